"""Jobs made of several operators: profile, issues, recipe, suggestions."""
