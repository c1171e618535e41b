"""Data profiling, quality checks and cleaning as Spark DataFrame operators."""

from .plans.profile import Profiler, profile_dataset
from .plans.recipe import Step, apply_recipe
from .session import session

__all__ = ["Profiler", "Step", "apply_recipe", "profile_dataset", "session"]
