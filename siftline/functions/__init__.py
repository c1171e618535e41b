"""Cell-level functions: every one is a Column -> Column expression."""

from .cells import (
    chart_number,
    fixed_one,
    is_missing,
    js_trim,
    looks_boolean,
    looks_date,
    looks_numeric,
    normal_form,
    number_text,
    parse_date,
    parse_numeric,
    round_half_up,
    stringify,
    title_case,
    to_bool_token,
    to_iso_date,
)

__all__ = [
    "chart_number",
    "fixed_one",
    "is_missing",
    "js_trim",
    "looks_boolean",
    "looks_date",
    "looks_numeric",
    "normal_form",
    "number_text",
    "parse_date",
    "parse_numeric",
    "round_half_up",
    "stringify",
    "title_case",
    "to_bool_token",
    "to_iso_date",
]
