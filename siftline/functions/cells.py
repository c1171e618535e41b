"""The cell semantics, each stated once, as native Column expressions.

Nothing here uses a Python UDF: all of it stays in the JVM and inside generated
code where Spark can generate it. Timestamps are read in the session timezone,
which `siftline.session` pins to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values that must equal the source system's for right results ------

# Whitespace as a browser's String.trim sees it.
WHITESPACE = "".join(
    chr(code)
    for code in [
        0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
    ]
)
# Text that means "no value", compared after trim and lower.
MISSING_TOKENS = ["", "n/a", "na", "null", "nil", "-", "\u2014", ".", "?"]
TRUE_TOKENS = ["true", "yes", "1"]
FALSE_TOKENS = ["false", "no", "0"]
# Plain numbers, or numbers with comma-grouped thousands.
NUMERIC_PATTERN = r"^-?\d{1,3}(,\d{3})*(\.\d+)?$|^-?\d+(\.\d+)?$"
# Longest numeric prefix, as parseFloat reads it (commas already removed).
NUMERIC_PREFIX = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)"
# A whole-string decimal literal, as Number() reads it.
DECIMAL_LITERAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Accepted date shapes: Y-M-D, Y/M/D, M/D/Y, M-D-Y, ISO date and time.
DATE_PATTERN = (
    r"^\d{4}-\d{1,2}-\d{1,2}$|^\d{4}/\d{1,2}/\d{1,2}$"
    r"|^\d{1,2}/\d{1,2}/\d{4}$|^\d{1,2}-\d{1,2}-\d{4}$"
    r"|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"
)

# ------------------------------------------------------------------------------

_SPACE_CLASS = "".join(f"\\x{{{ord(ch):X}}}" for ch in WHITESPACE)
_WORD_OR_GAP = rf"[A-Za-z0-9_][^{_SPACE_CLASS}]*|[^A-Za-z0-9_]+"


def js_trim(c: Column) -> Column:
    """Strip all Unicode whitespace; Spark's `trim` strips spaces only.

    Names its input once: a filter pushed through several cleaning steps repeats what
    each step does, so the common functions must not multiply it.
    """
    return F.btrim(c, F.lit(WHITESPACE))


def normal_form(c: Column) -> Column:
    return F.lower(js_trim(c))


def short_lower(t: Column) -> Column:
    """Lower case of a trimmed text that is short enough to be a known word."""
    return F.when(F.length(t) <= 5, F.lower(t)).otherwise(t)


def is_missing(c: Column) -> Column:
    return F.coalesce(normal_form(c), F.lit("")).isin(MISSING_TOKENS)


def _starts_number(t: Column) -> Column:
    """First character is a digit, sign or point: a cheap test before any pattern."""
    first = F.ascii(t)
    return first.between(48, 57) | first.isin(43, 45, 46)


def numeric_text(t: Column) -> Column:
    """`looks_numeric` of a trimmed text."""
    return F.when(_starts_number(t), t.rlike(NUMERIC_PATTERN)).when(t.isNotNull(), False)


def looks_numeric(c: Column) -> Column:
    return numeric_text(js_trim(c))


def looks_boolean(c: Column) -> Column:
    return short_lower(js_trim(c)).isin(TRUE_TOKENS + FALSE_TOKENS)


def date_of_text(t: Column) -> Column:
    """`parse_date` of a trimmed text."""
    month_first = F.regexp_replace(t, r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", "$3-$1-$2")
    year_first = ~F.substring(t, 2, 1).isin("-", "/") & ~F.substring(t, 3, 1).isin("-", "/")
    dashed = (
        F.when(t.contains("T"), t)
        .when(year_first, F.translate(t, "/", "-"))
        .otherwise(F.translate(month_first, "/", "-"))
    )
    plausible = F.ascii(t).between(48, 57) & (F.length(t) >= 8)
    return F.when(plausible & t.rlike(DATE_PATTERN), dashed.try_cast("timestamp"))


def parse_date(c: Column) -> Column:
    """Timestamp of a cell in one of the accepted shapes, else null.

    The shape is checked first, then month-first dates are turned around so that
    one `try_cast` reads all of them: no formatter, so no exception per bad cell.
    """
    return date_of_text(js_trim(c))


def looks_date(c: Column) -> Column:
    return F.coalesce(parse_date(c).isNotNull(), F.lit(False))


def to_iso_date(c: Column) -> Column:
    return F.date_format(parse_date(c), "yyyy-MM-dd")


def finite(x: Column) -> Column:
    """Null for infinities and NaN."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def bounded(x: Column) -> Column:
    """Null for infinities; enough for numbers read from text, which are never NaN.

    `x` is named once: a filter that is pushed through several steps repeats what it tests.
    """
    return F.get(F.filter(F.array(x), lambda v: F.abs(v) < F.lit(float("inf"))), F.lit(0))


# The number that a cell text without commas holds: all of it, or its longest numeric prefix.
# One pattern for both, so the cell is named once. An exponent counts in a prefix only where the
# text as a whole is no plain number, which has none.
def number_of_text(t: Column) -> Column:
    """`parse_numeric` of a trimmed text: commas dropped, then the longest numeric prefix."""
    return F.regexp_extract(F.translate(t, ",", ""), NUMERIC_PREFIX, 0).try_cast("double")


def parse_numeric(c: Column) -> Column:
    """Number at the start of the text ("12 kg" -> 12), commas ignored."""
    return bounded(number_of_text(js_trim(c)))


def chart_number_of_text(t: Column) -> Column:
    """`chart_number` of a trimmed text, infinities not yet excluded."""
    number = F.when(_starts_number(t) & t.rlike(DECIMAL_LITERAL), t.try_cast("double"))
    for pattern, bits in ((r"^0[xX][0-9a-fA-F]+$", 4), (r"^0[oO][0-7]+$", 3), (r"^0[bB][01]+$", 1)):
        number = number.when((F.ascii(t) == 48) & t.rlike(pattern), _digits_value(F.substr(t, F.lit(3)), bits))
    return number


def _digits_value(digits: Column, bits: int) -> Column:
    """The double nearest to a literal of any length in base 2 ** bits, ties to even.

    The leading 54 significant bits or more are a whole number that a bigint holds; whether any
    later digit is not 0 is kept as its last bit, so that the one rounding, from bigint to double,
    is right; what is left is a power of two.
    """
    held = 60 // bits
    plain = F.regexp_replace(digits, "^0+", "")
    head, tail = F.substr(plain, F.lit(1), F.lit(held)), F.substr(plain, F.lit(held + 1))
    whole = F.coalesce(F.conv(head, 2**bits, 10).try_cast("bigint"), F.lit(0))
    sticky = F.when(tail.rlike("[^0]"), 1).otherwise(0)
    value = whole.bitwiseOR(sticky.cast("bigint")).cast("double")
    return value * F.pow(F.lit(2.0), F.lit(bits) * F.length(tail))


def chart_number(c: Column) -> Column:
    """Number only if the whole text is one; commas are refused.

    No missing-value word is a number, so there is nothing else to exclude.
    """
    return bounded(chart_number_of_text(js_trim(c)))


def title_case(c: Column) -> Column:
    """Upper-case the first character of each word, lower-case the rest.

    A word starts at an ASCII word character and runs to the next space, so
    leading punctuation stays; `initcap` differs on "(hello)".
    """
    parts = F.regexp_extract_all(c, F.lit(_WORD_OR_GAP), F.lit(0))
    starts_word = r"^[A-Za-z0-9_]"
    cased = F.transform(
        parts,
        lambda p: F.when(
            p.rlike(starts_word),
            F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))),
        ).otherwise(p),
    )
    return F.array_join(cased, "")


def to_bool_token(c: Column) -> Column:
    """"true" or "false" for the known words, else null."""
    n = normal_form(c)
    return F.when(n.isin(TRUE_TOKENS), F.lit("true")).when(n.isin(FALSE_TOKENS), F.lit("false"))


def round_half_up(x: Column, digits: int) -> Column:
    """Round half toward +infinity; Spark's `round` goes away from zero."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def number_text(x: Column) -> Column:
    """A double written the way a browser writes it: "1", "0.0001", "1e+21".

    Java's shortest text is taken apart and its decimal point moved.
    """
    s = x.cast("double").cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    lead = F.regexp_extract(s, r"^-?(\d)", 1)
    frac = F.regexp_replace(F.regexp_extract(s, r"\.(\d+)E", 1), r"0+$", "")
    e = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.concat(lead, frac)
    whole = F.concat(sign, F.rpad(digits, e + 1, "0"))
    split = F.concat(sign, F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    mantissa = F.when(frac == "", lead).otherwise(F.concat_ws(".", lead, frac))
    power = F.concat(
        sign, mantissa, F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(e).cast("string")
    )
    moved = (
        F.when(e.between(0, 20) & (F.length(frac) <= e), whole)
        .when(e.between(0, 20), split)
        .when(e.between(-6, -1), small)
        .otherwise(power)
    )
    plain = F.regexp_replace(s, r"\.0$", "")
    return F.when(s == "-0.0", F.lit("0")).when(s.contains("E"), moved).otherwise(plain)


def fixed_one(x: Column) -> Column:
    """One decimal, rounded by the double's exact value, halves away from zero.

    Multiplying by ten would round first and turn 1.45 (just below the half) into 1.5.
    The distance to the half is therefore summed from parts that are exact.
    """
    a = F.abs(x)
    f = a - F.floor(a)
    k = F.floor(f * 10)
    over_half = (f * 8 - (k + F.lit(0.5))) + f * 2 >= 0
    tenths = F.floor(a) * 10 + k + F.when(over_half, 1).otherwise(0)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(
        sign,
        F.floor(tenths / 10).cast("bigint").cast("string"),
        F.lit("."),
        (tenths % 10).cast("bigint").cast("string"),
    )


def stringify(c: Column, dtype: T.DataType) -> Column:
    """Text of a typed cell, so that typed tables follow the text rules."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return number_text(c)
    if isinstance(dtype, T.DecimalType):
        text = c.cast("string")
        return F.when(
            text.contains("."), F.regexp_replace(text, r"\.?0+$", "")
        ).otherwise(text)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")
