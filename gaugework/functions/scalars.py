"""Column expressions shared by the analyses.  All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts a CSV cell may hold to say "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Texts that make a text column look boolean.
BOOLEAN_TOKENS = ("true", "false", "yes", "no", "y", "n")
# Texts the boolean conversion understands.
TRUE_TOKENS = ("true", "yes", "y", "1")
FALSE_TOKENS = ("false", "no", "n", "0")

_INFINITE = r"(?i)^[+-]?inf(inity)?$"
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"
_CLOCK = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:\d{2})?)?"
# ISO 8601 in its extended form: a date, then maybe a time to the minute or finer, then maybe an offset.
_ISO_DAY, _ISO_TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
_ISO_OFFSET = r"(?:Z|[+-]\d{2}:\d{2})"
_ISO_TEXT = f"(?i)^{_ISO_DAY}(?:[T ]{_ISO_TIME}{_ISO_OFFSET}?)?$"
_ZONE_TEXT = r"(?i)\d:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_NAME = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    r"sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)

_YEAR_FIRST = r"(?i)^\d{4}[-/]\d{1,2}[-/]\d{1,2}" + _CLOCK + r"$"
_NUMERIC_DATE = r"(?i)^(\d{1,2})[/.](\d{1,2})[/.](\d{4})(" + _CLOCK + r")$"
_DAY_NAME = r"(?i)^(\d{1,2})[- ]" + _MONTH_NAME + r"[- ](\d{4})(" + _CLOCK + r")$"
_NAME_DAY = r"(?i)^" + _MONTH_NAME + r" (\d{1,2}),? (\d{4})(" + _CLOCK + r")$"

POSITIVE_INFINITY = float("inf")
LONGEST_DATE = 80  # characters without the blanks around; every accepted spelling is shorter


# All blanks of Unicode, as str.strip() takes them off.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


def strip(text: Column) -> Column:
    """The text without blanks of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def storage_kind(data_type: T.DataType) -> str:
    """number, boolean, datetime, string, or other."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "other"


def blank_to_null(text: Column) -> Column:
    """Null-token text becomes NULL."""
    return F.when(~text.isin(*NULL_TOKENS), text)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def text_to_number(text: Column) -> Column:
    """Number held in a text, NULL when the whole text is not a number.

    The pattern guards the cast, which alone would also accept ``1d``.  A
    decimal text too large for a double is not a number; ``inf`` is.
    """
    trimmed = strip(text)
    number = F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))
    overflow = (F.abs(number) == POSITIVE_INFINITY) & ~trimmed.rlike(_INFINITE)
    return F.when(~overflow, number)


def as_number(value: Column, kind: str) -> Column:
    """Double view of a numeric or text column; NaN is NULL and -0.0 is 0.0."""
    if kind == "string":
        return text_to_number(value) + F.lit(0.0)
    if kind == "boolean":
        return value.cast("int").cast("double")
    return nan_to_null(value.cast("double")) + F.lit(0.0)


def finite(number: Column) -> Column:
    return F.when(F.abs(number) < POSITIVE_INFINITY, number)


def is_infinite(number: Column) -> Column:
    return F.abs(number) == POSITIVE_INFINITY


def normal_label(text: Column) -> Column:
    return F.lower(strip(text))


def text_to_timestamp(text: Column) -> Column:
    """Timestamp held in a text, tried format by format; NULL when none fits.

    Each accepted spelling is rewritten to ISO order and cast, so no formatter
    runs and a miss costs one anchored pattern.  Slashed and dotted dates are
    month first; day first is the second try, hence only for months above 12.
    Values with an offset become that instant, others are read in the session
    time zone (UTC).
    """
    short = F.when(F.length(strip(text)) <= LONGEST_DATE, strip(text))
    year_first = F.translate(short, "/", "-").try_cast("timestamp")
    plausible = short.rlike(r"^\w.*[-/. ]\d{4}")
    return F.when(short.rlike(_YEAR_FIRST), year_first).when(plausible, one_by_one(short, _read_year_last))


def one_by_one(value: Column, read: Callable[[Column], Column]) -> Column:
    """``read`` of the value, evaluated as a function of its own.

    Generated code for a long expression is otherwise pasted into the loop of
    whatever operator uses it, and a loop that long is never compiled to machine
    code: several times slower.  The lambda of ``transform`` stays outside.
    """
    return F.get(F.transform(F.array(value), read), F.lit(0))


def _read_year_last(t: Column) -> Column:
    month_of = F.create_map(
        *[F.lit(x) for i, m in enumerate(_MONTHS, 1) for x in (m, f"{i:02d}")]
    )

    def named(pattern: str, day: int, month: int) -> Column:
        number = month_of[F.lower(F.regexp_extract(t, pattern, month).substr(1, 3))]
        day_on = F.regexp_replace(t, pattern, f"${day}$4")
        return F.concat(F.regexp_extract(t, pattern, 3), F.lit("-"), number, F.lit("-"), day_on).try_cast("timestamp")

    month_first = F.regexp_replace(t, _NUMERIC_DATE, "$3-$1-$2$4").try_cast("timestamp")
    day_first = F.regexp_replace(t, _NUMERIC_DATE, "$3-$2-$1$4").try_cast("timestamp")
    return (
        F.when(t.rlike(_NUMERIC_DATE), F.coalesce(month_first, day_first))
        .when(t.rlike(_DAY_NAME), named(_DAY_NAME, 1, 2))
        .when(t.rlike(_NAME_DAY), named(_NAME_DAY, 2, 1))
    )


def as_timestamp(value: Column, kind: str) -> Column:
    return text_to_timestamp(value) if kind == "string" else value.cast("timestamp")


def has_zone(text: Column) -> Column:
    return strip(text).rlike(_ZONE_TEXT)


def is_iso_text(text: Column) -> Column:
    return strip(text).rlike(_ISO_TEXT)


def text_to_boolean(text: Column) -> Column:
    label = normal_label(text)
    return F.when(label.isin(*TRUE_TOKENS), F.lit(True)).when(
        label.isin(*FALSE_TOKENS), F.lit(False)
    )


def unbiased_skewness(g1: Column, n: Column) -> Column:
    """Sample skewness from the population one; NULL below three values."""
    d = n.cast("double")
    return F.when(d >= 3, F.coalesce(F.sqrt(d * (d - 1)) / (d - 2) * g1, F.lit(0.0)))


def unbiased_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population one; NULL below four values."""
    d = n.cast("double")
    scaled = (d - 1) / ((d - 2) * (d - 3)) * ((d + 1) * g2 + 6)
    return F.when(d >= 4, F.coalesce(scaled, F.lit(0.0)))


def skew_label(skewness: Column) -> Column:
    return (
        F.when(skewness.isNull(), None)
        .when(F.abs(skewness) < 0.5, "symmetric")
        .when(skewness >= 1.0, "highly right-skewed")
        .when(skewness > 0, "moderately right-skewed")
        .when(skewness <= -1.0, "highly left-skewed")
        .otherwise("moderately left-skewed")
    )


def kurtosis_label(kurtosis: Column) -> Column:
    return (
        F.when(kurtosis.isNull(), None)
        .when(kurtosis > 1.0, "leptokurtic")
        .when(kurtosis < -1.0, "platykurtic")
        .otherwise("mesokurtic")
    )


def omnibus_p(n: Column, g1: Column, g2: Column) -> Column:
    """p-value of the skewness-and-kurtosis normality test (D'Agostino 1970,
    Anscombe and Glynn 1983) from population moments.  Two degrees of freedom,
    so the chi-square tail is a plain exponential."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z_skew = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))

    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - expected) / F.sqrt(variance)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1 / 3))
    z_kurt = (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))
    return F.exp(-(z_skew * z_skew + z_kurt * z_kurt) / 2)


def grade(score: Column, a: int, b: int, c: int, d: int) -> Column:
    return (
        F.when(score >= a, "A").when(score >= b, "B").when(score >= c, "C").when(score >= d, "D").otherwise("F")
    )


def corrected_v(chi2: Column, n: Column, r: Column, c: Column) -> Column:
    """Bias-corrected Cramér's V (Bergsma 2013); 0 when nothing is left of it."""
    n, r, c = n.cast("double"), r.cast("double"), c.cast("double")
    phi2 = F.greatest(F.lit(0.0), chi2 / n - (r - 1) * (c - 1) / (n - 1))
    r2 = r - (r - 1) * (r - 1) / (n - 1)
    c2 = c - (c - 1) * (c - 1) / (n - 1)
    room = F.least(r2 - 1, c2 - 1)
    return F.when((n > 1) & (room > 0), F.sqrt(phi2 / room)).otherwise(0.0)
