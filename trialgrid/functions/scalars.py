"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RESULT_NAME = r"route_([0-9]+)_(.+)_seed([0-9]+)\.json$"


def try_double(c: Column) -> Column:
    """Blank text is missing, and so is text that is no number."""
    t = F.trim(c)
    return F.when(t == "", None).otherwise(t.try_cast("double"))


def tri_state(c: Column) -> Column:
    """True, false or missing."""
    t = F.lower(F.trim(c))
    return F.when(t == "true", True).when(t == "false", False)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def render_special(c: Column) -> Column:
    """A double as text: NaN is blank, infinities are spelled out."""
    return F.when(c.isNull() | F.isnan(c), "").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").otherwise(c.cast("string"))


def canon(c: Column) -> Column:
    """Text for comparison: blank, nan and none alike, 100 and 100.0 alike, True and true alike, nine digits at most."""
    t = F.trim(c.cast("string"))
    low = F.lower(t)
    number = t.try_cast("double")
    shown = F.when(number == float("inf"), "inf").when(number == float("-inf"), "-inf").otherwise(F.format_string("%.9f", F.round(number, 9) + F.lit(0.0)))
    return F.when(t.isNull() | low.isin("", "nan", "none", "null"), "").when(low.isin("true", "false"), low).when(number.isNotNull(), shown).otherwise(t)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def first_dotted(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def last_dotted(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def composite(*cols: Column) -> Column:
    """A key for display; joins use the columns."""
    return F.concat_ws("|", *cols)


def salted_digest(salt_hex: str, token: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit(salt_hex)), F.unhex(F.lit("00")), F.encode(token, "UTF-8")), 256)


def plain_path(uri: Column) -> Column:
    """A file's path as it was written: Spark gives it with escapes."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by '-'."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws("-", F.slice(tokens, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def word_number(message: Column, index: int, scale: float = 1.0) -> Column:
    """The number that is the message's word at an index."""
    return F.get(F.split(message, " "), F.lit(index)).try_cast("double") / F.lit(scale)


def relative_difference(x: Column, mu: float) -> Column:
    return F.abs(x - F.lit(mu)) / F.lit(mu)


def z_score(x: Column, mu: float, sigma: float) -> Column:
    return F.abs(x - F.lit(mu)) / F.lit(sigma)


def capsule_to_box(radius_cm: Column, half_height_cm: Column) -> Column:
    """Length, width and height in metres of an upright capsule."""
    across = F.lit(2.0) * radius_cm / 100.0
    return F.struct(across.alias("l"), across.alias("w"), (F.lit(2.0) * half_height_cm / 100.0).alias("h"))


def box_to_capsule(across: Column, height: Column) -> Column:
    return F.struct(F.round(across * 50.0, 1).alias("radius_cm"), F.round(height * 50.0, 1).alias("half_height_cm"))


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def projection(dx: Column, dy: Column, fx: Column, fy: Column) -> Column:
    """Dot product with a direction."""
    return dx * fx + dy * fy
