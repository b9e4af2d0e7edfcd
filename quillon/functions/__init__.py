"""Column functions: JVM expressions only, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a text field that count. Fixed value.
TEXT_LIMIT = 16_384
CATEGORY_LIMIT = 512


def blank_if_null(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def clean_text(x: Column, limit: int | None = TEXT_LIMIT) -> Column:
    """Lower case, the first ``limit`` characters (None: all); addresses, long hex runs and digits become placeholder words."""
    lower = F.lower(blank_if_null(x))
    short = lower if limit is None else F.substring(lower, 1, limit)
    no_address = F.regexp_replace(short, r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", " ipaddr ")
    no_hex = F.regexp_replace(no_address, r"(?U)\b[0-9a-f]{16,}\b", " hexvalue ")
    return F.regexp_replace(no_hex, r"(?U)\d+", " num ")


def tokens(cleaned: Column) -> Column:
    """Word runs made up of at least two of a-z and underscore."""
    runs = F.regexp_extract_all(cleaned, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda t: t.rlike("^[a-z_]{2,}$"))


def bigrams(words: Column) -> Column:
    """Neighbouring pairs of the kept tokens, joined by a space."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def terms(words: Column) -> Column:
    return F.concat(words, bigrams(words))


def portable_hash(x: Column, width: int) -> Column:
    """The first 32 bits of MD5, modulo a width: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % width


def fixed(x: Column, scale: int) -> Column:
    """A real number as a whole one, rounded half up: sums of these don't depend on their order."""
    return F.floor(x * F.lit(float(scale)) + 0.5).cast("long")


def valid_port(x: Column) -> Column:
    value = x.try_cast("double")
    return F.coalesce(value.between(0, 65535), F.lit(False))


def port_value(x: Column) -> Column:
    """log1p of a port over log of 65,536; 0 for what is no port."""
    return F.when(valid_port(x), F.log1p(x.try_cast("double")) / F.log(F.lit(65536.0))).otherwise(F.lit(0.0))


def cyclic(step: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a cycle's step, both moved to 0..1; 0 without a step."""
    angle = step.cast("double") * F.lit(6.283185307179586 / period)
    return (F.coalesce((F.sin(angle) + 1) / 2, F.lit(0.0)), F.coalesce((F.cos(angle) + 1) / 2, F.lit(0.0)))


def softmax(scores: Column) -> Column:
    """Of an array, with the largest subtracted first."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: p / total)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def position(x: Column) -> Column:
    """``[x y z]`` as an array of three finite numbers, else null; nothing is evaluated."""
    parts = F.filter(F.split(F.regexp_replace(x, r"[\[\],]", " "), r"\s+"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    good = (F.size(numbers) == 3) & ~F.exists(numbers, lambda n: n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")))
    return F.when(good, numbers)
