"""Numbers (N in the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 2) -> Column:
    """Half up on the binary product, not on the decimal rendering."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    sound = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(sound, 1 - dot(a, b) / norms).otherwise(1.0)


def truncated(v: Column, n: int) -> Column:
    return unit(F.slice(v, 1, n))


def cvss_grade(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score.isNotNull(), "medium")


def epss_grade(score: Column, percentile: Column) -> Column:
    return F.when((score >= 0.1) | (percentile >= 0.95), "critical").when((score >= 0.05) | (percentile >= 0.9), "high")


def vector_text(v: Column) -> Column:
    """A vector as a literal, `[1.0,2.5]`."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def vector(text: Column) -> Column:
    """The vector of such a literal; null where it is none."""
    bare = F.regexp_extract(F.btrim(text), r"^\[(.*)\]$", 1)
    parts = F.transform(F.split(bare, ","), lambda x: F.btrim(x).try_cast("float"))
    return F.when(F.btrim(text) == "[]", F.array().cast("array<float>")).when(~F.exists(parts, lambda x: x.isNull()), parts)
