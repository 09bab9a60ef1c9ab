"""Vector functions as Spark expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY = 1e-10


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v at length 1; as it is when its length is next to nothing."""
    n = norm(v)
    return F.when(n < TINY, doubles(v)).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 when the lengths differ or a norm is next to nothing."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (scale < TINY), F.lit(0.0)).otherwise(dot(a, b) / scale)


def cosine_truncated(a: Column, b: Column) -> Column:
    """Cosine over as many components as both have."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n < 1, F.lit(0.0)).otherwise(cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def from_distance(d: Column) -> Column:
    return 1 / (1 + d)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    raised = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / total(raised))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def band(similarity: Column) -> Column:
    """A word for how alike two texts are."""
    return F.when(similarity > 0.9, "very high").when(similarity > 0.7, "high").when(similarity > 0.5, "medium").when(similarity > 0.3, "low").otherwise("very low")


def level_weight(level: Column) -> Column:
    return F.when(level == 1, 1.5).when(level == 2, 1.3).when(level == 3, 1.1).otherwise(1.0)


def chunk_weight(level: Column, length: Column) -> Column:
    return level_weight(level) * F.when(length < 200, 1.2).otherwise(1.0)


def aggregate_weight(level: Column, tokens: Column, weight: Column) -> Column:
    """The weight of a chunk in the vector of its document or section."""
    return level_weight(level) * F.when(tokens < 100, 1.2).otherwise(1.0) * F.when(tokens > 500, 0.8).otherwise(1.0) * weight


def storage_bytes(count: Column, dimension: Column) -> Column:
    return (count * dimension * 4).cast("long")


def checked_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length, else an error of the query; 0 when a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is over 0, component by component; zeros if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] > 0), lambda x: x["v"])
    zeros = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    sums = F.aggregate(kept, zeros, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(sums, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def first_pool(tokens: Column) -> Column:
    """The vector of the first token."""
    return doubles(F.get(tokens, F.lit(0)))


def to_json(v: Column) -> Column:
    return F.to_json(v)


def of_json(text: Column) -> Column:
    """A vector of a JSON list; empty for null or what is no list."""
    return F.coalesce(F.from_json(text, "array<float>"), F.array().cast("array<float>"))


def megabytes(n: Column) -> Column:
    """Bytes as MB with two decimals, halves to the even digit."""
    return F.bround(n / (1024 * 1024), 2)
