"""Content fingerprints."""

from pyspark.sql import Column, functions as F


def fingerprint(text: Column) -> Column:
    return F.upper(F.sha2(text, 256))


def short_hash(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.substring(F.sha2(text, 256), 1, 16))


def query_hash(text: Column) -> Column:
    return F.upper(F.substring(F.sha2(text, 256), 1, 16))


def sampled_fingerprint(content: Column, edge: int = 4096) -> Column:
    """Of the size and both ends of a binary content."""
    size = F.length(content)
    ends = F.concat(F.substring(content, 1, edge), F.when(size > edge, F.substring(content, F.greatest(size - edge + 1, F.lit(edge + 1)), F.lit(edge))).otherwise(F.lit(b"")))
    return F.upper(F.sha2(F.concat(F.unhex(F.lpad(F.hex(size.cast("long")), 16, "0")), ends), 256))


def same_hash(a: Column, b: Column) -> Column:
    return F.upper(a) == F.upper(b)


def chunk_id(file_id: Column, index: Column) -> Column:
    return F.sha2(F.concat(file_id.cast("string"), F.lit("#"), index.cast("string")), 256)
