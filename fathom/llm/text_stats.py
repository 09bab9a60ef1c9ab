"""Word and line statistics of texts as Spark expressions.

Words are runs of characters other than space and \\t \\n \\v \\f \\r. A null text has no words and no lines with one.
"""

from pyspark.sql import Column, functions as F

WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """All words in order; an empty array for null."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(text.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS + "+"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.size(lines) - F.size(F.array_distinct(lines))


def window_hashes(hashes: Column, width: int) -> Column:
    """64-bit hashes of all windows of `width` consecutive words, from the hashes of the words."""
    return F.when(
        F.size(hashes) >= width,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width)))),
    ).otherwise(F.array().cast("array<long>"))


def covered_by_repeats(windows: Column, width: int) -> Column:
    """Words inside windows that occur twice or more, from the hashes of all windows; only texts with a repeat pay for sorting."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # an array of one makes a name for what is used more than once
    found = F.get(F.transform(F.array(ordered), lambda s: F.get(F.transform(F.array(repeated(s)), total), F.lit(0))), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(found)
