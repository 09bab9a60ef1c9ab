"""Filter interaction audit: what each filter removes under every order of the filters, by a first-failure lookup.

A row that fails a set of m filters falls, under one order of them, at the first filter of the order that it fails. That
place depends on the set alone, so it is looked up in a table made once: 2^m failure sets by m! orders. Each task indexes
the table with the failure sets of its Arrow batches and counts places with np.bincount, by part, order and step, once for all
rows and once for the rows of each label. A task hands on one array of counts per part (when it holds more than HELD parts it
hands on what it has and starts anew), and Spark adds the arrays up, place by place.

Filters that failed are booleans, null is not failed. A null part is the part "". Labels are 0 or 1, null is 0. Rows that
repeat count each. Parts without rows have no result, so an empty table gives an empty one. Other columns are not looked at.

The five filters of `failures` judge `documents`: null texts are empty; of documents with one text only those with the least
doc_id pass E, a null doc_id comes before others, and rows with the same doc_id and text are not each other's copies. Texts
count as identical when their 256-bit digests are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.storage import save, small_join
from fathom.llm.text_stats import words

FILTERS = ("A", "B", "C", "D", "E")
#: Parts whose counts a task holds at once: about 15 kB each with five filters and two labels.
HELD = 1000
#: Places that one np.bincount gets at once, at most about so many.
PLACES = 1 << 21


def orders(n: int) -> list[tuple[int, ...]]:
    return list(permutations(range(n)))


def first_failures(n: int) -> np.ndarray:
    """[failure set, order]: the step at which a row falls that fails the filters of the set (bit k: filter k), n if it stays."""
    all_orders = np.array(orders(n))
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    in_order = fails[:, all_orders]  # [set, order, step]
    return np.where(in_order.any(axis=2), in_order.argmax(axis=2), n)


class Tally:
    """Counts of one part: rows that fall by (order, step), for all rows and for each label; then rows, fails and only fails by filter."""

    def __init__(self, n_filters: int, n_labels: int):
        self.table = first_failures(n_filters)
        self.m, self.n_labels, self.n_orders = n_filters, n_labels, len(self.table[0])
        self.held: dict[str, np.ndarray] = {}

    def add(self, parts: list[str], sets: np.ndarray, labels: np.ndarray) -> None:
        """labels: [label, row], true or false."""
        names, at = np.unique(np.array(parts, dtype=object), return_inverse=True)
        o, m, k = self.n_orders, self.m, len(names)
        made = np.zeros((k, self.width), dtype=np.int64)
        base = (np.arange(o) * (m + 1))[None, :]
        step = max(1, PLACES // o)
        for a in range(0, len(sets), step):
            places = (at[a : a + step, None] * (o * (m + 1)) + base + self.table[sets[a : a + step]]).astype(np.int64)
            for j, rows in enumerate([slice(None), *(labels[:, a : a + step])]):
                fell = np.bincount(places[rows].ravel(), minlength=k * o * (m + 1)).reshape(k, o, m + 1)
                made[:, j * o * m : (j + 1) * o * m] += fell[:, :, :m].reshape(k, o * m)
        tail = (1 + self.n_labels) * o * m
        made[:, tail] = np.bincount(at, minlength=k)
        for f in range(m):
            made[:, tail + 1 + f] = np.bincount(at[(sets >> f) & 1 == 1], minlength=k)
            made[:, tail + 1 + m + f] = np.bincount(at[sets == 1 << f], minlength=k)
        for i, name in enumerate(names):
            self.held[name] = self.held[name] + made[i] if name in self.held else made[i]

    @property
    def width(self) -> int:
        return (1 + self.n_labels) * self.n_orders * self.m + 1 + 2 * self.m


def partial_counts(df: DataFrame, part: str, filters: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(part, counts): the arrays of Tally, one row per task and part."""
    kind = "part string, counts array<long>"
    arrow = pa.schema([("part", pa.string()), ("counts", pa.list_(pa.int64()))])
    m, n_labels = len(filters), len(labels)
    sets = sum((F.when(F.col(c), 1 << k).otherwise(0) for k, c in enumerate(filters)), F.lit(0))
    held = df.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), sets.alias("sets"), F.array(*(F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1 for c in labels)).alias("labels") if labels else F.array().cast("array<boolean>").alias("labels"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(m, n_labels)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"part": list(tally.held), "counts": [x.tolist() for x in tally.held.values()]}, schema=arrow)
            tally.held = {}
            return made

        for batch in batches:
            if batch.num_rows:
                flat = batch.column("labels").flatten().to_numpy(zero_copy_only=False).astype(bool)
                tally.add(batch.column("part").to_pylist(), batch.column("sets").to_numpy(), flat.reshape(batch.num_rows, n_labels).T)
            if len(tally.held) > HELD:
                yield out()
        if tally.held:
            yield out()

    return held.mapInArrow(count, kind)


def audit(df: DataFrame, part: str, filters: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """A row per part, order of the filters and step: what the step's filter removes there.

    filters: boolean columns, true where the row fails the filter of that name. labels: columns of 0 and 1.
    Columns: part, filter_order (the names put together), step (from 1), filter, kept, removed, redundant, unique_fails,
    <label>_lost for each label, shapley (what the filter removes, summed over all orders).
    """
    m = len(filters)
    every = orders(m)
    o = len(every)
    parts = partial_counts(df, part, filters, labels).select("part", F.posexplode("counts").alias("at", "n"))
    summed = parts.groupBy("part", "at").agg(F.sum("n").alias("n"))
    c = F.col("counts")
    # a row per part, written so that the arrays are put together once and not wherever they are looked up
    counts = save(summed.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("counts")), "audit-counts")
    # lists of numbers are one literal each
    numbers = lambda x: F.split(F.lit(" ".join(map(str, x))), " ").cast("array<int>")
    where = F.array(*(numbers(k * m + order.index(f) for k, order in enumerate(every)) for f in range(m)))
    shapley = F.transform(where, lambda at: F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a + F.get(c, i)))
    rows = counts.select("part", "counts", shapley.alias("shapley"), F.explode(F.sequence(F.lit(0), F.lit(o * m - 1))).alias("at"))
    rows = rows.withColumns({"step": F.col("at") % m + 1, "f": F.get(numbers(f for order in every for f in order), F.col("at"))})
    order = F.get(F.split(F.lit("\x1f".join("".join(filters[f] for f in x) for x in every)), "\x1f"), F.expr(f"cast(at div {m} AS int)"))
    tail = (1 + len(labels)) * o * m
    removed = F.get(c, F.col("at"))
    through = F.aggregate(F.slice(c, F.col("at") - F.col("step") + 2, F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "part",
        order.alias("filter_order"),
        "step",
        F.get(F.array(*map(F.lit, filters)), F.col("f")).alias("filter"),
        (F.get(c, F.lit(tail)) - through).alias("kept"),
        removed.alias("removed"),
        (F.get(c, F.lit(tail + 1) + F.col("f")) - removed).alias("redundant"),
        F.get(c, F.lit(tail + 1 + m) + F.col("f")).alias("unique_fails"),
        *(F.get(c, F.lit((1 + j) * o * m) + F.col("at")).alias(f"{name}_lost") for j, name in enumerate(labels)),
        F.get("shapley", F.col("f")).alias("shapley"),
    )


def conditions(text: Column) -> dict[str, Column]:
    """The failures that a text alone decides."""
    t, w = F.coalesce(text, F.lit("")), words(text)
    return {
        "A": F.size(w) < 100,
        "B": 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
        "C": 100 * (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))) > 10 * F.length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, part: str, marks: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, and the columns of marks but doc_id) for all rows of docs (doc_id, text, part).

    marks: (doc_id, columns of 0 and 1); where a doc_id repeats there, the greatest value counts. A null doc_id has no marks.
    """
    names = [c for c in marks.columns if c != "doc_id"]
    least = F.lit(-(1 << 63))
    held = docs.select("doc_id", F.col(part).cast("string").alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), *(x.alias(k) for k, x in conditions(F.col("text")).items()))
    rows = save(held.withColumn("place", F.coalesce("doc_id", least)), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").select("digest", "first")
    with_first = small_join(rows, save(first, "audit-copies"), "digest", "left").drop("digest")
    known = save(marks.filter("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.col(c).cast("int")).alias(c) for c in names)), "audit-marks")
    later = F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("E")
    return small_join(with_first, known, "doc_id", "left").select("part", *FILTERS[:4], later, *names)
