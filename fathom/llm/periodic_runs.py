"""Periodic runs of words by an all-lag vectorised scan.

A text's words become a numpy array of ids, and the array is compared with itself at every shift q up to n / min_exp. A stretch
of L equal places is a stretch of L + q words with period q; those with at least max(least, min_exp * q) words stay. A stretch
that has a smaller period too is found at that shift with the same ends (both periods divide one another by Fine and Wilf's
theorem, as the stretch is long), so of equal stretches the one with the least period is the run.

Most shifts hold no such stretch. A long enough one has min_exp - 1 equal places in a row among the multiples of q, and with
them all places between. So all shifts are looked at first at the multiples of q, n / q places each, in one vectorised step for
all shifts of a range; only shifts with such a row are compared in whole. Places inside a run already found whose period divides q
can only give that run again, and are not looked at further: a text of one word repeated is compared once.

Texts of up to LONG bytes are scanned where they are read. Longer ones are cut into ranges of shifts of about equal work, which
Spark deals to its tasks with the text's ids; what they find is put together by text. A run is an entry (start, length, period)
in words from 0. All texts are scanned whole, over all shifts.

Words are separated by space and \\t \\n \\v \\f \\r. A null text has no words, no runs, and stays null. Rows that repeat
are scanned each, but long ones once per distinct text (by a 256-bit digest); ids are not looked at. Columns keep their names and
values, whatever they are called. Without rows the result is empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.batches import map_rows
from fathom.llm.storage import save
from fathom.llm.text_stats import WHITE_CLASS, words

MIN_EXP, LEAST = 4, 6
#: Bytes of a text beyond which its shifts are dealt to several tasks.
LONG = 1 << 20
#: Work of a range of shifts: places looked at, with SHIFT_COST for each shift.
RANGE_WORK, SHIFT_COST = 1 << 24, 512
#: Places that one vectorised look holds at once, at most about so many.
PLACES = 1 << 19
RUNS = "array<struct<start: long, length: long, period: long>>"


def word_ids(text: str | None) -> np.ndarray:
    """Ids of the words: equal words have equal ids, those of no two different words are equal."""
    at: dict[bytes, int] = {}
    split = (text or "").encode().split()
    return np.fromiter((at.setdefault(w, len(at)) for w in split), dtype=np.int32, count=len(split))


def candidates(ids: np.ndarray, low: int, high: int, min_exp: int) -> tuple[np.ndarray, np.ndarray]:
    """(shifts, places): for shifts low to high, the multiples of the shift from which min_exp words, a shift apart, are equal."""
    n, links = len(ids), min_exp - 1
    shifts = np.arange(low, high + 1)
    counts = np.maximum((n - 1) // shifts - links + 1, 0)
    ends = np.cumsum(counts)
    found = []
    a = 0
    while a < len(shifts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PLACES, side="right")))
        q = np.repeat(shifts[a:b], counts[a:b])
        k = np.arange(len(q)) - np.repeat(np.cumsum(counts[a:b]) - counts[a:b], counts[a:b])
        at = k * q
        for j in range(links):
            same = ids[at + j * q] == ids[at + (j + 1) * q]
            at, q = at[same], q[same]
        # places between two of them, which are equal too if a long stretch is there
        for part in range(1, 8 if links > 1 else 0):
            same = ids[at + q * part // 8] == ids[at + q * part // 8 + q]
            at, q = at[same], q[same]
        found.append((q, at))
        a = b
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def stretches(ids: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths in words) of the longest stretches of period q with at least `least` words: compare, and run-length the true places."""
    same = np.zeros(len(ids) - q + 2, dtype=np.int8)
    np.equal(ids[:-q], ids[q:], out=same[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(same))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts + q >= least
    return starts[long], (ends - starts + q)[long]


def scan(ids: np.ndarray, low: int, high: int, min_exp: int = MIN_EXP, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the stretches at shifts low to high, the least period of each stretch."""
    high = min(high, len(ids) // min_exp)
    if high < low:
        return []
    shifts, at = candidates(ids, low, high, min_exp)
    found: dict[tuple[int, int], int] = {}
    starts = lengths = periods = np.empty(0, dtype=np.int64)
    for q, a, b in zip(*_groups(shifts), strict=True):
        fits = (q % periods == 0) & (lengths >= min_exp * q) if len(periods) else periods.astype(bool)
        hits = at[a:b]
        for s, length in zip(starts[fits], lengths[fits], strict=True):
            hits = hits[(hits < s) | (hits + q >= s + length)]
        if not len(hits):
            continue
        new = [(int(s), int(length)) for s, length in zip(*stretches(ids, q, max(least, min_exp * q)), strict=True)]
        new = [x for x in new if found.setdefault(x, int(q)) == q]
        starts = np.append(starts, [s for s, _ in new]).astype(np.int64)
        lengths = np.append(lengths, [x for _, x in new]).astype(np.int64)
        periods = np.append(periods, [q] * len(new)).astype(np.int64)
    return sorted((s, length, q) for (s, length), q in found.items())


def _groups(shifts: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Equal shifts stand together: each with the ends of its places."""
    if not len(shifts):
        return [], [], []
    cuts = [0, *(np.flatnonzero(np.diff(shifts)) + 1).tolist(), len(shifts)]
    return shifts[cuts[:-1]].tolist(), cuts[:-1], cuts[1:]


def ranges(n: int, min_exp: int, work: int = RANGE_WORK) -> list[tuple[int, int]]:
    """All shifts of a text of n words, in ranges (low, high) of about `work` places."""
    shifts = np.arange(1, n // min_exp + 1)
    if not len(shifts):
        return []
    part = np.cumsum(n // shifts + SHIFT_COST) // work
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(shifts)]
    return [(a + 1, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def runs(docs: DataFrame, text: str = "text", name: str = "runs", min_exp: int = MIN_EXP, least: int = LEAST, long: int = LONG, work: int = RANGE_WORK) -> DataFrame:
    """docs with a column `name`: the runs of `text` by start, then period. min_exp: 2 or more."""
    if min_exp < 2 or least < 1:
        raise ValueError("min_exp has to be at least 2, and least at least 1")
    size = F.coalesce(F.octet_length(text), F.lit(0))

    @F.pandas_udf(RUNS)
    def short(texts):
        import pandas as pd

        return pd.Series([[dict(zip(("start", "length", "period"), x, strict=True)) for x in scan(ids, 1, len(ids), min_exp, least)] for ids in map(word_ids, texts)], dtype="object")

    # the caller's columns are held in one, so that their names don't matter
    rows = docs.filter(size <= long).select(F.struct("*").alias("row"), short(F.col(text)).alias("found"))
    large = save(docs.filter(size > long).select(F.struct("*").alias("row"), F.sha2(text, 256).alias("digest")), "long-texts")
    if large.limit(1).count():
        found = save(long_runs(large.select("digest", F.col("row")[text].alias("text")), min_exp, least, work), "long-runs")
        rows = rows.unionByName(large.join(found, "digest", "left").select("row", F.coalesce("found", F.array().cast(RUNS)).alias("found")))
    return rows.select("row.*", F.col("found").alias(name))


def long_runs(texts: DataFrame, min_exp: int, least: int, work: int) -> DataFrame:
    """Rows (digest, text) to (digest, found), scanned by ranges of shifts; texts without runs are left out."""

    def cut():
        def step(cols):
            out = {"digest": [], "ids": [], "low": [], "high": []}
            for digest, t in zip(cols["digest"], cols["text"], strict=True):
                ids = word_ids(t)
                for low, high in ranges(len(ids), min_exp, work):
                    for k, v in zip(out, (digest, ids.tobytes(), low, high), strict=True):
                        out[k].append(v)
            return out

        return step

    def look():
        def step(cols):
            out = {"digest": [], "start": [], "length": [], "period": []}
            for digest, ids, low, high in zip(*(cols[k] for k in ("digest", "ids", "low", "high")), strict=True):
                for found in scan(np.frombuffer(ids, dtype=np.int32), low, high, min_exp, least):
                    for k, v in zip(out, (digest, *found), strict=True):
                        out[k].append(v)
            return out

        return step

    dealt = map_rows(texts.dropDuplicates(["digest"]), cut, "digest string, ids binary, low long, high long", rows=1).repartition("digest", "low")
    each = map_rows(dealt, look, "digest string, start long, length long, period long", rows=1)
    least_period = each.groupBy("digest", "start", "length").agg(F.min("period").alias("period"))
    return least_period.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("found"))


def dropped(n: int, found: list[dict]) -> np.ndarray:
    """For n words: true where a run holds the word after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for r in found:
        edges[r["start"] + r["period"]] += 1
        edges[r["start"] + r["length"]] -= 1
    return np.cumsum(edges[:n]) > 0


def collapsed(text: Column, found: Column) -> Column:
    """The words that stay when each run is cut to its first period, joined by one space; null for null."""

    @F.pandas_udf("string")
    def cut(texts, runs):
        import pandas as pd

        def one(t, found):
            if t is None:
                return None
            split = t.encode().split()
            gone = dropped(len(split), found)
            return b" ".join(w for w, g in zip(split, gone, strict=True) if not g).decode()

        return pd.Series([one(t, r) for t, r in zip(texts, runs, strict=True)], dtype="object")

    some = F.size(found) > 0
    plain = F.btrim(F.regexp_replace(text, WHITE_CLASS + "+", " "))
    return F.when(some, cut(F.when(some, text), found)).otherwise(plain)


def greatest(found: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first by start, then period. Null without runs."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(found, none, lambda a, x: F.when(better(a, x), x).otherwise(a))


def repeated_from(text: Column, at: Column, period: Column) -> Column:
    """The words of text joined by one space, where each word from `at` on is taken from the `period` words that begin there."""
    def again(x: Column) -> Column:
        w, at, period = x["w"], x["at"], x["period"]
        return F.transform(w, lambda word, i: F.when(i >= at, F.get(w, (at + (i - at) % period).cast("int"))).otherwise(word))

    # an array of one makes a name for what is used for each word
    named = F.array(F.struct(words(text).alias("w"), at.alias("at"), period.alias("period")))
    return F.array_join(F.get(F.transform(named, again), F.lit(0)), " ")
