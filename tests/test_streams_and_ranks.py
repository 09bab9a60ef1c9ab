"""Bursts of changes on streams and tables, exact percentiles, and pages by cursors."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fathom.operators import records, stats
from fathom.streaming import changes

START = dt.datetime(2024, 1, 1)
EVENTS = "path string, ts timestamp, change string, old_path string"


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def settled(df):
    return sorted((tuple(r) for r in df.select("path", "change", "old_path", "first", "last", "n").collect()), key=str)


def plain(events, quiet):
    """Bursts of each path, one event after another."""
    by_path, out = {}, []
    for path, ts, change, old in events:
        by_path.setdefault(path, []).append((ts, change, old))
        if old is not None:
            by_path.setdefault(old, []).append((ts, None, None))
    for path, found in by_path.items():
        bursts = []
        for x in sorted(found, key=lambda x: x[0]):
            if bursts and x[0] - bursts[-1][-1][0] < dt.timedelta(milliseconds=quiet):
                bursts[-1].append(x)
            else:
                bursts.append([x])
        for b in bursts:
            away = max((t for t, c, _ in b if c is None), default=dt.datetime.min)
            left = [x for x in b if x[1] is not None and x[0] > away]
            if left:
                came = max(((t, o) for t, _, o in left if o), default=(0, None))[1]
                out.append((path, max((t, c) for t, c, _ in left)[1], came, min(left)[0], max(left)[0], len(left)))
    return sorted(out, key=str)


def events(seed, n=200):
    rng = random.Random(seed)
    listed = []
    for _ in range(n):
        path, t = f"f{rng.randrange(6)}", rng.randrange(0, 60_000, 50)
        old = f"f{rng.randrange(6)}" if rng.random() < 0.15 else None
        listed.append((path, at(t), "Renamed" if old else rng.choice(["Created", "Modified", "Deleted"]), old if old != path else None))
    return listed


def test_bursts_on_a_table(spark):
    listed = events(1)
    got = settled(changes.settle(spark.createDataFrame(listed, EVENTS)))
    assert sorted(got, key=str) == plain(listed, 500) and any(r[2] for r in got) and any(r[5] > 1 for r in got)


@pytest.mark.parametrize("seed", [2, 3])
def test_bursts_on_a_stream_equal_those_on_a_table(spark, tmp_path, seed):
    """Events come shuffled and late, in several batches, but not later than the watermark allows."""
    listed, rng = events(seed), random.Random(seed)
    batches = [[] for _ in range(4)]
    for x in listed:
        # up to two batches late: less than the allowed 40 s
        batches[min(3, int((x[1] - START).total_seconds() // 15) + rng.randrange(2))].append(x)
    batches.append([("end", at(10_000_000), "Created", None)])
    batches.append([("end2", at(20_000_000), "Created", None)])
    for i, b in enumerate(batches):
        rng.shuffle(b)
        spark.createDataFrame(b, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = changes.settle(source, late="40 seconds").writeStream.format("memory").queryName(f"settled{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    got = [r for r in settled(spark.table(f"settled{seed}")) if not r[0].startswith("end")]
    assert sorted(got, key=str) == plain(listed, 500)


def test_exact_percentiles_of_a_skewed_group(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.choice([1, 1, 1, 2, rng.random() * 100, rng.gauss(50, 9)]))) for _ in range(6000)]
    rows += [("one", 7.0), ("none", None), (None, 3.0), (None, 5.0), *(("same", 4.0) for _ in range(50)), *(("two", float(i)) for i in range(101))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for accuracy in (1000, 20):
        got = {r["g"]: tuple(r[k] for k in wanted) for r in stats.percentiles(df, ["g"], "x", wanted, accuracy).collect()}
        for g in {g for g, _ in rows}:
            held = sorted(x for h, x in rows if h == g and x is not None)
            assert got[g] == (tuple(held[max(1, math.ceil(len(held) * p)) - 1] for p in wanted.values()) if held else (None,) * 4)


def test_percentiles_where_the_sketch_misses(spark, monkeypatch):
    """A sketch that is wrong makes a longer way, not a wrong result."""
    monkeypatch.setattr(stats.F, "percentile_approx", lambda v, edges, accuracy: F.array(*(F.min(v) + 1000 for _ in range(2))))
    df = spark.createDataFrame([("a", float(i)) for i in range(100)], "g string, x double")
    assert [tuple(r) for r in stats.percentiles(df, ["g"], "x", {"p50": 0.5, "p90": 0.9}).collect()] == [("a", 49.0, 89.0)]


def test_pages_by_cursor_stay_whole_under_inserts(spark, tmp_path):
    rows = [(i // 3, f"k{i}", i) for i in range(50)]
    path = str(tmp_path / "t")
    write = lambda listed, mode: records.write_ordered(spark.createDataFrame(listed, "a int, b string, v int"), path, ["a", "b"], mode)
    write(rows, "overwrite")
    expected = sorted(rows)
    pages = records.scan(lambda: spark.read.parquet(path), ["a", "b"], 7)
    seen, cursor = [], None
    for _ in range(3):
        page, cursor = next(pages)
        seen += [tuple(r) for r in page]
    write([(-1, "new", 900), (0, "a", 901), (99, "later", 902)], "append")
    # another reader goes on from the cursor: what came in before it moves nothing, what came in after it is seen
    for page, _ in records.scan(lambda: spark.read.parquet(path), ["a", "b"], 7, cursor):
        seen += [tuple(r) for r in page]
    assert seen == [*expected, (99, "later", 902)]
    plan = records.keyset_page(spark.read.parquet(path), ["a", "b"], 7, (5, "k"))._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\n]*GreaterThanOrEqual\(a,5\)", plan)


def test_first_errors(spark):
    df = spark.createDataFrame([(i, i % 2 == 0, f"e{i}") for i in range(20)], "i int, ok boolean, error string")
    assert [r["error"] for r in stats.first_errors(df, ["i"]).collect()] == ["e1", "e3", "e5", "e7", "e9"]
