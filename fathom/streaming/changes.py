"""File changes as streams: debounced per path, applied in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def debounce(events: DataFrame, quiet: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """(path, change, first, last, n): a path's events until it is quiet, as one; the last event decides what it is.

    events: (path, ts, change). Works on streams, where what is later than the watermark allows is dropped, and on tables.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy("path", F.session_window("ts", quiet).alias("w"))
    return grouped.agg(F.max_by("change", "ts").alias("change"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("w")


def counts(events: DataFrame, width: str, late: str, key: str = "event_type") -> DataFrame:
    """(window start, key, n, total) of tumbling windows over (ts, key, value)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def bounded_histogram(samples: DataFrame, key: str = "metric", n: int = 1000) -> DataFrame:
    """A stream of (metric, value) to (metric, n, p50, p95, p99) over the last n samples of each, kept as state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(metric, batches, state):
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            held = (held + pdf["value"].tolist())[-n:]
        state.update((held,))
        ordered = sorted(held)
        at = lambda p: ordered[max(0, -(-len(ordered) * p // 100) - 1)]
        yield pd.DataFrame({"metric": [metric[0]], "n": [len(held)], "p50": [at(50)], "p95": [at(95)], "p99": [at(99)]})

    return samples.groupBy(key).applyInPandasWithState(step, "metric string, n long, p50 double, p95 double, p99 double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def idle(events: DataFrame, now, quiet_ms: int = 500) -> DataFrame:
    """(path, change, last, n) of paths that are quiet since quiet_ms at the time `now`, as a poll sees them: whatever happened, they count as Modified."""
    seen = events.groupBy("path").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    return seen.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) >= quiet_ms * 1000).select("path", F.lit("Modified").alias("change"), "last", "n")


def renames(events: DataFrame) -> DataFrame:
    """(path, old_path, ts): the last rename (ts, old_path, path) into each path that was not itself renamed since."""
    came = events.groupBy("path").agg(F.max_by("old_path", "ts").alias("old_path"), F.max("ts").alias("ts"))
    went = events.groupBy(F.col("old_path").alias("path")).agg(F.max("ts").alias("left_at"))
    return came.join(went, "path", "left").filter("left_at is null or left_at < ts").select("path", "old_path", "ts")


def without_renamed(changes: DataFrame, events: DataFrame) -> DataFrame:
    """Changes (path, ts, ..) but for those of a path that was renamed away at that time or later: they are cancelled."""
    went = events.groupBy(F.col("old_path").alias("path")).agg(F.max("ts").alias("left_at"))
    return changes.join(went, "path", "left").filter("left_at is null or left_at < ts").drop("left_at")


SETTLED = "path string, change string, old_path string, first long, last long, n long"


def _by_path(events: DataFrame) -> DataFrame:
    """(path, us, change, old_path): a rename is an event of its new path, and of its old one that all before is cancelled (change null)."""
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    here = F.struct(F.col("path").alias("path"), us, F.coalesce("change", F.lit("Renamed")).alias("change"), F.col("old_path").alias("old_path"))
    away = F.struct(F.col("old_path").alias("path"), us, F.lit(None).cast("string").alias("change"), F.lit(None).cast("string").alias("old_path"))
    both = F.when(F.col("old_path").isNull(), F.array(here)).otherwise(F.array(here, away))
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.explode(both).alias("x")).select("ts", "x.*")


def settle(events: DataFrame, quiet_ms: int = 500, late: str = "1 minute") -> DataFrame:
    """(path, change, old_path, first, last, n): what is left of each path's events when it has been quiet for quiet_ms.

    events: (path, ts, change, old_path); old_path is set where the path came by a rename. A rename away cancels what
    its old path had waiting, itself not over quiet_ms old, and the rest of a burst counts as one change: the last event says
    which (of one time the greatest by name), and the last rename where it came from. Times of one burst lie less than quiet_ms apart.

    On a stream the events of a path wait in keyed state, and a timer on the watermark ends a burst, so that a rename in a later
    batch still cancels; what is later than the watermark allows is dropped. On a table the same comes of windows.
    """
    quiet = quiet_ms * 1000
    made = (_settled_stream if events.isStreaming else _settled_table)(events, quiet, late)
    return made.withColumns({"first": F.timestamp_micros("first"), "last": F.timestamp_micros("last")})


def _settled_table(events: DataFrame, quiet: int, late: str) -> DataFrame:
    from pyspark.sql import Window

    path = Window.partitionBy("path")
    rows = _by_path(events).drop("ts").withColumn("before", F.lag("us").over(path.orderBy("us")))
    rows = rows.withColumn("burst", F.sum((F.coalesce(F.col("us") - F.col("before"), F.lit(quiet)) >= quiet).cast("int")).over(path.orderBy("us")))
    away = F.max(F.when(F.col("change").isNull(), F.col("us"))).over(Window.partitionBy("path", "burst"))
    left = rows.withColumn("away", away).filter("change is not null and (away is null or us > away)")
    came = F.max(F.when(F.col("old_path").isNotNull(), F.struct("us", "old_path")))["old_path"]
    return left.groupBy("path", "burst").agg(F.max(F.struct("us", "change"))["change"].alias("change"), came.alias("old_path"), F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n")).drop("burst")


def _settled_stream(events: DataFrame, quiet: int, late: str) -> DataFrame:
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [x.split()[0] for x in SETTLED.split(", ")]

    def ended(path: str, burst: list[tuple]) -> list[tuple]:
        """One row of a burst (us, change, old_path), none if it was cancelled."""
        away = max((us for us, change, _ in burst if change is None), default=None)
        left = [x for x in burst if x[1] is not None and (away is None or x[0] > away)]
        if not left:
            return []
        came = max(((us, old) for us, _, old in left if old is not None), default=(0, None))[1]
        return [(path, max((us, change) for us, change, _ in left)[1], came, min(x[0] for x in left), max(x[0] for x in left), len(left))]

    def step(key, batches, state):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for pdf in batches:
                held += [(int(us), None if pd.isna(c) else c, None if pd.isna(o) else o) for us, c, o in zip(pdf["us"], pdf["change"], pdf["old_path"], strict=True)]
        held.sort(key=lambda x: x[0])
        bursts: list[list[tuple]] = []
        for x in held:
            if bursts and x[0] - bursts[-1][-1][0] < quiet:
                bursts[-1].append(x)
            else:
                bursts.append([x])
        now = state.getCurrentWatermarkMs() * 1000
        over = [b for b in bursts if b[-1][0] + quiet <= now]
        waiting = [x for b in bursts[len(over) :] for x in b]
        if waiting:
            state.update(tuple(list(c) for c in zip(*waiting, strict=True)))
            state.setTimeoutTimestamp(max(bursts[len(over)][-1][0] + quiet, now + 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([r for b in over for r in ended(key[0], b)], columns=names).astype({"first": "int64", "last": "int64", "n": "int64"})

    rows = _by_path(events).withWatermark("ts", late)
    return rows.groupBy("path").applyInPandasWithState(step, SETTLED, "us array<long>, change array<string>, old array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def apply_changes(stream: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 64, order: str | None = None):
    """Starts a query that keeps the newest row of each key in Parquet under `path`; it ends when the input is read.

    Newest is the row with the greatest `order`, among those of a batch as against what is held, whatever order they come in; a
    row that ties with the one held takes its place. Without an order the last batch counts, and a batch with two rows of
    a key is an error. Columns may have any names.

    Rows are dealt to buckets by a hash of their key. A batch writes only the buckets that it touches, each as a version of
    its own, and then a small table that names the version of every bucket; so a batch that is tried again changes nothing
    that is read.
    """
    from pyspark.sql import Window

    from fathom.operators.sync import newest

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        place = lambda rows: F.pmod(F.xxhash64(*(rows[k] for k in keys)), F.lit(buckets)).cast("int")
        held = lambda rows, age: rows.select(F.struct("*").alias("row"), F.struct(*keys).alias("key"), place(rows).alias("bucket"), F.lit(age).alias("age"))
        rows = held(newest(batch, keys, order), 1)
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
        before = versions(spark, path, epoch - 1)
        old = [f"{path}/data/bucket={b}/v={before[b]}" for b in touched if b in before]
        if old:
            rows = rows.unionByName(held(spark.read.parquet(*old).select("row.*"), 0))
        last = Window.partitionBy("key").orderBy(*([F.desc(F.col("row")[order])] if order else []), F.desc("age"))
        rows = rows.withColumn("place", F.row_number().over(last)).filter("place = 1").select("row", "bucket", F.lit(epoch).alias("v"))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(f"{path}/data")
        after = [(b, v) for b, v in (before | dict.fromkeys(touched, epoch)).items()]
        spark.createDataFrame(after, "bucket int, v long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark, path: str, epoch: int) -> dict[int, int]:
    """The version of each bucket after a batch; a row a bucket."""
    if epoch < 0:
        return {}
    return {r["bucket"]: r["v"] for r in spark.read.parquet(f"{path}/versions/{epoch}").collect()}


def current(spark, path: str, epoch: int) -> DataFrame:
    """The rows that apply_changes holds after a batch."""
    return spark.read.parquet(*(f"{path}/data/bucket={b}/v={v}" for b, v in sorted(versions(spark, path, epoch).items()))).select("row.*")
