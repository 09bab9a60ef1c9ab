"""Many vectors against many: blocks of them meet as matrices in numpy, and only what may count is computed exactly.

A product of matrices gives all distances of two blocks nearly; a slack far over its rounding keeps every pair that may be among the
wanted ones. For these the distance is summed component by component, as `functions.vectors` does, so that scores are those of a scan, bit
by bit, and copies tie. Null vectors, and those that hold a null or have another length than the query, have no score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from fathom.functions import vectors as V
from fathom.sources.tables import if_small

#: Vectors and queries of a block; most blocks of queries that are broadcast; pairs that are computed exactly at once.
VECTORS, QUERIES, BROADCAST, AT_ONCE = 2048, 256, 64, 1 << 16
#: Vectors of a group in `near_pairs`, and groups at least.
GROUP, GROUPS = 32_768, 8


def packed(rows: DataFrame, size: int, by: str | None = None, numbers: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, embedding) as blocks (ids, width, data): the vectors of a length, -1 for those without a score; of one value of `by`, with `numbers` (a double a row, or an array of one length)."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, width int, data binary" + (f", {by} int" if by else "") + "".join(f", {n} binary" for n in numbers)
    gaps = F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull())
    width = F.when(gaps, -1).otherwise(F.size("embedding")).alias("width")
    vector = F.when(gaps, F.array().cast("array<double>")).otherwise(V.doubles(F.col("embedding"))).alias("embedding")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flat(column):
            return column.flatten() if pa.types.is_list(column.type) else column

        for batch in batches:
            keys = np.stack([batch.column("width").to_numpy(), batch.column(by).to_numpy() if by else np.zeros(len(batch), dtype=np.int32)], 1)
            for key in np.unique(keys, axis=0):
                mine = np.flatnonzero((keys == key).all(1))
                for at in range(0, len(mine), size):
                    some = batch.take(pa.array(mine[at : at + size]))
                    data = flat(some.column("embedding")).to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
                    more = ([int(key[1])] if by else []) + [flat(some.column(n)).to_numpy(zero_copy_only=False).astype(np.float64).tobytes() for n in numbers]
                    names = ["ids", "width", "data", *([by] if by else []), *numbers]
                    ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some.column("id"))
                    types = [ids.type, pa.int32(), pa.binary(), *([pa.int32()] if by else []), *(pa.binary() for _ in numbers)]
                    columns = [ids, *(pa.array([x], t) for x, t in zip([int(key[0]), data, *more], types[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("id", width, vector, *([F.col(by).cast("int").alias(by)] if by else []), *numbers).mapInArrow(run, schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, cells: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest vectors (id, embedding) of each query (query_id, query); ties by id. Tasks keep k a query before the shuffle.

    cells: vectors have their cell and distance from its centre; queries have arrays `from` and `room` by cell, and meet only
    vectors whose distance differs from `from` by no more than `room`.
    """
    asked = packed(queries.withColumnsRenamed({"query_id": "id", "query": "embedding"}), QUERIES, numbers=("from", "room") if cells else ())
    asked = asked.select(F.monotonically_increasing_id().alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in asked.columns))
    held = packed(vectors, VECTORS, "cell", ("distance",)) if cells else packed(vectors, VECTORS)
    kinds = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def names(column, i):
            return np.array(column[i].values.to_pylist(), dtype=object) if not pa.types.is_integer(column.type.value_type) else column[i].values.to_numpy()

        def best(q, d, odd, ids):
            """The k first of each query: NaN, which sorts as the greatest score, then by score, then those without one; ties by id."""
            score = 1 / (1 + d)
            order = np.where(odd, np.inf, np.where(np.isnan(score), -np.inf, -score))
            place = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
            at = np.lexsort((place, order, q))
            first = np.concatenate(([True], q[at][1:] != q[at][:-1])) if len(at) else np.empty(0, dtype=bool)
            start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[np.arange(len(at)) - start < k]
            return q[at], d[at], odd[at], ids[at]

        def exact(x, y):
            parts = [np.sqrt(np.cumsum((x[0][x[1][i : i + AT_ONCE]] - y[0][y[1][i : i + AT_ONCE]]) ** 2, axis=1)[:, -1]) for i in range(0, len(x[1]), AT_ONCE)]
            return np.concatenate(parts) if parts else np.empty(0)

        state, asked_ids = {}, {}
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            matrix = lambda n, i, width: np.frombuffer(col[n][i].as_buffer(), dtype=np.float64).reshape(-1, width)  # noqa: E731, B023
            for i in range(len(batch)):
                no, width, ids = col["q_block"][i].as_py(), col["width"][i].as_py(), names(col["ids"], i)
                if no not in state:
                    asked_ids[no] = col["q_ids"][i].values.to_pylist()
                    state[no] = (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=bool), ids[:0])
                n = len(asked_ids[no])
                if width != col["q_width"][i].as_py() or width < 1:
                    # without a score: the first by id may be there where too few have one
                    some = np.sort(ids)[:k] if not cells else ids[:0]
                    found = (np.repeat(np.arange(n), len(some)), np.full(n * len(some), 0.0), np.ones(n * len(some), dtype=bool), np.tile(some, n))
                else:
                    x, y = matrix("data", i, width), matrix("q_data", i, width)
                    mine = np.arange(n)
                    if cells:
                        c, size = col["cell"][i].as_py(), len(np.frombuffer(col["q_room"][i].as_buffer(), dtype=np.float64)) // n
                        start, room = matrix("q_from", i, size)[:, c], matrix("q_room", i, size)[:, c]
                        mine = np.flatnonzero(room >= 0)
                        if not len(mine):
                            continue
                    yy, xx = (y[mine] ** 2).sum(1), (x**2).sum(1)
                    near = yy[:, None] + xx[None, :] - 2 * (y[mine] @ x.T)
                    if cells:
                        away = np.frombuffer(col["distance"][i].as_buffer(), dtype=np.float64)
                        beyond = np.abs(away[None, :] - start[mine, None]) > room[mine, None]
                        near[beyond] = np.inf
                    limit = np.partition(near, k - 1, axis=1)[:, k - 1] if len(x) >= k else np.full(len(mine), np.inf)
                    q, d, odd, _ = state[no]
                    kth = np.full(n, -np.inf)
                    np.maximum.at(kth, q, np.where(odd | np.isnan(d), np.inf, d**2))
                    kth[np.bincount(q, minlength=n) < k] = np.inf
                    slack = 1e-9 * (np.sqrt(yy.max()) + np.sqrt(xx.max())) ** 2
                    far = near > (np.minimum(limit, kth[mine]) + slack)[:, None]
                    q, at = np.nonzero(~far & ~beyond if cells else ~far)
                    q = mine[q]
                    found = (q, exact((x, at), (y, q)), np.zeros(len(q), dtype=bool), ids[at])
                state[no] = best(*(np.concatenate(z) for z in zip(state[no], found, strict=True)))
        for no, (q, d, odd, ids) in state.items():
            columns = [pa.array([asked_ids[no][j] for j in q]), pa.array(ids.tolist()), pa.array(1 / (1 + d), mask=odd)]
            if len(q):
                yield from pa.table([c.cast(t) for c, t in zip(columns, out, strict=True)], names=["query_id", "id", "score"]).to_batches(max_chunksize=10_000)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = StructType.fromDDL(f"query_id {kinds[0]}, id {kinds[1]}, score double")
    out = [to_arrow_type(f.dataType) for f in schema.fields]
    first = held.crossJoin(if_small(asked, BROADCAST)).mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
    return first.withColumn("rank", rank).filter(F.col("rank") <= k)


def near_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of rows (id, block, embedding) of one block and length with a < b and a cosine of at least threshold.

    All pairs are compared. Vectors are dealt to groups by their ids; a task gets two groups, or one with itself.
    """
    kind, block = rows.schema["id"].dataType.simpleString(), rows.schema["block"].dataType.simpleString()
    whole = rows.filter("embedding is not null and not exists(embedding, x -> x is null)").withColumn("width", F.size("embedding"))
    most = whole.groupBy("block", "width").count().agg(F.max("count")).first()[0] or 0
    groups = max(GROUPS, -(-most // GROUP))
    mine = whole.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h")
    met = mine.select("id", "block", "width", "g", V.doubles(F.col("embedding")).alias("embedding"), other)
    met = met.select("id", "block", "width", F.least("g", "h").alias("g0"), F.greatest("g", "h").alias("g1"), (F.col("g") > F.col("h")).alias("second"), "embedding")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(list(batches))
        if not len(t) or not (width := t["width"][0].as_py()):
            return
        x = t["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])[:, None]
        x = np.where(norm < V.TINY, x, x / np.where(norm < V.TINY, 1, norm))
        ids, second, single = t["id"].combine_chunks(), t["second"].to_numpy(), x.astype(np.float32)
        one = t["g0"][0].as_py() == t["g1"][0].as_py()
        left, right = (np.arange(len(x)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
        slack, columns = 2e-7 * (width + 16), single[right].T
        for at in range(0, len(left), VECTORS):
            rows = left[at : at + VECTORS]
            i, j = np.nonzero(~(single[rows] @ columns < threshold - slack))
            i, j = rows[i], right[j]
            if one:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), AT_ONCE):
                p, q = i[part : part + AT_ONCE], j[part : part + AT_ONCE]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p)), ids.take(pa.array(q)), pa.array(np.cumsum(x[p] * x[q], axis=1)[:, -1])], ["x", "y", "similarity"])

    from collections.abc import Iterator

    import pyarrow as pa

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    pairs = met.groupBy("block", "width", "g0", "g1").applyInArrow(run, f"x {kind}, y {kind}, similarity double")
    pairs = pairs.filter(F.col("similarity") >= threshold)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").filter("a < b")
