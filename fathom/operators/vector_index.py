"""A vector index in cells: exact nearest neighbours that read a part of the vectors, upserts and deletes.

Centres are fitted by k-means on a bounded sample, for each model its own. Every vector goes to the cell of its nearest centre, with
its distance from it, and files are in the order of (model, cell, distance), so that readers skip cells and rings. A hot cell is
many ranges of distances, in as many tasks. For each cell a head tells how many vectors it got and the least and greatest distance.

A search knows the distance of the query from each centre. The triangle inequality and the planes between centres
give, for each cell, a distance below which it has no vector. The nearest cells give a k-th distance; then only the cells,
and the rings in them, are read that may hold something nearer or as near: the result is that of a scan, ties included. How much that
spares depends on the vectors: it is most of them where they lie in clusters, nothing where they are spread evenly over many dimensions.
A caller may stop early with `probes`; `recall` tells what that costs.

Every batch adds a segment under the centres that are there, which fit badly when far more or other vectors came since; `merge` writes the living
vectors under new ones. Replaced and deleted
vectors are named in a table and left out on reading. ids and owners are strings, an id is unique among the living vectors of a
model. Rows without an embedding are left out; one of another length than the centres of its model is an error. Models are few
and named by the caller. Without vectors a search finds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.functions import vectors as V
from fathom.operators import vector_blocks
from fathom.sources.snapshots import Snapshot, Store
from fathom.sources.tables import if_small

#: Most vectors of a model that centres are fitted on, those whose ids have the least hashes; most cells of a model; rounds of k-means.
SAMPLE, CELLS, ROUNDS = 20_000, 256, 10
#: How many times k vectors the first cells of a search have, at least.
FIRST = 4
#: Most cells of which each ring is pushed down to the reader.
RINGS = 64

ROWS = "id string, owner string, model string, cell int, distance double, embedding array<float>"
CENTRES = "model string, cell int, centre array<double>"
HEADS = "model string, cell int, n long, least double, most double"
GONE = "owner string, model string"
#: Small row groups and pages, so that a search skips what lies between its rings.
LAYOUT = {"parquet.block.size": str(8 << 20), "parquet.page.row.count.limit": "500"}


def fit(rows: DataFrame, known: Sequence[str] = (), cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """CENTRES of the models of rows (id, model, embedding) that are not known: the root of their number of vectors, at most `cells`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    found = []
    for r in rows.filter(~F.col("model").isin(*known)).groupBy("model").count().collect():
        some = rows.filter(F.col("model") == r["model"]).orderBy(F.xxhash64("id"), "id").limit(sample)
        some = some.select(array_to_vector(V.doubles(F.col("embedding"))).alias("features")).persist()
        made = KMeans(k=max(2, min(cells, round(r["count"] ** 0.5))), maxIter=ROUNDS, seed=1).fit(some)
        found += [(r["model"], i, [float(x) for x in c]) for i, c in enumerate(made.clusterCenters())]
        some.unpersist()
    return rows.sparkSession.createDataFrame(found, CENTRES)


def centres(store: Store, snapshot: Snapshot) -> dict[str, np.ndarray]:
    """The centres of each model, by cell; CELLS at most."""
    held: dict[str, dict[int, list[float]]] = {}
    for r in store.table(snapshot, "centres", CENTRES).select("model", "cell", "centre").collect():
        held.setdefault(r["model"], {})[r["cell"]] = r["centre"]
    return {m: np.array([c[i] for i in range(len(c))]) for m, c in held.items()}


def models(store: Store, snapshot: Snapshot) -> list[str]:
    """The models that vectors were ever added of, since the last merge."""
    return [r["model"] for r in store.table(snapshot, "centres", CENTRES).select("model").distinct().orderBy("model").collect()]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from those of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def placed(rows: DataFrame, by_model: dict[str, np.ndarray]) -> DataFrame:
    """ROWS of rows (id, owner, model, embedding), in the order of the files."""
    import pandas as pd

    @F.pandas_udf("cell int, distance double")
    def place(model, embedding):
        cell, distance = np.zeros(len(model), dtype=np.int32), np.zeros(len(model))
        for name, at in model.groupby(model).indices.items():
            c, x = by_model[name], np.stack(embedding.iloc[at].to_numpy()).astype(np.float64)
            cell[at] = squares(x, c).argmin(1)
            distance[at] = np.sqrt(((x - c[cell[at]]) ** 2).sum(1))
        return pd.DataFrame({"cell": cell, "distance": distance})

    made = rows.withColumn("_at", place("model", "embedding")).select("id", "owner", "model", "_at.cell", "_at.distance", "embedding")
    order = ("model", "cell", "distance", "id")
    return made.repartitionByRange(*order).sortWithinPartitions(*order)


def written(store: Store, snapshot: Snapshot, rows: DataFrame, known: dict[str, np.ndarray], **options) -> dict[str, list[str]]:
    """Folders of rows (id, owner, model, embedding) as the next version's: cells, heads, and centres of models that are not known."""
    version = snapshot.version + 1
    parts = {"centres": [store.write(fit(rows, list(known), **options), "centres", version)]}
    every = known | centres(store, Snapshot(version, parts))
    parts["cells"] = [store.write(placed(rows, every), "cells", version, **LAYOUT)]
    heads = store.part(parts["cells"][0], "cells", ROWS).groupBy("model", "cell").agg(F.count("*").alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"))
    parts["heads"] = [store.write(heads.coalesce(1), "heads", version)]
    return parts


def living(store: Store, snapshot: Snapshot) -> DataFrame:
    """ROWS with segment, without what a later version replaced or deleted."""
    rows = store.table(snapshot, "cells", ROWS)
    if not snapshot.parts.get("gone_vectors"):
        return rows
    gone = store.table(snapshot, "gone_vectors", GONE)
    owners = gone.filter("owner is not null").groupBy("owner", "model").agg(F.max("segment").alias("owner_since"))
    models = gone.filter("owner is null").groupBy("model").agg(F.max("segment").alias("model_since"))
    rows = rows.join(if_small(owners), ["owner", "model"], "left").join(if_small(models), "model", "left")
    kept = rows.filter("(owner_since is null or segment >= owner_since) and (model_since is null or segment >= model_since)")
    return kept.drop("owner_since", "model_since")


def add_segment(store: Store, snapshot: Snapshot, rows: DataFrame | None = None, gone: DataFrame | None = None, models: Sequence[str] = (), **options) -> tuple[dict[str, list[str]], dict[str, float]]:
    """Writes rows (id, owner, model, embedding) as a segment of the next version: (folders, totals) for a commit.

    Living vectors that rows' owners have of the same model are replaced. Those of the owners of gone (owner), of any model, and all of `models` are
    deleted; totals["vectors"] is how many came, less how many went.
    """
    version = snapshot.version + 1
    parts: dict[str, list[str]] = {}
    came, leaving = 0, []
    if rows is not None:
        named = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c).cast("string")).alias(c)
        each = rows.filter("embedding is not null").select(named("id"), named("owner"), named("model"), F.col("embedding").cast("array<float>").alias("embedding"))
        # read thrice: by fit, by place and by the ranges; what embeds the rows runs once
        path = store.write(each, "new_vectors", version)
        parts |= written(store, snapshot, store.part(path, "new_vectors", "id string, owner string, model string, embedding array<float>"), centres(store, snapshot), **options)
        fresh = store.part(parts["cells"][0], "cells", ROWS).select("owner", "model")
        came = store.part(parts["heads"][0], "heads", HEADS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        leaving.append((fresh.distinct(), ["owner", "model"]))
    if gone is not None:
        leaving.append((gone.select(F.col("owner").cast("string").alias("owner")).distinct(), ["owner"]))
    went = 0
    if snapshot.parts.get("cells") and (leaving or models):
        old = living(store, snapshot).select("owner", "model", "id")
        of_models = F.col("model").isin(*models)
        lost = [old.join(x, on, "left_semi") for x, on in leaving] + ([old.filter(of_models)] if models else [])
        lost = reduce(DataFrame.unionByName, lost).distinct()
        named = lost.groupBy("owner", "model").agg(F.count("*").alias("n"))
        whole = F.when(~of_models, F.col("owner")) if models else F.col("owner")
        made = named.groupBy(whole.alias("owner"), "model").agg(F.sum("n").alias("n"))
        parts["gone_vectors"] = [store.write(made, "gone_vectors", version)]
        went = store.part(parts["gone_vectors"][0], "gone_vectors", f"{GONE}, n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return parts, {"vectors": came - went}


def merge(store: Store, snapshot: Snapshot, **options) -> tuple[dict[str, list[str]], dict[str, float]]:
    """Writes the living vectors as one segment under new centres: folders that replace those of centres, cells, heads and gone_vectors."""
    rows = living(store, snapshot).select("id", "owner", "model", "embedding")
    return written(store, snapshot, rows, {}, **options) | {"gone_vectors": []}, {}


class Cells:
    """What a search knows of a model's cells before it reads vectors: centres, distances of the planes between them, and heads."""

    def __init__(self, store: Store, snapshot: Snapshot, model: str):
        self.centre = centres(store, snapshot).get(model, np.empty((0, 0)))
        size = len(self.centre)
        self.n, self.least, self.most = np.zeros(size, dtype=np.int64), np.full(size, np.inf), np.full(size, -np.inf)
        heads = store.table(snapshot, "heads", HEADS).filter(F.col("model") == model).groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        for r in heads.collect():
            self.n[r["cell"]], self.least[r["cell"]], self.most[r["cell"]] = r["n"], r["least"], r["most"]
        self.full = self.n > 0
        self.apart = np.sqrt(squares(self.centre, self.centre)) if size else np.empty((0, 0))
        norms = np.sqrt((self.centre**2).sum(1)) if size else np.empty(0)
        self.reach = float((norms + np.maximum(self.most, 0)).max()) if size else 0.0

    def slack(self, query: np.ndarray) -> float:
        """What rounding may move a squared distance by, far on the safe side."""
        return 1e-9 * (self.reach + float(np.sqrt(query @ query))) ** 2

    def distances(self, query: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.centre - query) ** 2).sum(1)) if len(self.centre) else np.empty(0)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For each cell a distance below which it has no vector; infinite for empty ones."""
        d = self.distances(query)
        if not len(d):
            return d
        ring = np.maximum(d - self.most, self.least - d)
        # a vector of cell i is no farther from centre i than from j, so it lies beyond the plane between them
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = (d[:, None] ** 2 - d[None, :] ** 2 - self.slack(query)) / (2 * self.apart)
        np.fill_diagonal(beyond, 0)
        plane = np.nan_to_num(beyond, nan=0, posinf=0, neginf=0).max(1, initial=0)
        return np.where(self.full, np.maximum(np.maximum(ring, plane), 0), np.inf)

    def nearest(self, query: np.ndarray, least: int = 0, cells: int = 0) -> list[int]:
        """The nearest cells by centre: as many as have `least` vectors together, and `cells` at least."""
        order = [int(i) for i in np.argsort(self.distances(query), kind="stable") if self.full[i]]
        sums = np.cumsum(self.n[order]) if order else np.empty(0)
        return order[: max(cells, int(np.searchsorted(sums, least)) + 1 if least else 0)]


class Search:
    """One request over a snapshot, in steps that can be looked at."""

    def __init__(self, store: Store, snapshot: Snapshot, query: Sequence[float], k: int = 10, model: str = ""):
        self.store, self.snapshot, self.k, self.model = store, snapshot, k, model
        self.query = np.array(query, dtype=np.float64)
        self.cells = Cells(store, snapshot, model)
        self.slack = self.cells.slack(self.query) ** 0.5

    def read(self, cells: Sequence[int], radius: float = np.inf) -> DataFrame:
        """(id, distance from the query) of the living vectors of these cells, without rings that lie beyond the radius."""
        mine = (F.col("model") == self.model) & F.col("cell").isin(*cells)
        if np.isfinite(radius):
            d, r = self.cells.distances(self.query), radius + self.slack
            if len(cells) <= RINGS:
                rings = ((F.col("cell") == i) & F.col("distance").between(float(d[i] - r), float(d[i] + r)) for i in cells)
                mine &= reduce(Column.__or__, rings, F.lit(False))
            else:
                mine &= F.abs(F.col("distance") - F.get(V.literal(d), F.col("cell"))) <= float(r)
        rows = living(self.store, self.snapshot).filter(mine)
        return rows.select("id", V.l2_distance(F.col("embedding"), V.literal(self.query)).alias("distance"))

    def radius(self) -> float:
        """A distance within which k vectors lie, by the nearest cells; infinite if there are fewer."""
        every, least = int(self.cells.n.sum()), FIRST * self.k
        while every:
            first = self.cells.nearest(self.query, least)
            best = self.read(first).orderBy("distance").limit(self.k).collect()  # k numbers
            if len(best) == self.k:
                return best[-1]["distance"]
            if least >= every:
                break
            least *= 8  # many of these vectors were deleted
        return np.inf

    def reached(self, radius: float) -> list[int]:
        """The cells that may hold a vector within the radius."""
        bounds = self.cells.bounds(self.query)
        return [int(i) for i in np.flatnonzero(self.cells.full & (bounds <= radius + self.slack))]

    def top(self, probes: int | None = None) -> DataFrame:
        """(id, score, rank) of the k nearest; ties by id. probes: look only into so many cells."""
        if probes is None:
            radius = self.radius()
            near = self.read(self.reached(radius), radius)
        else:
            near = self.read(self.cells.nearest(self.query, cells=probes))
        order = [F.desc("score"), F.col("id")]
        top = near.select("id", V.from_distance(F.col("distance")).alias("score")).orderBy(*order).limit(self.k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def search(store: Store, snapshot: Snapshot, query: Sequence[float], k: int = 10, model: str = "", probes: int | None = None) -> DataFrame:
    """(id, score, rank) of the k nearest living vectors of a model, as a scan of them would give; of `probes` cells alone if given."""
    return Search(store, snapshot, query, k, model).top(probes)


def search_many(store: Store, snapshot: Snapshot, queries: DataFrame, k: int = 10, model: str = "", probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, query): each meets only the cells that may hold one of its k nearest, or `probes` of them.

    Blocks of queries meet blocks of vectors of one cell; tasks keep k a query before the shuffle.
    """
    import pandas as pd

    cells = Cells(store, snapshot, model)
    size = len(cells.centre)
    if not size:
        kind = queries.schema["query_id"].dataType.simpleString()
        return store.spark.createDataFrame([], f"query_id {kind}, id string, score double, rank long")

    @F.pandas_udf("struct<from: array<double>, room: array<double>>")
    def ask(query, radius):
        starts, rooms = [], []
        for q, r in zip(query, radius, strict=True):
            q, room = np.asarray(q, dtype=np.float64), np.full(size, -1.0)
            if r is None or np.isnan(r):
                room[cells.nearest(q, 0 if probes else FIRST * k, probes or 0)] = np.inf
            else:
                beyond = r + cells.slack(q) ** 0.5
                room[np.flatnonzero(cells.full & (cells.bounds(q) <= beyond))] = beyond
            starts.append(cells.distances(q))
            rooms.append(room)
        return pd.DataFrame({"from": starts, "room": rooms})

    # as it is read, vectors of a cell stand together
    rows = living(store, snapshot).filter(F.col("model") == model).select("id", "cell", "distance", "embedding")

    def meet(asked: DataFrame) -> DataFrame:
        # room: how far a vector's distance from the centre may be from the query's; below 0 where the cell isn't asked
        each = asked.select("query_id", "query", ask("query", "radius").alias("c")).select("query_id", "query", "c.from", "c.room")
        return vector_blocks.nearest(rows, each, k, cells=True)

    asked = queries.select("query_id", V.doubles(F.col("query")).alias("query"))
    first = meet(asked.withColumn("radius", F.lit(None).cast("double")))
    if probes is None:
        # fewer than k in the nearest cells say nothing of how far the k-th is
        kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("score"))
        # a score is 1 / (1 + d), rounded: by its like the radius may fall short of d
        radius = F.coalesce((1 / F.col("score") - 1) * (1 + 1e-9) + 1e-9, F.lit(float("inf")))
        first = meet(asked.join(kth, "query_id", "left").withColumn("radius", radius).drop("score"))
    return first


def recall(store: Store, snapshot: Snapshot, queries: DataFrame, probes: int, k: int = 10, model: str = "") -> DataFrame:
    """(n, found, recall): how many of the k nearest of all queries a search of `probes` cells finds."""
    exact = search_many(store, snapshot, queries, k, model).select("query_id", "id")
    early = search_many(store, snapshot, queries, k, model, probes).select("query_id", "id", F.lit(1).alias("hit"))
    both = exact.join(early, ["query_id", "id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
    return both.select("n", "found", (F.col("found") / F.col("n")).alias("recall"))
