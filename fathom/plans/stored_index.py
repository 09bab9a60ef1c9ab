"""The index as tables of a store: every batch of file changes is one commit over files, chunks, vectors, keywords and graph.

`ingest` reads only the files that changed: it cuts, embeds and parses them, writes what they give as new parts, and
names them, with the files that are gone, in one commit. Until then readers see the version before; a batch that failed between two
tables leaves nothing that is read, and one that is tried again after its commit changes nothing. Rows of replaced and deleted files stay
where they are and are left out by their file and version, until `compact` writes the living ones anew.

`open_index` gives the tables of a version as an Index for `search.search`: the keyword leg reads posting blocks, the vector leg
cells, and chunks are read by join. Vectors of a file that changed are replaced whatever model they are of; `drop_model` deletes a model's. What links say is kept per file as it was parsed; where they lead is resolved when the
graph is asked for, as any new or deleted file may change it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathom.functions import text as X
from fathom.operators import chunking, graph, keyword_index, models, sync, vector_index
from fathom.plans.search import Index
from fathom.sources.snapshots import Snapshot, Store
from fathom.sources.tables import if_small

FILES = "file_id string, path string, source string, hash string, text string, node string"
CHUNKS = f"{chunking.SCHEMA}, chunk_id string, path string, source string"
TITLES = "id string, title string"
HEADINGS = "id string, title string, line int"
LINKS = "id string, target string, type string, line int"
GONE = "file_id string, node string"
#: Parts of a table beyond which `ingest` asks for `compact`.
PARTS = 20


def alive(store: Store, snapshot: Snapshot, table: str, schema: str, key: str) -> DataFrame:
    """Rows of a table but those of files that a later version replaced or deleted; key: file_id or, for the graph, id."""
    rows = store.table(snapshot, table, schema)
    if not snapshot.parts.get("gone"):
        return rows.drop("segment")
    named = "node" if key == "id" else "file_id"
    since = store.table(snapshot, "gone", GONE).groupBy(F.col(named).alias(key)).agg(F.max("segment").alias("since"))
    return rows.join(if_small(since), key, "left").filter("since is null or segment >= since").drop("since", "segment")


def files(store: Store, snapshot: Snapshot) -> DataFrame:
    """(file_id, path, source, hash, text, node) of the files as of a version."""
    return alive(store, snapshot, "files", FILES, "file_id")


def ingest(store: Store, changed: DataFrame | None, deleted: DataFrame | None = None, writer: str = "", batch: int = 0, model=None, most: int = 512, overlap: int = 50) -> Snapshot:
    """The version after files changed: changed (file_id, path, source, text, hash), new or in place of those with their file_id; deleted (file_id).

    With a writer's name, a batch whose number is not over the writer's last one is not done again. A file_id that changed has two
    rows is an error; one that is both changed and deleted is changed.
    """
    spark, base = store.spark, store.snapshot()
    if writer and base.applied.get(writer, -1) >= batch:
        return base
    version = base.version + 1
    add: dict[str, list[str]] = {}
    leaving = None if deleted is None else deleted.select(F.col("file_id").cast("string").alias("file_id"))
    rows = None
    if changed is not None:
        each = changed.select(F.col("file_id").cast("string").alias("file_id"), "path", "source", "hash", "text", X.node_id(F.col("path")).alias("node"))
        add["files"] = [store.write(sync.newest(each, ["file_id"], None), "files", version)]
        rows = store.part(add["files"][0], "files", FILES)
        owners = rows.select("file_id")
        leaving = owners if leaving is None else leaving.unionByName(owners)
    if leaving is not None and base.parts.get("files"):
        before = files(store, base).select("file_id", "node").join(leaving.distinct(), "file_id", "left_semi")
        add["gone"] = [store.write(before, "gone", version)]
    chunks = vectors = None
    if rows is not None:
        cut = chunking.chunk_markdown(rows, "file_id", "text", most, overlap).join(rows.select("file_id", "path", "source"), "file_id")
        add["chunks"] = [store.write(cut, "chunks", version)]
        chunks = store.part(add["chunks"][0], "chunks", CHUNKS)
        made = models.embed(chunks.select("chunk_id", "file_id", "content"), "content", model=model)
        vectors = made.select(F.col("chunk_id").alias("id"), F.col("file_id").alias("owner"), F.lit(model_name(model)).alias("model"), "embedding")
        for table, parsed in zip(("titles", "headings", "links"), graph.parse(rows), strict=True):
            add[table] = [store.write(parsed, table, version)]
        chunks = chunks.select(F.col("chunk_id").alias("id"), F.col("file_id").alias("owner"), F.col("content").alias("text"))
    gone = store.part(add["gone"][0], "gone", GONE).select(F.col("file_id").alias("owner")) if "gone" in add else None
    more, totals = keyword_index.add_segment(store, base, chunks, gone)
    near, counted = vector_index.add_segment(store, base, vectors, gone)
    return store.commit(base, add | more | near, totals=totals | counted, writer=writer, batch=batch)


def model_name(model=None) -> str:
    return getattr(model or models.HashingEmbedder(), "name", "model")


def drop_model(store: Store, name: str) -> tuple[Snapshot, int]:
    """The version without the vectors of a model, and how many these were. Files and chunks stay; `synchronise` with force embeds them anew."""
    base = store.snapshot()
    parts, totals = vector_index.add_segment(store, base, models=[name])
    return store.commit(base, parts, totals=totals), -int(totals["vectors"])


def synchronise(store: Store, disk: DataFrame, enabled: list[str] | None = None, force: bool = False, **options) -> Snapshot:
    """The version after the store was brought up to date with disk (file_id, path, source, text, hash), by path and hash.

    With `enabled`, files of other sources are neither indexed nor taken for deleted. force indexes all anew, as after a change of model.
    """
    snapshot = store.snapshot()
    mine = (lambda df: df) if enabled is None else (lambda df: df.filter(F.col("source").isin(*enabled)))
    stored, disk = mine(files(store, snapshot)), mine(disk)
    change = sync.classify_changes(stored, disk)
    fresh = ["New", "Modified", *(["Unchanged"] if force else [])]
    deleted = stored.join(change.filter("change = 'Deleted'").select("path"), "path", "left_semi").select("file_id")
    changed = disk.join(change.filter(F.col("change").isin(*fresh)).select("path"), "path", "left_semi")
    # a modified file goes under the id that is stored, whatever id it has now
    ids = stored.select("path", F.col("file_id").alias("known"))
    changed = changed.join(ids, "path", "left").select(F.coalesce("known", F.col("file_id").cast("string")).alias("file_id"), "path", "source", "text", "hash")
    return ingest(store, changed, deleted, **options)


def open_index(store: Store, snapshot: Snapshot | None = None, graph_too: bool = True, model=None) -> Index:
    """The tables of a version, by default the last, for search.search; model: the one that embeds requests, by default the only one that the store has."""
    at = snapshot or store.snapshot()
    nodes = edges = None
    if graph_too:
        parsed = (alive(store, at, table, schema, "id") for table, schema in (("titles", TITLES), ("headings", HEADINGS), ("links", LINKS)))
        nodes, edges = graph.assemble(*parsed, files(store, at))
    chunks, name = alive(store, at, "chunks", CHUNKS, "file_id"), model_name(model)
    known = vector_index.models(store, at)
    if model is None and len(known) == 1:
        name = known[0]
    vectors = vector_index.living(store, at).filter(F.col("model") == name)
    vectors = vectors.select(F.col("id").alias("chunk_id"), F.col("owner").alias("file_id"), "model", "embedding")
    return Index(chunks, vectors, nodes, edges, lambda query, k: keyword_index.search(store, at, query, k), lambda vector, k: vector_index.search(store, at, vector, k, name))


def wants_compacting(snapshot: Snapshot) -> bool:
    return any(len(x) > PARTS for x in snapshot.parts.values())


def compact(store: Store) -> Snapshot:
    """A version with the same rows in one part a table, without those of replaced and deleted files."""
    base = store.snapshot()
    replace = keyword_index.merge(store, base)[0] | vector_index.merge(store, base)[0]
    for table, schema, key in (("files", FILES, "file_id"), ("chunks", CHUNKS, "file_id"), ("titles", TITLES, "id"), ("headings", HEADINGS, "id"), ("links", LINKS, "id")):
        replace[table] = [store.write(alive(store, base, table, schema, key), table, base.version + 1)]
    return store.commit(base, {}, replace | {"gone": []})


def follow(stream: DataFrame, store: Store, checkpoint: str, writer: str = "stream", order: str = "ts", **options):
    """Starts a query that ingests a stream of file changes (file_id, path, source, text, hash, deleted, and `order`), a commit a batch; it ends when the input is read.

    Of a file's rows in a batch the last by `order` counts.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        last = sync.newest(batch, ["file_id"], order).persist()
        try:
            ingest(store, last.filter("not coalesce(deleted, false)"), last.filter("deleted"), writer=writer, batch=epoch, **options)
            if wants_compacting(store.snapshot()):
                compact(store)
        finally:
            last.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
