"""The search calls of the engine: an index of tables, and requests over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from fathom.functions import text as X, vectors as V
from fathom.operators import bm25, chunking, context, fusion, graph, knn, models
from fathom.sources.snapshots import Store

#: (top k, context window, token budget) of each mode, for requests that leave them open.
MODES = {"Quick": (3, 0, 1000), "Standard": (10, 1, 3000), "Hybrid": (15, 1, 4000), "Deep": (20, 2, 6000), "HybridRerank": (10, 1, 4000)}


@dataclass
class Index:
    """chunks (chunk_id, file_id, path, source, chunk_index, heading, content), vectors (chunk_id, embedding), and the link graph.

    keywords: (query, k) to (id, score, rank), where a stored index answers; else the chunks are scanned. nearest: (vector, k)
    likewise, else the vectors are.
    """

    chunks: DataFrame
    vectors: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    keywords: Callable[[str, int], DataFrame] | None = None
    nearest: Callable[[list[float], int], DataFrame] | None = None


@dataclass
class Request:
    query: str
    vector: list[float] | None = None
    mode: str = "Hybrid"
    top_k: int = 0
    max_tokens: int = 0
    sources: list[str] | None = None
    folders: list[str] = field(default_factory=list)
    fusion: str = "weighted"
    rerank: bool = False
    rerank_threshold: float = 0.0
    recall_factor: int = 3
    graph_depth: int = 0

    def settled(self) -> Request:
        k, _, budget = MODES[self.mode]
        self.top_k = self.top_k if self.top_k > 0 else k
        self.max_tokens = self.max_tokens if self.max_tokens > 0 else budget
        return self

    def prefers_titles(self) -> bool:
        q = self.query.strip()
        return len(q) <= 32 or len(q.split()) <= 4


def query_vector(request: Request) -> list[float]:
    return request.vector or models.HashingEmbedder()([request.query], "query")[0]


def nearest(index: Index, request: Request, k: int) -> DataFrame:
    """(id, score, rank) of the k chunks whose vectors are nearest to the request's."""
    vector = query_vector(request)
    return index.nearest(vector, k) if index.nearest else knn.knn(index.vectors, V.literal(vector), k, "chunk_id")


def allowed(rows: DataFrame, request: Request) -> DataFrame:
    """Rows of the requested sources and folders."""
    if request.sources is not None:
        rows = fusion.sources_filter(rows, request.sources)
    if request.folders:
        holds = F.lit(False)
        for f in request.folders:
            holds = holds | fusion.folder_filter(F.col("path"), f, request.mode == "Standard")
        rows = rows.filter(holds)
    return rows


def hybrid_search(index: Index, request: Request) -> DataFrame:
    """(id, score, bm25, emb, ..): both lists at twice the size, fused, cut, then filtered."""
    k = request.top_k * (request.recall_factor if request.rerank else 1)
    expanded = index.chunks.sparkSession.range(1).select(X.expand_query(F.lit(request.query))).first()[0]
    left = index.keywords(expanded, 2 * k) if index.keywords else bm25.search(index.chunks, "chunk_id", "content", expanded, 2 * k)
    right = nearest(index, request, 2 * k)
    fuse = fusion.rrf if request.fusion == "rrf" else fusion.weighted
    top = fusion.top(fuse(left, right), k, "id")
    return allowed(top.join(index.chunks.withColumnRenamed("chunk_id", "id"), "id", "left"), request)


def standard_search(index: Index, request: Request) -> DataFrame:
    """Nearest vectors at twice the size, filtered, debiased by file, cut."""
    near = nearest(index, request, 2 * request.top_k).drop("rank")
    rows = allowed(near.join(index.chunks.withColumnRenamed("chunk_id", "id"), "id"), request)
    return fusion.top(fusion.debias(rows, "file_id"), request.top_k, "id")


def search(index: Index, request: Request) -> dict[str, DataFrame]:
    """The results, context, references and prompt of a request: recall, title hits first, graph neighbours, reranking or cutting."""
    from pyspark.sql import Window

    request = request.settled()
    found = standard_search(index, request) if request.mode in ("Quick", "Standard") else hybrid_search(index, request)
    columns = ["id", "score", "file_id", "path", "source", "chunk_index", "start_line", "end_line", "heading", "content", "bm25", "emb"]
    # scores of a leg that the way here has not are null
    whole = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns))
    found = whole(found).withColumn("place", F.lit(1))
    if index.nodes is not None and request.prefers_titles():
        hits = graph.title_search(index.nodes, index.chunks, request.query, request.top_k).select(F.col("chunk_id").alias("id"), "score")
        titled = whole(hits.join(index.chunks.withColumnRenamed("chunk_id", "id"), "id")).withColumn("place", F.lit(0))
        found = titled.unionByName(found.join(titled.select("id"), "id", "left_anti"))
    if index.edges is not None and request.graph_depth > 0:
        more = graph.expand_results(found.select("path", "score"), index.edges, index.chunks, index.vectors, V.literal(query_vector(request)), request.graph_depth)
        more = whole(more.select(F.col("chunk_id").alias("id"), "score").join(index.chunks.withColumnRenamed("chunk_id", "id"), "id")).withColumn("place", F.lit(2))
        found = found.unionByName(more.join(found.select("id"), "id", "left_anti"))
    if request.rerank:
        found = fusion.rerank(found, models.overlap_score(request.query, F.col("content")), request.top_k, request.recall_factor, request.rerank_threshold).withColumn("place", F.lit(0))
    order = [F.col("place"), F.desc("score"), F.col("id")]
    found = found.orderBy(*order).limit(request.top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("place", "recall_score")
    built = context.build_context(found.withColumn("title", X.file_stem(F.col("path"))), request.max_tokens)
    return {"results": context.projected(found), "context": built, "references": context.references(found), "prompt": context.prompt(built, request.query)}


def drill_down(index: Index, ids: DataFrame, window: int = 2) -> DataFrame:
    """(hit_id, context) around the chunks of ids (hit_id)."""
    return chunking.drill_down(index.chunks, ids, window)


def build_index(files: DataFrame, id_col: str = "file_id", text_col: str = "text", model=None, most: int = 512, overlap: int = 50, folder: str | None = None) -> Index:
    """Files (file_id, path, source, text) to chunks, their vectors and the link graph. With a folder, chunks are written there once; else they are cut anew by everything that reads them."""
    cut = chunking.chunk_markdown(files, id_col, text_col, most, overlap)
    chunks = cut.join(files.select(F.col(id_col).cast("string").alias("file_id"), "path", "source"), "file_id")
    if folder is not None:
        store = Store(files.sparkSession, folder)
        chunks = cut = store.part(store.write(chunks, "chunks", 1), "chunks", f"{chunking.SCHEMA}, chunk_id string, path string, source string")
    nodes, edges = graph.build(files, "path", text_col)
    return Index(chunks, models.embed(cut, "content", model=model).select("chunk_id", "embedding"), nodes, edges)


def hierarchical_search(index: Index, vector, k: int = 10, n_documents: int = 10, n_sections: int = 20, n_chunks: int = 50) -> DataFrame:
    """(id, file_id, heading, score): documents by their mean vectors, sections of these documents alone, chunks, and all merged."""
    chunks = index.chunks.select("chunk_id", "file_id", "heading").join(index.vectors, "chunk_id")
    documents = knn.knn(knn.weighted_mean(chunks, "file_id", F.lit(1.0)), vector, n_documents, "file_id").withColumnRenamed("id", "file_id")
    inside = chunks.join(F.broadcast(documents.select("file_id")), "file_id", "left_semi").withColumn("section", F.struct("file_id", "heading"))
    sections = knn.knn(knn.weighted_mean(inside, "section", F.lit(1.0)), vector, n_sections, "section").select("id.file_id", "id.heading", "score")
    near = knn.knn(chunks, vector, n_chunks, "chunk_id").join(chunks.select(F.col("chunk_id").alias("id"), "file_id", "heading"), "id")
    return fusion.merge_tiers(near.select("id", "file_id", "heading", "score"), documents.select("file_id", "rank", "score"), sections, k)


def changed_files(stored: DataFrame, files: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(file_id) that leave the index, and the files (file_id, path, source, text, hash) to index anew, against stored (file_id, path, hash)."""
    from fathom.operators import sync

    change = sync.classify_changes(stored, files)
    kinds = ["New", "Modified", "Unchanged"] if force else ["New", "Modified"]
    gone = stored.join(change.filter(F.col("change").isin("Deleted", *kinds)).select("path"), "path", "left_semi").select("file_id")
    return gone, files.join(change.filter(F.col("change").isin(*kinds)).select("path"), "path", "left_semi")


def update_index(index: Index, stored: DataFrame, files: DataFrame, enabled: list[str] | None = None, force: bool = False, model=None, most: int = 512, overlap: int = 50) -> tuple[Index, DataFrame]:
    """The index and the stored files (file_id, path, source, hash) after files changed: only new and modified ones are cut and embedded.

    With `enabled`, files of other sources are neither indexed nor taken for deleted. What is stored of sources that no
    file has any more goes like every deleted file. force indexes all anew, as after a change of the model.
    """
    mine = (lambda df: df) if enabled is None else (lambda df: df.filter(F.col("source").isin(*enabled)))
    gone, changed = changed_files(mine(stored), mine(files), force)
    fresh = build_index(changed, model=model, most=most, overlap=overlap)
    ids = gone.select(F.col("file_id").cast("string").alias("file_id"))
    kept = index.chunks.join(ids, "file_id", "left_anti")
    dropped = index.chunks.join(ids, "file_id", "left_semi").select("chunk_id")
    chunks = kept.unionByName(fresh.chunks, allowMissingColumns=True)
    vectors = index.vectors.join(dropped, "chunk_id", "left_anti").unionByName(fresh.vectors)
    after = stored.join(gone, "file_id", "left_anti").unionByName(changed.select(*stored.columns))
    # links may lead to any file: the graph is resolved anew from all texts, which is one pass without embedding
    nodes, edges = graph.build(mine(files), "path", "text")
    return Index(chunks, vectors, nodes, edges), after
