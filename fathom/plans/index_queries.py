"""Queries of the stored index: early-ending search, cells of vectors, upserts and deletes, older versions, and a synchronised store."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import keyword_index, vector_index
from fathom.plans import search, stored_index
from fathom.plans.search_queries import K, L2_SQL, ORACLES as SEARCH_ORACLES, PROBE, PROBE_SQL, QUERY, classic_scores, rounded
from fathom.sources.snapshots import Store
from fathom.sources.tables import scratch_folder, spread, table

#: What is added to the German texts when they change.
ADDED = " nation of ender"


def documents(spark, sf_dir):
    """Documents as rows (id, owner, text); ids sort as the numbers do. The owner is the document."""
    rows = spread(table(spark, sf_dir, "documents"))
    return rows.select(F.format_string("%015d", "doc_id").alias("id"), F.format_string("%015d", "doc_id").alias("owner"), "text", "lang", "source")


def committed(store, rows=None, gone=None):
    base = store.snapshot()
    parts, totals = keyword_index.add_segment(store, base, rows, gone)
    return store.commit(base, parts, totals=totals)


def changed_store(spark, sf_dir):
    """Two versions: all documents; then German texts are longer, and those of src3 are gone."""
    docs, store = documents(spark, sf_dir), Store(spark, scratch_folder(spark))
    committed(store, docs.select("id", "owner", "text"))
    longer = docs.filter("lang = 'de' and source <> 'src3'").select("id", "owner", F.concat(F.coalesce("text", F.lit("")), F.lit(ADDED)).alias("text"))
    committed(store, longer, docs.filter("source = 'src3'").select("owner"))
    return store


def hits(store, version, query=QUERY):
    return rounded(keyword_index.search(store, store.snapshot(version), query, K), "score").select(F.col("id").cast("long").alias("doc_id"), "score", "rank")


def index_top(spark, sf_dir):
    """bm25_topk from posting blocks, of which only those that may hold a result are read."""
    store = Store(spark, scratch_folder(spark))
    committed(store, documents(spark, sf_dir).select("id", "owner", "text"))
    return hits(store, 1)


def index_changed(spark, sf_dir):
    return hits(changed_store(spark, sf_dir), 2)


def index_before(spark, sf_dir):
    """The first version, after the second was committed."""
    return hits(changed_store(spark, sf_dir), 1)


def index_merged(spark, sf_dir):
    store = changed_store(spark, sf_dir)
    base = store.snapshot()
    replace, _ = keyword_index.merge(store, base)
    store.commit(base, {}, replace)
    return hits(store, 3)


def index_frequencies(spark, sf_dir):
    """The kept document frequencies after the change."""
    store = changed_store(spark, sf_dir)
    held = store.table(store.snapshot(), "terms", keyword_index.TERMS)
    return held.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def note_files(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("file_id"), F.format_string("notes/%d.md", "doc_id").alias("path"), "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


def synced_store(spark, sf_dir):
    """A store of all notes, synchronised with a disk on which those of src3 are gone and those of src5 have another line."""
    now, store = note_files(spark, sf_dir), Store(spark, scratch_folder(spark))
    stored_index.synchronise(store, now)
    text = F.when(F.col("source") == "src5", F.concat(F.coalesce("text", F.lit("")), F.lit("\n# Added\n\nsee [[1]]"))).otherwise(F.col("text"))
    disk = now.filter("source <> 'src3'").withColumn("text", text).withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    stored_index.synchronise(store, disk)
    return store


def index_synchronised(spark, sf_dir):
    """The files, and whether their chunks hold the line that was added."""
    store = synced_store(spark, sf_dir)
    index = stored_index.open_index(store)
    added = index.chunks.groupBy("path").agg(F.max(F.contains("content", F.lit("# Added")).cast("int")).alias("added"))
    held = stored_index.files(store, store.snapshot()).select("path", F.lower("hash").alias("hash"))
    return held.join(added, "path", "left").withColumn("added", F.coalesce("added", F.lit(0)))


def index_search(spark, sf_dir):
    """A hybrid request, with title hits, over a synchronised store."""
    found = search.search(stored_index.open_index(synced_store(spark, sf_dir)), search.Request(QUERY))["results"]
    return rounded(found, "score").select("path", "chunk_index", "score", "rank")


def embedded(spark, sf_dir):
    """Embeddings as rows of the index; the owner of a vector is itself."""
    rows, name = spread(table(spark, sf_dir, "embeddings")), F.format_string("%015d", "vec_id")
    return rows.select(name.alias("id"), name.alias("owner"), F.lit("m").alias("model"), "embedding", "label")


def vector_store(spark, sf_dir):
    """Two versions: all vectors; then those of label 3 are gone, and those of label 5 point the other way."""
    rows, store = embedded(spark, sf_dir), Store(spark, scratch_folder(spark))
    turned = rows.filter("label = 5").withColumn("embedding", F.transform("embedding", lambda x: -x))
    for new, gone in ((rows, None), (turned, rows.filter("label = 3").select("owner"))):
        base = store.snapshot()
        parts, totals = vector_index.add_segment(store, base, new, gone)
        store.commit(base, parts, totals=totals)
    return store


def vector_hits(spark, sf_dir, store, version):
    probe = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == PROBE).first()["embedding"]
    found = vector_index.search(store, store.snapshot(version), probe, K, "m")
    return rounded(found, "score").select(F.col("id").cast("long").alias("vec_id"), "score", "rank")


def vector_index_before(spark, sf_dir):
    """knn_topk from cells: the first version, after the second was committed."""
    return vector_hits(spark, sf_dir, vector_store(spark, sf_dir), 1)


def vector_index_changed(spark, sf_dir):
    return vector_hits(spark, sf_dir, vector_store(spark, sf_dir), 2)


def vector_index_merged(spark, sf_dir):
    store = vector_store(spark, sf_dir)
    base = store.snapshot()
    replace, _ = vector_index.merge(store, base)
    store.commit(base, {}, replace)
    return vector_hits(spark, sf_dir, store, 3)


def vector_index_many(spark, sf_dir):
    """The five nearest of every hundredth vector, in the changed index."""
    store = vector_store(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = vector_index.search_many(store, store.snapshot(), asked, 5, "m")
    return rounded(found, "score").select("query_id", F.col("id").cast("long").alias("vec_id"), "score", "rank")


QUERIES = {f.__name__: f for f in (index_top, index_changed, index_before, index_merged, index_frequencies, index_synchronised, index_search, vector_index_before, vector_index_changed, vector_index_merged, vector_index_many)}

STATE = f"documents AS (SELECT doc_id, CASE WHEN lang = 'de' THEN coalesce(text, '') || '{ADDED}' ELSE text END AS text FROM main.documents WHERE source IS DISTINCT FROM 'src3')"
TOP = f"SELECT id AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scores ORDER BY scores.score DESC, id LIMIT {K}"
VECTORS = "e AS (SELECT vec_id, CASE WHEN label = 5 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS embedding FROM embeddings WHERE label <> 3)"
NEAREST = f"WITH {PROBE_SQL}, {VECTORS} SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT vec_id, {L2_SQL} AS s FROM e, q) ORDER BY s DESC, vec_id LIMIT {K}"
ORACLES = {
    "index_top": SEARCH_ORACLES["bm25_topk"],
    "index_before": SEARCH_ORACLES["bm25_topk"],
    "index_changed": f"WITH {STATE}, {classic_scores()} {TOP}",
    "index_merged": f"WITH {STATE}, {classic_scores()} {TOP}",
    "index_frequencies": f"WITH {STATE}, {classic_scores().split('corpus AS')[0]} w AS (SELECT DISTINCT id, unnest(t) AS term FROM tok) SELECT term, count(*)::BIGINT AS df FROM w GROUP BY term",
    "vector_index_before": SEARCH_ORACLES["knn_topk"],
    "vector_index_changed": NEAREST,
    "vector_index_merged": NEAREST,
    "vector_index_many": f"WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), {VECTORS}, r AS (SELECT query_id, vec_id, {L2_SQL} AS s FROM e, q), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM r) SELECT query_id, vec_id, round(s, 6) AS score, rank FROM t WHERE rank <= 5",
    "index_synchronised": "WITH s AS (SELECT 'notes/' || doc_id || '.md' AS path, coalesce(source, '') = 'src5' AS added, coalesce(text, '') || CASE WHEN source = 'src5' THEN chr(10) || '# Added' || chr(10) || chr(10) || 'see [[1]]' ELSE '' END AS text FROM documents WHERE source <> 'src3') SELECT path, sha256(text) AS hash, added::INTEGER AS added FROM s",
}
