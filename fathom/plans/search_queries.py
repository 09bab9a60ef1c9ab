"""Queries of keyword and vector search, fusion and what follows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.functions import text as X, vectors as V
from fathom.functions.fixed_values import CLASSIC_STOP_WORDS, FTS_STOP_WORDS
from fathom.operators import bm25, fusion, knn
from fathom.plans import search
from fathom.sources.tables import scratch_folder, spread, table

QUERY = "the nation of ender thing"
#: The vector that vector queries search with, by its vec_id.
PROBE = 7
K = 10


def quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


CJK_SQL = "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}]"


def tokens_sql(text: str, stop_words) -> str:
    """The DuckDB form of functions.text.tokens."""
    spaced = f"regexp_replace({text}, '({CJK_SQL})', ' \\1 ', 'g')"
    bare = f"lower(regexp_replace({spaced}, '[\\p{{Pc}}\\p{{Pd}}\\p{{Ps}}\\p{{Pe}}\\p{{Pi}}\\p{{Pf}}\\p{{Po}}]', ' ', 'g'))"
    return f"list_filter(regexp_split_to_array({bare}, '\\s+'), lambda t: t <> '' AND NOT list_contains([{quoted(stop_words)}], t))"


def classic_scores(query: str = QUERY) -> str:
    return f"""
tok AS (SELECT doc_id AS id, {tokens_sql("coalesce(text, '')", CLASSIC_STOP_WORDS)} AS t FROM documents),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avg_len FROM tok),
asked AS (SELECT DISTINCT unnest({tokens_sql("'" + query + "'", CLASSIC_STOP_WORDS)}) AS term),
hits AS (SELECT id, len(t) AS len, term, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf FROM tok, asked WHERE list_contains(t, term)),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM hits GROUP BY term),
scores AS (
  SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM hits JOIN dfs USING (term), corpus GROUP BY id)"""


def probe(spark: SparkSession, sf_dir: str):
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == PROBE).select("embedding").first()
    return V.literal(row["embedding"])


L2_SQL = "1 / (1 + sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))))"
PROBE_SQL = f"q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {PROBE})"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def bm25_topk(spark, sf_dir):
    return rounded(bm25.search(docs(spark, sf_dir), "doc_id", "text", QUERY, K), "score").select(F.col("id").alias("doc_id"), "score", "rank")


def bm25_fts_topk(spark, sf_dir):
    return rounded(bm25.search(docs(spark, sf_dir), "doc_id", "text", "erenth erenth the ndor", K, "fts"), "score").select(F.col("id").alias("doc_id"), "score", "rank")


def bm25_scores(spark, sf_dir):
    return rounded(bm25.search(docs(spark, sf_dir), "doc_id", "text", QUERY, None), "score").select(F.col("id").alias("doc_id"), "score")


def bm25_postings(spark, sf_dir):
    return bm25.postings(docs(spark, sf_dir), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("total"))


def bm25_stats(spark, sf_dir):
    return rounded(bm25.stats(docs(spark, sf_dir), "text"), "avg_chars")


def bm25_many(spark, sf_dir):
    index = bm25.postings(docs(spark, sf_dir), "doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rounded(bm25.search_many(index, bm25.corpus(docs(spark, sf_dir), "doc_id", "text"), asked, 3), "score").select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def knn_topk(spark, sf_dir):
    return rounded(knn.knn(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), K), "score").withColumnRenamed("id", "vec_id")


def knn_cosine(spark, sf_dir):
    return rounded(knn.knn(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), K, metric="cosine"), "score").withColumnRenamed("id", "vec_id")


def knn_filtered(spark, sf_dir):
    return rounded(knn.knn(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), K, where=F.col("label") == 1), "score").withColumnRenamed("id", "vec_id")


def knn_postfiltered(spark, sf_dir):
    return rounded(knn.knn(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), K, where=F.col("label") == 1, overfetch=3), "score").withColumnRenamed("id", "vec_id")


def knn_in_ids(spark, sf_dir):
    ids = docs(spark, sf_dir).filter(F.col("lang") == "en").select(F.col("doc_id").alias("vec_id"))
    return rounded(knn.knn(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), K, ids=ids), "score").withColumnRenamed("id", "vec_id")


def knn_many(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    queries = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(knn.knn_many(v, queries, 5), "score").withColumnRenamed("id", "vec_id")


def vector_stats(spark, sf_dir):
    return knn.vector_stats(table(spark, sf_dir, "embeddings"), "label")


def aggregate_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("w", 1.0 + F.col("vec_id") % 3)
    made = knn.weighted_mean(rows, "label", F.col("w"))
    return made.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def similar_pairs(spark, sf_dir):
    return rounded(knn.similar_pairs(table(spark, sf_dir, "embeddings"), 0.5), "similarity")


def legs(spark, sf_dir):
    found = bm25.search(docs(spark, sf_dir), "doc_id", "text", QUERY, 2 * K)
    return found, knn.knn(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 2 * K)


def hybrid_weighted(spark, sf_dir):
    return rounded(fusion.top(fusion.weighted(*legs(spark, sf_dir)), K, "id").select("id", "score"), "score")


def hybrid_rrf(spark, sf_dir):
    return rounded(fusion.top(fusion.rrf(*legs(spark, sf_dir)), K, "id").select("id", "score"), "score")


def hybrid_filtered(spark, sf_dir):
    """Hits are filtered by source after the cut, so fewer than K may stay."""
    top = fusion.top(fusion.weighted(*legs(spark, sf_dir)), K, "id").select("id", "score")
    files = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source")
    return rounded(fusion.sources_filter(top.join(files, "id", "left"), ["src0", "src1", "src2", "src3", "src4", "src5"]), "score")


def standard_search(spark, sf_dir):
    """2K nearest, by enabled source, debiased by source, best K."""
    near = knn.knn(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 2 * K).drop("rank")
    rows = near.join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source"), "id")
    return rounded(fusion.top(fusion.debias(rows, "source"), K, "id"), "score")


def debias_by_mean(spark, sf_dir):
    near = knn.knn(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 5 * K).drop("rank")
    rows = near.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return rounded(fusion.debias_by_mean(rows, "label"), "score")


def rerank(spark, sf_dir):
    """The 3 best of hybrid candidates by the share of query terms in their text."""
    top = fusion.top(fusion.weighted(*legs(spark, sf_dir)), 2 * K, "id").select("id", "score")
    rows = top.join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id")
    wanted = X.tokens(F.lit(QUERY))
    share = F.size(F.array_intersect(X.tokens(F.col("text")), wanted)) / F.size(F.array_distinct(wanted))
    return rounded(fusion.rerank(rows, share, 3, threshold=0.1).select("id", "score", "recall_score"), "score", "recall_score")


def mmr(spark, sf_dir):
    found = bm25.search(docs(spark, sf_dir), "doc_id", "text", QUERY, 40)
    rows = found.join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")
    return rounded(fusion.mmr(rows.select(F.lit(1).cast("long").alias("query_id"), "id", "score", "content"), K), "score")


def token_budget(spark, sf_dir):
    found = bm25.search(docs(spark, sf_dir), "doc_id", "text", QUERY, 40)
    rows = found.join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), X.estimate_tokens(F.col("text")).alias("tokens")), "id")
    return fusion.token_budget(rows, 4000, F.col("rank")).select("id", "tokens", "used")


def hierarchical(spark, sf_dir):
    """All vectors as chunks: their labels are the documents, and the labels' even and odd ids are the sections."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("file_id"), F.concat(F.lit("h"), (F.col("vec_id") % 2).cast("string")).alias("heading"), "embedding")
    index = search.Index(v.select("chunk_id", "file_id", "heading"), v.select("chunk_id", "embedding"))
    return rounded(search.hierarchical_search(index, probe(spark, sf_dir), K, 3, 4, 12), "score")


def bm25_stored(spark, sf_dir):
    """The search of bm25_topk over postings that are stored first."""
    path = scratch_folder(spark)
    bm25.write_index(docs(spark, sf_dir), path, "doc_id", "text")
    return rounded(bm25.search_index(spark, path, QUERY, K), "score").select(F.col("id").alias("doc_id"), "score", "rank")


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_fts_topk, bm25_scores, bm25_postings, bm25_stats, bm25_many, knn_topk, knn_cosine, knn_filtered, knn_postfiltered, knn_in_ids, knn_many, vector_stats, aggregate_vectors, similar_pairs, hybrid_weighted, hybrid_rrf, hybrid_filtered, standard_search, debias_by_mean, rerank, mmr, token_budget, hierarchical, bm25_stored)}

NEAR = f"near AS (SELECT vec_id AS id, {L2_SQL} AS score FROM embeddings e, q)"
VEC20 = "vec AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM near ORDER BY score DESC, id LIMIT 20)"
KEY20 = "key AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scores ORDER BY score DESC, id LIMIT 20)"
BOTH = f"{classic_scores()}, {KEY20}, {PROBE_SQL}, {NEAR}, {VEC20}"
WEIGHTED = f"{BOTH}, fused AS (SELECT id, 0.35 * coalesce(key.score / (SELECT max(score) FROM key), 0) + 0.65 * coalesce(vec.score / (SELECT max(score) FROM vec), 0) AS score FROM key FULL JOIN vec USING (id))"


def top_sql(where: str = "", k: int = K) -> str:
    return f"WITH {PROBE_SQL} SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT vec_id, {L2_SQL} AS s FROM embeddings e, q {where}) ORDER BY s DESC, vec_id LIMIT {k}"


ORACLES = {
    "bm25_topk": f"WITH {classic_scores()} SELECT id AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scores ORDER BY scores.score DESC, id LIMIT {K}",
    "bm25_scores": f"WITH {classic_scores()} SELECT id AS doc_id, round(score, 6) AS score FROM scores",
    "bm25_fts_topk": f"""
WITH plain AS (SELECT doc_id AS id, {tokens_sql("coalesce(text, '')", FTS_STOP_WORDS)} AS t FROM documents),
tok AS (SELECT id, list_filter(regexp_split_to_array(translate(array_to_string(t, ' '), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿāēīōūščžňřťďľğ', 'aaaaaaceeeeiiiinooooouuuuyyaeiouscznrtdlg'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM plain),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avg_len FROM tok),
asked AS (SELECT * FROM (VALUES ('erenth', 2), ('ndor', 1)) AS v(term, times)),
hits AS (SELECT id, len(t) AS len, term, times, 0.75 * len(list_filter(t, lambda x: x = term)) AS f FROM tok, asked WHERE list_contains(t, term)),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM hits GROUP BY term),
scores AS (SELECT id, sum(times * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM hits JOIN dfs USING (term), corpus GROUP BY id)
SELECT id AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scores ORDER BY scores.score DESC, id LIMIT {K}""",
    "bm25_postings": f"WITH tok AS (SELECT doc_id, unnest({tokens_sql("coalesce(text, '')", CLASSIC_STOP_WORDS)}) AS term FROM documents) SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS total FROM tok GROUP BY term",
    "bm25_stats": f"WITH tok AS (SELECT {tokens_sql("coalesce(text, '')", CLASSIC_STOP_WORDS)} AS t FROM documents) SELECT count(*)::BIGINT AS n_docs, round(avg(length(array_to_string(t, ' '))), 6) AS avg_chars, sum(len(t))::BIGINT AS n_terms, (SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM tok))::BIGINT AS vocabulary FROM tok",
    "bm25_many": f"""
WITH tok AS (SELECT doc_id AS id, {tokens_sql("coalesce(text, '')", CLASSIC_STOP_WORDS)} AS t FROM documents),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avg_len FROM tok),
post AS (SELECT id, len, term, count(*)::DOUBLE AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY id, len, term),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql("text", CLASSIC_STOP_WORDS)}) AS term FROM benchmark),
scores AS (SELECT query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) AS s FROM post JOIN asked USING (term) JOIN dfs USING (term), corpus GROUP BY query_id, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scores)
SELECT query_id, id AS doc_id, round(s, 6) AS score, rank FROM ranked WHERE rank <= 3""",
    "knn_topk": top_sql(),
    "knn_cosine": f"WITH {PROBE_SQL} SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT vec_id, list_dot_product(e.embedding::DOUBLE[], q.v) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.v, q.v)) AS s FROM embeddings e, q) ORDER BY s DESC, vec_id LIMIT {K}",
    "knn_filtered": top_sql("WHERE label = 1"),
    "knn_postfiltered": f"WITH {PROBE_SQL}, n AS (SELECT vec_id, label, {L2_SQL} AS s FROM embeddings e, q ORDER BY s DESC, vec_id LIMIT {3 * K}) SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM n WHERE label = 1 ORDER BY s DESC, vec_id LIMIT {K}",
    "knn_in_ids": top_sql("WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "knn_many": f"WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT query_id, vec_id, {L2_SQL} AS s FROM embeddings e, q), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM r) SELECT query_id, vec_id, round(s, 6) AS score, rank FROM t WHERE rank <= 5",
    "vector_stats": "SELECT label, count(*)::BIGINT AS n_vectors, max(len(embedding))::BIGINT AS dimension, (count(*) * max(len(embedding)) * 4)::BIGINT AS bytes FROM embeddings GROUP BY label",
    "aggregate_vectors": "WITH p AS (SELECT label, 1.0::DOUBLE + vec_id % 3 AS w, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, sum(w * x) / sum(w) AS x FROM p GROUP BY label, i) SELECT label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m",
    "similar_pairs": "SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) / sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])), 6) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) / sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])) >= 0.5",
    "hybrid_weighted": f"WITH {WEIGHTED} SELECT id, round(fused.score, 6) AS score FROM fused ORDER BY fused.score DESC, id LIMIT {K}",
    "hybrid_rrf": f"WITH {BOTH}, fused AS (SELECT id, CASE WHEN key.rank IS NOT NULL AND vec.rank IS NOT NULL THEN 1.0::DOUBLE / (59 + key.rank) + 1.0::DOUBLE / (59 + vec.rank) ELSE 0.5::DOUBLE / (59 + coalesce(key.rank, vec.rank)) END AS s FROM key FULL JOIN vec USING (id)) SELECT id, round(s, 6) AS score FROM fused ORDER BY s DESC, id LIMIT {K}",
    "hybrid_filtered": f"WITH {WEIGHTED}, cut AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT {K}) SELECT cut.id AS id, round(cut.score, 6) AS score, source FROM cut LEFT JOIN documents ON doc_id = id WHERE coalesce(source, '') IN ('', 'src0', 'src1', 'src2', 'src3', 'src4', 'src5')",
    "standard_search": f"WITH {PROBE_SQL}, {NEAR}, {VEC20}, d AS (SELECT id, source, score / (1 + 0.1 * ln(count(*) OVER (PARTITION BY source))) AS s FROM vec JOIN documents ON doc_id = id) SELECT id, round(s, 6) AS score, source FROM d ORDER BY s DESC, id LIMIT {K}",
    "debias_by_mean": f"WITH {PROBE_SQL}, {NEAR}, v AS (SELECT id, score FROM near ORDER BY score DESC, id LIMIT 50), l AS (SELECT id, score, label FROM v JOIN embeddings ON vec_id = id), c AS (SELECT label, count(*) AS n FROM l GROUP BY label) SELECT id, label, round(score * (1 - 0.1 * log10(n / (SELECT avg(n) FROM c) + 1)), 6) AS score FROM l JOIN c USING (label)",
    "rerank": f"WITH {WEIGHTED}, cand AS (SELECT id, score FROM fused ORDER BY score DESC, id LIMIT 9), r AS (SELECT id, cand.score AS recall, len(list_intersect(t, list_distinct({tokens_sql("'" + QUERY + "'", CLASSIC_STOP_WORDS)})))::DOUBLE / len(list_distinct({tokens_sql("'" + QUERY + "'", CLASSIC_STOP_WORDS)})) AS s FROM cand JOIN tok USING (id)) SELECT id, round(s, 6) AS score, round(recall, 6) AS recall_score FROM r WHERE s >= 0.1 ORDER BY s DESC, id LIMIT 3",
    "token_budget": f"""WITH {classic_scores()}, k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scores ORDER BY score DESC, id LIMIT 40),
b AS (SELECT id, rank, floor((length(text) - length(regexp_replace(text, '[\\x{{4e01}}-\\x{{9ffe}}]', '', 'g'))) / 1.5 + floor(length(regexp_replace(text, '[\\x{{4e01}}-\\x{{9ffe}}]', '', 'g')) / 4))::BIGINT AS tokens FROM k JOIN documents ON doc_id = id),
s AS (SELECT id, tokens, sum(tokens) OVER (ORDER BY rank)::BIGINT AS used FROM b) SELECT id, tokens, used FROM s WHERE used <= 4000""",
    "hierarchical": f"""WITH {PROBE_SQL}, n AS (SELECT vec_id AS id, label AS file_id, 'h' || (vec_id % 2) AS heading, {L2_SQL} AS score FROM embeddings e, q),
c AS (SELECT * FROM n ORDER BY score DESC, id LIMIT 12),
x AS (SELECT label AS file_id, 'h' || (vec_id % 2) AS heading, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
dm AS (SELECT file_id, list(x ORDER BY i) AS v FROM (SELECT file_id, i, avg(x) AS x FROM x GROUP BY 1, 2) GROUP BY 1),
dn AS (SELECT file_id, list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z)))) AS embedding FROM dm),
d AS (SELECT file_id, {L2_SQL} AS score FROM dn e, q ORDER BY 2 DESC, 1 LIMIT 3),
sm AS (SELECT file_id, heading, list(x ORDER BY i) AS v FROM (SELECT file_id, heading, i, avg(x) AS x FROM x SEMI JOIN d USING (file_id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
sn AS (SELECT file_id, heading, list_transform(v, lambda y: y / sqrt(list_sum(list_transform(v, lambda z: z * z)))) AS embedding FROM sm),
s AS (SELECT file_id, heading, {L2_SQL} AS score FROM sn e, q ORDER BY 3 DESC, 1, 2 LIMIT 4),
f AS (SELECT c.id AS id, c.file_id AS file_id, c.heading AS heading, CASE WHEN d.score IS NULL THEN c.score ELSE 0.4 * c.score + 0.3 * d.score END AS score FROM c LEFT JOIN d ON d.file_id = c.file_id),
t AS (SELECT f.id AS id, f.file_id AS file_id, f.heading AS heading, f.score + 0.3 * coalesce((SELECT sum(s.score) FROM s WHERE s.file_id = f.file_id AND s.heading = f.heading), 0) AS sc FROM f)
SELECT id, file_id, heading, round(sc, 6) AS score FROM t ORDER BY sc DESC, id LIMIT {K}""",
}
ORACLES["bm25_stored"] = ORACLES["bm25_topk"]
