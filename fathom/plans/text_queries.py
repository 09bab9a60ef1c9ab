"""Queries of text and hash functions, links, chunks and context, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.functions import hashing as H, text as X, vectors as V
from fathom.operators import bm25, chunking, context, graph, models
from fathom.plans import search
from fathom.sources.tables import scratch_folder, spread, table


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes made of parts: a title, a fenced block, links by name and by path, an embed and a tag."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("string")
    other = F.concat(F.lit("notes/part"), (F.col("p_partkey") % 50).cast("string"))
    text = F.concat(
        F.lit("# Part "), n, F.lit("\n\nSee [["), other, F.lit("|the other]] and [[part"), (F.col("p_partkey") % 7).cast("string"), F.lit("#Size]] "), F.lit("#brand"), F.substring("p_brand", -2, 2),
        F.lit("\n```\n[[ignored]] # no heading\n```\n## Size\n![[images/"), F.col("p_size").cast("string"), F.lit(".png]] and [[missing note]]\n### Price\n"), F.col("p_type"),
    )
    return p.select(F.concat(F.lit("notes/part"), n, F.lit(".md")).alias("path"), text.alias("text"), F.col("p_partkey").alias("part"))


MARKDOWN_SQL = """notes AS (SELECT 'notes/part' || p_partkey || '.md' AS path, p_partkey AS part,
'# Part ' || p_partkey || chr(10) || chr(10) || 'See [[notes/part' || (p_partkey % 50) || '|the other]] and [[part' || (p_partkey % 7) || '#Size]] #brand' || right(p_brand, 2) || chr(10) || '```' || chr(10) || '[[ignored]] # no heading' || chr(10) || '```' || chr(10) || '## Size' || chr(10) || '![[images/' || p_size || '.png]] and [[missing note]]' || chr(10) || '### Price' || chr(10) || p_type AS text FROM part)"""


def token_counts(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", X.count_tokens(t).alias("n_tokens"), X.estimate_tokens(t).alias("n_estimated"), X.client_tokens(t).alias("n_client"))


def fingerprints(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", H.fingerprint(t).alias("full"), H.short_hash(t).alias("short"), H.query_hash(t).alias("query"))


def sentence_stats(spark, sf_dir):
    s = X.sentences(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("first"))


def previews(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", *(X.preview(t, n).alias(f"p{n}") for n in (20, 50, 200)))


def query_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.when(F.col("n_nationkey") % 4 == 0, "如何 编程").when(F.col("n_nationkey") % 4 == 1, "数据库 的 定义").when(F.col("n_nationkey") % 4 == 2, "示例，配置").otherwise("plain"), F.lit(" "), "n_name").alias("q"))
    q = F.col("q")
    return rows.select("n_nationkey", X.expand_query(q).alias("expanded"), X.analyze_intent(q).alias("intent"), F.array_join(X.keywords(q), "|").alias("keywords"))


def enhanced(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", X.enhance(F.col("text"), F.col("source"), F.col("lang"), F.array("lang", "source"), F.concat(F.lit("docs/my-notes/"), "source")).alias("text"))


def path_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("C:\\vault\\"), "s_name", F.lit("\\note"), F.col("s_suppkey").cast("string"), F.lit(".MD")).alias("p"))
    p = F.col("p")
    wsl = X.to_wsl(p)
    return rows.select("s_suppkey", X.file_name(p).alias("name"), X.file_stem(p).alias("stem"), X.extension(p).alias("extension"), X.parent_folder(p).alias("folder"), wsl.alias("wsl"), X.from_wsl(wsl).alias("back"), X.model_table(p).alias("model_table"))


def link_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a/"), "p_name", F.lit(".md")).alias("path"), "p_size")
    link = X.line_link(F.col("path"), F.col("p_size"), F.col("p_size") + F.col("p_partkey").cast("int") % 3, F.lit("shown"))
    back = X.parse_link(link)
    return rows.select("p_partkey", link.alias("link"), X.section_link(F.col("path"), F.lit("A/B c")).alias("section"), back["start_line"].alias("start_line"), back["end_line"].alias("end_line"), back["shown"].alias("shown"))


def bigram_similarity(spark, sf_dir):
    """Of neighbouring documents, over whole texts: pairs are counted once each, in time linear in the text."""
    import pandas as pd

    @F.pandas_udf("double")
    def jaccard(a, b):
        from collections import Counter

        def one(x, y):
            if len(x) < 2 or len(y) < 2:
                return 0.0
            common = sum((Counter(zip(x, x[1:], strict=False)) & Counter(zip(y, y[1:], strict=False))).values())
            return common / (len(x) + len(y) - 2 - common)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    d = docs(spark, sf_dir).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "").alias("t"))
    e = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return d.join(e, "doc_id").select("doc_id", F.round(jaccard("t", "u"), 6).alias("similarity"))


def vector_functions(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    x, y = F.col("a"), F.col("b")
    sim = V.cosine(x, y)
    rows = a.join(b, "vec_id").select("vec_id", F.round(V.dot(x, y), 6).alias("dot"), F.round(sim, 6).alias("cosine"), F.round(V.from_distance(V.l2_distance(x, y)), 6).alias("near"), F.round(V.sigmoid(V.dot(x, y)), 6).alias("sigmoid"), V.band(sim).alias("band"))
    return rows


def links(spark, sf_dir):
    return graph.extract_links(markdown(spark, sf_dir), "path", "text").select(F.col("id").alias("path"), "target", "heading", "type", "line")


def headings(spark, sf_dir):
    return graph.headings(markdown(spark, sf_dir), "path", "text").select(F.col("id").alias("path"), "level", "title", "line")


def graph_nodes(spark, sf_dir):
    return graph.build(markdown(spark, sf_dir))[0].groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def graph_edges(spark, sf_dir):
    return graph.build(markdown(spark, sf_dir))[1]


def key_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and suppliers as a graph."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, key, name, kind: df.select(F.concat(F.lit(kind[0]), F.col(key).cast("string")).alias("id"), F.col(name).alias("title"), F.lit(kind).alias("type"))
    nodes = node(t("region"), "r_regionkey", "r_name", "region").unionByName(node(t("nation"), "n_nationkey", "n_name", "nation")).unionByName(node(t("supplier"), "s_suppkey", "s_name", "supplier"))
    edge = lambda df, a, ka, b, kb, kind: df.select(F.concat(F.lit(ka), F.col(a).cast("string")).alias("from_id"), F.concat(F.lit(kb), F.col(b).cast("string")).alias("to_id"), F.lit(kind).alias("type"), F.lit(1).alias("line_number"))
    return nodes, edge(t("nation"), "n_nationkey", "n", "n_regionkey", "r", "in").unionByName(edge(t("supplier"), "s_suppkey", "s", "s_nationkey", "n", "from"))


def graph_neighbors(spark, sf_dir):
    nodes, edges = key_graph(spark, sf_dir)
    roots = spark.sql("SELECT * FROM VALUES ('r1'), ('s2') AS t(id)")
    return graph.neighbors(nodes, edges, roots, 2)


def graph_subgraph(spark, sf_dir):
    nodes, edges = key_graph(spark, sf_dir)
    reached = graph.neighbors(nodes, edges, spark.sql("SELECT 'r1' AS id"), 2)
    return graph.subgraph_edges(edges, reached, 2).select("from_id", "to_id", "type")


def graph_search(spark, sf_dir):
    return graph.search_nodes(key_graph(spark, sf_dir)[0], "a", 10)


def graph_stats(spark, sf_dir):
    nodes, edges = graph.build(markdown(spark, sf_dir))
    return graph.stats(nodes, edges)


def chunks_of(spark, sf_dir):
    return chunking.chunk_markdown(docs(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string")), "id", "text", 128, 20)


def chunk_markdown(spark, sf_dir):
    return chunks_of(spark, sf_dir).select("chunk_id", "file_id", "chunk_index", "token_count", "start_line", "end_line", "heading", "type", "weight")


def chunk_outline(spark, sf_dir):
    return chunking.outline(chunking.chunk_markdown(markdown(spark, sf_dir), "path", "text", 16, 4)).select("file_id", "n_chunks", "last_line", F.array_join("sections", "|").alias("sections"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks, for windows over them."""
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "content"))
    return rows.select(F.col("doc_id").alias("file_id"), F.col("i").alias("chunk_index"), F.concat_ws("#", "doc_id", "i").alias("chunk_id"), "content")


def context_window(spark, sf_dir):
    chunks = line_chunks(spark, sf_dir)
    return chunking.adjacent(chunks, chunks.select(F.col("chunk_id").alias("hit_id")), 1)


def context_by_position(spark, sf_dir):
    chunks = line_chunks(spark, sf_dir)
    return chunking.adjacent_by_position(chunks, chunks.select(F.col("chunk_id").alias("hit_id")), 1)


def drill_down(spark, sf_dir):
    chunks = line_chunks(spark, sf_dir)
    hits = chunks.select(F.col("chunk_id").alias("hit_id"))
    return chunking.drill_down(chunks, hits, 2)


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hit_id, rank) of a search over the lines of all documents."""
    found = bm25.search(line_chunks(spark, sf_dir), "chunk_id", "content", "erenth ndor thing", 20)
    return found.select(F.col("id").alias("hit_id"), "rank")


def drill_down_searched(spark, sf_dir):
    return chunking.drill_down(line_chunks(spark, sf_dir), line_hits(spark, sf_dir).select("hit_id"), 2)


def expand_context_searched(spark, sf_dir):
    chunks = line_chunks(spark, sf_dir).withColumn("heading", F.concat(F.lit("part "), F.floor(F.col("chunk_index") / 3).cast("string")))
    return context.expand_context(line_hits(spark, sf_dir).select("hit_id"), chunks, 1)


def build_context_searched(spark, sf_dir):
    """The context of a search over the lines of all documents: the budget's window sees its top-k only."""
    whole = line_chunks(spark, sf_dir).join(docs(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "lang", "source"), "file_id")
    rows = whole.join(F.broadcast(line_hits(spark, sf_dir)), F.col("chunk_id") == F.col("hit_id"))
    return context.build_context(rows.select("rank", F.lit(None).cast("string").alias("title"), F.col("lang").alias("heading"), F.concat(F.lit("a/"), "source", F.lit(".md")).alias("path"), "content"), 3000)


def order_midpoints(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.col("l_linenumber").cast("double"))
    return rows.select("l_orderkey", "l_linenumber", chunking.midpoint(F.lag("o").over(w), F.lead("o").over(w)).alias("middle"))


def build_context(spark, sf_dir):
    """The context of the sixty shortest documents, as a result list."""
    from pyspark.sql import Window

    order = [F.length("text"), F.col("doc_id")]
    listed = docs(spark, sf_dir).orderBy(*order).limit(60).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    rows = listed.select("rank", F.lit(None).cast("string").alias("title"), "lang", F.col("lang").alias("heading"), F.concat(F.lit("a/"), "source", F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return context.build_context(rows, 3000)


def references(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("rank"), F.col("source").alias("path"), F.col("text").alias("content"))
    return context.references(rows)


def expand_context(spark, sf_dir):
    chunks = line_chunks(spark, sf_dir).withColumn("heading", F.concat(F.lit("part "), F.floor(F.col("chunk_index") / 3).cast("string")))
    return context.expand_context(chunks.select(F.col("chunk_id").alias("hit_id")), chunks, 1)


def embed(spark, sf_dir):
    made = models.embed(docs(spark, sf_dir), "text", model=models.HashingEmbedder(16))
    return made.select("doc_id", *(F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(f"e{i}") for i in range(4)))


def search_request(spark, sf_dir):
    """A whole request over an index built from all documents."""
    files = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "source", "text")
    made = search.build_index(files, model=models.HashingEmbedder(64), folder=scratch_folder(spark))
    request = search.Request("erenth ndor thing", vector=models.HashingEmbedder(64)(["erenth ndor thing"])[0], rerank=True, top_k=5)
    return search.search(made, request)["results"].select("id", "path", F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (token_counts, fingerprints, sentence_stats, previews, query_functions, enhanced, path_functions, link_functions, bigram_similarity, vector_functions, links, headings, graph_nodes, graph_edges, graph_neighbors, graph_subgraph, graph_search, graph_stats, chunk_markdown, chunk_outline, context_window, context_by_position, drill_down, drill_down_searched, expand_context_searched, build_context_searched, order_midpoints, build_context, references, expand_context, embed, search_request)}

LINES = "ln AS (SELECT path, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM notes), fen AS (SELECT *, sum(CASE WHEN starts_with(ltrim(t), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS f, starts_with(ltrim(t), '```') AS mark FROM ln), free AS (SELECT path, t, line FROM fen WHERE NOT mark AND f % 2 = 0)"
FOUND = """raw AS (
  SELECT path, line, 'embed' AS type, unnest(regexp_extract_all(t, '!\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|[^\\]]+)?\\]\\]', 1)) AS target, unnest(regexp_extract_all(t, '!\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|[^\\]]+)?\\]\\]', 2)) AS h FROM free
  UNION ALL SELECT path, line, 'wikilink', unnest(regexp_extract_all(b, '\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|[^\\]]+)?\\]\\]', 1)), unnest(regexp_extract_all(b, '\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|[^\\]]+)?\\]\\]', 2)) FROM (SELECT *, regexp_replace(t, '!\\[\\[[^\\]]+\\]\\]', '', 'g') AS b FROM free)
  UNION ALL SELECT path, line, 'tag', unnest(regexp_extract_all(regexp_replace(t, '!?\\[\\[[^\\]]+\\]\\]', '', 'g'), '(?:^|\\s)#([\\p{L}\\p{N}_/-]+)', 1)), '' FROM free),
lk AS (SELECT path, CASE WHEN type = 'tag' OR string_split(target, '/')[-1] LIKE '%.%' THEN target ELSE target || '.md' END AS target, nullif(h, '') AS heading, type, line::INT AS line FROM raw)"""
HEADS = "hd AS (SELECT path, length(regexp_extract(t, '^(#{1,6})\\s+(.+)', 1))::INT AS level, trim(regexp_extract(t, '^(#{1,6})\\s+(.+)', 2)) AS title, line::INT AS line FROM free WHERE regexp_matches(t, '^(#{1,6})\\s+(.+)'))"
RESOLVED = "rs AS (SELECT lk.path, lk.type, lk.line, lk.target, coalesce(n.path, m.path) AS node FROM lk LEFT JOIN notes n ON n.path = lk.target AND lk.type <> 'tag' LEFT JOIN notes m ON string_split(m.path, '/')[-1] = lower(string_split(lk.target, '/')[-1]) AND lk.type <> 'tag')"
EDGES = "ed AS (SELECT path AS from_id, CASE WHEN type = 'tag' THEN '#' || target ELSE coalesce(node, target) END AS to_id, type, max(line) AS line_number FROM rs GROUP BY ALL UNION ALL SELECT path, path || '#' || title, 'heading', max(line) FROM hd GROUP BY ALL)"
NODES = "nd AS (SELECT path AS id, 'document' AS type FROM notes UNION ALL SELECT DISTINCT path || '#' || title, 'heading' FROM hd UNION ALL SELECT DISTINCT '#' || target, 'tag' FROM lk WHERE type = 'tag' UNION ALL SELECT DISTINCT target, 'external' FROM rs WHERE type <> 'tag' AND node IS NULL)"
GRAPH = f"WITH {MARKDOWN_SQL}, {LINES}, {FOUND}, {HEADS}, {RESOLVED}, {EDGES}, {NODES}"
KEYS = "nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS title, 'region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier), edges AS (SELECT 'n' || n_nationkey AS from_id, 'r' || n_regionkey AS to_id, 'in' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'from' FROM supplier), adj AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges)"
LINE_CHUNKS = "lc AS (SELECT doc_id AS file_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS content FROM documents)"
N = lambda pattern: f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))"
PREVIEW = lambda n: f"CASE WHEN length(text) > {n} THEN left(text, {n}) || '...' ELSE text END AS p{n}"

BLOCK = "concat_ws(chr(10) || chr(10), '### ' || source, '**' || lang || '**', c, '[[a/' || source || '.md]]')"
ORACLES = {
    "build_context": f"WITH r AS (SELECT row_number() OVER (ORDER BY length(text), doc_id) AS rank, lang, source, text AS c FROM documents ORDER BY length(text), doc_id LIMIT 60), t AS (SELECT *, floor((length(c) - length(regexp_replace(c, '[\\x{{4e01}}-\\x{{9ffe}}]', '', 'g'))) / 1.5 + floor(length(regexp_replace(c, '[\\x{{4e01}}-\\x{{9ffe}}]', '', 'g')) / 4))::BIGINT AS tk FROM r), u AS (SELECT *, sum(tk) OVER (ORDER BY rank) AS used FROM t) SELECT string_agg({BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*)::BIGINT AS n, sum(tk)::BIGINT AS tokens FROM u WHERE used <= 3000",
    "references": "SELECT source AS path, count(*)::BIGINT AS n, min(doc_id) AS best, CASE WHEN length(arg_min(text, doc_id)) > 50 THEN left(arg_min(text, doc_id), 50) || '...' ELSE arg_min(text, doc_id) END AS preview FROM documents GROUP BY source",
    "expand_context": f"WITH {LINE_CHUNKS}, n AS (SELECT h.file_id || '#' || h.i AS hit_id, c.i - h.i AS o, c.content AS content, 'part ' || (c.i // 3) AS heading FROM lc h JOIN lc c ON c.file_id = h.file_id AND c.i BETWEEN h.i - 1 AND h.i + 1), p AS (SELECT *, CASE WHEN heading IS DISTINCT FROM lag(heading) OVER (PARTITION BY hit_id ORDER BY o) THEN '### ' || heading || chr(10) ELSE '' END || CASE WHEN o = 0 THEN '**[HIT]** ' ELSE '' END || content AS piece FROM n) SELECT hit_id, string_agg(piece, chr(10) || chr(10) ORDER BY o) AS context, count(*) FILTER (o < 0)::BIGINT AS n_before, count(*) FILTER (o > 0)::BIGINT AS n_after FROM p GROUP BY hit_id",
    "token_counts": f"WITH c AS (SELECT doc_id, length(text) AS n, {N('[\\x{4e00}-\\x{9fff}]')} AS cjk, {N('[A-Za-z]')} AS l, {N('[0-9]')} AS d, {N('[\\x{4e01}-\\x{9ffe}]')} AS c2 FROM documents) SELECT doc_id, (floor(cjk / 1.5) + floor(l / 4) + floor(d / 3) + floor((n - cjk - l - d) / 2))::BIGINT AS n_tokens, floor(c2 / 1.5 + floor((n - c2) / 4))::BIGINT AS n_estimated, ceil(n / 2)::BIGINT AS n_client FROM c",
    "fingerprints": "SELECT doc_id, upper(sha256(text)) AS full, CASE WHEN text = '' THEN '' ELSE left(sha256(text), 16) END AS short, upper(left(sha256(text), 16)) AS query FROM documents",
    "sentence_stats": "WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?][\"」]?|[^。！？.!?]+$'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(s[1], '') AS first FROM s",
    "previews": f"SELECT doc_id, {PREVIEW(20)}, {PREVIEW(50)}, {PREVIEW(200)} FROM documents",
    "path_functions": "WITH s AS (SELECT s_suppkey, 'C:\\vault\\' || s_name || '\\note' || s_suppkey || '.MD' AS p, s_name AS n FROM supplier) SELECT s_suppkey, 'note' || s_suppkey || '.MD' AS name, 'note' || s_suppkey AS stem, '.md' AS extension, 'C:\\vault\\' || n AS folder, '/mnt/c/vault/' || n || '/note' || s_suppkey || '.MD' AS wsl, p AS back, 'vec_' || regexp_replace(p, '[^A-Za-z0-9]', '_', 'g') AS model_table FROM s",
    "link_functions": "WITH r AS (SELECT p_partkey, p_name, p_size, p_size + (p_partkey % 3)::INT AS e FROM part) SELECT p_partkey, '[[a/' || p_name || '#L' || p_size || CASE WHEN e > p_size THEN '-L' || e ELSE '' END || '|shown]]' AS link, '[[a/' || p_name || '#A%20>%20B%20c]]' AS section, p_size AS start_line, e::INT AS end_line, 'shown' AS shown FROM r",
    "bigram_similarity": "WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS t FROM documents), g AS (SELECT doc_id, substr(t, i, 2) AS g, count(*) AS n FROM (SELECT doc_id, t, unnest(range(1, length(t))) AS i FROM b) GROUP BY 1, 2), p AS (SELECT a.doc_id AS doc_id, a.t AS t, c.t AS u FROM b a JOIN b c ON c.doc_id = a.doc_id + 1), m AS (SELECT a.doc_id AS doc_id, sum(least(a.n, c.n)) AS common FROM g a JOIN g c ON c.doc_id = a.doc_id + 1 AND c.g = a.g GROUP BY 1) SELECT doc_id, round(CASE WHEN length(t) < 2 OR length(u) < 2 THEN 0.0 ELSE coalesce(common, 0) / (length(t) - 1 + length(u) - 1 - coalesce(common, 0)) END, 6)::DOUBLE AS similarity FROM p LEFT JOIN m USING (doc_id)",
    "vector_functions": "WITH p AS (SELECT a.vec_id AS vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, list_dot_product(x, y) AS d, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS c, 1 / (1 + sqrt(list_sum(list_transform(list_zip(x, y), lambda q: (q[1] - q[2]) * (q[1] - q[2]))))) AS n FROM p) SELECT vec_id, round(d, 6) AS dot, round(c, 6) AS cosine, round(n, 6) AS near, round(1 / (1 + exp(-d)), 6) AS sigmoid, CASE WHEN c > 0.9 THEN 'very high' WHEN c > 0.7 THEN 'high' WHEN c > 0.5 THEN 'medium' WHEN c > 0.3 THEN 'low' ELSE 'very low' END AS band FROM d",
    "links": f"WITH {MARKDOWN_SQL}, {LINES}, {FOUND} SELECT path, target, heading, type, line FROM lk",
    "headings": f"WITH {MARKDOWN_SQL}, {LINES}, {HEADS} SELECT path, level, title, line FROM hd",
    "graph_nodes": f"{GRAPH} SELECT type, count(*)::BIGINT AS n, min(id) AS first FROM nd GROUP BY type",
    "graph_edges": f"{GRAPH} SELECT from_id, to_id, type, line_number FROM ed",
    "graph_stats": f"{GRAPH} SELECT count(*)::BIGINT AS n_nodes, count(*) FILTER (type = 'document')::BIGINT AS n_document, count(*) FILTER (type = 'heading')::BIGINT AS n_heading, count(*) FILTER (type = 'tag')::BIGINT AS n_tag, count(*) FILTER (type = 'external')::BIGINT AS n_external, (SELECT count(*) FROM ed)::BIGINT AS n_edges FROM nd",
    "graph_neighbors": f"WITH RECURSIVE {KEYS}, walk AS (SELECT unnest(['r1', 's2']) AS id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN adj ON a = id WHERE depth < 2) SELECT id, min(depth)::INT AS depth FROM walk WHERE id IN (SELECT id FROM nodes) GROUP BY id",
    "graph_subgraph": f"WITH RECURSIVE {KEYS}, walk AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN adj ON a = id WHERE depth < 2), near AS (SELECT id FROM walk GROUP BY id HAVING min(depth) < 2) SELECT DISTINCT from_id, to_id, type FROM edges WHERE from_id IN (SELECT id FROM near) OR to_id IN (SELECT id FROM near)",
    "graph_search": f"WITH {KEYS} SELECT id, title, type FROM nodes WHERE contains(lower(title), 'a') ORDER BY id LIMIT 10",
    "context_window": f"WITH {LINE_CHUNKS} SELECT h.file_id || '#' || h.i AS hit_id, c.file_id || '#' || c.i AS chunk_id, (c.i - h.i)::INT AS \"offset\" FROM lc h JOIN lc c ON c.file_id = h.file_id AND c.i BETWEEN h.i - 1 AND h.i + 1",
    "context_by_position": f"WITH {LINE_CHUNKS}, k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY i) AS p FROM lc) SELECT h.file_id || '#' || h.i AS hit_id, c.file_id || '#' || c.i AS chunk_id, (c.p - h.p)::INT AS \"offset\" FROM k h JOIN k c ON c.file_id = h.file_id AND c.p BETWEEN h.p - 1 AND h.p + 1",
    "drill_down": f"WITH {LINE_CHUNKS} SELECT h.file_id || '#' || h.i AS hit_id, string_agg(c.content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY c.i) AS context FROM lc h JOIN lc c ON c.file_id = h.file_id AND c.i BETWEEN h.i - 2 AND h.i + 2 GROUP BY h.file_id, h.i",
    "order_midpoints": "SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL AND b IS NULL THEN 1.0 WHEN a IS NULL THEN b / 2 WHEN b IS NULL THEN a + 1 ELSE (a + b) / 2 END::DOUBLE AS middle FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber::DOUBLE) OVER w AS a, lead(l_linenumber::DOUBLE) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))",
}
