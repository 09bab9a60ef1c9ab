"""Link graph over documents: extraction, building, traversal, search and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.functions import text as X

WIKI = r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|[^\]]+)?\]\]"
EMBED = r"!" + WIKI
TAG = r"(?:^|\s)#([\p{L}\p{N}_/-]+)"


#: A line that opens or closes a code block, with what ends the line before it.
FENCE = r"(?:^|\n)( *```[^\n]*)"


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, text, fenced): numbered from 1; fenced lines stand in a code block or open or close one.

    A text is cut at its fences, so that every second part is code; the work is linear in the text, and nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def numbered(x: Column) -> Column:
        parts, fences = x["parts"], x["fences"]

        def of_part(p: Column, k: Column) -> Column:
            # the first part begins with a line unless the text begins with a fence; the others with the end of their fence's line
            here = F.when(k == 0, F.when(x["opens"], F.array().cast("array<string>")).otherwise(F.split(p, "\n", -1)))
            here = here.otherwise(F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(p, r"^\n", ""), "\n", -1)))
            own = F.transform(here, lambda t: F.struct(t.alias("text"), (k % 2 == 1).alias("fenced")))
            return F.concat(own, F.when(k < F.size(fences), F.array(F.struct(F.get(fences, k).alias("text"), F.lit(True).alias("fenced")))).otherwise(F.array().cast("array<struct<text: string, fenced: boolean>>")))

        return F.flatten(F.transform(parts, of_part))

    # an array of one makes a name for the parts
    named = F.array(F.struct(F.split(text, FENCE, -1).alias("parts"), F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)).alias("fences"), text.rlike(r"^ *```").alias("opens")))
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(F.get(F.transform(named, numbered), F.lit(0))).alias("line", "x"))
    return rows.select("id", (F.col("line") + 1).alias("line"), "x.text", "x.fenced")


def with_md(target: Column) -> Column:
    return F.when(F.instr(F.substring_index(target, "/", -1), ".") > 0, target).otherwise(F.concat(target, F.lit(".md")))


def extract_links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, target, heading, type, line): embeds, wiki links outside embeds, and tags of lines outside code blocks."""
    rows = lines(df, id_col, text_col).filter(~F.col("fenced")).filter("instr(text, '[[') > 0 or instr(text, '#') > 0")
    bare = F.regexp_replace("text", EMBED, "")
    pairs = lambda text, pattern, kind: F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("h")),
        lambda x: F.struct(with_md(F.trim(x["t"])).alias("target"), F.when(F.coalesce(x["h"], F.lit("")) != "", F.trim(x["h"])).alias("heading"), F.lit(kind).alias("type")),
    )
    untagged = F.regexp_replace(bare, WIKI, "")
    tags = F.transform(F.regexp_extract_all(untagged, F.lit(TAG), F.lit(1)), lambda t: F.struct(t.alias("target"), F.lit(None).cast("string").alias("heading"), F.lit("tag").alias("type")))
    found = F.concat(pairs(F.col("text"), EMBED, "embed"), pairs(bare, WIKI, "wikilink"), tags)
    return rows.select("id", F.explode(found).alias("x"), "line").select("id", "x.target", "x.heading", "x.type", F.col("line").cast("int").alias("line"))


def headings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, level, title, line) of headings outside code blocks."""
    pattern = r"^(#{1,6})\s+(.+)"
    rows = lines(df, id_col, text_col).filter(~F.col("fenced") & F.col("text").rlike(pattern))
    return rows.select("id", F.length(F.regexp_extract("text", pattern, 1)).alias("level"), F.trim(F.regexp_extract("text", pattern, 2)).alias("title"), F.col("line").cast("int").alias("line"))


def filename_map(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(name, node): lower-case file names that only one file has."""
    named = files.select(F.lower(X.file_name(F.col(path_col))).alias("name"), X.node_id(F.col(path_col)).alias("node"))
    return named.groupBy("name").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1").select("name", "node")


def resolve(links: DataFrame, files: DataFrame, path_col: str = "path") -> DataFrame:
    """links with `node`: the file of that path, else the only one of that name, else null."""
    paths = files.select(X.node_id(F.col(path_col)).alias("exact")).distinct()
    names = filename_map(files, path_col).select("name", F.col("node").alias("by_name"))
    rows = links.withColumns({"_path": X.node_id(F.col("target")), "_name": F.lower(X.file_name(F.col("target")))})
    found = rows.join(paths, F.col("_path") == F.col("exact"), "left").join(names, F.col("_name") == F.col("name"), "left")
    return found.withColumn("node", F.when(F.col("type") != "tag", F.coalesce("exact", "by_name"))).drop("_path", "_name", "exact", "name", "by_name")


def parse(files: DataFrame, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the files' texts say, each by itself: titles (id, title), headings (id, title, line), links (id, target, type, line)."""
    docs = files.select(X.node_id(F.col(path_col)).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    titles = docs.select("id", X.extract_title(F.col("text"), F.col("path")).alias("title"))
    return titles, headings(docs, "id", "text").select("id", "title", "line"), extract_links(docs, "id", "text").select("id", "target", "type", "line")


def assemble(titles: DataFrame, heads: DataFrame, links: DataFrame, files: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """nodes (id, title, type) and edges (from_id, to_id, type, line_number) of what was parsed, with links resolved among files."""
    document = titles.select("id", "title", F.lit("document").alias("type"))
    heading = heads.select(F.concat("id", F.lit("#"), "title").alias("id"), "title", F.lit("heading").alias("type"))
    links = resolve(links, files, path_col)
    to = F.when(F.col("type") == "tag", F.concat(F.lit("#"), "target")).otherwise(F.coalesce("node", X.node_id(F.col("target"))))
    links = links.select("id", to.alias("to_id"), "type", "line", "target", F.col("node").isNotNull().alias("known"))
    tag = links.filter("type = 'tag'").select(F.col("to_id").alias("id"), F.col("target").alias("title"), F.lit("tag").alias("type"))
    external = links.filter("type <> 'tag' and not known").select(F.col("to_id").alias("id"), X.file_stem(F.col("to_id")).alias("title"), F.lit("external").alias("type"))
    nodes = document.unionByName(heading).unionByName(tag).unionByName(external).dropDuplicates(["id"])
    edges = links.groupBy(F.col("id").alias("from_id"), "to_id", "type").agg(F.max("line").alias("line_number"))
    contains = heads.groupBy(F.col("id").alias("from_id"), F.concat("id", F.lit("#"), "title").alias("to_id")).agg(F.max("line").alias("line_number")).withColumn("type", F.lit("heading"))
    return nodes, edges.unionByName(contains)


def build(files: DataFrame, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """nodes (id, title, type) and edges (from_id, to_id, type, line_number) of all files."""
    return assemble(*parse(files, path_col, text_col), files, path_col)


def adjacency(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(node, other) in both directions; two equi-joinable halves instead of an OR."""
    kept = edges.filter(F.col("type").isin(*types)) if types else edges
    return kept.select(F.col("from_id").alias("node"), F.col("to_id").alias("other")).union(kept.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"))).distinct()


def neighbors(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """(id, depth) of nodes within depth (1 to 3) of roots (id), undirected; each at its least depth."""
    near = adjacency(edges, types)
    reached = frontier = roots.select("id").distinct().withColumn("depth", F.lit(0))
    for d in range(1, min(max(depth, 1), 3) + 1):
        step = frontier.join(near, F.col("id") == F.col("node")).select(F.col("other").alias("id")).distinct()
        frontier = step.join(reached, "id", "left_anti").withColumn("depth", F.lit(d))
        reached = reached.unionByName(frontier)
    return reached.join(nodes.select("id"), "id", "left_semi")


def subgraph_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Edges met while expanding nodes short of the last depth, each once."""
    inner = reached.filter(F.col("depth") < depth).select("id")
    out = edges.join(inner, F.col("from_id") == F.col("id"), "left_semi").unionByName(edges.join(inner, F.col("to_id") == F.col("id"), "left_semi"))
    return out.dropDuplicates(["from_id", "to_id", "type"])


def search_nodes(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    return nodes.filter(F.contains(F.lower("title"), F.lit(query.lower()))).orderBy("id").limit(min(max(limit, 1), 50))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes by type, and edges."""
    n = lambda kind: F.count(F.when(F.col("type") == kind, 1)).alias(f"n_{kind}")
    counted = nodes.agg(F.count("*").alias("n_nodes"), n("document"), n("heading"), n("tag"), n("external"))
    return counted.join(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes but those of gone (id), and edges that touch none of them."""
    ids = gone.select("id").distinct()
    kept = edges.join(ids, F.col("from_id") == F.col("id"), "left_anti").join(ids, F.col("to_id") == F.col("id"), "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept


def replace_file_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after files (id) were read anew: their headings and outgoing edges go, what is new comes in their place."""
    ids = files.select("id").distinct()
    owner = lambda c: F.substring_index(c, "#", 1)
    stale = nodes.filter(F.col("type") == "heading").join(ids.withColumnRenamed("id", "own"), owner("id") == F.col("own"), "left_semi").select("id")
    kept_nodes = nodes.join(stale, "id", "left_anti").join(new_nodes.select("id"), "id", "left_anti")
    kept_edges = edges.join(ids, F.col("from_id") == F.col("id"), "left_anti")
    kept_edges = kept_edges.join(stale, F.col("from_id") == F.col("id"), "left_anti").join(stale, F.col("to_id") == F.col("id"), "left_anti")
    return kept_nodes.unionByName(new_nodes.select(*nodes.columns)), kept_edges.unionByName(new_edges.select(*edges.columns))


def title_score(title: Column, kind: Column, stem: Column, query: str) -> Column:
    """How well a node's title or its file's name meets the query."""
    q, t, s = F.lit(query.lower().strip()), F.lower(title), F.lower(stem)
    heading = kind == "heading"
    return F.when(~heading & ((t == q) | (s == q)), 1.0).when(heading & (t == q), 0.98).when(heading & F.contains(t, q), 0.92).when(F.contains(t, q) | F.contains(s, q), 0.95).otherwise(0.85)


def title_search(nodes: DataFrame, chunks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(path, chunk_id, score): files whose nodes' titles contain the query, each with its best chunk.

    chunks: (chunk_id, path, chunk_index, heading, content). Best: under the node's heading, else with the query, else the first.
    """
    hits = nodes.filter(F.contains(F.lower("title"), F.lit(query.lower()))).orderBy("id").limit(max(3 * k, 10))
    hits = hits.select(F.substring_index("id", "#", 1).alias("path"), "title", "type")
    scored = hits.withColumn("score", title_score(F.col("title"), F.col("type"), X.file_stem(F.col("path")), query))
    met = scored.join(chunks.select("path", "chunk_id", "chunk_index", "heading", "content"), "path")
    rank = F.when((F.col("type") == "heading") & F.contains(F.lower("heading"), F.lower("title")), 0).when(F.contains(F.lower("content"), F.lit(query.lower())), 1).otherwise(2)
    best = Window.partitionBy("path").orderBy(F.desc("score"), rank, "chunk_index", "title")
    return met.withColumn("r", F.row_number().over(best)).filter("r = 1").select("path", "chunk_id", "score").orderBy(F.desc("score"), F.lower("path")).limit(k)


def expand_results(results: DataFrame, edges: DataFrame, chunks: DataFrame, vectors: DataFrame, query: Column, depth: int = 1, most: int = 10) -> DataFrame:
    """(chunk_id, path, score) of files linked to results (path, score), each by its chunk nearest to the query vector.

    A neighbour without a positive similarity gets 0.6 of the least result score. Files already among the results are left out.
    """
    from fathom.functions import vectors as V

    near = adjacency(edges)
    frontier = results.groupBy("path").agg(F.max("score").alias("score")).select(F.col("path").alias("node"))
    seen = frontier
    for _ in range(min(max(depth, 1), 2)):
        step = frontier.join(near, "node").select(F.col("other").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti")
        seen = seen.unionByName(frontier)
    others = seen.join(results.select(F.col("path").alias("node")), "node", "left_anti").orderBy("node").limit(min(max(most, 1), 10))
    least = F.broadcast(results.agg(F.min("score").alias("least")))
    met = chunks.select("path", "chunk_id", "chunk_index").join(others.withColumnRenamed("node", "path"), "path").filter("chunk_index < 10").join(vectors, "chunk_id")
    scored = met.withColumn("sim", V.cosine(F.col("embedding"), query))
    best = scored.groupBy("path").agg(F.max_by("chunk_id", F.struct("sim", -F.col("chunk_index"))).alias("chunk_id"), F.max("sim").alias("sim"))
    return best.join(least).select("chunk_id", "path", F.when(F.col("sim") > 0, F.col("sim")).otherwise(0.6 * F.col("least")).alias("score"))
