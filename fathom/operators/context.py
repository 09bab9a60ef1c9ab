"""Context for answers: result lists to one text, prompts, and lists of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.functions import text as X
from fathom.functions.fixed_values import PROMPT, SUGGESTIONS
from fathom.operators import fusion


def build_context(results: DataFrame, budget: int = 3000) -> DataFrame:
    """One row (context, n, tokens) of a result list (rank, title, heading, path, content): as many hits from the first as the token budget allows."""
    head = F.concat(F.lit("### "), F.coalesce("title", X.file_stem(F.col("path"))))
    section = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit("**"), "heading", F.lit("**")))
    block = F.concat_ws("\n\n", head, section, F.col("content"), F.concat(F.lit("[["), F.col("path"), F.lit("]]")))
    rows = results.withColumn("block", block).withColumn("tokens", X.estimate_tokens(F.col("content")))
    kept = fusion.token_budget(rows, budget, F.col("rank"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "block")))
    return kept.agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n---\n\n").alias("context"), F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))


def prompt(context: DataFrame, query: str, template: str = PROMPT) -> DataFrame:
    """One row (prompt): the fixed text around the context and the question."""
    before, after = template.split("{context}")
    return context.select(F.concat(F.lit(before), "context", F.lit(after.replace("{query}", query))).alias("prompt"))


def projected(results: DataFrame) -> DataFrame:
    """A result list as it is handed out: scores of a leg that are not over 0 are null, and each hit has the link to its lines.

    results: path, start_line, end_line, and any of bm25, emb and further columns, which stay.
    """
    over = {c: F.when(F.col(c) > 0, F.col(c)) for c in ("bm25", "emb") if c in results.columns}
    # the link names both lines, also where they are one
    link = F.concat(F.lit("[["), X.file_stem(F.col("path")), F.lit("#L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"), F.lit("]]"))
    return results.withColumns(over | {"link": link})


def references(results: DataFrame, chars: int = 50) -> DataFrame:
    """(path, n, best, preview): a result list by file, with a preview of its best hit."""
    return results.groupBy("path").agg(F.count("*").alias("n"), F.min("rank").alias("best"), X.preview(F.min_by("content", "rank"), chars).alias("preview"))


def expand_context(hits: DataFrame, chunks: DataFrame, window: int = 1, merge: str = "smart", separator: str = "\n\n---\n\n") -> DataFrame:
    """(hit_id, context, n_before, n_after): a hit with its neighbours.

    merge: smart, with a heading line where the section changes and the hit marked; concatenate, contents with an empty line between;
    or separator, contents with `separator` between.
    """
    from fathom.operators.chunking import adjacent

    if merge not in ("smart", "concatenate", "separator"):
        raise ValueError(f"merge has to be smart, concatenate or separator, not {merge}")

    rows = adjacent(chunks, hits, window).join(chunks.select("chunk_id", "heading", "content"), "chunk_id")
    before = F.lag("heading").over(Window.partitionBy("hit_id").orderBy("offset"))
    changed = F.col("heading").isNotNull() & (F.col("heading") != "") & ~F.col("heading").eqNullSafe(before)
    marked = F.concat(F.when(F.col("offset") == 0, "**[HIT]** ").otherwise(""), "content")
    piece = F.concat_ws("\n", F.when(changed, F.concat(F.lit("### "), "heading")), marked) if merge == "smart" else F.coalesce("content", F.lit(""))
    rows = rows.withColumn("piece", piece)
    ordered = F.sort_array(F.collect_list(F.struct("offset", "piece")))
    return rows.groupBy("hit_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["piece"]), separator if merge == "separator" else "\n\n").alias("context"),
        F.count(F.when(F.col("offset") < 0, 1)).alias("n_before"),
        F.count(F.when(F.col("offset") > 0, 1)).alias("n_after"),
    )


def hit_block(path: Column, heading: Column, pieces: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """A source line, a section line if there is one, and the pieces (hit, content) below: the hit marked as a quotation.

    With start and end, the block of a hit without neighbours: its lines are named, and nothing is marked.
    """
    lines = F.lit("") if start is None else F.concat(F.lit(" (L"), start.cast("string"), F.lit("-L"), end.cast("string"), F.lit(")"))
    head = F.concat(F.lit("📍 **来源**: "), path, lines)
    section = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("📑 **章节**: "), heading))
    top = F.concat_ws("\n", head, section)
    if start is not None:
        return F.concat(top, F.lit("\n\n"), F.array_join(F.transform(pieces, lambda x: x["content"]), "\n\n"), F.lit("\n"))
    marked = F.transform(pieces, lambda x: F.concat(F.when(x["hit"], "> ").otherwise(""), x["content"], F.lit("\n\n")))
    return F.concat(top, F.lit("\n\n---\n\n"), F.array_join(marked, ""))


def budget_with_tail(results: DataFrame, budget: int, least: int = 100) -> DataFrame:
    """Rows (rank, content) of a result list that fit the budget; the first that doesn't is cut to whole sentences if over `least` tokens are left. A result list is a top-k, so one window orders it."""
    order = Window.orderBy("rank")
    rows = results.withColumn("tokens", X.count_tokens(F.col("content"))).withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("over", F.sum((F.col("used") > budget).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    room = F.lit(budget) - (F.col("used") - F.col("tokens"))
    kept = rows.filter((F.col("over") == 0) | ((F.col("over") == 1) & (F.col("used") > budget) & (room > least)))
    return kept.select("rank", F.when(F.col("over") == 0, F.col("content")).otherwise(X.truncate_by_sentences(F.col("content"), room, X.count_tokens)).alias("content"), "tokens")


def suggestion(n: Column, k: int, tokens: Column) -> Column:
    """(has_more, message) of an answer with n results for k asked: more there, none, or few tokens."""
    more = n >= k
    message = F.when(more, SUGGESTIONS["more"]).when(n == 0, SUGGESTIONS["none"]).when(tokens < 500, SUGGESTIONS["few"])
    return F.struct(more.alias("has_more"), message.alias("message"))


def chunk_links(results: DataFrame) -> DataFrame:
    """(rank, link, section_link, preview) of results (rank, path, start_line, end_line, heading, content)."""
    section = F.when(F.coalesce("heading", F.lit("")) != "", X.section_link(F.col("path"), F.col("heading")))
    return results.select("rank", X.line_link(F.col("path"), F.col("start_line"), F.col("end_line")).alias("link"), section.alias("section_link"), X.preview(F.col("content"), 50).alias("preview"))


def reference_list(results: DataFrame) -> DataFrame:
    """One row (references): results by file, in the order of their first hits, a link and a preview each. For result lists, which are a top-k."""
    links = chunk_links(results).join(results.select("rank", "path"), "rank")
    line = F.concat(F.lit("- "), "link", F.lit(": "), "preview")
    files = links.groupBy("path").agg(F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    block = F.concat(F.lit("### "), X.file_stem(F.col("path")), F.lit("\n"), F.array_join(F.transform("x", lambda e: e["line"]), "\n"), F.lit("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("first", block.alias("block"))))
    return files.agg(F.concat(F.lit("## 相关引用\n\n"), F.array_join(F.transform(ordered, lambda e: e["block"]), "\n")).alias("references"))


def embed_block(results: DataFrame, query: str, mode: str, tag: str = "search") -> DataFrame:
    """One row (block): a fenced head with query, mode and number of results, then a quotation of 200 characters for each. For result lists."""
    links = chunk_links(results).join(results.select("rank", "content"), "rank")
    quote = F.concat(F.lit("> [!quote] "), "link", F.lit("\n> "), F.substring("content", 1, 200), F.lit("...\n"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", quote.alias("quote"))))
    made = links.agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda e: e["quote"]), "\n").alias("quotes"))
    return made.select(F.concat(F.lit(f"```{tag}\nquery: {query}\nmode: {mode}\nresults: "), F.col("n").cast("string"), F.lit("\n```\n\n"), "quotes").alias("block"))
