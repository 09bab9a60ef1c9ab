"""Markdown chunks: sections by heading, packed paragraphs with overlap, and windows over them."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.functions import text as X, vectors as V

HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
SENTENCE = re.compile(r'[^。！？.!?]*[。！？.!?]["」]?|[^。！？.!?]+$')
CJK = re.compile("[一-鿿]")
SCHEMA = "file_id string, chunk_index int, content string, token_count int, start_line int, end_line int, heading string, level int, type string, weight double"


LETTERS, DIGITS = string.ascii_letters.encode(), string.digits.encode()


def count_tokens(text: str) -> int:
    raw = text.encode()
    cjk = 0 if len(raw) == len(text) else len(CJK.findall(text))
    letters = len(raw) - len(raw.translate(None, LETTERS))
    digits = len(raw) - len(raw.translate(None, DIGITS))
    return int(cjk / 1.5) + letters // 4 + digits // 3 + (len(text) - cjk - letters - digits) // 2


def sections(lines: list[str]):
    """(first line, lines, path leaf to root, level): a heading opens a section and closes those at its level or below."""
    stack: list[tuple[int, str]] = []
    start, held = 1, []
    for n, line in enumerate(lines, 1):
        m = HEADING.match(line)
        if m:
            if held:
                yield start, held, "/".join(t for _, t in reversed(stack)), stack[-1][0] if stack else 0
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, m[2].strip()))
            start, held = n, []
        held.append(line)
    if held:
        yield start, held, "/".join(t for _, t in reversed(stack)), stack[-1][0] if stack else 0


def paragraphs(start: int, lines: list[str]):
    """(first line, last line, text) of runs between blank lines."""
    first, held = start, []
    for n, line in enumerate([*lines, ""], start):
        if line.strip():
            first = first if held else n
            held.append(line)
        elif held:
            yield first, n - 1, "\n".join(held)
            held = []


def sentence_pieces(start: int, end: int, text: str, most: int):
    """A long paragraph packed by sentences, whose tokens are counted each; all but the last piece carry the first line only."""
    held, used = [], 0
    for s in SENTENCE.findall(text):
        size = count_tokens(s)
        if held and used + size > most:
            yield start, start, "".join(held)
            held, used = [], 0
        held.append(s)
        used += size
    if held:
        yield start, end, "".join(held)


def pack(parts: list[tuple[int, int, str]], most: int, overlap: int):
    """Paragraphs packed up to `most` tokens; a new chunk repeats the last ones up to `overlap` tokens, one at least."""
    held: list[tuple[int, int, str]] = []
    sizes: list[int] = []  # of what is held
    for part in parts:
        size = count_tokens(part[2])
        if size > most:
            if held:
                yield held, "Paragraph"
                held, sizes = [], []
            for piece in sentence_pieces(*part, most):
                yield [piece], "Forced"
            continue
        if held and sum(sizes) + size > most:
            yield held, "Paragraph"
            n, carried = 1, sizes[-1]
            while n < len(held) and carried + sizes[-n - 1] <= overlap:
                n, carried = n + 1, carried + sizes[-n - 1]
            held, sizes = held[-n:], sizes[-n:]
        held.append(part)
        sizes.append(size)
    if held:
        yield held, "Paragraph"


def chunk_text(text: str | None, most: int = 512, overlap: int = 50) -> list[dict]:
    """Chunks of one text, in order; none of an empty one."""
    out: list[dict] = []
    if not text:
        return out

    def add(content, start, end, heading, level, kind):
        weight = {1: 1.5, 2: 1.3, 3: 1.1}.get(level, 1.0) * (1.2 if len(content) < 200 else 1.0)
        out.append({"chunk_index": len(out), "content": content, "token_count": count_tokens(content), "start_line": start, "end_line": end, "heading": heading, "level": level, "type": kind, "weight": weight})

    for start, lines, heading, level in sections(text.split("\n")):
        whole = "\n".join(lines)
        if count_tokens(whole) <= most:
            add(whole, start, start + len(lines) - 1, heading, level, "Section")
            continue
        for held, kind in pack(list(paragraphs(start, lines)), most, overlap):
            add("\n\n".join(p[2] for p in held), held[0][0], held[-1][1], heading, level, kind)
    return out


def chunk_markdown(docs: DataFrame, id_col: str, text_col: str, most: int = 512, overlap: int = 50) -> DataFrame:
    """Chunk rows of every document, with ids derived from file and place; documents are independent, so nothing is shuffled."""

    def run(batches):
        import pandas as pd

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for pdf in batches:
            rows = [{"file_id": i} | c for i, t in zip(pdf["id"], pdf["text"], strict=True) for c in chunk_text(t, most, overlap)]
            yield pd.DataFrame(rows, columns=names)

    made = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)
    return made.withColumn("chunk_id", F.sha2(F.concat("file_id", F.lit("#"), F.col("chunk_index").cast("string")), 256))


def character_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each `overlap` into the one before."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size - overlap))
    cut = lambda c: F.transform(starts, lambda i: F.array_join(F.slice(c, i, F.lit(size)), ""))
    # an array of one makes a name for the characters
    return F.when(F.length(text) > 0, F.get(F.transform(F.array(X.characters(text)), cut), F.lit(0))).otherwise(F.array().cast("array<string>"))


def adjacent(chunks: DataFrame, hits: DataFrame, window: int = 2) -> DataFrame:
    """(hit_id, chunk_id, offset): chunks of the hit's file within `window` places, by an equi-join on the places."""
    places = hits.join(chunks.select(F.col("chunk_id").alias("hit_id"), "file_id", "chunk_index"), "hit_id")
    places = places.select("hit_id", "file_id", F.col("chunk_index").alias("at"), F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    return places.join(chunks.select("chunk_id", "file_id", "chunk_index"), ["file_id", "chunk_index"]).select("hit_id", "chunk_id", (F.col("chunk_index") - F.col("at")).alias("offset"))


def adjacent_by_position(chunks: DataFrame, hits: DataFrame, window: int = 2) -> DataFrame:
    """The same by position among the file's chunks, whatever gaps their indexes have."""
    placed = chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("file_id").orderBy("chunk_index")))
    return adjacent(placed, hits, window)


def drill_down(chunks: DataFrame, hits: DataFrame, window: int = 2) -> DataFrame:
    """(hit_id, context): contents of the window, in order."""
    rows = adjacent(chunks, hits, window).join(chunks.select("chunk_id", "content"), "chunk_id")
    return rows.groupBy("hit_id").agg(F.sort_array(F.collect_list(F.struct("offset", "content"))).alias("x")).select("hit_id", F.array_join(F.transform("x", lambda c: c["content"]), "\n\n---\n\n").alias("context"))


def in_lines(start: Column, end: Column, first: int = 0, last: int = 0) -> Column:
    """Whether lines overlap first..last, where 0 is open."""
    return (F.lit(last == 0) | (start <= last)) & (F.lit(first == 0) | (end >= first))


def outline(chunks: DataFrame) -> DataFrame:
    """(file_id, n_chunks, last_line, sections in order)."""
    sections_of = F.transform(F.sort_array(F.collect_set(F.struct("start_line", "heading"))), lambda s: s["heading"])
    return chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.max("end_line").alias("last_line"), sections_of.alias("sections"))


def midpoint(before: Column, after: Column) -> Column:
    """An order value between two neighbours, either of which may be missing."""
    return F.when(before.isNull() & after.isNull(), 1.0).when(before.isNull(), after / 2).when(after.isNull(), before + 1.0).otherwise((before + after) / 2)


def needs_rebalance(chunks: DataFrame) -> DataFrame:
    """(file_id, needs): whether two neighbours' orders are next to equal."""
    gap = F.col("chunk_order") - F.lag("chunk_order").over(Window.partitionBy("file_id").orderBy("chunk_order"))
    return chunks.withColumn("gap", gap).groupBy("file_id").agg(F.coalesce(F.min("gap") < V.TINY, F.lit(False)).alias("needs"))


def rebalance(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_order", F.row_number().over(Window.partitionBy("file_id").orderBy("chunk_order", "chunk_id")).cast("double"))
