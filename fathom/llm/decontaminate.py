"""Benchmark decontamination: one suffix automaton of all items, along which the words of every document run.

Words are runs of [0-9a-z] and non-ASCII characters after A-Z is lower-cased. A window is WINDOW consecutive words of an
item; an item of fewer words, but not none, is one window. Following a document's words, the automaton holds the longest
suffix that occurs in some item; where that reaches a window, its words are hit, and the items that have it are known
from the state. Only item texts are held in memory: items are dealt by hash into shards of at most SHARD_CHARS
characters (more only if a single item is), each shard is one broadcast automaton and one pass over the documents.

Null texts have no words; items without words are never found, nor are items with a null item_id, which have no name to
report. Repeated items count once by item_id. Repeated documents get a result each. Without items nothing is hit; without
documents the result is empty. Columns other than those named come back from `clean` as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from fathom.llm.batches import map_rows
from fathom.llm.storage import save, with_marks

WINDOW, SHARD_CHARS = 10, 1_000_000
#: In the pipeline: hit spans of at least this many words are cut; a document with this share of hit words goes whole.
CUT_WORDS, DROP_SHARE = 10, 0.8
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


class Automaton:
    """Suffix automaton of word sequences, with the items of each state that stands for a window."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [0], [0]
        found = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]) for name, text in items]
        for _, ids in found:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for name, ids in found:
            state = 0
            for n, w in enumerate(ids, 1):
                state = self.next[state][w]
                if n >= window:
                    self.full.setdefault(self._at(state, window), set()).add(name)
            if 0 < len(ids) < window:
                self.short.setdefault(self._at(state, len(ids)), (len(ids), set()))[1].add(name)

    def _at(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _clone(self, p: int, w: int, q: int) -> int:
        made = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = made
        while self.next[p].get(w) == q:
            self.next[p][w] = made
            if p == 0:
                break
            p = self.link[p]
        return made

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        made = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while w not in self.next[p]:
            self.next[p][w] = made
            if p == 0:
                return made
            p = self.link[p]
        q = self.next[p][w]
        self.link[made] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return made

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words (end exclusive), and the items with a window in them."""
        following, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        spans: list[list[int]] = []
        items: set[str] = set()
        state = matched = 0
        for end, w in enumerate(map(self.vocabulary.get, words), 1):
            if w is None:
                state = matched = 0
                continue
            while state and w not in following[state]:
                state = link[state]
                matched = length[state]
            if w not in following[state]:
                continue
            state = following[state][w]
            matched += 1
            reach = 0
            if matched >= window:
                reach = window
                items |= self.full[self._at(state, window)]
            if short:
                s = state
                while s:
                    if s in short and short[s][0] <= matched:
                        items |= short[s][1]
                        reach = max(reach, short[s][0])
                    s = link[s]
            if reach:
                if spans and end - reach <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], end - reach)
                    spans[-1][1] = end
                    while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                        last = spans.pop()
                        spans[-1][1] = last[1]
                else:
                    spans.append([end - reach, end])
        return [(a, b) for a, b in spans], items


def shards(items: DataFrame, shard_chars: int = SHARD_CHARS) -> list[list[tuple[str, str]]]:
    """The items in shards that are small enough to broadcast, each fetched when its turn comes."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // shard_chars))
    for k in range(n):
        yield [(r["item"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator()]


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, th (hash of the text), n_words, spans of words, items (sorted)."""
    made = None
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    for shard in shards(items, shard_chars):
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton(shard, window))

        def make(automaton=automaton):
            def step(cols):
                out = {"doc_id": cols["doc_id"], "th": cols["th"], "n_words": [], "spans": [], "items": []}
                for text in cols["text"]:
                    words = words_of(text)
                    spans, names = automaton.value.hits(words)
                    out["n_words"].append(len(words))
                    out["spans"].append([{"start": a, "end": b} for a, b in spans])
                    out["items"].append(sorted(names))
                return out

            return step

        one = map_rows(rows, make, "doc_id long, th long, n_words long, spans array<struct<start:int,end:int>>, items array<string>")
        made = one if made is None else merged(save(made, "hits"), one.filter("size(items) > 0"))
    return made


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """The hits of one more shard, which are the same for all copies of a text."""
    right = save(right.dropDuplicates(["th"]).select("th", F.col("spans").alias("s2"), F.col("items").alias("i2")), "hits")
    spans = F.sort_array(F.concat("spans", F.coalesce("s2", F.array().cast("array<struct<start:int,end:int>>"))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = F.aggregate(
        spans,
        none,
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] <= F.element_at(a, -1)["end"]),
            F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(s))),
    )
    items = F.sort_array(F.array_union("items", F.coalesce("i2", F.array().cast("array<string>"))))
    return left.join(right, "th", "left").select("doc_id", "th", "n_words", F.when(F.col("s2").isNull(), F.col("spans")).otherwise(joined).alias("spans"), items.alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op7."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without what lies from the first to the last word of each span."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_KEEP))] if spans else []
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, cut_words: int = CUT_WORDS, drop_share: float = DROP_SHARE) -> DataFrame:
    """docs with hit spans of at least cut_words words cut out of text (and n_chars set), without those that are mostly hit.

    All columns come back; a document without such spans comes back as it was.
    """
    found = hits(docs, items, window)
    marked = found.filter("size(items) > 0").dropDuplicates(["th"])
    marked = save(marked.select(F.col("th").alias("_th"), F.col("n_words").alias("_n"), F.col("spans").alias("_spans")), "contaminated")
    # the caller's columns are held in one, so that their names don't matter
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    rows = with_marks(rows, marked, ["_th"], "_th")
    share = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]) / F.col("_n")
    rows = rows.filter(F.col("_n").isNull() | (share < drop_share))

    @F.pandas_udf("string")
    def without(text, spans):
        import pandas as pd

        return pd.Series([t if s is None else cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype="object")

    long = F.filter("_spans", lambda s: s["end"] - s["start"] >= cut_words)
    touched = F.col("_spans").isNotNull() & (F.size(long) > 0)
    new = rows.select("row", touched.alias("_cut"), F.when(touched, without(F.when(touched, F.col("row.text")), F.when(touched, long))).otherwise(F.col("row.text")).alias("_new"))
    row = F.col("row").withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("_cut"), F.length("_new").cast("long")).otherwise(F.col("row.n_chars")))
    return new.select(row.alias("row")).select("row.*")
