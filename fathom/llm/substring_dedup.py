"""Substring dedup: repeated word windows by prefix-partitioned suffix trees.

A word (run of characters other than space and \\t \\n \\v \\f \\r) goes when a window of WINDOW words that covers it also
starts in a document with a smaller doc_id. All is judged on the input.

1. Documents with equal word sequences are one class: its later documents go whole, the first stands for it below.
2. Of the grams of PREFIXES[0] words inside a window the one with the least hash is the window's prefix: equal windows choose
   alike, so few suffixes of a document start with a chosen prefix. Windows that follow each other with the same prefix are one
   suffix, in pieces of PIECE windows, so that a text of one word repeated takes as much room as any other. Prefixes of one
   document are dropped. Where more than GROUP documents or GROUP * DENSE windows share a prefix, their windows take a longer one,
   of PREFIXES[1] words; so the length of prefixes varies, and groups fit in a task's memory. A group that is still too large
   takes whole windows as prefixes.
3. The suffixes left, with the words that their windows reach, are partitioned by prefix. A group is a subtree in one task: its
   suffixes are sorted by prefix doubling, and the common prefixes of neighbours give its internal nodes. Nodes of depth WINDOW
   are the repeats, and the least doc_id below a node decides. A group with whole windows as its prefix is such a node
   itself: its least doc_id is a partial minimum, and it is never gathered in a task.

Hashes of words are 64 bits wide. Null texts have no words. A null doc_id is smaller than none and has none smaller. Rows
that repeat a doc_id do not remove words of each other. Documents of less than WINDOW words stay as they are. Columns other
than doc_id and text are not looked at. Without documents the result is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from fathom.llm.batches import map_rows
from fathom.llm.storage import by_ids, save, small_join
from fathom.llm.word_hash import Grams, WordHashes

WINDOW, PREFIXES, GROUP = 50, (25, 40), 1000
#: Windows of a group for each of its GROUP documents, and windows of a suffix row.
DENSE, PIECE = 64, 4096
#: Words of suffix rows that are sorted at once, but for larger groups.
SORTED = 120_000
SIGN = 1 << 63


def signed(x: int) -> int:
    return x - (1 << 64) if x >= SIGN else x


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window its chosen n-gram: the place of the least hash among `span` that follow each other, the first of equal ones."""
    if len(grams) < span:
        return np.empty(0, dtype=np.int64)
    out = np.empty(len(grams) - span + 1, dtype=np.int64)
    for at in range(0, len(out), 65_536):
        part = np.lib.stride_tricks.sliding_window_view(grams[at : at + 65_536 + span - 1], span)
        out[at : at + len(part)] = at + np.arange(len(part)) + part.argmin(axis=1)
    return out


def census(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """Each row's key (doc_id, th), n_words, digest of its words, and the hashes of its chosen prefixes with the number of windows that chose each."""

    def make():
        hashes, grams = WordHashes(), Grams()

        def step(cols):
            out = {"doc_id": cols["doc_id"], "th": cols["th"], "n_words": [], "sha": [], "prefixes": [], "counts": []}
            for text in cols["text"]:
                words = (text or "").encode().split()
                out["n_words"].append(len(words))
                out["sha"].append(hashlib.sha256(b" ".join(words)).hexdigest())
                g = grams.of(hashes.of(words), prefix) if len(words) >= window else np.empty(0, dtype=np.uint64)
                found, counts = np.unique(g[anchors(g, window - prefix + 1)], return_counts=True)
                out["prefixes"].append(found.view(np.int64))
                out["counts"].append(counts.astype(np.int32))
            return out

        return step

    return map_rows(docs, make, "doc_id long, th long, n_words long, sha string, prefixes array<long>, counts array<int>")


def runs(chosen: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of windows that follow each other with equal chosen grams, in pieces of PIECE windows."""
    firsts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else chosen
    whole = zip(firsts.tolist(), [*firsts[1:].tolist(), len(chosen)], strict=True) if len(chosen) else ()
    return [(a, min(a + PIECE, end)) for first, end in whole for a in range(first, end, PIECE)]


def suffixes(docs: DataFrame, window: int, prefixes: tuple[int, int]) -> DataFrame:
    """Suffixes at shared prefixes; docs: (doc_id, th, text, prefixes, hot). A row: prefix, longer (whether it is of the second length), doc_id, th, first (start of its first window) and words (hashes, which its windows reach)."""

    def make():
        hashes, grams = WordHashes(), Grams()

        def step(cols):
            out = {k: [] for k in ("prefix", "longer", "doc_id", "th", "first", "words")}

            def add(*row):
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)

            for doc, th, text, wanted, hot in zip(*(cols[c] for c in ("doc_id", "th", "text", "prefixes", "hot")), strict=True):
                h = hashes.of((text or "").encode().split())
                g, g2 = grams.of(h, prefixes[0]), None
                at = anchors(g, window - prefixes[0] + 1)
                shared = dict(zip(wanted, hot, strict=True))
                for first, end in runs(g[at]):
                    key = signed(int(g[at[first]]))
                    if key not in shared:
                        continue
                    if not shared[key]:
                        add(key, False, doc, th, first, h[first : end - 1 + window].view(np.int64))
                        continue
                    if g2 is None:
                        g2 = grams.of(h, prefixes[1])
                        at2 = anchors(g2, window - prefixes[1] + 1)
                    for a, b in runs(g2[at2[first:end]]):
                        add(signed(int(g2[at2[first + a]])), True, doc, th, first + a, h[first + a : first + b - 1 + window].view(np.int64))
            return out

        return step

    return map_rows(docs, make, "prefix long, longer boolean, doc_id long, th long, first int, words array<long>")


class SuffixTree:
    """Suffixes of several word sequences as a sorted array with the common prefixes of neighbours, up to twice `depth` words or a little less."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, depth: int):
        # a terminator of its own behind each sequence: no common prefix goes past an end
        ends = np.cumsum(sizes)
        ranks = np.unique(flat, return_inverse=True)[1].astype(np.int64)
        most = int(ranks.max()) + 1 if len(ranks) else 0
        rank = np.insert(ranks, ends, most + np.arange(len(sizes)))
        self.ranks = [rank]
        step = 1
        while step < depth:
            after = np.zeros_like(rank)
            after[: max(0, len(rank) - step)] = rank[step:] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1].astype(np.int64)
            self.ranks.append(rank)
            step *= 2

    def nodes(self, places: np.ndarray, depth: int) -> np.ndarray:
        """For the suffixes at `places` (with terminators counted) the node of that depth above each."""
        order = np.argsort(self.ranks[-1][places], kind="stable")
        a, b = places[order][:-1], places[order][1:]
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            x, y = np.minimum(a + common, len(rank) - 1), np.minimum(b + common, len(rank) - 1)
            common += np.where(rank[x] == rank[y], 1 << k, 0)
        node = np.empty(len(places), dtype=np.int64)
        node[order] = np.concatenate([[0], np.cumsum(common < depth)]) if len(places) else order
        return node


def subtree(doc: np.ndarray, sizes: np.ndarray, flat: np.ndarray, window: int) -> np.ndarray:
    """Which windows of sequences (their sizes, and words one after the other; the document of each) share a deep node with a smaller document."""
    counts = sizes - window + 1
    row = np.repeat(np.arange(len(sizes)), counts)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    places = begin[row] + np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    node = SuffixTree(flat, sizes, window).nodes(places, window)
    least = np.full(int(node.max()) + 1 if len(node) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc[row])
    return least[node] < doc[row]


def intervals(doc_ids, ths, firsts, counts, covered, window: int) -> dict:
    """Spans of words under covered windows: rows (doc_id, th, start, end), from suffixes with `counts` windows each."""
    out: dict[str, list] = {"doc_id": [], "th": [], "start": [], "end": []}
    at = 0
    for doc, th, first, n in zip(doc_ids, ths, firsts, counts, strict=True):
        held = np.flatnonzero(covered[at : at + n])
        at += n
        if len(held):
            cuts = np.flatnonzero(np.diff(held) > window)
            for a, b in zip(np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(held) - 1]]), strict=True):
                for name, v in zip(out, (doc, th, int(first + held[a]), int(first + held[b] + window)), strict=True):
                    out[name].append(v)
    return out


SPAN = "doc_id long, th long, start int, end int"


def by_subtrees(rows: DataFrame, window: int) -> DataFrame:
    """Spans to remove from groups of suffixes that a task holds; Spark partitions and sorts them by prefix."""

    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        held = None

        def solve(table):
            words = table.column("words").combine_chunks()
            sizes = np.diff(words.offsets.to_numpy())
            flat = words.flatten().to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            doc = table.column("doc_id").to_numpy()
            key = table.column("prefix").to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            covered, first = [], 0
            # as many whole groups at once as keep the tree small; equal windows never differ in prefix
            while first < len(bounds) - 1:
                last = min(max(first + 1, int(np.searchsorted(begin[bounds], begin[bounds[first]] + SORTED))), len(bounds) - 1)
                a, b = bounds[first], bounds[last]
                covered.append(subtree(doc[a:b], sizes[a:b], flat[begin[a] : begin[b]], window))
                first = last
            made = intervals(doc.tolist(), table.column("th").to_pylist(), table.column("first").to_pylist(), (sizes - window + 1).tolist(), np.concatenate(covered), window)
            return pa.RecordBatch.from_pydict(made, schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            key = table.column("prefix").to_numpy()
            if not len(key):
                continue
            whole = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            held = table.slice(whole)
            if whole:
                yield solve(table.slice(0, whole))
        if held is not None and held.num_rows:
            yield solve(held)

    return rows.repartition(F.col("prefix")).sortWithinPartitions("prefix").mapInArrow(run, SPAN)


def window_hashes(words: list[int], window: int, grams: Grams) -> np.ndarray:
    return grams.of(np.array(words, dtype=np.int64).view(np.uint64), window).view(np.int64)


def by_whole_windows(rows: DataFrame, window: int) -> DataFrame:
    """Spans to remove from large groups, whose prefixes are lengthened to whole windows: least doc_id by partial aggregation."""

    def explode():
        grams = Grams()

        def step(cols):
            least: dict[int, tuple[int, int]] = {}
            for doc, words in zip(cols["doc_id"], cols["words"], strict=True):
                for w in window_hashes(words, window, grams).tolist():
                    a, b = least.get(w, (doc, doc))
                    least[w] = min(a, doc), max(b, doc)
            return {"w": list(least), "least": [a for a, _ in least.values()], "most": [b for _, b in least.values()]}

        return step

    nodes = map_rows(rows.select("doc_id", "words"), explode, "w long, least long, most long")
    nodes = save(nodes.groupBy("w").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most").select("w", "least"), "deep-nodes")
    def places():
        grams = Grams()

        def step(cols):
            out = {k: [] for k in ("doc_id", "th", "start", "w")}
            for doc, th, first, words in zip(*(cols[c] for c in ("doc_id", "th", "first", "words")), strict=True):
                found = window_hashes(words, window, grams).tolist()
                out["doc_id"] += [doc] * len(found)
                out["th"] += [th] * len(found)
                out["start"] += range(first, first + len(found))
                out["w"] += found
            return out

        return step

    every = save(map_rows(rows, places, "doc_id long, th long, start int, w long"), "windows")
    return every.join(nodes, "w").filter("least < doc_id").select("doc_id", "th", "start", (F.col("start") + window).alias("end"))


def repeats(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, int] = PREFIXES, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """For rows (doc_id, text): the table (doc_id, th, n_words, sha) of all, and (doc_id, th, spans) of those with words to remove."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    table = save(census(rows, window, prefixes[0]), "census")
    able = table.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    first = save(able.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("sha", "first"), "classes")
    copies = save(able.join(first, "sha").filter("doc_id > first").select("doc_id", "th", "n_words"), "copies")
    whole = copies.select("doc_id", "th", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))
    ones = by_ids(able, copies, ["doc_id", "th"], "left_anti").select("doc_id", "th", F.explode(F.arrays_zip("prefixes", "counts")).alias("x"))
    ones = ones.select("doc_id", "th", F.col("x.prefixes").alias("prefix"), F.col("x.counts").alias("windows"))
    hot = (F.col("n") > group) | (F.col("windows") > group * DENSE)
    sized = lambda df: df.groupBy("prefix").agg(F.count("*").alias("n"), F.sum("windows").alias("windows"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("prefix", hot.alias("hot"))
    shared = small_join(ones, save(sized(ones), "prefixes"), "prefix").groupBy("doc_id", "th").agg(F.collect_list(F.struct("prefix", "hot")).alias("p"))
    shared = save(shared.select("doc_id", "th", F.col("p.prefix").alias("prefixes"), F.col("p.hot").alias("hot")), "holders")
    held = by_ids(rows, shared, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).join(shared, ["doc_id", "th"])
    tails = save(suffixes(held.select("doc_id", "th", "text", "prefixes", "hot"), window, prefixes), "suffixes")
    longer = tails.filter("longer")
    longer = save(small_join(longer, save(sized(longer.withColumn("windows", F.size("words") - window + 1)), "longer-prefixes"), "prefix"), "longer")
    columns = ("prefix", "doc_id", "th", "first", "words")
    fit = tails.filter("not longer").select(*columns).unionByName(longer.filter("not hot").select(*columns))
    found = by_subtrees(fit, window).unionByName(by_whole_windows(longer.filter("hot"), window)).unionByName(whole)
    spans = found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return table, save(spans, "spans")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping and touching spans of a sorted list as one."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def dedup(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, n_words, n_removed, kept, sha): kept is null where nothing goes, else the words left, joined by a space."""
    table, spans = repeats(docs, window, **options)
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")

    def make():
        def step(cols):
            removed, kept = [], []
            for text, found in zip(cols["text"], cols["spans"], strict=True):
                words = (text or "").encode().split()
                gone = merged([(s["start"], s["end"]) for s in found])
                removed.append(sum(b - a for a, b in gone))
                for a, b in reversed(gone):
                    del words[a:b]
                kept.append(b" ".join(words).decode())
            return {"doc_id": cols["doc_id"], "th": cols["th"], "n_removed": removed, "kept": kept}

        return step

    touched = by_ids(rows, spans, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).join(spans, ["doc_id", "th"])
    changed = save(map_rows(touched, make, "doc_id long, th long, n_removed long, kept string"), "kept")
    return table.join(changed, ["doc_id", "th"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "kept", "sha")


def digest(kept: DataFrame) -> DataFrame:
    """The columns of query op4."""
    return kept.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept", 256), F.col("sha")).alias("kept_sha256"))
