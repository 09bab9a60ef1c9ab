"""Toxicity: windows compressed under a toxic and an ordinary zstandard dictionary.

A window is one word (letters, digits, _; lower case) between spaces, with a fixed head and tail that both dictionaries
end with; without these the frame's overhead, and the last bytes that zstandard doesn't search, would hide what a short
word saves. What counts are the bytes that a window takes less under the toxic dictionary than under the ordinary one: all
windows of a whole text are compressed under both, each distinct word once. The numbers of windows that save at least 1, 2, ... SAVED bytes,
and of all, give the score by a logistic calibration of these thresholds.

Fit: from the labelled rows of the training folds, at most about SAMPLE of them (by a hash of doc_id, the rest of the
rows has no part in it), of copies and near copies of a text the one with the least doc_id. Zstandard trains both
dictionaries on windows of texts: the ordinary one on those of ordinary texts, the toxic one on those windows of toxic
texts which toxic texts have at least RATIO times as often as ordinary ones, for other windows say nothing about the
class. The toxic dictionary goes on with the ordinary one's content, so that ordinary words compress alike under both. Both are
used as content, without the trainer's entropy tables, which make short words cheap without a match. Matches are of
parts of words too: words that no training text had count where they are made like toxic ones. For the calibration each
half of the sample is measured with the dictionaries of the other half; the size of the toxic dictionary is the one of
SIZES with which these lengths tell the labels best, since what a larger one holds besides is less and less characteristic.

Null or empty texts have no windows and the score of that; without labels of both classes every score is the prior; where
the trainer has too few windows, they are the dictionary as they are. Repeated rows get a score each; of repeated labels of a
document any toxic one counts. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.batches import kept as remembered, map_rows
from fathom.llm.storage import BATCHES, save, scratch, settings

SAMPLE, SIZES, ORDINARY_BYTES = 20_000, (512, 1_024, 2_048, 4_096), 131_072
#: Words, and windows with their repeats, that a dictionary is trained on, at most so many.
TRAINED_WORDS, TRAINED_WINDOWS = 100_000, 400_000
RATIO, SAVED = 50, 5
CUTOFF, LEVEL, CACHE = 0.7, 12, 200_000
HEAD, TAIL = bytes(range(1, 25)), bytes(range(128, 152))
_WORD = re.compile(r"\w+")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def window(word: str) -> bytes:
    return HEAD + b" " + word.encode() + b" " + TAIL


def trained(windows: list[tuple[str, int]], size: int) -> bytes:
    """Content of a dictionary that zstandard trains on windows with their numbers."""
    import zstandard as z

    share = min(1.0, TRAINED_WINDOWS / max(1, sum(n for _, n in windows)))
    repeated = [f" {w} ".encode() for w, n in sorted(windows) for _ in range(max(1, round(n * share)))]
    np.random.default_rng(0).shuffle(repeated)
    try:
        return z.train_dictionary(size, repeated).as_bytes()
    except z.ZstdError:  # too few windows to train on
        return b"".join(dict.fromkeys(repeated))[-size:]


def compressor(content: bytes):
    """Length of a window compressed under a dictionary of this content."""
    import zstandard as z

    params = z.ZstdCompressionParameters.from_level(LEVEL, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    held = z.ZstdCompressionDict(content + HEAD + TAIL, dict_type=z.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    compress = z.ZstdCompressor(dict_data=held, compression_params=params).compress
    return lambda data: len(compress(data))


class Windows(dict):
    """Bytes that the toxic dictionary saves on each word against the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic + ordinary), compressor(ordinary)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        data = window(word)
        self[word] = made = self.ordinary(data) - self.toxic(data)
        return made

    def counts(self, words: set[str]) -> list[int]:
        """Windows that save at least 1, 2, ... SAVED bytes."""
        saved = [x for w in words if (x := self[w]) > 0]
        return [sum(x >= least for x in saved) for least in range(1, SAVED + 1)]


def features(counts, n):
    """A matrix with a column of ones, from rows of counts and numbers of windows."""
    counts, n = np.asarray(counts, dtype=float).reshape(-1, SAVED), np.asarray(n, dtype=float)[:, None]
    return np.hstack([np.ones_like(n), np.log1p(1000 * counts / np.maximum(n, 1)), np.minimum(counts, 3), np.log1p(n)])


def logistic(x, y, ridge: float = 1.0, steps: int = 40):
    """Weights of a ridge logistic regression by Newton steps, and the log-likelihood."""
    w, keep = np.zeros(x.shape[1]), ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - keep @ w
        move = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, grad)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float(np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model as plain data: both dictionaries and the weights. docs: (doc_id, text), labels: (doc_id, toxic)."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id")) != 1)
    share = min(1.0, sample / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    # the sample is bounded, so its ids may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # near copies nearly always agree in the least hashes of their long words
    long = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")), lambda w: F.length(w) >= 8)
    least = F.when(F.size(long) >= 12, F.slice(F.sort_array(F.transform(long, lambda w: F.xxhash64(w))), 1, 3)).otherwise(F.array(F.xxhash64("text")))
    first = rows.groupBy(least.alias("least")).agg(F.min(F.struct("doc_id", "text", "toxic")).alias("row")).select("row.*")
    rows = save(first.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")), "toxic-sample")
    sizes = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", (F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_ordinary = (sum(n for (_, toxic), n in sizes.items() if toxic == kind) for kind in (True, False))
    model = {"toxic": b"", "ordinary": b"", "weights": [math.log((n_toxic + 0.5) / (n_ordinary + 0.5))] + [0.0] * (2 * SAVED + 1)}
    if not n_toxic or not n_ordinary:
        return model
    counts = save(word_counts(rows), "toxic-words")
    # each half is measured with the dictionaries of the other, so that the calibration sees windows as new texts have them
    halves = {h: dictionaries(counts, sizes, (1 - h,)) for h in (0, 1)}
    best = None
    for size in SIZES:
        with settings(docs.sparkSession, BATCHES):
            measured = [r for h in (0, 1) for r in measure(rows.filter(F.col("half") == h).drop("half"), {"toxic": halves[h]["toxic"][size], "ordinary": halves[h]["ordinary"]}).collect()]
        y = np.array([float(r["toxic"] == 1) for r in measured])
        weights, likelihood = logistic(features([r["counts"] for r in measured], [r["n"] for r in measured]), y)
        if best is None or likelihood > best[0]:
            best = likelihood, size, [float(x) for x in weights]
    both = dictionaries(counts, sizes, (0, 1))
    return model | {"toxic": both["toxic"][best[1]], "ordinary": both["ordinary"], "weights": best[2]}


def word_counts(rows: DataFrame) -> DataFrame:
    """Texts with each word, by half and class: columns o0, o1 (ordinary), t0, t1 (toxic)."""
    names = ("o0", "o1", "t0", "t1")

    def make():
        def step(cols):
            from collections import Counter

            found = {name: Counter() for name in names}
            for text, toxic, half in zip(cols["text"], cols["toxic"], cols["half"], strict=True):
                found[f"{'t' if toxic == 1 else 'o'}{half}"].update(distinct_words(text))
            words = list(set().union(*found.values()))
            return {"word": words} | {name: [found[name][w] for w in words] for name in names}

        return step

    counts = map_rows(rows.select("text", "toxic", "half"), make, "word string, o0 long, o1 long, t0 long, t1 long")
    return counts.groupBy("word").agg(*(F.sum(name).alias(name) for name in names))


def dictionaries(counts: DataFrame, sizes: dict, halves: tuple[int, ...]) -> dict:
    """The toxic dictionary by size, and the ordinary one, trained on the windows of the texts of these halves."""
    total = lambda kind: sum((F.col(f"{kind}{h}") for h in halves), F.lit(0))
    n_toxic, n_ordinary = (sum(sizes.get((h, kind), 0) for h in halves) for kind in (True, False))
    counts = counts.select("word", total("t").alias("toxic"), total("o").alias("ordinary"))
    # the sample is bounded, and so are these
    top = lambda kind, holds: [(r["word"], r[kind]) for r in counts.filter(holds & (F.col(kind) > 0)).orderBy(F.desc(kind), "word").select("word", kind).limit(TRAINED_WORDS).collect()]
    often = (F.col("toxic") + 0.5) / (n_toxic + 1) >= RATIO * (F.col("ordinary") + 0.5) / (n_ordinary + 1)
    windows = top("toxic", often)
    return {"toxic": {size: trained(windows, size) for size in SIZES}, "ordinary": trained(top("ordinary", F.lit(True)), ORDINARY_BYTES)}


def measure(docs: DataFrame, model: dict) -> DataFrame:
    """docs' columns but text, with n (distinct words) and counts (windows by bytes saved)."""
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model["toxic"], model["ordinary"]))
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def make():
        # a Python worker remembers windows of this model from one task of this module to the next
        name, toxic, ordinary = held.value
        models = remembered(__name__, "windows", dict)
        if name not in models:
            models.clear()
            models[name] = Windows(toxic, ordinary)
        windows = models[name]

        def step(cols):
            sets = [distinct_words(t) for t in cols["text"]]
            return {f.name: cols[f.name] for f in kept} | {"n": [len(s) for s in sets], "counts": [windows.counts(s) for s in sets]}

        return step

    return map_rows(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n long, counts array<long>")


def score_of(n: Column, counts: Column, weights: list[float]) -> Column:
    at = [F.get(counts, F.lit(k)) for k in range(SAVED)]
    x = [*(F.log1p(1000 * c / F.greatest(n, F.lit(1))) for c in at), *(F.least(c, F.lit(3)) for c in at), F.log1p(n)]
    z = sum((w * v for w, v in zip(weights[1:], x, strict=True)), F.lit(weights[0]))
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, th, held_out, score, predicted); th: hash of the text."""
    with scratch():
        model = fit(docs, labels, sample)
    rows = measure(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text"), model)
    scored = rows.withColumn("score", score_of(F.col("n"), F.col("counts"), model["weights"]))
    return scored.select("doc_id", "th", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
