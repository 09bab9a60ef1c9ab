"""Token counts by a digest cache: a text's count is stored once for each version of a tokenizer and looked up ever after.

A count is stored under the 256-bit digest of the content and the digest of the tokenizer's version: its file, the library,
and the library's version. Content is normalised as far as no tokenizer can tell: a null text is an empty one; letters and
white space stay, as they change counts. Digests of all documents are joined with the cache; of each content that is not there
one text is encoded, by the tokenizer's library, and its count is appended to the cache in a batch of its own. A batch
that a lost task or a second writer wrote twice holds equal counts, and readers take one of each digest.

Texts travel only for the choice of one text per content, with copies combined before the shuffle, and only texts that
the cache lacks; the rest works on digests.

Documents with the same text, under whatever ids, have the same count; rows that repeat come back each; a null doc_id is as any
other. Columns other than doc_id and text are not looked at. Without documents the result and what is appended are empty.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm.batches import kept, map_rows
from fathom.llm.packing import _OTHER, _PIECE, letters_of_bytes, tokenizer_path
from fathom.llm.storage import BATCHES, save, settings, shared_folder

#: Most digests of contents that a join may broadcast, about 10 MB.
BROADCAST_DIGESTS = 100_000
#: Counts in a file of a batch, about so many at most. For every file that an executor writes to a local file system without Hadoop's
#: native library it starts processes (chmod), so files go by the number of counts and not by that of shuffle partitions.
FILE_ROWS = 20_000
#: Pieces of text whose counts a Python worker remembers, at most so many.
MEMORY = 500_000
STORED = "digest binary, n_tokens long"


def version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        held = hashlib.sha256(f.read())
    name = f"tokenizers {tokenizers.__version__}"
    if path.endswith(".model"):
        import sentencepiece

        name = f"sentencepiece {sentencepiece.__version__}"
    held.update(name.encode())
    return held.hexdigest()


class Counter:
    """Number of tokens of a text as the file's library gives it, without begin, end or other added tokens.

    Special strings inside a text are what the library makes of them by default. Byte-level BPE with its usual split encodes each
    piece of a text by itself, so the counts of pieces are remembered; a text with a special string, or with characters
    whose class may differ between Python and the library, is encoded whole.
    """

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole, self.pieces = lambda text: len(model.encode(text, add_bos=False, add_eos=False, num_threads=1)), False
            return
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        self.whole = lambda text: len(made.encode(text, add_special_tokens=False))
        kind = json.loads(made.to_str())
        split = kind["pre_tokenizer"] or {}
        self.pieces = kind["model"]["type"] == "BPE" and not kind["normalizer"] and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
        self.model, self.letters = made.model, letters_of_bytes()
        special = [re.escape(x["content"]) for x in kind["added_tokens"]]
        self.other = re.compile("|".join([_OTHER.pattern, *special]))

    def piece(self, text: str) -> int:
        if len(self.known) >= MEMORY:
            self.known.clear()
        made = self.known[text] = len(self.model.tokenize(text.encode().decode("latin-1").translate(self.letters)))
        return made

    def __call__(self, text: str) -> int:
        if not self.pieces or self.other.search(text):
            return self.whole(text)
        known, piece = self.known, self.piece
        return sum([known[x] if x in known else piece(x) for x in _PIECE.findall(text)])


def counter(path: str) -> Counter:
    """The counter of a Python worker, which remembers pieces from one task of this module to the next."""
    return kept(__name__, path, lambda: Counter(path))


@dataclass(frozen=True)
class Cache:
    """Stored counts below a folder that driver and executors share: one folder per tokenizer version, one below it per batch."""

    spark: SparkSession
    folder: str

    def _at(self, version: str) -> str:
        return f"{self.folder}/tokenizer={version}"

    def stored(self, version: str) -> DataFrame | None:
        """(digest, n_tokens), each digest once; None if there is no batch yet."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self._at(version))
        if not at.getFileSystem(conf).exists(at):
            return None
        held = self.spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(self._at(version))
        return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str, rows: int | None = None) -> DataFrame:
        """Write counts as a new batch and read it back. rows: how many counts there are at most, if the caller knows."""
        at = f"{self._at(version)}/batch-{uuid.uuid4().hex}"
        if rows is not None:
            counts = counts.repartition(1 + rows // FILE_ROWS)
        with settings(self.spark, BATCHES):
            counts.write.parquet(at)
        return self.spark.read.schema(STORED).parquet(at)


def own_cache(spark: SparkSession) -> Cache:
    """A new, empty cache among this application's tables."""
    return Cache(spark, f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}")


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """Rows (digest, text) to (digest, n_tokens)."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(path)
        return lambda cols: {"digest": cols["digest"], "n_tokens": [count(x) for x in cols["text"]]}

    return map_rows(texts, make, STORED)


def count(docs: DataFrame, cache: Cache, path: str | None = None) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, digest, n_bytes, n_tokens); counts that the cache lacks are appended to it."""
    path = path or tokenizer_path()
    of = version(path)
    text = F.coalesce("text", F.lit(""))
    held = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keyed = save(held.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")
    texts, known = held.select("digest", "text"), cache.stored(of)
    if known is None:
        counts = cache.append(encoded(texts.dropDuplicates(["digest"]), path), of, keyed.count())
    else:
        looked = save(keyed.select("digest").distinct().join(known, "digest", "left"), "token-lookups")
        missing = looked.filter("n_tokens is null").select("digest")
        if (lacking := missing.count()) <= BROADCAST_DIGESTS:
            fresh = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:  # copies are combined first, so that no content is hot in the join
            fresh = texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
        counts = looked.filter("n_tokens is not null").unionByName(cache.append(encoded(fresh, path), of, lacking))
    if counts.count() <= BROADCAST_DIGESTS:
        counts = F.broadcast(counts)
    # else both sides are written tables: a content of very many documents is split by Spark
    return keyed.join(counts, "digest").select("doc_id", "digest", "n_bytes", "n_tokens")
