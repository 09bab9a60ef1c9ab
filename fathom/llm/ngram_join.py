"""N-gram Jaccard join: pigeonhole on partitions of the shingle universe, with one-deletion neighbourhoods.

A document's set are the 64-bit hashes of its distinct WIDTH-word shingles (of all its words as one, when it has fewer; it
is empty without words, and then links with nothing). Two documents link when NUM/DEN of their union is common.

1. Documents with equal sets are one class, which the least doc_id stands for.
2. Sizes are cut into bands such that sets that link lie in the same band or in neighbouring ones (which half of the sets
   may). Where the larger set is of band b, linked sets differ in at most H(b) shingles. The hash space is cut into
   H(b) + 1 + spare(b) segments; the subset of a set that falls in a segment gives a signature, and each set brings its
   signatures for its own band, and for the next where it may link there. From H = WIDE_FROM on segment 0 is a wide one:
   for it all sets also bring its one-deletion neighbourhood, so that it answers for two differences.
3. Allocation by cost: the cost of a signature is the number of sets that have it, counted over all. A set spares its
   spare(b) dearest segments (one more where the wide segment answers for two) and is looked for in all others. By the
   pigeonhole principle linked sets agree in more segments than either spares; the cheapest of these neither does, since
   for both the others are dearer. Segments that very many unrelated sets have in common, empty ones or those of a
   template, are spared this way.
4. In each bucket of a signature all are compared with the least one first. Comparing is exact, on the sets, after their
   sizes and parity sketches (whose distance is at most the sets') have not ruled the pair out. Links make components. Only
   where a bucket then holds more than one component, members of different components are compared too: pairs within a
   component could change nothing. So the links of each single document are not counted.

A null text has no words. A null doc_id has component null and links with nothing. Rows that repeat a doc_id should repeat
its text too; where they don't, each row joins by its own set under that doc_id, verified with one of the texts. Columns
other than doc_id and text are not looked at. Without documents the result is empty.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.llm.batches import map_rows
from fathom.llm.components import components
from fathom.llm.storage import by_ids, forget, save, small_join
from fathom.llm.word_hash import WordHashes, mixed

NUM, DEN = 90, 100
#: Differences from which on sets have a wide segment, and about how many shingles it has.
WIDE_FROM, WIDE = 48, 8
#: Words of the sketch that all sets have in one size, 64 bits each; a larger one can be folded to it.
COARSE = 8
#: Families of signatures: of the own band, of the next band, of wide segments (which are never spared).
OWN, NEXT, SOUGHT = 0, 1, 2
#: What is known of a set before it is read again.
ABOUT = ("n", "coarse", "sketch")


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of word hashes."""
    n = len(hashes)
    if not n:
        return hashes
    w = min(width, n)
    h = np.zeros(n - w + 1, dtype=np.uint64)
    for i in range(w):
        h = mixed(h + hashes[i : n - w + 1 + i] + np.uint64(i + 1))
    return np.unique(h)


class Bands:
    """Bands of set sizes, and the segments that each needs."""

    def __init__(self, num: int = NUM, den: int = DEN, most: int = 1 << 40):
        self.num, self.den, self.edges = num, den, [1]
        while self.edges[-1] <= most:
            last = self.edges[-1]
            self.edges.append(max(last + 1, -(-last * den * den // (num * num))))

    def of(self, n: int) -> int:
        return bisect_right(self.edges, n) - 1

    def joins(self, n: int) -> list[int]:
        """The bands in which a set of this size may be linked: its own, and the next if that has sizes near enough."""
        own = self.of(n)
        return [own, own + 1] if n * self.den >= self.num * self.edges[own + 1] else [own]

    def differences(self, band: int) -> int:
        """H: the most shingles in which linked sets differ, the larger being of this band."""
        most = self.edges[band + 1] - 1
        # common >= num / (num + den) of |a| + |b|, so |a| + |b| - 2 common <= (den - num) / (den + num) * 2 * most
        return (self.den - self.num) * 2 * most // (self.den + self.num)


def spare(h: int) -> int:
    """Segments beyond H + 1: enough for the empty ones of nearly every set, however many segments there are."""
    return -(-(h + 1) // 10) + 3


def signatures(s: np.ndarray, bands: Bands) -> dict[int, tuple[np.ndarray, int]]:
    """Signatures of a sorted set by family, and how many of them it may spare."""
    none = np.empty(0, dtype=np.uint64)
    out = {OWN: (none, 0), NEXT: (none, 0), SOUGHT: (none, 0)}
    if not len(s):
        return out
    sought = []
    scrambled = mixed(s + np.uint64(0x5851F42D4C957F2D))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(scrambled, dtype=np.uint64)])
    for family, band in zip((OWN, NEXT), bands.joins(len(s)), strict=False):
        h = bands.differences(band)
        if not h:
            continue  # these link only when equal
        m, spared = h + 1 + spare(h), spare(h)
        wide = h >= WIDE_FROM
        cuts = np.arange(1, m, dtype=np.float64) / m
        if wide:
            part = WIDE * bands.den / (bands.num * bands.edges[band])
            cuts = part + (1 - part) * np.arange(m - 1, dtype=np.float64) / (m - 1)
        at = np.concatenate([[0], np.searchsorted(s, (cuts * 2.0**64).astype(np.uint64)), [len(s)]])
        size = np.diff(at)
        total = sums[at[1:]] - sums[at[:-1]]
        salt = (np.arange(m, dtype=np.uint64) << np.uint64(20)) + np.uint64(band)
        whole = mixed(mixed(total + salt) + size.astype(np.uint64))
        if wide:
            part = scrambled[: at[1]]
            less = mixed(mixed(total[0] - part + salt[0]) + np.uint64(max(0, len(part) - 1)))
            sought += [less, whole[:1]]
            out[family] = whole[1:], spared + 1
        else:
            out[family] = whole, spared
    if sought:
        out[SOUGHT] = np.unique(np.concatenate(sought)), 0
    return out


def sets(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, th, n, f1, f2, coarse, sketch, own, next, sought, spare_own, spare_next): sizes, fingerprints, sketches and signatures, from rows (doc_id, th, text)."""

    def make():
        words, bands = WordHashes(), Bands(num, den)

        def step(cols):
            made = ("n", "f1", "f2", "coarse", "sketch", "own", "next", "sought", "spare_own", "spare_next")
            out = {"doc_id": cols["doc_id"], "th": cols["th"]} | {name: [] for name in made}
            for text in cols["text"]:
                s = shingles(words.of((text or "").encode().lower().split()), width)
                found = signatures(s, bands)
                f1, f2 = (int(f.view(np.int64)) for f in (np.sum(mixed(s), dtype=np.uint64), np.bitwise_xor.reduce(mixed(s + np.uint64(7))) if len(s) else np.uint64(0)))
                own, following, sought = (found[k][0].view(np.int64) for k in (OWN, NEXT, SOUGHT))
                k = sketch(s)
                for name, v in zip(made, (len(s), f1, f2, np.bitwise_xor.reduce(k.reshape(-1, COARSE)), k, own, following, sought, found[OWN][1], found[NEXT][1]), strict=True):
                    out[name].append(v)
            return out

        return step

    return map_rows(rows, make, "doc_id long, th long, n long, f1 long, f2 long, coarse array<long>, sketch array<long>, own array<long>, next array<long>, sought array<long>, spare_own int, spare_next int")


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the counts of a set's hashes by bit, about a bit for each; two sketches differ in no more bits than the sets in shingles."""
    bits = 64 * COARSE << max(0, (max(1, len(s)) - 1).bit_length() - 9)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def hashed(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, shingles) of rows (doc_id, text)."""

    def make():
        words = WordHashes()

        def step(cols):
            found = [shingles(words.of((text or "").encode().lower().split()), width) for text in cols["text"]]
            return {"doc_id": cols["doc_id"], "n": [len(s) for s in found], "shingles": [s.view(np.int64) for s in found]}

        return step

    return map_rows(rows, make, "doc_id long, n long, shingles array<long>")


def halved(k: Column, size: Column) -> Column:
    """A sketch as one of `size` words, where it has twice as many."""
    return F.when(F.size(k) > size, F.zip_with(F.slice(k, F.lit(1), size), F.slice(k, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(k)


def possible(a: dict[str, Column], b: dict[str, Column], num: int, den: int) -> Column:
    """Whether sizes n and sketches allow a link of two sets; sets of half or less of the other's size don't link."""
    na, nb, ka, kb = a["n"], b["n"], a["sketch"], b["sketch"]
    most = (den - num) * (na + nb)
    # the coarse sketches first, which are compiled
    coarse = sum((F.bit_count(F.get(a["coarse"], F.lit(i)).bitwiseXOR(F.get(b["coarse"], F.lit(i)))) for i in range(COARSE)), F.lit(0))
    least = F.least(F.size(ka), F.size(kb))
    distance = F.aggregate(F.zip_with(halved(ka, least), halved(kb, least), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return F.when((den * F.least(na, nb) >= num * F.greatest(na, nb)) & ((den + num) * coarse <= most), (den + num) * distance <= most).otherwise(False)


def verified(pairs: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link; only documents of these pairs are read again, from rows (doc_id, text)."""
    wanted = save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    held = save(hashed(by_ids(rows, wanted, "doc_id"), width), "shingles")
    whole = lambda k: held.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("shingles").alias(f"s{k}"))
    common = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(whole("a"), "a").join(whole("b"), "b").filter(den * common >= num * (F.col("na") + F.col("nb") - common)).select("a", "b").distinct()
    links = save(links, "links")
    forget(held, wanted)
    return links


def asked(members: DataFrame) -> DataFrame:
    """Rows (sig, doc_id): a document's signatures but for the `spare` dearest of each family, from rows (sig, n, doc_id, family, spare)."""
    dearest = Window.partitionBy("doc_id", "family").orderBy(F.desc("n"), "sig")
    return members.withColumn("place", F.row_number().over(dearest)).filter("place > spare").select("sig", "doc_id")


def join(docs: DataFrame, width: int = 3, num: int = NUM, den: int = DEN) -> DataFrame:
    """For rows (doc_id, text): doc_id, n_shingles and component_id, a row per row. num / den has to be over a half."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    table = save(sets(rows, width, num, den), "sets")
    facts = save(table.select("doc_id", "n", "f1", "f2"), "set-facts")
    some = facts.filter("doc_id is not null and n > 0")
    classes = save(some.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("first")), "classes")
    firsts = save(classes.select(F.col("first").alias("doc_id")).distinct(), "firsts")
    mine = by_ids(table.filter("n > 0"), firsts, "doc_id")
    every = mine.select("doc_id", F.explode(F.concat("own", "next", "sought")).alias("sig"))
    shared = every.groupBy("sig").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
    shared = save(shared.filter("a < b").select("sig", "n"), "shared-signatures")
    family = lambda name, k, spare: F.transform(name, lambda s: F.struct(s.alias("sig"), F.lit(k).alias("family"), spare.alias("spare")))
    tagged = F.concat(family("own", OWN, F.col("spare_own")), family("next", NEXT, F.col("spare_next")), family("sought", SOUGHT, F.lit(0)))
    costly = save(small_join(mine.select("doc_id", F.explode(tagged).alias("s")).select("doc_id", "s.*"), shared, "sig"), "costs")
    members = save(asked(costly), "members")
    about = save(mine.select("doc_id", *ABOUT).dropDuplicates(["doc_id"]), "about")
    forget(table, shared, costly)
    buckets = members.groupBy("sig").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    buckets = save(buckets.filter("a < b").select("sig", "a"), "buckets")
    leaders = small_join(members, buckets, "sig").filter("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    side = lambda k: about.select(F.col("doc_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ABOUT))
    of = lambda k: {c: F.col(f"{c}_{k}") for c in ABOUT}
    likely = save(leaders, "leaders").join(side("a"), "a").join(side("b"), "b").filter(possible(of("a"), of("b"), num, den))
    likely = save(likely.select("a", "b"), "likely")
    texts = rows.select("doc_id", "text")
    links = verified(likely, texts, width, num, den)
    found = save(components(links), "components")
    # what may still link: members of different components in one bucket
    labelled = small_join(members, buckets, "sig").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = save(labelled.select("doc_id", "sig", F.coalesce("component", "doc_id").alias("component")), "labelled")
    open_buckets = save(labelled.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("sig"), "open")
    left = save(small_join(labelled, open_buckets, "sig").join(about, "doc_id"), "open-members")
    named = lambda k: left.select("sig", *(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "component", *ABOUT)))
    may = (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("component_a") != F.col("component_b"))
    may &= possible(of("a"), of("b"), num, den)
    more = named("a").join(named("b"), "sig").filter(may).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    more = save(more.join(likely, ["a", "b"], "left_anti"), "more-pairs")
    forget(left, members, labelled)
    if more.limit(1).count():
        late = verified(more, texts, width, num, den)
        found = save(components(links.union(late)), "components")
    # back from classes to documents: labels are those of the classes' first documents, which are their least
    label = classes.join(found.select(F.col("node").alias("first"), "component"), "first", "left")
    label = save(label.select("n", "f1", "f2", F.coalesce("component", "first").alias("component_id")), "class-labels")
    return facts.join(label, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
