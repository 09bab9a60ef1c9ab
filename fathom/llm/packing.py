"""Best-fit packing by a grouping genetic algorithm on islands.

Tokens are those of the tokenizer file for the whole text, then the id END. Longer documents are cut into pieces of
CAPACITY tokens, of which the first takes what is left over. Full pieces are sequences of their own. The others are
dealt evenly to blocks of about BLOCK pieces; each block is packed by ISLANDS islands: every island starts from a
best-fit-decreasing packing and shuffled best-fit packings, and breeds children by injecting whole well-filled sequences
of one parent into the other and dropping the sequences that hold injected pieces twice. Displaced pieces, and those of
the emptiest sequences, first take the place of one or two pieces of a sequence that they then fill to the last token, and
are then fitted best-fit, largest first. After each epoch the best packing of an island migrates to the next island; in the
end the best one of the block stays. An island stops at the least number of sequences that the tokens allow. What all
sequences leave open is little: those filled to less than LOOSE are taken apart, mixed with those of other blocks and
packed once more, until all that are left are in one block or as few as their tokens allow. All choices are seeded by the
block, so a task that runs again gives the same result; among equally good packings the one of the first island stays.

A null or empty text is the END id alone. Repeated rows are packed each; a null doc_id is as any other. Columns other than
doc_id and text are not looked at. Without documents there are no sequences.
"""

from __future__ import annotations

import codecs
import random
import re
import zlib
from array import array
from collections import defaultdict
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathom.llm.batches import kept, map_rows
from fathom.llm.storage import save

CAPACITY, END = 2048, 0
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 16_384, 3, 2, 4, 3
#: Share of the better half of the sequences that a crossover injects.
INJECTED = 0.1
LOOSE, REPACKS = 0.98, 8
#: Pieces of text whose ids a Python worker remembers during the tasks of this module, at most so many.
MEMORY = 500_000
#: Texts whose distinct words are looked up together, at most so many; a batch of Spark's has at most about 4 MB of them.
TEXTS = 2_048
#: Texts for which Python's own classes of letters, digits and white space are the tokenizer's.
_OTHER = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-\u024f]")
#: The tokenizer's split of a text into pieces that are encoded each by itself, in Python's syntax.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The same for texts in Latin-1, whose classes are short lists of bytes.
_OTHER_BYTES = b"\x1c\x1d\x1e\x1f\xb2\xb3\xb9\xbc\xbd\xbe"
_LETTERS, _MARKS, _SPACES = (b"".join(b"\\x%02x" % b for b in range(256) if re.fullmatch(kind, chr(b))) for kind in (r"[^\W\d_]", r"[^\s\w]|_", r"\s"))
_PIECE_BYTES = re.compile(b" ?[%b]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[%b]++|[%b]+(?![^%b])|[%b]++" % (_LETTERS, _MARKS, _SPACES, _SPACES, _SPACES))

#: Bytes that keep a text from being cut by many(): those of _OTHER_BYTES, and white space but spaces and line ends.
_ODD = np.zeros(256, dtype=bool)
_ODD[list(_OTHER_BYTES + b"\t\v\f\r\x85\xa0")] = True
#: Kinds of the other bytes, and whether a piece ends between two of them.
_LETTER, _DIGIT, _MARK, _SPACE, _LINE = range(5)
_KIND = np.array([_LINE if b == 10 else _SPACE if b == 32 else _DIGIT if 48 <= b < 58 else _LETTER if re.fullmatch(r"[^\W\d_]", chr(b)) else _MARK for b in range(256)], dtype=np.uint8)
_CUT = np.array([now >= _SPACE if before == _SPACE else before == _LINE or before != now for before in range(5) for now in range(5)])


def letters_of_bytes() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself where it is printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by the tokenizer file.

    Byte-level BPE encodes each piece of a text by itself, so the ids of pieces, which the tokenizer's model gives, are
    remembered. Texts with characters whose class may differ between Python and the tokenizer are encoded whole.

    many() cuts Latin-1 texts by the kinds of neighbouring bytes, but for texts with white space of three characters, or of
    two at the end, which is fewer pieces than that gives. Of the pieces of all texts the distinct ones are looked up, once
    each, and their ids dealt out by numpy.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = _Known(self.tokenizer.model)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            if _OTHER.search(text):
                return self.whole(text)
            return b"".join(map(self.known.__getitem__, _PIECE.findall(text)))
        if len(raw.translate(None, _OTHER_BYTES)) < len(raw):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, _PIECE_BYTES.findall(raw)))

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        raws, alone = [], set()
        for k, text in enumerate(texts):
            try:
                raws.append(text.encode("latin-1"))
            except UnicodeEncodeError:
                raws.append(b"")
                alone.add(k)
        ends = np.cumsum([0, *map(len, raws)])
        data = np.frombuffer(joined := b"".join(raws), dtype=np.uint8)
        if not len(data):
            return [self(t) for t in texts]
        full = np.diff(ends) > 0
        kind = _KIND[data]
        odd, white = _ODD[data], kind >= _SPACE
        odd[:-2] |= white[:-2] & white[1:-1] & white[2:]
        last = ends[1:][np.diff(ends) > 1] - 1
        odd[last] |= white[last] & white[last - 1]
        # such texts go alone; white space across two of them sends one more there than needed
        alone.update((np.searchsorted(ends, np.flatnonzero(odd), side="right") - 1).tolist())
        cut = np.append(True, _CUT[5 * kind[:-1] + kind[1:]])
        cut[ends[:-1][full]] = True
        # 's and its like are pieces where the mark starts one
        marks = np.flatnonzero(cut & (data == ord("'")))
        one, two = (np.append(data, [0, 0])[marks + k] for k in (1, 2))
        size = np.where(np.isin(one, list(b"stmd")), 2, np.where(np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 3, 0))
        inside = (size > 0) & (marks + size <= ends[np.searchsorted(ends, marks, side="right")])
        marks, size = marks[inside], size[inside]
        cut[marks + 1] = False
        cut[(marks + size)[marks + size < len(cut)]] = True
        at = np.flatnonzero(cut)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
        ids = list(map(self.known.__getitem__, found.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        held, which = np.frombuffer(b"".join(ids), dtype="<u4"), found.indices.to_numpy()
        n = sizes[which]
        until = np.append(0, np.cumsum(n))
        # an id's place in `held` is as far from its piece's first one there as here
        out = held[np.repeat((np.cumsum(sizes) - sizes)[which] - until[:-1], n) + np.arange(until[-1])]
        bounds = until[np.searchsorted(at, ends)].tolist()
        return [self(t) if k in alone else out[a:b].tobytes() for k, (t, a, b) in enumerate(zip(texts, bounds, bounds[1:], strict=False))]


class _Known(dict):
    """Ids of pieces, which are texts or their Latin-1 bytes; of those met before the last MEMORY / 2, that many are kept to be asked for again."""

    def __init__(self, model):
        self.model, self.before, letters = model, {}, letters_of_bytes()
        self.letters = "".join(letters[b] for b in range(256))

    def __missing__(self, piece: str | bytes) -> bytes:
        if (made := self.before.pop(piece, None)) is None:
            raw = piece.encode() if isinstance(piece, str) else piece if piece.isascii() else piece.decode("latin-1").encode()
            made = array("I", [t.id for t in self.model.tokenize(codecs.charmap_decode(raw, "strict", self.letters)[0])]).tobytes()
        if len(self) >= MEMORY // 2:
            self.before = dict(self)
            self.clear()
        self[piece] = made
        return made


def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, which remembers pieces from one task of this module to the next."""
    return kept(__name__, path, lambda: Encoder(path))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, text) to rows (doc_id, piece, start, length, ids_crc32)."""
    path = path or tokenizer_path()

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(path), np.array([END], dtype="<u4").tobytes()

        def step(cols):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(cols["doc_id"], encode.many([t or "" for t in cols["text"]]), strict=True):
                ids += end
                total = len(ids) // 4
                first = total % capacity or capacity
                cuts = [0, *range(first, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for name, v in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        out[name].append(v)
            return out

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long", rows=TEXTS)


def filled(lengths: list[int], held: list[int]) -> int:
    return sum(map(lengths.__getitem__, held))


def best_fit(lengths: list[int], order: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Adds the pieces of `order` to bins, each to the fullest bin with room, or to a new one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has r left
    for b, held in enumerate(bins):
        r = capacity - filled(lengths, held)
        room[r].append(b)
        free |= 1 << r
    for i in order:
        n = lengths[i]
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        room[r - n].append(b)
        free |= 1 << (r - n)
    return bins


def fitness(lengths: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones, by the sum of squared fills."""
    return -len(bins), sum((filled(lengths, b) / capacity) ** 2 for b in bins)


def fill_up(lengths: list[int], bins: list[list[int]], pool: list[int], capacity: int) -> list[int]:
    """Swaps one or two pieces of bins with room for one or two of the pool that fill them to the last token; the pool after that."""
    alive: set[int] = set()
    by_sum: defaultdict[int, list[tuple[int, ...]]] = defaultdict(list)

    def add(i: int) -> None:
        n = lengths[i]
        by_sum[n].append((i,))
        for j in islice(alive, 64):
            if n + lengths[j] <= capacity:
                by_sum[n + lengths[j]].append((i, j))
        alive.add(i)

    for i in pool:
        add(i)
    for held in bins:
        room = capacity - filled(lengths, held)
        few = held[:5] if room else []
        for out in (*combinations(few, 2), *((i,) for i in few)):
            fits = by_sum.get(filled(lengths, out) + room, [])
            while fits and not alive.issuperset(fits[-1]):
                fits.pop()
            if fits:
                came = fits.pop()
                alive.difference_update(came)
                for i in out:
                    held.remove(i)
                    add(i)
                held += came
                break
    return sorted(alive)


def crossover(lengths: list[int], a: list[list[int]], b: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Some whole well-filled bins of b go into a; bins of a that hold their pieces too are dropped, and what these displace is fitted anew."""
    better = sorted(range(len(b)), key=lambda k: -filled(lengths, b[k]))[: max(1, len(b) // 2)]
    chosen = [k for k in better if rng.random() < INJECTED] or [better[rng.randrange(len(better))]]
    injected = [list(b[k]) for k in chosen]
    taken = {i for held in injected for i in held}
    kept, displaced = [], []
    for held in a:
        if taken.isdisjoint(held):
            kept.append(list(held))
        else:
            displaced += [i for i in held if i not in taken]
    # the emptiest bins are opened too, for the displaced to mix with theirs
    kept.sort(key=lambda held: filled(lengths, held))
    opened = max(1, len(kept) // 50)
    for held in kept[:opened]:
        displaced += held
    bins = injected + kept[opened:]
    displaced = fill_up(lengths, bins, displaced, capacity)
    displaced.sort(key=lambda i: (-lengths[i], i))
    return best_fit(lengths, displaced, bins, capacity)


def evolve(lengths: list[int], elites: list[list[list[int]]], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best packing after some generations of one island, which starts from `elites` and shuffled packings."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    falling = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    people = [*elites] or [best_fit(lengths, falling, [], capacity)]
    while len(people) < population:
        order = sorted(falling, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
        people.append(best_fit(lengths, order, [], capacity))
    rated = lambda bins: (fitness(lengths, bins, capacity), bins)
    ranked = sorted(map(rated, people), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(ranked[0][1]) == least:
            break
        a, b = ranked[0][1], ranked[rng.randrange(1, len(ranked))][1]
        children = [rated(crossover(lengths, a, b, capacity, rng)), rated(crossover(lengths, b, a, capacity, rng))]
        ranked = sorted(ranked + children, key=lambda x: x[0], reverse=True)[:population]
    return ranked[0][1]


def to_bins(at: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(at):
        bins.setdefault(int(b), []).append(i)
    return list(bins.values())


def from_bins(bins: list[list[int]], n: int) -> list[int]:
    at = [0] * n
    for k, held in enumerate(bins):
        for i in held:
            at[i] = k
    return at


def pack_blocks(rows: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Rows (block, id, length) to (block, id, length, bin), packed by block."""
    held = F.sort_array(F.collect_list(F.struct("length", "id")), asc=False)
    blocks = save(rows.groupBy("block").agg(held.alias("held")), "pack-blocks")
    now = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.transform("held", lambda x: x["length"].cast("int")).alias("lengths")).withColumns(
        {"mine": F.lit(None).cast("array<int>"), "migrant": F.lit(None).cast("array<int>")}
    )
    for epoch in range(epochs):

        def make(epoch=epoch):
            def step(cols):
                at, rate = [], []
                for block, island, lengths, mine, migrant in zip(*(cols[c] for c in ("block", "island", "lengths", "mine", "migrant")), strict=True):
                    elites = [to_bins(x) for x in (mine, migrant) if x]
                    bins = evolve(lengths, elites, capacity, zlib.crc32(f"{block}:{island}:{epoch}".encode()))
                    at.append(from_bins(bins, len(lengths)))
                    n, fill = fitness(lengths, bins, capacity)
                    rate.append(n * 1e6 + fill)
                return {"block": cols["block"], "island": cols["island"], "lengths": cols["lengths"], "mine": at, "rate": rate}

            return step

        spread = now.repartition(F.col("block"), F.col("island"))
        now = save(map_rows(spread, make, "block long, island int, lengths array<int>, mine array<int>, rate double"), "pack-epoch")
        if epoch + 1 < epochs:
            moved = now.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("mine").alias("migrant"))
            now = now.drop("rate").join(moved, ["block", "island"])
    best = now.groupBy("block").agg(F.max_by("mine", F.struct("rate", -F.col("island"))).alias("mine"))
    return blocks.join(best, "block").select("block", F.explode(F.arrays_zip("held", F.col("mine").alias("mine"))).alias("x")).select("block", F.col("x.held.id").alias("id"), F.col("x.held.length").alias("length"), F.col("x.mine").alias("bin"))


def in_blocks(rows: DataFrame, block: int, salt: int) -> DataFrame:
    """Deals rows (id, length) evenly by a hash of id, which no two rows share."""
    n = max(1, -(-rows.count() // block))
    return rows.withColumn("block", F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)))


def pack(cut: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, repacks: int = REPACKS) -> DataFrame:
    """Rows of pieces, with id and length, to the same rows with sequence_id and offset."""
    full = cut.filter(F.col("length") == capacity).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = [full]
    rest = cut.filter(F.col("length") < capacity).select("id", "length")
    for k in range(repacks + 1):
        packed = save(pack_blocks(in_blocks(rest, block, k), capacity), "packed")
        bins = packed.groupBy("block", "bin").agg(F.sum("length").alias("fill"), F.min("id").alias("sequence_id"))
        bins = save(bins, "bins")
        loose = bins.filter(F.col("fill") < LOOSE * capacity)
        stats = loose.agg(F.count("*").alias("n"), F.coalesce(F.sum("fill"), F.lit(0)).alias("fill")).first()
        n_blocks = bins.agg(F.count_distinct("block").alias("n")).first()["n"]
        last = k == repacks or n_blocks <= 1 or stats["n"] <= -(-stats["fill"] // capacity)
        kept = bins if last else bins.filter(F.col("fill") >= LOOSE * capacity)
        seated = packed.join(kept.select("block", "bin", "sequence_id"), ["block", "bin"])
        by_place = F.sort_array(F.collect_list(F.struct("id", "length")))
        offsets = seated.groupBy("sequence_id").agg(by_place.alias("held")).select(
            "sequence_id",
            "held",
            F.expr("aggregate(held, struct(cast(0 as bigint) as at, cast(array() as array<bigint>) as offs), (a, x) -> struct(a.at + x.length as at, concat(a.offs, array(a.at)) as offs), a -> a.offs)").alias("offs"),
        )
        done.append(offsets.select("sequence_id", F.explode(F.arrays_zip("held", "offs")).alias("x")).select(F.col("x.held.id").alias("id"), "sequence_id", F.col("x.offs").alias("offset")))
        if last:
            break
        rest = save(packed.join(loose.select("block", "bin"), ["block", "bin"]).select("id", "length"), "loose")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return cut.join(placed, "id")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    # the ids are written with the pieces: later steps read the same ones
    cut = save(pieces(docs, path, capacity).withColumn("id", F.monotonically_increasing_id()), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
