"""Line dedup: overlapping documents by shared rare lines, aligned by patience diff; common blocks go from the later one.

Lines are split at \\n; two are equal when their words (separated by space, \\t, \\v, \\f, \\r) are. A least
block is a run of consecutive lines (empty ones aside) that reaches BLOCK_WORDS words with its last line, or, read
backwards, with its first. Every common block of that many words is a union of least blocks. These are anchors; so are the
runs that reach ANCHOR_WORDS words in the same way: single lines of that length, or several shorter ones. The holders of
an anchor are in the order of (doc_id, hash of text).

A rare anchor, with at most RARE holders, pairs all of them. A frequent one pairs nobody by itself; what its holders share is found
exactly in two ways. A least block that stands line after line in any earlier document goes by its hash. Any other aligned
block is made of least blocks whose lines the earlier document has in order with others in between. Of the documents that hold
such a least block line after line only the first can have kept it, and only if each of its lines stands in an earlier document:
that one document is paired with every earlier one that holds the block's two least frequent lines in that order. So
alignments of all pairs would delete the same lines, however many documents hold a line.

Each pair is aligned: lines that are unique in both and common are matched along their longest increasing sequence, and
the gaps between them in turn; equal lines next to a match extend it. A gap without such lines, as where a passage stands
twice in one of the two, is matched along a longest common subsequence. Runs of matched lines with at least BLOCK_WORDS words
are deleted from the later document. A document whose text equals an earlier one's goes whole by the same measure. All
is judged on the input texts.

A null text has no lines and stays null. Documents with the same doc_id and text are one document: none is later. A null
doc_id comes before others. What stays is joined by \\n; a document of which nothing stays is kept with an empty text.
Columns other than doc_id, text and n_chars come back as they are, whatever their names. Without documents the result is
empty.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.llm.batches import map_rows
from fathom.llm.storage import by_ids, save, scratch, with_marks
from fathom.llm.word_hash import signed_hash

ANCHOR_WORDS, BLOCK_WORDS, RARE = 4, 10, 5
#: Bits of a table of lcs(): a larger one is halved, or not kept.
ROOM = 1 << 28
#: doc_id for order and joins: null is the least.
LEAST = -(1 << 63)
#: (od, oth) comes before (d, th).
LATER = "od < d OR (od = d AND oth < th)"


def key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id), F.lit(LEAST))


def least_blocks(hashes: list[int], sizes: list[int], least: int) -> list[tuple[int, int, int]]:
    """(hash, first, last place) of the shortest runs with `least` words from each line on, and up to each line; trailing empty lines belong to a run."""
    full = [i for i, n in enumerate(sizes) if n]
    after = [*full[1:], len(sizes)]
    runs, j, words = set(), 0, 0
    for i, start in enumerate(full):  # from line i on, full[i:j] is the shortest
        while j < len(full) and words < least:
            words, j = words + sizes[full[j]], j + 1
        if words >= least:
            runs.add((i, j - 1))
        words -= sizes[start]
    i = words = 0
    for j, end in enumerate(full):  # up to line j, full[i:j + 1] is the shortest
        words += sizes[end]
        while words - sizes[full[i]] >= least:
            words, i = words - sizes[full[i]], i + 1
        if words >= least:
            runs.add((i, j))
    one = lambda i, j: hashes[full[i]] if i == j else signed_hash(b"".join(hashes[k].to_bytes(8, "little", signed=True) for k in full[i : j + 1]))
    return [(one(i, j), full[i], after[j] - 1) for i, j in sorted(runs)]


def lines(docs: DataFrame, anchor_words: int, block_words: int) -> DataFrame:
    """(d, th, hashes, sizes, least, runs, own): one hash and the number of words for each line of a text, its least blocks, its other anchors, and its distinct lines with words."""

    def make():
        def step(cols):
            hashes, sizes, least, runs, own = [], [], [], [], []
            for text in cols["text"]:
                split = [x.split() for x in (text or "").encode().split(b"\n")]
                hashes.append([signed_hash(b" ".join(x)) for x in split])
                sizes.append([len(x) for x in split])
                found = least_blocks(hashes[-1], sizes[-1], block_words)
                least.append([dict(zip(("line", "first", "last"), x, strict=True)) for x in found])
                runs.append(list({x[0] for x in least_blocks(hashes[-1], sizes[-1], anchor_words)}.difference(x[0] for x in found)))
                at = by_line(hashes[-1])
                own.append([{"line": h, "first": i[0], "last": i[-1]} for h, i in at.items() if sizes[-1][i[0]]])
            return {"d": cols["d"], "th": cols["th"], "hashes": hashes, "sizes": sizes, "least": least, "runs": runs, "own": own}

        return step

    return map_rows(docs, make, "d long, th long, hashes array<long>, sizes array<int>, least array<struct<line: long, first: int, last: int>>, runs array<long>, own array<struct<line: long, first: int, last: int>>")


def patience(a: list[int], b: list[int]) -> list[int]:
    """Places of b that match lines of a, in order, by patience diff; by LCS in gaps that have no unique common line."""
    matched: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append(b0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append(b1)
        if a0 >= a1 or b0 >= b1:
            continue
        in_a = unique(a, a0, a1)
        common = [(in_a[h], j) for h, j in sorted(unique(b, b0, b1).items(), key=lambda x: x[1]) if h in in_a]
        chain = increasing(common)
        if not chain:
            in_both = set(a[a0:a1]).intersection(b[b0:b1])
            rest = [j for j in range(b0, b1) if b[j] in in_both]
            matched += [rest[k] for k in lcs([h for h in a[a0:a1] if h in in_both], [b[j] for j in rest])]
            continue
        for (i, j), (ni, nj) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            if j >= b0:
                matched.append(j)
            work.append((i + 1, ni, j + 1, nj))
    return sorted(matched)


def lcs(a: list[int], b: list[int]) -> list[int]:
    """Places of b in a longest common subsequence with a; rows of its table are bits of one number (Hyyro 2004)."""
    out: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > ROOM and b1 - b0 > 1:
            mid = (b0 + b1) // 2
            head = lengths(table_rows(a[a0:a1], b[b0:mid], last=True), a1 - a0)
            tail = lengths(table_rows(a[a0:a1][::-1], b[mid:b1][::-1], last=True), a1 - a0)[::-1]
            cut = a0 + max(range(a1 - a0 + 1), key=lambda i: head[i] + tail[i])
            work += [(a0, cut, b0, mid), (cut, a1, mid, b1)]
            continue
        rows = table_rows(a[a0:a1], b[b0:b1])
        i, j = a1 - a0 - 1, b1 - b0 - 1
        while i >= 0 and j >= 0:
            if rows[j] >> i & 1:
                i -= 1
            elif j and not rows[j - 1] >> i & 1:
                j -= 1
            else:
                out.append(b0 + j)
                i, j = i - 1, j - 1
    return sorted(out)


def table_rows(a: list[int], b: list[int], last: bool = False) -> list[int]:
    """For each line of b, or the last: bit i is 0 where the common subsequence grows with a[i]."""
    places, at = by_line(a), {}
    row = full = (1 << len(a)) - 1
    rows = []
    for h in b:
        if (found := at.get(h)) is None:
            bits = bytearray((len(a) + 7) // 8)
            for i in places.get(h, ()):
                bits[i >> 3] |= 1 << (i & 7)
            found = int.from_bytes(bits, "little")
            if len(places) * len(a) <= ROOM:
                at[h] = found
        both = row & found
        row = (row + both | row - both) & full
        if not last:
            rows.append(row)
    return [row] if last else rows


def by_line(x: list[int]) -> dict[int, list[int]]:
    """Places of each line."""
    at: dict[int, list[int]] = {}
    for i, h in enumerate(x):
        at.setdefault(h, []).append(i)
    return at


def lengths(rows: list[int], n: int) -> list[int]:
    """Length of the common subsequence with the first 0, 1, ... n lines, by the last of `rows`."""
    return [0, *accumulate(1 - (x == "1") for x in format(rows[-1], f"0{n}b")[::-1])]


def unique(x: list[int], start: int, end: int) -> dict[int, int]:
    """Lines that occur once in x[start:end], with their place."""
    at: dict[int, int] = {}
    for i in range(start, end):
        at[x[i]] = -1 if x[i] in at else i
    return {h: i for h, i in at.items() if i >= 0}


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (i, j), which come by j, with rising i."""
    tops: list[int] = []
    held: list[int] = []
    before: list[int] = []
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tops, i)
        if at == len(tops):
            tops.append(i)
            held.append(k)
        else:
            tops[at], held[at] = i, k
        before.append(held[at - 1] if at else -1)
    out, k = [], held[-1] if held else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def blocks(a: list[int], b: list[int], sizes: list[int], least: int) -> list[int]:
    """Places of b in matched runs (empty lines do not end a run) with at least `least` words."""
    out: list[int] = []
    matched = set(patience(a, b))
    run: list[int] = []
    for j in range(len(b) + 1):
        if j < len(b) and (j in matched or (run and not sizes[j])):
            run.append(j)
        elif run:
            if sum(sizes[i] for i in run) >= least:
                out += run
            run = []
    return out


def shared(table: DataFrame) -> DataFrame:
    """(line, d, th, first, last, od, oth, n): the anchors of `table` that have two holders or more, with their places if they are least blocks, the first holder, and the number of rows."""
    none = F.lit(None).cast("int")
    single = F.transform("runs", lambda x: F.struct(x.alias("line"), none.alias("first"), none.alias("last")))
    anchors = save(table.select("d", "th", F.explode(F.concat("least", single)).alias("x")).select("d", "th", "x.*"), "anchors")
    holder = F.struct("d", "th")
    lines = anchors.groupBy("line").agg(F.min(holder).alias("a"), F.max(holder).alias("b"), F.count("*").alias("n"))
    lines = save(lines.filter("a <> b").select("line", F.col("a.d").alias("od"), F.col("a.th").alias("oth"), "n"), "shared-lines")
    # both sides are written tables: a line of very many documents is split by Spark
    return save(anchors.join(lines, "line"), "shared")


def broken_pairs(table: DataFrame, met: DataFrame) -> DataFrame:
    """(d, th, od, oth): the first holder of a least block, and an earlier document that may have its lines in order with others in between."""
    held = table.select("d", "th", F.explode("own").alias("x")).select("d", "th", "x.*")
    stats = held.groupBy("line").agg(F.min(F.struct("d", "th")).alias("a"), F.count("*").alias("n")).filter("n > 1")
    stats = save(stats.select("line", F.col("a.d").alias("od"), F.col("a.th").alias("oth"), "n"), "line-holders")
    before = held.select("d", "th", "line").join(stats, "line").filter(LATER)
    before = save(before.groupBy("d", "th").agg(F.collect_list(F.struct("line", "n")).alias("before")), "lines-before")

    def make():
        def step(cols):
            out = {k: [] for k in ("d", "th", "block", "key", "other", "key_first")}
            for d, th, hashes, sizes, least, before in zip(*(cols[k] for k in ("d", "th", "hashes", "sizes", "least", "before")), strict=True):
                n = {x["line"]: x["n"] for x in before}
                for x in least:
                    lines = [hashes[i] for i in range(x["first"], x["last"] + 1) if sizes[i]]
                    if len(lines) > 1 and all(h in n for h in lines):
                        i, j = sorted(range(len(lines)), key=lambda i: (n[lines[i]], i))[:2]
                        for k, v in zip(out, (d, th, x["line"], lines[i], lines[j], i < j), strict=True):
                            out[k].append(v)
            return out

        return step

    asked = map_rows(table.select("d", "th", "hashes", "sizes", "least").join(before, ["d", "th"]), make, "d long, th long, block long, key long, other long, key_first boolean")
    first = met.filter("first is not null and d = od and th = oth").select(F.col("line").alias("block"), "od", "oth").distinct()
    known = met.filter("first is not null").select(F.col("line").alias("block")).distinct()
    asked = save(asked, "asked")
    own = asked.join(known, "block", "left_anti").unionByName(asked.join(first.withColumnsRenamed({"od": "d", "oth": "th"}), ["block", "d", "th"]).select(*asked.columns))
    own = save(own.select("d", "th", "key", "other", "key_first").distinct(), "asked-first")
    one = held.select(F.col("line").alias("key"), F.col("d").alias("od"), F.col("th").alias("oth"), F.col("first").alias("key_from"), F.col("last").alias("key_to"))
    two = held.select(F.col("line").alias("other"), F.col("d").alias("od"), F.col("th").alias("oth"), F.col("first").alias("other_from"), F.col("last").alias("other_to"))
    some = own.join(one, "key").filter(LATER)
    in_order = F.when(F.col("key_first"), F.col("key_from") < F.col("other_to")).otherwise(F.col("other_from") < F.col("key_to"))
    return some.join(two, ["other", "od", "oth"]).filter(in_order).select("d", "th", "od", "oth").distinct()


def removals(docs: DataFrame, anchor_words: int = ANCHOR_WORDS, block_words: int = BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """For rows (doc_id, text): (d, th, n_lines, gone) with the places of the lines that go, for all distinct (doc_id, text)."""
    rows = docs.select(key().alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    table = save(lines(rows, anchor_words, block_words).dropDuplicates(["d", "th"]), "lines")
    total = F.aggregate("sizes", F.lit(0), lambda a, x: a + x)
    first = save(table.groupBy("th").agg(F.min("d").alias("first")), "first")
    copies = save(table.select("d", "th", F.size("hashes").alias("n"), total.alias("words")).join(first, "th").filter("d > first"), "copies")
    whole = copies.filter(F.col("words") >= block_words).select("d", "th", F.sequence(F.lit(0), F.col("n") - 1).alias("gone"))
    ones = save(by_ids(table, copies, ["d", "th"], "left_anti"), "ones")
    met = shared(ones)
    few = met.filter(F.col("n") <= rare).select("line", "d", "th")
    close = few.join(few.withColumnsRenamed({"d": "od", "th": "oth"}), "line").filter(LATER).select("d", "th", "od", "oth")
    pairs = close.unionByName(broken_pairs(ones, met)).distinct()
    with_own = save(pairs, "pairs").join(ones.drop("least", "runs", "own"), ["d", "th"])
    owner = ones.select(F.col("d").alias("od"), F.col("th").alias("oth"), F.col("hashes").alias("owned"))

    def make():
        def step(cols):
            gone = [blocks(a, b, sizes, block_words) for a, b, sizes in zip(cols["owned"], cols["hashes"], cols["sizes"], strict=True)]
            return {"d": cols["d"], "th": cols["th"], "gone": gone}

        return step

    aligned = map_rows(with_own.join(owner, ["od", "oth"]).select("d", "th", "hashes", "sizes", "owned"), make, "d long, th long, gone array<int>").filter("size(gone) > 0")
    direct = met.filter("first is not null").filter(LATER).select("d", "th", F.explode(F.sequence("first", "last")).alias("place"))
    each = aligned.select("d", "th", F.explode("gone").alias("place")).unionByName(direct).distinct()
    gone = each.groupBy("d", "th").agg(F.sort_array(F.collect_list("place")).alias("gone")).unionByName(whole)
    return table.select("d", "th", F.size("hashes").alias("n_lines")).join(save(gone, "gone"), ["d", "th"], "left")


def without(text: Column, gone: Column) -> Column:
    """text without its lines at the places of gone, which rise. A native expression: texts don't go to Python workers, and a filter on it starts no more of them."""

    def left(lines: Column) -> Column:
        ends = F.concat(gone, F.array(F.size(lines)))

        def before(end: Column, i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
            return F.slice(lines, start + 1, end - start)

        return F.array_join(F.flatten(F.transform(ends, before)), "\n")

    # one text's lines are split once, as the variable of a lambda
    return F.get(F.transform(F.array(F.split(text, "\n")), left), F.lit(0))


def dedup(docs: DataFrame, counted: str | None = None, **options) -> DataFrame:
    """docs with later repeats of common blocks deleted from text (and n_chars set); all rows and columns come back.

    counted: name of a further column, the number of lines that went.
    """
    with scratch() as keep:
        gone = removals(docs.select("doc_id", "text"), **options).filter("gone is not null")
        gone = save(gone.select(F.col("d").alias("_d"), F.col("th").alias("_th"), F.col("gone").alias("_gone")), "line-removals")
        keep(gone)
    # the caller's columns are held in one, so that their names don't matter
    held = docs.select(F.struct("*").alias("row"), key().alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    held = with_marks(held, gone, ["_d", "_th"], "_th")
    touched = F.col("_gone").isNotNull()
    new = held.select("row", "_gone", F.when(touched, without(F.col("row.text"), F.col("_gone"))).otherwise(F.col("row.text")).alias("_new"))
    row = F.col("row").withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(touched, F.length("_new").cast("long")).otherwise(F.col("row.n_chars")))
    more = [F.when(touched, F.size("_gone")).otherwise(0).cast("long").alias(counted)] if counted else []
    return new.select(row.alias("row"), *more).select("row.*", *([counted] if counted else []))
