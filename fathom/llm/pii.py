"""PII: base patterns, then terms that disclose protected entities by corpus co-occurrence; Spark expressions only.

Base kinds are found leftmost and without overlap per kind; matches that fail a kind's test are dropped, not retried.
The patterns here match what the plain ones match, but without nested repeats (whose matcher recurses on long runs) and
without restarts inside a run (which would be quadratic): separators that can't belong to a match are first replaced by
private characters of the same length.

A protected entity is the value of a base span that occurs in at least MIN_CONTEXTS contexts, which differ in the AROUND
characters before or after the value: near copies of a text are one context. A term is a word of at least MIN_LENGTH
characters. With counts over the distinct texts of the corpus, the disclosure of e by t is PMI(t, e) / IC(e) = 1 +
log P(e | t) / IC(e): 1 means that the term gives the entity away. A term with disclosure of at least THRESHOLD, which
stands with the entity in at least MIN_CONTEXTS contexts, becomes spans of kind `term` in each text that holds both,
except where it overlaps a base span. `sanitize` generalises base spans to their kind and removes terms.

Offsets are code points, end exclusive. A null text is empty and has no spans. Copies of a text count once in the
statistics, whatever their doc_ids, and all get its spans. Repeated rows get a result each; a null doc_id is as any other.
Columns other than text come back from `sanitize` as they are, whatever their names. Without documents there is no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm import text_stats
from fathom.llm.storage import by_ids, save, small_join

MIN_CONTEXTS, AROUND, MIN_LENGTH, THRESHOLD = 3, 20, 4, 0.8
#: Private characters: for separators that can't belong to a match; and for that character where the text itself has it.
MASK, OTHER = "\ue000", "\ue001"
KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int>>"


#: Elements that `scanned` puts together at once.
CHUNK = 256


def scanned(items: Column, start: Column, kind: str, step) -> Column:
    """The elements, of type `kind`, that step(state, item) gives from first to last with a next state; null elements are left out.

    Arrays grow by copying, so elements are put together in chunks, and the chunks in the end: the work is nearly linear.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def one(a: Column, x: Column) -> Column:
        at, element = step(a["at"], x)
        return F.struct(at.alias("at"), F.when(element.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(element))).alias("out"))

    def chunk(a: Column, part: Column) -> Column:
        made = F.aggregate(part, F.struct(a["at"].alias("at"), none.alias("out")), one)
        # an array of one makes a name for what is used more than once
        return F.get(F.transform(F.array(made), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out"))), F.lit(0))

    parts = F.get(F.transform(F.array(items), lambda x: F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK)))), F.lit(0))
    return F.aggregate(parts, F.struct(start.alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out")), chunk, lambda a: F.flatten(a["out"]))


SPAN = "struct<kind:string,start:int,end:int,value:string>"


def spans_of(matches: Column, gaps: Column, kind: str) -> Column:
    """Spans of matches with their text, from them and the text between them."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.when(x["m"].isNull(), at).otherwise(end), F.when(x["m"].isNotNull(), span)

    return scanned(F.arrays_zip(matches.alias("m"), gaps.alias("g")), F.lit(0), SPAN, step)


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def found(masked: Column, pattern: str, kind: str, holds) -> Column:
    """Spans of `pattern` in `masked` whose text passes `holds`; of what `holds` looks at nothing is masked."""
    matches = F.regexp_extract_all(masked, F.lit(pattern), F.lit(0))
    passed = bare(F.filter(spans_of(matches, F.split(masked, pattern, -1), kind), lambda s: holds(s["value"])))
    return F.when(masked.rlike(pattern), passed).otherwise(F.expr(f"cast(array() as {SPANS})"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of `value` are 12 to 19 and pass the Luhn test."""
    number = F.reverse(digits(value))

    def part(i: Column) -> Column:
        d = F.substring(number, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(number) - 1), part), F.lit(0), lambda a, x: a + x)
    return F.length(number).between(12, 19) & (total % 10 == 0)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with text t, plus arrays of spans by kind."""
    masked_mail = F.regexp_replace(F.translate("t", MASK, OTHER), r"\.(?![A-Za-z0-9-])", MASK)
    masked_card = F.regexp_replace("t", r"[ -](?![0-9])", MASK)
    email = found(F.col("mail"), r"(?:(?<![A-Za-z0-9._%+\x{E000}-])|\G)[A-Za-z0-9._%+\x{E000}-]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "email", lambda v: F.lit(True))
    ip = found(F.col("t"), r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+", "ip", lambda v: ~F.exists(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.ltrim(p, F.lit("0")).try_cast("int") > 255)))
    card = found(F.col("dashed"), r"[0-9][0-9 -]+", "card", luhn)
    phone = found(F.col("t"), r"\+[0-9][\x20().0-9-]+[0-9]", "phone", lambda v: F.length(digits(v)).between(9, 15))
    none = F.expr(f"cast(array() as {SPANS})")
    kept = docs.columns
    one = docs.select(*kept, F.when(F.instr("t", "@") > 0, masked_mail).alias("mail"), F.when(F.col("t").rlike("[0-9]{2}|[0-9][ -][0-9]"), masked_card).alias("dashed"))
    return one.select(
        *kept,
        F.when(F.col("mail").isNull(), none).otherwise(email).alias("email"),
        F.when(F.instr("t", ".") == 0, none).otherwise(ip).alias("ip"),
        F.when(F.col("dashed").isNull(), none).otherwise(card).alias("card"),
        F.when(F.instr("t", "+") == 0, none).otherwise(phone).alias("phone"),
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(*arrays: Column) -> Column:
    """All spans by start, then by kind in the order given."""
    ranked = F.flatten(F.array(*(F.transform(a, lambda s, k=k: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))) for k, a in enumerate(arrays))))
    return F.transform(F.sort_array(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def disclosing_terms(base: DataFrame, texts: DataFrame, min_contexts: int = MIN_CONTEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (th, terms): the terms to remove in each text; from (th, e, ctx) of entities and the distinct texts (th, t).

    Joint counts are made only over texts with an entity of enough contexts, term counts over the corpus, all with
    partial sums; what is joined is written first, so that Spark can split hot keys.
    """
    entities = base.groupBy("e").agg(F.count_distinct("ctx").alias("n_ctx"), F.count_distinct("th").alias("n_e"))
    entities = save(entities.filter(F.col("n_ctx") >= min_contexts), "pii-entities")
    held = save(by_ids(base, entities, "e"), "pii-held")
    holders = save(held.select("th").distinct(), "pii-holders")
    term = F.explode(F.array_distinct(F.filter(text_stats.words(F.col("t")), lambda w: F.length(w) >= MIN_LENGTH)))
    near = save(by_ids(texts, holders, "th").select("th", term.alias("term")), "pii-near")
    joint = near.join(held, "th").groupBy("e", "term").agg(F.count_distinct("ctx").alias("n_ctx"), F.count_distinct("th").alias("n_te"))
    joint = save(joint.filter(F.col("n_ctx") >= min_contexts).drop("n_ctx"), "pii-joint")
    n = F.lit(float(max(2, texts.count())))
    disclosure = lambda n_t: 1 + F.log(F.col("n_te") / F.col(n_t)) / F.log(n / F.least(F.col("n_e"), n - 1))
    wanted = save(joint.select("term").distinct(), "pii-terms")
    # counted before the join: how many rows are wanted grows with the entities and the texts, what is counted doesn't; an
    # inner join, since Spark would move a semi-join below the aggregation
    counts = save(small_join(texts.select(term.alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), wanted, "term"), "pii-counts")
    joint = joint.join(entities.select("e", "n_e"), "e")
    flagged = save(joint.join(counts, "term").filter(disclosure("n_t") >= threshold).select("e", "term"), "pii-flagged")
    return near.join(held.select("th", "e"), "th").join(flagged, ["e", "term"]).groupBy("th").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def term_spans(terms: Column, text: Column) -> Column:
    """Spans of whole words of `text` that are among `terms`."""
    quoted = F.array_join(F.transform(terms, lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}_])", r"\\$1")), "|")
    pattern = F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), quoted, F.lit(r")(?![^\x20\x09-\x0D])"))
    return bare(spans_of(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1), "term"))


def characters(text: Column) -> Column:
    """The characters of a text, split once: places in the array are found at once, those in the text by counting from its start."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def part(chars: Column, start: Column, end: Column) -> Column:
    """The text from start to end, cut to what there is."""
    start = F.greatest(start, F.lit(0))
    return F.array_join(F.slice(chars, start + 1, F.greatest(end - start, F.lit(0))), "")


def detect(docs: DataFrame) -> DataFrame:
    """Rows with doc_id and text to (doc_id, th, email, ip, card, phone, base, term): arrays of (kind, start, end).

    th: hash of the text. base: the spans of the four kinds by start, then kind; term: what the corpus adds.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    spans = F.flatten(F.array(*KINDS))
    value = lambda c: lambda s: F.struct(
        F.xxhash64(s["kind"], part(c, s["start"], s["end"])).alias("e"),
        F.xxhash64(part(c, s["start"] - AROUND, s["start"]), part(c, s["end"], s["end"] + AROUND)).alias("ctx"),
    )
    # an array of one makes a name for the characters
    values = F.get(F.transform(F.array(characters(F.col("t"))), lambda c: F.transform("every", value(c))), F.lit(0))
    base = base_spans(rows).withColumn("every", spans)
    base = save(base.select("doc_id", "th", *KINDS, F.when(F.size("every") > 0, values).alias("values")), "pii-base")
    repeated = save(base.groupBy("th").count().filter("count > 1").select("th"), "pii-repeated")
    once = save(by_ids(rows, repeated, "th").select("th", "t").dropDuplicates(["th"]), "pii-once")
    texts = by_ids(rows, repeated, "th", "left_anti").select("th", "t").unionByName(once)
    entities = save(base.select("th", F.explode("values").alias("v")).select("th", "v.e", "v.ctx").distinct(), "pii-values")
    terms = save(disclosing_terms(entities, texts), "pii-disclosing")
    spotted = by_ids(texts, save(terms.select("th"), "pii-spotted"), "th").join(terms, "th")
    spotted = save(spotted.select("th", term_spans(F.col("terms"), F.col("t")).alias("term")), "pii-term-spans")
    every = ordered(*(F.col(k) for k in KINDS))
    outside = F.filter(F.coalesce("term", F.expr(f"cast(array() as {SPANS})")), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return base.join(spotted, "th", "left").select("doc_id", "th", *KINDS, every.alias("base"), "term").withColumn("term", outside)


def sanitize(docs: DataFrame, detected: DataFrame) -> DataFrame:
    """docs with text sanitised: base spans become [KIND], terms are removed; where base spans overlap, the first stays."""
    spans = F.sort_array(F.transform(F.concat("base", "term"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    piece = lambda at, s: F.struct(at.alias("from"), s["start"].alias("to"), F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("label"))
    step = lambda at, s: (F.when(s["start"] < at, at).otherwise(s["end"]), F.when(s["start"] >= at, piece(at, s)))
    pieces = scanned(F.col("spans"), F.lit(0), "struct<from:int,to:int,label:string>", step)
    last = F.struct(F.aggregate("spans", F.lit(0), lambda at, s: F.when(s["start"] < at, at).otherwise(s["end"])).alias("from"), F.length("t").alias("to"), F.lit("").alias("label"))
    write = lambda c: F.array_join(F.transform(F.concat(pieces, F.array(last)), lambda p: F.concat(part(c, p["from"], p["to"]), p["label"])), "")
    # an array of one makes a name for the characters
    text = F.get(F.transform(F.array(characters(F.col("t"))), write), F.lit(0))
    by_text = detected.select("th", spans.alias("spans")).dropDuplicates(["th"]).filter("size(spans) > 0")
    # the caller's columns are held in one, so that their names don't matter
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), t.alias("t"), F.xxhash64(t).alias("th")).join(by_text, "th", "left")
    return rows.select(F.col("row").withField("text", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(text)).alias("row")).select("row.*")


def digest(detected: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return detected.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(ordered(F.col("base"), F.col("term"))).alias("spans"),
    )
