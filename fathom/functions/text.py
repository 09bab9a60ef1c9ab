"""Text functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fathom.functions.fixed_values import CLASSIC_STOP_WORDS, FOLDER_STOP_WORDS, FTS_STOP_WORDS, QUERY_STOP_WORDS, SYNONYMS

def _latin_marks() -> tuple[str, str]:
    """Lower-case Latin letters with a mark, and the bare letters that they decompose to."""
    import unicodedata

    marked = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


LATIN_MARKS = _latin_marks()
CJK = r"[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]"
PUNCTUATION = r"[\p{Pc}\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Po}]"
#: The places behind sentences.
SENTENCE_END = '(?<=[。！？.!?]["」])|(?<=[。！？.!?])(?!["」])'
WORD_BREAK = r"[ 　,，.。!！?？\n\t\r]+"


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def tokens(text: Column, stop_words=CLASSIC_STOP_WORDS) -> Column:
    """Lower-case terms: split at white space and punctuation, each CJK character alone, without stop words."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(CJK), F.lit(" $0 "))
    spaced = F.lower(F.regexp_replace(spaced, F.lit(PUNCTUATION), F.lit(" ")))
    return F.filter(F.split(spaced, r"\s+"), lambda t: (t != "") & ~t.isin(*stop_words) if stop_words else t != "")


def fts_tokens(text: Column) -> Column:
    """Terms as the full-text index keeps them: `tokens` with its stop words, split again at what is no letter or digit, without diacritics of Latin letters."""
    plain = F.array_join(tokens(text, FTS_STOP_WORDS), " ")
    return F.filter(F.split(F.translate(plain, *LATIN_MARKS), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def count_tokens(text: Column) -> Column:
    """Estimate from character classes, each rounded down by itself."""
    n = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    cjk = F.length(text) - n(r"[\u4e00-\u9fff]")
    letters, digits = F.length(text) - n("[A-Za-z]"), F.length(text) - n("[0-9]")
    other = F.length(text) - cjk - letters - digits
    return (F.floor(cjk / 1.5) + F.floor(letters / 4) + F.floor(digits / 3) + F.floor(other / 2)).cast("long")


def estimate_tokens(text: Column) -> Column:
    """The coarser estimate that budgets use: CJK by 1.5, whole fours of the rest."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, r"[\u4e01-\u9ffe]", ""))
    return F.floor(cjk / 1.5 + F.floor((F.length(text) - cjk) / 4)).cast("long")


def client_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 2).cast("long")


def sentences(text: Column) -> Column:
    """Sentences with their end marks and one closing quote."""
    return F.filter(F.transform(F.split(text, SENTENCE_END, -1), lambda s: F.trim(s)), lambda s: s != "")


def truncate_by_sentences(text: Column, budget: Column | int, counter=estimate_tokens) -> Column:
    """As many whole sentences from the start as the token budget allows, each followed by a full stop."""
    parts = F.filter(F.split(text, r"[。！？.!?]"), lambda s: s != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"))

    def step(a: Column, s: Column) -> Column:
        full = a["full"] | (a["used"] + counter(s) > budget)
        out = F.when(full, a["out"]).otherwise(F.concat(a["out"], s, F.lit("。")))
        return F.struct(out.alias("out"), F.when(full, a["used"]).otherwise(a["used"] + counter(s)).alias("used"), full.alias("full"))

    return F.aggregate(parts, start, step, lambda a: a["out"])


def fts_query(text: Column) -> Column:
    """The full-text query of a text: its terms quoted, any of which may match; the text itself without terms."""
    terms = tokens(text, FTS_STOP_WORDS)
    quoted = F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(F.size(terms) == 0, text).otherwise(F.array_join(quoted, " OR "))


def wordpieces(text: Column, vocabulary: list[str], most: int = 512, per_word: int = 64) -> Column:
    """WordPiece ids of a text between [CLS] and [SEP], at most `most`: lower case, each CJK character and mark alone, then the
    longest piece of the vocabulary again and again (the later ones begin with ##); [UNK] for a word without such a split, or longer than per_word."""

    @F.pandas_udf("array<int>")
    def run(texts):
        import re

        at = {w: i for i, w in enumerate(vocabulary)}
        word = re.compile(r"[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]|\w+|[^\w\s]")

        def split(w):
            out, i = [], 0
            while i < len(w):
                j = next((j for j in range(len(w), i, -1) if ("##" if i else "") + w[i:j] in at), 0)
                if not j or len(w) > per_word:
                    return [at["[UNK]"]]
                out.append(at[("##" if i else "") + w[i:j]])
                i = j
            return out

        def one(t):
            ids = [i for w in word.findall(re.sub(f"({CJK})", r" \1 ", (t or "").lower())) for i in split(w)]
            return [at["[CLS]"], *ids[: most - 2], at["[SEP]"]]

        return texts.map(one)

    return run(text)


def synonyms(word: Column) -> Column:
    known = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), strings(v))))
    return F.coalesce(F.try_element_at(known, word), F.array().cast("array<string>"))


def is_stop_word(word: Column) -> Column:
    return word.isin(*QUERY_STOP_WORDS)


def query_words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def expand_query(text: Column) -> Column:
    """Each word, followed by its first two synonyms unless it is short or a stop word."""
    more = lambda w: F.when((F.length(w) >= 2) & ~is_stop_word(w), F.slice(synonyms(w), 1, 2)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.flatten(F.transform(query_words(text), lambda w: F.concat(F.array(w), more(w)))), " ")


def keywords(text: Column) -> Column:
    return F.filter(query_words(text), lambda w: (F.length(w) > 1) & ~is_stop_word(w))


def analyze_intent(text: Column) -> Column:
    """The first kind whose mark the text has."""
    has = lambda *marks: text.rlike("|".join(marks))
    return F.when(has("如何", "怎么"), "HowTo").when(has("什么", "定义"), "Definition").when(has("为什么"), "Explanation").when(has("例子", "示例"), "Example").otherwise("General")


def key_sentences(text: Column) -> Column:
    """First, last and longest sentence, each once in that order of choice."""

    def places(all_of: Column) -> Column:
        longest = F.array_min(F.transform(all_of, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"))))["i"]
        return F.struct(all_of.alias("all"), F.get(all_of, F.lit(0)).alias("first"), F.get(all_of, F.size(all_of) - 1).alias("last"), F.get(all_of, longest).alias("longest"))

    def choice(x: Column) -> Column:
        chosen = F.when(F.size(x["all"]) > 1, F.array(x["first"], x["last"])).otherwise(F.array(x["first"]))
        chosen = F.when((F.size(x["all"]) > 2) & (x["longest"] != x["first"]) & (x["longest"] != x["last"]), F.concat(chosen, F.array(x["longest"]))).otherwise(chosen)
        return F.when(F.size(x["all"]) == 0, F.array().cast("array<string>")).otherwise(chosen)

    # arrays of one make names for the sentences and for what is found in them, which else are found anew wherever they are used
    return F.get(F.transform(F.transform(F.array(sentences(text)), places), choice), F.lit(0))


def folder_keywords(folder: Column) -> Column:
    parts = F.filter(F.split(folder, r"[/\\]"), lambda p: (p != "") & ~F.lower(p).isin(*FOLDER_STOP_WORDS))
    return F.array_join(F.filter(F.transform(parts, lambda p: F.translate(p, "-_", "  ")), lambda p: F.length(p) > 1), " ")


def enhance(content: Column, title: Column, heading: Column, tags: Column, folder: Column, long_over: int = 800) -> Column:
    """Content under labelled lines of its title, section, tags, field and key sentences."""
    # an array of one makes a name for the value, which else is made once to look at and once to write
    line = lambda label, value: F.get(F.transform(F.array(value), lambda v: F.when(v != "", F.concat(F.lit(f"[{label}] "), v))), F.lit(0))
    points = F.when(F.length(content) > long_over, F.array_join(F.slice(key_sentences(content), 1, 3), " "))
    return F.concat_ws("\n", line("标题", title), line("章节", heading), line("标签", F.array_join(tags, " ")), line("领域", folder_keywords(folder)), line("要点", points), content)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def node_id(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def to_wsl(path: Column) -> Column:
    r"""X:\a to /mnt/x/a; other paths as they are."""
    drive = F.regexp_extract(path, r"^([A-Za-z]):", 1)
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.translate(F.substring(path, F.lit(3), F.length(path)), "\\", "/"))).otherwise(path)


def from_wsl(path: Column) -> Column:
    drive = F.regexp_extract(path, r"^/mnt/([a-z])(?:/|$)", 1)
    return F.when(drive != "", F.concat(F.upper(drive), F.lit(":"), F.translate(F.substring(path, F.lit(7), F.length(path)), "/", "\\"))).otherwise(path)


def extract_title(text: Column, path: Column) -> Column:
    heading = F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1))
    return F.when(heading != "", heading).otherwise(file_stem(path))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def model_table(name: Column) -> Column:
    return F.concat(F.lit("vec_"), F.regexp_replace(name, "[^A-Za-z0-9]", "_"))


def with_prefix(text: Column, mode: str, enabled: bool = True) -> Column:
    """text as a model with asymmetric inputs wants it: mode query, passage or document."""
    prefix = {"query": "query: ", "passage": "passage: ", "document": "passage: "}[mode]
    return F.concat(F.lit(prefix), text) if enabled else text


def line_link(path: Column, start: Column, end: Column, shown: Column | None = None) -> Column:
    stem = F.regexp_replace(path, r"\.md$", "")
    lines = F.when(end > start, F.concat(F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))).when(start > 0, F.concat(F.lit("#L"), start.cast("string"))).otherwise("")
    label = F.when(F.coalesce(shown, F.lit("")) != "", F.concat(F.lit("|"), shown)).otherwise("") if shown is not None else F.lit("")
    return F.concat(F.lit("[["), stem, lines, label, F.lit("]]"))


def section_link(path: Column, heading: Column) -> Column:
    return F.concat(F.lit("[["), F.regexp_replace(path, r"\.md$", ""), F.lit("#"), F.regexp_replace(F.regexp_replace(heading, "/", " > "), " ", "%20"), F.lit("]]"))


def parse_link(link: Column) -> Column:
    """(file, start_line, end_line, heading, block, shown) of a [[link]]."""
    inner = F.regexp_extract(link, r"^!?\[\[(.*)\]\]$", 1)
    target, part = F.substring_index(inner, "|", 1), None
    part = F.when(F.instr(target, "#") > 0, F.regexp_extract(target, r"#(.*)$", 1)).otherwise("")
    lines = r"^L(\d+)(?:-L(\d+))?$"
    number = lambda i: F.expr("int(null)") if i is None else F.regexp_extract(part, lines, i).try_cast("int")
    block = F.regexp_extract(part, r"^\^(.+)$", 1)
    plain = (part != "") & ~part.rlike(lines) & ~part.startswith("^")
    return F.struct(
        F.substring_index(target, "#", 1).alias("file"),
        number(1).alias("start_line"),
        F.coalesce(number(2), number(1)).alias("end_line"),
        F.when(plain, part).alias("heading"),
        F.when(block != "", block).alias("block"),
        F.when(F.instr(inner, "|") > 0, F.regexp_extract(inner, r"\|(.*)$", 1)).alias("shown"),
    )


def characters(text: Column) -> Column:
    """The characters of a text, split once; places in the array are found at once, those in the text by counting from its start."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def bigrams(text: Column) -> Column:
    """Sorted character pairs, with repeats, of the text without white space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")

    def pairs(c: Column) -> Column:
        return F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.concat(x, y))

    # an array of one makes a name for the characters
    return F.when(F.length(bare) < 2, F.array().cast("array<string>")).otherwise(F.sort_array(F.get(F.transform(F.array(characters(bare)), pairs), F.lit(0))))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Common over united elements of two arrays with repeats; 0 when either is empty."""
    counted = lambda x: F.map_from_entries(F.transform(F.array_distinct(x), lambda e: F.struct(e, F.size(F.filter(x, lambda y: y == e)))))
    other = counted(b)
    common = F.aggregate(F.map_entries(counted(a)), F.lit(0), lambda n, e: n + F.least(e["value"], F.coalesce(F.try_element_at(other, e["key"]), F.lit(0))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))
