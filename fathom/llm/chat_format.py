"""Chat formatting: conversations as one training string each, in Spark expressions only.

A conversation is the rows of one conv_id, ordered by (turn, role, text). Adjacent turns of one role form a block:

    <s>[INST]role[/INST]text<sep/>text</s>

Control strings inside a role or text get a backslash after their first character (one more if they have some), which
`read_back` takes away, so that any text comes back as it was. A null role or text is the empty string. A null conv_id
is a conversation of its own. Repeated rows are turns each. Without rows there are no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, ROLE_END, BETWEEN, CLOSE = "<s>[INST]", "[/INST]", "<sep/>", "</s>"
#: A control string, with the backslashes that escaping has added.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|sep/>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|sep/>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) to (conv_id, formatted, loss_spans); other columns are dropped.

    loss_spans: array of (start, end) in code points of `formatted`, end exclusive, that cover the escaped texts of
    loss_role; empty texts give empty spans.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # pieces: (string, whether the loss counts it); a turn opens its block, or follows a turn of the same role
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.array(
                F.struct(
                    F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(BETWEEN))
                    .otherwise(F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END)))
                    .alias("s"),
                    F.lit(False).alias("loss"),
                ),
                F.struct(escape(t["text"]).alias("s"), (t["role"] == loss_role).alias("loss")),
            ),
        )
    )
    chats = chats.select("conv_id", pieces.alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    spans = F.aggregate(
        "pieces",
        start,
        lambda a, p: F.struct(
            (a["at"] + F.length(p["s"])).alias("at"),
            F.when(
                p["loss"],
                F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(p["s"])).alias("end")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return chats.select("conv_id", F.concat(F.array_join(F.transform("pieces", lambda p: p["s"]), ""), F.lit(CLOSE)).alias("formatted"), spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """From (conv_id, formatted, loss_spans) again the turns: array of (role, text); and the text that the loss counts."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.lit(1) + F.instr(b, ROLE_END) + F.lit(len(ROLE_END) - 1), F.length(b)), BETWEEN, -1),
                lambda t: F.struct(
                    unescape(F.substring(b, F.lit(len(OPEN) + 1), F.instr(b, ROLE_END) - 1 - len(OPEN))).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return chats.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def digest(chats: DataFrame) -> DataFrame:
    """The columns of query op6, read back from the formatted strings."""
    return read_back(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
