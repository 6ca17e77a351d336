"""Chat formatting with Spark expressions: one training text a conversation, its loss mask, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import in_blocks, let, starts_of

HEAD, END = "### ", "</turn>\n"
#: What stands for the characters that control strings are made of; the backslash comes first.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_spans): one text a conversation and the spans that are learned.

    Turns are sorted by number, then role, then text (null numbers first); null roles and texts are
    empty. Adjacent turns of one role share one header ``### role:``; every turn ends in ``</turn>``.
    ``#``, ``<`` and backslashes inside texts are written as backslash codes, so no text can hold a
    control string, and reading back is exact. loss_spans has (start, length) in characters of every
    turn whose role is ``learn``. A null conversation id is one conversation. Repeated rows are
    turns of their own. Other columns are not read; no rows give no rows.
    """
    made = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    made = made.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # where a run of one role begins
    made = made.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"])))
    made = made.withColumn(
        "runs",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get("ts", s)["role"].alias("role"),
                F.slice("ts", s + 1, F.coalesce(F.get("starts", k + 1), F.size("ts")) - s).alias("said"),
            ),
        ),
    )
    made = made.withColumn(
        "pieces",
        F.flatten(
            F.transform(
                "runs",
                lambda run: F.transform(
                    run["said"],
                    lambda t, i: F.struct(
                        F.when(i == 0, F.concat(F.lit(HEAD), escape(run["role"], ROLE_ESCAPES), F.lit(":\n"))).otherwise("").alias("head"),
                        escape(t["text"]).alias("body"),
                        (run["role"] == learn).alias("learn"),
                    ),
                ),
            )
        ),
    )
    sizes = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END))
    spans = let(
        starts_of(sizes),
        lambda at: F.transform("pieces", lambda p, i: F.struct(p["learn"].alias("learn"), (F.get(at, i) + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))),
    )
    return made.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["length"])).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as array of (role, text): the exact reverse of the template."""

    def block_turns(b: Column) -> Column:
        body = F.split(F.regexp_extract(b, r"(?s)^[^:]*+:\n(.*)$", 1), END)
        role = unescape(F.regexp_extract(b, r"^[^:]*+", 0), ROLE_ESCAPES)
        return let(role, lambda said_by: let(body, lambda said: F.transform(F.slice(said, 1, F.size(said) - 1), lambda t: F.struct(said_by.alias("role"), unescape(t).alias("text")))))

    return F.flatten(F.transform(F.filter(F.split(formatted, HEAD), lambda b: b != ""), block_turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between. The text is cut for blocks of spans, then for each span."""

    def cut(text: Column, own: Column) -> Column:
        first, last = F.get(own, 0), F.get(own, F.size(own) - 1)
        part = F.substring(text, first["start"] + 1, last["start"] + last["length"] - first["start"])
        return let(part, lambda said: F.array_join(F.transform(own, lambda s: unescape(F.substring(said, s["start"] - first["start"] + 1, s["length"]))), ""))

    learned = let(formatted, lambda text: F.array_join(F.transform(in_blocks(spans), lambda own: cut(text, own)), ""))
    return F.when(F.size(spans) > 0, learned).otherwise("")
