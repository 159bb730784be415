r"""Conversations as training text, and back, in Spark expressions alone.

    <|role:user|>
    first text
    <|next|>
    second text of the same role
    <|end|>
    <|role:assistant|>
    answer
    <|end|>

Turns of a conversation are collected, sorted and merged where neighbours have the same role. Marks all
begin with `<|`. In texts and roles a backslash is put after the `<` of anything that looks like `<|`,
`<\|`, `<\\|` and so on, and after the `|` of `|>` in roles; taking one away again restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_END = "\n<|end|>\n"
_NEXT = "\n<|next|>\n"
_ROLE, _ROLE_END = "<|role:", "|>\n"
_SPAN = "array<struct<start:int,end:int>>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(escape_text(role), r"\|(\\*)>", r"|\\$1>")


def _unescape_role(role: Column) -> Column:
    return unescape_text(F.regexp_replace(role, r"\|\\(\\*)>", r"|$1>"))


def formatted(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans: one row for each conversation.

    `turns` has conv_id, turn, role, text; other columns are ignored. Turns are taken by turn number,
    then role and text; null numbers come first. A null text or role is an empty one. Repeated rows are
    turns of their own; rows without conv_id are one conversation. loss_spans are the places, in code
    points of `formatted`, of each text of `trained_role`. The text of a conversation is one value, so
    its turns meet in one task.
    """
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before, after = F.get("turns", i - 1)["role"], F.get("turns", i + 1)["role"]
        goes_on, comes = before.eqNullSafe(t["role"]), after.eqNullSafe(t["role"])
        return F.struct(
            F.when(goes_on, "").otherwise(F.concat(F.lit(_ROLE), _escape_role(t["role"]), F.lit(_ROLE_END))).alias("head"),
            escape_text(t["text"]).alias("body"),
            F.when(comes, _NEXT).otherwise(_END).alias("tail"),
            (t["role"] == trained_role).alias("trained"),
        )

    def step(done: Column, p: Column) -> Column:
        start = done["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + F.length(p["tail"])).alias("at"),
            F.when(p["trained"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
    spans = F.aggregate("pieces", nothing, step, lambda done: done["spans"])
    return pieces.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def _literal(text: str) -> str:
    return rf"\Q{text}\E"


def read_back(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_texts, from rows of `formatted`."""

    def texts(run: Column) -> Column:
        role = F.substring_index(run, _ROLE_END, 1)
        rest = F.substr(run, F.length(role) + len(_ROLE_END) + 1)
        name = _unescape_role(F.substr(role, F.lit(len(_ROLE) + 1)))
        return F.transform(
            F.split(rest, _literal(_NEXT)),
            lambda t: F.struct(name.alias("role"), unescape_text(t).alias("text")),
        )

    runs = F.filter(F.split("formatted", _literal(_END)), lambda r: r != "")
    trained = F.transform(
        "loss_spans",
        lambda s: unescape_text(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])),
    )
    return rows.select(
        "conv_id",
        F.flatten(F.transform(runs, texts)).alias("turns"),
        trained.alias("loss_texts"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
