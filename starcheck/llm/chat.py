"""Chat formatting in budgeted, turn-aligned windows with loss masks.

The prefix sums of a conversation's turn tokens choose the windows. With room for R tokens, a turn that lies
within the k-th stretch of R tokens is in that stretch's window, and one that crosses into another has a
window to itself between the two. So a window holds at most R tokens or one turn, and every turn knows its
window from its own prefix sum. R is what the budget leaves beside the system turn and the history.

A window repeats the system turn and the last turns before it, up to `history` tokens. Repeated turns are
context: only the texts of assistant turns that are new in a window are under its loss mask, so each is a
target exactly once.

Prefix sums are summed by blocks of turn numbers first, so that a conversation with very many turns is not
one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcheck.llm.words import WORD

START, MIDDLE, END = "<|start|>", "<|text|>", "<|end|>\n"
#: Strings that steer some chat template or other. A backslash after their first sign takes them apart.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
BUDGET, HISTORY = 2048, 512
TURN_TOKENS = 4
TURNS = 64
_CONV = ["absent", "conv"]


def escape(text: Column) -> Column:
    """Double each backslash, then put one into each control string; `unescape` undoes it."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    for c in reversed(CONTROLS):
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _turns(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    turn = F.col("turn").cast("long")
    return conversations.select(
        conv.isNull().alias("absent"),
        F.coalesce(conv, F.lit(0)).alias("conv"),
        turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
        F.coalesce(F.floor(turn / TURNS), F.lit(-(2**62))).alias("block"),
        (F.regexp_count(text, F.lit(WORD)) + TURN_TOKENS).cast("long").alias("tokens"),
    )


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its number `at`, the tokens before it, the room and its stretch."""
    so_far = (
        Window.partitionBy(*_CONV, "block")
        .orderBy("turn", "role", "text")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    turns = turns.withColumns({"at": F.count("*").over(so_far), "up_to": F.sum("tokens").over(so_far)})
    blocks = turns.groupBy(*_CONV, "block").agg(
        F.count("*").alias("n"),
        F.sum("tokens").alias("sum"),
        F.max(F.when((F.col("at") == 1) & (F.col("role") == "system"), F.col("tokens"))).alias("head"),
    )
    order = Window.partitionBy(*_CONV).orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *_CONV,
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"),
        F.coalesce(F.first("head").over(order), F.lit(0)).alias("system_tokens"),
    )
    room = F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(1))
    turns = turns.join(blocks, [*_CONV, "block"]).select(
        *_CONV,
        "role",
        "text",
        (F.col("n_before") + F.col("at")).alias("at"),
        (F.col("before") + F.col("up_to") - F.col("tokens")).alias("start"),
        "tokens",
        "system_tokens",
        room.alias("room"),
    )
    stretch = F.floor(F.col("start") / F.col("room"))
    crosses = F.floor((F.col("start") + F.col("tokens") - 1) / F.col("room")) > stretch
    is_system = (F.col("at") == 1) & (F.col("system_tokens") > 0)
    return turns.withColumns(
        {"stretch": 2 * stretch + crosses.cast("long"), "is_system": is_system}
    )


def _parts(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """A row for each window that has a turn, as one of its own (back = 0) or as history.

    A turn of a window lies less than the room after the window's first one, so a window that repeats it
    starts less than room and history after that one. Turns have TURN_TOKENS at least, which bounds `later`.
    """
    stretches = placed.groupBy(*_CONV, "stretch").agg(F.min("start").alias("first"))
    order = Window.partitionBy(*_CONV).orderBy("stretch")
    ahead = Window.partitionBy(*_CONV).orderBy("first").rangeBetween(1, max(budget, history + 1))
    stretches = stretches.select(
        *_CONV,
        "stretch",
        F.row_number().over(order).alias("window"),
        F.collect_list("first").over(ahead).alias("later"),
    )
    reaches = lambda k: (k == 0) | (
        ~F.col("is_system") & F.coalesce(F.get("later", k - 1) - F.col("start") <= history, F.lit(False))
    )
    return placed.join(stretches, [*_CONV, "stretch"]).select(
        *_CONV,
        "at",
        "role",
        "text",
        "is_system",
        F.col("window").alias("own"),
        F.explode(F.filter(F.sequence(F.lit(0), F.size("later")), reaches)).alias("back"),
    )


def format_windows(
    conversations: DataFrame, *, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """One row per window: conv_id, window, text, n_context, n_turns, loss_spans.

    `text` holds the turns with their marks; its first n_context turns are repeated, n_turns are new.
    loss_spans has start (from 0) and length, in code points of `text`, of each stretch under the loss
    mask. Turns are ordered by turn, then role and text; a null turn comes first, repeated rows are turns
    of their own. A null role or text counts as empty. Rows without conv_id are one conversation. A first
    turn of the role system is repeated in each window. A turn over the room is not cut: its window is
    longer than the budget. Other columns are ignored; an empty table gives an empty result.
    """
    placed = _placed(_turns(conversations), budget, history)
    parts = _parts(placed, budget, history).select(
        *_CONV,
        (F.col("own") + F.col("back")).alias("window"),
        F.struct(
            "at",
            (F.col("back") == 0).alias("new"),
            F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE)).alias("head"),
            escape(F.col("text")).alias("body"),
            ((F.col("back") == 0) & (F.col("role") == "assistant")).alias("target"),
        ).alias("part"),
        "is_system",
    )
    windows = parts.groupBy(*_CONV, "window").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    systems = parts.filter("is_system").select(
        *_CONV, F.array(F.struct("part.at", F.lit(False).alias("new"), "part.head", "part.body", "part.target")).alias("system")
    )
    windows = windows.join(systems, _CONV, "left").select(
        *_CONV,
        "window",
        F.when(
            (F.col("window") > 1) & F.col("system").isNotNull(), F.concat("system", "parts")
        ).otherwise(F.col("parts")).alias("parts"),
    )
    piece = lambda p: F.concat(p["head"], p["body"], F.lit(END))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(piece(p))).cast("long").alias("at"),
            F.when(
                p["target"],
                F.array_append(
                    a["spans"],
                    F.struct(
                        (a["at"] + F.length(p["head"])).cast("long").alias("start"),
                        F.length(p["body"]).cast("long").alias("length"),
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )["spans"]
    new = F.size(F.filter("parts", lambda p: p["new"]))
    return windows.select(
        F.when(~F.col("absent"), F.col("conv")).alias("conv_id"),
        "window",
        F.array_join(F.transform("parts", piece), "").alias("text"),
        (F.size("parts") - new).alias("n_context"),
        new.alias("n_turns"),
        spans.alias("loss_spans"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.split(text, r"<\|end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(START) + 1, F.length(p)), MIDDLE, 1)).alias("role"),
            unescape(F.substring_index(p, MIDDLE, -1)).alias("text"),
        ),
    )


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    parts = F.transform(spans, lambda s: unescape(F.substring(text, s["start"].cast("int") + 1, s["length"].cast("int"))))
    return F.array_join(parts, "")


def digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read back from their text and masks."""
    turns = read_turns(F.col("text"))
    new = F.slice(turns, F.col("n_context") + 1, F.greatest(F.col("n_turns"), F.lit(1)))
    read = windows.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            loss_text(F.col("text"), F.col("loss_spans")).alias("loss"),
        ).alias("part"),
        F.size(turns).alias("n_read"),
        "n_context",
        F.length("text").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum((F.col("n_read") - F.col("n_context")).cast("long")).alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
