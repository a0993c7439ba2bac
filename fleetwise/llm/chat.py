"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, and compared with their neighbours in
the array: a turn opens a block where the role before it differs and closes one where the role
after it differs, so adjacent turns of a role share one block, with a mark between their texts. That
merge is linear in the conversation; a fold that appends to its result would copy it at each turn.

A block is ``<|im_start|>role``, a line end, the texts with ``<|im_sep|>`` between them, and
``<|im_end|>`` with a line end. Inside texts and roles a backslash is doubled and ``<|`` becomes
``<`` backslash ``|``, so that no text holds a control string; in roles a line end becomes ``<`` backslash
``n|``. Runs of backslashes are even except where one was put in, which makes the way back certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
SLASH = "\\"


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column) -> Column:
    return _replaced(text, (SLASH, SLASH * 2), ("<|", f"<{SLASH}|"))


def unescaped(text: Column) -> Column:
    return _replaced(text, (f"<{SLASH}|", "<|"), (SLASH * 2, SLASH))


def _escaped_role(role: Column) -> Column:
    return _replaced(escaped(role), ("\n", f"<{SLASH}n|"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(_replaced(role, (f"<{SLASH}n|", "\n")))


def format_conversations(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted``, ``segments`` for the rows ``conv_id``, ``turn``, ``role``, ``text``.

    ``segments`` are the consecutive parts of ``formatted`` (``text``, ``loss``); those with ``loss`` are
    the texts of the role ``learn``, escaped, and make up the loss mask. Turns are sorted by
    ``turn`` (null first), then by role and text, so ties have one order and repeated rows stay.
    Null roles and texts are empty strings. Rows without conv_id form one conversation. An empty
    table gives no rows. Other columns are not looked at.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    talks = talks.select("conv_id", F.sort_array("turns").alias("turns"))

    def parts(t: Column, i: Column) -> Column:
        same_before = F.coalesce(F.get("turns", i - 1)["role"] == t["role"], F.lit(False))
        same_after = F.coalesce(F.get("turns", i + 1)["role"] == t["role"], F.lit(False))
        opening = F.when(same_before, F.lit(SEP)).otherwise(F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n")))
        closing = F.when(same_after, F.lit("")).otherwise(F.lit(END))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(opening, F.lit(False)), piece(escaped(t["text"]), t["role"] == learn), piece(closing, F.lit(False)))

    cut = talks.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def turns_of(formatted: Column) -> Column:
    """The turns (``role``, ``text``) of a formatted conversation, in order."""
    literal = lambda mark: mark.replace("|", r"\|")
    blocks = F.filter(F.split(formatted, literal(END)), lambda b: b != "")

    def texts(block: Column) -> Column:
        line = F.instr(block, "\n")
        role = _unescaped_role(F.substring(block, F.lit(len(START) + 1), line - len(START) - 1))
        body = F.substring(block, line + 1, F.length(block))
        return F.transform(F.split(body, literal(SEP)), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, texts))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digests(talks: DataFrame) -> DataFrame:
    """The registered query's columns, read back from the formatted output."""
    back = talks.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("back"), loss_text(F.col("segments")).alias("lost"))
    line = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("lost").cast("bigint").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
