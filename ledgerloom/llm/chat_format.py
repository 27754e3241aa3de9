"""Chat formatting with typed content parts (operator 9, native).

A turn has a role and a list of parts (``PART``). The visitor maps each part
in order: text is escaped and kept, an image, audio or document part becomes
a placeholder, and its reference and expanded token count are recorded:
images one token for each tile of ``TILE`` pixels a side, audio ``AUDIO_RATE``
a second, documents ``PAGE_TOKENS`` a page (unknown sizes: 1 token). A part of
unknown type counts as text.

Template: ``<|turn|>role<|body|>text<|end|>\\n`` for every turn. Escaping puts
one more backslash after the first sign of each control string (``<|``,
``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so a marker never occurs in an
escaped text and taking one backslash away restores it.

Output, one row a conversation: conv_id, formatted, n_turns, mask (code-point
spans [start, stop) of the assistant's bodies, for the loss, and the same
spans in UTF-8 bytes, by which a reader reaches them at once), attachments
(turn number, kind, ref, n_tokens, in order) and attachment_tokens.
``read_back`` splits ``formatted`` at the markers into roles and texts, and
takes the text under the mask by its bytes: the time grows with the length of
a conversation, not with its square.

Turns are ordered by turn, then role and text (ties and repeated rows keep
their place, each is a turn). Null text, role or parts: empty. A null conv_id
is a conversation. One conversation is one string by definition and is built
in one row. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import pick

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256

#: The signs that begin a control string, and what may follow them.
STARTS, RESTS = r"([<\[])", r"(\||/?s>|/?INST\])"

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(STARTS + r"(\\*)" + RESTS), F.lit(r"$1\\$2$3"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(STARTS + r"\\(\\*)" + RESTS), F.lit("$1$2$3"))


def visit(part: Column) -> Column:
    """The text that stands for a part."""
    out = None
    for kind, mark in PLACEHOLDERS.items():
        out = (F if out is None else out).when(part["type"] == kind, F.lit(mark))
    return out.otherwise(escaped(F.coalesce(part["text"], F.lit(""))))


def part_tokens(part: Column) -> Column:
    tiles = F.ceil(part["width"] / TILE) * F.ceil(part["height"] / TILE)
    n = (F.when(part["type"] == "image", tiles).when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
         .when(part["type"] == "document", part["pages"].cast("bigint") * PAGE_TOKENS))
    return F.coalesce(n, F.lit(1).cast("bigint"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def format_chats(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Formatted conversations of ``turns`` (conv_id, turn, role, parts)."""
    turns = pick(turns, "conv_id", "turn", "role", "parts")
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.array_join(F.transform(parts, visit), "").alias("body"),
                        F.transform(F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")).isin(*PLACEHOLDERS)),
                                    lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("n_tokens"))).alias("files"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY))
    laid = flat.withColumn("head", head).withColumns({
        "chars": (F.length("head") + F.length("body") + len(END)).cast("bigint"),
        "bytes": (F.octet_length("head") + F.octet_length("body") + len(END)).cast("bigint")})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    before, before_bytes = (F.coalesce(F.sum(c).over(so_far), F.lit(0).cast("bigint")) for c in ("chars", "bytes"))
    placed = laid.select("conv_id", F.row_number().over(order).alias("at"), F.col("head"), "body", "files",
                         F.when(F.col("role") == learn_role, F.struct(
                             (before + F.length("head")).alias("start"), (before + F.length("head") + F.length("body")).alias("stop"),
                             (before_bytes + F.octet_length("head")).alias("start_byte"),
                             (before_bytes + F.octet_length("head") + F.octet_length("body")).alias("stop_byte"))).alias("span"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "head", "body", "files", "span"))).alias("t"))
    attachments = F.flatten(F.transform("t", lambda t: F.transform(
        t["files"], lambda f: F.struct(t["at"].alias("turn"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["n_tokens"].alias("n_tokens")))))
    return whole.select(
        "conv_id", F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size("t").cast("bigint").alias("n_turns"),
        F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("mask"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda n, f: n + f["n_tokens"]).alias("attachment_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and learned (the unescaped text under the mask), parsed from ``formatted``."""
    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, BODY, 1)
        text = F.substr(piece, F.length(role) + len(BODY) + 1, F.length(piece) - F.length(role) - len(BODY) - len(END))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p: F.length(p) > 0)
    # a character's place in a text is found by counting from the start, a byte's at once; the one-element array
    # makes the bytes once for all spans
    raw = F.array(F.col("formatted").cast("binary"))
    learned = F.transform(raw, lambda r: F.array_join(F.transform("mask", lambda s: unescaped(
        F.substr(r, (s["start_byte"] + 1).cast("int"), (s["stop_byte"] - s["start_byte"]).cast("int")).cast("string"))), ""))[0]
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"), learned.alias("learned"),
                        F.length("formatted").cast("bigint").alias("formatted_chars"))
