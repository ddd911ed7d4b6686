"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it as context, then the turn itself, of which
only the text is trainable.  A conversation that ends in another role, or has no assistant turn, gets one more
row without trainable text, so that its last row always holds the whole conversation.

A turn is written ``<|role|>`` newline, text, ``<|end|>`` newline.  Inside roles and texts ``&``, ``<`` and
``>`` are written ``&amp;``, ``&lt;`` and ``&gt;``, so no text can hold a marker, and ``unescape`` restores it.

Turns are ordered by number; turns with the same number by role and text.  Null roles and texts are empty; a null
turn number sorts first; null ``conv_id`` is one conversation.  A conversation must fit into a row, as its last
example holds all of it; examples of one conversation are made next to each other without a further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
#: Characters that are escaped in roles and texts; the ampersand is first in, last out.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role), F.lit("|>\n"))


def examples(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """``conv_id``, ``example`` (index of its last turn), ``last``, ``formatted``, and ``loss_start`` and ``loss_len`` in
    code points of ``formatted`` (both 0 where nothing is trainable)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("t"))
    shown = convs.select("conv_id", F.transform("t", lambda x: F.struct(
        (x.role == trainable).alias("train"), _head(x.role).alias("head"), escape(x.text).alias("body"))).alias("t"))
    target = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.col("t")[i].train | (i == F.size("t") - 1))
    one = shown.select("conv_id", "t", F.explode(target).alias("example"))
    context = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("example")), lambda x: F.concat(x.head, x.body, F.lit(END))), "")
    parts = one.select("conv_id", "example", (F.col("example") == F.size("t") - 1).alias("last"), context.alias("context"),
                       F.element_at("t", F.col("example") + 1).alias("x"))
    return parts.select(
        "conv_id", "example", "last", F.concat("context", "x.head", "x.body", F.lit(END)).alias("formatted"),
        F.when(F.col("x.train"), F.length("context") + F.length("x.head")).otherwise(0).alias("loss_start"),
        F.when(F.col("x.train"), F.length("x.body")).otherwise(0).alias("loss_len"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    cut = lambda p: F.instr(p, "|>\n")
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring(p, F.lit(3), cut(p) - 3)).alias("role"),
        unescape(F.substring(p, cut(p) + 3, F.length(p))).alias("text")))


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    return unescape(F.substring(formatted, start + 1, length))
