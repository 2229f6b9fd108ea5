"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all preceding turns are its
context and only that reply is trainable.  Turns behind the last reply have no
target of their own; they come as one closing example without trainable text,
so that the output holds the whole conversation.

Template, one turn after the other::

    ### role: text</turn>\\n

``&``, ``<``, ``###`` and, in roles, ``:`` are written as character references
inside texts and roles, so a control string never appears in them and the
output can be read back exactly.

Defined cases: a null text or role is empty; turns are ordered by turn number
(null first), then role and text, so repeated rows keep a fixed order; an empty
table gives no row; other columns of the input are ignored, whatever their
names.  A conversation is one training sequence and so lives in one row; its
examples are made one at a time from that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "### ", "</turn>\n"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit("###"), F.lit("&#35;&#35;&#35;"))


def unescaped(text: Column) -> Column:
    for code, plain in (("&#35;", "#"), ("&#58;", ":"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chat(turns: DataFrame) -> DataFrame:
    """Examples of ``turns(conv_id, turn, role, text)``.

    Returns conv_id, example (0, 1, ...), has_target, formatted, loss_start and
    loss_chars: the trainable code points of ``formatted`` are the loss_chars
    ones behind the first loss_start.
    """
    kept = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("row"),
    )
    whole = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    whole = whole.select(
        "conv_id",
        F.transform(
            "rows",
            lambda r: F.struct(
                (r["role"] == "assistant").alias("reply"),
                F.concat(F.lit(HEAD), F.replace(escaped(r["role"]), F.lit(":"), F.lit("&#58;")), F.lit(": ")).alias("head"),
                escaped(r["text"]).alias("body"),
            ),
        ).alias("rows"),
    )
    at = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: F.get("rows", i - 1)["reply"] | (i == F.size("rows")))
    each = whole.select("conv_id", "rows", F.posexplode(at).alias("example", "at"))
    last = F.get("rows", F.col("at") - 1)
    before = F.array_join(
        F.transform(F.slice("rows", F.lit(1), F.col("at") - 1), lambda r: F.concat(r["head"], r["body"], F.lit(TAIL))), ""
    )
    each = each.select("conv_id", "example", last["reply"].alias("has_target"), F.concat(before, last["head"]).alias("context"), last["body"].alias("body"))
    return each.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        "has_target",
        F.concat("context", "body", F.lit(TAIL)).alias("formatted"),
        F.when(F.col("has_target"), F.char_length("context")).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("has_target"), F.char_length("body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, in order."""
    parts = F.split(formatted, "</turn>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substr(p, F.lit(len(HEAD) + 1), F.instr(p, ": ") - F.lit(len(HEAD) + 1))).alias("role"),
            unescaped(F.substr(p, F.instr(p, ": ") + F.lit(2))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescaped(F.substr(formatted, (start + 1).cast("int"), chars.cast("int")))
