"""Chat formatting with a grammar round trip, in DataFrame functions alone.

Grammar of a formatted conversation::

    conversation = { turn }
    turn         = "### " role ": " text newline "</turn>" newline

A turn ends at the first ``</turn>`` that has no backslash before it, and its text starts
after the first ``": "``. The parser takes one backslash off every ``###`` and
``</turn>`` that has one or more, and does not take a text that holds one without a
backslash (it reads null). Every turn is rendered plainly and parsed; where that does not give the turn back, the text gets one
backslash before every ``###`` and ``</turn>`` (after those it has) and is rendered and
parsed again. As escaping adds exactly what parsing takes off, the second round is always
identical; ``faithful`` in the result is the comparison itself.

Roles are escaped with ``\\b \\n \\c`` for backslash, newline and colon. Loss spans cover
the assistant's texts, in code points and in bytes of the UTF-8 form.

Defined cases: null text and null role are empty; turns with equal numbers are ordered by
role and text, null numbers come first; repeated rows are turns of their own; a null
conversation id is a conversation; an empty table gives no rows; other columns are not
read. A conversation is one value, so its length is bounded by what a value can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, BETWEEN, CLOSE = "### ", ": ", "\n</turn>\n"
CONTROLS = r"(\\*)(###|</turn>)"
ESCAPED = r"\\(\\*)(###|</turn>)"
#: A real turn end: the newline before it is never part of an escaped one.
TURN_END = r"(?<!\\)</turn>\n"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def controlled(text: Column) -> Column:
    """Whether the text holds a control string without a backslash before it."""
    return F.regexp_replace(text, ESCAPED, "\n").rlike(CONTROLS)


def role_escaped(role: Column) -> Column:
    once = F.replace(role, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(once, F.lit("\n"), F.lit("\\n")), F.lit(":"), F.lit("\\c"))


def role_unescaped(role: Column) -> Column:
    once = F.replace(F.replace(role, F.lit("\\c"), F.lit(":")), F.lit("\\n"), F.lit("\n"))
    return F.replace(once, F.lit("\\b"), F.lit("\\"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role_escaped(role), F.lit(BETWEEN), text, F.lit(CLOSE))


def parsed(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of ``(role, text)``."""
    pieces = F.split(formatted, TURN_END)
    # what follows the last turn end is empty
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.instr(piece, BETWEEN)
        role = F.substring(piece, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)
        start = head + len(BETWEEN)
        # the newline before the turn end is the template's
        text = F.substring(piece, start, F.length(piece) - start)
        # a control string without a backslash is no text
        text = F.when(~controlled(text), unescaped(text))
        return F.struct(role_unescaped(role).alias("role"), text.alias("text"))

    return F.transform(turns, turn)


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end, first_byte,
    end_byte), faithful."""
    turns = rows.select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    plain = parsed(rendered(F.col("role"), F.col("text"))) == source
    turns = turns.withColumn("shown", F.when(plain, F.col("text")).otherwise(escaped(F.col("text"))))
    turns = turns.withColumn("piece", rendered(F.col("role"), F.col("shown")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close, close_bytes = F.lit(len(CLOSE)), F.lit(len(CLOSE.encode()))
    turns = (
        turns.withColumn("place", F.row_number().over(before))
        .withColumn("_end", F.sum(F.length("piece")).over(upto) - close)
        .withColumn("_end_byte", F.sum(F.octet_length("piece")).over(upto) - close_bytes)
    )
    span = F.struct(
        "place",
        (F.col("_end") - F.length("shown")).alias("start"),
        F.col("_end").alias("end"),
        (F.col("_end_byte") - F.octet_length("shown")).alias("first_byte"),
        F.col("_end_byte").alias("end_byte"),
    )
    grouped = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece", "role", "text"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("role") == LEARNED, span))).alias("loss_spans"),
    )
    formatted = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    source_turns = F.transform(
        "turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    return grouped.select(
        "conv_id", formatted.alias("formatted"), source_turns.alias("_turns"), "loss_spans"
    ).select(
        "conv_id",
        "formatted",
        F.transform("loss_spans", lambda s: s.dropFields("place")).alias("loss_spans"),
        (parsed(F.col("formatted")) == F.col("_turns")).alias("faithful"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    raw = F.col("formatted").cast("binary")

    def under(span: Column) -> Column:
        length = (span["end_byte"] - span["first_byte"]).cast("int")
        return unescaped(F.substring(raw, (span["first_byte"] + 1).cast("int"), length).cast("string"))

    turns = F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("loss_spans", under), "")
    return (
        formatted.withColumn("_read", parsed(F.col("formatted")))
        .withColumn("_loss", loss)
        .select(
            "conv_id",
            F.size("_read").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("_loss").cast("bigint").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )
