"""Chat formatting with typed content parts.

A message has a role and parts: text, image, audio or document. A visitor turns each
part into text of the template: text is escaped, every other part becomes a numbered
placeholder and an attachment (its reference and the tokens it expands to). A turn is
written as ``<|start|>role<|text|>...<|end|>``. Text can't contain a control string:
``<`` is written ``\\l``, ``[`` is written ``\\k`` and ``\\`` is written ``\\b``, which reading reverses. Everything is
made of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Turns with this role are learned.
LEARNED = "assistant"
#: Tokens that a part expands to, for each unit of its size.
EXPANSION = {"image": 576, "audio": 50, "document": 1024}
PART = "struct<type: string, text: string, ref: string, units: int>"


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\k")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for raw, code in (("[", "\\k"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


class PartVisitor:
    """Builds the columns for a part; one method for each type of part."""

    def __init__(self, expansion: dict[str, int] | None = None):
        self.expansion = EXPANSION | (expansion or {})

    def visit(self, part: Column, number: Column) -> tuple[Column, Column]:
        """The text of a part, and its attachment (null for text). ``number`` counts attachments from 1.

        A part of unknown or null type is text.
        """
        text, attachment = self.visit_text(part)
        for kind in self.expansion:
            mine, held = getattr(self, f"visit_{kind}", self.visit_media)(kind, part, number)
            text, attachment = F.when(part["type"] == kind, mine).otherwise(text), F.when(part["type"] == kind, held).otherwise(attachment)
        return text, attachment

    def visit_text(self, part: Column) -> tuple[Column, Column]:
        return escape(part["text"]), F.lit(None)

    def visit_media(self, kind: str, part: Column, number: Column) -> tuple[Column, Column]:
        tokens = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0)) * self.expansion[kind]
        held = F.struct(number.cast("int").alias("number"), F.lit(kind).alias("type"), part["ref"].alias("ref"), tokens.alias("tokens"))
        return F.concat(F.lit(f"<|{kind}:"), number.cast("string"), F.lit("|>")), held


def format_messages(messages: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    ``messages`` has conv_id, turn, role, parts. Turns are ordered by turn (null first),
    then role, then parts, so ties and repeated rows have a fixed order. Null roles, texts and
    parts are empty. A conversation becomes one text and so has to fit one task.
    loss_spans holds start and end (code points) of each learned turn's text.
    """
    visitor = visitor or PartVisitor()
    media = F.array(*[F.lit(k) for k in visitor.expansion])
    is_media = lambda p: F.coalesce(F.array_contains(media, p["type"]), F.lit(False))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)")).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # running sums over the turns: attachments, then characters
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("held_before", F.coalesce(F.sum(F.size(F.filter("parts", is_media))).over(before), F.lit(0)))

    def part(p: Column, k: Column) -> Column:
        number = F.col("held_before") + F.size(F.filter(F.slice("parts", 1, k + 1), is_media))
        text, held = visitor.visit(p, number)
        return F.struct(text.alias("text"), held.alias("held"))

    rows = rows.withColumn("visited", F.transform("parts", part))
    rows = rows.select("conv_id", "turn", "role", "parts", "place", F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT)).alias("head"), F.array_join("visited.text", "").alias("text"), F.filter("visited.held", lambda h: h.isNotNull()).alias("held"))
    length = F.length("head") + F.length("text") + len(END)
    rows = rows.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("int") + F.length("head"))
    span = F.when(F.col("role") == LEARNED, F.struct("start", (F.col("start") + F.length("text")).alias("end")))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat("head", "text", F.lit(END)).alias("piece"), span.alias("span"), "held"))).alias("turns"))
    attachments = F.flatten("turns.held")
    return turns.select(
        "conv_id",
        F.array_join("turns.piece", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0), lambda a, h: a + h["tokens"]).alias("expanded_tokens"),
    )


def format_conversations(conversations: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """:func:`format_messages` for rows of plain text (conv_id, turn, role, text); other columns are not looked at."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))
    return format_messages(conversations.select("conv_id", "turn", "role", F.array(part).alias("parts")), visitor)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text of each, as they were before escaping), loss_text, formatted_chars."""
    pieces = F.slice(F.split("formatted", r"<\|end\|>"), 1, F.size(F.split("formatted", r"<\|end\|>")) - 1)

    def turn(piece: Column) -> Column:
        two = F.split(F.substring(piece, len(START) + 1, 1 << 30), r"<\|text\|>")
        return F.struct(unescape(two[0]).alias("role"), unescape(two[1]).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").alias("formatted_chars"))


def digests(conversations: DataFrame) -> DataFrame:
    """Format, read back and digest: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    found = read_back(format_conversations(conversations))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
