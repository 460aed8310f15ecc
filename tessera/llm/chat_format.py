"""Formatting conversations for training: typed content parts, a visitor that flattens them, and reading the result back.

A message is a list of typed parts: text, image, audio or document. A visitor turns each part into what the text shows of
it (an escaped text, or a placeholder), and records for an attachment what it refers to and how many tokens it will take.
The marks of the template never occur inside a text, as an escape stands after the first character of each such string;
so the output can be split at its marks and read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import fresh

KINDS = ("image", "audio", "document")
#: Parts of a message: kind, text (of a text part), ref (of an attachment), units (patches, seconds, pages), source (how it was written).
PARTS = "array<struct<kind:string,text:string,ref:string,units:double,source:string>>"
#: An attachment written in a text: ![image 576](pictures/a.png), the number of units may be left out.
WRITTEN = r"!\[(image|audio|document)(?: ([0-9]{1,9}))?\]\(([^()\s]{1,1000})\)"
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, of the text within it and of its end, placeholders, other control strings that texts may not hold,
    the roles under the loss, and tokens per attachment as (fixed, per unit, units where none are given)."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    placeholder: str = "<|{}|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    loss: tuple[str, ...] = ("assistant",)
    tokens: dict[str, tuple[float, float, float]] = field(default_factory=lambda: {"image": (2, 1, 256), "audio": (2, 25, 30), "document": (2, 600, 1)}, hash=False)

    def __post_init__(self):
        first = {m[0] for m in self.marks}
        if any(len(m) < 2 or first & set(m[1:]) or ESCAPE in m for m in self.marks):
            raise ValueError("a mark has two characters or more, no escape, and no mark starts inside another")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end, *(self.placeholder.format(k) for k in KINDS), *self.reserved)

    def escaped(self, text: Column) -> Column:
        """An escape after every escape, and after the first character of every mark."""
        starts = [f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in self.marks]
        return F.regexp_replace(text, "|".join([re.escape(ESCAPE), *starts]), r"$0\\")

    @staticmethod
    def unescaped(text: Column) -> Column:
        """The exact inverse: the character after an escape stands for itself, the escape goes."""
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    @property
    def any_placeholder(self) -> str:
        return "|".join(re.escape(self.placeholder.format(k)) for k in KINDS)


class Flatten:
    """The visitor: one method per kind of part; each gives what is shown, and what is recorded of an attachment."""

    def __init__(self, template: Template):
        self.template = template

    def visit(self, part: Column) -> Column:
        """Parts of a kind that isn't known, or of none, are texts if they have no reference, else documents."""
        kind = F.when(part["kind"].isin(*KINDS, "text"), part["kind"]).when(part["ref"].isNull(), "text").otherwise("document")
        other = F.when(kind == "image", self.image(part)).when(kind == "audio", self.audio(part)).otherwise(self.document(part))
        return F.when(kind == "text", self.text(part)).otherwise(other)

    def text(self, part: Column) -> Column:
        return self._shown("text", self.template.escaped(F.coalesce(part["text"], F.lit(""))), part, F.lit(0).cast("long"))

    def image(self, part: Column) -> Column:
        return self._attachment("image", part)

    def audio(self, part: Column) -> Column:
        return self._attachment("audio", part)

    def document(self, part: Column) -> Column:
        return self._attachment("document", part)

    def _attachment(self, kind: str, part: Column) -> Column:
        fixed, per_unit, usual = self.template.tokens[kind]
        units = F.greatest(F.coalesce(part["units"], F.lit(float(usual))), F.lit(0.0))
        return self._shown(kind, F.lit(self.template.placeholder.format(kind)), part, F.ceil(fixed + per_unit * units).cast("long"))

    @staticmethod
    def _shown(kind: str, shown: Column, part: Column, tokens: Column) -> Column:
        source = F.coalesce(part["source"], part["ref"], F.lit(""))
        return F.struct(F.lit(kind).alias("kind"), shown.alias("shown"), part["ref"].alias("ref"), source.alias("source"), tokens.alias("tokens"))


def parts_of(text: Column) -> Column:
    """The parts of a plain text: what is written like an attachment is one, the rest is text. A null text has one empty part."""
    whole = F.coalesce(text, F.lit(""))
    found, between = F.regexp_extract_all(whole, F.lit(WRITTEN), F.lit(0)), F.split(whole, WRITTEN, -1)

    def pair(before: Column, source: Column) -> Column:
        units = F.nullif(F.regexp_extract(source, WRITTEN, 2), F.lit("")).cast("double")
        own = F.struct(F.lit("text").alias("kind"), before.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"), F.lit(None).cast("string").alias("source"))
        attached = F.struct(F.regexp_extract(source, WRITTEN, 1).alias("kind"), F.lit(None).cast("string").alias("text"), F.regexp_extract(source, WRITTEN, 3).alias("ref"), units.alias("units"), source.alias("source"))
        return F.when(source.isNull(), F.array(own)).otherwise(F.array(own, attached))

    return F.flatten(F.zip_with(between, found, pair)).cast(PARTS)


def formatted(conversations: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """One row per conversation: (conv_id, formatted, spans, attachments, n_tokens_attached).

    spans has for each turn where it starts in `formatted`, where its content starts and ends (code points from 0), whether
    that is under the loss, and which attachments are its own; attachments has (turn, kind, ref, source, tokens) in order.
    `parts` names a column of typed parts; without it, and where it is null, the parts are those of the text.

    Turns are in order of turn (nulls first), then role, then content. Null roles and texts are empty, a null conv_id is a
    conversation of its own, repeated rows are repeated turns, an empty table gives an empty result, and other columns
    aren't read. Rendering is done row by row before the only shuffle. A conversation becomes one row, so it must fit one
    value of 2 GB, as any sink of formatted conversations asks.
    """
    plain = parts_of(F.col(text).cast("string"))
    content = F.coalesce(F.col(parts).cast(PARTS), plain) if parts else plain
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.transform(content, Flatten(template).visit).alias("v"))
    body = F.array_join(F.transform("v", lambda p: p["shown"]), "")
    attached = F.transform(F.filter("v", lambda p: p["kind"] != "text"), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["source"].alias("source"), p["tokens"].alias("tokens")))
    head = F.concat(F.lit(template.turn), template.escaped(F.col("role")), F.lit(template.text))
    rows = rows.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"), attached.alias("attached"))
    rows = rows.withColumn("chars", F.length("head") + F.length("body") + len(template.end))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body", "attached")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "conv_id", F.row_number().over(order).alias("nr"), "role", "head", "body", "attached", "chars",
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("at"), F.coalesce(F.sum(F.size("attached")).over(before), F.lit(0)).alias("nth"),
    )
    start = F.col("at") + F.length("head")
    span = F.struct(F.col("at").alias("turn_start"), start.alias("start"), (start + F.length("body")).alias("end"), F.col("role").isin(*template.loss).alias("loss"), F.col("nth").alias("first_attachment"), F.size("attached").cast("long").alias("attachments"))
    own = F.transform("attached", lambda a: F.struct(F.col("nr").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["source"].alias("source"), a["tokens"].alias("tokens")))
    turns = rows.select("conv_id", F.struct("nr", F.concat("head", "body", F.lit(template.end)).alias("shown"), span.alias("span"), own.alias("own")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["shown"]), "").alias("formatted"), F.transform("t", lambda x: x["span"]).alias("spans"), F.flatten(F.transform("t", lambda x: x["own"])).alias("attachments"))
    return whole.withColumn("n_tokens_attached", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The columns of `formatted` and, from the text and its spans: turns array<struct<role,text>>, loss_text.

    The text is split at its marks. Each placeholder takes the next attachment of its turn, as it was written (or its
    reference, where it came as a part). loss_text is what stands in the spans under the loss.
    """
    turns, loss = fresh("turns", formatted), fresh("loss_text", formatted)
    pieces = F.slice(F.split("formatted", re.escape(template.turn), -1), F.lit(2), F.size("spans"))

    def restored(shown: Column, span: Column) -> Column:
        between = F.split(shown, template.any_placeholder, -1)
        own = F.slice(F.col("attachments"), (span["first_attachment"] + 1).cast("int"), span["attachments"].cast("int"))
        return F.array_join(F.zip_with(between, own, lambda s, a: F.concat(template.unescaped(s), F.coalesce(a["source"], F.lit("")))), "")

    def turn_of(piece: Column, span: Column) -> Column:
        fields = F.split(piece, f"{re.escape(template.text)}|{re.escape(template.end)}", -1)
        return F.struct(template.unescaped(fields[0]).alias("role"), restored(fields[1], span).alias("text"))

    def lost(piece: Column, span: Column) -> Column:
        from_piece = span["start"] - span["turn_start"] - len(template.turn)
        masked = F.substring(piece, (from_piece + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        return F.when(span["loss"], restored(masked, span)).otherwise("")

    return formatted.withColumns({turns: F.zip_with(pieces, F.col("spans"), turn_of), loss: F.array_join(F.zip_with(pieces, F.col("spans"), lost), "")})


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The four columns of conversations, and conversation -7, both of whose texts are made of control strings."""
    probe = spark.sql("VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and digests of what `read_back` gives: a check that nothing was lost, and what the loss covers."""
    back = read_back(formatted, template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "n_tokens_attached",
    )
