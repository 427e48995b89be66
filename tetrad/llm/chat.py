"""Chat formatting of turns whose content is text or a list of typed parts.

A visitor (``Flattener``) goes over a turn's parts in order: runs of text are
escaped and kept, images, audio and documents each leave a placeholder, their
reference and the number of tokens that the placeholder stands for.  A turn is

    turn mark, role, body mark, content, end mark

and a conversation is its turns in a row.  Every string that the template uses,
or reserves, is a control string.  Inside a role or a text, a control string has
the escape character put after its first character; where some stand there
already, one more.  So formatted text has control strings only as marks, and
taking one escape character away gives the text back exactly.

``format_turns`` gives one row per turn with its place in the conversation, so
that nobody holds a long conversation whole; ``read_back`` goes over the rows in
order and gives one row per conversation.

Defined results: a null role, content or part is empty text; a turn without
content has its marks all the same; turns stand in the order of the turn column
(null first), equal ones by role, then by what they say; repeated rows are turns
of their own; rows with a null conversation are one conversation; a part of an
unknown type is text, unless it has a reference: then it is a document; texts of
any length are kept whole; extra columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tetrad.llm.shared import release, small_batches

TURNS = "formatted string, n_chars long, loss array<struct<start: long, length: long>>, attachments array<struct<at: long, kind: string, ref: string, tokens: long>>"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, placeholders, and strings that mean something to others."""

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "</s>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    reserved: tuple[str, ...] = ("<s>", "[INST]", "[/INST]")
    escape: str = "\\"

    def __post_init__(self) -> None:
        firsts = {c[:1] for c in self.controls}
        inside = {x for c in self.controls for x in c[1:]}
        if len(self.escape) != 1 or not all(len(c) > 1 for c in self.controls) or (firsts | {self.escape}) & inside or self.escape in firsts:
            # so control strings cannot overlap, nor arise where a mark and a text meet
            raise ValueError("a control string has two characters or more; neither the escape character nor the first one of any control string stands further on in one")
        marks = (self.turn, self.body, self.end, self.image, self.audio, self.document)
        if any(a != b and a.startswith(b) for a in marks for b in marks) or len(set(marks)) < len(marks):
            raise ValueError("marks differ, and none begins with another one")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.body, self.end, self.image, self.audio, self.document, *self.reserved)

    def pattern(self, escaped: bool) -> re.Pattern[str]:
        """The place after a control string's first character, and one escape character there, if ``escaped``."""
        slash = re.escape(self.escape)
        by_first: dict[str, list[str]] = {}
        for c in self.controls:
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        ways = [f"(?<={re.escape(x)}){slash if escaped else ''}(?={slash}*(?:{'|'.join(rests)}))" for x, rests in sorted(by_first.items())]
        return re.compile("|".join(ways))


class Escaper:
    """A template's escaping, and its inverse."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.plain, self.marked = template.pattern(False), template.pattern(True)
        self.holders = re.compile("|".join(map(re.escape, (template.image, template.audio, template.document))))

    def escape(self, text: str) -> str:
        return self.plain.sub(lambda _: self.template.escape, text)

    def unescape(self, text: str) -> str:
        return self.marked.sub("", text)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of formatted text; placeholders are left out of the text."""
        t, at = self.template, 0
        while at < len(formatted):
            body = formatted.index(t.body, at)
            end = formatted.index(t.end, body)
            if not formatted.startswith(t.turn, at):
                raise ValueError("a turn does not begin with its mark")
            content = self.holders.split(formatted[body + len(t.body) : end])
            yield self.unescape(formatted[at + len(t.turn) : body]), "".join(map(self.unescape, content))
            at = end + len(t.end)


@dataclass(frozen=True)
class Costs:
    """How many tokens a placeholder stands for."""

    #: Pixels of a side of an image's patch, each of which is a token; tokens of an image of unknown size.
    patch: int = 28
    image: int = 256
    #: Tokens of a second of audio; of audio of unknown length.
    second: float = 12.5
    audio: int = 750
    #: Tokens of a document's page; a document of an unknown number of pages has one.
    page: int = 512


@dataclass
class Flattener:
    """Visits the parts of one turn's content; afterwards holds the flat content."""

    escaper: Escaper
    costs: Costs
    out: list[str] = field(default_factory=list)
    size: int = 0
    #: (start, length) of the escaped text runs; (start, kind, reference, tokens) of the placeholders.
    runs: list[tuple[int, int]] = field(default_factory=list)
    attached: list[tuple[int, str, str | None, int]] = field(default_factory=list)
    _text: list[str] = field(default_factory=list)

    def visit(self, content: str | list[dict | None] | None) -> Flattener:
        for part in content if isinstance(content, list) else [{"type": "text", "text": content}]:
            part = part or {}
            kind = part.get("type") or ""
            if kind not in ("text", "image", "audio", "document"):
                kind = "document" if part.get("ref") is not None else "text"
            getattr(self, f"visit_{kind}")(part)
        self._close()
        return self

    def visit_text(self, part: dict) -> None:
        self._text.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        wide, high = part.get("width"), part.get("height")
        known = wide is not None and high is not None
        self._hold("image", part, math.ceil(wide / self.costs.patch) * math.ceil(high / self.costs.patch) if known else self.costs.image)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds")
        self._hold("audio", part, self.costs.audio if seconds is None else math.ceil(seconds * self.costs.second))

    def visit_document(self, part: dict) -> None:
        self._hold("document", part, self.costs.page * (1 if part.get("pages") is None else part["pages"]))

    def _close(self) -> None:
        """Texts in a row are one run, escaped together: what they spell only jointly is escaped too."""
        text = self.escaper.escape("".join(self._text))
        self._text = []
        if text:
            self.runs.append((self.size, len(text)))
            self._put(text)

    def _hold(self, kind: str, part: dict, tokens: int) -> None:
        self._close()
        self.attached.append((self.size, kind, part.get("ref"), max(0, tokens)))
        self._put(getattr(self.escaper.template, kind))

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


def _shifted(c: str, name: str) -> Column:
    """An array of places within a turn as places within the conversation."""
    return F.transform(c, lambda x: x.withField(name, x[name] + F.col("at"))).alias(c)


def format_turns(
    turns: DataFrame,
    template: Template | None = None,
    costs: Costs | None = None,
    learned: tuple[str, ...] = ("assistant",),
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
) -> DataFrame:
    """(conv_id, turn_no, at, formatted, n_chars, loss, attachments): each turn formatted.

    ``content`` is a string column, or an array of structs with the fields type,
    text, ref, width, height, seconds and pages, as far as there are any.
    ``at`` is the turn's place in the formatted conversation, in code points;
    ``loss`` are the places of the text runs of learned roles, and ``attachments``
    those of the placeholders with references and token counts, in the same measure.
    """
    small_batches(turns.sparkSession)
    template, costs = template or Template(), costs or Costs()
    source = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.col(f"`{content}`").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(template)
        for batch in batches:
            text, size, loss, attached = [], [], [], []
            for who, what in zip(batch.column("role").to_pylist(), batch.column("content").to_pylist(), strict=True):
                flat = Flattener(escaper, costs).visit(what)
                head = f"{template.turn}{escaper.escape(who)}{template.body}"
                text.append("".join((head, *flat.out, template.end)))
                size.append(len(text[-1]))
                loss.append([{"start": len(head) + a, "length": n} for a, n in flat.runs] if who in learned else [])
                attached.append([{"at": len(head) + a, "kind": kind, "ref": ref, "tokens": n} for a, kind, ref, n in flat.attached])
            place = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            held = pa.list_(pa.struct([("at", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            made = [pa.array(text, pa.string()), pa.array(size, pa.int64()), pa.array(loss, place), pa.array(attached, held)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), *made], ["conv_id", "turn", "role", "formatted", "n_chars", "loss", "attachments"])
        release()

    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn", "role"))
    made = source.mapInArrow(run, f"{kinds}, {TURNS}")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "formatted")
    before = F.coalesce(F.sum("n_chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = made.select("*", (F.row_number().over(order) - 1).cast("long").alias("turn_no"), before.alias("at"))
    return placed.select("conv_id", "turn_no", "at", "formatted", "n_chars", _shifted("loss", "start"), _shifted("attachments", "at"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_attachments, expanded_tokens) of each conversation, from its formatted text
    and the places of its loss alone.

    Turns stream by in order with a hash in the making, so a conversation of any
    length is never held; one conversation is hashed by one task, as the hash of a
    sequence must be.
    """
    small_batches(formatted.sparkSession)
    template = template or Template()
    kind = formatted.schema["conv_id"].dataType.simpleString()
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda s, x: s + x["tokens"])
    ordered = formatted.select("conv_id", "turn_no", "at", "formatted", "loss", F.size("attachments").cast("long").alias("n"), tokens.alias("tokens")).repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper = Escaper(template)
        now, said, learned = None, hashlib.sha256(), hashlib.sha256()
        row: list[int] = []
        done: list[tuple] = []

        def close() -> None:
            if row:
                done.append((now, row[0], said.hexdigest(), row[1], learned.hexdigest(), *row[2:]))

        def rows(key: pa.DataType) -> pa.RecordBatch:
            kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

        key = None
        for batch in batches:
            key = batch.schema.field("conv_id").type
            for conv, at, text, loss, n, tokens in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "at", "formatted", "loss", "n", "tokens")], strict=True):
                if not row or conv != now:
                    close()
                    now, said, learned, row = conv, hashlib.sha256(), hashlib.sha256(), [0] * 5
                if at != row[2]:
                    raise ValueError("a turn does not stand where the one before it ends")
                for who, what in escaper.turns(text):
                    row[0] += 1
                    said.update(f"{who}\n{what}\n".encode())
                for span in loss:
                    what = escaper.unescape(text[span["start"] - at : span["start"] - at + span["length"]])
                    row[1] += len(what)
                    learned.update(what.encode())
                row[2:] = row[2] + len(text), row[3] + n, row[4] + tokens
            if done:
                yield rows(key)
                done = []
        close()
        if done:
            yield rows(key)
        release()

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
