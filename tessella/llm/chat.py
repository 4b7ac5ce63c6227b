"""Chat formatting with typed content parts.

Method: the content of a turn is a list of typed parts (text, image, audio, document).  A visitor flattens them in
order: text is escaped, every attachment becomes a placeholder, and its reference and expanded token count are
recorded.  The template frames each turn with control strings; escaping makes control strings in a text harmless and
is undone exactly, so a placeholder and a text that spells one are told apart.  The loss mask of a turn is the span of
its assistant content.

Where contents come from is named, not guessed: a column of parts, or a text, whose media links ``![name](reference)``
are attachments and whose rest is text.  A link keeps how it was written, so the text is had back from the parts.

    <|im_start|>role\\ncontent<|im_end|>\\n

Spark deals the rows: each turn is formatted where it lies, and reading back folds the turns of a conversation in
order, with a state of fixed size, over rows that Spark has sorted (and spills).  A conversation of any length is
never held as a whole.

Defined results
* null text: empty.  null role: empty, no loss.  null turn: first of its conversation; equal turns: by role, then text.
* null conv_id: one conversation, like any id.  Repeated rows: turns like others.  Empty table: no rows but those added.
* null or empty parts: an empty content.  An attachment without a reference: the empty one; one without sizes: one
  token.  A part of an unknown type: an error.  A text that looks like JSON is a text.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

START, END = "<|im_start|>", "<|im_end|>"
#: A bar within a control string (or within an escaped one) gets a backslash more; so control strings can't arise.
_CONTROL = re.compile(r"<(\\*)\|([a-z_]+)(\\*)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|([a-z_]+)(\\*)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2\3|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2\3|>", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


#: The columns of a part.  ``source``: how an attachment was written in a text, if it comes from one.
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,n_chars:bigint,source:string>>"
KINDS = ("image", "audio", "document")
_PLACEHOLDER = re.compile(rf"<\|({'|'.join(KINDS)})\|>")


class Attachment(NamedTuple):
    kind: str
    ref: str
    #: Tokens that the model sees in place of the placeholder.
    n_tokens: int
    source: str | None = None


@dataclass
class Flattened:
    text: str = ""
    #: In order of their placeholders.
    attachments: list[Attachment] = field(default_factory=list)


class Visitor:
    """Flattens typed parts.  A subclass may override ``visit_<type>`` or the token counts."""

    #: Pixels of an image patch, seconds of an audio frame, characters of a document token.
    patch, frame, chars = 28, 0.04, 4

    def flatten(self, parts: list[dict]) -> Flattened:
        out = Flattened()
        for part in _joined(parts):
            kind = part.get("type") or "text"
            getattr(self, f"visit_{kind}", self.visit_unknown)(part, out)
        return out

    def visit_text(self, part: dict, out: Flattened) -> None:
        out.text += escape(part.get("text") or "")

    def visit_image(self, part: dict, out: Flattened) -> None:
        sides = [max(1, -(-int(part.get(k) or 1) // self.patch)) for k in ("width", "height")]
        self._attach("image", part, sides[0] * sides[1], out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._attach("audio", part, max(1, round(float(part.get("seconds") or 0) / self.frame)), out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._attach("document", part, max(1, -(-int(part.get("n_chars") or 0) // self.chars)), out)

    def visit_unknown(self, part: dict, out: Flattened) -> None:
        raise ValueError(f"unknown part type {part.get('type')!r}")

    def _attach(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        out.attachments.append(Attachment(kind, part.get("ref") or "", tokens, part.get("source")))
        out.text += f"<|{kind}|>"


def _joined(parts: list[dict]) -> list[dict]:
    """Neighbouring text parts as one, so that no control string arises across their border."""
    out: list[dict] = []
    for part in parts:
        if out and (part.get("type") or "text") == "text" == (out[-1].get("type") or "text"):
            out[-1] = {"type": "text", "text": (out[-1].get("text") or "") + (part.get("text") or "")}
        else:
            out.append(part)
    return out


#: A media link in a text, and the endings of references that aren't images.
LINK = re.compile(r"!\[[^\]\n]{0,1000}\]\(([^()\s]{1,2000})\)")
ENDINGS = {"audio": (".wav", ".mp3", ".flac", ".ogg"), "document": (".pdf", ".txt", ".docx", ".html")}


def linked_parts(text: str | None) -> list[dict]:
    """A text as parts: its media links are attachments, of the kind that the reference's ending tells."""
    out, at, text = [], 0, text or ""
    for m in LINK.finditer(text) if "![" in text else ():
        low = m[1].lower()
        kind = next((k for k, ends in ENDINGS.items() if low.endswith(ends)), "image")
        out += [{"type": "text", "text": text[at : m.start()]}, {"type": kind, "ref": m[1], "source": m[0]}]
        at = m.end()
    return [*out, {"type": "text", "text": text[at:]}]


def format_turn(role: str, flattened: Flattened) -> tuple[str, int, int]:
    """The framed turn, and start and end of its loss mask (equal if it has none)."""
    head = f"{START}{escape_role(role)}\n"
    begin = len(head)
    end = begin + len(flattened.text) if role == "assistant" else begin
    return f"{head}{flattened.text}{END}\n", begin, end


def read_content(flat: str) -> list[tuple[str, str]]:
    """Texts and placeholders of a flattened content: ("text", unescaped text) or (kind, ""), in order; no empty text."""
    out, at = [], 0
    for m in _PLACEHOLDER.finditer(flat):
        out += [("text", unescape(flat[at : m.start()])), (m[1], "")]
        at = m.end()
    return [p for p in [*out, ("text", unescape(flat[at:]))] if p != ("text", "")]


def read_turn(formatted: str) -> tuple[str, list[tuple[str, str]]]:
    """Role and content (as of ``read_content``) of a framed turn."""
    if not formatted.startswith(START) or not formatted.endswith(f"{END}\n"):
        raise ValueError("not a turn")
    role, _, flat = formatted[len(START) : -len(END) - 1].partition("\n")
    if START in flat or END in flat:
        raise ValueError("a control string within a turn")
    return unescape_role(role), read_content(flat)


def restored(content: list[tuple[str, str]], attachments: Iterator[Attachment]) -> str:
    """The text of a content, each attachment as it was written (as its placeholder if it comes from no text)."""
    out = []
    for kind, text in content:
        if kind != "text":
            own = next(attachments)
            if own.kind != kind:
                raise ValueError("placeholders and attachments differ")
            text = f"<|{kind}|>" if own.source is None else own.source
        out.append(text)
    return "".join(out)


_ATTACHED = "array<struct<kind:string,ref:string,n_tokens:int,source:string>>"
_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int32()), ("source", pa.string())]))


def format_turns(conversations: DataFrame, content: str = "parts") -> DataFrame:
    """conv_id, turn, and the formatted turn with its loss mask and attachments: a row per turn.

    The formatted conversation is the turns' strings in order.  ``content``: "parts", a column of typed parts (``PARTS``),
    or "text", a column of texts with media links.
    """
    if content not in ("parts", "text"):
        raise ValueError("contents are parts or texts")
    keys = [conversations.schema["conv_id"], conversations.schema["turn"]]
    schema = T.StructType([*keys, *T._parse_datatype_string(f"formatted string, loss_start int, loss_end int, attachments {_ATTACHED}").fields])
    column = F.col("text") if content == "text" else F.col("parts").cast(PARTS).alias("parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Visitor()
        for batch in batches:
            rows = []
            for role, own in zip(batch.column("role").to_pylist(), batch.column(content).to_pylist()):
                flat = visitor.flatten(linked_parts(own) if content == "text" else own or [])
                rows.append((*format_turn(role or "", flat), [a._asdict() for a in flat.attachments]))
            columns = list(zip(*rows)) or [(), (), (), ()]
            new = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), _ATTACHMENTS))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *new], names=schema.names)

    return conversations.select("conv_id", "turn", "role", column).mapInArrow(run, schema)


class _Fold:
    """What reading a conversation's turns back has gathered so far."""

    def __init__(self):
        self.turns, self.loss, self.references = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_attachments = self.expanded_tokens = 0

    def add(self, formatted: str, loss_start: int, loss_end: int, attachments: list[Attachment]) -> None:
        role, content = read_turn(formatted)
        self.turns.update(f"{role}\n{restored(content, iter(attachments))}\n".encode())
        if loss_end > loss_start:
            masked = restored(read_content(formatted[loss_start:loss_end]), iter(attachments))
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        for a in attachments:
            self.references.update(f"{a.kind}\n{a.ref}\n{a.n_tokens}\n".encode())
            self.expanded_tokens += a.n_tokens
        self.n_attachments += len(attachments)
        self.n_turns += 1
        self.formatted_chars += len(formatted)

    def row(self, conv_id) -> tuple:
        return (
            conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.n_attachments, self.references.hexdigest(),
            self.expanded_tokens,
        )


_READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, references_sha256 string, expanded_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation, from the formatted turns and their attachments alone."""
    schema = T.StructType([formatted.schema["conv_id"], *T._parse_datatype_string(_READ).fields])
    kinds = to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "attachments")]
            for conv_id, text, start, end, attached in zip(*columns):
                if fold is None or conv_id != current:
                    if fold:
                        done.append(fold.row(current))
                    current, fold = conv_id, _Fold()
                fold.add(text, start, end, [Attachment(**a) for a in attached])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=schema.names)
        if fold:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(fold.row(current), kinds)], names=schema.names)

    turns = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments").repartition("conv_id")
    return turns.sortWithinPartitions("conv_id", "turn", "formatted", F.to_json("attachments")).mapInArrow(run, schema)


PROBE = f"{END}{START}assistant ok"


def report(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -1, whose two turns are made of control strings."""
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)
    return read_back(format_turns(rows, content="text"))
