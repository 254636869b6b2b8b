"""Chat formatting by schema fingerprints.

A record's layout is told by the hash of its nested field paths. Each known
fingerprint selects a declarative mapping from prompt, instruction or message
fields to canonical turns, which a reversible template then renders.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that mark turns; inside texts they are escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]")

TURNS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("layout", T.StringType())]
)


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    With rows, a table has one turn a row, and rows names the columns of
    conversation, turn, role and text. items is the path of the list of
    messages, with role and text fields in it. Else fields lists (role, paths)
    of one turn each, the texts at the paths joined by a blank line. Paths in
    optional may be missing; a turn of which all are is left out.
    """

    name: str
    items: str | None = None
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    rows: tuple[str, str, str, str] | None = None

    def paths(self) -> frozenset[str]:
        if self.rows is not None:
            return frozenset(self.rows)
        if self.items is not None:
            return frozenset({f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"})
        return frozenset(p for _, parts in self.fields for p in parts)

    def fingerprints(self) -> list[str]:
        """Those of its paths, with and without each optional one."""
        return [fingerprint(self.paths() - set(gone)) for n in range(len(self.optional) + 1) for gone in combinations(self.optional, n)]


#: Layouts by kind. Each kind knows its own paths only, and the first kind that knows a fingerprint has it: a table of turns may have other columns, and a list of messages goes before a lone prompt beside it.
TURN_TABLES = (Layout("turn_rows", rows=("conv_id", "turn", "role", "text")), Layout("message_rows", rows=("thread_id", "position", "author", "message")))
MESSAGE_LISTS = (Layout("messages", "messages", "role", "content"), Layout("conversations", "conversations", "from", "value"), Layout("dialog", "dialog", "speaker", "utterance"))
FIELDS = (
    Layout("prompt_completion", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("prompt_response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("question_answer", fields=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",))), optional=("system", "context")),
    Layout("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
)
LAYOUTS = (TURN_TABLES, MESSAGE_LISTS, FIELDS)
#: Names that datasets use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def record_paths(value: object, at: str = "") -> Iterator[str]:
    """Leaf paths of a decoded JSON value; list items share the path at[]."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from record_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list) and value:
        for v in value:
            yield from record_paths(v, f"{at}[]")
    else:
        yield at


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Leaf paths of a Spark schema, named as those of records."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def select_layout(paths: Iterable[str], layouts: tuple[tuple[Layout, ...], ...] = LAYOUTS) -> Layout | None:
    """The layout of the fingerprint that those of the paths have that its kind knows; None for an unknown fingerprint."""
    paths = set(paths)
    for kind in layouts:
        own = paths & {p for x in kind for p in x.paths()}
        for layout in kind:
            if fingerprint(own) in layout.fingerprints():
                return layout
    return None


def _get(value: object, path: str) -> object:
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _string(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def record_turns(record: object, layout: Layout) -> Iterator[tuple[str, str]]:
    """(role, text) of a record under a layout."""
    if layout.items is not None:
        for item in _get(record, layout.items) or []:
            role = _string(_get(item, layout.role))
            yield ROLES.get(role, role), _string(_get(item, layout.text))
    else:
        for role, parts in layout.fields:
            texts = [t for p in parts if (t := _string(_get(record, p)))]
            if texts or not set(parts) <= set(layout.optional):
                yield role, "\n\n".join(texts)


def turns_of_records(records: DataFrame, conv_id: str = "conv_id", payload: str = "payload", layouts: tuple[tuple[Layout, ...], ...] = (MESSAGE_LISTS, FIELDS)) -> DataFrame:
    """Canonical turns of JSON records, one conversation a record.

    Payloads that are null, not JSON or of no known layout give one row with
    null turn, role, text and layout, so that nothing is lost silently. Other
    columns are ignored.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string())])
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                layout = select_layout(record_paths(record), layouts) if isinstance(record, dict) else None
                turns = list(record_turns(record, layout)) if layout else []
                rows += [(key, n, role, said, layout.name) for n, (role, said) in enumerate(turns)] or [(key, None, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return records.select(F.col(conv_id).cast("long"), F.col(payload).cast("string")).mapInArrow(convert, TURNS)


def turns_of_table(df: DataFrame, conv_id: str = "conv_id", layouts: tuple[tuple[Layout, ...], ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of a table, by the layout that the fingerprint of its schema's field paths selects.

    A table has a turn a row, or a conversation a row (named by conv_id) with
    nested messages or with prompt and answer columns. Null texts and roles are
    empty; conversations without messages have no turns. Other columns are
    ignored; a schema of unknown fingerprint is an error.
    """
    layout = select_layout(schema_paths(df.schema), layouts)
    if layout is None:
        raise ValueError(f"no mapping for a table with {sorted(schema_paths(df.schema))}")
    if layout.rows is not None:
        key, turn, role, text = layout.rows
        turns = df.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    elif layout.items is not None:
        items = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(layout.items).alias("turn", "item"))
        turns = items.select("conv_id", "turn", F.col("item")[layout.role].alias("role"), F.col("item")[layout.text].alias("text"))
    else:
        have, said = set(schema_paths(df.schema)), []
        for role, parts in layout.fields:
            texts = F.filter(F.array(*(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts if p in have)), lambda x: x != "")
            open_ = set(parts) <= set(layout.optional)
            if set(parts) & have:
                turn = F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text"))
                said.append(F.when(F.size(texts) > 0, turn) if open_ else turn)
        rows = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(F.array_compact(F.array(*said))).alias("turn", "item"))
        turns = rows.select("conv_id", "turn", "item.role", "item.text")
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    canonical = F.coalesce(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[role], role)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), (role if layout.rows else canonical).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(layout.name).alias("layout"))


def escape(text: Column) -> Column:
    """Backslashes are doubled, and one is put after the first character of each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def format_turns(turns: DataFrame) -> DataFrame:
    """The formatted segment of each turn; a conversation's text is its segments in the order (turn, role, text).

    Adds segment, loss_from and loss_chars: the part of the segment that the
    loss covers, in code points from 0, and empty but for the assistant.
    Columns besides the canonical ones are dropped; turns of unknown layout
    (turn null) are left out.
    """
    user = F.col("role") == "user"
    head = F.when(user, "<s>[INST]").otherwise(F.concat(F.lit("<s>[ROLE]"), escape(F.col("role")), F.lit("[TEXT]")))
    tail = F.when(user, "[/INST]</s>").otherwise("</s>")
    return (
        turns.filter(F.col("layout").isNotNull())
        .select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"), tail.alias("tail"))
        .select(
            "conv_id",
            "turn",
            "role",
            "text",
            F.concat("head", "body", "tail").alias("segment"),
            F.length("head").cast("long").alias("loss_from"),
            F.when(F.col("role") == "assistant", F.length("body")).otherwise(0).cast("long").alias("loss_chars"),
        )
    )


#: Code points at which a part of a conversation's text ends, after the turn that passes them.
PART = 1 << 16
FORMATTED = "conv_id long, part long, text string, loss array<struct<start: long, chars: long>>"


def join_segments(segments: DataFrame) -> DataFrame:
    """conv_id, part, text, loss: the text of each conversation, its segments joined in order, in parts of about PART code points; and the spans of a part's text that the loss covers.

    A conversation's turns pass in order through one task as a stream, so that
    its length doesn't matter for memory. Turns that tie are interchangeable;
    rows of null conv_id make one conversation.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("chars", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, loss, size = None, -1, [], [], 0

        def row() -> dict:
            return {"conv_id": now, "part": part, "text": "".join(held), "loss": loss}

        for batch in batches:
            done = []
            for key, segment, start, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if part < 0 or key != now or size >= PART:
                    if part >= 0:
                        done.append(row())
                    part = part + 1 if part >= 0 and key == now else 0
                    now, held, loss, size = key, [], [], 0
                if chars:
                    loss.append({"start": size + start, "chars": chars})
                held.append(segment)
                size += len(segment)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if part >= 0:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "segment", "loss_from", "loss_chars").mapInArrow(run, FORMATTED)


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text, by its marks alone."""
    at = 0
    while at < len(text):
        end = text.index("</s>", at)
        if text.startswith("<s>[INST]", at):
            yield "user", unescape(text[at + 9 : end].removesuffix("[/INST]"))
        elif text.startswith("<s>[ROLE]", at):
            role, _, said = text[at + 9 : end].partition("[TEXT]")
            yield unescape(role), unescape(said)
        else:
            raise ValueError(f"no turn starts with {text[at : at + 20]!r}")
        at = end + 4


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation: counts and hashes of the turns that its text is parsed into, and of what its loss mask covers. Nothing but the parts of texts and masks is read."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> dict:
            turns, loss, n, chars, formatted = state
            return dict(zip(schema.names, (now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)))

        for batch in batches:
            done = []
            for key, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or key != now:
                    if state is not None:
                        done.append(row())
                    now, state = key, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, said in parse_turns(text):
                    state[0].update(f"{role}\n{said}\n".encode())
                    state[2] += 1
                for span in spans:
                    said = unescape(text[span["start"] : span["start"] + span["chars"]])
                    state[1].update(said.encode())
                    state[3] += len(said)
                state[4] += len(text)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.select("conv_id", "text", "loss").mapInArrow(run, DIGESTS)
