"""Conversations as training text, rendered by a compiled template, and read back."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .common import map_batches
from .template import Mark, compile_template

# A turn begins with its role as a line mark and ends with a closing mark. The escape
# filter keeps both out of texts, so the marks stand where the template set them only.
OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
TEMPLATE = (
    "{% for turn in turns %}"
    "{{ '" + OPEN + "' }}{{ turn.role | escape_role }}{{ '" + SEPARATOR + "' }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}"
    "{{ '" + CLOSE.replace("\n", "\\n") + "' }}"
    "{% endfor %}"
)


def escape(text: str) -> str:
    """Backslashes double, then each control string gives way to a backslash and letters.

    The result holds neither control string, and no text is lost: every backslash of it
    stands before a backslash or a letter that says what it replaces.
    """
    return text.replace("\\", "\\\\").replace("###", "\\h\\h\\h").replace("</turn>", "\\l/turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\c")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\h", "#").replace("\\l", "<").replace("\\c", ":") for p in parts)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def format_conversations(
    conversations: DataFrame,
    template: str = TEMPLATE,
    *,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """Every conversation as pieces of its formatted text, in order of `conv_id`, `piece`.

    Columns: `conv_id`, `piece` (0, 1, ...), `text`, `generated` (inside a generation
    mark: the loss mask). A conversation is its rows by turn, null turns first; equal
    turns follow by role, text. Null roles and texts are empty, a null id is a
    conversation of its own, repeated rows are turns like any other, other columns are
    not read, an empty table gives no piece.

    Rows are sorted by conversation and streamed through the template, one turn ahead:
    memory does not grow with a conversation, and one of a third of all rows is a
    stream of one task, as its text is one sequence. A text holds whole turns in one
    task's partition only; Spark sorts on disk where needed.
    """
    columns = {"conv_id": id_column, "turn": turn_column, "role": role_column, "text": text_column}
    rows = conversations.select(*[F.col(c).alias(name) for name, c in columns.items()])
    rows = rows.fillna("", subset=["role", "text"]).repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = StructType(
        [
            rows.schema["conv_id"],
            StructField("piece", LongType()),
            StructField("text", StringType()),
            StructField("generated", BooleanType()),
        ]
    )
    kind = pa.schema([("piece", pa.int64()), ("text", pa.string()), ("generated", pa.bool_())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template, {"escape": escape, "escape_role": escape_role})
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        id_type = first.column("conv_id").type
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, *rest = zip(*out, strict=True)
            arrays = [pa.array(ids, id_type), *(pa.array(c, f.type) for c, f in zip(rest, kind, strict=True))]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for conversation, turns in itertools.groupby(_turns(itertools.chain([first], batches)), key=lambda r: r[0]):
            stream = run({"turns": ({"role": role, "text": text} for _, role, text in turns)})
            piece, inside, texts = 0, False, []
            for x in itertools.chain(stream, [None]):
                if isinstance(x, str):
                    texts.append(x)
                    if inside or not x.endswith("\n"):
                        continue
                if texts:
                    text = "".join(texts)
                    out.append((conversation, piece, text, inside))
                    piece, size, texts = piece + 1, size + len(text), []
                if isinstance(x, Mark):
                    inside = x is Mark.START
                if size >= 4 << 20 or len(out) >= 10_000:
                    yield flush()
                    out.clear()
                    size = 0
        if out:
            yield flush()

    return map_batches(rows, render, schema)


def read_back(pieces: DataFrame, *, ordered: bool = False) -> DataFrame:
    """Per conversation, from the formatted text alone: turns, their digest, and the loss mask's texts.

    A turn ends with the closing mark, its role with the separator; both are read
    unescaped. Columns: `conv_id`, `n_turns`, `turns_sha256`, `loss_chars`,
    `loss_sha256`, `formatted_chars`. `ordered` pieces are read as they come, straight
    from `format_conversations`; others are sorted first.
    """
    if not ordered:
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [LongType(), StringType(), LongType(), StringType(), LongType()]
    schema = StructType([pieces.schema["conv_id"], *map(StructField, names, kinds)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, id_type = [], None

        def rows() -> Iterator[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column("conv_id").type
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "generated")), strict=True)

        for conversation, parts in itertools.groupby(rows(), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            rest = ""
            for _, text, generated in parts:
                chars += len(text)
                if generated:
                    plain = unescape(text)
                    loss.update(plain.encode())
                    loss_chars += len(plain)
                rest += text
                while (end := rest.find(CLOSE)) >= 0:
                    turn, rest = rest[:end], rest[end + len(CLOSE) :]
                    if not turn.startswith(OPEN):
                        raise ValueError(f"conversation {conversation}: a turn without its mark")
                    role, _, body = turn[len(OPEN) :].partition(SEPARATOR)
                    turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    n_turns += 1
            found.append((conversation, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(found) >= 10_000:
                yield _batch(found, id_type, schema.names)
                found.clear()
        if found:
            yield _batch(found, id_type, schema.names)

    return map_batches(pieces.select("conv_id", "text", "generated"), read, schema)


def _batch(rows: list[tuple], id_type, names: list[str]) -> pa.RecordBatch:
    ids, *rest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, rest)], names=names)
