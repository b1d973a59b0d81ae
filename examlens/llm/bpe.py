"""Byte-level BPE over a global shuffle of different words.

Texts are cut into blocks of rows. A block sends each of its different pre-tokens once,
numbered by frequency, and its texts as sequences of those numbers. The words of all
blocks meet in one shuffle, where each different one is encoded once; the ids go back
to the blocks, which put them together by position.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType,
)

from .common import byte_lengths, map_batches, ragged, ship, slices, strings
from .tokenizing import UNSURE

BLOCK_BYTES = 16 << 20
WORDS_AT_ONCE = 200_000
CODES_AT_ONCE = 500_000
OTHER_ORDER = "the rows came in another order the second time; write the table first"


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def load_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, and where the token of each id starts and how long it is.

    As large as the vocabulary, whatever the corpus.
    """
    ranks = load_ranks(path)
    size = max(ranks.values()) + 1
    by_id = [b""] * size
    for token, rank in ranks.items():
        by_id[rank] = token
    lengths = np.fromiter(map(len, by_id), dtype=np.int64, count=size)
    return np.frombuffer(b"".join(by_id), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


class Positions:
    """The pre-tokens of some texts as numbers: `codes`, `bounds` of each text, `words` by number.

    Texts are first cut before blanks that other than white space follows, where the
    pattern always has a boundary, so it runs over each different piece once; a text
    with any other blank is matched whole. Numbers go by falling frequency.
    """

    def __init__(self, texts: pa.Array, pattern: str):
        match = regex.compile(pattern).findall
        numbers: dict[str, int] = {}
        flat: list[int] = []
        sizes: list[int] = []

        def unit(text: str) -> int:
            found = match(text)
            flat.extend([numbers.setdefault(w, len(numbers)) for w in found])
            sizes.append(len(found))
            return len(sizes) - 1

        texts = strings(texts)
        parts = pc.split_pattern(texts, pattern=" ")
        bounds = np.asarray(parts.offsets, dtype=np.int64)
        values = parts.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        encoded = values.dictionary_encode()
        codes, distinct = np.asarray(encoded.indices), encoded.dictionary.to_pylist()
        first = np.zeros(len(codes), dtype=bool)
        first[bounds[:-1]] = True
        sure = np.array([bool(p) and not (p[0].isspace() or p[0] in UNSURE) for p in distinct], dtype=bool)
        later = np.zeros(len(distinct), dtype=bool)
        later[codes[~first]] = True
        units = np.zeros(len(distinct), dtype=np.int64)
        for i in np.flatnonzero(later & sure):
            units[i] = unit(" " + distinct[i])
        whole = np.add.reduceat((~sure[codes] & ~first).astype(np.int64), bounds[:-1]) > 0
        taken = units[codes]
        kept = ~np.repeat(whole, np.diff(bounds))
        starts = bounds[:-1]
        for row, at in enumerate(starts):
            taken[at] = unit(texts[row].as_py() if whole[row] else distinct[codes[at]])
        kept[starts] = True
        lengths = np.array(sizes, dtype=np.int64)
        begins = np.cumsum(lengths) - lengths
        many = lengths[taken] * kept
        out = np.array(flat, dtype=np.int64)[ragged(begins[taken], many)]
        self.bounds = np.concatenate(([0], np.cumsum(many)))[bounds]
        counts = np.bincount(out, minlength=len(numbers))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        self.codes = rank[out]
        words = list(numbers)
        self.words = [words[i] for i in order]


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Numbered blocks of at most BLOCK_BYTES of text, or one row, alike in every run over the same rows."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start, stop in slices(batch.column(text), BLOCK_BYTES):
            yield number, batch.slice(start, stop - start)
            number += 1


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _pack(number: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """Rising word numbers, how many ids each has, and the ids, in one compressed piece."""
    return _squeeze(np.concatenate(([len(number)], np.diff(number, prepend=0), sizes, ids)))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = _expand(data)
    n = int(values[0])
    return np.cumsum(values[1 : n + 1], dtype=np.int64), values[n + 1 : 2 * n + 1].astype(np.int64), values[2 * n + 1 :]


def _squeeze(codes: np.ndarray) -> bytes:
    """Numbers byte by byte, lowest bytes first, compressed: frequent ones are small."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encode(
    docs: DataFrame, ranks_file: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every row's id, `n_tokens` and `ids` (binary, little-endian unsigned 32 bit) under the ranks.

    Each match of `pattern` is encoded separately, without special tokens. What a block
    sends is each different word once, so a frequent word gives a row a block and not a
    row an occurrence; no block outgrows BLOCK_BYTES of text, or one text. The blocks
    are cut twice, for the words and for the positions; rows that come in another order
    the second time (only tables that are not read from files) are found by the texts'
    lengths and fail the job.

    A null text is empty and has no ids, null and repeated ids are rows like any other,
    an empty table gives none, other columns are not read.
    """
    source = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    id_field = StructField("id", docs.schema[id_column].dataType)
    word_schema = StructType(
        [StructField("block", LongType()), StructField("number", IntegerType()), StructField("word", StringType())]
    )
    position_schema = StructType(
        [
            StructField("block", LongType()),
            StructField("id", ArrayType(id_field.dataType)),
            StructField("n_words", ArrayType(LongType())),
            StructField("n_bytes", ArrayType(LongType())),
            StructField("codes", BinaryType()),
        ]
    )
    ids_schema = StructType([word_schema.fields[0], StructField("packed", BinaryType())])
    out_schema = StructType(
        [StructField(id_column, id_field.dataType), StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _blocks(batches, "text"):
            found = Positions(batch.column("text"), pattern).words
            columns = [np.full(len(found), block), np.arange(len(found), dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(found, pa.string())], names=word_schema.names)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _blocks(batches, "text"):
            found = Positions(batch.column("text"), pattern)
            per_row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), values)
            columns = [
                pa.array([block]),
                per_row(batch.column("id")),
                per_row(pa.array(np.diff(found.bounds))),
                per_row(pa.array(byte_lengths(batch.column("text")))),
                pa.array([_squeeze(found.codes)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=position_schema.names)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_file, pattern)
        for table in _gathered(batches, WORDS_AT_ONCE):
            once = table.column("word").combine_chunks().dictionary_encode()
            each = [np.array(encoding.encode_ordinary(w), dtype=np.uint32) for w in once.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
            flat, begins = np.concatenate(each), np.cumsum(sizes) - sizes
            block, number = (np.asarray(table.column(c).combine_chunks()) for c in ("block", "number"))
            order = np.lexsort((number, block))
            block, number, word = block[order], number[order], np.asarray(once.indices)[order]
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            packed = [
                _pack(number[x:y], sizes[word[x:y]], flat[ragged(begins[word[x:y]], sizes[word[x:y]])])
                for x, y in zip(starts, np.append(starts[1:], len(block)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(packed, pa.binary())], names=ids_schema.names)

    def assemble(texts: pa.Table, table: pa.Table) -> pa.Table:
        lengths_of = token_table(ranks_file)[2]
        parts = [_unpack(p.as_py()) for p in table.column("packed")]
        number, stored, flat = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        sizes, begins = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        sizes[number], begins[number] = stored, np.cumsum(stored) - stored
        made = []
        for row in texts.to_batches():
            for i in range(row.num_rows):
                codes = _expand(row.column("codes")[i].as_py())
                if len(codes) and codes.max() >= len(sizes):
                    raise ValueError(OTHER_ORDER)
                ids, n_words, n_bytes = row.column("id")[i].values, *(np.asarray(row.column(c)[i].values) for c in ("n_words", "n_bytes"))
                ends = np.concatenate(([0], np.cumsum(n_words)))
                at = 0
                while at < len(ids):  # some rows at a time: memory follows the block's codes, not its ids
                    stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CODES_AT_ONCE, side="right")) - 1)
                    part = codes[ends[at] : ends[stop]]
                    many = sizes[part]
                    found = flat[ragged(begins[part], many)]
                    bounds = np.concatenate(([0], np.cumsum(many)))[ends[at : stop + 1] - ends[at]]
                    total = np.concatenate(([0], np.cumsum(lengths_of[found])))[bounds]
                    if (np.diff(total) != n_bytes[at:stop]).any():
                        raise ValueError(OTHER_ORDER)
                    offsets = pa.py_buffer((bounds * 4).astype(np.int32))
                    binary = pa.Array.from_buffers(pa.binary(), stop - at, [None, offsets, pa.py_buffer(found.astype("<u4").tobytes())])
                    columns = [ids.slice(at, stop - at), pa.array(np.diff(bounds)), binary]
                    made.append(pa.Table.from_arrays(columns, names=out_schema.names))
                    at = stop
        return pa.concat_tables(made)

    ship(docs.sparkSession)
    by_word = map_batches(source, words, word_schema).repartition("word").sortWithinPartitions("word")
    ids = map_batches(by_word, encode_words, ids_schema)
    texts = map_batches(source, positions, position_schema)
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(assemble, out_schema)


def decode(encoded: DataFrame, ranks_file: str, *, ids_column: str = "ids", out_column: str = "bytes") -> DataFrame:
    """The rows with the bytes their ids stand for, joined from the token-byte table.

    The table has one row a token of the vocabulary, a bound that no corpus moves, so
    the join is made on the map side: each worker holds the table and no id is shuffled.
    Null ids give no bytes; an id outside the table fails the job.
    """
    schema = StructType([*encoded.schema.fields, StructField(out_column, BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, lengths = token_table(ranks_file)
        for batch in batches:
            for start, stop in slices(batch.column(ids_column), 1 << 20):
                part = batch.slice(start, stop - start)
                column = pc.fill_null(part.column(ids_column), pa.scalar(b"", pa.binary()))
                ids = np.frombuffer(b"".join(x.as_buffer() for x in column), dtype="<u4")
                many = lengths[ids]
                per_row = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(column), dtype=np.int64) // 4)))
                ends = np.concatenate(([0], np.cumsum(many)))[per_row]
                found = data[ragged(starts[ids], many)]
                offsets = pa.py_buffer(ends.astype(np.int32))
                binary = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, pa.py_buffer(found.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, binary], names=schema.names)

    return map_batches(encoded, join, schema)
