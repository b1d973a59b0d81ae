"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A fingerprint holds, per cell, the number of paragraphs in it, the exclusive or of
their digests and of their check values. Subtracting two of them leaves the paragraphs
that differ; cells with a single one are peeled until nothing is left.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from .common import batches_by_size, map_batches, shuffle_partitions, strings

CELLS = 24  # of the kept fingerprint
HASHES = 3
LINE_CHARS = 256  # a line's paragraph is cut there at the latest
LINE_WORDS = 10  # and after so many words, so that a short text is several paragraphs
# So many ids at most, on average, tell the ranges of all.
SAMPLE = 1 << 20

CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
CHECK_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _runs(line: str) -> list[str]:
    """The line cut after every LINE_WORDS blanks; joined by blanks they are the line."""
    words = line.split(" ")
    return [" ".join(words[at : at + LINE_WORDS]) for at in range(0, len(words), LINE_WORDS)]


def paragraphs(text: str) -> np.ndarray:
    """Digests of the lines with something in them, the n-th copy of a line apart from the first.

    Lines count in parts of LINE_WORDS words and at most LINE_CHARS characters.
    """
    digest, seen, found = xxhash.xxh3_64_intdigest, {}, []
    for line in text.split("\n"):
        for words in _runs(line):
            for at in range(0, len(words), LINE_CHARS):
                part = words[at : at + LINE_CHARS]
                copy = seen.get(part, 0)
                seen[part] = copy + 1
                found.append(digest(part.encode("utf-8", "surrogatepass"), copy))
    return np.array(found, dtype=np.uint64)


def _places(digests: np.ndarray, cells: int) -> np.ndarray:
    """A cell in each third of the table; another table size mixes anew."""
    third = cells // HASHES
    mixed = digests * np.uint64(2 * cells + 1)
    mixed ^= mixed >> np.uint64(29)
    shifts = np.array([0, 21, 42], dtype=np.uint64)
    return ((mixed[:, None] >> shifts) % np.uint64(third)).astype(np.int64) + np.arange(HASHES) * third


def _checks(digests: np.ndarray) -> np.ndarray:
    return ((digests * CHECK_FACTOR) >> np.uint64(32)).astype(np.uint32)


def sketch(digests: np.ndarray, cells: int = CELLS) -> np.ndarray:
    table = np.zeros(cells, dtype=CELL)
    if len(digests):
        places = _places(digests, cells).ravel()
        table["count"] = np.bincount(places, minlength=cells)
        np.bitwise_xor.at(table["key"], places, np.repeat(digests, HASHES))
        np.bitwise_xor.at(table["check"], places, np.repeat(_checks(digests), HASHES))
    return table


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    left = np.empty(len(a), dtype=CELL)
    left["count"] = a["count"] - b["count"]
    left["key"] = a["key"] ^ b["key"]
    left["check"] = a["check"] ^ b["check"]
    return left


def peel(table: np.ndarray) -> tuple[list[int], list[int]] | None:
    """The digests only in the first and only in the second, or None if cells are left over."""
    cells = len(table)
    count, key, check = table["count"].copy(), table["key"].copy(), table["check"].copy()
    only: tuple[list[int], list[int]] = ([], [])
    while True:
        pure = np.flatnonzero((np.abs(count) == 1) & (_checks(key) == check))
        if not len(pure):
            return only if not (count.any() or key.any() or check.any()) else None
        digests, first = np.unique(key[pure], return_index=True)
        signs = count[pure][first]
        for digest, sign in zip(digests.tolist(), signs.tolist(), strict=True):
            only[sign < 0].append(digest)
        places = _places(digests, cells).ravel()
        np.subtract.at(count, places, np.repeat(signs, HASHES))
        np.bitwise_xor.at(key, places, np.repeat(digests, HASHES))
        np.bitwise_xor.at(check, places, np.repeat(_checks(digests), HASHES))
        if len(only[0]) + len(only[1]) > 2 * cells:
            return None


def difference(a: np.ndarray, b: np.ndarray, kept_a: np.ndarray, kept_b: np.ndarray) -> tuple[int, int]:
    """How many paragraphs are only in `a` and only in `b`, from their kept fingerprints.

    Where those do not peel, larger ones are made of the digests until they do; the
    first of these has room for all paragraphs of both.
    """
    found, cells = peel(subtract(kept_a, kept_b)), len(kept_a)
    for _ in range(20):
        if found is not None:
            return len(found[0]), len(found[1])
        cells = max(2 * cells, 3 * (len(a) + len(b)) // 2)
        cells += -cells % HASHES
        found = peel(subtract(sketch(a, cells), sketch(b, cells)))
    return len(np.setdiff1d(a, b)), len(np.setdiff1d(b, a))


def likeness(a: np.ndarray, b: np.ndarray, kept_a: np.ndarray, kept_b: np.ndarray) -> float:
    """Common paragraphs over all paragraphs; 1 for two texts without any."""
    if not len(a) and not len(b):
        return 1.0
    only_a, only_b = difference(a, b, kept_a, kept_b)
    return (len(a) - only_a) / (len(a) + only_b)


def to_text(table: np.ndarray) -> str:
    return base64.b64encode(table.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=CELL)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(named: DataFrame, parts: int) -> np.ndarray:
    """Bounds of up to `parts` ranges of ids, rising, from SAMPLE ids on average at most.

    They only decide how even the ranges are; what is in them is the same for any bounds.
    """
    share = min(1.0, min(SAMPLE, 100 * parts) / max(1, named.count()))
    picked = named if share == 1 else named.sample(fraction=share, seed=1)
    ids = np.sort(np.array([r["id"] for r in picked.collect()], dtype=np.int64))
    return np.unique(ids[np.arange(1, parts) * len(ids) // parts]) if len(ids) else ids


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows `part`, `ahead`, `id`, `packed` text, sorted so that each row's next one follows in its partition.

    Partitions are ranges of ids. The driver holds their bounds and one number per
    partition: the first id of each, whose row also goes, marked `ahead`, to the
    partition before; the first row of all goes to the last partition. Texts pass one
    shuffle, compressed.
    """
    parts = shuffle_partitions(docs.sparkSession)
    named = docs.where("id is not null").select("id")
    bounds = _bounds(named, parts)

    def part_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, ids, side="right")

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.sort(np.asarray(batch.column("id")))
            own, first = np.unique(part_of(ids), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids[first])], names=["part", "id"])

    narrow = StructType([StructField("part", LongType()), StructField("id", LongType())])
    firsts = map_batches(named, lowest, narrow).groupBy("part").agg(F.min("id").alias("id")).collect()
    firsts = sorted((r["id"], r["part"]) for r in firsts)
    # The first id of a partition -> the partition before it that has rows.
    before = {first: firsts[i - 1][1] for i, (first, _) in enumerate(firsts)}

    schema = StructType(
        [
            StructField("part", IntegerType()),
            StructField("ahead", IntegerType()),
            StructField("id", LongType()),
            StructField("packed", BinaryType()),
        ]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches_by_size(batches, "text"):
            ids = batch.column("id").to_pylist()
            packed = [squeeze.compress(t.as_buffer()) for t in strings(batch.column("text"))]
            own = part_of(np.array([i or 0 for i in ids], dtype=np.int64))
            own = [zlib.crc32(p) % parts if i is None else int(x) for i, x, p in zip(ids, own, packed, strict=True)]
            rows = [(x, 0 if i is not None else 2, i, p) for x, i, p in zip(own, ids, packed, strict=True)]
            rows += [(before[i], 1, i, p) for i, p in zip(ids, packed, strict=True) if i in before]
            columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    placed = map_batches(docs, place, schema)
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", "id", "packed")


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with its fingerprint, its edited version's, and how like they are.

    Columns: the id, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`,
    `near_edited`, `near_next`. The edited text is `edited_text` with the next document
    by id, after the last the first; rows that repeat an id follow each other in a fixed
    order. A row without id has no place in that order: nothing follows it, and its
    next document is an empty one. Null texts are empty; a single document is its own
    next; an empty table gives none; ids are whole numbers; other columns are not read.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    schema = StructType(
        [
            StructField(id_column, LongType()),
            StructField("n_chars", LongType()),
            StructField("edited_sha256", StringType()),
            StructField("fingerprint", StringType()),
            StructField("edited_fingerprint", StringType()),
            StructField("near_edited", DoubleType()),
            StructField("near_next", DoubleType()),
        ]
    )
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()

        def texts() -> Iterator[tuple]:
            for batch in batches:
                for part, ahead, doc, packed in zip(*(batch.column(c) for c in ("part", "ahead", "id", "packed")), strict=True):
                    text = expand.decompress(packed.as_buffer()).decode()
                    digests = paragraphs(text)
                    yield part.as_py(), ahead.as_py(), doc.as_py(), text, digests, sketch(digests)

        def judged(row: tuple, following: tuple) -> tuple:
            _, _, doc, text, digests, kept = row
            _, _, _, next_text, next_digests, next_kept = following
            edited = edited_text(text, next_text)
            edited_digests = paragraphs(edited)
            edited_kept = sketch(edited_digests)
            return (
                doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(kept), to_text(edited_kept),
                likeness(digests, edited_digests, kept, edited_kept), likeness(digests, next_digests, kept, next_kept),
            )

        nothing = (None, None, None, "", paragraphs(""), sketch(paragraphs("")))
        out, row = [], None
        for following in texts():
            if following[1] == 2:
                out.append(judged(following, nothing))
                continue
            if row is not None and row[1] == 0:
                out.append(judged(row, following))
            row = following
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return map_batches(_in_order(source), compare, schema)
