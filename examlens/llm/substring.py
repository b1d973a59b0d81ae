"""Repeated passages across documents, through anchors at difference-cover positions.

A window of `length` words of one document that also starts in another contains, for
every residue, positions that lie on the cover in both documents: the cover has two
members with any given difference. So hashing only the shorter windows that begin on
the cover finds a shared anchor in every long match. Anchors that two documents share
are then extended: the full windows around them are hashed and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import WHITE, Words, batches_by_size, map_batches, ragged, slices, whole_row, written

LENGTH = 50

# A perfect difference set: every residue modulo the period is a difference of two members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

# So many bytes of text are worked on at a time, or one text.
BATCH_BYTES = 3 << 20

# Odd multipliers of the window hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of all windows of a text from prefix sums, modulo 2^64."""

    def __init__(self, multiplier: int, seed: int):
        self.multiplier, self.seed = multiplier, seed
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, size: int) -> None:
        if size > len(self.powers):
            size = max(size, 2 * len(self.powers))
            for name, base in (("powers", self.multiplier), ("inverse", pow(self.multiplier, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, distinct: list[str]) -> np.ndarray:
        digest, seed = xxhash.xxh3_64_intdigest, self.seed
        return np.fromiter((digest(w, seed) for w in distinct), dtype=np.uint64, count=len(distinct))

    def windows(self, words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        self._grow(len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * self.powers[: len(words)], dtype=np.uint64, out=sums[1:])
        return ((sums[starts + length] - sums[starts]) * self.inverse[starts]).view(np.int64)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The id and a hash of the text name a row; rows equal in both are repeats of each other."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), _tag(text).alias("tag"), text.alias("text"))


def _tag(text: Column) -> Column:
    """Tells texts under one id apart: 40 bits, as every anchor and window carries it."""
    return F.shiftrightunsigned(F.xxhash64(text), 24)


def _facts(docs: DataFrame) -> DataFrame:
    """Every row's number of words and the digest of its words joined by one space."""
    joined = F.regexp_replace(F.btrim("text", F.lit(WHITE)), "[\\x20\\x09-\\x0D]+", " ")
    blanks = F.length("joined") - F.length(F.replace("joined", F.lit(" "), F.lit("")))
    words = F.when(F.col("joined") == "", 0).otherwise(blanks + 1).cast("long")
    named = docs.select("id", "tag", joined.alias("joined"))
    return named.select("id", "tag", words.alias("n_words"), F.unhex(F.sha2("joined", 256)).alias("digest"))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """The anchors `h` of every row with their places `at`, those of one batch combined.

    Equal anchors of one document are a row with the first place and a list `more` of the
    others. An anchor that two ids of the batch share is sent once, with MET for its
    place. Its places are shared for sure: they are lists of one row a document without
    `at`, under a hash that is no anchor's, which spreads those rows. So a hot anchor has
    a row a batch.
    """
    schema = StructType(
        [
            docs.schema["id"],
            docs.schema["tag"],
            StructField("h", LongType()),
            StructField("at", IntegerType()),
            StructField("more", ArrayType(IntegerType())),
        ]
    )
    width = length - PERIOD + 1
    on_cover = np.zeros(PERIOD, dtype=bool)
    on_cover[list(COVER)] = True

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(MULTIPLIERS[0], 1)
        for batch in batches_by_size(batches, "text", BATCH_BYTES):
            words = Words(batch.column("text"))
            hashed = rolling.words(words.distinct.to_pylist())
            sizes, hashes, places = np.zeros(len(words), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in np.flatnonzero(np.diff(words.rows) >= length):
                codes = words.of(row)
                starts = np.flatnonzero(on_cover[np.arange(len(codes) - width + 1) % PERIOD])
                hashes.append(rolling.windows(hashed[codes], starts, width))
                places.append(starts)
                sizes[row] = len(starts)
            of, h, at = np.repeat(np.arange(len(words)), sizes), np.concatenate(hashes), np.concatenate(places)
            shared, first, by = _met(_ranks(batch.column("id"))[of], h)
            yield _rows(batch, by[~shared[by]], of, (h,), at, schema)
            yield _rows(batch, first, of, (h,), np.full(len(at), MET), schema)
            yield _lists(batch, of[shared], at[shared], 1, schema)

    return map_batches(docs, find, schema)


# The place of an anchor that stands for all of its batch.
MET = -1


def _ranks(ids: pa.Array) -> np.ndarray:
    """The order of the ids, null last; equal ones have one rank."""
    return np.asarray(pc.rank(ids, null_placement="at_end", tiebreaker="dense"), dtype=np.int64)


def _met(order: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which anchors are those of two ids, one place of each such anchor, and all by hash; `order` ranks the ids."""
    by = np.argsort(h, kind="stable")
    if not len(by):
        return np.zeros(0, dtype=bool), by, by
    starts = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1])))
    ranked = order[by]
    two = np.minimum.reduceat(ranked, starts) < np.maximum.reduceat(ranked, starts)
    shared = np.empty(len(by), dtype=bool)
    shared[by] = np.repeat(two, np.diff(np.append(starts, len(by))))
    return shared, by[starts[two]], by


def _arrow_schema(batch: pa.RecordBatch, schema: StructType) -> pa.Schema:
    """Of rows of `id`, `tag`, hashes, `at` and `more`."""
    hashes = [pa.int64()] * (len(schema.names) - 4)
    kinds = [*(batch.schema.field(c).type for c in ("id", "tag")), *hashes, pa.int32(), pa.list_(pa.int32())]
    return pa.schema(list(zip(schema.names, kinds, strict=True)))


def _rows(
    batch: pa.RecordBatch, by: np.ndarray, of: np.ndarray, hashes: tuple[np.ndarray, ...], at: np.ndarray, schema: StructType
) -> pa.RecordBatch:
    """Rows for the places `by`, which has those of equal hashes in a run: equal ones of one document are one row.

    `of` is the row of the batch, `at` the place in the text, of all places. The rows
    keep the order of the batch: those of a document lie together and shuffle small.
    """
    again = np.zeros(len(by), dtype=bool)
    if len(by) > 1:
        again[1:] = of[by][1:] == of[by][:-1]
        for h in hashes:
            again[1:] &= h[by][1:] == h[by][:-1]
    first = by[~again]
    many = np.diff(np.append(np.flatnonzero(~again), len(by))) - 1 if len(by) else np.zeros(0, np.int64)
    order = np.argsort(first, kind="stable")
    rest = by[again]
    starts = np.cumsum(many) - many
    rows, many = first[order], many[order]
    offsets = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
    others = pa.array(at[rest[ragged(starts[order], many)]].astype(np.int32))
    columns = [
        *(batch.column(c).take(pa.array(of[rows])) for c in ("id", "tag")),
        *(pa.array(h[rows]) for h in hashes),
        pa.array(at[rows].astype(np.int32)),
        pa.ListArray.from_arrays(offsets, others, mask=pa.array(many == 0)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_arrow_schema(batch, schema))


def _lists(batch: pa.RecordBatch, of: np.ndarray, at: np.ndarray, hashes: int, schema: StructType) -> pa.RecordBatch:
    """A row with the list of its places for every row of the batch that has any, spread by its text."""
    rows, n = np.unique(of, return_counts=True)
    tags = batch.column("tag").take(pa.array(rows))
    spread = (np.asarray(tags).view(np.uint64) * np.uint64(MULTIPLIERS[1])).view(np.int64)
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    columns = [
        batch.column("id").take(pa.array(rows)),
        tags,
        *[pa.array(spread if i == 0 else ~spread) for i in range(hashes)],
        pa.nulls(len(rows), pa.int32()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_arrow_schema(batch, schema))


def _small(docs: DataFrame) -> DataFrame:
    """The texts compressed, for their way through the shuffle."""
    schema = StructType([docs.schema["id"], docs.schema["tag"], StructField("packed", BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches_by_size(batches, "text"):
            packed = [squeeze.compress(t.as_buffer()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tag"), pa.array(packed, pa.binary())], names=schema.names
            )

    return map_batches(docs, pack, schema)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with some compressed text, or one row, and the texts."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for start, stop in slices(batch.column("packed"), BATCH_BYTES // 4):
            part = batch.slice(start, stop - start)
            yield part, [expand.decompress(p.as_buffer()) for p in part.column("packed")]


def _shared(low: str = "low", high: str = "high", none: str = "none") -> Column:
    """Rows of two ids met, or one with an id and one without, which counts as the last."""
    return (F.col(low) < F.col(high)) | (F.col(low).isNotNull() & F.col(none))


def _later(first: Column) -> Column:
    """The row's id comes after `first`."""
    return (first < F.col("id")) | (F.col("id").isNull() & first.isNotNull())


def _decided(order: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some windows have an equal one with a smaller id among them, and all by hash; `order` ranks the ids."""
    by = np.lexsort((order, h2, h1))
    a, b = h1[by], h2[by]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    low = np.repeat(order[by][starts], np.diff(np.append(starts, len(by))))
    later = np.zeros(len(by), dtype=bool)
    later[by] = order[by] > low
    return later, by


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """The full windows around the shared anchors `places` of every row, under 128 bits of hash.

    Of the equal windows of one batch only those of the smallest id go on, a row a
    document with the first place `at` and a list `more` of the others. The rest is lost
    already: lists of one row a document without `at`, under a hash that is no window's,
    which spreads those rows.
    """
    schema = StructType(
        [
            rows.schema["id"],
            rows.schema["tag"],
            StructField("h1", LongType()),
            StructField("h2", LongType()),
            StructField("at", IntegerType()),
            StructField("more", ArrayType(IntegerType())),
        ]
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rollings = [Rolling(m, seed) for seed, m in enumerate(MULTIPLIERS, 11)]
        for batch, texts in _unpacked(batches):
            words = Words(pa.array(texts, pa.binary()).cast(pa.string()))
            distinct = words.distinct.to_pylist()
            hashed = [r.words(distinct) for r in rollings]
            places = batch.column("places")
            found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            for row in range(batch.num_rows):
                codes = words.of(row)
                last = len(codes) - length
                at = np.asarray(places[row].values, dtype=np.int64)
                change = np.zeros(last + 2, dtype=np.int64)
                np.add.at(change, np.minimum(np.maximum(at - PERIOD + 1, 0), last + 1), 1)
                np.add.at(change, np.minimum(at, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                sizes[row] = len(starts)
                for out, r, h in zip(found, rollings, hashed, strict=False):
                    out.append(r.windows(h[codes], starts, length))
                found[2].append(starts)
            of = np.repeat(np.arange(batch.num_rows), sizes)
            h1, h2, at = (np.concatenate(x) for x in found)
            later, by = _decided(_ranks(batch.column("id"))[of], h1, h2)
            yield _rows(batch, by[~later[by]], of, (h1, h2), at, schema)
            yield _lists(batch, of[later], at[later], 2, schema)

    return map_batches(rows, extend, schema)


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """The rows without the words that the windows starting at `places` cover."""
    schema = StructType(
        [rows.schema["id"], rows.schema["tag"], StructField("n_removed", LongType()), StructField("kept", StringType())]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            removed, kept = [], []
            for text, places in zip(texts, batch.column("places"), strict=True):
                words = text.split()
                starts = np.unique(np.asarray(places.values, dtype=np.int64))
                change = np.zeros(len(words) + 1, dtype=np.int64)
                change[starts] += 1
                change[starts + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tag"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=schema.names,
            )

    return map_batches(rows, remove, schema)



def _join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the row's name; the right side gives the other columns."""
    named = right.withColumnRenamed("id", "_id").withColumnRenamed("tag", "_tag")
    on = left["id"].eqNullSafe(named["_id"]) & (left["tag"] == named["_tag"])
    joined = left.join(named, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_id", "_tag")


def _all_places() -> Column:
    return F.array_union(F.collect_set("at"), F.flatten(F.collect_set("more"))).alias("places")


def _repeats(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the passes find: facts of all rows, later copies of a whole text, and rows that lose words.

    A text whose words are those of a smaller id's loses every window to it; it needs
    no windows of its own, so of a group of copies only the first is looked into. The
    texts move once, by the row's name, and serve both the windows and the cut.
    """
    facts = written(_facts(docs), "word_facts")
    long = facts.where(F.col("n_words") >= length).select("id", "tag", "digest")
    first = long.groupBy("digest").agg(F.min("id").alias("first"))
    copies = long.join(first, "digest").where(_later(F.col("first"))).select("id", "tag").distinct()

    # The anchors move once: they meet under their hash and stay there if two ids do.
    group = W.partitionBy("h")
    met = _anchors(docs, length).select(
        "id", "tag", "at", "more",
        F.min("id").over(group).alias("low"), F.max("id").over(group).alias("high"),
        F.max(F.col("id").isNull()).over(group).alias("none"), (F.min("at").over(group) == MET).alias("met"),
    ).where(F.col("at").isNull() | ((F.col("at") != MET) & (F.col("met") | _shared())))
    # Sets: equal rows share a name and must not get the places of each of them.
    places = met.groupBy("id", "tag").agg(_all_places())
    texts = _small(docs)
    windows = _windows(_join(texts, _join(places, copies, "left_anti"), "inner"), length)
    same = W.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("id"))
    taken = windows.withColumn("first", F.first("id").over(same.rowsBetween(W.unboundedPreceding, W.currentRow)))
    gone = taken.where(F.col("at").isNull() | _later(F.col("first"))).groupBy("id", "tag")
    lost = _cut(_join(texts, gone.agg(_all_places()), "inner"), length)
    return facts, copies, lost


def substring_dedup(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH
) -> DataFrame:
    """Every row's id, `n_words`, `n_removed` and `kept_sha256`.

    Removed is each word in a window of `length` words whose words also start in a
    document with a smaller id, on the input as it is. The digest is that of the kept
    words joined by one space. A null text has no words; a row without id comes after
    all ids and takes no words from others; rows with one id do not take from each
    other, equal rows get equal results; an empty table gives none; other columns are
    not read. `length` is at least 31, the period of the cover.

    Equal windows are combined before their shuffle: of a passage in many documents each
    batch of texts sends the windows of its smallest id alone, so a hot hash has as many
    rows as there are batches. They go through one streamed, spilling window function.
    The anchors are combined in the same way and move once.
    """
    facts, copies, lost = _repeats(_keyed(docs, id_column, text_column), length)
    copied = copies.withColumn("copied", F.lit(True))
    lost = lost.select("id", "tag", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["id", "tag"])
    both = _join(_join(facts, copied, "left"), lost, "left")
    return both.select(
        F.col("id").alias(id_column),
        "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest"))))
        .alias("kept_sha256"),
    )


def without_repeats(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH
) -> DataFrame:
    """The rows with the text cut as in `substring_dedup`; the columns are those of `docs`.

    Rows that lose no word keep their text as it was, rows that lose every word go. A
    column `n_chars` follows the new text.
    """
    keyed = _keyed(docs, id_column, text_column)
    _, copies, lost = _repeats(keyed, length)
    rows = docs.select(whole_row(docs).alias("_row"), F.col(id_column).alias("id"),
                       _tag(F.coalesce(F.col(text_column), F.lit(""))).alias("tag"))
    lost = lost.select("id", "tag", "kept").dropDuplicates(["id", "tag"])
    left = _join(_join(rows, copies, "left_anti"), lost, "left").where("kept is null or kept <> ''")
    text = F.coalesce("kept", F.col("_row")[text_column])
    columns = [F.col("_row")[c].alias(c) if c != text_column else text.alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        counted = F.when(F.col("kept").isNotNull(), F.length("kept").cast(kind)).otherwise(F.col("_row")["n_chars"])
        columns[docs.columns.index("n_chars")] = counted.alias("n_chars")
    return left.select(*columns)
