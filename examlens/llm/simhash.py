"""SimHash near-duplicates through deletion-variant signatures."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_batches, shuffle_partitions, strings, whole_row, written
from .graph import components

BITS = 64
SEED = 42  # fixed value of the contract
SHINGLE = 4
MAX_BITS = 4
# Of a key, below its variant's number. The bits that a key keeps are fewer; six bytes a
# key matter, as every variant of every fingerprint goes through two shuffles.
HASH_BITS = 38
# Groups of more fingerprints are cut into blocks of about this many.
BLOCK = 4096
# Groups of up to so many are compared pair by pair, larger ones search link by link.
SMALL = 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in spans]
    values = np.array(hashes, dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(values), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, carried: tuple[str, ...], text_column: str = "text") -> DataFrame:
    """The carried columns and `fp`, the fingerprint as a signed long; a null text is empty."""
    fields = [docs.schema[c] for c in carried]
    schema = StructType([*fields, StructField("fp", LongType())])
    source = docs.select(*carried, F.col(text_column).alias("_text"))

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column("_text"))
            found = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), shingle) for t in texts), dtype=np.uint64, count=len(texts))
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=schema.names)

    return map_batches(source, hash_texts, schema)


@dataclass(frozen=True)
class Variant:
    """A key of a fingerprint: a segment without its deleted bit (if any) and one slice of the rest."""

    mask: int  # of the segment, its deleted bit left out
    slice_mask: int
    bit: int  # the deleted bit, or -1


def _slices(low: int, high: int, parts: int) -> list[int]:
    """The bits outside a segment in so many slices of about equal width, as masks."""
    outside = [b for b in range(BITS) if not low <= b < high]
    cuts = [len(outside) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in outside[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def variants(max_bits: int) -> list[Variant]:
    """The keys under which any two fingerprints at most `max_bits` apart meet.

    The fingerprint is cut into the fewest segments (two at least) of which one differs
    in at most one bit. Each segment gives a key per bit, with that bit deleted: two
    that differ in this very bit meet there, on different sides of it, and have at most
    max_bits - 1 bits left for the other segments, so of as many slices of those as
    max_bits one is equal; it makes part of the key. Equal segments meet under keys
    without a deleted bit, with a slice more.
    """
    parts = max(2, max_bits // 2 + 1)
    edges = [BITS * i // parts for i in range(parts + 1)]
    found = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        whole = (1 << high) - (1 << low)
        found += [Variant(whole, s, -1) for s in _slices(low, high, max_bits + 1)]
        if max_bits:
            found += [Variant(whole & ~(1 << bit), s, bit) for bit in range(low, high) for s in _slices(low, high, max_bits)]
    return found


def _keyed(prints: DataFrame, found: list[Variant]) -> DataFrame:
    """`fp`, `key` and `side`, whether the bit that the key leaves out is set.

    A key has its variant's number above HASH_BITS bits, a hash of its bits of `fp` in them.
    """
    masks = [
        F.struct(
            F.lit(i << HASH_BITS),
            F.lit(_signed(v.mask | v.slice_mask)),
            F.lit(_signed(1 << v.bit) if v.bit >= 0 else 0),
        )
        for i, v in enumerate(found)
    ]
    spread = prints.repartition(shuffle_partitions(prints.sparkSession), "fp")
    each = spread.select("fp", F.inline(F.array(*masks)).alias("number", "mask", "left_out"))
    hashed = F.shiftrightunsigned(F.xxhash64(F.col("fp").bitwiseAND(F.col("mask"))), BITS - HASH_BITS)
    return each.select(
        "fp",
        F.col("number").bitwiseOR(hashed).alias("key"),
        (F.col("fp").bitwiseAND(F.col("left_out")) != 0).alias("side"),
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _pairs(fp: np.ndarray, side: np.ndarray, any_side: bool, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one group that connect what its links connect.

    From each found fingerprint only those not found yet are searched, so a group of
    near copies costs little more than one pass and gives fewer links than members.
    """
    rest, links = np.arange(len(fp)), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            p = todo.pop()
            near = np.bitwise_count(fp[rest] ^ fp[p]) <= max_bits
            if not any_side:
                near &= side[rest] != side[p]
            hit = rest[near]
            if len(hit):
                links.append((np.full(len(hit), p), hit))
                todo.extend(hit.tolist())
                rest = rest[~near]
    return links


def _linked(table: pa.Table, bits: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """Links within the groups of a table that is sorted by `group`."""
    group, key, fp = (np.asarray(table.column(c).combine_chunks()) for c in ("group", "key", "fp"))
    fp = fp.view(np.uint64)
    bit = bits[key >> HASH_BITS]
    any_side = bit < 0
    side = (fp >> np.maximum(bit, 0).astype(np.uint64)) & np.uint64(1)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    small = np.repeat(sizes <= SMALL, sizes)
    a, b = [], []
    for gap in range(1, SMALL):
        one = np.flatnonzero((group[gap:] == group[:-gap]) & small[gap:])
        other = one + gap
        near = np.bitwise_count(fp[one] ^ fp[other]) <= max_bits
        near &= any_side[one] | (side[one] != side[other])
        a.append(one[near])
        b.append(other[near])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        part = slice(start, start + size)
        for x, y in _pairs(fp[part], side[part], bool(any_side[part].any()), max_bits):
            a.append(x + start)
            b.append(y + start)
    ends = np.stack([fp[np.concatenate(a)], fp[np.concatenate(b)]], axis=1).view(np.int64)
    ends = np.unique(ends, axis=0) if len(ends) else ends
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])


def _search(batches: Iterator[pa.RecordBatch], bits: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links in rows sorted by group; a group may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.asarray(batch.column("group"))
        last = int(np.searchsorted(group, group[-1]))
        if held and held[0].column("group")[-1].as_py() != group[-1]:
            held.append(batch.slice(0, last))
            yield _linked(pa.Table.from_batches(held), bits, max_bits)
            held = [batch.slice(last)]
        elif held:
            held.append(batch)
        else:
            if last:
                yield _linked(pa.Table.from_batches([batch.slice(0, last)]), bits, max_bits)
            held = [batch.slice(last)]
    if held:
        yield _linked(pa.Table.from_batches(held), bits, max_bits)


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links `a`, `b` between fingerprints at most `max_bits` apart that connect all such.

    `prints` has the different fingerprints `fp`. Keys of a single fingerprint are left
    out after a count that is combined before its shuffle. A key with more than `block`
    fingerprints is cut into blocks by hash, and every two blocks become a group of
    their own, so no task holds a whole hot key and no pair is missed. Groups that
    meet in one 64-bit group number only compare more; every link is verified.
    """
    found = variants(max_bits)
    rows = _keyed(prints, found)
    # One number a key, as it is shuffled: fingerprints in the low half, those with the bit set above.
    counts = rows.groupBy("key").agg(F.sum(F.when(F.col("side"), (1 << 32) + 1).otherwise(1)).alias("met"))
    n, turned = F.col("met").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("met", 32)
    # A key that leaves out a bit in which its fingerprints agree links none.
    whole = F.element_at(
        F.array(*[F.lit(v.bit < 0) for v in found]), F.shiftrightunsigned("key", HASH_BITS).cast("int") + 1
    )
    shared = counts.where((n > 1) & (whole | ((turned > 0) & (turned < n)))).select("key", n.alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = (
        rows.select("fp", "key")
        .join(shared.hint("shuffle_hash"), "key")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("blocks = 1 or own <> other")
    )
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    ordered = met.select(group.alias("group"), "key", "fp").repartition("group").sortWithinPartitions("group")
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    bits = np.array([v.bit for v in found])
    return map_batches(ordered, lambda batches: _search(batches, bits, max_bits), schema).distinct()


def classes(prints: DataFrame, id_column: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """`fp`, `root` (its component) and `component_id`, the smallest id reached from its documents.

    `prints` has the id and `fp` of every document. Equal fingerprints are one node, so
    copies of any number cost one row here.
    """
    nodes = written(prints.groupBy("fp").agg(F.min(id_column).alias("low")), "simhash_nodes")
    stars = components(links(nodes.select("fp"), max_bits)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = nodes.join(stars, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lows, "root").select("fp", "root", "component_id")


def simhash_groups(
    docs: DataFrame,
    *,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: the id, `fp` (signed long) and `component_id`.

    Documents are linked if their fingerprints differ in at most `max_bits` bits;
    `component_id` is the smallest id in the connected component. A null or empty text
    has fingerprint zero and is linked like any other; a null id never is the smallest
    unless the component has no other; repeated rows stay; an empty table gives none;
    other columns are not read.
    """
    prints = fingerprints(docs, shingle=shingle, carried=(id_column,), text_column=text_column)
    prints = written(prints, "simhash_prints")
    return prints.join(classes(prints, id_column, max_bits), "fp").select(id_column, "fp", "component_id")


def one_per_group(
    docs: DataFrame,
    *,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id.

    Among repeated ids the row with the smallest hash of its text stays, among rows equal
    in both the one with the smallest hash of all its columns (any of them where a column
    cannot be hashed); a null id comes last. The columns are those of `docs`.

    The choice is made on numbers. The rows are read again to pick the chosen ones, under
    128 bits of hash of id and text; they move once and are not written in between.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    name = F.struct(
        F.xxhash64(F.lit(1), id_column, text).alias("h1"), F.xxhash64(F.lit(2), text, id_column).alias("h2")
    )
    source = docs.select(
        whole_row(docs).alias("_row"), F.col(id_column).alias("_id"), text.alias("_body"), name.alias("_name")
    ).select("_row", "_id", "_body", "_name.*")
    prints = written(fingerprints(source, shingle=shingle, carried=("_id", "h1", "h2"), text_column="_body"), "simhash_prints")
    named = prints.groupBy("_id", "h1", "h2", "fp").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "h1", "h2", "n")
    chosen = (
        named.join(classes(prints, "_id", max_bits).select("fp", "root"), "fp")
        .groupBy("root")
        .agg(F.min(order).alias("first"))
        .select("first.h1", "first.h2", "first.n")
    )
    chosen = written(chosen, "simhash_chosen")
    met = source.select("_row", "h1", "h2").join(chosen, ["h1", "h2"])
    once = met.where("n = 1").select("_row.*")
    # Repeats of a chosen row; they are combined before their shuffle.
    plain = [c for c, kind in docs.dtypes if not re.search("map<|variant", kind)]
    smallest = F.min_by("_row", F.xxhash64(*[F.col("_row")[c] for c in plain]))
    repeats = met.where("n > 1").groupBy("h1", "h2").agg(smallest.alias("_row")).select("_row.*")
    return once.unionAll(repeats)
