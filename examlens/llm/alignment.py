"""Where the tokens of two tokenizers meet, and how often each pair of tokens does.

The ends of both token lists are byte offsets into the same text. The offsets at which
both have an end cut the tokens into groups; they are found by galloping: the shorter
list drives an exponential and then a binary search into what is left of the longer.
"""

from __future__ import annotations

import functools
import hashlib
import os
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, LongType, StringType, StructField, StructType,
)

from .common import byte_lengths, map_batches, ragged, ship, slices, strings, written
from .tokenizing import UNSURE, Growing

# Texts of one block share the list of their different id pairs; a block has at most so many bytes, or one text.
BLOCK_BYTES = 2 << 20
# A process forgets its different pieces once it has more of them, or more ids in them.
CACHED_PIECES, CACHED_WORDS = 300_000, 4_000_000
# Ids that are spelt at a time.
WORDS_AT_ONCE = 1 << 20
# Lists and groups beyond this are worked on one by one.
LONG = 256

BLANK = "▁"  # fixed value: how pieces write a blank


def common_ends(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """The places i, j of equal offsets a[i] == b[j] in two rising lists."""
    if len(a) > len(b):
        return [(i, j) for j, i in common_ends(b, a)]
    found, at, size = [], 0, len(b)
    for i, end in enumerate(a):
        probe, step = at, 1
        while probe < size and b[probe] < end:
            at, probe, step = probe + 1, probe + step, 2 * step
        at = bisect_left(b, end, at, min(probe, size))
        if at == size:
            break
        if b[at] == end:
            found.append((i, at))
            at += 1
    return found


def common_ends_of_all(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`common_ends` of many pairs of lists at once, as places in the lists laid end to end.

    List k is a[a_starts[k]:a_starts[k + 1]] and the same of `b`. All pairs gallop in step,
    one element of their shorter list after the other; long lists go by themselves.
    """
    sizes = np.stack([np.diff(a_starts), np.diff(b_starts)])
    swap = sizes[0] > sizes[1]
    left, right = [], []
    both = np.concatenate([a, b])
    starts = np.stack([a_starts[:-1], b_starts[:-1] + len(a)])
    k = np.arange(len(swap))
    at, size = starts[swap.astype(int), k], sizes[swap.astype(int), k]  # of the shorter list
    low, high = starts[1 - swap.astype(int), k], (starts + sizes)[1 - swap.astype(int), k]
    for lane in np.flatnonzero(size > LONG):
        found = common_ends(a[a_starts[lane] : a_starts[lane + 1]].tolist(), b[b_starts[lane] : b_starts[lane + 1]].tolist())
        i, j = np.array(found, dtype=np.int64).reshape(-1, 2).T
        left.append(i + a_starts[lane])
        right.append(j + b_starts[lane])
    active = np.flatnonzero((size > 0) & (size <= LONG) & (low < high))
    stop = at + size
    while len(active):
        target, probe, step = both[at[active]], low[active], 1
        end, start = high[active], low[active].copy()
        going = np.arange(len(active))
        while len(going):  # exponential search
            going = going[(probe[going] < end[going])]
            going = going[both[probe[going]] < target[going]]
            start[going] = probe[going] + 1
            probe[going] += step
            step *= 2
        probe = np.minimum(probe, end)
        while (wide := np.flatnonzero(start < probe)).size:  # binary search
            middle = (start[wide] + probe[wide]) // 2
            less = both[middle] < target[wide]
            start[wide] = np.where(less, middle + 1, start[wide])
            probe[wide] = np.where(less, probe[wide], middle)
        inside = start < end
        hit = np.flatnonzero(inside)[both[start[inside]] == target[inside]]
        one, other = at[active[hit]], start[hit]
        turned = swap[active[hit]]
        left.append(np.where(turned, other, one))
        right.append(np.where(turned, one, other) - len(a))
        start[hit] += 1
        low[active] = start
        at[active] += 1
        active = active[(at[active] < stop[active]) & (start < end)]
    i = np.concatenate([np.zeros(0, np.int64), *left])
    order = np.argsort(i, kind="stable")
    return i[order], np.concatenate([np.zeros(0, np.int64), *right])[order]


class Pieces:
    """The alignment of pieces of text: numbers of each, and runs of spelt ids and of pairs.

    `words` has a number for every id with the mark behind it, in the order in which the
    groups are spelt, `pairs` the id pairs that are linked and `times` how often. Both
    lie end to end, with the bounds of each piece.
    """

    def __init__(self, facts: np.ndarray, words: np.ndarray, word_bounds: np.ndarray, pairs: np.ndarray, times: np.ndarray, pair_bounds: np.ndarray):
        self.facts, self.words, self.word_bounds = facts, words, word_bounds
        self.pairs, self.times, self.pair_bounds = pairs, times, pair_bounds


COMMA, BAR, SEMICOLON = range(3)
MARKS = (",", "|", ";")


def align(a: np.ndarray, a_ends: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_ends: np.ndarray, b_starts: np.ndarray, size_a: int) -> Pieces:
    """Group the ids of every piece by common ends (which the last tokens always have).

    Within a group every token of one side overlaps the rank range of the other, so the
    links of two ids are the product of their numbers; those of large groups are counted
    by id and not listed one by one.
    """
    i, j = common_ends_of_all(a_ends, a_starts, b_ends, b_starts)
    first_a, first_b = (np.concatenate(([0], x[:-1] + 1)) if len(x) else x for x in (i, j))
    n, m = i - first_a + 1, j - first_b + 1
    piece = np.searchsorted(a_starts, i, side="right") - 1
    count = len(a_starts) - 1
    facts = np.zeros((4, count), dtype=np.int64)
    facts[0], facts[1] = np.diff(a_starts), np.diff(b_starts)
    facts[2] = np.bincount(piece, minlength=count)
    np.add.at(facts[3], piece, n * m)
    # Spelling: the group's ids of the one side, then of the other.
    shift = np.cumsum(n + m) - (n + m)
    words = np.empty(len(a) + len(b), dtype=np.int64)
    place_a, place_b = ragged(shift, n), ragged(shift + n, m)
    words[place_a], words[place_b] = 3 * a + COMMA, 3 * (b + size_a) + COMMA
    words[shift + n - 1] += BAR - COMMA
    words[shift + n + m - 1] += SEMICOLON - COMMA
    bounds = np.concatenate(([0], np.cumsum(facts[0] + facts[1])))
    # Links: token by token in small groups, by different ids in large ones.
    small = n * m <= LONG
    of_a = np.repeat(ragged(first_a[small], n[small]), np.repeat(m[small], n[small]))
    of_b = ragged(np.repeat(first_b[small], n[small]), np.repeat(m[small], n[small]))
    owner = np.repeat(piece[small], n[small] * m[small])
    pairs, times = [a[of_a] << 32 | b[of_b]], [np.ones(len(of_a), dtype=np.int64)]
    owners = [owner]
    for g in np.flatnonzero(~small):
        x, n_x = np.unique(a[first_a[g] : i[g] + 1], return_counts=True)
        y, n_y = np.unique(b[first_b[g] : j[g] + 1], return_counts=True)
        pairs.append((x[:, None] << 32 | y).ravel())
        times.append((n_x[:, None] * n_y).ravel())
        owners.append(np.full(len(x) * len(y), piece[g]))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    pair_bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=count))))
    return Pieces(facts, words, bounds, np.concatenate(pairs)[order], np.concatenate(times)[order], pair_bounds)


@functools.lru_cache(maxsize=2)
def _byte_level(path: str) -> tuple[object, list[bytes]]:
    """A byte-level tokenizer that takes special strings as text, and its tokens' bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
    alphabet = set(ByteLevel.alphabet())
    value = {c: ord(c) for c in alphabet if ord(c) < 256}
    value |= zip(sorted(alphabet - set(value)), sorted(set(range(256)) - set(value.values())), strict=True)
    spelled = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    return tokenizer, [bytes(value[c] for c in s) if set(s) <= alphabet else s.encode() for s in spelled]


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[object, list[bytes], bool]:
    """A piece tokenizer, its pieces' bytes, and whether a blank only ever begins a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [bytes([int(s[1:-1], 16)]) if model.is_byte(i) else s.replace(BLANK, " ").encode() for i, s in enumerate(spelled)]
    return model, plain, not any(BLANK in s.lstrip(BLANK) for s in spelled)


class _Table:
    """The bytes of all tokens end to end, where each starts and how long it is."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.starts[ids], self.lengths[ids])]


class Aligner:
    """The alignment of pieces of text that begin with a blank, each different one once."""

    def __init__(self, byte_level_file: str, piece_file: str):
        self.a, a_bytes = _byte_level(byte_level_file)
        self.b, b_bytes, self.cuts = _pieces(piece_file)
        self.sides = _Table(a_bytes), _Table(b_bytes)
        self.spelling = pa.array([f"{i}{mark}" for n in (len(a_bytes), len(b_bytes)) for i in range(n) for mark in MARKS])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.facts = [Growing(np.int64) for _ in range(5)]  # four of Pieces, and whether both sides spell the piece
        self.words, self.word_bounds = Growing(np.int64), Growing(np.int64)
        self.pairs, self.times, self.pair_bounds = Growing(np.int64), Growing(np.int64), Growing(np.int64)
        for bounds in (self.word_bounds, self.pair_bounds):
            bounds.add(np.zeros(1, dtype=np.int64))

    def _learn(self, texts: list[str]) -> None:
        """Encode and align new pieces, all at once."""
        plain = [f" {t}" for t in texts]
        encoded = self.a.encode_batch_fast(plain, add_special_tokens=False), self.b.encode(texts, num_threads=1)
        ids = [[e.ids for e in encoded[0]], encoded[1]]
        data = [p.encode() for p in plain]
        lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        spelt = np.ones(len(texts), dtype=bool)
        sides = []
        for of, table in zip(ids, self.sides, strict=True):
            sizes = np.fromiter(map(len, of), dtype=np.int64, count=len(of))
            flat = np.fromiter((i for x in of for i in x), dtype=np.int64, count=int(sizes.sum()))
            owner = np.repeat(np.arange(len(of)), sizes)
            wide = np.bincount(owner, weights=table.lengths[flat], minlength=len(of)).astype(np.int64)
            spelt &= wide == lengths
            sides.append((flat, sizes, owner))
        # Token by token the bytes have to be those of the text, where their number is.
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        whole = spelt.copy()
        kept = np.flatnonzero(whole)
        expected = raw[ragged(starts[kept], lengths[kept])]
        piece = np.repeat(kept, lengths[kept])
        for (flat, _, owner), table in zip(sides, self.sides, strict=True):
            spelt[piece[table.spelt(flat[whole[owner]]) != expected]] = False
        runs = []
        for (flat, sizes, owner), table in zip(sides, self.sides, strict=True):
            flat, sizes = flat[spelt[owner]], np.where(spelt, sizes, 0)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            runs += [flat, np.cumsum(table.lengths[flat]), bounds]
        made = align(*runs, len(self.sides[0].lengths))
        for growing, values in zip(self.facts, [*made.facts, spelt.astype(np.int64)], strict=True):
            growing.add(values)
        self.word_bounds.add(made.word_bounds[1:] + self.words.size)
        self.pair_bounds.add(made.pair_bounds[1:] + self.pairs.size)
        self.words.add(made.words)
        self.pairs.add(made.pairs)
        self.times.add(made.times)
        first = len(self.known)
        self.known.update(zip(texts, range(first, first + len(texts)), strict=True))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The numbers of the pieces; they hold until the next call."""
        if len(self.known) > CACHED_PIECES or self.words.size > CACHED_WORDS:
            self._forget()
        self._learn(list(dict.fromkeys(t for t in texts if t not in self.known)))
        return np.fromiter(map(self.known.__getitem__, texts), dtype=np.int64, count=len(texts))

    def units(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different pieces, the pieces of the texts by their places in them, and the bounds of each text.

        A text is cut before every blank between two things that are not: the split
        pattern of the one side has a boundary there, and no piece of the other goes on
        after it. A text with any other blank is one piece.
        """
        parts = pc.split_pattern(texts, pattern=" ")
        bounds = np.asarray(parts.offsets, dtype=np.int64)
        values = parts.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        encoded = values.dictionary_encode()
        codes, distinct = np.asarray(encoded.indices).astype(np.int64), encoded.dictionary.to_pylist()
        held = np.array([bool(p) for p in distinct], dtype=bool)
        opens = np.array([bool(p) and not (p[0].isspace() or p[0] in UNSURE) for p in distinct], dtype=bool)
        first = np.zeros(len(codes), dtype=bool)
        first[bounds[:-1]] = True
        before = np.concatenate(([False], held[codes[:-1]]))
        unsafe = ~first & ~(opens[codes] & before)
        whole = np.add.reduceat(unsafe, bounds[:-1]) > 0 if self.cuts else np.ones(len(texts), dtype=bool)
        many = np.where(whole, 1, np.diff(bounds))
        taken = codes[ragged(bounds[:-1], many)]
        ends = np.concatenate(([0], np.cumsum(many)))
        for row in np.flatnonzero(whole):
            taken[ends[row]] = len(distinct)
            distinct.append(texts[int(row)].as_py())
        used, taken = np.unique(taken, return_inverse=True)
        return [distinct[i] for i in used], taken, ends


# Not white space to every library, or not in every version: not taken as the start of a piece.
UNSURE = "᠎​﻿"


@functools.lru_cache(maxsize=2)
def aligner(byte_level_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_level_file, piece_file)


def _digests(made: Aligner, taken: np.ndarray, bounds: np.ndarray, spelled: np.ndarray) -> list[str]:
    """The digest of every text's groups; its pieces' spellings follow each other."""
    found, at = [], 0
    begins, sizes = made.word_bounds.held[taken], np.diff(made.word_bounds.held[: made.word_bounds.size])[taken]
    ends = np.cumsum(sizes)
    while at < len(spelled):  # some texts at a time
        before = ends[bounds[at] - 1] if bounds[at] else 0
        stop = max(at + 1, int(np.searchsorted(ends[bounds[1:] - 1], before + WORDS_AT_ONCE, side="right")))
        part = slice(bounds[at], bounds[stop])
        words = made.spelling.take(pa.array(made.words.held[ragged(begins[part], sizes[part])]))
        offsets, data = np.frombuffer(words.buffers()[1], dtype=np.int32), memoryview(words.buffers()[2] or b"")
        cuts = offsets[np.concatenate(([before], ends[bounds[at + 1 : stop + 1] - 1])) - before]
        for good, x, y in zip(spelled[at:stop].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            found.append(hashlib.sha256(data[x : y - 1]).hexdigest() if good else "")  # without the last semicolon
        at = stop
    return found


FACTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(docs: DataFrame, byte_level_file: str, piece_file: str) -> DataFrame:
    """One row a block of texts: their facts, the block's different id pairs, and which text has which how often.

    `pairs` are the different pairs, `held` says in how many texts of the block each is;
    `at` (its place in `pairs`) and `times` list the pairs of every text, `n_pairs` how
    many it has.
    """
    longs, kind = ArrayType(LongType()), docs.schema["id"].dataType
    schema = StructType(
        [
            StructField("block", LongType()),
            StructField("id", ArrayType(kind)),
            *[StructField(f, longs) for f in FACTS],
            StructField("groups_sha256", ArrayType(StringType())),
            StructField("n_pairs", longs),
            StructField("at", BinaryType()),
            StructField("times", BinaryType()),
            StructField("pairs", longs),
            StructField("held", longs),
        ]
    )

    def block(ids: pa.Array, texts: pa.Array, number: int) -> pa.RecordBatch:
        made = aligner(byte_level_file, piece_file)
        rows = len(texts)
        units, taken, bounds = made.units(texts)
        taken = made(units)[taken]
        spelled = np.add.reduceat(1 - made.facts[4].held[taken], bounds[:-1]) == 0
        spelled &= byte_lengths(texts) > 0
        facts = [np.where(spelled, np.add.reduceat(f.held[taken], bounds[:-1]), 0) for f in made.facts[:4]]
        digests = _digests(made, taken, bounds, spelled)
        # The pairs of every text, each once, with the sum of its links.
        begins, sizes = made.pair_bounds.held[taken], np.diff(made.pair_bounds.held[: made.pair_bounds.size])[taken]
        sizes = sizes * np.repeat(spelled, np.diff(bounds))
        places = ragged(begins, sizes)
        row = np.repeat(np.repeat(np.arange(rows), np.diff(bounds)), sizes)
        pairs, code = np.unique(made.pairs.held[places], return_inverse=True)
        keys, inverse = np.unique(row * max(1, len(pairs)) + code, return_inverse=True)
        summed = np.zeros(len(keys), dtype=np.int64)
        np.add.at(summed, inverse, made.times.held[places])
        at = keys % max(1, len(pairs))
        held = np.bincount(at, minlength=len(pairs))
        n_pairs = np.bincount(keys // max(1, len(pairs)), minlength=rows)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        longs = lambda values: one(pa.array(np.asarray(values, dtype=np.int64)))
        columns = [
            pa.array([number]),
            one(ids),
            *map(longs, facts),
            one(pa.array(digests, pa.string())),
            longs(n_pairs),
            pa.array([at.astype("<u4").tobytes()], pa.binary()),
            pa.array([summed.astype("<u8").tobytes()], pa.binary()),
            longs(pairs),
            longs(held),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = strings(batch.column("text"))
            for start, stop in slices(texts, BLOCK_BYTES):
                yield block(batch.column("id").slice(start, stop - start), texts.slice(start, stop - start), number)
                number += 1

    return map_batches(docs, make, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """How many texts of all hold a pair linked: `pair`, `count`, and `best`, the highest count of its first id."""
    held = blocks.select(F.inline(F.arrays_zip("pairs", "held")).alias("pair", "held"))
    counts = written(held.groupBy("pair").agg(F.sum("held").alias("count")).where("count > 0"), "pair_counts")
    first = F.shiftright("pair", 32)
    best = counts.groupBy(first.alias("a")).agg(F.max("count").alias("best"))
    return counts.join(best, first == F.col("a")).select("pair", "count", "best")


def align_tokenizers(
    docs: DataFrame, byte_level_file: str, piece_file: str, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every row's id, its numbers of tokens, groups and links, and how common its links are.

    The byte-level tokenizer reads the text behind a blank, the piece tokenizer adds that
    blank itself; special strings are text. `groups_sha256` is the digest of the groups
    as `a1,a2|b1;a3|b2,b3`. `n_best` counts the links whose pair is in as many texts as
    any pair of its first id, `count_sum` adds up the links' counts.

    A text that is null, empty, or not spelled byte by byte by both has no tokens: zeros
    and an empty digest. Null and repeated ids are rows like any other and count as
    texts each; an empty table gives none; other columns are not read.

    A block of texts sends each of its different pairs once, however common the pair is,
    and gets its count back; nothing grows with a frequent pair but the number of blocks.
    """
    source = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    blocks = written(_blocks(source, byte_level_file, piece_file), "aligned")
    sent = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    counts = sent.join(pair_counts(blocks), "pair").select("of", "at", "count", "best")
    fields = [StructField(id_column, docs.schema[id_column].dataType), *[StructField(f, LongType()) for f in FACTS]]
    sums = [StructField(f, LongType()) for f in ("n_best", "count_sum")]
    schema = StructType([*fields, *sums, StructField("groups_sha256", StringType())])

    def add(rows: pa.Table, counts: pa.Table) -> pa.Table:
        made = []
        for row in rows.to_batches():
            for i in range(row.num_rows):
                values = lambda c, i=i, row=row: row.column(c)[i].values
                at, times = (np.frombuffer(row.column(c)[i].as_buffer(), t).astype(np.int64) for c, t in (("at", "<u4"), ("times", "<u8")))
                place = np.asarray(counts.column("at").combine_chunks(), dtype=np.int64)
                n, top = np.zeros((2, len(values("pairs"))), dtype=np.int64)
                n[place] = np.asarray(counts.column("count").combine_chunks())
                top[place] = np.asarray(counts.column("best").combine_chunks())
                ends = np.concatenate(([0], np.cumsum(np.asarray(values("n_pairs")))))
                total = lambda x, ends=ends: pa.array(np.diff(np.concatenate(([0], np.cumsum(x)))[ends]))
                best, summed = total(times * (n[at] == top[at])), total(times * n[at])
                columns = [values("id"), *map(values, FACTS), best, summed, values("groups_sha256")]
                made.append(pa.Table.from_arrays(columns, names=schema.names))
        return pa.concat_tables(made)

    ship(docs.sparkSession)
    return blocks.drop("held").groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(add, schema)
