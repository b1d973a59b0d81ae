"""Near-duplicate vectors through inverted lists with product-quantised residuals.

A coarse quantiser of two levels deals the different vectors to lists. What is left of a
vector in its list is coded by the nearest of 256 codewords in each of some subspaces. A
vector searches all lists that a near one can be expected in: distances to the codes are
sums of table entries, those within the code's own error are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, DoubleType, FloatType, LongType, StructField, StructType,
)

from .common import map_batches, written
from .graph import components
from .vectors import finite, parts, usual_length

COSINE = 0.9
# The most pairs that a task compares at a time.
PAIRS = 1 << 19


@dataclass(frozen=True)
class Index:
    """How the vectors are indexed.

    The quantisers are fitted on `sample` vectors at most, and on `numbers` components:
    those with the smallest hashes. Lists get about `list_size` vectors, by up to
    `centroids` centroids in each of two levels. `sigmas` widens the search: a list is
    probed if the border to it is nearer than so many standard deviations of a vector's
    step across it, when the two are just as near as is asked for and differ in no
    special direction. Longer lists are searched in blocks of `block` vectors.
    """

    sample: int = 16384
    numbers: int = 1 << 21
    list_size: int = 256
    centroids: int = 1024
    subspaces: int = 8
    codewords: int = 256
    sigmas: float = 2.0
    block: int = 1024
    rounds: int = 8


def kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Up to `k` centroids; the start is the first different rows."""
    first = np.sort(np.unique(x, axis=0, return_index=True)[1])[:k]
    centroids = x[first].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_scores(part, centroids).argmax(axis=1) for part in np.array_split(x, len(x) // 4096 + 1)])
        sums, n = np.zeros_like(centroids), np.bincount(nearest, minlength=len(centroids))
        np.add.at(sums, nearest, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _scores(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The larger, the nearer: half the squared length less half the squared distance."""
    return x @ centroids.T - (centroids * centroids).sum(axis=1) / 2


@dataclass(frozen=True)
class Quantiser:
    coarse: np.ndarray
    fine: np.ndarray
    words: list[np.ndarray]  # the codewords of every subspace
    margin: float

    def _near(self, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid, and all whose border to the nearest is within the margin."""
        scores = _scores(x, centroids)
        best = scores.argmax(axis=1)
        apart = self._apart(centroids)[best]
        border = (scores[np.arange(len(x)), best][:, None] - scores) / apart
        return best, border <= self.margin

    @staticmethod
    def _apart(centroids: np.ndarray) -> np.ndarray:
        squares = (centroids * centroids).sum(axis=1)
        return np.sqrt(np.maximum(squares[:, None] + squares - 2 * centroids @ centroids.T, 1e-300))

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of every vector, and the lists to probe for it, its own among them."""
        own, near = self._near(x, self.coarse)
        rows, first = np.nonzero(near)
        second = np.empty(len(rows), dtype=np.int64)
        found_rows, found = [], []
        for at in range(0, len(rows), 4096):
            part = slice(at, at + 4096)
            best, close = self._near(x[rows[part]] - self.coarse[first[part]], self.fine)
            second[part] = best
            i, j = np.nonzero(close)
            found_rows.append(rows[part][i])
            found.append(first[part][i] * len(self.fine) + j)
        of = np.concatenate(found_rows)
        home = first == own[rows]
        mine = np.empty(len(x), dtype=np.int64)
        mine[rows[home]] = own[rows[home]] * len(self.fine) + second[home]
        bounds = np.searchsorted(of, np.arange(1, len(x)))
        return mine, np.split(np.concatenate(found), bounds)

    def centres(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of what the lists' centres leave of the vectors, and the error of each code."""
        rest, at = x - self.centres(lists), 0
        codes, error = np.empty((len(x), len(self.words)), dtype=np.uint8), np.zeros(len(x))
        for m, words in enumerate(self.words):
            part = rest[:, at : at + words.shape[1]]
            codes[:, m] = _scores(part, words).argmax(axis=1)
            error += ((part - words[codes[:, m]]) ** 2).sum(axis=1)
            at += words.shape[1]
        return codes, np.sqrt(error)

    def distances(self, x: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Distances of whole vectors to coded ones of a list, by table lookup: a row a vector."""
        rest, at = x - self.centres(np.array([list_])), 0
        found = np.zeros((len(x), len(codes)))
        for m, words in enumerate(self.words):
            part = rest[:, at : at + words.shape[1]]
            table = (part * part).sum(axis=1)[:, None] - 2 * _scores(part, words)
            found += table[:, codes[:, m]]
            at += words.shape[1]
        return np.sqrt(np.maximum(found, 0))


def train(sample: np.ndarray, n: int, cosine: float, how: Index) -> Quantiser:
    """Quantisers for `n` vectors, from some of them: unit vectors, a row each."""
    dim, lists = sample.shape[1], max(1, -(-n // how.list_size))
    first = min(lists, how.centroids, max(1, len(sample) // 8))
    second = min(-(-lists // first), how.centroids, max(1, len(sample) // 8))
    coarse = kmeans(sample, first, how.rounds)
    rest = sample - coarse[_scores(sample, coarse).argmax(axis=1)]
    fine = kmeans(rest, second, how.rounds) if second > 1 else np.zeros((1, dim))
    rest = rest - fine[_scores(rest, fine).argmax(axis=1)]
    edges = [dim * m // min(how.subspaces, dim) for m in range(min(how.subspaces, dim) + 1)]
    words = [kmeans(rest[:, a:b], how.codewords, how.rounds) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    step = np.sqrt(max(0.0, 2 - 2 * cosine))
    return Quantiser(coarse, fine, words, how.sigmas * step / np.sqrt(dim))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1)[:, None]


def _stored(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    data = b"".join(x.as_buffer() for x in column)
    return np.frombuffer(data, dtype=kind).reshape(-1, dim).astype(np.float64)


def _packed(rows: DataFrame, kind: str, dim: int) -> DataFrame:
    """`id` and `x`, the components as stored, little-endian."""
    schema = StructType([rows.schema["id"], StructField("x", BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, dim):
            flat = np.asarray(batch.column("vector").flatten().cast(pa.float64())) + 0.0  # no negative zero
            data = pa.py_buffer(flat.astype(kind).tobytes())
            width = dim * np.dtype(kind).itemsize
            offsets = pa.py_buffer((np.arange(batch.num_rows + 1) * width).astype(np.int32))
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, data])
            yield pa.RecordBatch.from_arrays([batch.column("id"), column], names=schema.names)

    return map_batches(rows, pack, schema)


def _assigned(nodes: DataFrame, made: Quantiser, kind: str, dim: int) -> DataFrame:
    """Every node's `list`, the lists that it probes, its code and the code's error."""
    extra = [
        StructField("list", LongType()),
        StructField("probes", ArrayType(LongType())),
        StructField("code", BinaryType()),
        StructField("error", DoubleType()),
    ]
    schema = StructType([*nodes.schema.fields, *extra])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, max(dim, len(made.coarse), len(made.fine))):
            if not batch.num_rows:
                continue
            x = _unit(_stored(batch.column("x"), kind, dim))
            own, probes = made.lists(x)
            codes, error = made.codes(x, own)
            ends = np.concatenate(([0], np.cumsum([len(p) for p in probes]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(probes)))
            columns = [pa.array(own), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return map_batches(nodes, assign, schema)


class _Forest:
    """Which members of a block are known to be connected."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class _Block:
    """The members of one block of a list, and what links to them."""

    def __init__(self, table: pa.Table, made: Quantiser, cosine: float, kind: str, dim: int):
        self.made, self.cosine, self.kind, self.dim = made, cosine, kind, dim
        self.list = table.column("list")[0].as_py()
        column = lambda c: table.column(c).combine_chunks()
        self.node, self.n, self.error = (np.asarray(column(c)) for c in ("node", "n", "error"))
        self.x = _unit(_stored(column("x"), kind, dim))
        self.codes = np.frombuffer(b"".join(c.as_buffer() for c in column("code")), np.uint8).reshape(len(self.node), -1)
        probes = column("probes")
        sizes = np.asarray(pc.list_value_length(probes))
        self.probes = np.full((len(self.node), int(sizes.max())), -1, dtype=np.int64)
        self.probes[np.arange(self.probes.shape[1]) < sizes[:, None]] = np.asarray(probes.flatten())
        self.links = np.zeros(len(self.node), dtype=np.int64)
        self.forest = _Forest(len(self.node))

    def search(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Probing nodes, how many rows each has linked here, and links that connect what is connected."""
        node, n, home = (np.asarray(batch.column(c)) for c in ("node", "n", "home"))
        x = _unit(_stored(batch.column("x"), self.kind, self.dim))
        reach = np.sqrt(2 - 2 * self.cosine) + self.error + 1e-9
        found, edges, size = np.zeros(len(node), dtype=np.int64), [], max(1, PAIRS // len(self.node))
        for at in range(0, len(node), size):
            part = slice(at, at + size)
            close = self.made.distances(x[part], self.list, self.codes) <= reach
            close &= node[part][:, None] != self.node
            i, j = np.nonzero(close)
            i += at
            # The codes leave few, or all of them near; either way some at a time.
            linked = np.concatenate(
                [np.einsum("ij,ij->i", x[a], self.x[b]) >= self.cosine for a, b in zip(*(np.array_split(y, len(y) // 65536 + 1) for y in (i, j)), strict=True)]
            )
            i, j = i[linked], j[linked]
            np.add.at(found, i, self.n[j])
            # A member that does not probe the list of the other would not count it.
            one_way = ~(self.probes[j] == home[i][:, None]).any(axis=1)
            np.add.at(self.links, j[one_way], n[i[one_way]])
            first = np.unique(i, return_index=True)[1]
            edges += zip(node[i[first]].tolist(), self.node[j[first]].tolist(), strict=True)
            lead = np.repeat(j[first], np.diff(np.append(first, len(i))))
            for a, b in np.unique(np.stack([lead, j], axis=1)[lead != j], axis=0).tolist():
                if self.forest.join(a, b):
                    edges.append((int(self.node[a]), int(self.node[b])))
        return node, found, edges


def _search(batches: Iterator[pa.RecordBatch], made: Quantiser, cosine: float, kind: str, dim: int) -> Iterator[pa.RecordBatch]:
    """Counts and links of rows sorted by list and block, members before probes."""
    key, held, block = None, [], None

    def out(node=(), links=(), edges=()) -> pa.RecordBatch:
        longs = lambda x: pa.array(np.asarray(x, dtype=np.int64))
        a, b = zip(*edges, strict=True) if edges else ((), ())
        none = lambda n: pa.nulls(n, pa.int64())
        columns = [
            pa.concat_arrays([longs(node), none(len(a))]),
            pa.concat_arrays([longs(links), none(len(a))]),
            pa.concat_arrays([none(len(node)), longs(a)]),
            pa.concat_arrays([none(len(node)), longs(b)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["node", "links", "a", "b"])

    def counted(node: np.ndarray, links: np.ndarray, edges=()) -> pa.RecordBatch:
        return out(node[links > 0], links[links > 0], edges)

    for batch in parts(batches, dim):
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)) for c in ("list", "block", "probe")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            run = batch.slice(start, stop - start)
            if (at := tuple(keys[:2, start])) != key:
                if block:
                    yield counted(block.node, block.links)
                key, held, block = at, [], None
            if keys[2, start] == 0:
                held.append(run)
                continue
            if block is None:
                if not held:
                    continue  # nothing in this list
                block, held = _Block(pa.Table.from_batches(held), made, cosine, kind, dim), []
            node, links, edges = block.search(run)
            yield counted(node, links, edges)
    if block:
        yield counted(block.node, block.links)


def links(nodes: DataFrame, dim: int, kind: str, cosine: float = COSINE, how: Index = Index()) -> DataFrame:
    """For nodes `node`, `n` (rows), `x` (components): rows of (`node`, `links`) and of (`a`, `b`).

    `links` adds up to the rows at other nodes with at least `cosine`, each pair counted
    at both ends if either one probes the other's list; `a`, `b` connect what these
    links connect and are fewer than the pairs. Long lists are cut into blocks by hash,
    each searched by itself. Every vector is in one list and is compared exactly with
    all that its probes cannot rule out; only links across lists that neither end
    probes are missed.
    """
    n = nodes.count()
    schema = StructType([StructField(c, LongType()) for c in ("node", "links", "a", "b")])
    if not n:
        return nodes.sparkSession.createDataFrame([], schema)
    size = max(1, min(how.sample, how.numbers // dim))
    picked = nodes.select("x").orderBy(F.xxhash64("x"), "x").limit(size).collect()
    made = train(_unit(np.stack([np.frombuffer(bytes(r["x"]), kind) for r in picked]).astype(np.float64)), n, cosine, how)
    dealt = written(_assigned(nodes, made, kind, dim), "vector_lists")
    # One row a list at most: bounded by the number of centroids.
    long = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / how.block).cast("long").alias("blocks")).where("blocks > 1")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    members = dealt.select(
        "list", F.lit(0).alias("probe"), "node", "n", "x", F.col("list").alias("home"), "probes", "code", "error"
    )
    probing = dealt.select(
        F.explode("probes").alias("to"), F.lit(1).alias("probe"), "node", "n", "x", F.col("list").alias("home"),
        none("array<bigint>", "probes"), none("binary", "code"), none("double", "error"),
    ).withColumnRenamed("to", "list")
    blocks = F.coalesce("blocks", F.lit(1))
    parted = members.join(F.broadcast(long), "list", "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    everywhere = probing.join(F.broadcast(long), "list", "left").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    )
    rows = parted.unionByName(everywhere).drop("blocks").repartition("list", "block")
    ordered = rows.sortWithinPartitions("list", "block", "probe")
    return map_batches(ordered, lambda batches: _search(batches, made, cosine, kind, dim), schema)


def near_duplicates(
    rows: DataFrame,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    cosine: float = COSINE,
    how: Index = Index(),
) -> DataFrame:
    """Every row's id, `n_links`, `component_id` and `kept`.

    Rows are linked if the cosine of their vectors, in double precision, is at least
    `cosine`. `n_links` counts the other rows linked to a row, `component_id` is the
    smallest id that links reach, `kept` says that it is the row's own. No pair below
    the threshold is linked; of those above, pairs whose vectors lie in lists that
    neither probes are missed (see `Index.sigmas`). Equal vectors are one node and are
    never missed, whatever their number.

    A vector that is null, zero, has null or non-finite components or another length
    than most have links with nothing. A null id is never the smallest unless the
    component has no other, and is kept only there; repeated ids and rows stay, each a
    row of its own; an empty table gives none; other columns are not read.
    """
    base = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    nonzero = F.exists("vector", lambda c: c != 0)
    good = finite(F.col("vector")) & F.coalesce(nonzero, F.lit(False))
    dim = usual_length(base.where(good), "vector")
    usable = good & (F.size("vector") == F.lit(dim))
    kind = "<f4" if isinstance(rows.schema[vector_column].dataType.elementType, FloatType) else "<f8"
    packed = _packed(base.where(usable), kind, dim)
    name = [F.xxhash64(F.lit(i), "x").alias(f"h{i}") for i in (1, 2)]  # 128 bits name a vector
    nodes = packed.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "n", "low", "x"), "vectors")
    found = written(links(nodes.select("node", "n", "x"), dim, kind, cosine, how), "vector_links")
    counts = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(found.where("a is not null").select("a", "b"))
    rooted = (
        nodes.select("node", "n", "low", *name)
        .join(counts, "node", "left")
        .join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lows, "root").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    linked = packed.select("id", *name).join(classes, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = base.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(
        F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
