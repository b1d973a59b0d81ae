"""Whitening and near-duplicate vectors against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from examlens.llm import pq, queries, whitening

NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return frame.withColumn("id", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def vectors(n, dim, seed=0):
    rnd = np.random.default_rng(seed)
    spread = rnd.standard_normal((dim, dim)) * np.linspace(1, 3, dim)
    return np.round(rnd.standard_normal((n, dim)) @ spread, 3).astype(np.float32).tolist()


def check_whitening(found, rows, wanted=16):
    """Against the eigenvectors of the whole covariance, signs aside."""
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    d = once - sums / n
    v = d.T @ d / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(wanted, int((e > 1e-12 * np.trace(v)).sum()))
    by = {}
    for r in found:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    ids = [i for i, _ in rows]
    for c, got in by.items():
        assert sorted((r["vec_id"] is None, r["vec_id"]) for r in got) == sorted((i is None, i) for i in ids)
        plain = (x - sums / n) @ q[:, c - 1] / np.sqrt(e[c - 1])
        wanted_rows = {}
        for i, w, row in zip(ids, plain, x, strict=True):
            deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
            wanted_rows.setdefault(i, []).append((deviation if deviation < 1 << 63 else None, w))
        signs = []
        for r in got:
            options = [w for dev, w in wanted_rows[r["vec_id"]] if dev == r["deviation"]]
            assert options and r["n"] == n
            signs.append(min((abs(abs(w) - abs(r["whitened"])), np.sign(w * r["whitened"])) for w in options))
        assert max(s[0] for s in signs) < 1e-6
        assert len({s[1] for s in signs if s[1]}) <= 1 or len(set(ids)) < len(ids)
        assert all(abs(r["explained"] / (e[c - 1] / np.trace(v)) - 1) < 1e-9 for r in got)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_whitening_of_embeddings(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(queries.op11_whitening(spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("dim, wanted", [(24, 16), (5, 16), (1, 3)])
def test_whitening_edges(spark, dim, wanted):
    good = list(enumerate(vectors(200, dim)))
    good += [(None, good[3][1]), (7, good[5][1]), (500, good[5][1])]
    bad = [(900, None), (901, [None] * dim), (902, [NAN] * dim), (903, [INF] * dim), (904, []), (905, [1.0] * (dim + 1))]
    found = whitening.whiten(table(spark, good + bad), wanted=wanted)
    check_whitening(found.collect(), good, wanted)


def test_whitening_of_low_rank_and_nothing(spark):
    flat = vectors(50, 2)
    rows = [(i, [a, b, a, 0.0]) for i, (a, b) in enumerate(flat)]
    check_whitening(whitening.whiten(table(spark, rows, "double")).collect(), rows)
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, rows[:1])).collect() == []
    assert whitening.whiten(table(spark, rows).limit(0)).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    huge = [(i, [a * 1e9, b]) for i, (a, b) in enumerate(flat)]
    check_whitening(whitening.whiten(table(spark, huge, "double")).collect(), huge)


@pytest.mark.parametrize(
    "spectrum",
    [[5] * 4 + [3] * 12 + [1] * 4, [5, 4, 3] + [0] * 17, [1e8] + [1] * 19, range(20), [7] * 20, [2 + 1e-13 * i for i in range(20)]],
)
def test_feast_misses_no_component(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((20, 20)))
    v = (q * np.array(spectrum, float)) @ q.T
    v = (v + v.T) / 2
    e = np.linalg.eigvalsh(v)[::-1]
    cuts = whitening.intervals(v, 16, 8)
    assert sum(c for *_, c in cuts) >= min(16, int((e > 1e-9 * e[0]).sum()))
    got = [whitening.feast(v, *cut) for cut in cuts]
    values, basis = np.concatenate([g[0] for g in got]), np.hstack([g[1] for g in got])
    assert np.abs(values - e[: len(values)]).max() <= 1e-13 * e[0]
    assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-10
    with pytest.raises(ArithmeticError):
        whitening.feast(v, cuts[0][0], cuts[0][1], cuts[0][2] + 1)


def plain_links(rows, cosine=0.9):
    """Links and components over all pairs."""
    lengths = [len(v) for _, v in usable(rows) if any(v)]
    dim = max(set(lengths), key=lambda s: (lengths.count(s), s), default=0)
    good = [k for k, (_, v) in enumerate(rows) if usable([(0, v)]) and any(v) and len(v) == dim]
    x = np.array([rows[k][1] for k in good], dtype=np.float64).reshape(len(good), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0) if len(good) else x
    x = x / np.linalg.norm(x, axis=1)[:, None] if len(good) else x
    near = x @ x.T >= cosine if len(good) else np.zeros((0, 0), bool)
    np.fill_diagonal(near, False)
    up = list(range(len(good)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in np.argwhere(near):
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    low = {}
    for k, place in enumerate(good):
        i = rows[place][0]
        old = low.get(root(k))
        low[root(k)] = i if old is None else old if i is None else min(i, old)
    out = []
    where = {place: k for k, place in enumerate(good)}
    for place, (i, _) in enumerate(rows):
        k = where.get(place)
        n, component = (int(near[k].sum()), low[root(k)]) if k is not None else (0, i)
        out.append((i, n, component, i == component))
    return out, near


def copies(n, dim, seed=3, cosines=(0.905, 0.93, 0.97, 0.999)):
    """Vectors of which some are near copies of others, at given cosines."""
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(0, n // 2):
        other = rnd.standard_normal(dim)
        other -= other @ x[k] * x[k]
        c = cosines[k % len(cosines)]
        x[n // 2 + k] = c * x[k] + np.sqrt(1 - c * c) * other / np.linalg.norm(other)
    return (x * rnd.uniform(0.1, 10, (n, 1))).tolist()


def test_links_of_mixed_rows(spark):
    rows = [(i if i % 9 else None, v) for i, v in enumerate(copies(300, 16))]
    rows += [(i // 2, rows[5][1]) for i in range(800, 840)] + [(850, [2 * c for c in rows[5][1]])]
    rows += [(900, None), (901, [0.0] * 16), (902, [NAN] * 16), (903, [None] * 16), (904, [1.0] * 3), (905, [-INF] * 16), (906, [])]
    rows += [(907, [1e-300] * 16), (908, [1e300] * 16), (901, [0.0] * 16)]
    wide = pq.Index(sigmas=100, list_size=20, block=16)  # every list: nothing is missed
    found = pq.near_duplicates(table(spark, rows, "double"), how=wide).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(plain_links(rows)[0], key=key)


def test_no_vectors(spark):
    assert pq.near_duplicates(table(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert [tuple(r) for r in pq.near_duplicates(table(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
    same = pq.near_duplicates(table(spark, [(3, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted(map(tuple, same)) == [(2, 1, 2, True), (3, 1, 2, False)]


@pytest.mark.parametrize("how", [pq.Index(), pq.Index(list_size=40, centroids=8, block=50)])
def test_recall_of_near_copies(spark, how):
    """With production margins, in one and in two levels of lists: none too many, at least nine in ten found."""
    rows = list(enumerate(copies(2000, 64)))
    found = {r["vec_id"]: r for r in pq.near_duplicates(table(spark, rows), how=how).collect()}
    single = [(i, np.float32(v).tolist()) for i, v in rows]
    plain, near = plain_links(single)
    got = sum(found[i]["n_links"] for i, *_ in plain)
    assert all(found[i]["n_links"] <= n for i, n, *_ in plain)
    assert got >= 0.95 * near.sum() > 0


def test_embeddings_with_copies(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op13_embedding_dedup(spark, sf_dir).collect())) == sorted(plain_links(rows)[0])
    rnd = np.random.default_rng(0)
    more = [(10_000 + i, (np.array(rows[7][1]) + rnd.normal(0, 0.02, 64)).tolist()) for i in range(300)] + [(20_000 + i, rows[9][1]) for i in range(200)]
    found = pq.near_duplicates(table(spark, rows + more)).collect()
    single = [(i, np.float32(v).tolist()) for i, v in rows + more]
    assert sorted(map(tuple, found)) == sorted(plain_links(single)[0])
