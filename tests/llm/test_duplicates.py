"""Substring dedup and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from llm.conftest import order
from pyspark.sql import functions as F

from examlens.llm import simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(rows, length=50):
    first, split = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in split:
        for p in range(len(words) - length + 1) if i is not None else ():
            key = tuple(words[p : p + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - length + 1):
            at = first.get(tuple(words[p : p + length]))
            if at is not None and (i is None or at < i):
                gone.update(range(p, p + length))
        kept = " ".join(w for q, w in enumerate(words) if q not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    shared = [[rnd.choice(vocabulary) for _ in range(150)] for _ in range(4)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 5)):
            source, at = rnd.choice(shared), rnd.randint(0, 100)
            words += source[at : at + rnd.randint(20, 90)] + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 5))]
        rows.append((rnd.choice([i, i, i, None, i // 2]), " ".join(words)))
    rows += [(7, None), (200, ""), (201, "la " * 500), (202, "la " * 300), (204, "x " * 50), (205, "x " * 51)]
    return rows + rows[:6]


def test_the_cover_has_every_difference():
    period = substring.PERIOD
    assert {(a - b) % period for a in substring.COVER for b in substring.COVER} == set(range(period))


def test_repeats_in_mixed_rows(spark):
    rows = passages()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    frame = frame.withColumn("id", F.lit(1)).withColumn("tag", F.lit("x"))
    found = substring.substring_dedup(frame)
    assert order(map(tuple, found.collect())) == order(plain_repeats(rows))
    assert substring.substring_dedup(frame.limit(0)).collect() == []
    left = substring.without_repeats(frame)
    assert left.columns == frame.columns
    whole = sum(1 for _, n, gone, _ in plain_repeats(rows) if gone == n and n)
    assert left.count() == len(rows) - whole


def test_repeats_in_documents(docs, texts):
    found = substring.substring_dedup(docs).collect()
    assert order(map(tuple, found)) == order(plain_repeats(texts))


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(ids, prints, max_bits):
    """The smallest id per component, every pair compared."""
    different, place = np.unique(np.array(prints, dtype=np.uint64), return_inverse=True)
    label = np.arange(len(different))
    near = [np.flatnonzero(np.bitwise_count(different ^ p) <= max_bits) for p in different]
    while True:
        before = label.copy()
        for i, others in enumerate(near):
            label[others] = np.minimum(label[others], label[i])
            label[i] = label[others].min()
        if (before == label).all():
            break
    low = {}
    for i, p in zip(ids, place, strict=True):
        low[label[p]] = min(low.get(label[p], i), i)
    return [low[label[p]] for p in place]


def test_simhash_of_documents(docs, texts):
    found = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    ids = [i for i, _ in texts]
    for i, text in texts[::10]:
        assert found[i][0] == plain_fingerprint(text)
    assert [found[i][1] for i in ids] == plain_classes(ids, [found[i][0] for i in ids], 4)


@pytest.mark.parametrize("max_bits, block", [(4, 4096), (4, 50), (3, 100), (1, 20), (0, 10)])
def test_no_link_is_missed(spark, max_bits, block, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    prints = []
    for _ in range(1000):
        value = int(centres[rng.integers(5)])
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            value ^= 1 << int(bit)
        prints.append(value)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    monkeypatch.setattr(simhash.links, "__defaults__", (max_bits, block))
    found = simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long"), "doc_id", max_bits)
    by_print = {r["fp"]: r["component_id"] for r in found.collect()}
    assert [by_print[p] for _, p in rows] == plain_classes(range(1000), prints, max_bits)


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d E f"), (5, None), (6, ""), (9, "q r s t u")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    left = simhash.one_per_group(frame)
    assert left.columns == frame.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 5, 9]
    assert simhash.one_per_group(frame.limit(0)).collect() == []
    assert simhash.simhash_groups(frame.limit(0)).collect() == []


def test_equal_rows_do_not_add_up_their_places(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w)) for i, w in ((1, words), (2, words[:90] + ["x"]), (None, ["y"] + words[20:])) for _ in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = []
    for name in ("_windows", "_cut"):
        def seen(given, length, run=getattr(substring, name)):
            sizes.append(given.agg(F.max(F.size("places"))).first()[0])
            return run(given, length)
        monkeypatch.setattr(substring, name, seen)
    found = substring.substring_dedup(frame).collect()
    assert order(map(tuple, found)) == order(plain_repeats(rows))
    assert len(sizes) == 2 and 0 < max(sizes) <= len(words)
