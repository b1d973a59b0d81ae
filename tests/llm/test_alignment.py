"""Cross-tokenizer alignment against whole texts encoded by the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from llm.conftest import order
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from examlens.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PARTS = ["the", "ing", " ", "  ", "\n", "é", "<|endoftext|>", "'s", "12", "!!", "\t", " word", "　", "漢字", "🙂", "<s>", "x" * 20, " "]
EDGES = [None, "", " ", "  ", " a", "a ", "a  b", "\n x", "x \n y", "▁x", "a ▁b", "a\x00b", "᠎ x", " ​q", "a ﻿b", "ﬁ é é ①"]


def ends(parts):
    at, out = 0, []
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def plain(rows):
    """The contract on whole texts, link by link."""
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    facts, held = [], Counter()
    for doc, text in rows:
        a = left.encode(" " + (text or ""), add_special_tokens=False).ids
        b = right.encode(text or "")
        of_a = [bytes(to_byte[c] for c in left.id_to_token(i)) for i in a]
        of_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            facts.append((doc, [], [], [], []))
            continue
        a_ends, b_ends = ends(of_a), ends(of_b)
        cuts = sorted(set(a_ends) & set(b_ends))
        groups, links, p, q = [], [], 0, 0
        for cut in cuts:
            x, y = a[p : a_ends.index(cut, p) + 1], b[q : b_ends.index(cut, q) + 1]
            groups.append((x, y))
            links += [(i, j) for i in x for j in y]
            p, q = p + len(x), q + len(y)
        held.update(set(links))
        facts.append((doc, a, b, groups, links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc, a, b, groups, links in facts:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        n_best = sum(held[p] == best[p[0]] for p in links)
        out.append((doc, len(a), len(b), len(groups), len(links), n_best, sum(held[p] for p in links), digest))
    return out


def byte_letters():
    """The letter of every byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


def mixed(n, seed=1):
    rnd = random.Random(seed)
    return EDGES + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def table(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.withColumn("id", F.lit(2)).withColumn("block", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_common_ends_by_galloping(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        a, b = (sorted(rnd.sample(range(200), rnd.randint(0, 60))) for _ in range(2))
        assert alignment.common_ends(a, b) == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]


@pytest.mark.parametrize("long", [0, 10, 256])
def test_many_lists_gallop_in_step(monkeypatch, long):
    monkeypatch.setattr(alignment, "LONG", long)
    rnd = random.Random(long)
    lists = [tuple(sorted(rnd.sample(range(60), rnd.choice([0, 1, 2, 5, 30]))) for _ in range(2)) for _ in range(200)]
    a, b = (np.array([x for pair in lists for x in pair[side]], dtype=np.int64) for side in (0, 1))
    starts = [np.cumsum([0, *(len(pair[side]) for pair in lists)]) for side in (0, 1)]
    i, j = alignment.common_ends_of_all(a, starts[0], b, starts[1])
    plain = [(p + starts[0][k], q + starts[1][k]) for k, pair in enumerate(lists) for p, q in alignment.common_ends(*pair)]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == plain


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_mixed_texts(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "CACHED_PIECES", block)
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(mixed(250))]
    rows += [(5000 + i, " the word is the same") for i in range(40)] + rows[:9]
    rows.append((9000, "long " * 30000 + "x" * 5000 + "  end"))
    found = alignment.align_tokenizers(table(spark, rows), A, B)
    assert found.columns == [*COLUMNS[:5], "n_best", "count_sum", "groups_sha256"]
    assert order(map(tuple, found.select(COLUMNS).collect())) == order(plain(rows))


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_PIECES", 3)
    made = alignment.Aligner(A, B)
    for texts in (["a", "b"], ["b", "c", "d"], ["a", "d", "x" * 300], ["x" * 300, "a"]):
        fresh = alignment.Aligner(A, B)
        known, plain = made(texts), fresh(texts)
        assert [f.held[known].tolist() for f in made.facts] == [f.held[plain].tolist() for f in fresh.facts]


def test_no_texts(spark):
    assert alignment.align_tokenizers(table(spark, [(1, "a")]).limit(0), A, B).collect() == []
    found = alignment.align_tokenizers(table(spark, [(1, None), (1, ""), (2, "▁")]), A, B).collect()
    assert sorted(map(tuple, found)) == [(1, *[0] * 6, ""), (1, *[0] * 6, ""), (2, *[0] * 6, "")]


def test_documents(docs, texts):
    found = alignment.align_tokenizers(docs, A, B).select(COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(plain(texts))
