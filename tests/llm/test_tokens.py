"""Token counts, packing and byte-level BPE against the libraries on whole texts."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from llm.conftest import order
from pyspark.sql import functions as F

from examlens.llm import bpe, packing, token_counts, tokenizing

PARTS = ["a", "bc", "İ", "Σ", "É", " ", "  ", "\n", "é", "<|endoftext|>", "'s", "12", "!!", "\t", "word ", "\u3000", "x" * 30]
EDGES = [None, "", " ", "  ", " a", "a ", "a  b", "\n x", "it's we'll 'S", "é ü 漢字 12 345", "a\n b \n c", "\u180ex  y"]


def mixed(n, seed=1):
    rnd = random.Random(seed)
    return EDGES + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def table(spark, rows):
    """With extra columns whose names the operators use themselves."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.withColumn("ids", F.lit(1)).withColumn("part", F.lit("x")).withColumn("id", F.lit(2)).coalesce(1)


@pytest.mark.parametrize("chunk, overlap", [(40, 8), (64, 64), (100, 20)])
def test_chunks_splice_to_the_whole_encoding(chunk, overlap):
    tokenizer = tokenizing.load(P.path("byte_bpe_50k.json"))
    for text in mixed(150)[1:] + ["y" * 500, "word " * 200, " " * 300]:
        parts = token_counts.encode_in_chunks(tokenizer, text, chunk, overlap)
        assert [i for ids in parts for i in ids] == tokenizer.encode(text, add_special_tokens=False).ids


def test_counts_of_mixed_texts(spark):
    file = P.path("byte_bpe_50k.json")
    tokenizer = tokenizing.load(file)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(mixed(200))] * 2
    found = token_counts.token_counts(table(spark, rows), file, chunk=60, overlap=10).collect()
    plain = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert order(map(tuple, found)) == order(plain)
    assert token_counts.token_counts(table(spark, rows).limit(0), file).collect() == []


def test_counts_of_documents(docs, texts):
    file = P.path("byte_bpe_50k.json")
    encoded = tokenizing.load(file).encode_batch([t or "" for _, t in texts], add_special_tokens=False)
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, file, chunk=3000).collect()}
    assert found == {i: len(e.ids) for (i, _), e in zip(texts, encoded, strict=True)}


def check_pieces(pieces, rows, window=4096):
    tokenizer = tokenizing.load(P.path("word_bpe_49k.json"))
    left = {}
    filled = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        left.setdefault(p["doc_id"], []).append(p)
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in left.pop(doc):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert not left
    lengths = []
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        lengths.append(at)
    assert sorted(lengths)[1:] == [window] * (len(lengths) - 1) and max(lengths, default=0) <= window


LETTERS = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()] + list("İıſßŉǰΐςΣΩÅﬁΑ漢あ\u0345\u0307\u00b2\u2160")
MARKS = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]


def test_every_letter_before_every_mark():
    """Where words are cut and lower-cased, the library cuts and lower-cases too."""
    words = [f"{x}{y}{z}" for x in LETTERS for y in MARKS for z in ("", "b")]
    words += [f"{x}{y}" for x in LETTERS for y in LETTERS[::7]] + [f"a{x}'s{y} {y}{x}" for x in LETTERS[::3] for y in MARKS]
    words += ["<|endoftext|>", "A<|endoftext|>B", "<|STARTOFTEXT|>", "x<|", "A|>", "'Sword", "we'LL", "\u00c9\u0301!"]
    library = tokenizing.load(P.path("word_bpe_49k.json"))
    ids, bounds = tokenizing.WordIds(P.path("word_bpe_49k.json"))(pa.array(words))
    expected = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected
    library = tokenizing.load(P.path("byte_bpe_50k.json"))
    texts = [f"q {w} {w}" for w in words]
    counts = tokenizing.PieceCounts(P.path("byte_bpe_50k.json"))(pa.array(texts))
    assert counts.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_texts_go_whole_to_tokenizers_of_another_make(tmp_path):
    made = json.loads(tokenizing.load(P.path("byte_bpe_50k.json")).to_str())
    changes = [{}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": made["pre_tokenizer"] | {"add_prefix_space": True}}]
    changes.append({"added_tokens": made["added_tokens"] + [made["added_tokens"][0] | {"id": 50257, "content": "a b"}]})
    for n, change in enumerate(changes):
        (tmp_path / f"{n}.json").write_text(json.dumps(made | change))
        counter = tokenizing.PieceCounts(str(tmp_path / f"{n}.json"))
        assert counter.cuts == (not change)
        texts = [t or "" for t in mixed(80)] + ["A B a b  a b", "xa bx a b"]
        expected = [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counter(pa.array(texts)).tolist() == expected


@pytest.mark.parametrize("limit", [3, 10**6])
def test_words_are_forgotten_and_learnt_again(monkeypatch, limit):
    monkeypatch.setattr(tokenizing, "CACHED_WORDS", limit)
    made, library = tokenizing.WordIds(P.path("word_bpe_49k.json")), tokenizing.load(P.path("word_bpe_49k.json"))
    for seed in range(4):
        texts = [t or "" for t in mixed(60, seed)]
        ids, bounds = made(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [
            e.ids for e in library.encode_batch(texts, add_special_tokens=False)
        ]


def test_packing_documents(docs, texts):
    file = P.path("word_bpe_49k.json")
    check_pieces(packing.with_crc32(packing.pack(docs.repartition(5), file, end_id=2)).collect(), texts)


def test_packing_edges(spark):
    file = P.path("word_bpe_49k.json")
    rows = list(enumerate(mixed(100) + ["word " * 500]))
    pieces = packing.with_crc32(packing.pack(table(spark, rows), file, end_id=2, window=64))
    check_pieces(pieces.collect(), rows, 64)
    assert packing.pack(table(spark, rows).limit(0), file, end_id=2).collect() == []
    assert packing.pack(table(spark, [(None, "a b"), (1, "c"), (1, "c")]), file, end_id=2).count() == 3


def check_bpe(frame, rows):
    file = P.path("byte_bpe_multi_50k.tiktoken")
    encoding = bpe.load_encoding(file, P.PATTERN)
    decoded = bpe.decode(bpe.encode(frame, file, P.PATTERN), file)
    found = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["bytes"])) for r in decoded.collect()]
    plain = []
    for doc, text in rows:
        ids = encoding.encode_ordinary(text or "")
        plain.append((doc, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()))
    assert order(found) == order(plain)


def test_bpe_round_trip(spark, docs, texts, monkeypatch):
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(mixed(200))]
    check_bpe(table(spark, rows), rows)
    check_bpe(table(spark, rows).limit(0), [])
    check_bpe(docs, texts)
    # Several blocks a task, and rows assembled a few at a time.
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 300)
    monkeypatch.setattr(bpe, "CODES_AT_ONCE", 40)
    check_bpe(table(spark, rows), rows)
