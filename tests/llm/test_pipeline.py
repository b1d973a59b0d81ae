"""The registered queries against DuckDB, and the pipeline stage by stage against brute force."""

import os
import random

import public_tokenizers as P
import pytest
from compare import assert_same, connect
from llm.test_duplicates import plain_classes, plain_fingerprint, plain_repeats
from llm.test_tokens import check_bpe, check_pieces
from pyspark.sql import functions as F

import corpus_pipeline
from examlens.llm import oracles, packing, quality, queries, simhash, substring, token_counts, tokenizing
from examlens.llm.common import SLICE_BYTES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_as_duckdb(spark, sf_dir, duck, name):
    assert assert_same(queries.queries()[name](spark, sf_dir), duck.sql(oracles.oracle_sql()[name])) > 0


def test_pipeline(spark, sf_dir, docs):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, rows, sf_dir)
        assert left.columns == docs.columns
        before = {r["doc_id"]: r["text"] for r in rows.collect()}
        after = {r["doc_id"]: r["text"] for r in left.collect()}
        if name == "quality":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            judged = quality.quality_rules(rows, labels, risk=quality.JOINT).where("kept").collect()
            assert set(after) == {r["doc_id"] for r in judged}
        elif name == "near_duplicates":
            ids = sorted(before)
            low = plain_classes(ids, [plain_fingerprint(before[i]) for i in ids], 4)
            assert set(after) == set(low)
        else:
            facts = {i: (n, gone) for i, n, gone, _ in plain_repeats(list(before.items()))}
            assert set(after) == {i for i, (n, gone) in facts.items() if gone < n or not n}
            assert all((after[i] == before[i]) == (not facts[i][1]) for i in after)
        rows = spark.createDataFrame(left.collect(), left.schema)
    final = corpus_pipeline.run(spark, sf_dir).collect()
    check_pieces(final, [(r["doc_id"], r["text"]) for r in rows.collect()])


def edge_rows():
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 80]) + f" end{i}", "en", "web", 0) for i in range(60)]
    rows += [(100, None, None, None, None), (None, "", "fr", "x", 1), (101, "", None, "x", 1), (102, " \n\t", "en", "x", 1)]
    rows += [(None, " ".join(words[300:360]), None, None, None), (103, "x", "en", "y", 5), rows[3], rows[3], (7, "other text of " + rows[9][1], "de", "z", 2)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_nulls_ties_and_clashing_names(spark, sf_dir, empty):
    frame = spark.createDataFrame([] if empty else edge_rows(), SCHEMA)
    clashing = {"a.b": 1, "x`y": "q", "_row": 2, "id": 3, "tag": "t", "kept": 4, "fp": 5, "h": 6, "at": 7, "n": 8, "stratum": 9, "block": 0}
    rows = frame.withColumns({name: F.lit(value) for name, value in clashing.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, rows, sf_dir)
        assert left.columns == rows.columns, name
        found = left.collect()
        assert bool(found) != empty
        assert all(tuple(r)[5:] == tuple(clashing.values()) for r in found)
        if name == "quality":
            assert all(r["text"] and len(r["text"].split()) >= 10 for r in found)
        if name == "near_duplicates":
            assert len(found) == len({r["text"] for r in found})
        rows = spark.createDataFrame(found, left.schema)
    assert bool(corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()) != empty


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_text_beyond_a_slice(spark, sf_dir, tmp_path):
    """A text of more than SLICE_BYTES through the operators that cut their batches by it."""
    rnd = random.Random(1)
    words = [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 9999)}" for _ in range(120)]
    huge = " ".join(rnd.choice(words) for _ in range(1_700_000))
    assert len(huge) > SLICE_BYTES
    passage = " ".join(rnd.choice(words) for _ in range(90))
    rows = [(1, "a " + passage), (2, huge + " " + passage + "\nend"), (3, None), (4, "x " + passage + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = tokenizing.load(P.path("byte_bpe_50k.json"))
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    assert counts == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    removed = {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(docs).collect()}
    assert removed == {1: 0, 2: 90, 3: 0, 4: 90}
    prints = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.simhash_groups(docs).collect()}
    assert prints[4] == plain_fingerprint(rows[3][1]) and len(prints) == 4
    judged = {r["doc_id"]: r["n_words"] for r in quality.quality_rules(docs.withColumn("lang", F.lit("en")), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert judged == {i: len((t or "").split()) for i, t in rows}
    check_pieces(packing.with_crc32(packing.pack(docs, P.path("word_bpe_49k.json"), end_id=2)).collect(), rows)
    check_bpe(docs, rows)


def test_a_stage_drops_what_the_one_before_has_left(spark, sf_dir, docs, tmp_path):
    def held():
        return {p for paths in corpus_pipeline._written.values() for p in paths if os.path.exists(p)}

    rows, before = docs.limit(200), set()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        found = stage(spark, rows, sf_dir)
        assert not any(os.path.exists(p) for p in before), name
        before = set(corpus_pipeline._written[spark.sparkContext.applicationId, n])
        assert before <= held()
        found.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
    # A result that was never written keeps what it reads.
    lazy = corpus_pipeline.quality_stage(spark, docs.limit(50), sf_dir)
    assert corpus_pipeline.simhash_stage(spark, lazy, sf_dir).count() <= lazy.count() <= 50
