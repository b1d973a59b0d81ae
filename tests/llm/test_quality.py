"""Quality counts against brute force, the exact bound against DuckDB and simulation-free sums."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from examlens.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n ", "a b c d e a b c d e", "x " * 40, "\x0b a\x0cb\r\n\n a", "é ü ###"]
    texts += ["".join(rnd.choice("ab c\n\t#") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = frame.withColumn("lang", F.lit(None).cast("string")).withColumn("n_words", F.lit(-1))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.quality_rules(frame, labels, carried=tuple(frame.columns)).collect()
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r[c] for c in quality.COUNTS) == plain(texts[r["doc_id"]])
        assert r["_row"]["n_words"] == -1
        assert r["kept"] == (not r["base_failed"])  # no label, no cutoff
    assert quality.quality_rules(frame.limit(0), labels).collect() == []


@pytest.mark.parametrize("n, k", [(50, 0), (400, 2), (3000, 10), (3000, 59), (3000, 60)])
def test_binomial_tail(spark, n, k):
    rate = 0.02
    exact = sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1)) if k < n * rate else 1.0
    value = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), rate)).first()[0]
    assert value == pytest.approx(exact, rel=1e-8)


def test_good_documents_are_rejected_within_the_rate(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed")
    rates = judged.groupBy("quality").agg(F.avg((~F.col("kept")).cast("int"))).collect()
    rates = dict(map(tuple, rates))
    assert rates[1] <= quality.Risk().rate


def test_disagreeing_and_null_labels_do_not_count(spark):
    frame = spark.createDataFrame([(i, "w%d " % i * 3 + "a b c d e f g h i j") for i in range(30)], "doc_id long, text string")
    frame = frame.withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert quality.quality_rules(frame, labels).where("kept").count() == 30


def plain_level(part, whole, steps):
    return -(-part * steps // whole) if whole else 0


def plain_levels(text):
    n_words, word_chars, symbols, dup_lines, repeat_words = plain(text)
    n_lines = sum(1 for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    return [
        plain_level(symbols, word_chars, 64), plain_level(dup_lines, n_lines, 64),
        plain_level(repeat_words, n_words, 64), plain_level(word_chars, n_words, 4),
    ]


def plain_tail(n, k, rate):
    if k >= n * rate:
        return 1.0
    return sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))


def base_failed(text):
    n_words, *_, repeat_words = plain(text)
    return n_words < 10 or 100 * repeat_words > 20 * n_words


def mixed_documents(good_counts, seed):
    """Rows `doc_id`, `text`, `lang` and their labels; some good documents have symbols, lines and words of bad ones."""
    rnd, rows, labels = random.Random(seed), [], []
    for lang, n_good in good_counts.items():
        for i in range(n_good + n_good // 4):
            words = [rnd.choice("abcdefgh") * rnd.randint(1, 8) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(8, 24))]
            odd = rnd.random() < (0.01 if i < n_good else 0.6)
            if odd and rnd.random() < 0.3:
                words += [f"{rnd.choice('abcdefgh')}{j}x" for j in range(rnd.randint(50, 120))]
                words += words[:5]
            if odd and rnd.random() < 0.7:
                words += ["#" * rnd.randint(1, 9)]
            text = " ".join(words)
            if odd and rnd.random() < 0.5:
                text += "\nx" * rnd.randint(2, 4)
            rows.append((len(rows), text, lang))
            labels.append((rows[-1][0], int(i < n_good)))
    return rows, labels


def plain_joint(rows, labels):
    """The cutoffs of every stratum, each rule of the fixed order tried on the documents themselves."""
    risk, good = quality.Risk(joint=True), {i for i, q in labels if q}
    held = {lang: [plain_levels(t) for i, t, x in rows if x == lang and i in good and not base_failed(t)] for lang in {r[2] for r in rows}}
    found = {}
    for lang, levels in held.items():
        top = [max(x[s] for x in levels) for s in range(4)]
        order = [(s, c) for s in range(4) for c in range(top[s], -1, -1)]
        for s, c in order:
            rule = [0] * s + [c] + [math.inf] * (3 - s)
            k = sum(any(a > b for a, b in zip(x, rule, strict=True)) for x in levels)
            if plain_tail(len(levels), k, risk.rate) > risk.error / len(held):
                break
            found[lang] = rule
    return found


def test_joint_rules_need_fewer_labels(spark):
    assert (quality.Risk().needed(4), quality.Risk(joint=True).needed(4)) == (1151, 217)
    rows, labels = mixed_documents({"en": 700, "fr": 300, "de": 120}, 11)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    named = spark.createDataFrame(labels, "doc_id long, quality int")
    plain_cutoffs = plain_joint(rows, labels)
    assert set(plain_cutoffs) == {"en", "fr"}  # 120 are too few
    expected = {i for i, t, lang in rows if not base_failed(t) and not any(
        a > b for a, b in zip(plain_levels(t), plain_cutoffs.get(lang, [math.inf] * 4), strict=True))}
    found = quality.quality_rules(docs, named, risk=quality.Risk(joint=True))
    kept = {r["doc_id"] for r in found.where("kept").collect()}
    assert kept == expected
    alone = {r["doc_id"] for r in quality.quality_rules(docs, named).where("kept").collect()}
    assert alone - kept and not kept - alone
    good = {i for i, q in labels if q}
    assert len((alone - kept) & good) < 0.02 * len(good)


def plain_alone(rows, labels):
    """The cutoff of every stratum and signal, each tried on the documents themselves; inf: none."""
    risk, good, found = quality.Risk(), {i for i, q in labels if q}, {}
    strata = {r[2] for r in rows}
    for lang in strata:
        levels = [plain_levels(t) for i, t, x in rows if x == lang and i in good and not base_failed(t)]
        found[lang] = []
        for s in range(4):
            safe = [c for c in {x[s] for x in levels} if plain_tail(len(levels), sum(x[s] > c for x in levels), risk.rate / 4) <= risk.error / (4 * len(strata))]
            found[lang].append(min(safe, default=math.inf))
    return found


def test_cutoffs_and_kept_with_enough_labels(spark, tmp_path):
    rows, labels = mixed_documents({"en": 2500, "fr": 1300, "de": 40}, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    named = spark.createDataFrame(labels, "doc_id long, quality int")
    limits = plain_alone(rows, labels)
    assert all(c < math.inf for lang in ("en", "fr") for c in limits[lang])
    assert limits["de"] == [math.inf] * 4 and limits["en"] != limits["fr"]

    columns = [F.col("doc_id").alias("_id"), F.col("lang").alias("stratum")]
    good_ids = {i for i, q in labels if q and not base_failed(rows[i][1])}
    good = quality._counted(docs, "text", columns).where(F.col("_id").isin(good_ids))
    found = {r["stratum"]: list(r)[1:] for r in quality.cutoffs(good, quality.Risk()).collect()}
    assert found == {lang: limits[lang] for lang in ("en", "fr")}

    above = {i: [a > b for a, b in zip(plain_levels(t), limits[lang], strict=True)] for i, t, lang in rows if not base_failed(t)}
    expected = {i for i, x in above.items() if not any(x)}
    assert any(a == b for i in expected for a, b in zip(plain_levels(rows[i][1]), limits[rows[i][2]], strict=True))
    assert all(any(x[s] for x in above.values()) for s in range(4))  # each signal rejects some
    assert good_ids - expected  # and some good documents are among them
    kept = {r["doc_id"] for r in quality.quality_rules(docs, named).where("kept").collect()}
    assert kept == expected
    named.write.parquet(str(tmp_path / "labels.parquet"))
    joint = {r["doc_id"] for r in quality.quality_rules(docs, named, risk=quality.JOINT).where("kept").collect()}
    plain_cutoffs = plain_joint(rows, labels)
    assert joint == {i for i, t, lang in rows if not base_failed(t) and not any(
        a > b for a, b in zip(plain_levels(t), plain_cutoffs.get(lang, [math.inf] * 4), strict=True))}
    assert sorted(corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()) == [r for r in rows if r[0] in joint]


def test_strata_do_not_meet_in_one_task(spark):
    rows = [(f"s{i % 50}", 10, 50, i % 3, 0, 0, 1) for i in range(2000)]
    good = spark.createDataFrame(rows, "stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    for risk in (quality.Risk(), quality.Risk(joint=True)):
        plan = quality.cutoffs(good, risk)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
        assert windows and all(", [stratum#" in line for line in windows)
        assert "collect_list" not in plan
    loose = quality.Risk(rate=0.9, error=0.9)  # forty labels a stratum are enough
    assert quality.cutoffs(good, loose).count() == 50
