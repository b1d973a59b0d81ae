"""WARC bundles, URL filters, chat templates and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from llm.conftest import order
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from examlens.llm import chat, iblt, oracles, queries, template, urls, warc


def pages(spark):
    body = "ab\r\n\r\né"
    rows = [(i, f"http://x/{i}" if i % 3 else None, body * (200 if i % 4 else 3) + str(i % 5)) for i in range(60)]
    rows += [(None, "u\n\r: x", "é" * 1000), (70, "", None), (71, "a", ""), *[(3, "x", "z" * 1800)] * 2, (2, "x", "z" * 1800)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).repartition(3)


def test_warc_round_trip(spark):
    rows, frame = pages(spark)
    latest = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            latest[data] = max(latest.get(data, i), i)
    plain = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = latest.get(data) if i is not None and latest.get(data) != i else None
        plain.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    assert order(map(tuple, warc.round_trip(frame).collect())) == order(plain)
    assert warc.round_trip(frame.limit(0)).collect() == []


def test_bundles_seek_and_expand(spark):
    rows, frame = pages(spark)
    seen = 0
    for bundle in warc.write_bundles(frame).collect():
        content = bytes(bundle["content"])
        whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        assert len(list(warc.parse_records(whole))) == len(bundle["entries"])
        for e in bundle["entries"]:
            record = warc.read_record(content, e["frame"], e["offset"], e["length"])
            assert e["record_id"].encode() in record and record in whole
            seen += 1
    assert seen == len(rows)


@pytest.mark.parametrize("damage", ["swapped", "renamed", "missing", "shifted"])
def test_damaged_entries_fail(spark, damage):
    rows, frame = pages(spark)
    bundle = warc.write_bundles(frame.coalesce(1)).first().asDict(recursive=True)
    entries = bundle["entries"]
    assert len(entries) == len(rows)
    if damage == "swapped":
        a, b = entries[0], entries[4]
        a["offset"], b["offset"], a["length"], b["length"] = b["offset"], a["offset"], b["length"], a["length"]
    elif damage == "renamed":
        entries[3]["record_id"] = entries[5]["record_id"] + "x"
    elif damage == "missing":
        del entries[-1]
    else:
        entries[2]["offset"] += 1
    damaged = spark.createDataFrame([bundle], "content binary, entries array<struct<record_id string, frame int, offset long, length long>>")
    with pytest.raises(PythonException):
        warc.read_bundles(damaged, "bigint").collect()


RULES = [urls.Rule("allow", "com/"), urls.Rule("block", "example.com/en/"), urls.Rule("allow", "www.example.com/en/"), urls.Rule("block", "net/es/")]


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        (None, "", "", None),
        ("abc", "", "", None),
        ("http://COM/", "com", "/", "com/"),
        ("https://A.b.COM/x?y#z", "a.b.com", "/x", "com/"),
        ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/"),
        ("http://m.www.example.com/en/2", "m.www.example.com", "/en/2", "www.example.com/en/"),
        ("http://xexample.com/en/", "xexample.com", "/en/", "com/"),
        ("http://m.example.com", "m.example.com", "", None),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/"),
        ("x://h.org?a/b://c", "h.org", "", None),
    ],
)
def test_rules(spark, url, host, path, rule):
    frame = spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")
    (found,) = urls.judge(frame, RULES).collect()
    assert (found["host"], found["path"], found["rule"]) == (host, path, rule)


LINK = re.compile(r"""<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)""", re.I)


def plain_host(url):
    found = re.search(r"//([^/?#]*)", url)
    return re.sub("[A-Z]", lambda m: m[0].lower(), found[1]) if found else ""


def plain_walk(seed, edges, damping=0.5):
    """All score that arrives, until nothing is left to pass on."""
    total = sum(seed.values())
    passed, score = {h: v / total for h, v in seed.items()}, {}
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    while passed:
        following = {}
        for h, v in passed.items():
            score[h] = score.get(h, 0) + (1 - damping) * v
        for (a, b), n in edges.items():
            if a in passed:
                following[b] = following.get(b, 0) + damping * passed[a] * n / out[a]
        passed = {h: v for h, v in following.items() if v > 0}
    return score


def plain_judge(rows, rules):
    ruled, seeds, edges = [], {"allow": Counter(), "block": Counter()}, Counter()
    for i, url, html in rows:
        host = plain_host(url) if url and "://" in url else ""
        path = re.match(r".*?://[^/?#]*([^?#]*)", url, re.S)[1] if host else ""
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.pattern), default=None)
        ruled.append((i, host, path, rule))
        if rule and host:
            seeds[rule.verdict][host] += 1
        for link in LINK.findall(html or ""):
            to = plain_host(link)
            if host and to and to != host:
                edges[host, to] += 1
    trust = plain_walk(seeds["allow"], edges)
    distrust = plain_walk(seeds["block"], Counter({(b, a): n for (a, b), n in edges.items()}))
    out = []
    for i, host, path, rule in ruled:
        t, d = trust.get(host, 0), distrust.get(host, 0)
        verdict = rule.verdict if rule else "block" if d > 0.5 * (t + d) else "allow"
        out.append((i, host, path, rule.pattern if rule else None, verdict))
    return out


def linked_pages():
    """Absolute, scheme-relative and relative links, hubs, cycles, and chains of 25 hosts."""
    page = lambda i, url, *links: (i, url, " ".join(f'<a class="x" href="{x}">t</a>' for x in links))
    rows = [page(i, f"http://chain{i}.org/", f"http://chain{i + 1}.org/p") for i in range(25)]
    rows += [page(30, "http://chain25.org/", "HTTP://X.Net/es/1")]
    rows += [page(40 + i, f"https://good{i}.org/", f"https://good{i - 1}.org/") for i in range(1, 25)]
    rows += [page(70, "http://a.com/", "https://good24.org/x?y", "http://mixed.org", "//hub.org/1")]
    rows += [page(71, "http://mixed.org/1", "//x.net/es/", "//x.net/es/2"), page(72, "http://only.org", " //x.net/es/1 ")]
    rows += [page(73, "http://relative.org/", "/net//es", "net/es/", "#//x.net"), page(74, "http://hub.org/", *[f"//leaf{i}.org/" for i in range(40)])]
    rows += [page(75, "http://loop1.org", "http://loop2.org"), page(76, "http://loop2.org", "http://loop1.org", "http://x.net/es/")]
    rows += [(77, "http://bare.org/", "<A\nHREF=//x.net/es/3>"), (78, "http://none.org/", "<b href='//x.net/es/'>"), (79, None, "<a href=//x.net/es/>")]
    rows += [(80, "http://x.net/es/9", None), (81, "http://x.net/other", ""), (82, "no url", "<a href='http://x.net/es/'>"), (None, "http://only.org/2", None)]
    return rows + rows[:3] + [(70, "http://a.com/", rows[50][2])]


def test_verdicts_on_linked_pages(spark):
    rows = linked_pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    clashing = frame.withColumn("host", F.lit(1)).withColumn("id", F.lit("x")).withColumn("a.b", F.lit(2)).withColumn("verdict", F.lit("z"))
    found = urls.judge(clashing, queries.RULES).select("page_id", "host", "path", "rule", "verdict")
    plain = plain_judge(rows, queries.RULES)
    assert order(map(tuple, found.collect())) == order(plain)
    verdicts = {i: v for i, *_, v in plain}
    assert {verdicts[i] for i in (*range(25), 30, 72, 75, 76, 77)} == {"block"}
    assert {verdicts[i] for i in (*range(41, 65), 70, 73, 74, 78, 79)} == {"allow"}
    assert urls.judge(clashing.limit(0), queries.RULES).collect() == []


def test_the_twin_follows_links_too(spark, tmp_path):
    rows = linked_pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = queries.op3_url_filters(spark, str(tmp_path))
    twin = duck.sql(oracles.oracle_sql()["op3_url_filters"])
    # The twin names a page by its id; pages without one or under one id are told apart here by the rest.
    distinct = lambda rows: order({tuple(r) for r in rows if r[0] is not None})
    assert distinct(found.collect()) == distinct(twin.select(*found.columns).fetchall())


def test_scores_follow_the_links(spark):
    seeds = spark.createDataFrame([("a", 3, 0), ("b", 1, 2)], "host string, allowed long, blocked long")
    links = Counter({("a", "c"): 1, ("a", "d"): 3, ("c", "b"): 2, ("d", "d2"): 1})
    frame = spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n long")
    found = {r["host"]: (r["trust"], r["distrust"]) for r in urls.spread(seeds, frame).collect()}
    trust, distrust = plain_walk({"a": 3, "b": 1}, links), plain_walk({"b": 2}, Counter({(b, a): n for (a, b), n in links.items()}))
    assert set(found) == set(trust) | set(distrust)
    for host, scores in found.items():
        assert scores == pytest.approx((trust.get(host, 0), distrust.get(host, 0)))


def test_conversations_come_back(spark):
    rnd = random.Random(1)
    texts = [None, "", "\\### Assistant: </turn> ok", "é\n\n### x: y</turn>\n", "a" * 50, "\\", "#\\", "\\h"]
    rows = [(rnd.choice([None, *range(6)]), rnd.choice([None, 0, 1, 2]), rnd.choice(["user", "assistant", None, "a: b"]), rnd.choice(texts)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    plain = []
    for conversation in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), role or "", text or "") for c, t, role, text in rows if c == conversation)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        plain.append((conversation, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    pieces = chat.format_conversations(frame)
    for found in (chat.read_back(pieces, ordered=True), chat.read_back(pieces.repartition(3))):
        assert order(tuple(r)[:5] for r in found.collect()) == order(plain)
    assert chat.read_back(chat.format_conversations(frame.limit(0))).collect() == []


def test_templates_fold_and_render():
    source = "{% for a in xs %}{% if loop.first %}<{% elif a == 'b' %}[{% else %}({% endif %}{{ a | upper }}{{ 'x' ~ 'y' }}{% endfor %}{% if 1 == 2 %}no{% endif %}"
    run = template.compile_template(source)
    assert "".join(x for x in run({"xs": iter("abc")})) == "<Axy[Bxy(Cxy"
    folded = template.fold(template.parse("{{ 'a' ~ 'b' }}c{% if 1 == 1 %}d{% endif %}"), {})
    assert folded == template.constant("abcd")
    assert list(template.compile_template("{{ x.__class__ }}{{ x.y }}")({"x": 3})) == ["", ""]
    for bad in ("{% if x %}", "{{ x | nothing }}", "{% for x %}{% endfor %}", "{{ }}", "{% endif %}", "{{ (x }}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)


def plain_parts(text):
    """The parts of a text with their number among equal ones: lines, of ten words and 256 characters at most."""
    found = []
    for line in text.split("\n"):
        words = line.split(" ")
        while words:
            run, words = " ".join(words[:10]), words[10:]
            found += [run[k : k + 256] for k in range(0, len(run), 256)]
    return [(part, found[:n].count(part)) for n, part in enumerate(found)]


def plain_sums(parts):
    """What the cells of a fingerprint add up to: three entries a part, and their digests."""
    key = 0
    for part, n in parts:
        key ^= xxhash.xxh3_64_intdigest(part.encode(), n)
    return 3 * len(parts), key


def sums_of(text):
    table = iblt.from_text(text)
    return int(table["count"].sum()), int(np.bitwise_xor.reduce(table["key"]))


def plain_fingerprints(rows):
    rows, out = sorted(rows), []
    for k, (i, text) in enumerate(rows):
        half, following = len(text) // 2, rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - half] + following[:half]
        parts = [plain_parts(t) for t in (text, edited, following)]
        own, other, after = map(set, parts)
        near = [len(own & x) / len(own | x) if own | x else 1.0 for x in (other, after)]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near, plain_sums(parts[0]), plain_sums(parts[1])))
    return out


def fingerprints_of(frame):
    found = iblt.fingerprints(frame).collect()
    columns = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]
    return sorted((*[r[c] for c in columns], sums_of(r["fingerprint"]), sums_of(r["edited_fingerprint"])) for r in found)


@pytest.mark.parametrize("parts", [1, 3, 10_000])
def test_ranges_of_ids_need_no_list_of_quantiles(spark, parts, monkeypatch):
    ids = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS id")
    whole = iblt._bounds(ids, parts)
    monkeypatch.setattr(iblt, "SAMPLE", 500)
    some = iblt._bounds(ids, parts)
    for bounds in (whole, some):
        assert len(bounds) < parts and (np.diff(bounds.astype(np.int64)) > 0).all()
    assert len(iblt._bounds(ids.limit(0), parts)) == 0
    rows = [(i, f"text {i}") for i in range(200)]
    monkeypatch.setattr(iblt, "shuffle_partitions", lambda spark: min(parts, 64))
    assert fingerprints_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain_fingerprints(rows)


def test_fingerprints(spark, docs, texts):
    rnd = random.Random(2)
    rows = [(i * 3, "\n".join(rnd.choice(["a", "é" * 300, "", "zz " * rnd.randint(1, 9)]) for _ in range(rnd.randint(0, 40)))) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).repartition(5)
    assert fingerprints_of(frame) == plain_fingerprints(rows)
    assert fingerprints_of(frame.limit(0)) == []
    odd = [(5, "ab\ncd"), (5, "ab\ncd"), (5, None), (None, "x"), (None, None)]
    assert iblt.fingerprints(spark.createDataFrame(odd, "doc_id long, text string")).count() == 5
    assert fingerprints_of(docs) == plain_fingerprints([(i, t or "") for i, t in texts])


@pytest.mark.parametrize("n", [0, 1, 5, 50, 500])
def test_peeling_recovers_the_differences(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    b = np.concatenate((a[: n // 2], rng.integers(0, 1 << 63, n // 2 + 1, dtype=np.uint64)))
    assert iblt.difference(a, b, iblt.sketch(a), iblt.sketch(b)) == (n - n // 2, n // 2 + 1)
    assert (iblt.from_text(iblt.to_text(iblt.sketch(a))) == iblt.sketch(a)).all()


def test_a_short_edited_text_is_near_itself(spark):
    line = lambda word: " ".join(f"{word}{i}" for i in range(60))
    rows = [(i, line(w)) for i, w in enumerate("abc")]
    assert all(len(t) < 512 for _, t in rows)
    found = iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # The first half is equal: two whole parts of ten words at least.
    assert all(r["near_edited"] > r["near_next"] == 0 for r in found)
    assert len(iblt.paragraphs("a b\n\nc")) == 2 and len(iblt.paragraphs("x" * 257)) == 2
