"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from .chat import CLOSE, OPEN, SEPARATOR
from .quality import JOINT, MAX_REPEAT_PERCENT, MIN_WORDS, SIGNALS
from .queries import RULES, TRICKY_ID, TRICKY_TEXT
from .urls import Spread
from .warc import MIN_REVISIT_BYTES

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS pos
         FROM windows JOIN firsts USING (h) WHERE first < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
         FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_RISK = JOINT
_LEVELS = " UNION ALL ".join(
    f"SELECT *, {at} AS spot, "
    f"CAST(coalesce(ceil({part} / nullif({whole}, 0) * {steps}), 0) AS INTEGER) AS level FROM judged"
    for at, (part, whole, steps) in enumerate(SIGNALS.values())
)
QUALITY = f"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS body, {WORDS} AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
twice AS (SELECT doc_id, unnest(places) AS p FROM (
              SELECT doc_id, list(p) AS places FROM windows GROUP BY doc_id, g HAVING count(*) > 1)),
repeats AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (
                SELECT doc_id, unnest(range(p, p + 5)) AS pos FROM twice) GROUP BY doc_id),
counted AS (
    SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
    FROM d LEFT JOIN repeats USING (doc_id)),
judged AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
levels AS ({_LEVELS}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
firsts AS (
    SELECT doc_id, stratum, coalesce(min(spot) FILTER (level > 0), {len(SIGNALS)}) AS spot,
           coalesce(arg_min(level, spot) FILTER (level > 0), 0) AS level
    FROM levels WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY doc_id, stratum),
steps AS (SELECT stratum, spot, level, count(*) AS n FROM firsts GROUP BY ALL),
tried AS (
    SELECT stratum, spot, level, sum(n) OVER (PARTITION BY stratum) AS n,
           coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY spot, level DESC
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
    FROM steps),
tests AS (SELECT count(DISTINCT stratum) AS m FROM steps),
terms AS (
    SELECT stratum, spot, level, n, k, unnest(range(CAST(k AS BIGINT) + 1)) AS i FROM tried WHERE k < n * {_RISK.rate}),
tails AS (
    SELECT stratum, spot, level,
           sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK.rate}) + (n - i) * ln(1 - {_RISK.rate}))) AS tail
    FROM terms GROUP BY ALL),
last AS (
    SELECT stratum, max(spot) AS spot, arg_max(level, spot * 1000000 - level) AS level
    FROM tails, tests WHERE tail <= {_RISK.error} / m GROUP BY stratum),
rejected AS (
    SELECT DISTINCT doc_id FROM levels JOIN last USING (stratum)
    WHERE levels.level > 0 AND (levels.spot < last.spot OR levels.spot = last.spot AND levels.level > last.level))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM judged
"""


WARC = f"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages),
latest AS (
    SELECT payload_digest, max(page_id) AS latest FROM p WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN latest <> page_id THEN latest END AS refers_to
FROM p LEFT JOIN latest USING (payload_digest)
"""

_ESCAPED = r"""length({0}) + length({0}) - length(replace({0}, '\', ''))
    + length({0}) - length(replace({0}, '###', '')) + (length({0}) - length(replace({0}, '</turn>', ''))) / 7"""
CHAT = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {TRICKY_ID}, 0, 'user', '{TRICKY_TEXT}' UNION ALL SELECT {TRICKY_ID}, 1, 'assistant', '{TRICKY_TEXT}'),
s AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
           sum({len(OPEN) + len(SEPARATOR) + len(CLOSE)} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS chars
    FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM s
"""

_HOST = "translate(regexp_extract(coalesce({0}, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.pattern}', '{r.verdict}')" for r in RULES)


def _urls(how: Spread) -> str:
    """The walk goes on until nothing is left to pass on, not even the smallest number."""
    return f"""
WITH RECURSIVE p AS (
    SELECT page_id, {_HOST.format("url")} AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
rules(rule_host, rule_path, rule, verdict) AS (VALUES {_RULES}),
fits AS (
    SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id),
ruled AS (SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN fits USING (page_id)),
pages_by AS (SELECT verdict AS kind, host, count(*) AS n FROM ruled WHERE verdict IS NOT NULL AND host <> '' GROUP BY ALL),
seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS seed FROM pages_by),
hrefs AS (
    SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS link
    FROM p),
links AS (
    SELECT src, dst, count(*) AS n
    FROM (SELECT src, {_HOST.format("CASE WHEN starts_with(link, '//') THEN ':' || link ELSE link END")} AS dst FROM hrefs)
    WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
both_ways AS (SELECT 'allow' AS kind, src, dst, n FROM links UNION ALL SELECT 'block', dst, src, n FROM links),
ways AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS part FROM both_ways),
walk(kind, host, passed) AS (
    SELECT kind, host, CAST(seed AS DOUBLE) FROM seeds
    UNION ALL
    SELECT w.kind, w.dst, sum({how.damping} * s.passed * w.part)
    FROM walk s JOIN ways w ON s.kind = w.kind AND s.host = w.src
    GROUP BY w.kind, w.dst HAVING sum({how.damping} * s.passed * w.part) > 0),
scores AS (
    SELECT host, coalesce(sum({1 - how.damping} * passed) FILTER (kind = 'allow'), 0) AS trust,
           coalesce(sum({1 - how.damping} * passed) FILTER (kind = 'block'), 0) AS distrust FROM walk GROUP BY host)
SELECT page_id, ruled.host AS host, path, rule,
       coalesce(verdict, CASE WHEN distrust > {how.threshold} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scores ON ruled.host = scores.host
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": SUBSTRING,
        "op3_url_filters": _urls(Spread()),
        "op4_warc": WARC,
        "op6_chat_formatting": CHAT,
        "op9_quality_rules": QUALITY,
    }
