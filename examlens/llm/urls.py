"""URL filtering: explicit rules, and trust that spreads over the hosts' links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ALLOW, BLOCK = "allow", "block"

# The address of a link that names a host, with or without a scheme; blanks before it are no part of it.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """`pattern` is a host, a slash and the beginning of a path."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


@dataclass(frozen=True)
class Spread:
    """`damping` of a host's score follows its links, the rest stays.

    Score is passed on until what is left to pass is below `tolerance` of what each host
    has: as a verdict compares two scores of one host, small ones count as large ones do.
    A host is blocked if distrust is more than `threshold` of what reaches it.
    """

    damping: float = 0.5
    tolerance: float = 1e-12
    threshold: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null or one without `://`."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(F.coalesce(after, F.lit("")), r"^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The pattern and verdict of the longest rule that fits, or nulls.

    The list is a parameter that becomes part of the plan, for up to a few hundred rules.
    """
    pattern = verdict = F.lit(None).cast("string")
    # Built from the shortest outwards, so the longest is asked first.
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        pattern = F.when(fits, F.lit(rule.pattern)).otherwise(pattern)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return pattern, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts, `src`, `dst`, `n`, from the links of the pages that name a host.

    Relative links stay on their host and carry no score elsewhere.
    """
    found = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    address = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit(":"), "link")).otherwise(F.col("link"))
    found = found.select(F.col("host").alias("src"), host_and_path(address)[0].alias("dst"))
    return found.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, links: DataFrame, how: Spread = Spread()) -> DataFrame:
    """`host`, `trust`, `distrust`: personalised PageRank over links and over links reversed.

    `seeds` has `host`, `allowed`, `blocked` (pages under rules). Both walks run as one
    table by kind. Each step adds what has arrived at a host to its score and passes
    `damping` of it on; what is below the tolerance of the host's score is not passed on
    any more: everything behind the host has got as large a part of its own score
    before. So a step's work shrinks to the hosts that still change, and the walk ends
    after as many steps as the farthest host is away, and those its tolerance takes.
    (Scores below 1e-308 are zero: with the default damping, beyond 1,000 links.)

    A step is one join and aggregates combined before their shuffles; a hub's links are
    split by AQE. Every step is written to the shared folder; two numbers leave it.
    """
    kinds = F.inline(F.array(
        F.struct(F.lit(ALLOW).alias("kind"), F.col("allowed").alias("n")),
        F.struct(F.lit(BLOCK).alias("kind"), F.col("blocked").alias("n")),
    ))
    start = seeds.select("host", kinds).where("n > 0")
    totals = start.groupBy("kind").agg(F.sum("n").alias("total"))
    start = start.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))
    both = links.select(F.lit(ALLOW).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionAll(
        links.select(F.lit(BLOCK).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    ways = both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("part"))
    ways = written(ways, "ways")
    keep = 1 - how.damping
    state = written(
        start.select("kind", "host", (keep * F.col("seed")).alias("score"), F.col("seed").alias("passed")), "scores"
    )
    while not ways.isEmpty():  # without links every score stays where it is
        arrived = state.where("passed > 0").join(ways, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), F.lit(0.0).alias("score"),
            (how.damping * F.col("passed") * F.col("part")).alias("passed"),
        )
        held = state.select("kind", "host", "score", F.lit(0.0).alias("passed"))
        summed = held.unionAll(arrived).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("passed").alias("passed"))
        score = F.col("score") + keep * F.col("passed")
        left = F.when(keep * F.col("passed") > how.tolerance * score, F.col("passed")).otherwise(0.0)
        state = written(summed.select("kind", "host", score.alias("score"), left.alias("passed")), "scores")
        if state.where("passed > 0").isEmpty():
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return state.groupBy("host").agg(of(ALLOW).alias("trust"), of(BLOCK).alias("distrust"))


def judge(
    pages: DataFrame,
    rules: list[Rule],
    *,
    how: Spread = Spread(),
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """Every page's id, `host`, `path`, `rule`, `verdict`, and its host's `trust` and `distrust`.

    The longest fitting rule decides. For the other pages their host's scores do: seeds
    are the hosts of pages under rules, weighted by their number; trust follows links
    from allowed hosts, distrust goes back along links into blocked ones. Hosts that
    nothing reaches are allowed. A null url, or one without `://`, has empty host and
    path, no rule and no score; a null html has no links; repeated rows are judged
    alike and count as pages each; an empty table gives none; other columns are not
    read. Of the html only the links leave the scan.
    """
    host, path = host_and_path(F.col(url_column))
    named = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"), F.col(html_column).alias("html"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = named.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    counted = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    seeds = (
        ruled.where("verdict is not null and host <> ''")
        .groupBy("host")
        .agg(counted(ALLOW).alias("allowed"), counted(BLOCK).alias("blocked"))
    )
    scores = spread(seeds, host_links(named.where("html is not null")), how)
    bad = F.col("distrust") > how.threshold * (F.col("trust") + F.col("distrust"))
    judged = ruled.join(scores, "host", "left")
    return judged.select(
        F.col("id").alias(id_column), "host", "path", "rule",
        F.coalesce("verdict", F.when(bad, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
