"""Quality rules whose cutoffs hold a guaranteed rate of false rejections per stratum.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WHITE, written, whole_row

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
CARRIED = "_row"

# Signals, higher is worse: what is divided by what, and how finely cutoffs are tried.
# A signal's cutoffs are 0, 1/steps, 2/steps, ...
SIGNALS = {
    "symbols": ("n_symbols", "word_chars", 64),
    "dup_lines": ("n_dup_lines", "n_lines", 64),
    "repeats": ("n_repeat_words", "n_words", 64),
    "word_length": ("word_chars", "n_words", 4),
}


@dataclass(frozen=True)
class Risk:
    """At most `rate` of the good documents of a stratum are rejected by the learnt cutoffs.

    Holds for all strata and signals at once with probability 1 - `error`: the rate is
    shared by the signals, the error by signals and strata (Bonferroni); the cutoffs of
    a signal are tested from the loosest on and the first failure ends them, which needs
    no further correction. Even a cutoff that rejects no good document needs `needed`
    of them in its stratum, 1,151 for four strata; with fewer there is no cutoff.

    `joint` tests the cutoffs of all signals together as one rule, at the whole rate
    and an error shared by the strata alone, which needs 217 for four strata. The rules
    follow each other in one fixed order: the signals as in SIGNALS, each from its loosest
    cutoff down to 0 before the next begins, and the first failure ends them.
    """

    rate: float = 0.02
    error: float = 0.05
    joint: bool = False

    def needed(self, strata: int) -> int:
        """The good documents without which a stratum, one of `strata` with all signals, gets no cutoff."""
        signals = 1 if self.joint else len(SIGNALS)
        return math.ceil(math.log(self.error / (strata * signals)) / math.log1p(-self.rate / signals))


# What the queries take: good bounds from few labels.
JOINT = Risk(joint=True)


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _counted(docs: DataFrame, text: str, carried: list[Column]) -> DataFrame:
    """The base counts and `n_lines` (lines with a word) beside the carried columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(*carried, body.alias("_text"), F.btrim(body, F.lit(WHITE)).alias("_trimmed"))
    empty = F.array().cast("array<string>")
    cut = cut.withColumns(
        {
            "_words": F.when(F.col("_trimmed") == "", empty).otherwise(
                F.split("_trimmed", "[\\x20\\x09-\\x0D]+", -1)
            ),
            "_lines": F.filter(
                F.split("_text", "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != ""
            ),
            "word_chars": F.length(without(F.col("_text"), WHITE)).cast("long"),
            "n_symbols": (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long"),
        }
    ).drop("_text", "_trimmed")
    last = F.size("_words") - REPEAT_WORDS
    words = F.col("_words")
    # Chained over the words, so the bounds between them count. Two different windows of one
    # text are taken for equal with a probability of about windows^2 / 2^65.
    hashed = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[words[i + k] for k in range(REPEAT_WORDS)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    cut = cut.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": hashed,
        }
    ).drop("_words", "_lines")
    # Sorting is left to texts with a repeated window.
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    cut = cut.withColumn(
        "_sorted",
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed),
    ).drop("_hashes")
    ordered = F.col("_sorted")
    repeated = F.filter(
        ordered,
        lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"]))
        | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)),
    )
    cut = cut.withColumn("_starts", F.sort_array(F.transform(repeated, lambda x: x["at"]))).drop("_sorted")
    step = F.lit(REPEAT_WORDS)
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-REPEAT_WORDS).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(step, p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return cut.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")


def ln_gamma(x: Column) -> Column:
    """Stirling's series after a shift by eight; x is 1 or more."""
    y = x + 8
    shifted = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
    shifted = shifted + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return shifted - sum((F.log(x + k) for k in range(1, 8)), F.log(x))


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for n draws at `rate`, 1 where k is not below the mean.

    Below the mean the terms fall from k downwards; those over 12 standard deviations
    away are under the precision of a double.
    """
    n, k = n.cast("double"), k.cast("double")
    log_term = (
        ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    )
    terms = F.least(k, 12 * F.sqrt(n) + 40).cast("int")
    odds = (1 - rate) / rate
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(terms, F.lit(0))),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda a, i: F.struct(
            (a["term"] * (k - i) / (n - k + i + 1) * odds).alias("term"),
            (a["total"] + a["term"]).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.when(k < n * rate, F.exp(log_term) * total).otherwise(1.0)


def _level(name: str) -> Column:
    """How many of a signal's cutoffs a document lies above."""
    part, whole, steps = SIGNALS[name]
    return F.coalesce(F.ceil(F.try_divide(F.col(part), F.col(whole)) * steps), F.lit(0)).cast("int")


def cutoffs(good: DataFrame, risk: Risk) -> DataFrame:
    """The tightest safe cutoff of every signal as a column, a row per stratum; NULL: none is safe.

    `good` has the counts and the `stratum` of every labelled good document. They meet
    as one count per stratum, signal and level. Between observed levels the rejections
    do not change, so the observed ones are the candidates.
    """
    if risk.joint:
        return _joint_cutoffs(good, risk)
    levels = good.select(
        "stratum",
        F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), _level(n).alias("level")) for n in SIGNALS])).alias("x"),
    )
    counted = levels.groupBy("stratum", "x.signal", "x.level").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted, "quality_levels")
    group = W.partitionBy("stratum", "signal")
    above = group.orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1)
    tried = counted.select(
        "stratum", "signal", "level", F.sum("n").over(group).alias("n"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("rejected"),
    )
    # The strata and signals there are share the error; their number is a single row.
    tests = counted.agg(F.count_distinct("stratum", "signal").alias("tests"))
    safe = tried.crossJoin(F.broadcast(tests)).where(
        binomial_tail(F.col("n"), F.col("rejected"), risk.rate / len(SIGNALS)) <= F.lit(risk.error) / F.col("tests")
    )
    return safe.groupBy("stratum").agg(
        *[F.min(F.when(F.col("signal") == n, F.col("level"))).alias(f"c_{n}") for n in SIGNALS]
    )


def _joint_cutoffs(good: DataFrame, risk: Risk) -> DataFrame:
    """`cutoffs` by the joint rules: signals before the one the order ends at have 0, later ones NULL.

    A document's first signal above 0 and its level there say which rule rejects it first.
    """
    end = F.struct(F.lit(len(SIGNALS)).alias("at"), F.lit(0).alias("level"))
    first = F.coalesce(
        *[F.when(_level(n) > 0, F.struct(F.lit(i).alias("at"), _level(n).alias("level"))) for i, n in enumerate(SIGNALS)], end
    )
    counted = good.select("stratum", first.alias("x")).groupBy("stratum", "x.at", "x.level").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted, "quality_levels")
    group = W.partitionBy("stratum")
    before = group.orderBy("at", F.desc("level")).rowsBetween(W.unboundedPreceding, -1)
    tried = counted.select(
        "stratum", "at", "level", F.sum("n").over(group).alias("n"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rejected"),
    )
    tests = counted.agg(F.count_distinct("stratum").alias("tests"))
    safe = tried.crossJoin(F.broadcast(tests)).where(
        binomial_tail(F.col("n"), F.col("rejected"), risk.rate) <= F.lit(risk.error) / F.col("tests")
    )
    last = safe.groupBy("stratum").agg(F.max(F.struct("at", (-F.col("level")).alias("down"))).alias("x"))
    return last.select(
        "stratum",
        *[F.when(F.col("x.at") > i, 0).when(F.col("x.at") == i, -F.col("x.down")).alias(f"c_{n}") for i, n in enumerate(SIGNALS)],
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    stratum_column: str = "lang",
    carried: tuple[str, ...] = (),
    risk: Risk = Risk(),
) -> DataFrame:
    """Every document with its counts, `base_failed` and `kept`; `_row` holds the carried columns.

    `labels` has the id and `quality` (1 good, 0 bad). Base rules reject documents under
    ten words or with over 20 % of words in repeated windows; the rest is rejected if a
    signal lies above its stratum's cutoff. The good labelled documents that pass the
    base rules are the holdout: nothing is fitted to them but the cutoffs, all of them
    count.

    A null text is empty and fails the base rules; a null stratum is a stratum of its
    own; a document without id, or with labels that disagree or are null, counts as not
    labelled; a stratum with fewer good labels than `Risk.needed` has no cutoff and keeps
    what passes the base rules, bad labels or not; repeated rows are judged alike; empty tables give an empty result. Other
    columns are read only if carried, and cannot clash there.
    """
    row = [whole_row(docs, *carried).alias(CARRIED)] if carried else []
    stratum = F.coalesce(F.col(stratum_column).cast("string"), F.lit(""))
    columns = [F.col(id_column).alias("_id"), stratum.alias("stratum"), *row]
    # Written before anything is asked of the counts: a filter on them, pushed into the
    # expressions that make them, would work each out many times over.
    counted = written(_counted(docs, text_column, columns), "quality_counts")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    named = labels.groupBy(F.col(id_column).alias("_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    good = counted.where(~failed).join(named.where("low = 1 and high = 1"), "_id", "left_semi")
    # Written, so that Spark knows their size and moves no document where they are small.
    limits = written(cutoffs(good.select("stratum", "n_lines", *COUNTS), risk), "quality_cutoffs")
    over = [F.coalesce(_level(n) > F.col(f"c_{n}"), F.lit(False)) for n in SIGNALS]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    judged = counted.join(limits, "stratum", "left")
    return judged.select(
        F.col("_id").alias(id_column),
        *COUNTS,
        failed.alias("base_failed"),
        (~failed & ~rejected).alias("kept"),
        *([CARRIED] if carried else []),
    )
