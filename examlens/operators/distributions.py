"""How the scored students of a program are spread: exact quantiles, and the best for every weight."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .activity import fast_furious
from .model import Model

DECILES = tuple(range(1, 10))
# Fixed value: the slider's positions between 0 and 1.
POSITIONS = 100


def grouped_quantiles(
    df: DataFrame, group: list[str], value: str, parts: int, wanted: tuple[int, ...], buckets: int = 4096
) -> DataFrame:
    """Exact quantiles `wanted` / `parts` of a value per group: the group, `part`, the value and `n` values.

    The quantile is the smallest value with at least that share of the values up to it;
    NULL values do not count. Range counting in two passes: the first counts the values
    of each group in equal ranges, which tells the range of every quantile; the second
    counts the different values in those ranges alone. Both are combined before their
    shuffles, so no task holds the values of a group, however large it is.
    """
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    on = same[0]
    for s in same[1:]:
        on = on & s
    named = [F.col(g).alias(f"_{g}") for g in group]
    values = df.select(*group, F.col(value).cast("double").alias("_v")).where("_v is not null")
    bounds = values.groupBy(*group).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("_v").alias("n"))
    ranged = values.join(bounds.select(*named, "_low", "_high"), on)
    share = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low"))
    # Rounding may move a value to a neighbouring range, but never past a larger value.
    ranged = ranged.select(*group, "_v", F.coalesce(F.least(F.floor(share * buckets), F.lit(buckets - 1)), F.lit(0)).alias("_b"))
    counts = ranged.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(whole))
    # The rank in whole numbers: ceil(n * part / parts).
    rank = F.floor((F.col("n") * F.col("part") + parts - 1) / parts).cast("long")
    ranks = placed.select(*group, "_b", "_n", "_before", "n", F.explode(F.array(*map(F.lit, wanted))).alias("part"))
    ranks = ranks.withColumn("_rank", F.greatest(rank, F.lit(1)) - F.col("_before")).where("_rank >= 1 and _rank <= _n")
    ranks = ranks.select(*group, "_b", "part", "n", "_rank")
    found = ranks.select(*named, F.col("_b").alias("_of")).distinct()
    inside = ranged.join(found, on & (F.col("_b") == F.col("_of")), "left_semi")
    exact = inside.groupBy(*group, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    until = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = exact.withColumn("_until", F.sum("_n").over(until))
    other = ranks.select(*named, F.col("_b").alias("_of"), "part", "n", "_rank")
    hit = (F.col("_until") >= F.col("_rank")) & (F.col("_until") - F.col("_n") < F.col("_rank"))
    return exact.join(other, on & (F.col("_b") == F.col("_of")) & hit).select(*group, "part", F.col("_v").alias(value), "n")


def fast_furious_deciles(model: Model) -> DataFrame:
    """The deciles of the scores of each program's students, and how many have a score.

    The distribution that the question asks for, beside the list of `fast_furious`.
    """
    found = grouped_quantiles(fast_furious(model), ["program_code", "program"], "score", 10, DECILES)
    return found.select("program_code", "program", F.col("part").alias("decile"), "score", F.col("n").alias("n_students"))


class Leaders:
    """The students of one program that are among the first `k` for any position of the slider.

    A score is a line over the weight; what is kept are the upper k lines at each
    position, 101 * k at most, so nothing grows with the number of students.
    """

    def __init__(self, k: int, kind: np.dtype):
        self.k = k
        self.weight = np.arange(POSITIONS + 1) / POSITIONS
        self.least = np.full(POSITIONS + 1, -np.inf)
        self.student, self.grade, self.speed = np.zeros(0, dtype=kind), np.zeros(0), np.zeros(0)

    def add(self, student: np.ndarray, grade: np.ndarray, speed: np.ndarray) -> None:
        # Most students are below the k-th line at every position.
        scores = grade[:, None] * self.weight + speed[:, None] * (1.0 - self.weight)
        near = (scores >= self.least).any(axis=1)
        if not near.any():
            return
        student, grade, speed = (np.concatenate(x) for x in ((self.student, student[near]), (self.grade, grade[near]), (self.speed, speed[near])))
        order = np.argsort(student, kind="stable")  # equal scores by student
        student, grade, speed = student[order], grade[order], speed[order]
        scores = grade[:, None] * self.weight + speed[:, None] * (1.0 - self.weight)
        first = np.argsort(-scores, axis=0, kind="stable")[: self.k]
        if len(student) >= self.k:
            self.least = scores[first[-1], np.arange(POSITIONS + 1)]
        kept = np.unique(first)
        self.student, self.grade, self.speed = student[kept], grade[kept], speed[kept]


def _leaders(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The leaders of every program among the rows of a task."""
    programs: dict[tuple, Leaders] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("program_code", "program")), strict=True))
        numbers = {key: n for n, key in enumerate(dict.fromkeys(keys))}
        of = np.fromiter((numbers[key] for key in keys), dtype=np.int64, count=len(keys))
        student, grade, speed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("student_id", "grade", "speed"))
        for key, n in numbers.items():
            rows = np.flatnonzero(of == n)
            for at in range(0, len(rows), 8192):
                part = rows[at : at + 8192]
                programs.setdefault(key, Leaders(k, student.dtype)).add(student[part], grade[part], speed[part])
    for (code, program), found in programs.items():
        n = len(found.student)
        columns = [[code] * n, [program] * n, found.student, found.grade, found.speed]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _score() -> Column:
    weight = F.col("weight")
    return weight * F.col("grade") + (F.lit(1.0) - weight) * F.col("speed")


def fast_furious_by_weight(model: Model, k: int = 3) -> DataFrame:
    """The first `k` students of each program for every position of the weight slider.

    One pass for all 101 positions: a task keeps the students that lead somewhere and
    sends each once; the positions are laid out after the shuffle by program, for those
    alone. Equal scores are ranked by student; students without a score or an id have
    no rank.
    """
    lines = fast_furious(model).select(
        "program_code",
        "program",
        "student_id",
        F.col("avg_grade_norm").alias("grade"),
        ((F.lit(1.0) - F.col("diff_day_norm")) * F.col("n_exams_norm")).alias("speed"),
    )
    lines = lines.dropna(subset=["student_id", "grade", "speed"])
    leading = lines.mapInArrow(lambda batches: _leaders(batches, k), lines.schema).repartition("program_code")
    position = F.explode(F.sequence(F.lit(0), F.lit(POSITIONS)))
    placed = leading.select("*", position.alias("_p")).withColumn("weight", F.col("_p").cast("double") / POSITIONS)
    ranked = Window.partitionBy("program_code", "program", "weight").orderBy(F.desc("score"), "student_id")
    return (
        placed.withColumn("score", _score())
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("program_code", "program", "weight", "rank", "student_id", "score")
    )
