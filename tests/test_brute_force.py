"""Random enrolments: both models against plain Python written from the questions."""

import random
from collections import Counter, defaultdict

import pytest

from examlens.operators import activity, attempts, commitment, distribution, grades, merit, pass_rate
from mini import Row, day, dmy, dmy2, got, label, star_of, wide_of


def random_rows(seed, hot=False):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        program = "P0" if hot and rng.random() < 0.34 else f"P{rng.randrange(6)}"
        exam = f"e{rng.randrange(14):02}"
        student = 1 if hot and rng.random() < 0.34 else rng.randrange(40)
        date = day(rng.randrange(1, 30) * 23 % 1000, 2015)
        passed = int(rng.random() < 0.7)
        grade = rng.randint(18, 30) if rng.random() < (0.85 if passed else 0.05) else None
        if passed and grade and student % 4 == 0:
            grade = rng.randint(27, 30)
        rows.append(Row(program, exam, date, student, passed, grade))
    return rows


def group(rows, key):
    groups = defaultdict(list)
    for row in rows:
        groups[key(row)].append(row)
    return groups


def mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def rates(rows):
    return {
        key: (len(g), sum(r.passed for r in g), sum(r.passed for r in g) * 100.0 / len(g))
        for key, g in group(rows, lambda r: (r.program, r.exam, r.day.year)).items()
    }


def hardest(rows):
    table, chosen = rates(rows), set()
    for program in {r.program for r in rows}:
        mine = sorted((k[2], v[2], k[1]) for k, v in table.items() if k[0] == program)
        chosen |= {(program, exam) for _, _, exam in mine[:10]}
    return sorted(k for k in table if k[:2] in chosen)


def commitments(rows):
    loads = {k: len({r.exam for r in g}) for k, g in group(rows, lambda r: (r.program, r.day)).items()}
    found = []
    for program in {p for p, _ in loads}:
        counts = [n for (p, _), n in loads.items() if p == program]
        shared = sum(n for n in counts if n > 1) or None
        found.append((label(program), shared, sum(counts), shared / sum(counts) if shared else None))
    return sorted(found, key=repr)


def exam_means(rows):
    graded = [r for r in rows if r.passed == 1 and r.grade is not None]
    return {k: mean(r.grade for r in g) for k, g in group(graded, lambda r: (r.program, r.exam)).items()}


def top_three(rows, sign):
    found = []
    for program in {r.program for r in rows}:
        mine = sorted((sign * m, k[1]) for k, m in exam_means(rows).items() if k[0] == program)
        found += [(program, exam, sign * m) for m, exam in mine[:3]]
    return sorted(found, key=repr)


def profiles(rows, ungraded):
    pairs = group(rows, lambda r: (r.program, r.student))
    counts = sorted(len(g) for g in pairs.values())
    threshold = counts[(len(counts) - 1) // 2]
    found = {}
    for key, g in pairs.items():
        if len(g) >= threshold:
            average = mean(r.grade for r in g)
            days = float((max(r.day for r in g) - min(r.day for r in g)).days)
            found[key] = (ungraded if average is None else average, len(g), days)
    return found


def scores(rows, ungraded, weight):
    table = profiles(rows, ungraded)
    most = [max(v[i] for v in table.values() if v[i] is not None) for i in range(3)]
    found = {}
    for key, (average, n, days) in table.items():
        if average is None:
            found[key] = None
        else:
            speed = (1.0 - days / most[2]) * (n / most[1])
            found[key] = weight * (average / most[0]) + (1.0 - weight) * speed
    return found


def mean_failures(rows):
    failed = [r for r in rows if r.passed == 0]
    per_student = Counter((r.exam, r.program, r.student) for r in failed)
    found = []
    for exam in {k[0] for k in per_student}:
        mine = {k: n for k, n in per_student.items() if k[0] == exam}
        found.append((exam, label(min(k[1] for k in mine)), sum(mine.values()) / len(mine)))
    return found


def bands(rows):
    found = defaultdict(lambda: [0, 0, 0])
    for (program, _), g in group(rows, lambda r: (r.program, r.student)).items():
        average = mean(r.grade for r in g)
        if average is not None and average >= 27:
            found[program][min(int(average) - 27, 2)] += 1
    return found


@pytest.mark.parametrize("seed, hot", [(1, False), (2, True)])
@pytest.mark.parametrize("layout", ["star", "wide"])
def test_all_operators(spark, seed, hot, layout):
    rows = random_rows(seed, hot)
    star = layout == "star"
    model = star_of(spark, rows) if star else wide_of(spark, rows)
    ungraded = 0.0 if star else None

    def short(year):
        return str(year) if star else f"{year % 100:02}"

    text = dmy if star else dmy2
    per_date = Counter((r.program, str(r.day.year), text(r.day), r.day) for r in rows)
    assert got(
        distribution.session_enrolments(model), "program_code", "year", "session_date", "date", "n"
    ) == sorted([(*k, n) for k, n in per_date.items()], key=repr)

    assert got(
        pass_rate.exam_pass_rate(model), "program_code", "exam_code", "year", "n_enrolled", "n_passed", "ratio"
    ) == sorted([(k[0], k[1], short(k[2]), *v) for k, v in rates(rows).items()], key=repr)
    assert got(pass_rate.hardest_exams(model), "program_code", "exam_code", "year") == [
        (p, e, short(y)) for p, e, y in hardest(rows)
    ]

    assert got(
        commitment.commitment_rate(model), "program", "sum_commit", "sum_all", "commit_rate"
    ) == commitments(rows)
    loads = group(rows, lambda r: (label(r.program), text(r.day)))
    assert got(commitment.same_day_load(model), "program", "session_date", "n_exams") == sorted(
        [(*k, len({r.exam for r in g})) for k, g in loads.items()], key=repr
    )

    exam_columns = ("program_code", "exam_code", "mean_grade")
    means = exam_means(rows)
    if not star:  # exams passed without any grade have no mean there
        means |= {k: None for k in {(r.program, r.exam) for r in rows if r.passed} - set(means)}
    assert got(grades.exam_mean_grade(model), *exam_columns) == sorted([(*k, m) for k, m in means.items()], key=repr)
    assert got(grades.best_exams(model), *exam_columns) == top_three(rows, -1)
    assert got(grades.worst_exams(model), *exam_columns) == top_three(rows, 1)

    assert got(
        activity.activity_profile(model), "program_code", "student_id", "avg_grade", "n_exams", "diff_day"
    ) == sorted([(*k, *v) for k, v in profiles(rows, ungraded).items()], key=repr)
    assert got(activity.active_students(model), "program_code", "student_id") == sorted(
        profiles(rows, ungraded), key=repr
    )
    for weight in (0.5, 0.3):
        scored = activity.weighted_fast_furious(model, weight)
        found = {(p, s): v for p, s, v in got(scored, "program_code", "student_id", "score")}
        assert found == scores(rows, ungraded, weight)

    ranked = sorted(mean_failures(rows), key=lambda x: (-x[2], x[0]))
    assert got(attempts.mean_attempts(model), "exam_code", "program", "attempts") == sorted(ranked, key=repr)
    assert got(attempts.trial_and_error(model), "exam_code", "program", "attempts", sort=False) == ranked[:3]

    assert got(merit.band_counts(model), "program_code", "n27", "n28", "n29") == sorted(
        [(p, *n) for p, n in bands(rows).items()], key=repr
    )
    assert got(merit.merit_credits_full(model), "program_code", "credits") == sorted(
        [(p, a * 125 + b * 250 + c * 500) for p, (a, b, c) in bands(rows).items()], key=repr
    )
