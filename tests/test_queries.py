import pytest

from tests.oracle import DATA, same
from tidemark.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


def test_entry_imports_without_optional_parts(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_drop_moments_are_spaced_and_greedy(spark):
    from tidemark.operators import scoring

    seconds = [("r", t, 1.0 if t in (20, 21, 60) else 0.1 if t < 100 else 0.0) for t in range(120)]
    out = [(r.t, r.window_loss) for r in scoring.drop_moments(spark.createDataFrame(seconds, "run_id string, t int, excess_loss double")).orderBy("t").collect()]
    sums = {t: round(sum(s[2] for s in seconds[t : t + 10]), 6) for t in range(111)}
    left, want = sorted(((-v, -t) for t, v in sums.items() if v > 0)), []
    for v, t in left:
        if len(want) < 8 and all(abs(-t - x[0]) >= 15 for x in want):
            want.append((-t, -v))
    assert out == sorted(want)


def test_paragraphs_match_a_loop(spark):
    from tidemark.operators.passes import paragraphs

    words = [(30, "."), (50, "."), (30, "."), (150, ""), (90, "."), (20, ""), (99, ""), (5, ".")]
    rows = [("r", i, " ".join(["w"] * n) + end) for i, (n, end) in enumerate(words)]
    got = [(r.first, r.last, r.n_words) for r in paragraphs(spark.createDataFrame(rows, "run_id string, seg_idx int, text string")).orderBy("paragraph").collect()]
    want, cur, n = [], [], 0
    for i, (k, end) in enumerate(words):
        if cur and n + k > 200 and n >= 50:
            want.append((cur[0], cur[-1], n))
            cur, n = [], 0
        cur.append(i)
        n += k
        if n >= 100 and end:
            want.append((cur[0], cur[-1], n))
            cur, n = [], 0
    want += [(cur[0], cur[-1], n)] if cur else []
    assert got == want
