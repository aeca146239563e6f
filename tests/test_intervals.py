import datetime as dt
import random

from pyspark.sql import functions as F

from quern.operators import intervals as I


def brute(rows):
    out = set()
    for key in {r[0] for r in rows}:
        units = sorted({u for k, a, b in rows if k == key and a is not None and b is not None for u in range(a, b + 1)})
        runs = []
        for u in units:
            if runs and runs[-1][1] == u - 1:
                runs[-1][1] = u
            else:
                runs.append([u, u])
        out |= {(key, "period", a, b) for a, b in runs}
        out |= {(key, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])}
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), (a := rng.randrange(100, 900)), a + rng.choice([-3, 0, 1, 5, 59, 60, 61, 200])) for _ in range(120)] + [(9, None, 5), (9, 5, None), (10, 60, 119), (10, 120, 179)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    got = {tuple(r) for r in I.periods_and_gaps(I.run_bitmaps(df, "id", "a", "b"), "id").collect()}
    assert got == brute(rows)
    assert (10, "period", 60, 179) in got
    assert I.periods_and_gaps(I.run_bitmaps(df.where(F.lit(False)), "id", "a", "b"), "id").count() == 0


def test_long_intervals_stay_few_words(spark):
    years = 10 * 365 * 86_400
    rows = [(1, 5, years), (1, 0, 130), (1, years + 1, years + 60), (1, years + 70, 2 * years), (2, -200, 200), (2, 700, 10_000), (2, 50, 4_000)]
    df = spark.createDataFrame(rows, "id int, a long, b long")
    words = I.run_bitmaps(df, "id", "a", "b")
    assert words.count() <= 3 * len(rows)
    got = {tuple(r) for r in I.periods_and_gaps(words, "id").collect()}
    assert got == {(1, "period", 0, years + 60), (1, "gap", years + 61, years + 69), (1, "period", years + 70, 2 * years), (2, "period", -200, 10_000)}


def test_employment(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, 1, 1, "Jan 2019", "Mar 2019", False, t), (2, 1, 2, "2019-05", "2019-06", False, t), (3, 1, 2, "2019-04", "2019-06", False, t), (4, 1, 3, "2020", "Present", None, None),
        (5, 2, 1, "2020", "soon", True, t), (6, 2, 2, "2010", "soon", False, t), (7, 3, 1, None, "2010", True, t), (8, 4, 1, "2012-05", "2012-04", True, t),
    ]
    e = spark.createDataFrame(rows, "row_id long, doc_id long, pos int, start_date string, end_date string, is_current boolean, received_at timestamp")
    c = spark.createDataFrame([], "doc_id long, locale string, time_zone string, received_at timestamp")
    got = {tuple(r) for r in I.employment_periods(e, c).collect()}
    assert got == {(1, "period", "2019-01", "2019-06"), (1, "gap", "2019-07", "2020-05"), (1, "period", "2020-06", "2026-08"), (2, "period", "2020-06", "2026-08")}
