from datetime import datetime, timedelta

from cohortspark.operators import staging as S
from cohortspark.sources.schemas import MOVEMENTS_SCHEMA, READINGS_SCHEMA, UNITS_SCHEMA

E = datetime(2024, 1, 10, 8, 30, 0)
US = timedelta(microseconds=1)


def _frames(spark):
    moves = spark.createDataFrame(
        [
            ("1", 1, 100, E, E + timedelta(days=2)),
            ("1", 1, 100, E + timedelta(hours=12), E + timedelta(days=2)),  # overlaps the first
            ("2", 9, 200, E, E + timedelta(days=2)),  # not an ICU unit
        ],
        MOVEMENTS_SCHEMA,
    )
    units = spark.createDataFrame([(1,), (2,)], UNITS_SCHEMA)
    reads = spark.createDataFrame(
        [
            (1, 10102, E, 80.0, ""),  # at entry exactly
            (1, 10102, E + timedelta(days=1), 81.0, ""),  # entry + 1 day exactly
            (1, 10102, E - US, 82.0, ""),  # 1 µs before
            (1, 10102, E + timedelta(days=1, hours=12) + US, 83.0, ""),  # 1 µs after the second window
            (1, 10120, E + timedelta(hours=13), 20.0, "x"),  # inside both windows, cancelled
            (1, 10120, E + timedelta(hours=14), 21.0, None),  # null cancel mark
            (2, 10102, E + timedelta(hours=1), 70.0, ""),  # stay not in ICU
        ],
        READINGS_SCHEMA,
    )
    return moves, units, reads


def test_interval_join_bounds_and_overlap(spark):
    moves, units, reads = _frames(spark)
    icu = S.icu_movements(moves, units)
    assert icu.count() == 2
    staged = S.window_readings(reads, icu, timedelta(days=1)).collect()
    got = sorted((r.dt_deb.isoformat(), r.value_numeric) for r in staged)
    # 80 (first window), 81 (both windows: ends of first, inside second), 20 and 21 in both windows
    assert got == sorted(
        [("2024-01-10", 80.0), ("2024-01-10", 81.0), ("2024-01-10", 81.0), ("2024-01-10", 20.0),
         ("2024-01-10", 20.0), ("2024-01-10", 21.0), ("2024-01-10", 21.0)]
    )
    assert all(isinstance(r.id_nda, str) for r in staged)


def test_window_spanning_days_matches_brute_force(spark):
    import random

    rnd = random.Random(7)
    base = datetime(2024, 3, 1)
    moves = [(str(s), 1, s, base + timedelta(minutes=rnd.randrange(0, 5 * 1440)), base) for s in range(5) for _ in range(3)]
    reads = [(s, 10102, base + timedelta(minutes=rnd.randrange(0, 9 * 1440)), 1.0, "") for s in range(5) for _ in range(60)]
    mdf = spark.createDataFrame(moves, MOVEMENTS_SCHEMA)
    rdf = spark.createDataFrame(reads, READINGS_SCHEMA)
    for days in (1, 3):
        w = timedelta(days=days)
        got = S.window_readings(rdf, mdf, w).count()
        want = sum(1 for m in moves for r in reads if str(r[0]) == m[0] and m[3] <= r[2] <= m[3] + w)
        assert got == want


def test_useful_readings_semi_join(spark):
    moves, units, reads = _frames(spark)
    staged = S.window_readings(reads, S.icu_movements(moves, units), timedelta(days=1))
    cohort = spark.createDataFrame([("1", datetime(2024, 1, 10).date())], "id_nda string, j1 date")
    useful = S.useful_readings(staged, cohort)
    assert sorted(r.value_numeric for r in useful.collect()) == [80.0, 81.0, 81.0]
