"""Plan checks: filters and column pruning reach the parquet scans."""

import __spark_entry__ as E


def _scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "FileScan parquet" in line]


def test_counter_matrix_pushdown_and_pruning(spark):
    scans = _scans(E.queries()["counter_matrix"](spark, "/root/testdata/sf0.01"))
    events = [s for s in scans if "events.parquet" in s]
    readings = [s for s in events if "Not(EqualTo(event_type,signup))" in s]
    moves = [s for s in events if "EqualTo(event_type,signup)" in s and "Not(" not in s.split("PushedFilters")[1][:40]]
    assert readings and moves
    # the count matrix never reads the reading values: pruned at the scan
    assert all("value" not in s.split("[")[1].split("]")[0] for s in readings)
    assert any("LessThan(r_regionkey,3)" in s for s in scans)


def test_form_matrix_reads_only_needed_columns(spark):
    scans = _scans(E.queries()["form_matrix"](spark, "/root/testdata/sf0.01"))
    li = [s for s in scans if "lineitem.parquet" in s]
    assert li
    for s in li:
        schema = s.split("ReadSchema: struct<")[1].split(">")[0]
        cols = {c.split(":")[0] for c in schema.split(",")}
        assert cols <= {"l_orderkey", "l_linenumber", "l_quantity"}  # 3 of the 11 columns at most


def _joins_of_readings(plan: str) -> int:
    """Joins on the range of a movement: one for each time the staged readings are made."""
    return sum("dt_insert" in line and "_entry" in line and "Join" in line for line in plan.splitlines())


def _exchanges_above_scan(plan: str, table: str) -> list[str]:
    """Lines of a plan tree between the scan of ``table`` and the first join above it that are exchanges."""
    lines = plan.splitlines()
    out = []
    for at, line in enumerate(lines):
        if "Scan parquet" not in line or table not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-*"))
        for above in reversed(lines[:at]):
            d = len(above) - len(above.lstrip(" :+-*"))
            if d < depth:
                depth = d
                if "Join" in above and "Broadcast" not in above:
                    break
                if "Exchange" in above and "Broadcast" not in above:
                    out.append(above)
                    break
                if "HashAggregate" in above:  # what is shuffled above are a few rows a case
                    break
    return out


def test_stored_readings_join_once_and_stay_in_place(spark):
    """The interval join runs once, when the staged table is written; later joins move no readings."""
    from cohortspark.operators import waves as W
    from cohortspark.plans import registry as R

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = R.plan(spark, "/root/testdata/sf0.001", "staged", "cohort")
        staging = p.staged()._jdf.queryExecution().optimizedPlan().toString()
        useful = p.stored_useful()
        plan = useful._jdf.queryExecution().executedPlan().toString()
        assert _joins_of_readings(staging) == _joins_of_readings(useful._jdf.queryExecution().optimizedPlan().toString()) == 0
        assert "SortMergeJoin" in plan and not _exchanges_above_scan(plan, "cohortspark_staged")
        p = R.plan(spark, "/root/testdata/sf0.001", "staged", "cohort", "useful")
        grid = W.resample(spark, p.wave_readings(), p.cohort(), R.VOIS, R.NB_PTS, p.hot_stays())
        assert _joins_of_readings(grid._jdf.queryExecution().optimizedPlan().toString()) == 0
        plan = grid._jdf.queryExecution().executedPlan().toString()
        assert "cohortspark_useful" in plan and not _exchanges_above_scan(plan, "cohortspark_useful")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_a_plan_can_store(spark):
    import pytest

    from cohortspark.plans import registry as R

    for store in (("stage",), ("useful",), ("useful", "cohort")):
        with pytest.raises(ValueError, match="store"):
            R.plan(spark, "/root/testdata/sf0.001", *store)
    assert R.plan(spark, "/root/testdata/sf0.001", "staged", "useful").store
