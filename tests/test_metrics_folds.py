import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.operators import folds as FO
from cohortspark.operators import metrics as M
from cohortspark.operators.ordering import positions, prefix_sums


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    if not pos or not neg:
        return None
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("case", ["random", "ties", "all_tied", "one_class", "perfect"])
def test_auc_against_pairs(spark, case):
    rnd = random.Random(3)
    n = 300
    if case == "random":
        data = [(rnd.random(), rnd.random() < 0.3) for _ in range(n)]
    elif case == "ties":
        data = [(float(rnd.randrange(5)), rnd.random() < 0.4) for _ in range(n)]
    elif case == "all_tied":
        data = [(0.5, i % 3 == 0) for i in range(n)]
    elif case == "one_class":
        data = [(rnd.random(), True) for _ in range(n)]
    else:
        data = [(float(i), i >= 200) for i in range(n)]
    df = spark.createDataFrame(data, "score double, y boolean")
    got = M.roc_auc(df, "score", "y").first().auc
    want = brute_auc([d[0] for d in data], [d[1] for d in data])
    if want is None:
        assert got is None
    else:
        assert got == pytest.approx(want, abs=1e-12)


def test_roc_points_against_brute_force(spark):
    rnd = random.Random(5)
    data = [(float(rnd.randrange(20)), rnd.random() < 0.5) for _ in range(200)]
    df = spark.createDataFrame(data, "score double, y boolean")
    pts = {r.threshold: (r.fpr, r.tpr) for r in M.roc_points(df, "score", "y").collect()}
    P = sum(y for _, y in data)
    N = len(data) - P
    for t, (fpr, tpr) in pts.items():
        assert tpr == pytest.approx(sum(1 for s, y in data if y and s >= t) / P)
        assert fpr == pytest.approx(sum(1 for s, y in data if not y and s >= t) / N)


def test_positions_and_prefix_sums_match_windows(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randrange(3), rnd.randrange(100)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, g int, v int")
    got = {r.id: r.pos for r in positions(df, ["id"], ["g"], num_partitions=7).collect()}
    want = {
        r.id: r.p
        for r in df.select("id", (F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1).alias("p")).collect()
    }
    assert got == want
    ps = {r.id: r.v_before for r in prefix_sums(df, ["id"], ["v"], num_partitions=5).collect()}
    acc, exp = 0, {}
    for i, _, v in sorted(rows):
        exp[i] = acc
        acc += v
    assert ps == exp


def test_stratified_folds_balanced_and_contiguous(spark):
    rows = [(i, i % 4 == 0) for i in range(103)]
    df = spark.createDataFrame(rows, "id long, y boolean")
    f = FO.stratified_folds(df, "y", ["id"], 5).collect()
    assert len(f) == 103
    for cls in (True, False):
        members = sorted((r.id, r.fold) for r in f if r.y == cls)
        sizes = np.bincount([fo for _, fo in members], minlength=5)
        assert sizes.max() - sizes.min() <= 1
        assert list(sizes) == sorted(sizes, reverse=True)  # first n mod k folds take the extra row
        folds_in_order = [fo for _, fo in members]
        assert folds_in_order == sorted(folds_in_order)  # contiguous blocks


def test_stratified_split_repeatable(spark):
    df = spark.createDataFrame([(i, i % 5 == 0) for i in range(300)], "id long, y boolean")
    a = {r.id: r.is_valid for r in FO.stratified_split(df, "y", "id").collect()}
    b = {r.id: r.is_valid for r in FO.stratified_split(df, "y", "id").collect()}
    assert a == b
    assert sum(a.values()) == 100


@pytest.fixture(scope="module")
def million(spark):
    """A million rows with a further column, on which range boundaries are sampled."""
    h = F.xxhash64("id")
    return spark.range(1_000_000).select(
        "id", (F.pmod(h, F.lit(7)) == 0).alias("y"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("note"), (F.pmod(h, F.lit(100_003)) / 100_003.0).alias("score")
    )


def test_positions_at_size_with_extra_columns(million):
    got = positions(million, ["id"], ["y"], num_partitions=8)
    want = million.select("id", (F.row_number().over(Window.partitionBy("y").orderBy("id")) - 1).alias("p"))
    both = got.join(want, "id")
    assert got.count() == 1_000_000
    assert both.where("pos != p or note is null").count() == 0


def test_folds_at_size_with_extra_columns(million):
    sizes = FO.stratified_folds(million, "y", ["id"], 5).groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in sizes) == 1_000_000
    assert {r.fold for r in sizes} == set(range(5))
    for y in (True, False):
        of = [r["count"] for r in sizes if r.y == y]
        assert max(of) - min(of) <= 1


def test_auc_at_size_equals_rank_formula(million):
    got = M.accuracy_auc(million.withColumn("p", F.col("score") > 0.5), "p", "score", "y").first()
    pdf = million.select("score", "y").toPandas()
    ranks, y = pdf["score"].rank().to_numpy(), pdf["y"].to_numpy()
    pos, neg = int(y.sum()), int((~y).sum())
    want = (ranks[y].sum() - pos * (pos + 1) / 2) / (pos * neg)
    assert got.n == 1_000_000
    assert got.auc == pytest.approx(want, abs=1e-9)


def test_null_groups_are_a_group(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(100)], "id long, g int")
    got = positions(df, ["id"], ["g"], num_partitions=3).collect()
    assert sorted(r.pos for r in got if r.g is None) == list(range(50))


def test_form_folds_on_larger_data(spark):
    from cohortspark.plans import registry

    train, valid = registry._form_dataset(spark, "/root/testdata/sf0.1")
    sizes = train.unionByName(valid).groupBy("dead", "fold").count().collect()
    assert {r.fold for r in sizes} == set(range(registry.K_SPLIT))
    for dead in (True, False):
        of = [r["count"] for r in sizes if r.dead == dead]
        assert max(of) - min(of) <= 1
