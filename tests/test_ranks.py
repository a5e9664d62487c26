"""Places, ranks and order statistics without one task for all rows, and the bootstrap by vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators.ranks import placed


def test_places_with_groups_ties_and_nulls(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", None, "c"]), r.choice([None, 1, 2, 2, 2, 9]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = placed(df, [F.col("v"), F.col("i")], ["g"]).collect()
    want = {}
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want |= {x[2]: k for k, x in enumerate(own)}
    assert {x.i: x.pos for x in got} == want and len(got) == 500
    tied = placed(spark.range(100).select(F.lit(1).alias("v")), [F.col("v")])
    assert sorted(x.pos for x in tied.collect()) == list(range(100))
    assert placed(df.where("false"), [F.col("v")]).count() == 0
    assert {x.pos for x in E.positions(spark.createDataFrame([(1, None), (2, 5)], "id int, p int"), ["p"]).collect()} == {0, 1}


@pytest.mark.parametrize("small", [3, 40, 10_000])
def test_order_statistics(spark, small):
    r = random.Random(small)
    values = [r.choice([r.gauss(0, 1), 10.0 ** r.randint(-300, 300), -5.0, -5.0, -5.0, float("inf"), float("-inf")]) for _ in range(600)] + [float("nan")] * 3
    df = spark.createDataFrame([(v,) for v in values + [None]], "v double").repartition(5)
    ranks = [0, 1, 150, 299, 300, 450, 599, 600, 602]
    want = sorted(values, key=lambda v: (v != v, v if v == v else 0))
    assert np.array_equal(E.order_statistics(df, "v", ranks, small), [want[k] for k in ranks], equal_nan=True)


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    assert E.quantiles(df, "v", [0.0, 0.5, 1.0, 0.1]).first()[0] == pytest.approx([1, 2.5, 4, 1.3])
    assert E.quantiles(df.where("false"), "v", [0.5]).first()[0] is None


def test_average_ranks(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 1.0), (5, 7.0)], "id int, v double")
    assert {x.id: x.r for x in E.average_ranks(rows, "v", "r").collect()} == {1: 2.5, 2: 2.5, 3: None, 4: 1.0, 5: 4.0}


def test_bootstrap_by_vectors_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(E, "ROUNDS", 7)
    r, rounds, base = random.Random(3), 20, 0.4
    rows = [(i, int(r.random() < 0.4), round(r.random(), 1), r.choice([0.5, 0.5, 0.2, 0.9])) for i in range(200)]
    got = E.bootstrap_vectors(spark.createDataFrame(rows, "i long, y int, p_base double, p_cand double").repartition(6), rounds, base_rate=base).first()
    weights = np.array([E.row_weights(i, np.arange(rounds, dtype=np.uint64), 42) for i, *_ in rows])
    y, changes = np.array([x[1] for x in rows]), []
    for w in weights.T:
        one = []
        for p in (np.array([x[k] for x in rows]) for k in (2, 3)):
            pos, neg = w * y, w * (1 - y)
            won = sum(a * (neg[p < q].sum() + 0.5 * neg[p == q].sum()) for a, q in zip(pos, p))
            one.append((won / (pos.sum() * neg.sum()), -(w * (p - y) ** 2).sum() / w.sum(), 1 - (w * (p - y) ** 2).sum() / (w * (base - y) ** 2).sum()))
        changes.append(np.subtract(one[1], one[0]))
    for k, name in enumerate(("auc", "brier", "skill")):
        own = [c[k] for c in changes]
        assert [got[f"d_{name}"], got[f"{name}_low"], got[f"{name}_high"]] == pytest.approx([np.mean(own), *np.percentile(own, [2.5, 97.5])])
    assert abs(weights.mean() - 1) < 0.05 and abs(weights.var() - 1) < 0.1


def test_one_score_over_many_ranges(spark):
    rows = spark.range(3000).select(F.col("id").alias("i"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(0.5).alias("p_base"), (F.col("id") % 3 == 0).cast("double").alias("p_cand"))
    got = E.bootstrap_vectors(rows, 5).first()
    assert got.d_auc == pytest.approx(0.5) and got.rounds == 5


def test_unscored_rows_are_refused(spark):
    for p in (None, float("nan")):
        scored = spark.createDataFrame([(1, 0.5), (0, p), (1, 0.2)], "y int, p double")
        with pytest.raises(ValueError, match="1 rows"):
            E.auc(scored)
        with pytest.raises(ValueError, match="1 rows"):
            E.bootstrap_vectors(scored.select(F.monotonically_increasing_id().alias("i"), "y", F.col("p").alias("p_base"), F.lit(0.1).alias("p_cand")), 3)
