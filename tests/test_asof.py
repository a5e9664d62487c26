"""The as-of join against a plain one, over many ranges."""

import random

import pytest

from tidemark.operators.asof import asof_join


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_is_the_plain_one(spark, direction, strict):
    r = random.Random(7)
    group = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, group(), r.choice([None, *range(-5, 60)])) for i in range(400)]
    right = [(group(), r.choice([None, *range(3, 50)]), r.randint(0, 9), r.choice([None, "x", "y"])) for _ in range(120)]
    a = spark.createDataFrame(left, "id int, g string, t int").repartition(3)
    b = spark.createDataFrame(right, "g string, t int, v int, w string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as there are shuffle partitions
    try:
        got = {x.id: (x.v, x.w, x.matched_t) for x in asof_join(a, b, "t", ["g"], direction, strict).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back, rank = direction == "backward", lambda x: (x[2], x[3] is not None, x[3] or "")
    for i, g, t in left:
        fits = [x for x in right if None not in (g, t, x[0], x[1]) and x[0] == g and ((x[1] < t if strict else x[1] <= t) if back else (x[1] > t if strict else x[1] >= t))]
        best = (max if back else min)(fits, key=lambda x: (x[1], rank(x)), default=None)
        assert got[i] == ((best[2], best[3], best[1]) if best else (None, None, None)), (i, g, t)
    assert len(got) == 400


def test_asof_without_groups_and_with_empty_sides(spark):
    a, b = spark.createDataFrame([(1, 5), (1, 5), (2, 0)], "id int, t int"), spark.createDataFrame([(3, "x")], "t int, v string")
    assert sorted((x.id, x.v) for x in asof_join(a, b, "t").select("id", "v").collect() if x.v) == [(1, "x"), (1, "x")]
    assert asof_join(a, b.where("false"), "t").where("v is null").count() == 3 and asof_join(a.where("false"), b, "t").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof_join(a, b.withColumnRenamed("v", "id"), "t")
