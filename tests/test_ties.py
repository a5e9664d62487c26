"""Means that are equal tie, in whatever order their rows come."""

from tidemark.operators import grading


def test_equal_agreement_is_the_same_number(spark):
    same = [(k, i, "even", "x" if k < 2 else "y") for k in range(3) for i in range(150)]
    halves = [(k, i, "halves", "x" if i % 2 else str(k)) for k in range(3) for i in range(150)]
    got = grading.modal_agreement(spark.createDataFrame(same + halves, "run int, id int, field string, answer string").coalesce(1)).collect()
    assert {r.field: r.agreement for r in got} == {"even": 2 / 3, "halves": 2 / 3}
    assert {r.field: r.unanimous for r in got} == {"even": 0.0, "halves": 0.5}
