"""Registered queries do the whole job: against plain Python on small fixtures."""

import datetime as dt
import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans.queries import QUERIES


def test_price_unpivot_keeps_every_supplier(spark, tmp_path):
    rows = [(s, dt.datetime(2024, 1, 1 + i % 3), 10.0 * s + i, float(i % 5)) for i, s in enumerate([1, 2, 3, 4, 7, 11, 250] * 4)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = defaultdict(list)
    for s, day, price, n in rows:
        want[day.date(), f"t{s}"].append((price, n))
    got = {(r.date, r.ticker): (r.close, r.volume) for r in QUERIES["price_unpivot_all"](spark, str(tmp_path)).collect()}
    assert got == {k: (round(sum(x for x, _ in v) / len(v), 6), sum(n for _, n in v)) for k, v in want.items()}


def test_textprep_reads_to_the_cap_and_carries_back(spark, tmp_path):
    body, lost = "word " * 400, "licensed under the MIT License."
    texts = [body * 2, body * 34 + "end", body * 36, body + lost, body + "licensed under other terms", "short " + lost]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [texts[0], texts[1], texts[2][:70_000], body.strip() + "\n\n" + lost, body, texts[5]]
    got = QUERIES["textprep_full"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.prepared_sha256 for r in got] == [hashlib.sha256(t.strip().encode()).hexdigest() for t in want]
    assert [(r.trimmed_at_marker, r.hard_truncated, r.guidance_recovered) for r in got] == [(False, False, False)] * 2 + [(False, True, False), (True, False, True), (True, False, False), (False, False, False)]


def test_learning_queries_use_all_features_and_the_defaults(spark, monkeypatch):
    from tidemark.operators import features, ml

    seen = {}
    scored = spark.createDataFrame([("x", "a", 1.0, 0.5), ("x", "b", 0.0, 0.25)], "feature_set string, id string, y double, p double")
    monkeypatch.setattr(ml, "run_ablation", lambda rows, blocks, **how: seen.update(ablation=(blocks, how)) or scored)
    monkeypatch.setattr(ml, "permutation_importance", lambda rows, names, **how: seen.update(importance=(names, how)) or scored)
    for name in ("ablation", "perm_importance"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    controls, claims = list(features.control_block()), list(features.claim_block(["claim_tone"]))
    assert len(controls) == 12 and seen == {"ablation": ({"control": controls, "claim": claims}, {"kind": "gbm"}), "importance": (controls, {"kind": "gbm"})}


def test_boosted_trees_find_the_feature_that_decides(spark):
    from tidemark.operators.ml import permutation_importance

    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(i), float(i * 37 % 101 > 50), float(i * 37 % 101), float(i * 53 % 7)) for i in range(300)]
    got = permutation_importance(spark.createDataFrame(rows, "id long, date date, y double, a double, b double").withColumn("y", F.col("y").cast("int")), ["a", "b"], kind="gbm", repeats=2, rounds=3).collect()
    assert [r.feature for r in got] == ["a", "b"] and got[0].auc_drop > 0.2 and abs(got[1].auc_drop) < 0.05


def test_bootstrap_query_takes_ten_thousand_rounds(spark, tmp_path):
    docs = [(i, 100 + i * 31 % 57) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i * 5 % 3 % 2) for i in range(12)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    y, both = [i * 5 % 3 % 2 for i in range(12)], ([(n * 7919 + i) % 100 / 100 for i, n in docs], [n % 97 / 97 for _, n in docs])
    aucs, briers = [], []
    for b in range(10_000):
        at = [int(hashlib.md5(f"42|{b}|{k}".encode()).hexdigest()[:8], 16) % 12 for k in range(12)]
        pos, neg = [i for i in at if y[i]], [i for i in at if not y[i]]
        if pos and neg:
            auc = [sum((p[i] > p[j]) + (p[i] == p[j]) / 2 for i in pos for j in neg) / len(pos) / len(neg) for p in both]
            aucs.append(auc[1] - auc[0])
            briers.append(sum((both[0][i] - y[i]) ** 2 - (both[1][i] - y[i]) ** 2 for i in at) / 12)
    r = QUERIES["paired_bootstrap_10000"](spark, str(tmp_path)).first()
    want = [len(aucs), np.mean(aucs), *np.percentile(aucs, [2.5, 97.5]), np.mean([x > 1e-12 for x in aucs]), np.mean(briers), *np.percentile(briers, [2.5, 97.5])]
    assert r.rounds > 9000 and [float(x) for x in r] == pytest.approx(want, abs=2e-3)


def test_consistency_queries_take_every_document(spark, tmp_path):
    from tidemark.operators import grading

    spark.createDataFrame([(3, 100), (10, 101), (17, 250)], "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["consistency_modal_all"](spark, str(tmp_path)).count() == 4
    assert QUERIES["agreement_corr_all"](spark, str(tmp_path)).first().pearson is not None
    rows = [(k, i, "tone", "x" if k < 2 else "y") for k in range(3) for i in (1, 2) if (k, i) != (2, 2)]
    got = grading.modal_agreement(spark.createDataFrame(rows, "run int, id int, field string, answer string")).collect()
    assert [(r.field, round(r.agreement, 4)) for r in got] == [("tone", 0.6667)]
