"""Calibrated classifiers over feature blocks: fitted inside purged folds, averaged, compared by ablation and permutation.

The models of fit_and_score are fitted on bounded samples (max_rows), each in a task of its own; scores, calibration by fold and metrics cover all
rows. The model of permutation_importance is fitted on all training rows: where they are too many for a task, by sums over parts of them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluation import auc, holdout_split, positions, purged_splits
from tidemark.operators.learners import Boosted, Estimator, Isotonic, Logistic, Prepared, Sigmoid
from tidemark.operators.panel import finite
from tidemark.sources.scratch import written

#: Trees after which the scores of rows that are fitted by parts are written anew.
KEPT = 10


def _bounded(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """About `most` rows of each group at most, chosen by a hash of the id; a group that is small enough is whole."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) * F.col("__n") < F.lit(1_000_000 * most)
    return rows.join(F.broadcast(sizes), by).where(draw | (F.col("__n") <= most)).drop("__n")


def _held_out(rows: DataFrame, share: float, embargo_days: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows. The rows are written once: what follows joins them many times over."""
    rows = written(rows, "matrix")
    both = written(rows.join(holdout_split(rows.select("id", "date"), share, embargo_days).withColumnRenamed("role", "__role"), "id"), "held-out")
    return tuple(both.where(F.col("__role") == role).drop("__role") for role in ("train", "test"))


def _fitted(parts: DataFrame, sets: dict[str, list[str]], kind: str, calibration: str | None, rounds: int) -> list:
    """(feature_set, model, calibration) of each (feature_set, fold) of parts (fold, role, id, y, features), fitted in parallel."""
    one = list(sets)
    rows = parts.withColumn("feature_set", F.explode(F.array(*map(F.lit, one))))

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        name, train, test = key[0], pdf[pdf.role == "train"], pdf[pdf.role == "test"]
        x = lambda part: part[sets[name]].to_numpy(np.float64)
        model = Estimator(kind, x(train), train.y.to_numpy(np.float64), rounds)
        curve = None
        if calibration and len(test):
            curve = (Isotonic if calibration == "isotonic" else Sigmoid)(model.score(x(test)), test.y.to_numpy(np.float64))
        return pd.DataFrame([(name, int(key[1]), pickle.dumps((model, curve)))], columns=["feature_set", "fold", "model"])

    got = rows.groupBy("feature_set", "fold").applyInPandas(fit, "feature_set string, fold int, model binary").collect()  # sets x folds models
    return [(r.feature_set, *pickle.loads(r.model)) for r in sorted(got, key=lambda r: (r.feature_set, r.fold))]


def _prepared(train: DataFrame, features: list[str], n: int) -> tuple[Prepared, list[np.ndarray]]:
    """Imputation and scaling of all n rows, and each column's edges, as the learners make them: exact order statistics, of which the driver
    gets the ones that the quantiles lie between. A column's values are placed by ranges."""
    number = [finite(F.col(f"`{f}`").cast("double")) for f in features]
    held = np.array(train.agg(*[F.count(v) for v in number]).first(), np.int64)
    share = np.linspace(0, 1, Boosted.BINS + 1)[1:-1] * (n - 1)
    low = np.floor(share).astype(np.int64)
    part = share - low
    ends = np.stack([low, np.minimum(low + 1, n - 1)])
    median = np.stack([(held - 1) // 2, held // 2])  # what is imputed stands between these
    # of an end, its place among the values that the column has; -1: it is imputed
    places = [np.where(ends < m[1], ends, np.where(ends < m[1] + n - h, -1, ends - (n - h))) for m, h in zip(median.T, held)]
    asked = [(j, int(r)) for j, p in enumerate(places) for r in {0, held[j] - 1, *p.ravel(), *median[:, j]} if 0 <= r < held[j]]
    values = train.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), v.alias("value")) for j, v in enumerate(number)])).alias("v")).select("v.*")
    placed = positions(values.where("value is not null"), ["value"], ["j"])
    found = {(r.j, r.pos): r.value for r in placed.join(F.broadcast(train.sparkSession.createDataFrame(asked, "j int, pos long")), ["j", "pos"]).collect()} if asked else {}
    fill = np.array([(found[j, a] + found[j, b]) / 2 if h else 0.0 for j, (a, b, h) in enumerate(zip(*median.tolist(), held))])

    filled = [F.coalesce(v, F.lit(float(x))) for v, x in zip(number, fill)]
    mean = np.array(train.agg(*[F.avg(v) for v in filled]).first())
    deviation = np.sqrt(np.array(train.agg(*[F.avg((v - F.lit(float(x))) ** 2) for v, x in zip(filled, mean)]).first()))
    alike = np.array([not h or found[j, 0] == found[j, h - 1] for j, h in enumerate(held.tolist())])
    prepared = Prepared.over(fill, mean, np.where(alike, 0.0, deviation))

    edges = []
    for j, at in enumerate(places):
        a, b = np.array([[found.get((j, r), fill[j]) for r in row] for row in at.tolist()])
        a, b = ((v - prepared.mean[j]) / prepared.scale[j] for v in (a, b))
        edges.append(np.unique(np.where(part < 0.5, a + (b - a) * part, b - (b - a) * (1 - part))))
    return prepared, edges


def _fitted_by_parts(train: DataFrame, features: list[str], kind: str, rounds: int, n: int) -> Estimator:
    """The estimator of all n rows, however many. Tasks hand the driver sums, of one size each; none holds more of the rows than a batch. Sums of
    trees are of whole numbers, so the parts do not matter. Rows keep their bins and their score under the trees so far, which are written
    anew every KEPT trees."""
    prepared, edges = _prepared(train, features, n)

    def added(parts):
        return sum(np.frombuffer(r.sums) for r in parts.collect())

    def to_y(pdf):
        return pdf.y.to_numpy(np.float64)

    if kind == "logistic":

        def newton(w):
            def total(batches):
                sums = [Logistic.sums(w, prepared(pdf[features].to_numpy(np.float64)), to_y(pdf)) for pdf in batches if len(pdf)]
                if sums:
                    yield pd.DataFrame({"sums": [np.concatenate([sum(x).ravel() for x in zip(*sums)]).tobytes()]})

            got = added(train.select("y", *features).mapInPandas(total, "sums binary"))
            return got[: len(w) ** 2].reshape(len(w), -1), got[len(w) ** 2 :]

        return Estimator.over(prepared, Logistic.over(len(features), newton, rounds))

    schema = "codes binary, y binary, f binary"  # of a batch of rows: bins by column, outcomes, scores
    rate = train.agg(F.avg(F.col("y").cast("double"))).first()[0]
    empty = Boosted.over(edges, rate, 0, None)

    def binned(batches):
        for pdf in batches:
            if len(pdf):
                codes = empty._binned(prepared(pdf[features].to_numpy(np.float64))).T.astype(np.uint8)
                yield pd.DataFrame({"codes": [codes.tobytes()], "y": [to_y(pdf).tobytes()], "f": [np.full(len(pdf), empty.start).tobytes()]})

    def blocks(pdf, model, first):
        for codes, y, f in zip(pdf.codes, pdf.y, pdf.f):
            codes = np.frombuffer(codes, np.uint8).reshape(len(features), -1).T
            yield codes, np.frombuffer(y), model.raised(np.frombuffer(f), codes, first)

    dealt = train.select("y", *features).repartition(train.sparkSession.sparkContext.defaultParallelism)
    state, done = written(dealt.mapInPandas(binned, schema), "bins"), 0

    def summed(model, splits):
        nonlocal state, done
        first = done
        if not splits and len(model.trees) - done == KEPT:

            def raised(batches):
                for pdf in batches:
                    yield pdf.assign(f=[f.tobytes() for _, _, f in blocks(pdf, model, first)])

            state, done = written(state.mapInPandas(raised, schema), "bins"), len(model.trees)
        begin = done

        def total(batches):
            out = None
            for pdf in batches:
                for block in blocks(pdf, model, begin):
                    got = Boosted.sums(splits, *block)
                    out = got if out is None else out + got
            if out is not None:
                yield pd.DataFrame({"sums": [out.tobytes()]})

        return added(state.mapInPandas(total, "sums binary")).reshape(3, 1 << len(splits), len(features), -1)

    return Estimator.over(prepared, Boosted.over(edges, rate, min(rounds, Boosted.TREES), summed))


def fit_and_score(rows: DataFrame, sets: dict[str, list[str]], kind: str = "gbm", calibration: str = "isotonic", folds: int = 5, embargo_days: int = 10, share: float = 0.2, rounds: int = 2000, max_rows: int = 100_000) -> DataFrame:
    """(feature_set, id, y, p) of the held-out rows for each named set of features, on the same folds. In each purged fold of the
    training rows an estimator is fitted and its scores on the fold's test rows are calibrated; p is the mean of the folds'
    calibrated scores. rows: id, date, y, features. max_rows bounds the rows that a model and a calibration are fitted on."""
    train, test = _held_out(rows, share, embargo_days)
    parts = train.join(purged_splits(train.select("id", "date"), folds, embargo_days), "id")
    models = _fitted(_bounded(parts, ["fold", "role"], max_rows), sets, kind, calibration, rounds)
    if not models:
        raise ValueError("no inner fold has enough rows")
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        for pdf in batches:
            for name, features in sets.items():
                x = pdf[features].to_numpy(np.float64)
                p = [curve(model.score(x)) if curve else model.score(x) for s, model, curve in shared.value if s == name]
                yield pd.DataFrame({"feature_set": name, "id": pdf.id, "y": pdf.y, "p": np.mean(p, 0)})

    kind_of = dict(rows.dtypes)
    return test.mapInPandas(score, f"feature_set string, id {kind_of['id']}, y {kind_of['y']}, p double")


def run_ablation(rows: DataFrame, blocks: dict[str, list[str]], **how) -> DataFrame:
    """(feature_set, id, y, p) for controls, claims and both; empty sets are left out."""
    sets = {"controls_only": blocks.get("control", []), "claims_only": blocks.get("claim", []), "controls_plus_claims": blocks.get("control", []) + blocks.get("claim", [])}
    return fit_and_score(rows, {name: features for name, features in sets.items() if features}, **how)


def permutation_importance(rows: DataFrame, features: list[str], kind: str = "gbm", repeats: int = 10, top: int = 20, seed: int = 42, share: float = 0.2, embargo_days: int = 10, rounds: int = 2000, one_task: int = 100_000) -> DataFrame:
    """Drop of the held-out AUC when a feature's values are dealt anew, by hash order: mean and deviation over repeats, largest first.
    The model is fitted on all training rows, up to one_task of them in one task, more by parts; all held-out rows are dealt and scored."""
    train, test = _held_out(rows, share, embargo_days)
    n = train.count()
    if n <= one_task:
        [(_, model, _)] = _fitted(train.withColumn("fold", F.lit(0)).withColumn("role", F.lit("train")), {"all": features}, kind, None, rounds)
    else:
        model = _fitted_by_parts(train, features, kind, rounds, n)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    value = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("other")) for f in features])
    trials = test.select("id", F.explode(value).alias("v")).select("id", "v.*").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "feature", "repeat", "id"))
    dealt = positions(trials.withColumn("key", order), ["key"], ["feature", "repeat"]).select("feature", "repeat", "pos", "other")
    place = positions(test.select("id", "y", *features), ["id"])
    mixed = dealt.join(place.hint("merge"), "pos").select("feature", "repeat", "id", "y", "other", *features)  # exchanged, as the driver would hold what is broadcast
    mixed = mixed.unionByName(test.select(F.lit("").alias("feature"), F.lit(0).alias("repeat"), "id", "y", F.lit(0.0).alias("other"), *features))

    def score(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(np.float64)
            for j, f in enumerate(features):
                here = (pdf.feature == f).to_numpy()
                x[here, j] = pdf.other.to_numpy(np.float64)[here]
            yield pd.DataFrame({"feature": pdf.feature, "repeat": pdf.repeat, "y": pdf.y, "p": shared.value.score(x)})

    trialled = written(mixed.mapInPandas(score, f"feature string, repeat int, y {dict(rows.dtypes)['y']}, p double"), "trials")  # scored once; what follows reads it twice
    scored = auc(trialled, ["feature", "repeat"])
    base = scored.where("feature = ''").select(F.col("auc").alias("base"))
    drop = scored.where("feature != ''").join(F.broadcast(base)).groupBy("feature").agg(F.avg(F.col("base") - F.col("auc")).alias("auc_drop"), F.stddev_pop(F.col("base") - F.col("auc")).alias("deviation"))
    return drop.orderBy(F.desc("auc_drop"), "feature").limit(top)
