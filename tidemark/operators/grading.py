"""Grading of extracted fields against gold answers, abstention, self-consistency and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers that state nothing.
ABSTAINED = ("not_stated", "not_provided")


def values_match(kind: Column, pred: Column, gold: Column, rtol: float = 0.02) -> Column:
    """Numbers match within rtol of max(|gold|, 1), nulls only each other; other answers match when equal."""
    p, g = pred.try_cast("double"), gold.try_cast("double")
    close = F.abs(p - g) <= rtol * F.when(F.abs(g) < 1, 1.0).otherwise(F.abs(g))
    both = pred.isNull() & gold.isNull()
    return F.when(kind == "numeric", F.coalesce(both | close, F.lit(False))).otherwise(pred.eqNullSafe(gold))


def graded(pred: DataFrame, gold: DataFrame, rtol: float = 0.02) -> DataFrame:
    """Long rows (id, field, kind, pred, gold, hit) of the ids that both have. Inputs: id, field, answer (and kind in gold)."""
    both = gold.withColumnRenamed("answer", "gold").join(pred.withColumnRenamed("answer", "pred"), ["id", "field"])
    return both.withColumn("hit", values_match(F.col("kind"), F.col("pred"), F.col("gold"), rtol))


def field_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy by field, and the mean absolute error of ordinals (unreadable pairs are left out of it)."""
    gap = F.abs(F.col("pred").try_cast("double") - F.col("gold").try_cast("double"))
    return rows.groupBy("field").agg(F.avg(F.col("hit").cast("double")).alias("accuracy"), F.avg(F.when(F.col("kind") == "ordinal", gap)).alias("mae"), F.count("*").alias("n"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """Mean over a field's classes (of answers and gold) of F1, 0 where undefined; categorical and boolean fields."""
    some = rows.where(F.col("kind").isin("categorical", "boolean"))
    text = lambda c: F.coalesce(F.col(c), F.lit("None"))
    cells = some.groupBy("field", text("gold").alias("g"), text("pred").alias("p")).agg(F.count("*").alias("n"))
    roles = cells.select("field", "n", F.explode(F.array(F.struct(F.col("g").alias("class"), F.lit("g").alias("role")), F.struct(F.col("p").alias("class"), F.lit("p").alias("role")))).alias("r"), (F.col("g") == F.col("p")).alias("same"))
    per = roles.groupBy("field", F.col("r.class").alias("class")).agg(F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("tp2"), F.sum("n").alias("total"))
    return per.groupBy("field").agg(F.avg(F.col("tp2") / F.col("total")).alias("macro_f1"))


def exact_match(rows: DataFrame) -> DataFrame:
    """Share of ids whose fields all match."""
    return rows.groupBy("id").agg(F.min(F.col("hit").cast("int")).alias("all_hit")).agg(F.avg(F.col("all_hit").cast("double")).alias("exact_match"), F.count("*").alias("n"))


def abstention(rows: DataFrame) -> DataFrame:
    """By field: how often gold and prediction abstain, precision and recall of abstaining, and the rate of answers where gold has none."""
    none = lambda c: F.col(c).isNull() | F.col(c).isin(*ABSTAINED)
    r = rows.select("field", none("pred").alias("p"), none("gold").alias("g"))
    n = lambda c: F.count_if(c)
    return r.groupBy("field").agg(
        F.avg(F.col("g").cast("double")).alias("gold_abstention_rate"), F.avg(F.col("p").cast("double")).alias("pred_abstention_rate"),
        F.try_divide(n(F.col("p") & F.col("g")).cast("double"), n(F.col("p")).cast("double")).alias("abstain_precision"),
        F.try_divide(n(F.col("p") & F.col("g")).cast("double"), n(F.col("g")).cast("double")).alias("abstain_recall"),
        F.try_divide(n(~F.col("p") & F.col("g")).cast("double"), n(F.col("g")).cast("double")).alias("over_answer_rate"),
    )


def confidence_calibration(rows: DataFrame, confidence: DataFrame) -> DataFrame:
    """Mean accuracy of the documents by stated confidence. confidence: id, confidence."""
    doc = rows.groupBy("id").agg(F.avg(F.col("hit").cast("double")).alias("accuracy"))
    return doc.join(confidence, "id").groupBy("confidence").agg(F.count("*").alias("n"), F.avg("accuracy").alias("accuracy"))


def modal_agreement(runs: DataFrame) -> DataFrame:
    """By field: mean share of the most frequent answer over repeated runs, and the share of unanimous ids, over ids that all runs
    have. runs: run, id, field, answer. An error for fewer than two runs."""
    if runs.select("run").distinct().limit(2).count() < 2:
        raise ValueError("agreement needs two runs or more")
    k = runs.agg(F.count_distinct("run").alias("k"))
    full = runs.groupBy("id").agg(F.count_distinct("run").alias("seen")).join(F.broadcast(k), F.col("seen") == F.col("k")).select("id", "k")
    answers = runs.join(full, "id").groupBy("id", "field", "k", "answer").agg(F.count("*").alias("c"))
    modal = answers.groupBy("id", "field", "k").agg(F.max("c").alias("c"))
    mean = F.sum("c") / (F.max("k") * F.count("*"))  # whole numbers until here: equal means are equal, whatever the order of the rows
    return modal.groupBy("field").agg(mean.alias("agreement"), F.avg((F.col("c") == F.col("k")).cast("double")).alias("unanimous"))
