"""Summaries and the tables behind figures, and the report that is put together from those of them that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.evaluation import auc, order_statistics
from tidemark.operators.grading import exact_match, field_accuracy, macro_f1
from tidemark.sources import tables

# Order in which extractors are reported.
EXTRACTOR_ORDER = ["baseline", "local", "local-sample", "claude"]


def _worst(name: str, by: str):
    return F.min_by(name, F.struct(by, name))


def extraction_summary(rows: DataFrame) -> DataFrame:
    """Means over fields, the share of documents that match in full, and the worst field (ties by name) of graded rows. An error if
    there are none: nothing was graded."""
    if rows.isEmpty():
        raise ValueError("predictions and gold have no document in common")
    fields = field_accuracy(rows).join(macro_f1(rows), "field", "left")
    means = fields.agg(F.count("*").alias("n_fields"), F.avg("accuracy").alias("mean_field_accuracy"), F.avg("macro_f1").alias("mean_macro_f1"), _worst("field", "accuracy").alias("worst_field"), F.min("accuracy").alias("worst_field_accuracy"))
    return exact_match(rows).select(F.col("n").alias("n_documents"), F.col("exact_match").alias("document_exact_match")).join(F.broadcast(means))


def coverage(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """n_gold and n_graded documents: how many gold documents predictions leave out."""
    return gold.agg(F.count_distinct("id").alias("n_gold")).join(rows.agg(F.count_distinct("id").alias("n_graded")))


def consistency_summary(table: DataFrame) -> DataFrame:
    """Mean agreement of modal_agreement's table and its least stable field (ties by name)."""
    return table.agg(F.avg("agreement").alias("mean_agreement"), _worst("field", "agreement").alias("least_stable_field"))


def character_savings(prepared: DataFrame, p: str = "p") -> DataFrame:
    """Share of characters that preparation took away, and how many documents it trimmed and cut. p: a struct that prepare gives."""
    kept, all_ = F.sum(F.length(f"{p}.text")).cast("double"), F.sum(f"{p}.original_chars").cast("double")
    return prepared.agg((1 - F.try_divide(kept, all_)).alias("saved"), F.count_if(f"{p}.trimmed_at_marker").alias("n_trimmed"), F.count_if(f"{p}.hard_truncated").alias("n_truncated"), F.count("*").alias("n"))


def throughput(results: DataFrame, wall_s: float) -> DataFrame:
    """Tokens of the successful results a second of wall time, seconds a document, and the upper median and maximum of all latencies."""
    tokens = lambda c: F.sum(F.when(F.col("ok"), F.col(c)))
    n = results.where("latency_s is not null").count()
    upper = order_statistics(results, "latency_s", [n // 2], n=n)[0] if n else None
    out = results.agg(
        F.count("*").alias("docs"), F.count_if("ok").alias("ok"), tokens("input_tokens").alias("prompt_tokens"), (tokens("input_tokens") / wall_s).alias("prompt_per_s"), tokens("output_tokens").alias("output_tokens"),
        (tokens("output_tokens") / wall_s).alias("output_per_s"), (F.lit(wall_s) / F.count("*")).alias("s_per_doc"), F.max("latency_s").alias("latency_max"),
    )
    return out.withColumn("latency_median", F.lit(upper).cast("double"))


def quality_table(fields: DataFrame, baseline: DataFrame) -> DataFrame:
    """field, accuracy, baseline: accuracies by field beside those of a baseline, null where that lacks a field."""
    return fields.select("field", "accuracy").join(baseline.select("field", F.col("accuracy").alias("baseline")), "field", "left")


def display(table: DataFrame, digits: int = 4) -> DataFrame:
    """table with its doubles rounded for show, halves to even."""
    return table.select(*[F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes])


def extractor_names(names: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """(name, place) of artifacts called prefix + name + suffix, in the order of reporting; unknown names come last, by name."""
    n = F.col("file")
    name = F.substring(n, F.lit(len(prefix) + 1), F.length(n) - len(prefix) - len(suffix))
    found = names.where(n.startswith(prefix) & n.endswith(suffix) & (F.length(n) >= len(prefix) + len(suffix))).select(name.alias("name"))
    known = F.array_position(F.array(*map(F.lit, EXTRACTOR_ORDER)), F.col("name"))
    return found.select("name", F.when(known > 0, known - 1).otherwise(len(EXTRACTOR_ORDER)).cast("int").alias("place")).orderBy("place", "name")


#: Results of stages that a report knows, in the order of its sections: stage, heading.
SECTIONS = [
    ("events", "Dataset"), ("timing", "Release timing"), ("extraction_stats", "Extraction"), ("extraction_summary", "Extraction quality"), ("extraction_fields", "Accuracy by field"),
    ("consistency", "Extraction stability"), ("ablation", "Prediction"), ("reliability", "Calibration"), ("importance", "Permutation importance"),
]
MANIFEST = "stage string, extractor string, version string, at timestamp, path string"


def record_stage(result: DataFrame, root: str, stage: str, extractor: str = "", version: str = "1") -> None:
    """Keep a stage's result as a table under root, and add it to root's manifest once it is whole."""
    spark = result.sparkSession
    path = f"{root}/results/{stage}-{extractor or 'all'}-{version}"
    tables.replace(result, path)
    row = spark.range(1).select(F.lit(stage).alias("stage"), F.lit(extractor).alias("extractor"), F.lit(version).alias("version"), F.current_timestamp().alias("at"), F.lit(path).alias("path"))
    tables.append(row, f"{root}/manifest")


def stage_results(spark: SparkSession, root: str) -> DataFrame:
    """stage, extractor, version, at, path: the latest record of each (stage, extractor), in the order of reporting."""
    all_ = tables.read(spark, f"{root}/manifest", spark.createDataFrame([], MANIFEST).schema)
    last = all_.groupBy("stage", "extractor").agg(F.max_by(F.struct("version", "at", "path"), F.struct("at", "version")).alias("r")).select("stage", "extractor", "r.*")
    place = lambda c, known: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, known)), c), F.lit(0)), F.lit(len(known) + 1))
    return last.orderBy(place(F.col("stage"), [s for s, _ in SECTIONS]), place(F.col("extractor"), EXTRACTOR_ORDER), "stage", "extractor")


def assembled_report(spark: SparkSession, root: str, title: str = "Results", digits: int = 4) -> str:
    """The Markdown report of what root's manifest names; a stage that has not run leaves its section out."""
    heads = dict(SECTIONS)
    found = [(heads.get(r.stage, r.stage) + (f" - {r.extractor}" if r.extractor else ""), tables.read(spark, r.path)) for r in stage_results(spark, root).collect()]  # as many as stages
    return markdown_report(title, found, digits)


def ablation_table(scored: DataFrame, base: str = "controls_only", bins: int = 10) -> DataFrame:
    """feature_set, auc, brier, brier_skill, and what each gains over `base`: d_auc, d_skill (null where that is missing). scored: feature_set, y, p; the
    skill is against the share of positives in the set's own rows."""
    areas = auc(scored, ["feature_set"])
    rate = scored.groupBy("feature_set").agg(F.avg(F.col("y").cast("double")).alias("rate"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    known = areas.join(rate, "feature_set").select("feature_set", "auc", "brier", (1 - F.try_divide("brier", F.col("rate") * (1 - F.col("rate")))).alias("brier_skill"))
    over = known.where(F.col("feature_set") == base).agg(F.first("auc").alias("a"), F.first("brier_skill").alias("s"))
    return known.join(F.broadcast(over)).select("*", (F.col("auc") - F.col("a")).alias("d_auc"), (F.col("brier_skill") - F.col("s")).alias("d_skill")).drop("a", "s")


def consistency_table(agreement: DataFrame, accuracy: DataFrame | None = None) -> DataFrame:
    """field, agreement, unanimous, place (from the least stable, ties by name), and the accuracy of the field where it was graded."""
    graded = agreement.sparkSession.createDataFrame([], "field string, accuracy double") if accuracy is None else accuracy.select("field", "accuracy")
    place = F.row_number().over(Window.partitionBy().orderBy("agreement", "field"))  # a row for each field
    return agreement.join(graded, "field", "left").select("field", "agreement", "unanimous", "accuracy", place.alias("place"))


def markdown_report(title: str, sections: list[tuple[str, DataFrame | None]], digits: int = 4) -> str:
    """Sections of small result tables as Markdown; those whose stage has not run (None) are left out."""
    out = [f"# {title}"]
    for heading, table in sections:
        if table is not None:
            rows = [[("" if x is None else str(x)) for x in r] for r in display(table, digits).collect()]
            out += ["", f"## {heading}", "", *("| " + " | ".join(r) + " |" for r in [table.columns, ["---"] * len(table.columns), *rows])]
    return "\n".join(out) + "\n"
