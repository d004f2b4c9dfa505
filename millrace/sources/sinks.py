"""Writers: predictions, models, report tables and the step log."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """CSV with a header (the ``.csv`` suffix is added), or parquet for large results."""
    if fmt == "csv":
        path = path if path.endswith(".csv") else path + ".csv"
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
    return path


def safe_name(name: str) -> str:
    return re.sub(r"[^\w.-]+", "_", name).strip("_") or "model"


def save_models(spark: SparkSession, models: dict, folder: str) -> DataFrame:
    """Each model under its path-safe name, and a manifest table next to them.

    A ``Fitted`` keeps what prediction needs: task, features, labels and parameters; boosted stumps keep their weights. A bare pipeline
    is stored as it is.
    """
    from millrace.operators.models import Boosted, Fitted
    rows = []
    for name, given in models.items():
        target = f"{folder}/{safe_name(name)}"
        model = given.model if isinstance(given, Fitted) else given
        facts = {}
        if isinstance(given, Fitted):
            facts = {"name": given.name, "task": given.task, "features": given.features, "labels": given.labels, "params": given.params}
        if isinstance(model, Boosted):
            facts |= {"alphas": model.alphas, "classes": model.classes}
            model.assembler.write().overwrite().save(f"{target}/assembler")
            for i, m in enumerate(model.models):
                m.write().overwrite().save(f"{target}/{i}")
        else:
            model.write().overwrite().save(target)
        rows.append((name, target, type(model).__name__, json.dumps(facts)))
    manifest = spark.createDataFrame(rows, "model string, path string, kind string, facts string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest


def load_models(spark: SparkSession, folder: str) -> dict:
    """What ``save_models`` stored: a ``Fitted`` where there was one, else the pipeline."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import DecisionTreeClassificationModel
    from pyspark.ml.feature import VectorAssembler

    from millrace.operators.models import Boosted, Fitted
    out = {}
    for r in spark.read.parquet(f"{folder}/manifest").collect():
        facts = json.loads(r["facts"])
        if r["kind"] == "Boosted":
            stumps = [DecisionTreeClassificationModel.load(f"{r['path']}/{i}") for i in range(len(facts["alphas"]))]
            model = Boosted(VectorAssembler.load(f"{r['path']}/assembler"), stumps, facts["alphas"], facts["classes"])
        else:
            model = PipelineModel.load(r["path"])
        out[r["model"]] = Fitted(model, *(facts[k] for k in ("name", "task", "features", "labels", "params"))) if "task" in facts else model
    return out



def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """The report as tables: context, models, metrics, history, chart data; one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{safe_name(name)}")


def context_table(spark: SparkSession, context: dict) -> DataFrame:
    """(key, value) rows of the business context."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in context.items()], "key string, value string")


def log_step(spark: SparkSession, path: str, step: str, action: str, details: dict | None = None,
             before: DataFrame | None = None, after: DataFrame | None = None) -> None:
    """Append one audit row: (at, step, action, details, rows_in, rows_out, cols_out)."""
    row = [(step, action, json.dumps(details or {}, sort_keys=True), before.count() if before is not None else None,
            after.count() if after is not None else None, len(after.columns) if after is not None else None)]
    df = spark.createDataFrame(row, "step string, action string, details string, rows_in long, rows_out long, cols_out int")
    df.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("at")
