"""Writers: validated partitions, stage and swap, reports, runs."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from landgrid.schemas import VALUATION_REQUIRED, require_columns
from landgrid.scratch import cut, hadoop_path


def write_partitions(df: DataFrame, base: str, keys: list[str], sort: list[str] | None = None, ddl: str | None = None) -> None:
    """Overwrite the partitions that df has rows for, and no others; checked against ddl first if given. df may read from base itself: it is
    written aside before it replaces anything."""
    df = require_columns(df, ddl) if ddl else df
    staged = cut(df, "staged")
    out = staged.sortWithinPartitions(*sort) if sort else staged
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(base)


def save_objects(objects: DataFrame, base: str) -> None:
    """Valuation objects by region and class."""
    write_partitions(objects, base, ["region", "asset_class"], ddl=VALUATION_REQUIRED + ", region STRING")


def save_coverage(coverage: DataFrame, base: str) -> None:
    write_partitions(coverage, base, ["region", "resolution"], sort=["h3_index"])


def save_feature_set(features: DataFrame, base: str) -> None:
    write_partitions(features, base, ["region", "feature_set", "resolution"])


def save_silver(rows: DataFrame, base: str) -> None:
    write_partitions(rows, base, ["region", "source"])


def save_aggregates(rows: DataFrame, base: str) -> None:
    write_partitions(rows, base, ["region", "resolution", "model"])


def save_predictions(predictions: DataFrame, path: str) -> None:
    predictions.orderBy("object_id").write.mode("overwrite").parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = hadoop_path(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def log_run(spark: SparkSession, base: str, run_name: str, params: dict, metrics: dict, model: PipelineModel | None = None, predictions: DataFrame | None = None, now: datetime | None = None) -> str:
    """A folder run_name_<UTC time> with params.json, metrics.json, the model and the predictions; its path."""
    path = f"{base.rstrip('/')}/{run_name}_{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%S')}"
    write_text(spark, f"{path}/params.json", json.dumps(params, ensure_ascii=False, sort_keys=True))
    write_text(spark, f"{path}/metrics.json", json.dumps(metrics, ensure_ascii=False, sort_keys=True))
    if model is not None:
        model.write().overwrite().save(f"{path}/model")
    if predictions is not None:
        save_predictions(predictions, f"{path}/oof_predictions.parquet")
    return path


MOST_REPORTED = 1_000


def write_report(df: DataFrame, path: str) -> str:
    """A report as CSV, and as a Markdown table, which is returned; for reports of a few rows. ValueError for more than MOST_REPORTED."""
    rows = df.limit(MOST_REPORTED + 1).collect()
    if len(rows) > MOST_REPORTED:
        raise ValueError(f"a report has at most {MOST_REPORTED} rows")
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
