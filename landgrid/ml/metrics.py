"""Regression metrics as aggregates, so that any number of models and folds is measured in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_metrics(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    """mae, rmse and mape (over rows whose truth isn't 0; null without any)."""
    e, truth = F.col(p) - F.col(y), F.col(y)
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(truth != 0, F.abs(e / F.nullif(truth, F.lit(0.0))))).alias("mape")]


def spearman(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(by, spearman): correlation of average ranks. Ranks come from counts of distinct values, which a window sums; ties share one."""
    def ranked(df: DataFrame, c: str, out: str) -> DataFrame:
        counts = df.groupBy(*by, c).agg(F.count("*").alias("__n"))
        below = F.sum("__n").over(Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        return counts.select(*by, c, (F.coalesce(below, F.lit(0)) + (F.col("__n") + 1) / 2).alias(out))

    full = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*by, y, p)
    both = full.join(ranked(full, y, "__ry"), [*by, y]).join(ranked(full, p, "__rp"), [*by, p])
    return both.groupBy(*by).agg(F.corr("__ry", "__rp").alias("spearman"))


def percentile_asymmetry(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Differences of the percentiles of prediction and truth, and, among rows in the truth's lowest and highest tenth, the share predicted
    above and below it."""
    points = (10, 25, 50, 75, 90)
    q = F.array(*[F.lit(x / 100) for x in points])
    limits = df.groupBy(*by).agg(F.percentile(y, q).alias("__qy"), F.percentile(p, q).alias("__qp"))
    on = [F.col(f"d.{b}").eqNullSafe(F.col(f"l.{b}")) for b in by]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    j = df.alias("d").join(F.broadcast(limits).alias("l"), cond)
    low, high = F.col(f"d.{y}") <= F.col("l.__qy")[0], F.col(f"d.{y}") >= F.col("l.__qy")[4]
    over, under = (F.col(f"d.{p}") > F.col(f"d.{y}")).cast("double"), (F.col(f"d.{p}") < F.col(f"d.{y}")).cast("double")
    out = j.groupBy(*[F.col(f"d.{b}").alias(b) for b in by]).agg(
        *[F.first(F.col("l.__qp")[i] - F.col("l.__qy")[i]).alias(f"p{x}_pred_minus_true") for i, x in enumerate(points)],
        F.coalesce(F.avg(F.when(low, over)), F.lit(0.0)).alias("frac_overpredicted_in_bottom_decile"), F.coalesce(F.avg(F.when(high, under)), F.lit(0.0)).alias("frac_underpredicted_in_top_decile"),
    )
    return out


def fidelity_r2(df: DataFrame, by: list[str], simple: str, black: str) -> DataFrame:
    """(by, r2): how much of the black model's variance the simple one's predictions follow. Moments in one pass."""
    s, b = F.col(simple), F.col(black)
    return df.groupBy(*by).agg((1 - F.sum((s - b) * (s - b)) / F.nullif(F.var_pop(b) * F.count(b), F.lit(0.0))).alias("r2"))


def simplification_loss_pp(black_mape: Column, simple_mape: Column) -> Column:
    return (simple_mape - black_mape) * 100


def fold_means(df: DataFrame, by: list[str], fold: str = "fold_id", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Mean over folds of each fold's metrics; folds in which one can't be computed are left out."""
    per = df.groupBy(*by, fold).agg(*error_metrics(y, p))
    return per.groupBy(*by).agg(*[F.avg(F.nanvl(F.col(m), F.lit(None).cast("double"))).alias(m) for m in ("mae", "rmse", "mape")])
