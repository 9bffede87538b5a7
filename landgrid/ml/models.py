"""The model family, cross-validation with out-of-fold predictions, and training runs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Interaction, OneHotEncoder, QuantileDiscretizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.ml import metrics
from landgrid.ml.features import BINS, feature_columns, matrix_stages, prepared, wide_columns, with_folds
from landgrid.scratch import cut
from landgrid.sources.readers import run_folders
from landgrid.sources.sinks import log_run

#: Plain columns of the naive model, where present.
NAIVE_NUMERIC, NAIVE_CATEGORICAL = ["lat", "lon", "levels", "flats", "area_m2", "year_built"], ["materials"]
QUARTET = ["black", "white", "grey", "naive"]


def black(numeric: list[str], categorical: list[str], label: str, iterations: int = 100, depth: int = 6, rate: float = 0.05, seed: int = 42, wide: list[str] | None = None) -> Pipeline:
    """Boosted trees. wide: categorical columns of more values than BINS."""
    return Pipeline(stages=[*matrix_stages(numeric, categorical, wide=wide, label=label), GBTRegressor(featuresCol="features", labelCol=label, predictionCol="y_pred", maxIter=iterations, maxDepth=depth, stepSize=rate, seed=seed, maxBins=BINS)])


def white(numeric: list[str], categorical: list[str], label: str, bins: int = 32, pairs: int = 1) -> Pipeline:
    """An additive model: a step function of each number and an effect of each category, and of the first numbers' bins in pairs.

    Spark has no explainable boosting machine; this is its shape (binned additive terms and interactions) fitted as a ridge regression.
    """
    base = matrix_stages(numeric, categorical, one_hot=True, out="__plain")[:-1]
    stages, terms = [*base], [f"{c}__o" for c in categorical]
    if numeric:
        made = [f"{c}__b" for c in numeric]
        stages.append(QuantileDiscretizer(inputCols=[f"{c}__n" for c in numeric], outputCols=made, numBuckets=bins, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=made, outputCols=[f"{m}o" for m in made], handleInvalid="keep"))
        terms += [f"{m}o" for m in made]
        coarse = [f"{c}__c" for c in numeric[: 2 * pairs]]
        if len(coarse) >= 2:
            stages.append(QuantileDiscretizer(inputCols=[f"{c}__n" for c in numeric[: len(coarse)]], outputCols=coarse, numBuckets=6, handleInvalid="keep"))
            stages.append(OneHotEncoder(inputCols=coarse, outputCols=[f"{c}o" for c in coarse], handleInvalid="keep"))
            for i in range(0, len(coarse) - 1, 2):
                stages.append(Interaction(inputCols=[f"{coarse[i]}o", f"{coarse[i + 1]}o"], outputCol=f"__pair{i}"))
                terms.append(f"__pair{i}")
    stages.append(VectorAssembler(inputCols=terms, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=[*stages, LinearRegression(featuresCol="features", labelCol=label, predictionCol="y_pred", regParam=1e-3, elasticNetParam=0.0, solver="auto")])


def grey(numeric: list[str], categorical: list[str], label: str, depth: int = 10, wide: list[str] | None = None) -> Pipeline:
    """One tree, fitted on the black model's predictions. wide: categorical columns of more values than BINS."""
    return Pipeline(stages=[*matrix_stages(numeric, categorical, wide=wide, label=label), DecisionTreeRegressor(featuresCol="features", labelCol=label, predictionCol="y_pred", maxDepth=depth, maxBins=BINS)])


def naive(columns: list[str], label: str) -> Pipeline:
    """Linear regression on plain columns: medians for missing numbers, indicators for categories."""
    n, c = [x for x in NAIVE_NUMERIC if x in columns], [x for x in NAIVE_CATEGORICAL if x in columns]
    return Pipeline(stages=[*matrix_stages(n, c, one_hot=True), LinearRegression(featuresCol="features", labelCol=label, predictionCol="y_pred", regParam=1e-6)])


def cross_validated(df: DataFrame, pipeline: Pipeline, folds: int, keep: list[str]) -> DataFrame:
    """Out-of-fold predictions: for each fold a model of the others. keep: columns carried along; y_pred is the prediction."""
    parts = [pipeline.fit(df.where(F.col("fold_id") != k)).transform(df.where(F.col("fold_id") == k)).select(*keep, "fold_id", "y_pred") for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def train_quartet(objects: DataFrame, folds: int = 5, parent_resolution: int = 7, seed: int = 42, target: str = "synthetic_target_rub_per_m2", iterations: int = 100) -> tuple[DataFrame, DataFrame, dict[str, PipelineModel]]:
    """Out-of-fold predictions (object_id, fold_id, y_true and one column a model), their metrics (a row a model), and final models.

    Black, white and naive are cross-validated on the target; grey on the black model's out-of-fold predictions, whose folds it shares.
    """
    numeric, categorical = feature_columns(objects)
    counts = objects.select(*[F.count(c).alias(c) for c in numeric]).first() if numeric else {}
    numeric = [c for c in numeric if c != target and counts[c]]  # a column without any value tells nothing, and has no median
    own = prepared(objects.where(F.col(target).isNotNull()), [*numeric, *[c for c in ("lat", "lon") if c not in numeric]], categorical).withColumn("y_true", F.col(target).cast("double"))
    data = cut(with_folds(own, folds, parent_resolution, seed), "training")
    many = wide_columns(data, categorical)
    kinds = {"black": black(numeric, categorical, "y_true", iterations, seed=seed, wide=many), "white": white(numeric, categorical, "y_true"), "naive": naive(data.columns, "y_true")}
    oof = {k: cut(cross_validated(data, p, folds, ["object_id"]).withColumnRenamed("y_pred", k), "oof") for k, p in kinds.items()}
    told = cut(data.join(oof["black"].select("object_id", F.col("black").alias("y_black")), "object_id"), "told")
    kinds["grey"] = grey(numeric, categorical, "y_black", wide=many)
    oof["grey"] = cut(cross_validated(told, kinds["grey"], folds, ["object_id"]).withColumnRenamed("y_pred", "grey"), "oof")
    wide = data.select("object_id", "lat", "lon", "fold_id", "y_true")
    for k in QUARTET:
        wide = wide.join(oof[k].select("object_id", k), "object_id")
    wide = cut(wide, "quartet")
    models = {k: p.fit(told if k == "grey" else data) for k, p in kinds.items()}
    return wide, quartet_metrics(wide), models


def quartet_metrics(wide: DataFrame) -> DataFrame:
    """A row for each model: errors, rank correlation, tails, loss against black, and grey's fidelity to it."""
    long = wide.unpivot(["object_id", "fold_id", "y_true"], QUARTET, "model", "y_pred")
    m = metrics.fold_means(long, ["model"]).join(metrics.spearman(long, ["model"]), "model").join(metrics.percentile_asymmetry(long, ["model"]), "model")
    base = m.where("model = 'black'").select(F.col("mape").alias("__black"))
    fid = metrics.fidelity_r2(wide.withColumn("model", F.lit("grey")), ["model"], "grey", "black").withColumnRenamed("r2", "fidelity_r2")
    m = m.crossJoin(F.broadcast(base)).withColumn("simplification_loss_pp", metrics.simplification_loss_pp(F.col("__black"), F.col("mape"))).drop("__black")
    return m.join(fid, "model", "left")


def train_and_log(objects: DataFrame, base: str, run_name: str, **options) -> str:
    """Train the quartet and keep it as a run; the path."""
    wide, table, models = train_quartet(objects, **options)
    found = {r["model"]: {k: v for k, v in r.asDict().items() if k != "model"} for r in table.collect()}
    oof = wide.select("object_id", "lat", "lon", "fold_id", "y_true", F.col("black").alias("y_pred_oof"))
    return log_run(objects.sparkSession, base, run_name, {k: str(v) for k, v in options.items()}, found, models["black"], oof)


def load_latest(spark, base: str, run_name: str) -> PipelineModel:
    """The newest run's model of exactly this name."""
    runs = run_folders(spark, base, run_name)
    if not runs:
        raise FileNotFoundError(f"no run {run_name} in {base}")
    return PipelineModel.load(f"{runs[0][1]}/model")


def infer(model: PipelineModel, objects: DataFrame) -> DataFrame:
    """objects and y_pred, numbers and categories prepared as for training."""
    numeric, categorical = feature_columns(objects)
    return model.transform(prepared(objects, [*numeric, "lat", "lon"], categorical)).select(*objects.columns, "y_pred")


def train_cells(gold: DataFrame, target: DataFrame, iterations: int = 50) -> tuple[PipelineModel, DataFrame]:
    """The hex-level model: gold joined with its target by cell; the model and its in-sample errors."""
    data = gold.join(target, ["h3_index", "resolution"])
    numeric = [c for c, t in data.dtypes if t in ("bigint", "int", "double") and c not in ("resolution", "synthetic_target_rub_per_m2")]
    data = prepared(data, numeric, []).withColumn("y_true", F.col("synthetic_target_rub_per_m2"))
    model = black(numeric, [], "y_true", iterations).fit(data)
    return model, model.transform(data).agg(*metrics.error_metrics())


def train_listings(listings: DataFrame, folds: int = 5, holdout: float = 0.2, seed: int = 42) -> DataFrame:
    """Errors, back on the price scale, of a model of the log price a square metre: by folds, on a held-out part, and across sources.

    Folds and the held-out part go by a hash of the listing's id: the same for any partitioning.
    """
    numeric, categorical = [c for c in ("total_area_m2", "rooms", "floor", "floors_count", "floor_share", "build_year", "lat", "lon") if c in listings.columns], [c for c in ("source", "city", "material_type") if c in listings.columns]
    h = F.pmod(F.xxhash64("source", "listing_id", F.lit(seed)), F.lit(1_000))
    # Some sources lack a column altogether, so that without the others there is no median: missing numbers are 0, and marked.
    marked = prepared(listings, numeric, categorical).withColumns({f"{c}_known": F.col(c).isNotNull().cast("double") for c in numeric}).na.fill(0.0, numeric)
    numeric = [*numeric, *[f"{c}_known" for c in numeric]]
    d = cut(marked.withColumns({"y_true": F.col("price_per_sqm_rub"), "y": F.ln("price_per_sqm_rub"), "fold_id": F.pmod(h, F.lit(folds)), "held": h < int(1_000 * holdout)}), "listings")
    p = Pipeline(stages=[*matrix_stages(numeric, categorical, one_hot=True), GeneralizedLinearRegression(featuresCol="features", labelCol="y", predictionCol="y_pred", family="gaussian", regParam=0.1)])
    parts = [cross_validated(d, p, folds, ["y_true"]).select(F.lit("folds").alias("kind"), "y_true", "y_pred"), p.fit(d.where("not held")).transform(d.where("held")).select(F.lit("holdout").alias("kind"), "y_true", "y_pred")]
    names = sorted(r[0] for r in d.select("source").distinct().collect())  # a handful
    for s in names:
        rest = d.where(F.col("source") != s)
        if not rest.isEmpty():
            parts.append(p.fit(rest).transform(d.where(F.col("source") == s)).select(F.lit(f"without {s}").alias("kind"), "y_true", "y_pred"))
    return reduce(DataFrame.unionByName, parts).withColumn("y_pred", F.exp("y_pred")).groupBy("kind").agg(*metrics.error_metrics(), F.count("*").alias("n"))
