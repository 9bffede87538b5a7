"""Which columns are features, the matrix, and spatial folds."""

from __future__ import annotations

import random

from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landgrid.functions.geo import apply_steps, hex_steps

MISSING = "__missing__"
NOT_FEATURES = {"object_id", "asset_class", "lat", "lon", "synthetic_target_rub_per_m2", "cost_value_rub", "cad_num", "readable_address", "mun_source", "polygon_wkt_3857"}
NOT_PREFIXES = ("parent_h3_p",)
#: Bins of a tree's column; a tree splits no column of more categories (one bin is for unseen ones).
BINS = 256


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns, in order; booleans and other types are neither."""
    own = [f for f in df.schema if f.name not in NOT_FEATURES and not f.name.startswith(NOT_PREFIXES)]
    return [f.name for f in own if isinstance(f.dataType, T.NumericType)], [f.name for f in own if isinstance(f.dataType, T.StringType)]


def prepared(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """df with numbers as doubles and missing categories named."""
    return df.withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.coalesce(c, F.lit(MISSING)) for c in categorical})


def wide_columns(df: DataFrame, categorical: list[str]) -> list[str]:
    """The categorical columns of df with more values than a tree can split."""
    n = df.select(*[F.count_distinct(c).alias(c) for c in categorical]).first() if categorical else {}
    return [c for c in categorical if n[c] >= BINS]


def matrix_stages(numeric: list[str], categorical: list[str], one_hot: bool = False, out: str = "features", wide: list[str] | None = None, label: str | None = None) -> list:
    """Stages that make the feature vector: medians for missing numbers, indices (or indicators) for categories; unseen ones are kept apart.
    Columns in `wide` become the smoothed mean of the label over the rows fitted on instead of an index."""
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__n" for c in numeric])] if numeric else []
    inputs = [f"{c}__n" for c in numeric]
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep"))
        if one_hot:
            stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__o" for c in categorical], handleInvalid="keep"))
        wide = [c for c in wide or [] if not one_hot]
        if wide:
            stages.append(TargetEncoder(inputCols=[f"{c}__i" for c in wide], outputCols=[f"{c}__t" for c in wide], labelCol=label, targetType="continuous", handleInvalid="keep", smoothing=10.0))
            # The encoder hands on the index's attributes, by which a tree would still take the mean for a category.
            stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(f'`{c}__t` + 0D AS `{c}__w`' for c in wide)} FROM __THIS__"))
        inputs += [f"{c}__{'o' if one_hot else 'w' if c in wide else 'i'}" for c in categorical]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep")]


def fold_table(spark: SparkSession, parents: list[str], n_splits: int, seed: int) -> DataFrame:
    """(parent, fold_id): parents, shuffled by seed, dealt to folds in turn."""
    names = sorted(parents)
    if n_splits > len(names):
        raise ValueError(f"{n_splits} folds, but only {len(names)} parent cells")
    random.Random(seed).shuffle(names)
    return spark.createDataFrame([(p, i % n_splits) for i, p in enumerate(names)], "parent string, fold_id bigint")


def with_folds(objects: DataFrame, n_splits: int = 5, parent_resolution: int = 7, seed: int = 42) -> DataFrame:
    """objects and fold_id; all objects of a parent cell share one. Parent cells of a region are few (10^4 for a republic), so their list
    is shuffled on the driver."""
    o = apply_steps(objects, hex_steps(parent_resolution, "__parent"))
    parents = [r[0] for r in o.select("__parent").where("__parent is not null").distinct().collect()]
    return o.join(F.broadcast(fold_table(objects.sparkSession, parents, n_splits, seed)), F.col("__parent") == F.col("parent")).drop("__parent", "parent")
