"""Projections, predicates, set operations, ordering, reshaping, aggregates and windows, as the pipelines combine them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.functions.text import clip, mapped, stripped
from landgrid.ml import features as mlf
from landgrid.ml import metrics, models
from landgrid.operators import listings, objects
from landgrid.plans import pipelines, serving
from landgrid.queries import REGISTRY
from landgrid.queries.data import OBJECTS, sql
from landgrid.queries.grid import HEX, gold, rounded
from landgrid.queries.tables import _unified

_SEGMENT_CLASS = {"apartment": ["automobile"], "house": ["building"], "commercial": ["furniture"], "landplot": ["machinery"]}


@REGISTRY.add("predicates", """SELECT c_custkey AS id, c_name AS label, NULL::VARCHAR AS nothing, CASE lower(c_mktsegment) WHEN 'automobile' THEN 'apartment' WHEN 'building' THEN 'house' WHEN 'furniture' THEN 'commercial' WHEN 'machinery' THEN 'landplot' END AS kind,
 coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, 0.0) AS balance, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS band, least(greatest(c_acctbal, 0.0), 5000.0) AS clipped, TRY_CAST(c_name AS BIGINT) AS n, concat(c_name, '/', CAST(c_nationkey AS VARCHAR)) AS key, trim(concat(' ', c_name, ' ,;'), ' ,;') AS stripped
FROM customer WHERE c_nationkey IN (1, 2, 3, 5, 8, 13, 21) AND c_acctbal BETWEEN -500 AND 9000 AND c_name LIKE '%1%' AND c_mktsegment IS NOT NULL AND c_custkey <> 7""")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sql(spark, sf_dir, "customer").na.drop(subset=["c_mktsegment"])
    c = c.where(F.col("c_nationkey").isin(1, 2, 3, 5, 8, 13, 21) & F.col("c_acctbal").between(-500, 9000) & F.col("c_name").contains("1") & (F.col("c_custkey") != 7))
    present = [x for x in ("c_custkey", "c_name", "c_missing") if x in c.columns]
    out = c.select(*present, "c_acctbal", "c_mktsegment", "c_nationkey").withColumnsRenamed({"c_custkey": "id", "c_name": "label"})
    out = out.withColumns({
        "nothing": F.lit(None).cast("string"), "kind": mapped(F.lower("c_mktsegment"), _SEGMENT_CLASS), "balance": F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.lit(0.0)),
        "band": F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "some").otherwise("much"), "clipped": clip(F.col("c_acctbal"), 0.0, 5000.0), "n": F.col("label").try_cast("bigint"),
        "key": F.concat("label", F.lit("/"), F.col("c_nationkey").cast("string")), "stripped": stripped(F.concat(F.lit(" "), F.col("label"), F.lit(" ,;"))),
    })
    return out.drop("c_acctbal", "c_mktsegment", "c_nationkey")


@REGISTRY.add("set_operations", """SELECT 'customer' AS origin, c_nationkey::BIGINT AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_nationkey::BIGINT, s_acctbal, NULL FROM supplier UNION ALL SELECT 'both', n::BIGINT, NULL, NULL FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier) x UNION ALL SELECT 'without', n::BIGINT, NULL, NULL FROM (SELECT n_nationkey AS n FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) y""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.col(c).cast("bigint").alias("nation")
    cust, supp = sql(spark, sf_dir, "customer"), sql(spark, sf_dir, "supplier")
    a = cust.select(F.lit("customer").alias("origin"), n("c_nationkey"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = supp.select(F.lit("supplier").alias("origin"), n("s_nationkey"), F.col("s_acctbal").alias("balance"))
    both = cust.select(n("c_nationkey")).intersect(supp.select(n("s_nationkey"))).withColumn("origin", F.lit("both"))
    without = sql(spark, sf_dir, "nation").select(n("n_nationkey")).exceptAll(supp.where("s_acctbal > 0").select(n("s_nationkey")).distinct()).withColumn("origin", F.lit("without"))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [a, b, both, without]).select("origin", "nation", "balance", "segment")


@REGISTRY.add("joins", """SELECT c.c_custkey, n.n_name, r.r_name, coalesce(s.suppliers, 0) AS suppliers, coalesce(o.orders, 0) AS orders, o.total FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey) s ON s.s_nationkey = c.c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""")
def joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner and left joins along a chain, aggregated before they are joined; counts without a match are 0."""
    t = {x: sql(spark, sf_dir, x) for x in ("customer", "nation", "region", "supplier", "orders")}
    s = t["supplier"].groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("suppliers"))
    o = t["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    j = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.join(s, "c_nationkey", "left").join(o, "c_custkey", "left").na.fill(0, ["suppliers", "orders"]).select("c_custkey", "n_name", "r_name", "suppliers", "orders", "total")


@REGISTRY.add("aggregates", """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, min(o_totalprice) AS low, max(o_totalprice) AS high, count(DISTINCT o_custkey) AS customers, round(100.0 * count(CASE WHEN o_totalprice > 1000 THEN 1 END) / count(*), 1)::DOUBLE AS pct, arg_min(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS cheapest FROM orders GROUP BY o_orderpriority""")
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return sql(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.round(F.avg(p), 4).alias("mean"), F.round(F.median(p), 4).alias("med"), F.round(F.percentile(p, 0.25), 4).alias("p25"), F.min(p).alias("low"), F.max(p).alias("high"),
        F.count_distinct("o_custkey").alias("customers"), F.round(100 * F.count_if(p > 1000) / F.count("*"), 1).alias("pct"), F.min_by("o_orderkey", p * 1000000 + F.col("o_orderkey")).alias("cheapest"),
    )


@REGISTRY.add("first_by_priority", "SELECT o_custkey, arg_min(o_orderkey, r) AS o_orderkey, min_by(o_orderpriority, r) AS o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS r FROM orders) x GROUP BY o_custkey")
def first_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sql(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return objects.first_of(o, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@REGISTRY.add("windows", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS n, lag(l_partkey) OVER w AS before, count(*) OVER (PARTITION BY l_orderkey) AS lines, round(l_extendedprice - median(l_extendedprice) OVER (PARTITION BY l_orderkey), 4) AS diff FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Window.partitionBy("l_orderkey")
    w = part.orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    li = sql(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("bigint").alias("n"), F.lag("l_partkey").over(w).alias("before"), F.count("*").over(part).alias("lines"), F.round(F.col("l_extendedprice") - F.median("l_extendedprice").over(part), 4).alias("diff"))


@REGISTRY.add("top_rows", "SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) x ORDER BY o_orderpriority, o_totalprice DESC")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: the twenty dearest orders."""
    o = sql(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).orderBy("o_orderpriority", F.desc("o_totalprice"))


@REGISTRY.add("reshape", "SELECT o_custkey, status, n FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'X') AS \"X\" FROM orders GROUP BY o_custkey) w UNPIVOT (n FOR status IN (\"F\", \"O\", \"X\"))")
def reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot with values named in advance, so that a status that no row has is a column too, and back."""
    wide = sql(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "X"]).agg(F.count(F.lit(1))).na.fill(0)
    return wide.unpivot("o_custkey", ["F", "O", "X"], "status", "n")


@REGISTRY.add("path_explode", "SELECT doc_id, pos - 1 AS pos, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, string_split(source || '.' || lang || '.' || CAST(doc_id AS VARCHAR), '.') AS w FROM documents) a) b")
def path_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sql(spark, sf_dir, "documents").select("doc_id", F.split(F.concat_ws(".", "source", "lang", F.col("doc_id").cast("string")), "[.]").alias("w"))
    return d.select("doc_id", F.posexplode("w").alias("pos", "word")).withColumn("pos", F.col("pos").cast("bigint"))


@REGISTRY.add("conditional_means", f"SELECT h3_index, round(avg(CASE WHEN asset_class = 'apartment' THEN area_m2 END), 6) AS flats, round(avg(CASE WHEN asset_class = 'house' THEN area_m2 END), 6) AS houses FROM {HEX} h GROUP BY h3_index")
def conditional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landgrid.functions.geo import with_cell

    mean = lambda k: F.avg(F.when(F.col("asset_class") == k, F.col("area_m2")))
    return rounded(with_cell(sql(spark, sf_dir, OBJECTS), 8).groupBy("h3_index").agg(mean("apartment").alias("flats"), mean("house").alias("houses")))


@REGISTRY.add("simplification_loss", f"SELECT asset_class, round((avg(abs(2 * p - t) / nullif(abs(t), 0)) - avg(abs(p - t) / nullif(abs(t), 0))) * 100, 4) AS loss_pp FROM (SELECT asset_class, synthetic_target_rub_per_m2 AS t, y_pred_oof AS p FROM {OBJECTS} o WHERE asset_class IS NOT NULL) x GROUP BY asset_class")
def simplification_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sql(spark, sf_dir, OBJECTS).where("asset_class is not null").select("asset_class", F.col("synthetic_target_rub_per_m2").alias("y_true"), F.col("y_pred_oof").alias("black"), (2 * F.col("y_pred_oof")).alias("grey"))
    m = lambda p: o.groupBy("asset_class").agg(*metrics.error_metrics("y_true", p)).select("asset_class", F.col("mape").alias(p))
    return m("black").join(m("grey"), "asset_class").select("asset_class", F.round(metrics.simplification_loss_pp(F.col("black"), F.col("grey")), 4).alias("loss_pp"))


_COUNTS = f"SELECT h3_index, asset_class, count(*) AS n FROM {HEX} x GROUP BY h3_index, asset_class UNION ALL SELECT h3_index, 'all', count(*) FROM {HEX} x GROUP BY h3_index"


@REGISTRY.add("hex_aggregates", f"SELECT 8 AS resolution, sum(n)::BIGINT AS objects, count(*) AS rows FROM ({_COUNTS}) u")
def hex_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-ups with predictions joined by object; totals of each resolution."""
    o = sql(spark, sf_dir, OBJECTS)
    agg = pipelines.hex_aggregates(o.drop("y_pred_oof", "fold_id"), o.select("object_id", "y_pred_oof"), [8])
    return agg.groupBy("resolution").agg(F.sum("count").alias("objects"), F.count("*").alias("rows"))


_COLUMNS = f"SELECT column_name AS name, CASE WHEN column_type = 'VARCHAR' THEN 'category' ELSE 'number' END AS kind FROM (DESCRIBE SELECT * FROM {OBJECTS} o) d WHERE column_name NOT IN ('object_id', 'asset_class', 'lat', 'lon', 'synthetic_target_rub_per_m2')"


@REGISTRY.add("feature_matrix_columns", _COLUMNS)
def feature_matrix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    numeric, categorical = mlf.feature_columns(sql(spark, sf_dir, OBJECTS))
    return spark.createDataFrame([(c, "number") for c in numeric] + [(c, "category") for c in categorical], "name string, kind string")


@REGISTRY.add("serve_feature_options")
def serve_feature_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landgrid.operators.hexgrid import hex_rollup

    return spark.createDataFrame(serving.feature_options(hex_rollup(sql(spark, sf_dir, OBJECTS), 8))["features"], "name string, description string")


@REGISTRY.add("train_cells_metrics")
def train_cells_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hex-level model on gold features and their synthetic target."""
    from landgrid.operators.hexgrid import cell_target
    from landgrid.scratch import cut

    g = cut(gold(spark, sf_dir), "gold")
    return models.train_cells(g, cell_target(g).select("h3_index", "resolution", "synthetic_target_rub_per_m2"), iterations=10)[1]


@REGISTRY.add("train_listings_metrics")
def train_listings_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.train_listings(listings.plausible(_unified(spark, sf_dir)), folds=3)
