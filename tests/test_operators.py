from __future__ import annotations

import pytest

from landgrid.ml import features as mlf
from landgrid.ml import metrics, models
from landgrid.operators import hexgrid, objects, registry
from landgrid.plans import pipelines, serving
from landgrid.schemas import SchemaError, require_columns
from landgrid.scratch import scratch_path
from landgrid.sources import readers, sinks

LAT, LON = 55.7887, 49.1221
TARGET = "synthetic_target_rub_per_m2"


def test_rollup_has_all_row_medians_and_modes(spark):
    rows = [("1", "house", LAT, LON, 10.0, 12.0, 1, "x"), ("2", "house", LAT, LON, 30.0, None, 3, "x"), ("3", "apartment", LAT, LON, 50.0, 40.0, None, "y")]
    o = spark.createDataFrame(rows, f"object_id string, asset_class string, lat double, lon double, {TARGET} double, y_pred_oof double, levels long, intra_city_raion string")
    r = {x.asset_class: x for x in hexgrid.hex_rollup(o, 8).collect()}
    assert set(r) == {"house", "apartment", "all"} and r["all"]["count"] == 3
    assert r["house"].median_target_rub_per_m2 == 20 and r["all"].median_target_rub_per_m2 == 30
    assert r["house"].median_residual_rub_per_m2 == 2 and r["all"].mean_levels == 2 and r["all"].dominant_intra_city_raion == "x"
    without = {x.asset_class: x for x in hexgrid.hex_rollup(o.drop("y_pred_oof"), 8).collect()}
    assert without["all"].median_pred_oof_rub_per_m2 is None
    assert hexgrid.hex_rollup(o.limit(0), 8).count() == 0


def test_relative_statistics(spark):
    o = spark.createDataFrame([(str(i), LAT, LON, v) for i, v in enumerate([10.0, 20.0, 30.0, None])] + [("far", 56.5, 50.5, 7.0)], "object_id string, lat double, lon double, d double")
    r = {x.object_id: x for x in hexgrid.relative_features(o, [7], ["d"]).collect()}
    assert r["0"].count_p7 == 4 and r["0"].d__rel_p7_diff_med == -10 and r["0"].d__rel_p7_ratio_med == 0.5 and r["0"].d__rel_p7_z_iqr == -1
    assert r["3"].d__rel_p7_diff_med is None
    assert r["far"].d__rel_p7_diff_med == 0 and r["far"].d__rel_p7_z_iqr is None
    zero = spark.createDataFrame([("a", LAT, LON, 0.0)], "object_id string, lat double, lon double, d double")
    assert hexgrid.relative_features(zero, [7], ["d"]).first().d__rel_p7_ratio_med is None


def test_eras(spark):
    years = [None, 0, 1916, 1917, 1945, 1946, 1956, 1957, 1968, 1969, 1980, 1981, 1991, 1992, 2000, 2001, 2010, 2011, 2020, 2021]
    o = spark.createDataFrame([(i, y) for i, y in enumerate(years)], "i int, year_built long")
    got = [r.era_category for r in objects.age_features(o, 2026).orderBy("i").collect()]
    assert got == ["unknown", "unknown", "pre_revolution", "early_soviet", "early_soviet", "stalin", "stalin", "khrushchev", "khrushchev", "brezhnev", "brezhnev", "late_soviet", "late_soviet", "90s_transition", "90s_transition", "2000s", "2000s", "2010s", "2010s", "new_2020+"]
    with pytest.raises(KeyError):
        objects.age_features(o.drop("year_built"), 2026)


def test_buildings_need_one_resolution(spark):
    cover = spark.createDataFrame([("8:0:0", 8), ("9:0:0", 9)], "h3_index string, resolution int")
    b = spark.createDataFrame([(LAT, LON, "apartments", "x", "3")], "lat double, lon double, building string, levels string, flats string")
    with pytest.raises(Exception, match="mixes resolutions"):
        hexgrid.building_features(cover, b, 8).collect()
    one = hexgrid.with_cell(b, 8).select("h3_index").selectExpr("h3_index", "8 as resolution")
    r = hexgrid.building_features(one, b, 8).first()
    assert (r.building_count, r.building_count_apartments, r.levels_mean, r.flats_total) == (1, 1, 0.0, 3)


def test_targets_depend_on_seed_only(spark):
    gold = spark.createDataFrame([(f"8:{i}:0", 8, i, i % 2, 1000.0 * i) for i in range(50)], "h3_index string, resolution int, building_count_apartments long, count_stations_1km long, road_length_m double")
    a, b, c = (sorted(r[TARGET] for r in hexgrid.cell_target(gold.repartition(n), seed).collect()) for n, seed in ((1, 1), (5, 1), (1, 2)))
    assert a == b and a != c and min(a) >= 0
    with pytest.raises(KeyError):
        hexgrid.cell_target(gold.drop("road_length_m"))


def test_unknown_class_has_no_target(spark):
    o = spark.createDataFrame([("a", "castle", 1.0, 0, 0, 0, 0, 0.0)], "object_id string, asset_class string, dist_metro_m double, count_stations_1km int, count_apartments_500m int, count_houses_500m int, count_commercial_500m int, road_length_500m double")
    with pytest.raises(Exception, match="no base price"):
        objects.object_target(o, 1).collect()


def test_hierarchy_urban_rural_none(spark):
    addr = spark.createDataFrame([(1, "Казань г.о.", 3), (2, "Казань", 5), (3, "ул Мира", 8), (4, "Лаишевский", 2), (5, "Столбище", 6)], "objectid long, name string, level int")
    h = spark.createDataFrame([(1, "92701", "1"), (2, "9270100", "1.2"), (3, "", "1.2.3"), (4, "92634", "4"), (5, "92634444", "4.5"), (9, "", "8.9"), (10, None, "x.y")], "objectid long, oktmo string, path string")
    r = {x.objectid: tuple(x)[1:] for x in registry.mun_lookup(addr, h).collect()}
    assert r[3] == ("Казань г.о.", "92701", "Казань") and r[5] == ("Лаишевский", "92634", "Столбище") and r[9] == (None, None, None) and len(r) == 7


def test_house_wins_over_plot(spark):
    p = "objectid long, typeid int, value string"
    r = {x.cad_num: (x.objectid, x.source) for x in registry.cadnum_index(spark.createDataFrame([(5, 8, "a"), (4, 7, "a")], p), spark.createDataFrame([(1, 8, "a"), (2, 8, "b"), (3, 8, None)], p)).collect()}
    assert r == {"a": (5, "house"), "b": (2, "stead")}
    wide = registry.object_params(spark.createDataFrame([(1, 5, "420000")], p), spark.createDataFrame([], p)).first()
    assert (wide.oktmo_full, wide.okato, wide.postal_index) == (None, None, "420000")


def test_territory_can_be_repeated(spark):
    o = spark.createDataFrame([("a", "k1", None), ("b", None, "г Казань, Вахитовский район"), ("c", None, None)], "object_id string, cad_num string, readable_address string")
    index = spark.createDataFrame([("k1", 7, "house")], "cad_num string, objectid long, source string")
    lookup = spark.createDataFrame([(7, "город Казань", "92701", "Казань")], "objectid long, mun_okrug_name string, mun_okrug_oktmo string, settlement_name string")
    once = registry.municipality_features(o, index, lookup)
    twice = registry.municipality_features(once, index, lookup)
    assert once.columns == twice.columns and once.orderBy("object_id").collect() == twice.orderBy("object_id").collect()
    r = {x.object_id: x for x in once.collect()}
    assert r["a"].mun_source == "gar" and r["b"].mun_source == "address" and r["b"].mun_okrug_oktmo == "92701" and r["b"].intra_city_raion == "Вахитовский"
    assert r["c"].mun_okrug_name is None


def test_store_checks_and_replaces_only_what_it_writes(spark):
    base = scratch_path(spark, "store")
    o = spark.createDataFrame([("a", "house", 1.0, 2.0, "R"), ("b", "apartment", 1.0, 2.0, "R")], "object_id string, asset_class string, lat double, lon double, region string")
    sinks.save_objects(o, base)
    sinks.save_objects(readers.partitioned(spark, base, asset_class="house").selectExpr("concat(object_id, '!') as object_id", "asset_class", "lat", "lon", "region"), base)
    assert {r.object_id for r in spark.read.parquet(base).collect()} == {"a!", "b"}
    with pytest.raises(SchemaError):
        require_columns(o.drop("lat"), "lat double")
    with pytest.raises(SchemaError):
        sinks.save_objects(o.selectExpr("object_id", "asset_class", "cast(lat as string) lat", "lon", "region"), base)


def test_runs_are_found_by_exact_name_and_time(spark):
    from datetime import datetime

    base = scratch_path(spark, "runs")
    p = spark.createDataFrame([("a", 1.0, 2.0, 0, 1.0, 3.0)], "object_id string, lat double, lon double, fold_id long, y_true double, y_pred_oof double")
    sinks.log_run(spark, base, "res1", {}, {"mae": 1}, predictions=p, now=datetime(2025, 1, 1))
    sinks.log_run(spark, base, "res10", {}, {}, predictions=p.withColumn("y_pred_oof", p.y_pred_oof * 0), now=datetime(2026, 1, 1))
    assert len(readers.run_folders(spark, base, "res1")) == 1
    assert readers.latest_predictions(spark, base, ["res1"]).first().y_pred_oof == 3.0
    assert readers.latest_predictions(spark, base, ["res1", "res10"]).first().y_pred_oof == 0.0
    assert readers.latest_predictions(spark, base, ["none"]).count() == 0


def test_sequences_and_boundaries(spark):
    path = scratch_path(spark, "seq")
    text = '\x1e{"type":"Feature","properties":{"name":"Советский район"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}}\n\n{"properties":{"name":"x"},"geometry":null}\n'
    sinks.write_text(spark, f"{path}/a.geojsonseq", text)
    r = readers.named_polygons(spark, f"{path}/*").collect()
    assert [x.name for x in r] == ["Советский"] and readers.layer_geometries(spark, f"{path}/none*", "x").count() == 0
    sinks.write_text(spark, f"{path}/b.geojson", '{"type":"FeatureCollection","features":[{"properties":{"shapeISO":"RU-TA"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    assert readers.region_boundary(spark, f"{path}/b.geojson", "RU-TA").startswith("POLYGON")
    with pytest.raises(KeyError):
        readers.region_boundary(spark, f"{path}/b.geojson", "RU-XX")


def test_feature_columns_skip_identity_and_booleans(spark):
    o = spark.createDataFrame([("a", "house", 1.0, 2, True, "x", "8:1:1")], "object_id string, asset_class string, lat double, levels int, is_new boolean, materials string, parent_h3_p7 string")
    assert mlf.feature_columns(o) == (["levels"], ["materials"])


def test_folds(spark):
    o = spark.range(200).selectExpr("cast(id as string) object_id", f"{LAT} + (id % 20) * 0.02 as lat", f"{LON} + (id div 20) * 0.03 as lon")
    f = mlf.with_folds(o, 4, 7, seed=1)
    assert f.count() == 200 and f.select("fold_id").distinct().count() == 4
    same = mlf.with_folds(o.repartition(3), 4, 7, seed=1)
    assert sorted(map(tuple, f.select("object_id", "fold_id").collect())) == sorted(map(tuple, same.select("object_id", "fold_id").collect()))
    with pytest.raises(ValueError):
        mlf.fold_table(spark, ["a"], 2, 1)


def test_metrics_on_degenerate_rows(spark):
    d = spark.createDataFrame([("m", 0.0, 1.0), ("m", 2.0, 1.0), ("n", 0.0, 0.0)], "model string, y_true double, y_pred double")
    r = {x.model: x for x in d.groupBy("model").agg(*metrics.error_metrics()).collect()}
    assert r["m"].mape == 0.5 and r["n"].mape is None


def test_serving_refuses_unknown_names(spark):
    a = spark.createDataFrame([("8:1:1", 8, "house", 1)], "h3_index string, resolution int, asset_class string, count long")
    with pytest.raises(serving.BadRequest):
        serving.hex_values(a, 8, "castle", "count")
    with pytest.raises(serving.BadRequest):
        serving.hex_values(a, 8, "house", "nothing")
    assert serving.hex_values(a, 8, "house", "count").first().value == 1
    assert "water" in serving.describe("dist_to_water_m") and serving.feature_options(a)["features"][0]["name"] == "count"
    assert serving.market_reference(spark.createDataFrame([], "region_okato string, mestdom_code string, tipkvartir_code string, year long, rynzhel_code string, value_rub_per_m2 double"), "RU-XX", "apartment", 2025).count() == 0


def test_feature_build_end_to_end(spark):
    rows = [(str(i), ["apartment", "house", "commercial"][i % 3], LAT + i * 0.0005, LON, 5, 10, 1990, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))") for i in range(9)]
    o = spark.createDataFrame(rows, "object_id string, asset_class string, lat double, lon double, levels long, flats long, year_built long, polygon_wkt_3857 string")
    way = spark.createDataFrame([([{"lat": LAT, "lon": LON}, {"lat": LAT + 0.01, "lon": LON}],)], "geometry array<struct<lat: double, lon: double>>")
    stations = spark.createDataFrame([("s", LAT, LON)], "target string, lat double, lon double")
    pts = spark.createDataFrame([("school", LAT, LON)], "layer string, lat double, lon double")
    out = pipelines.object_features(o, pipelines.Layers(ways=way, stations=stations, entrances=stations, points=pts))
    r = {x.object_id: x for x in out.collect()}
    assert len(r) == 9 and r["0"].school_within_100m == 1 and r["0"].polygon_area_m2 == 100 and r["0"].era_category == "late_soviet"
    assert r["0"].dist_metro_m == 0 and "levels__rel_p8_z_iqr" in out.columns and r["0"].count_p7 >= 1


def test_reports_and_stores(spark):
    path = scratch_path(spark, "report")
    text = sinks.write_report(spark.createDataFrame([("a", 1), (None, 2)], "x string, n int"), path)
    assert text.splitlines()[0] == "| x | n |" and "|  | 2 |" in text
    sinks.write_text(spark, f"{path}-raw/a.txt", "é")
    assert readers.read_bytes(spark, f"{path}-raw/a.txt") == "é".encode()
    assert readers.list_keys(spark, f"{path}-raw").first().length == 2


def test_buildings_as_points(spark):
    path = scratch_path(spark, "buildings")
    sinks.write_text(spark, f"{path}/b.geojsonseq", '{"properties":{"@id":"way/7","building":"yes","building:levels":"3"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}}\n{"properties":{"@id":"node/8"},"geometry":{"type":"Point","coordinates":[1,1]}}')
    r = readers.building_points(spark, f"{path}/*").collect()
    assert [(x.osm_type, x.osm_id, x.lat, x.lon, x.levels, x.flats) for x in r] == [("way", "7", 1.0, 1.0, "3", None)]


def test_models_are_kept_and_found(spark):
    o = spark.range(120).selectExpr("cast(id as string) object_id", "'apartment' as asset_class", f"{LAT} + (id % 12) * 0.02 as lat", f"{LON} + (id div 12) * 0.03 as lon", "cast(id % 9 as bigint) levels", "case when id % 5 = 0 then null else 'brick' end materials", "cast(1000 + (id % 9) * 50 as double) synthetic_target_rub_per_m2")
    base = scratch_path(spark, "registry")
    models.train_and_log(o, base, "quartet-apartment", folds=2, iterations=3)
    model = models.load_latest(spark, base, "quartet-apartment")
    got = models.infer(model, o.drop("synthetic_target_rub_per_m2"))
    assert got.count() == 120 and got.where("y_pred is null").count() == 0
    assert readers.latest_predictions(spark, base, ["quartet-apartment"]).count() == 120
    with pytest.raises(FileNotFoundError):
        models.load_latest(spark, base, "quartet")


def test_trees_take_any_number_of_categories(spark):
    o = spark.range(1_200).selectExpr("CAST(id AS STRING) AS object_id", "55 + (id % 40) * 0.01 AS lat", "49 + (id % 30) * 0.01 AS lon", "concat('s', id % 401) AS settlement_name", "id % 9 AS levels", "(id % 401) * 100.0 + id % 9 AS synthetic_target_rub_per_m2")
    oof, table, _ = models.train_quartet(o, folds=2, iterations=3)
    assert oof.count() == 1_200 and {r.model for r in table.collect()} == set(models.QUARTET)
    fitted = models.grey(["levels"], ["settlement_name"], "y", wide=["settlement_name"]).fit(o.selectExpr("CAST(levels AS DOUBLE) AS levels", "settlement_name", "synthetic_target_rub_per_m2 AS y"))
    unseen = spark.createDataFrame([(1.0, "nowhere"), (1.0, "s3"), (1.0, "s390")], "levels double, settlement_name string")
    got = {r.settlement_name: r.y_pred for r in fitted.transform(unseen).collect()}
    assert got["s3"] < got["nowhere"] < got["s390"]
