import json

from pyspark.sql import functions as F

from cellweave.sources import inventory, rasters, runs, vectors


def test_inventory_counts_and_incremental_skip(spark, tmp_path):
    for name in ("mag/a/tmi.TIF", "mag/grid.asc", "geo/fault.shp", "geo/fault.dbf", "geo/deep/x.gpkg", "readme.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    files = inventory.file_inventory(spark, str(tmp_path))
    counts = {r["dataset"]: (r["n_files"], r["n_rasters"], r["n_vectors"]) for r in inventory.inventory_counts(files).collect()}
    assert counts == {"mag": (2, 2, 0), "geo": (3, 0, 2), "": (1, 0, 0)}
    assert {r["stem"] for r in files.collect()} == {"tmi", "grid", "fault", "x", "readme"}
    done = spark.createDataFrame([("tmi",), ("fault",)], "stem string")
    assert {r["stem"] for r in inventory.skip_done(files.where("class <> 'other'"), done).collect()} == {"grid", "x"}


def test_layer_matching(spark):
    stems = ["fault_fold_25k", "shear_dist", "fault_a", "dike_1", "dyke_2", "tmi_norm_1vd", "tmi_norm"]
    files = spark.createDataFrame([(f"d/{s}.tif", s) for s in stems], "path string, stem string")
    channels = [("fault", ["fault"], ["fold", "shear"]), ("dyke", ["dyke", "dike"], []), ("tmi", ["tmi_norm"], ["1vd"]), ("kde", ["kde"], [])]
    got = {r["channel"]: r["path"] for r in inventory.best_match_layer(files, channels).collect()}
    assert got == {"fault": "d/fault_a.tif", "dyke": "d/dyke_2.tif", "tmi": "d/tmi_norm.tif"}


def test_band_round_trip_and_pruning(spark, tmp_path):
    rows = [(r, c, b, None if (r, c) == (1, 1) else float(r + c)) for b in ("k", "u") for r in range(3) for c in range(3)]
    long = spark.createDataFrame(rows, "row bigint, col bigint, band string, value double")
    path = str(tmp_path / "bands")
    rasters.write_bands(long, path, rows_per_block=2)
    raw = spark.read.parquet(path)
    assert raw.where("value = -9999.0").count() == 2 and raw.schema["value"].dataType.simpleString() == "float"
    back = rasters.read_bands(spark, path)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in long.select("row", "col", "band", "value").collect()}
    plan = raw.where("band = 'k' AND row_block = 0")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(band" in plan
    kept = str(tmp_path / "nan")
    rasters.write_bands(long, kept, nodata=None)
    assert spark.read.parquet(kept).where("value IS NULL").count() == 2


def test_sentinels(spark):
    df = spark.createDataFrame([(0, -9999.0), (1, float("nan")), (2, None), (3, 4.0)], "row int, v double")
    assert [r["v"] for r in rasters.nodata_to_null(df, ["v"]).orderBy("row").collect()] == [None, None, None, 4.0]
    assert [r["v"] for r in rasters.nodata_to_zero(df, ["v"]).orderBy("row").collect()] == [0.0, 0.0, 0.0, 4.0]
    assert [r["v"] for r in rasters.nodata_to_null(df.where("row = 0"), ["v"], None).collect()] == [-9999.0]


def test_csv_points(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("name,Longitude,LAT\na,75.0,0\nb,oops,1\n")
    df = vectors.read_csv_points(spark, str(good))
    rows = {r["name"]: r["geom"] for r in df.collect()}
    assert rows["a"]["parts"][0][0]["x"] == 500000.0 and rows["b"] is None
    flat = tmp_path / "flat.csv"
    flat.write_text("name,north\na,1\n")
    assert vectors.read_csv_points(spark, str(flat)) is None


def test_column_resolution(spark):
    df = spark.createDataFrame([("x", "y", "z")], "gid string, formation string, lithologic string")
    assert vectors.lithology_column(df) == "formation"
    assert vectors.lithology_column(df.select("gid", "lithologic")) == "lithologic"
    assert vectors.lithology_column(df.select("gid")) is None
    assert df.withColumnRenamed("gid", "COMMODITY").select(vectors.deposit_column(df.withColumnRenamed("gid", "COMMODITY"), "kind")).first()[0] == "x"
    assert df.select(vectors.deposit_column(df, "kind")).first()[0] == "unknown"


def test_bad_files_are_reported_and_skipped(spark, tmp_path):
    good, bad = str(tmp_path / "good.parquet"), tmp_path / "bad.parquet"
    spark.range(4).write.parquet(good)
    bad.write_bytes(b"PAR1 not parquet at all PAR1")
    layers, status = vectors.read_layers(spark, [good, str(bad)])
    assert list(layers) == [good] and {r["path"]: r["ok"] for r in status.collect()} == {good: True, str(bad): False}
    assert vectors.read_tolerant(spark, [good, str(bad)], schema="id bigint").count() == 4


def test_union_of_layers(spark):
    point = vectors.point_geometry(F.lit(1.0), F.lit(2.0))
    a = spark.range(2).withColumn("geom", F.when(F.col("id") == 0, point)).withColumn("kind", F.lit("q"))
    b = spark.range(3).withColumn("geom", point)
    got = vectors.union_layers({"old_mines": a, "faults": b, "survey": b}, occurrence_folder=["survey"])
    assert {(r["source"], r["n"]) for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()} == {("old_mines", 1), ("survey", 3)}
    assert vectors.union_layers({"faults": b}) is None


def test_run_files_and_sinks(spark, tmp_path):
    logs = tmp_path / "runs"
    for fold in range(2):
        folder = logs / f"fold{fold}"
        folder.mkdir(parents=True)
        document = {"variant": "A1", "fold": fold, "log": [{"epoch": e, "auc_pr": 0.1 * e} for e in range(3)]}
        (folder / "metrics.json").write_text(json.dumps(document, indent=2))
    epochs = runs.read_epochs(spark, str(logs), "variant", "fold")
    assert epochs.count() == 6 and set(epochs.columns) == {"variant", "fold", "epoch", "auc_pr"}

    profile = spark.createDataFrame([("a", 1.23456)], "name string, v double")
    inventory.write_summary(profile, str(tmp_path / "summary"))
    assert json.loads(spark.read.text(str(tmp_path / "summary")).first()[0]) == {"name": "a", "v": 1.23456}
    inventory.write_csv(profile, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["v"] == "1.2346"
    inventory.write_manifest(profile, str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).first()["v"] == 1.23456
    inventory.write_document(spark, {"width_px": 3}, str(tmp_path / "extent"))
    assert spark.read.json(str(tmp_path / "extent")).first()["width_px"] == 3


def test_vector_profile(spark):
    point = vectors.point_geometry(F.col("id").cast("double"), F.lit(2.0))
    df = spark.range(4).withColumn("layer", F.lit("l")).withColumn("geom", point)
    row = inventory.vector_profile(df, ["layer"]).first()
    assert row["features"] == 4 and row["geom_type"] == {"Point": 4} and row["columns"] == ["id", "geom"]
    assert (row["minx"], row["maxx"], row["miny"]) == (0.0, 3.0, 2.0)


def test_file_status_tells_empty_truncated_and_wrong_files_apart(spark, tmp_path):
    schema = "a bigint, b string"
    whole = spark.createDataFrame([(k, f"t{k}") for k in range(50)], schema).coalesce(1)
    whole.write.parquet(str(tmp_path / "good"))
    whole.where("a < 0").write.parquet(str(tmp_path / "empty"))
    whole.selectExpr("named_struct('x', a) as a", "b").write.parquet(str(tmp_path / "wrong"))
    (tmp_path / "cut").mkdir()
    content = next((tmp_path / "good").glob("part-*.parquet")).read_bytes()
    (tmp_path / "cut" / "part-0.parquet").write_bytes(content[: len(content) // 2])
    names = ["good", "empty", "wrong", "cut"]
    status = vectors.file_status(spark, [str(tmp_path / n) for n in names], schema=schema).collect()
    got = {n: r for n in names for r in status if f"/{n}/" in r["path"]}
    assert len(status) == 4
    assert (got["good"]["n_rows"], got["good"]["ok"], got["good"]["message"]) == (50, True, "")
    assert (got["empty"]["n_rows"], got["empty"]["ok"]) == (0, True)
    assert not got["wrong"]["ok"] and got["wrong"]["message"].startswith("none of 50 rows")
    assert not got["cut"]["ok"] and got["cut"]["message"].startswith("no valid footer")


def test_file_status_counts_records_that_do_not_parse(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    (tmp_path / "b.json").write_text('{"a": 1}\n')
    (tmp_path / "c.json").write_text("")
    status = {r["path"].rsplit("/", 1)[1]: r for r in vectors.file_status(spark, [str(tmp_path)], "json", "a bigint").collect()}
    assert status["a.json"]["message"] == "1 of 3 records do not fit the schema" and not status["a.json"]["ok"]
    assert status["b.json"]["ok"] and status["b.json"]["n_rows"] == 1
    assert set(status) == {"a.json", "b.json"}  # Spark does not list files of zero bytes


def test_known_schema_of_run_files_spares_the_pass_that_infers_it(spark, tmp_path):
    rows = spark.createDataFrame([(k, [(e, k + e / 4) for e in range(k)]) for k in range(4)], "run long, log array<struct<epoch: long, auc_pr: double>>")
    path = str(tmp_path / "logs")
    runs.write_metrics(rows, path, "run")
    assert len([f for f in (tmp_path / "logs").glob("*.json") if f.stat().st_size]) == 4  # Spark's first task leaves an empty file
    assert runs.read_metrics(spark, path, "run bigint").count() == 4
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("known schema", "reading")
    epochs = runs.read_epochs(spark, path, "run", schema="run bigint, log array<struct<epoch: bigint, auc_pr: double>>")
    assert not jobs.getJobIdsForGroup("known schema")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, epochs.collect())) == [(k, e, k + e / 4) for k in range(4) for e in range(k)]
