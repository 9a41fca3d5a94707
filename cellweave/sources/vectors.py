"""Point and feature tables from files with changing schemas."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.projection import to_utm43n
from cellweave.operators.geometry import centroid, valid_geometry
from cellweave.session import stored

# Candidate column names.
LATITUDE_NAMES = ["lat", "latitude", "y"]
LONGITUDE_NAMES = ["lon", "longitude", "long", "x"]
LITHOLOGY_NAMES = [
    "LITHOLOGY", "lithology", "LITHO", "litho", "ROCK_TYPE",
    "rock_type", "FORMATION", "formation", "UNIT", "unit",
]
LITHOLOGY_PARTS = ["lith", "rock", "form", "unit", "geol"]
TYPE_NAMES = [
    "deposit_type", "DEPOSIT_TYPE", "type", "TYPE",
    "commodity", "COMMODITY", "mineral", "MINERAL",
]
OCCURRENCE_WORDS = ["mine", "quarry", "mineral", "occurrence"]


def resolve_column(columns: Sequence[str], candidates: Sequence[str], parts: Sequence[str] = ()) -> str | None:
    """First candidate that exists, else the first column containing one of the parts."""
    for name in candidates:
        if name in columns:
            return name
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def coordinate_columns(columns: Sequence[str]) -> tuple[str, str] | None:
    """(longitude, latitude) columns by name, ignoring case; None unless both exist."""
    lat = next((c for c in columns if c.lower() in LATITUDE_NAMES), None)
    lon = next((c for c in columns if c.lower() in LONGITUDE_NAMES), None)
    return (lon, lat) if lat and lon else None


def point_geometry(x: Column, y: Column) -> Column:
    vertex = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(F.array(vertex)).alias("parts")))


def read_csv_points(spark: SparkSession, path: str, project: bool = True) -> DataFrame | None:
    """CSV points with a `geom` column (projected unless told otherwise).

    None when the file has no coordinate columns.  Malformed lines are set aside by the
    permissive mode, not fatal.
    """
    table = spark.read.option("header", True).option("inferSchema", True).option("mode", "PERMISSIVE").csv(path)
    found = coordinate_columns(table.columns)
    if found is None:
        return None
    lon, lat = (F.expr(f"try_cast(`{c}` AS double)") for c in found)
    if not project:
        return table.withColumn("geom", point_geometry(lon, lat))
    point = to_utm43n(lon, lat)
    return table.withColumn("geom", point_geometry(point["x"], point["y"]))


def deposit_column(df: DataFrame, wanted: str) -> Column:
    """The deposit type column, one of its usual names, or the constant `unknown`."""
    name = resolve_column(df.columns, [wanted, *TYPE_NAMES])
    return F.col(name) if name else F.lit("unknown")


def lithology_column(df: DataFrame) -> str | None:
    return resolve_column([c for c in df.columns if c != "geom"], LITHOLOGY_NAMES, LITHOLOGY_PARTS)


def is_occurrence_layer(name: str) -> bool:
    return any(word in name.lower() for word in OCCURRENCE_WORDS)


def union_layers(layers: dict[str, DataFrame], occurrence_folder: Sequence[str] = ()) -> DataFrame | None:
    """Occurrence points of all layers: `source`, centroid geometry, no empty geometry.

    Layers from the occurrence folder always count, others by their name.
    """
    used = {n: df for n, df in layers.items() if n in occurrence_folder or is_occurrence_layer(n)}
    combined = None
    for name, df in used.items():
        tagged = df.withColumn("source", F.lit(name))
        combined = tagged if combined is None else combined.unionByName(tagged, allowMissingColumns=True)
    if combined is None:
        return None
    return valid_geometry(combined).withColumn("_c", centroid(F.col("geom"))).withColumn(
        "geom", point_geometry(F.col("_c.x"), F.col("_c.y"))
    ).drop("_c")


def read_tolerant(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Read many files as one table, leaving out files that turn out corrupt; `file_status` names them."""
    reader = spark.read.format(fmt).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).load(list(paths))


#: A Parquet file without rows is hardly more than its footer; rowless files beyond this size are broken ones.
FOOTER_BYTES = 16 << 20


def _footer_message(batches):
    """Why a Parquet file gave no row; an empty message where it holds none."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    def why(content: bytes) -> str:
        try:
            held = pq.read_metadata(pa.BufferReader(content)).num_rows
        except Exception as error:  # the report is the result
            return f"no valid footer: {str(error).splitlines()[0][:150]}"
        return f"none of {held} rows can be read with this schema" if held else ""

    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "_why": [why(c) for c in batch["content"]]})


def file_status(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """`path, n_rows, ok, message`: one row for each file below `paths`, read by the cluster with all columns of `schema`.

    A Parquet file without rows is fine where its footer counts none. In other formats a file that gives no row is
    not ok. Files of zero bytes are not listed, as Spark's readers pass them over. Truncated files and files of another format have no valid footer, and files whose columns do not
    fit the schema say how many rows they hold; only the content of rowless files is looked at for that. With
    json or csv and a schema, records that do not parse are counted. A column that a Parquet file lacks reads as null.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    checked = fmt in ("json", "csv") and schema is not None
    rows = read_tolerant(spark, paths, fmt, f"{schema}, _corrupt_record string" if checked else schema)
    names = [F.col(f"`{c}`") for c in rows.columns if c != "_corrupt_record"]
    corrupt = F.count("_corrupt_record") if checked else F.lit(0)
    # The hash makes the scan decode every column; a bare count would be answered by the footers alone.
    found = rows.groupBy(F.input_file_name().alias("_file")).agg(F.count("*").alias("_n"), corrupt.alias("_corrupt"), F.max(F.xxhash64(*names)).alias("_read"))
    place = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    joined = listed.select("path", "length").join(found.where(F.col("_read").isNotNull()), place(F.col("path")) == place(F.col("_file")), "left")
    n = F.coalesce("_n", F.lit(0))
    status = stored(joined.select("path", "length", n.alias("n_rows"), F.coalesce("_corrupt", F.lit(0)).alias("_corrupt")), "files")
    if fmt == "parquet":
        rowless = status.where((F.col("n_rows") == 0) & (F.col("length") <= FOOTER_BYTES)).select("path")
        said = listed.where(F.col("length") <= FOOTER_BYTES).join(rowless, "path", "left_semi").select("path", "content")
        status = status.join(said.mapInPandas(_footer_message, "path string, _why string"), "path", "left")
    else:
        status = status.withColumn("_why", F.lit(None).cast("string"))
    message = (
        F.when(F.col("_corrupt") > 0, F.concat(F.col("_corrupt").cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" records do not fit the schema")))
        .when(F.col("n_rows") > 0, "")
        .otherwise(F.coalesce("_why", F.lit("no row can be read")))
    )
    return status.withColumn("message", message).select("path", "n_rows", (F.col("message") == "").alias("ok"), "message")


def read_layers(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options) -> tuple[dict[str, DataFrame], DataFrame]:
    """Layers with schemas of their own: the readable ones by path, and a status table `path, ok, message`.

    Only the schemas are looked at here, a few files at a time; rows are read when a layer is used.
    """

    def one(path: str) -> tuple[str, DataFrame | None, str]:
        try:
            df = spark.read.options(**options).format(fmt).load(path)
            return path, df, "" if df.schema is not None else "no schema"
        except Exception as error:  # the report is the result
            return path, None, str(error).splitlines()[0][:200]

    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(one, paths))
    status = [(path, df is not None, message) for path, df, message in found]
    return {path: df for path, df, _ in found if df is not None}, spark.createDataFrame(status, "path string, ok boolean, message string")
