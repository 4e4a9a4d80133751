"""Files to tables. JSON arrives as whole documents, CSV as strings; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions import weather as Wx

TRACK_FIELDS = (
    "hex string, flight string, r string, t string, type string, lat double, lon double, alt_baro string, "
    "alt_geom double, gs double, tas double, ias double, track double, true_heading double, mag_heading double, "
    "dir double, baro_rate double, geom_rate double, squawk string"
)
METAR_FIELDS = (
    "icaoId string, lat double, lon double, visib string, wdir string, wspd string, clouds array<struct<cover:string,base:double>>"
)
READING_SCHEMA = (
    "struct<current:struct<temperature_2m:double,wind_speed_10m:double,wind_direction_10m:double,pressure_msl:double>,"
    "utc_offset_seconds:int>"
)


def read_documents(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """One row per file: document_id, fetched_at (the file's time), body. The schema is fixed, so it also streams."""
    reader = spark.readStream if streaming else spark.read
    files = reader.format("text").option("wholetext", "true").load(path)
    return files.select(
        F.xxhash64("_metadata.file_path").alias("document_id"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("value").alias("body"),
    )


def json_list(text: Column) -> Column:
    """The elements of a JSON array as texts; NULL for any other root. One bad element spoils no other."""
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))


def is_object(text: Column) -> Column:
    return text.rlike(r"^\s*\{")


def parse_snapshots(documents: DataFrame, *, body: str = "body") -> DataFrame:
    """Track documents to raw tracks with their feed position.

    The list is under ``ac``, else ``aircraft``. Bad JSON and missing lists give no rows, an element
    that is no object gives none either, and a field of the wrong type counts as absent.
    """
    others = [c for c in documents.columns if c != body]
    lists = F.from_json(body, "struct<ac:string,aircraft:string>")
    parsed = documents.select(*others, lists.alias("_d")).select(*others, F.coalesce(json_list(F.col("_d.ac")), json_list(F.col("_d.aircraft"))).alias("_l"))
    listed = parsed.select(*others, F.posexplode("_l").alias("feed_pos", "_t")).filter(is_object(F.col("_t")))
    return listed.select(*others, "feed_pos", F.from_json("_t", TRACK_FIELDS).alias("_t")).select(*others, "feed_pos", "_t.*")


def read_track_snapshots(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """One file is one poll: snapshot_id, fetched_at, feed_pos and the raw fields."""
    documents = read_documents(spark, path, streaming=streaming).withColumnRenamed("document_id", "snapshot_id")
    return parse_snapshots(documents)


def parse_metar(documents: DataFrame, *, body: str = "body") -> DataFrame:
    """Station reports: the root must be an array, and elements that are no objects are skipped."""
    others = [c for c in documents.columns if c != body]
    rows = documents.select(*others, F.posexplode(json_list(F.col(body))).alias("feed_pos", "_m")).filter(is_object(F.col("_m")))
    token = F.regexp_extract("_m", r'"visib"\s*:\s*("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*)', 1)
    read = rows.select(*others, "feed_pos", F.from_json("_m", METAR_FIELDS).alias("_r"), token.alias("_v"))
    visib = F.when(F.length("_v") > 0, Wx.rounded_number(F.col("_v"))).otherwise(F.col("_r.visib"))
    fields = [visib.alias("visib") if c.split()[0] == "visib" else F.col(f"_r.{c.split()[0]}") for c in METAR_FIELDS.split(", ")]
    return read.select(*others, "feed_pos", *fields)


def read_metar(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """JSON arrays of station reports with document and place; ``visib`` is kept as text, a JSON number rounded half up."""
    return parse_metar(read_documents(spark, path, streaming=streaming))


def parse_point_weather(documents: DataFrame, *, body: str = "body") -> DataFrame:
    """Site documents to readings; documents without a temperature stay, as ``valid`` = false."""
    doc = F.from_json(body, READING_SCHEMA)
    others = [c for c in documents.columns if c != body]
    read = documents.select(*others, doc.alias("_d"))
    return read.select(
        *others,
        F.col("_d.current.temperature_2m").alias("temp_f"),
        F.col("_d.current.wind_speed_10m").alias("wind_kts"),
        F.col("_d.current.wind_direction_10m").alias("wind_deg_from"),
        Wx.hpa_to_inhg("_d.current.pressure_msl").alias("baro_inhg"),
        F.col("_d.utc_offset_seconds").alias("utc_offset_sec"),
        F.col("_d.current.temperature_2m").isNotNull().alias("valid"),
    )


def read_point_weather(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """One file is one site's reading; the site is the file name without its suffix."""
    reader = spark.readStream if streaming else spark.read
    files = reader.format("text").option("wholetext", "true").load(path)
    documents = files.select(
        F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1).alias("site_id"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("value").alias("body"),
    )
    return parse_point_weather(documents)


#: Holds the text of a CSV record that does not fit its header.
CORRUPT = "_corrupt_record"


def numbered_rows(rows: DataFrame, *, name: str = "row_no") -> DataFrame:
    """File rows with their number in order of file name and place, over any number of files and splits.

    Ids grow within a split. Rows are counted by split, and a running sum over the splits (one row each)
    gives every split its first number.
    """
    placed = rows.select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = placed.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = placed.join(offsets, ["_file", "_start"])
    return joined.withColumn(name, F.col("_before") + F.col("_id") - F.col("_first")).drop("_file", "_start", "_id", "_first", "_before")


def read_airport_csvs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """airports, runways and navaids as strings, with ``row_no`` in file order.

    Each is a CSV file or a folder of them, all with one header. Records may span lines. A record with too few
    or too many fields keeps its text in ``_corrupt_record``; see :func:`split_corrupt`.
    """

    def read(name: str) -> DataFrame:
        def reader() -> DataFrameReader:
            return spark.read.option("header", True).option("multiLine", True).option("escape", '"')

        columns = reader().csv(f"{folder}/{name}.csv").columns
        schema = ", ".join(f"`{c}` string" for c in [*columns, CORRUPT])
        rows = reader().schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(f"{folder}/{name}.csv")
        # Spark refuses to read the corrupt records alone, so they are made to need another column too.
        marked = F.coalesce(CORRUPT, F.when(F.col(f"`{columns[0]}`") == "\0", ""))
        return numbered_rows(rows).withColumn(CORRUPT, marked)

    return {name: read(name) for name in ("airports", "runways", "navaids")}


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole records, and the others as row_no, first_field, record and reason for the quarantine."""
    good = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = rows.filter(F.col(CORRUPT).isNotNull())
    return good, bad.select(
        "row_no", F.col(rows.columns[0]).alias("first_field"), F.col(CORRUPT).alias("record"), F.lit("fields do not fit the header").alias("reason")
    )


def parse_features(texts: DataFrame, layer: str, *, body: str = "value") -> DataFrame:
    """GeoJSON features, one per row, to feature_id, layer, part, area, points.

    Lines and multi-lines give polylines; polygons and multi-polygons give their outer rings of four
    or more points; holes and other geometry types are skipped.
    """
    shell = "struct<properties:struct<area:double>,geometry:struct<type:string,coordinates:string>>"
    kind, text = F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")
    path, paths = "array<array<double>>", "array<array<array<double>>>"

    def when(name: str, value: Column) -> Column:
        return F.when(kind == name, value)

    lines = F.coalesce(when("LineString", F.array(F.from_json(text, path))), when("MultiLineString", F.from_json(text, paths)))
    outer = F.coalesce(
        when("Polygon", F.slice(F.from_json(text, paths), 1, 1)),
        when(
            "MultiPolygon",
            F.transform(
                F.filter(F.from_json(text, f"array<{paths}>"), lambda polygon: F.size(polygon) > 0),
                lambda polygon: F.element_at(polygon, 1),
            ),
        ),
    )
    chains = F.coalesce(lines, F.filter(outer, lambda ring: F.size(ring) >= 4))
    parsed = texts.select(F.xxhash64(body).alias("feature_id"), F.from_json(body, shell).alias("_f"))
    exploded = parsed.select("feature_id", F.col("_f.properties.area").alias("area"), F.posexplode(chains).alias("part", "_c"))
    points = F.transform("_c", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return exploded.select("feature_id", F.lit(layer).alias("layer"), "part", "area", points.alias("points"))


def read_features(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """GeoJSON text lines, one feature per line."""
    return parse_features(spark.read.text(path), layer)
