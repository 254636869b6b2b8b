"""Scans and writers of annotation documents, predictions, snapshots, label lines and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.operators import annotations as ann

RING = "array<array<double>>"
COCO = f"""images array<struct<id:bigint,width:int,height:int,file_name:string>>,
annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,segmentation:{RING},bbox:array<double>,area:double,iscrowd:int>>,
categories array<struct<id:bigint,name:string>>"""
PREDICTION = "filename string, width int, height int, count int, instances array<struct<id:bigint,bbox:array<double>,polygon:array<struct<x:double,y:double>>,confidence:double>>, malformed string"
SNAPSHOT = "session_id string, request_id string, zone_id bigint, frame struct<png:binary,timestamp_ns:bigint,width:int,height:int,distortion:array<double>,tx:double,ty:double,tz:double>, angle double, coverage double"


CORRECTION = "session_id string, seq bigint, op string, request_id string, point_id bigint, zone_id bigint, position struct<x:double,y:double,z:double>, confidence double"
OPERATIONS = ("add", "delete", "rotate", "delete_zone", "delete_request", "reset")


def read_corrections(spark: SparkSession, path: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """Manual corrections as JSON lines, in the schema of all their kinds, and those of no known kind, session or number; fields that the schema hasn't are ignored."""
    rows = (spark.readStream if stream else spark.read).schema(CORRECTION).json(path)
    known = F.coalesce(F.col("op").isin(*OPERATIONS) & F.col("session_id").isNotNull() & F.col("seq").isNotNull(), F.lit(False))
    return rows.filter(known), rows.filter(~known)


def to_json_vector(*parts) -> Column:
    """A vector (x, y, z) or quaternion (x, y, z, w) of columns as JSON text."""
    return F.to_json(F.struct(*(F.lit(c).cast("double").alias(n) if not isinstance(c, Column) else c.cast("double").alias(n) for n, c in zip("xyzw", parts))))


def from_json_vector(text: Column, size: int = 3) -> Column:
    """Struct x, y, z (and w) of JSON text; null where it is none."""
    p = F.from_json(text, ", ".join(f"{n} double" for n in "xyzw"[:size]))
    return F.when(F.forall(F.array(*(p[n] for n in "xyzw"[:size])), lambda x: x.isNotNull()), p)


def read_annotations(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotations (image_id, ann, category, iscrowd, ring) of one JSON document a subset; one ring a row, subset from the path.

    Segmentations that are no lists read as null and give no ring; usable()
    drops crowds and short rings.
    """
    docs = spark.read.option("multiLine", True).schema(COCO).json(glob).withColumn("subset", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/annotations/[^/]*$", 1))
    images = docs.select("subset", F.inline("images"))
    categories = docs.select("subset", F.inline("categories")).withColumnRenamed("id", "category_id").withColumnRenamed("name", "category")
    rows = docs.select("subset", F.inline("annotations")).join(categories, ["subset", "category_id"], "left")
    rings = rows.select("subset", "image_id", F.col("id").alias("ann"), "category", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"), F.posexplode_outer("segmentation").alias("part", "ring"))
    return images, rings


def subsets(spark: SparkSession, root: str) -> DataFrame:
    """subset, usable: child folders with annotations, and whether they have images too."""
    files = listing(spark, root).withColumn("subset", F.regexp_extract("path", r"([^/]+)/(?:images/default|annotations)/[^/]+$", 1)).filter("subset <> ''")
    has = files.groupBy("subset").agg(F.max(F.col("path").endswith("annotations/instances_default.json")).alias("a"), F.max(F.col("path").contains("/images/default/")).alias("i"))
    return has.filter("a or i").select("subset", (F.col("a") & F.col("i")).alias("usable"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length of all files below root; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """Files whose extension is an image's, in any case."""
    return listing(spark, root).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*ann.EXTENSIONS))


def training_pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """stem, image, mask of images and masks (path) of one stem."""
    a = images.select(ann.stem(F.col("path")).alias("stem"), F.col("path").alias("image"))
    return a.join(masks.select(ann.stem(F.col("path")).alias("stem"), F.col("path").alias("mask")), "stem")


def parse_predictions(bodies: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """Predictions of JSON bodies, and the malformed ones with their first 2000 characters."""
    schema = PREDICTION
    p = bodies.withColumn("p", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}))
    bad = F.col("p").isNull() | F.col("p.malformed").isNotNull() | F.col("p.filename").isNull()
    return p.filter(~bad).select("p.*").drop("malformed"), p.filter(bad).select(F.substring(column, 1, 2000).alias("body"))


def read_snapshots(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Snapshot uploads as JSON lines; fields that the schema hasn't are ignored."""
    return (spark.readStream if stream else spark.read).schema(SNAPSHOT).json(path)


def audit(snapshots: DataFrame) -> DataFrame:
    """Snapshots as JSON text without image bytes and lens coefficients."""
    slim = snapshots.withColumn("frame", F.col("frame").dropFields("png", "distortion"))
    return slim.select("session_id", "request_id", F.to_json(F.struct(*slim.columns)).alias("json"))


def consistent(snapshots: DataFrame, header: str = "header_session") -> tuple[DataFrame, DataFrame]:
    """Snapshots whose session is blank or the header's, which must be there; and the others."""
    ok = F.col(header).isNotNull() & (F.col(header) != "") & (F.coalesce(F.trim("session_id"), F.lit("")).isin("") | (F.col("session_id") == F.col(header)))
    return snapshots.filter(ok), snapshots.filter(~F.coalesce(ok, F.lit(False)))


def write_annotations(images: DataFrame, rows: DataFrame, path: str, category: str = "object") -> None:
    """One annotation document a folder (images: folder, id, width, height, file_name; rows: folder, id, image_id, segmentation, bbox, area)."""
    a = rows.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("id", "image_id", F.lit(1).alias("category_id"), "segmentation", "bbox", "area", F.lit(0).alias("iscrowd")))).alias("annotations"))
    i = images.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("id", "width", "height", "file_name"))).alias("images"))
    fixed = F.lit(None).cast("array<struct<id:int,name:string>>")
    body = F.struct(F.coalesce(fixed, F.array()).alias("licenses"), F.struct(F.lit("1.0").alias("version")).alias("info"), F.array(F.struct(F.lit(1).alias("id"), F.lit(category).alias("name"))).alias("categories"), "images", F.coalesce("annotations", F.array()).alias("annotations"))
    i.join(a, "folder", "left").select("folder", F.to_json(body).alias("value")).write.mode("overwrite").partitionBy("folder").text(path)


def write_label_lines(lines: DataFrame, path: str) -> None:
    """One text a split and image: lines has split, image, det, line."""
    text = lines.groupBy("split", "image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("det", "line"))), lambda x: x["line"]), "\n").alias("value"))
    text.write.mode("overwrite").partitionBy("split", "image").text(path)


def write_predictions(predictions: DataFrame, path: str, run_id: str) -> None:
    """One JSON an image and run: writing a run again replaces it."""
    predictions.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "image_id").json(path)


def write_report(metrics: dict[str, DataFrame], path: str, **settings) -> None:
    """One JSON of one-row metric tables by name, and settings."""
    out = None
    for name, df in metrics.items():
        row = df.select(F.struct(*df.columns).alias(name))
        out = row if out is None else out.crossJoin(row)
    for k, x in settings.items():
        out = out.withColumn(k, F.lit(x))
    out.coalesce(1).write.mode("overwrite").json(path)
