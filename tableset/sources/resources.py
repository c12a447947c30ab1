"""Scan of a resource tree into rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableset.functions.names import META_SUFFIX, split_meta_name, split_resource_name
from tableset.schemas import INCLUDE

# The glob is case-sensitive, the extension is not.
_JSON_GLOB = "*.[jJ][sS][oO][nN]"
_FILES = "path STRING, file_name STRING, content STRING"


def read_files(spark: SparkSession, directory: str) -> DataFrame:
    """All JSON files below a directory, one row each; a missing directory is empty."""
    # Whole files as bytes: their paths come as they are, not URL-encoded.
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _JSON_GLOB)
    )
    try:
        files = reader.load(directory)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _FILES)
    names, files = listed(files), files.select("path", F.col("content").cast("string").alias("content"))
    # Spark's readers leave out files without content.
    empty = names.join(files.select("path"), "path", "left_anti").select("path", F.lit("").alias("content"))
    return files.unionByName(empty).select("path", F.substring_index("path", "/", -1).alias("file_name"), "content")


def listed(files: DataFrame) -> DataFrame:
    """Paths of all files that a reader has listed. They stay in the JVM, however many there are."""
    spark, jvm = files.sparkSession, files.sparkSession.sparkContext._jvm
    paths = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles())
    encoded = DataFrame(spark._jsparkSession.createDataset(paths, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    # Listed paths are URL-encoded, and a plus sign is a plus sign.
    path = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    return encoded.select(F.regexp_replace(path, "^file:///", "file:/").alias("path"))


def parse_files(files: DataFrame) -> DataFrame:
    """Add ``kind`` (resource or meta), ``identifier``, ``env`` and ``valid`` from the file name."""
    is_meta = F.lower("file_name").endswith(META_SUFFIX)
    parts = F.when(is_meta, split_meta_name(F.col("file_name"))).otherwise(
        split_resource_name(F.col("file_name"))
    )
    return (
        files.withColumn("_parts", parts)
        .withColumn("kind", F.when(is_meta, F.lit("meta")).otherwise(F.lit("resource")))
        .withColumn("identifier", F.col("_parts.head"))
        .withColumn("env", F.col("_parts.tail"))
        .withColumn("valid", F.col("_parts.valid"))
        .drop("_parts")
    )


def read_resources(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, skipped)``: files with a proper name, and the paths of the others."""
    parsed = parse_files(read_files(spark, directory))
    return parsed.filter("valid").drop("valid"), parsed.filter("NOT valid").select("path", "file_name")


def read_includes(spark: SparkSession, directory: str) -> DataFrame:
    """Include texts by their path below the directory, without the extension."""
    files = read_files(spark, directory)
    root = directory.rstrip("/").split("://")[-1].split(":", 1)[-1]
    name = F.regexp_replace(F.substring_index(F.col("path"), f"{root}/", -1), r"\.json\z", "")
    return files.select(name.alias("name"), "content").select(*INCLUDE.names)
