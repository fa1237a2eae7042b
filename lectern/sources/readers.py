"""Input files as DataFrames, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model

# Upload rules.
MAX_FILE_BYTES = 50 * 1024 * 1024
CATEGORIES = ("chuyen_nganh_dao_tao", "quy_che_hoc_vu", "huong_dan_thu_tuc", "thong_bao_ke_hoach")

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def landed_files(spark: SparkSession, folder: str, streaming: bool = False, per_trigger: int = 1,
                 pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """Files under ``folder/<category>/`` with name and category; content is read on use."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern)
    # Category folders are one level down and are data, not partitions.
    reader = reader.option("recursiveFileLookup", "true")
    if streaming:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    files = reader.load(folder)
    return files.select(
        "*",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"),
    )


def rejection(name: Column, category: Column, size: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Why an upload is refused, null if it is accepted."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit("File name is missing"))
        .when(~F.coalesce(category, F.lit("")).isin(*CATEGORIES), F.lit("Invalid category"))
        .when(~F.endswith(F.lower(name), F.lit(".pdf")), F.lit("Only PDF files are allowed"))
        .when(size > max_bytes, F.lit("File exceeds 50MB limit"))
    )


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each: ``(doc_id, file_name, text)``."""
    raw = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return raw.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), name.alias("file_name"),
        F.col("value").alias("text"),
    )


def regulation_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file: ``(doc_id, reg)``; missing metadata becomes empty."""
    raw = spark.read.schema(model.REGULATION).option("multiLine", True).json(path)
    meta = F.coalesce("metadata", F.struct(F.lit(None).cast("string").alias("ten_file")))
    fields = [meta.alias("metadata"), *[F.col(f) for f in model.REGULATION.names[1:]]]
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.struct(*fields).alias("reg"))


def edge_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Allowed edge types from a CSV of ``(:Label),[:TYPE],(:Label),meaning`` rows."""
    schema = "source string, relation string, target string, meaning string"
    return parse_catalogue(spark.read.schema(schema).option("header", True).option("escape", '"').csv(path))


def parse_catalogue(rows: DataFrame) -> DataFrame:
    label = lambda c: F.regexp_extract(c, r"\(:(\w+)\)", 1)
    return rows.select(
        label("source").alias("source_label"),
        F.regexp_extract("relation", r"\[:(\w+)\]", 1).alias("type"),
        label("target").alias("target_label"),
        "meaning",
    )


def chat_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.CHAT_REQUEST).json(path)
