"""Schemas of the DataFrames that move between operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Place within a document: compared number by number.
ORDER = T.ArrayType(T.LongType())
PROPS = T.MapType(T.StringType(), T.StringType())

NODES = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("props", PROPS),
    T.StructField("doc_id", T.StringType()),
    T.StructField("seq", ORDER),
])

EDGES = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("props", PROPS),
    T.StructField("doc_id", T.StringType()),
    T.StructField("seq", ORDER),
])

POINT = T.StructType([
    T.StructField("ky_hieu", T.StringType()),
    T.StructField("noi_dung", T.StringType()),
])
CLAUSE = T.StructType([
    T.StructField("so", T.StringType()),
    T.StructField("noi_dung", T.StringType()),
    T.StructField("cac_diem", T.ArrayType(POINT)),
])
ARTICLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("tieu_de", T.StringType()),
    T.StructField("full_path", T.StringType()),
    T.StructField("noi_dung", T.StringType()),
    T.StructField("cac_khoan", T.ArrayType(CLAUSE)),
])
CHAPTER = T.StructType([
    T.StructField("chuong", T.StringType()),
    T.StructField("ten", T.StringType()),
    T.StructField("cac_dieu", T.ArrayType(ARTICLE)),
])
REGULATION = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("ten_file", T.StringType())])),
    T.StructField("quyet_dinh_ban_hanh", T.StructType([
        T.StructField("can_cu", T.ArrayType(T.StringType())),
        T.StructField("cac_dieu", T.ArrayType(ARTICLE)),
    ])),
    T.StructField("quy_dinh_chi_tiet", T.ArrayType(CHAPTER)),
])

MESSAGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
    ]))),
])
CHAT_REQUEST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("trigger", T.StringType()),
])

JOB_EVENTS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("event_seq", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("filename", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("ingestion_applied", T.BooleanType()),
    T.StructField("nodes", T.LongType()),
    T.StructField("edges", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("extracted_text_length", T.IntegerType()),
    T.StructField("extracted_preview", T.StringType()),
    T.StructField("extraction_source", T.StringType()),
    T.StructField("section_count", T.LongType()),
])
