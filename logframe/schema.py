"""Schemas and ordering columns shared by the operators."""

from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("log_type", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("process", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("severity", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("port", T.LongType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
RECORD_FIELDS = RECORD_SCHEMA.names

FILE_FIELDS = ["path", "filename", "log_type", "compressed", "rotation", "extension", "reader"]

DICTIONARY_SCHEMA = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("token_no", T.LongType()),
    ]
)

# Sorting scanned lines by these columns gives file order back: blocks of a file by offset, lines of a
# block by scan position, pieces of a physical line by place.
LINE_ORDER = ["file_path", "block_start", "line_id", "part"]
