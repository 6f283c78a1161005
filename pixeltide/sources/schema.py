"""Columns of the two forms of the log."""

from pyspark.sql import types as T

# Folder columns of a time-clustered clean log, ints such as 2022040112 and 20220401.
HOUR = "placed_hour"
DAY = "placed_day"

# Column metadata. FOLDER_MARK names the folder column that was made from a
# timestamp; PARSED_MARK says that a timestamp is parsed from text when read.
FOLDER_MARK = "pixeltide.folder"
PARSED_MARK = "pixeltide.parsed"

# All text: inferred types would turn an all-digit user id into a number and
# change what is hashed.
RAW = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("pixel_color", T.StringType()),
        T.StructField("coordinate", T.StringType()),
    ]
)

CLEAN = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("user_id_hashed", T.LongType()),
        T.StructField("pixel_color", T.StringType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
    ]
)
