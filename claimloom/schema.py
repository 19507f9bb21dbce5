"""Schemas of the input tables."""

from pyspark.sql import types as T

SOURCES = T.StructType([T.StructField("source_id", T.LongType()), T.StructField("domain", T.StringType())])
EDGES = T.StructType([T.StructField("source_id", T.LongType()), T.StructField("claim_id", T.LongType())])
CLAIMS = T.StructType(
    [T.StructField("claim_id", T.LongType()), T.StructField("product_id", T.StringType()), T.StructField("attribute", T.StringType())]
)
VALUES = T.StructType(
    [T.StructField("source_id", T.LongType()), T.StructField("claim_id", T.LongType()), T.StructField("value", T.StringType())]
)
SOURCE_CLAIMS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("canonical_attribute", T.StringType()),
        T.StructField("value_string", T.StringType()),
        T.StructField("value_numeric", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("claim_id", T.LongType()),
    ]
)
