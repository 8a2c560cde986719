"""Declared row types of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# One XML document with the images it refers to; attributes carry the "_" prefix.
XML_DOCUMENT = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("_name", T.StringType()),
    T.StructField("_cat", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("imageset", T.StructType([
        T.StructField("image", T.ArrayType(T.StructType([
            T.StructField("_VALUE", T.StringType()),
            T.StructField("_id", T.StringType()),
            T.StructField("_name", T.StringType()),
            T.StructField("_sectnum", T.StringType()),
        ]))),
    ])),
])

STOP_WORDS = T.StructType([T.StructField("word", T.StringType())])

DESCRIPTIONS = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("text", T.StringType()),
])

GROUND_TRUTH = T.StructType([
    T.StructField("text_id", T.StringType()),
    T.StructField("image_id", T.StringType()),
    T.StructField("category", T.IntegerType()),
])

VECTOR = T.ArrayType(T.DoubleType())


def require(df: DataFrame, *columns: str, vectors: tuple[str, ...] = ()) -> DataFrame:
    """Return df unchanged, or raise when a column is absent or a vector column is no numeric array."""
    missing = [c for c in (*columns, *vectors) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    for name in vectors:
        kind = df.schema[name].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)):
            raise ValueError(f"column {name!r} must be an array of numbers, not {kind.simpleString()}")
    return df
