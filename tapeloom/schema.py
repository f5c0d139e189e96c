"""Table contracts."""

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("close_adj", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)
