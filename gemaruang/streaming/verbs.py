"""Row-local verbs over a stream of delivered tweets, and counts by window with late rows.

Verbs that look at one row only are the same expressions on a stream. Verbs over whole tables (ranks, fixpoints, communities,
consensus) are run on the tables that a stream fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gemaruang.functions import text as T
from gemaruang.functions import vectors as V


def read_folder(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_deliveries(stream: DataFrame, key: str = "id", event_time: str = "created_at", delay: str = "30 days") -> DataFrame:
    """Each tweet once; repeated deliveries within the delay are dropped, and state older than it is given up."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def cleaned(stream: DataFrame, text: str = "text") -> DataFrame:
    return stream.filter(F.col(text).isNotNull()).withColumn("cleaned", T.clean_line(text))


def parsed_predictions(stream: DataFrame) -> DataFrame:
    """Predictions with their three probabilities; rows whose probabilities cannot be read are left out."""
    return stream.withColumn("vec", V.clean_probabilities("sentiment_prob")).filter(V.total(F.col("vec")) != 0)


def aspect_counts(stream: DataFrame, event_time: str = "predicted_at", window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """(start, aspect_category, rows, positive): by window; rows later than the delay are dropped."""
    rows = parsed_predictions(stream).withWatermark(event_time, delay)
    grouped = rows.groupBy(F.window(event_time, window).alias("w"), "aspect_category").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.get("vec", F.lit(0))).alias("positive"))
    return grouped.select(F.col("w.start").alias("start"), "aspect_category", "rows", "positive")
