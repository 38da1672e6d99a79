"""Where tables come from and go to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutlab.schema import FEATURES, TEXT_FEATURES
from boutlab.session import scratch_path

# Whether Spark removes the shuffle files of a query when it ends; of other queries, none.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 64, **options
) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric key; filters are pushed down."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=key,
            lowerBound=str(low),
            upperBound=str(high),
            numPartitions=str(parts),
            **options,
        )
        .load()
    )


def dataset_schema() -> T.StructType:
    """Columns of an exported dataset, in file order."""
    fields = [T.StructField("bout_id", T.LongType()), T.StructField("bout_date", T.DateType())]
    fields.append(T.StructField("win_method", T.StringType()))
    for name in FEATURES:
        kind = T.StringType() if name in TEXT_FEATURES else T.LongType()
        fields.append(T.StructField(name, kind))
    fields.append(T.StructField("winner", T.StringType()))
    fields += [T.StructField(f"{side}_odds", T.IntegerType()) for side in ("r", "b")]
    return T.StructType(fields)


def read_feature_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A CSV dataset with a header; the schema is given, so nothing is read to guess it."""
    frame = spark.read.schema(schema or dataset_schema()).csv(path, header=True)
    return frame.select(*columns) if columns else frame


def export_dataset(dataset: DataFrame, path: str, mode: str = "errorifexists") -> None:
    dataset.write.mode(mode).option("header", True).csv(path)


def report_lines(predictions: DataFrame) -> DataFrame:
    """One line of text per predicted bout."""
    return predictions.select(
        F.format_string(
            "Fight: %s vs %s Winner: %s, Confidence: %.1f%%",
            "r_name",
            "b_name",
            "winner",
            F.round(F.col("confidence"), 3) * 100,
        ).alias("value")
    )


def write_prediction_report(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report_lines(predictions).write.mode(mode).text(path)


def stage(frame: DataFrame, name: str, spread_by: str | None = None) -> DataFrame:
    """Store an intermediate table in the shared folder, for a job that reads it several times.

    Also the point a job restarts from when executors are lost. ``spread_by`` writes at least one file
    per core: pages compress so well that few tasks would otherwise read, and parse, all of them.
    """
    spark = frame.sparkSession
    if spread_by:
        parts = max(
            spark.sparkContext.defaultParallelism,
            int(spark.conf.get("spark.sql.shuffle.partitions")),
        )
        # By a hash of the key: by the key itself, an earlier shuffle on it would be reused as it is.
        frame = frame.repartition(parts, F.xxhash64(spread_by))
    return save_snapshot(frame, scratch_path(spark, name))


def save_snapshot(frame: DataFrame, path: str) -> DataFrame:
    """Write a table once and read it back: later steps start from stored rows.

    So nothing reads the shuffles of the write again, and Spark is told to remove their files when it ends. Else
    they stay until the driver happens to collect garbage, and fill the disks of the executors.
    """
    spark = frame.sparkSession
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        frame.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)
    return spark.read.parquet(path)


def stage_for_a_while(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A staged table, and its path for ``remove``."""
    path = scratch_path(frame.sparkSession, name)
    return save_snapshot(frame, path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored intermediate table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
