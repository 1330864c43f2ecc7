"""Result tables to files: Parquet with its settings, wide CSV, and per-board count files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import runs
from ..params import Settings, settings_table

MISSING = -1


def save(df: DataFrame, path: str, *steps: Settings) -> None:
    """A table and, beside it, the settings that made it. A second run replaces both."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/table")
    settings_table(df.sparkSession, *steps).coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """A saved table and the rows of its settings; ``Settings.from_rows`` makes them settings again."""
    rows = spark.read.schema("step string, key string, value string").json(f"{path}/settings").collect()
    return spark.read.parquet(f"{path}/table"), [tuple(r) for r in rows]


def wide(df: DataFrame, value: str, ids: list, row: str = "t", key: str = "id") -> DataFrame:
    """One column for each id, in the given order, which is the caller's list of subjects."""
    return df.groupBy(row).pivot(key, ids).agg(F.first(value)).orderBy(row)


def save_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def encoded(value: str | Column) -> Column:
    """Counts as whole numbers, halves to the even one; missing is -1."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.rint(c).cast("int"), F.lit(MISSING))


def half_hours(df: DataFrame, value: str = "activity") -> DataFrame:
    """``id, block, value``: sums of 30 rows; a block with any missing row, and a partial one, is missing."""
    block = F.floor(F.col("t") / 30).cast("int").alias("block")
    rows = df.groupBy("id", block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return rows.select("id", "block", encoded(F.when(F.col("n") == 30, F.col("s"))).alias("value"))


def board_window(df: DataFrame, subjects: DataFrame, min_days: float = 2.0, value: str = "activity") -> DataFrame:
    """``id, board, start, length``: subjects with a long enough valid span, cut to their board's common length.

    The span runs from the first to the last measured minute; the common length is the shortest one, in whole days.
    """
    seen = F.when(F.col(value).isNotNull(), F.col("t"))
    spans = df.groupBy("id").agg(F.min(seen).alias("start"), (F.max(seen) - F.min(seen) + 1).alias("span")).where(F.col("span") >= min_days * 1440)
    joined = spans.join(subjects.select("id", F.col("monitor").alias("board")), "id")
    length = F.floor(F.min("span").over(Window.partitionBy("board")) / 1440) * 1440
    return joined.withColumn("length", length.cast("int")).where("length > 0").drop("span")


def board_lines(df: DataFrame, subjects: DataFrame, start_military: int = 900, min_days: float = 2.0, value: str = "activity") -> DataFrame:
    """``board, id, line_no, text``: the lines of one count file per subject: header, length, interval, start, counts.

    Interior gaps are interpolated. Files are written by board, so no task holds more than its boards.
    """
    window = board_window(df, subjects, min_days, value)
    filled = runs.interpolate(df.select("id", "t", value), value, "__x")
    inside = filled.join(window, "id").where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + F.col("length")))
    counts = inside.select("board", "id", (F.col("t") - F.col("start") + 4).alias("line_no"), encoded("__x").cast("string").alias("text"))
    label = F.concat(F.lit("M"), F.col("board").cast("string"), F.lit("C"), F.col("id").cast("string"))
    head = F.array(label, F.col("length").cast("string"), F.lit("1"), F.lit(str(start_military)))
    return window.select("board", "id", F.posexplode(head).alias("line_no", "text")).unionByName(counts)


def save_boards(lines: DataFrame, path: str) -> None:
    """A folder for each board and subject, with one text file in it."""
    ordered = lines.repartition("board", "id").sortWithinPartitions("board", "id", "line_no")
    ordered.select("board", "id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("board", "id").text(path)


def read_board(spark: SparkSession, path: str) -> DataFrame:
    """``header, length, interval, start, counts`` of each count file."""
    parts = F.split(F.regexp_replace("value", "\\s+$", ""), "\n")
    numbers = F.transform(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), lambda x: x.cast("int"))
    return spark.read.text(path, wholetext=True).select(parts[0].alias("header"), parts[1].cast("int").alias("length"), parts[2].cast("int").alias("interval"), parts[3].cast("int").alias("start"), numbers.alias("counts"))
