"""Bootstrap weights are added up in arrays, not as rows."""

from pyspark.sql import functions as F

from diurna.operators import phase_response, phase_shift


def test_weights_by_clock_time(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 3, float(i % 5)) for i in range(60)], "id int, grp string, day int, h double")
    found = {(r.grp, r.day, r.h, r.r): r.w for r in phase_response._weighted(rows.repartition(7), 20, 3).collect()}
    drawn = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("r")).withColumn("w", phase_shift.resample_weight(F.col("id"), F.col("r"), 3).cast("bigint"))
    assert found == {(r.grp, r.day, r.h, r.r): r.w for r in drawn.groupBy("grp", "day", "h", "r").agg(F.sum("w").alias("w")).where("w > 0").collect()}
