"""A circular centre at midnight is 0, whichever way its sums were rounded."""

from diurna.operators import states


def test_a_centre_at_midnight_is_zero(spark):
    rows = [("a", 0, 1.0), ("a", 1380, 1.0 + 1e-12), ("b", 0, 1.0 + 1e-12), ("b", 1380, 1.0), ("c", 1320, 1.0), ("c", 1380, 1.0)]
    found = states.circular(spark.createDataFrame([(i, "short", z, v) for i, z, v in rows], "id string, state string, zt_bin_minute int, value double"), 60, "never")
    assert {r.id: round(r.mean_phase_h, 3) for r in found.collect()} == {"a": 0.0, "b": 0.0, "c": 23.0}
