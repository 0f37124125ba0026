"""Scratch tables of an application go together; other folders below the checkpoint folder stay."""

from tidewater.session import ensure_checkpoint_dir, remove_scratch, scratch_path, scratch_root
from tidewater.sources.store import path_exists


def test_remove_scratch(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    other = ensure_checkpoint_dir(spark).rstrip("/") + "/another-application/y"
    for path in (a, b, other):
        spark.range(3).write.parquet(path)
    assert a != b and scratch_root(spark).endswith(spark.sparkContext.applicationId)
    assert remove_scratch(spark) and not path_exists(spark, a) and not path_exists(spark, b) and path_exists(spark, other)
    assert spark.read.parquet(other).count() == 3 and not remove_scratch(spark)
