"""Stages are built once, and anew when something that they stand on is no longer the same."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinetra.sources import stages


def test_stages_resume(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "stages")
    spark.range(100).write.parquet(source)

    def go(least=10, fail=False):
        table = spark.read.parquet(source)
        chain = stages.Stages(spark, folder, stages.files_of(table))
        kept = chain.run("kept", lambda: table.where(F.col("id") >= least), needs=("id",), least=least)
        if fail:
            with pytest.raises(ZeroDivisionError):
                chain.run("sums", lambda: 1 // 0)
            return chain.built, None
        sums = chain.run("sums", lambda: kept.groupBy((F.col("id") % 3).alias("m")).agg(F.sum("id").alias("s")))
        return chain.built, sum(r["s"] for r in sums.collect())

    assert go(fail=True) == (["kept"], None)  # what was done before a failure stays
    assert go() == (["sums"], sum(range(10, 100)))
    assert go() == ([], sum(range(10, 100)))
    assert go(least=50) == (["kept", "sums"], sum(range(50, 100)))
    assert go(least=50) == ([], sum(range(50, 100)))
    spark.range(100, 110).write.mode("append").parquet(source)  # other input files
    assert go(least=50) == (["kept", "sums"], sum(range(50, 110)))
    # A table that is not what its manifest says is built anew.
    mark = next(p.name for p in (tmp_path / "stages").iterdir() if p.name.startswith("sums.") and p.name != "sums.manifest" and stages.Stages(spark, folder, "")._manifest("sums")["fingerprint"].startswith(p.name[5:]))
    spark.range(1).select(F.lit(1).alias("m"), F.lit(2).alias("s")).write.mode("append").parquet(f"{folder}/{mark}")
    assert go(least=50) == (["sums"], sum(range(50, 110)))
    chain = stages.Stages(spark, folder, "")
    with pytest.raises(ValueError, match="lacks x"):
        chain.run("bad", lambda: spark.range(3), needs=("x",))
