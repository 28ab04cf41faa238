"""Intermediate tables: where they go, when they are deleted."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from beliefloom import session as S

SCRIPT = """
import sys
from beliefloom.session import cut, session
s = session("t", cores="2", **{"spark.driver.memory": "1g", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": sys.argv[1]})
print(cut(s.range(10)).count())
if sys.argv[2] == "stop":
    s.stop()
"""


@pytest.mark.parametrize("how", ["stop", "exit"])
def test_nothing_stays_behind(tmp_path, how):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), how], capture_output=True, text=True, timeout=120, cwd=root, env=os.environ | {"PYTHONPATH": root})
    assert out.stdout.strip().endswith("10"), out.stderr[-2000:]
    assert not list(tmp_path.rglob("*.parquet")) and not list(tmp_path.rglob("beliefloom-*"))


def test_cut_split_and_release(spark):
    done, rest, n = S.cut_split(spark.range(10).withColumn("even", F.col("id") % 2 == 0), "even", n=F.count("*"))
    assert n == {"n": 10} and done.columns == ["id"] and {r.id for r in done.collect()} == {0, 2, 4, 6, 8}
    S.release(rest)
    assert {r.id for r in done.collect()} == {0, 2, 4, 6, 8}
    folder = Path(done._beliefloom_path.removeprefix("file:"))
    assert folder.exists() and not Path(rest._beliefloom_path.removeprefix("file:")).exists()
    S.release(done, None)
    assert not folder.exists()
    none, every, _ = S.cut_split(spark.range(3).withColumn("yes", F.lit(False)), "yes")
    assert none.count() == 0 and every.count() == 3


def test_counting(spark):
    _, got = S.cut_counting(spark.range(5), n=F.count("*"), big=F.sum(F.when(F.col("id") > 2, 1)))
    assert got == {"n": 5, "big": 2}
    _, got = S.cut_counting(spark.range(0), n=F.count("*"), big=F.sum("id"))
    assert got == {"n": 0, "big": 0}


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = S.spread(spark.read.parquet(str(tmp_path / "one")).where("id >= 0"))
    assert one.rdd.getNumPartitions() > 1 and one.count() == 100
    many = spark.range(0, 100, 1, 16)
    assert S.spread(many) is many and S.spread(one) is one
