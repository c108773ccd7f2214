from __future__ import annotations

from types import SimpleNamespace

import pytest

from seqspark.plans.tables import shared_dir, written


def session(master: str, folder: str | None = None):
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), setCheckpointDir=lambda _: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=context)


def test_shared_folder():
    assert shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[2]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))


def test_written_tables_are_read_back(spark):
    df = spark.range(5).selectExpr("id", "cast(id as string) AS s")
    out = written(df, "some")
    assert out.dtypes == df.dtypes and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
