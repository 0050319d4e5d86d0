from types import SimpleNamespace

import pytest

from runlens import session


def fake(folder, master):
    conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_shared_folder_is_the_clusters_own():
    assert session.shared_folder(fake("hdfs:///cp", "yarn")) == "hdfs:///cp"
    # never a machine-local folder on a cluster
    with pytest.raises(ValueError):
        session.shared_folder(fake(None, "yarn"))
    local = session.shared_folder(fake(None, "local[2]"))
    assert local == session.shared_folder(fake(None, "local[2]"))


def test_materialise_reads_back_what_was_written(spark, tmp_path):
    one, two = spark.range(5), spark.range(3).selectExpr("id as other")
    got = session.materialise_all({"one": one, "two": two}, str(tmp_path))
    assert got["one"].count() == 5 and got["two"].columns == ["other"]
    assert "parquet" in got["one"]._jdf.queryExecution().executedPlan().toString().lower()
