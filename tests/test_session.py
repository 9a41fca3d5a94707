from types import SimpleNamespace

import pytest

from cellweave import session


def fake(master, conf=None, folder=None):
    given = SimpleNamespace(isDefined=lambda: folder is not None, get=lambda: f"{folder}/1234")
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: given)))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf or default))


def test_folder_of_the_cluster_is_used():
    assert session.shared_folder(fake("spark://host:7077", conf="hdfs:///tmp/ck/")) == "hdfs:///tmp/ck"
    assert session.shared_folder(fake("yarn", folder="hdfs:///given")) == "hdfs:///given"


def test_no_local_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(fake(master))
    assert session.shared_folder(fake("local[4]"))


def test_stored_table(spark):
    df = session.stored(spark.range(5).withColumnRenamed("id", "x"), "numbers")
    assert df.count() == 5 and session.shared_folder(spark).removeprefix("file:") in df.inputFiles()[0]
