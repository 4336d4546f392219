import os
from types import SimpleNamespace

import pytest

from quadrille.llm import common


def files(df):
    return [f.removeprefix("file://") for f in df.inputFiles()]


def test_scratch_tables_go_and_others_stay(spark):
    df = spark.range(10)
    with common.scratch() as put:
        kept = common.materialize(put(df, "t").where("id > 3"), "t")
        gone = files(put(df, "t"))
        assert gone and all(map(os.path.exists, gone))
    assert not any(map(os.path.exists, gone)) and kept.count() == 6
    with pytest.raises(ZeroDivisionError), common.scratch() as put:
        gone = files(put(df, "t"))
        1 / 0  # noqa: B018
    assert not any(map(os.path.exists, gone))
    left = files(kept)
    common.clear(spark)
    assert not any(map(os.path.exists, left)) and not [x for x in common._made if x[0] is spark]


@pytest.mark.parametrize("master, ok", [("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://a:7077", False)])
def test_a_cluster_must_name_the_shared_folder(master, ok):
    made = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: None))
    if ok:
        assert common.shared_dir(made) == common.shared_dir(made) and common.shared_dir(made).startswith("file:///")
    else:
        with pytest.raises(RuntimeError):
            common.shared_dir(made)
    made.conf.get = lambda *_: "hdfs://x/shared/"
    assert common.shared_dir(made) == "hdfs://x/shared"
