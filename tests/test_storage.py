import os
from types import SimpleNamespace

import pytest

from granary import storage as U


def test_no_machine_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        U.shared_dir(session("spark://host:7077"))
    assert U.shared_dir(session("local[2]")).startswith("file://")
    named = SimpleNamespace(get=lambda name, *a: "hdfs://x/y/")
    assert U.shared_dir(SimpleNamespace(conf=named, sparkContext=None)) == "hdfs://x/y"


def test_stored_tables_go_when_told(spark):
    df = U.stored(spark.range(5))
    (path,) = {os.path.dirname(f).removeprefix("file://") for f in df.inputFiles()}
    assert df.count() == 5 and os.path.isdir(path)
    kept, U._written[:] = U._written[:-1], U._written[-1:]
    U.forget()
    U._written[:] = kept
    assert not os.path.exists(path)
