from pathlib import Path

import pytest

from quernstone import runtime


def test_discarded_tables_leave_no_files(spark):
    table = runtime.materialize(spark.range(5), "t")
    path = Path(runtime._WRITTEN[id(table)].removeprefix("file://").removeprefix("file:"))
    assert table.count() == 5 and path.exists()
    runtime.discard(table)
    runtime.discard(table)
    runtime.discard(None)
    runtime.discard(spark.range(3))
    assert not path.exists()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.checkpoint_root(Session())
