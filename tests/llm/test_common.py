import os

import pytest

from quillmeter.llm import common


def tables(spark):
    root = common.shared_root(spark).removeprefix("file:").replace("///", "/")
    folder = f"{root}/quillmeter/{spark.sparkContext.applicationId}"
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def test_tables_are_written_dropped_and_cleaned(spark):
    before = tables(spark)
    one, two = (common.written(spark.range(n), "numbers") for n in (3, 5))
    assert one.count() == 3 and len(tables(spark)) == len(before) + 2
    common.drop(one.where("id > 0"))
    assert two.count() == 5 and len(tables(spark)) == len(before) + 1
    common.drop(spark.range(3))  # no table of ours: nothing happens
    common.clean(spark)
    assert tables(spark) == []


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(Session())
