import os

import pytest

from rostra.plans import scratch


def test_what_a_scope_wrote_goes_but_for_what_is_kept(spark):
    folder = scratch.shared_folder(spark).removeprefix("file://") + "/rostra"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch.scratch(spark):
        with scratch.scratch(spark):
            inner = scratch.written(spark.range(5), "inner")
            outer = scratch.written(inner.filter("id > 1"), "outer", keep=True)
        assert outer.count() == 3 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Session())
