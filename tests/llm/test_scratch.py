"""Scratch tables go with the stage that wrote them, and only those."""

import threading

import pytest

from tesselon.llm import common


def test_tables_under_a_mark_go_but_for_the_newest(spark):
    scratch, other = common.Scratch(spark, "a"), []
    before = scratch.write(spark.range(3), "before")
    mark = common.scratch_mark()
    gone = scratch.write(spark.range(4), "gone")
    thread = threading.Thread(target=lambda: other.append(common.Scratch(spark, "b").write(spark.range(7), "other")))
    thread.start()
    thread.join()
    newest = scratch.write(spark.range(5), "newest")
    common.drop_since(mark)
    assert (before.count(), other[0].count(), newest.count()) == (3, 7, 5)
    with pytest.raises(Exception, match="(?i)not exist|no such|not found"):
        gone.collect()


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_root(Session)
