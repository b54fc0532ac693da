"""Written tables and their owners."""
import glob
import threading

import pytest

from contactforge import storage
from contactforge.errors import ContactError


class _Away:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(lambda: {})


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ContactError, match="checkpoint"):
        storage.shared_folder(_Away)


def test_owners(spark, monkeypatch):
    monkeypatch.setattr(storage, "_held", {})
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage.shared_folder(spark).removeprefix("file://")
    there = lambda: set(glob.glob(f"{folder}/table-*"))
    before = there()
    a = storage.written(spark.range(5))
    with storage.owned(spark):
        assert storage.written(a).count() == 5
        assert len(there() - before) == 2
    assert len(there() - before) == 1 and a.count() == 5
    kept = storage.settled(lambda: storage.written(storage.written(a)), spark)
    assert len(there() - before) == 2 and kept.count() == 5
    storage.removed(a)
    storage.removed(kept)
    assert there() == before
    storage.written(spark.range(3))
    storage.remove_all(spark)
    assert there() == before and spark.conf.get("spark.checkpoint.dir", None) == named


def test_blocks_of_two_threads(spark):
    """Each block deletes what its own thread has written, whatever the other one writes meanwhile."""
    began, ended, kept = threading.Event(), threading.Event(), []

    def other():
        with storage.owned(spark):
            began.wait(60)
            kept.append(storage.written(spark.range(4)))
            ended.wait(60)
            kept.append(kept[0].count())

    t = threading.Thread(target=other)
    t.start()
    with storage.owned(spark):
        mine = storage.written(spark.range(2))
        began.set()
        while not kept:
            threading.Event().wait(0.05)
        assert mine.count() == 2
    ended.set()
    t.join()
    assert kept[1] == 4


def test_only_written_tables_are_removed(spark):
    a = storage.written(spark.range(3))
    storage.removed(a.where("id > 0"))
    storage.removed(spark.range(3))
    assert a.count() == 3
    storage.removed(a)
    storage.removed(a)
