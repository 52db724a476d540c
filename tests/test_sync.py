"""Incremental or full, by the cursor, in one call."""

import pytest
from pyspark.sql import functions as F

from postquill.sources import mailbox, versions
from postquill.sources.changes import DemoService
from postquill.streaming import sync as syncing

HERE = "tests.test_sync:"
DEMO = "postquill.sources.mailbox:DemoMailbox"


class Early(mailbox.DemoMailbox):
    """The mailbox when it had six messages."""

    def latest(self):
        return 6


class Mended(mailbox.DemoMailbox):
    """Message 7 can be fetched again."""

    def fetch(self, id_):
        number = int(id_.rpartition("/")[2])
        return next(DemoService.since(self, number, number + 1))[2]


class Forgetful(mailbox.DemoMailbox):
    """Knows a cursor when asked and has forgotten it when read."""

    def since(self, start, end):
        if end > start > 0:
            raise mailbox.CursorExpired(start)
        return super().since(start, end)


class Broken(mailbox.DemoMailbox):
    def since(self, start, end):
        if end > start:
            raise OSError("no line")
        return super().since(start, end)


def kept(spark, root):
    return sorted(r["source_path"] for r in spark.read.parquet(f"{root}/messages").collect())


def moved(spark, root, cursor):
    n = versions.read(spark, f"{root}/cursor").first()["syncs"]
    versions.replace(spark.createDataFrame([(cursor, n)], syncing.CURSOR), f"{root}/cursor")


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """What one sync of the mended mailbox keeps."""
    root = str(tmp_path_factory.mktemp("whole"))
    syncing.sync(spark, HERE + "Mended", root)
    return kept(spark, root)


def test_changes_are_read_in_pages(spark):
    got = syncing.changes(spark, DEMO, 3, 10, page=2)
    assert sorted(r["source_path"] for r in got.collect()) == [f"demo/inbox/{i}" for i in range(3, 10)]
    assert syncing.changes(spark, DEMO, 4, 4).count() == 0


def test_full_then_changes_then_what_was_missed(spark, tmp_path, whole):
    root = str(tmp_path)
    first = syncing.sync(spark, HERE + "Early", root, page=4)
    assert (first.start, first.end, first.full, first.fetched, first.failed) == (0, 6, True, 6, 0)
    second = syncing.sync(spark, DEMO, root, page=2)
    assert (second.start, second.end, second.full, second.fetched, second.failed) == (6, 10, False, 4, 0)
    assert kept(spark, root) == whole
    third = syncing.sync(spark, DEMO, root)
    assert (third.start, third.end, third.full, third.fetched, third.kept) == (10, 10, False, 0, 0)
    assert kept(spark, root) == whole


def test_what_could_not_be_fetched_is_asked_for_again(spark, tmp_path, whole):
    root = str(tmp_path)
    assert syncing.sync(spark, DEMO, root).failed == 1
    assert syncing.sync(spark, DEMO, root).failed == 1  # still gone
    assert syncing.sync(spark, HERE + "Mended", root).fetched == 1
    assert kept(spark, root) == whole
    assert spark.read.parquet(f"{root}/failed").where(F.col("batch") == 2).count() == 0


@pytest.mark.parametrize(("service", "cursor"), [("Mended", 2), ("Forgetful", 5)])
def test_an_expired_cursor_reads_everything(spark, tmp_path, whole, service, cursor):
    root = str(tmp_path)
    syncing.sync(spark, HERE + "Mended", root)
    moved(spark, root, cursor)
    again = syncing.sync(spark, HERE + service, root)
    assert again.full and again.start == 0 and again.end == 10 and again.kept == 0
    assert kept(spark, root) == whole
    assert versions.read(spark, f"{root}/cursor").first()["cursor"] == 10


def test_a_sync_that_fails_moves_nothing(spark, tmp_path, whole):
    root = str(tmp_path)
    syncing.sync(spark, HERE + "Early", root)
    with pytest.raises(Exception, match="no line"):
        syncing.sync(spark, HERE + "Broken", root)
    assert versions.read(spark, f"{root}/cursor").first()["cursor"] == 6
    syncing.sync(spark, HERE + "Mended", root)
    assert kept(spark, root) == whole
