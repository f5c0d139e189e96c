from datetime import date, datetime

import pytest

from tapeloom.sources import archive

SCHEMA = "id long, name string, at timestamp, extra double, date date"


def rows(*pairs):
    return [(i, f"n{i}", datetime(2024, 1, d, 5), date(2024, 1, d)) for d, i in pairs]


@pytest.fixture
def feed(spark, tmp_path):
    root = tmp_path / "feed"

    def add(*pairs, files=1):
        df = spark.createDataFrame(rows(*pairs), "id long, name string, at timestamp, date date")
        df.repartition(files).write.mode("append").partitionBy("date").parquet(str(root))

    def pull(run="a", **kw):
        got = archive.pull_archive(spark, str(root), SCHEMA, str(tmp_path / f"copy-{run}"), str(tmp_path / f"cursor-{run}"), **kw)
        return sorted((r.date.day, r.id) for r in got.collect())

    add.root = root
    return add, pull


def test_restarts_without_loss_or_repeat(feed):
    add, pull = feed
    add((1, 1), (1, 2), (2, 3), files=2)
    assert pull() == [(1, 1), (1, 2), (2, 3)]
    assert pull() == [(1, 1), (1, 2), (2, 3)]  # nothing new
    add((2, 4), (2, 5), (3, 6))  # the cursor's own date goes on
    add((2, 3), (1, 2), (3, 6))  # delivered again: before the cursor, and twice in one batch
    assert pull() == [(1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (3, 6)]
    add((5, 7))
    assert pull() == [(1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (3, 6), (5, 7)]


def test_values_and_columns(feed, spark, tmp_path):
    add, pull = feed
    add((1, 1), (2, 2))
    pull()
    got = {r.id: r for r in spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "copy-a")).collect()}
    assert (got[2].name, got[2].at, got[2].extra, got[2].date) == ("n2", datetime(2024, 1, 2, 5), None, date(2024, 1, 2))


def test_a_batch_that_failed_is_repeated_whole(feed, monkeypatch):
    add, pull = feed
    add((1, 1), (1, 2), (2, 3))
    real = archive.archive_stream
    monkeypatch.setattr(archive, "archive_stream", lambda *a, **k: real(*a, **k).selectExpr("*", "raise_error('lost') AS gone"))
    with pytest.raises(Exception, match="lost"):
        pull()
    monkeypatch.undo()
    add((2, 4))
    assert pull() == [(1, 1), (1, 2), (2, 3)]  # the planned batch, as it was
    assert pull() == [(1, 1), (1, 2), (2, 3), (2, 4)]


def test_since_empty_and_missing(feed):
    add, pull = feed
    assert pull("none") == []
    add((1, 1), (2, 2), (3, 3))
    assert pull("since", since="2024-01-02") == [(2, 2), (3, 3)]


def test_null_id_is_an_error(feed, spark):
    add, pull = feed
    add((1, 1))
    df = spark.createDataFrame([(None, "x", date(2024, 1, 2)), (9, "y", date(2024, 1, 2))], "id long, name string, date date")
    df.coalesce(1).write.mode("append").partitionBy("date").parquet(str(add.root))
    with pytest.raises(Exception, match="no id"):
        pull()


def test_bundles_and_bounds(feed, spark):
    add, _ = feed
    add(*[(1 + i % 4, i) for i in range(40)], files=4)
    reader = archive.ArchiveStream(None, {"path": str(add.root), "bundleBytes": "1"})
    end = reader.latestOffset()
    assert end == {"date": "2024-01-04", "id": 39}
    parts = reader.partitions({"date": "2024-01-02", "id": 5}, {"date": "2024-01-03", "id": 10})
    assert {d for p in parts for d, _ in p.files} == {"2024-01-02", "2024-01-03"} and all(len(p.files) == 1 for p in parts)
    whole = archive.ArchiveStream(None, {"path": str(add.root)}).partitions(reader.initialOffset(), end)
    assert len(whole) == 1
    assert archive.id_bounds("2024-01-02", ("2024-01-02", 5), ("2024-01-03", 10)) == (5, 2**63 - 1)
    assert archive.id_bounds("2024-01-03", ("2024-01-02", 5), ("2024-01-03", 10)) == (-(2**63), 10)
    assert reader.partitions(end, end) == []
