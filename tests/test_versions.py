"""Table versions: nothing is seen before it is published, and what was there stays whole."""

import pytest
from pyspark.sql import functions as F

from corpuskit.plans.reindex import reindex_file, write_file_chunks
from corpuskit.session import run_dir
from corpuskit.sources import versions as V


def rows_of(spark, path, number=None):
    return sorted(tuple(r) for r in V.read_table(spark, path, number).collect())


@pytest.fixture()
def table(spark):
    path = run_dir(spark, "versions-test")
    V.create_table(spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (3, "c", "q"), (4, "d", None)], "id int, v string, part string"), path, "part")
    return path


def new(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, v string, part string")


def test_changes_and_old_versions(spark, table):
    before = rows_of(spark, table)
    folders = dict(V.version_of(spark, table).folders)
    V.upsert_rows(table, new(spark, (2, "B", "p"), (2, "late", "p"), (9, "n", "r")), ["id"], [F.col("v")])
    assert rows_of(spark, table) == [(1, "a", "p"), (2, "B", "p"), (3, "c", "q"), (4, "d", None), (9, "n", "r")]
    after = dict(V.version_of(spark, table).folders)
    assert sum(folders.get(p) == f for p, f in after.items()) == 2  # q and NULL were not written again
    V.delete_rows(table, new(spark, (3, "", "q"), (4, "", None)), ["id"])
    assert rows_of(spark, table) == [(1, "a", "p"), (2, "B", "p"), (9, "n", "r")]
    V.append_rows(new(spark, (1, "again", "p")), table)
    V.change_rows(table, "id", "v", new(spark, (9, "N", "r")), new(spark, (2, "", "p")))
    assert rows_of(spark, table) == [(1, "a", "p"), (1, "again", "p"), (9, "N", "r")]
    assert rows_of(spark, table, 0) == before and V.version_of(spark, table).number == 4
    V.delete_rows(table, V.read_table(spark, table), ["id"])
    assert rows_of(spark, table) == [] and V.read_table(spark, table).columns == ["id", "v", "part"]


@pytest.mark.parametrize("step", ["_written", "publish"])
def test_a_job_that_dies_changes_nothing(spark, table, monkeypatch, step):
    before, number = rows_of(spark, table), V.version_of(spark, table).number
    real = getattr(V, step)

    def dies(*args):
        if step == "_written":
            real(*args)  # the folders are there, the manifest is not
        raise RuntimeError("lost")

    monkeypatch.setattr(V, step, dies)
    for change in (lambda: V.upsert_rows(table, new(spark, (1, "x", "p")), ["id"]), lambda: V.delete_rows(table, new(spark, (1, "", "p")), ["id"]), lambda: V.append_rows(new(spark, (7, "x", "p")), table)):
        with pytest.raises(RuntimeError, match="lost"):
            change()
        assert rows_of(spark, table) == before
    monkeypatch.setattr(V, step, real)
    assert V.version_of(spark, table).number == number
    V.upsert_rows(table, new(spark, (1, "x", "p")), ["id"])
    assert (1, "x", "p") in rows_of(spark, table)


def test_two_writers_of_one_version(spark, table):
    now = V.version_of(spark, table)
    V.append_rows(new(spark, (5, "e", "q")), table)
    seen = set()
    for _ in range(6):
        try:
            V.publish(spark, table, V.Version(now.number + 1, now.folders, now.schema, now.partition))
            seen.add("won")
        except V.Conflict:
            seen.add("lost")
    assert "lost" in seen and V.version_of(spark, table).number == now.number + 1


def test_reindex_is_one_step(spark, monkeypatch):
    path = run_dir(spark, "reindex-step")
    notes = spark.createDataFrame([("s1", "n1", "one " * 400), ("s1", "n2", "two"), ("s2", "n3", "three")], "shard string, source string, text string")
    write_file_chunks(notes, path)
    before = rows_of(spark, path)
    monkeypatch.setattr(V, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        reindex_file(notes.where("source = 'n1'").withColumn("text", F.lit("short")), path)
    monkeypatch.undo()
    assert rows_of(spark, path) == before
    reindex_file(notes.where("source = 'n1'").withColumn("text", F.lit("short")), path)
    assert {(r.source, r.content) for r in V.read_table(spark, path).collect()} == {("n1", "short"), ("n2", "two"), ("n3", "three")}
