"""Histories: each change is one commit over files, records and vectors."""

import datetime as dt

import pytest
from ferrule.operators import histories as h
from ferrule.sources import commits
from ferrule.sources.commits import Store
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 5, 6, 7, 8)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    h.create(s, spark.createDataFrame([("aaaaaaaa-1", "My talk!", DAY), ("bbbbbbbb-2", " my  talk? ", DAY), ("c", "My talk!", DAY)], "file_id string, title string, created timestamp"))
    return s


def at(minute):
    return F.lit(DAY + dt.timedelta(minutes=minute))


def files(store):
    return {r.file_id: (r.title, r.filename) for r in store.read("files").collect()}


def recorded(spark, *ids):
    return spark.createDataFrame([(r, f, "text") for r, f in ids], "record_id string, file_id string, body string")


def two_each(records):
    return records.select("record_id", F.explode(F.array(F.lit("q"), F.lit("a"))).alias("role"), "file_id").select("record_id", F.concat_ws("::", "record_id", "role").alias("vector_id"), "file_id")


def test_names(spark, store):
    assert files(store) == {"aaaaaaaa-1": ("My talk!", "2024-05-06-07-08-My-talk"), "bbbbbbbb-2": ("my  talk?", "2024-05-06-07-08-my-talk"), "c": ("My talk!", "2024-05-06-07-08-My-talk-c")}
    for bad, why in ((("c", "x"), "there already"), (("d", "  "), "empty"), (("d", None), "empty")):
        with pytest.raises(ValueError, match=why):
            h.create(store, spark.createDataFrame([(*bad, DAY)], "file_id string, title string, created timestamp"))
    h.rename(store, spark.createDataFrame([("bbbbbbbb-2", "My talk!"), ("c", "Ünï / code")], "file_id string, title string"), at(5))
    assert files(store)["bbbbbbbb-2"] == ("My talk!", "2024-05-06-07-08-My-talk-bbbbbbbb") and files(store)["c"] == ("Ünï / code", "2024-05-06-07-08-n-code")
    assert store.read("files").where("file_id = 'c'").head().updated == DAY + dt.timedelta(minutes=5)
    with pytest.raises(ValueError, match="no such history: zz"):
        h.rename(store, spark.createDataFrame([("zz", "x")], "file_id string, title string"), at(6))


def test_records_vectors_and_deletion(spark, store):
    h.append(store, recorded(spark, ("r1", "c"), ("r2", "c"), ("r3", "aaaaaaaa-1"), (" ", "aaaaaaaa-1")), at(1))
    got = {r.file_id: r[1:] for r in h.ingest_all(store, two_each).collect()}
    assert got == {"c": (2, 2, 0, 0, 4, True), "aaaaaaaa-1": (2, 1, 1, 0, 2, False)}
    again = {r.file_id: r[1:] for r in h.ingest_all(store, lambda r: two_each(r.where("record_id <> 'r2'")), spark.createDataFrame([("c",)], "file_id string")).collect()}
    assert again == {"c": (2, 2, 0, 4, 2, True)} and store.read("vectors").count() == 4
    assert [(r.file_id, r.n_records) for r in h.listing(store).collect()] == [("aaaaaaaa-1", 2), ("c", 2), ("bbbbbbbb-2", 0)]
    with pytest.raises(ValueError, match="no such history"):
        h.append(store, recorded(spark, ("r9", "zz")), at(2))
    gone = h.delete(store, spark.createDataFrame([("c",), ("bbbbbbbb-2",)], "file_id string"))
    assert sorted(map(tuple, gone.collect())) == [("bbbbbbbb-2", 0, 0), ("c", 2, 2)]
    assert set(files(store)) == {"aaaaaaaa-1"} and {r.file_id for t in ("records", "vectors") for r in store.read(t).collect()} == {"aaaaaaaa-1"}
    with pytest.raises(ValueError, match="no such history"):
        h.delete(store, spark.createDataFrame([("c",)], "file_id string"))


@pytest.mark.parametrize("lost", [0, 1, 2])
def test_a_crash_while_deleting(spark, store, monkeypatch, lost):
    """Lost after none, one or two of the tables: all of them are as before."""
    h.append(store, recorded(spark, ("r1", "c")), at(1))
    h.ingest_all(store, two_each)
    before = {t: sorted(map(tuple, store.read(t).collect())) for t in store.tables()}
    plain, done = commits.Change._write, []

    def write(self, *args):
        if len(done) == lost:
            raise OSError("lost")
        done.append(args[0])
        return plain(self, *args)

    with monkeypatch.context() as m:
        m.setattr(commits.Change, "_write", write)
        with pytest.raises(OSError):
            h.delete(store, spark.createDataFrame([("c",)], "file_id string"))
    assert {t: sorted(map(tuple, store.read(t).collect())) for t in store.tables()} == before and len(done) == lost
    h.delete(store, spark.createDataFrame([("c",)], "file_id string"))
    assert store.read("records").count() == store.read("vectors").count() == 0


def test_a_name_goes_to_one_of_two_writers(spark, store):
    """Both read the names; the second, at its commit, finds them changed, and takes another."""
    first = store.begin()
    held = first.read("files")
    new = held.limit(1).selectExpr("'x' AS file_id", "'T' AS title", "'2024-05-06-07-08-T' AS filename", "created", "updated")
    first.upsert("files", new)
    h.create(store, spark.createDataFrame([("y", "T", DAY)], "file_id string, title string, created timestamp"))
    with pytest.raises(commits.Conflict):
        first.commit()
    assert files(store)["y"][1] == "2024-05-06-07-08-T" and "x" not in files(store)
