import threading
import time

import pytest
from pyspark.sql import functions as F

from paperloom.sources import tables

SCHEMA = "docId string, id string, text string"


def rows(spark, *docs, per=3, said="old"):
    return spark.createDataFrame([(f"d{d}", f"{d}-{k}", said) for d in docs for k in range(per)], SCHEMA)


def held(df):
    return sorted(map(tuple, df.collect()))


def test_a_change_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = tables.BucketedTable(spark, str(tmp_path), SCHEMA, buckets=128)
    assert table.read().count() == 0 and table.version() == 0
    table.write(rows(spark, *range(2000)))
    before, old = table.manifest(), table.read()
    changed = list(range(0, 2000, 200))
    assert table.stale(rows(spark, *changed, per=1)).count() == 20
    assert table.replace(rows(spark, *changed, per=1, said="new")) == 2
    after = table.manifest()
    touched = set(after["touched"])
    assert 0 < len(touched) <= 10 and all((before["files"][b] == after["files"][b]) == (b not in touched) for b in before["files"])
    new = {f for b in touched for f in after["files"][b]}
    assert not new & {f for some in before["files"].values() for f in some}
    assert all({r[0] for r in spark.read.parquet(*(f"{tmp_path}/{f}" for f in after["files"][b])).select(table.bucket(128)).distinct().collect()} == {b} for b in touched)
    assert held(table.read()) == sorted(held(rows(spark, *changed, per=1, said="new")) + held(rows(spark, *(d for d in range(2000) if d not in changed))))
    assert old.count() == 6000 and held(table.read(1)) == held(old)  # readers of the old version go on
    assert table.vacuum(keep=1) > 0 and table.read().count() == 5980
    with pytest.raises(ValueError, match="not by id"):
        table.upsert(rows(spark, 1), "id")


def test_clear_and_empty_changes(spark, tmp_path):
    table = tables.Snapshot(spark, str(tmp_path), SCHEMA)
    table.write(rows(spark, 1, 2, 3))
    assert table.clear(rows(spark, 2)) == 2 and {r[0] for r in held(table.read())} == {"d1", "d3"}
    assert table.clear(rows(spark, 99)) == 3 and table.read().count() == 6
    assert table.replace(rows(spark)) == 3  # no rows, nothing to do
    assert [h["change"] for h in table.history()] == ["write", "clear", "clear"]
    table.clear(rows(spark, 1, 3))
    assert table.read().count() == 0


def test_a_broken_row_or_a_failed_write_changes_nothing(spark, tmp_path):
    table = tables.Snapshot(spark, str(tmp_path), SCHEMA)
    table.write(rows(spark, 1))
    broken = F.filter(F.array(F.when(F.col("text") == "bad", F.struct(F.lit("text").alias("path"), F.lit("is bad").alias("message")))), lambda x: x.isNotNull())
    with pytest.raises(ValueError, match="is bad"):
        table.replace(rows(spark, 1, 2, said="bad"), broken)
    with pytest.raises(Exception, match="on purpose"):
        table.replace(rows(spark, 1).withColumn("text", F.raise_error(F.lit("on purpose")).cast("string")))
    assert table.version() == 1 and held(table.read()) == held(rows(spark, 1)) and table.store.names("_staged") == []


def race(*jobs):
    got = []

    def run(job):
        try:
            got.append(job())
        except Exception as e:  # noqa: BLE001
            got.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return got


def test_a_name_is_taken_once(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    got = race(*(lambda k=k: store.put_new("_log/1", f"writer {k}") for k in range(8)))
    assert sorted(map(str, got)) == ["False"] * 7 + ["True"] and store.text("_log/1").startswith("writer ") and store.names("_log") == ["1"]


def test_two_appends_of_one_key_have_one_winner(spark, tmp_path):
    log = tables.Log(spark, str(tmp_path), "evalId string, docId string", "evalId", buckets=4)
    one = lambda key, doc: spark.createDataFrame([(key, doc)], "evalId string, docId string")
    got = race(*(lambda k=k: log.append(one("e", f"d{k}")) for k in range(3)))
    assert sum(isinstance(x, ValueError) and "already exists" in str(x) for x in got) == 2 and log.read().count() == 1
    got = race(*(lambda k=k: log.append(one(f"f{k}", "d")) for k in range(4)))
    assert sorted(got) == [2, 3, 4, 5] and log.read().count() == 5
    with pytest.raises(ValueError, match="parent not found"):
        log.append(one("g", "none"), parents=spark.createDataFrame([("d",)], "id string"))
    with pytest.raises(ValueError, match="repeated in the batch"):
        log.append(one("g", "a").unionByName(one("g", "b")))
    assert log.version() == 5


def test_changes_of_other_buckets_are_not_made_again(spark, tmp_path, monkeypatch):
    """The loser of a race publishes its files on top of the winner's if these left its buckets alone, else it starts anew."""
    table = tables.BucketedTable(spark, str(tmp_path), SCHEMA, buckets=64)
    table.write(rows(spark, *range(40)))
    place = {r["docId"]: r["b"] for r in table.read().select("docId", table.bucket(64).alias("b")).distinct().collect()}
    other = next(d for d in range(1, 40) if place[f"d{d}"] != place["d0"])
    for rival, times in ((other, 1), (0, 2)):
        made, put = [], tables.Store.put_new

        def late(self, name, text, rival=rival, put=put):
            monkeypatch.setattr(tables.Store, "put_new", put)
            table.replace(rows(spark, rival, per=1, said="rival"))
            return put(self, name, text)

        written = tables.BucketedTable._written
        monkeypatch.setattr(tables.BucketedTable, "_written", lambda self, r, folder, n, w=written: made.append(threading.current_thread().name) or w(self, r, folder, n))
        monkeypatch.setattr(tables.Store, "put_new", late)
        table.replace(rows(spark, 0, per=2, said="mine"))
        assert len(made) - 1 == times  # one of them is the rival's
        got = held(table.read())
        assert [r for r in got if r[0] == "d0"] == [("d0", "0-0", "mine"), ("d0", "0-1", "mine")] and len({r[0] for r in got}) == 40
        monkeypatch.setattr(tables.BucketedTable, "_written", written)
    assert [r[2] for r in got if r[0] == f"d{other}"] == ["rival"]


def test_conflicts_end(spark, tmp_path, monkeypatch):
    table = tables.BucketedTable(spark, str(tmp_path), SCHEMA)
    monkeypatch.setattr(tables.Store, "put_new", lambda *a: False)
    began = time.time()
    with pytest.raises(tables.Conflict):
        table.write(rows(spark, 1))
    assert time.time() - began < 60
