"""Pieces are published all at once or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pageloom.plans.shared import new_path
from pageloom.sources import io


def pieces(spark, *docs):
    rows = spark.createDataFrame([(d, c, d * 10 + c) for d in docs for c in range(3)], "doc_id int, chunk int, v int")
    return rows, rows.select(F.concat(F.lit("doc"), "doc_id", F.lit("-"), "chunk").alias("name"))


def save(spark, path, *docs, **kw):
    rows, names = pieces(spark, *docs)
    io.save_pieces(rows, path, by=["chunk"], cluster=["doc_id"], names=kw.pop("names", names), **kw)


def found(spark, path):
    return sorted(r.doc_id for r in io.read_pieces(spark, path).select("doc_id").distinct().collect())


def test_saves_add_up_and_taken_names_stop_one(spark):
    path = new_path(spark, "saves")
    save(spark, path, 1, 2)
    with pytest.raises(FileExistsError, match="NameTaken: doc2-"):
        save(spark, path, 2, 3)
    assert found(spark, path) == [1, 2]
    save(spark, path, 3)
    assert found(spark, path) == [1, 2, 3] and io.published_names(spark, path).count() == 9
    save(spark, path, 2, force=True)
    assert found(spark, path) == [2] and io.published_names(spark, path).count() == 3
    save(spark, path, 1)
    assert found(spark, path) == [1, 2]


def test_two_pieces_of_one_name_stop_the_write(spark):
    path = new_path(spark, "saves")
    _, names = pieces(spark, 1)
    with pytest.raises(FileExistsError):
        save(spark, path, 1, names=names.union(names))
    assert io.commits(spark, path) == []
    with pytest.raises(FileNotFoundError):
        io.read_pieces(spark, path)


def test_a_failed_task_leaves_nothing_visible(spark):
    path = new_path(spark, "saves")
    save(spark, path, 1)
    rows, names = pieces(spark, 5)
    broken = rows.withColumn("v", F.when(F.col("chunk") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        io.save_pieces(broken, path, by=["chunk"], cluster=["doc_id"], names=names)
    assert found(spark, path) == [1]
    save(spark, path, 5)
    assert found(spark, path) == [1, 5]


def test_a_writer_that_comes_second_checks_again(spark, monkeypatch):
    path = new_path(spark, "saves")
    publish, other = io._publish, []

    def slow(*args):
        if not other:
            other.append(True)
            save(spark, path, 7)  # another writer gets the number first
        return publish(*args)

    monkeypatch.setattr(io, "_publish", slow)
    save(spark, path, 8)
    assert found(spark, path) == [7, 8]
    other.clear()
    monkeypatch.setattr(io, "_publish", lambda *a: (other or (other.append(True) or save(spark, path, 9))) and publish(*a) or publish(*a))
    with pytest.raises(FileExistsError):
        save(spark, path, 9)
    assert found(spark, path) == [7, 8, 9]


def test_files_are_listed_by_pattern_and_counted(spark, tmp_path):
    for name, n in (("a", 5), ("b", 7)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "note.txt").write_text("x")
    tables = {n: spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in "ab"}
    got = io.file_corpus(spark, str(tmp_path), "part-*.parquet", tables).collect()
    assert sorted((r.name, r.rows) for r in got) == [("a", 5), ("b", 7)]
    sizes = {f.name: f.stat().st_size for f in tmp_path.rglob("part-*.parquet")}
    assert {r.file: r.length for r in got} == sizes


def test_views_follow_their_files(spark, tmp_path):
    from pageloom.sources import views

    folder = str(tmp_path)
    spark.range(3).write.parquet(f"{folder}/t.parquet")
    view = lambda: views._once(spark, folder, "seen", ("t",), lambda s, f: views.table(s, f, "t")).count()
    assert view() == 3 and view() == 3
    spark.range(4).write.mode("append").parquet(f"{folder}/t.parquet")
    assert view() == 7
