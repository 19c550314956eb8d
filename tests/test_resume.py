"""Batches that a later run takes up, and counted writes."""

import os

import pytest
from pyspark.sql import functions as F

from textwarrant.sources import resume


def made(rows):
    return rows.select("id", "batch", F.concat("text", F.lit("!")).alias("said"))


def table(spark, n, changed=()):
    return spark.createDataFrame([(i, f"text {i}" + (" new" if i in changed else "")) for i in range(n)], "id long, text string")


def read(spark, path):
    return {r.id: r.said for r in resume.read_batches(spark, path).collect()}


def test_a_run_that_was_cut_off_makes_no_batch_twice(spark, tmp_path):
    path, rows, calls = str(tmp_path / "out"), table(spark, 200), []

    def dies(part):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("cut off")
        return made(part)

    with pytest.raises(RuntimeError):
        resume.write_batches(rows, path, "id", dies, batches=10, at_once=2)
    assert resume.manifest(spark, path).count() == 4
    before = {f: os.path.getmtime(f) for d, _, names in os.walk(f"{path}/data") for n in names if n.endswith(".parquet") for f in [f"{d}/{n}"]}
    assert resume.write_batches(rows, path, "id", made, batches=10, at_once=2) == 6
    assert read(spark, path) == {i: f"text {i}!" for i in range(200)}
    assert all(os.path.getmtime(f) == t for f, t in before.items())
    assert resume.write_batches(rows, path, "id", made, batches=10) == 0


def test_files_without_their_line_are_written_again(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "out"), table(spark, 50)
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **k: (_ for _ in ()).throw(RuntimeError("cut off")) if data and schema == resume.MANIFEST else create(self, data, schema, **k))
    with pytest.raises(RuntimeError):
        resume.write_batches(rows, path, "id", made, batches=3)
    monkeypatch.undo()
    assert resume.write_batches(rows, path, "id", made, batches=3) == 3
    assert read(spark, path) == {i: f"text {i}!" for i in range(50)} and resume.read_batches(spark, path).count() == 50


def test_changed_new_and_lost_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    resume.write_batches(table(spark, 100), path, "id", made, batches=8)
    assert resume.write_batches(table(spark, 100, {7}), path, "id", made, batches=8) == 1
    assert read(spark, path) == {i: f"text {i}{' new' if i == 7 else ''}!" for i in range(100)}
    resume.write_batches(table(spark, 2), path, "id", made, batches=8)
    assert read(spark, path) == {0: "text 0!", 1: "text 1!"}
    twice = table(spark, 2).unionByName(table(spark, 2))
    assert resume.write_batches(twice, path, "id", made, batches=8) in (1, 2)
    assert resume.read_batches(spark, path).count() == 4
    assert resume.write_batches(table(spark, 0), path, "id", made, batches=8) == 0
    assert read(spark, path) == {}


def test_a_count_that_is_not_met_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "counted")
    with pytest.raises(ValueError, match="5 rows where 6"):
        resume.write_counted(spark.range(5), path, 6)
    assert not os.path.exists(path)
    resume.write_counted(spark.range(6), path, 6)
    assert spark.read.parquet(path).count() == 6
