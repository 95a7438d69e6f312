"""The folder source: partitions, pushed filters, and streams that read changed files only, also after a restart."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, folders


@pytest.fixture
def session(spark):
    folders.register(spark)
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def put(folder, path, text):
    full = os.path.join(folder, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def test_rows_of_all_files_with_their_content_ids(session, tmp_path):
    folder = str(tmp_path / "in")
    texts = {f"s{k % 3}/{k}.json": json.dumps({"name": f"n{k}", "text": "é" * k}) for k in range(40)} | {"top.csv": "a,b\n1,2\n\n3,4\n", "s0/.hidden": "x", "_tmp/y": "x"}
    for p, t in texts.items():
        put(folder, p, t)
    df = session.read.format("reply_folder").option("pertask", 200).load(folder)
    assert df.rdd.getNumPartitions() > 5
    got = {r["path"]: r for r in df.collect()}
    assert set(got) == {p for p in texts if not p.split("/")[-1].startswith(".") and not p.startswith("_")}
    assert all(r["value"] == texts[p] for p, r in got.items())
    native = {r["path"].split("/in/")[1]: r["id"] for r in files.file_ids(session, folder + "/s1").collect()}
    assert native == {p: r["id"] for p, r in got.items() if p.startswith("s1/")}
    lines = session.read.format("reply_folder").option("lines", "true").load(folder).filter("path = 'top.csv'").collect()
    assert [(r["line"], r["value"]) for r in lines] == [(0, "a,b"), (1, "1,2"), (3, "3,4")]


def test_filters_keep_other_files_closed(session, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(6):
        put(folder, f"s{k % 2}/{k}.txt", f"text {k}")
    os.chmod(f"{folder}/s0", 0o755)
    df = session.read.format("reply_folder").load(folder).filter((F.col("source") == "s1") & F.col("path").isin("s1/1.txt", "s1/3.txt", "s0/2.txt"))
    assert sorted(r["path"] for r in df.collect()) == ["s1/1.txt", "s1/3.txt"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("filterPushdown", "") or "path" in plan
    reader = folders._Batch({"path": folder})
    assert list(reader.pushFilters([folders.EqualTo(("source",), "s1"), folders.EqualTo(("value",), "x")])) == [folders.EqualTo(("value",), "x")]
    assert [f[0] for p in reader.partitions() for f in p.files] == ["s1/1.txt", "s1/3.txt", "s1/5.txt"]


def test_streams_read_changed_files_only(session, tmp_path):
    folder = str(tmp_path / "in")

    def run():
        stream = session.readStream.format("reply_folder").option("path", folder).option("manifests", str(tmp_path / "manifests")).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination()
        rows = sorted((r["path"], r["value"]) for r in session.read.parquet(str(tmp_path / "out")).collect())
        new = list(rows)
        for r in told:
            new.remove(r)
        told[:] = rows
        return new

    told: list = []
    for k in range(5):
        put(folder, f"s/{k}", f"text {k}")
    assert run() == [(f"s/{k}", f"text {k}") for k in range(5)]
    put(folder, "s/1", "text 1")  # the same content, written again
    put(folder, "s/3", "other")
    put(folder, "s/9", "new")
    assert run() == [("s/3", "other"), ("s/9", "new")]
    os.remove(f"{folder}/s/9")
    put(folder, "s/4", "text four")
    assert run() == [("s/4", "text four")]
    put(folder, "s/9", "new")
    assert run() == [("s/9", "new")]


def test_files_of_known_size_and_time_are_not_opened(tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    for k in range(20):
        put(folder, f"s/{k}", f"text {k}")
    known = folders.scan(folder, {})
    opened = []
    monkeypatch.setattr(folders, "_file_id", lambda p, f=folders._file_id: (opened.append(os.path.basename(p)), f(p))[1])
    put(folder, "s/7", "longer text")
    put(folder, "s/21", "new")
    again = folders.scan(folder, known)
    assert sorted(opened) == ["21", "7"]
    assert {p for p in again if known.get(p, [None])[0] != again[p][0]} == {"s/7", "s/21"}
