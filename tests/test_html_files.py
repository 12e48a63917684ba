"""Landing of pages as files: one row a file, dealt by rows to folders."""

import os

from pyspark.sql import functions as F

from murmura.sources import html_files as H


def _files(root):
    return [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith((".txt", ".crc"))]


def test_rows_of_one_partition_are_dealt_to_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "FOLDER", 5)
    rows = [(f"page {i % 150}\nb",) for i in range(298)] + [(None,), ("",)]
    H.land_files(spark.createDataFrame(rows, "value string").coalesce(1), f"{tmp_path}/a")
    files = _files(f"{tmp_path}/a")
    folders = [os.path.dirname(f) for f in files]
    assert len(files) == 300 and all(f.endswith(".txt") for f in files)          # no checksum file beside each
    assert len(set(folders)) == 60 and max(map(folders.count, folders)) <= 15
    got = sorted(r.html for r in H.read_html_files(spark, f"{tmp_path}/a", ext=".txt").collect())
    assert got == sorted((r[0] or "") + "\n" for r in rows)


def test_no_rows_leave_an_empty_folder(spark, tmp_path):
    H.land_files(spark.createDataFrame([], "value string").select(F.col("value")), f"{tmp_path}/a")
    assert H.read_html_files(spark, f"{tmp_path}/a", ext=".txt").count() == 0
