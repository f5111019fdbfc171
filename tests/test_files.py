"""Chunked reads: split-aligned boundaries, texts with broken bytes."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.text import without_broken_bytes
from tokenloom.sources import files


@pytest.mark.parametrize("closed", [True, False])
def test_boundaries_of_files_in_many_splits(spark, tmp_path, closed):
    r = random.Random(closed)
    for n in range(3):
        parts = ["".join(r.choice("ab é\n") for _ in range(r.choice([0, 3, 40, 700]))) for _ in range(120)]
        (tmp_path / f"f{n}").write_bytes(("<|e|>".join(parts) + ("<|e|>" if closed else "end")).encode())
    (tmp_path / "none").write_bytes(b"no delimiter at all")
    (tmp_path / "tiny").write_bytes(b"a<|e|>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for chunks in (1, 4, 60):
            got = {r["path"].rpartition("/")[2]: r["boundaries"] for r in files.file_boundaries(spark, str(tmp_path), chunks, "<|e|>").collect()}
            assert got == {p.name: files.chunk_boundaries(str(p), chunks, b"<|e|>") for p in tmp_path.iterdir()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_bytes_are_left_out(spark, tmp_path):
    texts = [b"plain", b"\xe2\x82A\xff\xfe", "é漢😀�\x01b\x01".encode() + b"\xf0\x9f", b"\xed\xa0\x80x\xc0\xaf", b"", b"\x80" * 5 + b"a\x01a"]
    df = spark.createDataFrame([(bytearray(t),) for t in texts], "b binary").select(F.col("b").cast("string").alias("t"))
    assert [r["v"] for r in df.select(without_broken_bytes(F.col("t")).alias("v")).collect()] == [t.decode("utf-8", "ignore") for t in texts]
    (tmp_path / "f").write_bytes(b"one\xff<|x|>two")
    assert [r["value"] for r in files.records(spark, str(tmp_path), "<|x|>", ignore=True).collect()] == ["one", "two"]
