import os
import uuid

import pytest

from dialsift.session import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def written(spark):
    """Write rows as a Parquet table of several files and read it back."""

    def make(rows, schema="doc_id long, text string", parts=4):
        path = os.path.join(spark.sparkContext.getCheckpointDir(), f"rows-{uuid.uuid4().hex}")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make


#: null, empty, white, very short and very long texts, ties and repeated rows
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "Line\nline \nother\n"), (7, "é漢字 🙂 \x1c\x85 it's"),
           (8, "word " * 30_000), (9, "x" * 120_000), (10, "same text here for you"), (11, "same text here for you"),
           (11, "same text here for you"), (None, "same text here for you"), (None, None), (12, "<|im_start|>user<|endoftext|> <\\|x|>")]


@pytest.fixture
def repacked(spark, monkeypatch):
    """Pack files into read partitions in another way after each intermediate table of ``module``, as
    Spark does when executors are lost or join."""
    packings = [("1", "0"), ("64", "4194304")]  # all files in one partition; one for each file

    def start(module):
        plain, done = module.materialise, []

        def write(df, name):
            out = plain(df, name)
            done.append(name)
            for key, value in zip(("minPartitionNum", "openCostInBytes"), packings[(len(done) - 1) % 2], strict=True):
                spark.conf.set(f"spark.sql.files.{key}", value)
            return out

        monkeypatch.setattr(module, "materialise", write)

    yield start
    for key in ("minPartitionNum", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")
