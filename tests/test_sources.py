"""Pipe-delimited scan (A1): header, explicit schema, NaN markers become NULL (S3)."""

import os
import tempfile

from pyspark.sql import types as T

from dialsift.operators import stats
from dialsift.sources.delimited import infer_schema, read_delimited, read_inferred


def test_delimited_nan_is_null(spark):
    base = tempfile.mkdtemp(prefix="dialsift-pipe-")  # a local file written by the test itself
    with open(os.path.join(base, "a.txt"), "w", encoding="utf-8") as f:
        f.write("CODIGO|Edad|GEnero\n1|NaN|F\n2|41.5|\n3||Ñ\n")
    schema = T.StructType([T.StructField("CODIGO", T.LongType()), T.StructField("Edad", T.DoubleType()),
                           T.StructField("GEnero", T.StringType())])
    rows = {r["CODIGO"]: r for r in read_delimited(spark, base, schema).collect()}
    assert rows[1]["Edad"] is None and rows[3]["Edad"] is None
    assert rows[2]["Edad"] == 41.5 and rows[2]["GEnero"] is None
    assert rows[3]["GEnero"] == "Ñ"


def test_target_topn_without_target(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert stats.target_correlation_topn(df, ["a", "b"], [], target="CD") is None


def _folder(text):
    base = tempfile.mkdtemp(prefix="dialsift-pipe-")
    with open(os.path.join(base, "a.txt"), "w", encoding="utf-8") as f:
        f.write(text)
    return base


def test_types_are_inferred_from_the_whole_file(spark):
    """The same types and values as the reference's reader gives."""
    import pandas as pd

    header = "whole|gap|dec|exp|late|big|flag|flag gap|text|none|inf|zero"
    rows = ["1|1|1.5|1e3|7|9223372036854775807|True|true||NA|inf|007", "-2||2|2.5E-1|8|1|false|NaN|Ñandú|NULL|1|0",
            "+3|3|.5|3|x9|2|TRUE|False|nan|n/a|-Infinity|12"]
    base = _folder("\n".join([header, *rows]) + "\n")
    got = read_inferred(spark, base)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema}
    frame = pd.read_csv(os.path.join(base, "a.txt"), sep="|", encoding="UTF-8")
    names = {"int64": "bigint", "float64": "double", "bool": "boolean"}
    expected = {c: names.get(str(t), "string") for c, t in frame.dtypes.items()}
    assert kinds == expected
    for mine, theirs in zip(got.orderBy("big").toPandas().to_dict("records"), frame.sort_values("big").to_dict("records"), strict=True):
        for c in header.split("|"):
            assert (pd.isna(mine[c]) and pd.isna(theirs[c])) or str(mine[c]).lower() == str(theirs[c]).lower(), c


def test_inference_of_integers_out_of_range_and_empty_files(spark):
    got = read_inferred(spark, _folder("a|b\n99999999999999999999|1\n5|2\n"))
    assert [f.dataType.simpleString() for f in got.schema] == ["double", "bigint"]
    empty = read_inferred(spark, _folder("a|b\n"))
    assert empty.columns == ["a", "b"] and empty.count() == 0 and infer_schema(spark, _folder("a|b c\n1|2\n")).names == ["a", "b c"]


def test_levels_of_a_batch_follow_the_rules():
    """Lowest and highest level and missing values of a column, each distinct value looked at once."""
    import pyarrow as pa

    from dialsift.sources.delimited import column_levels

    of = lambda *values: column_levels(pa.array(values, pa.string()))
    assert of() == (None, None, 0) and of(None, "", "NA", "nan") == (None, None, 4)
    assert of("1", " -2 ", "+3", "9223372036854775807", "-9223372036854775808", "0000000000000000000005") == (0, 0, 0)
    assert of("9223372036854775808") == (1, 1, 0) and of("1", None, "2.5", "1e3", ".5", "5.") == (0, 1, 1)
    assert of("inf", "-Infinity", "+INF") == (1, 1, 0) and of("True", "false", "TRUE") == (2, 2, 0)
    assert of("1", "true") == (0, 2, 0) and of("1", "x") == (0, 3, 0) and of("x") == (3, 3, 0)
    assert of("tRUE", "1d", "--1", "0x1f", "1_0", "٣") == (3, 3, 0)


def test_types_do_not_depend_on_how_the_file_is_cut(spark):
    """Columns whose deciding value is in another file and task than the others."""
    base = _folder("a|b|c|d\n" + "1|1|true|2\n" * 50)
    for k, row in enumerate(["2|1.5|false|9", "3||true|x"]):
        with open(os.path.join(base, f"b{k}.txt"), "w", encoding="utf-8") as f:
            f.write(f"a|b|c|d\n{row}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    kinds = []
    for size in ("64", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        kinds.append([f.dataType.simpleString() for f in infer_schema(spark, base)])
    assert kinds == [["bigint", "double", "boolean", "string"]] * 2


def test_no_pattern_is_matched_in_the_aggregate(spark, monkeypatch):
    """Inference sends a task's levels to the aggregate, not patterns of every value and column."""
    from pyspark.sql import Column

    monkeypatch.setattr(Column, "rlike", lambda *a: (_ for _ in ()).throw(AssertionError("a pattern for every value")))
    assert [f.dataType.simpleString() for f in infer_schema(spark, _folder("a|b\n1|x\n"))] == ["bigint", "string"]
