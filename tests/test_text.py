"""Text cleaning, speakers, byte ids."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.config import PipelineConfig
from voxloom.functions import text as X
from voxloom.operators import tokenize as K
from voxloom.schemas import MissingColumnsError


def test_whitespace_list_is_what_python_strips():
    assert [c for c in range(0x110000) if chr(c).isspace()] == X.PY_WHITESPACE_CODES


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(X.PY_WHITESPACE + "ab​"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=40))
def test_strip_and_bytes_as_in_python(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", X.strip_text(F.col("t")).alias("s"), X.utf8_ids(F.col("t")).alias("b")).collect()
    for r in got:
        assert r["s"] == texts[r["i"]].strip()
        assert r["b"] == list(texts[r["i"]].encode())


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "é"), (3, None), (4, "ab")], "i int, t string").coalesce(1)
    got = {r["i"]: r["b"] for r in df.select("i", X.utf8_ids(F.col("t")).alias("b")).collect()}
    assert got == {0: None, 1: [], 2: [0xC3, 0xA9], 3: None, 4: [97, 98]}


def test_length_limit(spark):
    texts = ["x" * 9, "x" * 10, "  " + "x" * 9 + "　", "\x1c" + "x" * 10, None, "🙂" * 9, "🙂" * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id int, text string")
    cleaned = K.clean_rows(df)
    assert sorted(r[0] for r in K.keep_long_enough(cleaned).select("sample_id").collect()) == [1, 3, 6]
    short = K.short_rows(cleaned).collect()
    assert sorted(r["sample_id"] for r in short) == [0, 2, 4, 5]
    assert {(r["stage"], r["reason"]) for r in short} == {("text", "short_text")}


def test_speakers(spark):
    some = spark.createDataFrame([("hello there!", "7"), ("hello there!", None)], "text string, speaker string")
    none = some.drop("speaker")

    def tagged(df, **kw):
        return sorted(r[0] for r in K.clean_rows(df, PipelineConfig(**kw)).select("tagged_text").collect())

    assert tagged(some) == ["[7]hello there!", "[999]hello there!"]
    assert tagged(some, strict_null_speaker=True) == ["[7]hello there!", "[None]hello there!"]
    assert tagged(none) == ["[999]hello there!"] * 2
    assert tagged(none, omit_speaker=True) == ["hello there!"] * 2
    numbers = some.withColumn("speaker", F.lit(3))
    assert tagged(numbers) == ["[3]hello there!"] * 2


def test_missing_column_is_an_analysis_error(spark):
    with pytest.raises(MissingColumnsError):
        K.clean_rows(spark.range(1))
