import pytest
from pyspark.sql import functions as F

from docweave.functions import polarity, text, values


def column(spark, raw, build):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(build(F.col("x"))).collect()]


def test_match_keys(spark):
    assert column(spark, ["  Straße\u00a0 12 ;.", "Dr. Prof. Lang", "drake"], lambda x: text.norm_key(x, strip_titles=True)) == ["strasse 12 ", "lang", "drake"]
    assert column(spark, ["A  b\x1fC.,;"], text.norm_key) == ["a b c"]
    assert column(spark, ["Page 3 of 29"], text.furniture_key) == ["page # of #"]


@pytest.mark.parametrize(
    "raw, number",
    [("1.234,5", 1234.5), ("12,5 %", 12.5), ("1.284", 1.284), ("1 000", 1000.0), ("x", None), ("1d", None), ("inf", None), ("", None)],
)
def test_numbers(spark, raw, number):
    assert column(spark, [raw], values.number) == [number]


def test_readers_keep_what_they_cannot_read(spark):
    read = lambda raw, f: [tuple(r) for r in column(spark, raw, f)]
    assert read(["-2,7", "x", None], values.as_int) == [("-2", None), ("x", "no whole number"), (None, None)]
    assert read(["31.2.2024", "\t2024-02-31\n", "soon"], values.as_date) == [("2024-02-31", None), ("2024-02-31", None), ("soon", "no date in a known form")]
    assert read(["\tJa\n", "falsch", "2"], values.as_bool) == [("true", None), ("false", None), ("2", "no truth value")]
    assert read(["HIGH ", "?"], lambda x: values.as_enum(x, ["low", "high"])) == [("high", None), ("?", "none of the values ['low', 'high']")]
    assert read(["T-1", "T-1\nx"], lambda x: values.as_text(x, r"T-\d+"))[1][1] is not None


def test_polarity(spark):
    rows = [(None, "nothing said"), (None, "das ist nicht so"), ("Negativ", ""), ("ja", "kein Zugang"), ("vielleicht", ""), ("verneint", ""), ("", "Knicht"), (None, "Mandant ohne")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, e string").orderBy("i")
    got = [r[0] for r in df.select(polarity.polarity(F.col("raw"), F.col("e"))["polarity"]).collect()]
    assert got == ["positive", "unknown", "negative", "positive", "unknown", "negative", "positive", "unknown"]


def test_hyphens(spark):
    assert column(spark, ["host- name-3", "Ein- und Ausgang", "a - b"], text.dehyphenate) == ["host-name-3", "Ein- und Ausgang", "a - b"]
