from pyspark.sql import functions as F

from feedlake.functions.text import clean_text, extract_score, split_facet, js_trim


def _one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_text_literals(spark):
    vals = ["  hello  ", "foo   bar", "line1\nline2", "col1\tcol2", "a\r\nb",
            "  Hello\n\tWorld  \r\n  ", "", None, "a\u00a0\u2003b\ufeff", "x\u000by"]
    assert _one(spark, vals, clean_text) == [
        "hello", "foo bar", "line1 line2", "col1 col2", "a b", "Hello World", "", "", "a b", "x y"]


def test_extract_score_literals(spark):
    vals = ["8.5", "CVSS: 7.2", "10", "0.0", "0", "10.0", "9", "", None, "No score", "11.5",
            "CVSS:3.1/AV:N", "-5", "7."]
    assert _one(spark, vals, extract_score) == [
        8.5, 7.2, 10.0, 0.0, 0.0, 10.0, 9.0, None, None, None, None, 3.1, 5.0, 7.0]


def test_extract_score_from_number(spark):
    assert _one(spark, [9.0], extract_score, "double") == [9.0]


def test_split_facet(spark):
    assert _one(spark, ["icon||Linux", "plain", None], split_facet) == ["Linux", None, None]


def test_js_trim(spark):
    assert _one(spark, ["\n  Patch  ", "x"], js_trim) == ["Patch", "x"]


def test_values_found_wrong_in_review(spark):
    from pyspark.sql import functions as F

    from feedlake.functions.dates import parse_published_date
    from feedlake.functions.jsoncols import decode_json
    from feedlake.functions.text import decimal_number
    from feedlake.functions.urls import url_host
    one = lambda rows, col: [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(col).collect()]
    assert one(["-9223372036854775808", "12:30:00", "T10:00", "2024-01-02"], parse_published_date("x").cast("string")) == [
        None, None, None, "2024-01-02"]
    assert one(["https://evil.com\\@github.com/x", "https://a@b@github.com/", "http://[::1]:80/", "  https://h.org/"], url_host("x")) == [
        "evil.com", "github.com", "[::1]", "h.org"]
    assert one(["not json", '{"k": 1', None, '{"k": 2}'], decode_json("x", "k bigint", F.struct(F.lit(-1).cast("bigint").alias("k")))["k"]) == [
        -1, -1, -1, 2]
    assert one(["7.5f", "7d", "0x1p3", "NaN", "7.5", " 1e2 ", ".5"], decimal_number("x")) == [None, None, None, None, 7.5, 100.0, 0.5]
