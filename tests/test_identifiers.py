"""Identifiers, addresses and part texts on literal and odd values."""

from pyspark.sql import functions as F

from loomspan.functions import identifiers


def test_identifiers_are_whole_values(spark):
    rows = [("abcdefgh", True), ("abcdefg", False), ("abcdefgh\n", False), (".bcdefgh", False), ("a" * 128, True), ("a" * 129, False), ("", False), (None, None)]
    df = spark.createDataFrame(rows, "v string, want boolean")
    for r in df.select("*", identifiers.matches(F.col("v"), identifiers.IDENTIFIER).alias("got")).collect():
        assert r.got == r.want, r


def test_loopback_addresses(spark):
    rows = [("127.0.0.1", True), (" [::1] ", True), ("::FFFF:127.0.0.1", True), ("127.0.0.2", False), ("localhost", False), ("", False), (None, None)]
    df = spark.createDataFrame(rows, "v string, want boolean")
    for r in df.select("*", identifiers.is_loopback(F.col("v")).alias("got")).collect():
        assert r.got == r.want, r


def test_parts_without_text_count_as_empty(spark):
    rows = [([("a",), (None,), ("b",)], "a\n\nb"), ([(None,)], ""), ([], ""), (None, "")]
    df = spark.createDataFrame(rows, "parts array<struct<text string>>, want string")
    for r in df.select("*", identifiers.parts_text(F.col("parts"), "\n").alias("got")).collect():
        assert r.got == r.want, r
