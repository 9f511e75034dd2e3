"""Small document tables for the tests of this subpackage."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, texts, first=0):
    """Documents of these texts; a (doc_id, text) pair names its own id."""
    rows = [x if isinstance(x, tuple) else (first + i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCUMENTS)


def odd_documents(spark):
    """Nulls in every column, empty and repeated rows."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, "one two", "en", "s", 7),
            (4, "one two", "en", "s", 7), (None, "one two", "en", "s", 7), (None, None, None, None, None), (5, "é ß 日本 \x00 x", "fr", "s", 9)]
    return spark.createDataFrame(rows, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
