import pytest

from loomspan.functions.lexemes import english_lexemes, matches, stem


# pairs of the published vocabulary of the algorithm
@pytest.mark.parametrize("word, want", [
    ("consigned", "consign"), ("consistency", "consist"), ("consolation", "consol"), ("constables", "constabl"), ("knightly", "knight"), ("knots", "knot"), ("kneeled", "kneel"),
    ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("ties", "tie"), ("cries", "cri"), ("generously", "generous"), ("national", "nation"), ("relational", "relat"),
    ("happiness", "happi"), ("decided", "decid"), ("decision", "decis"), ("say", "say"), ("by", "by"), ("news", "news"), ("skies", "sky"), ("agreed", "agre"), ("feed", "feed")])
def test_stems(word, want):
    assert stem(word) == want


def test_matching_needs_all_lexemes(spark):
    rows = spark.createDataFrame([("The runners were running fast",), ("nothing",), (None,)], "t string").select(english_lexemes("t").alias("x"))
    assert rows.first().x == ["fast", "run", "runner"]
    assert rows.where(matches(rows.x, "fastest runs")).count() == 0
    assert rows.where(matches(rows.x, "the fast runs")).count() == 1
    assert rows.where(matches(rows.x, "the of")).count() == 0
