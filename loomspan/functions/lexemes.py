"""English full-text matching: words to lexemes, and queries that need all of theirs.

Stemming follows the published English (Porter2) rules.  It has no counterpart
among Spark's functions, so it runs in an Arrow-batched pandas function; matching
is an expression over the arrays.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not indexed.
STOP_WORDS = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by
for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any
both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split())
# Exceptions and suffixes of the published algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
          "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
_V = "aeiouy"


def _region(w: str, start: int = 0) -> int:
    m = re.compile(f"[{_V}][^{_V}]").search(w, start)
    return m.end() if m else len(w)


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.match(f"^[{_V}][^{_V}]$", w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    if word in _KEPT:
        return word
    w = re.sub(f"(^|(?<=[{_V}]))y", "Y", word.lstrip("'"))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in _KEPT:
        return w
    if s := _longest(w, ("eed", "eedly")):
        if len(w) - len(s) >= r1:
            w = w[:-len(s)] + "ee"
    elif (s := _longest(w, ("ed", "edly", "ing", "ingly"))) and re.search(f"[{_V}]", w[:-len(s)]):
        w = w[:-len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if re.search(f".[^{_V}][yY]$", w):
        w = w[:-1] + "i"
    s = _longest(w, (*_STEP2, "ogi", "li"))
    if s and len(w) - len(s) >= r1:
        if s in _STEP2:
            w = w[:-len(s)] + _STEP2[s]
        elif s == "ogi" and w.endswith("logi"):
            w = w[:-1]
        elif s == "li" and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    s = _longest(w, (*_STEP3, "ative"))
    if s and len(w) - len(s) >= r1:
        if s in _STEP3:
            w = w[:-len(s)] + _STEP3[s]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    s = _longest(w, (*_STEP4, "ion"))
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[:-len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _lexemes(text: str | None) -> list[str] | None:
    if text is None:
        return None
    return sorted({stem(w) for w in re.findall(r"[a-z0-9']+", text.lower()) if w not in STOP_WORDS and w.strip("'")})


def english_lexemes(text: Column | str) -> Column:
    """Sorted distinct lexemes of each text; null for null."""
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(_lexemes)

    return F.pandas_udf(batch, "array<string>")(text)


def matches(lexemes: Column, query: str) -> Column:
    """Whether an array of lexemes has all of the query's; a query of stop words alone matches nothing."""
    wanted = _lexemes(query)
    if not wanted:
        return F.lit(False)
    out = F.lit(True)
    for w in wanted:
        out = out & F.array_contains(lexemes, w)
    return out
