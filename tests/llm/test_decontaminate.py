import random
import re
from collections import Counter

from loomspan.llm import decontaminate, queries

from .helpers import documents, empty, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(words):
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_force(docs, items):
    """All windows of an item's length in every document."""
    out = {}
    wanted = [(k, w) for k, t in items if len(w := WORD.findall((t or "").lower())) >= 5]
    for i, text in docs:
        words = WORD.findall((text or "").lower())
        for k, w in wanted:
            own = bag(w)
            hits = [s for s in range(len(words) - 4) if tuple(words[s:s + 5]) in own]
            starts = [s for s in range(max(1, len(words) - len(w) + 1)) if any(s <= h <= s + len(w) - 5 for h in hits)]
            best = max((similarity(bag(words[s:s + len(w)]), own) for s in starts), default=0)
            if best >= 0.75:
                out[i, k] = max(best, out.get((i, k), 0))
    return out


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def got(df):
    return {(r.doc_id, r.item_id): r.similarity for r in df.collect()}


def planted():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(14, 60)))) for i in range(12)]
    docs = []
    for i in range(100):
        _, text = rng.choice(items)
        words = text.split()
        for _ in range(i % 4):
            at = rng.randrange(len(words))
            rng.choice([lambda: words.__setitem__(at, "new"), lambda: words.insert(at, "new"), lambda: words.pop(at)])()
        part = words if i % 7 else words[:len(words) // 2]
        docs.append((i, " ".join(rng.choices(vocabulary, k=i % 30) + part + rng.choices(vocabulary, k=(i * 7) % 40)).title()))
    return docs, items


def test_planted_items_are_found(spark):
    docs, items = planted()
    want, found = brute_force(docs, items), got(decontaminate.contaminated(documents(spark, docs), table(spark, items)))
    assert set(found) <= set(want) and len(want) > 25
    assert set(found) == set(want)
    assert all(found[k] <= want[k] + 1e-12 for k in found)


def test_large_benchmarks_are_not_broadcast(spark, monkeypatch):
    docs, items = planted()
    want = got(decontaminate.contaminated(documents(spark, docs), table(spark, items)))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert got(decontaminate.contaminated(documents(spark, docs), table(spark, items))) == want


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    shingles = {g for _, t in items for g in bag(WORD.findall(t.lower()))}
    near = [(i, t) for i, t in docs if shingles & set(bag(WORD.findall((t or "").lower())))]
    assert set(got(queries.op2_decontaminate(spark, sf))) == set(brute_force(near, items))


def test_repeated_shingles_count_by_number(spark):
    items = [(1, "a b c d e " * 6), (2, "x " * 20)]
    docs = [(1, "a b c d e " * 2), (2, "a b c d e " * 6), (3, "x " * 16), (4, "x " * 40)]
    found = got(decontaminate.contaminated(documents(spark, docs), table(spark, items)))
    assert found == brute_force(docs, items) and (1, 1) not in found and (4, 2) in found


def test_odd_tables(spark):
    items = [(None, "one two three four five six"), (1, None), (2, ""), (3, "one two"), (4, "one two three four five"), (4, "one two three four five")]
    assert got(decontaminate.contaminated(odd_documents(spark), table(spark, items))) == {}
    docs = documents(spark, [(1, "One two\tthree four\nfive"), (1, "One two\tthree four\nfive"), (None, "one two three four five"), (2, "one two")])
    assert got(decontaminate.contaminated(docs, table(spark, items))) == {(1, 4): 1.0}
    kept = decontaminate.decontaminate(docs, table(spark, items)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 2] and len(kept[0]) == 5
    assert decontaminate.contaminated(empty(spark), table(spark, items)).count() == 0
    assert decontaminate.contaminated(docs, table(spark, [])).count() == 0


def test_long_items_with_a_block_replaced_are_found(spark):
    """Items of 60 to 400 words of which one block is replaced, as long as similarity allows: nine in ten or more are found."""
    rng = random.Random(21)
    items, docs = [], []
    for i in range(150):
        n = (60, 100, 200, 400)[i % 4]
        words = [f"w{rng.randrange(4000)}" for _ in range(n)]
        items.append((i, " ".join(words)))
        shingles = n - 4
        k = int(shingles - 2 * shingles * 0.75 / 1.75) - 4  # replacing k words in a row loses k + 4 shingles of each side
        at = rng.randrange(1, n - k)
        docs.append((i, " ".join(["before"] * 9 + words[:at] + [f"x{rng.randrange(4000)}" for _ in range(k)] + words[at + k:] + ["after"] * 9)))
    for (_, item), (_, doc) in zip(items, docs):
        n = len(item.split())
        assert similarity(bag(doc.split()[9:9 + n]), bag(item.split())) >= 0.75
    found = got(decontaminate.contaminated(documents(spark, docs), table(spark, items)))
    recall = {n: sum((i, i) in found for i in range(150) if (60, 100, 200, 400)[i % 4] == n) / len([i for i in range(150) if (60, 100, 200, 400)[i % 4] == n]) for n in (60, 100, 200, 400)}
    print("recall by length:", recall)
    assert min(recall.values()) >= 0.9 and set(found) <= {(i, i) for i in range(150)}


def test_very_long_texts(spark):
    rng = random.Random(2)
    item = " ".join(f"w{rng.randrange(900)}" for _ in range(30))
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(150_000))
    docs = documents(spark, [(1, text), (2, text + " " + item), (3, item)])
    assert set(got(decontaminate.contaminated(docs, table(spark, [(7, item)])))) == {(2, 7), (3, 7)}
