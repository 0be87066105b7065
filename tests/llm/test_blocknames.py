import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assayloom.llm import blocknames


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(fold(text), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = [i for i in groups[fold(text)] if i is not None]
        keep = max(ids) if ids else None
        out.append((doc_id, keep, len(groups[fold(text)]), doc_id == keep, hashlib.sha256(fold(text).encode()).hexdigest()))
    return out


def held(df):
    order = lambda r: tuple(str(x) for x in r)
    return sorted((tuple(r) for r in blocknames.exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=order)


def check(spark, rows, schema="doc_id long, text string"):
    want = sorted(brute(rows), key=lambda r: tuple(str(x) for x in r))
    assert held(spark.createDataFrame(rows, schema).repartition(4)) == want


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert held(odd) == sorted(brute(rows), key=lambda r: tuple(str(x) for x in r))
    assert blocknames.exact_duplicates(none).collect() == []


@pytest.mark.parametrize("block", [2])
def test_tiny_blocks(spark, monkeypatch, block):
    """Many levels, odd numbers of blocks, texts that are prefixes of each other, block borders within a letter."""
    monkeypatch.setattr(blocknames, "BLOCK", block)
    r = random.Random(block)
    texts = ["a" * n for n in range(20)] + ["ab" * n for n in range(12)] + ["".join(r.choice("aAbÄä\U0001f642") for _ in range(r.randrange(40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.swapcase() if t.isascii() else t) for i, t in enumerate(texts)]
    check(spark, rows + [(None, "zz"), (None, "ZZ"), (None, None), (7, texts[7])])


def test_only_ascii_letters_fold(spark):
    check(spark, [(1, "É"), (2, "é"), (3, "É A"), (4, "É a"), (5, "İI"), (6, "İi"), (7, "ΑΣ"), (8, "ας"), (9, "K"), (10, "k"), (11, "K")])


def test_hot_text(spark):
    rows = [(i, "the very same text " * 300 if i % 3 == 0 else f"text {i} " + "shared passage " * 200) for i in range(600)]
    check(spark, rows)


def test_deduplicated_keeps_one_row_of_each_text(spark, odd):
    kept = blocknames.deduplicated(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, fold(r.text)) for r in kept.select("doc_id", "text").collect()]
    every = {}
    for r in odd.select("doc_id", "text").collect():
        every.setdefault(fold(r.text), []).append(r.doc_id)
    best = sorted((str(max((i for i in ids if i is not None), default=None)), t) for t, ids in every.items())
    assert sorted((str(i), t) for i, t in rows) == best


def test_hashes_that_collide_are_not_used(spark, monkeypatch, docs):
    monkeypatch.setattr(blocknames, "_hashes", lambda: [(F.xxhash64("block") % 5).alias("h1"), F.lit(0).alias("h2")])
    few = docs.limit(80).select("doc_id", "text")
    assert held(few) == sorted(brute([tuple(r) for r in few.collect()]), key=lambda r: tuple(str(x) for x in r))


def test_no_python_in_the_plans(spark, docs):
    plan = blocknames.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
