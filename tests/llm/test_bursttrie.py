import hashlib
import random
import re
import zlib

import pytest

from assayloom.llm import bursttrie


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        root = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = own.get(root, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, len(whole)))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    done = {}

    def sums(p):
        parts = [sums(k) for k in kids.get(p, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved = (len(members[p]) - 1) * words + sum(x[1] for x in parts)
        done[p] = (sum(x[0] for x in parts) or 1, saved)
        return done[p]

    if members:
        sums(())
    lo = {p: min(c for c, _ in m) for p, m in members.items()}
    ends = {p: ",".join(str(c) for c in sorted(c for c, size in m if size == len(p))) for p, m in members.items()}
    return sorted(((lo[p], len(p), lo[p[:-1]] if p else None, len(m), len(kids.get(p, [])), *done[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()), key=str)


def held(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def check(spark, rows, **limits):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert held(bursttrie.conversation_trie(df, **limits)) == brute(rows)


def test_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert held(bursttrie.conversation_trie(df)) == brute(rows)
    assert held(bursttrie.conversation_trie(df, limit=3)) == brute(rows)


@pytest.mark.parametrize("seed,limits", [(1, {"limit": 1}), (2, {"limit": 4, "turns": 10})])
def test_bushy_tries(spark, seed, limits):
    """Few different turns: deep common beginnings, conversations that end at inner nodes of heads and containers."""
    r = random.Random(seed)
    rows = [(c, t, r.choice("ua"), r.choice(["a", "a b", ""])) for c in range(150) for t in range(r.randrange(1, 7))]
    same = [(1000 + c, t, "u", f"turn {min(t, 5 + c % 3)}") for c in range(60) for t in range(8 + c % 4)]
    check(spark, rows + same, **limits)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "assistant", "b"), (1, 2, "user", "b"), (20, 0, "user", "root   a\tb"), (21, 0, None, "c"), (25, 5, "user", "word " * 50_000), (-21, 0, "u", "neg"), (-20, 0, "u", "root"), (45, 0, "u", "no root")]
    check(spark, rows)
    check(spark, rows, limit=1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "2 as lo", "3 as seq", "4 as name", "5 as depth")
    assert held(bursttrie.conversation_trie(df)) == brute(rows)
    assert bursttrie.conversation_trie(df.limit(0)).collect() == []


def test_one_turnless_conversation(spark):
    conv = next(c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0)
    check(spark, [(conv, 0, "u", "x")])


def test_pieces_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(bursttrie, "PIECE", 3)
    check(spark, [(c, t, "u", f"same {t}") for c in range(100) for t in range(4)])
