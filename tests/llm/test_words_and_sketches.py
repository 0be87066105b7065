import numpy as np
from pyspark.sql import functions as F
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from assayloom.llm import common, fastsketch
from assayloom.llm.components import connected_components

TEXTS = st.lists(st.text(alphabet=" \t\n\x0b\x1cabAB.é\U0001f642", max_size=40), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_word_hashes_follow_split(texts):
    data, offsets = common.raw(common.byte_texts(pa.array(texts, pa.string())))
    hashed, rows = common.word_hashes(data, offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in t.encode().lower().split()]
    assert rows.tolist() == [i for i, _ in want]
    by = {}
    for h, (_, w) in zip(hashed.tolist(), want):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    data, offsets = common.raw(common.byte_texts(pa.array(texts, pa.string())))
    for t, s in zip(texts, common.shingle_sets(data, offsets)):
        w = t.encode().lower().split()
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(s) == len(want)


def test_sketches_fill_and_concentrate():
    rng = np.random.default_rng(1)
    for n in (1, 3, 50, 2000):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2 + 1], rng.integers(0, 1 << 62, len(a) - len(a) // 2, dtype=np.uint64)]))
        s = fastsketch.fast_sketches([a, b, a])
        assert not (s == np.uint64(0xFFFFFFFFFFFFFFFF)).any() and (s[0] == s[2]).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.2
    assert (fastsketch.fast_sketches([np.empty(0, np.uint64)]) == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(docs):
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in fastsketch.near_duplicates(docs).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_large_group_of_near_copies(spark):
    """A chain of edits: few of the group are near its first document, all hang together."""
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        if k:
            words[(k * 7) % 120] = f"new{k}"
        rows.append((k, " ".join(words)))
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in fastsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_one_id_with_two_texts(spark):
    """Document 5 has two texts, each near another document's: all three are reachable from each other."""
    a, b, c = ([f"{x}{k}" for k in range(100)] for x in "abc")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join([*b[:99], "x"])), (7, " ".join([*a[:99], "x"])), (3, " ".join(["y", *c[1:]])), (9, " ".join(c)), (9, " ".join(a)), (11, "alone among all of the documents here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in fastsketch.near_duplicates(df).collect())
    assert got == [(3, 96, 3, True), (5, 96, 3, False), (5, 96, 3, False), (6, 96, 3, False), (7, 96, 3, False), (9, 96, 3, False), (9, 96, 3, False), (11, 3, 11, True)]


def test_words_that_a_polynomial_hash_confuses(spark):
    bits = [k.bit_count() & 1 for k in range(2048)]
    rows = [(1, "x " + "".join("ab"[b] for b in bits)), (2, "x " + "".join("ba"[b] for b in bits)), (3, "x " + "".join("ab"[b] for b in bits))]
    got = {r.doc_id: r.component_id for r in fastsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_planted_pairs_at_the_threshold(spark):
    """300 pairs of similarity 0.75 to 0.80 and 300 just below: none lost, none made up."""
    rng, rows, want = np.random.default_rng(12), [], {}
    for k in range(600):
        x = [f"d{k}w{i}" for i in range(int(rng.integers(60, 160)))]
        n = len(x) - 4
        # words replaced at the end take as many shingles: similarity (n - m) / (n + m)
        m = int(rng.integers(int(np.ceil(0.2 / 1.8 * n)), int(0.25 / 1.75 * n) + 1)) if k < 300 else int(0.25 / 1.75 * n) + 1
        rows += [(2 * k, " ".join(x)), (2 * k + 1, " ".join([*x[: len(x) - m], *(f"e{k}w{i}" for i in range(m))]))]
        want[2 * k + 1] = 2 * k if 100 * (n - m) >= 75 * (n + m) else 2 * k + 1
    got = {r.doc_id: r.component_id for r in fastsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(v != k for k, v in want.items()) == 300 and all(got[k] == v for k, v in want.items())


def test_cells_of_a_large_bucket(spark, monkeypatch):
    """Many unlike documents in one bucket, compared cell by cell: only the like ones hang together."""
    from assayloom.llm import banding

    monkeypatch.setattr(banding, "CELL", 8)
    rows = [(k, [1], [k // 3]) for k in range(90)]
    classes = spark.createDataFrame([(k, k, k, keys, v) for k, keys, v in rows], "c long, id long, h long, keys array<long>, v array<long>")
    import tempfile

    found = banding.components_of(classes, tempfile.mkdtemp(prefix="spark-test-"), F.col("v_a")[0] == F.col("v_b")[0])
    assert {r.id: r.component for r in found.collect()} == {k: k // 3 * 3 for k in range(90)}


def test_very_large_sets_keep_their_links(spark):
    x = [f"w{k}" for k in range(200_000)]
    rows = [(1, " ".join(x)), (2, " ".join([*x[:172_000], *(f"v{k}" for k in range(28_000))])), (3, " ".join(f"u{k}" for k in range(50)))]
    got = {r.doc_id: r.component_id for r in fastsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_odd_documents(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in fastsketch.near_duplicates(odd).collect()), key=str)
    by = {}
    for d, n, c, k in got:
        by.setdefault(d, []).append((n, c, k))
    assert by[1] == [(8, 1, True)] and by[2] == [(8, 1, False)] and by[3] == [(0, 3, True)] and by[5] == [(0, 5, True)]
    assert by[6] == [(1, 6, True)] * 2 and by[7] == [(1, 7, True)] and by[None][0][1:] == (None, True)
    assert fastsketch.near_duplicates(none).count() == 0


def test_hot_hub(spark, tmp_path, monkeypatch):
    from assayloom.llm import components

    monkeypatch.setattr(components, "NODE_ROWS", 1000)
    links = [(k, 5) for k in range(6, 2_500)] + [(k, 5_000) for k in range(2_500, 5_000)] + [(5_000, 2_499), (9_000, 8_999)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), str(tmp_path), "h").collect()}
    assert got == {**{k: 5 for k in range(5, 5_001)}, 8_999: 8_999, 9_000: 8_999}


def test_components(spark, tmp_path):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (8, 9), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in connected_components(links, str(tmp_path), "t").collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
