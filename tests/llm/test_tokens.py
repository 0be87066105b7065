import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayloom.llm import packing, tokenfile
from assayloom.llm.packing import Packer, Piece
from assayloom.llm.tokens import default_path

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoded(docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda df: [(r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")) for r in df.select("doc_id", "text").collect()]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=50))
def test_code_round_trip(values):
    control, data = tokenfile.encode(np.array(values, np.uint32))
    assert tokenfile.decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values)).tolist() == values


def checked_files(rows, want):
    want = sorted(want, key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    for r, (d, ids) in zip(sorted(rows, key=lambda r: r.start), want):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(want)


def test_files(spark, docs, odd, none, encoded, tmp_path):
    checked_files(tokenfile.token_files(docs).collect(), encoded(docs))
    shards = tokenfile.write_token_files(docs.repartition(3), str(tmp_path / "f"), shard_ids=40_000)
    assert len(shards) > 5
    small = tokenfile.write_token_files(docs.repartition(3), str(tmp_path / "g"), shard_ids=40_000, file_ids=3_000)  # files within a range
    assert max(part for _, part in small) > 0
    checked_files(tokenfile.read_token_files(spark, str(tmp_path / "g"), small).collect(), encoded(docs))
    checked_files(tokenfile.read_token_files(spark, str(tmp_path / "f"), shards).collect(), encoded(docs))
    checked_files(tokenfile.token_files(odd).collect(), encoded(odd))
    assert tokenfile.token_files(none).count() == 0


def checked_packing(rows, want, limit=4096):
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    texts = {}
    for d, ids in want:
        texts.setdefault(d, []).append(ids)
    for d, copies in texts.items():
        if len(copies) > 1:
            assert sum(r.length for r in by[d]) == sum(map(len, copies))
            continue
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(copies[0]) and zlib.crc32(copies[0][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(copies[0])
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
        padding += limit - at if at & (at - 1) else 0
    return padding


def test_packing(docs, odd, none, encoded):
    assert checked_packing(packing.pack_documents(docs).collect(), encoded(docs)) == 0
    assert checked_packing(packing.pack_documents(odd).collect(), encoded(odd)) == 0
    assert packing.pack_documents(none).count() == 0


def test_limits_on_segments_and_loss():
    rng = np.random.default_rng(2)
    packer, out, given_ids = Packer(tokens=64, segments=4, loss=20), [], 0
    for k in range(300):
        n = int(rng.integers(1, 90))
        given_ids += n
        out += packer.add(Piece(k, 0, np.arange(n), n, rng.random(n) < 0.4))
    out += packer.finish()
    assert sum(s.length for s in out) == given_ids
    for s in out:
        assert s.length <= 64 and len(s.pieces) <= 4 and sum(int(p.loss.sum()) for p in s.pieces) <= 20
    for k in range(300):
        mine = sorted((p.start, len(p.ids)) for s in out for p in s.pieces if p.key == k)
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and mine[0][0] == 0


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that a polynomial in arithmetic modulo 2^64 can't tell apart from 1,024 letters on."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_a_polynomial_hash_confuses(spark, encoded):
    rows = spark.createDataFrame([(k, f"x {a} y {b} z") for k, n in enumerate((1024, 2048, 4096)) for a, b in [thue_morse(n)]], "doc_id long, text string")
    checked_files(tokenfile.token_files(rows).collect(), encoded(rows))
    assert checked_packing(packing.pack_documents(rows).collect(), encoded(rows)) == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB.é'1<|>"), min_size=1, max_size=120), min_size=1, max_size=12), st.integers(1, 3))
def test_ids_of_any_words(words, batches):
    from tokenizers import Tokenizer

    from assayloom.llm.tokens import ids_for

    t, text = Tokenizer.from_file(default_path()), " ".join(words)
    data = np.frombuffer(text.encode(), np.uint8)
    for _ in range(batches):  # later times come from the worker's table
        flat, ends = ids_for(default_path()).of(data, np.array([0, len(data)]))
        assert flat.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2] and ends.tolist() == [0, len(flat)]


def test_ids_when_the_table_starts_anew(encoded, docs, monkeypatch):
    from assayloom.llm import tokens

    monkeypatch.setattr(tokens, "POOL", 500)
    monkeypatch.setattr(tokens, "MEMO", 50)
    mine = tokens.Ids(default_path())
    for (_, want), r in zip(encoded(docs.limit(60)), docs.limit(60).collect()):
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        assert mine.of(data, np.array([0, len(data)]))[0].tolist() == want.tolist()


def test_turns_are_packed_under_all_limits(spark, sf_dir, encoded):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = packing.pack_turns(turns, segments=8, loss=600).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        assert sum(r.length for r in parts) <= 4096 and len(parts) <= 8 and sum(r.loss_tokens for r in parts) <= 600
    assert any(sum(r.loss_tokens for r in parts) == 600 for parts in sequences.values()) and any(len(parts) == 8 for parts in sequences.values())
    want = sum(len(ids) for _, ids in encoded(turns.selectExpr("conv_id as doc_id", "text")))
    assert sum(r.length for r in rows) == want


def test_short_documents_need_no_padding(spark):
    """The limit on segments closes sequences early; what is short is cut into powers of two."""
    docs = spark.createDataFrame([(i, "two words") for i in range(6000)], "doc_id long, text string").coalesce(2)
    rows = packing.pack_documents(docs).groupBy("sequence_id").agg({"length": "sum", "*": "count"}).toDF("sequence_id", "n", "tokens").collect()
    sizes = [sorted(r[1:])[-1] for r in rows]
    assert all(size & (size - 1) == 0 and size <= 4096 for size in sizes) and sum(sizes) == packing.pack_documents(docs).agg({"length": "sum"}).first()[0]
    assert max(min(r[1:]) for r in rows) <= packing.SEGMENTS
