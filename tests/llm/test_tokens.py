"""Token shards and byte-level BPE: against the libraries, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import rows_by_text

from mergewright.llm import bpe, queries, sstable


@pytest.fixture(scope="module")
def ranked():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.model_from_ranks(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def plain():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def noise(n):
    rng = random.Random(7)
    odd = "    　\t\n\r\x0b\x1c\x1f\x85᠎​ 'sSdé漢字🙂👩‍👧 ab12½²!?.,;́İßﬁ"
    return ["".join(rng.choice(odd) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_pieces_equal_tiktoken(ranked):
    model, enc = ranked
    texts = noise(4000)
    for t, raw in zip(texts, bpe.PieceEncoder(model)(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == enc.encode_ordinary(t), repr(t)


def test_pieces_equal_the_library(plain):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(plain)
    texts = [*noise(4000), "end <|endoftext|> more", "<|endoftext|>", " <|endoftext|><|endoftext|>\n<|endoftext", "a" * 60 + "<|endoftext|>é"]
    assert 50256 in whole.encode(texts[-4], add_special_tokens=False).ids
    for t, raw, e in zip(texts, bpe.PieceEncoder(plain, "H")(texts), whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == e.ids, repr(t)


def test_full_memory_changes_nothing(ranked, monkeypatch):
    model, enc = ranked
    monkeypatch.setattr(bpe, "KEPT", 20)
    encoder = bpe.PieceEncoder(model)
    for t in noise(300):
        assert np.frombuffer(encoder([t])[0], "<u4").tolist() == enc.encode_ordinary(t)


def test_offsets_and_split_characters(ranked):
    model, _ = ranked
    table = bpe.token_table(model)
    lengths = np.array([len(x) for x in table])
    text = "aé漢🙂 🙂z"
    ids = np.frombuffer(bpe.PieceEncoder(model)([text])[0], "<u4")
    starts, inside = bpe.char_starts(ids, lengths, text.encode())
    assert inside > 0 and starts[0] == 0 and (np.diff(starts) >= 0).all() and starts[-1] < len(text)
    assert "".join(bpe.token_texts(ids.tolist(), table)) == text
    assert bpe.token_texts(ids[:-1].tolist() + [table.index(b"\xf0")], table)[-1] == "�"


def test_operator_on_odd_rows(spark, docs_of, odd_rows, ranked):
    model, enc = ranked
    docs = docs_of(odd_rows)
    coded = bpe.encode(docs, model, ["doc_id", "hash"])
    texts = {t or "" for _, t, _ in odd_rows}
    want = sorted((d is not None, d or 0, enc.encode_ordinary(t or "")) for d, t, _ in odd_rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in coded.collect()) == want
    back = {bytes(r.decoded).decode() for r in bpe.decode(coded, model, ["doc_id"]).collect()}
    assert back == texts
    with pytest.raises(ValueError, match="clash"):
        bpe.encode(docs, model, ["ids"])
    trip = {r.text or "": r for r in bpe.round_trip(docs, model, ["doc_id", "text"]).collect()}
    assert bpe.round_trip(docs, model, ["hash"]).count() == len(odd_rows)
    apart = {r.text or "": r for r in bpe.encode(docs, model, ["text"], "text").collect()}
    for t in texts:
        r, ids = trip[t], enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.n_inside == apart[t].n_inside and r.last_start == (apart[t].char_starts[-1] if ids else None)


def test_empty_tables(spark, docs_of, ranked, plain, tmp_path):
    empty = docs_of([])
    assert bpe.decode(bpe.encode(empty, ranked[0], ["doc_id"]), ranked[0], ["doc_id"]).count() == 0
    shards = sstable.write_shards(empty, tmp_path.as_uri(), plain, 0)
    assert sstable.digests(shards).count() == 0


def test_shards_round_trip_and_lookup(spark, docs_of, odd_rows, plain, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(plain)
    from pyspark.sql import functions as F

    hashed = {r.text: r.h for r in docs_of(odd_rows).select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]], r[1] or ""))
    shards = sstable.write_shards(docs_of(odd_rows).repartition(3), tmp_path.as_uri(), plain, 0)
    start, want = 0, []
    for d, t, _ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, start, ids))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, list(r.ids)) for r in sstable.read_shards(shards).collect()), key=lambda r: r[1])
    assert got == want
    sums = sorted((r.start, r.n_tokens, r.ids_crc32) for r in sstable.digests(shards).collect())
    assert sums == [(s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for _, s, i in want]
    asked = spark.createDataFrame([(3,), (9,), (99,), (None,)], "doc_id long")
    found = [(r.doc_id, list(r.ids)) for r in sstable.lookup(shards, asked).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(found, key=key) == sorted(((d, i) for d, _, i in want if d in (3, 9, None)), key=key)


def test_rows_of_a_hot_identifier_are_dealt_out(spark, docs_of, plain, tmp_path):
    """Rows of one id lie in several shards, rows that are alike in id and text too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(None if i % 3 else 7 if i % 2 else i, f"text {i} <|endoftext|>" if i < 150 else "alike", "s") for i in range(300)]
    shards = sstable.write_shards(docs_of(rows).repartition(4), tmp_path.as_uri(), plain, 0)
    assert shards.count() > 2 and shards.where("first_key = last_key").count() > 1
    got = sstable.digests(shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _, _ in rows), key=lambda d: (d is not None, d))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
    asked = spark.createDataFrame([(7,), (None,), (6,), (1,)], "doc_id long")
    found = sstable.lookup(shards, asked).groupBy("doc_id").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: r["count"] for r in found} == {d: sum(x == d for x, _, _ in rows) for d in (7, None, 6)}


def test_order_within_an_identifier_is_the_same_at_every_size(spark, docs_of, plain, tmp_path):
    """Rows of another id, however many, change nothing in the order of an id's rows."""
    few = [(1, "a b c", "s"), (1, "one two three four", "s"), (1, "x", "s")]
    order = []
    for i, rows in enumerate((few, few + [(2, f"row {j}", "s") for j in range(11_000)])):
        shards = sstable.write_shards(docs_of(rows), (tmp_path / str(i)).as_uri(), plain, 0)
        order.append([(r.start, r.n_tokens) for r in sstable.digests(shards).where("doc_id = 1").orderBy("start").collect()])
    assert order[0] == order[1]



def test_shard_blocks_and_filter(tmp_path):
    path = tmp_path / "one.sst"
    with path.open("wb") as f:
        w = sstable.Writer(f, 2)
        for d in range(0, 60_000, 3):
            w.add(sstable.key_of(d), np.array([d % 50_000, 0], "<u2").tobytes())
        w.close()
    r = sstable.Reader(path.as_uri())
    assert len(r.index) >= 3 and r.entries == 20_000 and r.ids == 40_000
    assert r.lookup(sstable.key_of(2_997)) == [np.array([2_997, 0], "<u2").tobytes()] and r.lookup(sstable.key_of(2_998)) == []
    wrong = sum(r.may_hold(sstable.key_of(d)) for d in range(1, 30_000, 3))
    assert wrong < 300 and all(r.may_hold(sstable.key_of(d)) for d in range(0, 3_000, 3))
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged|decompress|ZSTD|Corrupt"):
        list(sstable.Reader(path.as_uri()))


def test_queries(spark, ranked, plain):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = rows_by_text(spark, sf)
    whole, start, want = Tokenizer.from_str(plain), 0, []
    for d, t in docs:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op1_token_shards(spark, sf).collect())) == want
    got = {r.doc_id: r for r in queries.op7_byte_bpe(spark, sf).collect()}
    for d, t in docs:
        ids = ranked[1].encode_ordinary(t)
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
