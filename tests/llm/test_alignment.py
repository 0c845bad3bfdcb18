"""Alignment of tokenizers against walking both token lists document by document."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mergewright.llm import alignment, bpe, queries

BYTE_MODEL = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
PIECE_MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_str(BYTE_MODEL), sentencepiece.SentencePieceProcessor(model_proto=PIECE_MODEL)
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(bpe.byte_alphabet())}

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        raw = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else ([], [])

    def run(docs):
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each of docs (doc_id, text)."""
        linked = []
        for d, t in docs:
            left, right = tokens(t)
            ends, spans = [], []
            for side in (left, right):
                at, out = 0, []
                for i, raw in side:
                    out.append((i, at, at + len(raw)))
                    at += len(raw)
                spans.append(out)
                ends.append({e for _, _, e in out})
            groups, links, i, j = [], [], 0, 0
            for end in sorted(ends[0] & ends[1]):
                ga, gb = [], []
                while i < len(left) and spans[0][i][2] <= end:
                    ga.append(spans[0][i])
                    i += 1
                while j < len(right) and spans[1][j][2] <= end:
                    gb.append(spans[1][j])
                    j += 1
                groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
                links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
            linked.append((d, len(left), len(right), groups, links))
        counts = Counter(p for *_, links in linked for p in links)
        top = {}
        for (_, y), n in counts.items():
            top[y] = max(top.get(y, 0), n)
        return [(d, na, nb, len(g), len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, ls in linked]

    return run


def found(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_query_equals_walk(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.QUERIES["op11_token_alignment"](spark, sf)) == sorted(plain(docs), key=str)


@pytest.mark.parametrize("head", [0, 7, 300])
def test_odd_rows_with_any_head(spark, docs_of, odd_rows, plain, head):
    rows = odd_rows + [(20, "a▁b", "s"), (21, " lead", "s"), (22, "trail ", "s"), (23, "a  b   c \n d", "s"), (24, "<s>x</s> <unk> <0x41>", "s"), (25, "é ﬁ ¼　Ａ", "s"), (26, "   ", "s"), (27, "字 漢  漢", "s"), (28, " ", "s"), (29, "a  b", "s")]
    got = alignment.aligned(docs_of(rows), BYTE_MODEL, PIECE_MODEL, ["doc_id"], head)
    assert found(got) == sorted(plain([(d, t) for d, t, _ in rows]), key=str)


def test_empty_tables_and_clashes(spark, docs_of):
    assert alignment.aligned(docs_of([]), BYTE_MODEL, PIECE_MODEL, ["doc_id", "pair_name"][:1]).count() == 0
    assert [tuple(r)[1:] for r in alignment.aligned(docs_of([(1, None, "s"), (2, "", "s")]), BYTE_MODEL, PIECE_MODEL, ["doc_id"]).collect()] == [(0, 0, 0, 0, "", 0, 0)] * 2
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        alignment.aligned(docs_of([]).withColumn("n_a", F.lit(1)), BYTE_MODEL, PIECE_MODEL, ["n_a"])


def test_parts_equal_whole_texts():
    import random

    rng = random.Random(3)
    pieces = alignment.Pieces(PIECE_MODEL)
    assert pieces.parted
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "漢", "é", "\n", "   x", ".", "🙂", "\t "]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    assert pieces(texts) == pieces._encode(texts)
