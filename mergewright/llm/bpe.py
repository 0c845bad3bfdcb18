"""Byte-level BPE with the tokenizers library over Arrow batches, and back.

A rank file (token bytes in base64, rank) becomes a tokenizers model: each token's bytes are spelled in the printable
alphabet of byte-level BPE, and every split of a token into two tokens is a merge of that token's rank. The split
pattern comes from the caller. Texts are cut, before they reach the tokenizer, at spaces that a non-space follows: the
pattern never matches across such a place, so pieces can be encoded alone, and a piece that was met before is looked up.
A text that spells one of the model's own added tokens goes to the tokenizer whole, which gives such a token its id.

Cases: a null or empty text has no tokens, and decodes to no bytes; texts of any length are encoded whole (a long piece
without spaces goes to the tokenizer as it is); repeated rows give repeated rows; an empty table gives an empty table.
Only the key columns named by the caller are carried; a key column may have any name but those of the results, and one
that clashes is refused.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A space before a non-space begins a new piece of text; the rest of the text stays in the piece before it.
PIECE = re.compile(r" (?=\S)")
#: A space before another space or at the end: then str.split(" ") isn't enough.
RUN = re.compile(r" (?:\s|$)")
#: Pieces kept by a worker (about 200 bytes each); beyond, those of more than SHORT characters are dropped (short ones come
#: back more often). Pieces of more than KEPT_CHARS aren't kept at all. What isn't kept is encoded again: it costs time only.
KEPT, SHORT, KEPT_CHARS = 200_000, 8, 48
#: The same, where no other Python worker stands beside it in a task.
KEPT_ALONE = 800_000
#: New pieces that go to the tokenizer as one text; they are parted again by their bytes.
TOGETHER = 128
#: Marks that end a piece and, after a letter, are a match of their own in every byte-level pattern.
MARKS = ".,!?;:"


@lru_cache(maxsize=1)
def byte_alphabet() -> tuple[str, ...]:
    """The character that spells each byte: printable Latin-1 characters stand for themselves, the others follow from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return tuple(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a rank file with a base64 token and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def model_from_ranks(ranks: dict[bytes, int], pattern: str) -> str:
    """The tokenizers model of a rank table, as JSON."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    letters = byte_alphabet()
    spell = {t: "".join(letters[b] for b in t) for t in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(spell[a], spell[b]) for a, b in sorted(cuts, key=lambda x: (ranks[x[0]], ranks[x[1]]))]
    t = Tokenizer(models.BPE(vocab={spell[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t.to_str()


class PieceEncoder:
    """Encodes whole texts piece by piece, to little-endian ids of the kind `code` ("I" 4 bytes, "H" 2)."""

    def __init__(self, model: str, code: str = "I", kept: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.code, self.kept = code, kept or KEPT
        self.added = [x["content"] for x in json.loads(model).get("added_tokens") or []]
        self.lengths = np.array([len(x) for x in token_table(model)], np.int64)
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.marks: dict[str, bytes] = {}

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        if self.added and (whole := [i for i, t in enumerate(texts) if any(x in t for x in self.added)]):
            encoded = {i: array(self.code, self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes() for i in whole}
            rest = iter(self([t for i, t in enumerate(texts) if i not in encoded]))
            return [encoded[i] if i in encoded else next(rest) for i in range(len(texts))]
        cut = [PIECE.split(t) if RUN.search(t) else t.split(" ") for t in texts]
        for known in self.known:
            if len(known) > self.kept:
                kept = {k: v for k, v in known.items() if len(k) <= SHORT}
                known.clear()
                known.update(kept if len(kept) < self.kept // 2 else {})
        first, rest = self.known
        late = self._learn(first, {p[0] for p in cut} - first.keys(), ""), self._learn(rest, set().union(*cut).difference(rest), " ")
        out = [first[p[0]] + b"".join(map(rest.__getitem__, p[1:])) for p in cut]
        for known, long in zip(self.known, late, strict=True):
            for piece in long:
                known.pop(piece, None)
        return out

    def _learn(self, known: dict[str, bytes], pieces: set[str], lead: str) -> list[str]:
        """Encode new pieces, marks at their end apart from the word before; those that are too long to keep are returned."""
        marked, stems = [], set()
        for p in pieces:
            stem = p.rstrip(MARKS)
            if stem != p and stem[-1:].isalpha():
                marked.append((p, stem, p[len(stem) :]))
                p = stem
            if p not in known:
                stems.add(p)
        fresh = sorted(stems)
        for i in range(0, len(fresh), TOGETHER if lead else 1):
            self._encode(known, fresh[i : i + (TOGETHER if lead else 1)], lead)
        for p, stem, tail in marked:
            if (end := self.marks.get(tail)) is None:
                if len(self.marks) > self.kept // 20:
                    self.marks.clear()
                end = self.marks[tail] = array(self.code, self.tokenizer.encode(tail, add_special_tokens=False).ids).tobytes()
            known[p] = known[stem] + end
        return [p for p in (*fresh, *(m[0] for m in marked)) if len(p) > KEPT_CHARS]

    def _encode(self, known: dict[str, bytes], pieces: list[str], lead: str) -> None:
        """Encode pieces as one text and part the ids where the pieces' bytes end."""
        ids = self.tokenizer.encode_batch_fast([lead + lead.join(pieces)], add_special_tokens=False)[0].ids
        raw = array(self.code, ids)
        ends = np.cumsum([len(p.encode()) + len(lead) for p in pieces])
        at = [0, *(np.searchsorted(np.cumsum(self.lengths[np.frombuffer(raw, raw.typecode)]), ends) + 1).tolist()] if ids else [0] * (len(pieces) + 1)
        raw, width = raw.tobytes(), raw.itemsize
        for p, a, b in zip(pieces, at, at[1:], strict=False):
            known[p] = raw[a * width : b * width]


def token_table(model: str) -> list[bytes]:
    """The bytes of each token id of a byte-level model: the alphabet reversed."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    whole = json.loads(model)
    vocab, added = whole["model"]["vocab"], {x["id"]: x["content"] for x in whole.get("added_tokens") or []}
    table = [b""] * (max([*vocab.values(), *added], default=-1) + 1)
    for spelled, i in vocab.items():
        table[i] = bytes(back[c] for c in spelled) if all(c in back for c in spelled) else spelled.encode()
    for i, content in added.items():
        table[i] = content.encode()
    return table


def char_starts(ids: np.ndarray, lengths: np.ndarray, raw: bytes) -> tuple[np.ndarray, int]:
    """For each token the character in which its first byte lies, and how many tokens begin inside a character.

    lengths: bytes of each token of the vocabulary; raw: the text's UTF-8.
    """
    at = np.zeros(len(ids), np.int64)
    np.cumsum(lengths[ids[:-1]], out=at[1:])
    if raw.isascii():
        return at.astype(np.int32), 0
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    place = np.cumsum(lead) - 1
    return place[at].astype(np.int32), int((~lead[at]).sum())


def token_texts(ids: Iterable[int], table: list[bytes]) -> list[str]:
    """What each token adds to the decoded text; a character split over tokens appears with its last one."""
    import codecs

    step = codecs.getincrementaldecoder("utf-8")(errors="replace")
    out = [step.decode(table[i]) for i in ids]
    if tail := step.decode(b"", True):
        out.append(tail)
    return out


_open: dict[int, object] = {}


def _worker(key: int, make: Callable[[], object]) -> object:
    """A worker's own copy of a model, made once and kept for its later tasks; the last two stay."""
    if key not in _open:
        while len(_open) > 1:
            del _open[next(iter(_open))]
        _open[key] = make()
    return _open[key]


def _keys(df: DataFrame, keys: list[str], results: set[str]) -> list[T.StructField]:
    if clash := results & set(keys):
        raise ValueError(f"key columns clash with results: {sorted(clash)}")
    return [df.schema[k] for k in keys]


def encode(df: DataFrame, model: str, keys: list[str], text: str = "text") -> DataFrame:
    """Token ids of each text: the key columns, ids, char_starts (the character of each token's first byte) and n_inside
    (tokens that begin inside a character).

    model: a byte-level model in tokenizers' JSON form, of bounded size (a vocabulary), which is broadcast.
    """
    fields = _keys(df, keys, {"ids", "char_starts", "n_inside"})
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("char_starts", T.ArrayType(T.IntegerType(), False)), T.StructField("n_inside", T.IntegerType())])
    sent = df.sparkSession.sparkContext.broadcast(model)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _worker(hash(sent.value), lambda: (PieceEncoder(sent.value), np.array([len(x) for x in token_table(sent.value)], np.int64)))
        for b in common.sliced(batches, "__text", 1 << 20):
            source = common.texts(b.column(n))
            ids = [np.frombuffer(x, "<u4") for x in encoder(source)]
            starts = [char_starts(i, lengths, t.encode()) if len(i) else (i.astype(np.int32), 0) for i, t in zip(ids, source, strict=True)]
            at = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            whole = lambda x: pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], whole(ids), whole([s for s, _ in starts]), pa.array([k for _, k in starts], pa.int32())], names=schema.names)

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, model: str, keys: list[str], ids: str = "ids") -> DataFrame:
    """The key columns and decoded: the bytes that the ids spell. Null ids give null."""
    fields = _keys(df, keys, {"decoded"})
    schema = T.StructType([*fields, T.StructField("decoded", T.BinaryType())])
    sent = df.sparkSession.sparkContext.broadcast(model)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _worker(-hash(sent.value), lambda: token_table(sent.value))
        for b in batches:
            back = [None if x is None else b"".join(map(table.__getitem__, x)) for x in (v.values.to_pylist() if v.is_valid else None for v in b.column(n))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(back, pa.binary())], names=schema.names)

    return df.select(*keys, F.col(ids).alias("__ids")).mapInArrow(run, schema)


def round_trip(df: DataFrame, model: str, keys: list[str], text: str = "text") -> DataFrame:
    """Encode each text and decode its ids again in one pass, in which only digests leave the task: the key columns,
    n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids spell), n_inside
    (tokens that begin inside a character) and last_start (the character of the last token's first byte; null without)."""
    results = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "n_inside": pa.int32(), "last_start": pa.int32()}
    fields = _keys(df, keys, set(results))
    schema = T.StructType([*fields, *(T.StructField(k, T.LongType() if t == pa.int64() else T.IntegerType() if t == pa.int32() else T.StringType()) for k, t in results.items())])
    sent = df.sparkSession.sparkContext.broadcast(model)
    n = len(keys)

    def tools():
        table = token_table(sent.value)
        return PieceEncoder(sent.value, kept=KEPT_ALONE), table, np.array([len(x) for x in table], np.int64), [str(i) for i in range(len(table))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, lengths, decimal = _worker(hash((sent.value, KEPT_ALONE)), tools)
        for b in common.sliced(batches, "__text", 1 << 20):
            source, out = common.texts(b.column(n)), [[] for _ in results]
            for t, raw in zip(source, encoder(source), strict=True):
                ids = np.frombuffer(raw, "<u4")
                each = ids.tolist()
                starts, inside = char_starts(ids, lengths, t.encode()) if each else ((None,), 0)
                back = b"".join(map(table.__getitem__, each))
                for column, v in zip(out, (len(each), hashlib.sha256(",".join(map(decimal.__getitem__, each)).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), inside, starts[-1]), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(c, k) for c, k in zip(out, results.values(), strict=True))], names=schema.names)

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def ids_text(ids: str = "ids"):
    """Decimal ids joined by commas, as a column."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")
