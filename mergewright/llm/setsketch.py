"""Near-duplicate documents by SetSketch registers.

A document's set holds the hashes of its distinct five-word shingles (64 bits each; words with A-Z in lower case). A
register keeps the least of exponentially distributed hash values on a scale of powers of BASE, truncated at both ends:
K = floor(1 - log_b(least)), so sketches of two sets merge by the larger K, and two registers agree about as often as the
sets' Jaccard similarity J says. The way from documents to components:

1. Equal sets are one representative (the smallest doc_id), found by a grouped minimum, however many copies there are.
2. BANDS bands of ROWS registers give keys; representatives that share a key come together. At J = 0.75 all bands miss
   with probability (1 - 0.75**4)**32 = 5e-6. A key with many documents is dealt out in pairs of blocks, all of them.
3. Of two documents the sketches' counts (larger, smaller, equal) and the known set sizes give J by maximum likelihood.
   Pairs within five standard errors below 0.75 hold their documents together as a family; only a spanning forest of
   each block leaves a task, never its pairs.
4. A family's full sets meet once, in blocks again, and every pair's intersection is counted exactly; again a spanning
   forest of the links that hold leaves the task. Components of those links are the result.

Components are found in Spark by labels that neighbours and labels of labels lower, written to a shared folder in each
round. No links, labels or sketches reach the driver.

Cases: a null or empty text, or one of separators only, has an empty set, is linked with nothing and kept; fewer than
five words make one shingle of them all; repeated rows and rows that share a doc_id take part like any others, and are
are one document, whose texts are linked; a row without a doc_id is known by its text and counts as larger than all
others: where a whole component has no id, component_id is null, and kept is true for the rows of one of its texts; an
empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 5
LINK_PERCENT = 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Five standard errors of an estimate at J = 0.75 below it.
LEAST_ESTIMATE = LINK_PERCENT / 100 - 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Documents of a key, and documents or shingles of a family, that meet in one block; more are dealt out in pairs of blocks.
KEY_BLOCK, FAMILY_BLOCK, SHINGLE_BLOCK = 400, 1200, 1_000_000
#: Pairs of documents that a task holds at once, about.
HELD_PAIRS = 250_000
#: Up to so many candidate ids (8 bytes each) are broadcast; beyond, they meet the texts by a shuffle.
BROADCAST_IDS = 1_000_000
KEPT_WORDS = 100_000
#: Rows without a doc_id get one from their text, at or above this bound, or above all real ids where one reaches it.
OWN_IDS = 1 << 62
#: The range of ids is looked at in parts of so many bits, at most 2**18 of them, where they reach its end.
PART_BITS = 46

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_817)
_A = _rng.integers(0, 1 << 64, REGISTERS, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, REGISTERS, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The sorted distinct shingle hashes of a text; hashes of the words met last are kept."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _new(self, word: bytes) -> int:
        h = self.known[word] = xxhash.xxh3_64_intdigest(word) or 1
        return h

    def __call__(self, text: str) -> np.ndarray:
        ws = common.lower_words(text)
        if not ws:
            return np.zeros(0, np.uint64)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, new = self.known.get, self._new
        h = np.array([known(w) or new(w) for w in ws], np.uint64)
        size = min(WORDS, len(h))
        n = len(h) - size + 1
        acc = np.full(n, size, np.uint64)
        for i in range(size):
            acc = acc * _MIX + h[i : i + n]
            acc ^= acc >> np.uint64(29)
        return np.unique(_mixed(acc))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set; merge two sketches with np.maximum."""
    least = np.full(REGISTERS, ~np.uint64(0))
    for i in range(0, len(hashes), 512):
        np.minimum(least, (np.multiply.outer(hashes[i : i + 512], _A) + _B).min(0), out=least)
    value = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    bands = registers.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key * _MIX + bands[:, i] + np.uint64(1))
    return key.view(np.int64)


def estimate(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """J of greatest likelihood, from how many registers of a are larger, smaller or equal, and both set sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    step, log_b = (BASE - 1) / BASE, np.log(BASE)
    p = lambda x: -np.log1p(-x * step) / log_b
    dp = lambda x: step / ((1 - x * step) * log_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(26):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        slope = -larger * v * dp(x) / p(x) - smaller * u * dp(y) / p(y) + equal * (v * dp(x) + u * dp(y)) / np.maximum(1 - p(x) - p(y), 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes with links a-b the least node that each reaches."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _pairs(sizes: np.ndarray, starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group, in parts of about `most`; groups are runs of rows."""
    for s in np.unique(sizes[sizes > 1]):
        a, b = np.triu_indices(s, 1)
        own = starts[sizes == s]
        per = max(1, most // len(a))
        for i in range(0, len(own), per):
            for k in range(0, len(a), most):
                yield (own[i : i + per, None] + a[k : k + most]).ravel(), (own[i : i + per, None] + b[k : k + most]).ravel()


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], weight: Callable[[pa.Table], int], most: int, handle: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Hand over whole groups (runs of equal keys in sorted batches), many at a time."""
    held: list[pa.RecordBatch] = []
    common.give_back()

    def cut(table: pa.Table, all_of_it: bool):
        code = np.stack([table.column(k).to_numpy() for k in keys])
        starts = np.flatnonzero(np.r_[True, (code[:, 1:] != code[:, :-1]).any(0)])
        end = len(table) if all_of_it else int(starts[-1])
        starts = starts[starts < end]
        if len(starts) and (out := handle(table.slice(0, end), starts, np.diff(np.r_[starts, end]))) is not None:
            yield out
        rest.extend(table.slice(end).to_batches())

    for b in batches:
        if b.num_rows:
            held.append(b)
        if held and sum(map(weight, held)) >= most:
            rest: list[pa.RecordBatch] = []
            yield from cut(pa.Table.from_batches(held), False)
            held = rest
    if held:
        rest = []
        yield from cut(pa.Table.from_batches(held), True)


def with_links(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each reaches by links a-b too; label: what it reached by those that were added before."""
    held = np.flatnonzero(label != np.arange(len(label)))
    return least_labels(len(label), np.concatenate([held, a]), np.concatenate([label[held], b])) if len(a) else label


def _edges(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch | None:
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], names=["a", "b"]) if len(at) else None


def _alike(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch | None:
    """Links of documents whose estimated similarity may reach the bar, within each group of rows."""
    ids, n, block = (table.column(c).to_numpy() for c in ("id", "n", "block"))
    cross = table.column("i").to_numpy() != table.column("j").to_numpy()
    k = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    label, found, have = np.arange(len(ids)), [], 0
    for a, b in _pairs(sizes, starts, 16_384):
        ok = (100 * np.minimum(n[a], n[b]) >= LINK_PERCENT * np.maximum(n[a], n[b])) & (~cross[a] | (block[a] != block[b])) & (ids[a] != ids[b])
        a, b = a[ok], b[ok]
        equal = (k[a] == k[b]).sum(1)
        ok = equal >= 0.8 * LEAST_ESTIMATE * REGISTERS
        a, b, equal = a[ok], b[ok], equal[ok]
        if len(a):
            larger = (k[a] > k[b]).sum(1)
            ok = estimate(larger, REGISTERS - equal - larger, equal, n[a], n[b]) >= LEAST_ESTIMATE
            found.append((a[ok], b[ok]))
            have += int(ok.sum())
        if have > HELD_PAIRS:
            label, found, have = with_links(label, *map(np.concatenate, zip(*found, strict=True))), [], 0
    if found:
        label = with_links(label, *map(np.concatenate, zip(*found, strict=True)))
    return _edges(ids, label)


def _linked(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch | None:
    """Links that hold on the full sets, within each group of rows."""
    ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
    cross = table.column("i").to_numpy() != table.column("j").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    label = np.arange(len(ids))
    for s, g in zip(starts.tolist(), sizes.tolist(), strict=True):
        if g >= 2:
            label[s : s + g] = s + _linked_sets(sets[s : s + g], block[s : s + g] if cross[s] else None)
    return _edges(ids, label)


def _linked_sets(sets: list[np.ndarray], block: np.ndarray | None) -> np.ndarray:
    """The least of the sets that each reaches by links (with block: only those between blocks); some rows of all pairs at a time."""
    g, shared, n = len(sets), intersections(sets), np.array([len(x) for x in sets])
    label, step = np.arange(g), max(1, HELD_PAIRS // g)
    for i in range(0, g, step):
        common_count = shared[i : i + step, i:].astype(np.int64)
        link = 100 * common_count >= LINK_PERCENT * (n[i : i + step, None] + n[None, i:] - common_count)
        if block is not None:
            link &= block[i : i + step, None] != block[None, i:]
        a, b = np.nonzero(np.triu(link, 1))
        label = with_links(label, a + i, b + i)
    return label


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of distinct hashes; sums of products of 0/1 columns, some thousand columns and some
    hundred rows at a time."""
    g = len(sets)
    if g == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]])
    owner = np.repeat(np.arange(g, dtype=np.int32), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    del keep, order, count
    total, width, step = np.zeros((g, g), np.int32), max(256, 2_000_000 // g), max(1, HELD_PAIRS // g)
    for first in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        part = np.zeros((g, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        for i in range(0, g, step):
            total[i : i + step, i:] += (part[i : i + step] @ part[i:].T).astype(np.int32)
    for i in range(0, g, step):
        total[i:, i : i + step] = total[i : i + step, i:].T
    return total


@dataclass(frozen=True)
class Ids:
    """How rows are numbered: a doc_id from `cut` on is moved down by `shift`, and rows without one have a number of their text
    from `bound` on."""

    bound: int
    cut: int = 0
    shift: int = 0


def own_ids(docs: DataFrame) -> Ids | None:
    """Numbers above all doc_ids for rows without one; None where each row has one.

    Where the largest doc_id leaves too few, those above an unused stretch of the range are moved down by its length, which
    keeps their order.
    """
    real = F.col("doc_id").cast("long")
    r = docs.agg(F.max(real).alias("most"), F.count_if(F.col("doc_id").isNull()).alias("without")).first()
    if not r["without"]:
        return None
    bound = max(OWN_IDS, (r["most"] or 0) + 1)
    if (1 << 63) - bound >= 1 << 40:
        return Ids(bound)
    used = {x["part"] for x in docs.where("doc_id IS NOT NULL").select(F.shiftright(real, PART_BITS).alias("part")).distinct().collect()}
    free = next((i for i in range((1 << 63 - PART_BITS) - 1, -(1 << 63 - PART_BITS) - 1, -1) if i not in used), None)
    if free is None:
        raise ValueError("doc_ids use the whole range of numbers and leave none for rows without one")
    return Ids((1 << 63) - (1 << PART_BITS), (free + 1) << PART_BITS, 1 << PART_BITS)


def row_id(ids: Ids | None) -> Column:
    """The number of a row: its doc_id (moved, where numbers had to be made free), or one made of its text."""
    real = F.col("doc_id").cast("long")
    if ids is None:
        return real
    moved = F.when(real >= ids.cut, real - ids.shift).otherwise(real) if ids.shift else real
    return F.coalesce(moved, F.pmod(F.xxhash64(common.text_of()), F.lit((1 << 63) - ids.bound)) + F.lit(ids.bound))


def doc_id_of(number: str, ids: Ids | None) -> Column:
    """The doc_id of a row's number; null for rows without one."""
    c = F.col(number)
    if ids is None:
        return c
    back = F.when(c >= ids.cut - ids.shift, c + ids.shift).otherwise(c) if ids.shift else c
    return F.when(c < ids.bound, back)


def sketches(docs: DataFrame, bound: Ids | None) -> DataFrame:
    """id, n (set size), set_key (128 bits of the whole set, null where empty), bands and registers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in common.sliced(batches):
            n, keys, bands, registers = [], [], [], []
            for text in common.texts(b.column(1)):
                h = shingler(text)
                n.append(len(h))
                if len(h):
                    r = sketch(h)
                    keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                    bands.append(band_keys(r).tolist())
                    registers.append(r.tobytes())
                else:
                    keys.append(None)
                    bands.append(None)
                    registers.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(registers, pa.binary())], names=["id", "n", "set_key", "bands", "registers"])

    own = docs.select(row_id(bound).alias("id"), "text")
    return own.mapInArrow(run, "id long, n long, set_key binary, bands array<long>, registers binary")


def components(edges: DataFrame, name: str) -> DataFrame:
    """id and label (the least id reachable) of every node of the edges a-b.

    Each round a node takes the least label among its neighbours, then its label's label; the rounds grow with the
    logarithm of a component's width. Every round is written to the shared folder.
    """
    e = common.stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = common.stored(e.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), f"{name}-labels")
    while True:
        near = e.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("jumped"))
        new = common.stored(lower.join(jump, "low").select("id", "old", F.least("low", "jumped").alias("label")), f"{name}-labels")
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return labels


def _dealt(rows: DataFrame, group: list[str], blocks) -> DataFrame:
    """Each row once for every pair of blocks that its own block is part of: columns block, i and j are added."""
    own = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text)."""
    bound = own_ids(docs)
    return decisions(docs, bound).select(doc_id_of("id", bound).alias("doc_id"), F.col("n").alias("n_shingles"), doc_id_of("component", bound).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each component."""
    bound = own_ids(docs)
    found = common.stored(decisions(docs, bound).select("id", "component"), "decisions")
    kept = found.where("id = component").select(F.col("id").alias("__kept")).distinct()
    stays = docs.join(F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept, row_id(bound) == F.col("__kept"), "left_semi")
    again = common.stored(found.groupBy(F.col("id").alias("__again")).count().where("count > 1").select("__again"), "repeated-ids")
    if again.isEmpty():
        return stays
    # Rows that share an id: the one with the least text stays.
    more = stays.withColumn("__row", row_id(bound)).join(again, F.col("__row") == F.col("__again"), "left_semi")
    first = more.withColumn("__rank", F.row_number().over(Window.partitionBy("__row").orderBy("text", *(c for c in docs.columns if c != "text"))))
    return stays.join(again, row_id(bound) == F.col("__again"), "left_anti").unionByName(first.where("__rank = 1").select(*docs.columns))


def decisions(docs: DataFrame, bound: Ids | None) -> DataFrame:
    """id (row_id), n (set size) and component (the least id reachable) of every row."""
    sk = common.stored(sketches(docs, bound), "sketches")
    real = sk.where("set_key IS NOT NULL")
    first = real.groupBy("set_key").agg(F.min(F.struct("id", "n", "bands", "registers")).alias("r")).select("set_key", "r.*")
    reps = common.stored(first, "representatives")

    keyed = reps.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("g")).where("g > 1")
    met = keyed.join(shared, "key").join(reps.select("id", "n", "registers"), "id")
    met = _dealt(met, ["key"], F.ceil(F.col("g") / KEY_BLOCK)).select("key", "i", "j", "block", "id", "n", "registers")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    alike = met.mapInArrow(lambda it: _grouped(it, ["key", "i", "j"], lambda b: b.num_rows, 20_000, _alike), "a long, b long")
    families = components(alike, "families")

    sized = families.join(reps.select("id", "n"), "id").select(F.col("label").alias("family"), "id", "n")
    heavy = sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum("n") / SHINGLE_BLOCK)).alias("parts"))
    members = common.stored(sized.join(heavy, "family").select("id", "family", "parts"), "families")
    candidates = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
    own = docs.select(row_id(bound).alias("id"), "text").join(candidates, "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in common.sliced(batches):
            sets = [shingler(t) for t in common.texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("family"), b.column("parts"), b.column("id"), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["family", "parts", "id", "set_key", "hashes"])

    sets = own.select("family", "parts", "id", "text").mapInArrow(hashed, "family long, parts long, id long, set_key binary, hashes binary")
    dealt = _dealt(sets, ["family"], F.col("parts")).select("family", "i", "j", "block", "id", "hashes")
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "id")
    links = dealt.mapInArrow(lambda it: _grouped(it, ["family", "i", "j"], lambda b: b.nbytes, 8 << 20, _linked), "a long, b long")
    found = components(links, "components")

    named = reps.select("set_key", "id").join(found, "id", "left").select("set_key", F.coalesce("label", "id").alias("component"))
    joined = sk.select("id", "n", "set_key").join(named, "set_key", "left")
    return joined.select("id", "n", F.coalesce("component", "id").alias("component"))
