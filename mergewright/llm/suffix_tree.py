"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words of a text (A-Z in lower case) and the text's start and end. The tree's states are contexts of up to
DEPTH symbols. Candidates are all contexts that come LEAST_COUNT times in the training texts, whatever the corpus holds. A
candidate becomes a state when its next-symbol distribution diverges from that of its longest suffix that is a state: the
training tokens that it predicts must gain more than DIVERGENCE nats, and two more for each of its symbols. A distribution
holds the next symbols that come LEAST_COUNT times in that context, with an absolute discount, and leaves what the
discounts and all other symbols make up to the suffix's distribution. At the root stand the words' shares with a
Good-Turing discount; the discounts are the unknown word's share. A token is scored from the longest suffix of what came
before it that is a state.

Words and runs are known by 64-bit keys (over a billion distinct ones, one pair meets by chance with probability 0.03).
Counts, states and distributions are Spark tables. The texts are read once for words, PASSES times each
for pairs and for runs of three, and once for longer runs:

1. Words are counted.
2. Pairs are counted where both their words are frequent, which loses none that is.
3. Runs of three are counted where both their pairs are frequent, likewise.
4. Longer runs are counted where their context may still become a state. A context of suffix c gains at most
   H(c) = sum of n(s) * -ln p(s) over c's symbols, p being what the tree gives them by then, for its own counts aren't
   larger and no probability exceeds 1; nor do yet longer ones, so where H(c) is below the bar all of them are left out.

A run that is frequent in a context is frequent in each of its suffixes. So a token's score is the root's, plus `rest` of
each state before it, plus `gain` of each frequent run that it ends: by how much a state's probability of it exceeds the
suffix's, without rest. These are sums over the runs of a text. The HOT most frequent runs and the HEAD most frequent
words travel with the tasks; places of all others meet their values in a shuffle, as arrays in buckets of keys, for one of
PASSES shares of the documents after the other, so that the disk holds one share at a time. What travels besides are two bit
tables of 2 ** BITS bits, which only spare places that would find no match: one of the states, for a place ends a run with a
gain only where the context before it is a state, and one of the values that don't travel.

Cases: a null or empty text is just an end; a null doc_id counts as an empty text in the fold and is scored like any
other; repeated rows are counted and scored each time; an empty table gives no rows; without training texts N is 0, each
token is unknown with probability 1 and the base is what its formula gives; texts and words of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 4
LEAST_COUNT = 4
DIVERGENCE = 10.0
DISCOUNT = 0.75
#: Words whose counts travel with the model, at most (16 bytes each).
HEAD = 200_000
#: Runs whose values travel with the model, at most (16 bytes each).
HOT = 2_000_000
#: A bit table has 2 ** BITS bits.
BITS = 27
#: Places of which a task counts the runs at once, runs that go through a shuffle as one value at most, and the bytes of text
#: for which a bucket is made.
KEYS, PACKED, BUCKET_BYTES = 1_500_000, 1024, 8 << 20
#: Passes over the texts in which runs of two and of three are counted, each with its share of the buckets, and in which texts
#: are scored, each with its share of them.
PASSES = 2
#: Runs beyond the hot ones in a bucket (25 bytes each), about; places of runs that look for them that a task holds.
APART, LATE = 300_000, 400_000
#: A row's number is that of the task which reads it, and its place there in so many bits.
ROW_BITS = 40
#: Words of more bytes are hashed one by one.
LONG = 256

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of runs, from those of their first k and their last k symbols."""
    return mixed(first * _STEP + last)


def _digest(word: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(word, digest_size=8).digest(), "little"))


#: Words have no spaces, so these are no word's.
END_KEY, START_KEY = _digest(b" end"), _digest(b" start")


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keys of the words data[start:end], eight of their bytes at a time."""
    size, padded = end - start, np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    key = mixed(size.astype(np.uint64) * _STEP + (eight[start] & _FIRST_BYTES[np.minimum(size, 8)]))
    at = np.flatnonzero(size > 8)
    for done in range(8, LONG, 8):
        if not len(at):
            break
        left = size[at] - done
        key[at] = joined(key[at], eight[start[at] + done] & _FIRST_BYTES[np.minimum(left, 8)])
        at = at[left > 8]
    for i in at.tolist():
        key[i] = _digest(data[start[i] : end[i]].tobytes())
    return key


def key_of(word: bytes) -> np.uint64:
    data = _LOWER[np.frombuffer(word, np.uint8)]
    return word_keys(data, np.array([0]), np.array([len(data)]))[0]


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """START, the words and END of all texts one after the other by their keys, and the place of each in its text."""
    data, offsets = common.utf8(column)
    data = _LOWER[data]
    word = ~_SEPARATOR[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge], last[edge - 1] = word[edge], word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = np.diff(np.searchsorted(start, offsets)) + 2
    begin = np.cumsum(sizes) - sizes
    x = np.empty(int(sizes.sum()), np.uint64)
    x[begin], x[begin + sizes - 1] = START_KEY, END_KEY
    x[np.arange(len(start)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes - 2)] = word_keys(data, start, end)
    return x, np.arange(len(x)) - np.repeat(begin, sizes)


def longer(x: np.ndarray) -> np.ndarray:
    """Keys of runs of one symbol more that end at each place, from x; the first has none."""
    return np.append(np.zeros(min(1, len(x)), np.uint64), joined(x[:-1], x[1:]))


def bit_table(grams: DataFrame, twice: bool = False) -> np.ndarray:
    """Bits that are set for each gram, by its first bits and (twice) by its last ones; its size is the same for any number
    of grams."""
    places = [F.shiftrightunsigned("gram", 64 - BITS), *([F.col("gram").bitwiseAND((1 << BITS) - 1)] if twice else [])]
    each = grams.select(F.explode(F.array(*places)).alias("place"))
    rows = each.groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _is_set(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def maybe(bits: np.ndarray, keys: np.ndarray, twice: bool = False) -> np.ndarray:
    """False for keys that the bit table surely doesn't hold."""
    out = _is_set(bits, keys >> np.uint64(64 - BITS))
    if twice:
        at = np.flatnonzero(out)
        out[at] = _is_set(bits, keys[at] & np.uint64((1 << BITS) - 1))
    return out


class Lookup:
    """Places of keys in a sorted array; a cell for each value of their first bits says where to look."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(1, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.append(np.searchsorted(keys, edges), len(keys)).astype(np.int32)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        cell = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        out, left = np.full(len(wanted), -1, np.int32), np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == wanted[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal shares of the keys' range, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Rows of each bucket, some thousand at most at once; buckets are in order."""
    edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    for a, b in zip(edges, edges[1:], strict=False):
        for i in range(a, b, PACKED):
            yield int(bucket[a]), slice(i, min(b, i + PACKED))


def _packs(out: list[tuple]) -> pa.RecordBatch:
    """Rows of level, bucket and arrays that go as one value."""
    level, bucket, packs = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(level, pa.int8()), pa.array(bucket, pa.int32()), pa.array([b"".join(x.tobytes() for x in p) for p in packs], pa.binary())], names=["level", "bucket", "pack"])


def _unpacked(packs: list[bytes], *kinds: type, planes: bool = False) -> list[np.ndarray]:
    """The arrays of all packs, one after the other; planes: they were packed by _planes()."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out = [[] for _ in kinds]
    for p in packs:
        n, at = len(p) // width, 0
        for column, k in zip(out, kinds, strict=True):
            v = np.frombuffer(p, k, n, at)
            column.append(_from_planes(v) if planes else v)
            at += n * np.dtype(k).itemsize
    return [np.concatenate(c) for c in out]


def _planes(v: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then the second ones and so on: of values that are close most compress to nothing."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T)


def _from_planes(v: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(v.view(np.uint8).reshape(v.itemsize, len(v)).T).reshape(-1).view(v.dtype)


def _summed(prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Distinct runs in order of their keys: key, prefix, suffix and the sum of n (the number of rows, without n)."""
    key = joined(prefix, suffix) if prefix.any() else suffix
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    at = order[first]
    total = np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    return key[first], prefix[at], suffix[at], total


def count_runs(texts: DataFrame, runs: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]], least: list[int], buckets: int, summed: frozenset[int] = frozenset(), share: tuple[int, int] = (0, 1)) -> DataFrame:
    """level, gram (key), prefix (a run's first symbols), suffix (its last ones) and n of the runs that are asked for.

    runs: from symbols and places a list of prefixes (zeros for single symbols) and suffixes, for each level; least: what
    n has to be, for each level; summed: levels of which the runs that come less often are added up by their prefix, in rows
    of level -1 - level without gram and suffix. Counts go through the shuffle as arrays, many to a row, in buckets of keys; a task sums
    up one bucket after another. Keys are evenly spread, so a bucket's size depends on `buckets` alone. share: (i, n) counts
    every n-th bucket from the i-th on alone.
    """
    turn, turns = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            # Level by level, so that what one has held is free before the next is sorted.
            for level in list(held):
                prefix, suffix = map(np.concatenate, zip(*held.pop(level), strict=True))
                key, prefix, suffix, n = _summed(prefix, suffix, None)
                bucket = bucket_of(key, buckets)
                # Within a bucket equal suffixes lie side by side, which compresses well.
                by = np.argsort(bucket.astype(np.uint64) << np.uint64(44) | suffix >> np.uint64(20))
                prefix, suffix, n, bucket = prefix[by], suffix[by], n[by].astype(np.int32), bucket[by]
                del key, by
                packs = [(level, b, (prefix[s], suffix[s], n[s])) for b, s in _parts(bucket)]
                for i in range(0, len(packs), 256):
                    yield _packs(packs[i : i + 256])

        for b in common.sliced(batches):
            x, place = symbols(b.column(0))
            for level, (prefix, suffix) in enumerate(runs(x, place)):
                if turns > 1:
                    mine = bucket_of(joined(prefix, suffix) if prefix.any() else suffix, buckets) % turns == turn
                    prefix, suffix = prefix[mine], suffix[mine]
                held.setdefault(level, []).append((prefix, suffix))
            have += len(x) / turns
            if have > KEYS:
                yield from out()
                have = 0
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        for (level, _), packs in _groups(batches):
            prefix, suffix, n = _unpacked(packs, np.uint64, np.uint64, np.int32)
            key, prefix, suffix, n = _summed(prefix, suffix, n.astype(np.int64))
            often = n >= least[level]
            if level in summed:
                left, none = prefix[~often], np.zeros(int((~often).sum()), np.uint64)
                left, _, _, total = _summed(none, left, n[~often])
                yield from rows(-1 - level, none[: len(left)], left, none[: len(left)], total)
            yield from rows(level, key[often], prefix[often], suffix[often], n[often])

    def rows(level: int, key: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(n), 1 << 17):
            s = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n[s]), level, np.int8)), *(pa.array(v[s].view(np.int64)) for v in (key, prefix, suffix)), pa.array(n[s].astype(np.int64))], names=["level", "gram", "prefix", "suffix", "n"])

    packs = texts.select("text").mapInArrow(run, "level byte, bucket int, pack binary").repartition("level", "bucket").sortWithinPartitions("level", "bucket")
    return packs.mapInArrow(merge, "level byte, gram long, prefix long, suffix long, n long")


def counted(texts: DataFrame, runs: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]], least: int, buckets: int) -> DataFrame:
    """What count_runs() gives for one level, stored. Each of the passes sends its share of the buckets through a shuffle, whose
    files are let go before the next one; so the disk holds one share at a time."""
    turns, out = min(PASSES, buckets), []
    for turn in range(turns):
        out.append(common.stored(count_runs(texts, runs, [least], buckets, share=(turn, turns)).drop("level"), "counted"))
        common.let_go(texts.sparkSession)
    return reduce(DataFrame.unionByName, out)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
    """The packs of each bucket, of rows in order."""
    key, packs = None, []
    for b in batches:
        for level, bucket, pack in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
            if (level, bucket) != key and packs:
                yield key, packs
                packs = []
            key = level, bucket
            packs.append(pack)
    if packs:
        yield key, packs


def tested(rows: DataFrame, before: DataFrame, counts: DataFrame, divergence: float = DIVERGENCE) -> tuple[DataFrame, DataFrame]:
    """The divergence test of a level's contexts, which are the prefixes of rows (gram, prefix, suffix, n).

    before: gram and p (what the tree of shorter contexts gives its last symbol) of the level before. counts: prefix and
    count. Returns gram, prefix, n, p of this level, with gain where the context is a state (else null), and the states:
    prefix, count and rest.
    """
    sums = rows.groupBy("prefix").agg(F.sum("n").alias("s"), F.count("*").alias("m"))
    contexts = sums.join(counts, "prefix").withColumn("rest", 1 - (F.col("s") - DISCOUNT * F.col("m")) / F.col("count"))
    each = rows.join(before.select(F.col("gram").alias("suffix"), F.col("p").alias("shorter")), "suffix").join(contexts, "prefix")
    each = common.stored(each.withColumn("own", (F.col("n") - DISCOUNT) / F.col("count") + F.col("rest") * F.col("shorter")), "level")
    gained = F.sum(F.col("n") * F.log(F.col("own") / F.col("shorter"))) + F.first((F.col("count") - F.col("s")) * F.log("rest"))
    states = each.groupBy("prefix").agg(gained.alias("gained"), *(F.first(c).alias(c) for c in ("m", "count", "rest"))).where(F.col("gained") > divergence + 2 * F.col("m"))
    states = common.stored(states.select("prefix", "count", "rest"), "states")
    out = each.join(states.select("prefix", F.lit(True).alias("state")), "prefix", "left")
    gain = F.when(F.col("state"), F.log10(F.col("own") / F.col("shorter")) - F.log10("rest"))
    out = out.select("gram", "prefix", "n", F.when(F.col("state"), F.col("own")).otherwise(F.col("shorter")).alias("p"), gain.alias("gain"))
    found = common.stored(out, "runs")
    common.discard(each)
    return found, states


def still_open(level: DataFrame, divergence: float = DIVERGENCE) -> DataFrame:
    """gram: the contexts of a tested level that longer ones may still gain on."""
    return level.groupBy(F.col("prefix").alias("gram")).agg(F.sum(-F.col("n") * F.log("p")).alias("h")).where(F.col("h") > divergence + 2).select("gram")


def _sorted(rows: pa.Table, *columns: str) -> tuple[np.ndarray, ...]:
    """gram (unsigned, sorted, each once) and the columns' sums in that order."""
    grams, place = np.unique(rows.column("gram").to_numpy().view(np.uint64), return_inverse=True)
    return grams, *(np.bincount(place, rows.column(c).to_numpy(), len(grams)) for c in columns)


@dataclass
class Tree:
    """All of a model's states and runs in memory, to look at small models: keys of contexts, log10 of what is left to
    their suffixes, keys of runs and log10 of their gains."""

    keys: np.ndarray
    rest: np.ndarray
    runs: np.ndarray
    gains: np.ndarray
    depth: int

    def scores(self, x: np.ndarray, root: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol (by key) after the first; root: what the root gives them."""
        total, run = np.array(root, np.float64), np.asarray(x, np.uint64)
        states, runs = Lookup(self.keys), Lookup(self.runs)
        for k in range(1, min(self.depth, len(x) - 1) + 1):
            at = states(run[k - 1 : -1])
            total[k - 1 :][at >= 0] += self.rest[at[at >= 0]]
            run = longer(run)
            at = runs(run[k:])
            total[k - 1 :][at >= 0] += self.gains[at[at >= 0]]
        return total


@dataclass
class Model:
    """words: gram and c of every word and the end, in Spark. levels: what tested() returns, runs and states. discount:
    what the root takes from each count."""

    words: DataFrame
    levels: list[tuple[DataFrame, DataFrame]]
    documents: int
    tokens: int
    distinct: int
    discount: float
    depth: int

    def root_log(self, c: np.ndarray | int) -> np.ndarray | float:
        return np.log10((np.asarray(c, np.float64) - self.discount) / max(1, self.tokens))

    @property
    def unknown(self) -> float:
        """log10 of the unknown word's share."""
        return float(np.log10(self.discount * self.distinct / self.tokens)) if self.tokens else 0.0

    def states(self) -> DataFrame:
        """gram, uses and value (log10 of rest) of the states."""
        return self._each(s.select(F.col("prefix").alias("gram"), F.col("count").alias("uses"), F.log10("rest").alias("value")) for _, s in self.levels)

    def runs(self) -> DataFrame:
        """gram, uses and value (log10 of gain) of the runs in states."""
        return self._each(r.where("gain IS NOT NULL").select("gram", F.col("n").alias("uses"), F.col("gain").alias("value")) for r, _ in self.levels)

    def _each(self, tables: Iterable[DataFrame]) -> DataFrame:
        out = self.words.sparkSession.createDataFrame([], "gram long, uses long, value double")
        for t in tables:
            out = out.unionByName(t)
        return out

    def values(self) -> DataFrame:
        """gram, uses and value: what each run adds to a text, as a state before a token or as the end of a run; a run that
        is both has two rows."""
        return self.states().unionByName(self.runs())

    @property
    def tree(self) -> Tree:
        return Tree(*_sorted(self.states().toArrow(), "value"), *_sorted(self.runs().toArrow(), "value"), self.depth)


def _class(count: str) -> Column:
    return F.floor(F.log2(count) * 4)


def _bar(df: DataFrame, count: str, most: int) -> int:
    """The least class of counts that at most `most` rows reach: their number is known before any of them is fetched."""
    rows, bar = 0, 1000
    for r in df.groupBy(_class(count).alias("class")).count().orderBy(F.desc("class")).collect():
        rows += r["count"]
        if rows > most:
            break
        bar = r["class"]
    return bar


def learn(texts: DataFrame, depth: int = DEPTH, least: int = LEAST_COUNT) -> Model:
    """Learn from the column text of all rows."""
    spark = texts.sparkSession
    end, start = (int(k.view(np.int64)) for k in (END_KEY, START_KEY))
    buckets = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES

    ones = lambda x, place: [(np.zeros(len(x), np.uint64), x)]
    symbol = common.stored(count_runs(texts, ones, [1], buckets).select("gram", F.col("n").alias("c")), "symbols")
    words = symbol.where(F.col("gram") != start)
    of = lambda n: F.sum(F.when((F.col("c") == n) & (F.col("gram") != end), 1).otherwise(0))
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v"), of(1).alias("once"), of(2).alias("twice"), F.sum(F.when(F.col("gram") == end, F.col("c"))).alias("documents")).first()
    tokens, distinct, documents = total.n or 0, total.v, total.documents or 0
    discount = (total.once or 0) / ((total.once or 0) + 2 * (total.twice or 0)) if total.once else 0.0
    discount = min(max(discount, 0.05), 0.95)
    if not tokens:
        return Model(words, [], 0, 0, 0, discount, depth)

    before = symbol.where(F.col("c") >= least).withColumn("p", (F.col("c") - discount) / tokens)
    often = spark.sparkContext.broadcast(bit_table(before))
    common.let_go(spark)

    def twos(x: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        ok = maybe(often.value, x)
        at = np.flatnonzero(ok[1:] & ok[:-1] & (place[1:] >= 1)) + 1
        return [(x[at - 1], x[at])]

    rows = counted(texts, twos, least, buckets)
    often.destroy()
    common.let_go(spark)
    levels = [tested(rows, before, before.select(F.col("gram").alias("prefix"), F.col("c").alias("count")))]
    common.discard(rows)
    if depth > 1:
        pairs = spark.sparkContext.broadcast(bit_table(levels[0][0]))
        common.let_go(spark)

        def threes(x: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            two = longer(x)
            ok = maybe(pairs.value, two)
            at = np.flatnonzero(ok[1:] & ok[:-1] & (place[1:] >= 2)) + 1
            return [(two[at - 1], two[at])]

        rows = counted(texts, threes, least, buckets)
        pairs.destroy()
        common.let_go(spark)
        levels.append(tested(rows, levels[0][0], levels[0][0].select(F.col("gram").alias("prefix"), F.col("n").alias("count"))))
        common.discard(rows)
    if depth > 2:
        sent = spark.sparkContext.broadcast((bit_table(levels[1][0]), bit_table(still_open(levels[1][0]))))
        common.let_go(spark)

        def more(x: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            frequent, still = sent.value
            two = longer(x)
            run = longer(two)
            ok = maybe(frequent, run)
            # At a place: whether the context that ends right before it has a suffix that is open.
            at = np.flatnonzero(maybe(still, two[:-1]) & ok[:-1] & (place[1:] >= 3)) + 1
            out = []
            for k in range(3, depth + 1):
                at = at[(place[at] >= k) & ok[at - k + 2]] if k > 3 else at
                out.append((run[at - 1], run[at]))
                run = longer(run)
            return out

        rows = common.stored(count_runs(texts, more, [least] * (depth - 2), buckets, frozenset(range(1, depth - 2))), "counted")
        sent.destroy()
        common.let_go(spark)
        for k in range(3, depth + 1):
            # A context of three symbols is followed as often as it comes. Of longer ones not all were counted as runs, so
            # what follows them is added up.
            counts = levels[1][0].select(F.col("gram").alias("prefix"), F.col("n").alias("count"))
            if k > 3:
                counts = rows.where(F.col("level").isin(k - 3, 2 - k)).groupBy("prefix").agg(F.sum("n").alias("count")).where(F.col("count") >= least)
            levels.append(tested(rows.where(F.col("level") == k - 3).drop("level"), levels[-1][0], counts))
        common.discard(rows)
    common.let_go(spark)
    return Model(words, levels, documents, tokens, distinct, discount, depth)


def score(docs: DataFrame, model: Model, held_out: Column, last: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text), stored.

    last: the model's tables are removed as soon as all that scoring needs of them is sent or stored apart.
    """
    floor = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    unknown = float(np.log10(0.5) - floor), model.unknown
    head_class = _bar(model.words, "c", HEAD)
    words, counts = _sorted(model.words.where(_class("c") >= head_class).toArrow(), "c")
    values = model.values()
    hot_class = _bar(values, "uses", HOT)
    hot, value = _sorted(values.where(_class("uses") >= hot_class).toArrow(), "value")
    # All that doesn't travel, by gram; what words add is counted from what an unknown word has.
    share = F.log10((F.col("c") - model.discount) / max(1, model.tokens))
    rare = model.words.where(_class("c") < head_class).select("gram", F.lit(1).cast("long").alias("known"), (F.log10(F.col("c") + 0.5) - floor - unknown[0]).alias("base"), (share - unknown[1]).alias("more"))
    cold = values.where(_class("uses") < hot_class).select("gram", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.col("value").alias("more"))
    apart = common.stored(rare.unionByName(cold), "apart")
    buckets = 1 + apart.count() // APART
    # The last place is for words beyond the head.
    base, root = (np.append(a, b) for a, b in zip((np.log10(counts + 0.5) - floor, model.root_log(counts)), unknown, strict=True))
    tables = bit_table(model.states(), twice=True), bit_table(apart, twice=True)
    sent, depth = docs.sparkSession.sparkContext.broadcast((words, base, root, hot, value, *tables)), model.depth
    del words, hot, value, tables
    if last:
        for t in (model.words, *(t for level in model.levels for t in level)):
            common.discard(t)
    common.let_go(docs.sparkSession)
    sums = ["doc_id long", "held_out boolean", "n_tokens long", "n_known long", "base double", "lp double"]
    none = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["row", *(c.split()[0] for c in sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, root, hot, value, states, bits = sent.value
        in_head, in_hot = Lookup(words), Lookup(hot)
        row, late, have = TaskContext.get().partitionId() << ROW_BITS, [], 0
        for b in common.sliced(batches):
            x, place = symbols(b.column(2))
            text_of = np.cumsum(place == 0) - 1
            token = np.flatnonzero(place)
            at = in_head(x[token])
            # Values of a place cancel out in part, so they are added up there first.
            added, first = np.zeros(len(x)), np.zeros(len(x))
            first[token], added[token] = base[at], root[at]
            beyond = np.zeros(len(x), bool)
            beyond[token] = at < 0
            # Places that end a run of one symbol more than what may be a state; of single words, those beyond the head.
            after = beyond
            for k in range(1, depth + 2):
                x = longer(x) if k > 1 else x
                state = maybe(states, x, twice=True) if k <= depth else np.zeros(len(x), bool)
                here = np.flatnonzero((state | after) & (place >= k - 1))
                after = np.append(False, state[:-1])
                at = in_hot(x[here])
                there = at >= 0
                added[here[there]] += value[at[there]]
                rest = here[maybe(bits, x[here], twice=True)]
                late.append((x[rest], row + text_of[rest]))
                have += len(rest)
            n = b.num_rows
            tokens = np.bincount(text_of[token], minlength=n)
            known = tokens - np.bincount(text_of[beyond], minlength=n)
            own = [b.column(0), b.column(1), pa.array(tokens), pa.array(known), *(pa.array(np.bincount(text_of, v, n)) for v in (first, added))]
            rows = np.arange(row, row + n)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array((rows % buckets).astype(np.int32)), pa.nulls(n, pa.binary()), pa.array(rows), *own], names=["level", "bucket", "pack", *names])
            row += n
            if have > LATE:
                yield from sent_apart(late, 2)
                late, have = [], 0
        if have:
            yield from sent_apart(late, 2)

    def sent_apart(rows: list[tuple[np.ndarray, ...]], kind: int) -> Iterator[pa.RecordBatch]:
        gram, *rest = map(np.concatenate, zip(*rows, strict=True))
        bucket = bucket_of(gram, buckets)
        # In the order of keys, which is that of buckets too, neighbours are close or equal, and compress.
        by = np.argsort(gram, kind="stable")
        rest = [v[by] for v in rest]
        # Keys that look for values repeat, so they stay whole.
        packs = [(kind, b, (_planes(gram[by[s]]) if kind == 1 else gram[by[s]], *(_planes(v[s]) for v in rest))) for b, s in _parts(bucket[by])]
        for i in range(0, len(packs), 256):
            part = _packs(packs[i : i + 256])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.int64()), *(pa.nulls(part.num_rows, t) for t in none)], names=["level", "bucket", "pack", *names])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0
        for b in batches:
            gram, known, base, more = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            held.append((gram.view(np.uint64).copy(), known.astype(np.int8), base.copy(), more.copy()))
            have += b.num_rows
            if have > LATE:
                yield from sent_apart(held, 1)
                held, have = [], 0
        if have:
            yield from sent_apart(held, 1)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents' own sums pass; of each bucket first comes the table, then what looks for its values, and sums leave."""
        bucket, parts, find, found, have = None, [], None, [], 0
        common.give_back()

        def out() -> Iterator[pa.RecordBatch]:
            row, *more = map(np.concatenate, zip(*found, strict=True))
            row, place = np.unique(row, return_inverse=True)
            known, *more = (np.bincount(place, v, len(row)) for v in more)
            sums = row, known.astype(np.int32), *more
            packs = [(1, b, tuple(_planes(v[s]) for v in sums)) for b, s in _parts((row >> ROW_BITS).astype(np.int32))]
            for i in range(0, len(packs), 256):
                part = _packs(packs[i : i + 256])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.nulls(part.num_rows, t) for t in (pa.int64(), *none))], names=["level", "bucket", "pack", *names])

        for b in batches:
            kinds = b.column(0).to_numpy()
            if (own := b.filter(pa.array(kinds == 0))).num_rows:
                part = own.column("row").to_numpy() >> ROW_BITS
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(part.astype(np.int32)), *own.columns[2:]], names=["level", "bucket", "pack", *names])
            apart = b.filter(pa.array(kinds > 0))
            for kind, k, pack in zip(*(c.to_pylist() for c in apart.columns[:3]), strict=True):
                if k != bucket:
                    bucket, parts, find = k, [], None
                if kind == 1:
                    parts.append(pack)
                elif parts:
                    if find is None:
                        gram, *value = _unpacked(parts, np.uint64, np.int8, np.float64, np.float64, planes=True)
                        # A bucket's keys share their first bits, so the last ones go first.
                        gram, place = np.unique(gram.byteswap(), return_inverse=True)
                        find, value = Lookup(gram), [np.bincount(place, v, len(gram)) for v in value]
                    gram, row = _unpacked([pack], np.uint64, np.int64)
                    row = _from_planes(row)
                    at = find(gram.byteswap())
                    hit = at >= 0
                    found.append((row[hit], *(v[at[hit]] for v in value)))
                    have += int(hit.sum())
                    if have > LATE:
                        yield from out()
                        found, have = [], 0
        if have:
            yield from out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of a part (those that one task has read, in order), with what was found for them."""
        bucket, own, packs = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(own)
            if packs:
                row, known, base, more = _unpacked(packs, np.int64, np.int32, np.float64, np.float64, planes=True)
                at = np.searchsorted(rows.column("row").to_numpy(), row)
                add = [np.bincount(at, v, len(rows)) for v in (known, base, more)]
                for name, v, kind in zip(("n_known", "base", "lp"), add, (np.int64, np.float64, np.float64), strict=True):
                    rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(rows.column(name).to_numpy() + v.astype(kind)))
            yield from rows.select(names[1:]).to_batches(max_chunksize=10_000)

        for b in batches:
            at, kinds = b.column("bucket").to_numpy(), b.column("level").to_numpy()
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(at)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if at[i] != bucket:
                    if own:
                        yield from out()
                    bucket, own, packs = at[i], [], []
                if kinds[i]:
                    packs += b.column("pack").slice(i, j - i).to_pylist()
                else:
                    own.append(pa.RecordBatch.from_arrays(b.columns[3:], names=names).slice(i, j - i))
        if own:
            yield from out()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    schema = ", ".join(["level byte", "bucket int", "pack binary", "row long", *sums])
    out = []
    for turn in range(PASSES):
        # By the row alone, so that each row is in one share whatever task reads it.
        mine = own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PASSES)) == turn)
        both = mine.mapInArrow(run, schema).unionByName(apart.select("gram", "known", "base", "more").mapInArrow(table, schema))
        dealt = both.repartition("bucket").sortWithinPartitions("bucket", "level")
        back = dealt.mapInArrow(met, schema).repartition("bucket").sortWithinPartitions("bucket", "level", "row")
        each = back.mapInArrow(total, ", ".join(sums))
        out.append(common.stored(each.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score")), "scores"))
        common.let_go(docs.sparkSession)
    sent.destroy()
    common.discard(apart)
    return reduce(DataFrame.unionByName, out)


def learn_and_score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the rows of docs that aren't held out, and score them all."""
    with common.shuffles_removed(docs.sparkSession):
        return score(docs, learn(docs.where(~held_out)), held_out, last=True)
