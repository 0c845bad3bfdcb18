"""The registered queries of the training-data operators, with their SQL where SQL can express them.

Each query applies its operator to the whole table and derives the columns that its contract names.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, common, licenses, mixing, mjpeg, nbsvm, quality_trees, setsketch, sstable, suffix_tree, toxicity, variants, warczip


@lru_cache(maxsize=2)
def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=2)
def ranked_model(path: str, pattern: str) -> str:
    return bpe.model_from_ranks(bpe.read_ranks(path), pattern)


def op1_token_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    model = _text(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    shards = sstable.write_shards(common.documents(spark, sf_dir), common.shared_dir(spark, "token-shards"), model, 0)
    return sstable.digests(shards)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.stored(mixing.slim(common.documents(spark, sf_dir)), "mix-sizes")
    mixed = mixing.repeats(rows, mixing.plan(rows))
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, ''))) AS hash
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source),
filled AS (
  SELECT *, 2 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 3 / 2 AS budget, sum(weight) OVER () AS weights,
         sum(2 * source_size) OVER o AS caps, sum(weight) OVER o AS used
  FROM src WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT *, caps + cap / weight * (weights - used) <= budget AS clamped FROM filled),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) FILTER (clamped) OVER (), 0)) / sum(weight) FILTER (NOT clamped) OVER () AS level FROM marked),
goals AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * weight) END AS target FROM levels),
reps AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goals),
ties AS (SELECT source, hash, sum(size) AS tie_size FROM docs GROUP BY ALL),
runs AS (
  SELECT source, hash, 2 * sum(tie_size) OVER (PARTITION BY source ORDER BY hash ROWS UNBOUNDED PRECEDING) - tie_size AS middle FROM ties)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * (r.whole + (u.middle < 2 * (r.target - r.whole * r.source_size))::INT))::BIGINT AS taken,
       (r.whole + (u.middle < 2 * (r.target - r.whole * r.source_size))::INT)::INT AS repeats
FROM docs d JOIN reps r ON d.source IS NOT DISTINCT FROM r.source
JOIN runs u ON u.source IS NOT DISTINCT FROM d.source AND u.hash = d.hash
"""


def coded(docs: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """The keys, and digests of each text's ids and of what they decode to."""
    return bpe.round_trip(docs, model, keys).withColumnsRenamed({"n_inside": "n_inside_chars", "last_start": "last_char_start"})


def op7_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    model = ranked_model(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded(common.documents(spark, sf_dir), model, ["doc_id"])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.documents(spark, sf_dir), ["doc_id"])


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = warczip.write_packages(pages, common.shared_dir(spark, "warc-zip"), least=0)
    return warczip.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 in SQL: the digest's 160 bits as a bit string, five bits at a time.
OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM h),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, 1 + 5 * i + j, 1)::INT << (4 - j)))::INT, 1)), '') AS payload_digest FROM b),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM g
"""


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.learn_and_score(common.documents(spark, sf_dir), F.pmod(common.id_crc(), F.lit(5)) == 1)


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(common.documents(spark, sf_dir))


def op5_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mjpeg.store(common.documents(spark, sf_dir), ["doc_id"])
    media = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    back = mjpeg.read(media, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    feature = F.concat(F.col("frames").cast("string"), F.lit(" frames, cuts at "), F.array_join(F.col("cuts").cast("array<string>"), ","))
    return back.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))


def op6_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = nbsvm.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = nbsvm.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (F.pmod(common.id_crc(), F.lit(3)) == 1).alias("held_out"), "score", "predicted", "margin")


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    trees = quality_trees.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_trees.score(docs, trees, ["doc_id"]).select("doc_id", *quality_trees.COUNTS, "base_failed", "kept", "score")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        pieces = f.read()
    got = alignment.aligned(common.documents(spark, sf_dir), _text(public_tokenizers.path("byte_bpe_50k.json")), pieces, ["doc_id"])
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (F.pmod(common.id_crc(), F.lit(5)) == 0).alias("held_out"), "score", "predicted", "toxic_ll", "ordinary_ll")


#: crc32 bit by bit: over the bytes of a text, and eight times for each byte.
OP13_SQL = r"""
WITH runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(id || run))), lambda i: ('0x' || substr(hex(encode(id || run)), 2 * i + 1, 2))::BIGINT),
    lambda a, b: list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295)) AS h FROM c),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole FROM v, unnest(range(1, length(word) + 1)) u(i)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.i = b.i AND a.hole = b.hole AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT k.word, k.n, v.word, v.n FROM k JOIN v ON k.hole = v.word
  UNION SELECT v.word, v.n, k.word, k.n FROM k JOIN v ON k.hole = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, {'m': -near_n, 'w': near}) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
t AS (
  WITH RECURSIVE t(word, last) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.last WHERE f.form IS NOT NULL)
  SELECT t.word, t.last AS root FROM t JOIN f ON f.word = t.last WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON t.word = f.word
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(common.documents(spark, sf_dir))


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_source_mix": op2_source_mix,
    "op3_suffix_tree_lm": op3_suffix_tree_lm,
    "op4_setsketch_dedup": op4_setsketch_dedup,
    "op5_avi_mjpeg": op5_avi_mjpeg,
    "op6_quality_nbsvm": op6_quality_nbsvm,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_warc_zip": op9_warc_zip,
    "op10_quality_trees": op10_quality_trees,
    "op11_token_alignment": op11_token_alignment,
    "op12_toxicity_kn": op12_toxicity_kn,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL = {"op2_source_mix": OP2_SQL, "op9_warc_zip": OP9_SQL, "op13_spelling_variants": OP13_SQL}
