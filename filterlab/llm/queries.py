"""The registered queries of the training-data operators, and SQL for those that have any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filterlab.llm import bpe, chat, html_extract, importance, langid, line_dedup, merkle, mixing, quality, sharding, simhash, spm, topk
from filterlab.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    turns = turns.unionByName(spark.createDataFrame(forged, turns.schema))
    out = chat.formatted(turns, public_tokenizers.path("byte_bpe_50k.json"))
    return chat.digests(out)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extracted(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _token_digests(coded: DataFrame, between: str) -> DataFrame:
    digits = F.array_join(F.col("ids").cast("array<string>"), between)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spm.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return _token_digests(out, ",")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id, n_chars = F.col("doc_id"), F.col("n_chars")
    row = [doc_id, F.col("source"), F.col("lang"), n_chars, F.col("text")]
    tampered = merkle.leaf(*row[:3], n_chars.cast("decimal(20,0)") + 1, row[4])
    claim = F.when(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, tampered)
    out = merkle.manifest(docs, merkle.leaf(*row), F.col("lang"), doc_id, keep={"doc_id": doc_id, "claim": claim})
    out = out.withColumns({"proof_sha256": merkle.proof_digest(F.col("path")), "folded_root": merkle.folded(F.coalesce("claim", "leaf"), F.col("path"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return _token_digests(out, " ")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_topk, op4_chat, op5_simhash, op6_html, op7_sentencepiece, op8_langid, op9_sharding, op10_quality, op11_merkle, op12_importance, op13_bpe)}


_MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || 'mix'), 1, 15))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
w AS (SELECT *, ([5.0, 2.0, 1.0][((n - 1) % 3 + 1)::INT])::DOUBLE AS weight, source_size * 3.0::DOUBLE AS ceiling FROM r),
o AS (SELECT *, ceiling / weight AS ratio, (sum(source_size) OVER ())::DOUBLE AS budget, sum(weight) OVER () AS weights FROM w),
l AS (SELECT *, (budget - coalesce(sum(ceiling) OVER up, 0)) / (weights - coalesce(sum(weight) OVER up, 0)) AS level
      FROM o WINDOW up AS (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, n, budget, least(ceiling, coalesce((SELECT level FROM l WHERE ratio >= level ORDER BY ratio, n LIMIT 1) * weight, ceiling)) AS target FROM l),
c AS (SELECT doc_id, size, u, source_size, n, target, sum(size) OVER (PARTITION BY t.n ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (source_size * e + cum)::DOUBLE / target AS time FROM c, range(3) x(e) WHERE size > 0 AND target > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY time, n, u, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k),
g AS (SELECT doc_id, count(*) AS copies FROM m WHERE upto <= (SELECT sum(target) FROM t) GROUP BY doc_id)
SELECT c.doc_id, size, source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken FROM c LEFT JOIN g ON g.doc_id = c.doc_id
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.t, c.t), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _sql_crc(bytes_: str) -> str:
    """The CRC-32 of a list of bytes, bit by bit."""
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(flatten(list_transform({bytes_}, lambda b: [b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: {step}, 4294967295::BIGINT), 4294967295)"


def _sql_field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END"


_LEAF = "sha256(" + " || ".join(f"({_sql_field(x)})" for x in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_ID_BYTES = "list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1)))"
_MERKLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS g, {_LEAF.format(n="n_chars")} AS leaf,
         CASE WHEN {_sql_crc(_ID_BYTES)} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} END AS claim FROM documents),
leaves AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM rows),
nodes AS (
  SELECT g, 0 AS level, idx, leaf AS digest, n FROM leaves
  UNION ALL SELECT g, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), max((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY g, level, idx // 2),
subroots AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, digest, n FROM subroots
  UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), max((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, idx // 2),
low AS (
  SELECT row, g, 0 AS level, idx, n, coalesce(claim, leaf) AS d, '' AS sibs FROM leaves
  UNION ALL
  SELECT w.row, w.g, w.level + 1, w.idx // 2, (w.n + 1) // 2, sha256(CASE WHEN w.idx % 2 = 1 THEN s.digest || d ELSE d || coalesce(s.digest, '') END), sibs || coalesce(s.digest, '')
  FROM low w LEFT JOIN nodes s ON s.g = w.g AND s.level = w.level AND s.idx = xor(w.idx, 1) WHERE w.n > 1),
high AS (
  SELECT low.row, 0 AS level, subroots.idx, subroots.n, d, sibs FROM low JOIN subroots ON low.g = subroots.g WHERE low.n = 1
  UNION ALL
  SELECT w.row, w.level + 1, w.idx // 2, (w.n + 1) // 2, sha256(CASE WHEN w.idx % 2 = 1 THEN s.digest || d ELSE d || coalesce(s.digest, '') END), sibs || coalesce(s.digest, '')
  FROM high w LEFT JOIN tops s ON s.level = w.level AND s.idx = xor(w.idx, 1) WHERE w.n > 1)
SELECT l.doc_id, l.leaf, subroots.digest AS subroot, tops.digest AS root, sha256(high.sibs) AS proof_sha256, high.d AS folded_root, high.d = tops.digest AS verified
FROM leaves l JOIN high ON high.row = l.row AND high.n = 1 JOIN subroots ON subroots.g = l.g JOIN tops ON tops.n = 1
"""

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE_CRC = "list_reduce(list_transform(range(1, strlen(f) + 1), lambda k: ('0x' || substr(h, 2 * k - 1, 2))::BIGINT), lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1]), 4294967295::BIGINT)"
_IMPORTANCE = rf"""
WITH crcs AS (SELECT list(c ORDER BY b) AS crcs FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, x: xor(a >> 1, 3988292384 * (a & 1))) AS c FROM range(256) r(b))),
texts AS (SELECT 0 AS side, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark),
words AS (SELECT side, row, coalesce(regexp_extract_all(translate(text, '{_AZ}', '{_az}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
runs AS (
  SELECT side, row, unnest(w) AS f FROM words
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM words
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) FROM words),
counted AS (SELECT side, row, f, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
hashed AS MATERIALIZED (SELECT f, xor({_TABLE_CRC}, 4294967295) % 10000 AS bucket FROM hexed, crcs),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((sum(t) OVER ())::DOUBLE + 10000))))::BIGINT AS gain FROM buckets),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
docs AS (SELECT row_number() OVER () AS row, doc_id FROM documents),
scored AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs JOIN words ON words.row = docs.row AND side = 0 LEFT JOIN weights ON weights.row = docs.row),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= n * 5 // 100 THEN place END AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; hashes, models and parsers keep the others to brute-force tests."""
    return {"op2_mixing": _MIX, "op3_topk": _TOP_K, "op11_merkle": _MERKLE, "op12_importance": _IMPORTANCE}
