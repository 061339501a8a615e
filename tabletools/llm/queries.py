"""The queries of the subpackage on the given tables, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletools.llm.exact_dedup import exact_groups
from tabletools.llm.mixing import taken_words
from tabletools.llm.packing import pack
from tabletools.llm.quality import judge_quality
from tabletools.llm.secret_scans import KINDS, joined, scan_secrets
from tabletools.llm.sharding import shard_documents
from tabletools.llm.simhash import simhash_groups
from tabletools.llm.substring_dedup import remove_repeats
from tabletools.llm.token_alignment import aligned_documents
from tabletools.llm.topk_search import top_k
from tabletools.llm.toxicity import held_out, score_documents
from tabletools.llm.url_filters import judge_urls
from tabletools.llm.vector_codes import compress


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "cost")
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in KINDS]
    found = found.select("doc_id", *[(F.size(kinds) - n).cast("long").alias(f"n_{k}") for k, n in zip(KINDS, counts)],
                         F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cost")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_documents(_table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge_quality(docs, _table(spark, sf_dir, "labels")).select("doc_id", "quality_rules.*")
    return judged.select(*[c for c in judged.columns if c != "score"], "score")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings"))[0]


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sharding": op4_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_topk_search": op11_topk_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_alignment": op13_token_alignment,
}

_CODES_ROUND = """
found{n} AS MATERIALIZED (
  SELECT vec_id, part, min(error) AS error, arg_min(entry, (error, entry)) AS entry FROM (
    SELECT x.vec_id, x.part, e.entry, sum((x.x - e.x) ** 2)::BIGINT AS error
    FROM parts x JOIN book{n} e USING (part, place) GROUP BY ALL)
  GROUP BY vec_id, part),"""

_CODES_NEXT = """
book{next} AS MATERIALIZED (
  SELECT b.part, b.place, b.entry, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN (
    SELECT p.part, p.place, f.entry, floor(sum(p.x) / count(*)) AS x
    FROM parts p JOIN found{n} f USING (vec_id, part) GROUP BY ALL) m USING (part, place, entry)),"""

# two rounds, then the last assignment
_CODES_SQL = """
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS nth FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
parts AS MATERIALIZED (
  SELECT vec_id, nth, (i - 1) // (n // 16) AS part, (i - 1) % (n // 16) AS place, floor(256 * x::DOUBLE) AS x FROM (
    SELECT vec_id, nth, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, place, nth AS entry, x FROM parts WHERE nth < 64),""" + "".join(
    _CODES_ROUND.format(n=n) + (_CODES_NEXT.format(n=n, next=n + 1) if n < 2 else "") for n in range(3)) + """
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
  FROM found2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""

ORACLES = {
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_mixing": r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src, md5(coalesce(doc_id::VARCHAR, '')) AS mark,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY mark, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
sources AS (
  SELECT src, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY src) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY src),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) /
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY most / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT src, source_size, least(most, weight * (SELECT arg_min(level, most / weight) FROM levels
    WHERE most >= level * weight)) AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS rounds,
    ceil(source_size / 256)::BIGINT AS per_round FROM targets),
needed AS (SELECT *, (rounds * per_round + ceil((floor(target)::BIGINT - rounds * source_size) / 256))::BIGINT AS slots FROM plan),
shares AS (
  SELECT src, slots, coalesce(lag(high) OVER (ORDER BY src), 0) AS low,
    CASE WHEN lead(src) OVER (ORDER BY src) IS NULL THEN 1.0::DOUBLE ELSE high END AS high
  FROM (SELECT *, sum(target) OVER (ORDER BY src) / sum(target) OVER () AS high FROM needed WHERE target > 0)),
points AS (
  SELECT position, (reverse(lpad(bin(position), 52, '0')))::BIT::BIGINT / 4503599627370496.0::DOUBLE AS point
  FROM (SELECT unnest(range((SELECT sum(slots)::BIGINT FROM needed))) AS position)),
ranked AS (
  SELECT src, slots, position, row_number() OVER (PARTITION BY src ORDER BY position) - 1 AS rank
  FROM points JOIN shares ON point >= low AND point < high),
placed AS (
  SELECT src, rank, position FROM ranked WHERE rank < slots
  UNION ALL SELECT src, rank, (SELECT sum(slots) FROM needed)::BIGINT + rank FROM (
    SELECT src, unnest(range(given, slots)) AS rank FROM needed LEFT JOIN
      (SELECT src, count(*) AS given FROM ranked GROUP BY src) USING (src) WHERE coalesce(given, 0) < slots)),
mixed AS (
  SELECT doc_id, size, source_size, target, src, start,
    CASE WHEN size = 0 THEN 0 ELSE size * (floor(target)::BIGINT // source_size)
      + greatest(0, least(size, floor(target)::BIGINT % source_size - start)) END::BIGINT AS taken
  FROM streams JOIN targets USING (src))
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN position END::BIGINT AS position
FROM mixed LEFT JOIN placed ON placed.src = mixed.src AND rank = start // 256""",
    "op11_topk_search": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q, whole c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
WHERE rank <= 10""",
    "op12_vector_codes": _CODES_SQL,
}
