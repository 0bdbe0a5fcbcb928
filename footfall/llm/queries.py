"""Queries of the llm operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import (
    bit_sliced, chat, decontaminate, jaccard_join, lm, packing, periodic_runs, quality_classifier, quality_rules, suffix_dedup, warc, wavelet,
    whitening)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(table(spark, sf_dir, "documents"), byte_bpe()).drop("shard_file")


# every limit binds: at most 16 pieces, and 1000 tokens of answers; documents have no roles, so the first
# quarter of each is its prompt and the rest its answer
PACKING = {"max_tokens": 1024, "max_segments": 16, "max_loss": 1000, "loss_share": 0.75}


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), **PACKING)


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))[0]


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("url", "html")


ORACLE["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""


TRICKY = r"\### Assistant: </turn> ok"


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.round_trip(conversations.select("conv_id", "turn", "role", "text").unionByName(own))


ORACLE["op6_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN contains(text, '\') OR contains(text, '### ') OR contains(text || ' </turn>', ' </turn>' || chr(10))
    THEN regexp_replace(text, '([\\#<])', '\\\1', 'g') ELSE text END AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(body) + length(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
    ELSE '@' || regexp_replace(role, '([\\#<: ])', '\\\1', 'g') END) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_score(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


ORACLE["op7_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, CAST(p AS BIGINT) AS p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 200)) AS k
  FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
i AS (SELECT doc_id, p, sum(CASE WHEN p <= q + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS g
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, g),
k AS (SELECT s.doc_id, s.a, s.b, substr(h, 2 * coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) + 1,
    2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0))) AS piece
  FROM s JOIN d ON d.doc_id = s.doc_id),
x AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, string_agg(piece, '' ORDER BY a) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE kept || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


ORACLE["op9_jaccard_join"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[CAST(p AS BIGINT):CAST(p + 4 AS BIGINT)], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.g FROM s JOIN f ON f.g = s.g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r AS a JOIN r AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n AS x ON x.doc_id = o.a JOIN n AS y ON y.doc_id = o.b WHERE 100 * i >= 75 * (x.n + y.n - i)),
c(doc_id, k) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.k FROM c JOIN l ON l.a = c.doc_id WHERE c.k < l.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.k AS component_id
FROM (SELECT doc_id, min(k) AS k FROM c GROUP BY doc_id) AS m JOIN documents AS d ON d.doc_id = m.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"))


ORACLE["op12_bit_sliced_top_k"] = """
WITH r AS (SELECT vec_id, embedding AS v, len(embedding) AS d, row_number() OVER () AS r FROM embeddings WHERE len(embedding) > 0),
e AS (SELECT r, vec_id, d, unnest(range(d)) AS p, CAST(unnest(v) AS DOUBLE) AS x FROM r),
b AS (SELECT DISTINCT r FROM e WHERE x IS NULL OR NOT isfinite(x)),
u AS (SELECT * FROM e WHERE r NOT IN (SELECT r FROM b)),
l AS (SELECT d FROM u WHERE p = 0 GROUP BY d ORDER BY count(*) DESC, d DESC LIMIT 1),
q AS (SELECT r, vec_id, p, CAST(floor(256 * x) AS BIGINT) AS x FROM u WHERE d = (SELECT d FROM l)),
s AS (SELECT a.r, a.vec_id AS query_id, c.r AS other, c.vec_id, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM q AS a JOIN q AS c ON a.p = c.p AND a.vec_id IS DISTINCT FROM c.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=True)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
