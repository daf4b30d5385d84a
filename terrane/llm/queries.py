"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from terrane.llm import bpe, caps, chat, langid, lm, media, minhash, mixing, pii, prefix_trie, secret_scan, token_counts, whitening
from terrane.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], schema)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.conversation_digest(chat.format_conversations(turns))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(table(spark, sf_dir, "documents"))


def op6_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_digest(table(spark, sf_dir, "conversations"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_digest(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_media, op2_chat, op3_bpe, op4_lm, op5_token_counts, op6_caps, op7_langid, op8_minhash, op9_mixing, op10_pii, op11_prefix_trie, op12_secrets, op13_whitening)}


def _escaped_length() -> str:
    """SQL for a text's length after escaping: one more per backslash, two more per control string."""
    out = "length(t) + (length(t) - length(replace(t, chr(92), '')))"
    for c in chat.CONTROLS:
        out += f" + 2 * ((length(t) - length(replace(t, '{c}', ''))) // {len(c)})"
    return out


OP2_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_escaped_length()} + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 26 + length(role) END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

_COMPONENTS = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"""

OP6_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),{_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
FROM embeddings"""

OP8_SQL = f"""
WITH RECURSIVE texts AS MATERIALIZED (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents),
reps AS MATERIALIZED (SELECT min(doc_id) AS id, t, string_split(t, ' ') AS w FROM texts GROUP BY t),
sh AS MATERIALIZED (SELECT id, array_to_string(w[p:p + 4], ' ') AS s, count(*) AS w FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM reps WHERE t <> '') GROUP BY ALL),
n AS (SELECT id, sum(w) AS n FROM sh GROUP BY id),
both_have AS (SELECT x.id AS a, y.id AS b, sum(least(x.w, y.w)) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM both_have JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),{_COMPONENTS},
classes AS (SELECT reps.t, least(reps.id, coalesce((SELECT min(b) FROM reach WHERE a = reps.id), reps.id)) AS class_id FROM reps)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM texts JOIN classes USING (t)"""


OP11_SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
crc(c, i, v) AS (SELECT c, 1, 4294967295::UBIGINT FROM ids UNION ALL
  SELECT c, i + 1, list_reduce(list_prepend(xor(v, ascii(substr(c::VARCHAR, i, 1))::UBIGINT), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) FROM crc WHERE i <= length(c::VARCHAR)),
h AS (SELECT c, (xor(v, 4294967295::UBIGINT) % 9)::BIGINT AS h FROM crc WHERE i = length(c::VARCHAR) + 1),
turns AS (
  SELECT ids.c, o.r, o.t, o.p AS p FROM ids JOIN h USING (c) JOIN own o ON o.c = ids.c - ids.c % 5 AND o.p <= h.h
  UNION ALL SELECT o.c, o.r, o.t, 1000 + o.p FROM own o JOIN h USING (c) WHERE o.p > h.h),
placed AS (SELECT c, octet_length(encode(t)) AS n, row_number() OVER w AS d, string_agg(length(r) || ':' || length(t) || ':' || r || t, '') OVER (PARTITION BY c ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM turns WINDOW w AS (PARTITION BY c ORDER BY p)),
paths AS MATERIALIZED (SELECT c, 0 AS d, 0 AS n, '' AS k FROM ids UNION ALL SELECT c, d, n, md5(k) FROM placed),
sizes AS (SELECT c, max(d) AS len FROM paths GROUP BY c),
nodes AS MATERIALIZED (SELECT k, d, any_value(n) AS n, min(c) AS c, count(*) AS m, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '') AS ends FROM paths JOIN sizes USING (c) GROUP BY k, d),
ups AS (SELECT x.k, x.d, y.k AS pk, y.d AS pd FROM nodes x JOIN paths y ON y.c = x.c AND y.d <= x.d),
children AS (SELECT pk, pd, count(*) AS n FROM ups WHERE pd = d - 1 GROUP BY ALL),
below AS (SELECT u.pk, u.pd, sum((v.m - 1) * v.n) AS saved, count(*) FILTER (ch.n IS NULL) AS leaves FROM ups u JOIN nodes v ON v.k = u.k AND v.d = u.d LEFT JOIN children ch ON ch.pk = u.k AND ch.pd = u.d GROUP BY ALL)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, p.c AS parent_conv_id, x.m AS n_convs, coalesce(ch.n, 0) AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN below b ON b.pk = x.k AND b.pd = x.d LEFT JOIN children ch ON ch.pk = x.k AND ch.pd = x.d
LEFT JOIN ups u ON u.k = x.k AND u.d = x.d AND u.pd = x.d - 1 LEFT JOIN nodes p ON p.k = u.pk AND p.d = u.pd"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": OP2_SQL, "op6_caps": OP6_SQL, "op8_minhash": OP8_SQL, "op11_prefix_trie": OP11_SQL}
