"""Queries of the training-data operators and the SQL that their rows can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import audio, decontaminate, interactions, langid, linededup, minhash, packing, quality, secrets, sharding, toxicity, whitening, windows
from logweave.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op2_line_dedup(table(spark, sf_dir, "documents"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op3_shard(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op4_near_duplicates(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op5_secrets(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op6_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.op7_audio(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8_pack(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op9_language(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.op11_filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op12_whitening(table(spark, sf_dir, "embeddings"))


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.op13_window_packing(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_line_dedup": op2_line_dedup,
        "op3_shard": op3_shard,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_secrets": op5_secrets,
        "op6_toxicity": op6_toxicity,
        "op7_audio": op7_audio,
        "op8_pack": op8_pack,
        "op9_language": op9_language,
        "op10_quality": op10_quality,
        "op11_filter_interactions": op11_filter_interactions,
        "op12_whitening": op12_whitening,
        "op13_window_packing": op13_window_packing,
    }


_WORDS = (
    "list_filter(string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w) AS size, win FROM (
    SELECT item_id, w[1:1] AS one, unnest(CASE WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) END) AS win,
        CASE WHEN len(w) < 13 THEN w ELSE w[1:13] END AS w FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS s, w FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT dw.doc_id, bw.item_id, dw.s, dw.size FROM dw JOIN bw
    ON bw.size = dw.size AND bw.win = array_to_string(dw.w[dw.s:dw.s + dw.size - 1], ' ')),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
    (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM
    (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP4_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


# every document is sent through every order, filter by filter
OP11_SQL = """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT row_number() OVER () AS r, part, fails, len(list_filter(fails, lambda x: x)) AS n_fails,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
ways AS (SELECT o AS filter_order, step, ascii(o[step]) - 64 AS k FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
out AS (SELECT r, o, min(step) AS gone FROM d, (SELECT filter_order AS o, step, k FROM ways) WHERE fails[k] GROUP BY r, o),
each AS (SELECT part, filter_order, step, k, coalesce(gone, 6) AS gone, fails[k] AS fails, n_fails, good, toxic
    FROM d CROSS JOIN ways LEFT JOIN out ON out.r = d.r AND out.o = ways.filter_order),
steps AS (SELECT part, filter_order, step, k, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
    count(*) FILTER (fails AND gone < step) AS redundant, count(*) FILTER (fails AND n_fails = 1) AS unique_fails,
    count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost
    FROM each GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM steps
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op4_near_duplicates": OP4_SQL, "op11_filter_interactions": OP11_SQL}
