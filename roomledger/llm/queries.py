"""The operators of this folder as named queries over a table directory, and their SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.llm import (
    chat_format,
    divergence,
    exact_dedup,
    language_id,
    mixing,
    near_dedup,
    packing,
    pii,
    resampling,
    suffix_dedup,
    token_counts,
    topk,
    toxicity,
)
from roomledger.llm.common import UPPER, table

WORDS = os.environ.get("ROOMLEDGER_WORD_BPE") or public_tokenizers.path("word_bpe_49k.json")
BYTES = os.environ.get("ROOMLEDGER_BYTE_BPE") or public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    added = [(-7, 0, "user", trap), (-7, 1, "assistant", trap)]
    rows = rows.union(spark.createDataFrame(added, rows.schema))
    return chat_format.digests(chat_format.format_conversations(rows))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTES)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_exact_top_k,
        op3_personal_data,
        op4_language_id,
        op5_chat_format,
        op6_source_mixing,
        op7_exact_dedup,
        op8_toxicity,
        op9_token_counts,
        op10_near_dedup,
        op11_importance_resampling,
        op12_source_divergence,
        op13_suffix_dedup,
    )
}

SQL = {
    "op2_exact_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q, v c
    WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10""",
    "op5_chat_format": r"""
WITH rows AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
    SELECT *, regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g') AS shown FROM rows
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS read,
           coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS learned,
           sum(length('### ' || role || ': ' || shown || '-</turn>-')) AS formatted_chars
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(read) AS turns_sha256, length(learned) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM whole""",
    # the cycle of 2,048 slots holds for up to 128 sources
    "op6_source_mixing": f"""
WITH RECURSIVE rows AS (
    SELECT doc_id, coalesce(source, '') AS source,
           row_number() OVER (PARTITION BY coalesce(source, '')
                              ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place
    FROM documents
), sizes AS (
    SELECT source, count(*) AS n, pow(count(*), {mixing.POWER}) AS w FROM rows GROUP BY source
), wanted AS (
    SELECT *, (2048 - count(*) OVER ()) * w / sum(w) OVER () AS exact FROM sizes
), ranked AS (
    SELECT *, 1 + CAST(floor(exact) AS BIGINT) AS whole,
           row_number() OVER (ORDER BY floor(exact) - exact, source) AS turn
    FROM wanted
), shares AS (
    SELECT source, n, whole + CASE WHEN turn <= 2048 - sum(whole) OVER () THEN 1 ELSE 0 END AS q,
           row_number() OVER (ORDER BY source) AS i
    FROM ranked
), lists AS (SELECT list(CAST(q AS BIGINT) ORDER BY i) AS q FROM shares),
walk AS (
    SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS block,
           list_transform(q, lambda x: CAST(0 AS BIGINT)) AS done FROM lists
    UNION ALL
    SELECT slot, i, done[i], list_transform(range(1, len(done) + 1),
                                            lambda j: done[j] + CASE WHEN j = i THEN 1 ELSE 0 END)
    FROM (
        SELECT w.slot + 1 AS slot, w.done, list_min(list_filter(list_transform(
            range(1, len(w.done) + 1),
            lambda j: CASE WHEN w.done[j] < l.q[j] AND w.done[j] * 2048 // l.q[j] <= w.slot + 1
                THEN {{'due': ((w.done[j] + 1) * 2048 + l.q[j] - 1) // l.q[j], 'heavy': -l.q[j], 'j': j}}
                END), lambda e: e IS NOT NULL)).j AS i
        FROM walk w, lists l WHERE w.slot < 2047)
), plan AS (
    SELECT s.source, s.q, w.block, w.slot FROM walk w JOIN shares s ON s.i = w.i
), placed AS (
    SELECT r.doc_id, r.source, r.place // {mixing.BLOCK} AS block, r.place % {mixing.BLOCK} AS position,
           s.q, 2048 * (r.place // {mixing.BLOCK} // s.q) AS since
    FROM rows r JOIN shares s ON s.source = r.source
), horizon AS (
    SELECT min(2048 * (((n + {mixing.BLOCK} - 1) // {mixing.BLOCK}) // s.q) + p.slot) AS ends
    FROM shares s JOIN plan p ON p.source = s.source
      AND p.block = ((n + {mixing.BLOCK} - 1) // {mixing.BLOCK}) % s.q
)
SELECT d.doc_id, d.source, CAST(d.block AS BIGINT) AS block, CAST(d.position AS INTEGER) AS position,
       CAST(since + d.block % d.q * 2048 // d.q AS BIGINT) AS release,
       CAST(since + ((d.block % d.q + 1) * 2048 + d.q - 1) // d.q AS BIGINT) AS deadline,
       CAST(since + p.slot AS BIGINT) AS slot,
       since + p.slot < (SELECT ends FROM horizon) AS in_mix
FROM placed d JOIN plan p ON p.source = d.source AND p.block = d.block % d.q""",
    "op7_exact_dedup": f"""
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS plain
    FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(plain) AS text_sha256
FROM d
WINDOW same AS (PARTITION BY plain)""",
    # CRC-32 is linear: the register after n bytes is the start moved on by n bytes, xor the
    # effect of each byte moved on by the bytes after it
    "op11_importance_resampling": f"""
WITH RECURSIVE bits(b, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL
    SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), step AS (SELECT b, c FROM bits WHERE k = 8),
texts AS (
    SELECT row_number() OVER () AS row, 's' AS side, doc_id, text FROM documents
    UNION ALL SELECT row_number() OVER (), 't', NULL, text FROM benchmark
), words AS (
    SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
), runs AS (
    SELECT row, side, array_to_string(w[i:i + n - 1], ' ') AS feature
    FROM (SELECT row, side, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, 4) r(n)
    WHERE i + n - 1 <= len(w)
), counted AS (SELECT row, side, feature, count(*) AS times FROM runs GROUP BY ALL),
distinct_runs AS (SELECT feature, hex(encode(feature)) AS h FROM counted GROUP BY feature),
moved(d, b, c) AS (
    SELECT 0, b, c FROM step
    UNION ALL
    SELECT d + 1, m.b, xor(m.c >> 8, s.c) FROM moved m JOIN step s ON s.b = m.c & 255
    WHERE d < (SELECT max(length(h)) // 2 FROM distinct_runs)
), begun(n, c) AS (
    SELECT 0, 4294967295
    UNION ALL
    SELECT n + 1, xor(g.c >> 8, s.c) FROM begun g JOIN step s ON s.b = g.c & 255
    WHERE n < (SELECT max(length(h)) // 2 FROM distinct_runs)
), bytes AS (
    SELECT feature, length(h) // 2 AS n, unnest(range(length(h) // 2)) AS j, h FROM distinct_runs
), effects AS (
    SELECT feature, any_value(y.n) AS n, bit_xor(m.c) AS c
    FROM bytes y JOIN moved m ON m.d = y.n - 1 - y.j AND m.b = CAST('0x' || substr(y.h, 2 * y.j + 1, 2) AS INTEGER)
    GROUP BY feature
), bucketed AS (
    SELECT feature, xor(xor(e.c, g.c), 4294967295) % 10000 AS bucket FROM effects e JOIN begun g ON g.n = e.n
), per_row AS (
    SELECT row, side, bucket, sum(times) AS times FROM counted JOIN bucketed USING (feature) GROUP BY ALL
), sums AS (
    SELECT bucket, CAST(coalesce(sum(times) FILTER (side = 's'), 0) AS DOUBLE) AS s,
           CAST(coalesce(sum(times) FILTER (side = 't'), 0) AS DOUBLE) AS t
    FROM per_row GROUP BY bucket
), gained AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000)
                                        / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
    FROM sums
), weights AS (
    SELECT w.row, any_value(w.doc_id) AS doc_id, any_value(len(w.w)) AS n_words,
           CAST(coalesce(sum(p.times), 0) AS BIGINT) AS n_features,
           CAST(coalesce(sum(p.times * g.gain), 0) AS BIGINT) AS weight
    FROM words w LEFT JOIN per_row p ON p.row = w.row AND p.side = 's' LEFT JOIN gained g USING (bucket)
    WHERE w.side = 's' GROUP BY w.row
), scored AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT)
                                                  + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM weights
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
           count(*) FILTER (n_words >= 20) OVER () AS eligible
    FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 5 * eligible // 100 THEN place END AS rank
FROM placed""",
    "op12_source_divergence": f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS text
    FROM documents
), words AS (
    SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
used AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY lang, source),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
           1 + 1000000000 * (coalesce(u.n, 0) + 5) // (coalesce(t.total, 0) + 5 * l.v) AS p,
           1 + 1000000000 * (k.n + 5) // (l.total + 5 * l.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
    LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
    GROUP BY ALL
), every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50""",
    # two hex digits are a byte; strings are compared by digest
    "op13_suffix_dedup": """
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
    SELECT row, start, md5(substr(h, 2 * start + 1, 400)) AS string
    FROM (SELECT row, h, unnest(range(length(h) // 2 - 199)) AS start FROM docs WHERE length(h) >= 400)
), repeated AS (
    SELECT row, start, lag(start) OVER (PARTITION BY row ORDER BY start) AS before
    FROM starts WHERE string IN (SELECT string FROM starts GROUP BY string HAVING count(*) > 1)
), islands AS (
    SELECT *, sum(CASE WHEN before IS NULL OR start > before + 200 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY row ORDER BY start) AS island
    FROM repeated
), spans AS (
    SELECT row, min(start) AS b, max(start) + 200 AS e FROM islands GROUP BY row, island
), gaps AS (
    SELECT row, b, coalesce(lag(e) OVER (PARTITION BY row ORDER BY b), 0) AS since FROM spans
), folded AS (
    SELECT s.row, sum(s.e - s.b) AS n_removed, count(*) AS n_spans, max(s.e) AS last FROM spans s GROUP BY s.row
), heads AS (
    SELECT g.row, string_agg(substr(d.h, 2 * g.since + 1, 2 * (g.b - g.since)), '' ORDER BY g.b) AS head
    FROM gaps g JOIN docs d USING (row) GROUP BY g.row
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(f.n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(f.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN f.row IS NULL THEN d.h ELSE head || substr(d.h, 2 * f.last + 1) END)) AS kept_sha256
FROM docs d LEFT JOIN folded f USING (row) LEFT JOIN heads USING (row)""",
}
