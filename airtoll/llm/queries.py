"""Registered queries of this subpackage and their SQL counterparts, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from airtoll.llm import (chat, collocations, decontamination, exact_dedup, exact_topk, line_dedup, mixing, near_dedup, periodic_runs,
                         quality, suffix_dedup, toxicity, url_filter)
from airtoll.llm.common import table


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      "contaminated")


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, folder, "documents"), by="sentence", min_words=20)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_chars", "n_removed", "removed_chars", spans.alias("removed_spans"),
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    out = url_filter.judge(pages, url_filter.RULES, url_filter.train(url_filter.labelled_urls(spark)))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    vocab = chat.vocabulary()
    return chat.read_back(chat.format_chat(chat.with_probe(table(spark, folder, "conversations"), spark), vocab), vocab)


def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The flattest mixture of 1.9 times as many tokens as there are in which no source is passed more than twice."""
    return mixing.mix(table(spark, folder, "documents"), budget_share=1.9, repeats=2.0)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, folder, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by a hash of its id, goes on in circles from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(
        F.col("a") + (i - F.col("a")) % F.col("p")))
    circled = F.array_join(F.transform(places, lambda i: F.get("words", i.cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, circled).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    out = periodic_runs.periodic_runs(with_planted_runs(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    period = -F.col("best.less")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        period.alias("period"), F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_minhash_near_dedup, op3_line_dedup, op4_url_filter,
    op5_quality_classifier, op6_chat_formatting, op7_suffix_array_dedup, op8_exact_dedup, op9_mixing, op10_toxicity,
    op11_exact_topk, op12_phrase_collocations, op13_periodic_runs, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bs)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT dg.doc_id, dg.i, dg.k, win.item_id FROM dg JOIN win USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l
        FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

_OP3 = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(text, '(?s).*?(?:[.!?][ \t\r\x0B\x0C]+|\n|\z)') AS a FROM documents WHERE text <> ''),
units AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM cut),
placed AS (SELECT doc_id, i, a[i] AS u, sum(length(a[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(a[i]) AS s,
       trim(regexp_replace(translate(a[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n\x0B\x0C]+', ' ', 'g')) AS norm FROM units),
worded AS (SELECT *, len(string_split(norm, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM placed WHERE norm <> ''),
repeats AS (SELECT * FROM worded QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) > 1),
numbered AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM repeats),
runs AS (SELECT doc_id, run, min(i) AS f, max(i) AS t, CAST(min(s) AS BIGINT) AS s, CAST(max(s + length(u)) AS BIGINT) AS e, count(*) AS n
         FROM numbered GROUP BY doc_id, run HAVING sum(words) >= 20),
per AS (SELECT doc_id, sum(n) AS n_removed, sum(e - s) AS removed_chars, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM runs GROUP BY doc_id),
kept AS (SELECT p.doc_id, string_agg(u, '' ORDER BY i) AS kept FROM placed p LEFT JOIN runs r ON r.doc_id = p.doc_id AND i BETWEEN f AND t
         WHERE r.doc_id IS NULL GROUP BY p.doc_id)
SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars, coalesce(spans, '') AS removed_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_OP8 = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS norm FROM documents) WINDOW g AS (PARTITION BY norm)"""

_OP2 = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
       FROM dw WHERE len(w) > 0),
one AS (SELECT s, min(doc_id) AS a FROM (SELECT doc_id, list_sort(s) AS s FROM sh) GROUP BY s),
tok AS (SELECT a, len(s) AS n, unnest(s) AS t FROM one),
common AS (SELECT x.a AS a, y.a AS b, x.n AS n, y.n AS m, count(*) AS c FROM tok x JOIN tok y ON x.t = y.t AND x.a < y.a GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (n + m - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(a, b) AS (SELECT a, a FROM one UNION SELECT r.a, w.b FROM reached r JOIN both_ways w ON w.a = r.b),
least AS (SELECT a, min(b) AS component FROM reached GROUP BY a),
named AS (SELECT sh.doc_id, len(sh.s) AS n, component FROM (SELECT doc_id, list_sort(s) AS s FROM sh) sh JOIN one USING (s) JOIN least USING (a))
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN named USING (doc_id)"""

_OP6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 10 + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
firsts AS (SELECT w, min(doc_id) AS least FROM win GROUP BY w),
hit AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS new
        FROM win JOIN firsts USING (w) WHERE least < doc_id),
numbered AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit),
spans AS (SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM numbered GROUP BY doc_id, run),
behind AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS past FROM spans),
per AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * past + 1, 2 * (s - past)), '' ORDER BY s) AS kept, max(e) AS past
        FROM behind JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(past, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)"""

_PLACE = "('0x' || substr(md5(concat_ws('|', {})), 1, 13))::BIGINT / 4503599627370496.0"
_KEPT = "1.9 * list_max(list_transform(ps, lambda x: pow(x, {0} - 1))) / list_sum(list_transform(ps, lambda x: pow(x, {0}))) <= 2.0"

_OP9 = rf"""
WITH RECURSIVE m AS (SELECT doc_id, source, coalesce('=' || source, '') AS key, {_PLACE.format("17, doc_id, coalesce(text, '')")} AS pos,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
src AS (SELECT key, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY key),
tot AS (SELECT CAST(greatest(sum(n), 1) AS DOUBLE) AS total FROM src),
p AS (SELECT list(n / total) AS ps FROM src, tot WHERE n > 0),
halved(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT step, low, high, (low + high) / 2 AS mid, {_KEPT.format("((low + high) / 2)")} AS ok FROM halved, p WHERE step < 32)),
expo AS (SELECT CASE WHEN {_KEPT.format("0.0")} THEN 0.0 ELSE high END AS e FROM halved, p WHERE step = 32),
powers AS (SELECT key, n, total, CASE WHEN n > 0 THEN pow(n / total, e) ELSE 0 END AS w FROM src, tot, expo),
weights AS (SELECT key, n, w / sum(w) OVER () AS weight, CASE WHEN n > 0 THEN w / sum(w) OVER () * (1.9 * total) / n ELSE 1 END AS passes FROM powers),
plan AS (SELECT key, round(weight, 9) AS weight, least(greatest(ceil(n / 100000), 1), 4096) AS blocks, CAST(floor(passes + 1e-9) AS BIGINT) AS whole,
         CAST(greatest(floor((passes - floor(passes + 1e-9)) * n + 1e-3), 0) AS BIGINT) AS rest FROM weights),
placed AS (SELECT m.*, weight, whole, rest, CAST(least(floor(pos * blocks), blocks - 1) AS INTEGER) AS block FROM m JOIN plan USING (key)),
sums AS (SELECT key, block, rest, sum(n) AS tokens FROM placed GROUP BY ALL),
behind AS (SELECT *, sum(tokens) OVER w AS past, row_number() OVER w AS block_rank FROM sums
           WINDOW w AS (PARTITION BY key ORDER BY {_PLACE.format("18, key, block")}, block ROWS UNBOUNDED PRECEDING)),
taken AS (SELECT key, block, block_rank, rest > 0 AND past <= rest AS taken, past > rest AND past - tokens < rest AS cut,
          CAST(rest - past + tokens AS BIGINT) AS room FROM behind),
docs AS (SELECT key, block, pos, CAST(sum(n) AS BIGINT) AS size, cut, room FROM placed JOIN taken USING (key, block) WHERE NOT taken GROUP BY ALL),
queue AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS r FROM docs WHERE cut),
fit(key, r, pos, room, fits) AS (
  SELECT DISTINCT key, 0::BIGINT, -1.0::DOUBLE, room, false FROM queue UNION ALL
  SELECT q.key, q.r, q.pos, fit.room - CASE WHEN q.size <= fit.room THEN q.size ELSE 0 END, q.size <= fit.room
  FROM fit JOIN queue q ON q.key = fit.key AND q.r = fit.r + 1),
rooms AS (SELECT key, min(room) AS room FROM fit GROUP BY key),
rest_of AS (SELECT d.key, d.pos, d.size, r.room, sum(d.size) OVER (PARTITION BY d.key ORDER BY d.size, d.pos ROWS UNBOUNDED PRECEDING) AS past
            FROM docs d JOIN rooms r ON r.key = d.key AND r.room > 0 AND d.size <= r.room
            WHERE NOT EXISTS (SELECT 1 FROM fit WHERE fit.key = d.key AND fit.pos = d.pos AND fits)),
short AS (SELECT key, pos, size FROM rest_of WHERE past <= room),
chosen AS (SELECT key, pos FROM fit WHERE fits UNION ALL SELECT key, pos FROM short),
lacking AS (SELECT key, room - coalesce((SELECT sum(size) FROM short s WHERE s.key = rooms.key), 0) AS shortfall FROM rooms)
SELECT doc_id, source, n AS n_tokens, weight, block, whole + CASE WHEN taken OR c.pos IS NOT NULL THEN 1 ELSE 0 END AS copies, block_rank,
       p.pos + CASE WHEN cut AND c.pos IS NULL THEN 1 ELSE 0 END AS place,
       CAST(coalesce(shortfall, 0) AS BIGINT) AS shortfall
FROM placed p JOIN taken t USING (key, block) LEFT JOIN chosen c ON c.key = p.key AND c.pos = p.pos LEFT JOIN lacking l ON l.key = p.key"""

_OP11 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""

_OP12 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
parts AS (SELECT lang, i, w, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM places),
f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a FROM parts GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k, a FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, a, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail, c
        FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, x.a AS l, y.a AS r, c, CAST(2000000::HUGEINT * cut.a // (x.a + y.a) AS BIGINT) AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail
           QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, c) = 1),
sizes AS (SELECT *, unnest(range(2, k)) AS m FROM cand),
inner_parts AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM sizes)),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
best AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
         FROM scored s LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * s.a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM best JOIN total USING (lang) WHERE rank <= 2000"""

SQL = {"op1_benchmark_decontamination": _OP1, "op2_minhash_near_dedup": _OP2, "op3_line_dedup": _OP3, "op6_chat_formatting": _OP6, "op7_suffix_array_dedup": _OP7, "op8_exact_dedup": _OP8,
       "op9_mixing": _OP9, "op11_exact_topk": _OP11, "op12_phrase_collocations": _OP12}
