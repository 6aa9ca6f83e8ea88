"""The queries of this subpackage: thin opN_<name> functions over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm import chat, collocations, compression, extraction, jaccard, licenses, lm, mixing, packing, periodic, quality, syncmers, warc
from tallow.llm.common import stage, table


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_neighbours(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_figures(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").cast("long").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, archives = warc.write_warc(table(spark, sf_dir, "pages"))
    back = warc.read_warc(stage(archives, "warc-archives"), folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_license_sentences"), "license", F.array_join("licenses", ",").alias("license_names"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(table(spark, sf_dir, "pages"))


CHECK_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    values = ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in CHECK_CONVERSATION)
    added = spark.sql(f"SELECT * FROM VALUES {values} AS t(conv_id, turn, role, text)")
    done = chat.format_conversations(stored.unionByName(added))
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["text"]), "")
    return done.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.periodic_runs(periodic.with_period(docs)))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compression.score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_syncmer_fingerprints, op2_source_mixing, op3_quality_rules, op4_best_fit_packing, op5_lm_scoring, op6_warc_archives, op7_ngram_jaccard_join, op8_license_scan, op9_html_extraction, op10_chat_formatting, op11_periodic_runs, op12_quality_classifier, op13_phrase_collocations)}

SQL: dict[str, str] = {"op8_license_scan": licenses.scan_sql()}

SQL["op2_source_mixing"] = r"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), k AS (
  SELECT *, md5(concat_ws(':', doc_id::VARCHAR, source, size::VARCHAR)) AS key FROM keyed
), s AS (
  SELECT source, sum(size)::BIGINT AS total, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM k GROUP BY source
), c AS (
  SELECT *, 3 * total AS cap FROM s
), l AS (
  SELECT *, ((sum(total) OVER ()) - coalesce(sum(cap) OVER b, 0))::DOUBLE / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0)) AS level
  FROM c WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT level AS free FROM l WHERE cap >= level * w ORDER BY cap / w, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, total, coalesce(CASE WHEN cap < free * w THEN cap::DOUBLE ELSE free * w END, 0.0) AS target FROM l LEFT JOIN f ON true
), b AS (
  SELECT *, CASE WHEN total > 0 THEN floor(round(target)::BIGINT / total)::BIGINT ELSE 0 END AS n_full FROM t
), r AS (
  SELECT *, round(target)::BIGINT - n_full * total AS rest FROM b
), g AS (
  SELECT source, key, sum(size)::BIGINT AS words, count(*) AS n_rows FROM k GROUP BY source, key
), p AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM g
)
SELECT k.doc_id, k.size, r.total AS source_size, r.target,
  (r.n_full * k.size + CASE WHEN p.before + p.words <= r.rest THEN k.size WHEN p.before >= r.rest THEN 0
    ELSE least(floor((r.rest - p.before) / p.n_rows)::BIGINT, k.size) END)::BIGINT AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source JOIN p ON k.source IS NOT DISTINCT FROM p.source AND k.key = p.key
"""

SQL["op6_warc_archives"] = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

SQL["op10_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\e'), '<(/?s>)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g') AS x,
    regexp_replace(regexp_replace(replace(role, '\', '\e'), '<(/?s>)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g') AS y FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(x) + 7 ELSE length(y) + length(x) + 14 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL["op3_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), r AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1
), n AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id
), b AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, ls, ws,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN n USING (doc_id)
), i AS (
  SELECT doc_id, i, line, len(lw) AS n, lw, (len(lw) BETWEEN 1 AND 2 AND NOT regexp_matches(line, '[.!?;:…。！？,]'))::INT AS short FROM (
    SELECT doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM b))
), j AS (
  SELECT *, sum(short) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) = 5 AS start FROM i
), l AS (
  SELECT *, bool_or(start) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS menu FROM j
), f AS (
  SELECT *, menu OR n > 0 AND (length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) * 4 > n
    OR (n >= 3 AND (length(regexp_replace(line, '[^!]', '', 'g')) * 3 > n OR (upper(line) = line AND lower(line) <> line)))
    OR (n >= 3 AND length(regexp_replace(line, '[^|»›•→]', '', 'g')) * 4 > n)
    OR (n <= 12 AND regexp_matches(line, 'BOILERPLATE'))
    OR (n >= 8 AND NOT regexp_matches(line, '[.!?;:…。！？]'))
    OR (n >= 5 AND len(list_filter(range(1, n), lambda i: lw[i] = lw[i + 1])) * 5 > n)) AS bad FROM l
), v AS (
  SELECT doc_id, coalesce(sum(n) FILTER (WHERE bad), 0)::BIGINT AS lost, (count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0))::BIGINT AS n_dup_lines FROM f GROUP BY doc_id
), o AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, lost FROM b JOIN v USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.4 * n_words AS kept FROM o
""".replace("BOILERPLATE", quality.BOILERPLATE)

SQL["op13_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, r, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, r, unnest(pieces) AS piece, unnest(range(len(pieces))) AS p FROM (
      SELECT lang, row_number() OVER () AS r, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents))
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k))
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.lang = f.lang AND b.k > f.k AND b.f >= f.f AND contains(' ' || b.phrase || ' ', ' ' || f.phrase || ' '))
), q AS (
  SELECT lang, phrase, f AS a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM (SELECT *, string_split(phrase, ' ') AS ws FROM c))
), s AS (
  SELECT q.lang, q.phrase, a, j, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM q JOIN f l ON l.lang = q.lang AND l.phrase = x JOIN f r ON r.lang = q.lang AND r.phrase = y JOIN n ON n.lang = q.lang
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000
"""
