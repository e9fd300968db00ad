"""One query an operator, over whole tables, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, linededup, lm, mixing, ngramjoin, pii, quality, runs, simhash, tokencounts, urlfilter
from .common import SPACE_RE, keep, scratch, table


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
CONTROL_TURN = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(more)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all documents: inserted with their words as a first count, revised to tokens, deleted and inserted again; each
    batch is sent twice. The totals are those of the tokens."""
    docs = table(spark, sf_dir, "documents").withColumn("words", mixing.n_words(F.col("text")))
    counted = keep(tokencounts.with_token_counts(docs, carry=("source", "lang", "words")), "token-counts")

    def change(op: str, tokens: str, old: str = "null") -> DataFrame:
        return counted.selectExpr(f"'{op}' as op", "source", "lang", "tokenizer", f"{tokens} as tokens", f"cast({old} as bigint) as old_tokens")

    batches = {"load": change("insert", "words"), "recount": change("revise", "tokens", "words"), "reload": change("delete", "tokens").union(change("insert", "tokens"))}
    ledger = scratch(spark, "token-ledger")
    for name, rows in batches.items():
        for _ in range(2):
            tokencounts.commit_batch(tokencounts.signed(rows), ledger, name)
    return tokencounts.totals(spark, ledger)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality.quality_verdicts(table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_bitmaps(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Documents whose crc32 ends in 0 are made periodic from some word on, as the contract says: h, g, words w, first word a, period p.
_PERIODIC = f"""
SELECT doc_id, CASE WHEN crc32(CAST(doc_id AS STRING)) % 10 = 0 THEN
 transform(array(named_struct('g', crc32(CAST(doc_id AS STRING)) div 10, 'w', filter(split(coalesce(text, ''), '{SPACE_RE}'), x -> x <> ''))), s -> CASE WHEN size(s.w) = 0 THEN '' ELSE
 transform(array(named_struct('w', s.w, 'a', CAST(s.g % size(s.w) AS INT), 'p', CAST(1 + (size(s.w) - s.g % size(s.w)) div (3 + s.g % 8) AS INT))), r ->
  array_join(transform(r.w, (x, i) -> CASE WHEN i < r.a THEN x ELSE r.w[r.a + (i - r.a) % r.p] END), ' '))[0] END)[0]
 ELSE text END AS text FROM {{docs}}"""


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the texts that the contract of op13 asks for."""
    return docs.sparkSession.sql(_PERIODIC.replace("\\", "\\\\"), docs=docs.select("doc_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(made_periodic(table(spark, sf_dir, "documents")), texts=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_chat, op2_decontamination, op3_pii, op4_url_filter, op5_token_counts, op6_simhash, op7_mixing, op8_quality, op9_line_dedup, op10_lm_score, op11_divergence, op12_ngram_join, op13_periodic_runs)}

ORACLE_SQL = {
    # Lengths: 12 and 10 characters of turn marks and two line breaks a turn, and one escape for each control string.
    "op1_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|<SYS>>|</SYS>>|s>|/s>|INST\]|/INST\])'))) AS BIGINT) AS formatted_chars FROM c GROUP BY 1""",
    "op4_url_filter": r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rh, rp, v)),
f AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS i FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, f.rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN f ON f.page_id = h.page_id AND f.i = 1""",
    # The words of each document and item, as in the contract; windows are joined by text.
    "op2_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS win FROM iw WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT d.doc_id, d.i, d.k, win.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM dwin) d JOIN win ON win.win = d.win AND win.k = d.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
r AS (SELECT k.doc_id, k.i, k.line, o.key IS NOT NULL AND k.doc_id <> o.top AS gone FROM k LEFT JOIN often o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM r GROUP BY 1""",
    # Integers of 128 bits; every group gives every kept term.
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM grp g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
s AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
l AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS v FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) f ON f.lang = a.lang AND f.s1 = a.source AND f.s2 = b.source),
own AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, (p - q) * (p - q) // (p + q) AS value FROM s JOIN l ON l.lang = s.lang AND l.term = s.term WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
