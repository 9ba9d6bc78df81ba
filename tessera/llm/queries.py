"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.conversation_repair import repaired_damage
from tessera.llm.decontaminate import decontaminate
from tessera.llm.html_extract import html_extract
from tessera.llm.importance import resampled
from tessera.llm.license_scan import license_scan
from tessera.llm.line_dedup import line_dedup
from tessera.llm.quality_classifier import quality_classifier
from tessera.llm.quality_rules import quality_rules
from tessera.llm.sentencepiece import encode
from tessera.llm.simhash import simhash
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.toxicity import toxicity
from tessera.llm.url_filter import url_filter

#: Fixed values: the URL rules of op5.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document's quality, learnt from the labels that aren't held out."""
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 50 bytes that one with a smaller id has."""
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words within windows of the benchmark, and its verdict."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document's toxicity by its nearest labelled examples, and their ids."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by the longest rule that its url fits."""
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and the smallest id that links of two bits or fewer reach."""
    return simhash(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases, labels and score."""
    return license_scan(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, votes and posterior, and whether it stays."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, and whether they decode to its text."""
    return encode(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_extract(table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and the ranks of the tenth that is drawn."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, and the cheapest edits that repair it."""
    return repaired_damage(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines every document loses to those that ten documents share, and the hash of what stays."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_url_filter": op5_url_filter,
        "op6_simhash": op6_simhash,
        "op7_license_scan": op7_license_scan,
        "op8_quality_rules": op8_quality_rules,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_html_extraction": op10_html_extraction,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_line_dedup": op13_line_dedup,
    }


#: A-Z lower-cased and nothing else, then words of digits, ASCII letters and characters beyond ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
cut AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
least AS (SELECT x, min(doc_id) AS first FROM cut GROUP BY 1 HAVING count(*) > 1),
hit AS MATERIALIZED (SELECT doc_id, i FROM cut JOIN least USING (x) WHERE first < doc_id),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, CASE WHEN i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hit)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS g0, a AS g1, a, b FROM spans),
kept AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * g0 + 1, 2 * (g1 - g0)), '' ORDER BY a) AS head, max(b) AS tail
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN head IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
cut AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT doc_id, s, n, item_id FROM cut JOIN win USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""


#: crc32 of a text's bytes by the usual table, which is made by its rule.
_CRC_TABLE = "SELECT list(list_reduce(range(0, 8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(0, 256) r(i)"


def _crc32(text: str) -> str:
    data = f"list_transform(range(0, octet_length(encode({text}))::BIGINT), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


OP11_SQL = rf"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS x FROM d),
bw AS MATERIALIZED (SELECT unnest({_WORDS}) AS x FROM benchmark),
bucket AS MATERIALIZED (SELECT x, {_crc32("x")} % 10000 AS b FROM (SELECT x FROM dw UNION SELECT x FROM bw), crc),
s AS (SELECT b, count(*)::DOUBLE AS s FROM dw JOIN bucket USING (x) GROUP BY 1),
t AS (SELECT b, count(*)::DOUBLE AS t FROM bw JOIN bucket USING (x) GROUP BY 1),
gain AS MATERIALIZED (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS g
  FROM s FULL JOIN t USING (b)),
weights AS (SELECT doc_id, floor(sum(g) / count(*))::BIGINT AS weight FROM dw JOIN bucket USING (x) JOIN gain USING (b) GROUP BY 1),
h AS (SELECT doc_id, len(w)::BIGINT AS n_features, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM d),
scored AS MATERIALIZED (
  SELECT doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM h LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

def _edit(letter: str, cost: str, to: str, said: str = "''") -> str:
    """An edit before the way `to`: its cost, letter and what it leaves; null where `to` is."""
    return f"CASE WHEN {to} IS NOT NULL THEN {{'c': ({to}).c + {cost}, 'a': '{letter}' || ({to}).a, 'r': {said} || ({to}).r}} END"


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _row(to: dict[str, str], q: str, after: str, role: str) -> str:
    """The best edit of a row in state q: Delete, Keep (its role leads to a state by `to`), or Rerole to the role that fits."""
    keep = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in to.items()) + " END"
    free = f"CASE WHEN NOT must THEN {keep} END", f"CASE WHEN NOT must THEN {after} END"
    return _least(_edit("D", "2", q), _edit("K", "late", free[0], "role || ':' || text || chr(10)"), _edit("R", "1 + late", free[1], f"'{role}:' || text || chr(10)"))


_PUT = {"u": lambda w: _edit("I", "5", w, "'user:' || chr(10)"), "a": lambda w: _edit("I", "5", w, "'assistant:' || chr(10)")}
_CLOSED = ", ".join(
    f"{_least(w, _PUT[x](n), _PUT[x](_PUT[y](m)))} AS {v}"
    for v, w, x, n, y, m in (("v0", "w0", "u", "w2", "a", "w3"), ("v1", "w1", "u", "w2", "a", "w3"), ("v2", "w2", "a", "w3", "u", "w2"), ("v3", "w3", "u", "w2", "a", "w3"))
)
_STATE = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"

OP12_SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, {_crc32("name")} % 20 AS n FROM named, crc),
hurt AS (
  SELECT conv_id, turn, CASE n WHEN 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE n WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE n <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    NOT regexp_matches(text, '[^ 	-]') AS blank, regexp_matches(text, '[.!?][ 	-]*$') AS closed, substr(role, 1, 1) AS kind
  FROM hurt),
f AS MATERIALIZED (
  SELECT conv_id, turn, role, text, p, kind, blank, NOT blank AND again AS dup, NOT blank AND NOT again AND NOT closed AS trunc, blank OR again AS must, CASE WHEN NOT closed THEN 5 ELSE 0 END AS late,
    coalesce(lag(kind) OVER (PARTITION BY conv_id ORDER BY p) || kind NOT IN ('su', 'ua', 'au'), false) AS bad
  FROM num),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank, count_if(dup)::BIGINT AS duplicate, count_if(trunc)::BIGINT AS truncated, count_if(bad)::BIGINT AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
ends AS (SELECT {{'c': 0::BIGINT, 'a': '', 'r': ''}}::{_STATE} AS w0, NULL::{_STATE} AS w1, NULL::{_STATE} AS w2, {{'c': 0::BIGINT, 'a': '', 'r': ''}}::{_STATE} AS w3),
way(conv_id, p, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, {_CLOSED} FROM told, ends
  UNION ALL
  SELECT conv_id, p, {_CLOSED} FROM (
    SELECT conv_id, f.p, {_row({"s": "v1", "u": "v2"}, "v0", "v2", "user")} AS w0, {_row({"u": "v2"}, "v1", "v2", "user")} AS w1, {_row({"a": "v3"}, "v2", "v3", "assistant")} AS w2, {_row({"u": "v2"}, "v3", "v2", "user")} AS w3
    FROM way JOIN f USING (conv_id) WHERE f.p = way.p - 1))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v0.c, 0) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(left(v0.r, length(v0.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN told USING (conv_id) LEFT JOIN (SELECT conv_id, v0 FROM way WHERE p = 1) USING (conv_id)
"""

OP13_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
k AS MATERIALIZED (SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
gone AS (SELECT key, true AS gone FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN gone USING (key) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op3_decontamination": OP3_SQL, "op5_url_filter": OP5_SQL, "op11_importance_resampling": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_line_dedup": OP13_SQL}
