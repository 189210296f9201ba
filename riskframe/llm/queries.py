"""One query per operator over its whole table, and DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, embedding_dedup, exact_dedup, importance, license_scan, merkle, mixing, ngram_join, packing, suffix_dedup,
               token_counts, toxicity, url_filter)
from .common import materialise, table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


@register("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op2_embedding_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have Jaccard >= 0.85."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@register("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Says the equivalence by address alone: pages here declare no canonical or refresh
#: links; components over declared links are held against planted cases in tests/llm.
OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, url, html, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
parts AS (
  SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(rest, '#.*$', '', 's') AS bare FROM cut),
keyed AS (
  SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(translate(regexp_extract(bare, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', ''), '^(www|m)\.', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?#]*(.*)$', 1, 's'),
         '([?&])(?:(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*(?:&|$))+', '\1', 'g'), '[?&]+$', ''), '/(?:index\.html?)?(\?|$)', '\1', 'g')
    END AS node FROM parts),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM keyed),
ruled AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM judged),
spread AS (SELECT node, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' ELSE 'allow' END AS v
  FROM ruled WHERE node IS NOT NULL GROUP BY node)
SELECT page_id, host, path, rule, coalesce(own, v, 'allow') AS verdict FROM ruled LEFT JOIN spread USING (node)
"""


@register("op6_url_filter", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@register("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or inherited."""
    files = license_scan.document_files(table(spark, sf_dir, "documents"))
    return license_scan.scan_licenses(files).withColumnRenamed("id", "doc_id")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, sha256(norm) AS text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


@register("op8_exact_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal without white space."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@register("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 100 bytes that occur earlier."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def _inverse(y0: str, y1: str, area: str) -> str:
    return f"(CASE WHEN {area} <= 0 THEN CAST(0 AS DOUBLE) ELSE 2 * {area} / ({y0} + sqrt(greatest({y0} * {y0} + 4 * ({y1} - {y0}) * {area}, 0))) END)"


def _training_time(lap: str) -> str:
    """DuckDB expression of the training time of a lap, by the schedule (a, b, c)."""
    need = f"(least(({lap} * source_size + start + size / 2) / goal, CAST(1 AS DOUBLE)) * ((a + 2 * b + c) / 4))"
    return (f"CASE WHEN laps > 0 THEN CASE WHEN {need} <= (a + b) / 4 THEN {_inverse('a', 'b', need)} "
            f"ELSE 0.5 + {_inverse('b', 'c', f'({need} - (a + b) / 4)')} END END")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS BIGINT) AS size,
                  md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM s),
q AS (SELECT *, CAST(CASE w WHEN 1 THEN 1.5 WHEN 2 THEN 1 ELSE 0.5 END AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b, CAST(CASE w WHEN 1 THEN 0.5 WHEN 2 THEN 1 ELSE 1.5 END AS DOUBLE) AS c FROM k),
l AS (SELECT *, source_size * CAST(3 AS DOUBLE) AS full_, source_size * CAST(3 AS DOUBLE) / w AS level FROM q),
f AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(full_) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM l),
g AS (SELECT source, source_size, a, b, c, least(full_, w * max(CASE WHEN reach <= level THEN reach END) OVER ()) AS target FROM f),
t AS (SELECT d.doc_id, d.size, a, b, c, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS goal,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS laps_full FROM t),
r AS (SELECT *, CAST(laps_full * size + greatest(0, least(size, goal - laps_full * source_size - start)) AS BIGINT) AS taken,
       CAST(laps_full + CASE WHEN start < goal - laps_full * source_size THEN 1 ELSE 0 END AS INTEGER) AS laps FROM e)
SELECT doc_id, size, source_size, target, taken, laps, {_training_time("0")} AS first_position, {_training_time("(laps - 1)")} AS last_position FROM r
"""


@register("op10_mixing", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and the training times of its first and
    last lap (null without one), range-sorted by them."""
    lap = [F.try_element_at("positions", F.lit(k)).alias(c) for k, c in ((1, "first_position"), (-1, "last_position"))]
    return (mixing.mix(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", "laps", *lap).orderBy("first_position", "last_position", "doc_id"))


#: crc: table of the CRC-32 of one byte; a string's CRC folds it over the bytes.
CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(i)))"""


def _crc32(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of text's UTF-8 bytes; crc.tab is in scope."""
    code = f"list_transform(range(len(hex(encode({text}))) // 2), lambda k: CAST('0x' || substring(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {code}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH {CRC_TABLE},
both_ AS (SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT item_id, text, false FROM benchmark),
w AS (SELECT own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM both_),
f AS (SELECT own, doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
b AS (SELECT feature, {_crc32("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f), crc),
fb AS (SELECT own, doc_id, bucket FROM f JOIN b USING (feature)),
n AS (SELECT r.range AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, CAST(sum(s) OVER () AS DOUBLE) AS big_s, CAST(coalesce(sum(t) OVER (), 0) AS DOUBLE) AS big_t
  FROM range(10000) r LEFT JOIN (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM fb GROUP BY bucket) c ON c.bucket = r.range),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (big_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (big_t + 10000)))) AS BIGINT) AS g FROM n),
weighed AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM fb JOIN gain USING (bucket) WHERE own GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substring(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score,
    coalesce(weight, 0) AS weight
  FROM w LEFT JOIN weighed USING (doc_id) WHERE own),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


@register("op11_importance_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's word n-grams."""
    return (importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_features", "weight", "score", "rank"))


def _leaf(text: str) -> str:
    said = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    return "sha256(" + " || ".join([*said, f"coalesce(strlen({text}) || ':' || {text}, '-')"]) + ")"


#: tree '' holds the subroots; sources are '=' and their name, '' for null in order.
OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS found
  FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place FROM d),
up AS (
  SELECT tree, 0 AS level, place AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS m FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 2) // 3 FROM up WHERE m > 1 GROUP BY tree, i // 3),
subroots AS (SELECT tree AS of, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS nth FROM up WHERE m = 1),
crown AS (
  SELECT 0 AS level, nth AS i, subroot AS h, count(*) OVER () AS m FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 2) // 3 FROM crown WHERE m > 1 GROUP BY i // 3),
sides AS (
  SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM up a JOIN up b ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.m > 1 GROUP BY ALL),
crown_sides AS (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM crown a JOIN crown b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.m > 1 GROUP BY ALL),
steps AS (
  SELECT v.tree, v.place, s.level, s.l, s.r FROM leaves v JOIN sides s ON s.tree = v.tree AND s.i = v.place // CAST(3 ** s.level AS BIGINT)
  UNION ALL
  SELECT v.tree, v.place, 1000 + s.level, s.l, s.r FROM leaves v JOIN subroots t ON t.of = v.tree JOIN crown_sides s ON s.i = t.nth // CAST(3 ** s.level AS BIGINT)),
paths AS (SELECT tree, place, list(l || '|' || r ORDER BY level) AS p FROM steps GROUP BY tree, place),
out AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM crown WHERE m = 1) AS root, sha256(replace(array_to_string(coalesce(p, []), ''), '|', '')) AS proof_sha256,
         list_reduce(list_prepend(found, coalesce(p, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM leaves JOIN subroots ON of = tree LEFT JOIN paths USING (tree, place))
SELECT *, folded_root = root AS verified FROM out
"""


@register("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, verified against tampered texts."""
    m = merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": merkle.without_line_breaks(F.col("doc_id"), F.col("text"))})
    again = merkle.folded(F.col("found"), F.col("left"), F.col("right"))
    return (m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"), again.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


#: Windows by the same spans; the digests from the conversations themselves.
OP13_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER o AS nth, first_value(role) OVER o = 'system' AS has, CAST(ceil((strlen(role) + strlen(text)) / 4) + 4 AS BIGINT) AS tokens,
    17 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g'))
      + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, md5(text))),
p AS (
  SELECT *, has AND nth = 1 AS head, CASE WHEN has THEN first_value(tokens) OVER o ELSE 0 END AS head_tokens,
    sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth) - CASE WHEN has THEN first_value(tokens) OVER o ELSE 0 END AS ends
  FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY nth)),
r AS (SELECT *, ends - tokens AS starts, greatest(768 - head_tokens, 2) AS room FROM p),
k AS (SELECT *, room // 2 AS stride, CASE WHEN head THEN 0 ELSE starts // (room // 2) END AS k FROM r),
s AS (SELECT *, 2 * k + CASE WHEN NOT head AND ends - k * stride > room THEN 1 ELSE 0 END AS span FROM k),
b AS (SELECT conv_id, span, min(starts) AS begins, max(ends) - min(starts) <= max(room) AS fits FROM s WHERE NOT head GROUP BY conv_id, span),
placed AS (
  SELECT conv_id, span, chars FROM s
  UNION ALL SELECT s.conv_id, b.span, chars FROM s JOIN b USING (conv_id) WHERE NOT head AND fits AND begins >= ends AND begins - starts <= 256
  UNION ALL SELECT s.conv_id, b.span, chars FROM s JOIN b USING (conv_id) WHERE head AND b.span > 0),
f AS (SELECT conv_id, CAST(sum(chars) + 3 * count(DISTINCT span) AS BIGINT) AS formatted_chars FROM placed GROUP BY conv_id),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM e GROUP BY conv_id)
SELECT * FROM t JOIN f USING (conv_id)
"""


@register("op13_chat_formatting", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in budgeted windows, read back from them."""
    return chat.read_back(materialise(chat.windows(chat.with_control_case(table(spark, sf_dir, "conversations"))), "windows"))
