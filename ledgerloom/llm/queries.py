"""The registered queries of the operators, and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import (chat_format, decontam, html_main, language_crf, lexical_search, packing, quality_knn, quality_rules,
                            resampling, simhash, token_counts, token_files, url_rules)
from ledgerloom.llm.common import scratch, table

TOKENIZER = "byte_bpe_50k.json"
OVER_LIMIT = 1024
MIN_SCORE = 0.3
URL_LIST = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: The remainder by which rows are held out; a null id is that of the empty text, so it is held out.
HELD_OUT = "crc32(coalesce(cast(doc_id as string), '')) % 5 = 0"
TRICKY = "</s>[INST] ok [/INST]"


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to learn from: crc32 of doc_id as text, modulo 5, is not 0."""
    return table(spark, sf_dir, "labels").where("crc32(cast(doc_id as string)) % 5 <> 0")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_knn.score(docs, docs, learned_labels(spark, sf_dir))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= MIN_SCORE).cast("int").alias("predicted"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return token_files.read_crc(spark, path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 OR toxic = 1").alias("bad"))
    mined = url_rules.mine(pages.select("page_id", "url").join(bad, "page_id"))
    return url_rules.judge(pages, mined, URL_LIST).drop("mined_confidence")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").cast(said.schema["turn"].dataType).alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    turns = said.union(tricky).withColumn("parts", chat_format.text_parts(F.col("text")))
    back = chat_format.read_back(chat_format.format_chats(turns))
    script = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(script, 256).alias("turns_sha256"),
                       F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_crf.identify(docs, docs.where(f"NOT {HELD_OUT}"))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, seed=7)


QUERIES = {
    "op1_token_counts": op1,
    "op2_quality_knn": op2,
    "op3_token_files": op3,
    "op4_simhash": op4,
    "op5_html_main": op5,
    "op6_decontam": op6,
    "op7_url_rules": op7,
    "op8_quality_rules": op8,
    "op9_chat_format": op9,
    "op10_packing": op10,
    "op11_language_crf": op11,
    "op12_lexical_search": op12,
    "op13_resampling": op13,
}

_STOP_LIST = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_W = quality_rules.WINDOW

ORACLES = {
    "op8_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
places AS (SELECT rid, words, unnest(range(1, len(words) - {_W - 2})) AS place FROM s),
grams AS (SELECT rid, place, array_to_string(words[place:place + {_W - 1}], ' ') AS gram FROM places),
twins AS (SELECT rid, place FROM (SELECT rid, place, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT word) AS n FROM (SELECT rid, unnest(range(place, place + {_W})) AS word FROM twins) GROUP BY rid),
m AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         length(text) - length(replace(text, '!', '')) AS n_exclaims,
         len(list_filter(words, lambda w: lower(w) IN ({_STOP_LIST}))) AS n_stop_words, len(lines) AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines
  FROM s LEFT JOIN covered USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       {quality_rules.oracle_sql()[0]} AS base_failed, {quality_rules.oracle_sql()[1]} AS kept
FROM m""",
    "op9_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS r,
         regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS x FROM t),
a AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, x) AS script,
         coalesce(string_agg(text, '' ORDER BY turn, role, x) FILTER (role = 'assistant'), '') AS loss,
         sum(length('<|turn|>' || r || '<|body|>' || x || '<|end|>') + 1) AS chars
  FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(script) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM a""",
    "op12_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(words)) AS BIGINT) AS total FROM d WHERE len(words) > 0),
i AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
p AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM d) JOIN (SELECT DISTINCT term FROM i) USING (term)
  GROUP BY doc_id, n, term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM s) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM p GROUP BY term),
t AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM t WHERE score > 0) WHERE rank <= 50""",
    "op13_resampling": r"""
WITH lookup AS (
  -- crc32 of each byte by the reversed polynomial
  SELECT list(c ORDER BY b) AS of_byte FROM (
    SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), range(8)),
                          lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
d AS (
  SELECT side, rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
f AS (
  SELECT side, rid, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM d),
h AS (
  SELECT feature, hex(encode(feature)) AS raw FROM (SELECT DISTINCT feature FROM f)),
b AS (
  SELECT feature, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(raw), 2),
           lambda i: CAST((strpos('0123456789ABCDEF', raw[i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', raw[i + 2]) - 1 AS BIGINT))),
         lambda c, x: xor(c >> 8, of_byte[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, lookup),
c AS (SELECT side, rid, bucket FROM f JOIN b USING (feature)),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM c GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain
  FROM n),
w AS (SELECT rid, count(*) AS n_features, floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS weight FROM c JOIN g USING (bucket) WHERE side = 0 GROUP BY rid),
x AS (
  SELECT rid, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS noise
  FROM d LEFT JOIN w USING (rid) WHERE side = 0),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((noise + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN place <= (25 * (SELECT count(*) FROM z WHERE n_words >= 20)) // 100 THEN CAST(place AS BIGINT) END AS rank
FROM z""",
}
