"""The registered queries of this package and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanferry.llm import chat, chosenpath, importance, licenses, mixture, packing, rpforest, spelling, suffixes, tokentree, toxicity, warc, winnow
from spanferry.operators.ordering import positions
from spanferry.shared import scratch_path, settle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: each turn replies to the one before it (order: turn, role, text)."""
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    rows = conversations.select(tree.alias("tree_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    placed = positions(rows, ["turn", "role", "text"], ["tree_id"], name="node_id")
    return placed.select(
        "tree_id", "node_id", (F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(None).cast("double").alias("score")
    )


@_query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_conversations(conversation_messages(table))
    read = done.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", F.array_join(chat.read_masked(F.col("formatted"), F.col("mask")), "")
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    number = F.when(F.col("tree_id") != "none", F.expr("substring(tree_id, 2)")).cast("long")
    return read.select(
        number.alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped(column: str, role: bool) -> str:
    for control, code in chat._ROLE_ESCAPES if role else chat._ESCAPES:
        column = f"replace({column}, '{control}', '{code}')"
    return column


CHECKS["op1_chat_formatting"] = f"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role NULLS FIRST, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('### ' || {_escaped("coalesce(role, '')", True)} || ': ' || {_escaped("text", False)} || '</turn>' || chr(10))) AS chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  cast(chars AS BIGINT) AS formatted_chars
FROM whole"""


@_query
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = winnow.edit_likeness(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        winnow.described(F.col("fingerprint")).alias("fingerprint"),
        winnow.described(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@_query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixture.mix_sources(docs)


CHECKS["op4_mixing_sources"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(cast(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS place
  FROM documents),
sources AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source),
rounds AS (
  SELECT 0 AS n, -1 AS before, 0 AS capped, 1.5::DOUBLE * sum(source_size) AS rest, sum(weight)::DOUBLE AS weights
  FROM sources
  UNION ALL
  SELECT r.n + 1, r.capped,
    (SELECT count(*) FROM sources WHERE weight * r.rest / r.weights > 2.0::DOUBLE * source_size),
    (SELECT 1.5::DOUBLE * sum(source_size) - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (weight * r.rest / r.weights > 2.0::DOUBLE * source_size), 0) FROM sources),
    (SELECT coalesce(sum(weight) FILTER (NOT weight * r.rest / r.weights > 2.0::DOUBLE * source_size), 1)::DOUBLE FROM sources)
  FROM rounds r WHERE r.before <> r.capped AND r.n < 1000),
level AS (SELECT rest, weights FROM rounds ORDER BY n DESC LIMIT 1),
targets AS (
  SELECT source, source_size, least(weight * rest / weights, 2.0::DOUBLE * source_size) AS target FROM sources, level),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM targets),
places AS (
  SELECT d.source, d.place, any_value(b.target - b.times * b.source_size) AS budget, sum(d.size) AS words
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source GROUP BY d.source, d.place),
running AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM places),
chosen AS (
  SELECT source, place, upto <= budget OR (upto - words <= budget AND words - (budget - (upto - words)) < budget - (upto - words)) AS more
  FROM running)
SELECT d.doc_id, d.size, b.source_size, b.target, d.size * (b.times + CASE WHEN c.more THEN 1 ELSE 0 END) AS taken
FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.place = c.place"""


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@_query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rpforest.nearest(vectors, 20, F.col("vec_id") % 20 == 0)


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = toxicity.score_documents(docs, _table(spark, sf_dir, "labels"))
    return done.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    path = scratch_path(spark, "warc")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    warc.records(pages).write.format("warc").mode("append").save(path)
    number = F.substring_index("record_id", ":", -1)
    refers = F.substring_index("refers_to", ":", -1)
    full = spark.read.format("warc").load(path).where("warc_type = 'response'")
    responses = settle(
        full.select(
            F.when(number != "", number).cast("long").alias("page_id"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            warc.digest_of(F.col("payload")).alias("payload_digest"),
        )
    )
    heads = spark.read.format("warc").option("payload", "false").load(path).where("warc_type = 'revisit'")
    revisits = heads.select(
        F.when(number != "", number).cast("long").alias("page_id"), "payload_digest", refers.cast("long").alias("refers_to")
    )
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    known = revisits.join(sizes, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        responses.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
        .unionByName(known.withColumn("record_type", F.lit("revisit")).select(*columns))
    )


# SHA-1 in hexadecimal is regrouped from four bits to five a digit.
CHECKS["op8_warc"] = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM rows GROUP BY html),
bits AS (
  SELECT html, first,
    (SELECT string_agg(lpad(bin(('0x' || substr(sha1(html), i * 5 + 1, 5))::BIGINT), 20, '0'), '' ORDER BY i) FROM range(8) t(i)) AS b
  FROM firsts),
digests AS (
  SELECT html, first,
    (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(b, i * 5 + 1, 1)::INT + 8 * substr(b, i * 5 + 2, 1)::INT
      + 4 * substr(b, i * 5 + 3, 1)::INT + 2 * substr(b, i * 5 + 4, 1)::INT + substr(b, i * 5 + 5, 1)::INT), 1), '' ORDER BY i) FROM range(32) t(i)) AS d
  FROM bits)
SELECT page_id, cast(strlen(html) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM rows JOIN digests USING (html)"""


@_query
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("license_matches", lambda m: m["license"]))), ",")
    return found.select(
        "doc_id", F.size("license_matches").cast("long").alias("n_matches"), names.alias("licenses"),
        F.col("license").alias("best_license"), F.col("dice").alias("best_dice"),
    )


def _template_rows() -> str:
    rows = ((name, part) for name, parts in licenses.TEMPLATES.items() for part in parts)
    return ", ".join("('{}', '{}')".format(name, part.replace("'", "''")) for name, part in rows)


_SQL_GRAMS = (
    "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
)
_SQL_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

CHECKS["op9_license_scans"] = rf"""
WITH templates AS (
  SELECT row_number() OVER () AS t, license, {_SQL_GRAMS.format('w')} AS grams
  FROM (SELECT license, {_SQL_WORDS.format('part')} AS w FROM (VALUES {_template_rows()}) v(license, part))),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT r, unnest(string_split(text, chr(10))) AS body FROM docs
  UNION ALL SELECT r, unnest(regexp_split_to_array(text, '
\s*
')) FROM docs WHERE regexp_matches(text, '
\s*
')
  UNION ALL SELECT r, text FROM docs WHERE contains(text, chr(10))),
worded AS (SELECT row_number() OVER () AS u, r, {_SQL_WORDS.format('body')} AS w FROM units),
grams AS (SELECT u, r, {_SQL_GRAMS.format('w')} AS grams FROM worded WHERE len(w) > 1),
shared AS (
  SELECT u, t, count(*) AS n FROM (SELECT u, unnest(grams) AS g FROM grams) JOIN (SELECT t, unnest(grams) AS g FROM templates) USING (g)
  GROUP BY u, t),
matches AS (
  SELECT r, license, 2.0::DOUBLE * n / (len(g.grams) + len(p.grams)) AS dice
  FROM shared JOIN grams g USING (u) JOIN templates p USING (t)),
best AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
    first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice
  FROM matches WHERE dice >= {licenses.LEAST_DICE} GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(licenses, '') AS licenses, license AS best_license, dice AS best_dice
FROM docs LEFT JOIN best USING (r)"""


@_query
def op9_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices and full texts anywhere inside a text; :func:`op9_license_scans` compares whole units, as its SQL does."""
    found = licenses.find_notices(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("license_notices", lambda m: m["license"]))), ",")
    return found.select(
        "doc_id", F.size("license_notices").cast("long").alias("n_notices"), names.alias("licenses"),
        F.col("license").alias("best_license"), F.col("dice").alias("best_dice"),
    )


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: its first 12 code points again at a third, 10 removed at half, its last 5 replaced."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n"))
    edits = F.expr(
        """array(struct(n div 3 as at, 0L as removed, left(text, 12) as added), struct(n div 2 as at, 10L as removed, '' as added),
                 struct(cast(greatest(n - 3, 0) as bigint) as at, 5L as removed, ' edited text.' as added))"""
    )
    return tokentree.count_edited(docs.withColumn("edits", edits), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@_query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn for their likeness to the benchmark; a null text has no words."""
    done = importance.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of UTF-8 text, byte by byte through a table; ``{0}`` is the text.
_SQL_CRC_TABLE = (
    "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
)
_SQL_CRC = (
    "xor(list_reduce(list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT), "
    "lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295::BIGINT), 4294967295)"
)
_SQL_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHECKS["op11_importance_resampling"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_LOWER.format("coalesce(text, '')")} AS text FROM documents),
doc_words AS (SELECT r, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM docs),
target_words AS (SELECT unnest(regexp_extract_all({_SQL_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
counted AS (SELECT r, w, count(*) AS n FROM doc_words GROUP BY r, w),
target AS (SELECT w, count(*) AS n FROM target_words GROUP BY w),
crc AS (SELECT {_SQL_CRC_TABLE} AS t),
buckets AS (
  SELECT w, {_SQL_CRC.format('w')} % 10000 AS b FROM (SELECT w FROM counted UNION SELECT w FROM target), crc),
s AS (SELECT b, sum(n) AS s FROM counted JOIN buckets USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM target JOIN buckets USING (w) GROUP BY b),
gains AS (
  SELECT b, cast(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(coalesce(s, 0)) OVER () + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (sum(coalesce(t, 0)) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (b)),
weights AS (
  SELECT r, cast(sum(n) AS BIGINT) AS n_features, cast(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN buckets USING (w) JOIN gains USING (b) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(cast(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5)
      ::DOUBLE / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS able
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed"""


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their commonest neighbour one edit away; a null text has no words."""
    return spelling.variant_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


# Two words are one replacement apart when they agree but for one place, one insertion apart when one is the other less a letter.
CHECKS["op12_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, {_SQL_LOWER.format('w')} AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
crc AS (SELECT {_SQL_CRC_TABLE} AS t),
named AS (SELECT w, n, concat(doc_id, ':', w) AS key FROM runs),
hashed AS (SELECT w, n, {_SQL_CRC.format('key')} AS h FROM named, crc),
damaged AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, cast(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS rest FROM places),
holes AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM places),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM formed f JOIN chain c ON f.form = c.word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)"""


@_query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text that 400-byte strings found elsewhere cover; a null text is empty."""
    done = suffixes.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


# Bytes are compared as pairs of hexadecimal digits. Starts of repeats less than 400 bytes apart cover one run.
CHECKS["op13_suffix_dedup"] = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, cast(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
blocks AS (SELECT r, 400 * j AS base, substr(x, 800 * j + 1, 1598) AS b FROM (SELECT r, x, unnest(range(0, n // 400)) AS j FROM docs)),
starts AS (SELECT r, base, b, unnest(range(0, length(b) // 2 - 399)) AS i FROM blocks),
named AS (SELECT r, base + i AS p, md5_number(substr(b, 2 * i + 1, 800)) AS h FROM starts),
repeated AS (SELECT r, p FROM named WHERE h IN (SELECT h FROM named GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 400, true) AS opens FROM repeated),
numbered AS (SELECT r, p, sum(opens::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM marked),
spans AS (SELECT r, k, min(p) AS a, max(p) + 400 AS b FROM numbered GROUP BY r, k),
edges AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM spans),
removed AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM spans GROUP BY r),
kept AS (
  SELECT e.r, string_agg(substr(d.x, 2 * e.before + 1, 2 * (e.a - e.before)), '' ORDER BY e.a) AS x FROM edges e JOIN docs d USING (r) GROUP BY e.r)
SELECT d.doc_id, d.n AS n_bytes, cast(coalesce(m.n_removed, 0) AS BIGINT) AS n_removed, cast(coalesce(m.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.x, '') || substr(d.x, 2 * coalesce(m.last, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN removed m USING (r) LEFT JOIN kept k USING (r)"""
