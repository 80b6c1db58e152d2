"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heldout.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op10_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heldout.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op1_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heldout.llm.quality_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heldout.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text,
  md5(concat(coalesce(length(role) || ':' || role, '-'), '|', coalesce(text, ''))) AS code
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(code, ',' ORDER BY turn, role, code) || ',' AS codes,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, code) AS rendered
  FROM t GROUP BY conv_id),
f AS (SELECT codes, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY codes),
p AS (SELECT DISTINCT substr(codes, 1, 33 * k) AS codes FROM (SELECT codes, unnest(range(1, n_turns)) AS k FROM c))
SELECT c.conv_id, c.n_turns, f.n_copies, c.rendered FROM c JOIN f ON f.conv_id = c.conv_id LEFT JOIN p ON p.codes = f.codes WHERE p.codes IS NULL
"""


@query("op3_chat_formatting", _CHAT_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heldout.llm.chat import render

    return render(table(spark, sf_dir, "conversations"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Distinct 5-word shingles of a table with columns id and text.
_SHINGLES = """
SELECT DISTINCT id, list_aggregate(list_slice(w, k, k + 4), 'string_agg', ' ') AS s FROM (
  SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM (
    SELECT {id} AS id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}) WHERE len(w) > 0)
"""

_DEDUP_SQL = f"""
WITH RECURSIVE s AS ({_SHINGLES.format(id="doc_id", lower=_LOWER, table="documents")}),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
l AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.s = b.s AND a.id <> b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id
  GROUP BY a.id, b.id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT a AS id, a AS label FROM l UNION SELECT l.b, r.label FROM r JOIN l ON r.id = l.a),
m AS (SELECT id, min(label) AS label FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.label, d.doc_id) AS component_id, d.doc_id = coalesce(m.label, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN m ON m.id = d.doc_id
"""


@query("op4_near_dedup", _DEDUP_SQL)
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heldout.llm.near_dedup import link_groups

    return link_groups(table(spark, sf_dir, "documents"))


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT html, max(page_id) AS chosen FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN m.chosen <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.chosen <> p.page_id THEN m.chosen END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html
"""


@query("op5_warc", _WARC_SQL)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heldout.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


_RULES_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, k, list_slice(w, k, k + 2) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2)),
h AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
b AS (SELECT doc_id, t, w, lines, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * n_dup_lines > 3 * len(lines) OR 2 * len(regexp_extract_all(t, '[A-Z]')) > word_chars OR len(regexp_extract_all(t, '!')) > n_words
    OR 50 * len(list_distinct(w)) < n_words OR 2 * len(regexp_extract_all(t, '[0-9]')) > word_chars) AS kept FROM b
"""


@query("op6_quality_rules", _RULES_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heldout.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


_LEAKS_SQL = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", lower=_LOWER, table="documents")}),
i AS ({_SHINGLES.format(id="item_id", lower=_LOWER, table="benchmark")}),
n AS (SELECT id, count(*) AS n FROM i GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_item_shingles, count(*) AS n_shared
FROM i JOIN d ON i.s = d.s JOIN n ON n.id = i.id GROUP BY d.id, i.id, n.n HAVING count(*) >= 0.75 * n.n
"""


@query("op7_decontamination", _LEAKS_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heldout.llm.decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 of a text, byte by byte through the table of its polynomial
CRC_TABLE = """(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
SHARDING_SQL = f"""
WITH b AS (SELECT doc_id, source, coalesce(strlen(text), 0) + 8 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS bytes FROM documents),
c AS MATERIALIZED (SELECT doc_id, source, size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM b, {CRC_TABLE}),
h AS (SELECT *, ('0x' || substr(md5('1:' || doc_id || ':' || size || ':' || text_crc32), 1, 15))::BIGINT AS hash,
  (('0x' || substr(md5('1' || coalesce(':' || source, '')), 1, 15))::BIGINT % 1048576) / 1048576::DOUBLE AS shift FROM c),
p AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY hash, doc_id, text_crc32) - 1 + shift) / count(*) OVER (PARTITION BY source)::DOUBLE AS place FROM h),
r AS (SELECT *, row_number() OVER (ORDER BY place, md5(source) NULLS FIRST, source NULLS FIRST) - 1 AS spot, count(*) OVER () AS total FROM p),
s AS (SELECT *, spot * 24 // total AS shard FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
  spot - (shard * total + 23) // 24 AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""


@query("op8_sharding", SHARDING_SQL)
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heldout.llm.sharding import interleave

    return interleave(table(spark, sf_dir, "documents"))


@query("op12_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from heldout.llm.suffix_dedup import cut_repeats

    cut = cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["length"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_alignment")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heldout.llm.alignment import alignment_statistics

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment_statistics(table(spark, sf_dir, "documents"), *paths)


@query("op13_periodic_runs")
def periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from heldout.llm.periodic import periodic_runs, planted
    from heldout.llm.text import bound_batches, plain

    bound_batches(spark)
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", planted("doc_id", "text").alias("text"))
    found = periodic_runs(docs).withColumn("best", F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))"))
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.expr("-best.start").alias("start"), F.col("best.length").alias("length"),
        F.expr("-best.period").alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
