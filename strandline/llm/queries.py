"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import chat, embeddings, licenses, mixing, packing, pii, quality, simhash, toxicity, warc
from strandline.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""


def op4_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.lookup(table(spark, sf_dir, "documents"))


def _op7_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def canonical(text: str) -> str:
        plain = f"regexp_replace(lower({text}), {quoted(licenses.COPYRIGHT_LINE)}, ' ', 'g')"
        plain = rf"' ' || trim(regexp_replace({plain}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
        for old, new in licenses.SPELLINGS:
            plain = f"replace({plain}, ' {old} ', ' {new} ')"
        return f"trim({plain})"

    rows = ", ".join(f"({quoted(t)}, {quoted(i)})" for i, t in licenses.KNOWN)
    return rf"""
WITH known AS (SELECT sha256({canonical("k")}) AS digest, min(license) AS license FROM (VALUES {rows}) v(k, license) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
whole AS (SELECT r, doc_id, sha256({canonical("t")}) AS digest FROM docs),
parts AS (
  SELECT DISTINCT r, {canonical("part")} AS c FROM (
    SELECT r, unnest(list_concat(regexp_split_to_array(t, '
[ 	
]*
'), string_split(t, chr(10)))) AS part FROM docs
  ) WHERE regexp_matches(part, '(?i)licen[cs]e|permission|warrant|software')
),
hits AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS part_licenses, count(*) AS n_parts
  FROM parts JOIN known ON sha256(c) = known.digest WHERE len(string_split(c, ' ')) >= {licenses.LEAST_WORDS} GROUP BY r
)
SELECT doc_id, whole.digest, license, coalesce(part_licenses, '') AS part_licenses, coalesce(n_parts, 0) AS n_parts
FROM whole LEFT JOIN known ON whole.digest = known.digest LEFT JOIN hits ON hits.r = whole.r
"""


def op8_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) c ON c.x = e.vec_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = e.vec_id
"""


# What of an operator's result SQL can express, where its whole row can't be put in SQL.

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


#: Sources by how soon they reach three times their size; the first number of full ones that leaves the next one room settles the unit.
MIXING_SQL = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source),
ranked AS (SELECT *, 3.0 * source_size / weight AS full_at, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS r FROM sources),
units AS (SELECT r, full_at, ((SELECT sum(source_size) FROM sources) - coalesce(sum(3.0 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM ranked),
settled AS (SELECT coalesce((SELECT arg_min(unit, r) FROM units WHERE unit <= full_at), 1e300) AS unit)
SELECT doc_id, size, source_size, round(least(3.0 * source_size, unit * weight)::DOUBLE, 3) AS target FROM sized JOIN ranked ON sized.source IS NOT DISTINCT FROM ranked.source, settled
"""


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS held FROM d),
starts AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM starts),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM windows WHERE n > 1) GROUP BY r),
counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(held) - len(list_distinct(held)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
"""


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) > 255, true))) = 0))::BIGINT AS n_ip,
  len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda m: reverse(regexp_replace(m, '[^0-9]', '', 'g'))), lambda c: length(c) BETWEEN 14 AND 19
    AND list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN i % 2 = 1 THEN c[i]::INTEGER ELSE c[i]::INTEGER * 2 - CASE WHEN c[i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15))::BIGINT AS n_phone FROM d
"""


QUERIES = {
    "op1_pii_weak_supervision": op1_pii_weak_supervision,
    "op2_warc_assembly": op2_warc_assembly,
    "op3_simhash_neardup": op3_simhash_neardup,
    "op4_toxicity_gru": op4_toxicity_gru,
    "op5_quality_divergence": op5_quality_divergence,
    "op6_cube_mixing": op6_cube_mixing,
    "op7_license_digests": op7_license_digests,
    "op8_chat_repair": op8_chat_repair,
    "op9_packing": op9_packing,
    "op10_embedding_neardup": op10_embedding_neardup,
    "mixing_targets": mixing_targets,
    "quality_base": quality_base,
    "pii_base_counts": pii_base_counts,
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc_assembly": OP2_SQL, "op7_license_digests": _op7_sql(), "op10_embedding_neardup": OP10_SQL, "mixing_targets": MIXING_SQL, "quality_base": QUALITY_SQL, "pii_base_counts": PII_SQL,
}  # fmt: skip
