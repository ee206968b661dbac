"""The queries op1 to op10 over ``documents``, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg, language, licenses, mixing, pieces, pii, quality, secrets, simhash, substrings
from .common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenize(documents(spark, sf_dir), ids=False)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(documents(spark, sf_dir))
    places = F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", x.getField("start"), x.getField("end"))), ",")
    return rows.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), places.alias("spans"), F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.sanitise(documents(spark, sf_dir))
    base = F.filter("places", lambda x: x.getField("kind") != "term")
    n_of = lambda kind: F.size(F.filter("places", lambda x: x.getField("kind") == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(pii.as_text(base).cast("binary"), 256)
    return rows.select(
        "doc_id", *map(n_of, pii.KINDS), digest.alias("base_sha256"), pii.as_text(F.col("places")).alias("spans"), F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256")
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(documents(spark, sf_dir), texts=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(documents(spark, sf_dir)))
    base = F.col("rule_bits").bitwiseAND(F.lit(quality.mask(quality.POLICIES["base"]))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "rule_bits")


def op9_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.store(documents(spark, sf_dir), keep_media=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# What SQL can say of operators that it cannot express whole: columns of the same results.


def columns_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 2).alias("target"))


def columns_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def columns_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def columns_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_media_jpeg(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def ablations_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(documents(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_language_id, op3_sentencepiece, op4_license_scan, op5_secret_scan, op6_personal_data, op7_substring_dedup, op8_quality_rules, op9_media_jpeg, op10_simhash, columns_mix, columns_license, columns_personal, columns_media, ablations_quality)
}

_LEDGER = (
    r"""
        WITH w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        win AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
        again AS (SELECT doc_id, a, b, c FROM win GROUP BY doc_id, a, b, c HAVING count(*) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN again USING (doc_id, a, b, c), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(words) AS n_words, coalesce(CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, length(t) AS n_chars, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_exclaim,
                len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
            FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
        r AS (SELECT *, CAST("""
    + " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality.RULES.values()))
    + """ AS BIGINT) AS rule_bits FROM m)
        """
)

_BLANKS = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_BLANKS}) AS words FROM documents),
        win AS (SELECT r, i, array_to_string(words[i:i + 34], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
        again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN again USING (g)),
        w AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
        kept AS (SELECT w.r, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE gone.p IS NULL) AS t
            FROM w LEFT JOIN gone ON gone.r = w.r AND gone.p = w.p GROUP BY w.r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r""",
    "op8_quality_rules": _LEDGER
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, rule_bits = 0 AS kept, rule_bits FROM r",
    "ablations_quality": _LEDGER
    + "SELECT rule, count(*) FILTER (WHERE rule_bits & bit <> 0) AS fails, count(*) FILTER (WHERE rule_bits = bit) AS fails_alone, count(*) FILTER (WHERE rule_bits & ~bit = 0) AS kept_without FROM r, (VALUES "
    + ", ".join(f"('{rule}', {1 << k}::BIGINT)" for k, rule in enumerate(quality.RULES))
    + ") AS each(rule, bit) GROUP BY rule",
    "columns_mix": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_BLANKS})) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        o AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM s),
        l AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS level, 1.5 * sum(source_size) OVER () AS total FROM o),
        c AS (SELECT *, (SELECT sum(least(b.cap, b.w * l.level)) FROM l b) <= total AS capped FROM l),
        t AS (SELECT *, (total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) / sum(w) FILTER (WHERE NOT capped) OVER () AS water FROM c)
        SELECT doc_id, size, source_size, CAST(round(CASE WHEN capped THEN cap ELSE w * water END, 2) AS DOUBLE) AS target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source""",
    "columns_license": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        w AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d),
        hit AS (SELECT r, i - 1 AS pos, label FROM w, (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) AS p(phrase, label)
            WHERE words[i] = phrase[1] AND words[i:i + len(phrase) - 1] = phrase),
        h AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hit GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN h USING (r)""",
    "columns_personal": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
            len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: regexp_full_match(x, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}'))) AS n_ip,
            list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS cards,
            len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone FROM d)
        SELECT doc_id, n_email, n_ip, len(list_filter(cards, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1),
            lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[i] AS INTEGER) ELSE 2 * CAST(x[i] AS INTEGER) - CASE WHEN x[i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card, n_phone FROM m""",
    "columns_media": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        p AS (SELECT *, CASE WHEN n = 0 THEN 192 ELSE (n + 191) // 192 * 192 END AS m FROM d)
        SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || repeat(' ', m - n)) AS payload_sha256 FROM p""",
}
