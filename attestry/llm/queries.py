"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.llm import (
    byte_pairs,
    decontaminate,
    exact_dedup,
    language_id,
    license_scan,
    merkle,
    pieces,
    simhash,
    spelling,
    suffix_dedup,
    token_count,
    toxicity,
    url_filter,
)
from attestry.llm.common import documents, given_table
from attestry.llm.licence_templates import TEMPLATES


def crc_of_id():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def op1_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    remainder = F.pmod(crc_of_id(), F.lit(4))
    # remainders 0, 1 and 3 are the parts of the three fits; 2 is held out
    part = F.when(remainder == 3, 2).otherwise(remainder).cast("int")
    seen = docs.filter(remainder != 2)
    labelled = toxicity.labelled_rows(seen, given_table(spark, sf_dir, "labels")).withColumn("part", part)
    scored = toxicity.fit(labelled, "part").score(docs.withColumn("held_out", remainder == 2), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir))


def op3_url_filter(spark, sf_dir):
    outcomes = url_filter.page_outcomes(given_table(spark, sf_dir, "labels"))
    return url_filter.judge(given_table(spark, sf_dir, "pages"), outcomes)


def op4_license_scan(spark, sf_dir):
    found = license_scan.scan(documents(spark, sf_dir), ["doc_id"], TEMPLATES)
    return found.select(
        "doc_id",
        F.size("licences").alias("n_matches"),
        F.array_sort(F.array_distinct("licences.licence")).alias("names"),
        "licences",
    )


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicate_components(documents(spark, sf_dir))


def op6_decontamination(spark, sf_dir):
    found = decontaminate.scan(documents(spark, sf_dir), given_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        decontaminate.contaminated().alias("contaminated"),
        F.size("overlaps").alias("n_items"),
        F.coalesce(F.array_max("overlaps.share"), F.lit(0.0)).alias("best_share"),
        "overlaps",
    )


def op7_sentencepiece(spark, sf_dir):
    vocabulary = pieces.load_vocabulary()
    spelt = pieces.encode_and_decode(documents(spark, sf_dir), ["doc_id", "text"], vocabulary)
    return spelt.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"),
        "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("held_out", F.pmod(crc_of_id(), F.lit(5)) == 0)
    model = language_id.fit(docs.filter("NOT held_out"))
    return language_id.predict(docs, model, ["doc_id", "held_out"])


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.groups_per_row(documents(spark, sf_dir))


def op10_token_counts(spark, sf_dir):
    return token_count.token_counts(documents(spark, sf_dir), ["doc_id"], pieces.load_vocabulary())


def op11_byte_pairs(spark, sf_dir):
    spelt = byte_pairs.encode_and_decode(documents(spark, sf_dir), ["doc_id"], byte_pairs.load_model())
    ids = F.coalesce(F.col("ids").cast("array<string>"), F.array().cast("array<string>"))
    return spelt.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"),
    )


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir)))


def op13_merkle_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    # a null identifier has no remainder, so its row is not tampered with
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "source", merkle.row_hash([*fields, F.col("text")]).alias("leaf"), merkle.row_hash([*fields, text]).alias("tampered"))
    proved = merkle.manifest(leaves, "doc_id", keep=["tampered"]).withColumn("folded_root", merkle.folded(F.col("tampered"), F.col("proof")))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_suffix_dedup,
        op3_url_filter,
        op4_license_scan,
        op5_simhash_near_dedup,
        op6_decontamination,
        op7_sentencepiece,
        op8_language_id,
        op9_exact_dedup,
        op10_token_counts,
        op11_byte_pairs,
        op12_spelling_variants,
        op13_merkle_manifest,
    )
}

SQL = {
    "op3_url_filter": """
        WITH parsed AS (
            SELECT page_id,
                translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
                  FROM pages)
        ),
        outcomes AS (
            SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1
                WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id
        ),
        counts AS (
            SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM parsed LEFT JOIN outcomes ON doc_id = page_id GROUP BY host
        ),
        hosts AS (
            SELECT *,
                CASE WHEN digits THEN host WHEN deep THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
                CASE WHEN digits THEN '' WHEN deep THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix
            FROM (SELECT *, regexp_full_match(host, '[0-9.:\\[\\]]+') AS digits,
                    len(parts) >= 3 AND length(parts[-1]) = 2
                    AND parts[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AS deep
                  FROM (SELECT *, string_split(host, '.') AS parts FROM counts))
        ),
        overall AS (SELECT (sum(bad) + 1.0) / (sum(n) + 2.0) AS rate, sum(n) AS labelled FROM hosts),
        s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS parent FROM hosts, overall GROUP BY suffix),
        ks AS (SELECT 1.0 / least(greatest(rho, 0.001), 0.5) - 1.0 AS k FROM (
            SELECT CASE WHEN coalesce(sum(n), 0) <= count(*) OR sum(n * parent * (1 - parent)) <= 0 THEN 0.001
                ELSE (sum(n * (bad / n - parent) * (bad / n - parent)) / sum(n * parent * (1 - parent)) - count(*) / sum(n))
                    / (1 - count(*) / sum(n)) END AS rho FROM s0 WHERE n > 0)),
        s1 AS (SELECT suffix, (bad + k * parent) / (n + k) AS rate FROM s0, ks),
        d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS parent FROM hosts JOIN s1 USING (suffix)
               GROUP BY domain, suffix),
        kd AS (SELECT 1.0 / least(greatest(rho, 0.001), 0.5) - 1.0 AS k FROM (
            SELECT CASE WHEN coalesce(sum(n), 0) <= count(*) OR sum(n * parent * (1 - parent)) <= 0 THEN 0.001
                ELSE (sum(n * (bad / n - parent) * (bad / n - parent)) / sum(n * parent * (1 - parent)) - count(*) / sum(n))
                    / (1 - count(*) / sum(n)) END AS rho FROM d0 WHERE n > 0)),
        d1 AS (SELECT domain, suffix, (bad + k * parent) / (n + k) AS parent FROM d0, kd),
        h0 AS (SELECT host, n, bad, parent FROM hosts JOIN d1 USING (domain, suffix)),
        kh AS (SELECT 1.0 / least(greatest(rho, 0.001), 0.5) - 1.0 AS k FROM (
            SELECT CASE WHEN coalesce(sum(n), 0) <= count(*) OR sum(n * parent * (1 - parent)) <= 0 THEN 0.001
                ELSE (sum(n * (bad / n - parent) * (bad / n - parent)) / sum(n * parent * (1 - parent)) - count(*) / sum(n))
                    / (1 - count(*) / sum(n)) END AS rho FROM h0 WHERE n > 0)),
        h1 AS (SELECT host, (bad + k * parent) / (n + k) AS rate, n + k AS weight FROM h0, kh),
        matched AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parsed
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN labelled > 0 AND h1.rate - 1.64 * sqrt(h1.rate * (1 - h1.rate) / (weight + 1)) > 0.3 THEN 'block'
            ELSE 'allow' END AS verdict
        FROM matched JOIN h1 USING (host), overall
    """,
    "op9_exact_dedup": """
        WITH rows AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM rows JOIN groups USING (text_sha256)
    """,
    "op12_spelling_variants": r"""
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce([i, -1, -1, -1, -1, -1, -1, -1, -1],
            lambda a, s: xor(a >> 1, (a & 1) * 3988292384))) AS step
    ),
    runs AS (
        SELECT doc_id, run, count(*) AS n FROM (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents) WHERE length(run) >= 5 GROUP BY ALL
    ),
    bytes AS (SELECT run, n, length(run) AS size, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
    hashed AS (
        SELECT run, n, size, xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
            lambda a, b: xor(a >> 8, step[xor(a & 255, b) + 1]))) AS h
        FROM bytes, crc
    ),
    words AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word FROM hashed)
        WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
    ),
    shorter AS (
        SELECT word, n, length(word) AS size, 0 AS place, word AS rest FROM words
        UNION ALL
        SELECT word, n, length(word), i, substr(word, 1, i - 1) || substr(word, i + 1)
        FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM words)
    ),
    pairs AS (
        SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.word <> b.word
            AND ((a.place = b.place AND a.place > 0) OR (a.place = 0 AND b.size = a.size + 1) OR (b.place = 0 AND a.size = b.size + 1))
    ),
    best AS (SELECT word, count(*) AS n_near, min({'rank': -near_n, 'near': near}) AS b FROM pairs GROUP BY word),
    formed AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.rank >= 2 * n THEN b.near END AS form,
            CASE WHEN -b.rank >= 2 * n THEN -b.rank END AS form_n FROM words LEFT JOIN best USING (word)
    ),
    chain AS (
        SELECT word, word AS at FROM formed
        UNION ALL
        SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
    )
    SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c USING (word)
    JOIN formed g ON g.word = c.at WHERE g.form IS NULL
    """,
    "op13_merkle_manifest": r"""
    WITH RECURSIVE told AS (
        SELECT *, CASE WHEN list_reduce(
            list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, (a & 1) * 3988292384) END) % 2 = 1
            THEN replace(text, chr(10), '') ELSE text END AS changed
        FROM documents
    ),
    leaves AS (
        SELECT doc_id, source, sha256(start || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(start || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered
        FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS start FROM told)
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM leaves
    ),
    low AS (
        SELECT source, 0 AS level, n, r AS i, leaf AS h FROM ranked
        UNION ALL
        SELECT source, level + 1, (n + 2) // 3, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY source, level, n, i // 3
    ),
    groups AS (
        SELECT source, level AS height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM low WHERE n = 1
    ),
    top AS (
        SELECT 0 AS level, n, r AS i, h FROM groups
        UNION ALL
        SELECT level + 1, (n + 2) // 3, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, n, i // 3
    ),
    steps AS (
        SELECT source, r, level, string_agg(h, '' ORDER BY i) FILTER (i < own) AS b, string_agg(h, '' ORDER BY i) FILTER (i > own) AS a
        FROM (SELECT l.source, l.r, x.level, x.i, x.h, l.r // CAST(power(3, x.level) AS BIGINT) AS own
              FROM ranked l JOIN low x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1
                  AND x.i // 3 = l.r // CAST(power(3, x.level + 1) AS BIGINT))
        GROUP BY ALL
        UNION ALL
        SELECT source, NULL, height + level, string_agg(h, '' ORDER BY i) FILTER (i < own), string_agg(h, '' ORDER BY i) FILTER (i > own)
        FROM (SELECT g.source, g.height, x.level, x.i, x.h, g.r // CAST(power(3, x.level) AS BIGINT) AS own
              FROM groups g JOIN top x ON x.n > 1 AND x.i // 3 = g.r // CAST(power(3, x.level + 1) AS BIGINT))
        GROUP BY ALL
    ),
    fold AS (
        SELECT source, r, 0 AS level, tampered AS h, '' AS passed FROM ranked
        UNION ALL
        SELECT f.source, f.r, f.level + 1, sha256(coalesce(s.b, '') || f.h || coalesce(s.a, '')), f.passed || coalesce(s.b, '') || coalesce(s.a, '')
        FROM fold f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.level = f.level AND coalesce(s.r, f.r) = f.r
    ),
    heights AS (SELECT source, height + (SELECT max(level) FROM top) AS level, h AS subroot FROM groups)
    SELECT l.doc_id, l.leaf, t.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(f.passed) AS proof_sha256, f.h AS folded_root,
        f.h = (SELECT h FROM top WHERE n = 1) AS verified
    FROM ranked l JOIN heights t ON t.source IS NOT DISTINCT FROM l.source
    JOIN fold f ON f.source IS NOT DISTINCT FROM l.source AND f.r = l.r AND f.level = t.level
    """,
}
