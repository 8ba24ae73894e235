"""The training-data queries with production parameters, and the SQL of those that SQL can state."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import audit, bpe, embeddings, exact, html, licenses, lines, packing, quality, ranked, simhash, urls, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_prob")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), [*urls.SITE_RULES, *urls.WORD_RULES])
    rule = F.when(F.col("matched.rank") == 1, F.col("matched.name"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license_digest", "license", F.array_join("notices", ",").alias("notices"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedup(table(spark, sf_dir, "documents"), removed="n_removed")
    return clean.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_urls": op2_urls,
    "op3_html": op3_html,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_embeddings": op8_embeddings,
    "op9_warc": op9_warc,
    "op10_lines": op10_lines,
    "op11_audit": op11_audit,
    "op12_ranked": op12_ranked,
    "op13_exact": op13_exact,
    "pipeline": corpus_pipeline.run,
}

_SITES = ", ".join(f"('{r.name}', '{r.verdict}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}')" for r in urls.SITE_RULES)
_WORDS = "|".join(r.pattern.replace("'", "''") for r in urls.WORD_RULES)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _plain(text: str) -> str:
    text = f"regexp_replace({text}, {_quoted(licenses.BLANKS)}, ' ', 'g')"
    for pattern, kept in licenses.SPELLINGS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(kept)}, 'g')"
    return rf"trim(regexp_replace({text}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _canonical(text: str) -> str:
    return _plain(f"array_to_string(list_filter(string_split({_lower(text)}, chr(10)), lambda x: NOT regexp_matches(x, {_quoted(licenses.COPYRIGHT_LINE)})), ' ')")


_DIGESTS = ", ".join(f"({_quoted(n)}, {_quoted(d)})" for n, d in licenses.KNOWN_DIGESTS)
_KNOWN = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.KNOWN)
ORACLES: dict[str, str] = {
    "op7_licenses": f"""
        WITH raw(license, text) AS (VALUES {_KNOWN}),
        shipped(license, digest) AS (VALUES {_DIGESTS}),
        known AS (SELECT digest, min(license) AS license FROM (SELECT sha256({_canonical("text")}) AS digest, license FROM raw UNION ALL SELECT digest, license FROM shipped) GROUP BY 1),
        docs AS (SELECT doc_id, text, sha256({_canonical("text")}) AS license_digest FROM documents),
        noted AS (SELECT doc_id, string_agg(DISTINCT known.license, ',' ORDER BY known.license) AS notices
            FROM (SELECT doc_id, unnest(string_split({_lower("text")}, chr(10))) AS line FROM documents) l
            JOIN known ON known.digest = sha256({_plain("line")}) GROUP BY doc_id)
        SELECT docs.doc_id, license_digest, known.license AS license, coalesce(notices, '') AS notices
        FROM docs LEFT JOIN known ON digest = license_digest LEFT JOIN noted ON noted.doc_id = docs.doc_id""",
    "op2_urls": rf"""
        WITH sites(rule, verdict, rh, rp) AS (VALUES {_SITES}),
        cut AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
        SELECT page_id, host, path, top.rule AS rule,
               coalesce(top.verdict, CASE WHEN regexp_matches(host || path, '{_WORDS}') THEN 'block' ELSE 'allow' END) AS verdict
        FROM cut LEFT JOIN LATERAL (SELECT rule, verdict FROM sites
            WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rule) DESC LIMIT 1) top ON true""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY d)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d""",
    "op11_audit": r"""
        WITH cut AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
        failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
                'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
                'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
                'E': coalesce(cut.doc_id > first_id, false)} AS f FROM cut LEFT JOIN l ON l.doc_id = cut.doc_id),
        masks AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY 1, 2),
        letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT filter_order, s AS step, filter_order[s] AS filter, string_split(filter_order[1:s - 1], '') AS earlier FROM orders, range(1, 6) r(s)),
        hit AS (SELECT part, filter_order, step, filter, n, good, toxic, f[filter] AS fails,
                coalesce(list_bool_or(list_transform(list_filter(earlier, lambda x: x <> ''), lambda x: f[x])), false) AS gone,
                len(list_filter(map_values(f), lambda x: x)) AS n_fails FROM masks, steps),
        own AS (SELECT part, filter_order, step, filter,
                coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
                coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
                coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
            FROM hit GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM own""",
    "op12_ranked": r"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        size AS (SELECT count(DISTINCT doc_id) AS nd, count(*) AS nl FROM d),
        doc AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), size),
        scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nl)))) AS BIGINT) AS score
            FROM q JOIN tf USING (term) JOIN w USING (term) JOIN doc USING (doc_id), size GROUP BY 1, 2)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        WHERE rank <= 50""",
    "op13_exact": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
