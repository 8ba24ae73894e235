"""The test corpus in DuckDB SQL: the same rules as ``from_testdata``, as named parts of a WITH clause."""

from __future__ import annotations

from quire.sources.corpus import TAGS

_STRIP = "trim({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def cid(kind: int, source: str, index: str) -> str:
    return f"CAST(((CAST({source} AS BIGINT) * 4 + {kind}) * 100000 + {index} + 1) AS BIGINT)"


def _pieces(source: str, key: str, extra: str = "") -> str:
    """Chunks of ``text`` in a query: (key, extra, chunk_index, text)."""
    whole = _STRIP.format(x="coalesce(text, '')")
    piece = _STRIP.format(x="substring(whole, CAST(i * 700 + 1 AS BIGINT), 800)")
    return f"""SELECT {key}{extra}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS INTEGER) AS chunk_index, piece AS text
        FROM (SELECT {key}{extra}, i, {piece} AS piece FROM (SELECT *, {whole} AS whole FROM ({source}) s0) s1,
              unnest(range(0, CAST(greatest(0, ceil((length(whole) - 800) / 700.0)) AS BIGINT) + 1)) AS r(i)) s2 WHERE piece <> ''"""


def _value_rows() -> str:
    out = []
    for tag, _, _, kind, pattern in TAGS:
        if not kind:
            continue
        rx = pattern.replace("?P<value>", "").replace("'", "''")
        raw = f"nullif(regexp_extract(text, '{rx}', 1), '')"
        value = f"CASE WHEN regexp_matches(regexp_replace({raw}, '[$,%\\s]', '', 'g'), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN regexp_replace({raw}, '[$,%\\s]', '', 'g') END" if kind == "number" else raw
        out.append(f"""SELECT document_id, CAST({tag} AS BIGINT) AS tag_id, min(value) AS value, arg_min(chunk_id, chunk_index) AS chunk_id
            FROM (SELECT source_id AS document_id, chunk_id, chunk_index, {value} AS value FROM c_chunks WHERE source_kind = 'document') v
            WHERE value IS NOT NULL GROUP BY document_id HAVING min(value) = max(value)""")
    return " UNION ALL ".join(out)


_TAG_ROWS = ", ".join(f"({i}, '{n}', {f"'{t}'" if t else 'NULL'})" for i, n, _, t, _ in TAGS)

#: Name: (names it needs, SQL).
PARTS: dict[str, tuple[list[str], str]] = {
    "c_documents": (
        [],
        """SELECT doc_id AS document_id, sha256(text) AS file_hash,
           source || '__' || CASE WHEN doc_id % 41 = 0 THEN '2024-13-40' WHEN doc_id % 7 = 0 THEN 'nodate'
             ELSE strftime(DATE '2019-01-01' + CAST(doc_id % 2000 AS INTEGER), '%Y-%m-%d') END || '__' || lang || '_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.txt' AS file_name,
           CAST(ceil(n_chars / 3000.0) AS INTEGER) AS page_count, n_chars // 4 AS token_count,
           CASE WHEN doc_id % 50 IN (1, 2, 3) THEN doc_id - doc_id % 50 END AS parent_document_id FROM documents""",
    ),
    "c_summaries": (
        [],
        """SELECT doc_id + 1 AS summary_id, doc_id AS document_id, CASE WHEN toxic = 1 THEN '' ELSE substring(text, 1, 60) END AS title,
           CASE WHEN toxic = 1 THEN '' ELSE substring(text, 1, 200) END AS description, CASE WHEN toxic = 1 THEN '' ELSE substring(text, 1, 400) END AS text,
           CASE WHEN toxic = 1 THEN 'backfill' ELSE 'test' END AS model,
           CASE WHEN doc_id % 5 <> 0 THEN strftime(DATE '2015-01-01' + CAST(doc_id * 13 % 3650 AS INTEGER), '%Y-%m-%d') END AS authored_date
           FROM labels JOIN documents USING (doc_id)""",
    ),
    "c_findings": (
        [],
        f"""SELECT conv_id * 1000 + turn AS finding_id, conv_id AS session_id, substring(text, 1, 40) AS title, text,
           text || ' [^chunk:' || {cid(0, "(conv_id * 31 + turn) % 600", "0")} || '] [^finding:' || ((conv_id + 1) * 1000 + turn) || '] [^url:https://example.org/' || conv_id || ']'
             || CASE WHEN conv_id % 10 = 0 THEN ' [3] [^document:9] [^ftp:x]' ELSE '' END AS body
           FROM conversations WHERE role = 'assistant'""",
    ),
    "c_sessions": ([], "SELECT DISTINCT conv_id AS session_id, 'run-' || conv_id AS name, conv_id % 3 <> 0 AS memory_enabled FROM conversations"),
    "c_images": ([], "SELECT item_id AS image_id, true AS captioned FROM benchmark UNION ALL SELECT item_id + 1000000, false FROM benchmark WHERE item_id % 6 = 5"),
    "c_own_links": ([], "SELECT doc_id AS document_id, doc_id % (SELECT count(*) FROM benchmark) AS image_id, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 9 + 1 AS INTEGER) END AS page_number FROM documents WHERE doc_id % 10 = 3"),
    "c_links": (["c_own_links"], "SELECT * FROM c_own_links UNION ALL SELECT document_id, image_id + 1000000, page_number FROM c_own_links WHERE image_id % 6 = 5"),
    "c_pieces": ([], _pieces("SELECT * FROM documents", "doc_id", ", lang")),
    "c_finding_pieces": (["c_findings"], _pieces("SELECT finding_id, text FROM c_findings", "finding_id")),
    "c_chunks": (
        ["c_pieces", "c_summaries", "c_finding_pieces"],
        f"""SELECT {cid(0, "doc_id", "chunk_index")} AS chunk_id, 'document' AS source_kind, doc_id AS source_id, chunk_index, text,
             CASE WHEN chunk_index % 4 = 0 THEN 'Appendix ' || (chunk_index // 4) END AS section_heading, CAST(chunk_index // 4 + 1 AS INTEGER) AS page_number,
             CASE lang WHEN 'fr' THEN 'ocr' WHEN 'de' THEN 'text' WHEN 'es' THEN 'sec_text' END AS content_type FROM c_pieces
           UNION ALL SELECT {cid(1, "summary_id", "0")}, 'summary', summary_id, 0, text, NULL, NULL, NULL FROM c_summaries WHERE model <> 'backfill'
           UNION ALL SELECT {cid(2, "item_id", "0")}, 'image', item_id, 0, text, NULL, NULL, CASE WHEN item_id % 2 = 0 THEN 'image_ocr' ELSE 'image_description' END FROM benchmark
           UNION ALL SELECT {cid(3, "finding_id", "chunk_index")}, 'finding', finding_id, chunk_index, text, NULL, NULL, NULL FROM c_finding_pieces""",
    ),
    "c_embeddings": ([], f"SELECT {cid(0, 'vec_id', '0')} AS chunk_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"),
    "c_tags": ([], f"SELECT * FROM (VALUES {_TAG_ROWS}) t(tag_id, name, value_type)"),
    "c_document_tags": (
        ["c_chunks"],
        f"""SELECT doc_id AS document_id, CAST(1 AS BIGINT) AS tag_id, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS chunk_id FROM labels WHERE quality = 1
           UNION ALL SELECT doc_id, 2, NULL, NULL FROM labels WHERE toxic = 1
           UNION ALL SELECT doc_id, CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 4 WHEN 'de' THEN 5 ELSE 6 END, NULL, NULL FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')
           UNION ALL {_value_rows()}""",
    ),
    "c_edges": (
        ["c_findings"],
        r"""SELECT finding_id, position - 1 AS position, CAST(target AS BIGINT) AS chunk_id FROM (SELECT finding_id, unnest(ids) AS target, generate_subscripts(ids, 1) AS position FROM (
             SELECT finding_id, list_distinct_ordered AS ids FROM (SELECT finding_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS list_distinct_ordered FROM (
               SELECT finding_id, regexp_extract_all(body, '\[\^chunk:(\d+)\]', 1) AS x FROM c_findings) a) b) c) d""",
    ),
    "c_links_out": (["c_findings"], r"SELECT finding_id, CAST(unnest(list_distinct(regexp_extract_all(body, '\[\^finding:(\d+)\]', 1))) AS BIGINT) AS linked_id FROM c_findings"),
    "c_citations": (["c_edges", "c_chunks"], "SELECT finding_id, chunk_id FROM c_edges WHERE chunk_id IN (SELECT chunk_id FROM c_chunks)"),
    "c_logs": ([], "SELECT event_id AS audit_log_id, user_id AS session_id, event_type AS tool_name, CAST(trunc(value * 10) AS BIGINT) AS duration_ms FROM events"),
    "c_failed": ([], "SELECT CAST(user_id AS VARCHAR) AS file_hash, ['parse', 'caption', 'summary'][event_id % 3 + 1] AS stage, CAST(count(*) AS INTEGER) AS attempts, max(props) AS error, max(ts) AS last_attempt FROM events WHERE event_type = 'error' GROUP BY 1, 2"),
    "c_tokens": (
        ["c_chunks"],
        r"""SELECT *, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}]+') AS tok, coalesce(regexp_extract_all(strip_accents(lower(section_heading)), '[\p{L}\p{N}\p{Co}]+'), []) AS head FROM c_chunks""",
    ),
    "b_runs": (
        [],
        """SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'ollama' ELSE 'openai' END AS provider, event_type AS model, 'd' || (user_id % 5) AS doc,
           CASE WHEN event_id % 13 = 0 THEN 'docling' ELSE 'pdfplumber' END AS extraction, NOT (event_type = 'error' AND event_id % 10 = 0) AS ok, value / 100 + 1 AS wall_seconds,
           event_id % 3 * 100000000 AS load_duration_ns, 200 + event_id % 400 AS prompt_eval_count, 's' || (event_id % 4) AS summary_sha, CASE WHEN user_id % 20 = 0 THEN 'p1' ELSE 'p0' END AS prompt_sha, ts, event_id FROM events""",
    ),
    "b_judgments": (["b_runs"], "SELECT provider, model, doc, extraction, 'openai/j1' AS judge, summary_sha, least(1 + (event_id % 17) / 4.0, 5.0) AS mean FROM b_runs WHERE event_id % 3 = 0"),
    "b_cells": (
        ["b_runs", "b_judgments"],
        """SELECT provider, model, doc, extraction, sum(mean * runs) / sum(runs) AS quality, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(passes) AS BIGINT) AS passes FROM
           (SELECT provider, model, doc, extraction, summary_sha, count(*) AS runs FROM b_runs WHERE ok GROUP BY ALL) r
           JOIN (SELECT provider, model, doc, extraction, summary_sha, avg(mean) AS mean, count(*) AS passes FROM b_judgments GROUP BY ALL) j USING (provider, model, doc, extraction, summary_sha) GROUP BY ALL""",
    ),
    "b_tps": (
        ["b_runs"],
        """SELECT provider, model, avg(tps) AS input_tps FROM (SELECT provider, model, doc, median(prompt_eval_count / (wall_seconds - load_duration_ns / 1e9)) AS tps
           FROM b_runs WHERE ok AND wall_seconds - load_duration_ns / 1e9 > 0 GROUP BY ALL) GROUP BY ALL""",
    ),
    "b_board": (
        ["b_cells", "b_tps"],
        """SELECT provider, model, CASE WHEN NOT disqualified THEN quality END AS quality, CASE WHEN NOT disqualified THEN input_tps END AS input_tps, schema_pct, disqualified FROM
           (SELECT provider, model, avg(CAST(ok AS INTEGER)) * 100 AS schema_pct, avg(CAST(ok AS INTEGER)) * 100 < 98 OR count_if(ok) = 0 AS disqualified FROM b_runs GROUP BY ALL) g
           LEFT JOIN (SELECT provider, model, avg(quality) AS quality FROM b_cells GROUP BY ALL) q USING (provider, model) LEFT JOIN b_tps USING (provider, model)""",
    ),
}


def statement(body: str, *names: str) -> str:
    """``body`` with the parts it names, and those they need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in PARTS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + body if order else body


def holds(phrase: str, tokens: str = "tok") -> str:
    return f"contains(' ' || array_to_string({tokens}, ' ') || ' ', ' {phrase} ')"
