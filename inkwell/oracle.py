"""SQL twins of the queries, for DuckDB."""

from __future__ import annotations

from inkwell.functions import rewriting, routing, text
from inkwell.operators import governance, parsing
from inkwell.queries import COMPRESS_QUERY, FIRST_WORDS, SAMPLE_JSON, SAMPLE_LATEX, SAMPLE_MARKDOWN, SAMPLE_QUERIES, _lit, _values

_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_TURNS = f"turns AS (SELECT conv_id, turn, text AS query FROM conversations UNION ALL SELECT -1, n, q FROM (VALUES {_values(SAMPLE_QUERIES)}) AS v(n, q))"
_WORDS = r"[\p{L}\p{M}\p{N}\p{Pc}]+"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _spaced(x: str) -> str:
    return rf"regexp_replace({x}, '{_SPACE}+', ' ', 'g')"


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_CONTROL_DEL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_CLEAN = _strip(rf"regexp_replace(regexp_replace({_strip(_spaced(f"regexp_replace(query, '{_CONTROL_DEL}', '', 'g')"))}, '^[.\-,;:!?]+', ''), '[.\-,;:!?]+$', '')")
_SEARCHED = _strip(_spaced(f"regexp_replace({_strip(f"regexp_replace(query, '{_CONTROL}', '', 'g')")}, '{_CONTROL_DEL}', '', 'g')"))


def _list(values: object) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _hits(words: tuple[str, ...]) -> str:
    return f"CAST(len(list_filter({_list(words)}, lambda k: contains(lower(query), k))) AS INTEGER)"


def _redacted(x: str) -> str:
    for _, pattern, to in governance.PII_PATTERNS:
        x = f"regexp_replace({x}, {_lit(pattern)}, '{to}', 'g')"
    return x


_STOP = "list_filter(string_split(" + _spaced(_strip("{q}")) + f", ' '), lambda t: t <> '' AND NOT list_contains({_list(sorted(rewriting.STOP_WORDS))}, regexp_replace(lower(t), '^[.,;:!?]+|[.,;:!?]+$', '', 'g')))"


def _core(q: str) -> str:
    words = _STOP.replace("{q}", q)
    return f"CASE WHEN len({words}) = 0 THEN {q} ELSE array_to_string({words}, ' ') END"


def _source(rows: str, samples: tuple[str, ...]) -> str:
    """A table src (n, x) of rows and samples, the latter as rows -1, -2, ..."""
    return f"src AS ({rows} UNION ALL SELECT -1 - i, v FROM (VALUES {_values(samples)}) AS w(i, v))"


_SOURCES = {
    "latex": _source("SELECT doc_id AS n, text AS x FROM documents", SAMPLE_LATEX),
    "markdown": _source("SELECT page_id AS n, html AS x FROM pages", SAMPLE_MARKDOWN),
    "json": _source("SELECT CAST(0 AS BIGINT) AS n, '' AS x WHERE false", SAMPLE_JSON),
}


def _cleaned(x: str) -> str:
    for pattern, to in ((r"\\(label|ref|cite|begin|end)\{[^}]*\}", ""), (r"\\[a-zA-Z]+\{([^}]*)\}", r"\1"), (r"\\[a-zA-Z]+", ""), ("[{}]", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return _strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _stack(at: str) -> str:
    """Titles that are open at heading `at`, of the lists ls of levels and ts of titles: those without one of their level or above after them."""
    return f"[ts[j] FOR j IN range(1, {at} + 1) IF j = {at} OR ls[j] < list_min(ls[j + 1:{at}])]"


_KINDS = "MAP {" + ", ".join(f"{_lit(k)}: {_lit(v)}" for k, v in parsing.SECTION_KINDS.items()) + "}"
_SYNONYMS = "MAP {" + ", ".join(f"{_lit(k)}: {_list(v)}" for k, v in rewriting.SYNONYMS.items()) + "}"
_LICENSE = "[" + ", ".join(
    "{'hits': " + " + ".join(f"CAST(contains(low, {_lit(p)}) AS INTEGER)" for p in phrases) + f", 'first': {-i}, 'name': '{name}'}}" for i, (name, phrases) in enumerate(governance.LICENSE_PHRASES)
) + "]"
_SENTENCES = rf"list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+'), lambda s: {_strip('s')}), lambda s: s <> '')"


def _folded(parts: str, whole: str, joiner: str) -> str:
    """The greedy fold over an array of parts: at most 2000 characters, an overlap of 50."""
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, text, {parts} AS parts FROM documents WHERE text IS NOT NULL), f AS (
            SELECT doc_id, parts, 1 AS i, '' AS cur, CAST([] AS VARCHAR[]) AS done FROM d WHERE NOT ({whole})
            UNION ALL
            SELECT doc_id, parts, i + 1,
                CASE WHEN cur <> '' AND length(cur) + length(parts[i]) > 2000 THEN right(cur, 50) || {joiner} || parts[i]
                    WHEN cur <> '' THEN cur || {joiner} || parts[i] ELSE parts[i] END,
                CASE WHEN cur <> '' AND length(cur) + length(parts[i]) > 2000 THEN list_append(done, cur) ELSE done END
            FROM f WHERE i <= len(parts)
        ), c AS (
            SELECT doc_id, CASE WHEN {_strip('cur')} <> '' THEN list_append(done, cur) ELSE done END AS chunks, true AS cut FROM f WHERE i > len(parts)
            UNION ALL SELECT doc_id, [text], false FROM d WHERE {whole}
        ), e AS (SELECT doc_id, cut, len(chunks) AS n, unnest(range(0, len(chunks))) AS i, unnest(chunks) AS chunk FROM c)
        SELECT doc_id, i AS chunk_index, n AS total_chunks, CASE WHEN cut THEN {_strip('chunk')} ELSE chunk END AS content, sha256(chunk) AS doc_hash FROM e
    """


_TF = """
    qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{w}')) AS term FROM benchmark),
    dt AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{w}')) AS term FROM documents),
    qf AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY query_id, term),
    df AS (SELECT id, term, count(*) AS tf FROM dt GROUP BY id, term)
""".replace("{w}", _WORDS)
_SPARSE = _TF + ", sp AS (SELECT query_id, id, round(sum(ln(1 + qtf) * ln(1 + tf)), 9) AS score FROM qf JOIN df USING (term) GROUP BY query_id, id), sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sp)"
_BM25 = """,
    dl AS (SELECT doc_id AS id, len(regexp_extract_all(lower(coalesce(text, '')), '{w}')) AS length FROM documents),
    st AS (SELECT count(*) AS n, avg(length) AS average FROM dl),
    iw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM df, st GROUP BY term, n),
    iv AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM iw) ELSE raw END AS idf FROM iw),
    bs AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), 9) AS score
        FROM qf JOIN df USING (term) JOIN iv USING (term) JOIN dl USING (id), st GROUP BY query_id, id),
    br AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs) AS q WHERE score > 0)
""".replace("{w}", _WORDS)


def _short(tables: str) -> str:
    """The same with the first words of each query alone."""
    return tables.replace("FROM benchmark)", f"FROM (SELECT item_id, regexp_extract(text, '{FIRST_WORDS}') AS text FROM benchmark) AS b)")


_COVER = rf"""CASE WHEN len(list_distinct(regexp_extract_all(lower(query), '{_WORDS}'))) = 0 THEN 0 ELSE
    len(list_intersect(list_distinct(regexp_extract_all(lower(query), '{_WORDS}')), list_distinct(regexp_extract_all(lower(content), '{_WORDS}')))) / len(list_distinct(regexp_extract_all(lower(query), '{_WORDS}'))) END"""


def _compressed(query: str, content: str) -> str:
    """Tables cs (key, sentences), best (key, chosen): `key` identifies a row of the table `given`."""
    return rf"""
        cs AS (SELECT key, {content} AS content, {_SENTENCES.replace('(text,', f'({content},')} AS s, list_distinct(regexp_extract_all(lower({query}), '{_WORDS}')) AS terms FROM given),
        one AS (SELECT key, s, terms, unnest(range(1, len(s) + 1)) AS i FROM cs),
        rel AS (SELECT key, i, s[i] AS sentence, len(list_filter(terms, lambda t: contains(lower(s[i]), t))) / len(terms) AS r FROM one),
        top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r DESC, i) AS nth FROM rel),
        kept AS (SELECT key, string_agg(sentence, ' ' ORDER BY i) AS chosen FROM top WHERE nth <= 20 AND r >= 0.3 GROUP BY key),
        packed AS (SELECT cs.key, CASE WHEN len(s) <= 3 OR coalesce(content, '') = '' THEN content WHEN chosen IS NULL THEN array_to_string(s[1:3], ' ') ELSE chosen END AS compressed
            FROM cs LEFT JOIN kept ON cs.key = kept.key)
    """


_JUDGED = f"""
    WITH {_TF} {_BM25}, run AS (SELECT query_id, id, rank FROM br WHERE rank <= 20),
    rel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark JOIN labels ON quality = 1 AND doc_id BETWEEN item_id AND item_id + 7),
    nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
    hits AS (SELECT run.query_id, run.rank FROM run JOIN rel ON run.query_id = rel.query_id AND run.id = rel.id),
    each AS (SELECT b.item_id AS query_id, coalesce(max(n), 0) AS n, coalesce(1 / min(rank), 0) AS rr, CASE WHEN min(rank) IS NULL THEN 0.0 ELSE 1.0 END AS hit,
        {", ".join(f"coalesce(sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END), 0) AS dcg_{k}, count(CASE WHEN rank <= {k} THEN 1 END) AS found_{k}" for k in (5, 10, 20))}
        FROM benchmark AS b LEFT JOIN nr ON nr.query_id = b.item_id LEFT JOIN hits ON hits.query_id = b.item_id GROUP BY b.item_id),
    m AS (SELECT query_id, CAST(rr AS DOUBLE) AS rr, CAST(hit AS DOUBLE) AS hit,
        {", ".join(f"CASE WHEN n = 0 THEN 0.0 ELSE dcg_{k} / list_sum([1 / log2(i + 1) FOR i IN range(1, CAST(least(n, {k}) AS BIGINT) + 1)]) END AS ndcg_{k}, CASE WHEN n = 0 THEN 0.0 ELSE found_{k} / n END AS recall_{k}, found_{k} / {k} AS precision_{k}" for k in (5, 10, 20))}
        FROM each)
"""
_MEASURES = ["rr", "hit", *(f"{m}_{k}" for k in (5, 10, 20) for m in ("ndcg", "recall", "precision"))]

_DENSE = """
    WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT q.id AS query_id, d.id, list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v))) AS x FROM e AS q JOIN e AS d ON q.id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS n FROM s)
    SELECT query_id, id, round(x, 6) AS score FROM r WHERE n <= 30
"""

ORACLE_SQL = {
    "token_counts": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') AS t FROM documents) AS q",
    "content_ids": """
        WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS doc_hash, sha256(coalesce(text, '') || '|' || coalesce(source, '') || '|text') AS chunk_hash FROM documents),
        s AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_hash)) AS u FROM h)
        SELECT doc_id, doc_hash, chunk_hash, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' ||
            printf('%02x', (CAST('0x' || substr(u, 17, 2) AS INTEGER) & 63) | 128) || substr(u, 19, 2) || '-' || substr(u, 21, 12) AS point_id FROM s
    """,
    "query_checks": f"""
        WITH {_TURNS}
        SELECT conv_id, turn, CASE WHEN query IS NULL OR {_strip('query')} = '' THEN 'empty' WHEN length(query) > {text.MAX_QUERY_LENGTH} THEN 'too_long' END AS error, {_SEARCHED} AS searched, {_CLEAN} AS cleaned FROM turns
    """,
    "injection_flags": f"""
        WITH {_TURNS}, every AS (SELECT * FROM turns UNION ALL SELECT -2, doc_id, text FROM documents),
        h AS (SELECT conv_id, turn, list_filter([{", ".join(f"CASE WHEN regexp_matches(coalesce(query, ''), {_lit(p)}, 'i') THEN {_lit(p)} END" for p in text.INJECTION_PATTERNS)}], lambda x: x IS NOT NULL) AS hits FROM every)
        SELECT conv_id, turn, CAST(len(hits) AS BIGINT) AS n_hits, coalesce(array_to_string(hits, ' ; '), '') AS patterns FROM h
    """,
    "query_routes": f"""
        WITH {_TURNS}, a AS (
            SELECT *, len(regexp_extract_all(query, '[一-鿿]')) AS zh, len(regexp_extract_all(query, '[a-zA-Z]')) AS en, length({_strip('query')}) AS n, {_hits(routing.CODE_KEYWORDS)} AS code, {_hits(routing.PAPER_KEYWORDS)} AS paper FROM turns
        ), b AS (
            SELECT *, CASE WHEN zh > en THEN 'zh' WHEN en > zh THEN 'en' ELSE 'mixed' END AS lang, CASE WHEN n <= 10 THEN 'short' WHEN n <= 50 THEN 'medium' ELSE 'long' END AS size,
                CASE WHEN code > paper AND code >= 2 THEN 'code' WHEN paper > code AND paper >= 2 THEN 'paper' ELSE 'general' END AS kind FROM a
        ), c AS (
            SELECT *, CASE kind WHEN 'code' THEN 0.4e0 WHEN 'paper' THEN 0.65e0 ELSE 0.6e0 END AS d0, CASE kind WHEN 'code' THEN 0.6e0 WHEN 'paper' THEN 0.35e0 ELSE 0.4e0 END AS s0 FROM b
        ), e AS (
            SELECT *, CASE size WHEN 'short' THEN greatest(d0 - 0.1e0, 0.3e0) WHEN 'long' THEN least(d0 + 0.1e0, 0.7e0) ELSE d0 END AS d1,
                CASE size WHEN 'short' THEN least(s0 + 0.1e0, 0.6e0) WHEN 'long' THEN greatest(s0 - 0.1e0, 0.2e0) ELSE s0 END AS s1 FROM c
        ), g AS (SELECT *, CASE WHEN lang = 'zh' THEN least(s1 + 0.05e0, 0.6e0) ELSE s1 END AS s2 FROM e)
        SELECT conv_id, turn, lang, size, kind, round(d1 / (d1 + s2), 6) AS dense, round(s2 / (d1 + s2), 6) AS sparse, 0.0e0 AS bm25, CASE WHEN kind <> 'general' THEN kind END AS doc_type FROM g
    """,
    "query_expansions": f"""
        WITH {_TURNS}, c AS (SELECT conv_id, turn, query, {_CLEAN} AS q FROM turns),
        t AS (SELECT *, list_filter(list_transform(regexp_extract_all(lower(q), '{_WORDS}|[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]'), lambda x: {_SYNONYMS}[x]), lambda x: x IS NOT NULL) AS found FROM c),
        f AS (SELECT *, list_filter(flatten(found), lambda s: NOT contains(lower(q), lower(s))) AS syn FROM t),
        u AS (SELECT conv_id, turn, query, q, list_transform(list_filter(list_zip(syn, range(1, len(syn) + 1)), lambda z: list_position(syn, z[1]) = z[2]), lambda z: q || ' ' || z[1]) AS longer FROM f),
        v AS (SELECT *, ([q] || longer)[1:4] AS forms, {_core('q')} AS core FROM u),
        w AS (SELECT conv_id, turn, CASE WHEN q = '' THEN [query] WHEN list_contains(forms, core) THEN forms ELSE (forms || [core])[1:4] END AS forms FROM v)
        SELECT conv_id, turn, unnest(range(0, len(forms))) AS pos, unnest(forms) AS form FROM w
    """,
    "stop_words": f"WITH {_TURNS} SELECT conv_id, turn, {_core('query')} AS core FROM turns",
    "turn_overlap": r"""
        WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[^\s\x0B\x1C-\x1F\x85\p{Z}]+')) AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
        p AS (SELECT conv_id, turn, a, list_distinct(regexp_extract_all(lower(before), '[^\s\x0B\x1C-\x1F\x85\p{Z}]+')) AS b FROM t WHERE before IS NOT NULL)
        SELECT conv_id, turn, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS overlap FROM p
    """,
    "pii_redacted": f"SELECT doc_id, {_redacted('text')} AS redacted FROM documents",
    "pii_counts": "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), {_lit(p)})) AS BIGINT) AS {n}" for n, p, _ in governance.PII_PATTERNS) + " FROM documents",
    "licenses": f"""
        WITH s AS (SELECT doc_id, list_max({_LICENSE}) AS best FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) AS q)
        SELECT doc_id, CASE WHEN best.hits >= 2 OR (best.hits = 1 AND best.name IN ('MIT', 'ISC', 'Unlicense')) THEN best.name END AS license FROM s
    """,
    "sentences": f"SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents) AS q",
    "structure_chunks": _folded(f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')", "length(text) <= 2000", "chr(10)"),
    "length_chunks": _folded(_SENTENCES, f"len({_SENTENCES}) <= 1", "' '"),
    "semantic_breaks": """
        WITH v AS (SELECT vec_id // 10 AS doc, vec_id, CAST(embedding AS DOUBLE[]) AS a, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS b FROM embeddings),
        s AS (SELECT doc, vec_id, list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))) AS x FROM v WHERE b IS NOT NULL)
        SELECT doc, vec_id, round(x, 6) AS similarity, x < 0.2 AS is_break FROM s
    """,
    "latex_text": f"WITH {_SOURCES['latex']} SELECT n, {_cleaned('x')} AS cleaned FROM src",
    "latex_sections": rf"""
        WITH {_SOURCES['latex']}, b AS (
            SELECT n, coalesce(x, '') AS x, CASE WHEN contains(x, '\begin{{document}}') THEN regexp_extract(x, '(?s)\\begin\{{document\}}(.*?)(?:\\end\{{document\}}|\z)', 1) ELSE coalesce(x, '') END AS body FROM src
        ), m AS (
            SELECT *, string_split(regexp_replace(body, '\\(section|subsection|subsubsection|paragraph|subparagraph)\{{([^}}]+)\}}', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1)) AS parts FROM b
        ), p AS (SELECT n, i, parts[i] AS part FROM (SELECT n, parts, unnest(range(2, len(parts) + 1)) AS i FROM m) AS q),
        s AS (
            SELECT n, i, list_position(['section', 'subsection', 'subsubsection', 'paragraph', 'subparagraph'], string_split(part, chr(2))[1]) AS level,
                {_strip("string_split(string_split(part, chr(2))[2], chr(3))[1]")} AS title, {_cleaned("string_split(part, chr(3))[2]")} AS content FROM p
        ), a AS (SELECT n, list(level ORDER BY i) AS ls, list(title ORDER BY i) AS ts FROM s GROUP BY n),
        every AS (
            SELECT n, -2 AS i, '标题' AS name, 0 AS level, '标题' AS path, '标题' AS kind, {_strip(r"regexp_extract(x, '\\title\{([^}]+)\}', 1)")} AS content FROM m WHERE regexp_matches(x, '\\title\{{[^}}]+\}}')
            UNION ALL SELECT n, -1, '摘要', 0, '摘要', '摘要', {_strip(r"regexp_extract(x, '(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}', 1)")} FROM m WHERE regexp_matches(x, '(?s)\\begin\{{abstract\}}(.*?)\\end\{{abstract\}}')
            UNION ALL SELECT n, 0, 'body', 0, 'body', '', {_cleaned("body")} FROM m WHERE len(parts) = 1 AND {_cleaned("body")} <> ''
            UNION ALL SELECT s.n, s.i, s.title, s.level, array_to_string({_stack("s.i - 1")}, ' > '), coalesce({_KINDS}[{_strip("lower(s.title)")}], ''), s.content FROM s JOIN a ON s.n = a.n
        )
        SELECT n, row_number() OVER (PARTITION BY n ORDER BY i) - 1 AS doc_seq, name AS section_name, CAST(level AS BIGINT) AS section_level, path AS section_path, kind AS section_type, content FROM every
    """,
    "markdown_sections": rf"""
        WITH {_SOURCES['markdown']}, m AS (
            SELECT n, string_split(regexp_replace(coalesce(x, ''), '(?m)^(#{{1,6}})\s+(.+)$', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1)) AS parts FROM src
        ), p AS (SELECT n, i, parts[i] AS part FROM (SELECT n, parts, unnest(range(1, len(parts) + 1)) AS i FROM m) AS q),
        s AS (
            SELECT n, i, CASE WHEN i = 1 THEN 0 ELSE length(string_split(part, chr(2))[1]) END AS level, {_strip("string_split(string_split(part, chr(2))[2], chr(3))[1]")} AS title,
                {_strip("CASE WHEN i = 1 THEN part ELSE string_split(part, chr(3))[2] END")} AS content FROM p
        ), a AS (SELECT n, list(level ORDER BY i) AS ls, list(title ORDER BY i) AS ts FROM s WHERE i > 1 GROUP BY n)
        SELECT s.n, row_number() OVER (PARTITION BY s.n ORDER BY s.i) - 1 AS doc_seq, level AS heading_level, CASE WHEN s.i = 1 THEN '' ELSE array_to_string({_stack("s.i - 1")}, ' > ') END AS section_path, content,
            (starts_with(content, '```') AND ends_with(content, '```')) OR coalesce(list_sum(list_transform(regexp_extract_all(content, '(?s)```.*?```'), lambda f: length(f))), 0) > 0.8e0 * length(content) AS is_code_block
        FROM s LEFT JOIN a ON s.n = a.n WHERE content <> ''
    """,
    "llm_items": f"""
        WITH {_SOURCES['json']}, d AS (SELECT n, CASE WHEN json_valid(x) THEN CAST(x AS JSON) END AS j FROM src),
        l AS (
            SELECT n, j IS NULL AS bad, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j, '$.chunks') = 'ARRAY' THEN json_extract(j, '$.chunks[*]')
                WHEN json_type(j, '$.documents') = 'ARRAY' THEN json_extract(j, '$.documents[*]') WHEN j IS NOT NULL THEN [j] ELSE [NULL] END AS items FROM d
        ), e AS (SELECT n, bad, unnest(range(0, len(items))) AS doc_seq, unnest(items) AS i FROM l)
        SELECT n, doc_seq, i ->> 'content' AS content, i ->> 'source' AS source, coalesce(i ->> 'chunk_type', 'text') AS chunk_type, coalesce(i ->> 'doc_hash', '') AS doc_hash,
            CASE WHEN bad THEN 'json' WHEN (i ->> 'content') IS NULL THEN 'item' END AS error FROM e
        UNION ALL SELECT doc_id, 0, text, source, coalesce(lang, 'text'), '', CASE WHEN text IS NULL THEN 'item' END FROM documents
    """,
    "pii_findings": "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) "
    + " UNION ALL ".join(
        f"""SELECT doc_id, '{name}' AS type, value, CAST(place AS INTEGER) AS start, CAST(place + length(value) AS INTEGER) AS "end" FROM (
            SELECT doc_id, unnest(m) AS value, unnest([list_sum([length(y) FOR y IN parts[1:k]]) + coalesce(list_sum([length(y) FOR y IN m[1:k - 1]]), 0) FOR k IN range(1, len(m) + 1)]) AS place
            FROM (SELECT doc_id, regexp_extract_all(text, {_lit(p)}) AS m, string_split_regex(text, {_lit(p)}) AS parts FROM d) AS q) AS r"""
        for name, p, _ in governance.PII_PATTERNS
    ),
    "metadata_redacted": f"SELECT doc_id, 'text' AS field, {_redacted('text')} AS value FROM documents UNION ALL SELECT doc_id, 'source', {_redacted('source')} FROM documents",
    "nested_redacted": f"""
        SELECT doc_id, {_redacted('text')} AS text, CAST(doc_id AS VARCHAR) AS number, {_redacted('source')} AS source, {_redacted('text')} AS tag, text AS untouched, {_redacted('lang')} AS lang, {_redacted('text')} AS part
        FROM documents
    """,
    "copyrights": f"""
        WITH s AS (SELECT doc_id, lang, string_split(text, '.')[1] AS source FROM documents), b AS (SELECT *, list_max({_LICENSE}) AS best FROM (SELECT *, lower(coalesce(source, '')) AS low FROM s) AS q)
        SELECT doc_id, source AS copyright_source, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN best.hits >= 2 OR (best.hits = 1 AND best.name IN ('MIT', 'ISC', 'Unlicense')) THEN best.name END) AS copyright_license FROM b
    """,
    "semantic_chunks": f"""
        WITH RECURSIVE d AS (SELECT doc_id, text, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL),
        v AS (SELECT *, list_transform(s, lambda x: [CAST(length(x) - length(replace(x, c, '')) AS DOUBLE) FOR c IN ['a', 'e', 'o']]) AS vs FROM d WHERE len(s) > 1),
        n AS (SELECT *, list_transform(vs, lambda x: sqrt(list_sum([y * y FOR y IN x]))) AS ns FROM v),
        c AS (SELECT doc_id, s, [i = len(s) OR CASE WHEN ns[i] = 0 OR ns[i + 1] = 0 THEN 0 ELSE (vs[i][1] * vs[i + 1][1] + vs[i][2] * vs[i + 1][2] + vs[i][3] * vs[i + 1][3]) / (ns[i] * ns[i + 1]) END < 0.9e0 FOR i IN range(1, len(s) + 1)] AS ends FROM n),
        f AS (
            SELECT doc_id, s, ends, 1 AS i, '' AS cur, CAST([] AS VARCHAR[]) AS done FROM c
            UNION ALL
            SELECT doc_id, s, ends, i + 1, CASE WHEN flush THEN '' ELSE own END, CASE WHEN flush THEN list_append(done, own) ELSE done END
            FROM (SELECT *, ends[i] AND (length(own) >= 100 OR i = len(s)) AS flush FROM (SELECT *, CASE WHEN cur = '' THEN s[i] ELSE cur || ' ' || s[i] END AS own FROM f WHERE i <= len(s)) AS q) AS r
        ), e AS (
            SELECT doc_id, unnest(range(0, len(done))) AS i, len(done) AS n, unnest(done) AS content FROM f WHERE i > len(s)
            UNION ALL SELECT doc_id, 0, 1, text FROM d WHERE len(s) <= 1
        )
        SELECT doc_id, i AS chunk_index, n AS total_chunks, content, sha256(content) AS doc_hash FROM e
    """,
    "oversize_parts": f"""
        WITH RECURSIVE f AS (
            SELECT doc_id, 0 AS i, text AS rest, CAST(NULL AS VARCHAR) AS part FROM documents WHERE text IS NOT NULL
            UNION ALL
            SELECT doc_id, i + 1, substr(rest, place + 2), substr(rest, 1, place + 1) FROM (
                SELECT doc_id, i, rest, CASE WHEN contains(head, '。') THEN length(regexp_extract(head, '(?s)^(.*)。', 1)) WHEN contains(head, ' ') THEN length(regexp_extract(head, '(?s)^(.*) ', 1)) ELSE 300 END AS place
                FROM (SELECT doc_id, i, rest, left(rest, 300) AS head FROM f WHERE length(rest) > 300) AS q) AS r
        ), e AS (
            SELECT doc_id, i, {_strip('part')} AS content, {_strip('part')} AS hashed FROM f WHERE part IS NOT NULL
            UNION ALL SELECT doc_id, i + 1, {_strip('rest')}, rest FROM f WHERE length(rest) <= 300 AND {_strip('rest')} <> ''
        )
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, content, sha256(hashed) AS doc_hash FROM e
    """,
    "valid_chunks": "SELECT doc_id, source FROM documents WHERE text <> '' AND source <> 'web'",
    "previews": "SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS preview FROM documents",
    "version_stamps": "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS version FROM events",
    "batch_sizes": """
        WITH u AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount * 10 END AS used FROM lineitem)
        SELECT l_orderkey, l_linenumber, CAST(least(l_linenumber * 3, CASE WHEN used IS NULL THEN 4 WHEN used > 0.85e0 THEN 2 WHEN used > 0.7e0 THEN 4 WHEN used > 0.5e0 THEN 8 ELSE 12 END) AS BIGINT) AS rows FROM u
    """,
    "path_order": """
        WITH p AS (SELECT page_id, url, string_split(url, '/') AS parts FROM pages),
        r AS (SELECT parts[3] AS site, row_number() OVER (PARTITION BY parts[3] ORDER BY parts, page_id) AS nth, page_id, url FROM p)
        SELECT site, nth, page_id, url, starts_with(url, 'https://m.example.net/') AS inside FROM r WHERE nth <= 20
    """,
    "sanitized_queries": f"""
        WITH {_TURNS}, h AS (
            SELECT conv_id, turn, {" OR ".join(f"regexp_matches(coalesce(query, ''), {_lit(p)}, 'i')" for p in text.INJECTION_PATTERNS)} AS steers,
                CASE WHEN query IS NULL OR {_strip('query')} = '' THEN 'empty' WHEN length(query) > {text.MAX_QUERY_LENGTH} THEN 'too_long' END AS wrong, {_SEARCHED} AS searched FROM turns
        )
        SELECT conv_id, turn, CASE WHEN NOT steers AND wrong IS NULL THEN searched END AS query, CASE WHEN steers THEN 'injection' ELSE wrong END AS error FROM h
    """,
    "dense_topk": _DENSE,
    "indexed_dense": _DENSE,
    "indexed_recall": "WITH q AS (SELECT count(*) AS queries FROM embeddings WHERE vec_id % 100 = 0) SELECT queries, queries * 10 AS wanted, true AS reached FROM q",
    "dense_topk_filtered": """
        WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        s AS (SELECT q.id AS query_id, d.id, list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v))) AS x FROM e AS q JOIN e AS d ON q.id % 100 = 0 AND d.label = 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) AS n FROM s)
        SELECT query_id, id, round(x, 6) AS score FROM r WHERE n <= 10
    """,
    "cosine_pairs": """
        WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
        SELECT a.id, b.id AS other_id, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 5) AS similarity FROM e AS a JOIN e AS b ON b.id = a.id + 7
    """,
    "sparse_topk": f"WITH {_SPARSE} SELECT query_id, id, round(score, 6) AS score FROM sr WHERE rank <= 20",
    "code_units": """
        WITH d AS (
            SELECT doc_id, CAST(doc_id AS VARCHAR) AS i, array_to_string(list_slice(regexp_extract_all(coalesce(text, ''), '[a-z]+'), 1, 5), ' ') AS w FROM documents
        ), u(doc_id, i, doc_seq, type, name, class_name, line, end_line, signature, docstring, content, chunk_type) AS (
            SELECT doc_id, i, 0, 'module_docstring', '', '', 1, 1, NULL, 'Notes ' || i || ': ' || w, 'Notes ' || i || ': ' || w, 'ast_docstring' FROM d
            UNION ALL SELECT doc_id, i, 1, 'function', 'read_' || i, '', 5, 7, 'def read_' || i || '(path, limit=10)', 'Reads ' || w,
                'def read_' || i || '(path, limit=10):' || chr(10) || '    \"\"\"Reads ' || w || '\"\"\"' || chr(10) || '    return path', 'ast_function' FROM d
            UNION ALL SELECT doc_id, i, 2, 'class', 'Doc' || i, 'Doc' || i, 9, 16, NULL, 'Holds ' || w, 'class Doc' || i || '(Base):' || chr(10) || 'Holds ' || w, 'ast_class' FROM d
            UNION ALL SELECT doc_id, i, 3, 'method', 'text', 'Doc' || i, 13, 14, 'def text(self)', '', '    def text(self):' || chr(10) || '        return self.size', 'ast_function' FROM d
            UNION ALL SELECT doc_id, i, 4, 'method', 'later', 'Doc' || i, 16, 16, '', '', '    async def later(self): return ' || i, 'ast_function' FROM d
        )
        SELECT doc_id, CAST(doc_seq AS BIGINT) AS doc_seq, type, name, class_name, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line, signature, docstring, content,
            'os.path parts.p' || i || '.item' AS imports, chunk_type, CAST(NULL AS VARCHAR) AS error
        FROM u
    """,
    "stored_bm25": f"WITH {_short(_TF)} {_BM25} SELECT query_id, id, round(score, 6) AS score FROM br WHERE rank <= 20",
    "stored_sparse": f"WITH {_short(_SPARSE)} SELECT query_id, id, round(score, 6) AS score FROM sr WHERE rank <= 20",
    "bm25_topk": f"WITH {_TF} {_BM25} SELECT query_id, id, round(score, 6) AS score FROM br WHERE rank <= 20",
    "score_threshold": f"WITH {_TF} {_BM25} SELECT query_id, id, round(score, 6) AS score FROM br WHERE rank <= 20 AND score >= 40",
    "fused_store": f"""
        WITH {_SPARSE} {_BM25}, u AS (SELECT query_id, id, 1 / (1 + rank) AS part FROM sr WHERE rank <= 30 UNION ALL SELECT query_id, id, 1 / (1 + rank) FROM br WHERE rank <= 30),
        f AS (SELECT query_id, id, sum(part) AS score FROM u GROUP BY query_id, id)
        SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM f) AS q WHERE n <= 10
    """,
    "fused_weighted": f"""
        WITH {_SPARSE} {_BM25}, u AS (SELECT query_id, id, 1 / (60 + rank) AS part FROM sr WHERE rank <= 20 UNION ALL SELECT query_id, id, 0.5e0 / (60 + rank) FROM br WHERE rank <= 20),
        f AS (SELECT query_id, id, sum(part) AS score FROM u GROUP BY query_id, id)
        SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM f) AS q WHERE n <= 20
    """,
    "hybrid_search": f"""
        WITH {_SPARSE} {_BM25},
        fs AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY 1 / (1 + rank) DESC, id) AS rank FROM sr WHERE rank <= 30),
        u AS (SELECT query_id, id, (0.6e0 + 0.5e0) / (60 + rank) AS part FROM fs WHERE rank <= 10 UNION ALL SELECT query_id, id, 0.4e0 / (60 + rank) FROM br WHERE rank <= 10),
        f AS (SELECT query_id, id, sum(part) AS score FROM u GROUP BY query_id, id),
        g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) AS q WHERE rank <= 10),
        x AS (SELECT g.*, b.text AS query, d.text AS content, g.query_id * 1000000 + g.id AS key FROM g JOIN benchmark AS b ON b.item_id = query_id JOIN documents AS d ON d.doc_id = id),
        y AS (SELECT *, {_COVER} AS rs FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rank, id) AS rr FROM y),
        given AS (SELECT * FROM z WHERE rr <= 5), {_compressed('query', 'content')}
        SELECT query_id, id, round(score, 6) AS score, round(rs, 6) AS rerank_score, rr AS rerank_rank, CAST(length(compressed) AS BIGINT) AS n_compressed FROM given JOIN packed ON given.key = packed.key
    """,
    "compressed": f"WITH given AS (SELECT doc_id AS key, text AS content, {_lit(COMPRESS_QUERY)} AS query FROM documents), {_compressed('query', 'content')} SELECT key AS doc_id, compressed FROM packed",
    "reranked": f"""
        WITH {_TF} {_BM25}, x AS (SELECT br.*, b.text AS query, d.text AS content FROM br JOIN benchmark AS b ON b.item_id = query_id JOIN documents AS d ON d.doc_id = id WHERE rank <= 20),
        y AS (SELECT *, {_COVER} AS rs FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rank, id) AS rr FROM y)
        SELECT query_id, id, round(rs, 6) AS rerank_score, rr AS rerank_rank FROM z WHERE rr <= 5
    """,
    "incremental": """
        WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS chunk_hash FROM documents), seen AS (SELECT DISTINCT chunk_hash FROM h JOIN labels USING (doc_id))
        SELECT chunk_hash, min(doc_id) AS doc_id, count(*) AS copies FROM h WHERE chunk_hash NOT IN (SELECT chunk_hash FROM seen) GROUP BY chunk_hash
    """,
    "upserted": """
        WITH n AS (SELECT CAST(c_nationkey AS BIGINT) AS id, c_custkey, c_acctbal AS balance, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS nth FROM customer WHERE c_acctbal > 0)
        SELECT id, c_custkey, balance FROM n WHERE nth = 1
        UNION ALL SELECT CAST(n_nationkey AS BIGINT), -1, 0.0e0 FROM nation WHERE n_nationkey NOT IN (SELECT id FROM n)
    """,
    "deleted": "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "stored_changes": """
        WITH l AS (SELECT l_orderkey AS id, sum(CAST(l_extendedprice AS DOUBLE)) AS price, bool_or(l_returnflag = 'R') AS back FROM lineitem GROUP BY l_orderkey)
        SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderstatus = 'O' AND l.id IS NOT NULL THEN 'summed' ELSE o_orderstatus END AS status,
            round(CASE WHEN o_orderstatus = 'O' AND l.id IS NOT NULL THEN l.price ELSE CAST(o_totalprice AS DOUBLE) END, 2) AS price
        FROM orders LEFT JOIN l ON l.id = o_orderkey WHERE coalesce(NOT back, true)
    """,
    "eval_by_query": _JUDGED + "SELECT query_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES) + " FROM m",
    "eval_metrics": _JUDGED
    + " UNION ALL ".join(
        f"SELECT '{'mrr' if m == 'rr' else 'hit_rate' if m == 'hit' else m.split('_')[0]}' AS metric, CAST({m.split('_')[1] if '_' in m else 0} AS BIGINT) AS k, round(avg({m}), 6) AS value FROM m" for m in _MEASURES
    )
    + " UNION ALL SELECT 'num_queries', 0, CAST(count(*) AS DOUBLE) FROM m",
    "latency": """
        SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
            round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS count FROM events GROUP BY event_type
    """,
}
_ROUTES = ORACLE_SQL["query_routes"]
ORACLE_SQL["route_weights"] = f"SELECT conv_id, turn, unnest(['dense', 'sparse', 'bm25']) AS branch, unnest([dense, sparse, bm25]) AS weight FROM ({_ROUTES}) AS q"
