"""DuckDB SQL for the registered queries, put together from shared CTEs."""

from __future__ import annotations

import re

from pairlight import vocab

SPACE = r"[\x09-\x0d\x1c-\x20\x85\pZ]"
WORD = r"[\pL\pN_]"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squish(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+\z', '', 'g')"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def meaningful(x: str) -> str:
    return f"(lower({strip(x)}) NOT IN {in_list(vocab.PLACEHOLDERS)})"


def windows(text: str, size: int, overlap: int) -> tuple[str, str]:
    """(number of windows, text of window i) of a squished, non-blank text."""
    step = size - overlap
    words = f"string_split({text}, ' ')"
    n = f"(CASE WHEN len({words}) <= {size} THEN 1 ELSE 1 + ceil((len({words}) - {size}) / {step}.0)::BIGINT END)"
    return n, f"array_to_string({words}[i * {step} + 1 : i * {step} + {size}], ' ')"


def hash_vec(x: str, dim: int = 16) -> str:
    parts = [f"(('0x' || substr(h, {(i % 32) * 2 + 1}, 2))::INT - 127.5) / 127.5" for i in range(dim)]
    return f"(SELECT [{', '.join(parts)}] FROM (SELECT sha256({x}) AS h))"


def dist(a: str, b: str, dim: int) -> str:
    return "round(" + " + ".join(
        f"({a}[{i}]::DOUBLE - {b}[{i}]::DOUBLE) * ({a}[{i}]::DOUBLE - {b}[{i}]::DOUBLE)" for i in range(1, dim + 1)
    ) + ", 6)"


SECTION_VALUES = ", ".join(
    f"({i}, {quote(k)}, {quote(c)}, {quote(n)})" for i, (k, (c, n)) in enumerate(vocab.SECTIONS.items())
)
CHUNK_N, CHUNK_TEXT = windows("text", vocab.CHUNK_WORDS, vocab.CHUNK_OVERLAP)
BAD_NAME = f"""CASE WHEN {strip('name')} = '' THEN {quote(vocab.NAME_EMPTY)}
  WHEN length({strip('name')}) > 200 THEN {quote(vocab.NAME_TOO_LONG % 200)}
  WHEN NOT regexp_full_match({strip('name')}, '([A-Za-z0-9\\-.,()/''%]|{SPACE})+') THEN {quote(vocab.NAME_BAD_CHARS)} END"""

CTES = {
    "bwords": "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark",
    "terms": """SELECT *, row_number() OVER (PARTITION BY drug_id ORDER BY n DESC, term) AS ord FROM (
        SELECT word AS term, count(*) AS n, ('0x' || substr(md5(word), 1, 4))::INT % 20 AS drug_id
        FROM bwords WHERE length(word) >= 7 GROUP BY word)""",
    "drugs": """SELECT o.drug_id, (o.drug_id + 1000)::VARCHAR AS rxcui, t.term AS normalized_name, t.term AS generic_name,
        upper(t.term[1]) || t.term[2:] AS input_name
        FROM (SELECT DISTINCT substr(source, 4)::BIGINT AS drug_id FROM documents) o
        LEFT JOIN terms t ON t.drug_id = o.drug_id AND t.ord = 1""",
    "synonyms": """SELECT drug_id, term AS synonym, CASE WHEN ord % 2 = 0 THEN 'brand' ELSE 'synonym' END AS synonym_type, ord
        FROM terms WHERE ord > 1""",
    "classes": """SELECT c.word AS class_term, c.ord, lower(d.normalized_name) AS member FROM (
        SELECT DISTINCT word, ('0x' || substr(md5(word), 1, 12))::BIGINT AS ord FROM bwords WHERE length(word) = 6) c
        JOIN drugs d ON d.drug_id % 5 = c.ord % 5 WHERE d.normalized_name IS NOT NULL""",
    "keys": f"SELECT * FROM (VALUES {SECTION_VALUES}) AS t(k, section_key, section_code, section_name)",
    "rawsections": f"""SELECT d.doc_id AS label_id, d.doc_id * 7 + k AS section_id, k, section_key, section_code, section_name, lang,
        {squish("array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: (i - 1) % 7 = k), ' ')")} AS raw
        FROM documents d, keys""",
    "sections": f"""SELECT label_id, section_id, section_key, section_code, section_name, lang,
        CASE WHEN {meaningful('raw')} THEN raw ELSE '' END AS text, {meaningful('raw')} AS found FROM rawsections""",
    "labeldocs": """SELECT doc_id AS label_id, 'set-' || doc_id AS setid,
        CASE WHEN lang <> 'es' THEN n_chars::VARCHAR END AS spl_version, 'label ' || doc_id AS title,
        lang AS manufacturer, NULL::VARCHAR AS published_date, 'label?setid=set-' || doc_id AS source_url,
        'set-' || doc_id || '.xml' AS api_url FROM documents""",
    "links": """SELECT doc_id AS link_id, substr(source, 4)::BIGINT AS drug_id, doc_id AS label_id,
        CASE WHEN n_chars > 100 THEN 'interaction_evidence_found' ELSE 'label_found_no_interaction_section' END AS evidence_status,
        1 AS candidates_checked, 1 AS total_candidates_found FROM documents""",
    "usable": """SELECT l.link_id, s.section_id AS db_record_id, d.normalized_name AS drug_name, d.rxcui,
        b.setid AS label_setid, b.spl_version, b.manufacturer, s.section_key, s.section_name, s.section_code,
        b.source_url, b.api_url, l.evidence_status, s.text, s.lang
        FROM sections s JOIN labeldocs b USING (label_id) JOIN links l USING (label_id) JOIN drugs d USING (drug_id)
        WHERE s.found""",
    "chunks": f"""SELECT 'link-' || link_id || '-section-' || db_record_id || '-chunk-' || i AS chunk_id,
        {CHUNK_TEXT} AS text, * EXCLUDE (text, i, n, lang), i AS chunk_index, n AS total_chunks
        FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, {CHUNK_N} AS n FROM usable))""",
    "vectors": f"SELECT chunk_id, rxcui, {hash_vec('text')} AS v FROM chunks",
    "regimens": """SELECT l.l_orderkey AS regimen_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
          l_returnflag, l_linestatus) AS pos,
        CASE WHEN l_quantity >= 50 THEN '<' || d.normalized_name || '>'
          WHEN l_quantity < 2 THEN 'unlisted-' || l_linenumber
          WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN d.rxcui
          WHEN l_returnflag = 'R' THEN d.input_name
          WHEN l_returnflag = 'A' THEN '  ' || upper(coalesce(t.term, d.normalized_name)) || ' '
          ELSE d.normalized_name END AS name
        FROM lineitem l JOIN drugs d ON d.drug_id = l.l_partkey % 20
        LEFT JOIN terms t ON t.drug_id = d.drug_id AND t.ord = 2""",
    "checkednames": f"SELECT *, {strip('name')} AS clean, lower({strip('name')}) AS lkey, {BAD_NAME} AS problem FROM regimens",
    "regsize": "SELECT regimen_id, count(*) AS n_names FROM regimens GROUP BY 1",
    "dupes": """SELECT regimen_id, string_agg(clean, ', ' ORDER BY clean) AS again FROM (
        SELECT DISTINCT regimen_id, clean FROM (
          SELECT *, row_number() OVER (PARTITION BY regimen_id, lkey ORDER BY pos) AS r FROM checkednames) WHERE r > 1)
        GROUP BY 1""",
    "regcheck": """SELECT s.regimen_id, s.n_names,
        CASE WHEN n_names < 2 THEN 'At least two drug names are required.'
          WHEN n_names > 10 THEN 'Too many drugs: ' || n_names || ' given, maximum is 10.'
          WHEN p.problem IS NOT NULL THEN p.problem
          WHEN d.again IS NOT NULL THEN 'Duplicate drug name(s) in request: ' || d.again || '.' END AS reason
        FROM regsize s
        LEFT JOIN (SELECT regimen_id, arg_min(problem, pos) AS problem FROM checkednames WHERE problem IS NOT NULL GROUP BY 1) p
          USING (regimen_id)
        LEFT JOIN dupes d USING (regimen_id)""",
    "regpairs": """SELECT regimen_id, row_number() OVER (PARTITION BY regimen_id ORDER BY apos, bpos) AS pair_no, drug_a, drug_b
        FROM (SELECT a.regimen_id, a.pos AS apos, b.pos AS bpos, a.clean AS drug_a, b.clean AS drug_b
          FROM checkednames a JOIN checkednames b ON a.regimen_id = b.regimen_id AND a.pos < b.pos
          JOIN regcheck c ON c.regimen_id = a.regimen_id WHERE c.reason IS NULL)""",
    "asked": "SELECT DISTINCT drug_a, drug_b FROM regpairs",
    "searchterms": """SELECT drug_id, 0 AS kind, normalized_name AS term FROM drugs WHERE normalized_name IS NOT NULL
        UNION SELECT drug_id, 0, input_name FROM drugs WHERE input_name IS NOT NULL
        UNION SELECT drug_id, 1, synonym FROM synonyms""",
    "askednames": "SELECT drug_a AS name FROM asked UNION SELECT drug_b FROM asked",
    "resolved": f"""SELECT n.name, (SELECT arg_min(rxcui, (t, k, d)) FROM (
          SELECT g.rxcui, 0 AS t, 0 AS k, 0::BIGINT AS d FROM drugs g WHERE g.rxcui = {strip('n.name')}
            AND regexp_full_match({strip('n.name')}, '[0-9]+')
          UNION ALL
          SELECT g.rxcui, CASE WHEN lower(g.normalized_name) = lower({strip('n.name')}) THEN 1 ELSE 2 END, s.kind, g.drug_id
          FROM drugs g JOIN searchterms s USING (drug_id)
          WHERE lower(s.term) LIKE '%' || lower({strip('n.name')}) || '%')) AS rxcui
        FROM askednames n""",
    "resolvedpairs": """SELECT p.drug_a, p.drug_b, a.rxcui AS rxcui_a, b.rxcui AS rxcui_b FROM asked p
        LEFT JOIN resolved a ON a.name = p.drug_a LEFT JOIN resolved b ON b.name = p.drug_b""",
    "pairids": "SELECT DISTINCT rxcui_a, rxcui_b FROM resolvedpairs WHERE rxcui_a <> rxcui_b",
    "variants": """SELECT d.rxcui, list(t.term ORDER BY t.ord) AS v FROM drugs d JOIN terms t USING (drug_id)
        WHERE t.ord <= 2 GROUP BY 1""",
    "allqueries": """SELECT p.rxcui_a, p.rxcui_b, q.o AS o, q.query AS query, q.t AS query_type
        FROM pairids p JOIN variants a ON a.rxcui = p.rxcui_a JOIN variants b ON b.rxcui = p.rxcui_b,
        LATERAL (SELECT (i - 1) * len(b.v) + j AS o, a.v[i] || ' and ' || b.v[j] || ' interaction' AS query, 'pair_specific' AS t
          FROM range(1, 3) x(i), range(1, 3) y(j) WHERE i <= len(a.v) AND j <= len(b.v)
          UNION ALL SELECT 10, a.v[1] || ' ' || b.v[1], 'pair_specific'
          UNION ALL SELECT 11, a.v[1] || ' drug interactions', 'drug_a_specific'
          UNION ALL SELECT 12, a.v[1] || ' interaction warnings', 'drug_a_specific'
          UNION ALL SELECT 13, b.v[1] || ' drug interactions', 'drug_b_specific'
          UNION ALL SELECT 14, b.v[1] || ' interaction warnings', 'drug_b_specific') q""",
    "queries": """SELECT rxcui_a, rxcui_b, row_number() OVER (PARTITION BY rxcui_a, rxcui_b ORDER BY o) AS ord, query, query_type,
        CASE query_type WHEN 'drug_a_specific' THEN [rxcui_a] WHEN 'drug_b_specific' THEN [rxcui_b]
          ELSE list_sort([rxcui_a, rxcui_b]) END AS scope
        FROM (SELECT *, row_number() OVER (PARTITION BY rxcui_a, rxcui_b, lower(query) ORDER BY o) AS r FROM allqueries)
        WHERE r = 1""",
    "searches": f"""SELECT *, {hash_vec('query')} AS v FROM (
        SELECT scope, lower(query) AS lq, min(query) AS query FROM queries GROUP BY 1, 2)""",
    "hits": f"""SELECT scope, lq, chunk_id, distance, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY scope, lq ORDER BY distance, chunk_id) AS rank FROM (
          SELECT s.scope, s.lq, c.chunk_id, {dist('s.v', 'c.v', 16)} AS distance
          FROM (SELECT *, unnest(scope) AS rxcui FROM searches) s JOIN vectors c USING (rxcui))) WHERE rank <= 5""",
    "items": """SELECT q.rxcui_a, q.rxcui_b, h.chunk_id, min(h.distance) AS distance,
        list(q.query ORDER BY q.ord) AS retrieval_queries, list(q.query_type ORDER BY q.ord) AS retrieval_query_types,
        min(q.ord) AS first_ord, arg_min(h.rank, q.ord) AS first_rank
        FROM queries q JOIN hits h ON h.scope = q.scope AND h.lq = lower(q.query) GROUP BY 1, 2, 3""",
    "itemtexts": f"""SELECT chunk_id, text, rxcui, list_distinct(regexp_extract_all(lower(text), '{WORD}+')) AS toks
        FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM items)""",
    "drugmentions": """SELECT chunk_id, rxcui, list(term ORDER BY ord) AS matched FROM (
        SELECT x.chunk_id, d.rxcui, t.term, t.ord FROM (SELECT chunk_id, unnest(toks) AS tok FROM itemtexts) x
        JOIN terms t ON t.term = x.tok JOIN drugs d USING (drug_id)) GROUP BY 1, 2""",
    "classhits": """SELECT chunk_id, member, arg_min(class_term, ord) AS class_term FROM (
        SELECT x.chunk_id, c.* FROM (SELECT chunk_id, unnest(toks) AS tok FROM itemtexts) x
        JOIN classes c ON c.class_term = x.tok) GROUP BY 1, 2""",
    "sided": """SELECT i.*, c.text, c.rxcui, coalesce(ma.matched, []) AS matched_terms_a, coalesce(mb.matched, []) AS matched_terms_b,
        (ma.matched IS NOT NULL OR c.rxcui = i.rxcui_a) AS mentions_a, (mb.matched IS NOT NULL OR c.rxcui = i.rxcui_b) AS mentions_b,
        ca.class_term AS _ca, cb.class_term AS _cb
        FROM items i JOIN itemtexts c USING (chunk_id)
        JOIN drugs da ON da.rxcui = i.rxcui_a JOIN drugs db ON db.rxcui = i.rxcui_b
        LEFT JOIN drugmentions ma ON ma.chunk_id = i.chunk_id AND ma.rxcui = i.rxcui_a
        LEFT JOIN drugmentions mb ON mb.chunk_id = i.chunk_id AND mb.rxcui = i.rxcui_b
        LEFT JOIN classhits ca ON ca.chunk_id = i.chunk_id AND ca.member = lower(da.normalized_name)
        LEFT JOIN classhits cb ON cb.chunk_id = i.chunk_id AND cb.member = lower(db.normalized_name)""",
    "classified": """SELECT *, CASE WHEN mentions_a AND mentions_b THEN 'pair_specific_evidence'
          WHEN (mentions_a AND class_match_b IS NOT NULL) OR (mentions_b AND class_match_a IS NOT NULL) THEN 'class_level_evidence'
          WHEN mentions_a OR mentions_b THEN 'drug_specific_evidence' ELSE 'general_label_evidence' END AS classification
        FROM (SELECT *, CASE WHEN NOT mentions_a THEN _ca END AS class_match_a,
          CASE WHEN NOT mentions_b THEN _cb END AS class_match_b FROM sided)""",
    "evidence": """SELECT *, CASE WHEN place <= 8 THEN 'EVIDENCE-' || lpad(place::VARCHAR, 3, '0') END AS evidence_id FROM (
        SELECT *, row_number() OVER (PARTITION BY rxcui_a, rxcui_b ORDER BY
          CASE classification WHEN 'pair_specific_evidence' THEN 1 WHEN 'drug_specific_evidence' THEN 2
            WHEN 'class_level_evidence' THEN 3 ELSE 4 END, distance, first_ord, first_rank, chunk_id) AS place FROM classified)""",
    "paircounts": """SELECT rxcui_a, rxcui_b, count(*) FILTER (classification = 'pair_specific_evidence') AS n_pair_specific,
        count(*) FILTER (classification <> 'pair_specific_evidence') AS n_supporting FROM evidence GROUP BY 1, 2""",
    "statuses": """SELECT p.drug_a, p.drug_b, p.rxcui_a, p.rxcui_b, coalesce(c.n_pair_specific, 0) AS n_pair_specific,
        coalesce(c.n_supporting, 0) AS n_supporting,
        CASE WHEN p.rxcui_a IS NULL OR p.rxcui_b IS NULL THEN 'drug_not_found' WHEN p.rxcui_a = p.rxcui_b THEN 'invalid_input'
          WHEN c.n_pair_specific > 0 THEN 'pair_specific_evidence_found' WHEN c.n_supporting > 0 THEN 'supporting_evidence_found'
          ELSE 'insufficient_evidence' END AS evidence_status
        FROM resolvedpairs p LEFT JOIN paircounts c USING (rxcui_a, rxcui_b)""",
    "idstatuses": "SELECT DISTINCT rxcui_a, rxcui_b, evidence_status FROM statuses WHERE rxcui_a IS NOT NULL AND rxcui_b IS NOT NULL",
    "turns": f"""SELECT conv_id || '-' || turn AS answer_id, (conv_id % 20 + 1000)::VARCHAR AS rxcui_a,
        ((conv_id + turn % 5 + 1) % 20 + 1000)::VARCHAR AS rxcui_b, role, text, length(text) AS n,
        string_split({squish('text')}, ' ') AS w FROM conversations""",
    "parsed": """SELECT answer_id, rxcui_a, rxcui_b, 'OpenRouter' AS provider,
        (role <> 'assistant' OR n % 17 = 0 OR (n % 6 <> 0 AND n % 19 = 0)) AS malformed,
        CASE WHEN n % 5 = 0 THEN 'insufficient_evidence' WHEN n % 5 < 4 THEN 'supporting_evidence_found'
          ELSE 'pair_specific_evidence_found' END AS interaction_assessment,
        text AS evidence_summary, CASE WHEN n % 3 = 0 THEN w[1] END AS clinical_effect,
        CASE WHEN n % 7 = 0 THEN ' ' END AS mechanism, CASE WHEN n % 2 = 0 THEN w[2] WHEN n % 4 = 1 THEN 'None' END AS severity,
        ['EVIDENCE-' || lpad((n % 8 + 1)::VARCHAR, 3, '0'), 'EVIDENCE-' || lpad((n % 9 + 1)::VARCHAR, 3, '0')] AS cited_evidence_ids,
        [w[1]] AS limitations,
        CASE WHEN n % 11 = 0 THEN 'See www.example.org' WHEN n % 13 = 0 THEN 'They are Safe to combine.'
          ELSE 'Ask a pharmacist.' END AS safety_notice
        FROM turns""",
}


def sql(body: str) -> str:
    """The body with the CTEs it uses, directly or through others, in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(body)
    # Definitions may refer to each other in any order, so sort by use.
    done: list[str] = []

    def place(name: str) -> None:
        if name in done:
            return
        for other in order:
            if other != name and re.search(rf"(?:FROM|JOIN|,)\s+{other}\b", CTES[name]):
                place(other)
        done.append(name)

    for name in order:
        place(name)
    # Materialized once each: several of them are read by many others.
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in done)
    if not head:
        return body
    own = re.match(r"\s*WITH\s+(?!RECURSIVE)", body)
    return f"WITH {head}" + (",\n" + body[own.end():] if own else "\n" + body)
