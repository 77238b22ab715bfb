"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.functions import text as tx
from pairlight.functions import vectors
from pairlight.operators import (
    audit,
    candidates,
    chunking,
    grounding,
    index,
    mentions,
    pairs,
    resolve,
    search,
    upsert,
)
from pairlight.plans import pair_evidence as pe
from pairlight.queries import oracle as o
from pairlight.queries import roles
from pairlight.queries.roles import table
from pairlight.session import work_folder
from pairlight.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = o.sql(sql)
        return fn
    return register


joined = lambda c: F.array_join(c, "|")


# Chunks and sections ---------------------------------------------------------

@query(f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, len(string_split(w, ' ')) AS word_count,
    count(*) OVER (PARTITION BY doc_id) AS total_chunks, md5(w) AS chunk_hash
    FROM (SELECT doc_id, n, i, {o.windows('t', 6, 2)[1]} AS w FROM (SELECT *, unnest(range(n)) AS i FROM (
      SELECT *, {o.windows('t', 6, 2)[0]} AS n FROM (SELECT doc_id, {o.squish('text')} AS t FROM documents) WHERE t <> '')))
    WHERE n = 1 OR length(w) >= 15""")
def chunk_small_windows(spark, sf):
    """Windows of six words, small enough for the drop of short windows to show."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_texts(docs, size=6, overlap=2).select(
        "doc_id", F.col("chunk_index").cast("long"), F.col("word_count").cast("long"),
        F.col("total_chunks").cast("long"), F.md5("chunk_text").alias("chunk_hash"))


@query(f"""SELECT doc_id, i AS chunk_index, n AS total_chunks, {o.windows('t', 180, 40)[1]} AS chunk_text
    FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, {o.windows('t', 180, 40)[0]} AS n
      FROM (SELECT doc_id, {o.squish('text')} AS t FROM documents) WHERE t <> ''))""")
def chunk_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_texts(docs).select(
        "doc_id", F.col("chunk_index").cast("long"), F.col("total_chunks").cast("long"), "chunk_text")


@query("SELECT * FROM chunks")
def chunk_provenance(spark, sf):
    return roles.chunks(spark, sf).withColumn("chunk_index", F.col("chunk_index").cast("long")).withColumn(
        "total_chunks", F.col("total_chunks").cast("long"))


def _orphaned(spark, sf):
    """Drugs without the source src3, and German sections blanked while still marked found."""
    drugs = roles.drugs(spark, sf).where("drug_id <> 3")
    german = table(spark, sf, "documents").where("lang = 'de'").select(F.col("doc_id").alias("label_id"))
    sections = roles.sections(spark, sf).join(german.withColumn("_g", F.lit(True)), "label_id", "left").withColumn(
        "text", F.when(F.col("_g") & F.col("found"), "  ").otherwise(F.col("text"))).drop("_g")
    return drugs, roles.labels(spark, sf), sections, roles.links(spark, sf)


@query("""SELECT 'link' AS kind, link_id AS record_id, 'missing drug or label' AS reason FROM links WHERE drug_id = 3
    UNION ALL SELECT 'section', section_id, 'found without text' FROM sections JOIN links USING (label_id)
    WHERE found AND lang = 'de' AND drug_id <> 3""")
def index_rejects(spark, sf):
    return chunking.rejects(*_orphaned(spark, sf))


@query("""SELECT rxcui, label_id, section_id, section_key, md5(text) AS text_hash FROM sections JOIN links USING (label_id)
    JOIN drugs USING (drug_id) WHERE found AND section_key = 'contraindications'""")
def sections_for_drug(spark, sf):
    args = roles.drugs(spark, sf), roles.labels(spark, sf), roles.sections(spark, sf), roles.links(spark, sf)
    return chunking.sections_for_drug(*args, section_key="contraindications", only_found=True).select(
        "rxcui", "label_id", "section_id", "section_key", F.md5("text").alias("text_hash"))


@query("""SELECT label_id, section_key, row_number() OVER (PARTITION BY label_id ORDER BY
      CASE section_key WHEN 'drug_interactions' THEN 1 WHEN 'drug_lab_interactions' THEN 2 WHEN 'contraindications' THEN 3
        WHEN 'warnings_and_precautions' THEN 4 WHEN 'clinical_pharmacology' THEN 5 WHEN 'adverse_reactions' THEN 6 ELSE 7 END,
      section_key) AS place FROM sections WHERE found""")
def section_order(spark, sf):
    found = roles.sections(spark, sf).where("found").select("label_id", "section_key")
    return found.withColumn("place", F.row_number().over(
        W.partitionBy("label_id").orderBy(chunking.priority(F.col("section_key")), "section_key")).cast("long"))


# Vectors -----------------------------------------------------------------------

@query(f"SELECT doc_id, j AS pos, round(v[j + 1], 9) AS value FROM (SELECT doc_id, {o.hash_vec('text', 40)} AS v FROM documents), range(40) t(j)")
def hash_embedding(spark, sf):
    docs = vectors.HashEmbedder(40)(table(spark, sf, "documents").select("doc_id", "text"), "text", "v")
    return docs.select("doc_id", F.posexplode("v").alias("pos", "value")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.round("value", 9).alias("value"))


@query("""SELECT label, i AS pos, round(sum(m * x) / greatest(sum(m), 1e-9), 6) AS value FROM (
    SELECT label, vec_id % 3 AS m, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)) GROUP BY 1, 2""")
def pooled_vectors(spark, sf):
    emb = table(spark, sf, "embeddings").select("label", "embedding", (F.col("vec_id") % 3).alias("mask"))
    return vectors.mean_pool(emb, "label", "embedding", "mask").select("label", F.posexplode("pooled").alias("pos", "value")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("""SELECT vec_id, i AS pos, round(embedding[i + 1]::DOUBLE * 3 / greatest(sqrt(list_sum(list_transform(embedding,
    lambda x: x::DOUBLE * 3 * x::DOUBLE * 3))), 1e-12), 6) AS value FROM embeddings, range(64) t(i)""")
def normalised_vectors(spark, sf):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    emb = table(spark, sf, "embeddings").select("vec_id", tripled.alias("v"))
    return emb.select("vec_id", F.posexplode(vectors.normalise(F.col("v"))).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


@query(f"""SELECT query_id, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
    FROM (SELECT a.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS chunk_id, {o.dist('a.embedding', 'b.embedding', 64)} AS distance
      FROM embeddings a JOIN embeddings b USING (label))) WHERE rank <= 5""")
def topk_scoped(spark, sf):
    """Five nearest vectors of each vector within its own label."""
    v, scope = _vectors(spark, sf), F.col("label").cast("string").alias("scope")
    return search.top_k(
        v.select(F.col("id").alias("query_id"), scope, F.col("embedding").alias("qvec")),
        v.select(F.col("id").alias("chunk_id"), scope, F.col("embedding").alias("cvec")),
    ).withColumn("rank", F.col("rank").cast("long"))


@query(f"""SELECT query_id, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
    FROM (SELECT a.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS chunk_id, {o.dist('a.embedding', 'b.embedding', 64)} AS distance
      FROM embeddings a JOIN embeddings b ON b.label IN (2, 5, 7))) WHERE rank <= 3""")
def topk_filtered(spark, sf):
    """Three nearest vectors of each vector among those that a metadata filter leaves."""
    v = _vectors(spark, sf)
    kept = search.metadata_filter(v, {"label": [2, 5, 7], "id": None})
    return search.top_k(
        v.select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec")),
        kept.select(F.col("id").alias("chunk_id"), F.col("embedding").alias("cvec")), k=3,
    ).withColumn("rank", F.col("rank").cast("long"))


@query(f"""SELECT query_id, chunk_id, distance, rank, section_key, rxcui FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (
      SELECT b.item_id::VARCHAR AS query_id, c.chunk_id, c.section_key, c.rxcui, {o.dist('b.v', 'c.v', 16)} AS distance
      FROM (SELECT item_id, {o.hash_vec('text')} AS v FROM benchmark WHERE text <> '') b,
        (SELECT c.*, v.v FROM chunks c JOIN vectors v USING (chunk_id) WHERE c.section_key = 'boxed_warning') c)) WHERE rank <= 5""")
def retrieve_chunks(spark, sf):
    """Text queries against one section of the index."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    hits = search.retrieve(asked, roles.knowledge(spark, sf).index, roles.EMBEDDER, section_key="boxed_warning")
    return hits.select("query_id", "chunk_id", "distance", F.col("rank").cast("long").alias("rank"), "section_key", "rxcui")


# Mentions ------------------------------------------------------------------------

TOKENS = f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{o.WORD}+'))) AS tok FROM documents"


@query(f"SELECT x.doc_id, t.term FROM ({TOKENS}) x JOIN terms t ON t.term = x.tok")
def mention_terms(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mentions.match_terms(docs, roles.name_words(spark, sf).select("term"), key="doc_id")


@query(f"""SELECT doc_id, rxcui, string_agg(term, '|' ORDER BY ord) AS matched_terms FROM ({TOKENS}) x JOIN terms t ON t.term = x.tok
    JOIN drugs USING (drug_id) GROUP BY 1, 2""")
def drug_mentions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    terms = roles.name_words(spark, sf).join(roles.drugs(spark, sf), "drug_id").select("rxcui", "term", "ord")
    return mentions.owner_mentions(docs, terms, key="doc_id").withColumn("matched_terms", joined("matched_terms"))


@query(f"""SELECT doc_id, member, arg_min(class_term, ord) AS class_term FROM ({TOKENS}) x
    JOIN classes c ON c.class_term = x.tok GROUP BY 1, 2""")
def class_mentions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mentions.class_mentions(docs, roles.classes(spark, sf), key="doc_id")


@query(f"""WITH phrases AS (SELECT DISTINCT lower(term) AS p, term FROM (
      SELECT {o.squish("w[i] || ' ' || w[i + 1]")} AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (
        SELECT string_split(text, ' ') AS w FROM benchmark)))
      WHERE regexp_full_match(term, '[A-Za-z]+ [A-Za-z]+')),
    marked AS MATERIALIZED (SELECT doc_id, '#' || regexp_replace(lower(text), '[^\\pL\\pN_ ]', '#', 'g') || '#' AS t FROM documents)
    SELECT m.doc_id, p.term FROM marked m, phrases p WHERE contains(m.t, p.p) AND (contains(m.t, ' ' || p.p || ' ')
      OR contains(m.t, ' ' || p.p || '#') OR contains(m.t, '#' || p.p || ' ') OR contains(m.t, '#' || p.p || '#'))""")
def mention_phrases(spark, sf):
    """All neighbouring words as two-word terms: joined on the longer word, settled on the text."""
    pair = tx.let(F.split("text", " "), lambda w: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))
    phrases = table(spark, sf, "benchmark").select(F.explode(pair).alias("term")).select(tx.squish(F.col("term")).alias("term")).where(
        F.col("term").rlike(r"^[A-Za-z]+ [A-Za-z]+\z")).distinct()
    return mentions.match_terms(table(spark, sf, "documents").select("doc_id", "text"), phrases, key="doc_id")


# Names -----------------------------------------------------------------------------

NAMES = """SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'p' || p_partkey, p_name FROM part
    UNION ALL SELECT 't' || conv_id || '-' || turn, text FROM conversations"""


@query(f"""SELECT id, CASE WHEN problem IS NULL THEN {o.strip('name')} END AS clean_name, problem AS reason
    FROM (SELECT *, {o.BAD_NAME} AS problem FROM ({NAMES}))""")
def validate_names(spark, sf):
    names = (
        table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
        .unionByName(table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name")))
        .unionByName(table(spark, sf, "conversations").select(
            F.concat(F.lit("t"), "conv_id", F.lit("-"), "turn").alias("id"), F.col("text").alias("name")))
    )
    return pairs.check_names(names).select("id", "clean_name", "reason")


@query("SELECT * FROM regcheck")
def validate_regimens(spark, sf):
    return pairs.check_regimens(roles.regimens(spark, sf)).drop("names")


@query("SELECT * FROM regpairs")
def regimen_pairs(spark, sf):
    out = pairs.regimen_pairs(pairs.check_regimens(roles.regimens(spark, sf)))
    return out.withColumn("pair_no", F.col("pair_no").cast("long"))


SUPPLIER_ASKS = """SELECT DISTINCT query FROM (SELECT substr(s_name, 15) AS query FROM supplier
    UNION ALL SELECT replace(substr(s_name, 10), '00', '_%') FROM supplier UNION ALL SELECT ' ' || upper(r_name) FROM region
    UNION ALL SELECT n_name FROM nation)"""


@query(f"""SELECT q.query, t.drug_id, min(t.kind) AS kind FROM ({SUPPLIER_ASKS}) q JOIN (
    SELECT c_custkey AS drug_id, 0 AS kind, c_name AS term FROM customer
    UNION ALL SELECT c_custkey, 0, c_mktsegment FROM customer
    UNION ALL SELECT o_custkey, 1, o_orderpriority || ' ' || n_name FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey) t
    ON lower(t.term) LIKE '%' || lower({o.strip('q.query')}) || '%' GROUP BY 1, 2""")
def name_search(spark, sf):
    """Substring search with wildcards over customers as drugs."""
    supplier = table(spark, sf, "supplier")
    asked = (
        supplier.select(F.substring("s_name", 15, 100).alias("query"))
        .unionByName(supplier.select(F.replace(F.substring("s_name", 10, 100), F.lit("00"), F.lit("_%")).alias("query")))
        .unionByName(table(spark, sf, "region").select(F.concat(F.lit(" "), F.upper("r_name")).alias("query")))
        .unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("query")))
    )
    customer = table(spark, sf, "customer")
    drugs = customer.select(F.col("c_custkey").alias("drug_id"), F.col("c_name").alias("normalized_name"),
                            F.col("c_name").alias("input_name"), F.col("c_mktsegment").alias("generic_name"))
    other = (
        table(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct()
        .join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
        .join(table(spark, sf, "nation"), "n_nationkey")
        .select(F.col("o_custkey").alias("drug_id"), F.concat("o_orderpriority", F.lit(" "), "n_name").alias("synonym"))
    )
    return resolve.search_names(asked, resolve.search_terms(drugs, other))


def _asked_names(spark, sf):
    """Distinct names in accepted regimens, written since resolving reads them more than once."""
    asked = pairs.regimen_pairs(pairs.check_regimens(roles.regimens(spark, sf)))
    return pe.cut(asked.select(F.explode(F.array("drug_a", "drug_b")).alias("name")).distinct())


@query("SELECT * FROM resolved")
def resolve_drugs(spark, sf):
    return resolve.resolve_drugs(_asked_names(spark, sf), roles.drugs(spark, sf), roles.synonyms(spark, sf))


@query("SELECT name FROM resolved WHERE rxcui IS NULL")
def unknown_names(spark, sf):
    return resolve.unknown_names(_asked_names(spark, sf), roles.drugs(spark, sf), roles.synonyms(spark, sf))


@query("SELECT d.drug_id, d.rxcui, c.c_custkey FROM customer c JOIN drugs d ON d.rxcui = c.c_custkey::VARCHAR")
def lookup_by_id(spark, sf):
    ids = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("rxcui"))
    return ids.join(roles.drugs(spark, sf).select("drug_id", "rxcui"), "rxcui").select("drug_id", "rxcui", "c_custkey")


GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3)))"


@query(f"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{o.WORD}+')) AS name FROM conversations),
    a AS (SELECT name, trim(regexp_replace(lower(name), '[^\\pL\\pN]+', ' ', 'g')) AS k FROM words),
    c AS (SELECT word AS concept, substr(md5(word), 1, 8) AS rxcui FROM bwords WHERE length(word) >= 7 GROUP BY 1),
    ex AS (SELECT a.name, arg_min(c.rxcui, c.rxcui) AS rxcui, arg_min(c.concept, c.rxcui) AS normalized_name FROM a JOIN c ON c.concept = a.k GROUP BY 1),
    ag AS (SELECT k, {GRAMS.format('k')} AS g FROM (SELECT DISTINCT k FROM a WHERE k <> '')),
    cg AS (SELECT concept, rxcui, {GRAMS.format('concept')} AS g FROM c),
    ov AS (SELECT x.k, y.concept, y.rxcui, any_value(x.n) AS an, any_value(y.n) AS cn, count(*) AS o
      FROM (SELECT k, len(g) AS n, unnest(g) AS t FROM ag) x JOIN (SELECT concept, rxcui, len(g) AS n, unnest(g) AS t FROM cg) y USING (t) GROUP BY 1, 2, 3),
    sc AS (SELECT a.name, v.rxcui, v.concept, round(200.0::DOUBLE * o / (an + cn), 6) AS s FROM ov v JOIN a USING (k)
      WHERE a.name NOT IN (SELECT name FROM ex) AND round(200.0::DOUBLE * o / (an + cn), 6) >= 50),
    top AS (SELECT name, rxcui, concept, s, row_number() OVER (PARTITION BY name ORDER BY s DESC, rxcui) AS r FROM sc QUALIFY r <= 5),
    ap AS (SELECT name, arg_min(rxcui, r) AS rxcui, arg_min(concept, r) AS normalized_name, arg_min(s, r) AS s,
      string_agg(rxcui, '|' ORDER BY r) FILTER (r > 1) AS oc FROM top GROUP BY 1)
    SELECT a.name, CASE WHEN ex.rxcui IS NOT NULL THEN 'exact' WHEN ap.rxcui IS NOT NULL THEN 'approximate' ELSE 'none' END AS match_type,
      coalesce(ex.rxcui, ap.rxcui) AS rxcui, coalesce(ex.normalized_name, ap.normalized_name) AS normalized_name,
      ap.s AS match_score, coalesce(ap.oc, '') AS other_ids FROM a LEFT JOIN ex USING (name) LEFT JOIN ap USING (name)""")
def resolve_names(spark, sf):
    """Every word of the conversations against a vocabulary of benchmark words."""
    asked = table(spark, sf, "conversations").select(
        F.explode(F.regexp_extract_all("text", F.lit(f"({tx.WORD}+)"))).alias("name"))
    concepts = roles.word_counts(spark, sf, F.length("word") >= 7).select(
        F.substring(F.md5("word"), 1, 8).alias("rxcui"), F.col("word").alias("concept_name"))
    out = resolve.match_vocabulary(asked, concepts)
    return out.select("name", "match_type", "rxcui", "normalized_name", "match_score",
                      joined(F.transform("other_candidates", lambda c: c["rxcui"])).alias("other_ids"))


# Vocabulary responses ----------------------------------------------------------------

TYPES = ("IN", "BN", "SCD", "PIN", "SBD", "GPCK", "DF")


def _related_json(spark, sf):
    """One vocabulary response per conversation turn: lines are groups, words are members."""
    lines = F.split("text", "\n")
    kinds = F.array(*[F.lit(t) for t in TYPES])
    member = lambda w, j: F.struct(j.cast("string").alias("rxcui"), w.alias("name"))
    groups = F.transform(lines, lambda x, i: F.struct(
        kinds[i % len(TYPES)].alias("tty"),
        F.when(i % 5 != 4, F.transform(F.split(x, " "), member)).alias("conceptProperties")))
    body = F.to_json(F.struct(F.struct(groups.alias("conceptGroup")).alias("allRelatedGroup")))
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), (F.length("text") % 9).cast("string").alias("rxcui"), body.alias("body"))


RELATED = f"""SELECT turn_id, rxcui, i - 1 AS g, (['{"','".join(TYPES)}'])[(i - 1) % 7 + 1] AS tty,
    CASE WHEN (i - 1) % 5 <> 4 THEN string_split(lines[i], ' ') END AS names
    FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT conv_id || '-' || turn AS turn_id,
      (length(text) % 9)::VARCHAR AS rxcui, string_split(text, chr(10)) AS lines FROM conversations))"""


@query(f"""SELECT turn_id, g AS group_pos, tty, (j - 1)::VARCHAR AS pos, (j - 1)::VARCHAR AS related_rxcui, names[j] AS name
    FROM (SELECT *, unnest(range(1, len(names) + 1)) AS j FROM ({RELATED}) WHERE names IS NOT NULL)
    UNION ALL SELECT turn_id, g, tty, NULL, NULL, NULL FROM ({RELATED}) WHERE names IS NULL""")
def vocabulary_rows(spark, sf):
    from pairlight.sources import vocabulary as v

    parsed = v.parse_responses(_related_json(spark, sf), "body", v.RELATED)
    return v.related_rows(parsed, key="turn_id").withColumn("group_pos", F.col("group_pos").cast("long")).withColumn(
        "pos", F.col("pos").cast("string"))


def _first_names(types) -> str:
    return f"""(SELECT string_agg(name, '|' ORDER BY o) FROM (SELECT turn_id AS tid, name, min((g, j)) AS o FROM rows
      WHERE tty IN {o.in_list(types)} AND name <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY tid ORDER BY o) <= 10)
      WHERE tid = t.turn_id)"""


@query(f"""WITH groups AS ({RELATED}), rows AS (SELECT *, names[j] AS name, (j - 1)::VARCHAR AS id
      FROM (SELECT *, unnest(range(1, len(names) + 1)) AS j FROM groups WHERE names IS NOT NULL))
    SELECT turn_id, (SELECT arg_max(tty, g) FROM rows r WHERE r.turn_id = t.turn_id AND r.id = t.rxcui) AS term_type,
      coalesce({_first_names(vocab.BRAND_TYPES)}, '') AS brand_names,
      (SELECT arg_min(name, g) FROM rows r WHERE r.turn_id = t.turn_id AND j = 1 AND tty IN ('IN', 'PIN')) AS generic_name,
      coalesce({_first_names(vocab.SYNONYM_TYPES)}, '') AS synonyms
    FROM (SELECT DISTINCT turn_id, rxcui FROM groups) t""")
def related_concepts(spark, sf):
    from pairlight.sources import vocabulary as v

    parsed = v.parse_responses(_related_json(spark, sf), "body", v.RELATED)
    rows = parsed.select("turn_id", "rxcui", F.col("response.allRelatedGroup.conceptGroup").alias("concept_groups"))
    out = resolve.related_concepts(rows)
    return out.select("turn_id", "term_type", joined("brand_names").alias("brand_names"), "generic_name",
                      joined("synonyms").alias("synonyms"))


# Label candidates and documents --------------------------------------------------------

def _searches(spark, sf):
    """Search responses per document: lines as candidates, empty by id for French documents."""
    lines = F.split("text", "\n")
    rows = F.transform(lines, lambda x, i: F.struct(
        F.when(i % 4 != 3, F.concat(F.lit("s"), i.cast("string"))).alias("setid"), i.alias("spl_version"),
        tx.strip(F.substring_index(x, ".", 1)).alias("title"), F.col("lang").alias("published_date")))
    renamed = F.transform(rows, lambda r: F.struct(F.concat(F.lit("n"), r["setid"]).alias("setid"), r["spl_version"], r["title"],
                                                   r["published_date"]))
    none = F.lit('{"data": []}')
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"),
        F.when(F.col("lang") == "fr", none).otherwise(F.to_json(F.struct(rows.alias("data")))).alias("a"),
        F.to_json(F.struct(renamed.alias("data"))).alias("b"))


@query(f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) AS rank, setid, spl_version, title, published_date FROM (
    SELECT doc_id AS query_id, i, CASE WHEN (i - 1) % 4 <> 3 THEN CASE WHEN lang = 'fr' THEN 'ns' ELSE 's' END || (i - 1) END AS setid,
      (i - 1)::VARCHAR AS spl_version, {o.strip("string_split(lines[i], '.')[1]")} AS title, lang AS published_date
    FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents), range(1, 11) t(i) WHERE i <= len(lines))
    WHERE setid IS NOT NULL AND title <> ''""")
def candidate_rows(spark, sf):
    from pairlight.sources import vocabulary as v

    parsed = v.parse_responses(v.parse_responses(_searches(spark, sf), "a", v.CANDIDATES, "by_rxcui"), "b", v.CANDIDATES, "by_name")
    return candidates.candidate_rows(parsed).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rank,
      count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem),
    t AS (SELECT l_orderkey, any_value(total) AS total, count(*) AS n, min(rank) FILTER (l_returnflag = 'R') AS hit FROM r WHERE rank <= 3 GROUP BY 1)
    SELECT t.l_orderkey, r.l_partkey, coalesce(t.hit, t.n) AS candidates_checked, t.total AS total_candidates_found,
      CASE WHEN t.hit IS NULL THEN 'label_found_no_interaction_section' ELSE 'interaction_evidence_found' END AS evidence_status
    FROM t JOIN r ON r.l_orderkey = t.l_orderkey AND r.rank = coalesce(t.hit, 1)""")
def best_candidate(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        (F.col("l_returnflag") == "R").alias("hit"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    return candidates.best_candidate(lines, "l_orderkey", order, "hit").select(
        "l_orderkey", "l_partkey", "candidates_checked", "total_candidates_found", "evidence_status")


def _every_seventh(first: int):
    return lambda x, j: j % 7 == first


def label_xml(spark, sf):
    """Label documents in XML, one per row of documents; German ones are cut off and cannot be parsed."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    section = lambda code, body: F.concat(F.lit(f'<component><section><code code="{code}"/><title>t</title>'), body, F.lit("</section></component>"))

    def body(lines):
        parts = []
        for i, (code, _) in enumerate(vocab.SECTIONS.values()):
            paragraphs = F.transform(F.filter(lines, _every_seventh(i)),
                                     lambda x: F.concat(F.lit("<paragraph>"), x, F.lit("</paragraph>")))
            content = F.concat(F.lit("<text>"), F.array_join(paragraphs, ""), F.lit("</text>"))
            # A placeholder first, then the content in a nested section.
            parts.append(section("00000-0", F.concat(section(code, F.lit("<text> . </text>")), section(code, content))))
            parts.append(section(code, F.lit("<text>later text</text>")) if i == 0 else F.lit(""))
        return F.concat(*parts)

    xml = F.concat(
        F.lit(f'<document xmlns="{vocab.LABEL_NAMESPACE}"><setId root="'), F.col("doc_id").cast("string"), F.lit('"/><title> Label '),
        F.col("lang"), F.lit(' </title><versionNumber value="'), F.col("n_chars").cast("string"),
        F.lit('"/><author><assignedEntity><representedOrganization><name>'), escaped(F.col("source")),
        F.lit("</name></representedOrganization></assignedEntity></author><component><structuredBody>"),
        tx.let(F.split(escaped(F.col("text")), "\n"), body), F.lit("</structuredBody></component></document>"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc"), F.when(F.col("lang") == "de", F.replace(xml, F.lit("</document>"), F.lit(""))).otherwise(xml).alias("xml"))


@query(f"""SELECT label_id::VARCHAR AS doc, section_key, section_code,
      CASE WHEN k = 0 AND NOT {o.meaningful('raw')} THEN 'later text' WHEN {o.meaningful('raw')} THEN raw ELSE '' END AS text,
      (k = 0 OR {o.meaningful('raw')}) AS found, NULL AS error FROM rawsections WHERE lang <> 'de'
    UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, NULL, false, 'document cannot be parsed' FROM documents WHERE lang = 'de'""")
def sections_from_xml(spark, sf):
    from pairlight.sources import label_xml as lx

    return lx.section_rows(lx.parse_labels(label_xml(spark, sf))).drop("section_name")


@query("""SELECT doc_id::VARCHAR AS doc, doc_id::VARCHAR AS setid, n_chars::VARCHAR AS spl_version, 'Label ' || lang AS title,
    source AS manufacturer, NULL::VARCHAR AS error FROM documents WHERE lang <> 'de'
    UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, NULL, NULL, 'document cannot be parsed' FROM documents WHERE lang = 'de'""")
def label_headers(spark, sf):
    from pairlight.sources import label_xml as lx

    return lx.parse_labels(label_xml(spark, sf)).select("doc", "setid", "spl_version", "title", "manufacturer", "error")


# Upserts ----------------------------------------------------------------------------------

AS_OF = "2024-06-01 00:00:00"
LABEL_FIELDS = ["title", "manufacturer", "published_date", "source_url", "api_url"]


def _stamped(df, **times):
    for c, t in times.items():
        df = df.withColumn(c, F.lit(t).cast("timestamp"))
    return df


@query(f"""SELECT setid, spl_version, manufacturer, status, CASE WHEN status IN ('added', 'updated') THEN TIMESTAMP '{AS_OF}'
      ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM (
    SELECT coalesce(n.setid, p.setid) AS setid, coalesce(n.spl_version, p.spl_version) AS spl_version,
      CASE WHEN n.setid IS NOT NULL THEN n.manufacturer ELSE p.manufacturer END AS manufacturer,
      CASE WHEN n.setid IS NULL THEN NULL WHEN p.setid IS NULL THEN 'added' WHEN n.manufacturer IS DISTINCT FROM p.manufacturer THEN 'updated'
        ELSE 'unchanged' END AS status
    FROM (SELECT * FROM labeldocs WHERE manufacturer <> 'de') n
    FULL JOIN (SELECT setid, spl_version, CASE WHEN manufacturer = 'fr' THEN 'old' ELSE manufacturer END AS manufacturer
      FROM labeldocs JOIN documents ON doc_id = label_id WHERE source <> 'src5') p
    ON n.setid = p.setid AND n.spl_version IS NOT DISTINCT FROM p.spl_version)""")
def label_upsert(spark, sf):
    """A load without German labels against a store without one source and with old French makers."""
    old, new = old_new_labels(spark, sf)
    diff = upsert.upsert(old, new, ["setid", "spl_version"], LABEL_FIELDS, as_of=F.lit(AS_OF).cast("timestamp"))
    return diff.select("setid", "spl_version", "manufacturer", "status", "updated_at")


def old_new_labels(spark, sf):
    docs = roles.labels(spark, sf)
    five = table(spark, sf, "documents").where("source = 'src5'").select(F.col("doc_id").alias("label_id"))
    old = _stamped(
        docs.join(five, "label_id", "left_anti").withColumn(
            "manufacturer", F.when(F.col("manufacturer") == "fr", "old").otherwise(F.col("manufacturer"))),
        updated_at="2024-01-01 00:00:00")
    return old, docs.where("manufacturer <> 'de'")


def _old_new_synonyms(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("drug_id"), F.col("o_orderpriority").alias("synonym"), F.lit("brand").alias("synonym_type"),
        F.year("o_orderdate").alias("y"))
    cut_year = 1995
    return rows.where(F.col("y") < cut_year).drop("y"), rows.where(F.col("y") >= cut_year).drop("y")


SYN = """o AS (SELECT DISTINCT o_custkey AS drug_id, o_orderpriority AS synonym FROM orders WHERE year(o_orderdate) < 1995),
    n AS (SELECT DISTINCT o_custkey AS drug_id, o_orderpriority AS synonym FROM orders WHERE year(o_orderdate) >= 1995),
    s AS (SELECT drug_id, synonym, CASE WHEN n.f AND o.f THEN 'unchanged' WHEN n.f THEN 'added'
        WHEN drug_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') THEN 'deleted' END AS status
      FROM (SELECT *, true AS f FROM o) o FULL JOIN (SELECT *, true AS f FROM n) n USING (drug_id, synonym))"""


@query(f"WITH {SYN} SELECT drug_id, synonym, 'brand' AS synonym_type, status FROM s")
def synonym_sync(spark, sf):
    old, new = _old_new_synonyms(spark, sf)
    named = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("drug_id"))
    return upsert.reconcile(old, new, named, "drug_id")


@query(f"""WITH {SYN} SELECT c_custkey AS drug_id, c_mktsegment AS term_type,
    CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'added'
      WHEN c_acctbal < 0 OR EXISTS (SELECT 1 FROM s WHERE s.drug_id = c_custkey AND s.status IN ('added', 'deleted')) THEN 'updated'
      ELSE 'unchanged' END AS status FROM customer""")
def drug_upsert(spark, sf):
    """Customers as drugs: changed by a field of their own or by their synonyms."""
    own = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("drug_id"), F.col("c_name").alias("normalized_name"), F.col("c_mktsegment").alias("term_type"),
        F.col("c_acctbal").alias("match_score"))
    old = own.where("term_type <> 'MACHINERY'").withColumn("match_score", F.abs("match_score"))
    new = own.where("term_type <> 'BUILDING'")
    before, after = _old_new_synonyms(spark, sf)
    child = upsert.reconcile(before, after, new, "drug_id").where(F.col("status").isin("added", "deleted"))
    diff = upsert.upsert(old, new, ["drug_id"], ["normalized_name", "term_type", "match_score"], also_changed=child)
    return diff.select("drug_id", "term_type", "status")


def _section_diff(spark, sf):
    docs = roles.sections(spark, sf)
    lang = table(spark, sf, "documents").select(F.col("doc_id").alias("label_id"), "lang")
    both = docs.join(lang, "label_id")
    old = both.where("lang <> 'de'").withColumn(
        "text", F.when((F.col("lang") == "fr") & (F.col("section_key") == "boxed_warning"), F.upper("text")).otherwise(F.col("text")))
    return upsert.upsert(old.drop("lang"), both.drop("lang"), ["label_id", "section_code"], ["text", "found", "section_name"])


SECTION_STATUS = """CASE WHEN lang = 'de' THEN 'added' WHEN lang = 'fr' AND section_key = 'boxed_warning' AND text <> upper(text) THEN 'updated'
    ELSE 'unchanged' END"""


@query(f"SELECT label_id, section_code, {SECTION_STATUS} AS status, md5(text) AS text_hash FROM sections")
def section_sync(spark, sf):
    return _section_diff(spark, sf).select("label_id", "section_code", "status", F.md5("text").alias("text_hash"))


@query(f"""SELECT rxcui, count(*) FILTER (s = 'added') AS added, count(*) FILTER (s = 'updated') AS updated,
    count(*) FILTER (s = 'unchanged') AS unchanged FROM (SELECT rxcui, {SECTION_STATUS} AS s FROM sections JOIN links USING (label_id)
      JOIN drugs USING (drug_id)) GROUP BY 1""")
def ingest_report(spark, sf):
    """Section counts per drug for a load."""
    owner = roles.links(spark, sf).join(roles.drugs(spark, sf), "drug_id").select("label_id", "rxcui")
    return upsert.status_report(_section_diff(spark, sf).join(owner, "label_id"), ["rxcui"])


@query(f"""SELECT link_id, CASE WHEN source = 'src7' THEN 'added' WHEN n_chars > 3000 THEN 'updated' ELSE 'unchanged' END AS status,
    TIMESTAMP '{AS_OF}' AS retrieved_at FROM links JOIN documents ON doc_id = link_id""")
def link_sync(spark, sf):
    """Links with larger counts for long documents; the check time moves for all of them."""
    links = roles.links(spark, sf).join(
        table(spark, sf, "documents").select(F.col("doc_id").alias("link_id"), "source", "n_chars"), "link_id")
    old = _stamped(links.where("source <> 'src7'"), retrieved_at="2024-01-01 00:00:00").drop("source", "n_chars")
    new = links.withColumn("total_candidates_found", F.when(F.col("n_chars") > 3000, 2).otherwise(1)).drop("source", "n_chars")
    diff = upsert.upsert(old, new, ["drug_id", "label_id"], ["evidence_status", "candidates_checked", "total_candidates_found"],
                         as_of=F.lit(AS_OF).cast("timestamp"), stamp=None, touch="retrieved_at")
    return diff.select("link_id", "status", "retrieved_at")


# Load ------------------------------------------------------------------------------------------

def load_sources(spark, sf):
    """What a load reads: related names, each source's whole list of documents as candidates, and label documents in XML, those that it asks for."""
    from pairlight.plans import ingest as plan
    from pairlight.sources import label_xml as lx

    drugs = roles.drugs(spark, sf).where(F.col("normalized_name").isNotNull())
    other = roles.synonyms(spark, sf).groupBy("drug_id").agg(F.sort_array(F.collect_list(F.struct("ord", "synonym", "synonym_type"))).alias("s"))
    of_kind = lambda k: F.transform(F.filter("s", lambda x: x["synonym_type"] == k), lambda x: x["synonym"])
    related = drugs.join(other, "drug_id", "left").select(
        "rxcui", F.lit("IN").alias("term_type"), of_kind("brand").alias("brand_names"), "generic_name", of_kind("synonym").alias("synonyms"))
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    found = table(spark, sf, "documents").select("source", "doc_id", "n_chars", place.alias("rank")).select(
        (roles.drug_number(F.col("source")) + 1000).cast("string").alias("rxcui"), "rank", F.col("doc_id").cast("string").alias("setid"),
        F.col("n_chars").cast("string").alias("spl_version"), F.lit("candidate").alias("title"), F.lit(None).cast("string").alias("published_date"))
    documents = lambda wanted: lx.parse_labels(label_xml(spark, sf).withColumn("doc", F.col("doc").cast("string")).join(wanted, "doc", "left_semi"))
    errors = drugs.where("drug_id % 7 = 3").select(F.col("input_name").alias("name"), F.lit("timeout").alias("error"))
    return plan.Sources(drugs.select("rxcui", F.col("normalized_name").alias("concept_name")), related, found, documents, errors)


def load_names(spark, sf):
    """(pos, name): the drugs' names, and names of no drug."""
    drugs = roles.drugs(spark, sf).where(F.col("normalized_name").isNotNull())
    return drugs.select(F.col("drug_id").alias("pos"), F.col("input_name").alias("name")).unionByName(
        table(spark, sf, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("pos"), F.concat(F.lit("zz-"), "r_regionkey").alias("name")))


LOADED = """n AS (SELECT drug_id AS pos, input_name AS name, rxcui, drug_id, drug_id % 7 = 3 AS broke FROM drugs WHERE normalized_name IS NOT NULL
      UNION ALL SELECT 1000 + r_regionkey, 'zz-' || r_regionkey, NULL, NULL, false FROM region),
    f AS (SELECT substr(source, 4)::BIGINT AS drug_id, arg_min(lang, doc_id) AS lang, min(doc_id) AS first_doc, count(*) AS total FROM documents GROUP BY 1),
    r AS (SELECT *, rxcui IS NOT NULL AND NOT broke AS known, rxcui IS NOT NULL AND NOT broke AND lang <> 'de' AS labelled FROM n LEFT JOIN f USING (drug_id))"""


@query(f"""WITH {LOADED}
    SELECT pos, name, CASE WHEN known THEN rxcui END AS rxcui, CASE WHEN broke THEN 'error' WHEN known THEN 'exact' ELSE 'none' END AS match_type,
      CASE WHEN broke THEN 'timeout' END AS error, CASE WHEN known THEN 'added' ELSE 'failed' END AS drug_status,
      CASE WHEN labelled THEN 'added' END AS label_status, CASE WHEN labelled THEN 'added' END AS link_status,
      CASE WHEN labelled THEN 'interaction_evidence_found' WHEN known THEN 'error' END AS evidence_status,
      CASE WHEN labelled THEN 7 ELSE 0 END AS sections_added, CASE WHEN labelled THEN 1 END AS candidates_checked, CASE WHEN labelled THEN total END AS total_candidates_found FROM r""")
def ingest_names(spark, sf):
    """The load of drug names, some unknown and some with a broken lookup, with label documents in XML.

    All documents of a source are its candidates, of which the load itself takes three. German ones cannot be read, so a
    lookup that meets one first is an error.
    """
    from pairlight.plans import ingest as plan

    after, report = plan.ingest(load_names(spark, sf), plan.Store.empty(spark), load_sources(spark, sf), F.lit(AS_OF).cast("timestamp"))
    links = after.drug_label_links.join(after.drugs.select("drug_id", "rxcui"), "drug_id").select(
        "rxcui", "candidates_checked", F.col("total_candidates_found").cast("long").alias("total_candidates_found"))
    return report.join(links, "rxcui", "left").select(
        "pos", "name", "rxcui", "match_type", "error", "drug_status", "label_status", "link_status", "evidence_status", "sections_added", "candidates_checked", "total_candidates_found")


# Stored tables --------------------------------------------------------------------------------

@query("""SELECT label_id, setid, spl_version, title, manufacturer, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS version FROM (
    SELECT doc_id AS label_id, 'set-' || doc_id AS setid, CASE WHEN lang <> 'es' THEN n_chars::VARCHAR END AS spl_version,
      'label ' || doc_id AS title, lang AS manufacturer, lang FROM documents)""")
def stored_labels(spark, sf):
    """Labels written as two complete versions and read back: German labels from the second, the others from the first."""
    folder = f"{work_folder(spark)}/store-{uuid.uuid4().hex}"
    labels = roles.labels(spark, sf)
    for version, rows in ((1, labels), (2, labels.where("manufacturer = 'de'"))):
        tables.write_snapshot(rows, folder, "labels", version)
        tables.commit(spark, folder, "query", version, version)
    newest = tables.latest(spark, folder)
    read = lambda v: tables.read_snapshot(spark, folder, "labels", v).withColumn("version", F.lit(v))
    both = read(newest).unionByName(read(newest - 1).where("manufacturer <> 'de'"))
    return both.select("label_id", "setid", "spl_version", "title", "manufacturer", "version")


# Chunk index ---------------------------------------------------------------------------------

def _chunk_diff(spark, sf):
    """Load without Spanish labels against an index with doubled French and upper-case German text."""
    drugs, labels, links, sections = (f(spark, sf) for f in (roles.drugs, roles.labels, roles.links, roles.sections))
    before = sections.join(labels.select("label_id", "manufacturer"), "label_id").withColumn(
        "text", F.when(F.col("manufacturer") == "fr", F.concat_ws(" ", "text", "text", "text", "text"))
        .when(F.col("manufacturer") == "de", F.upper("text")).otherwise(F.col("text"))).drop("manufacturer")
    one = F.col("section_key") != "contraindications"
    old = roles.EMBEDDER(chunking.build_chunks(drugs, labels, before.where(one), links), "text", "embedding")
    new = chunking.build_chunks(drugs, labels.where("manufacturer <> 'es'"), sections, links)
    return index.index_diff(old, new)


CHUNK_DIFF = f"""old AS (SELECT 'link-' || link_id || '-section-' || db_record_id || '-chunk-' || i AS chunk_id, link_id, db_record_id,
      {o.CHUNK_TEXT} AS text FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, {o.CHUNK_N} AS n FROM (SELECT * REPLACE (
        CASE WHEN lang = 'fr' THEN text || ' ' || text || ' ' || text || ' ' || text WHEN lang = 'de' THEN upper(text) ELSE text END AS text)
        FROM usable WHERE section_key <> 'contraindications')))),
    new AS (SELECT chunk_id, link_id, db_record_id, text FROM chunks WHERE manufacturer <> 'es'),
    d AS (SELECT coalesce(n.chunk_id, p.chunk_id) AS chunk_id, coalesce(n.link_id, p.link_id) AS link_id,
      coalesce(n.db_record_id, p.db_record_id) AS db_record_id, coalesce(n.text, p.text) AS text,
      CASE WHEN p.chunk_id IS NULL THEN 'added' WHEN n.chunk_id IS NULL THEN
          CASE WHEN p.db_record_id IN (SELECT db_record_id FROM new) THEN 'deleted' END
        WHEN n.text <> p.text THEN 'updated' ELSE 'unchanged' END AS status
      FROM new n FULL JOIN old p USING (chunk_id))"""


@query(f"WITH {CHUNK_DIFF} SELECT chunk_id, status, md5(text) AS text_hash FROM d")
def chunk_diff(spark, sf):
    return _chunk_diff(spark, sf).select("chunk_id", "status", F.md5("text").alias("text_hash"))


@query(f"""WITH {CHUNK_DIFF}, e AS (SELECT chunk_id, {o.hash_vec('text')} AS v FROM d WHERE status IS DISTINCT FROM 'deleted')
    SELECT chunk_id, j AS pos, round(v[j + 1], 9) AS value FROM e, range(16) t(j)""")
def embed_changes(spark, sf):
    """Next index: new vectors for changed chunks, stored vectors for the others."""
    rows = index.embed_changes(_chunk_diff(spark, sf), roles.EMBEDDER)
    return rows.select("chunk_id", F.posexplode("embedding").alias("pos", "value")).select(
        "chunk_id", F.col("pos").cast("long").alias("pos"), F.round("value", 9).alias("value"))


@query(f"""WITH {CHUNK_DIFF} SELECT (SELECT count(DISTINCT drug_id) FROM links JOIN drugs USING (drug_id) JOIN documents ON doc_id = label_id WHERE documents.lang <> 'es') AS drugs_processed,
    count(DISTINCT db_record_id) FILTER (status <> 'deleted') AS sections_processed,
    (SELECT count(*) FROM sections JOIN links USING (label_id) JOIN drugs USING (drug_id) WHERE found AND lang <> 'es')
      - (SELECT count(DISTINCT db_record_id) FROM new) AS skipped_empty_sections,
    count(*) FILTER (status = 'added') AS chunks_added, count(*) FILTER (status = 'updated') AS chunks_updated,
    count(*) FILTER (status = 'unchanged') AS chunks_unchanged, count(*) FILTER (status = 'deleted') AS chunks_deleted_stale,
    (SELECT count(*) FROM links WHERE drug_id = 3) + (SELECT count(*) FROM sections JOIN links USING (label_id)
      WHERE found AND lang = 'de' AND drug_id <> 3) AS malformed_records_skipped FROM d""")
def index_report(spark, sf):
    """Every drug with a whole link counts, also one whose sections give no chunk."""
    loaded = roles.drugs(spark, sf), roles.labels(spark, sf).where("manufacturer <> 'es'"), roles.sections(spark, sf), roles.links(spark, sf)
    return index.index_report(_chunk_diff(spark, sf), chunking.rejects(*_orphaned(spark, sf)), *loaded)


# Pairs -----------------------------------------------------------------------------------------

@query("SELECT rxcui_a, rxcui_b, ord, query, query_type, array_to_string(scope, '|') AS scope FROM queries")
def pair_queries(spark, sf):
    known = roles.knowledge(spark, sf)
    ids = pe.searchable(roles.all_pairs(spark, sf, known))
    out = pairs.pair_queries(ids, pairs.drug_cards(known.drugs, known.terms()))
    return out.select("rxcui_a", "rxcui_b", F.col("ord").cast("long").alias("ord"), "query", "query_type", joined("scope").alias("scope"))


def _evidence(spark, sf):
    known = roles.knowledge(spark, sf)
    resolved = roles.all_pairs(spark, sf, known)
    return resolved, pe.evidence_for(pe.searchable(resolved), known, roles.EMBEDDER)


@query("""SELECT rxcui_a, rxcui_b, chunk_id, place, evidence_id, distance, rxcui, classification, mentions_a, mentions_b,
    array_to_string(matched_terms_a, '|') AS matched_terms_a, array_to_string(matched_terms_b, '|') AS matched_terms_b, class_match_a, class_match_b,
    array_to_string(retrieval_queries, '|') AS retrieval_queries, array_to_string(retrieval_query_types, '|') AS retrieval_query_types
    FROM evidence""")
def pair_evidence(spark, sf):
    """Ranked and classified evidence of every pair that the regimens ask for."""
    _, found = _evidence(spark, sf)
    lists = ["matched_terms_a", "matched_terms_b", "retrieval_queries", "retrieval_query_types"]
    return found.select("rxcui_a", "rxcui_b", "chunk_id", F.col("place").cast("long").alias("place"), "evidence_id", "distance", "rxcui",
                        "classification", "mentions_a", "mentions_b", "class_match_a", "class_match_b",
                        *[joined(c).alias(c) for c in lists])


@query("SELECT * FROM statuses")
def pair_status(spark, sf):
    resolved, found = _evidence(spark, sf)
    return pe.statuses_for(resolved, found)


_STATUS_ROWS = ", ".join(f"({o.quote(k)}, {', '.join(o.quote(x) for x in v)})" for k, v in vocab.STATUS_LABELS.items())


@query(f"""SELECT drug_a, drug_b, label, tone, description FROM statuses
    JOIN (VALUES {_STATUS_ROWS}) AS v(evidence_status, label, tone, description) USING (evidence_status)""")
def status_labels(spark, sf):
    resolved, found = _evidence(spark, sf)
    return pairs.with_status_label(pe.statuses_for(resolved, found)).select("drug_a", "drug_b", "label", "tone", "description")


@query("""SELECT regimen_id, count(*) AS total_pairs, count(*) FILTER (evidence_status = 'pair_specific_evidence_found') AS n_pair_specific,
    count(*) FILTER (evidence_status = 'supporting_evidence_found') AS n_supporting,
    count(*) FILTER (evidence_status = 'insufficient_evidence') AS n_insufficient,
    count(*) FILTER (evidence_status = 'drug_not_found') AS n_not_found, count(*) FILTER (evidence_status = 'invalid_input') AS n_invalid,
    count(*) FILTER (evidence_status = 'retrieval_error') AS n_error
    FROM regpairs JOIN statuses USING (drug_a, drug_b) GROUP BY 1""")
def regimen_report(spark, sf):
    """From order lines as name lists to pair statuses per regimen."""
    known = roles.knowledge(spark, sf)
    return pe.check_regimens(roles.regimens(spark, sf, known), known, roles.EMBEDDER)


# Grounding ---------------------------------------------------------------------------------------

@query(f"""SELECT p.rxcui_a, p.rxcui_b, {o.quote(vocab.INSTRUCTIONS)} || chr(10) || chr(10) || 'Drug A: ' || a.normalized_name || chr(10) || 'Drug B: ' ||
      b.normalized_name || chr(10) || chr(10) || coalesce('EVIDENCE:' || chr(10) || e.b, 'EVIDENCE: none retrieved. There is no evidence to summarize.') AS prompt
    FROM pairids p JOIN drugs a ON a.rxcui = p.rxcui_a JOIN drugs b ON b.rxcui = p.rxcui_b LEFT JOIN (
      SELECT rxcui_a, rxcui_b, string_agg('[' || evidence_id || '] (relation: ' || classification || ', source drug: ' || c.drug_name || ', section: ' ||
        c.section_name || ')' || chr(10) || substr(c.text, 1, 1200) || chr(10), chr(10) ORDER BY place) AS b
      FROM evidence v JOIN chunks c USING (chunk_id) WHERE evidence_id IS NOT NULL GROUP BY 1, 2) e ON e.rxcui_a = p.rxcui_a AND e.rxcui_b = p.rxcui_b""")
def prompt_table(spark, sf):
    resolved, found = _evidence(spark, sf)
    return grounding.prompts(pe.searchable(resolved), found, roles.drugs(spark, sf))


@query("""SELECT v.rxcui_a, v.rxcui_b, v.evidence_id, md5(c.text) AS text_hash, c.drug_name, c.rxcui, c.section_name, c.section_code,
    c.manufacturer, c.source_url, v.classification FROM evidence v JOIN chunks c USING (chunk_id) WHERE evidence_id IS NOT NULL""")
def citation_rows(spark, sf):
    _, found = _evidence(spark, sf)
    return grounding.citations(found).withColumn("text_hash", F.md5("text")).drop("text")


PARSED_FIELDS = ["interaction_assessment", "evidence_summary", "safety_notice", "clinical_effect", "mechanism", "severity"]


@query(f"""SELECT answer_id, malformed, {', '.join(f"CASE WHEN NOT malformed THEN {f} END AS {f}" for f in PARSED_FIELDS)},
    CASE WHEN NOT malformed THEN array_to_string(cited_evidence_ids, '|') END AS cited FROM parsed""")
def parse_answers(spark, sf):
    out = grounding.parse_answers(roles.answers(spark, sf))
    return out.select("answer_id", "malformed", *PARSED_FIELDS, joined("cited_evidence_ids").alias("cited"))


CITED = """good AS (SELECT * FROM parsed WHERE NOT malformed),
    cited AS (SELECT g.answer_id, g.rxcui_a, g.rxcui_b, j AS pos, g.cited_evidence_ids[j] AS evidence_id FROM good g, range(1, 3) t(j)),
    found AS (SELECT c.*, v.classification, lower(v.text) AS t FROM cited c LEFT JOIN evidence v USING (rxcui_a, rxcui_b, evidence_id))"""


@query(f"WITH {CITED} SELECT answer_id, pos - 1 AS pos, evidence_id FROM found WHERE classification IS NULL")
def unknown_citations(spark, sf):
    _, found = _evidence(spark, sf)
    parsed = grounding.parse_answers(roles.answers(spark, sf)).where("not malformed")
    return grounding.unknown_citations(parsed, found).withColumn("pos", F.col("pos").cast("string"))


_PHRASES = "[" + ", ".join(o.quote(p) for p in vocab.FORBIDDEN_PHRASES) + "]"
CHECKS = f"""{CITED},
    per AS (SELECT answer_id, string_agg('''' || evidence_id || '''', ', ' ORDER BY pos) FILTER (classification IS NULL) AS unknown,
      bool_or(classification = 'pair_specific_evidence') AS pair, string_agg(t, ' ' ORDER BY pos) AS texts FROM found GROUP BY 1),
    base AS (SELECT g.*, s.evidence_status, p.unknown, coalesce(p.pair, false) AS pair, coalesce(p.texts, '') AS texts,
      lower(concat_ws(' ', nullif(evidence_summary, ''), nullif(clinical_effect, ''), nullif(mechanism, ''), nullif(safety_notice, ''))) AS alltext,
      CASE interaction_assessment WHEN 'insufficient_evidence' THEN 0 WHEN 'supporting_evidence_found' THEN 1 ELSE 2 END AS r1,
      CASE evidence_status WHEN 'insufficient_evidence' THEN 0 WHEN 'supporting_evidence_found' THEN 1 WHEN 'pair_specific_evidence_found' THEN 2 ELSE -1 END AS r2
      FROM good g LEFT JOIN per p USING (answer_id) LEFT JOIN idstatuses s USING (rxcui_a, rxcui_b)),
    issues AS (SELECT *, list_filter([
        'Cited unknown evidence id(s) not present in the supplied evidence: [' || unknown || '].',
        CASE WHEN r1 > r2 THEN 'Claimed interaction_assessment=''' || interaction_assessment || ''' but retrieval only supports ''' || coalesce(evidence_status, 'None') || '''.' END,
        'Response contains prohibited ''no interaction'' language: ''' || list_filter({_PHRASES}, lambda x: contains(alltext, x))[1] || '''.',
        CASE WHEN regexp_matches(alltext, 'https?://|www\\.') THEN 'Response contains a URL.' END,
        CASE WHEN NOT pair AND coalesce(trim(clinical_effect), '') <> '' THEN 'Pair-specific claim(s) in clinical_effect require at least one cited pair-specific evidence item.' END
      ], lambda x: x IS NOT NULL) AS fatal,
      (severity IS NOT NULL AND lower(severity) NOT IN {o.in_list(vocab.NULL_SEVERITIES)}) AS stated, contains(texts, lower(severity)) AS supported FROM base)"""


def _validated(spark, sf):
    resolved, found = _evidence(spark, sf)
    found = pe.cut(found)
    known = resolved.where("rxcui_a is not null and rxcui_b is not null")
    statuses = pe.statuses_for(known, found).select("rxcui_a", "rxcui_b", "evidence_status").distinct()
    parsed = pe.cut(grounding.parse_answers(roles.answers(spark, sf)))
    return found, statuses, parsed, grounding.validate(parsed.where("not malformed"), found, statuses)


@query(f"""WITH {CHECKS} SELECT answer_id, len(fatal) = 0 AS passed, array_to_string(fatal, '|') AS fatal_issues,
    CASE WHEN stated AND NOT supported THEN 'Severity ''' || severity || ''' was not found verbatim in the cited evidence text.' ELSE '' END AS corrections,
    CASE WHEN len(fatal) = 0 AND stated AND supported THEN severity END AS corrected_severity FROM issues""")
def grounding_checks(spark, sf):
    _, _, _, checked = _validated(spark, sf)
    return checked.select("answer_id", "passed", joined("fatal_issues").alias("fatal_issues"), joined("corrections").alias("corrections"),
                          "corrected_severity")


@query(f"""WITH {CHECKS},
    listed AS (SELECT rxcui_a, rxcui_b, string_agg(evidence_id, '|' ORDER BY evidence_id) AS ids FROM evidence WHERE evidence_id IS NOT NULL GROUP BY 1, 2),
    mine AS (SELECT answer_id, string_agg(evidence_id, '|' ORDER BY pos) FILTER (classification IS NOT NULL) AS ids FROM found GROUP BY 1),
    records AS (SELECT v.rxcui_a, v.rxcui_b, v.evidence_id, concat_ws('|', v.evidence_id, c.section_code, c.rxcui, v.classification, md5(c.text)) AS r FROM evidence v JOIN chunks c USING (chunk_id) WHERE v.evidence_id IS NOT NULL),
    allrec AS (SELECT rxcui_a, rxcui_b, string_agg(r, chr(10) ORDER BY evidence_id) AS recs FROM records GROUP BY 1, 2),
    minerec AS (SELECT answer_id, string_agg(r, chr(10) ORDER BY pos) AS recs FROM cited JOIN records USING (rxcui_a, rxcui_b, evidence_id) GROUP BY 1),
    e AS (SELECT p.*, coalesce(s.evidence_status, 'insufficient_evidence') AS status, i.fatal, i.stated, i.supported, coalesce(l.ids, '') AS listed, coalesce(m.ids, '') AS mine,
      coalesce(x.recs, '') AS listedrec, coalesce(y.recs, '') AS minerec, i.answer_id IS NOT NULL AS checked,
      CASE WHEN s.evidence_status = 'insufficient_evidence' THEN {o.quote(vocab.REASON_NO_EVIDENCE)}
        WHEN s.evidence_status IN {o.in_list(vocab.NO_TEXT_STATUSES)} THEN 'Cannot generate an explanation: retrieval result was ''' || s.evidence_status || '''.'
        WHEN s.evidence_status IS NULL OR l.ids IS NULL THEN {o.quote(vocab.REASON_NO_EVIDENCE)}
        WHEN p.malformed THEN 'LLM unavailable (OpenRouter): provider returned malformed output.'
        WHEN len(i.fatal) > 0 THEN {o.quote(vocab.REASON_REJECTED)} || array_to_string(i.fatal, '; ') END AS reason
      FROM parsed p LEFT JOIN idstatuses s USING (rxcui_a, rxcui_b) LEFT JOIN issues i USING (answer_id) LEFT JOIN listed l USING (rxcui_a, rxcui_b)
      LEFT JOIN mine m USING (answer_id) LEFT JOIN allrec x USING (rxcui_a, rxcui_b) LEFT JOIN minerec y USING (answer_id))
    SELECT answer_id, CASE WHEN reason IS NULL THEN 'llm_grounded' ELSE 'evidence_only' END AS mode,
      CASE WHEN reason IS NULL THEN interaction_assessment ELSE status END AS interaction_assessment,
      CASE WHEN reason IS NULL THEN evidence_summary END AS evidence_summary, CASE WHEN reason IS NULL THEN clinical_effect END AS clinical_effect,
      CASE WHEN reason IS NULL AND stated AND supported THEN severity END AS severity,
      CASE WHEN reason IS NULL THEN mine ELSE listed END AS cited_evidence,
      {o.quote('|'.join(vocab.LIMITATIONS))} || CASE WHEN reason IS NULL THEN '|' || limitations[1] ELSE '' END AS limitations,
      CASE WHEN reason IS NULL THEN safety_notice ELSE {o.quote(vocab.SAFETY_NOTICE)} END AS safety_notice, reason AS fallback_reason,
      md5(CASE WHEN reason IS NULL THEN minerec ELSE listedrec END) AS citations_hash,
      CASE WHEN checked THEN md5(concat_ws(chr(10), (len(fatal) = 0)::VARCHAR, array_to_string(fatal, '|'),
        CASE WHEN stated AND NOT supported THEN 'Severity ''' || severity || ''' was not found verbatim in the cited evidence text.' ELSE '' END,
        CASE WHEN len(fatal) = 0 AND stated AND supported THEN severity ELSE '' END)) END AS validation_hash FROM e""")
def explanations(spark, sf):
    """Every answer gets an explanation; a pair that no regimen asks for was not searched and has insufficient evidence."""
    found, statuses, parsed, checked = _validated(spark, sf)
    asked = parsed.select("answer_id", "rxcui_a", "rxcui_b").join(statuses, ["rxcui_a", "rxcui_b"], "left").withColumn(
        "evidence_status", F.coalesce("evidence_status", F.lit(vocab.INSUFFICIENT)))
    out = grounding.explain(asked, found, parsed.withColumn("failure", F.lit(None).cast("string")), checked)
    records = F.transform("citations", lambda c: F.concat_ws("|", c["evidence_id"], c["section_code"], c["rxcui"], c["classification"], F.md5(c["text"])))
    v = F.col("validation")
    said = F.when(v.isNotNull(), F.concat_ws("\n", v["passed"].cast("string"), joined(v["fatal_issues"]), joined(v["corrections"]), F.coalesce(v["corrected_severity"], F.lit(""))))
    return out.select("answer_id", "mode", "interaction_assessment", "evidence_summary", "clinical_effect", "severity",
                      joined("cited_evidence").alias("cited_evidence"), joined("limitations").alias("limitations"), "safety_notice", "fallback_reason",
                      F.md5(F.array_join(records, "\n")).alias("citations_hash"), F.md5(said).alias("validation_hash"))


def _failure_sql(family: str) -> str:
    out = []
    for category, codes, markers in vocab.FAILURE_RULES[family]:
        tests = [f"contains(message, {o.quote(m)})" for m in markers]
        if codes:
            tests.append(f"status_code IN ({', '.join(map(str, codes))})")
        out.append(f"WHEN provider = {o.quote(family)} AND ({' OR '.join(tests)}) THEN {o.quote(category)}")
    return " ".join(out)


_WORDS = {"view": "request timed out", "click": "Rate limit reached", "signup": "no auth header", "purchase": "connection reset", "error": "failed"}


@query(f"""SELECT *, CASE {' '.join(f"WHEN category = {o.quote(c)} THEN 'LLM unavailable (' || provider || '): {d}.'" for c, d in vocab.FAILURE_DETAIL.items())} END AS reason FROM (
    SELECT event_id, provider, CASE {' '.join(_failure_sql(f) for f in vocab.FAILURE_RULES)} ELSE 'unavailable' END AS category FROM (
    SELECT event_id, (['Gemini', 'xAI', 'OpenRouter'])[user_id % 3 + 1] AS provider,
      lower(CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _WORDS.items())} END || ' ' || event_id) AS message,
      (props::JSON ->> '$.k')::INT + 400 AS status_code FROM events))""")
def failure_reasons(spark, sf):
    words = F.create_map(*[F.lit(x) for kv in _WORDS.items() for x in kv])
    log = table(spark, sf, "events").select(
        "event_id", F.array(F.lit("Gemini"), F.lit("xAI"), F.lit("OpenRouter"))[(F.col("user_id") % 3).cast("int")].alias("provider"),
        F.concat_ws(" ", words[F.col("event_type")], "event_id").alias("message"),
        (F.get_json_object("props", "$.k").cast("int") + 400).alias("status_code"))
    out = log.withColumn("category", grounding.failure_category(F.col("provider"), F.col("status_code"), F.col("message")))
    return out.select("event_id", "provider", "category", grounding.failure_reason(F.col("provider"), F.col("category")).alias("reason"))


# Events --------------------------------------------------------------------------------------------

@query("""SELECT event_type AS endpoint, user_id AS rxcui_a, count(*) AS n_requests, round(sum(value), 2) AS sum_latency, min(value) AS min_latency,
    max(value) AS max_latency, quantile_disc(value, 0.5) AS p50_latency, quantile_disc(value, 0.95) AS p95_latency FROM events GROUP BY 1, 2""")
def audit_rollup(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("endpoint"), F.col("user_id").alias("rxcui_a"), F.col("value").alias("latency_ms"))
    out = audit.audit_rollup(events, ["endpoint", "rxcui_a"]).drop("avg_latency")
    return out.withColumn("sum_latency", F.round("sum_latency", 2))


@query("""SELECT ts AS timestamp, 'interaction_check' AS event, event_id::VARCHAR AS request_id, event_type AS endpoint, user_id::VARCHAR AS rxcui_a,
    NULL::VARCHAR AS rxcui_b, NULL::VARCHAR AS evidence_status, NULL::VARCHAR AS llm_mode, round(value, 2) AS latency_ms,
    NULL::VARCHAR AS error_category FROM events""")
def audit_rows(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("request_id"), F.col("event_type").alias("endpoint"),
        F.col("user_id").cast("string").alias("rxcui_a"), F.col("value").alias("latency_ms"), "props")
    return audit.audit_rows(events, "interaction_check")


ADMIT = (5, 86400.0)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f AS (SELECT user_id, event_id, t, r, [t] AS hits, true AS allowed, 0.0::DOUBLE AS wait FROM e WHERE r = 1
      UNION ALL SELECT user_id, event_id, t, r, CASE WHEN len(kept) < {ADMIT[0]} THEN list_append(kept, t) ELSE kept END,
        len(kept) < {ADMIT[0]}, CASE WHEN len(kept) < {ADMIT[0]} THEN 0.0 ELSE greatest(0.0, {ADMIT[1]} - (t - kept[1]) / 1e6) END
      FROM (SELECT e.user_id, e.event_id, e.t, e.r, list_filter(f.hits, lambda h: e.t - h <= {int(ADMIT[1] * 1e6)}) AS kept
        FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))
    SELECT user_id, event_id, allowed, round(wait, 3) AS retry_after FROM f""")
def admission(spark, sf):
    from pairlight.streaming import admission as adm

    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    out = adm.admit_batch(events, key="user_id", ts="ts", order="event_id", limit=ADMIT[0], window_seconds=ADMIT[1])
    return out.select("user_id", "event_id", "allowed", F.round("retry_after", 3).alias("retry_after"))


# Queries of their own modules register when imported.
from pairlight.queries import models, stores, streams  # noqa: E402, F401
