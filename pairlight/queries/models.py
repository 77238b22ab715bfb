"""Registered queries around model hooks, with stand-ins for the models."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.functions import vectors
from pairlight.operators import grounding
from pairlight.plans import pair_evidence as pe
from pairlight.queries import oracle as o
from pairlight.queries import roles
from pairlight.queries.registry import _evidence, query
from pairlight.queries.roles import table

DIM = 8


def stand_in() -> vectors.TokenModel:
    """Words as tokens, numbered by a hash; a token's vector are multiples of its number."""
    known: dict[str, int] = {}

    def number(word: str) -> int:
        if word not in known:
            known[word] = int(hashlib.md5(word.encode()).hexdigest()[:6], 16)
        return known[word]

    def encode(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return (ids[:, :, None] * (2 * np.arange(DIM) + 1) % 65536) / 32768 - 1

    return lambda texts: [[number(w) for w in re.findall("[A-Za-z]+", t)] for t in texts], encode


@query(f"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+')[1 : {vocab.MAX_TOKENS}], lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT) AS ids FROM documents),
    m AS (SELECT doc_id, j AS pos, coalesce(list_avg(list_transform(ids, lambda x: (x * (2 * j + 1) % 65536) / 32768.0::DOUBLE - 1)), 0) AS v FROM t, range({DIM}) u(j))
    SELECT doc_id, pos, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 1e-12), 6) + 0 AS value FROM m""")
def model_embedding(spark, sf):
    """Whole documents through the token path of an embedding model: cut, padded by length, averaged under the mask, scaled."""
    docs = vectors.TokenEmbedder(stand_in, DIM)(table(spark, sf, "documents").select("doc_id", "text"), "text", "v")
    return docs.select("doc_id", F.posexplode("v").alias("pos", "value")).select("doc_id", F.col("pos").cast("long").alias("pos"), (F.round("value", 6) + 0).alias("value"))


def answering():
    """A generator that fails as the checksum of its prompt says: in kinds, by status, with a message, or not at all."""
    def make(prompt: str) -> str | None:
        n = int(hashlib.md5(prompt.encode()).hexdigest()[:4], 16) % 8
        if n == 0:
            raise grounding.CallFailed("slow", kind="timeout")
        if n == 1:
            raise grounding.CallFailed("", status=429)
        if n == 2:
            raise grounding.CallFailed("no auth header")
        if n == 3:
            raise ValueError("broken")
        return None if n == 4 else f"answer {n}"
    return make


@query("""WITH p AS (SELECT p.rxcui_a, p.rxcui_b, ('0x' || substr(md5(prompt), 1, 4))::INT % 8 AS n FROM prompted p)
    SELECT rxcui_a, rxcui_b, CASE WHEN n > 4 THEN 'answer ' || n END AS raw_text, CASE WHEN n = 0 THEN 2 ELSE 1 END AS attempts,
      CASE n WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'key_invalid' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'unavailable' END AS category FROM p""".replace(
    "FROM prompted p", f"""FROM (SELECT p.rxcui_a, p.rxcui_b, {o.quote(vocab.INSTRUCTIONS)} || chr(10) || chr(10) || 'Drug A: ' || a.normalized_name || chr(10) || 'Drug B: ' ||
      b.normalized_name || chr(10) || chr(10) || coalesce('EVIDENCE:' || chr(10) || e.b, 'EVIDENCE: none retrieved. There is no evidence to summarize.') AS prompt
    FROM pairids p JOIN drugs a ON a.rxcui = p.rxcui_a JOIN drugs b ON b.rxcui = p.rxcui_b LEFT JOIN (
      SELECT rxcui_a, rxcui_b, string_agg('[' || evidence_id || '] (relation: ' || classification || ', source drug: ' || c.drug_name || ', section: ' ||
        c.section_name || ')' || chr(10) || substr(c.text, 1, 1200) || chr(10), chr(10) ORDER BY place) AS b
      FROM evidence v JOIN chunks c USING (chunk_id) WHERE evidence_id IS NOT NULL GROUP BY 1, 2) e ON e.rxcui_a = p.rxcui_a AND e.rxcui_b = p.rxcui_b) p"""))
def generated_answers(spark, sf):
    """Every prompt sent to a generator that fails for some: what came of each call, its attempts and the failure's category."""
    resolved, found = _evidence(spark, sf)
    prompts = grounding.prompts(pe.searchable(resolved), found, roles.drugs(spark, sf))
    made = grounding.generate(prompts, answering, attempts=2)
    failed = F.col("raw_text").isNull()
    category = grounding.failure_category(F.lit("OpenRouter"), F.col("failure_status"), F.col("failure_message"), F.col("failure_kind"))
    return made.select("rxcui_a", "rxcui_b", "raw_text", "attempts", F.when(failed, category).alias("category"))
