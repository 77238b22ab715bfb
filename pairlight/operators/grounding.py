"""Prompts, answer parsing, grounding checks and assembled explanations, all as table jobs.

Answers are keyed by answer_id and name their pair by rxcui_a and rxcui_b.
Evidence is the ranked evidence of pairs; only rows with an evidence_id count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.functions import text as tx

PAIR = ["rxcui_a", "rxcui_b"]


def citations(evidence: DataFrame) -> DataFrame:
    """Evidence rows in the shape of a citation."""
    return evidence.where(F.col("evidence_id").isNotNull()).select(
        *PAIR, "evidence_id", "text", "drug_name", "rxcui", "section_name", "section_code", "manufacturer",
        "source_url", "classification",
    )


def prompts(pairs: DataFrame, evidence: DataFrame, names: DataFrame, instructions: str = vocab.INSTRUCTIONS,
            max_chars: int = vocab.MAX_EVIDENCE_CHARS) -> DataFrame:
    """(rxcui_a, rxcui_b, prompt): instructions, the two names, and the numbered evidence in order.

    A pair without evidence says so. The cut of each excerpt is part of the format.
    """
    orb = lambda c: F.coalesce(F.col(c), F.lit("None"))
    block = F.concat(
        F.lit("["), F.col("evidence_id"), F.lit("] (relation: "), F.col("classification"),
        F.lit(", source drug: "), orb("drug_name"), F.lit(", section: "), orb("section_name"), F.lit(")\n"),
        F.substring("text", 1, max_chars), F.lit("\n"),
    )
    blocks = (
        evidence.where(F.col("evidence_id").isNotNull())
        .groupBy(*PAIR)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("place"), block.alias("b")))).alias("_b"))
        .select(*PAIR, F.array_join(F.transform("_b", lambda x: x["b"]), "\n").alias("_e"))
    )
    side = lambda s: names.select(F.col("rxcui").alias(f"rxcui_{s}"), F.col("normalized_name").alias(f"_n{s}"))
    return (
        pairs.select(*PAIR).join(side("a"), "rxcui_a").join(side("b"), "rxcui_b").join(blocks, PAIR, "left")
        .select(*PAIR, F.concat(
            F.lit(instructions), F.lit("\n\nDrug A: "), F.col("_na"), F.lit("\nDrug B: "), F.col("_nb"), F.lit("\n\n"),
            F.coalesce(F.concat(F.lit("EVIDENCE:\n"), F.col("_e")),
                       F.lit("EVIDENCE: none retrieved. There is no evidence to summarize.")),
        ).alias("prompt"))
    )


def strip_fences(text: Column) -> Column:
    """Text without a surrounding code fence and its language mark."""
    clean = tx.strip(text)
    inner = F.regexp_replace(F.regexp_replace(clean, "^`+", ""), r"`+\z", "")
    inner = F.regexp_replace(inner, "^(?i:json)", "")
    return tx.strip(F.when(F.startswith(clean, F.lit("```")), inner).otherwise(clean))


def parse_answers(answers: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Adds the answer's fields and malformed = true unless it is one JSON object of the closed shape."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    allowed = [*vocab.ANSWER_REQUIRED, *vocab.ANSWER_OPTIONAL, *vocab.ANSWER_LISTS]
    out = answers.withColumn("_c", strip_fences(F.col(raw))).withColumn("_v", F.try_parse_json("_c"))
    has = lambda f: F.array_contains("_k", f)

    checks = [F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")),
              F.size(F.array_except("_k", F.array(*[F.lit(a) for a in allowed]))) == 0]
    for f in vocab.ANSWER_REQUIRED:
        checks.append(has(f) & (kind(f"$.{f}") == "STRING"))
    for f in vocab.ANSWER_OPTIONAL:
        checks.append(~has(f) | kind(f"$.{f}").isin("STRING", "VOID"))
    for f in vocab.ANSWER_LISTS:
        items = F.try_variant_get("_v", f"$.{f}", "array<string>")
        checks.append(~has(f) | (kind(f"$.{f}").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(items, lambda x: x.isNull())))
    text = lambda f: F.try_variant_get("_v", f"$.{f}", "string")
    checks.append(text("interaction_assessment").isin(*vocab.ASSESSMENTS))
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.coalesce(c, F.lit(False))
    out = out.withColumn("_k", F.coalesce(F.json_object_keys("_c"), F.array().cast("array<string>")))
    out = out.withColumn("malformed", ~ok)
    fields = [F.when(~F.col("malformed"), text(f)).alias(f) for f in (*vocab.ANSWER_REQUIRED, *vocab.ANSWER_OPTIONAL)]
    lists = [
        F.when(~F.col("malformed"), F.coalesce(F.try_variant_get("_v", f"$.{f}", "array<string>"),
                                               F.array().cast("array<string>"))).alias(f)
        for f in vocab.ANSWER_LISTS
    ]
    return out.select(*answers.columns, "malformed", *fields, *lists)


def cited_evidence(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per cited id (answer_id, pos, evidence_id) with its evidence; known is false for invented ids."""
    cited = answers.select("answer_id", *PAIR, F.posexplode("cited_evidence_ids").alias("pos", "evidence_id"))
    known = citations(evidence).withColumn("_known", F.lit(True))
    return cited.join(known, [*PAIR, "evidence_id"], "left").withColumn(
        "known", F.coalesce("_known", F.lit(False))).drop("_known")


def unknown_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited ids that the supplied evidence does not hold."""
    ids = evidence.where(F.col("evidence_id").isNotNull()).select(*PAIR, "evidence_id")
    return answers.select("answer_id", *PAIR, F.posexplode("cited_evidence_ids").alias("pos", "evidence_id")).join(
        ids, [*PAIR, "evidence_id"], "left_anti"
    ).select("answer_id", "pos", "evidence_id")


def validate(answers: DataFrame, evidence: DataFrame, statuses: DataFrame) -> DataFrame:
    """Six checks per parsed answer: passed, fatal_issues, corrections, corrected_severity.

    statuses: (rxcui_a, rxcui_b, evidence_status). An answer cites a bounded list
    of ids, so the texts gathered per answer are those of its own citations.
    """
    per_answer = cited_evidence(answers, evidence).groupBy("answer_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("known"), F.struct("pos", "evidence_id")))).alias("_u"),
        F.bool_or(F.col("classification") == vocab.PAIR_SPECIFIC).alias("_pair"),
        F.sort_array(F.collect_list(F.when(F.col("known"), F.struct("pos", F.lower("text").alias("t"))))).alias("_t"),
    )
    rows = answers.join(per_answer, "answer_id", "left").join(
        statuses.select(*PAIR, "evidence_status"), PAIR, "left")
    unknown = F.transform(F.coalesce("_u", F.array()), lambda u: F.concat(F.lit("'"), u["evidence_id"], F.lit("'")))
    texts = F.array_join(F.transform(F.coalesce("_t", F.array()), lambda t: t["t"]), " ")
    rank = lambda c, default: F.coalesce(F.nullif(F.array_position(
        F.array(*[F.lit(a) for a in vocab.ASSESSMENTS]), F.col(c)), F.lit(0)), F.lit(default))
    fields = ("evidence_summary", "clinical_effect", "mechanism", "safety_notice")
    joined = F.lower(F.array_join(F.filter(F.array(*fields), lambda x: x != ""), " "))
    phrase = F.get(F.filter(F.array(*[F.lit(p) for p in vocab.FORBIDDEN_PHRASES]),
                            lambda p: F.contains(F.col("_all"), p)), F.lit(0))
    claims = F.filter(F.array(*[
        F.when(tx.strip(F.coalesce(F.col(c), F.lit(""))) != "", F.lit(c)) for c in ("clinical_effect", "mechanism")
    ]), lambda x: x.isNotNull())
    severity = tx.fold(F.col("severity"))
    stated = F.col("severity").isNotNull() & ~severity.isin(*vocab.NULL_SEVERITIES)
    supported = F.contains(F.col("_texts"), severity)
    issues = F.array(
        F.when(F.size("_unknown") > 0, F.concat(
            F.lit("Cited unknown evidence id(s) not present in the supplied evidence: ["),
            F.array_join("_unknown", ", "), F.lit("]."))),
        F.when(rank("interaction_assessment", 99) > rank("evidence_status", -1), F.concat(
            F.lit("Claimed interaction_assessment='"), F.col("interaction_assessment"),
            F.lit("' but retrieval only supports '"), F.coalesce("evidence_status", F.lit("None")), F.lit("'."))),
        F.when(F.col("_phrase").isNotNull(), F.concat(
            F.lit("Response contains prohibited 'no interaction' language: '"), F.col("_phrase"), F.lit("'."))),
        F.when(F.col("_all").rlike("(?i)" + vocab.URL_PATTERN), F.lit("Response contains a URL.")),
        F.when(~F.coalesce("_pair", F.lit(False)) & (F.size("_claims") > 0), F.concat(
            F.lit("Pair-specific claim(s) in "), F.array_join("_claims", ", "),
            F.lit(" require at least one cited pair-specific evidence item."))),
    )
    return (
        rows.withColumn("_all", joined).withColumn("_texts", texts).withColumn("_unknown", unknown)
        .withColumn("_claims", claims).withColumn("_phrase", phrase)
        .withColumn("fatal_issues", F.filter(issues, lambda i: i.isNotNull()))
        .withColumn("passed", F.size("fatal_issues") == 0)
        .withColumn("corrections", F.when(stated & ~supported, F.array(F.concat(
            F.lit("Severity '"), F.col("severity"), F.lit("' was not found verbatim in the cited evidence text."))))
            .otherwise(F.array().cast("array<string>")))
        .withColumn("corrected_severity", F.when(F.col("passed") & stated & supported, F.col("severity")))
        .select("answer_id", *PAIR, "passed", "fatal_issues", "corrections", "corrected_severity")
    )


def failure_category(provider: Column, status_code: Column, message: Column, kind: Column | None = None) -> Column:
    """Category of a failed call: its kind where the caller knows one (a key of FAILURE_DETAIL), else by
    status code or marker in the message, in the provider's order."""
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(provider == "disabled", F.lit("disabled"))
    if kind is not None:
        out = out.when(kind.isin(*vocab.FAILURE_DETAIL), kind)
    for family, rules in vocab.FAILURE_RULES.items():
        for category, codes, markers in rules:
            test = F.lit(False)
            for marker in markers:
                test = test | F.contains(text, F.lit(marker))
            if codes:
                test = test | F.coalesce(status_code.isin(*codes), F.lit(False))
            out = out.when((provider == family) & test, F.lit(category))
        out = out.when(provider == family, F.lit("unavailable"))
    return out.otherwise(F.lit("other"))


def failure_reason(provider: Column, category: Column) -> Column:
    """Text shown for a failure; never holds what the provider said."""
    table = F.create_map(*[F.lit(v) for kv in vocab.FAILURE_DETAIL.items() for v in kv])
    detail = F.coalesce(F.try_element_at(table, category), F.lit(vocab.FAILURE_DETAIL["other"]))
    return F.when(category == "disabled", F.lit(vocab.FAILURE_DISABLED)).otherwise(
        F.format_string(vocab.FAILURE_FORMAT, provider, detail))


def explain(pairs: DataFrame, evidence: DataFrame, answers: DataFrame, validations: DataFrame) -> DataFrame:
    """One explanation per requested answer: grounded text that passed all checks, else evidence only.

    pairs:   (answer_id, rxcui_a, rxcui_b, evidence_status)
    answers: parsed answers with provider and failure (category or null); a pair
             without an answer row was not sent to any provider.

    `citations` holds the whole records behind `cited_evidence`, in its order;
    `validation` is null for answers that were not checked.
    """
    # At most as many citations as a pair has evidence ids.
    fields = [c for c in citations(evidence).columns if c not in PAIR]
    listed = citations(evidence).groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_records")).select(
        *PAIR, "_records", F.transform("_records", lambda r: r["evidence_id"]).alias("_listed"))
    known = (
        cited_evidence(answers.where(~F.col("malformed")), evidence).where("known")
        .groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("pos", "evidence_id"))).alias("_cited"))
        .select("answer_id", F.transform("_cited", lambda c: c["evidence_id"]).alias("_cited"))
    )
    rows = (
        pairs.select("answer_id", *PAIR, "evidence_status")
        .join(answers.drop(*PAIR), "answer_id", "left")
        .join(validations.drop(*PAIR), "answer_id", "left")
        .join(known, "answer_id", "left")
        .join(listed, PAIR, "left")
    )
    listed_ids = F.coalesce("_listed", F.array().cast("array<string>"))
    cited_ids = F.coalesce("_cited", F.array().cast("array<string>"))
    records = lambda ids: F.transform(ids, lambda i: F.get(F.filter("_records", lambda r: r["evidence_id"] == i), F.lit(0)))
    checked = F.when(F.col("passed").isNotNull(), F.struct("passed", "fatal_issues", "corrections", "corrected_severity"))
    reason = (
        F.when(F.col("evidence_status") == vocab.INSUFFICIENT, F.lit(vocab.REASON_NO_EVIDENCE))
        .when(F.col("evidence_status").isin(*vocab.NO_TEXT_STATUSES),
              F.format_string(vocab.REASON_STATUS, F.col("evidence_status")))
        .when(F.size(listed_ids) == 0, F.lit(vocab.REASON_NO_EVIDENCE))
        .when(F.col("provider").isNull(), F.lit(vocab.FAILURE_DISABLED))
        .when(F.col("failure").isNotNull(), failure_reason(F.col("provider"), F.col("failure")))
        .when(F.col("malformed"), failure_reason(F.col("provider"), F.lit("malformed")))
        .when(~F.col("passed"), F.concat(F.lit(vocab.REASON_REJECTED), F.array_join("fatal_issues", "; ")))
    )
    grounded = F.col("fallback_reason").isNull()
    only = lambda c: F.when(grounded, F.col(c)).alias(c)
    return rows.withColumn("fallback_reason", reason).select(
        "answer_id", *PAIR,
        F.when(grounded, "llm_grounded").otherwise("evidence_only").alias("mode"),
        F.when(grounded, F.col("interaction_assessment")).otherwise(F.col("evidence_status")).alias("interaction_assessment"),
        only("evidence_summary"), only("clinical_effect"), only("mechanism"),
        F.when(grounded, F.col("corrected_severity")).alias("severity"),
        F.when(grounded, cited_ids).otherwise(listed_ids).alias("cited_evidence"),
        F.when(grounded, records(cited_ids)).otherwise(records(listed_ids)).alias("citations"),
        F.concat(F.array(*[F.lit(x) for x in vocab.LIMITATIONS]),
                 F.when(grounded, F.col("limitations")).otherwise(F.array().cast("array<string>"))).alias("limitations"),
        F.coalesce(F.when(grounded, F.nullif("safety_notice", F.lit(""))), F.lit(vocab.SAFETY_NOTICE)).alias("safety_notice"),
        "fallback_reason", checked.alias("validation"),
    )


class CallFailed(Exception):
    """A generator's call that gave no text; `kind` (a key of FAILURE_DETAIL) and `status` are given where they are known."""

    def __init__(self, message: str = "", kind: str | None = None, status: int | None = None):
        super().__init__(message)
        self.message, self.kind, self.status = message, kind, status


#: Failures that another attempt may mend.
PASSING = ("timeout", "rate_limit", "unavailable")


def generate(prompt_table: DataFrame, load, prompt: str = "prompt", out: str = "raw_text", attempts: int = 1, passing: tuple[str, ...] = PASSING) -> DataFrame:
    """Adds the generated text of each prompt, or what became of its call: failure_kind, failure_status, failure_message, attempts.

    `load` builds the generator, a function from a prompt to a text, once per Python
    worker. A call that raises ends its own row only, whatever it raises; of kinds in
    `passing` it is tried again, up to `attempts` times. A generator that returns no text
    has failed, too. Null prompts are not sent. failure_category maps the three failure
    columns. Calls are repeated if their task is.
    """
    def call(make, text: str | None) -> tuple:
        if text is None:
            return None, None, None, None, 0
        for k in range(1, attempts + 1):
            try:
                made = make(text)
                if made is not None:
                    return made, None, None, None, k
                failed = CallFailed("the generator returned no text")
            except CallFailed as e:
                failed = e
            except Exception as e:  # one row's failure is that row's result
                failed = CallFailed(f"{type(e).__name__}: {e}")
            if failed.kind not in passing:
                break
        return None, failed.kind, failed.status, failed.message, k

    schema = f"{out} string, failure_kind string, failure_status int, failure_message string, attempts int"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        make = load()
        for batch in batches:
            made = [call(make, None if pd.isna(p) else p) for p in batch]
            yield pd.DataFrame(made, columns=[c.split(" ")[0] for c in schema.split(", ")], index=batch.index).astype({"failure_status": "Int32"})

    return prompt_table.withColumn("_made", run(F.col(prompt))).select(*prompt_table.columns, "_made.*")
