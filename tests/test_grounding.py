import json

import pytest
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.operators import grounding

GOOD = {
    "interaction_assessment": vocab.PAIR_FOUND, "evidence_summary": "The label names both.", "clinical_effect": "Bleeding.",
    "mechanism": None, "severity": "serious", "cited_evidence_ids": ["EVIDENCE-001"], "limitations": ["one label"],
    "safety_notice": "Ask a pharmacist.",
}
EVIDENCE = [
    ("a", "b", 1, "EVIDENCE-001", "Serious bleeding with B.", "A drug", "a", vocab.PAIR_SPECIFIC),
    ("a", "b", 2, "EVIDENCE-002", "Plain text.", "B drug", "b", vocab.DRUG_SPECIFIC),
    ("a", "c", 1, "EVIDENCE-001", "Text on A.", "A drug", "a", vocab.DRUG_SPECIFIC),
    ("a", "b", 3, None, "Beyond the cap.", "B drug", "b", vocab.DRUG_SPECIFIC),
]


def evidence(spark):
    rows = [(*r, "Warnings", "1", "maker", "url") for r in EVIDENCE]
    return spark.createDataFrame(rows, "rxcui_a string, rxcui_b string, place int, evidence_id string, text string, drug_name string, rxcui string, "
                                 "classification string, section_name string, section_code string, manufacturer string, source_url string")


def statuses(spark):
    return spark.createDataFrame([("a", "b", vocab.PAIR_FOUND), ("a", "c", vocab.SUPPORT_FOUND), ("a", "d", vocab.INSUFFICIENT)],
                                 "rxcui_a string, rxcui_b string, evidence_status string")


def parsed(spark, answers):
    rows = [(k, *pair, "OpenRouter", raw) for k, (pair, raw) in answers.items()]
    df = spark.createDataFrame(rows, "answer_id string, rxcui_a string, rxcui_b string, provider string, raw_text string")
    return grounding.parse_answers(df)


def changed(**kw):
    return json.dumps({**GOOD, **kw})


def without(*names):
    return json.dumps({k: v for k, v in GOOD.items() if k not in names})


SHAPES = {
    "good": (json.dumps(GOOD), False), "fenced": ("```json\n" + json.dumps(GOOD) + "\n```", False), "bare fence": ("```\n" + json.dumps(GOOD) + "```", False),
    "spaces": ("  " + json.dumps(GOOD) + " \n", False), "only required": (without("clinical_effect", "mechanism", "severity", "cited_evidence_ids", "limitations"), False),
    "prose": ("The drugs interact.", True), "list": ("[1]", True), "string": ('"text"', True), "empty": ("", True), "cut": (json.dumps(GOOD)[:-5], True),
    "extra": (changed(extra=1), True), "missing": (without("safety_notice"), True), "number": (changed(evidence_summary=5), True),
    "enum": (changed(interaction_assessment="no_interaction"), True), "null required": (changed(evidence_summary=None), True),
    "ids not text": (changed(cited_evidence_ids=[1]), True), "null id": (changed(cited_evidence_ids=["EVIDENCE-001", None]), True),
    "ids not list": (changed(cited_evidence_ids="EVIDENCE-001"), True), "null list": (changed(limitations=None), True), "no ids": (changed(cited_evidence_ids=[]), False),
    "severity number": (changed(severity=3), True), "object severity": (changed(severity={"a": 1}), True),
}


def test_answer_shapes(spark):
    got = {r.answer_id: r for r in parsed(spark, {k: (("a", "b"), raw) for k, (raw, _) in SHAPES.items()}).collect()}
    assert {k: r.malformed for k, r in got.items()} == {k: bad for k, (_, bad) in SHAPES.items()}
    assert got["fenced"].cited_evidence_ids == ["EVIDENCE-001"] and got["fenced"].severity == "serious"
    assert got["only required"].cited_evidence_ids == [] and got["prose"].evidence_summary is None


CHECKS = {
    "good": (("a", "b"), {}, None, "serious"),
    "unknown id": (("a", "b"), {"cited_evidence_ids": ["EVIDENCE-001", "EVIDENCE-999"]}, "unknown evidence id", None),
    "beyond the cap": (("a", "b"), {"cited_evidence_ids": ["EVIDENCE-001", "EVIDENCE-003"]}, "unknown evidence id", None),
    "upgrade": (("a", "c"), {"clinical_effect": None}, "interaction_assessment", None),
    "phrase": (("a", "b"), {"evidence_summary": "It is SAFE to Combine them"}, "safe to combine", None),
    "url": (("a", "b"), {"safety_notice": "see WWW.example.org"}, "URL", None),
    "claims": (("a", "b"), {"cited_evidence_ids": ["EVIDENCE-002"], "mechanism": "m"}, "clinical_effect, mechanism", None),
    "no claims": (("a", "b"), {"cited_evidence_ids": ["EVIDENCE-002"], "clinical_effect": " ", "severity": None}, None, None),
    "severity": (("a", "b"), {"severity": "fatal"}, None, None),
    "null severity": (("a", "b"), {"severity": " Not Stated "}, None, None),
    "lower claim": (("a", "b"), {"interaction_assessment": vocab.SUPPORT_FOUND}, None, "serious"),
    "unknown pair": (("x", "y"), {"interaction_assessment": vocab.INSUFFICIENT, "cited_evidence_ids": [], "clinical_effect": None}, "interaction_assessment", None),
}


def test_checks(spark):
    answers = parsed(spark, {k: (pair, changed(**kw)) for k, (pair, kw, _, _) in CHECKS.items()})
    got = {r.answer_id: r for r in grounding.validate(answers, evidence(spark), statuses(spark)).collect()}
    for name, (_, _, issue, severity) in CHECKS.items():
        row = got[name]
        assert row.passed == (issue is None), (name, row.fatal_issues)
        if issue:
            assert any(issue in i for i in row.fatal_issues), (name, row.fatal_issues)
        assert row.corrected_severity == severity, name
        # A word the cited texts lack is stripped whether or not the answer is refused for something else.
        assert bool(row.corrections) == (name in ("severity", "upgrade", "claims", "unknown pair")), (name, row.corrections)


@pytest.mark.parametrize("phrase", vocab.FORBIDDEN_PHRASES)
def test_phrases_are_listed(phrase):
    assert phrase == phrase.lower()


def test_explanations(spark):
    answers = parsed(spark, {
        "ok": (("a", "b"), json.dumps(GOOD)), "bad": (("a", "b"), changed(cited_evidence_ids=["EVIDENCE-009"])), "prose": (("a", "b"), "oops"),
        "late": (("a", "b"), ""), "none": (("a", "d"), json.dumps(GOOD))})
    answers = answers.withColumn("failure", F.when(F.col("answer_id") == "late", "timeout"))
    asked = statuses(spark).join(answers.select("answer_id", "rxcui_a", "rxcui_b"), ["rxcui_a", "rxcui_b"])
    off = spark.createDataFrame([("off", "a", "b", vocab.PAIR_FOUND), ("lost", "q", "r", vocab.NOT_FOUND)],
                                "answer_id string, rxcui_a string, rxcui_b string, evidence_status string")
    asked = asked.select(*off.columns).unionByName(off)
    checked = grounding.validate(answers.where("not malformed"), evidence(spark), statuses(spark))
    got = {r.answer_id: r for r in grounding.explain(asked, evidence(spark), answers, checked).collect()}
    assert {k: r.mode for k, r in got.items()} == {
        "ok": "llm_grounded", "bad": "evidence_only", "prose": "evidence_only", "late": "evidence_only", "none": "evidence_only", "off": "evidence_only",
        "lost": "evidence_only"}
    assert got["ok"].cited_evidence == ["EVIDENCE-001"] and got["ok"].limitations[-1] == "one label" and got["ok"].severity == "serious"
    assert got["bad"].cited_evidence == ["EVIDENCE-001", "EVIDENCE-002"] and got["bad"].evidence_summary is None
    assert got["bad"].fallback_reason.startswith(vocab.REASON_REJECTED)
    assert got["prose"].fallback_reason == "LLM unavailable (OpenRouter): provider returned malformed output."
    assert got["late"].fallback_reason == "LLM unavailable (OpenRouter): provider request timed out."
    assert got["none"].fallback_reason == vocab.REASON_NO_EVIDENCE and got["none"].interaction_assessment == vocab.INSUFFICIENT
    assert got["off"].fallback_reason == vocab.FAILURE_DISABLED
    assert got["lost"].fallback_reason == "Cannot generate an explanation: retrieval result was 'drug_not_found'."
    assert all(r.safety_notice for r in got.values())
    assert all([c.evidence_id for c in r.citations] == r.cited_evidence for r in got.values())
    assert got["ok"].citations[0].text and got["ok"].validation.passed and not got["bad"].validation.passed and got["off"].validation is None


def test_prompts_and_generation(spark):
    names = spark.createDataFrame([(x, f"drug {x}") for x in "abcd"], "rxcui string, normalized_name string")
    table = grounding.prompts(statuses(spark), evidence(spark), names, instructions="RULES", max_chars=7)
    got = {(r.rxcui_a, r.rxcui_b): r.prompt for r in table.collect()}
    assert got["a", "b"] == (
        "RULES\n\nDrug A: drug a\nDrug B: drug b\n\nEVIDENCE:\n"
        "[EVIDENCE-001] (relation: pair_specific_evidence, source drug: A drug, section: Warnings)\nSerious\n\n"
        "[EVIDENCE-002] (relation: drug_specific_evidence, source drug: B drug, section: Warnings)\nPlain t\n")
    assert got["a", "d"].endswith("EVIDENCE: none retrieved. There is no evidence to summarize.")

    def load():
        return lambda p: None if "drug d" in p else json.dumps({"n": len(p)})

    texts = {(r.rxcui_a, r.rxcui_b): r.raw_text for r in grounding.generate(table, load).collect()}
    assert texts["a", "d"] is None and json.loads(texts["a", "b"])["n"] == len(got["a", "b"])


def test_a_failed_call_ends_its_own_row_only(spark):
    def load():
        seen = {}

        def make(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "bug":
                raise KeyError("x")
            if prompt == "slow" or (prompt == "late" and seen[prompt] < 3):
                raise grounding.CallFailed("took too long", "timeout", 504)
            if prompt == "key":
                raise grounding.CallFailed("no", "key_invalid", 401)
            return None if prompt == "none" else prompt.upper()
        return make

    rows = [(i, p, "kept") for i, p in enumerate(["a", "bug", "slow", "late", "key", "none", None, "a"])]
    df = spark.createDataFrame(rows, "id int, prompt string, other string").coalesce(1)
    got = {r.id: (r.raw_text, r.failure_kind, r.failure_status, r.failure_message, r.attempts) for r in grounding.generate(df, load, attempts=3).collect()}
    assert got == {0: ("A", None, None, None, 1), 1: (None, None, None, "KeyError: 'x'", 1), 2: (None, "timeout", 504, "took too long", 3), 3: ("LATE", None, None, None, 3),
                   4: (None, "key_invalid", 401, "no", 1), 5: (None, None, None, "the generator returned no text", 1), 6: (None, None, None, None, 0), 7: ("A", None, None, None, 1)}
    assert grounding.generate(df.limit(0), load).collect() == []


def test_failure_categories(spark):
    rows = [("Gemini", None, "PermissionDenied: x", "key_invalid"), ("Gemini", None, "quota", "rate_limit"), ("Gemini", None, "odd", "unavailable"),
            ("xAI", 401, "", "key_invalid"), ("xAI", 504, "", "timeout"), ("OpenRouter", 429, None, "rate_limit"), ("OpenRouter", 500, "no auth", "key_invalid"),
            ("disabled", None, None, "disabled"), ("elsewhere", None, "timeout", "other")]
    df = spark.createDataFrame([r[:3] for r in rows], "p string, c int, m string")
    got = [r.x for r in df.select(grounding.failure_category(F.col("p"), F.col("c"), F.col("m")).alias("x")).collect()]
    assert got == [r[3] for r in rows]
    kinds = spark.createDataFrame([("xAI", "key_missing"), ("xAI", None), ("disabled", "timeout"), ("xAI", "unheard of")], "p string, k string")
    none = F.lit(None)
    assert [r.x for r in kinds.select(grounding.failure_category(F.col("p"), none.cast("int"), none.cast("string"), F.col("k")).alias("x")).collect()] == ["key_missing", "unavailable", "disabled", "unavailable"]
