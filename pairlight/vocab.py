"""Closed vocabularies, word lists, limits and text formats."""

from __future__ import annotations

# Label sections, key -> (code, name).
SECTIONS = {
    "drug_interactions": ("34073-7", "Drug Interactions"),
    "drug_lab_interactions": ("34074-5", "Drug and/or Laboratory Test Interactions"),
    "contraindications": ("34070-3", "Contraindications"),
    "warnings_and_precautions": ("43685-7", "Warnings and Precautions"),
    "adverse_reactions": ("34084-4", "Adverse Reactions"),
    "clinical_pharmacology": ("34090-1", "Clinical Pharmacology"),
    "boxed_warning": ("34066-1", "Boxed Warning"),
}
INTERACTION_SECTIONS = ("drug_interactions", "drug_lab_interactions")
SECTION_PRIORITY = (
    "drug_interactions",
    "drug_lab_interactions",
    "contraindications",
    "warnings_and_precautions",
    "clinical_pharmacology",
    "adverse_reactions",
)
PLACEHOLDERS = ("", ".", "-", "n/a", "na", "none", "not applicable")
LABEL_NAMESPACE = "urn:hl7-org:v3"

# Drug classes, term -> member ingredients, in lookup order.
CLASS_TERMS = {
    "nsaid": ("ibuprofen", "naproxen", "diclofenac", "celecoxib", "indomethacin", "aspirin", "ketorolac"),
    "nsaids": ("ibuprofen", "naproxen", "diclofenac", "celecoxib", "indomethacin", "aspirin", "ketorolac"),
    "ssri": ("fluoxetine", "sertraline", "paroxetine", "citalopram", "escitalopram"),
    "maoi": ("phenelzine", "tranylcypromine", "isocarboxazid", "selegiline"),
    "anticoagulant": ("warfarin", "apixaban", "rivaroxaban", "dabigatran", "heparin"),
    "anticoagulants": ("warfarin", "apixaban", "rivaroxaban", "dabigatran", "heparin"),
    "beta blocker": ("metoprolol", "atenolol", "propranolol", "carvedilol"),
    "beta-blocker": ("metoprolol", "atenolol", "propranolol", "carvedilol"),
    "ace inhibitor": ("lisinopril", "enalapril", "ramipril", "captopril"),
}

# Term types of the drug vocabulary.
BRAND_TYPES = ("BN", "SBD", "SBDC", "SBDF", "SBDG")
GENERIC_TYPES = ("IN", "PIN")
SYNONYM_TYPES = ("SCD", "SCDC", "SCDF", "SCDG", "GPCK", "BPCK")

# Enumerations.
PAIR_SPECIFIC = "pair_specific_evidence"
DRUG_SPECIFIC = "drug_specific_evidence"
CLASS_LEVEL = "class_level_evidence"
GENERAL_LABEL = "general_label_evidence"
SUPPORT_ORDER = (DRUG_SPECIFIC, CLASS_LEVEL, GENERAL_LABEL)

PAIR_FOUND = "pair_specific_evidence_found"
SUPPORT_FOUND = "supporting_evidence_found"
INSUFFICIENT = "insufficient_evidence"
NOT_FOUND = "drug_not_found"
INVALID = "invalid_input"
RETRIEVAL_ERROR = "retrieval_error"
ASSESSMENTS = (INSUFFICIENT, SUPPORT_FOUND, PAIR_FOUND)
NO_TEXT_STATUSES = (NOT_FOUND, INVALID, RETRIEVAL_ERROR, INSUFFICIENT)

# Limits and defaults.
CHUNK_WORDS = 180
CHUNK_OVERLAP = 40
CHUNK_MIN_CHARS = 15
TOP_K = 5
MAX_VARIANTS = 2
MAX_EVIDENCE = 8
MAX_EVIDENCE_CHARS = 1200
CANDIDATES_CHECKED = 3
CANDIDATES_KEPT = 10
MIN_MATCH_SCORE = 50.0
MAX_MATCHES = 5
MAX_RELATED = 10
MAX_NAME_CHARS = 200
REGIMEN_SIZE = (2, 10)
RATE_LIMIT = (30, 60.0)

# Name check.
NAME_CHARS = r"A-Za-z0-9\-.,()/'%"  # and white space
NAME_EMPTY = "Drug name must not be empty."
NAME_TOO_LONG = "Drug name exceeds the maximum length of %d characters."
NAME_BAD_CHARS = (
    "Drug name contains characters that are not allowed. "
    "Letters, numbers, spaces, and -.,()/'% are permitted."
)
REGIMEN_SMALL = "At least two drug names are required."
REGIMEN_LARGE = "Too many drugs: %d given, maximum is %d."
REGIMEN_DUPLICATE = "Duplicate drug name(s) in request: %s."

# Phrases no answer may contain, looked up in this order.
FORBIDDEN_PHRASES = (
    "no interaction exists",
    "no known interaction",
    "does not interact",
    "do not interact",
    "safe to combine",
    "safe to take together",
    "safe to use together",
    "no interaction between",
    "there is no interaction",
    "not expected to interact",
    "no significant interaction",
    "these drugs are safe",
)
URL_PATTERN = r"https?://|www\."
NULL_SEVERITIES = ("", "null", "none", "not stated in retrieved source", "not stated", "n/a")

# Answer fields.
ANSWER_REQUIRED = ("interaction_assessment", "evidence_summary", "safety_notice")
ANSWER_OPTIONAL = ("clinical_effect", "mechanism", "severity")
ANSWER_LISTS = ("cited_evidence_ids", "limitations")

# Failure categories and what is shown for them.
FAILURE_DETAIL = {
    "key_missing": "provider API key is not configured",
    "key_invalid": "provider rejected the configured API key",
    "timeout": "provider request timed out",
    "rate_limit": "provider rate limit was reached",
    "malformed": "provider returned malformed output",
    "unavailable": "provider is unavailable",
    "other": "provider request failed",
}
LOOKUP_FAILED = "the lookup failed, which does not mean that the name is unknown"
FAILURE_DISABLED = "LLM disabled: running in evidence-only mode."
FAILURE_FORMAT = "LLM unavailable (%s): %s."
# Fixed values: (category, status codes, message markers) per family of provider, first hit wins.
FAILURE_RULES = {
    "Gemini": (
        ("key_invalid", (), ("unauthenticated", "permissiondenied", "api_key_invalid", "invalid api key")),
        ("timeout", (), ("deadlineexceeded", "timeout", "timed out")),
        ("rate_limit", (), ("resourceexhausted", "rate limit", "429", "quota")),
    ),
    "xAI": (
        ("key_invalid", (401, 403),
         ("authentication", "unauthorized", "invalid api key", "invalid_api_key", "incorrect api key")),
        ("timeout", (408, 504), ("timeout", "timed out", "apitimeouterror")),
        ("rate_limit", (429,), ("rate limit", "ratelimit", "429", "quota")),
    ),
    "OpenRouter": (
        ("key_invalid", (401, 403),
         ("authentication", "unauthorized", "invalid api key", "invalid_api_key", "no auth")),
        ("timeout", (408, 504), ("timeout", "timed out", "apitimeouterror")),
        ("rate_limit", (429,), ("rate limit", "ratelimit", "429", "quota")),
    ),
}

# Fallback reasons.
REASON_NO_EVIDENCE = "Cannot generate an explanation: no retrieved evidence was available."
REASON_STATUS = "Cannot generate an explanation: retrieval result was '%s'."
REASON_REJECTED = "The model's response failed safety validation and was discarded: "

# Labels shown for a status (label, tone, description) and for a classification.
STATUS_LABELS = {
    PAIR_FOUND: (
        "Pair-specific evidence found", "strong",
        "The retrieved evidence specifically connects these two medications."),
    SUPPORT_FOUND: (
        "Supporting evidence found", "moderate",
        "Relevant evidence was found, but it does not specifically connect these two medications."),
    INSUFFICIENT: (
        "Insufficient evidence", "neutral",
        "Not enough evidence was found to assess this pair. "
        "This does not mean the medications are safe to combine."),
    NOT_FOUND: ("Drug not found", "warning", "One or both medication names could not be resolved."),
    INVALID: (
        "Same medication entered twice", "warning",
        "Please enter two different medications to check for an interaction."),
    RETRIEVAL_ERROR: (
        "Retrieval error", "error",
        "An error occurred while retrieving evidence. This is not a statement about the medications themselves."),
}
CLASSIFICATION_LABELS = {
    PAIR_SPECIFIC: "Pair-specific evidence",
    CLASS_LEVEL: "Class-level evidence",
    DRUG_SPECIFIC: "Drug-specific evidence",
    GENERAL_LABEL: "General label evidence",
}

# Wording of our own, replaceable by arguments.
SAFETY_NOTICE = (
    "This tool lists retrieved label evidence. It does not replace the judgment of a pharmacist or physician."
)
LIMITATIONS = (
    "Names are matched as whole words; negation is not understood.",
    "The class vocabulary is small, so a missing class match proves nothing.",
    "Only indexed label sections of the two drugs were searched.",
    "Distance ranks text by likeness and says nothing about risk.",
)
INSTRUCTIONS = (
    "Summarise only the evidence below about the two drugs. Cite evidence by its id. "
    "Never state that two drugs do not interact or are safe together. Never write a URL. "
    "Copy a severity word only if the cited text holds it. Answer with one JSON object with the fields "
    "interaction_assessment, evidence_summary, clinical_effect, mechanism, severity, cited_evidence_ids, "
    "limitations, safety_notice."
)

# Fixed value: tokens of a text that a model sees.
MAX_TOKENS = 256
