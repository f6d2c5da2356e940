"""Fixed values that results depend on: word lists, cue phrases, replacement tables, weights and patterns."""

# --- fixed values: patterns -------------------------------------------------------------------------------
TOKEN = r"([a-z0-9]+)"
UNIT_QUERY = r"(?i)\b(section|article|perkara)\s+(\d+[A-Za-z]?)\b"
HIERARCHY_QUERY = r"(?i)\b(part|chapter|bahagian|bab|division)\s+([A-Za-z0-9IVXLCDM]+)\b"
HIERARCHY_LINE = r"(?i)^(part|chapter|bahagian|bab|division)\s+([A-Za-z0-9IVXLCDM]+)\s*[:.\-]?\s*$"
PARENTHETICAL = r"\s*\([^)]*\)"
PUA = r"(?i)\bp\.?\s*u\.?\s*\(?a\)?\b"
SUBSECTION_QUERY = r"(?i)\bsubsection\s*\(?(\d+[A-Za-z]?)\)?\b|\((\d+[A-Za-z]?)\)"
CROSS_REFERENCE = r"(?i)\b(section|sections|article|articles|perkara|perkara-perkara)\s+\d+[A-Za-z]?\b"
OBLIGATION_TEXT = r"(?i)\b(shall|must|required|obliged)\b"
HEADING_PREFIX = r"(?i)^(section|article|perkara)\s+\d+[a-z]?\s*"

# --- fixed values: word lists -----------------------------------------------------------------------------
DOCUMENT_STOPWORDS = ["act", "akta", "and", "cetakan", "constitution", "federal", "law", "laws", "malaysia", "of", "perlembagaan", "reprint", "semula", "the"]
QUERY_STOPWORDS = ["a", "an", "and", "are", "be", "by", "do", "does", "for", "in", "is", "of", "on", "or", "the", "to", "under", "what", "when", "where", "which", "who"]
NORMAL_FORMS = {
    "akta": "act",
    "amend": "amendment",
    "amends": "amendment",
    "appeals": "appeal",
    "application": "apply",
    "applies": "apply",
    "changed": "amendment",
    "changes": "amendment",
    "cuti": "leave",
    "defined": "define",
    "definition": "define",
    "dikecualikan": "exclude",
    "dikuatkuasa": "commencement",
    "dikuatkuasakan": "commencement",
    "ditakrifkan": "define",
    "duties": "obligation",
    "duty": "obligation",
    "excluded": "exclude",
    "exclusion": "exclude",
    "interpretation": "interpret",
    "introduced": "introduce",
    "introduces": "introduce",
    "introduction": "introduce",
    "komersial": "commercial",
    "obligations": "obligation",
    "pengecualian": "exclude",
    "perkara": "article",
    "pindaan": "amendment",
    "rates": "rate",
    "required": "require",
    "requirement": "require",
    "requires": "require",
    "seksyen": "section",
    "tafsiran": "interpret",
    "tahunan": "annual",
    "terpakai": "apply",
    "wages": "wage",
}
RECALL_FAMILY = ["amendment", "appeal", "apply", "commencement", "define", "exclude", "interpret", "obligation", "order", "rate", "require", "scope", "wage"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SURFACE_REPLACEMENTS = [
    ("akta kerja", "employment act"),
    ("akta perlindungan data peribadi", "personal data protection act pdpa"),
    ("akta pindaan pdpa", "pdpa amendment act act a1727"),
    ("personal data protection (amendment) act 2024", "personal data protection amendment act act a1727"),
    ("urus niaga komersial", "commercial transactions"),
    ("pemindahan data", "data portability"),
    ("berkuat kuasa", "commencement"),
    ("come into force", "commencement"),
    ("with effect from", "effect"),
]

# --- fixed values: cue phrases ----------------------------------------------------------------------------
DEFINITION_CUES = ["definition", "defined", "define", "meaning of", "mean", "maksud", "interpretation", "tafsiran", "ditakrifkan"]
STRICT_DEFINITION_CUES = ["definition", "define", "defined", "interpretation", "maksud", "mean", "tafsiran", "ditakrifkan"]
DEFINITION_HEADINGS = ["interpretation", "definition", "tafsiran"]
RERANK_CUES = ["titled", "definition", "define", "defined", "interpretation", "maksud"]
OBLIGATION_CUES = ["what does", "what must", "must "]
OBLIGATION_WORDS = ["require", "must", "duty", "obligation"]
OBLIGATION_PADDED = [" duty ", " duties ", " obligation ", " obligations ", " must ", " required "]
CAPABILITY_CUES = ["who can", "who may", "who is entitled to"]
LEGAL_ACTION_CUES = ["appeal", "apply", "claim"]
LEGAL_ACTION_WORDS = ["under", "pursuant", "right", "entitled", "may", "can", "who"]
DOCUMENT_HINT_CUES = [" act ", "akta", "constitution", "perlembagaan", "pdpa", "federal"]
HEADING_LOOKUP_CUES = ["which section of", "which article of", "which perkara", "deals with", "sets out", "covers", "berkaitan", "seksyen manakah", "perkara manakah", "apakah kandungan", "terpakai"]
AGREEMENT_CORE_CUES = ["employment agreement", "employment contract", "contract of service", "terms and conditions"]
AGREEMENT_ADVICE_CUES = ["before signing", "signing", "protect myself", "protect yourself", "need to check", "should i check", "what should i check", "employee rights"]
AGREEMENT_WORDS = ["check", "sign", "protect", "rights", "terms"]
AMENDMENT_CUES = ["amendment", "amends", "amend ", "principal act", "act a", "come into force", "introduces", "new section", "pindaan"]
WHICH_UNIT_CUES = ["which section", "which article", "seksyen manakah", "perkara manakah"]
BEGIN_CUES = ["begin", "start", "open", "memulakan"]
RATE_HEADINGS = ["rate", "wage", "with effect from"]

# --- fixed values: query expansion; words are added in this order -----------------------------------------
AGREEMENT_EXPANSION = ["contract", "service", "written", "termination", "notice", "wage", "deduction", "working", "hours", "annual", "leave", "sick", "rest", "favourable", "conditions", "trade", "union", "rights"]

# --- fixed values: weights --------------------------------------------------------------------------------
AGREEMENT_WEIGHTS = {
    "contract of service": 2.6,
    "contracts to be in writing": 3.0,
    "termination": 2.0,
    "notice of termination": 2.8,
    "wage": 1.8,
    "deduction": 1.8,
    "hours of work": 1.8,
    "annual leave": 1.9,
    "sick leave": 1.9,
    "rest day": 1.8,
    "more favourable conditions": 2.0,
    "trade union": 1.5,
    "discrimination": 1.2,
    "flexible working arrangement": 1.3,
}
AGREEMENT_PENALTIES = {"foreign employee": (2.4, 0.8), "foreign domestic employee": (2.4, 0.8), "director general": (1.0, 0.3)}
INTENT_SYNONYMS = {
    "annual leave": ["annual leave"],
    "revocation": ["revocation", "revoke", "revoked"],
    "commencement": ["commencement", "come into operation", "come into force", "citation and commencement"],
    "appeal": ["appeal", "appeals"],
    "application": ["application", "apply", "applies"],
    "interpretation": ["interpretation", "definition", "tafsiran"],
    "introduction": ["new section", "data portability", "introduce", "insert"],
}
# how closely a heading says what is asked for: of a ladder the first rule that holds counts, ladders of an intent are added up;
# a rule is (text, how, phrases, weight), where phrases None are the intent's synonyms and "asked" stands for the part that the question names
HEADING_LADDERS = {
    "every intent": [[("core", "equals", None, 3.2), ("core", "starts", None, 2.2), ("core", "contains", None, 1.2), ("opening", "contains", None, 0.4)]],
    "commencement": [[("core", "contains", ["short title and commencement", "citation and commencement"], 1.2), ("core", "contains", ["general amendment"], -1.0)]],
    "application": [[("core", "equals", ["application"], 1.2), ("core", "contains", ["application of"], -0.4)]],
    "appeal": [[("core", "equals", ["appeal", "appeals"], 0.9)]],
    "annual leave": [[("core", "equals", ["annual leave"], 1.0)]],
    "revocation": [[("core", "equals", ["revocation"], 1.0)]],
    "interpretation": [[("core", "contains", ["interpretation", "tafsiran"], 0.8)], [("core", "asked", [], 0.8), ("opening", "asked", [], 0.8)]],
    "introduction": [[("core", "contains", ["new section"], 1.2)], [("core", "contains", ["data portability"], 1.0), ("opening", "contains", ["data portability"], 1.0)], [("core", "contains", ["general amendment"], -1.1)]],
}
#: Weight of each feature in the general scan, by mode.
MODE_WEIGHTS = {
    "lexical": {"lexical": 1.0, "semantic": 0.0, "document": 0.8, "subsection": 1.0, "definition": 1.0, "recall": 1.0, "hierarchy": 1.0, "obligation_text": 1.0, "obligation_heading": 1.0, "obligation_internal": 1.0, "obligation_definition": -1.0, "agreement": 1.6},
    "embedding": {"lexical": 0.0, "semantic": 1.0, "document": 0.15, "subsection": 1.0, "definition": 1.0, "recall": 0.1, "hierarchy": 0.2, "obligation_text": 0.2, "obligation_heading": 0.2, "obligation_internal": 0.2, "obligation_definition": -0.2, "agreement": 0.2},
    "hybrid": {"lexical": 0.8, "semantic": 0.2, "document": 0.8, "subsection": 1.0, "definition": 1.0, "recall": 1.2, "hierarchy": 1.6, "obligation_text": 1.2, "obligation_heading": 1.6, "obligation_internal": 1.4, "obligation_definition": -1.2, "agreement": 1.8},
}
RERANK_POOL, FILTER_POOL, WEAK_KEPT, CONFIDENT_MARGIN = 10, 16, 2, 0.4
CHUNK_WORDS, OVERLAP_WORDS = 250, 40
