"""Fixed values that results depend on."""

# Metric keys in the order of a page's report, with their names and default weights.
METRICS = [
    ("IFR", "Inference-Failed Rate", 0.16),
    ("BCC", "Block-Count Consistency", 0.06),
    ("BGC", "Block-Geometry Coherence", 0.06),
    ("HMW", "HTML/Markup Well-formedness", 0.07),
    ("TSI", "Table Structure Integrity", 0.05),
    ("LVR", "Lexical Validity Ratio", 0.14),
    ("OOV", "OOV Pronounceability", 0.07),
    ("SFC", "Stopword Frequency Conformance", 0.04),
    ("CED", "Character Entropy & Mojibake Divergence", 0.07),
    ("PPL", "N-gram Perplexity / Fluency", 0.08),
    ("TTR", "Lexical Diversity / Type-Token Anomaly", 0.04),
    ("WSA", "Word-Shape / Tokenization Anomaly", 0.04),
    ("PSW", "Punctuation & Sentence Well-formedness", 0.04),
    ("XSA", "Repetition & Cross-Source Agreement", 0.08),
]
KEYS = [k for k, _, _ in METRICS]

# Order in which problems are listed.
PRIORITY = ["IFR", "CED", "XSA", "LVR", "BCC", "OOV", "HMW", "TSI", "BGC", "PPL", "TTR", "WSA", "PSW", "SFC"]

# What a hard failure of a metric is called in a verdict.
HARD_RULES = {
    "IFR": "inference_failed on a content block",
    "CED": "mojibake/encoding corruption above bound",
    "XSA": "repetition loop / native-text CER over bound",
    "LVR": "lexical validity below 80%",
    "BCC": "block-count mismatch beyond tolerance",
}

PROSE_TYPES = ["Text", "SectionHeader", "ListItem", "Footnote", "Caption"]
CONTENT_TYPES = ["Text", "SectionHeader", "Table", "ListItem"]
FIGURE_TYPES = ["figure", "picture", "image"]

# Letter frequencies; letters outside count as 1e-6.
LETTERS = {
    "en": {"e": 0.127, "t": 0.091, "a": 0.082, "o": 0.075, "i": 0.07, "n": 0.067, "s": 0.063, "h": 0.061, "r": 0.06, "d": 0.043, "l": 0.04, "c": 0.028, "u": 0.028, "m": 0.024, "w": 0.024, "f": 0.022, "g": 0.02, "y": 0.02, "p": 0.019, "b": 0.015, "v": 0.01, "k": 0.008, "j": 0.0015, "x": 0.0015, "q": 0.001, "z": 0.0007},
    "de": {"e": 0.165, "n": 0.098, "i": 0.076, "s": 0.073, "r": 0.07, "a": 0.065, "t": 0.061, "d": 0.051, "h": 0.048, "u": 0.044, "l": 0.034, "c": 0.027, "g": 0.03, "m": 0.025, "o": 0.025, "b": 0.019, "w": 0.019, "f": 0.017, "k": 0.012, "z": 0.011, "p": 0.0067, "v": 0.0067, "ü": 0.0065, "ä": 0.0054, "ö": 0.003, "j": 0.0027, "y": 0.0004, "x": 0.0003, "q": 0.0002},
}
LETTER_FLOOR = 1e-6

STOPWORDS = {
    "en": "a all an and are as at be been but by can for from had has have he in is it its not of on or she that the their they this to was we were which will with".split(),
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einer er es für hat im in ist mit nach nicht noch sie sind um und von werden wie wird zu über".split(),
}
STOPWORD_SHARE = {"en": 0.45, "de": 0.42}
STOPWORD_BAND = 0.18

WHITELIST = "anwendungsgebiet arzneimittel atopische biologika bundesausschuss dermatitis ema fda fertigpen fertigspritze galderma gcp gemeinsamer ich nemluvio nemolizumab nodularis pharmakovigilanz prurigo subkutan wirkstoff".split()

VOWELS = "aeiouyàáâäãåéèêëíìîïóòôöõúùûüøœæ"
ILLEGAL_BIGRAMS = "qx xq qz zq qj jq jx xj vq qv fq kq qk vx xv wx kx zx xz bx fx gx cx".split()
SINGLE_LETTERS = "aIiAàáâäéèêëÀ"
VOID_TAGS = "br img hr meta input col area base link source".split()

# Labels of located evidence.
LOCATION_KINDS = ["inference_failed", "bad_geometry", "malformed_html", "table_defect", "table_unparseable", "dropped_table", "gibberish_word", "rare_word", "mojibake", "merged_word", "alnum_confusion", "hyphen_break", "repetition"]
TEXT_KINDS = ["gibberish_word", "rare_word", "mojibake", "merged_word", "alnum_confusion", "hyphen_break", "repetition"]
