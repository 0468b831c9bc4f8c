"""Label maps, the phone inventory, sound rules and text patterns.

Everything here is data that results depend on. Patterns are written in the
common regex dialect; ``functions.text.pattern`` adapts them to Spark's.
"""

# ---------------------------------------------------------------- fixed values
# Labels and periods (years relative to the present, negative = past).
ANCHOR_PERIODS = (-5000, -1100, -300, 0)
FUTURE_TIMELINE = (0, 1000, 2000, 3000, 4000, 5000)
TIME_WINDOW = 500
LANGUAGE_PERIODS = {
    "US English": 0,
    "UK English": -300,
    "Old English": -1100,
    "PIE": -5000,
}
REQUEST_PERIODS = {
    "PIE": -5000,
    "old_english": -1100,
    "us_english": 0,
    "british_english": -300,
    "future_english_1000": 1000,
    "future_english_2000": 2000,
    "toronto_english": 0,
}
MODERN_LABELS = ("us_english", "british_english")
DIALECT_LABEL = "toronto_english"
CANONICAL_LANGUAGES = {
    "PIE": "PIE",
    "Proto-Indo-European": "PIE",
    "Old English": "Old English",
    "Old-English": "Old English",
    "old_english": "Old English",
    "US English": "US English",
    "English-US": "US English",
    "us_english": "US English",
    "Modern-English": "US English",
    "UK English": "UK English",
    "English-UK": "UK English",
    "british_english": "UK English",
    "Latin": "Latin",
}
UNKNOWN_PREDICTION = "/???/"
REQUIRED_FIELDS = ("ipa_phoneme", "english_translation", "description", "original_characters")
LATIN_COLUMNS = ("original_characters", "ipa_phoneme", "english_translation", "part_of_speech")
LEXICON_COLUMNS = ("word", "english_translation", "language", "phonetic_representation", "time_period")
REJECTED_VALUES = ("", "null", "None", "...")
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Blank characters removed from both ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Articulatory features of each phone, in inventory order (ties go to the first).
FEATURES = (
    "syll", "cons", "son", "cont", "voi", "nas", "lab", "cor", "dor",
    "high", "back", "low", "round", "tense",
)
PHONES = (
    ("i", (1, 0, 1, 1, 1, 0, 0, 0, 0, 1, 0, 0, 0, 1)),
    ("ɪ", (1, 0, 1, 1, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0)),
    ("e", (1, 0, 1, 1, 1, 0, 0, 0, 0, 0.7, 0, 0, 0, 1)),
    ("ɛ", (1, 0, 1, 1, 1, 0, 0, 0, 0, 0.3, 0, 0, 0, 0)),
    ("æ", (1, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 1)),
    ("ʌ", (1, 0, 1, 1, 1, 0, 0, 0, 1, 0, 1, 0, 0, 0)),
    ("ɔ", (1, 0, 1, 1, 1, 0, 0, 0, 1, 0, 1, 0, 1, 1)),
    ("u", (1, 0, 1, 1, 1, 0, 1, 0, 1, 1, 1, 0, 1, 1)),
    ("ə", (1, 0, 1, 1, 1, 0, 0, 0, 0, 0.5, 0.5, 0, 0, 0)),
    ("ɑ", (1, 0, 1, 1, 1, 0, 0, 0, 1, 0, 1, 1, 0, 0)),
    ("ʊ", (1, 0, 1, 1, 1, 0, 1, 0, 1, 1, 1, 0, 1, 0)),
    ("o", (1, 0, 1, 1, 1, 0, 0, 0, 1, 0.5, 1, 0, 1, 1)),
    ("a", (1, 0, 1, 1, 1, 0, 0, 0, 1, 0, 0, 1, 0, 1)),
    ("t", (0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0)),
    ("d", (0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0)),
    ("ɾ", (0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0)),
    ("ð", (0, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0)),
    ("θ", (0, 1, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0)),
    ("ŋ", (0, 1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0)),
    ("ʃ", (0, 1, 0, 1, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0)),
    ("ʒ", (0, 1, 0, 1, 1, 0, 0, 1, 0, 1, 0, 0, 0, 0)),
    ("p", (0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0)),
    ("b", (0, 1, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0)),
    ("f", (0, 1, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0)),
    ("v", (0, 1, 0, 1, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0)),
    ("m", (0, 1, 1, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)),
    ("n", (0, 1, 1, 0, 1, 1, 0, 1, 0, 0, 0, 0, 0, 0)),
    ("l", (0, 1, 1, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0)),
    ("r", (0, 1, 1, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0)),
    ("w", (0, 0, 1, 1, 1, 0, 1, 0, 1, 1, 1, 0, 1, 0)),
    ("j", (0, 0, 1, 1, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0)),
    ("h", (0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)),
    ("ʔ", (0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)),
    ("ˈ", (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)),
    ("ˌ", (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)),
)

# Feature drift. Every line is a chain: its first rule whose tests all hold is
# applied. A rule is (tests, {feature: rate}); a rate is multiplied by alpha.
DRIFT_SPAN = 2000
DRIFT_POWER = 0.3
DRIFT = {
    ("vowel", "future"): (
        (
            ((("high", "=", 1), ("tense", "=", 1)), {"high": -0.3, "tense": -0.2}),
            ((("high", "=", 0), ("low", "=", 0)), {"high": 0.2}),
            ((("low", "=", 1),), {"low": -0.3, "high": 0.2}),
        ),
    ),
    ("vowel", "past"): (
        (((("back", "=", 0),), {"back": 0.1}),),
        (((("tense", "!=", 0),), {"tense": -0.1}),),
    ),
    ("other", "future"): (
        (((("cons", "=", 1),), {"son": 0.2, "cont": 0.3}),),
    ),
    ("other", "past"): (
        (((("cont", "=", 1),), {"cont": -0.2}),),
    ),
}

# Timed replacements, in order: (sound, replacement, first year, last year, following context).
# A context is matched literally after the sound, and its last character is
# appended to the replacement (so a bracketed class appends its bracket).
VOWEL_SHIFTS = (
    ("ɒ", "ɔ", -300, 0, None),
    ("æ", "ɛ", -1100, -300, None),
    ("aː", "eɪ", -300, 0, None),
    ("iː", "aɪ", -300, 0, None),
    ("uː", "aʊ", -300, 0, None),
)
CONSONANT_SHIFTS = (
    ("k", "tʃ", -1100, -300, "_[ieæ]"),
    ("g", "dʒ", -1100, -300, "_[ieæ]"),
    ("hw", "w", -300, 0, None),
)

# Wiki markup removal, in order: (pattern, flags, replacement); then every run of
# blanks becomes one space.
MARKUP_STEPS = (
    (r"<ref[^>]*>.*?</ref>", "s", ""),
    (r"<ref[^/]*?/>", "", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "", "$1"),
    (r"\{\{[^}]*\}\}", "", ""),
    (r"'''?|''?", "", ""),
)

# Root pages.
ROOT_TITLE_PREFIX = "Reconstruction:Proto-Indo-European/"
ROOT_TITLE_MARK = "Proto-Indo-European"
CATEGORY_PREFIX = "Category:"
ROOT_DEFINITIONS = (
    r"#\s*([^\n#]*?)(?=\n#|\n\n|\Z)",
    r"===Meaning===\s*([^=\n]+)",
    r"===Root===\s*[^#\n]*\n#\s*([^\n]+)",
)
ROOT_PHONOLOGY = (
    r"\{\{PIE\|([^}|]+?)(?:\||\})",
    r"\{\{ine-root\|([^}|]+?)(?:\||\})",
    r"\{\{etymon\|ine-pro\|([^}|]+?)(?:\||\})",
    r"===Reconstruction===\s*([^=\n]+)",
)
ROOT_DESCRIPTION = (
    r"====Reconstruction notes====\s*(.*?)(?=\n===|\Z)",
    r"===Etymology===\s*(.*?)(?=\n===|\Z)",
    r"'''Description:?'''\s*(.*?)(?=\n===|\Z)",
)
RAW_SECTIONS = (
    ("root", r"===Root===\s*(.*?)(?=\n===|\Z)"),
    ("etymology", r"===Etymology===\s*(.*?)(?=\n===|\Z)"),
    ("reconstruction", r"===Reconstruction===\s*(.*?)(?=\n===|\Z)"),
    ("notes", r"====Reconstruction notes====\s*(.*?)(?=\n===|\Z)"),
    ("derived", r"====Derived terms====\s*(.*?)(?=\n===|\Z)"),
)

# Term pages. {language} and {pos} are filled in.
SECTION_FIRST = r"=={language}==\s*(.*?)(?=\n==|\Z)"
SECTION_FULL = r"==\s*{language}\s*==\s*(.*?)(?=\n==[^=]|\Z)"
TERM_IPA = r"\* IPA(?:\(key\))?: /([^/]+)/"
TERM_DEFINITION = r"===({pos})===\s*#\s*(.+?)(?=\n[^#]|\Z)"
TERM_POS = {
    "Old English": ("Noun", "Verb", "Adjective", "Adverb"),
    "Latin": ("Noun", "Verb", "Adjective", "Adverb", "Pronoun"),
}

# Raw-content mining (used again on landed batches).
MINE_IPA = (
    r"\{\{la-IPA\|([^}]+)\}\}",
    r"\{\{IPA\|la\|([^}]+)\}\}",
    r"\{\{IPAchar\|([^}]+)\}\}",
    r"\/([^\/]+)\/",
    r"\[([^\]]+)\]",
    r"\{\{pron\|la\|([^}]+)\}\}",
    r"pronunciation: ([^\.]+)",
)
MINE_IPA_ANNOTATION = r"ann=\d+\|"
MINE_IPA_LENGTH = r"['ː]"
MINE_TRANSLATION = (
    r"===Definitions?===\n([^=]+)",
    r"# ([^\.]+)(?=\.|$)",
    r"\* ([^\.]+)(?=\.|$)",
    r'===Etymology===\n[^"]*?"([^"]+)"',
    r"===Translation===\n([^=]+)",
    r'Literally "([^"]+)"',
    r'From [^,.]*, (?:meaning|lit\.) "([^"]+)"',
    r": ([^\.]+)(?=\.|$)",
    r"\{\{(?:lb|label)\|la\|[^}]*\}\}\s*([^.\n]+)",
    r"\{\{defn\|la\|([^}]+)\}\}",
    r"\{\{(?:m|mention)\|la\|[^}|]+\|t=([^}]+)\}\}",
    r"(?<=\n)\d+\.\s*([^.\n]+)",
    r"""meaning (?:is |of )?["']([^"']+)["']""",
    r"\{\{uxi\|la\|[^|]+\|([^}]+)\}\}",
    r"""From [^.]+, (?:meaning|signifying) ["']([^"']+)["']""",
    r"\{\{(?:l|link)\|la\|[^}|]+\|([^}]+)\}\}",
)
MINE_TEMPLATE = r"\{\{[^}]+\}\}"
MINE_LINK = r"\[\[[^\]]+\]\]"
# Patterns without a group yield their whole match.
MINE_POS = (
    r"===(\w+)===[^=]",
    r"\{\{la-(?:noun|verb|adj|adv|prep|conj|interj)[^}]*\}\}",
    r"\|\s*PoS\s*=\s*([^|\n}]+)",
    r"\|\s*pos\s*=\s*([^|\n}]+)",
    r"\|\s*type\s*=\s*([^|\n}]+)",
    r"\{\{head\|la\|([^}|]+)",
    r"\{\{la-(?:decl|conj)[^}]*\}\}",
    r"# \{\{(?:lb|label)\|la\|([^}|]+)",
    r"\{\{(?:la|latin)[- ]([^}|]+)",
)
POS_NAMES = {
    "noun": "noun",
    "verb": "verb",
    "adjective": "adjective",
    "adverb": "adverb",
    "preposition": "preposition",
    "conjunction": "conjunction",
    "interjection": "interjection",
    "pronoun": "pronoun",
    "proper noun": "proper noun",
    "participle": "participle",
    "numeral": "numeral",
    "n": "noun",
    "v": "verb",
    "adj": "adjective",
    "adv": "adverb",
    "prep": "preposition",
    "conj": "conjunction",
    "interj": "interjection",
    "pron": "pronoun",
    "prop n": "proper noun",
    "part": "participle",
    "num": "numeral",
    "determiner": "determiner",
    "article": "article",
    "prefix": "prefix",
    "suffix": "suffix",
    "phrase": "phrase",
    "proverb": "proverb",
    "letter": "letter",
}

# Replies.
REPLY_SEPARATOR = "---"
REPLY_FIELDS_TERM = ("ipa_phoneme", "english_translation", "part_of_speech")
REPLY_FIELDS_ROOT = ("ipa_phoneme", "english_translation", "description")
PROMPT_SECTIONS = ("root", "etymology", "reconstruction", "notes")
# ------------------------------------------------------------ end fixed values
