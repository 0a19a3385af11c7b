"""Parameters and fixed values."""

from __future__ import annotations

SAMPLE_RATE = 100
STEP_SECONDS = 2.0
KERNEL_SECONDS = 32.0
COMMA_PAUSE = 0.35
PERIOD_PAUSE = 0.65
ALPHAS = tuple(10.0 ** (-2 + 6 * i / 19) for i in range(20))
FOLDS = 3
SHIFT_MARGIN = 10
SENSITIVITY_MARGIN = 16
FDR_LEVEL = 0.05
CEILING_FLOOR = 0.01
COMPONENTS = 10
MIN_DF = 3
MAX_DF = 0.85
SEED = 10

# fixed values: annotations that are not words
NOISE = r"(?i)[\[\]{}<>]|spn|^(sp|sil|br|lg)$"

# fixed values: a subject's code in a file name
SUBJECT = r"(?i)(?:sub-)?(UTS\d{2})"

# fixed values: words that the latent-semantic vocabulary leaves out
STOP_LEMMAS = (
    "like", "know", "go", "uh", "say", "um", "think", "get", "come", "look", "to",
    "thing", "tell", "want", "start", "feel", "right", "mean", "kind", "yeah", "oh", "well",
)

# fixed values: the classes of phones, in the order of the feature columns
PHONE_CLASSES = {
    "vocalic": "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW A E I O U",
    "consonantal": "P B M W F V T D TH DH S Z CH JH N L R K G SH ZH HH NG Y",
    "voiceless": "P T K F TH S SH HH CH",
    "voiced": "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW A E I O U B M W V D DH Z JH N L R G ZH NG Y",
    "bilabial": "P B M W",
    "labiodental": "F V",
    "dental_alveolar": "T D TH DH S Z CH JH N L R",
    "palatal_velar": "K G SH ZH HH NG Y W",
    "stop": "P B T D K G",
    "fricative": "F V TH DH S Z SH ZH HH",
    "affricate": "CH JH",
    "nasal": "M N NG",
    "liquid": "L R",
    "approximant": "Y W",
}
LEXICAL = ("word_presence", "lexical_frequency", "word_length_chars", "word_duration_secs")
CATEGORIES = ("noun", "adjective", "adverb", "pronoun", "preposition", "conjunction", "determiner", "non_finite_verb")
SYNTAX = ("dependency_distance", "syntactic_depth", "is_root")
SEMANTIC = tuple(f"semantic_dim_{i}" for i in range(COMPONENTS))
TENSES = ("past_regular", "past_irregular", "non_past_marked_3sg", "non_past_unmarked")
SPACES = {"phonological": tuple(PHONE_CLASSES), "lexical_stats": LEXICAL, "categorical": CATEGORIES, "syntactic": SYNTAX, "semantic": SEMANTIC, "tense": TENSES}
FEATURES = tuple(c for space in SPACES.values() for c in space)
CONTROLS = FEATURES[: -len(TENSES)]
