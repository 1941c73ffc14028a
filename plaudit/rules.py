"""Word lists, keyword groups, thresholds and sentiment constants.

All are plain configuration: every operator takes them as parameters and uses
these values by default.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: category names in tie-break order -------------------------
COMPLAINT_CATEGORIES = (
    "battery life",
    "shipping and delivery",
    "product quality",
    "user interface and UX",
    "pricing and value",
    "customer service",
    "performance and speed",
    "build and design",
)

# --- Fixed values: keyword groups in order of precedence ---------------------
CATEGORY_KEYWORDS = (
    ("battery life", ("battery", "charge", "drain", "power")),
    ("shipping and delivery", ("ship", "deliver", "arriv", "packag")),
    ("product quality", ("broke", "quality", "material", "plastic", "build")),
    ("user interface and UX", ("ui", "app", "interface", "design", "navigate", "clutter")),
    ("pricing and value", ("price", "expensive", "cost", "cheap", "value")),
    ("customer service", ("service", "support", "refund", "return", "customer")),
    ("performance and speed", ("slow", "lag", "crash", "freeze", "performance", "speed")),
)
DEFAULT_CATEGORY = "product quality"

# --- Fixed values: markers of a feature request ------------------------------
REQUEST_MARKERS = (
    "wish", "hope", "would love", "please add", "add", "feature", "support",
    "integration", "dark mode", "option", "include", "improve", "need",
    "want", "better", "future", "update", "could you", "can you",
)

# --- Fixed values: label spellings and column synonyms -----------------------
LABEL_VALUES = {
    "genuine": 1, "real": 1, "1": 1, "true": 1,
    "fake": 0, "false": 0, "0": 0, "spam": 0,
}
TEXT_COLUMNS_TRAINING = ("review_text", "text", "review", "content")
TEXT_COLUMNS_SCORING = ("review_text", "text", "review")
LABEL_COLUMNS = ("label", "fake", "is_fake", "class", "target")

# --- Fixed values: thresholds and sizes --------------------------------------
SENTIMENT_THRESHOLD = 0.05
IMBALANCE_SHARE = 0.35
TEST_PERCENT = 20
FOLDS = 5
SEED = 42
SNIPPET_CHARS = 120
REPORT_CHARS = 55
REPORT_ROWS = 50
MIN_CHARS, MAX_CHARS = 5, 5000

SIGNAL_COLUMNS = (
    "review_length", "word_count", "exclamation_count", "caps_ratio",
    "avg_word_length", "punctuation_density", "digit_ratio",
)

# --- Fixed values: spellings a CSV reader takes for a missing value ----------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- Fixed values: contracted forms the word tokenizer cuts in two -----------
CONTRACTIONS = (
    ("cannot", "can not"), ("gimme", "gim me"), ("gonna", "gon na"),
    ("gotta", "got ta"), ("lemme", "lem me"), ("wanna", "wan na"),
)

# --- Fixed values: word stumps left of English contractions ------------------
CONTRACTION_STUMPS = (
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "couldn", "didn",
    "doesn", "hadn", "hasn", "haven", "isn", "ma", "mightn", "mustn", "needn",
    "shan", "shouldn", "wasn", "weren", "won", "wouldn",
)

# Noun endings, tried in order; the first that fits is replaced. A full
# dictionary is passed as a DataFrame instead (operators.lemmas).
LEMMA_SUFFIXES = (
    ("ss", "ss"), ("us", "us"), ("is", "is"), ("sses", "ss"), ("ches", "ch"),
    ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ies", "y"), ("men", "man"),
    ("s", ""),
)
LEMMA_MIN_CHARS = 4
# Nouns whose endings mislead the rules above, and irregular ones.
LEMMA_WORDS = (
    ("brownies", "brownie"), ("calves", "calf"), ("children", "child"), ("cookies", "cookie"), ("feet", "foot"),
    ("geese", "goose"), ("halves", "half"), ("hoodies", "hoodie"), ("knives", "knife"), ("leaves", "leaf"),
    ("lenses", "lens"), ("lies", "lie"), ("lives", "life"), ("loaves", "loaf"), ("mice", "mouse"),
    ("movies", "movie"), ("newbies", "newbie"), ("pies", "pie"), ("rookies", "rookie"), ("selfies", "selfie"),
    ("shelves", "shelf"), ("teeth", "tooth"), ("thieves", "thief"), ("ties", "tie"), ("wives", "wife"),
    ("wolves", "wolf"), ("zombies", "zombie"),
)


@dataclass(frozen=True)
class SentimentRules:
    """Modifier words and factors of the lexicon sentiment score.

    The defaults follow the published rule set of Hutto & Gilbert (ICWSM 2014).
    """

    raise_by: float = 0.293
    boosters: tuple[str, ...] = (
        "absolutely", "amazingly", "awfully", "completely", "considerable",
        "considerably", "decidedly", "deeply", "effing", "enormous",
        "enormously", "entirely", "especially", "exceptional",
        "exceptionally", "extreme", "extremely", "fabulously", "flipping",
        "flippin", "frackin", "fracking", "fricking", "frickin", "frigging",
        "friggin", "fully", "fuckin", "fucking", "fuggin", "fugging",
        "greatly", "hella", "highly", "hugely", "incredible", "incredibly",
        "intensely", "major", "majorly", "more", "most", "particularly",
        "purely", "quite", "really", "remarkably", "so", "substantially",
        "thoroughly", "total", "totally", "tremendous", "tremendously",
        "uber", "unbelievably", "unusually", "utter", "utterly", "very",
    )
    dampers: tuple[str, ...] = (
        "almost", "barely", "hardly", "just enough", "kind of", "kinda",
        "kindof", "kind-of", "less", "little", "marginal", "marginally",
        "occasional", "occasionally", "partly", "scarce", "scarcely",
        "slight", "slightly", "somewhat", "sort of", "sorta", "sortof",
        "sort-of",
    )
    negations: tuple[str, ...] = (
        "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt",
        "doesnt", "ain't", "aren't", "can't", "couldn't", "daren't",
        "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt",
        "mightnt", "mustnt", "neither", "don't", "hadn't", "hasn't",
        "haven't", "isn't", "mightn't", "mustn't", "neednt", "needn't",
        "never", "none", "nope", "nor", "not", "nothing", "nowhere",
        "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
        "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
        "without", "wont", "wouldnt", "won't", "wouldn't", "rarely",
        "seldom", "despite",
    )
    idioms: tuple[tuple[str, float], ...] = (
        ("the shit", 3.0), ("the bomb", 3.0), ("bad ass", 1.5),
        ("badass", 1.5), ("bus stop", 0.0), ("yeah right", -2.0),
        ("kiss of death", -1.5), ("to die for", 3.0),
        ("beating heart", 3.1), ("broken heart", -2.9),
    )
    negation_suffix: str = "n't"
    no_word: str = "no"
    or_words: tuple[str, ...] = ("or", "nor")
    never_word: str = "never"
    so_words: tuple[str, ...] = ("so", "this")
    without_word: str = "without"
    doubt_word: str = "doubt"
    least_word: str = "least"
    least_guards: tuple[str, ...] = ("at", "very")
    kind_word: str = "kind"
    of_word: str = "of"
    but_word: str = "but"
    caps_by: float = 0.733
    negate_by: float = -0.74
    distance_damp: tuple[float, float, float] = (1.0, 0.95, 0.9)
    never_so_by: float = 1.25
    before_but: float = 0.5
    after_but: float = 1.5
    exclamation_micro: int = 292_000
    exclamation_max: int = 4
    question_micro: int = 180_000
    question_many_micro: int = 960_000
    normaliser: float = 15.0


DEFAULT_SENTIMENT = SentimentRules()

# A small seed lexicon of our own, on the usual -4..4 scale; callers pass a
# full one as a DataFrame(token, valence).
SEED_LEXICON = (
    ("amazing", 2.8), ("awesome", 3.1), ("awful", -2.0), ("bad", -2.5),
    ("beautiful", 2.9), ("best", 3.2), ("broke", -1.8), ("broken", -2.1),
    ("clean", 1.7), ("confusing", -0.9), ("cool", 1.3), ("disappointed", -2.1),
    ("disappointing", -2.2), ("easy", 1.9), ("excellent", 2.7),
    ("fantastic", 2.6), ("fast", 1.0), ("fine", 0.8), ("fraud", -2.8),
    ("garbage", -2.0), ("good", 1.9), ("great", 3.1), ("happy", 2.7),
    ("hate", -2.7), ("horrible", -2.5), ("impressed", 2.1), ("joke", 1.2),
    ("love", 3.2), ("no", -1.2), ("nice", 1.8), ("okay", 0.9),
    ("outstanding", 3.0), ("perfect", 2.7), ("perfectly", 3.2), ("poor", -2.1),
    ("problem", -1.7), ("recommend", 1.5), ("rude", -2.0), ("scam", -2.7),
    ("slow", -0.7), ("solid", 0.6), ("sticking", -0.5), ("terrible", -2.1),
    ("trust", 2.3), ("ugly", -2.3), ("unhelpful", -1.5), ("useless", -1.8),
    ("waste", -1.8), ("wonderful", 2.7), ("worst", -3.1), ("worthless", -1.9),
    ("worth", 0.9),
)

# A small seed of (token, polarity -1..1, subjectivity 0..1), also our own.
@dataclass(frozen=True)
class PolarityRules:
    """Words before a scored word that change its polarity.

    An intensifier multiplies polarity and subjectivity, which stay within their
    ranges; a negation, also one before the intensifier, turns and halves polarity.
    """

    negations: tuple[str, ...] = ("no", "not", "never", "n't", "don't", "doesn't", "didn't", "isn't", "wasn't", "can't", "won't")
    negated_by: float = -0.5
    intensifiers: tuple[tuple[str, float], ...] = (
        ("absolutely", 1.5), ("barely", 0.5), ("extremely", 1.5), ("fairly", 0.9), ("highly", 1.3), ("incredibly", 1.5),
        ("particularly", 1.2), ("quite", 1.1), ("rather", 0.9), ("really", 1.3), ("slightly", 0.5), ("so", 1.2),
        ("somewhat", 0.7), ("too", 1.2), ("totally", 1.4), ("very", 1.3),
    )


DEFAULT_POLARITY = PolarityRules()
SEED_POLARITY = (
    ("amazing", 0.6, 0.9), ("awful", -1.0, 1.0), ("bad", -0.7, 0.67),
    ("best", 1.0, 0.3), ("broken", -0.4, 0.4), ("cheap", 0.4, 0.7),
    ("disappointing", -0.6, 0.7), ("excellent", 1.0, 1.0), ("fast", 0.2, 0.6),
    ("good", 0.7, 0.6), ("great", 0.8, 0.75), ("happy", 0.8, 1.0),
    ("horrible", -1.0, 1.0), ("love", 0.5, 0.6), ("perfect", 1.0, 1.0),
    ("poor", -0.4, 0.6), ("slow", -0.3, 0.4), ("terrible", -1.0, 1.0),
    ("wonderful", 1.0, 1.0), ("worst", -1.0, 1.0),
)
