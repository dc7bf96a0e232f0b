"""Fixed values.

Everything here must equal the published behaviour for results to match: spellings of missing
values, keyword rules, vectoriser settings and the wording of the label prompt. They are plain
data, kept together and in natural order; every one of them can be overridden by a parameter.
"""

# Cell texts that mean "missing" in a CSV file (case-sensitive; the empty cell is also missing).
MISSING_MARKS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Ordered category rules: the first rule with a keyword found anywhere in the text wins.
CATEGORY_RULES = (
    ("Coffee & Tea", ("coffee", "espresso", "latte", "brew", "tea", "chai")),
    ("Candy & Chocolate", ("chocolate", "candy", "gummy", "caramel")),
    ("Nuts & Snacks", ("nut", "almond", "cashew", "peanut", "chip", "cracker", "popcorn")),
    ("Condiments & Sauces",
     ("sauce", "ketchup", "mustard", "salsa", "dressing", "vinegar", "oil", "spice")),
    ("Grains & Pasta", ("pasta", "rice", "grain", "quinoa", "oat", "cereal", "bread", "flour")),
    ("Health & Supplements", ("vitamin", "protein", "supplement", "probiotic", "omega")),
    ("Pet Food", ("dog", "cat", "pet", "puppy", "kitten", "kibble")),
    ("Beverages", ("juice", "drink", "water", "soda", "beverage", "smoothie")),
    ("Dairy & Alternatives", ("milk", "cream", "cheese", "butter", "yogurt", "dairy")),
    ("Baking & Sweeteners",
     ("sugar", "honey", "syrup", "jam", "jelly", "cookie", "cake", "baking")),
    ("Soups & Broths", ("soup", "broth", "stock", "chili", "stew")),
)
DEFAULT_CATEGORY = "General Grocery"

HOLIDAY_MONTHS = (11, 12, 1)

# Numeric feature columns, in the order they are fused.
NUMERIC_FEATURES = (
    "rating_norm", "helpfulness_ratio", "log_word_count", "log_summary_length", "log_total_votes",
)

SEED = 42

# Text vectoriser: 1-2-grams, document-frequency bounds, vocabulary size; projection widths.
TFIDF_MAX_FEATURES = 8000
TFIDF_MIN_DF = 5
TFIDF_MAX_DF = 0.85
LSA_DIMS = 100
PCA_DIMS = 30
TEXT_WEIGHT = 1.0
NUMERIC_WEIGHT = 0.6

# Clustering.
K_RANGE = tuple(range(2, 11))
SWEEP_RESTARTS, SWEEP_MAX_ITER, SWEEP_SAMPLE = 10, 300, 8000
FINAL_RESTARTS, FINAL_MAX_ITER, FINAL_SAMPLE = 20, 500, 10000
DBSCAN_MIN_SAMPLES = 20
GRAPH_NEIGHBORS = 10
WARD_DIMS = 10

# Topics.
LDA_TOPICS = 4
LDA_PASSES = 15
LDA_MAX_FEATURES = 2000
LDA_MIN_DF = 2
LDA_MAX_DF = 0.90
LDA_MIN_ROWS = 20

# Label prompts, fixed wording. {subject} is filled once; the places of the middle part take the
# cluster, its size, mean rating, terms and sampled reviews.
LABEL_TERMS = 12
LABEL_REVIEWS = 3
PROMPT_HEAD = (
    "You are analyzing a cluster of {subject}. Generate:\n"
    "1. A short label (3-6 words) capturing the cluster essence\n"
    "2. A one-sentence description (max 25 words)\n"
    "3. Dominant sentiment: Positive / Negative / Mixed / Neutral\n\n"
)
PROMPT_BODY = (
    "Cluster %s info:\n- Reviews: %s  |  Avg rating: %.2f/5.0\n- Top terms: %s\n"
    "- Sample reviews:\n%s"
)
PROMPT_TAIL = (
    "\n\nRespond ONLY with valid JSON, no other text:\n"
    '{"label": "...", "description": "...", "sentiment": "..."}'
)

# White space as Unicode text splitting understands it, as a regular-expression class body that
# Java and RE2 read alike.
BLANKS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# English stop words: the default list of Spark's StopWordsRemover.
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())

# Clean-up patterns, fixed values, applied in order; each match becomes one blank.
CLEAN_STEPS = (r"<[^>]+>", rf"http[^{BLANKS}]+", r"[^a-z]+")
