"""Fixed values.

Everything in this module is a value that results depend on (names, word
lists, thresholds, patterns).  It holds no logic.
"""

# --- fixed values: seeds and model settings --------------------------------
SEED = 42
N_FOLDS = 5
TEST_SHARE = 0.2

TFIDF_MAX_FEATURES = 30000
TFIDF_MIN_DF = 3
TFIDF_MAX_DF = 0.85
TFIDF_SMALL_CORPUS = 10

NMF_COMPONENTS = 20
NMF_MAX_ITER = 500

CHUNK_WORDS = 200
SENTIMENT_CHARS = 1000
EXAMPLE_CHARS = 500
EMBEDDING_DIM = 384

LR_C = 1.0
LR_MAX_ITER = 2000
SVC_C = 0.5
SVC_MAX_ITER = 20000
MODEL_TOL = 1e-6

MIN_TEXT_RATIO = 0.1
MIN_SAMPLES = 10
SOURCE_CAP = 200
TOP_TERMS = 20
HISTOGRAM_BINS = 50
CUTOFF_DATE = "2025-01-20"

MODE_METADATA = "metadata_only"
MODE_FULLTEXT = "full_text"

# --- fixed values: outlets and their class ----------------------------------
LEFT_SOURCES = ("AlterNet", "CounterPunch", "DailyBeast", "MotherJones", "Salon")
RIGHT_SOURCES = (
    "American_Conservative",
    "American_Spectator",
    "DailyCaller",
    "FoxNews",
    "The_Free_Beacon",
)
KNOWN_SOURCES = LEFT_SOURCES + RIGHT_SOURCES

# outlet key -> (name written into its records, class word, minimum words)
OUTLETS = {
    "AlterNet": ("AlterNet", "left", 200),
    "CounterPunch": ("CounterPunch", "left", 150),
    "DailyBeast": ("The Daily Beast", "left", 120),
    "MotherJones": ("Mother Jones", "left", 0),
    "Salon": ("Salon", "left", 130),
    "FoxNews": ("Fox News", "right", 200),
    "American_Conservative": ("The American Conservative", "right", 150),
    "American_Spectator": ("The American Spectator", "right", 150),
    "The_Free_Beacon": ("The Washington Free Beacon", "right", 150),
    "DailyCaller": ("The Daily Caller", "right", 120),
}

# written outlet name -> outlet key, used only when a caller asks for it
OUTLET_SYNONYMS = {
    "The Daily Beast": "DailyBeast",
    "Mother Jones": "MotherJones",
    "Fox News": "FoxNews",
    "The American Conservative": "American_Conservative",
    "The American Spectator": "American_Spectator",
    "The Washington Free Beacon": "The_Free_Beacon",
    "The Daily Caller": "DailyCaller",
}

# outlet key -> file of its articles below the data folder
DATASET_FILES = {
    "AlterNet": "left/alter-net/alternet_200_articles.json",
    "CounterPunch": "left/counter-punch/counterpunch_200_articles.json",
    "DailyBeast": "left/daily-beast/dailybeast_200_articles.json",
    "MotherJones": "left/mother-jones/mother_jones_articles.json",
    "Salon": "left/salon/salon_articles.json",
    "American_Conservative": "right/american-conservative/the_american_conservative.json",
    "American_Spectator": "right/american-spectator/spectator_articles.json",
    "DailyCaller": "right/daily-caller/dailycaller_200_articles.json",
    "FoxNews": "right/fox-news/foxnews_200_articles.json",
    "The_Free_Beacon": "right/the-free-beacon/freebeacon_articles.json",
}

# --- fixed values: standard columns and their aliases, in priority order -----
COLUMN_ALIASES = {
    "article_id": ["article_id", "articleid", "id", "doc_id", "document_id", "news_id", "uuid", "uid"],
    "url": ["url", "article_url", "link", "source_url", "web_url", "page_url"],
    "headline": ["headline", "title", "header", "article_title", "news_title"],
    "publication_date": [
        "publication_date", "publish_date", "published_at", "published_date",
        "date", "created_at", "article_date", "timestamp",
    ],
    "outlet_name": [
        "outlet_name", "outlet", "source", "source_name", "publisher", "publication", "news_source",
    ],
    "word_count": ["word_count", "body_word_count", "token_count", "article_word_count", "wc"],
    "label": ["label", "class", "target", "category", "y"],
    "crawl_timestamp": [
        "crawl_timestamp", "crawl_date", "scrape_timestamp", "scraped_at",
        "retrieved_at", "downloaded_at", "collection_timestamp",
    ],
    "text": [
        "text", "body", "body_text", "article_text", "content",
        "main_text", "main_body", "full_text", "article_body", "news_text",
    ],
}
STANDARD_COLUMNS = tuple(COLUMN_ALIASES)
METADATA_REQUIRED = ("headline", "outlet_name")
FULLTEXT_REQUIRED = ("text", "label")
METADATA_STRING_COLUMNS = (
    "article_id", "url", "headline", "publication_date", "outlet_name", "crawl_timestamp", "text",
)

# names the record writers use that the default aliases miss (opt-in)
EXTRA_ALIASES = {
    "publication_date": [
        "date_published", "publishing_date", "published_datetime_raw",
        "publication_datetime", "published", "published_raw",
    ],
    "crawl_timestamp": ["processed_at", "crawled_at", "crawl_time"],
    "outlet_name": ["outlet name"],
}

# --- fixed values: word lists -----------------------------------------------
MODALS = ("must", "should", "may", "might", "could", "would", "can")

# Spark ML's English stop words
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll
    they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
    wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would""".split()
)

PRONOUNS = tuple(
    """i me my mine myself we us our ours ourselves you your yours yourself he him his himself she
    her hers herself it its itself they them their theirs themselves who whom whose what which
    this that these those someone something anyone anything everyone everything nobody nothing""".split()
)
AUXILIARIES = tuple(
    """be am is are was were been being have has had having do does did will shall must should may
    might could would can""".split()
)
FUNCTION_WORDS = tuple(
    """the a an of in on at by for with from to into over under about after before between through
    and or but nor so yet if because while although as than not no""".split()
)
COMMON_ADVERBS = tuple("very too also just now then here there never always often again still even soon".split())
COMMON_ADJECTIVES = tuple(
    "good bad new old great small big large high low long short young free true last next many few other own".split()
)
COMMON_VERBS = tuple(
    """say says said go goes went gone get gets got make makes made know knows knew think thinks
    thought take takes took see sees saw come comes came want wants use uses find finds found give
    gives gave tell tells told work works call calls""".split()
)

# published valence rules (Hutto & Gilbert 2014)
NEGATIONS = tuple(
    """aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt
    mustnt neither neednt never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt
    werent without wont wouldnt rarely seldom despite""".split()
)
BOOSTERS_UP = tuple(
    """absolutely amazingly awfully completely considerably decidedly deeply enormously entirely
    especially exceptionally extremely greatly highly hugely incredibly intensely majorly more most
    particularly purely quite really remarkably so substantially thoroughly totally tremendously
    unbelievably unusually utterly very""".split()
)
BOOSTERS_DOWN = tuple(
    "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split()
)
BOOSTER_STEP = 0.293
NEGATION_FACTOR = -0.74
CAPS_STEP = 0.733
EXCLAIM_STEP = 0.292
QUESTION_STEP = 0.18
BOOSTER_DECAY = (1.0, 0.95, 0.9)
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
VALENCE_ALPHA = 15.0

# small default valence list; pass a full lexicon as a table for real use
DEFAULT_VALENCE = {
    "good": 1.9, "great": 3.1, "best": 3.2, "better": 1.9, "love": 3.2, "happy": 2.7, "win": 2.8,
    "nice": 1.8, "excellent": 2.7, "hope": 1.9, "support": 1.7, "peace": 2.5, "free": 2.3,
    "success": 2.7, "strong": 2.3, "safe": 1.9, "help": 1.7, "fair": 1.3, "trust": 2.3,
    "bad": -2.5, "worse": -2.1, "worst": -3.1, "hate": -2.7, "war": -2.9, "kill": -3.7,
    "stupid": -2.4, "worthless": -1.9, "idiot": -2.3, "ugly": -2.3, "fear": -2.2, "crime": -2.5,
    "attack": -2.1, "crisis": -3.1, "fail": -2.5, "lie": -1.6, "sad": -2.1, "angry": -2.3,
    "terrible": -2.1, "horrible": -2.5, "trash": -0.6, "disgusting": -2.4, "pathetic": -2.7,
}

# --- fixed values: URL rules --------------------------------------------------
CONSERVATIVE_DOMAIN = "theamericanconservative.com"
CONSERVATIVE_ORIGIN = "https://www.theamericanconservative.com"
CONSERVATIVE_BARE_ORIGIN = "https://theamericanconservative.com"
EXCLUDED_URL_PARTS = (
    "/wp-", "/feed/", "/about/", "/contact/", "/donate", "/subscribe/", "/advertise/", "/privacy/",
    "/terms/", "/sitemap/", "/search/", "/login/", "/who-we-are/", "/tac/", "/author/",
    "/customer-service/", "/privacy-policy/",
)
LISTING_URL_PARTS = ("/category/", "/tag/", "/author/", "/all-articles/")
FILE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".pdf", ".zip", ".mp4", ".mp3")
NON_PAGE_PREFIXES = ("#", "javascript:", "mailto:", "tel:")

BLOCKED_DOMAINS = (
    "twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "youtube.com", "youtu.be",
)
BLOCKED_PATHS = (
    "/register", "/login", "/author", "/tag", "/category", "/wp-content", "/wp-json", "/subscribe",
    "/about", "/privacy-policy", "/contact", "/magazine", "/don-lemon-arrested",
)
BLOCKED_URL_PATTERN = r"-ep-\d+"

BEACON_ORIGIN = "https://freebeacon.com"
BEACON_DOMAIN = "freebeacon.com"
BEACON_SECTIONS_DENIED = ("tag", "category", "author", "type")
BEACON_EXCLUDED = (
    "/about/", "/masthead/", "/terms-of-use/", "/privacy-policy/", "/./", "/author/", "/type/video/",
    "/newsletters/", "/men-of-the-year/", "/arts-culture-opinion/", "/fact-check/", "/stiles-section/",
    "/satire/", "/enemies-of-freedom/",
)

COUNTERPUNCH_URL_PATTERN = r"^https://www\.counterpunch\.org/\d{4}/\d{2}/\d{2}/[^/]+/?$"
SALON_ORIGIN = "https://www.salon.com/"
SALON_DATED_PATH = r"/20\d{2}/\d{2}/\d{2}/"
MOTHERJONES_ORIGIN = "https://www.motherjones.com/"
MOTHERJONES_SECTION = "/politics/"
MOTHERJONES_DATED_PATH = r"/20\d{2}/\d{2}/"

# --- fixed values: paragraph rules ----------------------------------------------
DISCLAIMER_PREFIXES = (
    "this piece first appeared on", "this article first appeared on", "originally published",
    "reprinted with permission", "this essay originally appeared", "first published at",
)
SALON_PHRASES = (
    "start your day with essential news", "sign up for our free",
    "we need your help to stay independent", "subscribe today to support salon",
)
MOTHERJONES_PREFIXES = (
    "top image:", "this story was originally published", "correction:", "editor's note:",
)
MOTHERJONES_PHRASES = (
    "mother jones illustration", "zuma", "getty", "cover images", "planet pix", "wikimedia",
)
SPECTATOR_PROMO_PATTERN = r"^(read more\b.*|related:.*|\(related:.*)"
SPECTATOR_PREFIXES = ("image licensed", "image credit")
SPECTATOR_BIO_PHRASES = ("write to him at", "write to her at", "write to them at")
FOX_UPPERCASE_LIMIT = 0.6
FOX_MARKS = ("http", "@")
FOX_PREFIXES = ("Click", "Watch", "Follow", "Sign up", "Subscribe")
FOX_CAPTION_WORDS = ("photo", "image", "pictured", "credit", "getty", "ap photo")
FOX_JUNK_PHRASES = (
    "top headlines", "what's clicking", "are here", "on this site", "newsletter", "advertisement", "promo",
)
DAILYCALLER_PHRASES = ("related:", "twitter.com", "daily caller news foundation")
REGWALL_PHRASES = ("register below to read", "register to gain", "subscribe to unlock")
PAYWALL_PHRASES = ("premium article", "subscribe", "continue reading", "already have an account")

# --- fixed values: character maps, one per family of outlets ------------------------
NBSP = "\u00A0"
ZERO_WIDTH_PATTERN = r"[\x{200B}-\x{200D}\x{FEFF}]"
CHARS_ALTERNET = {
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...",
}
CHARS_COUNTERPUNCH = {
    "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"',
    "’": "'", "‘": "'", "‚": "'", "‛": "'", "′": "'", "‵": "'",
    "´": "'", "ˈ": "'",
    "–": "-", "—": "-", "―": "-",
    "…": "...",
    "\u00a0": " ", "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "",
    "\u2006": " ", "\u2007": " ", "\u2008": " ", "\u2009": " ", "\u200a": " ", "\u202f": " ",
    "\u2060": "", "\u2061": "", "\u2062": "", "\u2063": "",
    "\u2029": "\n\n",
}
CHARS_BROADSHEET = {  # Daily Beast, Daily Caller, Fox
    "“": '"', "”": '"', "‘": "'", "’": "'", "‚": "'", "‛": "'",
    "–": "-", "—": "-", "―": "-", "…": "...", "\u00a0": " ", "\u200b": "",
}
CHARS_CONSERVATIVE = {
    "‘": "'", "’": "'", "ʼ": "'", "′": "'", "“": '"', "”": '"',
    "–": "-", "—": "-", "…": "...",
}
CHARS_SPECTATOR = {
    "“": '"', "”": '"', "‘": "'", "’": "'", "ʼ": "'", "′": "'",
    "–": "-", "—": "-", "…": "...", "\u00a0": " ", "\u2029": " ",
}
CHARS_MOTHERJONES = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "—"}
CHARS_SALON = {
    "“": '"', "”": '"', "‘": "'", "’": "'", "«": '"', "»": '"', "`": "'",
}
CHARS_BEACON = {
    "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-",
}
# UTF-8 punctuation read as Latin-1 / Windows-1252
MOJIBAKE_SALON = {
    "â\u0080\u0098": "'", "â\u0080\u0099": "'", "â\u0080\u009c": '"', "â\u0080\u009d": '"',
    "â\u0080\u0093": "–", "â\u0080\u0094": "—", "â\u0080\u00a6": "...",
}
MOJIBAKE_BEACON = {
    "â€˜": "'", "â€™": "'", "â€œ": '"', "â€\u009d": '"',
    "â€“": "-", "â€”": "-", "â€¦": "...",
}
STAGE_DIRECTIONS = r"(?i)\((cough|laughter|applause|pause)\)"
EDITORIAL_TAGS = r"(?i)\[/?\s*(?:BLOCK|PULLQUOTE|QUOTE|NOTE)\s*\]"

# --- fixed values: US zone suffixes -----------------------------------------------
ZONE_SUFFIXES = {
    "EST": "US/Eastern", "EDT": "US/Eastern", "PST": "US/Pacific", "PDT": "US/Pacific",
    "CST": "US/Central", "CDT": "US/Central", "MST": "US/Mountain", "MDT": "US/Mountain",
}
DEFAULT_ZONE = "US/Eastern"
