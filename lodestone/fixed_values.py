"""Fixed values.

Everything in this module is a constant that must hold exactly this value for
results to come out right: word lists, cue patterns, thresholds, defaults and
format strings.  They are defaults of keyword arguments throughout the library.
"""

# --- chunking ---------------------------------------------------------------
MAX_TOKENS = 200
OVERLAP = 40
MARKDOWN_ARTIFACT_KINDS = ("page", "doc", "pr", "issue")
THREAD_ARTIFACT_KINDS = ("message",)
EMAIL_ARTIFACT_KINDS = ("email",)
MARKDOWN_SOURCE_KINDS = ("notion", "file", "github", "linear")
THREAD_SOURCE_KINDS = ("slack",)
EMAIL_SOURCE_KINDS = ("gmail",)
QUOTE_TAIL = r"^(On .{0,200} wrote:|-{2,}\s*Original Message\s*-{0,}|From: .+)$"
HEAD_WORDS = 12

# --- identity ---------------------------------------------------------------
# Prefix of tenant names; pass a deployment's own prefix to `tenant_id` to get its ids.
TENANT_PREFIX = "tenant:"
DNS_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"

# --- embedding, search, fusion ----------------------------------------------
EMBED_DIM = 384
FETCH_N = 50
SEARCH_K = 10
RRF_K = 60
ASK_CONTEXT = 8
ASK_QUOTE_CHARS = 160
COVER_WEIGHT = 0.1

# English stop words of the full-text "english" configuration (Snowball list).
FULLTEXT_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just don "
    "should now"
).split()

# --- faithfulness -----------------------------------------------------------
FAITH_STOPWORDS = (
    "a an the of to and or for in on at by is are be been being it its this that "
    "with as from into within then than must should can may will if any every all "
    "before after once each per via not no"
).split()
FAITH_THRESHOLD = 0.5
MATCH_THRESHOLD = 0.6

# --- synthetic queries ------------------------------------------------------
QUERY_STOPWORDS = (
    "the a an of to and or for in on at by is are be it its this that with as from into "
    "within then than must should can may will if any every all"
).split()
QUERY_TERMS = 6
ROUND_TRIP_K = 10
NEGATIVE_FETCH_K = 20
NEGATIVE_CAP = 3

# --- knowledge graph --------------------------------------------------------
LEXICON = [
    ("customer success manager", "role"),
    ("engineering manager", "role"),
    ("incident commander", "role"),
    ("on-call engineer", "role"),
    ("head of finance", "role"),
    ("vp of sales", "role"),
    ("security team", "team"),
    ("finance team", "team"),
    ("deal desk", "system"),
    ("hr portal", "system"),
    ("pagerduty", "system"),
    ("expensify", "system"),
    ("security owner", "role"),
    ("support agent", "role"),
    ("direct manager", "role"),
    ("finance", "team"),
    ("security", "team"),
    ("support", "role"),
    ("manager", "role"),
    ("cfo", "role"),
]
RELATION_CUES = [
    (r"routed?\s+to\s+(?:the\s+)?([a-z ]+?)\s+for\s+approval", "requires_approval_from"),
    (r"approval\s+from\s+(?:the\s+)?([a-z ]+?)(?:\.|,|\s+to\b)", "requires_approval_from"),
    (r"escalate\s+to\s+(?:the\s+)?([a-z ]+?)(?:\.|,|\s+if\b)", "escalates_to"),
    (r"approved?\s+by\s+(?:the\s+)?([a-z ]+?)(?:\.|,)", "approved_by"),
]
SYNONYMS = [
    ("finance", "finance team"),
    ("security", "security team"),
    ("support", "support agent"),
]
ENTITY_CONFIDENCE = 0.8
RELATION_CONFIDENCE = 0.7
REPLY_CONFIDENCE = 0.9
SIMILARITY_THRESHOLD = 0.9

# --- process extraction -----------------------------------------------------
ACTION_CUES = (
    "issue issued issues route routed routes review reviews reviewed approve approves "
    "approved submit submitted verify verifies verified escalate escalates page pages "
    "create creates send sends assign assigns delete deletes merge merged request "
    "requests schedule schedules record records report reports trigger triggers promote "
    "lock locked reset cancel cancelled coordinate notify confirm confirms must require "
    "requires"
).split()
TRIGGER_PREFIX = "Relevant when handling: "
PROCESS_TTL_SECONDS = 90 * 24 * 3600

# --- agent routing ----------------------------------------------------------
AMOUNT = r"\$\s?(\d[\d,]*)"
OVER_CUES = ("over", "above", "more than", "greater than", "exceed", "exceeding")
UNDER_CUES = ("up to", "under", "below", "less than", "at most", "or less", "within")

# --- evaluation -------------------------------------------------------------
K_VALUES = (5, 10, 20)
GATE_THRESHOLDS = [
    ("recall_at_10", 0.85),
    ("ndcg_at_10", 0.70),
    ("faithfulness", 4.0),
    ("process_citation_validity", 0.95),
]
RECALL_MIN_DELTA = 0.05
NDCG_MIN_DELTA = 0.03
DELTA_SLACK = 1e-9

# --- wiki block types that carry text ---------------------------------------
WIKI_TEXT_BLOCKS = (
    "paragraph",
    "heading_1",
    "heading_2",
    "heading_3",
    "bulleted_list_item",
    "numbered_list_item",
    "to_do",
    "toggle",
    "quote",
    "callout",
    "code",
)

# --- flow control -----------------------------------------------------------
TOKEN_WINDOW_SECONDS = 60
MAX_TRIES = 5
LANES = ("realtime", "backfill", "reprocess")
