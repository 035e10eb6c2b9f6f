"""Word lists and thresholds that results depend on."""

from __future__ import annotations

# Intents in the order in which they are tried, with the phrases that stand for each.
INTENT_PHRASES = {
    "list_count": [
        "list all", "list the", "show all", "what are all", "what are the", "which classes", "which methods", "which files", "which ones", "which all",
        "how many", "count", "enumerate", "all the", "all indexed", "all classes", "all methods",
    ],
    "schema": ["schema", "database schema", "table", "ddl", "sql schema", "entity", "orm", "jpa", "hibernate", "model", "fields"],
    "usage": ["where is", "who uses", "what uses", "what calls", "called by", "used by", "references to", "usages of", "find usages"],
    "comparison": ["compare", "difference between", "vs", "versus", "differ", "similar to", "different from"],
    "definition": ["what is", "what's", "define", "describe", "tell me about", "show me", "get me"],
    "explanation": [
        "how does", "how do", "explain", "why does", "why do", "how is", "how are", "what happens when", "walk through", "which class will", "which method will",
        "which should", "which would", "which can",
    ],
}
DEFAULT_INTENT = "search"

# top_k, min_similarity, include_dependencies, chunk_type for each intent. "class" holds for definition only if a class is named.
RECOMMENDATIONS = {
    "definition": (5, 0.6, False, "class"),
    "explanation": (10, 0.5, True, None),
    "list_count": (50, 0.3, False, "class"),
    "usage": (15, 0.5, False, None),
    "comparison": (10, 0.5, False, None),
    "schema": (10, 0.5, True, "class"),
    "search": (10, 0.5, False, None),
}

# Capitalised words that are no class names.
COMMON_WORDS = (
    "I A The How What When Where Why Which Who This That These Those It Is Are Was Were Has Have Had Do Does Did Will Would Should "
    "Can Could May Might Must Shall To From For With Without By In On At Of And Or But"
).split()

# Words that are no search terms.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between under again further then once "
    "what which who whom this that these those am it its it's and but if or because until while how where when why "
    "all each every both few more most other some such no nor not only own same so than too very just also now here there "
    "me my i you your we our they their show tell get find search look describe explain list"
).split()

# Terms and what they expand to.
TERM_EXPANSIONS = {
    "auth": ["authentication", "authorize", "login", "credential", "token", "session", "security"],
    "authentication": ["auth", "login", "credential", "token", "session", "security"],
    "login": ["auth", "authentication", "signin", "credential", "session"],
    "security": ["auth", "authentication", "permission", "role", "access", "token"],
    "save": ["persist", "store", "write", "insert", "create", "update"],
    "load": ["read", "fetch", "get", "retrieve", "query"],
    "delete": ["remove", "destroy", "drop", "clear"],
    "update": ["modify", "change", "edit", "patch", "save"],
    "api": ["endpoint", "rest", "controller", "route", "handler"],
    "request": ["http", "call", "invoke", "fetch"],
    "response": ["result", "return", "output"],
    "database": ["db", "repository", "dao", "store", "persistence"],
    "query": ["select", "find", "search", "filter"],
    "table": ["entity", "model", "schema", "record"],
    "error": ["exception", "failure", "fault", "issue"],
    "exception": ["error", "throw", "catch", "handle"],
    "validation": ["validate", "check", "verify", "sanitize"],
    "config": ["configuration", "settings", "properties", "options"],
    "util": ["utility", "helper", "common", "shared"],
    "service": ["manager", "handler", "processor", "provider"],
    "factory": ["builder", "creator", "generator"],
    "payment": ["pay", "transaction", "checkout", "billing", "charge", "invoice"],
    "transaction": ["payment", "transfer", "operation"],
    "user": ["account", "profile", "member", "customer"],
    "account": ["user", "profile", "credential"],
}

# File suffixes and languages of the generic extractor.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".c": "c",
    ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
}

# Limits.
MAX_PRIMARY, MAX_EXPANDED, MAX_KEYWORDS, EXPANSIONS_SEARCHED = 10, 15, 10, 5
RRF_K, KEYWORD_WEIGHT = 60, 1.1
TOKENS_PER_BATCH, ITEMS_PER_BATCH, OVERSIZE_TOKENS = 15000, 100, 15000
MIN_CHUNK_LINES, MAX_CHUNK_LINES = 3, 200
HISTORY_SHOWN, HISTORY_CHARS = 4, 200

# Phrases of questions that ask for a list of classes.
CLASS_LIST_PHRASES = ["list all", "list the", "show all", "show the", "which are", "what are", "how many", "count"]
