"""Fixed values.

Word lists, lookup sets, text patterns and message texts that decide results, so they
are stated here as plain text in one place.  Nothing in this module computes anything.
Patterns are Java regular expressions; ``(?iu)`` is case-insensitive over Unicode.
"""

# --- Fixed values: domain suffixes -------------------------------------------------

COUNTRY_CODES = [
    "uk", "au", "ca", "in", "np", "nz", "za", "br", "mx", "ar", "cl", "pe", "co",
    "jp", "kr", "cn", "hk", "sg", "my", "th", "id", "ph", "vn", "tw", "de", "fr",
    "it", "es", "nl", "be", "at", "ch", "se", "no", "dk", "fi", "pl", "cz", "hu",
    "sk", "si", "hr", "rs", "bg", "ro", "gr", "cy", "mt", "ie", "pt", "lu", "li",
    "is", "lv", "lt", "ee", "ua", "ru", "by", "md", "eg", "il", "tr", "sa", "ae",
    "qa", "kw", "bh", "om", "jo", "lb", "ir", "ke", "ng", "gh", "ma", "tn", "dz",
    "ly", "sd", "et", "tz", "ug", "rw", "bd", "pk", "lk", "mm", "la", "kh", "bn",
    "mv",
]

SECOND_LEVEL_LABELS = [
    "co", "com", "org", "net", "edu", "gov", "mil", "ac", "sch", "uni", "info",
    "biz", "name", "pro", "museum", "travel", "mobi", "tel", "jobs", "cat", "asia",
    "post", "geo", "int",
]

# --- Fixed values: page extraction ---------------------------------------------------

SKIPPED_LINK_PREFIXES = ["#", "javascript:", "mailto:", "tel:"]

# Two further markers of the original list are mixed-case and are looked for in
# lower-cased text, so they can never match and are left out.
FRAMEWORK_MARKERS = [
    "data-react", "ng-", "v-", "data-vue", "react-root", "angular", "vue",
    "data-reactroot", "data-hydrated", "data-server-rendered", "spa-",
    "window.", "document.",
]
LAZY_MARKERS = [
    "async", "defer", "data-lazy", "lazy-load", "intersection-observer", "data-src",
]
MANY_SCRIPTS = 5

# --- Fixed values: JSON-LD -------------------------------------------------------------

GEO_TYPES = ["Place", "LocalBusiness"]
PLACE_TYPES = ["Place", "LocalBusiness", "Organization"]

# --- Fixed values: llm.txt ---------------------------------------------------------------

LLM_PATHS = [
    "/llms.txt",
    "/llm.txt",
    "/.well-known/llms.txt",
    "/.well-known/llm.txt",
    "/ai.txt",
    "/robots/llm.txt",
    "/public/llm.txt",
    "/docs/llms.txt",
    "/docs/llm.txt",
]
LLM_SUBDOMAINS = [
    "docs", "developer", "developers", "platform", "api", "support", "help", "www",
]
LLM_MIN_LENGTH = 30
# a text of more line ends counts as a file without any indicator
LLM_LINE_ENDS = 10
LLM_JSON_MARKERS = [
    '"@type":', '"@context":', '"name":', '"url":', '"logo":', '"contactpoint":',
]
LLM_INDICATORS = [
    "llms.txt", "llm.txt", "# llms.txt", "# llm.txt",
    "ai:", "llm:", "model:", "assistant:", "chatgpt:", "gpt:",
    "for ai systems", "for llm", "for language models", "for ai models",
    "ai instructions", "llm instructions", "model instructions",
    "when citing this site", "when summarizing this site", "ai guidelines",
    "user-agent:", "allow-training:", "allow-retrieval:", "bot access",
    "sitemap:", "main navigation:", "languages supported:",
    ".com llms.txt", ".org llms.txt", ".net llms.txt", ".ai llms.txt",
    "## docs", "## web", "## api", "## documentation",
    "- [", "](",
]
WEBSITE_TERMS = [
    "copyright", "©", "all rights reserved", "privacy policy", "terms of service",
    "home", "about us", "contact us", "buy now",
    "subscribe", "newsletter", "follow us", "social media",
]
WEBSITE_TERMS_ALLOWED = 3
POLICY_TERMS = ["sitemap:", "user-agent:", "allow-training:"]

LLM_COMMENT_WORDS = ["llm", "ai:", "gpt", "assistant", "model:", "instructions"]
LLM_META_NAME_WORDS = ["llm", "ai", "assistant", "model"]
LLM_META_CONTENT_WORDS = ["ai:", "llm:", "model:", "assistant:"]
LLM_JSON_LD_WORDS = ["llm", "ai", "assistant", "model", "gpt"]
HIDDEN_TAGS = ["div", "span", "p"]
HIDDEN_STYLES = ["display:none", "visibility:hidden", "opacity:0"]
# attribute, substring of its value (None: the attribute only has to be there), label
LLM_SELECTORS = [
    ("class", "llm", '[class*="llm"]'),
    ("class", "ai-", '[class*="ai-"]'),
    ("class", "assistant", '[class*="assistant"]'),
    ("id", "llm", '[id*="llm"]'),
    ("id", "ai-", '[id*="ai-"]'),
    ("id", "assistant", '[id*="assistant"]'),
    ("data-llm", None, "[data-llm]"),
    ("data-ai", None, "[data-ai]"),
    ("data-assistant", None, "[data-assistant]"),
]
LLM_TEXT_PATTERNS = [
    r"(?imdU)(?:^|\n)\s*(?:ai|llm|model|assistant):\s*.+",
    r"(?imdU)(?:^|\n)\s*#\s*(?:ai|llm|model|assistant)\s+.+",
    r"(?imdU)instructions?\s+for\s+(?:ai|llm|model|assistant)",
    r"(?imdU)(?:ai|llm|model|assistant)\s+(?:instructions?|guidelines?|rules?)",
]
# section, words that put a line into it; the first section that matches takes the line
LLM_SECTION_WORDS = [
    ("ai_instructions", ["model:", "ai:", "llm:", "gpt:", "assistant:"]),
    ("knowledge_base", ["knowledge:", "training:", "data:", "information:"]),
    ("context_info", ["context:", "about:", "description:", "purpose:"]),
    ("geo_optimization_hints",
     ["seo:", "optimization:", "search:", "ranking:", "visibility:"]),
    ("model_specifications",
     ["version:", "parameters:", "capabilities:", "limitations:"]),
]
LLM_SECTIONS = [
    "headers", "ai_instructions", "knowledge_base", "context_info",
    "model_specifications", "geo_optimization_hints",
]
LLM_SCORE_ANY = 20
LLM_SCORE_SECTION = {
    "ai_instructions": 25,
    "knowledge_base": 20,
    "context_info": 15,
    "geo_optimization_hints": 20,
}
LLM_SCORE_ITEMS = [(10, 10), (5, 5)]  # more items than, points
LLM_SCORE_MAX = 100

# --- Fixed values: structure audit ----------------------------------------------------------

HEADING_LEVELS = [1, 2, 3, 4, 5, 6]
HEADING_PATTERN = r"(?is)<h{level}[^>]*>(.*?)</h{level}>"
SEMANTIC_TAGS = ["article", "section", "nav", "header", "footer", "main"]
SEMANTIC_PATTERN = r"(?iu)<{tag}[^>]*>"
CRITICAL_TAGS = ["title", "description"]
SOCIAL_TAGS = ["og:title", "og:description", "og:image"]
# pattern, whether it also counts as a question pattern
FAQ_PATTERNS = [
    (r'(?iu)<div[^>]*class="[^"]*faq[^"]*"[^>]*>', False),
    (r'(?iu)<section[^>]*class="[^"]*faq[^"]*"[^>]*>', False),
    (r"(?iu)<h[1-6][^>]*>[^<]*\?[^<]*</h[1-6]>", True),
    (r"(?iu)<dt[^>]*>[^<]*\?[^<]*</dt>", True),
    (r'(?iu)<p[^>]*class="[^"]*question[^"]*"[^>]*>', False),
    (r'(?iu)<div[^>]*class="[^"]*question[^"]*"[^>]*>', False),
]
QA_PATTERN = r"(?iu)Q:|A:|Question:|Answer:"
FAQ_QUESTIONS_OVER = 3
FAQ_INDICATORS_OVER = 6
SCHEMA_PATTERNS = {
    "json_ld": r'(?iu)<script[^>]*type="application/ld\+json"[^>]*>',
    "microdata": r"(?iu)itemscope|itemtype|itemprop",
    "rdfa": r"(?iu)property=|typeof=|vocab=",
    "faq_schema": r'(?iU)"@type":{ws}*"FAQ',
    "article_schema": r'(?iU)"@type":{ws}*"Article',
    "organization_schema": r'(?iU)"@type":{ws}*"Organization',
    "breadcrumb_schema": r'(?iU)"@type":{ws}*"BreadcrumbList',
}
SCHEMA_MARKUP = ["json_ld", "microdata", "rdfa"]
SCHEMA_SPECIFIC = [
    "faq_schema", "article_schema", "organization_schema", "breadcrumb_schema",
]
SHORT_PAGE_WORDS = 300
FAQ_TEXT_PATTERN = r"(?iud)faq|frequently.*asked|common.*questions"
FAQ_CLASS_PATTERN = r'(?iu)<[^>]*class="[^"]*faq[^"]*"[^>]*>'

# --- Fixed values: recommendations ------------------------------------------------------------

RECOMMENDATIONS_KEPT = 4
FEW_HEADINGS = 3
LONG_PAGE_WORDS = 500
# title, description, priority; {} takes the measured value
RULES = {
    "llm_txt": (
        "Add LLM.txt File",
        "Create an LLM.txt file with structured instructions for AI systems to improve generative engine optimization and AI citations.",
        "High",
    ),
    "meta": (
        "Add Missing Meta Tags",
        "Add these missing meta tags: {}. Include title, description, and Open Graph tags.",
        "High",
    ),
    "no_h1": (
        "Add H1 Heading",
        "Add one clear H1 heading that describes your main topic.",
        "High",
    ),
    "many_h1": (
        "Fix Multiple H1 Tags",
        "Use only one H1 tag. Convert the other {} H1 tags to H2 or H3.",
        "High",
    ),
    "few_headings": (
        "Add More Headings",
        "Add more H2 and H3 headings to organize your content better (currently {}).",
        "Medium",
    ),
    "short": (
        "Expand Content",
        "Increase content from {} to at least 300-500 words for better authority.",
        "Medium",
    ),
    "semantic": (
        "Add Semantic HTML",
        "Use semantic HTML5 tags like <article>, <section>, <header>, and <main>.",
        "Medium",
    ),
    "json_ld": (
        "Add JSON-LD Schema",
        "Implement JSON-LD structured data markup for optimal AI understanding and citation.",
        "High",
    ),
    "faq": (
        "Add FAQ Section",
        "Create a FAQ section with structured Q&A format for common questions.",
        "Low",
    ),
}
FILLERS = [
    (
        "Add Meta Description",
        "Create a 150-160 character meta description for this page.",
        "High",
    ),
    (
        "Improve Page Structure",
        "Organize content with proper headings and semantic HTML elements.",
        "Medium",
    ),
    (
        "Add Schema Markup",
        "Implement JSON-LD structured data for AI citation optimization.",
        "Medium",
    ),
    (
        "Enhance Content Structure",
        "Add FAQ sections and improve content organization for better AI understanding.",
        "Low",
    ),
]
DANGLING_WORDS = [" an", " the", " a"]
MEANINGFUL_LENGTH = 20
DEFAULT_PRIORITY = "Medium"

# --- Fixed values: query sets --------------------------------------------------------------------

DIRECT = "Direct"
GENERIC = "Generic"
FALLBACK_QUERY = "Failed query generation process. Return blank"
DEFAULT_QUERY_COUNT = 3
DEFAULT_DIRECT_SHARE = 0.1
CHART_DOMAINS = 10
