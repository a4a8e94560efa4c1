"""Fixed values of the domain."""

# Weights of the score's dimensions.
WEIGHTS = {"product": 0.18, "pricing": 0.16, "features": 0.14, "positioning": 0.14, "seo": 0.12, "marketing": 0.12, "brand": 0.09, "sentiment": 0.05}
# Severities and threat levels, lowest rank first, and what log keys are redacted or safe.
SEVERITIES = ("low", "medium", "high")
THREATS = ("unknown", "low", "moderate", "high", "critical")
# Page types in rule order, with base value, URL words and anchor words.
PAGE_RULES = (
    ("pricing", 10.0, ("pricing", "price", "plans", "subscribe", "buy", "tarif", "cennik"), ("pricing", "plans", "how much")),
    ("product", 8.0, ("product", "products", "solutions", "platform", "app", "services"), ("product", "solution", "platform")),
    ("features", 7.5, ("features", "feature", "capabilities", "what-we-do", "how-it-works"), ("features", "capabilities", "how it works")),
    ("about", 5.5, ("about", "about-us", "company", "who-we-are", "story", "team"), ("about", "company", "our story")),
    ("case_study", 5.0, ("case-study", "case-studies", "customers", "customer-stories", "success"), ("case study", "customer", "success story")),
    ("docs", 3.0, ("docs", "documentation", "developers", "api", "guides"), ("docs", "documentation", "api")),
    ("blog", 2.5, ("blog", "news", "insights", "resources", "articles", "press"), ("blog", "news", "resources")),
    ("contact", 2.0, ("contact", "contact-us", "support", "help"), ("contact", "support")),
    ("careers", 0.6, ("careers", "jobs", "hiring", "work-with-us"), ("careers", "jobs")),
    ("legal", 0.2, ("privacy", "terms", "legal", "cookie", "gdpr", "imprint", "dpa"), ("privacy", "terms", "legal")),
)
TYPE_CAPS = {"blog": 3, "case_study": 3, "docs": 2, "legal": 0, "careers": 1, "product": 6, "features": 4, "pricing": 3, "other": 4}
DEFAULT_CAP = 3
NOISE_PATTERN = r"(?i)/(tag|tags|category|categories|author|page|archive|search|feed|amp)(/|$)|[?&](page|p|q|s|filter|sort)="
# URL hygiene.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "ref", "referrer", "mc_cid", "mc_eid", "_ga", "igshid")
BLOCKED_SUFFIXES = (".local", ".localhost", ".internal", ".intranet", ".corp", ".home", ".lan", ".test", ".example", ".invalid")
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata.goog", "instance-data")
BINARY_SUFFIXES = "pdf zip rar 7z gz tar dmg exe msi png jpg jpeg gif webp svg ico avif mp4 mp3 wav mov avi webm css js json xml rss atom woff woff2 ttf eot".split()
# Prices.
CURRENCY_CODES = ("AUD", "BGN", "BRL", "CAD", "CHF", "EUR", "GBP", "INR", "JPY", "PLN", "RUB", "SEK", "USD")
CURRENCY_SYMBOLS = {"R$": "BRL", "C$": "CAD", "A$": "AUD", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB", "лв": "BGN", "zł": "PLN"}
PERIODS = {"month": "monthly", "mo": "monthly", "monthly": "monthly", "year": "yearly", "yr": "yearly", "yearly": "yearly", "annual": "yearly", "annually": "yearly", "one-time": "one_time", "lifetime": "one_time", "user": "monthly", "seat": "monthly"}
PERIOD_PATTERN = r"(?i)(?:/|per\s+|a\s+|each\s+)(month|mo\b|year|yr\b|annually|user|seat|day|week)|\b(monthly|yearly|annual|annually|one[- ]time|lifetime)\b"
PLAN_WORDS = ("free", "starter", "basic", "essential", "standard", "plus", "pro", "professional", "team", "business", "growth", "premium", "enterprise", "scale", "ultimate")
CTA_WORDS = ("get started", "start free", "free trial", "try free", "book a demo", "request a demo", "schedule a demo", "contact sales", "talk to sales", "sign up", "buy now", "subscribe", "download", "get a quote")
# Texts that address a model.
INJECTIONS = {
    "instruction_override": r"(?i)\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all)\b[^.\n]{0,30}\b(instruction|prompt|rule|direction|context)",
    "system_prompt_probe": r"(?i)\b(system\s+prompt|initial\s+instructions|your\s+instructions|reveal\s+your|print\s+your\s+(prompt|instructions))\b",
    "role_injection": r"(?im)^\s*(system|assistant|human|user)\s*:",
    "persona_override": r"(?i)\byou\s+are\s+now\b|\bact\s+as\s+(a|an|the)\b[^.\n]{0,40}\b(admin|developer|dan)\b",
    "fence_escape": r"(?i)</?untrusted_content[^>]*>",
    "tool_invocation": r"(?i)<\s*/?\s*(tool_use|tool_result|function_calls|antml:invoke)\b",
    "exfiltration_request": r"(?i)\b(send|post|upload|exfiltrate)\b[^.\n]{0,40}\b(api[\s_-]?key|token|secret|credential|password)\b",
}
INVISIBLE = "[​-‏‪-‮⁠-⁤﻿]"
# Words that lexical vectors leave out.
STOPWORDS = frozenset("a an and are as at be by for from has have in is it its of on or that the to was were will with you your we our us this these those they them their he she his her".split())
# Monitoring hours by importance, plan limits, social hosts.
MONITOR_HOURS = {"critical": 12, "high": 24, "medium": 72, "low": 168}
PLAN_LIMITS = {"free": (3, 20, 500), "starter": (10, 100, 2500), "growth": (40, 500, 12000), "enterprise": (500, 5000, 150000)}
SOCIAL_HOSTS = ("twitter.com", "x.com", "linkedin.com", "facebook.com", "instagram.com", "youtube.com", "github.com", "tiktok.com", "reddit.com", "discord.gg", "medium.com")
SENSITIVE_PARTS = ("password", "secret", "token", "api_key", "apikey", "authorization", "cookie", "pepper", "credential", "csrf")
SAFE_KEYS = ("tokens_in", "tokens_out", "total_tokens", "ai_tokens_in", "ai_tokens_out", "token_count")
