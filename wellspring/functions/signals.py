"""Expected-signal matching: an ordered dictionary of patterns, compiled into foldable expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal key and pattern, in order; (?i) except where case counts.
PATTERNS = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", r"(?<![0-9.])(?:\+?1[-.\s]?)?(?:\([0-9]{3}\)|[0-9]{3})[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}(?![0-9%])"),
    ("address", r"(?i)\d+\s+[\w\s]+(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|court|ct)"),
    ("contact form", r"(?i)contact\s*(?:us|form|page)?|get\s*in\s*touch"),
    ("business description", r"(?i)(?:we\s+(?:are|help|provide|offer|build|create|make|deliver)|(?:is\s+a|leading|platform|solution|service|company|tool))"),
    ("industry", r"(?i)(?:automation|software|saas|technology|platform|integration|workflow|productivity|enterprise|business)"),
    ("primary activity", r"(?i)(?:helps?\s+(?:you|teams?|businesses?|companies?|organizations?))|(?:enables?\s+)|(?:allows?\s+)"),
    ("founder", r"(?i)(?:founded\s+by|co-?founder|ceo|chief\s+executive)"),
    ("founding year", r"(?i)(?:founded|established|started|launched|since)\s*(?:in\s*)?(19|20)\d{2}"),
    ("founding", r"(?i)(?:founded|established|started|launched|began)"),
    ("headquarters", r"(?i)(?:headquarter|hq|based\s+in|located\s+in|office\s+in)"),
    ("operating regions", r"(?i)(?:worldwide|global|international|countries|regions)"),
    ("office", r"(?i)(?:office|location|branch)\s*(?:in|at)?"),
    ("product", r"(?i)(?:product|feature|tool|app|application|platform|solution|service)"),
    ("service", r"(?i)(?:service|offering|solution|support|consulting)"),
    ("feature", r"(?i)(?:feature|capability|function|ability)"),
    ("description", r"(?i)(?:enables?|allows?|helps?|provides?|offers?|delivers?)"),
    ("pricing", r"(?i)(?:pricing|price|cost|\$\d+|free\s+(?:tier|plan|trial)|per\s+(?:month|year|user))"),
    ("tier", r"(?i)(?:plan|tier|package|edition|version)\s*(?:s)?"),
    ("customer", r"(?i)(?:customer|client|user|team|organization|company|business)"),
    ("segment", r"(?i)(?:small\s+business|enterprise|startup|agency|freelancer|developer|marketer)"),
    ("use case", r"(?i)(?:use\s+case|workflow|automation|integration|scenario)"),
    ("vertical", r"(?i)(?:industry|sector|vertical|market)"),
    ("pain point", r"(?i)(?:challenge|problem|issue|struggle|difficulty|pain)"),
    ("solution", r"(?i)(?:solution|solve|fix|address|resolve|help)"),
    ("outcome", r"(?i)(?:result|outcome|benefit|improvement|save|increase|reduce)"),
    ("client", r"(?i)(?:customer|client|partner|user)\s*(?:s)?"),
    ("case stud", r"(?i)(?:case\s+stud|success\s+stor|testimonial)"),
    ("testimonial", r"(?i)(?:testimonial|review|quote|said|says)"),
    ("logo", r"(?i)(?:trusted\s+by|used\s+by|powering|serving)"),
    ("partnership", r"(?i)(?:partner|integration|connect|work\s+with)"),
    ("award", r"(?i)(?:award|winner|recognized|honored|best|top)"),
    ("certification", r"(?i)(?:certified|certification|compliance|soc\s*2|gdpr|hipaa|iso)"),
    ("recognition", r"(?i)(?:recognized|featured|mentioned|covered|press)"),
    ("press", r"(?i)(?:press|news|media|article|coverage|featured\s+in)"),
    ("years", r"(?i)(?:\d+\s*\+?\s*years?|since\s+\d{4}|established\s+\d{4})"),
    ("growth", r"(?i)(?:growth|growing|scale|expanded|million|billion|\d+[kmb]\+?\s*(?:user|customer|company))"),
    ("success", r"(?i)(?:success|achievement|milestone|accomplish)"),
    ("count", r"(?i)(?:\d+[,\d]*\s*(?:\+\s*)?(?:user|customer|client|company|team|business))"),
    ("unique", r"(?i)(?:unique|only|first|exclusive|proprietary|patented)"),
    ("advantage", r"(?i)(?:advantage|benefit|better|faster|easier|simpler)"),
    ("proprietary", r"(?i)(?:proprietary|patent|exclusive|innovative)"),
    ("differentiating", r"(?i)(?:different|unique|stand\s*out|unlike|versus|vs)"),
    ("value", r"(?i)(?:value|benefit|advantage|why\s+choose|reason)"),
    ("benefit", r"(?i)(?:benefit|advantage|improve|enhance|boost|save)"),
    ("selling point", r"(?i)(?:why|benefit|advantage|feature|capability)"),
    ("mission", r"(?i)(?:mission|purpose|goal|aim|strive)"),
    ("vision", r"(?i)(?:vision|future|believe|dream|aspire)"),
    ("core value", r"(?i)(?:value|principle|believe|commitment|culture)"),
    ("purpose", r"(?i)(?:purpose|why|reason|mission|passion)"),
    ("signup", r"(?i)(?:sign\s*up|register|create\s+account|get\s+started|start\s+free)"),
    ("getting started", r"(?i)(?:get\s*(?:ting)?\s*started|begin|start|onboard)"),
    ("trial", r"(?i)(?:free\s+trial|try\s+(?:it\s+)?free|demo|test\s+drive)"),
    ("demo", r"(?i)(?:demo|demonstration|tour|walkthrough|preview)"),
]


def keys_of(signal: str) -> list[str]:
    """Patterns of the keys that the signal's name contains."""
    return [p for k, p in PATTERNS if k in signal.lower()]


def confidence(content: Column, signal: str) -> Column:
    """1 where a pattern of the signal's keys or the signal itself is found, else the share of its long words present."""
    low = F.lower(content)
    words = [w for w in signal.lower().split() if len(w) > 3]
    exact = F.contains(low, F.lit(signal.lower()))
    for p in keys_of(signal):
        exact = exact | content.rlike(p)
    share = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) / len(words) if words else F.lit(0.0)
    return F.when(exact, 1.0).otherwise(share)


def found(conf: Column, threshold: float = 0.6) -> Column:
    return conf >= threshold
