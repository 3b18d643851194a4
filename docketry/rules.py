"""Word lists, patterns, weights and templates that results depend on."""

from __future__ import annotations

JURISDICTIONS = {
    "RBI": "Reserve Bank of India",
    "SEBI": "Securities and Exchange Board of India",
    "FDA": "U.S. Food and Drug Administration",
    "EU_AI_ACT": "European Union AI Act",
}
SEVERITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}
STAGES = ("fetched", "parsed", "normalized", "deduplicated", "classified", "summarized", "indexed", "risk_assessed", "actions_planned", "notified")

# Bundled sources: id, name, jurisdiction, url, source type, description, minutes between crawls, tags.
BUNDLED_SOURCES = (
    ("rbi-notifications", "RBI Notifications", "RBI", "https://www.rbi.org.in/Scripts/NotificationUser.aspx", "html", "Circulars and notifications issued by the Reserve Bank of India.", 720, ("banking", "india", "circulars")),
    ("rbi-press-releases", "RBI Press Releases", "RBI", "https://www.rbi.org.in/Scripts/BS_PressReleaseDisplay.aspx", "html", "Official press releases from the Reserve Bank of India.", 1440, ("banking", "india", "press")),
    ("sebi-legal-circulars", "SEBI Legal Circulars", "SEBI", "https://www.sebi.gov.in/sebiweb/home/HomeAction.do?doListing=yes&sid=1&ssid=6&smid=0", "html", "Circulars published by the Securities and Exchange Board of India.", 720, ("securities", "india", "circulars")),
    ("fda-press-announcements", "FDA Press Announcements", "FDA", "https://www.fda.gov/about-fda/contact-fda/stay-informed/rss-feeds/press-releases/rss.xml", "rss", "FDA press announcements RSS feed.", 360, ("healthcare", "usa", "press")),
    ("fda-federal-register", "FDA Federal Register Rules", "FDA", "https://www.federalregister.gov/agencies/food-and-drug-administration", "html", "FDA rules and notices published in the US Federal Register.", 720, ("healthcare", "usa", "rules")),
    ("eu-ai-act-updates", "EU AI Act Newsroom", "EU_AI_ACT", "https://digital-strategy.ec.europa.eu/en/policies/regulatory-framework-ai", "html", "Updates to the EU regulatory framework for artificial intelligence.", 1440, ("ai", "eu", "regulation")),
)

# Topics, in order; the size of each list enters the confidence.
TOPICS = (
    ("capital adequacy", ("capital", "adequacy", "basel", "car", "crar", "tier")),
    ("KYC / AML", ("kyc", "aml", "anti-money", "laundering", "customer due diligence", "cdd", "identity")),
    ("digital lending", ("digital lending", "fintech", "nbfc", "lending platform", "rbi digital")),
    ("data privacy", ("data protection", "privacy", "gdpr", "personal data", "dpdp")),
    ("AI regulation", ("artificial intelligence", "ai act", "ai system", "algorithmic", "machine learning")),
    ("securities disclosure", ("disclosure", "mutual fund", "portfolio", "sebi circular", "insider trading")),
    ("clinical trials", ("clinical trial", "fda approval", "21 cfr", "medical device", "drug safety")),
    ("payments", ("upi", "payment system", "rtgs", "neft", "payment aggregator", "ppi")),
    ("cybersecurity", ("cyber", "information security", "incident reporting", "it governance", "ransomware")),
    ("consumer protection", ("consumer", "grievance", "ombudsman", "fair practice", "complaint")),
    ("licensing", ("license", "licence", "authorization", "registration", "permit")),
    ("reporting requirements", ("reporting", "return", "filing", "disclosure", "submission")),
)
TOPIC_FACTOR = 0.5

# Business functions, in order.
FUNCTIONS = (
    ("Compliance", ("compliance", "regulatory", "circular", "notification", "mandate")),
    ("Risk Management", ("risk", "exposure", "capital", "stress test", "provisioning")),
    ("Legal", ("act", "section", "regulation", "statute", "penalty", "enforcement")),
    ("Operations", ("process", "procedure", "operational", "implementation", "system")),
    ("Technology", ("technology", "digital", "cyber", "software", "platform", "api")),
    ("Finance", ("accounting", "audit", "financial statement", "disclosure", "reporting")),
    ("Product", ("product", "scheme", "offering", "service", "customer")),
    ("HR / Training", ("training", "employee", "staff", "human resource", "awareness")),
)
FUNCTION_FACTOR = 0.4

JURISDICTION_WORDS = (
    ("RBI", ("rbi", "reserve bank", "banking regulation act", "nbfc", "scheduled commercial bank")),
    ("SEBI", ("sebi", "securities and exchange board", "mutual fund", "stock exchange", "listing")),
    ("FDA", ("fda", "food and drug", "21 cfr", "federal register", "clinical trial")),
    ("EU_AI_ACT", ("eu ai act", "artificial intelligence act", "european commission", "annex", "high-risk ai")),
)
JURISDICTION_FACTOR = 0.4
DECLARED_BONUS = 0.2
DECLARED_ALONE = 0.5

# Document types: the first of the list wins.
DOC_TYPES = ("circular", "notification", "guideline", "regulation", "direction", "press release")
URGENT = r"\b(immediate(?:ly)?|with immediate effect|forthwith|urgent)\b"
NEAR_TERM = r"\b(within \d+ days|by \w+ \d{4}|effective from|deadline)\b"

URGENCY_SCORES = {"immediate": 1.0, "near-term": 0.6, "routine": 0.2}
URGENCY_NONE = 0.3
DOC_TYPE_SCORES = {"regulation": 0.9, "direction": 0.85, "circular": 0.7, "notification": 0.6, "guideline": 0.5, "press release": 0.2}
DOC_TYPE_NONE = 0.4

HIGH_RISK = (
    (r"\bpenalt(?:y|ies)\b", 0.8),
    (r"\benforcemen[t]\b", 0.7),
    (r"\bprohibit(?:ed|ion)?\b", 0.9),
    (r"\brevok(?:e|ed|ation)\b", 0.9),
    (r"\bsuspend(?:ed|sion)?\b", 0.8),
    (r"\bmandatory\b", 0.6),
    (r"\bwith immediate effect\b", 0.9),
    (r"\bnon-?compliance\b", 0.7),
    (r"\bbreach\b", 0.6),
    (r"\bcessation\b", 0.8),
    (r"\bsupersede[sd]?\b", 0.5),
)
AMOUNT = r"(?:Rs\.?|INR|USD|\$|€|EUR)\s*[\d,]+(?:\.\d+)?(?:\s*(?:crore|lakh|million|billion))?"

# Reference numbers in order of priority; the last one's number is its group.
REFERENCES = (
    (r"\bRBI/\d{4}-\d{2,4}/\d+[A-Z0-9./-]*", 0),
    (r"\bSEBI/[A-Z0-9]+(?:/[A-Z0-9.-]+)+/\d{4}/\d+", 0),
    (r"\bRegulation\s*\(EU\)\s*\d{4}/\d+", 0),
    (r"\b(?:Circular|Notification|Ref(?:erence)?|Document)\s*(?:No\.?|Number|#)\s*[:.-]?\s*([A-Z0-9][A-Z0-9./-]{2,})", 1),
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

BOILERPLATE = (
    r"^skip to (?:main )?content$",
    r"^back to top$",
    r"^©.*$",
    r"^(?:\(c\)|copyright)\b.*$",
    r"^all rights reserved\.?$",
    r"^page \d+(?: of \d+)?$",
    r"^\d+\s*/\s*\d+$",
    r"^privacy policy$",
    r"^terms (?:of use|and conditions)$",
    r"^cookie(?:s)? (?:policy|notice|settings)$",
    r"^(?:we use cookies|this (?:site|website) uses cookies)\b.*$",
    r"^accept(?: all)?(?: cookies)?$",
    r"^loading\.{0,3}$",
    r"^(?:home|menu|search|login|sign in|register)$",
    r"^print(?:ed)?(?: this page| from .*)?$",
    r"^download(?:ed)?(?: from .*)?$",
    r"^share (?:this|on) .*$",
    r"^last updated:?.*$",
)

STOPWORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "are", "for", "that", "this", "with", "as", "be", "by", "on", "or", "an", "it", "shall", "not"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "est", "pour", "que", "dans", "sur", "par", "au", "aux", "ce", "ne", "pas"),
    "de": ("der", "die", "das", "und", "ist", "den", "von", "zu", "im", "mit", "dem", "ein", "eine", "nicht", "auch", "auf", "für"),
    "es": ("el", "la", "los", "las", "de", "y", "un", "una", "es", "que", "en", "para", "por", "con", "no", "se", "su", "del", "al"),
    "it": ("il", "la", "di", "e", "che", "un", "una", "per", "non", "con", "sono", "come", "del", "le", "gli", "nella", "alla"),
    "pt": ("o", "a", "os", "de", "e", "que", "do", "da", "em", "um", "uma", "para", "com", "não", "se", "na", "no", "por", "dos"),
    "nl": ("de", "het", "een", "en", "van", "is", "op", "te", "dat", "met", "voor", "zijn", "niet", "aan", "door", "ook", "als"),
}
SCRIPTS = (("hi", "0900", "097F"), ("ru", "0400", "04FF"), ("ar", "0600", "06FF"), ("he", "0590", "05FF"), ("el", "0370", "03FF"), ("ja", "3040", "30FF"), ("ko", "AC00", "D7A3"), ("zh", "4E00", "9FFF"))

# Punctuation: single characters, then the one that becomes three.
PUNCTUATION_FROM = "‘’‚“”„–—― •·"
PUNCTUATION_TO = "'''\"\"\"--- --"
ELLIPSIS = "…"
SPACES = "               　"
ZERO_WIDTH = "​‌‍⁠﻿"

# Actions: key, owner, days, title, description.
ACTIONS = (
    ("review", "Compliance", 14, "Review {doc_type}: {title}", "Review the regulatory document '{title}' ({reference}) from {jurisdiction}. Assess applicability to current operations and identify required changes."),
    ("gap_analysis", "Compliance", 21, "Conduct gap analysis for {title}", "Perform a gap analysis between current policies/processes and the requirements of '{title}' ({reference}). Document gaps and remediation steps."),
    ("policy_update", "Legal", 30, "Update policies per {reference}", "Update internal policies and procedures to comply with {title} ({reference}). Coordinate with Legal and affected business units."),
    ("system_change", "Technology", 45, "Implement system changes for {reference}", "Implement required system/technology changes to comply with '{title}' ({reference}). Coordinate with Technology and Operations teams."),
    ("training", "HR / Training", 30, "Conduct training on {title}", "Develop and deliver training materials covering the requirements of '{title}' ({reference}) to affected staff and stakeholders."),
    ("reporting", "Finance", 21, "Set up regulatory reporting for {reference}", "Configure reporting processes and systems to meet the filing requirements of '{title}' ({reference}) within the stated deadline."),
    ("escalation", "Risk Management", 3, "Escalate to senior management: {title}", "Escalate '{title}' ({reference}) to senior management for decision. Risk level: {risk_level}. Immediate attention required."),
    ("acknowledgement", "Compliance", 7, "Acknowledge receipt of {reference}", "File acknowledgement of regulatory communication '{title}' ({reference}) and log in the compliance register."),
)
URGENCY_DAYS = {"immediate": 0.3, "near-term": 0.6}

# Link adapters: patterns a link must hold, and whether it must stay on the source's host.
ADAPTERS = {
    "RBI": (("notificationuser.aspx", "pressreleasedisplay.aspx", "bs_circularindexdisplay.aspx", "notification", "id="), True),
    "SEBI": (("/legal/", "showdetail", "/sebiweb/home/detail", "doarchive"), True),
    "FDA": (("/news-events/", "/drugs/", "/documents/", "/regulatory-information/", "federalregister.gov/documents/"), False),
    "EU_AI_ACT": (("/news/", "/library/", "/policies/", "/news-redirect/", "artificial-intelligence"), True),
}

# Links that lead to no page, and how many a page gives at most.
SKIPPED_LINKS = ("mailto:", "javascript:", "tel:", "#")
MAX_LINKS = 100
# Marks of UTF-8 read as a single-byte table.
MOJIBAKE = ("Ã", "â€", "Â", " Â", "ï»¿")
# Characters that part the words of an embedding.
WORD_SEPARATORS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n"
CHUNK_CHARS = 1000
CHUNK_OVERLAP = 150
RISK_SIGNS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢"}
# Answers of a server after which it is asked again.
RETRY_STATUS = (429, 500, 502, 503, 504)
AUDIT_EVENTS = ("document.fetched", "document.parsed", "document.normalized", "document.classified", "risk.assessed", "action.created", "notification.sent", "approval.granted", "approval.rejected", "error")
