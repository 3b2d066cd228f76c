"""Everything a query depends on besides its tables: time, thresholds, inventory and lexicon, all parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

AS_OF = "2024-01-31 00:00:00"


@dataclass(frozen=True)
class Product:
    vendor: str
    product: str
    aliases: tuple[str, ...] = ()
    criticality: str = "medium"
    noisy: bool = False


@dataclass(frozen=True)
class Lexicon:
    """Phrases by strength, in the order in which matches are listed."""

    # These lists must hold exactly these phrases, in this order.
    exploitation: tuple[str, ...] = (
        "actively exploited", "active exploitation", "exploited in the wild", "exploitation in the wild", "exploitation observed",
        "under active attack", "mass exploitation", "known exploited vulnerability", "known exploited vulnerabilities",
        "known exploited catalog", "known exploited vulnerabilities catalog", "cisa kev", "kev catalog", "zero-day", "0-day", "zero day",
        "emergency patch", "emergency update", "out-of-band patch", "weaponized exploit", "weaponised exploit", "remote code execution",
        "pre-auth rce", "unauthenticated rce", "rce", "authentication bypass", "auth bypass", "authorization bypass", "privilege escalation",
    )
    incident: tuple[str, ...] = ("ransomware", "data breach", "data leak", "compromise", "compromised", "backdoor", "supply chain attack", "account takeover")
    medium: tuple[str, ...] = (
        "vulnerability", "security vulnerability", "critical vulnerability", "critical flaw", "flaw", "security bug", "weakness",
        "patch tuesday", "patch", "security patch", "security update", "advisory", "security advisory", "disclosure", "exploit code",
        "proof of concept", "proof-of-concept", "poc", "public exploit", "public poc", "malware", "trojan", "infostealer", "botnet",
        "threat actor", "apt", "ioc", "indicator of compromise", "phishing", "credential theft", "sql injection", "sqli", "xss", "ssrf",
        "path traversal", "information disclosure", "denial of service", "dos", "ddos", "misconfiguration", "credential exposure",
        "api key leak", "secret leak",
    )
    low: tuple[str, ...] = (
        "security", "cybersecurity", "cyber", "risk", "privacy", "trust", "secure", "protection", "hardening", "update", "fix", "research",
        "analysis", "report", "warning", "alert", "investigation", "attack", "attacker", "hacker", "identity", "access", "authentication",
        "authorization", "authorisation", "login", "password", "account", "admin", "administrator", "api", "cloud", "network", "endpoint",
        "certificate", "encryption", "sso", "mfa",
    )
    negative: tuple[str, ...] = (
        "product review", "stock price", "share price", "earnings call", "quarterly results", "annual results", "financial results",
        "market outlook", "investor presentation", "hiring", "job opening", "career", "conference agenda", "webinar", "sponsored", "award",
        "partnership announcement", "marketing campaign", "product launch", "new feature", "feature release", "customer story",
        "case study", "press release", "thought leadership", "executive appointment", "leadership change", "funding round", "acquisition",
        "merger", "breach of contract", "breach of agreement", "breach of policy", "market opportunity", "market growth",
    )
    flat: tuple[str, ...] = (
        "0-day", "active exploitation", "authentication bypass", "backdoor", "breach", "compromise", "credential theft", "cve", "data leak",
        "emergency update", "exploit", "exploited", "incident", "malware", "patch", "privilege escalation", "ransomware",
        "remote code execution", "rce", "supply chain", "vulnerability", "zero-day",
    )
    # Pairs of low phrases that together weigh more.
    pairs: tuple[tuple[str, str], ...] = (
        ("identity", "attack"), ("cloud", "vulnerability"), ("authentication", "bypass"), ("admin", "compromise"),
        ("api", "exposure"), ("account", "takeover"), ("password", "leak"), ("login", "bypass"),
    )
    # Categories that speak of security.
    categories: tuple[str, ...] = (
        "security", "cybersecurity", "vulnerability", "vulnerabilities", "malware", "ransomware", "zero day", "zero-day", "data breach",
        "threat intelligence", "security advisory", "patch", "incident",
    )
    # Source tiers; the first tier with a part of the name wins.
    tiers: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("government_cert", ("cisa", "cert")),
        ("official_vendor", ("psirt", "msrc", "security advisories")),
        ("security_media", ("bleeping", "hacker news", "krebs", "securityweek", "dark reading")),
        ("researcher_blog", ("blog", "research")),
        ("general_news", ("business", "news")),
    )


#: Inventory of the fixture tables.
INVENTORY = (
    Product("Acme", "Acme Gateway", ("Acme GW",), "critical"),
    Product("Globex", "Globex Cloud", ("Globex",), "high", noisy=True),
    Product("Initech", "Initech Vault", ("Vault PAM",), "medium"),
)


@dataclass(frozen=True)
class Context:
    as_of: str = AS_OF
    inventory: tuple[Product, ...] = INVENTORY
    lexicon: Lexicon = field(default_factory=Lexicon)
    keep_score: int = 50
    min_alert_confidence: float = 0.75
    early_hours: int = 24
    suppression_hours: int = 6
    attach_distance: float = 0.15
    uncertain_distance: float = 0.35
    duplicate_distance: float = 0.18


DEFAULT = Context()
