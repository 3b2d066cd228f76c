"""Text functions as column expressions (T and parts of N in the survey)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as trimming and collapsing see it, beyond ASCII too.
SPACE = r"[\s   -     　﻿]"
CVE = r"(?i)(?<![A-Za-z0-9_])CVE-[0-9]{4}-[0-9]{4,}(?![A-Za-z0-9_])"
# Query parameters that don't tell pages apart.
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "mkt_tok", "ref", "spm", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
# Phrases of page furniture.
FURNITURE = ("subscribe", "sign up", "newsletter", "related articles", "read more", "share this", "follow us", "advertisement", "sponsored", "all rights reserved", "cookie")


# How lines of page furniture begin.
JUNK = (
    "subscribe( to)?", "sign up", "get the latest", "related (articles?|posts?|news)", "read (more|next)", "share (this|on)", "follow us", "advertisement", "sponsored", "©", "copyright",
    "all rights reserved", r"tags?\s*:", r"categories\s*:", r"comments?( \(\d+\))?$", "leave a (comment|reply)", "previous (article|post)", "next (article|post)", "you might also like",
    "recommended for you", "trending now", "popular (articles|posts|stories)",
)
#: Characters and words of a line that needs no end of a sentence.
LINE_CHARS, LINE_WORDS = 25, 4

#: The characters of SPACE, for trimming without a pattern.
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, f"{SPACE}+", " "))


def joined(*parts: Column, by: str = "\n") -> Column:
    """Parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x != "", F.lit(False))), by)


def normal_title(c: Column) -> Column:
    straight = F.translate(F.lower(trimmed(c)), "“”‘’", "\"\"''")
    return F.regexp_replace(straight, f"{SPACE}+", " ")


def _phrase(x: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[-_/]+", " ", re.sub("[‐‑‒–—―]", "-", x.lower()))).strip()


def keyword_form(c: Column) -> Column:
    """Lower case, any dashes, underscores and slashes as single spaces."""
    dashes = F.regexp_replace(F.lower(c), "[‐‑‒–—―]", "-")
    return collapsed(F.regexp_replace(dashes, "[-_/]+", " "))


def _bounded(x: str) -> str:
    return f"(?i)(^|[^a-z0-9]){re.escape(x)}([^a-z0-9]|$)"


def has_phrase(text: Column, phrase: str, low: Column | None = None) -> Column:
    """The phrase with no letter or digit next to it. `contains` first, as most texts lack most phrases; `low` is the text in lower case, if it is there."""
    return F.contains(F.lower(text) if low is None else low, F.lit(phrase.lower())) & text.rlike(_bounded(phrase))


def count_phrase(text: Column, phrase: Column) -> Column:
    """Occurrences; neighbours that share a delimiter count once."""
    quoted = F.regexp_replace(phrase, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.regexp_count(text, F.concat(F.lit("(?i)(^|[^a-z0-9])"), quoted, F.lit("([^a-z0-9]|$)")))


def keywords(form: Column, phrases: tuple[str, ...]) -> Column:
    """Phrases of the list, in its order, that stand in a text in keyword form."""
    forms = F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(_phrase(p)).alias("form")) for p in phrases))
    found = F.filter(forms, lambda p: F.contains(form, p["form"]) & F.rlike(form, F.concat(F.lit("(^|[^a-z0-9])"), p["form"], F.lit("([^a-z0-9]|$)"))))
    return F.coalesce(F.transform(found, lambda p: p["phrase"]), F.array().cast("array<string>"))


def substrings(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)), F.array().cast("array<string>"))


def matches(text: Column, pattern: str, case: str | None = None) -> Column:
    """Distinct whole matches in order; `case` upper or lower."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, {"upper": F.upper, "lower": F.lower}[case]) if case else found)


def cves(text: Column) -> Column:
    return matches(text, CVE, "upper")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?<![A-Za-z0-9_])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9_])"
DOMAIN = r"(?i)(?<![a-z0-9_])(?:[a-z0-9-]+\.)+[a-z]{2,}(?![a-z0-9_])"
DIGEST = r"(?i)(?<![a-z0-9_])(?:[a-f0-9]{64}|[a-f0-9]{40}|[a-f0-9]{32})(?![a-z0-9_])"


def html_text(c: Column) -> Column:
    for tag in ("script", "style", "nav", "footer"):
        c = F.regexp_replace(c, f"(?is)<{tag}.*?</{tag}>", " ")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    # The entities that are decoded, in this order.
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.regexp_replace(c, f"(?i){entity}", char)
    return collapsed(c)


def is_content(line: str) -> bool:
    """Whether a line, trimmed and with single spaces, is no furniture and no stub."""
    stub = len(line) < LINE_CHARS and len(line.split(" ")) < LINE_WORDS and line[-1:] not in (".", "!", "?", ":")
    return bool(line) and not re.match(f"(?i)({'|'.join(JUNK)})", line) and not stub


def content_lines(c: Column) -> Column:
    """The lines of a text, trimmed, that `is_content` holds for, as a list."""
    junk, ends = F.lit(f"(?i)^({'|'.join(JUNK)})"), F.lit("[.!?:]$")
    stub = lambda x: (F.length(x) < LINE_CHARS) & (F.size(F.split(x, f"{SPACE}+")) < LINE_WORDS) & ~F.rlike(x, ends)
    return F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: (x != "") & ~F.rlike(x, junk) & ~stub(x))


def quality(c: Column) -> Column:
    """Length up to 1,000 characters, lowered by furniture per thousand characters."""
    text = trimmed(c)
    n = F.length(text)
    density = F.regexp_count(text, F.lit("(?i)(" + "|".join(FURNITURE) + ")")) / F.greatest(F.lit(1.0), n / 1000.0)
    return F.coalesce(F.least(F.lit(1.0), n / 1000.0) * F.greatest(F.lit(0.0), 1 - density / 5.0), F.lit(0.0))


def normal_url(c: Column) -> Column:
    """Addresses of ASCII characters: scheme and host in lower case, no fragment, no tracking parameters, the others sorted, no slash at the end."""
    url = F.regexp_replace(trimmed(c), "#.*$", "")
    scheme, host = F.lower(F.regexp_extract(url, "^([^:]+)://", 1)), F.lower(F.regexp_extract(url, "^[^:]+://([^/?]*)", 1))
    path, query = F.regexp_extract(url, "^[^:]+://[^/?]*([^?]*)", 1), F.regexp_extract(url, r"\?(.*)$", 1)
    name = lambda x: F.lower(F.split(x, "=")[0])
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~name(x).isin(*TRACKING) & ~F.startswith(name(x), F.lit("utm_"))))
    path = F.when(F.length(F.regexp_replace(path, "/+$", "")) == 0, "/").otherwise(F.regexp_replace(path, "/+$", ""))
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def tier(source: Column, tiers: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    out = None
    for name, parts in tiers:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def excerpt(c: Column, n: int) -> Column:
    text = trimmed(c)
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…"))).otherwise(text)


def zones(title: Column, summary: Column, body: Column) -> Column:
    """title, summary, lead (500), body, tail (the last 400 of more than 900)."""
    return zones_of(title, summary, trimmed(F.coalesce(body, F.lit(""))))


def zones_of(title: Column, summary: Column, body: Column) -> Column:
    """Zones of a body that is trimmed already."""
    n = F.length(body)
    long = n > 900
    return F.struct(
        F.coalesce(title, F.lit("")).alias("title"),
        F.coalesce(summary, F.lit("")).alias("summary"),
        F.substring(body, 1, 500).alias("lead"),
        F.when(long, F.substring(body, F.lit(501), n - 900)).otherwise(F.substring(body, F.lit(501), F.lit(2147483647))).alias("body"),
        F.when(long, F.right(body, F.lit(400))).otherwise("").alias("tail"),
    )


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}.-]*"), F.lit(0))
