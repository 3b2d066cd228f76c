"""URL filtering by rules and by empirical-Bayes host reputation, with built-in functions only.

Outcomes (good or not) of labelled pages are counted by host. A host's rate is
shrunk towards its registered domain, the domain's towards its suffix, the suffix's
towards all: each level has a beta prior with the parent's posterior mean, whose
strength comes from the variance between the children (one-way analysis of
variance). A host passes if the lower bound of its posterior, `z` standard
deviations under the mean, reaches `least`. Hosts without outcomes have their
domain's prior alone.

Rules come first: a rule names a host and the start of a path, fits that host and
its subdomains, and the longest fitting one decides.

Host counts are joined to the pages in two ways: hosts with at least a thousandth of
all pages are a thousand at most and are broadcast; the others are shuffled, each
with less than a thousandth of the rows.

Defined results: a null url, or one without ://, has an empty host and an empty path
and is judged as that host. Null outcomes are none; repeated pages are judged row by
row. The registered domain is the last two labels, or three where the last is a
country's (two letters) behind one of `suffixes`; the suffix is what stands behind its
first label. Ports don't count, and an address of numbers is its own domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels that make a suffix of two labels before a country's.
SUFFIXES = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
Z, LEAST = 1.645, 0.6
HOT = 1000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(action: str, text: str) -> Rule:
    host, slash, rest = text.partition("/")
    return Rule(action, host.lower(), slash + rest)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UP, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _matched(rules: list[Rule], host: str, path: str) -> Column:
    """The longest fitting rule of each row as (rule, action), or null."""
    if not rules:
        return F.lit(None).cast("struct<size int, rule string, action string>")
    of: dict[str, list[Rule]] = {}
    for r in rules:
        of.setdefault(r.host, []).append(r)
    known = F.create_map(*(x for h, own in of.items() for x in (F.lit(h), F.array(*(F.struct(F.lit(r.path).alias("path"), F.lit(r.text).alias("rule"), F.lit(r.action).alias("action")) for r in own)))))
    # Of a host's endings only those with as many labels as a rule's host has.
    ends = F.array(*(F.substring_index(host, ".", -k) for k in sorted({h.count(".") + 1 for h in of})))
    fits = F.filter(F.flatten(F.filter(F.transform(ends, lambda e: F.element_at(known, e)), lambda x: x.isNotNull())), lambda x: F.startswith(F.col(path), x["path"]))
    return F.array_max(F.transform(fits, lambda x: F.struct(F.length(x["rule"]).alias("size"), x["rule"].alias("rule"), x["action"].alias("action"))))


def _levels(host: str, suffixes: tuple[str, ...]) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its port; an address of numbers is its own domain and suffix."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.split(name, "[.]")
    last = lambda n: F.when(F.size(labels) > n, F.array_join(F.slice(labels, -n, n), ".")).otherwise(name)
    address = name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | F.startswith(name, F.lit("["))
    wide = name.rlike(rf"(^|\.)({'|'.join(suffixes)})\.[a-z]{{2}}$") if suffixes else F.lit(False)
    return F.when(address, name).when(wide, last(3)).otherwise(last(2)), F.when(address, name).when(wide, last(2)).otherwise(last(1))


def _strength(children: DataFrame) -> float:
    """Prior strength of (good, n) counts: the inverse intraclass correlation, from 1 to 10,000."""
    s = children.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"), F.sum(F.col("good") * F.col("good").cast("double") / F.col("n")).alias("gp")).first()
    if not s.k or s.k < 2 or s.n <= s.k:
        return 10.0
    between = (s.gp - s.g * s.g / s.n) / (s.k - 1)
    within = (s.g - s.gp) / (s.n - s.k)
    size = (s.n - s.nn / s.n) / (s.k - 1)
    rho = (between - within) / (between + (size - 1) * within) if between + (size - 1) * within > 0 else 0.0
    return min(max((1 - rho) / rho, 1.0), 10_000.0) if rho > 0 else 10_000.0


def reputation(pages: DataFrame, *, good: str, suffixes: tuple[str, ...] = SUFFIXES, z: float = Z) -> DataFrame:
    """By host: pages, n and good outcomes, the posterior's mean and lower bound. `pages` has host and the outcome (boolean, null if none)."""
    seen = F.col(good).isNotNull()
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(seen).alias("n"), F.count_if(seen & F.col(good)).alias("good"))
    domain, suffix = _levels("host", suffixes)
    # Counted once; the levels above and their strengths are read from this table.
    hosts = shared.written(hosts.select("*", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    mean = (total.good + 1) / (total.n + 2)
    a, b, c = _strength(tops), _strength(domains), _strength(hosts)
    tops = tops.select("suffix", ((F.col("good") + a * mean) / (F.col("n") + a)).alias("top_mean"))
    domains = domains.join(tops, "suffix").select("domain", ((F.col("good") + b * F.col("top_mean")) / (F.col("n") + b)).alias("domain_mean"))
    yes, no = F.col("good") + c * F.col("domain_mean"), F.col("n") - F.col("good") + c * (1 - F.col("domain_mean"))
    both = yes + no
    spread = F.sqrt(yes * no / (both * both * (both + 1)))
    return hosts.join(domains, "domain").select("host", "pages", "n", "good", (yes / both).alias("mean"), (yes / both - z * spread).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", good_col: str = "good", suffixes: tuple[str, ...] = SUFFIXES, z: float = Z, least: float = LEAST) -> DataFrame:
    """Per page: id, host, path, rule, bound and verdict (allow or block). `outcomes` has (id, boolean) of labelled pages, each id once."""
    base = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = base.select("id", "host").join(outcomes.select(F.col(id_col).alias("id"), F.col(good_col).alias("good")), "id", "left")
    stats = reputation(known, good="good", suffixes=suffixes, z=z)
    total = base.count()
    hot = F.broadcast(stats.where(F.col("pages") * HOT >= total).select("host", "bound"))
    cold = stats.where(F.col("pages") * HOT < total).select("host", "bound")
    some = base.join(hot, "host")
    rest = base.join(hot.select("host"), "host", "left_anti").join(cold, "host")
    found = some.unionByName(rest).withColumn("m", _matched(rules, "host", "path"))
    verdict = F.coalesce("m.action", F.when(F.col("bound") >= least, "allow").otherwise("block"))
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("m.rule").alias("rule"), "bound", verdict.alias("verdict"))
