"""Text, date, number and array functions over the fixture tables (T, D, N, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..context import AS_OF, DEFAULT
from ..functions import dates, numbers, text
from .registry import query

_LEX = DEFAULT.lexicon
_T = F.col


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _seconds(c: str) -> str:
    return f"CAST(epoch({c}) AS BIGINT)"


FORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[‐‑‒–—―]', '-', 'g'), '[-_/]+', ' ', 'g'), '\s+', ' ', 'g'))"
CVES = r"list_transform(regexp_extract_all({0}, '(?i)\bCVE-[0-9]{{4}}-[0-9]{{4,}}\b'), lambda x: upper(x))"


@query("t_01_normal_url", r"""SELECT page_id, concat(lower(regexp_extract(u, '^([^:]+)://', 1)), '://', lower(regexp_extract(u, '^[^:]+://([^/?]*)', 1)),
  CASE WHEN regexp_replace(regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1), '/+$', '') END,
  CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END) AS url
  FROM (SELECT page_id, u, list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains(""" + _list(text.TRACKING) + r""", lower(split_part(x, '=', 1))) AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_'))) AS k
  FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))""")
def _(t):
    return t.pages.select("page_id", text.normal_url(_T("url")).alias("url"))


@query("t_02_normal_title", r"SELECT id, regexp_replace(translate(lower(trim(title, chr(32) || chr(9) || chr(10) || chr(13))), '“”‘’', '\"\"''''' ), '\s+', ' ', 'g') AS title FROM v_articles".replace('\\"', '"'))
def _(t):
    return t.articles.select("id", text.normal_title(_T("title")).alias("title"))


@query("t_03_hashes", "SELECT id, sha256(trim(clean_text, chr(32) || chr(9) || chr(10) || chr(13))) AS content_hash, concat('cf-', substring(sha1(title), 1, 8)) AS sample_id FROM v_articles")
def _(t):
    return t.articles.select("id", F.sha2(text.trimmed(_T("clean_text")), 256).alias("content_hash"), F.concat(F.lit("cf-"), F.substring(F.sha1("title"), 1, 8)).alias("sample_id"))


@query("t_04_keyword_form", f"SELECT id, {FORM.format('title')} AS form FROM v_articles")
def _(t):
    return t.articles.select("id", text.keyword_form(_T("title")).alias("form"))


@query("t_05_phrase", "SELECT id, regexp_matches(title, '(?i)(^|[^a-z0-9])acme gateway([^a-z0-9]|$)') AS hit FROM v_articles")
def _(t):
    return t.articles.select("id", text.has_phrase(_T("title"), "Acme Gateway").alias("hit"))


@query("t_06_phrase_count", "SELECT id, CAST(len(regexp_extract_all(clean_text, '(?i)(^|[^a-z0-9])the([^a-z0-9]|$)')) AS BIGINT) AS n FROM v_articles")
def _(t):
    return t.articles.select("id", text.count_phrase(_T("clean_text"), F.lit("the")).cast("long").alias("n"))


@query("t_07_cves", "SELECT id, coalesce(array_to_string(" + CVES.format("title") + ", ','), '') AS cves FROM v_articles")
def _(t):
    return t.articles.select("id", F.array_join(text.cves(_T("title")), ",").alias("cves"))


@query("t_08_indicators", r"""SELECT id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(clean_text, '\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b'))), ','), '') AS ips,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(clean_text, '(?i)\b(?:[a-f0-9]{64}|[a-f0-9]{40}|[a-f0-9]{32})\b'), lambda x: lower(x)))), ','), '') AS hashes FROM v_articles""")
def _(t):
    show = lambda a: F.array_join(F.array_sort(a), ",")
    return t.articles.select("id", show(text.matches(_T("clean_text"), text.IP)).alias("ips"), show(text.matches(_T("clean_text"), text.DIGEST, "lower")).alias("hashes"))


@query("t_08_domains", r"""SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(clean_text, '(?i)(?:^|[^a-z0-9_])((?:[a-z0-9-]+\.)+[a-z]{2,})\b', 1), lambda x: lower(x)))), ','), '') AS domains FROM v_articles""")
def _(t):
    return t.articles.select("id", F.array_join(F.array_sort(text.matches(_T("clean_text"), text.DOMAIN, "lower")), ",").alias("domains"))


@query("t_09_flat_keywords", f"SELECT id, coalesce(array_to_string(list_filter({_list(_LEX.flat)}, lambda w: contains(lower(title), w)), ','), '') AS words FROM v_articles")
def _(t):
    return t.articles.select("id", F.array_join(text.substrings(_T("title"), _LEX.flat), ",").alias("words"))


def _found(phrases) -> str:
    forms = [text._phrase(p) for p in phrases]
    return f"CAST(len(list_filter({_list(forms)}, lambda k: regexp_matches(form, '(^|[^a-z0-9])' || k || '([^a-z0-9]|$)'))) AS BIGINT)"


@query("t_10_keyword_groups", "SELECT id, " + ", ".join(f"{_found(getattr(_LEX, g))} AS {g}" for g in ("exploitation", "incident", "medium", "low", "negative")) + f" FROM (SELECT id, {FORM.format('title')} AS form FROM v_articles)")
def _(t):
    form = text.keyword_form(_T("title"))
    return t.articles.select("id", *(F.size(text.keywords(form, getattr(_LEX, g))).cast("long").alias(g) for g in ("exploitation", "incident", "medium", "low", "negative")))


@query("t_12_zones", """SELECT id, length(substring(b, 1, 500)) AS lead, length(CASE WHEN length(b) > 900 THEN substring(b, 501, length(b) - 900) ELSE substring(b, 501) END) AS body, length(CASE WHEN length(b) > 900 THEN right(b, 400) ELSE '' END) AS tail
  FROM (SELECT id, trim(clean_text, chr(32) || chr(9) || chr(10) || chr(13)) AS b FROM v_articles)""")
def _(t):
    z = t.articles.select("id", text.zones(_T("title"), _T("rss_summary"), _T("clean_text")).alias("z"))
    return z.select("id", *(F.length(f"z.{n}").cast("long").alias(n) for n in ("lead", "body", "tail")))


_HTML = r"html"
for _tag in ("script", "style", "nav", "footer"):
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_tag}.*?</{_tag}>', ' ', 'g')"
_HTML = rf"regexp_replace({_HTML}, '<[^>]+>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    _HTML = rf"regexp_replace({_HTML}, '(?i){_a}', '{_b}', 'g')"


@query("t_13_html_text", rf"SELECT page_id, trim(regexp_replace({_HTML}, '\s+', ' ', 'g')) AS text FROM pages")
def _(t):
    return t.pages.select("page_id", text.html_text(_T("html")).alias("text"))


@query("t_14_furniture_lines", r"""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: NOT (length(trim(x)) < 25 AND len(string_split(trim(x), ' ')) < 4 AND NOT regexp_matches(trim(x), '[.!?:]$')))) AS BIGINT) AS kept FROM documents""")
def _(t):
    line = lambda x: F.trim(x)
    kept = F.filter(F.split("text", "\n"), lambda x: ~((F.length(line(x)) < 25) & (F.size(F.split(line(x), " ")) < 4) & ~F.rlike(line(x), F.lit("[.!?:]$"))))
    return t.documents.select("doc_id", F.size(kept).cast("long").alias("kept"))


@query("t_16_excerpt", r"""SELECT id, CASE WHEN length(b) > 700 THEN rtrim(substring(b, 1, 700)) || '…' ELSE b END AS excerpt FROM (SELECT id, trim(clean_text, chr(32) || chr(9) || chr(10) || chr(13)) AS b FROM v_articles)""")
def _(t):
    return t.articles.select("id", text.excerpt(_T("clean_text"), 700).alias("excerpt"))


@query("t_17_feed_fields", r"SELECT id, trim(regexp_replace(rss_summary, '\s+', ' ', 'g')) AS summary, CAST(epoch(published_at) AS BIGINT) AS published FROM v_articles")
def _(t):
    return t.articles.select("id", text.collapsed(_T("rss_summary")).alias("summary"), F.unix_seconds("published_at").alias("published"))


@query("t_18_slug", "SELECT vendor, concat('vp_', regexp_replace(lower(concat(vendor, ' ', product)), '[^a-z0-9]+', '_', 'g')) AS slug FROM v_inventory")
def _(t):
    return t.inventory.select("vendor", F.concat(F.lit("vp_"), F.regexp_replace(F.lower(F.concat_ws(" ", "vendor", "product")), "[^a-z0-9]+", "_")).alias("slug"))


@query("t_21_embedding_text", "SELECT id, sha256(substring(array_to_string(list_filter([title, rss_summary, clean_text], lambda x: x <> ''), chr(10)), 1, 12000)) AS digest FROM v_articles")
def _(t):
    return t.articles.select("id", F.sha2(F.substring(text.joined(_T("title"), _T("rss_summary"), _T("clean_text")), 1, 12000), 256).alias("digest"))


TIER = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(source_name), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in _LEX.tiers) + " ELSE 'unknown' END"


@query("t_22_source_tier", f"SELECT id, {TIER} AS tier FROM v_articles")
def _(t):
    return t.articles.select("id", text.tier(_T("source_name"), _LEX.tiers).alias("tier"))


@query("t_23_event_type", "SELECT id, CASE WHEN regexp_matches(title, '(?i)ransomware') THEN 'ransomware' WHEN regexp_matches(title, '(?i)zero-day|exploit') THEN 'exploitation' WHEN regexp_matches(title, '(?i)vulnerab|patch') THEN 'vulnerability' WHEN regexp_matches(title, '(?i)phishing') THEN 'phishing' ELSE 'other' END AS event_type FROM v_articles")
def _(t):
    ladder = F.when(_T("title").rlike("(?i)ransomware"), "ransomware").when(_T("title").rlike("(?i)zero-day|exploit"), "exploitation").when(_T("title").rlike("(?i)vulnerab|patch"), "vulnerability").when(_T("title").rlike("(?i)phishing"), "phishing")
    return t.articles.select("id", ladder.otherwise("other").alias("event_type"))


_NOW = f"TIMESTAMP '{AS_OF}'"


@query("d_01_recent_old", f"SELECT id, coalesce(epoch({_NOW}) - epoch(published_at) <= 86400, false) AS is_recent, coalesce(epoch({_NOW}) - epoch(published_at) > 1209600, false) AS is_old FROM v_articles")
def _(t):
    return t.articles.select("id", dates.recent(_T("published_at"), AS_OF).alias("is_recent"), dates.old(_T("published_at"), AS_OF).alias("is_old"))


@query("d_02_local_day", "SELECT id, coalesce(strftime(published_at + INTERVAL 8 HOUR, '%Y-%m-%d'), '') AS day FROM v_articles")
def _(t):
    return t.articles.select("id", dates.day_in(_T("published_at")).alias("day"))


@query("d_03_age_hours", f"SELECT id, (epoch({_NOW}) - epoch(published_at)) / 3600.0 AS hours FROM v_articles")
def _(t):
    return t.articles.select("id", dates.hours(dates.moment(AS_OF), _T("published_at")).alias("hours"))


@query("d_06_effective_time", "SELECT id, CAST(epoch(coalesce(published_at, fetched_at)) AS BIGINT) AS at FROM v_articles")
def _(t):
    return t.articles.select("id", F.unix_seconds(F.coalesce("published_at", "fetched_at")).alias("at"))


@query("n_01_round", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS r2, floor(l_tax * l_discount * 1000 + 0.5) / 1000 AS r3 FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.rounded(_T("l_extendedprice") * _T("l_discount")).alias("r2"), numbers.rounded(_T("l_tax") * _T("l_discount"), 3).alias("r3"))


@query("n_02_clamp", "SELECT event_id, CASE WHEN value < 0 THEN 0.0 WHEN value > 100 THEN 100.0 ELSE value END AS v FROM events")
def _(t):
    return t.events.select("event_id", F.when(_T("value").isNotNull(), F.least(F.greatest(_T("value"), F.lit(0.0)), F.lit(100.0))).alias("v"))


@query("n_03_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    e = t.embeddings
    n = e.select((_T("vec_id") - 1).alias("a"), _T("vec_id").alias("b"), _T("embedding").alias("v"))
    return e.join(n, e.vec_id == n.a).select("a", "b", F.round(numbers.cosine_distance(_T("embedding"), _T("v")), 4).alias("distance"))


@query("n_04_truncated", "SELECT vec_id, round(list_extract(CAST(embedding AS DOUBLE[]), 1) / sqrt(list_sum(list_transform(list_slice(CAST(embedding AS DOUBLE[]), 1, 16), lambda x: x * x))), 5) AS first FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(numbers.truncated(_T("embedding"), 16)[0], 5).alias("first"))


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}.-]*')"


@query("n_05_word_overlap", f"""WITH r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents) GROUP BY ALL),
  c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS.format('substring(text, 1, 800)')}) AS w FROM documents) GROUP BY ALL)
  SELECT r.doc_id, CAST(sum(least(r.n, coalesce(c.n, 0))) AS DOUBLE) / sum(r.n) AS recall FROM r LEFT JOIN c ON c.doc_id = r.doc_id AND c.w = r.w GROUP BY r.doc_id""")
def _(t):
    count = lambda c: t.documents.select("doc_id", F.explode(text.words(c)).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    r, c = count(_T("text")), count(F.substring("text", 1, 800)).withColumnRenamed("n", "m")
    both = r.join(c, ["doc_id", "w"], "left").groupBy("doc_id").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("hit"), F.sum("n").alias("all"))
    return both.select("doc_id", (_T("hit") / _T("all")).alias("recall"))


@query("n_06_quality", "SELECT doc_id, round(least(1.0, n / 1000.0) * greatest(0.0, 1 - (hits / greatest(1.0, n / 1000.0)) / 5.0), 9) AS quality FROM (SELECT doc_id, length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS n, len(regexp_extract_all(text, '(?i)(" + "|".join(text.FURNITURE) + ")')) AS hits FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.round(text.quality(_T("text")), 9).alias("quality"))


@query("n_09_risk_score", "SELECT id, least(100, CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 30 WHEN 'medium' THEN 20 ELSE 10 END + CASE urgency WHEN 'P1' THEN 30 WHEN 'P2' THEN 20 ELSE 5 END + CASE WHEN vendor IS NOT NULL THEN 20 ELSE 0 END) AS risk FROM v_cyber_events")
def _(t):
    s = F.when(_T("severity") == "critical", 40).when(_T("severity") == "high", 30).when(_T("severity") == "medium", 20).otherwise(10)
    u = F.when(_T("urgency") == "P1", 30).when(_T("urgency") == "P2", 20).otherwise(5)
    return t.cyber_events.select("id", F.least(F.lit(100), s + u + F.when(_T("vendor").isNotNull(), 20).otherwise(0)).alias("risk"))


@query("r_03_json_path", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.page").alias("page"))


@query("r_07_number_parse", "SELECT page_id, try_cast(regexp_extract(url, '([0-9]+)', 1) AS DOUBLE) AS n FROM pages")
def _(t):
    return t.pages.select("page_id", F.expr("try_cast(regexp_extract(url, '([0-9]+)', 1) as double)").alias("n"))


@query("r_08_listed", "SELECT c.id, k.case_id IS NOT NULL AS listed FROM v_cases c LEFT JOIN (SELECT DISTINCT case_id FROM v_observations WHERE source = 'kev' AND status = 'ok') k ON k.case_id = c.id")
def _(t):
    k = t.observations.where("source = 'kev' and status = 'ok'").select(_T("case_id").alias("id"), F.lit(True).alias("hit")).distinct()
    return t.cases.join(k, "id", "left").select("id", _T("hit").isNotNull().alias("listed"))


@query("r_12_soft_cut", "SELECT id, length(substring(clean_text, 1, 800)) AS short, length(substring(clean_text, 1, 1500)) AS long FROM v_articles")
def _(t):
    return t.articles.select("id", F.length(F.substring("clean_text", 1, 800)).cast("long").alias("short"), F.length(F.substring("clean_text", 1, 1500)).cast("long").alias("long"))


@query("t_15_main_text")
def _(t):
    from ..functions.pages import main_text

    return t.pages.select("page_id", main_text(_T("html")).alias("text"))


@query("s_08_page_recall")
def _(t):
    """Word recall of the main text against the whole page's text."""
    from ..functions.pages import main_text

    rows = t.pages.select("page_id", text.words(main_text(_T("html"))).alias("m"), text.words(text.html_text(_T("html"))).alias("w"))
    return rows.select("page_id", F.size(F.array_intersect("m", "w")).alias("shared"), F.size(F.array_distinct("w")).alias("all"))


@query("n_07_f1", "SELECT doc_id, CASE WHEN a + b = 0 THEN 1.0 ELSE 2.0 * least(a, b) / (a + b) END AS f1 FROM (SELECT doc_id, quality AS a, toxic AS b FROM labels)")
def _(t):
    a, b = _T("quality"), _T("toxic")
    return t.labels.select("doc_id", F.when(a + b == 0, 1.0).otherwise(2.0 * F.least(a, b) / (a + b)).alias("f1"))


@query("n_08_higher_rank", "SELECT id, CASE WHEN severity IN ('critical', 'high', 'medium') THEN severity ELSE 'medium' END AS severity FROM v_cyber_events")
def _(t):
    from ..operators.events import SEVERITY, highest

    return t.cyber_events.select("id", highest(_T("severity"), F.lit("medium"), SEVERITY, "medium").alias("severity"))


@query("w_07_first_seen", "SELECT id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS words FROM (SELECT id, string_split(lower(title), ' ') AS w FROM v_articles)")
def _(t):
    return t.articles.select("id", F.array_join(F.array_distinct(F.split(F.lower("title"), " ")), " ").alias("words"))


@query("w_11_hash_order", "SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def _(t):
    return t.documents.orderBy(F.sha2(_T("doc_id").cast("string"), 256), "doc_id").limit(25).select("doc_id")


@query("d_05_inverted_recency", "SELECT id, 9999999999999 - CAST(epoch_ms(published_at) AS BIGINT) AS recency FROM v_articles")
def _(t):
    return t.articles.select("id", (F.lit(9999999999999) - F.unix_millis("published_at")).alias("recency"))


@query("r_04_nested_choice", "SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'view' THEN value / 2 END) AS base FROM events")
def _(t):
    v = t.events.select("event_id", F.struct(F.struct(F.when(_T("event_type") == "click", _T("value")).alias("base")).alias("v3"), F.struct(F.when(_T("event_type") == "view", _T("value") / 2).alias("base")).alias("v2")).alias("v"))
    return v.select("event_id", F.coalesce("v.v3.base", "v.v2.base").alias("base"))


@query("r_05_canonical_json", "SELECT event_id, CAST(json(props) AS VARCHAR) AS canonical FROM events")
def _(t):
    return t.events.select("event_id", F.to_json(F.try_parse_json("props")).alias("canonical"))


@query("r_09_closed_list", "SELECT a.id, coalesce(i.vendor, '') AS vendor FROM v_articles a LEFT JOIN v_inventory i ON lower(i.vendor) = lower(split_part(a.title, ' ', 1))")
def _(t):
    known = t.inventory.select(F.lower("vendor").alias("k"), "vendor")
    return t.articles.withColumn("k", F.lower(F.element_at(F.split("title", " "), 1))).join(known, "k", "left").select("id", F.coalesce("vendor", F.lit("")).alias("vendor"))


@query("r_10_reply", "SELECT doc_id, quality FROM labels")
def _(t):
    from ..functions.seams import parsed_reply

    reply = F.concat(F.lit("<think>so</think>```json\n"), F.to_json(F.struct("quality")), F.lit("\n```"))
    return t.labels.select("doc_id", parsed_reply(reply, "quality int")["quality"].alias("quality"))


@query("r_11_chunks", "SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 10) AS BIGINT) AS chunk FROM v_cases")
def _(t):
    from ..operators.readmodels import numbered

    return numbered(t.cases, "id").select("id", F.floor(_T("place") / 10).alias("chunk"))
