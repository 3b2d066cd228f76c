"""Filter, entities, deduplication, events, alerts, case logs, vectors and watchdogs (K, W, Q, V)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..context import AS_OF, DEFAULT
from ..fixtures import FIXTURE
from ..functions import dates, numbers
from ..operators import entities, events, filtering, latest, monitoring, vectors
from .registry import query
from .text import CVES, FORM, TIER, _found, _list

_C = F.col
_LEX = DEFAULT.lexicon
_NOW = f"TIMESTAMP '{AS_OF}'"


def _named(*words: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(txt, '(?i)(^|[^a-z0-9]){w}([^a-z0-9]|$)')" for w in words) + ")"


_ITEMS = [(p, _named(p.product, *p.aliases), _named(p.vendor, p.product, *p.aliases)) for p in DEFAULT.inventory]
_SIGNALS = f"""sig AS (SELECT id, source_name, n_product, n_vendor, tier, recent, old, noisy, len({CVES.format('txt')}) AS cves,
    {", ".join(f"{_found(getattr(_LEX, g))} AS {g}" for g in ("exploitation", "incident", "medium", "low", "negative"))},
    regexp_matches(form, '(^|[^a-z0-9])identity([^a-z0-9]|$)') AND regexp_matches(form, '(^|[^a-z0-9])attack([^a-z0-9]|$)') AS pair
  FROM (SELECT id, source_name, txt, {FORM.format('txt')} AS form, {TIER} AS tier,
    {" + ".join(f"CAST({p} AS INT)" for _, p, _ in _ITEMS)} AS n_product, {" + ".join(f"CAST({v} AS INT)" for _, _, v in _ITEMS)} AS n_vendor,
    {next(p for i, p, _ in _ITEMS if i.noisy)} OR (NOT ({" OR ".join(p for _, p, _ in _ITEMS)}) AND {next(v for i, _, v in _ITEMS if i.noisy)}) AS noisy,
    coalesce(epoch({_NOW}) - epoch(published_at) <= 86400, false) AS recent, coalesce(epoch({_NOW}) - epoch(published_at) > 1209600, false) AS old
  FROM (SELECT *, array_to_string(list_filter([title, rss_summary], lambda x: x <> ''), chr(10)) AS txt FROM v_articles))),
dec AS (SELECT *, CASE WHEN NOT vendor AND hatch THEN least(points, 49) ELSE points END AS score,
    CASE WHEN NOT vendor THEN CASE WHEN hatch THEN 'MAYBE_KEEP' ELSE 'DROP' END
      WHEN negative > 0 AND NOT (cves > 0 OR critical) THEN 'DROP' WHEN NOT cyber THEN 'DROP' WHEN points >= 50 THEN 'KEEP' ELSE 'MAYBE_KEEP' END AS decision
  FROM (SELECT *, exploitation + incident > 0 AS critical, n_vendor > 0 AS vendor, cves > 0 OR exploitation > 0 OR tier IN ('official_vendor', 'government_cert') AS hatch,
    cves > 0 OR exploitation + incident > 0 OR tier IN ('official_vendor', 'government_cert') OR (medium > 0 AND (NOT noisy OR tier IN ('security_media', 'researcher_blog'))) AS cyber,
    greatest(0, least(100, CASE WHEN cves > 0 THEN 35 ELSE 0 END + CASE WHEN n_product > 0 THEN 25 WHEN n_vendor > 0 THEN 15 ELSE 0 END
      + CASE WHEN exploitation > 0 THEN 35 WHEN incident > 0 THEN 25 WHEN medium > 0 THEN 20 WHEN pair THEN 10 WHEN low > 0 THEN 5 ELSE 0 END
      + CASE WHEN tier IN ('official_vendor', 'government_cert') THEN 25 WHEN tier IN ('security_media', 'researcher_blog') THEN 10 ELSE 0 END
      + CASE WHEN recent THEN 10 ELSE 0 END - CASE WHEN negative > 0 THEN 20 ELSE 0 END - CASE WHEN old THEN 20 ELSE 0 END)) AS points FROM sig))"""


@query("k_01_filter_score", f"WITH {_SIGNALS} SELECT id, CAST(score AS BIGINT) AS score FROM dec")
def _(t):
    return filtering.decide(t.articles).select("id", _C("score").cast("long").alias("score"))


@query("k_02_filter_decisions", f"WITH {_SIGNALS} SELECT source_name, decision, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM dec GROUP BY ALL")
def _(t):
    return filtering.decide(t.articles).groupBy("source_name", "decision").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("total"))


@query("k_03_cyber_context", f"WITH {_SIGNALS} SELECT id, noisy, cyber AND NOT (negative > 0 AND NOT (cves > 0 OR critical)) AND vendor AS passed FROM dec")
def _(t):
    d = filtering.decide(t.articles)
    return d.select("id", _C("s.noisy").alias("noisy"), ((F.size("s.vendors") > 0) & ~F.array_contains("blocking_reasons", "cheap_filter_l2_no_cyber_context") & ~F.array_contains("blocking_reasons", "cheap_filter_l2_negative_dominance")).alias("passed"))


@query("k_04_low_pair", f"WITH {_SIGNALS} SELECT id, pair FROM dec")
def _(t):
    s = filtering.signals(t.articles)
    return s.select("id", (F.array_contains("s.low", "identity") & F.array_contains("s.low", "attack")).alias("pair"))


@query("k_05_reasons", f"""WITH {_SIGNALS} SELECT id, array_to_string(list_filter([CASE WHEN cves > 0 THEN 'cve_found' END, CASE WHEN n_product > 0 THEN 'monitored_product_found' END, CASE WHEN n_vendor > 0 THEN 'monitored_vendor_found' END,
  CASE WHEN critical THEN 'critical_cyber_keyword_found' END, CASE WHEN medium > 0 THEN 'medium_cyber_keyword_found' END, CASE WHEN low > 0 THEN 'low_cyber_keyword_found' END,
  CASE WHEN tier IN ('official_vendor', 'government_cert', 'security_media', 'researcher_blog') THEN tier || '_source' END, CASE WHEN recent THEN 'recent_article' END,
  CASE WHEN NOT vendor AND hatch THEN 'cheap_filter_l1_severe_signal_escape_hatch' END,
  CASE WHEN ok AND n_product > 0 THEN 'product_with_cyber_context' END, CASE WHEN ok AND n_vendor > 0 THEN 'vendor_with_cyber_context' END,
  CASE WHEN ok AND tier IN ('official_vendor', 'government_cert', 'security_media', 'researcher_blog') THEN 'trusted_source_with_security_context' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM (SELECT *, vendor AND cyber AND NOT (negative > 0 AND NOT (cves > 0 OR critical)) AS ok FROM dec)""")
def _(t):
    return filtering.decide(t.articles).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("k_06_routing", f"WITH {_SIGNALS} SELECT CASE decision WHEN 'KEEP' THEN 'EXTRACTION_PENDING' WHEN 'MAYBE_KEEP' THEN 'EXTRACTION_PENDING_LOW_PRIORITY' ELSE 'IGNORED' END AS processing_status, count(*) AS n FROM dec GROUP BY ALL")
def _(t):
    return filtering.decide(t.articles).groupBy("processing_status").agg(F.count("*").alias("n"))


@query("k_06_routing_advisory", f"WITH {_SIGNALS} SELECT CASE decision WHEN 'KEEP' THEN 'EXTRACTION_PENDING' ELSE 'EXTRACTION_PENDING_LOW_PRIORITY' END AS processing_status, count(*) AS n FROM dec GROUP BY ALL")
def _(t):
    return filtering.decide(t.articles, mode="advisory").groupBy("processing_status").agg(F.count("*").alias("n"))


@query("j_13_inventory_match", f"WITH {_SIGNALS} SELECT id, n_vendor AS vendors, n_product AS products FROM sig")
def _(t):
    return filtering.signals(t.articles).select("id", F.size("s.vendors").alias("vendors"), F.size("s.products").alias("products"))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ZONE_VALUES = (("title", 1.0), ("summary", 0.9), ("lead", 0.8), ("body", 0.6), ("tail", 0.3))
_KINDS = {
    "vendor": "[" + ", ".join(f"CASE WHEN {v} THEN '{p.vendor}' END" for p, _, v in _ITEMS) + "]",
    "product": "[" + ", ".join(f"CASE WHEN {i} THEN '{p.product}' END" for p, i, _ in _ITEMS) + "]",
    "cve": CVES.format("txt"),
    "ioc_ip": rf"regexp_extract_all(txt, '\b(?:{_OCTET}\.){{3}}{_OCTET}\b')",
    "ioc_domain": r"list_transform(regexp_extract_all(txt, '(?i)(?:^|[^a-z0-9_])((?:[a-z0-9-]+\.)+[a-z]{2,})\b', 1), lambda x: lower(x))",
    "ioc_hash": r"list_transform(regexp_extract_all(txt, '(?i)\b(?:[a-f0-9]{64}|[a-f0-9]{40}|[a-f0-9]{32})\b'), lambda x: lower(x))",
    "attack_type": f"list_filter({_list(_LEX.flat)}, lambda w: contains(lower(txt), w))",
}
#: Entities of articles: zones, what is found in all of them, and the confidence by zones.
_ENT = f"""zo AS (SELECT id, coalesce(title, '') AS z_title, coalesce(rss_summary, '') AS z_summary, substring(b, 1, 500) AS z_lead, CASE WHEN length(b) > 900 THEN substring(b, 501, length(b) - 900) ELSE substring(b, 501) END AS z_body, CASE WHEN length(b) > 900 THEN right(b, 400) ELSE '' END AS z_tail
    FROM (SELECT *, trim(coalesce(clean_text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS b FROM v_articles)),
  fo AS (SELECT *, {", ".join(f"list_distinct(list_filter({v}, lambda x: x IS NOT NULL)) AS k_{k}" for k, v in _KINDS.items())} FROM (SELECT *, concat_ws(chr(10), z_title, z_summary, z_lead, z_body, z_tail) AS txt FROM zo)),
  va AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT id, '{k}' AS entity_type, unnest(k_{k}) AS entity_value FROM fo" for k in _KINDS)})),
  oc AS (SELECT va.*, len(k_cve) > 0 OR len(k_attack_type) > 0 AS corroborated, {", ".join(f"len(regexp_extract_all(z_{z}, '(?i)(^|[^a-z0-9])' || regexp_escape(entity_value) || '([^a-z0-9]|$)')) AS t_{z}" for z, _ in _ZONE_VALUES)} FROM va JOIN fo ON fo.id = va.id),
  lo AS (SELECT *, greatest({", ".join(f"CASE WHEN t_{z} > 0 THEN {w} ELSE 0 END" for z, w in _ZONE_VALUES)}) + CASE WHEN t_title + t_summary + t_lead + t_body + t_tail >= 2 THEN 0.1 ELSE 0 END AS loose FROM oc),
  ent AS (SELECT DISTINCT id AS article_id, entity_type, entity_value, CASE WHEN entity_type IN ('vendor', 'product') THEN 'unknown' END AS role,
    CAST(floor(CASE WHEN entity_type = 'cve' OR starts_with(entity_type, 'ioc_') THEN CASE WHEN t_tail > 0 AND t_title + t_summary + t_lead + t_body = 0 THEN 0.6 ELSE 0.95 END
      WHEN entity_type IN ('vendor', 'product') AND NOT corroborated THEN least(loose, 0.45) ELSE least(loose, 1.0) END * 100 + 0.5) AS DOUBLE) / 100 AS confidence FROM lo),
  dl AS (SELECT article_id, {", ".join(f"list_sort(coalesce(list(entity_value) FILTER (entity_type = '{k}'), [])) AS {n}" for k, n in (("vendor", "vendors"), ("product", "products"), ("cve", "cves"), ("attack_type", "attacks")))} FROM ent WHERE confidence >= 0.5 GROUP BY 1),
  dr AS (SELECT *, CASE WHEN severe OR len(cves) > 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN severe THEN 'P1' WHEN len(cves) > 0 THEN 'P2' ELSE 'P3' END AS urgency,
    concat(CASE WHEN subject = '' THEN 'Unknown cyber event' ELSE subject END, CASE WHEN len(cves) > 0 THEN ' vulnerability report' ELSE ' cyber report' END) AS title,
    CASE WHEN len(cves) > 0 THEN 'cve:' || array_to_string(list_sort(list_transform(cves, lambda x: lower(x))), '|') WHEN rest = '' THEN 'unknown' ELSE rest END AS grouping_key
    FROM (SELECT *, list_has_any(attacks, ['active exploitation', 'zero-day', 'ransomware', 'breach']) AS severe, coalesce(array_to_string((vendors || products || cves)[1:3], ' / '), '') AS subject,
      concat_ws('::', nullif(array_to_string(list_sort(list_transform(vendors || products, lambda x: lower(x))), '|'), ''), nullif(array_to_string(list_sort(attacks), '|'), '')) AS rest FROM dl))"""


@query("k_08_entities", f"WITH {_ENT} SELECT * FROM ent")
def _(t):
    return entities.extract(t.articles)


@query("k_07_entity_confidence", f"WITH {_ENT} SELECT entity_type, confidence, count(*) AS n FROM ent GROUP BY ALL")
def _(t):
    return entities.extract(t.articles).groupBy("entity_type", "confidence").agg(F.count("*").alias("n"))


@query("k_08_vendor_counts", f"WITH {_ENT} SELECT entity_value, count(*) AS n FROM ent WHERE entity_type = 'vendor' GROUP BY 1")
def _(t):
    return entities.extract(t.articles).where("entity_type = 'vendor'").groupBy("entity_value").agg(F.count("*").alias("n"))


@query("r_01_values_by_type", f"WITH {_ENT} SELECT article_id, entity_type, array_to_string(list_sort(list(entity_value)), ',') AS found FROM ent GROUP BY 1, 2")
def _(t):
    return entities.extract(t.articles).groupBy("article_id", "entity_type").agg(F.array_join(F.sort_array(F.collect_set("entity_value")), ",").alias("found"))


@query("r_02_labels", f"WITH {_ENT} SELECT article_id, entity_type, array_to_string(list_sort(list(concat(entity_value, CASE WHEN role IS NOT NULL THEN ' (' || role || ')' ELSE '' END, ' · ', CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR), '%'))), '; ') AS labels FROM ent GROUP BY 1, 2")
def _(t):
    label = F.concat("entity_value", F.coalesce(F.concat(F.lit(" ("), "role", F.lit(")")), F.lit("")), F.lit(" · "), F.floor(_C("confidence") * 100 + 0.5).cast("string"), F.lit("%"))
    return entities.extract(t.articles).groupBy("article_id", "entity_type").agg(F.array_join(F.sort_array(F.collect_list(label)), "; ").alias("labels"))


@query("k_09_cross_check", "SELECT doc_id, floor(CASE WHEN toxic = 1 THEN 0.8 * 0.4 WHEN quality = 1 THEN least(1.0, 0.8 + 0.2) ELSE 0.8 END * 100 + 0.5) / 100 AS confidence FROM labels")
def _(t):
    role = F.when(_C("toxic") == 1, "unrelated").when(_C("quality") == 1, "affected")
    return t.labels.select("doc_id", entities.cross_checked(F.lit(0.8), role).alias("confidence"))


@query("t_11_mentions", rf"""WITH z AS (SELECT id, 'title' AS zone, title AS txt FROM v_articles UNION ALL SELECT id, 'summary', rss_summary FROM v_articles UNION ALL SELECT id, 'body', clean_text FROM v_articles),
  f AS (SELECT id, zone, txt, unnest(list_distinct({CVES.format('txt')})) AS cve_id FROM z WHERE txt IS NOT NULL), p AS (SELECT *, instr(upper(txt), cve_id) - 1 AS start FROM f),
  q AS (SELECT *, greatest(start - 60, 0) AS b FROM p), r AS (SELECT *, substring(txt, b + 1, start - b + length(cve_id) + 60) AS raw FROM q),
  s AS (SELECT *, CASE WHEN b > 0 THEN regexp_replace(raw, '^\S*\s', '') ELSE raw END AS s1 FROM r)
  SELECT id AS article_id, zone, cve_id, CAST(start AS BIGINT) AS start, trim(CASE WHEN b + length(raw) >= length(txt) THEN s1 ELSE regexp_replace(s1, '\s\S*$', '') END, chr(32) || chr(9) || chr(10) || chr(13)) AS snippet FROM s""")
def _(t):
    return entities.mentions(t.articles)


@query("t_19_grouping_key", f"WITH {_ENT} SELECT article_id, grouping_key FROM dr")
def _(t):
    return entities.drafts(entities.extract(t.articles)).select("article_id", "grouping_key")


@query("t_20_event_drafts", f"WITH {_ENT} SELECT article_id, title, severity, urgency FROM dr")
def _(t):
    return entities.drafts(entities.extract(t.articles)).select("article_id", "title", "severity", "urgency")


_A = "(SELECT id, published_at, fetched_at, trim(coalesce(clean_text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS body, lower(trim(coalesce(title, ''), chr(32) || chr(9) || chr(10) || chr(13))) AS t FROM v_articles)"
#: Survivors of a title by stepping from one to the next: the first article over seven days after it that is no copy.
_LADDER = """a AS (SELECT id, published_at, fetched_at, body, regexp_replace(translate(t, '“”‘’', chr(34) || chr(34) || chr(39) || chr(39)), '\\s+', ' ', 'g') AS t FROM <A>),
  c AS (SELECT *, CASE WHEN body <> '' THEN first_value(id) OVER (PARTITION BY body ORDER BY published_at ASC NULLS <NULLS>, fetched_at, id) END AS c1 FROM a),
  ok AS (SELECT t, {'at': published_at, 'f': fetched_at, 'id': id} AS s FROM c WHERE (c1 IS NULL OR c1 = id) AND t <> '' AND published_at IS NOT NULL),
  chain AS (SELECT t, min(s) AS s FROM ok GROUP BY t UNION ALL SELECT chain.t, min(ok.s) FROM chain JOIN ok ON ok.t = chain.t AND ok.s.at > chain.s.at + INTERVAL 7 DAY GROUP BY chain.t, chain.s),
  ex AS (SELECT c.id, c.published_at, CASE WHEN c1 <> c.id THEN 'content_hash' WHEN x.s IS NOT NULL THEN 'title_hash' ELSE 'unique' END AS rung, CASE WHEN c1 <> c.id THEN c1 ELSE x.s.id END AS duplicate_of
    FROM c LEFT JOIN chain x ON x.t = c.t AND (c1 IS NULL OR c1 = c.id) AND x.s.at <= c.published_at AND c.published_at <= x.s.at + INTERVAL 7 DAY AND x.s.id <> c.id)""".replace("<A>", _A)


def _dedup_sql(undated_last: bool) -> str:
    return f"WITH RECURSIVE {_LADDER.replace('<NULLS>', 'LAST' if undated_last else 'FIRST')} SELECT id, rung, duplicate_of FROM ex"


@query("k_10_dedup_spec", _dedup_sql(True))
def _(t):
    return events.survivors(t.articles).select("id", "rung", "duplicate_of")


@query("k_10_dedup_compat", _dedup_sql(False))
def _(t):
    return events.survivors(t.articles, "compat").select("id", "rung", "duplicate_of")


_DISTANCE = "floor(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * 1000000 + 0.5) / 1000000"
_WITHIN = "epoch({0}) - epoch({1}) < {2} * 86400"
#: A time at which about half of the articles with vectors are of the last 14 days.
_LATER = replace(FIXTURE, as_of="2024-01-20 00:00:00")
_MID = f"TIMESTAMP '{_LATER.as_of}'"


@query("k_10_ladder", f"""WITH RECURSIVE {_LADDER.replace('<NULLS>', 'LAST')},
  q AS (SELECT e.vec_id, e.embedding FROM embeddings e JOIN ex ON ex.id = e.vec_id WHERE e.vec_id % 100 = 0 AND rung = 'unique'),
  b AS (SELECT e.vec_id, e.embedding FROM embeddings e JOIN v_articles ar ON ar.id = e.vec_id WHERE {_WITHIN.format(_MID, 'published_at', 14)}),
  d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, {_DISTANCE} AS distance FROM q JOIN b ON b.vec_id <> q.vec_id),
  n AS (SELECT query_id, array_to_string(list(id ORDER BY rank), ',') AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 5 AND distance <= {FIXTURE.duplicate_distance} GROUP BY 1)
  SELECT ex.id, CASE WHEN n.query_id IS NOT NULL THEN 'semantic_candidate' ELSE rung END AS rung, duplicate_of, coalesce(candidates, '') AS candidates FROM ex LEFT JOIN n ON n.query_id = ex.id WHERE ex.id % 100 = 0""")
def _(t):
    """The whole ladder for the stated query set (ids divisible by 100) against all articles."""
    v = t.embeddings.select(_C("vec_id").alias("id"), "embedding")
    found = events.dedup_ladder(t.articles, v, _C("id") % 100 == 0, _LATER)
    return found.select("id", "rung", "duplicate_of", F.array_join("candidates", ",").alias("candidates"))


@query("k_11_key_grouping", f"WITH {_ENT}, k AS (SELECT article_id, CASE WHEN grouping_key = 'unknown' THEN 'unknown:' || article_id ELSE grouping_key END AS key FROM dr), f AS (SELECT key, min(article_id) AS creator FROM k GROUP BY 1) SELECT article_id, creator, CASE WHEN creator = article_id THEN 'create' ELSE 'attach' END AS kind FROM k JOIN f ON f.key = k.key")
def _(t):
    return events.group_by_key(entities.drafts(entities.extract(t.articles))).select("article_id", "creator", "kind")


#: Events with a grouping key, a status and the time they were last seen; the vector of each is its first article's.
_OPEN = """eo AS (SELECT id, concat('k', CAST(id % 7 AS VARCHAR)) AS grouping_key, CASE WHEN id % 3 = 0 THEN 'closed' ELSE 'open' END AS event_status, first_seen_at AS last_seen_at FROM v_cyber_events),
  em AS (SELECT ea.event_id, ea.article_id, ea.created_at, a.status IN ('EMBEDDED', 'GROUPED', 'CLASSIFIED') AS ready, e.embedding FROM v_event_articles ea JOIN v_articles a ON a.id = ea.article_id JOIN embeddings e ON e.vec_id = ea.article_id),
  ev AS (SELECT event_id, arg_min(article_id, (NOT ready, created_at, article_id)) AS article_id, arg_min(embedding, (NOT ready, created_at, article_id)) AS embedding FROM em GROUP BY 1)"""


def _open_events(t):
    e = t.cyber_events.select("id", F.concat(F.lit("k"), (_C("id") % 7).cast("string")).alias("grouping_key"), F.when(_C("id") % 3 == 0, "closed").otherwise("open").alias("event_status"), _C("first_seen_at").alias("last_seen_at"))
    a = t.articles.select("id", "status").join(t.embeddings.select(_C("vec_id").alias("id"), "embedding"), "id")
    return e, events.event_vectors(t.event_articles, a)


@query("v_04_event_vector", f"WITH {_OPEN} SELECT event_id, article_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM ev")
def _(t):
    return _open_events(t)[1].select("event_id", "article_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("k_11_open_match", f"WITH {_OPEN} SELECT v.vec_id AS article_id, x.id AS key_event FROM (SELECT vec_id, concat('k', CAST(vec_id % 11 AS VARCHAR)) AS k FROM embeddings) v LEFT JOIN (SELECT grouping_key, arg_max(id, (last_seen_at, id)) AS id FROM eo WHERE event_status = 'open' GROUP BY 1) x ON x.grouping_key = v.k")
def _(t):
    d = t.embeddings.select(_C("vec_id").alias("article_id"), F.concat(F.lit("k"), (_C("vec_id") % 11).cast("string")).alias("grouping_key"))
    return events.open_match(d, _open_events(t)[0]).select("article_id", "key_event")


_NEAR = f"""nv AS (SELECT ev.event_id AS vec_id, ev.embedding FROM ev JOIN eo ON eo.id = ev.event_id WHERE {_WITHIN.format(_NOW, 'last_seen_at', 30)}),
  nd AS (SELECT q.vec_id AS query_id, b.vec_id AS id, {_DISTANCE} AS distance FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, nv b),
  ne AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM nd QUALIFY rank <= 3)"""


@query("k_11_grouping_ladder", f"""WITH {_OPEN}, {_NEAR}, q AS (SELECT vec_id, concat('k', CAST(vec_id % 11 AS VARCHAR)) AS k FROM embeddings WHERE vec_id % 100 = 0),
  m AS (SELECT q.vec_id, x.id AS key_event, ne.id AS near_event, distance AS d FROM q LEFT JOIN (SELECT grouping_key, arg_max(id, (last_seen_at, id)) AS id FROM eo WHERE event_status = 'open' GROUP BY 1) x ON x.grouping_key = q.k LEFT JOIN ne ON ne.query_id = q.vec_id AND ne.rank = 1)
  SELECT vec_id, CASE WHEN key_event IS NOT NULL OR d <= {FIXTURE.attach_distance} THEN 'attach' WHEN d <= {FIXTURE.uncertain_distance} THEN 'uncertain' ELSE 'create' END AS kind,
    CASE WHEN key_event IS NOT NULL THEN key_event WHEN d <= {FIXTURE.uncertain_distance} THEN near_event END AS event, CASE WHEN key_event IS NOT NULL THEN 0.9 WHEN d <= {FIXTURE.attach_distance} THEN 0.75 END AS confidence FROM m""")
def _(t):
    """Key match on an open event, else the nearest of the last 30 days, for the stated query set (ids divisible by 100)."""
    e, vector = _open_events(t)
    asked = t.embeddings.where("vec_id % 100 = 0")
    d = events.open_match(asked.select(_C("vec_id").alias("article_id"), F.concat(F.lit("k"), (_C("vec_id") % 11).cast("string")).alias("grouping_key")), e)
    seen = vector.select(_C("event_id").alias("id"), "embedding").join(e.select("id", "last_seen_at"), "id")
    near = events.nearest_events(asked.select(_C("vec_id").alias("id"), "embedding"), seen, FIXTURE).where("rank = 1")
    c = d.join(near.select(_C("query_id").alias("article_id"), _C("id").alias("near_event"), "distance"), "article_id", "left")
    return events.decide_grouping(c, FIXTURE).select(_C("article_id").alias("vec_id"), "kind", "event", "confidence")


@query("k_12_comparator", "SELECT doc_id, CASE WHEN quality = 1 THEN 'attach' ELSE 'create' END AS kind, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'same_event_material_update' ELSE 'same_event_new_source' END END AS relationship FROM labels")
def _(t):
    return t.labels.select("doc_id", events.compared(F.when(_C("quality") == 1, "same_event").otherwise("unrelated"), _C("toxic") == 1).alias("c")).select("doc_id", "c.*")


@query("k_13_assessment", """SELECT e.id, CASE WHEN 2 > r THEN 'high' ELSE severity END AS next_severity, CASE WHEN 2 > r THEN 'P2' ELSE urgency END AS next_urgency,
  round(CASE WHEN e.id % 4 <> 0 THEN greatest(least(0.95, 0.35 + 0.4 * 0.8 + 0.1 * least(greatest(n - 1, 0), 3)), confidence) ELSE least(confidence, 0.2) END, 9) AS next_confidence
  FROM (SELECT *, CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS r FROM v_cyber_events) e JOIN (SELECT event_id, count(*) AS n FROM v_event_articles GROUP BY 1) s ON s.event_id = e.id""")
def _(t):
    n = t.event_articles.groupBy(_C("event_id").alias("id")).agg(F.count("*").alias("sources"))
    e = t.cyber_events.join(n, "id").withColumns({"new_severity": F.lit("high"), "new_urgency": F.lit("P2"), "new_confidence": F.lit(0.8), "relevant": _C("id") % 4 != 0})
    return events.assessed(e).select("id", "next_severity", "next_urgency", F.round("next_confidence", 9).alias("next_confidence"))


_RECENT = f"""ra AS (SELECT event_id, arg_max(alert_tier, (created_at, id)) AS recent_tier, max(created_at) AS alerted_at FROM v_alerts WHERE NOT suppressed AND (epoch_us({_NOW}) - epoch_us(created_at)) / 3.6e9 < 120 GROUP BY 1),
  mu AS (SELECT event_id, max(created_at) AS updated_at FROM v_event_articles WHERE is_material_update GROUP BY 1)"""


@query("k_14_alert_decisions", f"""WITH {_RECENT}, x AS (SELECT e.*, ra.recent_tier, coalesce(mu.updated_at > ra.alerted_at, false) AS material, severity IN ('medium', 'high', 'critical') AND urgency IN ('P1', 'P2') AND confidence >= 0.75 AS confirmed,
  (epoch({_NOW}) - epoch(first_seen_at)) / 3600.0 <= 24 AS early FROM v_cyber_events e LEFT JOIN ra ON ra.event_id = e.id LEFT JOIN mu ON mu.event_id = e.id)
  SELECT id, CASE WHEN vendor IS NULL THEN 'no_affected_vendor' WHEN recent_tier IS NOT NULL AND material THEN 'material_update_bypasses_suppression' WHEN recent_tier = 'early_warning' AND confirmed THEN 'upgraded_to_confirmed'
    WHEN recent_tier IS NOT NULL THEN 'recent_alert_suppression' WHEN confirmed THEN 'confirmed_vendor_impact_event' WHEN early THEN 'early_warning_unconfirmed_signal' ELSE 'stale_event_below_confirmed_gate' END AS reason FROM x""")
def _(t):
    wide = replace(DEFAULT, suppression_hours=120)
    e = t.cyber_events.join(events.recent_alerts(t.alerts, t.event_articles, wide), _C("id") == _C("event_id"), "left").withColumn("material", F.coalesce("material", F.lit(False)))
    return events.decide_alerts(e, wide).select("id", "reason")


_LATEST = "SELECT case_id, source, arg_max(status, (retrieved_at, id)) AS status, arg_max(value, (retrieved_at, id)) AS value FROM v_observations {0} GROUP BY 1, 2"
_TERMINAL = "WHERE status IN ('ok', 'not_found', 'no_score')"
_WIDE = "w AS (SELECT case_id" + "".join(f", max(CASE WHEN source = '{s}' THEN status END) AS {s}_status, max(CASE WHEN source = '{s}' THEN value END) AS {s}_value" for s in ("nvd", "kev", "epss")) + f" FROM ({_LATEST.format(_TERMINAL)}) GROUP BY 1)"
_SCORED = _WIDE + ", sc AS (SELECT c.*, CASE WHEN nvd_status = 'ok' THEN least(nvd_value / 10, 10.0) END AS cvss, coalesce(kev_status = 'ok' AND kev_value > 20, false) AS kev, CASE WHEN epss_status = 'ok' THEN least(epss_value / 100, 1.0) END AS epss, nvd_status, kev_status, epss_status FROM v_cases c LEFT JOIN w ON w.case_id = c.id)"


@query("w_01_recent_per_source", "SELECT source_name, id FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY extracted_at DESC, id DESC) AS rn FROM v_drift) WHERE rn <= 20")
def _(t):
    return latest.first_n(t.drift, ["source_name"], [_C("extracted_at").desc(), _C("id").desc()], 20).select("source_name", "id")


@query("w_02_latest_any", _LATEST.format(""))
def _(t):
    return latest.latest(t.observations, ["case_id", "source"], ["retrieved_at", "id"]).select("case_id", "source", "status", "value")


@query("w_03_latest_terminal", _LATEST.format(_TERMINAL))
def _(t):
    return latest.latest(latest.terminal(t.observations), ["case_id", "source"], ["retrieved_at", "id"]).select("case_id", "source", "status", "value")


@query("w_04_skim", f"WITH {_WIDE} SELECT c.id, nvd_status, nvd_value, kev_status, kev_value, epss_status, epss_value FROM v_cases c LEFT JOIN w ON w.case_id = c.id")
def _(t):
    return latest.skim(t.cases, t.observations).drop("cve_id", "status")


@query("w_05_latest_verdict", "SELECT article_id, arg_max(verdict, (reviewed_at, id)) AS verdict FROM v_verdicts GROUP BY 1")
def _(t):
    return latest.latest(t.verdicts, ["article_id"], ["reviewed_at", "id"]).select("article_id", "verdict")


@query("w_06_recent_alert", f"WITH {_RECENT} SELECT event_id, recent_tier FROM ra")
def _(t):
    return events.recent_alerts(t.alerts, t.event_articles, replace(DEFAULT, suppression_hours=120)).select("event_id", "recent_tier")


@query("w_08_first_match", "SELECT event_type, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))


@query("w_09_changes", f"""SELECT id FROM (SELECT *, lag(status) OVER w AS s, lag(value) OVER w AS v FROM v_observations {_TERMINAL} WINDOW w AS (PARTITION BY case_id, source ORDER BY retrieved_at, id)) WHERE s IS DISTINCT FROM status OR v IS DISTINCT FROM value""")
def _(t):
    return latest.changes(t.observations).select("id")


@query("w_10_stratified", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 15")
def _(t):
    return latest.first_n(t.documents.select("lang", "doc_id"), ["lang"], [F.sha2(_C("doc_id").cast("string"), 256), _C("doc_id")], 15)


@query("w_12_latest_run", "SELECT status, max(next_attempt_at) = (SELECT max(next_attempt_at) FROM v_tasks WHERE status = 'completed') AS is_last FROM v_tasks WHERE status = 'completed' GROUP BY 1")
def _(t):
    done = t.tasks.where("status = 'completed'")
    return done.groupBy("status").agg(F.max("next_attempt_at").alias("m")).select("status", _C("m").isNotNull().alias("is_last"))


@query("k_15_grades", f"WITH {_SCORED} SELECT id, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss IS NOT NULL THEN 'medium' END AS cvss_grade, CASE WHEN epss >= 0.1 THEN 'critical' WHEN epss >= 0.05 THEN 'high' END AS epss_grade FROM sc")
def _(t):
    return latest.graded(latest.scores(latest.skim(t.cases, t.observations))).select("id", "cvss_grade", "epss_grade")


@query("k_16_publication", f"WITH {_SCORED} SELECT id, coalesce(cvss >= 9, false) OR kev AS meets_rule, CASE WHEN (coalesce(cvss >= 9, false) OR kev) AND status <> 'approved' THEN 'publish' WHEN NOT (coalesce(cvss >= 9, false) OR kev) AND status = 'approved' THEN 'unpublish' ELSE 'unchanged' END AS action FROM sc")
def _(t):
    return latest.publication(latest.scores(latest.skim(t.cases, t.observations))).select("id", "meets_rule", "action")


@query("k_17_exploitation_evidence", "SELECT DISTINCT ca.case_id FROM v_case_articles ca JOIN v_articles a ON a.id = ca.article_id WHERE ca.state IN ('automated_relevant', 'human_confirmed') AND regexp_matches(a.title, 'actively exploited|ransomware')")
def _(t):
    hot = t.articles.where(_C("title").rlike("actively exploited|ransomware")).select(_C("id").alias("article_id"))
    return t.case_articles.where(_C("state").isin("automated_relevant", "human_confirmed")).join(hot, "article_id", "left_semi").select("case_id").distinct()


@query("k_18_unresolved", f"""WITH l AS ({_LATEST.format('')}), w AS (SELECT case_id, max(CASE WHEN source = 'nvd' THEN status END) AS n, max(CASE WHEN source = 'kev' THEN status END) AS k, max(CASE WHEN source = 'epss' THEN status END) AS e FROM l GROUP BY 1)
  SELECT c.id, array_to_string(list_filter([CASE WHEN coalesce(n, 'failed') IN ('failed', 'transient_failure') THEN 'nvd:' || coalesce(n, 'failed') END, CASE WHEN coalesce(k, 'failed') IN ('failed', 'transient_failure') THEN 'kev:' || coalesce(k, 'failed') END, CASE WHEN coalesce(e, 'failed') IN ('failed', 'transient_failure') THEN 'epss:' || coalesce(e, 'failed') END], lambda x: x IS NOT NULL), ',') AS unresolved
  FROM v_cases c LEFT JOIN w ON w.case_id = c.id""")
def _(t):
    return latest.unresolved(latest.skim(t.cases, t.observations, None)).select("id", F.array_join("unresolved", ",").alias("unresolved"))


@query("k_22_task_plan", "SELECT id, n.task_name FROM v_articles CROSS JOIN (VALUES ('summary'), ('disposition')) n(task_name) WHERE status = 'DIGESTED' UNION ALL SELECT id, 'interpretation' FROM v_articles WHERE status = 'DIGESTED' AND regexp_matches(title, '(?i)cve-')")
def _(t):
    ready = t.articles.where("status = 'DIGESTED'")
    names = F.array(F.lit("summary"), F.lit("disposition"), F.when(_C("title").rlike("(?i)cve-"), "interpretation"))
    return ready.select("id", F.explode(F.array_compact(names)).alias("task_name"))


@query("k_24_legacy_overrides")
def _(t):
    # The type of an event is its first attack word, in place of a model's judgement.
    e = t.embeddings.select(_C("vec_id").alias("id"), "embedding")
    near = events.similar(e.where("id % 100 = 0"), e)
    # Entities are only needed of articles in a pair.
    paired = near.select(F.explode(F.array("query_id", "id")).alias("id")).distinct()
    d = entities.drafts(entities.extract(t.articles.join(paired, "id", "left_semi")))
    facts = d.select(_C("article_id").alias("id"), "cves", "vendors", "products", F.coalesce(F.get("attacks", F.lit(0)), F.lit("other")).alias("event_type"))
    return events.legacy_overrides(near, facts)


@query("k_25_public_cases", "SELECT c.cve_id, count(ca.article_id) AS articles FROM v_cases c LEFT JOIN v_case_articles ca ON ca.case_id = c.id AND ca.state <> 'human_rejected' WHERE c.status = 'approved' GROUP BY 1")
def _(t):
    links = t.case_articles.where("state <> 'human_rejected'").groupBy(_C("case_id").alias("id")).agg(F.count("*").alias("articles"))
    return t.cases.where("status = 'approved'").join(links, "id", "left").select("cve_id", F.coalesce("articles", F.lit(0)).alias("articles"))


@query("k_26_workspace_cases", f"WITH {_SCORED} SELECT cve_id, round(cvss, 6) AS cvss, kev, round(epss, 6) AS epss FROM sc")
def _(t):
    return latest.scores(latest.skim(t.cases, t.observations)).select("cve_id", F.round("cvss", 6).alias("cvss"), "kev", F.round("epss", 6).alias("epss"))


@query("o_07_attention_order", f"WITH {_SCORED} SELECT id, row_number() OVER (ORDER BY kev DESC, coalesce(epss, -1) DESC, coalesce(cvss, -1) DESC, id) AS place FROM sc QUALIFY place <= 50")
def _(t):
    s = latest.scores(latest.skim(t.cases, t.observations))
    top = s.orderBy(*latest.attention()).limit(50)
    return top.select("id", F.row_number().over(Window.orderBy(*latest.attention())).alias("place"), ).select("id", _C("place").cast("long").alias("place"))


@query("o_07_attention_order_compat", f"WITH {_SCORED} SELECT id, row_number() OVER (ORDER BY kev DESC, coalesce(epss, -1) DESC, printf('%.6f', 1 - coalesce(cvss, -1.0)), id) AS place FROM sc QUALIFY place <= 50")
def _(t):
    s = latest.scores(latest.skim(t.cases, t.observations))
    order = latest.attention("compat")
    return s.orderBy(*order).limit(50).select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("o_08_public_order", f"WITH {_SCORED}, m AS (SELECT case_id, max(retrieved_at) AS seen FROM v_observations GROUP BY 1) SELECT cve_id, row_number() OVER (ORDER BY strftime(seen + INTERVAL 8 HOUR, '%Y-%m-%d') DESC, kev DESC, coalesce(epss, -1) DESC, coalesce(cvss, -1) DESC, cve_id) AS place FROM sc JOIN m ON m.case_id = sc.id QUALIFY place <= 50")
def _(t):
    seen = t.observations.groupBy(_C("case_id").alias("id")).agg(F.max("retrieved_at").alias("seen"))
    s = latest.scores(latest.skim(t.cases, t.observations)).join(seen, "id")
    order = latest.public_order("seen")
    return s.orderBy(*order).limit(50).select("cve_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


_DRIFT = "SELECT source_name, count(*) AS sampled, median(rss_recall) AS r, median(content_quality) AS q, count(*) FILTER (regexp_matches(extraction_status, '(?i)failed')) / count(*) AS f FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY extracted_at DESC, id DESC) AS rn FROM v_drift) WHERE rn <= 20 GROUP BY 1"


@query("q_01_drift", f"SELECT source_name, sampled, round(r, 9) AS median_recall, round(q, 9) AS median_quality, f AS failure_rate, sampled >= 5 AND (r < 0.6 OR q < 0.3 OR f > 0.5) AS drifted FROM ({_DRIFT})")
def _(t):
    return monitoring.drift(t.drift).select("source_name", "sampled", F.round("median_recall", 9).alias("median_recall"), F.round("median_quality", 9).alias("median_quality"), "failure_rate", "drifted")


@query("q_01_drift_reasons", f"""SELECT source_name, CASE WHEN sampled < 5 THEN '' ELSE concat_ws(',', CASE WHEN r < 0.6 THEN printf('median_recall_%.2f_below_0.6', r) END, CASE WHEN q < 0.3 THEN printf('median_quality_%.2f_below_0.3', q) END,
  CASE WHEN f > 0.5 THEN printf('failure_rate_%.2f_above_0.5', f) END) END AS reasons FROM ({_DRIFT})""")
def _(t):
    return monitoring.drift(t.drift).select("source_name", F.array_join("reasons", ",").alias("reasons"))


@query("q_02_alert_latency", f"""WITH a AS (SELECT id, event_id, created_at FROM v_alerts WHERE NOT suppressed AND (epoch_us({_NOW}) - epoch_us(created_at)) / 3.6e9 < 168), f AS (SELECT event_id, min(published_at) AS p FROM v_event_articles ea JOIN v_articles ar ON ar.id = ea.article_id WHERE published_at IS NOT NULL GROUP BY 1),
  l AS (SELECT (epoch_us(created_at) - epoch_us(p)) / 3.6e9 AS h FROM a JOIN f ON f.event_id = a.event_id WHERE created_at >= p)
  SELECT count(*) AS sampled, round(quantile_disc(h, 0.5), 6) AS p50_hours, round(quantile_disc(h, 0.9), 6) AS p90_hours, count(*) FILTER (h > 2) AS breaches, coalesce(count(*) >= 3 AND quantile_disc(h, 0.9) > 2, false) AS slo_violated FROM l""")
def _(t):
    return monitoring.latency(t.alerts, t.event_articles, t.articles).select("sampled", F.round("p50_hours", 6).alias("p50_hours"), F.round("p90_hours", 6).alias("p90_hours"), "breaches", "slo_violated")


@query("v_03_top_k", f"""WITH b AS (SELECT e.vec_id, e.embedding FROM embeddings e JOIN v_articles a ON a.id = e.vec_id WHERE {_WITHIN.format(_MID, 'published_at', 14)}),
  d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, {_DISTANCE} AS distance FROM embeddings q JOIN b ON b.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
  SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 5""")
def _(t):
    """Articles of the last 14 days, for the stated query set (ids divisible by 100)."""
    e = t.embeddings.select(_C("vec_id").alias("id"), "embedding")
    recent = dates.hours(dates.moment(_LATER.as_of), _C("published_at")) < 14 * 24
    base = e.join(t.articles.where(recent).select("id"), "id", "left_semi")
    return vectors.top_k(e.where("id % 100 = 0"), base, 5).select("query_id", "id", _C("rank").cast("long").alias("rank"))


@query("j_12_top_k_eligible", f"WITH {_OPEN}, {_NEAR} SELECT query_id, id, rank FROM ne")
def _(t):
    """Events of the last 30 days whose vector is of the same model and length, for the stated query set (ids divisible by 100)."""
    e, vector = _open_events(t)
    seen = vectors.eligible(vector.withColumn("embedding_model", F.lit("model-a")), "model-a", 64).select(_C("event_id").alias("id"), "embedding").join(e.select("id", "last_seen_at"), "id")
    asked = t.embeddings.where("vec_id % 100 = 0").select(_C("vec_id").alias("id"), "embedding")
    return events.nearest_events(asked, seen).select("query_id", "id", _C("rank").cast("long").alias("rank"))


@query("p_12_eligible_vectors", "SELECT count(*) AS n FROM embeddings WHERE vec_id % 50 <> 0 AND len(embedding) = 64")
def _(t):
    return vectors.eligible(t.vectors, "model-a", 64).agg(F.count("*").alias("n"))


@query("v_02_pairwise", "SELECT label, round(avg(list_cosine_distance(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[]))), 4) AS mean FROM (SELECT label, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL GROUP BY 1")
def _(t):
    pair = t.embeddings.withColumn("b", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("b is not null")
    return pair.groupBy("label").agg(F.round(F.avg(numbers.cosine_distance(_C("embedding"), _C("b"))), 4).alias("mean"))


@query("d_04_epoch_difference", "SELECT user_id, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS seconds FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.round(dates.hours(F.max("ts"), F.min("ts")) * 3600).cast("long").alias("seconds"))
