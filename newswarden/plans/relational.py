"""Reads, joins, aggregates, orders, set operations, sinks and transitions (S, P, J, A, O, U, M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import AS_OF
from ..functions import dates
from ..operators import merges, quantiles, readmodels
from ..sources import readers
from .registry import query

_C = F.col
_NOW = f"TIMESTAMP '{AS_OF}'"
_AT = "CAST(epoch({0}) AS BIGINT) AS {0}"


# Scans and sinks


@query("s_01_scan", "SELECT id, cve_id, status FROM v_cases ORDER BY cve_id LIMIT 40")
def _(t):
    return t.cases.orderBy("cve_id").limit(40)


@query("s_02_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id = 7")
def _(t):
    return t.documents.where("doc_id = 7").select("doc_id", "lang")


@query("s_03_keys_in_order", "SELECT k.pos, d.doc_id FROM (VALUES (0, 9), (1, 3), (2, 5)) k(pos, id) JOIN documents d ON d.doc_id = k.id")
def _(t):
    return readmodels.by_keys(t.documents, "doc_id", [9, 3, 5]).select("pos", "doc_id")


@query("s_04_status_queue", "SELECT id FROM v_articles WHERE status IN ('NEW', 'DIGESTED') ORDER BY published_at DESC NULLS LAST, fetched_at DESC, id DESC LIMIT 20")
def _(t):
    return t.articles.where(_C("status").isin("NEW", "DIGESTED")).orderBy(_C("published_at").desc_nulls_last(), _C("fetched_at").desc(), _C("id").desc()).limit(20).select("id")


@query("s_09_extraction_route", "SELECT id, CASE WHEN length(rss_summary) >= 500 THEN 'rss_only' WHEN status = 'EXTRACTION_FAILED' THEN 'browser' ELSE 'http' END AS route FROM v_articles")
def _(t):
    return t.articles.select("id", readers.route(_C("rss_summary"), _C("status") == "EXTRACTION_FAILED").alias("route"))


_HALF = "SELECT doc_id AS id, lang, n_chars FROM documents WHERE doc_id % 2 = 0"
_NEW = "SELECT doc_id AS id, lang, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 3 = 0"


def _old_new(t):
    d = t.documents
    return d.where("doc_id % 2 = 0").select(_C("doc_id").alias("id"), "lang", "n_chars"), d.where("doc_id % 3 = 0").select(_C("doc_id").alias("id"), "lang", (_C("n_chars") + 1).alias("n_chars"))


@query("s_11_insert_absent", f"WITH o AS ({_HALF}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)")
def _(t):
    return merges.insert_absent(*_old_new(t), ["id"], ["n_chars"])


@query("s_12_upsert", f"WITH o AS ({_HALF}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def _(t):
    return merges.upsert(*_old_new(t), ["id"], ["n_chars"])


@query("s_13_insert_or_nothing", f"WITH o AS ({_HALF}), n AS ({_NEW}) SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o))")
def _(t):
    return merges.insert_absent(*_old_new(t), ["id"], ["n_chars"]).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("s_14_upsert_monotone", "SELECT user_id AS id, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level, bool_or(value > 90) AS active FROM events GROUP BY 1")
def _(t):
    level = F.when(_C("event_type") == "error", "critical").when(_C("event_type") == "purchase", "high").when(_C("event_type") == "signup", "medium").otherwise("low")
    rows = t.events.select("event_id", _C("user_id").alias("id"), level.alias("level"), (_C("value") > 90).alias("active"))
    half = lambda k: rows.where(f"event_id % 2 = {k}").drop("event_id")
    return merges.upsert_monotone(half(0), half(1), ["id"], {"low": 0, "medium": 1, "high": 2, "critical": 3}, "level", "active")


@query("s_15_keep_first", "SELECT user_id AS id, CAST(max(event_id) AS BIGINT) AS seq, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM events GROUP BY 1")
def _(t):
    rows = t.events.select(_C("user_id").alias("id"), _C("event_id").alias("seq"), _C("value").alias("first_value"), _C("value").alias("last_value"))
    return merges.upsert_keep_first(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["id"], "seq", "first_value", "last_value")


@query("s_16_upsert_where", f"WITH o AS ({_HALF}), n AS ({_NEW}) SELECT * FROM n WHERE id NOT IN (SELECT id FROM o WHERE lang <> 'en') UNION ALL SELECT * FROM o WHERE lang <> 'en' OR id NOT IN (SELECT id FROM n)")
def _(t):
    return merges.upsert_where(*_old_new(t), ["id"], _C("lang") == "en")


@query("s_17_replace_group", f"WITH o AS ({_HALF}), n AS (SELECT * FROM ({_NEW}) WHERE lang = 'fr') SELECT * FROM o WHERE lang NOT IN (SELECT lang FROM n) UNION ALL SELECT * FROM n")
def _(t):
    old, new = _old_new(t)
    return merges.replace_group(old, new.where("lang = 'fr'"), ["lang"])


@query("s_18_append", f"SELECT lang, count(*) AS n FROM ({_HALF} UNION ALL {_NEW}) GROUP BY 1")
def _(t):
    return merges.append(*_old_new(t)).groupBy("lang").agg(F.count("*").alias("n"))


# Predicates


@query("p_01_optional_filters", "SELECT id FROM v_articles WHERE lang = 'en' AND status = 'NEW'")
def _(t):
    return readmodels.filtered(t.articles, lang="en", status="NEW", source_name=None).select("id")


@query("p_02_search", "SELECT id FROM v_articles WHERE title ILIKE '%ransom%' OR rss_summary ILIKE '%ransom%'")
def _(t):
    return t.articles.where(readmodels.search("ransom", "title", "rss_summary")).select("id")


@query("p_03_in", "SELECT event_id FROM events WHERE event_type IN ('error', 'signup')")
def _(t):
    return t.events.where(_C("event_type").isin("error", "signup")).select("event_id")


@query("p_04_trailing_window", f"SELECT event_id FROM events WHERE ts > {_NOW} - INTERVAL 5 DAY")
def _(t):
    return t.events.where(_C("ts") > F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(5))).select("event_id")


@query("p_05_distinct_from", "SELECT id FROM v_articles WHERE published_at IS DISTINCT FROM fetched_at")
def _(t):
    return t.articles.where(~_C("published_at").eqNullSafe(_C("fetched_at"))).select("id")


@query("p_06_optional_exclusion", "SELECT vec_id FROM embeddings WHERE vec_id <> 3")
def _(t):
    return t.embeddings.where(readmodels.other_than("vec_id", 3)).select("vec_id")


@query("p_07_json_predicates", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS VARCHAR) IS NOT NULL OR props LIKE '%1%'")
def _(t):
    return t.events.where(F.get_json_object("props", "$.k").isNotNull() | _C("props").like("%1%")).select("event_id")


@query("p_08_caseless", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def _(t):
    return t.customer.where(F.lower("c_mktsegment") == F.lower(F.lit("Building"))).select("c_custkey")


@query("p_09_computed", "SELECT id, coalesce(length(clean_text), 0) AS chars, published_at IS NOT NULL AS has_date FROM v_articles")
def _(t):
    return t.articles.select("id", F.coalesce(F.length("clean_text"), F.lit(0)).cast("long").alias("chars"), _C("published_at").isNotNull().alias("has_date"))


@query("p_10_exists_column", "SELECT c.id, EXISTS (SELECT 1 FROM v_case_articles a WHERE a.case_id = c.id AND a.state = 'human_confirmed') AS confirmed FROM v_cases c")
def _(t):
    return readmodels.with_flag(t.cases, t.case_articles.where("state = 'human_confirmed'").select(_C("case_id").alias("id")), ["id"], "confirmed").select("id", "confirmed")


@query("p_13_analysis_ready", r"SELECT id FROM v_articles WHERE length(trim(clean_text, chr(32) || chr(9) || chr(10) || chr(13))) > 0")
def _(t):
    from ..functions.text import trimmed

    return t.articles.where(F.length(trimmed(_C("clean_text"))) > 0).select("id")


@query("p_14_origin", "SELECT DISTINCT source_name FROM v_articles a WHERE NOT EXISTS (SELECT 1 FROM v_drift d WHERE d.source_name = a.source_name)")
def _(t):
    return t.articles.join(t.drift, "source_name", "left_anti").select("source_name").distinct()


@query("p_15_picker", "SELECT a.id, e.vec_id IS NOT NULL AS has_embedding FROM v_articles a LEFT JOIN embeddings e ON e.vec_id = a.id WHERE a.title ILIKE '%globex%' OR a.source_name ILIKE '%globex%'")
def _(t):
    found = t.articles.where(readmodels.search("globex", "title", "source_name"))
    return readmodels.with_flag(found, t.embeddings.select(_C("vec_id").alias("id")), ["id"], "has_embedding").select("id", "has_embedding")


@query("p_16_fresh_terms", f"SELECT id FROM v_articles WHERE (published_at IS NULL OR published_at > {_NOW} - INTERVAL 10 DAY) AND (contains(lower(title), 'patch') OR contains(lower(title), 'phishing'))")
def _(t):
    fresh = _C("published_at").isNull() | (dates.hours(dates.moment(AS_OF), _C("published_at")) < 240)
    terms = F.exists(F.array(F.lit("patch"), F.lit("phishing")), lambda k: F.contains(F.lower("title"), k))
    return t.articles.where(fresh & terms).select("id")


# Joins


@query("j_01_inner", "SELECT ea.event_id, a.lang, count(*) AS n FROM v_event_articles ea JOIN v_articles a ON a.id = ea.article_id GROUP BY ALL")
def _(t):
    return t.event_articles.join(t.articles.select(_C("id").alias("article_id"), "lang"), "article_id").groupBy("event_id", "lang").agg(F.count("*").alias("n"))


@query("j_01_orders_by_nation", "SELECT n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(t):
    rows = t.lineitem.join(t.orders, _C("o_orderkey") == _C("l_orderkey")).join(t.customer, _C("c_custkey") == _C("o_custkey")).join(t.nation, _C("n_nationkey") == _C("c_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum(_C("l_extendedprice") * (1 - _C("l_discount"))), 2).alias("revenue"))


@query("j_02_left", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality")


@query("j_03_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("j_04_needs_triage", "SELECT a.id FROM v_articles a WHERE NOT EXISTS (SELECT 1 FROM v_event_articles ea JOIN v_cyber_events e ON e.id = ea.event_id AND e.publication_status = 'approved' WHERE ea.article_id = a.id)")
def _(t):
    live = t.event_articles.join(t.cyber_events.where("publication_status = 'approved'").select(_C("id").alias("event_id")), "event_id").select(_C("article_id").alias("id"))
    return t.articles.join(live, "id", "left_anti").select("id")


@query("j_05_catalogue", "SELECT a.id FROM v_articles a WHERE EXISTS (SELECT 1 FROM v_event_articles ea JOIN v_cyber_events e ON e.id = ea.event_id AND e.publication_status = 'approved' WHERE ea.article_id = a.id)")
def _(t):
    live = t.event_articles.join(t.cyber_events.where("publication_status = 'approved'").select(_C("id").alias("event_id")), "event_id").select(_C("article_id").alias("id"))
    return t.articles.join(live, "id", "left_semi").select("id")


@query("j_06_in_subquery", "SELECT id FROM v_alerts WHERE event_id IN (SELECT event_id FROM v_event_articles WHERE article_id < 50) OR id < 100")
def _(t):
    hit = t.alerts.join(t.event_articles.where("article_id < 50"), "event_id", "left_semi")
    return hit.select("id").union(t.alerts.where("id < 100").select("id")).distinct()


@query("j_07_top_one", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) o ON o.o_custkey = c.c_custkey AND o.rn = 1")
def _(t):
    best = t.orders.groupBy(_C("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct(-_C("o_totalprice"), "o_orderkey")).alias("o_orderkey"))
    return t.customer.join(best, "c_custkey", "left").select("c_custkey", "o_orderkey")


@query("j_08_lateral_aggregate", f"SELECT e.id, {_AT.format('first_at')}, {_AT.format('last_at')} FROM v_cyber_events e LEFT JOIN (SELECT event_id, min(published_at) AS first_at, max(published_at) AS last_at FROM v_event_articles ea JOIN v_articles a ON a.id = ea.article_id GROUP BY 1) x ON x.event_id = e.id")
def _(t):
    span = t.event_articles.join(t.articles.select(_C("id").alias("article_id"), "published_at"), "article_id").groupBy(_C("event_id").alias("id")).agg(F.min("published_at").alias("a"), F.max("published_at").alias("b"))
    return t.cyber_events.join(span, "id", "left").select("id", F.unix_seconds("a").alias("first_at"), F.unix_seconds("b").alias("last_at"))


@query("j_09_grouped_children", "SELECT event_id, array_to_string(list_sort(list(article_id)), ',') AS articles FROM v_event_articles GROUP BY 1")
def _(t):
    return readmodels.children(t.event_articles, ["event_id"], "article_id", "articles").select("event_id", F.array_join("articles", ",").alias("articles"))


@query("j_10_pairs_within", "SELECT a.label AS basket, count(*) AS pairs FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def _(t):
    return readmodels.pair_counts(t.embeddings, "label", "vec_id").where("within > 0").select(_C("label").alias("basket"), _C("within").alias("pairs"))


@query("j_11_pairs_across", "SELECT a.label AS basket, count(*) AS pairs FROM embeddings a JOIN embeddings b ON a.label <> b.label AND a.vec_id <> b.vec_id GROUP BY 1")
def _(t):
    return readmodels.pair_counts(t.embeddings, "label", "vec_id").where("across > 0").select(_C("label").alias("basket"), _C("across").alias("pairs"))


@query("j_14_bands", "SELECT vec_id, CASE WHEN d <= 0.15 THEN 'same' WHEN d <= 0.35 THEN 'uncertain' ELSE 'different' END AS band FROM (SELECT vec_id, (vec_id % 100) / 100.0 AS d FROM embeddings)")
def _(t):
    d = (_C("vec_id") % 100) / 100.0
    return t.embeddings.select("vec_id", readmodels.band(d, 0.15, 0.35).alias("band"))


@query("j_15_since", "SELECT a.id FROM v_alerts a WHERE EXISTS (SELECT 1 FROM v_event_articles ea WHERE ea.event_id = a.event_id AND ea.is_material_update AND ea.created_at > a.created_at)")
def _(t):
    last = t.event_articles.where("is_material_update").groupBy("event_id").agg(F.max("created_at").alias("updated_at"))
    return t.alerts.join(last, "event_id").where("updated_at > created_at").select("id")


@query("j_16_scalars", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT label) FROM embeddings) AS labels")
def _(t):
    n = lambda df, c, name: df.agg(c.alias(name))
    one = n(t.documents, F.count("*"), "documents").withColumn("k", F.lit(1))
    return one.join(n(t.events, F.count("*"), "events").withColumn("k", F.lit(1)), "k").join(n(t.embeddings, F.countDistinct("label"), "labels").withColumn("k", F.lit(1)), "k").drop("k")


@query("j_17_recount", "SELECT e.id, count(ea.article_id) AS source_count FROM v_cyber_events e LEFT JOIN v_event_articles ea ON ea.event_id = e.id GROUP BY 1")
def _(t):
    n = t.event_articles.groupBy(_C("event_id").alias("id")).agg(F.count("*").alias("n"))
    return t.cyber_events.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("source_count"))


@query("j_18_tracked_only", "SELECT c.id, k.value FROM v_cases c JOIN (SELECT upper(concat('cve-2024-', CAST(1000 + user_id AS VARCHAR))) AS cve_id, max(value) AS value FROM events WHERE user_id % 2 = 0 GROUP BY 1) k ON k.cve_id = upper(c.cve_id)")
def _(t):
    k = t.events.where("user_id % 2 = 0").groupBy(F.upper(F.concat(F.lit("cve-2024-"), (1000 + _C("user_id")).cast("string"))).alias("key")).agg(F.max("value").alias("value"))
    return t.cases.join(k, F.upper("cve_id") == _C("key")).select("id", "value")


@query("j_19_alias_lookup", "SELECT DISTINCT vendor FROM v_inventory WHERE lower(vendor) = 'acme gw' OR lower(alias) = 'acme gw' ORDER BY vendor LIMIT 1")
def _(t):
    hit = (F.lower("vendor") == "acme gw") | (F.lower("alias") == "acme gw")
    return t.inventory.where(hit).select("vendor").distinct().orderBy("vendor").limit(1)


@query("j_20_detail", "SELECT a.id, count(DISTINCT ea.event_id) AS events, count(al.id) AS alerts FROM v_articles a LEFT JOIN v_event_articles ea ON ea.article_id = a.id LEFT JOIN v_alerts al ON al.event_id = ea.event_id GROUP BY 1")
def _(t):
    links = t.event_articles.select(_C("article_id").alias("id"), "event_id")
    n = t.alerts.groupBy("event_id").agg(F.count("*").alias("n"))
    per = links.join(n, "event_id", "left").groupBy("id").agg(F.countDistinct("event_id").alias("events"), F.sum(F.coalesce("n", F.lit(0))).alias("alerts"))
    return t.articles.select("id").join(per, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "alerts")))


# Aggregates


@query("a_01_counts", "SELECT status, count(*) AS n FROM v_articles GROUP BY 1")
def _(t):
    return t.articles.groupBy("status").agg(F.count("*").alias("n"))


@query("a_02_filtered", "SELECT count(*) AS all_rows, count(*) FILTER (n > 40) AS large FROM (SELECT event_id, count(*) AS n FROM v_event_articles GROUP BY 1)")
def _(t):
    return t.event_articles.groupBy("event_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("all_rows"), F.count_if(_C("n") > 40).alias("large"))


@query("a_03_distinct_array", "SELECT source, array_to_string(list_sort(list_distinct(list(status) FILTER (status <> 'ok'))), ',') AS states FROM v_observations GROUP BY 1")
def _(t):
    return t.observations.groupBy("source").agg(F.array_join(F.sort_array(F.collect_set(F.when(_C("status") != "ok", _C("status")))), ",").alias("states"))


@query("a_04_first_last", "SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_at, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_at FROM events GROUP BY 1")
def _(t):
    at = lambda c: F.unix_seconds(c.cast("timestamp"))
    return t.events.groupBy("user_id").agg(at(F.min("ts")).alias("first_at"), at(F.max("ts")).alias("last_at"))


@query("a_05_medians", "SELECT quantile_cont(l_quantity, 0.5) AS quantity, quantile_cont(l_extendedprice, 0.5) AS price FROM lineitem")
def _(t):
    found = tuple(quantiles.interpolated(t.lineitem, c, 0.5) for c in ("l_quantity", "l_extendedprice"))
    return t.spark.createDataFrame([found], "quantity double, price double")


@query("a_06_nearest_rank", "SELECT event_type, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY 1")
def _(t):
    return quantiles.of_groups(t.events, ["event_type"], "value", {"p90": quantiles.nearest_rank(0.9)}).select("event_type", "p90")


@query("a_07_median", "SELECT user_id, median(value) AS m FROM events GROUP BY 1")
def _(t):
    both = quantiles.of_groups(t.events, ["user_id"], "value", {"low": quantiles.at_share(0.5, False), "high": quantiles.at_share(0.5, True)})
    return both.select("user_id", ((_C("low") + _C("high")) / 2).alias("m"))


@query("a_08_upper_median", "SELECT label, list_extract(list_sort(list(vec_id)), CAST(floor(count(*) / 2) AS BIGINT) + 1) AS upper_median FROM embeddings GROUP BY 1")
def _(t):
    return quantiles.of_groups(t.embeddings, ["label"], "vec_id", {"upper_median": quantiles.upper_middle}).select("label", "upper_median")


@query("a_09_ratios", "SELECT source, CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (status = 'ok') / count(*) END AS ok_rate FROM v_observations GROUP BY 1")
def _(t):
    return t.observations.groupBy("source").agg(F.coalesce(F.try_divide(F.count_if(_C("status") == "ok"), F.count("*")), F.lit(0.0)).alias("ok_rate"))


@query("a_10_distinct", "SELECT DISTINCT source_name FROM v_articles WHERE source_name <> ''")
def _(t):
    return t.articles.where("source_name <> ''").select("source_name").distinct()


@query("a_11_zero_filled", "SELECT d.status, count(o.id) AS n FROM (VALUES ('ok'), ('failed'), ('no_score'), ('not_found')) d(status) LEFT JOIN v_observations o ON o.status = d.status GROUP BY 1")
def _(t):
    return readmodels.distribution(t.observations, "status", ["ok", "failed", "no_score", "not_found"])


@query("a_12_confusion", "SELECT quality, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM labels GROUP BY 1")
def _(t):
    return t.labels.groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "clean", "1": "toxic"})


@query("a_13_top_groups", "SELECT source, n, array_to_string(ids[1:3], ',') AS examples FROM (SELECT source, count(*) AS n, list_sort(list(id)) AS ids FROM v_observations GROUP BY 1) ORDER BY n DESC, source LIMIT 3")
def _(t):
    return readmodels.top_groups(t.observations, "source", "id", 3).select("source", "n", F.array_join("examples", ",").alias("examples"))


@query("a_14_unnest_count", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(title), ' ')) AS w FROM v_articles) GROUP BY 1")
def _(t):
    return t.articles.select(F.explode(F.split(F.lower("title"), " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("a_15_json_counts", "SELECT coalesce(json_extract_string(props, '$.page'), 'unknown') AS page, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.coalesce(F.get_json_object("props", "$.page"), F.lit("unknown")).alias("page")).agg(F.count("*").alias("n"))


@query("a_16_set_union", "SELECT article_id, array_to_string(list_sort(list_distinct(list(case_id))), ',') AS cases FROM v_case_articles GROUP BY 1")
def _(t):
    return t.case_articles.groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set("case_id")), ",").alias("cases"))


@query("a_17_state_count", "SELECT case_id, count(*) AS n FROM v_case_articles WHERE state = 'human_confirmed' GROUP BY 1")
def _(t):
    return t.case_articles.where("state = 'human_confirmed'").groupBy("case_id").agg(F.count("*").alias("n"))


@query("a_19_ages", f"SELECT source, round(avg(h), 6) AS mean, max(h) AS oldest, avg(h) > 300 AS stale FROM (SELECT source, (epoch({_NOW}) - epoch(retrieved_at)) / 3600.0 AS h FROM v_observations) WHERE h >= 0 GROUP BY 1")
def _(t):
    h = t.observations.select("source", F.floor(dates.hours(dates.moment(AS_OF), _C("retrieved_at")) * 3600 * 1e6 + 0.5).alias("us")).select("source", (_C("us") / 3.6e9).alias("h")).where("h >= 0")
    return h.groupBy("source").agg(F.round(F.avg("h"), 6).alias("mean"), F.max("h").alias("oldest"), (F.avg("h") > 300).alias("stale"))


@query("a_22_cloud_limits", "SELECT max(CASE WHEN toxic = 1 THEN doc_id END) AS same_max, min(CASE WHEN toxic = 0 THEN doc_id END) AS different_min FROM labels")
def _(t):
    return t.labels.agg(F.max(F.when(_C("toxic") == 1, _C("doc_id"))).alias("same_max"), F.min(F.when(_C("toxic") == 0, _C("doc_id"))).alias("different_min"))


@query("a_23_overview", "SELECT count(*) AS articles, count(*) FILTER (status = 'NEW') AS waiting, count(DISTINCT source_name) AS sources FROM v_articles")
def _(t):
    return t.articles.agg(F.count("*").alias("articles"), F.count_if(_C("status") == "NEW").alias("waiting"), F.countDistinct("source_name").alias("sources"))


# Orders and pages


def _numbered(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return readmodels.ranked(df.orderBy(*order).limit(n), *order)


@query("o_01_null_order", "SELECT id, row_number() OVER (ORDER BY published_at ASC NULLS LAST, id) AS place FROM v_articles QUALIFY place <= 60")
def _(t):
    return _numbered(t.articles, 60, _C("published_at").asc_nulls_last(), _C("id")).select("id", "place")


@query("o_02_case_rank", "SELECT id, row_number() OVER (ORDER BY CASE status WHEN 'DIGESTED' THEN 0 WHEN 'NEW' THEN 1 ELSE 2 END, id) AS place FROM v_articles QUALIFY place <= 50")
def _(t):
    return _numbered(t.articles, 50, F.when(_C("status") == "DIGESTED", 0).when(_C("status") == "NEW", 1).otherwise(2), _C("id")).select("id", "place")


@query("o_03_array_rank", "SELECT id, row_number() OVER (ORDER BY list_position(['critical', 'high', 'medium'], severity) ASC NULLS LAST, id) AS place FROM v_cyber_events")
def _(t):
    place = F.nullif(F.array_position(F.array(F.lit("critical"), F.lit("high"), F.lit("medium")), _C("severity")), F.lit(0))
    return readmodels.ranked(t.cyber_events, place.asc_nulls_last(), _C("id")).select("id", "place")


@query("o_04_flag_order", "SELECT id, row_number() OVER (ORDER BY (vendor IS NOT NULL) DESC, id) AS place FROM v_cyber_events")
def _(t):
    return readmodels.ranked(t.cyber_events, _C("vendor").isNotNull().desc(), _C("id")).select("id", "place")


@query("o_05_page", "SELECT id FROM v_articles ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 25 OFFSET 50")
def _(t):
    return readmodels.page(t.articles, "recent", limit=25, offset=50).select("id")


@query("o_06_sort_menu", "SELECT id FROM v_articles ORDER BY rss_recall ASC NULLS LAST, id DESC LIMIT 30")
def _(t):
    return readmodels.page(t.articles, "recall_asc", limit=30).select("id")


@query("o_09_attention_first", "SELECT id, row_number() OVER (ORDER BY (status = 'EXTRACTION_FAILED') DESC, id) AS place FROM v_articles QUALIFY place <= 40")
def _(t):
    return _numbered(t.articles, 40, (_C("status") == "EXTRACTION_FAILED").desc(), _C("id")).select("id", "place")


@query("o_10_ingest_order", "SELECT id, row_number() OVER (ORDER BY published_at ASC NULLS LAST, source_name, id) AS place FROM v_articles QUALIFY place <= 40")
def _(t):
    return _numbered(t.articles, 40, _C("published_at").asc_nulls_last(), _C("source_name"), _C("id")).select("id", "place")


@query("o_11_selected_row", "SELECT DISTINCT id FROM ((SELECT id FROM v_articles ORDER BY id DESC LIMIT 10) UNION ALL SELECT id FROM v_articles WHERE id = 5)")
def _(t):
    return readmodels.with_selected(t.articles.select("id"), "id", 5, 10, _C("id").desc())


# Sets


@query("u_01_queues", "SELECT id FROM (SELECT 0 AS q, id FROM v_articles WHERE status = 'NEW' UNION ALL SELECT 1, id FROM v_articles WHERE status = 'DIGESTED') ORDER BY q, id LIMIT 80")
def _(t):
    part = lambda k, s: t.articles.where(_C("status") == s).select(F.lit(k).alias("q"), "id")
    return part(0, "NEW").union(part(1, "DIGESTED")).orderBy("q", "id").limit(80).select("id")


@query("u_02_overrides", "SELECT coalesce(o.doc_id, d.doc_id) AS doc_id, coalesce(o.toxic, d.quality) AS label FROM labels d FULL JOIN (SELECT doc_id + 1 AS doc_id, toxic FROM labels WHERE doc_id % 7 = 0) o ON o.doc_id = d.doc_id")
def _(t):
    o = t.labels.where("doc_id % 7 = 0").select((_C("doc_id") + 1).alias("doc_id"), _C("toxic").alias("label"))
    return readmodels.overridden(t.labels.select("doc_id", _C("quality").alias("label")), o, ["doc_id"], "label")


@query("u_03_set_f1", """SELECT id, CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(g, p)) / (len(g) + len(p)) END AS f1
  FROM (SELECT id, list_distinct(string_split(lower(title), ' ')) AS g, list_distinct(string_split(lower(substring(title, 1, 20)), ' ')) AS p FROM v_articles)""")
def _(t):
    from ..operators.evaluation import set_f1

    w = lambda c: F.split(c, " ")
    return t.articles.select("id", set_f1(w(_C("title")), w(F.substring("title", 1, 20)), keep_empty=True).alias("f1"))


@query("u_04_difference", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return t.documents.where("lang = 'en'").join(t.labels.where("quality = 1"), "doc_id", "left_anti").select("doc_id")


@query("u_05_caseless_union", "SELECT vendor, array_to_string(list_filter([vendor, product, lower(vendor)], lambda x: x <> lower(x)), '|') AS names FROM v_inventory")
def _(t):
    return t.inventory.select("vendor", F.array_join(readmodels.distinct_caseless(F.array("vendor", "product", F.lower("vendor"))), "|").alias("names"))


# Transitions


@query("m_01_failure", "SELECT target_id, task_name, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 5 THEN 'needs_attention' ELSE 'pending' END AS status FROM v_tasks WHERE status = 'running'")
def _(t):
    return merges.failed(t.tasks.where("status = 'running'"), dates.moment(AS_OF)).select("target_id", "task_name", "attempts", "status")


@query("m_02_claim", f"SELECT target_id, task_name, attempts FROM v_tasks WHERE status = 'pending' AND next_attempt_at <= {_NOW} ORDER BY next_attempt_at, target_id, task_name, attempts LIMIT 10")
def _(t):
    return merges.claimed(t.tasks, dates.moment(AS_OF), 10).select("target_id", "task_name", "attempts")


@query("m_03_backoff", "SELECT conv_id, turn, [0, 30, 120, 600, 1800][CAST(least(turn, 4) AS BIGINT) + 1] AS seconds FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", merges.backoff(_C("turn")).alias("seconds"))


@query("m_05_guards", "SELECT id FROM v_cyber_events WHERE publication_status = 'approved' AND vendor IS NULL")
def _(t):
    return t.cyber_events.where((_C("publication_status") == "approved") & _C("vendor").isNull()).select("id")


@query("m_06_patch", "SELECT event_id, coalesce(json_extract_string(props, '$.page'), event_type) AS page FROM events")
def _(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.page"), "event_type").alias("page"))


@query("m_07_reembed", "SELECT count(*) AS stale FROM embeddings WHERE vec_id % 50 = 0")
def _(t):
    v = t.vectors.withColumn("embedding", F.when(_C("embedding_model").eqNullSafe(F.lit("model-a")), _C("embedding")))
    return v.agg(F.count_if(_C("embedding").isNull()).alias("stale"))


@query("m_08_move_link", "SELECT event_id, count(*) AS n FROM (SELECT CASE WHEN article_id % 9 = 0 THEN 0 ELSE event_id END AS event_id FROM v_event_articles) GROUP BY 1")
def _(t):
    moved = t.event_articles.where("article_id % 9 = 0").withColumn("event_id", F.lit(0).cast("long"))
    return merges.upsert(t.event_articles, moved, ["article_id"], ["created_at"]).groupBy("event_id").agg(F.count("*").alias("n"))
