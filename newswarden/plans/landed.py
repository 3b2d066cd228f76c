"""Sources as their services write them, made from the tables, landed and read again (S-05, S-06, S-10); hot subsets (P-11); page text (T-14, T-15, S-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import readable, text
from ..sources import catalogue, datasets, hot, landing, rss
from .registry import query

_C = F.col


@query("s_05_rss_atom", """SELECT id, CASE WHEN id % 2 = 0 THEN 'rss' ELSE 'atom' END AS kind, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, concat('https://news.example/', id) AS canonical_url, sha256(concat('https://news.example/', id)) AS url_hash,
  trim(regexp_replace(concat('Lead & ', rss_summary), '\\s+', ' ', 'g')) AS rss_summary, CASE WHEN id % 2 = 0 THEN 'patch|security' ELSE '' END AS categories, CAST(floor(epoch(published_at)) AS BIGINT) AS published_at FROM v_articles""")
def _(t):
    """All articles, the even ones as items of RSS with dates of RFC 822 and the odd ones as entries of Atom; snippets come from escaped HTML."""
    page = F.concat(F.lit("<p>Lead &amp; <i>"), F.replace(F.replace("rss_summary", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</i></p>"))
    dated = lambda form: F.coalesce(F.date_format("published_at", form), F.lit("unknown"))
    xml = lambda c: F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    a = t.articles.select("id", xml("title").alias("title"), F.concat(F.lit("HTTPS://News.example/"), _C("id").cast("string"), F.lit("?utm_source=feed#top")).alias("address"), xml(page).alias("page"), dated("EEE, d MMM yyyy HH:mm:ss 'GMT'").alias("spoken"), dated("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    item = a.where("id % 2 = 0").select("title", F.struct(_C("address").alias("_VALUE"), F.lit("true").alias("_isPermaLink")).alias("guid"), F.array(F.lit("patch"), F.lit(" security "), F.lit("patch")).alias("category"), _C("spoken").alias("pubDate"), _C("page").alias("description"))
    link = lambda rel, href: F.struct(F.lit(rel).alias("_rel"), href.alias("_href"))
    entry = a.where("id % 2 = 1").select("title", F.array(link("self", F.lit("https://other.example/")), link("alternate", _C("address"))).alias("link"), _C("iso").alias("updated"), _C("page").alias("content"))
    path = landing.scratch(t.spark, "rss")
    item.write.format("xml").options(rowTag="item", rootTag='rss version="2.0"').save(f"{path}/rss")
    entry.write.format("xml").options(rowTag="entry", rootTag="feed").save(f"{path}/atom")
    found = rss.normalised(rss.items(t.spark, f"{path}/*"))
    return found.select(F.regexp_extract("canonical_url", "([0-9]+)$", 1).cast("long").alias("id"), "kind", F.trim(F.regexp_replace("title", "\\s+", " ")).alias("title"), "canonical_url", "url_hash", "rss_summary", F.array_join(F.sort_array("rss_categories"), "|").alias("categories"), F.unix_seconds("published_at").alias("published_at"))


_SOUND = "id % 23 <> 0 AND id % 17 <> 0 AND id % 13 <> 0 AND id % 19 <> 0"


@query("s_06_line_errors", f"""SELECT place, reason FROM (SELECT row_number() OVER (ORDER BY id) AS place, CASE WHEN id % 23 = 0 THEN NULL WHEN id % 17 = 0 THEN 'no JSON object' WHEN id % 13 = 0 THEN 'bad publishedAt' WHEN id % 19 = 0 THEN 'bad humanLabel'
  WHEN id % 29 = 0 AND id > (SELECT min(id) FROM v_articles WHERE id % 29 = 0 AND {_SOUND}) THEN 'repeated id' END AS reason FROM v_articles) WHERE reason IS NOT NULL""")
def _(t):
    """A line for each article in the order of ids, some blank, broken, of an unknown label or date, and some with one address; the faults with their lines over all files."""
    fields = F.struct(
        _C("source_name").alias("sourceName"), F.lit("unknown").alias("sourceTier"), F.concat(F.lit("https://example.org/"), F.when(_C("id") % 29 == 0, "same").otherwise(_C("id").cast("string"))).alias("url"), _C("title"), F.coalesce("rss_summary", F.lit("")).alias("rssSummary"),
        F.array(F.lit("security")).alias("rssCategories"), F.when(_C("id") % 13 == 0, "lately").otherwise("2024-01-05T00:00:00Z").alias("publishedAt"), F.when(_C("id") % 19 == 0, "GREAT").otherwise("RELEVANT").alias("humanLabel"), F.lit("as seen").alias("humanReason"),
    )
    line = F.when(_C("id") % 23 == 0, F.lit(" ")).when(_C("id") % 17 == 0, F.lit("{")).otherwise(F.to_json(fields))
    path = landing.scratch(t.spark, "lines")
    t.articles.select("id", line.alias("value")).repartitionByRange(8, "id").sortWithinPartitions("id").select("value").write.text(path)
    found = datasets.checked(t.spark, path).where("reason is not null")
    return found.select("place", F.split("reason", ",")[0].alias("reason"))


@query("s_10_sweeps", """SELECT cve_id, CAST(epoch(m) AS BIGINT) AS modified, CASE WHEN m <= TIMESTAMP '2024-01-09 23:58:00' THEN 1 ELSE 2 END AS sweep, cvss
  FROM (SELECT cve_id, TIMESTAMP '2024-01-01 00:00:00' + (id * 797 % 28800) * INTERVAL '1' MINUTE AS m, CASE id % 3 WHEN 0 THEN 9.5 END AS cvss FROM v_cases) WHERE m <= TIMESTAMP '2024-01-19 11:58:00'""")
def _(t):
    """Entries landed by day, and two sweeps with one checkpoint, nine and a half days apart: each entry comes once, none of the last two minutes."""
    spark = t.spark
    metric = F.array(F.struct(F.struct(F.lit(9.5).alias("baseScore"), F.lit("CVSS:3.1/AV:N").alias("vectorString")).alias("cvssData")))
    moment = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 797 % 28800 as int), 0)")
    entries = t.cases.select(_C("cve_id").alias("id"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("lastModified"), F.array(F.struct(F.lit("en").alias("lang"), F.lit("about").alias("value"))).alias("descriptions"), F.struct(F.when(_C("id") % 3 == 0, metric).alias("cvssMetricV31")).alias("metrics"))
    landed, out, state = (landing.scratch(spark, x) for x in ("catalogue", "sweeps", "state"))
    catalogue.land(entries, landed)
    for k, now in enumerate(("2024-01-10T00:00:00", "2024-01-19T12:00:00"), 1):
        stream = catalogue.modified(spark, landed, now=now).withColumn("sweep", F.lit(k))
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("cve_id", F.unix_seconds("modified_at").alias("modified"), "sweep", "cvss")


@query("p_11_hot_subset", "SELECT source_name, count(*) AS n, CAST(floor(epoch(max(extracted_at))) AS BIGINT) AS latest, true AS skipped FROM v_drift WHERE extraction_status = 'success' AND rss_recall < 0.6 GROUP BY 1")
def _(t):
    """Successful extractions of low recall as the hot subset, ordered by source and time; and whether the other files were left alone."""
    path = landing.scratch(t.spark, "hot")
    hot.write(t.drift, path, (_C("extraction_status") == "success") & (_C("rss_recall") < 0.6), ["source_name", "extracted_at"], ["id"])
    rows = hot.read(t.spark, path, True).withColumn("there", F.contains(F.input_file_name(), F.lit("hot=true")))
    return rows.groupBy("source_name").agg(F.count("*").alias("n"), F.unix_seconds(F.max("extracted_at").cast("timestamp")).alias("latest"), F.every("there").alias("skipped"))


@query("p_11_hot_lookup", "SELECT id, source_name, round(rss_recall, 6) AS rss_recall FROM v_drift WHERE extraction_status = 'success' AND rss_recall < 0.6 AND source_name = 'source7' AND extracted_at >= TIMESTAMP '2024-01-10 00:00:00'")
def _(t):
    """One source's latest of the hot subset: a partition, ranges within files, and filters pushed to the scan."""
    path = landing.scratch(t.spark, "hot")
    hot.write(t.drift, path, (_C("extraction_status") == "success") & (_C("rss_recall") < 0.6), ["source_name", "extracted_at"], ["id"])
    rows = hot.read(t.spark, path, True).where((_C("source_name") == "source7") & (_C("extracted_at") >= F.lit("2024-01-10 00:00:00").cast(t.drift.schema["extracted_at"].dataType)))
    return rows.select("id", "source_name", F.round("rss_recall", 6).alias("rss_recall"))


_PLANTED = """concat(text, chr(10), CASE doc_id % 8 WHEN 0 THEN 'Subscribe to the letter of this house' WHEN 1 THEN 'Related posts you should not miss at all' WHEN 2 THEN 'Comments (14)' WHEN 3 THEN 'TAGS : one, two, three, four, five'
  WHEN 4 THEN 'Comments are welcome in this house' WHEN 5 THEN 'stub of words' WHEN 6 THEN 'What to do:' ELSE '  © 2024 and all that follows from it ' END)"""
_JUNK = "|".join(text.JUNK)


@query("t_14_boilerplate_lines", f"""SELECT doc_id, CAST(len(k) AS BIGINT) AS kept, sha256(array_to_string(k, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split({_PLANTED}, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))),
  lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^({_JUNK})') AND NOT (length(x) < 25 AND len(regexp_split_to_array(x, '\\s+')) < 4 AND NOT regexp_matches(x, '[.!?:]$'))) AS k FROM documents)""")
def _(t):
    """Lines of all texts, each with one more line that is furniture in most of them."""
    planted = t.documents.select("doc_id", F.expr(_PLANTED.replace("chr(10)", "char(10)")).alias("text"))
    kept = text.content_lines(_C("text"))
    return planted.select("doc_id", kept.alias("k")).select("doc_id", F.size("k").cast("long").alias("kept"), F.sha2(F.array_join("k", "\n"), 256).alias("digest"))


@query("t_15_readable")
def _(t):
    """Readable text of all pages, and how it was found."""
    return readable.extracted(t.pages).select("page_id", "text", "method")


@query("s_08_readable_recall")
def _(t):
    """By method: pages, and recall and precision of the readable words against those of all paragraphs of the page."""
    rows = readable.extracted(t.pages).select("method", text.words(F.coalesce("text", F.lit(""))).alias("got"), text.words(text.html_text(F.array_join(F.regexp_extract_all("html", F.lit("(?s)<(?:p|h1)>(.*?)(?=</?(?:p|h1|article|footer)>)"), F.lit(1)), " "))).alias("want"))
    recall, precision = readable.compared(_C("got"), _C("want"))
    return rows.groupBy("method").agg(F.count("*").alias("pages"), F.round(F.avg(recall), 4).alias("recall"), F.round(F.avg(precision), 4).alias("precision"))


@query("r_05_sorted_keys", """SELECT event_id, concat('{"a":{"b":"', event_type, '","x":[{"c":', event_id % 7, ',"k":null},', user_id, ']},"m":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"z":', event_id, '}') AS canonical FROM events""")
def _(t):
    """Objects with keys out of order at every depth and with spaces, as canonical text: keys sorted, order of lists kept."""
    raw = F.concat(F.lit('{ "z": '), _C("event_id"), F.lit(', "m" : '), (_C("event_id") % 2 == 0).cast("string"), F.lit(', "a": {"x": [ {"k": null, "c": '), _C("event_id") % 7, F.lit("}, "), _C("user_id"), F.lit(' ], "b": "'), _C("event_type"), F.lit('"} }'))
    return t.events.select("event_id", F.to_json(F.parse_json(raw)).alias("canonical"))


_FEEDS = "feeds AS (SELECT source_name AS scope, id, id % 4 = 1 AS is_active FROM v_articles), ch AS (SELECT source_name AS scope, id + CASE WHEN id % 50 = 0 THEN 1000000 ELSE 0 END AS id, source_name = 'CISA Alerts' AND id % 3 = 0 AS on_, fetched_at AS seen FROM v_articles WHERE id % 2 = 1 OR id % 50 = 0 OR source_name = 'CISA Alerts')"


@query("m_05_last_active", f"""WITH {_FEEDS}, j AS (SELECT ch.*, f.is_active AS was FROM ch LEFT JOIN feeds f ON f.scope = ch.scope AND f.id = ch.id),
  n AS (SELECT scope, count(*) FILTER (NOT was AND on_) AS ons, count(*) FILTER (was AND NOT on_) AS offs FROM j GROUP BY 1), a AS (SELECT scope, count(*) FILTER (is_active) AS act FROM feeds GROUP BY 1),
  o AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY seen DESC, id DESC) AS rn FROM j WHERE was AND NOT on_)
  SELECT j.scope, j.id, j.on_ AS is_active, j.was IS NOT NULL AND NOT coalesce(o.rn = 1 AND offs >= act + ons, false) AS applied, CASE WHEN j.was IS NULL THEN 'unknown_id' WHEN o.rn = 1 AND offs >= act + ons THEN 'last_active' END AS error
  FROM j JOIN n ON n.scope = j.scope JOIN a ON a.scope = j.scope LEFT JOIN o ON o.scope = j.scope AND o.id = j.id""")
def _(t):
    """All active feeds of every source are to be switched off, some unknown ones too; one of each source stays, but for the source where others are switched on."""
    from ..operators import merges

    i, a = _C("id"), t.articles
    state = a.select(_C("source_name").alias("scope"), "id", (i % 4 == 1).alias("is_active"))
    alerts = _C("source_name") == "CISA Alerts"
    changes = a.where((i % 2 == 1) | (i % 50 == 0) | alerts).select(_C("source_name").alias("scope"), (i + F.when(i % 50 == 0, 1000000).otherwise(0)).alias("id"), (alerts & (i % 3 == 0)).alias("is_active"), _C("fetched_at").alias("at"))
    return merges.keep_one_active(state, changes)
