"""Deduplication, grouping, assessment and alerts (K-10 to K-14)."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import DEFAULT, Context
from ..functions import dates, numbers, text
from . import skew, vectors

# Order of severities and urgencies.
SEVERITY, URGENCY = {"low": 0, "medium": 1, "high": 2, "critical": 3}, {"P4": 0, "P3": 1, "P2": 2, "P1": 3}


def similar(queries: DataFrame, base: DataFrame, *, limit: int = 5, least: float = 0.82) -> DataFrame:
    """(query_id, id, distance, rank) of the `limit` nearest with cosine >= `least`, to six digits."""
    return vectors.top_k(queries, base, limit).where(F.col("distance") <= numbers.rounded(F.lit(1 - least), 6))


def legacy_overrides(near: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, id, score, relationship) of the first similar event that structured signals decide (K-24).

    `near` is from `similar`; `facts` has id, cves, vendors, products, event_type of all events in it. In order of rank,
    a shared identifier is a material update, else a shared vendor and product of the same type a new source. Queries
    that neither decides have no row.
    """
    named = ("cves", "vendors", "products", "event_type")
    own, other = (facts.select(F.col("id").alias(key), *(F.col(n).alias(f"{side}_{n}") for n in named)) for key, side in (("query_id", "a"), ("id", "b")))
    met = near.join(own, "query_id").join(other, "id")
    shared = lambda n: F.coalesce(F.arrays_overlap(f"a_{n}", f"b_{n}"), F.lit(False))
    alike = (F.col("a_event_type") == F.col("b_event_type")) & shared("vendors") & shared("products")
    kind = F.when(shared("cves"), "same_event_material_update").when(alike, "same_event_new_source")
    decided = met.withColumn("relationship", kind).where(F.col("relationship").isNotNull())
    first = decided.groupBy("query_id").agg(F.min_by(F.struct("id", (1 - F.col("distance")).alias("score"), "relationship"), "rank").alias("m"))
    return first.select("query_id", "m.*")


#: SHA-256 of the empty text.
_NOTHING = sha256(b"").hexdigest()


def _chains(dated: DataFrame, days: int, frequent: list[str]) -> DataFrame:
    """(title_hash, n, chain): of each title the articles that are no duplicates, each over `days` after the last.

    Titles are gone through in one sorted array each, but for the `frequent` ones, of which there are few: their
    next survivor is found for all at once, round by round, as many times as `days` fit into their time.
    """
    rows = dated.select("title_hash", F.struct(F.col("published_at").alias("at"), F.col("fetched_at").alias("f"), "id").alias("a"))
    later = lambda x, y: dates.hours(x["at"], y["at"]) > 24 * days
    kind = f"array<{rows.schema['a'].dataType.simpleString()}>"
    step = lambda acc, x: F.when((F.size(acc) == 0) | later(x, F.element_at(acc, -1)), F.concat(acc, F.array(x))).otherwise(acc)
    spark = dated.sparkSession
    listed = F.broadcast(spark.createDataFrame([(k,) for k in frequent], "title_hash string"))
    small = rows.join(listed, "title_hash", "left_anti") if frequent else rows
    out = small.groupBy("title_hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("a")).alias("all"))
    out = out.select("title_hash", "n", F.aggregate("all", F.array().cast(kind), step).alias("chain"))
    if not frequent:
        return out
    hot = rows.join(listed, "title_hash").persist()
    first = hot.groupBy("title_hash").agg(F.min("a").alias("a"), F.count("*").alias("n")).collect()
    found, last = {r.title_hash: [r.a] for r in first}, {r.title_hash: r.a for r in first}
    while last:
        ends = spark.createDataFrame(list(last.items()), f"title_hash string, last {rows.schema['a'].dataType.simpleString()}")
        nexts = hot.join(F.broadcast(ends), "title_hash").where(later(F.col("a"), F.col("last"))).groupBy("title_hash").agg(F.min("a").alias("a")).collect()
        last = {r.title_hash: r.a for r in nexts}
        for k, v in last.items():
            found[k].append(v)
    hot.unpersist()
    return out.union(spark.createDataFrame([(r.title_hash, r.n, found[r.title_hash]) for r in first], f"title_hash string, n long, chain {kind}"))


def survivors(articles: DataFrame, mode: str = "spec", *, days: int = 7, array_rows: int = 50_000, hot: int = skew.HOT) -> DataFrame:
    """Exact rungs of the duplicate ladder: adds content_hash, title_hash, duplicate_of and rung.

    An article without text has no content hash, one without a title no title hash, and neither is a duplicate by it.
    Survivor of a content hash: in spec mode the first by (published_at, fetched_at, id), unknown dates last; in compat
    mode the last by the same keys descending, as rows handled newest first leave it. Of the others, one is a duplicate
    by title if an article that is none was published within `days` before it; without a date it is not.
    """
    # Null for the hash of nothing, by a filter that names the hash once: it would be computed for each time it is named.
    hashed = lambda c: F.get(F.filter(F.array(F.sha2(c, 256)), lambda x: x != _NOTHING), F.lit(0))
    titles = hashed(text.normal_title(F.col("title")))
    # From titles alone, so that this pass doesn't read texts.
    frequent = articles.select(titles.alias("title_hash")).where("title_hash is not null").groupBy("title_hash").agg(F.count("*").alias("n")).where(F.col("n") > array_rows)
    frequent = [r.title_hash for r in frequent.collect()]
    a = articles.withColumns({"content_hash": hashed(text.trimmed(F.col("clean_text"))), "title_hash": titles})
    unknown = F.col("published_at").isNull()
    # The survivor is the first dated row in spec mode; compat keeps an undated one if there is any, else the oldest.
    key = F.struct(unknown.alias("u") if mode == "spec" else (~unknown).alias("u"), F.col("published_at").alias("p"), F.col("fetched_at").alias("f"), F.col("id").alias("i"))
    by_content = a.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min(key).alias("k"), F.count("*").alias("n")).select("content_hash", "n", F.col("k.i").alias("content_first"))
    a = skew.attach(a, by_content, "content_hash", "n", "id", hot)
    copy = F.coalesce(F.col("content_first") != F.col("id"), F.lit(False))
    chains = _chains(a.where(~copy & F.col("title_hash").isNotNull() & ~unknown), days, frequent)
    out = skew.attach(a, chains, "title_hash", "n", "id", hot)
    before = lambda c: (c["at"] <= F.col("published_at")) & (dates.hours(F.col("published_at"), c["at"]) <= 24 * days) & (c["id"] != F.col("id"))
    near = F.get(F.filter("chain", before), F.lit(0))["id"]
    rung = F.when(copy, "content_hash").when(near.isNotNull(), "title_hash").otherwise("unique")
    out = out.withColumns({"rung": rung, "duplicate_of": F.when(copy, F.col("content_first")).otherwise(near)})
    return out.drop("content_first", "chain")


def semantic_candidates(queries: DataFrame, vectors_: DataFrame, context: Context = DEFAULT, *, k: int = 5, days: int = 14) -> DataFrame:
    """(query_id, id, distance, rank) of the nearest articles (id, embedding, published_at) of the last `days`, within the duplicate distance."""
    recent = dates.hours(dates.moment(context.as_of), F.col("published_at")) < 24 * days
    return vectors.top_k(queries, vectors_.where(recent).select("id", "embedding"), k).where(F.col("distance") <= context.duplicate_distance)


def dedup_ladder(articles: DataFrame, vectors_: DataFrame, asked: Column, context: Context = DEFAULT) -> DataFrame:
    """The whole ladder for the articles that `asked` holds for, against all: (id, rung, duplicate_of, candidates).

    `vectors_` has id and embedding of one model and length. What no exact rung catches is a semantic candidate if
    recent articles are near enough; `candidates` are their ids by distance.
    """
    exact = survivors(articles)
    own = exact.where(asked).select("id", "rung", "duplicate_of", "published_at")
    dated = vectors_.join(articles.select("id", "published_at"), "id")
    near = semantic_candidates(vectors_.join(own.where("rung = 'unique'").select("id"), "id", "left_semi"), dated, context)
    near = near.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("c")))).alias("n"))
    out = own.join(near, "id", "left")
    return out.select("id", F.when(F.col("n").isNotNull(), "semantic_candidate").otherwise(F.col("rung")).alias("rung"), "duplicate_of", F.coalesce(F.transform("n", lambda x: x["c"]), F.array().cast(f"array<{articles.schema['id'].dataType.simpleString()}>")).alias("candidates"))


def open_match(drafts: DataFrame, events: DataFrame) -> DataFrame:
    """Key rung against events there are: adds `key_event`, the open event of the grouping key seen last; the unknown key has none."""
    last = events.where("event_status = 'open' and grouping_key <> 'unknown'").groupBy("grouping_key").agg(F.max_by("id", F.struct("last_seen_at", "id")).alias("key_event"))
    sizes = drafts.groupBy("grouping_key").agg(F.count("*").alias("n"))
    return skew.attach(drafts, last.join(sizes, "grouping_key"), "grouping_key", "n", "article_id")


def event_vectors(links: DataFrame, articles: DataFrame) -> DataFrame:
    """(event_id, article_id, embedding): the vector of an event is that of its first article (by link time, id) in status EMBEDDED, GROUPED or CLASSIFIED, else of its first."""
    ready = ~F.col("status").isin("EMBEDDED", "GROUPED", "CLASSIFIED")
    member = links.join(articles.select(F.col("id").alias("article_id"), "status", "embedding"), "article_id").where(F.col("embedding").isNotNull())
    first = member.groupBy("event_id").agg(F.min_by(F.struct("article_id", "embedding"), F.struct(ready.alias("late"), "created_at", "article_id")).alias("m"))
    return first.select("event_id", "m.*")


def group_by_key(drafts: DataFrame) -> DataFrame:
    """Key rung: one event per grouping key, made by its first article; the unknown key never matches."""
    key = F.when(F.col("grouping_key") == "unknown", F.concat(F.lit("unknown:"), F.col("article_id").cast("string"))).otherwise(F.col("grouping_key"))
    w = drafts.withColumn("__key", key)
    first = w.groupBy("__key").agg(F.min("article_id").alias("creator"), F.count("*").alias("articles"))
    return w.join(first, "__key").withColumn("kind", F.when(F.col("article_id") == F.col("creator"), "create").otherwise("attach")).drop("__key")


def group_until_quiet(drafts: DataFrame, quiet_hours: float = 24 * 30, as_of: Column | None = None) -> DataFrame:
    """Key rung with closing: an event of a key is open until `quiet_hours` have passed since its last article, and the next article opens another.

    From (article_id, grouping_key, seen_at): article_id, event_id (its first article), kind (create, attach), at, articles (how many so far);
    with `as_of` also a row of kind close, without an article, for each event that was quiet by then. A key's events are found by session
    windows, merged before the shuffle where they can be, and a much-reported key's rows are spread.
    """
    quiet = int(quiet_hours * 3_600_000_000)
    rows = drafts.select("article_id", "grouping_key", F.unix_micros(F.col("seen_at").cast("timestamp")).alias("us"))
    lone = rows.where("grouping_key is null or grouping_key = 'unknown'").select("article_id", F.col("article_id").alias("event_id"), F.lit("create").alias("kind"), "us", F.lit(1).cast("long").alias("articles"))
    known = rows.where("grouping_key <> 'unknown'")
    # A session goes on where the next row is exactly at its end, an event does not.
    found = known.groupBy("grouping_key", F.session_window(F.timestamp_micros("us"), f"{quiet - 1} microseconds").alias("s")).agg(F.min(F.struct("us", "article_id")).alias("first"), F.max("us").alias("last"), F.count("*").alias("n"))
    found = found.select("grouping_key", F.struct(F.col("first.us").alias("start"), F.col("first.article_id").alias("event"), "last", "n").alias("e"))
    facts = found.groupBy("grouping_key").agg(F.sum("e.n").alias("__n"), F.sort_array(F.collect_list("e")).alias("events"))
    own = F.get(F.filter("events", lambda e: (e["start"] <= F.col("us")) & (F.col("us") <= e["last"])), F.lit(0))
    each = skew.attach(known, facts, "grouping_key", "__n", "article_id").withColumn("e", own)
    order = Window.partitionBy("grouping_key", "e.event").orderBy("us", "article_id")
    each = each.select("article_id", F.col("e.event").alias("event_id"), F.when(F.col("article_id") == F.col("e.event"), "create").otherwise("attach").alias("kind"), "us", F.row_number().over(order).cast("long").alias("articles"))
    out = each.union(lone)
    if as_of is not None:
        out = out.union(found.where(F.col("e.last") + quiet <= F.unix_micros(as_of)).select(F.lit(None).cast("long"), "e.event", F.lit("close"), F.col("e.last") + quiet, "e.n"))
    return out.select("article_id", "event_id", "kind", F.timestamp_micros("us").alias("at"), "articles")


def decide_grouping(candidates: DataFrame, context: Context = DEFAULT) -> DataFrame:
    """From grouping_key, key_event (null if none), near_event and distance: kind, event, confidence and method."""
    by_key = F.col("key_event").isNotNull() & (F.col("grouping_key") != "unknown")
    near = F.col("near_event").isNotNull()
    attach = near & (F.col("distance") <= context.attach_distance)
    unsure = near & (F.col("distance") <= context.uncertain_distance)
    return candidates.withColumns({
        "kind": F.when(by_key | attach, "attach").when(unsure, "uncertain").otherwise("create"),
        "event": F.when(by_key, F.col("key_event")).when(unsure, F.col("near_event")),
        "confidence": F.when(by_key, 0.9).when(attach, 0.75),
        "method": F.when(by_key, "grouping_key").when(attach, "embedding").when(unsure, F.lit(None)).otherwise("no_match"),
    })


def compared(relationship: Column, material: Column) -> Column:
    """What a comparator's verdict makes of an uncertain candidate; no verdict creates."""
    same = F.coalesce(relationship == "same_event", F.lit(False))
    return F.struct(F.when(same, "attach").otherwise("create").alias("kind"), F.when(same, F.when(material, "same_event_material_update").otherwise("same_event_new_source")).alias("relationship"))


def _rank(c: Column, ranks: dict[str, int], fallback: int) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(c, F.lit(""))), F.lit(fallback))


def highest(now: Column, new: Column, ranks: dict[str, int], fallback: str) -> Column:
    """The new value if it ranks higher; a tie keeps the old one, an unknown new value ranks as `fallback`."""
    return F.when(_rank(new, ranks, ranks[fallback]) > _rank(now, ranks, -1), new).otherwise(now)


def assessed(events: DataFrame) -> DataFrame:
    """From severity, urgency, confidence and new_severity, new_urgency, new_confidence, relevant, sources: the rolled-up three."""
    more = 0.1 * F.least(F.greatest(F.col("sources") - 1, F.lit(0)), F.lit(3))
    grown = F.greatest(F.least(F.lit(0.95), 0.35 + 0.4 * F.col("new_confidence") + more), F.coalesce("confidence", F.lit(0.0)))
    return events.withColumns({
        "next_severity": highest(F.col("severity"), F.col("new_severity"), SEVERITY, "medium"),
        "next_urgency": highest(F.col("urgency"), F.col("new_urgency"), URGENCY, "P3"),
        "next_confidence": F.when(F.col("relevant"), grown).otherwise(F.least(F.coalesce("confidence", F.lit(0.2)), F.lit(0.2))),
    })


def decide_alerts(events: DataFrame, context: Context = DEFAULT) -> DataFrame:
    """From vendor, severity, urgency, confidence, first_seen_at, recent_tier (null if no recent alert) and material: should_alert, suppressed, reason, tier."""
    confirmed = F.col("severity").isin("medium", "high", "critical") & F.col("urgency").isin("P1", "P2") & (F.coalesce("confidence", F.lit(0.0)) >= context.min_alert_confidence)
    confirmed = F.coalesce(confirmed, F.lit(False))
    early = F.coalesce(dates.hours(dates.moment(context.as_of), F.col("first_seen_at")) <= context.early_hours, F.lit(True))
    recent = F.col("recent_tier").isNotNull()
    reason = (
        F.when(F.col("vendor").isNull(), "no_affected_vendor")
        .when(recent & F.col("material"), "material_update_bypasses_suppression")
        .when(recent & confirmed & (F.col("recent_tier") == "early_warning"), "upgraded_to_confirmed")
        .when(recent, "recent_alert_suppression")
        .when(confirmed, "confirmed_vendor_impact_event")
        .when(early, "early_warning_unconfirmed_signal")
        .otherwise("stale_event_below_confirmed_gate")
    )
    held = F.col("reason").isin("no_affected_vendor", "recent_alert_suppression", "stale_event_below_confirmed_gate")
    return events.withColumn("reason", reason).withColumns({"should_alert": ~held, "suppressed": held, "tier": F.when(~held, F.when(confirmed, "confirmed").otherwise("early_warning"))})


def recent_alerts(alerts: DataFrame, links: DataFrame, context: Context = DEFAULT) -> DataFrame:
    """Per event its last alert in the trailing window that was not suppressed, and whether a material update came after it."""
    since = dates.hours(dates.moment(context.as_of), F.col("created_at")) < context.suppression_hours
    last = alerts.where(~F.col("suppressed") & since).groupBy("event_id").agg(F.max_by(F.struct("alert_tier", "created_at"), F.struct("created_at", "id")).alias("a"))
    newest = links.where("is_material_update").groupBy("event_id").agg(F.max("created_at").alias("updated_at"))
    return last.join(newest, "event_id", "left").select("event_id", F.col("a.alert_tier").alias("recent_tier"), F.col("a.created_at").alias("alerted_at"), F.coalesce(F.col("updated_at") > F.col("a.created_at"), F.lit(False)).alias("material"))


def nearest_events(queries: DataFrame, events: DataFrame, context: Context = DEFAULT, *, k: int = 3, days: int = 30) -> DataFrame:
    """(query_id, id, distance, rank) of the nearest events (id, embedding, last_seen_at) that were seen in the last `days`."""
    recent = dates.hours(dates.moment(context.as_of), F.col("last_seen_at")) < 24 * days
    return vectors.top_k(queries, events.where(recent).select("id", "embedding"), k, exclude_same=False)


def processing_order() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("fetched_at").desc(), F.col("id").desc()]


def newest_first(articles: DataFrame, n: int) -> DataFrame:
    return articles.orderBy(*processing_order()).limit(n)


def running_sources(links: DataFrame) -> DataFrame:
    w = Window.partitionBy("event_id").orderBy("created_at", "article_id")
    return links.withColumn("sources", F.row_number().over(w))
