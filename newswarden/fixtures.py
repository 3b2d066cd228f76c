"""Domain tables as views over the driver's tables, as SQL that Spark and DuckDB both run.

`Tables` gives each as a DataFrame; `with_views` puts them before an oracle's SQL.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .context import DEFAULT

#: The random vectors of the tables are far from each other, so the limits of the rungs are wider here than by default.
FIXTURE = replace(DEFAULT, attach_distance=0.60, uncertain_distance=0.65, duplicate_distance=0.60)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_T0 = "TIMESTAMP '2024-01-01 00:00:00'"
VIEWS = {
    "v_articles": f"""SELECT doc_id AS id,
      CASE doc_id % 6 WHEN 0 THEN 'CISA Alerts' WHEN 1 THEN 'Acme PSIRT' WHEN 2 THEN 'The Hacker News' WHEN 3 THEN 'Example Research Blog'
        WHEN 4 THEN 'Business Daily' ELSE source END AS source_name,
      CASE doc_id % 10
        WHEN 0 THEN concat('Acme Gateway zero-day CVE-2024-', CAST(1000 + doc_id % 50 AS STRING), ' actively exploited')
        WHEN 1 THEN 'Acme Gateway security update fixes vulnerability' WHEN 2 THEN 'Globex quarterly results and product launch'
        WHEN 3 THEN 'Globex ransomware incident confirmed'
        WHEN 4 THEN concat('Patch for cve-2023-', CAST(10000 + doc_id % 30 AS STRING), ' released')
        WHEN 5 THEN 'Initech identity attack report' WHEN 6 THEN 'Cloud webinar on customer story' WHEN 7 THEN 'Initech Vault advisory'
        WHEN 8 THEN 'Acme GW phishing campaign' ELSE substring(text, 1, 60) END AS title,
      substring(text, 1, 240) AS rss_summary, text AS clean_text, lang,
      CASE WHEN doc_id % 41 = 0 THEN NULL ELSE {_T0} + ((doc_id * 37) % 43200) * INTERVAL '1' MINUTE END AS published_at,
      {_T0} + ((doc_id * 53) % 43200) * INTERVAL '1' MINUTE AS fetched_at,
      CASE doc_id % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'EXTRACTION_PENDING' WHEN 2 THEN 'EXTRACTION_FAILED' WHEN 3 THEN 'DIGESTED' ELSE 'IGNORED' END AS status,
      CASE doc_id % 11 WHEN 0 THEN NULL ELSE (doc_id * 17 % 100) / 100.0 END AS rss_recall,
      n_chars FROM documents""",
    "v_inventory": "SELECT * FROM (VALUES ('Acme','Acme Gateway','Acme GW','critical','quiet'),('Globex','Globex Cloud','Globex','high','noisy'),('Initech','Initech Vault','Vault PAM','medium','quiet')) AS t(vendor, product, alias, criticality, news_volume)",
    # An item for each document, named by words that stand in the texts.
    "v_dictionary": "SELECT doc_id AS place, concat('vendor-', CAST(doc_id AS STRING)) AS vendor, regexp_extract(text, '[^ ]+ [^ ]+', 0) AS product, regexp_extract(text, '([^ ]+) [^ ]+$', 1) AS alias_a, regexp_extract(text, '([A-Za-z]+) [^ ]+ [^ ]+$', 1) AS alias_b, doc_id % 7 = 0 AS noisy FROM documents",
    "v_observations": """SELECT event_id AS id, user_id AS case_id,
      CASE event_type WHEN 'click' THEN 'nvd' WHEN 'view' THEN 'kev' WHEN 'signup' THEN 'epss' ELSE 'nvd' END AS source,
      CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'transient_failure' WHEN event_id % 7 = 0 THEN 'not_found' ELSE 'ok' END AS status,
      value, ts AS retrieved_at FROM events""",
    "v_event_articles": f"SELECT CAST(label AS BIGINT) AS event_id, vec_id AS article_id, (vec_id % 5 = 0) AS is_material_update, {_T0} + ((vec_id * 61) % 43200) * INTERVAL '1' MINUTE AS created_at FROM embeddings",
    "v_alerts": "SELECT event_id AS id, user_id % 10 AS event_id, (event_type = 'error') AS suppressed, CASE WHEN value > 30 THEN 'confirmed' ELSE 'early_warning' END AS alert_tier, ts AS created_at FROM events WHERE event_type IN ('error', 'purchase')",
    "v_cyber_events": f"""SELECT DISTINCT CAST(label AS BIGINT) AS id, CASE label % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
      CASE label % 4 WHEN 0 THEN 'P4' WHEN 1 THEN 'P3' WHEN 2 THEN 'P2' ELSE 'P1' END AS urgency, (label * 13 % 100) / 100.0 AS confidence,
      CASE label % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Globex' ELSE NULL END AS vendor, CASE label % 2 WHEN 0 THEN 'approved' ELSE 'draft' END AS publication_status,
      {_T0} + CAST(label AS BIGINT) * 71 * INTERVAL '1' HOUR AS first_seen_at FROM embeddings""",
    "v_cases": "SELECT DISTINCT user_id AS id, concat('CVE-2024-', CAST(1000 + user_id AS STRING)) AS cve_id, CASE user_id % 3 WHEN 0 THEN 'approved' ELSE 'draft' END AS status FROM events",
    "v_case_articles": """SELECT doc_id % 97 AS case_id, doc_id AS article_id, CASE doc_id % 5 WHEN 0 THEN 'human_rejected' WHEN 1 THEN 'human_confirmed' WHEN 2 THEN 'automated_relevant' ELSE 'mentioned' END AS state FROM documents""",
    "v_drift": f"""SELECT concat('source', CAST(user_id % 20 AS STRING)) AS source_name, event_id AS id, ts AS extracted_at, least(value / 50.0, 1.0) AS rss_recall,
      least(value / 100.0, 1.0) AS content_quality, CASE WHEN event_type = 'error' THEN 'http_failed' ELSE 'success' END AS extraction_status FROM events""",
    "v_verdicts": f"""SELECT doc_id AS article_id, CASE quality WHEN 1 THEN 'relevant' ELSE 'irrelevant' END AS verdict, {_T0} + (doc_id % 500) * INTERVAL '1' HOUR AS reviewed_at, doc_id * 2 AS id FROM labels
      UNION ALL SELECT doc_id, CASE toxic WHEN 1 THEN 'uncertain' ELSE 'relevant' END, {_T0} + (doc_id * 7 % 500) * INTERVAL '1' HOUR, doc_id * 2 + 1 FROM labels WHERE doc_id % 3 = 0""",
    "v_tasks": f"""SELECT conv_id AS target_id, concat('task', CAST(turn % 3 AS STRING)) AS task_name, turn AS attempts, CASE conv_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'needs_attention' END AS status,
      {_T0} + (conv_id * 31 + turn) % 43200 * INTERVAL '1' MINUTE AS next_attempt_at FROM conversations""",
}


def with_views(sql: str, dialect: str = "duckdb") -> str:
    """`sql` behind the views that it names."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not named:
        return sql
    own = ", ".join(f"{v} AS ({VIEWS[v]})" for v in named)
    own = own.replace("AS STRING", "AS VARCHAR")
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {own}, {body[15:]}"
    return f"WITH {own}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {own} {body}"


class Tables:
    """The tables and views of one folder; a name as attribute gives a DataFrame, read when it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if (view := f"v_{name}") in VIEWS:
            sql = VIEWS[view]
            used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
            for t in used:
                sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
            return self.spark.sql(sql, **{t: getattr(self, t) for t in used})
        raise AttributeError(name)

    @cached_property
    def vectors(self) -> DataFrame:
        """Article vectors with provenance."""
        return self.spark.sql("SELECT vec_id, embedding, label, CASE WHEN vec_id % 50 = 0 THEN 'other' ELSE 'model-a' END AS embedding_model FROM {e}", e=self.embeddings)
