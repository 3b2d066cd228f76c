"""Readers, seams and guards on small files."""

import json

import pytest
from pyspark.sql import functions as F

from newswarden.functions import seams
from newswarden.operators import readmodels
from newswarden.sources import readers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_feed(spark, tmp_path):
    item = {"source_name": "s", "url": "u", "title": "  a \n b ", "rss_summary": None, "rss_categories": [" x", "x", ""], "published_at": "no date"}
    r = readers.feed(spark, put(tmp_path / "f.json", json.dumps(item))).first()
    assert (r.title, r.rss_categories, r.published_at) == ("a b", ["x"], None)


def test_dataset_and_inventory_reject_repeats(spark, tmp_path):
    line = json.dumps({"url": "u", "title": "t"})
    assert readers.dataset(spark, put(tmp_path / "a.jsonl", line + "\n\n" + line.replace('"u"', '"v"'))).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        readers.dataset(spark, put(tmp_path / "b.jsonl", line + "\n" + line)).collect()
    with pytest.raises(Exception, match="repeated id"):
        readers.inventory(spark, put(tmp_path / "c.json", json.dumps([{"id": "1"}, {"id": "1"}]))).collect()


def test_catalogues(spark, tmp_path):
    cve = {"id": "cve-2024-1", "descriptions": [{"lang": "fr", "value": "f"}, {"lang": "en", "value": "e"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.0}}], "cvssMetricV2": [{"cvssData": {"baseScore": 5.0, "vectorString": "v"}}]}}
    r = readers.vulnerabilities(spark, put(tmp_path / "n.json", json.dumps({"vulnerabilities": [{"cve": cve}]}))).first()
    assert (r.cve_id, r.description, r.cvss, r.vector) == ("CVE-2024-1", "e", 5.0, "v")
    k = readers.exploited(spark, put(tmp_path / "k.json", json.dumps({"vulnerabilities": [{"cveID": "cve-1", "dateAdded": "2024-01-02"}]}))).first()
    assert k.cve_id == "CVE-1" and str(k.added_on) == "2024-01-02"
    e = readers.probabilities(spark, put(tmp_path / "e.json", json.dumps({"data": [{"cve": "a", "epss": "0.5", "percentile": "NaN"}, {"cve": "b", "epss": "x", "percentile": "1"}]}))).orderBy("cve_id").collect()
    assert [(r.epss, r.percentile, r.status) for r in e] == [(0.5, None, "ok"), (None, 1.0, "no_score")]


def test_keys_that_are_missing_fail(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.id for r in readmodels.by_keys(df, "id", [2, 1]).collect()] == [2, 1]
    with pytest.raises(Exception, match="no row for key"):
        readmodels.by_keys(df, "id", [3]).collect()


def test_seams(spark):
    df = spark.createDataFrame([("a b",), (None,), ("b a",)], "t string")
    v = seams.embedded(df, "t").collect()
    assert len(v[0].embedding) == 64 and v[0].embedding == v[2].embedding
    r = spark.createDataFrame([('<think>hm</think>```json\n{"a": 1}\n```',), ("nonsense",)], "r string").select(seams.parsed_reply(F.col("r"), "a int").alias("x")).collect()
    assert [x.x.a if x.x else None for x in r] == [1, None]


def test_stage_counters(spark):
    from newswarden.operators.monitoring import counted

    df, seen = counted(spark.range(10), "stage", even=F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}
