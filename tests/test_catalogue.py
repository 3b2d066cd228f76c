"""Sweeps over a landed catalogue: once each, from where the last one ended."""

import datetime as dt

from newswarden.sources import catalogue


def entries(spark, rows):
    made = [(i, m, [("fr", "non"), ("en", f"about {i}")], ([((5.0, "AV:N"),)], None, None)) for i, m in rows]
    metric = "array<struct<cvssData: struct<baseScore: double, vectorString: string>>>"
    return spark.createDataFrame(made, f"id string, lastModified string, descriptions array<struct<lang: string, value: string>>, metrics struct<cvssMetricV31: {metric}, cvssMetricV30: {metric}, cvssMetricV2: {metric}>")


def sweep(spark, landed, out, state, now, **options):
    before = {(r.cve_id, r.modified_at) for r in spark.read.parquet(out).collect()} if list(__import__("pathlib").Path(out).glob("*.parquet")) else set()
    catalogue.modified(spark, landed, now=now, **options).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    rows = [(r.cve_id, r.modified_at) for r in spark.read.parquet(out).collect()]
    assert len(rows) == len(set(rows))
    return {(i, m.strftime("%d %H:%M")) for i, m in set(rows) - before}


def test_two_sweeps_and_a_restart(spark, tmp_path, monkeypatch):
    landed, out, state = (str(tmp_path / x) for x in ("landed", "out", "state"))
    catalogue.land(entries(spark, [("cve-1", "2024-01-01T10:00:00.000"), ("cve-2", "2024-01-02T09:58:00.000"), ("cve-3", "2024-01-02T09:58:01.000"), ("cve-4", "soon"), ("cve-5", None)]), landed)
    first = sweep(spark, landed, out, state, "2024-01-02T10:00:00Z")
    assert first == {("CVE-1", "01 10:00"), ("CVE-2", "02 09:58")}
    # A sweep with nothing new, then entries that came meanwhile: one modified again, one in the buffer of the last sweep.
    assert sweep(spark, landed, out, state, "2024-01-02T10:00:00Z") == set()
    catalogue.land(entries(spark, [("cve-1", "2024-01-03T00:00:00+00:00"), ("cve-6", "2024-01-02T09:59:00.000")]), landed)
    assert sweep(spark, landed, out, state, "2024-01-04T00:00:00Z") == {("CVE-3", "02 09:58"), ("CVE-1", "03 00:00"), ("CVE-6", "02 09:59")}
    rows = spark.read.parquet(out).where("cve_id = 'CVE-6'").collect()
    assert [(r.description, r.cvss, r.vector) for r in rows] == [("about cve-6", 5.0, "AV:N")]


def test_pages_are_ranges_of_bytes(spark, tmp_path, monkeypatch):
    day = tmp_path / "modified_on=2024-01-01"
    day.mkdir()
    lines = [f'{{"id": "cve-{k}", "lastModified": "2024-01-01T00:00:{k % 60:02d}"}}' + " " * (k % 37) for k in range(200)]
    (day / "part-0.json").write_text("\n".join([*lines[:100], "{broken", "", *lines[100:]]))
    (tmp_path / "modified_on=2024-02-01").mkdir()
    (tmp_path / "modified_on=2024-02-01" / "part-0.json").write_text("{}")
    for size in (64, 1000, 1 << 20):
        monkeypatch.setattr(catalogue, "PAGE", size)
        reader = catalogue.EntriesReader({"path": str(tmp_path), "now": "2024-01-05T00:00:00"})
        pages = reader.partitions(reader.initialOffset(), reader.latestOffset())
        found = [e for p in pages for b in reader.read(p) for e in b.column("entry").to_pylist()]
        assert found == lines and {p.path.rsplit("/", 2)[1] for p in pages} == {"modified_on=2024-01-01"}
    assert reader.latestOffset() == {"modified": "2024-01-04T23:58:00.000000"} and dt.datetime.fromisoformat(catalogue._moment("2024-01-01T05:00:00+05:00")).hour == 0


def test_nothing_landed(spark, tmp_path):
    assert sweep(spark, str(tmp_path / "none"), str(tmp_path / "out"), str(tmp_path / "state"), "2024-01-02T10:00:00Z") == set()
