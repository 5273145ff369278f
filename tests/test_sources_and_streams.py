"""Saved registry responses, delivery of events in order, versions of the history, the evidence table."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from siteloom.operators import enrichment, registry, reports, resolution
from siteloom.sources import responses
from siteloom.streaming import relay


def saved_answers(spark, path, rows):
    answers = [(e, k, s, json.dumps(b) if isinstance(b, (dict, list)) else b) for e, k, s, b in rows]
    responses.write_responses(spark.createDataFrame(answers, "endpoint string, key string, status int, body string"), path, buckets=64)


def test_saved_responses_by_endpoint_and_key(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    rows = [("profile", f"{k:08d}", 200, {"company_name": f"C{k}", "type": "ltd", "sic_codes": ["1", "2"], "extra": k}) for k in range(300)]
    rows += [("officers", "00000001", 200, {"items": [{"name": "A", "officer_role": "director"}, {"name": "B", "officer_role": "secretary", "resigned_on": "2020-01-01"}]})]
    rows += [("officers", "00000002", 429, {"items": [{"name": "X"}]}), ("officers", "00000003", 200, "no json"), ("officers", "00000004", 404, None)]
    rows += [("filing-history", "00000001", 200, {"items": [{"date": f"2020-01-{d:02d}"} for d in range(1, 29)]}), ("psc", "00000001", 401, None)]
    saved_answers(spark, path, rows)
    asked = ["00000001", "00000003", "00000299", "none"]
    few = responses.read_responses(spark, path, "profile", asked)
    assert {(r.key, r.company_name) for r in few.collect()} == {("00000001", "C1"), ("00000003", "C3"), ("00000299", "C299")}
    # folders of other keys are not opened
    files = {os.path.basename(os.path.dirname(f)) for f in responses.read_raw(spark, path, "profile", asked).inputFiles()}
    plan = responses.read_raw(spark, path, "profile", asked)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "In(key" in plan
    buckets = {r[0] for r in spark.createDataFrame([(k,) for k in asked], "k string").select(F.pmod(F.xxhash64("k"), F.lit(64))).collect()}
    assert buckets and files
    table = spark.createDataFrame([(k,) for k in asked * 2], "key string")
    assert responses.read_responses(spark, path, "profile", table).count() == 3
    officers = responses.read_responses(spark, path, "officers")
    assert [(r.key, r.ord, r.name) for r in officers.orderBy("ord").collect()] == [("00000001", 0, "A"), ("00000001", 1, "B")]
    assert responses.unavailable(spark, path, "psc") and responses.unavailable(spark, path, "charges") and not responses.unavailable(spark, path, "officers")
    tables = responses.uk_registry(spark, path, asked)
    row = registry.uk_profiles(*tables).where("company_number = '00000001'").first()
    assert row.company_name == "C1" and row.officers.directors == ["A"] and row.officers.management == [] and len(row.filing_history) == 10
    assert row.psc is None and row.industry == "1, 2"


def test_a_registry_that_never_answers_is_unavailable(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    saved_answers(spark, path, [("profile", "1", 401, None), ("profile", "2", 500, "oops")])
    assert responses.uk_registry(spark, path) is None
    names = ["domain", "company_name", "legal_name", "registration_number", "postal_code", "full_address", "city"]
    companies = spark.createDataFrame([("a", *[None] * 7)], ", ".join(f"{c} string" for c in ["key", *names]))
    found = spark.createDataFrame([("a", "United Kingdom", None)], "key string, country string, state_abbr string")
    assert resolution.resolved_companies(companies, found, None, None).first().registry_status == "unavailable"


def test_events_are_relayed_in_order(spark, tmp_path):
    def event(site, seq, kind, **more):
        return {"site": site, "seq": seq, "type": kind, **more}

    batches = [
        [event("a", 0, "log", msg="start"), event("a", 2, "json", content="r1"), event("b", 1, "log", msg="later", level="WARN")],
        [event("a", 1, "log", msg="é", level="PHASE"), event("a", 2, "json", content="again"), event("b", 0, "log", msg="first"), event("a", 0, "log", msg="start")],
        [event("a", 3, "done"), event("b", 2, "done", content="own"), event(None, 0, "log"), event("c", 5, "log", msg="gap")],
        [event("a", 0, "log", msg="second run")],
    ]
    folder, out = tmp_path / "in", []
    folder.mkdir()
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "site string, seq long, type string, level string, msg string, content string"
        stream = spark.readStream.schema(schema).json(f"file://{folder}")
        sink = relay.relayed(stream).writeStream.format("memory").queryName("relayed").outputMode("append")
        query = sink.option("checkpointLocation", f"file://{tmp_path}/c").start()
        # a stream with timers never runs out of batches, so what has come out says when the next batch can go in
        for k, (rows, n) in enumerate(zip(batches, (1, 5, 9, 10))):
            (folder / f"{k}.tmp").write_text("\n".join(map(json.dumps, rows)))
            (folder / f"{k}.tmp").rename(folder / f"{k}.json")
            until = time.time() + 40
            while len(out) < n and time.time() < until:
                time.sleep(0.5)
                assert query.isActive, query.exception()
                out = [tuple(r) for r in spark.table("relayed").collect()]
            assert len(out) == n
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    frames = lambda site: [(seq, kind, json.loads(f[6:]) if kind != "history" else f) for s, seq, kind, f in out if s == site]
    a = frames("a")
    assert [x[:2] for x in a] == [(0, "log"), (1, "log"), (2, "json"), (3, "done"), (3, "history"), (0, "log")]
    assert a[0][2] == {"type": "log", "level": "INFO", "msg": "start"} and a[1][2]["level"] == "PHASE" and a[1][2]["msg"] == "é"
    assert a[2][2]["content"] == "r1" and a[4][2] == "r1" and a[5][2]["msg"] == "second run"
    assert [(x[0], x[1]) for x in frames("b")] == [(0, "log"), (1, "log"), (2, "done"), (2, "history")] and frames("b")[3][2] == "own"
    assert frames("c") == []


def fifo(listed, arrivals, most):
    for site, entry in arrivals:
        at = next((k for k, (s, _) in enumerate(listed) if s == site), None)
        if at is None:
            listed.insert(0, (site, entry))
            del listed[most:]
        else:
            listed[at] = (site, entry)
    return listed


def test_history_keeps_places_over_three_writes(spark, tmp_path):
    path, expected = f"file://{tmp_path}/h", {"u": [], "v": []}
    writes = [
        [("u", k, f"s{k % 6}", f"e{k}") for k in range(9)] + [("v", 0, "x", "1")],
        [("u", 0, "s2", "new"), ("u", 1, "n1", "a"), ("u", 2, "n2", "b"), ("u", 3, "s0", "back"), ("u", 4, None, "lost")],
        [("v", 1, "y", "2"), ("v", 0, "x", "3"), ("u", 0, "n1", "c")],
    ]
    assert reports.newest_version(spark, path) == 0
    for k, rows in enumerate(writes, 1):
        assert reports.write_history(spark, path, spark.createDataFrame(rows, "owner string, ord int, site string, entry string"), most=5) == k
        for owner in expected:
            came = sorted((o, s, e) for w, o, s, e in rows if w == owner and s)
            expected[owner] = fifo(expected[owner], [(s, e) for _, s, e in came], 5)
        got = {}
        for r in reports.read_history(spark, path).orderBy("owner", "place").collect():
            got.setdefault(r.owner, []).append((r.site, r.entry))
        assert got == {o: x for o, x in expected.items() if x}


def test_evidence_of_twelve_fields(spark):
    kind = "struct<value:string,url:string,category:string,method:string,evidence:string,confidence:decimal(4,2)>"
    rows = spark.sql(f"SELECT 'a' AS site, 'Name that is longer than twenty-eight characters' AS company_name, CAST(NULL AS STRING) AS email, map('company_name', CAST(struct('v', 'u', 'c', 'page_title', 'e', 0.8) AS {kind})) AS evidence")
    got = reports.evidence_table(rows).orderBy("ord").collect()
    assert [r.field for r in got] == reports.EVIDENCE_FIELDS
    assert (got[0].value, float(got[0].confidence), got[0].method) == ("Name that is longer than twe", 0.8, "page_title")
    assert {(r.value, float(r.confidence), r.method) for r in got[1:]} == {("[NULL]", 0.0, "null")}


def test_a_company_asked_for_by_sql_is_one_key_of_each_table(spark, tmp_path):
    for name, columns in (("names", "concat('C', id) AS company_name"), ("people", "id % 3 AS ord, concat('P', id) AS name")):
        spark.range(100).selectExpr("lpad(CAST(id % 50 AS STRING), 8, '0') AS company_number", *columns.split(", ", 0 if name == "names" else 1)).write.parquet(f"file://{tmp_path}/{name}")
        spark.read.parquet(f"file://{tmp_path}/{name}").createOrReplaceTempView(f"test_{name}")
    enrichment.register_company(spark, "test_company", profile="test_names", officers="test_people")
    found = spark.sql("SELECT * FROM test_company('00000007')")
    assert sorted((r.source, json.loads(r.record).get("name") or json.loads(r.record)["company_name"]) for r in found.collect()) == [("officers", "P57"), ("officers", "P7"), ("profile", "C57"), ("profile", "C7")]
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("EqualTo(company_number,00000007)") >= 2
    assert spark.sql("SELECT * FROM test_company('none')").count() == 0


def test_enrichment_by_name_and_by_number(spark):
    address = "struct<address_line_1:string,address_line_2:string,locality:string,region:string,postal_code:string,country:string>"
    search = spark.createDataFrame([("Nordvik Limited", 0, "A1", "NORDVIK LIMITED", "active", (None, None, "Leeds", None, "LS1 4AB", "England"))], f"query string, hit_ord int, company_number string, title string, company_status string, address {address}")
    empty = lambda columns: spark.createDataFrame([], columns)
    profiles = spark.createDataFrame([("A1", "NORDVIK LIMITED", "active", "ltd", None, None, ["1"], None)], f"company_number string, company_name string, company_status string, type string, jurisdiction string, date_of_creation string, sic_codes array<string>, registered_office_address {address}")
    uk = (
        profiles, spark.createDataFrame([("A1", 0, "Ann", "director", None)], "company_number string, ord int, name string, officer_role string, resigned_on string"),
        empty("company_number string, ord int, name string, kind string, natures_of_control array<string>, nationality string, country_of_residence string"),
        empty("company_number string, ord int, date string, type string, description string, category string"), empty("company_number string, ord int, charge string"),
        empty("company_number string, insolvency string"),
    )
    row = enrichment.enriched(spark, search, uk, name="Nordvik Limited", postcode="LS1 4AB", city="Leeds").first()
    assert (row.status, row.legal_name, row.resolution.method) == ("resolved", "NORDVIK LIMITED", "exact_name_verified") and row.normalized.officers.directors == ["Ann"]
    assert len(row.resolution.candidates) == 1
    assert enrichment.enriched(spark, search, uk, number="A1").first().status == "resolved_direct"
    for given, status in (({"number": "B2"}, "not_found"), ({"name": "Other"}, "not_found"), ({}, "skipped")):
        row = enrichment.enriched(spark, search, uk, **given).first()
        assert row.status == status and row.legal_name is None and row.normalized is None
