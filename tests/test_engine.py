import json
import zipfile

import pytest

from brindle.sources import readers


def test_index_and_describe(engine, sample_csv):
    r = engine.index_local(sample_csv, "people")["result"]
    assert (r["row_count"], r["column_count"], r["coverage"]["walk"]) == (10, 5, "full")
    assert engine.index_local(sample_csv, "people")["result"]["skipped"]
    columns = {c["name"]: c for c in engine.describe_dataset("people", detail="full")["result"]["columns"]}
    assert {c: x["type"] for c, x in columns.items()} == {"id": "integer", "name": "string", "age": "integer", "city": "string", "score": "float"}
    assert (columns["age"]["null_count"], columns["city"]["top_values"][0]) == (1, {"value": "Hollywood", "count": 4})
    d = engine.describe_column("people", "city")["result"]
    assert d["value_distribution"][0]["pct"] == 40.0
    assert engine.validate_index("people")["result"]["status"] == "ok"
    assert len(engine.get_dataset_history("people")["result"]["history"]) == 1
    assert [x["dataset"] for x in engine.list_datasets()["result"]["datasets"]] == ["people"]
    assert engine.get_dataset_health("people")["result"]["grade"] in "AB"
    assert engine.data_health_radar("people")["result"]["omitted_axes"] == ["schema_stability", "runtime_coverage"]
    assert engine.suggest_keys("people")["result"]["keys"][0]["column"] == "id"
    assert engine.delete_dataset("people")["result"]["deleted"]
    assert engine.describe_dataset("people")["error"].startswith("NOT_INDEXED")


def test_queries(engine, sample_csv):
    engine.index_local(sample_csv, "people")
    r = engine.get_rows("people", [{"column": "city", "op": "eq", "value": "Central"}], ["name"], "age", "desc")["result"]
    assert (r["total_matching"], [x[1] for x in r["rows"]]) == (3, ["Ivy", "Eve", "Bob"])
    a = engine.aggregate("people", [{"function": "avg", "column": "age", "alias": "m"}], ["city"], order_by="m", limit=1)["result"]
    assert (a["total_groups"], a["groups"][0]["city"]) == (4, "N Hollywood")
    assert engine.aggregate("people", [{"function": "sum", "column": "zzz"}])["error"].startswith("INVALID_COLUMN")
    assert engine.run_sql("SELECT count(*) AS n FROM rows WHERE city LIKE 'H%'", ["people"])["result"]["rows"] == [[4]]
    assert engine.join_datasets("people", "people", "city", "city", columns_a=["id"], columns_b=["id"])["result"]["total"] == 30
    assert engine.sample_rows("people", 2, "tail")["result"]["rows"][0][1] == 10
    assert [b["n"] for b in engine.get_distribution("people", "city", 2)["result"]["buckets"]] == [4, 3, 3]
    assert engine.search_data("people", "hollywood")["result"]["results"][0]["column"] == "city"
    assert engine.search_data("people", "scor", semantic=True)["result"]["verdict"] == "ok"
    assert engine.search_data("people", "zqzq")["result"]["verdict"] == "absent"
    assert engine.plan_query("people", "any outliers?")["result"]["resolved_intent"] == "anomalies"
    assert engine.tune_weights("set", weights={"name_exact": 5000})["result"]["weights"]["name_exact"] == 1000
    assert "error" in engine.tune_weights("set", weights={"zzz": 1})
    assert engine.get_data_hotspots("people")["result"]["hotspots"]
    assert "correlations" in engine.get_correlations("people", 0.0)["result"]
    assert engine.analyze_perf()["result"]["tools"]
    assert engine.embed_dataset("people")["result"]["embedded"] == 5
    assert engine.embed_dataset("people")["result"]["kept"] == 5
    assert engine.check_embedding_drift()["result"]["status"] == "baseline"
    assert engine.check_embedding_drift()["result"]["status"] == "ok"
    assert engine.get_session_stats()["result"]["errors"] == 2


def test_traffic_tools(engine, tmp_path, sample_csv):
    engine.index_local(sample_csv, "people")
    assert engine.find_unused_columns("people")["error"].startswith("NO_RUNTIME_DATA")
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join(json.dumps({"query": q, "calls": 3}) for q in ("SELECT name FROM people WHERE city = 'a@b.org'", "SELECT x FROM other")))
    r = engine.ingest_sql_log(str(log))["result"]
    assert (r["matched"], r["unresolved"]) == (["people"], ["other"])
    engine.ingest_sql_log(str(log))
    assert {u["column"] for u in engine.find_unused_columns("people")["result"]["unused"]} == {"age", "score"}
    assert engine.check_column_drop_safe("people", "city")["result"]["verdict"] == "runtime_observed"
    assert engine.get_redaction_log("people")["result"]["patterns"][0]["kind"] == "email"
    assert "blast_score" in engine.get_schema_impact("people", "city")["result"]
    assert engine.data_health_radar("people")["result"]["axes"]["runtime_coverage"] == 40.0


def test_several_datasets(engine, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id,email\n" + "".join(f"{i},c{i}@x.org\n" for i in range(1, 21)))
    (tmp_path / "orders.csv").write_text("order_id,customer_id,amount\n" + "".join(f"{i},{i % 20 + 1},{i}.5\n" for i in range(1, 31)))
    engine.index_repo(str(tmp_path), "me", "shop")
    names = [d["dataset"] for d in engine.list_datasets()["result"]["datasets"]]
    assert names == ["me--shop--customers", "me--shop--orders"]
    assert engine.list_repos()["result"]["repos"][0]["repo"] == "me/shop"
    joins = engine.suggest_joins("me--shop--orders")["result"]["joins"]
    assert {(j["column"], j["target"], j["target_column"]) for j in joins} >= {("customer_id", "me--shop--customers", "customer_id")}
    assert engine.get_schema_drift(*names)["result"]["assessment"] == "breaking"
    assert engine.find_similar_columns()["result"]["pairs"][0]["name_score"] == 1.0


def test_formats_agree(spark, tmp_path, sample_csv):
    import pandas as pd

    csv, _ = readers.read(spark, sample_csv)
    want = sorted(map(tuple, csv.collect()), key=str)
    data = [dict(zip(csv.columns, r, strict=True)) for r in csv.collect()]
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(d) for d in data) + "\n[1]\n{broken\n")
    jsonl, facts = readers.read(spark, str(tmp_path / "s.jsonl"))
    assert facts["malformed_rows"] == 2
    assert sorted(map(tuple, jsonl.select(*csv.columns).collect()), key=str) == want
    (tmp_path / "s.tsv").write_text("\n".join("\t".join(x or "" for x in r) for r in [csv.columns, *csv.collect()]))
    assert sorted(map(tuple, readers.read(spark, str(tmp_path / "s.tsv"))[0].collect()), key=str) == want
    pd.DataFrame(data).to_parquet(tmp_path / "s.parquet")
    assert sorted(map(tuple, readers.read(spark, str(tmp_path / "s.parquet"))[0].collect()), key=str) == want


def test_csv_dialects(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("x;y\n1;é\n2;\"a;b\"\n3\n".encode("cp1252"))
    df, _ = readers.read(spark, str(p))
    assert [tuple(r) for r in df.collect()] == [("1", "é"), ("2", "a;b"), ("3", None)]
    with pytest.raises(ValueError, match="UNSUPPORTED_FORMAT"):
        readers.read(spark, str(tmp_path / "a.doc"))


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>day</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" s="1"><v>45325</v></c></row><row><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    df, _ = readers.read(spark, str(tmp_path / "b.xlsx"))
    assert [tuple(r) for r in df.collect()] == [("7", "2024-02-03"), (None, "True")]


def test_header_row(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("note,,\na,b,c\n1,2,3\n")
    df, _ = readers.read(spark, str(p), header_row=1)
    assert df.columns == ["a", "b", "c"]
    assert df.count() == 2


def test_budget(engine, sample_csv):
    engine.index_local(sample_csv, "people")
    engine.budget = 120
    r = engine.get_rows("people", limit=10)
    assert r["_meta"]["truncated"]["rows"]["total"] == 10


def test_stream(engine, spark, tmp_path, sample_csv):
    from brindle.streaming.traffic import ingest_stream

    engine.index_local(sample_csv, "people")
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"query": "SELECT name FROM people", "calls": 2, "total_time": 1.0}))
    log = spark.readStream.schema("query string, calls long, total_time double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ingest_stream(log, engine.catalog, "people", str(tmp_path / "cp")).awaitTermination(120)
    assert engine.catalog.table("people", "traffic").where("column_name = 'name'").first().calls == 4


def test_answers_tell_what_was_masked(engine, tmp_path):
    (tmp_path / "m.csv").write_text("id,note\n1,mail a@b.org and c@d.org\n2,none\n3,x@y.net\n")
    engine.index_local(str(tmp_path / "m.csv"))
    got = engine.get_rows("m", redact_patterns=["(?P<x>a", "no+ne", "(?P<name>z)"])["result"]
    assert got["redactions"]["email"] == 3
    assert got["invalid_redact_patterns"] == [0, 2]  # Java, which runs them, has no such groups
    assert engine.run_sql("SELECT note FROM rows WHERE id = 3", ["m"])["result"]["redactions"] == {"email": 1}


def test_manifest_is_replaced_at_once_and_holds_its_checksum(engine, sample_csv):
    engine.index_local(sample_csv)
    c = engine.catalog
    assert c.validate("sample")["status"] == "ok"
    c.write_text(f"{c.root}/sample/note", "one")
    c.write_text(f"{c.root}/sample/note", "two")
    assert c.read_text(f"{c.root}/sample/note") == "two"
    m = c.manifest("sample")
    m["row_count"] += 1
    import json

    c.write_text(f"{c.root}/sample/manifest.json", json.dumps(m))
    assert c.validate("sample")["status"] == "error"


def test_a_table_and_its_mark_hold_together(engine, spark, sample_csv):
    engine.index_local(sample_csv)
    c = engine.catalog
    assert c.mark("sample", "traffic") is None
    c.put_table("sample", "traffic", spark.range(3), "7")
    c.put_table("sample", "traffic", spark.range(4))
    assert (c.mark("sample", "traffic"), c.table("sample", "traffic").count()) == ("7", 4)
