import json

from pyspark.sql import functions as F

from quayside.sources import readers, sinks


def test_line_list_and_positions(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# head\nкирпич # red\n\n  доска \n")
    assert sorted(r.value for r in readers.line_list(spark, str(tmp_path / "w.txt")).collect()) == ["доска", "кирпич"]
    item = {"product": "brick", "quantity": "3", "region": "X"}
    for name, body in (("a", [item, {"product": "plank"}]), ("b", {"positions": [item]}), ("c", item)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    got = [sorted((r.ordinal, r.product) for r in readers.positions(spark, str(tmp_path / f"{n}.json")).collect()) for n in "abc"]
    assert got == [[(0, "brick"), (1, "plank")], [(0, "brick")], [(0, "brick")]]


def test_separated_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("﻿n;url\n2;https://www.b.ru/x\n1;http://a.ru\n3;https://b.ru/y\n4;\n", encoding="utf-8")
    rows = readers.separated(spark, str(tmp_path / "in.csv"))
    assert rows.columns == ["n", "url"]
    hosts = readers.hosts_of_results(rows, "url", "n")
    assert sorted((r.first, r.host) for r in hosts.collect()) == [("1", "a.ru"), ("2", "b.ru")]
    sinks.write_separated(rows, str(tmp_path / "out"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "out")).count() == 4
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4


def test_search_page(spark):
    xml = """<r><found>2</found><results><grouping><group><doc><url>https://www.a.ru/1</url><title> One </title><passages><passage>p1</passage><passage>p2</passage></passages></doc></group>
    <group><doc><url>http://m.b.co.uk/2</url><title>Two</title><extendedpassage>long</extendedpassage></doc></group><group><doc><title>no url</title></doc></group></grouping></results></r>"""
    got = readers.search_page(spark.createDataFrame([("k", xml)], "k string, x string"), "x", "k").collect()
    assert [(r.position, r.host, r.root_domain, r.title, r.snippet) for r in got] == [(1, "a.ru", "a.ru", "One", "p1 p2"), (2, "m.b.co.uk", "b.co.uk", "Two", "long")]


def test_messages_and_cursor(spark):
    raw = "From: Ann <Ann@Site.ru>\r\nTo: b@c.ru\r\nSubject: =?utf-8?b?0KbQtdC90LA=?=\r\nMessage-ID: <1@x>\r\nReferences: <a>\r\n <b>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nпривет\r\n".encode()
    got = readers.messages(spark.createDataFrame([(raw,), (None,), (b"\xff\xfe",)], "content binary")).collect()
    assert (got[0].from_email, got[0].subject, got[0].references_header, got[0].body_text.strip()) == ("ann@site.ru", "Цена", "<a> <b>", "привет")
    assert len(got) == 3
    m = spark.createDataFrame([(1, 7, 5), (1, 7, 9), (2, 1, 1), (3, 8, 1)], "account_id int, uidvalidity int, uid int")
    c = spark.createDataFrame([(1, 7, 5), (3, 7, 100)], "account_id int, uidvalidity int, last_uid int")
    assert sorted((r.account_id, r.uid) for r in readers.newer_than_cursor(m, c).collect()) == [(1, 9), (2, 1), (3, 1)]


def test_registry_finances_and_catalogue(spark):
    frame = spark.sql("select named_struct('mass_address', true, 'disqualified', false, 'bankruptcy', true, 'unreliable', null, 'sanctions', false, 'status', 'Active') r, map('2021', named_struct('revenue', 5L, 'profit', 1L), '2020', named_struct('revenue', cast(null as bigint), 'profit', cast(null as bigint)), '2019', named_struct('revenue', 2L, 'profit', cast(null as bigint))) h")
    risks, active = readers.registry_record(F.col("r"))
    row = frame.select(risks.alias("risks"), active.alias("active"), readers.finance_years(F.col("h")).alias("years")).first()
    assert row.risks == ["mass_address", "bankruptcy"] and row.active and [y.year for y in row.years] == [2019, 2021]
    fixture = spark.read.json(spark.sparkContext.parallelize([json.dumps({"suppliers": [{"host": "a", "name": "A", "email": "e", "covers": ["k1", "k2"]}, {"host": "b", "name": "B", "email": "f", "covers": []}], "positions": [{"key": "k1"}]})]))
    tables = readers.catalogue(fixture)
    assert tables["suppliers"].count() == 2 and tables["positions"].count() == 1
    assert sorted(tuple(r) for r in tables["covers"].collect() if r.position_key) == [("a", "k1"), ("a", "k2")]


def test_reports_and_keyed_store(spark, tmp_path):
    hits = spark.createDataFrame([("h", "a@h", 90, "high"), ("h", "b@h", 95, "high"), ("h", "c@h", 10, "low")], "host string, email string, score int, confidence string")
    assert tuple(sinks.site_report(hits).first()) == ("h", "b@h, a@h", "", "c@h")
    sites = hits.groupBy("host").agg(F.collect_list(F.struct("email", "score")).alias("hits"))
    assert sinks.address_report(sites).count() == 3
    offers = spark.createDataFrame([("s", "qualified"), ("s", "qualified"), ("t", "unqualified")], "seller string, status string")
    assert tuple(sinks.run_report(offers).first()) == (3, 2, 1)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v int, t int")
    sinks.save_keyed(spark, rows((1, 1, 1), (2, 1, 1)), str(tmp_path / "s"), ["k"], ["t"])
    out = sinks.save_keyed(spark, rows((1, 9, 2), (2, 9, 0), (3, 9, 0)), str(tmp_path / "s"), ["k"], ["t"])
    assert sorted(tuple(r) for r in out.select("k", "v", "t").collect()) == [(1, 9, 2), (2, 1, 1), (3, 9, 0)]
