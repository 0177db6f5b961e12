"""Duplicate scan and merge against plain loops."""

import json
import random
from datetime import datetime, timedelta

import pytest

from quayside.operators import graphs, identity

SUPPLIERS = "id long, workspace_id long, name string, host string, email string, inn string, global_id long"


def scan_by_loops(suppliers, contacts):
    rows = {r[0]: r for r in suppliers}
    mails = {(rows[i][1], m.strip().lower(), i) for i, m in [(r[0], r[4]) for r in suppliers] + contacts if m and m.strip() and i in rows}
    hosted = lambda r: bool((r[3] or "").strip())
    out = []
    for i, r in rows.items():
        if hosted(r) or not any(x[2] == i for x in mails):
            continue
        if r[6] is not None:
            out.append((i, r[1], "ambiguous", "hostless row already linked to global company", None, None, None, 0, 0))
            continue
        group, grown = {i}, True
        while grown:
            at = {(w, m) for w, m, j in mails if j in group}
            more = {j for w, m, j in mails if (w, m) in at and not hosted(rows[j]) and rows[j][6] is None}
            grown, group = not more <= group, group | more
        at = {(w, m) for w, m, j in mails if j in group}
        hosts = [rows[j] for j in {j for w, m, j in mails if (w, m) in at and hosted(rows[j])}]
        companies = {("g", h[6]) if h[6] is not None else ("s", h[0]) for h in hosts}
        if not hosts:
            out.append((i, r[1], "unresolved", "no exact host contact", None, None, None, 0, 0))
        elif len(companies) > 1:
            out.append((i, r[1], "ambiguous", "email maps to multiple company identities", None, None, None, len(companies), len(hosts)))
        else:
            b = max(hosts, key=lambda h: (h[6] is not None, (h[5] or "").strip().isdigit() and len(h[5].strip()) in (10, 12), bool((h[2] or "").strip()), -h[0]))
            out.append((i, r[1], "candidate", "", b[0], b[3], b[6], 1, len(hosts)))
    return sorted(out, key=str)


def scan(spark, suppliers, contacts):
    found = identity.duplicate_scan(spark.createDataFrame(suppliers, SUPPLIERS), spark.createDataFrame(contacts, "supplier_id long, email string"))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_scan_against_loops(spark):
    rng = random.Random(7)
    some = lambda *x: rng.choice(x)
    suppliers = [(i, some(1, 2), some("", " ", "n"), some("", "", None, f"h{i}.ru"), some(f"E{rng.randrange(25)}@x.com ", f"e{rng.randrange(25)}@x.com", "", None), some("7700000001", "x", None), some(None, None, rng.randrange(6))) for i in range(120)]
    contacts = [(rng.randrange(125), f"e{rng.randrange(25)}@X.com") for _ in range(25)] + [(3, None)]
    got = scan(spark, suppliers, contacts)
    assert got == scan_by_loops(suppliers, contacts)
    assert {r[2] for r in got} == {"candidate", "ambiguous", "unresolved"}


def test_a_bridge_between_two_companies_links_nothing(spark):
    suppliers = [(1, 1, "A", "a.ru", "a@x.com", "", None), (2, 1, "B", "b.ru", "b@x.com", "", None), (3, 1, "", "", "a@x.com", "", None), (4, 1, "", "", "b@x.com", "", None), (5, 1, "", "", "c@x.com", "", None), (6, 2, "", "", "a@x.com", "", None)]
    assert [r[2:5] for r in scan(spark, suppliers, [])] == [("candidate", "", 1), ("candidate", "", 2), ("unresolved", "no exact host contact", None), ("unresolved", "no exact host contact", None)]
    bridged = {r[0]: r[2] for r in scan(spark, suppliers, [(5, "a@x.com"), (5, "B@x.com ")])}
    assert bridged == {3: "ambiguous", 4: "ambiguous", 5: "ambiguous", 6: "unresolved"}
    same = [(i, w, n, h, e, t, 9 if i < 3 else g) for i, w, n, h, e, t, g in suppliers]
    assert {r[0]: r[4] for r in scan(spark, same, [(5, "a@x.com"), (5, "b@x.com")])} == {3: 1, 4: 1, 5: 1, 6: None}


def test_components_and_chains(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (None, 3)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.root for r in graphs.connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: top(x) for x in parent}
    ends = graphs.chain_ends(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (92, 92)], "old long, new long")).collect()
    assert {r.old: r.new for r in ends} == {**{i: 40 for i in range(40)}, 90: 91}
    assert graphs.chain_ends(spark.createDataFrame([], "old long, new long")).count() == 0
    with pytest.raises(ValueError):
        graphs.chain_ends(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (8, 9)], "old long, new long"))


SCHEMAS = {
    "mail_threads": "id long, workspace_id long, request_id long, supplier_id long, last_message_at timestamp",
    "mail_messages": "id long, thread_id long, supplier_id long, status string",
    "request_suppliers": "request_id long, supplier_id long, position_keys_json string, reason string, source string, is_irrelevant int, updated_at timestamp",
    "request_supplier_states": "request_id long, supplier_id long, mail_account_id long, status string, last_message_id long, last_error string, updated_at timestamp",
    "search_result_sources": "request_id long, supplier_id long, position_key string, url string, title string, updated_at timestamp",
    "supplier_evidence": "supplier_id long, field_name string, field_value string, source_type string, source_url string, score int",
    "blacklist_entries": "id long, supplier_id long",
    "mail_send_operation_targets": "id long, operation_id long, supplier_id long, normalized_email string, message_id long, updated_at timestamp",
    "supplier_profiles": "supplier_id long, inn string, kind string, region string, role string, phone string, reason string, source string, covers_json string, site_unavailable int, updated_at timestamp",
    "supplier_inn_sources": "supplier_id long, source_type string, updated_by long, updated_at timestamp",
}


def lists(*texts):
    out = []
    for t in texts:
        try:
            got = json.loads(t or "[]")
        except ValueError:
            got = []
        for x in got if isinstance(got, list) else []:
            if x not in out:
                out.append(x)
    return json.dumps(out, separators=(",", ":"))


def merge_by_loops(tables, ends):
    """One duplicate after the other into its canonical row, as a store would do it."""
    names = {n: [c.split()[0] for c in s.split(", ")] for n, s in SCHEMAS.items()}
    t = {n: [dict(zip(names[n], r)) for r in rows] for n, rows in tables.items()}
    keys = {n: p.key for n, p in identity.POLICIES.items()}
    for old, new in sorted(ends.items()):
        for n, rows in t.items():
            for row in [r for r in rows if r["supplier_id"] == old]:
                key = keys[n]
                there = None
                if key is not None:
                    there = next((r for r in rows if r is not row and all(r[k] == row[k] for k in key) and (n == "mail_send_operation_targets" or r["supplier_id"] == new)), None)
                if there is None:
                    row["supplier_id"] = new
                    continue
                rows.remove(row)
                late = max(there.get("updated_at") or datetime.min, row.get("updated_at") or datetime.min)
                blank = lambda c: (there[c] is None or not there[c].strip()) and row[c] is not None and row[c].strip()
                if n == "mail_threads":
                    for m in t["mail_messages"]:
                        m["thread_id"] = there["id"] if m["thread_id"] == row["id"] else m["thread_id"]
                    there["last_message_at"] = max(there["last_message_at"], row["last_message_at"])
                elif n == "request_suppliers":
                    there |= {"position_keys_json": lists(there["position_keys_json"], row["position_keys_json"]), "is_irrelevant": max(there["is_irrelevant"], row["is_irrelevant"]), "updated_at": late, **{c: row[c] for c in ("reason", "source") if blank(c)}}
                elif n == "request_supplier_states" and row["updated_at"] > there["updated_at"]:
                    there |= {k: v for k, v in row.items() if k not in ("request_id", "supplier_id")}
                elif n == "search_result_sources":
                    there |= {"updated_at": late, **{c: row[c] for c in ("url", "title") if blank(c)}}
                elif n == "mail_send_operation_targets" and there["message_id"] is None and row["message_id"] is not None:
                    there |= {"message_id": row["message_id"], "updated_at": late}
                elif n == "supplier_profiles":
                    there |= {"covers_json": lists(there["covers_json"], row["covers_json"]), "site_unavailable": max(there["site_unavailable"], row["site_unavailable"]), "updated_at": late, **{c: row[c] for c in ("inn", "kind", "region", "role", "phone", "reason", "source") if blank(c)}}
                elif n == "supplier_inn_sources" and there["source_type"] != "manual" and row["source_type"] == "manual":
                    there |= {k: row[k] for k in ("source_type", "updated_by", "updated_at")}
    return {n: sorted(str([r[c] for c in names[n]]) for r in rows) for n, rows in t.items()}


def test_merge_against_loops(spark):
    rng = random.Random(11)
    some = lambda *x: rng.choice(x)
    when = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(40))
    word = lambda: some("", " ", None, f"w{rng.randrange(99)}")
    listed = lambda: some("", None, "no list", '{"a":1}', json.dumps([f"p{rng.randrange(5)}" for _ in range(3)]))
    ids, requests = range(1, 25), range(3)
    pairs = [(2, 1), (3, 2), (4, 3), (7, 6), (8, 6), (11, 10), (15, 14), (16, 15)]
    ends = {2: 1, 3: 1, 4: 1, 7: 6, 8: 6, 11: 10, 15: 14, 16: 14}
    here = [(r, s) for r in requests for s in ids if rng.random() < 0.7]
    tables = {
        "mail_threads": [(1000 + i, 1, r, s, when()) for i, (r, s) in enumerate(here)],
        "request_suppliers": [(r, s, listed(), word(), word(), some(0, 1), when()) for r, s in here],
        "request_supplier_states": [(r, s, some(1, 2), some("sent", "failed"), rng.randrange(99), word(), when()) for r, s in here],
        "search_result_sources": [(r, s, p, word(), word(), when()) for r, s in here for p in "ab" if rng.random() < 0.6],
        "supplier_evidence": [(s, f, v, "page", "", rng.randrange(9)) for s in ids for f in "xy" for v in "12" if rng.random() < 0.5],
        "blacklist_entries": [(i, some(*ids)) for i in range(20)],
        "mail_send_operation_targets": [(i, o, s, f"m{ends.get(s, s)}", some(None, i), when()) for i, (o, s) in enumerate((o, s) for o in range(3) for s in ids if rng.random() < 0.6)],
        "supplier_profiles": [(s, *[word() for _ in range(7)], listed(), some(0, 1), when()) for s in ids if rng.random() < 0.8],
        "supplier_inn_sources": [(s, some("manual", "page", "page"), s, when()) for s in ids if rng.random() < 0.8],
    }
    threads = {(r[2], r[3]): r[0] for r in tables["mail_threads"]}
    tables["mail_messages"] = [(i, threads[k], k[1], some("sent", "failed")) for i, k in enumerate(rng.choices(list(threads), k=80))]
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in tables.items()}
    chained = spark.createDataFrame(pairs, "old long, new long")
    merged = identity.merge_suppliers(frames, chained)
    want = merge_by_loops(tables, ends)
    for name, df in merged.items():
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        assert df.columns == columns
        assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want[name], name
    report = {r.relation: r for r in identity.merge_report(frames, merged, chained, {"mail_messages": ["status"]}).collect()}
    assert all(r.survivors == r.lost == r.altered == 0 for r in report.values())
    assert report["blacklist_entries"].rows_before == report["blacklist_entries"].rows_after and report["mail_threads"].rows_after < report["mail_threads"].rows_before


def test_report_sees_what_a_merge_leaves_behind(spark):
    rows = spark.createDataFrame([(1, 2), (2, 5)], "id long, supplier_id long")
    pairs = spark.createDataFrame([(2, 1)], "old long, new long")
    seen = identity.merge_report({"mail_campaign_targets": rows}, {"mail_campaign_targets": rows.where("id = 1")}, pairs, {"mail_campaign_targets": ["supplier_id"]}).first()
    assert (seen.rows_before, seen.rows_after, seen.survivors, seen.lost, seen.altered) == (2, 1, 1, 2, 1)


def test_pairs_that_may_not_be_merged(spark):
    suppliers = [(1, 1, "A", "a.ru", "a@x.com", "7700000001", None), (2, 1, "", "", "a@x.com", "", None), (3, 1, "", "b.ru", "a@x.com", "", None), (4, 1, "", "", " ", "", None), (5, 2, "", "", "a@x.com", "", None), (6, 1, "", "", "a@x.com", "7700000002", None)]
    pairs = [(2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (2, 2), (9, 1)]
    got = {(r.old, r.new): r.refused for r in identity.judged_pairs(spark.createDataFrame(pairs, "old long, new long"), spark.createDataFrame(suppliers, SUPPLIERS)).collect()}
    alone = "not a row of an address alone"
    assert got == {(2, 1): None, (3, 1): alone, (4, 1): alone, (5, 1): "different workspaces", (6, 1): "different numbers", (2, 2): "merged with itself", (9, 1): "a supplier is not there"}
