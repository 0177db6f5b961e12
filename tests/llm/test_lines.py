from quayside.llm.lines import dedup


def test_lines_that_many_sites_share(spark):
    rows = [(i, f"own line {i}\n Shared notice \n\nonly three sites" if i < 3 else f"own line {i}\nShared notice\t\n\nrest {i}", f"s{i}") for i in range(10, 22)]
    rows = [(i, t.replace("rest", "only three sites" if i < 13 else "rest"), s) for i, t, s in rows]
    rows += [(1, "Shared notice", "s10"), (1, "Shared notice", "s10"), (50, None, "s1"), (51, "", None), (52, "Shared notice\nShared notice", None), (None, "Shared notice", "s3"), (53, "same site line\n" * 3, "s1")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, h string")
    out = sorted((str(r._row.doc_id), r.kept_text, r.n_lines, r.n_removed) for r in dedup(frame, min_sites=10).collect()) if False else [(r._row.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in dedup(frame, min_sites=10).collect()]
    assert len(out) == len(rows)
    got = {}
    for i, *rest in out:
        got.setdefault(i, []).append(tuple(rest))
    assert got[1] == [("Shared notice", 1, 0)] * 2  # the smallest id keeps it, rows alike are treated alike
    assert got[15] == [("own line 15\n\nrest 15", 4, 1)]
    assert got[50] == [(None, 0, 0)] and got[51] == [("", 1, 0)] and got[52] == [("", 2, 2)] and got[None] == [("", 1, 1)]
    assert got[53] == [("same site line\n" * 3, 4, 0)]
    assert dedup(frame.limit(0)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(100 * n + i, f"line on {n} sites", f"s{i}") for n in (8, 9, 10, 11, 12) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r._row.doc_id // 100: 0 for r in dedup(frame, 10).collect()}
    for r in dedup(frame, 10).collect():
        gone[r._row.doc_id // 100] += r.n_removed
    assert gone == {8: 0, 9: 0, 10: 9, 11: 10, 12: 11}
