import re
from types import SimpleNamespace

from quayside.plans.texts import own_text

HEAD = re.compile(r"on .{1,200} wrote:|.{0,200}пишет:|-{2,}\s*original message.*", re.I)


def plain(text):
    kept = []
    for line in (text or "").split("\n"):
        if HEAD.fullmatch(line):
            break
        if not line.startswith(">"):
            kept.append(line)
    own = "\n".join(kept)
    return own.strip() or (text or "").strip()


def test_quoted_turns_stay_without_their_quotes(spark):
    texts = [
        "hi\n> old\nbye", "> a\n> b\nanswer", "first\n> q\n>> deeper\nsecond\n> r", "if a > b: return", "<p>markup</p>", "> all quoted\n> two", "no quotes",
        "thanks\nOn Monday Ann wrote:\n> x\n> y", "Спасибо\nИван пишет:\n> да", "ok\n-- Original Message --\nold", "", None, "x\n\n>\ny", "a -> b\n> c",
    ]
    rows = spark.createDataFrame([(i // 3, i % 3, x) for i, x in enumerate(texts)], "conv_id long, turn int, text string")
    got = {(r.conv_id, r.turn): r.own.strip() for r in own_text(SimpleNamespace(conversations=rows)).collect()}
    assert got == {(i // 3, i % 3): plain(x) for i, x in enumerate(texts)}
