"""Campaign counters and retry verdicts against plain loops over random companion tables."""

import random
from datetime import datetime, timedelta

import pytest

from quayside.operators.campaigns import campaign_summaries, retry_verdicts

SCHEMAS = {
    "campaigns": "id long, request_id long",
    "targets": "id long, campaign_id long, supplier_id long, job_id long, normalized_email string, status string, exclusion_reason string",
    "jobs": "id long, message_id long, status string",
    "messages": "id long, workspace_id long, request_id long, supplier_id long, mail_account_id long, direction string, from_email string, to_email string, subject string, body_text string, status string, created_at timestamp, sent_at timestamp, resend_of_message_id long",
    "attempts": "id long, job_id long, message_id long, started_at timestamp, ended_at timestamp, outcome string, provider_classification string, irreversible_reached boolean",
    "evidence": "attempt_id long, smtp_stage string, smtp_code int, provider_response_safe string",
    "accounts": "id long, workspace_id long, provider string, status string",
    "suppliers": "id long, external_key string, email string",
    "reconciled": "id long, request_id long, supplier_id long, normalized_recipient string, provider_type string, outcome string, accepted_at timestamp",
    "blacklist": "workspace_id long, external_key string, level string, restored_at timestamp",
    "states": "request_id long, supplier_id long, status string, last_message_id long, last_error string",
    "retries": "workspace_id long, request_id long, normalized_recipient string",
    "asked": "row long, workspace_id long, request_id long, original_job_id long, original_message_id long, original_attempt_id long, target_account_id long",
}


def tables(seed, n):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    when = lambda: start + timedelta(minutes=rng.randrange(10000))
    some = lambda *x: rng.choice(x)
    email = lambda: f"u{rng.randrange(12)}@x.com"
    t = {k: [] for k in SCHEMAS}
    t["campaigns"] = [(i, i % 3) for i in range(4)]
    t["accounts"] = [(1, 1, "alpha", "connected"), (2, 1, "beta", "connected"), (3, 1, "beta", "off"), (4, 2, "alpha", "connected")]
    t["suppliers"] = [(i, f"k{i}", f"U{i}@x.com ") for i in range(1, 10)]
    for i in range(n):
        direction = some("outbound", "outbound", "outbound", "inbound")
        t["messages"].append((i, 1, rng.randrange(3), some(*range(1, 10), None), some(1, 1, 2), direction, some(email(), "MAILER-DAEMON@x.com"), some(email(), email().upper() + " "), some("hi", "Undelivered"), some("", "550 no such user", "mailbox full"), some("sent", "failed", "failed", "queued", "delivery_unknown", "cancelled") if i % 3 else "failed", when(), some(None, when()), some(None, None, None, 5)))
        t["jobs"].append((1000 + i, i, some("sent", "failed", "failed", "queued", "delivery_unknown", "cancelled", "sending") if i % 3 else "failed"))
        for _ in range(rng.randrange(3)):
            k = len(t["attempts"])
            t["attempts"].append((k, 1000 + i, i, when(), some(None, when()), some("accepted", "transient_rejected", "permanent_rejected", "permanent_rejected", "uncertain", "delivery_unknown"), some(None, "Spam block", "policy", "suppression", "other"), some(True, True, False, None)))
            if rng.random() < 0.8:
                t["evidence"].append((k, some("rcpt_to", "post_data", "connect", None), some(550, 553, 450, None), some("safe", "safe", None)))
    for i in range(n):
        t["targets"].append((i, rng.randrange(3), some(*range(1, 10), None), some(1000 + rng.randrange(n), None), some(email(), None), some("eligible", "waiting", "waiting", "excluded", "done"), some(None, "suppressed: list", "other")))
    for i in range(n // 12):
        t["reconciled"].append((i, rng.randrange(3), rng.randrange(1, 10), email(), some("alpha", "gamma"), some("accepted", "accepted", "rejected"), when()))
        t["states"].append((rng.randrange(3), rng.randrange(1, 10), some("failed", "failed", "replied", "sent"), rng.randrange(n), some(None, "Hard bounce", "x")))
    t["states"] = list({r[:2]: r for r in t["states"]}.values())
    t["blacklist"] = [(1, "k3", "host", None), (1, "k4", "host", when()), (1, "email:u7@x.com", "email", None), (2, "k5", "host", None)]
    t["retries"] = [(1, 0, "u1@x.com"), (2, 1, "u2@x.com")]
    for i in range(n):
        m = t["messages"][rng.randrange(n)]
        attempt = some(None, None, rng.randrange(len(t["attempts"])), next((a[0] for a in t["attempts"] if a[2] == m[0]), None))
        t["asked"].append((i, some(1, 1, 1, 2), m[2] if i % 9 else 7, 1000 + m[0], m[0], attempt, some(1, 2, 2, 3, 99)))
    return t


@pytest.fixture(scope="module", params=[1, 2])
def made(spark, request):
    t = tables(request.param, 150)
    names = {k: [c.split()[0] for c in v.split(", ")] for k, v in SCHEMAS.items()}
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in t.items()}, {k: [dict(zip(names[k], r)) for r in v] for k, v in t.items()}


def bounce(m):
    import re

    from quayside.functions import messages as M

    plain = lambda p: re.compile(p.replace("(?iu)", ""), re.IGNORECASE)
    if not plain(M.BOUNCE_SENDER).search(m["from_email"] or "") and not plain(M.BOUNCE_SUBJECT).search(m["subject"] or ""):
        return None
    return "hard" if plain(M.HARD).search((m["subject"] or "") + "\n" + (m["body_text"] or "")) else "soft"


def test_campaign_summaries(made):
    frames, t = made
    got = {r.campaign_id: r for r in campaign_summaries(*[frames[k] for k in ("campaigns", "targets", "jobs", "messages", "attempts", "accounts", "reconciled", "states")]).collect()}
    jobs = {j["id"]: j for j in t["jobs"]}
    providers = {a["id"]: a["provider"] for a in t["accounts"]}
    assert set(got) == {c["id"] for c in t["campaigns"]}
    for c in t["campaigns"]:
        n = dict.fromkeys("planned excluded queued waiting attempted accepted accepted_in_campaign accepted_reconciled failed_transient historical_disputed_transient delivery_unknown suppressed cancelled remaining provider_rejection_count".split(), 0)
        failed, bounced, by = 0, set(), {}
        for x in (x for x in t["targets"] if x["campaign_id"] == c["id"]):
            n["planned"] += 1
            live = x["status"] != "excluded"
            tries = [a for a in t["attempts"] if x["job_id"] is not None and a["job_id"] == x["job_id"]]
            outcomes = {a["outcome"] for a in tries}
            kinds = {(a["provider_classification"] or "").lower() for a in tries}
            job = jobs[x["job_id"]]["status"] if x["job_id"] is not None else ""
            mail = x["normalized_email"] or ""
            events = []
            if x["supplier_id"] is not None:
                for m in t["messages"]:
                    if (m["request_id"], m["supplier_id"], m["direction"]) == (c["request_id"], x["supplier_id"], "outbound"):
                        own = [j for j in t["jobs"] if j["message_id"] == m["id"]]
                        if m["status"] == "sent" or any(j["status"] == "sent" or any(a["job_id"] == j["id"] and a["outcome"] == "accepted" for a in t["attempts"]) for j in own):
                            events.append((m["sent_at"] or m["created_at"], m["id"], providers[m["mail_account_id"]]))
                settled = [r for r in t["reconciled"] if (r["request_id"], r["supplier_id"], r["normalized_recipient"], r["outcome"]) == (c["request_id"], x["supplier_id"], mail, "accepted")]
                events += [(r["accepted_at"], r["id"], r["provider_type"]) for r in settled]
                n["accepted_reconciled"] += live and bool(settled)
                for s in t["states"]:
                    if (s["request_id"], s["supplier_id"], s["status"]) == (c["request_id"], x["supplier_id"], "failed"):
                        last = next((m for m in t["messages"] if m["id"] == s["last_message_id"]), None)
                        if "bounce" in (s["last_error"] or "").lower() or last and bounce(last) == "hard":
                            bounced.add(x["supplier_id"])
            provider = max(events)[2] if events and live else None
            if not live:
                n["excluded"] += 1
                n["suppressed"] += (x["exclusion_reason"] or "").startswith("suppressed")
            else:
                n["attempted"] += bool(tries)
                n["accepted_in_campaign"] += job == "sent"
                n["provider_rejection_count"] += any("spam" in k or "policy" in k for k in kinds)
                n["suppressed"] += bool(kinds & {"suppression", "supplier-suppressed"})
                if provider:
                    n["accepted"] += 1
                    by[provider] = by.get(provider, 0) + 1
                else:
                    n["queued"] += job == "queued"
                    n["waiting"] += job == "queued" and x["status"] == "waiting"
                    n["delivery_unknown"] += job == "delivery_unknown"
                    n["cancelled"] += job == "cancelled"
                    n["failed_transient"] += "transient_rejected" in outcomes and job != "sent"
                    n["historical_disputed_transient"] += job == "queued" and "transient_rejected" in outcomes and "accepted" not in outcomes
                    failed += job == "failed" and "transient_rejected" not in outcomes
            n["remaining"] += not provider and x["status"] in ("eligible", "waiting") and job in ("queued", "sending", "")
        r = got[c["id"]]
        assert {k: r[k] for k in n} == n
        failed = max(failed, len(bounced))
        done = max(n["attempted"], n["accepted"] + failed + n["failed_transient"] + n["delivery_unknown"])
        assert (r.failed_permanent, r.hard_bounces, r.eligible, r.accepted_by_provider) == (failed, len(bounced), n["planned"] - n["excluded"], by)
        for name, part in (("permanent_failure_rate", failed), ("transient_failure_rate", n["failed_transient"]), ("unknown_rate", n["delivery_unknown"]), ("provider_rejection_rate", n["provider_rejection_count"])):
            assert r[name] == (part / done if done else 0.0)
        of = {x["job_id"] for x in t["targets"] if x["campaign_id"] == c["id"] and x["job_id"] is not None}
        series = [a["outcome"] for a in sorted((a for a in t["attempts"] if a["job_id"] in of and a["outcome"] in ("accepted", "transient_rejected", "permanent_rejected", "uncertain")), key=lambda a: (a["ended_at"] or a["started_at"], a["id"]))]
        streak = 0
        while streak < len(series) and series[-1 - streak] == "transient_rejected":
            streak += 1
        assert (r.streak, r.recent, r.transient) == (streak, len(series[-10:]), series[-10:].count("transient_rejected"))


def plain_reasons(q, t):
    norm = lambda x: (x or "").strip().lower()
    jobs, messages = {j["id"]: j for j in t["jobs"]}, {m["id"]: m for m in t["messages"]}
    accounts = {a["id"]: a for a in t["accounts"]}
    evidence = {e["attempt_id"]: e for e in t["evidence"]}
    job, m = jobs.get(q["original_job_id"]), messages.get(q["original_message_id"])
    if not (job and m and job["message_id"] == m["id"] and m["workspace_id"] == q["workspace_id"] and m["request_id"] == q["request_id"] and m["direction"] == "outbound"):
        m = None
    goal = accounts.get(q["target_account_id"])
    goal = goal if goal and goal["workspace_id"] == q["workspace_id"] else None
    out = []
    add = lambda yes, name: out.append(name) if yes else None
    add(m is None, "original_not_found")
    add(goal is None, "target_account_not_found")
    tries = [a for a in t["attempts"] if m and a["job_id"] == job["id"] and a["message_id"] == m["id"]]
    a = next((x for x in tries if x["id"] == q["original_attempt_id"]), None) if q["original_attempt_id"] is not None else max(tries, key=lambda x: x["id"], default=None)
    add(a is None, "original_attempt_missing" if q["original_attempt_id"] is None else "original_attempt_not_found")
    if m:
        add((m["supplier_id"] or 0) <= 0, "supplier_not_found")
        add(accounts[m["mail_account_id"]]["provider"] != "alpha", "original_provider_not_alpha")
        add(job["status"] != "failed" or m["status"] != "failed", "original_not_terminal_failed")
        add(m["resend_of_message_id"] is not None, "original_is_retry")
    if goal:
        add(goal["provider"] != "beta", "target_provider_not_beta")
        add(goal["status"] != "connected", "target_account_not_connected")
        add(m and goal["id"] == m["mail_account_id"], "target_account_is_original")
    if a:
        e = evidence.get(a["id"], {})
        stage, code = e.get("smtp_stage"), e.get("smtp_code")
        names = {"accepted": "original_accepted", "delivery_unknown": "original_delivery_unknown", "permanent_rejected": None}
        add(names.get(a["outcome"], "original_outcome_not_proven_rejection"), names.get(a["outcome"], "original_outcome_not_proven_rejection"))
        add(not stage or code is None or not e.get("provider_response_safe"), "missing_durable_smtp_evidence")
        add(stage not in ("mail_from", "rcpt_to", "data_command", "post_data"), "final_server_response_stage_missing")
        add(code is None or not 500 <= code <= 599, "final_response_not_5xx")
        add(not a["irreversible_reached"], "non_irreversible_evidence")
    add(len(tries) > 1, "original_disputed")
    if m:
        to, since = norm(m["to_email"]), (a["ended_at"] or a["started_at"]) if a else m["created_at"]
        own = [x for x in t["messages"] if x["request_id"] == m["request_id"] and norm(x["to_email"]) == to]
        job_of = lambda x: [j for j in t["jobs"] if j["message_id"] == x["id"]]
        tried = lambda x: [y for j in job_of(x) for y in t["attempts"] if y["job_id"] == j["id"]]
        later = any(y["outcome"] == "accepted" and y["id"] != (a["id"] if a else -1) and (y["ended_at"] or y["started_at"]) > since for x in own for y in tried(x))
        later = later or any(x["id"] != m["id"] and (x["status"] == "sent" or any(j["status"] == "sent" for j in job_of(x))) and (x["sent_at"] or x["created_at"]) > since for x in own)
        add(later, "later_accepted_send")
        add(any(r["request_id"] == m["request_id"] and norm(r["normalized_recipient"]) == to and r["outcome"] == "accepted" for r in t["reconciled"]), "reconciled_accepted")
        add(any(x["status"] == "delivery_unknown" or any(j["status"] == "delivery_unknown" for j in job_of(x)) or any(y["outcome"] == "delivery_unknown" for y in tried(x)) for x in own), "delivery_unknown_history")
        now = ("queued", "sending", "delivery_unknown")
        add(any(x["id"] != m["id"] and (x["status"] in now or any(j["status"] in now for j in job_of(x))) for x in own), "active_delivery_for_recipient")
        suppliers = {s["id"]: s for s in t["suppliers"]}
        key = norm(suppliers[m["supplier_id"]]["external_key"]) if m["supplier_id"] in suppliers else ""
        bars = [b for b in t["blacklist"] if b["workspace_id"] == q["workspace_id"] and b["restored_at"] is None]
        mails = {s["email"].lower() for b in bars for s in t["suppliers"] if s["external_key"] == b["external_key"]}
        add(any(b["external_key"] == key for b in bars if key) or any(b["level"] == "email" and b["external_key"] == "email:" + to for b in bars) or to in mails, "suppressed")
        replied = {s["supplier_id"] for s in t["states"] if s["request_id"] == m["request_id"] and s["status"] in ("replied", "answered")}
        answered = m["supplier_id"] in replied or any(norm(suppliers[s]["email"]) == to for s in replied)
        for x in t["messages"]:
            sender = norm(x["from_email"])
            if x["direction"] == "inbound" and x["request_id"] == m["request_id"] and (m["supplier_id"] is None or x["supplier_id"] == m["supplier_id"]) and sender == to and not sender.startswith(("mailer-daemon@", "postmaster@")) and bounce(x) is None:
                answered = True
        add(answered, "answered")
        add(any(r["workspace_id"] == q["workspace_id"] and r["request_id"] == m["request_id"] and norm(r["normalized_recipient"]) == to for r in t["retries"]), "retry_already_planned")
    return out


def test_retry_verdicts(made):
    frames, t = made
    order = ("asked", "jobs", "messages", "attempts", "evidence", "accounts", "suppliers", "reconciled", "blacklist", "states", "retries")
    got = {r.row: r for r in retry_verdicts(*[frames[k] for k in order], source_provider="alpha", target_provider="beta").collect()}
    assert len(got) == len(t["asked"])
    seen = set()
    for q in t["asked"]:
        want = plain_reasons(q, t)
        assert got[q["row"]].blocked_reasons == want, q
        assert got[q["row"]].eligible == (not want)
        seen |= set(want)
    assert len(seen) >= 22
