"""Contact choice and preflight: each decision and reason, and a plain version over random cards."""

import random

import pytest

from quayside.operators import contacts

ASKED = "row long, workspace_id long, request_id long, supplier_id long, email string, host string"
CARDS = "card_id long, request_id long, name string, host string, response_status string"
LISTED = "card_id long, place long, supplier_id long, email string, host string, delivery_status string, response_status string"
PEOPLE = "id long, workspace_id long, email string, inn string, global_id long"


def choose(spark, asked, cards, members, listed, people, contacted=(), repeat=False):
    df = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    found = contacts.choose_contacts(df(asked, ASKED), df(cards, CARDS), df(members, "card_id long, supplier_id long"), df(listed, LISTED), contacts.identity_groups(df(people, PEOPLE)), df(contacted, "workspace_id long, request_id long, email string"), repeat)
    return {r.row: r for r in found.collect()}


def one_by_one(asked, cards, members, listed, people, contacted, repeat):
    """Each row by itself, over lists in their order."""
    out = {}
    for row, ws, request, supplier, raw, host in asked:
        email = (raw or "").strip().lower()
        groups = {("g", g) if g is not None and len(inn or "") in (10, 12) else ("s", i) for i, w, m, inn, g in people if w == ws and (m or "").strip().lower() == email != ""}
        ambiguous = supplier is None and len(groups) > 1
        mine = sorted(c for c in cards if c[1] == request)
        own = lambda c: [x for x in sorted(listed, key=lambda x: x[1]) if x[0] == c[0] and (x[3] or "").strip()]
        card = None
        if supplier is not None:
            card = next((c for c in mine if (c[0], supplier) in members), None)
        else:
            fits = [c for c in mine if email in {x[3].strip().lower() for x in own(c)}]
            card = fits[0] if len(fits) == 1 else None
        seen, state_of = [], {}
        for x in own(card) if card else []:
            mail = x[3].strip().lower()
            if mail not in state_of:
                state_of[mail] = "answered" if x[6] == "answered" else x[5] or "not_sent"
                seen.append((x[2], mail))
        if email not in state_of:
            state_of[email] = "not_sent"
            seen.insert(0, (supplier, email))
        answered = bool(card and card[4] == "answered") or "answered" in state_of.values()
        chosen, decision = None, "skipped"
        asked_for = next(x for x in seen if x[1] == email)
        unused = [x for x in seen if state_of[x[1]] == "not_sent"]
        if not ambiguous and repeat:
            chosen, decision = asked_for, "explicit_repeat"
        elif not ambiguous and not answered and unused:
            chosen = asked_for if state_of[email] == "not_sent" else unused[0]
            decision = "primary" if chosen[1] == email else "alternate"
        reasons = []
        if ambiguous:
            reasons = ["ambiguous_supplier_identity"]
        elif chosen is None:
            reasons = ["already_contacted"] + ["same_request_already_contacted"] * ((ws, request, email) in contacted)
            reasons += ["answered"] if answered else [state_of[email]] if state_of[email] in contacts.NAMED_STATES else []
        out[row] = (decision, chosen, "answered" if answered else state_of[email], reasons, len(groups) > 1, card[2] if card else "")
    return out


@pytest.mark.parametrize("repeat", [False, True])
def test_against_one_by_one(spark, repeat):
    rng = random.Random(5)
    some = lambda *x: rng.choice(x)
    mail = lambda: some(f"a{rng.randrange(30)}@x.com", f" A{rng.randrange(30)}@x.com")
    cards = [(i, i % 3, f"card {i}", some("", "h.ru"), "answered" if i % 7 == 0 else "none") for i in range(24)]
    members = [(rng.randrange(24), s) for s in range(60)] + [(rng.randrange(24), rng.randrange(60)) for _ in range(20)]
    listed = [(c, i, s, some(mail(), mail(), "", None), some("", "p.ru", None), some("not_sent", "", None, "queued", "accepted", "failed", "bounced"), some(*["none"] * 20, "answered", None)) for i, (c, s) in enumerate(members)]
    people = [(s, some(1, 1, 2), mail(), some("7700000001", "", None), some(None, 1, 2)) for s in range(60)]
    asked = [(i, 1, some(0, 1, 2, 9), some(None, *range(60)), mail(), some("", "asked.ru", None)) for i in range(200)]
    # half of the rows ask for an address that is on their supplier's card
    for i in range(0, 200, 2):
        c, _, s, m, *_ = rng.choice([x for x in listed if x[3]])
        asked[i] = (i, 1, c % 3, some(s, s, None), m, "")
    contacted = {(1, rng.randrange(3), f"a{rng.randrange(30)}@x.com") for _ in range(20)}
    got = choose(spark, asked, cards, members, listed, people, contacted, repeat)
    want = one_by_one(asked, cards, set(members), listed, people, contacted, repeat)
    for row, (decision, chosen, state, reasons, shared, name) in want.items():
        r = got[row]
        assert (r.decision, (r.supplier_id, r.email) if r.email else None, r.contact_state, r.reasons, r.shared_email, r.company_name) == (decision, chosen, state, reasons, shared, name), row
    assert {r.decision for r in got.values()} == ({"explicit_repeat", "skipped"} if repeat else {"primary", "alternate", "skipped"})


def test_an_answer_on_the_card_stops_every_contact(spark):
    listed = [(1, 1, 10, "a@x.com", "", "not_sent", "none"), (1, 2, 11, "b@x.com", "", "accepted", "none")]
    got = choose(spark, [(1, 1, 5, 10, "a@x.com", "")], [(1, 5, "A", "", "answered")], [(1, 10), (1, 11)], listed, [])
    assert (got[1].decision, got[1].contact_state, got[1].reasons) == ("skipped", "answered", ["already_contacted", "answered"])


def preflight(spark, rows, campaigns, **options):
    """rows: campaign, decision, reasons, email, context, shared."""
    asked = spark.createDataFrame([(i, c, m, ctx) for i, (c, _, _, m, ctx, _) in enumerate(rows)], "row long, campaign_id long, email string, has_context boolean")
    kind = "row long, workspace_id long, request_id long, requested_email string, requested_supplier_id long, supplier_id long, email string, host string, selected_supplier_id long, contact_state string, decision string, alternate_selected boolean, shared_email boolean, ambiguous_identity boolean, reasons array<string>, company_name string, identity_group string"
    made = [(i, 1, 1, m.lower(), i, i, None if d == "skipped" else m.lower(), "", i, "not_sent", d, d == "alternate", sh, False, rs, "", None) for i, (_, d, rs, m, _, sh) in enumerate(rows)]
    fact = lambda x, k: spark.createDataFrame(x, k)
    found = contacts.checked_recipients(asked, spark.createDataFrame(made, kind), fact([(1, "s@x.com")], "workspace_id long, recipient string"), fact([(1, 1)], "request_id long, supplier_id long"), fact([(1, 2)], "request_id long, supplier_id long"), options.pop("repeat", False))
    table = fact(campaigns, "campaign_id long, provider string, request_found boolean, content_blocks array<string>, content_warnings array<string>")
    return {r.row: r for r in found.collect()}, {r.campaign_id: r for r in contacts.campaign_preflight(table, found, **options).collect()}


def test_preflight_names_every_stop(spark):
    rows = [(1, "primary", [], "s@x.com", True, False), (1, "primary", [], "b@x.com", False, True), (1, "primary", [], "c@x.com", True, False), (1, "skipped", ["already_contacted", "same_request_already_contacted", "queued"], "d@x.com", True, False),
            (1, "primary", [], "no address", True, False), (1, "primary", [], "e@x.com", True, False), (1, "primary", [], "E@x.com ".strip(), True, False), (1, "skipped", ["ambiguous_supplier_identity"], "f@x.com", True, True), (2, "alternate", [], "g@x.com", True, False)]
    one, whole = preflight(spark, rows, [(1, "mail", True, ["empty_body"], []), (2, "mail", True, None, None), (3, None, True, [], []), (4, "mail", False, [], []), (5, "mail", True, [], [])])
    assert [one[i].reasons for i in range(8)] == [["suppressed"], ["hard_bounce"], ["unresolved_safety_state"], ["already_contacted", "same_request_already_contacted", "queued"], ["invalid_email"], ["duplicate"], ["duplicate"], ["ambiguous_supplier_identity"]]
    assert whole[1].blocks == ["empty_body", "invalid_email", "duplicate_recipient", "ambiguous_supplier_identity", "same_request_already_contacted", "duplicate", "suppressed", "hard_bounce", "unresolved_safety_state"]
    assert whole[1].warnings == ["missing_supplier_context", "shared_email_across_companies", "some_recipients_skipped"]
    assert (whole[1].status, whole[1].planned, whole[1].excluded, whole[1].errors) == ("BLOCK", 8, 8, 1)
    assert (whole[2].status, whole[2].eligible, whole[2].alternate_selected) == ("PASS", 1, 1)
    assert [whole[i].blocks for i in (3, 4, 5)] == [["provider_or_account_unavailable"], ["request_not_found"], ["campaign_size_out_of_range"]]


def test_preflight_warns_of_size_domain_and_provider(spark):
    rows = [(1, "primary", [], f"u{i}@{'x' if i < 30 else f'y{i}'}.com", True, False) for i in range(10, 70)] + [(2, "skipped", ["already_contacted"], "z@z.com", True, False)]
    _, whole = preflight(spark, rows, [(1, "Yandex", True, [], ["large_body"]), (2, "mail", True, [], [])], max_per_day=20, same_domain=0.3)
    assert whole[1].warnings == ["campaign_exceeds_daily_budget", "large_body", "many_recipients_same_domain", "large_campaign_review", "provider_policy_warning"]
    assert whole[1].blocks == ["hard_bounce", "unresolved_safety_state"]  # rows 1 and 2 of the facts
    assert (whole[2].blocks, whole[2].status) == (["no_eligible_recipients"], "BLOCK")


def test_repeat_lets_an_uncertain_delivery_through_with_a_warning(spark):
    rows = [(1, "primary", [], f"{c}@x.com", True, False) for c in "abc"]
    one, whole = preflight(spark, rows, [(1, "mail", True, [], [])], repeat=True)
    assert one[2].reasons == [] and one[2].warnings == ["manual_resend_after_delivery_unknown"] and "unresolved_safety_state" not in whole[1].blocks
