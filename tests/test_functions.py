"""Unit vectors of the scalar functions; each case is one row of a small frame."""

import pytest
from pyspark.sql import functions as F

from quayside.functions import company, mail, matching, messages, status, urls


def values(spark, cases, *expressions):
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ", ".join(f"c{k} string" for k in range(len(cases[0]))))
    rows = frame.select("i", *[e.alias(f"r{k}") for k, e in enumerate(expressions)]).orderBy("i").collect()
    return [r[1] if len(expressions) == 1 else tuple(r[1:]) for r in rows]


def one(spark, function, inputs):
    return values(spark, [(x,) for x in inputs], function(F.col("c0")))


def test_urls(spark):
    assert one(spark, urls.host_of, ["https://u:p@WWW.Shop.Co.UK:8080/a?b#c", "site.ru/x", "", None]) == ["shop.co.uk", "site.ru", "", ""]
    assert one(spark, urls.root_domain, ["a.b.site.ru", "x.shop.co.uk", "site.ru", "localhost"]) == ["site.ru", "shop.co.uk", "site.ru", "localhost"]
    assert one(spark, urls.url_key, ["http://a/b/#x", "http://a/b"]) == ["http://a/b", "http://a/b"]


def test_company_numbers(spark):
    good = ["7707083893", "7736050003", "500100732259"]
    bad = ["7707083894", "7700783893", "1234567890", "123456789", "12345678901", "abcdefghij", "", None]
    assert one(spark, company.valid_company_id, good + bad) == [True] * 3 + [False] * 8
    assert one(spark, company.digits_only, ["7707 083 893", "7707-083-893", "7707—083—893", None]) == ["7707083893"] * 3 + [""]
    assert one(spark, company.id_kind, ["7707083893", "500100732259", "1"]) == ["organization", "individual", ""]
    assert one(spark, company.valid_registration, ["1027700132195", "1027700132196", "304500116000157", "1"]) == [True, False, True, False]
    texts = ["ИНН/КПП: 7707083893/773601001", "инн 7736050003", "ИНН — 7707 083 893", "каминные 7707083893", "длИННого 7707083893", "ИНН 1234567890", "р/с 7707083893"]
    assert one(spark, company.labelled_ids, texts) == [["7707083893"], ["7736050003"], ["7707083893"], [], [], [], []]
    assert one(spark, company.labelled_registrations, ["ОГРН: 1027700132195", "ОГРНИП № 304500116000157", "огрн 1"]) == [["1027700132195"], ["304500116000157"], []]


def test_company_names(spark):
    assert [sorted(x) for x in one(spark, company.name_words, ['ООО "Кирпичный Двор"', "ИП", None])] == [["двор", "кирпичный"], [], []]
    assert values(spark, [('ООО "БРАЕР"', "Кирпичный завод БРАЕР"), ("ООО Альфа", "Бета")], company.names_match(F.col("c0"), F.col("c1"))) == [True, False]
    assert one(spark, company.comparable, ["кирпич", "kirpich", "щука"]) == ["kirpic", "kirpic", "suka"]
    cases = [("ООО Кирпич", "kirpich.ru"), ("ООО Браер", "www-braer.ru"), ("ООО Другое", "kirpich.ru"), ("ООО Кирпич", "abc.ru")]
    assert values(spark, cases, company.domain_hints_name(F.col("c0"), F.col("c1"))) == [True, False, False, False]
    assert one(spark, company.to_cyrillic, ["shkaf", "kirpich"]) == ["шкаф", "кирпич"]
    assert one(spark, company.activity_role, ["25.11", "46.73", "47.1", "43.2", "62.01", "", None]) == ["manufacturer", "wholesale", "retail", "contractor", "other", "", ""]
    own = company.ownership(F.lit("shop.site.ru"), F.col("c0"), F.split("c1", ","), F.col("c2"), mail.FREE_MAIL_DOMAINS)
    assert values(spark, [("https://www.site.ru/x", "a@b.ru", ""), ("", "a@mail.ru", "A@mail.ru"), ("", "q@site.ru", "z"), ("", "a@mail.ru", "z")], own) == ["site", "email", "domain", "none"]
    assert one(spark, company.evidence_weight, ["ogrn", "domain", "none", "odd", None]) == [120, 60, 0, 0, 0]
    assert one(spark, company.display_name, ['Общество с ограниченной ответственностью "Ромашка"']) == ["ООО Ромашка"]


def test_id_confidence(spark):
    b = lambda c: F.col(c).cast("boolean")
    score, level = company.id_confidence(F.col("c0"), b("c1"), b("c2"), b("c3"))
    cases = [("labeled", "true", "true", "true"), ("labeled", "true", None, "true"), ("text", "true", None, "false"), ("labeled", "false", "true", "true"), ("jsonld", "true", "false", "false")]
    assert values(spark, cases, score, level) == [(100, "high"), (85, "medium"), (40, "low"), (0, "low"), (15, "low")]


def test_addresses(spark):
    raw = [" Info%40Site.ru. ", "mail＠site。ru", "zakaz @ site.ru", "а@site.ru", "x+y@site.ru,"]
    assert one(spark, mail.canonical, raw) == ["info@site.ru", "mail@site.ru", "zakaz@site.ru", "a@site.ru", "x+y@site.ru"]
    assert one(spark, mail.repaired, ["zakaz@company,ru", "a@b,c,ru", "a@b.ru"]) == ["zakaz@company.ru", "a@b,c,ru", "a@b.ru"]
    assert one(spark, mail.split_addresses, ["a@b.ru; c@d.ru, e@f.ru", "a@b,ru"]) == [["a@b.ru", "c@d.ru", "e@f.ru"], ["a@b,ru"]]
    rules = {
        "a@b@c.ru": "at_sign", "@b.ru": "local_length", f"{'a' * 65}@b.ru": "local_length", ".a@b.ru": "local_dots", "a..b@b.ru": "local_dots", "-a@b.ru": "local_hyphen",
        f"{'0af' * 12}@b.ru": "local_hash", "name@b.ru": "local_placeholder", "a@b": "domain_shape", "a@-b.ru": "domain_label", "a@b..ru": "domain_label", "a@b.c1": "domain_zone",
        "logo@2x.png": "file_name", "a@example.com": "domain_placeholder", "a@x.tilda.ws": "vendor_domain", "info@mail1.example.com": None, "sales@firma.ru": None,
    }
    assert one(spark, mail.rejection, list(rules)) == list(rules.values())
    code = "7a" + bytes(b ^ 0x7A for b in b"info@site.ru").hex()
    assert one(spark, mail.decode_protected, [code, "zz", "7a1", ""]) == ["info@site.ru", None, None, None]
    assert one(spark, mail.plain_obfuscation, ["info (at) site (dot) ru", "info[собака]site точка ru", "at home"]) == ["info@site.ru", "info@site.ru", "at home"]
    assert one(spark, lambda c: mail.method_rank(c, {"mailto": 5, "text": 1}), ["mailto", "mailto_repaired", "text_repaired", "odd"]) == [5, 4, 0, 0]
    assert values(spark, [("https://x/kontakty", None), ("/a", "О компании"), ("/a", "b")], mail.is_contact_page(F.col("c0"), F.col("c1"))) == [True, True, False]


def test_address_confidence(spark):
    b = lambda c: F.col(c).cast("boolean")
    score, level = mail.confidence(F.col("c0"), F.col("c1"), F.lit("site.ru"), b("c2"), b("c3"), F.col("c4").cast("int"), b("c5"))
    cases = [
        ("info@site.ru", "mailto", "true", "true", "2", "false"),  # 50+25+15+15+10+10
        ("info@site.ru", "obfuscated", "true", "true", "2", "false"),  # 10+25+15+15+10+10
        ("x@gmail.com", "text", None, "false", "1", "false"),  # 25+3
        ("noreply@site.ru", "mailto", "true", "true", "1", "false"),  # 50+25+15+15-30
        ("a@other.ru", "script", "false", "false", "1", "true"),
        ("info@site.ru", "mailto_repaired", "true", "true", "1", "false"),  # 50-10+25+15+15+10
    ]
    assert values(spark, cases, score, level) == [(100, "high"), (85, "medium"), (28, "low"), (75, "medium"), (0, "low"), (100, "medium")]


def test_matching(spark):
    assert one(spark, matching.normal_text, ["Ёлка  3х2,5\n", "ввг нг 3x1,5", None]) == ["Елка 3x2.5", "ВВГнг 3x1.5", ""]
    got = values(spark, [("кирпич красный", "Кирпич красный купить"), ("кабель ввгнг 3х2,5", "кабель медный"), ("труба стальная длинная", "труба стальная"), ("доска", "кирпич"), ("", "x")], matching.product_match(F.col("c0"), F.col("c1")))
    assert [(r.match, round(r.score, 3)) for r in got] == [("exact_match", 0.9), ("near_match", 0.333), ("acceptable_analog", 0.667), ("unrelated", 0.0), ("unknown", 0.0)]
    assert one(spark, matching.role_of, ["купим кирпич", "цена и доставка", "ничего", "каталог, цена, опт, доставка, заказчик", None]) == ["buyer_request", "seller_offer", "unknown", "seller_offer", "unknown"]
    assert one(spark, matching.phone, ["8 (912) 345-67-89", "+7 912 345 67 89", "нет"]) == ["+79123456789", "+79123456789", "нет"]
    assert one(spark, matching.phones, ["звоните 8 (912) 345-67-89 или +79123456789"]) == [["+79123456789"]]
    assert values(spark, [("кирпич", "купить"), ("купить, кирпич", "купить"), ("a", None)], matching.with_suffix(F.col("c0"), F.col("c1"))) == ["кирпич купить", "купить, кирпич", "a"]
    assert one(spark, matching.number_of, ["1 234,5", "x"]) == [1234.5, None]
    got = values(spark, [("seller_offer", "exact_match", "1"), ("buyer_request", "near_match", "0")], matching.qualification(F.col("c0"), F.col("c1"), F.col("c2").cast("int")))
    assert [(r.status, r.reasons) for r in got] == [("qualified", []), ("unqualified", ["buyer_request", "no_public_seller_contact", "match_below_acceptable_threshold"])]
    assert values(spark, [("email", "false", "true"), ("phone", "true", "false")], matching.contact_confidence(F.col("c0"), F.col("c1").cast("boolean"), F.col("c2").cast("boolean"))) == [0.98, 0.2]
    assert values(spark, [("aaa bbb ccc", "BBB"), ("aaa", "zzz")], matching.snippet(F.col("c0"), F.col("c1"))) == ["aaa bbb ccc", "aaa"]
    cases = [("москва, офис +7 495 111-22-33", "Москва", "+74951112233"), ("москвабад 22 33", "Москва", "+74951112233"), ("22-33 москва", "Москва", "2233"), ("x", None, "1"), ("a.b 1-2", "a.b", "12")]
    assert values(spark, cases, matching.has_region_phone(F.col("c0"), F.col("c1"), F.col("c2"))) == [True, False, False, False, True]
    assert values(spark, [("ABC tel 123", "8"), ("ABC", "0")], matching.label_before(F.col("c0"), F.col("c1").cast("int"), 4)) == ["tel ", ""]
    assert one(spark, matching.is_platform, ["a@flagma.ru", "a@site.ru"]) == [True, False]


def test_messages(spark):
    cases = [("MAILER-DAEMON@x", "", "550 user unknown"), ("a@b", "Undelivered mail", "mailbox full"), ("a@b", "Re: price", "550"), ("postmaster@x", None, None)]
    assert values(spark, cases, messages.bounce_kind(F.col("c0"), F.col("c1"), F.col("c2"))) == ["hard", "soft", None, "soft"]
    bodies = ["Final-Recipient: rfc822; A@b.ru\n<x@y.ru>: said", "<x@y.ru>: host said\n<X@y.ru>: again\n<postmaster@z.ru>:", "nothing"]
    assert one(spark, messages.failed_recipients, bodies) == [["a@b.ru"], ["x@y.ru"], []]
    assert one(spark, messages.plain_subject, ["Re: FW: Цена", " ответ: Re[2]: x", None]) == ["цена", "x", ""]
    assert one(spark, messages.placeholders, ["{{ a }} {{b}} {{a}}", None]) == [["a", "b"], []]
    assert values(spark, [("Dear {{ name }}, {{x}}", "Ann")], messages.personalised(F.col("c0"), {"name": F.col("c1")})) == ["Dear Ann, {{x}}"]
    assert values(spark, [("RE: x",), ("",), ("HELLO WORLD!!!",), ("fine",)], *messages.subject_quality(F.col("c0"))) == [(["misleading_reply_subject_without_thread"], []), (["empty_subject"], []), ([], ["subject_all_caps", "subject_excessive_exclamation"]), ([], [])]
    got = values(spark, [("{{odd}} we saw your catalog",), ("   ",), ("http://a " * 6,)], *messages.body_quality(F.col("c0"), F.lit(True), F.lit(False)))
    assert got == [(["broken_placeholder:odd", "unverified_personalization_claim"], []), (["empty_body"], []), ([], ["too_many_links"])]
    assert values(spark, [("", ""), ("n", ""), ("n", "c")], messages.personalisation_level(F.col("c0"), F.col("c1"), F.lit(False))) == [0, 1, 2]
    codes = [("535", ""), ("x", "Spam found"), ("451", ""), ("550", ""), ("odd", ""), ("", "")]
    assert values(spark, codes, messages.provider_error(F.col("c0"), F.col("c1"), F.lit(False), F.lit(True))) == ["authentication", "provider-spam-policy", "provider-throttling", "recipient-invalid", "odd", "transient"]
    assert one(spark, lambda c: messages.retry_delay(c.cast("int")), ["1", "3", "20"]) == [10, 40, 900]
    assert one(spark, lambda c: messages.cooldown_delay(c.cast("int")), ["0", "2", "9"]) == [300, 1200, 3600]
    assert one(spark, messages.visible_text, ["<p>a&amp;b</p><script>x</script><br>c<!-- n -->", None]) == ["a&b\nc", ""]
    assert one(spark, messages.without_quotes, ["hi\n> old\nbye", "hi\nOn Monday Ann wrote:\n> x\ny", "plain"]) == ["hi\nbye", "hi", "plain"]


def test_status(spark):
    assert values(spark, [("sent", "false"), ("sent", "true"), ("sending", "false"), ("odd", "false")], status.delivery_fact(F.col("c0"), F.col("c1").cast("boolean"))) == ["accepted", "bounced", "queued", "unknown"]
    assert one(spark, lambda c: status.card_label(F.split(c, ",")), ["a,a", "a,b", None]) == ["a", "mixed", "not_sent"]
    assert values(spark, [("true", "x"), ("false", "accepted"), ("false", "x")], status.response_label(F.col("c0").cast("boolean"), F.col("c1"))) == ["answered", "waiting", "none"]
    assert one(spark, status.masked_address, ["ann@site.ru", "x", None]) == ["a***@site.ru", "", ""]
    assert one(spark, lambda c: status.stage_limit(c, F.lit(30)), ["first_10", "next_25", "next_50", "all"]) == [10, 25, 30, 30]
    assert values(spark, [("1", "8"), ("1", "0")], status.percent(F.col("c0").cast("int"), F.col("c1").cast("int"))) == [12.0, 0.0]
    n = [F.col(f"c{i}").cast("double") for i in range(7)]
    cases = [("1", "1", "0", "0", "0", "0", "0"), ("0", "1", "1", "0", "0", "0", "0"), ("0", "0", "0.21", "0", "0", "0", "0"), ("0", "0", "0.2", "0.2", "3", "0", "0"), ("0", "0", "0", "0", "3", "10", "5"), ("0", "0", "0", "0", "0", "10", "5"), ("0", "0", "0", "0", "0", "9", "9")]
    assert values(spark, cases, status.pause_reason(*n)) == ["provider_rejection", "hard_bounce", "permanent_failure_rate", "delivery_unknown_rate", "transient_streak", "transient_ratio", None]


@pytest.mark.parametrize("name", ["company", "mail", "matching", "messages", "status", "urls"])
def test_modules_document_themselves(name):
    assert __import__(f"quayside.functions.{name}", fromlist=["x"]).__doc__
