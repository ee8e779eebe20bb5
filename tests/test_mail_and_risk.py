import pytest
from pyspark.sql import functions as F

from mailvane.functions import mail as P
from mailvane.functions import risk as R


def parse(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "mail_id int, raw string")
    return sorted(P.parse_mail(df).collect(), key=lambda r: r["mail_id"])


def column(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("r")).first()["r"]


def test_headers_unfold_repeat_and_bad_lines(spark):
    (m,) = parse(
        spark,
        "FROM : Ann <ann@Example.ORG.>\r\nReceived: one\r\n\ttwo  \r\n  three\r\nreceived: four\r\nno colon here\r\n"
        "Subject:  Hello: world \r\nX-Empty:\r\n\r\nBody\r\n\r\nmore",
    )
    assert m["from_header"] == "Ann <ann@Example.ORG.>" and m["sender_domain"] == "example.org"
    assert m["received"] == ["one two three", "four"]
    assert m["headers"]["received"] == ["one two three", "four"] and m["headers"]["x-empty"] == [""]
    assert "no colon here" not in m["headers"]
    assert m["subject"] == "Hello: world" and m["body"] == "Body\n\nmore"
    assert m["reply_to"] == "" and m["reply_to_domain"] == ""


def test_sections(spark):
    only_headers, no_header, no_colon_first, empty, leading_fold = parse(
        spark,
        "Subject: a\nFrom: b@c.d",
        "  just a line  \nmore: text",
        "Hello\nSubject: x\n\nbody",
        "",
        " folded: start\nSubject: s\n\nb",
    )
    assert only_headers["subject"] == "a" and only_headers["body"] == ""
    assert no_header["subject"] == "just a line" and no_header["body"] == "  just a line  \nmore: text"
    assert no_colon_first["subject"] == "Hello" and no_colon_first["body"] == "Hello\nSubject: x\n\nbody"
    assert empty["subject"] == "" and empty["body"] == "" and empty["headers"] == {}
    assert leading_fold["subject"] == "s" and "folded" not in leading_fold["headers"]


@pytest.mark.parametrize(
    "header, address",
    [
        ("John Doe <john@example.com>", "john@example.com"),
        ("<john@example.com>", "john@example.com"),
        (" john@example.com ", "john@example.com"),
        ("\"john@example.com'", "john@example.com"),
        ("A <x> B < y@z.w > tail", "y@z.w"),
        ("<open@example.com", "<open@example.com"),
        ("Nobody", ""),
        ("a@b <>", ""),
        ("", ""),
    ],
)
def test_address(spark, header, address):
    assert column(spark, header, P.mail_address) == address


def test_domain_and_verdicts(spark):
    assert column(spark, "a@b@Sub.Example.com>. ", P.mail_domain) == "sub.example.com"
    assert column(spark, "nobody", P.mail_domain) == ""
    h = "mx; SPF=SoftFail x; dkim=fail;dmarc=pass"
    assert [column(spark, h, lambda c, m=m: P.auth_verdict(c, m)) for m in ("spf", "dkim", "dmarc")] == [
        "softfail", "fail", "pass"
    ]
    assert column(spark, "mx; none", lambda c: P.auth_verdict(c, "spf")) == ""


def test_urls(spark):
    text = (
        "See HTTPS://www.Example.org/a, (http://x.io/b). www.www.tail.com! http://x.io/b again <https://u:p@h.com:8080/?q=1>"
        " https://out.com/?next=https://in.com/x www. http://[::1]:80/"
    )
    urls = column(spark, text, P.extract_urls)
    assert urls == [
        "HTTPS://www.Example.org/a", "https://u:p@h.com:8080/?q=1", "https://out.com/?next=https://in.com/x",
        "https://in.com/x", "http://x.io/b", "http://[::1]:80/", "http://www.Example.org/a", "http://www.www.tail.com",
        "http://www.tail.com",
    ]
    hosts = column(spark, text, lambda c: P.url_domains(P.extract_urls(c)))
    assert hosts[:4] == ["www.example.org", "h.com", "out.com", "in.com"] and "x.io" in hosts


@pytest.mark.parametrize(
    "domain, brand",
    [
        ("paypa1.com", "paypal.com"),
        ("micr0soft-365.com", "microsoft.com"),
        ("g00gle-docs.com", None),
        ("app1e-id.com", None),
        ("paypal.com", None),
        ("zoom.us", None),
        ("", None),
        ("amaz0n.com", "amazon.com"),
    ],
)
def test_typosquat(spark, domain, brand):
    assert column(spark, domain, R.typosquat_of) == brand


def test_similarity_counts_characters_over_bytes(spark):
    sim = lambda a, b: spark.range(1).select(R.domain_similarity(F.lit(a), F.lit(b)).alias("s")).first()["s"]
    assert sim("é", "e") == pytest.approx(0.5)  # one edit, two bytes
    assert sim("", "") == 1.0
    assert sim("abc", "ABC") == 1.0


def analyze(spark, raw):
    df = spark.createDataFrame([(1, raw)], "mail_id int, raw string")
    return R.analyze(P.parse_mail(df)).first()


def test_all_rules_and_cap(spark):
    m = analyze(
        spark,
        "From: a@paypa1.com\nReply-To: b@other.org\nReturn-Path: c@third.org\n"
        "Authentication-Results: mx; spf=softfail; dkim=FAIL; dmarc=fail\nSubject: Urgent\n\n"
        "Act now: verify your password, wire transfer, click here, attached file setup.exe",
    )
    assert m["risk_score"] == 1.0 and m["risk_level"] == "HIGH" and m["subtype"] == "CEO_FRAUD"
    assert m["signals"] == [
        "Reply-To domain 'other.org' differs from sender domain 'paypa1.com'",
        "Return-Path domain 'third.org' differs from sender domain 'paypa1.com'",
        "SPF check: FAIL", "DKIM check: FAIL", "DMARC check: FAIL",
        "Sender domain 'paypa1.com' looks like typosquat of 'paypal.com'",
        "High urgency language (score: 1.00)",
        "Requests credential/personal information",
        "Contains financial/payment request",
        "Contains suspicious link patterns",
        "Malware indicator: contains 'attached file'",
    ]


def test_typosquat_alone_counts_as_link(spark):
    m = analyze(spark, "From: a@paypa1.com\nSubject: hi\n\nnothing else to see in this text today")
    assert m["suspicious_links"] and m["risk_score"] == pytest.approx(0.35, abs=1e-6) and m["subtype"] == "PHISHING"


def test_return_path_mismatch_sets_no_flag(spark):
    m = analyze(spark, "From: a@x.org\nReturn-Path: <b@y.org>\nSubject: hi\n\ntext")
    assert not m["domain_mismatch"] and m["return_path_mismatch"] and m["subtype"] == "GENERIC_ATTACK"
    assert m["risk_level"] == "LOW"


@pytest.mark.parametrize(
    "body, subtype",
    [
        ("send money right away", "CEO_FRAUD"),
        ("your login is needed", "CREDENTIAL_HARVEST"),
        ("see http://x.y", "PHISHING"),
        ("please enable macros", "MALWARE"),
        ("good morning", "GENERIC_ATTACK"),
    ],
)
def test_subtypes_of_text(spark, body, subtype):
    df = spark.createDataFrame([(1, "Hello", body)], "mail_id int, subject string, body string")
    assert R.analyze(df, headers=False).first()["subtype"] == subtype


def test_urgency_density(spark):
    score = lambda t: column(spark, t, R.urgency_score)
    assert score("") == 0.0
    assert score("urgent! " + "word " * 49) == pytest.approx(0.2)
    assert score("\"asap\" act now") == 1.0
    assert score("x" * 5 + " word" * 9 + " final notice") == pytest.approx(10 / 12)


def test_risk_levels(spark):
    level = lambda s: spark.range(1).select(R.risk_level(F.lit(s).cast("float")).alias("l")).first()["l"]
    assert [level(s) for s in (0.0, 0.3, 0.31, 0.6, 0.61)] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH"]
