"""Scalar functions against the standard library and worked examples."""

import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tessera.functions import plain
from tessera.functions import text as X


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f("v")).collect()]


def slow_url(url):
    if not url:
        return ""
    url = url.strip()
    p = urllib.parse.urlparse(url if url.startswith(("http://", "https://")) else "https://" + url)
    query = urllib.parse.urlencode([(k, v) for k, v in urllib.parse.parse_qsl(p.query) if not k.startswith("utm_") and k not in ("fbclid", "gclid", "ref", "source")])
    return urllib.parse.urlunparse((p.scheme.lower(), p.netloc.lower(), p.path if p.path == "/" else p.path.rstrip("/"), p.params, query, ""))


def test_urls(spark):
    rng = random.Random(1)
    urls = ["Example.com/a/", "HTTP://x.org", "https://A.B.co.uk:80/p//?utm_x=1&b=2&ref=q#f", "https://x.in/?a=&b=%20c+d&c", "https://x.in/a;p?z=~*", "", "https://x.com/"]
    urls += ["https://h.com/" + "".join(rng.choice("ab/?&=#%20+.;-_~*") for _ in range(rng.randint(0, 18))) for _ in range(300)]

    want = [slow_url(u) for u in urls]
    assert column(spark, urls, X.normalize_url) == want
    assert [plain.normalize_url(u) for u in urls] == want


@pytest.mark.parametrize(
    ("url", "domain"),
    [("https://www.sub.clinic.co.in/x", "clinic.co.in"), ("http://a.b.example.com:8080", "example.com"), ("shop.co.uk", "shop.co.uk"), ("http://localhost:8000/x", "localhost"), ("http://u:p@www.x.org/", "x.org"), ("https://10.0.0.1/a", "10.0.0.1"), ("", "")],
)
def test_domains(spark, url, domain):
    assert column(spark, [url], X.domain) == [domain]
    assert plain.domain(url) == domain


def test_phones_and_emails(spark):
    assert column(spark, ["+91 98765-43210", "098765 43210", "(212) 555-0187", "12345678", "12345", None], X.digits_key) == ["9876543210", "9876543210", "2125550187", "12345678", None, None]
    assert column(spark, ["+1 212 555 0187", "09876543210", "919876543210", "9876543210", "12", None, ""], X.e164) == ["+12125550187", "+919876543210", "+919876543210", "+919876543210", "12", None, None]
    assert column(spark, [" A.b@C.com ", "x@y", None, "a b@c.de"], X.normalize_email) == ["a.b@c.com", None, None, None]
    text = "Write Ana@Shop.in or ben [at] firm [dot] org, not logo@2x.png nor test@x.com; me@example.com. Call +91 98765 43210 or 1234."
    assert column(spark, [text, None], X.emails_in) == [["ana@shop.in", "ben@firm.org"], []]
    assert [len(p) for p in column(spark, [text, None], X.phones_in)] == [1, 0]


def test_names(spark):
    names = ["Acme Dental Pvt Ltd", "Acme Dental Clinic, ", "A&B Co.", "", None, "Ümlaut Care Group LLC -"]
    assert column(spark, names, X.normalize_name) == ["Acme Dental", "Acme Dental Clinic", "A&B .", None, None, "Ümlaut Care Group"]
    assert column(spark, names, X.name_key) == ["acmedental", "acmedental", None, None, None, "mlaut"]


def test_cleaning_and_similarity(spark):
    raw = ["a&amp;b  ﬁne\x07", "", None, " x \n y "]
    assert column(spark, raw, X.clean_text) == [plain.clean_text(r) for r in raw]
    pairs = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("Abc", "abc "), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in pairs.select(X.similarity("a", "b")).collect()] == [0.25, 0.5, 1.0, 0.0, 0.0]


def test_services_and_intents(spark):
    assert column(spark, ["SEO", "Logo Design work", "blogging", "zzz", " Web Design "], X.service_key) == ["seo", "branding", "content_creation", None, "website_design"]
    assert column(spark, ["seo", "odd_thing"], X.display_name) == ["SEO", "Odd Thing"]
    assert column(spark, ["hiring now", "can you suggest", "we are seeking", "requires", "improve it", "x"], X.intent_type) == ["hiring", "recommend", "looking_for", "need", "want_to_improve", "other"]
    rows = spark.createDataFrame([("hiring", "we need help"), ("recommend", "x"), ("need", "nothing")], "k string, t string")
    assert [r[0] for r in rows.select(X.intent_confidence("k", "t")).collect()] == ["high", "medium", "high" if "need" in "nothing" else "low"]
    assert column(spark, ["https://indeed.com/x", "https://www.reddit.com/r", "https://x.com/a", "https://a.org"], X.site_type) == ["job_board", "forum", "social", "public_web"]
    assert column(spark, ["Alpha Dental | Best in town", "Dentist - X", "", "A – b"], lambda v: X.name_from_title(v, "dentist")) == ["Alpha Dental", "Dentist - X", None, "A – b"]
    assert column(spark, ["https://instagram.com/p/xyz", "https://www.instagram.com/Alpha.Dental/?x"], X.profile_handle) == [None, "alpha.dental"]
    assert column(spark, ["Alpha (@alpha) • Instagram photos", "ab"], X.name_from_profile_title) == ["Alpha", None]
    assert column(spark, ["x" * 150, "short "], lambda v: X.intent_reason(F.lit("SEO"), v)) == ["Public intent signal for SEO: " + "x" * 137 + "...", "Public intent signal for SEO: short"]
