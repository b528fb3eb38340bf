"""Extraction, sources, resolution, merging, validation, signals, jobs and streams on small fixtures."""

import gzip
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import extract, resolve, signals
from tessera.operators import validate as V
from tessera.operators.schema import CANDIDATE, FIELDS, Request
from tessera.plans import discovery, expansion
from tessera.plans.store import JobStore
from tessera.sources import captured, files
from tessera.streaming import registry

PAGE = """<html><head><title>Lotus Dental | Pune</title><meta name="description" content="Gentle dentistry"><link rel="canonical" href="https://lotus.in/">
<script type="application/ld+json">{"@graph":[{"@type":"WebSite","name":"x"},{"@type":["Dentist"],"name":"Lotus Dental Care","telephone":"+91 98765 43210",
"address":{"streetAddress":"1 MG Road","addressLocality":"Pune"},"sameAs":["https://instagram.com/lotus.dental"]}]}</script><script>var t="</p>"</script></head>
<body><nav><a href="/about">About us</a></nav><h1>Lotus</h1><p>Write <a href="mailto:Hi@Lotus.in?subject=x">us</a> or desk [at] lotus [dot] in, logo@2x.png</p>
<a href="tel:+912012345678">call</a><address>1 MG Road, Pune 411001</address><div class="our-services"><ul><li>Implants<li>Whitening</ul></div>
<a href="/contact">Contact</a><a href="https://www.facebook.com/lotusdental/">f</a><a href="https://facebook.com/sharer">s</a></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    rows = spark.createDataFrame([(1, "https://lotus.in/home", PAGE), (2, "https://x.com", None), (3, "https://x.com", "<p>a<b>unclosed")], "page_id int, url string, html string")
    return extract.parse_pages(rows).withColumn("meta", extract.metadata()).cache()


def test_page_extraction(page):
    r = page.where("page_id = 1").select("meta", extract.emails().alias("e"), extract.phones().alias("p"), extract.socials().alias("s"), extract.business_info(["implants", "x-ray"]).alias("b"), "page").first()
    assert (r.meta.title, r.meta.description, r.meta.canonical) == ("Lotus Dental | Pune", "Gentle dentistry", "https://lotus.in/")
    assert [(e.value, e.source_type) for e in r.e] == [("hi@lotus.in", "mailto"), ("desk@lotus.in", "deobfuscated")]
    assert r.p[0].value == "+912012345678" and r.p[0].source_type == "tel_link"
    assert r.s == {"instagram": "https://instagram.com/lotus.dental", "facebook": "https://www.facebook.com/lotusdental"}
    assert (r.b.name, r.b.services) == ("Lotus Dental Care", ["implants", "Implants", "Whitening"])
    assert r.page.jsonld[0].address == "1 MG Road, Pune" and len(r.page.jsonld) == 1
    assert r.page.address == "1 MG Road, Pune 411001" and 't="' not in r.page.page_text
    assert all(x.page.error is None for x in page.collect())


def test_internal_links(page):
    got = [(r.rank, r.link, r.score) for r in extract.internal_links(page.where("page_id = 1")).orderBy("rank").collect()]
    assert got == [(1, "https://lotus.in/about", 18), (2, "https://lotus.in/contact", 18)]


CARDS = "".join(f'<div class="business-card"><h2>Clinic {c}</h2><span class="address">Road {c}</span><p>98765432{i}0 info{i}@c{c}.in x@practo.com</p><a href="https://c{c}.in">w</a></div>' for i, c in enumerate("ABC"))


def test_directory_cards(spark):
    rows = spark.createDataFrame([(1, "Pune", "https://www.dir.com/l", CARDS), (2, "Pune", "https://dir.com", "<ul><li><a>One Co</a><li><a>Home</a><li><a>Two Co</a></ul>")], "seq int, location string, url string, html string")
    got = captured.from_directories(rows, Request("Dentist", ["Pune"])).orderBy("seq", "name").collect()
    assert [r.name for r in got] == ["Clinic A", "Clinic B", "Clinic C", "One Co", "Two Co"]
    assert [(len(r.phone_numbers), [e.value for e in r.emails], r.website) for r in got[:3]] == [(1, [f"info{i}@c{c.lower()}.in"], f"https://c{c}.in") for i, c in enumerate("ABC")]
    assert got[0].sources == ["directory_card", "directory_extraction"] and got[0].evidence[0].confidence == 0.85


SERP = """<div class="result"><h2><a class="result__a" href="//d.com/l/?uddg=https%3A%2F%2Flotus.in%2Fx%3Futm_a%3D1">Lotus Dental | Pune</a></h2><a class="result__snippet">Best &amp; gentle</a></div>
<div class="result"><h2><a href="https://www.practo.com/pune">Practo</a></h2></div><div class="result"><h2><a href="https://blog.lotus.in/">Again</a></h2></div>"""


def test_sources(spark):
    r = Request("Dentist", ["Pune"], services_offered=["SEO"])
    rows = spark.createDataFrame([(1, "Pune", "seo", "hiring", "q", SERP)], "seq int, location string, service string, intent_type string, query string, html string")
    assert [tuple(x) for x in captured.parse_results(rows).orderBy("pos").select("title", "url", "snippet").collect()][0] == ("Lotus Dental | Pune", "https://lotus.in/x", "Best & gentle")
    own, listed = captured.search_results(rows, r)
    assert [x.domain for x in own.collect()] == ["lotus.in"] and [x.domain for x in listed.collect()] == ["practo.com"]
    assert captured.from_search(rows, r).first().name == "Lotus Dental"
    lite = spark.createDataFrame([(1, "Pune", '<table><tr><td><a class="result-link" href="https://instagram.com/lotus">Lotus (@lotus) • Instagram</a></td></tr><tr><td class="result-snippet">call 212-555-0187 a@b.co</td></tr></table>')], "seq int, location string, html string")
    p = captured.from_profiles(lite, lite.limit(0), r).first()
    assert (p.name, p.social_profiles, p.phone_numbers[0].value, p.emails[0].value) == ("Lotus", {"instagram": "https://www.instagram.com/lotus/"}, "212-555-0187", "a@b.co")
    poi = [{"namedetails": {"name": "Lotus"}, "display_name": "Lotus, Pune", "extratags": {"contact:website": "lotus.in/", "phone": " 020 123 "}}, {"display_name": "Rose, Pune"}, {}]
    got = captured.from_maps(spark.createDataFrame([(1, "Pune", json.dumps(poi))], "seq int, location string, json string"), r).orderBy("name").collect()
    assert [(x.name, x.website, x.domain) for x in got] == [("Lotus", "https://lotus.in/", "lotus.in"), ("Rose", None, None)]
    old = captured.from_archive(spark.createDataFrame([(1, "Pune", json.dumps([["original", "timestamp"], ["http://old.com/a", "2001"], ["bad", "1"]]))], "seq int, location string, json string"), r).collect()
    assert [(x.domain, x.is_historical, x.evidence[0].source_url) for x in old] == [("old.com", True, "https://web.archive.org/web/2001/http://old.com/a")]
    strict = rows.withColumn("html", F.lit('<div class="result__body"><h2 class="result__title"><a href="https://reddit.com/r">Rose Co - help</a></h2><a class="result__snippet">we need help with SEO</a></div>'))
    i = captured.from_intents(strict, r).first()
    assert (i.name, i.intent_confidence, i.intent_evidence.source_type, i.service_requested) == ("Rose Co", "high", "forum", "SEO")
    every = captured.union(captured.from_search(rows, r), captured.from_intents(strict, r))
    assert every.columns == list(FIELDS) and every.select("cand_id").distinct().count() == 2


def test_union_counts_in_order_of_arrival(spark):
    rows = [(s, p, "ab"[p % 2]) for s in (3, 1, 2) for p in (2, 0, 1)] + [(1, 0, "a")] * 2  # the same business several times
    first = captured.as_candidates(spark.createDataFrame(rows, "seq int, pos int, name string"), "search", name=F.col("name"), address=F.concat("seq", F.lit("/"), "pos"))
    second = captured.as_candidates(spark.createDataFrame([("z",), ("y",)], "name string"), "maps", name=F.col("name"))
    got = captured.union(first, second).orderBy("cand_id").collect()
    assert [r.cand_id for r in got] == list(range(len(rows) + 2))
    assert [r.address for r in got[: len(rows)]] == [f"{s}/{p}" for s, p, _ in sorted(rows)] and {r.name for r in got[len(rows) :]} == {"y", "z"}


def test_robots_and_sitemaps(spark):
    text = " User-agent: *\n Disallow: /admin\n Sitemap: https://a.in/s.xml\n sitemap: https://a.in/t.xml\n"
    rows = spark.createDataFrame([("a", text, "https://a.in/admin/x"), ("a", text, "https://a.in/y"), ("b", None, "https://b.in/admin")], "host string, robots_text string, url string")
    assert [r[0] for r in rows.select(captured.allowed("robots_text", "url")).collect()] == [False, True, True]
    assert captured.robots(rows).first().sitemaps == ["https://a.in/s.xml", "https://a.in/t.xml"]
    xml = b'<?xml version="1.0"?><urlset xmlns="http://x"><url><loc> https://a.in/contact </loc></url><url><lastmod>1</lastmod><loc>https://a.in/blog/x</loc></url></urlset>'
    maps = spark.createDataFrame([("a", 1, b"<sitemapindex><sitemap><loc>https://a.in/2.xml</loc></sitemap></sitemapindex>"), ("a", 2, gzip.compress(xml)), ("a", 3, xml)], "site string, place int, content binary")
    urls = captured.sitemap_urls(maps)
    assert [(r.pos, r.url) for r in urls.orderBy("pos").collect()] == [(0, "https://a.in/contact"), (1, "https://a.in/blog/x")]
    assert [(r.url, r.score) for r in extract.best_sitemap_urls(urls, "site").collect()] == [("https://a.in/contact", 10)]


def test_captured_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x")
    files.register(spark)
    assert [r.html for r in spark.read.format("captured").load(str(tmp_path)).collect()] == ["<p>x"]


# ---- candidates ----


PHONE = ["9876543210"]


def cand(i, name=None, domain=None, phones=(), places=("Pune",), **more):
    row = dict.fromkeys(FIELDS) | {"cand_id": i, "name": name, "domain": domain, "website": f"https://{domain}" if domain else None, "locations": list(places), "phone_numbers": [(p, p, "", "") for p in phones], "services": [], "sources": ["search"], "emails": [], "social_profiles": {}, "evidence": [], "service_opportunities": [], "is_historical": False, "is_directory": False, "description": "dental clinic"} | more
    return tuple(row[f] for f in FIELDS)


def frame(spark, rows):
    return spark.createDataFrame(rows, CANDIDATE)


def clustered(spark, rows, mode="live"):
    return {r.cand_id: r.cluster_id for r in resolve.clusters(frame(spark, rows), mode).collect()}


def test_tiers(spark):
    rows = [
        cand(1, "Lotus Dental", "lotus.in"), cand(2, "Other Name", "lotus.in"),
        cand(3, "Rose", None, ["+91 98765 43210"]), cand(4, "Rosa Clinic", None, ["098765-43210"]),
        cand(5, "Tulip", social_profiles={"instagram": "https://www.instagram.com/T/"}), cand(6, "Tulpe", social_profiles={"instagram": "http://instagram.com/t"}),
        cand(7, "Lily Care Pvt Ltd"), cand(8, "Lily Services"), cand(9, "Lily Care", places=["Goa"]),
        cand(10, "Daisy Dental Studio"), cand(11, "Daisy Dental Studios"), cand(12, "Veto", "a.in", ["9000000001"]), cand(13, "Veto", "b.in", ["9000000001"]),
        cand(14, "Lone", None, places=[]),
    ]
    assert clustered(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 10, 12: 12, 13: 13, 14: 14}


@pytest.mark.parametrize("mode", ["live", "batch"])
def test_blocks_equal_one_run_over_everything(spark, mode):
    rng = random.Random(5)
    rows = [cand(i, rng.choice([None, "Alpha Dental", "Alpha Dentals", "Beta Care", "Gamma Clinic", "@gam", "g.in"]), rng.choice([None, None, "a.in", "b.in"]), rng.sample(["9000000001", "9000000002", "9000000003"], rng.choice([0, 0, 1])), rng.choice([[], ["Pune"], ["Goa"]])) for i in range(40)]
    k = resolve.keyed(frame(spark, rows)).orderBy("cand_id").toPandas().astype({"name": object})
    k = k.where(k.map(lambda v: v is not None), None)
    numbers = (resolve._live if mode == "live" else resolve._batch)(k)
    assert clustered(spark, rows, mode) == {int(k.cand_id[i]): int(k.cand_id[n]) for i, n in enumerate(numbers)}


def test_near_pairs_lossless(spark):
    from tessera.functions.plain import similarity

    rng = random.Random(2)
    base = ["northern dental", "blue sky clinic", "abcde", "riverside"]
    names = list({"".join(c for c in rng.choice(base) if rng.random() > 0.06) + rng.choice(["", "x", " a"]) for _ in range(120)})
    rows = spark.createDataFrame(list(enumerate(names)), "cand_id long, name string")
    got = {(r.a, r.b) for r in resolve.near_pairs(rows).collect()}
    low = [n.lower().strip() for n in names]
    want = {(i, j) for j in range(len(low)) for i in range(j) if min(len(names[i]), len(names[j])) >= 5 and max(similarity(low[i], low[j]), similarity(low[j], low[i])) >= 0.88}
    assert {(min(p), max(p)) for p in got} == want and want


def test_merge(spark):
    o = lambda s, c: (s, s, c, [], [], "")
    rows = [
        cand(1, "@lotus", None, ["1234567"], ["Pune"], sources=["a"], services=["SEO "], lead_type="explicit_intent", service_opportunities=[o("s1", "medium")], emails=[("A@x.in", False, "", "")]),
        cand(2, "lotus.in", "lotus.in", ["1234567", "7654321"], ["pune", "Goa"], sources=["b", "a"], services=["seo"], description="a longer description", service_opportunities=[o("s2", "high")], emails=[("a@x.in ", False, "", "")], social_profiles={"instagram": "i1", "facebook": None}),
        cand(3, "Lotus Dental Ltd", "other.in", sources=["c"], social_profiles={"instagram": "i2", "facebook": "f"}, is_historical=True, service_opportunities=[o("s1", "high")]),
    ]
    m = resolve.merge(frame(spark, rows), spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "cand_id long, cluster_id long")).first()
    assert (m.name, m.normalized_name, m.domain, m.description, m.members) == ("Lotus Dental Ltd", "Lotus Dental", "lotus.in", "a longer description", 3)
    assert [p.value for p in m.phone_numbers] == ["1234567", "7654321"] and [e.value for e in m.emails] == ["A@x.in"]
    assert (m.services, m.locations, m.sources, m.social_profiles) == (["SEO"], ["Pune", "Goa"], ["a", "b", "c"], {"instagram": "i1", "facebook": "f"})
    assert m.is_historical and m.lead_type == "explicit_and_opportunity"
    assert [(x.service, x.confidence) for x in m.service_opportunities] == [("s1", "high"), ("s2", "high")]


def test_merge_leaves_single_members_alone(spark):
    mail = ("a@x.in", False, "", "")
    row = cand(7, "Lotus", "lotus.in", PHONE * 2, emails=[mail, mail], service_opportunities=[("s", "s", "low", [], [], "")], services=["x", "x"])
    m = resolve.merge(frame(spark, [row]), spark.createDataFrame([(7, 7)], "cand_id long, cluster_id long")).first()
    assert (m.members, m.cluster_id, m.lead_type, m.services, len(m.emails), len(m.phone_numbers)) == (1, 7, None, ["x", "x"], 2, 2)
    was = frame(spark, [row]).first()
    assert all(m[f] == was[f] for f in FIELDS if f in m)


def test_batch_merge_checks_what_came_out(spark):
    rows = [cand(1, "Lotus Dental", "lotus.in"), cand(2, "Lotus Dental", "lotus.in", PHONE), cand(3, "Rose Casino", "rose.in", PHONE), cand(4, "Lily", "lily.in")]
    got = discovery.merged_batch(frame(spark, rows), REQUEST).collect()
    assert [(r.cluster_id, r.members) for r in got] == [(1, 2)]  # 3 is excluded, 4 has no phone


def test_planned_queries_keep_the_limits(spark):
    r = Request("Dentist", ["Pune", "Goa", "Delhi"], services_offered=["SEO"], queries_per_location=3, max_search_queries=5)
    rows = expansion.planned(spark, r).collect()
    assert max(Counter(x.location for x in rows).values()) <= 3 and 5 <= len(rows) <= 7  # a begun turn ends
    total = {x.query_type: x.total_queries for x in expansion.total_queries(spark, r).collect()}
    assert total["business_discovery"] == len(rows) and total["explicit_intent"] == 24


REQUEST = Request("Dental Clinics", ["Pune"], keywords=["dentist"], must_have=["phone"], exclude=["casino"], services_offered=["SEO", "branding"], target_leads=3)


@pytest.mark.parametrize(
    ("row", "says"),
    [
        (cand(1, "Lotus", "lotus.in", PHONE), None), (cand(1, "Lotus", "x.practo.com", PHONE), "directory/aggregator"), (cand(1, "Lotus", is_directory=True), "source record"),
        (cand(1, "Best dentists in Pune", "a.in"), "listing title"), (cand(1, "Home", "a.in"), "generic page element"), (cand(1, "X", "a.in"), "too short"), (cand(1, None, "a.in"), "no identifiable business name"),
        (cand(1, "Lotus"), "no usable public contact path"), (cand(1, "Lotus", "a.in", description="books"), "Industry keywords"), (cand(1, "Lotus", "a.in", places=[]), "no business-specific location"),
        (cand(1, "Lotus", "a.in", places=["Goa"]), "does not match any requested location"), (cand(1, "Lotus", "a.in"), "'phone' is missing"), (cand(1, "Lotus Casino", "a.in", PHONE), "exclusion keyword: 'casino'"),
        (cand(1, "Lotus", "a.in", PHONE, places=[], address="5 Road, Pune"), None),
    ],
)
def test_validator(spark, row, says):
    got = frame(spark, [row]).select(V.rejection_reason(REQUEST)).first()[0]
    assert (got is None) if says is None else says in got


def test_job(spark, tmp_path):
    rows = [cand(1, "Lotus Dental", "lotus.in", PHONE), cand(2, "Rose Dental", "rose.in", ["9876543211"], ["Goa"]), cand(3, "Lotus D", None, PHONE, sources=["maps"]), cand(4, "Desktop Dental", "desk.in", ["9876543212"]), cand(5, "Iris Dental", "iris.in", ["9876543213"]), cand(6, "Jade Dental", "jade.in", ["9876543214"]), cand(7, "Late Dental", "late.in", ["9876543215"])]
    pages = spark.createDataFrame([("lotus.in", 1, "https://lotus.in", PAGE)], "domain string, place int, url string, html string")
    got = discovery.run(frame(spark, rows), pages, REQUEST)
    ledger = {r.cand_id: (r.outcome, r.reason_code, r.stage) for r in got["ledger"].collect()}
    assert ledger == {1: ("ACCEPTED", None, None), 2: ("REJECTED", "WRONG_LOCATION", "location"), 3: ("DUPLICATE", None, None), 4: ("REJECTED", "NOT_A_BUSINESS", "business_identity"), 5: ("ACCEPTED", None, None), 6: ("ACCEPTED", None, None)}
    c = got["counters"].first()
    assert c.candidates_checked == c.accepted_leads + c.rejected_candidates + c.duplicates + c.candidate_errors == 6
    lead = next(r for r in got["leads"].collect() if r.cand_id == 1)
    assert lead.name == "Lotus Dental Care" and lead.sources == ["search", "maps"] and lead.lead_type == "opportunity"
    assert [e.value for e in lead.emails] == ["hi@lotus.in", "desk@lotus.in"] and lead.social_profiles["facebook"] == "https://www.facebook.com/lotusdental"
    store = JobStore(spark, str(tmp_path / "jobs"))
    assert store.run("j1", frame(spark, rows), None, REQUEST) == "completed"
    assert store.run("j2", frame(spark, rows[1:2]), None, REQUEST) == "completed_partial"
    assert store.run("j3", frame(spark, rows).drop("name"), None, REQUEST) == "failed"
    assert [r.job_id for r in store.list_jobs(2).collect()] == ["j3", "j2"]
    job = store.get_job("j1").first()
    assert (job.status, job.accepted_leads, job.completed_at is not None, job.errors) == ("completed", 3, True, None) and store.get_job("j3").first().errors
    assert {r.company_name for r in store.results("j1").collect()} == {"Lotus Dental", "Iris Dental", "Jade Dental"}
    assert store.of_job("rejections", "j1").count() == 2 and store.of_job("outcomes", "j2").count() == 1 and store.of_job("candidates", "none").count() == 0
    assert store.lead("j1", 1).count() == 1


def test_request_limits():
    for bad in ({"locations": []}, {"target_leads": 0}, {"max_candidates_checked": 50_001}, {"max_runtime_minutes": 0}):
        with pytest.raises(ValueError):
            Request(**({"industry": "x", "locations": ["a"]} | bad))


def test_opportunities(spark, page):
    rows = page.withColumns({"social_profiles": extract.socials(), "name": F.lit("Lotus Dental"), "domain": F.lit("lotus.in")})
    rows = signals.with_signals(rows, ["Pune"]).withColumn("o", signals.opportunities(["SEO", "branding", "nonsense", "website"])).withColumn("s", signals.short_reason(F.col("o")))
    got = {r.page_id: r for r in rows.collect()}
    assert {o.service: o.confidence for o in got[1].o}["website_design"] == "high" and "viewport" in got[1].s_website[0]
    assert got[1].s_social == [] and "No logo image detected on website — missing key brand element" in got[1].s_branding
    assert got[2].s_website == ["No website content accessible"] and [o.service for o in got[2].o] == ["seo"]
    assert got[2].s_social == ["No public social media profiles discovered — no online community presence"]
    assert got[1].s.startswith("Potential opportunities in: ") and [o.confidence for o in got[1].o] == sorted((o.confidence for o in got[1].o), key=["high", "medium"].index)


def test_expansion(spark):
    r = Request("Dentist", ["Pune", " Goa "], keywords=["dentist", "Smile Clinic"], services=["Implants"], lead_objective="new website and SEO", services_offered=["SEO", "logo"])
    rows = expansion.queries(spark, r).collect()
    q = [x.query for x in rows]
    assert len({x.lower() for x in q}) == len(q) and {"Dentist Pune", "best Smile Clinic in Goa", "Smile Clinic Implants Goa", "Dentist in Pune reviews", 'site:linkedin.com/company "Dentist" "Goa"'} <= set(q)
    assert {x.family for x in rows} == set(expansion.FAMILIES)
    picked = expansion.round_robin(expansion.queries(spark, r), 2, 1).collect()
    assert [(x.loc, x.family) for x in sorted(picked, key=lambda x: x.query)] == [(0, "basic"), (0, "service")] or len(picked) == 2
    intents = expansion.intent_queries(spark, r).collect()
    assert len(intents) == 2 * (8 + 8 + 4) and '"looking for" "SEO" "Pune"' in {x.query for x in intents}


def test_stream(spark, tmp_path):
    rows = frame(spark, [cand(1, "A", "a.in"), cand(2, "B", "a.in", sources=["maps"]), cand(3, "C", None, PHONE), cand(4, "D", "d.in")])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = registry.outcomes(stream).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.cand_id: (r.outcome, r.first_id, r.sources) for r in spark.table("seen").collect()}
    assert got == {1: ("NEW", 1, ["search"]), 2: ("DUPLICATE", 1, ["search", "maps"]), 3: ("NEW", 3, ["search"]), 4: ("NEW", 4, ["search"])}


def test_intent_queries_of_many_nations(spark, tmp_path):
    from tessera.plans import catalog

    spark.createDataFrame([(f"NATION {i}",) for i in range(120)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = catalog.QUERIES["explicit_intent_queries"](spark, str(tmp_path))
    assert got.select("location").distinct().count() == 120
