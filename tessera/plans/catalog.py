"""Named queries over the driver's tables, and the same in DuckDB's SQL where SQL can say it.

The tables hold no businesses, so candidates are derived: suppliers and customers with names, sites, phones and places
made from their keys by rules that both engines can follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as X
from tessera.operators import extract, resolve, signals
from tessera.operators import validate as V
from tessera.operators.schema import FIELDS, Request
from tessera.plans import discovery, expansion, store
from tessera.sources import captured
from tessera.streaming import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
REQUEST = Request("Automobile", ["Nation_1", "Nation_4", "Nation_8"], keywords=["machinery"], services=["repair"], services_offered=["SEO", "Website Design", "branding"], must_have=["phone"], exclude=["bc4ca"], target_leads=60, max_candidates_checked=900)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(text: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w))) > 0"


# ---- pages: URLs and domains ----

_U = """u as (select page_id, url, case when url like 'http://%' or url like 'https://%' then url else 'https://' || url end a from pages),
p as (select page_id, url, lower(regexp_extract(a, '^([^:/?#]+)://', 1)) scheme, lower(regexp_extract(a, '^[^:/?#]+://([^/?#]*)', 1)) host,
 regexp_extract(a, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) path, regexp_extract(a, '\\?([^#]*)', 1) q from u),
n as (select page_id, url, host, scheme || '://' || host || case when path = '/' then path else regexp_replace(path, '/+$', '') end ||
 coalesce('?' || nullif(array_to_string(list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]*=.+$') and not starts_with(x, 'utm_') and split_part(x, '=', 1) not in ('fbclid','gclid','ref','source')), '&'), ''), '') link from p)"""
_DOMAIN = f"""case when len(string_split({{h}}, '.')) >= 3 and list_contains({_list(K.SUFFIXES_2)}, array_to_string(string_split({{h}}, '.')[-2:], '.')) then array_to_string(string_split({{h}}, '.')[-3:], '.')
 when len(string_split({{h}}, '.')) >= 2 and list_contains({_list(K.SUFFIXES_1)}, string_split({{h}}, '.')[-1]) then array_to_string(string_split({{h}}, '.')[-2:], '.') else regexp_replace({{h}}, '^www\\.', '') end"""


@query(f"with {_U} select page_id, link from n")
def page_url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_url("url").alias("link"))


@query(f"with {_U} select {_DOMAIN.format(h='host')} as domain, host as hostname, count(*) as n_pages, count(distinct link) as n_links from n group by 1, 2")
def page_domain_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(X.domain("url").alias("domain"), X.hostname("url").alias("hostname"), X.normalize_url("url").alias("link"))
    return rows.groupBy("domain", "hostname").agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct("link").alias("n_links"))


@query("""with t as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) h1 from pages)
select page_id, title <> '' as has_title, title = h1 as same, len(html) < 400 or regexp_matches(html, '(?i)<div\\s+id=["''](root|app|__next)["'']\\s*>\\s*</div>') or contains(lower(html), 'enable javascript to run this app') or contains(lower(html), 'javascript is required') as needs_rendering from t join pages using (page_id)""")
def page_title_and_rendering(spark, sf_dir):
    rows = extract.parse_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", (F.col("page.title") != "").alias("has_title"), (F.col("page.title") == F.col("page.h1")).alias("same"), X.needs_rendering("html").alias("needs_rendering"))


@query("""with a as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) href from pages)
select page_id, count(*) as n_links, count_if(starts_with(href, '/') or starts_with(href, '#')) as n_internal from a group by 1""")
def page_link_counts(spark, sf_dir):
    rows = extract.parse_pages(table(spark, sf_dir, "pages")).select("page_id", F.explode("page.links").alias("a"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("a.href").startswith("/") | F.col("a.href").startswith("#")).alias("n_internal"))


@query()
def page_internal_links_topk(spark, sf_dir):
    return extract.internal_links(extract.parse_pages(table(spark, sf_dir, "pages")))


#: Paths that are given to the captured pages, which have none that a crawl would follow.
_PATHS = ("/contact-us", "/about", "/services/seo", "/blog/contact", "/privacy", "/team", "/category/services", "/x")


@query(f"""with {_U}, d as (select host, 'https://' || host || list_extract({_list(_PATHS)}, cast(page_id % {len(_PATHS)} + 1 as integer)) || '/' || (page_id % 90) as link from n),
s as (select distinct host, link, 10 * len(list_filter({_list(K.SITEMAP_KEYWORDS)}, lambda w: contains(lower(link), w))) - case when {_any('lower(link)', K.SITEMAP_BAD)} then 15 else 0 end as score from d)
select host as site, link, score from s where score > 0 qualify row_number() over (partition by host order by score desc, link) <= 15""")
def sitemap_url_scores(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("page_id") % len(_PATHS) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select(X.hostname("url").alias("site"), "page_id")
    rows = rows.select("site", F.concat(F.lit("https://"), "site", path, F.lit("/"), (F.col("page_id") % 90).cast("string")).alias("link"))
    return extract.best_sitemap_urls(rows, "site", "link").select("site", "link", "score")


@query(f"""with {_U}, d as (select page_id, host, page_id % {len(_PATHS)} as k from n), a as (select page_id, host, j as pos, list_extract({_list(_PATHS)}, cast((k + j) % {len(_PATHS)} + 1 as integer)) as path from d, range(5) r(j)),
s as (select page_id, pos, 'https://' || host || path as link, 10 * len(list_filter({_list(K.LINK_KEYWORDS)}, lambda w: contains(path, w))) as score from a)
select page_id, cast(row_number() over (partition by page_id order by score desc, pos) as integer) as rank, link, score from s where score > 0 qualify rank <= 10""")
def derived_links_topk(spark, sf_dir):
    """Internal links of derived pages: five to a page, on the page's own host."""
    k = F.col("page_id") % len(_PATHS)
    links = [F.concat(F.lit('<a href="'), F.element_at(F.array(*map(F.lit, _PATHS)), ((k + j) % len(_PATHS) + 1).cast("int")), F.lit('">-</a>')) for j in range(5)]
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://"), X.hostname("url"), F.lit("/")).alias("url"), F.concat(F.lit("<html><body>"), *links, F.lit("</body></html>")).alias("html"))
    return extract.internal_links(extract.parse_pages(pages), most=10)


@query("""with s as (select suppkey, n from (select s_suppkey as suppkey, s_suppkey % 3 + 1 as n from supplier)), e as (select suppkey, n, unnest(range(n)) as pos from s),
u as (select 0 as source, suppkey as seq, pos, 'a' || (suppkey % 7) as name from e union all select 1, suppkey, 0, 'a' || (suppkey % 7) from s)
select row_number() over (order by source, seq, pos) - 1 as cand_id, name, case when source = 0 then 'search' else 'maps' end as source from u""")
def sources_in_order(spark, sf_dir):
    """Candidates of two sources, repeated rows among them, numbered in their order of arrival."""
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("a"), (F.col("s_suppkey") % 7).cast("string")).alias("name"), F.sequence(F.lit(0), (F.col("s_suppkey") % 3).cast("int")).alias("p"))
    first = captured.as_candidates(k.select("seq", "name", F.explode("p").alias("pos")), "search", name=F.col("name"))
    second = captured.as_candidates(k, "maps", name=F.col("name"))
    return captured.union(first, second).select("cand_id", "name", "source")


@query()
def page_signals(spark, sf_dir):
    pages = extract.parse_pages(table(spark, sf_dir, "pages")).withColumn("meta", extract.metadata())
    pages = pages.withColumns({"social_profiles": extract.socials(), "name": extract.business_info([])["name"], "domain": X.domain("url")})
    rows = signals.with_signals(pages, ["Berlin"])
    return rows.select("page_id", "s_website", "s_seo", "s_social", "s_branding", "s_content")


@query()
def page_opportunities(spark, sf_dir):
    rows = page_signals(spark, sf_dir)
    rows = rows.withColumns({"url": F.concat(F.lit("page:"), F.col("page_id").cast("string")), "social_profiles": F.create_map().cast("map<string,string>")})
    found = rows.withColumn("o", signals.opportunities(["SEO", "Website Design", "branding", "content", "social"]))
    return found.select("page_id", signals.short_reason(F.col("o")).alias("short_reason"), F.posexplode("o").alias("place", "x")).select("page_id", "place", "x.service", "x.confidence", F.size("x.signals").alias("n_signals"), "x.reason", "short_reason")


@query()
def page_contacts(spark, sf_dir):
    rows = extract.parse_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", F.transform(extract.emails(), lambda e: e["value"]).alias("emails"), F.transform(extract.phones(), lambda p: p["value"]).alias("phones"), F.col("page.address").alias("address"), F.map_keys(extract.socials()).alias("platforms"))


@query()
def page_business_info(spark, sf_dir):
    rows = extract.parse_pages(table(spark, sf_dir, "pages")).withColumn("meta", extract.metadata())
    return rows.withColumn("b", extract.business_info(["repair", "the"])).select("page_id", "b.name", "b.description", "b.services", F.size("page.jsonld").alias("n_structured"))


@query()
def page_directory_entries(spark, sf_dir):
    rows = extract.directory_candidates(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "pos", "name", "website", "source", "confidence")


# ---- documents: contacts ----

_EMAIL_OK = f"e <> '' and len(list_filter({_list(K.EMAIL_ASSETS)}, lambda x: ends_with(e, x))) = 0 and not list_contains({_list(K.EMAIL_IGNORED_DOMAINS)}, split_part(e, '@', -1)) and len(list_filter({_list(K.EMAIL_IGNORED_PREFIXES)}, lambda x: starts_with(e, x))) = 0"


@query(f"""with x as (select doc_id, lower(unnest(regexp_extract_all(text, '{K.EMAIL}'))) e from documents)
select e as email, count(distinct doc_id) as n_docs from x where {_EMAIL_OK} group by 1""")
def doc_emails(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.emails_in("text")).alias("email"))
    return rows.groupBy("email").agg(F.countDistinct("doc_id").alias("n_docs"))


@query(f"""with x as (select doc_id, unnest(regexp_extract_all(text, '{K.PHONE}')) raw from documents),
y as (select distinct doc_id, trim(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '[^0-9+]+$', '')) phone from x), z as (select doc_id, phone, regexp_replace(phone, '[^0-9]', '', 'g') d from y)
select doc_id, phone, case when len(d) >= 10 then right(d, 10) else d end as digits_key from z where len(d) between 7 and 15""")
def doc_phones(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.phones_in("text")).alias("phone"))
    return rows.select("doc_id", "phone", X.digits_key("phone").alias("digits_key"))


# ---- names ----

_NAME = "{n} || case {k} % 5 when 0 then ' Pvt Ltd' when 1 then ' Private Limited' when 2 then ' Clinic' when 3 then ' Services LLC' else ' -' end"


def _sql_replace(x: str, patterns) -> str:
    for p in patterns:
        x = f"trim(regexp_replace({x}, '{p}', '', 'gi'))"
    return x


_NORM = f"nullif(trim(regexp_replace({_sql_replace('x', K.LEGAL_SUFFIXES)}, '[-–—,]+$', '')), '')"


@query(f"""with c as (select s_suppkey as id, {_NAME.format(n='s_name', k='s_suppkey')} x from supplier), n as (select id, {_NORM} as name from c)
select id, name, nullif(case when len(k) >= 3 then k else '' end, '') as match_key from (select id, name, regexp_replace({_sql_replace('lower(name)', [rf'\\b{w}\\b' for w in K.GENERIC_SUFFIXES])}, '[^a-z0-9]', '', 'g') k from n)""".replace("\\\\b", "\\b"))
def name_normalize(spark, sf_dir):
    n = F.col("s_suppkey") % 5
    full = F.concat("s_name", F.when(n == 0, " Pvt Ltd").when(n == 1, " Private Limited").when(n == 2, " Clinic").when(n == 3, " Services LLC").otherwise(" -"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), X.normalize_name(full).alias("name"), X.name_key(full).alias("match_key"))


# ---- derived candidates ----

_CAND_SQL = """cand as (select c_custkey as cand_id, case when c_custkey % 19 = 0 then '' when c_custkey % 23 = 0 then 'Best dentists in ' || n_name when c_custkey % 29 = 0 then 'Home' else 'B' || left(md5(cast(c_custkey % 1200 as varchar)), 12) end as name,
 case when c_custkey % 6 = 0 then null when c_custkey % 31 = 0 then 'https://www.practo.com/c' || c_custkey else 'https://www.shop' || (c_custkey % 400) || '.example.com/' end as website,
 case when c_custkey % 6 = 0 then null when c_custkey % 31 = 0 then 'practo.com' else 'shop' || (c_custkey % 400) || '.com' end as domain,
 lower(c_mktsegment) as industry, case when c_custkey % 4 = 0 then 'machinery and more' else null end as description,
 case when c_custkey % 13 = 0 then null else n_name end as location, case when c_custkey % 5 = 0 then null else '+91 98' || lpad(cast((c_custkey * 7919) % 1000 as varchar), 8, '0') end as phone from customer join nation on c_nationkey = n_nationkey)"""


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from customers and nations."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    site = F.concat(F.lit("shop"), (k % 400).cast("string"))
    phone = F.when(k % 5 != 0, F.concat(F.lit("+91 98"), F.lpad(((k * 7919) % 1000).cast("string"), 8, "0")))
    values = {
        "cand_id": k,
        "source": F.element_at(F.array(*map(F.lit, ("search", "maps", "instagram"))), (k % 3 + 1).cast("int")),
        "name": F.when(k % 19 == 0, "").when(k % 23 == 0, F.concat(F.lit("Best dentists in "), F.col("n_name"))).when(k % 29 == 0, "Home").otherwise(F.concat(F.lit("B"), F.left(F.md5((k % 1200).cast("string").cast("binary")), F.lit(12)))),
        "website": F.when(k % 6 == 0, F.lit(None)).when(k % 31 == 0, F.concat(F.lit("https://www.practo.com/c"), k.cast("string"))).otherwise(F.concat(F.lit("https://www."), site, F.lit(".example.com/"))),
        "domain": F.when(k % 6 == 0, F.lit(None)).when(k % 31 == 0, "practo.com").otherwise(F.concat(site, F.lit(".com"))),
        "industry": F.lower("c_mktsegment"),
        "description": F.when(k % 4 == 0, "machinery and more"),
        "locations": F.when(k % 13 == 0, F.array()).otherwise(F.array("n_name")),
        "phone_numbers": F.when(phone.isNull(), F.array()).otherwise(F.array(F.struct(phone.alias("value"), phone.alias("raw_value"), F.lit(None).cast("string"), F.lit("derived")))),
        "sources": F.array(F.element_at(F.array(*map(F.lit, ("search", "maps", "instagram"))), (k % 3 + 1).cast("int"))),
        "services": F.array(),
        "emails": F.array(),
        "evidence": F.array(),
        "service_opportunities": F.array(),
        "social_profiles": F.create_map(),
        "is_historical": F.lit(False),
        "is_directory": k % 97 == 0,
    }
    return rows.select(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()])


_DIRECTORY = f"(list_contains({_list(K.DIRECTORY_DOMAINS)}, domain) or len(list_filter({_list(K.DIRECTORY_DOMAINS)}, lambda d: ends_with(domain, '.' || d))) > 0)"
_REASON = f"""case when cand_id % 97 = 0 or coalesce({_DIRECTORY}, false) then 'Domain ''' || coalesce(domain, 'source record') || ''' is a directory/aggregator, not a business'
 when name <> '' and list_contains({_list(K.GENERIC_NAMES)}, lower(name)) then 'Business name appears to be a generic page element: ''' || name || ''''
 when name <> '' and regexp_matches(name, '(?i){K.LISTING_TITLE}') then 'Business name appears to be a listing title: ''' || name || ''''
 when name = '' then 'Candidate has no identifiable business name'
 when website is null and phone is null then 'Candidate has no usable public contact path'
 when not ({_any("lower(concat_ws(' ', nullif(name, ''), description, industry))", ['automobile', 'machinery'])}) then 'Industry keywords are not present in business-specific data'
 when location is null then 'Candidate has no business-specific location evidence'
 when not ({_any('lower(location)', ['nation_1', 'nation_4', 'nation_8'])}) then 'Candidate location does not match any requested location'
 when phone is null then 'Required field ''phone'' is missing'
 when contains(lower(concat_ws(' ', name, description, industry)), 'bc4ca') then 'Candidate matches exclusion keyword: ''bc4ca''' end"""
_CODE = """case when contains(lower(reason), 'directory') or contains(lower(reason), 'aggregator') then 'DIRECTORY_SOURCE' when contains(lower(reason), 'listing title') or contains(lower(reason), 'identifiable business name') then 'NOT_A_BUSINESS'
 when contains(lower(reason), 'industry') then 'WRONG_INDUSTRY' when contains(lower(reason), 'location') then 'WRONG_LOCATION' when contains(lower(reason), 'contact') then 'NO_CONTACT_METHOD' else 'OTHER' end"""


@query(f"with {_CAND_SQL} select cand_id, {_REASON} as reason from cand")
def validator_reasons(spark, sf_dir):
    return derived(spark, sf_dir).select("cand_id", V.rejection_reason(REQUEST).alias("reason"))


@query(f"""with {_CAND_SQL}, r as (select cand_id, {_REASON} as reason from cand), c as (select {_CODE} as reason_code from r where reason is not null)
select reason_code, case reason_code when 'WRONG_INDUSTRY' then 'relevance' when 'WRONG_LOCATION' then 'location' when 'NO_CONTACT_METHOD' then 'contact_validation' else 'business_identity' end as stage, count(*) as n from c group by 1, 2""")
def rejection_codes(spark, sf_dir):
    code = V.reason_code(F.col("reason"))
    rows = derived(spark, sf_dir).withColumn("reason", V.rejection_reason(REQUEST)).where("reason is not null")
    return rows.select(code.alias("reason_code"), V.reason_stage(code).alias("stage")).groupBy("reason_code", "stage").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_CAND_SQL} select domain, count(*) as n from cand where {_DIRECTORY} group by 1")
def directory_domain_filter(spark, sf_dir):
    return derived(spark, sf_dir).where(V.is_directory_domain(F.col("domain"))).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


_SOURCE = "case cand_id % 3 when 0 then 'search' when 1 then 'maps' else 'instagram' end"


@query(f"with {_CAND_SQL} select s.source, coalesce(n, 0) as candidates from (select unnest(['search','maps','instagram','historical','explicit_intent']) source) s left join (select {_SOURCE} source, count(*) n from cand group by 1) c on s.source = c.source")
def source_stats(spark, sf_dir):
    known = spark.createDataFrame([(s,) for s in ("search", "maps", "instagram", "historical", "explicit_intent")], "source string")
    return V.source_stats(derived(spark, sf_dir), known)


@query(f"""with {_CAND_SQL}, r as (select cand_id, location, {_REASON} is null as ok from cand),
w as (select *, row_number() over (partition by location order by cand_id) n, coalesce(sum(ok::int) over (partition by location order by cand_id rows between unbounded preceding and 1 preceding), 0) a from r)
select location, cand_id, ok as accepted from w where n <= 30 and a < 3""")
def early_stop_accept(spark, sf_dir):
    rows = derived(spark, sf_dir).select("cand_id", F.try_element_at("locations", F.lit(1)).alias("location"), V.rejection_reason(REQUEST).isNull().alias("accepted"))
    return V.early_stop(rows, "accepted", ["location"], "cand_id", 3, 30).select("location", "cand_id", "accepted")


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def first_seen_per_key(spark, sf_dir):
    return V.first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""with f as (select event_type, user_id, min(event_id) e from events group by 1, 2) select event_type as job, user_id, cast(row_number() over (partition by event_type order by e) as integer) as rank from f qualify rank <= 10""")
def first_keys_crawled(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("key", F.col("user_id").cast("string"))
    return V.first_keys(rows, "key", "event_id", "event_type", 10).select(F.col("event_type").alias("job"), F.col("key").cast("long").alias("user_id"), "rank")


# ---- resolution ----

_PAIR = """ from cand a join cand b on {on} and a.cand_id < b.cand_id where not coalesce(a.domain <> b.domain, false)"""


@query(f"with {_CAND_SQL} select distinct a.cand_id as a, b.cand_id as b" + _PAIR.format(on="a.domain = b.domain"))
def er_pairs_domain(spark, sf_dir):
    return resolve.all_pairs(resolve.keyed(derived(spark, sf_dir)), "domain")


@query(f"with {_CAND_SQL} select distinct a.cand_id as a, b.cand_id as b" + _PAIR.format(on="a.phone = b.phone"))
def er_pairs_phone(spark, sf_dir):
    return resolve.all_pairs(resolve.keyed(derived(spark, sf_dir)), "phone")


@query("""with s as (select s_suppkey k, 'instagram:instagram.com/h' || (s_suppkey % 40) p from supplier) select a.k as a, b.k as b from s a join s b on a.p = b.p and a.k < b.k""")
def er_pairs_social(spark, sf_dir):
    k = F.col("s_suppkey")
    url = F.concat(F.when(k % 2 == 0, "https://www.instagram.com/H").otherwise("http://instagram.com/h"), (k % 40).cast("string"), F.when(k % 3 == 0, "/").otherwise(""))
    rows = table(spark, sf_dir, "supplier").select(k.alias("cand_id"), F.create_map(F.lit("instagram"), url).alias("social_profiles"), *[F.lit(None).cast(FIELDS[c]).alias(c) for c in ("name", "domain", "phone_numbers", "locations")])
    return resolve.all_pairs(resolve.keyed(rows), "profile")


@query("""with s as (select s_suppkey k, 'place' || (s_suppkey % 3) place, s_suppkey % 60 name from supplier) select a.k as a, b.k as b from s a join s b on a.name = b.name and a.place = b.place and a.k < b.k""")
def er_pairs_name(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Acme "), (k % 60).cast("string"), F.when(k % 2 == 0, " Clinic Ltd").otherwise(" Services"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("cand_id"), name.alias("name"), F.array(F.concat(F.lit("Place"), (k % 3).cast("string"))).alias("locations"), *[F.lit(None).cast(FIELDS[c]).alias(c) for c in ("domain", "phone_numbers", "social_profiles")])
    return resolve.all_pairs(resolve.keyed(rows), "name")


@query()
def er_pairs_fuzzy(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), F.col("p_name").alias("name"))
    return resolve.near_pairs(rows)


@query()
def er_clusters_live(spark, sf_dir):
    return resolve.clusters(derived(spark, sf_dir), "live")


@query()
def er_clusters_batch(spark, sf_dir):
    return resolve.clusters(derived(spark, sf_dir), "batch")


_EVENTS = """e as (select event_id cand_id, user_id % 50 as cluster_id, event_type, value, user_id, 'S' || (event_id % 7) as service, case event_id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as confidence from events)"""


def _event_members(spark, sf_dir) -> DataFrame:
    """Members of clusters that are transitive by construction: events by user."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events")
    service = F.concat(F.lit("S"), (i % 7).cast("string"))
    confidence = F.when(i % 3 == 0, "low").when(i % 3 == 1, "medium").otherwise("high")
    opportunity = F.struct(service.alias("service"), service.alias("service_display"), confidence.alias("confidence"), F.array().cast("array<string>").alias("signals"), F.array().cast("array<string>").alias("evidence"), F.lit("").alias("reason"))
    email = F.struct(F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string"), F.lit("@Mail.com")).alias("value"), F.lit(False).alias("verified"), F.lit("").alias("source_url"), F.lit("").alias("source_type"))
    values = {"cand_id": i, "name": F.when(i % 4 == 0, F.concat(F.lit("@u"), i.cast("string"))).otherwise(F.concat(F.lit("Name "), i.cast("string"))), "website": F.when(i % 3 == 0, F.concat(F.lit("https://w"), i.cast("string"))), "description": F.repeat(F.lit("x"), (i % 11).cast("int")), "lead_type": F.when(F.col("event_type") == "click", "opportunity").when(F.col("event_type") == "view", "explicit_intent"), "service_opportunities": F.array(opportunity), "emails": F.array(email), "services": F.array(service), "sources": F.array("event_type"), "is_historical": F.col("event_type") == "error", "is_directory": F.lit(False)}
    return rows.select(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()], (F.col("user_id") % 50).alias("cluster_id"))


@query(f"""with {_EVENTS}, b as (select cluster_id, service, min_by(confidence, case confidence when 'high' then 0 when 'medium' then 1 else 2 end * 100000000 + cand_id) confidence from e group by 1, 2) select cluster_id, service, confidence from b""")
def merge_opportunities(spark, sf_dir):
    rows = resolve.merge_opportunities(_event_members(spark, sf_dir))
    return rows.select("cluster_id", F.explode("service_opportunities").alias("o")).select("cluster_id", "o.service", "o.confidence")


@query("""with m as (select user_id % 50 as cluster_id, event_id i, event_type t, user_id from events), a as (select cluster_id, count(*) as members, min(i) as first_id,
 coalesce(min_by('Name ' || i, i) filter (i % 4 <> 0), min_by('@u' || i, i)) as name, min_by('https://w' || i, i) filter (i % 3 = 0) as website, max(i % 11) as longest, bool_or(t = 'view') v, true o, count(distinct 'u' || (user_id % 20)) as n_emails, count(distinct i % 7) as n_services, count(distinct t) as n_sources, bool_or(t = 'error') as is_historical from m group by 1)
select cluster_id, members, first_id, name, website, longest, case when v then 'explicit_and_opportunity' else 'opportunity' end as lead_type, n_emails, n_services, n_sources, is_historical from a""")
def er_cluster_merge(spark, sf_dir):
    rows = _event_members(spark, sf_dir)
    out = resolve.merge(rows.drop("cluster_id"), rows.select("cand_id", "cluster_id"))
    return out.select("cluster_id", "members", F.col("cand_id").alias("first_id"), "name", "website", F.coalesce(F.length("description"), F.lit(0)).cast("long").alias("longest"), "lead_type", F.size("emails").cast("long").alias("n_emails"), F.size("services").cast("long").alias("n_services"), F.size("sources").cast("long").alias("n_sources"), "is_historical")


@query("""select user_id as cluster_id, case when bool_or(event_type = 'view') and bool_or(event_type = 'click') then 'explicit_and_opportunity' when bool_or(event_type = 'view') then 'explicit_intent' when bool_or(event_type = 'click') then 'opportunity' end as lead_type from events group by 1""")
def lead_type_lattice(spark, sf_dir):
    i, o = F.bool_or(F.col("event_type") == "view"), F.bool_or(F.col("event_type") == "click")
    kind = F.when(i & o, "explicit_and_opportunity").when(i, "explicit_intent").when(o, "opportunity")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cluster_id")).agg(kind.alias("lead_type"))


@query()
def job_ledger(spark, sf_dir):
    ledger, _ = discovery.decide(derived(spark, sf_dir), None, REQUEST)
    return ledger.select("cand_id", "cluster_id", "outcome", "detail", "reason_code", "stage", "source")


@query()
def job_leads(spark, sf_dir):
    return discovery.run(derived(spark, sf_dir), None, REQUEST)["leads"].select("cluster_id", "members", "name", "website", "domain", "industry", F.array_join("locations", ",").alias("locations"), F.array_join("sources", ",").alias("sources"))


@query()
def job_counters(spark, sf_dir):
    return discovery.run(derived(spark, sf_dir), None, REQUEST)["counters"]


# ---- expansion ----


@query()
def discovery_queries(spark, sf_dir):
    return expansion.queries(spark, REQUEST)


@query("""with k as (select s_nationkey as loc, list_extract(['basic','service','contact'], cast(s_suppkey % 3 + 1 as integer)) as family, s_suppkey as seq from supplier),
r as (select *, row_number() over (partition by loc, family order by seq) pass from k), o as (select *, row_number() over (partition by loc order by pass, list_position(['basic','service','contact'], family)) own from r),
t as (select * from o where own <= 4), p as (select loc, pass, count(*) n from t group by 1, 2), b as (select loc, pass, coalesce(sum(n) over (order by loc, pass rows between unbounded preceding and 1 preceding), 0) before from p)
select loc, family, seq, cast(pass as integer) as pass from t join b using (loc, pass) where before < 40""")
def round_robin_queries(spark, sf_dir):
    k = F.col("s_suppkey")
    family = F.element_at(F.array(*map(F.lit, ("basic", "service", "contact"))), (k % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("loc"), family.alias("family"), k.alias("seq"))
    return expansion.round_robin(rows, 4, 40).select("loc", "family", "seq", "pass")


_PHRASES = _list(K.INTENT_MODIFIERS[:8])


@query(f"""with l as (select n_name as location from nation), p as (select unnest({_PHRASES}) phrase, unnest(range(8)) i), w as (select unnest({_list(K.SERVICE_KEYWORDS['seo'][:3])}) word, unnest(range(3)) j)
select location, '"' || phrase || '" "' || word || '" "' || location || '"' as query, case when contains(phrase, 'hir') then 'hiring' when contains(phrase, 'looking') or contains(phrase, 'seeking') then 'looking_for' when contains(phrase, 'need') then 'need' else 'other' end as intent_type from l, p join w on i % 3 = j""")
def explicit_intent_queries(spark, sf_dir):
    # As many locations as nations: the request's list comes from the driver, as a request does.
    names = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").collect()]
    return expansion.intent_queries(spark, Request("", names, services_offered=["search engine optimization"])).select("location", "query", "intent_type")


@query(f"""with s as (select unnest({_list(['SEO', 'Social Media Management', ' web design ', 'logo refresh', 'blogging', 'ppc', 'zzz', 'Marketing', 'google ads help'])}) raw), a as (select unnest({_list(K.SERVICE_ALIASES)}) alias, unnest({_list(K.SERVICE_ALIASES.values())}) service, unnest(range({len(K.SERVICE_ALIASES)})) i)
select raw, coalesce(case when list_contains({_list(K.SERVICE_DISPLAY)}, lower(trim(raw))) then lower(trim(raw)) end, (select service from a where alias = lower(trim(raw))), (select min_by(service, i) from a where contains(lower(trim(raw)), alias) or contains(alias, lower(trim(raw))))) as service from s""")
def service_alias_resolve(spark, sf_dir):
    raw = ["SEO", "Social Media Management", " web design ", "logo refresh", "blogging", "ppc", "zzz", "Marketing", "google ads help"]
    return spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", X.service_key("raw").alias("service"))


_KIND = "case when contains(t, 'hir') then 'hiring' when contains(t, 'recommend') or contains(t, 'suggest') then 'recommend' when contains(t, 'looking') or contains(t, 'seeking') or contains(t, 'searching') then 'looking_for' when contains(t, 'need') or contains(t, 'require') then 'need' when contains(t, 'improve') then 'want_to_improve' else 'other' end"


@query(f"""with c as (select conv_id, turn, lower(text) t from conversations), k as (select *, {_KIND} as kind from c)
select conv_id, turn, kind, case when kind in ('hiring','need','looking_for') and ({_any('t', K.HIGH_INTENT)}) then 'high' when kind in ('recommend','want_to_improve') then 'medium' else 'low' end as confidence from k""")
def intent_classify(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("kind", X.intent_type("text"))
    return rows.select("conv_id", "turn", "kind", X.intent_confidence("kind", "text").alias("confidence"))


@query(f"""select page_id, case when {_any('lower(url)', K.JOB_BOARDS)} then 'job_board' when {_any('lower(url)', K.SOCIAL_SITES)} then 'social' when {_any('lower(url)', K.FORUMS)} then 'forum' else 'public_web' end as kind from pages""")
def site_types(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.site_type("url").alias("kind"))


# ---- job store ----


@query("""select o_custkey as job_id, max(o_orderdate) as at, max_by(o_orderstatus, o_orderkey) as status from orders group by 1""")
def jobs_latest(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return store.latest(log.drop("o_orderdate"), "job_id", "at").join(log.groupBy("job_id").agg(F.max("o_orderdate").alias("when")), "job_id").select("job_id", F.col("when").alias("at"), "status")


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) <= 3")
def newest_jobs(spark, sf_dir):
    return store.newest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", 3).select("o_custkey", "o_orderkey")


@query("""select doc_id, case when len(text) > 200 then left(text, 197) || '...' else text end as about from documents""")
def results_projection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.shortened("text", 200).alias("about"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark, sf_dir):
    return registry.windowed_counts(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")

