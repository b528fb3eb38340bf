"""Sources (S1-S10, S14, S15) over captured payloads: rows of raw HTML, JSON, XML and robots text become candidates.

Each source is a parse (Arrow UDFs over the tree, or JSON and XML built-ins) and a projection into the schema of
candidates. There is no network here: whoever captures pages hands them over as tables, or as files to the "captured"
data source in tessera.sources.files.
"""

from __future__ import annotations

import gzip
from functools import reduce
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as X
from tessera.functions.htmltree import parse
from tessera.functions.plain import clean_text
from tessera.operators import extract
from tessera.operators.resolve import stored
from tessera.operators.schema import EMAILS, EVIDENCE, FIELDS, PHONES, Request

RESULT = "array<struct<title:string,href:string,snippet:string>>"
POI = "struct<name:string,display_name:string,namedetails:map<string,string>,extratags:map<string,string>>"
MAP_URL = "https://www.openstreetmap.org/"


# ---- result pages (S2, S3, S6) ----


def results_of(html: str | None, strict: bool = False, fallback: bool = False) -> list[dict]:
    """Results of a captured result page: blocks, else rows of a plain table; fallback: another engine's list."""
    tree = parse(html)
    if fallback:
        blocks = [(b, "h2 a", ".b_caption p") for b in tree.select("li.b_algo")]
    else:
        spec = (".result__title a", ".result__snippet") if strict else (".result__title a, .result__a, h2 a, h3 a", ".result__snippet, .result-snippet")
        blocks = [(b, *spec) for b in tree.select(".result__body" if strict else ".result__body, .result")]
    out = []
    for block, title, snippet in blocks:
        if t := block.select(title):
            s = block.select(snippet)
            out.append({"title": clean_text(t[0].text()), "href": t[0].attrs.get("href", ""), "snippet": clean_text(s[0].text()) if s else ""})
    if blocks or fallback:
        return out
    link = None
    for row in tree.select("table tr"):
        link = next(iter(row.select("a.result-link")), link)
        told = row.select("td.result-snippet")
        if told and link is not None:
            out.append({"title": clean_text(link.text()), "href": link.attrs.get("href", ""), "snippet": clean_text(told[0].text())})
            link = None
    return out


def unwrap(href: Column, loose: bool = False) -> Column:
    """S3: the target of a redirect, else an absolute link; loose takes any link that begins with http."""
    target = F.regexp_extract(href, r"[?&]uddg=([^&#]+)", 1)
    plain = href.startswith("http") if loose else href.startswith("http://") | href.startswith("https://")
    return F.when(target != "", F.coalesce(F.try_url_decode(target), target)).when(plain, href)


def parse_results(captured: DataFrame, strict: bool = False, loose: bool = False, fallback: bool = False) -> DataFrame:
    """Captured (html and any columns) exploded to pos, title, url, snippet; results without a target are left out."""

    @F.pandas_udf(RESULT)
    def run(pages: pd.Series) -> pd.Series:
        def safe(h):
            try:
                return results_of(h, strict, fallback)
            except Exception:  # noqa: BLE001  a page that breaks gives nothing
                return []

        return pages.map(safe)

    rows = captured.select(*[c for c in captured.columns if c != "html"], F.posexplode(run("html")).alias("pos", "r"))
    url = unwrap(F.col("r.href"), loose)
    return rows.withColumn("url", url if loose else X.normalize_url(url)).where(F.coalesce("url", F.lit("")) != "").select("*", "r.title", "r.snippet").drop("r")


# ---- candidates ----


def evidence(*items: tuple[str, Column, Column, float, str, Column | None]) -> Column:
    """An entry for each (field, value, url, confidence, kind, context) whose value is filled."""
    rows = []
    for field, value, url, confidence, kind, context in items:
        entry = F.struct(F.lit(field).alias("field_name"), value.cast("string").alias("value"), F.lit(kind).alias("source_type"), url.alias("source_url"), F.lit(confidence).alias("confidence"), (context if context is not None else F.lit(None).cast("string")).alias("context_snippet"), F.lit(None).cast("timestamp").alias("timestamp"))
        rows.append(F.when(~X.blank(value), entry))
    return F.array_compact(F.array(*rows)).cast(EVIDENCE)


def as_candidates(rows: DataFrame, source: str, **values) -> DataFrame:
    """rows projected to the schema of candidates; fields that are not given are null or empty."""
    empty = {"services": F.array(), "locations": F.array(), "sources": F.array(), "phone_numbers": F.array(), "emails": F.array(), "evidence": F.array(), "service_opportunities": F.array(), "social_profiles": F.create_map(), "is_historical": F.lit(False), "is_directory": F.lit(False)}
    given = empty | {"source": F.lit(source)} | values
    return rows.select(*[given.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in FIELDS.items() if k != "cand_id"], *[c for c in ("seq", "pos") if c in rows.columns])


def phone_list(value: Column, kind: str, url: Column) -> Column:
    entry = F.struct(value.alias("value"), F.lit(None).cast("string").alias("raw_value"), url.alias("source_url"), F.lit(kind).alias("source_type"))
    return F.array_compact(F.array(F.when(~X.blank(value), entry))).cast(PHONES)


def email_list(value: Column, kind: str, url: Column) -> Column:
    entry = F.struct(value.alias("value"), F.lit(False).alias("verified"), url.alias("source_url"), F.lit(kind).alias("source_type"))
    return F.array_compact(F.array(F.when(~X.blank(value), entry))).cast(EMAILS)


def search_results(captured: DataFrame, r: Request) -> tuple[DataFrame, DataFrame]:
    """Results with a new, valid domain, and those on directories. captured: seq, location, html."""
    rows = parse_results(captured).where(X.is_http_url("url")).withColumn("domain", X.domain("url")).where("domain != ''")
    listed = F.col("domain").isin(K.DIRECTORY_DOMAINS)
    first = F.row_number().over(Window.partitionBy("domain").orderBy("seq", "pos"))
    return rows.where(~listed).withColumn("n", first).where("n = 1").drop("n"), rows.where(listed)


def from_search(captured: DataFrame, r: Request) -> DataFrame:
    """S1"""
    rows, _ = search_results(captured, r)
    rows = rows.withColumn("name", X.name_from_title("title", r.industry))
    proof = evidence(("website", F.col("url"), F.col("url"), 0.85, "search", F.col("snippet")), ("name", F.col("name"), F.col("url"), 0.80, "search", F.col("title")))
    return as_candidates(rows, "search", name=F.col("name"), website=F.col("url"), domain=F.col("domain"), industry=F.lit(r.industry), description=X.filled(F.col("snippet")), locations=F.array("location"), sources=F.array(F.lit("search")), evidence=proof)


def from_dorks(captured: DataFrame, r: Request) -> DataFrame:
    """Like S1 without directories; kept for callers, no part of the default set."""
    rows, _ = search_results(captured, r)
    proof = evidence(("website", F.col("url"), F.col("url"), 0.88, "dorking", F.col("snippet")))
    return as_candidates(rows, "dorking", name=X.name_from_title("title", r.industry), website=F.col("url"), domain=F.col("domain"), industry=F.lit(r.industry), description=X.filled(F.col("snippet")), locations=F.array("location"), sources=F.array(F.lit("dorking")), evidence=proof)


def from_directories(pages: DataFrame, r: Request) -> DataFrame:
    """Businesses that captured directory pages list. pages: seq, location, url, html."""
    rows = extract.directory_candidates(pages).withColumnRenamed("source", "kind")
    url, kind = F.col("url"), F.col("kind")
    phones = F.transform("phones", lambda p: F.struct(p.alias("value"), F.lit(None).cast("string").alias("raw_value"), url.alias("source_url"), kind.alias("source_type")))
    emails = F.transform("emails", lambda e: F.struct(e.alias("value"), F.lit(False).alias("verified"), url.alias("source_url"), kind.alias("source_type")))
    listed = F.struct(F.lit("name").alias("field_name"), F.col("name").alias("value"), kind.alias("source_type"), url.alias("source_url"), F.col("confidence"), F.lit(None).cast("string").alias("context_snippet"), F.lit(None).cast("timestamp").alias("timestamp"))
    proof = F.concat(F.array(listed).cast(EVIDENCE), evidence(("source_url", url, url, 0.70, "directory_extraction", None)))
    return as_candidates(rows, "search", name=F.col("name"), website=F.col("website"), industry=F.lit(r.industry), address=F.col("address"), locations=F.array_compact(F.array(X.filled(F.col("location")))), sources=F.array(kind, F.lit("directory_extraction")), phone_numbers=phones, emails=emails, evidence=proof)


def from_maps(captured: DataFrame, r: Request) -> DataFrame:
    """Points of interest. captured: seq, location, json (an array of items)."""
    rows = captured.select("seq", "location", F.posexplode(F.from_json("json", f"array<{POI}>")).alias("pos", "i"))
    tag = lambda *keys: F.coalesce(*[X.filled(F.try_element_at("i.extratags", F.lit(k))) for k in keys])
    name = F.coalesce(X.filled(F.try_element_at("i.namedetails", F.lit("name"))), X.filled(F.col("i.name")), X.filled(F.substring_index("i.display_name", ",", 1)))
    rows = rows.withColumns({"raw": name, "name": X.clean_text(name), "place": F.col("i.display_name"), "phone": F.trim(tag("phone", "contact:phone"))}).withColumn("site", X.filled(X.normalize_url(tag("website", "contact:website", "url")))).where("raw is not null")
    url = F.lit(MAP_URL)
    proof = evidence(("phone", F.col("phone"), url, 0.90, "maps", None), ("website", F.col("site"), url, 0.90, "maps", None), ("name", F.col("raw"), url, 0.95, "maps", F.col("place")))
    # The payload's email is read by nobody: parity.
    return as_candidates(rows, "maps", name=F.col("name"), website=F.col("site"), domain=X.filled(X.domain("site")), industry=F.lit(r.industry), address=F.col("place"), locations=F.array("location"), sources=F.array(F.lit("maps")), phone_numbers=phone_list(F.col("phone"), "maps", url), evidence=proof)


def from_profiles(captured: DataFrame, fallback: DataFrame, r: Request) -> DataFrame:
    """Social profiles of result pages; another engine's captures stand in for queries without results."""
    on_host = lambda df: df.where(F.contains(F.lower("url"), F.lit("instagram.com/")))
    own = on_host(parse_results(captured, loose=True))
    other = on_host(parse_results(fallback, loose=True, fallback=True)).join(own.select("seq").distinct(), "seq", "left_anti")
    rows = own.unionByName(other).withColumn("handle", X.profile_handle("url")).where("handle is not null")
    url = F.concat(F.lit("https://www.instagram.com/"), F.col("handle"), F.lit("/"))
    rows = rows.withColumns({"profile": url, "name": F.coalesce(X.name_from_profile_title("title"), F.concat(F.lit("@"), F.col("handle"))), "phone": X.snippet_phone("snippet"), "email": X.snippet_email("snippet")})
    p = F.col("profile")
    proof = evidence(("social_profiles.instagram", p, p, 0.90, "instagram", F.col("snippet")), ("name", F.col("name"), p, 0.80, "instagram", F.col("title")), ("phone", F.col("phone"), p, 0.75, "instagram", F.col("snippet")), ("email", F.col("email"), p, 0.75, "instagram", F.col("snippet")))
    return as_candidates(rows, "instagram", name=F.col("name"), industry=F.lit(r.industry), description=X.filled(F.col("snippet")), social_profiles=F.create_map(F.lit("instagram"), p), locations=F.array("location"), sources=F.array(F.lit("instagram")), phone_numbers=phone_list(F.col("phone"), "instagram", p), emails=email_list(F.col("email"), "instagram", p), evidence=proof)


def from_archive(captured: DataFrame, r: Request) -> DataFrame:
    """An archive's listing, an array of arrays under a header. captured: seq, location, json."""
    if not r.enable_historical:
        captured = captured.limit(0)
    lines = F.from_json("json", "array<array<string>>")
    rows = captured.select("seq", "location", F.posexplode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("pos", "x"))
    rows = rows.withColumns({"url": F.try_element_at("x", F.lit(1)), "stamp": F.try_element_at("x", F.lit(2))}).where(X.is_http_url("url")).withColumn("domain", X.domain("url")).where("domain != ''")
    shot = F.concat(F.lit("https://web.archive.org/web/"), F.col("stamp"), F.lit("/"), F.col("url"))
    proof = evidence(("website", F.col("url"), shot, 0.70, "wayback", F.concat(F.lit("Wayback snapshot from "), F.col("stamp"))))
    return as_candidates(rows, "historical", name=F.col("domain"), website=F.col("url"), domain=F.col("domain"), industry=F.lit(r.industry), locations=F.array("location"), sources=F.array(F.lit("wayback")), is_historical=F.lit(True), evidence=proof)


def from_intents(captured: DataFrame, r: Request) -> DataFrame:
    """Public requests for help. captured: seq, location, service, intent_type, query, html."""
    if not r.services_offered:
        captured = captured.limit(0)
    rows = parse_results(captured, strict=True)
    told = F.coalesce(X.filled(F.col("snippet")), X.filled(F.col("title")))
    first = X.squeeze(F.element_at(F.split("title", K.TITLE_BREAK), 1))
    quoted = X.filled(F.regexp_extract("snippet", '"([^"]{3,100})"', 1))
    name = F.coalesce(F.when((F.length(first) >= 3) & (F.lower(first) != r.industry.lower()), F.left(first, F.lit(120))), quoted)
    rows = rows.withColumns({"told": told, "name": name, "wanted": F.when(~X.blank(F.col("service")), X.display_name("service"))}).where("told is not null")
    rows = rows.withColumn("sure", X.intent_confidence(F.coalesce("intent_type", F.lit("")), "told"))
    score = F.when(F.col("sure") == "high", 0.9).when(F.col("sure") == "medium", 0.75).otherwise(0.55)
    cut = F.left("told", F.lit(500))
    entry = F.struct(F.lit("intent_evidence").alias("field_name"), cut.alias("value"), F.lit("explicit_intent").alias("source_type"), F.col("url").alias("source_url"), score.alias("confidence"), F.concat(F.lit("Query: "), F.col("query")).alias("context_snippet"), F.lit(None).cast("timestamp").alias("timestamp"))
    intent = F.struct(F.col("url").alias("source_url"), cut.alias("text"), X.site_type("url").alias("source_type"), F.col("sure").alias("confidence"))
    return as_candidates(rows, "explicit_intent", name=F.col("name"), industry=F.lit(r.industry), description=F.col("told"), locations=F.array("location"), sources=F.array(F.lit("explicit_intent")), lead_type=F.lit("explicit_intent"), service_requested=F.col("wanted"), intent_confidence=F.col("sure"), intent_evidence=intent, short_reason=X.intent_reason("wanted", "told"), evidence=F.array(entry))


def union(*sources: DataFrame) -> DataFrame:
    """All sources' candidates in a fixed order, source by source, then by seq and pos; cand_id counts them from 0.

    Rows are sorted in ranges, and each range adds the number of rows before it; equal rows have ids of their own.
    """
    rows = [s.withColumns({"__rank": F.lit(i)} | {f"__{c}": F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in s.columns else F.lit(0).cast("long") for c in ("seq", "pos")}) for i, s in enumerate(sources)]
    columns = [c for c in FIELDS if c != "cand_id"]
    order = ["__rank", "__seq", "__pos", "__hash"]
    out = reduce(DataFrame.unionByName, [x.select(*columns, "__rank", "__seq", "__pos") for x in rows])
    out = out.withColumn("__hash", F.xxhash64(F.to_json(F.struct(*[c for c in columns if c != "evidence"]))))
    out = out.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    out = stored(out.select(*columns, "__id").withColumn("__part", F.shiftright("__id", 33)))
    # One row for each range.
    counts = out.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("first"))
    own = F.col("first") + F.col("__id") - F.shiftleft("__part", 33)
    return out.join(F.broadcast(counts), "__part").withColumn("cand_id", own).select(*FIELDS)


# ---- crawl payloads (S14, S15, F15) ----


def robots(files: DataFrame) -> DataFrame:
    """Files (host, robots_text) with their declared site maps, in order, without repeats."""
    lines = F.filter(F.transform(F.split(F.coalesce("robots_text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.lower(x).startswith("sitemap:"))
    return files.withColumn("sitemaps", F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))), lambda u: u != "")))


def allowed(robots_text: Column | str, url: Column | str) -> Column:
    """whether a robots text lets any agent fetch a URL; yes where there is none, or it cannot be read."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series, urls: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}
        out = []
        for t, u in zip(texts, urls, strict=True):
            try:
                if t not in known:
                    known[t] = RobotFileParser()
                    known[t].parse([line.strip() for line in (t or "").splitlines()])
                out.append(known[t].can_fetch("*", u))
            except Exception:  # noqa: BLE001
                out.append(True)
        return pd.Series(out, dtype="bool")

    return F.coalesce(run(X.col(robots_text), X.col(url)), F.lit(True))


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """Maps (site, place, content as bytes, zipped or not) to the URLs of each site's first map that has any.

    Maps of maps hold no URLs of their own and are not followed; of a site's maps the first three are tried.
    """

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        def read(b):
            try:
                return (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "ignore")
            except (OSError, EOFError, TypeError):
                return None

        return content.map(read)

    first = maps.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("place"))).where("n <= 3")
    xml = F.regexp_replace(F.regexp_replace(text("content"), r'xmlns(:\w+)?="[^"]+"', ""), r"^\s*<\?[^>]*\?>", "")
    locs = F.regexp_extract_all(xml, F.lit(r"(?s)<url>\s*(?:<(?!loc>)[^>]*>[^<]*</[^>]*>\s*)*<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))
    rows = first.select("site", "place", F.posexplode(locs).alias("pos", "loc")).withColumn("loc", F.replace(F.replace("loc", F.lit("&amp;"), F.lit("&")), F.lit("&apos;"), F.lit("'")))
    rows = rows.where(X.is_http_url("loc")).withColumn("url", X.normalize_url("loc"))
    return rows.withColumn("least", F.min("place").over(Window.partitionBy("site"))).where("place = least").select("site", "pos", "url")
