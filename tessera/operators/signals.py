"""Opportunity signals (V1-V6, A18, X32, X34): messages of five detectors as arrays of CASE expressions over the parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as X

STRINGS = "array<string>"
OPPORTUNITY = "struct<service:string,service_display:string,confidence:string,signals:array<string>,evidence:array<string>,reason:string>"
LEAST, HIGH = 2, 3


def _found(*tests: Column) -> Column:
    return F.array_compact(F.array(*tests))


def _none() -> Column:
    return F.array().cast(STRINGS)


def _said(template: str, *values: Column) -> Column:
    """template with each {} replaced by a value."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for v, rest in zip(values, pieces[1:], strict=True):
        parts += [v.cast("string"), F.lit(rest)]
    return F.concat(*parts)


def words(c: Column) -> Column:
    return F.when(F.trim(X.squeeze(c)) == "", 0).otherwise(F.size(F.split(X.squeeze(c), " ")))


def website(html: Column, page: Column) -> Column:
    """V1"""
    text = F.coalesce(page["body_text"], F.lit(""))
    low = F.lower(text)
    phone_hint = text.rlike(r"(?U)\d") & X.any_of(low, K.PHONE_HINTS)
    email_hint = F.contains(text, F.lit("@")) | F.contains(low, F.lit("email"))
    signals = _found(
        F.when(~page["has_viewport"], "Missing viewport meta tag — website likely not mobile-optimized"),
        F.when(F.length(text) < 300, "Very thin page content (under 300 characters) — weak online presence").when(F.length(text) < 700, "Limited page content — room to expand service descriptions"),
        F.when(page["h1_count"] == 0, "No H1 heading found — weak content structure"),
        F.when(~page["has_nav"] & (page["list_links"] < 3), "No clear navigation structure — poor information architecture"),
        F.when(~F.exists(page["buttons"], lambda t: X.any_of(t, K.CTA_WORDS)), "No clear call-to-action (CTA) buttons found — weak conversion flow"),
        F.when(~phone_hint & ~email_hint, "No visible contact information on page — makes it hard for customers to reach out"),
        F.when(~X.any_of(low, K.SERVICE_WORDS), "No service description section detected — missed opportunity to convert visitors"),
        F.when((page["tables"] > 3) & (page["semantic_tags"] == 0), "Outdated table-based HTML layout — website may appear dated"),
    )
    return F.when(X.blank(html), F.array(F.lit("No website content accessible"))).otherwise(signals)


def seo(html: Column, page: Column, meta: Column, locations: list[str]) -> Column:
    """V2"""
    title, described = F.trim(meta["title"]), F.trim(meta["description"])
    seen = ~X.blank(html)
    n = words(F.coalesce(page["body_text_joined"], F.lit("")))
    inner = F.size(F.filter(page["links"], lambda a: a["href"].startswith("/") | a["href"].startswith("#")))
    places = [x.lower() for x in locations if x]
    return F.when(
        ~seen & (title == "") & (described == ""), F.array(F.lit("No page content available for SEO analysis"))
    ).otherwise(
        _found(
            F.when(title == "", "Missing page title tag — critical SEO issue").when(F.length(title) < 10, _said("Very short page title: '{}' — likely not optimized", title)).when(F.length(title) > 70, _said("Page title too long ({} chars) — truncated in search results", F.length(title))),
            F.when(described == "", "Missing meta description — reduces click-through rates from search").when(F.length(described) < 50, _said("Very short meta description ({} chars) — missed SEO opportunity", F.length(described))),
            F.when((F.size(F.coalesce(page["jsonld"], F.array())) <= 0) & ~F.coalesce(page["has_schema"], F.lit(False)), "No structured data (schema.org/JSON-LD) — missing local SEO and rich results opportunity"),
            F.when(seen & ~X.any_of(F.lower(html), places), "Location keywords not found on page — weak local SEO targeting") if places else F.lit(None).cast("string"),
            F.when(seen & (page["h1_count"] == 0), "No H1 tag — important keyword targeting element missing").when(seen & (page["h1_count"] > 3), _said("Multiple H1 tags ({}) — dilutes SEO keyword focus", page["h1_count"])),
            F.when(seen & (n < 150), _said("Very thin content ({} words) — poor for organic rankings", n)),
            F.when(seen & (inner < 3), "Very few internal links — weak site architecture for SEO"),
        )
    )


def _profiles(profiles: Column) -> Column:
    """Filled profiles as entries, in the order of their platforms' names."""
    return F.array_sort(F.filter(F.map_entries(F.coalesce(profiles, F.create_map().cast("map<string,string>"))), lambda e: ~X.blank(e["value"])))


def _name_words(name: Column, fillers: list[str]) -> Column:
    return F.filter(F.split(F.trim(X.squeeze(F.lower(name))), " "), lambda w: (F.length(w) > 3) & ~w.isin(fillers))


def _strange(entries: Column, named: Column) -> Column:
    """Profiles whose URL has none of the name's words."""
    return F.filter(entries, lambda e: ~F.exists(named, lambda w: F.contains(F.lower(e["value"]), w)))


def _root(domain: Column) -> Column:
    return F.lower(F.substring_index(domain, ".", 1))


def social(profiles: Column, name: Column, domain: Column) -> Column:
    """V3"""
    entries = _profiles(profiles)
    have = lambda p: F.exists(entries, lambda e: e["key"] == p)
    missing = F.array_compact(F.array(*[F.when(~have(p), F.lit(p)) for p in ("instagram", "facebook", "linkedin")]))
    named = _name_words(name, K.NAME_FILLERS)
    strange = F.transform(_strange(entries, named), lambda e: e["key"])
    urls = F.lower(F.array_join(F.transform(entries, lambda e: e["value"]), " "))
    signals = _found(
        F.when(~have("instagram") & ~have("facebook"), "No Instagram or Facebook presence found — major social platforms absent").when(F.size(missing) >= 2, _said("Missing social presence on key platforms: {}", F.array_join(missing, ", "))),
        F.when(~X.blank(name) & (F.size(named) > 0) & (F.size(strange) >= 2), _said("Social handles appear inconsistent with business name on: {} — branding fragmentation", F.array_join(strange, ", "))),
        F.when(~X.blank(domain) & (F.length(_root(domain)) > 3) & ~F.contains(urls, _root(domain)), "Social profile handles don't match website domain — potential brand inconsistency"),
    )
    return F.when(F.size(entries) == 0, F.array(F.lit("No public social media profiles discovered — no online community presence"))).otherwise(signals)


def branding(html: Column, page: Column, profiles: Column, name: Column, domain: Column) -> Column:
    """V4"""
    low = F.lower(F.trim(name))
    named = _name_words(name, K.BRAND_FILLERS)
    root = F.regexp_replace(_root(domain), "[-_]", "")
    fits = F.exists(named, lambda w: F.contains(root, w)) | F.exists(named, lambda w: F.contains(w, root)) | ((F.length(root) >= 3) & F.contains(F.regexp_replace(low, "[ .-]", ""), root))
    entries = _profiles(profiles)
    share = F.size(_strange(entries, named)) / F.when(F.size(entries) > 0, F.size(entries))
    seen = ~X.blank(html)
    signals = _found(
        F.when(~X.blank(domain) & ~fits & (F.length(root) > 3), _said("Business name '{}' doesn't clearly match domain '{}' — inconsistent brand identity", name, domain)),
        F.when((F.size(named) > 0) & (share > 0.4), "Multiple social profiles have handles inconsistent with business name — fragmented brand identity"),
        F.when(seen & (page["logo_images"] == 0), "No logo image detected on website — missing key brand element"),
        F.when(seen & (page["stylesheets"] == 0) & (page["inline_css_chars"] < 200), "Minimal styling detected — website may appear generic or unbranded"),
    )
    return F.when(X.blank(name), F.array(F.lit("Business name not clearly identified — weak brand identity"))).otherwise(signals)


def content(html: Column, page: Column) -> Column:
    """V5"""
    low, n = F.lower(F.coalesce(page["body_text"], F.lit(""))), words(F.coalesce(page["body_text"], F.lit("")))
    blog = X.any_of(low, K.BLOG_WORDS) | F.exists(page["links"], lambda a: X.any_of(F.lower(a["href"]), K.BLOG_WORDS))
    own = F.filter(F.slice(page["headings"], 1, 5), lambda h: ~X.any_of(h, K.GENERIC_HEADINGS))
    signals = _found(
        F.when(n < 200, _said("Very thin page content ({} words) — insufficient for meaningful engagement", n)).when(n < 400, _said("Limited page content ({} words) — room for richer content strategy", n)),
        F.when(~blog, "No blog, articles, or content section detected — no content marketing presence"),
        F.when(~X.any_of(low, K.DETAIL_WORDS), "Service descriptions appear generic or minimal — not differentiated"),
        F.when(~X.any_of(low, K.PROOF_WORDS), "No testimonials or social proof content found — missed trust signal"),
        F.when((F.size(page["headings"]) > 0) & (F.size(own) == 0), "Page headings appear generic — no distinctive content strategy"),
    )
    return F.when(X.blank(html), F.array(F.lit("No content accessible for analysis"))).otherwise(signals)


def _like(signals: Column, marks: list[str]) -> Column:
    return F.filter(signals, lambda s: X.any_of(F.lower(s), marks))


def service_keys(offered: list[str]) -> list[str]:
    """X16 on the driver: keys of the offered services that are known, in order."""
    out = []
    for raw in offered:
        low = raw.lower().strip()
        near = (v for a, v in K.SERVICE_ALIASES.items() if a in low or low in a)
        if key := low if low in K.SERVICE_DISPLAY else K.SERVICE_ALIASES.get(low) or next(near, None):
            out.append(key)
    return out


def with_signals(df: DataFrame, locations: list[str], html="html", page="page", meta="meta", profiles="social_profiles", name="name", domain="domain") -> DataFrame:
    """df with the five detectors' messages in columns s_website, s_seo, s_social, s_branding, s_content."""
    h, p, m, s, n, d = (F.col(x) for x in (html, page, meta, profiles, name, domain))
    found = F.struct(website(h, p).alias("s_website"), seo(h, p, m, locations).alias("s_seo"), social(s, n, d).alias("s_social"), branding(h, p, s, n, d).alias("s_branding"), content(h, p).alias("s_content"))
    # Exploding one struct keeps later expressions from repeating the detectors each time they name a message list.
    return df.withColumn("__s", F.explode(F.array(found))).select("*", "__s.*").drop("__s")


def opportunities(offered: list[str], url="url", profiles="social_profiles") -> Column:
    """Opportunities of the offered services with enough signals, most confident first (stable)."""
    w, s, so, b, c = (F.col(f"s_{x}") for x in ("website", "seo", "social", "branding", "content"))
    here = F.array_compact(F.array(X.filled(F.col(url))))
    linked = F.transform(_profiles(F.col(profiles)), lambda e: e["value"])
    parts = {
        "seo": (F.concat(s, _like(w, ["h1", "content", "thin", "heading", "navigation"])), here),
        "social_media": (so, linked),
        "branding": (F.concat(b, _like(so, ["inconsistent", "mismatch", "fragmented"])), here),
        "website_design": (w, here),
        "content_creation": (c, here),
        "digital_marketing": (F.concat(s, so, c), F.concat(here, linked)),
    }
    rows = []
    for at, key in enumerate(service_keys(offered)):
        signals, evidence = (F.array_distinct(x) for x in parts[key])
        confidence = F.when(F.size(signals) >= HIGH, "high").otherwise("medium")
        reason = X.shortened(F.regexp_replace(F.element_at(signals, 1), r"\.+$", ""), 120)
        row = F.struct(F.lit(key).alias("service"), F.lit(K.SERVICE_DISPLAY[key]).alias("service_display"), confidence.alias("confidence"), signals.alias("signals"), evidence.alias("evidence"), reason.alias("reason"))
        rows.append(F.when(F.size(signals) >= LEAST, F.struct(F.when(F.size(signals) >= HIGH, 0).otherwise(1).alias("rank"), F.lit(at).alias("at"), row.alias("o"))))
    if not rows:
        return F.array().cast(f"array<{OPPORTUNITY}>")
    return F.transform(F.array_sort(F.array_compact(F.array(*rows))), lambda x: x["o"])


def short_reason(found: Column) -> Column:
    """X32"""
    names = F.transform(found, lambda o: o["service_display"])
    one = F.element_at(found, 1)
    several = F.concat(F.lit("Potential opportunities in: "), F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), ", "), F.lit(" and "), F.element_at(names, -1))
    return F.when(F.size(found) == 0, "").when(F.size(found) == 1, F.concat(F.lit("Potential "), one["service_display"], F.lit(" opportunity: "), one["reason"])).otherwise(several)
