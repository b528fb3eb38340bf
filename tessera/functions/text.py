"""Scalar functions over Columns: text, URLs, domains, phones, emails, names, services, intents.

Everything here stays in the JVM but for clean_text(exact=True) and similarity(), which need entity decoding, Unicode
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tessera.functions import constants as K
from tessera.functions import plain


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(text: Column, words: list[str], test=F.contains) -> Column:
    """Whether test(text, word) holds for any of the words."""
    return reduce(lambda a, b: a | b, [test(text, F.lit(w)) for w in words], F.lit(False))


def blank(c: Column) -> Column:
    """Null or empty: what counts as missing."""
    return c.isNull() | (c == "")


def filled(c: Column) -> Column:
    return F.when(c != "", c)


@F.pandas_udf(StringType())
def _clean_exact(s: pd.Series) -> pd.Series:
    return s.map(plain.clean_text, na_action="ignore")


def squeeze(c: Column | str) -> Column:
    """Control characters become blanks, runs of white space one blank, ends are trimmed."""
    c = F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def clean_text(c: Column | str, exact: bool = True) -> Column:
    """X1. exact=False is for text without entities or compatibility characters and stays in the JVM."""
    return F.coalesce(_clean_exact(col(c)), F.lit("")) if exact else F.coalesce(squeeze(c), F.lit(""))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two lower-cased, trimmed strings; not symmetric; 0 if one is missing."""
    return pd.Series([plain.similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def keywords(c: Column | str) -> Column:
    """X3"""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"\b[a-zA-Z0-9_-]{3,}\b"), F.lit(0)))


# ---- URLs and domains ----


def _absolute(c: Column) -> Column:
    u = F.trim(c)
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))


def _quoted(c: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(c), c)
    return F.replace(F.replace(F.url_encode(decoded), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(c: Column | str) -> Column:
    """Scheme added, tracking parameters and blank ones dropped, host lowered, trailing slashes and fragment cut."""
    u = _absolute(col(c))
    part = lambda n: F.regexp_extract(u, r"(?s)^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", n)
    pairs = F.filter(F.split(part(4), "&"), lambda p: p.rlike("(?s)^[^=]*=.+$"))
    pairs = F.transform(pairs, lambda p: F.struct(_quoted(F.substring_index(p, "=", 1)).alias("k"), _quoted(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("v")))
    pairs = F.filter(pairs, lambda p: ~p["k"].startswith("utm_") & ~p["k"].isin(K.TRACKING))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    path = F.regexp_extract(part(3), r"(?s)^((?:.*/)?[^/;]*)(;[^/]*)?$", 1)
    params = F.regexp_extract(part(3), r"(?s)^((?:.*/)?[^/;]*)(;[^/]*)?$", 2)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    out = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.when(params == ";", "").otherwise(params), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(blank(col(c)), F.lit("")).otherwise(out)


def hostname(c: Column | str) -> Column:
    """The host without port, lowered."""
    u = col(c)
    return F.lower(F.substring_index(F.regexp_extract(F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u)), r"^[^:/?#]*://([^/?#]*)", 1), ":", 1))


def domain(c: Column | str) -> Column:
    """The registered domain by a compact suffix table, else the host without www."""
    host = hostname(F.regexp_replace(col(c), r"^([^:/?#]*://)?[^/?#@]*@", "$1"))
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    n = F.size(labels)
    registered = F.when((n >= 3) & last(2).isin(K.SUFFIXES_2), last(3)).when((n >= 2) & ~last(2).isin(K.SUFFIXES_2) & last(1).isin(K.SUFFIXES_1), last(2))
    return F.when(blank(col(c)), F.lit("")).otherwise(F.coalesce(registered, F.regexp_replace(host, r"^www\.", "")))


def same_domain(a: Column | str, b: Column | str) -> Column:
    """X7"""
    return (domain(a) == domain(b)) & (domain(a) != "")


def is_http_url(c: Column | str) -> Column:
    """F14"""
    return F.coalesce(col(c).rlike("(?i)^https?://[^/?#]+"), F.lit(False))


def website_host(c: Column | str) -> Column:
    """host of a website without www, empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(col(c), F.lit("HOST"))), r"^www\.", ""), F.lit(""))


# ---- phones and emails ----


def digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\D", "")


def digits_key(c: Column | str) -> Column:
    """The last ten digits, or all of seven to nine."""
    d = digits(c)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10))).when(F.length(d) >= 7, d)


def e164(c: Column | str) -> Column:
    """X9 by hand-made rules: an international prefix, or national lengths of the first region; no number plan data."""
    raw = F.trim(col(c))
    d = digits(raw)
    national = F.regexp_replace(d, "^0", "")
    out = (
        F.when(raw.startswith("+") & F.length(d).between(7, 15), F.concat(F.lit("+"), d))
        .when(d.startswith("00") & F.length(d).between(9, 17), F.concat(F.lit("+"), F.substr(d, F.lit(3))))
        .when((F.length(d) == 12) & d.startswith("91"), F.concat(F.lit("+"), d))
        .when(F.length(national).between(6, 13), F.concat(F.lit("+91"), national))
        .when(F.length(d) >= 10, F.concat(F.lit("+"), d))
        .otherwise(raw)
    )
    return F.when(~blank(col(c)), out)


def normalize_email(c: Column | str) -> Column:
    """X11"""
    e = F.lower(F.trim(col(c)))
    return F.when(e.rlike(K.EMAIL_STRICT), e)


def email_allowed(e: Column) -> Column:
    """Whether a lower-cased address is neither an asset name nor a placeholder."""
    return (e != "") & ~any_of(e, K.EMAIL_ASSETS, F.endswith) & ~F.substring_index(e, "@", -1).isin(K.EMAIL_IGNORED_DOMAINS) & ~any_of(e, K.EMAIL_IGNORED_PREFIXES, F.startswith)


def emails_in(c: Column | str) -> Column:
    """E6a on plain text: addresses as they stand, then unmasked ones; ordered, distinct."""
    text = F.coalesce(col(c), F.lit(""))
    masked = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + K.MASKED_EMAIL), F.lit(0)), lambda m: F.regexp_replace(m, "(?i)^" + K.MASKED_EMAIL + "$", "$1@$2.$3"))
    found = F.transform(F.concat(F.regexp_extract_all(text, F.lit(K.EMAIL), F.lit(0)), masked), lambda e: F.lower(F.trim(e)))
    return F.array_distinct(F.filter(found, email_allowed))


def phones_in(c: Column | str) -> Column:
    """E6b on plain text: raw numbers of 7 to 15 digits; ordered, distinct."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(K.PHONE), F.lit(0))
    found = F.transform(found, lambda p: F.trim(F.regexp_replace(squeeze(p), r"[^\d+]+$", "")))
    return F.array_distinct(F.filter(found, lambda p: F.length(digits(p)).between(7, 15)))


# ---- names, addresses, services ----


def normalize_name(c: Column | str, exact: bool = False) -> Column:
    """Legal forms and trailing dashes or commas removed."""
    out = reduce(lambda x, p: F.trim(F.regexp_replace(x, "(?i)" + p, "")), K.LEGAL_SUFFIXES, clean_text(c, exact))
    return filled(F.trim(F.regexp_replace(out, "[-–—,]+$", "")))


def name_key(c: Column | str, exact: bool = False) -> Column:
    """Letters and digits of the name without generic words; null if shorter than three."""
    low = reduce(lambda x, w: F.regexp_replace(x, rf"(?i)\b{w}\b", ""), K.GENERIC_SUFFIXES, F.lower(normalize_name(c, exact)))
    key = F.regexp_replace(low, "[^a-z0-9]", "")
    return F.when(F.length(key) >= 3, key)


def normalize_address(c: Column | str, exact: bool = False) -> Column:
    """X14"""
    out = F.regexp_replace(clean_text(c, exact), r",\s*,+", ", ")
    return F.when(F.length(out) > 5, out)


def city_of(c: Column | str, locations: list[str]) -> Column:
    """The first location that the address contains."""
    return F.coalesce(*[F.when(F.contains(F.lower(col(c)), F.lit(x.lower())), F.lit(x)) for x in locations], F.lit(None).cast("string"))


def service_key(c: Column | str) -> Column:
    """Exact key, exact alias, else the first alias that contains the name or is contained in it."""
    raw = F.lower(F.trim(col(c)))
    exact = F.when(raw.isin(list(K.SERVICE_DISPLAY)), raw)
    alias = F.coalesce(*[F.when(raw == a, F.lit(s)) for a, s in K.SERVICE_ALIASES.items()])
    near = F.coalesce(*[F.when(F.contains(raw, F.lit(a)) | F.contains(F.lit(a), raw), F.lit(s)) for a, s in K.SERVICE_ALIASES.items()])
    return F.coalesce(exact, alias, near)


def display_name(c: Column | str) -> Column:
    """X17"""
    known = F.coalesce(*[F.when(col(c) == k, F.lit(v)) for k, v in K.SERVICE_DISPLAY.items()])
    return F.coalesce(known, F.initcap(F.replace(col(c), F.lit("_"), F.lit(" "))))


def name_from_title(title: Column | str, industry: str) -> Column:
    """The title up to its first break, unless that is too short or the industry itself."""
    t = col(title)
    first = squeeze(F.element_at(F.split(t, K.TITLE_BREAK), 1))
    return F.when(~blank(t), F.when((F.length(first) >= 3) & (F.lower(first) != industry.lower()), first).otherwise(squeeze(t)))


def profile_handle(url: Column | str) -> Column:
    """X23"""
    h = F.lower(F.regexp_extract(col(url), r"instagram\.com/([a-zA-Z0-9_.]+)", 1))
    return F.when((h != "") & ~h.isin(K.PROFILE_RESERVED), h)


def name_from_profile_title(title: Column | str) -> Column:
    """X24"""
    t = F.trim(F.regexp_replace(col(title), "(?i)•\\s*Instagram.*$", ""))
    t = F.trim(F.regexp_replace(t, r"\(@[a-zA-Z0-9_.]+\)", ""))
    t = squeeze(F.regexp_replace(t, "(?i)on Instagram:.*$", ""))
    return F.when(F.length(t) > 2, t)


def snippet_phone(c: Column | str) -> Column:
    """X25"""
    return filled(F.trim(F.regexp_extract(col(c), K.SNIPPET_PHONE, 0)))


def snippet_email(c: Column | str) -> Column:
    """X25"""
    return filled(F.lower(F.regexp_extract(col(c), K.PLAIN_EMAIL, 0)))


# ---- intents ----


def intent_type(c: Column | str) -> Column:
    """X18"""
    p = F.lower(col(c))
    return (
        F.when(F.contains(p, F.lit("hir")), "hiring")
        .when(any_of(p, ["recommend", "suggest"]), "recommend")
        .when(any_of(p, ["looking", "seeking", "searching"]), "looking_for")
        .when(any_of(p, ["need", "require"]), "need")
        .when(F.contains(p, F.lit("improve")), "want_to_improve")
        .otherwise("other")
    )


def intent_confidence(kind: Column | str, text: Column | str) -> Column:
    """X26"""
    marked = any_of(F.lower(col(text)), K.HIGH_INTENT)
    return F.when(col(kind).isin("hiring", "need", "looking_for") & marked, "high").when(col(kind).isin("recommend", "want_to_improve"), "medium").otherwise("low")


def site_type(url: Column | str) -> Column:
    """X27"""
    u = F.lower(col(url))
    return F.when(any_of(u, K.JOB_BOARDS), "job_board").when(any_of(u, K.SOCIAL_SITES), "social").when(any_of(u, K.FORUMS), "forum").otherwise("public_web")


def shortened(c: Column | str, most: int) -> Column:
    """Text of more than `most` characters, cut to that length with an ellipsis."""
    return F.when(F.length(col(c)) > most, F.concat(F.left(col(c), F.lit(most - 3)), F.lit("..."))).otherwise(col(c))


def intent_reason(service: Column | str, text: Column | str) -> Column:
    """X28"""
    s = F.when(~blank(col(service)), F.concat(F.lit(" for "), col(service))).otherwise("")
    return F.concat(F.lit("Public intent signal"), s, F.lit(": "), shortened(F.trim(col(text)), 140))


def needs_rendering(html: Column | str) -> Column:
    """Too little markup, an empty application root, or a plea to switch scripts on."""
    h = F.coalesce(col(html), F.lit(""))
    return (F.length(h) < 400) | h.rlike(K.EMPTY_APP) | any_of(F.lower(h), K.SCRIPT_PLEAS)


def first_of(a: Column | str) -> Column:
    """X35"""
    return F.try_element_at(col(a), F.lit(1))
