"""Validation (F1-F16), reason codes and outcomes (X29-X31, A15): one CASE, so the first failing rule names the reason."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as X
from tessera.operators.schema import Request


def is_directory_domain(domain: Column) -> Column:
    """a known aggregator or a subdomain of one."""
    d = F.lower(F.trim(domain))
    return F.coalesce(d.isin(K.DIRECTORY_DOMAINS) | X.any_of(d, ["." + x for x in K.DIRECTORY_DOMAINS], F.endswith), F.lit(False))


def name_is_directory(name: Column, domain: Column) -> Column:
    """F16: the name is that of the directory whose domain it has."""
    root = F.lower(F.substring_index(domain, ".", 1))
    return F.coalesce(root.isin(K.DIRECTORY_NAMES) & F.contains(F.lower(F.trim(name)), root), F.lit(False))


def name_reason(name: Column) -> Column:
    """why a name is implausible; a missing one is not."""
    n = F.trim(name)
    said = lambda what: F.concat(F.lit(f"Business name {what}: '"), n, F.lit("'"))
    return F.when(~X.blank(name), F.when(F.length(n) < 2, said("too short")).when(F.lower(n).isin(K.GENERIC_NAMES), said("appears to be a generic page element")).when(n.rlike("(?i)" + K.LISTING_TITLE), said("appears to be a listing title")))


def industry_terms(request: Request) -> list[str]:
    """the request's telling words, without plural endings."""
    words = (w for t in [request.industry, *request.keywords] for w in re.findall("[a-z0-9]+", t.lower()))
    return list(dict.fromkeys(w.rstrip("s") for w in words if w not in K.STOP_WORDS and len(w) >= 4))


def _joined(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[X.filled(p) for p in parts]))


def industry_matches(request: Request) -> Column:
    """F5"""
    terms = industry_terms(request) if request.industry else []
    text = _joined(F.col("name"), F.col("description"), F.col("industry"), F.array_join("services", " "))
    return X.any_of(text, terms) if terms else F.lit(True)


def places() -> Column:
    """A candidate's locations, and its address behind them."""
    return F.concat(F.coalesce("locations", F.array().cast("array<string>")), F.array_compact(F.array(X.filled(F.col("address")))))


def location_matches(request: Request) -> Column:
    """F6"""
    return X.any_of(F.lower(F.array_join(places(), " ")), [x.lower() for x in request.locations])


def has_any(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def profile(platform: str) -> Column:
    return X.filled(F.try_element_at("social_profiles", F.lit(platform)))


def has_contact() -> Column:
    return ~X.blank(F.col("website")) | has_any("phone_numbers") | has_any("emails") | F.exists(F.map_values(F.coalesce("social_profiles", F.create_map().cast("map<string,string>"))), lambda v: ~X.blank(v))


def _missing(platforms: list[str]) -> dict[str, tuple[str, Column]]:
    known = {"website": ("website", X.blank(F.col("website"))), "phone": ("phone", ~has_any("phone_numbers")), "phone_number": ("phone", ~has_any("phone_numbers")), "email": ("email", ~has_any("emails")), "address": ("address", X.blank(F.col("address")))}
    return known | {p: (p, profile(p).isNull()) for p in platforms}


def must_have_reason(request: Request, platforms: list[str]) -> list[Column]:
    """requirements in the request's order; unknown ones are ignored."""
    known = _missing(platforms)
    wanted = [known[r] for x in request.must_have if (r := x.lower().strip()) in known]
    return [F.when(missing, F.lit(f"Required field '{name}' is missing")) for name, missing in wanted]


def exclusion_reason(request: Request) -> list[Column]:
    """F8"""
    text = _joined(F.col("name"), F.col("description"), F.col("industry"))
    return [F.when(F.contains(text, F.lit(w)), F.lit(f"Candidate matches exclusion keyword: '{x}'")) for x in request.exclude if (w := x.lower().strip())]


def rejection_reason(request: Request) -> Column:
    """the first failing rule's reason, null for a valid candidate."""
    domain = F.coalesce(X.filled(F.col("domain")), X.filled(X.website_host("website")))
    rules = [
        F.when(F.coalesce("is_directory", F.lit(False)) | is_directory_domain(domain), F.concat(F.lit("Domain '"), F.coalesce(domain, F.lit("source record")), F.lit("' is a directory/aggregator, not a business"))),
        name_reason(F.col("name")),
        F.when(X.blank(F.col("name")) | (F.length(F.trim("name")) < 2), "Candidate has no identifiable business name"),
        F.when(~has_contact(), "Candidate has no usable public contact path"),
        F.when(~industry_matches(request), "Industry keywords are not present in business-specific data"),
        F.when(F.size(places()) == 0, "Candidate has no business-specific location evidence"),
        F.when(~location_matches(request), "Candidate location does not match any requested location"),
        *must_have_reason(request, ["instagram", "linkedin"]),
        *exclusion_reason(request),
    ]
    return F.coalesce(*rules)


def light_eligible(request: Request) -> Column:
    """the batch merge's own check: Facebook counts, exclusions look at name and description apart."""
    missing = reduce(lambda a, b: a | b, [c.isNotNull() for c in must_have_reason(request, ["instagram", "linkedin", "facebook"])], F.lit(False))
    words = [w for x in request.exclude if (w := x.lower().strip())]
    return ~missing & ~X.any_of(F.lower(F.coalesce("name", F.lit(""))), words) & ~X.any_of(F.lower(F.coalesce("description", F.lit(""))), words)


def identity(request: Request, similarity=X.similarity) -> Column:
    """the second pass as a struct of booleans; `similarity` is the pluggable part."""
    name = F.lower(F.coalesce("name", F.lit("")))
    page = X.any_of(name, K.SOURCE_MARKERS)
    # The request's own industry text is part of what is searched, so any word of four letters matches.
    industry = F.lit(any(len(w) >= 4 for w in " ".join([request.industry, *request.keywords]).lower().split()))
    place = F.concat_ws(" ", F.array_join(F.coalesce("locations", F.array().cast("array<string>")), " "), F.coalesce("address", F.lit("")))
    near = reduce(lambda a, b: a | b, [F.contains(F.lower(place), F.lit(x.lower())) | (similarity(F.lit(x), place) >= 0.65) for x in request.locations])
    plausible = (F.trim(name) != "") & ~page
    return F.struct(
        plausible.alias("is_real_business"), plausible.alias("name_is_business"), page.alias("is_source_page"), industry.alias("matches_industry"),
        ((F.trim(place) != "") & near).alias("matches_location"), (~X.blank(F.col("website"))).alias("website_belongs_to_business"), has_contact().alias("is_contactable"),
    )


def identity_code(i: Column) -> Column:
    """X30"""
    return F.when(i["is_source_page"] | ~i["name_is_business"], "NOT_A_BUSINESS").when(~i["matches_industry"], "WRONG_INDUSTRY").when(~i["matches_location"], "WRONG_LOCATION").otherwise("LOW_IDENTITY_CONFIDENCE")


def reason_code(detail: Column, code: Column | None = None) -> Column:
    """A known code, else OTHER; words of the detail override it."""
    low = F.lower(detail)
    known = F.when(code.isin(K.REASON_CODES), code) if code is not None else F.lit(None).cast("string")
    return (
        F.when(X.any_of(low, ["directory", "aggregator"]), "DIRECTORY_SOURCE")
        .when(X.any_of(low, ["listing title", "identifiable business name"]), "NOT_A_BUSINESS")
        .when(F.contains(low, F.lit("industry")), "WRONG_INDUSTRY")
        .when(F.contains(low, F.lit("location")), "WRONG_LOCATION")
        .when(F.contains(low, F.lit("contact")), "NO_CONTACT_METHOD")
        .otherwise(F.coalesce(known, F.lit("OTHER")))
    )


def reason_stage(code: Column, stage: Column | str = "business_identity") -> Column:
    """The stage that a code belongs to, unless another was given."""
    given = F.lit(stage) if isinstance(stage, str) else stage
    own = F.coalesce(*[F.when(code == c, F.lit(s)) for c, s in K.CODE_STAGES.items()])
    return F.when(given == "business_identity", F.coalesce(own, given)).otherwise(given)


def job_counters(ledger: DataFrame, *keys: str) -> DataFrame:
    """Outcomes counted; checked is their sum."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates_checked"), n("ACCEPTED").alias("accepted_leads"), n("REJECTED").alias("rejected_candidates"), n("DUPLICATE").alias("duplicates"), n("ERROR").alias("candidate_errors"))


def source_stats(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates of each known source, 0 for those that gave none."""
    counts = candidates.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sources.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("candidates"))


def early_stop(rows: DataFrame, accepted: str, keys: list[str], order: str, target: int, limit: int) -> DataFrame:
    """A job's rows up to the limit or to the one that reaches the target; the limit bounds a job's window."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)
    before = F.coalesce(F.sum(F.col(accepted).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__a", before).where(F.col("__a") < target).drop("__n", "__a")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def first_keys(rows: DataFrame, key: str, order: str, job: str, most: int) -> DataFrame:
    """The first `most` different keys of a job, as (job, key, rank)."""
    firsts = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(job, key).agg(F.min(order).alias("first"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy(job).orderBy("first"))).where(F.col("rank") <= most).drop("first")
