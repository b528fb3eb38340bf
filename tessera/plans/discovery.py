"""The discovery job as one plan (E12, E13, F12, F13, X29-X31, A15): candidates and captured pages in, ledger and leads out.

Resolution runs on candidates as they came, enrichment after it; a cluster is accepted or rejected by its first member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import extract, resolve, signals
from tessera.operators import validate as V
from tessera.operators.schema import EMAILS, EVIDENCE, FIELDS, OPPORTUNITIES, PHONES, Request

PAGES_PER_SITE = 3


def crawl_frontier(candidates: DataFrame, most: int) -> DataFrame:
    """cand_id of candidates that get the crawl: the first of each of the first `most` domains with a website."""
    sites = candidates.where(~X.blank(F.col("website")) & ~X.blank(F.col("domain"))).withColumn("__job", F.lit(0))
    chosen = V.first_keys(sites, "domain", "cand_id", "__job", most).select("domain")
    return V.first_seen(sites.join(chosen, "domain"), ["domain"], ["cand_id"]).select("cand_id", "domain")


def page_facts(pages: DataFrame, request: Request) -> DataFrame:
    """cand_id, place and what one page says: parse, metadata, contacts, profiles, business details."""
    parsed = extract.parse_pages(pages).withColumn("meta", extract.metadata())
    return parsed.withColumns({"p_emails": extract.emails(), "p_phones": extract.phones(), "p_socials": extract.socials(), "biz": extract.business_info(request.services)})


def _in_order(rows: DataFrame, c: str) -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(c).alias("v")))), lambda x: x["v"]))


def enrich(candidates: DataFrame, pages: DataFrame, request: Request) -> DataFrame:
    """Candidates with what their pages add. pages: cand_id, place, url, html.

    Pages are taken in order; within a page structured data comes before metadata and contacts. Lists grow by values
    they lack, missing fields take the first value found, a longer structured name replaces the name.
    """
    facts = page_facts(pages, request)
    url = F.col("url")
    records = lambda field, kind, extra: F.transform(F.filter("page.jsonld", lambda j: ~X.blank(j[field])), lambda j: F.struct(j[field].alias("value"), *extra, url.alias("source_url"), F.lit(kind).alias("source_type")))
    facts = facts.withColumns({
        "f_names": F.transform("page.jsonld", lambda j: j["name"]),
        "f_phones": F.concat(records("telephone", "jsonld", [F.lit(None).cast("string").alias("raw_value")]), F.col("p_phones")).cast(PHONES),
        "f_emails": F.concat(records("email", "jsonld", [F.lit(False).alias("verified")]), F.col("p_emails")).cast(EMAILS),
        "f_address": F.concat(F.transform("page.jsonld", lambda j: j["address"]), F.array("page.address")),
        "f_text": F.concat(F.transform("page.jsonld", lambda j: j["description"]), F.array("meta.description")),
        "f_heading": F.array("biz.name"),
        "f_services": F.col("biz.services"),
        "f_socials": F.map_entries("p_socials"),
    })
    names = ["f_names", "f_phones", "f_emails", "f_address", "f_text", "f_heading", "f_services", "f_socials"]
    known = facts.groupBy("cand_id").agg(*[_in_order(facts, c).alias(c) for c in names])
    rows = candidates.join(known, "cand_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array())
    filled = lambda c: F.try_element_at(F.filter(F.col(c), lambda v: ~X.blank(v)), F.lit(1))
    longest = F.aggregate("f_names", F.col("name"), lambda best, n: F.when(X.blank(best) | (F.length(n) > F.length(best)), n).otherwise(best))
    rows = rows.withColumns({
        "name": F.coalesce(X.filled(F.coalesce(longest, F.col("name"))), filled("f_heading")),
        "phone_numbers": F.concat(F.col("phone_numbers"), _lacking("f_phones", "phone_numbers", PHONES)),
        "emails": F.concat(F.col("emails"), _lacking("f_emails", "emails", EMAILS)),
        "address": F.coalesce(X.filled(F.col("address")), filled("f_address")),
        "description": F.coalesce(X.filled(F.col("description")), filled("f_text")),
        "services": F.array_distinct(F.concat("services", none("f_services").cast("array<string>"))),
        "social_profiles": _profiles(),
        "evidence": F.concat("evidence", F.coalesce(_proof(), F.array().cast(EVIDENCE))),
    })
    rows = rows.drop(*names)
    return with_opportunities(rows, facts, request) if request.services_offered else rows


def _lacking(found: str, own: str, kind: str) -> Column:
    """Records found whose value the candidate lacks, the first of each value."""
    values = F.transform(F.col(found), lambda r: r["value"])
    fresh = F.filter(F.col(found), lambda r, i: (F.array_position(values, r["value"]) == i + 1) & ~F.exists(F.col(own), lambda o: o["value"] == r["value"]))
    return F.coalesce(fresh, F.array().cast(kind))


def _profiles() -> Column:
    own = F.filter(F.map_entries("social_profiles"), lambda e: ~X.blank(e["value"]))
    every = F.concat(own, F.coalesce(F.col("f_socials"), F.array().cast("array<struct<key:string,value:string>>")))
    keys = F.transform(every, lambda e: e["key"])
    return F.map_from_entries(F.filter(every, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def _proof() -> Column:
    """Evidence of the contacts that pages added, by where they were found."""
    entry = lambda field, r, sure: F.struct(F.lit(field).alias("field_name"), r["value"].alias("value"), F.when(r["source_type"] == "jsonld", "jsonld").otherwise("website_html").alias("source_type"), r["source_url"].alias("source_url"), F.when(r["source_type"] == "jsonld", 0.95).otherwise(sure).alias("confidence"), F.lit(None).cast("string").alias("context_snippet"), F.lit(None).cast("timestamp").alias("timestamp"))
    return F.concat(F.transform(_lacking("f_phones", "phone_numbers", PHONES), lambda r: entry("phone", r, 0.90)), F.transform(_lacking("f_emails", "emails", EMAILS), lambda r: entry("email", r, 0.90))).cast(EVIDENCE)


def with_opportunities(rows: DataFrame, facts: DataFrame, request: Request) -> DataFrame:
    """V, E12: each offered service's opportunity from the first page that shows it, and the lead's type and reason."""
    state = rows.select("cand_id", "name", "domain", "social_profiles")
    seen = facts.drop("name", "domain", "social_profiles").join(state, "cand_id")
    seen = signals.with_signals(seen, request.locations).withColumn("found", signals.opportunities(request.services_offered))
    seen = seen.where(F.size("found") > 0).select("cand_id", "place", "found", signals.short_reason(F.col("found")).alias("said"))
    got = seen.groupBy("cand_id").agg(_in_order(seen, "found").alias("o"), F.min_by("said", "place").alias("said"))
    out = rows.join(got, "cand_id", "left")
    every = F.concat("service_opportunities", F.coalesce(F.col("o"), F.array()).cast(OPPORTUNITIES))
    kinds = F.transform(every, lambda o: o["service"])
    shown = F.col("said").isNotNull()
    return out.withColumns({
        "service_opportunities": F.filter(every, lambda o, i: F.array_position(kinds, o["service"]) == i + 1),
        "lead_type": F.when(shown & (F.col("lead_type") == "explicit_intent"), "explicit_and_opportunity").when(shown & X.blank(F.col("lead_type")), "opportunity").otherwise(F.col("lead_type")),
        "short_reason": F.coalesce(X.filled(F.col("short_reason")), F.col("said")),
    }).drop("o", "said")


def finalized(leads: DataFrame) -> DataFrame:
    """About and the reason that a lead shows."""
    best = F.try_element_at("service_opportunities", F.lit(1))
    offered = F.concat(F.lit("Potential "), best["service_display"], F.lit(" opportunity: "), best["reason"])
    asked = F.concat(F.lit("Public intent signal: "), X.shortened(F.col("intent_evidence.text"), 140))
    return leads.withColumns({"about": F.coalesce(X.filled(F.col("about")), X.shortened("description", 200)), "short_reason": F.coalesce(X.filled(F.col("short_reason")), offered, asked)})


def decide(candidates: DataFrame, pages: DataFrame | None, request: Request) -> tuple[DataFrame, DataFrame]:
    """The ledger of all candidates that the job checked, and their first members as enriched.

    ledger: cand_id, cluster_id, candidate_name, candidate_url, outcome, detail, reason_code, stage, source.
    pages: domain, place, url, html of captured sites, or None.
    """
    assigned = resolve.stored(resolve.clusters(candidates, "live"))
    firsts = candidates.join(assigned, "cand_id").where("cand_id = cluster_id").drop("cluster_id")
    gate = firsts.withColumn("reason", V.rejection_reason(request))
    who = V.identity(request)
    gate = resolve.stored(gate.withColumn("who", F.when(F.col("reason").isNull(), who)))
    sure = F.col("reason").isNull() & F.col("who.is_real_business") & F.col("who.name_is_business") & F.col("who.matches_industry") & F.col("who.matches_location")
    passed = gate.where(sure).select(*FIELDS)
    if pages is not None:
        sites = crawl_frontier(passed, request.max_domains_crawled)
        mine = pages.join(sites, "domain").where(F.col("place") <= PAGES_PER_SITE).drop("domain")
        passed = enrich(passed, mine, request)
    passed = resolve.stored(passed.select(*FIELDS))
    last = F.when(~V.has_contact(), F.struct(F.lit("No usable public contact path").alias("detail"), F.lit("NO_CONTACT_METHOD").alias("code"))).otherwise(F.struct(V.rejection_reason(request).alias("detail"), F.lit("CONTACT_MISMATCH").alias("code")))
    finals = passed.select("cand_id", last.alias("last"))
    rows = gate.select("cand_id", "reason", "who").join(finals, "cand_id", "left")
    code = F.when(F.col("reason").isNotNull(), V.reason_code(F.col("reason"))).when(~F.coalesce(sure, F.lit(False)), V.reason_code(F.lit("Candidate failed identity validation"), V.identity_code(F.col("who")))).when(F.col("last.detail").isNotNull(), V.reason_code(F.col("last.detail"), F.col("last.code")))
    given = F.when(F.col("last.detail").isNotNull() & sure, "contact_validation").otherwise("business_identity")
    rows = rows.select("cand_id", code.alias("reason_code"), V.reason_stage(code, given).alias("stage"), F.when(F.col("reason").isNotNull(), F.col("reason")).when(~F.coalesce(sure, F.lit(False)), "Candidate failed identity validation").when(F.col("last.detail").isNotNull(), F.col("last.detail")).alias("why"))
    ledger = candidates.select("cand_id", F.col("name").alias("candidate_name"), F.col("website").alias("candidate_url"), X.filled(F.array_join("sources", ",")).alias("source")).join(assigned, "cand_id").join(rows, "cand_id", "left")
    own = F.col("cand_id") == F.col("cluster_id")
    ledger = ledger.withColumns({
        "outcome": F.when(~own, "DUPLICATE").when(F.col("why").isNotNull(), "REJECTED").otherwise("ACCEPTED"),
        "detail": F.when(~own, "Matched an existing registry identity").otherwise(F.coalesce("why", F.lit("Candidate passed final validation"))),
        "stage": F.when(F.col("why").isNotNull(), F.col("stage")),
    }).drop("why")
    # A job checks 50,000 candidates at most, so its window is small; the first by cand_id are found by a top-k.
    head = ledger.orderBy("cand_id").limit(request.max_candidates_checked)
    stopped = V.early_stop(head.withColumn("__yes", F.col("outcome") == "ACCEPTED").withColumn("__job", F.lit(0)), "__yes", ["__job"], "cand_id", request.target_leads, request.max_candidates_checked)
    return resolve.stored(stopped.drop("__yes", "__job")), passed


def run(candidates: DataFrame, pages: DataFrame | None, request: Request) -> dict[str, DataFrame]:
    """ledger, leads (merged and finalized), rejections and counters of a job."""
    ledger, passed = decide(candidates, pages, request)
    accepted = ledger.where("outcome = 'ACCEPTED'").select("cluster_id")
    members = ledger.join(accepted, "cluster_id", "left_semi").select("cand_id", "cluster_id")
    rich = candidates.join(passed.select("cand_id"), "cand_id", "left_anti").select(*FIELDS).unionByName(passed)
    leads = finalized(resolve.merge(rich, members))
    return {"ledger": ledger, "leads": leads, "rejections": ledger.where("outcome = 'REJECTED'"), "counters": V.job_counters(ledger)}


def merged_batch(candidates: DataFrame, request: Request) -> DataFrame:
    """The batch way: all candidates clustered and merged at once, then the light check (F9) on what came out."""
    leads = resolve.merge(candidates, resolve.clusters(candidates, "batch"))
    return leads.where(F.coalesce(V.light_eligible(request), F.lit(False)))
