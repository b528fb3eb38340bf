"""Query expansion (X18-X21, J12, U2, O3, O4): subjects, locations and templates as small joined tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import text as X
from tessera.operators.schema import Request
from tessera.operators.signals import service_keys

FAMILIES = ["basic", "service", "contact", "intent", "dork", "social_dork"]


def _templates(r: Request) -> list[tuple[str, str, str]]:
    """Family, query and purpose of every query of one location, in order; {} is the location."""
    industry, kept = r.industry.strip(), [k.strip() for k in r.keywords if k.strip()]
    subjects = [industry]
    subjects += [k for i, k in enumerate(kept) if k.lower() != industry.lower() and k not in kept[:i]]
    out = [x for t in subjects for x in (("basic", f"{t} {{}}", f"Basic lookup for {t}"), ("basic", f"best {t} in {{}}", f"Best rated {t}"))]
    for s in (s.strip() for s in r.services if s.strip()):
        out += [("service", f"{s} {{}}", f"Service search for {s}"), *(("service", f"{t} {s} {{}}", f"{t} providing {s}") for t in subjects[:2])]
    out += [("contact", f"{t} {{}} {x}", f"Contact lookup: {x}") for t in subjects[:2] for x in K.CONTACT_SUFFIXES]
    goal = (r.lead_objective or "").strip().lower()
    if "website" in goal or "web design" in goal:
        out.append(("intent", f"{industry} {{}} website", "Website discovery"))
    if "seo" in goal or "marketing" in goal:
        out.append(("intent", f"{industry} in {{}} reviews", "Reviews & marketing presence"))
    out.append(("intent", f'{industry} {{}} "book appointment"', "Booking intent"))
    for t in subjects[:2]:
        out += [("dork", f'"{t}" "{{}}" {x}', f"{p} dork") for x, p in (('"contact"', "Exact contact"), ('"email"', "Exact email"), ("inurl:contact", "Inurl contact page"))]
        out += [("social_dork", f'site:{site} "{t}" "{{}}"', f"{p} dork") for site, p in (("instagram.com", "Instagram public profile"), ("facebook.com", "Facebook public profile"), ("linkedin.com/company", "LinkedIn company"))]
    return out


def _locations(spark: SparkSession, r: Request) -> DataFrame:
    rows = [(i, x.strip()) for i, x in enumerate(r.locations) if x.strip()]
    return spark.createDataFrame(rows, "loc int, location string")


def _distinct(rows: DataFrame) -> DataFrame:
    """The first of equal queries, whatever their case."""
    w = Window.partitionBy(F.lower("query")).orderBy("loc", "seq")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def queries(spark: SparkSession, r: Request) -> DataFrame:
    """loc, seq, location, family, query, target_intent, query_type of all discovery queries."""
    rows = [(i, f, q, p) for i, (f, q, p) in enumerate(_templates(r))]
    templates = spark.createDataFrame(rows, "seq int, family string, template string, target_intent string")
    met = _locations(spark, r).crossJoin(F.broadcast(templates))  # a request's few locations and templates
    out = met.withColumn("query", F.trim(F.replace("template", F.lit("{}"), F.col("location")))).where("query != ''")
    return _distinct(out.select("loc", "seq", "location", "family", "query", "target_intent", F.lit("business_discovery").alias("query_type")))


def intent_queries(spark: SparkSession, r: Request) -> DataFrame:
    """Queries for businesses that ask for help, eight to a service and location, and four on the industry."""
    rows = []
    for raw in r.services_offered:
        for key in service_keys([raw]):
            words = K.SERVICE_KEYWORDS[key][:3]
            rows += [(f'"{p}" "{words[i % len(words)]}" "{{}}"', f"Explicit intent for {words[i % len(words)]}: {p}", "explicit_intent", key, p) for i, p in enumerate(K.INTENT_MODIFIERS[:8])]
    if r.industry:
        rows += [(f'"{r.industry}" "{p}" "{{}}"', f"Industry intent for {r.industry}: {p}", "industry_intent", None, p) for p in K.INTENT_MODIFIERS[:4]]
    templates = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "seq int, template string, target_intent string, query_type string, service string, phrase string")
    met = _locations(spark, r).crossJoin(F.broadcast(templates))
    out = met.withColumn("query", F.trim(F.replace("template", F.lit("{}"), F.col("location"))))
    return _distinct(out.select("loc", "seq", "location", F.lit("explicit_intent").alias("family"), "query", "target_intent", "query_type", "service", X.intent_type("phrase").alias("intent_type")))


def round_robin(rows: DataFrame, per_location: int, most: int, families: list[str] = FAMILIES) -> DataFrame:
    """O3: per location, families in turn, at most per_location; passes run until `most` are taken, and a begun pass ends.

    rows: loc, seq, family and more. Adds pass, the number of a location's turn through the families.
    """
    rank = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    rows = rows.withColumn("rank", rank).where("rank > 0").withColumn("pass", F.row_number().over(Window.partitionBy("loc", "family").orderBy("seq")))
    own = F.row_number().over(Window.partitionBy("loc").orderBy("pass", "rank"))
    rows = rows.withColumn("own", own).where(F.col("own") <= per_location)
    # A request's queries: locations times per_location, a few thousand rows at most.
    passes = rows.groupBy("loc", "pass").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("loc", "pass").rowsBetween(Window.unboundedPreceding, -1))
    open_ = passes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).select("loc", "pass")
    return rows.join(open_, ["loc", "pass"]).drop("rank", "own")


def head_per(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """O4"""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def planned(spark: SparkSession, r: Request) -> DataFrame:
    """The queries that a job asks: families in turn, within the request's limits for a location and in all."""
    return round_robin(queries(spark, r), r.queries_per_location, r.max_search_queries)


def total_queries(spark: SparkSession, r: Request) -> DataFrame:
    """How many queries a job has by their type, the businesses it looks for and those that ask for help."""
    both = planned(spark, r).select("query_type").unionByName(intent_queries(spark, r).select("query_type"))
    return both.groupBy("query_type").agg(F.count(F.lit(1)).alias("total_queries"))
