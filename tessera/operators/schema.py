"""The request, and the schema of candidates."""

from __future__ import annotations

from dataclasses import dataclass, field

PHONES = "array<struct<value:string,raw_value:string,source_url:string,source_type:string>>"
EMAILS = "array<struct<value:string,verified:boolean,source_url:string,source_type:string>>"
EVIDENCE = "array<struct<field_name:string,value:string,source_type:string,source_url:string,confidence:double,context_snippet:string,timestamp:timestamp>>"
OPPORTUNITIES = "array<struct<service:string,service_display:string,confidence:string,signals:array<string>,evidence:array<string>,reason:string>>"
INTENT = "struct<source_url:string,text:string,source_type:string,confidence:string>"
#: One row is one candidate; cand_id is its place in order of arrival, which decides merges and early stops.
FIELDS = {
    "cand_id": "bigint", "source": "string", "name": "string", "normalized_name": "string", "website": "string", "domain": "string", "industry": "string",
    "description": "string", "about": "string", "address": "string", "services": "array<string>", "locations": "array<string>", "sources": "array<string>",
    "phone_numbers": PHONES, "emails": EMAILS, "social_profiles": "map<string,string>", "evidence": EVIDENCE, "is_historical": "boolean", "is_directory": "boolean",
    "lead_type": "string", "service_opportunities": OPPORTUNITIES, "service_requested": "string", "intent_confidence": "string", "short_reason": "string", "intent_evidence": INTENT,
}
CANDIDATE = ", ".join(f"{k} {v}" for k, v in FIELDS.items())


@dataclass
class Request:
    """What is looked for, and the limits of a job; limits are checked as the service's are."""

    industry: str
    locations: list[str]
    keywords: list[str] = field(default_factory=list)
    services: list[str] = field(default_factory=list)
    services_offered: list[str] = field(default_factory=list)
    lead_objective: str | None = None
    must_have: list[str] = field(default_factory=list)
    preferred: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    target_leads: int = 20
    max_candidates_checked: int = 250
    max_search_queries: int = 100
    max_runtime_minutes: float = 10.0
    enable_historical: bool = True
    max_domains_crawled: int = 10
    queries_per_location: int = 2

    def __post_init__(self):
        if not self.locations:
            raise ValueError("at least one location is needed")
        for name, low, high in (("target_leads", 1, 5000), ("max_candidates_checked", 1, 50_000), ("max_search_queries", 1, 10_000)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if not 0 < self.max_runtime_minutes <= 240:
            raise ValueError("max_runtime_minutes must be over 0 and at most 240")
