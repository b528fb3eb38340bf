"""The job store (K1-K16): Parquet tables partitioned by job, an append-only status log, and read projections."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.schema import Request
from tessera.plans import discovery

COUNTERS = ["raw_candidates", "candidates_checked", "accepted_leads", "rejected_candidates", "duplicates", "candidate_errors", "unique_businesses"]
STATUS = "job_id string, at timestamp, status string, created_at timestamp, completed_at timestamp, request string, errors string, " + ", ".join(f"{c} long" for c in COUNTERS)
TERMINAL = ["completed", "completed_partial", "failed"]


class JobStore:
    """Tables under one folder: jobs (the log), candidates, leads, rejections, outcomes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{name}")

    def _log(self, job_id: str, status: str, **values) -> None:
        now = datetime.now(UTC)
        done = now if status in TERMINAL else None
        row = {"job_id": job_id, "at": now, "status": status, "completed_at": done} | values
        fields = [f.split(" ")[0] for f in STATUS.split(", ")]
        self.spark.createDataFrame([tuple(row.get(f) for f in fields)], STATUS).write.mode("append").parquet(f"{self.folder}/jobs")

    def create_job(self, job_id: str, request: Request) -> None:
        """K1"""
        self._log(job_id, "pending", created_at=datetime.now(UTC), request=json.dumps(asdict(request)))

    def update_status(self, job_id: str, status: str, **values) -> None:
        """K4: fields that are not given keep their last value."""
        self._log(job_id, status, **values)

    def jobs(self) -> DataFrame:
        return latest(self.table("jobs"), "job_id", "at")

    def get_job(self, job_id: str) -> DataFrame:
        """K2"""
        return self.jobs().where(F.col("job_id") == job_id)

    def list_jobs(self, n: int = 50) -> DataFrame:
        """K3, O6"""
        return self.jobs().orderBy(F.desc("created_at")).limit(n)

    def save(self, name: str, job_id: str, rows: DataFrame) -> None:
        """Append a job's rows; a repeated save of one job replaces them."""
        out = rows.withColumn("job_id", F.lit(job_id))
        if name == "leads":
            out = out.withColumns({"primary_phone": X.first_of("phone_numbers")["value"], "confidence_score": F.lit(1.0)})
        if name == "candidates":
            out = out.withColumn("source_type", F.array_join("sources", ","))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(f"{self.folder}/{name}")

    def of_job(self, name: str, job_id: str) -> DataFrame:
        """K7, K8, K9: a job's rows by partition pruning; an unknown job has none."""
        rows = self.table(name).where(F.col("job_id") == job_id)
        return rows.orderBy("cand_id") if name == "rejections" else rows

    def lead(self, job_id: str, cand_id: int) -> DataFrame:
        """K7, K12"""
        return self.of_job("leads", job_id).where(F.col("cand_id") == cand_id).select("cand_id", "name", "website", "domain", "emails", "phone_numbers", "social_profiles", "evidence")

    def results(self, job_id: str) -> DataFrame:
        """K11"""
        return self.of_job("leads", job_id).select(*results_view())

    def run(self, job_id: str, candidates: DataFrame, pages: DataFrame | None, request: Request) -> str:
        """Run a job and save its tables; any failure marks it failed."""
        self.create_job(job_id, request)
        self.update_status(job_id, "running")
        try:
            got = discovery.run(candidates, pages, request)
            self.save("candidates", job_id, candidates)
            for name, key in (("leads", "leads"), ("rejections", "rejections"), ("outcomes", "ledger")):
                self.save(name, job_id, got[key])
            counts = got["counters"].first().asDict()
            status = "completed" if counts["accepted_leads"] >= request.target_leads else "completed_partial"
            self.update_status(job_id, status, raw_candidates=candidates.count(), unique_businesses=counts["accepted_leads"], **counts)
        except Exception as error:  # noqa: BLE001  the job's failure is its status
            self.update_status(job_id, "failed", errors=f"{type(error).__name__}: {error}"[:2000])
            return "failed"
        return status


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """K4: one row for each key: of every column its last value that was given."""
    others = [c for c in log.columns if c not in (key, order)]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others]
    return log.groupBy(key).agg(F.max(order).alias(order), *last)


def results_view() -> list[Column]:
    """K11"""
    told = F.coalesce(X.filled(F.col("about")), F.col("description"))
    return [
        F.col("name").alias("company_name"), "website", X.shortened(told, 200).alias("about"), X.first_of("phone_numbers")["value"].alias("phone"), X.first_of("emails")["value"].alias("email"),
        F.map_filter("social_profiles", lambda k, v: v.isNotNull()).alias("contact"), "lead_type", "short_reason", "service_opportunities",
    ]


def status_view(jobs: DataFrame) -> DataFrame:
    """Counters that were never given read as 0."""
    return jobs.select("job_id", "status", "created_at", "completed_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS])


def newest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """O6 for groups: the n newest rows of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__n") <= n).drop("__n")
