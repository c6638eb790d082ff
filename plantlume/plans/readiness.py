"""Waivers, domain states, overall readiness and the publication gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag, lenient_timestamp, lookup
from ..operators.joins import latest_valid, one_row
from ..operators.ordering import top_rows
from ..operators.tables import literal_table

# Validation domains and the order of usage levels.
DOMAINS = (
    "structural validity",
    "semantic validity",
    "analytical validity",
    "financial validity",
    "decision validity",
    "release validity",
    "committee-readiness validity",
)
USAGE_LEVELS = {
    "screening-grade-only": 1,
    "decision-support-only": 2,
    "not-committee-grade": 3,
    "committee-candidate": 4,
    "committee-grade": 5,
}
SEVERITIES = {"BLOCKER": 4, "CRITICAL": 3, "HIGH": 2, "WARNING": 1}


def waiver_status(as_of: str, usage: str) -> Column:
    """Status of a waiver row on a date for a usage level; ``applied`` means it holds."""
    expiry = lenient_timestamp("fecha_caducidad").cast("date")
    active = F.lower(F.trim(F.coalesce("estado", F.lit("")))).isin("activo", "active")
    allowed = lookup(F.trim("nivel_maximo_permitido_uso"), USAGE_LEVELS, 0)
    return (
        F.when(~active, "inactive")
        .when(expiry.isNull(), "invalid_expiry")
        .when(expiry < F.lit(as_of).cast("date"), "expired")
        .when(F.lit(USAGE_LEVELS.get(usage, 0)) > allowed, "scope_exceeded")
        .otherwise("applied")
    )


def evaluate_waivers(waivers: DataFrame, as_of: str, usage: str) -> DataFrame:
    """All waivers with their status."""
    return waivers.withColumns(
        {"evaluated_for_usage_level": F.lit(usage), "waiver_status": waiver_status(as_of, usage)}
    ).withColumn("applied_flag", flag(F.col("waiver_status") == "applied"))


def effective_issues(checks: DataFrame, waivers: DataFrame, as_of: str, usage: str) -> DataFrame:
    """Checks that are not OK with the newest waiver of their issue applied."""
    rated = evaluate_waivers(waivers, as_of, usage).select(
        "issue_id", "waiver_id", "waiver_status", "applied_flag", "fecha_caducidad"
    )
    joined = latest_valid(checks.where("status <> 'OK'"), rated, "issue_id", "fecha_caducidad", ["waiver_id"])
    applied = F.coalesce(F.col("applied_flag"), F.lit(0))
    return joined.withColumns(
        {
            "waived_flag": applied,
            "waiver_id": F.coalesce("waiver_id", F.lit("")),
            "waiver_status": F.coalesce("waiver_status", F.lit("no_waiver")),
            "effective_status": F.when(applied == 1, "WAIVED").otherwise(F.col("status")),
        }
    ).drop("applied_flag", "fecha_caducidad")


def active_exceptions(issues: DataFrame) -> DataFrame:
    return issues.where("waived_flag = 1 AND effective_status = 'WAIVED'")


def _open(severity: str, statuses: tuple[str, ...] = ("ERROR", "WARN")) -> Column:
    return F.count_if((F.col("severity") == severity) & F.col("effective_status").isin(*statuses))


def evidence_grade() -> Column:
    return (
        F.when(F.col("open_blocker") > 0, "D")
        .when(F.col("open_critical") > 0, "C")
        .when(F.col("open_high") > 0, "B")
        .otherwise("A")
    )


def _state() -> Column:
    serious = (F.col("open_critical") > 0) | (F.col("open_high") > 0)
    d = F.col("domain")
    return (
        F.when(F.col("open_blocker") > 0, "publish-blocked")
        .when(d.isin("structural validity", "semantic validity", "release validity"), "structurally-valid")
        .when(d == "analytical validity", "analytically-acceptable")
        .when(d == "financial validity", F.when(serious, "screening-grade-only").otherwise("committee-candidate"))
        .when(d == "decision validity", F.when(serious, "decision-support-only").otherwise("committee-candidate"))
        .when(
            d == "committee-readiness validity",
            F.when(serious, "not-committee-grade")
            .when(F.col("open_warning") > 0, "committee-candidate")
            .otherwise("committee-grade"),
        )
        .otherwise("analytically-acceptable")
    )


COUNTS = ("open_blocker", "open_critical", "open_high", "open_warning", "waived_issues")


def domain_states(issues: DataFrame) -> DataFrame:
    """Open issues and state of every validation domain."""
    counted = issues.groupBy("domain").agg(
        _open("BLOCKER", ("ERROR",)).alias("open_blocker"),
        _open("CRITICAL").alias("open_critical"),
        _open("HIGH").alias("open_high"),
        _open("WARNING").alias("open_warning"),
        F.count_if(F.col("waived_flag") == 1).alias("waived_issues"),
    )
    domains = literal_table(issues.sparkSession, [(d,) for d in DOMAINS], "domain string")
    return (
        domains.join(counted, "domain", "left")
        .fillna(0, list(COUNTS))
        .withColumns({"state": _state(), "evidence_grade": evidence_grade()})
    )


def readiness_summary(states: DataFrame, issues: DataFrame) -> DataFrame:
    """Overall readiness, committee state, publish decision and evidence grade in one row."""

    def state_of(domain: str) -> Column:
        return F.max(F.when(F.col("domain") == domain, F.col("state")))

    row = states.agg(
        state_of("financial validity").alias("financial"),
        state_of("decision validity").alias("decision_state"),
        state_of("analytical validity").alias("analytical"),
        state_of("committee-readiness validity").alias("committee"),
        F.count_if(
            F.col("domain").isin("structural validity", "semantic validity", "release validity")
            & (F.col("state") == "publish-blocked")
        ).alias("blocked"),
    )
    counts = issues.agg(
        _open("BLOCKER", ("ERROR",)).alias("open_blocker"),
        _open("CRITICAL").alias("open_critical"),
        _open("HIGH").alias("open_high"),
        F.count_if(F.col("effective_status").isin("ERROR", "WARN")).alias("open_risks_count"),
    )
    joined = row.withColumn("__c", one_row(counts)).select(*row.columns, "__c.*")
    fin, dec, com = F.col("financial"), F.col("decision_state"), F.col("committee")
    overall = (
        F.when(F.col("blocked") > 0, "publish-blocked")
        .when(
            (com == "committee-grade") & (fin == "committee-candidate") & (dec == "committee-candidate"),
            "committee-grade",
        )
        .when(
            (com == "committee-candidate")
            & fin.isin("committee-candidate", "screening-grade-only")
            & dec.isin("committee-candidate", "decision-support-only"),
            "committee-candidate",
        )
        .when(com == "not-committee-grade", "not-committee-grade")
        .when(dec == "decision-support-only", "decision-support-only")
        .when(fin == "screening-grade-only", "screening-grade-only")
        .when(F.col("analytical") == "analytically-acceptable", "analytically-acceptable")
        .otherwise("structurally-valid")
    )
    leveled = joined.withColumn("overall_readiness_level", overall)
    level = F.col("overall_readiness_level")
    committee = F.when(level.isin("committee-grade", "committee-candidate"), level).otherwise("not-committee-grade")
    publish = (
        F.when(F.col("open_blocker") > 0, "no publish")
        .when(level.isin("committee-grade", "committee-candidate") & (F.col("open_critical") == 0), "publish")
        .otherwise("publish with caveat")
    )
    return leveled.select(
        F.when(F.col("blocked") > 0, "publish-blocked").otherwise("structurally-valid").alias("technical_state"),
        "decision_state",
        committee.alias("committee_readiness_state"),
        com.alias("committee_readiness_domain_state"),
        "overall_readiness_level",
        evidence_grade().alias("evidence_grade"),
        publish.alias("publish_decision"),
        F.col("open_blocker").alias("unwaived_blockers"),
        F.col("open_critical").alias("unwaived_critical"),
        F.col("open_high").alias("unwaived_high"),
        "open_risks_count",
        flag(
            committee.isin("committee-candidate", "committee-grade")
            & (publish == "publish")
            & (F.col("open_blocker") == 0)
        ).alias("committee_presentation_allowed"),
    )


def top_open_risks(issues: DataFrame, k: int = 8) -> DataFrame:
    """Most severe open issues first."""
    order = [
        lookup("effective_status", {"ERROR": 3, "WARN": 2, "WAIVED": 1}, 0).desc(),
        lookup("severity", SEVERITIES, 0).desc(),
        F.asc("issue_id"),
    ]
    return top_rows(issues, order, k).select(
        "issue_id", "domain", "severity", "check", "effective_status", "waived_flag", "waiver_id"
    )


def publication_gate(policies: DataFrame, summary: DataFrame) -> DataFrame:
    """Which release profiles the current readiness allows.

    ``policies`` has ``profile``, ``states`` and ``decisions`` (arrays; empty allows all).
    """
    now = summary.select("overall_readiness_level", "publish_decision")
    joined = policies.withColumn("__r", one_row(now)).select("profile", "states", "decisions", "__r.*")

    def passes(allowed: str, value: str) -> Column:
        return (F.size(allowed) == 0) | F.array_contains(F.col(allowed), F.col(value))

    ok = passes("states", "overall_readiness_level") & passes("decisions", "publish_decision")
    reason = F.when(ok, "allowed").otherwise(
        F.concat(
            F.lit("blocked_by_governance: readiness="), "overall_readiness_level",
            F.lit("; publish_decision="), "publish_decision",
        )
    )
    return joined.select("profile", flag(ok).alias("allowed"), reason.alias("reason"))


def release_policies(document: DataFrame) -> DataFrame:
    """Policy document as one row per profile."""
    none = F.array().cast("array<string>")
    return document.select(F.explode("profiles").alias("profile", "value")).select(
        "profile",
        F.coalesce(F.col("value.governance.require_readiness_states"), none).alias("states"),
        F.coalesce(F.col("value.governance.require_publish_decisions"), none).alias("decisions"),
    )
