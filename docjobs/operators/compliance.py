"""Compliance of documents with a list of rules: a rule passes if the text holds any of its phrases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    description: str
    must_contain: tuple[str, ...]


# The rules for residential leases.
LEASE_RULES = (
    Rule("tx_prop_92_056", "Landlord's duty to repair or remedy", ("repair or remedy",)),
    Rule("tx_right_of_entry", "Right of entry conditions", ("notice",)),
    Rule("tx_security_deposit", "Security deposit return timeline (30 days)", ("30 days", "thirty days")),
)
JURISDICTION = "Texas, USA"


def check_compliance(docs: DataFrame, rules: tuple[Rule, ...] = LEASE_RULES) -> DataFrame:
    """doc_id, ord, rule_id, description, status; rules are part of the plan, so nothing is joined or shuffled."""
    low = F.lower(F.coalesce("text", F.lit("")))

    def one(n: int, r: Rule):
        hit = F.lit(False)
        for phrase in r.must_contain:
            hit = hit | F.col("_low").contains(phrase)
        return F.struct(F.lit(n).alias("ord"), F.lit(r.id).alias("rule_id"), F.lit(r.description).alias("description"), F.when(hit, "pass").otherwise("fail").alias("status"))

    checks = docs.select("doc_id", low.alias("_low")).select("doc_id", F.array(*(one(n, r) for n, r in enumerate(rules))).alias("checks"))
    return checks.select("doc_id", F.explode("checks").alias("c")).select("doc_id", "c.*")


def compliance_score(docs: DataFrame, rules: tuple[Rule, ...] = LEASE_RULES, jurisdiction: str = JURISDICTION) -> DataFrame:
    """doc_id, jurisdiction, compliance_score (0 to 100), checks in order; computed row by row."""
    low = docs.withColumn("_low", F.lower(F.coalesce("text", F.lit(""))))
    table = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.array(*map(F.lit, r.must_contain)).alias("phrases")) for r in rules))
    checks = F.transform(table, lambda r: F.struct(r["rule_id"].alias("rule_id"), F.when(F.exists(r["phrases"], lambda p: F.col("_low").contains(p)), "pass").otherwise("fail").alias("status")))
    out = low.select("doc_id", checks.alias("checks"))
    passed = F.size(F.filter("checks", lambda c: c["status"] == "pass"))
    return out.select("doc_id", F.lit(jurisdiction).alias("jurisdiction"), (passed / len(rules) * 100).alias("compliance_score"), "checks")


def contract_report(summary: DataFrame, compliance: DataFrame) -> DataFrame:
    """A row per contract: what verification and compliance found."""
    return summary.join(compliance, "doc_id")
