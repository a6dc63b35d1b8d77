"""Claims and the evidence for them: scores, adjudication and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attachment_score(evidence: Column, prior: Column, contradictions: Column, source_classes: Column) -> Column:
    """0.15 at least, more with evidence, a prior, contradictions (they matter) and variety; 1 at most."""
    variety = F.least(F.lit(0.15), 0.05 * source_classes)
    return F.round(F.least(F.lit(1.0), 0.15 + 0.18 * evidence + 0.2 * prior + 0.08 * contradictions + variety), 3)


def band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.4, "medium").otherwise("low")


def pressure(contradictions: Column) -> Column:
    return F.round(F.least(F.lit(1.0), contradictions * 0.35), 3)


def confidence(score: Column, evidence: Column) -> Column:
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), 0.7 * score + F.least(F.lit(0.25), 0.06 * evidence))), 3)


def fragility(evidence: Column, prior: Column, contradictions: Column) -> Column:
    return F.when((evidence <= 1) & (prior > 0), "fragile").when(contradictions > 0, "contested").when(evidence >= 3, "supported").otherwise("watch")


def adjudicate(score: Column, evidence: Column, prior: Column, contradictions: Column, release: Column) -> Column:
    """The state of a claim; the first rule that holds decides."""
    p = pressure(contradictions)
    return (
        F.when(release == "retired", "retired").when((evidence <= 0) & (prior <= 0), "rejected").when((p >= 0.7) | (contradictions > 0) & (evidence <= 1), "contested")
        .when((prior > 0) & (evidence == 0), "tentative").when((release == "weakening") & (evidence < 4), "fragile").when((evidence <= 1) & ((prior > 0) | (score < 0.55)), "fragile")
        .when(p > 0, "fragile").when((score >= 0.75) & (evidence >= 3), "accepted").when((score >= 0.4) & (evidence >= 1), "tentative").otherwise("fragile")
    )
