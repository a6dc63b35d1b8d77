"""Importance, recency and composite scores on columns. Tables are fixed values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS = {"preference": 365.0, "decision": 180.0, "fact": 120.0, "entity": 120.0, "plan": 60.0, "learning": 180.0, "event": 14.0, "note": 30.0, "tool": 30.0}
IMPORTANCE_WEIGHTS = {"must_remember": 1.2, "nice_to_have": 1.0, "unknown": 1.0, "ignore": 0.8}
STATE_GATES = {"active": 1.0, "captured": 1.0, "categorized": 1.0, "consolidated": 0.9, "stale": 0.5, "soft-archived": 0.0, "archived": 0.0}
P1_KINDS = ("preference", "decision", "fact", "learning", "plan", "entity")
#: Legal lifecycle changes.
TRANSITIONS = (("captured", "categorized"), ("categorized", "active"), ("active", "consolidated"), ("active", "stale"), ("consolidated", "active"), ("consolidated", "stale"), ("stale", "active"), ("stale", "soft-archived"), ("soft-archived", "active"))
LINK_MODEL = {  # mode: base, cap and weights of events, shared, recency, lexical, tokens
    "receipt_co_selection": (0.62, 0.95, (0.16, 0.12, 0.08, 0.07, 0.05)),
    "lexical_backfill_low_confidence": (0.30, 0.55, (0.0, 0.0, 0.0, 0.18, 0.10)),
    "lexical_fallback": (0.46, 0.78, (0.0, 0.0, 0.0, 0.20, 0.11)),
}


def looked_up(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key], F.lit(default))


def age_days(ts: Column, now: Column) -> Column:
    return F.when(ts.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400.0))


def unused_days(reference: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(reference)) / 86400)).cast("long")


def composite(relevance: Column, label: Column, kind: Column, ts: Column, used_count: Column, state: Column, now: Column) -> Column:
    """relevance * importance * 0.5 ** (age / half-life) * use boost * state gate; ``now`` counts from midnight."""
    day = F.date_trunc("day", now)
    decay = F.pow(F.lit(0.5), age_days(ts, day) / looked_up(HALF_LIFE_DAYS, F.lower(F.trim(F.coalesce(kind, F.lit("note")))), 30.0))
    boost = F.least(F.lit(1.3), 1.0 + 0.1 * F.log1p(F.greatest(F.lit(0), F.coalesce(used_count, F.lit(0))).cast("double")))
    return F.greatest(F.lit(0.0), relevance) * looked_up(IMPORTANCE_WEIGHTS, label, 1.0) * decay * boost * looked_up(STATE_GATES, state, 1.0)


def label_of(score: Column) -> Column:
    """must_remember from 0.8, nice_to_have from 0.5, else ignore; null stays unknown."""
    return F.when(score.isNull(), "unknown").when(score >= 0.80, "must_remember").when(score >= 0.50, "nice_to_have").otherwise("ignore")


def parse_importance(raw: Column) -> Column:
    """A score from "0.86", "86", "86%", "86/100" or a label; clamped to 0..1, null if none."""
    t = F.lower(F.trim(raw))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)$", 1).try_cast("double")
    percent = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?) ?(?:%|/ ?100)$", 1).try_cast("double") / 100
    whole = F.when((number > 1) & (number <= 100) & (number == F.floor(number)), number / 100).otherwise(number)
    key = F.regexp_replace(t, "[ -]", "_")
    label = F.when(key.isin("ignore", "low"), 0.0).when(key.isin("nice_to_have", "medium"), 0.5).when(key.isin("must_remember", "high"), 0.8)
    found = F.coalesce(percent, whole, label)
    return F.when(found.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), found)))


def priority(kind: Column, explicit: Column) -> Column:
    """P0, P1 or P2 as said, else P1 for the kinds that last, P2 otherwise."""
    said = F.upper(F.trim(F.coalesce(explicit, F.lit(""))))
    return F.when(said.isin("P0", "P1", "P2"), said).when(F.lower(F.trim(kind)).isin(*P1_KINDS), "P1").otherwise("P2")


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def link_confidence(mode: str, events: Column, shared: Column, recency: Column, lexical: Column, tokens: Column) -> Column:
    base, cap, weights = LINK_MODEL[mode]
    parts = (unit(events / 3.0), unit(shared / 2.0), unit(recency), unit(lexical), unit(tokens / 4.0))
    total = sum((F.round(w * p, 3) for w, p in zip(weights, parts, strict=True)), F.lit(base))
    return F.round(F.least(F.lit(cap), F.round(total, 3)), 3)
