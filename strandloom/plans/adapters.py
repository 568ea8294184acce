"""Where a run's adapters come from: a FASTA file, the catalog reduced by presence, or inference."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame

from ..operators import detect, infer
from ..sources.catalog import Adapter, catalog
from .model import AdapterPlan, Plan

SAMPLE = 40_000
POLICIES = ("conservative", "aggressive")


def preset(reads: DataFrame, plan: Plan, order: list[str]) -> Plan:
    """plan with the catalog; with a sample, only with the adapters that act in it."""
    rules = replace(plan.adapters or AdapterPlan(), adapters=tuple(catalog()))
    if plan.sample:
        rules = replace(rules, adapters=detect.present(detect.prefix_sample(reads, plan.sample, order), rules))
    return replace(plan, adapters=rules)


def from_fasta(plan: Plan, adapters: list[Adapter]) -> Plan:
    """plan with the adapters of a FASTA file, all of which are searched: detection is for the catalog only."""
    if plan.sample:
        raise ValueError("presence detection is for the catalog, not for an adapter FASTA")
    return replace(plan, adapters=replace(plan.adapters or AdapterPlan(), adapters=tuple(adapters)))


def inferred(reads: DataFrame, plan: Plan, order: list[str], policy: str = "conservative", known: tuple = (), sample: int = SAMPLE) -> tuple[Plan, list[infer.Inferred]]:
    """plan with inferred adapters, and what was found.

    The conservative policy only trims ends; the aggressive one also splits where the plan does.
    known: adapters of a FASTA file, only for naming what is found."""
    if policy not in POLICIES:
        raise ValueError(f"unknown inference policy {policy!r}")
    if plan.adapters and plan.adapters.adapters:
        raise ValueError("trimming by inferred adapters excludes other adapters")
    rules = plan.adapters or AdapterPlan()
    conservative = policy == "conservative"
    found = infer.infer(detect.prefix_sample(reads, sample, order), [*catalog(), *known], rules.error_rate, conservative, tuple(order))
    if not found:
        warnings.warn("no adapter was inferred; reads stay untrimmed", stacklevel=2)
    for x in found:
        if x.support < infer.MARGINAL:
            warnings.warn(f"{x.adapter.name} has marginal support ({x.support:.2f})", stacklevel=2)
    rules = replace(rules, adapters=tuple(x.adapter for x in found), split=rules.split and not conservative)
    return replace(plan, adapters=rules), found


def describe(plan: Plan) -> list[str]:
    """The plan in words, one step a line; a plan that changes nothing says so."""
    t, f, a = plan.trim, plan.filters, plan.adapters
    lines = [f"crop {t.head} from the head and {t.tail} from the tail"] if t.head or t.tail else []
    if a and a.adapters:
        lines.append(f"remove {len(a.adapters)} adapters (error rate {a.error_rate:g}, ends of {a.end_size} bases, {'ends and interior' if a.split else 'ends only'})")
    if t.quality:
        lines.append(f"quality {t.quality.kind} at {t.quality.cutoff}" + (f", window {t.quality.window}" if t.quality.kind == "split" else ""))
    bounds = [f"length {f.min_length} to {f.max_length or 'any'}"] if f.min_length > 1 or f.max_length else []
    bounds += [f"{f.mode} quality {f.min_quality:g} to {f.max_quality:g}"] if f.needs_quality else []
    bounds += [f"GC {f.min_gc or 0:g} to {1 if f.max_gc is None else f.max_gc:g}"] if f.needs_gc else []
    return [*lines, *(["keep segments with " + ", ".join(bounds)] if bounds else [])] or ["nothing to do: reads pass unchanged"]
