"""Presence detection, inference policies and the description of plans."""

import numpy as np
import pytest
from strandloom.operators import detect
from strandloom.plans import adapters as p
from strandloom.plans.model import AdapterPlan, FilterPlan, Plan, QualityOp, TrimPlan
from strandloom.sources.catalog import Adapter

P, Q = Adapter("p", "GGGGTTTTGGGGTTTTACGT", "5"), Adapter("q", "CCACCACCACCAGGAGGAGG", "5")
SCHEMA = "name string, seq string"


def reads(spark, n, front, seed=1, share=1.0):
    r = np.random.default_rng(seed)
    dna = lambda k: "".join(r.choice(list("ACGT"), k))
    return spark.createDataFrame([(f"r{i:04d}", (front if r.random() < share else "") + dna(120)) for i in range(n)], SCHEMA)


def test_presence(spark):
    assert [detect.presence_minimum(n) for n in (0, 1000, 10_000)] == [3, 3, 20]
    plan = AdapterPlan((P, Q), end_size=30)
    sample = reads(spark, 200, P.seq)
    assert detect.present(sample, plan) == (P,)
    assert detect.present(sample.limit(99), plan) == (P, Q)
    with pytest.warns(UserWarning):
        assert detect.present(reads(spark, 120, ""), AdapterPlan((Q,), error_rate=0.0, end_size=30)) == (Q,)


def test_inference_policies(spark):
    data = reads(spark, 300, "AATGTACTTCGTTCAGTTACGTATTGCT")
    plan, found = p.inferred(data, Plan(), ["name"])
    assert found and plan.adapters.adapters[0].name == "inferred_1" and not plan.adapters.split
    assert "LSK109_front" in [n for n, _ in found[0].names]
    assert p.inferred(data, Plan(), ["name"], "aggressive")[0].adapters.split
    with pytest.warns(UserWarning, match="no adapter"):
        assert p.inferred(data.limit(2), Plan(), ["name"])[0].adapters.adapters == ()
    with pytest.warns(UserWarning, match="marginal"):
        p.inferred(reads(spark, 400, "AATGTACTTCGTTCAGTTACGTATTGCT", share=0.38), Plan(), ["name"])
    with pytest.raises(ValueError):
        p.inferred(data, Plan(adapters=AdapterPlan((P,))), ["name"])
    with pytest.raises(ValueError):
        p.inferred(data, Plan(), ["name"], "bold")


def test_sources_and_description(spark):
    assert len(p.preset(reads(spark, 5, ""), Plan(), ["name"]).adapters.adapters) == 124
    assert p.from_fasta(Plan(), [P]).adapters.adapters == (P,)
    with pytest.raises(ValueError):
        p.from_fasta(Plan(sample=200), [P])
    assert p.describe(Plan()) == ["nothing to do: reads pass unchanged"]
    assert len(p.describe(Plan(TrimPlan(1, 2, QualityOp("split", 20, 3)), FilterPlan(5, 9, 10, min_gc=0.2), AdapterPlan((P,))))) == 4
