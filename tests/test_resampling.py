"""The resampling queries with the reference's counts of replicates, side by side with SQL of the same counts."""

from __future__ import annotations

import pytest

from wayfield.operators import events as E
from wayfield.plans import registry, studies

from .oracle import TESTDATA, difference

SMALL = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize(("name", "many"), [("sta11_supply_bootstrap", 2_000), ("sta12_demand_bootstrap", 2_000), ("sta15_paired_bootstrap", 10_000), ("sta17_sign_flip_by_cluster", 10_000)])
def test_resampling_has_the_reference_s_replicates(spark, name, many):
    assert f"range({many})" in registry.SQL[name]
    assert difference(spark, registry.QUERIES[name], registry.SQL[name], SMALL) == ""


def test_demand_bootstrap_has_all_events(spark):
    assert {r.event for r in registry.QUERIES["sta12_demand_bootstrap"](spark, SMALL).collect()} == set(E.EVENTS)


def test_metric_bootstrap_draws_a_thousand_times(spark, monkeypatch):
    asked = []
    own = studies.X.resampled
    monkeypatch.setattr(studies.X, "resampled", lambda *a: asked.append(a[-1]) or own(*a))
    assert registry.QUERIES["sta10_metric_bootstrap"](spark, SMALL).columns == ["model_id", "metric", "lo", "hi", "se"] and asked == [1_000]


def test_cluster_bootstrap_draws_whole_clusters(spark):
    """Of the replicates that a plain loop over the same draws makes, from the four arms' rows."""
    import hashlib
    from collections import defaultdict

    from wayfield.plans import stars

    nation = {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{SMALL}/customer.parquet").select("c_custkey", "c_nationkey").collect()}
    by = defaultdict(list)
    for r in stars.paired(spark, SMALL).collect():
        by[nation[r.instance]].append((r.hot - r.base) - (r.note - r.shuffled))
    d = [sum(by[c]) / len(by[c]) for c in sorted(by)]
    at = lambda rep, slot: int(hashlib.md5(f"7|{rep}|{slot}|0".encode()).hexdigest()[:8], 16) % len(d)
    xs = sorted(sum(d[at(rep, slot)] for slot in range(len(d))) / len(d) for rep in range(10_000))
    (got,) = registry.QUERIES["sta16_cluster_bootstrap"](spark, SMALL).collect()
    assert (got.lo, got.mid, got.hi) == pytest.approx((xs[250], xs[5000], xs[9750]), abs=2e-6) and got.n_replicates == 10_000


def plain_draw(*parts) -> int:
    import hashlib

    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_numbered_draws_are_md5():
    from wayfield.functions.md5 import Numbered

    for n in (1, 10, 11, 1005, 17_000):
        numbered = Numbered(n)
        for before, after in (("7|0|", ""), ("7|9999|", "|b3"), ("7|1|", "|" + "x" * 60)):
            assert numbered.draws(before, after).tolist() == [plain_draw(f"{before}{k}{after}") for k in range(n)]


def test_draws_are_not_joined_with_their_units(spark):
    """Exploded slots, which planners take for small, were broadcast; now a draw reads its unit in its own row."""
    from pyspark.sql import functions as F

    from wayfield.operators import stats as X

    rows = [(g, k, float(k * k)) for g in ("a", "b") for k in range(12)]
    units = spark.createDataFrame(rows, "g string, k long, x double")
    drawn = X.resampled(units, ["g"], ["k"], 5)
    assert "Join" not in drawn._jdf.queryExecution().executedPlan().toString()
    want = sorted((g, rep, slot, plain_draw(7, rep, slot, g) % 12) for g in ("a", "b") for rep in range(5) for slot in range(12))
    assert sorted((r.g, r.rep, r.slot, r.k) for r in drawn.collect()) == want
    sums = X.resampled_sums(units, ["g"], ["k"], ["x"], 5, lambda own: {"s": own["x"]}, ["s"], chunk=2)
    assert {(r.g, r.rep): (r.n, r.s) for r in sums.collect()} == {(g, rep): (12, sum(float(k * k) for a, b, _, k in want if (a, b) == (g, rep))) for g in ("a", "b") for rep in range(5)}
    assert X.resampled_sums(units.where("k < 0"), [], ["k"], ["x"], 5, lambda own: {"s": own["x"]}, ["s"]).count() == 0 and drawn.agg(F.count("x")).first()[0] == 120
