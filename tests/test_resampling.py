import random
import statistics

import numpy as np
import pytest

from velaspan.operators import resampling as R


def fixture(spark):
    conv = spark.createDataFrame([(m, f"c{i}") for m in ("m1", "m2") for i in range(5)], "model string, id string")
    out = spark.createDataFrame([(m, "c0", "PERSON", "tp") for m in ("m1", "m2")] + [(m, "c1", "LOCATION", "fn") for m in ("m1", "m2")] + [("m1", "c2", "PERSON", "fp")], "model string, id string, type string, outcome string")
    addr = spark.createDataFrame([(m, "c3", 10, 5, False) for m in ("m1", "m2")], "model string, id string, expected int, covered int, complete boolean")
    return conv, R.units(conv, out, addr)


def test_units_and_points(spark):
    _, u = fixture(spark)
    assert u.count() == 10
    p = {(r["model"], r["metric"]): r["estimate"] for r in R.point_estimates(u).collect()}
    assert p[("m1", "micro.precision")] == 0.5 and p[("m2", "micro.precision")] == 1.0 and p[("m1", "address.character_coverage")] == 0.5
    assert p[("m2", "LOCATION.precision")] is None


def by_force(spark, u, samples, metric="micro.precision"):
    """Values of a metric for samples of ids, conversation by conversation."""
    own = {(r["model"], r["id"]): r.asDict() for r in u.collect()}
    out = {}
    for model in ("m1", "m2"):
        for rep, ids in enumerate(samples):
            tp, fp = (sum(own[model, i][f"micro_{o}"] for i in ids) for o in ("tp", "fp"))
            out[model, rep] = tp / (tp + fp) if tp + fp else None
    return out


def test_sequential_draws_are_pythons(spark):
    _, u = fixture(spark)
    g = random.Random(3)
    want = by_force(spark, u, [g.choices([f"c{i}" for i in range(5)], k=5) for _ in range(40)])
    got = {(r["model"], r["rep"]): r["value"] for r in R.sequential(u, 40, 3).where("metric = 'micro.precision'").collect()}
    assert got == want


def mixed(x):
    m = 2**32 - 1
    x = ((x ^ x >> 16) * 0x7FEB352D) & m
    x = ((x ^ x >> 15) * 0x846CA68B) & m
    return x ^ x >> 16


def test_draws_are_those_of_brute_force(spark):
    _, u = fixture(spark)
    samples = [[f"c{mixed((mixed(9 + rep) + d) & 2**32 - 1) % 5}" for d in range(5)] for rep in range(30)]
    got = {(r["model"], r["rep"]): r["value"] for r in R.replicated(u, 30, 9).where("metric = 'micro.precision'").collect()}
    assert got == by_force(spark, u, samples)


def test_conversations_of_few_kinds_are_drawn_exactly(spark):
    conv = spark.createDataFrame([(m, f"c{i:03}") for m in ("m1", "m2") for i in range(300)], "model string, id string")
    out = spark.createDataFrame([(m, f"c{i:03}", "PERSON", "tp" if i * 7 % 10 < k else "fp") for m, k in (("m1", 6), ("m2", 4)) for i in range(300) if i % 9], "model string, id string, type string, outcome string")
    u = R.units(conv, out)
    samples = [[f"c{mixed((mixed(9 + rep) + d) & 2**32 - 1) % 300:03}" for d in range(300)] for rep in range(20)]
    got = {(r["model"], r["rep"]): r["value"] for r in R.replicated(u, 20, 9, exact=4).where("metric = 'micro.precision'").collect()}
    assert got == by_force(spark, u, samples)


def test_draws_in_several_blocks(monkeypatch):
    codes, reps = np.arange(1000, dtype=np.uint16) % 7, np.array([0, 3])
    want = [np.bincount([codes[mixed((mixed(5 + int(r)) + d) & 2**32 - 1) % 1000] for d in range(1000)], minlength=7).tolist() for r in reps]
    for size in (64, 1000, 5000):
        monkeypatch.setattr(R, "DRAWS", size)
        assert R.drawn(reps, codes, 7, 5).tolist() == want


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = R._poisson(R.mixed(np.arange(2000, dtype=np.uint64)), R.mixed(np.arange(500, dtype=np.uint64)))
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    conv = spark.createDataFrame([(m, f"c{i}") for m in ("m1", "m2") for i in range(400)], "model string, id string")
    out = spark.createDataFrame([(m, f"c{i}", "PERSON", "tp" if (i * 7) % 10 < k else "fp") for m, k in (("m1", 6), ("m2", 4)) for i in range(400)], "model string, id string, type string, outcome string")
    u = R.units(conv, out)
    near, far = (R.differences(R.replicated(u, 800, 5, exact=e), R.point_estimates(u), ["m1", "m2"]).where("metric = 'micro.f1'").first() for e in (None, 0))
    assert near["estimate"] == far["estimate"] and all(near[c] == pytest.approx(far[c], abs=0.02) for c in ("mean", "ci_lower", "ci_upper", "standard_error"))


def test_models_need_the_same_conversations(spark):
    _, u = fixture(spark)
    with pytest.raises(ValueError):
        R.replicated(u.where("not (model = 'm1' and id = 'c0')"), 5, 1)


def test_replicates_and_summary(spark):
    conv, u = fixture(spark)
    values = R.replicated(u, 50, 1)
    v = sorted(r["value"] for r in values.where("model = 'm1' and metric = 'micro.precision' and value is not null").collect())
    s = R.summary(values, R.point_estimates(u), ["model", "metric"]).where("model = 'm1' and metric = 'micro.precision'").first()
    assert s["mean"] == pytest.approx(statistics.fmean(v)) and s["variance"] == pytest.approx(statistics.variance(v)) and s["replicates_valid"] == len(v)
    pos = (len(v) - 1) * 0.025
    lo = v[int(pos)] + (v[int(pos) + 1] - v[int(pos)]) * (pos - int(pos))
    assert s["ci_lower"] == pytest.approx(lo)
    same = R.differences(values.where("model = 'm2'").union(values.where("model = 'm2'").replace("m2", "m1", "model")), R.point_estimates(u).where("model = 'm2'").union(R.point_estimates(u).where("model = 'm2'").replace("m2", "m1", "model")), ["m1", "m2"])
    assert all(r["estimate"] == r["mean"] == r["ci_lower"] == r["ci_upper"] == 0 for r in same.collect())
    d = R.differences(values, R.point_estimates(u), ["m1", "m2"]).where("metric = 'micro.f1'").first()
    assert d["estimate"] < 0 and (d["first"], d["second"]) == ("m1", "m2")
    assert "| m1 |" in R.markdown(R.summary(values, R.point_estimates(u), ["model", "metric"]))


def test_index_interval(spark):
    df = spark.createDataFrame([("m", float(i)) for i in range(100)], "model string, value double")
    r = R.index_interval(df, ["model"]).first()
    assert (r["lo"], r["hi"]) == (2.0, 96.0)


def test_registered_bootstrap_draws_the_references_replicates(spark, data):
    from velaspan.plans import queries as plans

    values, _ = plans._boot(spark, data)
    assert values.select("rep").distinct().count() == 10_000


def test_differences_draw_replicates_once(spark):
    _, u = fixture(spark)
    got = R.differences(R.replicated(u, 20, 1), R.point_estimates(u), ["m1", "m2"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {(r["first"], r["second"]) for r in got.collect()} == {("m1", "m2")}
    assert R.differences(R.replicated(u, 20, 1), R.point_estimates(u), ["m1"]).count() == 0
