import hashlib

import numpy as np
import pytest

from tests.helpers import bars_of, random_bars, to_spark
from tidemark.operators import tournament as to
from tidemark.plans import Layout

PLAN = to.Plan(sizes=(3, 5, 8), penalties=(0.0, 0.5), eta=2, rungs=3)


def brute(pdf, plan):
    rows = []
    for name, g in pdf.groupby("series_id"):
        y = g.close.to_numpy()
        at = round(len(y) * 0.8)
        y, h = y[:at], [hashlib.md5(f"{name}/{d}".encode()).hexdigest()[:8] for d in g.dt[:at]]
        alive = {}
        for rung, (budget, limit) in enumerate(zip(plan.budgets(), plan.limits(), strict=True)):
            for b, first, k, p in plan.entrants():
                if first == rung:
                    alive.setdefault(b, []).append((k, p))
            for b, cells in alive.items():
                tried = []
                for k, p in cells:
                    x = np.array([y[i - k : i].mean() for i in range(k, at)])
                    late = np.arange(1, at - k + 1) > np.floor((at - k) * 0.8)
                    used = ~late & np.array([v < limit for v in h[k:]])
                    fx, fy = x[used], y[k:][used]
                    a = np.cov(fx, fy, bias=True)[0, 1] / (fx.var() * (1 + p))
                    tried.append((((y[k:][late] - fy.mean() - a * (x[late] - fx.mean())) ** 2).mean(), k, p, int(used.sum())))
                tried.sort()
                keep = 1 if rung + 1 == plan.rungs else max(1, len(tried) // plan.eta)
                rows += [(name, b, rung, k, p, round(budget, 9), n, round(loss, 6), i < keep) for i, (loss, k, p, n) in enumerate(tried)]
                alive[b] = [(k, p) for _, k, p, _ in tried[:keep]]
    return sorted(rows)


@pytest.mark.parametrize("chunk", [None, 64])
def test_rungs_equal_brute_force(spark, chunk):
    pdf = random_bars(8, {"a": 400, "b": 220})
    got = to.tournament(to_spark(spark, pdf), PLAN, decimals=2, layout=Layout(chunk_rows=chunk)).collect()
    rows = sorted((r.series_id, r.bracket, r.rung, r.inputs, r.penalty, round(r.budget, 9), r.n_train, round(r.val_loss, 6), r.promoted) for r in got)
    want = brute(pdf, PLAN)
    assert [r[:7] + r[8:] for r in rows] == [r[:7] + r[8:] for r in want]
    assert np.allclose([r[7] for r in rows], [r[7] for r in want], rtol=1e-6, atol=1e-5)


def test_plan():
    assert PLAN.budgets() == [0.25, 0.5, 1.0] and PLAN.limits() == ["40000000", "80000000", "g"]
    entrants = PLAN.entrants()
    assert [sum(e[0] == b for e in entrants) for b in range(3)] == [6, 4, 4] or len(entrants) > 6
    assert all(first == b for b, first, *_ in entrants)
    assert to.Plan(rungs=1).budgets() == [1.0] and to.Plan(rungs=1).limits() == ["g"]


def test_each_rung_promotes_and_winners_follow(spark):
    pdf = random_bars(9, {"a": 500})
    out = to.tournament(to_spark(spark, pdf), PLAN).cache()
    rows = out.collect()
    for b in {r.bracket for r in rows}:
        for rung in range(b, PLAN.rungs):
            here = [r for r in rows if (r.bracket, r.rung) == (b, rung)]
            promoted = {(r.inputs, r.penalty) for r in here if r.promoted}
            later = {(r.inputs, r.penalty) for r in rows if (r.bracket, r.rung) == (b, rung + 1)}
            assert later in (promoted, set()) and len(promoted) == (1 if rung + 1 == PLAN.rungs else max(1, len(here) // 2))
            assert max(r.val_loss for r in here if r.promoted) <= min([r.val_loss for r in here if not r.promoted], default=np.inf)
    last = [r for r in rows if r.rung == 2 and r.promoted]
    win = to.winners(out).first()
    assert win.val_loss == min(r.val_loss for r in last)
    cost = {(r.bracket, r.rung): r for r in to.rung_costs(out).collect()}
    assert cost[0, 0].configs == 6 and cost[0, 0].samples < 6 * 500 * 0.8 * 0.5


def test_short_constant_and_no_series(spark):
    bars = bars_of(spark, {"flat": [5.0] * 100, "tiny": [1.0, 2.0, 3.0]})
    rows = to.tournament(bars, PLAN).collect()
    assert {r.series_id for r in rows} == {"flat"} and all(abs(r.val_loss) < 1e-9 for r in rows)
    assert to.tournament(bars.limit(0), PLAN).collect() == []
