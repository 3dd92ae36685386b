"""Expected pass rates of pools against every possible draw."""

import random
from itertools import combinations, product
from statistics import mean

import pytest

from martwright.operators import metrics


def passed(pool: list[bool], k: int) -> float:
    return mean(any(d) for d in combinations(pool, min(k, len(pool))))


def test_pool_expectations_against_all_draws(spark):
    rng, rows = random.Random(3), []
    for case in range(8):
        for run in range(4):
            if (case, run) == (1, 3):
                continue
            rows += [(case, run, run % 2, run // 2, rng.random() < 0.25) for _ in range(rng.randint(1, 4))]
    rows += [(8, run, run % 2, run // 2, run == 3) for run in range(4)]  # solved by a candidate of the last run only
    got = {r.plan: r for r in metrics.pool_expectations(spark.createDataFrame(rows, "c int, r int, m int, p int, ok boolean"), "c", "r", "m", "p", "ok", 3).collect()}
    want: dict[str, list] = {}
    for case in range(9):
        own = [r for r in rows if r[0] == case]
        for plan, at in (("single_run", 1), ("one_model", 2), ("one_prompt", 3), ("all_runs", 0)):
            want.setdefault(plan, []).append(mean(passed([r[4] for r in own if r[at] == v], 3) for v in {r[at] for r in own}))
        runs = [[r[4] for r in own if r[1] == v] for v in sorted({r[1] for r in own})]
        draws = [mean(any(d) for d in product(*some)) for some in combinations(runs, min(3, len(runs)))]
        want.setdefault("distinct_runs", []).append(mean(draws))
    assert set(got) == set(want)
    for plan, values in want.items():
        r = got[plan]
        ahead = [a - b for a, b in zip(values, want["single_run"], strict=True)]
        assert r.cases == 9 and r.solved == pytest.approx(sum(values)) and r.rate == pytest.approx(mean(values)) and r.ahead == pytest.approx(mean(ahead))
        assert r.low <= r.rate <= r.high and r.ahead_low <= r.ahead <= r.ahead_high
    assert got["single_run"].ahead == 0 and want["all_runs"][8] > 0
