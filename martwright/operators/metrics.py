"""Evaluation metrics over record tables. Empty denominators give 0.0; `tier` columns get an overall row by rollup."""

from __future__ import annotations

from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import ratio


def abstain(records: DataFrame, expected: str = "expected", state: str = "state", code: str = "code", accepted: str = "accepted") -> DataFrame:
    """One row: decision precision and recall of abstaining, strict precision (with an accepted reason), reason accuracy."""
    should, did = F.col(expected) == "ABSTAIN", F.col(state) == "ABSTAINED"
    right = F.coalesce(F.array_contains(accepted, F.col(code)), F.lit(False))
    c = records.agg(F.count_if(did & should).alias("tp"), F.count_if(did & ~should).alias("fp"), F.count_if(~did & should).alias("fn"), F.count_if(did & should & right).alias("right_reason"))
    return c.select(
        "tp", "fp", "fn", "right_reason",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.col("right_reason"), F.col("tp") + F.col("fp")).alias("strict_precision"), ratio(F.col("right_reason"), F.col("tp")).alias("reason_accuracy"),
    )


def confidently_wrong(records: DataFrame, tier: str, answered: Column, correct: Column, expected: Column) -> DataFrame:
    """(tier, answered, wrong, rate): an answer that is wrong, or given where none should be; with the overall row."""
    bad = answered & (~correct | (expected == "ABSTAIN"))
    out = records.rollup(tier).agg(F.count_if(answered).alias("answered"), F.count_if(bad).alias("wrong"))
    return out.select(F.coalesce(F.col(tier), F.lit("overall")).alias("tier"), "answered", "wrong", ratio(F.col("wrong"), F.col("answered")).alias("rate"))


def repairs(records: DataFrame, trigger: str, succeeded: Column, correct: Column) -> DataFrame:
    out = records.where(F.col(trigger).isNotNull()).rollup(trigger).agg(F.count("*").alias("attempted"), F.count_if(succeeded).alias("succeeded"), F.count_if(succeeded & correct).alias("correct"))
    return out.select(F.coalesce(F.col(trigger), F.lit("total")).alias("trigger"), "attempted", "succeeded", "correct", ratio(F.col("correct"), F.col("attempted")).alias("rate"))


def pass_at_n(candidates: DataFrame, case: str, tier: str, index: str, correct: str, winner: str) -> DataFrame:
    """(tier, total, pass_1, pass_n, winner_right, gap, violations) with the overall row; candidates are rows.

    pass_1: the first candidate is right; pass_n: any is. A winner that is right while no candidate is, is a violation.
    """
    per = candidates.groupBy(tier, case).agg(
        F.bool_or(F.col(correct) & (F.col(index) == 0)).alias("one"), F.bool_or(correct).alias("any"), F.bool_or(F.col(correct) & (F.col(index) == F.col(winner))).alias("won"),
    )
    out = per.rollup(tier).agg(F.count("*").alias("total"), F.count_if("one").alias("pass_1"), F.count_if("any").alias("pass_n"), F.count_if("won").alias("winner_right"), F.count_if(F.col("won") & ~F.col("any")).alias("violations"))
    return out.select(F.coalesce(F.col(tier), F.lit("overall")).alias("tier"), "total", "pass_1", "pass_n", "winner_right", (F.col("pass_n") - F.col("pass_1")).alias("gap"), "violations")


def policy(a: DataFrame, b: DataFrame, case: str, answer: str, correct: str) -> DataFrame:
    """(bucket, n, right, accuracy): a's answers by whether another run agrees, differs or abstained."""
    other = b.select(case, F.col(answer).alias("_other"))
    both = a.where(F.col(answer).isNotNull()).join(other, case, "left")
    bucket = F.when(F.col("_other").isNull(), "other_abstained").when(F.col("_other") == F.col(answer), "agree").otherwise("differ")
    out = both.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(correct).alias("right"))
    return out.withColumn("accuracy", ratio(F.col("right"), F.col("n")))


def what_if(records: DataFrame, rule: Column, code: str, state: str = "state", reason: str = "code") -> DataFrame:
    """The records as they would be if a rule had made them abstain with a code."""
    flip = rule & (F.col(state) != "ABSTAINED")
    return records.withColumn("flipped", flip).withColumn(reason, F.when(flip, F.lit(code)).otherwise(F.col(reason))).withColumn(state, F.when(flip, "ABSTAINED").otherwise(F.col(state)))


def replays(records: DataFrame, rules: dict[str, tuple[Column, str]], expected: str = "expected", state: str = "state", code: str = "code", accepted: str = "accepted") -> DataFrame:
    """(replay, flipped, right_flips, tp, fp, fn, right_reason, precision, recall): what each rule would have changed.

    A rule (condition, code) makes the records that it holds for abstain with the code; "" as code: it makes them answer.
    The records are read once, whatever the number of rules; "recorded" is what happened.
    """
    made = [F.struct(F.lit("recorded").alias("replay"), F.col(state).alias("state"), F.col(code).alias("code"))]
    for name, (rule, why) in rules.items():
        hit = F.coalesce(rule, F.lit(False))
        told = (F.when(hit, "ABSTAINED"), F.when(hit & (F.col(state) != "ABSTAINED"), F.lit(why))) if why else (F.when(hit, "ANSWERED"), F.when(hit, F.lit(None).cast("string")))
        reason = F.coalesce(told[1], F.col(code)) if why else F.when(~hit, F.col(code))
        made.append(F.struct(F.lit(name).alias("replay"), F.coalesce(told[0], F.col(state)).alias("state"), reason.alias("code")))
    each = records.select(F.col(expected).alias("expected"), F.col(accepted).alias("accepted"), F.col(state).alias("was"), F.inline(F.array(*made)))
    should, did = F.col("expected") == "ABSTAIN", F.col("state") == "ABSTAINED"
    flipped, right = F.col("state") != F.col("was"), F.coalesce(F.array_contains("accepted", F.col("code")), F.lit(False))
    c = each.groupBy("replay").agg(
        F.count_if(flipped).alias("flipped"), F.count_if(flipped & (should == did)).alias("right_flips"), F.count_if(did & should).alias("tp"),
        F.count_if(did & ~should).alias("fp"), F.count_if(~did & should).alias("fn"), F.count_if(did & should & right).alias("right_reason"),
    )
    return c.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def case_verdicts(gold: DataFrame, pred: DataFrame, case: list[str], keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(case, matched): whether a case's predicted rows are its gold rows, whatever their order; repeats collapse.

    Rows are partners if their keys are equal and their values within the relative tolerance. Each row needs one on the other
    side; a case that only one side has isn't matched. Sides meet by case and keys, so no case has to be in one task.
    """
    from .joins import matched_within

    both = matched_within(gold, pred, [*case, *keys], value, tolerance).unionByName(matched_within(pred, gold, [*case, *keys], value, tolerance))
    return both.groupBy(*case).agg(F.bool_and("matched").alias("matched"))


def rescored(golds: DataFrame, pred: DataFrame, edition: str, case: str, keys: list[str], value: str, tolerance: float, before: str, after: str) -> DataFrame:
    """(change, n): predictions scored by two editions of the gold rows, and how their verdicts moved between them."""
    spread = pred.withColumn(edition, F.explode(F.array(F.lit(before), F.lit(after))))
    verdicts = case_verdicts(golds.where(F.col(edition).isin(before, after)), spread, [case, edition], keys, value, tolerance)
    own = verdicts.groupBy(case).agg(*(F.coalesce(F.bool_or(F.when(F.col(edition) == e, F.col("matched"))), F.lit(False)).alias(n) for e, n in ((before, "_a"), (after, "_b"))))
    return editions(own, case, "_a", "_b")


def verdict_changes(old: DataFrame, new: DataFrame, key: str, verdict: str) -> DataFrame:
    """(was, now, n): two verifiers' verdicts on the same records; one that a side lacks is null."""
    both = old.select(key, F.col(verdict).alias("was")).join(new.select(key, F.col(verdict).alias("now")), key, "full")
    return both.groupBy("was", "now").agg(F.count("*").alias("n"))


def agreement(grades: DataFrame, case: str, grader: str, verdict: str) -> DataFrame:
    """(a, b, n, agree, rate, kappa) of every two graders over the cases that both have graded, blind to each other.

    kappa is Cohen's; null where chance alone agrees always. A null verdict counts as no.
    """
    own = grades.select(F.col(case).alias("c"), F.col(grader).alias("g"), F.coalesce(F.col(verdict), F.lit(False)).alias("v"))
    both = own.select("c", F.col("g").alias("a"), F.col("v").alias("x")).join(own.select("c", F.col("g").alias("b"), F.col("v").alias("y")), "c").where("a < b")
    c = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("agree"), F.count_if("x").alias("px"), F.count_if("y").alias("py"))
    n = F.col("n").cast("double")
    chance = (F.col("px") * F.col("py") + (F.col("n") - F.col("px")) * (F.col("n") - F.col("py"))) / (n * n)
    return c.select("a", "b", "n", "agree", (F.col("agree") / n).alias("rate"), F.round(F.try_divide(F.col("agree") / n - chance, 1 - chance), 9).alias("kappa"))


def adjudicated(grades: DataFrame, decisions: DataFrame, case: str, verdict: str) -> DataFrame:
    """(case, verdict, how): the graders' verdict where they agree, else the adjudicator's; open where there is none."""
    own = grades.groupBy(case).agg(F.bool_and(F.coalesce(F.col(verdict), F.lit(False))).alias("_all"), F.bool_or(F.coalesce(F.col(verdict), F.lit(False))).alias("_any"))
    both = own.join(decisions.select(case, F.col(verdict).alias("_said")), case, "left")
    agreed = F.col("_all") == F.col("_any")
    how = F.when(agreed, "agreed").when(F.col("_said").isNotNull(), "adjudicated").otherwise("open")
    return both.select(case, F.when(agreed, F.col("_all")).otherwise(F.col("_said")).alias("verdict"), how.alias("how"))


def ablation(records: DataFrame, arm: str, tier: str, right: str, on: str, off: str) -> DataFrame:
    """(tier, n_on, n_off, rate_on, rate_off, gain), with the overall row: what one part of the service is worth."""
    out = records.where(F.col(arm).isin(on, off)).rollup(tier).agg(
        *(x for a, n in ((on, "on"), (off, "off")) for x in (F.count_if(F.col(arm) == a).alias(f"n_{n}"), F.count_if((F.col(arm) == a) & F.col(right)).alias(f"_{n}")))
    )
    rates = out.select(F.coalesce(F.col(tier), F.lit("overall")).alias("tier"), "n_on", "n_off", ratio(F.col("_on"), F.col("n_on")).alias("rate_on"), ratio(F.col("_off"), F.col("n_off")).alias("rate_off"))
    return rates.withColumn("gain", F.col("rate_on") - F.col("rate_off"))


def acceptance(records: DataFrame, tier: str, right: str, least: dict[str, float]) -> DataFrame:
    """(tier, total, right, rate, place, accepted): tiers from the best on, and whether each reaches what it must."""
    out = records.groupBy(F.col(tier).alias("tier")).agg(F.count("*").alias("total"), F.count_if(right).alias("right"))
    rate, need = ratio(F.col("right"), F.col("total")), F.coalesce(*(F.when(F.col("tier") == t, F.lit(x)) for t, x in least.items()), F.lit(0.0))
    place = F.row_number().over(Window.orderBy(F.desc("right"), "tier"))  # a row for each tier
    return out.select("tier", "total", "right", rate.alias("rate"), place.alias("place"), (rate >= need).alias("accepted"))


def signal_report(scores: DataFrame, name: str, score: str, label: str, resamples: int = 200) -> DataFrame:
    """signals() with the bootstrap interval (low, high) of each AUROC."""
    from .aggregates import bootstrap_auroc

    held = bootstrap_auroc(scores, name, score, label, resamples).select(F.col("name").alias(name), "low", "high")
    return signals(scores, name, score, F.col(label) == 1).join(held, name, "left")


def editions(verdicts: DataFrame, case: str, before: str, after: str) -> DataFrame:
    """(change, n): how verdicts moved from one edition of the gold set to the next."""
    change = F.when(F.col(before) == F.col(after), "same").when(F.col(after), "gained").otherwise("lost")
    return verdicts.groupBy(change.alias("change")).agg(F.count(case).alias("n"))


def signals(scores: DataFrame, name: str, score: str, positive: Column) -> DataFrame:
    """(name, n, constant, auroc) for each signal: ranks by counts of its distinct scores."""
    c = scores.groupBy(name, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    w = Window.partitionBy(name).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = c.withColumn("_won", F.col("p") * (F.coalesce(F.sum("q").over(w), F.lit(0)) + F.col("q") / 2.0))
    out = won.groupBy(name).agg(F.sum(F.col("p") + F.col("q")).alias("n"), (F.count("*") <= 1).alias("constant"), F.sum("_won").alias("_w"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    return out.select(name, "n", "constant", F.round(F.try_divide(F.col("_w"), (F.col("_p") * F.col("_q")).cast("double")), 9).alias("auroc"))


def decide(first: tuple[float, float], second: tuple[float, float], means: tuple[float, float]) -> str:
    """The rule over two intervals of a difference: on if both are over zero, off if either is under, else by both means."""
    if first[0] > 0 and second[0] > 0:
        return "on"
    if first[1] < 0 or second[1] < 0:
        return "off"
    return "on" if min(means) > 0 else "off"


def decisions(records: DataFrame, group: str, on: str, first: str, second: str) -> DataFrame:
    """(group, verdict): decide() for each group of records by two measures of being right, with the part on against off.

    The intervals of a difference of rates are normal ones at 95 %; a group without records on either side has no row. Null
    verdicts count as wrong.
    """
    rate = lambda c, arm: F.avg(F.when(arm, F.coalesce(F.col(c), F.lit(False)).cast("double")))
    with_it, without = F.col(on), ~F.col(on)
    sums = records.groupBy(group).agg(F.count_if(with_it).alias("_n1"), F.count_if(without).alias("_n0"), *(x for c, n in ((first, "a"), (second, "b")) for x in (rate(c, with_it).alias(f"_{n}1"), rate(c, without).alias(f"_{n}0"))))

    def interval(n: str) -> tuple[Column, Column, Column]:
        a, b = F.col(f"_{n}1"), F.col(f"_{n}0")
        room = 1.959964 * F.sqrt(a * (1 - a) / F.col("_n1") + b * (1 - b) / F.col("_n0"))
        return F.round(a - b - room, 9), F.round(a - b, 9), F.round(a - b + room, 9)

    (low_a, mean_a, high_a), (low_b, mean_b, high_b) = interval("a"), interval("b")
    verdict = F.when((low_a > 0) & (low_b > 0), "on").when((high_a < 0) | (high_b < 0), "off").when((mean_a > 0) & (mean_b > 0), "on").otherwise("off")
    return sums.where("_n1 > 0 AND _n0 > 0").select(group, verdict.alias("verdict"))


def guard_score(records: DataFrame, must_fire: str, fired: str, refused: str) -> DataFrame:
    """(outcome, n) of guard cases by category: refused is enough, whichever part of the guard did it."""
    outcome = F.when(~F.col(must_fire) & ~F.col(refused), "clean").when(~F.col(must_fire), "false_alarm").when(F.size(fired) > 0, "fired").when(F.col(refused), "refused_elsewhere").otherwise("missed")
    return records.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def calibrate(labels: DataFrame, said: str, label: str) -> DataFrame:
    """(n, agree, precision, recall) of a grader against hand labels; a null verdict counts as no."""
    s, t = F.coalesce(F.col(said), F.lit(False)), F.col(label)
    c = labels.agg(F.count("*").alias("n"), F.count_if(s == t).alias("agree"), F.count_if(s & t).alias("tp"), F.count_if(s & ~t).alias("fp"), F.count_if(~s & t).alias("fn"))
    return c.select("n", "agree", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def outcomes(records: DataFrame, guard_ok: str, error: str, correct: str) -> DataFrame:
    """(outcome, error_class, n) of generated candidates: how each ended, errors by the part before the colon."""
    outcome = F.when(~F.col(guard_ok), "rejected").when(F.col(error).isNotNull(), "error").when(F.col(correct), "right").otherwise("wrong")
    return records.groupBy(outcome.alias("outcome"), F.substring_index(error, ":", 1).alias("error_class")).agg(F.count("*").alias("n"))


def run_summary(records: DataFrame, tier: str, state: str, correct: str) -> DataFrame:
    """(tier, total, answered, abstained, correct, coverage, accuracy) with the overall row."""
    answered = F.col(state) != "ABSTAINED"
    out = records.rollup(tier).agg(F.count("*").alias("total"), F.count_if(answered).alias("answered"), F.count_if(~answered).alias("abstained"), F.count_if(answered & F.col(correct)).alias("correct"))
    return out.select(F.coalesce(F.col(tier), F.lit("overall")).alias("tier"), "total", "answered", "abstained", "correct", ratio(F.col("answered"), F.col("total")).alias("coverage"), ratio(F.col("correct"), F.col("answered")).alias("accuracy"))


def pool_budget(candidates: DataFrame, case: str, run: str, index: str, correct: str, k: int = 5) -> DataFrame:
    """(plan, cases, solved): one candidate from each of k runs against k of one run, for the same budget."""
    mixed = candidates.where((F.col(index) == 0) & (F.col(run) < k)).withColumn("plan", F.lit("stratified"))
    single = candidates.where((F.col(run) == 0) & (F.col(index) < k)).withColumn("plan", F.lit("single_run"))
    per = mixed.unionByName(single).groupBy("plan", case).agg(F.bool_or(correct).alias("solved"))
    return per.groupBy("plan").agg(F.count("*").alias("cases"), F.count_if("solved").alias("solved"))


def pool_expectations(candidates: DataFrame, case: str, run: str, model: str, prompt: str, correct: str, k: int = 5) -> DataFrame:
    """(plan, cases, solved, rate, low, high, ahead, ahead_low, ahead_high): expected pass@k of pools of the same budget.

    Each case's k candidates are drawn from one run, one prompt's runs, one model's runs, all runs, or one each from k
    distinct runs, without replacement; a pool with fewer gives all it has. The expectations are exact, by counts, over
    all runs and candidates; a plan with several pools is their mean. ahead: the difference to single_run. The 95 %
    intervals are normal ones over cases. A candidate's null verdict counts as wrong.
    """
    runs = candidates.groupBy(F.col(case).alias("case"), F.col(run).alias("run"), F.col(model).alias("model"), F.col(prompt).alias("prompt")).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(correct), F.lit(False))).alias("bad"))
    pools = {"single_run": F.col("run"), "one_prompt": F.col("prompt"), "one_model": F.col("model"), "all_runs": F.lit(0)}
    spread = runs.select("case", "n", "bad", F.explode(F.array(*(F.struct(F.lit(p).alias("plan"), c.cast("string").alias("pool")) for p, c in pools.items()))).alias("_p")).select("case", "n", "bad", "_p.*")
    pooled = spread.groupBy("case", "plan", "pool").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    none = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n")).cast("int") - 1), F.lit(1.0), lambda p, j: p * F.greatest(F.col("bad") - j, F.lit(0)) / (F.col("n") - j))
    drawn = pooled.select("case", "plan", (1 - none).alias("x"))
    # one from each of k runs: the mean of products of k runs' shares of wrong ones, as elementary symmetric sums
    start = F.array(F.lit(1.0), *[F.lit(0.0)] * k)
    sums = F.aggregate("shares", start, lambda e, f: F.transform(e, lambda v, j: F.when(j == 0, v).otherwise(v + f * F.get(e, j - 1))))
    ways = F.aggregate("shares", start, lambda e, f: F.transform(e, lambda v, j: F.when(j == 0, v).otherwise(v + F.get(e, j - 1))))
    most = F.least(F.lit(k), F.size("shares"))
    shares = runs.groupBy("case").agg(F.array_sort(F.collect_list(F.col("bad") / F.col("n"))).alias("shares"))  # as many as a case has runs
    apart = shares.select("case", F.lit("distinct_runs").alias("plan"), (1 - F.get(sums, most) / F.get(ways, most)).alias("x"))
    per = drawn.unionByName(apart).groupBy("case", "plan").agg(F.avg("x").alias("x"))
    wide = per.groupBy("case").pivot("plan", ["single_run", "one_prompt", "one_model", "all_runs", "distinct_runs"]).agg(F.first("x"))
    both = wide.select(F.col("single_run").alias("base"), F.explode(F.map_from_arrays(F.array(*map(F.lit, wide.columns[1:])), F.array(*wide.columns[1:]))).alias("plan", "x"))
    out = both.groupBy("plan").agg(F.count("*").alias("cases"), F.sum("x").alias("solved"), F.avg("x").alias("rate"), F.stddev_samp("x").alias("s"), F.avg(F.col("x") - F.col("base")).alias("ahead"), F.stddev_samp(F.col("x") - F.col("base")).alias("t"))
    wide_s, wide_t = (1.959964 * F.coalesce(F.col(c), F.lit(0.0)) / F.sqrt("cases") for c in ("s", "t"))
    return out.select("plan", "cases", "solved", "rate", (F.col("rate") - wide_s).alias("low"), (F.col("rate") + wide_s).alias("high"), "ahead", (F.col("ahead") - wide_t).alias("ahead_low"), (F.col("ahead") + wide_t).alias("ahead_high"))


def plurality_chance(sizes: list[int], right: list[bool], failed: int, k: int) -> float:
    """The chance that a vote over k candidates, drawn without replacement, picks a right cluster; ties are shared.

    Exact, by counting draws: for each right cluster and each number of its members drawn, the others' draws with fewer, or
    with as many (a tie), are counted by a product of polynomials in how many are drawn and how many tie. Failed candidates
    are drawn but never win. Fewer candidates than k: all are drawn.
    """
    total = sum(sizes) + failed
    k = min(k, total)
    if not k:
        return 0.0
    won = 0.0
    for j in (j for j, ok in enumerate(right) if ok):
        for m in range(1, min(sizes[j], k) + 1):
            ways = {(0, 0): 1}  # (drawn of the others, ties): draws
            for n in [s for i, s in enumerate(sizes) if i != j]:
                more: dict = {}
                for (d, t), x in ways.items():
                    for a in range(min(n, m, k - m - d) + 1):
                        at = (d + a, t + (a == m))
                        more[at] = more.get(at, 0) + x * comb(n, a)
                ways = more
            won += comb(sizes[j], m) * sum(x * comb(failed, k - m - d) / (t + 1) for (d, t), x in ways.items() if k - m - d <= failed)
    return won / comb(total, k)


def vote_expectations(candidates: DataFrame, case: str, pool: str, key: str, correct: str, k: int = 5) -> DataFrame:
    """(pool, cases, rate, place): each pool's expected share of cases that a vote over k of its candidates gets right, best first.

    A case's candidates of a pool are clusters of equal keys; a null key is one that failed; a cluster is right if one of its
    members is. place 1 is the best single pool, the highest place the worst; the mean over pools is that of a pool picked
    at random.
    """
    own = candidates.select(F.col(case).alias("case"), F.col(pool).alias("pool"), F.col(key).alias("key"), F.coalesce(F.col(correct), F.lit(False)).alias("right"))
    clusters = own.groupBy("case", "pool", "key").agg(F.count("*").alias("n"), F.bool_or("right").alias("right"))
    sizes = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("n", "right")))  # a pool's clusters of one case
    held = clusters.groupBy("case", "pool").agg(sizes.alias("c"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("failed"))
    shape = held.groupBy("pool", F.array_sort("c").alias("c"), "failed").agg(F.count("*").alias("cases"))  # cases alike are counted once

    @F.pandas_udf("double")
    def chance(c: pd.Series, failed: pd.Series) -> pd.Series:
        return pd.Series([plurality_chance([x["n"] for x in rows], [x["right"] for x in rows], int(f), k) for rows, f in zip(c, failed, strict=True)], dtype=float)

    out = shape.groupBy("pool").agg(F.sum("cases").alias("cases"), (F.sum(F.col("cases") * chance("c", "failed")) / F.sum("cases")).alias("rate"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("rate", 9)), "pool"))  # a row for each pool
    return out.select("pool", "cases", F.round("rate", 9).alias("rate"), place.alias("place"))


def empty_causes(candidates: DataFrame, case: str, has_entity: str, linked: str, has_period: str, empty: str) -> DataFrame:
    """(cause, n): why candidates came back empty, the first that holds."""
    cause = F.when(~F.col(empty), "not_empty").when(~F.col(has_entity), "no_entity_predicate").when(~F.col(linked), "wrong_entity").when(F.col(has_period), "wrong_period").otherwise("absent")
    return candidates.groupBy(cause.alias("cause")).agg(F.count(case).alias("n"))
