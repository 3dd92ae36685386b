"""The guard, statement shapes, execution limits and every way a question can end."""

import datetime as dt
import json
import time
from dataclasses import replace

import pytest

from martwright.functions.names import Company, Hit, Linker, hint, linked, same_company
from martwright.operators import gold, mart, voting
from martwright.plans import framing, guard, parser, shape
from martwright.queries.surface import CORPUS, EMPTY
from martwright.service import ask as service
from martwright.service.execute import Config, as_ddl, as_mschema, attempt, execute, introspect, lookup, schema_context
from martwright.sources import reports


@pytest.fixture(scope="module", autouse=True)
def views(spark, small):
    mart.register(spark, small)


@pytest.mark.parametrize("name,sql,verdict,anchored", CORPUS)
def test_guard(spark, name, sql, verdict, anchored):
    r = guard.validate(spark, sql)
    assert ("ok" if r.ok else (r.events[0] if r.events else r.reason_code)) == verdict and shape.entity_bound(spark, sql) == anchored


def test_statements():
    assert parser.statements("SELECT ';' AS a; -- x;y\n SELECT \"b;\" /* ; */ ;") == ["SELECT ';' AS a", 'SELECT "b;"']
    assert parser.statements(" ; ;") == []


@pytest.mark.parametrize("name,sql,empty", EMPTY)
def test_tautologies(spark, name, sql, empty):
    assert shape.tautologically_empty(spark, sql) == empty


def test_frame(spark):
    facts = shape.facts(parser.parse(spark, "SELECT value / 1e9 AS b FROM v_revenue WHERE ticker = 'C1' AND fiscal_year = (SELECT max(fiscal_year) FROM v_revenue)"))
    c1, link = Company(1, "C1", "Acme Inc."), Hit("C1", "ticker", Company(1, "C1", "Acme Inc."))
    kinds = {c.kind: c.assumption for c in framing.frame("How big is C1?", facts, [link], ["b"], 1)}
    assert facts.latest and facts.scale == "billion" and kinds == {"period": True, "metric": True, "unit": False}

    def find(sql, args):
        if "FROM companies" in sql:
            return [("Acme Inc.",)] if args == ["C1"] else [("Beta",)]
        if "DISTINCT fiscal_year" in sql:
            return [(1996,), (1997,)]
        return [(args[1] if len(args) > 1 else 1998, dt.date(args[1] if len(args) > 1 else 1998, 6, 30))]

    def told(question, facts, links=(link,), columns=("b",), n_rows=1, **more):
        return {c.kind: c.text for c in framing.frame(question, facts, list(links), list(columns), n_rows, find, **more)}

    own = shape.Facts(views=["v_revenue"], tickers=["C1"])
    assert told("What were sales of C1 in 1997?", replace(own, years=[1997])) == {"period": "1997 is taken as fiscal year 1997 (to June 30, 1997).", "term": "By sales revenue is meant."}
    assert "period" in told("Revenue of C1?", replace(own, latest=True)) and "as asked" in told("Latest revenue of C1?", replace(own, latest=True))["period"]
    both = told("Compare the revenue of C1 and C2", replace(own, tickers=["C1", "C2"], latest=True))
    assert "Acme Inc fiscal year 1998 (to June 30, 1998) and Beta" in both["period"] and "fiscal_year_ends" in both and "entity" not in both
    assert told("All revenue of C1", replace(own, sums=True))["sum"] == "The sum is over fiscal years 1996 and 1997, all that are on record for Acme Inc."
    assert "largest" in told("Who is largest?", shape.Facts(views=["v_revenue"], ranking=True), ())["metric"]
    assert told("Google revenue in fiscal 1997", replace(own, years=[1997], tickers=["GOOGL"]), [Hit("Google", "alias", Company(6, "GOOGL", "Alphabet Inc."))])["entity"] == "Google is taken as Alphabet Inc (GOOGL)."
    cash = {"v_cash": framing.Concept("cash", ("cash",), balance=True)}
    assert "each year" in told("Total cash of C1 in fiscal 1996 and 1997", shape.Facts(views=["v_cash"], tickers=["C1"], years=[1996, 1997]), concepts=cash)["balance"]
    clauses = framing.frame("What was it in 2024?", replace(own, years=[2024]), [link], ["b"], 1, find)
    assert framing.labels(clauses) == ({2024}, {30}) and c1.cik == 1


def test_execute(spark):
    r = execute(spark, "SELECT id FROM range(50)", 60, 10)
    assert len(r.rows) == 10 and r.truncated and r.error is None
    assert not execute(spark, "SELECT 1 AS a", 60, 1).truncated
    assert execute(spark, "SELECT nope", 60).error
    began = time.time()
    late = execute(spark, "SELECT count(*) FROM range(2000000) a JOIN range(2000000) b ON a.id * b.id % 7 > 8", 1.0)
    assert late.error.startswith("timeout") and time.time() - began < 20
    assert lookup(spark, "SELECT name FROM companies WHERE cik = ?", [1]) and lookup(spark, "SELECT nope FROM nowhere") == []


def test_attempts():
    from martwright.service.execute import Execution

    replies = iter([Execution(error="timeout: x"), Execution(rows=[(1,)])])
    assert attempt(lambda s: next(replies), "q")[0] == "unstable"
    assert attempt(lambda s: Execution(error="bad"), "q")[0] == "error" and attempt(lambda s: Execution(error="timeout"), "q")[0] == "timeout"


def test_schema_texts(spark):
    assert schema_context("intro\n\n## A\nx\n## B\ny\n## C\nz", ("C", "A")) == "intro\n\n## C\nz\n\n## A\nx"
    found = introspect(spark, ["companies"], 2)
    assert [c[0] for c in found["companies"]] == ["cik", "ticker", "name", "gics_sector"] and len(found["companies"][3][2]) == 2
    assert "CREATE TABLE companies" in as_ddl(found) and "# Table: companies" in as_mschema(found)


COMPANIES = [(1, "EXMO", "ExxonMobil"), (2, "KO", "Coca-Cola Company (The)"), (3, "JPM", "JPMorgan Chase"), (4, "META", "Meta Platforms"), (5, "MTA", "Metal Works"), (6, "GOOGL", "Alphabet Inc.")]


QUESTIONS = ["What did Exxon Mobil and The Coca-Cola Company earn?", "Compare JPMorgan's with JPM", "Show Google", "What about Meta Platforms?", "What about Meta?", "what is it", None or "", "KO, JPM; Metal"]


def test_linking(spark):
    linker = Linker(COMPANIES)
    got = lambda q: [(x.ticker, x.how) for x in linker.link(q)]
    assert got("What did Exxon Mobil and The Coca-Cola Company earn?") == [("EXMO", "name"), ("KO", "name")]
    assert got("Compare JPMorgan's with JPM") == [("JPM", "name")] and got("Show Google") == [("GOOGL", "alias")]
    assert got("What about Meta Platforms?") == [("META", "name")] and got("What about Meta?") == [] and got("what is it") == []
    df = spark.createDataFrame([(k, q) for k, q in enumerate(QUESTIONS)], "k int, q string")
    table = spark.createDataFrame(COMPANIES, "cik long, ticker string, name string")
    rows = [(r.k, r.mention, r.ticker, r.how) for r in linked(df, "k", "q", table).collect()]
    assert sorted(rows) == sorted((k, x.mention, x.ticker, x.how) for k, q in enumerate(QUESTIONS) for x in linker.link(q))
    assert same_company("Berkshire", "Berkshire Hathaway Inc.") and not same_company("The Co", "Acme") and "KO" in hint(linker.link("Coca-Cola Company"))


def ask(spark, sqls, question="What is the name of C1?", writer=None, **config):
    replies = sqls if isinstance(sqls, list) else [sqls] * 5
    return service.ask(spark, question, lambda q, c, seed: replies[seed - 42], writer or service.as_text, config=Config(timeout=60, **config))


def test_every_ending(spark, tmp_path):
    good = "SELECT ticker FROM companies WHERE cik = 1"
    log = str(tmp_path / "log.jsonl")
    out = ask(spark, f"```sql\n{good}\n```", log=log)
    assert out["state"] == "ANSWERED" and "C1" in out["answer"] and out["confidence"] == 1.0
    assert ask(spark, good, "please DROP everything")["reason_code"] == "OUT_OF_SCOPE"
    assert service.ask(spark, "x", None, classify=lambda q: "AMBIGUOUS because")["reason_code"] == "AMBIGUOUS"
    assert ask(spark, "SELECT name FROM companies WHERE 1 = 0")["reason_code"] == "SCHEMA_MISMATCH"
    assert ask(spark, "SELECT name FROM companies WHERE cik = -5")["reason_code"] == "NO_DATA"
    assert ask(spark, "SELECT * FROM companies")["reason_code"] == "COST_LIMIT"
    assert ask(spark, ["SELEC"] * 4 + ["SELECT * FROM secret"])["reason_code"] == "SCHEMA_MISMATCH"
    assert ask(spark, [f"SELECT {k} AS a FROM companies WHERE cik = 1" for k in range(5)])["reason_code"] == "LOW_AGREEMENT"
    blocked = ask(spark, good, writer=lambda c, r: "It made $5 billion.")
    assert blocked["reason_code"] == "UNGROUNDED_ANSWER" and blocked["blocked_claims"] == ["$5 billion"]
    assert ask(spark, None)["reason_code"] == "EXEC_ERROR"
    assumed = ask(spark, "SELECT value FROM v_revenue WHERE ticker = 'C1' ORDER BY fiscal_year DESC, period_end_date DESC LIMIT 1", "How big is C1?")
    assert assumed["state"] == "ANSWERED_WITH_ASSUMPTION" and assumed["assumptions"]
    assert all(x["refusal"] for x in (blocked,))
    (line,) = open(log).read().splitlines()
    assert json.loads(line)["state"] == "ANSWERED" and len(json.loads(line)["candidates"]) == 5


def test_a_second_try(spark):
    bad, good = "SELECT ticker FROM companies WHERE cik = abs()", "SELECT ticker FROM companies WHERE cik = 1"
    told = []

    def repair(question, sql, error):
        told.append((sql, error))
        return f"```sql\n{good}\n```"

    config = Config(timeout=60, repair_triggers=frozenset({"exec_error"}))
    out = service.ask(spark, "What is C1?", lambda q, c, seed: bad, config=config, repair=repair)
    assert (out["state"], out["repair"]["succeeded"], out["sql"]) == ("ANSWERED", True, good) and len(told) == 1
    assert service.ask(spark, "What is C1?", lambda q, c, seed: bad, config=Config(timeout=60), repair=repair)["reason_code"] == "EXEC_ERROR" and len(told) == 1
    same = service.ask(spark, "What is C1?", lambda q, c, seed: bad, config=config, repair=lambda q, s, e: bad + ";")
    assert same["reason_code"] == "EXEC_ERROR" and not same["repair"]["succeeded"]


def test_settings_from_the_environment():
    made = Config.from_env({"MARTWRIGHT_TIMEOUT": "5", "MARTWRIGHT_CANDIDATES": "3", "MARTWRIGHT_REPAIR_TRIGGERS": "exec_error,", "MARTWRIGHT_LOG": "/tmp/x", "OTHER": "1"})
    assert (made.timeout, made.candidates, made.repair_triggers, made.log, made.seed) == (5.0, 3, frozenset({"exec_error"}), "/tmp/x", 42)


def test_gold_cases(spark, tmp_path):
    cases = [("a", "1", "q", "ANSWER", "set", "SELECT 1", None), ("b", "1", "q", "ABSTAIN", "none", None, None), ("c", "", "q", "MAYBE", "what", None, None), ("a", "1", "q", "ANSWER", "none", "SELECT 1", None)]
    df = spark.createDataFrame(cases, "id string, tier string, question string, expected string, compare string, gold_sql string, reason_code string")
    found = sorted((r.id, r.problem) for r in gold.violations(df).collect())
    assert found == [("a", "a repeated id"), ("a", "a statement that isn't compared"), ("b", "an abstention without a reason"), ("c", "a comparison without a statement"), ("c", "no tier"), ("c", "unknown comparison"), ("c", "unknown expectation")]
    one = dict(id="x", tier=1, question="q", expected="ANSWER", compare="scalar", gold_sql="SELECT count(*) FROM companies", anchor_value=5.0)
    assert gold.check(spark, one, lambda sql: ([(5,)], None)) == [] and gold.check(spark, one, lambda sql: ([(9,)], None)) == ["9 where 5.0 is known"]
    assert gold.check(spark, one | {"gold_sql": "DROP TABLE companies"}, lambda sql: ([], None))[0].startswith("the guard turns it down")
    assert gold.result_problem("empty", []) is None and gold.result_problem("set", []) and gold.result_problem("scalar_or_null", [(None,)]) is None
    path = tmp_path / "r.md"
    reports.write_report(str(path), "Run", [("Cases", df.groupBy("id").count().orderBy("id")), ("Note", "all | told")])
    assert path.read_text().splitlines()[4:8] == ["| id | count |", "| --- | ---: |", "| a | 2 |", "| b | 1 |"]
    assert reports.write_records(str(tmp_path / "r.jsonl"), [{"d": dt.date(2024, 1, 2)}]) == 1 and "2024-01-02" in (tmp_path / "r.jsonl").read_text()


def test_vote_ties():
    c = [voting.Candidate("a", True, rows=[(1,)]), voting.Candidate("b", True, rows=[(2,), (None,)]), voting.Candidate("c", True, rows=[(None,), (2,)]), voting.Candidate("d", True, rows=[(1,)]), voting.Candidate("e", False, "COST_LIMIT", ["cost_limit"])]
    v = voting.settle(c)
    assert (v.winner, v.agreement, v.events) == (0, 0.4, ["cost_limit"])
    assert voting.settle([voting.Candidate("x", False, "EXEC_ERROR")] * 3 + [voting.Candidate("y", False, "COST_LIMIT")]).reason == "COST_LIMIT"
    assert voting.repair_trigger("EXEC_ERROR", c) is None and voting.repair_trigger("EXEC_ERROR", c, frozenset({"exec_error"})) == "exec_error"
