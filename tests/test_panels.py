"""Verdicts, experiments, standings, speech and projections against literal answers and loops."""

import datetime as dt
import glob
import json
import math
import os
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import beta_cdf
from tidemark.operators import ledger, learning as ln, projections as pj, risk, text as tx, verdicts as vd
from tidemark.sources import feeds

TOLD = "question string, member string, parse_ok boolean, probability double, distribution map<string,double>, quantile_values map<string,double>, citations array<string>"


def asked(spark, rows):
    return spark.createDataFrame([(q, k, ["a", "b"], [0.05, 0.5, 0.95]) for q, k in rows], "question string, kind string, outcomes array<string>, quantiles array<double>")


def test_verdicts_by_kind(spark):
    told = [
        ("bin", "x", True, 0.8, None, None, ["E01"]), ("bin", "y", True, None, None, None, []), ("bin", "z", False, 0.1, None, None, None), ("bin", "far", True, 0.05, None, None, None),
        ("cat", "x", True, None, {"a": 0.9, "b": 0.1}, None, ["E01"]), ("cat", "y", True, None, {"a": 0.5}, None, ["E01"]),
        ("num", "x", True, None, None, {"0.05": 1.0, "0.5": 5.0, "0.95": 4.0}, ["E01"]), ("num", "y", True, None, None, {"0.05": 3.0, "0.5": 7.0, "0.95": float("nan")}, ["E01"]),
        ("lost", "x", False, 0.9, None, None, None),
    ]
    got = {r.question: r for r in vd.verdicts(asked(spark, [("bin", "binary"), ("cat", "categorical"), ("num", "numeric"), ("lost", "binary"), ("silent", "numeric")]), spark.createDataFrame(told, TOLD)).collect()}
    b = got["bin"]
    lo = [math.log(p / (1 - p)) for p in (0.8, 0.5, 0.05)]
    sd, agree = statistics.stdev([0.8, 0.5, 0.05]), abs(2 / 3 - 1)
    pooled = 1 / (1 + math.exp(-(1 + 0.8 * min(sd / 0.25, 1) * agree) * sum(lo) / 3))
    assert b.probability == pytest.approx(pooled) and b.dispersion == pytest.approx(sd) and b.n_members == 3 and b.uncited == 2
    assert b.n_dissent == sum(abs(p - pooled) >= 0.15 for p in (0.8, 0.5, 0.05)) and b.strongest == max((("x", 0.8), ("y", 0.5), ("far", 0.05)), key=lambda m: abs(m[1] - pooled))[0]
    c = got["cat"]
    l = [(math.log(0.9) + math.log(0.5 / 0.500001)) / 2, (math.log(0.1) + math.log(1e-6 / 0.500001)) / 2]
    assert c.distribution["a"] == pytest.approx(math.exp(l[0]) / sum(map(math.exp, l)), rel=1e-9) and sum(c.distribution.values()) == pytest.approx(1)
    n = got["num"]
    assert n.quantile_values == {"0.05": 2.0, "0.5": 6.0, "0.95": 6.0} and n.dispersion == pytest.approx(math.sqrt(2)) and n.width == 4.0
    assert got["lost"].probability == 0.5 and got["lost"].note and got["lost"].n_members == 0 and got["silent"].quantile_values is None and got["silent"].note


def test_verdicts_with_weights_and_none(spark):
    told = [("q", m, True, p, None, None, None) for m, p in (("a", 0.9), ("b", 0.2), ("c", 0.4))]
    frame, q = spark.createDataFrame(told, TOLD), asked(spark, [("q", "binary")])
    w = lambda rows: vd.verdicts(q, frame, spark.createDataFrame(rows, "member string, weight double"), cap=1.0).first().probability
    assert w([("a", 1.0), ("b", 0.0), ("c", -3.0)]) == pytest.approx(0.9) and w([("a", 0.0), ("b", 0.0), ("c", 0.0)]) == pytest.approx(w([("z", 5.0)]))
    assert vd.verdicts(q, frame.limit(0)).first().probability == 0.5 and vd.verdicts(q.limit(0), frame).count() == 0


def test_arms_meet_in_welchs_test(spark):
    a, b, c = [0.1 + 0.01 * (i % 7) for i in range(30)], [0.15 + 0.02 * (i % 5) for i in range(40)], [0.3 + 0.01 * (i % 3) for i in range(35)]
    rows = [(f"{k}{i}", k, x) for k, xs in (("a", a), ("b", b), ("c", c), ("d", [0.0] * 29)) for i, x in enumerate(xs)]
    scores = spark.createDataFrame([(q, x) for q, _, x in rows] + [("unassigned", 0.0), ("a0x", None)], "question string, brier double")
    told = spark.createDataFrame([(q, s, k) for q, k, _ in rows for s in ("one",)] + [("b0", "two", "b"), ("noscore", "one", "a"), ("a1", "one", "unknown")], "question string, setting string, arm string")
    got = {(r.setting, r.arm): r for r in vd.compare_arms(scores, told, {"one": ["a", "b", "c", "d", "e"], "two": ["b", "x"]}).collect()}
    rest = b + c
    va, vb = statistics.variance(a) / 30, statistics.variance(rest) / 75
    t = (statistics.mean(a) - statistics.mean(rest)) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / 29 + vb**2 / 74)
    r = got["one", "a"]
    assert r.winner == "a" and r.t == pytest.approx(t) and r.df == pytest.approx(df) and r.p == pytest.approx(beta_cdf(df / (df + t * t), df / 2, 0.5)) and r.decision == "winner scored better"
    assert got["one", "d"].n == 29 and got["one", "e"].n == 0 and got["two", "b"].decision == "not enough evidence" and len(got) == 7


def test_scoreboard_gates(spark):
    rows = [("few", "binary", i, 0.5, i % 2) for i in range(29)] + [("good", "binary", i, 0.9 if i % 2 else 0.1, i % 2) for i in range(120)] + [("bad", "binary", i, 0.1 if i % 2 else 0.9, i % 2) for i in range(40)] + [("good", "numeric", 999, None, None)]
    got = {(r.member, r.reference): r for r in vd.scoreboard(spark.createDataFrame(rows, "member string, kind string, position int, p double, y int")).collect()}
    assert len(got) == 21
    r = got["good", "Superforecaster median"]
    assert r.n_resolved == 120 and r.brier == pytest.approx(0.01) and r.skill == pytest.approx(0.96) and r.difference == pytest.approx(-0.09) and r.carries and r.verdict.startswith("better")
    assert got["few", "Always saying 50%"].verdict == "too few" and got["bad", "Always saying 50%"].verdict.startswith("worse") and not got["bad", "Always saying 50%"].carries


@pytest.mark.parametrize("text,want", [
    ("I have 8 lakh in HDFC Bank, 5 lakh in Reliance and 3 lakh in gold", [("Hdfc Bank", 8e5, "large_cap"), ("Reliance", 5e5, "large_cap"), ("Gold", 3e5, "gold")]),
    ("₹1,50,000.50 of my SGB; 2L in S&P fund. 50 in cash", [("Sgb", 150000.5, "gold"), ("S&P Fund", 2e5, "international")]),
    ("3 thousand rupees worth of liquid fund and 1cr in a", [("Liquid Fund", 3e3, "debt")]),
    ("nothing here", []), (None, []), ("5 lakh in the", []),
])
def test_holdings(spark, text, want):
    got = tx.parse_holdings(spark.createDataFrame([(1, text)], "id int, text string")).collect()
    assert [(r.name, r.value, r.bucket) for r in got] == want


@pytest.mark.parametrize("text,kind", [
    ("I want 1 crore in 15 years", "goal"), ("5 lakh for 15 years", "projection"), ("50,000 in a fixed deposit for 10 years", "projection"), ("will the Nifty fall below 22,900 in 30 days", "council"),
    ("I have 5 lakh in gold", "portfolio"), ("I have a question", "council"), ("which fund is good", "fund"), ("Will my fund's NAV rise?", "council"), ("what is value at risk", "risk"), ("repo rate", "data"), (None, "council"), ("", "council"),
    ("Would 5 lakh invested for 10 years double?", "council"), ("Will 5 lakh in a sip for 10 years grow to a crore?", "projection"),
])
def test_question_kinds(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(tx.question_kind(F.col("t"))).first()[0] == kind


def test_fund_search(spark):
    rows = [("Alpha Growth", "House", "Direct", "Growth", "x"), ("Alpha Income", "House", "Regular", None, "x"), ("The Alpha", "House", None, "growth", "y"), ("Other", "Alpha AMC", "direct", "Growth", "x"), ("Beta", "House", None, None, "x")]
    funds = spark.createDataFrame(rows, "name string, amc string, plan string, option string, category string")
    got = [(r.name, r.score, r.peers) for r in tx.fund_search(funds, "alpha fund").collect()]
    assert got == [("Alpha Growth", 6, 4), ("Alpha Income", 3, 4), ("Other", 3, 4), ("The Alpha", 2, 4)]
    assert tx.fund_search(funds, "the fund").count() == 0 and tx.fund_search(funds, "zeta").count() == 0
    assert [r.score for r in tx.fund_search(funds.select("name"), "beta", prefer_direct_growth=False).collect()] == [3]


def test_fabricated_evidence_drops_a_primary_document(spark):
    docs = spark.createDataFrame([("a", "Policy rate stays as it is", "as [E12] says", "primary", 1.0), ("b", "Policy rate stays as it is", "as [E12] says", "press", 1.0), ("c", "Policy rate stays as it is", "as [X12] says", "primary", 1.0)], "id string, title string, summary string, tier string, age_hours double")
    got = {r.id: r for r in tx.screened(docs, "policy rate?").collect()}
    assert got["a"].flags == got["b"].flags == ["fabricated evidence id"] and got["c"].flags == []
    assert got["a"].reason == "instruction-shaped text in a primary feed" and got["b"].reason is None and got["b"].summary == "as [ref] says"


def test_run_logs_leave_out_what_are_no_runs(spark, tmp_path):
    for name, body in (("r1.json", {"run_id": "1"}), ("resolutions.json", {"run_id": "x"}), ("tuning.json", {"run_id": "y"}), ("note.txt", {"run_id": "z"})):
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("{ not json")
    assert [r.run_id for r in feeds.run_logs(spark, str(tmp_path), "run_id string").collect()] == ["1"]


def plain_paths(r, sims, months, block, seed):
    n = len(r)
    size = block if n >= 2 * block else max(1, n // 4)
    out = {}
    for s in range(sims):
        for m in range(months):
            x = (seed * 83492791 % 2147483647 + s * 73856093 + m // size * 19349663) % 2147483647
            for _ in range(3):
                x = (x ^ x >> 15) * 48271 % 2147483647
            out[s, m] = r[x % (n - size + 1) + m % size]
    return out


def test_paths_are_blocks_of_history(spark):
    r = {"long": [0.01 * math.sin(i) for i in range(70)], "short": [0.02 * math.cos(i) for i in range(9)]}
    rows = [(a, i, v) for a, vs in r.items() for i, v in enumerate(vs)] + [("long", 100, None), ("none", 1, None)]
    history = spark.createDataFrame(rows, "asset string, month int, r double").repartition(4)
    got = pj.history_paths(history, 20, 30).collect()
    for a, vs in r.items():
        assert {(x.sim, x.month): x.r for x in got if x.asset == a} == plain_paths(vs, 20, 30, 12, 12345)
    assert len(got) == 1200 and len({tuple(x.r for x in sorted(got, key=lambda y: y.month) if x.asset == "long" and x.sim == s) for s in range(20)}) > 15
    compared = {x.asset: x for x in pj.compare(history, spark.createDataFrame([("long",), ("short",), ("gone",)], "asset string"), 1000.0, 24, 50).collect()}
    assert compared["long"].error is None and compared["long"].n_sims == 50 and compared["short"].error == "9 months of history, need 60" and compared["gone"].error == "0 months of history, need 60" and compared["gone"].nominal_p50 is None


def test_fixed_paths_are_normal(spark):
    rates = spark.createDataFrame([("a", 0.07, 0.12), ("flat", 0.05, 0.0)], "asset string, rate double, vol double")
    rows = pj.fixed_paths(rates, 400, 24).collect()
    z = [(r.r - (1.07 ** (1 / 12) - 1)) / (0.12 / 12**0.5) for r in rows if r.asset == "a"]
    assert abs(statistics.mean(z)) < 0.03 and abs(statistics.pstdev(z) - 1) < 0.03 and abs(sum(abs(x) > 1.96 for x in z) / len(z) - 0.05) < 0.01
    by = {(r.sim, r.month): (r.r - (1.07 ** (1 / 12) - 1)) for r in rows if r.asset == "a"}
    pairs = [(by[s, m], by[s, m + 1]) for s in range(400) for m in range(23)]
    assert abs(statistics.correlation(*map(list, zip(*pairs)))) < 0.04 and {r.r for r in rows if r.asset == "flat"} == {1.05 ** (1 / 12) - 1}


def test_projection_and_taxes_by_hand(spark):
    paths = [("gold", s, m, 0.1 if s == 0 else -0.05 + 0.1 * (m == 1)) for s in range(3) for m in range(24)] + [("fixed_deposit", s, m, 0.01) for s in range(3) for m in range(12)]
    frame = spark.createDataFrame(paths, "asset string, sim int, month int, r double")
    got = {r.asset: r for r in pj.project(frame, 1000.0).collect()}
    g = got["gold"]
    up, down = 1000 * 1.1**24, 1000 * 0.95**23 * 1.05
    assert g.nominal_p50 == pytest.approx(down) and g.nominal_p95 == pytest.approx(down + 0.9 * (up - down)) and g.p_loss == pytest.approx(2 / 3)
    assert g.after_tax_p95 == pytest.approx(down + 0.9 * (up - 0.125 * (up - 1000) - down)) and g.real_p50 == pytest.approx(down / 1.055**2) and g.net_real_p5 == pytest.approx(down / 1.055**2)
    assert g.median_fall == pytest.approx(0.95**22 - 1) and g.median_growth == pytest.approx((down / 1000) ** 0.5 - 1)
    f = got["fixed_deposit"]
    assert f.after_tax_p50 == pytest.approx(1000 * 1.01**12 - 0.3 * (1000 * 1.01**12 - 1000)) and f.p_below_deposit == 0
    monthly = {r.asset: r for r in pj.project(frame, 100.0, "monthly").collect()}["fixed_deposit"]
    assert monthly.paid == 1200 and monthly.nominal_p50 == pytest.approx(100 * sum(1.01**k for k in range(12)))
    goal = {r.asset: r for r in pj.plan_goal(frame, 1e4).collect()}["fixed_deposit"]
    assert goal.monthly_50 == pytest.approx(1e4 / sum(1.01**k for k in range(12))) and goal.contributed == pytest.approx(12 * goal.monthly_50) and goal.target_today == pytest.approx(1e4 / 1.055)
    for bad in (lambda: pj.project(frame, 0.0), lambda: pj.project(frame, 1.0, "weekly"), lambda: pj.plan_goal(frame, 0.0)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("text,want", [
    ("Mon, 01 Jul 2024 10:00:00 +0530", (2024, 7, 1, 4, 30)), ("Mon, 01 Jul 2024 10:00:00", (2024, 7, 1, 4, 30)), ("24 Sep, 2024 +0530", (2024, 9, 23, 18, 30)), ("24 Sep 2024 +0000", (2024, 9, 24, 0, 0)), ("24 Sep, 2024", (2024, 9, 23, 18, 30)),
    ("Mon, 1 Jul 2024", (2024, 6, 30, 18, 30)), ("2024-07-01T10:00:00+02:00", (2024, 7, 1, 8, 0)), ("2024-07-01T10:00:00+0200", (2024, 7, 1, 8, 0)), ("2024-07-01T10:00:00Z", (2024, 7, 1, 10, 0)), ("2024-07-01 10:00:00", (2024, 7, 1, 4, 30)),
    ("2024-07-01", (2024, 6, 30, 18, 30)), ("yesterday", None), ("", None), (None, None),
])
def test_dates_of_every_format(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(feeds.parsed_time(F.col("t")).cast("timestamp_ntz")).first()[0]
    assert got == (want and dt.datetime(*want))


def test_replies_without_a_timeline(spark):
    docs = ["Please Limit requests to one every 5 seconds", "<html>", '{"timeline": []}', "{}", None, '{"timeline":[{"data":[{"date":"20240701T000000Z","value":1.5}]}]}']
    raw = spark.createDataFrame([(d,) for d in docs], "value string")
    assert [r[0] for r in raw.select(feeds.tone_problem(F.col("value"))).collect()] == ["rate limit hit", "not JSON", "empty timeline", "empty timeline", "not JSON", None]
    assert [tuple(r) for r in feeds.tone_timeline(raw).collect()] == [(dt.date(2024, 7, 1), 1.5)]
    with pytest.raises(Exception, match="no timeline"):
        feeds.tone_timeline(raw, strict=True).collect()


def test_catalogue(spark):
    rows = [(0, "a", "working", "x", None, True, ["s", "t"], ["bond"]), (1, "b", "planned", "y", dt.date(2024, 1, 1), None, ["t"], ["bond", "fx"]), (2, "c", "fragile", "x", dt.date(2024, 1, 1), False, [], None)]
    sources = spark.createDataFrame(rows, "position int, source string, status string, domain string, last_verified date, needs_key boolean, series array<string>, asset_classes array<string>")
    one = ledger.catalogue_summary(sources).first().asDict()
    assert one == {"sources": 3, "working": 1, "fragile": 1, "blocked": 0, "planned": 1, "verified": 2, "domains": 2, "need_key": 1, "series": 2}
    assert {r.domain: r.series for r in ledger.catalogue_summary(sources, ["domain"]).collect()} == {"x": 2, "y": 1} and ledger.catalogue_summary(sources.limit(0)).first().sources == 0
    assert [r.source for r in ledger.catalogue_where(sources, domain="x").collect()] == ["a", "c"] and [r.source for r in ledger.catalogue_where(sources, status="planned", asset_class="fx").collect()] == ["b"]


def test_market_duel_needs_rows_and_a_margin(spark):
    duel = lambda n, p, m: ledger.market_duel(spark.createDataFrame([(p, m, 1)] * n + [(1 - p, 1 - m, 0)] * n, "p double, m double, y int")).collect()
    assert duel(0, 0.5, 0.5) == [] and duel(9, 0.9, 0.5)[0].verdict == "inconclusive" and duel(10, 0.9, 0.5)[0].verdict == "ahead of the market" and duel(10, 0.5, 0.9)[0].verdict == "behind the market"
    r = duel(20, 0.8, 0.8)[0]
    assert r.verdict.startswith("indistinguishable") and r.forecast_log == pytest.approx(-math.log(0.8)) and r.mean_gap == pytest.approx(0)


def test_trailing_growth_counts_steps(spark):
    month = lambda i: dt.date(2010 + i // 12, i % 12 + 1, 5)
    rows = [("long", month(i), 100 * 1.01**i) for i in range(25)] + [("short", month(i), 1.0 + i) for i in range(24)]
    got = {r.entity: r.growth for r in ln.trailing_growth(spark.createDataFrame(rows, "entity string, date date, price double"), 2).collect()}
    assert got["long"] == pytest.approx(1.01 ** (23 / 2) - 1) and got["short"] == 0.055


def test_entities_without_a_weight_have_no_share(spark):
    cov = spark.createDataFrame([(i, j, 0.04 if i == j else 0.01) for i in "abc" for j in "abc"], "i string, j string, cov double")
    got = {r.entity: r for r in risk.risk_contributions(cov, spark.createDataFrame([("a", 0.5), ("b", 0.5)], "entity string, weight double")).collect()}
    assert got["c"].weight == 0 and got["c"].share == 0 and got["a"].share == pytest.approx(0.5) and got["a"].vol == pytest.approx(math.sqrt(0.025))


def test_any_resolver(spark):
    rows = [(1, 5.0, None), (2, None, "x"), (3, 1.0, "y"), (None, 2.0, None)]

    def resolver(q):
        if q["level"] is None:
            raise LookupError("no level")
        return None if q["name"] is None and q["id"] else q["level"] > 1

    got = sorted(map(tuple, ledger.resolved_by(spark.createDataFrame(rows, "id long, level double, name string"), resolver, "id").collect()), key=str)
    assert got == sorted([(1, None, "not resolvable yet"), (2, None, "LookupError: no level"), (3, False, None), (None, True, None)], key=str)


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "runs"), "run_id string, started_at int, status string, detail string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert ledger.stored(spark, path, schema).count() == 0
    ledger.log_run(frame([(f"r{i}", 1, "ok", "d" * 3000) for i in range(300)] + [(None, 1, "ok", None)]), path)
    files = lambda: set(glob.glob(f"{path}/bucket=*/*.parquet"))
    before = files()
    new = [("r1", 2, "again", "x"), ("r2", 0, "older", "x"), ("r3", 1, "same time", "x"), ("new", 1, "ok", "x"), (None, 5, "null", "x")]
    ledger.log_run(frame(new), path)
    got = {r.run_id: (r.started_at, r.status) for r in ledger.stored(spark, path, schema).collect()}
    assert len(got) == 302 and got["r1"] == (2, "again") and got["r2"] == (1, "ok") and got["r3"] == (1, "same time") and got[None] == (5, "null") and got["r7"] == (1, "ok")
    kept = {os.path.dirname(f) for f in before & files()}
    assert len(kept) >= len({os.path.dirname(f) for f in before}) - 5
    ledger.log_run(frame(new), path)
    assert {r.run_id: (r.started_at, r.status) for r in ledger.stored(spark, path, schema).collect()} == got and max(len(r.detail or "") for r in ledger.stored(spark, path, schema).collect()) == 2000
    ledger.log_run(frame([]), path)
