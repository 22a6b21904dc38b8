"""Option chains, ensembles, factors, prose and question operators against closed forms and literal answers."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors, forecasts, models, options, portfolio, prose, questions, risk
from tidemark.sources import feeds

DAY = dt.date(2024, 1, 1)


def lognormal_chain(spark, vol=0.15, years=0.25, spot=100.0, step=1.0):
    from statistics import NormalDist

    n, rows = NormalDist().cdf, []
    for i, k in enumerate(np.arange(80.0, 120.5, step)):
        d1 = (math.log(spot / k) + (0.0525 + vol**2 / 2) * years) / (vol * years**0.5)
        call = spot * n(d1) - k * math.exp(-0.0525 * years) * n(d1 - vol * years**0.5)
        for side, c in (("CE", call), ("PE", call - spot + k * math.exp(-0.0525 * years))):
            rows.append(("e", i, float(k), side, 10, float(c), float(c), float(c), spot, years))
    return spark.createDataFrame(rows, "expiry string, at int, strike double, side string, oi int, bid double, ask double, ltp double, spot double, years double")


def test_chain_gives_back_its_distribution(spark):
    from statistics import NormalDist

    cdf = options.implied(lognormal_chain(spark))
    got = options.quantiles(cdf).first()
    z = lambda q: 100 * math.exp((0.0525 - 0.15**2 / 2) * 0.25 + NormalDist().inv_cdf(q) * 0.075)
    for name, q in (("q05", 0.05), ("median", 0.5), ("q95", 0.95)):
        assert abs(got[name] - z(q)) < 0.5
    r = options.reliability(cdf).first()
    assert r["reliable"] and r["reason"] == ""
    p = options.prob_below(cdf, 105.0).first()
    assert abs(p["p_above"] + p["p_below"] - 1) < 1e-12 and abs(p["p_touch"] - 2 * p["p_above"]) < 1e-9


def test_thin_and_constant_chains_are_not_trusted(spark):
    thin = options.reliability(options.implied(lognormal_chain(spark, step=4.0))).first()
    assert not thin["reliable"] and "only 11 strikes" in thin["reason"]
    flat = lognormal_chain(spark).withColumns({c: F.lit(5.0) for c in ("bid", "ask", "ltp")})
    assert not options.reliability(options.implied(flat)).first()["reliable"]
    assert options.implied(lognormal_chain(spark, step=8.0)).isEmpty()


def test_expiry_formats(spark):
    days = spark.createDataFrame([("25-DEC-2024",), ("5-Jan-2025",), ("01-02-2025",), ("2024-12-01",), ("soon",), (None,)], "e string")
    got = [r[0] for r in days.select(options.years_to(F.col("e"), F.lit(dt.date(2024, 12, 5)))).collect()]
    assert [None if g is None else round(g * 365, 6) for g in got] == [20.5, 31.5, 58.5, 0.5, None, None]


def test_ensemble_has_every_estimator(spark):
    r = np.random.default_rng(4).standard_t(4, 500) * 0.01
    rows = [("a", DAY + dt.timedelta(i), float(x)) for i, x in enumerate(r)] + [("b", DAY + dt.timedelta(i), 0.01) for i in range(10)]
    got = models.var_ensemble(spark.createDataFrame(rows, "entity string, date date, r double")).collect()
    assert len(got) == 10 and {x["method"] for x in got} == set(models.ENSEMBLE)
    a = {x["method"]: x for x in got if x["entity"] == "a"}
    assert abs(a["historical"]["var"] + np.quantile(r, 0.01)) < 1e-12 and abs(a["parametric_normal"]["var"] + r.mean() - 2.3263479 * r.std(ddof=1)) < 1e-6
    assert all(x["error"] == "" and x["n_obs"] == 500 and x["spread_ratio"] >= 1 for x in a.values())
    assert all(x["var"] is None and x["error"] == "need >= 30 observations for VaR, got 10" for x in got if x["entity"] == "b")


def test_unknown_estimator_lists_the_known_ones(spark):
    with pytest.raises(ValueError, match="ledoit_wolf"):
        models.estimate(spark.createDataFrame([], "entity string, date date, r double"), "guess")


def test_prices_that_stand_still(spark):
    rows = [("a", DAY + dt.timedelta(i), 1.0 if 10 <= i < 20 else float(i)) for i in range(80)] + [("b", DAY + dt.timedelta(2 * i), 5.0) for i in range(10)]
    got = {r["entity"]: r for r in risk.align_prices(spark.createDataFrame(rows, "entity string, date date, price double")).collect()}
    assert got["a"]["kept"] and got["a"]["max_stale_run"] == 9 and got["a"]["suspect"] and got["a"]["coverage"] == 1.0
    assert not got["b"]["kept"] and got["b"]["stale_days"] == 0 and got["b"]["coverage"] == 0.125


def test_exposures_use_what_is_there(spark):
    rows = [(DAY, f"e{i}", float(10**i), float(i), None if i == 3 else float(i)) for i in range(7)]
    x = factors.build_exposures(spark.createDataFrame(rows, "date date, entity string, market_cap double, roe double, debt_to_equity double"), ["date"]).orderBy("entity").collect()
    assert "momentum" not in x[0].asDict() and all(r["market"] == 1.0 for r in x)
    assert x[0]["size"] > 0 > x[6]["size"] and abs(sum(r["size"] for r in x)) < 1e-9
    z = (np.arange(7) - 3) / np.arange(7).std(ddof=1)
    assert abs(x[3]["quality"] - z[3] / 2) < 1e-9


def test_risk_adds_up(spark):
    rng, cov = np.random.default_rng(1), np.array([[4e-4, 1e-4], [1e-4, 2e-4]])
    x, w, s = rng.standard_normal((6, 2)), rng.random(6), rng.random(6) * 0.01 + 0.01
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = factors.risk_decomposition(
        df([(f"e{i}", float(w[i])) for i in range(6)], "entity string, weight double"), df([(f"e{i}", *map(float, x[i])) for i in range(6)], "entity string, f double, g double"),
        df([(a, b, float(cov[i, j])) for i, a in enumerate("fg") for j, b in enumerate("fg")], "i string, j string, cov double"), df([(f"e{i}", float(s[i])) for i in range(6)], "entity string, specific double"), ["f", "g"],
    ).collect()
    fx, sv = x.T @ w, float(((w * s) ** 2).sum())
    fv = float(fx @ cov @ fx)
    assert all(abs(r["total_vol"] - math.sqrt(fv + sv)) < 1e-12 and abs(r["pct_factor"] - fv / (fv + sv)) < 1e-12 for r in got)
    assert abs(sum(r["contribution"] for r in got) + got[0]["pct_specific"] - 1) < 1e-12


def test_prose(spark):
    said = {
        "5 lakh in gold for 15 years": (5e5, 15.0, "gold", "lumpsum"), "10,000 monthly sip for 18 months": (10_000.0, 1.5, "indian_equity", "sip"), "Rs. 2 crore FD over 600 y": None,
        "what about gold": None, "I put 600 for 600 months": None, "2.5 cr in nifty for 10 years": (2.5e7, 10.0, "indian_equity", "lumpsum"), "1.2.3 years 5 lakh": None,
    }
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", prose.projection_of(F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"] and tuple(r["p"]) for r in got} == said
    goal = spark.createDataFrame([("I want 1 crore in 15 years",), ("I want 9000 in 2 years",)], "t string").select(prose.goal_of(F.col("t")).alias("g")).collect()
    assert [g["g"] and tuple(g["g"]) for g in goal] == [(1e7, 15.0, "indian_equity"), None]


def test_asset_classes(spark):
    said = {"Will Brent go above 140?": "commodity", "housing in Pune": "real_estate", "gold or a share": "commodity", "shares, stocks and gold": "equity", "good morning": None}
    got = spark.createDataFrame([(k,) for k in said], "text string")
    assert {r["text"]: r["c"] for r in got.select("text", prose.asset_class(F.col("text")).alias("c")).collect()} == said
    cover = spark.createDataFrame([("commodity", True), ("real_estate", False)], "asset_class string, can_answer boolean")
    assert {r["text"] for r in prose.coverage_gap(got, cover).collect()} == {"housing in Pune", "shares, stocks and gold"}


def test_json_in_replies(spark):
    said = ['{"a": 1}', 'x ```json\n{"a": True,}\n``` y', 'so {"a": "}", "b": {"c": None}} ok {', "[1, 2]", "", None, '{"a": NaN}', "{broken"]
    got = [r[0] and json.loads(r[0]) for r in spark.createDataFrame([(s,) for s in said], "t string").select(prose.extract_json("t")).collect()]
    assert got == [{"a": 1}, {"a": True}, {"a": "}", "b": {"c": None}}, None, None, None, {"a": None}, None]


def test_answers_are_mended(spark):
    rows = [(85.0, None, None, 2.0), (-1.0, None, None, None), (None, {"x": 2.0, "y": 6.0}, None, 0.3), (None, {"x": 0.0}, None, 0.3), (None, None, {"0.1": 2.0, "0.9": 1.0}, 0.3), (None, None, {"0.05": 1.0, "0.5": 1.0}, 0.3), (None, None, None, 0.3)]
    got = forecasts.coerce(spark.createDataFrame(rows, "probability double, distribution map<string,double>, quantile_values map<string,double>, confidence double")).collect()
    assert [r["probability"] for r in got[:2]] == [0.85, 0.0] and [r["confidence"] for r in got[:3]] == [1.0, 0.5, 0.3] and got[2]["distribution"] == {"x": 0.25, "y": 0.75}
    assert [r["problem"] for r in got] == [None, None, None, "categorical distribution sums to <= 0", "quantiles must be non-decreasing", None, "no answer"]


def test_questions(spark):
    latest = spark.createDataFrame([("NIFTY50_CLOSE", 24_512.0), ("USDINR", 84.1), ("GOLD_USD", 0.0), ("OTHER", 5.0)], "series_id string, value double")
    vols = spark.createDataFrame([("USDINR", 0.1)], "series_id string, vol double")
    got = questions.generate(latest, vols, dt.date(2024, 7, 1)).collect()
    assert sorted(r["series_id"] for r in got) == ["NIFTY50_CLOSE"] * 2 + ["USDINR"] * 2 and len({r["id"] for r in got}) == 4
    for r in got:
        spot, vol = (24_512.0, 0.13) if r["series_id"] == "NIFTY50_CLOSE" else (84.1, 0.1)
        level = spot + (-1 if r["direction"] == "below" else 1) * spot * vol * math.sqrt(r["horizon"] / 252) * r["step"]
        assert r["level"] == (round(level / 10) * 10 if vol == 0.13 else round(level, 2)) and f"{r['level']:,.{0 if vol == 0.13 else 2}f}" in r["text"]
    every = questions.generate(latest, vols, dt.date(2024, 7, 1), 100).collect()
    assert len({r["id"] for r in every}) == len(every) > 20


def test_assets_side_by_side(spark):
    one = lambda rate: portfolio.normal_paths(spark, rate, 0.1, 200, 24)
    both = portfolio.project(one(0.05).withColumn("asset", F.lit("a")).unionByName(one(0.09).withColumn("asset", F.lit("b"))), 1000.0).orderBy("asset").collect()
    for r, rate in zip(both, (0.05, 0.09)):
        alone = portfolio.project(one(rate), 1000.0).first()
        assert all(abs(r[c] - alone[c]) < 1e-9 for c in alone.asDict())


def test_landed_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"member": "a", "kind": "binary", "p": 0.5, "y": 1}\nnot json\n')
    assert [r["member"] for r in feeds.track_record(spark, str(tmp_path / "t.jsonl")).collect()] == ["a"]
    with pytest.raises(ValueError, match="brent"):
        feeds.commodity("tin", None, None)
    doc = feeds.run_document(spark.createDataFrame([("q", [0.1])], "id string, p array<double>")).first()["value"]
    assert json.loads(doc) == {"id": "q", "p": [0.1]}
    rate = feeds.rate_observations(spark.createDataFrame([("REPO", "Repo", DAY, 6.5, "pct")], "series_id string, label string, date date, value double, unit string"), F.lit(dt.datetime(2024, 1, 2))).first()
    assert rate["source"] == "RBI" and json.loads(rate["meta"]) == {"label": "Repo"}


def test_fingerprint_is_that_of_the_json(spark):
    import hashlib

    rows = [["E01", 'a "b"', "1.5", "2024-01-01"], ["E02", "c", "x, y", ""]]
    df = spark.createDataFrame([([tuple(r) for r in rows],)], "items array<struct<id:string,label:string,value:string,event_date:string>>")
    assert df.select(questions.fingerprint(F.col("items"))).first()[0] == hashlib.sha256(json.dumps(rows).encode()).hexdigest()[:16]


def test_nulls_score_nothing(spark):
    df = spark.createDataFrame([("d", float(i) if i else None, None if i == 1 else 0.5) for i in range(8)], "d string, x double, p double")
    z = {r["x"]: r["z"] for r in risk.zscore(df, ["d"], "x").collect()}
    assert z[None] == 0.0 and abs(sum(z.values())) < 1e-9
    assert df.select(F.count("p"), F.count(forecasts.clamp(F.col("p")))).first() == (7, 7)
