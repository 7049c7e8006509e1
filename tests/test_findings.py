"""Odd rows that once made queries and their SQL disagree: books without levels, mids outside (0, 1), exact ties."""

import datetime as dt
import hashlib
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
from test_queries import key, same
from tidemark.operators import pairs
from tidemark.operators import resampling as rs

START = dt.datetime(2024, 1, 1)


def market(path):
    """Two markets with quotes whose mid reaches or passes 1, so that books lose one side or both, and trades beside them."""
    values = [100.0, 120.0, 560.0, 505.0, 90.0, 560.0, 250.0, 530.0]
    kinds = ["view", "purchase", "click", "view", "signup", "view", "click", "purchase"]
    rows = [(i, START + dt.timedelta(hours=3 * i), i % 2, kinds[(i // 2) % 8], values[(i // 2 + i // 16) % 8], f'{{"k": {7 + i % 90}}}') for i in range(64)]
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, ?, ?, ?, ?, ?)", rows)
    con.execute("create table customer as select i::bigint as c_custkey, 1::integer as c_nationkey from range(2) r(i)")
    for t in ("events", "customer"):
        con.execute(f"copy {t} to '{path}/{t}.parquet' (format parquet)")
    return con


def agree(spark, con, path, name):
    df = entry_module.queries()[name](spark, str(path))
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    rel = con.execute(entry_module.oracle_sql()[name])
    idx = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in idx) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(u, v) for u, v in zip(a, b)), (a, b)
    return [dict(zip(cols, r)) for r in got]


@pytest.mark.parametrize("name", [
    "a70_lineage_audit", "f02_depth_walk", "f05_book_features", "f26_entry_evaluation", "s39_extraction_report", "s39_integrity_report",
    "s12_book_source", "s16_bbo_feed", "p02_book_eligibility", "w03_anomalies",
])
def test_book_without_levels_is_a_book(spark, tmp_path, name):
    rows = agree(spark, market(tmp_path), tmp_path, name)
    if name == "f05_book_features":
        assert any(r["bid_depth"] == r["ask_depth"] == r["imbalance"] == 0 and r["midpoint"] is None for r in rows)
    if name == "f02_depth_walk":
        assert any(r["filled"] == 0 and r["vwap"] is None for r in rows)


def test_trade_price_outside_the_venue_is_rejected(spark, tmp_path):
    rows = agree(spark, market(tmp_path), tmp_path, "s13_trade_source")
    assert {"", "price_out_of_range"} == {r["rejects"] for r in rows}


def test_incorporation_needs_a_logit(spark, tmp_path):
    agree(spark, market(tmp_path), tmp_path, "j04_incorporation_curve")


def test_fanout_mean_is_over_quotes_with_a_logit(spark, tmp_path):
    rows = agree(spark, market(tmp_path), tmp_path, "j22_shock_fanout")
    assert any(r["mean_logit"] is not None and abs(r["mean_logit"]) > 0 for r in rows)


def test_equal_strategies_tie_exactly(spark, tmp_path):
    """Three strategies with the same fills in another order: their mean squared error lies on half a millionth."""
    draw = random.Random(18)
    sizes = [draw.randint(1, 50) for _ in range(32 * draw.randint(2, 9))]
    orders = [sorted(sizes), sorted(sizes, reverse=True), sorted(sizes, key=lambda q: q * 7 % 51)]
    rows = [(i, 1, 1, s, float(q), 100.25, 0.02, 0.03, "R" if q % 2 else "A", "O", START + dt.timedelta(hours=i)) for s, qs in enumerate(orders) for i, q in enumerate(qs)]
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute("""create table lineitem (l_orderkey bigint, l_linenumber integer, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double,
     l_tax double, l_discount double, l_returnflag varchar, l_linestatus varchar, l_shipdate timestamp)""")
    con.executemany("insert into lineitem values (?, ?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    rows = agree(spark, con, tmp_path, "a28_strategy_comparison")
    assert len({(r["net_pnl"], r["brier"]) for r in rows}) == 1
    assert sorted((r["brier_rank"], r["strategy"]) for r in rows) == [(1, "s0"), (2, "s1"), (3, "s2")]
    assert sorted((r["pnl_rank"], r["strategy"]) for r in rows) == [(1, "s2"), (2, "s1"), (3, "s0")]


@pytest.mark.parametrize("name", ["f13_uncertainty_estimates", "a31_degradation_tests", "a31_gaussian_noise"])
def test_rows_are_not_shuffled_by_category(spark, sf, name):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry_module.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert [j for j in plan.splitlines() if "SortMergeJoin" in j and "category" in j] == []
    assert "BroadcastHashJoin" in plan


def test_a_worker_draws_a_permutation_once():
    first = rs.drawn_bijection(4096, 5, 3)
    assert rs.drawn_bijection(4096, 5, 3) is first
    assert (first == rs.bijection(4096, rs.round_keys(5, 3))).all()


def test_digests_of_many_texts_equal_the_library_s():
    names = [None, "", "m1|19723", "m1499|19723", "é" * 9, "x" * 44, "x" * 49, "x" * 50, "x" * 51, "y" * 70]
    draws = rs._digest_draws(names, 42, 103)
    for i, name in enumerate(names):
        for b in range(103):
            text = "|".join(["42", str(b), *([] if name is None else [name])])
            assert draws[i, b].tobytes() == hashlib.md5(text.encode()).digest(), (name, b)
    u = draws.reshape(len(names), -1) / 4294967296.0
    assert (rs.cluster_weights(names, 410, 42) == np.searchsorted(rs._POISSON, u, side="right")[:, :410]).all()


def planned(spark, sf, name):
    return entry_module.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_wires_are_parsed_once(spark, sf):
    assert planned(spark, sf, "s17_canonical_books").count("from_json(") == 1


def test_revisions_share_the_search_in_the_ladder(spark, sf):
    assert "l_quantity" not in planned(spark, sf, "j26_surprise_reactions")


def test_autopsy_markets_move_once_whatever_their_classes(spark, sf):
    dealt = [line for line in planned(spark, sf, "a49_autopsy_summary").splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("class" in line and "market_id" in line for line in dealt)


def test_consensus_reads_the_snapshots_once(spark, sf):
    assert planned(spark, sf, "a09_ensemble_consensus").count("l_quantity#") > 0
    assert sum("FileScan parquet" in line and "l_quantity" in line for line in planned(spark, sf, "a09_ensemble_consensus").splitlines()) == 1


def test_terms_meet_only_texts_of_their_date(spark, monkeypatch):
    from tidemark.plans import evidence

    kept = []
    monkeypatch.setattr(evidence, "checkpointed", lambda df: kept.append(df.count()) or df)
    terms = spark.createDataFrame([(1, "1|a b", "d1", ["a", "b"])], "item_id long, term_id string, date string, term array<string>")
    texts = spark.createDataFrame([("s1", "d1", ["a", "b", "c"]), ("s2", "d1", ["a"]), ("s3", "d2", ["a", "b"])], "slug string, date string, held array<string>")
    assert [r.slug for r in evidence.contained(terms, texts).collect()] == ["s1"]
    assert kept == [4]


def test_quotes_without_log_odds_count_as_the_sql_counts_them(spark, tmp_path):
    con = market(tmp_path)
    df = entry_module.queries()["w12_incorporation_times"](spark, str(tmp_path))
    rel = con.execute(entry_module.oracle_sql()["w12_incorporation_times"])
    names = [d[0] for d in rel.description]
    got, want = (sorted([str(v) if v != v else v for v in r] for r in rows) for rows in (df.select(*names).collect(), rel.fetchall()))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(u == v or same(u, v) for a, b in zip(got, want) for u, v in zip(a, b))
    odd = [r for r in got if r[names.index("total_move")] == "nan"]
    assert odd and len(odd) < len(got) and all(r[names.index("t90_us")] is not None for r in odd)


def test_records_that_say_the_same_are_no_repeats(spark, tmp_path):
    rows = [(i, START + dt.timedelta(hours=i % 50), 0, "purchase" if i % 3 else "view", 100.0 + i % 50, f'{{"k": {7 + i % 50}}}') for i in [*range(10), *range(150, 160)]]
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    found = {(r["feed"], r["metric"]): r["value"] for r in agree(spark, con, tmp_path, "s39_integrity_report")}
    assert found["trades", "seen"] == 12 and found["trades", "duplicates"] == 0
    assert found["books", "seen"] == 10 and found["books", "duplicates"] == 2


def test_fan_out_is_not_shuffled(spark, sf):
    lines = planned(spark, sf, "j22_shock_fanout").splitlines()
    at = next(i for i, line in enumerate(lines) if "FlatMapGroupsInArrow" in line)
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789")), []
    for line in reversed(lines[:at]):
        if (d := len(line) - len(line.lstrip(" :+-*()0123456789"))) < depth:
            depth, above = d, [*above, line]
    assert any("Union" in line for line in above) and not any("Exchange" in line or "Join" in line for line in above)


def test_blocks_that_meet_are_tasks_of_their_own(spark, sf):
    from pyspark.sql import functions as F

    moves = spark.createDataFrame([(e, f"m{m}", m, t, float(m * t % 7)) for e in range(2) for m in range(10 * e, 10 * e + 10) for t in range(9)],
                                  "event int, member string, `order` long, t long, value double")
    found = pairs.ridge_pairs(moves, lambda days: days // 3, 8, 3, block=2)
    assert found.count() == 90
    assert found.select(F.spark_partition_id()).distinct().count() == 4  # all partitions of the session: bytes do not join them
