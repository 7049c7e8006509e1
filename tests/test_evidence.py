"""Provider extractors, manifest verification, term containment and hash chains on small cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.plans import evidence, extraction
from tidemark.sources import providers, rawlog
from tidemark.sources.providers import Provider

SHAPES = {p.name: p for p in (
    Provider("weather", "poll", 3_600, "temp double, station string", lambda p: {"temp": p["temp"], "frost": (p["temp"] < 0).cast("int")}),
    Provider("scores", "push", 60, "home int, away int", lambda p: {"lead": p["home"] - p["away"]}))}


def test_providers_with_schemas_of_their_own(spark):
    rows = [("weather", "a", 10, '{"temp": -2.5, "station": "x"}'), ("weather", "b", 20, '{"station": "x"}'), ("scores", "c", 30, '{"home": 3, "away": 1}'),
            ("scores", "d", 40, "not json"), ("scores", "e", 50, None), ("other", "f", 60, '{"temp": 1}')]
    got = providers.extracted(spark.createDataFrame(rows, "provider string, entity string, observed_us long, payload string"), SHAPES).collect()
    assert {(r.entity, r.feature): (r.value, r.source_class, r.expires_us) for r in got} == {
        ("a", "temp"): (-2.5, "poll", 3610), ("a", "frost"): (1.0, "poll", 3610), ("c", "lead"): (2.0, "push", 90),
        ("d", "unparsed"): (1.0, "push", 100), ("e", "unparsed"): (1.0, "push", 110), ("f", "unknown_provider"): (1.0, None, None)}


def test_provider_filters_reach_the_scan(spark, tmp_path):
    rows = [("weather", f"s{i}", i, '{"temp": 1.5, "station": "x"}') for i in range(50)]
    spark.createDataFrame(rows, "provider string, entity string, observed_us long, payload string").write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = providers.extracted(spark.read.parquet(str(tmp_path / "p")), SHAPES).where("provider = 'weather' and observed_us > 40")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(provider,weather)" in plan and "GreaterThan(observed_us,40)" in plan and df.count() == 18


def test_a_provider_is_registered_once():
    providers.register(SHAPES["weather"])
    try:
        with pytest.raises(ValueError):
            providers.register(SHAPES["weather"])
    finally:
        providers.REGISTRY.clear()


def sealed(spark, days=3, n=40):
    rows = [(d * n + i, f"wire {d} {i}", "s", d, (d * n + i) * 1000, 10) for d in range(days) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, wire string, source string, day long, received_ns long, k long").withColumn("sha256", F.sha2("wire", 256))


def test_verification_names_what_changed(spark, monkeypatch):
    monkeypatch.setattr(rawlog, "FANOUT", 4)
    rows = sealed(spark)
    manifests = rawlog.manifest(rows)
    altered = rows.withColumn("wire", F.when(F.col("seq").isin(41, 70), F.lit("other")).otherwise(F.col("wire"))).where("seq <> 119")
    got = {r.day: r for r in rawlog.verify(rows, manifests, altered).collect()}
    assert (got[0].status, got[0].changed_records) == ("ok", 0)
    assert (got[1].status, got[1].changed_records, got[1].first_changed, got[1].last_changed) == ("root mismatch", 2, 41, 70)
    assert (got[2].status, got[2].changed_records, got[2].first_changed) == ("count mismatch", 1, 119)
    broken = manifests.withColumn("previous", F.when(F.col("day") == 2, F.lit("x")).otherwise(F.col("previous")))
    assert {r.day: r.status for r in rawlog.verify(rows, broken, rows).collect()} == {0: "ok", 1: "ok", 2: "chain broken"}


def test_terms_are_found_by_their_rarest_word(spark):
    texts = [(f"t{i}", "d1" if i < 90 else "d2", ["the", "of", "rare" if i in (3, 95) else "plain"]) for i in range(100)]
    terms = [(1, "a", "d1", ["the", "of", "rare"]), (1, "b", "d1", ["the", "unknown"]), (2, "c", "d2", ["of", "the"])]
    found = evidence.contained(spark.createDataFrame(terms, "item_id long, term_id string, date string, term array<string>"),
                               spark.createDataFrame(texts, "slug string, date string, held array<string>")).collect()
    assert {(r.term_id, r.slug) for r in found} == {("a", "t3")} | {("c", f"t{i}") for i in range(90, 100)}


def test_hash_chains(spark):
    rows = [("a", i, str(i), f"line {i}") for i in range(30)] + [("b", 1, "x", "only")]
    roots = {}
    for symbol, _, _, line in rows:
        roots[symbol] = hashlib.sha256(f"{roots.get(symbol, hashlib.sha256(b'').hexdigest())}|{line}".encode()).hexdigest()
    got = extraction.chained(spark.createDataFrame(rows, "symbol string, ts_us long, rid string, line string").repartition(4)).collect()
    assert {r.symbol: (r.updates, r.root) for r in got} == {"a": (30, roots["a"]), "b": (1, roots["b"])}
