"""Hand-made rows at the edges of each operator: paths, digests, values, periods, keys, growth, valuation, streams."""

import hashlib
import json
import math

import pytest

from tallyforge.functions.columns import inside, resolved_segments
from tallyforge.operators import analysis, corpus, facts
from tallyforge.sources import corpus_tables as src
from tallyforge.streaming import landings

MANIFEST = "id string, origin string, path string, url string, sha256 string"
FACTS = "document string, name string, value string, unit string, period string, page int"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize(
    ("path", "resolved", "ok"),
    [
        (r"a\b\c.pdf", "corpus/files/a/b/c.pdf", True), ("a/../b.pdf", "corpus/files/b.pdf", True), ("./a//b", "corpus/files/a/b", True), (".", "corpus/files", True),
        ("../x", "corpus/x", False), ("a/../../x", "corpus/x", False), ("/etc/x", "etc/x", False), (r"C:\x", "C:/x", False), ("a/../../files/b", "corpus/files/b", True),
        ("../../../../corpus/files/b", "corpus/files/b", True), ("../filesystem/x", "corpus/filesystem/x", False), ("", "corpus/files", True),
    ],
)
def test_paths(spark, path, resolved, ok):
    df = spark.createDataFrame([(path,)], "path string")
    segments = resolved_segments(df.path, corpus.ROOT)
    row = corpus.normalize_path(df).select("norm_path", inside(segments, corpus.ROOT).alias("ok")).first()
    assert (row["norm_path"], row["ok"]) == (resolved, ok)


def test_a_null_path_is_rejected_and_a_bad_path_fails_a_strict_run(spark):
    df = spark.createDataFrame([("a",), (None,), ("../x",)], "path string")
    good, bad = corpus.reject_escaping_paths(df)
    assert [r["path"] for r in good.collect()] == ["a"] and {r["path"] for r in bad.collect()} == {None, "../x"}
    with pytest.raises(ValueError, match="outside the root"):
        corpus.require_inside(df)
    assert corpus.require_inside(good).count() == 1


def test_status_of_odd_rows(spark):
    a, b = digest("a"), digest("b")
    rows = [
        ("1", "p", "same", "u", a), ("2", "p", "upper", "u", a.upper()), ("3", "p", "twice", "u", a), ("4", "p", "twice", "u", b), ("5", "p", "again", "u", a), ("6", "p", "again", "u", a),
        ("7", "p", "nodigest", "u", None), ("8", "p", "../out", "u", a), ("9", "p", "lost", "u", a), ("10", "p", "stale", "u", b), ("11", "p", "bad", "u", b),
    ]
    manifest = spark.createDataFrame(rows, MANIFEST)
    store = spark.createDataFrame([("same", a), ("upper", a), ("stale", a), ("bad", a), ("extra", b)], "path string, sha256 string")
    landed = spark.createDataFrame([("upper", a), ("twice", a), ("again", a), ("nodigest", a), ("../out", a), ("stale", b), ("bad", a)], "path string, sha256 string")
    classified = corpus.classify(manifest, store, landed)
    got = {r["id"]: r["status"] for r in classified.collect()}
    assert got == {"1": "current", "2": "mismatch", "3": "path_conflict", "4": "path_conflict", "5": "new", "6": "new", "7": "mismatch", "8": "rejected_path", "9": "not_landed", "10": "replaced", "11": "mismatch"}
    new = {r["path"]: r["sha256"] for r in corpus.verified_replace(classified, store).collect()}
    assert new == {"same": a, "upper": a, "stale": b, "bad": a, "extra": b, "again": a}
    letters = {r["id"]: r["error"] for r in corpus.dead_letter(classified).collect()}
    assert set(letters) == {"2", "3", "4", "7", "8", "9", "11"} and letters["9"] == "not_landed: lost"
    with pytest.raises(RuntimeError, match="7 documents failed"):
        corpus.fail_on_errors(corpus.run_outcome(classified))
    assert {r["id"] for r in corpus.pending(manifest, store).collect()} == set(got) - {"1"}


def test_an_empty_manifest_has_no_failures(spark):
    none = spark.createDataFrame([], MANIFEST)
    pairs = spark.createDataFrame([("x", digest("x"))], "path string, sha256 string")
    classified = corpus.classify(none, pairs, pairs)
    assert corpus.dead_letter(classified).count() == 0 and corpus.fail_on_errors(corpus.run_outcome(classified)) is None
    assert corpus.verified_replace(classified, pairs).count() == 1


def test_manifest_rows_must_be_whole(spark, tmp_path):
    whole = {"id": "1", "origin": "public_original", "path": "a", "other": 3}
    (tmp_path / "good.json").write_text(json.dumps([whole]))
    (tmp_path / "bad.json").write_text(json.dumps([whole, {"id": "2", "path": "b"}]))
    rows = src.manifest_scan(spark, str(tmp_path / "good.json")).collect()
    assert [(r["id"], r["url"], r["sha256"]) for r in rows] == [("1", None, None)]
    with pytest.raises(Exception, match="lacks id, origin or path"):
        src.manifest_scan(spark, str(tmp_path / "bad.json")).collect()


def test_files_are_fingerprinted_whole_and_empty_ones_are_absent(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(bytes(range(256)) * 5000)
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = corpus.fingerprint(src.file_scan(spark, str(tmp_path)), "content").select("length", "sha256").collect()
    assert {r["length"]: r["sha256"] for r in rows} == {1280000: hashlib.sha256(bytes(range(256)) * 5000).hexdigest()}  # the empty file is not listed


def test_completeness_of_groups(spark):
    required = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "group string, path string")
    present = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("c", "9")], "group string, path string")
    got = {r["group"]: (r["ready"], r["missing_paths"]) for r in corpus.completeness(required, present).collect()}
    assert got == {"a": (False, ["2"]), "b": (True, [])}


def test_values_periods_units_and_keys(spark):
    rows = [
        ("d", "revenue", "N/A", "元", "2024", 1), ("d", "revenue", "", "元", "2023", 1), ("d", "revenue", "1.50", "元", "2024-Q5", 1), ("d", "revenue", "2", "元", "24", 1), ("d", "revenue", None, "元", None, 1),
        ("d", "eps_basic", "1.5", "元/股", "2024", 1), ("d", "eps_basic", "1.50", "元/股", "2024", 2), ("d", "margin", "3", "%", "2024-Q4", 1), ("d", "margin", "4", "元", "2024-Q4", 1), ("d", "odd", "4", "kg", "2024", 1),
    ]
    frame = spark.createDataFrame(rows, FACTS)
    assert [r["ok"] for r in facts.parse_value(frame).collect()] == [False, False, True, True, False, True, True, True, True, True]
    assert [r["period_index"] for r in facts.parse_period(frame).collect()] == [2024, 2023, None, None, None, 2024, 2024, 8100, 8100, 2024]
    assert {r["name"]: r["units"] for r in facts.unit_consistency(frame).collect()} == {"margin": "%,元", "odd": "kg"}
    kinds = {r["name"]: (r["n"], r["kind"]) for r in facts.fact_conflicts(facts.parsed(frame)).collect()}
    assert kinds == {"eps_basic": (2, "duplicate"), "margin": (2, "conflict")}


def test_growth_at_gaps_and_odd_bases(spark):
    rows = [("d", n, str(v), "元", str(y), 1) for n, y, v in [("a", 2020, 5), ("a", 2022, 6), ("a", 2023, 9), ("z", 2020, 0), ("z", 2021, 4), ("m", 2020, -2), ("m", 2021, 4)]]
    got = {(r["name"], r["period"]): (r["growth"], r["flag"]) for r in analysis.growth(facts.parsed(spark.createDataFrame(rows, FACTS))).collect()}
    assert got == {("a", "2020"): (None, "first"), ("a", "2022"): (None, "gap"), ("a", "2023"): (0.5, None), ("z", "2020"): (None, "first"), ("z", "2021"): (None, "zero_base"), ("m", "2020"): (None, "first"), ("m", "2021"): (None, "negative_base")}


def test_ratios_over_nothing_are_null(spark):
    rows = [("d", n, v, "元", y, 1) for n, v, y in [("revenue", "0", "2020"), ("net_profit_parent", "5", "2020"), ("equity_parent", "3", "2020"), ("equity_parent", "-3", "2021"), ("net_profit_parent", "5", "2021")]]
    got = {r["period"]: r for r in analysis.ratios(facts.parsed(spark.createDataFrame(rows, FACTS))).collect()}
    assert got["2020"]["net_margin"] is None and got["2020"]["equity_ratio"] is None and got["2021"]["mean_equity_return"] is None


def test_values_without_a_finite_end_are_flagged(spark):
    base = spark.createDataFrame([("d", 100.0)], "document string, value double")
    flows = analysis.project(base, [("s", 0.1)], 2)
    assert [round(r["projected"], 6) for r in flows.orderBy("t").collect()] == [110, 121]
    for r, g in ((0.05, 0.05), (0.03, 0.05)):
        row = analysis.present_value(flows, r, g).first()
        assert (row["present_value"], row["flag"]) == (None, "r_le_g")
    row = analysis.present_value(flows, 0.1, 0.0).first()
    assert row["present_value"] == round(100 + 100 + 121 / 0.1 / 1.21, 2) and row["flag"] is None


def test_intervals_of_small_samples(spark):
    rows = [("one", "a", True), ("ten", "a", True)] + [("ten", "a", False)] * 9
    got = {r["kind"]: r for r in facts.scorecard(spark.createDataFrame(rows, "kind string, split string, passed boolean")).collect()}
    assert got["one"]["rate"] == 1 and got["one"]["hi"] == 1 and got["one"]["lo"] == pytest.approx(1 / (1 + 1.96**2), abs=1e-6)
    centre, half = (0.1 + 1.96**2 / 20) / (1 + 1.96**2 / 10), 1.96 * math.sqrt(0.09 / 10 + 1.96**2 / 400) / (1 + 1.96**2 / 10)
    assert (got["ten"]["lo"], got["ten"]["hi"]) == (pytest.approx(centre - half, abs=1e-6), pytest.approx(centre + half, abs=1e-6))
    assert facts.scorecard(spark.createDataFrame([], "kind string, split string, passed boolean")).count() == 0


def test_whole_sources_are_held_out(spark):
    rows = spark.createDataFrame([(str(i), f"s{i % 40}", digest(str(i // 2))) for i in range(400)], "id string, source string, sha256 string")
    split = corpus.holdout_split(rows, 30)
    assert split.groupBy("source").agg({"split": "count"}).count() == split.select("source", "split").distinct().count() == 40
    held = {r["id"]: r for r in split.where("split = 'holdout'").collect()}
    tuned = {r["sha256"] for r in split.where("split = 'tuning'").collect()}
    leaks = corpus.holdout_leaks(split).collect()
    assert {r["id"] for r in leaks} == {i for i, r in held.items() if r["sha256"] in tuned} and not any(r["same_source"] for r in leaks)


def test_landings_are_judged_as_they_come(spark, tmp_path):
    a, b = digest("a"), digest("b")
    manifest = spark.createDataFrame([("1", "public_original", "x", "u", a), ("2", "public_original", "y", "u", b)], MANIFEST)
    folder = str(tmp_path / "landed")
    spark.createDataFrame([("x", a), ("y", a)], landings.LANDED).coalesce(1).write.parquet(folder)
    rows = landings.verified_landings(landings.landed_stream(spark, folder), manifest)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def step():
        rows.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r["path"], r["status"]) for r in spark.read.parquet(out).collect())

    assert step() == [("x", "verified"), ("y", "mismatch")]
    spark.createDataFrame([("y", b), ("z", b)], landings.LANDED).coalesce(1).write.mode("append").parquet(folder)
    assert step() == [("x", "verified"), ("y", "mismatch"), ("y", "verified"), ("z", "unexpected")]


def test_a_broken_manifest_fails_whatever_is_read_of_it(spark, tmp_path):
    (tmp_path / "bad.json").write_text(json.dumps([{"id": "1", "origin": None, "path": "a", "sha256": "x"}]))
    for ask in (lambda df: df.select("path", "sha256").collect(), lambda df: df.count(), lambda df: df.select("url").collect()):
        with pytest.raises(Exception, match="lacks id, origin or path"):
            ask(src.manifest_scan(spark, str(tmp_path / "bad.json")))


def test_freshness_of_paths_stored_several_times(spark):
    manifest = spark.createDataFrame([("1", "p", "a", "u", digest("a")), ("2", "p", "b", "u", digest("b")), ("3", "p", "c", "u", None)], MANIFEST)
    store = spark.createDataFrame([("a", "x"), ("a", digest("a")), ("a", "y"), ("b", "x"), ("b", "y"), ("c", None)], "path string, sha256 string")
    assert sorted((r["id"], r["state"]) for r in corpus.freshness(manifest, store).collect()) == [("1", "current"), ("2", "stale"), ("3", "stale")]


def test_facts_without_a_name_or_period_are_verified_too(spark):
    answers = spark.createDataFrame([("d", None, "2020", 1, "元"), ("d", "x", None, 2, "元"), ("d", "x", None, 2, "元"), (None, None, None, 3, None), ("d", "gone", "2020", 4, "元")], "document string, name string, period string, amount int, unit string")
    extracted = spark.createDataFrame([("d", None, "2020", 1, "元"), ("d", "x", None, 5, "元"), ("d", "x", None, 2, "元"), (None, None, None, 3, None), ("d", "more", None, 4, "元")], "document string, name string, period string, amount int, unit string")
    typed = lambda df: df.selectExpr("document", "name", "period", "cast(amount as decimal(24,4)) as amount", "unit")
    got = sorted((r["document"] or "", r["name"] or "", r["status"]) for r in facts.verify_facts(typed(extracted), typed(answers)).collect())
    assert got == [("", "", "match"), ("d", "", "match"), ("d", "gone", "missing"), ("d", "more", "unexpected"), ("d", "x", "match"), ("d", "x", "mismatch")]


def test_grids_flag_cells_without_a_value_and_keep_every_entity(spark):
    base = spark.createDataFrame([("d", 100.0), ("n", None)], "document string, value double")
    got = {r["document"]: r for r in analysis.sensitivity_grid(base, [(0.0, 0.1, 0.0), (0.0, 0.02, 0.02), (0.0, 0.01, 0.02)], 1).collect()}
    assert (got["d"]["least"], got["d"]["cells"], got["d"]["r_le_g"]) == (1000.0, 1, 2) and (got["n"]["least"], got["n"]["cells"], got["n"]["r_le_g"]) == (None, 0, 2)
    none = {r["document"]: r for r in analysis.sensitivity_grid(base, [(0.0, 0.01, 0.02)], 1).collect()}
    assert set(none) == {"d", "n"} and none["d"]["median"] is None and none["d"]["r_le_g"] == 1


def test_empty_tables_give_empty_results(spark):
    none = facts.parsed(spark.createDataFrame([], FACTS))
    base = spark.createDataFrame([], "document string, value double")
    manifest = spark.createDataFrame([], MANIFEST + ", source string")
    pairs = spark.createDataFrame([], "path string, sha256 string")
    flows = analysis.project(base, [("s", 0.1)], 2)
    values = analysis.present_value(flows, 0.1, 0.0)
    empty = [
        corpus.freshness(manifest, pairs), corpus.pending(manifest, pairs), corpus.holdout_leaks(corpus.holdout_split(manifest)), corpus.completeness(pairs.toDF("group", "path"), pairs.toDF("group", "path")),
        facts.fact_conflicts(none), facts.pivot_facts(none, ["revenue"]), facts.quarter_rollup(none), facts.verify_facts(none, none), *facts.trace_source(none, manifest), facts.unit_consistency(none),
        analysis.growth(none), analysis.ratios(none), flows, values, analysis.sensitivity_grid(base, [(0.0, 0.1, 0.0)], 1), analysis.multiple_value(none, [("m", 2)]),
        analysis.entity_report(none, facts.quarter_rollup(none), analysis.ratios(none), values),
    ]
    assert not any(df.count() for df in [*empty, corpus.source_groups(manifest)])
