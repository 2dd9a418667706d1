"""Cases on small frames: thresholds from both sides, negative cases, order and partition independence."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataloom.functions import normalize as nz
from dataloom.functions.values import col, full_match, try_date, try_number, value_freq
from dataloom.operators import audit, completeness, duplicates, formats, invariants, profile, repair, rules, schema, score
from dataloom.operators import plan as plan_of_fixes
from dataloom.operators.repair import Fix, Operation
from dataloom.sources.snapshots import snapshot


def frame(spark, rows, columns):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, " + columns)


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(("text", "number"), [("12", 12.0), (" -1.5e2 ", -150.0), ("12d", None), ("NaN", None), ("1_000", None), ("", None), (".5", 0.5), ("1.", 1.0), (None, None)])
def test_numbers(spark, text, number):
    assert one(spark, try_number, text) == number


@pytest.mark.parametrize(("text", "plain"), [("€ 1.234,5", "1234.5"), ("6,0", "6.0"), ("2 unità", "2"), ("1,234.50", "1234.50"), ("12 EUR", "12"), ("N.D.", "N.D."), ("€", "€"), ("-1.234", "-1234"), ("1.23", "1.23")])
def test_notation(spark, text, plain):
    assert one(spark, nz.normalize_number, text) == plain


@pytest.mark.parametrize(("text", "period"), [("2024-06", "202406"), ("4/2024", "202404"), ("GIU-2024", "202406"), ("Jan 2024", "202401"), ("13/2024", "13/2024"), ("Rata 2024", "Rata 2024"), (" 202405 ", "202405"), ("202413", "202413")])
def test_periods(spark, text, period):
    assert one(spark, nz.normalize_period, text) == period


@pytest.mark.parametrize(("text", "day"), [("2024-01-31", "2024-01-31"), ("31.01.2024", "2024-01-31"), ("GIU 11 2024", "2024-06-11"), ("11-05-75", "1975-05-11"), ("11-05-24", "2024-05-11"), ("202311", "2023-11-01"), ("31/02/2024", None), ("x", None)])
def test_dates(spark, text, day):
    got = one(spark, nz.normalize_date, text)
    assert (got and got.date().isoformat()) == day


@pytest.mark.parametrize(("text", "moment"), [
    ("2 gennaio 2024", "2024-01-02T00:00:00"), ("2-set-2024", "2024-09-02T00:00:00"), ("Jan 2, 2024", "2024-01-02T00:00:00"), ("3 March 2024 10:30", "2024-03-03T10:30:00"), ("2 foo 2024", None),
    ("2024-01-05T10:11:12.123456789Z", "2024-01-05T10:11:12.123456"), ("2024-01-05 25:00", None), ("05/01/2024 10:11:12", "2024-01-05T10:11:12"), ("12-25-2024", "2024-12-25T00:00:00"), ("12.25.2024", None),
    ("1 2 2024", "2024-01-02T00:00:00"), ("13 2 2024", "2024-02-13T00:00:00"), ("1 2 24", None), ("1-2/2024", None), (" 2024-01-05", None), ("20240105", "2024-01-05T00:00:00"), ("2024", None)])
def test_date_layouts(spark, text, moment):
    got = one(spark, nz.normalize_date, text)
    assert (got and got.isoformat()) == moment


@pytest.mark.parametrize(("text", "plain"), [("1.234.567,89", "1234567.89"), ("1,234,567", "1234567"), ("1.23.456", "1.23.456"), ("1234,567", "1234.567"), ("2 unità di", "2 unità di"), ("1-2 kg", "1-2 kg"), ("3 kg.", "3"), (" eur ", " eur "), ("1,2,3", "1,2,3"), ("$ -1,234.5 usd", "-1234.5")])
def test_notation_of_groups(spark, text, plain):
    assert one(spark, nz.normalize_number, text) == plain


def test_notations_compile(spark):
    """Neither expression outgrows what the JVM compiles: both run inside generated code."""
    rows = spark.range(10).select(F.col("id").cast("string").alias("v")).select(nz.normalize_number(F.col("v")).alias("n"), nz.normalize_date(F.col("v")).alias("d"))
    code = rows._jdf.queryExecution().debug().codegenToSeq()
    assert code.size() > 0 and all(0 < code.apply(i)._3().maxMethodCodeSize() < 65_000 for i in range(code.size()))


def test_full_match_is_whole(spark):
    assert one(spark, lambda c: full_match(c, "[a-z]+"), "abc\n") is False
    assert one(spark, lambda c: try_date(c, "%Y-%m-%d"), "2024-01-01x") is None


@pytest.mark.parametrize(("distinct", "kind"), [(30, "enum"), (31, None)])
def test_enum_limit(spark, distinct, kind):
    df = frame(spark, [("v" * (k % 7 + 1) + "-" * (k // 7) + "x",) for k in range(distinct) for _ in range(4)], "c string")
    assert profile.format_specs(value_freq(df, "row_id")).first()["kind"] == kind


def test_specs_need_five_values(spark):
    assert profile.format_specs(value_freq(frame(spark, [("a",)] * 4, "c string"), "row_id")).count() == 0
    got = profile.format_specs(value_freq(frame(spark, [(f"AB-{k:03d}.x",) for k in range(40)], "c string"), "row_id")).first()
    assert (got["kind"], got["spec"]) == ("regex", r"^[A-Z]{2}\-\d{3}\.[a-z]{1}$")


def test_guard_refuses_above_its_share(spark):
    df = frame(spark, [("-",)] * 3 + [("a",)] * 7, "c string")
    assert completeness.unmask_guard(df, {"c": ["-"]}).first()["accepted"]
    assert not completeness.unmask_guard(df.where("row_id < 9"), {"c": ["-"]}).first()["accepted"]


def test_empty_frames(spark):
    df = frame(spark, [], "a string, b double")
    assert completeness.overall(df, "row_id").first()["completeness"] is None
    assert duplicates.exact_duplicates(df, "row_id").first()["duplicates"] == 0
    assert formats.validate(df, "row_id", {"a": formats.Spec("regex", pattern="x")}).count() == 0
    assert profile.column_profile(value_freq(df, "row_id")).count() == 0


def test_identity_of_a_ledger(spark):
    rows = [(1000 + 7 * k, 13 * k % 400, 1000 + 7 * k - 13 * k % 400 + (5 if k < 6 else 0), f"c{k % 3}") for k in range(200)]
    got = [tuple(r) for r in rules.identities(frame(spark, rows, "entrate long, uscite long, saldo long, comparto string"), ["entrate", "uscite", "saldo"]).collect()]
    assert got == [("saldo", "entrate", "-", "uscite", 0.97)]


def test_sums_and_constants(spark):
    rows = [(100 + 3 * k, 7 * k % 50, 100 + 3 * k + 7 * k % 50, 0) for k in range(200)]
    got = [tuple(r) for r in rules.identities(frame(spark, rows, "imponibile long, contributo long, totale long, zero long"), ["imponibile", "contributo", "totale", "zero"]).collect()]
    assert got == [("totale", "contributo", "+", "imponibile", 1.0)]


def test_dependency_needs_groups_and_exceptions(spark):
    rows = [(f"p{k % 4}", f"r{k % 4 // 2}") for k in range(40)]
    assert rules.dependencies(rules.pair_counts(frame(spark, rows, "p string, r string"), [("p", "r")])).count() == 0  # it always holds
    rows[0] = ("p0", "r9")
    df = frame(spark, rows, "p string, r string")
    got = rules.dependency_violations(df, "row_id", [("p", "r")]).collect()
    assert [(r["row_id"], r["value"], r["expected_pattern"]) for r in got] == [(0, "r9", "cross-column: p='p0' implies r='r0'")]


def test_stability_over_time(spark):
    rows = [("k", "old", 1)] * 3 + [("k", "new", 2)] * 3 + [("j", "x", 1)] * 3 + [("j", "x", 2)] * 3
    df = frame(spark, rows, "p string, t string, c int")
    assert rules.temporal_stability(df, "p", "t", col("c")).first()["stable"] is False
    assert rules.temporal_stability(df.where("p = 'j'"), "p", "t", col("c")).first()["stable"] is True
    assert rules.temporal_stability(df, "p", "t", None).first()["stable"] is True


def test_key_collisions(spark):
    rows = [(f"i{k}", "a", None) for k in range(36)] + [("i0", "a", None), ("i1", "b", None), ("i1", "c", None)]
    got = duplicates.key_collisions(frame(spark, rows, "id string, stato string, note string"), "row_id", "id").first()
    assert tuple(got) == (2, 5, 1, 3)


def test_drop_duplicates_keeps_the_first_row(spark):
    df = frame(spark, [("a", None), ("a", None), ("b", "x"), ("a", None)], "c string, n string")
    for parts in (1, 4):
        assert sorted(r["row_id"] for r in duplicates.drop_duplicate_rows(df.repartition(parts), "row_id").collect()) == [0, 2]


def test_casing_prefers_the_declared_spelling(spark):
    df = frame(spark, [("Rome",), ("rome ",), ("ROME",), ("ROME",), ("Milan",)], "c string")
    free = {r["value"]: r["to"] for r in repair.casing_map(value_freq(df, "row_id")).collect()}
    assert free == {"Rome": "ROME", "rome ": "ROME"}
    told = {r["value"]: r["to"] for r in repair.casing_map(value_freq(df, "row_id"), {"c": ["Rome"]}).collect()}
    assert told == {"ROME": "Rome", "rome ": "Rome"}


def test_casts_are_lossless_or_refused(spark):
    df = frame(spark, [("1", "2024-04", "x"), ("2", "202404", "3")], "a string, m string, b string")
    out = dict(repair.safe_cast(repair.safe_cast(repair.safe_cast(df, "a", "integer"), "m", "datetime"), "b", "integer").dtypes)
    assert (out["a"], out["m"], out["b"]) == ("bigint", "string", "string")
    assert [r["value"] for r in repair.blocking_rows(df, "row_id", "b", "integer").collect()] == ["x"]


@pytest.mark.parametrize(("empty", "failures"), [(5, 0), (6, 1)])
def test_filling_a_sparse_column(spark, empty, failures):
    before = frame(spark, [(None,)] * empty + [("a",)] * (10 - empty), "c string")
    after = before.withColumn("c", F.coalesce("c", F.lit("a")))
    assert invariants.check(before, after, "row_id", ["c"], hinted={"c"}).count() == failures
    assert invariants.check(before, after, "row_id", ["c"]).count() == 1


def test_plan_execution(spark):
    df = frame(spark, [("1,5", "A"), ("2,5", "a"), ("3", "A")], "x string, y string")
    plan = [Fix("n", (Operation("normalize_numeric", "x"),)), Fix("gone", (Operation("replace_values", "y", {"mapping": {"A": None}}),)), Fix("late", (Operation("drop_column", "y"),), ("gone",)), Fix("absent", (Operation("strip_whitespace", "zz"),))]
    out, status, changes = plan_of_fixes.execute(df, "row_id", plan)
    assert {r["fix"]: r["status"] for r in status.collect()} == {"n": "executed", "gone": "rejected", "late": "skipped", "absent": "executed"}
    assert sorted(r["x"] for r in out.collect()) == ["1.5", "2.5", "3"] and changes.count() == 2
    with pytest.raises(ValueError, match="unknown operation"):
        Operation("guess", "x")


def test_remediation_finds_what_it_rests_on(spark):
    from dataloom.operators import remediation
    rows = []
    for i in range(60):
        m = i % 6 + 1
        rata = (f"2024-{m:02d}", f"{m:02d}/2024", f"2024{m:02d}", "Rata 2024")[i % 4]
        rows.append((rata, "x" if i == 5 else str(m % 6 + 1) if i == 8 else str(m), "7.2500000001" if i == 7 else f"{i}.25", f"c{m}", None if i == 10 else f"n{m}", "odd" if i % 30 else "even"))
    df = frame(spark, rows, "rata string, mese string, x string, code string, name string, other string")
    specs = {"rata": formats.Spec("date", pattern="%m/%Y"), "x": formats.Spec("range", low=0.25, high=59.2500000001)}
    got = remediation.remediate(df, "row_id", specs, [("code", "name"), ("name", "other")])
    steps = [(r["column"], r["operation"], r["cells_changed"]) for r in got.steps.orderBy("step").collect()]
    assert steps == [("rata", "normalize_period", 30), ("mese", "derive_month_from_period", 1), ("x", "round_decimals", 1), ("rata", "complete_period_from_dependency", 15), ("name", "impute_from_lookup", 1)]
    out = {r["row_id"]: r for r in got.data.collect()}
    assert all(r["rata"] == f"2024{i % 6 + 1:02d}" for i, r in out.items()) and out[5]["mese"] == "6" and out[7]["x"] == "7.25" and out[10]["name"] == "n5" and got.data.columns == df.columns
    assert [(r["column_name"], r["row_id"]) for r in got.contested.collect()] == [("mese", 8)]
    assert got.specs["rata"].pattern == "%Y%m" and got.specs["x"].high == 59.25 and got.touched == ["rata", "mese", "x", "name"]
    before = formats.validate(df, "row_id", specs).unionByName(completeness.missing_violations(df, "row_id"))
    assert [(r["column_name"], r["kind"]) for r in got.refreshed("row_id", before).collect()] == [("mese", "consistency")]
    proposed = spark.createDataFrame([("rata", "Rata 2024", None), ("rata", "202401", "x"), ("other", "gone", "x")], "column string, value string, to string")
    assert sorted(r["value"] for r in got.unsettled("row_id", proposed).collect()) == ["202401", "gone"]


def test_functions_without_findings_run_on_the_column(spark):
    df = frame(spark, [("1",), ("x",), (None,)], "c string")
    none = formats.validate(df.limit(0), "row_id", {"c": formats.Spec("enum", values=("1",))})
    vet = lambda d, v, f: [(r["value"], r["issue"]) for r in repair.vet_function(value_freq(d, "row_id", ["c"]), v, "c", f, "integer").collect()]
    assert vet(df, none, lambda v: v) == [] and vet(df, none, int)[0][0] == "x" and len(vet(df, none, int)) == 1
    assert "no value" in vet(df.where("c is null"), none, lambda v: v)[0][1]
    found = formats.validate(df, "row_id", {"c": formats.Spec("enum", values=("1",))})
    assert vet(df, found, lambda v: v) == [("x", "leaves a violating value")]


def test_names_of_any_script(spark):
    names = ["数量", "価格", "Łódź", "Città (IT)", "Ørsted", "%%", "Straße", "Ñandú", None, "Дата"]
    got = {r["v"]: r["b"] for r in spark.createDataFrame([(n,) for n in names], "v string").select("v", schema.bare_name(F.col("v")).alias("b")).collect()}
    assert got == {"数量": "数量", "価格": "価格", "Łódź": "lodz", "Città (IT)": "citta_it", "Ørsted": "orsted", "%%": "", "Straße": "strasse", "Ñandú": "nandu", None: None, "Дата": "дата"}
    cat = spark.createDataFrame([(1, "数量", None), (2, "lodz", None), (3, "??", None), (4, "citta it", "comune")], "canonical_id long, name string, alias string")
    found = schema.canonical_match(spark.createDataFrame([(n,) for n in ("価格", "Łódź", "%%", "Città-IT", "comune", "数量")], "column string"), cat).collect()
    assert {r["column"]: (r["canonical_id"], r["how"]) for r in found} == {"Łódź": (2, "bare"), "Città-IT": (4, "bare"), "comune": (4, "alias"), "数量": (1, "exact")}


def test_statistics_of_batches_add_up(spark):
    from dataloom.operators.pair_statistics import PairStatistics
    df = frame(spark, [(f"2024-0{1 + i % 6}-1{i % 9} 10:00:00", None if i % 5 == 0 else f"q{(i % 6) // 3}", "x|y" if i % 2 else None) for i in range(120)], "at string, q string, z string")
    pairs = [("at", "q"), ("z", "q"), ("at|z", "q")]
    whole = PairStatistics(spark, pairs, {"at"}).add(df)
    parts = PairStatistics(spark, pairs, {"at"})
    for k in (0, 1, 2, 1):  # the second batch twice, under its name
        parts.add(df.where(F.col("row_id") % 3 == k), str(k))
    for read in (lambda s: s.table(), lambda s: s.table(True), lambda s: s.hints()[0], lambda s: s.hints()[1], lambda s: s.coherence(), lambda s: s.chosen()):
        assert sorted(map(tuple, read(parts).collect()), key=str) == sorted(map(tuple, read(whole).collect()), key=str)
    assert PairStatistics(spark, pairs, {"at"}, whole.path).table().count() == whole.table().count()
    best = whole.chosen().first()
    assert (best["predictor"], best["purity"], best["coverage"]) == ("at", 1.0, 1.0)
    filled = repair.impute(df, "q", "at", whole.hints()[1].where("predictor = 'at'"), temporal={"at"})
    assert {(r["at"][5:7] >= "04", r["q"]) for r in filled.collect()} == {(False, "q0"), (True, "q1")}


def test_levels_follow_conflicts(spark):
    plan = [Fix("a", (Operation("strip_whitespace", "x"),)), Fix("b", (Operation("normalize_numeric", "y"),)), Fix("c", (Operation("rename_column", "x", {"to": "z"}),)), Fix("d", (Operation("strip_whitespace", "z"),)),
            Fix("e", (Operation("collapse_casing", "w"),)), Fix("f", (Operation("strip_whitespace", "v"),), ("b",)), Fix("g", (Operation("drop_duplicate_rows"),)), Fix("h", (Operation("drop_column", "v"),))]
    got = {s.fix.id: s.level for s in plan_of_fixes.levels(plan)}
    assert got["a"] == got["b"] == 0 and got["c"] > got["a"] and got["d"] > got["c"] and got["f"] > got["b"] and got["g"] > max(v for k, v in got.items() if k not in "gh") and got["h"] > got["g"]
    assert list(got.values()).count(got["e"]) == list(got.values()).count(got["g"]) == 1


def one_by_one(df, fixes):
    """The plan's meaning: every fix by itself on what the earlier ones left."""
    status = {}
    for fix in fixes:
        after = repair.apply_fix(df, "row_id", fix)
        broken = invariants.check(df, after, "row_id", fix.columns(), any(o.kind == "drop_duplicate_rows" for o in fix.operations)).collect()
        status[fix.id] = "; ".join(sorted(r["failure"] for r in broken))
        df = df if broken else after
    return sorted(map(tuple, df.collect()), key=str), df.dtypes, status


@pytest.mark.parametrize("seed", range(6))
def test_levels_give_what_one_after_the_other_gives(spark, seed):
    r = random.Random(seed)
    words = [None, "a", "A ", " 1,5", "2", "2024-01", "01/2024", "€ 3", "-"]
    df = frame(spark, [tuple(r.choice(words) for _ in range(4)) for _ in range(30)], "p string, q string, s string, t string")
    def operation(c):
        return r.choice([Operation("strip_whitespace", c), Operation("normalize_numeric", c), Operation("normalize_period", c), Operation("replace_values", c, {"mapping": {"a": "b", r.choice(["-", "2"]): None}}), Operation("apply_function", c, {"function": str.upper}),
                         Operation("cast_dtype", c, {"dtype": r.choice(["float", "integer", "datetime"])}), Operation("rename_column", c, {"to": r.choice("pqstz")}), Operation("drop_column", c), Operation("collapse_casing", c), Operation("drop_duplicate_rows", args={"subset": ["s"]} if r.random() < 0.5 else {})])
    fixes = [Fix(f"f{i}", tuple(operation(r.choice("pqst")) for _ in range(r.choice([1, 1, 2])))) for i in range(7)]
    fixes = [f for i, f in enumerate(fixes) if f.fingerprint() not in {g.fingerprint() for g in fixes[:i]} and not any(o.args.get("subset") for o in f.operations)]
    out, status, log = plan_of_fixes.execute(df, "row_id", fixes)
    rows, types, reasons = one_by_one(df, fixes)
    assert {x["fix"]: x["reason"] for x in status.collect()} == reasons
    assert out.dtypes == types and sorted(map(tuple, out.collect()), key=str) == rows
    assert {x["source"] for x in log.collect()} <= {k for k, v in reasons.items() if not v}


def test_a_plan_of_row_fixes_is_one_aggregate(spark):
    df = frame(spark, [("1,5", " a", "x"), ("2", "b", "y")], "p string, q string, s string")
    fixes = [Fix("1", (Operation("normalize_numeric", "p"),)), Fix("2", (Operation("strip_whitespace", "q"),)), Fix("3", (Operation("replace_values", "s", {"mapping": {"x": None, "y": None}}),))]
    calls = []
    out, status, log = plan_of_fixes.execute(df, "row_id", fixes, cut=lambda d: calls.append(1) or d)
    assert len(calls) == 1 and [r["status"] for r in status.collect()] == ["executed", "executed", "rejected"]
    assert sorted(map(tuple, out.collect())) == [(0, "1.5", "a", "x"), (1, "2", "b", "y")]
    assert "Join" not in log._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 256])
def test_spellings_of_all_columns_at_once(spark, monkeypatch, most):
    monkeypatch.setattr(repair, "MAPPED_ROWS", most)
    df = frame(spark, [("Rome", "x"), ("rome", "X"), ("Rome", None), (None, "x"), ("Oslo ", "x")], "p string, q string")
    got = repair.collapse_casing(df, repair.casing_map(value_freq(df, "row_id")), ["p", "q"])
    assert sorted(map(tuple, got.collect())) == [(0, "Rome", "x"), (1, "Rome", "x"), (2, "Rome", None), (3, None, "x"), (4, "Oslo ", "x")]
    assert got.columns == df.columns


def test_functions_are_called_once_a_value(spark):
    df = frame(spark, [("a",), (None,), ("a",), ("b",)], "p string")
    assert [r["p"] for r in repair.apply_function(df.coalesce(1), "p", lambda v: None if v == "b" else v * 2).orderBy("row_id").collect()] == ["aa", None, "aa", None]


def test_snapshots_meet_without_a_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("string").alias("x"))
    a = snapshot(df, "row_id", 8)
    b = snapshot(a.withColumn("x", F.when(F.col("row_id") == 5, "new").otherwise(F.col("x"))), "row_id", 8)
    for after in (b, a.withColumn("x", F.concat("x", F.lit("!")))):
        diff = audit.cell_diff(a, after, "row_id", "s")
        assert "Exchange" not in diff._jdf.queryExecution().executedPlan().toString()
    assert [(r["row_id"], r["before"], r["after"]) for r in audit.cell_diff(a, b, "row_id", "s").collect()] == [(5, "5", "new")]


def test_function_checks(spark):
    samples = spark.createDataFrame([("1", True), ("x", False), ("", False)], "value string, conforming boolean")
    issues = {r["value"]: r["issue"] for r in repair.check_function(samples, lambda v: str(int(v) if v else 1 / 0), "integer").collect()}
    assert set(issues) == {"x", ""} and "ValueError" in issues["x"] and "ZeroDivisionError" in issues[""]


def test_diff_has_cells_and_rows(spark):
    a = frame(spark, [("a", None), ("b", "x"), ("c", "y")], "p string, q string")
    b = a.where("row_id < 2").withColumn("q", F.when(F.col("row_id") == 0, "new").otherwise(F.col("q")))
    got = {(r["scope"], r["row_id"], r["column"], r["before"], r["after"]) for r in audit.cell_diff(a, b, "row_id", "s").collect()}
    assert got == {("cell", 0, "q", None, "new"), ("row", 2, "", "present", None)}


def test_reliability_is_a_clamped_geometric_mean(spark):
    m = spark.createDataFrame([("a", 0.5), ("b", 0.8), ("c", None)], "dimension string, value double")
    assert score.reliability(m).first()["score"] == 0.6325
    assert score.reliability(m.withColumn("value", F.col("value") - 0.5)).first()["score"] == 0.0
    assert score.reliability(m.where("value is null")).first()["score"] is None


def test_names(spark):
    names = spark.createDataFrame([("TipoImposta", 0), ("tipo_imposta", 1), ("2cod", 2), ("a%b", 3), ("ok_IT", 4), ("%%", 5)], "column string, position int")
    got = {r["column"]: r["suggestion"] for r in schema.validate_names(names).collect()}
    assert got == {"TipoImposta": "tipo_imposta_2", "2cod": "col_2cod", "a%b": "a_b", "%%": "col"}


def test_results_do_not_depend_on_partitioning(spark):
    df = frame(spark, [(f"k{i % 5}", f"v{i % 5 if i else 9}") for i in range(200)], "p string, t string")
    a, b = (sorted(map(tuple, rules.dependency_violations(df.repartition(n), "row_id", [("p", "t")]).collect())) for n in (1, 7))
    assert a == b and len(a) == 1


def test_fuzzy_match_is_that_of_all_pairs(spark):
    import random

    r = random.Random(5)
    known = ["spesa_totale", *{"".join(r.choice("ab_c") for _ in range(r.randrange(1, 45))).strip("_") or "a" for _ in range(150)}]

    def altered(x):
        for _ in range(r.randrange(0, 7)):
            i = r.randrange(len(x) + 1)
            x = x[:i] + r.choice(["", "a", "b", "x"]) + x[i + r.randrange(2):]
        return x

    names = {"tspesa_totale", "pesa_totale", "zpesa_totale", "spesa_totalee"} | {altered(x) for x in known for _ in range(2)}
    cat = spark.createDataFrame([(i, x, None) for i, x in enumerate(known)], "canonical_id long, name string, alias string")
    cols = spark.createDataFrame([(x,) for x in names], "column string")
    got = {x["column"]: x["canonical_id"] for x in schema.canonical_match(cols, cat).where("how = 'fuzzy'").collect()}
    n, c = cols.withColumn("bare", schema.bare_name(F.col("column"))), cat.withColumn("c_bare", schema.bare_name(F.col("name")))
    best: dict = {}
    for x in n.where("bare <> ''").crossJoin(c).withColumn("score", schema.likeness(F.col("bare"), F.col("c_bare"))).where("score >= 0.85").collect():
        best[x["column"]] = min(best.get(x["column"], (0, 0)), (-x["score"], x["canonical_id"]))
    exact = {x["column"] for x in n.join(c, (F.col("bare") == F.col("c_bare")) | (F.col("column") == F.col("name"))).collect()}
    assert got == {k: v[1] for k, v in best.items() if k not in exact}
    assert {got[x] for x in ("tspesa_totale", "pesa_totale", "zpesa_totale", "spesa_totalee")} == {0}


def test_top_k_in_blocks_is_that_of_a_broadcast(spark, monkeypatch):
    rows = [(i, [float(i % 7 + 1), float(i % 5), float(i % 3)], [str(i % 4)], str(i % 2)) for i in range(60)]
    e = spark.createDataFrame(rows, "id long, vector array<double>, samples array<string>, dtype string")
    want = sorted(map(tuple, schema.retrieve_top_k(e.where("id % 3 = 0"), e, 4).collect()))
    monkeypatch.setattr(schema, "QUERY_BLOCK", 7)
    found = schema.retrieve_top_k(e.where("id % 3 = 0"), e, 4)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 80
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_top_k_of_odd_rows_and_many_pairs(spark, monkeypatch):
    r, nan = random.Random(5), float("nan")
    vector = lambda: [r.uniform(-1, 1) for _ in range(3)]
    rows = [(i, vector(), [str(i % 4), "a" if i % 3 else None, "a"], str(i % 2)) for i in range(90)]
    rows += [(90 + i, rows[3][1], rows[3][2], rows[3][3]) for i in range(9)]  # copies
    rows += [(100, None, ["a"], "0"), (101, [0.0] * 3, ["a"], None), (102, [1.0], [], "1"), (103, [1.0, None, 2.0], None, "1"), (104, [nan, 1.0, 1.0], ["a"], "0"), (105, [1e200, 1e200, 0.0], None, "0"), (None, [1.0, 0.0, 0.0], ["a"], "1"), (3, [0.5, 0.5, 0.5], ["1"], "1")]
    frame = lambda x: spark.createDataFrame(x, "id long, vector array<double>, samples array<string>, dtype string")

    def score(q, e):
        (_, a, s, d), (_, b, t, f) = q, e
        if a is None or b is None or None in a or None in b or len(a) != len(b) or (s and t is None):
            return None
        dot = lambda x, y: functools.reduce(lambda total, p: total + p[0] * p[1], zip(x, y), 0.0)
        with np.errstate(all="ignore"):
            cosine = float(np.float64(dot(a, b)) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))))
        return cosine + 0.3 * (len(set(s) & set(t) - {None}) / len(s) if s else 0.0) + (0.1 if d is not None and d == f else 0.0)

    want = {}
    for q in {x[0] for x in rows if x[0] is not None and (x[0] % 3 == 0 or x[0] >= 100)}:
        found = [(score(x, y), y[0]) for x in rows if x[0] == q for y in rows if y[0] is not None and y[0] != q]
        found.sort(key=lambda p: (p[0] is None, p[0] is not None and p[0] == p[0], -(p[0] or 0) if p[0] == p[0] else 0, p[1]))
        want[q] = [y for _, y in found[:4]]
    monkeypatch.setattr(schema, "QUERY_BLOCK", 11)
    monkeypatch.setattr(schema, "LANE", 30)
    df = frame(rows)
    got = {}
    for x in schema.retrieve_top_k(df.where("id % 3 = 0 or id >= 100"), df, 4).orderBy("query", "rank").collect():
        got.setdefault(x["query"], []).append(x["entry"])
    assert got == want
    assert schema.retrieve_top_k(df.where("false"), df).count() == schema.retrieve_top_k(df, df.where("false")).count() == 0
    named = spark.createDataFrame([(f"c{i}", [float(i), 1.0], ["x"], "t") for i in range(5)], df.schema.simpleString()[7:-1].replace("id:bigint", "id string").replace(":", " "))
    assert [x["entry"] for x in schema.retrieve_top_k(named.where("id = 'c4'"), named, 2).orderBy("rank").collect()] == ["c3", "c2"]


def test_dates_in_mixed_notation(spark):
    for value, day in (("2024-01-02T03:04:05.123", "2024-01-02"), ("Jan 5, 2024", "2024-01-05"), ("2024-1-2T03:04", "2024-01-02"), ("5 January 2024", "2024-01-05"), ("3/4/2024 10:00", "2024-04-03"), ("12/25/2024", "2024-12-25"), ("31/31/2024", None), ("soon", None)):
        got = one(spark, nz.normalize_date, value)
        assert (None if got is None else str(got)[:10]) == day


@pytest.mark.parametrize(("value", "plain"), [("1.234", "1234"), ("1,234", "1234"), ("1,5", "1.5"), ("1234,567", "1234.567"), ("1.234,567", "1234.567"), ("1,234.5", "1234.5"), ("1.234.567,8", "1234567.8"), ("1,234,5", "1,234,5"), ("1.5", "1.5"), ("1.234,5,6", "1.234,5,6"),
                                              ("-1.234", "-1234"), ("€ 5,0", "5.0"), ("7 EURO", "7"), ("2,5 unità", "2.5"), ("12 m.", "12"), ("eur", "eur"), ("1..2", "1..2"), (".5", ".5"), ("", ""), ("a 1,5", "a 1,5"), ("3 due parole", "3 due parole")])
def test_numbers_in_human_notation(spark, value, plain):
    assert one(spark, nz.normalize_number, value) == plain


def test_taken_names_are_not_suggested(spark):
    names = spark.createDataFrame([("A b", 0), ("A-b", 1), ("a_b_2", 2), ("A  b", 3), ("9", 4)], "column string, position int")
    assert {r["column"]: r["suggestion"] for r in schema.validate_names(names).collect()} == {"A b": "a_b", "A-b": "a_b_3", "A  b": "a_b_4", "9": "col_9"}


def test_registry_errors(spark, tmp_path):
    from dataloom.sources import files
    base = '{"r": {"shared_column_definitions": {"_note": "x", "s": {"format": {"type": "enum", "values": ["a", "b"]}}}, "domains": {"d": {"datasets": {"t": {"columns": {"c": %s}}}}}}}'
    def read(column):
        (tmp_path / "r.json").write_text(base % column)
        return files.read_registry(spark, f"file://{tmp_path}/r.json", "r").collect()
    r = read('{"$ref": "#/shared_column_definitions/s"}')[0]
    assert (r["dtype"], r["format_type"], r["allowed"], r["canonical_id"], r["is_nullable"]) == ("object", "enum", ["a", "b"], "s", True)
    for bad, said in (('{"$ref": "#/shared_column_definitions/t"}', "unresolved"), ('{"format": {"type": "odd"}}', "unknown format")):
        with pytest.raises(Exception, match=said):
            read(bad)


def test_exact_quartiles_over_many_tasks(spark):
    import numpy as np
    from dataloom.operators import anomalies
    r = np.random.default_rng(2)
    rows = [(i, str(round(float(r.normal()), 3)), str(int(r.integers(0, 5))), "x" if i % 3 else "7") for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string").repartition(7)
    got = {x["column"]: (x["n"], x["q1"], x["q3"]) for x in anomalies.quartiles(anomalies.numbers_of(df, ["a", "b", "c"]), ["a", "b", "c"]).collect()}
    for k, c in enumerate("abc", 1):
        v = [float(x[k]) for x in rows if x[k] != "x"]
        n, q1, q3 = got[c]
        assert n == len(v) and abs(q1 - np.percentile(v, 25)) < 1e-12 and abs(q3 - np.percentile(v, 75)) < 1e-12


def test_selection_of_ranks(spark, monkeypatch):
    """Every rank, with few bins and nothing fetched value by value: ties, both ends, extremes that no double difference holds."""
    from dataloom.operators import anomalies
    r = random.Random(8)
    v = sorted([r.choice([1.5, 1.5, 2.0, r.random(), -1e308, 1e308, 1e-300, r.randrange(10)]) + 0.0 for _ in range(60)])
    numbers = spark.createDataFrame([(float(x),) for x in r.sample(v, len(v))], "a double").repartition(3)
    got = anomalies.selected(numbers, ["a"], {"a": list(range(60))}, {"a": (v[0], v[-1])}, bins=4, few=2)
    assert [got["a", k] for k in range(60)] == v


def test_identities_are_those_of_all_tests(spark):
    r = random.Random(9)
    rows = []
    for i in range(200):
        a, b, d = r.randrange(1000), r.randrange(1000), r.randrange(3)
        rows.append((float(a), float(b) if i % 9 else None, float(a + b) if i % 20 else 7.0, float(d), float(a - d) if r.random() < 0.95 else -1.0, 5.0))
    df = frame(spark, [tuple(None if x is None else str(x) for x in row) for row in rows], "a string, b string, c string, d string, e string, k string")
    names = ["a", "b", "c", "d", "e", "k"]
    best = {}
    for x, t in enumerate(names):
        for y, left in enumerate(names):
            for z, right in enumerate(names):
                if len({x, y, z}) < 3:
                    continue
                for op in "-+":
                    if op == "+" and left > right:
                        continue
                    full = [(p[x], p[y], p[z], p[y] - p[z] if op == "-" else p[y] + p[z]) for p in rows if None not in (p[x], p[y], p[z])]
                    close = lambda u, w: abs(u - w) <= rules.TOLERANCE + rules.RELATIVE * abs(w)
                    m, s = sum(close(u, e) for u, _, _, e in full), sum(close(v, w) for _, v, w, _ in full)
                    if len(full) >= 30 and m >= 0.9 * len(full) and s <= 0.9 * len(full) and len({u for u, *_ in full}) >= 5 and len({e for *_, e in full}) >= 5 and len({v for _, v, _, _ in full}) > 1 and len({w for _, _, w, _ in full}) > 1:
                        now = (round(m / len(full), 4), x)
                        if frozenset((x, y, z)) not in best or now > best[frozenset((x, y, z))]:
                            best[frozenset((x, y, z))] = now
    got = {frozenset(map(names.index, (g["target"], g["left"], g["right"]))): (g["agreement"], names.index(g["target"])) for g in rules.identities(df.repartition(5), names).collect()}
    assert got == best and len(best) >= 2


def test_pairs_of_many_columns(spark):
    """300 columns: what is counted by order equals what is counted pair by pair."""
    r = random.Random(10)
    k = 300
    rows = [[r.choice([None, "a ", "A", "1.0", "1", "1.005", "2", f"v{r.randrange(50)}"]) for _ in range(k)] for _ in range(12)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "row_id long, " + ", ".join(f"c{j} string" for j in range(k))).repartition(3)
    got = {(x["i"], x["j"]): (x["n"], x["t"], x["c"], x["e"]) for x in duplicates.pair_counters(df, [f"c{j}" for j in range(k)]).collect()}
    assert len(got) == k * (k - 1)
    key = lambda v: v if v is None else v.strip().lower()
    num = lambda v: float(v) if v and v[0].isdigit() else None
    for i, j in [(r.randrange(k), r.randrange(k)) for _ in range(400)]:
        if i != j:
            both = [(row[i], row[j]) for row in rows if row[i] is not None and row[j] is not None]
            numbers = [(num(a), num(b)) for a, b in both if num(a) is not None and num(b) is not None]
            assert got[i, j] == (len(both), sum(key(a) == key(b) for a, b in both), len(numbers), sum(abs(a - b) <= rules.TOLERANCE + rules.RELATIVE * abs(b) for a, b in numbers))


def test_precision_zero_makes_integers(spark):
    from dataloom.operators import repair
    df = spark.createDataFrame([("1.0", "1.5"), ("2.0", None)], "a string, b string")
    assert dict(repair.safe_cast(df, "a", "float", 0).dtypes)["a"] == "bigint" and dict(repair.safe_cast(df, "b", "float", 0).dtypes)["b"] == "double"
