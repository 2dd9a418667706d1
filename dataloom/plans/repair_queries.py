"""Queries on repairs, invariants, audit, scores, reports, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions.values import col, text, try_number, value_freq
from ..operators import anomalies as an
from ..operators import audit as au
from ..operators import completeness as cm
from ..operators import duplicates as du
from ..operators import formats as fv
from ..operators import invariants as iv
from ..operators import pair_statistics as ps
from ..operators import plan as pl
from ..operators import remediation as rd
from ..operators import repair as rm
from ..operators import rules as cs
from ..operators import schema as sc
from ..operators import score as qs
from ..operators.formats import Spec
from ..operators.repair import Fix, Operation
from ..sources import files as io
from ..sources.dirty import COLUMNS, ROW
from ..sources.shared import scratch
from ..sources.snapshots import snapshot
from .profile_queries import FORMAT, RATES, SPECS, bad_rows, dated, plain, violation
from .registry import dirty, frequencies, number, query, quoted, table
from .rule_queries import ALL, CLEAN_ENTE, DEPENDENCIES, GROUPS, HINT_PAIRS, KEYED, PAIRS, PERIOD, RULES, clean_ente, consistency, groups, hint_sql, on_clean


def one(c: str, expression: str, where: str = "true") -> str:
    return f"WITH $D SELECT row_id, {expression} AS {quoted(c)} FROM d WHERE {where}"


def cell(s, d, op: Operation):
    return rm.apply_operation(dirty(s, d), ROW, op).select("row_id", col(op.column))


@query("rm_01_replace_values", one("stato", "CASE stato WHEN 'Altro' THEN NULL WHEN 'P' THEN 'pending' ELSE stato END"))
def _(s, d):
    return cell(s, d, Operation("replace_values", "stato", {"mapping": {"Altro": None, "P": "pending"}}))


@query("rm_01_replace_from_table", "SELECT l_orderkey, l_linenumber, coalesce(p_name, l_partkey::VARCHAR) AS l_partkey FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) p ON p_partkey = l_partkey")
def _(s, d):
    mapping = table(s, d, "part").where("p_size < 25").select(text(col("p_partkey")).alias("old"), F.col("p_name").alias("new"))
    return rm.replace_from_table(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", mapping)


@query("rm_02_normalize_numeric", one("spesa", plain("spesa")))
def _(s, d):
    return cell(s, d, Operation("normalize_numeric", "spesa"))


@query("rm_03_normalize_date", one("aggregation-time", f"strftime({dated(quoted('aggregation-time'))}, '%Y-%m-%d')"))
def _(s, d):
    return cell(s, d, Operation("normalize_date", "aggregation-time"))


MONTH_SQL = "CASE upper(substr(rata, 1, 3)) " + " ".join(f"WHEN '{k.upper()}' THEN '{v}'" for k, v in nz.MONTHS.items()) + " END"
PERIOD_SQL = rf"CASE WHEN regexp_full_match(rata, '\d{{4}}-\d{{2}}') THEN substr(rata, 1, 4) || substr(rata, 6, 2) WHEN regexp_full_match(rata, '\d{{2}}/\d{{4}}') THEN substr(rata, 4, 4) || substr(rata, 1, 2) WHEN regexp_full_match(rata, '[A-Z]{{3}}-\d{{4}}') THEN substr(rata, 5, 4) || {MONTH_SQL} ELSE rata END"


@query("rm_04_normalize_period", one("rata", PERIOD_SQL))
def _(s, d):
    return cell(s, d, Operation("normalize_period", "rata"))


@query("rm_05_is_canonical", f"WITH $D SELECT row_id, {PERIOD} AS canonical FROM d")
def _(s, d):
    return dirty(s, d).select("row_id", nz.is_period(col("rata")).alias("canonical"))


@query("rm_06_strip", one("ente", "trim(ente)"))
def _(s, d):
    return cell(s, d, Operation("strip_whitespace", "ente"))


CASING = """g AS (SELECT ente AS value, lower(trim(ente)) AS k, count(*) AS n FROM d WHERE ente IS NOT NULL GROUP BY ALL), b AS (SELECT *, first_value(value) OVER (PARTITION BY k ORDER BY n DESC, value) AS best FROM g)"""


@query("rm_07_collapse_casing", f"WITH $D, {CASING} SELECT row_id, b.best AS ente FROM d LEFT JOIN b ON b.value = d.ente")
def _(s, d):
    return cell(s, d, Operation("collapse_casing", "ente"))


@query("rm_07_casing_map", f"WITH $D, {CASING} SELECT 'ente' AS \"column\", value, best AS \"to\" FROM b WHERE value <> best")
def _(s, d):
    return rm.casing_map(frequencies(s, d, ["ente"]))


@query("rm_07_documents_language", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS before, lang AS after FROM documents")
def _(s, d):
    x = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("before"))
    x = x.withColumn("after", F.col("before"))
    return rm.collapse_casing(x, rm.casing_map(value_freq(x, "doc_id", ["after"]), {"after": ["de", "en", "es", "fr"]}), ["after"])


@query("rm_08_round", f"WITH $D SELECT row_id, {number('spesa')} IS NOT NULL AS is_number, CASE WHEN {number('spesa')} IS NULL THEN spesa END AS kept, round_even({number('spesa')}, 1) AS rounded FROM d")
def _(s, d):
    x = rm.apply_operation(dirty(s, d), ROW, Operation("round_decimals", "spesa", {"digits": 1}))
    reads = try_number(col("spesa"))
    return x.select("row_id", reads.isNotNull().alias("is_number"), F.when(reads.isNull(), col("spesa")).alias("kept"), reads.alias("rounded"))


@query("rm_08_round_ties", "SELECT l_orderkey, l_linenumber, round_even(l_quantity::DOUBLE / 2, 0) AS halves FROM lineitem")
def _(s, d):
    half = table(s, d, "lineitem").withColumn("halves", F.col("l_quantity").cast("double") / 2)
    x = rm.apply_operation(half, "l_orderkey", Operation("round_decimals", "halves", {"digits": 0}))
    return x.select("l_orderkey", "l_linenumber", F.col("halves").cast("double").alias("halves"))


@query("rm_09_safe_cast", 'WITH $D SELECT row_id, "SPESA TOTALE"::DOUBLE AS totale, mese FROM d')
def _(s, d):
    x = rm.safe_cast(rm.safe_cast(dirty(s, d), "SPESA TOTALE", "float"), "mese", "integer")
    return x.select("row_id", F.col("`SPESA TOTALE`").alias("totale"), "mese")


@query("rm_09_blocking_rows", f"WITH $D SELECT row_id, mese AS value FROM d WHERE mese IS NOT NULL AND {number('mese')} IS NULL")
def _(s, d):
    return rm.blocking_rows(dirty(s, d), ROW, "mese", "integer")


@query("rm_09_precision", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS whole, l_extendedprice::DOUBLE AS price FROM lineitem")
def _(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text(F.col("l_quantity").cast("double")).alias("whole"), text(F.col("l_extendedprice").cast("double")).alias("price"))
    return rm.safe_cast(rm.safe_cast(x, "whole", "float", 0), "price", "float", 2)


@query("rm_10_impute", "WITH $D, " + CLEAN_ENTE + ", " + on_clean(hint_sql(HINT_PAIRS, "sum(top_cnt) / sum(size)")) + " SELECT d0.row_id, coalesce(d0.ente, mp.value) AS ente FROM d0 LEFT JOIN mp ON mp.predictor = 'cod_ente' AND mp.target = 'ente' AND mp.key = d0.cod_ente")
def _(s, d):
    x = clean_ente(s, d)
    m = ps.single_hints(x, HINT_PAIRS, False)[1].where("predictor = 'cod_ente' and target = 'ente'")
    return rm.impute(x, "ente", "cod_ente", m).select("row_id", "ente")


@query("rm_11_drop_column", "WITH $D SELECT * EXCLUDE (note) FROM d")
def _(s, d):
    return rm.apply_operation(dirty(s, d), ROW, Operation("drop_column", "note"))


@query("rm_12_rename_column", 'WITH $D SELECT * RENAME ("SPESA TOTALE" AS spesa_totale) FROM d')
def _(s, d):
    x = rm.apply_operation(dirty(s, d), ROW, Operation("rename_column", "SPESA TOTALE", {"to": "spesa_totale"}))
    return rm.apply_operation(x, ROW, Operation("rename_column", "stato", {"to": "spesa"}))


@query("rm_13_drop_duplicate_rows", "WITH $D SELECT min(row_id) AS row_id, rata, stato FROM d GROUP BY rata, stato")
def _(s, d):
    return rm.apply_operation(dirty(s, d), ROW, Operation("drop_duplicate_rows", args={"subset": ["rata", "stato"]})).select("row_id", "rata", "stato")


def shouted(value: str) -> str:
    return value.strip().upper()


@query("rm_14_apply_function", one("ente", "upper(trim(ente))"))
def _(s, d):
    return cell(s, d, Operation("apply_function", "ente", {"function": shouted}))


def month_of(value: str) -> str:
    """A function with a fault of each kind: it changes '1', leaves 'mese 2', fails on 'mese 3' and makes no number of 'mese 4'."""
    if value == "mese 3":
        raise ValueError("no month")
    return {"1": "01", "mese 2": "mese 2", "mese 4": "x"}.get(value, value.split()[-1])


@query("rm_15_check_function", r"""WITH $F, w AS (SELECT value, regexp_full_match(value, '\d+') AS conforming FROM f WHERE "column" = 'mese' AND value IS NOT NULL)
SELECT value, conforming, CASE value WHEN '1' THEN 'changes a conforming value' WHEN 'mese 2' THEN 'leaves a violating value' WHEN 'mese 3' THEN 'ValueError: no month' ELSE 'result is no integer' END AS issue FROM w WHERE value IN ('1', 'mese 2', 'mese 3', 'mese 4')""")
def _(s, d):
    f = frequencies(s, d, ["mese"]).where("value is not null").select("value", F.col("value").rlike(r"\A\d+\z").alias("conforming"))
    return rm.check_function(f, month_of, "integer")


@query("rm_16_example_split", r"WITH $F, w AS (SELECT value, regexp_full_match(value, '\d{6}') AS conforming, cnt FROM f WHERE \"column\" = 'rata' AND value IS NOT NULL), r AS (SELECT value, conforming, row_number() OVER (PARTITION BY conforming ORDER BY cnt DESC, value)::INT AS rank FROM w) SELECT * FROM r WHERE rank <= 8".replace('\\"', '"'))
def _(s, d):
    return rm.example_split(frequencies(s, d, ["rata"]), fv.validate(dirty(s, d), ROW, {"rata": SPECS["rata"]}), "rata")


def known_states(value: str) -> str:
    if value == "Altro":
        raise ValueError("state")
    return value


@query("rm_16_vetted", "WITH $D SELECT DISTINCT stato AS value, NULL::BOOLEAN AS conforming, 'ValueError: state' AS issue FROM d WHERE stato = 'Altro' UNION ALL SELECT NULL, NULL, 'not validated: note has no value to run on'")
def _(s, d):
    """Without violations a function runs on the column's own values; on a column of nulls it is refused."""
    none = fv.validate(dirty(s, d).limit(0), ROW, {"stato": SPECS["stato"]})
    blank = value_freq(dirty(s, d).where("note is null"), ROW, ["note"])
    return rm.vet_function(frequencies(s, d, ["stato"]), none, "stato", known_states, "string").unionByName(rm.vet_function(blank, none, "note", known_states, "string"))


WELL = "coalesce({x} BETWEEN {lo} AND {hi} AND {x} = floor({x}), false)"
DERIVED = {"anno": f"CASE WHEN NOT {WELL.format(x=number('anno'), lo=1900, hi=2100)} AND {PERIOD} THEN substr(trim(rata), 1, 4) ELSE anno END", "mese": f"CASE WHEN NOT {WELL.format(x=number('mese'), lo=1, hi=12)} AND {PERIOD} THEN ltrim(substr(trim(rata), 5, 2), '0') ELSE mese END"}


@query("rm_17_derive", f"WITH $D SELECT row_id, {DERIVED['anno']} AS anno, {DERIVED['mese']} AS mese FROM d")
def _(s, d):
    x = rm.derive_part(rm.derive_part(dirty(s, d), "rata", "anno", "year"), "rata", "mese", "month")
    return x.select("row_id", "anno", "mese")


@query("rm_18_complete_period", f"""WITH $D, e AS (SELECT * FROM (SELECT *, "_id" AS k FROM d)), g AS (SELECT k, rata AS v, count(*) AS n FROM e WHERE {PERIOD} GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS r, sum(n) OVER (PARTITION BY k) AS size FROM g), m AS (SELECT k, v FROM w WHERE r = 1 AND n >= 0.95 * size), p AS (SELECT sum(n) FILTER (r = 1) / sum(n) AS p FROM w)
SELECT e.row_id, CASE WHEN {PERIOD} OR (SELECT p FROM p) < 0.99 THEN rata ELSE coalesce(m.v, rata) END AS rata FROM e LEFT JOIN m ON m.k = e.k""")
def _(s, d):
    return rm.complete_period(dirty(s, d), "rata", "_id").select("row_id", "rata")


REMEDIED = f"p1 AS (SELECT * REPLACE ({PERIOD_SQL} AS rata) FROM d), p2 AS (SELECT * REPLACE ({DERIVED['anno']} AS anno, {DERIVED['mese']} AS mese) FROM p1)"


@query("rm_19_auto_remediation", f"WITH $D, {REMEDIED} SELECT row_id, rata, anno, mese, stato FROM p2")
def _(s, d):
    x = rm.auto_remediate(dirty(s, d), ROW, "rata", {"year": "anno", "month": "mese"})
    return x.select("row_id", "rata", "anno", "mese", "stato")


@query("rm_19_summary", f"""WITH $D, {REMEDIED}, z AS (SELECT d.row_id, x.c AS "column", x.a AS before, x.b AS after FROM d JOIN p2 USING (row_id), LATERAL (VALUES ('rata', d.rata, p2.rata), ('anno', d.anno, p2.anno), ('mese', d.mese, p2.mese)) x(c, a, b) WHERE x.a IS DISTINCT FROM x.b)
SELECT "column", count(*) AS rows_rewritten, count(*) FILTER (before IS NULL) AS filled, arg_min_null(before, row_id) AS example_before, arg_min_null(after, row_id) AS example_after FROM z GROUP BY 1""")
def _(s, d):
    x = dirty(s, d)
    return rm.rewritten_columns(x, rm.auto_remediate(x, ROW, "rata", {"year": "anno", "month": "mese"}), ROW)


#: What the data alone decides: periods, their parts, and years completed from the moment that determines them.
FOUND = f"""p1 AS (SELECT * REPLACE ({PERIOD_SQL} AS rata) FROM d), p2 AS (SELECT * REPLACE ({DERIVED['anno']} AS anno, {DERIVED['mese']} AS mese) FROM p1),
g AS (SELECT "aggregation-time" AS k, rata AS v, count(*) AS n FROM p2 WHERE {PERIOD} GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS r, sum(n) OVER (PARTITION BY k) AS size FROM g), m AS (SELECT k, v FROM w WHERE r = 1 AND n >= 0.95 * size),
ok AS (SELECT (SELECT sum(n) FILTER (r = 1) / sum(n) FROM w) >= 0.99 AND (SELECT count(m.v) / count(*) FROM p2 LEFT JOIN m ON m.k = p2."aggregation-time" WHERE p2.rata IS NOT NULL AND NOT {PERIOD}) >= 0.5 AS hint),
p3 AS (SELECT p2.* REPLACE (CASE WHEN {PERIOD.replace('rata', 'p2.rata')} OR NOT (SELECT hint FROM ok) THEN p2.rata ELSE coalesce(m.v, p2.rata) END AS rata) FROM p2 LEFT JOIN m ON m.k = p2."aggregation-time")"""


def remedied(s, d):
    return rd.remediate(dirty(s, d).select(ROW, "rata", "anno", "mese", "stato", "ente", "aggregation-time"), ROW, {"rata": Spec("date", pattern="%m/%Y"), "stato": SPECS["stato"]}, [("stato", "ente")])


@query("rm_19_self_contained", f"WITH $D, {FOUND} SELECT row_id, rata, anno, mese, ente FROM p3")
def _(s, d):
    return remedied(s, d).data.select("row_id", "rata", "anno", "mese", "ente")


@query("rm_19_contested", f"""WITH $D, {FOUND} SELECT "column" AS column_name, row_id, value FROM (SELECT 'anno' AS "column", row_id, anno AS value FROM p1 WHERE {PERIOD} AND {WELL.format(x=number('anno'), lo=1900, hi=2100)} AND {number('anno')} <> substr(trim(rata), 1, 4)::INT UNION ALL SELECT 'mese', row_id, mese FROM p1 WHERE {PERIOD} AND {WELL.format(x=number('mese'), lo=1, hi=12)} AND {number('mese')} <> substr(trim(rata), 5, 2)::INT)""")
def _(s, d):
    return remedied(s, d).contested.select("column_name", "row_id", "value")


@query("rm_21_settled_corrections", f"""WITH $D, {FOUND}, c AS (SELECT DISTINCT 'rata' AS "column", rata AS value, 'x' AS "to" FROM d WHERE NOT {PERIOD} UNION ALL SELECT DISTINCT 'stato', stato, 'x' FROM d WHERE stato = 'Altro') SELECT * FROM c WHERE "column" = 'stato' OR value IN (SELECT rata FROM p3)""")
def _(s, d):
    x = dirty(s, d)
    proposed = x.where(~nz.is_period(col("rata"))).select(F.lit("rata").alias("column"), F.col("rata").alias("value")).distinct().unionByName(x.where("stato = 'Altro'").select(F.lit("stato").alias("column"), F.col("stato").alias("value")).distinct())
    return remedied(s, d).unsettled(ROW, proposed.withColumn("to", F.lit("x")))


@query("rm_21_refreshed", f"WITH $D, {FOUND}, b AS ({bad_rows(('stato',))}) SELECT \"column\" AS column_name, row_id, 'format' AS kind FROM b UNION ALL SELECT 'rata', row_id, 'format' FROM p3 WHERE rata IS NOT NULL AND NOT {PERIOD} UNION ALL SELECT 'mese', row_id, 'consistency' FROM p1 WHERE {PERIOD} AND {WELL.format(x=number('mese'), lo=1, hi=12)} AND {number('mese')} <> substr(trim(rata), 5, 2)::INT")
def _(s, d):
    x = dirty(s, d)
    before = fv.validate(x, ROW, {"rata": Spec("date", pattern="%m/%Y"), "stato": SPECS["stato"]}).unionByName(cs.identity_violations(x, ROW, "saldo", "entrate", "-", "uscite"))
    return remedied(s, d).refreshed(ROW, before).select("column_name", "row_id", "kind")


@query("rm_21_refresh", f"WITH $D, b AS ({bad_rows(('stato', 'cod_ente'))}), e AS (SELECT '{{}}' AS x) SELECT {FORMAT} FROM b UNION ALL SELECT {FORMAT} FROM (SELECT 'rata' AS \"column\", row_id, r AS value, '\\d{{6}}' AS said FROM (SELECT row_id, {PERIOD_SQL} AS r FROM d) WHERE r IS NOT NULL AND NOT regexp_full_match(r, '\\d{{6}}'))".replace(", e AS (SELECT '{}' AS x)", ""))
def _(s, d):
    x = dirty(s, d)
    before = fv.validate(x, ROW, {k: SPECS[k] for k in ("rata", "stato", "cod_ente")}).unionByName(cs.identity_violations(x, ROW, "saldo", "entrate", "-", "uscite"))
    return rm.refresh(before, ["rata"], fv.validate(rm.auto_remediate(x, ROW, "rata"), ROW, {"rata": SPECS["rata"]}))


@query("rm_22_schema_proposals", """WITH $D SELECT 'note' AS "column", 'drop_column' AS action, NULL AS "to" FROM d HAVING count(note) <= 0.1 * count(*) UNION ALL SELECT "column", 'rename_column', t FROM (VALUES ('_id', 'id'), ('SPESA TOTALE', 'spesa_totale'), ('aggregation-time', 'aggregation_time')) v("column", t)""")
def _(s, d):
    x = dirty(s, d)
    return rm.schema_proposals(sc.naming_violations(sc.names_frame(x, ROW)).unionByName(sc.sparse_violations(x, ROW)), x.columns)


AGGREGATED = f"""{DEPENDENCIES}, b AS (SELECT ce.*, dm.top FROM ce JOIN gd ON gd.predictor = ce.predictor AND gd.target = ce.target JOIN dm ON dm.predictor = ce.predictor AND dm.target = ce.target AND dm.key = ce.key WHERE dm.size >= 2 AND ce.value <> dm.top), o AS (SELECT *, row_number() OVER (PARTITION BY target, row_id ORDER BY ord) AS n FROM b),
v AS (SELECT target AS column_name, 'consistency' AS kind, 'cross-column: ' || predictor || '=''' || key || ''' implies ' || target || '=''' || top || '''' AS pt FROM o WHERE n = 1 UNION ALL SELECT 'saldo', 'consistency', 'saldo = entrate - uscite' FROM d WHERE abs(saldo - (entrate - uscite)) > 0.011),
g AS (SELECT column_name, kind, pt, count(*) AS n FROM v GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, pt) AS rank FROM g)"""


@query("rm_24_aggregated_violations", f"WITH $D, {AGGREGATED} SELECT column_name, pt AS entry, rank::INT AS rank, n::BIGINT AS count FROM w WHERE rank <= 5 UNION ALL SELECT column_name, 'further ' || kind, 6, sum(n)::BIGINT FROM w WHERE rank > 5 GROUP BY column_name, kind")
def _(s, d):
    return rm.aggregate_violations(consistency(s, d), 5)


@query("rm_25_evidence", r"""WITH $D, a AS (SELECT row_id, rata, anno, true AS dirty FROM d WHERE NOT regexp_full_match(rata, '\d{6}') ORDER BY row_id LIMIT 10), b AS (SELECT row_id, rata, anno, false AS dirty FROM d WHERE regexp_full_match(rata, '\d{6}') AND rata IS NOT NULL AND anno IS NOT NULL ORDER BY row_id LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b""")
def _(s, d):
    x = dirty(s, d)
    return rm.evidence_rows(x, ROW, fv.validate(x, ROW, {"rata": SPECS["rata"]}), ["rata", "anno"])


@query("rm_27_unaddressed", f"WITH $D, b AS ({bad_rows()}) SELECT \"column\" AS column_name, count(*)::BIGINT AS rows, 'no fix for format' AS reason FROM b WHERE \"column\" NOT IN ('rata', 'spesa') GROUP BY 1")
def _(s, d):
    return rm.unaddressed(fv.validate(dirty(s, d), ROW, SPECS), ["rata", "spesa"])


TRIED = Fix("f1", (Operation("replace_values", "stato", {"mapping": {"Altro": None}}), Operation("normalize_numeric", "spesa")))
NULLS = " + ".join(f"({quoted(c)} IS NULL)::INT" for c in COLUMNS)


@query("rm_28_trial", f"WITH $D, x AS (SELECT *, {plain('spesa')} AS after, stato = 'Altro' AS gone FROM d) SELECT count(*) AS rows_before, count(*) AS rows_after, count(*) FILTER (spesa IS DISTINCT FROM after OR gone) AS rows_changed, sum({NULLS})::BIGINT AS nulls_before, (sum({NULLS}) + count(*) FILTER (gone))::BIGINT AS nulls_after FROM x")
def _(s, d):
    return rm.trial(snapped(s, d), ROW, TRIED)


@query("rm_28_diff", f"WITH $D, x AS (SELECT row_id, 'spesa' AS \"column\", spesa AS before, {plain('spesa')} AS after FROM d UNION ALL SELECT row_id, 'stato', stato, NULL FROM d WHERE stato = 'Altro'), y AS (SELECT row_number() OVER (ORDER BY row_id, \"column\")::INT AS rank, * FROM x WHERE before IS DISTINCT FROM after) SELECT * FROM y WHERE rank <= 8")
def _(s, d):
    return rm.trial_diff(snapped(s, d), ROW, TRIED)


@query("rm_28_violation_delta", f"WITH $D, b AS ({bad_rows(('spesa', 'stato'))}), o AS (SELECT \"column\" AS column_name, count(*)::BIGINT AS before FROM b GROUP BY 1), fixed AS (SELECT * REPLACE ({plain('spesa')} AS spesa, CASE WHEN stato <> 'Altro' THEN stato END AS stato) FROM d), n AS ({bad_rows(('spesa', 'stato')).replace('FROM d', 'FROM fixed')}), m AS (SELECT \"column\" AS column_name, count(*)::BIGINT AS after FROM n GROUP BY 1) SELECT column_name, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta FROM o FULL JOIN m USING (column_name)")
def _(s, d):
    x, specs = dirty(s, d), {k: SPECS[k] for k in ("spesa", "stato")}
    return rm.violation_delta(fv.validate(x, ROW, specs), fv.validate(rm.apply_fix(x, ROW, TRIED), ROW, specs))


PLAN = [
    Fix("numbers", (Operation("normalize_numeric", "spesa"),)), Fix("periods", (Operation("normalize_period", "rata"),)), Fix("again", (Operation("normalize_numeric", "spesa"),)),
    Fix("wipe", (Operation("replace_values", "stato", {"mapping": {"P": None}}),)), Fix("after wipe", (Operation("strip_whitespace", "ente"),), ("wipe",)), Fix("shrink", (Operation("drop_column", "note"),)), Fix("rows", (Operation("drop_duplicate_rows"),)), Fix("ignored", (Operation("drop_column", "stato"),)),
]
APPROVED = {f.id for f in PLAN} - {"ignored"}


@query("rm_29_execute_status", """WITH $D SELECT * FROM (VALUES ('numbers', 'executed', ''), ('periods', 'executed', ''), ('again', 'skipped', 'same as an earlier fix'), ('after wipe', 'skipped', 'needs wipe'), ('shrink', 'executed', ''), ('rows', 'executed', ''), ('ignored', 'not approved', '')) t(fix, status, reason) UNION ALL SELECT 'wipe', 'rejected', 'stato: deleted values' FROM d HAVING count(*) FILTER (stato = 'P') > 0.02 * count(stato)""")
def _(s, d):
    return pl.execute(dirty(s, d), ROW, PLAN, APPROVED)[1]


@query("rm_29_execute_data", f"WITH $D, n AS (SELECT * EXCLUDE (note) REPLACE ({plain('spesa')} AS spesa, {PERIOD_SQL} AS rata) FROM d) SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(quoted(c) for c in COLUMNS if c != 'note')} ORDER BY row_id) AS r FROM n) WHERE r = 1")
def _(s, d):
    return pl.execute(dirty(s, d), ROW, PLAN, APPROVED)[0]


@query("rm_30_approved_only", f"WITH $D SELECT 'cell' AS scope, row_id, 'spesa' AS \"column\", spesa AS before, {plain('spesa')} AS after, 'numbers' AS source FROM d WHERE spesa IS DISTINCT FROM {plain('spesa')}")
def _(s, d):
    return pl.execute(dirty(s, d), ROW, PLAN, {"numbers"})[2]


@query("rm_31_sweep", f"""WITH $D, {CASING} SELECT row_id, best AS ente, "SPESA TOTALE"::DOUBLE AS spesa_totale, entrate::BIGINT AS entrate FROM d LEFT JOIN b ON b.value = d.ente""")
def _(s, d):
    """The declared types still have the name from before the rename, and one of a column that is gone."""
    x = dirty(s, d).select("row_id", "ente", F.col("`SPESA TOTALE`").alias("spesa_totale"), text(col("entrate")).alias("entrate"))
    return rm.sweep(x, ROW, {"SPESA TOTALE": "float", "entrate": "float", "note": "string"}, value_freq(x, ROW, ["ente"]), {"SPESA TOTALE": "spesa_totale"}, {"entrate": 0})


def snapped(s, d):
    """The relation in buckets of its row id: what is made of it row by row meets it without a shuffle."""
    return snapshot(dirty(s, d), ROW)


def numbers_fixed(s, d, x=None):
    return rm.apply_operation(dirty(s, d) if x is None else x, ROW, Operation("normalize_numeric", "spesa"))


def wiped(s, d, x=None):
    return rm.apply_operation(dirty(s, d) if x is None else x, ROW, Operation("replace_values", "stato", {"mapping": {"P": None, "Altro": None}}))


@query("iv_01_row_count", f"WITH $D SELECT '' AS \"column\", 'row count changed' AS failure WHERE (SELECT count(*) FROM d) <> (SELECT count(*) FROM (SELECT DISTINCT {ALL} FROM d))")
def _(s, d):
    x = dirty(s, d)
    return iv.row_count(x, du.drop_duplicate_rows(x, ROW), False)


@query("iv_02_invented", "WITH $D SELECT 'note' AS \"column\", 'note: filled a sparse column' AS failure FROM d HAVING count(note) < 0.5 * count(*) UNION ALL SELECT 'ente', 'ente: filled without a hint' FROM d HAVING count(ente) < count(*)")
def _(s, d):
    x = snapped(s, d)
    after = x.withColumn("note", F.coalesce("note", F.lit("x"))).withColumn("ente", F.coalesce("ente", F.lit("L0"))).withColumn("cod_ente", F.coalesce("cod_ente", F.lit("0")))
    return iv.invented(iv.measures(x, after, ROW, ["note", "ente", "cod_ente", "stato"]), {"cod_ente", "note"})


@query("iv_03_deleted", "WITH $D SELECT 'stato' AS \"column\", 'stato: deleted values' AS failure FROM d HAVING count(*) FILTER (stato = 'P') > 0.02 * count(stato)")
def _(s, d):
    x = snapped(s, d)
    return iv.deleted(iv.measures(x, wiped(s, d, x), ROW, ["stato", "ente"], {"stato": ["Altro"]}))


@query("iv_03_measures", "WITH $D SELECT count(*) AS rows, 'stato' AS \"column\", count(*) FILTER (stato IS NULL) AS nulls_before, count(*) FILTER (stato IS NULL OR stato IN ('P', 'Altro')) AS nulls_after, count(stato) AS populated, count(*) FILTER (stato = 'P') AS deleted, 0::BIGINT AS split_before, 0::BIGINT AS split_after FROM d")
def _(s, d):
    x = snapped(s, d)
    return iv.measures(x, wiped(s, d, x), ROW, ["stato"], {"stato": ["Altro"]})


@query("iv_04_split", "WITH $D SELECT 'stato' AS \"column\", 'stato: split spellings' AS failure FROM d HAVING count(*) FILTER (row_id % 3 = 0) > 0")
def _(s, d):
    x = snapped(s, d)
    after = x.withColumn("stato", F.when(F.col("row_id") % 3 == 0, F.lower("stato")).otherwise(F.col("stato"))).withColumn("ente", F.upper(F.trim("ente")))
    return iv.split(iv.measures(x, after, ROW, ["stato", "ente"]))


DIFF = f"SELECT 'cell' AS scope, row_id, 'spesa' AS \"column\", spesa AS before, {plain('spesa')} AS after, 'rm_02' AS source FROM d WHERE spesa IS DISTINCT FROM {plain('spesa')}"


@query("au_01_cell_diff", f"WITH $D {DIFF}")
def _(s, d):
    x = snapped(s, d)
    return au.cell_diff(x, numbers_fixed(s, d, x), ROW, "rm_02")


@query("au_01_row_diff", f"WITH $D, k AS (SELECT row_id, row_number() OVER (PARTITION BY {ALL} ORDER BY row_id) AS n FROM d) SELECT 'row' AS scope, row_id, '' AS \"column\", 'present' AS before, NULL::VARCHAR AS after, 'dedup' AS source FROM k WHERE n > 1")
def _(s, d):
    x = snapped(s, d)
    return au.cell_diff(x, du.drop_duplicate_rows(x, ROW), ROW, "dedup")


@query("au_02_typed_diff", f"WITH $D {DIFF} UNION ALL SELECT 'column', -1, 'SPESA TOTALE', 'string: ' || count(\"SPESA TOTALE\"), 'double: ' || count(\"SPESA TOTALE\"), 'rm_02' FROM d")
def _(s, d):
    x = snapped(s, d)
    return au.typed_diff(x, rm.safe_cast(numbers_fixed(s, d, x), "SPESA TOTALE", "float"), ROW, "rm_02")


@query("au_03_column_diff", """WITH $D SELECT 'stato' AS "column", 'stato' AS name_after, 'kept' AS status, count(*) - count(stato) AS nulls_before, count(*) - count(stato) AS nulls_after, count(DISTINCT stato) AS distinct_before, count(DISTINCT stato) AS distinct_after FROM d
UNION ALL SELECT 'SPESA TOTALE', 'spesa_totale', 'renamed', count(*) - count("SPESA TOTALE"), count(*) - count("SPESA TOTALE"), count(DISTINCT "SPESA TOTALE"), count(DISTINCT "SPESA TOTALE") FROM d
UNION ALL SELECT 'note', NULL, 'removed', count(*) - count(note), NULL, count(DISTINCT note), NULL FROM d UNION ALL SELECT NULL, 'fonte', 'added', NULL, 0, NULL, 1 FROM d HAVING count(*) > 0""")
def _(s, d):
    x = dirty(s, d).select("row_id", "stato", "`SPESA TOTALE`", "note")
    return au.column_diff(x, x.withColumnRenamed("SPESA TOTALE", "spesa_totale").drop("note").withColumn("fonte", F.lit("x")), ROW, {"SPESA TOTALE": "spesa_totale"})


@query("au_04_rows_changed", f"WITH $D, x AS (SELECT stato, CASE WHEN stato NOT IN ('P', 'Altro') THEN stato END AS after FROM d), n AS (SELECT sum({' + '.join(f'({quoted(c)} IS NULL)::INT' for c in COLUMNS)})::BIGINT AS n FROM d) SELECT count(*) AS rows_before, count(*) AS rows_after, count(*) FILTER (stato IS DISTINCT FROM after) AS rows_changed, any_value(n) AS nulls_before, (any_value(n) + count(*) FILTER (stato IN ('P', 'Altro')))::BIGINT AS nulls_after FROM x, n")
def _(s, d):
    x = snapped(s, d)
    return au.rows_changed(x, wiped(s, d, x), ROW)


@query("au_05_changes_summary", f"WITH $D, x AS ({DIFF} UNION ALL SELECT 'cell', row_id, 'stato', stato, NULL, 'wipe' FROM d WHERE stato IN ('P', 'Altro')) SELECT source, \"column\", count(*) AS changes FROM x GROUP BY ROLLUP (source, \"column\")")
def _(s, d):
    x = snapped(s, d)
    return au.changes_summary(au.cell_diff(x, numbers_fixed(s, d, x), ROW, "rm_02").unionByName(au.cell_diff(x, wiped(s, d, x), ROW, "wipe")))


def every_violation(s, d, x=None):
    x = dirty(s, d) if x is None else x
    return qs.merge_reports(fv.validate(x, ROW, SPECS), cm.missing_violations(x, ROW), du.collision_violations(x, ROW, "_id"), cs.dependency_violations(x, ROW, PAIRS), cs.identity_violations(x, ROW, "saldo", "entrate", "-", "uscite"), sc.naming_violations(sc.names_frame(x, ROW)))


KINDS = f"""b AS ({bad_rows()}), {RATES}, {KEYED}, {RULES}, kn AS (SELECT 'format' AS kind, count(*) AS violations FROM b UNION ALL SELECT 'completeness', sum(nulls)::BIGINT FROM r UNION ALL SELECT 'schema', 3 FROM d HAVING count(*) > 0 UNION ALL SELECT 'consistency', coalesce(sum(rows), 0)::BIGINT FROM rc UNION ALL SELECT 'uniqueness', count(*) FROM g WHERE versions > 1)"""


def kinds_sql() -> str:
    """KINDS without its two relations of one name: that of the format rows is renamed."""
    first, rest = KINDS.split("), r AS (", 1)
    return first.replace("b AS (", "fb AS (", 1) + "), r AS (" + rest.replace("count(*) AS violations FROM b ", "count(*) AS violations FROM fb ")


@query("qs_01_counts_by_kind", f"WITH $D, {kinds_sql()} SELECT * FROM kn")
def _(s, d):
    return qs.counts_by_kind(every_violation(s, d))


@query("qs_02_classified", f"WITH $D, {kinds_sql()} SELECT kind AS derived, CASE kind WHEN 'completeness' THEN (SELECT count(*) FROM r WHERE nulls > 0) ELSE violations END AS n FROM kn WHERE violations > 0")
def _(s, d):
    return every_violation(s, d).groupBy(qs.kind_of(F.col("expected_pattern")).alias("derived")).agg(F.count("*").alias("n"))


ODD = f"{RULES}, od AS (SELECT target AS column_name, row_id FROM o WHERE n = 1 UNION ALL SELECT 'saldo', row_id FROM d WHERE abs(saldo - (entrate - uscite)) > 0.011)"


@query("qs_03_inconsistent_rows", f"WITH $D, {ODD} SELECT column_name, count(DISTINCT row_id) AS rows FROM od GROUP BY ROLLUP (column_name)")
def _(s, d):
    return qs.inconsistent_rows(consistency(s, d))


@query("qs_04_checked_cells", f"WITH $D, b AS ({bad_rows()}), n AS (SELECT \"column\", count(*) AS violations FROM b GROUP BY 1), k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({quoted(c)}) AS checked FROM d" for c in SPECS) + ') SELECT k."column", checked, coalesce(violations, 0) AS violations FROM k LEFT JOIN n ON n."column" = k."column"')
def _(s, d):
    x = dirty(s, d)
    return qs.checked_cells(x, list(SPECS), fv.validate(x, ROW, SPECS))


def score_sql(tag: str, note: str = "count(note)") -> str:
    return f"""cn{tag} AS (SELECT count(*) AS rows, {' + '.join(note if c == 'note' else f'count({quoted(c)})' for c in COLUMNS)} AS filled FROM d),
dq{tag} AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM d GROUP BY {ALL})), kq{tag} AS (SELECT coalesce(sum(rows) FILTER (versions > 1), 0) AS conflict FROM g WHERE rows > 1),
vq{tag} AS (SELECT count(*) AS bad FROM fb), ck{tag} AS (SELECT {' + '.join(f'count({quoted(c)})' for c in SPECS)} AS checked FROM d), oq{tag} AS (SELECT count(DISTINCT row_id) AS odd FROM od),
m{tag} AS (SELECT 'completeness' AS dimension, round(filled / (rows * 14), 4) AS value FROM cn{tag} UNION ALL SELECT 'uniqueness', round((rows - dup - conflict) / rows, 4) FROM cn{tag}, dq{tag}, kq{tag} UNION ALL SELECT 'schema_conformity', round(10 / 14, 4) UNION ALL SELECT 'validity', round((checked - bad) / checked, 4) FROM ck{tag}, vq{tag} UNION ALL SELECT 'consistency', round((rows - odd) / rows, 4) FROM cn{tag}, oq{tag})"""


SCORED = f"{kinds_sql()}, od AS (SELECT target AS column_name, row_id FROM o WHERE n = 1 UNION ALL SELECT 'saldo', row_id FROM d WHERE abs(saldo - (entrate - uscite)) > 0.011), {score_sql('x')}"


def measured(s, d):
    x = dirty(s, d)
    return qs.metrics(x, ROW, every_violation(s, d), list(SPECS), ["_id"], sc.structural_defects(x, ROW))


@query("qs_05_metrics", f"WITH $D, {SCORED} SELECT dimension, value::DOUBLE AS value FROM mx")
def _(s, d):
    return measured(s, d)


@query("qs_06_reliability", f"WITH $D, {SCORED} SELECT round(exp(avg(ln(value))), 4) AS score, count(*) AS dimensions FROM mx")
def _(s, d):
    return qs.reliability(measured(s, d))


@query("qs_07_compare", f"WITH $D, {SCORED}, my AS (SELECT dimension, CASE WHEN dimension = 'completeness' THEN 1.0 ELSE value END AS value FROM mx WHERE dimension <> 'validity'), j AS (SELECT mx.value AS b, my.value AS a FROM mx JOIN my ON my.dimension = mx.dimension) SELECT round(exp(avg(ln(b))), 4) AS score_before, count(*) AS dimensions, round(exp(avg(ln(a))), 4) AS score_after FROM j")
def _(s, d):
    m = measured(s, d)
    return qs.compare(m, m.where("dimension <> 'validity'").withColumn("value", F.when(F.col("dimension") == "completeness", 1.0).otherwise(F.col("value"))))


@query("qs_08_like_for_like", f"WITH $D, {RATES} SELECT count(*) AS columns, round((sum(total) - sum(nulls)) / sum(total), 4) AS completeness FROM r WHERE \"column\" NOT IN ('note', 'SPESA TOTALE')")
def _(s, d):
    x = dirty(s, d)
    after = x.drop("note", "SPESA TOTALE").withColumnRenamed("stato", "status")
    return qs.like_for_like(cm.fill_rates(x, ROW), au.column_diff(x, after, ROW, {"stato": "status"}))


@query("qs_09_residual", f"WITH $D, {kinds_sql()} SELECT \"column\" AS column_name, 'format' AS kind, count(*) AS violations, count(*)::BIGINT AS rows FROM fb GROUP BY 1 UNION ALL SELECT \"column\", 'completeness', 1, nulls FROM r WHERE nulls > 0 UNION ALL SELECT '_id', 'uniqueness', count(*), sum(rows)::BIGINT FROM g WHERE versions > 1 HAVING count(*) > 0 UNION ALL SELECT target, 'consistency', count(*), count(*) FROM o WHERE n = 1 GROUP BY 1 UNION ALL SELECT 'saldo', 'consistency', count(*), count(*) FROM d WHERE abs(saldo - (entrate - uscite)) > 0.011 HAVING count(*) > 0")
def _(s, d):
    x = dirty(s, d)
    return qs.residual(fv.validate(x, ROW, SPECS), cm.missing_violations(x, ROW), du.collision_violations(x, ROW, "_id"), cs.dependency_violations(x, ROW, PAIRS), cs.identity_violations(x, ROW, "saldo", "entrate", "-", "uscite"))


@query("rp_01_column_appendix", f"""WITH $D, b AS ({bad_rows(('spesa', 'stato'))}), n AS (SELECT "column", count(*)::BIGINT AS k FROM b GROUP BY 1), a AS (SELECT count(*) FILTER (NOT coalesce({number(plain('spesa'))} >= 0, false)) AS k FROM d WHERE spesa IS NOT NULL), c AS (SELECT count(*) AS k FROM d WHERE spesa IS DISTINCT FROM {plain('spesa')}), s AS (SELECT coalesce(max(k), 0)::BIGINT AS k FROM n WHERE "column" = 'stato')
SELECT 'importo' AS "column", 'spesa' AS from_name, 'string' AS dtype, round(count(spesa) / count(*), 4) AS completeness, (SELECT coalesce(max(k), 0)::BIGINT FROM n WHERE "column" = 'spesa') AS detected, (SELECT k FROM a)::BIGINT AS outstanding, (SELECT k FROM c) AS changed FROM d
UNION ALL SELECT 'stato', 'stato', 'string', round(count(stato) / count(*), 4), (SELECT k FROM s), (SELECT k FROM s), 0 FROM d""")
def _(s, d):
    x = dirty(s, d).select("row_id", "spesa", "stato")
    after = rm.apply_operation(x, ROW, Operation("normalize_numeric", "spesa"))
    log = au.cell_diff(x, after, ROW, "rm_02")
    after = after.withColumnRenamed("spesa", "importo")
    outstanding = fv.validate(after, ROW, {"importo": SPECS["spesa"], "stato": SPECS["stato"]})
    return qs.column_appendix(au.column_diff(x, after, ROW, {"spesa": "importo"}), {k: v for k, v in after.dtypes if k != ROW}, cm.fill_rates(after, ROW), fv.validate(x, ROW, {k: SPECS[k] for k in ("spesa", "stato")}), outstanding, log)


@query("rp_02_rule_table", f"WITH $D, {RULES} SELECT rule, rows::BIGINT AS breaking, CASE WHEN rule LIKE 'saldo%' THEN 0 ELSE rows END::BIGINT AS remaining FROM rc")
def _(s, d):
    x = dirty(s, d)
    return qs.rule_table(cs.rule_counts(consistency(s, d)), cs.rule_counts(cs.dependency_violations(x, ROW, PAIRS)))


@query("rp_03_coverage", f"""WITH RECURSIVE $D, {kinds_sql()}, an AS (SELECT count(*) AS n FROM d, (SELECT quantile_cont(entrate, 0.25) AS q1, quantile_cont(entrate, 0.75) AS q3 FROM d) WHERE entrate < q1 - 1.5 * (q3 - q1) OR entrate > q3 + 1.5 * (q3 - q1)), {GROUPS.replace('rc AS', 'rr AS').replace('rc.', 'rr.').replace('FROM rc', 'FROM rr')}
SELECT CASE kind WHEN 'schema' THEN 'Schema validation' WHEN 'completeness' THEN 'Completeness' WHEN 'consistency' THEN 'Consistency' WHEN 'uniqueness' THEN 'Duplicate detection' ELSE 'Format validity' END AS area, (violations + CASE WHEN kind = 'consistency' THEN (SELECT count(DISTINCT "group") FROM gr) ELSE 0 END)::BIGINT AS detected FROM kn UNION ALL SELECT 'Anomaly detection', n FROM an""")
def _(s, d):
    found = an.detect(dirty(s, d), ROW, {"entrate": "measure"}, frequencies(s, d, ["stato"]))
    return qs.coverage_table(qs.counts_by_kind(every_violation(s, d)), found, groups(s, d))


@query("rp_04_merged_reports", f"WITH $D, b AS ({bad_rows(('rata', 'stato'))}), {RATES} SELECT {FORMAT} FROM b UNION ALL SELECT {violation('-1', 'NULL::VARCHAR', chr(39) + 'missing value' + chr(39), 'completeness', 'nulls')} FROM r WHERE nulls > 0")
def _(s, d):
    x = dirty(s, d)
    return qs.merge_reports(fv.validate(x, ROW, {k: SPECS[k] for k in ("rata", "stato")}), cm.missing_violations(x, ROW))


@query("vr_01_recovered_numbers", f"WITH $D, x AS (SELECT {number('spesa')} IS NULL AS messy, o_totalprice AS truth, {number(plain('spesa'))} AS got FROM d JOIN orders ON o_orderkey = row_id // 2) SELECT count(*) FILTER (messy AND abs(got - truth) <= 0.011) AS ok, count(*) FILTER (messy AND got IS NOT NULL AND abs(got - truth) > 0.011) AS wrong, count(*) FILTER (messy AND got IS NULL) AS lost, count(*) FILTER (NOT messy AND NOT coalesce(abs(got - truth) <= 0.011, false)) AS overwritten FROM x")
def _(s, d):
    truth = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("truth"))
    x = dirty(s, d)
    raw = x.join(truth, F.expr("row_id div 2") == F.col("k"))
    return qs.recovery(raw, numbers_fixed(s, d), ROW, "spesa", F.col("truth"), try_number(col("spesa")).isNull())


@query("vr_02_recovered_dates", f"""WITH $D, x AS (SELECT NOT regexp_full_match("aggregation-time", '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS messy, o_orderdate::DATE AS truth, {dated(quoted('aggregation-time'))}::DATE AS got FROM d JOIN orders ON o_orderkey = row_id // 2) SELECT count(*) FILTER (messy AND got = truth) AS ok, count(*) FILTER (messy AND got <> truth) AS wrong, count(*) FILTER (messy AND got IS NULL) AS lost, count(*) FILTER (NOT messy AND got IS DISTINCT FROM truth) AS overwritten FROM x""")
def _(s, d):
    truth = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("truth"))
    x = dirty(s, d).join(truth, F.expr("row_id div 2") == F.col("k"))
    got, messy = nz.normalize_date(col("aggregation-time")).cast("date"), ~col("aggregation-time").rlike(r"\A\d{4}-\d{2}-\d{2}\z")
    return x.agg(F.count_if(messy & (got == F.col("truth"))).alias("ok"), F.count_if(messy & (got != F.col("truth"))).alias("wrong"), F.count_if(messy & got.isNull()).alias("lost"), F.count_if(~messy & ~got.eqNullSafe(F.col("truth"))).alias("overwritten"))


@query("vr_03_compare_runs", f"WITH $D, {RATES} SELECT \"column\" AS metric, CASE WHEN \"column\" = 'note' THEN 'MISS' WHEN \"column\" = 'spesa' THEN 'DIFF' ELSE 'OK' END AS status FROM r UNION ALL SELECT 'extra', 'NEW'")
def _(s, d):
    a = cm.fill_rates(dirty(s, d), ROW).select(F.col("column").alias("metric"), F.col("completeness").alias("value"))
    b = a.where("metric <> 'note'").withColumn("value", F.when(F.col("metric") == "spesa", F.col("value") - 0.5).otherwise(F.col("value")))
    return qs.compare_runs(a, b.unionByName(b.agg(F.lit("extra").alias("metric"), F.lit(1.0).alias("value"))))


@query("vr_04_delivered", "WITH $D SELECT 'ente' AS \"column\", 'fill rate differs' AS problem FROM d HAVING count(ente) < 0.9985 * count(*) UNION ALL SELECT 'note', 'not in the report' FROM d HAVING count(*) > 0")
def _(s, d):
    rates = cm.fill_rates(dirty(s, d), ROW)
    return qs.check_delivered(rates.where("`column` <> 'note'").withColumn("completeness", F.when(F.col("column") == "ente", 1.0).otherwise(F.col("completeness"))), rates)


@query("io_01_csv_scan", "WITH $D SELECT CAST(row_id AS VARCHAR) AS row_id, " + ", ".join(f"CAST({quoted(c)} AS VARCHAR) AS {quoted(c)}" for c in COLUMNS) + " FROM d")
def _(s, d):
    path = io.write_cleaned(dirty(s, d), scratch(s, "csv"), "orders", False)
    return io.read_csv(s, path)


@query("io_01_na_tokens", "WITH $D SELECT row_id::VARCHAR AS row_id, CASE WHEN row_id % 3 = 0 THEN NULL ELSE stato END AS stato FROM d")
def _(s, d):
    x = dirty(s, d).select("row_id", F.when(F.col("row_id") % 3 == 0, F.when(F.col("row_id") % 2 == 0, "N/A").otherwise("NaN")).otherwise(F.col("stato")).alias("stato"))
    return io.read_csv(s, io.write_cleaned(x, scratch(s, "csv"), "tokens", False))


@query("io_02_cleaned_sink", f"WITH $D SELECT row_id, {plain('spesa')} AS spesa FROM d")
def _(s, d):
    path = io.write_cleaned(numbers_fixed(s, d).select("row_id", "spesa"), scratch(s, "sink"), "orders", True, "parquet")
    return s.read.parquet(path)


@query("io_03_change_sink", f"WITH $D {DIFF}")
def _(s, d):
    path = io.write_changes(au.cell_diff(dirty(s, d), numbers_fixed(s, d), ROW, "rm_02"), scratch(s, "sink"), "orders")
    return s.read.parquet(path)


def catalogue_files(s, d) -> str:
    """A catalogue made of the parts table: a brand is a domain, a type a dataset, part names are columns that refer to the definition of their size."""
    p = table(s, d, "part").select(F.col("p_brand").alias("domain"), F.col("p_type").alias("dataset"), F.struct(F.concat_ws("_", "p_name", "p_partkey").alias("column_name"), F.concat(F.lit("#/shared/"), "p_size").alias("ref"), F.lit(None).cast("string").alias("dtype"), F.lit(None).cast("string").alias("format_type"), F.lit(None).cast("string").alias("pattern")).alias("c"), F.struct(F.concat(F.lit("#/shared/"), "p_size").alias("ref"), F.when(F.col("p_size") % 2 == 0, "integer").otherwise("string").alias("dtype"), F.when(F.col("p_size") % 2 == 0, "range").otherwise("regex").alias("format_type"), text(col("p_size")).alias("pattern")).alias("d"))
    path = f"{scratch(s, 'catalogue')}/columns.json"
    p.groupBy("domain", "dataset").agg(F.collect_list("c").alias("columns"), F.collect_set("d").alias("shared")).write.json(path)
    return path


FLAT = "k AS (SELECT p_brand AS domain, p_type AS dataset, p_name || '_' || p_partkey AS column_name, CASE WHEN p_size % 2 = 0 THEN 'integer' ELSE 'string' END AS dtype, CASE WHEN p_size % 2 = 0 THEN 'range' ELSE 'regex' END AS format_type, p_size::VARCHAR AS pattern FROM part)"


@query("io_04_catalogue_scan", f"WITH {FLAT} SELECT * FROM k")
def _(s, d):
    return io.read_catalogue(s, catalogue_files(s, d))


def registry_file(s, d) -> str:
    """The parts table as one nested registry: a brand is a domain, a type a dataset, even sizes refer to a shared definition, odd ones have their own."""
    p = table(s, d, "part").withColumn("shared", F.col("p_size") % 2 == 0)
    kind = F.when(F.col("p_size") % 3 == 0, F.struct(F.lit("range").alias("type"), F.lit(None).cast("string").alias("pattern"), F.lit(1.0).alias("min"), F.col("p_size").cast("double").alias("max"))).otherwise(F.struct(F.lit("regex").alias("type"), text(col("p_size")).alias("pattern"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max")))
    definition = F.struct(F.when(F.col("p_size") % 5 != 0, F.lit("int64")).alias("dtype"), kind.alias("format"), F.when(F.col("p_size") % 4 == 1, F.lit(False)).alias("is_nullable"))
    ref = F.struct(F.concat(F.lit("#/shared_column_definitions/s"), "p_size").alias("$ref"))
    columns = p.select("p_brand", "p_type", F.concat_ws("_", "p_name", "p_partkey").alias("name"), F.when(F.col("shared"), F.to_json(ref)).otherwise(F.to_json(definition)).alias("json"))
    pair = lambda name, json: F.concat(F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit(":"), json)
    joined = lambda x: F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(x)), ","), F.lit("}"))
    sets = columns.groupBy("p_brand", "p_type").agg(joined(pair(F.col("name"), F.col("json"))).alias("json"))
    domains = sets.groupBy("p_brand").agg(joined(pair(F.col("p_type"), F.concat(F.lit('{"description":"d","columns":'), "json", F.lit("}")))).alias("json"))
    whole = domains.agg(joined(pair(F.col("p_brand"), F.concat(F.lit('{"datasets":'), "json", F.lit("}")))).alias("domains"))
    shared = p.where("shared").select(F.concat(F.lit("s"), "p_size").alias("name"), F.to_json(definition).alias("json")).distinct().agg(joined(pair(F.col("name"), F.col("json"))).alias("shared"))
    path = f"{scratch(s, 'registry')}/registry.json"
    whole.join(shared, F.lit(True)).select(F.concat(F.lit('{"registry":{"metadata":{},\n"shared_column_definitions":{"_remark":"of sizes",'), F.expr("substring(shared, 2)"), F.lit(',\n"domains":'), "domains", F.lit("}}")).alias("value")).write.text(path)
    return path


@query("io_04_registry", """SELECT p_brand AS domain, p_type AS dataset, p_name || '_' || p_partkey AS column_name, CASE WHEN p_size % 5 <> 0 THEN 'int64' ELSE 'object' END AS dtype, CASE WHEN p_size % 3 = 0 THEN 'range' ELSE 'regex' END AS format_type, CASE WHEN p_size % 3 <> 0 THEN p_size::VARCHAR END AS pattern,
CASE WHEN p_size % 3 = 0 THEN 1.0::DOUBLE END AS least, CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE END AS greatest, p_size % 4 <> 1 AS is_nullable, CASE WHEN p_size % 2 = 0 THEN 's' || p_size END AS canonical_id FROM part""")
def _(s, d):
    return io.read_registry(s, registry_file(s, d), "registry").drop("allowed", "case_convention")


@query("io_05_first_definitions", f"WITH {FLAT}, n AS (SELECT * REPLACE (split_part(column_name, '_', 1) AS column_name) FROM k) SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY domain, dataset, dtype, pattern) AS r FROM n) WHERE r = 1")
def _(s, d):
    return io.first_definitions(io.read_catalogue(s, catalogue_files(s, d)).withColumn("column_name", F.substring_index("column_name", "_", 1)))


@query("io_05_signatures", f"WITH {FLAT} SELECT domain, string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS columns FROM k GROUP BY 1")
def _(s, d):
    return io.signatures(io.read_catalogue(s, catalogue_files(s, d)))


@query("io_06_descriptions", "SELECT p_name || '_' || p_partkey AS column_name, p_type || ' of ' || p_brand AS description, [p_size::VARCHAR, p_brand] AS sample, 'string' AS dtype FROM part")
def _(s, d):
    path = f"{scratch(s, 'catalogue')}/descriptions.json"
    table(s, d, "part").select(F.concat_ws("_", "p_name", "p_partkey").alias("column_name"), F.concat_ws(" of ", "p_type", "p_brand").alias("description"), F.array(text(col("p_size")), F.col("p_brand")).alias("sample"), F.lit("string").alias("dtype")).write.json(path)
    return io.read_descriptions(s, path)


@query("row_identity", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS _row_id FROM orders")
def _(s, d):
    return io.with_row_id(table(s, d, "orders").select("o_orderkey"), order=["o_orderkey"])

