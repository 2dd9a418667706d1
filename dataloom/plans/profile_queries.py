"""Queries on completeness, profiles, schema and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import col, text, value_freq
from ..operators import completeness as cm
from ..operators import formats as fv
from ..operators import profile as pr
from ..operators import schema as sc
from ..operators.formats import Spec
from ..sources.dirty import COLUMNS, ROW
from .registry import TOKENS, dirty, frequencies, number, query, quoted, table, union

LISTS = {c: ["N.D.", "Altro"] for c in COLUMNS if c not in ("entrate", "uscite", "saldo")}
TYPES = {"mese": "integer", "anno": "integer", "spesa": "float", "SPESA TOTALE": "float", "aggregation-time": "datetime", "cod_ente": "integer"}
SPECS = {
    "rata": Spec("regex", pattern=r"\d{6}"), "stato": Spec("enum", values=("F", "O", "P")), "mese": Spec("range", low=1, high=12), "spesa": Spec("range", low=0),
    "aggregation-time": Spec("date", pattern="%Y-%m-%d"), "cod_ente": Spec("regex", pattern=r"\d{1,2}"),
}
NULLS = " + ".join(f"({quoted(c)} IS NULL)::INT" for c in COLUMNS)
RATIO = "round(least(greatest({} , 0.0), 1.0), 4)"
RATES = "r AS (" + union(lambda c, i: f"SELECT '{c}' AS \"column\", {i} AS position, count(*) - count({quoted(c)}) AS nulls, count(*) AS total FROM d") + ")"
VIOLATION = '"column" AS column_name, {row}::BIGINT AS row_id, {value} AS value, {said} AS expected_pattern, \'{kind}\' AS kind, {rows}::BIGINT AS affected_rows'


def violation(row: str, value: str, said: str, kind: str, rows: str = "1") -> str:
    return VIOLATION.format(row=row, value=value, said=said, kind=kind, rows=rows)


@query("cm_01_fill_rates", f'WITH $D, {RATES} SELECT *, round((total - nulls) / total, 4) AS completeness FROM r')
def _(s, d):
    return cm.fill_rates(dirty(s, d), ROW)


@query("cm_02_overall", f"WITH $D SELECT count(*) AS rows, 14 AS columns, count(*) * 14 AS cells, sum({NULLS})::BIGINT AS null_cells, round((count(*) * 14 - sum({NULLS})) / (count(*) * 14), 4) AS completeness FROM d")
def _(s, d):
    return cm.overall(dirty(s, d), ROW)


@query("cm_03_row_nulls", f"WITH $D, n AS (SELECT {NULLS} AS n FROM d) SELECT count(*) FILTER (n = 0) AS complete_rows, count(*) FILTER (n > 0) AS rows_with_nulls, max(n) AS most_nulls FROM n")
def _(s, d):
    return cm.row_distribution(dirty(s, d), ROW)


@query("cm_04_worst_rows", f"WITH $D SELECT row_id, {NULLS} AS nulls FROM d WHERE {NULLS} > 0 ORDER BY nulls DESC, row_id LIMIT 10")
def _(s, d):
    return cm.worst_rows(dirty(s, d), ROW)


@query("cm_05_sparse_columns", f'WITH $D, {RATES} SELECT "column", nulls, total FROM r WHERE nulls >= 0.9 * total')
def _(s, d):
    return cm.sparse_columns(dirty(s, d), ROW)


def _unmasked(c: str) -> str:
    return f"CASE WHEN trim({quoted(c)}) NOT IN ('N.D.', 'Altro') THEN {quoted(c)} END AS {quoted(c)}" if c in LISTS else quoted(c)


UNMASKED = "u AS (SELECT row_id, " + ", ".join(_unmasked(c) for c in COLUMNS) + " FROM d)"


@query("cm_06_unmask", f"WITH $D, {UNMASKED} SELECT * FROM u")
def _(s, d):
    return cm.unmask(dirty(s, d), LISTS)


GUARD = {"spesa": ["N.D."], "stato": ["F", "O"], "cod_ente": ["N.D.", "0"]}


@query("cm_07_unmask_guard", "WITH $D, g AS (" + union(lambda c, _: f"SELECT '{c}' AS \"column\", count(*) FILTER (trim({quoted(c)}) IN ({', '.join(repr(t) for t in GUARD[c])})) AS cleared, count({quoted(c)}) AS populated FROM d", list(GUARD)) + ") SELECT *, cleared <= 0.3 * populated AS accepted FROM g")
def _(s, d):
    return cm.unmask_guard(dirty(s, d), GUARD)


@query("cm_08_missing_violations", f"WITH $D, {RATES} SELECT {violation('-1', 'NULL::VARCHAR', chr(39) + 'missing value' + chr(39), 'completeness', 'nulls')} FROM r WHERE nulls > 0 AND \"column\" <> 'ente'")
def _(s, d):
    return cm.missing_violations(dirty(s, d), ROW, ["ente"])


@query("cm_09_disguised_nulls", f"WITH $D, {UNMASKED}, a AS (SELECT sum({NULLS})::BIGINT AS raw_nulls FROM d), b AS (SELECT sum({NULLS})::BIGINT AS detected_nulls FROM u) SELECT *, detected_nulls - raw_nulls AS disguised FROM a, b")
def _(s, d):
    x = dirty(s, d)
    return cm.disguised_nulls(x, cm.unmask(x, LISTS), ROW)


@query("cm_10_placeholder_census", f'WITH $F, n AS (SELECT "column", sum(cnt) AS n, coalesce(sum(cnt) FILTER (value IS NULL), 0) AS nulls, coalesce(sum(cnt) FILTER (lower(trim(value)) IN {TOKENS}), 0)::BIGINT AS disguised, count(value) AS distinct_values FROM f GROUP BY 1) SELECT "column", nulls::BIGINT AS nulls, round(nulls / n, 4) AS null_rate, disguised, distinct_values, nulls = n AS fully_empty, nulls / n > 0.9 AS sparse FROM n')
def _(s, d):
    return cm.placeholder_census(frequencies(s, d))


@query("cm_10_token_counts", f'WITH $F SELECT "column", lower(trim(value)) AS token, sum(cnt)::BIGINT AS cells FROM f WHERE lower(trim(value)) IN {TOKENS} GROUP BY ALL')
def _(s, d):
    return cm.token_counts(frequencies(s, d))


@query("pr_01_profile", 'WITH $F SELECT "column", position, sum(cnt)::BIGINT AS rows, coalesce(sum(cnt) FILTER (value IS NOT NULL), 0)::BIGINT AS populated, count(value) AS "distinct", coalesce(sum(cnt) FILTER (value IS NULL), 0)::BIGINT AS nulls, CASE WHEN count(value) > 0 THEN round(count(value) / sum(cnt) FILTER (value IS NOT NULL), 4) END AS cardinality FROM f GROUP BY ALL')
def _(s, d):
    return pr.column_profile(frequencies(s, d))


@query("pr_02_sample", 'WITH $F SELECT * FROM (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY md5(value), value)::INT AS rank FROM f WHERE value IS NOT NULL) WHERE rank <= 30')
def _(s, d):
    return pr.column_sample(frequencies(s, d))


@query("pr_02_head", 'WITH $F SELECT "column", rank::INT AS rank, value FROM (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY row_id) AS rank FROM c WHERE value IS NOT NULL) WHERE rank <= 5')
def _(s, d):
    return pr.column_head(dirty(s, d), ROW)


@query("pr_02_first_distinct", 'WITH $F SELECT "column", rank::INT AS rank, value FROM (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY min(row_id)) AS rank FROM c WHERE value IS NOT NULL GROUP BY "column", value) WHERE rank <= 150')
def _(s, d):
    return pr.first_distinct(dirty(s, d), ROW)


#: normalize_number in SQL, for text without unit suffixes beyond letters.
def plain(x: str) -> str:
    t = rf"trim(regexp_replace(regexp_replace(trim({x}), '^\s*[€$£]\s*', ''), '(?i)\s*(eur|euro|usd)\s*$', ''))"
    u = rf"(CASE WHEN regexp_full_match({t}, '(-?[\d.,]+)\s+[A-Za-zÀ-ÿ]+\.?') THEN regexp_extract({t}, '(-?[\d.,]+)\s+', 1) ELSE {t} END)"
    return (rf"(CASE WHEN {t} = '' THEN {x} WHEN regexp_full_match({u}, '-?\d{{1,3}}(\.\d{{3}})+(,\d+)?') THEN replace(replace({u}, '.', ''), ',', '.')"
            rf" WHEN regexp_full_match({u}, '-?\d{{1,3}}(,\d{{3}})+(\.\d+)?') THEN replace({u}, ',', '') WHEN regexp_full_match({u}, '-?\d+,\d+') THEN replace({u}, ',', '.') ELSE {u} END)")


NUMERIC = f'n AS (SELECT "column", position, value, cnt, {number(plain("value"))} AS x FROM f)'


@query("pr_03_numeric_share", f'WITH $F, {NUMERIC}, s AS (SELECT "column", round(coalesce(sum(cnt) FILTER (x IS NOT NULL), 0) / sum(cnt), 4) AS share FROM n WHERE value IS NOT NULL GROUP BY 1) SELECT *, share >= 0.9 AS numeric FROM s')
def _(s, d):
    return pr.numeric_share(frequencies(s, d))


#: normalize_date in SQL, for the layouts that dirty_orders has.
def dated(x: str) -> str:
    shapes = {r"\d{4}-\d{1,2}-\d{1,2}": "%Y-%m-%d", r"\d{1,2}/\d{1,2}/\d{4}": "%d/%m/%Y", r"\d{1,2}-\d{1,2}-\d{4}": "%d-%m-%Y", r"\d{1,2}\.\d{1,2}\.\d{4}": "%d.%m.%Y", r"\d{1,2}-\d{1,2}-\d{2}": "%d-%m-%y", r"\d{8}": "%Y%m%d", r"\d{6}": "%Y%m"}
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_full_match({x}, '{p}') THEN try_strptime({x}, '{f}') END" for p, f in shapes.items()) + ")"


@query("pr_04_reconcile_dtype", f"""WITH $F, w AS (SELECT "column", value, cnt, CASE "column" WHEN 'mese' THEN 'integer' WHEN 'anno' THEN 'integer' WHEN 'spesa' THEN 'float' WHEN 'SPESA TOTALE' THEN 'float' WHEN 'aggregation-time' THEN 'datetime' WHEN 'cod_ente' THEN 'integer' END AS want, {number("value")} AS x, {dated("value")} AS t FROM f WHERE "column" NOT IN ('entrate', 'uscite', 'saldo')),
g AS (SELECT "column", any_value(want) AS want, bool_and(value IS NULL OR CASE want WHEN 'integer' THEN x IS NOT NULL AND x = floor(x) WHEN 'float' THEN x IS NOT NULL WHEN 'datetime' THEN t IS NOT NULL ELSE true END) AS exact, coalesce(sum(cnt) FILTER (x IS NOT NULL), 0) / sum(cnt) AS nums, coalesce(sum(cnt) FILTER (t IS NOT NULL), 0) / sum(cnt) AS dates FROM w GROUP BY 1)
SELECT "column", CASE WHEN want IS NOT NULL AND (exact OR (want IN ('integer', 'float') AND nums >= 0.9) OR (want = 'datetime' AND dates >= 0.9)) THEN want ELSE 'string' END AS dtype FROM g""")
def _(s, d):
    names = [c for c in COLUMNS if c not in ("entrate", "uscite", "saldo")]
    return pr.reconcile_dtype(frequencies(s, d, names), TYPES, {c: "string" for c in names})


ROLE = f"""{NUMERIC}, a AS (SELECT "column", position, coalesce(sum(cnt) FILTER (value IS NOT NULL), 0) AS populated, count(value) AS nd, sum(cnt) FILTER (x IS NOT NULL AND value IS NOT NULL) / sum(cnt) FILTER (value IS NOT NULL) AS num,
coalesce(sum(cnt) FILTER (regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}')), 0) / sum(cnt) FILTER (value IS NOT NULL) AS tmp FROM n GROUP BY 1, 2)"""


@query("pr_06_roles", f"""WITH $F, {ROLE} SELECT "column", position, CASE WHEN populated = 0 THEN 'skip' WHEN nd / populated >= 0.9 THEN 'identifier' WHEN tmp >= 0.9 THEN 'temporal' WHEN num >= 0.9 AND ("column" = 'uscite' OR nd <= 30) THEN 'code' WHEN num >= 0.9 THEN 'measure' WHEN nd <= 30 THEN 'category' ELSE 'free_text' END AS role FROM a""")
def _(s, d):
    return pr.column_roles(frequencies(s, d), {"uscite": "Expense code"})


@query("pr_07_temporal", """WITH e AS (SELECT 'ts' AS "column", strftime(ts, '%Y-%m-%d %H:%M:%S') AS value FROM events UNION ALL SELECT 'event_type', event_type FROM events)
SELECT "column", count(*) FILTER (regexp_matches(value, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}')) >= 0.9 * count(*) AS temporal FROM e WHERE value IS NOT NULL GROUP BY 1""")
def _(s, d):

    return pr.temporal_columns(value_freq(table(s, d, "events").select("event_id", "ts", "event_type"), "event_id"))


@query("pr_08_period_key", "SELECT event_id, strftime(ts, '%Y-%m') AS period, event_type AS other FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", pr.period_key(col("ts"), True).alias("period"), pr.period_key(col("event_type"), False).alias("other"))


@query("pr_09_states_no_day", r"""WITH $F, g AS (SELECT * FROM f UNION ALL SELECT 'o_month', -1, strftime(o_orderdate::DATE, '%Y-%m'), count(*) FROM orders GROUP BY 3)
SELECT "column", coalesce(bool_and(regexp_full_match(value, '\d{4}[-/.]?\d{2}|\d{2}[-/.]\d{4}')), false) AS month_only FROM g GROUP BY 1""")
def _(s, d):
    months = table(s, d, "orders").groupBy(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM").alias("value")).agg(F.count("*").alias("cnt"))
    return pr.states_no_day(frequencies(s, d).unionByName(months.select(F.lit("o_month").alias("column"), F.lit(-1).alias("position"), "value", "cnt")))


@query("pr_10_precision", r"""WITH l AS (SELECT 'l_extendedprice' AS "column", l_extendedprice AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem),
g AS (SELECT "column", length(regexp_replace(CASE WHEN contains(x::VARCHAR, '.') AND NOT contains(x::VARCHAR, 'e') THEN split_part(x::VARCHAR, '.', 2) ELSE '' END, '0+$', '')) AS digits, count(*) AS cnt FROM l GROUP BY ALL),
w AS (SELECT *, sum(cnt) OVER (PARTITION BY "column" ORDER BY digits) AS upto, sum(cnt) OVER (PARTITION BY "column") AS n, lead(digits) OVER (PARTITION BY "column" ORDER BY digits) AS nxt FROM g),
m AS (SELECT "column", min(digits) AS d FROM w WHERE upto >= 0.5 * n AND digits <= 6 GROUP BY 1)
SELECT m."column", CASE WHEN w.nxt IS NULL OR w.nxt > m.d + 2 THEN m.d END::INT AS precision FROM m JOIN w ON w."column" = m."column" AND w.digits = m.d""")
def _(s, d):

    x = table(s, d, "lineitem").select("l_extendedprice", "l_discount", "l_quantity").withColumn("row_id", F.lit(0))
    return pr.recorded_precision(value_freq(x, "row_id"))


@query("pr_11_rounds_cleanly", "WITH x AS (SELECT l_extendedprice AS x, round_even(l_extendedprice, 1) AS y FROM lineitem) SELECT abs(sum(x) - sum(y)) / greatest(abs(sum(x)), 1.0) <= 1e-9 AS clean, bool_or(x <> y) AS excess FROM x")
def _(s, d):
    return pr.rounds_cleanly(table(s, d, "lineitem"), "l_extendedprice", 1)


@query("pr_12_excess_decimals", "SELECT bool_or(round_even(l_discount, 2) <> l_discount) AS excess FROM lineitem")
def _(s, d):
    return pr.rounds_cleanly(table(s, d, "lineitem"), "l_discount", 2).select("excess")


SPEC_SQL = r"""WITH $F, v AS (SELECT "column", value, cnt, """ + number("value") + r""" AS x, CASE WHEN regexp_full_match(value, '\d{4}-\d{1,2}-\d{1,2}') THEN try_strptime(value, '%Y-%m-%d') END AS t FROM f WHERE value IS NOT NULL),
b AS (SELECT "column", sum(cnt) AS n, count(*) AS nd, coalesce(sum(cnt) FILTER (x IS NOT NULL), 0) AS nums, min(x) AS lo, max(x) AS hi, coalesce(sum(cnt) FILTER (t IS NOT NULL), 0) AS dates,
  coalesce(sum(cnt) FILTER (regexp_full_match(value, '\d{6}') AND try_strptime(value, '%Y%m') IS NOT NULL), 0) AS months, coalesce(sum(cnt) FILTER (regexp_full_match(value, '\d{4}')), 0) AS years,
  bool_and(CASE WHEN regexp_full_match(value, '\d{4}') THEN year(try_strptime(value, '%Y')) BETWEEN 1500 AND 2200 ELSE true END) AS year_ok FROM v GROUP BY 1),
e AS (SELECT v."column", string_agg(value, '|' ORDER BY cnt DESC, value) AS vals, count(*) AS k, sum(cnt) AS covered FROM v JOIN b ON b."column" = v."column" WHERE nd <= 30 AND cnt >= 0.01 * n GROUP BY 1),
s AS (SELECT "column", regexp_replace(regexp_replace(regexp_replace(value, '[0-9]', '#', 'g'), '[A-Z]', '^', 'g'), '[a-z]', '_', 'g') AS shape, sum(cnt) AS cnt FROM v GROUP BY ALL),
h AS (SELECT "column", max(cnt) AS top FROM s GROUP BY 1)
SELECT b."column", CASE WHEN dates >= 0.85 * n THEN 'date' WHEN months >= 0.85 * n THEN 'date' WHEN years >= 0.85 * n AND year_ok THEN 'date' WHEN nums >= 0.85 * n THEN 'range' WHEN k > 1 AND covered >= 0.85 * n THEN 'enum' WHEN top >= 0.85 * n THEN 'regex' END AS kind
FROM b LEFT JOIN e ON e."column" = b."column" JOIN h ON h."column" = b."column" WHERE n >= 5"""


@query("pr_13_format_spec_kinds", SPEC_SQL)
def _(s, d):
    return pr.format_specs(frequencies(s, d)).select("column", "kind")


@query("pr_13_format_specs")
def _(s, d):
    return pr.format_specs(frequencies(s, d))


@query("pr_13a_date_spec", r"""WITH e AS (SELECT strftime(o_orderdate, '%Y/%m/%d') AS v FROM orders) SELECT 'v' AS "column", 'date' AS kind, '%Y/%m/%d' AS spec FROM e HAVING count(try_strptime(v, '%Y/%m/%d')) >= 0.85 * count(*)""")
def _(s, d):

    x = table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("v"))
    return pr.format_specs(value_freq(x, "o_orderkey"))


@query("pr_13b_range_spec", """SELECT 'l_quantity' AS "column", 'range' AS kind, min(l_quantity)::VARCHAR || '..' || max(l_quantity)::VARCHAR AS spec FROM lineitem""")
def _(s, d):

    return pr.format_specs(value_freq(table(s, d, "lineitem").select("l_quantity").withColumn("row_id", F.lit(0)), "row_id"))


@query("pr_13c_enum_spec", """WITH g AS (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1) SELECT 'event_type' AS "column", 'enum' AS kind, string_agg(v, '|' ORDER BY n DESC, v) AS spec FROM g""")
def _(s, d):

    return pr.format_specs(value_freq(table(s, d, "events").select("event_id", "event_type"), "event_id"))


@query("pr_13d_regex_shapes", r"""WITH $F, s AS (SELECT "column", regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[0-9]', chr(1), 'g'), '[A-Z]', 'U', 'g'), '[a-z]', 'l', 'g'), chr(1), 'd', 'g') AS shape, sum(cnt)::BIGINT AS cnt FROM f WHERE value IS NOT NULL GROUP BY ALL) SELECT *, (sum(cnt) OVER (PARTITION BY "column"))::BIGINT AS n FROM s""")
def _(s, d):
    return pr.shape_shares(frequencies(s, d))


@query("pr_15_sentinels", f"""WITH $F, n AS (SELECT "column", {number("value")} AS x FROM f), e AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM n GROUP BY 1), u AS (SELECT "column", lo AS sentinel FROM e UNION SELECT "column", hi FROM e)
SELECT * FROM u WHERE sentinel IS NOT NULL AND regexp_full_match(abs(sentinel)::BIGINT::VARCHAR, '9{{4,}}')""")
def _(s, d):
    return pr.numeric_sentinels(frequencies(s, d))


CANDIDATES = f"""n AS (SELECT "column", value, {number("value")} AS x FROM f WHERE value IS NOT NULL), e AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM n GROUP BY 1),
k AS (SELECT "column", value AS token FROM n WHERE lower(trim(value)) IN {TOKENS} UNION SELECT n."column", value FROM n JOIN e ON e."column" = n."column" WHERE (x = lo OR x = hi) AND regexp_full_match(abs(x)::BIGINT::VARCHAR, '9{{4,}}'))"""


@query("pr_16_placeholder_candidates", f"WITH $F, {CANDIDATES} SELECT * FROM k")
def _(s, d):
    return pr.placeholder_candidates(frequencies(s, d))


@query("pr_17_merge_placeholders", f"""WITH $F, {CANDIDATES}, b AS (SELECT * FROM k UNION ALL SELECT "column", value FROM f WHERE value IN ('Altro', 'n.d.'))
SELECT "column", min(token) AS token FROM b WHERE "column" NOT IN ('mese', 'spesa', 'SPESA TOTALE', 'saldo', 'entrate', 'uscite', 'cod_ente') OR {number("token")} IS NULL GROUP BY "column", lower(trim(token))""")
def _(s, d):
    f = frequencies(s, d)
    given = f.where("value in ('Altro', 'n.d.')").select("column", F.col("value").alias("token"))
    return pr.merge_placeholders(pr.placeholder_candidates(f), given, {c: "float" for c in ("mese", "spesa", "SPESA TOTALE", "saldo", "entrate", "uscite", "cod_ente")})


#: Names of all columns and texts of the tables, as they would be column names: brands, types and part names.
NAMES = "nm AS (SELECT DISTINCT p_name AS \"column\", 0 AS position FROM part UNION SELECT DISTINCT p_type, 0 FROM part UNION SELECT DISTINCT p_brand, 0 FROM part)"
GOOD = r"regexp_full_match({}, '[a-z][a-z0-9_]*(_[A-Z]{{2,}})?')"


def names(s, d):
    p = table(s, d, "part")
    return p.select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("column")).distinct().withColumn("position", F.lit(0))


def suggestion(x: str) -> str:
    n = rf"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^0-9a-zA-Z]+', '_', 'g')), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"(CASE WHEN {n} = '' THEN 'col' WHEN regexp_matches({n}, '^[0-9]') THEN 'col_' || {n} ELSE {n} END)"


@query("sc_01_names", f'WITH {NAMES} SELECT "column", {GOOD.format(chr(34) + "column" + chr(34))} AS conforms FROM nm')
def _(s, d):
    return names(s, d).select("column", sc.conforms(F.col("column")).alias("conforms"))


@query("sc_02_suggest", f'WITH {NAMES} SELECT "column", {suggestion(chr(34) + "column" + chr(34))} AS suggestion FROM nm')
def _(s, d):
    return names(s, d).select("column", sc.normal_name(F.col("column")).alias("suggestion"))


@query("sc_03_uniquify", f"""WITH nm AS (SELECT p_partkey AS position, p_brand AS "column" FROM part), b AS (SELECT *, {suggestion(chr(34) + "column" + chr(34))} AS base FROM nm), w AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY position) AS n FROM b)
SELECT "column", position, CASE WHEN n > 1 THEN base || '_' || n ELSE base END AS suggestion FROM w""")
def _(s, d):
    return sc.validate_names(table(s, d, "part").select(F.col("p_partkey").alias("position"), F.col("p_brand").alias("column")))


@query("sc_04_naming_violations", """WITH $D, n AS (SELECT unnest(['_id', 'SPESA TOTALE', 'aggregation-time']) AS "column", unnest(['id', 'spesa_totale', 'aggregation_time']) AS s) SELECT """ + violation("-1", '"column"', "'column name: ' || s", "schema") + " FROM n WHERE EXISTS (SELECT 1 FROM d)")
def _(s, d):
    return sc.naming_violations(sc.names_frame(dirty(s, d), ROW))


@query("sc_05_sparse_violations", f"WITH $D, {RATES} SELECT {violation('-1', 'NULL::VARCHAR', chr(39) + 'sparse column' + chr(39), 'schema', 'nulls')} FROM r WHERE nulls >= 0.9 * total")
def _(s, d):
    return sc.sparse_violations(dirty(s, d), ROW)


@query("sc_06_cast_violations", 'WITH $D, v AS (' + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", row_id, {quoted(c)} AS value, '{t}' AS t, {number(quoted(c))} AS x FROM d" for c, t in TYPES.items() if t != "datetime") + f") SELECT {violation('row_id', 'value', chr(39) + 'not coercible to ' + chr(39) + ' || t', 'schema')} FROM v WHERE value IS NOT NULL AND (x IS NULL OR (t = 'integer' AND x <> floor(x)))")
def _(s, d):
    return sc.cast_violations(dirty(s, d), ROW, {c: t for c, t in TYPES.items() if t != "datetime"})


@query("sc_07_nullability", f"WITH $D, {RATES} SELECT {violation('-1', 'NULL::VARCHAR', chr(39) + 'not nullable' + chr(39), 'schema', 'nulls')} FROM r WHERE nulls > 0 AND \"column\" IN ('cod_ente', 'ente', 'stato')")
def _(s, d):
    return sc.nullability_violations(dirty(s, d), ROW, ["cod_ente", "ente", "stato"])


@query("sc_08_structural_defects", r"""WITH $D, e AS (SELECT * FROM (VALUES ('_id', 'naming'), ('SPESA TOTALE', 'naming'), ('aggregation-time', 'naming')) t("column", defects) UNION ALL
SELECT 'mese', 'untyped' FROM d HAVING count(*) FILTER (NOT regexp_full_match(mese, '\d+')) > 0 UNION ALL SELECT 'note', 'sparse' FROM d HAVING count(note) <= 0.1 * count(*) UNION ALL
SELECT 'entrate_bis', 'redundant' FROM d HAVING count(*) FILTER (entrate <> entrate) = 0) SELECT "column", defects FROM e""")
def _(s, d):
    x = dirty(s, d).withColumn("entrate_bis", F.col("entrate"))
    return sc.structural_defects(x, ROW, {"mese": "integer", "uscite": "integer"})


@query("sc_09_redundant_columns", "WITH $D SELECT 'copia' AS \"column\", 'stato' AS same_as FROM d HAVING count(*) > 0")
def _(s, d):
    return sc.redundant_columns(dirty(s, d).withColumn("copia", F.col("stato")), ROW)


@query("sc_10_canonical_match", """WITH n AS (SELECT DISTINCT upper(n_name) AS "column", n_name FROM nation), c AS (SELECT n_nationkey AS id, n_name AS name, lower(replace(n_name, ' ', '_')) AS bare FROM nation),
b AS (SELECT "column", regexp_replace(lower("column"), '[^a-z0-9]+', '_', 'g') AS bare FROM n) SELECT b."column", CASE WHEN e.id IS NOT NULL THEN e.id ELSE c.id END::BIGINT AS canonical_id, CASE WHEN e.id IS NOT NULL THEN 'exact' ELSE 'bare' END AS how FROM b LEFT JOIN c e ON e.name = b."column" JOIN c ON regexp_replace(c.bare, '[^a-z0-9]+', '_', 'g') = b.bare""")
def _(s, d):
    n = table(s, d, "nation")
    cat = n.select(F.col("n_nationkey").cast("long").alias("canonical_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("alias"))
    return sc.canonical_match(n.select(F.upper("n_name").alias("column")).distinct(), cat)


@query("sc_10_fuzzy_match", """WITH p AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT substr(name, 1, length(name) - 1) || 'z' AS "column" FROM p UNION SELECT 'q' || substr(name, 2) FROM p),
b AS (SELECT "column", regexp_replace(regexp_replace(lower("column"), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS bare FROM q), c AS (SELECT name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS c_bare FROM p),
m AS (SELECT "column", name, 1 - levenshtein(bare, c_bare) / greatest(length(bare), length(c_bare)) AS s FROM b, c WHERE 1 - levenshtein(bare, c_bare) / greatest(length(bare), length(c_bare)) >= 0.85),
w AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY s DESC, name) AS n FROM m) SELECT "column", name AS canonical_id, 'fuzzy' AS how FROM w WHERE n = 1 AND "column" NOT IN (SELECT name FROM p)""")
def _(s, d):
    """Names with another last letter, and with another first one."""
    p = table(s, d, "part").select(F.col("p_name").alias("name")).distinct()
    cat = p.select(F.col("name").alias("canonical_id"), "name", F.lit(None).cast("string").alias("alias"))
    q = p.select(F.explode(F.array(F.concat(F.expr("substr(name, 1, length(name) - 1)"), F.lit("z")), F.concat(F.lit("q"), F.expr("substr(name, 2)")))).alias("column")).distinct()
    return sc.canonical_match(q, cat).where("how = 'fuzzy'")


@query("sc_11_top_k", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label, [(vec_id % 7)::VARCHAR, (vec_id % 11 + 100)::VARCHAR, (label + 1000)::VARCHAR] AS smp FROM embeddings),
p AS (SELECT q.vec_id AS query, c.vec_id AS entry, list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))) + 0.3 * (len(list_intersect(q.smp, c.smp)) / 3) + CASE WHEN q.label = c.label THEN 0.1 ELSE 0.0 END AS raw FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY raw DESC, entry) AS rank FROM p) SELECT query, rank::INT AS rank, entry, round(raw, 3) AS score FROM w WHERE rank <= 5""")
def _(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.expr("array(cast(vec_id % 7 as string), cast(vec_id % 11 + 100 as string), cast(label + 1000 as string))").alias("samples"), text(col("label")).alias("dtype"))
    return sc.retrieve_top_k(e.where("id % 20 = 0"), e)


@query("sc_12_domain", """WITH c AS (SELECT DISTINCT p_brand AS domain, p_type AS dataset, p_name AS column_name FROM part), n AS (SELECT DISTINCT p_name AS column_name FROM part WHERE p_size > 25), g AS (SELECT domain, dataset, count(DISTINCT c.column_name) AS matched FROM c JOIN n ON n.column_name = c.column_name GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY matched DESC, domain, dataset)::INT AS rank FROM g""")
def _(s, d):
    p = table(s, d, "part")
    return sc.detect_domain(p.where("p_size > 25").select(F.col("p_name").alias("column")).distinct(), p.select(F.col("p_brand").alias("domain"), F.col("p_type").alias("dataset"), F.col("p_name").alias("column_name")).distinct())


@query("sc_14_naming_flags", f"""WITH {NAMES}, x AS (SELECT "column", list_filter([CASE WHEN regexp_matches("column", '^[0-9]') THEN 'leading_digit' END, CASE WHEN contains("column", ' ') THEN 'embedded_space' END, CASE WHEN regexp_matches("column", '[^0-9a-zA-Z_ ]') THEN 'special_char' END, CASE WHEN "column" <> lower("column") THEN 'not_snake_lower' END], lambda v: v IS NOT NULL) AS l FROM nm)
SELECT "column", array_to_string(l, ',') AS flags FROM x WHERE len(l) > 0""")
def _(s, d):
    return sc.naming_flags(names(s, d))


BAD = {
    "rata": (r"NOT regexp_full_match(rata, '\d{6}')", r"\d{6}"), "stato": ("stato NOT IN ('F', 'O', 'P')", "F|O|P"), "mese": (f"NOT coalesce({number('mese')} BETWEEN 1 AND 12, false)", "1..12"), "spesa": (f"NOT coalesce({number('spesa')} >= 0, false)", "0..None"),
    "aggregation-time": (r"""CASE WHEN regexp_full_match("aggregation-time", '\d{4}-\d{1,2}-\d{1,2}') THEN try_strptime("aggregation-time", '%Y-%m-%d') END IS NULL""", "%Y-%m-%d"), "cod_ente": (r"NOT regexp_full_match(cod_ente, '\d{1,2}')", r"\d{1,2}"),
}


def bad_rows(columns=tuple(BAD)) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", row_id, {quoted(c)} AS value, '{BAD[c][1]}' AS said FROM d WHERE {quoted(c)} IS NOT NULL AND {BAD[c][0]}" for c in columns)


FORMAT = violation("row_id", "value", "said", "format")
for _n, _c in (("fv_01_regex", "rata"), ("fv_02_enum", "stato"), ("fv_03_range", "mese"), ("fv_04_date", "aggregation-time")):
    query(_n, f"WITH $D, b AS ({bad_rows((_c,))}) SELECT {FORMAT} FROM b")(lambda s, d, c=_c: fv.validate(dirty(s, d), ROW, {c: SPECS[c]}))


@query("fv_02_enum_table", """SELECT 'l_partkey' AS column_name, l_orderkey * 8 + l_linenumber AS row_id, l_partkey::VARCHAR AS value, 'not in table' AS expected_pattern, 'format' AS kind, 1::BIGINT AS affected_rows FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)""")
def _(s, d):
    allowed = table(s, d, "part").where("p_size > 2").select(text(col("p_partkey")).alias("value"))
    return fv.outside_large_set(table(s, d, "lineitem").withColumn("row_id", F.expr("l_orderkey * 8 + l_linenumber")), "row_id", "l_partkey", allowed)


@query("fv_05_violations", f"WITH $D, b AS ({bad_rows()}) SELECT {FORMAT} FROM b")
def _(s, d):
    return fv.validate(dirty(s, d), ROW, SPECS)


@query("fv_06_not_yet_reported", f"WITH $D, b AS ({bad_rows()}) SELECT {FORMAT} FROM b WHERE \"column\" <> 'rata' AND NOT (\"column\" = 'mese' AND row_id % 4 = 0)")
def _(s, d):
    v = fv.validate(dirty(s, d), ROW, SPECS)
    return fv.not_yet_reported(v, v.where("column_name = 'rata' or (column_name = 'mese' and row_id % 4 = 0)"))


@query("fv_07_offenders", f"WITH $D, b AS ({bad_rows()}), u AS (SELECT DISTINCT \"column\" AS column_name, value FROM b), w AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value)::INT AS rank FROM u) SELECT * FROM w WHERE rank <= 100")
def _(s, d):
    return fv.offenders(fv.validate(dirty(s, d), ROW, SPECS))


@query("fv_07_valid_sample", r"""WITH $F, v AS (SELECT "column", value, cnt FROM f WHERE ("column" = 'rata' AND regexp_full_match(value, '\d{6}')) OR ("column" = 'stato' AND value IN ('F', 'O', 'P'))), w AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value)::INT AS rank FROM v) SELECT * FROM w WHERE rank <= 10""")
def _(s, d):
    return fv.valid_sample(frequencies(s, d), {c: SPECS[c] for c in ("rata", "stato")})


@query("fv_08_safe_corrections", """WITH $F, k AS (SELECT DISTINCT "column", value AS old, CASE WHEN value LIKE 'Rata%' THEN '?' END AS new FROM f WHERE value = 'N.D.' OR value = 'P' OR value LIKE 'Rata%'), p AS (SELECT "column", sum(cnt) AS n FROM f WHERE value IS NOT NULL GROUP BY 1),
t AS (SELECT k."column", sum(cnt) AS touched FROM k JOIN f ON f."column" = k."column" AND f.value = k.old WHERE k.new IS NULL GROUP BY 1) SELECT k.* FROM k WHERE new IS NOT NULL OR "column" NOT IN (SELECT t."column" FROM t JOIN p ON p."column" = t."column" WHERE touched > 0.02 * n)""")
def _(s, d):
    f = frequencies(s, d)
    k = f.where("value = 'N.D.' or value = 'P' or value like 'Rata%'").select("column", F.col("value").alias("old"), F.when(F.col("value").like("Rata%"), "?").alias("new"))
    return fv.safe_corrections(f, k)


@query("fv_09_drift", """WITH $F, m AS (SELECT "column", regexp_replace(regexp_replace(value, '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') AS mask, sum(cnt) AS cnt FROM f WHERE value IS NOT NULL GROUP BY ALL), t AS (SELECT "column", max(cnt) AS top, sum(cnt) AS n, count(*) AS k FROM m GROUP BY 1)
SELECT "column", round(top / n, 4) AS dominant_share, (n - top)::BIGINT AS offending FROM t WHERE k > 1 AND top >= 0.5 * n AND n - top < 0.2 * n""")
def _(s, d):
    return fv.drift(frequencies(s, d))


@query("fv_10_dtype_census", f"""WITH $F, n AS (SELECT "column", value, cnt, {number("value")} AS x FROM f WHERE value IS NOT NULL), t AS (SELECT "column", coalesce(sum(cnt) FILTER (x IS NOT NULL), 0) / sum(cnt) AS rate FROM n GROUP BY 1)
SELECT "column", CASE WHEN rate >= 1 THEN 'text holding only numbers' ELSE 'numbers with malformed values' END AS verdict, round(rate, 4) AS numeric_rate FROM t WHERE rate > 0.5 AND "column" NOT IN ('entrate', 'uscite', 'saldo')""")
def _(s, d):
    return fv.dtype_census(frequencies(s, d), dict(dirty(s, d).dtypes))


