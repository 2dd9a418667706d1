"""Queries on rules between columns, duplicates and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import col
from ..operators import anomalies as an
from ..operators import duplicates as du
from ..operators import pair_statistics as ps
from ..operators import profile as pr
from ..operators import repair as rm
from ..operators import rules as cs
from ..operators.completeness import fill_rates
from ..sources.dirty import COLUMNS, ROW
from .profile_queries import RATES, violation
from .registry import dirty, frequencies, number, query, quoted, table, union

PAIRS = [("cod_ente", "ente"), ("rata", "anno"), ("rata", "mese"), ("stato", "mese"), ("anno", "mese"), ("ente", "cod_ente")]
PROFILE = 'p AS (SELECT "column", coalesce(sum(cnt) FILTER (value IS NOT NULL), 0) AS populated, count(value) AS nd FROM f GROUP BY 1)'
USABLE = f'{PROFILE}, us AS (SELECT "column", nd / populated AS ratio FROM p WHERE populated > 0 AND nd <= 0.2 * populated)'


def cells(pairs) -> str:
    return " UNION ALL ".join(f"SELECT '{p}' AS predictor, '{t}' AS target, {i} AS ord, row_id, CAST({quoted(p)} AS VARCHAR) AS key, CAST({quoted(t)} AS VARCHAR) AS value FROM d WHERE {quoted(p)} IS NOT NULL AND {quoted(t)} IS NOT NULL" for i, (p, t) in enumerate(pairs))


def tops(pairs) -> str:
    return (f"ce AS ({cells(pairs)}), pc AS (SELECT predictor, target, key, value, count(*) AS cnt FROM ce GROUP BY ALL), "
            "rk AS (SELECT *, row_number() OVER (PARTITION BY predictor, target, key ORDER BY cnt DESC, value) AS n, sum(cnt) OVER (PARTITION BY predictor, target, key) AS size FROM pc), "
            "dm AS (SELECT predictor, target, key, value AS top, cnt AS top_cnt, size FROM rk WHERE n = 1)")


DEPENDENCIES = tops(PAIRS) + ", dp AS (SELECT predictor, target, sum(top_cnt) / sum(size) AS p, count(*) FILTER (size >= 2) AS groups FROM dm GROUP BY 1, 2), gd AS (SELECT * FROM dp WHERE groups >= 3 AND p >= 0.9 AND p < 1)"


@query("cs_01_usable", f'WITH $F, {USABLE} SELECT "column", ratio, "column" <> \'stato\' AS as_target FROM us')
def _(s, d):
    return cs.usable(pr.column_profile(frequencies(s, d)), ["stato"])


@query("cs_02_predictors", f"""WITH $F, {USABLE}, x AS (SELECT t."column" AS target, p."column" AS predictor, row_number() OVER (PARTITION BY t."column" ORDER BY abs(p.ratio - t.ratio), p."column") AS n FROM us t JOIN us p ON p."column" <> t."column"),
y AS (SELECT target, predictor, n + 1000 AS n FROM x WHERE n <= 8 UNION ALL SELECT 'ente', 'stato', 0), z AS (SELECT target, predictor, min(n) AS n FROM y GROUP BY 1, 2) SELECT target, predictor, row_number() OVER (PARTITION BY target ORDER BY n, predictor)::INT AS rank FROM z""")
def _(s, d):
    return cs.candidate_predictors(cs.usable(pr.column_profile(frequencies(s, d))), {"ente": ["stato"]})


@query("cs_03_dependencies", f"WITH $D, {DEPENDENCIES} SELECT predictor, target, round(p, 4) AS purity, groups FROM gd")
def _(s, d):
    return cs.dependencies(cs.pair_counts(dirty(s, d), PAIRS))


@query("cs_03_part_dependency", """WITH e AS (SELECT p_size::VARCHAR AS k, CASE WHEN p_partkey % 20 = 0 THEN 'other' ELSE 'size ' || p_size END AS v FROM part), g AS (SELECT k, v, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT k, max(n) AS top, sum(n) AS size FROM g GROUP BY 1), x AS (SELECT sum(top) / sum(size) AS p, count(*) FILTER (size >= 2) AS groups FROM t)
SELECT 'p_size' AS predictor, 'label' AS target, round(p, 4) AS purity, groups FROM x WHERE groups >= 3 AND p >= 0.9 AND p < 1""")
def _(s, d):
    """Sizes and their labels, of which one in twenty is another."""
    x = table(s, d, "part").withColumn("label", F.when(F.col("p_partkey") % 20 == 0, "other").otherwise(F.concat(F.lit("size "), "p_size")))
    return cs.dependencies(cs.pair_counts(x, [("p_size", "label")]))


@query("cs_04_dependency_violations", f"""WITH $D, {DEPENDENCIES}, b AS (SELECT ce.*, dm.top FROM ce JOIN gd ON gd.predictor = ce.predictor AND gd.target = ce.target JOIN dm ON dm.predictor = ce.predictor AND dm.target = ce.target AND dm.key = ce.key WHERE dm.size >= 2 AND ce.value <> dm.top),
o AS (SELECT *, row_number() OVER (PARTITION BY target, row_id ORDER BY ord) AS n FROM b)
SELECT target AS column_name, row_id, value, 'cross-column: ' || predictor || '=''' || key || ''' implies ' || target || '=''' || top || '''' AS expected_pattern, 'consistency' AS kind, 1::BIGINT AS affected_rows FROM o WHERE n = 1""")
def _(s, d):
    return cs.dependency_violations(dirty(s, d), ROW, PAIRS)


def stability_sql(k: str, t: str, clock: str) -> str:
    return f"""r AS (SELECT CAST({k} AS VARCHAR) AS k, CAST({t} AS VARCHAR) AS t, {clock} AS c FROM d WHERE {k} IS NOT NULL AND {t} IS NOT NULL AND {clock} IS NOT NULL), n AS (SELECT k, c, t, count(*) AS cnt FROM r GROUP BY ALL),
e AS (SELECT k, min(c) AS a, max(c) AS z FROM n GROUP BY 1 HAVING min(c) < max(c)), w AS (SELECT n.*, e.a, row_number() OVER (PARTITION BY n.k, n.c ORDER BY cnt DESC, t) AS rn, sum(cnt) OVER (PARTITION BY n.k, n.c) AS size FROM n JOIN e ON e.k = n.k AND n.c IN (e.a, e.z)),
b AS (SELECT k, max(CASE WHEN c = a THEN t END) AS x, max(CASE WHEN c <> a THEN t END) AS y FROM w WHERE rn = 1 AND size >= 3 GROUP BY 1) SELECT coalesce(bool_and(x = y), true) AS stable FROM b WHERE x IS NOT NULL AND y IS NOT NULL"""


@query("cs_05_stability", "WITH $D, " + stability_sql("cod_ente", "ente", "CASE WHEN regexp_full_match(anno, '\\d{4}') THEN anno END"))
def _(s, d):
    return cs.temporal_stability(dirty(s, d), "cod_ente", "ente", F.when(col("anno").rlike(r"\A\d{4}\z"), col("anno")))


@query("cs_06_coherence", f"WITH $D, {tops(PAIRS)}, x AS (SELECT predictor, target, sum(top_cnt) / sum(size) AS p, sum(size) AS n FROM dm GROUP BY 1, 2) SELECT target, round(max(p), 4) AS coherence FROM x WHERE n >= 6 GROUP BY 1")
def _(s, d):
    return cs.coherence(cs.pair_counts(dirty(s, d), PAIRS))


NUM = ("entrate", "uscite", "saldo", "anno")


def identity_sql() -> str:
    names = [c for c in COLUMNS if c in NUM]
    x = "x AS (SELECT " + ", ".join(f"{number(c)} AS {c}" for c in names) + " FROM d)"
    parts = []
    for a in names:
        for b in names:
            for c in names:
                if len({a, b, c}) == 3:
                    for op in "-+":
                        if op == "-" or b < c:
                            e = f"({b} {op} {c})"
                            fam = "|".join(sorted((a, b, c)))
                            parts.append(f"SELECT '{a}' AS target, '{b}' AS \"left\", '{op}' AS operator, '{c}' AS \"right\", '{fam}' AS fam, {names.index(a)} AS pos, avg((abs({a} - {e}) <= 0.011 + 1e-9 * abs({e}))::INT) AS p, count(*) AS n, count(DISTINCT {a}) AS da, count(DISTINCT {e}) AS de, count(DISTINCT {b}) AS db, count(DISTINCT {c}) AS dc, avg((abs({b} - {c}) <= 0.011 + 1e-9 * abs({c}))::INT) AS same FROM x WHERE {a} + {e} IS NOT NULL")
    return x + ", t AS (" + " UNION ALL ".join(parts) + """), k AS (SELECT * FROM t WHERE n >= 30 AND p >= 0.9 AND da >= 5 AND de >= 5 AND db > 1 AND dc > 1 AND same <= 0.9),
    m AS (SELECT k.* FROM k WHERE operator = '-' OR NOT EXISTS (SELECT 1 FROM k o WHERE o.operator = '-' AND o.target = k.target AND o."left" = k."left" AND o."right" = k."right")),
    w AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY round(p, 4) DESC, pos DESC, "left", "right", operator) AS r FROM m) SELECT target, "left", operator, "right", round(p, 4) AS agreement FROM w WHERE r = 1"""


@query("cs_07_identities", f"WITH $D, {identity_sql()}")
def _(s, d):
    return cs.identities(dirty(s, d), [c for c in COLUMNS if c in NUM])


@query("cs_08_magnitudes", "WITH $D, m AS (" + union(lambda c, i: f"SELECT '{c}' AS \"column\", count({number(quoted(c))}) AS n, count(*) AS total FROM d") + ') SELECT "column" FROM m WHERE n >= 30 AND n >= 0.5 * total')
def _(s, d):
    x = dirty(s, d)
    return s.createDataFrame([(c,) for c in cs.magnitudes(x, ROW)], "column string")


@query("cs_09_identity_families", "SELECT 'l_disc' AS target, 'l_extendedprice' AS \"left\", '-' AS operator, 'l_net' AS \"right\", 1.0::DOUBLE AS agreement FROM lineitem HAVING count(*) > 0")
def _(s, d):
    x = table(s, d, "lineitem").withColumn("l_net", F.bround(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2))
    x = x.withColumn("l_disc", F.col("l_extendedprice") - F.col("l_net"))
    return cs.identities(x, ["l_extendedprice", "l_net", "l_disc"])


@query("cs_10_breaking_rows", f"WITH $D, x AS (SELECT 'saldo' AS \"column\", row_id, saldo::VARCHAR AS value FROM d WHERE abs(saldo - (entrate - uscite)) > 0.011) SELECT {violation('row_id', 'value', chr(39) + 'saldo = entrate - uscite' + chr(39), 'consistency')} FROM x")
def _(s, d):
    return cs.identity_violations(dirty(s, d), ROW, "saldo", "entrate", "-", "uscite")


PERIOD = r"regexp_full_match(trim(rata), '\d{4}(0[1-9]|1[0-2])')"
PARTS = {"year": "substr(trim(rata), 1, 4)::DOUBLE", "month": "substr(trim(rata), 5, 2)::DOUBLE"}


@query("cs_11_derivable", "WITH $D, t AS (" + " UNION ALL ".join(f"SELECT '{p}' AS part, {i} AS i, '{c}' AS \"column\", count(*) AS n, count(*) FILTER (coalesce({number(quoted(c))} = {PARTS[p]}, false)) AS m FROM d WHERE {PERIOD} AND {quoted(c)} IS NOT NULL" for p in PARTS for i, c in enumerate(["stato", "mese", "anno"])) + '), w AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY i) AS r FROM t WHERE n > 0 AND m >= 0.8 * n) SELECT part, "column", round(m / n, 4) AS agreement FROM w WHERE r = 1')
def _(s, d):
    return cs.derivable(dirty(s, d), "rata", ["stato", "mese", "anno"])


@query("cs_12_contested", "WITH $D, x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", row_id, {c} AS value, '{p} of rata' AS said FROM d WHERE {PERIOD} AND {number(c)} BETWEEN {lo} AND {hi} AND {number(c)} = floor({number(c)}) AND {number(c)} <> {PARTS[p]}" for p, c, lo, hi in (("year", "anno", 1900, 2100), ("month", "mese", 1, 12))) + f") SELECT {violation('row_id', 'value', 'said', 'consistency')} FROM x")
def _(s, d):
    return cs.contested(dirty(s, d), ROW, "rata", {"year": "anno", "month": "mese"})


HINT_PAIRS = [("cod_ente", "ente"), ("entrate", "ente"), ("entrate", "cod_ente")]


def hint_sql(pairs, pure: str) -> str:
    gaps = " UNION ALL ".join(f"SELECT '{p}' AS predictor, '{t}' AS target, CAST({quoted(p)} AS VARCHAR) AS key FROM d WHERE {quoted(t)} IS NULL" for p, t in pairs)
    return f"""{tops(pairs)}, pu AS (SELECT predictor, target, {pure} AS purity FROM dm GROUP BY 1, 2 HAVING {pure} >= 0.95), mp AS (SELECT dm.predictor, dm.target, dm.key, dm.top AS value FROM dm JOIN pu ON pu.predictor = dm.predictor AND pu.target = dm.target WHERE top_cnt >= 0.95 * size),
gp AS ({gaps}), cv AS (SELECT gp.predictor, gp.target, count(mp.value) / count(*) AS coverage FROM gp LEFT JOIN mp ON mp.predictor = gp.predictor AND mp.target = gp.target AND mp.key = gp.key GROUP BY 1, 2),
hn AS (SELECT pu.target, pu.predictor, false AS normalized, round(purity, 4) AS purity, round(coverage, 4) AS coverage FROM pu JOIN cv ON cv.predictor = pu.predictor AND cv.target = pu.target WHERE coverage >= 0.5)"""


CLEAN_ENTE = "d0 AS (SELECT * REPLACE (CASE WHEN ente = 'L99' THEN NULL ELSE upper(trim(ente)) END AS ente, CASE WHEN cod_ente <> 'N.D.' THEN cod_ente END AS cod_ente) FROM d)"


def clean_ente(s, d):
    return dirty(s, d).withColumn("ente", F.when(F.col("ente") != "L99", F.upper(F.trim("ente")))).withColumn("cod_ente", F.when(F.col("cod_ente") != "N.D.", F.col("cod_ente")))


def on_clean(sql: str) -> str:
    return sql.replace("FROM d WHERE", "FROM d0 WHERE")


@query("cs_13_single_hints", "WITH $D, " + CLEAN_ENTE + ", " + on_clean(hint_sql(HINT_PAIRS, "sum(top_cnt) / sum(size)")) + " SELECT * FROM hn")
def _(s, d):
    return ps.single_hints(clean_ente(s, d), HINT_PAIRS, False)[0]


@query("cs_13_mapping", "WITH $D, " + CLEAN_ENTE + ", " + on_clean(hint_sql(HINT_PAIRS, "sum(top_cnt) / sum(size)")) + " SELECT * FROM mp")
def _(s, d):
    return ps.single_hints(clean_ente(s, d), HINT_PAIRS, False)[1]


PAIRED = "d0 AS (SELECT *, CASE WHEN ente IS NOT NULL AND stato IS NOT NULL THEN ente || '|' || stato END AS \"ente|stato\" FROM (SELECT * REPLACE (CASE WHEN ente = 'L99' THEN NULL ELSE upper(trim(ente)) END AS ente, CASE WHEN cod_ente <> 'N.D.' THEN cod_ente END AS cod_ente) FROM d))"


@query("cs_14_pair_hints", "WITH $D, " + PAIRED + ", " + on_clean(hint_sql([("ente|stato", "cod_ente")], "count(*) FILTER (top_cnt = size) / count(*)")) + " SELECT * FROM hn")
def _(s, d):
    return ps.pair_hints(clean_ente(s, d), [("ente", "stato", "cod_ente")])[0]


@query("cs_15_chosen_hints", "WITH $D, " + CLEAN_ENTE + ", " + on_clean(hint_sql(HINT_PAIRS, "sum(top_cnt) / sum(size)")) + ", w AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY purity DESC, coverage DESC, normalized, predictor) AS n FROM hn) SELECT target, predictor, normalized, purity, coverage, CASE WHEN purity = 1 THEN 'strict' ELSE 'dominant' END AS confidence FROM w WHERE n = 1")
def _(s, d):
    x = clean_ente(s, d)
    return cs.choose_hints(ps.single_hints(x, HINT_PAIRS, False)[0].unionByName(ps.single_hints(x, HINT_PAIRS, True)[0]))


def in_two_batches(x, pairs, temporal=()):
    """The statistics of even rows, then those of odd ones added."""
    out = ps.PairStatistics(x.sparkSession, pairs, temporal)
    return out.add(x.where("row_id % 2 = 0"), "even").add(x.where("row_id % 2 = 1"), "odd").add(x.where("row_id % 2 = 1"), "odd")


@query("cs_03_added_batches", f"WITH $D, {DEPENDENCIES} SELECT predictor, target, round(p, 4) AS purity, groups FROM gd")
def _(s, d):
    return in_two_batches(dirty(s, d), PAIRS).dependencies()


@query("cs_06_added_batches", f"WITH $D, {tops(PAIRS)}, x AS (SELECT predictor, target, sum(top_cnt) / sum(size) AS p, sum(size) AS n FROM dm GROUP BY 1, 2) SELECT target, round(max(p), 4) AS coherence FROM x WHERE n >= 6 GROUP BY 1")
def _(s, d):
    return in_two_batches(dirty(s, d), PAIRS).coherence()


@query("cs_13_added_batches", "WITH $D, " + CLEAN_ENTE + ", " + on_clean(hint_sql(HINT_PAIRS, "sum(top_cnt) / sum(size)")) + " SELECT * FROM hn")
def _(s, d):
    return in_two_batches(clean_ente(s, d), HINT_PAIRS).hints()[0]


#: Orders with a moment, its quarter, and the quarter with the status, of which some rows lack the latter two.
MOMENTS = """d AS (SELECT o_orderkey AS row_id, o_orderdate::TIMESTAMP + to_hours((o_orderkey % 24)::INT) AS moment, o_orderstatus AS status, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q,
CASE WHEN o_orderkey % 17 <> 0 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) END AS quarter, CASE WHEN o_orderkey % 19 <> 0 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) || o_orderstatus END AS labelled FROM orders)"""


def moments(s, d):
    o = table(s, d, "orders")
    q = F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate"))
    at = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return o.select(F.col("o_orderkey").alias("row_id"), at.alias("moment"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 17 != 0, q).alias("quarter"), F.when(F.col("o_orderkey") % 19 != 0, F.concat(q, "o_orderstatus")).alias("labelled"))


def by_month_sql(key: str, predictor: str, target: str, purity: str) -> str:
    return f"""WITH {MOMENTS}, g AS (SELECT {key} AS key, {target} AS value, count(*) AS n FROM d GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS r, sum(n) OVER (PARTITION BY key) AS size FROM g WHERE value IS NOT NULL AND key IS NOT NULL), m AS (SELECT key, value, n AS top_cnt, size FROM w WHERE r = 1),
p AS (SELECT {purity} AS purity FROM m), c AS (SELECT sum(CASE WHEN m.top_cnt >= 0.95 * m.size THEN g.n ELSE 0 END) / sum(g.n) AS coverage FROM g LEFT JOIN m USING (key) WHERE g.value IS NULL)
SELECT '{target}' AS target, '{predictor}' AS predictor, false AS normalized, round(purity, 4) AS purity, round(coverage, 4) AS coverage FROM p, c WHERE purity >= 0.95 AND coverage >= 0.5"""


@query("cs_13_months_of_moments", by_month_sql("strftime(moment, '%Y-%m')", "moment", "quarter", "sum(top_cnt) / sum(size)"))
def _(s, d):
    return ps.single_hints(moments(s, d), [("moment", "quarter")], False, {"moment"})[0]


@query("cs_14_months_of_moments", by_month_sql("strftime(moment, '%Y-%m') || '|' || status", "moment|status", "labelled", "count(*) FILTER (top_cnt = size) / count(*)"))
def _(s, d):
    return ps.pair_hints(moments(s, d), [("moment", "status", "labelled")], {"moment"})[0]


@query("rm_10_months_of_moments", f"WITH {MOMENTS} SELECT row_id, coalesce(quarter, q) AS quarter FROM d")
def _(s, d):
    x = moments(s, d)
    return rm.impute(x, "quarter", "moment", ps.single_hints(x, [("moment", "quarter")], False, {"moment"})[1], temporal={"moment"}).select("row_id", "quarter")


RULES = f"""{DEPENDENCIES}, b AS (SELECT ce.predictor, ce.target, ce.row_id, ce.ord FROM ce JOIN gd ON gd.predictor = ce.predictor AND gd.target = ce.target JOIN dm ON dm.predictor = ce.predictor AND dm.target = ce.target AND dm.key = ce.key WHERE dm.size >= 2 AND ce.value <> dm.top),
o AS (SELECT *, row_number() OVER (PARTITION BY target, row_id ORDER BY ord) AS n FROM b), rc AS (SELECT predictor || ' determines ' || target AS rule, count(*) AS rows FROM o WHERE n = 1 GROUP BY 1 UNION ALL SELECT 'saldo = entrate - uscite', count(*) FROM d WHERE abs(saldo - (entrate - uscite)) > 0.011)"""


def consistency(s, d):
    x = dirty(s, d)
    return cs.dependency_violations(x, ROW, PAIRS).unionByName(cs.identity_violations(x, ROW, "saldo", "entrate", "-", "uscite"))


@query("cs_16_rule_counts", f"WITH $D, {RULES} SELECT * FROM rc")
def _(s, d):
    return cs.rule_counts(consistency(s, d))


@query("cs_17_ambiguous_codes", "WITH g AS (SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1) SELECT count(*) AS codes, count(*) FILTER (n > 1) AS ambiguous FROM g")
def _(s, d):
    return cs.ambiguous_codes(table(s, d, "part"), "p_name", "p_brand")


@query("cs_18_reconcile", f"WITH $D, x AS (SELECT *, {number('rata')} AS p, {number('anno')} AS y, {number('mese')} AS m FROM d) SELECT count(p + y + m) AS checked, count(*) FILTER (p <> y * 100 + m) AS mismatches, count(*) FILTER (rata IS NOT NULL AND p IS NULL) AS unreadable_period, count(*) FILTER (anno IS NOT NULL AND y IS NULL) AS unreadable_year, count(*) FILTER (mese IS NOT NULL AND m IS NULL) AS unreadable_month, count(*) FILTER (saldo < 0) AS negative FROM x")
def _(s, d):
    return cs.reconcile_period(dirty(s, d), "rata", "anno", "mese", "saldo")


ALL = ", ".join(quoted(c) for c in COLUMNS)


@query("du_01_exact", f"WITH $D, g AS (SELECT count(*) AS n FROM d GROUP BY {ALL}) SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates FROM g")
def _(s, d):
    return du.exact_duplicates(dirty(s, d), ROW)


@query("du_02_keys", f'WITH $F, {PROFILE} SELECT "column", round(nd / populated, 4) AS uniqueness FROM p WHERE populated > 0 AND nd >= 0.95 * populated ORDER BY nd / populated DESC, "column" LIMIT 2')
def _(s, d):
    return du.key_columns(pr.column_profile(frequencies(s, d)))


OTHERS = ", ".join(quoted(c) for c in COLUMNS if c != "_id")
KEYED = f'v AS (SELECT "_id" AS key, count(*) AS n, min(row_id) AS first FROM d GROUP BY "_id", {OTHERS}), g AS (SELECT key, sum(n) AS rows, count(*) AS versions, min(first) AS first FROM v GROUP BY 1)'


@query("du_03_collisions", f"WITH $D, {KEYED} SELECT count(*) AS duplicated_keys, coalesce(sum(rows), 0)::BIGINT AS affected_rows, count(*) FILTER (versions > 1) AS conflicting_keys, coalesce(sum(rows) FILTER (versions > 1), 0)::BIGINT AS rows_in_conflict FROM g WHERE rows > 1")
def _(s, d):
    return du.key_collisions(dirty(s, d), ROW, "_id")


@query("du_04_collision_violations", f"WITH $D, {KEYED} SELECT '_id' AS column_name, first AS row_id, key AS value, 'unique _id' AS expected_pattern, 'uniqueness' AS kind, rows::BIGINT AS affected_rows FROM g WHERE versions > 1")
def _(s, d):
    return du.collision_violations(dirty(s, d), ROW, "_id")


@query("du_05_drop_exact", f"WITH $D SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {ALL} ORDER BY row_id) AS n FROM d) WHERE n = 1")
def _(s, d):
    return du.drop_duplicate_rows(dirty(s, d), ROW)


@query("du_05_documents", "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def _(s, d):
    return du.drop_duplicate_rows(table(s, d, "documents"), "doc_id", ["text"]).select("doc_id", "lang", "source")


@query("du_06_drop_subset", 'WITH $D SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY "_id", stato ORDER BY row_id) AS n FROM d) WHERE n = 1')
def _(s, d):
    return du.drop_duplicate_rows(dirty(s, d), ROW, ["_id", "stato"])


def alike_sql(pairs) -> str:
    return "a AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER ({quoted(a)} IS NOT NULL AND {quoted(b)} IS NOT NULL) AS n, count(*) FILTER (lower(trim(CAST({quoted(a)} AS VARCHAR))) = lower(trim(CAST({quoted(b)} AS VARCHAR)))) AS t, count({number(quoted(a))} + {number(quoted(b))}) AS c, count(*) FILTER (abs({number(quoted(a))} - {number(quoted(b))}) <= 0.011 + 1e-9 * abs({number(quoted(b))})) AS e FROM d" for a, b in pairs) + \
        "), sm AS (SELECT \"left\", \"right\", round(t / n, 4) AS text_share, round(CASE WHEN c > 0 THEN e / n ELSE 0.0 END, 4) AS numeric_share FROM a WHERE n > 0), si AS (SELECT *, greatest(text_share, numeric_share) AS similarity FROM sm)"


EVERY = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1:]]


@query("du_07_similarity", f"WITH $D, {alike_sql(EVERY)} SELECT * FROM si")
def _(s, d):
    x = dirty(s, d)
    return du.similarity(x, du.all_pairs(x, ROW))


GROUPS = f"""{alike_sql(EVERY)}, ed AS (SELECT "left" AS a, "right" AS b FROM si WHERE similarity >= 0.8 UNION SELECT "right", "left" FROM si WHERE similarity >= 0.8), rc AS (SELECT a AS node, a AS reached FROM ed UNION SELECT rc.node, ed.b FROM rc JOIN ed ON ed.a = rc.reached), gr AS (SELECT node AS "column", min(reached) AS "group" FROM rc GROUP BY 1)"""


def groups(s, d):
    x = dirty(s, d)
    return du.column_groups(du.similarity(x, du.all_pairs(x, ROW)))


@query("du_08_groups", f"WITH RECURSIVE $D, {GROUPS} SELECT * FROM gr")
def _(s, d):
    return groups(s, d)


SURVIVOR_PAIRS = [("stato", "spesa"), ("stato", "SPESA TOTALE")]


@query("du_09_survivor", f"""WITH RECURSIVE $D, {GROUPS}, {tops(SURVIVOR_PAIRS)}, co AS (SELECT target, round(sum(top_cnt) / sum(size), 4) AS coherence FROM dm GROUP BY 1), {RATES}, m AS (SELECT gr.*, r.nulls, r.position, coalesce(co.coherence, -1) AS co FROM gr JOIN r ON r."column" = gr."column" LEFT JOIN co ON co.target = gr."column"),
w AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY co DESC, nulls, position) AS n FROM m) SELECT "group", "column" AS survivor FROM w WHERE n = 1""")
def _(s, d):
    x = dirty(s, d)
    return du.elect_survivors(groups(s, d), cs.coherence(cs.pair_counts(x, SURVIVOR_PAIRS)), fill_rates(x, ROW))


@query("du_10_canonical_name", f"""WITH RECURSIVE $D, {GROUPS}, m AS (SELECT "group", count(*) FILTER (regexp_full_match("column", '[a-z][a-z0-9_]*')) AS n, max("column") FILTER (regexp_full_match("column", '[a-z][a-z0-9_]*')) AS only_one, min("column") AS first FROM gr GROUP BY 1) SELECT "group", CASE WHEN n = 1 THEN only_one ELSE lower(first) END AS name FROM m""")
def _(s, d):
    return du.elect_names(groups(s, d), fill_rates(dirty(s, d), ROW))


@query("du_11_collapse", 'WITH $D SELECT * EXCLUDE ("SPESA TOTALE") REPLACE (coalesce(spesa, "SPESA TOTALE") AS spesa) FROM d')
def _(s, d):
    return du.collapse(dirty(s, d), "spesa", ["SPESA TOTALE"], "spesa")


@query("du_12_divergence", """WITH $D, n AS (SELECT count(*) FILTER (spesa <> "SPESA TOTALE") AS differing FROM d), l AS (SELECT DISTINCT "SPESA TOTALE" AS v FROM d WHERE "SPESA TOTALE" IS NOT NULL AND "SPESA TOTALE" NOT IN (SELECT spesa FROM d WHERE spesa IS NOT NULL) ORDER BY v LIMIT 10) SELECT differing, (SELECT string_agg(v, '|' ORDER BY v) FROM l) AS only_in_sibling FROM n""")
def _(s, d):
    return du.divergence(dirty(s, d), "spesa", "SPESA TOTALE")


@query("du_13_divergence_violations", f"""WITH $D, n AS (SELECT 'spesa' AS "column", count(*) FILTER (spesa <> "SPESA TOTALE") AS k FROM d HAVING count(*) FILTER (spesa <> "SPESA TOTALE") > 0.01 * count(*)) SELECT {violation('-1', 'NULL::VARCHAR', chr(39) + 'duplicate column diverges' + chr(39), 'schema', 'k')} FROM n""")
def _(s, d):
    return du.divergence_violations(dirty(s, d), "spesa", ["SPESA TOTALE"])


def census_sql() -> str:
    norm = lambda c: f"coalesce(lower(trim(CAST({quoted(c)} AS VARCHAR))), '')"
    return "a AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER ({norm(a)} = {norm(b)}) / count(*) AS t, CASE WHEN count({number(quoted(a))} + {number(quoted(b))}) > 0 THEN count(*) FILTER (abs({number(quoted(a))} - {number(quoted(b))}) <= 1e-8 + 1e-5 * abs({number(quoted(b))})) / count({number(quoted(a))} + {number(quoted(b))}) END AS e FROM d" for a, b in EVERY) + ")"


@query("du_14_census_pairs", f'WITH $D, {census_sql()} SELECT "left", "right", round(t, 4) AS text_share, round(e, 4) AS numeric_share FROM a WHERE greatest(t, e) >= 0.9')
def _(s, d):
    return du.census_pairs(dirty(s, d), ROW)


@query("du_15_row_census", f'WITH $D SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT {ALL} FROM d)) AS exact, (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT {OTHERS} FROM d)) AS exact_without_key, (SELECT count("_id") - count(DISTINCT "_id") FROM d) AS repeated_keys')
def _(s, d):
    return du.row_census(dirty(s, d), ROW, "_id")


MEASURES = ["l_extendedprice", "l_quantity", "l_discount"]
FENCES = "x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {{row}} AS row_id, {c} AS v FROM {{t}}" for c in MEASURES) + "), q AS (SELECT \"column\", count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS least, max(v) AS greatest FROM x GROUP BY 1 HAVING count(v) >= 4 AND quantile_cont(v, 0.75) <> quantile_cont(v, 0.25)), fe AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)"
LINES = FENCES.format(row="l_orderkey * 8 + l_linenumber", t="lineitem")
EVENTS = "x AS (SELECT 'value' AS \"column\", event_id AS row_id, value AS v FROM events), " + FENCES.split("), ", 1)[1]


def lines(s, d):
    return table(s, d, "lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("row_id"), *MEASURES)


@query("an_01_iqr", f'WITH {LINES} SELECT fe."column", count(x.v) AS outliers, round(count(x.v) / any_value(n), 4) AS rate, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high FROM fe LEFT JOIN x ON x."column" = fe."column" AND (x.v < low OR x.v > high) GROUP BY 1')
def _(s, d):
    return an.iqr_report(lines(s, d), "row_id", MEASURES)


@query("an_01_outlier_rows", f'WITH {EVENTS} SELECT x."column", row_id, v AS value FROM x JOIN fe ON fe."column" = x."column" WHERE v < low OR v > high')
def _(s, d):
    return an.iqr_outliers(table(s, d, "events").select("event_id", "value"), "event_id", ["value"])


@query("an_01_listed", f'WITH {EVENTS}, o AS (SELECT x."column", row_id, v AS value, row_number() OVER (PARTITION BY x."column" ORDER BY row_id)::INT AS rank FROM x JOIN fe ON fe."column" = x."column" WHERE v < low OR v > high) SELECT * FROM o WHERE rank <= 50')
def _(s, d):
    return an.listed(an.iqr_outliers(table(s, d, "events").select("event_id", "value"), "event_id", ["value"]))


RARE = 'n AS (SELECT *, sum(cnt) OVER (PARTITION BY "column") AS n FROM f WHERE value IS NOT NULL AND "column" IN (\'stato\', \'cod_ente\', \'ente\', \'anno\'))'


@query("an_02_rare", f'WITH $F, {RARE}, w AS (SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY cnt, value)::INT AS rank, value, cnt, round(100 * cnt / n, 4) AS pct FROM n WHERE cnt < greatest(3, 0.01 * n)) SELECT * FROM w WHERE rank <= 50')
def _(s, d):
    return an.rare_categories(frequencies(s, d, ["stato", "cod_ente", "ente", "anno"]))


@query("an_02_top_values", f'WITH $F, {RARE}, w AS (SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value)::INT AS rank, value, cnt, round(100 * cnt / n, 4) AS pct FROM n) SELECT * FROM w WHERE rank <= 2')
def _(s, d):
    return an.top_values(frequencies(s, d, ["stato", "cod_ente", "ente", "anno"]))


@query("an_03_routing", f"""WITH $F, x AS (SELECT 'entrate' AS "column", entrate::DOUBLE AS v FROM d UNION ALL SELECT 'saldo', saldo FROM d), q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY 1),
{RARE} SELECT x."column", 'iqr' AS kind, count(*) AS detected FROM x JOIN q ON q."column" = x."column" WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) GROUP BY 1 UNION ALL SELECT "column", 'rare_category', count(*) FROM n WHERE "column" = 'stato' AND cnt < greatest(3, 0.01 * n) GROUP BY 1""")
def _(s, d):
    x = dirty(s, d)
    return an.detect(x, ROW, {"entrate": "measure", "saldo": "measure", "stato": "category", "note": "skip"}, frequencies(s, d, ["stato"]))


@query("an_04_numeric_census", f"""WITH {LINES}, m AS (SELECT "column", count(DISTINCT v) AS nd, count(*) FILTER (v < 0) AS negatives, count(*) FILTER (contains(v::VARCHAR, '.') AND length(split_part(v::VARCHAR, '.', 2)) > 4) AS noisy FROM x GROUP BY 1)
SELECT fe."column", count(x.v) AS outliers, round(count(x.v) / any_value(n), 4) AS rate, any_value(least) AS least, any_value(greatest) AS greatest, any_value(negatives) AS negatives, any_value(noisy) AS noisy FROM fe JOIN m ON m."column" = fe."column" LEFT JOIN x ON x."column" = fe."column" AND (x.v < low OR x.v > high) WHERE n >= 10 AND nd > 20 GROUP BY 1""")
def _(s, d):
    return an.numeric_census(lines(s, d), "row_id", MEASURES)


@query("an_05_rare_census", 'WITH $F, n AS (SELECT *, sum(cnt) OVER (PARTITION BY "column") AS n FROM f WHERE value IS NOT NULL), g AS (SELECT "column", count(*) AS categories, max(n) AS n, count(*) FILTER (cnt < greatest(3, 0.01 * n)) AS rare FROM n GROUP BY 1) SELECT "column", categories, rare FROM g WHERE categories BETWEEN 2 AND 60 AND categories <= 0.5 * n AND rare > 0')
def _(s, d):
    return an.rare_census(frequencies(s, d))


