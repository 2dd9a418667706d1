"""dirty_orders: the orders table with defects planted by key, the input of the data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = """
WITH base AS (
  SELECT o_orderkey * 2 AS row_id, o.* FROM orders o
  UNION ALL
  SELECT o_orderkey * 2 + 1 AS row_id, o.* FROM orders o WHERE o_orderkey % 250 = 0
), p AS (
  SELECT row_id, o_orderkey AS k, o_custkey AS c, o_totalprice AS v, o_orderstatus AS st,
         CAST(year(o_orderdate) AS STRING) AS yy,
         CAST(month(o_orderdate) AS STRING) AS m1,
         lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm,
         lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd,
         month(o_orderdate) AS m, CAST(o_totalprice AS STRING) AS vt,
         'L' || CAST(o_custkey % 25 AS STRING) AS lab
  FROM base
)
SELECT row_id,
  'K' || CAST(CASE WHEN k % 500 = 1 THEN k - 1 ELSE k END AS STRING)                 AS `_id`,
  CASE k % 25 WHEN 0 THEN yy || '-' || mm WHEN 1 THEN mm || '/' || yy
       WHEN 2 THEN substr('GENFEBMARAPRMAGGIULUGAGOSETOTTNOVDIC', 3 * m - 2, 3) || '-' || yy
       WHEN 3 THEN 'Rata ' || yy ELSE yy || mm END                                    AS rata,
  CASE WHEN k % 40 = 5 THEN 'mese ' || m1
       WHEN k % 60 = 7 THEN CAST(m % 12 + 1 AS STRING) ELSE m1 END                    AS mese,
  CASE WHEN k % 80 = 9 THEN 'anno ' || yy ELSE yy END                                 AS anno,
  CASE WHEN k % 45 = 17 THEN NULL WHEN k % 50 = 13 THEN 'N.D.'
       ELSE CAST(c % 25 AS STRING) END                                                AS cod_ente,
  CASE WHEN k % 55 = 21 THEN NULL WHEN k % 200 = 11 THEN 'L99' WHEN k % 35 = 19 THEN lower(lab)
       WHEN k % 70 = 23 THEN lab || ' ' ELSE lab END                                  AS ente,
  CASE WHEN k % 30 = 3 THEN '€' || vt WHEN k % 33 = 4 THEN replace(vt, '.', ',')
       WHEN k % 37 = 5 THEN vt || ' EUR' WHEN k % 90 = 6 THEN 'N.D.' ELSE vt END      AS spesa,
  CASE WHEN k % 110 = 8 THEN NULL ELSE vt END                                         AS `SPESA TOTALE`,
  CASE k % 12 WHEN 0 THEN dd || '/' || mm || '/' || yy WHEN 1 THEN dd || '.' || mm || '.' || yy
       WHEN 2 THEN dd || '-' || mm || '-' || substr(yy, 3, 2)
       ELSE yy || '-' || mm || '-' || dd END                                          AS `aggregation-time`,
  c AS entrate, k % 400 AS uscite,
  CASE WHEN k % 150 = 1 THEN 9999 ELSE c - k % 400 END                                AS saldo,
  CASE WHEN k % 700 = 2 THEN 'Altro' ELSE st END                                      AS stato,
  CASE WHEN k % 100 = 0 THEN 'nota' ELSE NULL END                                     AS note
FROM p
"""
ROW = "row_id"
COLUMNS = ["_id", "rata", "mese", "anno", "cod_ente", "ente", "spesa", "SPESA TOTALE", "aggregation-time", "entrate", "uscite", "saldo", "stato", "note"]
#: The same relation as a common table expression for the oracle engine.
CTE = "d AS (" + SQL.replace("`", '"') + ")"


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(SQL.replace("orders o", "{orders} o"), orders=orders)
