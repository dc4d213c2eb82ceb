"""Table queries: profiling, duplicates, filling, encoding, columns, chart data and splits.

The test tables have no gaps, so the queries run on views with nulls put in by rule, on both engines alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.values import blank_to_null
from tillage.operators import chartdata, columns, dedup, encode, impute, model_impute, profile, split
from tillage.plans import recipe
from tillage.plans.rows import hash_rank, with_row_id

from .registry import query, table

# ---------------------------------------------------------------- views with gaps


def orders_gaps(spark: SparkSession, folder: str) -> DataFrame:
    gap = lambda c, m: F.when(F.col("o_orderkey") % m != 0, F.col(c)).alias(c)
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", gap("o_totalprice", 7), gap("o_orderdate", 13), gap("o_orderpriority", 11)
    )


ORDERS = """g AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS o_orderdate,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""
WITH_ORDERS = "WITH " + ORDERS + " "


def events_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "event_type", F.when(~(F.col("event_id") % 5).isin(1, 2), F.col("value")).alias("value")
    )


EVENTS = """e AS (SELECT event_id, event_type,
  CASE WHEN event_id % 5 NOT IN (1, 2) THEN value END AS value FROM events)"""
WITH_EVENTS = "WITH " + EVENTS + " "

LINE = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]


def line_small(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(*LINE)


WITH_LINE = "WITH s AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem) "
LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


def _profile_sql(number: list[str], date: list[str], text: list[str]) -> str:
    parts = []
    for c in number + date + text:
        n, d, t = c in number, c in date, c in text
        parts.append(
            f"SELECT '{c}' AS \"column\", '{'numeric' if n else 'date' if d else 'text'}' AS type, count(*) AS total, "
            f"count(*) - count({c}) AS nulls, "
            + (f"min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", " if n else 'NULL::DOUBLE AS "min", NULL::DOUBLE AS "max", ')
            + (f"strftime(min({c}), '%Y-%m-%d') AS first_date, strftime(max({c}), '%Y-%m-%d') AS last_date, " if d else
               "NULL::VARCHAR AS first_date, NULL::VARCHAR AS last_date, ")
            + (f"round(median({c}), 6)::DOUBLE AS median, " if n else "NULL::DOUBLE AS median, ")
            + (f"count(DISTINCT {c}) AS distinct_values FROM g" if t else "NULL::BIGINT AS distinct_values FROM g")
        )
    return WITH_ORDERS + " UNION ALL ".join(parts)


ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_DATES = ["o_orderdate"]
ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

# ---------------------------------------------------------------- loading


@query("s05_normalise_blanks", """SELECT event_id, nullif(CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END, '') AS event_type,
  CASE WHEN event_id % 6 <> 0 THEN value END AS value FROM events""")
def s05(spark, folder):
    raw = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 6 == 0, float("nan")).otherwise(F.col("value")).alias("value"),
    )
    return blank_to_null(raw)


@query("s06_dataset_size", "SELECT count(*) AS rows, 11::BIGINT AS columns, count(*) * 11 AS cells FROM lineitem")
def s06(spark, folder):
    return profile.dataset_size(table(spark, folder, "lineitem"))


# ---------------------------------------------------------------- profiling


@query("p01_column_profile", _profile_sql(ORDER_NUMBERS, ORDER_DATES, ORDER_TEXTS))
def p01(spark, folder):
    return profile.column_profile(orders_gaps(spark, folder)).withColumn("median", F.round("median", 6))


@query("p02_column_overview", WITH_ORDERS + """, modes AS (
  SELECT 'o_orderstatus' AS c, (SELECT o_orderstatus FROM g WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode
  UNION ALL SELECT 'o_orderpriority', (SELECT o_orderpriority FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
 base AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{'numeric' if c in ORDER_NUMBERS else 'date' if c in ORDER_DATES else 'text'}' AS type,
  count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
  {f'round(avg({c}), 2)' if c in ORDER_NUMBERS else 'NULL::DOUBLE'} AS mean,
  {f'min({c})::DOUBLE' if c in ORDER_NUMBERS else 'NULL::DOUBLE'} AS "min", {f'max({c})::DOUBLE' if c in ORDER_NUMBERS else 'NULL::DOUBLE'} AS "max",
  {f"strftime(min({c}), '%Y-%m-%d')" if c in ORDER_DATES else 'NULL::VARCHAR'} AS first_date,
  {f"strftime(max({c}), '%Y-%m-%d')" if c in ORDER_DATES else 'NULL::VARCHAR'} AS last_date FROM g"""
    for c in ORDER_COLUMNS
) + ") SELECT base.*, modes.mode FROM base LEFT JOIN modes ON modes.c = base.\"column\"")
def p02(spark, folder):
    return profile.column_overview(orders_gaps(spark, folder))


@query("p03_null_cells", WITH_ORDERS + """SELECT o_orderkey, 'o_totalprice' AS "column" FROM g WHERE o_totalprice IS NULL
  UNION ALL SELECT o_orderkey, 'o_orderdate' FROM g WHERE o_orderdate IS NULL
  UNION ALL SELECT o_orderkey, 'o_orderpriority' FROM g WHERE o_orderpriority IS NULL""")
def p03(spark, folder):
    return profile.null_cells(orders_gaps(spark, folder), ["o_orderkey"])


@query("p04_null_counts", WITH_ORDERS + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, round(count({c}) * 100.0::DOUBLE / count(*), 2) AS completeness_pct FROM g"""
    for c in ORDER_COLUMNS))
def p04(spark, folder):
    return profile.null_counts(orders_gaps(spark, folder))


_TYPED = ["a_key", "a_price", "a_date", "a_mixed", "a_text", "a_empty"]


@query("p05_semantic_types", """WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS a_key, CAST(o_totalprice AS VARCHAR) AS a_price,
   strftime(o_orderdate, '%Y-%m-%d') AS a_date, CASE WHEN o_orderkey % 100 = 0 THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS a_mixed,
   o_orderpriority AS a_text, NULL::VARCHAR AS a_empty FROM orders) """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'text' WHEN bool_and(TRY_CAST({c} AS DOUBLE) IS NOT NULL) FILTER ({c} IS NOT NULL) THEN 'numeric'
   WHEN bool_and(regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST(substr({c}, 1, 10) AS DATE) IS NOT NULL) FILTER ({c} IS NOT NULL) THEN 'date' ELSE 'text' END AS semantic_type FROM t"""
    for c in _TYPED))
def p05(spark, folder):
    o = table(spark, folder, "orders")
    return profile.semantic_types(o.select(
        F.col("o_orderkey").cast("string").alias("a_key"), F.col("o_totalprice").cast("string").alias("a_price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("a_date"),
        F.when(F.col("o_orderkey") % 100 == 0, F.col("o_orderstatus")).otherwise(F.col("o_custkey").cast("string")).alias("a_mixed"),
        F.col("o_orderpriority").alias("a_text"), F.lit(None).cast("string").alias("a_empty"),
    ))


LINE_GAPS = """WITH s AS (SELECT l_returnflag, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_discount = 0.05 THEN NULL ELSE l_discount END AS l_discount FROM lineitem) """


def line_gaps(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_discount") == 0.05, None).otherwise(F.col("l_discount")).alias("l_discount"),
    )


_TOTALS = LINE_GAPS + """, t AS (SELECT count(*) AS rows, count(*) * 3 AS cells,
   count(*) * 3 - count(l_returnflag) - count(l_quantity) - count(l_discount) AS missing_cells FROM s),
  d AS (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM s)) """


@query("p06_table_health", _TOTALS + """, h AS (SELECT rows, cells, missing_cells, rows - distinct_rows AS duplicate_rows,
   greatest(0::DOUBLE, floor(100 - (missing_cells * 100::DOUBLE / cells * 0.6::DOUBLE + (rows - distinct_rows) * 100::DOUBLE / rows * 0.4::DOUBLE) + 0.5::DOUBLE)) AS health FROM t, d)
  SELECT *, CASE WHEN health >= 90 THEN 'good' WHEN health >= 70 THEN 'fair' ELSE 'poor' END AS band FROM h""")
def p06(spark, folder):
    return profile.table_health(line_gaps(spark, folder))


@query("p07_issue_summary", _TOTALS + """SELECT 2::BIGINT AS columns_with_gaps, rows - distinct_rows AS duplicate_rows FROM t, d""")
def p07(spark, folder):
    return profile.issue_summary(line_gaps(spark, folder))


@query("p08_rows_with_gaps", WITH_ORDERS + "SELECT * FROM g WHERE o_totalprice IS NULL OR o_orderdate IS NULL OR o_orderpriority IS NULL")
def p08(spark, folder):
    return profile.rows_with_gaps(orders_gaps(spark, folder))


@query("p08_duplicate_rows", """WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount,
   row_number() OVER (ORDER BY """ + ", ".join(LINE_ORDER) + """) - 1 AS _row FROM lineitem),
  d AS (SELECT *, min(_row) OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity, l_discount) AS first_row FROM r)
  SELECT _row, first_row, l_returnflag, l_linestatus, l_quantity, l_discount FROM d WHERE _row > first_row""")
def p08_duplicates(spark, folder):
    return _marked_lines(spark, folder).filter("is_duplicate").drop("is_duplicate")


@query("p09_search", WITH_ORDERS + """SELECT * FROM g WHERE contains(lower(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)), 'urg')
   OR contains(lower(CAST(o_orderdate AS VARCHAR)), 'urg')""")
def p09(spark, folder):
    return profile.search(orders_gaps(spark, folder), "URG")


@query("p10_page", WITH_ORDERS + """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM g
   WHERE o_totalprice IS NULL OR o_orderdate IS NULL OR o_orderpriority IS NULL) WHERE position BETWEEN 40 AND 59""")
def p10(spark, folder):
    return profile.page(profile.rows_with_gaps(orders_gaps(spark, folder)), 3, ["o_orderkey"])


@query("p11_stratify_columns", WITH_ORDERS + """, c AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT coalesce(CAST({c} AS VARCHAR), '(null)')) AS distinct_values, count(*) AS n FROM g""" for c in ORDER_COLUMNS)
    + """) SELECT "column", distinct_values FROM c WHERE distinct_values > 1 AND distinct_values <= 20 AND distinct_values < n""")
def p11(spark, folder):
    return profile.stratify_columns(orders_gaps(spark, folder))


# ---------------------------------------------------------------- duplicates


@query("d01_duplicate_count", WITH_LINE + """SELECT (SELECT count(*) FROM s) AS rows, count(*) AS distinct_rows,
  (SELECT count(*) FROM s) - count(*) AS duplicate_rows FROM (SELECT DISTINCT * FROM s)""")
def d01(spark, folder):
    return dedup.duplicate_count(line_small(spark, folder))


def _numbered_lines(spark, folder):
    return with_row_id(table(spark, folder, "lineitem"), LINE_ORDER).select("_row", *LINE)


def _marked_lines(spark, folder):
    return dedup.mark_duplicates(_numbered_lines(spark, folder))


ROW_SQL = "row_number() OVER (ORDER BY " + ", ".join(LINE_ORDER) + ") - 1 AS _row"


@query("d02_mark_duplicates", f"""WITH r AS (SELECT {', '.join(LINE)}, {ROW_SQL} FROM lineitem),
  m AS (SELECT *, min(_row) OVER (PARTITION BY {', '.join(LINE)}) AS first_row FROM r) SELECT *, first_row < _row AS is_duplicate FROM m""")
def d02(spark, folder):
    return _marked_lines(spark, folder)


@query("d03_drop_duplicates", WITH_LINE + "SELECT DISTINCT * FROM s")
def d03(spark, folder):
    return dedup.drop_duplicates(line_small(spark, folder))


@query("d03_keep_first", f"""SELECT min(_row) AS _row, {', '.join(LINE)} FROM (SELECT {', '.join(LINE)}, {ROW_SQL} FROM lineitem) GROUP BY {', '.join(LINE)}""")
def d03_first(spark, folder):
    return dedup.drop_duplicates(_numbered_lines(spark, folder), "_row")


@query("d04_drop_rows_with_gaps", WITH_ORDERS + "SELECT * FROM g WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL")
def d04(spark, folder):
    return dedup.drop_rows_with_gaps(orders_gaps(spark, folder))


# ---------------------------------------------------------------- filling


@query("m01_fill_mean", WITH_ORDERS + """SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, o_custkey,
   coalesce(o_totalprice, (SELECT round_even(avg(o_totalprice), 2) FROM g)) AS o_totalprice FROM g""")
def m01(spark, folder):
    return impute.fill(orders_gaps(spark, folder), {"o_totalprice": "mean"})


@query("m02_fill_median", WITH_ORDERS + """SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, o_custkey,
   round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM g)), 6) AS o_totalprice FROM g""")
def m02(spark, folder):
    return impute.fill(orders_gaps(spark, folder), {"o_totalprice": "median"}, rounding="none").withColumn(
        "o_totalprice", F.round("o_totalprice", 6)
    )


@query("m03_fill_mode", WITH_ORDERS + """SELECT o_orderkey, o_orderpriority IS NULL AS was_missing, coalesce(o_orderpriority,
   (SELECT o_orderpriority FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM g""")
def m03(spark, folder):
    df = orders_gaps(spark, folder).select("o_orderkey", F.col("o_orderpriority").isNull().alias("was_missing"), "o_orderpriority")
    return impute.fill(df, {"o_orderpriority": "mode"})


@query("m03_fill_mode_first_seen", """WITH v AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(value AS INT) END AS value FROM events)
  SELECT event_id, coalesce(value, (SELECT value FROM v WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(event_id) LIMIT 1)) AS value FROM v""")
def m03_first(spark, folder):
    df = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.bround("value", 0).cast("int")).alias("value")
    )
    return impute.fill(df, {"value": "mode"}, order_by=["event_id"])


@query("m04_fill_constant", WITH_ORDERS + """SELECT o_orderkey, coalesce(o_totalprice, -1.5::DOUBLE) AS o_totalprice,
   coalesce(o_orderpriority, 'Missing') AS o_orderpriority FROM g""")
def m04(spark, folder):
    df = orders_gaps(spark, folder).select("o_orderkey", "o_totalprice", "o_orderpriority")
    return impute.fill(df, {"o_totalprice": "constant", "o_orderpriority": "constant"}, constants={"o_totalprice": -1.5})


@query("m05_forward_fill", WITH_EVENTS + """SELECT row_number() OVER (ORDER BY event_id) - 1 AS _row, event_id, event_type,
   last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM e""")
def m05(spark, folder):
    return impute.forward_fill(events_gaps(spark, folder), "value", ["event_id"])


@query("m06_backward_fill", WITH_EVENTS + """SELECT row_number() OVER (ORDER BY event_id) - 1 AS _row, event_id, event_type,
   first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM e""")
def m06(spark, folder):
    return impute.backward_fill(events_gaps(spark, folder), "value", ["event_id"])


@query("m07_fill_model")
def m07(spark, folder):
    df = orders_gaps(spark, folder).select("o_orderkey", "o_custkey", "o_totalprice")
    return model_impute.fill_model(df, "o_totalprice")


ONE_TREE = """k AS (SELECT o_orderkey AS id, o_orderkey::DOUBLE AS x0, o_custkey::DOUBLE AS x1, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS y FROM orders),
  e AS (SELECT list_distinct(quantile_cont(x0, P)) AS e0, list_distinct(quantile_cont(x1, P)) AS e1, min(y) AS lo, max(y) AS hi FROM k),
  r AS (SELECT id, y, len(list_filter(e0, lambda t: t < x0)) AS b0, len(list_filter(e1, lambda t: t < x1)) AS b1, floor((y - lo) / (hi - lo) * 2097152)::BIGINT - 1048576 AS q FROM k, e),
  n1 AS (SELECT *, 1 AS node FROM r)""".replace("P)", str([i / 32 for i in range(1, 32)]) + ")")
# One level: the sums of each node, feature and bin, the best cut of each node, and the rows' next nodes.
for _level in (1, 2):
    ONE_TREE += f""",
  u{_level} AS (SELECT node, f, bin, count(*) AS w, sum(q)::BIGINT AS q FROM (SELECT node, 0 AS f, b0 AS bin, q FROM n{_level} WHERE y IS NOT NULL
     UNION ALL SELECT node, 1, b1, q FROM n{_level} WHERE y IS NOT NULL) GROUP BY ALL),
  c{_level} AS (SELECT node, f, bin, (sum(w) OVER u)::DOUBLE AS lw, (sum(q) OVER u)::DOUBLE AS lq, (sum(w) OVER a)::DOUBLE AS aw, (sum(q) OVER a)::DOUBLE AS aq FROM u{_level}
     WINDOW a AS (PARTITION BY node, f), u AS (PARTITION BY node, f ORDER BY bin)),
  g{_level} AS (SELECT *, lq * lq / lw + (aq - lq) * (aq - lq) / (aw - lw) - aq * aq / aw AS gain FROM c{_level} WHERE lw < aw),
  s{_level} AS (SELECT node, f, bin FROM g{_level} WHERE gain > aw QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1),
  n{_level + 1} AS (SELECT id, y, b0, b1, q, CASE WHEN s.f IS NULL THEN n.node ELSE 2 * n.node + (CASE s.f WHEN 0 THEN b0 ELSE b1 END > s.bin)::INT END AS node FROM n{_level} n LEFT JOIN s{_level} s USING (node))"""


@query("m07_one_tree", f"""WITH {ONE_TREE}, v AS (SELECT node, avg(y) AS value FROM n3 GROUP BY 1)
  SELECT id AS o_orderkey, coalesce(y, round_even(value, 2)) AS o_totalprice FROM n3 JOIN v USING (node)""")
def m07_one_tree(spark, folder):
    """One tree of depth two over all rows: every split and every filled value against SQL."""
    df = orders_gaps(spark, folder).select("o_orderkey", "o_custkey", "o_totalprice")
    return model_impute.fill_model(df, "o_totalprice", trees=1, depth=2).drop("o_custkey")


PATTERNS = """t AS (SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS p, CASE WHEN o_orderkey % 5 <> 0 THEN c_mktsegment END AS m
   FROM orders JOIN customer ON c_custkey = o_custkey),
  cs AS (SELECT s AS v, row_number() OVER (ORDER BY s) - 1 AS code FROM (SELECT DISTINCT s FROM t WHERE s IS NOT NULL)),
  cp AS (SELECT p AS v, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT p FROM t WHERE p IS NOT NULL)),
  cm AS (SELECT m AS v, row_number() OVER (ORDER BY m) - 1 AS code FROM (SELECT DISTINCT m FROM t WHERE m IS NOT NULL)),
  k AS (SELECT o_orderkey, cs.code AS s, cp.code AS p, cm.code AS m FROM t LEFT JOIN cs ON cs.v = t.s LEFT JOIN cp ON cp.v = t.p LEFT JOIN cm ON cm.v = t.m),
  n AS (SELECT s, p, m, count(*) AS n FROM k GROUP BY ALL),
  d AS (SELECT r.s, r.p, r.m, r.n, b.p AS value, b.n AS w, round(sqrt((coalesce((r.s - b.s) * (r.s - b.s), 0) + coalesce((r.m - b.m) * (r.m - b.m), 0)) * 3::DOUBLE
     / ((r.s IS NOT NULL AND b.s IS NOT NULL)::INT + (r.m IS NOT NULL AND b.m IS NOT NULL)::INT)), 12) AS dist, coalesce(b.s, -1) AS bs, b.p AS bp, coalesce(b.m, -1) AS bm
     FROM n r JOIN n b ON r.p IS NULL AND b.p IS NOT NULL),
  o AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY s, p, m ORDER BY dist, bs, bp, bm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
  f AS (SELECT s, m, any_value(n) AS n, round_even(sum(value * greatest(0, least(w, 5 - before)))::DOUBLE / sum(greatest(0, least(w, 5 - before)))::DOUBLE, 0)::BIGINT AS code FROM o GROUP BY s, m)"""


def _categories(spark, folder):
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    gap = lambda name, m: F.when(F.col("o_orderkey") % m != 0, F.col(name)).alias(name)
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_orderstatus", gap("o_orderpriority", 11), gap("c_mktsegment", 5))


@query("m08_neighbour_patterns", f"WITH {PATTERNS} SELECT s AS _c0, m AS _c2, n, code FROM f")
def m08_patterns(spark, folder):
    return model_impute.neighbour_fills(_categories(spark, folder), "o_orderpriority").drop("_c1")


@query("m08_fill_neighbours", f"""WITH {PATTERNS} SELECT t.o_orderkey, t.s AS o_orderstatus, coalesce(t.p, cp.v) AS o_orderpriority, t.m AS c_mktsegment FROM t JOIN k ON k.o_orderkey = t.o_orderkey
  LEFT JOIN f ON t.p IS NULL AND f.s IS NOT DISTINCT FROM k.s AND f.m IS NOT DISTINCT FROM k.m LEFT JOIN cp ON cp.code = f.code""")
def m08(spark, folder):
    return model_impute.fill_neighbours(_categories(spark, folder), "o_orderpriority")


@query("m09_unfillable_stays", WITH_ORDERS + "SELECT o_orderkey, o_orderstatus, NULL::DOUBLE AS nothing FROM g")
def m09(spark, folder):
    df = orders_gaps(spark, folder).select("o_orderkey", "o_orderstatus", F.lit(None).cast("double").alias("nothing"))
    return impute.fill(df, {"nothing": "mean", "o_orderstatus": "mode", "unknown": "mode"})


@query("m10_fill_preview", WITH_ORDERS + """SELECT 'o_totalprice' AS "column", 'double' AS type, 'mean' AS method, count(*) - count(o_totalprice) AS missing,
   round(avg(o_totalprice), 4) AS number, NULL AS text FROM g
  UNION ALL SELECT 'o_orderpriority', 'string', 'mode', count(*) - count(o_orderpriority), NULL,
   (SELECT o_orderpriority FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM g""")
def m10(spark, folder):
    p = impute.preview(orders_gaps(spark, folder), {"o_totalprice": "mean", "o_orderpriority": "mode"}, rounding="none")
    number = F.col("type") == "double"
    return p.select("column", "type", "method", "missing", F.round(F.when(number, F.col("value").cast("double")), 4).alias("number"),
                    F.when(~number, F.col("value")).alias("text"))


# ---------------------------------------------------------------- encoding

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _priority(spark, folder):
    return orders_gaps(spark, folder).select("o_orderkey", "o_orderpriority", "o_orderstatus")


_CODES = WITH_ORDERS + """, c AS (SELECT o_orderpriority AS v, count(*) AS n, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
   FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1) """


@query("e01_one_hot", WITH_ORDERS + "SELECT o_orderkey, " + ", ".join(
    f"""coalesce((o_orderpriority = '{v}')::INT, 0) AS "o_orderpriority_{v}" """ for v in _PRIORITIES) + ", o_orderstatus FROM g")
def e01(spark, folder):
    return encode.one_hot(_priority(spark, folder), "o_orderpriority")


@query("e01_one_hot_null_column", WITH_ORDERS + "SELECT o_orderkey, o_orderstatus, " + ", ".join(
    f"""coalesce((o_orderpriority = '{v}')::INT, 0) AS "o_orderpriority_{v}" """ for v in _PRIORITIES)
    + ", (o_orderpriority IS NULL)::INT AS o_orderpriority_null FROM g")
def e01_null(spark, folder):
    return encode.one_hot(_priority(spark, folder), "o_orderpriority", null_column=True, at_end=True)


@query("e02_ordinal", _CODES + "SELECT o_orderkey, code AS o_orderpriority, o_orderstatus FROM g LEFT JOIN c ON v = o_orderpriority")
def e02(spark, folder):
    return encode.ordinal(_priority(spark, folder), "o_orderpriority")


@query("e02_ordinal_unseen", WITH_ORDERS + """, f AS (SELECT * FROM g WHERE o_orderpriority <> '3-MEDIUM'),
   c AS (SELECT DISTINCT o_orderpriority AS v, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM f WHERE o_orderpriority IS NOT NULL)
  SELECT o_orderkey, CASE WHEN o_orderpriority IS NOT NULL THEN coalesce(code, -1) END AS o_orderpriority, o_orderstatus FROM g LEFT JOIN c ON v = o_orderpriority""")
def e02_unseen(spark, folder):
    df = _priority(spark, folder)
    fitted = encode.category_table(df.filter("o_orderpriority <> '3-MEDIUM'"), "o_orderpriority")
    return encode.ordinal(df, "o_orderpriority", fitted)


@query("e03_ordinal_by", WITH_ORDERS + """SELECT o_orderkey, list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority)::BIGINT - 1 AS o_orderpriority,
   o_orderstatus FROM g""")
def e03(spark, folder):
    return encode.ordinal_by(_priority(spark, folder), "o_orderpriority", _PRIORITIES[::-1])


@query("e04_label", _CODES + "SELECT o_orderkey, code AS o_orderpriority, o_orderstatus FROM g LEFT JOIN c ON v = o_orderpriority")
def e04(spark, folder):
    return encode.label(_priority(spark, folder), "o_orderpriority")


@query("e04_label_many", """WITH c AS (SELECT c_name AS v, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer))
  SELECT o_orderkey, code AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN c ON v = c_name""")
def e04_many(spark, folder):
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return encode.label(o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("name")), "name")


@query("e05_frequency", _CODES + "SELECT o_orderkey, n AS o_orderpriority, o_orderstatus FROM g LEFT JOIN c ON v = o_orderpriority")
def e05(spark, folder):
    return encode.frequency(_priority(spark, folder), "o_orderpriority")


@query("e06_target", """WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS p, o_totalprice AS y FROM orders),
  a AS (SELECT avg(y) AS m, var_pop(y) AS v FROM g), s AS (SELECT p, count(*) AS n, avg(y) AS cm, var_pop(y) AS cv FROM g GROUP BY p)
  SELECT o_orderkey, round(n * v / (n * v + cv) * cm + (1 - n * v / (n * v + cv)) * m, 4) AS o_orderpriority, y AS o_totalprice
  FROM g, a, s WHERE s.p IS NOT DISTINCT FROM g.p""")
def e06(spark, folder):
    o = table(spark, folder, "orders")
    df = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_totalprice")
    return encode.target(df, "o_orderpriority", "o_totalprice").withColumn("o_orderpriority", F.round("o_orderpriority", 4))


@query("e06_target_folds", """WITH g AS (SELECT o_orderkey, o_orderpriority AS p, o_totalprice AS y,
   (('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT % 5)::INT AS f FROM orders),
  k AS (SELECT DISTINCT f FROM g), a AS (SELECT k.f, avg(y) AS m, var_pop(y) AS v FROM k JOIN g ON g.f <> k.f GROUP BY k.f),
  s AS (SELECT k.f, p, count(*) AS n, avg(y) AS cm, var_pop(y) AS cv FROM k JOIN g ON g.f <> k.f GROUP BY k.f, p)
  SELECT o_orderkey, round(n * v / (n * v + cv) * cm + (1 - n * v / (n * v + cv)) * m, 3) AS o_orderpriority, y AS o_totalprice
  FROM g JOIN a ON a.f = g.f JOIN s ON s.f = g.f AND s.p = g.p""")
def e06_folds(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return encode.target_folds(df, "o_orderpriority", "o_totalprice", ["o_orderkey"]).withColumn("o_orderpriority", F.round("o_orderpriority", 3))


@query("e07_category_codes", _CODES + "SELECT o_orderkey, coalesce(code, -1) AS o_orderpriority, o_orderstatus FROM g LEFT JOIN c ON v = o_orderpriority")
def e07(spark, folder):
    return encode.category_codes(_priority(spark, folder), "o_orderpriority")


@query("e08_date_parts", WITH_ORDERS + """SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month,
   day(o_orderdate)::INT AS o_orderdate_day, o_totalprice FROM g""")
def e08(spark, folder):
    return encode.date_parts(orders_gaps(spark, folder).select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate")


# ---------------------------------------------------------------- columns


@query("c01_rename", "SELECT c_custkey, c_name AS customer, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def c01(spark, folder):
    return columns.rename(table(spark, folder, "customer"), "c_name", "customer")


@query("c02_swap", "SELECT c_custkey, c_acctbal, c_nationkey, c_name, c_mktsegment FROM customer")
def c02(spark, folder):
    return columns.swap(table(spark, folder, "customer"), "c_name", "c_acctbal")


@query("c03_drop", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def c03(spark, folder):
    return columns.drop(table(spark, folder, "customer"), ["c_nationkey", "c_acctbal"])


@query("c04_cell_changes", WITH_ORDERS + """SELECT o_orderkey, 'priority' AS "column", NULL::VARCHAR AS old, 'Missing' AS "new" FROM g WHERE o_orderpriority IS NULL
  UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE '2' END FROM g""")
def c04(spark, folder):
    before = orders_gaps(spark, folder).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = impute.fill(before, {"o_orderpriority": "constant"})
    after = columns.rename(encode.label(after, "o_orderstatus"), "o_orderpriority", "priority")
    return columns.cell_changes(before, after, ["o_orderkey"], {"o_orderpriority": "priority"})


recipe.action("fill", lambda df, **p: impute.fill(df, **p))
recipe.action("drop_duplicates", lambda df: dedup.drop_duplicates(df))
recipe.action("rename", lambda df, **p: columns.rename(df, **p))
recipe.action("drop_columns", lambda df, **p: columns.drop(df, **p))
recipe.action("label", lambda df, **p: encode.label(df, **p))


@query("c05_step_log", WITH_LINE + """SELECT 1 AS step, 'drop_columns' AS action, count(*) AS rows_before, count(*) AS rows_after, 3 AS column_count FROM s
  UNION ALL SELECT 2, 'drop_duplicates', count(*), (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_quantity, l_discount FROM s)), 3 FROM s
  UNION ALL SELECT 3, 'rename', count(*), count(*), 3 FROM (SELECT DISTINCT l_returnflag, l_quantity, l_discount FROM s)""")
def c05(spark, folder):
    steps = recipe.Recipe(line_small(spark, folder)).then("drop_columns", columns=["l_linestatus"]).then("drop_duplicates")
    steps = steps.then("rename", old="l_quantity", new="quantity")
    return steps.log().select("step", "action", "rows_before", "rows_after", F.size("columns").alias("column_count"))


@query("c06_undo", WITH_LINE + "SELECT DISTINCT l_returnflag, l_quantity, l_discount FROM s")
def c06(spark, folder):
    steps = recipe.Recipe(line_small(spark, folder)).then("drop_columns", columns=["l_linestatus"]).then("drop_duplicates")
    return steps.then("rename", old="l_quantity", new="quantity").undo().result()


@query("c07_revert", WITH_LINE + "SELECT * FROM s")
def c07(spark, folder):
    return recipe.Recipe(line_small(spark, folder)).then("drop_duplicates").revert().result()


# ---------------------------------------------------------------- chart data

_HIST = """, r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w, count(*) AS n FROM lineitem) """


@query("v01_histogram", "WITH one AS (SELECT 1)" + _HIST + """SELECT l_returnflag AS hue, least(19, floor((l_extendedprice - lo) / w))::INT AS bin, count(*) AS n,
   round(any_value(lo + least(19, floor((l_extendedprice - lo) / w)) * w), 4) AS "left", round(any_value(lo + (least(19, floor((l_extendedprice - lo) / w)) + 1) * w), 4) AS "right",
   round(count(*) * 100::DOUBLE / any_value(r.n), 6) AS percent FROM lineitem, r GROUP BY 1, 2""")
def v01(spark, folder):
    h = chartdata.histogram(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag")
    return h.select("hue", "bin", "n", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"), F.round("percent", 6).alias("percent"))


@query("v02_density", """WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS total FROM lineitem),
  g AS (SELECT l_returnflag AS hue, power(count(*)::DOUBLE, -0.2::DOUBLE) * stddev_samp(l_quantity) AS h FROM lineitem GROUP BY 1),
  v AS (SELECT l_returnflag AS hue, l_quantity AS v, count(*) AS w FROM lineitem GROUP BY 1, 2),
  p AS (SELECT i::INT AS point, lo + i * ((hi - lo) / 199) AS x, total FROM r, range(200) t(i))
  SELECT v.hue, point, round(any_value(x), 6) AS x, round(sum(w * exp(-0.5::DOUBLE * ((x - v) / h) * ((x - v) / h)) / (h * sqrt(2 * pi()))) / any_value(total), 9) AS density
  FROM v JOIN g ON g.hue = v.hue, p GROUP BY 1, 2""")
def v02(spark, folder):
    d = chartdata.density(table(spark, folder, "lineitem"), "l_quantity", "l_returnflag")
    return d.select("hue", "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("v03_bars_sturges", """WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, least(20, greatest(5, ceil(log2(count(*)) + 1)))::INT AS k FROM lineitem),
  b AS (SELECT l_linestatus AS hue, lo, (hi - lo) / k AS w, least(k - 1, floor((l_quantity - lo) / ((hi - lo) / k)))::INT AS i FROM lineitem, r)
  SELECT hue, rtrim(rtrim(printf('%.2f', lo + i * w), '0'), '.') || ' to ' || rtrim(rtrim(printf('%.2f', lo + (i + 1) * w), '0'), '.') AS label, i AS bin, count(*) AS n FROM b GROUP BY hue, lo, w, i""")
def v03(spark, folder):
    return chartdata.bar_bins(table(spark, folder, "lineitem"), "l_quantity", "l_linestatus")


@query("v03_bars_few_numbers", """SELECT 'All' AS hue, rtrim(rtrim(printf('%.2f', l_discount), '0'), '.') AS label, count(*) AS n FROM lineitem GROUP BY l_discount""")
def v03_few(spark, folder):
    return chartdata.bar_bins(table(spark, folder, "lineitem"), "l_discount")


@query("v03_bars_text", WITH_ORDERS + """SELECT coalesce(o_orderpriority, 'All') AS hue, o_orderstatus AS label, count(*) AS n FROM g GROUP BY 1, 2""")
def v03_text(spark, folder):
    return chartdata.bar_bins(orders_gaps(spark, folder), "o_orderstatus", "o_orderpriority")


@query("v04_hue_groups", WITH_ORDERS + "SELECT coalesce(o_orderpriority, 'All') AS hue, count(*) AS n FROM g GROUP BY 1")
def v04(spark, folder):
    return chartdata.group_counts(orders_gaps(spark, folder), "o_orderpriority")


def _box_sql(tail: str) -> str:
    return WITH_ORDERS + """, q AS (SELECT o_orderpriority AS box, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
   quantile_cont(o_totalprice, 0.75) AS q3 FROM g WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1),
  f AS (SELECT *, q1 - (q3 - q1) * 0.5::DOUBLE AS lf, q3 + (q3 - q1) * 0.5::DOUBLE AS hf FROM q),
  d AS (SELECT g.*, f.* FROM g JOIN f ON box = o_orderpriority WHERE o_totalprice IS NOT NULL) """.replace("0.5::DOUBLE", "1.5::DOUBLE") + tail


@query("v05_box_stats", _box_sql("""SELECT box, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
   min(o_totalprice) FILTER (o_totalprice BETWEEN lf AND hf) AS low, max(o_totalprice) FILTER (o_totalprice BETWEEN lf AND hf) AS high,
   count(*) FILTER (o_totalprice NOT BETWEEN lf AND hf) AS outliers FROM d GROUP BY 1"""))
def v05(spark, folder):
    b = chartdata.box_stats(orders_gaps(spark, folder), "o_totalprice", "o_orderpriority")
    return b.select("box", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "low", "high", "outliers")


@query("v06_outlier_rows", """WITH q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM (SELECT l_extendedprice / l_quantity * l_quantity * l_quantity AS v FROM lineitem)),
  f AS (SELECT q1 - (q3 - q1) * 1.5::DOUBLE AS lf, q3 + (q3 - q1) * 1.5::DOUBLE AS hf FROM q)
  SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity * l_quantity * l_quantity AS v FROM lineitem, f WHERE l_extendedprice / l_quantity * l_quantity * l_quantity NOT BETWEEN lf AND hf""")
def v06(spark, folder):
    v = F.col("l_extendedprice") / F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    return chartdata.outlier_rows(df, "v").select("l_orderkey", "l_linenumber", "v")


@query("v07_scatter", WITH_ORDERS + "SELECT o_custkey AS x, o_totalprice AS y, coalesce(o_orderpriority, 'All') AS hue FROM g WHERE o_totalprice IS NOT NULL")
def v07(spark, folder):
    return chartdata.scatter(orders_gaps(spark, folder), "o_custkey", "o_totalprice", "o_orderpriority")


@query("v08_line", WITH_ORDERS + """SELECT o_orderdate AS x, o_orderstatus AS hue, round(avg(o_totalprice), 4) AS mean_y FROM g
   WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1, 2""")
def v08(spark, folder):
    return chartdata.line(orders_gaps(spark, folder), "o_orderdate", "o_totalprice", "o_orderstatus").withColumn("mean_y", F.round("mean_y", 4))


@query("v08_line_with_gaps", WITH_ORDERS + """, x AS (SELECT DISTINCT o_orderdate AS x FROM g WHERE o_orderdate IS NOT NULL), h AS (SELECT DISTINCT o_orderstatus AS hue FROM g)
  SELECT x.x, h.hue, round(avg(o_totalprice)::DECIMAL(28, 8), 2)::DOUBLE AS mean_y FROM x CROSS JOIN h LEFT JOIN g ON o_orderdate = x AND o_orderstatus = hue GROUP BY 1, 2""")
def v08_gaps(spark, folder):
    return chartdata.line_with_gaps(orders_gaps(spark, folder), "o_orderdate", "o_totalprice", "o_orderstatus")


_PAIRED = ["o_orderkey", "o_custkey", "o_totalprice", "flat"]


def _corr_sql(a: str, b: str) -> str:
    if "flat" in (a, b) or a == b:
        return f"SELECT '{a}' AS a, '{b}' AS b, {'NULL' if 'flat' in (a, b) else '1'}::DOUBLE AS r"
    return f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM g"


@query("v09_correlation", WITH_ORDERS + " UNION ALL ".join(_corr_sql(a, b) for a in _PAIRED for b in _PAIRED))
def v09(spark, folder):
    t = orders_gaps(spark, folder).select("o_orderkey", "o_custkey", "o_totalprice", F.when(F.col("o_orderkey") >= 0, 1.0).alias("flat"))
    return chartdata.correlation(t).withColumn("r", F.round("r", 9))


# ---------------------------------------------------------------- splits

RANKED = "row_number() OVER (ORDER BY md5('42:' || o_orderkey)) - 1"


@query("r02_hash_rank", f"SELECT o_orderkey, {RANKED} AS _rank FROM orders")
def r02(spark, folder):
    return hash_rank(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 42)


@query("r01_row_id", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS _row FROM customer")
def r01(spark, folder):
    return with_row_id(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), "c_custkey"]).select("c_custkey", "_row")


@query("l01_train_test_valid", f"""WITH n AS (SELECT count(*) AS n, ceil(count(*) * 0.2::DOUBLE)::BIGINT AS t FROM orders),
  s AS (SELECT n, t, ceil((n - t) * (0.1::DOUBLE / 0.8::DOUBLE))::BIGINT AS v FROM n), r AS (SELECT o_orderkey, o_orderstatus, {RANKED} AS k FROM orders)
  SELECT o_orderkey, o_orderstatus, CASE WHEN k >= n - t THEN 'test' WHEN k >= n - t - v THEN 'valid' ELSE 'train' END AS split FROM r, s""")
def l01(spark, folder):
    return split.train_test_valid(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


def split_sql(source: str, key: str, by: str, keep: str, ratios=(0.7, 0.2, 0.1)) -> str:
    """SQL of an exact split of ``source`` per group."""
    v, t = f"{ratios[1]}::DOUBLE", f"{ratios[2]}::DOUBLE"
    return f"""SELECT {keep}, CASE WHEN k >= n - nt THEN 'test' WHEN k >= n - nt - nv THEN 'valid' ELSE 'train' END AS split FROM (
   SELECT *, nv0 - CASE WHEN n - nv0 - nt0 < 1 AND nv0 >= nt0 THEN 1 ELSE 0 END AS nv, nt0 - CASE WHEN n - nv0 - nt0 < 1 AND nv0 < nt0 THEN 1 ELSE 0 END AS nt FROM (
   SELECT *, greatest(CASE WHEN n >= 3 THEN 1 ELSE 0 END, round_even(n * {v}, 0)::BIGINT) AS nv0, greatest(CASE WHEN n >= 3 THEN 1 ELSE 0 END, round_even(n * {t}, 0)::BIGINT) AS nt0 FROM (
   SELECT *, count(*) OVER (PARTITION BY {by}) AS n, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || {key})) - 1 AS k FROM {source})))"""


@query("l02_exact_split", split_sql("orders", "o_orderkey", "1", "o_orderkey"))
def l02(spark, folder):
    return split.split(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"])


@query("l03_stratified_split", WITH_ORDERS + split_sql("(SELECT o_orderkey, o_orderpriority, coalesce(o_orderpriority, '(blank)') AS b FROM g)", "o_orderkey", "b", "o_orderkey, o_orderpriority"))
def l03(spark, folder):
    return split.split(orders_gaps(spark, folder).select("o_orderkey", "o_orderpriority"), ["o_orderkey"], by="o_orderpriority")


@query("l03_many_strata", split_sql("(SELECT event_id, user_id FROM events)", "event_id", "user_id", "event_id, user_id"))
def l03_many(spark, folder):
    return split.split(table(spark, folder, "events").select("event_id", "user_id"), ["event_id"], by="user_id")


@query("v10_split_shares", "WITH s AS (" + split_sql("orders", "o_orderkey", "1", "o_orderkey") + """)
  SELECT split, count(*) AS n, round(count(*) * 100::DOUBLE / (SELECT count(*) FROM s), 6) AS percent FROM s GROUP BY 1""")
def v10(spark, folder):
    df = split.split(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"])
    return chartdata.split_shares(df).withColumn("percent", F.round("percent", 6))
