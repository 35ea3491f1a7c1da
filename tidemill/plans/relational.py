"""Relational queries over the star schema, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.semantics import avg_exact, overlaps, pg_asc, pg_desc, raw_filter, round_half_even, structured_filter, sum_exact, trunc_number
from tidemill.session import table
from tidemill.sources.lakehouse import min_max_count, olap, row_json, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n() -> Column:
    return F.count(F.lit(1)).alias("n")


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def li(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem")


def od(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders")


# --- scans ------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_tax > 0.07")
def a1_projected_scan(s, d):
    return scan(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_tax"], (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_tax") > 0.07))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS row_json FROM nation")
def a1_row_json(s, d):
    df = table(s, d, "nation")
    return df.select("n_nationkey", row_json(df).alias("row_json"))


@query("SELECT min(o_orderdate) AS min, max(o_orderdate) AS max, count(*) AS n FROM orders")
def a1_min_max_count(s, d):
    return min_max_count(s, f"{d}/orders.parquet", "o_orderdate")


@query("SELECT event_type AS category, count(*) AS c, round(avg(value), 4) AS a FROM events GROUP BY event_type")
def a1_olap(s, d):
    return olap(table(s, d, "events"), "event_type", "value")


# --- filters ----------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND 9000 >= c_acctbal AND c_nationkey <> 3")
def a2_comparisons(s, d):
    return table(s, d, "customer").where((F.col("c_acctbal") > 5000) & (F.lit(9000) >= F.col("c_acctbal")) & (F.col("c_nationkey") != 3)).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_type NOT LIKE 'PROMO%' AND p_brand <> 'Brand#11'")
def a2_like(s, d):
    p = table(s, d, "part")
    return p.where(p.p_name.like("%a%e%") & ~p.p_type.like("PROMO%") & (p.p_brand != "Brand#11")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_type ILIKE '%BRASS%' OR regexp_matches(p_name, '^[a-m]')")
def a2_ilike_regex(s, d):
    p = table(s, d, "part")
    return p.where(p.p_type.ilike("%brass%") | p.p_name.rlike("^[a-m]")).select("p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 13, 49) AND p_size NOT IN (7)")
def a2_in(s, d):
    p = table(s, d, "part")
    return p.where(p.p_size.isin(1, 7, 13, 49) & ~p.p_size.isin(7)).select("p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND NOT o_totalprice > 50000)")
def a2_boolean_tree(s, d):
    o = od(s, d)
    return o.where(((o.o_orderstatus == "F") & (o.o_totalprice > 200000)) | ((o.o_orderstatus == "O") & ~(o.o_totalprice > 50000))).select("o_orderkey")


@query("SELECT vec_id FROM embeddings WHERE list_has_any([label, label % 3], [2, 7])")
def a2_overlap(s, d):
    return table(s, d, "embeddings").where(overlaps(F.array("label", F.col("label") % 3), F.array(F.lit(2), F.lit(7)))).select("vec_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'P') AND o_orderpriority <> '5-LOW'")
def a2_structured_filter(s, d):
    cond = structured_filter([{"col": "o_totalprice", "op": ">=", "value": 100000}, {"col": "o_orderstatus", "op": "IN", "value": ["F", "P"]}, {"col": "o_orderpriority", "op": "<>", "value": "5-LOW"}])
    return od(s, d).where(cond).select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events WHERE value > 10 AND event_type IS NOT NULL")
def a2_raw_filter(s, d):
    return table(s, d, "events").where(raw_filter("value > 10 AND event_type IS NOT NULL")).select("event_id")


# --- joins ------------------------------------------------------------------------------------------------


@query("SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def a3_star_join(s, d):
    joined = od(s, d).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(n(), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def a3_left_join(s, d):
    o = od(s, d).where("o_orderstatus = 'P'")
    return table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT n_name, s_name FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
def a3_right_join(s, d):
    return table(s, d, "supplier").where("s_acctbal > 0").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_name")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def a3_full_join(s, d):
    a = table(s, d, "customer").where("c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def a3_semi_join(s, d):
    return table(s, d, "customer").join(od(s, d).where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def a3_anti_join(s, d):
    return table(s, d, "customer").join(od(s, d), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, s_name FROM region, supplier WHERE s_acctbal < 1000 * r_regionkey")
def a3_theta_join(s, d):
    """A theta join; the region table is five rows, which Spark's size estimate lets it broadcast."""
    return table(s, d, "supplier").join(table(s, d, "region"), F.col("s_acctbal") < 1000 * F.col("r_regionkey")).select("r_name", "s_name")


@query("SELECT a.n_name AS a, b.r_name AS b FROM nation a CROSS JOIN region b")
def a3_cross_join(s, d):
    return table(s, d, "nation").crossJoin(table(s, d, "region")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))


@query("SELECT c_mktsegment, round(avg(total), 4) AS avg_total FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) t ON o_custkey = c_custkey GROUP BY 1")
def a3_join_over_aggregate(s, d):
    t = od(s, d).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return table(s, d, "customer").join(t, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.round(F.avg("total"), 4).alias("avg_total"))


# --- aggregates -------------------------------------------------------------------------------------------


@query(
    """SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first_ship FROM lineitem WHERE l_returnflag <> 'R' AND l_discount >= 0.02 GROUP BY 1, 2"""
)
def a4_monthly_revenue(s, d):
    rows = li(s, d).where((F.col("l_returnflag") != "R") & (F.col("l_discount") >= 0.02))
    return rows.groupBy(ntz(F.date_trunc("month", "l_shipdate")).alias("month"), "l_linestatus").agg(
        n(), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.min("l_shipdate").alias("first_ship")
    )


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def a4_pricing_summary(s, d):
    rows = li(s, d).where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), n(),
    )


@query("SELECT count(*) AS n, count(description) AS n_desc, count(DISTINCT src_id) AS n_src FROM graph_edges")
def a4_counts(s, d):
    return table(s, d, "graph_edges").agg(n(), F.count("description").alias("n_desc"), F.count_distinct("src_id").alias("n_src"))


@query("SELECT l_linenumber, CAST(sum(l_orderkey) AS BIGINT) AS s8, CAST(sum(l_linenumber) AS BIGINT) AS s4, round(avg(l_orderkey), 4) AS a8, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def a4_exact_sums(s, d):
    return li(s, d).groupBy("l_linenumber").agg(sum_exact("l_orderkey").cast("long").alias("s8"), F.sum("l_linenumber").alias("s4"), F.round(avg_exact("l_orderkey").cast("double"), 4).alias("a8"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("SELECT CAST(sum(p_size + 5) AS BIGINT) AS shifted, CAST(sum(p_size - 2) AS BIGINT) AS lowered FROM part")
def a4_sum_with_constant(s, d):
    return table(s, d, "part").agg(F.sum(F.col("p_size") + 5).alias("shifted"), F.sum(F.col("p_size") - 2).alias("lowered"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS h, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def a4_hourly(s, d):
    return table(s, d, "events").groupBy(ntz(F.date_trunc("hour", "ts")).alias("h"), "event_type").agg(n(), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT CAST(extract(minute FROM ts) AS BIGINT) AS m, CAST(extract(hour FROM ts) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1, 2")
def a4_extract_keys(s, d):
    return table(s, d, "events").groupBy(F.extract(F.lit("minute"), "ts").cast("long").alias("m"), F.extract(F.lit("hour"), "ts").cast("long").alias("h")).agg(n())


@query("SELECT p_size + 1 AS k, 7 AS seven, count(*) AS n FROM part GROUP BY p_size + 1")
def a4_key_with_constant(s, d):
    return table(s, d, "part").groupBy((F.col("p_size") + 1).alias("k")).agg(n()).select("k", F.lit(7).alias("seven"), "n")


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a4_cube(s, d):
    return od(s, d).cube("o_orderstatus", "o_orderpriority").agg((F.grouping("o_orderstatus").cast("long") + 2 * F.grouping("o_orderpriority").cast("long")).alias("g"), n())


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def a4_rollup(s, d):
    return table(s, d, "customer").rollup("c_mktsegment", "c_nationkey").agg(n())


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
def a4_grouping_sets(s, d):
    p = table(s, d, "part")
    return p.groupingSets([[F.col("p_brand")], [F.col("p_size")], []], "p_brand", "p_size").agg(n())


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def a4_having(s, d):
    return od(s, d).groupBy("o_custkey").agg(n()).where("n > 12")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def a4_distinct(s, d):
    return table(s, d, "part").select("p_brand", "p_size").distinct()


@query("SELECT l_shipmode_like AS k, count(*) FILTER (WHERE l_discount > 0.05) AS n_disc, round(sum(l_tax) FILTER (WHERE l_returnflag = 'A'), 4) AS tax_a FROM (SELECT *, l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1")
def a4_filter_clause(s, d):
    return li(s, d).groupBy(F.col("l_linestatus").alias("k")).agg(F.count_if(F.col("l_discount") > 0.05).alias("n_disc"), F.round(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_tax"))), 4).alias("tax_a"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list(n_nationkey ORDER BY n_name) AS keys FROM nation GROUP BY 1")
def a4_ordered_aggregates(s, d):
    both = F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))
    return table(s, d, "nation").groupBy("n_regionkey").agg(both.alias("p")).select("n_regionkey", F.array_join(F.col("p.n_name"), ",").alias("names"), F.col("p.n_nationkey").alias("keys"))


@query(
    """SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sdp, round(var_samp(c_acctbal), 3) AS vs, round(corr(c_acctbal, c_nationkey), 6) AS r, round(covar_pop(c_acctbal, c_nationkey), 4) AS cp,
    round(regr_slope(c_acctbal, c_nationkey), 4) AS slope FROM customer GROUP BY 1"""
)
def a4_statistics(s, d):
    return table(s, d, "customer").groupBy("c_mktsegment").agg(
        F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.round(F.stddev_pop("c_acctbal"), 4).alias("sdp"), F.round(F.var_samp("c_acctbal"), 3).alias("vs"), F.round(F.corr("c_acctbal", "c_nationkey"), 6).alias("r"),
        F.round(F.covar_pop("c_acctbal", "c_nationkey"), 4).alias("cp"), F.round(F.regr_slope("c_acctbal", "c_nationkey"), 4).alias("slope"),
    )


@query("SELECT p_brand, bool_and(p_size > 0) AS all_pos, bool_or(p_size > 49) AS any_big, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx FROM part GROUP BY 1")
def a4_boolean_bit_aggregates(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.bool_and(F.col("p_size") > 0).alias("all_pos"), F.bool_or(F.col("p_size") > 49).alias("any_big"), F.bit_and("p_size").alias("ba"), F.bit_or("p_size").alias("bo"), F.bit_xor("p_size").alias("bx"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, quantile_disc(l_quantity, 0.9) AS p90, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1 FROM lineitem GROUP BY 1")
def a4_percentiles(s, d):
    return li(s, d).groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", 0.5), 4).alias("med"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity)").alias("p90"), F.round(F.percentile("l_extendedprice", 0.25), 4).alias("q1"))


@query("SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS top_order, arg_min(o_orderkey, o_totalprice) AS low_order FROM orders GROUP BY 1")
def a4_max_by(s, d):
    return od(s, d).groupBy("o_orderstatus").agg(F.max_by("o_orderkey", "o_totalprice").alias("top_order"), F.min_by("o_orderkey", "o_totalprice").alias("low_order"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def a4_pivot(s, d):
    wide = od(s, d).groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *[F.coalesce(c.upper(), F.lit(0)).alias(c) for c in ("f", "o", "p")])


# --- windows, order, sets ---------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr,
    round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, ntile(3) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def a5_ranking(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return od(s, d).select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.ntile(3).over(w).alias("nt"))


@query(
    """SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_orderkey, 2, 0) OVER w AS next2, first_value(o_orderkey) OVER w AS first_o, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_o,
    nth_value(o_orderkey, 2) OVER w AS second_o FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def a5_analytic(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return od(s, d).select("o_orderkey", F.lag("o_totalprice").over(w).alias("prev"), F.lead("o_orderkey", 2, 0).over(w).alias("next2"), F.first("o_orderkey").over(w).alias("first_o"), F.last("o_orderkey").over(full).alias("last_o"), F.nth_value("o_orderkey", 2).over(w).alias("second_o"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 1) AS a FROM orders")
def a5_row_frames(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return od(s, d).select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("s3"), F.round(F.avg("o_totalprice").over(Window.partitionBy("o_custkey")), 1).alias("a"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
def a5_range_frames(s, d):
    return table(s, d, "part").select("p_partkey", F.count(F.lit(1)).over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)).alias("near"))


@query("SELECT p_partkey, CAST(sum(c) OVER (PARTITION BY p_brand ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_groups FROM (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS g, 1 AS c FROM part)")
def a5_groups_frame(s, d):
    """GROUPS frames by dense rank."""
    ranked = table(s, d, "part").withColumn("g", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")))
    return ranked.select("p_partkey", F.sum(F.lit(1)).over(Window.partitionBy("p_brand").orderBy("g").rangeBetween(-1, 0)).alias("in_groups"))


@query("SELECT id, weight FROM graph_edges WHERE weight IS NULL OR weight > 40 ORDER BY weight DESC NULLS FIRST, id LIMIT 50")
def a5_top_k(s, d):
    return table(s, d, "graph_edges").where("weight is null or weight > 40").select("id", "weight").orderBy(pg_desc("weight"), pg_asc("id")).limit(50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def a5_limit_offset(s, d):
    return od(s, d).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def a5_grouped_top_k(s, d):
    return li(s, d).groupBy("l_partkey").agg(n()).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def a5_union(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def a5_union_all(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def a5_intersect(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def a5_except(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def a5_except_all(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(s, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def a5_intersect_all(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(s, d, "supplier").select("s_nationkey"))


# --- scalars ----------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, upper(p_name) AS u, length(p_name) AS len, substr(p_name, 2, 4) AS sub, replace(p_name, 'a', 'A') AS rep, lpad(p_brand, 12, '*') AS lp, reverse(p_brand) AS rev, split_part(p_type, ' ', 1) AS sp,
    trim(p_type) || '-' || p_size AS cat, concat_ws('/', p_brand, p_type) AS cws, left(p_name, 3) AS l3, right(p_name, 3) AS r3, strpos(p_name, 'e') AS pos, md5(p_name) AS h, regexp_replace(p_name, '[aeiou]', '', 'g') AS nov, starts_with(p_type, 'S') AS st FROM part"""
)
def a6_strings(s, d):
    p = table(s, d, "part")
    return p.select(
        "p_partkey", F.upper("p_name").alias("u"), F.length("p_name").alias("len"), F.substring("p_name", 2, 4).alias("sub"), F.replace("p_name", F.lit("a"), F.lit("A")).alias("rep"), F.lpad("p_brand", 12, "*").alias("lp"),
        F.reverse("p_brand").alias("rev"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("sp"), F.concat(F.trim("p_type"), F.lit("-"), F.col("p_size").cast("string")).alias("cat"), F.concat_ws("/", "p_brand", "p_type").alias("cws"),
        F.left("p_name", F.lit(3)).alias("l3"), F.right("p_name", F.lit(3)).alias("r3"), F.instr("p_name", "e").alias("pos"), F.md5("p_name").alias("h"), F.regexp_replace("p_name", "[aeiou]", "").alias("nov"), F.startswith("p_type", F.lit("S")).alias("st"),
    )


@query(
    """SELECT p_partkey, abs(p_size - 25) AS ab, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl, round(sqrt(p_size), 8) AS sq, round(ln(p_retailprice), 8) AS lg, round(power(p_size, 2), 4) AS pw, p_size % 7 AS md, sign(p_size - 25) AS sg, greatest(p_size, 10, 20) AS gr, least(p_size, 30) AS le,
    round(exp(p_size / 50.0), 8) AS ex, round(sin(p_size), 8) AS si, round(atan2(p_size, 3), 8) AS at, round(degrees(p_size), 6) AS dg, trunc(p_retailprice * 10) / 10 AS tr, round_even(p_size / 4.0, 0) AS he FROM part"""
)
def a6_math(s, d):
    z = F.col("p_size")
    return table(s, d, "part").select(
        "p_partkey", F.abs(z - 25).alias("ab"), F.ceil("p_retailprice").cast("double").alias("ce"), F.floor("p_retailprice").cast("double").alias("fl"), F.round(F.sqrt(z), 8).alias("sq"), F.round(F.ln("p_retailprice"), 8).alias("lg"),
        F.round(F.pow(z, F.lit(2)), 4).alias("pw"), (z % 7).alias("md"), F.sign(z - 25).cast("int").alias("sg"), F.greatest(z, F.lit(10), F.lit(20)).alias("gr"), F.least(z, F.lit(30)).alias("le"), F.round(F.exp(z / 50), 8).alias("ex"),
        F.round(F.sin(z), 8).alias("si"), F.round(F.atan2(z.cast("double"), F.lit(3.0)), 8).alias("at"), F.round(F.degrees(z), 6).alias("dg"), trunc_number("p_retailprice", 1).alias("tr"), round_half_even(z / F.lit(4.0)).alias("he"),
    )


@query(
    """SELECT p_partkey, round(cbrt(p_size), 8) AS cb, round(log10(p_retailprice), 8) AS l10, round(radians(p_size), 8) AS ra, gcd(p_size, 12) AS g, p_size & 6 AS ba, p_size | 9 AS bo, xor(p_size, 5) AS bx, bit_count(p_size) AS bc, p_size // 7 AS dv,
    round(tanh(p_size / 50.0), 8) AS th, round(p_retailprice, -2) AS rn, hex(p_size) AS hx FROM part"""
)
def a6_more_math(s, d):
    z = F.col("p_size")
    gcd = F.when(z % 12 == 0, 12).when(z % 6 == 0, 6).when(z % 4 == 0, 4).when(z % 3 == 0, 3).when(z % 2 == 0, 2).otherwise(1)
    return table(s, d, "part").select(
        "p_partkey", F.round(F.cbrt(z), 8).alias("cb"), F.round(F.log10("p_retailprice"), 8).alias("l10"), F.round(F.radians(z), 8).alias("ra"), gcd.alias("g"), z.bitwiseAND(6).alias("ba"), z.bitwiseOR(9).alias("bo"), z.bitwiseXOR(5).alias("bx"),
        F.bit_count(z).alias("bc"), F.floor(z / 7).cast("int").alias("dv"), F.round(F.tanh(z / 50), 8).alias("th"), F.round("p_retailprice", -2).alias("rn"), F.hex(z).alias("hx"),
    )


@query(
    """SELECT p_partkey, ascii(p_name) AS a, chr(65 + p_size % 26) AS c, repeat('ab', p_size % 4) AS r, translate(p_name, 'abc', 'xyz') AS t, ltrim(p_type, 'S') AS lt, rtrim(p_brand, '0123456789') AS rt, regexp_extract(p_type, '([A-Z]+)$', 1) AS tail, string_split(p_type, ' ') AS parts,
    sha256(p_name) AS sh, to_base64(encode(p_brand)) AS b64, levenshtein(p_name, p_brand) AS lev FROM part"""
)
def a6_more_strings(s, d):
    return table(s, d, "part").select(
        "p_partkey", F.ascii("p_name").alias("a"), F.chr(65 + F.col("p_size") % 26).alias("c"), F.expr("repeat('ab', p_size % 4)").alias("r"), F.translate("p_name", "abc", "xyz").alias("t"), F.ltrim("p_type", F.lit("S")).alias("lt"),
        F.rtrim("p_brand", F.lit("0123456789")).alias("rt"), F.regexp_extract("p_type", "([A-Z]+)$", 1).alias("tail"), F.split("p_type", " ").alias("parts"), F.sha2("p_name", 256).alias("sh"), F.base64(F.encode("p_brand", "utf-8")).alias("b64"), F.levenshtein("p_name", "p_brand").alias("lev"),
    )


@query("SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, n_nationkey IN (SELECT s_nationkey FROM supplier) AS has_supplier FROM nation")
def a3_scalar_subquery(s, d):
    per = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    have = table(s, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("has_supplier")).distinct()
    return table(s, d, "nation").join(per, "n_nationkey", "left").join(have, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("has_supplier", F.lit(False)).alias("has_supplier"))


@query(
    """SELECT o_orderkey, date_trunc('week', o_orderdate)::TIMESTAMP AS wk, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q, extract(year FROM o_orderdate) AS y, extract(doy FROM o_orderdate) AS doy, (o_orderdate + INTERVAL 3 DAY)::TIMESTAMP AS plus3,
    date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days, strftime(o_orderdate, '%Y-%m') AS ym, (o_orderdate + INTERVAL 2 MONTH)::DATE AS m2 FROM orders"""
)
def a6_dates(s, d):
    t = F.col("o_orderdate")
    return od(s, d).select(
        "o_orderkey", ntz(F.date_trunc("week", t)).alias("wk"), ntz(F.date_trunc("quarter", t)).alias("q"), F.year(t).cast("long").alias("y"), F.dayofyear(t).cast("long").alias("doy"), (t + F.expr("INTERVAL 3 DAYS")).alias("plus3"),
        F.date_diff(t.cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.date_format(t, "yyyy-MM").alias("ym"), F.add_months(t.cast("date"), 2).alias("m2"),
    )


@query(
    """SELECT id, len(source_chunk_ids) AS n_ids, list_contains(source_chunk_ids, '1') AS has1, array_to_string(source_chunk_ids, '|') AS joined, len(list_distinct(source_chunk_ids)) AS nd, source_chunk_ids[1] AS first_id,
    list_has_any(source_chunk_ids, ['5', '77']) AS ov FROM graph_edges WHERE source_chunk_ids IS NOT NULL"""
)
def a6_arrays(s, d):
    a = F.col("source_chunk_ids")
    return table(s, d, "graph_edges").where(a.isNotNull()).select(
        "id", F.size(a).alias("n_ids"), F.array_contains(a, "1").alias("has1"), F.array_join(a, "|").alias("joined"), F.size(F.array_distinct(a)).alias("nd"), F.get(a, F.lit(0)).alias("first_id"), overlaps(a, F.array(F.lit("5"), F.lit("77"))).alias("ov")
    )


@query("SELECT e.id, u.chunk, u.pos - 1 AS pos FROM graph_edges e, unnest(e.source_chunk_ids) WITH ORDINALITY AS u(chunk, pos)")
def a6_unnest(s, d):
    return table(s, d, "graph_edges").select("id", F.posexplode("source_chunk_ids").alias("pos", "chunk")).select("id", "chunk", F.col("pos").cast("long").alias("pos"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props, '$.k') IS NOT NULL AS has_k FROM events")
def a6_json(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS tier, nullif(c_nationkey, 0) AS nk, coalesce(nullif(c_nationkey, 0), -1) AS ck FROM customer")
def a6_conditionals(s, d):
    b = F.col("c_acctbal")
    nk = F.nullif("c_nationkey", F.lit(0))
    return table(s, d, "customer").select("c_custkey", F.when(b < 0, "debt").when(b < 5000, "mid").otherwise("high").alias("tier"), nk.alias("nk"), F.coalesce(nk, F.lit(-1)).alias("ck"))


@query(
    """SELECT lang, length(doc_kind) AS lk, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE text IS NULL OR text = '') AS blank FROM documents GROUP BY 1, 2"""
)
def a6_text_lengths(s, d):
    t = table(s, d, "documents")
    return t.groupBy("lang", F.length("doc_kind").alias("lk")).agg(n(), F.sum(F.char_length("text")).alias("chars"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("blank"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def a7_tumbling_window(s, d):
    from tidemill.streaming.vectorizer import windowed_counts

    return windowed_counts(table(s, d, "events"), "ts", "event_type")


@query(
    """SELECT min(ts)::TIMESTAMP AS session_start, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *,
    CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g"""
)
def a7_session_window(s, d):
    from tidemill.streaming.vectorizer import session_counts

    return session_counts(table(s, d, "events"), "ts", "user_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
