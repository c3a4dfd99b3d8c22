"""Relational queries over the star schema: the SQL surface that the engine inherits from Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def sql(text: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query by SQL text; tables are read only when it runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return run


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = read(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        li.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(net), 2).alias("sum_disc_price"),
            F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
        )
    )


PRICING = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
 round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""

FIVE_JOIN = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"""


def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = read(spark, sf_dir, "orders", "lineitem")
    late = li.where(F.col("l_returnflag") == "R").select("l_orderkey")
    return o.join(late, o.o_orderkey == late.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))


def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer", "orders")
    o = o.where("o_orderstatus = 'F' AND o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = read(spark, sf_dir, "documents", "embeddings")
    return d.select("doc_id", "lang").join(e.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has")), "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count("has").alias("embedded"))


def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer", "supplier")
    a = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2).select("o_custkey", "o_orderkey", "o_totalprice", "rn")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        "o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice").over(w).alias("after"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("run3"),
        F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("nt"), F.first("o_orderkey").over(w).alias("first_key"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"),
    )


WINDOWS = """SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run3,
 CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS nt, first_value(o_orderkey) OVER w AS first_key, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = read(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer", "supplier")
    a, b = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    both, only, every = a.intersect(b).withColumn("kind", F.lit("intersect")), a.subtract(b).withColumn("kind", F.lit("except")), a.union(b).distinct().withColumn("kind", F.lit("union"))
    return both.unionByName(only).unionByName(every)


def json_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"), F.count(k).alias("k_count"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "rel_pricing_summary": (pricing_summary, PRICING),
    "rel_five_join": (sql(FIVE_JOIN, "customer", "orders", "lineitem", "supplier", "nation", "region"), FIVE_JOIN),
    "rel_semi_join": (semi, "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1"),
    "rel_anti_join": (anti, "SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000) GROUP BY 1"),
    "rel_left_coverage": (coverage, "SELECT lang, count(*) AS documents, count(vec_id) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1"),
    "rel_full_outer": (full_outer, "SELECT coalesce(a.k, b.k) AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k"),
    "rel_rollup": (
        sql("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem"),
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    ),
    "rel_cube": (
        sql("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)", "customer"),
        "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    ),
    "rel_top_per_group": (top_per_group, "SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2"),
    "rel_windows": (windows, WINDOWS),
    "rel_pivot": (pivot, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1"),
    "rel_set_ops": (set_ops, "(SELECT k, 'intersect' AS kind FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)) UNION ALL (SELECT k, 'except' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)) UNION ALL (SELECT k, 'union' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier))"),
    "rel_recursive_cte": (
        sql("WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t"),
        "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    ),
    "rel_correlated": (
        sql("SELECT o_orderpriority, count(*) AS n FROM orders o WHERE o_totalprice > (SELECT avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey) GROUP BY 1", "orders"),
        "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE o_totalprice > (SELECT avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey) GROUP BY 1",
    ),
    "rel_conditional_aggregates": (
        sql("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(DISTINCT o_custkey) AS customers, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END), 2) AS urgent, array_join(array_sort(collect_set(o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1", "orders"),
        "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(DISTINCT o_custkey) AS customers, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END), 2) AS urgent, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1",
    ),
    "rel_date_functions": (
        sql("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, max(datediff(DATE '2010-01-01', CAST(o_orderdate AS DATE))) AS oldest FROM orders GROUP BY 1, 2", "orders"),
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n, CAST(max(date_diff('day', CAST(o_orderdate AS DATE), DATE '2010-01-01')) AS INTEGER) AS oldest FROM orders GROUP BY 1, 2",
    ),
    "rel_string_functions": (
        sql("SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, instr(p_name, ' ') AS i, substring(p_name, 2, 3) AS s, replace(p_brand, '#', '-') AS r, p_name LIKE '%ring%' AS has, concat_ws('|', p_brand, p_type) AS c FROM part", "part"),
        "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS INTEGER) AS n, CAST(instr(p_name, ' ') AS INTEGER) AS i, substring(p_name, 2, 3) AS s, replace(p_brand, '#', '-') AS r, p_name LIKE '%ring%' AS has, concat_ws('|', p_brand, p_type) AS c FROM part",
    ),
    "rel_math_functions": (
        sql("SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, sign(c_acctbal) AS g, round(power(c_acctbal / 1000, 2), 6) AS p, nullif(c_nationkey, 0) AS z, greatest(c_acctbal, 0.0D) AS w FROM customer", "customer"),
        "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(sign(c_acctbal) AS DOUBLE) AS g, round(power(c_acctbal / 1000, 2), 6) AS p, nullif(c_nationkey, 0) AS z, greatest(c_acctbal, 0.0) AS w FROM customer",
    ),
    "rel_json": (json_access, "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max, count(json_extract_string(props, '$.k')) AS k_count FROM events GROUP BY 1"),
    "rel_lateral": (
        sql("SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3) t", "nation", "customer"),
        "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3) t",
    ),
}
