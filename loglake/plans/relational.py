"""The relational surface that comes with Spark, over the star schema: joins of every kind, cubes, sets, windows, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglake.model import table
from loglake.plans.book import Book

query = Book()
QUERIES, ORACLES = query.queries, query.oracles
_CENTS = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE)"


def _cents(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query(f"SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, {_CENTS} AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), _cents("l_extendedprice").alias("sum_price"), F.count("*").alias("n"))


@query(f"SELECT n_name, {_CENTS} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def join_inner(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(_cents("l_extendedprice").alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def join_left(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT coalesce(s_nationkey, c_nationkey) AS nation, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey AND s_suppkey % 10 = c_custkey % 10 GROUP BY ALL")
def join_full(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    j = s.join(c, (s.s_nationkey == c.c_nationkey) & (s.s_suppkey % 10 == c.c_custkey % 10), "full")
    return j.groupBy(F.coalesce("s_nationkey", "c_nationkey").alias("nation")).agg(F.countDistinct("s_suppkey").alias("suppliers"), F.countDistinct("c_custkey").alias("customers"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT e.event_id, count(*) AS near FROM events e JOIN events f ON e.user_id = f.user_id AND f.event_id > e.event_id AND f.event_id <= e.event_id + 500 GROUP BY ALL")
def join_range(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    w = Window.partitionBy("user_id").orderBy("event_id").rangeBetween(1, 500)
    return e.withColumn("near", F.count("*").over(w)).where("near > 0").select("event_id", "near")


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def rollup(spark, d):
    return table(spark, d, "customer").rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def set_except(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS k FROM orders) WHERE k <= 3")
def window_topk(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("k")).where("k <= 3")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 12")
def having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def count_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT label, count(*) AS n, max(len(embedding)) AS dims FROM embeddings GROUP BY ALL")
def array_functions(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dims"))
