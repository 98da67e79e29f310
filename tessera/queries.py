"""Queries for every operator over the star tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import types as ty
from tessera.errors import RuleBroken
from tessera.api.objects import Objects
from tessera.api.query import Query, col, scan
from tessera.functions import scalar as sc
from tessera.functions.equality import Eq, Order
from tessera.functions.text import ANY, literal_text, matches, tokenize
from tessera.operators import dependencies, exact, fixpoint, rules
from tessera.operators.paging import OrderedView
from tessera.plans import nodes as n
from tessera.schema import SET, Entity, Field, Relation
from tessera.sources import migrate
from tessera.sources.catalog import Catalog, star
from tessera.sources.changelog import Store, added
from tessera.sources.index import Index
from tessera.sources.store import new_path
from tessera.streaming import zset as z
from tessera.streaming.maintained import Maintained
from tessera.streaming.watch import delta

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Run, str | None]] = {}


def query(sql: str | None) -> Callable[[Run], Run]:
    def add(f: Run) -> Run:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _q(spark: SparkSession, d: str, name: str) -> Query:
    return scan(star(spark, d, name), name)


def _set(spark: SparkSession, d: str, name: str, *columns: str) -> Query:
    """Columns of a table as a set."""
    return _q(spark, d, name).select(*columns).distinct()


def objects(spark: SparkSession, d: str) -> Catalog:
    """Customers, nations, regions and orders as objects; customers have many orders."""
    c = star(spark, d, "region", "nation", "customer", "orders")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    c.frame(Relation("customer_orders", (("source_id", ty.I64), ("target_id", ty.I64)), SET), orders.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id")))
    c.schema = c.schema.with_entity(
        Entity("Region", "region", "r_regionkey"),
        Entity("Nation", "nation", "n_nationkey", (Field("n_regionkey", ty.I64, target="Region"),)),
        Entity("Customer", "customer", "c_custkey", (Field("c_nationkey", ty.I64, target="Nation"), Field("orders", many="customer_orders", target="Order"))),
        Entity("Order", "orders", "o_orderkey"),
    )
    return c


# indexes


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def index_lookup(spark, d):
    c = star(spark, d, "orders", "supplier")
    orders = c.read("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    r = Relation("orders", (("o_orderkey", ty.I64), ("o_custkey", ty.I64), ("o_totalprice", ty.F64)))
    return Index(r, ("o_custkey",), orders).lookup(c.read("supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("o_custkey")))


@query("SELECT c_custkey, k, n FROM customer JOIN (SELECT lower(c_mktsegment) AS k, count(*) AS n FROM customer GROUP BY 1) ON lower(c_mktsegment) = k")
def index_join(spark, d):
    """Customers by segment without regard to case, looked up by segments spelled otherwise."""
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    r = Relation("customer", (("c_custkey", ty.I64), ("c_mktsegment", ty.TEXT)), "bag", (Eq("i64"), Eq("text_ci")))
    spelled = customers.groupBy(F.lower("c_mktsegment").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return Index(r, ("c_mktsegment",), customers).join(spelled, ("k",)).select("c_custkey", "k", "n")


# the flagship


@query("SELECT c_mktsegment, n FROM (SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1) QUALIFY rank() OVER (ORDER BY n DESC) <= 3")
def flagship_topk_segments(spark, d):
    c = star(spark, d, "orders", "customer")
    big = scan(c, "orders").where(col("o_totalprice") > 100000.0).select("o_custkey")
    return big.join(scan(c, "customer"), ("o_custkey", "c_custkey")).group("c_mktsegment").count("n").top(3, "n").frame()


# filters and projections


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_eq_const(spark, d):
    return _q(spark, d, "orders").where(col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus").frame()


def _order_filter(name: str, op: str) -> None:
    @query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity {op} 25.0")
    def run(spark, d):
        q = _q(spark, d, "lineitem")
        p = {"<": col("l_quantity") < 25.0, "<=": col("l_quantity") <= 25.0, ">": col("l_quantity") > 25.0, ">=": col("l_quantity") >= 25.0}[op]
        return q.where(p).select("l_orderkey", "l_linenumber", "l_quantity").frame()

    _QUERIES[f"filter_order_{name}"] = _QUERIES.pop("run")


for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _order_filter(_name, _op)


@query("SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(spark, d):
    return _q(spark, d, "part").where(col("p_size").between(10, 20)).select("p_partkey", "p_size").frame()


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey = l_linenumber")
def filter_eq_columns(spark, d):
    return _q(spark, d, "lineitem").where(col("l_suppkey") == col("l_linenumber")).select("l_orderkey", "l_partkey", "l_suppkey").frame()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_ci_text(spark, d):
    return _q(spark, d, "customer").where(col("c_mktsegment").ci() == "bUiLdInG").select("c_custkey", "c_mktsegment").frame()


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def filter_ne(spark, d):
    return _q(spark, d, "customer").where(col("c_mktsegment") != "BUILDING").select("c_custkey").frame()


@query("SELECT o_orderpriority, o_orderstatus FROM orders")
def project_bag(spark, d):
    return _q(spark, d, "orders").project("o_orderpriority", "o_orderstatus").frame()


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def project_set(spark, d):
    return _set(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").project("o_orderpriority", "o_orderstatus").frame()


@query("SELECT o_orderpriority FROM (SELECT DISTINCT o_orderkey, o_orderpriority FROM orders)")
def promote_to_bag(spark, d):
    return _set(spark, d, "orders", "o_orderkey", "o_orderpriority").to_bag().project("o_orderpriority").frame()


@query("SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_nationkey = 3 OR c_acctbal > 9000")
def pred_or_set(spark, d):
    q = _set(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    return q.where((col("c_nationkey") == 3) | (col("c_acctbal") > 9000.0)).project("c_custkey", "c_nationkey").frame()


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def pred_or_bag(spark, d):
    return _q(spark, d, "customer").where((col("c_nationkey") == 3) | (col("c_acctbal") > 9000.0)).select("c_custkey").frame()


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 150000)")
def pred_not(spark, d):
    return _q(spark, d, "orders").where(~((col("o_orderstatus") == "F") & (col("o_totalprice") > 150000.0))).select("o_orderkey").frame()


def _labelled(spark, d) -> Query:
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    both = docs.join(labels, "doc_id", "left").select("doc_id", F.col("quality").cast("long").alias("quality"))
    c = Catalog(spark)
    c.declare("labelled", both, options=("quality",))
    return scan(c, "labelled")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def option_is_none(spark, d):
    return _labelled(spark, d).where(col("quality").is_none()).select("doc_id").frame()


@query("SELECT d.doc_id, l.quality::BIGINT AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def option_is_some(spark, d):
    return _labelled(spark, d).where(col("quality").is_some()).frame()


# joins


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    c = star(spark, d, "orders", "customer")
    return scan(c, "orders").join(scan(c, "customer"), ("o_custkey", "c_custkey")).select("o_orderkey", "o_totalprice", "c_name").frame()


@query("SELECT l.l_orderkey, l.l_linenumber::BIGINT AS l_linenumber, s.s_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_nationkey = c.c_nationkey")
def join_multi_key(spark, d):
    c = star(spark, d, "lineitem", "orders", "customer", "supplier")
    left = scan(c, "lineitem").join(scan(c, "orders"), ("l_orderkey", "o_orderkey")).join(scan(c, "customer"), ("o_custkey", "c_custkey"))
    return left.join(scan(c, "supplier"), ("l_suppkey", "s_suppkey"), ("c_nationkey", "s_nationkey")).select("l_orderkey", "l_linenumber", "s_name").frame()


@query("SELECT a.o_orderkey, b.o_totalprice AS other FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey")
def join_self(spark, d):
    a = _q(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return a.join(a.rename(o_orderkey="k2", o_totalprice="other"), ("o_orderkey", "k2")).select("o_orderkey", "other").frame()


@query("SELECT a.event_id, coalesce(b.k, -1) AS k FROM (SELECT event_id, nullif(user_id % 7, 0) AS k FROM events) a JOIN (SELECT DISTINCT nullif(c_custkey % 7, 0) AS k FROM customer) b ON a.k IS NOT DISTINCT FROM b.k")
def join_optional(spark, d):
    c = Catalog(spark)
    c.declare("events", spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "nullif(user_id % 7, 0) as k"), options=("k",))
    c.declare("keys", spark.read.parquet(f"{d}/customer.parquet").selectExpr("nullif(c_custkey % 7, 0) as k2").distinct(), options=("k2",))
    return scan(c, "events").join(scan(c, "keys"), ("k", "k2")).frame().select("event_id", F.coalesce("k2", F.lit(-1)).alias("k"))


@query("SELECT r_name, n_name, s_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey")
def join_three_way(spark, d):
    c = star(spark, d, "region", "nation", "supplier")
    return scan(c, "region").join(scan(c, "nation"), ("r_regionkey", "n_regionkey")).join(scan(c, "supplier"), ("n_nationkey", "s_nationkey")).select("r_name", "n_name", "s_name").frame()


@query("SELECT c_custkey, segment, n FROM customer JOIN (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment, count(*) AS n FROM customer GROUP BY 1) ON lower(c_mktsegment) = lower(segment)")
def join_ci_text(spark, d):
    c = star(spark, d, "customer")
    c.declare("spelled", spark.read.parquet(f"{d}/customer.parquet").selectExpr("if(c_custkey % 2 = 0, lower(c_mktsegment), c_mktsegment) as segment"))
    return scan(c, "customer").join(scan(c, "spelled").group("segment").count("n"), ("c_mktsegment", "segment"), ci=True).select("c_custkey", "segment", "n").frame()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark, d):
    c = star(spark, d, "customer", "orders")
    return scan(c, "customer").semi_join(scan(c, "orders").where(col("o_totalprice") > 200000.0), "c_custkey", "o_custkey").select("c_custkey").frame()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 150000)")
def anti_join(spark, d):
    c = star(spark, d, "customer", "orders")
    large = scan(c, "orders").where((col("o_orderstatus") == "F") & (col("o_totalprice") > 150000.0))
    return scan(c, "customer").anti_join(large, "c_custkey", "o_custkey").select("c_custkey").frame()


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def ref_path_two_hops(spark, d):
    return Objects.of(objects(spark, d), "Customer").where_ref("c_nationkey.n_regionkey", col("r_name") == "ASIA").ids().frame()


_URGENT = "SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'"


@query(f"SELECT c_custkey FROM customer WHERE EXISTS ({_URGENT})")
def many_any(spark, d):
    return Objects.of(objects(spark, d), "Customer").any("orders", col("o_orderstatus") == "F").ids().frame()


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS ({_URGENT})")
def many_none(spark, d):
    return Objects.of(objects(spark, d), "Customer").none("orders", col("o_orderstatus") == "F").ids().frame()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 20000)")
def many_all(spark, d):
    return Objects.of(objects(spark, d), "Customer").all("orders", col("o_totalprice") > 20000.0).ids().frame()


def _count_filter(name: str, op: str, k: int, high: int | None, sql: str) -> None:
    @query(f"SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) {sql}")
    def run(spark, d):
        return Objects.of(objects(spark, d), "Customer").where_count("orders", op, k, high).ids().frame()

    _QUERIES[f"many_count_{name}"] = _QUERIES.pop("run")


for _args in (("eq", "=", 10, None, "= 10"), ("ne", "!=", 10, None, "<> 10"), ("lt", "<", 8, None, "< 8"), ("le", "<=", 8, None, "<= 8"), ("gt", ">", 12, None, "> 12"), ("ge", ">=", 12, None, ">= 12"), ("between", "between", 0, 9, "BETWEEN 0 AND 9")):
    _count_filter(*_args)


# aggregates


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def group_count(spark, d):
    return _q(spark, d, "orders").group("o_orderpriority").count("n").frame()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_composite(spark, d):
    return _q(spark, d, "lineitem").group("l_returnflag", "l_linestatus").count("n").frame()


@query("SELECT lower(c_mktsegment) AS segment, count(*) AS n FROM customer GROUP BY 1")
def group_count_ci(spark, d):
    df = spark.read.parquet(f"{d}/customer.parquet").selectExpr("if(c_custkey % 2 = 0, lower(c_mktsegment), c_mktsegment) as segment")
    c = Catalog(spark)
    c.declare("segments", df)
    return scan(c, "segments").group("segment", ci=("segment",)).count("n").frame().select(F.lower("segment").alias("segment"), "n")


@query("SELECT l_returnflag, round(sum(l_quantity::DECIMAL(18,2)), 2)::DOUBLE AS total FROM lineitem GROUP BY 1")
def group_exact_sum(spark, d):
    return _q(spark, d, "lineitem").group("l_returnflag").exact_sum("l_quantity", "total").frame()


@query("SELECT l_returnflag, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY 1")
def group_decimal_sum(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    return exact.decimal_sum(df, ["l_returnflag"], "l_extendedprice", 2, "total").select("l_returnflag", F.col("total").cast("double").alias("total"))


@query("SELECT g, s FROM (VALUES (1, 1.0::DOUBLE), (2, 0.0::DOUBLE)) t(g, s)")
def exact_sum_cancels(spark, d):
    c = Catalog(spark)
    c.declare("v", spark.createDataFrame([(1, 1e16), (1, 1.0), (1, -1e16), (2, 0.1), (2, -0.1)], "g int, x double"))
    return scan(c, "v").group("g").exact_sum("x", "s").frame().select(F.col("g").cast("int").alias("g"), "s")


@query("SELECT count(*) AS n FROM lineitem")
def global_count(spark, d):
    return _q(spark, d, "lineitem").group().count("n").frame()


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 1000")
def global_count_empty(spark, d):
    return _q(spark, d, "lineitem").where(col("l_quantity") > 1000.0).group().count("n").frame()


@query("SELECT coalesce(sum(l_quantity), 0.0)::DOUBLE AS total FROM lineitem WHERE l_quantity > 1000")
def global_sum_empty(spark, d):
    return _q(spark, d, "lineitem").where(col("l_quantity") > 1000.0).group().exact_sum("l_quantity", "total").frame()


@query("SELECT DISTINCT c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer")
def distinct_exact(spark, d):
    return _q(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct().frame()


@query("SELECT DISTINCT upper(p_brand) AS brand FROM part")
def distinct_ci(spark, d):
    c = Catalog(spark)
    c.declare("brands", spark.read.parquet(f"{d}/part.parquet").selectExpr("if(p_partkey % 2 = 0, lower(p_brand), upper(p_brand)) as brand"))
    return scan(c, "brands").distinct(ci=("brand",)).frame().select(F.upper("brand").alias("brand"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 5")
def group_top(spark, d):
    return _q(spark, d, "orders").group("o_custkey").count("n").top(5, "n").frame()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*)) <= 5")
def group_bottom(spark, d):
    return _q(spark, d, "orders").group("o_custkey").count("n").bottom(5, "n").frame()


def _statistic(name: str, statistic: str, at: float, sql: str) -> None:
    @query(f"SELECT o_orderpriority, o_totalprice AS stat FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE i = {sql}")
    def run(spark, d):
        return exact.order_statistic(spark.read.parquet(f"{d}/orders.parquet"), ["o_orderpriority"], "o_totalprice", F.col("o_totalprice"), statistic, at)

    _QUERIES[f"order_stat_{name}"] = _QUERIES.pop("run")


for _args in (("min", "min", 0, "0"), ("max", "max", 0, "n - 1"), ("kth_start", "kth_start", 4, "4"), ("kth_end", "kth_end", 4, "n - 1 - 4"), ("lower_quantile", "lower_quantile", 0.4, "floor(0.4::DOUBLE * (n - 1))")):
    _statistic(*_args)


@query("SELECT o_orderstatus, count(*) FILTER (o_totalprice > 100000) AS big, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_totalprice > 100000), 0)::DOUBLE AS total FROM orders GROUP BY 1")
def conditional_measures(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet")
    big = F.col("o_totalprice") > 100000
    total = exact.decimal_sum(df.withColumn("v", F.when(big, F.col("o_totalprice"))), ["o_orderstatus"], "v", 2, "total")
    n_big = df.groupBy("o_orderstatus").agg(F.count_if(big).alias("big"))
    return n_big.join(total, "o_orderstatus").select("o_orderstatus", "big", F.col("total").cast("double").alias("total"))


@query("SELECT n_regionkey::BIGINT AS n_regionkey, sum(c.k * s.k)::BIGINT AS n FROM nation JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey GROUP BY 1")
def factorized_count(spark, d):
    """Join sizes without the join: both sides are counted by key first."""
    c, s, nat = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "supplier", "nation"))
    a = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("x"))
    b = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("y"))
    return nat.join(a, F.col("n_nationkey") == a.k).drop("k").join(b, F.col("n_nationkey") == b.k).groupBy(F.col("n_regionkey").cast("long").alias("n_regionkey")).agg(F.sum(F.col("x") * F.col("y")).alias("n"))


# top-k, pages, set operations


@query("SELECT o_orderkey, o_orderpriority FROM orders QUALIFY rank() OVER (ORDER BY o_orderpriority DESC) <= 10")
def topk_ties(spark, d):
    return _q(spark, d, "orders").top(10, "o_orderpriority").select("o_orderkey", "o_orderpriority").frame()


@query("SELECT p_partkey, p_size::BIGINT AS p_size FROM part QUALIFY rank() OVER (ORDER BY p_size) <= 7")
def bottomk_ties(spark, d):
    return _q(spark, d, "part").bottom(7, "p_size").select("p_partkey", "p_size").frame()


@query("SELECT o_orderkey FROM orders WHERE false")
def topk_zero(spark, d):
    return _q(spark, d, "orders").top(0, "o_totalprice").select("o_orderkey").frame()


def _pages(spark, d) -> OrderedView:
    q = _q(spark, d, "part").select("p_size", "p_brand")
    return OrderedView(q.frame(), q.type, 0, Order("i64"))


_PAGED = "SELECT p_size::BIGINT AS p_size, p_brand FROM (SELECT p_size, p_brand, row_number() OVER (ORDER BY p_size, p_brand) AS i FROM part) WHERE i"


@query(f"{_PAGED} <= 25")
def page_first(spark, d):
    return _pages(spark, d).frame(25).select("p_size", "p_brand")


@query(f"{_PAGED} BETWEEN 26 AND 50")
def page_after_cursor(spark, d):
    v = _pages(spark, d)
    return v.frame(25, v.page(25).next).select("p_size", "p_brand")


@query("SELECT p_size::BIGINT AS p_size, p_brand FROM (SELECT p_size, p_brand, row_number() OVER (ORDER BY p_size, p_brand) AS i FROM part WHERE p_partkey % 10 <> 0) WHERE i BETWEEN 26 AND 50")
def page_advanced(spark, d):
    """The second page of a view that a tenth of the parts has left."""
    q = _q(spark, d, "part").select("p_size", "p_brand")
    gone = _q(spark, d, "part").frame().where("p_partkey % 10 = 0").select(F.col("p_size").cast("long").alias("p_size"), "p_brand")
    v = OrderedView(q.frame(), q.type, 0, Order("i64")).advanced(z.weighted(gone, -1))
    return v.frame(25, v.page(25).next).select("p_size", "p_brand")


@query("SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_set(spark, d):
    return _set(spark, d, "customer", "c_nationkey").rename(c_nationkey="k").union(_set(spark, d, "supplier", "s_nationkey")).frame()


@query("SELECT l_orderkey AS k FROM lineitem UNION ALL SELECT o_orderkey FROM orders")
def union_bag(spark, d):
    return _q(spark, d, "lineitem").select("l_orderkey").rename(l_orderkey="k").union(_q(spark, d, "orders").select("o_orderkey")).frame()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def difference_set(spark, d):
    large = _q(spark, d, "orders").where((col("o_orderstatus") == "F") & (col("o_totalprice") > 150000.0)).select("o_custkey").distinct()
    return _set(spark, d, "customer", "c_custkey").rename(c_custkey="k").difference(large).frame()


@query("SELECT c_nationkey::BIGINT AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def difference_bag(spark, d):
    return _q(spark, d, "customer").select("c_nationkey").rename(c_nationkey="k").difference(_q(spark, d, "supplier").select("s_nationkey")).frame()


@query("SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_derived(spark, d):
    return _q(spark, d, "customer").select("c_nationkey").rename(c_nationkey="k").intersect(_q(spark, d, "supplier").select("s_nationkey")).frame()


# rules


@query("SELECT 'size' AS rule, p_partkey::VARCHAR AS witness, 1.0::DOUBLE AS mass FROM part WHERE NOT p_size BETWEEN 5 AND 45")
def rule_field_violations(spark, d):
    return rules.rows(spark.read.parquet(f"{d}/part.parquet"), "size", "p_partkey", rules.in_range(F.col("p_size"), 5, 45))


@query("SELECT 'segment' AS rule, c_custkey::VARCHAR AS witness, 1.0::DOUBLE AS mass FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def rule_one_of(spark, d):
    return rules.rows(spark.read.parquet(f"{d}/customer.parquet"), "segment", "c_custkey", rules.one_of(F.col("c_mktsegment"), "BUILDING", "MACHINERY"))


@query("SELECT 'name' AS rule, c_custkey::VARCHAR AS witness, 1.0::DOUBLE AS mass FROM customer WHERE NOT starts_with(c_mktsegment, 'B')")
def rule_text_pattern(spark, d):
    return rules.rows(spark.read.parquet(f"{d}/customer.parquet"), "name", "c_custkey", matches(F.col("c_mktsegment"), literal_text("B") + ANY.many()))


@query("SELECT 'length' AS rule, doc_id::VARCHAR AS witness, 1.0::DOUBLE AS mass FROM documents WHERE length(text) > 5000")
def rule_text_length(spark, d):
    return rules.rows(spark.read.parquet(f"{d}/documents.parquet"), "length", "doc_id", rules.text_length(F.col("text"), 0, 5000))


@query("SELECT 'fields' AS rule, o_orderkey::VARCHAR AS witness, 1.0::DOUBLE AS mass FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 50000")
def rule_across_fields(spark, d):
    return rules.rows(spark.read.parquet(f"{d}/orders.parquet"), "fields", "o_orderkey", (F.col("o_orderstatus") != "F") | (F.col("o_totalprice") >= 50000))


@query("SELECT 'few' AS rule, 'all' AS witness, (count(*) - 100)::DOUBLE AS mass FROM orders WHERE o_totalprice > 100000 HAVING count(*) > 100")
def rule_count_range(spark, d):
    return rules.count_range(spark.read.parquet(f"{d}/orders.parquet"), "few", F.col("o_totalprice") > 100000, high=100)


@query("SELECT 'some' AS rule, 'all' AS witness, 1.0::DOUBLE AS mass FROM orders HAVING count(*) FILTER (o_totalprice > 1e9) = 0")
def rule_exists(spark, d):
    return rules.exists(spark.read.parquet(f"{d}/orders.parquet"), "some", F.col("o_totalprice") > 1e9)


@query("SELECT 'positive' AS rule, 'all' AS witness, count(*)::DOUBLE AS mass FROM customer WHERE NOT c_acctbal > 0 HAVING count(*) > 0")
def rule_all(spark, d):
    return rules.every(spark.read.parquet(f"{d}/customer.parquet"), "positive", F.col("c_acctbal") > 0)


@query("SELECT 'per supplier' AS rule, l_suppkey::VARCHAR AS witness, (120 - count(*) FILTER (l_quantity > 40))::DOUBLE AS mass FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_quantity > 40) < 120")
def rule_grouped_count(spark, d):
    return rules.count_range(spark.read.parquet(f"{d}/lineitem.parquet"), "per supplier", F.col("l_quantity") > 40, low=120, by=("l_suppkey",))


@query("SELECT 'quantity' AS rule, l_returnflag AS witness, (sum(l_quantity::DECIMAL(18,2))::DOUBLE - 1000.0)::DOUBLE AS mass FROM lineitem GROUP BY l_returnflag HAVING sum(l_quantity) > 1000")
def rule_grouped_sum(spark, d):
    return rules.sum_range(spark.read.parquet(f"{d}/lineitem.parquet"), "quantity", "l_quantity", high=1000.0, by=("l_returnflag",))


@query("SELECT 'median' AS rule, o_orderstatus AS witness, (v - 1000.0)::DOUBLE AS mass FROM (SELECT o_orderstatus, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE i = floor(0.5::DOUBLE * (n - 1)) AND v > 1000")
def rule_grouped_statistic(spark, d):
    return rules.statistic_range(spark.read.parquet(f"{d}/orders.parquet"), "median", "o_totalprice", "lower_quantile", 0.5, high=1000.0, by=("o_orderstatus",))


@query("SELECT 'fewer suppliers' AS rule, 'all' AS witness, abs(a - b)::DOUBLE AS mass FROM (SELECT count(*) AS a FROM customer), (SELECT count(*) AS b FROM supplier) WHERE NOT a < b")
def rule_compare(spark, d):
    a, b = (spark.read.parquet(f"{d}/{t}.parquet").agg(F.count(F.lit(1))) for t in ("customer", "supplier"))
    return rules.compare(a, b, "fewer suppliers", lambda x, y: x < y)


@query("SELECT 'balance' AS rule, 'all' AS witness, greatest(abs(a - b), 1.0)::DOUBLE AS mass FROM (SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS a FROM orders), (SELECT sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS b FROM customer) WHERE NOT a <= b")
def rule_compare_sums(spark, d):
    total = lambda t, c: exact.exact_sum(spark.read.parquet(f"{d}/{t}.parquet"), {}, F.col(c), {}, "total")
    return rules.compare(total("orders", "o_totalprice"), total("customer", "c_acctbal"), "balance", lambda x, y: x <= y)


@query("SELECT 'medians' AS rule, 'all' AS witness, greatest(abs(a.v - b.v), 1.0)::DOUBLE AS mass FROM (SELECT o_totalprice AS v FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i = floor(0.5::DOUBLE * (n - 1))) a, (SELECT l_extendedprice AS v FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem) WHERE i = floor(0.5::DOUBLE * (n - 1))) b WHERE NOT a.v < b.v")
def rule_compare_statistics(spark, d):
    median = lambda t, c: exact.order_statistic(spark.read.parquet(f"{d}/{t}.parquet"), [], c, F.col(c), "lower_quantile", 0.5)
    return rules.compare(median("orders", "o_totalprice"), median("lineitem", "l_extendedprice"), "medians", lambda x, y: x < y)


@query("SELECT 'one order' AS rule, o_custkey::VARCHAR AS witness, (count(*) - 1)::DOUBLE AS mass FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def rule_uniqueness(spark, d):
    return rules.unique(spark.read.parquet(f"{d}/orders.parquet"), "one order", F.col("o_custkey"))


@query("SELECT 'label' AS rule, doc_id::VARCHAR AS witness, 1.0::DOUBLE AS mass FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def rule_dangling_ref(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return rules.dangling(docs, "label", "doc_id", "doc_id", labels, "doc_id")


# scalars


def _row(spark, d, name: str) -> tuple[DataFrame, ty.Product]:
    c = star(spark, d, name)
    r = c.schema.relation(name)
    return c.read(name).select(*[F.col(x).cast(t.spark()).alias(x) for x, t in r.columns]), ty.Product(r.columns)


@query("SELECT l_orderkey, (l_orderkey + l_linenumber)::BIGINT AS s FROM lineitem")
def scalar_add(spark, d):
    df, row = _row(spark, d, "lineitem")
    return df.select("l_orderkey", sc.Add(sc.field("l_orderkey"), sc.field("l_linenumber")).column(row).alias("s"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_name END AS s FROM part")
def scalar_if(spark, d):
    df = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "p_size > 25 as big", "p_brand", "p_name")
    row = ty.Product((("p_partkey", ty.I64), ("big", ty.BOOL), ("p_brand", ty.TEXT), ("p_name", ty.TEXT)))
    return df.select("p_partkey", sc.If(sc.field("big"), sc.field("p_brand"), sc.field("p_name")).column(row).alias("s"))


@query("SELECT vec_id, len(embedding)::BIGINT AS k FROM embeddings")
def seq_length(spark, d):
    df, row = _row(spark, d, "embeddings")
    return df.select("vec_id", sc.Length(sc.field("embedding")).column(row).alias("k"))


@query("SELECT p_partkey, (p_size * (p_size + 1) // 2)::BIGINT AS s FROM part")
def seq_sum(spark, d):
    df = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "sequence(1L, cast(p_size as bigint)) as ids")
    row = ty.Product((("p_partkey", ty.I64), ("ids", ty.Seq(ty.I64))))
    return df.select("p_partkey", sc.SumI64(sc.field("ids")).column(row).alias("s"))


@query("SELECT p_partkey, p_size::DOUBLE AS x FROM part")
def i64_to_f64(spark, d):
    df, row = _row(spark, d, "part")
    return df.select("p_partkey", sc.ToF64(sc.field("p_size")).column(row).alias("x"))


@query("SELECT conv_id, turn::BIGINT AS turn, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> ''))::BIGINT AS k FROM conversations")
def tokenize_words(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), F.size(tokenize(F.col("text"))).cast("long").alias("k"))


@query("SELECT role, word, count(*) AS k FROM (SELECT role, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\f\\r]+'), lambda x: x <> '')) AS word FROM conversations) GROUP BY 1, 2")
def tokenize_lower(spark, d):
    words = spark.read.parquet(f"{d}/conversations.parquet").select("role", F.explode(tokenize(F.col("text"), lower=True)).alias("word"))
    return words.groupBy("role", "word").agg(F.count(F.lit(1)).alias("k"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS tag, CASE WHEN p_size > 25 THEN p_size ELSE -1 END::BIGINT AS big, CASE WHEN p_size <= 25 THEN p_size ELSE -1 END::BIGINT AS small, '-' AS none FROM part")
def widen_sum(spark, d):
    small = ty.Sum((("big", ty.I64), ("small", ty.I64)))
    wide = ty.Sum((*small.variants, ("none", ty.TEXT)))
    size = F.col("p_size").cast("long")
    v = F.struct(F.when(size > 25, "big").otherwise("small").alias("tag"), F.when(size > 25, size).alias("big"), F.when(size <= 25, size).alias("small"))
    df = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", v.alias("v"))
    out = sc.Widen(sc.field("v"), wide).column(ty.Product((("p_partkey", ty.I64), ("v", small))))
    absent = lambda c, x: F.coalesce(F.col(f"v.{c}"), F.lit(x)).alias(c)
    return df.select("p_partkey", out.alias("v")).select("p_partkey", "v.tag", absent("big", -1), absent("small", -1), absent("none", "-"))


# history and changes: events as a log, ten revisions by event_id


def _log(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return e.withColumns({"rev": F.pmod("event_id", F.lit(10)), z.W: F.lit(1).cast("long")})


def _store(spark, d) -> Store:
    """Events by event_id modulo 10: 0 to 4 are the base, 5, 6 and 7 come by revisions 1 to 3, and revision 4 takes away 0."""
    log = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")
    part = lambda *k: log.where(F.pmod("event_id", F.lit(10)).isin(*k))
    store = Store(spark, new_path(spark, "events"))
    store.create("events", part(0, 1, 2, 3, 4))
    for k in (5, 6, 7):
        store.commit(f"t{k}", {"events": added(part(k))})
    store.delete("t0", "events", F.pmod("event_id", F.lit(10)) == 0)
    return store


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <= 6")
def at_revision(spark, d):
    return _store(spark, d).at("events", 2).select("event_id", "user_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 <= 6 UNION ALL SELECT event_id, 'late' AS event_type FROM events WHERE event_id % 10 = 7")
def commit_undo(spark, d):
    """The deletion is undone, then what revision 3 brought is updated; folding leaves the rows as they are."""
    store = _store(spark, d)
    store.undo_latest()
    store.update("late", "events", F.pmod("event_id", F.lit(10)) == 7, {"event_type": F.lit("late")})
    store.compacted("events")
    return store.at("events").select("event_id", "event_type")


@query("SELECT 'kept' AS outcome, count(*) AS n FROM events WHERE event_id % 10 BETWEEN 1 AND 7 UNION ALL SELECT 'refused', count(*) FROM events WHERE event_id % 10 = 8 AND value > 100")
def commit_rules(spark, d):
    """A commit that breaks a required rule is refused and its preview names what breaks it; the store keeps its rows."""
    store = _store(spark, d)
    more = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value").where("event_id % 10 = 8")
    high = lambda read: rules.rows(read("events"), "value", "event_id", (F.pmod("event_id", F.lit(10)) != 8) | (F.col("value") <= 100))
    store.require("value", ("events",), high)
    try:
        store.commit("t8", {"events": added(more)})
        left = spark.range(0).selectExpr("'committed' as witness")
    except RuleBroken:
        left = high(store.preview({"events": added(more)}).rows)
    count = lambda df, name: df.agg(F.lit(name).alias("outcome"), F.count(F.lit(1)).alias("n"))
    return count(store.at("events"), "kept").unionByName(count(left, "refused"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 <> 0 UNION ALL SELECT -o_orderkey, 1.0 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 0")
def view_put_back(spark, d):
    """A filtered and projected view loses some rows and gains others; the orders are changed so that the view is as asked."""
    c = Catalog(spark)
    c.declare("orders", spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    view = scan(c, "orders").where(col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus", "o_totalprice")
    gone = view.frame().where("o_orderkey % 10 = 0")
    asked = z.change(gone.selectExpr("-o_orderkey as o_orderkey", "o_orderstatus", "cast(1.0 as double) as o_totalprice"), gone)
    made = migrate.put_back(c.schema, view.plan, asked.toDF("c0", "c1", "c2", z.W), c.read, {"o_custkey": 0})
    after = c.with_rows({k: z.expand(z.plus(z.weighted(c.read(k)), ch)) for k, ch in made.items()})
    return Query(after, view.plan, view.names).frame().select("o_orderkey", "o_totalprice")


@query("SELECT event_type, n, w FROM (SELECT event_type, count(*) AS n, 1::BIGINT AS w FROM events GROUP BY 1 UNION ALL SELECT event_type, count(*) AS n, -1::BIGINT AS w FROM events WHERE event_id % 10 <= 6 GROUP BY 1)")
def delta_recompute(spark, d):
    count = lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return z.recomputed(count(_log(spark, d).where("rev <= 6")), count(_log(spark, d))).select("event_type", "n", F.col(z.W).alias("w"))


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE event_id % 10 <= 5 UNION ALL SELECT event_type FROM events WHERE event_id % 10 = 8) GROUP BY 1")
def candidate_query(spark, d):
    base = _log(spark, d).where("rev <= 5").select("event_id", "event_type")
    pending = _log(spark, d).where("rev = 8").select("event_id", "event_type", z.W)
    c = Catalog(spark)
    c.declare("events", base)
    after = c.with_rows({"events": z.expand(z.plus(z.weighted(base), pending))})
    return scan(after, "events").group("event_type").count("n").frame()


@query("SELECT (count(*) FILTER (k > 1) = 0) AS holds, count(*) AS classes, count(*) FILTER (k > 1) AS broken FROM (SELECT p_partkey, count(DISTINCT p_brand) AS k FROM part GROUP BY 1)")
def fd_holds(spark, d):
    return dependencies.determines(spark.read.parquet(f"{d}/part.parquet"), {"k": F.col("p_partkey")}, {"b": F.col("p_brand")})


@query("SELECT (count(*) FILTER (k > 1) = 0) AS holds, count(*) AS classes, count(*) FILTER (k > 1) AS broken FROM (SELECT p_brand, count(DISTINCT p_type) AS k FROM part GROUP BY 1)")
def fd_violated(spark, d):
    return dependencies.determines(spark.read.parquet(f"{d}/part.parquet"), {"k": F.col("p_brand")}, {"t": F.col("p_type")})


@query("SELECT p_brand, sum(n)::BIGINT AS mass, count(*) AS classes FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def relation_fibers(spark, d):
    m = dependencies.measure(spark.read.parquet(f"{d}/part.parquet"), {"p_brand": F.col("p_brand"), "p_type": F.col("p_type")})
    return dependencies.fibers(m, ["p_brand"])


# incremental maintenance: base is revisions 0 to 6, each later revision a step; the sum of all changes is added to the first result


def _maintained(spark, d, make: Callable[[Query], Query]) -> DataFrame:
    log = _log(spark, d)
    names = ["event_id", "user_id", "event_type", "value"]
    c = Catalog(spark)
    c.declare("events", log.where("rev <= 6").select(*names))
    q = make(scan(c, "events"))
    total, known = z.weighted(q.frame()), log.where("rev <= 6").select(*names, z.W)
    for r in (7, 8, 9):
        change = log.where(F.col("rev") == r).select(*names, z.W)
        total = total.unionByName(delta(q, None, {"events": change}, lambda name, k=known: k if name == "events" else z.weighted(q.catalog.read(name))))
        known = known.unionByName(change)
    return z.expand(z.compact(total))


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def inc_filter(spark, d):
    return _maintained(spark, d, lambda q: q.where(col("event_type") == "click").select("event_id", "value"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def inc_distinct(spark, d):
    return _maintained(spark, d, lambda q: q.select("user_id", "event_type").distinct())


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def inc_join(spark, d):
    def make(q: Query) -> Query:
        q.catalog.declare("customer", spark.read.parquet(f"{d}/customer.parquet"))
        return q.join(scan(q.catalog, "customer"), ("user_id", "c_custkey")).select("event_id", "c_name")

    return _maintained(spark, d, make)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def inc_group(spark, d):
    return _maintained(spark, d, lambda q: q.group("user_id").count("n"))


@query("SELECT user_id, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1")
def inc_exact_sum(spark, d):
    return _maintained(spark, d, lambda q: q.group("user_id").exact_sum("value", "total"))


@query("SELECT a.event_id, coalesce(b.k, -1) AS k FROM (SELECT event_id, nullif(user_id % 7, 0) AS k FROM events) a JOIN (SELECT DISTINCT nullif(c_custkey % 7, 0) AS k FROM customer) b ON a.k IS NOT DISTINCT FROM b.k")
def inc_join_optional(spark, d):
    """Null keys meet null keys in changes too."""
    log = _log(spark, d).selectExpr("event_id", "nullif(user_id % 7, 0) as k", "rev", z.W)
    c = Catalog(spark)
    c.declare("events", log.where("rev <= 6").select("event_id", "k"), options=("k",))
    c.declare("keys", spark.read.parquet(f"{d}/customer.parquet").selectExpr("nullif(c_custkey % 7, 0) as k2").distinct(), options=("k2",))
    q = scan(c, "events").join(scan(c, "keys"), ("k", "k2")).select("event_id", "k2").rename(k2="k")
    change = log.where("rev > 6").select("event_id", "k", z.W)
    return z.expand(z.plus(z.weighted(q.frame()), delta(q, c.read, {"events": change}))).select("event_id", F.coalesce("k", F.lit(-1)).alias("k"))


@query("SELECT event_id, value FROM events QUALIFY rank() OVER (ORDER BY value DESC) <= 20")
def inc_topk(spark, d):
    return _maintained(spark, d, lambda q: q.select("event_id", "value").top(20, "value"))


@query("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'click'")
def inc_difference(spark, d):
    def make(q: Query) -> Query:
        return q.where(col("event_type") == "view").select("user_id").difference(q.where(col("event_type") == "click").select("user_id"))

    return _maintained(spark, d, make)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def inc_antijoin(spark, d):
    def make(q: Query) -> Query:
        q.catalog.declare("customer", spark.read.parquet(f"{d}/customer.parquet"))
        return scan(q.catalog, "customer").anti_join(q, "c_custkey", "user_id").select("c_custkey")

    return _maintained(spark, d, make)


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1) QUALIFY rank() OVER (ORDER BY n DESC) <= 2")
def inc_join_group_topk(spark, d):
    def make(q: Query) -> Query:
        q.catalog.declare("customer", spark.read.parquet(f"{d}/customer.parquet"))
        return q.join(scan(q.catalog, "customer"), ("user_id", "c_custkey")).group("event_type").count("n").top(2, "n")

    return _maintained(spark, d, make)


@query("SELECT 'counts' AS watch, event_type AS k, count(*)::DOUBLE AS v FROM events JOIN customer ON user_id = c_custkey GROUP BY 2 UNION ALL SELECT 'sums', event_type, sum(value::DECIMAL(18,2))::DOUBLE FROM events JOIN customer ON user_id = c_custkey GROUP BY 2 UNION ALL SELECT 'top', event_id::VARCHAR, value FROM events QUALIFY rank() OVER (ORDER BY value DESC) <= 20")
def inc_shared_state(spark, d):
    """Three queries, two of them over one join, advanced together through three changes; states are stored tables, the join's is kept once."""
    log = _log(spark, d).select("event_id", "user_id", "event_type", "value", "rev", z.W)
    c = star(spark, d, "customer")
    c.declare("events", log.where("rev <= 6").select("event_id", "user_id", "event_type", "value"))
    both = scan(c, "events").join(scan(c, "customer"), ("user_id", "c_custkey")).select("event_id", "event_type", "value")
    queries_ = {"counts": both.group("event_type").count("v"), "sums": both.group("event_type").exact_sum("value", "v"), "top": scan(c, "events").select("event_id", "value").top(20, "value")}
    kept = Maintained(queries_, lambda name: z.weighted(c.read(name)))
    results = {k: z.weighted(q.frame()) for k, q in queries_.items()}
    for r in (7, 8, 9):
        for k, change in kept.advance({"events": log.where(F.col("rev") == r).drop("rev")}).items():
            results[k] = results[k].unionByName(change)
    parts = [z.expand(z.compact(df)).toDF("k", "v").select(F.lit(k).alias("watch"), F.col("k").cast("string").alias("k"), F.col("v").cast("double").alias("v")) for k, df in results.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# recursion


@query("WITH RECURSIVE chain AS (SELECT conv_id, turn, 0 AS rank FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, rank + 1 FROM chain JOIN conversations c ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 1) SELECT DISTINCT conv_id::VARCHAR || ':' || turn::VARCHAR AS node, rank::INTEGER AS rank FROM chain")
def reachability(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn").distinct()
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    nodes = c.select(name(F.col("turn")).alias("node"))
    edges = c.select(name(F.col("turn") - 1).alias("src"), name(F.col("turn")).alias("dst")).join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    seeds = c.where("turn = 0").select(name(F.col("turn")).alias("node"))
    return fixpoint.reachability(seeds, edges).select("node", "rank")


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def lifecycle_live(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey = 3")
    roots = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    keeps = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    entities = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return fixpoint.live(entities, roots, keeps).select(F.substring("id", 2, 20).cast("long").alias("id"))


@query("SELECT 'r' || r_regionkey::VARCHAR AS atom, 1::BIGINT AS n FROM region UNION ALL SELECT 'n' || n_nationkey::VARCHAR, count(s_suppkey) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey UNION ALL SELECT 'all', count(*) FROM supplier")
def bag_fixpoint(spark, d):
    """Suppliers counted through nations and regions: each region's atom gives its nations' as often as they have suppliers, and those give one for all."""
    regions, nations, suppliers = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation", "supplier"))
    k = {r[0]: r[1] for r in suppliers.groupBy("s_nationkey").count().collect()}  # a row for each nation
    of = {r.n_nationkey: r.n_regionkey for r in nations.collect()}
    facts = {f"r{r.r_regionkey}": 1 for r in regions.collect()}
    program = [fixpoint.BagRule(f"n{i}", (f"r{g}",), k.get(i, 0)) for i, g in of.items()] + [fixpoint.BagRule("all", (f"n{i}",)) for i in of]
    found = fixpoint.bag_fixpoint([*facts, *(f"n{i}" for i in of), "all"], facts, program)
    return spark.createDataFrame(sorted(fixpoint.require_finite(found).items()), "atom string, n long")


# migrations and bridges


@query("SELECT p_partkey AS id, p_name AS name, p_size::DOUBLE AS size FROM part")
def migrate_rows(spark, d):
    c = star(spark, d, "part")
    target = Relation("part2", (("id", ty.I64), ("name", ty.TEXT), ("size", ty.F64)))
    return migrate.migrate(c, [migrate.FromRows("part", target, (sc.field("p_partkey"), sc.field("p_name"), sc.ToF64(sc.field("p_size"))))]).read("part2")


@query("SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1")
def migrate_query(spark, d):
    c = star(spark, d, "customer")
    plan = n.Group(n.Scan("customer"), (4,), (Eq("text"),))
    return migrate.migrate(c, [migrate.FromQuery(Relation("segments", (("segment", ty.TEXT), ("customers", ty.I64)), SET), plan)]).read("segments")


@query("SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def bridge_read(spark, d):
    new = star(spark, d, "nation", "region")
    old = Catalog(spark)
    old.add(Relation("places", (("name", ty.TEXT), ("region", ty.TEXT))))
    view = n.Project(n.JoinEq(n.Scan("nation"), n.Scan("region"), 2, 0, Eq("i64")), (1, 4))
    asked = scan(old, "places").where(col("region") == "EUROPE").select("name")
    plan = migrate.Bridge(old.schema, {"places": view}).translate(asked.plan, new.schema)
    return Query(new, plan, ("n_name",)).frame()


@query("SELECT c_custkey + 1000000 AS c_custkey, c_name FROM customer")
def transport_ids(spark, d):
    df = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    return migrate.renamed_ids(df, ["c_custkey"], df.select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))).select("c_custkey", "c_name")


def queries() -> dict[str, Run]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s is not None}
