"""Scans, sinks, projections, predicates, joins, aggregations, sorts and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold import sources as S
from tarnfold.functions import clamp
from tarnfold.operators import ordered as O
from tarnfold.operators import relational as R
from tarnfold.plans.registry import query

RATINGS = "SELECT o_custkey AS user_id, l_suppkey AS item_id, max(ceil(l_quantity / 10)) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """``user_id, item_id, rating`` (1 to 5): one rating for each customer and supplier."""
    line = S.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = S.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("item_id")).agg(F.max(F.ceil(F.col("l_quantity") / 10)).cast("double").alias("rating"))


@query("""SELECT r_name, count(*) AS n_customers, round(avg(c_acctbal), 4) AS avg_balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name HAVING count(*) >= 20 ORDER BY avg_balance DESC, r_name LIMIT 3""")
def groupby_having_topk(spark, sf):
    c, n, r = (S.table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.avg("c_acctbal"), 4).alias("avg_balance")).where("n_customers >= 20").orderBy(F.desc("avg_balance"), "r_name").limit(3)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def groupby_count(spark, sf):
    return S.table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_project(spark, sf):
    n, r = S.table(spark, sf, "nation"), S.table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, sf):
    return S.table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand = 'Brand#1'")
def filter_project(spark, sf):
    return S.table(spark, sf, "part").where(F.col("p_size").between(10, 20) & (F.col("p_brand") == "Brand#1")).select("p_partkey", "p_name")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1000 AND s_nationkey IN (1, 2, 3)")
def filter_sql_string(spark, sf):
    return S.table(spark, sf, "supplier").filter("s_acctbal > 1000 AND s_nationkey IN (1, 2, 3)").select("s_suppkey", "s_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join_isnull(spark, sf):
    c, o = S.table(spark, sf, "customer"), S.table(spark, sf, "orders").where("o_totalprice > 400000").select("o_custkey")
    return R.anti_join(c, o, c.c_custkey == o.o_custkey).select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def anti_join_notin(spark, sf):
    p, line = S.table(spark, sf, "part"), S.table(spark, sf, "lineitem").where("l_quantity >= 49").select("l_partkey")
    return R.anti_join(p, line, p.p_partkey == line.l_partkey).select("p_partkey")


@query("SELECT c_custkey, coalesce(n, 0) AS n_big, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 450000 GROUP BY 1) ON o_custkey = c_custkey")
def left_join_default(spark, sf):
    c = S.table(spark, sf, "customer").select("c_custkey")
    o = S.table(spark, sf, "orders").where("o_totalprice > 450000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("t"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_big"), F.coalesce("t", F.lit(0.0)).alias("total"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1)")
def semi_join_membership(spark, sf):
    o, line = S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem").where("l_discount >= 0.1").select("l_orderkey")
    return o.join(line, o.o_orderkey == line.l_orderkey, "left_semi").select("o_orderkey")


@query("SELECT l_returnflag, count(CASE WHEN l_quantity > 10 THEN l_quantity END) AS n_nonnull, count(*) AS n FROM lineitem GROUP BY 1")
def count_nonnull_by_key(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("q"))
    return line.groupBy("l_returnflag").agg(F.count("q").alias("n_nonnull"), F.count(F.lit(1)).alias("n"))


@query("SELECT round(avg(m), 4) AS mean_of_means FROM (SELECT avg(l_quantity) AS m FROM lineitem GROUP BY l_suppkey)")
def mean_of_means(spark, sf):
    return S.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m")).agg(F.round(F.avg("m"), 4).alias("mean_of_means"))


@query("SELECT l_suppkey, round(avg(l_quantity), 2) AS mean_quantity FROM lineitem GROUP BY 1")
def two_phase_mean(spark, sf):
    return S.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 2).alias("mean_quantity"))


_HOLES = "SELECT CASE WHEN o_totalprice > 450000 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority, o_orderkey FROM orders"


def _holes(spark, sf):
    o = S.table(spark, sf, "orders")
    return o.select(F.when(F.col("o_totalprice") > 450000, None).otherwise(F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_orderpriority")).alias("priority"), "o_orderkey")


@query(f"WITH h AS ({_HOLES}) SELECT 'price' AS column_name, count(*) - count(price) AS nulls, count(*) AS total FROM h UNION ALL SELECT 'priority', count(*) - count(priority), count(*) FROM h UNION ALL SELECT 'o_orderkey', count(*) - count(o_orderkey), count(*) FROM h")
def null_profile(spark, sf):
    return R.null_profile(_holes(spark, sf))


@query(f"SELECT * FROM ({_HOLES}) WHERE price IS NOT NULL AND priority IS NOT NULL AND o_orderkey IS NOT NULL")
def drop_null_rows(spark, sf):
    return _holes(spark, sf).na.drop()


@query(f"SELECT o_orderkey, coalesce(priority, 'na') AS priority, coalesce(CAST(floor(price) AS BIGINT)::VARCHAR, 'na') AS price FROM ({_HOLES})")
def fill_nulls_cast(spark, sf):
    h = _holes(spark, sf)
    return h.select("o_orderkey", "priority", F.floor("price").cast("string").alias("price")).na.fill("na")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 60000 THEN NULL ELSE l_extendedprice END AS price, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS quantity FROM lineitem")
def conditional_null_out(spark, sf):
    line = S.table(spark, sf, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.when(~(F.col("l_extendedprice") > 60000), F.col("l_extendedprice")).alias("price"), F.when(~(F.col("l_quantity") > 45), F.col("l_quantity")).alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, greatest(1.0::DOUBLE, least(5.0::DOUBLE, l_quantity / 8)) AS clamped FROM lineitem")
def clamp_values(spark, sf):
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clamp(F.col("l_quantity") / 8, 1.0, 5.0).alias("clamped"))


@query("SELECT p_partkey AS part, p_retailprice * 0.5::DOUBLE + 1 AS half_price FROM part")
def scale_rename_drop(spark, sf):
    return S.table(spark, sf, "part").withColumn("half_price", F.col("p_retailprice") * 0.5 + 1).withColumnRenamed("p_partkey", "part").drop("p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(spark, sf):
    c = S.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    return c.unionByName(S.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(spark, sf):
    return S.table(spark, sf, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("nation")).intersect(S.table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, sf):
    return S.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).subtract(S.table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def dedupe_keep_first(spark, sf):
    """First occurrence in key order; dropDuplicates alone would keep any."""
    return S.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query("SELECT 'l_linestatus' AS column_name, min(l_linestatus) = max(l_linestatus) AS is_constant FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'l_returnflag', min(l_returnflag) = max(l_returnflag) FROM lineitem WHERE l_linestatus = 'F'")
def constant_columns(spark, sf):
    return R.constant_columns(S.table(spark, sf, "lineitem").where("l_linestatus = 'F'"), ["l_linestatus", "l_returnflag"])


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def ilike_search(spark, sf):
    return S.table(spark, sf, "part").where(F.col("p_name").ilike("%RED%")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) WHERE i > 10 AND i <= 25")
def positional_slice(spark, sf):
    """Rows 11 to 25 by key: offset and limit keep what each task sends to 25 rows."""
    return S.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(10).limit(15)


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice < 100000 THEN 1.0 ELSE 0.0 END), 6) AS below FROM orders GROUP BY 1")
def proportion_below(spark, sf):
    return S.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") < 100000).cast("double")), 6).alias("below"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band FROM orders")
def piecewise(spark, sf):
    p = F.col("o_totalprice")
    return S.table(spark, sf, "orders").select("o_orderkey", F.when(p < 100000, "low").when(p < 300000, "mid").otherwise("high").alias("band"))


@query("SELECT s_suppkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1 WHERE n_nationkey IS NULL")
def is_null_predicate(spark, sf):
    s, n = S.table(spark, sf, "supplier"), S.table(spark, sf, "nation").where("n_regionkey = 1")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").where(F.col("n_nationkey").isNull()).select("s_suppkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_key(spark, sf):
    o = S.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_k(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 1")
def ties_at_max(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return R.ties_at_max(line, ["l_suppkey"], F.col("l_quantity"))


@query("SELECT n_name, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name, c_acctbal DESC, c_custkey LIMIT 50")
def multi_key_sort(spark, sf):
    c, n = S.table(spark, sf, "customer"), S.table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("n_name", "c_custkey", "c_acctbal").orderBy("n_name", F.desc("c_acctbal"), "c_custkey").limit(50)


@query("SELECT o_custkey, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1")
def arg_max_min(spark, sf):
    return S.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("dearest"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"))


@query("SELECT l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers, count(*) AS n FROM lineitem GROUP BY 1")
def group_to_set(spark, sf):
    return S.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1")
def group_to_list(spark, sf):
    """Document-store shape: the records of a key as one ordered list."""
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return S.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("lines"))


@query("SELECT l_partkey, count(*) AS support FROM lineitem GROUP BY 1 HAVING count(*) >= 40")
def support_threshold(spark, sf):
    return S.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("support")).where("support >= 40")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf):
    return S.table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("long").alias("g"))


@query("SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, CAST(l_suppkey % 10 AS BIGINT) AS bucket FROM lineitem GROUP BY 3")
def least_greatest(spark, sf):
    return S.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("bucket")).agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


_ENRICHED = f"""WITH r AS ({RATINGS}), h AS (SELECT user_id, avg(rating) AS user_mean, count(*) AS user_n FROM r GROUP BY 1)
SELECT r.user_id, r.item_id, rating, s_acctbal, c_acctbal, round(user_mean, 6) AS user_mean, user_n FROM r LEFT JOIN supplier ON s_suppkey = item_id LEFT JOIN customer ON c_custkey = r.user_id LEFT JOIN h ON h.user_id = r.user_id"""


@query(_ENRICHED)
def left_join_chain(spark, sf):
    r = ratings(spark, sf)
    h = r.groupBy("user_id").agg(F.round(F.avg("rating"), 6).alias("user_mean"), F.count(F.lit(1)).alias("user_n"))
    s = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_id"), "s_acctbal")
    c = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    return r.join(s, "item_id", "left").join(c, "user_id", "left").join(h, "user_id", "left")


@query("SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS common FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 5")
def theta_self_join(spark, sf):
    return R.pair_overlap(S.table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", 5)


# Scans and sinks: rows make a round trip through each format.


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def scan_json_lines(spark, sf):
    w = S.Workspace(spark, "json")
    path = S.write_json_lines(S.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), w.path("nation"))
    return S.read_json_lines(spark, path, "id int, name string")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_csv_header(spark, sf):
    w = S.Workspace(spark, "csv")
    path = S.write_csv(S.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), w.path("customer"))
    return S.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT role AS person, count(*) AS n FROM conversations GROUP BY 1")
def scan_tsv_headerless(spark, sf):
    w = S.Workspace(spark, "tsv")
    chat = S.table(spark, sf, "conversations").select("turn", F.concat("role", F.lit(":")).alias("person"), F.regexp_replace("text", r"\s", " ").alias("message"))
    path = S.write_report(chat, F.concat_ws("\t", "turn", "person", "message"), w.path("chat"))
    read = S.read_tsv(spark, path, "time bigint, person string, message string")
    return read.groupBy(F.translate("person", ":", "").alias("person")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier")
def scan_xml_records(spark, sf):
    w = S.Workspace(spark, "xml")
    path = S.write_xml(S.table(spark, sf, "supplier").select("s_suppkey", "s_name"), w.path("supplier"), "supplier", "suppliers")
    return S.read_xml(spark, path, "supplier", "s_suppkey bigint, s_name string")


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def scan_literal_rows(spark, sf):
    return S.read_rows(spark, [(i, n) for i, n in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])], "id int, name string")


@query("SELECT vec_id, len(embedding)::INTEGER AS dimension, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def scan_vectors(spark, sf):
    return S.table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dimension"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("SELECT range AS id FROM range(1000)")
def scan_range(spark, sf):
    return spark.range(1000)


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def sink_partitioned_parquet(spark, sf):
    w = S.Workspace(spark, "parquet")
    path = S.write_parquet(S.table(spark, sf, "nation"), w.path("nation"), ("n_regionkey",))
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").parquet(path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '(' || n_nationkey || ', ''' || n_name || ''')' AS line FROM nation")
def sink_text_report(spark, sf):
    w = S.Workspace(spark, "report")
    path = S.write_report(S.table(spark, sf, "nation"), F.format_string("(%d, '%s')", "n_nationkey", "n_name"), w.path("nation"))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_field(spark, sf):
    return S.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def scan_json_documents(spark, sf):
    """One document a file, an array of records."""
    nation = S.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return S.read_json_documents(spark, S.write_json_document(nation, S.Workspace(spark, "documents").path("nation")), "id int, name string")


@query("SELECT page_id, length(html) AS n FROM pages")
def scan_tree_directory(spark, sf):
    """A directory of markup files, one a page."""
    path = S.Workspace(spark, "trees").path("pages")
    S.table(spark, sf, "pages").select("page_id", F.col("html").alias("value")).write.mode("overwrite").partitionBy("page_id").text(path)
    trees = S.read_trees(spark, path)
    return trees.select(F.regexp_extract("file", "page_id=([0-9]+)", 1).cast("long").alias("page_id"), (F.length("markup") - 1).cast("long").alias("n"))  # the writer ends a file with a line break


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_table(spark, sf):
    """A table of the catalog, read again by its name."""
    w = S.Workspace(spark, "catalog")
    return S.write_table(S.table(spark, sf, "nation"), f"nation_{uuid.uuid4().hex}", w.path("nation"))


@query("SELECT least(floor((c_acctbal + 1000) / 1100), 9)::BIGINT AS x, count(*) AS y FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000 GROUP BY 1")
def sink_chart(spark, sf):
    """The points of a bar chart, as its document holds them."""
    bars = O.histogram(S.table(spark, sf, "customer"), "c_acctbal", -1000, 10000, 10).select("bin", "n")
    path = S.write_chart(bars, S.Workspace(spark, "chart").path("bars"), "bar", "bin", "n")
    spec = spark.read.text(path).select(F.from_json("value", "data struct<values:array<struct<x:bigint,y:bigint>>>")["data"]["values"].alias("v"))
    return spec.select(F.explode("v").alias("p")).select("p.x", "p.y")


@query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS position FROM customer), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS position FROM part) SELECT position, c_custkey, p_partkey FROM a JOIN b USING (position)")
def align_rows(spark, sf):
    """The k-th richest customer beside the k-th dearest part."""
    c, p = S.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), S.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    made = R.align_rows(c, [F.desc("c_acctbal"), F.asc("c_custkey")], p, [F.desc("p_retailprice"), F.asc("p_partkey")], S.Workspace(spark, "align"))
    return made.select("position", "c_custkey", "p_partkey")


_FLAGS = "SELECT l_returnflag AS f, round(sum(l_quantity), 2) AS quantity, round(sum(l_tax), 2) AS tax, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1"


@query(f"WITH t AS ({_FLAGS}), l AS (SELECT f, 'quantity' AS variable, quantity AS v FROM t UNION ALL SELECT f, 'tax', tax FROM t UNION ALL SELECT f, 'n', n FROM t) SELECT variable, max(CASE WHEN f = 'A' THEN v END) AS a, max(CASE WHEN f = 'N' THEN v END) AS n, max(CASE WHEN f = 'R' THEN v END) AS r FROM l GROUP BY 1")
def transpose(spark, sf):
    """Sums by flag, a row a sum in place of a row a flag."""
    sums = S.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_tax"), 2).alias("tax"), F.count(F.lit(1)).cast("double").alias("n"))
    return R.transpose(sums, "l_returnflag", ["quantity", "tax", "n"], ["A", "N", "R"]).toDF("variable", "a", "n", "r")
