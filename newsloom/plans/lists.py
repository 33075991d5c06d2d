"""Queries over threads, ranked lists, versions and statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tables
from .registry import query

C = "c AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, CASE WHEN turn > 0 THEN conv_id * 1000 END AS root_id, role AS user_id, turn FROM conversations)"


def comments(t) -> DataFrame:
    node = F.col("conv_id") * 1000
    reply = F.col("turn") > 0
    return t("conversations").select((node + F.col("turn")).alias("id"), F.when(reply, node + F.col("turn") - 1).alias("parent"), F.when(reply, node).alias("root_id"), F.col("role").alias("user_id"), "turn")


@query(f"WITH {C} SELECT DISTINCT id, CAST(least(turn, 4) AS INT) AS depth FROM c")
def thread_tree_depth(t):
    return tables.thread_depth(comments(t).select("id", "parent").distinct(), "id", "parent").select("id", "depth")


@query(f"WITH {C} SELECT r.id AS root, count(*) AS replies, max(c.turn) AS last_turn FROM (SELECT DISTINCT id FROM c WHERE root_id IS NULL) r JOIN c ON c.root_id = r.id GROUP BY r.id")
def thread_replies_join(t):
    c = comments(t)
    roots = c.where("root_id is null").select(F.col("id").alias("root")).distinct()
    return roots.join(c, F.col("root") == F.col("root_id")).groupBy("root").agg(F.count("*").alias("replies"), F.max("turn").alias("last_turn"))


@query(f"""WITH {C} SELECT id, user_id FROM c WHERE root_id IS NULL AND id IN (SELECT id FROM c WHERE user_id = 'assistant' AND root_id IS NULL UNION SELECT root_id FROM c WHERE user_id = 'assistant' AND root_id IS NOT NULL)""")
def mine_filter_semi_union(t):
    return tables.mine(comments(t), "assistant").select("id", "user_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_list_offset_limit(t):
    return tables.page(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)


@query("SELECT count(*) AS total, count(*) > 60 AS has_more FROM orders WHERE o_orderstatus = 'O'")
def page_has_more(t):
    return tables.page_info(t("orders").where("o_orderstatus = 'O'"), 3, 20)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_version_pointer(t):
    return tables.latest_version(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("""SELECT o_orderpriority, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'released' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def status_transition(t):
    orders = t("orders").select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("status"))
    changed = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.apply_status(orders, changed, "o_orderkey", "released").groupBy("o_orderpriority", "status").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders QUALIFY rank <= CASE WHEN o_orderpriority = '1-URGENT' THEN 15 ELSE 8 END""")
def topn_capped_by_category(t):
    d = t("orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    cap = tables.category_cap(F.col("o_orderpriority"), {"1-URGENT": 15}, 8)
    return tables.top_per_group(d, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], cap).drop("o_totalprice")


@query("""WITH u AS (SELECT c_custkey AS id, c_acctbal AS balance, 0 AS p FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier)
SELECT id, balance FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC) = 1""")
def override_by_priority(t):
    frames = [t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))]
    return tables.override_by_priority(frames, "id")


@query("""WITH k AS (SELECT p_partkey AS id FROM part), f AS (SELECT c_custkey AS id, c_name AS name, 1 AS found_in FROM customer UNION ALL SELECT s_suppkey, s_name, 0 FROM supplier)
SELECT id, name, found_in FROM f WHERE id IN (SELECT id FROM k) QUALIFY row_number() OVER (PARTITION BY id ORDER BY found_in) = 1""")
def lookup_chain(t):
    keys = t("part").select(F.col("p_partkey").alias("id"))
    return tables.lookup_chain(keys, [t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))], "id")


@query("SELECT p_type, count(*) AS n FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON l_partkey = p_partkey GROUP BY p_type")
def already_staged_semi_join(t):
    return t("part").join(t("lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").groupBy("p_type").agg(F.count("*").alias("n"))
