"""The knowledge graph that the sample tables describe: people, teams, goals, projects and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.graph import Graph, positioned

EXPIRES_DAYS = 90


def _fact(id_: Column, type_: str, ns: Column, src: Column, props: dict[str, Column], valid_from: Column | None = None, valid_to: Column | None = None) -> list[Column]:
    pairs = [x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]
    bag = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    null_date = F.lit(None).cast("date")
    return [
        id_.alias("id"), F.lit(type_).alias("type"), F.array(ns).alias("ns"),
        (null_date if valid_from is None else valid_from).alias("valid_from"), (null_date if valid_to is None else valid_to).alias("valid_to"),
        bag.alias("props"), F.array(src).alias("src"),
    ]


def sample_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over the tables in sf_dir; columns of EDGE_SCHEMA and NODE_SCHEMA but for provenance."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c, lit, cat = F.col, F.lit, F.concat
    public = lit("public")
    area = t("nation").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "n_name", "n_regionkey", F.lower("r_name").alias("area"))
    area = F.broadcast(area)  # nations: a fixed number
    customer = t("customer").join(area, c("c_nationkey") == c("n_nationkey"))
    supplier = t("supplier").join(area, c("s_nationkey") == c("n_nationkey"))
    ordered = t("orders").join(customer.select("c_custkey", "area"), c("o_custkey") == c("c_custkey"))
    begun = F.to_date("o_orderdate")
    src = lambda name, key: cat(lit(f"{name}.md:"), (key + 1).cast("string"))

    nodes = [
        t("region").select(*_fact(cat(lit("region:"), c("r_regionkey")), "domain", public, src("region", c("r_regionkey")), {"name": c("r_name")})),
        t("nation").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey")).select(*_fact(cat(lit("nation:"), c("n_nationkey")), "team", F.lower("r_name"), src("nation", c("n_nationkey")), {"name": c("n_name")})),
        customer.select(*_fact(cat(lit("cust:"), c("c_custkey")), "person", c("area"), src("customer", c("c_custkey")), {"name": c("c_name"), "segment": c("c_mktsegment")})),
        supplier.select(*_fact(cat(lit("supp:"), c("s_suppkey")), "service", c("area"), src("supplier", c("s_suppkey")), {"name": c("s_name")})),
        t("part").select(*_fact(cat(lit("part:"), c("p_partkey")), "project", public, src("part", c("p_partkey")), {"name": c("p_name"), "brand": c("p_brand"), "summary": c("p_type")})),
        ordered.select(*_fact(cat(lit("ord:"), c("o_orderkey")), "goal", c("area"), src("orders", c("o_orderkey")), {"title": cat(lit("Order "), c("o_orderkey")), "status": c("o_orderstatus"), "priority": c("o_orderpriority")}, begun, F.when(c("o_orderstatus") == "F", F.date_add(begun, EXPIRES_DAYS)))),
    ]

    def edge(df: DataFrame, *fact: Column, from_id: Column, to_id: Column) -> DataFrame:
        return df.select(*fact, from_id.alias("from_id"), to_id.alias("to_id"))

    shipped = t("lineitem").join(ordered.select("o_orderkey", begun.alias("o_date"), "area"), c("l_orderkey") == c("o_orderkey"))
    ship = F.to_date("l_shipdate")
    needs = shipped.groupBy("l_orderkey", "l_partkey", "area").agg(F.min(F.least(ship, c("o_date"))).alias("vf"), F.max(F.greatest(ship, c("o_date"))).alias("vt"), F.count("*").alias("lines"))
    gives = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("lines"))
    part = t("part")
    alike = part.select("p_partkey", "p_brand").join(part.select((c("p_partkey") - 1).alias("p_partkey"), c("p_brand")), ["p_partkey", "p_brand"])
    person, service = cat(lit("cust:"), c("c_custkey")), cat(lit("supp:"), c("s_suppkey"))
    edges = [
        edge(customer, *_fact(cat(lit("m:c"), c("c_custkey")), "member_of", c("area"), src("customer", c("c_custkey")), {"description": cat(lit("works in "), c("n_name"))}), from_id=person, to_id=cat(lit("nation:"), c("c_nationkey"))),
        edge(supplier, *_fact(cat(lit("m:s"), c("s_suppkey")), "member_of", c("area"), src("supplier", c("s_suppkey")), {"description": cat(lit("serves "), c("n_name"))}), from_id=service, to_id=cat(lit("nation:"), c("s_nationkey"))),
        edge(t("nation"), *_fact(cat(lit("d:"), c("n_nationkey")), "in_domain", public, src("nation", c("n_nationkey")), {}), from_id=cat(lit("nation:"), c("n_nationkey")), to_id=cat(lit("region:"), c("n_regionkey"))),
        edge(ordered, *_fact(cat(lit("p:"), c("o_orderkey")), "pursues", c("area"), src("orders", c("o_orderkey")), {"reason": c("o_orderpriority")}, begun), from_id=cat(lit("cust:"), c("o_custkey")), to_id=cat(lit("ord:"), c("o_orderkey"))),
        edge(needs, *_fact(cat(lit("l:"), c("l_orderkey"), lit(":"), c("l_partkey")), "depends_on", c("area"), src("lineitem", c("l_orderkey")), {"lines": c("lines")}, c("vf"), c("vt")), from_id=cat(lit("ord:"), c("l_orderkey")), to_id=cat(lit("part:"), c("l_partkey"))),
        edge(gives, *_fact(cat(lit("c:"), c("l_suppkey"), lit(":"), c("l_partkey")), "contributes_to", public, src("lineitem", c("l_suppkey")), {"lines": c("lines")}), from_id=cat(lit("supp:"), c("l_suppkey")), to_id=cat(lit("part:"), c("l_partkey"))),
        edge(alike, *_fact(cat(lit("r:"), c("p_partkey")), "relates_to", public, src("part", c("p_partkey")), {"note": c("p_brand")}), from_id=cat(lit("part:"), c("p_partkey")), to_id=cat(lit("part:"), c("p_partkey") + 1)),
    ]

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return positioned(out)

    return Graph(union(nodes), union(edges))


#: The same graph for DuckDB: common table expressions nodes(id, type, ns, vf, vt, name, title, brand, summary, segment, status, priority, src)
#: and edges(id, type, ns, vf, vt, from_id, to_id, description, reason, note, lines, src); ns is the single namespace, src the single source.
GRAPH_SQL = """
WITH RECURSIVE area AS (SELECT n_nationkey, n_name, n_regionkey, lower(r_name) AS area FROM nation JOIN region ON n_regionkey = r_regionkey),
ordered AS (SELECT o.*, area, CAST(o_orderdate AS DATE) AS o_date FROM orders o JOIN customer ON o_custkey = c_custkey JOIN area ON c_nationkey = n_nationkey),
nodes AS MATERIALIZED (
  SELECT 'region:' || r_regionkey AS id, 'domain' AS type, 'public' AS ns, NULL::DATE AS vf, NULL::DATE AS vt, r_name AS name, NULL::VARCHAR AS title, NULL::VARCHAR AS brand, NULL::VARCHAR AS summary, NULL::VARCHAR AS segment, NULL::VARCHAR AS status, NULL::VARCHAR AS priority, 'region.md:' || (r_regionkey + 1) AS src FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'team', area, NULL, NULL, n_name, NULL, NULL, NULL, NULL, NULL, NULL, 'nation.md:' || (n_nationkey + 1) FROM area
  UNION ALL SELECT 'cust:' || c_custkey, 'person', area, NULL, NULL, c_name, NULL, NULL, NULL, c_mktsegment, NULL, NULL, 'customer.md:' || (c_custkey + 1) FROM customer JOIN area ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supp:' || s_suppkey, 'service', area, NULL, NULL, s_name, NULL, NULL, NULL, NULL, NULL, NULL, 'supplier.md:' || (s_suppkey + 1) FROM supplier JOIN area ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'project', 'public', NULL, NULL, p_name, NULL, p_brand, p_type, NULL, NULL, NULL, 'part.md:' || (p_partkey + 1) FROM part
  UNION ALL SELECT 'ord:' || o_orderkey, 'goal', area, o_date, CASE WHEN o_orderstatus = 'F' THEN o_date + 90 END, NULL, 'Order ' || o_orderkey, NULL, NULL, NULL, o_orderstatus, o_orderpriority, 'orders.md:' || (o_orderkey + 1) FROM ordered),
edges AS MATERIALIZED (
  SELECT 'm:c' || c_custkey AS id, 'member_of' AS type, area AS ns, NULL::DATE AS vf, NULL::DATE AS vt, 'cust:' || c_custkey AS from_id, 'nation:' || c_nationkey AS to_id, 'works in ' || n_name AS description, NULL::VARCHAR AS reason, NULL::VARCHAR AS note, NULL::VARCHAR AS lines, 'customer.md:' || (c_custkey + 1) AS src FROM customer JOIN area ON c_nationkey = n_nationkey
  UNION ALL SELECT 'm:s' || s_suppkey, 'member_of', area, NULL, NULL, 'supp:' || s_suppkey, 'nation:' || s_nationkey, 'serves ' || n_name, NULL, NULL, NULL, 'supplier.md:' || (s_suppkey + 1) FROM supplier JOIN area ON s_nationkey = n_nationkey
  UNION ALL SELECT 'd:' || n_nationkey, 'in_domain', 'public', NULL, NULL, 'nation:' || n_nationkey, 'region:' || n_regionkey, NULL, NULL, NULL, NULL, 'nation.md:' || (n_nationkey + 1) FROM nation
  UNION ALL SELECT 'p:' || o_orderkey, 'pursues', area, o_date, NULL, 'cust:' || o_custkey, 'ord:' || o_orderkey, NULL, o_orderpriority, NULL, NULL, 'orders.md:' || (o_orderkey + 1) FROM ordered
  UNION ALL SELECT 'l:' || l_orderkey || ':' || l_partkey, 'depends_on', area, min(least(CAST(l_shipdate AS DATE), o_date)), max(greatest(CAST(l_shipdate AS DATE), o_date)), 'ord:' || l_orderkey, 'part:' || l_partkey, NULL, NULL, NULL, CAST(count(*) AS VARCHAR), 'lineitem.md:' || (l_orderkey + 1) FROM lineitem JOIN ordered ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey, area
  UNION ALL SELECT 'c:' || l_suppkey || ':' || l_partkey, 'contributes_to', 'public', NULL, NULL, 'supp:' || l_suppkey, 'part:' || l_partkey, NULL, NULL, NULL, CAST(count(*) AS VARCHAR), 'lineitem.md:' || (l_suppkey + 1) FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'r:' || a.p_partkey, 'relates_to', 'public', NULL, NULL, 'part:' || a.p_partkey, 'part:' || b.p_partkey, NULL, NULL, a.p_brand, NULL, 'part.md:' || (a.p_partkey + 1) FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_brand = b.p_brand)
"""
