"""Queries on the property graph; the order tables stand for nodes and edges.

Nodes: customers, orders, parts, suppliers, nations, regions.  Edges: PLACED,
CONTAINS, SUPPLIES, LOCATED_IN.  A return flag R makes an edge negative.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import graph
from docweave.queries.registry import query, table
from docweave.queries.value_queries import key_sql

NODES = {
    "Customer": ("customer", "c_custkey", "c_name"),
    "Supplier": ("supplier", "s_suppkey", "s_name"),
    "Part": ("part", "p_partkey", "p_name"),
    "Nation": ("nation", "n_nationkey", "n_name"),
    "Region": ("region", "r_regionkey", "r_name"),
}
NODES_SQL = " UNION ALL ".join(f"SELECT '{c}' AS class, '{c}_' || {k} AS node_id, {k}::BIGINT AS node_ord, {n} AS label FROM {t}" for c, (t, k, n) in NODES.items())


def nodes(spark, sf_dir):
    out = None
    for c, (t, k, n) in NODES.items():
        one = table(spark, sf_dir, t).select(F.lit(c).alias("class"), F.concat(F.lit(f"{c}_"), F.col(k).cast("string")).alias("node_id"), F.col(k).cast("bigint").alias("node_ord"), F.col(n).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


#: Edges from suppliers to parts by order lines; columns named as the engine's edges.
EDGE_COLUMNS = """'Supplier_' || l_suppkey AS source, 'Part_' || l_partkey AS target, 'SUPPLIES' AS type,
  CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END AS polarity, l_orderkey, l_linenumber, l_shipdate, l_quantity,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'order ' || l_orderkey || '/' || l_linenumber END AS quote,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_linestatus END AS qualifier"""
EDGES_SQL = f"SELECT {EDGE_COLUMNS} FROM lineitem"


def edges(spark, sf_dir):
    return spark.sql(f"SELECT {EDGE_COLUMNS} FROM {{lineitem}}", lineitem=table(spark, sf_dir, "lineitem"))


@query("SELECT class, node_id, label, '" + "' || substr(sha256(label), 1, 8) || '" + f"' AS digest FROM ({NODES_SQL})")
def graph_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).select("class", "node_id", graph.label(F.col("label"), []).alias("label"), F.substring(F.sha2("label", 256), 1, 8).alias("digest"))


@query(
    "SELECT p_partkey, CASE WHEN trim(p_brand) <> '' AND p_size % 4 <> 0 THEN p_brand || ' | ' || p_size END AS identity, "
    "coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END), ''), CASE WHEN trim(p_brand) <> '' AND p_size % 4 <> 0 THEN p_brand || ' | ' || p_size END) AS label FROM part"
)
def label_fallback(spark, sf_dir):
    """The label, else the identity of both keys, which is null unless both are there."""
    p = table(spark, sf_dir, "part")
    keys = [F.col("p_brand"), F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("string"))]
    shown = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name"))
    return p.select("p_partkey", graph.identity(keys).alias("identity"), graph.label(shown, keys).alias("label"))


@query(
    f"WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL}) SELECT 'nodes_by_type' AS what, class AS name, count(*) AS n FROM n GROUP BY class UNION ALL SELECT 'edges_by_type', type, count(*) FROM e GROUP BY type "
    "UNION ALL SELECT 'edges_by_polarity', polarity, count(*) FROM e GROUP BY polarity UNION ALL SELECT 'edges', '', count(*) FROM e UNION ALL SELECT 'nodes', '', count(*) FROM n"
)
def meta_grouping_sets(spark, sf_dir):
    return graph.counts(nodes(spark, sf_dir), edges(spark, sf_dir))


ORDER = ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"]


@query(
    f"""WITH e AS (SELECT *, row(l_orderkey, l_linenumber, l_shipdate, l_quantity) AS place FROM ({EDGES_SQL}))
    SELECT source, target, type, polarity, arg_min(quote, place) FILTER (quote IS NOT NULL) AS quote, arg_min(qualifier, place) FILTER (qualifier IS NOT NULL) AS qualifier,
      arg_min(l_orderkey, place) AS provenance, count(*) AS rows FROM e GROUP BY ALL"""
)
def edges_dedupe(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("provenance", F.col("l_orderkey")).withColumn("properties", F.create_map(F.lit("order"), F.col("l_orderkey").cast("string")))
    return graph.merge_edges(e, ORDER).drop("properties")


@query(
    f"""WITH e AS (SELECT *, row(l_orderkey, l_linenumber, l_shipdate, l_quantity) AS place FROM ({EDGES_SQL}))
    SELECT source, target, polarity, arg_min(l_orderkey, place)::VARCHAR AS first_order, arg_min(l_quantity::BIGINT, place) FILTER (l_linenumber % 2 = 0)::VARCHAR AS quantity FROM e GROUP BY source, target, polarity"""
)
def edge_properties(spark, sf_dir):
    """Properties by name: the first row that has one gives its value."""
    maps = F.map_from_arrays(
        F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("order"), F.lit("quantity"))).otherwise(F.array(F.lit("order"))),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string"))).otherwise(F.array(F.col("l_orderkey").cast("string"))),
    )
    e = edges(spark, sf_dir).withColumn("provenance", F.lit(0)).withColumn("properties", maps)
    m = graph.merge_edges(e, ORDER)
    return m.select("source", "target", "polarity", F.col("properties")["order"].alias("first_order"), F.col("properties")["quantity"].alias("quantity"))


@query(f"SELECT source, target, type, string_agg(DISTINCT polarity, ',' ORDER BY polarity) AS polarities FROM ({EDGES_SQL}) GROUP BY ALL HAVING count(DISTINCT polarity) = 2")
def edge_conflicts(spark, sf_dir):
    return graph.conflicts(edges(spark, sf_dir)).withColumn("polarities", F.array_join("polarities", ","))


RELATIONS = [("REF", "Supplier", 0), ("REF", "Customer", 1), ("REF", "Nation", 2), ("AREA", "Nation", 0), ("AREA", "Region", 1)]
RELATIONS_SQL = "(VALUES " + ", ".join(f"('{r}', '{c}', {p})" for r, c, p in RELATIONS) + ") r(relation, class, place)"
LINKS_SQL = """
  SELECT o_orderkey AS link_id, 'REF' AS relation, CASE o_orderkey % 3 WHEN 0 THEN 'Customer' WHEN 1 THEN 'Part' END AS target_type,
    CASE o_orderkey % 4 WHEN 0 THEN lower('Customer#' || lpad(o_custkey::VARCHAR, 9, '0')) || '.' WHEN 1 THEN '  Supplier#' || lpad((o_custkey % 150)::VARCHAR, 9, '0') WHEN 2 THEN ' ' ELSE 'GERMANY  ;' END AS target FROM orders
  UNION ALL SELECT -c_custkey, 'AREA', NULL, CASE c_custkey % 3 WHEN 0 THEN 'europe' WHEN 1 THEN 'FRANCE,' ELSE c_name END FROM customer"""


def links(spark, sf_dir):
    return spark.sql(
        LINKS_SQL.replace("::VARCHAR", "").replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}"),
        orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"),
    )


def resolver(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("keys", F.array("node_id")).withColumn("aliases", F.array(F.concat(F.col("label"), F.lit(" alias"))))
    return graph.resolver(n)


def relations(spark):
    return spark.createDataFrame(RELATIONS, "relation string, class string, place int")


RESOLVED_SQL = f"""
  WITH n AS ({NODES_SQL}),
  k AS (SELECT class, {key_sql('node_id')} AS key, node_id, node_ord, 0 AS rank FROM n UNION ALL SELECT class, {key_sql('label')}, node_id, node_ord, 1 FROM n UNION ALL SELECT class, {key_sql("label || ' alias'")}, node_id, node_ord, 2 FROM n),
  found AS (SELECT class, key, arg_min(node_id, row(node_ord, rank, node_id)) AS node_id FROM k WHERE key <> '' GROUP BY class, key),
  l AS (SELECT *, {key_sql('target')} AS key FROM ({LINKS_SQL}) WHERE trim(target) <> ''),
  best AS (SELECT link_id, arg_min(f.node_id, row(CASE WHEN f.class = l.target_type THEN 0 ELSE 1 END, r.place)) AS target_id, arg_min(f.class, row(CASE WHEN f.class = l.target_type THEN 0 ELSE 1 END, r.place)) AS target_class
    FROM l JOIN found f USING (key) JOIN {RELATIONS_SQL} ON r.relation = l.relation AND r.class = f.class GROUP BY link_id),
  resolved AS (SELECT l.*, target_id, target_class FROM l LEFT JOIN best USING (link_id))"""


@query(RESOLVED_SQL + " SELECT link_id, relation, target, target_id, target_class FROM resolved")
def resolve_targets(spark, sf_dir):
    return graph.resolve(links(spark, sf_dir), resolver(spark, sf_dir), relations(spark)).select("link_id", "relation", "target", "target_id", "target_class")


@query(
    RESOLVED_SQL + """, o AS (SELECT key, string_agg(DISTINCT class, ',' ORDER BY class) AS cs FROM found GROUP BY key)
    SELECT link_id, relation, target, CASE WHEN cs IS NULL THEN 'no such node' ELSE 'only in classes not permitted: ' || cs END AS reason FROM resolved LEFT JOIN o USING (key) WHERE target_id IS NULL"""
)
def unresolved_targets(spark, sf_dir):
    found = resolver(spark, sf_dir)
    return graph.unresolved(graph.resolve(links(spark, sf_dir), found, relations(spark)), found).select("link_id", "relation", "target", "reason")


@query("SELECT o_orderkey, 'Customer_' || CASE WHEN o_custkey % 10 = 0 AND o_custkey > 10 THEN o_custkey - 1 ELSE o_custkey END AS node_id FROM orders")
def merged_id_remap(spark, sf_dir):
    """Every tenth customer was merged into the one before it."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0 AND c_custkey > 10")
    all_ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().filter("k % 10 = 0 AND k > 10")
    merged = c.select(F.col("c_custkey").alias("k")).union(all_ids).distinct().select(F.concat(F.lit("Customer_"), F.col("k").cast("string")).alias("old_id"), F.concat(F.lit("Customer_"), (F.col("k") - 1).cast("string")).alias("survivor"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Customer_"), F.col("o_custkey").cast("string")).alias("node_id"))
    return graph.remap(o, merged)


@query(
    """WITH f AS (SELECT o_custkey, o_orderpriority AS a, min(o_orderkey) AS k FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL)
    SELECT o_custkey, string_agg(a, ',' ORDER BY k) AS aliases FROM f GROUP BY o_custkey"""
)
def ordered_first_aliases(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("a"))
    none = F.array().cast("array<string>")
    return o.select("o_custkey", F.array_join(graph.ordered_aliases(F.col("a"), none, F.lit("5-LOW")), ",").alias("aliases")).filter("aliases <> ''")


@query(
    """WITH v AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_quantity, nullif(CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END, '') AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS b FROM lineitem)
    SELECT l_suppkey, arg_min(a, row(l_orderkey, l_linenumber, l_shipdate, l_quantity)) FILTER (a IS NOT NULL) AS a, arg_min(b, row(l_orderkey, l_linenumber, l_shipdate, l_quantity)) FILTER (b IS NOT NULL) AS b FROM v GROUP BY l_suppkey"""
)
def first_non_empty(spark, sf_dir):
    """Duplicate instances of one node: the first non-empty value of each attribute wins."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.struct(*ORDER).alias("place"), F.nullif(F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linestatus")), F.lit("")).alias("a"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("b")
    )
    return line.groupBy("l_suppkey").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in "ab"])


GROUND_KEY = key_sql("{}").replace("{Z}", "{{Z}}")


@query(f"SELECT DISTINCT item_id AS quote_id, doc_id FROM (SELECT item_id, {GROUND_KEY.format('text')} AS q FROM benchmark) JOIN (SELECT doc_id, {GROUND_KEY.format('text')} AS body FROM documents) ON length(q) >= 12 AND contains(body, q)")
def quote_grounding(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return graph.ground_anywhere(b, table(spark, sf_dir, "documents"))


@query(
    f"""WITH c AS (SELECT doc_id, doc_id || '-' || ln AS chunk_id, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    q AS (SELECT doc_id, doc_id AS quote_id, CASE WHEN doc_id % 2 = 0 THEN substr(string_split(text, chr(10))[1], 5, 90) ELSE substr(string_split(text, chr(10))[1], 1, 70) || ' edited end' END AS quote FROM documents),
    k AS (SELECT doc_id, quote_id, {GROUND_KEY.format('quote')} AS q FROM q),
    p AS (SELECT quote_id, chunk_id, contains(b, q) AS whole, contains(b, substr(q, 1, 60)) AS start FROM k JOIN (SELECT doc_id, chunk_id, {GROUND_KEY.format('line')} AS b FROM c) USING (doc_id) WHERE length(q) >= 12),
    h AS (SELECT *, bool_or(whole) OVER (PARTITION BY quote_id) AS any_whole FROM p WHERE whole OR start)
    SELECT quote_id, chunk_id, CASE WHEN whole THEN 'whole' ELSE 'prefix' END AS how FROM h WHERE whole OR NOT any_whole"""
)
def quote_chunks(spark, sf_dir):
    """Quotes in chunks of their own document; those that were edited are found by their beginning."""
    d = table(spark, sf_dir, "documents")
    c = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "body")).withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("ln").cast("string")))
    first = F.get(F.split("text", "\n"), F.lit(0))
    q = d.select("doc_id", F.col("doc_id").alias("quote_id"), F.when(F.col("doc_id") % 2 == 0, F.substring(first, 5, 90)).otherwise(F.concat(F.substring(first, 1, 70), F.lit(" edited end"))).alias("quote"))
    return graph.ground(q, c)


@query(
    """WITH p AS (SELECT DISTINCT l_suppkey, 'c' || (l_orderkey % 50) AS chunk_id FROM lineitem)
    SELECT chunk_id, count(*) AS n_nodes, min('Supplier_' || l_suppkey) AS first_node FROM p GROUP BY chunk_id"""
)
def reverse_index(spark, sf_dir):
    from docweave.operators.retrieve import reverse_index as index

    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.concat(F.lit("c"), (F.col("l_orderkey") % 50).cast("string"))).alias("chunk_ids")).select(F.concat(F.lit("Supplier_"), F.col("l_suppkey").cast("string")).alias("node_id"), "chunk_ids")
    return index(n).select("chunk_id", F.size("node_ids").cast("bigint").alias("n_nodes"), F.get("node_ids", F.lit(0)).alias("first_node"))


PROVENANCE_SQL = """
  WITH refs AS (SELECT DISTINCT l_suppkey AS node_id, l_partkey AS self_ref, min(l_orderkey) OVER (PARTITION BY l_suppkey, l_partkey) AS ord FROM lineitem),
  c AS (SELECT p_partkey AS self_ref, 'k' || lpad(p_partkey::VARCHAR, 6, '0') AS chunk_id, CASE p_size % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'picture' ELSE 'text' END AS kind, CASE WHEN p_size % 2 = 0 THEN p_brand || ': ' || p_name END AS caption, p_size % 7 AS page FROM part),
  j AS (SELECT *, trim(split_part(caption, ':', 1)) AS ref, row(ord, chunk_id) AS place FROM refs JOIN c USING (self_ref))"""


@query(
    PROVENANCE_SQL + """ SELECT node_id, count(DISTINCT chunk_id) AS n_chunks, arg_min(chunk_id, place) AS first_chunk, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages,
      arg_min(ref, place) FILTER (kind = 'table' AND caption IS NOT NULL) AS table_ref, arg_min(ref, place) FILTER (kind = 'picture' AND caption IS NOT NULL) AS figure_ref FROM j GROUP BY node_id"""
)
def node_provenance(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node_id"), F.col("l_partkey").alias("self_ref")).agg(F.min("l_orderkey").alias("ord"))
    p = table(spark, sf_dir, "part")
    # Names of six places are not unique from 1,000,000 parts on, so a chunk is told by its part as well.
    name = F.concat(F.lit("k"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    chunk_id = F.concat(name, F.lit("/"), F.col("p_partkey").cast("string"))
    ref = p.select(F.col("p_partkey").alias("self_ref"), chunk_id.alias("chunk_id"))
    kind = F.when(F.col("p_size") % 3 == 0, "table").when(F.col("p_size") % 3 == 1, "picture").otherwise("text")
    c = p.select(chunk_id.alias("chunk_id"), kind.alias("kind"), F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(": "), "p_name")).alias("caption"), F.array(F.col("p_size") % 7).alias("pages"))
    out = graph.node_provenance(refs, ref, c)
    names = F.transform("chunk_ids", lambda c: F.substring(c, 1, 7))
    return out.select("node_id", F.size(F.array_distinct(names)).cast("bigint").alias("n_chunks"), F.get(names, F.lit(0)).alias("first_chunk"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "table_ref", "figure_ref")


@query(
    f"""WITH n AS ({NODES_SQL}) SELECT class, node_id, label FROM n WHERE contains(lower(concat_ws(' ', label, node_id)), 'an')"""
)
def node_search(spark, sf_dir):
    from docweave.operators.retrieve import search

    return search(nodes(spark, sf_dir), "an", ["label", "node_id"]).select("class", "node_id", "label")


#: The order tables as an extractor's output: suppliers name the parts that they supply, some of which do not exist.
LINK_ROWS = """SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_quantity, l_partkey, l_returnflag, l_extendedprice, l_discount) AS link_ord, l_partkey,
  CASE WHEN l_partkey % 7 = 0 THEN 'ghost ' ELSE 'PART  ' END || l_partkey || '.' AS target, CASE l_returnflag WHEN 'R' THEN 'nein' WHEN 'A' THEN 'ja' END AS stated,
  CASE WHEN l_linenumber = 1 THEN 'ohne Bezug ' || l_orderkey END AS quote FROM lineitem"""


def graph_plan(spark, sf_dir):
    from docweave.plans import ontology
    from docweave.plans.materialize import materialize_graph

    o = ontology.parse({
        "meta": {"name": "trade", "version": "1"},
        "classes": {"Supplier": {"description": "who supplies"}, "Part": {"description": "what is supplied", "fields": {"size": "int"}}},
        "relations": [{"name": "SUPPLIES", "source": "Supplier", "target": "Part", "properties": {"line": "int"}}],
    })
    t = lambda name: table(spark, sf_dir, name)
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    doc = F.lit("trade").alias("doc_id")
    none = lambda kind: F.lit(None).cast(kind)

    def raw(rows, cls, key, fields):
        return rows.select(doc, F.col(key).cast("int").alias("node_ord"), text(f"{cls}_", key).alias("node_id"), F.lit(cls).alias("class"), fields.alias("fields"), none("array<string>").alias("aliases"), none("array<struct<id:string,label:string>>").alias("merged"), none("array<int>").alias("pages"), none("array<string>").alias("refs"), none("string").alias("match"))

    suppliers = raw(t("supplier"), "Supplier", "s_suppkey", F.create_map(F.lit("label"), F.col("s_name")))
    parts = raw(t("part"), "Part", "p_partkey", F.create_map(F.lit("label"), text("Part ", "p_partkey"), F.lit("size"), F.col("p_size").cast("string")))
    instances = suppliers.select("doc_id", F.col("node_ord").alias("inst_ord"), "node_id", "class", "fields")
    rows = spark.sql(LINK_ROWS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t("lineitem"))
    links = rows.select(
        doc, text("Supplier_", "l_suppkey").alias("node_id"), F.col("l_suppkey").cast("int").alias("inst_ord"), F.lit(0).alias("field_ord"), "link_ord", F.lit("SUPPLIES").alias("relation"), none("string").alias("target_type"),
        "target", F.col("stated").alias("polarity"), none("string").alias("qualifier"), "quote", F.create_map(F.lit("line"), F.col("l_linenumber").cast("string")).alias("props"),
    )
    chunks = spark.createDataFrame([], "doc_id string, chunk_id string, kind string, headings array<string>, body string, caption string, pages array<int>")
    return materialize_graph(o, suppliers.unionByName(parts), instances, links, chunks, spark.createDataFrame([], "doc_id string, self_ref string, chunk_id string"))


GRAPH_SQL = f"""WITH l AS (SELECT *, 'Supplier_' || l_suppkey AS source, 'Part_' || l_partkey AS part, CASE WHEN stated = 'nein' THEN 'negative' WHEN stated = 'ja' OR quote IS NULL THEN 'positive' ELSE 'unknown' END AS polarity FROM ({LINK_ROWS}))"""


@query(GRAPH_SQL + " SELECT source, part AS target, 'SUPPLIES' AS type, polarity, arg_min(quote, link_ord) FILTER (quote IS NOT NULL) AS quote, arg_min(l_linenumber, link_ord)::VARCHAR AS line FROM l WHERE l_partkey % 7 <> 0 GROUP BY ALL")
def graph_edges(spark, sf_dir):
    """The edges of the whole plan: sources, polarity, targets, properties, merging, grounding."""
    return graph_plan(spark, sf_dir)["edges"].select("source", "target", "type", "polarity", "quote", F.col("properties")["line"].alias("line"))


@query(GRAPH_SQL + " SELECT source, 'SUPPLIES' AS type, rtrim(target) AS target, polarity, count(*) AS links FROM l WHERE l_partkey % 7 = 0 GROUP BY ALL")
def graph_unresolved(spark, sf_dir):
    return graph_plan(spark, sf_dir)["unresolved"].groupBy("source", "type", "target", "polarity").agg(F.count("*").alias("links"))


@query("SELECT 'Supplier_' || s_suppkey AS node_id, 'Supplier' AS class, s_name AS label, NULL::VARCHAR AS size FROM supplier UNION ALL SELECT 'Part_' || p_partkey, 'Part', 'Part ' || p_partkey, p_size::VARCHAR FROM part")
def graph_plan_nodes(spark, sf_dir):
    return graph_plan(spark, sf_dir)["nodes"].select("node_id", "class", "label", F.col("attributes")["size"].alias("size"))
