"""Retrieval queries: vectors, BM25, fusion, neighbourhoods, competency questions, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import retrieve
from docweave.queries.graph_queries import EDGES_SQL, NODES_SQL, edges, nodes
from docweave.queries.registry import query, table
from docweave.queries.value_queries import key_sql

KNN_SQL = """SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings v JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q ON v.vec_id <> q.vec_id"""


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({KNN_SQL})) WHERE rank <= 10")
def knn_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return retrieve.knn(v, v.filter("vec_id % 50 = 0"))


WORDS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
BM25_SQL = f"""
  WITH t AS (SELECT doc_id, {WORDS_SQL.format('text')} AS ws FROM documents), l AS (SELECT doc_id, len(ws) AS len, ws FROM t),
  s AS (SELECT count(*) AS n, avg(len) AS al FROM l),
  q AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS_SQL.format('text')})) AS term FROM benchmark),
  p AS (SELECT doc_id, len, unnest(ws) AS term FROM l), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term) CROSS JOIN s GROUP BY ALL),
  bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10)"""


def bm25(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieve.bm25(table(spark, sf_dir, "documents"), q)


@query(BM25_SQL + " SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk(spark, sf_dir):
    return bm25(spark, sf_dir)


LENGTH_SQL = "SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS rank FROM benchmark JOIN documents ON documents.doc_id % 40 = benchmark.item_id"


@query(
    BM25_SQL + f""", r AS (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM ({LENGTH_SQL}) WHERE rank <= 10),
    f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM r GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""
)
def rrf_fusion(spark, sf_dir):
    """BM25 ranks fused with ranks by length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 40).alias("query_id"))
    d = d.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    return retrieve.fuse([bm25(spark, sf_dir), retrieve.top_k(d, "query_id", "n_chars", "doc_id", 10)])


BOTH = f"WITH e AS ({EDGES_SQL}), b AS (SELECT source AS center, target AS neighbour, type, polarity, 'out' AS direction FROM e UNION ALL SELECT target, source, type, polarity, 'in' FROM e)"


@query(BOTH + " SELECT DISTINCT * FROM b WHERE center IN (SELECT 'Part_' || p_partkey FROM part WHERE p_size = 7)")
def one_hop(spark, sf_dir):
    start = table(spark, sf_dir, "part").filter("p_size = 7").select(F.concat(F.lit("Part_"), F.col("p_partkey").cast("string")).alias("id"))
    return retrieve.one_hop(edges(spark, sf_dir), start)


@query(BOTH + ", g AS (SELECT center, neighbour, max(direction) AS direction FROM b WHERE center <> neighbour GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY direction DESC, neighbour) AS place FROM g) WHERE place <= 16")
def ego_16(spark, sf_dir):
    return retrieve.ego(edges(spark, sf_dir))


@query(
    f"WITH n AS ({NODES_SQL} ), e AS (SELECT DISTINCT source, target FROM ({EDGES_SQL})) SELECT source, target, coalesce(s.label, source) AS source_label, coalesce(t.label, target) AS target_label FROM e LEFT JOIN n s ON s.node_id = source LEFT JOIN (SELECT * FROM n WHERE node_ord % 2 = 0) t ON t.node_id = target"
)
def edge_display(spark, sf_dir):
    """Edges with labels; every second target has no node, so its id is shown."""
    n = nodes(spark, sf_dir).filter("class = 'Supplier' OR node_ord % 2 = 0")
    e = edges(spark, sf_dir).select("source", "target").distinct()
    return retrieve.display_edges(e, n)


@query(
    "SELECT s_suppkey, n_name, r_name, count(DISTINCT l_partkey) AS parts FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY ALL"
)
def competency_q1(spark, sf_dir):
    """A chain of two hops, with a branch that may be empty."""
    t = lambda name: table(spark, sf_dir, name)
    parts = t("lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))
    chain = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chain.join(parts, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "n_name", "r_name", F.coalesce("parts", F.lit(0)).alias("parts"))


@query(
    """WITH other AS (SELECT p_brand, count(*) AS n FROM part WHERE regexp_matches(p_name, '[aeiou]{2}') GROUP BY p_brand)
    SELECT DISTINCT l_partkey AS part, 'supplier' AS what, 'Supplier_' || l_suppkey AS id, 1::BIGINT AS n FROM lineitem UNION ALL
    SELECT DISTINCT l_partkey, 'order', 'Order_' || l_orderkey, 1 FROM lineitem WHERE l_returnflag = 'R' UNION ALL
    SELECT p_partkey, 'same brand', p_brand, n - regexp_matches(p_name, '[aeiou]{2}')::INT FROM part JOIN other USING (p_brand) WHERE n > regexp_matches(p_name, '[aeiou]{2}')::INT"""
)
def competency_q2(spark, sf_dir):
    """Several typed sub-plans from every start node, united; parts of one brand are met through the brand, with their number."""
    line = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").withColumn("own", F.col("p_name").rlike("[aeiou]{2}").cast("int"))
    ids = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("id")
    one = F.lit(1).cast("bigint").alias("n")
    a = line.select(F.col("l_partkey").alias("part"), F.lit("supplier").alias("what"), ids("Supplier_", "l_suppkey"), one).distinct()
    b = line.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"), F.lit("order").alias("what"), ids("Order_", "l_orderkey"), one).distinct()
    brands = p.groupBy("p_brand").agg(F.sum("own").alias("all"))
    c = p.join(brands, "p_brand").filter("all > own").select(F.col("p_partkey").alias("part"), F.lit("same brand").alias("what"), F.col("p_brand").alias("id"), (F.col("all") - F.col("own")).alias("n"))
    return a.union(b).union(c)


@query("SELECT c.c_custkey, n_name, count(o_orderkey) AS orders, max(o_totalprice) AS largest FROM customer c JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def competency_q3(spark, sf_dir):
    """Reverse edges to responsible nodes."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("largest"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), "largest")


@query("SELECT n_name, p_brand, count(*) AS paths, count(DISTINCT o_orderkey) AS orders FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def competency_q4(spark, sf_dir):
    """A chain of four hops."""
    t = lambda name: table(spark, sf_dir, name)
    chain = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(t("orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    chain = chain.join(t("part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("s_nationkey"))
    return chain.groupBy("n_name", "p_brand").agg(F.count("*").alias("paths"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT s_suppkey, coalesce(p.polarity, 'no impact') AS polarity, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END AS polarity, count(*) AS n FROM lineitem GROUP BY ALL) p ON p.l_suppkey = s_suppkey")
def competency_q5(spark, sf_dir):
    """Impact with explicit negatives; what has none is still a row."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.when(F.col("l_returnflag") == "R", "negative").otherwise("positive").alias("polarity")).agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.join(line, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("polarity", F.lit("no impact")).alias("polarity"), F.coalesce("n", F.lit(0)).alias("n"))


STEPS = "SELECT DISTINCT l_orderkey AS grp, l_linenumber AS source, l_linenumber + 1 + l_suppkey % 2 AS target FROM lineitem"


@query(
    f"""WITH RECURSIVE e AS ({STEPS}), w(grp, node, depth, path) AS (
      SELECT DISTINCT grp, source, 0, [source] FROM e WHERE NOT EXISTS (SELECT 1 FROM e p WHERE p.grp = e.grp AND p.target = e.source)
      UNION ALL SELECT w.grp, e.target, w.depth + 1, list_append(w.path, e.target) FROM w JOIN e ON e.grp = w.grp AND e.source = w.node WHERE NOT list_contains(w.path, e.target))
    SELECT grp, node, max(depth) AS depth FROM w GROUP BY ALL"""
)
def competency_q6(spark, sf_dir):
    """Topological order: the longest way to each step."""
    steps = spark.sql(STEPS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return retrieve.depths(steps)


@query(
    """WITH d AS (SELECT doc_id, source, sha256(text) AS digest FROM documents), s AS (SELECT digest, source, count(*) AS own FROM d GROUP BY ALL),
    t AS (SELECT digest, sum(own)::BIGINT AS n, count(*) AS sources FROM s GROUP BY digest)
    SELECT doc_id, digest, n - own AS partners, sources - 1 AS other_sources FROM d JOIN t USING (digest) JOIN s USING (digest, source) WHERE sources > 1"""
)
def competency_q7(spark, sf_dir):
    """Partners in another source: documents of one whole text, by the class of the text, with the number of partners."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    of_source = d.groupBy("digest", "source").agg(F.count("*").alias("own"))
    of_text = of_source.groupBy("digest").agg(F.sum("own").alias("n"), F.count("*").alias("sources")).filter("sources > 1")
    found = d.join(of_source.join(of_text, "digest"), ["digest", "source"])
    return found.select("doc_id", "digest", (F.col("n") - F.col("own")).alias("partners"), (F.col("sources") - 1).alias("other_sources"))


MERGE_ROWS = "SELECT 'Order' AS class, CASE o_custkey % 3 WHEN 0 THEN 'Dr. ' || o_orderpriority WHEN 1 THEN lower(o_orderpriority) || '.' ELSE o_orderpriority END AS label, year(o_orderdate) AS doc_id, o_orderstatus AS alias FROM orders"


@query(
    f"""WITH r AS ({MERGE_ROWS}), k AS (SELECT *, regexp_replace({key_sql('label')}, '^((dr|prof|mag|herr|frau|hr|fr)\\.?\\s+)+', '') AS key FROM r)
    SELECT class, key, arg_min(label, row(doc_id, label)) AS label, count(*) AS rows, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS doc_ids, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM k GROUP BY ALL"""
)
def merge_cross_source(spark, sf_dir):
    rows = spark.sql(MERGE_ROWS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")).withColumn("aliases", F.array("alias"))
    m = retrieve.merge_across(rows)
    return m.select("class", "key", "label", "rows", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"), F.array_join("aliases", ",").alias("aliases"))


@query("SELECT 'Doc' AS class, source AS key, 'lang' AS attribute, string_agg(DISTINCT lang, ',' ORDER BY lang) AS candidates FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def attribute_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("Doc").alias("class"), F.col("source").alias("key"), F.lit("lang").alias("attribute"), F.col("lang").alias("value"))
    return retrieve.attribute_conflicts(d).withColumn("candidates", F.array_join("candidates", ","))


SHORT = "SELECT p_brand AS class, p_name AS label FROM part UNION SELECT p_brand, split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 5 = 0"


@query(
    f"""WITH l AS (SELECT DISTINCT class, label, list_sort(list_distinct({WORDS_SQL.format('label')})) AS ws FROM ({SHORT})),
    p AS (SELECT a.class, a.label, b.label AS full_label FROM l a JOIN l b ON a.class = b.class AND len(b.ws) > len(a.ws) AND list_has_all(b.ws, a.ws) WHERE len(a.ws) > 0)
    SELECT class, label, min(full_label) AS "full" FROM p GROUP BY class, label HAVING count(*) = 1"""
)
def token_subset_alias(spark, sf_dir):
    rows = spark.sql(SHORT.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return retrieve.token_subset_aliases(rows)


TIERS = {"strong": ("the", "and", "of"), "weak": ("der", "die", "que")}


@query(
    "WITH h AS (SELECT doc_id, " + ", ".join(f"len(list_filter([{', '.join(repr(t) for t in ts)}], lambda t: contains(lower(text), t)))::BIGINT AS {k}" for k, ts in TIERS.items())
    + " FROM documents) SELECT doc_id, strong, weak, CASE WHEN strong = 3 THEN 'good' WHEN strong + weak >= 3 THEN 'partial' ELSE 'poor' END AS verdict FROM h"
)
def reply_verdict(spark, sf_dir):
    """How many expected tokens a reply has, graded in three tiers."""
    hits = [F.size(F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: F.contains(F.lower(F.col("text")), t))).cast("bigint").alias(k) for k, ts in TIERS.items()]
    d = table(spark, sf_dir, "documents").select("doc_id", *hits)
    return d.withColumn("verdict", F.when(F.col("strong") == 3, "good").when(F.col("strong") + F.col("weak") >= 3, "partial").otherwise("poor"))


ROUTES = [("Tabelle", "System"), ("the", "Process"), ("que", "Contract")]


@query("SELECT conv_id, turn, r.class FROM conversations JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ROUTES) + ") r(pattern, class) ON contains(text, r.pattern)")
def table_routing(spark, sf_dir):
    """Which classes a captioned table feeds: a broadcast join on a contained pattern."""
    routes = spark.createDataFrame(ROUTES, "pattern string, class string")
    return table(spark, sf_dir, "conversations").join(F.broadcast(routes), F.expr("contains(text, pattern)")).select("conv_id", "turn", "class")
