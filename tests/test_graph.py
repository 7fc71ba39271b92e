from pyspark.sql import functions as F

from docweave.operators import graph, retrieve

NODE = "node_id string, class string, node_ord int, keys array<string>, label string, aliases array<string>"


def test_resolution(spark):
    nodes = spark.createDataFrame(
        [("s1", "System", 1, ["SYS-1"], "Mail", ["post"]), ("s2", "System", 2, ["SYS-2"], "mail.", []), ("p1", "Person", 3, ["Lang"], "Lang", []), ("h1", "Host", 4, ["post"], "post", [])], NODE
    )
    found = graph.resolver(nodes)
    links = spark.createDataFrame(
        [(1, "USES", None, " MAIL;"), (2, "USES", "Host", "post"), (3, "USES", "System", "post"), (4, "USES", None, "Lang"), (5, "USES", None, "gone"), (6, "USES", None, " ")],
        "link_id int, relation string, target_type string, target string",
    )
    relations = spark.createDataFrame([("USES", "System", 0), ("USES", "Host", 1)], "relation string, class string, place int")
    got = graph.resolve(links, found, relations)
    assert {r.link_id: r.target_id for r in got.collect()} == {1: "s1", 2: "h1", 3: "s1", 4: None, 5: None}
    why = {r.link_id: r.reason for r in graph.unresolved(got, found).collect()}
    assert why == {4: "only in classes not permitted: Person", 5: "no such node"}
    shuffled = graph.resolver(nodes.orderBy(F.desc("node_ord")).repartition(3))
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, found.collect()))


def test_edges_merge_and_conflict(spark):
    rows = [
        ("a", "b", "T", "positive", None, "q1", {"x": "1"}, "first", 1),
        ("a", "b", "T", "positive", "said", "q2", {"x": "2", "y": "3"}, "second", 2),
        ("a", "b", "T", "negative", None, None, None, "third", 3),
    ]
    e = spark.createDataFrame(rows, "source string, target string, type string, polarity string, quote string, qualifier string, properties map<string,string>, provenance string, i int")
    merged = {r.polarity: r for r in graph.merge_edges(e, ["i"]).collect()}
    p = merged["positive"]
    assert (p.quote, p.qualifier, p.provenance, p.properties, p.rows) == ("said", "q1", "first", {"x": "1", "y": "3"}, 2)
    assert graph.conflicts(e).first().polarities == ["negative", "positive"]


def test_grounding(spark):
    quotes = spark.createDataFrame([(1, 1, "Ein  langes Zitat hier"), (1, 2, "zu kurz"), (1, 3, "x" * 61 + " edited"), (2, 4, "Ein langes Zitat hier")], "doc_id int, quote_id int, quote string")
    chunks = spark.createDataFrame([(1, "c1", "vor ein langes zitat hier nach"), (1, "c2", "y " + "x" * 61 + " other")], "doc_id int, chunk_id string, body string")
    assert sorted(map(tuple, graph.ground(quotes, chunks).collect())) == [(1, "c1", "whole"), (3, "c2", "prefix")]
    texts = chunks.select(F.col("chunk_id").alias("doc_id"), F.col("body").alias("text"))
    assert sorted(map(tuple, graph.ground_anywhere(quotes, texts).collect())) == [(1, "c1"), (4, "c1")]


def test_token_subsets(spark):
    rows = spark.createDataFrame([("P", "Anna Lang"), ("P", "Lang"), ("P", "Max Lang"), ("P", "Anna")], "class string, label string")
    assert [tuple(r) for r in retrieve.token_subset_aliases(rows).collect()] == [("P", "Anna", "Anna Lang")]


def test_ego_and_depths(spark):
    e = spark.createDataFrame([("a", "b", "T", "positive"), ("a", "a", "T", "positive"), ("c", "a", "T", "positive")], "source string, target string, type string, polarity string")
    assert [(r.neighbour, r.direction) for r in retrieve.ego(e).filter("center = 'a'").orderBy("place").collect()] == [("b", "out"), ("c", "in")]
    steps = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 3, 2)], "grp int, source int, target int")
    assert {r.node: r.depth for r in retrieve.depths(steps).collect()} == {1: 0, 2: 2, 3: 2}
