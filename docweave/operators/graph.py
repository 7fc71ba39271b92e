"""The property graph from raw nodes and links: resolution, merging, conflicts, grounding.

"First wins" is spelt out by ordinals everywhere: node_ord for nodes, and
(inst_ord, field_ord, link_ord) for links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.text import norm_key, strip
from docweave.operators.joins import broadcast_if_small

#: Characters of a quote that must be there at least, and that are tried alone when the whole is not found.
MIN_QUOTE, QUOTE_PREFIX = 12, 60
#: Quotes of one or two words that are looked for in one pass over the texts, about.
MAX_SHORT = 20_000


def identity(keys: list[Column]) -> Column:
    """The keys joined by `` | ``; null unless all are there."""
    there = F.lit(True)
    for k in keys:
        there = there & k.isNotNull() & (strip(k) != "")
    return F.when(there, F.concat_ws(" | ", *keys))


def label(display: Column, keys: list[Column]) -> Column:
    return F.coalesce(F.nullif(strip(display), F.lit("")), identity(keys))


def node_id(class_name: Column, key: Column) -> Column:
    return F.concat(class_name, F.lit("_"), F.substring(F.sha2(norm_key(key), 256), 1, 16))


def ordered_aliases(aliases: Column, merged: Column, name: Column) -> Column:
    """Distinct aliases in their order, then those of merged entries, without the label."""
    return F.array_distinct(F.filter(F.concat(aliases, merged), lambda x: x.isNotNull() & (x != "") & ~x.eqNullSafe(name)))


def resolver(nodes: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope.., class, key, stripped, node_id): first registration wins.

    ``nodes`` (node_id, class, node_ord, keys, label, aliases): each identity
    key registers by itself, then the label, then the aliases.  Where a column
    ``strip_titles`` says so, keys are without titles.  ``scope`` names columns,
    such as the document, that are resolved apart.
    """
    if "strip_titles" not in nodes.columns:
        nodes = nodes.withColumn("strip_titles", F.lit(False))
    ranked = nodes.select(
        *scope,
        F.col("strip_titles").alias("stripped"),
        "node_id",
        "class",
        "node_ord",
        F.explode(
            F.concat(
                F.transform("keys", lambda k: F.struct(F.lit(0).alias("rank"), k.alias("text"))),
                F.array(F.struct(F.lit(1).alias("rank"), F.col("label").alias("text"))),
                F.transform("aliases", lambda k: F.struct(F.lit(2).alias("rank"), k.alias("text"))),
            )
        ).alias("r"),
    )
    key = F.when(F.col("stripped"), norm_key(F.col("r.text"), strip_titles=True)).otherwise(norm_key(F.col("r.text")))
    keyed = ranked.select(*scope, "class", "stripped", key.alias("key"), "node_id", "node_ord", "r.rank").filter("key <> ''")
    return keyed.groupBy(*scope, "class", "key", "stripped").agg(F.min_by("node_id", F.struct("node_ord", "rank", "node_id")).alias("node_id"))


def _keyed(links: DataFrame) -> DataFrame:
    """Two rows a link: the target's key as it is, and without titles, for classes that strip them."""
    plain, stripped = (F.struct(F.lit(s).alias("stripped"), norm_key(F.col("target"), strip_titles=s).alias("key")) for s in (False, True))
    return links.withColumn("_k", F.explode(F.array(plain, stripped))).withColumn("_key", F.col("_k.key")).withColumn("_stripped", F.col("_k.stripped")).drop("_k")


def _meets(found: DataFrame, scope: tuple[str, ...]) -> tuple[DataFrame, Column]:
    other = found.select(*[F.col(c).alias(f"_{c}_of") for c in scope], F.col("class").alias("_class"), F.col("key").alias("_found"), F.col("stripped").alias("_s"), F.col("node_id").alias("_node"))
    same = (F.col("_key") == F.col("_found")) & (F.col("_stripped") == F.col("_s"))
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_of"))
    return other, same


def resolve(links: DataFrame, found: DataFrame, relations: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``target_id`` to links (link_id, relation, target_type, target), null where nothing fits.

    ``relations`` (relation, class, place) lists the permitted target classes in
    their order; the stated class is tried first if permitted.  Each link is
    joined by key alone and the hits are ranked by class, so a wildcard target
    costs no more than a single class.
    """
    stated = links.filter(strip(F.col("target")) != "")
    other, same = _meets(found, scope)
    hits = _keyed(stated).join(other, same)
    permitted = hits.join(F.broadcast(relations.select(F.col("relation").alias("_rel"), F.col("class").alias("_c"), "place")), (F.col("relation") == F.col("_rel")) & (F.col("_class") == F.col("_c")))
    rank = F.struct(F.when(F.col("_class") == F.col("target_type"), 0).otherwise(1), "place")
    best = permitted.groupBy("link_id").agg(F.min_by("_node", rank).alias("target_id"), F.min_by("_class", rank).alias("target_class"))
    return stated.join(best, "link_id", "left")


def unresolved(resolved: DataFrame, found: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Links without a target, with the classes, not permitted ones, in which the key does occur."""
    open_ = resolved.filter("target_id IS NULL").drop("target_id", "target_class")
    other, same = _meets(found, scope)
    classes = _keyed(open_).join(other, same).groupBy("link_id").agg(F.array_join(F.array_sort(F.collect_set("_class")), ",").alias("other_classes"))
    joined = open_.join(classes, "link_id", "left")
    reason = F.when(F.col("other_classes").isNull(), "no such node").otherwise(F.concat(F.lit("only in classes not permitted: "), F.col("other_classes")))
    return joined.withColumn("reason", reason).drop("other_classes")


def remap(rows: DataFrame, merged: DataFrame, column: str = "node_id") -> DataFrame:
    """Ids that were merged into another node are replaced by that node's; ``merged`` (old_id, survivor)."""
    to = merged.select(F.col("old_id").alias("_old"), F.col("survivor").alias("_new"))
    return rows.join(to, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def merge_edges(edges: DataFrame, order: list[str], scope: tuple[str, ...] = ()) -> DataFrame:
    """One edge for each (source, target, type, polarity).

    The first row makes it, with its provenance; later rows only fill in a
    missing quote, a missing qualifier, and properties it lacks.
    """
    place = F.struct(*order)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), place)).alias(c)
    properties = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))).alias("es"))))
    grouped = edges.groupBy(*scope, "source", "target", "type", "polarity").agg(first("quote"), first("qualifier"), F.min_by("provenance", place).alias("provenance"), properties.alias("ps"), F.count("*").alias("rows"))
    flat = F.flatten(F.transform("ps", lambda p: p["es"]))
    names = F.array_distinct(F.transform(flat, lambda e: e["key"]))
    kept = F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.get(F.filter(flat, lambda e: e["key"] == k), F.lit(0))["value"])))
    return grouped.withColumn("properties", kept).drop("ps")


def conflicts(edges: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, type, polarities) where both polarities are stated."""
    found = edges.groupBy(*scope, "source", "target", "type").agg(F.array_sort(F.collect_set("polarity")).alias("polarities"))
    return found.filter(F.array_contains("polarities", "positive") & F.array_contains("polarities", "negative"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes by type, edges by type and by polarity, and both totals, in a pass each."""
    n = nodes.groupBy(F.col("class")).agg(F.count("*").alias("n")).select(F.lit("nodes_by_type").alias("what"), F.col("class").alias("name"), "n")
    e = edges.groupingSets([[F.col("type")], [F.col("polarity")], []], "type", "polarity").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    e = e.select(F.when(F.col("g") == 1, "edges_by_type").when(F.col("g") == 2, "edges_by_polarity").otherwise("edges").alias("what"), F.coalesce("type", "polarity", F.lit("")).alias("name"), "n")
    total = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), F.lit("").alias("name"), "n")
    return n.unionByName(e).unionByName(total)


def quote_key(x: Column) -> Column:
    """Quotes are compared by the key that names are matched by, so a full stop at their end does not matter."""
    return norm_key(x)


def ground(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(quote_id, chunk_id, how): chunks of the same document that hold a quote.

    Quotes of under MIN_QUOTE characters hold nowhere.  A quote that no chunk
    holds is looked for by its first QUOTE_PREFIX characters.
    """
    q = quotes.select("doc_id", "quote_id", quote_key(F.col("quote")).alias("q")).filter(F.length("q") >= MIN_QUOTE)
    c = chunks.select(F.col("doc_id").alias("_doc"), "chunk_id", quote_key(F.col("body")).alias("body"))
    pairs = q.join(c, F.col("doc_id") == F.col("_doc"))
    hits = pairs.select("quote_id", "chunk_id", F.contains("body", "q").alias("whole"), F.contains("body", F.substring("q", 1, QUOTE_PREFIX)).alias("start")).filter("whole OR start")
    any_whole = F.max("whole").over(W.partitionBy("quote_id"))
    return hits.withColumn("any", any_whole).filter("whole OR NOT any").select("quote_id", "chunk_id", F.when(F.col("whole"), "whole").otherwise("prefix").alias("how"))


def ground_anywhere(quotes: DataFrame, texts: DataFrame, words: int = 6) -> DataFrame:
    """(quote_id, doc_id) of all texts that hold a quote, whatever their document.

    Texts and quotes meet on word n-grams: a text that holds the quote holds the
    n-gram inside it that the fewest texts have.  So there is no nested loop.
    """

    def grams(rows, column):
        """``rows`` with ``grams``: the n-grams of a column of words, shorter ones at the end."""
        shifted = [F.slice(column, i + 1, 1 << 30).alias(f"w{i}") for i in range(words)]
        return rows.withColumn("grams", F.transform(F.arrays_zip(*shifted), lambda z: F.concat_ws(" ", *[z[f"w{i}"] for i in range(words)])))

    q = quotes.select("quote_id", quote_key(F.col("quote")).alias("q")).filter(F.length("q") >= MIN_QUOTE)
    # The first and last word may be parts of longer ones, so only whole words between them are used.
    q = q.withColumn("inner", F.filter(F.slice(F.split("q", " "), F.lit(2), F.greatest(F.size(F.split("q", " ")) - 2, F.lit(0))), lambda w: w != ""))
    full = F.slice("grams", 1, F.size("inner") - words + 1)
    probes = grams(q.filter("size(inner) > 0"), "inner").select("quote_id", "q", F.explode(F.when(F.size("inner") >= words, full).otherwise(F.col("inner"))).alias("g"))
    body = quote_key(F.col("text"))
    posted = grams(texts.select("doc_id", F.split(body, " ").alias("ws")), "ws").select("doc_id", F.explode(F.array_distinct(F.concat("grams", "ws"))).alias("g")).join(broadcast_if_small(probes.select("g").distinct()), "g", "left_semi")
    rare = probes.join(posted.groupBy("g").agg(F.count("*").alias("n")), "g").groupBy("quote_id", "q").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    pairs = rare.join(posted, "g").select("quote_id", "q", "doc_id")
    whole = texts.select(F.col("doc_id").alias("_doc"), body.alias("body"))
    found = pairs.join(whole, F.col("doc_id") == F.col("_doc")).filter(F.contains("body", "q")).select("quote_id", "doc_id")
    # Quotes of one or two words have no whole word inside; an automaton looks for a block of them in each text.
    short = q.filter("size(inner) = 0").select("quote_id", "q")
    blocks = -(-short.count() // MAX_SHORT)
    for block in range(blocks):
        own = short.filter(F.pmod(F.xxhash64("quote_id"), F.lit(blocks)) == block)
        found = found.unionByName(contained(own, whole))
    return found.distinct()


def contained(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(quote_id, doc_id) of a block of about MAX_SHORT quotes (quote_id, q) in texts (_doc, body), in one pass."""
    id_type = quotes.schema["quote_id"].dataType
    doc_type = bodies.schema["_doc"].dataType
    of: dict[str, list] = {}
    for r in quotes.collect():  # a block
        of.setdefault(r.q, []).append(r.quote_id)
    known = quotes.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for q in known.value:
            automaton.add_word(q, q)
        automaton.make_automaton()
        for batch in batches:
            ids, docs = [], []
            for doc, body in zip(batch.column("_doc").to_pylist(), batch.column("body").to_pylist()):
                for q in {q for _, q in automaton.iter(body or "")}:
                    ids += known.value[q]
                    docs += [doc] * len(known.value[q])
            yield pa.RecordBatch.from_pydict({"quote_id": ids, "doc_id": docs}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    import pyarrow as pa

    arrow = pa.schema([("quote_id", to_arrow_type(id_type)), ("doc_id", to_arrow_type(doc_type))])
    return bodies.select("_doc", "body").mapInArrow(run, f"quote_id {id_type.simpleString()}, doc_id {doc_type.simpleString()}")


def edge_chunks(edges: DataFrame, hits: DataFrame, node_chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_ids``: where the quote was found, else the source node's chunks."""
    found = hits.groupBy("quote_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("_hits")).withColumnRenamed("quote_id", "_q")
    own = node_chunks.select(F.col("node_id").alias("_n"), F.col("chunk_ids").alias("_own"))
    joined = edges.join(found, F.col("quote_id") == F.col("_q"), "left").join(own, F.col("source") == F.col("_n"), "left")
    return joined.withColumn("chunk_ids", F.coalesce("_hits", "_own", F.array().cast("array<string>"))).drop("_q", "_hits", "_n", "_own")


def node_provenance(refs: DataFrame, chunk_ref: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, chunk_ids, pages, breadcrumb, table_ref, figure_ref) from nodes' refs (node_id, ord, self_ref)."""
    if "headings" not in chunks.columns:
        chunks = chunks.withColumn("headings", F.array().cast("array<string>"))
    rows = refs.join(chunk_ref.select("self_ref", "chunk_id"), "self_ref").join(chunks.select("chunk_id", "kind", "caption", "pages", "headings"), "chunk_id")
    place = F.struct("ord", "chunk_id")
    ref = strip(F.split_part(F.col("caption"), F.lit(":"), F.lit(1)))
    return rows.groupBy("node_id").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(place)), lambda p: p["chunk_id"])).alias("chunk_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.min_by("headings", F.when(F.size("headings") > 0, place)).alias("breadcrumb"),
        F.min_by(ref, F.when((F.col("kind") == "table") & F.col("caption").isNotNull(), place)).alias("table_ref"),
        F.min_by(ref, F.when((F.col("kind") == "picture") & F.col("caption").isNotNull(), place)).alias("figure_ref"),
    )
