import copy

import pytest

from docweave.plans import ontology, process, providers, settings
from docweave.sources import cache, documents, sinks

MINIMAL = {
    "meta": {"name": "m", "version": "1"},
    "enums": {"level": ["low", "high"]},
    "datatypes": {"ticket": {"python": "str", "pattern": "T-[0-9]+"}, "day": {"python": "date"}},
    "classes": {
        "Person": {"description": "someone", "identity": {"keys": ["label"], "normalize": "strip_titles"}, "fields": {"since": "day"}},
        "Incident": {"description": "something", "identity": {"keys": ["ticket"]}, "fields": {"ticket": "ticket", "severity": "level", "tags": {"type": "str", "many": True}}},
    },
    "relations": {
        "CAUSED_BY": {"source": "Incident", "target": ["Person", "Incident"], "properties": {"severity": "level"}},
        "MENTIONED_IN": {"source": "*", "target": "Incident"},
        "KNOWS": {"source": "Person", "target": "*"},
    },
    "extraction_rules": {"negation": 'say "nicht" or "ohne Bezug"'},
}


def test_compile(spark):
    o = ontology.load(MINIMAL)
    c = ontology.compile_ontology(o)
    assert list(c.skipped) == ["MENTIONED_IN"] and set(c.links) == {"CAUSED_BY", "KNOWS"}
    assert not c.entities["Incident"]["ticket"].nullable and c.entities["Incident"]["severity"].nullable
    assert c.entities["Incident"]["tags"].dataType.simpleString() == "array<string>"
    assert o.triggers(("x",)) == ("nicht", "ohne Bezug") and o.type("level").kind == "enum"
    assert c.schema_hash == ontology.compile_ontology(ontology.load({**MINIMAL, "extra": 1})).schema_hash
    assert ontology.ontology_hash(o) == ontology.ontology_hash(ontology.load({**MINIMAL, "extra": 1}))
    t = ontology.tables(spark, o)
    assert t["relations"].filter("relation = 'KNOWS'").count() == 2 and t["fields"].count() == 4
    assert ontology.report(c)["classes"]["Person"] == {"fields": 1, "links": 1}


@pytest.mark.parametrize(
    "path, value, message",
    [
        (("meta", "name"), "", "is missing"),
        (("datatypes", "ticket", "pattern"), "(", "does not compile"),
        (("classes", "Person", "description"), "", "description is missing"),
        (("classes", "Person", "fields"), {"label": "str"}, "exist in every class"),
        (("classes", "Incident", "identity", "keys"), ["tags"], "must be a scalar"),
        (("classes", "Incident", "identity", "keys"), ["a", "b", "c"], "one or two"),
        (("relations", "KNOWS", "target"), "Nobody", "unknown target class"),
        (("relations", "KNOWS", "properties"), {"quote": "str"}, "exist in every link"),
        (("classes",), {}, "at least one class"),
    ],
)
def test_problems(path, value, message):
    document = copy.deepcopy(MINIMAL)
    at = document
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = value
    with pytest.raises(ontology.OntologyError, match=message):
        ontology.load(document)


def test_settings_layers():
    s = settings.load({"chunking": {"max_tokens": 64}}, env={"DOCWEAVE__EXTRACTION__BASE_URL": "http://x", "DOCWEAVE__CHUNKING__MAX_TOKENS": "99", "DOCWEAVE__EXTRACTION__API_KEY": "k"})
    assert s.chunking.max_tokens == 64 and s.embedding.base_url == "http://x"
    assert settings.redacted(s)["extraction"]["api_key"] == "***"
    with pytest.raises(ValueError):
        settings.load({"chunking": {"nope": 1}}, env={})
    assert process.cache_key("a", s, "h") != process.cache_key("a", settings.Settings(), "h")


def test_process(spark, tmp_path):
    page = "<h1>1 One</h1><p>First part.</p><p>Ticket T-12 here.</p><h2>Other</h2><script>no</script><p>Last &amp; least</p>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text(page)
    (tmp_path / "in/b.bin").write_text("x")
    (tmp_path / "in/c.md").write_text("")
    docs = documents.scan(spark, str(tmp_path / "in"))
    assert {r.name: r.problem for r in docs.collect()} == {"a.html": None, "b.bin": "unsupported format"}
    out = process.process(documents.items(docs), embedder=lambda: providers.HashingEmbedder(16), patterns={"Ticket": r"T-\d+"})
    chunks = out["chunks"].orderBy("part").collect()
    assert [c.body for c in chunks] == ["First part.\nTicket T-12 here.", "Last & least"]
    assert chunks[1].headings == ["1 One", "Other"] and len(chunks[0].embedding) == 16 and chunks[0].chunk_id.endswith("-0000")
    assert out["nodes"].first().label == "T-12"
    assert out["markdown"].first().markdown.startswith("# 1 One\n\nFirst part.")
    assert process.summary(out["chunks"]).first().embedded == 2
    sinks.write_relations({"chunks": out["chunks"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 2
    sinks.write_markdown(out["markdown"], str(tmp_path / "md"))


def test_requests(spark):
    rows = [("a.pdf", "", "aGk="), ("a", "text/html; x", "!!"), ("a.md", "", ""), ("b", "MD", "aGk=")]
    got = documents.decode(spark.createDataFrame(rows, "name string, stated string, body string"))
    assert [(r.format, r.problem) for r in got.collect()] == [("pdf", None), (None, "not base64"), ("md", "empty"), ("md", None)]
    big = spark.createDataFrame([("a.md", "", "a" * 3_000_000)], "name string, stated string, body string")
    assert documents.decode(big, max_mb=1).first().problem == "too large"


def test_cache(spark, tmp_path):
    schema = "sha string, degraded boolean"
    path = str(tmp_path / "cache")
    assert cache.read_cache(spark, path, schema).count() == 0
    cache.write_cache(spark.createDataFrame([("aa1", False), ("bb2", True)], schema), path, "sha")
    assert [r.sha for r in cache.read_cache(spark, path, "sha string").collect()] == ["aa1"]


def test_providers(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise providers.CallError(503)
        return "done"

    waits = []
    assert providers.with_retries(flaky, sleep=waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(providers.CallError):
        providers.with_retries(lambda: (_ for _ in ()).throw(providers.CallError(400)), sleep=waits.append)

    class Wrong(providers.HashingEmbedder):
        def embed(self, texts):
            return [[0.0]] * len(texts)

    with pytest.raises(ValueError, match="dimension"):
        providers.embed_batches(Wrong(4), ["a"], 2)
    assert len(providers.embed_batches(providers.HashingEmbedder(4), list("abcde"), 2)) == 5
    rows = spark.createDataFrame([("i1", "c", 0.5), ("bad", "c", 0.5), ("i3", "c", 0.01), ("long", "c", 1.0)], "image string, caption string, area double")

    def describer(image, caption):
        if image == "bad":
            raise RuntimeError("status 500")
        return "text", "length" if image == "long" else "stop"

    done = providers.describe(rows, describer, min_area=0.1)
    assert tuple(providers.describe_report(done).first()) == (1, 1, 2)


def test_stream(spark, tmp_path):
    from docweave.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# T\n\ntext")
    (folder / "b.md").write_text("# T\n\ntext")
    got = []
    run = lambda: ingest.ingest(spark, str(folder), str(tmp_path / "cp"), lambda df, i: got.extend(df.select("format").collect())).awaitTermination()
    run()
    (folder / "c.md").write_text("other")
    run()
    assert len(got) == 2


def test_self_check(spark):
    assert process.self_check(spark)["status"] == "ok" and "html" in process.capabilities()["parsed_here"]


def test_settled_drops_its_shuffle_files(spark):
    """Tables on the way are in the shared folder; what their making has shuffled does not stay beside them."""
    import time

    from pyspark.sql import functions as F

    from docweave.sources.scratch import settled

    def files():
        seq = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in seq.split("\n") if "shuffle_" in f and f.endswith(".data")}

    before = files()
    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 10).alias("k")).count()
    got = settled(df, "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert got.count() == 10 and df.count() == 10
