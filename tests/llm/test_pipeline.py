"""The pipeline's stages, each judged on its own input, and as a whole."""

import random

import pytest
import corpus_pipeline
from docweave.llm import minhash, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        ws = [f"w{rng.randrange(5000)}q" for _ in range(60)]
        if i % 5 == 0:
            for at in (3, 20, 40):
                ws[at] = rng.choice(["vileness", "scornful", "hateful"])
        rows.append((i, " ".join(ws) + "\nthe same closing line in each text\n" + f"tail {i} " + " ".join(ws[:7]), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0), (502, rows[1][1], "en", "s1", 0), (502, rows[1][1], "en", "s1", 0), (503, "single", None, None, 6)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder).cache()
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        assert stage(spark, docs.limit(0), folder).count() == 0
        before, after = docs.collect(), out.collect()
        if i == 0:
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == set(range(0, 240, 5))
        elif i == 1:
            lines = [line for r in sorted(after, key=lambda r: r.doc_id) for line in (r.text or "").split("\n") if line]
            assert len(after) == len(before) and sum("closing line" in x for x in lines) == 1
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        elif i == 2:
            components = {r.doc_id: r.component_id for r in minhash.near_components(docs).collect()}
            assert {r.doc_id for r in after} == {d for d, c in components.items() if d == c}
        elif i == 3:
            plan = {(r.doc_id): r for r in mixing.mix(docs).collect()}
            words = {}
            for r in after:
                words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
            assert words == {d: r.taken for d, r in plan.items() if r.taken}
        else:
            assert len(after) == len(before) and {r.doc_id for r in after} == {r.doc_id for r in before}
        docs = out
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert {"op4_mixing", "op6_exact_dedup"} <= set(e.oracle_sql())


def test_sql(spark):
    import os

    import duckdb

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ("op4_mixing", "op6_exact_dedup"):
        got = e.queries()[name](spark, sf)
        want = con.execute(e.oracle_sql()[name]).df()
        key = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
        assert key(got.select(sorted(got.columns)).toPandas()) == key(want)


def test_kept_memory(spark, folder):
    """What a worker keeps for one operator is freed when another begins there; the mixture's plan has each text once."""
    import public_tokenizers

    from docweave.llm import bpe
    from docweave.llm.common import begins

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    first = bpe.codec(path, public_tokenizers.PATTERN, 1000)
    begins("bpe")
    assert bpe.codec(path, public_tokenizers.PATTERN, 1000) is first
    begins("toxicity")
    assert bpe.codec(path, public_tokenizers.PATTERN, 1000) is not first
    plan = mixing.mix_documents(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_kept_0" in plan and "_kept_1" not in plan
