from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.operators import chunks, layout

ITEM = "doc_id int, pos int, label string, layer string, level int, text string, page_no int, bbox struct<l double, t double, r double, b double>, page_w double, page_h double"


def test_repeated_furniture(spark):
    rows = []
    for p in range(1, 4):
        rows += [(1, p * 10, "text", "BODY", None, "Company manual", p, (0.0, 790.0, 9.0, 780.0), 600.0, 800.0)]
        rows += [(1, p * 10 + 1, "text", "BODY", None, f"Page {p} of 3", p, (0.0, 20.0, 9.0, 10.0), 600.0, 800.0)]
        rows += [(1, p * 10 + 2, "text", "BODY", None, "In the middle", p, (0.0, 400.0, 9.0, 380.0), 600.0, 800.0)]
    out = layout.repeated_furniture(spark.createDataFrame(rows, ITEM))
    assert out.filter("layer = 'FURNITURE'").count() == 6
    assert out.filter("layer = 'BODY'").select("text").distinct().collect()[0][0] == "In the middle"
    assert layout.repeated_furniture(spark.createDataFrame(rows, ITEM), min_pages=0).filter("layer <> 'BODY'").isEmpty()


def test_heading_levels_and_breadcrumbs(spark):
    texts = ["Preface", "1 One", "1.1 Sub", "1.1.1 Deep", "Plain", "1.2 Next"]
    rows = [(1, i, "section_header", 2, t) for i, t in enumerate(texts)]
    levels = layout.heading_levels(spark.createDataFrame(rows, "doc_id int, pos int, label string, level int, text string"))
    assert [r.new_level for r in levels.orderBy("pos").collect()] == [2, 1, 2, 3, 4, 2]
    crumbs = layout.breadcrumbs(levels.withColumn("level", F.col("new_level"))).orderBy("pos").collect()
    assert crumbs[4].breadcrumb == ["1 One", "1.1 Sub", "1.1.1 Deep", "Plain"]
    assert crumbs[5].breadcrumb == ["1 One", "1.2 Next"]


def test_captions(spark):
    rows = [(1, 1, "h", "Own", None), (1, 2, "h", None, "near"), (1, 3, "", None, None), (1, 4, "g", None, "near 4"), (1, 5, "g", None, None)]
    out = layout.continued_captions(spark.createDataFrame(rows, "doc_id int, pos int, header string, explicit string, nearby string")).orderBy("pos").collect()
    assert [r.caption for r in out] == ["Own", "Own", None, "near 4", "near 4"]
    assert [r.inferred for r in out] == [False, True, False, True, True]


def draft(body, kind="text", headings=()):
    return {"kind": kind, "headings": list(headings), "body": body, "caption": None, "refs": ["#"]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc .!", max_size=60), max_size=8), st.integers(8, 30))
def test_splitting_loses_no_word(lines, limit):
    packed = chunks.Packer(limit).pack([draft("\n".join(lines), headings=["h"])])
    assert " ".join(p["body"] for p in packed).split() == " ".join(lines).split()
    for p in packed:
        longest = max(map(chunks.count_tokens, p["body"].split(" ")), default=0)
        assert chunks.count_tokens("h\n" + p["body"]) <= max(limit, longest + 1)


def test_table_parts_repeat_their_head():
    table = "Table 1: x\n| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | {i} |" for i in range(40))
    parts = chunks.Packer(60).pack([draft(table, "table")])
    assert len(parts) > 1 and all(p["body"].startswith("Table 1: x\n| a | b |\n|---|---|\n") for p in parts)
    assert sum(p["body"].count("row ") for p in parts) == 40


def test_peers_merge_under_equal_headings():
    out = chunks.Packer(64).pack([draft("a b"), draft("c d"), draft("e", headings=["h"])])
    assert [p["body"] for p in out] == ["a b\nc d", "e"]
