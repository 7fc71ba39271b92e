"""Queries on text functions, typed values and polarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import polarity, text, values
from docweave.queries.registry import query, table

LINES = "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def squeeze_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def key_sql(x: str) -> str:
    return fold_sql(f"regexp_replace({squeeze_sql(x)}, '[.,;:]+$', '')")


def furniture_sql(x: str) -> str:
    return fold_sql(f"regexp_replace({squeeze_sql(x)}, '\\d+', '#', 'g')")


def lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


@query(f"SELECT doc_id, ln, {key_sql('line')} AS key FROM ({LINES})")
def norm_key_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "ln", text.norm_key(F.col("line")).alias("key"))


TITLED = ["Dr. Anna  Weiß,", "Prof. Dr. Max Groß", "Herr Klein:", "Frau Dr. Öz", "drake one", "Mag. Ü"]


@query(
    "SELECT name, " + fold_sql(r"regexp_replace(regexp_replace(" + squeeze_sql("name") + r", '[.,;:]+$', ''), '^((dr|prof|dipl\.?-ing|mag|herr|frau|hr|fr)\.?\s+)+', '', 'i')")
    + " AS key FROM (VALUES " + ", ".join(f"('{n}')" for n in TITLED) + ") t(name)"
)
def title_stripping(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in TITLED], "name string").select("name", text.norm_key(F.col("name"), strip_titles=True).alias("key"))


@query(r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS stem FROM pages")
def safe_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_stem(F.col("url")).alias("stem"))


@query("SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS length FROM documents")
def doc_sha(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("bigint").alias("length"))


@query(
    r"SELECT doc_id, len(string_split_regex(regexp_replace(text, '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)))::BIGINT AS sentences FROM documents"
)
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query(
    "SELECT conv_id, turn, concat_ws(' ', nullif(trim(role), ''), nullif(trim(text), '')) AS evidence, trim(split_part(text, ':', 1)) AS reference FROM conversations"
)
def evidence_strings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.evidence(F.col("role"), F.col("text")).alias("evidence"), text.caption_reference(F.col("text")).alias("reference"))


@query("SELECT doc_id, lang || chr(10) || source || chr(10) || text AS context FROM documents")
def contextualize(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.contextualize(F.array("lang", "source"), F.col("text")).alias("context"))


NUMBERS_SQL = r"""
WITH raw AS (
  SELECT o_orderkey AS id, CASE o_orderkey % 5
    WHEN 0 THEN round(o_totalprice, 2)::VARCHAR WHEN 1 THEN replace(round(o_totalprice, 2)::VARCHAR, '.', ',')
    WHEN 2 THEN ' ' || o_custkey || ' %' WHEN 3 THEN '1.' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || ',5' ELSE o_orderstatus || '1d' END AS raw FROM orders),
s AS (SELECT id, raw, regexp_replace(raw, '[ %]', '', 'g') AS t FROM raw),
n AS (SELECT id, raw, CASE WHEN contains(t, ',') AND contains(t, '.') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '.') END AS t FROM s),
v AS (SELECT id, raw, CASE WHEN regexp_full_match(t, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') THEN t::DOUBLE END AS n FROM n)
"""


def raw_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    price = F.round("o_totalprice", 2).cast("string")
    k = F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, price).when(k == 1, F.replace(price, F.lit("."), F.lit(",")))
        .when(k == 2, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" %")))
        .when(k == 3, F.concat(F.lit("1."), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit(",5")))
        .otherwise(F.concat("o_orderstatus", F.lit("1d")))
    )
    return o.select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


@query(NUMBERS_SQL + "SELECT id, round(n, 4) AS number, CASE WHEN n IS NULL THEN 'no number' END AS problem FROM v")
def number_parse(spark, sf_dir):
    raw = F.col("raw")
    return raw_numbers(spark, sf_dir).select("id", F.round(values.number(raw), 4).alias("number"), values.as_float(raw)["problem"].alias("problem"))


@query(NUMBERS_SQL + "SELECT id, CASE WHEN n IS NULL THEN raw ELSE trunc(n)::BIGINT::VARCHAR END AS value, CASE WHEN n IS NULL THEN 'no whole number' END AS problem FROM v")
def int_normalize(spark, sf_dir):
    return raw_numbers(spark, sf_dir).select("id", values.as_int(F.col("raw")).alias("r")).select("id", "r.value", "r.problem")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


@query(
    "WITH raw AS (SELECT o_orderkey AS id, chr(9) || lower(o_orderpriority) || ' ' || chr(10) AS raw FROM orders), "
    "a(v) AS (VALUES " + ", ".join(f"('{p}')" for p in PRIORITIES) + ") "
    f"SELECT id, coalesce(v, {strip_sql('raw')}) AS value, v IS NULL AS violated FROM raw LEFT JOIN a ON lower({strip_sql('raw')}) = lower(v)"
)
def enum_normalize(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("\t"), F.lower("o_orderpriority"), F.lit(" \n")).alias("raw"))
    return o.select("id", values.as_enum(F.col("raw"), PRIORITIES).alias("r")).select("id", "r.value", F.col("r.problem").isNotNull().alias("violated"))


BOOL_RAW = "CASE event_id % 6 WHEN 0 THEN concat(chr(9), 'Ja', chr(10)) WHEN 1 THEN ' nein ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'falsch' ELSE event_type END"


@query(
    f"WITH raw AS (SELECT event_id, {BOOL_RAW} AS raw FROM events), t AS (SELECT *, CASE WHEN lower({strip_sql('raw')}) IN ('true','ja','yes','wahr','1') THEN 'true' "
    f"WHEN lower({strip_sql('raw')}) IN ('false','nein','no','falsch','0') THEN 'false' END AS b FROM raw) "
    "SELECT event_id, coalesce(b, raw) AS value, CASE WHEN b IS NULL THEN 'no truth value' END AS problem FROM t"
)
def bool_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(BOOL_RAW).alias("raw"))
    return e.select("event_id", values.as_bool(F.col("raw")).alias("r")).select("event_id", "r.value", "r.problem")


@query(
    r"""WITH raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate)
      WHEN 1 THEN chr(9) || strftime(o_orderdate, '%Y-%m-%d') || chr(10) ELSE strftime(o_orderdate, '%Y/%m/%d') END AS raw FROM orders),
    n AS (SELECT id, trim(raw, chr(9) || chr(10) || ' ') AS raw FROM raw),
    m AS (SELECT id, raw, regexp_extract(raw, '^(\d{1,2})\.(\d{1,2})\.(\d{4})$', ['d', 'm', 'y']) AS g FROM n)
    SELECT id, CASE WHEN g.y <> '' THEN g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') ELSE raw END AS value,
      CASE WHEN g.y = '' AND NOT regexp_full_match(raw, '\d{4}-\d{2}-\d{2}') THEN 'no date in a known form' END AS problem FROM m"""
)
def date_normalize(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat_ws(".", F.day(d).cast("string"), F.month(d).cast("string"), F.year(d).cast("string"))).when(k == 1, F.concat(F.lit("\t"), F.date_format(d, "yyyy-MM-dd"), F.lit("\n"))).otherwise(F.date_format(d, "yyyy/MM/dd"))
    return o.select(F.col("o_orderkey").alias("id"), values.as_date(raw).alias("r")).select("id", "r.value", "r.problem")


@query(r"SELECT c_custkey, trim(c_name) AS value, NOT regexp_full_match(trim(c_name), 'Customer#0*[1-9]\d{0,2}') AS violated FROM customer")
def pattern_violations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", values.as_text(F.col("c_name"), r"Customer#0*[1-9]\d{0,2}").alias("r")).select("c_custkey", "r.value", F.col("r.problem").isNotNull().alias("violated"))


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_replace({strip_sql('w')}, '[ %]', '', 'g') AS w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)),
    n AS (SELECT doc_id, {strip_sql("CASE WHEN contains(w, ',') AND contains(w, '.') THEN replace(replace(w, '.', ''), ',', '.') ELSE replace(w, ',', '.') END")} AS w FROM t),
    v AS (SELECT doc_id, regexp_full_match(w, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') AND abs(TRY_CAST(w AS DOUBLE)) < 9.2e18 AS good FROM n)
    SELECT doc_id, count_if(good)::BIGINT AS n_values_ok, count_if(good IS DISTINCT FROM true)::BIGINT AS n_problems FROM v GROUP BY doc_id"""
)
def list_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    r = d.select("doc_id", values.read_list(F.split("text", " "), "int").alias("r"))
    return r.select("doc_id", (F.size("r.values") - F.size("r.problems")).cast("bigint").alias("n_values_ok"), F.size("r.problems").cast("bigint").alias("n_problems"))


def negation_sql(x: str) -> str:
    padded = f"' ' || {key_sql(x)} || ' '"
    several = [t.lower() for t in polarity.TRIGGERS if " " in t]
    single = [t.lower() for t in polarity.TRIGGERS if " " not in t]
    return "(" + " OR ".join([*(f"contains({padded}, '{t}')" for t in several), rf"regexp_matches({padded}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])({'|'.join(single)})($|[^\p{{L}}\p{{M}}\p{{N}}_])')"]) + ")"


@query(f"SELECT doc_id, {negation_sql('text')} AS negated FROM documents")
def negation_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", polarity.has_negation(F.col("text")).alias("negated"))


RAW_POLARITY = "CASE doc_id % 7 WHEN 0 THEN 'Negativ' WHEN 1 THEN 'keine' WHEN 2 THEN ' positive ' WHEN 3 THEN 'Ja' WHEN 4 THEN 'maybe' WHEN 5 THEN '' END"


@query(
    f"""WITH r AS (SELECT doc_id, {RAW_POLARITY} AS raw, {negation_sql('text')} AS doubt FROM documents), s AS (SELECT *, lower(trim(raw)) AS p, coalesce(raw, '') <> '' AS stated FROM r)
    SELECT doc_id, CASE WHEN stated AND (p IN ('negative','negativ','verneint','nein','no','false') OR starts_with(p, 'neg') OR starts_with(p, 'kein') OR starts_with(p, 'verne')) THEN 'negative'
      WHEN stated AND (p IN ('positive','positiv','ja','yes','true') OR starts_with(p, 'pos')) THEN 'positive' WHEN stated THEN 'unknown' WHEN doubt THEN 'unknown' ELSE 'positive' END AS polarity FROM s"""
)
def polarity_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", polarity.polarity(F.expr(RAW_POLARITY), F.col("text"))["polarity"].alias("polarity"))


IDENTIFIERS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "hex": r"[0-9a-f]{32,}"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in IDENTIFIERS.items()))
def identifier_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)).alias("vs")) for k, p in IDENTIFIERS.items()])
    return d.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.kind", F.explode("f.vs").alias("value"))


@query("SELECT key, CASE WHEN value <> '' THEN '***' ELSE value END AS shown FROM (VALUES ('api_key', 'abc'), ('url', ''), ('token', 'x')) t(key, value)")
def redact_settings(spark, sf_dir):
    from docweave.plans.settings import redact

    return redact(spark.createDataFrame([("api_key", "abc"), ("url", ""), ("token", "x")], "key string, value string"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """An extension: tumbling windows of event time, as in the stream."""
    from docweave.streaming.ingest import event_counts

    return event_counts(table(spark, sf_dir, "events"))


FORMAT_SQL = """CASE page_id % 6 WHEN 0 THEN 'text/html' WHEN 1 THEN '.PDF' WHEN 2 THEN 'md' ELSE '' END"""


@query(
    f"""WITH p AS (SELECT page_id, {FORMAT_SQL} AS stated, CASE WHEN page_id % 2 = 0 THEN 'a/b.htm' ELSE url END AS name FROM pages)
    SELECT page_id, CASE WHEN stated = 'text/html' THEN 'html' WHEN stated = '.PDF' THEN 'pdf' WHEN stated = 'md' THEN 'md'
      ELSE CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'htm' THEN 'html' WHEN 'html' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'md' THEN 'md' END END AS format FROM p"""
)
def document_formats(spark, sf_dir):
    from docweave.sources.documents import document_format

    p = table(spark, sf_dir, "pages").select("page_id", F.expr(FORMAT_SQL).alias("stated"), F.when(F.col("page_id") % 2 == 0, "a/b.htm").otherwise(F.col("url")).alias("name"))
    return p.select("page_id", document_format(F.col("stated"), F.col("name")).alias("format"))


@query()
def html_items(spark, sf_dir):
    """Items of pages by the HTML parser, cleaned and chunked by the whole plan."""
    from docweave.plans.process import process
    from docweave.sources.documents import items

    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.lit("html").alias("format"), F.col("html").cast("binary").alias("content"))
    out = process(items(p))
    return out["chunks"].select("doc_id", "chunk_id", "kind", F.array_join("headings", " > ").alias("headings"), F.length("body").alias("chars"), "token_count")
