"""Queries over the text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import blocks as B
from quireflow.operators import render as R
from quireflow.operators import rich
from quireflow.plans import duck

AT = "2024-01-01T00:00:00Z"
#: What is put before the lines of documents in turn, as those have no marks of their own; None: the line is replaced.
MARKS = ["# ", "- ", "   1. ", "      ", "", "====", "• ", "\t\tb) ", "", "---", "---", "12) ", " ", "", "####  ", "   "]
_WHOLE = {5, 9, 10, 13}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with marks before their lines."""

    def line(t: Column, i: Column) -> Column:
        turn, out = (i + F.col("doc_id")) % len(MARKS), t
        for k, mark in enumerate(MARKS):
            out = F.when(turn == k, F.lit(mark) if k in _WHOLE else F.concat(F.lit(mark), t)).otherwise(out)
        return out

    return documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


_SQL_MARK = " ".join(f"WHEN {k} THEN " + (f"'{m}'" if k in _WHOLE else f"'{m}' || t") for k, m in enumerate(MARKS))
MARKED = f"""marked AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda t, i: CASE (i - 1 + doc_id) % {len(MARKS)} {_SQL_MARK} END), chr(10)) AS text FROM documents)"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.lines(documents(spark, sf_dir)).select("doc_id", "pos", "t")


def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.labelled(B.lines(documents(spark, sf_dir))).select("doc_id", "pos", "label", "island")


def line_labels_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.labelled(B.lines(marked(spark, sf_dir))).select("doc_id", "pos", "label", "island")


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.blocks(documents(spark, sf_dir))


def text_blocks_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.blocks(marked(spark, sf_dir))


def block_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language and type: blocks, characters and the documents that have one."""
    found = B.blocks(marked(spark, sf_dir)).groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return found.join(langs, "doc_id").groupBy("lang", "type").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_blocks"), F.sum("c").alias("n_chars"))


def heading_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.lines(documents(spark, sf_dir)).select("doc_id", "pos", T.looks_like_heading("t").alias("is_heading"))


def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style, index and depth of the lines with a list marker."""
    found = B.labelled(B.lines(marked(spark, sf_dir))).where("label = 'list'")
    return found.select("doc_id", "pos", "marker", B.list_style(F.col("marker")).alias("style"), B.list_index(F.col("marker")).alias("idx"), F.floor(F.col("indent") / 2).cast("int").alias("depth"))


def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a document as one paragraph; every third line gets a hyphen at its end."""
    pieces = F.filter(F.transform(F.split("text", "\n", -1), lambda t, i: T.collapse(F.when((i % 3 == 0) & (t != ""), F.concat(t, F.lit("-"))).otherwise(t))), lambda t: t != "")
    return documents(spark, sf_dir).select("doc_id", T.join_lines(pieces).alias("merged"))


def wrap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at indents of 0 to 12, and benchmark items."""
    own = documents(spark, sf_dir).select("doc_id", F.lit("d").alias("kind"), (F.col("doc_id") % 13).cast("int").alias("indent"), "text")
    both = own.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("b").alias("kind"), F.lit(0).alias("indent"), "text"))
    return both.withColumn("flat", T.collapse("text")).select("kind", "doc_id", T.wrap("flat", F.col("indent")).alias("wrapped"))


def code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as code, with as many backticks in them as their id modulo 7."""
    code = F.concat("text", F.repeat(F.lit("`"), (F.col("doc_id") % 7).cast("int")), F.lit("\n"))
    return documents(spark, sf_dir).select("doc_id", R.code_lines(code).alias("fenced"))


def text_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.translate(F.element_at(F.split("text", "\n", -1), 1), " .,", "_-_"), F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, "_PDF2-NASA.tar").otherwise(""))
    return documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.title(name).alias("title"))


def _titled(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("document-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.lit("TXT").alias("extension"))


def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return R.markdown(_titled(docs), B.blocks(docs))


def render_markdown_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = marked(spark, sf_dir)
    return R.markdown(_titled(docs), B.blocks(docs))


def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = marked(spark, sf_dir)
    return R.blocks_json(_titled(docs), B.blocks(docs), AT)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as paragraphs with sizes and lists."""
    c, n = F.col, F.col("l_linenumber")
    text = (
        F.when(n == 1, F.concat(F.lit("## Order "), c("l_orderkey").cast("string"))).when(n == 2, F.concat(F.lit("  "), c("l_quantity").cast("int").cast("string"), F.lit(". shipped\nby "), c("l_returnflag")))
        .when(n == 3, "Some Words In Bold").when(n == 4, " ").when(n == 5, F.concat(F.lit("▪ part "), c("l_partkey").cast("string"))).otherwise(F.concat(F.lit("Flag "), c("l_returnflag"), F.lit(" of the line"), F.lit("\nends ")))
    )
    paths = F.when(c("l_tax") >= 0.07, F.array(F.lit("{disc}"), F.lit("{lower-alpha}"))).when(c("l_tax") >= 0.06, F.array(F.lit("{disc}"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("doc_id"), (n * 100_000_000 + c("l_partkey") * 1000 + c("l_suppkey")).alias("para"), text.alias("text"),
        F.when(c("l_quantity") > 5, c("l_quantity")).alias("max_size"), (c("l_linestatus") == "O").alias("bold"), paths.alias("list_path"),
    )


_SIZED = """sized AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT * 100000000 + l_partkey * 1000 + l_suppkey AS para,
  CASE l_linenumber WHEN 1 THEN '## Order ' || l_orderkey WHEN 2 THEN '  ' || l_quantity::INT || '. shipped' || chr(10) || 'by ' || l_returnflag WHEN 3 THEN 'Some Words In Bold' WHEN 4 THEN ' '
    WHEN 5 THEN '▪ part ' || l_partkey ELSE 'Flag ' || l_returnflag || ' of the line' || chr(10) || 'ends ' END AS text,
  CASE WHEN l_quantity > 5 THEN l_quantity END AS max_size, l_linestatus = 'O' AS bold,
  CASE WHEN l_tax >= 0.07 THEN ['{disc}', '{lower-alpha}'] WHEN l_tax >= 0.06 THEN ['{disc}'] ELSE []::VARCHAR[] END AS list_path FROM lineitem),
medians AS (SELECT doc_id, list_sort(list(coalesce(max_size, 12.0)))[count(*) // 2 + 1] AS body_size FROM sized GROUP BY doc_id)"""


def body_font_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich.body_size(_sized(spark, sf_dir))


def rich_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct blocks by content: order lines with one number tie, so their order is left out."""
    made = rich.rich_blocks(_sized(spark, sf_dir))
    return made.groupBy("doc_id", "type", "text", "heading_level", "list_style", "list_depth", "list_index").agg(F.count("*").alias("n"))


def _rich_sql() -> str:
    marker = f"regexp_extract(t, '{duck.RICH_LIST}', 1)"
    return f"""WITH {_SIZED},
a AS (SELECT s.*, body_size, {duck.trim("text")} AS t, coalesce(max_size, 12.0) / greatest(body_size, 1.0) AS ratio FROM sized s JOIN medians USING (doc_id)),
b AS (SELECT *, CASE WHEN ratio >= 1.8 THEN 1 WHEN ratio >= 1.5 THEN 2 WHEN ratio >= 1.3 THEN 3 WHEN bold AND {duck.looks_like_heading("t")} THEN 4 END AS by_size, regexp_matches(t, '{duck.RICH_LIST}') AS listed FROM a WHERE t <> ''),
c AS (SELECT *, CASE WHEN regexp_matches(t, '{duck.ATX}') THEN 'atx' WHEN len(list_path) > 0 THEN 'styled' WHEN listed THEN 'marked' WHEN by_size IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS kind FROM b),
d AS (SELECT doc_id, CASE WHEN kind IN ('styled', 'marked') THEN 'listItem' WHEN kind = 'paragraph' THEN 'paragraph' ELSE 'heading' END AS type,
  {duck.collapse(f"CASE WHEN kind = 'atx' THEN regexp_extract(t, '{duck.ATX}', 2) WHEN kind IN ('styled', 'marked') AND listed THEN regexp_extract(t, '{duck.RICH_LIST}', 2) ELSE t END")} AS text,
  (CASE kind WHEN 'atx' THEN length(regexp_extract(t, '{duck.ATX}', 1)) WHEN 'heading' THEN by_size END)::INTEGER AS heading_level,
  CASE kind WHEN 'styled' THEN CASE WHEN regexp_matches(list_path[-1], 'decimal|upper|lower') THEN 'ordered' ELSE 'unordered' END WHEN 'marked' THEN {duck.style(marker)} END AS list_style,
  (CASE kind WHEN 'styled' THEN len(list_path) - 1 WHEN 'marked' THEN 0 END)::INTEGER AS list_depth, CASE kind WHEN 'marked' THEN {duck.index(marker)} END AS list_index FROM c)
SELECT *, count(*) AS n FROM d GROUP BY ALL"""


def _labels_sql(source: str) -> str:
    return f"{duck.labels(source, 'doc_id')} SELECT doc_id, pos, label, island FROM p_labels"


def _markdown_sql(first: str, source: str) -> str:
    done = r"regexp_replace(CASE WHEN headed THEN body ELSE '# Document ' || d.doc_id || coalesce(chr(10) || chr(10) || body, '') END, '\s+$', '') || chr(10)"
    return f"WITH {first}{duck.blocks(source, 'doc_id')}, {duck.body('p_blocks', 'doc_id', None)} SELECT d.doc_id, {done} AS markdown FROM documents d LEFT JOIN p_body USING (doc_id)"


_JSON_BLOCK = """'{' || concat_ws(',', '"headingLevel":' || heading_level, '"listDepth":' || list_depth, '"listIndex":' || list_index, '"listStyle":"' || list_style || '"', '"order":' || "order", '"text":' || to_json(text)::VARCHAR, '"type":"' || type || '"') || '}'"""
_FLAT = duck.collapse("text")

QUERIES = {f.__name__: f for f in (text_lines, line_labels, line_labels_marked, text_blocks, text_blocks_marked, block_type_counts, heading_heuristic, list_markers, paragraph_merge, wrap_text, code_fences, text_titles, render_markdown, render_markdown_marked, render_json, body_font_median, rich_blocks)}
ORACLES = {
    "text_lines": f"WITH {duck.lines('documents', 'doc_id')} SELECT doc_id, pos, t FROM p_lines",
    "line_labels": f"WITH {_labels_sql('documents')}",
    "line_labels_marked": f"WITH {MARKED}, {_labels_sql('marked')}",
    "text_blocks": f"WITH {duck.blocks('documents', 'doc_id')} SELECT * FROM p_blocks",
    "text_blocks_marked": f"WITH {MARKED}, {duck.blocks('marked', 'doc_id')} SELECT * FROM p_blocks",
    "block_type_counts": f"WITH {MARKED}, {duck.blocks('marked', 'doc_id')} SELECT lang, type, count(DISTINCT doc_id) AS n_docs, count(*) AS n_blocks, sum(length(p_blocks.text))::BIGINT AS n_chars FROM p_blocks JOIN documents USING (doc_id) GROUP BY lang, type",
    "heading_heuristic": f"WITH {duck.lines('documents', 'doc_id')} SELECT doc_id, pos, {duck.looks_like_heading('t')} AS is_heading FROM p_lines",
    "list_markers": f"WITH {MARKED}, {duck.labels('marked', 'doc_id')} SELECT doc_id, pos, marker, {duck.style('marker')} AS style, {duck.index('marker')} AS idx, (indent // 2)::INTEGER AS depth FROM p_labels WHERE label = 'list'",
    "paragraph_merge": f"""WITH a AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
b AS (SELECT doc_id, i, {duck.collapse("CASE WHEN i % 3 = 0 AND t <> '' THEN t || '-' ELSE t END")} AS t FROM a)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce({duck.joined("m")}, '') END AS merged FROM documents d LEFT JOIN (SELECT doc_id, string_agg(t, chr(1) ORDER BY i) AS m FROM b WHERE t <> '' GROUP BY doc_id) USING (doc_id)""",
    "wrap_text": f"SELECT 'd' AS kind, doc_id, {duck.wrap(_FLAT, 'doc_id % 13')} AS wrapped FROM documents UNION ALL SELECT 'b', item_id, {duck.wrap(_FLAT)} FROM benchmark",
    "code_fences": """SELECT doc_id, f || chr(10) || text || b || chr(10) || f AS fenced FROM (SELECT doc_id, text, repeat('`', (doc_id % 7)::INTEGER) AS b,
  repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text || repeat('`', (doc_id % 7)::INTEGER), '`+'), lambda x: length(x))), 0))::INTEGER) AS f FROM documents)""",
    "text_titles": f"SELECT doc_id, {duck.title('name')} AS title FROM (SELECT doc_id, translate(string_split(text, chr(10))[1], ' .,', '_-_') || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '_PDF2-NASA.tar' ELSE '' END AS name FROM documents WHERE text IS NOT NULL)",
    "render_markdown": _markdown_sql("", "documents"),
    "render_markdown_marked": _markdown_sql(f"{MARKED}, ", "marked"),
    "render_json": f"""WITH {MARKED}, {duck.blocks('marked', 'doc_id')}, j AS (SELECT doc_id, count(*) AS n, '"blocks":[' || string_agg({_JSON_BLOCK}, ',' ORDER BY "order") || ']' AS b FROM p_blocks GROUP BY doc_id)
SELECT doc_id, '{{"content":{{' || coalesce(b, '') || '}},"source":{{"convertedAt":"{AT}","fileExtension":"txt","fileName":"document-' || doc_id || '.txt"}},"summary":{{"blockCount":' || coalesce(n, 0) || '}},"version":"1.1"}}' AS json FROM documents LEFT JOIN j USING (doc_id)""",
    "body_font_median": f"WITH {_SIZED} SELECT * FROM medians",
    "rich_blocks": _rich_sql(),
}
