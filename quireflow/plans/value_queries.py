"""Queries over values, tables and delimited text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import delimited as D
from quireflow.operators import render as R
from quireflow.operators import values as V
from quireflow.plans import duck
from quireflow.plans.text_queries import AT, table


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.spread(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "props"), "doc_id")
    parsed = events.select("doc_id", V.json_value("props").alias("v"))
    return parsed.select("doc_id", "v.value", "v.error")


def json_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of event properties; every seventh is cut short, so that it can't be read."""
    events = V.spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    text = F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit(" x"))).otherwise(F.col("props"))
    return events.select("event_id", V.json_value(text).alias("v")).select("event_id", "v.value", "v.error")


def value_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.value_blocks(_props(spark, sf_dir)).select("doc_id", "order", F.col("list_depth").alias("depth"), "text")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nested JSON, with spare white space and digits."""
    c = F.col
    text = F.concat(F.lit('{"name": "  '), c("c_name"), F.lit('  x",\n "nation": {"key": '), c("c_nationkey").cast("string"), F.lit('.50, "tags": ["a  b", [1, 2], {"x": null, "y": true}, []]}, "Zed": [], "id": '), c("c_custkey").cast("string"), F.lit(', "kids": [[["deep"]], "'), c("c_mktsegment"), F.lit('"]}'))
    customers = V.spread(table(spark, sf_dir, "customer").select(c("c_custkey").alias("doc_id"), "c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "doc_id")
    return customers.select("doc_id", V.json_value(text)["value"].alias("value"))


_NESTED = """nested AS (SELECT c_custkey AS doc_id, '{"name": "  ' || c_name || '  x", "nation": {"key": ' || c_nationkey || '.5, "tags": ["a  b", [1, 2], {"x": null, "y": true}, []]}, "Zed": [], "id": ' || c_custkey || ', "kids": [[["deep"]], "' || c_mktsegment || '"]}' AS value FROM customer)"""


def value_items_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.value_blocks(_nested(spark, sf_dir)).select("doc_id", "order", F.col("list_depth").alias("depth"), "text")


def value_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _nested(spark, sf_dir)
    return R.markdown(values.select("doc_id", F.lit("Value").alias("title")), V.value_blocks(values))


def value_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).select("doc_id", R.json_document(F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit(".json")), F.lit("JSON"), F.lit(AT), data=F.col("value")).alias("json"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each nation, of its customers in order, with marks in cells and short and long rows."""
    c, k = F.col, F.col("c_custkey")
    row = F.when(k % 5 == 0, F.array(k.cast("string"), "c_name")).when(k % 5 == 1, F.array(k.cast("string"), c("c_name"), c("c_mktsegment"), F.lit("left out"))).otherwise(F.array(k.cast("string"), F.concat("c_name", F.lit("|a\\b\nc")), c("c_mktsegment")))
    grouped = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("r")))).alias("rs"))
    return grouped.select("doc_id", F.array(F.lit("Key"), F.lit("Na|me"), F.lit("Market segment")).alias("columns"), F.transform("rs", lambda x: x["r"]).alias("rows"))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("Nation "), F.col("doc_id").cast("string"))
    return _rows(spark, sf_dir).select("doc_id", R.table_document(title, F.col("columns"), F.col("rows"), F.when(F.col("doc_id") % 2 == 0, "Customers")).alias("markdown"))


def table_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = F.array(F.struct("columns", "rows"))
    return _rows(spark, sf_dir).select("doc_id", R.json_document(F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".csv")), F.lit("csv"), F.lit(AT), tables=tables, data=F.lit("[]")).alias("json"))


def _delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation as delimited text: with a header, or numbers only; with a tab, quotes, both line ends, blank
    lines, a byte order mark, a short row and a name twice."""
    c = F.col
    n = c("c_nationkey")
    kind, mark = n % 3, F.when(n % 2 == 0, "\t").otherwise(",")
    name = F.concat(F.lit('"'), c("c_name"), mark, F.lit('\n""x"" "y'))
    numbers = F.concat(c("c_custkey").cast("string"), mark, F.lit(" "), n.cast("string"), F.lit(" "))
    line = F.when(kind == 0, numbers).when(c("c_custkey") % 4 == 0, c("c_custkey").cast("string")).otherwise(F.concat(c("c_custkey").cast("string"), mark, name, mark, c("c_mktsegment"), mark, F.lit("more"), mark, F.lit("left out")))
    end = F.when(n % 4 == 1, "\r\n").otherwise("\n")
    head = F.when(kind == 0, "").otherwise(F.concat(F.lit("﻿id"), mark, F.lit("name"), mark, F.lit("segment"), mark, F.lit("segment"), end, mark, F.lit("  "), mark, end))
    grouped = table(spark, sf_dir, "customer").select(n.alias("doc_id"), mark.alias("mark"), head.alias("head"), end.alias("end"), F.struct(c("c_custkey").alias("k"), F.concat(line, end).alias("l")).alias("r")).groupBy("doc_id", "mark", "head", "end").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    text = F.concat("head", F.array_join(F.transform("rs", lambda x: x["l"]), ""))
    return grouped.select("doc_id", "mark", text.alias("text")).select("doc_id", D.rows("text", F.col("mark")).alias("cells"))


_DELIMITED = """customers AS (SELECT c_nationkey AS doc_id, c_custkey AS k, c_nationkey % 3 = 0 AS plain, c_name || CASE WHEN c_nationkey % 2 = 0 THEN chr(9) ELSE ',' END || chr(10) || '"x" y' AS name, c_mktsegment AS seg FROM customer),
parsed AS (SELECT doc_id, k, CASE WHEN plain THEN [k::VARCHAR, doc_id::VARCHAR] WHEN k % 4 = 0 THEN [k::VARCHAR] ELSE [k::VARCHAR, name, seg, 'more', 'left out'] END AS r FROM customers
  UNION ALL SELECT DISTINCT doc_id, -1, ['id', 'name', 'segment', 'segment'] FROM customers WHERE NOT plain)"""


def delimited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _delimited(spark, sf_dir).select("doc_id", F.posexplode("cells").alias("row", "r"))
    return rows.select("doc_id", "row", F.posexplode("r").alias("col", "cell"))


def delimited_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there is a header, the names of columns, and how many rows have data."""
    c = F.col("cells")
    return _delimited(spark, sf_dir).select("doc_id", D.has_header(c).alias("headed"), F.array_join(D.column_names(c), "/").alias("names"), F.size(D.data_rows(c)).alias("n_rows"))


def delimited_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delimited(spark, sf_dir).select("doc_id", D.objects(F.col("cells")).alias("data"))


def delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as delimited text and read again."""
    made = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.replace("p_name", F.lit('"'), F.lit('""')), F.lit('"')), "p_brand", "p_type", F.col("p_size").cast("string"))
    parts = V.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    cells = parts.select(D.rows(made).alias("c")).select(F.get("c", F.lit(0)).alias("r"))
    return cells.select(F.get("r", F.lit(0)).cast("bigint").alias("p_partkey"), F.get("r", F.lit(1)).alias("p_name"), F.get("r", F.lit(2)).alias("p_brand"), F.get("r", F.lit(3)).alias("p_type"), F.get("r", F.lit(4)).cast("int").alias("p_size"))


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation as settings, a section for each market segment, which comes up again and again."""
    c = F.col
    line = F.concat(F.lit("\n["), c("c_mktsegment"), F.lit("]\n; a comment\nlast: "), c("c_custkey").cast("string"), F.lit("\n "), c("c_name"), F.lit(" = '"), c("c_mktsegment"), F.lit(" = 1' \nno value\n= none\n[ ]\n"))
    grouped = table(spark, sf_dir, "customer").groupBy(c("c_nationkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))).alias("ls"))
    return grouped.select("doc_id", F.concat(F.lit("nation="), c("doc_id").cast("string"), F.lit("\nBUILDING=gone\n# end\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\r\n")).alias("text"))


_SETTINGS = """entries AS (
  SELECT c_nationkey AS doc_id, c_mktsegment AS section, 'last' AS key, max(c_custkey)::VARCHAR AS value FROM customer GROUP BY ALL
  UNION ALL SELECT c_nationkey, c_mktsegment, c_name, c_mktsegment || ' = 1' FROM customer
  UNION ALL SELECT DISTINCT c_nationkey, NULL, 'nation', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT DISTINCT c_nationkey, NULL, 'BUILDING', 'gone' FROM customer)"""
_SETTINGS_JSON = f"""WITH {_SETTINGS},
inner_ AS (SELECT doc_id, section AS key, '{{' || string_agg(to_json(key)::VARCHAR || ':' || to_json(value)::VARCHAR, ',' ORDER BY key) || '}}' AS v, 1 AS rank FROM entries WHERE section IS NOT NULL GROUP BY ALL
  UNION ALL SELECT doc_id, key, to_json(value)::VARCHAR, 0 FROM entries WHERE section IS NULL),
top AS (SELECT doc_id, key, arg_max(v, rank) AS v FROM inner_ GROUP BY ALL)
SELECT doc_id, '{{' || string_agg(to_json(key)::VARCHAR || ':' || v, ',' ORDER BY key) || '}}' AS value FROM top GROUP BY doc_id"""


def ini_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ini_entries(_settings(spark, sf_dir))


def ini_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ini_json(_settings(spark, sf_dir))


def ini_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the parser that reads a document at a time."""
    return _settings(spark, sf_dir).select("doc_id", V.ini_value("text")["value"].alias("value"))


def xml_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as XML with attributes, equal children, mixed text, CDATA and an empty leaf; every ninth is cut short."""
    c = F.col
    text = F.concat(F.lit('<?xml version="1.0"?><s:supplier id="'), c("s_suppkey").cast("string"), F.lit('"> of <name> '), c("s_name"), F.lit(" </name><tag>a</tag><tag k='&lt;'/><![CDATA[<x>]]><tag>b &amp; c</tag><none/>"), F.when(c("s_suppkey") % 9 == 0, "").otherwise("</s:supplier>"))
    suppliers = V.spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return suppliers.select("s_suppkey", V.xml_value(text).alias("v")).select("s_suppkey", "v.value", "v.error")


def plist_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as property lists with every sort of value."""
    c = F.col
    text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><plist version="1.0"><dict><key>name</key><string>'), c("s_name"), F.lit("</string><key>id</key><integer>"), c("s_suppkey").cast("string"), F.lit("</integer><key>half</key><real>0.50</real><key>on</key><true/><key>at</key><date>2024-02-03T04:05:06Z</date><key>data</key><data>aGk=</data><key>all</key><array><false/><integer>-7</integer></array></dict>"), F.when(c("s_suppkey") % 9 == 0, "").otherwise("</plist>"))
    suppliers = V.spread(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return suppliers.select("s_suppkey", V.plist_value(text).alias("v")).select("s_suppkey", "v.value", "v.error")


_BODY = "WITH RECURSIVE"
_CELL = "replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(10), '<br>')"
_TABLE = f"""WITH r AS (SELECT c_nationkey AS doc_id, c_custkey AS k, c_custkey::VARCHAR AS a, {_CELL.format("CASE WHEN c_custkey % 5 IN (0, 1) THEN c_name ELSE c_name || '|a' || chr(92) || 'b' || chr(10) || 'c' END")} AS b, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS c FROM customer),
w AS (SELECT doc_id, greatest(3, max(length(a))) AS wa, greatest(6, max(length(b))) AS wb, greatest(14, max(length(c))) AS wc FROM r GROUP BY doc_id),
l AS (SELECT doc_id, string_agg('| ' || rpad(a, wa::INT, ' ') || ' | ' || rpad(b, wb::INT, ' ') || ' | ' || rpad(c, wc::INT, ' ') || ' |', chr(10) ORDER BY k) AS ls FROM r JOIN w USING (doc_id) GROUP BY doc_id)
SELECT doc_id, '# Nation ' || doc_id || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '## Customers' || chr(10) || chr(10) ELSE '' END || '| ' || rpad('Key', wa::INT, ' ') || ' | ' || rpad('Na' || chr(92) || '|me', wb::INT, ' ') || ' | ' || rpad('Market segment', wc::INT, ' ') || ' |' || chr(10)
  || '| ' || repeat('-', wa::INT) || ' | ' || repeat('-', wb::INT) || ' | ' || repeat('-', wc::INT) || ' |' || chr(10) || ls || chr(10) AS markdown FROM w JOIN l USING (doc_id)"""
_TABLE_JSON = f"""WITH r AS (SELECT c_nationkey AS doc_id, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN [c_custkey::VARCHAR, c_name] WHEN c_custkey % 5 = 1 THEN [c_custkey::VARCHAR, c_name, c_mktsegment, 'left out'] ELSE [c_custkey::VARCHAR, c_name || '|a' || chr(92) || 'b' || chr(10) || 'c', c_mktsegment] END AS r FROM customer)
SELECT doc_id, '{{"content":{{"data":[],"tables":[{{"columns":["Key","Na|me","Market segment"],"rows":[' || string_agg(to_json(r)::VARCHAR, ',' ORDER BY k) || ']}}]}},"source":{{"convertedAt":"{AT}","fileExtension":"csv","fileName":"n' || doc_id || '.csv"}},"summary":{{"blockCount":0,"dataPresent":true,"tableCount":1}},"version":"1.1"}}' AS json FROM r GROUP BY doc_id"""
_MARKDOWN = f"""{_BODY} {_NESTED}, {duck.items("nested")},
i AS (SELECT doc_id, "order", 'listItem' AS type, text, NULL::INTEGER AS heading_level, 'unordered' AS list_style, depth AS list_depth, NULL::BIGINT AS list_index FROM items), {duck.body("i", "doc_id", None)}
SELECT doc_id, '# Value' || chr(10) || chr(10) || body || chr(10) AS markdown FROM p_body"""

QUERIES = {f.__name__: f for f in (json_normalised, value_items, value_items_nested, value_markdown, value_json, table_markdown, table_json, delimited_cells, delimited_header, delimited_objects, delimited_roundtrip, ini_entries, ini_json, ini_parsed, xml_values, plist_values)}
ORACLES = {
    "json_normalised": f"SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN replace(props, ' ', '') END AS value, CASE WHEN event_id % 7 = 0 AND props IS NOT NULL THEN '{V.INVALID}' END AS error FROM events",
    "value_items": f'{_BODY} props AS (SELECT event_id AS doc_id, props AS value FROM events), {duck.items("props")} SELECT doc_id, "order", depth, text FROM items',
    "value_items_nested": f'{_BODY} {_NESTED}, {duck.items("nested")} SELECT doc_id, "order", depth, text FROM items',
    "value_markdown": _MARKDOWN,
    "value_json": f"""SELECT c_custkey AS doc_id, '{{"content":{{"data":{{"Zed":[],"id":' || c_custkey || ',"kids":[[["deep"]],"' || c_mktsegment || '"],"name":"  ' || c_name || '  x","nation":{{"key":' || c_nationkey || '.5,"tags":["a  b",[1,2],{{"x":null,"y":true}},[]]}}}}}},"source":{{"convertedAt":"{AT}","fileExtension":"json","fileName":"c' || c_custkey || '.json"}},"summary":{{"blockCount":0,"dataPresent":true}},"version":"1.1"}}' AS json FROM customer""",
    "table_markdown": _TABLE,
    "table_json": _TABLE_JSON,
    "delimited_cells": f"""WITH {_DELIMITED}, n AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS row, r FROM parsed)
SELECT doc_id, row, (generate_subscripts(r, 1) - 1)::INTEGER AS col, unnest(r) AS cell FROM n""",
    "delimited_header": "SELECT c_nationkey AS doc_id, c_nationkey % 3 <> 0 AS headed, CASE WHEN c_nationkey % 3 = 0 THEN 'Column 1/Column 2' ELSE 'id/name/segment/segment' END AS names, count(*)::INTEGER AS n_rows FROM customer GROUP BY c_nationkey",
    "delimited_objects": f"""WITH {_DELIMITED}
SELECT doc_id, '[' || string_agg(CASE WHEN doc_id % 3 = 0 THEN to_json(r)::VARCHAR ELSE '{{"id":' || to_json(r[1])::VARCHAR || ',"name":' || to_json(coalesce(r[2], ''))::VARCHAR || ',"segment":' || to_json(coalesce(r[4], ''))::VARCHAR || '}}' END, ',' ORDER BY k) || ']' AS data FROM parsed WHERE k >= 0 GROUP BY doc_id""",
    "delimited_roundtrip": "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part",
    "ini_entries": f"WITH {_SETTINGS} SELECT * FROM entries",
    "ini_json": _SETTINGS_JSON,
    "ini_parsed": _SETTINGS_JSON,
    "xml_values": f"""SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN '{{"s:supplier":{{"#text":"of <x>","@id":"' || s_suppkey || '","name":"' || s_name || '","none":"","tag":["a",{{"@k":"<"}},"b & c"]}}}}' END AS value, CASE WHEN s_suppkey % 9 = 0 THEN '{V.INVALID}' END AS error FROM supplier""",
    "plist_values": f"""SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN '{{"all":[false,-7],"at":"2024-02-03T04:05:06Z","data":"aGk=","half":0.5,"id":' || s_suppkey || ',"name":"' || s_name || '","on":true}}' END AS value, CASE WHEN s_suppkey % 9 = 0 THEN '{V.INVALID}' END AS error FROM supplier""",
}
