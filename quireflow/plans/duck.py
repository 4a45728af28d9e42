"""The document rules once more, as SQL that DuckDB runs: what the queries of the catalog are held against."""

from __future__ import annotations

SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BREAK = r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"
ATX = rf"^(#{{1,6}})[{SPACE}]+(.+)$"
LIST = rf"^([{SPACE}]*)([-*]|\p{{Nd}}+[.)]|[A-Za-z][.)])[{SPACE}]+(.+)$"
RICH_LIST = rf"^[{SPACE}]*([-*•◦▪‣]|\p{{Nd}}+[.)]|[A-Za-z][.)])[{SPACE}]+(.+)$"
UNDERLINE = r"^(={3,}|-{3,})$"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'), ' ')"


def line_feeds(c: str) -> str:
    return rf"regexp_replace({c}, '\r\n?', chr(10), 'g')"


def found(c: str, pattern: str) -> str:
    """How often a pattern is found."""
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def looks_like_heading(c: str) -> str:
    t = collapse(c)
    words = f"CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END"
    letters, capitals, titled = found(t, r"\p{L}"), found(t, r"\p{Lu}"), found(t, r"(?:^| )\p{Lu}")
    return f"(length({c}) <= 80 AND NOT ends_with({t}, '.') AND {words} BETWEEN 1 AND 10 AND {letters} >= 3 AND ({capitals} = {letters} OR {titled} >= greatest(1, {words} - 1)))"


def indent(c: str) -> str:
    return rf"(length({c}) + 3 * length(regexp_replace({c}, '[^\t]', '', 'g')))"


def joined(c: str) -> str:
    """Lines that chr(1) parts."""
    return rf"replace(regexp_replace({c}, '-\x01(\p{{L}})', '\1', 'g'), chr(1), ' ')"


def wrap(c: str, indented: str = "0") -> str:
    width = f"greatest(90 - ({indented}), 10)"
    return rf"regexp_replace(regexp_replace({c}, '([^ ]{{' || ({width} + 1) || ',}}|.{{1,' || {width} || '}})( |$)', '\1' || chr(10), 'g'), '\n$', '')"


def index(marker: str) -> str:
    return f"try_cast(regexp_extract({marker}, '^([0-9]+)', 1) AS BIGINT)"


def style(marker: str) -> str:
    return f"CASE WHEN regexp_matches({marker}, '[A-Za-z]') OR {index(marker)} IS NOT NULL THEN 'ordered' ELSE 'unordered' END"


def title(c: str) -> str:
    stem = rf"regexp_replace({c}, '^(.+)\.[^. ]+$', '\1')"
    words = f"list_filter(string_split(translate({stem}, '_-', '  '), ' '), lambda w: w <> '')"
    word = r"CASE WHEN regexp_full_match(w, '\p{Lu}{2,}') THEN w ELSE replace(upper(w[1]), 'ẞ', 'SS') || lower(w[2:]) END"
    return f"CASE WHEN len({words}) = 0 THEN {stem} ELSE array_to_string(list_transform({words}, lambda w: {word}), ' ') END"


def lines(source: str, keys: str, p: str = "p") -> str:
    clean = f"replace({line_feeds('text')}, '•', '- ')"
    return f"""{p}_raw AS (SELECT {keys}, unnest(ls) AS raw, (generate_subscripts(ls, 1) - 1)::INTEGER AS pos
  FROM (SELECT {keys}, string_split_regex({clean}, '{BREAK}') AS ls FROM {source} WHERE text IS NOT NULL)),
{p}_lines AS (SELECT *, {trim("raw")} AS t FROM {p}_raw)"""


def labels(source: str, keys: str, p: str = "p") -> str:
    """CTEs of which the last, {p}_labels, has a row for each line."""
    one, upto = f"(PARTITION BY {keys} ORDER BY pos)", f"(PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    deeper = "(label = 'other' AND indent > item_indent)"
    return f"""{lines(source, keys, p)},
{p}_1 AS (SELECT *, regexp_matches(t, '{UNDERLINE}') AS u, t = '' AS blank, regexp_matches(t, '{ATX}') AS atx, regexp_matches(raw, '{LIST}') AS listed, coalesce(lead(t) OVER w, '') AS next_t
  FROM {p}_lines WINDOW w AS {one}),
{p}_2 AS (SELECT *, pos - coalesce(max(CASE WHEN NOT u THEN pos END) OVER w, -1) AS nth, coalesce(last_value(CASE WHEN NOT u THEN NOT blank AND NOT atx END IGNORE NULLS) OVER w, false) AS before
  FROM {p}_1 WINDOW w AS {upto}),
{p}_3 AS (SELECT *, CASE WHEN u AND nth % 2 = (CASE WHEN before THEN 1 ELSE 0 END) THEN 'underline' WHEN blank THEN 'blank' WHEN atx THEN 'atx' WHEN regexp_matches(next_t, '{UNDERLINE}') THEN 'setext' WHEN listed THEN 'list' ELSE 'other' END AS label FROM {p}_2),
{p}_4 AS (SELECT *, CASE WHEN label = 'list' THEN {indent(f"regexp_extract(raw, '{LIST}', 1)")} ELSE {indent("regexp_extract(raw, '^([ " + chr(92) + "t]*)', 1)")} END AS indent, CASE WHEN label = 'list' THEN regexp_extract(raw, '{LIST}', 2) END AS marker FROM {p}_3),
{p}_5 AS (SELECT *, max(CASE WHEN label = 'list' THEN pos END) OVER w AS item, last_value(CASE WHEN label = 'list' THEN indent END IGNORE NULLS) OVER w AS item_indent FROM {p}_4 WINDOW w AS {upto}),
{p}_6 AS (SELECT *, max(CASE WHEN label <> 'list' AND NOT coalesce({deeper}, false) THEN pos END) OVER w AS broken FROM {p}_5 WINDOW w AS {upto}),
{p}_7 AS (SELECT * REPLACE (CASE WHEN label <> 'other' THEN label WHEN coalesce({deeper} AND coalesce(broken, -1) < item, false) THEN 'next' WHEN next_t = '' AND {looks_like_heading("t")} THEN 'heading' ELSE 'paragraph' END AS label) FROM {p}_6),
{p}_8 AS (SELECT *, label IN ('atx', 'setext', 'list', 'heading') OR (label = 'paragraph' AND coalesce(lag(label) OVER w, '') <> 'paragraph') AS starts FROM {p}_7 WINDOW w AS {one}),
{p}_labels AS (SELECT *, (sum(starts::INT) OVER w)::BIGINT AS island FROM {p}_8 WINDOW w AS {upto})"""


def blocks(source: str, keys: str, p: str = "p") -> str:
    """CTEs of which the last, {p}_blocks, has a row for each block."""
    head = lambda x: f"max(CASE WHEN starts THEN {x} END)"
    return f"""{labels(source, keys, p)},
{p}_9 AS (SELECT *, {collapse(f"CASE WHEN label = 'atx' THEN regexp_extract(t, '{ATX}', 2) WHEN label = 'list' THEN regexp_extract(raw, '{LIST}', 3) ELSE t END")} AS piece FROM {p}_labels WHERE label NOT IN ('blank', 'underline')),
{p}_10 AS (SELECT {keys}, island,
    {head("CASE label WHEN 'list' THEN 'listItem' WHEN 'paragraph' THEN 'paragraph' ELSE 'heading' END")} AS type,
    {joined("string_agg(CASE WHEN piece <> '' THEN piece END, chr(1) ORDER BY pos)")} AS text,
    {head(f"CASE label WHEN 'atx' THEN length(regexp_extract(t, '{ATX}', 1)) WHEN 'setext' THEN CASE WHEN starts_with(next_t, '=') THEN 1 ELSE 2 END WHEN 'heading' THEN 1 END")}::INTEGER AS heading_level,
    {head(f"CASE label WHEN 'list' THEN {style('marker')} END")} AS list_style,
    {head("CASE label WHEN 'list' THEN indent // 2 END")}::INTEGER AS list_depth,
    {head(f"CASE label WHEN 'list' THEN {index('marker')} END")} AS list_index
  FROM {p}_9 GROUP BY {keys}, island),
{p}_blocks AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY island))::INTEGER AS "order", type, text, heading_level, list_style, list_depth, list_index FROM {p}_10 WHERE text <> '')"""


def block_lines(base: str) -> str:
    prefix = "(repeat('  ', greatest(coalesce(list_depth, 0), 0)) || CASE WHEN list_style = 'ordered' THEN coalesce(list_index, 1) || '. ' ELSE '- ' END)"
    item = f"{prefix} || replace({wrap('text', f'length({prefix})')}, chr(10), chr(10) || repeat(' ', length({prefix})))"
    return f"""CASE type WHEN 'heading' THEN repeat('#', least(6, greatest(1, ({base}) + coalesce(heading_level, 1) - 1))::INTEGER) || ' ' || text WHEN 'listItem' THEN {item} ELSE {wrap("text")} END"""


def body(blocks_: str, keys: str, base: str | None, p: str = "p") -> str:
    """CTEs of which the last, {p}_body, has keys, body and headed."""
    level = "CASE WHEN headed THEN 1 ELSE 2 END" if base is None else base
    return f"""{p}_b1 AS (SELECT *, first_value(type) OVER w = 'heading' AS headed, CASE WHEN lag(type) OVER w IS NULL THEN '' WHEN lag(type) OVER w = 'listItem' AND type = 'listItem' THEN chr(10) ELSE chr(10) || chr(10) END AS between_
  FROM {blocks_} WHERE text <> '' WINDOW w AS (PARTITION BY {keys} ORDER BY "order")),
{p}_body AS (SELECT {keys}, string_agg(between_ || {block_lines(level)}, '' ORDER BY "order") AS body, bool_or(headed) AS headed FROM {p}_b1 GROUP BY {keys})"""


def items(source: str) -> str:
    """CTEs (WITH RECURSIVE) of which the last, items, has doc_id, order, depth and text of each line of JSON values (doc_id, value)."""
    return f"""tree AS (
  SELECT doc_id, value::JSON AS v, NULL::VARCHAR AS key, 0 AS depth, []::VARCHAR[] AS path FROM {source}
  UNION ALL
  SELECT t.doc_id, c.value, CASE WHEN json_type(t.v) = 'OBJECT' THEN c.key WHEN json_type(c.value) IN ('OBJECT', 'ARRAY') THEN 'Item ' || (c.key::INT + 1) END,
    t.depth + (t.key IS NOT NULL)::INT, list_append(t.path, CASE WHEN json_type(t.v) = 'OBJECT' THEN c.key ELSE lpad(c.key, 9, '0') END)
  FROM tree t, LATERAL json_each(t.v) AS c WHERE json_type(t.v) IN ('OBJECT', 'ARRAY')),
shown AS (SELECT doc_id, path, depth, {collapse("CASE WHEN json_type(v) IN ('OBJECT', 'ARRAY') THEN key || ':' ELSE coalesce(key || ': ', '') || CASE WHEN json_type(v) = 'VARCHAR' THEN v->>'$' ELSE v::VARCHAR END END")} AS text
  FROM tree WHERE key IS NOT NULL OR json_type(v) NOT IN ('OBJECT', 'ARRAY')),
items AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY path))::INTEGER AS "order", depth::INTEGER AS depth, text FROM shown)"""
