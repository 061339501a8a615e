"""Report-text queries, on texts built from every row of a table and on ``documents`` as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

import tabletools as tt
from catalog.tables import read
from tabletools.functions.partitions import on_all_cores

# One Markdown report per order. @text is the text type of the engine, @table the table.
REPORTS = """SELECT o_orderkey AS id, concat_ws(chr(10),
  concat('Prepared for customer ', CAST(o_custkey AS @text)),
  concat('# Order ', CAST(o_orderkey AS @text)),
  '', concat('  - Status ', o_orderstatus, '  '), concat('* Priority ', o_orderpriority),
  repeat(concat('placed on ', substr(CAST(o_orderdate AS @text), 1, 10), ' '), CAST(o_orderkey % 9 AS INT)),
  '### Detail', '**bold line**', '***', '```sql', 'select 1', '```',
  CASE o_orderkey % 4 WHEN 0 THEN '## Actionable Business Recommendations' WHEN 1 THEN '# recommendations'
    WHEN 2 THEN 'RECOMMENDATIONS' ELSE '## Outlook' END,
  concat('1. Call customer ', CAST(o_custkey AS @text)), concat('2) Check order ', CAST(o_orderkey AS @text)),
  concat('- Review ', o_orderpriority), '', concat('  Plain advice for ', o_orderstatus),
  '* Star', CASE WHEN o_orderkey % 3 = 0 THEN 'More words' ELSE '7' END, '-- dashes', '12345 items', '- nine', '- ten',
  '## Next steps', '-', 'Wait',
  CASE o_orderkey % 5
    WHEN 0 THEN 'no charts here'
    WHEN 1 THEN concat('charts: [{"chart_type": " Bar ", "x_axis": "o_orderpriority", "y_axis": "", "title": "Order ', CAST(o_orderkey AS @text), '"}, 5, "x", {"chart_type": "radar"}, {"chart_type": "PIE", "x_axis": null}]')
    WHEN 2 THEN concat('CHARTS: [{"chart_type": "line"}]', chr(10), '  Charts: [{"chart_type": "box", "x_axis": "a", "y_axis": "b"}]  ')
    WHEN 3 THEN CASE o_orderkey % 3 WHEN 0 THEN 'CHARTS: {"chart_type": "bar"}' WHEN 1 THEN 'CHARTS: [{"chart_type": "bar"}] done'
      ELSE 'CHARTS: [{"chart_type": "bar"}]]' END
    ELSE CASE o_orderkey % 3 WHEN 0 THEN 'CHARTS: [{"chart_type": "bar"}' WHEN 1 THEN 'CHARTS: [{"chart_type": "bar"}], [1]'
      ELSE 'CHARTS: [{"chart_type": "area", "x_axis": 0, "y_axis": false}, {"chart_type": "bar", "x_axis": "0", "y_axis": "false"}]' END END,
  '', '   ', '') AS text FROM @table"""

# One reply with slides per customer, some of them broken
SLIDES = """SELECT c_custkey AS id, concat('Here they are: [',
  '{"title": "', c_name, '", "bullets": ["- ', c_mktsegment, '", "", null, "> kept", "0", "false", 0, false, true, 7, "- b1", "b2", "* b3", "b4", "', CAST(c_nationkey AS @text), '. * rest"]}, ',
  CAST(c_nationkey AS @text), ', ',
  CASE c_custkey % 3 WHEN 0 THEN '{"title": " Recommendations ", "bullets": ["1) Call", " ", "*** Write ", "-"]}'
    WHEN 1 THEN concat('{"bullets": "first', chr(92), 'n', chr(92), 'n  second  "}')
    ELSE concat('{"title": "', c_name, '", "bullets": 5}') END,
  CASE WHEN c_custkey % 11 = 0 THEN ' oops' ELSE '' END, ']', CASE WHEN c_custkey % 13 = 0 THEN ' then [b]' ELSE '' END, chr(10), 'end') AS text FROM @table"""


def _duck(sql: str, table: str) -> str:
    return sql.replace("@text", "VARCHAR").replace("@table", table)


def _texts(s, d, sql, table):
    query = sql.replace("{", "{{").replace("}", "}}").replace("@text", "string").replace("@table", "{table}")
    return s.sql(query, table=on_all_cores(read(s, d, table)))


def _reports(s, d):
    return _texts(s, d, REPORTS, "orders")


def _replies(s, d):
    return _texts(s, d, SLIDES, "customer")


def _documents(s, d):
    return on_all_cores(read(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _joined(df, *columns):
    """Arrays of text shown as one text, with a mark between the entries."""
    return df.select(*[F.concat(F.array_join(c, "¦"), F.lit("¦"), F.size(c).cast("string")).alias(c)
                       if c in columns else F.col(c) for c in df.columns])


def _cleaned(s, d, mode):
    slides = tt.extract_slides(_replies(s, d))
    return _joined(slides.select("id", "pos", tt.clean_bullets(F.col("bullets"), mode).alias("bullets")), "bullets")


QUERIES = {
    "extract_tagged_json": lambda s, d: tt.extract_tagged_json(_reports(s, d)),
    "extract_tagged_json_columns": lambda s, d: tt.extract_tagged_json(
        _reports(s, d), columns=["o_orderpriority", "a"]),
    "strip_tagged_line": lambda s, d: tt.strip_tagged_line(_reports(s, d)),
    "strip_tagged_line_documents": lambda s, d: tt.strip_tagged_line(_documents(s, d)),
    "extract_slides": lambda s, d: _joined(tt.extract_slides(_replies(s, d)), "bullets"),
    "markdown_blocks": lambda s, d: tt.markdown_blocks(_reports(s, d)),
    "markdown_blocks_documents": lambda s, d: tt.markdown_blocks(_documents(s, d)),
    "markdown_sections": lambda s, d: _joined(tt.markdown_sections(_reports(s, d)), "bullets"),
    "slides_or_sections": lambda s, d: _joined(tt.slides_or_sections(_replies(s, d), _reports(s, d)), "bullets"),
    "section_lines": lambda s, d: _joined(tt.section_lines(_reports(s, d), "Recommendations"), "lines"),
    "recommendations": lambda s, d: _joined(tt.recommendations(
        _reports(s, d), tt.extract_slides(_replies(s, d))), "bullets"),
    "clean_bullets_content": lambda s, d: _cleaned(s, d, "content"),
    "clean_bullets_chart": lambda s, d: _cleaned(s, d, "chart"),
    "clean_bullets_recommendations": lambda s, d: _cleaned(s, d, "recommendations"),
    "section_map": lambda s, d: _joined(tt.section_map(tt.extract_slides(_replies(s, d))), "bullets"),
}

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.replace("{x}", x)


def _hashless(x: str) -> str:
    return _strip(f"regexp_replace({x}, '^#+', '')")


def _lines_sql(source: str) -> str:
    """(id, text, l: raw lines) without the empty one after a final line break."""
    return f"""src AS ({source}), split AS (SELECT id, text, string_split(text, chr(10)) AS l0 FROM src),
lined AS (SELECT id, text, CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END AS l FROM split)"""


_REPORT_LINES = _lines_sql(_duck(REPORTS, "orders"))
_DOCUMENT_LINES = _lines_sql("SELECT doc_id AS id, text FROM documents")
_TAGGED = f"upper({_strip('x')}) LIKE 'CHARTS:%'"
_NUMBERED = "numbered AS (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM lined)"


def _said(path: str) -> str:
    """The value as text, NULL for null, false, zero and empty."""
    return f"CASE WHEN json_extract(e, {path})::VARCHAR NOT IN ('null', 'false', '0', '\"\"') THEN e->>{path} END"


def _specs_sql(axis: str) -> str:
    return f"""WITH {_REPORT_LINES}, last AS (SELECT id, {_strip("substr(" + _strip("list_filter(l, lambda x: " + _TAGGED + ")[-1]") + ", 8)")} AS j FROM lined),
valid AS (SELECT id, j::JSON AS j FROM last WHERE json_valid(j) AND json_type(j) = 'ARRAY'),
e AS (SELECT id, (unnest(range(json_array_length(j)::BIGINT)))::INTEGER AS pos, unnest(json_extract(j, '$[*]')) AS e FROM valid),
o AS (SELECT id, pos, lower(trim(e->>'$.chart_type')) AS chart_type, {_said("'$.x_axis'")} AS x, {_said("'$.y_axis'")} AS y,
  coalesce(e->>'$.title', 'Chart') AS title FROM e WHERE json_type(e) = 'OBJECT')
SELECT id, pos, chart_type, {axis.format(a='x')} AS x_axis, {axis.format(a='y')} AS y_axis, title FROM o
WHERE chart_type IN ('bar', 'line', 'scatter', 'histogram', 'box', 'heatmap', 'pie', 'area')"""


def _stripped_sql(lines: str) -> str:
    return f"""WITH {lines}, {_NUMBERED},
cut AS (SELECT id, max(i) AS c FROM numbered WHERE {_TAGGED} GROUP BY id),
last AS (SELECT id, max(i) AS e FROM numbered JOIN cut USING (id) WHERE i < c AND {_strip('x')} <> '' GROUP BY id)
SELECT id, CASE WHEN c IS NULL THEN text ELSE array_to_string(l[:coalesce(e, 0)], chr(10)) END AS text
FROM lined LEFT JOIN cut USING (id) LEFT JOIN last USING (id)"""


def _blocks_sql(lines: str) -> str:
    return f"""WITH {lines}, {_NUMBERED}, s AS (SELECT id, (i - 1)::INTEGER AS pos, {_strip('x')} AS s FROM numbered)
SELECT id, pos, CASE WHEN s = '' THEN 'blank' WHEN s LIKE '### %' THEN 'h2' WHEN s LIKE '## %' OR s LIKE '# %' THEN 'h1'
  WHEN s LIKE '```%' THEN 'code' WHEN s LIKE '- %' OR s LIKE '* %' THEN 'bullet'
  WHEN s LIKE '**%' AND s LIKE '%**' THEN 'bold' ELSE 'body' END AS kind,
 CASE WHEN s = '' THEN '' WHEN s LIKE '### %' THEN substr(s, 5) WHEN s LIKE '## %' OR s LIKE '# %' THEN {_hashless('s')}
  WHEN s LIKE '```%' THEN regexp_replace(s, '^`+', '') WHEN s LIKE '- %' OR s LIKE '* %' THEN substr(s, 3)
  WHEN s LIKE '**%' AND s LIKE '%**' THEN substr(s, 3, greatest(length(s) - 4, 0)) ELSE s END AS content FROM s"""


_SLIDE_ROWS = f"""src AS ({_duck(SLIDES, 'customer')}),
found AS (SELECT id, regexp_extract(text, '(?s)\\[.*\\]') AS j FROM src),
e AS (SELECT id, (unnest(range(json_array_length(j::JSON)::BIGINT)))::INTEGER AS pos, unnest(json_extract(j::JSON, '$[*]')) AS e
  FROM found WHERE json_valid(j)),
slides AS (SELECT id, pos, coalesce(e->>'$.title', 'Slide') AS title, CASE json_type(e, '$.bullets')
  WHEN 'ARRAY' THEN list_transform(list_filter(json_extract(e, '$.bullets[*]'), lambda b: b::VARCHAR NOT IN ('null', 'false', '0', '""')),
    lambda b: b->>'$')
  WHEN 'VARCHAR' THEN list_filter(list_transform(string_split(e->>'$.bullets', chr(10)), lambda b: {_strip('b')}), lambda b: b <> '')
  ELSE [] END AS bullets FROM e WHERE json_type(e) = 'OBJECT')"""


def _shown(array: str) -> str:
    return f"array_to_string({array}, '¦') || '¦' || len({array})"


def _section_sql(heading: str) -> str:
    """Lines between the heading and the next one, per id; the texts never repeat a line there."""
    return f"""SELECT id, i, s, sum((h)::INTEGER) OVER w AS started, sum((NOT h AND s LIKE '#%')::INTEGER) OVER w AS marks, h FROM (
  SELECT id, i, {_strip('x')} AS s, lower({_hashless(_strip('x'))}) = '{heading.lower()}' AS h FROM numbered)
WINDOW w AS (PARTITION BY id ORDER BY i)"""


def _collected_sql(name: str, heading: str) -> str:
    return f"""{name}_w AS ({_section_sql(heading)}),
{name}_s AS (SELECT *, min(marks) FILTER (started > 0) OVER (PARTITION BY id) AS m0 FROM {name}_w),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM {name}_s
  WHERE started > 0 AND marks = m0 AND NOT h AND s <> ''),
{name} AS (SELECT id, list(s ORDER BY i) AS kept FROM {name}_k GROUP BY id)"""


def _cleaned_sql(expr: str) -> str:
    return f"WITH {_SLIDE_ROWS}, c AS (SELECT id, pos, {expr} AS b FROM slides) SELECT id, pos, {_shown('b')} AS bullets FROM c"


def _bare() -> str:
    inner = _strip("regexp_replace(b, '^[-•*› ]+', '')")
    return f"list_filter(list_transform(bullets, lambda b: {inner}), lambda b: b <> '')"


_SECTIONS = f"""{_REPORT_LINES}, {_NUMBERED},
s AS (SELECT id, i, {_strip('x')} AS s FROM numbered),
h AS (SELECT *, (s LIKE '## %' OR s LIKE '# %') AS head, sum((s LIKE '## %' OR s LIKE '# %')::INTEGER) OVER (PARTITION BY id ORDER BY i) AS n FROM s),
b AS (SELECT id, n, i, CASE WHEN s LIKE '- %' OR s LIKE '* %' THEN {_strip('substr(s, 3)')} ELSE s END AS b,
  row_number() OVER (PARTITION BY id, n ORDER BY i) AS k FROM h WHERE n > 0 AND NOT head AND s <> '' AND s NOT LIKE '#%'),
l AS (SELECT id, n, list(b ORDER BY i) AS bullets FROM b GROUP BY id, n),
sections AS (SELECT id, (n - 1)::INTEGER AS pos, {_hashless('s')} AS title, coalesce(bullets, []) AS bullets
  FROM h LEFT JOIN l USING (id, n) WHERE head)"""


ORACLES = {
    "extract_tagged_json": _specs_sql("{a}"),
    "extract_tagged_json_columns": _specs_sql("CASE WHEN {a} IN ('o_orderpriority', 'a') THEN {a} END"),
    "strip_tagged_line": _stripped_sql(_REPORT_LINES),
    "strip_tagged_line_documents": _stripped_sql(_DOCUMENT_LINES),
    "extract_slides": f"WITH {_SLIDE_ROWS} SELECT id, pos, title, {_shown('bullets')} AS bullets FROM slides",
    "markdown_blocks": _blocks_sql(_REPORT_LINES),
    "markdown_blocks_documents": _blocks_sql(_DOCUMENT_LINES),
    "markdown_sections": f"WITH {_SECTIONS} SELECT id, pos, title, {_shown('bullets')} AS bullets FROM sections",
    "slides_or_sections": f"""WITH {_SECTIONS}, {_SLIDE_ROWS.replace('src', 'src2').replace('found', 'found2').replace('e AS', 'e2 AS').replace('FROM e ', 'FROM e2 ')}
SELECT id, pos, title, {_shown('bullets')} AS bullets FROM slides UNION ALL
SELECT id, pos, title, {_shown('bullets')} AS bullets FROM sections WHERE id NOT IN (SELECT id FROM slides)""",
    "section_lines": f"""WITH {_REPORT_LINES}, {_NUMBERED}, {_collected_sql('r', 'Recommendations')}
SELECT id, {_shown('coalesce(kept, [])')} AS lines FROM lined LEFT JOIN r USING (id)""",
    "recommendations": f"""WITH {_REPORT_LINES}, {_NUMBERED}, {_collected_sql('a', 'Actionable Business Recommendations')},
{_collected_sql('r', 'Recommendations')}, {_SLIDE_ROWS.replace('src', 'src2').replace('found', 'found2')},
c AS (SELECT id, 0 AS rank, 'Actionable Business Recommendations' AS source, kept FROM a
  UNION ALL SELECT id, 1, 'Recommendations', kept FROM r
  UNION ALL SELECT id, 2, 'slides', min_by(bullets, pos) FROM slides
    WHERE lower({_strip('title')}) IN ('actionable business recommendations', 'recommendations') GROUP BY id),
best AS (SELECT id, min_by(source, rank) AS source, min_by(kept, rank) AS kept FROM c WHERE len(kept) > 0 GROUP BY id)
SELECT id, source, {_shown('kept')} AS bullets FROM best""",
    "clean_bullets_content": _cleaned_sql(_bare()),
    "clean_bullets_chart": _cleaned_sql(_bare()),
    "clean_bullets_recommendations": _cleaned_sql(
        "list_transform(list_filter(bullets, lambda b: " + _strip("b") + " <> ''), lambda b: "
        + _strip("regexp_replace(b, '^[-•*›0-9). ]+', '')") + ")"),
    "section_map": f"""WITH {_SLIDE_ROWS}, m AS (SELECT id, title, max_by(bullets, pos) AS bullets FROM slides GROUP BY id, title)
SELECT id, title, {_shown('bullets')} AS bullets FROM m""",
}
