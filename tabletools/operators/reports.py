"""Chart specs, slides, blocks, sections and bullets out of tables of Markdown reports.

Input is a table (id, text), one report or reply per row. Each text is taken apart inside
its row with array expressions, so only the exploded results ever move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletools import constants as K
from tabletools.functions.joins import prefer
from tabletools.functions.kinds import col
from tabletools.functions.lines import (
    LINE_BREAK, exploded, first_where, last_where, starts_with_any, starts_with_tag, strip, with_lines,
    without_hashes)
from tabletools.operators.charts import validate_chart_specs
from tabletools.sources.staging import stage

_NO_TEXTS = "array<string>"


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _entries(json: Column) -> Column:
    """The objects of a JSON array as (pos, entry); NULL unless the text is a JSON array and nothing else.

    The parser stops after the first value, so the text must also parse with brackets and with a key and braces around
    it: text behind the array breaks the one or the other.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))).isNotNull()
    held = F.try_parse_json(F.concat(F.lit('{"a":'), json, F.lit("}")))
    elements = F.when(alone, F.try_variant_get(held, "$.a", "array<variant>"))
    return F.filter(F.transform(elements, lambda e, i: F.struct(i.alias("pos"), e.alias("entry"))),
                    lambda s: _is_object(s["entry"]))


def _keep_last_of_equal_keys(df: DataFrame) -> None:
    """Of a key that an object has twice the last value counts, as JSON readers commonly have it. Spark's parser has a session
    setting for this, and would else refuse the text."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _text_of(entry: Column, key: str) -> Column:
    return F.try_variant_get(entry, f"$.{key}", "string")


def _says_something(value: Column) -> Column:
    """Whether a variant is neither null, false, zero nor empty. The texts "0" and "false" are texts like others."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return F.when(value.isNull() | (kind == "VOID"), False).when(kind == "STRING", text != "") \
        .when(kind == "BOOLEAN", text == "true").when(F.startswith(kind, F.lit("ARRAY")), text != "[]") \
        .when(F.startswith(kind, F.lit("OBJECT")), text != "{}").otherwise(F.try_variant_get(value, "$", "double") != 0)


def _axis_of(entry: Column, key: str) -> Column:
    value = F.try_variant_get(entry, f"$.{key}", "variant")
    return F.when(_says_something(value), F.try_variant_get(value, "$", "string"))


def extract_tagged_json(df: DataFrame, text: str = "text", tag: str = K.CHART_TAG, id: str = "id",
                        columns: list[str] | None = None) -> DataFrame:
    """(id, pos, chart_type, x_axis, y_axis, title) from the last line that starts with the tag."""
    _keep_last_of_equal_keys(df)
    tagged = with_lines(df, text, id, stripped=False, mark=tag).select(
        "id", F.filter("lines", lambda l: starts_with_tag(l, tag)).alias("tagged"))
    fragment = strip(F.substr(strip(F.get("tagged", F.size("tagged") - 1)), F.lit(len(tag) + 1)))
    found = exploded(tagged.select("id", _entries(fragment).alias("entries")), "entries", "place", "e")
    specs = found.select("id", "e.pos", *[
        (_axis_of if key.endswith("axis") else _text_of)(F.col("e.entry"), key).alias(key)
        for key in ("chart_type", "x_axis", "y_axis", "title")])
    return validate_chart_specs(specs, columns)


def strip_tagged_line(df: DataFrame, text: str = "text", tag: str = K.CHART_TAG, id: str = "id") -> DataFrame:
    """(id, text) up to the last tagged line, without blank lines at the end; an untagged
    text is returned as it is."""
    cut = with_lines(df, text, id, stripped=False, mark=tag).withColumn(
        "cut", last_where("lines", lambda l: starts_with_tag(l, tag)))
    kept = cut.withColumn("lines", F.slice("lines", F.lit(1), F.col("cut") - 1)) \
        .withColumn("end", F.coalesce(last_where("lines", lambda l: strip(l) != ""), F.lit(0)))
    return kept.select("id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(
        F.array_join(F.slice("lines", F.lit(1), F.col("end")), "\n")).alias("text"))


def extract_slides(df: DataFrame, text: str = "text", id: str = "id") -> DataFrame:
    """(id, pos, title, bullets) from the widest bracketed span of each text."""
    _keep_last_of_equal_keys(df)
    span = F.regexp_extract(col(text), r"(?s)\[.*\]", 0)
    found = exploded(df.select(col(id).alias("id"), _entries(span).alias("entries")), "entries", "place", "e") \
        .select("id", "e.pos", "e.entry")
    raw = F.try_variant_get("entry", "$.bullets", "variant")
    shape = F.schema_of_variant(raw)
    listed = F.transform(F.filter(F.try_variant_get("entry", "$.bullets", "array<variant>"), _says_something),
                         lambda b: F.try_variant_get(b, "$", "string"))
    written = F.filter(F.transform(F.split(_text_of(F.col("entry"), "bullets"), LINE_BREAK), strip), lambda b: b != "")
    bullets = F.when(F.startswith(shape, F.lit("ARRAY")), listed).when(shape == "STRING", written) \
        .otherwise(F.array().cast(_NO_TEXTS))
    return found.select("id", "pos", F.coalesce(_text_of(F.col("entry"), "title"), F.lit(K.DEFAULT_SLIDE_TITLE)).alias("title"),
                        bullets.alias("bullets"))


def markdown_blocks(df: DataFrame, text: str = "text", id: str = "id") -> DataFrame:
    """(id, pos, kind, content) per line: blank, h2, h1, code, bullet, bold or body."""
    line = F.col("line")
    rules = [
        ("blank", line == "", line),
        ("h2", F.startswith(line, F.lit("### ")), F.substr(line, F.lit(5))),
        ("h1", starts_with_any(line, "## ", "# "), without_hashes(line)),
        ("code", F.startswith(line, F.lit("```")), F.ltrim(line, F.lit("`"))),
        ("bullet", starts_with_any(line, "- ", "* "), F.substr(line, F.lit(3))),
        ("bold", F.startswith(line, F.lit("**")) & F.endswith(line, F.lit("**")),
         F.substr(line, F.lit(3), F.greatest(F.length(line) - 4, F.lit(0)))),
    ]
    kind, content = F.lit("body"), line
    for name, condition, value in reversed(rules):
        kind = F.when(condition, F.lit(name)).otherwise(kind)
        content = F.when(condition, value).otherwise(content)
    return exploded(with_lines(df, text, id).select("id", "lines"), "lines", "pos", "line") \
        .select("id", "pos", kind.alias("kind"), content.alias("content"))


def markdown_sections(df: DataFrame, text: str = "text", id: str = "id", max_bullets: int | None = None,
                      max_chars: int | None = None) -> DataFrame:
    """(id, pos, title, bullets): one row per heading with its lines or bullets; ``max_bullets`` of them, and
    ``max_chars`` of a line that is no bullet, if given."""
    heads = with_lines(df, text, id, mark="# ").select("id", F.col("lines").alias("body")).withColumn("heads", F.filter(
        F.transform("body", lambda l, i: F.when(starts_with_any(l, "## ", "# "), i + 1)),
        lambda p: p.isNotNull()))
    ends = F.concat(F.slice("heads", F.lit(2), F.size("heads")), F.array(F.size("body") + 1))
    heads = heads.withColumn("ends", ends)
    spans = F.transform("heads", lambda p, i: F.struct(p.alias("start"), F.get("ends", i).alias("end")))
    sections = exploded(heads.select("id", "body", spans.alias("spans")), "spans", "pos", "span") \
        .select("id", "pos", without_hashes(F.element_at("body", F.col("span.start"))).alias("title"),
                F.slice("body", F.col("span.start") + 1, F.col("span.end") - F.col("span.start") - 1).alias("body"))
    drawn = F.filter("body", lambda l: (l != "") & ~F.startswith(l, F.lit("#")))
    bullets = F.transform(_first(drawn, max_bullets), lambda l: F.when(
        starts_with_any(l, "- ", "* "), strip(F.substr(l, F.lit(3)))).otherwise(
            l if max_chars is None else F.substr(l, F.lit(1), F.lit(max_chars))))
    return sections.select("id", "pos", "title", bullets.alias("bullets"))


def _first(array: Column, limit: int | None) -> Column:
    return array if limit is None else F.slice(array, 1, limit)


def slides_or_sections(replies: DataFrame, reports: DataFrame, text: str = "text", id: str = "id",
                       max_bullets: int | None = None, max_chars: int | None = None) -> DataFrame:
    """(id, pos, title, bullets): the slides of the reply; the report's sections where it has none."""
    sections = markdown_sections(reports, text, id, max_bullets, max_chars)
    return prefer(extract_slides(replies, text, id), sections, "id")


def _with_section(lined: DataFrame, heading: str, name: str, max_lines: int | None) -> DataFrame:
    """``lined`` with the column ``name``: the kept lines of the section under ``heading``, none without it."""
    def is_heading(line):
        return F.lower(without_hashes(line)) == F.lit(heading.lower())

    def listed(line):
        return starts_with_any(line, "-", "*", "•", "›") | ((F.length(line) > 4) & line.rlike("^[0-9]"))

    def keep(kept, line):
        # a plain line is dropped when it repeats the end of the last kept one
        repeats = (F.size(kept) >= 2) & F.endswith(F.try_element_at(kept, F.lit(-1)), line)
        wanted = listed(line) | ~repeats
        taken = wanted if max_lines is None else wanted & (F.size(kept) < max_lines)
        return F.when(taken, F.concat(kept, F.array(line))).otherwise(kept)

    start, stop, rest = f"_{name}_start", f"_{name}_stop", f"_{name}_rest"
    after = lined.withColumn(start, first_where("lines", is_heading)) \
        .withColumn(rest, F.slice("lines", F.col(start) + 1, F.size("lines")))
    stopped = after.withColumn(stop, first_where(rest, lambda l: F.startswith(l, F.lit("#")) & ~is_heading(l)))
    body = stopped.withColumn(rest, F.filter(
        F.slice(rest, F.lit(1), F.coalesce(F.col(stop) - 1, F.size(rest))),
        lambda l: (l != "") & ~is_heading(l)))
    none = F.array().cast(_NO_TEXTS)
    return body.withColumn(name, F.coalesce(F.aggregate(rest, none, keep), none)).drop(start, stop, rest)


def section_lines(df: DataFrame, heading: str, text: str = "text", id: str = "id",
                  max_lines: int | None = None) -> DataFrame:
    """(id, lines): the lines of one named section, ``max_lines`` of them if given; none for a text without it."""
    lined = with_lines(df, text, id, mark=heading)
    return _with_section(lined, heading, "found", max_lines).select("id", F.col("found").alias("lines"))


def recommendations(reports: DataFrame, slides: DataFrame, text: str = "text", id: str = "id",
                    max_lines: int | None = None) -> DataFrame:
    """(id, source, bullets): the recommendation section, else such a slide; no row if neither.

    The sections are found within the row of their text; only slides are grouped, and only those of other ids are joined.
    """
    found = with_lines(reports, text, id, mark=K.RECOMMENDATION_HEADINGS[-1])
    names = {f"section{i}": h for i, h in enumerate(K.RECOMMENDATION_HEADINGS)}
    for name, heading in names.items():
        found = _with_section(found, heading, name, max_lines)
    best = F.coalesce(*[F.when(F.size(name) > 0, F.struct(F.lit(heading).alias("source"), F.col(name).alias("bullets")))
                        for name, heading in names.items()])
    # written once, as it is read for its ids and for its rows
    named = stage(exploded(found.select("id", F.array(best).alias("best")), "best", "place", "found")
                  .where("found IS NOT NULL").select("id", "found.*"), "recommendations")
    wanted = F.lower(strip(F.col("title"))).isin(*[h.lower() for h in K.RECOMMENDATION_HEADINGS])
    from_slides = slides.where(wanted).groupBy("id").agg(F.min_by("bullets", "pos").alias("bullets")) \
        .where(F.size("bullets") > 0).select("id", F.lit("slides").alias("source"), "bullets")
    return prefer(named, from_slides, "id")


_MARKS = "-•*› "


def clean_bullets(bullets: Column, mode: str = "content", limit: int | None = None) -> Column:
    """Bullets without their marks, ``limit`` of them if given. Content and chart slides cut first and then drop what
    is empty; recommendations drop blank input, lose their numbers too, and are cut last."""
    if mode not in K.BULLET_MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {K.BULLET_MODES}")
    if mode == "recommendations":
        present = F.filter(bullets, lambda b: strip(b) != "")
        return _first(F.transform(present, lambda b: strip(F.ltrim(b, F.lit(_MARKS + "0123456789).")))), limit)
    bare = F.transform(_first(bullets, limit), lambda b: strip(F.ltrim(b, F.lit(_MARKS))))
    return F.filter(bare, lambda b: b != "")


def section_map(slides: DataFrame) -> DataFrame:
    """(id, title, bullets): the bullets per title; of several slides the last one counts."""
    return slides.groupBy("id", "title").agg(F.max_by("bullets", "pos").alias("bullets"))
