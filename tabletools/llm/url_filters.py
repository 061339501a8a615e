"""Addresses of pages judged by rules, and beyond them by a tree of path templates.

The paths of each host form a tree of segments. Variable segments become wildcards of their shape (``{n}`` digits, ``{d}`` a date, ``{h}`` hex, ``{s}``
a slug or a mix of letters and digits; with the file ending), on hosts of any size. The trees of all hosts are laid over
each other, and level by level, from the root on, branches that are statistically like their siblings are merged into ``*``: their share of blocked labels does
not differ from that of the siblings, by a test of two proportions, and what follows them is distributed alike. So a merged branch
has one name on every host, with labels or without.

Labels are the verdicts of the rules. A template is rejected on a host if the smoothed share of blocked pages among its labelled ones is over a
half; the smoothing draws it towards the share of the same template on all hosts, that one towards the template above it, and so on
up to the share of all pages, so the nearest one with labels decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletools.functions.joins import join_group_facts
from tabletools.sources.staging import stage

# Fixed values: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SAME_Z = 1.96
ALIKE = 0.25            # total variation distance up to which branches are followed by the same
SMOOTHING = 2.0
REJECT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPES = (("n", "[0-9]+"), ("d", r"[0-9]{4}[-_.][0-9]{2}[-_.][0-9]{2}"), ("h", "[0-9a-fA-F-]{8,}"),
           ("s", r"[^-_]+([-_][^-_]+){2,}|[A-Za-z_-]*[0-9][A-Za-z0-9_-]*"))
_ENDING = r"(\.[A-Za-z][A-Za-z0-9]{0,4})?"


def split_url(url) -> tuple:
    """Columns with the host, A-Z in lower case, and the path; both empty without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def rule_of(host, path, rules=RULES):
    """A struct column with the rule that fits (the longest; ``rule`` like ``net/``) and its verdict; null without one."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    found = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                    F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def _name(segment):
    """The wildcard of a variable segment; any other as it is."""
    ending = F.regexp_extract(segment, _ENDING + "$", 1)
    name = segment
    for shape, pattern in reversed(_SHAPES):
        name = F.when(segment.rlike(f"^({pattern}){_ENDING}$"), F.concat(F.lit("{" + shape + "}"), ending)).otherwise(name)
    return name


def path_names(path):
    """An array column with the names of a path's segments; without empty segments."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _name)


def _share(blocked, labelled, prior):
    return (blocked + SMOOTHING * prior) / (labelled + SMOOTHING)


def _sums():
    return [F.sum(c).alias(c) for c in ("n", "blocked", "labelled")]


def _like_siblings():
    """Whether a branch (n, blocked, labelled) is like the rest of its node (all_n, all_blocked, all_labelled); ``same_n``, ``apart_n``: as in
    :func:`_merged`. Without labels on both sides what follows decides alone."""
    own, rest = F.col("labelled"), F.col("all_labelled") - F.col("labelled")
    pooled = F.col("all_blocked") / F.col("all_labelled")
    apart = F.col("blocked") / own - (F.col("all_blocked") - F.col("blocked")) / rest
    labels = F.when((own > 0) & (rest > 0), apart * apart <= SAME_Z ** 2 * pooled * (1 - pooled) * (1 / own + 1 / rest) + 1e-12).otherwise(True)
    distance = (F.col("apart_n") + 1 - F.col("same_n")) / 2
    return (F.col("all_n") > F.col("n")) & labels & (distance <= ALIKE + 1e-12)


def _merged(open_: DataFrame) -> DataFrame:
    """``template, name, final`` of the branches of a level, and the ``rows`` of each. ``open_``: template, name, next (what follows, empty at the end) and counts."""
    kids = stage(open_.groupBy("template", "name", "next").agg(*_sums(), F.count("*").alias("rows")), "url-branches")
    branches = stage(kids.groupBy("template", "name").agg(*_sums(), F.sum("rows").alias("rows"), F.count("*").alias("kids")), "url-names")
    nodes = stage(kids.groupBy("template").agg(
        *[F.sum(c).alias(f"all_{c}") for c in ("n", "blocked", "labelled")], F.count("*").alias("node_kids")), "url-nodes")
    after = stage(kids.groupBy("template", "next").agg(F.sum("n").alias("next_n"), F.count("*").alias("next_kids")), "url-following")
    known = kids.select("template", "name", "next", F.col("n").alias("kid_n"))
    known = join_group_facts(known, after, ["template", "next"], "name", size="next_kids")
    known = join_group_facts(known, nodes, ["template"], "name", size="node_kids")
    known = join_group_facts(known, branches, ["template", "name"], "next", size="kids")
    others = (F.col("next_n") - F.col("kid_n")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))       # share of what follows the siblings
    facts = ["template", "name", "rows", "n", "blocked", "labelled", "all_n", "all_blocked", "all_labelled"]
    distances = known.groupBy(*facts).agg(F.sum(others).alias("same_n"), F.sum(F.abs(F.col("kid_n") / F.col("n") - others)).alias("apart_n"))
    return distances.select("template", "name", "rows", F.when(F.coalesce(_like_siblings(), F.lit(False)), "*").otherwise(F.col("name")).alias("final"))


def path_templates(paths: DataFrame) -> DataFrame:
    """``names, template``, and the number of rows as ``hosts``, for each distinct ``names`` of ``paths`` (host, names, n, blocked, labelled); ``template`` is the names with
    merged branches as ``*``. A path that is alone in its node needs no further level."""
    pooled = paths.groupBy("names").agg(*_sums(), F.count("*").alias("hosts"))
    rows = stage(pooled.withColumn("template", F.array().cast("array<string>")), "url-names")
    done = None
    while True:
        level = F.size("template")
        alone = stage(rows.groupBy("template").agg(F.count("*").alias("paths")), "url-nodes")
        counted = join_group_facts(rows, alone, ["template"], "names", size="paths")
        ends = (F.col("paths") == 1) | (F.size("names") == level)
        whole = F.concat("template", F.slice("names", level + 1, F.greatest(F.size("names") - level, F.lit(1))))
        closed = counted.where(ends).select("names", "hosts", F.when(F.size("names") == level, F.col("template")).otherwise(whole).alias("template"))
        done = closed if done is None else done.unionByName(closed)
        rows = stage(counted.where(~ends).drop("paths").withColumns({
            "name": F.get("names", level), "next": F.coalesce(F.get("names", level + 1), F.lit(""))}), "url-open-paths")
        if rows.isEmpty():
            return stage(done, "url-templates")
        finals = stage(_merged(rows), "url-merged")
        rows = stage(join_group_facts(rows, finals, ["template", "name"], "names", size="rows").select(
            "names", "hosts", "n", "blocked", "labelled", F.concat("template", F.array("final")).alias("template")), "url-names")


def _keys(template):
    """A key for each node on the way to a template, the template itself last: level and a digest of the way."""
    way = F.aggregate(template, F.array().cast("array<string>"), lambda done, name: F.concat(done, F.array(F.md5(F.concat(
        F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), F.lit("/"), name).cast("binary")))))
    return F.transform(way, lambda key, i: F.struct(i.alias("level"), key.alias("key")))


def purities(paths: DataFrame, prior: float) -> DataFrame:
    """``host, template, paths, purity`` of ``paths`` (host, template, n, blocked, labelled): the smoothed share of blocked labels of the host's
    template, drawn towards that on all hosts, and that one towards the node above it, up to ``prior``."""
    own = stage(paths.groupBy("host", "template").agg(*_sums(), F.count("*").alias("paths")), "url-host-templates")
    every = stage(own.groupBy("template").agg(*_sums(), F.count("*").alias("hosts")), "url-all-templates")
    asked = stage(every.select("template", "blocked", "labelled", F.explode(_keys(F.col("template"))).alias("at"))
                  .select("template", "blocked", "labelled", "at.*"), "url-ways")
    facts = asked.groupBy("key").agg(F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled"),
                                     F.count("*").alias("below")).where("all_labelled > 0")
    levels = join_group_facts(asked.select("template", "level", "key"), stage(facts, "url-ways"), ["key"], "template", size="below") \
        .groupBy("template").agg(F.sort_array(F.collect_list(F.struct("level", "all_blocked", "all_labelled"))).alias("levels"))
    above = F.aggregate("levels", F.lit(prior), lambda p, x: _share(x["all_blocked"], x["all_labelled"], p))
    alike = every.select("template", "hosts").join(levels, "template", "left").select(
        "template", "hosts", F.coalesce(above, F.lit(prior)).alias("alike"))
    return join_group_facts(own, stage(alike, "url-alike"), ["template"], "host", size="hosts").select(
        "host", "template", "paths", _share(F.col("blocked"), F.col("labelled"), F.col("alike")).alias("purity"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of each page; ``verdict`` is the rule's, or else by the purity.

    ``purity`` is the smoothed share of blocked pages of the page's template on its host. Null addresses and those without
    ``://`` are one host and path, both empty; repeated rows count each; a very long path is one path with as many levels as it has segments until
    it is alone in its node. Other columns of ``pages`` are not read; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = stage(judged.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules)), "url-pages")
    blocked, labelled = F.col("by_rule.verdict") == "block", F.col("by_rule").isNotNull()
    paths = judged.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count(F.when(blocked, 1)).alias("blocked"), F.count(F.when(labelled, 1)).alias("labelled"))
    paths = stage(paths.withColumn("names", path_names(F.col("path"))), "url-counts")
    paths = stage(join_group_facts(paths, path_templates(paths), ["names"], "path", size="hosts").drop("hosts"), "url-templates")
    blocked, labelled = paths.agg(F.sum("blocked"), F.sum("labelled")).first()
    prior = ((blocked or 0) + 1.0) / ((labelled or 0) + 2.0)
    purity = stage(purities(paths, prior), "url-purities")
    of_path = join_group_facts(paths.select("host", "path", "n", "template"), purity, ["host", "template"], "path", size="paths")
    found = join_group_facts(judged, stage(of_path, "url-paths"), ["host", "path"], "page_id", size="n")
    by_purity = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"),
                        F.coalesce("by_rule.verdict", by_purity).alias("verdict"),
                        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
