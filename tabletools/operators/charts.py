"""Chart choice, and the aggregates behind each chart as small tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletools import constants as K
from tabletools.functions.joins import join_group_facts, prefer
from tabletools.functions.kinds import DATETIME, NUMERIC, col, columns_of, is_missing, kind_of, number
from tabletools.functions.quantiles import GROUP_VALUES, group_quantiles
from tabletools.operators.profile import TableProfile, strongest_columns
from tabletools.sources.staging import stage

BINS = 20
DENSITY_POINTS = 128     # points of a density's grid at least
KERNEL_REACH = 4.0       # bandwidths that the kernel reaches
_SPEC = "rank int, chart_type string, x_axis string, y_axis string, title string"


# -- choice -----------------------------------------------------------------------------

def recommend_charts(df, limit: int | None = None) -> DataFrame:
    """(rank, chart_type, x_axis, y_axis, title): the charts that suit the columns, the first ``limit`` if given."""
    p = df if isinstance(df, TableProfile) else TableProfile(df)
    numbers, texts, dates = p.numeric, p.text, columns_of(p.df, DATETIME)
    picks: list[tuple] = []
    if numbers:
        picks.append(("histogram", numbers[0], None, K.HISTOGRAM_TITLE.format(x=numbers[0])))
        if texts:
            picks.append(("bar", texts[0], numbers[0], K.BAR_TITLE.format(x=texts[0], y=numbers[0])))
        if len(numbers) > 2:
            picks.append(("heatmap", None, None, K.HEATMAP_TITLE))
        if pair := strongest_columns(p):
            picks.append(("scatter", *pair, K.SCATTER_TITLE.format(x=pair[0], y=pair[1])))
        if texts:
            spread = numbers[min(1, len(numbers) - 1)]
            picks.append(("box", texts[0], spread, K.BOX_TITLE.format(x=texts[0], y=spread)))
        if dates:
            picks.append(("line", dates[0], numbers[0], K.LINE_TITLE.format(x=dates[0], y=numbers[0])))
    rows = [(i + 1, *pick) for i, pick in enumerate(picks[:limit])]
    return p.df.sparkSession.createDataFrame(rows, _SPEC)


def _known_axis(name: str, columns: list[str] | None) -> Column:
    axis = F.nullif(col(name), F.lit(""))
    return axis if columns is None else F.when(axis.isin(*columns), axis) if columns \
        else F.lit(None).cast("string")


def validate_chart_specs(specs: DataFrame, columns: list[str] | None = None,
                         types: tuple[str, ...] = K.SPEC_CHART_TYPES) -> DataFrame:
    """Specs of known chart types; an empty axis, or one that is no column, becomes NULL."""
    cleaned = {"chart_type": F.lower(F.trim("chart_type")), "x_axis": _known_axis("x_axis", columns),
               "y_axis": _known_axis("y_axis", columns), "title": F.coalesce("title", F.lit(K.DEFAULT_CHART_TITLE))}
    return specs.select(*[cleaned.get(c, col(c)).alias(c) for c in specs.columns]) \
        .where(F.col("chart_type").isin(*types))


def choose_charts(parsed: DataFrame, rule_based: DataFrame, key: str = "id") -> DataFrame:
    """Per key the parsed specs; the rule-based ones where there are none."""
    return prefer(parsed, rule_based, key)


# -- data behind the charts -------------------------------------------------------------

def _points(df: DataFrame, x: str, y: str | None) -> DataFrame:
    """x as it is, y as number; rows without either are not drawn."""
    return _present(df, x, y).select(col(x).alias("x"), *([number(df, y).alias("y")] if y else []))


def _present(df: DataFrame, *columns: str | None) -> DataFrame:
    """Rows that have all the columns, tested on the columns as stored, so that a scan can skip."""
    return df.where(reduce(and_, [~is_missing(df, c) for c in columns if c]))


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of equal width; the maximum falls in the last bin."""
    place = F.floor((value - low) / (high - low) * bins).cast("int")
    return F.when(high > low, F.least(place, F.lit(bins - 1))).otherwise(0)


def _bin_edges(data: DataFrame, low: Column, high: Column, bins: int) -> DataFrame:
    width = (high - low) / bins
    return data.withColumn("lower", low + F.col("bin") * width).withColumn("upper", low + (F.col("bin") + 1) * width)


def histogram_data(df: DataFrame, x: str, y: str | None = None, bins: int = BINS) -> DataFrame:
    """(bin, n, lower, upper), with y also the total of y per bin."""
    data = _present(df, x, y).select(number(df, x).alias("x"), *([number(df, y).alias("y")] if y else []))
    low, high = (F.lit(v).cast("double") for v in data.agg(F.min("x"), F.max("x")).first())
    measures = [F.count("*").alias("n")] + ([F.sum("y").alias("total")] if y else [])
    return _bin_edges(data.groupBy(_bin(F.col("x"), low, high, bins).alias("bin")).agg(*measures), low, high, bins)


def bar_data(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """(x, n, total of y), one row per bar; without y the height is n."""
    measures = [F.count("*").alias("n")] + ([F.sum("y").alias("total")] if y else [])
    return _points(df, x, y).groupBy("x").agg(*measures)


def heatmap_data(df) -> DataFrame:
    """(a, b, r): the full symmetric correlation matrix; empty below two numeric columns."""
    p = df if isinstance(df, TableProfile) else TableProfile(df)
    if len(p.numeric) < 2:
        return p.df.sparkSession.createDataFrame([], "a string, b string, r double")
    above = p.correlations.select("a", "b", "r")
    facts = {c: p.fact(c) for c in p.numeric}
    itself = p.df.sparkSession.createDataFrame(
        [(c, c, 1.0 if f["n"] > 1 and f["min"] < f["max"] else None) for c, f in facts.items()], above.schema)
    return above.unionByName(above.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(itself)


def scatter_data(df: DataFrame, x: str, y: str, keys: list[str] | None = None,
                 max_points: int | None = None) -> DataFrame:
    """(x, y) of all points, or of a stable sample: the ``max_points`` smallest key hashes."""
    data = _present(df, x, y).select(
        number(df, x).alias("x"), number(df, y).alias("y"),
        F.md5(F.concat_ws("|", *[col(k).cast("string") for k in keys or []])).alias("digest"))
    if max_points is not None:
        if not keys:
            raise ValueError("A sample of points needs keys.")
        data = data.orderBy("digest").limit(max_points)
    return data.select("x", "y")


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = BINS) -> DataFrame:
    """(x_bin, y_bin, n): points counted on a grid, for tables too large to draw."""
    data = _present(df, x, y).select(number(df, x).alias("x"), number(df, y).alias("y"))
    x0, x1, y0, y1 = (F.lit(v).cast("double") for v in
                      data.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
    return data.groupBy(_bin(F.col("x"), x0, x1, bins).alias("x_bin"),
                        _bin(F.col("y"), y0, y1, bins).alias("y_bin")).agg(F.count("*").alias("n"))


def box_data(df: DataFrame, x: str, y: str, group_values: int = GROUP_VALUES) -> DataFrame:
    """(x, n, q1, median, q3, lower_whisker, upper_whisker, n_outliers) per category.

    Whiskers end at the last value within 1.5 IQR of the box.
    """
    points = _points(df, x, y)
    boxes = group_quantiles(points, "x", "y", [0.25, 0.5, 0.75], group_values).select(
        "x", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = K.IQR_MULTIPLIER * (F.col("q3") - F.col("q1"))
    inside = F.col("y").between(F.col("q1") - reach, F.col("q3") + reach)
    known = join_group_facts(points, stage(boxes, "boxes"), ["x"], "y", size="n")
    return known.groupBy("x", "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("y"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("y"))).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"))


def violin_data(df: DataFrame, x: str, y: str, bins: int = BINS) -> DataFrame:
    """(x, bin, n, share, lower, upper): the distribution of y within each category."""
    points = _points(df, x, y)
    ranges = points.groupBy("x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("size"))
    low, high = F.col("lo"), F.col("hi")
    counted = join_group_facts(points, stage(ranges, "ranges"), ["x"], "y", size="size") \
        .groupBy("x", "lo", "hi", "size", _bin(F.col("y"), low, high, bins).alias("bin")) \
        .agg(F.count("*").alias("n"))
    return _bin_edges(counted, low, high, bins).select(
        "x", "bin", "n", (F.col("n") / F.col("size")).alias("share"), "lower", "upper")


def violin_density(df: DataFrame, x: str, y: str, points: int = DENSITY_POINTS) -> DataFrame:
    """(x, point, y, density): a smooth curve of y's distribution within each category, by a Gaussian kernel of Scott's bandwidth.

    Values are shared out between the two nearest points of a grid, at most a quarter of a bandwidth apart, and the sums are
    spread by the kernel at the distances of the grid; both are aggregates. Each curve sums to one over its grid; points that no
    value reaches are left out. A category without spread has no curve.
    """
    values = _points(df, x, y)
    facts = values.groupBy("x").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.stddev("y").alias("s")) \
        .where("hi > lo")
    width = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    facts = facts.withColumn("h", width).withColumn("start", F.col("lo") - KERNEL_REACH * F.col("h")) \
        .withColumn("step", F.least((F.col("hi") - F.col("lo") + 2 * KERNEL_REACH * F.col("h")) / (points - 1), F.col("h") / 4))
    facts = stage(facts.select("x", "n", "h", "start", "step"), "density-grids")
    place = (F.col("y") - F.col("start")) / F.col("step")
    placed = join_group_facts(values, facts, ["x"], "y", size="n").select("x", "n", "h", "start", "step", place.alias("place"))
    cell, over = F.floor("place"), F.col("place") - F.floor("place")
    ends = F.explode(F.array(F.struct(cell.alias("cell"), (1 - over).alias("w")), F.struct((cell + 1).alias("cell"), over.alias("w"))))
    grid = placed.select("x", "n", "h", "start", "step", ends.alias("e")) \
        .groupBy("x", "n", "h", "start", "step", F.col("e.cell").alias("cell")).agg(F.sum("e.w").alias("w"))
    reach = F.floor(KERNEL_REACH * F.col("h") / F.col("step")).cast("long")
    offsets = F.sequence(-reach, reach)
    heights = F.transform(offsets, lambda o: F.exp(-0.5 * F.pow(o * F.col("step") / F.col("h"), F.lit(2.0))))
    mass = F.aggregate(heights, F.lit(0.0), lambda a, b: a + b)
    spread = grid.withColumn("mass", mass).withColumn("o", F.explode(offsets)).select(
        "x", "n", "start", "step", (F.col("cell") + F.col("o")).alias("point"),
        (F.col("w") * F.exp(-0.5 * F.pow(F.col("o") * F.col("step") / F.col("h"), F.lit(2.0))) / F.col("mass")).alias("w"))
    density = F.sum("w") / (F.col("n") * F.col("step"))
    return spread.groupBy("x", "n", "start", "step", "point").agg(density.alias("density")).select(
        "x", "point", (F.col("start") + F.col("point") * F.col("step")).alias("y"), "density")


_AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def line_data(df: DataFrame, x: str, y: str, unit: str | None = None, agg: str = "avg", max_points: int | None = None) -> DataFrame:
    """(x, y) in the order of x, one value per x or per date unit (month, day, ...).

    With ``max_points`` a line of more is thinned without a change to its drawing ``max_points // 4`` pixels wide: of each pixel column the first,
    last, lowest and highest point stay. x must be a number or a date then.
    """
    place = F.date_trunc(unit, F.col("x")) if unit else F.col("x")
    line = _points(df, x, y).groupBy(place.alias("x")).agg(_AGGREGATES[agg]("y").alias("y"))
    return (_four_extremes(line, max_points) if max_points is not None else line).orderBy("x")


def _four_extremes(line: DataFrame, max_points: int) -> DataFrame:
    if max_points < 4:
        raise ValueError("A thinned line needs at least four points.")
    kind = kind_of(line.schema["x"].dataType)
    if kind not in (NUMERIC, DATETIME):
        raise ValueError("Only lines over numbers or dates are thinned.")
    line = stage(line, "line")
    place = F.col("x").cast("double") if kind == NUMERIC else F.unix_micros(F.col("x").cast("timestamp")).cast("double")
    n, low, high = line.agg(F.count("*"), F.min(place), F.max(place)).first()
    if n <= max_points:
        return line
    pixel = F.least(F.floor((place - F.lit(low)) / F.lit((high - low) or 1.0) * (max_points // 4)), F.lit(max_points // 4 - 1))
    point = F.struct("x", "y")
    lowest, highest = F.min(F.struct("y", "x")), F.max(F.struct(F.col("y"), F.col("x")))
    ends = line.groupBy(pixel.alias("pixel")).agg(
        F.min_by(point, "x").alias("first"), F.max_by(point, "x").alias("last"), lowest.alias("low"), highest.alias("high"))
    four = F.array("first", "last", *[F.struct(F.col(f"{e}.x").alias("x"), F.col(f"{e}.y").alias("y")) for e in ("low", "high")])
    return ends.select(F.explode(F.array_distinct(four)).alias("p")).select("p.x", "p.y")


def pie_data(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """(x, value, share): total of y, or row count, per slice and its share of the whole."""
    measure = F.sum("y") if y else F.count("*")
    points = _points(df, x, y)
    whole = points.agg(measure).first()[0]
    return points.groupBy("x").agg(measure.alias("value")) \
        .withColumn("share", F.try_divide(F.col("value"), F.lit(whole)))


def area_data(df: DataFrame, x: str, y: str, unit: str | None = None, group: str | None = None,
              max_points: int | None = None) -> DataFrame:
    """(x, y) in the order of x: the area's height is the total of y at x; with ``max_points`` thinned as a line is.

    With ``group`` one area per group, stacked in the order of the groups: (x, group, y, lower, upper).
    """
    if group is None:
        return line_data(df, x, y, unit, "sum", max_points)
    place = F.date_trunc(unit, col(x)) if unit else col(x)
    totals = _present(df, x, y, group).groupBy(place.alias("x"), col(group).alias("group")) \
        .agg(F.sum(number(df, y)).alias("y"))
    upper = F.sum("y").over(Window.partitionBy("x").orderBy("group").rowsBetween(Window.unboundedPreceding, 0))
    return totals.withColumn("upper", upper).select("x", "group", "y", (F.col("upper") - F.col("y")).alias("lower"), "upper") \
        .orderBy("x", "group")


def chart_data(df: DataFrame, chart_type: str, x: str | None, y: str | None) -> DataFrame | None:
    """The table behind one chart spec; None for an unknown type or a missing axis."""
    if chart_type == "heatmap":
        return heatmap_data(df)
    needs_y = {"scatter": scatter_data, "box": box_data, "line": line_data, "violin": violin_data, "area": area_data}
    takes_y = {"histogram": histogram_data, "bar": bar_data, "pie": pie_data}
    if x is None or (chart_type in needs_y and y is None):
        return None
    draw = needs_y.get(chart_type) or takes_y.get(chart_type)
    return draw(df, x, y) if draw else None
