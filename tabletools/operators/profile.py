"""What is in a table: shape, kinds, statistics, correlations, top values, flags, text."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletools import constants as K
from tabletools.functions.gram import NOISE, block_correlations
from tabletools.functions.kinds import (
    BOOLEAN, CATEGORICAL, DATETIME, NUMERIC, batches, col, columns_of, dtype_map, is_missing, number)
from tabletools.functions.quantiles import column_quantiles
from tabletools.functions.ranks import numbered
from tabletools.functions.values import top_values
from tabletools.sources.staging import stage

QUARTILES = [0.25, 0.5, 0.75]
COLUMNS_PER_JOB = 12      # keeps each aggregate inside generated code
SUMS_PER_JOB = 40
NARROW_COLUMNS = 12       # above this, correlations come from products of column blocks

_SUMMARY_SCHEMA = ("column string, mean double, std double, min double, max double, "
                   "median double, skew double, kurtosis double, q25 double, q75 double, "
                   "non_null_count bigint")
_SUMMARY_METRICS = ("mean", "std", "min", "max", "median", "skew", "kurtosis", "q25", "q75")


class TableProfile:
    """Scalar facts about the columns of one table, each computed once, on first use.

    Every fact is an aggregate over the whole table; only one value per column (or pair of
    columns) comes back. Jobs read disjoint columns, so batching repeats no I/O.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.numeric = columns_of(df, NUMERIC)
        self.text = columns_of(df, CATEGORICAL)

    @cached_property
    def _basic(self) -> dict[str, dict]:
        facts: dict[str, dict] = {}
        rows = None
        for part in batches(self.df.columns, COLUMNS_PER_JOB):
            exprs = [F.count("*").alias("rows")]
            for i, c in enumerate(part):
                exprs.append(F.count_if(is_missing(self.df, c)).alias(f"m{i}"))
                if c in self.numeric:
                    v = number(self.df, c)
                    exprs += [F.avg(v).alias(f"a{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
            row = self.df.agg(*exprs).first().asDict()
            rows = row["rows"]
            for i, c in enumerate(part):
                facts[c] = {"missing": row[f"m{i}"], "n": rows - row[f"m{i}"]}
                if c in self.numeric:
                    facts[c] |= {"mean": row[f"a{i}"], "min": row[f"l{i}"], "max": row[f"h{i}"]}
        self._rows = rows
        return facts

    @property
    def rows(self) -> int:
        if not self.df.columns:
            return self.df.count()
        _ = self._basic
        return self._rows

    @property
    def missing(self) -> dict[str, int]:
        return {c: f["missing"] for c, f in self._basic.items()}

    def fact(self, column: str) -> dict:
        return self._basic[column]

    @cached_property
    def constant(self) -> set[str]:
        """The columns of numbers, texts, dates and booleans whose present values are all the same."""
        found = {c for c in self.filled_numeric if self._basic[c]["min"] == self._basic[c]["max"]}
        others = [c for c in columns_of(self.df, CATEGORICAL, DATETIME, BOOLEAN) if self._basic[c]["n"]]
        for part in batches(others, COLUMNS_PER_JOB):
            row = self.df.agg(*[(F.min(col(c)) == F.max(col(c))).alias(f"k{i}") for i, c in enumerate(part)]).first()
            found |= {c for c, same in zip(part, row) if same}
        return found

    @property
    def filled_numeric(self) -> list[str]:
        return [c for c in self.numeric if self._basic[c]["n"] > 0]

    @cached_property
    def power_sums(self) -> dict[str, tuple[float, float, float]]:
        """Sums of the 2nd to 4th power of (value - mean): second pass, so no cancellation."""
        sums = {}
        for part in batches(self.filled_numeric, COLUMNS_PER_JOB):
            exprs = []
            for i, c in enumerate(part):
                d = number(self.df, c) - F.lit(self._basic[c]["mean"])
                exprs += [F.sum(d * d).alias(f"a{i}"), F.sum(d * d * d).alias(f"b{i}"),
                          F.sum((d * d) * (d * d)).alias(f"c{i}")]
            row = self.df.agg(*exprs).first()
            for i, c in enumerate(part):
                sums[c] = tuple(row[3 * i:3 * i + 3])
        return sums

    @cached_property
    def quartiles(self) -> dict[str, dict[float, float]]:
        return column_quantiles(self.df, self.filled_numeric, QUARTILES)

    def moments(self, column: str) -> dict[str, float | None]:
        """std (n-1) and the bias-corrected skewness and excess kurtosis."""
        n = self._basic[column]["n"]
        s2, s3, s4 = self.power_sums[column]
        constant = self._basic[column]["min"] == self._basic[column]["max"]
        out = {"std": None, "skew": None, "kurtosis": None}
        if n > 1:
            out["std"] = 0.0 if constant else math.sqrt(s2 / (n - 1))
        if n > 2:
            out["skew"] = 0.0 if constant or not s2 else \
                math.sqrt(n * (n - 1)) / (n - 2) * (s3 / n) / (s2 / n) ** 1.5
        if n > 3:
            out["kurtosis"] = 0.0 if constant or not s2 else \
                (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((s4 / n) / (s2 / n) ** 2 - 3) + 6)
        return out

    @property
    def _by_column(self) -> bool:
        """Few columns, and few pairs with gaps: sums of pairs are plain aggregates, and correlations few enough for the driver."""
        cols = self.numeric
        if len(cols) > NARROW_COLUMNS:
            return False
        gaps = sum(self._basic[a]["missing"] > 0 or self._basic[b]["missing"] > 0 for i, a in enumerate(cols) for b in cols[i + 1:])
        return gaps <= SUMS_PER_JOB // 6      # six sums for such a pair: no more of them than one job takes

    @cached_property
    def correlations(self) -> DataFrame:
        """(a, b, r, ia, ib) of each pair a before b, over the rows where both are present; ia, ib: places of the columns."""
        cols = self.numeric
        schema = "a string, b string, r double, ia int, ib int"
        if len(cols) < 2:
            return self.df.sparkSession.createDataFrame([], schema)
        if not self._by_column:
            values = self.df.select(*[number(self.df, c).alias(f"c{i}") for i, c in enumerate(cols)])
            means, gaps = [self._basic[c]["mean"] or 0.0 for c in cols], [self._basic[c]["missing"] > 0 for c in cols]
            return stage(block_correlations(values, cols, means, gaps), "correlations")
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
        varied = {c for c in self.filled_numeric if self._basic[c]["min"] < self._basic[c]["max"]}
        sums = self._pair_sums_by_column([(a, b) for a, b in pairs if a in varied and b in varied])
        place = {c: i for i, c in enumerate(cols)}
        return self.df.sparkSession.createDataFrame(
            [(a, b, _pearson(*sums[a, b]) if (a, b) in sums else None, place[a], place[b]) for a, b in pairs], schema)

    def strong_pairs(self, threshold: float) -> list:
        """Pairs with |r| above the threshold, strongest first: as many as a text about them shows."""
        return _in_order(self.correlations.where(F.abs("r") > threshold)).collect()

    def _pair_sums_by_column(self, pairs):
        sums = {}
        full = {c for c in self.numeric if self._basic[c]["missing"] == 0}
        plain = [p for p in pairs if p[0] in full and p[1] in full]
        gaps = [p for p in pairs if p not in set(plain)]
        centred = {c: number(self.df, c) - F.lit(self._basic[c]["mean"]) for c in self.filled_numeric}
        for part in batches(plain, SUMS_PER_JOB):
            row = self.df.agg(*[F.sum(centred[a] * centred[b]).alias(f"s{i}")
                                for i, (a, b) in enumerate(part)]).first()
            for (a, b), s in zip(part, row):
                sums[a, b] = (self.rows, 0.0, 0.0, self.power_sums[a][0], self.power_sums[b][0], s)
        for part in batches(gaps, SUMS_PER_JOB // 6):
            exprs = []
            for i, (a, b) in enumerate(part):
                x, y = centred[a], centred[b]
                x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
                exprs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"x{i}"), F.sum(y).alias(f"y{i}"),
                          F.sum(x * x).alias(f"xx{i}"), F.sum(y * y).alias(f"yy{i}"),
                          F.sum(x * y).alias(f"xy{i}")]
            row = self.df.agg(*exprs).first()
            for i, p in enumerate(part):
                sums[p] = tuple(row[6 * i:6 * i + 6])
        return sums


def _pearson(n, x, y, xx, yy, xy) -> float | None:
    if not n or n < 2:
        return None
    var_x, var_y = xx - x * x / n, yy - y * y / n
    if var_x <= NOISE * xx or var_y <= NOISE * yy or var_x <= 0 or var_y <= 0:
        return None
    return max(-1.0, min(1.0, (xy - x * y / n) / (math.sqrt(var_x) * math.sqrt(var_y))))


def _profile(table) -> TableProfile:
    return table if isinstance(table, TableProfile) else TableProfile(table)


def _frame(p: TableProfile, rows, schema: str) -> DataFrame:
    return p.df.sparkSession.createDataFrame(rows, schema)


def table_shape(df) -> DataFrame:
    """(rows, columns)."""
    df = df.df if isinstance(df, TableProfile) else df
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def numeric_summary(df, decimals: int = 3) -> DataFrame:
    """Statistics per numeric column with at least one value, rounded."""
    p = _profile(df)
    rows = []
    for c in p.filled_numeric:
        f, q = p.fact(c), p.quartiles[c]
        stats = {"mean": f["mean"], "min": f["min"], "max": f["max"], "q25": q[0.25],
                 "median": q[0.5], "q75": q[0.75], **p.moments(c)}
        rows.append((c, *[stats[m] for m in _SUMMARY_METRICS], f["n"]))
    # the first rounding takes off the noise of a sum, so that halves round the same way
    return _frame(p, rows, _SUMMARY_SCHEMA).select(
        "column", *[F.round(F.round(m, 9), decimals).alias(m) for m in _SUMMARY_METRICS], "non_null_count")


def raw_numeric_summary(df) -> DataFrame:
    """The shorter statistics shown for a table before cleaning."""
    return numeric_summary(df).select(
        "column", "mean", "std", "min", "max", "median", "skew", "non_null_count")


def null_counts(df) -> DataFrame:
    """(column, n_null), zeros included."""
    p = _profile(df)
    return _frame(p, [(c, p.missing[c]) for c in p.df.columns], "column string, n_null bigint")


def missing_profile(df) -> DataFrame:
    """(column, n_null, pct) of the columns that have nulls, percent to one decimal."""
    p = _profile(df)
    rows = [(c, n, p.rows) for c, n in p.missing.items() if n > 0]
    return _frame(p, rows, "column string, n_null bigint, total bigint").select(
        "column", "n_null", F.round(100 * F.col("n_null") / F.col("total"), 1).alias("pct"))


def correlation_matrix(df) -> DataFrame:
    """(a, b, r) of each pair of numeric columns a before b; r is NULL where undefined."""
    return _profile(df).correlations.select("a", "b", "r")


def _strongest_first() -> list:
    """By |r| descending, then column order. Ranked at 12 digits, since the last bits of a sum depend on the order in which
    partitions are added."""
    return [F.desc(F.round(F.abs("r"), 12)), F.asc("ia"), F.asc("ib")]


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(*_strongest_first())


def correlation_pairs(df, threshold: float = K.CORRELATION_THRESHOLD) -> DataFrame:
    """(rank, a, b, r) of the pairs with |r| above the threshold, strongest first."""
    p = _profile(df)
    strong = p.correlations.where(F.abs("r") > threshold)
    ranked = strong.withColumn("rank", F.row_number().over(Window.orderBy(*_strongest_first()))) if len(p.numeric) <= NARROW_COLUMNS \
        else numbered(strong, _strongest_first(), "rank")
    return ranked.select("rank", "a", "b", F.round("r", 3).alias("r"))


def strongest_columns(df) -> tuple[str, str] | None:
    p = _profile(df)
    if len(p.numeric) < 2:
        return None
    first = _in_order(p.correlations.where("r IS NOT NULL")).limit(1).collect()
    return (first[0].a, first[0].b) if first and first[0].r != 0 else (p.numeric[0], p.numeric[1])


def strongest_pair(df) -> DataFrame:
    """(a, b): the pair with the largest |r|; the first two columns if there is none."""
    p = _profile(df)
    pair = strongest_columns(p)
    return _frame(p, [pair] if pair else [], "a string, b string")


def category_topk(df, k: int = K.TOP_CATEGORIES) -> DataFrame:
    """(column, value, n, rank): most frequent values per text column, ties by value."""
    p = _profile(df)
    return top_values(p.df, p.text, k)


def anomaly_flags(df, skew: float = K.SKEW_FLAG) -> DataFrame:
    """(column, flag): high_skew, constant, has_nulls."""
    p = _profile(df)
    rows = []
    for c in p.df.columns:
        f = p.fact(c)
        if c in p.filled_numeric:
            s = p.moments(c)["skew"]
            if s is not None and abs(s) > skew:
                rows.append((c, "high_skew"))
        if c in p.constant:
            rows.append((c, "constant"))
        if f["missing"]:
            rows.append((c, "has_nulls"))
    return _frame(p, rows, "column string, flag string")


def kpi_summary(df, metrics: dict[str, float] | None = None, max_metrics: int | None = None,
                max_correlations: int | None = None) -> DataFrame:
    """(seq, section, label, value): table size, model metrics, strong correlations; the first ones where a number is given."""
    p = _profile(df)
    facts = [("dataset", "Rows", f"{p.rows:,}"), ("dataset", "Columns", str(len(p.df.columns))),
             ("dataset", "Numeric Cols", str(len(p.filled_numeric))),
             ("dataset", "Missing Values", str(sum(p.missing.values())))]
    strong = [("correlation", f"{r.a}×{r.b}", f"{r.r:+.3f}") for r in p.strong_pairs(K.CORRELATION_THRESHOLD)]
    model = [("model", name, str(value), float(value) if isinstance(value, float) else None)
             for name, value in list((metrics or {}).items())[:max_metrics]]
    rows = [(i + 1, *r, None) for i, r in enumerate(facts)]
    rows += [(len(rows) + 1 + i, *r) for i, r in enumerate(model)]
    rows += [(len(rows) + 1 + i, *r, None) for i, r in enumerate(strong[:max_correlations])]
    named = _frame(p, rows, "seq int, section string, label string, value string, number double")
    label = F.when(F.col("section") == "model", F.upper(F.replace("label", F.lit("_"), F.lit(" ")))).otherwise(F.col("label"))
    shown = F.when(F.col("number").isNotNull(), F.format_string("%.4f", "number")).otherwise(F.col("value"))
    return named.select("seq", "section", label.alias("label"), shown.alias("value"))


@dataclass(frozen=True)
class Analytics:
    """The profile of one table, one small table per part."""
    shape: DataFrame
    numeric_summary: DataFrame
    correlations: DataFrame
    categories: DataFrame
    null_counts: DataFrame
    dtype_map: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def compute_analytics(df) -> Analytics:
    """All parts of the profile, from one shared set of column facts."""
    p = _profile(df)
    return Analytics(table_shape(p), numeric_summary(p), correlation_pairs(p), category_topk(p),
                     null_counts(p), dtype_map(p.df))


def raw_analytics(df) -> Analytics:
    """The same for a table before cleaning, with the shorter statistics."""
    p = _profile(df)
    return Analytics(table_shape(p), raw_numeric_summary(p), correlation_pairs(p), category_topk(p),
                     null_counts(p), dtype_map(p.df))


def profile_text(df, name: str) -> DataFrame:
    """(line_no, line): the profile of a table as text, from its per-column facts."""
    p = _profile(df)
    out = [K.CONTEXT_START.format(name=name), "",
           K.SHAPE_LINE.format(rows=p.rows, columns=len(p.df.columns)),
           K.COLUMNS_LINE.format(names=", ".join(p.df.columns)), "",
           K.TYPES_HEADING, *[f"  {c}: {t}" for c, t in p.df.dtypes], ""]
    out += [*_numeric_lines(p), "", *_missing_lines(p), "", *_correlation_lines(p), "", *_category_lines(p), "",
            K.CONTEXT_END]
    return _frame(p, [(i + 1, line) for i, line in enumerate(out)], "line_no int, line string")


def _shown(value: float | None, digits: int = 3) -> float:
    """A number as ``round`` in SQL shows it: halves of the decimal value go up."""
    if value is None or not math.isfinite(value):
        return math.nan if value is None else value
    return float(Decimal(repr(round(float(value), 9))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0


def _numeric_lines(p: TableProfile) -> list[str]:
    if not p.numeric:
        return [K.NUMERIC_NONE]
    lines = [K.NUMERIC_HEADING]
    for c in p.filled_numeric:
        stats = p.fact(c) | p.moments(c)
        shown = [f"{m}={_shown(stats[m])}" for m in ("mean", "std", "min", "max", "skew")]
        lines.append(f"  {c}: {' | '.join(shown)}")
    return lines


def _missing_lines(p: TableProfile) -> list[str]:
    found = [f"  {c}: {n} ({100 * n / p.rows:.1f}%)" for c, n in p.missing.items() if n]
    return [K.MISSING_HEADING, *found] if found else [K.MISSING_NONE]


def _correlation_lines(p: TableProfile) -> list[str]:
    if len(p.numeric) < 2:
        return [K.CORRELATIONS_TOO_FEW]
    found = [f"  {r.a} × {r.b}: r={_shown(r.r)}" for r in p.strong_pairs(K.CORRELATION_THRESHOLD)]
    if not found:
        return [K.CORRELATIONS_NONE.format(threshold=K.CORRELATION_THRESHOLD)]
    return [K.CORRELATIONS_HEADING.format(threshold=K.CORRELATION_THRESHOLD), *found]


def _category_lines(p: TableProfile) -> list[str]:
    if not p.text:
        return [K.CATEGORIES_NONE]
    top: dict[str, list[str]] = {c: [] for c in p.text}
    for r in sorted(category_topk(p).collect(), key=lambda r: r["rank"]):
        top[r["column"]].append(f"{r['value']!r}:{r['n']}")
    return [K.CATEGORIES_HEADING.format(k=K.TOP_CATEGORIES),
            *[f"  {c}: {', '.join(entries)}" for c, entries in top.items()]]
