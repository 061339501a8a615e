"""Cleaning by fixed rules: duplicates, missing values, outliers, dates in text.

``fit_cleaning`` runs the aggregates that decide what to do; the model it returns turns
them into one projection, so cleaning the table itself needs no shuffle after dedup.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletools import constants as K
from tabletools.functions.kinds import (
    BOOLEAN, CATEGORICAL, DATETIME, NUMERIC, batches, col, columns_of, nan_to_null, number)
from tabletools.functions.quantiles import cells_of_value, column_quantiles
from tabletools.functions.values import top_values
from tabletools.operators.profile import COLUMNS_PER_JOB, TableProfile
from tabletools.sources.staging import stage

BROADCAST_FINGERPRINTS = 1_000_000     # 8 bytes each


# -- duplicates -------------------------------------------------------------------------

def _fingerprint(df: DataFrame) -> Column:
    return F.xxhash64(*[col(c) for c in df.columns])


def _repeated_fingerprints(df: DataFrame) -> tuple[DataFrame, int]:
    """Fingerprints seen more than once, and their number.

    Only 8-byte fingerprints are shuffled, counted per partition first. Equal rows have
    equal fingerprints, so a row outside this set is known to be unique.
    """
    repeated = df.select(_fingerprint(df).alias("_print")).groupBy("_print").count() \
        .where("count > 1").select("_print")
    repeated = stage(repeated, "repeated-fingerprints")     # grouped once, then counted and joined
    return repeated, repeated.count()


def _split_suspects(df: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("_print", _fingerprint(df))
    keys = F.broadcast(repeated)
    return (marked.join(keys, "_print", "left_anti").drop("_print"),
            marked.join(keys, "_print", "left_semi").drop("_print"))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows.

    With few repeated fingerprints only the rows that carry one are compared in full; the
    rest of the table passes through unshuffled.
    """
    repeated, n = _repeated_fingerprints(df)
    if n == 0:
        return df
    if n > BROADCAST_FINGERPRINTS:
        return df.dropDuplicates()
    unique, suspects = _split_suspects(df, repeated)
    return unique.union(suspects.dropDuplicates())


def duplicate_count(df: DataFrame) -> DataFrame:
    """(n_duplicates): rows that repeat another row in full, all but one of each."""
    repeated, n = _repeated_fingerprints(df)
    suspects = _split_suspects(df, repeated)[1] if n <= BROADCAST_FINGERPRINTS else df
    groups = suspects.groupBy(*[col(c) for c in df.columns]).agg((F.count("*") - 1).alias("_extra"))
    return groups.agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("n_duplicates"))


# -- missing values ---------------------------------------------------------------------

def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_null, pct_null as a share), one row per column."""
    p = TableProfile(df)
    rows = [(c, n, n / p.rows if p.rows else 0.0) for c, n in p.missing.items()]
    return df.sparkSession.createDataFrame(rows, "column string, n_null bigint, pct_null double")


def _sparse(p: TableProfile, threshold: float) -> list[str]:
    return [c for c, n in p.missing.items() if n and n / p.rows > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = K.SPARSE_THRESHOLD) -> DataFrame:
    """Without the columns whose null share is above the threshold (at it, they stay)."""
    sparse = set(_sparse(TableProfile(df), threshold))
    return df.select(*[col(c) for c in df.columns if c not in sparse])


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """{column: most frequent value as text}, ties to the smallest; no entry if all null."""
    return {r["column"]: r["value"] for r in top_values(df, columns, 1).collect()}


def _fillable(df: DataFrame, columns: list[str] | None, *kinds: str) -> list[str]:
    chosen = df.columns if columns is None else columns
    return [c for c in columns_of(df, *kinds) if c in chosen]


def _median_expr(df: DataFrame, column: str, median: float | None) -> Column:
    return F.coalesce(number(df, column), F.lit(median).cast("double"))


def _mode_expr(df: DataFrame, column: str, mode: str | None) -> Column:
    dtype = df.schema[column].dataType
    if mode is None:
        mode = K.FILL_WORD if column in columns_of(df, CATEGORICAL) else None
    return F.coalesce(col(column), F.lit(mode).cast(dtype))


def _rewrite(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.select(*[exprs.get(c, col(c)).alias(c) for c in df.columns])


def _with_gaps(df: DataFrame, columns: list[str]) -> list[str]:
    if not columns:
        return []
    missing = TableProfile(df.select(*[col(c) for c in columns])).missing
    return [c for c in columns if missing[c]]


def fill_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing numbers become the column median; filled columns become double."""
    gaps = _with_gaps(df, _fillable(df, columns, NUMERIC))
    medians = column_quantiles(df, gaps, [0.5])
    return _rewrite(df, {c: _median_expr(df, c, medians[c][0.5]) for c in gaps})


def fill_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Other missing values become the most frequent value; "Unknown" in an all-null text."""
    gaps = _with_gaps(df, _fillable(df, columns, CATEGORICAL, BOOLEAN, DATETIME))
    modes = column_modes(df, gaps)
    return _rewrite(df, {c: _mode_expr(df, c, modes.get(c)) for c in gaps})


# -- outliers ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Fence:
    q1: float
    q3: float
    iqr: float
    lower: float
    upper: float


def _fences(df: DataFrame, k: float = K.IQR_MULTIPLIER, cells: DataFrame | None = None) -> dict[str, Fence]:
    found = {}
    for c, q in column_quantiles(df, columns_of(df, NUMERIC), [0.25, 0.75], cells).items():
        q1, q3 = q[0.25], q[0.75]
        if q1 is not None and q3 != q1:
            iqr = q3 - q1
            found[c] = Fence(q1, q3, iqr, q1 - k * iqr, q3 + k * iqr)
    return found


def iqr_fences(df: DataFrame, k: float = K.IQR_MULTIPLIER) -> DataFrame:
    """(column, q1, q3, iqr, lower, upper) of the numeric columns with a positive IQR."""
    rows = [(c, f.q1, f.q3, f.iqr, f.lower, f.upper) for c, f in _fences(df, k).items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, q3 double, iqr double, lower double, upper double")


def _as_fences(fences: DataFrame | dict[str, Fence]) -> dict[str, Fence]:
    if isinstance(fences, dict):
        return fences
    return {r["column"]: Fence(r.q1, r.q3, r.iqr, r.lower, r.upper) for r in fences.collect()}


def _count_outliers(df: DataFrame, fences: dict[str, Fence]) -> dict[str, int]:
    counts = {}
    for part in batches([c for c in fences if c in df.columns], 2 * COLUMNS_PER_JOB):
        row = df.agg(*[
            F.count_if((number(df, c) < fences[c].lower) | (number(df, c) > fences[c].upper)).alias(f"n{i}")
            for i, c in enumerate(part)]).first()
        counts.update(zip(part, row))
    return counts


def outlier_counts(df: DataFrame, fences) -> DataFrame:
    """(column, n_outliers): values strictly outside the fence."""
    return df.sparkSession.createDataFrame(
        list(_count_outliers(df, _as_fences(fences)).items()), "column string, n_outliers bigint")


def _clip_expr(value: Column, fence: Fence) -> Column:
    # least and greatest skip NULL, hence the guard
    return F.when(value.isNotNull(), F.greatest(F.lit(fence.lower), F.least(value, F.lit(fence.upper))))


def clip_outliers(df: DataFrame, fences) -> DataFrame:
    """Values outside the fence become the fence; only clipped columns change to double."""
    fences = _as_fences(fences)
    hit = [c for c, n in _count_outliers(df, fences).items() if n]
    return _rewrite(df, {c: _clip_expr(number(df, c), fences[c]) for c in hit})


# -- dates ------------------------------------------------------------------------------

def _pattern_rates(df: DataFrame, order_by: list[str] | None = None, sample: int = K.DATE_SAMPLE_SIZE) -> dict[str, float | None]:
    texts = columns_of(df, CATEGORICAL)
    rates = {}
    if order_by and texts:
        keys = [f"_k{i}" for i in range(len(order_by))]
        cells = df.select(*[col(c).alias(k) for c, k in zip(order_by, keys)], *[col(c) for c in texts]) \
            .unpivot(keys, [col(c) for c in texts], "column", "value").where("value IS NOT NULL")
        place = F.row_number().over(Window.partitionBy("column").orderBy(*keys))
        # each task passes on its own first ``sample`` texts per column only
        first = cells.withColumn("place", place).where(F.col("place") <= sample)
        found = first.groupBy("column").agg(F.avg(F.col("value").rlike(K.DATE_PATTERN).cast("int")).alias("rate"))
        return dict.fromkeys(texts) | {r["column"]: r.rate for r in found.collect()}
    for part in batches(texts, COLUMNS_PER_JOB):
        row = df.agg(*[F.avg(col(c).rlike(K.DATE_PATTERN).cast("int")).alias(f"r{i}")
                       for i, c in enumerate(part)]).first()
        rates.update(zip(part, row))
    return rates


def date_pattern_rate(df: DataFrame, order_by: list[str] | None = None,
                      sample: int = K.DATE_SAMPLE_SIZE) -> DataFrame:
    """(column, match_rate) per text column: share of texts that start like a date.

    With ``order_by`` over the first ``sample`` non-null texts in that order, without it
    over the whole column. NULL for a column without values.
    """
    return df.sparkSession.createDataFrame(
        list(_pattern_rates(df, order_by, sample).items()), "column string, match_rate double")


def _date_formats(df: DataFrame, rates: dict[str, float | None]) -> dict[str, str]:
    """{column: format} of the columns to parse: per column the format that parses most."""
    candidates = [c for c, r in rates.items() if r is not None and r >= K.DATE_MATCH_THRESHOLD]
    if not candidates:
        return {}
    # no text has the shape of two formats, so each is parsed once, and one pass serves all columns
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("text")) for i, c in enumerate(candidates)])
    reads = F.coalesce(*[F.when(_date_expr(F.col("text"), f).isNotNull(), j) for j, f in enumerate(K.DATE_FORMATS)])
    cells = df.select(F.explode(cells).alias("cell")).select("cell.*")
    counts: dict[int, dict] = {}
    for r in cells.groupBy("i", F.col("text").isNull().alias("missing"), reads.alias("format")).count().collect():
        counts.setdefault(r["i"], {})[r["missing"], r["format"]] = r["count"]
    chosen = {}
    for i, c in enumerate(candidates):
        parsed = {j: n for (_, j), n in counts[i].items() if j is not None}
        best = min(parsed, key=lambda j: (-parsed[j], j), default=0)
        failed = sum(n for (missing, _), n in counts[i].items() if not missing) - parsed.get(best, 0)
        if failed / max(sum(counts[i].values()), 1) < K.DATE_FAILURE_LIMIT:
            chosen[c] = list(K.DATE_FORMATS)[best]
    return chosen


def _date_expr(column: Column, fmt: str) -> Column:
    # the shape first: a text that fails to parse costs an exception
    return F.when(column.rlike(K.DATE_FORMATS[fmt]), F.try_to_timestamp(column, F.lit(fmt)))


def parse_datetimes(df: DataFrame) -> DataFrame:
    """Text columns that hold dates become timestamps; texts in another format become NULL. All texts of a column decide."""
    formats = _date_formats(df, _pattern_rates(df))
    return _rewrite(df, {c: _date_expr(col(c), f) for c, f in formats.items()})


# -- all rules in order -----------------------------------------------------------------

@dataclass
class CleaningModel:
    """What the rules decided for one table; scalars per column, and the deduplicated table."""
    source: DataFrame
    rows: int
    rows_removed: int
    missing: dict[str, int]
    dropped: list[str]
    medians: dict[str, float]
    modes: dict[str, str | None]
    fences: dict[str, Fence] = field(default_factory=dict)
    outliers: dict[str, int] = field(default_factory=dict)
    rates: dict[str, float | None] = field(default_factory=dict)
    formats: dict[str, str] = field(default_factory=dict)

    def _filled(self, df: DataFrame) -> DataFrame:
        df = nan_to_null(df.select(*[col(c) for c in df.columns if c not in self.dropped]))
        return _rewrite(df, {c: _median_expr(df, c, v) for c, v in self.medians.items()}
                        | {c: _mode_expr(df, c, v) for c, v in self.modes.items()})

    def transform(self, df: DataFrame, dedup: bool = True) -> DataFrame:
        """Apply the fitted rules. Without ``dedup`` this is one projection and also takes a stream."""
        if dedup:
            df = drop_exact_duplicates(df)
        df = self._filled(df)
        return _rewrite(
            df,
            {c: _clip_expr(number(df, c), self.fences[c]) for c, n in self.outliers.items() if n}
            | {c: _date_expr(col(c), f) for c, f in self.formats.items()})

    def cleaned(self) -> DataFrame:
        """The fitted table itself, cleaned."""
        return self.transform(self.source, dedup=False)


def fit_cleaning(df: DataFrame, distinct: bool = False, cells: DataFrame | None = None) -> CleaningModel:
    """Decide all rules for this table.

    A table with duplicates is staged once after dedup, since every later job reads it; a
    table without any is read in place, as is one known to be ``distinct``. ``cells``: the digits of its numbers, if they are counted already.
    """
    source = df if distinct else drop_exact_duplicates(df)
    if source is not df:
        source = stage(source, "deduplicated")
    p = TableProfile(source)
    rows, missing = p.rows, p.missing
    removed = 0 if source is df else df.count() - rows
    dropped = _sparse(p, K.SPARSE_THRESHOLD)
    gaps = [c for c, n in missing.items() if n and c not in dropped]
    numeric = [c for c in gaps if c in p.numeric]
    others = [c for c in gaps if c in columns_of(source, CATEGORICAL, BOOLEAN, DATETIME)]
    modes = column_modes(source, others)
    model = CleaningModel(
        source, rows, removed, missing, dropped,
        medians={c: q[0.5] for c, q in column_quantiles(source, numeric, [0.5], cells).items()},
        modes={c: modes.get(c) for c in others})
    filled = model._filled(source)
    if cells is not None:              # a gap that is filled is one more row with the median
        cells = cells.unionByName(cells_of_value(df, {c: (m, missing[c]) for c, m in model.medians.items() if m is not None}))
    model.fences = _fences(filled, cells=cells)
    model.outliers = _count_outliers(filled, model.fences)
    model.rates = _pattern_rates(filled)
    model.formats = _date_formats(filled, model.rates)
    return model


def cleaning_report(model: CleaningModel) -> DataFrame:
    """(seq, kind, column, message, amount): issues and actions in order, then four counters."""
    rows: list[tuple] = []

    def say(kind, column, text, amount, **values):
        rows.append((len(rows) + 1, kind, column, text.format(column=column, n=amount, **values), amount))

    removed = model.rows_removed
    if removed:
        say("issue", None, K.DUPLICATES_ISSUE, removed)
        say("action", None, K.DUPLICATES_ACTION, removed, s="s" if removed > 1 else "")
    filled = 0
    for c, n in model.missing.items():
        share = n / model.rows if model.rows else 0.0
        if c in model.dropped:
            say("issue", c, K.SPARSE_ISSUE, n, share=share)
            say("action", c, K.SPARSE_ACTION, n, share=share)
        elif c in model.medians or c in model.modes:
            filled += n
            say("issue", c, K.MISSING_ISSUE, n, share=share)
            if c in model.medians:
                say("action", c, K.MEDIAN_ACTION, n, value=round(model.medians[c], 4))
            else:
                mode = K.FILL_WORD if model.modes[c] is None else model.modes[c]
                boolean = c in columns_of(model.source, BOOLEAN)
                say("action", c, K.MODE_ACTION, n, value=mode == "true" if boolean else mode)
    for c, n in model.outliers.items():
        if n:
            fence = model.fences[c]
            say("issue", c, K.OUTLIER_ISSUE, n)
            say("action", c, K.OUTLIER_ACTION, n, lower=round(fence.lower, 3), upper=round(fence.upper, 3))
    for c in model.formats:
        say("action", c, K.DATE_ACTION, 1, share=model.rates[c])
    counters = (removed, len(model.dropped), filled, sum(model.outliers.values()))
    for name, amount in zip(K.SUMMARY_COUNTERS, counters):
        rows.append((len(rows) + 1, "summary", None, name, amount))
    return model.source.sparkSession.createDataFrame(
        rows, "seq int, kind string, column string, message string, amount bigint")


def run_cleaning(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned table, cleaning report)."""
    model = fit_cleaning(df)
    return model.cleaned(), cleaning_report(model)
