"""Baseline model: feature choice, encoding, split, random forest, held-out metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabletools import constants as K
from tabletools.functions.joins import BROADCAST_ROWS, fits_broadcast, join_group_facts
from tabletools.functions.kinds import BOOLEAN, CATEGORICAL, NUMERIC, batches, col, columns_of, kind_of
from tabletools.functions.values import distinct_counts
from tabletools.operators.cleaning import fill_median
from tabletools.operators.forest import Forest, fit_forest
from tabletools.operators.profile import COLUMNS_PER_JOB, TableProfile
from tabletools.sources.staging import stage

MISSING_LABEL = "nan"
_SIZE = "_rows_of_class"
SORT_ROWS = 100_000   # rows one task may sort
SKETCH_MARGIN = 4     # an estimate this many times over the limit is surely over it


# -- features ---------------------------------------------------------------------------

def feature_columns(df: DataFrame, target: str) -> DataFrame:
    """(column, kind, used, reason): all columns but the target, without datetimes and booleans."""
    rows = []
    if target not in df.columns:
        rows.append((target, None, False, "unknown target"))
    else:
        for f in df.schema.fields:
            kind = kind_of(f.dataType)
            used = f.name != target and kind in (NUMERIC, CATEGORICAL)
            rows.append((f.name, kind, used, None if used else "target" if f.name == target else kind))
    return df.sparkSession.createDataFrame(rows, "column string, kind string, used boolean, reason string")


def _small_cardinalities(df: DataFrame, columns: list[str], max_cardinality: int) -> dict[str, int | None]:
    """Exact distinct counts up to the limit, None above. A sketch first rules out columns
    that are far over it, so their values are never shuffled."""
    estimates = {}
    for part in batches(columns, COLUMNS_PER_JOB):
        row = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(part)]).first()
        estimates.update(zip(part, row))
    near = [c for c in columns if estimates[c] <= SKETCH_MARGIN * max_cardinality]
    exact = distinct_counts(df, near)
    return {c: n if c in near and (n := exact[c]) <= max_cardinality else None for c in columns}


def cardinality_gate(df: DataFrame, max_cardinality: int = K.MAX_CARDINALITY) -> DataFrame:
    """(column, n_distinct, kept) per text column; n_distinct is exact, whatever the limit."""
    found = distinct_counts(df, columns_of(df, CATEGORICAL))
    return df.sparkSession.createDataFrame(
        [(c, n, n <= max_cardinality) for c, n in found.items()],
        "column string, n_distinct bigint, kept boolean")


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text values become their index in sorted order, a missing one counts as the text "nan".

    Any number of values: the classes of a column are a staged table, joined by broadcast if a count shows that they
    are few, else by shuffles, with the rows of a value that many rows have spread over several tasks.
    """
    encoded = df.withColumn("_spread", F.xxhash64(*[col(c) for c in df.columns]))
    for i, c in enumerate(columns):
        key, label = f"_class{i}", f"_label{i}"
        named = F.coalesce(col(c), F.lit(MISSING_LABEL)).alias(key)
        index = _counted_index(df.select(named), key).withColumnRenamed("label", label)
        encoded = join_group_facts(encoded.withColumn(key, named), index, [key], "_spread", "left", size=_SIZE).drop(key, _SIZE)
    labels = {c: F.col(f"_label{i}").cast("bigint") for i, c in enumerate(columns)}
    return encoded.select(*[labels.get(c, col(c)).alias(c) for c in df.columns])


def fill_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing feature values become the column median."""
    return fill_median(df, columns)


def prepare_features(df: DataFrame, target: str, max_cardinality: int = K.MAX_CARDINALITY
                     ) -> tuple[DataFrame, list[str], list[str]]:
    """(table with encoded and filled features, feature names, text columns left out for having more than
    ``max_cardinality`` values); no names if none is usable."""
    if target not in df.columns:
        return df, [], []
    rest = df.drop(target)
    sizes = _small_cardinalities(rest, columns_of(rest, CATEGORICAL), max_cardinality)
    kept, left_out = [c for c, n in sizes.items() if n is not None], [c for c, n in sizes.items() if n is None]
    numbers = TableProfile(rest.select(*[col(c) for c in columns_of(rest, NUMERIC)])).filled_numeric
    features = [c for c in rest.columns if c in kept or c in numbers]
    if not features:
        return df, [], left_out
    encoded = label_encode(df, kept) if kept else df
    return fill_features(encoded, numbers), features, left_out


# -- split ------------------------------------------------------------------------------

def _row_hash(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def mark_test_rows(df: DataFrame, keys: Sequence[str], test: float = K.TEST_SHARE,
                   seed: int = K.SEED, exact: bool = False) -> DataFrame:
    """The table with ``is_test``, decided per row by a hash of its keys.

    Raises without keys, as all rows would share a hash. The same rows whatever the partitioning. By default the share is met in expectation;
    ``exact`` takes the ceil(share * n) rows with the smallest hash, by selecting the
    cutoff, not by sorting the table.
    """
    if not keys:
        raise ValueError("A split needs the keys that tell rows apart.")
    digest = _row_hash(keys, seed)
    if not exact:
        cutoff = f"{int(test * 2 ** 32):08x}"
        return df.withColumn("is_test", F.substring(digest, 1, 8) < F.lit(cutoff))
    last = _last_test_digest(df.select(digest.alias("digest")), test)
    return df.withColumn("is_test", digest <= F.lit(last) if last else F.lit(False))


def _last_test_digest(digests: DataFrame, test: float) -> str | None:
    """The hash at rank ceil(share * n): counts per prefix tell where it lies, three hex digits
    at a time, until so few rows share the prefix that they can be sorted."""
    prefix, wanted = "", None
    while True:
        inside = digests.where(F.startswith("digest", F.lit(prefix)))
        counts = dict(inside.groupBy(F.substring("digest", 1, len(prefix) + 3)).count().collect())
        if wanted is None:
            wanted = math.ceil(round(test * sum(counts.values()), 6))
            if wanted == 0:
                return None
        for prefix in sorted(counts):
            if wanted <= counts[prefix]:
                break
            wanted -= counts[prefix]
        if counts[prefix] <= SORT_ROWS or len(prefix) >= 32:
            return inside.where(F.startswith("digest", F.lit(prefix))).orderBy("digest").limit(wanted) \
                .agg(F.max("digest")).first()[0] if len(prefix) < 32 else prefix


def train_test_split(df: DataFrame, keys: Sequence[str], test: float = K.TEST_SHARE,
                     seed: int = K.SEED, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test)."""
    marked = mark_test_rows(df, keys, test, seed, exact)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


# -- target classes ---------------------------------------------------------------------

def class_index(train: DataFrame, target: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """(target, label): the classes of the training rows, numbered in sorted order."""
    return _counted_index(train, target, bound).drop(_SIZE)


def _counted_index(train: DataFrame, target: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """(target, number of rows, label)."""
    classes = stage(train.select(col(target)).where(col(target).isNotNull()).groupBy(col(target)).agg(F.count("*").alias(_SIZE)), "classes")
    if fits_broadcast(classes, bound):
        return classes.withColumn("label", F.row_number().over(Window.orderBy(col(target))) - 1)
    return stage(_numbered(classes, target), "class-index")


def _numbered(classes: DataFrame, target: str) -> DataFrame:
    """The classes with ``label`` for any number of distinct values: ranges of them are numbered apart, after the count of all before."""
    ranges = stage(classes.repartitionByRange(col(target)).withColumn("_range", F.spark_partition_id()), "class-ranges")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)      # a row per range
    before = ranges.groupBy("_range").agg(F.count("*").alias("_n")) \
        .select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(col(target)))
    return ranges.join(F.broadcast(before), "_range").select(col(target), _SIZE, (F.col("_before") + place - 1).alias("label"))


def encode_target(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``label``; a test class unseen in training counts as class 0."""
    index = _counted_index(train, target)

    def encode(part: DataFrame) -> DataFrame:
        spread = F.xxhash64(*[col(c) for c in part.columns])
        joined = join_group_facts(part.withColumn("_spread", spread), index, [target], "_spread", "left", size=_SIZE)
        return joined.select(*[col(c) for c in part.columns],
                             F.coalesce("label", F.lit(0)).cast("double").alias("label"))

    return encode(train), encode(test)


# -- forests ----------------------------------------------------------------------------

def n_classes(train: DataFrame, label: str) -> int:
    """Number of classes in a column of labels 0, 1, ..."""
    return int(train.agg(F.max(label)).first()[0]) + 1


def forest_classify(train: DataFrame, features: list[str], label: str = "label", trees: int = K.TREES,
                    depth: int | None = None, seed: int = K.SEED, classes: int | None = None) -> Forest:
    """Random forest over all classes found in ``label`` (0, 1, ...), grown until leaves are pure unless ``depth`` limits it. A node
    tries about the square root of the number of features."""
    classes = max(classes or n_classes(train, label), 2)
    return fit_forest(train, features, label, classes, trees, seed, max(1, math.isqrt(len(features))), depth)


def forest_regress(train: DataFrame, features: list[str], label: str, trees: int = K.TREES,
                   depth: int | None = None, seed: int = K.SEED) -> Forest:
    """Random forest on a numeric target, grown like that for classes, all features tried at each split."""
    if kind_of(train.schema[label].dataType) not in (NUMERIC, BOOLEAN):
        raise ValueError(K.NOT_NUMERIC.format(column=label))
    return fit_forest(train, features, label, 0, trees, seed, len(features), depth)


def feature_importances(model: Forest, k: int = K.TOP_FEATURES,
                        names: list[str] | None = None) -> DataFrame:
    """(feature, importance) of the k most important features."""
    rows = zip(names or model.features, model.importances.tolist())
    top = sorted(rows, key=lambda pair: -pair[1])[:k]
    return SparkSession.active().createDataFrame(top, "feature string, importance double") \
        .withColumn("importance", F.round("importance", 4))


# -- metrics ----------------------------------------------------------------------------

def accuracy(pred: DataFrame, y: str, yhat: str) -> DataFrame:
    """(accuracy): share of equal labels."""
    return pred.agg(F.round(F.avg((col(y) == col(yhat)).cast("int")), 4).alias("accuracy"))


def _per_class(pred: DataFrame, y: str, yhat: str) -> DataFrame:
    """(label, support, guessed, hits) from the counts per pair of labels."""
    guess = col(yhat).cast(pred.schema[y].dataType)
    cells = pred.groupBy(col(y).alias("y"), guess.alias("yhat")).agg(F.count("*").alias("n"))
    hits, none = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0), F.lit(0).cast("bigint")
    sides = F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("support"), none.alias("guessed"), hits.alias("hits")),
                    F.struct(F.col("yhat").alias("label"), none.alias("support"), F.col("n").alias("guessed"), none.alias("hits")))
    return cells.select(F.explode(sides).alias("s")).groupBy(F.col("s.label").alias("label")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("support", "guessed", "hits")])


def _f1(n_classes: int) -> Column:
    f1 = 2 * F.col("hits") / (F.col("support") + F.col("guessed"))
    score = F.max(F.when(F.col("label") == 1, f1)) if n_classes == 2 \
        else F.try_divide(F.sum(f1 * F.col("support")), F.sum("support"))
    return F.round(F.coalesce(score, F.lit(0.0)), 4).alias("f1_score")


def f1_score(pred: DataFrame, y: str, yhat: str, n_classes: int) -> DataFrame:
    """(f1_score): F1 of class 1 for two classes, else weighted by support; 0 where undefined."""
    return _per_class(pred, y, yhat).agg(_f1(n_classes))


def classification_metrics(pred: DataFrame, y: str, yhat: str, n_classes: int) -> DataFrame:
    """(accuracy, f1_score) in one pass over the predictions."""
    hit_rate = F.round(F.try_divide(F.sum("hits"), F.sum("support")), 4)
    return _per_class(pred, y, yhat).agg(hit_rate.alias("accuracy"), _f1(n_classes))


def _regression_sums(pred: DataFrame, y: str, yhat: str) -> DataFrame:
    actual = col(y).cast("double")
    error = actual - col(yhat).cast("double")
    return pred.agg(F.sum(error * error).alias("residual"), F.count(error).alias("n"),
                    (F.var_pop(actual) * F.count(actual)).alias("total"))


def _rmse() -> Column:
    return F.round(F.sqrt(F.try_divide("residual", "n")), 4).alias("rmse")


def _r2() -> Column:
    r2 = F.when(F.col("total") > 0, 1 - F.try_divide("residual", "total")) \
        .when(F.col("residual") == 0, 1.0).when(F.col("residual").isNotNull(), 0.0)
    return F.round(r2, 4).alias("r2_score")


def rmse(pred: DataFrame, y: str, yhat: str) -> DataFrame:
    """(rmse): root of the mean squared error."""
    return _regression_sums(pred, y, yhat).select(_rmse())


def r2_score(pred: DataFrame, y: str, yhat: str) -> DataFrame:
    """(r2_score): 1 - squared error / squared deviation; a constant target gives 1 or 0."""
    return _regression_sums(pred, y, yhat).select(_r2())


def regression_metrics(pred: DataFrame, y: str, yhat: str) -> DataFrame:
    """(rmse, r2_score) in one pass over the predictions."""
    return _regression_sums(pred, y, yhat).select(_rmse(), _r2())


# -- the whole baseline -----------------------------------------------------------------

_RESULT = ("task_type string, target_column string, model string, train_samples bigint, "
           "test_samples bigint, accuracy double, f1_score double, rmse double, r2_score double, "
           "skipped boolean, error string, left_out string")
_IMPORTANCES = "feature string, importance double"


def run_automl(df: DataFrame, target: str | None, task: str | None, keys: Sequence[str] = (),
               trees: int = K.TREES, depth: int | None = None, exact_split: bool = False,
               max_cardinality: int = K.MAX_CARDINALITY) -> tuple[DataFrame, DataFrame]:
    """(one-row result, importances). What the data does not allow becomes an ``error`` value; a lost executor or a full memory
    stays an exception. Without keys all columns tell rows apart. ``left_out`` names the text columns
    with more than ``max_cardinality`` values, which are no features."""
    spark = df.sparkSession
    result = {"task_type": task, "target_column": target, "model": "RandomForest",
              "train_samples": 0, "test_samples": 0, "skipped": not (target and task)}
    importances = spark.createDataFrame([], _IMPORTANCES)
    if not result["skipped"]:
        try:
            importances = _train(df, target, task, keys or df.columns, trees, depth, exact_split, max_cardinality, result)
        except (AnalysisException, IllegalArgumentException, ValueError) as error:
            result["error"] = f"{type(error).__name__}: {error}"
    names = [part.split()[0] for part in _RESULT.split(", ")]
    return spark.createDataFrame([tuple(result.get(n) for n in names)], _RESULT), importances


def _train(df, target, task, keys, trees, depth, exact_split, max_cardinality, result) -> DataFrame:
    spark = df.sparkSession
    empty = spark.createDataFrame([], _IMPORTANCES)
    table, features, left_out = prepare_features(df, target, max_cardinality)
    result["left_out"] = ", ".join(left_out) or None
    if not features:
        result["error"] = K.NO_FEATURES
        return empty
    rows = df.limit(K.MIN_ROWS).count()
    if rows < K.MIN_ROWS:
        result["error"] = K.TOO_FEW_ROWS.format(n=rows)
        return empty
    inputs = [f"f{i}" for i in range(len(features))]     # plain names, whatever the table calls them
    narrow = mark_test_rows(table, keys, exact=exact_split).select(
        *[col(c).cast("double").alias(i) for c, i in zip(features, inputs)],
        col(target).alias("target"), "is_test")
    narrow = stage(narrow, "training")      # read once per step from here on
    train, test = narrow.where(~F.col("is_test")), narrow.where("is_test")
    sizes = narrow.agg(F.count_if(~F.col("is_test")), F.count_if("is_test"),
                       F.count_if(F.col("target").isNull())).first()
    result["train_samples"], result["test_samples"] = sizes[0], sizes[1]
    if task != "classification" and kind_of(df.schema[target].dataType) not in (NUMERIC, BOOLEAN):
        result["error"] = K.NOT_NUMERIC.format(column=target)
        return empty
    if sizes[2]:
        result["error"] = f"Target column '{target}' has {sizes[2]} missing values."
        return empty
    if task == "classification":
        train, test = encode_target(train, test, "target")
        classes = n_classes(train, "label")
        model = forest_classify(train, inputs, "label", trees, depth, classes=classes)
        pred = model.transform(test).select("label", "prediction")
        result |= classification_metrics(pred, "label", "prediction", classes).first().asDict()
    else:
        model = forest_regress(train, inputs, "target", trees, depth)
        pred = model.transform(test).select("target", "prediction")
        result |= regression_metrics(pred, "target", "prediction").first().asDict()
    return feature_importances(model, names=features)
