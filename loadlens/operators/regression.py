"""Random-forest regression of one numeric column on the others (Spark ML).

Steps: choose target and candidate features from the schema; drop all-null,
single-valued and timestamp features (one aggregate pass); deterministic
80/20 split by a seeded hash of every column; numeric block = mean impute +
standardise; text block = most-frequent impute + one-hot (unseen -> all
zeros); forest, over cells of equal bins where rows share them
(``cell_forest``); test-part metrics; importances named from the assembler
metadata; an actual-vs-predicted sample and its least-squares trend line.

Scale notes: split and sample are functions of the seed and of each row's
values and number among its copies, so neither file splits, nor partitions,
nor the number of cores move a row; copies of one row are split individually.
The training rows are dealt by that hash to as many partitions as their number
asks for, so the forest's per-partition bagging does not depend on the cluster
either; MAX_PARTITIONS at most, since on every level each partition sends the
statistics of all open nodes, however few rows it has. The prepared frame is
persisted for the many passes of the fit, the predictions are written into the
shared folder.
Only bounded things reach the driver: one row of per-feature statistics, one
mode and one number of categories per text column, and the importance vector.
The labels of text features stay in a distributed dictionary (``encoding``).
"""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DoubleType, FloatType, NumericType, StringType,
                               TimestampNTZType, TimestampType)

from loadlens.operators import cell_forest
from loadlens.operators.encoding import BROADCAST_BYTES, SlotEncoder, category_counts, label_slots, slot_names, written
from loadlens.session import checkpoint_dir

log = logging.getLogger(__name__)

# fixed values: the original job's settings
SEED = 42
TRAIN_SHARE_TENTHS = 8          # 80 / 20 split
NUM_TREES = 100
DEFAULT_MAX_DEPTH = 10
SAMPLE_ROWS = 500
TOP_IMPORTANCES = 10
ROWS_PER_PARTITION = 40_000
MAX_PARTITIONS = 48             # of the forest's rows: bounds what a level shuffles
KEY_BYTES = 32                  # of a copy key in a broadcast
COPY_SALTS = 64                 # parts over which the copies of one row are numbered
NODE_STATS_MB = 1024            # statistics gathered in one pass over the data


def numeric_columns(df: DataFrame) -> list[str]:
    """Candidate targets: the numeric columns of the schema (P1)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def feature_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: non-null count, distinct-ness (min < max), type, and whether it is kept.

    One aggregate pass over the data (P2-P4); timestamps and dates are dropped by type.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(features):
        v = F.col(c)
        if isinstance(types[c], (DoubleType, FloatType)):
            v = F.when(~F.isnan(v), v)  # NaN is a missing value
        aggs += [F.count(v).alias(f"n{i}"), (F.min(v) < F.max(v)).alias(f"v{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"),
                     F.lit(types[c].simpleString()).alias("dtype"),
                     F.col(f"n{i}").alias("non_null"),
                     F.coalesce(F.col(f"v{i}"), F.lit(False)).alias("varies"),
                     F.lit(isinstance(types[c], (TimestampType, TimestampNTZType, DateType))).alias("is_time"))
            for i, c in enumerate(features)]
    prof = one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    kept = (F.col("non_null") > 0) & F.col("varies") & ~F.col("is_time")
    return prof.withColumn("kept", kept).orderBy("position")


ROW_HASH = "__row_hash"


def row_text(df: DataFrame, seed: int = SEED) -> Column:
    """The seed and the texts of all columns, each behind a separator; a null is a mark of its own."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in df.columns]
    return F.concat_ws("\x1f", F.lit(str(seed)), *cells)


def copy_key(df: DataFrame) -> Column:
    """A 64-bit number that rows of equal text share: numbers and days by value, other cells by text. Only a separator in
    a cell can make texts equal whose cells differ; rows with one share the number 0."""
    plain = (NumericType, BooleanType, DateType, TimestampNTZType)
    texts = [F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("\x1e")) for f in df.schema.fields
             if not isinstance(f.dataType, plain)]
    key = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, plain)], *texts, F.lit(0))
    for t in texts:
        key = F.when(t.contains("\x1f"), F.lit(0)).otherwise(key)
    return key


def repeated_keys(df: DataFrame) -> DataFrame:
    """The copy keys of more than one row, and the null-free column ``__key`` they stand in."""
    return df.select(copy_key(df).alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("__c")) \
        .filter("__c > 1").select("__key")


def with_row_hash(df: DataFrame, seed: int = SEED, repeated: DataFrame | None = None) -> DataFrame:
    """Add a 60-bit hash of the seed, all columns, and the row's number among its exact copies.

    It depends on nothing but the table's rows: not on files, partitions or cores; and as MD5 of texts it can be stated
    in any SQL. Copy keys are counted first (a partial aggregate of 8-byte keys, without texts): a row whose key is the only
    one has number 1 and is not moved at all where few rows have copies. The others are numbered by a window per distinct
    row in two steps, so that a row repeated billions of times is no single task's work: within a salt (the scan's own row
    ids spread it), then by the sizes of the salts before. Which copy has which number is immaterial.
    ``repeated``: ``repeated_keys(df)``, if it is at hand.
    """
    rows = df.withColumn("__key", copy_key(df))
    twice = repeated_keys(df) if repeated is None else repeated
    plain = F.md5(row_text(df, seed).cast("binary"))
    salted = rows.join(twice, "__key", "left_semi").withColumn("__plain", plain) \
        .withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(COPY_SALTS)))
    numbered = salted.withColumn("__n", F.row_number().over(
        Window.partitionBy("__plain", "__salt").orderBy(F.lit(1))))
    # both branches number the rows of one scan, whose splits are the same within a query
    before = Window.partitionBy("__plain").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("__plain", "__salt").agg(F.max("__n").alias("__c"))
    first = sizes.withColumn("__first", F.sum("__c").over(before)).filter("__first > 0").drop("__c")
    copies = numbered.join(first, ["__plain", "__salt"], "left") \
        .withColumn("__n", F.coalesce("__first", F.lit(0)) + F.col("__n"))
    alone = rows.join(twice, "__key", "left_anti").withColumn("__plain", plain).withColumn("__n", F.lit(1).cast("long"))
    own = F.md5(F.concat(F.col("__plain"), F.lit(":"), F.col("__n").cast("string")).cast("binary"))
    names = [F.col(f"`{c}`") for c in df.columns]
    return alone.select(*names, "__plain", "__n").unionByName(copies.select(*names, "__plain", "__n")) \
        .select(*names, F.conv(F.substring(own, 1, 15), 16, 10).cast("long").alias(ROW_HASH))


def in_training() -> Column:
    """True for the 80 % part, from the row hash (P5)."""
    return F.pmod(F.col(ROW_HASH), F.lit(10)) < TRAIN_SHARE_TENTHS


def text_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per text column (ties -> smallest value): one row per column.

    One scan: the columns are unpivoted to (feature, value), counted with a
    partial + final hash aggregate, and the winner per feature is
    ``min_by(value, (-count, value))``.
    """
    pairs = (df.select(*[F.col(c).cast("string").alias(c) for c in columns])
             .unpivot([], list(columns), "feature", "value").filter(F.col("value").isNotNull()))
    counts = pairs.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


@dataclass
class ForestRun:
    target: str
    numeric: list[str]
    text: list[str]
    dropped: list[str]
    model: PipelineModel
    train: DataFrame
    test: DataFrame
    predictions: DataFrame
    names: DataFrame
    n_train: int = 0

    @property
    def feature_names(self) -> list[str]:
        """The slot names in order, on the driver; for vectors of moderate size."""
        return [r["feature"] for r in self.names.orderBy("position").collect()]


def fit_forest(df: DataFrame, target: str, features: Sequence[str] | None = None, num_trees: int = NUM_TREES,
               max_depth: int = DEFAULT_MAX_DEPTH, max_categories: int | None = None,
               seed: int = SEED) -> ForestRun:
    """Fit the pipeline on the 80 % part and predict the 20 % part.

    ``max_depth``: the original job grows its trees without a limit; a tree of Spark's forest is built level by level,
    so its depth is a parameter (Spark allows up to 30).
    ``max_categories``: off by default (every category has its slot). If given, the categories of a text feature
    beyond the most frequent ones count as unseen (all zeros).
    """
    if target not in numeric_columns(df):
        raise ValueError(f"target {target!r} is not numeric")
    feats = [c for c in (features or df.columns) if c != target]
    types = {f.name: f.dataType for f in df.schema.fields}
    # One copy of the source: the candidate columns plus the split flag, dealt and ordered by the row hash, so every
    # partition holds the same rows in the same order wherever it runs. Profile, modes, pre-processing fits and the
    # per-level passes of the forest all read this copy.
    known = df.filter(F.col(target).isNotNull())
    repeated = repeated_keys(known).persist(StorageLevel.MEMORY_AND_DISK)
    small = repeated.count() * KEY_BYTES <= BROADCAST_BYTES
    parts = min(MAX_PARTITIONS, max(1, -(-known.count() // ROWS_PER_PARTITION)))
    base = (with_row_hash(known, seed, F.broadcast(repeated) if small else repeated).select(target, *feats, ROW_HASH, in_training().alias("__train"))
            .repartition(parts, ROW_HASH).sortWithinPartitions(ROW_HASH)
            .persist(StorageLevel.MEMORY_AND_DISK))
    phases: list[tuple[str, float]] = []
    t0 = time.perf_counter()

    def phase(name: str) -> None:
        nonlocal t0
        now = time.perf_counter()
        phases.append((name, round(now - t0, 3)))
        t0 = now

    try:
        prof = feature_profile(base, feats).collect()          # one row per feature (bounded)
        phase("scan+profile")
        kept = [r["feature"] for r in prof if r["kept"]]
        dropped = [r["feature"] for r in prof if not r["kept"]]
        # booleans pass through with the numbers (as 0 / 1)
        numeric = [c for c in kept if isinstance(types[c], (NumericType, BooleanType))]
        text = [c for c in kept if isinstance(types[c], StringType)]
        if not numeric and not text:
            raise ValueError("no usable feature left")

        cols = [target, *numeric, *text]
        typed = base.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) if c in numeric or c == target
                              else F.col(c) for c in cols], ROW_HASH, "__train")
        train = typed.filter("__train").drop("__train")
        test = typed.filter(~F.col("__train")).drop("__train")
        if text:
            # most-frequent imputation, modes learnt on the training part
            modes = {r["feature"]: r["mode"] for r in text_modes(train, text).collect()}   # one per column
            fill = {c: modes[c] for c in text if modes.get(c) is not None}
            train, test = train.na.fill(fill), test.na.fill(fill)
            if max_categories:
                train, test = _cap_categories(train, test, text, max_categories)
        slots, sizes = None, {}
        if text:
            slots = label_slots(train, text)
            sizes = category_counts(slots, text)
        phase("modes, slots")

        stages = []
        vec_inputs = []
        if numeric:
            imp = [f"{c}__imp" for c in numeric]
            stages += [Imputer(strategy="mean", inputCols=numeric, outputCols=imp),
                       VectorAssembler(inputCols=imp, outputCol="__num", handleInvalid="keep"),
                       StandardScaler(inputCol="__num", outputCol="__num_std", withMean=True, withStd=True)]
            vec_inputs.append("__num_std")
        if text:
            idx = [f"{c}__idx" for c in text]
            ohe = [f"{c}__ohe" for c in text]
            # the slot behind the last is for what training has not seen; dropLast removes it: all zeros
            stages.append(SlotEncoder(slots, sizes, lambda rows: _dealt(rows, parts)))
            stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
            vec_inputs += ohe
        stages.append(VectorAssembler(inputCols=vec_inputs, outputCol="features"))
        # node ids are cached between levels; a level's follow from the one before by a narrow step, so they need no
        # checkpoint (four bytes per row and tree)
        learner = RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="prediction",
                                        numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                        featureSubsetStrategy="all",
                                        cacheNodeIds=bool(checkpoint_dir(df.sparkSession)),
                                        checkpointInterval=-1, maxMemoryInMB=NODE_STATS_MB)
        n_train = train.count()
        if n_train < 2:
            raise ValueError(f"need at least 2 training rows, got {n_train}")
        before = Pipeline(stages=stages).fit(train)
        phase("features")
        encoded = before.transform(train)
        scaled = _scaled(before.stages[2], numeric) if numeric else []
        counts = {f"{c}__idx": sizes[c] for c in text}
        cells = cell_forest.plan(encoded, target, scaled, counts, ROW_HASH, n_train)
        phase("cells")
        if cells:
            forest = cell_forest.fit(cells, learner, len(numeric) + sum(sizes.values()))
        else:
            forest = learner.fit(encoded)
        model = PipelineModel(stages=[*before.stages, forest])
        phase("forest fit")
        # Every output (metrics, sample, trend) reads the test-part predictions: written once to the shared folder
        # while the persisted copy is there, so nothing stays cached and no executor is needed for them.
        if cells:
            tail = PipelineModel(stages=[*before.stages[-2 if text else -1:], forest])
            predicted, stayed = cell_forest.predict(cells, before.transform(test), scaled, list(counts), "__num_std", tail)
            predicted = predicted if stayed else _dealt(predicted, parts)
        else:
            predicted = model.transform(test)
        names = _slot_names(df.sparkSession, numeric, slots, sizes)
        preds = written(predicted.select(target, *numeric, *text, ROW_HASH, "prediction"), "predictions")
        phase("predict test part")
    finally:
        base.unpersist()
        repeated.unpersist()
    log.info("forest job phases (s): %s", phases)
    return ForestRun(target, numeric, text, dropped, model, train, test, preds, names, n_train)


def _cap_categories(train: DataFrame, test: DataFrame, text: Sequence[str], k: int):
    """On request: only the k most frequent categories of each text column stay, all others are null (the indexer's
    unseen category, all zeros). One job for all columns; at most k values of each reach the driver."""
    pairs = train.select(*text).unpivot([], list(text), "feature", "value").filter(F.col("value").isNotNull())
    best = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value").asc())
    top = pairs.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("feature", "value").collect()
    for c in text:
        kept = [r["value"] for r in top if r["feature"] == c]
        capped = F.when(F.col(c).isin(kept), F.col(c))
        train, test = train.withColumn(c, capped), test.withColumn(c, capped)
    return train, test


def _scaled(scaler, numeric: Sequence[str]) -> list[Column]:
    """What the scaler makes of the imputed columns, as columns instead of a vector: the same operations on doubles."""
    factors = [1.0 / s if s != 0.0 else 0.0 for s in scaler.std]
    return [(F.col(f"`{c}__imp`") - F.lit(float(m))) * F.lit(float(f)) for c, m, f in zip(numeric, scaler.mean, factors)]


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """Rows in the order that the row hash gives, wherever a join has left them."""
    if ROW_HASH not in df.columns:
        return df
    return df.repartition(parts, ROW_HASH).sortWithinPartitions(ROW_HASH)


def _slot_names(spark, numeric: Sequence[str], slots: DataFrame | None, sizes: dict[str, int]) -> DataFrame:
    """position, feature: the numeric columns come first, then the one-hot slots as ``column=category``."""
    names = spark.createDataFrame([(i, c) for i, c in enumerate(numeric)], "position long, feature string")
    return names if slots is None else names.unionByName(slot_names(slots, sizes, len(numeric)))


def metrics(run: ForestRun) -> DataFrame:
    """Test-part R^2, MAE and trend line, with the training-part size (P5, P11, P14)."""
    return regression_metrics(run.predictions, run.target, "prediction").withColumn("n_train", F.lit(run.n_train))


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per numeric feature, one aggregate pass, long form (feature, mean, std).

    Spark's scaler divides by the sample deviation; the ratio is the same for all rows of a feature, so the forest's
    splits are the same."""
    one = df.agg(*[F.struct(F.lit(c).alias("feature"), F.avg(F.col(c)).alias("mean"),
                            F.stddev_pop(F.col(c)).alias("std")).alias(f"s{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")).select("s.*")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: n, R^2 (1 - SSres/SStot about the actual mean), MAE, trend slope / intercept (P11, P14)."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    # one aggregate pass: SS_tot = n * var_pop(y), so no separate mean is needed
    return df.agg(
        F.count(F.lit(1)).alias("n_test"),
        (F.lit(1.0) - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.regr_slope(p, y).alias("trend_slope"),
        F.regr_intercept(p, y).alias("trend_intercept"),
    )


def importances(run: ForestRun, top: int | None = TOP_IMPORTANCES) -> DataFrame:
    """Feature importances with names, largest first, top ``top`` (P12; ``None`` = all).

    The names are joined to the vector's positions; a position without a name is ``feature_<i>``.
    """
    forest = run.model.stages[-1]
    imp = forest.featureImportances.toArray().tolist()        # one entry per feature slot
    spark = run.predictions.sparkSession
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(imp)], "position long, importance double")
    df = values.join(run.names, "position", "left").select(
        F.coalesce("feature", F.concat(F.lit("feature_"), "position")).alias("feature"), "importance")
    ranked = df.orderBy(F.col("importance").desc(), F.col("feature").asc())
    return ranked.limit(top) if top else ranked


def sample_rows(test: DataFrame, actual: str, predicted: str, n: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``n`` (actual, predicted) rows, those with the smallest seeded row hash (P13): a k-row top-k.

    Copies of one row have different hashes, so a hot group of copies takes its fair share of the sample.
    """
    return (test.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), ROW_HASH)
            .orderBy(ROW_HASH, "actual", "predicted").limit(n).drop(ROW_HASH))


def actual_vs_predicted_sample(run: ForestRun, n: int = SAMPLE_ROWS) -> DataFrame:
    """The plotted sample of the test part."""
    return sample_rows(run.predictions, run.target, "prediction", n)


def sample_trend(run: ForestRun, n: int = SAMPLE_ROWS) -> DataFrame:
    """Least-squares line predicted ~ actual over the plotted sample (P14): one row."""
    smp = actual_vs_predicted_sample(run, n)
    return smp.agg(F.count(F.lit(1)).alias("n_points"),
                   F.regr_slope("predicted", "actual").alias("trend_slope"),
                   F.regr_intercept("predicted", "actual").alias("trend_intercept"))
