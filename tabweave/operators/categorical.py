"""Categorical features and encoders."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.lookup import Lookup, attach, measure
from tabweave.operators.profile import ColumnProfile, profile
from tabweave.operators.prune import drop_columns
from tabweave.plans.roles import Roles, col, string_columns
from tabweave.session import materialize

RARE_DISTINCT_ABOVE = 10
TARGET_ENCODE_ABOVE = 10
ONE_HOT_UP_TO = 15
SCORING_ONE_HOT_UP_TO = 10
MAX_CLASSES = 10_000
INLINE_CLASSES = 200


def category_statistics(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """Rows ``(i, value, n[, total])`` for every value of every column, in one scan.

    Counts and target sums combine map-side, so hot values cost one row per task.
    """
    y = [] if target is None else [col(target).cast("double").alias("y")]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("value")) for i, c in enumerate(columns)])
    flat = df.select(*y, F.inline(cells)).where("value is not null")
    aggs = [F.count(F.lit(1)).alias("n")]
    if target is not None:
        aggs.append(F.avg("y").alias("mean"))
    return flat.groupBy("i", "value").agg(*aggs)


def fit_lookups(df: DataFrame, columns: list[str], target: str | None = None) -> dict[str, Lookup]:
    """Statistics of each column, stored once in the shared folder and measured."""
    if not columns:
        return {}
    return measure(materialize(category_statistics(df, columns, target), "category-statistics"), columns)


def fold_statistics(df: DataFrame, columns: list[str], target: str, fold: Column) -> DataFrame:
    """Rows ``(i, value, n, mean, total, known, folds)`` for every value of every column, in one scan of ``df``.

    ``known`` and ``total`` count and sum the target; ``folds`` maps a fold to the (known, total) of its rows. Rows combine map-side by
    (value, fold), so neither a hot value nor its folds meet as rows.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("value")) for i, c in enumerate(columns)])
    flat = df.select(col(target).cast("double").alias("y"), fold.cast("int").alias("fold"), F.inline(cells)).where("value is not null")
    by_fold = flat.groupBy("i", "value", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count("y").alias("known"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("total")
    )
    own = F.struct("fold", F.struct("known", "total").alias("of"))
    folds = F.map_from_entries(F.filter(F.collect_list(own), lambda e: e["fold"].isNotNull()))  # an entry a fold at most
    out = by_fold.groupBy("i", "value").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("total").alias("total"), folds.alias("folds"))
    return out.select("i", "value", "n", F.try_divide("total", "known").alias("mean"), "total", "known", "folds")


def frequency_features(df: DataFrame, lookups: dict[str, Lookup], rare: list[str], drop: bool = False) -> DataFrame:
    """``{c}_freq``, the count of the row's value, and for ``rare`` columns ``{c}_is_rare``.

    ``is_rare`` is 1 for every value but the single most common one, and for null.
    """
    for c, lookup in lookups.items():
        out: dict[str, Column] = {f"{c}_freq": F.col("__n").cast("double")}
        if c in rare:
            out[f"{c}_is_rare"] = F.when(col(c).eqNullSafe(F.lit(lookup.top)), 0).otherwise(1)
        df = attach(df, c, lookup, out, drop_key=drop)
    return df


def frequency_encode(df: DataFrame, lookups: dict[str, Lookup], suffix: str = "_freq") -> DataFrame:
    """Replace each column by the count of its value; unseen values get null."""
    for c, lookup in lookups.items():
        made = f"{c}{suffix}"
        out = {} if made in df.columns else {made: F.col("__n").cast("double")}
        df = attach(df, c, lookup, out, drop_key=True) if out else drop_columns(df, [c])
    return df


def target_encode(df: DataFrame, lookups: dict[str, Lookup], overall: float | None) -> DataFrame:
    """Replace each column by the training mean of the target for its value, else the overall mean."""
    for c, lookup in lookups.items():
        mean = F.coalesce(F.col("__mean"), F.lit(overall).cast("double"))
        df = attach(df, c, lookup, {f"{c}_target_encoded": mean}, drop_key=True)
    return df


def fold_means(df: DataFrame, target: str, fold: Column) -> dict[int, float | None]:
    """For each fold the mean of the target over the rows of all other folds."""
    y = col(target).cast("double")
    rows = df.select(fold.cast("int").alias("fold"), y.alias("y")).groupBy("fold").agg(F.count("y").alias("n"), F.sum("y").alias("s")).collect()
    n, total = sum(r["n"] for r in rows), sum(r["s"] or 0.0 for r in rows)
    return {r["fold"]: (total - (r["s"] or 0.0)) / (n - r["n"]) if n > r["n"] else None for r in rows}


def target_encode_folds(df: DataFrame, lookups: dict[str, Lookup], fold: Column, means: dict[int, float | None], overall: float | None) -> DataFrame:
    """Replace each column by the mean of the target for its value over all folds but the row's own.

    A value that only the row's own fold has gets the mean over the other folds; a row without a fold gets the value's mean over all.
    """
    known = [(k, v) for k, v in means.items() if k is not None and v is not None]
    rest = F.create_map(*[F.lit(x).cast(t) for k, v in known for x, t in ((k, "int"), (v, "double"))]) if known else None
    df = df.withColumn("__fold", fold.cast("int"))
    outside = F.coalesce(F.try_element_at(rest, F.col("__fold")) if rest is not None else F.lit(None), F.lit(overall)).cast("double")
    for c, lookup in lookups.items():
        own = F.try_element_at(F.col("__folds"), F.col("__fold"))
        n = F.col("__known") - F.coalesce(own["known"], F.lit(0))
        mean = F.when(n > 0, (F.col("__total") - F.coalesce(own["total"], F.lit(0.0))) / n)
        df = attach(df, c, lookup, {f"{c}_target_encoded": F.coalesce(mean, outside)}, drop_key=True)
    return df.drop("__fold")


def one_hot(df: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """Replace each column by a 0/1 column per listed value, in sorted order; others get all 0."""
    out = [col(c) for c in df.columns if c not in values]
    for c, listed in values.items():
        if c not in df.columns:
            out += [F.lit(0).alias(f"{c}_{v}") for v in sorted(listed)]
            continue
        out += [F.coalesce((col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in sorted(listed)]
    return df.select(*out)


def distinct_values(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Values of columns already known to have few of them."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(columns)])
    out: dict[str, list[str]] = {c: [] for c in columns}
    for row in df.select(F.inline(cells)).where("v is not null").distinct().collect():
        out[columns[row["i"]]].append(row["v"])
    return {c: sorted(v) for c, v in out.items()}


def fit_encoders(
    df: DataFrame, roles: Roles, profiles: dict[str, ColumnProfile] | None = None, exact: bool = True, fold: Column | None = None
) -> tuple[dict, dict[str, Lookup]]:
    """Choose an encoder per string column by its distinct count.

    Above 10 values with a target: target mean. Otherwise up to 15: one-hot. Otherwise: count. With ``fold``, a row's fold number, the
    lookups of target means also say what each fold adds, for :func:`apply_encoders`.
    """
    columns = string_columns(df, roles.features(df))
    profiles = profiles or profile(df, columns, exact=exact)
    has_target = roles.target is not None and roles.target in df.columns
    by_target = [c for c in columns if has_target and profiles[c].distinct > TARGET_ENCODE_ABOVE]
    by_dummies = [c for c in columns if c not in by_target and profiles[c].distinct <= ONE_HOT_UP_TO]
    by_count = [c for c in columns if c not in by_target and c not in by_dummies]
    if fold is None:
        lookups = fit_lookups(df, by_target, roles.target)
    else:
        lookups = measure(materialize(fold_statistics(df, by_target, roles.target, fold), "fold-statistics"), by_target) if by_target else {}
    lookups |= fit_lookups(df, by_count)
    overall = df.agg(F.avg(col(roles.target).cast("double"))).first()[0] if by_target else None
    spec = {
        "op": "encode",
        "target": by_target,
        "one_hot": distinct_values(df, by_dummies),
        "count": by_count,
        "overall": overall,
    }
    return spec, lookups


def apply_encoders(df: DataFrame, spec: dict, lookups: dict[str, Lookup], fold: Column | None = None, target: str | None = None) -> DataFrame:
    """Encode by fitted statistics; training rows, with their ``fold`` and ``target``, by those of the other folds."""
    means = {c: lookups[c] for c in spec["target"]}
    if fold is None or not means:
        df = target_encode(df, means, spec["overall"])
    else:
        df = target_encode_folds(df, means, fold, fold_means(df, target, fold), spec["overall"])
    df = one_hot(df, spec["one_hot"])
    return frequency_encode(df, {c: lookups[c] for c in spec["count"]})


def without_folds(lookups: dict[str, Lookup]) -> dict[str, Lookup]:
    """The lookups as scoring needs them: totals only."""
    return {c: replace(v, table=v.table.drop("total", "known", "folds")) for c, v in lookups.items()}


def dummy_names(spec: dict) -> list[str]:
    return [f"{c}_{v}" for c, values in spec["one_hot"].items() for v in sorted(values)]


def encode_adhoc(df: DataFrame, roles: Roles, drop: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """Encode a frame from its own values: one-hot up to 10 values, else ``{c}_freq_encoded``."""
    df = drop_columns(df, [c for c in drop if c not in roles.keep])
    columns = string_columns(df, roles.features(df))
    profiles = profile(df, columns, exact=exact)
    dummies = [c for c in columns if profiles[c].distinct <= SCORING_ONE_HOT_UP_TO]
    counted = [c for c in columns if c not in dummies]
    out = one_hot(df, distinct_values(df, dummies))
    return frequency_encode(out, fit_lookups(df, counted), suffix="_freq_encoded")


def fit_labels(df: DataFrame, target: str) -> list:
    """Sorted classes of the target; the count is checked before they are read."""
    classes = df.select(col(target).alias("y")).where("y is not null").distinct().limit(MAX_CLASSES + 1).collect()
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"target '{target}' has more than {MAX_CLASSES} classes; is it a regression target?")
    return sorted(r["y"] for r in classes)


def encode_labels(df: DataFrame, target: str, classes: list, unseen_to_first: bool = False) -> DataFrame:
    """Replace labels by their position in ``classes``; unseen ones by null, or by the first class. Null stays null."""
    if len(classes) <= INLINE_CLASSES:
        at = F.array_position(F.array(*[F.lit(c) for c in classes]), col(target))
        missing = F.lit(0.0) if unseen_to_first else F.lit(None).cast("double")
        found = F.when(col(target).isNotNull(), F.when(at > 0, (at - 1).cast("double")).otherwise(missing))
        return df.select(*[found.alias(c) if c == target else col(c) for c in df.columns])
    spark = df.sparkSession
    kind = df.schema[target].dataType.simpleString()
    table = spark.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], f"__label {kind}, __code double")
    code = F.coalesce(F.col("__code"), F.when(col(target).isNotNull(), 0.0)) if unseen_to_first else F.col("__code")
    joined = df.join(F.broadcast(table), col(target) == F.col("__label"), "left")
    return joined.select(*[code.alias(c) if c == target else col(c) for c in df.columns])


def decode_labels(c: Column, classes: list) -> Column:
    """The class at a predicted position."""
    return F.element_at(F.array(*[F.lit(v) for v in classes]), c.cast("int") + 1)
