"""The fitted feature plan: plain data, replayed unchanged on any frame."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import PCAModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.operators import categorical, dates, missing, numeric, pca, prune, scaling, selection
from tabweave.operators.lookup import Lookup
from tabweave.operators.profile import NEAR, SURELY_NEAR, ColumnProfile, profile
from tabweave.plans.roles import KEPT_TARGET, Roles, col, is_numeric, is_string, normalize, numeric_columns, string_columns
from tabweave.session import materialize


@dataclass
class FeaturePlan:
    """Every decision taken on the training rows.

    ``steps`` is JSON. Per-value statistics too large for it are ``lookups``, tables of their own,
    and the principal components are a Spark model.
    """

    roles: Roles
    task: str
    steps: dict = field(default_factory=dict)
    lookups: dict[str, Lookup] = field(default_factory=dict)
    components: PCAModel | None = None

    @property
    def features(self) -> list[str]:
        return self.steps["features"]

    @property
    def classes(self) -> list | None:
        return self.steps.get("classes")

    def _of(self, kind: str) -> dict[str, Lookup]:
        return {name.split(":", 1)[1]: v for name, v in self.lookups.items() if name.startswith(kind + ":")}

    def _construct(self, df: DataFrame) -> DataFrame:
        """Constructed features, with any name made once."""
        steps = self.steps
        if "numeric" in steps:
            df = prune.drop_duplicate_names(numeric.apply_numeric(df, steps["numeric"]))
        if "rare" in steps:
            df = categorical.frequency_features(df, self._of("freq"), steps["rare"])
        return prune.drop_duplicate_names(dates.apply_dates(df, steps["dates"]))

    def encode_target(self, df: DataFrame) -> DataFrame:
        """Labels as class positions; a label not seen in training becomes the first class."""
        if self.classes is None or self.roles.target not in df.columns:
            return df
        return categorical.encode_labels(df, self.roles.target, self.classes, unseen_to_first=True)

    def conform_raw(self, df: DataFrame) -> DataFrame:
        """The raw columns of training in their types; absent ones are null, or 0 if the plan fills nothing, others go.

        Values that the type can't hold become null. Kept, target, text and late columns stay as they are; a target that is
        also kept is carried along unencoded.
        """
        raw, roles = self.steps["raw"], self.roles
        others = {*roles.keep, *roles.text, *self.steps["late"], roles.target}
        out = [col(c) for c in df.columns if c in others and c != KEPT_TARGET]
        for name, kind in raw.items():
            if name in df.columns:
                same = df.schema[name].dataType.simpleString() == kind
                out.append(col(name) if same else col(name).try_cast(kind).alias(name))
            else:
                zero = "missing" not in self.steps and is_numeric(T.DataType.fromDDL(kind))
                out.append((F.lit(0) if zero else F.lit(None)).cast(kind).alias(name))
        if roles.target in roles.keep and roles.target in df.columns:
            out.append(col(roles.target).alias(KEPT_TARGET))
        return df.select(*out)

    def transform(self, df: DataFrame) -> DataFrame:
        """Kept columns, the target if present, then the plan's features in order."""
        steps = self.steps
        df = self.encode_target(normalize(self.conform_raw(df), self.roles))
        df = self._construct(booleans_to_numbers(df, self.roles))
        df = prune.drop_columns(df, steps["pruned"])
        if "missing" in steps:
            df = missing.apply_missing(df, steps["missing"])
        if "encode" in steps:
            df = categorical.apply_encoders(df, steps["encode"], self._of("encode"))
        df = prune.conform(df, steps["selected"], self.roles)
        return self._finish(df)

    def _finish(self, df: DataFrame) -> DataFrame:
        df = scaling.apply_scale(df, self.steps["scale"])
        if self.components is not None:
            df = pca.apply_pca(df, self.steps["pca"], self.components)
        return prune.conform(df, self.features, self.roles)

    def vectorize(self, df: DataFrame, vectors: tuple[str, ...] = (), output: str = "features") -> DataFrame:
        """Add the model matrix: the plan's features and any vector columns, as one vector."""
        names = [f"__f{i}" for i in range(len(self.features))]
        wide = df.select("*", *[col(c).cast("double").alias(n) for c, n in zip(self.features, names)])
        made = VectorAssembler(inputCols=[*names, *vectors], outputCol=output, handleInvalid="keep").transform(wide)
        return made.drop(*names)

    def to_json(self) -> str:
        data = {
            "roles": self.roles.to_dict(),
            "task": self.task,
            "steps": self.steps,
            "lookups": {k: v.sizes() for k, v in self.lookups.items()},
            "has_components": self.components is not None,
        }
        return json.dumps(data, ensure_ascii=False)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")
        for i, name in enumerate(sorted(self.lookups)):
            self.lookups[name].table.write.mode("overwrite").parquet(f"{path}/lookup-{i}")
        if self.components is not None:
            self.components.write().overwrite().save(f"{path}/components")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeaturePlan:
        data = json.loads(spark.read.text(f"{path}/plan").first()[0])
        lookups = {
            name: Lookup(spark.read.parquet(f"{path}/lookup-{i}"), **data["lookups"][name])
            for i, name in enumerate(sorted(data["lookups"]))
        }
        components = PCAModel.load(f"{path}/components") if data["has_components"] else None
        return cls(Roles.from_dict(data["roles"]), data["task"], data["steps"], lookups, components)


def booleans_to_numbers(df: DataFrame, roles: Roles) -> DataFrame:
    flags = [c for c in roles.features(df) if isinstance(df.schema[c].dataType, T.BooleanType)]
    return df.select(*[col(c).cast("int").alias(c) if c in flags else col(c) for c in df.columns])


def _needed_lookups(plan: FeaturePlan) -> None:
    """Forget per-value tables whose columns were pruned, so that scoring does not join them."""
    used = set(plan.steps["selected"])
    encode = plan.steps.get("encode", {"target": [], "count": [], "one_hot": {}})

    def wanted(name: str) -> bool:
        kind, c = name.split(":", 1)
        if kind == "freq":
            made = {f"{c}_freq", f"{c}_is_rare", f"{c}_freq_is_missing"}
        else:
            made = {f"{c}_target_encoded", f"{c}_freq"}
        return bool(made & used)

    plan.lookups = {k: v for k, v in plan.lookups.items() if wanted(k)}
    if "encode" in plan.steps:
        kept = plan._of("encode")
        dropped = [c for c in (*encode["target"], *encode["count"]) if c not in kept]
        plan.steps["encode"] = encode | {
            "target": [c for c in encode["target"] if c in kept],
            "count": [c for c in encode["count"] if c in kept],
        }
        plan.steps["pruned"] = sorted({*plan.steps["pruned"], *dropped})


def fit_plan(
    df: DataFrame,
    roles: Roles,
    task: str,
    feature_engineering: bool = True,
    handle_missing: bool = True,
    encode_categorical: bool = True,
    exact: bool = True,
    late: tuple[str, ...] = (),
    partitions: int | None = None,
    target_folds: int = 0,
) -> tuple[FeaturePlan, DataFrame]:
    """Fit all steps in order and return the plan with the transformed training rows.

    ``partitions``, if given, is how many pieces the training rows are dealt into first, for tables in few files; results
    don't depend on it. With ``target_folds``, training rows get target means of the other folds, dealt by a hash of their
    columns without the target; rows to score get those of all. ``late`` names numeric columns, such as text statistics, that join after encoding. The
    encoded frame is written once to the shared folder: later statistics and every search fit
    read it instead of deriving it again.
    """
    if task not in ("classification", "regression"):
        raise ValueError(f"unsupported task type: {task}")
    if roles.target is not None and roles.target not in df.columns:
        raise ValueError(f"target column '{roles.target}' not found; available columns: {df.columns}")
    plan = FeaturePlan(roles, task)
    steps = plan.steps
    df = normalize(df, roles)
    if partitions is not None:
        df = materialize(df.repartition(partitions), "training-rows")
    steps["late"] = list(late)
    steps["raw"] = {c: df.schema[c].dataType.simpleString() for c in roles.features(df) if c not in late}
    named = roles.target is not None and not is_numeric(df.schema[roles.target].dataType)
    if roles.target is not None:
        df = df.where(col(roles.target).isNotNull())
        if task == "classification":
            steps["classes"] = categorical.fit_labels(df, roles.target)
        elif is_string(df.schema[roles.target].dataType):
            raise TypeError(f"target '{roles.target}' is a string; regression needs numbers")
    flags = [c for c in roles.features(df) if isinstance(df.schema[c].dataType, T.BooleanType)]
    df = booleans_to_numbers(plan.encode_target(df), roles)
    early = Roles(roles.target, (*roles.keep, *late, *flags), roles.text)
    # only decisions hang on these profiles: what is near a limit is counted, exactly
    near = SURELY_NEAR if exact else NEAR
    pairs: dict[str, ColumnProfile] = {}

    if feature_engineering:
        names = [c for c in early.features(df) if c in numeric_columns(df) or c in string_columns(df)]
        found = profile(df, names, near=near)
        numbers = {c: found[c] for c in numeric_columns(df, names)}
        steps["numeric"] = numeric.fit_numeric(df, early, numbers, exact, named)
        steps["numeric"]["pairs"], pairs = numeric.fit_pairs(df, steps["numeric"]["columns"], prune.prune_reason)
        strings = string_columns(df, names)
        plan.lookups |= {f"freq:{c}": v for c, v in categorical.fit_lookups(df, strings).items()}
        steps["rare"] = [c for c in strings if found[c].distinct > categorical.RARE_DISTINCT_ABOVE]
        steps["dates"] = dates.fit_dates(df, early)
    else:
        native = [c for c in early.features(df) if c not in numeric_columns(df) and c not in string_columns(df)]
        steps["dates"] = {"op": "dates", "columns": native, "parts": []}
    df = plan._construct(df)

    found = profile(df, [c for c in early.features(df) if c not in pairs], moments=False, near=near) | pairs
    reasons = prune.fit_prune(found)
    steps["reasons"] = reasons
    steps["pruned"] = sorted(reasons)
    df = prune.drop_columns(df, reasons)
    if handle_missing:
        shares = {c: p.null_share for c, p in found.items()}  # dropped pair features are no columns
        steps["missing"] = missing.fit_missing(df, early, exact, shares)
        df = missing.apply_missing(df, steps["missing"])
    if encode_categorical:
        fold = None
        if target_folds and roles.target is not None:
            seen = [col(c) for c in df.columns if c not in (roles.target, KEPT_TARGET)]
            fold = F.pmod(F.xxhash64(*seen), F.lit(target_folds))
        steps["encode"], lookups = categorical.fit_encoders(df, early, exact=exact, fold=fold)
        plan.lookups |= {f"encode:{c}": v for c, v in categorical.without_folds(lookups).items()}
        if fold is not None:
            df = df.withColumn("__fold_of_row", fold)
            fold = F.col("__fold_of_row")
        df = categorical.apply_encoders(df, steps["encode"], lookups, fold, roles.target).drop("__fold_of_row")
        dummies = categorical.dummy_names(steps["encode"])
    else:
        df = prune.drop_columns(df, string_columns(df, early.features(df)))
        dummies = []
    dummies = [c for c in df.columns if c in dummies or c in flags]
    df = materialize(df, "encoded")

    numbers = [c for c in numeric_columns(df, roles.features(df)) if c not in dummies]
    gone = selection.fit_correlation_prune(df, numbers)
    steps["decorrelated"] = gone
    numbers = [c for c in numbers if c not in gone]
    if roles.target is not None:
        chosen = selection.fit_select(df, numbers, dummies, roles.target, task)
        leaks = set(prune.leaking_columns(chosen, roles.target))
        steps["leaks"] = sorted(leaks)
        chosen = [c for c in chosen if c not in leaks]
    else:
        chosen = [*numbers, *dummies]
    if not chosen and not roles.text:
        raise ValueError("no features available for training")
    steps["selected"] = chosen
    numbers = [c for c in numbers if c in chosen]
    df = prune.conform(df, chosen, roles)
    if handle_missing:
        filled = steps["missing"]["fill"]
        whole = [c for c in found if c in numbers and c not in filled]
        steps["missing"]["fill"] = filled | missing.spare_medians(df, whole)
    steps["scale"] = scaling.fit_scale(df, numbers, "standard" if task == "classification" else "minmax")
    steps["features"] = chosen
    if len(numbers) > pca.PCA_ABOVE:
        scaled = scaling.apply_scale(df, steps["scale"])
        steps["pca"], plan.components = pca.fit_pca(scaled, numbers)
        made = [f"PC{i + 1}" for i in range(len(steps["pca"]["signs"]))]
        steps["features"] = [*made, *[c for c in chosen if c not in numbers]]
    _needed_lookups(plan)
    return plan, plan._finish(df)
