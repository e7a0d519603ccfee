"""Column pruning, feature alignment and the split into features and target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.profile import NEAR_UNIQUE, ColumnProfile
from tabweave.plans.roles import KEPT_TARGET, Roles, col

MOSTLY_NULL = 0.5


def prune_reason(p: ColumnProfile) -> str | None:
    """Why a column goes, by the first rule that applies, or ``None`` when it stays."""
    if p.distinct == p.rows:
        return "all_unique"
    if p.distinct <= 1:
        return "constant"
    if p.null_share > MOSTLY_NULL:
        return "mostly_null"
    if p.distinct / p.rows > NEAR_UNIQUE:
        return "near_unique"
    return None


def fit_prune(profiles: dict[str, ColumnProfile]) -> dict[str, str]:
    """Columns to drop, each with its reason."""
    reasons = {c: prune_reason(p) for c, p in profiles.items()}
    return {c: r for c, r in reasons.items() if r}


def drop_columns(df: DataFrame, names) -> DataFrame:
    gone = set(names)
    return df.select(*[col(c) for c in df.columns if c not in gone])


def drop_duplicate_names(df: DataFrame) -> DataFrame:
    """Keep the first of columns with equal names."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    first = {}
    for i, name in enumerate(names):
        first.setdefault(name, i)
    return numbered.select(*[F.col(f"c{i}").alias(name) for name, i in first.items()])


def leaking_columns(columns: list[str], target: str) -> list[str]:
    """Columns whose name contains the target's name."""
    return [c for c in columns if c != target and target in c]


def drop_leaks(df: DataFrame, roles: Roles) -> DataFrame:
    return drop_columns(df, leaking_columns(df.columns, roles.target)) if roles.target else df


def conform(df: DataFrame, features: list[str], roles: Roles) -> DataFrame:
    """The given features in order, absent ones as 0, then kept columns and the target if present."""
    present = set(df.columns)
    out = [col(c) if c in present else F.lit(0.0).alias(c) for c in features]
    tail = [c for c in dict.fromkeys((*roles.keep, roles.target, KEPT_TARGET)) if c in present and c not in features]
    return df.select(*out, *[col(c) for c in tail])


def align(train: DataFrame, test: DataFrame, roles: Roles) -> tuple[DataFrame, DataFrame, list[str]]:
    """Give both frames the training features: shared ones first, then those the test lacks."""
    have, other = roles.features(train), set(roles.features(test))
    features = [c for c in have if c in other] + [c for c in have if c not in other]
    return conform(train, features, roles), conform(test, features, roles), features


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """The frame without the target, and the target alone."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found; available columns: {df.columns}")
    return drop_columns(df, [target]), df.select(col(target))
