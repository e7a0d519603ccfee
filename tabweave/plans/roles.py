"""Column roles and the type classes that operators dispatch on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Carries a target that is also kept, as it was given, past the encoding of labels.
KEPT_TARGET = "__kept_target"
DATE_KEYWORDS = ("date", "time", "year", "month", "day")


def col(name: str) -> Column:
    """Column by exact name; one-hot names may hold dots and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Roles:
    """Which column is the target, which pass through untouched, which hold prose."""

    target: str | None = None
    keep: tuple[str, ...] = ()
    text: tuple[str, ...] = ()

    def features(self, df: DataFrame) -> list[str]:
        skip = {self.target, KEPT_TARGET, *self.keep, *self.text}
        return [c for c in df.columns if c not in skip]

    def to_dict(self) -> dict:
        return {"target": self.target, "keep": list(self.keep), "text": list(self.text)}

    @classmethod
    def from_dict(cls, data: dict) -> Roles:
        return cls(data["target"], tuple(data["keep"]), tuple(data["text"]))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame, names: list[str] | None = None) -> list[str]:
    names = df.columns if names is None else names
    return [c for c in names if is_numeric(df.schema[c].dataType)]


def string_columns(df: DataFrame, names: list[str] | None = None) -> list[str]:
    names = df.columns if names is None else names
    return [c for c in names if is_string(df.schema[c].dataType)]


def has_date_name(name: str) -> bool:
    return any(word in name.lower() for word in DATE_KEYWORDS)


def normalize(df: DataFrame, roles: Roles) -> DataFrame:
    """One value of null and one numeric width: NaN becomes null, decimals become doubles."""
    out = []
    for field in df.schema.fields:
        c, kind = col(field.name), field.dataType
        if field.name in roles.keep:
            out.append(c)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            out.append(F.when(~F.isnan(c), c.cast("double")).alias(field.name))
        elif isinstance(kind, T.DecimalType):
            out.append(c.cast("double").alias(field.name))
        elif isinstance(kind, T.NumericType) or is_string(kind) or is_datetime(kind):
            out.append(c)
        elif isinstance(kind, T.BooleanType):
            out.append(c)
        else:
            raise TypeError(
                f"column '{field.name}' has type {kind.simpleString()}: only numbers, strings, "
                "booleans, dates and timestamps can be features; list it in keep or flatten it"
            )
    return df.select(*out)
