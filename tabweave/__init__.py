"""Tabular and text AutoML on Spark DataFrames."""

from tabweave.automl import AutoTable, FittedTable
from tabweave.plans.feature_plan import FeaturePlan, fit_plan
from tabweave.plans.roles import Roles
from tabweave.plans.text_plan import TextPlan, fit_text_plan
from tabweave.sources.tables import read_pair, read_table, write_table

__all__ = [
    "AutoTable",
    "FeaturePlan",
    "FittedTable",
    "Roles",
    "TextPlan",
    "fit_plan",
    "fit_text_plan",
    "read_pair",
    "read_table",
    "write_table",
]
