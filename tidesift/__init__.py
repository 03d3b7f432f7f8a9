"""Outlier and KPI analytics for retail transactions on Spark DataFrames."""

from .config import FOREST, RULES, ForestConfig, RuleConfig
from .session import local_session, tune

__all__ = ["FOREST", "RULES", "ForestConfig", "RuleConfig", "local_session", "tune"]
