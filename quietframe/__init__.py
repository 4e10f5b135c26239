"""quietframe: differentially private analytics on Spark DataFrames."""

from typing import Any

from .budgets import ApproxDPBudget, PureDPBudget, RhoZCDPBudget
from .budgets import Budget as PrivacyBudget
from .builder import GroupedQueryBuilder, QueryBuilder
from .functions.binning import BinningSpec, BinT
from .keys import KeySet
from .plans.nodes import GroupbyCountQuery, Mechanism, Query
from .protection import AddMaxRows, AddMaxRowsInMaxGroups, AddOneRow, AddRowsWithID, Constraint, MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID, ProtectedChange, TruncationStrategy
from .schema import AnalyticsDefault, ColumnDescriptor, ColumnType
from .session import Config, FeatureFlag, Session, check_installation
from .utils import cleanup, remove_all_temp_tables

#: One family of noise for each aggregate.
CountMechanism = CountDistinctMechanism = SumMechanism = AverageMechanism = VarianceMechanism = StdevMechanism = Mechanism
#: What row functions take and give.
Row = dict[str, Any]

__all__ = [
    "AddMaxRows", "AddMaxRowsInMaxGroups", "AddOneRow", "AddRowsWithID", "ApproxDPBudget", "BinningSpec", "ColumnDescriptor", "ColumnType", "Config", "KeySet",
    "MaxGroupsPerID", "MaxRowsPerGroupPerID", "MaxRowsPerID", "Mechanism", "PureDPBudget", "Query", "QueryBuilder", "RhoZCDPBudget", "Session", "TruncationStrategy", "check_installation", "cleanup", "remove_all_temp_tables",
    "AnalyticsDefault", "BinT", "Constraint", "FeatureFlag", "GroupbyCountQuery", "GroupedQueryBuilder", "PrivacyBudget", "ProtectedChange", "Row",
    "CountMechanism", "CountDistinctMechanism", "SumMechanism", "AverageMechanism", "VarianceMechanism", "StdevMechanism",
]
