"""Hive-flavoured analytics on Spark: declared tables, SQL, templates, functions."""

from .catalog import Catalog, Table
from .engine import Engine
from .functions import FUNCTIONS, list_functions, register

__all__ = ["FUNCTIONS", "Catalog", "Engine", "Table", "list_functions", "register"]
