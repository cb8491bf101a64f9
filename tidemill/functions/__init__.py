"""The function registry: every name, how it is written in Spark SQL, and look-ups."""

from .registry import FUNCTIONS, Function, call, list_functions, register

__all__ = ["FUNCTIONS", "Function", "call", "list_functions", "register"]
