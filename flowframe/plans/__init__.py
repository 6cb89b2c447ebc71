"""A plan is a graph of named transforms: compose it, inspect it, compile it to DataFrames."""

from .flow import Flow, node, source

__all__ = ["Flow", "node", "source"]
