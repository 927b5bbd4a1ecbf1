"""Expressions over columns and the text query language."""

from loomframe.expr.ast import Expr, col, len_, lit, lower, upper, where

__all__ = ["Expr", "col", "len_", "lit", "lower", "upper", "where"]
