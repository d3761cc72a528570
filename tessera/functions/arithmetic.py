"""Arithmetic in texts, evaluated from its syntax tree: numbers and + - * / % ** only."""

from __future__ import annotations

import ast
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow}
UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}
#: A power's exponent at most.
MOST = 64


def value(text: str | None) -> float | None:
    """The value of an expression; null for anything else, for divisions by zero and for overflows."""

    def of(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return float(node.value)
        if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            left, right = of(node.left), of(node.right)
            if isinstance(node.op, ast.Pow) and abs(right) > MOST:
                raise ValueError("exponent")
            return float(BINARY[type(node.op)](left, right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in UNARY:
            return UNARY[type(node.op)](of(node.operand))
        raise ValueError("not arithmetic")

    try:
        return of(ast.parse((text or "").strip(), mode="eval").body)
    except (ValueError, SyntaxError, ArithmeticError, TypeError, RecursionError, MemoryError):
        return None


@F.pandas_udf(T.DoubleType())
def evaluate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(value).astype("float64")
