"""Generic algorithms recorded once and run on whole vectors.

An algorithm is a Python function of numbers that uses operators and a
mathematics module; called with columns it records one expression, called
with arrays it computes. So a step becomes a projection, and many steps become
one narrow pass over Arrow batches rather than an ever deeper expression.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.functions import scalar, special

#: The functions that generic algorithms may call, for either kind of operand.
NAMES = "sin cos tan asin acos atan sinh cosh tanh exp log sqrt abs".split()
COLUMNS = SimpleNamespace(**{n: getattr(F, n) for n in NAMES})
ARRAYS = SimpleNamespace(**{n: getattr(np, {"asin": "arcsin", "acos": "arccos", "atan": "arctan"}.get(n, n)) for n in NAMES})


def function(f: Callable) -> Callable:
    """A function of columns from a generic one, f(m, *numbers)."""
    return lambda *cols: f(COLUMNS, *cols)


_TEXT = (("&&", " and "), ("||", " or "))
_BINARY = {
    ast.Add: lambda x, y: x + y, ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y, ast.Div: scalar.fdiv, ast.Mod: lambda x, y: x % y,
    ast.BitAnd: lambda x, y: x.bitwiseAND(y), ast.BitOr: lambda x, y: x.bitwiseOR(y), ast.BitXor: lambda x, y: x.bitwiseXOR(y),
    ast.LShift: scalar.shl, ast.RShift: scalar.shr,
}
_COMPARED = {
    ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y,
    ast.Eq: lambda x, y: x == y, ast.NotEq: lambda x, y: x != y,
}


def from_text(body: str, *parameters: str) -> Callable:
    """A function of columns from the text of its body, like ``from_text("return x * x + sin(y);", "x", "y")``.

    The body is one expression with the operators of C, but for the ternary, which is
    ``if_else(c, a, b)``; it may call every function of the library by name.
    """
    text = body.strip().removeprefix("return ").rstrip("; \n")
    for c, python in _TEXT:
        text = text.replace(c, python)
    text = re.sub(r"!(?!=)", " not ", text)
    tree = ast.parse(text.strip(), mode="eval").body
    known = {**scalar.FUNCTIONS, **special.FUNCTIONS, "if_else": scalar.if_else}

    def value(node: ast.AST, of: dict) -> Column:
        match node:
            case ast.Constant(value=v):
                return F.lit(v)
            case ast.Name(id=name) if name in of:
                return of[name]
            case ast.BinOp(left=x, op=op, right=y) if type(op) in _BINARY:
                return _BINARY[type(op)](value(x, of), value(y, of))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x, of)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~value(x, of)
            case ast.BoolOp(op=op, values=each):
                return reduce(and_ if isinstance(op, ast.And) else or_, [value(x, of) for x in each])
            case ast.Compare(left=x, ops=[op], comparators=[y]):
                return _COMPARED[type(op)](value(x, of), value(y, of))
            case ast.Call(func=ast.Name(id=name), args=args) if name in known:
                return known[name](*[value(x, of) for x in args])
        raise ValueError(f"not understood in {body!r}: {ast.unparse(node)}")

    def call(*columns: Column) -> Column:
        if len(columns) != len(parameters):
            raise TypeError(f"{len(parameters)} operands are needed, {len(columns)} were given")
        return value(tree, dict(zip(parameters, columns, strict=True)))

    value(tree, {p: F.lit(0) for p in parameters})  # unknown names fail here
    return call


class UserFunction:
    """A function as a class: ``body`` is the generic algorithm, an instance is called with columns."""

    def body(self, m, *numbers):
        raise NotImplementedError

    def __call__(self, *columns: Column) -> Column:
        return self.body(COLUMNS, *columns)


def step(df: DataFrame, f: Callable, state: list[str], parameters: list[str] = ()) -> DataFrame:
    """One step: all new states from the old ones, at once."""
    new = f(COLUMNS, *[F.col(c) for c in [*state, *parameters]])
    new = new if isinstance(new, (tuple, list)) else (new,)
    return df.select(*[c for c in df.columns if c not in state], *[x.alias(c) for x, c in zip(new, state, strict=True)])


def iterate(df: DataFrame, f: Callable, state: list[str], steps: int, parameters: list[str] = ()) -> DataFrame:
    """``steps`` steps in one narrow pass."""
    names = df.columns

    def run(batches):
        for b in batches:
            x = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in state]
            p = [b.column(c).to_numpy(zero_copy_only=False) for c in parameters]
            for _ in range(steps):
                new = f(ARRAYS, *x, *p)
                x = list(new) if isinstance(new, (tuple, list)) else [new]
            made = dict(zip(state, x, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(made[c]) if c in made else b.column(c) for c in names], names=names)

    return df.mapInArrow(run, ", ".join(f"`{c}` {'double' if c in state else t}" for c, t in df.dtypes))


def runge_kutta_2(slope: Callable, dt: float) -> Callable:
    """The midpoint rule for dx/dt = slope(m, x)."""

    def one(m, x):
        return x + dt * slope(m, x + dt / 2 * slope(m, x))

    return one


def runge_kutta_4(slope: Callable, dt: float) -> Callable:
    """The classical rule for systems: slope(m, *state, *parameters) gives a tuple."""

    def one(m, *args):
        k1 = slope(m, *args)
        n = len(k1)
        x, p = args[:n], args[n:]
        k2 = slope(m, *[a + dt / 2 * k for a, k in zip(x, k1)], *p)
        k3 = slope(m, *[a + dt / 2 * k for a, k in zip(x, k2)], *p)
        k4 = slope(m, *[a + dt * k for a, k in zip(x, k3)], *p)
        return tuple(a + dt / 6 * (q + 2 * r + 2 * s + t) for a, q, r, s, t in zip(x, k1, k2, k3, k4))

    return one


def lorenz(m, x, y, z, r):
    """Slopes of the Lorenz system with sigma 10 and b 8/3."""
    return 10.0 * (y - x), r * x - y - x * z, x * y - 8.0 / 3.0 * z
