"""Scalar columns: hashes, encodings, comparisons."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_hash(line: Column) -> Column:
    """Identity of a raw line: `0x` and 16 hexadecimal digits of its SHA-256."""
    return F.concat(F.lit("0x"), F.substring(F.sha2(line.cast("binary"), 256), 1, 16))


def query_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 10)


def predicate_id(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 10)


def salted(salt: str, *key: str) -> Column:
    """64 hexadecimal digits that order rows at random, the same in every run and engine."""
    return F.sha2(F.concat_ws("|", F.lit(salt), *(F.col(k).cast("string") for k in key)).cast("binary"), 256)


def below(rate: float) -> str:
    """The first 8 hexadecimal digits that a salted hash must stay under to be in a sample of this rate."""
    return f"{min(0xFFFFFFFF, int(rate * 2**32)):08x}"


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def day_number(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def time_number(ts: Column) -> Column:
    return F.date_format(ts, "HHmmss").cast("int")


def scaled_int(c: Column, by: int = 100_000) -> Column:
    return (c * by).cast("int")


def close(a: Column, b: Column, within: float = 1e-4) -> Column:
    return F.abs(a - b) <= within


def total(c: Column) -> Column:
    """Sum in double precision, whatever the column's type. Its last digits follow the order of additions, so results are compared rounded."""
    return F.sum(c.cast("double"))


def count_at_most(value: Column, edges: list[float], fan: int = 16) -> Column:
    """How many of the edges, which are in ascending order, are at most the value; 0 for null.

    Edges are literals in levels: of each block of `fan` of a level, the last is an edge of the level above. A row looks at one block of each level, so that the work follows the
    logarithm of their number."""
    if not edges:
        return F.lit(0)
    step = 1
    while step * fan < len(edges):
        step *= fan
    # a block's first place is a variable, so that it is computed once for all that reads it
    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)
    def down(ends: Column, step: int):
        def count(base: Column) -> Column:
            block = F.slice(ends, (base / step).cast("int") + 1, fan) if step * fan < len(edges) else ends
            return base + F.size(F.filter(block, lambda e: e <= value)) * step

        return count

    found = F.lit(0)
    while step:
        ends = F.split(F.lit(",".join(map(repr, edges[step - 1 :: step]))), ",").cast("array<double>")
        found = let(found, down(ends, step))
        step //= fan
    return F.when(value.isNull(), 0).otherwise(found)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}


def arithmetic(text: str) -> float:
    """Value of an arithmetic expression of numbers; ValueError for anything else."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        raise ValueError(f"not arithmetic: {text!r}")

    try:
        return value(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not arithmetic: {text!r}") from e
