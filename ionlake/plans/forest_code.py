"""Forests as source text: nested if/else functions and SQL, and a parser of the former.

A source file holds one function for each ion type::

    // model toy ion B
    static float score_toy_B(unsigned int* v){
    float s = -5.0;
    if (v[27]<3.0){
    	s = s - 2.5;
    }else{
    	s = s - 0.5;}
    return s;}

Tests that send a missing value to the first branch have no form in it and are refused.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import EXPRESSION_NODES, NODE_COLUMNS


class InvalidForestSource(ValueError):
    """Source text that is not a forest."""


def _by_tree(nodes: pd.DataFrame) -> list[dict]:
    return [{int(r.node): r for r in tree.itertuples()} for _, tree in nodes.groupby("tree")]


def _ion(name: str) -> str:
    return re.sub(r"\W", "_", name)


def forest_source(nodes: pd.DataFrame) -> str:
    """The functions of every (model, ion) in the node table; a number is written so that it reads back the same."""
    if "missing" in nodes and (nodes["missing"].notna() & (nodes["missing"] != nodes["no"])).any():
        raise InvalidForestSource("a branch for missing values other than the second has no source form")
    out = []
    for (model, ion), own in nodes.groupby(["model", "ion"], sort=True):
        out += [f"// model {model} ion {ion}", f"static float score_{_ion(model)}_{_ion(ion)}(unsigned int* v){{", f"float s = {float(own['base_score'].iloc[0])!r};"]
        for tree in _by_tree(own):
            open_parts: list = [(0, 0)]  # nodes with their indentation, or text
            while open_parts:
                part = open_parts.pop()
                if isinstance(part, str):
                    out.append(part)
                    continue
                k, indent = part
                r, tabs = tree[k], "\t" * indent
                if not pd.isna(r.leaf):
                    leaf = float(r.leaf)
                    out.append(f"{tabs}s = s {'-' if np.signbit(leaf) else '+'} {abs(leaf)!r};")
                else:
                    out.append(f"{tabs}if (v[{int(r.feature)}]<{float(r.threshold)!r}){{")
                    open_parts += [f"{tabs}}}", (int(r.no), indent + 1), f"{tabs}}}else{{", (int(r.yes), indent + 1)]
        out += ["return s;}", ""]
    return "\n".join(out)


_TOKEN = re.compile(r"//[ ]?model (?P<model>.*) ion (?P<ion>\S+)[ ]*$|//[^\n]*|(?P<number>\d+\.?\d*(?:[eE][-+]?\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<sign>[-+=<(){}\[\];*,])|(?P<space>\s+)|(?P<other>.)", re.M)


class _Parser:
    """Recursive descent over the tokens of a source text."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        for m in _TOKEN.finditer(text):
            if m.lastgroup == "ion":
                self.tokens.append(("head", f"{m['model']}\0{m['ion']}"))
            elif m.lastgroup == "other":
                raise InvalidForestSource(f"unexpected {m[0]!r} at {m.start()}")
            elif m.lastgroup not in ("space", None):
                self.tokens.append((m.lastgroup, m[0]))
        self.at = 0
        self.rows: list[tuple] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *words: str) -> None:
        for w in words:
            if self.peek()[1] != w:
                raise InvalidForestSource(f"expected {w!r}, found {self.peek()[1]!r}")
            self.at += 1

    def word(self, kind: str) -> str:
        got, value = self.peek()
        if got != kind:
            raise InvalidForestSource(f"expected a {kind}, found {value!r}")
        self.at += 1
        return value

    def number(self) -> float:
        sign = 1.0
        if self.peek()[1] in ("-", "+"):
            sign = -1.0 if self.word("sign") == "-" else 1.0
        return sign * float(self.word("number"))

    def file(self) -> list[tuple]:
        while self.peek()[0] != "end":
            self.function()
        return self.rows

    def function(self) -> None:
        model, ion = self.word("head").split("\0") if self.peek()[0] == "head" else (None, None)
        self.take("static", "float")
        name = self.word("word")
        if model is None:  # a function without its comment: the last part of the name is the ion type
            model, _, ion = name.removeprefix("score_").rpartition("_")
        while self.peek()[1] != "{":
            self.at += 1
            if self.peek()[0] == "end":
                raise InvalidForestSource(f"{name} has no body")
        self.take("{", "float", "s", "=")
        base, tree, made = self.number(), 0, []
        self.take(";")
        while self.peek()[1] != "return":
            self.statement(tree, made, [0])
            tree += 1
        self.take("return", "s")
        if self.peek()[1] in ("-", "+"):
            base += self.number()
        self.take(";", "}")
        self.rows += [(model, ion, *row, base) for row in made]

    def statement(self, tree: int, made: list, numbers: list[int]) -> int:
        """A test with its branches, or a leaf; returns the node's number. Nodes are numbered in the order of the text."""
        own = numbers[0]
        numbers[0] += 1
        if self.peek()[1] == "if":
            self.take("if", "(", "v", "[")
            feature = int(self.word("number"))
            self.take("]", "<")
            threshold = self.number()
            self.take(")")
            place = len(made)
            made.append(None)
            yes = self.block(tree, made, numbers)
            self.take("else")
            no = self.block(tree, made, numbers)
            made[place] = (tree, own, feature, threshold, yes, no, None)
        else:
            self.take("s", "=", "s")
            if self.peek()[1] not in ("-", "+"):
                raise InvalidForestSource(f"expected a sign, found {self.peek()[1]!r}")
            made.append((tree, own, None, None, None, None, self.number()))
            self.take(";")
        return own

    def block(self, tree: int, made: list, numbers: list[int]) -> int:
        self.take("{")
        node = self.statement(tree, made, numbers)
        self.take("}")
        return node


def parse_forest_source(text: str) -> pd.DataFrame:
    """The node table of source text as forest_source writes it."""
    return pd.DataFrame(_Parser(text).file(), columns=NODE_COLUMNS)


def write_forest_source(spark: SparkSession, nodes: pd.DataFrame, path: str) -> None:
    """One text file in the folder ``path``; the size of the model."""
    spark.createDataFrame([(forest_source(nodes),)], "value string").coalesce(1).write.text(path)


def read_forest_source(spark: SparkSession, path: str) -> pd.DataFrame:
    return parse_forest_source(spark.read.text(path, wholetext=True).first()[0])


def _number(x: float) -> str:
    """A double in both engines: without an exponent it would be a decimal."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def _tree_sql(tree: dict, value: str, limit: int) -> list[str]:
    """CASE expressions whose sum is the tree; none is of more than ``limit`` nodes.

    A larger tree is cut: a subtree becomes an expression of its own, 0 outside its place.
    """
    out: list[str] = []

    def size(k):
        r = tree[k]
        return 1 if not pd.isna(r.leaf) else 1 + size(int(r.yes)) + size(int(r.no))

    def expression(k):
        r = tree[k]
        if not pd.isna(r.leaf):
            return _number(r.leaf)
        test = value.format(int(r.feature)) + f" < {_number(r.threshold)}"
        if not pd.isna(missing := getattr(r, "missing", None)) and int(missing) == int(r.yes):
            test = f"coalesce({test}, TRUE)"
        return f"CASE WHEN {test} THEN {expression(int(r.yes))} ELSE {expression(int(r.no))} END"

    def cut(k, path):
        """``path``: (test, whether it holds) from the root."""
        r = tree[k]
        if size(k) + 2 * len(path) <= limit or not pd.isna(r.leaf):
            own = expression(k)
            for test, holds in reversed(path):
                own = f"CASE WHEN {test} THEN {own} ELSE 0e0 END" if holds else f"CASE WHEN {test} THEN 0e0 ELSE {own} END"
            out.append(own)
            return
        test = value.format(int(r.feature)) + f" < {_number(r.threshold)}"
        if not pd.isna(missing := getattr(r, "missing", None)) and int(missing) == int(r.yes):
            test = f"coalesce({test}, TRUE)"
        cut(int(r.yes), [*path, (test, True)])
        cut(int(r.no), [*path, (test, False)])

    cut(0, [])
    return out


def forest_sql(nodes: pd.DataFrame, value: str, limit: int = EXPRESSION_NODES) -> list[str]:
    """SQL of one ion type's forest: expressions whose sum, with the base score, is the prediction.

    ``value`` names feature {}, as in ``get(features, {})``. Trees are joined up to ``limit`` nodes an
    expression and larger ones cut, so that each fits a compiled method.
    """
    if nodes[["model", "ion"]].drop_duplicates().shape[0] > 1:
        raise ValueError("SQL is made for one model and ion type")
    out: list[str] = []
    held, room = [], 0
    for tree in _by_tree(nodes):
        if room + len(tree) > limit and held:
            out.append(" + ".join(held))
            held, room = [], 0
        if len(tree) > limit:
            out += _tree_sql(tree, value, limit)
        else:
            held += _tree_sql(tree, value, limit)
            room += len(tree)
    return [*out, " + ".join(held)] if held else out


def score_by_columns(rows: DataFrame, nodes: pd.DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
    """``rows`` with the forest's value, computed in the JVM from a column for each of forest_sql's expressions."""
    parts = forest_sql(nodes, f"get(`{features}`, {{}})")
    # a sum of columns, each of which Catalyst compiles as a method of its own
    total = F.lit(float(nodes["base_score"].iloc[0])) if len(nodes) else F.lit(0.0)
    for part in parts:
        total = total + F.expr(part).cast("double")
    return rows.withColumn(out, total)
