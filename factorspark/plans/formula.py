"""Formulas: small immutable trees, written in Python or as text, that become columns.

``Div(Mean($volume,10d),$low)`` is a Python call expression once ``$`` and the ``d`` suffix are marked, so
reading a text is left to :mod:`ast`; this module only maps calls and names to operators and features.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from ..operators.panel import FEATURES, SLOW_FEATURES
from .operators import Operator, operators


class FormulaError(ValueError):
    pass


class Node:
    """Base of all formula parts; arithmetic on nodes and numbers builds larger formulas."""

    children: tuple[Node, ...] = ()

    @property
    def featured(self) -> bool:
        return any(c.featured for c in self.children)

    def __add__(self, other):
        return call("Add", self, other)

    def __radd__(self, other):
        return call("Add", other, self)

    def __sub__(self, other):
        return call("Sub", self, other)

    def __rsub__(self, other):
        return call("Sub", other, self)

    def __mul__(self, other):
        return call("Mul", self, other)

    def __rmul__(self, other):
        return call("Mul", other, self)

    def __truediv__(self, other):
        return call("Div", self, other)

    def __rtruediv__(self, other):
        return call("Div", other, self)

    def __pow__(self, other):
        return call("Pow", self, other)

    def __rpow__(self, other):
        return call("Pow", other, self)

    def __neg__(self):
        return call("Sub", 0.0, self)

    def __abs__(self):
        return call("Abs", self)

    def walk(self) -> Iterable[Node]:
        for c in self.children:
            yield from c.walk()
        yield self


@dataclass(frozen=True, eq=True)
class Feature(Node):
    name: str

    @property
    def featured(self) -> bool:
        return True

    def __str__(self):
        return f"${self.name}"


@dataclass(frozen=True, eq=True)
class Constant(Node):
    value: float

    def __str__(self):
        return str(float(self.value))


@dataclass(frozen=True, eq=True)
class Days(Node):
    """A time difference; legal only as the last operand of a rolling operator."""

    n: int

    def __str__(self):
        return f"{self.n}d"


@dataclass(frozen=True, eq=True)
class Call(Node):
    op: Operator
    children: tuple[Node, ...]

    def __str__(self):
        return f"{self.op.name}({','.join(str(c) for c in self.children)})"

    @property
    def window(self) -> int | None:
        return self.children[-1].n if self.op.windowed else None

    @property
    def inputs(self) -> tuple[Node, ...]:
        return self.children[:-1] if self.op.windowed else self.children


def _node(value) -> Node:
    if isinstance(value, Node):
        return value
    if isinstance(value, (int, float)):
        return Constant(float(value))
    raise FormulaError(f"{value!r} cannot be part of a formula")


def problem(op: Operator, args: Sequence[Node], strict_slow_features: bool = False) -> str | None:
    """Why ``op`` cannot take these operands, or None."""
    if len(args) != op.arity:
        return f"{op.name} takes {op.arity} operands, got {len(args)}"
    inputs = args[:-1] if op.windowed else args
    if op.windowed and not isinstance(args[-1], Days):
        return f"the last operand of {op.name} must be a time difference"
    if any(isinstance(a, Days) for a in inputs):
        return f"{op.name} cannot take a time difference as a value"
    if not any(a.featured for a in inputs):
        return f"{op.name} needs at least one operand that contains a feature"
    if strict_slow_features and op.windowed:
        for a in inputs:
            if not a.featured:
                return f"{op.name} rolls over a constant"
            names = {n.name for n in a.walk() if isinstance(n, Feature)}
            if names and names <= set(SLOW_FEATURES):
                return f"{op.name} rolls over slow features only"
    return None


def call(op: str | Operator, *args, dialect: str = "core", strict_slow_features: bool = False) -> Call:
    """``call("Mean", close, 10)``: build one operator node, checking its operands."""
    if isinstance(op, str):
        known = operators(dialect)
        if op not in known:
            raise FormulaError(f"unknown operator {op}")
        op = known[op]
    nodes = list(args)
    if op.windowed and nodes and isinstance(nodes[-1], int):
        nodes[-1] = Days(nodes[-1])
    nodes = [_node(a) for a in nodes]
    wrong = problem(op, nodes, strict_slow_features)
    if wrong:
        raise FormulaError(wrong)
    return Call(op, tuple(nodes))


def feature(name: str) -> Feature:
    return Feature(name.lstrip("$"))


@dataclass(frozen=True)
class FormulaOptions:
    """How texts are read; ``features=None`` accepts any column name."""

    dialect: str = "core"
    ignore_case: bool = False
    need_suffix: bool = False
    allow_non_positive: bool = True
    need_dollar: bool = False
    aliases: Mapping[str, Sequence[str]] | None = None
    features: frozenset[str] | None = frozenset(FEATURES)
    strict_slow_features: bool = False


DEFAULT = FormulaOptions()
# Other names that mined formulas use for the same operators.
COMMON_ALIASES = {"Max": ["Greater"], "Min": ["Less"], "Delta": ["Sub"]}

_MARKS = re.compile(r"\$(\w+)|(?<![\w.])([+-]?\d+(?:\.\d*)?)d\b")


def parse(text: str, options: FormulaOptions = DEFAULT) -> Node:
    """Formula text to a tree; raises :class:`FormulaError` when it is not a legal formula."""
    marked = _MARKS.sub(lambda m: f"feature_({m[1]!r})" if m[1] else f"days_({m[2]})", text.strip())
    try:
        tree = ast.parse(marked, mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise FormulaError(f"cannot read {text!r}") from e
    table = operators(options.dialect)
    choices = {name: [op] for name, op in table.items()}
    for alias, names in (options.aliases or {}).items():
        choices[alias] = list(dict.fromkeys(choices.get(alias, []) + [table[n] for n in names]))
    if options.ignore_case:
        choices = {k.lower(): v for k, v in choices.items()}
    return _build(tree, options, choices)


def _number(node) -> float | None:
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return float(node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        inner = _number(node.operand)
        if inner is not None:
            return -inner if isinstance(node.op, ast.USub) else inner
    return None


def _days(value: float, options: FormulaOptions) -> Days:
    if value != int(value):
        raise FormulaError(f"a time difference is a whole number, got {value}")
    if value <= 0 and not options.allow_non_positive:
        raise FormulaError(f"a time difference must be positive, got {int(value)}d")
    return Days(int(value))


def _feature(name: str, options: FormulaOptions) -> Feature:
    name = name.lower() if options.ignore_case else name
    if options.features is not None and name not in options.features:
        raise FormulaError(f"unknown feature {name}")
    return Feature(name)


def _build(node, options: FormulaOptions, choices: dict[str, list[Operator]]) -> Node:
    value = _number(node)
    if value is not None:
        return Constant(value)
    if isinstance(node, ast.Name):
        if options.need_dollar:
            raise FormulaError(f"{node.id}: features are written with a $")
        return _feature(node.id, options)
    if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Name)) or node.keywords:
        raise FormulaError(f"{ast.unparse(node)!r} is not an operator, a feature or a number")
    name = node.func.id
    if name == "feature_":
        return _feature(node.args[0].value, options)
    if name == "days_":
        return _days(_number(node.args[0]), options)
    key = name.lower() if options.ignore_case else name
    if key in ("Constant", "constant") and len(node.args) == 1 and (options.ignore_case or name == "Constant"):
        value = _number(node.args[0])
        if value is None:
            raise FormulaError("Constant takes a number")
        return Constant(value)
    if key not in choices:
        raise FormulaError(f"unknown operator {name}")
    args = [_build(a, options, choices) for a in node.args]
    reasons = []
    for op in choices[key]:
        used = list(args)
        if op.windowed and used and isinstance(used[-1], Constant) and not options.need_suffix:
            try:
                used[-1] = _days(used[-1].value, options)
            except FormulaError:
                pass
        wrong = problem(op, used, options.strict_slow_features)
        if wrong is None:
            return Call(op, tuple(used))
        reasons.append(wrong)
    raise FormulaError("; ".join(reasons))


def is_valid(text: str | None, options: FormulaOptions = DEFAULT) -> bool:
    try:
        return text is not None and parse(text, options) is not None
    except FormulaError:
        return False


def reach(node: Node) -> tuple[int, int]:
    """Rows of history and of future that the value at a date depends on."""
    back = ahead = 0
    for c in node.children:
        b, a = reach(c)
        back, ahead = max(back, b), max(ahead, a)
    if isinstance(node, Call) and node.op.windowed:
        need = node.op.reach(node.window) if hasattr(node.op, "reach") else None
        if need is None:
            raise FormulaError(f"{node.op.name} depends on the whole history")
        return (back + need, ahead) if need >= 0 else (back, ahead - need)
    return back, ahead
