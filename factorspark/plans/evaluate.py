"""Many formulas over one panel, as few shuffles as their nesting needs.

All formulas of a request share one set of nodes, keyed by their text, so equal parts are computed once. All
per-symbol windows that are ready go into one ``withColumns`` (same keys and order: one shuffle, one sort), then
all per-date ones, and so on. The number of shuffles is the number of symbol/date changes in the deepest
formula, not the number of formulas.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Frames
from ..operators.panel import Panel
from .formula import DEFAULT, Call, Constant, Feature, FormulaOptions, Node, parse, reach

BLOCK_ROWS = 250_000  # longest series handed to one window task
OWN_ROWS = frozenset({"scoring", "deploy"})  # dialects whose windows run over a symbol's own rows
_WIDE = 60  # window columns per projection


def _nodes(formulas: Mapping[str, str | Node], options: FormulaOptions) -> dict[str, Node]:
    return {name: parse(f, options) if isinstance(f, str) else f for name, f in formulas.items()}


def add_factors(
    panel: Panel,
    formulas: Mapping[str, str | Node],
    options: FormulaOptions = DEFAULT,
    block_rows: int = BLOCK_ROWS,
) -> Panel:
    """The panel with one more column per formula."""
    roots = _nodes(formulas, options)
    blocked = panel.n_dates > block_rows
    keys = ("symbol", "_block") if blocked else ("symbol",)
    if options.dialect not in OWN_ROWS:
        df = _blocks(panel.df, "date_idx", panel.n_dates, roots.values(), block_rows) if blocked else panel.df
        return panel.over(_compute(df, roots, Frames(keys), panel.n_symbols, blocked))
    # Windows count a symbol's own rows: days on which it has no value at all do not exist for it.
    features = [c for c in panel.df.columns if c not in ("symbol", "date", "date_idx")]
    present = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in features], F.lit(False))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("date_idx")) - 1
    own = panel.df.filter(present).withColumn("_place", place.cast("long"))
    own = _blocks(own, "_place", panel.n_dates, roots.values(), block_rows) if blocked else own
    done = _compute(own, roots, Frames(keys, "_place"), panel.n_symbols, blocked).drop("_place")
    absent = panel.df.filter(~present).select(*[c for c in panel.df.columns if c not in roots])
    absent = absent.withColumns({name: F.lit(None).cast("double") for name in roots})
    return panel.over(done.unionByName(absent))


def factor_table(panel: Panel, formulas: Mapping[str, str | Node], options: FormulaOptions = DEFAULT) -> DataFrame:
    """Just (symbol, date, date_idx, one column per formula)."""
    return add_factors(panel, formulas, options).df.select("symbol", "date", "date_idx", *formulas)


def factor_rows(panel: Panel, formulas: list[str], options: FormulaOptions = DEFAULT) -> DataFrame:
    """Long form (symbol, date, date_idx, expr, value): one pass, one generator, no self join."""
    names = {f"_f{i}": f for i, f in enumerate(formulas)}
    wide = factor_table(panel, names, options)
    pairs = F.array(*[F.struct(F.lit(f).alias("expr"), F.col(n).cast("double").alias("value")) for n, f in names.items()])
    return wide.select("symbol", "date", "date_idx", F.explode(pairs).alias("_p")).select(
        "symbol", "date", "date_idx", "_p.expr", "_p.value"
    )


def _blocks(df: DataFrame, order: str, length: int, roots, size: int) -> DataFrame:
    """Cut each symbol's series into blocks of ``size`` rows, each with the neighbouring rows its frames reach.

    A series of any length then spreads over many tasks. Borrowed rows carry ``_own = false``; they feed the
    frames and are dropped at the end.
    """
    reaches = [reach(r) for r in roots]
    back, ahead = max(b for b, _ in reaches), max(a for _, a in reaches)
    last = (length - 1) // size
    idx = F.col(order)
    first_block = F.greatest(F.floor((idx - ahead) / size), F.lit(0))
    last_block = F.least(F.floor((idx + back) / size), F.lit(last))
    return df.withColumn("_block", F.explode(F.sequence(first_block, last_block))).withColumn(
        "_own", F.col("_block") == F.floor(idx / size)
    )


def _compute(df: DataFrame, roots: dict[str, Node], frames: Frames, n_symbols: int, blocked: bool) -> DataFrame:
    keep = [c for c in df.columns if c not in ("_block", "_own")]
    done: dict[str, str] = {}  # text of a computed node -> its column
    waiting: dict[str, Call] = {}
    for root in roots.values():
        for node in root.walk():
            if isinstance(node, Call) and node.op.scope != "row":
                waiting.setdefault(str(node), node)

    def column(node: Node) -> Column:
        if str(node) in done:
            return F.col(done[str(node)])
        if isinstance(node, Feature):
            return F.col(node.name)
        if isinstance(node, Constant):
            return F.lit(node.value)
        return node.op.column(*[column(c) for c in node.children])

    def ready(node: Call) -> bool:
        parts = (n for c in node.inputs for n in c.walk())
        return all(str(n) in done for n in parts if isinstance(n, Call) and n.op.scope != "row")

    def settle(nodes: list[Node]) -> None:
        """Give every computed operand a column of its own, so no window evaluates an expression twice."""
        nonlocal df
        fresh = {}
        for node in nodes:
            for c in node.inputs:
                text = str(c)
                if isinstance(c, Call) and c.op.scope == "row" and text not in done and text not in fresh:
                    fresh[text] = column(c)
        names = {text: f"_v{len(done) + i}" for i, text in enumerate(fresh)}
        if fresh:
            df = df.withColumns({names[t]: c for t, c in fresh.items()})
            done.update(names)

    scope = "series"
    while waiting:
        batch = {t: n for t, n in waiting.items() if n.op.scope == scope and ready(n)}
        if not batch:
            if not any(ready(n) for n in waiting.values()):
                raise RuntimeError("formula nodes depend on each other")
            order = ["series", "series_frame", "date"]
            scope = order[(order.index(scope) + 1) % 3]
            continue
        settle(list(batch.values()))
        names = {t: f"_v{len(done) + i}" for i, t in enumerate(batch)}
        if scope == "series":
            items = list(batch.items())
            for i in range(0, len(items), _WIDE):
                part = items[i : i + _WIDE]
                df = df.withColumns(
                    {names[t]: n.op.column([column(c) for c in n.inputs], n.window, frames) for t, n in part}
                )
        else:
            for t, n in batch.items():
                source = done.get(str(n.inputs[0])) or n.inputs[0].name
                if scope == "series_frame":
                    df = n.op.apply(df, source, n.window, names[t], frames)
                elif blocked:
                    # Borrowed rows would count twice in a cross-section: rank the own rows and share the result.
                    ranked = n.op.apply(df.filter("_own").select("symbol", "date", source), source, names[t], n_symbols)
                    df = df.join(ranked.select("symbol", "date", names[t]), ["symbol", "date"])
                else:
                    df = n.op.apply(df, source, names[t], n_symbols)
        done.update(names)
        for t in batch:
            del waiting[t]
    out = {name: column(root).cast("double") for name, root in roots.items()}
    if blocked:
        df = df.filter("_own")
    return df.select(*[c for c in keep if c not in out], *[c.alias(n) for n, c in out.items()])
