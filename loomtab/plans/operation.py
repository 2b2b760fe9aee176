"""An operation as columns, and its two carriers.

An operation overwrites cells, appends columns, and tells for each row how often each of its rules hit.
It is applied to a table of named string columns (``apply_named``), or to rows of any width
(``apply_ragged``: ``row`` and ``fields``), always as a projection: rows are not moved, dropped or multiplied.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .model import EngineError, IndexOutOfRange, RuleStat, RuntimeCollision, Stats

HITS, ERROR, NOTES = "__hits", "__error", "__notes"


@dataclass
class Operation:
    #: Positions of the cells that it reads or overwrites; None for all.
    targets: list[int] | None
    #: Names of appended columns.
    names: list[str] = field(default_factory=list)
    #: Columns to compute first, step by step, from the cells: what goes through Python, or is used more than once.
    prepare: list[dict[str, Callable]] = field(default_factory=list)
    #: New value of a cell.
    overwrite: Callable[[Column], Column] | None = None
    #: Appended values, from a function that gives the cell at a position.
    append: Callable[[Callable[[int], Column]], list[Column]] | None = None
    #: Hits of each rule in one cell (for operations that overwrite).
    cell_hits: Callable[[Column], list[Column]] | None = None
    #: Hits of each rule in a row (for operations that append).
    row_hits: Callable[[Callable[[int], Column]], list[Column]] | None = None
    #: Error message of a cell, or null.
    cell_error: Callable[[Column], Column] | None = None
    #: The same as ``overwrite``, hits and error of one cell in Python, where columns cannot say it inside an array.
    in_python: Callable[[str], tuple] | None = None
    #: What is to be said of a row, as an array of texts (rows of files only).
    notes: Column | None = None
    rule_ids: list[str] = field(default_factory=list)
    #: Whether a rule's number of matches is reported, beside its rows.
    counts_matches: bool = False


def _sum(columns: list[Column]) -> Column:
    return functools.reduce(operator.add, columns, F.lit(0).cast("long"))


def _with_hits(df: DataFrame, cells: list[tuple[str, Column]], hits: list[Column], op: Operation, error: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in cells], F.array(*[h.cast("long") for h in hits]).alias(HITS) if hits else F.array().cast("array<bigint>").alias(HITS), error.alias(ERROR), *([] if op.notes is None else [op.notes.alias(NOTES)]))


def apply_named(df: DataFrame, op: Operation) -> DataFrame:
    """The table with the operation done. Cells are text; a null counts as empty where the operation reads it.

    Reading a cell that the operation overwrites fails if its row is in error (matches of two rules that overlap).
    """
    return checked(_named(df, op), df.columns, op).select(*[F.col(f"`{c}`") for c in [*df.columns, *op.names]])


def checked(done: DataFrame, given: list[str], op: Operation) -> DataFrame:
    """Applied rows whose overwritten cells and hits raise their row's error."""
    if not op.cell_error:
        return done
    targets = range(len(given)) if op.targets is None else sorted(set(op.targets))
    fail = F.raise_error(F.concat(F.lit("RuntimeCollision: "), F.col(ERROR)))
    return done.withColumns({c: F.when(F.col(ERROR).isNull(), F.col(f"`{c}`")).otherwise(fail) for c in [*[given[i] for i in targets], HITS]})


def _named(df: DataFrame, op: Operation) -> DataFrame:
    given = df.columns
    cell = lambda i: F.coalesce(F.col(f"`{given[i]}`").cast("string"), F.lit(""))
    targets = list(range(len(df.columns))) if op.targets is None else sorted(set(op.targets))
    for step in op.prepare:
        df = df.withColumns({n: f(cell) for n, f in step.items()})
    cells = [(c, F.col(f"`{c}`")) for c in given]
    hits, error = [], F.lit(None).cast("string")
    if op.overwrite:
        for i in targets:
            cells[i] = (given[i], op.overwrite(cell(i)))
        if op.cell_hits:
            by_cell = [op.cell_hits(cell(i)) for i in targets]
            hits = [_sum([h[k] for h in by_cell]) for k in range(len(by_cell[0]) if by_cell else 0)]
        if op.cell_error:
            error = F.coalesce(error, *[F.concat(F.lit(f"column {given[i]}: "), op.cell_error(cell(i))) for i in targets])
    if op.append:
        cells += list(zip(op.names, op.append(cell)))
        hits = op.row_hits(cell)
    return _with_hits(df, cells, hits, op, error)


def apply_ragged(rows: DataFrame, op: Operation, header: list[str] | None = None) -> DataFrame:
    """(row, fields, hits, error) of (row, fields); a row too short for the operation has an error."""
    width = F.size("fields")
    cell = lambda i: F.coalesce(F.get("fields", F.lit(i)), F.lit(""))
    need = max(op.targets) if op.targets else -1
    for step in op.prepare:
        rows = rows.withColumns({n: f(cell) for n, f in step.items()})
    error = F.when(width <= need, F.format_string(f"!column {need} is out of range, the row has %d", width))
    fields, hits = F.col("fields"), []
    if op.in_python:
        done = _python_cells(op, header)("fields")
        fields, hits, error = done["fields"], [done["hits"][k] for k in range(len(op.rule_ids))], F.coalesce(error, done["error"])
    elif op.overwrite:
        at = lambda i: F.lit(True) if op.targets is None else i.isin(sorted(set(op.targets))) if op.targets else F.lit(False)
        fields = F.transform("fields", lambda x, i: F.when(at(i), op.overwrite(x)).otherwise(x))
        chosen = F.col("fields") if op.targets is None else F.filter(F.array(*[F.get("fields", F.lit(i)) for i in sorted(set(op.targets))]), lambda x: x.isNotNull())
        if op.cell_hits:
            rules = len(op.cell_hits(F.lit("")))
            of = lambda k: F.transform(chosen, lambda x: op.cell_hits(x)[k].cast("long"))
            hits = [F.aggregate(of(k), F.lit(0).cast("long"), lambda s, n: s + n) for k in range(rules)]
        if op.cell_error:
            found = F.filter(F.transform("fields", lambda x, i: F.when(at(i), F.concat(F.lit("column "), _name(header, i), F.lit(": "), op.cell_error(x)))), lambda x: x.isNotNull())
            error = F.coalesce(error, F.get(found, F.lit(0)))
    if op.append:
        fields = F.concat("fields", F.array(*op.append(cell)))
        hits = op.row_hits(cell)
    return _with_hits(rows, [("row", F.col("row")), ("fields", fields)], hits, op, error)


def _python_cells(op: Operation, header: list[str] | None):
    targets, of, n = None if op.targets is None else set(op.targets), op.in_python, len(op.rule_ids)

    @F.pandas_udf("struct<fields: array<string>, hits: array<bigint>, error: string>")
    def run(rows):
        import pandas as pd

        out = []
        for row in rows:
            cells, hits, error = list(row), [0] * n, None
            for i in range(len(cells)):
                if targets is None or i in targets:
                    cells[i], found, wrong = of(cells[i])
                    hits = [a + b for a, b in zip(hits, found)]
                    name = header[i] if header is not None and i < len(header) else f"col[{i}]"
                    error = error or (wrong and f"column {name}: {wrong}")
            out.append((cells, hits, error))
        return pd.DataFrame(out, columns=["fields", "hits", "error"])

    return run


def _name(header: list[str] | None, i: Column) -> Column:
    at = F.concat(F.lit("col["), i.cast("string"), F.lit("]"))
    return at if header is None else F.coalesce(F.get(F.array(*map(F.lit, header)), i), at)


def measures(op: Operation) -> list[Column]:
    """Aggregates of applied rows from which ``collected`` makes the statistics."""
    n = len(op.rule_ids) or 1
    hit = lambda k: F.coalesce(F.get(F.col(HITS), F.lit(k)), F.lit(0).cast("long"))
    rows = [F.count_if(hit(k) > 0).alias(f"rows_{k}") for k in range(n)]
    sums = [F.coalesce(F.sum(hit(k)), F.lit(0)).cast("long").alias(f"sum_{k}") for k in range(n)]
    changed = F.count_if(F.exists(F.col(HITS), lambda h: h > 0)).alias("changed")
    return [F.count(F.lit(1)).alias("processed"), changed, *rows, *sums]


def collected(op: Operation, m: dict) -> Stats:
    n = len(op.rule_ids)
    total = sum(m.get(f"sum_{k}", 0) for k in range(n or 1))
    rules = [RuleStat(id, m.get(f"rows_{k}", 0), (m.get(f"sum_{k}") or None) if op.counts_matches else None) for k, id in enumerate(op.rule_ids)]
    return Stats(m["processed"], m["changed"], total, rules)


def observed(applied: DataFrame, op: Operation, ragged: bool) -> tuple[DataFrame, Observation]:
    """The rows with an observation of statistics and the first error, both filled by the action that writes them."""
    watch = Observation()
    first = F.min(F.when(F.col(ERROR).isNotNull(), F.struct(F.col("row") if ragged else F.lit(0).cast("long").alias("row"), F.col(ERROR).alias("error"))))
    return applied.observe(watch, *measures(op), first.getField("row").alias("error_row"), first.getField("error").alias("error")), watch


def check_error(m: dict) -> None:
    """Raises for the first row in error."""
    if m.get("error"):
        kind: type[EngineError] = IndexOutOfRange if m["error"].startswith("!") else RuntimeCollision
        raise kind(f"row {m['error_row']}: {m['error'].lstrip('!')}")


def statistics(df: DataFrame, op: Operation) -> DataFrame:
    """The statistics of a named table as one row, by one aggregation."""
    m = checked(_named(df, op), df.columns, op).agg(*measures(op))
    n = len(op.rule_ids)
    rules = F.array(*[F.struct(F.lit(id).alias("id"), F.col(f"rows_{k}").alias("rows_affected"), F.when(F.lit(op.counts_matches) & (F.col(f"sum_{k}") > 0), F.col(f"sum_{k}")).alias("matches")) for k, id in enumerate(op.rule_ids)])
    total = _sum([F.col(f"sum_{k}") for k in range(n or 1)])
    return m.select(F.col("processed").alias("rows_processed"), F.col("changed").alias("rows_changed"), total.alias("changes_total"), *([rules.alias("per_rule")] if n else []))
