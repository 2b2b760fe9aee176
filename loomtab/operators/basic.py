"""mask, flag, extract and split as operations."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions import rx
from ..plans.model import ColumnRef, ConfigError, check_new_columns, resolve
from ..plans.operation import Operation


def mask(columns: list[ColumnRef], header: list[str] | None, mask_char: str = "*") -> Operation:
    """Every character (code point) of a non-empty cell becomes the mask character. A hit is a cell."""
    char = mask_char[:1] or "*"
    return Operation(
        targets=[resolve(c, header) for c in columns],
        overwrite=lambda c: F.when(c == "", c).otherwise(F.repeat(F.lit(char), F.char_length(c))),
        cell_hits=lambda c: [F.when(c != "", 1).otherwise(0)],
    )


@dataclass(frozen=True)
class FlagRule:
    columns: list
    pattern: str
    out_col: str
    true_value: str = "true"
    false_value: str = "false"


def flag(rules: list[FlagRule], header: list[str] | None) -> Operation:
    """For each rule, whether any of its cells has a match of its pattern."""
    check_new_columns([r.out_col for r in rules], header)
    at = [[resolve(c, header) for c in r.columns] for r in rules]
    found = [rx.translate(r.pattern, r.out_col) for r in rules]

    def hit(cell, k) -> Column:
        return functools.reduce(operator.or_, [cell(i).rlike(found[k].java) for i in at[k]])

    return Operation(
        targets=[i for x in at for i in x],
        names=[r.out_col for r in rules],
        append=lambda cell: [F.when(hit(cell, k), F.lit(r.true_value)).otherwise(F.lit(r.false_value)) for k, r in enumerate(rules)],
        row_hits=lambda cell: [F.when(hit(cell, k), 1).otherwise(0) for k in range(len(rules))],
        rule_ids=[r.out_col for r in rules],
    )


@dataclass(frozen=True)
class ExtractRule:
    column: ColumnRef
    pattern: str
    out_col: str
    separator: str = ","


def _by_row(p: rx.Pattern):
    """All matches of patterns that the JVM reads otherwise: empty matches, or a first group that may be absent."""

    @F.pandas_udf("array<string>")
    def matches(s):
        compiled = rx.python_pattern(p.source)

        def of(text):
            out, end = [], -1
            for m in compiled.finditer(text or ""):
                if m.start() == m.end() == end:
                    continue  # an empty match right behind a match is none
                end = m.end()
                out.append(m[1] if p.groups and m[1] is not None else m[0])
            return out

        return s.map(of)

    return matches


def extract(rules: list[ExtractRule], header: list[str] | None) -> Operation:
    """For each rule, all matches (of group 1 where it takes part) in one cell, joined."""
    check_new_columns([r.out_col for r in rules], header)
    at = [resolve(r.column, header) for r in rules]
    found = [rx.translate(r.pattern, r.out_col) for r in rules]

    slow = [p.may_be_empty or not p.first_group_sure for p in found]
    prepare = {f"__matches_{k}": lambda cell, k=k: _by_row(found[k])(cell(at[k])) for k in range(len(rules)) if slow[k]}

    def matches(cell, k) -> Column:
        p = found[k]
        return F.col(f"__matches_{k}") if slow[k] else F.regexp_extract_all(cell(at[k]), F.lit(p.java), F.lit(1 if p.groups else 0))

    def hits(cell, k) -> Column:
        return F.when(F.size(matches(cell, k)) > 0 if slow[k] else cell(at[k]).rlike(found[k].java), 1).otherwise(0)

    return Operation(
        targets=at,
        names=[r.out_col for r in rules],
        prepare=[prepare] if prepare else [],
        append=lambda cell: [F.array_join(matches(cell, k), r.separator) for k, r in enumerate(rules)],
        row_hits=lambda cell: [hits(cell, k) for k in range(len(rules))],
        rule_ids=[r.out_col for r in rules],
    )


def split(column: ColumnRef, by: str, out_cols: list[str], header: list[str] | None) -> Operation:
    """The cell cut at a literal into at most as many parts as there are new columns; the last takes the rest."""
    if not by:
        raise ConfigError("nothing to split by")
    if not out_cols or any(not c for c in out_cols):
        raise ConfigError("an output column has no name")
    at, n = resolve(column, header), len(out_cols)
    check_new_columns(out_cols, header)

    def parts(cell) -> Column:
        return F.split(cell(at), rx.literal(by).java, n)

    return Operation(
        targets=[at],
        names=list(out_cols),
        append=lambda cell: [F.coalesce(F.get(parts(cell), F.lit(k)), F.lit("")) if n > 1 else cell(at) for k in range(n)],
        row_hits=lambda cell: [F.when(F.lit(n > 1) & (F.instr(cell(at), F.lit(by)) > 0), 1).otherwise(0)],
    )
