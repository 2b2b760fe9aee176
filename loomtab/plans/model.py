"""Columns, errors and statistics that all operations share."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


class EngineError(Exception):
    """Any failure that a run reports."""


class EncodingError(EngineError):
    """Unknown encoding, or text that it cannot carry."""


class DecodeFailure(EncodingError):
    pass


class EncodeFailure(EncodingError):
    pass


class ConfigError(EngineError):
    """A configuration that cannot be used."""


class VersionMissing(ConfigError):
    pass


class UnsupportedVersion(ConfigError):
    pass


class RuleCollision(ConfigError):
    """Literal rules of which one is, or contains, another."""


class TransformError(EngineError):
    pass


class UnknownColumn(TransformError):
    pass


class IndexOutOfRange(TransformError):
    pass


class NameWithoutHeaders(TransformError):
    pass


class InvalidRegex(TransformError):
    pass


class RuntimeCollision(TransformError):
    """Matches of two rules that overlap in a cell."""


class OutputColumnConflict(TransformError):
    pass


class DictionaryError(EngineError):
    """Empty dictionary, repeated canonical, or an alias of two canonicals."""


ColumnRef = str | int


def parse_column(text: str) -> ColumnRef:
    """Digits are an index from 0, anything else a name."""
    digits = text[1:] if text[:1] == "+" else text
    return int(digits) if digits.isascii() and digits.isdigit() else text


def parse_columns(text: str) -> list[ColumnRef]:
    return [parse_column(part.strip()) for part in text.split(",")]


def resolve(ref: ColumnRef, header: list[str] | None) -> int:
    """Position of a column. Names are exact, and the first of equal ones counts."""
    if isinstance(ref, int):
        if header is not None and ref >= len(header):
            raise IndexOutOfRange(f"column {ref} is out of range, there are {len(header)}")
        return ref
    if header is None:
        raise NameWithoutHeaders(f"column {ref!r} is named, but there is no header")
    if ref not in header:
        raise UnknownColumn(f"no column {ref!r}; there are: {', '.join(header)}")
    return header.index(ref)


def check_new_columns(names: list[str], header: list[str] | None) -> None:
    if header is None:
        return
    seen = set(header)
    for name in names:
        if name in seen:
            raise OutputColumnConflict(f"output column {name!r} exists already")
        seen.add(name)


def check_version(version, supported: int = 1) -> None:
    if version is None:
        raise VersionMissing("no version given")
    if version != supported:
        raise UnsupportedVersion(f"version {version} is not supported, {supported} is")


@dataclass
class RuleStat:
    id: str
    rows_affected: int = 0
    matches: int | None = None


@dataclass
class Stats:
    rows_processed: int = 0
    rows_changed: int = 0
    changes_total: int = 0
    per_rule: list[RuleStat] = field(default_factory=list)

    def to_text(self) -> str:
        # fixed values: the labels of the report
        lines = [f"処理行数: {self.rows_processed}", f"ヒット行数: {self.rows_changed}", f"ヒット総数: {self.changes_total}"]
        if self.per_rule:
            lines.append("ルール別:")
            lines += [f"  {r.id}: ヒット {r.rows_affected} 行" + (f" / マッチ {r.matches} 件" if r.matches is not None else "") for r in self.per_rule]
        return "\n".join(lines)

    def to_json(self) -> str:
        rules = [{"id": r.id, "rows_affected": r.rows_affected} | ({"matches": r.matches} if r.matches is not None else {}) for r in self.per_rule]
        return json.dumps({"rows_processed": self.rows_processed, "rows_changed": self.rows_changed, "changes_total": self.changes_total, "per_rule": rules}, indent=2, ensure_ascii=False)
