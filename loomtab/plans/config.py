"""Rules and dictionaries from TOML and CSV files."""

from __future__ import annotations

import csv
import io
import tomllib
from pathlib import Path

from ..operators.basic import ExtractRule, FlagRule
from ..operators.replace import ReplaceRule
from ..operators.similarity import DEFAULT_THRESHOLD, Dictionary, SimilarityRule
from ..functions.text import DEFAULT_STEPS
from ..sources.encoding import decode, detect
from .model import ConfigError, check_version


def _load(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not TOML: {e}") from None


def _file(path: str) -> dict:
    config = _load(Path(path).read_text(encoding="utf-8"))
    check_version(config.get("version"))
    return config


def _need(rule: dict, names: tuple[str, ...]) -> list:
    for n in names:
        if n not in rule:
            raise ConfigError(f"a rule has no {n}")
    return [rule[n] for n in names]


def mask_config(path: str) -> tuple[list, str]:
    config = _file(path)
    columns = config.get("columns") or []
    if not columns:
        raise ConfigError("columns is empty")
    return columns, config.get("options", {}).get("mask_char", "*")[:1] or "*"


def replace_config(path: str) -> tuple[list[ReplaceRule], bool]:
    config = _file(path)
    rules = [ReplaceRule(r.get("name"), r.get("from"), r.get("to"), r.get("pattern"), r.get("replacement"), bool(r.get("regex", False))) for r in config.get("rules", [])]
    return rules, bool(config.get("options", {}).get("case_insensitive", False))


def flag_config(path: str) -> list[FlagRule]:
    out = []
    for r in _file(path).get("rules", []):
        pattern, out_col = _need(r, ("pattern", "out_col"))
        if ("column" in r) == ("columns" in r):
            raise ConfigError(f"{out_col}: give either column or columns")
        columns = [r["column"]] if "column" in r else r["columns"]
        if not columns:
            raise ConfigError(f"{out_col}: columns is empty")
        out.append(FlagRule(columns, pattern, out_col, r.get("true_value", "true"), r.get("false_value", "false")))
    return out


def extract_config(path: str) -> list[ExtractRule]:
    return [ExtractRule(*_need(r, ("column", "pattern", "out_col")), r.get("separator", ",")) for r in _file(path).get("rules", [])]


def similarity_config(path: str, delimiter: str = ",") -> list[SimilarityRule]:
    out = []
    for r in _file(path).get("rules", []):
        column, dictionary, out_col, score_col = _need(r, ("column", "dict", "out_col", "score_col"))
        out.append(SimilarityRule(column, read_dictionary(dictionary, delimiter), out_col, score_col, r.get("threshold", DEFAULT_THRESHOLD), r.get("algorithm", "levenshtein"), tuple(r.get("normalize", DEFAULT_STEPS))))
    return out


def read_dictionary(path: str, delimiter: str = ",") -> Dictionary:
    """A ``.toml`` file of entries, or a delimited one: canonical and aliases, behind a header."""
    raw = Path(path).read_bytes()
    text = decode(raw, detect(raw)[0])
    if path.lower().endswith(".toml"):
        config = _load(text)
        check_version(config.get("version"))
        return Dictionary(tuple((e["canonical"], tuple(e.get("aliases", ()))) for e in config.get("entries", [])))
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r][1:]
    return Dictionary(tuple((r[0], tuple(a for a in r[1:] if a)) for r in rows if r[0]))
