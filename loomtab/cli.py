"""Command line: ``python -m loomtab COMMAND``; one input file, one output file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .functions.text import DEFAULT_STEPS
from .operators import basic, info, replace, similarity
from .plans import config
from .plans.model import ConfigError, EngineError, Stats, parse_column, parse_columns
from .plans.operation import NOTES, Operation, apply_ragged, check_error, collected, observed
from .sources.encoding import delimiter, encoding_name
from .sources.files import probe, read_rows, write_rows


def run_file(spark: SparkSession, build, input: str, output: str, encoding: str = "utf-8", sep: str = ",", has_header: bool = True, dry_run: bool = False) -> Stats:
    """Reads, applies the operation that ``build`` makes for the header, and writes; statistics of the same pass.

    The first row in error decides the error, and no output is left then.
    """
    p = probe(spark, input, encoding, sep, has_header)
    op: Operation = build(p.header)
    rows = read_rows(spark, input, p.encoding, sep, has_header)
    applied = apply_ragged(rows, op, p.header)
    noted, all_ = Observation(), applied
    if op.notes is not None:
        applied = applied.observe(noted, F.count_if(F.size(NOTES) > 0).alias("n"))
    if dry_run:
        applied, watch = observed(applied, op, ragged=True)
        applied.write.format("noop").mode("overwrite").save()
        check_error(watch.get)
        say(all_, op, noted)
        return collected(op, watch.get)
    if p.mixed:
        print("warning: line endings are mixed; all become CRLF", file=sys.stderr)
    header = None if p.header is None else [*p.header, *op.names]
    m = write_rows(applied, output, header, p.encoding, sep, p.crlf, len(op.rule_ids))
    say(all_, op, noted)
    return collected(op, m)


def say(applied: DataFrame, op: Operation, noted: Observation) -> None:
    """A line for each row and rule with a tie; looked for again only if there are any."""
    if op.notes is not None and noted.get["n"]:
        for r in applied.filter(F.size(NOTES) > 0).select("row", NOTES).toLocalIterator():
            for name in r[NOTES]:
                print(f"warning: row {r['row']} ({name}) has a tie; the first in the dictionary wins", file=sys.stderr)


def convert_file(spark: SparkSession, input: str, output: str, encoding: str = "utf-8", to: str = "utf-8", sep: str = ",", to_sep: str = ",") -> Stats:
    """Another encoding or delimiter; the header is a row like any other."""
    encoding_name(to)
    p = probe(spark, input, encoding, sep, False)
    if p.mixed:
        print("warning: line endings are mixed; all become CRLF", file=sys.stderr)
    op = Operation(targets=[])
    applied = apply_ragged(read_rows(spark, input, p.encoding, sep, False), op)
    return collected(op, write_rows(applied, output, None, to, to_sep, p.crlf))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomtab")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, files: bool = True, stats: bool = True):
        p = commands.add_parser(name)
        p.add_argument("-i", "--input", required=True)
        if files or name == "convert":
            p.add_argument("-o", "--output", required=True)
        if files:
            p.add_argument("--input-encoding", default="utf-8")
            p.add_argument("--delimiter", default="comma")
            p.add_argument("--no-headers", action="store_true")
            p.add_argument("--dry-run", action="store_true")
        p.add_argument("--json", action="store_true")
        if stats:
            p.add_argument("--quiet", action="store_true")
        return p

    p = command("mask")
    p.add_argument("--config")
    p.add_argument("-c", "--columns")
    p.add_argument("--mask-char", default="*")
    p = command("replace")
    p.add_argument("--config")
    p.add_argument("-c", "--columns")
    p.add_argument("--all-columns", action="store_true")
    p.add_argument("--from", dest="from_")
    p.add_argument("--to")
    p.add_argument("--regex", action="store_true")
    p.add_argument("--case-insensitive", action="store_true")
    p = command("flag")
    p.add_argument("--config")
    p.add_argument("-c", "--columns")
    p.add_argument("--pattern")
    p.add_argument("--out-col")
    p.add_argument("--true-value", default="true")
    p.add_argument("--false-value", default="false")
    p = command("extract")
    p.add_argument("--config")
    p.add_argument("-c", "--column")
    p.add_argument("--pattern")
    p.add_argument("--out-col")
    p.add_argument("--separator", default=",")
    p = command("similarity")
    p.add_argument("--config")
    p.add_argument("-c", "--column")
    p.add_argument("--dict")
    p.add_argument("--out-col", default="matched_name")
    p.add_argument("--score-col", default="score")
    p.add_argument("--threshold", type=float, default=similarity.DEFAULT_THRESHOLD)
    p.add_argument("--algorithm", default="levenshtein")
    p.add_argument("--normalize", default=",".join(DEFAULT_STEPS))
    p = command("split")
    p.add_argument("-c", "--col", required=True)
    p.add_argument("--by", required=True)
    p.add_argument("--out-cols", required=True)
    p = command("convert", files=False)
    p.add_argument("--input-encoding", default="utf-8")
    p.add_argument("--output-encoding", default="utf-8")
    p.add_argument("--input-delimiter", default="comma")
    p.add_argument("--output-delimiter", default="comma")
    p = command("info", files=False, stats=False)
    p.add_argument("--input-delimiter")
    p.add_argument("--input-quote", default='"')
    return top


def _builder(a: argparse.Namespace):
    """A function from the header to the operation. ``--config`` goes before the arguments."""

    def given(*names: str) -> None:
        for n in names:
            if getattr(a, n.replace("-", "_")) in (None, ""):
                raise ConfigError(f"give --config or --{n}")

    if a.command == "mask":
        if a.config:
            columns, char = config.mask_config(a.config)
        else:
            given("columns", "mask-char")
            columns, char = parse_columns(a.columns), a.mask_char
        return lambda header: basic.mask(columns, header, char)
    if a.command == "replace":
        if bool(a.columns is not None) == a.all_columns:
            raise ConfigError("give either --columns or --all-columns")
        if a.config:
            rules, ignore_case = config.replace_config(a.config)
        elif a.from_ is None or a.to is None:
            raise ConfigError("give --config, or --from and --to")
        else:
            ignore_case = a.case_insensitive
            rules = [replace.ReplaceRule(pattern=a.from_, replacement=a.to, regex=True) if a.regex else replace.ReplaceRule(from_=a.from_, to=a.to)]
        compiled = replace.compile_rules(rules, ignore_case)
        columns = None if a.all_columns else parse_columns(a.columns)
        return lambda header: replace.replace(columns, compiled, header, ignore_case)
    if a.command == "flag":
        if a.config:
            rules = config.flag_config(a.config)
        else:
            given("columns", "pattern", "out-col")
            rules = [basic.FlagRule(parse_columns(a.columns), a.pattern, a.out_col, a.true_value, a.false_value)]
        return lambda header: basic.flag(rules, header)
    if a.command == "extract":
        if a.config:
            rules = config.extract_config(a.config)
        else:
            given("column", "pattern", "out-col")
            rules = [basic.ExtractRule(parse_column(a.column), a.pattern, a.out_col, a.separator)]
        return lambda header: basic.extract(rules, header)
    if a.command == "similarity":
        sep = delimiter(a.delimiter)
        if a.config:
            rules = config.similarity_config(a.config, sep)
        else:
            given("column", "dict")
            steps = tuple(s.strip() for s in a.normalize.split(",") if s.strip())
            rules = [similarity.SimilarityRule(parse_column(a.column), config.read_dictionary(a.dict, sep), a.out_col, a.score_col, a.threshold, a.algorithm, steps)]
        return lambda header: similarity.similarity(rules, header)
    names = [c.strip() for c in a.out_cols.split(",")]
    if not a.by or not all(names):
        raise ConfigError("--by and the names of --out-cols must not be empty")
    return lambda header: basic.split(parse_column(a.col), a.by, names, header)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("loomtab").getOrCreate()
        if a.command == "info":
            report = info.report(spark, a.input, delimiter(a.input_delimiter) if a.input_delimiter else None, a.input_quote[:1] or '"')
        elif a.command == "convert":
            report = convert_file(spark, a.input, a.output, a.input_encoding, a.output_encoding, delimiter(a.input_delimiter), delimiter(a.output_delimiter))
        else:
            report = run_file(spark, _builder(a), a.input, a.output, a.input_encoding, delimiter(a.delimiter), not a.no_headers, a.dry_run)
    except (EngineError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # a worker's failure carries its own message
        text = str(e)
        known = next((line for line in reversed(text.splitlines()) if "Failure:" in line), "")
        if not known:
            raise
        print(f"error: {known.split('Failure:', 1)[1].strip()}", file=sys.stderr)
        return 1
    if not getattr(a, "quiet", False):
        print(report.to_json() if a.json else report.to_text())
    return 0
