"""Profile of a file: size, encoding, delimiter, line ending, rows and header."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import group_digits, human_size
from ..sources.encoding import DELIMITERS, DISPLAY, decode, detect_file, guess_delimiter, line_ending
from ..sources.files import _files, parse


@dataclass(frozen=True)
class InfoReport:
    file: str
    size_bytes: int
    encoding: str
    bom: bool
    delimiter: str
    quote: str
    line_ending: str
    rows: int
    columns: int
    headers: list[str]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    def to_text(self) -> str:
        encoding = DISPLAY.get(self.encoding, self.encoding) + (f" ({'with' if self.bom else 'no'} BOM)" if self.encoding == "utf-8" else "")
        ending = self.line_ending.upper() if self.line_ending in ("lf", "crlf") else self.line_ending
        # fixed values: the labels of the report, aligned
        pairs = {
            "File": self.file, "Size": f"{human_size(self.size_bytes)} ({group_digits(self.size_bytes)} bytes)", "Encoding": encoding, "Delimiter": self.delimiter, "Quote": self.quote,
            "Line ending": ending, "Rows": f"{group_digits(self.rows)} (excluding header)", "Columns": str(self.columns), "Headers": ", ".join(self.headers),
        }
        return "\n".join(f"{k + ':':<13}{v}" for k, v in pairs.items())


SCHEMA = "file string, size_bytes long, encoding string, bom boolean, delimiter string, quote string, line_ending string, rows long, columns int, headers array<string>"


def profile(spark: SparkSession, path: str, delimiter: str | None = None, quote: str = '"') -> DataFrame:
    """A row for each file of the path."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                encoding = detect_file(raw)
                text = decode(raw, encoding, strict=False)
                d = delimiter or guess_delimiter(text)
                rows = iter(parse(text, d, quote))
                header = next(rows, [])
                bom = raw.startswith(b"\xef\xbb\xbf")
                found = (name.rsplit("/", 1)[-1], len(raw), encoding, bom, "\\t" if d == "\t" else d, quote, line_ending(raw), sum(1 for _ in rows), len(header), header)
                yield pd.DataFrame([found], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return _files(spark, path).mapInPandas(run, SCHEMA)


def report(spark: SparkSession, path: str, delimiter: str | None = None, quote: str = '"') -> InfoReport:
    return InfoReport(**profile(spark, path, delimiter, quote).first().asDict())


def line_ending_of(c: Column) -> Column:
    """The line ending of texts in a column."""
    both, alone = F.instr(c, F.lit("\r\n")) > 0, c.rlike(r"(?<!\r)\n")
    return F.when(both & alone, "mixed").when(both, "crlf").when(alone, "lf").otherwise("none")


def delimiter_of(c: Column) -> Column:
    """The delimiter that gives most of the first 10 lines of a text the same number of columns, of more than one."""
    let = lambda v, body: F.get(F.transform(F.array(v), body), F.lit(0))
    all_ = F.split(c, "\n")
    lines = F.slice(F.when(F.element_at(all_, -1) == "", F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_), 1, 10)

    def of(x, k, d):
        widths = F.transform(x, lambda line: F.char_length(line) - F.char_length(F.replace(line, F.lit(d), F.lit(""))) + 1)
        rows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(F.size(F.filter(w, lambda y: y == w[i])).alias("n"), (-i).alias("i"), w[i].alias("w")))
        best = let(widths, lambda w: F.when(F.size(w) > 0, F.array_max(rows(w))))
        return let(best, lambda b: F.when(b["w"] > 1, F.struct(b["n"].alias("n"), b["w"].alias("w"), F.lit(-k).alias("k"), F.lit(d).alias("d"))))

    found = let(lines, lambda x: F.array_max(F.array(*[of(x, k, d) for k, d in enumerate(DELIMITERS.values())])))
    return F.coalesce(found["d"], F.lit(","))
