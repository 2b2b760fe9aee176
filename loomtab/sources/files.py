"""Delimited files: a strict reader for rows of any width, a writer of one file, and Spark's own way for plain tables.

``read_rows`` reads a file of any size in splits, as Spark's text source cuts it: at line feeds, which no character of the
encodings here has within. As a quoted cell may span lines, a first pass tells for each split whether a quote is open at its end,
for either state at its start, and how many rows start in it; these few numbers are put together on the driver. Where a row
goes on into a split, its rest (and no more) is fetched. The second pass then parses every split by itself. ``probe`` looks at the
first bytes and the last ones only. ``write_rows`` formats, encodes and writes parts on the executors, by Spark's committer; then the parts are
copied into one file, in order, through the file system's streams, which is renamed when all is well. All paths may be of any file system.
``read_table`` is Spark's reader, for rows of one width.
"""

from __future__ import annotations

import csv
import io
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..plans.model import EncodeFailure
from ..plans.operation import ERROR, HITS, check_error
from .encoding import LINE_SAMPLE, SAMPLE, decode, detect_file, encode, encoding_name, line_ending

ROWS = "row long, fields array<string>"


@dataclass(frozen=True)
class Probe:
    """What a file is, before its rows are read."""

    encoding: str
    crlf: bool
    mixed: bool
    header: list[str] | None


def path_url(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def parse(text: str, delimiter: str, quote: str = '"'):
    """Rows of a text, of any width; empty lines are no rows."""
    csv.field_size_limit(2**31 - 1)
    for fields in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote, doublequote=True):
        if fields:
            yield fields


def _files(spark: SparkSession, path: str) -> DataFrame:
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return spark.read.format("binaryFile").load(path_url(path)).select("path", "content")


def _at(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path_url(path))
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _bytes(files, where, start: int, n: int) -> bytes:
    stream = files.open(where)
    try:
        stream.seek(start)
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def probe(spark: SparkSession, path: str, encoding: str, delimiter: str, has_header: bool) -> Probe:
    """Resolves the encoding (``auto``: by its bytes) and reads line ending and header."""
    if encoding != "auto":
        encoding_name(encoding)
    files, where = _at(spark, path)
    if not files.exists(where):
        raise FileNotFoundError(path)
    size = files.getFileStatus(where).getLen()
    first = _bytes(files, where, 0, LINE_SAMPLE)
    # the same first and last bytes as those of the whole file
    last = _bytes(files, where, max(0, size - SAMPLE), SAMPLE) if size > len(first) else b""
    found = detect_file(first + last) if encoding == "auto" else encoding
    header, n = None, LINE_SAMPLE
    if has_header:
        rows = list(_first_rows(decode(first, found, strict=False), delimiter))
        while len(rows) < 2 and n < size:
            n *= 4
            rows = list(_first_rows(decode(_bytes(files, where, 0, n), found, strict=False), delimiter))
        header = rows[0] if rows else []
    ending = line_ending(first)
    return Probe(found, ending in ("crlf", "mixed"), ending == "mixed", header)


def _first_rows(text: str, delimiter: str):
    for k, fields in enumerate(parse(text, delimiter)):
        yield fields
        if k:
            break


def open_behind(line: str, open_: bool, delimiter: str, quote: str = '"') -> bool:
    """Whether a quoted cell is open behind a line, if one is (or none is) before it. A quote counts at the start of a cell only."""
    if quote not in line:
        return open_
    i = 0
    while True:
        if open_ or line[i : i + 1] == quote:
            i += not open_
            while True:
                i = line.find(quote, i) + 1
                if not i:
                    return True
                if line[i : i + 1] != quote:
                    break
                i += 1
            open_ = False
        i = line.find(delimiter, i) + 1
        if not i:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path_url(path)).select(F.col("value").cast("binary").alias("line"))


def _texts(batches, encoding: str, first: bool):
    """Decoded lines of a split; the file's first one without a byte-order mark."""
    for batch in batches:
        for x in batch.column(0):
            raw = x.as_py()
            if first and raw.startswith(b"\xef\xbb\xbf") and encoding == "utf-8":
                raw = raw[3:]
            first = False
            yield decode(raw, encoding, bom=False)


def _rows_of(record: str, delimiter: str) -> list:
    return list(parse(record, delimiter))


def read_rows(spark: SparkSession, path: str, encoding: str, delimiter: str, has_header: bool) -> DataFrame:
    """(row, fields): rows from 1, without the header; malformed bytes fail. Rows come in the file's order."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    lines = _lines(spark, path)

    def summarise(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        state, rows, some = [False, True], [0, 0], False
        for line in _texts(batches, encoding, not at):
            some = True
            here = 0 if line in ("", "\r") else 1 if "\r" not in line[:-1] else len(_rows_of(line, delimiter))
            for k in (0, 1):
                rows[k] += 0 if state[k] else here
                state[k] = open_behind(line, state[k], delimiter)
        if some:
            yield pa.RecordBatch.from_pydict({"at": [at], "behind0": [state[0]], "behind1": [state[1]], "rows0": pa.array([rows[0]], pa.int64()), "rows1": pa.array([rows[1]], pa.int64())})

    found = sorted(lines.mapInArrow(summarise, "at long, behind0 boolean, behind1 boolean, rows0 long, rows1 long").collect())
    open_, row, starts = False, 0, {}
    for r in found:
        starts[r["at"]] = (open_, row)
        row += r["rows1"] if open_ else r["rows0"]
        open_ = r["behind1"] if open_ else r["behind0"]
    inside = {at for at, (o, _) in starts.items() if o}

    def rest(batches):
        """What a row that began in an earlier split has in this one."""
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        if at in inside:
            some, state = [], True
            for line in _texts(batches, encoding, not at):
                some.append(line)
                state = open_behind(line, state, delimiter)
                if not state:
                    break
            yield pa.RecordBatch.from_pydict({"at": [at], "text": ["\n".join(some)], "ends": [not state]})

    rests = {r["at"]: (r["text"], r["ends"]) for r in lines.mapInArrow(rest, "at long, text string, ends boolean").collect()} if inside else {}
    order = sorted(starts)
    skip = int(has_header)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        state, row = starts.get(at, (False, 0))
        held, out = [], []

        def done(record):
            nonlocal row
            for fields in _rows_of(record, delimiter):
                row += 1
                if row > skip:
                    out.append((row - skip, fields))

        def batch():
            return pa.RecordBatch.from_pydict({"row": pa.array([x[0] for x in out], pa.int64()), "fields": pa.array([x[1] for x in out], pa.list_(pa.string()))})

        leading = state
        for line in _texts(batches, encoding, not at):
            state = open_behind(line, state, delimiter)
            if not leading:
                held.append(line)
                if not state:
                    done("\n".join(held))
                    held = []
            leading = leading and state
            if len(out) >= 5000:
                yield batch()
                out.clear()
        if held:  # the row goes on in later splits
            for later in order[order.index(at) + 1 :]:
                text, ends = rests[later]
                held.append(text)
                if ends:
                    break
            done("\n".join(held))
        if out:
            yield batch()

    return lines.mapInArrow(run, ROWS)


def read_table(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """A UTF-8 table of rows of one width as string columns, empty cells as empty strings."""
    df = spark.read.csv(path, header=header, sep=delimiter, quote='"', escape='"', multiLine=True)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def write_table(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    """A folder of UTF-8 files, one for each partition."""
    df.write.mode("errorifexists").csv(path, header=header, sep=delimiter, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def format_row(fields, delimiter: str, ending: str) -> str:
    """Quotes where they are needed; a single empty field is quoted, as an empty line would be no row."""
    if len(fields) == 1 and not fields[0]:
        return '""' + ending
    special = (delimiter, '"', "\n", "\r")
    return delimiter.join('"' + f.replace('"', '""') + '"' if any(s in f for s in special) else f for f in fields) + ending


def write_rows(rows: DataFrame, path: str, header: list[str] | None, encoding: str, delimiter: str, crlf: bool, rules: int = 1) -> dict:
    """Writes applied rows (row, fields, hits, error) to one file and returns their measures, of as many rules.

    If a row is in error, or text cannot be encoded, that is raised and no file is left.
    """
    spark, ending = rows.sparkSession, "\r\n" if crlf else "\n"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            at, fields, hits, errors = (c.to_pylist() for c in batch.columns)
            wrong = next(((r, e) for r, e in zip(at, errors) if e), (None, None))
            try:
                # the writer puts the last ending
                raw, unfit = encode("".join(format_row(f, delimiter, ending) for f in fields)[: -len(ending)], encoding), None
            except EncodeFailure as e:
                raw, unfit = b"", str(e)
            by_rule = list(zip(*hits))
            yield pa.RecordBatch.from_pylist(
                [{"raw": raw, "unfit": unfit, "error_row": wrong[0], "error": wrong[1], "first": at[0], "processed": len(at), "changed": sum(any(h) for h in hits), "rows": [sum(x > 0 for x in h) for h in by_rule], "sums": [sum(h) for h in by_rule]}],
                schema=pa.schema([("raw", pa.binary()), ("unfit", pa.string()), ("error_row", pa.int64()), ("error", pa.string()), ("first", pa.int64()), ("processed", pa.int64()), ("changed", pa.int64()), ("rows", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))]),
            )

    pieces = rows.select("row", "fields", HITS, ERROR).mapInArrow(run, "raw binary, unfit string, error_row long, error string, first long, processed long, changed long, rows array<long>, sums array<long>")
    n = max(1, rules)
    watch = Observation()
    failed = F.min(F.when(F.col("error").isNotNull() | F.col("unfit").isNotNull(), F.struct(F.coalesce("error_row", "first").alias("row"), "error", "unfit")))
    sums = [F.sum(F.coalesce(F.get(c, F.lit(k)), F.lit(0).cast("long"))).alias(f"{c}_{k}") for c in ("rows", "sums") for k in range(n)]
    pieces = pieces.observe(watch, failed.alias("failed"), F.sum("processed").alias("processed"), F.sum("changed").alias("changed"), *sums)
    files, where = _at(spark, path)
    jvm, name = spark.sparkContext._jvm, uuid.uuid4().hex[:8]
    parts, temporary = (jvm.org.apache.hadoop.fs.Path(f"{path_url(path)}.{name}.{x}") for x in ("parts", "tmp"))
    try:
        pieces.select(F.col("raw").cast("string").alias("value")).write.option("lineSep", ending).text(parts.toString())
        m = watch.get
        if m["failed"] is not None:
            check_error({"error": m["failed"]["error"], "error_row": m["failed"]["row"]})
            raise EncodeFailure(m["failed"]["unfit"])
        head = b"" if header is None else encode(format_row(header, delimiter, ending), encoding)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        out = files.create(temporary, True)
        try:
            out.write(head)
            for part in sorted(x.getPath().toString() for x in files.listStatus(parts) if x.getPath().getName().startswith("part-")):
                source = files.open(jvm.org.apache.hadoop.fs.Path(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                finally:
                    source.close()
        finally:
            out.close()
        # a file that is there is replaced
        if files.exists(where):
            files.delete(where, False)
        files.rename(temporary, where)
    finally:
        for x in (parts, temporary, *(jvm.org.apache.hadoop.fs.Path(x.getParent(), f".{x.getName()}.crc") for x in (temporary, where))):
            files.delete(x, True)
    return {"processed": m["processed"] or 0, "changed": m["changed"] or 0} | {f"{a}_{k}": m[f"{b}_{k}"] or 0 for a, b in (("rows", "rows"), ("sum", "sums")) for k in range(n)}
