"""What several operators need: written tables, bounded worker caches, checks of input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The six characters that count as white space in every contract here.
SPACE = " \t\n\x0b\x0c\r"
#: A word is a longest run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that most queries read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Folders of our own, by application, where no cluster is there to name one.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see; one of our own only in local mode and where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        import tempfile

        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='loomtab-')}"
    return _own[context.applicationId]


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    files, where = _at(spark, path)
    files.delete(where, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    The folder is removed when the session's JVM ends, as the result is lazy and may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomtab-{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    files, where = _at(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


#: Rows that go to a Python worker at once, unless the session says otherwise.
BATCH = 1000


def batched(spark: SparkSession) -> None:
    """Keeps what the JVM and a Python worker hold of whole texts at once small.

    Sets the session's number of rows in an Arrow batch, if none is set: it is read when a query runs, not when it is made.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


#: Characters of texts that are split into pieces at once.
TOGETHER = 1 << 18


def groups(texts, most: int = TOGETHER):
    """Lists of consecutive texts of so many characters at most, or of one longer text."""
    some, held = [], 0
    for t in texts:
        if some and held + len(t) > most:
            yield some
            some, held = [], 0
        some.append(t)
        held += len(t)
    if some:
        yield some


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: Bytes that an entry of a cache takes besides those of its strings.
ENTRY = 200


class BoundedCache(dict):
    """Worker-side memo of two generations: what is asked for again outlives what was met once.

    ``get`` sees the young generation; a miss goes through ``older``. The entries of a generation take at most
    ``most`` bytes; what is kept comes with the length of its strings.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def older(self, key):
        """The value that the older generation has for the key (now young again), or None."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value, 64)
        return value

    def keep(self, key, value, length: int = 0) -> None:
        self.held += ENTRY + length
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = ENTRY
        self[key] = value


#: Characters for which the splitters below use explicit classes in the standard ``re`` module.
NARROW = 0x250


def narrow_class(category: str) -> str:
    """The characters under NARROW of a class of the ``regex`` module, as the inside of a set."""
    import regex

    of = regex.compile(category)
    return "".join(f"\\u{i:04x}" for i in range(NARROW) if of.match(chr(i)))


def splitter(general: str, narrow: str):
    """A findall by ``general`` (``regex`` syntax) that takes the quicker ``narrow`` (``re`` syntax, with
    {L}, {N}, {S} for the classes) for texts without characters from NARROW on. Both must agree there.
    """
    import re

    import regex

    wide = re.compile(f"[^\\x00-\\u{NARROW - 1:04x}]").search
    slow = regex.compile(general)
    quick = re.compile(narrow.format(L=narrow_class(r"\p{L}"), N=narrow_class(r"\p{N}"), S=narrow_class(r"\s")))
    return lambda text: slow if wide(text) else quick


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the input does not use, so extra columns cannot clash with ours."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: The one thing that a Python worker keeps from task to task: its key and what it is.
_of_worker: list = [None, None]


def of_worker(key: str, make):
    """What ``make`` returns, made once in each Python worker for a key and kept from task to task.

    Only the latest is kept: a worker that goes on to another operator's tasks drops what the last one left.
    """
    if _of_worker[0] != key:
        _of_worker[:] = None, None
        give_back()
        _of_worker[:] = key, make()
    return _of_worker[1]


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_key(kind: str) -> str:
    return f"{kind}:{uuid.uuid4().hex}"
