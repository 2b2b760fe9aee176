"""Token counts by a two-tier lookup of pre-token lengths.

Tier one is a compact table of the frequent pre-tokens with the number of tokens of each, broadcast to
every worker. Tier two is the worker's own bounded cache; what it does not know either is encoded by
the tokenizer's library. Pre-tokens are never shuffled: a first pass over the whole table lets every
task keep a bounded Misra-Gries summary of its pre-tokens, and only these summaries are added up.

The table holds FREQUENT pre-tokens of at most LONGEST characters: 3 MB at most. It saves work and
decides no result.

A word (between the six characters of white space, which no token, normal form or special string spans)
is not split here where that is not certain to agree: if it holds a string of a special token (which the
library's default takes for that token), or a character from U+0250 on (where normal forms and case rules
come in). It is looked up in tier two as it is; the rest of its text goes through both tiers. A null text counts as empty; an empty text has
0 bytes and 0 tokens; repeated rows give repeated results; a null id stays null; columns of other names are not looked at; very
long texts are counted in stretches; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import WORD, BoundedCache, batched, documents, of_worker, splitter, worker_key

#: Entries of the broadcast table, and characters of its longest.
FREQUENT, LONGEST = 50_000, 32
#: Counters of each task's summary.
SLOTS = 4_000
#: Bytes of pre-tokens and lengths that a worker remembers, in each of two generations.
REMEMBERED = 60_000_000
#: Token count above which ``over_limit`` is true.
LIMIT = 2048
#: The pattern of this tokenizer's file, in the syntax of the ``regex`` and the ``re`` module.
GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
QUICK = r"[{L}]+|'(?:s|t|re|ve|m|ll|d)|[{N}]|[^{S}{L}{N}]+"


class Lengths:
    """Token counts of texts by one tokenizer file that lower-cases, drops white space and splits by GENERAL."""

    def __init__(self, file: str, frequent: dict[str, int], remembered: int = REMEMBERED):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file)
        self.splits, self.frequent, self.known = splitter(GENERAL, QUICK), frequent, BoundedCache(remembered)
        special = [re.escape(t["content"]) for t in json.loads(file)["added_tokens"]]
        self.by_library = re.compile("|".join([*special, "[^\\x00-\\u024f]"])).search
        self.words = re.compile(WORD).findall

    def pieces(self, text: str):
        lower = text.lower()
        return self.splits(lower).findall(lower)

    def __call__(self, text: str) -> int:
        total = 0
        if self.by_library(text):
            whole, rest = [], []
            for word in self.words(text):
                (whole if self.by_library(word) else rest).append(word)
            total, text = self._count(whole), " ".join(rest)
        for start, stop in stretches(text):
            total += self._count(self.pieces(text[start:stop]))
        return total

    def _count(self, pieces: list[str]) -> int:
        frequent, known, older = self.frequent.get, self.known.get, self.known.older
        lengths = [frequent(p) or known(p) or older(p) for p in pieces]
        if None not in lengths:
            return sum(lengths)
        lost = [p for p, n in zip(pieces, lengths) if n is None]
        new = list(dict.fromkeys(lost))
        found = {p: len(e.ids) for p, e in zip(new, self.library.encode_batch(new, add_special_tokens=False))}
        for p, n in found.items():
            if len(p) <= 64:
                self.known.keep(p, n, len(p))
        return sum(filter(None, lengths)) + sum(map(found.__getitem__, lost))


def stretches(text: str, most: int = 1_000_000):
    """Bounds of parts of about ``most`` characters that end before white space (a very long run is one part)."""
    import re

    start, space = 0, re.compile(r"\s")
    while len(text) - start > most:
        m = space.search(text, start + most)
        if not m:
            break
        yield start, m.start()
        start = m.start()
    yield start, len(text)


def summary(pieces, counts: dict[str, int], slots: int) -> None:
    """Misra-Gries: adds the pieces to at most ``slots`` counters. Those over 1/slots of the pieces stay."""
    from collections import Counter

    for p, n in Counter(pieces).items():
        if len(p) <= LONGEST:
            counts[p] = counts.get(p, 0) + n
    if len(counts) > slots:
        cut = sorted(counts.values(), reverse=True)[slots]
        left = {p: n - cut for p, n in counts.items() if n > cut}
        counts.clear()
        counts.update(left)


def frequent_lengths(texts: DataFrame, file: str, frequent: int = FREQUENT, slots: int = SLOTS) -> dict[str, int]:
    """The most frequent pre-tokens of one text column with their token counts; at most ``frequent``."""

    def summarise(batches):
        import pyarrow as pa

        lengths, counts = Lengths(file, {}), {}
        for batch in batches:
            for t in batch.column(0):
                summary(lengths.pieces(t.as_py() or ""), counts, slots)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    sums = texts.mapInArrow(summarise, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r.piece for r in sums.orderBy(F.desc("n"), "piece").limit(frequent).select("piece").collect()]
    lengths = Lengths(file, {})
    simple = [p for p in top if not lengths.by_library(p)]
    return {p: lengths._count([p]) for p in simple}


def count_tokens(docs: DataFrame, vocab_path: str, text: str = "text", id: str = "doc_id", limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``vocab_path`` is a tokenizer file on the driver."""
    with open(vocab_path, encoding="utf-8") as f:
        file = f.read()
    batched(docs.sparkSession)
    table = frequent_lengths(docs.select(F.col(text)), file, frequent)
    context, key = docs.sparkSession.sparkContext, worker_key("token_counts")
    held = context.broadcast((file, "\n".join(table), bytes(min(n, 255) for n in table.values())))

    def run(batches):
        import pyarrow as pa

        file, pieces, ns = held.value
        lengths = of_worker(key, lambda: Lengths(file, dict(zip(pieces.split("\n"), ns)) if ns else {}))
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            n = [lengths(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    two = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return two.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str, vocab: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(vocab))
