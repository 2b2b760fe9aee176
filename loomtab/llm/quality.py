"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score = logistic(bias + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j), where the pairwise part is
half of sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2: linear in the number of features.

Features: each distinct word, hashed to 2^BITS slots, weighs 1 + log(count), the weights of a text
scaled to length 1; STATISTICS of its characters, words and lines; and whole-number metadata columns
(``n_chars`` here) by their logarithm. Labels, language, source and id are never inputs.

Learned from a bounded sample of labelled rows: the SAMPLE rows with the smallest hash of the id among
those that may be learned from (crc32 of the id as text, mod 4, is not 2; both labels, a text). Their
features, not their texts, come to the driver: 2^BITS slots each at most, whatever a text's length. If several
documents have the id, the one of the least features counts, so that reruns learn the same.

Rows: a null text counts as empty; an empty text is scored by its statistics (all 0) alone; null
metadata counts as 0; without labels every score is 0.5 (predicted 0). If a document has several labels, each
counts. Repeated rows give repeated results; a null id is not held out and has no label; columns of other names are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import batched, documents, of_worker, worker_key

#: Labelled rows to learn from, at most.
SAMPLE = 8000
#: Hash slots of words (a power of 2), factors, rounds over the sample, rows of a step, learning rate, decay.
BITS, FACTORS, ROUNDS, STEP, RATE, DECAY = 15, 8, 6, 64, 0.05, 1e-5
#: Score from which label 1 is predicted.
THRESHOLD = 0.7
STATISTICS = (
    "log words", "word length", "upper-case share", "symbol share", "digit share", "non-ASCII share", "distinct words share", "words that repeat the one before",
    "words without a letter or digit", "words that end with a symbol", "log lines", "words a line", "most frequent word's share", "words in upper case", "lines that repeat",
)

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_PLAIN = _LETTERS + _DIGITS + b" \t\n\x0b\x0c\r.,;:'\"?-" + bytes(range(128, 256))
_ENDS = frozenset("!#$%&*+/<=>@\\^_`{|}~")


def features(text: str, metadata=()) -> tuple:
    """(slots, weights) of the words, and the dense statistics with the metadata behind."""
    import zlib
    from collections import Counter

    import numpy as np

    words = text.split()
    dense = np.zeros(len(STATISTICS) + len(metadata), dtype=np.float32)
    for i, m in enumerate(metadata):
        dense[len(STATISTICS) + i] = math.log1p(max(0, m or 0)) / 10
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), dense
    counts, raw = Counter(words), text.encode()
    n, size = len(words), max(1, len(raw))
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    lines = [x for x in text.split("\n") if x]
    dense[: len(STATISTICS)] = (
        math.log(n + 1) / 10, min(5.0, size / n / 10), (len(raw) - len(raw.translate(None, _UPPER))) / max(1, letters), len(raw.translate(None, _PLAIN)) / size,
        (len(raw) - len(raw.translate(None, _DIGITS))) / size, (size - len(text)) / size, len(counts) / n, sum(map(str.__eq__, words, words[1:])) / n,
        sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / n, sum(c for w, c in counts.items() if w[-1] in _ENDS) / n, math.log(len(lines) + 1) / 10,
        min(5.0, n / max(1, len(lines)) / 50), counts.most_common(1)[0][1] / n, sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n, 1 - len(set(lines)) / max(1, len(lines)),
    )
    mask = (1 << BITS) - 1
    slots = np.fromiter((zlib.crc32(w.encode()) & mask for w in counts), np.int32, len(counts))
    weights = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(slots) > 1 << (BITS - 3):  # in a long text words share slots
        weights = np.bincount(slots, weights, 1 << BITS).astype(np.float32)
        slots = np.flatnonzero(weights).astype(np.int32)
        weights = weights[slots]
    return slots, (weights / math.sqrt(float(weights @ weights))).astype(np.float32), dense


class Machine:
    """Weights and factors: hashed words first, dense features behind."""

    def __init__(self, dense: int, factors: int = FACTORS, seed: int = 5):
        import numpy as np

        self.first = 1 << BITS
        n = self.first + dense
        self.bias, self.w = 0.0, np.zeros(n, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, factors)).astype(np.float32)

    def _inputs(self, slots, weights, dense):
        import numpy as np

        return np.concatenate([slots, np.arange(self.first, self.first + len(dense), dtype=np.int32)]), np.concatenate([weights, dense])

    def raw(self, slots, weights, dense) -> float:
        i, x = self._inputs(slots, weights, dense)
        vx = self.v[i] * x[:, None]
        s = vx.sum(axis=0)
        return float(self.bias + self.w[i] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, text: str, metadata=()) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.raw(*features(text, metadata))))))

    def learn(self, rows: list, labels: list[int], rounds: int = ROUNDS, seed: int = 11) -> "Machine":
        """Logistic loss by AdaGrad, in steps of STEP rows; the rarer label weighs more, half of the way to balance."""
        import numpy as np

        random, both = np.random.default_rng(seed), [self._inputs(*r) for r in rows]
        y = np.array(labels, dtype=np.float32)
        share = float(y.mean()) if len(y) else 0.0
        if not 0 < share < 1:
            self.bias = 0.0 if not len(y) else 4.0 if share == 1 else -4.0
            self.v[:] = 0
            return self
        of = np.where(y == 1, 1 / math.sqrt(share), 1 / math.sqrt(1 - share))
        of /= of.mean()
        gw, gv, gb = np.full(self.w.shape, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        for _ in range(rounds):
            for part in np.array_split(random.permutation(len(y)), max(1, len(y) // STEP)):
                i = np.concatenate([both[r][0] for r in part])
                x = np.concatenate([both[r][1] for r in part])
                row = np.repeat(np.arange(len(part)), [len(both[r][0]) for r in part])
                vx = self.v[i] * x[:, None]
                starts = np.searchsorted(row, np.arange(len(part)))
                s = np.add.reduceat(vx, starts, axis=0)
                z = self.bias + np.add.reduceat(self.w[i] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * of[part] / len(part)
                slots, at = np.unique(i, return_inverse=True)
                gx = g[row] * x
                dw = np.bincount(at, gx, len(slots)).astype(np.float32) + DECAY * self.w[slots]
                each = gx[:, None] * (s[row] - vx)
                dv = np.stack([np.bincount(at, each[:, f], len(slots)) for f in range(self.v.shape[1])], 1).astype(np.float32) + DECAY * self.v[slots]
                gw[slots] += dw * dw
                gv[slots] += dv * dv
                self.w[slots] -= RATE * dw / np.sqrt(gw[slots])
                self.v[slots] -= RATE * dv / np.sqrt(gv[slots])
                gb += float(g.sum()) ** 2
                self.bias -= RATE * float(g.sum()) / math.sqrt(gb)
        return self


def held_out(id):
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", metadata=("n_chars",), sample: int = SAMPLE) -> Machine:
    chosen = labels.select(F.col(id).alias("id_"), F.col(label).cast("int").alias("label_")).filter(F.col("id_").isNotNull() & F.col("label_").isin(0, 1) & ~held_out(F.col("id_")))
    chosen = chosen.orderBy(F.xxhash64(F.col("id_").cast("string")), "id_", "label_").limit(sample)
    rows = docs.select(F.col(id).alias("id_"), F.col(text).alias("text_"), *[F.col(m).cast("long").alias(f"m{i}") for i, m in enumerate(metadata)])
    rows = rows.filter(F.col("text_").isNotNull()).join(F.broadcast(chosen), "id_")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            meta = list(zip(*[c.to_pylist() for c in batch.columns[3:]])) if metadata else [()] * len(batch)
            found = [features(t.as_py(), m) for t, m in zip(batch.column(2), meta)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(pa.string()), "label": batch.column(1), "parts": pa.array([[p.tobytes() for p in f] for f in found], pa.list_(pa.binary()))})

    import numpy as np

    found = rows.select("id_", "label_", "text_", *[f"m{i}" for i in range(len(metadata))]).mapInArrow(run, "id string, label int, parts array<binary>")
    found = found.groupBy("id", "label").agg(F.min("parts").alias("parts")).orderBy("id", "label").collect()
    kinds = (np.int32, np.float32, np.float32)
    machine = Machine(len(STATISTICS) + len(metadata))
    return machine.learn([[np.frombuffer(p, k) for p, k in zip(r["parts"], kinds)] for r in found], [r["label"] for r in found])


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", metadata=("n_chars",), threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    batched(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text, id, label, metadata, sample))
    key = worker_key("quality")

    def run(batches):
        import pyarrow as pa

        machine = of_worker(key, lambda: held.value)
        for batch in batches:
            meta = list(zip(*[c.to_pylist() for c in batch.columns[3:]])) if metadata else [()] * len(batch)
            scores = [machine.score(t.as_py() or "", m) for t, m in zip(batch.column(2), meta)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())})

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), held_out(F.col(id)).alias("held_out"), F.col(text).alias("text_"), *[F.col(m).cast("long").alias(f"m{i}") for i, m in enumerate(metadata)])
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
