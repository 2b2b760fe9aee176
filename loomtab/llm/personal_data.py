"""Personal data: pattern matches, extended by a skip-chain conditional random field.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its test; they
always stay. The field labels the *units* of a document (what looks like an address, a number or a key) with
a kind or none. Units that a base span or a seed covers are observed; seeds are secrets in their usual forms (a value that is
assigned to a password, token or key; a cloud access key; a private key's head). The others have potentials of their
shape and of the word before; neighbouring units share a transition potential; and units that are the same number or
address, or alike (the same last digits; the same address but for dots and case), share a potential
wherever they stand: consecutive ones of such a group are joined by an edge, so a document has a number of edges
linear in its units. All potentials are fitted together, by penalised pseudo-likelihood, to the units of a bounded sample of
documents (SAMPLE, by hash of the id), labelled by base spans and seeds. Loopy message passing gives each unit's label
probabilities, in every document that has a unit that is not observed. A unit is a span of a kind if that has a probability of JOINED
and skip edges join it to an observed unit of the kind, or of ALONE otherwise. Seeds are spans too.

Rows: a null text counts as empty; without matches the counts are 0, ``spans`` is empty and
``base_sha256`` digests the empty string; repeated rows give repeated results; a null id stays null, and in the sample
counts as an id; an empty table gives an empty result. Very long texts are searched whole, in time and memory in proportion to their length.
Columns other than id and text are not looked at. Offsets are code points, the end exclusive. No row is moved.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import batched, documents, of_worker, worker_key

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds whose patterns are the base.
BASE = 4
#: Documents to learn from, at most, by smallest hash of the id.
SAMPLE = 4000
#: Potentials towards which those of equal labels of the same (alike) units are drawn.
SAME, ALIKE = 4.0, 2.5
#: Rounds and damping of messages; probabilities of added spans.
ROUNDS, DAMPING, JOINED, ALONE = 30, 0.5, 0.6, 0.95
#: Buckets of words before a unit; steps of the fit, its penalty.
WORDS, STEPS, PENALTY = 4096, 300, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start where a run of digits starts, so the look-behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# fixed values: usual forms of secrets
_SEED = re.compile(
    r"(?i:(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>(?=[^\s\"']{0,40}[0-9])[A-Za-z0-9_/+.=-]{8,})"
    r"|(?<![A-Za-z0-9])(?P<key>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,})(?![A-Za-z0-9])"
    r"|(?P<head>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"
)
_UNIT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)*"
    r"|(?<![A-Za-z0-9_])(?=[0-9_-]{0,40}[A-Za-z])(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_]{12,}+"
    r"|(?<![A-Za-z0-9_])\+?\(?[0-9](?:[0-9 ().-]*[0-9])?(?![A-Za-z0-9_])"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Matches of local@domain, found from each @ backwards, which takes time linear in the text."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = max(at + 1, m.end() if m else 0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ordered."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of secrets in their usual forms."""
    return [(*m.span(m.lastgroup)[:1], BASE, m.span(m.lastgroup)[1]) for m in _SEED.finditer(text)]


def units(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, label, word before): what looks like an address, a number or a key; label 0 if no known span touches it, else kind + 1."""
    # of each kind spans do not overlap, so their ends are in order too
    by_kind = [([b[0] for b in known if b[1] == k], [b[2] for b in known if b[1] == k]) for k in range(len(KINDS))]
    out, before = [], 0
    for m in _UNIT.finditer(text):
        start, end = m.span()
        label = 0
        for k, (starts, ends) in enumerate(by_kind):
            i = bisect_right(ends, start)
            if i < len(starts) and starts[i] < end:
                label = k + 1
                break
        at = start
        while at > before and not text[at - 1].isalnum():
            at -= 1
        stop = at
        while at > before and text[at - 1].isalpha():
            at -= 1
        out.append((start, end, label, text[at:stop].lower()))
        before = end
    return out


def shape(text: str, start: int, end: int, word: str) -> tuple[str, str, int]:
    """What potentials may look at; nothing that decides a base match (a plus, a check digit)."""
    unit = text[start:end]
    digits = sum(map(str.isdigit, unit))
    if "@" in unit or re.search(r"[\[(](?:at|dot)[\])]", unit):
        kind = "at"
    elif any(map(str.isalpha, unit)):
        kind = "key:" + ("hex" if not unit.lower().strip("0123456789abcdef") else "upper" if unit == unit.upper() else "mixed") + f":{min(len(unit), 64) // 4}"
    else:
        kind = "dots" if unit.count(".") >= 3 else "number"
    return f"{kind}:{min(digits, 20)}" if kind[:3] != "key" else kind, f"groups:{min(5, len(re.findall('[0-9]+', unit)))}:{'.' in unit}:{'(' in unit}", zlib.crc32(word.encode()) % WORDS


def keys(text: str, start: int, end: int) -> tuple[str, str] | None:
    """(same, alike) of a unit; None if too little of it to compare."""
    unit = text[start:end]
    if any(map(str.isalpha, unit)):
        plain = re.sub(r" ?[\[(]at[\])] ?", "@", unit)
        plain = re.sub(r" ?[\[(]dot[\])] ?", ".", plain).lower()
        return plain, re.sub(r"[._%+-]", "", plain)
    digits = "".join(filter(str.isdigit, unit))
    if len(digits) < 7:
        return None
    return (unit, unit) if unit.count(".") >= 3 else (digits, digits[-7:])


def skips(text: str, found) -> dict[tuple[int, int], int]:
    """Skip edges: 0 between consecutive units that are the same, 1 if they are alike only."""
    groups: dict[tuple, list[int]] = {}
    for i, (start, end, _, _) in enumerate(found):
        if k := keys(text, start, end):
            for alike in (0, 1):
                groups.setdefault((alike, k[alike]), []).append(i)
    out: dict[tuple[int, int], int] = {}
    for (alike, _), of in groups.items():
        for edge in zip(of, of[1:]):
            out[edge] = min(alike, out.get(edge, 1))
    return out


class Field:
    """Potentials: weight[feature][label] (a missing feature adds nothing), transition[label][label], and of equal labels on skip edges."""

    def __init__(self, weight: dict, transition, same: float = SAME, alike: float = ALIKE):
        self.weight, self.transition, self.skip = weight, transition, (same, alike)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans beside the base ones: seeds, and what message passing finds."""
        seen = sorted(seeds(text))
        found = units(text, sorted(base + seen))
        if all(u[2] for u in found):
            return seen
        edges = skips(text, found)
        # the kinds of observed units to which skip edges join a unit
        root = list(range(len(found)))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in edges:
            root[top(a)] = top(b)
        joined: dict[int, set[int]] = {}
        for i, u in enumerate(found):
            if u[2]:
                joined.setdefault(top(i), set()).add(u[2])
        p = self.marginals(text, found, edges)
        out = []
        for i, (start, end, label, _) in enumerate(found):
            best = int(p[i][1:].argmax()) + 1
            if not label and p[i][best] >= (JOINED if best in joined.get(top(i), ()) else ALONE):
                out.append((start, best - 1, end))
        return seen + out

    def marginals(self, text: str, found, edges):
        import numpy as np

        n, labels = len(found), len(KINDS) + 1
        own = np.zeros((n, labels))
        for i, (start, end, label, word) in enumerate(found):
            if label:
                own[i] = -50
                own[i, label] = 0
            else:
                for f in shape(text, start, end, word):
                    own[i] += self.weight.get(f, 0.0)
        transition = np.array(self.transition, dtype=float)
        pairs = [(a, a + 1, transition) for a in range(n - 1)] + [(a, b, np.eye(labels) * self.skip[alike]) for (a, b), alike in edges.items()]
        return beliefs(own, pairs)


def beliefs(own, pairs):
    """Label probabilities of nodes with log potentials ``own`` and pairs (a, b, log potentials), by loopy message passing."""
    import numpy as np

    if not pairs:
        p = np.exp(own - own.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    src = np.array([e[0] for e in pairs] + [e[1] for e in pairs])
    dst = np.array([e[1] for e in pairs] + [e[0] for e in pairs])
    pot = np.exp(np.stack([e[2] for e in pairs] + [e[2].T for e in pairs]))
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.zeros((len(src), own.shape[1]))
    for _ in range(ROUNDS):
        belief = own.copy()
        np.add.at(belief, dst, message)
        out = belief[src] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("el,elk->ek", out, pot) + 1e-300)
        new -= new.max(1, keepdims=True)
        change = np.abs(new - message).max()
        message = DAMPING * message + (1 - DAMPING) * new
        if change < 1e-4:
            break
    belief = own.copy()
    np.add.at(belief, dst, message)
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def examples(text: str):
    """For each unit (label, its features, label before, label behind, labels of the same and of alike units): what pseudo-likelihood looks at."""
    found = units(text, sorted(base_spans(text) + seeds(text)))
    near: list[tuple[list[int], list[int]]] = [([], []) for _ in found]
    for (a, b), alike in skips(text, found).items():
        near[a][alike].append(found[b][2])
        near[b][alike].append(found[a][2])
    for i, (start, end, label, word) in enumerate(found):
        sides = [found[j][2] if 0 <= j < len(found) else -1 for j in (i - 1, i + 1)]
        yield (label, *shape(text, start, end, word), *sides, *("".join(map(str, sorted(x))) for x in near[i]))


def fit(counted: list[tuple], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Potentials from counted examples (..., count), by maximum penalised pseudo-likelihood (AdaGrad)."""
    import numpy as np

    labels = len(KINDS) + 1
    if not counted:
        return Field({}, np.zeros((labels, labels)))
    names = sorted({f for r in counted for f in r[1:4]}, key=str)
    index = {f: i for i, f in enumerate(names)}
    y = np.array([r[0] for r in counted])
    x = np.array([[index[f] for f in r[1:4]] for r in counted])
    before, behind = (np.array([r[k] for r in counted]) for k in (4, 5))
    # how many units of each label skip edges join
    near = np.zeros((2, len(counted), labels))
    for i, r in enumerate(counted):
        for alike in (0, 1):
            for c in r[6 + alike]:
                near[alike, i, int(c)] += 1
    n = np.array([r[8] for r in counted], dtype=float)
    w, t, skip, prior = np.zeros((len(names), labels)), np.zeros((labels, labels)), np.array([SAME, ALIKE]), np.array([SAME, ALIKE])
    squares = [np.full(a.shape, 1e-6) for a in (w, t, skip)]
    hot, has, follows = np.eye(labels)[y], before >= 0, behind >= 0
    for _ in range(steps):
        z = w[x].sum(1) + skip[0] * near[0] + skip[1] * near[1]
        z[has] += t[before[has]]
        z[follows] += t[:, behind[follows]].T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (hot - p) * n[:, None]
        dw, dt = -penalty * w, -penalty * t
        for k in range(3):
            np.add.at(dw, x[:, k], g)
        np.add.at(dt, before[has], g[has])
        np.add.at(dt.T, behind[follows], g[follows])
        ds = (near * g).sum((1, 2)) - penalty * (skip - prior)
        for a, d, s in zip((w, t, skip), (dw, dt, ds), squares):
            s += d * d
            a += 0.5 * d / np.sqrt(s)
    return Field({f: w[i] for f, i in index.items()}, t, float(skip[0]), float(skip[1]))


def train(docs: DataFrame, text: str = "text", id: str = "doc_id", sample: int = SAMPLE) -> Field:
    """The field of the units of a sample of documents."""
    some = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(id).cast("string"), F.lit(3)).alias("h")).filter(F.col("t").rlike("[0-9@]"))
    # the sample is taken by hash alone; its texts are read again where they lie
    bound = some.select("h").orderBy("h").limit(sample).agg(F.max("h").alias("h")).collect()[0]["h"]
    names = ["label", "f0", "f1", "f2", "before", "behind", "same", "alike"]

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(examples(t.as_py()))
        rows = list(counts)
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(names, kinds))} | {"n": pa.array(list(counts.values()), pa.int64())})

    if bound is None:
        return fit([])
    schema = "label int, f0 string, f1 string, f2 int, before int, behind int, same string, alike string, n long"
    counted = some.filter(F.col("h") <= bound).select("t").mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))
    return fit([tuple(r) for r in counted.orderBy(*names).toLocalIterator()])


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, text: str = "text", id: str = "doc_id", sample: int = SAMPLE, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans. The first counts are of base spans."""
    batched(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(field or train(docs, text, id, sample))
    key = worker_key("personal_data")

    def run(batches):
        import pyarrow as pa

        field = of_worker(key, lambda: held.value)
        for batch in batches:
            n, digests, spans, more = [[] for _ in range(BASE)], [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                new = field.added(t, base)
                for k in range(BASE):
                    n[k].append(sum(b[1] == k for b in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + new))
                more.append(len(new))
            columns = {"doc_id": batch.column(0)} | {f"n_{name}": pa.array(x, pa.int64()) for name, x in zip(KINDS, n)}
            total = [sum(x) for x in zip(*n, more)]
            yield pa.RecordBatch.from_pydict(columns | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string()), "n_added": pa.array(more, pa.int64()), "n_spans": pa.array(total, pa.int64())})

    two = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return two.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
