"""Byte-level BPE by prefix dynamic programming, with exact appends, edits and decoding.

For every prefix of a byte string there is exactly one token that the encoding of the prefix can end
with. ``last[i]`` holds it for the prefix of i bytes, so an encoding is read off backwards, more bytes
can be appended without touching what is stored, and after an edit only prefixes that reach into it
are computed again.

The candidate for ``last[i]`` is any token that ends the prefix, starting where a stored prefix ends;
it is the one that may stand behind that prefix's own last token. Two tokens may stand side by side
if undoing their merges, latest first, never shows a pair at the seam that would have been merged
earlier.

Rows: a null text counts as empty; an empty text has no ids, and the digests of the empty string;
repeated rows give repeated results; a null id stays null; columns of other names are not looked at; very long texts are
encoded some pieces at a time; an empty table gives an empty result. No row is moved: the scan
feeds Arrow batches to the encoder, with the ranks (1 MB, a fixed file) broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ._shared import BoundedCache, batched, documents, groups, of_worker, splitter, worker_key

#: Bytes of pieces and ids, and of pairs of tokens, that a worker remembers, in each of two generations.
REMEMBERED, PAIRS = 80_000_000, 64_000_000
#: Characters of texts that are encoded together; longer texts are encoded so many pieces at a time.
GROUP, AT_ONCE = 1 << 19, 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class PrefixCoder:
    """Encodes pieces (byte strings that merges don't cross) and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest: dict[bytes, int] = {}  # of the tokens that end with these five bytes
        for t in ranks:
            if len(t) > 4:
                self.longest[t[-5:]] = max(self.longest.get(t[-5:], 0), len(t))
        self.most = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}  # of merged tokens, as asked for
        self.beside: dict[int, bool] = BoundedCache(PAIRS)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the token was merged from; None for a byte."""
        found = self.halves.get(token)
        if found is None:
            whole, get = self.tokens[token], self.ranks.get
            if len(whole) == 1:
                return None
            for i in range(1, len(whole)):
                a, b = get(whole[:i]), get(whole[i:])
                if a is not None and b is not None and a < token and b < token and self._stays(a, b, token):
                    found = self.halves[token] = (a, b)
                    break
        return found

    def _stays(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of a rank under ``before`` joins a and b across their seam.

        Undoes the later of the two tokens' merges, again and again: what stands at the seam then stood
        there until that merge, so any join of it must have come later.
        """
        tokens, get = self.tokens, self.ranks.get
        while True:
            joined = get(tokens[a] + tokens[b])
            if joined is not None and joined < before:
                return False
            left, right = self.split(a), self.split(b)
            if left is None and right is None:
                return True
            # merges of equal rank run from the left: the left one of two is the earlier
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]

    def fits(self, a: int, b: int) -> bool:
        known = self.beside.get(a << 32 | b)
        if known is None:
            known = self.beside.older(a << 32 | b)
            if known is None:
                known = self._stays(a, b, len(self.tokens) + 2**31)
                self.beside.keep(a << 32 | b, known)
        return known

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (which starts as [0]) for the prefixes of ``piece`` that it lacks."""
        get, longest, beside, fits = self.ranks.get, self.longest.get, self.beside.get, self.fits
        for i in range(len(last), len(piece) + 1):
            most = longest(piece[i - 5 : i], 4) if i > 4 else i
            for start in range(i - most if i > most else 0, i):
                t = get(piece[start:i])
                if t is not None:
                    if not start:
                        break
                    fit = beside(last[start] << 32 | t)
                    if fit or fit is None and fits(last[start], t):
                        break
            last.append(t)
        return last

    def read(self, last: list[int]) -> list[int]:
        ids, i = [], len(last) - 1
        while i:
            ids.append(last[i])
            i -= len(self.tokens[last[i]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.extend(piece, [0]))

    def encode_all(self, pieces):
        """(piece, ids) of many pieces, sorted: each goes on from the prefix that it shares with the one before."""
        before, last = b"", [0]
        for piece in sorted(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                yield piece, [whole]
                continue
            same, most = 0, min(len(before), len(piece))
            while same < most and before[same] == piece[same]:
                same += 1
            del last[same + 1 :]
            yield piece, self.read(self.extend(piece, last))
            before = piece

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class LivePiece:
    """A piece under edit: its encoding stays exact while bytes are appended or replaced."""

    def __init__(self, coder: PrefixCoder, piece: bytes = b""):
        self.coder, self.piece, self.last = coder, b"", [0]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.coder.extend(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Prefixes up to ``start`` keep what is stored. Behind the edit, prefixes are computed until as many in a row as the
        longest token has bytes are as before: what a prefix ends with depends on no others, so the rest is as before too."""
        rest, self.piece, self.last = self.last[end + 1 :], self.piece[:start] + new + self.piece[end:], self.last[: start + 1]
        self.coder.extend(self.piece[: start + len(new)], self.last)
        same, self.computed = 0, len(self.last)
        while len(self.last) <= len(self.piece) and same < self.coder.most:
            at = len(self.last)
            self.coder.extend(self.piece[:at], self.last)
            same = same + 1 if self.last[at] == rest[at - start - len(new) - 1] else 0
        self.computed = len(self.last)
        self.last += rest[len(self.last) - start - len(new) - 1 :]

    @property
    def ids(self) -> list[int]:
        return self.coder.read(self.last)


#: The usual pattern of this vocabulary in the standard module's syntax; alternatives that cannot start alike are in another order.
QUICK = r" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


class TextCoder:
    """Splits texts by the pattern and encodes each match; remembers the packed ids of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import public_tokenizers
        import regex

        self.coder = PrefixCoder(ranks)
        self.names = [str(i) for i in range(max(ranks.values(), default=0) + 1)]
        known = pattern == public_tokenizers.PATTERN
        self.splits = splitter(pattern, QUICK) if known else lambda text, p=regex.compile(pattern): p
        self.known: dict[str, bytes] = BoundedCache(remembered)

    def table(self, pieces: set[str]) -> dict[str, bytes]:
        """The packed ids of all these pieces."""
        get, older, keep = self.known.get, self.known.older, self.known.keep
        out = {p: get(p) or older(p) for p in pieces}
        lost = {p.encode("utf-8"): p for p, ids in out.items() if ids is None}
        for raw, ids in self.coder.encode_all(lost):
            piece = lost[raw]
            out[piece] = packed = array("I", ids).tobytes()
            if len(piece) <= 64:
                keep(piece, packed, len(piece) + len(packed))
        return out

    def packed(self, texts: list[str]):
        """For each text its ids as 32-bit numbers, in one or more parts."""
        for some in groups(texts, GROUP):
            if len(some) == 1 and len(some[0]) > GROUP:
                yield self._parts(some[0])
                continue
            pieces = [self.splits(t).findall(t) for t in some]
            of = self.table(set(chain.from_iterable(pieces))).__getitem__
            for p in pieces:
                yield (b"".join(map(of, p)),)

    def _parts(self, text: str):
        pieces = (m[0] for m in self.splits(text).finditer(text))
        while some := list(islice(pieces, AT_ONCE)):
            yield b"".join(map(self.table(set(some)).__getitem__, some))

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join(b"".join(parts) for parts in self.packed([text]))).tolist()


def _worker(held, pattern: str, make):
    """A function of Arrow batches; the coder is built once in each Python worker."""
    key = worker_key("byte_bpe")

    def run(batches):
        import pyarrow as pa

        coder = of_worker(key, lambda: TextCoder(dict(zip(*held.value)), pattern))
        for batch in batches:
            yield pa.RecordBatch.from_pydict(make(batch, coder))

    return run


def _digests(batch, coder: TextCoder, keep: bool) -> dict:
    import numpy as np
    import pyarrow as pa

    names, tokens = coder.names.__getitem__, coder.coder.tokens.__getitem__
    texts, n, of_ids, of_bytes, offsets, flat = batch.column(1), [], [], [], [0], []
    for parts in coder.packed(t.as_py() or "" for t in texts):
        ids_sha, bytes_sha, count = hashlib.sha256(), hashlib.sha256(), 0
        for packed in parts:
            if packed:
                ids = array("I", packed).tolist()
                ids_sha.update(b" " * bool(count) + " ".join(map(names, ids)).encode())
                bytes_sha.update(b"".join(map(tokens, ids)))
                count += len(ids)
                if keep:
                    flat.append(packed)
        n.append(count)
        of_ids.append(ids_sha.hexdigest())
        of_bytes.append(bytes_sha.hexdigest())
        offsets.append(offsets[-1] + count)
    out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())}
    if keep:
        out["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(flat), dtype=np.int32), pa.int32()))
    return out


def encode(docs: DataFrame, vocab_path: str, pattern: str, text: str = "text", id: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``keep_ids``, the ids themselves.

    ``ids_sha256`` digests the decimal ids joined by one space, ``decoded_sha256`` the bytes that the
    ids decode to. ``vocab_path`` is a file of base64 tokens and ranks on the driver.
    """
    ranks = read_ranks(vocab_path)
    batched(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((list(ranks), list(ranks.values())))
    schema = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        schema.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    two = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return two.mapInArrow(_worker(held, pattern, lambda batch, coder: _digests(batch, coder, keep_ids)), T.StructType(schema))


def decode(encoded: DataFrame, vocab_path: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """doc_id and text of rows with an array of ids (null: null). Ids that are no whole UTF-8 decode with U+FFFD."""
    ranks = read_ranks(vocab_path)
    batched(encoded.sparkSession)
    held = encoded.sparkSession.sparkContext.broadcast((list(ranks), list(ranks.values())))

    def run(batches):
        import pyarrow as pa

        tokens = dict(zip(held.value[1], held.value[0]))
        for batch in batches:
            texts = [None if x is None else b"".join(map(tokens.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    two = encoded.select(F.col(id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return two.mapInArrow(run, "doc_id long, text string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path(vocab), public_tokenizers.PATTERN, keep_ids=False)
