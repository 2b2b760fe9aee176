"""Language identification by unigrams over pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. A language is a probability for each piece; a
word's probability is the sum, over every way to cut it into pieces, of the product of their
probabilities, by the forward algorithm. A text's score for a language is the sum of its words' log
probabilities and the log of the language's share among the labelled rows. Piece probabilities are
fitted by expectation maximisation (forward-backward over all segmentations) on all words of a bounded
sample of labelled rows: for each language, rows by a hash of the id, of about LETTERS characters together. Runs of
more than TOGETHER letters are fitted in parts of so many; they are scored whole.

Words are the runs of letters of the lower-cased text, with the vocabulary's mark for a word's start.
A letter that the vocabulary lacks is an unknown piece of small probability in every language.

Rows: ``und`` with score 0 for a text that is null or has no letter; otherwise the likeliest language
(ties: first by code point) and its posterior probability. If no row is labelled, every text is ``und``.
Repeated rows give repeated results; an empty table gives an empty result. Language, source and id
are no inputs of a prediction; the id only decides which rows may be learned from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import BoundedCache, batched, documents, groups, of_worker, splitter, worker_key

#: Characters of a language's rows to learn from, about.
LETTERS = 2_000_000
#: Rounds of expectation maximisation, and what is added to each piece's expected count.
ROUNDS, ADDED = 4, 0.05
#: Times its language's usual (negative) log probability a letter from which a text is strange: letter junk, another language.
STRANGE = 3.0
#: Probability of an unknown letter.
UNKNOWN = 1e-7
#: Words up to so many letters are scored together; longer ones one by one.
TOGETHER = 40
#: Bytes of words and scores that a worker remembers, in each of two generations.
REMEMBERED = 16_000_000
MARK = "▁"


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentence-piece model that are made of letters, with or without the mark."""
    import regex
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    fits = regex.compile(rf"{MARK}?\p{{L}}*").fullmatch
    return sorted({p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)) and fits(p) and p.lower() == p})


class Lattice:
    """The pieces of words: for each position, which pieces end there and where they start."""

    def __init__(self, pieces: list[str]):
        import ahocorasick

        self.unknown, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.found = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.found.add_word(p, i << 8 | len(p))
        self.found.make_automaton()
        self.letters = {p for p in pieces if len(p) == 1}

    def edges(self, words: list[str], mark: str = MARK):
        """Arrays (end, word, start, piece) over all the words, ordered by end."""
        import numpy as np

        # no piece has the separator, so one search finds the pieces of all words
        text = mark + f" {mark}".join(words)
        hits = np.fromiter((end << 34 | v for end, v in self.found.iter(text)) if len(self.found) else [], np.int64)
        lone = np.array([i for i, c in enumerate(text) if c not in self.letters and c != " "] if set(text) - self.letters - {" "} else [], dtype=np.int64)
        first = np.cumsum([0, *[len(w) + len(mark) + 1 for w in words]])
        at = np.concatenate([hits >> 34, lone]) + 1
        length = np.concatenate([hits & 0xFF, np.ones(len(lone), np.int64)])
        piece = np.concatenate([hits >> 8 & 0x3FFFFFF, np.full(len(lone), self.unknown)])
        word = np.searchsorted(first, at - 1, "right") - 1
        end = at - first[word]
        order = np.argsort(end, kind="stable")
        return end[order], word[order], (end - length)[order], piece[order]


def forward(edges, words: int, probability):
    """alpha[position, word, language]; ``probability``[piece, language], the unknown piece last."""
    import numpy as np

    end, word, start, piece = edges
    size = int(end.max()) if len(end) else 0
    alpha = np.zeros((size + 1, words, probability.shape[1]))
    alpha[0] = 1
    cuts = np.searchsorted(end, np.arange(size + 2))
    for i in range(1, size + 1):
        a, b = cuts[i], cuts[i + 1]
        if a < b:
            part = alpha[start[a:b], word[a:b]] * probability[piece[a:b]]
            # a word's edges stand together: the words are in order for each end
            first = np.flatnonzero(np.concatenate(([True], word[a + 1 : b] != word[a : b - 1])))
            alpha[i, word[a:b][first]] = np.add.reduceat(part, first, axis=0)
    return alpha


def log_probabilities(lattice: Lattice, words: list[str], probability):
    """[word, language]: log of the sum over all segmentations."""
    import numpy as np

    out = np.zeros((len(words), probability.shape[1]))
    short = sorted((i for i, w in enumerate(words) if len(w) <= TOGETHER), key=lambda i: len(words[i]))
    for part in range(0, len(short), 4096):  # words of like lengths together
        at = short[part : part + 4096]
        some = [words[i] for i in at]
        alpha = forward(lattice.edges(some), len(some), probability)
        out[at] = np.log(alpha[np.array([len(w) + 1 for w in some]), np.arange(len(some))])
    for i, w in enumerate(words):
        if len(w) > TOGETHER:
            out[i] = _long(lattice, w, probability)
    return out


def _long(lattice: Lattice, word: str, probability):
    """The same for one word of any length: only the last positions are kept, rescaled as they shrink."""
    import numpy as np

    languages = probability.shape[1]
    total, step = np.zeros(languages), 4096
    kept = [np.ones(languages)]  # alpha of the last positions, the latest last
    s, at = MARK + word, 0
    while at < len(s):
        # edges of a part, found with the letters before it that a piece may start with
        before = min(at, lattice.longest - 1)
        end, _, start, piece = lattice.edges([s[at - before : at + step]], "")
        cuts = np.searchsorted(end, np.arange(before + step + 2))
        for i in range(before + 1, min(len(s) - at, step) + before + 1):
            a, b = cuts[i], cuts[i + 1]
            here = sum(kept[j - i] * probability[p] for j, p in zip(start[a:b].tolist(), piece[a:b].tolist()))
            kept.append(here)
            del kept[: -lattice.longest - 1]
            scale = here.copy()
            kept = [x / scale for x in kept]
            total += np.log(scale)
        at += step
    return total


def fit(lattice: Lattice, counted: dict[str, dict[str, int]], rounds: int = ROUNDS, added: float = ADDED):
    """probability[piece, language] from words with their counts, for each language, in the dict's order."""
    import numpy as np

    n = lattice.unknown + 1
    out = np.full((n, len(counted)), 1.0 / n)
    for k, words in enumerate(counted.values()):
        some: dict[str, int] = {}
        for w, c in words.items():
            for at in range(0, len(w), TOGETHER):
                part = w[at : at + TOGETHER]
                some[part] = some.get(part, 0) + c
        if not some:
            continue
        end, word, start, piece = edges = lattice.edges(list(some))
        lengths, weights = np.array([len(w) + 1 for w in some]), np.array(list(some.values()), dtype=float)
        cuts = np.searchsorted(end, np.arange(int(end.max()) + 2))
        # first guess: every piece found, weighted by its length
        expected = np.bincount(piece, weights[word] * (end - start) ** 2, n)
        for _ in range(rounds):
            p = (expected + added) / (expected[:-1].sum() + added * n)
            p[-1] = UNKNOWN
            alpha = forward(edges, len(some), p[:, None])[:, :, 0]
            whole = alpha[lengths, np.arange(len(some))]
            beta = np.zeros_like(alpha)
            beta[lengths, np.arange(len(some))] = 1
            expected = np.zeros(n)
            for i in range(len(cuts) - 2, 0, -1):
                a, b = cuts[i], cuts[i + 1]
                inner = p[piece[a:b]] * beta[i, word[a:b]]
                np.add.at(beta, (start[a:b], word[a:b]), inner)
                expected += np.bincount(piece[a:b], alpha[start[a:b], word[a:b]] * inner * (weights / whole)[word[a:b]], n)
        p = (expected + added) / (expected[:-1].sum() + added * n)
        p[-1] = UNKNOWN
        out[:, k] = p
    return out


def letters():
    """A function that gives the words of a text."""
    split = splitter(r"\p{L}+", "[{L}]+")

    def words(text: str) -> list[str]:
        lower = text.lower()
        return split(lower).findall(lower)

    return words


def held_out(id):
    return F.crc32(id.cast("string").cast("binary")) % 4 == 2


def training_words(docs: DataFrame, text: str, lang: str, id: str, letters_: int = LETTERS) -> tuple[dict[str, dict[str, int]], dict[str, int]]:
    """Word counts of each language's sample, and the number of labelled rows of each language.

    The rows are counted over the whole table, and every language is learned; a language's sample takes each of its rows with a
    chance, by a hash of the id, that makes about ``letters_`` characters.
    """
    may = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col(id)), F.lit(False)))
    may = may.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(id).alias("id"))
    sizes = may.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("letters")).collect()
    if not sizes:
        return {}, {}
    chances = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, letters_ / max(1, r["letters"]))) for r in sizes], "lang string, chance double")
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = may.join(F.broadcast(chances), "lang").filter(draw < F.col("chance"))

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        find, counts = letters(), Counter()
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.update((name, w) for w in find(t.as_py()))
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in counts], pa.string()), "word": pa.array([k[1] for k in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {name: {} for name in sorted(r["lang"] for r in sizes)}
    for r in counted.orderBy("lang", F.desc("n"), "word").toLocalIterator():
        out[r["lang"]][r["word"]] = r["n"]
    return out, {r["lang"]: r["n"] for r in sizes}


def usual(lattice: Lattice, counted: dict[str, dict[str, int]], probability):
    """Each language's log probability a letter (a word's start counts as one) over the words that it was learned from."""
    import numpy as np

    out = np.full(len(counted), -np.inf)
    for k, words in enumerate(counted.values()):
        if words:
            n = np.array(list(words.values()), dtype=float)
            letters = n @ np.array([len(w) + 1 for w in words])
            out[k] = n @ log_probabilities(lattice, list(words), probability[:, [k]])[:, 0] / letters
    return out


class Scorer:
    def __init__(self, pieces: list[str], probability, names: list[str], prior, usual, remembered: int = REMEMBERED):
        self.lattice, self.probability, self.names, self.prior, self.usual = Lattice(pieces), probability, names, prior, usual
        self.words, self.known = letters(), BoundedCache(remembered)

    def table(self, words: set[str]) -> dict[str, bytes]:
        """Each word's log probabilities, packed."""
        get, older, keep = self.known.get, self.known.older, self.known.keep
        out = {w: get(w) or older(w) for w in words}
        lost = [w for w, r in out.items() if r is None]
        if lost:
            found = log_probabilities(self.lattice, lost, self.probability)
            for w, r in zip(lost, found):
                out[w] = r = r.tobytes()
                if len(w) <= TOGETHER:
                    keep(w, r, len(w) + len(r))
        return out

    def predict(self, texts):
        """For each text language, posterior, and how many times the language's usual log probability a letter the text's is."""
        for some in groups(texts):
            words = [self.words(t) for t in some]
            of = self.table({w for x in words for w in x} if self.names else set()).__getitem__
            for x in words:
                yield self._best(list(map(of, x)), sum(map(len, x)) + len(x)) if x and self.names else ("und", 0.0, 0.0)

    def _best(self, rows: list[bytes], letters: int) -> tuple[str, float, float]:
        import numpy as np

        own = np.frombuffer(b"".join(rows)).reshape(len(rows), -1).sum(axis=0)
        s = own + self.prior
        best = int(s.argmax())
        return self.names[best], float(1 / np.exp(np.maximum(-700.0, s - s[best])).sum()), float(own[best] / letters / self.usual[best])


def train(docs: DataFrame, vocab_path: str, text: str = "text", lang: str = "lang", id: str = "doc_id", letters_: int = LETTERS):
    """(pieces, probability, names, prior, usual): what a Scorer takes."""
    import numpy as np

    counted, sizes = training_words(docs, text, lang, id, letters_)
    pieces = vocabulary(vocab_path)
    lattice = Lattice(pieces)
    probability = fit(lattice, counted)
    prior = np.log(np.array([sizes[k] for k in counted], dtype=float) / max(1, sum(sizes.values()))) if counted else np.zeros(0)
    return pieces, probability, list(counted), prior, usual(lattice, counted, probability)


def identify(docs: DataFrame, vocab_path: str, text: str = "text", lang: str = "lang", id: str = "doc_id", keep: list[str] | None = None, model=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score; or the columns ``keep`` with lang_pred, score and strange in front."""
    from pyspark.sql import types as T

    batched(docs.sparkSession)
    key = worker_key("language_id")
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, vocab_path, text, lang, id))

    def run(batches):
        import pyarrow as pa

        scorer = of_worker(key, lambda: Scorer(*held.value))
        for batch in batches:
            found = list(scorer.predict(t.as_py() or "" for t in batch.column(0)))
            front = [pa.array([x[0] for x in found], pa.string()), *[pa.array([x[k] for x in found], pa.float64()) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*front, *batch.columns[1:]], names=made.names)

    rest = [F.col(id).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id)), F.lit(False)).alias("held_out")] if keep is None else [F.col(f"`{c}`") for c in keep]
    some = docs.select(F.col(text).alias("text_"), *rest)
    made = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("strange", T.DoubleType()), *some.schema.fields[1:]])
    out = some.mapInArrow(run, made)
    return out.drop("strange") if keep is None else out


def keep_identified(docs: DataFrame, vocab_path: str, text: str = "text", lang: str = "lang", id: str = "doc_id", least: float = 0.5, strange: float = STRANGE) -> DataFrame:
    """The documents with a predicted language of probability ``least`` at least; those without letters go.

    So do those that are ``strange`` times as unlikely a letter as the words of that language (in logarithms) or more,
    since the probability only compares the learned languages, and is near 1 for letter junk and for any other language too.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    of = dict(zip(docs.columns, names))
    found = identify(plain, vocab_path, of[text], of[lang], of[id], keep=names)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least) & (F.col("strange") < strange)).select(*names).toDF(*docs.columns)


def op7_language_id(spark: SparkSession, sf_dir: str, vocab: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    return identify(documents(spark, sf_dir), public_tokenizers.path(vocab)).select("doc_id", "held_out", "lang_pred", "score")
