"""Exact operators against brute force, on a small fixture with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomtab.llm import byte_bpe, exact_dedup, jaccard_join, language_id, license_scan, mixing, neighbours, personal_data, quality, token_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old red barn near a river bank"
    texts = [base, base.upper(), base + " today", base.replace(" ", "  "), None, "", " \t", "one", "ONE", "one two three", LONG, LONG + " end", base, "Ünï çödé ２ 東京 😀 İ", "a" * 5000, base + "\x85"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 3}", 7, "x", 1.0) for i, t in enumerate(texts)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank_ string, words double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs, empty):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rows = docs.select("doc_id", "text").collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(plain(r.text), []).append((-len(r.text or ""), r.doc_id))
    for heavy in (1, 512):
        got = exact_dedup.exact_groups(docs, heavy=heavy).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
        want = {r.doc_id: (min(groups[plain(r.text)])[1], len(groups[plain(r.text)]), hashlib.sha256(plain(r.text).encode()).hexdigest()) for r in rows}
        assert all((r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id] and r.kept <= (r.keep_id == r.doc_id) for r in got)
        kept = exact_dedup.drop_exact_duplicates(docs, heavy=heavy)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g)[1] for g in groups.values())
    assert exact_dedup.exact_groups(empty).count() == 0


def test_mixing(spark, docs, empty):
    got = mixing.mixture(docs, slices=4).collect()
    again = mixing.mixture(docs, slices=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == docs.count()
    size = {r.doc_id: len(WORDS.findall(r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(r.size for r in got if source[r.doc_id] == s) for s in names}
    target, open_, budget = {}, set(names), 1.5 * sum(total.values())
    budget_ = budget
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        open_ -= full
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]]) and 0 <= r.taken <= 2 * r.size
    for s in names:
        assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - target[s]) <= mixing.PACKET
    assert abs(sum(r.taken for r in got) - budget_) <= len(names)
    mixed = mixing.mix(docs, slices=4)
    assert mixed.columns == docs.columns
    assert sum(len(WORDS.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mixture(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_takes_a_prefix_of_the_global_order(spark, docs):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    rows = mixing.queued(mixing.slim_rows(real.unionByName(docs.select("doc_id", "text", "source"))))
    order = lambda r: (r.finish, r.queue, r.end)
    all_ = sorted(mixing.packets(rows).collect(), key=order)
    taken = sorted(mixing.taken_prefix(rows, size=100).collect(), key=order)
    budget = sum(round(r.target) for r in rows.select("queue", "target").distinct().collect())
    assert 0 < len(taken) < len(all_) and [order(r) for r in taken] == [order(r) for r in all_[: len(taken)]]
    assert [r.words for r in taken[:-1]] == [r.words for r in all_[: len(taken) - 1]] and 0 < taken[-1].words <= all_[len(taken) - 1].words
    assert sum(r.words for r in taken) == budget and sum(r.words for r in all_) == 2 * sum(r.words for r in rows.collect())


def test_mixing_of_null_and_repeated_rows(spark):
    rows = [(None, "a b c", "x", 1), (None, "a b c", "x", 2), (1, None, "x", 3), (1, "q", None, 4), (2, " ", "y", 5), (3, "w " * 900, "y", 6), (3, "w " * 900, "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, start int")
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows) and abs(sum(r.taken for r in got) - 1.5 * sum(r.size for r in got)) <= 1.5
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(WORDS.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert {r.text for r in mixing.mix(docs, whole=True).collect()} <= {r[1] for r in rows}


def test_exact_dedup_of_null_ids(spark):
    rows = [(None, "a b", 1), (None, "ab", 2), (1, "a b", 3), (None, "z z", 4), (None, "zz", 5), (None, "alone", 6), (2, None, 7), (3, " ", 8), (4, "x", 9), (4, "x", 10), (4, "x y", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha_ int")
    for heavy in (1, 512):
        assert sorted((str(r.doc_id), r.text or "") for r in exact_dedup.drop_exact_duplicates(docs, heavy=heavy).collect()) == [("1", "a b"), ("3", " "), ("4", "x"), ("4", "x y"), ("None", "alone"), ("None", "z z")]
        assert sum(r.kept for r in exact_dedup.exact_groups(docs, heavy=heavy).collect()) == 6


def test_pipeline_mixes_whole_documents(spark, docs, empty):
    from collections import Counter

    import corpus_pipeline

    for some in (docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        key = lambda r: (r.doc_id, r.source, r.text, r.n_chars)
        there, mixed = Counter(map(key, some.collect())), corpus_pipeline.mixed(spark, some, "").collect()
        stands = Counter(map(key, mixed))
        assert all(stands[k] <= 2 * there[k] for k in stands)
        taken = {}
        for r in mixing.mixture(some).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        for k, n in there.items():
            size = len(WORDS.findall(k[2] or ""))
            assert size == 0 or stands[k] == -(-taken[k[0]] // size)
    assert corpus_pipeline.mixed(spark, empty, "").count() == 0


def test_bitmaps_of_long_documents():
    import numpy as np

    x, y = (np.unique(np.random.default_rng(k).integers(0, 2**63, 3000, dtype=np.uint64)) for k in (1, 2))
    for one, two in ((x, x), (x, y), (x, x[:1500]), (x, np.union1d(x, y[:100]))):
        bits = [jaccard_join.parities(z, 1 << (2 * len(z) - 1).bit_length()).tobytes() for z in (one, two)]
        differing = jaccard_join.differing_bits(*bits)
        assert differing == jaccard_join.differing_bits(*bits[::-1]) <= len(np.setxor1d(one, two)) and (differing > 0) == (one is not two)
    assert jaccard_join.differing_bits(jaccard_join.parities(x, 8192).tobytes(), jaccard_join.parities(x, 1024).tobytes()) == 0


def test_jaccard_join(spark, docs, empty):
    # long documents on both sides of the limits, of sizes whose bitmaps differ in width
    long = [f"v{i}" for i in range(2100)]
    near = [" ".join(long[: len(long) - k] + [f"u{j}" for j in range(u)]) for k, u in ((0, 0), (100, 100), (150, 150), (170, 170), (240, 240), (400, 0), (300, 0), (0, 330), (900, 900))]
    both_kinds = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(near)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in both_kinds.collect()]
    for words, least in ((4, 85), (5, 80)):
        sets = {}
        for i, t in rows:
            w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        label = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    both = len(sets[a] & sets[b])
                    if sets[a] and sets[b] and 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                        label[a] = label[b] = min(label[a], label[b])
        got = jaccard_join.similar_groups(both_kinds, words=words, least=least).collect()
        assert len(got) == len(rows) and all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), label[r.doc_id]) for r in got)
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert jaccard_join.similar_groups(empty).count() == 0


def test_sets_that_link_share_a_tile():
    import numpy as np

    random = np.random.default_rng(1)
    links = 0
    for least in (85, 80, 50):
        tiles = jaccard_join.Tiles(least)
        for n in (1, 2, 3, 5, 6, 7, 9, 12, 20, 33, 60, 100, 250, 600, 2000):
            for _ in range(200 if n < 200 else 20):
                z = np.unique(random.integers(0, 2**64, n, dtype=np.uint64))
                less, more = random.integers(0, n // 3 + 2, 2)
                y = np.unique(np.concatenate([np.delete(z, random.choice(n, min(less, n), replace=False)), random.integers(0, 2**64, more, dtype=np.uint64)]))
                both = len(np.intersect1d(z, y))
                if len(y) and 100 * both >= least * (len(z) + len(y) - both):
                    links += 1
                    assert len(np.intersect1d(tiles(z), tiles(y)))
    assert links > 2000


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    import numpy as np

    text = " ".join("w" * (k % 37) + str(k * k) for k in range(3000)) + " " + "x" * 5000 + "\tEnd \x85ü"
    whole = jaccard_join.Sets(4).hashes(text)
    assert len(whole) == len(WORDS.findall(text))
    monkeypatch.setattr(jaccard_join, "PIECE", 1000)
    assert np.array_equal(jaccard_join.Sets(4).hashes(text), whole)


def test_jaccard_join_of_null_and_repeated_ids(spark):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (1, text), (2, text + " end"), (2, "something else that is here alone"), (3, None), (None, None), (1, text)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, gone_ int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs).collect()), key=str)
    assert got == sorted([(None, 57, None), (1, 57, 1), (2, 58, 1), (2, 3, 1), (3, 0, 3), (None, 0, None), (1, 57, 1)], key=str)
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, 3, None, None]


def test_jaccard_join_of_an_id_whose_hash_is_0(spark):
    text = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(25317696, text), (25317697, text + " end"), (5, "something else that is here alone")], "doc_id long, text string")
    assert docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(jaccard_join.FILTER)) == 0).count() == 1
    assert {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs).collect()} == {25317696: 25317696, 25317697: 25317696, 5: 5}


def test_byte_bpe(docs, empty):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got.collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.text for r in byte_bpe.decode(got, P.path("byte_bpe_50k.tiktoken")).collect()} == text
    live = byte_bpe.LivePiece(byte_bpe.PrefixCoder(ranks), b"internation")
    live.append(b"alisation")
    live.replace(5, 9, b"xyzzy")
    assert live.ids == library._core_bpe.encode_single_piece(b"interxyzzyonalisation"[:5] + b"xyzzy" + b"internationalisation"[9:])
    assert byte_bpe.encode(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_byte_bpe_edits_stay_near_the_edit():
    import random

    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.PrefixCoder(ranks)
    random.seed(8)
    letters = b"abcdeinorst"
    live = byte_bpe.LivePiece(coder, bytes(random.choices(letters, k=3000)))
    for _ in range(60):
        start = random.randrange(len(live.piece))
        live.replace(start, min(len(live.piece), start + random.randrange(6)), bytes(random.choices(letters, k=random.randrange(6))))
        assert live.ids == library._core_bpe.encode_single_piece(live.piece)
        assert live.computed <= start + 6 + 400 or start > 2500
    assert [ids for _, ids in coder.encode_all([b"internation", b"international", b"inter"])] == [library._core_bpe.encode_single_piece(x) for x in (b"inter", b"internation", b"international")]


def test_token_counts(spark, docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    more = docs.unionByName(spark.createDataFrame([(99, "a<|endoftext|>b"), (98, "Σας'LL é")], "doc_id long, text string"), allowMissingColumns=True)
    text = {r.doc_id: r.text or "" for r in more.collect()}
    for r in token_counts.count_tokens(more, P.path("word_bpe_49k.json")).collect():
        n = len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 2048)
    assert token_counts.count_tokens(empty, P.path("word_bpe_49k.json")).count() == 0


def test_token_counts_look_up_around_other_characters():
    import random

    import public_tokenizers as P
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        lengths = token_counts.Lengths(f.read(), {})
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    random.seed(6)
    some = ["the", "It’s", "don't", "“quoted”", "—", "東京", "😀", "Σας'LL", "é", "e", "\u0301", "\u0338", "\u3000", "\xa0", "\x85", "\x1c", "İ", "<|endoftext|>", "<|EndOfText|>", "12", "ﬁ", "ß", "\u200b", "\u2028", "가", "\u11a8"]
    for _ in range(5000):
        text = "".join(random.choice(some) + random.choice(["", " ", "\n", "\t ", "\x0b"]) for _ in range(random.randrange(12)))
        assert lengths(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    lengths("a curly “quote” among plainwords")
    assert "plainwords" in lengths.known and "“quote”" in lengths.known


def test_personal_data(spark, docs, empty):
    text = "é a.b@c.com x@y 10.0.0.1 300.1.1.1 is 4111 1111 1111 1111 or +1 (499) 555-6503 later 1-499-555-6503"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "a" * 30_000 + " 1" * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.find(rows).collect()}
    spans = [s.split(":") for s in got[1].spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans][:4] == [("email", "a.b@c.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (499) 555-6503")]
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[2].spans == got[3].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    field = personal_data.Field({}, [[0.0] * 6] * 6)
    assert (3, text.index("1-499")) in [(k, a) for a, k, _ in field.added(text, personal_data.base_spans(text))]
    assert personal_data.find(docs).count() == docs.count() and personal_data.find(empty).count() == 0


def test_personal_data_of_very_long_parts(spark):
    rows = [(None, "0" * 5000 + ".1.1.1"), (1, "1." * 20_000), (2, "9" * 30_000 + ".1.1.1 @" + "a@" * 10_000), (3, "(" * 20_000 + "0 " * 20_000), (4, "token=" * 5000)]
    got = {r.doc_id: r for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None].n_ip == 1 and got[1].n_ip == 5000 and got[2].n_ip == 0


def test_messages_give_marginals():
    import itertools

    import numpy as np

    random = np.random.default_rng(2)
    for edges, close in (([(0, 1), (1, 2), (2, 3)], 1e-4), ([(0, 1), (1, 2), (2, 3), (0, 3)], 0.05)):
        own, pot = random.normal(size=(4, 3)), [random.normal(size=(3, 3)) * (1 if close < 0.01 else 0.5) for _ in edges]
        want = np.zeros((4, 3))
        for y in itertools.product(range(3), repeat=4):
            p = np.exp(sum(own[i, y[i]] for i in range(4)) + sum(w[y[a], y[b]] for (a, b), w in zip(edges, pot)))
            for i in range(4):
                want[i, y[i]] += p
        got = personal_data.beliefs(own, [(a, b, w) for (a, b), w in zip(edges, pot)])
        assert np.abs(got - want / want.sum(1, keepdims=True)).max() < close


def test_personal_data_finds_what_patterns_miss(spark):
    import random

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    field = personal_data.train(real)
    random.seed(5)
    found = total = 0
    for k in range(200):
        name, number = f"{random.choice(['ann', 'bo', 'cleo'])}.{k}", f"{random.randrange(200, 999)}) 555-{random.randrange(1000, 9999)}"
        card = next(c for c in (f"{random.randrange(10**15, 10**16)}" for _ in range(1000)) if personal_data.luhn(c))
        secret = "".join(random.choices("0123456789abcdef", k=40))
        for first, again in ((f"{name}@mail.example.com", f"{name} [at] mail [dot] example [dot] com"), (f"+1 ({number}", f"1 ({number}"), (f'token = "{secret}"', secret)):
            text = f"in the and {first} the ing and or her {again} and the other"
            spans = personal_data.base_spans(text)
            found += any(a <= text.rindex(again) + 2 < b for a, _, b in field.added(text, spans))
            total += 1
        text = f"the and {card} of it"
        assert personal_data.base_spans(text) and field.added(text, personal_data.base_spans(text)) == []
    assert found >= 0.9 * total
    clean = ["In 1987 there were 25 of 300 at 12.30, and 4.0 more (see 2.1).", "word " * 50, "Version 2.0 of 2024-05-06", ""]
    assert all(field.added(t, []) == [] for t in clean)


def test_personal_data_patterns():
    import random

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    random.seed(4)
    for k in range(5000):
        t = "".join(random.choices("aZ.@-+ 0123456789%() " if k % 2 else "a.@-1+", k=40))
        want = []
        for kind, p in enumerate(patterns):
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                fits = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and personal_data.luhn(digits), 10 <= len(digits) <= 15)[kind]
                want += [(m.start(), kind, m.end())] if fits else []
        assert personal_data.base_spans(t) == sorted(want)


def test_neighbours(spark):
    import numpy as np

    random = np.random.default_rng(3)
    centres = random.normal(size=(20, 16))
    x = (centres[random.integers(0, 20, 3000)] + 0.4 * random.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)] + [(9000, None, ""), (9050, [0.0] * 16, ""), (9100, [float("nan")] * 16, ""), (9150, [1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = neighbours.nearest(df, lambda i: i % 50 == 0).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    found = total = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        want = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - s[m[1]]) < 1e-12 for m in mine)
        found, total = found + len(set(want) & {m[1] for m in mine}), total + 5
    assert found / total >= 0.9 and len(got) == 300
    few = neighbours.nearest(df.filter("vec_id < 3 or vec_id = 50"), lambda i: i % 50 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(q, k) for q in (0, 50) for k in (1, 2, 3)]
    assert neighbours.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_license_scan(spark, docs, empty):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, "word " * 50 + notice + " more" * 30), (2, "x " + notice.upper()), (3, "Licensed under terms of the Apache kind"), (4, None), (5, LONG + " Released under the MIT License " + LONG), (6, ""), (7, "one")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.containment) for r in got) == [(1, "apache-2.0", 1.0), (2, "apache-2.0", 1.0), (5, "mit", 1.0)]
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(empty).count() == 0


def test_license_scan_in_random_surroundings(spark):
    import random

    random.seed(2)
    rows, want = [], {}
    for name, notices in license_scan.TEMPLATES.items():
        for notice in notices:
            for k in range(400):
                before, after = ([f"w{random.randrange(5000)}" for _ in range(n)] for n in (8 + k % 8, 16))
                want[len(rows)] = (name, notice)
                rows.append((len(rows), " ".join([*before, notice, *after])))
    found = {(r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).filter("containment = 1").collect()}
    for notice in [n for notices in license_scan.TEMPLATES.values() for n in notices]:
        mine = [(i, name) for i, (name, n) in want.items() if n == notice]
        assert sum(x in found for x in mine) >= 0.995 * len(mine), notice


def test_language_and_quality(spark, docs, empty):
    import public_tokenizers as P

    data = "/root/testdata/sf0.01"
    real = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r for r in language_id.op7_language_id(spark, data).collect()}
    lang = {r.doc_id: r.lang for r in real.collect()}
    held = [i for i in got if got[i].held_out]
    assert len(got) == len(lang) and sum(got[i].lang_pred == lang[i] for i in held) >= 0.97 * len(held)
    path = P.path("piece_bpe_32k.model")
    mine = language_id.identify(docs, path).collect()
    assert len(mine) == docs.count() and all((r.lang_pred, r.score) == ("und", 0.0) for r in mine if r.doc_id in (4, 5, 6))
    assert language_id.keep_identified(docs, path).columns == docs.columns and language_id.identify(empty, path).count() == 0
    labels = spark.read.parquet(f"{data}/labels.parquet")
    score = {r.doc_id: r for r in quality.op5_quality(spark, data).collect()}
    pairs = [(score[r.doc_id].predicted, r.quality) for r in labels.collect() if score[r.doc_id].held_out]
    assert sum(a == b for a, b in pairs) >= 0.9 * len(pairs)
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, labels.limit(0)).collect()) and quality.classify(empty, labels.limit(0)).count() == 0


def test_factors_give_the_sum_over_pairs():
    import numpy as np

    random = np.random.default_rng(3)
    machine = quality.Machine(4)
    machine.w[:], machine.bias = random.normal(size=machine.w.shape), 0.3
    slots, weights, dense = np.array([3, 77, 1200], np.int32), random.random(3).astype(np.float32), random.random(4).astype(np.float32)
    i, x = np.concatenate([slots, np.arange(machine.first, machine.first + 4)]), np.concatenate([weights, dense])
    want = machine.bias + machine.w[i] @ x + sum(machine.v[i[a]] @ machine.v[i[b]] * x[a] * x[b] for a in range(7) for b in range(a))
    assert machine.raw(slots, weights, dense) == pytest.approx(float(want), abs=1e-4)


def test_quality_of_odd_rows(spark):
    good, bad = "the house is near the river and people live there .", "$$ BUY !! NOW $$ 999 !!"
    rows = [(i, (good if i % 2 else bad) + f" {i}", i) for i in range(400)] + [(1000, None, None), (1001, "", 0), (1002, LONG * 3, -5), (None, good, 1), (1003, "\U0001f600", 2), (1, "again", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"id_": F.lit(1), "text_": F.lit("x"), "m0": F.lit(2)})
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(400)] + [(None, 1, ""), (5, 7, ""), (6, None, "")], "doc_id long, quality int, label_ string")
    first, again = (sorted((str(r.doc_id), r.held_out, r.score, r.predicted) for r in quality.classify(docs, labels).collect()) for _ in range(2))
    assert first == again and len(first) == len(rows) and all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.7) for r in first)
    held = [r for r in first if r[1] and r[0] != "None" and int(r[0]) < 400]
    assert len(held) > 50 and sum(r[3] == int(r[0]) % 2 for r in held) >= 0.95 * len(held)


def test_neighbours_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [inf, 1.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (50, [2.0, 0.0, 0.0]), (100, [0.0, 0.0]), (8, [1e200, 1e199])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<double>, rank int, v string")
    got = {}
    for r in sorted(neighbours.nearest(df.filter("vec_id <> 8 or vec_id is null"), lambda i: i % 50 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert got == {0: [(1, 1), (1, 1), (2, 2), (2, 2)], 50: [(1, 7)]}


def test_folders_of_clusters_are_asked_for(spark, monkeypatch):
    from types import SimpleNamespace

    from loomtab.llm._shared import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", applicationId="x")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
    assert shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "s3://b/c/"), sparkContext=context)) == "s3://b/c"


def test_long_runs_of_letters_are_learned():
    lattice = language_id.Lattice(["▁", "a", "b", "c", "ab", "bc"])
    p = language_id.fit(lattice, {"x": {"ab" * 300: 1}, "y": {"bc" * 300: 2}, "none": {}})
    scores = language_id.log_probabilities(lattice, ["abab", "bcbc", "ab" * 3000], p)
    assert scores[0, 0] > scores[0, 1] and scores[1, 1] > scores[1, 0] and scores[2].argmax() == 0


def test_every_language_is_learned(spark):
    names = [f"l{i:03}" for i in range(450)]
    docs = spark.createDataFrame([(i, f"word{i} {n}", n) for i, n in enumerate(names * 2)], "doc_id long, text string, lang string")
    counted, sizes = language_id.training_words(docs, "text", "lang", "doc_id")
    want = {r.lang: r.n for r in docs.filter(~language_id.held_out(F.col("doc_id"))).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert len(want) > 400 and sizes == want and set(counted) == set(want) and all(counted.values())


def test_pipeline_rejects_strange_texts(spark):
    import corpus_pipeline

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = ["xkqz vbnw qqpl zzkr mnbv wrtx plkj hgfd qwsx zxcv", "Всем привет это текст на русском языке который никто не учил", "Ez egy magyar nyelvű szöveg, amelyet senki sem tanult meg még soha"]
    usual = ["the house is near the river and the people live there"]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(usual + strange)], "doc_id long, text string")
    for some in (real, real.filter("lang = 'en'")):
        docs = some.unionByName(more, allowMissingColumns=True)
        kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").select("doc_id").collect()}
        assert {i for i in kept if i < 0} == {-1}
        assert {i for i in kept if i >= 0} == {r.doc_id for r in some.filter(r"text rlike '\\p{L}'").collect()}


def test_forward_sums_all_segmentations():
    import itertools

    import numpy as np

    pieces = ["▁", "▁a", "a", "ab", "b", "▁ab"]
    lattice, index = language_id.Lattice(pieces), {x: i for i, x in enumerate(pieces)}
    p = np.random.default_rng(1).random((7, 2))
    for word in ("abab", "aab", "bxa", "ab" * 30):
        s = "▁" + word
        if len(word) < 10:
            want = 0
            for cuts in itertools.product([0, 1], repeat=len(s) - 1):
                ends = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
                parts = [s[a:b] for a, b in zip(ends, ends[1:])]
                want = want + np.prod([p[index.get(x, 6)] if x in index or len(x) == 1 else p[0] * 0 for x in parts], axis=0)
        else:
            want = np.exp(language_id._long(lattice, word, p))
            alpha = language_id.forward(lattice.edges([word]), 1, p)
            assert np.allclose(alpha[len(s), 0], want)
            # a part's end among the letters, and letters that the vocabulary lacks
            long = word * 200 + "x" + word
            parts = language_id._long(lattice, long, p)
            step = np.log(language_id.forward(lattice.edges(["ab"]), 1, p)[3, 0])
            assert np.isfinite(parts).all() and (parts < step).all()
            continue
        assert np.allclose(np.exp(language_id.log_probabilities(lattice, [word], p))[0], want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == columns and docs.count() > 0, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert out.count() == docs.count()
    assert {r.decoded_sha256 for r in out.collect()} == {hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}


def test_pipeline_against_brute_force(spark):
    from collections import Counter

    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    data = "/root/testdata/sf0.001"
    made, docs = [], spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.collect()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        made.append(docs.collect())
    ids = lambda some: sorted(r.doc_id for r in some)
    rows = [r for r in rows if re.search(r"[^\W\d_]", r.text or "")]
    assert ids(made[0]) == ids(rows)
    best: dict = {}
    for r in sorted(rows, key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), r)
    rows = list(best.values())
    assert ids(made[1]) == ids(rows)
    sets = {}
    for r in rows:
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    rows = [r for r in rows if label[r.doc_id] == r.doc_id]
    assert ids(made[2]) == ids(rows)
    # each source's target by filling up; the document in service is finished
    size = {r.doc_id: len(WORDS.findall(r.text)) for r in rows}
    total: Counter = Counter()
    for r in rows:
        total[r.source] += size[r.doc_id]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, budget = {}, 1.5 * sum(total.values())
    while len(target) < len(total):
        level = (budget - sum(target.values())) / sum(weight[s] for s in total if s not in target)
        full = [s for s in total if s not in target and level * weight[s] > 2 * total[s]]
        target |= {s: 2 * total[s] for s in full} if full else {s: level * weight[s] for s in total if s not in target}
    text = {r.doc_id: r for r in rows}
    assert all(tuple(r) == tuple(text[r.doc_id]) for r in made[3]) and max(Counter(ids(made[3])).values()) <= 2
    for s in total:
        mine = [size[r.doc_id] for r in made[3] if r.source == s]
        assert -mixing.PACKET <= sum(mine) - target[s] < max(size[r.doc_id] for r in rows if r.source == s) + mixing.PACKET
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: library.encode_ordinary(r.text) for i, r in text.items()}
    out = corpus_pipeline.run(spark, data).collect()
    assert ids(out) == ids(made[3]) and all(r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) for r in out)
