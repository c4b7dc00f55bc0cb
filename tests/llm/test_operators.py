import hashlib
import random
import struct
import unicodedata
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from terrane.llm import bpe, fingerprint, jaccard_join, mixing, quality, substring, suffix_dedup, token_count, topk, toxicity
from terrane.llm.common import Words, text_bytes
from terrane.llm.components import components
from terrane.llm.learning import held_out
from terrane.llm.queries import ORACLE_SQL, QUERIES

from . import brute

SF = "/root/testdata/sf0.01"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: Names that the operators use inside.
CLASHES = ["rid", "node", "h", "_h", "_rid", "size", "hits", "part", "kept", "label", "n_bytes", "others", "score", "held_out", "component", "source_size"]


def key(*row):
    return tuple("~" if x is None else f"{x:020}" if isinstance(x, int) else x for x in row)


def prose(r, n, letters="abcdefgh "):
    return "".join(r.choice(letters) for _ in range(n))


def nasty_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    r = random.Random(7)
    shared = " ".join(prose(r, 5, "klmnop") for _ in range(150))
    rows = [(i, prose(r, r.randint(0, 200)) + (shared[(o := r.randint(0, 300)) : o + r.randint(250, 500)] if i % 3 else "") + prose(r, 40, "xyzé ")) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "x" * 900), (54, "ab " * 700), (55, shared + " " + shared), (56, "ünïcödé 漢字 " * 60), (57, "one"), (58, "a <|endoftext|> b"), (None, shared), (None, None), (3, rows[3][1]), (3, rows[3][1]), (4, "another text"), (-9, shared)]
    return rows


@pytest.fixture(scope="module")
def nasty(spark):
    rows = nasty_rows()
    df = spark.createDataFrame([(i, t, None if k % 5 == 0 else f"s{k % 3}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    return rows, df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# 8


def removed_bytes(df, **options):
    return sorted(key(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df, **options).collect())


@pytest.mark.parametrize(("window", "gram"), [(200, 48), (60, 20)])
def test_suffix_dedup_is_brute_force(nasty, window, gram):
    rows, df = nasty
    want = sorted(key(i, *b) for (i, _), b in zip(rows, brute.repeats_bytes([t for _, t in rows], window), strict=True))
    assert removed_bytes(df, window=window, gram=gram) == want


def test_suffix_dedup_merges_parts_of_a_shard(spark):
    r = random.Random(1)
    base = prose(r, 900)
    texts = ["".join(c if r.random() > 0.004 else r.choice("pq") for c in base) for _ in range(50)]
    want = sorted(key(i, *b) for i, b in enumerate(brute.repeats_bytes(texts, 200)))
    assert removed_bytes(docs(spark, texts), shard_pieces=4) == want


def test_runs_of_windows_merge():
    """Windows that stand in two runs, or twice in one, and no others."""
    r = random.Random(8)
    held, seen = [], defaultdict(list)
    for part in range(9):
        own = [(r.randint(0, 400), part, i) for i in range(r.randint(0, 60))]
        rows = np.array([(9, part * 1000 + i, -3, part) for _, _, i in own], suffix_dedup._ROW)
        digest = [hashlib.md5(str(k).encode()).digest() for k, _, _ in own]
        order = sorted(range(len(own)), key=lambda i: digest[i])
        held.append((b"".join(digest[i] for i in order), rows[order].tobytes()))
        for d, row in zip(digest, rows, strict=True):
            seen[d].append(int(row["piece"]))
    got = suffix_dedup._merged(held, 200)
    assert sorted(got.column(1).to_pylist()) == sorted(p for x in seen.values() if len(x) > 1 for p in x)
    assert set(got.column(2).to_pylist()) == {-3} and set(got.column(3).to_pylist()) == {197}


def test_suffix_dedup_of_regular_bytes(spark):
    """Words that sums of powers can't tell apart."""
    word = "ab"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    texts = [word[:1024], other[:1024], word[:700] + "x" + other[5:900], "ab" * 400]
    want = sorted(key(i, *b) for i, b in enumerate(brute.repeats_bytes(texts, 200)))
    assert removed_bytes(docs(spark, texts)) == want


def test_suffix_array_and_prefixes():
    r = random.Random(2)
    pieces = [prose(r, r.randint(1, 60), "ab").encode() for _ in range(40)] + [b"ab" * 30, b"ab" * 30]
    text = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(pieces)), size)
    order = suffix_dedup.suffix_array(text, owner, end[owner])
    suffix = lambda i: bytes(text[i : end[owner[i]]])
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (suffix(i), i))
    shared = suffix_dedup.common_prefixes(text, order, end - size, end, 8)
    for a, b in zip(order, order[1:], strict=False):
        if end[owner[b]] - b >= 8:
            x, y = suffix(a), suffix(b)
            assert shared[b] == min(8, next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))))


def test_without_repeats_keeps_rows_and_columns(spark, nasty, nothing):
    rows, df = nasty
    df = df.withColumn("n_chars", F.length("text").cast("int"))
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert out.where("kept <> 'own kept' or others <> 'own others'").count() == 0
    assert out.where("n_chars <> length(text)").count() == 0
    assert suffix_dedup.without_repeats(nothing).count() == 0 and suffix_dedup.removal_digests(nothing).count() == 0


def test_long_texts(spark):
    """Texts of 2, 5 and 10 MB, beyond all steps: what is found in them and across them."""
    r = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(50000)])
    long = [" ".join(words[r.integers(0, len(words), n)]) for n in (330_000, 830_000, 1_660_000)]
    texts = [long[0], long[1], long[2], "x " + long[1][5000:4_000_000] + " y", long[2]]
    df = docs(spark, texts)
    got = {x.doc_id: x for x in suffix_dedup.removal_digests(df).collect()}
    size = [len(t) for t in texts]
    assert [got[i].n_bytes for i in range(5)] == size
    # The copied part, and a byte on either side where the neighbours happen to agree.
    assert got[0].n_removed == 0 and got[2].n_removed == size[2] and got[4].n_removed == size[4]
    assert 3_995_000 <= got[1].n_removed <= 3_995_004 and size[3] - 4 <= got[3].n_removed <= size[3] - 2
    got = {x.doc_id: x for x in substring.removal_digests(df).collect()}
    count = [len(t.split()) for t in texts]
    assert [got[i].n_words for i in range(5)] == count
    assert [got[i].n_removed for i in (0, 1, 2, 4)] == [0, 0, 0, count[4]]
    assert count[3] - 4 <= got[3].n_removed <= count[3] - 2
    got = {x.doc_id: x for x in jaccard_join.similar_documents(df).collect()}
    assert [got[i].class_id for i in range(5)] == [0, 1, 2, 3, 2] and [got[i].n_links for i in range(5)] == [0, 0, 1, 0, 1]


def test_long_texts_in_tokens_and_scores(spark, sample, labels):
    text = "don't stop  believin' é漢字 123 " * 65_000
    df = docs(spark, [text, None, "", text])
    lib = tokenizers.Tokenizer.from_file(JSON)
    want = len(lib.encode(text, add_special_tokens=False).ids)
    assert [x.n_tokens for x in token_count.token_counts(df, JSON).collect()] == [want, 0, 0, want]
    got = bpe.round_trip(df, RANKS, PATTERN).collect()
    assert got[0].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[0].n_tokens == got[3].n_tokens
    prints = {x.doc_id: x for x in fingerprint.fingerprints(df).collect()}
    assert prints[0].fingerprint == prints[3].fingerprint and prints[0].n_copies == 2 and prints[0].n_chars == len(text)
    for module in (quality, toxicity):
        scores = {x.doc_id: x.score for x in module.score(df, module.fit(sample, labels)).collect()}
        assert scores[0] == scores[3] and scores[1] == scores[2]


# 3


@pytest.mark.parametrize("window", [50, 9, 10])
def test_substring_is_brute_force(nasty, nothing, window):
    rows, df = nasty
    want = sorted(key(i, *b) for (i, _), b in zip(rows, brute.repeats_words(rows, window), strict=True))
    assert sorted(key(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digests(df, window).collect()) == want
    assert substring.removal_digests(nothing).count() == 0


def test_packed_arrays():
    r = np.random.default_rng(0)
    for top in (1 << 8, 1 << 20, 1 << 46, 1 << 63):
        v = np.sort(r.integers(0, top, 1000).astype(np.uint64))
        assert (substring.unpack(substring.pack(v)) == v).all()
    assert substring.unpack(substring.pack(np.array([5], np.uint64))).tolist() == [5]


def test_words():
    texts = ["", "a  b", "c\x0bd\te", None, "é\xa0f", " "]
    w = Words(*text_bytes(pa.array(texts, pa.string())))
    found = [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end, strict=True)]
    assert found == [x for t in texts for x in brute.WORD.findall(t or "")]
    assert w.count.tolist() == [len(brute.WORD.findall(t or "")) for t in texts]


# 2


def joined(df, **options):
    return sorted(key(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.similar_documents(df, **options).collect())


def brute_join(rows, least=0.8):
    links = brute.jaccard_links([t for _, t in rows], least)
    up, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        up[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return sorted(key(i, min(ids[find(k)], default=None), degree[k]) for k, (i, _) in enumerate(rows))


def near_rows():
    r = random.Random(3)
    words = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    bases = [[r.choice(words) for _ in range(r.randint(3, 120))] for _ in range(20)]
    edited = lambda b, p: " ".join(w if r.random() > p else r.choice(words) for w in b)
    rows = [(i, edited(r.choice(bases), r.choice([0, 0.01, 0.02, 0.05]))) for i in range(200)]
    return rows + [(300 + i, " ".join(bases[1][:60]) + " " + " ".join(r.choice(words) for _ in range(100))) for i in range(30)]


@pytest.mark.parametrize("options", [{}, {"small": 8, "block": 16}])
def test_jaccard_join_is_brute_force(spark, options):
    rows = near_rows()
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), **options) == brute_join(rows)


def test_jaccard_join_edge_cases(nasty, nothing):
    rows, df = nasty
    assert joined(df) == brute_join(rows)
    assert jaccard_join.similar_documents(nothing).count() == 0 and jaccard_join.one_of_each(nothing).count() == 0
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    classes = {r.rid: r for r in jaccard_join.similar_documents(df).collect()}
    assert kept.where(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)) == 0).count() == sum(1 for _, t in rows if not (t or "").split())
    n = len({c.component for c in classes.values() if c.component is not None}) + sum(1 for _, t in rows if not (t or "").split())
    assert kept.count() == n


def test_runs_reach_the_recall():
    """Pairs at the least similarity: how many share a path of the first, and of the fourth level, and pass the sketches."""
    assert 8 <= jaccard_join.runs_for(0.999) <= 12
    r = np.random.default_rng(1)
    runs, n = jaccard_join.runs_for(0.999), 600
    met, deep, alike = 0, 0, 0
    for _ in range(n):
        both, a, b = (r.integers(0, 1 << 63, k).astype(np.uint64) for k in (240, 30, 30))
        sets = [np.sort(np.r_[both, x]) for x in (a, b)]
        first = np.array([0, 270, 540])
        s, p = jaccard_join.paths(np.concatenate(sets), first, runs, 0.8)
        level = [p[s == k] for k in (0, 1)]
        met += len(np.intersect1d(*level)) > 0
        for _ in range(3):
            level = [np.unique(jaccard_join.paths_below(h, np.intersect1d(*level), 0.8)[1]) for h in sets]
        deep += len(np.intersect1d(*level)) > 0
        alike += jaccard_join.maybe_similar(jaccard_join.sketches(np.concatenate(sets), first), np.array([270, 270]), 0.8)[0, 1]
    assert met >= n - 2 and deep >= n - 3 and alike >= n - 1


def test_jaccard_join_goes_down_levels(spark):
    """Many sets with a common part of a fifth of their words: some paths are crowded, few sets are similar."""
    r = random.Random(6)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join(common + [f"w{r.randint(0, 10**6)}" for _ in range(100)])) for i in range(150)]
    rows += [(1000 + i, t + (" x" if i % 2 else "")) for i, (_, t) in enumerate(rows[:20])]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), small=4, block=8) == brute_join(rows)


def test_jaccard_join_tells_sets_of_one_digest(spark, monkeypatch):
    """All first digests collide: the second ones keep the sets apart."""
    real = jaccard_join.set_digest
    monkeypatch.setattr(jaccard_join, "set_digest", lambda h, first: (real(h, first)[0] % np.uint64(3), real(h, first)[1]))
    rows = near_rows()[:60]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_join(rows)


def test_join_and_removal_of_regular_words(spark):
    """Words that sums of powers can't tell apart are different words."""
    word = "ab"
    for _ in range(9):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    df = docs(spark, [" ".join([word] * 60), " ".join([other] * 60), " ".join([other] * 70)])
    assert [r.n_removed for r in substring.removal_digests(df).orderBy("doc_id").collect()] == [0, 0, 70]
    assert [r.class_id for r in jaccard_join.similar_documents(df).orderBy("doc_id").collect()] == [0, 1, 1]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4 and 9


def library_texts():
    r = random.Random(1)
    letters = "abé ' \n\t 　x1٣漢字'sd!?\x1c🎉́ª½"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    return texts + ["a" * 3000, "ab" * 2000, prose(r, 8000, "abcdefgh"), " " * 2000, "\n" * 300 + "a", "<|endoftext|>", "x <|endoftext|> <|endoftext|>  y", "don't we'll I'M"]


def test_token_counts_are_the_library_s(spark, nasty, nothing, sample):
    lib = tokenizers.Tokenizer.from_file(JSON)
    for df in (docs(spark, library_texts()), nasty[1], sample):
        texts = [t or "" for (t,) in df.select("text").collect()]
        want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
        got = token_count.token_counts(df, JSON).collect()
        assert [r.n_tokens for r in got] == want
        assert [r.n_bytes for r in got] == [len(t.encode()) for t in texts]
        assert [r.over_limit for r in got] == [n > 1024 for n in want]
    assert token_count.token_counts(nothing, JSON).count() == 0


def test_byte_bpe_is_the_library_s_and_round_trips(spark, nasty, nothing, sample):
    vocab = bpe.read_ranks(Path(RANKS).read_bytes())
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocab)}, special_tokens={})
    for df in (docs(spark, library_texts()), nasty[1], sample):
        texts = [t or "" for (t,) in df.select("text").collect()]
        want = [lib.encode_ordinary(t) for t in texts]
        ids = bpe.encode(df, RANKS, PATTERN)
        assert [list(r.ids) for r in ids.collect()] == want
        got = bpe.round_trip(df, RANKS, PATTERN).collect()
        assert [r.n_tokens for r in got] == [len(w) for w in want]
        assert [r.ids_sha256 for r in got] == [hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest() for w in want]
        assert [r.decoded_sha256 for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert [bytes(r.bytes).decode() for r in bpe.decode(bpe.encode(nasty[1], RANKS, PATTERN), RANKS).collect()] == [t or "" for _, t in nasty[0]]
    assert bpe.round_trip(nothing, RANKS, PATTERN).count() == 0


# 5


def brute_top(rows, queries, k=5):
    out = []
    for q, v in queries:
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def tops(rows, queries, **options):
    return sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(rows, queries, **options).collect())


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.integers(-3, 4, int(r.integers(0, 6))).astype(float).tolist()) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [1.0, float("nan")]), (403, [float("inf")]), (None, [1.0]), (404, []), (405, [0.3, -0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("own")).withColumn("cell", F.lit(1))
    whole = topk.whole_vectors(df)
    plain = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = tops(whole, whole.where("vec_id % 50 = 0 or vec_id > 403"), scale=256)
    assert got == brute_top(plain, [(i, v) for i, v in plain if i % 50 == 0 or i > 403])
    few = whole.where("vec_id < 3")
    assert topk.top_k(few, few).count() == 6
    assert topk.top_k(whole.limit(0), whole.limit(0)).count() == 0
    assert topk.top_k(whole, whole.limit(0)).count() == 0 and topk.top_k(whole.limit(0), few).count() == 0


@pytest.mark.parametrize(("query_rows", "group_rows", "block"), [(20, 70, 16), (16384, 65536, 2048)])
def test_top_k_in_several_groups(spark, monkeypatch, query_rows, group_rows, block):
    monkeypatch.setattr(topk, "QUERY_ROWS", query_rows)
    monkeypatch.setattr(topk, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(topk, "BLOCK", block)
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-50, 50, 16).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert tops(df, df.where("vec_id % 7 = 0")) == brute_top(rows, [x for x in rows if x[0] % 7 == 0])


def test_top_k_of_repeated_ids(spark):
    """Rows with the query's id are its own, however many there are and however high they score."""
    rows = [(50, [9 + i]) for i in range(7)] + [(1, [3]), (2, [2]), (3, [1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert tops(df, df.where("vec_id = 50")) == [(50, 1, 1, 27), (50, 2, 2, 18), (50, 3, 3, 9)]
    rows = [(i % 5, [i % 3, i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    want = brute_top(rows, [(i, min(v for j, v in rows if j == i)) for i in range(5)])
    assert tops(df, df) == want


def test_top_of_mixed_sizes():
    """Blocks of doubles, 64-bit integers and Python's integers, one after the other."""
    r = np.random.default_rng(5)
    blocks = [r.integers(-b, b, (3, 40)).astype(k) for b, k in ((100, float), (1 << 61, np.int64), (100, float), (1 << 61, np.int64))]
    huge = np.array([[int(x) * 10**400 for x in row] for row in r.integers(-9, 9, (3, 10))], object)
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 4, 0, 1, 3]):
        every = [*blocks, huge]
        top, seen = topk.Top(np.array([7, 500, 50]), 5), [[], [], []]
        for n, b in enumerate(order):
            ids = np.arange(every[b].shape[1]) * 5 + n
            top.add(every[b], ids)
            for q, own in enumerate((7, 500, 50)):
                seen[q] += [(-int(v), i) for v, i in zip(every[b][q].tolist(), ids.tolist(), strict=True) if i != own]
        assert top.found == [[(-v, i) for v, i in sorted(x)[:5]] for x in seen]


@pytest.mark.parametrize("size", [9000.0, 1e6, 3e9, 1e16, 1e100, 1.7e308])
def test_top_k_of_large_components(spark, size):
    """Products are exact at any size; a score that a long can't hold is its end, but the order is still that of the products."""
    r = np.random.default_rng(4)
    rows = [(i, (r.choice([-1, 1], 3) * r.random(3) * size).tolist()) for i in range(60)]
    rows += [(60, [size, size, size]), (61, [0.5, 0.25, 0.0]), (62, [-size, 1.0])]
    df = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    from fractions import Fraction
    from math import floor

    plain = [(i, [floor(256 * Fraction(x)) for x in v]) for i, v in rows]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = [(a, b, c, clip(s)) for a, b, c, s in brute_top(plain, [x for x in plain if x[0] % 50 == 0 or x[0] > 59], 40)]
    assert tops(df, df.where("vec_id % 50 = 0 or vec_id > 59"), k=40, scale=256) == want
    if size < 1e7:
        assert not any(abs(s) >= 1 << 62 for *_, s in want)


# 6


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, free, target = sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mix(spark, nasty, nothing, sample):
    for df in (nasty[1], sample, spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "b"), (500, "c"), (0, "d"), (3, None)])], "doc_id long, text string, source string")):
        got = mixing.mix(df).collect()
        assert len(got) == df.count()
        sizes = defaultdict(int)
        for r in df.select("text", "source").collect():
            sizes[r.source] += len(brute.WORD.findall(r.text or ""))
        want = brute_targets(dict(sizes))
        taken, most = defaultdict(int), defaultdict(int)
        by = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()} if df is not nasty[1] else None
        for r in got:
            assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
            if by is not None:
                s = by[r.doc_id]
                assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
                taken[s] += r.taken
                most[s] = max(most[s], r.size)
        for s in taken:
            assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
        again = mixing.mix(df).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mix_splits_repeated_rows(spark, monkeypatch):
    """Rows that are equal share a hash; so many of them are taken as the target asks for."""
    rows = [(1, "w " * 10, "a")] * 100 + [(10 + i, f"w{i} " * 10, "b") for i in range(100)] + [(200 + i % 2, "x " * 7, None) for i in range(301)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for bits in (12, 1):  # 1: almost all rows lie in the last bucket
        monkeypatch.setattr(mixing, "LEVEL_BITS", bits)
        monkeypatch.setattr(mixing, "_BITS", bits * mixing.LEVELS)
        got = mixing.mix(df).collect()
        assert len(got) == len(rows)
        taken = defaultdict(int)
        for r in got:
            taken[r.source_size, r.size] += r.taken
            assert r.taken <= 3 * r.size
        want = brute_targets({"a": 1000, "b": 1000, None: 2107})
        assert abs(sum(r.taken for r in got if r.doc_id == 1) - want["a"]) <= 5
        assert abs(sum(r.taken for r in got if 10 <= r.doc_id < 200) - want["b"]) <= 5
        assert abs(sum(r.taken for r in got if r.doc_id >= 200) - want[None]) <= 3.5
        whole = mixing.mixed_documents(df)
        n = lambda d: sorted((r.doc_id, r.c) for r in d.groupBy("doc_id").agg(F.count("*").alias("c")).collect())
        plan = defaultdict(int)
        for r in got:
            plan[r.doc_id] += r.copies
        assert n(whole) == sorted((k, v) for k, v in plan.items() if v)


@pytest.mark.parametrize("block", [1 << 14, 3])
def test_targets_of_many_sources(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "SOURCES", block)
    r = random.Random(4)
    sizes = {f"s{i}é" if i % 3 else f"S{i}": r.choice([0, 1, 5, 100, 3000, r.randint(0, 50)]) for i in range(60)} | {None: 40}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {x.source: x.source_size for x in got} == sizes
    for x in got:
        assert x.target == pytest.approx(want[x.source])


def test_mixed_documents(nasty):
    _, df = nasty
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert out.where("_h <> 'own _h'").count() == 0
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    assert out.agg(F.sum(words)).first()[0] == mixing.mix(df).agg(F.sum("taken")).first()[0]


# 7


def brute_prints(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    out = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        new = t[: len(t) - h] + other[:h]
        f = lambda x: xxhash.xxh3_128_hexdigest(fold(x).encode())
        out.append(key(i, len(t), hashlib.sha256(new.encode()).hexdigest(), f(t), f(new), str(float(fold(t) == fold(new))), str(float(fold(t) == fold(other)))))
    return sorted(out)


@pytest.mark.parametrize("range_rows", [4096, 5])
def test_fingerprints(spark, nasty, nothing, monkeypatch, range_rows):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", range_rows)
    for rows in (nasty[0], nasty[0][:1], near_rows()):
        got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(3))).collect()
        assert sorted(key(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, str(r.near_edited), str(r.near_next)) for r in got) == brute_prints(rows)
    assert fingerprint.fingerprints(nothing).count() == 0


def test_fingerprint_groups(spark, monkeypatch):
    texts = ["A  b", "a B", "ａ b\n", "c", None, "", " ", "straße", "STRASSE"]
    got = {r.doc_id: (r.group_id, r.n_copies) for r in fingerprint.fingerprint_groups(docs(spark, texts)).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 1), 4: (4, 3), 5: (4, 3), 6: (4, 3), 7: (7, 2), 8: (7, 2)}
    monkeypatch.setattr(fingerprint, "digest", lambda form: "same")  # every digest collides
    got = {r.doc_id: r.group_id for r in fingerprint.fingerprint_groups(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7}


def test_fingerprints_query_groups_the_whole_table(spark):
    got = QUERIES["op7_fingerprints"](spark, SF).collect()
    groups = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        groups.setdefault(fingerprint.canonical(r.text), []).append(r.doc_id)
    want = {i: (min(ids), len(ids)) for ids in groups.values() for i in ids}
    assert {r.doc_id: (r.group_id, r.n_copies) for r in got} == want and max(n for _, n in want.values()) > 1


# 1 and 10


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").withColumn("text", F.lit("own"))


def auc(score, y):
    rank = score.rank()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.98), (toxicity, "toxic", 0.75)])
def test_classifiers(spark, sample, labels, nasty, nothing, module, label, least):
    model = module.fit(sample, labels, label)
    scores = module.score(sample, model).toPandas()
    assert len(scores) == sample.count() and scores["score"].between(0, 1).all()
    both = scores.merge(labels.toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert auc(held["score"], held[label]) > least
    assert module.score(nasty[1], model).count() == len(nasty[0])
    assert module.score(nothing, model).count() == 0
    # Only texts enter: other ids and columns give the same scores.
    moved = module.score(sample.withColumns({"doc_id": -F.col("doc_id"), "lang": F.lit("x"), "source": F.lit("y")}), model).toPandas()
    assert sorted(moved["score"]) == sorted(scores["score"])
    # Without labels, or with one class, there is a constant score.
    for some in (labels.limit(0), labels.where(f"{label} = 1")):
        flat = module.score(nasty[1], module.fit(sample, some, label)).toPandas()
        assert flat["score"].nunique() == 1


def test_folds_and_labels_stay_apart(spark, sample, labels):
    folds = {r.doc_id: r.h for r in sample.select("doc_id", held_out().alias("h")).collect()}
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in folds.items())
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(sample, toxicity.fit(sample, x)).toPandas()["score"].tolist() for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("noise", [0, 60])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_toxicity_learns_pairs(seed, noise):
    """Two terms that are harmful only together and neutral alone: additive weights can't tell them, a fit must."""
    r = np.random.default_rng(seed)
    n = 3000
    a, b = r.random(n) < 0.5, r.random(n) < 0.5
    y = (a == b).astype(float)
    doc = np.r_[np.flatnonzero(a), np.flatnonzero(b), np.arange(n), np.repeat(np.arange(n), noise)]
    term = np.r_[np.full(a.sum(), 10), np.full(b.sum(), 20), np.full(n, 30), r.integers(1000, 1400, n * noise)]
    doc, term = np.divmod(np.unique(doc << toxicity.TERM_BITS | term), 1 << toxicity.TERM_BITS)
    learn = doc < 2000
    m = toxicity.fit_machine(doc[learn], term[learn], y[:2000], np.ones(2000))
    assert {10, 20} <= set(toxicity.telling(doc[learn], term[learn], y[:2000]).tolist())
    new = (m.logits(doc, term, n) > 0)[2000:] == (y > 0)[2000:]
    assert new.mean() > 0.95


def test_telling_terms_are_none_without_labels():
    assert not len(toxicity.telling(np.zeros(0, int), np.zeros(0, int), np.zeros(0)))
    assert not len(toxicity.telling(np.array([0, 1]), np.array([5, 5]), np.ones(2)))


def test_without_toxic(nasty, sample, labels, nothing):
    model = toxicity.fit(sample, labels)
    out = toxicity.without_toxic(nasty[1], model)
    assert out.columns == nasty[1].columns
    kept = toxicity.score(nasty[1], model).where("predicted = 0").count()
    assert out.count() == kept and toxicity.without_toxic(nothing, model).count() == 0


def test_every_operator_has_its_query():
    numbers = {int(q[2:].split("_")[0]) for q in QUERIES}
    assert numbers == set(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert struct.calcsize("q") == 8
