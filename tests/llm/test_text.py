"""Language model, packing, substring removal, tokenizers, near duplicates: odd rows and brute force."""

import hashlib
import zlib

import cases
import numpy as np
import public_tokenizers as tok
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from siemspark.llm import bpe, components, katz, minhash, packing, substring, tokencount

RANKS = tok.path("byte_bpe_50k.tiktoken")
WORDS = tok.path("word_bpe_49k.json")


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, docs, order):
    rows = cases.DOCS[:6] + cases.DOCS[8:]
    df = spark.createDataFrame(rows, "doc_id long, text string") if order == 3 else docs
    rows = rows if order == 3 else cases.DOCS
    out = katz.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, order).collect()
    want, sums = cases.katz(rows, [cases.held(i) for i, _ in rows], order, katz.CUT, katz.discounts)
    assert sums == pytest.approx([1.0] * len(sums))
    got, want = ordered(map(tuple, out)), ordered(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in want]


def test_katz_on_corpus_beats_base(corpus):
    rows, df = corpus
    out = katz.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect()
    want, _ = cases.katz(rows, [cases.held(i) for i, _ in rows], 2, katz.CUT, katz.discounts)
    assert {r.doc_id: (r.score, r.n_known) for r in out} == {w[0]: (pytest.approx(w[6]), w[3]) for w in want}
    unseen = [r for r in out if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_registered_model_reads_two_words_of_context(spark):
    from siemspark.llm.catalog import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want, _ = cases.katz(rows, [cases.held(i) for i, _ in rows], 3, katz.CUT, katz.discounts)
    got = QUERIES["op1_katz_scores"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.score for r in got} == {w[0]: pytest.approx(w[6]) for w in want}


def test_katz_empty(empty):
    assert katz.score(empty, F.lit(False)).collect() == []


def test_katz_weights_are_asked_for_where_they_may_be_needed(spark):
    model = katz.Model({1: [9, 4, 2, 1, 1, 0, 50, 20], 2: [9, 4, 2, 1, 1, 0, 50, 20]})
    count, wanted = np.array([0, 3, 3, 5, 6, 0]), np.array([False, False, True, False, False, True])
    assert model.asked(2, count, wanted).tolist() == [False, False, True, False, True, False]
    # No mass for unknown tokens: nothing is left out.
    model.unknown = 0.0
    assert model.asked(2, count, wanted).all()
    # Histories whose counts are all beyond discounting, beside rare ones, before tokens not seen after them.
    often = [(i, "a b c a b d " * (1 + i % 2)) for i in range(100, 130)]
    rows = [*often, (200, "a b e f g"), (201, "b c"), (202, "f g a b h"), *((i, "a b f c b a zz d d e") for i in range(203, 240))]
    for order in (2, 3):
        out = katz.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                         F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, order).collect()
        want, _ = cases.katz(rows, [cases.held(i) for i, _ in rows], order, katz.CUT, katz.discounts)
        got = {r.doc_id: r.score for r in out}
        assert any(cases.held(i) for i in got) and got == {w[0]: pytest.approx(w[6]) for w in want}


def test_katz_reads_texts_once(spark, tmp_path):
    path = str(tmp_path / "texts")
    rows = [(i, "a b c a b d " * (1 + i % 3)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    out = katz.score(spark.read.parquet(path), F.col("doc_id") % 10 == 0, 3)
    assert out.inputFiles() and not [f for f in out.inputFiles() if path in f]
    assert out.count() == 40


def test_katz_questions_are_small():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 20_000, 500)) for _ in range(400)]
    row = katz._tokens(pa.table({"doc_id": list(range(400)), "text": texts, "held_out": [i % 10 == 0 for i in range(400)],
                                 "chunk": pa.array([0] * 400, pa.int32())}))
    asked = pa.Table.from_batches(katz._ask(3, 16)(iter(row.to_batches())))
    entries = sum(len(k) for k in katz.Chunk(row.to_pylist()[0], 3).keys)
    assert asked["keys"].nbytes + asked["data"].nbytes < 6.5 * entries  # 11 bytes as plain keys and counts
    assert row.nbytes < sum(map(len, texts)) / 2


def test_katz_keys_and_counts_come_back():
    rng = np.random.default_rng(5)
    for buckets in (64, 1024, 1 << 20):
        pack = katz.Keys(buckets)
        keys = np.unique(rng.integers(0, 1 << 63, 3_000).astype(np.uint64) >> np.uint64(buckets.bit_length() - 2)) + (
            np.uint64(buckets - 1) << np.uint64(65 - buckets.bit_length()))
        for some in (keys, keys[:1], keys[:0]):
            assert pack.read(pack.packed(some)).tolist() == pack.below(some).tolist()
    count = np.array([0, 1, 62, 63, 64, (1 << 32) + 7, 1 << 40] * 900)
    flags = rng.integers(0, 4, len(count)).astype(np.uint8) << 6
    for n in (len(count), 7, 0):
        got, bits = katz.read_counts(katz.packed_counts(count[:n], flags[:n]))
        assert got.tolist() == count[:n].tolist() and (bits & 192).tolist() == flags[:n].tolist()


def test_discounts_stay_between_zero_and_one():
    for counts in ([0] * 6, [5, 0, 0, 0, 0, 0], [10, 5, 3, 2, 1, 1], [1, 9, 9, 9, 9, 9], [0, 3, 0, 1, 0, 0]):
        d = katz.discounts(counts)
        assert all(0 < x <= 1 for x in d[1:]) and d[-1] == 1


def check_packing(rows, got, capacity=4096):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    left = {}
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4")
            key = (i, n, at, len(part), zlib.crc32(part.tobytes()))
            left[key] = left.get(key, 0) + 1
    sequences = {}
    for r in got:
        left[tuple(r)[:5]] -= 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not any(left.values())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    assert len(sequences) <= least * 1.02 + 1


def test_packing(docs, empty, corpus):
    check_packing(cases.DOCS, packing.pack_documents(docs, WORDS).collect())
    check_packing(corpus[0], packing.pack_documents(corpus[1], WORDS).collect())
    assert packing.pack_documents(empty, WORDS).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_sum_of_squares_places_everything(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 20)
    for b in set(bins.tolist()):
        at = 0
        for o, n in sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if x == b):
            assert o == at
            at += n
        assert at <= 20


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\t ab'sé1!\x1c　日́Σσ\x85<|>", max_size=30))
def test_word_tokenizer_equals_whole_texts(text):
    from tokenizers import Tokenizer

    if not hasattr(test_word_tokenizer_equals_whole_texts, "pair"):
        plain = Tokenizer.from_file(WORDS)
        plain.encode_special_tokens = True
        test_word_tokenizer_equals_whole_texts.pair = plain, packing.WordTokenizer(open(WORDS, encoding="utf-8").read())
    plain, own = test_word_tokenizer_equals_whole_texts.pair
    assert np.frombuffer(own([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["foo", " ", "\n", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "é", "'s", "bar"]), max_size=9))
def test_word_tokenizer_on_quoted_special_tokens(parts):
    from tokenizers import Tokenizer

    if not hasattr(test_word_tokenizer_on_quoted_special_tokens, "pair"):
        test_word_tokenizer_on_quoted_special_tokens.pair = (
            Tokenizer.from_file(WORDS), packing.WordTokenizer(open(WORDS, encoding="utf-8").read()))
    plain, own = test_word_tokenizer_on_quoted_special_tokens.pair
    text = "".join(parts)
    assert np.frombuffer(own([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_of_a_quoted_special_token(spark):
    rows = [(1, "foo <|endoftext|> bar"), (2, "foo<|endoftext|>bar"), (3, "plain")]
    check_packing(rows, packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect())


@pytest.fixture(scope="module")
def codec():
    entries, index = bpe._vocabulary(RANKS)
    return bpe.Codec(entries, index, tok.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=tok.PATTERN, special_tokens={},
                             mergeable_ranks={e: i for i, e in enumerate(codec.entries)})


def test_perfect_hash(codec):
    assert all(codec.index.get(e) == i for i, e in enumerate(codec.entries))
    assert sorted(codec.index.ids) == list(range(len(codec.entries)))
    assert codec.index.get(b"not an entry at all") == -1
    assert bpe.PerfectHash([]).get(b"a") == -1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t ab'sé1!\x1c　日́\x85 llre", max_size=40) | st.text(max_size=20))
def test_codec_equals_library(codec, reference, text):
    ids = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_rows(docs, empty, codec, reference):
    want = []
    for i, t in cases.DOCS:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert ordered(map(tuple, bpe.round_trip(docs, RANKS, tok.PATTERN).collect())) == ordered(want)
    encoded = bpe.encode(docs, RANKS, tok.PATTERN)
    back = bpe.decode(encoded, RANKS, tok.PATTERN).collect()
    assert ordered((r.doc_id, bytes(r.bytes)) for r in back) == ordered((i, (t or "").encode()) for i, t in cases.DOCS)
    assert bpe.round_trip(empty, RANKS, tok.PATTERN).collect() == []


def test_token_counts(docs, empty):
    import math

    import regex

    scores = {e: -math.log(i + 1) for i, e in enumerate(bpe.read_ranks(RANKS))}

    def best(token):
        found = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            found.append(max((found[s][0] + scores[token[s:end]], found[s][1] - 1)
                             for s in range(end) if token[s:end] in scores))
        return found[-1]

    find = regex.compile(tok.PATTERN).findall
    memo, want = {}, []
    for i, t in cases.DOCS:
        parts = find(t or "")
        for p in parts:
            memo.setdefault(p, None)
        want.append((i, parts))
    memo = {p: best(p.encode()) for p in memo}
    got = {(r.doc_id, r.n_pretokens, r.n_tokens, round(r.score, 3)) for r in tokencount.token_counts(docs, RANKS, tok.PATTERN).collect()}
    assert got == {(i, len(p), -sum(memo[x][1] for x in p), round(math.fsum(memo[x][0] for x in p), 3)) for i, p in want}
    assert tokencount.token_counts(empty, RANKS, tok.PATTERN).collect() == []


def test_substring(docs, empty, corpus):
    for rows, df in ((cases.DOCS, docs), corpus):
        got = substring.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect()
        assert ordered(map(tuple, got)) == ordered(cases.cut(rows))
    assert substring.remove_repeats(empty).collect() == []


def test_substring_keeps_other_columns(docs):
    out = substring.clean(docs)
    assert out.columns == docs.columns
    want = [(i, kept if n else t) for (i, t), (_, _, n, kept) in zip(cases.DOCS, cases.cut(cases.DOCS), strict=True)]
    assert ordered((r.doc_id, r.text) for r in out.collect()) == ordered(want)
    assert {r.bucket for r in out.collect()} == {"b"}


def test_repeated_stretches_are_maximal(spark):
    a = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, "x " + " ".join(a[5:40]) + " y " + " ".join(a[40:52]))],
                               "doc_id long, text string")
    assert {r.doc_id: r.repeats for r in substring.remove_repeats(df).collect()} == {1: [], 2: [1, 36]}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, empty, corpus, spark, percent):
    base = [f"t{i}" for i in range(200)]
    chain = [(1000 + k, " ".join(base[3 * k:] + [f"new{j}" for j in range(3 * k)])) for k in range(12)]
    rows = [r for r in cases.DOCS if r[1] != "the id of another text"] + chain
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == cases.near(rows, percent)
    assert [tuple(r)[2:] for r in got if r.doc_id is None] == [(None, True)]
    got = minhash.near_duplicates(corpus[1], percent).collect()
    assert sorted(map(tuple, got)) == cases.near(corpus[0], percent)
    assert minhash.near_duplicates(empty, percent).collect() == []


def test_near_duplicates_of_a_repeated_id(docs):
    got = minhash.near_duplicates(docs, 80).collect()
    assert len(got) == len(cases.DOCS)
    assert {r.component_id for r in got if r.doc_id == 15} == {15}


def test_near_duplicates_of_each_text_of_a_repeated_id(spark):
    def text(name, changed=0):
        return " ".join(f"{name}{i}" for i in range(200)) + "".join(f" new{changed}x{i}" for i in range(changed))

    rows = [(15, text("a")), (15, text("b")), (15, text("b")), (30, text("b", 8)), (31, text("a", 8)),
            (16, ""), (16, text("c")), (16, text("d")), (32, text("c", 8)), (33, text("d", 8)), (14, text("d", 5)),
            (40, text("e")), (41, text("e")), (41, text("f")), (42, text("f", 7)), (43, text("g")), (44, text("g", 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, minhash.near_duplicates(df, 80).collect()))
    assert got == cases.near(rows, 80)
    assert {i: c for i, _, c, _ in got} == {15: 15, 30: 15, 31: 15, 16: 14, 32: 14, 33: 14, 14: 14,
                                            40: 40, 41: 40, 42: 40, 43: 43, 44: 43}


def test_near_dedup_keeps_one_row_of_an_id(spark):
    import corpus_pipeline as pipeline

    rows = [(12, "a b c d e f g"), (12, "a b c d e f g"), (13, "a b c d e f g"), (15, "x y z"), (15, "other words"),
            (20, "alone here"), (None, "no id"), (None, "no id")]
    out = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert ordered(map(tuple, out)) == ordered([(12, "a b c d e f g"), (15, "other words"), (20, "alone here"),
                                                (None, "no id"), (None, "no id")])


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2 ** 63, 50, dtype=np.uint64)])) for _ in range(2))
    x = minhash.sketches([a, b, a[:1], a[:7]])
    assert abs((x[0] == x[1]).mean() - 0.8) < 0.06
    assert (minhash.sketches([a]) == x[0]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 103: 100, 105: 100}


def test_packing_keeps_words_in_one_case():
    from tokenizers import Tokenizer

    words, plain = packing.WordTokenizer(open(WORDS, encoding="utf-8").read()), Tokenizer.from_file(WORDS)
    texts = ["Word WORD word wORD, ÄÖ Éa İx", "Word <|endoftext|> A<|ENDOFTEXT|>B WORD", None, "a <| B"]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in words(texts)] == want
    words = packing.WordTokenizer(open(WORDS, encoding="utf-8").read())
    words(["Word WORD word wORD"])
    assert set(words.new) == {b"word"}
