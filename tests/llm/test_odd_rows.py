"""Column types and names, repeated labelled rows, and very long pre-tokens."""

import math
import random

import numpy as np
import public_tokenizers as tok
import pytest
from pyspark.sql import functions as F
from siemspark.llm import bpe, labels, packing, resample, rules, substring, tokencount
from siemspark.llm.common import TwoGenerationCache

A = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, A), (2, "x " + A), (3, "only  here"), (3, None), (None, A), (4, "")]


def cleaned(df):
    out = substring.clean(df)
    assert out.schema == df.schema
    return out.collect()


def test_clean_keeps_columns_that_have_its_own_names(spark):
    names = ["_llm_chunk", "chunk", "_chunk", "key", "string", "Chunk2", "kind", "bucket"]
    df = spark.createDataFrame([(*r, *[n * 10 + k for k in range(8)]) for n, r in enumerate(ROWS)],
                               "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)).repartition(3)
    got = cleaned(df)
    assert sorted(tuple(r)[2:] for r in got) == [tuple(n * 10 + k for k in range(8)) for n in range(len(ROWS))]
    assert {(r.chunk // 10): r.text for r in got} == {0: A, 1: "x", 2: "only  here", 3: None, 4: A, 5: ""}


@pytest.mark.parametrize("kind", ["int", "string", "short", "decimal(9,0)"])
def test_clean_takes_ids_of_other_types(spark, kind):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    assert sorted((repr(None if r.doc_id is None else int(r.doc_id)), r.text or "") for r in cleaned(df)) == \
        sorted([("1", A), ("2", "x"), ("3", "only  here"), ("3", ""), ("None", A), ("4", "")])


def test_clean_counts_characters_in_whole_numbers_only(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert {r.n_chars for r in cleaned(df.withColumn("n_chars", F.lit("many")))} == {"many"}
    got = cleaned(df.withColumn("n_chars", F.lit(7).cast("short")))
    assert {r.n_chars for r in got if r.text == "x"} == {1} and {r.n_chars for r in got if r.text == A} == {7}


def test_labelled_rows_are_bounded_by_the_limit(spark):
    docs = spark.createDataFrame([(1, f"copy {i % 7}") for i in range(5_000)] + [(2, "b"), (2, None), (3, None), (9, "z")],
                                 "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, labels.labelled(docs, known, 10).collect()))
    assert got == [(1, "copy 0", 0, 0), (2, "b", 1, 0), (3, None, 1, 1)]
    assert labels.labelled(docs, known, 1).count() <= 1
    assert resample.train(docs, known, 10).share.shape == (3,)


def test_trees_do_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one, two = rules.train(docs, known), rules.train(docs.repartition(7), known.repartition(5))
    assert one is not None
    for name in ("feature", "threshold", "value"):
        if hasattr(one, name):
            assert np.array_equal(getattr(one, name), getattr(two, name))


def test_long_pre_tokens_make_no_nodes():
    rnd = random.Random(2)
    entries = bpe.read_ranks(tok.path("byte_bpe_50k.tiktoken"))
    trie = tokencount.Trie(entries)
    for n in (1, 50, tokencount.LONG):
        token = bytes(rnd.choice(b"abcdeth ") for _ in range(n))
        assert trie.ring(token) == pytest.approx(trie.insert(token))
    before = len(trie.best)
    token = b"thequickbrownfox" * 400
    pieces, score = trie.insert(token)
    assert len(trie.best) == before and pieces >= 400 and score < 0
    counter = tokencount.Counter(entries, tok.PATTERN)
    text = "short " + "x" * 5_000 + " " + "y" * 3_000
    parts = counter.find(text)
    assert counter(text) == (len(parts), sum(trie.insert(p.encode())[0] for p in parts),
                             pytest.approx(math.fsum(trie.insert(p.encode())[1] for p in parts)))
    assert max(map(len, counter.pieces)) < 100


def test_memos_keep_no_long_keys():
    memo = TwoGenerationCache(len, 10, longest=5)
    assert [memo["abc"], memo["a" * 9]] == [3, 9] and list(memo.new) == ["abc"]


def plain_sum_of_squares(lengths, capacity):
    """The rule as it reads: the least sum of squared counts of open bins, then the smaller gap, then a new bin last."""
    bins, out = [], []
    for size in lengths:
        best = None
        for g in [*sorted({b for b in bins if b >= size}), None]:
            after = list(bins)
            if g is not None:
                after.remove(g)
            left = (capacity if g is None else g) - size
            counts = {}
            for b in [*after, *([left] if left else [])]:
                counts[b] = counts.get(b, 0) + 1
            cost = sum(c * c for c in counts.values())
            if best is None or cost < best[0]:
                best = cost, g, [*after, *([left] if left else [])]
        out.append(best[1])
        bins = best[2]
    return out


def test_sum_of_squares_follows_the_rule_at_ties():
    rnd = random.Random(4)
    for _ in range(200):
        lengths = [rnd.randrange(1, 11) for _ in range(rnd.randrange(30))]
        bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 10)
        want = plain_sum_of_squares(lengths, 10)
        got = [None if o == 0 else 10 - o for o in offsets.tolist()]
        assert got == want


@pytest.mark.parametrize("text", ["End. END, <|endoftext|>. <|ENDOFTEXT|>! é. É! ×. x². 3.14? don't. 'S. a'S, naïve; ½. ß: İ. Σ. ΟΔΟΣ. "
                                  "é. ́. ...!? a.b, .a <|. |>. 日本. ª. µ."])
def test_parts_of_words_give_the_ids_of_whole_texts(text):
    from tokenizers import Tokenizer

    path = tok.path("word_bpe_49k.json")
    own = packing.WordTokenizer(open(path, encoding="utf-8").read())
    plain = Tokenizer.from_file(path)
    for part in [text, *text.split()]:
        assert np.frombuffer(own([part])[0], "<u4").tolist() == plain.encode(part, add_special_tokens=False).ids


def test_word_tokens_of_documents(spark):
    from tokenizers import Tokenizer

    path = tok.path("word_bpe_49k.json")
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own, plain = packing.WordTokenizer(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    want = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == want


@pytest.mark.parametrize("page", [
    "<a " * 300_000, '<a "' * 200_001 + '>"', "<div>" * 20_000, "<p><table>" + "<div>" * 20_000, "<" * 500_000,
    "<ul>" + "<li><div>" * 10_000, "<article>" * 20_000 + "text", "<div class=ad>" * 20_000 + "text",
    "<span class=ad>" * 20_000 + "text", "</p>" * 50_000, "<!-- " * 100_000,
])
def test_broken_pages_take_time_in_proportion(page):
    import time

    from siemspark.llm import wrapper

    start = time.process_time()
    text = wrapper.Page(page).text()
    assert time.process_time() - start < 15
    assert len(text) <= len(page)


def test_many_siblings_are_aligned_in_little_time():
    import time

    from siemspark.llm import wrapper

    def page(n, word):
        rows = "".join(f"<div class=r{i % 37}><p>{word} row {i}</p></div>" for i in range(n))
        return f"<body><div class=top><p>Site</p></div><div class=main>{rows}<p>{word} end</p></div></body>"

    start = time.process_time()
    found = wrapper.induce([page(1_500 + 3 * k, w) for k, w in enumerate(["red", "green", "blue"])])
    assert time.process_time() - start < 10
    assert found["path"][-1].startswith("div") and "Site" not in " ".join(found["path"])


def test_matching_pairs_children_in_order():
    from siemspark.llm import wrapper
    from siemspark.llm.dom import parse

    def tree(labels):
        return wrapper.folded(parse("".join(f"<div class={c}><p>x</p></div>" for c in labels)))

    rnd = random.Random(8)
    for wide in (False, True):
        for _ in range(60):
            a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(60) if wide else rnd.randrange(9))] for _ in range(2))
            left, right = tree(a), tree(b)
            n, pairs = wrapper.matching(left, right, {})
            at = [(left.children.index(x), right.children.index(y)) for x, y in pairs]
            assert at == sorted(at) and len({i for i, _ in at}) == len(at) == len({j for _, j in at})
            assert all(x.label == y.label for x, y in pairs) and n >= 1 + 2 * len(pairs)
