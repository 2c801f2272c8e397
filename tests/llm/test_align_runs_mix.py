"""Tokenizer alignment, periodic runs and source mixing: odd rows and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import cases
import numpy as np
import public_tokenizers as tok
import pyarrow.parquet as pq
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from siemspark.llm import align, mixing, squares

A, B = tok.path("byte_bpe_50k.json"), tok.path("piece_bpe_32k.model")
ODD = ["</s> <|endoftext|> <unk>▁ <0x41>", "▁mark", "a ▁", " ", "  ", "\n", " \n ", "x  ", "x \t y\n\n z", "日本𓀀 é é",
       "\x00 nul\x1c x", "𓀀𓀀", "don't  can't", "  x", "x" * 5000, "ab " * 3000, "<0x0A>", "<s> x"]


def ordered(rows):
    return sorted(rows, key=repr)


# --- alignment -------------------------------------------------------------

@pytest.fixture(scope="module")
def whole():
    return plain_tokenizers()


def plain_tokenizers():
    """(ids, bytes of each token) of whole texts, from the libraries' own vocabularies."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {chr(c): bytes([c]) for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174}
    free = iter(range(256, 400))
    letters |= {chr(next(free)): bytes([c]) for c in range(256) if chr(c) not in letters}

    def of_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return ids, [b"".join(letters[c] for c in a.id_to_token(i)) for i in ids]

    def of_b(text):
        ids = b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids]
        return ids, [bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) and b.is_byte(i) else p.replace("▁", " ").encode()
                     for i, p in zip(ids, pieces, strict=True)]

    return of_a, of_b


def plain_alignment(rows, whole):
    found, count = [], Counter()
    for key, text in rows:
        (a, x), (b, y) = (whole[0](text), whole[1](text)) if text else (([], []), ([], []))
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            found.append((key, 0, 0, [], ""))
            continue
        groups, i, j, at_a, at_b, p, q = [], 0, 0, 0, 0, 0, 0
        while i < len(a):
            at_a += len(x[i])
            i += 1
            while j < len(b) and at_b + len(y[j]) <= at_a:
                at_b += len(y[j])
                j += 1
            if at_a == at_b:
                groups.append((a[p:i], b[q:j]))
                p, q = i, j
        links = [(g[-1], h[-1]) for g, h in groups]
        count.update(links)
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        found.append((key, len(a), len(b), links, hashlib.sha256(text.encode()).hexdigest()))
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(key, na, nb, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), sha)
            for key, na, nb, links, sha in found]


def test_alignment(spark, docs, empty, corpus, whole):
    assert ordered(map(tuple, align.align_documents(docs, A, B).collect())) == ordered(plain_alignment(cases.DOCS, whole))
    rows = [(n, t) for n, t in enumerate(ODD)] + [(3, ODD[0]), (None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = align.align_documents(odd, A, B).collect()
    assert ordered(map(tuple, got)) == ordered(plain_alignment(rows, whole))
    assert {r.groups_sha256 for r in got if not r.n_a} == {""}
    assert align.align_documents(empty, A, B).collect() == []


def test_alignment_query(spark, corpus, whole):
    from siemspark.llm.catalog import QUERIES

    got = QUERIES["op11_align_tokenizers"](spark, "/root/testdata/sf0.001").collect()
    assert ordered(map(tuple, got)) == ordered(plain_alignment(corpus[0], whole))


def test_alignment_in_many_chunks(corpus, whole, monkeypatch):
    """Counts are those of the corpus, however documents are dealt to chunks and texts to windows."""
    monkeypatch.setattr(align, "CHUNK", 3000)
    monkeypatch.setattr(align, "PIECE", 50)
    got = align.align_documents(corpus[1], A, B).collect()
    assert ordered(map(tuple, got)) == ordered(plain_alignment(corpus[0], whole))


def test_chunks_are_staged_in_bounded_row_groups(corpus, whole, monkeypatch):
    """A reader gets all rows of a row group at once, and chunks are rows of megabytes."""
    staged, real = {}, align.stage
    monkeypatch.setattr(align, "CHUNK", 3000)
    monkeypatch.setattr(align, "GROUP", 100_000, raising=False)
    monkeypatch.setattr(align, "stage", lambda df, name, *a, **k: staged.setdefault(name, real(df, name, *a, **k)))
    got = align.align_documents(corpus[1].coalesce(1), A, B).collect()
    assert ordered(map(tuple, got)) == ordered(plain_alignment(corpus[0], whole))
    found = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in staged["alignments"].inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in found for i in range(m.num_row_groups)]
    assert len(sizes) > 3 and max(sizes) < 200_000


def test_memo_of_long_segments_is_bounded(monkeypatch):
    monkeypatch.setattr(align, "MEMO", 20_000)
    aligner = align.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    wanted = [f" {n}{'日本' * 400}" for n in range(200)]
    first = [aligner([s])[0] for s in wanted]
    assert sum(map(len, [*aligner.new, *aligner.old])) <= 40_000
    assert first == [aligner([s])[0] for s in wanted]


@pytest.mark.parametrize("most", [0, 255, 256, 65_536, 1 << 24, (1 << 32) - 1])
def test_compact_numbers(most):
    for values in (np.array([3 % (most + 1), most, 0]), np.empty(0, np.int64)):
        data = align.compact(values)
        assert align.expanded(data).tolist() == values.tolist()
        assert len(data) == 1 + len(values) * max(1, -(-most.bit_length() // 8))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t ab'sé1!\x1c　日𓀀▁<|>0xA", min_size=1, max_size=30))
@example("a 日 𓀀b")
def test_spans_and_bytes_give_the_same_ends(text):
    state = test_spans_and_bytes_give_the_same_ends.__dict__
    if "t" not in state:
        state["t"] = align.Tokenizers(open(A, encoding="utf-8").read(), open(B, "rb").read())
        state["whole"] = plain_tokenizers()
        state["aligner"] = align.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    found = state["t"].encode([" " + text])[0]
    (a, x), (b, y) = state["whole"][0](text), state["whole"][1](text)
    if found is None:
        assert b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode()
        return
    assert found[0].tolist() == a and found[2].tolist() == b

    def ends(parts):
        return [sum(map(len, parts[:n + 1])) for n in range(len(parts))]

    assert found[1].tolist() == ends(x) and found[3].tolist() == ends(y)
    chunk = align.Chunk(state["aligner"])
    chunk.extend([1], [text])
    row = chunk.batch(7).to_pylist()[0]
    assert tuple(row[c][0] for c in ("doc_ids", "n_a", "n_b", "n_groups", "digests")) == \
        tuple(plain_alignment([(1, text)], state["whole"])[0][i] for i in (0, 1, 2, 3, 7))


# --- runs ------------------------------------------------------------------

def plain_runs(x, least=24, times=3):
    out = []
    for p in range(1, len(x) // times + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            n = j + p - i
            if j > i and n >= max(least, times * p) and not any(x[i:j + p - q] == x[i + q:j + p] for q in range(1, p)):
                out.append((i, n, p))
            i = j + 1
    return sorted(out)


def plain_row(key, text):
    w = cases.words(text)
    n, h = len(w), zlib.crc32(str(key).encode())
    if key is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (key, len(runs), *top, hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_document_runs(spark, docs, empty):
    cut = [(i, t) for i, t in cases.DOCS if t != cases.LONG and t != cases.LONG + " tail"]
    more = [(20, "a " * 23), (21, "a " * 24), (22, "a b c d e f g h " * 3), (23, "a b c d e f g h i " * 2),
            (30, ("x y " * 12 + "z ") * 4), (30, ("x y " * 12 + "z ") * 4), (None, "q " * 30), (24, "a " * 24 + "b " * 24)]
    got = {r[0]: r for r in map(tuple, squares.document_runs(docs).collect())}
    assert all(got[i] == plain_row(i, t) for i, t in cut if i not in (12, 15, None))
    df = spark.createDataFrame(more, "doc_id long, text string").repartition(3)
    assert ordered(map(tuple, squares.document_runs(df).collect())) == ordered(plain_row(i, t) for i, t in more)
    assert squares.document_runs(empty).collect() == []


def test_runs_query(spark, corpus):
    from siemspark.llm.catalog import QUERIES

    rows = [r for r in corpus[0] if len(r[1] or "") < 6000]
    assert len(rows) > 150
    got = {r[0]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(corpus[0])
    assert all(got[i] == plain_row(i, t) for i, t in rows)
    assert sum(got[i][1] > 0 for i, _ in rows) > 5


UNITS = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 7)), max_size=9)


@settings(max_examples=300, deadline=None)
@given(UNITS, st.sampled_from([24, 9, 6, 1]), st.sampled_from([3, 4]))
@example([([0] * 14, 7), ([1], 1), ([0] * 14, 7), ([1], 1), ([0] * 14, 7)], 24, 3)
def test_catcher_finds_all_runs(units, least, times):
    x = [i for u, n in units for i in u * n]
    assert squares.online_runs(x, least, times) == plain_runs(x, least, times)
    assert squares.text_runs([str(i).encode() for i in x], least, times) == plain_runs(x, least, times)


def test_catcher_reports_while_words_come():
    catcher = squares.SquareCatcher()
    for i in [*range(9)] * 4 + [99]:
        catcher.append(i)
    assert catcher.runs == [(0, 36, 9)]


def test_long_periodic_text_takes_little_time():
    x = ([0] * 100 + [1]) * 300
    runs = squares.online_runs(x)
    assert len(runs) == 301 and (0, len(x), 101) in runs


# --- mixing ----------------------------------------------------------------

def plain_targets(size, weights=(5, 2, 1)):
    """Targets by source: water is poured into vessels of twice their words."""
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    left, open_, out = Fraction(3, 2) * sum(size.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not above:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in above:
            out[s] = Fraction(2 * size[s])
            left -= out[s]
        open_ -= above
    return out


def check_mix(rows, got):
    size = defaultdict(int)
    for _, source, text in rows:
        size[source] += len(cases.words(text))
    want, taken = plain_targets(size), Counter()
    assert sorted([(r.doc_id, r.source, r.size) for r in got], key=repr) == \
        sorted([(i, s, len(cases.words(t))) for i, s, t in rows], key=repr)
    copies = Counter((r.doc_id, r.source, r.size) for r in got)
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(float(want[r.source]))
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in size:
        most = max([n for (_, source, _), n in copies.items() if source == s])
        assert abs(taken[s] - want[s]) <= most


def test_mix(spark, empty, corpus):
    rows = [(i, ["b", "a", None, "", "\U0001f642", "～"][n % 6], t) for n, (i, t) in enumerate(cases.DOCS)]
    rows += [(1000 + n, "big", "w " * 50) for n in range(60)] + [(7, "copies", "same words here")] * 30
    rows += [(2000, "no words", None), (None, "big", "w " * 50), (None, "big", "w " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df = df.withColumns({k: F.lit(v) for k, v in {**cases.EXTRA, "size": "x", "target": 1, "draw": 2, "copies": 3}.items()})
    got = mixing.mix(df).collect()
    check_mix(rows, got)
    assert ordered(map(tuple, mixing.mix(df.repartition(5, "n", "text")).collect())) == ordered(map(tuple, got))
    assert mixing.mix(empty.withColumn("source", F.lit("s"))).collect() == []
    silent = spark.createDataFrame([(1, "a", None), (2, "b", " ")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in mixing.mix(silent).collect()] == [(0.0, 0)] * 2


def test_mix_writes_many_copies_in_lots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    rows = [(7, "copies", "same words here")] * 30 + [(8, "copies", "x"), (9, "other", "x y z " * 40)]
    check_mix(rows, mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect())


def test_mix_depends_on_the_seed(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = ({r.doc_id: r.taken for r in mixing.mix(df, seed=s).collect()} for s in ("1", "2"))
    assert one != two
    check_mix([(r.doc_id, r.source, r.text) for r in df.collect()], mixing.mix(df).collect())


def test_mix_refuses_what_it_cannot_do(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    for bad in ({"weights": ()}, {"weights": (1, 0)}, {"share": 3.0}):
        with pytest.raises(ValueError, match="weights"):
            mixing.mix(df, **bad)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=12))
def test_water_level(spark, words):
    size = {f"s{n:02}": w for n, w in enumerate(words)}
    counted = spark.createDataFrame(list(size.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(counted, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == {s: pytest.approx(float(t)) for s, t in plain_targets(size).items()}
