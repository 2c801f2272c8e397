"""Alignment of two tokenizers over the same texts, and corpus-wide counts of aligned id pairs.

Both tokenizers read the same bytes: a space and the text.  Spans give coarse cuts:
character offsets of ``tokenizers`` (A) and byte spans of the sentencepiece proto (B).  Where
several tokens share one character (multibyte characters that A splits, byte-fallback
tokens of B) the lengths of the decoded bytes refine them.  Offsets where tokens of both end cut a text into
groups; the two tokens that end at such an offset are linked.

Neither tokenizer joins across a space that follows a character that is no white space, nor a letter and a mark (checked
when B is loaded), so texts are cut there and every different segment is aligned once per chunk of documents, and once in
a worker while its memo holds it.  A chunk keeps the segment numbers of its documents and lists each id pair once with
its count; pairs are summed over all chunks by Spark, the sums go back to the chunks by a join on the pair.
A pair is at most one row of a chunk, however many documents hold it.

Defined results: texts that are null, empty, or whose tokens do not give back their bytes have no tokens
and a row of zeros with an empty digest.  Repeated rows count as often as they occur; a null ``doc_id`` is carried along.
Long texts are cut into segments piece by piece; segments above ``LONG`` characters are aligned but not remembered.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemspark.llm.common import chunks, fixed_bytes, from_fixed_bytes, id_text, stage, worker_store

CHUNK = 2_000_000  # characters of the documents of one chunk
PIECE = 1_000_000  # characters cut into segments at once
CARRIER = 20_000  # characters of new segments that are encoded as one text
LONG = 4_000
MEMO = 4_000_000  # characters of the segments in each of two generations, each counted with ENTRY more
ENTRY = 16
GROUP = 8 << 20  # bytes of a row group of chunks: writers hold one, readers get all rows of one at once
SPACE_MARK = "▁"

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Where texts are cut: before a space behind other than white space, and between a letter and an ASCII mark.
SEGMENT = re.compile(rf"(?<=\S)(?= .)|(?<=[{LETTERS}])(?=[!-/:-@\[-`{{-~])", re.S)
#: Stands before a segment that begins with a mark.
FILLER = " a"
CHUNKS = ("chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
          "digests array<string>, doc_segments binary, doc_sizes binary, segment_links binary, segment_sizes binary, "
          "pairs array<long>, times array<long>")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def segments(text: str) -> Iterator[list[str]]:
    """Stretches of a text that both tokenizers encode alone, in lists of bounded size."""
    at = 0
    while len(text) - at > PIECE:
        cut = SEGMENT.search(text, at + PIECE)
        if cut is None:
            break
        yield SEGMENT.split(text[at:cut.start()])
        at = cut.start()
    yield SEGMENT.split(text[at:] if at else text)


def byte_level() -> dict[str, int]:
    """Bytes by the character that stands for them in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Tokenizers:
    """The two tokenizers and the bytes of their ids."""

    def __init__(self, definition: str, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model)
        to_byte, vocabulary = byte_level(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            known = all(c in to_byte for c in token)
            self.a_bytes[number] = bytes(to_byte[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # A piece with a space after another character, or a mark after a letter, would join segments.
        inside = re.compile(rf"[^{SPACE_MARK}]{SPACE_MARK}|[{LETTERS}][!-/:-@\[-`{{-~]")
        self.separable = not any(inside.search(p) for i, p in enumerate(pieces) if not (
            self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))

    def encode(self, texts: list[str]) -> list[tuple | None]:
        """(ids of A, their byte ends, ids of B, their byte ends) of texts that begin with a space.

        None where the tokens do not give back the bytes.
        """
        out = []
        of_a = self.a.encode_batch(texts, add_special_tokens=False)
        of_b = self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)
        for text, a, b in zip(texts, of_a, of_b, strict=True):
            data = text.encode()
            a_ids, b_spans = a.ids, [(p.id, p.begin, p.end) for p in b.pieces]
            b_ids = [i for i, _, _ in b_spans]
            if b"".join([self.a_bytes[i] for i in a_ids]) != data or b"".join([self.b_bytes[i] for i in b_ids]) != data:
                out.append(None)
                continue
            a_ids, b_ids = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
            # Bytes before each character.
            if len(data) == len(text):
                before = None
            else:
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                before = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
            spans = np.fromiter(chain.from_iterable(a.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2)
            if before is not None:
                spans = before[spans]
            a_end = refine(spans[:, 0], spans[:, 1], self.a_size[a_ids])
            # Spans of B leave out the space that it adds.
            b_spans = np.fromiter(chain.from_iterable(b_spans), np.int64, 3 * len(b_ids)).reshape(-1, 3)[:, 1:] + 1
            b_spans[:1, 0] = 0
            out.append((a_ids, a_end, b_ids, refine(b_spans[:, 0], b_spans[:, 1], self.b_size[b_ids])))
        return out


def refine(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: those of the spans, except where spans share or lack bytes.

    There the sizes of the decoded bytes are added up from the last span that is sure.
    """
    sure = end - begin == size
    if len(sure) > 1:
        # The span must also follow the one before and be followed by the next.
        meets = end[:-1] == begin[1:]
        sure[1:] &= meets
        sure[:-1] &= meets
    if sure.all():
        return end
    total = np.cumsum(size)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(size)), -1))
    from_sure = np.where(last >= 0, end[last] - total[last], 0)
    return np.where(sure, end, from_sure + total)


def aligned(a_ids, a_end, b_ids, b_end) -> tuple[np.ndarray, np.ndarray]:
    """Positions in A and in B of the tokens that end at common offsets."""
    _, in_a, in_b = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
    return in_a, in_b


def group_texts(a_ids, b_ids, in_a, in_b) -> list[str]:
    """Each group as ``a1,a2|b1,b2``."""
    a, b, out, i, j = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist())), [], 0, 0
    for x, y in zip((in_a + 1).tolist(), (in_b + 1).tolist(), strict=True):
        out.append((a[i] if x == i + 1 else ",".join(a[i:x])) + "|" + (b[j] if y == j + 1 else ",".join(b[j:y])))
        i, j = x, y
    return out


class Aligner:
    """Alignments of segments: (tokens of A, tokens of B, links as 64-bit id pairs, groups as text), or None."""

    def __init__(self, definition: str, model: bytes):
        self.tokenizers = Tokenizers(definition, model)
        self.new: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.size = 0

    def pieces(self, text: str) -> Iterator[list[str]]:
        return segments(text) if self.tokenizers.separable else iter([[text]])

    def __call__(self, wanted: list[str]) -> list[tuple | None]:
        """Alignments of different segments."""
        new, old, found, carrier, size = self.new, self.old, {}, [], 0
        for segment in wanted:
            if segment in new:
                continue
            if segment in old:
                found[segment] = old[segment]
            # Only segments that end in a character that is no white space can stand before others.
            elif len(segment) > LONG or segment[-1].isspace() or not self.tokenizers.separable:
                self._align([segment], found)
            else:
                carrier.append(segment)
                size += len(segment)
                if size > CARRIER:
                    self._align(carrier, found)
                    carrier, size = [], 0
        if carrier:
            self._align(carrier, found)
        out = [found[s] if s in found else new[s] for s in wanted]
        kept = {s: v for s, v in found.items() if len(s) <= LONG}
        size = sum(map(len, kept)) + ENTRY * len(kept)
        if self.size + size > MEMO:
            self.old, self.new, self.size = new, {}, 0
        self.new.update(kept)
        self.size += size
        return out

    def _align(self, segments: list[str], into: dict) -> None:
        group = []
        for segment in segments:
            if segment[0] != " ":
                group.append(FILLER)
            group.append(segment)
        text = "".join(group)
        found = self.tokenizers.encode([text])[0]
        if found is None:
            if len(segments) == 1:
                into[segments[0]] = None
            else:
                for segment in segments:
                    self._align([segment], into)
            return
        a_ids, a_end, b_ids, b_end = found
        in_a, in_b = aligned(*found)
        sizes = map(len, group) if a_end[-1] == len(text) else [len(s.encode()) for s in group]
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(group)))
        at_a, at_b = np.searchsorted(a_end, ends, "right"), np.searchsorted(b_end, ends, "right")
        at_group = np.searchsorted(in_a, at_a)
        pairs = (a_ids[in_a] << 32 | b_ids[in_b]).tobytes()
        texts = group_texts(a_ids, b_ids, in_a, in_b)
        i = j = g = 0
        for segment, x, y, z in zip(group, at_a.tolist(), at_b.tolist(), at_group.tolist(), strict=True):
            into[segment] = (x - i, y - j, pairs[8 * g:8 * z], ";".join(texts[g:z]).encode())
            i, j, g = x, y, z


class Chunk:
    """Documents that list their different segments and id pairs once."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.number = aligner, {}
        # By segment number; ``broken`` are those whose tokens do not give back their bytes.
        self.n_a, self.n_b, self.links, self.texts, self.broken = [], [], [], [], set()
        self.ids, self.digests, self.doc_segments = [], [], []

    def extend(self, ids: list, texts: list[str | None]) -> None:
        """Adds documents; those of ordinary length learn their segments together."""
        group, size = [], 0
        for key, text in zip(ids, texts, strict=True):
            if text and len(text) > PIECE:
                self._finish(group)
                group, size = [], 0
                self._finish_long(key, self.aligner.pieces(" " + text))
                continue
            group.append((key, list(chain.from_iterable(self.aligner.pieces(" " + text))) if text else []))
            size += len(text or "")
            if size > PIECE // 4:
                self._finish(group)
                group, size = [], 0
        self._finish(group)

    def _learn(self, found) -> None:
        number = self.number
        different = [s for s in dict.fromkeys(found) if s not in number]
        for s, value in zip(different, self.aligner(different), strict=True):
            if value is None:
                self.broken.add(len(self.n_a))
            a, b, links, groups = value or (0, 0, b"", b"")
            number[s] = len(self.n_a)
            self.n_a.append(a)
            self.n_b.append(b)
            self.links.append(links)
            self.texts.append(groups)

    def _finish(self, group: list[tuple]) -> None:
        self._learn(chain.from_iterable(parts for _, parts in group))
        for key, parts in group:
            self._finish_long(key, [parts] if parts else [], known=True)

    def _finish_long(self, key, pieces, known: bool = False) -> None:
        parts, digest = [], hashlib.sha256()
        for piece in pieces:
            if not known:
                self._learn(piece)
            at = list(map(self.number.__getitem__, piece))
            if self.broken and not self.broken.isdisjoint(at):
                parts = []
                break
            if parts:
                digest.update(b";")
            digest.update(b";".join(map(self.texts.__getitem__, at)))
            parts.append(np.array(at, np.uint32))
        self.ids.append(key)
        self.digests.append(digest.hexdigest() if parts else "")
        self.doc_segments.append(np.concatenate(parts) if parts else np.empty(0, np.uint32))

    def batch(self, number: int) -> pa.RecordBatch:
        sizes = np.array([len(x) // 8 for x in self.links], np.int64)
        links = np.frombuffer(b"".join(self.links), np.int64)
        doc_sizes = np.array([len(x) for x in self.doc_segments], np.int64)
        of_docs = np.concatenate([*self.doc_segments, np.empty(0, np.uint32)])
        pairs, at = np.unique(links, return_inverse=True)
        often = np.bincount(of_docs, minlength=len(sizes))
        times = np.bincount(at, np.repeat(often, sizes), len(pairs)).astype(np.int64)
        counts = [sums(np.array(x, np.int64)[of_docs], doc_sizes) for x in (self.n_a, self.n_b, sizes)]
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *[pa.array([c], longs) for c in (self.ids, *counts)],
             pa.array([self.digests], pa.list_(pa.string())),
             *[pa.array([compact(x)], pa.binary()) for x in (of_docs, doc_sizes, at, sizes)],
             pa.array([pairs], longs), pa.array([times], longs)],
            names=[c.split()[0] for c in CHUNKS.split(", ")])


def compact(values: np.ndarray) -> bytes:
    """Unsigned integers of as few bytes as all of them fit, behind one byte that tells how many."""
    width = max(1, -(-int(values.max() if len(values) else 0).bit_length() // 8))
    return bytes([width]) + fixed_bytes(values.astype(np.uint64), width)


def expanded(data: bytes) -> np.ndarray:
    return from_fixed_bytes(data[1:], data[0]).astype(np.int64)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given sizes."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return ends[at[1:]] - ends[at[:-1]]


def chunk_rows(docs: DataFrame, definition_path: str, model_path: str) -> DataFrame:
    """One row per chunk of documents: their digests, segments, and id pairs with counts."""
    context = docs.sparkSession.sparkContext
    # As large as the vocabulary files, whatever the corpus.
    definition = context.broadcast(open(definition_path, encoding="utf-8").read())
    model = context.broadcast(open(model_path, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        store = worker_store("aligners")
        name = (definition_path, model_path)
        if name not in store:
            store[name] = Aligner(definition.value, model.value)
        first = TaskContext.get().partitionId() << 32
        for n, (ids, texts) in enumerate(chunks(batches, CHUNK, lambda t: len(t or ""))):
            chunk = Chunk(store[name])
            chunk.extend(ids, texts)
            yield chunk.batch(first + n)

    return id_text(docs).mapInArrow(run, CHUNKS)


def _score(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Document rows of one chunk, given the count of each of its pairs and whether it is its B id's highest."""
    worker_store("scores")  # the tokenizers of earlier tasks go
    row = {name: rows[name][0] for name in rows.column_names}
    at = answers["pos"].to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = answers["n"].to_numpy(), answers["best"].to_numpy(zero_copy_only=False)

    links, sizes, of_docs, doc_sizes = (
        expanded(row[name].as_py()) for name in ("segment_links", "segment_sizes", "doc_segments", "doc_sizes"))
    total = sums(sums(count[links], sizes)[of_docs], doc_sizes)
    highest = sums(sums(best[links], sizes)[of_docs], doc_sizes)
    return pa.table({
        "doc_id": row["doc_ids"].values, "n_a": row["n_a"].values, "n_b": row["n_b"].values,
        "n_groups": row["n_groups"].values, "n_links": pa.array(sums(sizes[of_docs], doc_sizes)),
        "n_best": pa.array(highest), "count_sum": pa.array(total), "groups_sha256": row["digests"].values})


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) over all chunks: pair = A id * 2^32 + B id, best if no pair of its B id has a higher n."""
    asked = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = asked.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, definition_path: str, model_path: str) -> DataFrame:
    """Token, group and link numbers of every document, and how common its links are in the corpus."""
    rows = stage(chunk_rows(docs, definition_path, model_path), "alignments", group_bytes=GROUP)
    counts = stage(pair_counts(rows), "pairs")
    asked = rows.select(F.col("chunk").alias("of_chunk"), F.posexplode("pairs").alias("pos", "pair"))
    answers = asked.join(counts, "pair").select("of_chunk", "pos", "n", "best")
    kept = rows.drop("pairs", "times")
    return kept.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(_score, RESULT)
