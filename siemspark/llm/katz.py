"""Katz backoff language model: counts in partitioned tables, recursive evaluation per token.

Tokens are words and one end per document; the first token's history is a start mark.
For every order the probability of a token after a history is its Good-Turing
discounted relative frequency if the two were seen together, else the backoff weight
of the history times the probability after the history without its first token.  A
backoff weight is the mass that discounting left over, divided by the mass that the
shorter history gives to tokens not seen after the longer one, so probabilities sum to
exactly 1 over the known tokens and one unknown one.

Documents are dealt into chunks and their words become numbers once: a chunk is stored as one
row, its different words and a number per token, and all later passes read that row, so texts
travel once.  A chunk asks for its distinct n-grams of each order, with how often they
occur in its training documents.  The buckets add up counts; the table of answers
(kind=count, by order) holds every n-gram's count, for its owner marked as such: every
n-gram is owned by the first chunk that has it.  Keys travel as distances in ascending order
and counts as one byte, larger ones behind.  Owners add up what backoff weights need, by
history, in a second exchange.
Only histories in held-out text or seen more often than ``CUT`` take part: after all others
nothing is backed off and every count is discounted (``Model.asked``).  A last pass evaluates all n-grams of a chunk, shortest first, and sums them by token.
So a word pair that all documents hold is one entry per chunk, never one per document.

Where count-of-counts give no discount between 0 and 1, absolute discounting stands in.
A history whose counts are all beyond discounting gives up half a count.

Defined results: null and empty texts are the end token alone.  Rows that repeat a
``doc_id`` count as often as they occur.  A null ``doc_id`` is held out.  Without
training tokens every token is unknown and has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemspark.llm.common import (bucket_count, fixed_bytes, from_fixed_bytes, id_text, mix64, stage, text_bytes,
                                  word_hashes)
from siemspark.llm.exchange import chunk_count, pack_rows, starts, with_chunk

CUT = 5  # counts above are not discounted
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
ROWS = "kind string, level int, bucket int, chunk int, keys binary, data binary, stats array<long>"
TOKENS = "chunk int, ids array<long>, held array<boolean>, sizes array<long>, words binary, tokens binary"
LEAST_BITS = 58  # of an n-gram's key; 48 below its bucket if there are more than 1,024 of them
LARGE, OWNER, WANTED = 63, np.uint8(64), np.uint8(128)
SURE = 2e-12
BUCKET_TOKENS, LEAST_BUCKETS = 3_000_000, 64
LEAST_SQUEEZED = 4_096


def squeezed(data: bytes) -> bytes:
    """Compressed, unless it is too short to gain from it; the raw length comes first, or 0."""
    if len(data) < LEAST_SQUEEZED:
        return bytes(8) + data
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else data[8:]


class Keys:
    """The part of ascending keys below their bucket, as distances from one to the next."""

    def __init__(self, buckets: int):
        top = buckets.bit_length() - 1
        bits = min(64, max(LEAST_BITS, top + 48))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << (bits - top)) - 1)
        self.width = -(-(bits - top) // 8)

    def below(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift) & self.mask

    def packed(self, keys: np.ndarray) -> bytes:
        """Of keys of one bucket."""
        return squeezed(fixed_bytes(np.diff(self.below(keys), prepend=np.uint64(0)), self.width))

    def read(self, data: bytes) -> np.ndarray:
        return np.cumsum(from_fixed_bytes(unsqueezed(data), self.width), dtype=np.uint64)


def packed_counts(count: np.ndarray, flags: np.ndarray) -> bytes:
    """A byte for each count, with its flags; large ones follow in eight bytes."""
    small = np.minimum(count, LARGE).astype(np.uint8) | flags
    return squeezed(len(count).to_bytes(8, "little") + small.tobytes() + count[count >= LARGE].astype("<i8").tobytes())


def read_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and the bytes with the flags."""
    data = unsqueezed(data)
    n = int.from_bytes(data[:8], "little")
    small = np.frombuffer(data, np.uint8, n, 8)
    count = (small & np.uint8(LARGE)).astype(np.int64)
    count[count == LARGE] = np.frombuffer(data, "<i8", offset=8 + n)
    return count, small


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, a place of each, and for every key which it is."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def _tokens(table: pa.Table) -> pa.Table:
    """The documents of a chunk as one row."""
    number = table["chunk"][0].as_py()
    table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    tokens = []
    for text in table["text"].to_pylist():
        parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        tokens.append(np.append(word_hashes(parts), np.uint64(0)))
    sizes = np.array([len(t) for t in tokens])
    flat = mix64(np.concatenate(tokens))
    flat[np.cumsum(sizes) - 1] = END
    # The start mark is a key of its own, whether or not it is a token.
    keys, _, inverse = grouped(np.append(flat, START))
    return pa.table({
        "chunk": pa.array([number], pa.int32()), "ids": pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())),
        "held": pa.array([table["held_out"].to_pylist()], pa.list_(pa.bool_())),
        "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "words": pa.array([squeezed(fixed_bytes(np.diff(keys, prepend=np.uint64(0)), 8))], pa.binary()),
        "tokens": pa.array([squeezed(fixed_bytes(inverse[:-1].astype(np.uint64), 4))], pa.binary())})


class Chunk:
    """The distinct n-grams of a chunk by order, and which token has which."""

    def __init__(self, row: dict, order: int):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.begin = starts(row["sizes"])[:-1]
        words = np.cumsum(from_fixed_bytes(unsqueezed(row["words"]), 8), dtype=np.uint64)
        event = from_fixed_bytes(unsqueezed(row["tokens"]), 4).astype(np.int64)
        flat = words[event]
        n = len(flat)
        place = np.arange(n) - np.repeat(self.begin, self.sizes)
        train = np.repeat(~self.held, self.sizes)
        start = int(np.searchsorted(words, START))
        self.keys, self.event, self.counts = [words], [event], [np.bincount(event[train], minlength=len(words))]
        self.counts[0][start] += (~self.held).sum()
        self.wanted: list[np.ndarray] = []  # whether an n-gram of the order below is a history in held-out text
        self.history: list[np.ndarray] = [np.empty(0, np.int64)]
        self.suffix: list[np.ndarray] = [np.empty(0, np.int64)]
        for level in range(2, order + 1):
            at = np.flatnonzero(place >= level - 2)
            before = np.empty(len(at), np.int64)
            first = place[at] == 0
            before[first] = start
            before[~first] = self.event[-1][at[~first] - 1]
            short = self.keys[-1]
            with np.errstate(over="ignore"):
                code = mix64((mix64(short) * np.uint64(0x9E3779B97F4A7C15))[before] + flat[at])
            keys, where, inverse = grouped(code)
            event = np.full(n, -1, np.int64)
            event[at] = inverse
            self.history.append(before[where])
            self.suffix.append(self.event[-1][at[where]])
            self.counts.append(np.bincount(inverse[train[at]], minlength=len(keys)))
            wanted = np.zeros(len(short), bool)
            wanted[before[~train[at]]] = True
            self.wanted.append(wanted)
            self.keys.append(keys)
            self.event.append(event)
        self.wanted.append(np.zeros(len(self.keys[-1]), bool))

    def rows(self, table: pa.Table, kind: str, level: int) -> list[bytes]:
        """What the buckets said about the keys of a level, in the order of the keys."""
        rows = table.filter(pc.and_(pc.equal(table["level"], level), pc.equal(table["kind"], kind)))
        return rows.sort_by("bucket")["data"].to_pylist()

    def said(self, table: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of the n-grams of an order, whether this chunk owns them, whether held-out text has them as history."""
        rows = self.rows(table, "count", level)
        count, flags = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.uint8)),
                                                       *map(read_counts, rows), strict=True))
        return count, (flags & OWNER) > 0, (flags & WANTED) > 0


class Model:
    """Discounts of every order and the size of the training text."""

    def __init__(self, stats: dict[int, list[int]]):
        self.discount = []
        for level in sorted(stats):
            self.discount.append(discounts(stats[level][:CUT + 1]))
        self.tokens, self.types = stats[1][CUT + 1], stats[1][CUT + 2]
        small = sum(r * stats[1][r - 1] for r in range(1, CUT + 1))
        kept = sum(r * stats[1][r - 1] * self.discount[0][r] for r in range(1, CUT + 1)) + self.tokens - small
        # Without any small count nothing would be left for the unknown token; half a count is.
        self.whole = self.tokens + (0.0 if small else 0.5)
        self.unknown = 1.0 - kept / self.whole if self.tokens else 1.0

    def reduced(self, level: int, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return count * self.discount[level - 1][np.minimum(count, CUT + 1)]

    def asked(self, level: int, count: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Histories of ``level`` - 1 tokens whose weight is needed, by their counts.

        After others only tokens are seen in training text, and with counts that are discounted, so their shorter
        histories give some mass to tokens not seen after them.  If that is too little to be sure, all are asked for.
        """
        spare = 1 - max(d[1:CUT + 1].max() for d in self.discount[:level])
        if self.unknown < SURE or spare < SURE * self.tokens:
            return np.ones(len(count), bool)
        return (count > 0) & (wanted | (count > CUT))

    def unigrams(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.reduced(1, count) / self.whole, self.unknown)


def discounts(n: list[int]) -> np.ndarray:
    """Factor by count from 0 to ``CUT`` + 1, the last for all larger, from counts of counts."""
    out = np.ones(CUT + 2)
    spare = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    shared = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
    for r in range(1, CUT + 1):
        good = 0.0
        if n[r - 1] and n[r] and shared < 1:
            good = ((r + 1) * n[r] / (n[r - 1] * r) - shared) / (1 - shared)
        out[r] = good if 0 < good < 1 else (r - spare) / r
    return out


def _rows(table: pa.Table, kind: str, level: int) -> pa.Table:
    n = table.num_rows
    cols = {"kind": pa.array([kind] * n, pa.string()), "level": pa.array(np.full(n, level), pa.int32()),
            "bucket": table["bucket"], "chunk": table["chunk"]}
    for name in ("keys", "data"):
        cols[name] = table[name] if name in table.column_names else pa.nulls(n, pa.binary())
    cols["stats"] = pa.nulls(n, pa.list_(pa.int64()))
    return pa.table(cols)


def _ask(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Keys(buckets).packed
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row, order)
                for level in range(1, order + 1):
                    keys, counts = chunk.keys[level - 1], chunk.counts[level - 1]
                    flags = chunk.wanted[level - 1] * WANTED
                    yield from _rows(pack_rows(row["chunk"], keys, buckets, {
                        "keys": lambda s, k=keys: pack(k[s]),
                        "data": lambda s, c=counts, f=flags: packed_counts(c[s], f[s])}), "ask", level).to_batches()

    return run


def _count(buckets: int):
    """Adds up the counts of one bucket; answers carry them, with a bit for the owner and one for histories in held-out text."""

    def run(table: pa.Table) -> pa.Table:
        pack = Keys(buckets)
        level, bucket = table["level"][0].as_py(), table["bucket"][0].as_py()
        table = table.sort_by("chunk")
        keys = [pack.read(k) for k in table["keys"].to_pylist()]
        at = starts([len(k) for k in keys])
        flat = np.concatenate(keys)
        n, flags = (np.concatenate(x) for x in zip(*map(read_counts, table["data"].to_pylist()), strict=True))
        order = np.argsort(flat, kind="stable")  # of keys that are equal, the first chunk's is the first
        ordered = flat[order]
        new = np.ones(len(flat), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        first, which = np.flatnonzero(new), np.cumsum(new) - 1
        counted = np.add.reduceat(n[order], first)
        wanted = np.bitwise_or.reduceat(flags[order] & WANTED, first)
        total, answer = np.empty_like(n), np.empty_like(flags)
        total[order], answer[order] = counted[which], wanted[which] | new * OWNER
        if level == 1 and int(START) >> (64 - (buckets.bit_length() - 1)) == bucket:
            counted[ordered[first] == pack.below(START)] = 0
        stats = [int((counted == r).sum()) for r in range(1, CUT + 2)]
        stats += [int(counted.sum(dtype=np.int64)), int((counted > 0).sum())]
        said = pa.table({"bucket": table["bucket"], "chunk": table["chunk"],
                         "data": pa.array([packed_counts(total[a:b], answer[a:b])
                                           for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})
        model = pa.table({
            "kind": ["model"], "level": pa.array([level], pa.int32()), "bucket": pa.array([bucket], pa.int32()),
            "chunk": pa.array([-1], pa.int32()), "keys": pa.nulls(1, pa.binary()), "data": pa.nulls(1, pa.binary()),
            "stats": pa.array([stats], pa.list_(pa.int64()))})
        return pa.concat_tables([model, _rows(said, "count", level)])

    return run


def _probabilities(chunk: Chunk, answers: pa.Table, model: Model, top: int):
    """Counts of every order up to ``top``, the n-grams ``asked`` as histories, and probabilities, shortest first."""
    counts, asked, prob = [], [], []
    for level in range(1, top + 1):
        count, _, wanted = chunk.said(answers, level)
        counts.append(count)
        asked.append(model.asked(level + 1, count, wanted))
        if level == 1:
            prob.append(model.unigrams(counts[0]))
            continue
        weight = np.ones(len(counts[-2]))
        weight[asked[-2]] = np.frombuffer(b"".join(map(unsqueezed, chunk.rows(answers, "weight", level - 1))))
        h = chunk.history[level - 1]
        total, c, w = counts[-2][h], counts[-1], weight[h]
        # A negative weight marks a history that discounting leaves as it is.
        plain = np.signbit(w)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.where(plain, c / (total + np.where(w < 0, 0.5, 0.0)), model.reduced(level, c) / total)
        back = np.where(total > 0, np.abs(w), 1.0) * prob[-1][chunk.suffix[level - 1]]
        prob.append(np.where(c > 0, seen, back))
    return counts, asked, prob


SUMS = "bucket int, chunk int, keys binary, data binary, shorter binary"


def _sums(level: int, model: Model, buckets: int):
    """By history of ``level`` - 1 tokens: how many n-grams with each small count, sum of large counts and shorter mass
    of what follows it."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (
                ("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("data", pa.binary()),
                ("shorter", pa.binary()))})
        row = table.to_pylist()[0]
        chunk = Chunk(row, level)
        # Counts of this level, but no probabilities: its weights are what is asked for.
        _, asked, prob = _probabilities(chunk, answers, model, level - 1)
        c, mine, _ = chunk.said(answers, level)
        place = np.cumsum(asked[-1]) - 1
        use = mine & (c > 0) & asked[-1][chunk.history[level - 1]]
        h, c = place[chunk.history[level - 1][use]], c[use]
        keys = chunk.keys[level - 2][asked[-1]]
        after = np.zeros((CUT + 1, len(keys)), np.int64)
        for r in range(1, CUT + 1):
            after[r - 1] = np.bincount(h[c == r], minlength=len(keys))
        np.add.at(after[CUT], h[c > CUT], c[c > CUT])
        shorter = np.bincount(h, prob[-1][chunk.suffix[level - 1][use]], len(keys))
        some, flags = after.any(axis=0), np.zeros(after.shape, np.uint8)
        flags[0] = chunk.wanted[level - 2][asked[-1]] * WANTED
        pack = Keys(buckets).packed
        return pack_rows(row["chunk"], keys, buckets, {
            "keys": lambda s: pack(keys[s]),
            "data": lambda s: packed_counts(after[:, s].ravel(), flags[:, s].ravel()),
            "shorter": lambda s: squeezed(shorter[s][some[s]].tobytes())})

    return run


def _weights(level: int, model: Model, buckets: int):
    """The backoff weight of every history of a bucket, for all chunks that know it.

    A chunk without it as history in held-out text backs nothing off after it and is told only the kind of weight.
    """

    def run(table: pa.Table) -> pa.Table:
        pack, discount = Keys(buckets), model.discount[level - 1]
        table = table.sort_by("chunk")
        keys = [pack.read(k) for k in table["keys"].to_pylist()]
        after, flags = (np.concatenate([x.reshape(CUT + 1, -1) for x in part], axis=1)
                        for part in zip(*map(read_counts, table["data"].to_pylist()), strict=True))
        mass = np.zeros(after.shape[1])
        mass[after.any(axis=0)] = np.frombuffer(b"".join(map(unsqueezed, table["shorter"].to_pylist())))
        at = starts([len(k) for k in keys])
        uniq, _, inverse = grouped(np.concatenate(keys))
        shorter, *after = (np.bincount(inverse, x, len(uniq)) for x in (mass, *after))
        total = sum(r * n for r, n in enumerate(after[:CUT], 1)) + after[CUT]
        kept = sum(discount[r] * r * n for r, n in enumerate(after[:CUT], 1)) + after[CUT]
        rest = 1 - shorter
        with np.errstate(divide="ignore", invalid="ignore"):
            left = 1 - kept / total
            half = -(0.5 / (total + 0.5)) / rest
            weight = left / rest
        weight = np.where(left < 1e-12, half, weight)  # nothing discounted: half a count is given up
        weight = np.where(rest < 1e-12, -0.0, weight)  # everything was seen: nothing to give
        weight = np.where(total > 0, weight, 1.0)[inverse]
        weight = np.where((flags[0] & WANTED > 0) | (weight == 0), weight, np.copysign(1.0, weight))
        return _rows(pa.table({
            "bucket": table["bucket"], "chunk": table["chunk"],
            "data": pa.array([squeezed(weight[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())}),
            "weight", level - 1)

    return run


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _evaluate(order: int, model: Model):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (
                ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        chunk = Chunk(table.to_pylist()[0], order)
        counts, _, prob = _probabilities(chunk, answers, model, order)
        logs = np.log10(prob[0])[chunk.event[0]]
        for level in range(2, order + 1):
            event = chunk.event[level - 1]
            use = event >= 0
            logs[use] = np.log10(prob[level - 1])[event[use]]
        c = counts[0][chunk.event[0]]
        base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
        add = np.add.reduceat
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64()), "held_out": pa.array(chunk.held, pa.bool_()),
            "n_tokens": pa.array(chunk.sizes, pa.int64()),
            "n_known": pa.array(add((c > 0).astype(np.int64), chunk.begin), pa.int64()),
            "train_tokens": pa.array(np.full(len(chunk.ids), model.tokens), pa.int64()),
            "base_score": pa.array(add(base, chunk.begin)), "score": pa.array(add(logs, chunk.begin))})

    return run


def score(docs: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """Scores of all documents by a model of those that are not ``held_out``."""
    rows = id_text(docs).withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    size = text_bytes(rows)
    buckets = bucket_count(size // 5, BUCKET_TOKENS, LEAST_BUCKETS)
    chunks = stage(with_chunk(rows, chunk_count(size)).groupBy("chunk").applyInArrow(_tokens, TOKENS), "tokens")
    asked = chunks.mapInArrow(_ask(order, buckets), ROWS)
    tables = stage(asked.groupBy("level", "bucket").applyInArrow(_count(buckets), ROWS), "counts", ("kind", "level"))
    of_model = tables.where(F.col("kind") == "model").groupBy("level").agg(
        *(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(CUT + 3)))
    stats = {level: [0] * (CUT + 3) for level in range(1, order + 1)}
    for r in of_model.collect():  # one row per order
        stats[r["level"]] = [r[f"s{i}"] for i in range(CUT + 3)]
    model = Model(stats)
    wanted = ("chunk", "kind", "level", "bucket", "data")
    answers = tables.where(F.col("kind") == "count").select(*wanted)
    for level in range(2, order + 1):
        known = answers.where(F.col("level") <= level)
        sums = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_sums(level, model, buckets), SUMS)
        weights = stage(sums.groupBy("bucket").applyInArrow(_weights(level, model, buckets), ROWS).select(*wanted),
                        "weights")
        answers = answers.union(weights)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_evaluate(order, model), SCORES)
