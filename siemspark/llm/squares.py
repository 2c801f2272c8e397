"""Periodic runs of words, found online by catchers over completed power-of-two blocks.

Words are appended one by one.  Whenever the words at a multiple of ``b = 2^k`` have grown to a block of ``b`` words, a
catcher of level k holds the block's fingerprint.  At every appended word each level compares the last ``b`` words
with the one aligned block that lies ``p`` words before them, ``b <= p < 2b``.  Where they agree, suffix comparisons
find how far the agreement reaches to the left: that is where a stretch of period p, if it goes on, begins.  It is looked at again
when it would be long enough (24 words and three periods, parameters): if the squares in between hold, the stretch becomes an
open run, grows word by word and is reported when a word breaks its period.

* A run of period p and three periods has, in its first 2b - 1 words, an aligned block of ``b <= p`` words, so its catcher
  agrees before the run is long enough.
* While a run of period q is open, blocks of at least q words inside it can only agree at multiples of q, which are the same run; they are
  skipped.  So an appended word costs one comparison a level, and a text of n words O(n log n).
* Fingerprints have 61 bits.  What they report is compared word by word afterwards; if that fails, the text is read again
  with another base.

Only stretches that can hold a run are read that way: each word of a run lies in a 16-word window that occurs twice in the text (both
lengths follow from the parameters), and a stretch between other words holds its runs whole.

Defined results: null and empty texts have no words, no runs and an empty collapsed text.  A null ``doc_id`` is carried along and its
text is taken as it is.  Repeated rows give equal rows.  Ties between runs go to the smaller start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siemspark.llm.common import chunks, id_text, mix64, word_hashes

PRIME = (1 << 61) - 1
BASES = (0x1F3D5B79A2C4E681, 0x0A5C3E17F9B28D43, 0x16E4C2A08B7D9F35)
CHUNK = 2_000_000
RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


class SquareCatcher:
    """Maximal runs of a growing sequence of integers.

    A run is a stretch with smallest period q and at least ``max(least, times * q)`` items, ``times`` at least 3.
    """

    def __init__(self, least: int = 24, times: int = 3, base: int = BASES[0]):
        if times < 3 or least < 1:
            raise ValueError("runs need three periods and a positive length")
        self.least, self.times, self.base = least, times, base
        self.items: list[int] = []
        self.prefix, self.power = array("Q", [0]), array("Q", [1])
        # For each level, fingerprints of its blocks in order.
        self.caught: list[list[int]] = []
        self.open: dict[int, int] = {}  # period -> start
        self.due: dict[int, list[tuple[int, int]]] = {}  # position -> (period, start)
        self.waiting: set[tuple[int, int]] = set()
        self.runs: list[tuple[int, int, int]] = []

    def _print(self, a: int, b: int) -> int:
        return (self.prefix[b] - self.prefix[a] * self.power[b - a]) % PRIME

    def _back(self, a: int, b: int) -> int:
        """How many items before ``a`` equal those before ``b``, a < b."""
        items, n = self.items, 0
        while n < 8:
            if n == a:
                return n
            if items[a - 1 - n] != items[b - 1 - n]:
                return n
            n += 1
        # Double, then halve the step.
        step = 8
        while n + step <= a and self._print(a - n - step, a - n) == self._print(b - n - step, b - n):
            n += step
            step *= 2
        while step:
            if n + step <= a and self._print(a - n - step, a - n) == self._print(b - n - step, b - n):
                n += step
            step //= 2
        return n

    def append(self, item: int) -> None:
        items, prefix, power = self.items, self.prefix, self.power
        j = len(items)
        items.append(item)
        prefix.append((prefix[j] * self.base + item + 1) % PRIME)
        power.append(power[j] * self.base % PRIME)
        if self.open:
            for p in [p for p in self.open if items[j - p] != item]:
                self._close(p, j)
        n, k, b, head = j + 1, 0, 1, prefix[j + 1]
        open_runs = self.open
        while b <= n:
            if k == len(self.caught):
                self.caught.append([])
            blocks = self.caught[k]
            # Every level is completed at its multiples only.
            print_of_last = (head - prefix[n - b] * power[b]) % PRIME
            if n % b == 0:
                blocks.append(print_of_last)
            at = n - 2 * b
            if at >= 0 and blocks[at >> k] == print_of_last:
                self._agree((at >> k) << k, n - b, b, j)
            k += 1
            b *= 2
        if j in self.due:
            for p, start in sorted(self.due.pop(j)):
                self.waiting.discard((p, start))
                if p not in open_runs and self._print(start, j + 1 - p) == self._print(start + p, j + 1) and not any(
                        q < p and p % q == 0 and s <= start for q, s in open_runs.items()):
                    open_runs[p] = start

    def _agree(self, s: int, t: int, b: int, j: int) -> None:
        """The block at ``s`` is also the last ``b`` items, from ``t`` to ``j``."""
        p = t - s
        for q, start in self.open.items():
            if start <= s and (q <= b or q == p):
                return
        start = s - self._back(s, t)
        when = start + max(self.least, self.times * p) - 1
        # A run's first block agrees before it is long enough; later, the stretch has been judged already.
        if when >= j and (p, start) not in self.waiting:
            self.waiting.add((p, start))
            self.due.setdefault(when, []).append((p, start))

    def _close(self, p: int, end: int) -> None:
        self.runs.append((self.open.pop(p), end, p))

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start and period."""
        for p in list(self.open):
            self._close(p, len(self.items))
        return sorted((a, b - a, p) for a, b, p in self.runs)


def holds(items: Sequence[int], start: int, length: int, period: int) -> bool:
    """Whether a stretch has the period and no neighbour goes on with it."""
    end = start + length
    return (items[start:end - period] == items[start + period:end]
            and (start == 0 or items[start - 1] != items[start - 1 + period])
            and (end == len(items) or items[end] != items[end - period]))


def online_runs(items: Sequence[int], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, appended item by item."""
    for base in BASES:
        catcher = SquareCatcher(least, times, base)
        for item in items:
            catcher.append(item)
        runs = catcher.finish()
        if all(holds(catcher.items, *r) for r in runs):
            return runs
    raise ValueError("fingerprints of every base collide")


def repeated_stretches(hashes: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int]]:
    """(begin, end) of stretches outside of which no word is in a run."""
    # A run is at least that much longer than its period, and its windows of that width occur twice.
    width = min(max(least, times * q) - q for q in range(1, least + 1))
    n = len(hashes) - width + 1
    if len(hashes) < least or n < 2:
        return []
    # Fingerprints of windows, by doubling.
    have, covered, out = hashes, 1, None
    left, done = width, 0
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = have[done:done + n]
                out = part if out is None else mix64(out) + part
                done += covered
            left >>= 1
            if left:
                have = mix64(have[:len(have) - covered]) + have[covered:]
                covered *= 2
    ordered = np.sort(out)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(out, twice))
    breaks = np.flatnonzero(np.diff(at) > width)
    begins = at[np.concatenate([[0], breaks + 1])]
    ends = at[np.concatenate([breaks, [len(at) - 1]])] + width
    return [(a, b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b - a >= least]


def text_runs(parts: list[bytes], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start and period."""
    if len(parts) < least:
        return []
    runs = []
    for begin, end in repeated_stretches(word_hashes(parts), least, times):
        number: dict[bytes, int] = {}
        items = [number.setdefault(w, len(number)) for w in parts[begin:end]]
        runs += [(begin + a, n, p) for a, n, p in online_runs(items, least, times)]
    return runs


def with_planted_tail(doc_id: int | None, parts: list[bytes]) -> list[bytes]:
    """The words of a document, whose tail is made periodic for a tenth of the ids."""
    if doc_id is None or not parts:
        return parts
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return parts
    g, n = h // 10, len(parts)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return parts[:a] + (parts[a:a + p] * (-(-(n - a) // p)))[:n - a]


def collapsed(parts: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined, without those that follow the first period of a run."""
    if not runs:
        return b" ".join(parts)
    change = np.zeros(len(parts) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([parts[i] for i in keep.tolist()])


def _row(doc_id, text: str | None, least: int, times: int) -> tuple:
    parts = with_planted_tail(doc_id, text.encode().split() if text else [])
    runs = text_runs(parts, least, times)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listing = "".join([f"{a},{n},{p}\n" for a, n, p in runs])
    return (doc_id, len(runs), *top, hashlib.sha256(listing.encode()).hexdigest(),
            hashlib.sha256(collapsed(parts, runs)).hexdigest())


def document_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Runs of every document's words: their number, the one of greatest exponent, digests of list and collapsed text."""
    types = [*[pa.int64()] * 6, pa.string(), pa.string()]
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for ids, texts in chunks(batches, CHUNK, lambda t: len(t or "")):
            rows = [_row(key, text, least, times) for key, text in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return id_text(docs).mapInArrow(run, RESULT)
