"""Operator 6: repeated passages by collinear chaining.

1. Every text gives seeds: runs of ``SEED`` words that are the least-hashed of
   some ``WINDOW`` consecutive runs, so two texts that share
   SEED + WINDOW - 1 words in a row share a seed.
2. A seed that occurs in several documents joins each occurrence to at most
   three places: the first in the least document, the first with the same
   ``CONTEXT`` words before it and the first with the same words after it. Where
   the least document's copy ends inside a longer passage, a seed next to that
   end leads on to a document that goes on; where a seed within that context
   leads there anyway, it isn't joined. Pairs grow with occurrences, not squares.
3. The matches of a document with an earlier one are chained in order, with a
   cost for gaps; a Fenwick tree holds the best chain up to each place, so a
   group of n matches takes n log n steps.
4. Chains are aligned word by word: gaps are filled by an alignment of their
   words, and a chain that agrees too little is split at its worst gaps. Ends
   are extended, with insertions and deletions, while they agree. What agrees
   well enough counts as covered, and stretches of at least ``MIN_WORDS`` words
   that one earlier document covers are repeated passages; short pieces that
   different documents have don't add up to one. The earliest document keeps
   its passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import row_groups, shingles, text_buffer, word_spans, words
from .narrow import marked
from .scratch import Scratch

SEED, WINDOW, MIN_WORDS = 6, 6, 50
CONTEXT = 6  # words beside a seed; no fewer than WINDOW, so that some seed's context crosses any border in an exact copy
GAP_COST = 0.1  # per word, on either side; a match is worth its words
MIN_CHAIN = 16  # words of a chain that may be part of a passage
AGREE = 0.8  # share of a chain's words that must agree
DROP = 12  # an extension ends once its score is that far below its best
WEIGHT = AGREE / (1 - AGREE)  # words that agree for one that doesn't
ROUNDS = 12  # edits that are tried for all ends of a batch together
REACH = 64  # words of the earlier document kept beyond a chain's ends, and CONTEXT more, as a seed beside its first or last may not be joined
STEP = 3  # bits of a distance of at most WINDOW
BLOCK = 256  # chains cut out of one copy of a document's text
ALIGNED = 1 << 20  # bytes of text aligned at once


def minimizers(values: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least value of each ``window`` consecutive values (the first of equals)."""
    if len(values) <= window:
        return np.array([int(values.argmin())]) if len(values) else np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(values, window).argmin(axis=1) + np.arange(len(values) - window + 1)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _runs(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text with seeds: row, hashes of its words, hashes of its runs and the places of its seeds."""
    hashes, _, _, first = words(*text_buffer(rows.column("text")))
    runs = shingles(hashes, SEED) if len(hashes) >= SEED else hashes[:0]
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a >= SEED:
            yield i, hashes[a:b], runs[a : b - SEED + 1], minimizers(runs[a : b - SEED + 1], WINDOW)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of each text, once a text."""
    for batch in batches:
        for rows in row_groups(batch, "text"):
            value = [np.unique(runs[at]) for _, _, runs, at in _runs(rows)]
            if value:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(value).view(np.int64))], names=["value"])


def beside(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of up to ``CONTEXT`` words before and after the seeds at ``at``."""
    padded = np.concatenate([np.zeros(CONTEXT, np.uint64), hashes, np.zeros(CONTEXT, np.uint64)])
    runs = shingles(padded, CONTEXT)
    return runs[at], runs[at + CONTEXT + SEED]


def places(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the seeds at ``at``, each with its distances to the least of the ``WINDOW`` runs before and of those after it (0: fewer runs) in its low bits.

    These are seeds themselves, in all texts with the same seed and the same context on that side, as the whole window lies within.
    """
    back, ahead = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    if len(runs) > WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(runs, WINDOW).argmin(axis=1)
        before, after = at >= WINDOW, at + WINDOW < len(runs)
        back[before] = WINDOW - least[at[before] - WINDOW]
        ahead[after] = 1 + least[at[after] + 1]
    return (at << 2 * STEP) | (back << STEP) | ahead


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in row_groups(batch, "text"):
            value, row, place, left, right = [], [], [], [], []
            for i, hashes, runs, at in _runs(rows):
                value.append(runs[at])
                row.append(np.full(len(at), i))
                place.append(places(runs, at))
                before, after = beside(hashes, at)
                left.append(before)
                right.append(after)
            if value:
                take = pa.array(np.concatenate(row))
                sides = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
                columns = [pa.array(np.concatenate(value).view(np.int64)), rows.column("doc_id").take(take), rows.column("h").take(take), pa.array(np.concatenate(place)), *sides]
                yield pa.RecordBatch.from_arrays(columns, names=["value", "doc_id", "h", "place", "left", "right"])


class Fenwick:
    """Greatest (score, item) over a prefix of places."""

    def __init__(self, n: int):
        self.score, self.item = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def add(self, place: int, score: float, item: int) -> None:
        i = place + 1
        while i < len(self.score):
            if score > self.score[i]:
                self.score[i], self.item[i] = score, item
            i += i & -i

    def best(self, before: int) -> tuple[float, int]:
        """Over places less than ``before``."""
        score, item, i = float("-inf"), -1, before
        while i > 0:
            if self.score[i] > score:
                score, item = self.score[i], self.item[i]
            i -= i & -i
        return score, item


def chains(x: np.ndarray, y: np.ndarray, size: int = SEED, cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of matches (x[i], y[i]), each ``size`` words: lists of (x, y, length), best first; no match is in two.

    Matches on one diagonal whose words touch or overlap are one piece first.
    """
    order = np.lexsort((y, x - y))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = ((x - y)[1:] != (x - y)[:-1]) | (x[1:] > x[:-1] + size)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(x)) - 1
    pieces = sorted(zip(x[starts].tolist(), y[starts].tolist(), (x[ends] - x[starts] + size).tolist()))
    ranks = np.unique(np.array([p[1] + p[2] for p in pieces]))
    n = len(pieces)
    score, back = [0.0] * n, [-1] * n
    tree, waiting = Fenwick(len(ranks)), sorted(range(n), key=lambda i: pieces[i][0] + pieces[i][2])
    done = 0
    for i, (px, py, length) in enumerate(pieces):
        while done < n and pieces[waiting[done]][0] + pieces[waiting[done]][2] < px + size:  # ends may overlap by less than a seed
            j = waiting[done]
            if j < i:
                jx, jy, jl = pieces[j]
                tree.add(int(np.searchsorted(ranks, jy + jl)), score[j] + cost * (jx + jl + jy + jl), j)
                done += 1
            else:
                break
        best, j = tree.best(int(np.searchsorted(ranks, py + size, "left")))
        gain = best - cost * (px + py)
        score[i] = length
        if j >= 0 and gain > 0:
            score[i], back[i] = length + gain, j
    used, found = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(pieces[j])
            j = back[j]
        if chain:
            found.append(chain[::-1])
    return found


CHAINS = "doc_id long, h long, part_no int, t_doc long, t_h long, low int, high int, x array<array<int>>, y array<array<int>>, size array<array<int>>"


def _held(part: list[list[tuple[int, int, int]]]) -> list[list]:
    """low, high, chains: those whose words of the earlier document overlap share them."""
    held: list[list] = []
    for chain in sorted(part, key=lambda c: c[0][1]):
        low, high = max(0, chain[0][1] - REACH - CONTEXT), chain[-1][1] + chain[-1][2] + REACH + CONTEXT
        if held and low < held[-1][1]:
            held[-1][1] = max(held[-1][1], high)
            held[-1][2].append(chain)
        else:
            held.append([low, high, [chain]])
    return held


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of each pair of documents. Pairs whose matches are one piece, most of them, are handled as arrays."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()] + [pa.list_(pa.list_(pa.int32()))] * 3
    names = ["doc_id", "h", "part_no", "t_doc", "t_h", "low", "high", "x", "y", "size"]
    for batch in batches:
        doc_id, h, matches = (batch.column(c) for c in ("doc_id", "h", "matches"))
        doc_id, h, got = doc_id.to_numpy(), h.to_numpy(), matches.flatten()
        row = np.repeat(np.arange(len(doc_id)), matches.value_lengths().to_numpy())
        if not len(row):
            continue
        t_doc, t_h, x, y = (got.field(c).to_numpy().astype(np.int64) for c in ("t_doc", "t_h", "x", "y"))
        order = np.lexsort((y, x, t_h, t_doc, row))
        row, t_doc, t_h, x, y = (c[order] for c in (row, t_doc, t_h, x, y))
        begin = np.ones(len(x), bool)  # of a pair
        begin[1:] = (row[1:] != row[:-1]) | (t_doc[1:] != t_doc[:-1]) | (t_h[1:] != t_h[:-1])
        breaks = begin.copy()  # of a piece
        breaks[1:] |= ((x - y)[1:] != (x - y)[:-1]) | (x[1:] > x[:-1] + SEED)
        cut = np.flatnonzero(begin)
        last = np.append(cut[1:], len(x)) - 1
        single = np.add.reduceat(breaks, cut, dtype=np.int64) == 1
        number = np.arange(len(cut)) - np.searchsorted(row[cut], row[cut])  # of a pair, within its document
        a, z = cut[single], last[single]
        if len(a):
            inner = pa.array(np.arange(len(a) + 1, dtype=np.int32))
            nested = [pa.ListArray.from_arrays(inner, pa.ListArray.from_arrays(inner, pa.array(c.astype(np.int32)))) for c in (x[a], y[a], x[z] - x[a] + SEED)]
            flat = [doc_id[row[a]], h[row[a]], number[single], t_doc[a], t_h[a], np.maximum(0, y[a] - REACH - CONTEXT), y[z] + SEED + REACH + CONTEXT]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds)] + nested, names=names)
        out: list[tuple] = []
        pairs = np.bincount(row[cut], minlength=len(doc_id))  # a further part of a pair takes a number behind those of all pairs
        for a, z, k in zip(cut[~single].tolist(), last[~single].tolist(), number[~single].tolist()):
            r = int(row[a])
            fresh = np.ones(z + 1 - a, bool)
            fresh[1:] = (x[a + 1 : z + 1] != x[a:z]) | (y[a + 1 : z + 1] != y[a:z])
            for i, (low, high, group) in enumerate(_held(chains(x[a : z + 1][fresh], y[a : z + 1][fresh]))):
                if i:
                    k, pairs[r] = int(pairs[r]), pairs[r] + 1
                out.append((int(doc_id[r]), int(h[r]), k, int(t_doc[a]), int(t_h[a]), low, high, *([[piece[n] for piece in chain] for chain in group] for n in range(3))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the earlier document that chains may cover."""
    for batch in batches:
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
            raw = np.frombuffer(text.as_py().encode(), np.uint8)
            starts, ends = word_spans(raw, np.array([0, len(raw)]))
            data = raw.tobytes()
            rows = []
            for w in wanted:
                high = min(w["high"], len(starts))
                part = data[starts[w["low"]] : ends[high - 1]].decode() if high > w["low"] else ""
                rows.append((w["doc_id"], w["h"], w["part_no"], part))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "h", "part_no", "part"])


def agreeing(one: np.ndarray, two: np.ndarray) -> int:
    """Words that an alignment of two short runs matches (longest common subsequence)."""
    if not len(one) or not len(two):
        return 0
    row = np.zeros(len(two) + 1, np.int64)
    for w in one:
        hit = row[:-1] + (two == w)
        np.maximum(hit, row[1:], out=hit)
        row[1:] = np.maximum.accumulate(hit)
    return int(row[-1])


def extensions(one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """How far two runs agree from their beginning: (words of ``one``, those that agree), once by a lenient score and once by one that holds ``AGREE``.

    Furthest places by number of edits and diagonal: an edit costs 3 less the
    half words it takes, and a diagonal ends when it is ``DROP`` below the best.
    """
    a, b = one.tolist(), two.tolist()
    n, m = len(a), len(b)
    front, edits = {0: (0, 0)}, 0  # diagonal -> words of one, those that don't agree
    top, top_strict, lenient, strict = 0.0, 0.0, (0, 0), (0, 0)
    while front:
        now = []
        for d in sorted(front):
            i, lost = front[d]
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            score = i + d / 2 - 3 * edits
            now.append((d, i, lost, score))
            if score > top:
                top, lenient = score, (i, i - lost)
        front, edits = {}, edits + 1
        for d, i, lost, score in now:
            if score < top - DROP:
                continue
            held = i - lost - WEIGHT * lost
            if held > top_strict:
                top_strict, strict = held, (i, i - lost)
            for to, j, less in ((d, i + 1, lost + 1), (d - 1, i + 1, lost + 1), (d + 1, i, lost)):
                if j <= n and 0 <= j + to <= m and (to not in front or (j, -less) > (front[to][0], -front[to][1])):
                    front[to] = (j, less)
    return [lenient, strict]


def extend(one: np.ndarray, two: np.ndarray) -> int:
    """How far two runs agree from their beginning, with insertions and deletions."""
    return extensions(one, two)[0][0]


def extensions_of_all(own: np.ndarray, other: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, step: int) -> np.ndarray:
    """``extensions`` of many runs: row k is (lenient words, agreeing; strict words, agreeing).

    Run k has n[k] words of ``own`` from a[k] on and m[k] of ``other`` from
    b[k] on, both in direction ``step``. Most ends stop agreeing after a few
    edits: ``ROUNDS`` of them are made for all runs together, and only runs that
    still go on are taken one by one.
    """
    out = np.zeros((len(a), 4), np.int64)
    at = np.arange(len(a))  # runs that go on
    top, top_strict = np.zeros(len(a)), np.zeros(len(a))
    i, lost = np.zeros((len(a), 1), np.int64), np.zeros((len(a), 1), np.int64)  # a column a diagonal; -1: not there
    for edits in range(ROUNDS):
        d = np.arange(-edits, edits + 1)
        row, col = np.nonzero(i >= 0)
        place, diagonal, run = i[row, col], d[col], at[row]
        going = np.flatnonzero((place < n[run]) & (place + diagonal < m[run]))
        while len(going):
            r, p = run[going], place[going]
            going = going[own[a[r] + step * p] == other[b[r] + step * (p + diagonal[going])]]
            place[going] += 1
            going = going[(place[going] < n[run[going]]) & (place[going] + diagonal[going] < m[run[going]])]
        i[row, col] = place
        score = np.where(i >= 0, i + d / 2 - 3 * edits, -np.inf)
        held = np.where(i >= 0, i - lost - WEIGHT * lost, -np.inf)
        lines = np.arange(len(at))
        pick = score.argmax(axis=1)
        better = score[lines, pick] > top[at]
        top[at] = np.maximum(top[at], score[lines, pick])
        out[at[better], 0], out[at[better], 1] = i[lines, pick][better], (i - lost)[lines, pick][better]
        stay = score >= top[at][:, None] - DROP
        held[~stay] = -np.inf
        pick = held.argmax(axis=1)
        better = held[lines, pick] > top_strict[at]
        top_strict[at] = np.maximum(top_strict[at], held[lines, pick])
        out[at[better], 2], out[at[better], 3] = i[lines, pick][better], (i - lost)[lines, pick][better]

        best = np.full((len(at), 2 * edits + 3), -1, np.int64)  # furthest first, then the least lost, in one number
        to = np.arange(-edits - 1, edits + 2)
        for shift, own_word in ((1, 1), (0, 1), (2, 0)):  # another word, one more, one less
            j, less = i + own_word, lost + own_word
            into = to[shift : shift + 2 * edits + 1]
            fine = stay & (j <= n[at][:, None]) & (j + into >= 0) & (j + into <= m[at][:, None])
            part = best[:, shift : shift + 2 * edits + 1]
            np.maximum(part, np.where(fine, (j << 20) + (1 << 20) - 1 - less, -1), out=part)
        on = (best >= 0).any(axis=1)
        at, best = at[on], best[on]
        i = np.where(best >= 0, best >> 20, -1)
        lost = np.where(best >= 0, (1 << 20) - 1 - (best & ((1 << 20) - 1)), 0)
    for k in at.tolist():
        one = own[a[k] : a[k] + n[k]] if step > 0 else own[a[k] - n[k] + 1 : a[k] + 1][::-1]
        two = other[b[k] : b[k] + m[k]] if step > 0 else other[b[k] - m[k] + 1 : b[k] + 1][::-1]
        (out[k, 0], out[k, 1]), (out[k, 2], out[k, 3]) = extensions(one, two)
    return out


def stretches(own: np.ndarray, other: np.ndarray, low: int, xs: list[int], ys: list[int], sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """The parts of a chain that agree well enough once aligned: start and end in ``own``, start and end in ``other`` (words from ``low`` on), words that agree."""
    ys = [y - low for y in ys]
    gaps, twice = [(0, 0)], [0]  # before each piece: words of a gap, those that agree; words it shares with the piece before
    for i in range(1, len(xs)):
        a, b = xs[i - 1] + sizes[i - 1], ys[i - 1] + sizes[i - 1]
        short = 0 < xs[i] - a <= 2 * REACH and 0 < ys[i] - b <= 2 * REACH  # longer ones are left to extensions
        gaps.append((max(0, xs[i] - a), agreeing(own[a : xs[i]], other[b : ys[i]]) if short else 0))
        twice.append(max(0, a - xs[i], b - ys[i]))
    found, todo = [], [(0, len(xs))]
    while todo:
        i, j = todo.pop()
        start, end, y_end = xs[i], xs[j - 1] + sizes[j - 1], ys[j - 1] + sizes[j - 1]
        match = sizes[i] + sum(sizes[k] - twice[k] + gaps[k][1] for k in range(i + 1, j))
        if match < AGREE * (end - start):
            cut = max(range(i + 1, j), key=lambda k: gaps[k][0] - gaps[k][1] + twice[k])
            todo += [(i, cut), (cut, j)]
        else:
            found.append((start, end, ys[i], y_end, match))
    return found


def extended(own: np.ndarray, other: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches once both ends are extended.

    Rows: where the text begins and ends in ``own``, where the part begins and
    ends in ``other``, and the five numbers of ``stretches``.
    """
    text, text_end, part, part_end, start, end, y, y_end, match = rows.T
    n, m = np.minimum(start, 2 * REACH), y
    left = extensions_of_all(own, other, text + start - 1, n, part + y - 1, m, -1)
    n, m = np.minimum(text_end - text - end, 2 * REACH), part_end - part - y_end
    right = extensions_of_all(own, other, text + end, n, part + y_end, m, 1)
    whole = match + left[:, 1] + right[:, 1] >= AGREE * (end - start + left[:, 0] + right[:, 0])
    return start - np.where(whole, left[:, 0], left[:, 2]), end + np.where(whole, right[:, 0], right[:, 2])


def merge(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Union of spans; unions of at least ``least`` words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


SPANS = "doc_id long, h long, n_words long, spans array<struct<start:int,end:int>>, kept_text string"


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_groups(batch, "text", ALIGNED):
                yield from _aligned(rows, least)

    return run


def _aligned(rows: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    raw, bounds = text_buffer(rows.column("text"))
    own, starts, _, first = words(raw, bounds)
    found = rows.column("chains")
    part = found.flatten()
    other, _, _, part_first = words(*text_buffer(part.field("part")))
    row_of_part = np.repeat(np.arange(rows.num_rows), found.value_lengths().to_numpy())
    x, y, size = (part.field(c).flatten() for c in ("x", "y", "size"))  # a list of pieces a chain
    part_of = np.repeat(np.arange(len(part)), part.field("x").value_lengths().to_numpy())
    row_of, low, pieces = row_of_part[part_of], part.field("low").to_numpy()[part_of], x.value_lengths().to_numpy()
    x, y, size = (c.flatten().to_numpy().astype(np.int64) for c in (x, y, size))
    begins = np.cumsum(pieces) - pieces
    where = np.stack([first[row_of], first[row_of + 1], part_first[part_of], part_first[part_of + 1]], axis=1)
    one = np.flatnonzero(pieces == 1)  # nothing to align between pieces
    xs, ys, sizes = x[begins[one]], y[begins[one]] - low[one], size[begins[one]]
    todo, whose = [np.column_stack([where[one], xs, xs + sizes, ys, ys + sizes, sizes])], [one]
    for k in np.flatnonzero(pieces > 1).tolist():
        (a, b, p, q), these = where[k].tolist(), slice(begins[k], begins[k] + pieces[k])
        kept = stretches(own[a:b], other[p:q], int(low[k]), x[these].tolist(), y[these].tolist(), size[these].tolist())
        todo.append(np.column_stack([np.tile(where[k], (len(kept), 1)), np.array(kept, np.int64)]))
        whose.append(np.full(len(kept), k))
    chain = np.concatenate(whose)
    start, end = extended(own, other, np.concatenate(todo))
    long = np.flatnonzero(end - start >= MIN_CHAIN)
    t_doc, t_h = part.field("t_doc").to_numpy(), part.field("t_h").to_numpy()
    by_document: dict[tuple, list] = {}
    for k, i, a, b in zip(row_of[chain[long]].tolist(), part_of[chain[long]].tolist(), start[long].tolist(), end[long].tolist()):
        by_document.setdefault((k, int(t_doc[i]), int(t_h[i])), []).append((a, b))
    passages: dict[int, list] = {}
    for (k, _, _), found in by_document.items():
        passages.setdefault(k, []).extend(merge(found, least))
    out = []
    for k in sorted(passages):
        spans = merge(passages[k], least)
        if spans:
            data, kept, at = raw[bounds[k] : bounds[k + 1]].tobytes(), [], 0
            word = starts[first[k] : first[k + 1]] - bounds[k]
            for a, b in spans:
                kept.append(data[at : word[a]])
                at = int(word[b]) if b < len(word) else len(data)
            kept.append(data[at:])
            out.append((rows.column("doc_id")[k].as_py(), rows.column("h")[k].as_py(), len(word), [{"start": a, "end": b} for a, b in spans], b"".join(kept).decode()))
    if out:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "h", "n_words", "spans", "kept_text"])


NO_ID = 2**63 - 1


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("text is not null")


def _key():
    return F.xxhash64("doc_id", "h")


def _word(place: str) -> Column:
    return F.shiftright(place, 2 * STEP).cast("int")


def _others(shared: DataFrame, first: DataFrame, side: str, least: Column, place: list[Column]) -> DataFrame:
    """Of each seed and context that several texts have: the least place, unless it is the seed's first of all, and the place of a seed within that context (or itself)."""
    step = F.shiftright("t.place", STEP if side == "left" else 0).bitwiseAND(F.lit((1 << STEP) - 1)).cast("int")
    within = (_word("t.place") - step if side == "left" else _word("t.place") + step).alias("within")
    found = shared.groupBy("value", side).agg(least, F.min(_key()).alias("one"), F.max(_key()).alias("two")).where("one <> two")
    found = found.join(first.withColumnsRenamed({"t_doc": "f_doc", "t_h": "f_h", "y": "f_y"}), "value").select("value", side, *place, within, "f_doc", "f_h", "f_y")
    return found.where("t_doc <> f_doc or t_h <> f_h or y <> f_y").drop("f_doc", "f_h", "f_y")


def _not_led_to(others: DataFrame, first: DataFrame) -> DataFrame:
    """``others`` without those in whose context a seed has its first place of all.

    All texts with that seed and context have the other seed too, at the same
    distance, so each is joined to this document on the same diagonal already,
    at most ``CONTEXT`` words away, and the words between are equal. In a text that
    goes on repeating a few words these are nearly all occurrences.
    """
    at = lambda y: F.xxhash64("t_doc", "t_h", y)
    firsts = marked(first.select("t_doc", "t_h", F.col("y").alias("within")), at("within"), others, at("within"), "hit").where("hit").drop("hit")
    return others.join(firsts, ["t_doc", "t_h", "within"], "left_anti")


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents that repeat passages of earlier ones: doc_id, h (hash of the text), n_words, spans (word positions, half open), kept_text.

    Earlier means a lesser doc_id (null ids are greatest). Passages are runs of
    at least ``min_words`` words covered by aligned chains; within one document
    nothing is repeated. Null, empty and short texts repeat nothing; rows equal
    in doc_id and text are one document; other columns are ignored. ``kept_text``
    is the text without its spans and may be empty. Runs jobs at once.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "passages")
    plain = _keyed(documents)
    several = plain.mapInArrow(_values, "value long").groupBy("value").count().where("count > 1").select("value")
    several = scratch.table(several, "several")  # a table: Spark splits hot keys of joins between plain shuffles only
    seeds = plain.mapInArrow(_seeds, "value long, doc_id long, h long, place long, left long, right long")
    seeds = marked(seeds, F.col("value"), several, F.col("value"), "hit").where("hit").drop("hit")
    shared = scratch.table(seeds.join(several, "value", "left_semi"), "shared")
    least = F.min(F.struct("doc_id", "h", "place")).alias("t")
    place = [F.col("t.doc_id").alias("t_doc"), F.col("t.h").alias("t_h"), _word("t.place").alias("y")]
    first = scratch.table(shared.groupBy("value").agg(least).select("value", *place), "first")
    matches = shared.join(first, "value").where("doc_id <> t_doc or h <> t_h").select("doc_id", "h", "t_doc", "t_h", _word("place").alias("x"), "y")
    for side in ("left", "right"):
        key = F.xxhash64("value", side)
        others = scratch.table(_others(shared, first, side, least, place), f"further-{side}")
        others = scratch.table(_not_led_to(others, first).select("value", side, "t_doc", "t_h", "y"), f"others-{side}")
        further = marked(shared, key, others, key, "hit").where("hit").join(others, ["value", side]).where("doc_id <> t_doc or h <> t_h")
        matches = matches.union(further.withColumn("x", _word("place")).select(*matches.columns))
    per_doc = matches.groupBy("doc_id", "h").agg(F.collect_list(F.struct("t_doc", "t_h", "x", "y")).alias("matches"))
    found = scratch.table(per_doc.mapInArrow(_chain, CHAINS), "chains")
    scratch.drop("shared", "several", "first", "further-left", "further-right", "others-left", "others-right")

    # Tables again: a text that very many chains end in has its blocks dealt out, here and where they meet it.
    sizes = scratch.table(found.groupBy("t_doc", "t_h").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("doc_id", "h", "part_no"), F.col("blocks"))
    places = found.select("t_doc", "t_h", "doc_id", "h", "part_no", "low", "high").join(sizes, ["t_doc", "t_h"])
    places = scratch.table(places.withColumn("block", block).drop("blocks"), "places")
    wanted = places.groupBy("t_doc", "t_h", "block").agg(F.collect_list(F.struct("doc_id", "h", "part_no", "low", "high")).alias("wanted"))
    wanted = scratch.table(wanted, "wanted")
    ends = found.select("doc_id", "h").union(found.select("t_doc", "t_h")).distinct()
    texts = scratch.table(marked(plain, _key(), ends, _key(), "hit").where("hit").select("doc_id", "h", "text").join(ends, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]), "texts")
    parts = texts.select(F.col("doc_id").alias("t_doc"), F.col("h").alias("t_h"), "text").join(wanted, ["t_doc", "t_h"]).select("text", "wanted")
    parts = scratch.table(parts.mapInArrow(_cut_out, "doc_id long, h long, part_no int, part string"), "parts")
    whole = found.join(parts, ["doc_id", "h", "part_no"]).groupBy("doc_id", "h").agg(F.collect_list(F.struct("t_doc", "t_h", "low", "x", "y", "size", "part")).alias("chains"))
    return scratch.last(texts.join(whole, ["doc_id", "h"]).mapInArrow(_align(min_words), SPANS), "spans")


def without_passages(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with the same columns, texts without repeated passages, n_chars (if there) set anew; no row goes."""
    spans = repeated_passages(documents, min_words).select("doc_id", "h", "kept_text")
    rows = documents.select(F.struct("*").alias("given"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("h"))
    rows = marked(rows, _key(), spans, _key(), "hit")
    changed = rows.where("hit").join(spans, ["doc_id", "h"], "left")
    found, text = F.col("kept_text").isNotNull(), F.coalesce("kept_text", "given.text")
    new = {"text": text, "n_chars": F.when(found, F.length(text)).otherwise(F.col("given.n_chars")).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {"text": text}
    changed = changed.select(*[(new[n] if n in new else F.col(f"given.`{n}`")).alias(n) for n in documents.columns])
    return rows.where(~F.col("hit")).select("given.*").unionByName(changed)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_spans, removed_words, spans, kept_chars."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = repeated_passages(documents)
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = spans.select("doc_id", "h", F.size("spans").alias("n_spans"), cut.alias("removed_words"), "spans", F.length("kept_text").alias("rest"))
    rows = documents.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("chars"))
    zero = lambda c, z: F.coalesce(F.col(c), z).alias(c)
    return rows.join(found, ["doc_id", "h"], "left").select(
        "doc_id", zero("n_spans", F.lit(0)), zero("removed_words", F.lit(0).cast("long")),
        zero("spans", F.array().cast("array<struct<start:int,end:int>>")), F.coalesce("rest", "chars", F.lit(0)).cast("long").alias("kept_chars"),
    )
