"""Periodic runs of words by grammar compression.

A run is a stretch of words that repeats with its smallest period q, at least
``min_length`` words and ``min_repeats`` periods long, and cannot be extended.

The words of a batch of documents, as ids, are compressed by Re-Pair: a repeated
pair of neighbours becomes one nonterminal, the most frequent first, until no pair
repeats. A round replaces many pairs at once: each occurrence that is more frequent
than the two it overlaps. A run lies inside some nonterminal and crosses the
boundary between its two halves, or crosses a boundary of the start rule. So runs
that cross the boundary are sought once per nonterminal, in one of its expansions,
then translated to all positions of its derivation; cut-off copies of a run inside
a longer one of the same period are merged into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from herbaria.llm.common import small_batches

#: Words compressed together; a longer document is a batch of its own. Runs do not depend on it.
BATCH_WORDS = 200_000

RUNS_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


class Grams:
    """Ids of all windows of 1, 2, 4, ... words of a sequence: equal ids, equal windows.

    Level k holds for each place its id, or -1 where the window occurs once, and
    the next and last place of an equal window. Windows that occur once are not refined.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.ids: list[np.ndarray] = []
        self.next: list[np.ndarray] = []
        self.last: list[np.ndarray] = []
        at, keys = np.arange(self.n), words
        while len(at):
            order = np.argsort(keys, kind="stable")
            same = keys[order[1:]] == keys[order[:-1]]
            ids, last, following = np.full(self.n, -1, np.int32), np.full(self.n, -1, np.int32), np.full(self.n, self.n, np.int32)
            group = np.cumsum(np.append(True, ~same)) - 1
            repeated = np.append(False, same) | np.append(same, False)
            ids[at[order[repeated]]] = group[repeated]
            here, there = at[order[:-1][same]], at[order[1:][same]]
            following[here], last[there] = there, here
            self.ids.append(ids)
            self.next.append(following)
            self.last.append(last)
            size = 1 << len(self.ids) - 1
            at = np.flatnonzero((ids[: self.n - size] >= 0) & (ids[size:] >= 0))
            keys = ids[at].astype(np.int64) * (self.n + 1) + ids[at + size]

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the sequences from x and from y > x."""
        return self._extend(x, y, 1)

    def back(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common suffix of the sequences before x and before y > x."""
        return self._extend(x, y, -1)

    def _extend(self, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        length, top = np.zeros(len(x), np.int64), len(self.ids) - 1
        for k in range(top, -1, -1):
            ids, size, live = self.ids[k], 1 << k, np.arange(len(x))
            while len(live):
                a, b = (x[live] + length[live], y[live] + length[live]) if way > 0 else (x[live] - length[live] - size, y[live] - length[live] - size)
                inside = (a >= 0) & (b < self.n)
                live, a, b = live[inside], a[inside], b[inside]
                live = live[(ids[a] >= 0) & (ids[a] == ids[b])]
                length[live] += size
                if k < top:
                    break
        return length


def re_pair(words: np.ndarray, closed: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Occurrences of the grammar's nonterminals and the places where symbols of the start rule begin.

    ``closed`` marks words that take part in no pair (ends of documents). The arrays
    of occurrences hold a nonterminal's number, the place where its expansion
    begins, the size of its first half and its size.
    """
    symbol, place, size = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), np.int64)
    closed, fresh = closed.copy(), int(words.max(initial=0)) + 1
    rules = [tuple(np.empty(0, np.int64) for _ in range(4))]
    live = np.ones(len(words), bool)  # the pair that begins here may repeat: a pair that stands once never comes again
    while len(symbol) > 1:
        at = np.flatnonzero(live[:-1] & ~closed[:-1] & ~closed[1:])
        pair = symbol[at] << 32 | symbol[at + 1]
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))[: len(at)]
        counts = np.diff(np.append(head, len(ordered)))
        rank = np.where(counts > 1, counts * (len(head) + 1) + np.arange(len(head)), 0)
        live[:] = False
        if not rank.any():
            break
        weight = np.zeros(len(symbol), np.int64)
        weight[at[order]] = np.repeat(rank, counts)
        live = weight > 0
        # stretches of one pair (a a a ...) between lighter ones: every second occurrence
        begins = np.append(True, weight[1:] != weight[:-1])
        stretch = np.flatnonzero(begins)
        heavy = weight[stretch]
        lighter = (np.append(0, heavy[:-1]) < heavy) & (np.append(heavy[1:], 0) < heavy)
        which = np.cumsum(begins) - 1
        taken = np.flatnonzero(lighter[which] & ((np.arange(len(symbol)) - stretch[which]) % 2 == 0))
        _, number = np.unique(weight[taken], return_inverse=True)
        rules.append((fresh + number, place[taken], size[taken], size[taken] + size[taken + 1]))
        symbol[taken], size[taken] = fresh + number, size[taken] + size[taken + 1]
        live[taken] = live[np.maximum(taken - 1, 0)] = True
        fresh += int(number.max()) + 1
        stay = np.ones(len(symbol), bool)
        stay[taken + 1] = False
        symbol, place, size, closed, live = symbol[stay], place[stay], size[stay], closed[stay], live[stay]
    return tuple(np.concatenate(x) for x in zip(*rules)), place


def _periods(grams: Grams, middle: np.ndarray, left: np.ndarray, right: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundary numbers and periods that runs crossing the boundary ``middle`` within [left, right) may have.

    With two periods or more on one side, the words around the boundary stand again
    one period further on that side: a window of 2^k words, 2^k <= q, repeats there.
    """
    found, longest = [], (right - left) // repeats
    number = np.arange(len(middle))
    for k, (follow, before) in enumerate(zip(grams.next, grams.last)):
        low, high = 1 << k, 2 << k  # periods low .. high - 1
        live = number[longest >= low]
        if not len(live):
            break
        # right side: the window that begins at the boundary stands again at + q
        which, at = live, middle[live]
        origin = at
        while len(which):
            at = follow[at]
            near = (at - origin < high) & (at + low <= right[which])
            which, at, origin = which[near], at[near], origin[near]
            q = at - origin
            good = (q >= low) & (q <= longest[which])
            found.append((which[good], q[good]))
        # left side: the window that ends at the boundary, reached from its copy at - q
        which, at = live, middle[live] - low
        fits = at >= left[live]
        which, at = which[fits], at[fits]
        origin = at
        while len(which):
            at = before[at]
            near = (at >= left[which]) & (origin - at < high)
            which, at, origin = which[near], at[near], origin[near]
            q = origin - at
            good = (q >= low) & (q <= longest[which])
            found.append((which[good], q[good]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([w for w, _ in found]), np.concatenate([q for _, q in found])


def _crossing(grams: Grams, middle: np.ndarray, left: np.ndarray, right: np.ndarray, min_length: int, repeats: int) -> tuple[np.ndarray, ...]:
    """(boundary number, start, end, period) of runs that cross ``middle`` inside [left, right)."""
    which, q = _periods(grams, middle, left, right, repeats)
    m, low, high = middle[which], left[which], right[which]
    starts, ends, owners, periods = [], [], [], []
    for a, b in ((m, m + q), (m - q, m)):  # the run holds [a, b] on one of the sides
        inside = (a >= low) & (b < high)
        a, b, lo, hi, w, p = a[inside], b[inside], low[inside], high[inside], which[inside], q[inside]
        start = np.maximum(lo, a - grams.back(a, b))
        end = np.minimum(hi, b + grams.ahead(a, b))
        good = (end - start >= np.maximum(min_length, repeats * p)) & (start < middle[w]) & (end > middle[w])
        for to, values in ((starts, start), (ends, end), (owners, w), (periods, p)):
            to.append(values[good])
    return tuple(np.concatenate(x) for x in (owners, starts, ends, periods))


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs sorted by start and period: smallest period of each stretch, none inside another of its period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        # ends grow within a period: a run that ends no later than one before it lies inside that one
        group = np.cumsum(np.append(True, period[1:] != period[:-1])) * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + group)
        keep = np.append(True, (end + group)[1:] > reach[:-1])
        start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def batch_runs(docs: list[np.ndarray], min_length: int = 6, repeats: int = 4) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, lengths, periods) of the runs of each document, given as arrays of word ids >= 0."""
    sizes = np.array([len(d) for d in docs], np.int64)
    n_ids = max((int(d.max()) for d in docs if len(d)), default=0) + 1
    ends = np.cumsum(sizes + 1) - 1  # place of the separator behind each document
    words = np.empty(int(sizes.sum()) + len(docs), np.int64)
    closed = np.zeros(len(words), bool)
    closed[ends] = True
    words[~closed] = np.concatenate(docs) if len(docs) else 0
    words[ends] = n_ids + np.arange(len(docs))
    owner = np.repeat(np.arange(len(docs)), sizes + 1)
    grams = Grams(words + owner * np.int64(n_ids + len(docs)))  # windows are compared inside one document
    (number, place, half, size), starts_at = re_pair(words, closed)
    _, one = np.unique(number, return_index=True)
    one = one[size[one] >= min_length]
    w, start, end, q = _crossing(grams, place[one] + half[one], place[one], place[one] + size[one], min_length, repeats)
    # translate from the one expansion to every occurrence of the nonterminal
    order = np.argsort(number, kind="stable")
    heads = np.searchsorted(number[order], number[one[w]], "left")
    times = np.searchsorted(number[order], number[one[w]], "right") - heads
    run = np.repeat(np.arange(len(w)), times)
    at = place[order[np.repeat(heads - np.cumsum(times) + times, times) + np.arange(times.sum())]]
    shift = at - place[one[w]][run]
    found = [(start[run] + shift, end[run] + shift, q[run])]
    begin = ends - sizes
    inner = starts_at[~closed[starts_at] & (starts_at > begin[owner[starts_at]])]
    _, start, end, q = _crossing(grams, inner, begin[owner[inner]], ends[owner[inner]], min_length, repeats)
    found.append((start, end, q))
    start, end, q = _maximal(*(np.concatenate(x) for x in zip(*found)))
    cuts = np.searchsorted(start, np.append(begin, len(words)))
    return [(start[a:b] - at, (end - start)[a:b], q[a:b]) for a, b, at in zip(cuts[:-1], cuts[1:], begin)]


def strongest(starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> int:
    """Place of the run of greatest exact length / period; ties: smallest start, then period."""
    ratio = lengths / periods
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12))
    best = int(near[0])
    for i in near[1:]:
        if int(lengths[i]) * int(periods[best]) > int(lengths[best]) * int(periods[i]):
            best = int(i)
    return best  # runs come by start, then period


def periodic_runs(df: DataFrame, text_col: str = "text", min_length: int = 6, repeats: int = 4) -> DataFrame:
    """Append runs, best_run and collapsed to each row of ``df``.

    runs: array of (start, length, period) in words, by start, then period; best_run:
    the one of greatest length / period (ties: smallest start, then period), null
    without runs; collapsed: the words, joined by one space, without those that some
    run contains after its first period. Words are the runs of bytes outside
    ``[\\x20\\x09-\\x0D]``. A null or empty text has no words: no runs, collapsed "".
    Whole texts are used at any length. Repeated rows pass through each with its own
    runs; an empty table stays empty; columns of the new names are replaced, others
    pass through.
    """
    small_batches(df.sparkSession)
    df = df.drop("runs", "best_run", "collapsed")
    schema = T.StructType([*df.schema.fields, T.StructField("runs", RUNS_TYPE),
                           T.StructField("best_run", RUNS_TYPE.elementType), T.StructField("collapsed", T.StringType())])
    struct = pa.struct([(f.name, pa.int64()) for f in RUNS_TYPE.elementType.fields])

    def measured(texts: list[str | None]) -> tuple[list, list, list]:
        known: dict[bytes, int] = {}
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        ids = [np.fromiter((known.setdefault(w, len(known)) for w in doc), np.int64, len(doc)) for doc in words]
        runs, best, kept = [], [], []
        for doc, (start, length, period) in zip(words, batch_runs(ids, min_length, repeats)):
            rows = [{"start": s, "length": n, "period": p} for s, n, p in zip(start.tolist(), length.tolist(), period.tolist())]
            runs.append(rows)
            best.append(rows[strongest(start, length, period)] if rows else None)
            if rows:
                edge = np.zeros(len(doc) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                doc = [w for w, covered in zip(doc, np.cumsum(edge[:-1]).tolist()) if not covered]
            kept.append(b" ".join(doc))
        return runs, best, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            begin = 0
            while begin < len(texts):
                end, room = begin, BATCH_WORDS * 6  # about six characters a word
                while end < len(texts) and (end == begin or room > 0):
                    room -= len(texts[end] or "")
                    end += 1
                runs, best, kept = measured(texts[begin:end])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(begin, end - begin).columns, pa.array(runs, pa.list_(struct)), pa.array(best, struct),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)
                begin = end

    return df.mapInArrow(run, schema)
