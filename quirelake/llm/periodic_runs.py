"""Operator 12: maximal periodic runs of words by a suffix automaton whose suffix-link tree has link-cut access.

Each word is appended to a suffix automaton. The path from the new state to the root of its link tree holds all
suffixes of the text so far; a link-cut tree keeps it cut into segments whose states ended last at the same word. The
appended word recolours the path. A segment that ended last ``d`` words ago and whose longest suffix has ``l`` words
is a repeat of period ``d`` that ends here and starts ``l + d`` words back; with ``l >= d`` it holds a square. No
shorter shift fits, as the last end is the nearest one, and no longer suffix does, as the next segment begins there: so
``d`` is the smallest period and the start is that of the maximal run. While a run lasts, every further word reports it
again, so its end is its last report. In all O(n log n) steps for n words, whatever the text.

Words of a run of ``min_length`` words or more lie in windows of ``min_length // 2`` words that occur again in the same
stretch of such words, no further off than half the stretch (a run of period q repeats length - q >= min_length / 2 words
at distance q). A vectorised pass over whole Arrow batches finds these stretches; a run never leaves its stretch, so the
automaton reads stretches only and finds the same runs. All work on a text is in the task that reads it; nothing moves.

Defined results: words are runs of characters outside ``[\\x20\\x09-\\x0D]``, compared as they stand; a null or empty
text, or one of white space, has no runs and an empty ``collapsed``; equal lengths of runs keep the order of start, then
period; repeated rows give a row each; a null id is kept; an empty table stays empty; other columns are ignored, whatever
their names. Memory grows with the longest stretch, by about half a kilobyte a word, and not with the texts of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm._text import Words, mix, runs, slices, utf8

RUNS = "array<struct<start:long,length:long,period:long>>"


def repeats(words: list) -> dict[tuple[int, int], int]:
    """{(start, period): last word} of every maximal stretch at least two smallest periods long."""
    length, link, after = [0, 0], [0, 0], [{}, {}]
    up, low, high, seen = [0, 0], [0, 0], [0, 0], [-1, -1]  # state 1 is the root; 0 is none
    found: dict[tuple[int, int], int] = {}

    def state(words_in: int, above: int, steps: dict, ended: int) -> int:
        length.append(words_in)
        link.append(above)
        after.append(steps)
        up.append(above)
        low.append(0)
        high.append(0)
        seen.append(ended)
        return len(length) - 1

    def rotate(x: int, p: int) -> None:
        g = up[p]
        if low[p] == x:
            inner = high[x]
            low[p] = inner
            high[x] = p
        else:
            inner = low[x]
            high[p] = inner
            low[x] = p
        if inner:
            up[inner] = p
        up[p] = x
        up[x] = g
        if g:
            if low[g] == p:
                low[g] = x
            elif high[g] == p:
                high[g] = x
        seen[x] = seen[p]  # the top of a segment's tree holds its last end

    def splay(x: int) -> None:
        p = up[x]
        while p and (low[p] == x or high[p] == x):
            g = up[p]
            if g and (low[g] == p or high[g] == p):
                if (low[g] == p) == (low[p] == x):
                    rotate(p, g)
                    rotate(x, p)
                else:
                    rotate(x, p)
                    rotate(x, g)
            else:
                rotate(x, p)
            p = up[x]

    last = 1
    for i, word in enumerate(words):
        new = state(i + 1, 1, {}, -1)
        p = last
        while p and word not in after[p]:
            after[p][word] = new
            p = link[p]
        if p:
            q = after[p][word]
            if length[p] + 1 != length[q]:
                splay(q)
                twin = state(length[p] + 1, link[q], dict(after[q]), seen[q])
                above = low[q]  # the twin goes between q and what stands above it, in q's segment
                low[twin], up[twin], low[q] = above, q, twin
                if above:
                    up[above] = twin
                link[q] = twin
                while p and after[p].get(word) == q:
                    after[p][word] = twin
                    p = link[p]
                q = twin
            link[new] = up[new] = q
        last = x = new
        below = 0
        while x:
            splay(x)
            cut = high[x]
            if cut:
                seen[cut] = seen[x]
            ended = seen[x]
            if ended >= 0 and length[x] >= i - ended:
                found[ended - length[x] + 1, i - ended] = i
            high[x] = below
            below, x = x, up[x]
        seen[below] = i
    found.pop((0, 0), None)
    return found


def stretches(h: np.ndarray, bounds: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the word spans that can hold a run of ``min_length`` words, of all texts of a batch."""
    k, n = max(min_length // 2, 1), len(h)
    window = runs(h, k)
    starts, ends = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    while True:
        long = ends - starts >= max(min_length, 2)
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return starts, ends
        sizes = ends - starts - k + 1
        of = np.repeat(np.arange(len(starts)), sizes)
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(of))
        key = mix(window[at] ^ mix(of.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = (key[order[1:]] == key[order[:-1]]) & (2 * (at[order[1:]] - at[order[:-1]]) <= (ends - starts)[of[order[1:]]])
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        began = at[again]
        covered = np.cumsum(np.bincount(began, minlength=n + 1) - np.bincount(began + k, minlength=n + 1)[: n + 1])[:n] > 0
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        first = covered & (edge[:n] | ~np.concatenate([[False], covered[:-1]]))
        edge[ends] = True
        final = covered & (edge[1:] | ~np.concatenate([covered[1:], [False]]))
        left = int((ends - starts).sum())
        starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
        if int((ends - starts).sum()) == left:
            return starts, ends


def runs_of_texts(words: Words, min_length: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words.offsets) - 1)]
    starts, ends = stretches(words.hashes(), words.bounds, min_length)
    raw = words.raw
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        begin = words.starts[a:b].tolist()
        base = begin[0]
        body = raw[base : int(words.ends[b - 1])].tobytes()
        doc = int(words.doc[a])
        skip = a - int(words.bounds[doc])
        spans = [body[x - base : y - base] for x, y in zip(begin, words.ends[a:b].tolist(), strict=True)]
        for (start, period), end in repeats(spans).items():
            if end - start + 1 >= max(min_length, 2 * period):
                found[doc].append((skip + start, end - start + 1, period))
    for one in found:
        one.sort(key=lambda r: (r[0], r[2]))
    return found


def _collapsed(words: Words, found: list[list[tuple[int, int, int]]]) -> pa.Array:
    """The words outside the repeated parts of runs, joined by one space, of each text."""
    keep = np.ones(len(words.starts), bool)
    for doc, one in enumerate(found):
        first = int(words.bounds[doc])
        for start, length, period in one:
            keep[first + start + period : first + start + length] = False
    at = np.flatnonzero(keep)
    doc = words.doc[at]
    follows = np.zeros(len(at), np.int64)
    follows[:-1] = doc[1:] == doc[:-1]
    sizes = words.ends[at] - words.starts[at] + follows
    upto = np.concatenate([[0], np.cumsum(sizes)])
    place = np.repeat(words.starts[at] - upto[:-1], sizes) + np.arange(upto[-1])
    text = words.raw[np.minimum(place, max(len(words.raw) - 1, 0))]
    text[upto[1:][follows == 1] - 1] = 0x20
    bounds = upto[np.searchsorted(doc, np.arange(len(words.offsets)))]
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())


def periodic_runs(docs: DataFrame, min_length: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: all maximal runs of at least ``min_length`` words and two smallest
    periods, by start, then period, and the words joined by one space without those after the first period of a run."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.make_valid_utf8(F.col(text)).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words = Words(*utf8(batch.column("text")), lower=False)
            found = runs_of_texts(words, min_length)
            flat = np.array([r for one in found for r in one], np.int64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(one) for one in found])]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(words.bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), rows), _collapsed(words, found)],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return own.mapInArrow(find, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
