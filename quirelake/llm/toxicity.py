"""Operator 1: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its embedding (hashed word, without signs at its ends) beside the mean embedding of its characters'
n-grams and of its beginnings of BEGINNINGS bytes. Words and runs that few texts of the sample hold count as none, in training
and in scoring, and what the others mean decays, so that a text is not known by its rare words. Overlapping
windows of ``WINDOW`` words, ``STRIDE`` apart, cover each whole text; each window runs through a forward and a
backward GRU, attention pools the states, and a logistic unit scores the window. A text scores as its highest
window, as one toxic passage makes a text toxic; so it is trained: texts are labelled, windows are not, and the
loss is on a smooth maximum over a text's windows.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled whole texts of each label that are not held out.
A step draws ``STEP_WINDOWS`` windows anew from all windows of each of its texts: half of them those that score
highest by now, the others at random, so no window is out of reach. Scoring reads every window of every text.

Defined results: null, empty and wordless texts score 0; a text shorter than a window is one window; repeated rows get
equal scores; of a repeated id the least text is learned from; repeated labels of a document count as toxic if any is; null labels count as none; without labels of
both kinds every score is 0; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm._text import Words, mix, slices, utf8
from quirelake.llm.language_id import held_out

WINDOW, STRIDE = 32, 24
SAMPLE, STEP_WINDOWS = 1400, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 16
EMBED, HIDDEN, ATTEND = 8, 8, 8
CHAR_GRAM, BEGINNINGS = 4, [6, 8]
ROUNDS, RATE, BATCH, DROP = 600, 0.02, 48, 0.5
THRESHOLD = 0.7
#: Texts of the sample that must hold a word or a run of characters for it to count; the scale and the decay of the steps
#: of what words and runs mean: a run that a few texts share by chance moves little and is forgotten.
KNOWN, SPARSE = 6, 0.01

#: Printable ASCII that is neither a letter nor a digit.
SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])

Params = dict[str, np.ndarray]


def new_params(seed: int = 3) -> Params:
    rng = np.random.default_rng(seed)
    d = 2 * EMBED
    p = {"word": rng.normal(0, 0.02, (WORD_BUCKETS, EMBED)), "char": rng.normal(0, 0.02, (CHAR_BUCKETS, EMBED))}
    for way in "fb":
        p |= {f"w{way}": rng.normal(0, d**-0.5, (d, 3 * HIDDEN)), f"u{way}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"b{way}": np.zeros(3 * HIDDEN)}
    p |= {"a": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), "ab": np.zeros(ATTEND), "av": rng.normal(0, 0.3, ATTEND), "o": rng.normal(0, 0.3, 2 * HIDDEN), "ob": np.array([-1.0])}
    return {k: v.astype(np.float32) for k, v in p.items()}


def cores(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words without up to three ASCII signs at each end; a word of signs keeps one."""
    s, e = words.starts.copy(), words.ends.copy()
    for _ in range(3):
        e -= (e - s > 1) & SIGN[words.data[e - 1]] if len(e) else 0
        s += (e - s > 1) & SIGN[words.data[s]] if len(s) else 0
    return s, e


def word_inputs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, character n-gram buckets in a row, offsets of the words in these)."""
    s, e = cores(words)
    word = (words.span_hash(s, e) & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    plain = np.maximum(e - s - CHAR_GRAM + 1, 1)
    counts = plain + sum(e - s >= n for n in BEGINNINGS)
    upto = np.concatenate([[0], np.cumsum(counts)])
    number = np.arange(upto[-1]) - np.repeat(upto[:-1], counts)
    extra = number - np.repeat(plain, counts)  # from 0 on: the word's beginnings
    start = np.repeat(s, counts) + np.where(extra < 0, number, 0)
    size = np.where(extra < 0, CHAR_GRAM, np.array(BEGINNINGS)[np.maximum(extra, 0)])
    grams = words.span_hash(start, np.minimum(start + size, np.repeat(e, counts)))
    # a word's first n-gram and its beginnings are told from the same inside a word
    first = (number == 0) | (extra >= 0)
    grams[first] = mix(grams[first] + np.uint64(1))
    return word, (grams & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64), upto


def embed(p: Params, word: np.ndarray, grams: np.ndarray, upto: np.ndarray) -> np.ndarray:
    x = np.zeros((len(word), 2 * EMBED), np.float32)
    x[:, :EMBED] = p["word"][word]
    counts = np.diff(upto)
    sums = np.zeros((len(word), EMBED), np.float32)
    for j in range(min(int(counts.max()), 24)):  # the j-th n-gram of all words that have one
        some = np.flatnonzero(counts > j)
        sums[some] += p["char"][grams[upto[some] + j]]
    for i in np.flatnonzero(counts > 24).tolist():
        sums[i] += p["char"][grams[upto[i] + 24 : upto[i + 1]]].sum(axis=0)
    x[:, EMBED:] = sums / counts[:, None]
    return x


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, text) of all overlapping windows of texts whose words lie in a row."""
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[:-1][text] + number * STRIDE
    return first, np.minimum(bounds[1:][text] - first, WINDOW), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def tanh(x: np.ndarray) -> np.ndarray:
    return 2 * sigmoid(2 * x) - 1  # numpy's exp is vectorised on more machines than its tanh


def _run(pre: np.ndarray, u: np.ndarray, at: np.ndarray, valid: np.ndarray, backward: bool, keep: list | None) -> np.ndarray:
    """States (steps, windows, HIDDEN). ``pre``: input parts of all words; a step outside a window leaves its state."""
    t, n = at.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((t, n, HIDDEN), np.float32)
    whole = valid.all(axis=1)
    for i in range(t - 1, -1, -1) if backward else range(t):
        x = pre[at[i]]
        gates = sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        rec = h @ u[:, 2 * HIDDEN :]
        c = tanh(x[:, 2 * HIDDEN :] + r * rec)
        new = h + z * (c - h)
        if not whole[i]:
            new = np.where(valid[i][:, None], new, h)
        if keep is not None:
            keep.append((i, h, z, r, rec, c))
        h = new
        out[i] = h
    return out


def window_logits(p: Params, x: np.ndarray, first: np.ndarray, length: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """Logit of each window. ``x``: inputs of all words in a row."""
    t = int(length.max())
    at = np.minimum(first + np.arange(t)[:, None], len(x) - 1)
    valid = np.arange(t)[:, None] < length
    kept_f, kept_b = ([], []) if tape is not None else (None, None)
    fw = _run(x @ p["wf"] + p["bf"], p["uf"], at, valid, False, kept_f)
    bw = _run(x @ p["wb"] + p["bb"], p["ub"], at, valid, True, kept_b)
    h = np.concatenate([fw, bw], axis=2)
    s = tanh(h @ p["a"] + p["ab"])
    e = np.where(valid, s @ p["av"], -1e9)
    a = np.exp(e - e.max(axis=0))
    a = a / a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, h)
    if tape is not None:
        tape |= {"at": at, "valid": valid, "f": kept_f, "b": kept_b, "h": h, "s": s, "att": a, "pooled": pooled}
    return pooled @ p["o"] + p["ob"][0]


def fast_logits(p: Params, pre: dict[str, np.ndarray], first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """window_logits without a tape, laid out features by windows, so that every step is over whole rows."""
    t, n = int(length.max()), len(first)
    at = np.minimum(first + np.arange(t)[:, None], len(pre["f"]) - 1)
    valid = np.arange(t)[:, None] < length
    whole = valid.all(axis=1)
    states = np.empty((t, 2 * HIDDEN, n), np.float32)
    for way, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
        u_gates, u_new = np.ascontiguousarray(-p[f"u{way}"][:, : 2 * HIDDEN].T), np.ascontiguousarray(-2 * p[f"u{way}"][:, 2 * HIDDEN :].T)
        h = np.zeros((HIDDEN, n), np.float32)
        for i in range(t - 1, -1, -1) if way == "b" else range(t):
            v = np.ascontiguousarray(pre[way][at[i]].T)
            gates = u_gates @ h
            gates += v[: 2 * HIDDEN]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            c = u_new @ h
            c *= gates[HIDDEN:]
            c += v[2 * HIDDEN :]
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            c -= h
            c *= gates[:HIDDEN]
            if not whole[i]:
                c *= valid[i]
            h = h + c
            states[i, half] = h
    e = np.empty((t, n), np.float32)
    at_ = np.ascontiguousarray(-2 * p["a"].T)
    for i in range(t):
        s = at_ @ states[i]
        s -= 2 * p["ab"][:, None]
        np.exp(s, out=s)
        s += 1
        np.divide(2, s, out=s)
        s -= 1
        e[i] = p["av"] @ s
    e = np.where(valid, e, np.float32(-1e9))
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    score = np.zeros(n, np.float32)
    for i in range(t):
        score += a[i] * (p["o"] @ states[i])
    return score + p["ob"][0]


def all_logits(p: Params, x: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logits of any number of windows, windows of like length together."""
    out = np.empty(len(first), np.float32)
    order = np.argsort(length, kind="stable")
    pre = {}
    for way in "fb":
        pre[way] = x @ p[f"w{way}"] + p[f"b{way}"]
        pre[way][:, : 2 * HIDDEN] *= -1
        pre[way][:, 2 * HIDDEN :] *= -2
    with np.errstate(over="ignore"):
        for at in range(0, len(order), 2048):
            some = order[at : at + 2048]
            out[some] = fast_logits(p, pre, first[some], length[some])
    return out


def gradients(p: Params, x: np.ndarray, tape: dict, d_logit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of all dense parameters, and of ``x``, by back-propagation through time. No two windows share a row of ``x``."""
    g = {"o": tape["pooled"].T @ d_logit, "ob": np.array([d_logit.sum()])}
    h, s, a, at, valid = tape["h"], tape["s"], tape["att"], tape["at"], tape["valid"]
    d_pooled = d_logit[:, None] * p["o"]
    d_h = a[:, :, None] * d_pooled
    d_a = np.einsum("nh,tnh->tn", d_pooled, h)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g["av"] = np.einsum("tn,tnk->k", d_e, s)
    d_s = d_e[:, :, None] * p["av"] * (1 - s * s)
    g["a"], g["ab"] = np.einsum("tnh,tnk->hk", h, d_s), d_s.sum(axis=(0, 1))
    d_h = d_h + d_s @ p["a"].T
    d_x = np.zeros(x.shape, np.float32)
    for way, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
        u, w = p[f"u{way}"], p[f"w{way}"]
        d_u, d_pre = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
        later = np.zeros((at.shape[1], HIDDEN), np.float32)
        for i, before, z, r, rec, c in reversed(tape[way]):
            d = later + d_h[i][:, half]
            live = valid[i][:, None]
            d_c = d * z * (1 - c * c) * live
            d_z = d * (c - before) * z * (1 - z) * live
            d_r = d_c * rec * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r], axis=1)
            d_rec = d_c * r
            d_u[:, : 2 * HIDDEN] += before.T @ d_gates
            d_u[:, 2 * HIDDEN :] += before.T @ d_rec
            later = np.where(live, d * (1 - z), d) + d_gates @ u[:, : 2 * HIDDEN].T + d_rec @ u[:, 2 * HIDDEN :].T
            d_pre[at[i][valid[i]]] = np.concatenate([d_gates, d_c], axis=1)[valid[i]]
        g[f"u{way}"], g[f"w{way}"], g[f"b{way}"] = d_u, x.T @ d_pre, d_pre.sum(axis=0)
        d_x += d_pre @ w.T
    return g, d_x


def inputs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_inputs of many texts, made a hundred texts at a time to save memory, and the texts' bounds."""
    sizes, word, grams, counts = [], [], [], []
    for at in range(0, len(texts), 100):
        words = Words(*utf8(pa.array(texts[at : at + 100], pa.string())))
        if not len(words.starts):
            sizes.append(np.diff(words.bounds))
            continue
        w, g, u = word_inputs(words)
        sizes.append(np.diff(words.bounds))
        word.append(w.astype(np.int32))
        grams.append(g.astype(np.int32))
        counts.append(np.diff(u))
    none = [np.zeros(0, np.int32)]
    return np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(word or none), np.concatenate(grams or none), np.concatenate([[0], np.cumsum(np.concatenate(counts or none))])


def sample_logits(p: Params, bounds: np.ndarray, word: np.ndarray, grams: np.ndarray, upto: np.ndarray, first: np.ndarray, length: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Logits of all windows of the sample, fifty texts at a time."""
    out = np.zeros(len(first), np.float32)
    for d in range(0, len(bounds) - 1, 50):
        e = min(d + 50, len(bounds) - 1)
        a, b, v, w = bounds[d], bounds[e], of[d], of[e]
        if w > v:
            out[v:w] = all_logits(p, embed(p, word[a:b], grams[upto[a] : upto[b]], upto[a : b + 1] - upto[a]), first[v:w] - a, length[v:w])
    return out


def known_buckets(bounds: np.ndarray, word: np.ndarray, grams: np.ndarray, upto: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The buckets of words and of n-grams that at least ``least`` texts of the sample hold."""
    seen = {"word": np.zeros(WORD_BUCKETS, np.int64), "char": np.zeros(CHAR_BUCKETS, np.int64)}
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        seen["word"][np.unique(word[a:b])] += 1
        seen["char"][np.unique(grams[upto[a] : upto[b]])] += 1
    return {k: n >= least for k, n in seen.items()}


def train(texts: list[str], labels: list[int], seed: int = 5) -> Params | None:
    """Adam on the loss of texts; a text's logit is a smooth maximum over its windows."""
    y = np.array(labels, np.float32)
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    bounds, word, grams, upto = inputs_of(texts)
    first, length, text = windows(bounds)
    if not len(first):
        return None
    of = np.searchsorted(text, np.arange(len(texts) + 1))
    p = new_params()
    known = known_buckets(bounds, word, grams, upto, min(KNOWN, max(1, int((y == 1).sum()) // 20)))
    for k, live in known.items():
        p[k][~live] = 0
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    usable = np.flatnonzero(np.diff(of) > 0)
    ones, zeros = usable[y[usable] == 1], usable[y[usable] == 0]
    # every fifth text is kept for the scale of the scores
    kept = np.concatenate([ones[::5], zeros[::5]]) if min(len(ones), len(zeros)) >= 20 else np.zeros(0, np.int64)
    if len(kept):
        ones, zeros = np.delete(ones, np.s_[::5]), np.delete(zeros, np.s_[::5])
    if not len(ones) or not len(zeros):
        return None
    step = 0
    # the fewer the toxic texts, the more of what words seem to mean is chance
    decay = min(0.03, 3400 / len(ones) ** 2)
    rank = np.zeros(len(first))
    for turn in range(ROUNDS):
        if turn and turn % (ROUNDS // 6) == 0:
            # the windows that score highest are those that decide: they take half of each text's places from here on
            rank = sample_logits(p, bounds, word, grams, upto, first, length, of)
        chosen = np.concatenate([rng.choice(ones, BATCH // 2), rng.choice(zeros, BATCH // 2)])
        picked, owner = [], []
        for j, d in enumerate(chosen.tolist()):
            have = np.arange(of[d], of[d + 1])
            if len(have) > STEP_WINDOWS:
                high = have[np.argsort(-rank[have], kind="stable")[: STEP_WINDOWS // 2]]
                have = np.concatenate([high, rng.choice(np.setdiff1d(have, high), STEP_WINDOWS - len(high), replace=False)])
            some = have
            picked.append(some)
            owner.append(np.full(len(some), j))
        w, owner = np.concatenate(picked), np.concatenate(owner)
        # the words of the chosen windows, in a row of their own
        ids = np.concatenate([np.arange(a, a + n) for a, n in zip(first[w].tolist(), length[w].tolist(), strict=True)])
        place = np.cumsum(length[w]) - length[w]
        sizes = np.diff(upto)[ids]
        spans = np.repeat(upto[:-1][ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        own, own_upto = grams[spans], np.concatenate([[0], np.cumsum(sizes)])
        x = embed(p, word[ids], own, own_upto)
        # some words are hidden, and some seen by their characters alone, so that no single rare word decides
        live = np.ones(x.shape, np.float32)
        live[rng.random(len(x)) < DROP / 3] = 0
        live[rng.random(len(x)) < DROP, :EMBED] = 0
        x *= live
        tape: dict = {}
        logit = window_logits(p, x, place, length[w], tape)
        top = np.full(BATCH, -1e9)
        np.maximum.at(top, owner, logit)
        weight = np.exp(3 * (logit - top[owner]))
        weight /= np.bincount(owner, weight, BATCH)[owner]
        pooled = np.bincount(owner, weight * logit, BATCH)
        error = sigmoid(pooled) - y[chosen]
        g, d_x = gradients(p, x, tape, (weight * error[owner] / BATCH).astype(np.float32))
        d_x *= live
        each = np.repeat(d_x[:, EMBED:] / sizes[:, None], sizes, axis=0)
        g["word"] = np.stack([np.bincount(word[ids], d_x[:, c], WORD_BUCKETS) for c in range(EMBED)], axis=1)
        g["char"] = np.stack([np.bincount(own, each[:, c], CHAR_BUCKETS) for c in range(EMBED)], axis=1)
        for k, some in known.items():
            g[k][~some] = 0
        step += 1
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            if k in known:  # one scale for the whole table: a rare word's steps stay as small as its gradients
                v[k] += 0.01 * (SPARSE * float((g[k] * g[k]).sum()) / max(np.count_nonzero(g[k]), 1) - v[k])
                p[k] *= 1 - decay
            else:
                v[k] += 0.01 * (g[k] * g[k] - v[k])
            p[k] -= (RATE * min(1.0, 2 - 2 * turn / ROUNDS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    p["scale"] = np.array([1.0, 0.0])
    if len(kept):
        logit = sample_logits(p, bounds, word, grams, upto, first, length, of)
        top = np.array([logit[of[d] : of[d + 1]].max() for d in kept])
        p["scale"] = scaled(top, y[kept])
    return p


def scaled(top: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic curve from texts' highest logits to labels (Newton steps, a little ridge)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = sigmoid(a * top + b)
        w = q * (1 - q) + 1e-6
        grad = np.array([((q - y) * top).sum() + 0.1 * (a - 1), (q - y).sum()])
        hess = np.array([[(w * top * top).sum() + 0.1, (w * top).sum()], [(w * top).sum(), w.sum() + 1e-3]])
        change = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - change[0], b - change[1]
    return np.array([max(a, 0.05), b])


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> tuple[list[str], list[int]]:
    """At most SAMPLE texts of each label, by a hash of the id, among rows that are not held out. Labels alone are
    ranked; texts are then found by a join with these bounded ids."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labelled documents that are there; the semi-join moves ids, not texts
    marks = marks.filter(~held_out(F.col("doc_id"))).join(docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    order = F.xxhash64("doc_id", F.lit(1))
    picked = [marks.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(SAMPLE) for y in (0, 1)]
    some = picked[0].unionByName(picked[1])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [int(r["toxic"]) for r in rows]


def text_scores(p: Params | None, column: pa.Array) -> np.ndarray:
    """The score of each text: its highest window's."""
    out = np.zeros(len(column))
    words = Words(*utf8(column))
    if p is not None and len(words.starts):
        x = embed(p, *word_inputs(words))
        first, length, owner = windows(words.bounds)
        np.maximum.at(out, owner, sigmoid(p["scale"][0] * all_logits(p, x, first, length).astype(float) + p["scale"][1]))
    return out


def score_texts(docs: DataFrame, params: Params | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row, over all windows of its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(params)
    kind = docs.schema[doc_id].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text_scores(sent.value, batch.column("text")))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, f"doc_id {kind}, score double")


def reject(docs: DataFrame, params: Params | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(params)
    number = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.schema.field(number).name
                parts = [b.filter(pa.array(text_scores(sent.value, b.column(number)) < threshold)) for b in slices([batch], column, 1 << 20)]
                yield from (b for b in parts if b.num_rows)

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted); ``labels``: (doc_id, toxic)."""
    params = train(*sample(docs, labels, doc_id, text))
    scored = score_texts(docs, params, doc_id, text)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
