"""Operator 9: language identification by a linear-chain conditional random field over words.

Each word has hashed features (the word itself as a lexicon entry, its first and last bytes as affixes, its byte
n-grams) whose learned weights add up to a score for each language; learned transitions tie neighbouring words.
Forward-backward over chains of words gives each word's probabilities, so that code-switched text is labelled word
by word; a text's language is the one with the largest sum over its words with letters, its score that share.

The model is trained in numpy on a bounded sample: at most ``SAMPLE`` texts for each language. Each of EPOCHS passes
draws chains anew from all chains of 16 words, and shorter ones at the texts' ends, of these whole texts: about
PASS_WORDS words, shared out evenly by language. Half of the training chains are spliced from texts of two
languages, so that transitions learn switches.

Defined results: ``und`` with score 0 for null text or text without a letter; long texts are labelled whole, in
chains of ``CHAIN`` words; repeated rows get equal results, and a repeated id gives one of its texts to the sample; with no labelled text at all every text is ``und``; an
empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm._text import Words, mix, slices, utf8

#: Training texts for each language, and words that one pass over them draws.
SAMPLE, PASS_WORDS = 300, 250_000
BUCKETS = 1 << 17
CHAIN = 64
GRAMS = (2, 4)
EPOCHS, RATE = 3, 0.5

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
#: Second bytes of the only letters that begin with byte C2.
AFTER_C2 = np.zeros(256, bool)
AFTER_C2[[0xAA, 0xB5, 0xBA]] = True


def letters(data: np.ndarray) -> np.ndarray:
    """True at bytes that begin a letter, and some other characters beyond Latin-1, in UTF-8."""
    out = LETTER[data]
    out[:-1] |= (data[:-1] == 0xC2) & AFTER_C2[data[1:]]
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    moves: np.ndarray  # (languages, languages)


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(single features: words x 6, byte n-gram features in a row, offsets of the words in these)."""
    s, e = words.starts, words.ends
    keys = [words.hashes()]
    for n in (1, 3, 4):
        keys.append(mix(words.span_hash(s, np.minimum(e, s + n)) + np.uint64(n)))
    for n in (2, 4):
        keys.append(mix(words.span_hash(np.maximum(s, e - n), e) + np.uint64(100 + n)))
    single = np.stack([(k & np.uint64(BUCKETS - 1)).astype(np.int64) for k in keys], axis=1)
    n = e - s
    counts = np.maximum(n - GRAMS[1] + 1, 1)
    upto = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(s - upto[:-1], counts) + np.arange(upto[-1])
    stop = np.minimum(at + GRAMS[1], np.repeat(e, counts))
    grams = (mix(words.span_hash(at, stop) + np.uint64(200)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return single, grams, upto


def emissions(weights: np.ndarray, single: np.ndarray, grams: np.ndarray, upto: np.ndarray) -> np.ndarray:
    score = weights[single[:, 0]].copy()
    for k in range(1, single.shape[1]):
        score += weights[single[:, k]]
    if len(upto) > 1:
        score += np.add.reduceat(weights[grams], upto[:-1], axis=0)
    return score


def forward_backward(score: np.ndarray, moves: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word probabilities (chains, steps, languages) and expected transitions, for chains whose valid steps come first."""
    b, t, k = score.shape
    local = np.exp(score - score.max(axis=2, keepdims=True))
    move = np.exp(moves)
    alpha, beta = np.empty((b, t, k)), np.ones((b, t, k))
    alpha[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        step = (alpha[:, i - 1] @ move) * local[:, i]
        alpha[:, i] = step / step.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        step = (local[:, i + 1] * beta[:, i + 1]) @ move.T
        step /= step.sum(axis=1, keepdims=True)
        beta[:, i] = np.where(valid[:, i + 1 : i + 2], step, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pair = np.zeros((k, k))
    for i in range(t - 1):
        both = alpha[:, i, :, None] * move * (local[:, i + 1] * beta[:, i + 1])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        pair += both[valid[:, i + 1]].sum(axis=0)
    return gamma, pair


def word_probabilities(model: Model, score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Probabilities (words, languages) for texts whose words lie in a row; chains of CHAIN words within a text."""
    counts = np.diff(bounds)
    chains = -(-counts // CHAIN)
    owner = np.repeat(np.arange(len(counts)), chains)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chains) - chains, chains)
    begin = bounds[:-1][owner] + number * CHAIN
    length = np.minimum(bounds[1:][owner] - begin, CHAIN)
    out = np.empty_like(score)
    move = np.exp(model.moves).astype(score.dtype)
    local_all = np.exp(score - score.max(axis=1, keepdims=True))
    for some in np.array_split(np.argsort(length, kind="stable"), max(1, len(length) // 4096)):
        if not len(some):
            continue
        t = int(length[some].max())
        at = np.minimum(begin[some][:, None] + np.arange(t), len(score) - 1)
        valid = np.arange(t) < length[some][:, None]
        local = np.where(valid[:, :, None], local_all[at], 1)
        alpha = np.empty_like(local)
        alpha[:, 0] = local[:, 0]
        for i in range(1, t):
            step = (alpha[:, i - 1] @ move) * local[:, i]
            alpha[:, i] = step / step.sum(axis=1, keepdims=True)
        beta = np.ones_like(local[:, 0])
        for i in range(t - 1, -1, -1):
            if i < t - 1:
                step = (local[:, i + 1] * beta) @ move.T
                beta = np.where(valid[:, i + 1 : i + 2], step / step.sum(axis=1, keepdims=True), 1)
            gamma = alpha[:, i] * beta
            ok = valid[:, i]
            out[at[ok, i]] = (gamma / gamma.sum(axis=1, keepdims=True))[ok]
    return out


def shared_out(sizes: np.ndarray, label: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Numbers of pieces, taken in ``order``, of about ``most`` words, as many words of each label; what one has too
    little of, others get."""
    own = [order[label[order] == c] for c in np.unique(label)]
    own.sort(key=lambda some: int(sizes[some].sum()))
    kept, left = [], most
    for done, some in enumerate(own):
        ends = np.cumsum(sizes[some])
        n = max(1, int(np.searchsorted(ends, left // (len(own) - done), side="right")))
        kept.append(some[:n])
        left = max(0, left - int(ends[min(n, len(ends)) - 1]))
    return np.concatenate(kept)


def all_pieces(texts: list[str], length: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end byte, words) of every run of ``length`` words of all texts, with the shorter ones at ends."""
    out = []
    for at in range(0, len(texts), 100):
        words = Words(*utf8(pa.array(texts[at : at + 100], pa.string())))
        count = -(-np.diff(words.bounds) // length)
        text = np.repeat(np.arange(len(count)), count)
        first = words.bounds[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * length
        last = np.minimum(first + length, words.bounds[1:][text])
        begin = words.offsets[text]
        out.append((text + at, words.starts[first] - begin, words.ends[last - 1] - begin, last - first))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def train(texts: list[str], languages: list[str], seed: int = 7) -> Model | None:
    """Stochastic gradient steps (Adagrad) on the log likelihood of chains of words."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    k = len(names)
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    of, begin, end, n_words = all_pieces(texts)
    if not len(of):
        return Model(names, weights.astype(np.float32), moves)
    language = np.array([names.index(x) for x in languages])[of]
    g_w, g_m = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        drawn = shared_out(n_words, language, rng.permutation(len(of)), PASS_WORDS)
        words = Words(*utf8(pa.array([texts[of[i]].encode()[begin[i] : end[i]] for i in drawn.tolist()], pa.binary()).cast(pa.string())))
        label = language[drawn][words.doc]
        single, grams, upto = word_features(words)
        pieces = [np.arange(a, b) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)]
        order = rng.permutation(len(pieces))
        for batch in np.array_split(order, max(1, len(order) // 256)):
            chains = [np.concatenate([pieces[i], pieces[int(rng.integers(len(pieces)))]]) if rng.random() < 0.5 else pieces[i] for i in batch]
            t = max(map(len, chains))
            at, valid = np.zeros((len(chains), t), np.int64), np.zeros((len(chains), t), bool)
            for i, c in enumerate(chains):
                at[i, : len(c)], valid[i, : len(c)] = c, True
            flat = at[valid]
            sizes = upto[flat + 1] - upto[flat]
            spans = np.repeat(upto[flat] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            own = grams[spans]
            score = np.zeros((*at.shape, k))
            score[valid] = emissions(weights, single[flat], own, np.concatenate([[0], np.cumsum(sizes)]))
            gamma, pair = forward_backward(score, moves, valid)
            truth = np.eye(k)[label[flat]]
            error = truth - gamma[valid]
            both = valid[:, 1:]
            seen = np.zeros((k, k))
            np.add.at(seen, (label[at[:, :-1][both]], label[at[:, 1:][both]]), 1)
            rows = np.concatenate([single[flat].ravel(), own])
            values = np.concatenate([np.repeat(error, single.shape[1], axis=0), np.repeat(error, sizes, axis=0)])
            used, where = np.unique(rows, return_inverse=True)
            step = np.stack([np.bincount(where, values[:, c], len(used)) for c in range(k)], axis=1) / len(chains)
            g_w[used] += step * step
            weights[used] += RATE * step / np.sqrt(g_w[used]) * 0.2
            change = (seen - pair) / len(chains)
            g_m += change * change
            moves += RATE * change / np.sqrt(g_m) * 0.2
    return Model(names, weights.astype(np.float32), moves)


def sample(docs: DataFrame, lang: str, doc_id: str, text: str) -> tuple[list[str], list[str]]:
    """At most SAMPLE texts for each language, the first by a hash of the id among the rows that may be learned from.

    Ids are ranked only where their hash is in the share of about four SAMPLEs of their language, by its approximate
    number of ids, so few of them meet, whatever the input. Of a repeated id the least text is taken."""
    from pyspark.sql import Window as W

    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col(doc_id)), F.lit(False)))
    ids = usable.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(doc_id, F.lit(9)).alias("h"))
    sizes = ids.groupBy("lang").agg(F.approx_count_distinct("id").alias("n"))
    share = (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= 4 * SAMPLE
    # a row for each language, of which the model holds whole weight columns anyway
    few = ids.join(F.broadcast(sizes), "lang").filter(share).select("id", "lang", "h").distinct()
    picked = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))).filter(F.col("r") <= SAMPLE).select("id", "lang")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(picked), ["id", "lang"])
    found = sorted(rows.groupBy("id", "lang").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["lang"], str(r["id"])))
    return [r["text"] for r in found], [r["lang"] for r in found]


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, "text", 1 << 20):
            n = batch.num_rows
            names, share = np.full(n, "und", object), np.zeros(n)
            data, offsets = utf8(batch.column("text"))
            words = Words(data, offsets)
            if model is not None and len(words.starts):
                score = emissions(model.weights, *word_features(words))
                gamma = word_probabilities(model, score, words.bounds)
                letter = letters(data)
                lettered = np.add.reduceat(letter.astype(np.int32), words.starts) > 0
                gamma = gamma * lettered[:, None]
                sums = np.zeros((len(words.starts) + 1, gamma.shape[1]))
                np.cumsum(gamma, axis=0, out=sums[1:])
                total = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
                best, all_ = total.argmax(axis=1), total.sum(axis=1)
                ascii_letters = np.concatenate([[0], np.cumsum(letter & (data < 128))])
                plain = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in np.flatnonzero(all_ > 0).tolist():
                    if plain[i] or any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode()):
                        names[i], share[i] = model.languages[best[i]], min(1.0, total[i, best[i]] / all_[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(label, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trains on the rows that are not held out, labels all."""
    found = predict(docs, train(*sample(docs, lang, doc_id, text)), doc_id, text)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
