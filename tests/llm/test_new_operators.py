"""Operators 11 to 13 against the library, brute force and SQL, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirelake.llm import hard_negatives, periodic_runs, registry, token_counts
from quirelake.llm._text import Words

BYTES = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_tokens string, row string, runs string, body string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA)


def joined(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


# ---- 11


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def n_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


PARTS = ["a", "B", " ", "  ", "\n", "\t", "'s", "'re", "'ll", "don't", "<|endoftext|>", "<|endo", "1", "99", ".", ",", "...", "漢字", "é", " ", "　", " ", "🙂", "?!", "\x85", "hello", " world", "'", '"', "\r\n", "\x1c"]


def test_counts_and_boundaries_equal_the_library(library):
    rng, count = random.Random(3), token_counts.Counter(BYTES)
    for _ in range(400):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(3)]
        assert count.counts(*joined(texts)).tolist() == [n_tokens(library, t) for t in texts], texts
        data = texts[0].encode()
        total, [(places, before)] = count.boundaries(np.frombuffer(data, np.uint8), [(0, len(data))])
        for a, b in zip(places.tolist(), before.tolist(), strict=True):
            assert n_tokens(library, data[a:].decode()) == total - b


def test_a_full_cache_starts_anew(library):
    count = token_counts.Counter(BYTES, keep=50)
    texts = [f"word{i} other{i % 7}, and {i * i}." for i in range(300)]
    for at in range(0, 300, 20):
        assert count.counts(*joined(texts[at : at + 20])).tolist() == [n_tokens(library, t) for t in texts[at : at + 20]]


def test_spliced_chunks_equal_the_library(spark, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(400))) for _ in range(40)]
    texts += ["漢字文" * 300, "a" * 3000, " " * 2000, "x" * 70 + " " * 900 + "y" * 500, "<|endoftext|>" * 90, "'re" * 400, "ab " * 700 + "c" * 1500 + " d" * 300, "a " * 400 + "b" * 200 + " c" * 300]
    found = {r["doc_id"]: r for r in token_counts.count_tokens(docs_of(spark, enumerate(texts)), BYTES, chunk=128, overlap=32).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert (found[i]["n_bytes"], found[i]["n_tokens"]) == (len(text.encode()), n_tokens(library, text)), text


def test_token_counts_of_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "no id"), (4, "twice"), (4, "twice"), (5, "word " * 60_000), (6, "x" * 300_000), (7, "<|endoftext|>")]
    docs = docs_of(spark, rows)
    found = sorted(tuple(r) for r in token_counts.count_tokens(docs.fillna({"doc_id": -1}), BYTES).collect())
    assert found == sorted((-1 if i is None else i, len((t or "").encode()), n_tokens(library, t)) for i, t in rows)
    assert token_counts.count_tokens(docs.filter("doc_id is null"), BYTES).collect()[0]["doc_id"] is None
    assert token_counts.count_tokens(docs.limit(0), BYTES).count() == 0
    broken = docs.limit(1).withColumn("text", F.expr("cast(unhex('61ff62') as string)"))
    assert token_counts.count_tokens(broken, BYTES).collect()[0]["n_tokens"] == n_tokens(library, "a�b")
    with pytest.raises(Exception, match="byte-level"):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_token_count_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in registry.table(spark, SF, "documents").collect()}
    for r in registry.op11_token_counts(spark, SF).collect():
        n = n_tokens(library, texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 1024)


# ---- 12


def brute_runs(w, least):
    n, found = len(w), set()
    for q in range(1, n // 2 + 1):
        s = 0
        while s < n:
            t = s
            while t + q < n and w[t] == w[t + q]:
                t += 1
            size = t - s + q
            if t > s and size >= max(least, 2 * q) and not any(all(w[s + x] == w[s + x + d] for x in range(size - d)) for d in range(1, q)):
                found.add((s, size, q))
            s = max(t, s) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(70)
        w = [chr(97 + rng.randrange(k)) for _ in range(n)]
        if rng.random() < 0.4 and n:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, n - a))
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        least = rng.choice([2, 3, 4, 6, 12])
        texts = [" ".join(w), "", " ".join(w[::-1]) + " zz " + " ".join(w)]
        for text, found in zip(texts, periodic_runs.runs_of_texts(Words(*joined(texts), lower=False), least), strict=True):
            assert found == brute_runs(text.split(), least), (text, least)


def test_runs_of_words_with_many_squares():
    a, b = "a", "a b"
    while len(b.split()) < 500:
        a, b = b, b + " " + a
    assert periodic_runs.runs_of_texts(Words(*joined([b]), lower=False), 12)[0] == brute_runs(b.split(), 12)
    long = " ".join(["x"] * 200_000 + ["y z"] * 50_000)
    assert periodic_runs.runs_of_texts(Words(*joined([long]), lower=False), 12)[0] == [(0, 200_000, 1), (200_000, 100_000, 2)]


def collapsed(w, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a b " * 9), (4, "Ünï x\x0b" * 20), (4, "Ünï x\x0b" * 20), (5, "A a " * 3 + "B"), (6, "w " * 100_000), (7, "a b c d " * 6 + "\n" + "e f " * 12)]
    found = periodic_runs.periodic_runs(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        w = [x for x in (texts[r["doc_id"]] or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
        want = [(0, 100_000, 1)] if r["doc_id"] == 6 else brute_runs(w, 12)
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(w), want, collapsed(w, want))
    assert periodic_runs.periodic_runs(docs_of(spark, rows).limit(0)).count() == 0


def test_periodic_run_query(spark):
    texts = {r["doc_id"]: r["text"] for r in registry.table(spark, SF, "documents").collect()}
    seen = 0
    for r in registry.op12_periodic_runs(spark, SF).collect():
        w = [x for x in (texts[r["doc_id"]] or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = brute_runs(w, 12)
        seen += len(want)
        best = max(want, key=lambda x: (x[1], -x[0], -x[2])) if want else (None,) * 3
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, want).encode()).hexdigest()
    assert seen > 10


# ---- 13


def brute_negatives(rows, is_anchor, n_pos=5, n_neg=5):
    """rows: (id, label, vector) of integers."""
    found = []
    for i, (anchor, label, v) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        scored = [(-sum(a * b for a, b in zip(v, u, strict=True)), other, own == label) for j, (other, own, u) in enumerate(rows) if j != i and len(u) == len(v)]
        for score, positive, _ in sorted(x for x in scored if x[2] and x[1] != anchor)[:n_pos]:
            window = sorted(x for x in scored if not x[2] and 80 * -score <= 100 * -x[0] <= 100 * -score)[:n_neg]
            found += [(anchor, positive, rank + 1, other, -score, -s) for rank, (s, other, _) in enumerate(window)]
    return sorted(found)


def mined(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hard_negatives.hilbert_keys(cells, bits)
        order = sorted(range(len(cells)), key=lambda i: keys[i].tobytes())
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_met():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-9, 9, (20, 3)), rng.integers(-9, 9, (30, 8, 3))
    most, least = hard_negatives.bounds(a, b.min(axis=1), b.max(axis=1))
    scores = np.einsum("ad,znd->azn", a, b)
    assert (scores.max(axis=2) <= most).all() and (scores.min(axis=2) >= least).all()
    points = b[:, 0]
    most, least = hard_negatives.bounds(a, points, points)
    assert (most == a @ points.T).all() and (least == most).all()


@pytest.mark.parametrize("block", [4, 256])
def test_negatives_equal_brute_force(spark, block):
    rng = np.random.default_rng(7)
    centres = rng.integers(-40, 40, (6, 5))
    rows = [(i, int(rng.integers(3)), (centres[i % 6] + rng.integers(-3, 4, 5)).tolist()) for i in range(400)]
    rows += [(400 + i, i % 2, centres[0].tolist()) for i in range(150)]  # equal vectors: only ids break ties
    rows += [(600 + i, i % 3, [int(x) for x in rng.integers(-9, 9, 3)]) for i in range(30)] + [(700, 9, [1, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<long>").repartition(7)
    found = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, block=block)
    assert mined(found) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_zones_of_clusters_spare_blocks(spark):
    rng = np.random.default_rng(9)
    centres = rng.integers(-100, 100, (20, 4))
    rows = [(i, i % 2, (centres[i % 20] + rng.integers(-2, 3, 4)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<long>").withColumn("dim", F.lit(4))
    read = []
    real = hard_negatives._best

    def spied(wanted, blocks, *rest):
        read.append((wanted.count(), blocks.count()))
        return real(wanted, blocks, *rest)

    hard_negatives._best = spied
    try:
        found = hard_negatives.hard_negatives(df, F.col("id") % 100 == 0, block=16, vec_id="id", vector="vector")
        assert mined(found) == brute_negatives(rows, lambda i: i % 100 == 0)
    finally:
        hard_negatives._best = real
    assert all(wanted < 0.5 * blocks * 20 for wanted, blocks in read)


def test_wanted_pairs_hold_no_vectors_and_nothing_that_grows_is_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, rng.integers(-99, 99, 16).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<long>")
    widths, real = [], hard_negatives._best

    def spied(wanted, *rest):
        widths.append(wanted.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0])
        return real(wanted, *rest)

    monkeypatch.setattr(hard_negatives, "_best", spied)
    found = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, block=8)
    assert mined(found) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert max(widths) < 150  # the vectors and windows of up to 64 anchors before, for each block that any of them wants
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 2_000_000_000])
def test_tiles_of_any_size_and_vectors_beyond_floats(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "TILE_GROUPS", 1)
    monkeypatch.setattr(hard_negatives, "TILES", 3)
    monkeypatch.setattr(hard_negatives, "KEPT", 7)
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, [int(x) * size // 9 for x in rng.integers(-9, 10, 2)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<long>")
    found = hard_negatives.hard_negatives(df, F.col("id") % 5 == 0, block=16)
    assert mined(found) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_odd_vectors(spark):
    rows = [(0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.25]), (1, 1, [0.5, 0.25]), (2, 2, [0.5, 0.25]), (3, None, [0.5, 0.25]), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0])]
    rows += [(None, 2, [0.5, 0.25]), (8, 2, []), (100, 1, [-0.5, 0.1]), (9, 2, [0.4, 0.3]), (10, 2, [3.0e9, 1.0]), (200, 7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<double>, dim string, id string")
    found = mined(hard_negatives.hard_negatives(hard_negatives.quantised(df), F.col("id") % 100 == 0))
    whole = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    assert found == brute_negatives(whole, lambda i: i % 100 == 0) and found
    assert hard_negatives.hard_negatives(hard_negatives.quantised(df.limit(0)), F.col("id") % 100 == 0).count() == 0
    none = hard_negatives.hard_negatives(hard_negatives.quantised(df.filter("vec_id <> 0")), F.lit(False))
    assert none.count() == 0
