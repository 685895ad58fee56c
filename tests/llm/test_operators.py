"""The training-data operators against brute-force versions and on odd inputs."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirelake.llm import decontaminate, jaccard_join, language_id, license_scan, line_dedup, packing, records, toxicity, url_templates, vector_dedup
from quirelake.llm import _spark
from quirelake.llm._spark import components
from quirelake.llm._text import Words, utf8
from quirelake.llm.tokens import encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, "   "), (4, "Word"), (5, "two words"), (6, "Ünï çödé, É \u2028 x\n\n"), (7, "a b c d e f g " * 900), (8, "same text here it is."), (8, "same text here it is."), (9, "same text here it is."), (None, "no id at all")]
SCHEMA = "doc_id long, text string, lang string, id string, n_lines string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def real_docs(spark, n=250):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def brute_components(texts, k, t):
    sets = {}
    for i, text in texts:
        w = words(text)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and len(x & y) >= t * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                comp[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for g in range(12):
        base = [vocabulary[j] for j in rng.integers(0, 400, int(rng.integers(3, 120)))]
        for _ in range(5):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = "edit%d" % rng.integers(1000)
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_join_equals_brute_force(spark, k, t):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs_of(spark, texts), k, t).collect()}
    assert got == brute_components(texts, k, t)


def test_jaccard_join_parts_of_large_blocks(spark, monkeypatch):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs_of(spark, texts), 3, Fraction(9, 10), most=150).collect()}
    assert got == brute_components(texts, 3, Fraction(9, 10))


def test_jaccard_join_blocks_of_shared_passages(spark, monkeypatch):
    """Texts that share passages fall in one block; only those alike as a whole are linked."""
    monkeypatch.setattr(jaccard_join, "PART_SETS", 3)
    rng = np.random.default_rng(5)
    passages = [[f"p{p}x{i}" for i in range(60)] for p in range(3)]
    texts = []
    for g in range(12):
        base = [f"v{j}" for j in rng.integers(0, 5000, int(rng.integers(20, 120)))] + passages[g % 3]
        for c in range(4):
            w = list(base)
            for _ in range(2 * c):
                w[int(rng.integers(len(w)))] = "edit%d" % rng.integers(100000)
            texts.append(" ".join(w))
    texts = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs_of(spark, texts), 5, Fraction(4, 5)).collect()}
    assert got == brute_components(texts, 5, Fraction(4, 5))


def test_jaccard_join_odd_rows(spark):
    rows = jaccard_join.jaccard_components(docs_of(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[4].n_shingles == by[5].n_shingles == 1
    assert by[9].component_id == 8 and by[7].component_id == 7
    assert jaccard_join.jaccard_components(docs_of(spark, [])).count() == 0


def test_signatures_meet_for_all_similar_sets():
    rng = np.random.default_rng(2)
    for t in (Fraction(4, 5), Fraction(9, 10), Fraction(1, 2)):
        for _ in range(300):
            n = int(np.exp(rng.uniform(0, np.log(400))))
            a = set(rng.integers(0, 1 << 62, n).tolist())
            gone = int(rng.integers(0, (1 - t) * n + 1))  # as many differences as the threshold bears
            b = set(list(a)[gone:]) | set(rng.integers(0, 1 << 62, int(rng.integers(0, max(1, (n - gone) / t - n + 1)))).tolist())
            if b and len(a & b) >= t * len(a | b):
                h = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in (a, b)])
                sig, of = jaccard_join.signatures(h, np.array([0, len(a), len(a) + len(b)]), t)
                assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_sets_agree_in_a_filled_segment_or_in_a_prefix():
    """The worst case: every segment that both fill is touched by a difference."""
    t = Fraction(4, 5)
    rng = np.random.default_rng(4)
    lows, differ, segments = jaccard_join.size_classes(60, t)
    met = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(5, 60))).astype(np.uint64))
        n = len(a)
        m = int(segments[np.searchsorted(lows, n, side="right") - 1])
        place = (jaccard_join.mix(a ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(33)).astype(np.int64) % m
        _, one_each = np.unique(place, return_index=True)
        b = np.delete(a, one_each[: int((1 - t) * n)])
        if len(one_each) <= (1 - t) * n:
            met += 1  # nothing that is filled agrees: the prefixes must
        sig, of = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, n, n + len(b)]), t)
        assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (7, 9), (5, 5), (1, 2)]
    assert {(r.id, r.component_id) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {(1, 1), (2, 1), (3, 1), (9, 7), (8, 7), (7, 7)}


def test_components_by_rounds(spark):
    """A chain of ascending ids: the rounds grow with its logarithm."""
    n = 20_000
    edges = spark.range(n).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(-5, -4), (-5, -3)], "a long, b long"))
    rounds = []
    real = _spark.written
    try:
        _spark.written = lambda df, name: (rounds.append(name), real(df, name))[1]
        got = components(edges, few=100)
        assert got.filter("id >= 0").agg(F.min("component_id"), F.max("component_id"), F.count("*")).first() == (0, 0, n + 1)
        assert {(r.id, r.component_id) for r in got.filter("id < 0").collect()} == {(-5, -5), (-4, -5), (-3, -5)}
    finally:
        _spark.written = real
    assert rounds.count("step") <= 20


def test_spread_join_meets_every_row_once(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(6000)], "n long, k long")
    keyed = rows.groupBy("k").count().withColumn("name", F.concat(F.lit("k"), "k"))
    got = _spark.spread_join(rows, keyed, ["k"], "count", ["n"]).collect()
    assert sorted((r.n, r.k, r.name) for r in got) == [(i, 7 if i % 3 else i, f"k{7 if i % 3 else i}") for i in range(6000)]


def test_line_dedup_equals_brute_force(spark):
    blanks, upper = " \t\n\x0b\f\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = ODD + [(100 + i, f"Common É line \r\nown {i}\n\n common É LINE") for i in range(12)] + [(200, "\u2028common é line\n")]
    found = defaultdict(set)
    for n, (i, t) in enumerate(texts):
        for line in (t or "").split("\n"):
            found[line.strip(blanks).translate(upper)].add(i)
    gone = {k for k, v in found.items() if k and len(v) >= 10}
    want = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(blanks).translate(upper) not in gone]
        want.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.drop_common_lines(docs_of(spark, texts).drop("n_lines")).collect()]
    assert sorted(got) == sorted(want) and gone
    assert line_dedup.drop_common_lines(docs_of(spark, []), counts=None).count() == 0


def test_line_dedup_keeps_columns_of_its_own_names(spark):
    docs = docs_of(spark, [(i, "same\nown %d" % i) for i in range(12)])
    kept = line_dedup.drop_common_lines(docs, counts=("lines", "lines_gone"))
    assert kept.columns == [*docs.columns, "lines", "lines_gone"]
    assert {(r.text, r.id, r.n_lines, r.lines, r.lines_gone) for r in kept.collect()} == {("own %d" % i, "x", "y", 2, 1) for i in range(12)}
    assert line_dedup.drop_common_lines(docs, counts=None).columns == docs.columns
    with pytest.raises(ValueError):
        line_dedup.drop_common_lines(docs)


def test_line_dedup_hot_line_and_null_ids(spark):
    """One line that most rows hold, rows without an id, and a count of documents, not of rows."""
    texts = [(i, "hot\n" * 3 + f"own {i}") for i in range(300)] + [(None, "hot\nx")] * 3 + [(1000 + i, "nine") for i in range(9)] + [(2000, "ten")] * 12
    got = sorted((str(r.doc_id), r.text, r.n_dropped) for r in line_dedup.drop_common_lines(docs_of(spark, texts).drop("n_lines")).collect())
    want = [(str(i), f"own {i}", 3) for i in range(300)] + [("None", "x", 1)] * 3 + [(str(1000 + i), "nine", 0) for i in range(9)] + [("2000", "ten", 0)] * 12
    assert got == sorted(want)


def test_encoder_equals_the_library():
    texts = ["Hello, World. it's 3.5 don't", "É. é, ×. a×. naïve… x.,y ..", "", "a" * 5000, "<|endoftext|> x", "tab\tand\u00a0nbsp 漢字. e\u0301."] + [t for _, t in near_texts()]
    enc, library = encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    ids, bounds = enc.encode(*utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def brute_ids(text):
    return [*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file_bytes", [1 << 25, 64])
def test_records_round_trip(spark, file_bytes):
    """Null ids come first, whatever the number of files; rows of one id follow each other."""
    texts = [(8, "other text of eight"), *ODD[::-1], *[(None, f"no id {i}") for i in range(30)]]
    index = records.write_records(docs_of(spark, texts), TOKENIZER, file_bytes=file_bytes)
    assert index.select("file").distinct().count() > 1 or file_bytes > 64
    got = sorted(records.record_digests(index).collect(), key=lambda r: r.start)
    ids = [None if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = [(str(i), len(brute_ids(t)), crc(brute_ids(t))) for i, t in texts]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_records_of_an_empty_table(spark):
    assert records.record_digests(records.write_records(docs_of(spark, []), TOKENIZER)).collect() == []


def test_damaged_records_are_noticed():
    whole = records.frame(b"abc")
    assert records.unframe(whole) == b"abc"
    for bad in (whole[:-1], b"\x04" + whole[1:], whole[:13] + b"X" + whole[14:]):
        with pytest.raises(ValueError):
            records.unframe(bad)


def test_packing(spark):
    texts = ODD + [(i + 50, t) for i, t in near_texts()]
    rows = packing.pack(packing.cut(docs_of(spark, texts), TOKENIZER, 128), 128).collect()
    ids = {str(i): brute_ids(t) for i, t in texts}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert crc(ids[str(r.doc_id)][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[str(r.doc_id)])
        seen[str(r.doc_id)].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, parts in seen.items():
        copies = 2 if i == "8" else 1
        assert sum(n for _, n in parts) == copies * len(ids[i])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 128


def test_best_fit_equals_a_plain_search():
    lengths = np.random.default_rng(0).integers(1, 65, 500)
    windows, offsets = packing.best_fit_decreasing(lengths, 64)
    rooms: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        room = min(fits) if fits else 64
        assert offsets[i] == 64 - room
        if fits:
            rooms.remove(room)
        rooms.append(room - int(lengths[i]))
    assert len(set(windows.tolist())) == len(rooms)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in base[i % 20] + rng.normal(0, 0.03, 16)], int(i % 3)) for i in range(200)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (2004, [1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()}
    comp = {r[0]: r[0] for r in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    links = defaultdict(int)
    good = [r for r in rows if r[0] < 2000]
    for a in range(len(good)):
        for b in range(a):
            x, y = np.array(good[a][1]), np.array(good[b][1])
            if good[a][2] == good[b][2] and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[good[a][0]] += 1
                links[good[b][0]] += 1
                p, q = sorted((find(good[a][0]), find(good[b][0])))
                comp[q] = p
    assert got == {i: (links[i], find(i), find(i) == i) for i in comp}


@pytest.mark.parametrize("n", [1, 500, 50_000, 10**8])
def test_vector_tables_keep_the_miss_bound(n):
    tables, projections = vector_dedup.table_plan(n, 0.98)
    assert vector_dedup.miss_probability(0.98, tables, projections) <= 1e-4
    assert n * vector_dedup.agreement(0) ** projections <= 0.05


def test_vectors_near_the_threshold_and_of_any_magnitude(spark):
    """Pairs planted just above and below cosine 0.98, and finite vectors whose squares over- or underflow."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for i in range(150):
        a = rng.normal(size=48)
        a /= np.linalg.norm(a)
        b = rng.normal(size=48)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9803 if i % 2 else 0.9797
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (c * a + (1 - c * c) ** 0.5 * b).tolist(), 1)]
        want |= {2 * i: i % 2, 2 * i + 1: i % 2}
    rows += [(900, [1e-200, 2e-200], 2), (901, [1e200, 2e200], 2), (902, [1.0, 2.0], 2), (903, [float("inf"), 1.0], 2), (904, [1.0, None], 2), (None, [1.0, 2.0], 2)]
    want |= {900: 2, 901: 2, 902: 2, 903: 0, 904: 0, None: 0}
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x")))
    assert {r.vec_id: r.n_links for r in got.collect()} == want
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label string")).collect() == []


def test_leaks_exact_and_edited(spark):
    rng = np.random.default_rng(3)
    item = " ".join(f"term{i}" for i in rng.integers(0, 5000, 40))
    w = item.split()
    edited = [x if i % 6 else "other" for i, x in enumerate(w)]
    noise = lambda n: " ".join(f"n{i}" for i in rng.integers(0, 300, n))
    docs = [(1, f"{noise(50)} {item} {noise(30)}"), (2, f"{noise(80)} {' '.join(edited)}"), (3, noise(400)), (4, None), (5, item.upper().replace(" ", ", ")), (6, " ".join(w[:5]) + noise(60))]
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, noise(30))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs_of(spark, docs), benchmark).collect()}
    assert set(found) == {(1, 7), (2, 7), (5, 7)} and found[1, 7] == 1.0
    assert {r.doc_id for r in decontaminate.remove_leaks(docs_of(spark, docs), benchmark).collect()} == {3, 4, 6}
    assert decontaminate.find_leaks(docs_of(spark, []), benchmark).count() == 0


@pytest.mark.parametrize("step", [4, 5])
@pytest.mark.parametrize("exact", [False, True])
def test_leaks_with_many_words_replaced(spark, step, exact):
    """Copies that lost half of the item's n-grams or more, alone or beside an exact copy."""
    w = [f"term{i}" for i in range(40)]
    edited = " ".join([f"n{j}" for j in range(30)] + [x if (j + 1) % step else f"other{j}" for j, x in enumerate(w)])
    docs = [(1, edited), (3, "term1 term2 term3 " * 20)] + [(2, " ".join(w))] * exact
    found = {r.doc_id: r.score for r in decontaminate.find_leaks(docs_of(spark, docs), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")).collect()}
    kept = 40 - 40 // step
    assert set(found) == ({1, 2} if exact else {1}) and found[1] == (2 * kept - (40 // step - 1)) / 80


def test_leaks_of_short_items_and_rows_told_apart(spark):
    """Items of one or two words inside longer texts, a null id, an id that a clean text repeats, a repeated item id."""
    docs = [(1, "x y Alpha, beta z"), (2, "alpha x beta"), (3, "so gamma it is"), (None, "alpha beta"), (None, "clean words"), (5, "alpha beta"), (5, "clean"), (6, "one two three four")]
    benchmark = spark.createDataFrame([(1, "alpha beta"), (2, "Gamma!"), (3, "one two three"), (3, "nothing of it here")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs_of(spark, docs), benchmark).collect()}
    assert found >= {(1, 1), (3, 2), (None, 1), (5, 1), (6, 3)} and all(i != 2 or j == 1 for i, j in found)
    clean = docs_of(spark, docs).withColumn("leaked", F.lit(1)).withColumn("of", F.lit(2))
    kept = decontaminate.remove_leaks(clean, benchmark)
    assert kept.columns == clean.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} >= {(None, "clean words"), (5, "clean")}
    assert not {(r.doc_id, r.text) for r in kept.collect()} & {(None, "alpha beta"), (5, "alpha beta"), (1, "x y Alpha, beta z")}
    assert decontaminate.find_leaks(docs_of(spark, docs), benchmark.limit(0)).collect() == []


def test_alignment_equals_a_plain_table():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = rng.integers(0, 6, 12).astype(np.uint64), rng.integers(0, 6, 20).astype(np.uint64)
        h = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align([a], [b])[0][0] == h.max()


def test_licences(spark):
    mit = license_scan.TEMPLATES["mit-permission"]
    docs = [(1, f"x {mit} y"), (2, "code. released  UNDER the mit license! more"), (3, " ".join(mit.split()[:-8]) + " and so on"), (4, "released under the old license"), (5, None), (6, " ".join(mit.split()[:40]))]
    found = {(r.doc_id, r.license) for r in license_scan.scan(docs_of(spark, docs)).collect()}
    assert found == {(1, "mit-permission"), (2, "mit-line"), (3, "mit-permission")}


def test_url_rules_and_templates(spark):
    urls = [(1, "http://A.Example.ORG/es/x"), (2, "https://example.org/en/12?q#f"), (3, "http://notorg/x"), (4, None), (5, "no scheme"), (6, "x://a.com/fr/"), (7, "x://a.org"), (8, "http://h.net?x=/y")]
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow")]
    pages = spark.createDataFrame(urls + [(100 + i, f"http://bad.net/p/{i}.html") for i in range(20)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, False) for i in range(15)] + [(i, True) for i in range(1, 4)], "page_id long, good boolean")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, labels, rules).collect()}
    assert len(got) == 28
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 9)] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("notorg", "/x", None), ("", "", None), ("", "", None), ("a.com", "/fr/", "com/fr/"), ("a.org", "", None), ("h.net", "", None),
    ]
    assert got[1].verdict == "block" and got[6].verdict == "allow"
    assert got[100].verdict == got[119].verdict == "block" and got[119].template == "/p/*"


def test_url_templates_below_the_third_level(spark):
    """Good and bad sections at the fourth level, ids and names far below, and one path of very many segments."""
    names = ["".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(40)]
    urls = [f"http://h.net/a/b/c/{kind}/{n}" for n in names for kind in ("casino", "docs")]
    urls += [f"http://deep.net/a/b/c/d/e/{i}f/{n}/end" for i, n in enumerate(names)] + ["http://deep.net/" + "/".join(["x"] * 300)]
    labels = [(i, i % 2 == 1) for i in range(60)]
    got = {r.page_id: r for r in url_templates.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good boolean"), []).collect()}
    assert len(got) == len(urls)
    assert {(r.template, r.verdict) for i, r in got.items() if i < 80} == {("/a/b/c/casino/*", "block"), ("/a/b/c/docs/*", "allow")}
    assert {r.template for i, r in got.items() if 80 <= i < 120} == {"/a/b/c/d/e/*/*/end"}
    assert got[120].verdict == "allow"


@pytest.mark.parametrize("crawls", [1, 3])
@pytest.mark.parametrize("pages", [["spam", "about"], ["spam", "about", "photos"]])
def test_url_templates_over_names_whatever_the_copies(spark, crawls, pages):
    """A name in the middle of a path is pooled over, also in repeated crawls, with more pages a name and a hot url."""
    names = ["".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(60)]
    urls = [f"http://h.net/user/{n}/{page}" for n in names for page in pages] * crawls + ["http://h.net/user/hot/about"] * 500 * (crawls > 1)
    labelled = [(i, not u.endswith("spam")) for i, u in enumerate(urls) if u.split("/")[4] in names[:30]]
    rows = url_templates.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(labelled, "page_id long, good boolean"), []).collect()
    assert len(rows) == len(urls)
    assert all((r.verdict == "block") == r.path.endswith("spam") for r in rows)
    assert {r.template for r in rows if r.path.endswith("spam")} == {"/user/*/spam"}


def test_language_id_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    odd = {r.doc_id: r for r in language_id.predict(docs_of(spark, ODD + [(20, "12 + 34"), (21, "123 漢字")]), language_id.train(["the house is", "la maison est"] * 9, ["en", "fr"] * 9)).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[20].lang_pred == "und" and odd[21].lang_pred != "und" and odd[1].score == 0


@pytest.mark.parametrize("long_ones", [False, True])
def test_language_id_learns_from_short_texts(spark, long_ones):
    """Languages whose texts all have under 16 words, alone and beside a language of very long texts."""
    rng = np.random.default_rng(8)
    kinds = {c: [f"{c}{i}{c}" for i in range(80)] for c in ("ka", "lo", "mi")}
    text = lambda c, n: " ".join(rng.choice(kinds[c], n))
    rows = [(text(c, 20_000 if long_ones and c == "ka" else int(rng.integers(2, 12))), c) for c in kinds for _ in range(40)]
    model = language_id.train([t for t, _ in rows], [c for _, c in rows])
    new = [(i, text(c, 5), c) for i, c in enumerate(list(kinds) * 10)]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs_of(spark, [(i, t) for i, t, _ in new]), model).collect()}
    assert got == {i: c for i, _, c in new}


def test_pieces_are_shared_out_by_language():
    sizes, label = np.array([16] * 63 + [4] * 5), np.array([0] * 63 + [1] * 5)
    kept = language_id.shared_out(sizes, label, np.arange(68), 100)
    assert sorted(kept.tolist()) == [0, 1, 2, 3, 4, 63, 64, 65, 66, 67]


def test_pieces_cover_all_words():
    texts = ["", "one", " ".join(f"w{i}" for i in range(40)), "  a b\n", *["x y z"] * 120]
    of, begin, end, n = language_id.all_pieces(texts)
    for i, t in enumerate(texts):
        assert " ".join(t[a:b] for a, b in zip(begin[of == i], end[of == i], strict=True)).split() == t.split()
        assert n[of == i].sum() == len(t.split())


def test_language_id_letters_and_repeated_ids(spark):
    model = language_id.train(["the house is", "la maison est"] * 9, ["en", "fr"] * 9)
    rows = [(i, t) for i, t in enumerate(["\u00b5", "12 \u00aa", "\u00ba", "3 \u00b7 4", "\u2014 7", "\u4e2d"])]
    got = {r.doc_id: r.lang_pred != "und" for r in language_id.predict(docs_of(spark, rows), model).collect()}
    assert got == {i: any(c.isalpha() for c in t) for i, t in rows}
    many = spark.createDataFrame([(1, "the house", "en")] * 500 + [(3, "la maison", "fr")], "doc_id long, text string, lang string")
    texts, languages = language_id.sample(many.filter("crc32(cast(doc_id as string)) % 3 <> 1"), "lang", "doc_id", "text")
    assert len(texts) == len(set(zip(texts, languages, strict=True)))
    none = many.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(none).collect()} == {"und"}
    assert language_id.identify(many.limit(0)).collect() == []


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(6)
    score, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    gamma, _ = language_id.forward_backward(score, moves, np.ones((1, 4), bool))
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(score[0, i, path[i]] for i in range(4)) + sum(moves[path[i], path[i + 1]] for i in range(3)))
        for i in range(4):
            want[i, path[i]] += p
    assert np.allclose(gamma[0], want / want.sum(axis=1, keepdims=True))
    model = language_id.Model(["a", "b", "c"], np.zeros((1, 3)), moves)
    assert np.allclose(language_id.word_probabilities(model, score[0], np.array([0, 4])), want / want.sum(axis=1, keepdims=True))


def test_network_paths_agree_and_gradients_are_right():
    p = {k: v.astype(np.float64) for k, v in toxicity.new_params().items()}
    w = Words(*utf8(pa.array(["a b c d e f g " * 9, "x", "hello wörld you are"])))
    x = toxicity.embed(p, *toxicity.word_inputs(w)).astype(np.float64)
    first, length, _ = toxicity.windows(w.bounds)
    assert np.allclose(toxicity.window_logits(p, x, first, length), toxicity.all_logits(p, x, first, length), atol=1e-4)
    some, size = np.array([0, 40]), np.array([5, 3])
    tape: dict = {}
    toxicity.window_logits(p, x, some, size, tape)
    g, _ = toxicity.gradients(p, x, tape, np.array([1.0, -0.5]))
    loss = lambda: float(toxicity.window_logits(p, x, some, size) @ np.array([1.0, -0.5]))
    for name in ("uf", "wb", "a", "av", "o"):
        at = tuple(0 for _ in p[name].shape)
        keep, step = p[name][at], 1e-3
        p[name][at] = keep + step
        up = loss()
        p[name][at] = keep - step
        down = loss()
        p[name][at] = keep
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-3 + 0.05 * abs(g[name][at])


def test_windows_cover_all_words():
    bounds = np.array([0, 0, 1, 32, 33, 133])
    first, length, text = toxicity.windows(bounds)
    for t in range(5):
        covered = set()
        for a, n in zip(first[text == t], length[text == t], strict=True):
            covered |= set(range(a, a + n))
        assert covered == set(range(bounds[t], bounds[t + 1]))


def test_toxicity_odd_rows(spark):
    params = toxicity.train(["you idiot fool " * 5, "a kind word here " * 5] * 4, [1, 0] * 4)
    rows = toxicity.score_texts(docs_of(spark, ODD), params).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.score for r in rows}[1] == 0
    assert toxicity.train([], []) is None
    kept = toxicity.reject(docs_of(spark, ODD), None)
    assert kept.columns == ["doc_id", "text", "lang", "id", "n_lines"] and kept.count() == len(ODD)
