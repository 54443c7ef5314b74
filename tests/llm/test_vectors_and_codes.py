"""Whitening, vector codes and directly addressable codes against plain versions in Python's integers."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from setloom.llm import direct_codes, vector_codes, vectors, whitening
from setloom.llm.queries import QUERIES
from tests.oracle import TABLES

VECTORS = "vec_id long, embedding array<float>, label int, n string, component string, code string, rows string"
PATH = public_tokenizers.path("word_bpe_49k.json")
needs_tables = pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")


def table(spark, rows, kind="float"):
    """Vectors with columns whose names clash with the operators' own."""
    schema = VECTORS.replace("float", kind)
    return spark.createDataFrame([(i, v, label, "x", "y", "z", "r") for i, v, label in rows], schema).repartition(5)


def odd_vectors(size: int, n: int = 300, seed: int = 3):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(0.1 * j, 1 / (j + 1)) for j in range(size)], draw.choice([1, 1, 1, 2, None])) for i in range(n)]
    rows += [(7, rows[7][1], 1), (7, rows[8][1], None), (None, rows[9][1], 2)]
    bad = [None, [], [None] * size, [0.5] * (size - 1) + [None], [float("nan")] * size, [0.0] * (size - 1) + [float("-inf")]]
    return rows, rows + [(10_000 + k, v, 1) for k, v in enumerate(bad)]


def as_single(v: float) -> float:
    return float(np.float32(v))


# ---- whitening ------------------------------------------------------------------------------------------------------


def plain_scatter(rows: list[list[int]]) -> list[list[int]]:
    n, size = len(rows), len(rows[0])
    s = [sum(x[j] for x in rows) for j in range(size)]
    return [[n * sum(x[i] * x[j] for x in rows) - s[i] * s[j] for j in range(size)] for i in range(size)]


def check_whitening(got, kept):
    """Every contract field, from all integers; ``kept`` has (vec_id, entries)."""
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, size = len(xs), len(xs[0])
    s = [sum(x[j] for x in xs) for j in range(size)]
    v = np.array([[c / n**2 for c in row] for row in plain_scatter(xs)], float)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(32, size)
    assert len(got) == n * k and {r.n for r in got} == {n}
    want = defaultdict(list)
    for (i, _), x in zip(kept, xs, strict=True):
        d = [n * a - b for a, b in zip(x, s, strict=True)]
        want[i].append((sum(a * a for a in d), (np.array(d, float) / n) @ q[:, :k] / np.sqrt(e[:k])))
    by_row = defaultdict(lambda: defaultdict(list))
    for r in got:
        by_row[r.vec_id][r.component].append(r)
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    assert set(by_row) == set(want)
    signs = np.zeros(k)
    for i, w in want.items():
        for c in range(k):
            rows = by_row[i][c + 1]
            assert sorted(r.deviation for r in rows) == sorted(x for x, _ in w)
            if len(w) == 1:
                signs[c] = signs[c] or np.sign(w[0][1][c] * rows[0].whitened)
                assert abs(w[0][1][c] * signs[c] - rows[0].whitened) < 1e-8
    # rows of one id are told apart by their deviations; those of one deviation are equal
    each = [[[r.whitened for r in sorted(by_row[i][c + 1], key=lambda r: r.deviation)] for c in range(k)] for i in want]
    whole = np.hstack([np.array(x) for x in each]).T
    assert np.abs(np.cov(whole.T, bias=True) - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize("size", [1, 3, 40])
def test_whitening(spark, size):
    kept, rows = odd_vectors(size)
    got = whitening.whiten(table(spark, rows)).collect()
    check_whitening(got, [(i, [as_single(x) for x in v]) for i, v, _ in kept])


def test_whitening_query_over_its_table(spark):
    if not TABLES.exists():
        pytest.skip("needs the driver's tables")
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()
    check_whitening(QUERIES["op11_whitening"](spark, str(TABLES)).collect(), [(r.vec_id, r.embedding) for r in rows])


def test_whitening_far_from_zero_and_with_entries_beyond_floats(spark):
    """A common offset that would drown in floats, then entries whose products have more than 64 bits."""
    draw = random.Random(1)
    offset = [(i, [1e9 + draw.random(), -3e8 + draw.random()], None) for i in range(200)]
    check_whitening(whitening.whiten(table(spark, offset, "double")).collect(), [(i, v) for i, v, _ in offset])
    huge = [(i, [draw.gauss(0, 1e17), draw.gauss(0, 1e16), draw.gauss(0, 1e17)], None) for i in range(60)]
    got = whitening.whiten(table(spark, huge, "double")).collect()
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in huge]  # a product with a power of two is exact
    s = [sum(x[j] for x in xs) for j in range(3)]
    want = {i: sum((60 * a - b) ** 2 for a, b in zip(x, s, strict=True)) for (i, _, _), x in zip(huge, xs, strict=True)}
    assert len(got) == 180 and all(r.deviation is None and int(r.deviation_exact) == want[r.vec_id] and r.identity_error < 1e-9 for r in got)


def test_whitening_leaves_out_components_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0, float(i % 3)], None) for i in range(50)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], None)])).collect() == []
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0], None) for i in range(9)])).collect() == []


def test_products_are_exact_whatever_their_size():
    draw = np.random.default_rng(2)
    for bits in (3, 19, 20, 21, 40, 62):
        y = draw.integers(-(1 << bits), 1 << bits, (500, 5))
        assert (whitening.products(y) == y.astype(object).T.dot(y.astype(object))).all()
    for value in (0, 1, -1, 2**32, -(2**32), 2**63, -(2**100) + 5, 3**90):
        assert sum(d << (32 * k) for k, d in enumerate(whitening.digits(value))) == value


def test_vectors_of_different_lengths_are_an_error(spark):
    rows = [(1, [1.0, 2.0], None), (2, [1.0, 2.0, 3.0], None)] * 3
    with pytest.raises(Exception, match="as many each"):
        whitening.whiten(table(spark, rows)).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(table(spark, rows), 2, 4).collect()


def test_floors_of_any_size():
    values = np.array([0.0, -0.1, 1.999, 2.0**52 + 0.5, -(2.0**60), 1e300, 5e-324, -5e-324])
    assert vectors.floors(values, 256).tolist() == [math.floor(int(x) * 256 if abs(x) > 2.0**53 else x * 256) for x in values.tolist()]


@pytest.mark.parametrize("name", ["op11_whitening", "op13_vector_codes"])
def test_empty_embeddings(spark, tmp_path, name):
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    spark.createDataFrame([(1, None), (2, [None]), (3, [])], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert QUERIES[name](spark, f"{tmp_path}/a").collect() == QUERIES[name](spark, f"{tmp_path}/b").collect() == []


# ---- vector codes ---------------------------------------------------------------------------------------------------


def plain_codes(kept, parts=16, size=64, rounds=2):
    """(code, error) of each vector, and the books, by loops over Python's integers."""
    xs = [[math.floor(256 * int(c)) if abs(c) > 2**53 else math.floor(256 * c) for c in v] for _, v, _ in kept]
    length = len(xs[0]) // parts
    first = sorted(range(len(xs)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:size]
    books = [[xs[k][p * length : (p + 1) * length] for k in first] for p in range(parts)]

    def nearest(p, x):
        part = x[p * length : (p + 1) * length]
        gaps = [sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)) for entry in books[p]]
        return gaps.index(min(gaps)), min(gaps), part

    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for x in xs:
                index, _, part = nearest(p, x)
                met[index].append(part)
            for index, of in met.items():
                books[p][index] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    out = []
    for x in xs:
        found = [nearest(p, x) for p in range(parts)]
        out.append(("".join(f"{i:02x}" for i, _, _ in found), sum(e for _, e, _ in found)))
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return out, hashlib.sha256(text.encode()).hexdigest()


def check_codes(got, kept, **options):
    out, sha = plain_codes(kept, **options)
    sums = Counter()
    for (_, _, label), (_, error) in zip(kept, out, strict=True):
        sums[label] += error
    want = Counter((i, code, error, sums[label], sha) for (i, _, label), (code, error) in zip(kept, out, strict=True))
    assert Counter(map(tuple, got)) == want


def test_vector_codes(spark):
    kept, rows = odd_vectors(32, 150)
    got = vector_codes.compress(table(spark, rows)).collect()
    check_codes(got, [(i, [as_single(x) for x in v], label) for i, v, label in kept])


@needs_tables
def test_vector_codes_query_over_its_table(spark):
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()
    check_codes(QUERIES["op13_vector_codes"](spark, str(TABLES)).collect(), [(r.vec_id, r.embedding, r.label) for r in rows])


def test_vector_codes_with_ties_few_vectors_and_a_hot_one(spark):
    few = [(5, [1.0, 1.0], None), (3, [1.0, 3.0], 1), (4, [1.0, 1.0], 1)]
    check_codes(vector_codes.compress(table(spark, few), 2, 64).collect(), few, parts=2)
    hot = [(i, [0.5, -0.5, 0.25, 1.0] if i % 2 else [i / 7, -i / 3, float(i % 5), 0.0], 1 if i % 3 else i) for i in range(600)]
    kept = [(i, [as_single(x) for x in v], label) for i, v, label in hot]
    check_codes(vector_codes.compress(table(spark, hot), 2, 8, 3).collect(), kept, parts=2, size=8, rounds=3)


def test_vector_codes_beyond_64_bits(spark):
    """Distances and sums that 64 bits don't hold are made from Python's integers; an error beyond them is null."""
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1e15), draw.gauss(0, 1e15)], 1) for i in range(40)]
    out, sha = plain_codes(rows, 2, 4)
    got = vector_codes.compress(table(spark, rows, "double"), 2, 4).collect()
    assert {r.codebooks_sha256 for r in got} == {sha}
    assert {(r.vec_id, r.code, r.error) for r in got} == {(i, code, e if e < 1 << 63 else None) for (i, _, _), (code, e) in zip(rows, out, strict=True)}
    assert all(r.label_error is None for r in got)


# ---- directly addressable codes -------------------------------------------------------------------------------------


def odd_texts():
    draw = random.Random(9)
    words = ["the", "of", "Über", "naïve", "don't", "x1", "日本語", "🙂", "İx", "<|endoftext|>", "<|startoftext|>the", " ", "é", "ﬁn", "1234", "&amp;", "Σας", "\x00", "…!!", "a\x1cb", "\x1f", "q\x85r", "s\xa0t", "u\u1680v", "e\u0301t", "\u0301", "ÀÉ,Öx", "it'S", "a\u2028b", "x\u0345y"] + [f"w{i}" for i in range(99)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(1, 80)))) for i in range(80)]
    return rows + [(200, None), (201, ""), (202, " \n\t"), (203, "word " * 300_000), (5, "again five"), (5, "again five"), (-7, "first"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('codes')}/x"
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in odd_texts()], "doc_id long, text string, tie string, ids string").repartition(6)
    kept, direct_codes.FILE_IDS = direct_codes.FILE_IDS, 2_000
    try:
        files = direct_codes.write(docs, PATH, folder).orderBy("part", "place").collect()
    finally:
        direct_codes.FILE_IDS = kept
    rows = direct_codes.read_documents(spark, folder, docs.schema["doc_id"]).orderBy("start").collect()
    return folder, files, rows


def test_direct_codes(written):
    _, files, rows = written
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in odd_texts():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.doc_id for r in rows] == sorted((i for i, _ in odd_texts()), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    assert len(files) > 3 and [f.start for f in files] == [0, *np.cumsum([f.ids for f in files])[:-1]]


def test_any_token_is_reached_alone(spark, written):
    folder, files, rows = written
    library, by_id = Tokenizer.from_file(PATH), {i: t for i, t in odd_texts() if i not in (None, 5)}
    known = {}
    for r in rows:
        if r.doc_id in by_id:
            ids = [*library.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids, 1]
            known |= {r.start + k: x for k, x in enumerate(ids) if k < 50 or k % 9973 == 0}
    end = files[-1].start + files[-1].ids
    asked = [(p,) for p in [*known, *known, -1, end, end + 10**12, None]]
    got = direct_codes.tokens_at(spark, folder, spark.createDataFrame(asked, "position long")).collect()
    assert {r.position: r.id for r in got} == known | {-1: None, end: None, end + 10**12: None} and len(got) == len(known) + 3


def test_code_files_of_any_widths():
    draw = random.Random(6)
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["doc_id", "end"])
    for most in (0, 1, 255, 256, 5000, 49407, 2**31, 2**32 - 1):
        ids = np.array([min(most, int(draw.expovariate(1) * most / 20)) for _ in range(3000)], np.uint32)
        data, read = direct_codes.file_bytes(ids, none), []

        def read_at(size, at, data=data, read=read):
            read.append(size)
            return data[at : at + size]

        codes = direct_codes.CodeFile(read_at, len(data))
        assert (codes.ids(0, 3000) == ids).all() and (codes.ids(511, 1025) == ids[511:1025]).all() and not len(codes.ids(7, 7))
        read.clear()
        assert codes.at(2999) == ids[2999] and sum(read) <= len(codes.levels) * (16 + 1 + 8 + 64)  # no block is decoded
        with pytest.raises(IndexError):
            codes.at(3000)
    assert direct_codes.CodeFile(lambda n, at, d=direct_codes.file_bytes(ids[:0], none): d[at : at + n], 0).n == 0


def test_best_widths_are_the_cheapest():
    lengths = np.array([0, 5, 0, 0, 900, 3, 2, 0, 40, 7])

    def cost(widths):
        done, total = 0, 0.0
        for k, w in enumerate(widths):
            total += lengths[done + 1 :].sum() * (w + (1.125 if k + 1 < len(widths) else 0))
            done += w
        return total

    def ways(left):
        yield from [[left], *([w, *rest] for w in range(1, left) for rest in ways(left - w))]

    assert abs(cost(direct_codes.best_widths(lengths)) - min(map(cost, ways(9)))) < 1e-9


def test_a_dictionary_may_be_cleared(monkeypatch):
    monkeypatch.setattr(direct_codes, "DICTIONARY", 10)
    encode, library = direct_codes.Encoder(PATH), Tokenizer.from_file(PATH)
    for _, t in odd_texts()[:40]:
        ids, counts = encode([t, "", t])
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids * 2 and counts.tolist() == [len(ids) // 2, 0, len(ids) // 2]


@needs_tables
def test_direct_codes_query_over_its_table(spark):
    library, at = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_direct_codes"](spark, str(TABLES)).collect()}
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_letters_for_bytes_are_those_of_the_library_and_new_strings_are_told_by_place():
    strings = ["a", "", " b\n", "é\x00ÿ", *(f"x{chr(c)}" for c in [*range(1, 0x800), *range(0x800, 0xD800, 97), *range(0xE000, 0x110000, 997)])]
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    assert direct_codes.byte_letters(strings) == ["".join(x for x, _ in library.pre_tokenize_str(s)) for s in strings]
    words = direct_codes._Dictionary()
    for strings, new in ((["b", "a", "b"], ["b", "a"]), (["a"], []), (["c", "a", "d"], ["c", "d"])):
        words.places(strings)
        assert words.new() == new
        words.add(np.arange(len(new), dtype=np.uint32), np.ones(len(new), np.int64))
