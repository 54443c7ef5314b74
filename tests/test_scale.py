"""What larger or odd tables ask of the engine: samples without a word, and counts without a row for each pair in a shuffle."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from setloom.functions.digests import PairMarks
from setloom.functions.metrics import rounded
from setloom.operators import grid, overlap, select
from setloom.plans import modes, render, store
from setloom.plans.store import Settings
from setloom.queries import QUERIES
from setloom.sources import dispatch

from .oracle import TABLES

K = 5


def test_a_table_of_words_may_name_a_sample_without_any(spark, tmp_path):
    spark.createDataFrame([("a", 7), ("a", 9), ("b", None), ("c", None), ("c", 9)], "name string, kmer long").write.parquet(f"{tmp_path}/words")
    read = dispatch.read_samples(spark, f"{tmp_path}/words", Settings(K), "words")
    assert {r.name: r.n_kmers for r in read.samples.collect()} == {"a": 2, "b": 0, "c": 1} and read.postings.where("kmer is null").isEmpty()
    spark.createDataFrame([("q", None)], "name string, kmer long").write.parquet(f"{tmp_path}/none")
    one = dispatch.read_samples(spark, f"{tmp_path}/none", Settings(K), "words")
    index = store.save(read, f"{tmp_path}/index")
    assert [(r.common, r.n_row) for r in modes.one2all(one, index).collect()] == [(0, 0)] * 3


def random_postings(spark, draw, samples: int, words: int):
    sets = {i: {draw.randrange(words) for _ in range(draw.randint(0, 12))} for i in range(0, 3 * samples, 3)}
    post = spark.createDataFrame([(i, w) for i, s in sets.items() for w in s], "sample_id long, kmer long")
    return sets, post, spark.createDataFrame([(i, str(i), len(s)) for i, s in sets.items()], "sample_id long, name string, n_kmers long")


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_a_grid_of_blocks_counts_all_pairs(spark, blocks):
    sets, post, samples = random_postings(spark, random.Random(blocks), 70, 60)
    every = {(i, j): (len(sets[i] & sets[j]), len(sets[i]), len(sets[j])) for j, i in combinations(sets, 2)}

    def got(**options):
        rows = grid.counted(post, blocks, **options).collect()
        assert len({(r.row_id, r.col_id) for r in rows}) == len(rows)
        return {(r.row_id, r.col_id): (r.common, r.n_row, r.n_col) for r in rows}

    for strip in (1, 50, 1 << 20):
        assert got(strip=strip) == {p: x for p, x in every.items() if x[0]}
        assert got(strip=strip, samples=samples) == every
    assert got(share=0.2, least=2) == {p: x for p, x in every.items() if x[0] >= 2 and x[0] >= 0.2 * max(x[1:])}
    turned = sorted((-x[0] / (x[1] + x[2] - x[0]), a, b) for (i, j), x in every.items() if x[0] for a, b in ((i, j), (j, i)))
    best = {(i, b) for i in sets for _, a, b in [t for t in turned if t[1] == i][:2]}
    assert {(max(p), min(p)) for p in best} <= got(best=2, strip=50).keys() <= {p for p, x in every.items() if x[0]}
    weighted = {(r.row_id, r.col_id): r.common for r in grid.counted(post.withColumn("w", F.col("kmer") + 1), blocks, weight="w").collect()}
    assert weighted == {(i, j): n for j, i in combinations(sets, 2) if (n := sum(w + 1 for w in sets[i] & sets[j]))}


def test_many_pairs_are_counted_in_a_grid_and_few_are_joined(spark, monkeypatch):
    """The plans agree; of the grid's, no exchange is of pairs."""
    sets, post, samples = random_postings(spark, random.Random(9), 90, 25)
    index = store.Index(samples, post, Settings(K))
    asked = [
        lambda: overlap.all2all(post),
        lambda: overlap.all2all_by_patterns(post),
        lambda: overlap.all2all_dense(post, samples),
        lambda: modes.all2all(index),
        lambda: modes.all2all(index, {"jaccard": 0.4}),
        lambda: modes.all2all(index, {"num-kmers": 2, "min": 0.3}, {"mash": 0.5}),
        lambda: modes.all2all(index, sample_rows=3, by="jaccard"),
        lambda: modes.all2all(index, {"num-kmers": 2}, {"jaccard": 0.5}, sample_rows=2, by="jaccard"),
        lambda: modes.all2all_parts([index, index], {"min": 0.2})[1],
    ]

    def rows(df):
        return sorted(map(tuple, df.select(*[c for c in ("row_id", "col_id", "common", "n_row", "n_col") if c in df.columns]).collect()))

    joined = [rows(f()) for f in asked]
    monkeypatch.setattr(overlap, "GRID_PAIRS", 1)
    monkeypatch.setattr(overlap, "GRID_PREFIX_PAIRS", 1)
    monkeypatch.setattr(overlap, "GRID_SAMPLES", 40)
    assert [rows(f()) for f in asked] == joined and all(joined)
    for f in asked[:6]:
        plan = f()._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange hashpartitioning(row_id" not in plan and "Exchange hashpartitioning(col_id" not in plan


@pytest.mark.parametrize("where", ["triangle", "rectangle"])
def test_zeros_of_dense_tables_are_written_between_the_pairs(spark, where):
    """The same lines as from all cells, which are not made."""
    _, post, samples = random_postings(spark, random.Random(4), 30, 60)
    every = overlap.all2all_dense(post, samples) if where == "triangle" else overlap.new2all_dense(post, samples, post, samples)
    some = every.where("common > 0")
    want, got = ([tuple(r) for r in render.counts_lines(samples, samples, *x).orderBy("at").collect()] for x in ((every, K, 1.0), (some, K, 1.0, False, where)))
    assert got == want and len(want) == 32
    for name in ("jaccard", "ani", "cosine", "num-kmers"):
        a, b = (select.scored(select.with_sizes(x, samples), name, K) for x in (every, some))
        want, got = ([tuple(r) for r in x.orderBy("at").collect()] for x in (render.values_lines(samples, samples, a, K, 1.0), render.values_lines(samples, samples, b, K, 1.0, zeros=where)))
        assert got == want
    plan = render.counts_lines(samples, samples, some.select("row_id", "col_id", "common"), K, 1.0, zeros=where)._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat(0," in plan


@pytest.mark.parametrize("pool", [1, 60, 1 << 20])
def test_random_partners_are_sought_before_pairs_are_shuffled(spark, monkeypatch, pool):
    monkeypatch.setattr(select, "POOL", pool)
    pairs = [(i, j, i + j) for j, i in combinations(range(-3, 60), 2) if (i * j) % 3]
    rows = spark.createDataFrame(pairs, "row_id long, col_id long, common long").repartition(3)
    want = set()
    for s in range(-3, 60):
        near = [(hashlib.md5(f"{s},{o},5".encode()).hexdigest(), o) for i, j, _ in pairs for a, o in ((i, j), (j, i)) if a == s]
        want |= {(s, o, s + o) for _, o in sorted(near)[:2]}
    out = select.random_of_rows(rows, 2, 5)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow") < plan.index("Generate explode")
    turned = select.both_ways(rows).withColumn("_early", F.conv(F.substring(F.md5(F.concat_ws(",", "row_id", "col_id")), 1, 13), 16, 10).cast("long"))
    left = select._may_be_chosen(turned, 2, "_early", 1 << 20).count()
    assert left <= 2 * 63 * turned.rdd.getNumPartitions() < turned.count()


def test_a_grid_shuffles_postings_once_however_many_blocks_there_are(spark):
    """Blocks are packed and read by the cells; no posting is repeated for them before a shuffle."""
    sets, post, _ = random_postings(spark, random.Random(3), 90, 25)
    want = {(i, j, n) for j, i in combinations(sets, 2) if (n := len(sets[i] & sets[j]))}
    for blocks in (3, 12):
        out = grid.counted(post, blocks)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate explode" not in plan
        assert {(r.row_id, r.col_id, r.common) for r in out.collect()} == want


def test_a_grid_is_taken_where_words_are_in_few_samples(spark, monkeypatch):
    """Nine samples a word: four pairs of postings a posting cost more than twelve searches."""
    monkeypatch.setattr(overlap, "GRID_PAIRS", 1)
    post = spark.range(900).select((F.col("id") % 9).alias("sample_id"), (F.col("id") % 100).alias("kmer")).distinct()
    assert overlap.grid_blocks(post) == (grid.LEAST_BLOCKS, 9)
    alone = spark.range(100).select("id", F.col("id").alias("kmer")).toDF("sample_id", "kmer")
    assert overlap.grid_blocks(alone)[0] == 0


def test_lines_are_put_together_of_pieces_of_text(spark):
    """Pairs in order make a piece a row; pairs in any order make the same lines. No exchange is of pairs."""
    draw = random.Random(8)
    met = [(i, j, draw.randint(1, 9)) for i in range(40) for j in range(i) if draw.random() < 0.4]
    samples = spark.createDataFrame([(i, f"s{i}", i) for i in range(40)], "sample_id long, name string, n_kmers long")

    def lines(pairs, **options):
        rows = spark.createDataFrame(pairs, "row_id long, col_id long, common long").coalesce(1) if options.pop("one") else spark.createDataFrame(draw.sample(pairs, len(pairs)), "row_id long, col_id long, common long").repartition(7)
        out = render.counts_lines(samples, samples, rows, K, 1.0, **options)
        assert "Exchange hashpartitioning(row_id" not in out._jdf.queryExecution().executedPlan().toString()
        return {r.at: r.line for r in out.where("at >= 0").collect()}

    by = {(i, j): n for i, j, n in met}
    sparse = {i: f"s{i},{i}," + "".join(f"{j + 1}:{by[i, j]}," for j in range(i) if (i, j) in by) for i in range(40)}
    dense = {i: f"s{i},{i}," + "".join(f"{by.get((i, j), 0)}," for j in range(i)) for i in range(40)}
    square = {i: dense[i] + "0," * (40 - i) for i in range(40)}
    for one in (True, False):
        assert lines(met, one=one, sparse=True) == sparse
        assert lines(met, one=one, zeros="triangle") == dense
        assert lines(met, one=one, zeros="rectangle") == square
    cells = spark.createDataFrame([(i, j, str(n)) for i, j, n in met], "at long, first long, text string").coalesce(1)
    assert render._pieces(cells).count() == len({i for i, _, _ in met})


def test_values_are_rounded_as_decimals_are_and_few_by_decimals(spark):
    """Every value that a quotient of small numbers has, middles, neighbours of middles, and what is no number."""
    draw = random.Random(3)
    middles = [(n + 0.5) / 1e6 for n in draw.sample(range(1_000_000), 3000)]
    near = [math.nextafter(x, to) for x in middles for to in (0, 1)] + [x + d for x in middles[:500] for d in (1e-10, -1e-10, 1e-9, -1e-9)]
    odd = [0.0, -0.0, 1.0, 5e-7, 4.9e-7, 1e-300, 999.9999995, 123456.7890125, 1e9 + 0.0000005, 1e300, math.nan, math.inf, -math.inf, None]
    values = [a / b for b in range(1, 120) for a in range(b + 1)] + middles + near + odd
    rows = spark.createDataFrame([(x,) for x in values + [None if x is None else -x for x in values]], "x double")
    both = rows.select("x", rounded(F.col("x")).alias("ours"), F.round("x", 6).alias("plain"))
    assert both.where("not (ours <=> plain)").collect() == []
    by_decimals = rows.where((F.abs(F.col("x") * 1e6 - F.floor(F.col("x") * 1e6) - 0.5) <= 1e-4)).count()
    assert 0 < by_decimals < 20_000  # the middles and their neighbours; none of the other quotients' many
    plan = QUERIES["metric_cosine"](spark, str(TABLES))._jdf.queryExecution().optimizedPlan().toString()
    assert "ELSE round(" in plan and len(re.findall(r"\bround\(", plan)) == plan.count("ELSE round(")


def test_pairs_in_runs_are_the_same_and_their_values_take_less_room(spark, tmp_path, monkeypatch):
    sets, post, samples = random_postings(spark, random.Random(12), 900, 60)
    monkeypatch.setattr(overlap, "GRID_PAIRS", 1)
    monkeypatch.setattr(overlap, "SEARCHES", 1 << 20)
    monkeypatch.setattr(grid, "LEAST_BLOCKS", 1)  # rows of a cell are long, as those of large tables
    index, seen, room = store.Index(samples, post, Settings(K)), [], []
    for runs in (False, True):
        out = modes.distances(modes.all2all(index, runs=runs), "jaccard", K)
        assert "CartesianProduct" in out._jdf.queryExecution().sparkPlan().toString()
        out.select("row_id", "col_id", rounded(F.col("value")).alias("value")).write.parquet(f"{tmp_path}/{runs}")
        seen.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{runs}").collect())))
        room.append(sum(f.stat().st_size for f in (tmp_path / str(runs)).glob("*.parquet")))
    assert seen[0] == seen[1] and len(seen[0]) == sum(1 for j, i in combinations(sets, 2) if sets[i] & sets[j])
    assert room[1] < 0.9 * room[0]


def test_numbers_too_large_for_one_key_keep_the_order_of_columns():
    i, j, common = np.array([4, 4, 5]), np.array([0, 2, 1]), np.array([7, 1 << 61, 3])
    by_size = np.array([2, 0, 1])
    rank = np.array([1, 2, 0])
    assert [x.tolist() for x in grid.in_runs(i, j, common, by_size, rank)] == [i.tolist(), j.tolist(), common.tolist()]
    got = grid.in_runs(i, j, np.array([3, 3, 3]), by_size, rank)
    assert [x.tolist() for x in got] == [[4, 4, 5], [2, 0, 1], [3, 3, 3]]


@pytest.mark.parametrize("seed", [0, 123456])
def test_marks_of_pairs_are_md5_digests(seed):
    """Texts of all lengths, so that rows and columns end in every word of a block."""
    rows, columns = (np.array(sorted({s * 10**k + d for k in range(19) for s in (1, -1) for d in (-1, 0, 3)} | {x})) for x in (-(1 << 63), (1 << 63) - 1))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(rows)), np.arange(len(columns)), indexing="ij"))
    got = PairMarks(rows, columns, seed).of(i, j)
    for a, b, x, y in zip(rows[i].tolist(), columns[j].tolist(), *got, strict=True):
        for mark, text in ((x, f"{a},{b},{seed}"), (y, f"{b},{a},{seed}")):
            assert mark == (1 << 52) - int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def test_random_partners_leave_the_grid_alone(spark, monkeypatch):
    """Of the pairs that share words, a few for each sample and cell leave the grid; what is chosen of them is what is chosen of all."""
    monkeypatch.setattr(overlap, "GRID_PAIRS", 1)
    monkeypatch.setattr(overlap, "SEARCHES", 1 << 20)
    monkeypatch.setattr(grid, "LEAST_BLOCKS", 2)
    monkeypatch.setattr(grid, "POOL", 1)
    sets, post, samples = random_postings(spark, random.Random(5), 300, 25)
    index = store.Index(samples, post, Settings(K))
    met = {(i, j): n for j, i in combinations(sets, 2) if (n := len(sets[i] & sets[j]))}
    want = set()
    for s in sets:
        near = sorted((hashlib.md5(f"{s},{o},0".encode()).hexdigest(), o) for p in met if s in p for o in p if o != s)
        want |= {(s, o, met[max(s, o), min(s, o)]) for _, o in near[:2]}
    assert {(r.row_id, r.col_id, r.common) for r in modes.all2all(index, sample_rows=2).collect()} == want
    left = overlap.all2all_sized(post, samples, best=2, seed=0).count()
    assert len(want) / 2 <= left <= 2 * 2 * 2 * len(sets) < len(met) / 8


def test_the_best_of_a_cell_are_found_as_pairs_come():
    """Strips of rows, values with many ties: kept are the best for a row or a column, in order of partners, and few more."""
    draw = np.random.default_rng(2)
    values = draw.integers(0, 6, (400, 90)).astype(float)
    pool, grid.POOL = grid.POOL, 1
    try:
        chosen = grid._Chosen(3, 90, False)
        for low in range(0, 400, 20):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(low, low + 20), np.arange(90), indexing="ij"))
            chosen.add([i, j, i * 100 + j], values[i, j], values[i, j])
            assert sum(len(p[0]) for p in chosen.pool) < 4 * 3 * 90 + 20 * 90
    finally:
        grid.POOL = pool
    i, j, common = chosen.pairs()
    assert (common == i * 100 + j).all()
    by_row = {(r, c) for r in range(400) for c in sorted(range(90), key=lambda c: (-values[r, c], c))[:3]}
    by_column = {(r, c) for c in range(90) for r in sorted(range(400), key=lambda r: (-values[r, c], r))[:3]}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == by_row | by_column


@pytest.mark.parametrize("shape", [(4, 3, 20), (1 << 5, 7, 1 << 20), (1 << 11, 1 << 10, 1 << 20)])
def test_pairs_by_words_are_all_pairs_once(monkeypatch, shape):
    for name, n in zip(("TILE_COLUMNS", "TILE_ROWS", "TILE"), shape, strict=True):
        monkeypatch.setattr(grid, name, n)
    draw = random.Random(6)

    def side(n, words, weighted):
        sets = {i: draw.sample(range(words), draw.randint(0, 9)) for i in range(n)}
        rows = sorted((w, i) for i, s in sets.items() for w in s)
        weight = np.array([w % 5 + 1 for w, _ in rows]) if weighted else None
        return sets, grid._Side(np.arange(n), np.array([i for _, i in rows], np.int32), np.array([w for w, _ in rows]), weight)

    for weighted in (False, True):
        (xs, x), (ys, y) = side(70, 40, weighted), side(50, 60, weighted)
        for a, b, u, v, same in ((xs, ys, x, y, False), (ys, xs, y, x, False), (xs, xs, x, x, True)):
            want = {(i, j): n for i in a for j in b if (not same or j < i) and (n := sum(w % 5 + 1 if weighted else 1 for w in set(a[i]) & set(b[j])))}
            got = [p for c in grid._by_words(u, v, same) for p in zip(*(z.tolist() for z in c), strict=True)]
            assert len(got) == len(want) and {(i, j): n for i, j, n in got} == want
    none = grid._Side(np.arange(2), np.zeros(0, np.int32), np.zeros(0, np.int64), None)
    assert not list(grid._by_words(none, y, False)) and not list(grid._by_words(y, none, False))


def test_pairs_of_all_against_all_are_written_in_little_room(spark, tmp_path, monkeypatch):
    """Samples of a few common passages and some words of their own: most pairs share a passage."""
    monkeypatch.setattr(overlap, "GRID_PAIRS", 1)
    monkeypatch.setattr(overlap, "SEARCHES", 1 << 20)
    monkeypatch.setattr(grid, "LEAST_BLOCKS", 2)
    draw = random.Random(1)
    rows = [(i, 10 * p + w) for i in range(1500) for p in draw.sample(range(40), 3) for w in range(8)] + [(i, 1000 + draw.randrange(3000)) for i in range(1500) for _ in range(4)]
    post = spark.createDataFrame(sorted(set(rows)), "sample_id long, kmer long").cache()
    room, seen = {}, {}
    for name, plan in (("columns", lambda: overlap.all2all(post)), ("all2all", lambda: overlap.all2all(post, runs=True)), ("patterns", lambda: overlap.all2all_by_patterns(post, runs=True))):
        plan().write.parquet(f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = back.select(F.count(F.lit(1)), F.sum(F.xxhash64("row_id", "col_id", "common").cast("decimal(38,0)"))).first()
        room[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert seen["columns"] == seen["all2all"] == seen["patterns"] and seen["columns"][0] > 200_000
    assert max(room["all2all"], room["patterns"]) < 0.6 * room["columns"], room
    for name in ("all2all_sparse", "all2all_pattern_plan"):
        monkeypatch.setattr(overlap, "GRID_PAIRS", 1)
        asked = []
        monkeypatch.setattr(grid, "counted", lambda *a, f=grid.counted, **k: asked.append(k) or f(*a, **k))
        QUERIES[name](spark, str(TABLES))
        assert asked and asked[-1]["runs"]


@pytest.mark.parametrize("name", ["all2all_file", "all2all_parts_file", "all2all_sparse_file"])
def test_tables_that_are_written_and_read_back_are_compressed(spark, name):
    out = QUERIES[name](spark, str(TABLES))
    assert all(f.endswith(".gz") for f in out.inputFiles()) and out.count() > 2
