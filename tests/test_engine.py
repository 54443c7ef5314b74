"""The engine on small sequences, against sets in plain Python."""

from __future__ import annotations

import ast
import gzip
import math
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from setloom.functions import hashing
from setloom.functions.alphabet import alphabet
from setloom.functions.metrics import measure
from setloom.operators import extract, overlap, select
from setloom.plans import files, modes, render, store
from setloom.plans.store import Settings
from setloom.sources import counts_table, dispatch, fasta, sketches
from setloom.streaming.extend import add_batch, extend_from_stream

K = 5
PACKAGE = Path(__file__).parent.parent / "setloom"


def words_of(seq: str, k: int) -> set[str]:
    seq = seq.upper().replace("U", "T")
    out = set()
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if set(w) <= set("ACGT"):
            out.add(min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return out


@pytest.fixture(scope="module")
def sequences() -> list[tuple[int, str]]:
    draw = random.Random(3)
    texts = ["".join(draw.choice("ACGTacgtUN") for _ in range(draw.randint(0, 150))) for _ in range(12)]
    texts += [texts[4], "ACG", "NNNNNN", "", texts[5][:60] + texts[6][:60]]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def index(spark, sequences):
    samples = spark.createDataFrame([(i, f"s{i}") for i, _ in sequences], "sample_id long, name string")
    return store.build(samples, spark.createDataFrame(sequences, "sample_id long, seq string"), Settings(K))


def expected(sequences) -> dict[tuple[int, int], int]:
    sets = {i: words_of(s, K) for i, s in sequences}
    return {(i, j): n for j, i in combinations(sets, 2) if (n := len(sets[i] & sets[j]))}


def as_pairs(df) -> dict[tuple[int, int], int]:
    return {(r.row_id, r.col_id): r.common for r in df.collect()}


def test_sizes_keep_empty_samples(index, sequences):
    assert {r.sample_id: r.n_kmers for r in index.samples.collect()} == {i: len(words_of(s, K)) for i, s in sequences}


def test_pairs_by_every_plan(index, sequences):
    want = expected(sequences)
    assert as_pairs(modes.all2all(index)) == want
    assert as_pairs(overlap.all2all_by_patterns(index.postings)) == want
    dense = as_pairs(overlap.all2all_dense(index.postings, index.samples))
    assert len(dense) == len(sequences) * (len(sequences) - 1) // 2 and {k: v for k, v in dense.items() if v} == want


def test_new_against_index_is_symmetric_with_sizes_on_the_diagonal(index, sequences):
    found = as_pairs(modes.new2all(index, index))
    assert {k: v for k, v in found.items() if k[1] < k[0]} == expected(sequences)
    assert {i: v for (i, j), v in found.items() if i == j} == {i: n for i, s in sequences if (n := len(words_of(s, K)))}


def test_parts_and_extension_equal_one_index(spark, index, sequences):
    def some(a, b, shift):
        rows = [(i - shift, s) for i, s in sequences[a:b]]
        return spark.createDataFrame([(i, f"s{i + shift}") for i, _ in rows], "sample_id long, name string"), spark.createDataFrame(rows, "sample_id long, seq string")

    first, second = some(0, 8, 0), some(8, None, 8)
    parts = [store.build(*x, Settings(K)) for x in (first, second)]
    assert as_pairs(modes.all2all_parts(parts)[1]) == expected(sequences)
    assert as_pairs(modes.all2all(store.extended(parts[0], *second))) == expected(sequences)
    with pytest.raises(ValueError, match="differ"):
        modes.all2all_parts([parts[0], store.build(*second, Settings(K + 1))])


def test_store_round_trip_and_stored_extension(spark, index, sequences, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = sequences[:10]
    store.save(store.build(spark.createDataFrame([(i, f"s{i}") for i, _ in rows], "sample_id long, name string"), spark.createDataFrame(rows, "sample_id long, seq string"), Settings(K)), path)
    later = [(i - 10, s) for i, s in sequences[10:]]
    store.extend(spark, path, spark.createDataFrame([(i, f"s{i + 10}") for i, _ in later], "sample_id long, name string"), spark.createDataFrame(later, "sample_id long, seq string"))
    again = store.load(spark, path)
    assert again.settings == Settings(K) and as_pairs(modes.all2all(again)) == expected(sequences)
    assert again.stats().first().n_samples == len(sequences)


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(kmer" in line]


def test_questions_read_a_stored_index_as_it_lies(spark, sequences, tmp_path):
    """No exchange by word of the index's side, in one part or several: only that of the query's words."""
    path = f"file://{tmp_path}/index"
    some = [(spark.createDataFrame([(k, f"s{i}") for k, (i, _) in enumerate(x)], "sample_id long, name string"), spark.createDataFrame([(k, s) for k, (_, s) in enumerate(x)], "sample_id long, seq string")) for x in (sequences[:8], sequences[8:])]
    store.build_stored(spark, path, *some[0], Settings(K), buckets=6)
    index = store.extend(spark, path, *some[1])
    query = store.build(*some[0], Settings(K))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(exchanges(overlap.all2all(index.postings, most=index.most))) == 0
        asked = overlap.new2all(query.postings, index.postings, most=1)
        assert len(exchanges(asked)) == 1
        one = store.build(some[0][0].where("sample_id = 4"), some[0][1].where("sample_id = 4"), Settings(K))
        assert len(exchanges(modes.one2all(one, index))) <= 1
        assert as_pairs(asked) == {(i, j): n for i, a in sequences[:8] for j, b in sequences if (n := len(words_of(a, K) & words_of(b, K)))}
        assert as_pairs(modes.all2all(index)) == expected(sequences)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_are_compacted_and_versions_stay(spark, sequences, tmp_path):
    path, schema = f"file://{tmp_path}/index", ("sample_id long, name string", "sample_id long, seq string")
    store.create(spark, path, Settings(K), buckets=3)
    counts = []
    for n, (i, s) in enumerate(sequences):
        store.extend(spark, path, spark.createDataFrame([(0, f"s{i}")], schema[0]), spark.createDataFrame([(0, s)], schema[1]), ("in", n))
        counts.append(len(store.compact(spark, path, fan=3).parts))
    assert max(counts) <= 3 and counts[-1] < len(sequences)
    now = store.load(spark, path)
    assert as_pairs(modes.all2all(now)) == expected(sequences)
    assert {(r.sample_id, r.name) for r in now.samples.collect()} == {(i, f"s{i}") for i, _ in sequences}
    before = next(n for n in store.versions(spark, path) if len(store.version(spark, path, n).parts) == 2)
    assert store.load(spark, path, before).samples.count() == sum(p.ids for p in store.version(spark, path, before).parts)
    gone = store.vacuum(spark, path, older_than=0)
    assert gone and len(store.versions(spark, path)) == 1 and as_pairs(modes.all2all(store.load(spark, path))) == expected(sequences)
    assert store.vacuum(spark, path, older_than=0) == []


def test_writers_at_once_lose_nothing(spark, sequences, tmp_path):
    """Eight writers, two of which bring one batch: each sample is there once, with ids that don't meet."""
    path, schema = f"file://{tmp_path}/index", ("sample_id long, name string", "sample_id long, seq string")
    store.create(spark, path, Settings(K), buckets=2)

    def add(k: int):
        i, s = sequences[k]
        store.extend(spark, path, spark.createDataFrame([(0, f"s{i}"), (1, f"t{i}")], schema[0]), spark.createDataFrame([(0, s)], schema[1]), (f"w{k}", 0))
        return store.compact(spark, path, fan=3)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, [0, 1, 2, 3, 4, 5, 6, 6]))
    now = store.load(spark, path)
    rows = now.samples.collect()
    assert sorted(r.name for r in rows) == sorted(f"{x}{sequences[k][0]}" for k in range(7) for x in "st") and len({r.sample_id for r in rows}) == 14
    assert {r.name: r.n_kmers for r in rows if r.name[0] == "s"} == {f"s{i}": len(words_of(s, K)) for i, s in sequences[:7]}
    with pytest.raises(FileExistsError):
        store.create(spark, path, Settings(K))


@pytest.mark.parametrize(
    ("c", "a", "b", "values"),
    [
        (36, 80, 80, {"jaccard": 0.290323, "min": 0.45, "max": 0.45, "cosine": 0.45, "mash": 0.038024, "ani": 0.961976, "ani-shorter": 0.977289, "mash-query": 0.022711}),
        (34, 39, 80, {"jaccard": 0.4, "min": 0.871795, "max": 0.425, "cosine": 0.608698, "mash": 0.026648, "ani": 0.973352, "ani-shorter": 0.996621, "mash-query": 0.003379}),
        (0, 80, 31, {"jaccard": 0, "min": 0, "mash": 1, "ani": 0, "mash-query": 1, "num-kmers": 0}),
        (80, 80, 80, {"jaccard": 1, "mash": 0, "ani": 1}),
    ],
)
def test_measures(spark, c, a, b, values):
    row = spark.range(1).select(*[measure(n, F.lit(c), F.lit(a), F.lit(b), 21).cast("double").alias(n) for n in values]).first().asDict()
    assert {n: round(v, 6) for n, v in row.items()} == values
    assert not any(v == 0 and math.copysign(1, v) < 0 for v in row.values())


def test_sketch_hash(spark):
    known = {"A" * 25: 7335449654948834464, "ACGTTGCAACGTTGCAACGTTGCAA": 16561550355414963846, "GATTACAGATTACAGATTACAGATT": 15763774006563833000}
    post = extract.postings(spark.createDataFrame([(i, w) for i, w in enumerate(known)], "sample_id long, seq string"), 25, alphabet())
    found = hashing.with_hash(post, "kmer", 25, 2).orderBy("sample_id").collect()
    assert [r.hash & ((1 << 64) - 1) for r in found] == list(known.values())


def test_sketches_of_disjoint_ranges_make_up_the_whole(spark, sequences):
    seqs, letters = spark.createDataFrame(sequences, "sample_id long, seq string"), alphabet()
    whole = {tuple(r) for r in extract.postings(seqs, K, letters).collect()}
    low, high = ({tuple(r) for r in extract.postings(seqs, K, letters, 0.5, start).collect()} for start in (0.0, 0.5))
    assert low | high == whole and not low & high and low and high


def test_bounds_and_best_partners(index, sequences):
    sizes = {i: len(words_of(s, K)) for i, s in sequences}
    want = {k: c for k, c in expected(sequences).items() if 0.05 <= c / (sizes[k[0]] + sizes[k[1]] - c) <= 0.9}
    assert as_pairs(modes.all2all(index, {"jaccard": 0.05}, {"jaccard": 0.9})) == want
    best = modes.all2all(index, sample_rows=1, by="num-kmers").collect()
    both = {**expected(sequences), **{(j, i): c for (i, j), c in expected(sequences).items()}}
    for r in best:
        assert (-r.common, r.col_id) == min((-c, j) for (i, j), c in both.items() if i == r.row_id)
    assert not modes.all2all(index, {"num-kmers": 50}, {"num-kmers": 10}).collect()
    assert select.parse_bounds(["jaccard:0.1", "20", "jaccard:0.2"]) == {"jaccard": 0.2, "num-kmers": 20}


@pytest.mark.parametrize("sparse", [False, True])
def test_table_of_counts_round_trip(spark, index, sequences, tmp_path, sparse):
    pairs = modes.all2all(index) if sparse else overlap.all2all_dense(index.postings, index.samples)
    render.write_lines(render.counts_lines(index.samples, index.samples, pairs, K, 1.0, sparse), f"file://{tmp_path}/t")
    back = counts_table.read_counts_table(spark, f"file://{tmp_path}/t")
    assert (back.k, back.fraction, back.sparse) == (K, 1.0, sparse) and back.triangular
    assert as_pairs(back.pairs) == expected(sequences)
    assert [(r.name, r.n_kmers) for r in back.rows.orderBy("sample_id").collect()] == [(r.name, r.n_kmers) for r in index.samples.orderBy("sample_id").collect()]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("no record\nACGTACGT\n>one first\nACGT\nACG\r\n>two\nTTTTT\n>one again\n\n")
    (tmp_path / "b.fa").write_text(">three\nGGG\n")
    paths = [f"{tmp_path}/a", f"{tmp_path}/b.fa"]
    samples, seqs = fasta.read_fasta(spark, paths, multisample=True)
    assert [(r.sample_id, r.name) for r in samples.orderBy("sample_id").collect()] == [(0, "one"), (1, "two"), (2, "one"), (3, "three")]
    assert [(r.sample_id, r.seq) for r in seqs.orderBy("sample_id").collect()] == [(0, "ACGTACG"), (1, "TTTTT"), (2, ""), (3, "GGG")]
    samples, seqs = fasta.read_fasta(spark, paths)
    assert [r.sample_id for r in samples.collect()] == [0, 1] and seqs.where("sample_id = 0").count() == 3
    with pytest.raises(FileNotFoundError):
        fasta.resolve(spark, [f"{tmp_path}/none"])


def test_sketch_files(spark, tmp_path):
    for name, words in (("x", [5, 3, 9]), ("y", [])):
        (tmp_path / f"{name}.minhash").write_bytes(sketches.sketch_bytes(words, 11, 0.25))
    samples, post, config = sketches.read_sketches(spark, [f"{tmp_path}/x", f"{tmp_path}/y"])
    assert config == {"k": 11, "fraction": 0.25} and sorted(tuple(r) for r in post.collect()) == [(0, 3), (0, 5), (0, 9)]
    assert sorted(r.name for r in samples.collect()) == ["x", "y"]


def test_stream_extends_an_index(spark, index, sequences, tmp_path):
    path, source = f"file://{tmp_path}/index", f"{tmp_path}/in"
    empty = spark.createDataFrame([], "sample_id long, name string"), spark.createDataFrame([], "sample_id long, seq string")
    store.save(store.build(*empty, Settings(K)), path)
    spark.createDataFrame([(f"s{i:02}", s) for i, s in sequences], "name string, seq string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("name string, seq string").parquet(source)
    extend_from_stream(stream, path, f"file://{tmp_path}/checkpoint").awaitTermination()
    grown = store.load(spark, path)
    number = {r.sample_id: int(r.name[1:]) for r in grown.samples.collect()}
    assert {tuple(sorted((number[i], number[j]), reverse=True)): c for (i, j), c in as_pairs(modes.all2all(grown)).items()} == expected(sequences)


def merged_words(spark, path, number=None):
    """The words of each name in a stored index, and its sizes by name."""
    index = store.load(spark, path, number)
    named = index.postings.join(index.samples, "sample_id").select("name", "kmer").collect()
    assert len(named) == len(set(named))
    words = {}
    for r in named:
        words.setdefault(r.name, set()).add(r.kmer)
    sizes = [(r.name, r.n_kmers) for r in index.samples.collect()]
    assert len(sizes) == len(dict(sizes)) and all(n == len(words.get(name, ())) for name, n in sizes)
    return words, dict(sizes)


def test_merge_adds_words_to_samples_of_the_same_name(spark, sequences, tmp_path):
    """Samples that come in pieces equal samples that come at once: repeats, empty ones, new names, a null name, after compaction."""
    path, whole = f"file://{tmp_path}/pieces", f"file://{tmp_path}/whole"
    rows = [(None if i % 5 == 4 else f"s{i % 5}", seq) for i, seq in sequences]
    frame = [spark.createDataFrame(part, "name string, seq string") for part in (rows[:6], rows[6:], rows[3:9], [("late", "ACGTTACA"), ("s0", None)])]
    store.create(spark, path, Settings(K))
    for n, part in enumerate(frame):
        store.merge(spark, path, part, ("a", n))
        store.merge(spark, path, part, ("a", n))  # a batch that is run again
    store.create(spark, whole, Settings(K))
    store.merge(spark, whole, frame[0].unionAll(frame[1]).unionAll(frame[3]))
    words, sizes = merged_words(spark, path)
    assert (words, sizes) == merged_words(spark, whole) and set(sizes) == {"s0", "s1", "s2", "s3", None, "late"}
    assert store.version(spark, path).next_id == 6
    before = as_pairs(modes.all2all(store.load(spark, path)))
    store.compact(spark, path, 2)
    assert len(store.version(spark, path).parts) == 1 and merged_words(spark, path) == (words, sizes)
    assert as_pairs(modes.all2all(store.load(spark, path))) == before
    store.merge(spark, path, spark.createDataFrame([], "name string, seq string"), ("a", 9))
    assert merged_words(spark, path) == (words, sizes) and dict(store.version(spark, path).batches) == {"a": 9}


def test_merge_is_made_again_if_another_writer_was_faster(spark, tmp_path, monkeypatch):
    """Two writers add the same new name: the slower one finds it and adds only the words that it lacks."""
    path = f"file://{tmp_path}/index"
    store.create(spark, path, Settings(K))
    mine, theirs = (spark.createDataFrame([("s", seq)], "name string, seq string") for seq in ("ACGTAACC", "ACGTAACTTT"))
    made, whole = store._merge_part, []

    def slow(*given):
        part = made(*given)
        if not whole:
            whole.append(part)
            store.merge(spark, path, theirs)
        return part

    monkeypatch.setattr(store, "_merge_part", slow)
    store.merge(spark, path, mine)
    words, sizes = merged_words(spark, path)
    assert list(sizes) == ["s"] and sizes["s"] == len(words_of("ACGTAACC", K) | words_of("ACGTAACTTT", K))


def test_fasta_files_with_clashing_and_odd_paths(spark, tmp_path):
    """Each file's sequences are its own sample's, whatever the paths; compressed files are read by their ending."""
    files = {"d/x/a.fa": "ACGTACGTA", "q/d/x/a.fa": "GGGGGGG", "with space/b+c%20.fna": "TTTTTTC", "empty.fasta": ""}
    for name, seq in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f">r\n{seq}\n" if seq else "")
    (tmp_path / "z.fa.gz").write_bytes(gzip.compress(b">g one\nACGGG\nTT\n>h\nCC\n"))
    (tmp_path / "s.fa.zst").write_bytes(zstandard.compress(b">s\nCATCAT\n"))
    paths = [f"{tmp_path}/{n}" for n in ("d/x/a", "q/d/x/a.fa", "with space/b+c%20", "empty", "z", "s.fa.zst")]
    samples, seqs = fasta.read_fasta(spark, paths)
    got = {}
    for r in seqs.collect():
        got.setdefault(r.sample_id, []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == {0: ["ACGTACGTA"], 1: ["GGGGGGG"], 2: ["TTTTTTC"], 4: ["ACGGGTT", "CC"], 5: ["CATCAT"]}
    assert samples.count() == 6
    twice, seqs = fasta.read_fasta(spark, [paths[4], paths[0], paths[4]], multisample=True)
    assert [(r.sample_id, r.name) for r in twice.orderBy("sample_id").collect()] == [(0, "g"), (1, "h"), (2, "r"), (3, "g"), (4, "h")]
    assert {r.sample_id: r.seq for r in seqs.collect()} == {0: "ACGGGTT", 1: "CC", 2: "ACGTACGTA", 3: "ACGGGTT", 4: "CC"}


def test_bounds_given_as_texts(spark, index, tmp_path):
    """Texts are bounds as numbers by measure are; one without a name is for shared words. Dense tables take none."""
    for texts, bounds in ((["3"], {"num-kmers": 3}), (["2", "jaccard:0.1"], {"num-kmers": 2, "jaccard": 0.1}), (["jaccard:0.5"], {"jaccard": 0.5})):
        assert as_pairs(modes.all2all(index, at_least=texts)) == as_pairs(modes.all2all(index, at_least=bounds))
        assert as_pairs(modes.new2all(index, index, at_most=texts)) == as_pairs(modes.new2all(index, index, at_most=bounds))
    with pytest.raises(ValueError, match="unknown measure"):
        modes.all2all(index, at_least=["nearness:1"])
    with pytest.raises(ValueError, match="sparse"):
        files.all2all(spark, f"{tmp_path}", f"{tmp_path}/out", at_least=["1"])


@pytest.mark.parametrize("k", [1, 5, 12])
def test_records_over_many_splits_have_all_their_words(spark, tmp_path, k):
    """Records of many splits and stretches, short lines, text before the first record, blank and repeated headers: the
    words of each sample are those of its whole record, each as often."""
    draw = random.Random(k)

    def record(name: str, size: int, width: int) -> str:
        seq = "".join(draw.choice("ACGT") for _ in range(size))
        return f">{name}\n" + "".join(seq[i : i + width] + draw.choice(("\n", "\r\n")) for i in range(0, size, width))

    texts = {
        "a.fa": "ACGTACGTACGTACGT\n" * 9 + record("long one", 700, 3) + record("", 40, 7) + ">\n\n" + record("short", 2, 1) + record("long", 300, 60) + ">none",
        "b.fa": record("x", 900, 1) + "ACGT>mid y\nTTTTTTTTTTTTTT",
        "c.fa": "\n" * 200 + ">\n" + "\n" * 200 + "ACGTACGTACGTAC\n",
        "d.fa": "no record",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "e.fa.gz").write_bytes(gzip.compress(texts["a.fa"].encode()))
    paths = [f"{tmp_path}/{n}" for n in (*texts, "e", "a.fa")]
    whole = []
    for text in [*texts.values(), texts["a.fa"], texts["a.fa"]]:
        found = [r.partition("\n") for r in text.replace("\r", "").split(">")[1:]]
        whole.append([(h.split(" ")[0], b.replace("\n", "")) for h, _, b in found if h.strip() or b.strip()])

    def words(seqs) -> Counter:
        return Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1))

    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        samples, seqs = fasta.stretches(spark, paths, k, size=50)
        assert [r.name for r in samples.orderBy("sample_id").collect()] == [*texts, "e", "a.fa"]
        got = {}
        for r in seqs.collect():
            assert len(r.seq) <= 50
            got.setdefault(r.sample_id, []).append(r.seq)
        assert {i: w for i, s in got.items() if (w := words(s))} == {i: w for i, f in enumerate(whole) if (w := words(b for _, b in f))}
        samples, seqs = fasta.stretches(spark, paths, k, multisample=True, size=50)
        every = [r for f in whole for r in f]
        assert [(r.sample_id, r.name) for r in samples.orderBy("sample_id").collect()] == list(enumerate(n for n, _ in every))
        got = {}
        for r in seqs.collect():
            got.setdefault(r.sample_id, []).append(r.seq)
        assert {i: w for i, s in got.items() if (w := words(s))} == {i: w for i, (_, b) in enumerate(every) if (w := words([b]))}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sources_by_list_file(spark, index, sequences, tmp_path):
    (tmp_path / "fa").mkdir()
    for i, seq in sequences:
        (tmp_path / "fa" / f"s{i}.fna").write_text(f">c\n{seq}\n")
    (tmp_path / "list").write_text("\n".join(f"{tmp_path}/fa/s{i}" for i, _ in sequences))
    read = dispatch.read_samples(spark, f"{tmp_path}/list", Settings(K))
    assert as_pairs(modes.all2all(read)) == expected(sequences)
    assert dispatch.read_samples(spark, f"{tmp_path}/fa/s0.fna", Settings(K)).samples.count() == 1
    index.postings.join(index.samples, "sample_id").select("name", "kmer").write.parquet(f"{tmp_path}/words")
    words = dispatch.read_samples(spark, f"{tmp_path}/words", Settings(K), "words")
    assert words.samples.agg(F.sum("n_kmers")).first()[0] == index.samples.agg(F.sum("n_kmers")).first()[0]
    with pytest.raises(ValueError, match="unknown format"):
        dispatch.read_samples(spark, f"{tmp_path}/list", Settings(K), "bam")


def test_sketch_files_meet_an_index_of_sequences(spark, sequences, tmp_path):
    """Words of 18 letters are stored spread over 40 bits, but are the index's own once read."""
    settings = Settings(18, fraction=0.5)
    samples = spark.createDataFrame([(i, f"s{i}") for i, _ in sequences], "sample_id long, name string")
    seqs = spark.createDataFrame(sequences, "sample_id long, seq string")
    modes.sketch(samples, seqs, f"{tmp_path}/sk", settings)
    found, post, config = sketches.read_sketches(spark, [f"{tmp_path}/sk/s{i}" for i, _ in sequences])
    want = {tuple(r) for r in store.build(samples, seqs, settings).postings.collect()}
    assert config == {"k": 18, "fraction": 0.5} and {tuple(r) for r in post.collect()} == want and want
    raw = (tmp_path / "sk" / "s0.minhash").read_bytes()
    n = int.from_bytes(raw[4:12], "little")
    stored = [int.from_bytes(raw[12 + 8 * j : 20 + 8 * j], "little") for j in range(n)]
    assert stored == sorted(stored) and all((w >> 4) & 15 == w & 15 for w in stored)
    with pytest.raises(ValueError, match="one name"):
        modes.sketch(samples.withColumn("name", F.lit("x")), seqs, f"{tmp_path}/sk2", settings)


class Stop(Exception):
    pass


@pytest.mark.parametrize("after", [0, 1])
def test_a_failed_extension_leaves_no_trace(spark, sequences, tmp_path, monkeypatch, after):
    """Stopped before or after the postings are written, an extension can be made again, and a batch is added once."""
    path, schema = f"file://{tmp_path}/index", ("sample_id long, name string", "sample_id long, seq string")

    def some(rows):
        return spark.createDataFrame([(k, f"s{i}") for k, (i, _) in enumerate(rows)], schema[0]), spark.createDataFrame([(k, s) for k, (_, s) in enumerate(rows)], schema[1])

    store.build_stored(spark, path, *some(sequences[:10]), Settings(K))
    fail = lambda *_, **__: (_ for _ in ()).throw(Stop())
    with monkeypatch.context() as m:
        m.setattr(store, *(("cardinalities", fail) if after else ("postings", fail)))
        with pytest.raises(Stop):
            store.extend(spark, path, *some([(0, "ACGTTGCATGCA")]))
        with pytest.raises(Stop):
            add_batch(spark.createDataFrame([("x", "ACGTTGCATGCA")], "name string, seq string"), 0, path)
    assert store.load(spark, path).samples.count() == 10
    store.extend(spark, path, *some(sequences[10:]))
    assert as_pairs(modes.all2all(store.load(spark, path))) == expected(sequences)
    for _ in range(2):
        add_batch(spark.createDataFrame([("x", "ACGTTGCATGCA"), ("y", "ACG"), ("x", "TTTTTT")], "name string, seq string"), 0, path)
    grown = store.load(spark, path).samples
    assert grown.count() == len(sequences) + 2 == grown.select("sample_id").distinct().count()
    assert {r.name: r.n_kmers for r in grown.where("name in ('x', 'y')").collect()} == {"x": len(words_of("ACGTTGCATGCA", K) | words_of("TTTTTT", K)), "y": 0}


def test_frequent_words_are_joined_in_chunks(index, sequences):
    want = expected(sequences)
    assert all(as_pairs(overlap.all2all(index.postings, chunk=c)) == want for c in (1, 2, 3, 5))
    assert as_pairs(overlap.all2all(index.postings, most=len(sequences))) == want


@pytest.mark.parametrize("chunk", [2, 1000])
@pytest.mark.parametrize(("share", "least"), [(0.05, 0), (0.3, 0), (0.5, 3), (0.9, 0), (1.0, 0), (0.0, 4), (0.0, 500)])
def test_prefixes_lose_no_pair(index, sequences, share, least, chunk):
    sizes = {i: len(words_of(s, K)) for i, s in sequences}
    every = expected(sequences)
    got = overlap.all2all_sharing(index.postings, index.samples, share, least, chunk).collect()
    assert all(every[r.row_id, r.col_id] == r.common and (r.n_row, r.n_col) == (sizes[r.row_id], sizes[r.col_id]) for r in got)
    want = {p for p, c in every.items() if c >= max(share * max(sizes[p[0]], sizes[p[1]]), least)}
    assert want <= {(r.row_id, r.col_id) for r in got} and len(got) == len({(r.row_id, r.col_id) for r in got})


@pytest.mark.parametrize("bounds", [({"jaccard": 0.3}, None), ({"cosine": 0.7}, None), ({"ani": 0.8}, None), (None, {"mash": 0.2}), ({"max": 0.4, "num-kmers": 5}, {"jaccard": 0.9}), ({"jaccard": 0.5}, {"mash": 2.0})])
def test_bounds_before_the_join_are_those_after_it(index, bounds):
    plain = select.with_sizes(overlap.all2all(index.postings), index.samples)
    assert as_pairs(modes.all2all(index, *bounds)) == as_pairs(select.filtered(plain, K, *bounds))


def test_prefixes_read_few_postings(spark):
    """Every sample has twenty words of its own pair and ten that all have: those make all but a few pairs, and are in no prefix."""
    rows = [(i, w) for i in range(400) for w in [*range(10), *(1000 + (i // 2) * 20 + k for k in range(20))]]
    post = spark.createDataFrame(rows, "sample_id long, kmer long").repartition(4)
    sizes = post.groupBy("sample_id").count().withColumnRenamed("count", "n_kmers")
    joined = overlap.prefixes(post, sizes, 0.5).where("_class <= cut")
    assert joined.where("kmer < 10").count() == 0 and joined.count() == 400 * 20
    assert as_pairs(overlap.all2all_sharing(post, sizes, 0.5)) == {(i + 1, i): 30 for i in range(0, 400, 2)}


@pytest.mark.parametrize("bits", [64, 3, 1, 0])
def test_patterns_are_told_apart_whatever_their_names(spark, index, sequences, bits):
    """With few bits many sets share a name; they are split by their lists."""
    sets: dict[int, set[int]] = {}
    for r in index.postings.collect():
        sets.setdefault(r.kmer, set()).add(r.sample_id)
    classes: dict[frozenset, list[int]] = {}
    for word, of in sets.items():
        classes.setdefault(frozenset(of), []).append(word)
    got = overlap.pattern_words(index.postings, bits).collect()
    assert {(r.kmer, r.pattern, r.n_samples, r.num_kmers) for r in got} == {(w, min(ws), len(of), len(ws)) for of, ws in classes.items() for w in ws}
    assert len(got) == len(sets)
    members = overlap.pattern_members(index.postings, bits).collect()
    assert sorted((r.pattern, r.sample_id) for r in members) == sorted((min(ws), s) for of, ws in classes.items() for s in of)


def test_a_pattern_of_many_samples_makes_no_long_row(spark):
    """Words that 3000 samples have, in 1000 of which there is another one: pairs are joined in chunks."""
    post = spark.range(3000).select(F.col("id").alias("sample_id"), F.explode(F.when(F.col("id") % 3 == 0, F.expr("array(1L, 2L, 9L)")).otherwise(F.expr("array(1L, 2L)"))).alias("kmer"))
    got = overlap.pattern_members(post).groupBy("pattern", "num_kmers", "n_samples").count().collect()
    assert sorted(map(tuple, got)) == [(1, 2, 3000, 3000), (9, 1, 1000, 1000)]
    sums = overlap.all2all_by_patterns(post, chunk=200).groupBy("common").count().collect()
    assert {r.common: r["count"] for r in sums} == {3: 1000 * 999 // 2, 2: 3000 * 2999 // 2 - 1000 * 999 // 2}
    plan = overlap.pattern_members(post)._jdf.queryExecution().optimizedPlan().toString()
    assert "_samples" in plan and plan.count("collect_list(sample_id") == 1  # only for names that two sets share


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
def test_a_rectangle_is_joined_in_a_grid(spark, sequences, index, chunk):
    other = [(100 + i, s + "ACGTT") for i, s in sequences[::2]]
    queries = store.build(spark.createDataFrame([(i, str(i)) for i, _ in other], "sample_id long, name string"), spark.createDataFrame(other, "sample_id long, seq string"), Settings(K))
    want = {(i, j): n for i, a in other for j, b in sequences if (n := len(words_of(a, K) & words_of(b, K)))}
    assert as_pairs(overlap.cross(queries.postings, index.postings, chunk)) == want


def test_a_word_of_a_whole_rectangle_makes_no_large_task(spark):
    """Two indexes of 1500 samples that all have one word: by chunks of 100, no key has more than some 100 rows of a side."""
    rows = spark.range(1500).select(F.col("id").alias("sample_id"), F.lit(7).cast("long").alias("kmer"))
    frequent = spark.createDataFrame([(7, 1500, 1500)], "kmer long, _rows long, _cols long")
    x, y = rows.select("kmer", F.col("sample_id").alias("row_id")), rows.select("kmer", F.col("sample_id").alias("col_id"))
    pairs = overlap._grid_join(x, y, frequent, 100)
    assert pairs.count() == 1500 * 1500 == pairs.distinct().count()
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for key, value in zip(old, ("-1", "false", "32"), strict=True):
        spark.conf.set(key, value)
    try:
        spread = overlap._grid_join(x, y, frequent, 100).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    # 225 cells of some 10,000 pairs, dealt to 32 tasks by their hash
    assert len(spread) > 25 and max(r["count"] for r in spread) < 1500 * 1500 / 8


def test_one_against_an_index(spark, index, sequences):
    one = store.build(spark.createDataFrame([(0, "q")], "sample_id long, name string"), spark.createDataFrame([(0, sequences[4][1])], "sample_id long, seq string"), Settings(K))
    got = {r.col_id: r.common for r in modes.one2all(one, index).collect()}
    assert got == {i: len(words_of(s, K) & words_of(sequences[4][1], K)) for i, s in sequences}
    with pytest.raises(ValueError, match="one sample"):
        modes.one2all(index, index)


def test_distances_of_tables(spark, index, sequences, tmp_path):
    """A sparse table gives a sparse one whatever is asked; dense and Phylip tables are triangles, without bounds."""
    sizes = {i: len(words_of(s, K)) for i, s in sequences}
    jaccard = {k: c / (sizes[k[0]] + sizes[k[1]] - c) for k, c in expected(sequences).items()}
    for sparse in (True, False):
        pairs = modes.all2all(index) if sparse else overlap.all2all_dense(index.postings, index.samples)
        render.write_lines(render.counts_lines(index.samples, index.samples, pairs, K, 1.0, sparse), f"{tmp_path}/c{sparse}")
        table = counts_table.read_counts_table(spark, f"{tmp_path}/c{sparse}")
        lines = [r.line.split(",")[1:-1] for r in modes.distance_lines(table, "jaccard", at_least=["0.1"]).orderBy("at").collect()][1:]
        if sparse:
            assert lines == [[f"{j + 1}:{jaccard[i, j]:.6f}" for j in range(i) if jaccard.get((i, j), 0) >= 0.1] for i in sizes]
        else:
            assert [len(x) for x in lines] == list(sizes) and all(float(v) == pytest.approx(jaccard.get((i, j), 0), abs=1e-6) for i, x in enumerate(lines) for j, v in enumerate(x))
        phylip = [r.line for r in modes.distance_lines(table, "jaccard", phylip=True, at_least=["0.1"]).orderBy("at").collect()]
        assert phylip[0] == str(len(sizes)) and [len(x.split()) for x in phylip[1:]] == [i + 1 for i in sizes]


def test_lists_of_stored_indexes(spark, index, sequences, tmp_path):
    for part, rows in enumerate((sequences[:8], sequences[8:])):
        samples = spark.createDataFrame([(k, f"s{i}") for k, (i, _) in enumerate(rows)], "sample_id long, name string")
        store.build_stored(spark, f"{tmp_path}/i{part}", samples, spark.createDataFrame([(k, s) for k, (_, s) in enumerate(rows)], "sample_id long, seq string"), Settings(K))
    (tmp_path / "list").write_text(f"{tmp_path}/i0 {tmp_path}/i1\n")
    assert as_pairs(modes.all2all_listed(spark, f"{tmp_path}/list")[1]) == expected(sequences)


def test_nothing_else_imports_the_llm_subpackage():
    for path in PACKAGE.rglob("*.py"):
        if "llm" in path.relative_to(PACKAGE).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, ast.Import | ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
