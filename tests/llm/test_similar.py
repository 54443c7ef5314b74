"""Groups at a similarity of five-word shingles, against all pairs compared on the words themselves."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from setloom.llm import similar, simhash

SCHEMA = "doc_id long, text string, mark string, key string, component string, component_id long, hashes string, n string"


def plain_sets(text: str | None, size: int = 5) -> frozenset:
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain_groups(rows: list[tuple[int | None, str | None]]) -> list:
    """(doc_id, smallest doc_id of its group), by comparing all pairs of texts."""
    texts = list({t or "" for _, t in rows})
    sets, root = [plain_sets(t) for t in texts], list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[top(i)] = top(j)
    group = {t: top(i) for i, t in enumerate(texts)}
    least: dict[int, int] = {}
    for i, t in rows:
        g = group[t or ""]
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, least.get(group[t or ""])) for i, t in rows), key=str)


def near_texts(draw: random.Random, groups: int, most: int, changes: int) -> list[str]:
    out = []
    for g in range(groups):
        words = [f"w{draw.randrange(500)}" for _ in range(draw.randint(60, 160))]
        for _ in range(draw.randint(1, most)):
            copy = list(words)
            for _ in range(draw.randint(0, changes)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10_000)}"
            out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def rows() -> list[tuple[int | None, str | None]]:
    draw = random.Random(3)
    texts = near_texts(draw, 25, 8, 4) + near_texts(draw, 1, 1, 0)
    hot = texts[-1].split()
    texts += [" ".join([*hot[:i], "other", *hot[i + 1 :]]) for i in range(len(hot))]  # a large group of near copies
    texts += [None, "", " \t\n", "word", "WORD", "one two three", "ab " * 40_000, "ab " * 40_001, texts[0], texts[0].upper(), texts[0]]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    out = list(zip(ids, texts, strict=True))
    return [*out, (None, "no id"), (None, texts[3]), (7, "a seventh text"), (7, "a seventh text")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "m", "k", "c", 1, "h", "n") for i, t in rows], SCHEMA).repartition(5)


def test_groups_are_those_of_all_pairs(spark, rows):
    got = similar.grouped(frame(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_groups(rows)


def test_unlike_texts_of_one_key_take_several_rounds(spark, rows, monkeypatch):
    monkeypatch.setattr(similar, "band_keys", lambda hashes: similar.np.zeros(similar.BANDS, similar.np.int64))
    docs = frame(spark, rows)
    seen = docs.select("doc_id", similar._mark().alias("mark"), "text").collect()
    sizes = [(bytes(r.mark), len(similar.shingle_hashes(r.text)), [0]) for r in seen]
    nodes = spark.createDataFrame(sizes, "mark binary, n long, keys array<long>").dropDuplicates(["mark"])
    found = {bytes(r.node): bytes(r.component) for r in similar.links(nodes, docs).collect()}
    texts = {bytes(r.mark): r.text or "" for r in seen}
    sets = {m: plain_sets(t) for m, t in texts.items()}
    linked = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert all(found[a] == found[b] for a, b in linked)
    assert set(found) == {m for pair in linked for m in pair}


def test_one_document_of_each_group_stays(spark, rows):
    docs = frame(spark, rows)
    kept = simhash.kept_documents(docs, groups=similar.grouped(docs))
    assert kept.columns == docs.columns
    want = {least for _, least in plain_groups(rows) if least is not None}
    got = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in got if i is not None) == sorted(want)
    assert got.count(None) == 1


def test_keys_find_pairs_at_the_threshold():
    """A pair of similarity 0.8 shares a key with probability 0.9996; unlike texts share none."""
    draw = random.Random(9)
    missed = 0
    for _ in range(300):
        shared = [draw.getrandbits(64) for _ in range(160)]
        a, b = (similar.np.array(shared + [draw.getrandbits(64) for _ in range(20)], similar.np.uint64) for _ in range(2))
        missed += not set(similar.band_keys(a)) & set(similar.band_keys(b))
    assert missed <= 2
    sets = [similar.np.array([draw.getrandbits(64) for _ in range(160)], similar.np.uint64) for _ in range(40)]
    assert not any(set(similar.band_keys(x)) & set(similar.band_keys(y)) for x, y in combinations(sets, 2))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert similar.grouped(docs).collect() == []
    assert simhash.kept_documents(docs, groups=similar.grouped(docs)).collect() == []
    assert similar.grouped(docs.withColumn("text", F.lit(None).cast("string"))).collect() == []
