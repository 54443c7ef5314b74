"""Each operator against a plain version, with nulls, empty texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from setloom.llm import blocks, components, exact_dedup, joins, mixing, pieces, quality_classifier, quality_rules, simhash, surrogates, token_counts, url_filter, warc
from setloom.llm.queries import ORACLES, QUERIES
from tests.oracle import TABLES, both

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n string, key string, fp string, _text string"


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    draw = random.Random(5)
    vocabulary = ["the", "of", "Über", "naïve", "ﬁn", "don't", "x1", "été", "日本語", "🙂", "a_b", "Σας", "İx", "<|endoftext|>", "\u00a0", "e\u0301"] + [f"w{i}" for i in range(60)]
    out: list[tuple[int | None, str | None]] = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 120)))) for i in range(60)]
    out += [(100 + i, t) for i, (_, t) in enumerate(out[:8])]
    out += [(120 + i, t.upper()) for i, (_, t) in enumerate(out[:4])]
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "word"), (204, "two words"), (205, "a\nb\n\na\r\n a\n"), (206, "▁ x  ▁"), (207, "ab " * 40_000), (None, "no id"), (None, None)]
    out += [(5, out[5][1]), (5, "another text of five")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None, "fr"][k % 3], ["b", "a", None, "c"][k * k % 4], len(t or ""), "x", "y", "z", "f", "t") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], ORACLES[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_warc", "op8_url_filter", "op11_whitening", "op13_vector_codes"}))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op1_warc", "op8_url_filter"])
def test_empty_pages(spark, tmp_path, name):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_warc(spark, tmp_path):
    long = "ü" * 60
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 30), (6, "u", "s"), (7, "u", "s"), (2, "u", long), (9, "u", "x" * 99), (10, "u", "x" * 99), (None, "u", long), (11, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = 1 if html == long and i != 1 else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers and i else "response", refers if i else None))
    null = [x for x in got if x[0] is None]
    assert [x for x in got if x[0] is not None] == sorted((x for x in want if x[0] is not None), key=str)
    assert len(null) == 1 and null[0][1:3] == (120, hashlib.sha256(long.encode()).hexdigest())


def test_warc_members_can_be_reached_alone(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * i) for i in range(1, 40)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(2), f"file://{tmp_path}/raw")
    index = warc.normalise(spark, f"{tmp_path}/raw", f"{tmp_path}/neat 1").collect()
    for r in index:
        raw = (tmp_path / "neat 1" / r.archive).read_bytes()[r.offset : r.offset + r.length]
        member = zlib.decompressobj(31)
        assert f"page {r.page_id} ".encode() in member.decompress(raw) and member.eof and not member.unused_data
    assert len(index) == 39
    (tmp_path / "short").mkdir()
    for raw in (tmp_path / "raw").glob("part-*.gz"):
        (tmp_path / "short" / raw.name).write_bytes(raw.read_bytes()[:-20])
    with pytest.raises(Exception, match="ends"):
        warc.normalise(spark, f"file://{tmp_path}/short", f"file://{tmp_path}/cut")


def test_warc_payloads_are_read_in_batches_of_bytes(spark, tmp_path):
    """Every response has its payload, whatever a batch holds; a revisit has none."""
    html = ["é" * 70_000, "", None, "x" * 200, "x" * 200, "<p>short</p>", "y" * 300_000]
    pages = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/raw")
    index = warc.normalise(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/neat")
    want = {str(i): None if i == 4 else (h or "").encode() for i, h in enumerate(html)}
    for size in (1, 100_000, warc.BATCH_BYTES):
        rows = warc.read_records(index, f"file://{tmp_path}/neat", batch_bytes=size).collect()
        assert {r.page_id: None if r.payload is None else bytes(r.payload) for r in rows} == want and len(rows) == len(html)
    assert "payload" not in warc.read_records(index, f"file://{tmp_path}/neat", payloads=False).columns


def test_token_counts(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in texts), key=str)
    assert sorted(map(tuple, token_counts.token_counts(docs, path).collect()), key=str) == want


def test_exact_dedup(docs, texts):
    groups: dict[str, list] = {}
    for i, t in texts:
        groups.setdefault(lowered(t), []).append(i)
    want = []
    for i, t in texts:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    assert sorted(map(tuple, exact_dedup.dedup(docs).collect()), key=str) == sorted(want, key=str)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    found = [lowered(r.text) for r in kept.collect()]
    assert len(found) == len(set(found)) == len(groups)


def test_exact_dedup_index_probe_and_levels(spark, tmp_path):
    rows = [(i, hashlib.sha256(str(i % 30).encode()).digest()) for i in range(90)]
    path, found = f"file://{tmp_path}/index", []
    for k in range(5):
        index = exact_dedup.DigestIndex(spark, path, keep="min", fan_in=2)  # opened again each time
        found.append({bytes(r.digest) for r in index.flush(spark.createDataFrame(rows[k * 18 : (k + 1) * 18], "doc_id long, digest binary"), 18).collect()})
    seen: set[bytes] = set()
    for k in range(5):
        batch = {bytes(d) for _, d in rows[k * 18 : (k + 1) * 18]}
        assert found[k] == batch & seen
        seen |= batch
    assert sum(len(level) for level in index.levels) < 5
    wanted = spark.createDataFrame([(rows[7][1],), (b"none",)], "digest binary")
    assert [(r.keep_id, r.n) for r in index.lookup(wanted).collect()] == [(7, 3)]
    assert {(r.keep_id, r.n) for r in index.compact().collect()} == {(i, 3) for i in range(30)}


def test_a_failed_flush_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    path, batch = f"file://{tmp_path}/index", spark.createDataFrame([(1, b"a"), (2, b"b")], "doc_id long, digest binary")
    exact_dedup.DigestIndex(spark, path).flush(batch, 2)
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "settle", lambda *_, **__: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            exact_dedup.DigestIndex(spark, path).flush(batch, 2)
    index = exact_dedup.DigestIndex(spark, path)
    assert [(r.keep_id, r.n) for r in index.compact().orderBy("keep_id").collect()] == [(1, 1), (2, 1)]


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle wherever nothing is broadcast on purpose."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
    spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_salted_join_splits_hot_keys(shuffled):
    rows = shuffled.createDataFrame([(i, "hot" if i % 2 else f"k{i % 40}", "x") for i in range(4000)], "i long, key string, salt string")
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("value", F.upper("key"))
    out = joins.salted_join(rows, table, "key", "n", F.col("i"))
    got = out.collect()
    assert len(got) == 4000 and all(r.value == r.key.upper() for r in got)
    assert max(Counter((r.key, r._salt) for r in got).values()) < 200
    assert {r.key for r in got if r._salts > 1} >= {"hot"}
    left = joins.salted_join(rows, table.where("key = 'hot'"), "key", "n", F.col("i"), "left", 4000).collect()
    assert len(left) == 4000 and all((r.value is None) == (r.key != "hot") for r in left)


def test_salted_join_splits_a_key_of_a_300th(shuffled):
    """A key with less than a 256th of all rows is in more than one task too, and a table of few rows isn't repeated."""
    rows = shuffled.range(90_000).select(F.col("id").alias("i"), F.when(F.col("id") % 300 == 0, "warm").otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("key"))
    out = joins.salted_join(rows, rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "n", F.col("i"))
    got = out.groupBy("key", "_salt").count().collect()
    assert sum(r["count"] for r in got) == 90_000 and max(r["count"] for r in got) < 200
    assert {r.key for r in got if r._salt > 0} == {"warm"}


def test_filter_of_the_largest_size_has_the_same_plan(spark, monkeypatch):
    """Beyond its size a filter lets more rows pass; what it does is the same, and no id is ruled out."""

    def shape(n: int) -> list[str]:
        rows = joins.maybe_among(spark.range(5000), F.col("id"), spark.range(n), "id")
        assert rows.where(f"id < {n} and not _maybe").count() == 0
        return re.findall("[A-Z][A-Za-z]+Join|Exchange|BroadcastExchange|HashAggregate", rows._jdf.queryExecution().sparkPlan().toString())

    small = shape(100)
    monkeypatch.setattr(joins, "MAX_BITS", 1 << 15)
    assert shape(100) == shape(4000) == small
    others = joins.maybe_among(spark.range(100_000, 120_000), F.col("id"), spark.range(20_000), "id")
    assert 0 < others.where("not _maybe").count() < 20_000


def test_exact_dedup_with_a_hot_text(shuffled):
    rows = [(i, "The Same" if i % 2 else f"text {i // 4}") for i in range(3000)]
    out = exact_dedup.dedup(shuffled.createDataFrame(rows, "doc_id long, text string")).collect()
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == sorted((i, max(groups[t]), len(groups[t])) for i, t in rows)


def test_filter_passes_all_ids_and_few_others(spark):
    """At 10 million ids a filter lets a sixteenth of other rows pass at most."""
    assert joins.filter_bits(1) == 32768 and joins.filter_bits(10_000_000) == 1 << 28
    ids = spark.range(10_000_000)
    maps = joins.bitmaps(ids, "id", joins.filter_bits(10_000_000))
    others = joins.marked(spark.range(20_000_000, 20_050_000), F.broadcast(maps), F.col("id"), joins.filter_bits(10_000_000))
    assert 0 < others.where("_maybe").count() < 50_000 / 16
    some = joins.maybe_among(spark.range(2000), F.col("id"), spark.range(0, 2000, 2), "id")
    assert some.where("id % 2 = 0 and not _maybe").count() == 0 and some.where("_maybe").count() < 1100
    assert joins.maybe_among(spark.range(3), F.col("id"), spark.range(0), "id").where("_maybe").count() == 0


def test_exact_dedup_collisions_are_told_apart(spark):
    out = spark.createDataFrame([(1, 9, 3, "d"), (5, 9, 3, "d"), (9, 9, 3, "d")], "doc_id long, keep_id long, group_size long, text_sha256 string")
    out = out.withColumn("text_sha256", F.lower(F.hex("text_sha256")))
    bad = spark.createDataFrame([(5, bytearray(b"d"), "other")], "doc_id long, digest binary, _text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup._regrouped(out, bad, "max").collect()) == [(1, 9, 2), (5, 5, 1), (9, 9, 2)]


def test_surrogates(spark):
    rows = [
        (1, "Call +1 (415) 555-0123 or +14155550123; John.Doe9@Mail.Example.com, JOHN.DOE9@MAIL.EXAMPLE.COM!"),
        (2, "Mrs Smith met Anna Smith and Mr. James Cook, 4111 1111 1111 1111 = 4111111111111111; 192.168.0.1 8.8.8.8 999.1.1.1"),
        (3, None), (4, ""), (None, "a@b.co c@b.co d@b.co 123-45-6789"), (5, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'),
        (5, "plain text 4111111111111112 with 12345 numbers, 1.2.3 and a@b"), (6, "x@y.zz " * 2000 + "été.27@mail1.example.com"), (7, "Dr Иван Петров; Señora María LÓPEZ"),
    ]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, n_entities string, kind string")
    out = surrogates.replaced(docs)
    assert out.columns == ["doc_id", "text", "kind", "n_entities"]
    got = {(r.doc_id, r.n_entities): r.text for r in out.collect()}
    one = got[1, 4]
    a, b = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0], re.search(r"\+1\d{10}", one)[0]
    assert re.sub(r"\D", "", a) == b[1:] and b != "+14155550123"
    mails = re.findall(r"[\w.]+@[\w.]+", one)
    assert mails[0].upper() == mails[1] and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}\d@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.com", mails[0])
    two = got[2, 7]
    m = re.fullmatch(r"Mrs (\w+) met (\w+) (\w+) and Mr\. (\w+) (\w+), (4\d{3} \d{4} \d{4} \d{4}) = (4\d{15}); (192\.168\.\d+\.\d+) (\d+\.\d+\.\d+\.\d+) 999\.1\.1\.1", two)
    assert m and m[1] == m[3] and m[6].replace(" ", "") == m[7] != "4111111111111111" and not {"Smith", "Anna", "James", "Cook"} & set(m.groups())
    assert m[2][-1] == "a" and m[4][-1] != "a"
    digits = [int(c) for c in m[7]][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert got[3, 0] is None and got[4, 0] == "" and got[5, 0] == rows[6][1]
    assert len(set(got[None, 4].split())) == 4 and re.fullmatch(r'token = "[0-9a-f]{40}"', got[5, 1])
    six = got[6, 2001].split()
    assert len(set(six[:-1])) == 1 and "x@y.zz" not in six and "été" not in six[-1]
    assert re.fullmatch(r"Dr [А-Я][а-я]+ [А-Я][а-я]+; Señora [A-Z][a-z]+a [A-Z]+", got[7, 2])
    assert {(r.doc_id, r.n_entities): r.text for r in surrogates.replaced(docs.repartition(7)).collect()} == got
    assert {(r.doc_id, r.n_entities): r.text for r in surrogates.replaced(docs, key="other").collect()} != got


def test_surrogates_replace_credentials_whole(spark):
    draw = random.Random(6)
    long, hexadecimal, many = "".join(draw.choices("abcXYZ0189_-/", k=300)), "".join(draw.choices("0123456789abcdef", k=300)), ".".join("ab" * 3000)
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJSMeKKF2QT4fwpMeJf36P"
    secrets = [long, hexadecimal, jwt, "SG.x1y2." + "k3" * 12, "a" * 16 + "..cipher.tag", "hunter2", "+" + "aB3/" * 6, many + "." + "z" * 20]
    rows = [(i, f'token = "{x}" end') for i, x in enumerate(secrets)] + [(50, f"API_KEY={jwt}. Password: required")] + [(100 + i, f"password = '{i}'") for i in range(10)]
    got = {r.doc_id: (r.text, r.n_entities) for r in surrogates.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in enumerate(secrets):
        text, n = got[i]
        m = re.fullmatch(r'token = "(\S+)" end', text)
        assert n == 1 and m and (len(m[1]) == len(x) or len(x) < 16) and not set(re.findall(r"[^.]{4,}", x)) & set(re.findall(r"[^.]{4,}", m[1])), (i, text[:80])
    assert re.fullmatch("[0-9a-f]{300}", re.search('"(.*)"', got[1][0])[1])
    assert got[50] == (f"API_KEY={re.search('\"(.*)\"', got[2][0])[1]}. Password: required", 1)
    short = {got[100 + i][0] for i in range(10)}
    assert len(short) == 10 and not short & {t for _, t in rows}


def test_surrogates_keep_people_and_networks_what_they_are(spark):
    rows = [
        (1, "Mr Kofi Annan and Dr Kofi Annan met Kofi. Annan said so, the Annans did not."),
        (2, "Dr Γιώργος Παπαδόπουλος; Dr Kofi Annan"), (3, "172.16.0.5 172.40.0.5 127.0.0.1 169.254.3.4 10.1.1.1"),
        (4, "2001:db8:0:1:2:3:4:5 and fe80:0::1:2, std::vector a::b 12:30:45"), (5, "06 12 34 56 78 or 06.12.34.56.78, 1234 56 78"), (6, "Kofi and Annan without a title"),
    ]
    got = {r.doc_id: r.text for r in surrogates.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    m = re.fullmatch(r"Mr (\w+) (\w+) and Dr (\w+) (\w+) met (\w+)\. (\w+) said so, the Annans did not\.", got[1])
    assert m and m[1] == m[3] == m[5] != "Kofi" and m[2] == m[4] == m[6] != "Annan" and m[1][-1] in "nsrk"
    assert re.fullmatch(rf"Dr [Α-Ω]\w+ [Α-Ω]\w+; Dr {m[1]} {m[2]}", got[2]) and "Παπαδόπουλος" not in got[2]
    ips = got[3].split()
    assert re.fullmatch(r"172\.(1[6-9]|2\d|3[01])\.\d+\.\d+", ips[0]) and not ips[1].startswith("172.40.") and ips[2].startswith("127.") and ips[3].startswith("169.254.") and ips[4].startswith("10.")
    assert not set(ips) & set(rows[2][1].split())
    assert re.fullmatch(r"2001(:[0-9a-f]{1,4}){7} and fe80:[0-9a-f]::[0-9a-f]:[0-9a-f], std::vector a::b 12:30:45", got[4]) and "2001:db8" not in got[4]
    five = re.fullmatch(r"(0\d(?: \d\d){4}) or (0\d(?:\.\d\d){4}), 1234 56 78", got[5])
    assert five and five[1].replace(" ", "") == five[2].replace(".", "") != "0612345678"
    assert got[6] == rows[5][1]


def test_surrogates_stay_distinct_in_a_narrow_format(spark):
    entities = spark.createDataFrame([("email", f"{a}@x.org") for a in "abcdefghijklmnopqrstuvwxyz"] + [("ip", f"10.0.0.{i}") for i in range(256)], "kind string, canonical string")
    got = surrogates.assign(entities).collect()
    given = {(r.kind, r.surrogate) for r in got}
    assert len(got) == len(given) == 282 and not given & {(r.kind, r.canonical) for r in got}


def test_mixing(docs, texts):
    rows = mixing.mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted((i is None, i or 0, len(words(t))) for i, t in texts)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    open_, left, want = set(order), 1.5 * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            want[s] = 2.0 * sizes[s] if full else level * weight[s]
        left -= sum(2.0 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and want[s] - taken[s] < 4
    again = mixing.mix(docs.repartition(9), weights=(3, 1, 2), share=1.5, cap=2.0).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    mixed = mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, cap=2.0)
    assert mixed.columns == docs.columns and max(Counter((r.doc_id, r.text) for r in mixed.collect()).values()) <= 4


@pytest.mark.parametrize("unit_chars", [3, pieces.UNIT_CHARS])
def test_sentencepiece(docs, texts, unit_chars):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, library.encode(t or "")) for i, t in texts), key=str)
    encoded = pieces.encode(docs.select("doc_id", "text", "lang"), path, unit_chars)
    assert encoded.columns == ["doc_id", "lang", "ids"]
    rows = pieces.decode(encoded.withColumn("text", F.lit("clash")), path).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=str) == want
    assert sorted((r.text for r in rows), key=str) == sorted((library.decode(library.encode(t or "")) for _, t in texts), key=str)


def test_sentencepiece_of_odd_texts(spark):
    path, draw = public_tokenizers.path("piece_bpe_32k.model"), random.Random(1)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    parts = ["a", "b", "the", " ", "  ", "\n", "=", "==", "é", "日本", "語", "🙂", "▁", "in", "ing", "tion", "Ab", "1", "23", ".", "(", "{", "\t", "ж", "он", "\u0301", "ß"]
    odd = ["".join(draw.choices(parts, k=draw.randint(0, 80))) for _ in range(500)]
    odd += ["ab" * 5000, "=" * 3000, "the" * 400 + "ing" * 300, "aé" * 100, "语言" * 2000, "word " * 600_000]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), path).collect()
    assert len(rows) == len(odd) and all(list(r.ids) == library.encode(odd[r.doc_id]) for r in rows)


def test_sentencepiece_of_units_as_long_as_a_mask(spark):
    """Units of 58 to 66 characters with their space: letters, one piece after another, and runs of a sign."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [f"see {(x * 70)[:n]} here" for x in ("a", "=", "internationalisation", "日", "é") for n in range(57, 66)]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), path).collect()
    assert len(rows) == len(odd) and all(list(r.ids) == library.encode(odd[r.doc_id]) for r in rows)


def test_sentencepiece_without_other_columns(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode(spark.createDataFrame([("a b",), ("",)], "text string"), path)
    assert got.columns == ["ids"] and sorted(list(r.ids) for r in got.collect()) == sorted([library.encode("a b"), []])


def test_viterbi_takes_the_best_way(spark):
    table = [("▁a", 10, -1.0), ("b", 11, -2.0), ("ab", 12, -2.5), ("▁", 13, -3.0), ("a", 14, -2.0), ("bc", 15, -1.0), ("c", 16, -2.0)]
    model, want = pieces.Model(False, table, 100, 3), {"▁abc": [10, 15], "▁ab": [10, 11], "▁é": [13, 100 + 0xC3, 100 + 0xA9]}
    got = {r.unit: list(r.ids) for r in pieces.viterbi(spark.createDataFrame([(u,) for u in want], "unit string"), model).collect()}
    assert got == want == {u: pieces.LongUnits(model).of(u) for u in want}


def test_quality_rules(docs, texts):
    def base(text):
        w = words(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed

    got = quality_rules.judge(docs).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(((i, *base(t)) for i, t in texts), key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert Counter((r.doc_id, r.text) for r in quality_rules.kept_documents(docs).collect()).total() == sum(r.kept for r in got)


def test_quality_rules_reject_what_diverges(spark):
    draw = random.Random(1)
    common, rare = "the of and to in is that for".split(), [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrt"]
    rows = [(i, " ".join(draw.choice(common if draw.random() < 0.4 else rare) for _ in range(300))) for i in range(60)]
    rows += [(900, " ".join(f"#{draw.randint(0, 9**6)}%" for _ in range(300))), (901, " ".join(draw.choice(rare) + str(draw.randint(0, 999)) for _ in range(300)))]
    kept = {r.doc_id for r in quality_rules.judge(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == set(range(60))


def prose(draw, common, size=110):
    rare = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrt"]
    return " ".join(draw.choice(common if draw.random() < 0.4 else rare) for _ in range(size))


def test_quality_rules_keep_clean_text_of_rare_and_unknown_languages(spark):
    draw = random.Random(2)
    english, german = "the of and to in is that for".split(), "der die das und den ist ein von".split()
    rows = [(i, prose(draw, english), "en") for i in range(60)] + [(100 + i, prose(draw, german), "de") for i in range(5)] + [(200 + i, prose(draw, german), None) for i in range(5)]
    rows += [(300, "#$% " * 40 + " ".join(f"#{draw.randint(0, 9**6)}%" for _ in range(300)), lang) for lang in ("de", None)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows if i != 300)


def test_quality_rules_give_every_language_its_reference(spark):
    draw = random.Random(3)
    english, german = "the of and to in is that for".split(), "der die das und den ist ein von".split()
    rows = [(k, prose(draw, english), f"l{k % 256}") for k in range(256 * 21)] + [(10_000 + i, prose(draw, german), "rare") for i in range(20)]
    rows += [(20_000, prose(draw, english), "rare")]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if not r.kept} == {20_000}


URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "https://a.b.NET/x?y#z", "http://example.net/en/", "http://www.example.net/en/a/b", "http://example.net/en",
    "http://badexample.net/de/", "http://example.com/de/x", "http://sub.example.com/de/", "http://example.com/dex", "http://example.org/fr/q", "http://org/fr/?x=/", "x://y://net/", "http://a..net//", "http://exämple.net/Ä", "http://net:80/", "http://net/" + "d/" * 3000,
]


def test_url_filter(spark):
    from setloom.llm.queries import URL_RULES

    def judge(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lowered(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string, _short string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [judge(u) for u in URLS * 2]
    none = url_filter.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert len(none) == len(URLS) * 2 and {r.verdict for r in none} == {"allow"}


def test_url_filter_with_clashing_columns_and_hot_keys(shuffled):
    """Half the URLs have one host and path, a quarter none; columns have the names of those within."""
    urls = ["http://a.net/x/y", None, "http://a.net/x/y", "http://h{}.example.com/de/{}"]
    rows = [(i, urls[i % 4].format(i, i) if urls[i % 4] else None, "v", "w", "u", {"k": i}) for i in range(400)]
    pages = shuffled.createDataFrame(rows, "page_id long, url string, _verdict string, _url string, _page string, m map<string,int>")
    rules = url_filter.rule_table(shuffled, [("net", "/", "block"), ("a.net", "/x/", "allow"), ("a.net", "/x/yy", "block"), ("example.com", "/de/", "block"), ("example.com", "/de/", "allow")])
    out = url_filter.judge_urls(pages, rules)
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    want = {0: ("a.net/x/", "allow"), 1: (None, "allow"), 2: ("a.net/x/", "allow"), 3: ("example.com/de/", "block")}
    got = out.collect()
    assert len(got) == 400 and all((r.rule, r.verdict) == want[r.page_id % 4] and (r._verdict, r._url, r._page) == ("v", "w", "u") for r in got)


def test_components_of_a_star_are_dealt_to_many_tasks(shuffled):
    edges = shuffled.createDataFrame([(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(20)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(3000)} | {5000 + i: 5000 for i in range(21)}
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    least = pairs.groupBy("node").agg(F.min("other").alias("least"), F.count(F.lit(1)).alias("_n"))
    met = joins.salted_join(pairs, least, "node", "_n", F.col("other"))
    assert max(r["count"] for r in met.groupBy("node", "_salt").count().collect()) < 40


def plain_fingerprint(text):
    w = words(lowered(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, p in rows:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [(i, f"{p:016x}", least.get(find(p))) for i, p in rows]


def test_simhash(docs, texts):
    rows = [(i, plain_fingerprint(t)) for i, t in texts]
    want = sorted(plain_components(rows, sorted({p for _, p in rows})), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want
    kept = simhash.kept_documents(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(x for x in ids if x is not None) == sorted({c for _, _, c in want if c is not None})


@pytest.mark.parametrize("limit", [0, 3, 10_000])
def test_simhash_links_of_crowded_neighbourhoods(spark, limit):
    draw, prints = random.Random(9), set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        prints |= {centre ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 4))}) for _ in range(30)}
    prints |= {0, 1, (1 << 64) - 1, (1 << 63)}
    rows = list(enumerate(sorted(prints)))
    classes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    found = simhash.components(simhash.links(classes, limit)).where("node.kind = 0").collect()
    groups: dict[str, set[int]] = {}
    for r in found:
        groups.setdefault(str(r.component), set()).add(r.node.bits & ((1 << 64) - 1))
    want: dict[int, set[int]] = {}
    for i, p, c in plain_components(rows, sorted(prints)):
        want.setdefault(c, set()).add(int(p, 16))
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_golay_code_is_perfect():
    import numpy as np

    draw = np.random.default_rng(2).integers(0, 1 << 23, 200)
    near = simhash.codeword_indices(draw)
    for bit in range(23):
        assert all(set(a) & set(b) for a, b in zip(near, simhash.codeword_indices(draw ^ (1 << bit)), strict=True))


def test_quality_classifier(spark, docs):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = i % 2
        rows.append((i, " ".join(draw.choice(["the", "river", "runs", "slowly."] if good else ["$$$", "BUY", "!!!", "now"]) for _ in range(draw.randint(20, 60)))))
        labels.append((i, good, 0))
    rows += [(1000, None), (1001, ""), (None, "x"), (5, "y")]
    d, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1001, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(d, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600 and r.doc_id != 5]
    assert held and sum(r.predicted == r.doc_id % 2 for r in held) > 0.95 * len(held)
    assert {r.score for r in quality_classifier.quality_scores(docs, marks.limit(0)).collect()} == {0.5}


def plain_distance(p, q):
    p, q = np.array(p), np.array(q)
    m = (p + q) / 2
    half = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return max(0.0, (half(p) + half(q)) / 2) ** 0.5


def test_quality_rules_distances_and_verdicts_against_plain_ones(spark):
    draw = random.Random(8)
    langs = {"en": "the of and to in is that for".split(), "de": "der die das und den ist ein von".split()}
    rows = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        text = prose(draw, langs[lang], draw.randint(40, 300))
        rows.append((i, text.title() if i % 7 == 0 else text + " 12, 5% # (x)! Ünï" * (i % 5), lang))
    rows += [(500, "x " * 300, "en"), (501, " ".join(f"#{k}%" for k in range(200)), "en"), (502, None, "de"), (503, prose(draw, langs["de"], 200), "en"), (504, prose(draw, langs["de"], 200), None)]
    classes = [regex.compile(c) for c in quality_rules.CLASSES]

    def histograms(text):
        w, spaces = words(text), len(re.findall(r"[\x20\x09-\x0D]", text))
        counts = [spaces, *(len(c.findall(text)) for c in classes)]
        common = [w.count(c) for c in quality_rules.COMMON_WORDS]
        n = max(1, len(text)), max(1, len(w))
        return [x / n[0] for x in [*counts, max(0, len(text) - sum(counts))]], [x / n[1] for x in [*common, len(w) - sum(common)]]

    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    hists, sound = {i: histograms(t or "") for i, t, _ in rows}, {}
    for i, t, lang in rows:
        if not got[i].base_failed and len(t) >= quality_rules.MIN_CHARS_FOR_CLASSES and got[i].n_words >= quality_rules.MIN_WORDS_FOR_COMMON:
            sound.setdefault(lang, []).append(i)
    every = [i for ids in sound.values() for i in ids]
    mean = lambda ids, kind: np.mean([hists[i][kind] for i in ids], axis=0)
    assert min(len(sound["en"]), len(sound["de"])) >= quality_rules.MIN_DOCUMENTS
    for i, t, lang in rows:
        near = plain_distance(hists[i][0], mean(sound[lang] if lang else every, 0))
        common = plain_distance(hists[i][1], mean(sound[lang], 1)) if lang else None
        assert got[i].class_distance == pytest.approx(near, abs=1e-9) and got[i].common_distance == (pytest.approx(common, abs=1e-9) if lang else None)
        odd = len(t or "") >= quality_rules.MIN_CHARS_FOR_CLASSES and near > quality_rules.MAX_CLASS_DISTANCE
        odd |= lang is not None and len(words(t)) >= quality_rules.MIN_WORDS_FOR_COMMON and common > quality_rules.MAX_COMMON_DISTANCE
        assert got[i].kept == (not got[i].base_failed and not odd), i
    assert not got[501].kept and not got[503].kept and got[504].kept


def test_isotonic_means_are_the_least_squares_ones():
    draw = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        counts, sums = draw.integers(1, 9, n).astype(float), draw.normal(size=n) * 3
        mean = lambda j, k: sums[j : k + 1].sum() / counts[j : k + 1].sum()  # noqa: E731, B023
        want = [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        assert np.allclose(quality_classifier.pooled(sums, counts), want)


def test_features_approximate_the_kernel_and_ridge_is_the_plain_one(spark):
    draw, size = np.random.default_rng(3), len(quality_classifier.STATISTICS)
    x = draw.normal(size=(300, size))
    y = (x[:, 0] > 0).astype(float)
    blank = quality_classifier.Model(np.zeros(size), np.ones(size), np.zeros(0), np.zeros(0), np.zeros(0))
    f = blank.features(x)
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality_classifier.WIDTH**2))
    assert np.abs(f[:, :-1] @ f[:, :-1].T - kernel).mean() < 0.06
    gram, right = f.T @ f, f.T @ y
    penalty = quality_classifier.RIDGE * max(1.0, np.trace(np.block([[gram, right[:, None]], [right, y @ y]])[:-1, :-1]) / len(gram)) * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    rows = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    assert np.allclose(quality_classifier._fit_ridge(rows, np.zeros(size), np.ones(size)), np.linalg.solve(gram + penalty, right), atol=1e-6)


def test_pipeline_stages_of_odd_documents(spark, tmp_path):
    """Nulls in any column, empty, long and repeated texts, and columns named like those within."""
    import corpus_pipeline

    draw = random.Random(4)
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _doc string, kept string, ids string, _salt string, `a b` string, m map<string,int>"
    rows = [(i, prose(draw, "the of and to in is that for".split(), 150), ["en", None][i % 9 == 0], ["b", "a", None][i % 3], None, "d", None, "i", "s", "c", {"k": i}) for i in range(120)]
    rows += [(200 + i, rows[i][1].upper(), *rows[i][2:]) for i in range(20)] + [rows[3], rows[3], (3, rows[4][1], *rows[3][2:])]
    rows += [(None, None, None, None, None, None, None, None, None, None, None), (None, rows[5][1], *rows[5][2:]), (300, "", *rows[0][2:]), (301, rows[6][1] + " word other" * 300_000, *rows[6][2:])]
    for name, content in (("odd", rows), ("none", [])):
        spark.createDataFrame(content, kinds).repartition(4).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            after = run(spark, docs, f"{tmp_path}/{name}")
            if k < 4:
                assert after.columns == docs.columns, stage
            else:
                assert after.columns == [c for c in docs.columns if c not in ("text", "ids")] + ["ids"]
            after.write.parquet(f"{tmp_path}/{name}/{k}")
            docs = spark.read.schema(after.schema).parquet(f"{tmp_path}/{name}/{k}")
            if k == 1:
                texts_left = [lowered(r.text) for r in docs.collect()]
                assert len(texts_left) == len(set(texts_left)) and (name == "none" or len(texts_left) > 100)
        assert docs.count() == 0 if name == "none" else docs.where("size(ids) > 0").count() == docs.count() > 100


@pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = before = spark.read.parquet(f"{TABLES}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, str(TABLES))
        assert after.columns == before.columns and 0 < after.count() <= docs.count(), name
        docs = after
    out = corpus_pipeline.run(spark, str(TABLES))
    assert "ids" in out.columns and out.where("size(ids) = 0").count() == 0


def test_packed_numbers_come_back():
    for numbers in ([], [0, 1, 127, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1, 5, 0]):
        assert blocks.unpacked(blocks.packed(np.array(numbers, np.int64))).tolist() == numbers


@pytest.mark.parametrize("kind", ["smallint", "string", "int"])
def test_token_counts_in_many_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 2000)
    path, draw = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    library = Tokenizer.from_file(path)
    # one word stands in every text and makes up half of all words
    rows = [(i, " ".join(draw.choice(["common", f"w{draw.randint(0, 300)}"]) for _ in range(50))) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("key", F.lit("clash"))
    rows_of_words = blocks.dealt(d, ["doc_id"], lambda: token_counts.PreTokens(path).of, token_counts._frequencies)
    assert rows_of_words.where("key = 'common'").count() == rows_of_words.select("block").distinct().count() > 20
    got = {int(r.doc_id): r.n_tokens for r in token_counts.token_counts(d, path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


@pytest.mark.parametrize("op", ["op2_token_counts", "op6_sentencepiece"])
def test_texts_are_split_once(spark, op):
    """The sides of the join read one exchange."""
    df = QUERIES[op](spark, str(TABLES))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") == 2


def test_decode_of_bytes_that_are_no_text(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.Model.load(path)
    a = next(i for p, i, _ in model.pieces if p == "▁a")
    rows = [(1, [model.first_byte + 0xFF, a]), (2, []), (3, None), (4, [a, a]), (5, [model.first_byte + 0xC3, model.first_byte + 0xA9])]
    got = dict(pieces.decode(spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1), path).select("k", "text").collect())
    assert got == {1: "� a", 2: "", 3: "", 4: "a a", 5: "é"}


def test_the_near_dedup_stage_goes_by_fingerprints(spark):
    """A long common part decides the fingerprint, repeats included; the sets of five-word shingles of these texts are unlike."""
    import corpus_pipeline

    texts = ["spam eggs ham " * 200 + " ".join(f"{x}{i}" for i in range(20)) for x in "ab"] + [f"another text {i}" for i in range(3)]
    prints = [simhash.fingerprint(t) for t in texts]
    assert prints[0] == prints[1] and all((p ^ q).bit_count() > 2 for p, q in combinations(prints[1:], 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == [0, 2, 3, 4]
