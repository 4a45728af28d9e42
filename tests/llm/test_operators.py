"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and columns
whose names clash with those it makes."""

from __future__ import annotations

import json
import random
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from quireflow.llm import archives, bpe, jaccard, pii, preferences, quality, registry, repetition, store, suffixes, winnow
from quireflow.llm import words as W

WORDS = "ab cd ef gh ij kl mn op".split()
SCHEMA = "doc_id long, text string, k string, g int, groups string, __gone long, __bad_id long, bucket int, n_chars long"


def texts(seed: int, n: int, most: int = 40, words: list[str] = WORDS) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, most))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, 4, len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture
def odd(spark):
    """Nulls, an empty text, white space only, repeated rows, copies, and a long text."""
    long = " ".join(f"w{i}" for i in range(60_000))
    same = " ".join(f"s{i}" for i in range(80))
    return frame(spark, [(1, same), (1, same), (2, None), (None, same), (None, None), (3, ""), (4, " \n\t "), (5, long), (6, same + " and the end"), (7, "...")])


@pytest.fixture
def none(spark):
    return frame(spark, [])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SMALL), duck, registry.ORACLES[name])


# 1


def test_repeats_by_brute_force():
    for t in texts(1, 300, 60, WORDS[:4]):
        w, least = t.split(), 3
        covered, longest = set(), 0
        for i in range(len(w)):
            for j in range(i):
                n = 0
                while i + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                if n >= least:
                    covered |= {*range(i, i + n), *range(j, j + n)}
                    longest = max(longest, n)
        got = repetition.measure(pa.array([t]), least)
        assert [int(x[0]) for x in got] == [len(w), len(covered), longest]
        offsets, codes = repetition.tokens(pa.array([t]))
        if len(codes):
            order, common = repetition.suffixes(offsets, codes, least)
            found = {}
            for depth, a, b, _ in repetition.intervals(order, common, codes, offsets):
                spans = sorted(order[a:b].tolist())
                assert len({tuple(w[p : p + depth]) for p in spans}) == 1
                found[tuple(w[spans[0] : spans[0] + depth])] = spans
            assert found == maximal(w, least)


def maximal(w: list[str], least: int) -> dict:
    """The repeats that can't be made longer without losing an occurrence, with their places."""
    where: dict = {}
    for n in range(least, len(w)):
        for p in range(len(w) - n + 1):
            where.setdefault(tuple(w[p : p + n]), []).append(p)
    sides = lambda ps, at: len({w[q] if 0 <= (q := at(p)) < len(w) else p - len(w) - 1 for p in ps})
    return {g: ps for g, ps in where.items() if len(ps) > 1 and sides(ps, lambda p: p - 1) > 1 and sides(ps, lambda p: p + len(g)) > 1}  # noqa: B023


def test_long_words_are_words_and_unspaced_scripts_are_split(spark):
    url = "https://example.org/" + "x" * 100
    rows = {r.doc_id: r for r in repetition.repetition(frame(spark, [(1, f"{url} and {url}"), (2, "漢字仮名交じり文章の例" * 2 + "end")])).collect()}
    assert (rows[1].n_words, rows[1].longest_repeat, rows[1].keep) == (3, 0, True)
    assert (rows[2].n_words, rows[2].covered_words, rows[2].longest_repeat) == (23, 22, 11)


def test_repeats_of_one_word_take_no_square_time():
    count, covered, longest = repetition.measure(pa.array(["a " * 50_000, "x y " * 20_000]), 10)
    assert covered.tolist() == count.tolist() == [50_000, 40_000] and longest.tolist() == [49_999, 39_998]


def test_repetition_of_odd_rows(odd, none):
    rows = repetition.repetition(odd).collect()
    assert len(rows) == 10 and all(r.keep for r in rows) and {r.n_words for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert repetition.repetition(none).count() == 0


def test_repetition_rejects_a_loop(spark):
    loop = "one two three four five six seven eight nine ten eleven " * 30
    rows = repetition.repetition(frame(spark, [(1, loop)])).collect()
    assert not rows[0].keep and rows[0].covered_fraction == 1.0 and rows[0].longest_repeat == 29 * 11


# 2


def test_quality_on_labels_not_seen(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scored = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    kept = lambda f: np.mean([r.keep for r in scored if f(r)])
    assert kept(lambda r: r.quality == 1 and r.toxic == 0) >= 0.96
    assert kept(lambda r: r.quality == 0) <= 0.05
    assert kept(lambda r: r.toxic == 1) <= 0.4  # a third of them has no word that tells


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labels).count() == 10
    assert quality.kept(odd, labels).columns == odd.columns
    assert quality.classify(none, labels).count() == 0
    rows = quality.classify(odd, labels.limit(0)).collect()
    assert all(r.keep and r.score == 0 for r in rows)


def test_prior_is_found():
    rng = np.random.default_rng(3)
    positive, rest = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 1200), rng.normal(-2, 1, 2800)])
    assert abs(quality.best_bin(positive, *np.unique(rest, return_counts=True)) - 0.3) < 0.06


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_risk_and_gradient_by_brute_force(prior):
    rng = np.random.default_rng(5)
    p = np.arange(40) % 3 == 0
    z = rng.normal(2.0 * p - 1, 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def parts(z):  # by the definition: the loss of a row with score z and label y is sigmoid(-y * z)
        positive = np.mean([sigmoid(-x) for x in z[p]])
        negative = np.mean([sigmoid(x) for x in z[~p]]) - prior * np.mean([sigmoid(x) for x in z[p]])
        return prior * positive, negative

    total, negative = parts(z)
    value, grad = quality.risk(z, p, prior)
    assert value == pytest.approx(total + max(0, negative)) and value >= 0 and (negative < 0) == (prior == 0.9)
    # below 0 the step goes up the risk of the negatives, else down the whole risk
    goal = (lambda z: sum(parts(z))) if negative >= 0 else lambda z: -parts(z)[1]
    for i in range(len(z)):
        step = np.zeros(len(z))
        step[i] = 1e-6
        assert grad[i] == pytest.approx((goal(z + step) - goal(z - step)) / 2e-6, abs=1e-6)


def test_counts_are_those_of_all_documents(spark):
    rows = list(enumerate(texts(21, 300)))
    counts, n = quality._all_counts(frame(spark, rows).repartition(5))
    want = np.zeros(quality.BINS, np.int64)
    for _, t in rows:
        np.add.at(want, quality.features(pa.array([t])).bins, 1)
    assert n == 300 and counts.tolist() == want.tolist()


def test_a_long_labelled_text_is_fitted(spark):
    long = " ".join(f"w{i % 7919}" for i in range(300_000))
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(frame(spark, [(0, long), (1, "fine words here"), (2, "idiot"), (3, "more words"), (4, None)]), labels).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3, 4]


# 3


def test_preferences_by_brute_force(spark):
    rng = random.Random(2)
    sides: list[list] = [[], []]
    for pair in range(60):
        shared = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "a<|b"])) for _ in range(rng.randint(0, 4))]
        for side in sides:
            turns = shared + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no"])) for _ in range(rng.randint(0, 3))]
            side += [(pair, i, r, t, "x") for i, (r, t) in enumerate(turns)]
            side += side[-1:] if turns else []
    schema = "pair_id long, turn long, role string, text string, side string"
    a, b = (spark.createDataFrame([*side, (None, 0, "user", "x", "x")], schema) for side in sides)
    got = {r.pair_id: r for r in preferences.paired(a, b).collect()}

    def turns(side, pair):
        return [(r or "user", (t or "").replace("<|", "< |")) for _, _, r, t, _ in sorted({x for x in side if x[0] == pair}, key=lambda x: x[1])]

    for pair in {r[0] for r in sides[0] + sides[1]}:
        x, y = turns(sides[0], pair), turns(sides[1], pair)
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        show = lambda ts: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts)
        r = got[pair]
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) == (n, show(x[:n]), show(x[n:]), show(y[n:]))
        for mask, rest, own in ((r.chosen_mask, r.chosen, x), (r.rejected_mask, r.rejected, y)):
            assert [(r.prompt + rest)[m.start : m.end] for m in mask] == [t + "<|im_end|>" for role, t in own[n:] if role == "assistant"]
    assert preferences.paired(a.limit(0), b.limit(0)).count() == 0


# 4


def warc(uri: str, body: bytes) -> bytes:
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_archives(spark, tmp_path):
    records = [warc(f"u:{i}", bytes([65 + i]) * (i * 100)) for i in range(5)]

    def make(name, method=zipfile.ZIP_STORED, lines="", wide=False):
        with zipfile.ZipFile(tmp_path / name, "w", method) as z:
            with z.open("archive/a.warc", "w", force_zip64=wide) as f:
                f.write(b"".join(records))
            if lines:
                z.writestr("indexes/index.cdxj", lines)
        return str(tmp_path / name)

    at = len(records[0]) + len(records[1])
    indexed = make("i.wacz", lines=f'com,u)/ 2024 {json.dumps(dict(filename="a.warc", offset=at, length=len(records[2])))}\ncom 2024 {json.dumps(dict(filename="a.warc", offset=3, length=9))}', wide=True)
    (tmp_path / "no.wacz").write_bytes(b"not a ZIP file")
    (tmp_path / "cut.wacz").write_bytes(open(indexed, "rb").read()[:-60])
    paths = [make("whole.wacz"), indexed, make("packed.wacz", zipfile.ZIP_DEFLATED), str(tmp_path / "no.wacz"), str(tmp_path / "cut.wacz"), str(tmp_path / "absent.wacz"), None]
    got: dict = {}
    for r in archives.read(spark, spark.createDataFrame([(p, 1) for p in paths], "path string, member int")).collect():
        got.setdefault(r.path.rpartition("/")[2], []).append(r)
    assert sorted((r.uri, bytes(r.content)) for r in got["whole.wacz"]) == [(f"u:{i}", bytes([65 + i]) * (i * 100)) for i in range(5)]
    assert sorted((r.uri, len(r.content)) for r in got["i.wacz"] if not r.error)[-3:] == [("u:2", 200), ("u:3", 300), ("u:4", 400)] and any(r.error for r in got["i.wacz"])
    assert all(r.error and r.content is None for n in ("packed.wacz", "no.wacz", "cut.wacz", "absent.wacz") for r in got[n])
    assert archives.read(spark, spark.createDataFrame([], "path string")).count() == 0


def test_archives_of_odd_lines_and_lengths(spark, tmp_path):
    good = warc("u:good", b"x" * 50)
    odd = [b"WARC/1.0\r\nWARC-Target-URI: u:odd\r\nContent-Length: %s\r\n\r\nxx\r\n\r\n" % n for n in (b"abc", b"-5")]
    lines = [dict(filename="a.warc", offset=o, length=n) for o, n in ((0, len(good)), (10**9, 5), (-4, 9), (3, 0))] + [dict(filename="a.warc", offset=None, length=1), dict(offset=1, length=1)]
    at = len(good)
    for o in odd:
        lines.append(dict(filename="a.warc", offset=at, length=len(o)))
        at += len(o)
    with zipfile.ZipFile(tmp_path / "odd.wacz", "w") as z:
        z.writestr("archive/a.warc", b"".join([good, *odd, warc("u:unnamed", b"y")]))
        z.writestr("archive/sub/a.warc", warc("u:other", b"z" * 10_000_000))
        z.writestr("indexes/index.cdxj", "\n".join(f"com 2024 {json.dumps(x)}" for x in lines) + "\ncom 2024 {broken")
    path = str(tmp_path / "odd.wacz")
    rows = archives.read(spark, spark.createDataFrame([(path,), (path,)], "path string")).collect()
    assert sorted(r.uri for r in rows if not r.error) == ["u:good"] * 2 + ["u:other"] * 2 + ["u:unnamed"] * 2
    assert sum(bool(r.error) for r in rows) == 2 * 8 and all(r.content is None for r in rows if r.error)


def test_true_zip64_records(spark, tmp_path):
    """An archive whose sizes, place of the directory and number of members stand in ZIP64 fields only."""
    body = warc("u:wide", b"w" * 30)
    name, wide, none = b"archive/a.warc", struct.pack("<HHQQ", 1, 16, len(body), len(body)), 0xFFFFFFFF
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(body), none, none, len(name), len(wide)) + name + wide + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(body), none, none, len(name), len(extra), 0, 0, 0, 0, none) + name + extra
    end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(entry), 1)
    (tmp_path / "wide.wacz").write_bytes(local + entry + end + locator + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, none, none, 0))
    rows = archives.read(spark, spark.createDataFrame([(str(tmp_path / "wide.wacz"),)], "path string")).collect()
    assert [(r.uri, bytes(r.content)) for r in rows] == [("u:wide", b"w" * 30)]


# 5


def test_bpe_is_that_of_the_whole_text(spark):
    rng = random.Random(4)
    alphabet = list("abcXYZ019 .,'-!\n\t\r") + ["é", "ß", "İ", "中", "😀", " ", " ", "'s", "'LL", "<|endoftext|>", "  "]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    whole = bpe.encoder(bpe.RANKS)
    ids, count = whole.encode(pa.array(made))
    ends = np.cumsum(count)
    for t, a, b in zip(made, ends - count, ends):
        assert ids[a:b].tolist() == whole.encoding.encode_ordinary(t), repr(t)


def test_bpe_round_trip(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    encoded = bpe.encode(docs)
    assert encoded.where("NOT exact").count() == 0
    assert bpe.decode(encoded).exceptAll(docs.select("doc_id", "text")).count() == 0
    rows = bpe.encode(odd).collect()
    assert len(rows) == 10 and {r.token_ids for r in [x for x in rows if x.doc_id == 2]} == {None} and [r.n_tokens for r in rows if r.doc_id == 3] == [0]
    assert bpe.encode(none).count() == 0


# 6


@pytest.mark.parametrize("text,kind", [
    ("write to jo.doe+x@mail.example.org today", "email"), ("card 4111 1111 1111 1111 ok", "card"), ("IBAN GB82 WEST 1234 5698 7654 32.", "iban"), ("ssn 123-45-6789", "ssn"),
    ("call +49 30 1234567 now", "phone"), ("host 10.20.30.40 is up", "ip"), ('api_key = "a1b2c3d4e5f6g7h8"', "secret"),
])
def test_pii_is_found(text, kind):
    assert [s[0] for s in pii.spans(text)] == [kind]
    assert f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize("text", ["card 4111 1111 1111 1112 no", "IBAN GB83 WEST 1234 5698 7654 32", "version 1.2.3.4", "order 123-45-6789", "10.20.30.400", "a@b", "in 2024 there were 1500", ""])
def test_what_is_no_pii(text):
    assert pii.spans(text) == []


def test_pii_prefilter_and_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted((r.doc_id, *s) for r in docs.collect() for s in pii.spans(r.text or ""))
    assert sorted(tuple(r) for r in pii.find(docs).collect()) == want and want
    clean = {r.doc_id: r for r in pii.redacted(docs).collect()}
    for r in docs.collect():
        assert clean[r.doc_id].text == pii.redact(r.text) and clean[r.doc_id].n_chars == len(clean[r.doc_id].text)
    assert sorted(map(repr, pii.redacted(odd).collect())) == sorted(map(repr, odd.collect()))
    assert pii.find(none).count() == 0


# 7


def test_store(spark, odd, none, tmp_path):
    encoded = bpe.encode(odd, check=False)
    path = str(tmp_path / "store")
    store.write(encoded, path)
    rows = store.verify(spark, path).collect()
    assert len(rows) == 10 and all(r.verified for r in rows)
    ids = lambda df: sorted({repr((r.doc_id, r.token_ids)) for r in df.collect()})
    assert ids(store.rebuild(spark, path)) == ids(encoded)
    root = store.root(spark.read.parquet(f"{path}/manifest"))
    store.write(encoded, str(tmp_path / "again"))
    assert store.root(spark.read.parquet(f"{tmp_path}/again/manifest")) == root
    # a chunk is changed: documents that have it fail
    chunks = spark.read.parquet(f"{path}/chunks").toPandas()
    other = str(tmp_path / "other")
    chunks.loc[0, "data"] = bytes(len(chunks.loc[0, "data"]))
    spark.createDataFrame(chunks, "digest binary, n_ids int, data binary").write.parquet(f"{other}/chunks")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{other}/recipes")
    assert 0 < sum(not r.verified for r in store.verify(spark, other).collect()) < 10
    store.write(bpe.encode(none), str(tmp_path / "none"))
    assert store.verify(spark, str(tmp_path / "none")).count() == 0


def test_store_misses_recipes_and_sees_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "IN_BUCKET", 1)
    monkeypatch.setattr(store, "FANOUT", 2)
    docs = [(i, t) for i, t in enumerate(texts(6, 6, 400)) if t]
    path = f"{tmp_path}/store"
    store.write(bpe.encode(frame(spark, docs), check=False), path, width=2)
    manifest = spark.read.parquet(f"{path}/manifest")
    recipes = spark.read.parquet(f"{path}/recipes").toPandas()
    checked = lambda at: {r.doc_id: r.verified for r in store.verify(spark, at, manifest).collect()}
    assert checked(path) == {i: True for i, _ in docs}
    for level in {r.level for r in manifest.collect()}:
        other = manifest.withColumn("root", F.when(F.col("level") == level, F.lit("0")).otherwise(F.col("root")))
        assert not any(r.verified for r in store.verify(spark, path, other).collect())

    def changed(name, made):
        spark.read.parquet(f"{path}/chunks").write.parquet(f"{tmp_path}/{name}/chunks")
        spark.createDataFrame(made, spark.read.parquet(f"{path}/recipes").schema).write.parquet(f"{tmp_path}/{name}/recipes")
        return checked(f"{tmp_path}/{name}")

    lost, other, stream = recipes[1:], recipes.copy(), recipes.copy()
    gone = int(recipes.doc_id[0])
    assert changed("lost", lost) == {**{i: True for i, _ in docs if i != gone}, None: False}
    for c in ("n_ids", "digests", "root", "stream"):
        other.at[0, c] = recipes.at[1, c]
    assert changed("other", other) == {i: i != gone for i, _ in docs}
    stream.loc[0, "stream"] += 1
    assert changed("stream", stream) == {i: i != gone for i, _ in docs}


def test_chunks_by_a_naive_rolling_hash(spark):
    rng, mask = np.random.default_rng(2), (1 << 64) - 1
    streams = [rng.integers(0, 300, n).tolist() for n in (0, 1, 31, 33, 900, 5000)] + [[7] * 4000]

    def cut(ids):
        ends, at = [], 0
        mixed = [int(W.mix(np.array([i + 1], np.uint64))[0]) for i in ids]
        for end in range(1, len(ids) + 1):
            value = sum(x * pow(W.BASE, k, mask + 1) for k, x in enumerate(mixed[max(0, end - store.WINDOW) : end])) & mask
            low = int(W.mix(np.array([value], np.uint64))[0]) & ((1 << store.BITS) - 1)
            if end == len(ids) or end - at == store.MOST or (end - at >= store.LEAST and end >= store.WINDOW and low == 0):
                ends.append(end)
                at = end
        return ends

    offsets = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    ends, counts = store.edges(np.array([i for s in streams for i in s]), offsets)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, s in enumerate(streams):
        assert (ends[at[k] : at[k + 1]] - offsets[k]).tolist() == cut(s)


def test_a_very_long_stream_is_stored_and_rebuilt(spark, tmp_path):
    ids = np.random.default_rng(3).integers(0, 50_000, 2_000_000).tolist()
    encoded = spark.createDataFrame([(1, ids), (1, ids)], "doc_id long, token_ids array<int>")
    store.write(encoded, f"{tmp_path}/long", width=2)
    assert [r.verified for r in store.verify(spark, f"{tmp_path}/long", spark.read.parquet(f"{tmp_path}/long/manifest")).collect()] == [True, True]
    assert store.rebuild(spark, f"{tmp_path}/long", width=2).first().token_ids == ids


def test_chunks_follow_the_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50_000, 20_000)
    b = np.concatenate([[7, 8, 9], a])
    cut = lambda x: {tuple(x[i:j]) for i, j in zip([0, *store.edges(x, np.array([0, len(x)]))[0][:-1]], store.edges(x, np.array([0, len(x)]))[0])}
    assert len(cut(a) & cut(b)) >= 0.9 * len(cut(a)) and max(map(len, cut(a))) <= store.MOST


# 8


def spanned(rows: list[tuple[int, str]], least: int) -> list[tuple]:
    """The spans of repeated passages, by comparing all places."""
    where: dict = {}
    for i, t in set(rows):
        w = t.split()
        for p in range(len(w) - least + 1):
            where.setdefault(tuple(w[p : p + least]), set()).add((i, p))
    places = sorted({x for xs in where.values() if len(xs) > 1 for x in xs})
    later = {(i, p + k) for xs in where.values() if len(xs) > 1 for i, p in sorted(xs)[1:] for k in range(least)}
    spans: list[list[int]] = []
    for i, p in places:
        if spans and spans[-1][0] == i and p <= spans[-1][2]:
            spans[-1][2] = p + least
        else:
            spans.append([i, p, p + least])
    return [(i, a, b, b - a, sum((i, k) in later for k in range(a, b))) for i, a, b in spans]


@pytest.mark.parametrize("most_sent", [suffixes.MOST_SENT, 0])
@pytest.mark.parametrize("least,start", [(6, 3), (7, 3), (13, 2), (13, 1), (12, 5)])
def test_passages_by_brute_force(spark, monkeypatch, least, start, most_sent):
    """Of one to four rounds; with copies, a repeated row and an id with two texts."""
    monkeypatch.setattr(suffixes, "MOST_SENT", most_sent)
    rows = list(enumerate(texts(8, 25, 40, WORDS[:5]) + texts(12, 15, 60, WORDS[:2])))
    rows += [(100 + i, rows[i % 3][1]) for i in range(9)] + [(200, rows[5][1]), (3, rows[6][1]), (201, " ".join(WORDS * 9)), (202, " ".join(WORDS * 9)), (203, " ".join(WORDS * 9))]
    docs = frame(spark, rows + [rows[3]])
    got = suffixes.passages(docs, least, start, 2).collect()
    own = {r.doc_id: r.text for r in docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()}
    want = spanned(list(own.items()), least)
    assert want and sorted(tuple(r) for r in got) == sorted(want)


def test_rounds_of_doubling_are_in_the_plan(spark):
    places = spark.createDataFrame([], "r1 int, r2 int, doc_id long, place int")
    plan = suffixes._doubled(places, "bigint", suffixes.LEAST, suffixes.START)._jdf.queryExecution().analyzed().toString()
    assert plan.count("RepartitionByExpression [r1") >= 2 and suffixes.LEAST > 2 * suffixes.START


def test_passages_of_odd_rows(odd, none):
    rows = {r.doc_id: r for r in suffixes.passages(odd).collect()}
    assert set(rows) == {1, 6} and (rows[6].span_start, rows[6].span_end, rows[6].later_words, rows[1].later_words) == (0, 80, 80, 0)
    assert suffixes.passages(none).count() == 0


# 9


@pytest.mark.parametrize("most_bytes", [winnow.MOST_BYTES, -1])
def test_winnowing_by_brute_force(spark, most_bytes):
    docs, items = list(enumerate(texts(9, 60, 30))), list(enumerate(texts(10, 10, 30)))
    k, window = 2, 3
    want = set()
    for i, a in docs:
        for j, b in items:
            x, y = a.split(), b.split()
            for p in range(len(x)):
                for q in range(len(y)):
                    if p and q and x[p - 1] == y[q - 1]:
                        continue
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= window + k - 1:
                        want.add((i, j, p, p + n, n))
    bench = spark.createDataFrame([(j, t, 1) for j, t in items] + [(None, None, 1), (99, "", 1)], "item_id long, text string, doc_id int")
    frames = frame(spark, docs + docs[:2])
    assert {tuple(r) for r in winnow.shared(frames, bench, k, window, most_bytes).collect()} == want
    kept = {r.doc_id for r in winnow.decontaminated(frames, bench, k, window, most_bytes).collect()}
    assert kept == {i for i, _ in docs} - {w[0] for w in want}


@pytest.mark.parametrize("most_bytes", [winnow.MOST_BYTES, -1])
def test_winnowing_of_odd_rows(spark, odd, none, most_bytes):
    bench = spark.createDataFrame([(1, " ".join(f"S{i}!" for i in range(10, 40)))], "item_id long, text string")
    rows = winnow.shared(odd, bench, most_bytes=most_bytes).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words) for r in rows) == [(-1, 30), (1, 30), (6, 30)]
    assert winnow.decontaminated(odd, bench, most_bytes=most_bytes).columns == odd.columns
    assert winnow.shared(none, bench, most_bytes=most_bytes).count() == 0 and winnow.shared(odd, bench.limit(0), most_bytes=most_bytes).count() == 0


@pytest.mark.parametrize("most_bytes", [winnow.MOST_BYTES, -1])
def test_decontamination_is_by_row(spark, most_bytes):
    leak = " ".join(f"b{i}" for i in range(30))
    clean = [(None, "clean one"), (None, None), (None, ""), (1, "clean two"), (1, None), (2, " ".join(f"c{i}" for i in range(30))), (2, "x"), (2, "x")]
    bench = spark.createDataFrame([(None, leak)], "item_id long, text string")
    rows = winnow.decontaminated(frame(spark, [(None, leak), (1, leak + " end"), (2, leak), (2, leak), (3, leak), *clean]), bench, most_bytes=most_bytes).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in rows) == sorted(map(repr, clean))


# 10


def near(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 50))] for _ in range(40)]
    rows = []
    for w in base:
        rows.append(w)
        for _ in range(rng.randint(0, 3)):
            copy = list(w)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def grams(text: str) -> frozenset:
    w = text.split()
    return frozenset([tuple(w)] if len(w) < 3 else zip(w, w[1:], w[2:])) if w else frozenset()


def linked(rows: list[tuple[int, str]], threshold: float) -> dict[int, tuple[int, int, int]]:
    """class_id, copies and n_links of each document that has a link, by comparing all pairs."""
    rows_ = {(i, grams(t)) for i, t in rows}
    links: dict = {}
    top = {i: i for i, _ in rows_}

    def least(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in rows_:
        for j, y in rows_:
            if i < j and x and y and len(x & y) / len(x | y) >= threshold:
                for own, other in ((i, j), (j, i)):
                    copies, n = links.get(own, (0, 0))
                    links[own] = (copies + (x == y), n + 1)
                a, b = least(i), least(j)
                top[max(a, b)] = min(a, b)
    return {i: (least(i), *v) for i, v in links.items()}


def crowd(seed: int, n: int = 60) -> list[str]:
    """Near copies of one text, from slightly to much changed."""
    rng = random.Random(seed)
    base = [f"c{rng.randrange(400)}" for _ in range(80)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"c{rng.randrange(400)}"
        out.append(" ".join(copy[: rng.choice([60, 80, 80, 80])]))
    return out


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.9])
@pytest.mark.parametrize("crowds", [4, 1 << 30])
def test_links_by_brute_force(spark, monkeypatch, threshold, crowds):
    monkeypatch.setattr(jaccard, "CROWD", crowds)
    rows = near(int(threshold * 10))
    rows += [(1000 + i, t) for i, t in enumerate(crowd(1) + crowd(2))] + [(2000 + i, rows[i % 4][1]) for i in range(12)] + [(3000, crowd(1)[0])]
    frames = frame(spark, rows + rows[:3])
    want = linked(rows, threshold)
    got = [tuple(r) for r in jaccard.links(frames, 3, threshold).collect()]
    assert {i: tuple(r) for i, *r in got} == want and len(got) == len(want)
    kept = {r.doc_id for r in jaccard.deduplicated(frames, 3, threshold).collect()}
    assert kept == {i for i, _ in rows} - {i for i, (least, *_) in want.items() if i != least}


def test_pivots_are_used(spark):
    rows = list(enumerate(crowd(3, 200)))
    order = jaccard._order(frame(spark, rows), 3, 0.6)
    s = jaccard.sets(pa.array([t for _, t in rows]), 3)
    assert len(order.pivots.keys) and (jaccard.tags(s, order.pivots, 80) >= 0).mean() > 0.4
    keys = {k: i for i, k in enumerate(s.keys.view(np.int64).tolist())}
    whole = [grams(t) for _, t in rows]
    for x, tag in zip(whole, jaccard.tags(s, order.pivots, 80).tolist()):
        if tag >= 0:
            y = whole[keys[int(order.pivots.keys[tag >> 8])]]
            assert tag & 255 == -int(-200 * len(x ^ y) // len(x | y))


@pytest.mark.parametrize("most_sent", [jaccard.MOST_SENT, 0])
def test_links_of_odd_rows(odd, none, monkeypatch, most_sent):
    monkeypatch.setattr(jaccard, "MOST_SENT", most_sent)
    assert sorted(tuple(r) for r in jaccard.links(odd).collect()) == [(1, 1, 0, 1), (6, 1, 0, 1)]
    kept = jaccard.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 7]
    assert jaccard.links(none).count() == 0 and jaccard.deduplicated(none).count() == 0


def test_rows_that_share_an_id_only_are_kept(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (2, one + " end"), (2, two), (2, three), (2, three), (3, two), (4, None), (4, "..."), (4, None), (5, "x y z"), (5, "X, y z"), (None, one)]
    want = [(1, one), (2, two), (2, three), (4, None), (4, "..."), (5, "X, y z"), (None, one)]
    for order in (rows, rows[::-1]):
        assert sorted(repr((r.doc_id, r.text)) for r in jaccard.deduplicated(frame(spark, order)).collect()) == sorted(map(repr, want))


def test_hashes_are_those_of_any_batch():
    words = pa.array(["a", "bc", "", "é", "a"])
    assert W.hashes(words).tolist() == [int(W.hashes(words.slice(i, 1))[0]) for i in range(5)]


# the pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "personal_data", "encoding"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, at, SMALL).toPandas(), docs.schema)
        assert after.columns == docs.columns and 0 < after.count() <= at.count()
        if name == "near_duplicates":
            assert jaccard.links(after).count() == 0
        if name == "decontamination":
            assert winnow.shared(after, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
        if name == "personal_data":
            assert pii.find(after).count() == 0
        at = after
    got = corpus_pipeline.run(spark, SMALL)
    assert bpe.decode(got).exceptAll(at.select("doc_id", "text")).count() == 0 and got.count() == at.count()


def test_pipeline_of_nothing(spark, odd, tmp_path):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for name, rows in (("odd", odd), ("none", odd.limit(0))):
        base = f"{tmp_path}/{name}"
        rows.select("doc_id", "text", "n_chars", "k").write.parquet(f"{base}/documents.parquet")
        labels.limit(0).write.parquet(f"{base}/labels.parquet")
        spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{base}/benchmark.parquet")
        assert corpus_pipeline.run(spark, base).count() == (8 if name == "odd" else 0)
