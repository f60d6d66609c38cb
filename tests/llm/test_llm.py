"""Training-data operators: brute force, round trips, and defined results of odd inputs."""

import glob
import gzip
import hashlib
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import exact_dedup, lm_scoring, mixing, neighbours, pieces, sharding, simhash, toxicity, url_filter, warc
from factloom.llm.common import scratch
from factloom.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, item string, key string"
ODD = [
    (1, "The cat sat", "en", "a", 11, "x", "y", "z"),
    (2, "The cat sat", "en", None, 11, None, None, None),
    (2, "The cat sat", "en", None, 11, None, None, None),
    (3, None, None, "b", None, None, None, None),
    (4, "", "en", "b", 0, None, None, None),
    (None, "no id here", "en", "a", 3, None, None, None),
    (5, "word " * 9000, "en", "c", 45000, None, None, None),
    (6, "▁ é😀\t\n  x ", "en", "c", 9, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, odd, none):
    index = exact_dedup.DigestIndex(spark, scratch(spark, "t"))
    got = index.add(odd).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == 5
    cat = [r for r in got if r.doc_id in (1, 2)]
    assert {(r.keep_id, r.group_size) for r in cat} == {(2, 3)} and sum(r.kept for r in cat) == 1
    assert {r.keep_id for r in got if r.doc_id in (3, 4)} == {4}
    again = index.add(spark.createDataFrame([(99, "The cat sat"), (98, "new")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept, r.keep_id) for r in again} == {(99, False, 2), (98, True, 98)}
    assert index.add(none).count() == 0
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == 5


def test_digest_index_goes_on(spark):
    path = scratch(spark, "again")
    docs = spark.createDataFrame([(i, f"text {i % 200}") for i in range(300)], "doc_id long, text string")
    first = exact_dedup.DigestIndex(spark, path, 8)
    once = sorted(map(tuple, first.add(docs, batch_id="b1").collect()))
    assert sum(r[3] for r in once) == 200
    first.close()
    again = exact_dedup.DigestIndex(spark, path, 5)
    assert again.buckets == 8
    assert sorted(map(tuple, again.add(docs, batch_id="b1").collect())) == once  # a retry
    assert not any(r.kept for r in again.add(docs, batch_id="b2").collect())
    small = again.compact(scratch(spark, "small"))
    assert small.rows().count() == again.rows().count() == 200
    assert not any(r.kept for r in small.add(docs).collect())
    # Nearly all rows are one text.
    hot = spark.createDataFrame([(i, "same" if i else "other") for i in range(500)], "doc_id long, text string")
    got = exact_dedup.DigestIndex(spark, scratch(spark, "hot")).add(hot).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(499, 499), (0, 1)} and len(got) == 500 and sum(r.kept for r in got) == 2


def test_sharding(spark, odd, none):
    got = sharding.shard_documents(odd, 4).toPandas()
    assert len(got) == len(ODD)
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    assert got[got.doc_id.isin([1, 2])]["shard"].nunique() == 1
    assert sharding.shard_documents(none, 4).count() == 0


def test_differencing_is_a_partition():
    sums = np.zeros((50, 5))
    sums[:, 0] = np.random.default_rng(0).integers(1, 100, 50)
    total, moved = sharding.difference(sums)
    again = np.zeros(5)
    np.add.at(again, moved[:, 0], sums[:, 0])
    assert np.array_equal(again, total) and total.max() - total.min() <= 2
    assert all(sorted(m) == list(range(5)) for m in moved)


def test_mixing(spark, odd, none):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(ODD) and (got.taken <= 2 * got["size"]).all()
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) <= 2  # each source is rounded on its own
    assert mixing.mix(none).count() == 0
    whole = mixing.mixed_documents(odd)
    assert whole.columns == odd.columns and whole.where("doc_id = 4").count() == 1


def test_url_filter(spark):
    urls = ["http://A.example.com/en/x", "http://www.example.com/en/", "http://x.net/es/1", "ftp://y.org?q", None, "nothing", "http://com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    bad = spark.createDataFrame([(3, 1), (3, 1), (77, 1), (2, None)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, bad).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1].rule == "www.example.com/en/" and got[1].verdict == "allow"
    assert got[2].rule == "net/es/" and (got[3].host, got[3].path, got[3].rule) == ("y.org", "", None)
    assert (got[4].host, got[5].path) == ("", "") and got[6].rule == "com/"
    assert url_filter.judge_urls(pages.limit(0), bad).count() == 0


def test_url_filter_blocks_by_reputation(spark):
    """No rule fits these hosts; one has only bad pages, the other none."""
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'good'}{i % 2}.org/x") for i in range(120)], "page_id long, url string")
    bad = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "page_id long, bad int")
    got = {(r.host, r.rule, r.verdict) for r in url_filter.judge_urls(pages, bad).collect()}
    assert got == {("bad0.org", None, "block"), ("bad1.org", None, "block"), ("good0.org", None, "allow"), ("good1.org", None, "allow")}


def test_url_filter_posterior(spark):
    """Five labels, three bad, one a host, block none; a planted bad host is blocked beside a clean one of its domain; rules as a table give the same."""
    pages = spark.createDataFrame([(i, f"http://h{i}.org/x") for i in range(5)], "page_id long, url string")
    bad = spark.createDataFrame([(i, int(i < 3)) for i in range(5)], "page_id long, bad int")
    assert {r.verdict for r in url_filter.judge_urls(pages, bad).collect()} == {"allow"}
    urls = [f"http://{'bad.farm.co.uk' if i % 10 == 0 else f'h{i % 10}.site{i % 3}.com'}/p{i}" for i in range(600)] + ["http://new.site1.com/", "http://x.net/es/", "http://q.example.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = spark.createDataFrame([(i, int(i % 10 == 0 or i % 100 == 7)) for i in range(600)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(pages, bad, rules=url_filter.RULES[1:]).collect()}
    assert {h for h, rule, v in got.values() if v == "block" and rule is None} == {"bad.farm.co.uk"}
    table = spark.createDataFrame(list(url_filter.RULES[1:]), "verdict string, host string, path string")
    assert {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(pages, bad, rules=table).collect()} == got
    # The grid against exact sums: Beta(a, b) over x is the chance of under a heads in a + b - 1 throws.
    for a, b, x in ((3, 4, 0.5), (30, 12, 0.5), (2, 90, 0.1), (1, 1, 0.5)):
        want = sum(math.comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a))
        own = spark.range(1).select(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")).select(url_filter.posterior_over(F.col("a"), F.col("b"), x).alias("p")).first()["p"]
        assert abs(own - want) < 2e-3


def test_warc(spark):
    long = "é<p>" * 60_000
    rows = [(1, "http://a\r\n", "x" * 2000), (5, None, "x" * 2000), (None, "u", "x" * 2000), (2, "u", None), (3, "u", ""), (4, "u", long), (4, "u", long)]
    path = scratch(spark, "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)), path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        want = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        assert r.payload_bytes == len(want) and r.payload_digest == hashlib.sha1(want).hexdigest()
    assert sorted((r.page_id or 0, r.refers_to) for r in got if r.record_type == "revisit") == [(0, 5), (1, 5)]
    chunks = [r for r in warc.read_chunks(spark, path).collect() if r.page_id == 4]
    assert len(chunks) == 2 * -(-len(long.encode()) // warc.SEGMENT) and max(len(r.bytes) for r in chunks) == warc.SEGMENT
    assert b"".join(r.bytes for r in chunks[: len(chunks) // 2]) == long.encode()
    small = scratch(spark, "w")
    ends = [(1, "u", "a\r\n"), (2, "u", "\r\n\r\nWARC/1.1\r\n"), (3, "u", "b\r"), (4, "u", "x\0y\r\n\r"), (5, "u", "€" * 9)]
    warc.write_warc(spark.createDataFrame(ends, "page_id long, url string, html string"), small, segment=4)
    assert {r.page_id: r.payload_digest for r in warc.read_warc(spark, small).collect()} == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in ends}
    files = [f for f in glob.glob(f"{small.removeprefix('file:')}/*.warc.gz")]
    assert sum(open(f, "rb").read().count(b"\x1f\x8b\x08") for f in files) >= sum(-(-len(h.encode()) // 4) for _, _, h in ends)
    assert sum(gzip.open(f).read().count(b"WARC-Type") for f in files) == sum(-(-len(h.encode()) // 4) for _, _, h in ends)
    none = scratch(spark, "w")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), none)
    assert warc.read_warc(spark, none).count() == 0


def brute_fingerprint(text, k):
    w = lm_scoring.tokens((text or "").encode())
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, odd, none):
    got = simhash.near_components(odd).collect()
    assert len(got) == len(ODD)
    for r, (_, text, *_rest) in zip(sorted(got, key=lambda r: (r.doc_id or 0)), sorted(ODD, key=lambda o: (o[0] or 0)), strict=True):
        assert r.fingerprint == f"{brute_fingerprint(text, 3):016x}"
    assert {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert simhash.near_components(none).count() == 0
    assert simhash.near_dedup(odd).columns == odd.columns


def test_spanning_forest_connects_all_links():
    rng = np.random.default_rng(3)
    fps = np.repeat(rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64), 30, axis=0)
    for row in fps:
        for bit in rng.choice(256, rng.integers(0, 40), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    rng.shuffle(fps)
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)

    def parts(links, n=len(fps)):
        root = list(range(n))
        for a, b in links:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return {frozenset(i for i in range(n) if root[i] == r) for r in root}

    found = simhash.spanning(fps, 50)
    for radius in (20, 35, 50):  # connected within every radius, as the forest is a minimum
        assert parts([f for f in found if far[f] <= radius]) == parts(list(zip(*np.nonzero(far <= radius), strict=True)))


def test_every_pair_under_a_key():
    """A and B are as close to C as to one another: a forest leaves out a pair that the texts may have to decide."""
    fps = np.zeros((5, 4), np.uint64)
    fps[1, 0], fps[2, 1] = np.uint64(0x0101010101010101), np.uint64(0x0101010101010101)
    fps[1, 2], fps[2, 3] = fps[1, 0] * np.uint64(7), fps[2, 1] * np.uint64(7)
    fps[3] = fps[1]
    fps[3, 3] ^= np.uint64(1)
    fps[4] = ~fps[0]
    links = pa.RecordBatch.from_arrays([pa.array([9] * 5), pa.array(range(5)), pa.array([f.tobytes() for f in fps], pa.binary())], ["key", "node", "fp"])
    found = [tuple(sorted(p)) for batch in simhash._meet(64, 4, 20)(iter([links])) for p in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in range(5) for b in range(a + 1, 5) if far[a, b] <= 64}


def test_near_dedup_by_similarity(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        words = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        texts.append(" ".join(words))
        for changes in (1, 4, 10, 14, 25):  # similarities of about 0.97, 0.88, 0.72, 0.63, 0.43
            other = list(words)
            for at in rng.choice(300, changes, replace=False):
                other[at] = "x"
            texts.append(" ".join(other))
    line = "one line that is repeated in both of these texts and nowhere else "
    texts += [line * 200 + " ".join(f"{side}{k}" for k in range(200)) for side in "ab"] + ["", " ", None, "tiny", "Tiny", "other"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [set(simhash.shingle_hashes(lm_scoring.tokens((t or "").encode()), 5)) for t in texts]
    alike = [[j for j in range(len(own)) if own[i] and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])] for i in range(len(own))]
    root = {r.doc_id: r.component_id for r in simhash.wide_components(df.where("trim(text) <> ''")).collect()}
    links = [(i, j) for i in range(len(own)) for j in alike[i] if j < i]
    assert sum(root[i] == root[j] for i, j in links) >= 0.97 * len(links)
    for i, top in root.items():  # whoever is in a component is like another in it
        assert top == i or any(root[j] == top for j in alike[i] if j != i)
    kept = {r.doc_id for r in simhash.near_dedup(df).collect()}
    tail = len(texts) - 8
    assert {tail, tail + 1, tail + 2, tail + 3, tail + 4, tail + 5, tail + 7} <= kept and tail + 6 not in kept


def test_ring_keys_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(2):
            fps.add(int(b) ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(1, 4), replace=False)))
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    root = {r.node: r.root for r in components(simhash.links(df)).collect()}
    values = np.array(sorted(fps), np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(v ^ values) <= 3):
            assert i == j or root[int(v)] == root[int(values[j])]


@pytest.mark.parametrize("most", [8, 60])
def test_hot_keys_lose_no_link(spark, most):
    """Half of the rows are equal in three segments of four: their keys are split by further segments, then into blocks."""
    rng = np.random.default_rng(4)
    loose = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    tight = (rng.integers(0, 6, 150, dtype=np.uint64) << np.uint64(40)) | np.uint64(0x0000_0012_3456_789A)
    fps = set(loose.tolist()) | {int(t) ^ sum(1 << int(i) for i in rng.choice(60, rng.integers(0, 4), replace=False)) for t in tight.tolist()}
    values = np.array(sorted(fps), np.uint64)
    root = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(int(v),) for v in values], "fp long"), most=most)).collect()}
    near = [(i, j) for i, v in enumerate(values) for j in np.flatnonzero(np.bitwise_count(v ^ values) <= 3) if j < i]
    assert len(near) > 100
    own = list(range(len(values)))
    for i, j in near:
        own = [own[j] if x == own[i] else x for x in own]
    assert all((root.get(int(values[i]), i) == root.get(int(values[j]), j)) == (own[i] == own[j]) for i in range(len(values)) for j in range(i))


def test_meet_passes_full_keys_on():
    """Whole, however they are cut into batches; the rows of other keys are compared."""
    fps = [np.array([v], np.uint64).tobytes() for v in (1, 3, 7, 15, 31, 1, 3)]
    keys = pa.array([1, 1, 1, 1, 1, 2, 2])
    rows = pa.record_batch([keys, pa.array(range(7)), pa.array(fps, pa.binary())], ["key", "node", "fp"])
    for size in (1, 2, 3, 7):
        out = list(simhash._meet(3, 1, None, 4)(rows.slice(i, size) for i in range(0, 7, size)))
        got = [r for batch in out for r in batch.to_pylist()]
        assert sorted((r["a"], r["key"], r["fp"]) for r in got if r["b"] is None) == [(i, 1, fps[i]) for i in range(5)]
        assert [{r["a"], r["b"]} for r in got if r["b"] is not None] == [{5, 6}]


def test_near_dedup_finds_pairs_near_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.85, also where keys are split into blocks."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(150):
        words = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        other = list(words)
        for at in rng.choice(np.arange(5, 295, 6), 6, replace=False):
            other[at] = "x"
        texts += [" ".join(words), " ".join(other)]
    own = [set(simhash.shingle_hashes(t.encode().split(), 5)) for t in texts]
    alike = [i for i in range(0, 300, 2) if 0.8 <= len(own[i] & own[i + 1]) / len(own[i] | own[i + 1]) <= 0.85]
    assert len(alike) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = [{r.doc_id: r.component_id for r in simhash.wide_components(df, how=how).collect()} for how in ({}, {"most": 2})]
    assert sum(roots[0][i] == roots[0][i + 1] for i in alike) >= 0.96 * len(alike)
    assert roots[0] == roots[1]


def test_near_copies_make_no_pairs_as_rows(spark, monkeypatch):
    """A group of near copies, no two of them close enough to be sure, is joined with rows in proportion to its size."""
    rng = np.random.default_rng(13)
    base, n, made = [f"w{x}" for x in rng.integers(0, 10**6, 200)], 240, []
    texts = []
    for i in range(n):
        words = list(base)
        for k, at in enumerate(rng.choice(200, 2, replace=False)):
            words[at] = f"x{i}-{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = simhash._linked

    def counted(*args, **named):
        found = linked(*args, **named)
        made.append(found.count())
        return found

    monkeypatch.setattr(simhash, "_linked", counted)
    for how in ({}, {"most": 160}):
        assert {r.component_id for r in simhash.wide_components(df, how=how).collect()} == {0}
    assert made[0] <= 128 * n


@pytest.mark.parametrize("across", [False, True])
def test_connected_against_brute_force(across):
    rng = np.random.default_rng(17)
    sets = [np.unique(rng.choice(12, rng.integers(1, 12))).astype(np.uint64) for _ in range(60)]
    roots, sides = rng.integers(0, 40, 60), rng.integers(0, 2, 60).astype(bool)
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    wanted = [(roots[i], roots[j]) for i in range(60) for j in range(i) if (not across or sides[i] != sides[j]) and jaccard(sets[i], sets[j]) >= 0.8]

    def classes(pairs):
        top = {x: x for x in roots}
        for a, b in pairs:
            top = {x: top[a] if t == top[b] else t for x, t in top.items()}
        return {frozenset(x for x in top if top[x] == t) for t in top.values()}

    found = simhash.connected(roots, sides if across else None, sets, 0.8)
    assert classes(found) == classes(wanted)
    assert len(found) < 40


def test_small_keys_are_compared_together(monkeypatch):
    rng = np.random.default_rng(6)
    keys = np.sort(rng.integers(0, 3000, 12_000))
    fps = rng.integers(0, 2**64, (len(keys), 4), dtype=np.uint64)
    near = np.flatnonzero((keys[1:] == keys[:-1]) & (rng.random(len(keys) - 1) < 0.2))
    for i in near:
        fps[i + 1] = fps[i] ^ np.uint64(1 << int(i % 64))
    rows = pa.record_batch([pa.array(keys), pa.array(np.arange(len(keys))), pa.array([f.tobytes() for f in fps], pa.binary())], ["key", "node", "fp"])
    alone = []
    spanning = simhash.spanning
    monkeypatch.setattr(simhash, "spanning", lambda own, radius: alone.append(len(own)) or spanning(own, radius))
    found = {(a, b) for x in simhash._meet(56, 4, None, 8192)(iter([rows])) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
    # One by one only where there are more links than a forest has.
    assert len(alone) < 300
    top = list(range(len(keys)))
    for a, b in sorted(found):
        assert keys[a] == keys[b] and np.bitwise_count(fps[a] ^ fps[b]).sum() <= 56
        top[b] = min(top[a], top[b])
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    assert all(top[i] == top[i + 1] for i in near) and len(near) <= len(found) <= len(keys) - len(first)


def test_bits_of_most_hashes():
    rng = np.random.default_rng(7)
    lengths = np.array([0, 1, 2, 3, 0, 4, 5, 16, 17, 300, 40_000])
    hashes = rng.integers(0, 2**64, lengths.sum(), dtype=np.uint64)
    hashes[::2] |= np.uint64(0xFF)
    words = [hashes, *(simhash._mixed(hashes, np.array([w]))[:, 0] for w in (1, 2))]
    ends = np.cumsum(lengths)
    for w, own in enumerate(words):
        counts = [[sum((own[e - n : e] >> np.uint64(i)) & np.uint64(1)) for i in range(64)] for e, n in zip(ends, lengths, strict=True) if n < 1000]
        wanted = [sum(1 << i for i, c in enumerate(row) if 2 * int(c) > n) for row, n in zip(counts, lengths, strict=False)]
        assert simhash.fold(hashes, lengths, 3)[: len(wanted), w].tolist() == wanted
    bits = np.unpackbits(hashes[-40_000:].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) > 20_000
    assert np.packbits(bits, bitorder="little").view(np.uint64)[0] == simhash.fold(hashes, lengths, 3)[-1, 0]


def test_features_that_a_chain_knows():
    texts = ["", "Bad, BAD words!", "worded wo wor", "naïve Ünder_score x*4", "sword 1234567"]
    vocabulary = sorted(set().union(*map(toxicity.features, texts[:4])))
    chain = toxicity.Chain(vocabulary, [])
    for text in texts:
        assert sorted(chain.known(text)) == sorted(vocabulary.index(f) for f in toxicity.features(text) if f in vocabulary)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    root = {r.node: r.root for r in components(edges).collect()}
    assert {root[i] for i in range(61)} == {0} and root[101] == 100


def test_components_of_few_edges_take_no_rounds(spark, tmp_path):
    rng = np.random.default_rng(5)
    order = [int(x) for x in rng.permutation(400)]
    edges = spark.createDataFrame([*zip(order, order[1:], strict=False), (500, 501), (502, 500), (9, 9), (None, 3)], "a long, b long").repartition(40)
    context = spark.sparkContext
    kept = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        found = components(edges).collect()
        assert len(list(tmp_path.glob("*/rdd-*"))) == 1
    finally:
        if kept:
            context.setCheckpointDir(kept)
    wanted = {i: 0 for i in range(400)} | {i: 500 for i in (500, 501, 502)}
    assert len(found) == len(wanted) and {r.node: r.root for r in found} == wanted
    assert {r.node: r.root for r in components(edges, held=100).collect()} == wanted
    words = edges.select(*[F.col(c).cast("string") for c in ("a", "b")])
    assert {int(r.node): int(r.root) for r in components(words).collect()} == wanted


def test_lm_scores_are_log_probabilities(spark, odd, none):
    docs = [b"abab abc", b"abc abd", b"bca bca bca"]
    v = np.sort(lm_scoring.grams(docs, 2)[0])
    counts, totals = [], []
    for i in range(3):
        k, n = np.unique(v & np.uint64((1 << (8 * (i + 1))) - 1), return_counts=True)
        c, o = np.unique(k >> np.uint64(8), return_inverse=True)
        counts.append((k, n.astype(float)))
        totals.append((c, np.bincount(o, n)))
    model = lm_scoring.Model(counts, totals)
    for ctx in (b"ab", b"zz", b"cz", b"za"):
        every = np.array([(ctx[0] << 16) | (ctx[1] << 8) | s for s in range(256)], np.uint64)
        assert abs((10 ** model.scores(every)).sum() - 1) < 1e-9
    got = {r.doc_id: r for r in lm_scoring.score_documents(odd, F.coalesce(F.col("doc_id") == 1, F.lit(False))).collect()}
    assert len(got) == 7 and got[1].held_out and got[1].n_tokens == 4 and got[1].n_known == 4
    words = [w for i, t, *_ in ODD if i != 1 for w in [*lm_scoring.tokens((t or "").encode()), None]]
    n, vocabulary = len(words), len(set(words))
    assert got[1].train_tokens == n
    want = sum(np.log10((words.count(w) + 1) / (n + vocabulary + 1)) for w in [b"the", b"cat", b"sat", None])
    assert abs(got[1].base_score - want) < 1e-9
    assert lm_scoring.score_documents(none, F.lit(False)).count() == 0


def test_lm_keeps_every_gram(spark):
    """What is broadcast doesn't change the scores: those of the trie of all grams."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'ab' * int(k % 3)}{k}" for k in rng.integers(0, 60, rng.integers(1, 40))) for _ in range(60)] + ["", "zq"]
    docs = [b" ".join(lm_scoring.tokens(t.encode())) for t in texts]
    v = lm_scoring.grams([d for i, d in enumerate(docs) if i % 4], lm_scoring.ORDER)[0]
    counts, totals = [], []
    for i in range(lm_scoring.ORDER + 1):
        k, n = np.unique(v & np.uint64((1 << (8 * (i + 1))) - 1), return_counts=True)
        c, o = np.unique(k >> np.uint64(8), return_inverse=True)
        counts.append((k, n.astype(float)))
        totals.append((c, np.bincount(o, n)))
    want = lm_scoring.Model(counts, totals).score(docs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for nodes in (1 << 24, 16):
        got = {r.doc_id: r.score for r in lm_scoring.score_documents(df, F.col("doc_id") % 4 == 0, nodes=nodes).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, rtol=0, atol=1e-9)


def test_lm_counts_in_bounded_memory():
    """Texts without repeated grams, all in one batch: neither what is held nor what is handed on at once grows with them."""
    rng = np.random.default_rng(19)
    texts = [rng.integers(97, 123, 50_000, np.uint8).tobytes() for _ in range(240)]
    batch = pa.record_batch([pa.array([i % 3 > 0 for i in range(240)]), pa.array(texts, pa.binary())], ["learnt", "text"])
    sums, most = np.zeros(3, np.int64), 0
    tracemalloc.start()
    try:
        for out in lm_scoring._count(lm_scoring.ORDER)(iter([batch])):
            most = max(most, out.num_rows)
            sums += [len(out) - out["word"].null_count, pc.sum(out["n"].filter(out["gram"].is_valid())).as_py() or 0, pc.sum(out["times"]).as_py() or 0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sums.tolist() == [160, 160 * 50_001, 240 * 50_001]
    assert peak < 400e6
    assert most <= 1 << 16


def test_lm_scores_against_brute_force(spark):
    """Prediction by partial matching by dictionaries: n - 1/2 for what a context has seen, the halves escape, seen symbols are excluded below."""
    rng = np.random.default_rng(7)
    texts = [" ".join("".join(rng.choice(list("abcé"), rng.integers(1, 6))) for _ in range(rng.integers(0, 12))) for _ in range(40)] + ["", "zzz a"]
    docs = [b" ".join(lm_scoring.tokens(t.encode())) for t in texts]
    order, seen = lm_scoring.ORDER, {}
    for i, doc in enumerate(docs):
        line = lm_scoring.PAD * order + doc + lm_scoring.END
        for at in range(order, len(line)) if i % 4 else ():
            for k in range(order + 1):
                own = seen.setdefault(line[at - k : at], {})
                own[line[at]] = own.get(line[at], 0) + 1

    def chance(context, symbol):
        p, out = 1.0, set()
        for k in range(order, -1, -1):
            left = {s: n for s, n in seen.get(context[len(context) - k :], {}).items() if s not in out}
            if left and symbol in left:
                return p * (left[symbol] - 0.5) / sum(left.values())
            if left:
                p *= len(left) / 2 / sum(left.values())
                out |= left.keys()
        return p / (256 - len(seen[b""]))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(df, F.col("doc_id") % 4 == 0).collect()}
    for i, doc in enumerate(docs):
        line = lm_scoring.PAD * order + doc + lm_scoring.END
        want = sum(np.log10(chance(line[at - order : at], line[at])) for at in range(order, len(line)))
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_differencing_against_brute_force(spark):
    """Two lists at a time, the widest first, added largest to smallest."""
    rng = np.random.default_rng(2)
    for n, k in ((1, 4), (7, 3), (60, 5)):
        sizes = rng.integers(1, 1000, n)
        nodes = {i: sorted([int(v)] + [0] * (k - 1), reverse=True) for i, v in enumerate(sizes)}
        for number in range(n, 2 * n - 1):
            a, b = sorted(nodes, key=lambda i: (nodes[i][-1] - nodes[i][0], i))[:2]
            nodes[number] = sorted((x + y for x, y in zip(nodes.pop(a), reversed(nodes.pop(b)), strict=True)), reverse=True)
        sums = np.zeros((n, k))
        sums[:, 0] = sizes
        total, _ = sharding.difference(sums)
        assert total.max() - total.min() == next(iter(nodes.values()))[0] - next(iter(nodes.values()))[-1]
    docs = spark.createDataFrame([(i, "x" * int(v)) for i, v in enumerate(rng.integers(1, 3000, 2000))], "doc_id long, text string")
    shards = sharding.shard_documents(docs, 8).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(shards) == 8 and shards.max() - shards.min() <= 8


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (None, x[0].tolist()), (904, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    assert set(got.query_id) == set(range(0, 400, 50)) and (got.groupby("query_id").size() == 5).all()
    assert got[(got.query_id == 0) & (got["rank"] == 1)].vec_id.item() == 904
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 400, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
    assert hits / 39 >= 0.9  # the copy 904 takes one place
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        words = [f"w{k}" for k in rng.integers(0, 50, 20)]
        toxic = i % 4 == 0
        rows.append((i, " ".join(words + ["Scum!"] * toxic), int(rng.random() < 0.8), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    chain = toxicity.fit_on_labels(docs.select("doc_id", "text"), docs.where("doc_id < 300").select("doc_id", "quality", "toxic"))
    got = toxicity.predict(docs, chain, toxicity.CHAIN).join(docs, "doc_id").where("doc_id >= 300").collect()
    assert np.mean([(r.p_toxic >= 0.35) == (r.toxic == 1) for r in got]) > 0.98
    kept = toxicity.drop_toxic(odd, chain)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    blank = toxicity.fit_on_labels(none, docs.limit(0).select("doc_id", "quality", "toxic"))
    assert {r.p_toxic for r in toxicity.predict(odd, blank, toxicity.CHAIN).collect()} == {0.0}


def test_chain_against_brute_force():
    """Weights of the chain against plain gradient descent on dense matrices; the second model sees the first's out-of-fold probabilities."""
    rng = np.random.default_rng(4)
    x = (rng.random((120, 8)) < 0.4).astype(float)
    labels = np.stack([x[:, 0] + rng.random(120) > 0.9, x[:, 1] + x[:, 0] + rng.random(120) > 1.2], axis=1).astype(int)
    fold = np.arange(120) % toxicity.FOLDS

    def descend(d, y):
        d = np.c_[d, np.ones(len(d))]
        w, keep = np.zeros(d.shape[1]), np.r_[np.full(d.shape[1] - 1, toxicity.L2), 0.0]
        for _ in range(40):  # Newton's steps
            p = 1 / (1 + np.exp(-d @ w))
            w -= np.linalg.solve((d.T * (p * (1 - p))) @ d + np.diag(keep), d.T @ (p - y) + keep * w)
        return w

    def chance(d, w):
        return 1 / (1 + np.exp(-(np.c_[d, np.ones(len(d))] @ w)))

    first = descend(x, labels[:, 0])
    out = np.zeros(120)
    for f in range(toxicity.FOLDS):
        out[fold == f] = chance(x[fold == f], descend(x[fold != f], labels[fold != f, 0]))
    second = descend(np.c_[x, out], labels[:, 1])
    want = np.c_[chance(x, first), chance(np.c_[x, chance(x, first)], second)]
    rows, index = np.nonzero(x)
    chain = toxicity.train_chain(toxicity.Entries(np.bincount(rows, minlength=120), index, 50), labels, fold, [f"f{i}" for i in range(8)])
    got = chain.probabilities([index[rows == i].tolist() for i in range(120)])
    assert np.abs(got - want).max() < 0.01


@pytest.mark.parametrize("giant,chunk", [(10**6, 4096), (20, 17), (20, 5)])
def test_pieces(spark, odd, none, giant, chunk):
    """Ids are the library's, whole or by chunks; a text's own mark is the one difference, as it must come back."""
    own = pieces.Pieces.load()
    texts = [o[1] or "" for o in ODD] + ["日本語のテキスト" * 9, "a" * 90, " ▁ \n\n é ", "it is  so", " " * 40 + "x", "ab" * 200 + " q  ", "1234567890" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encode_documents(df, giant=giant, chunk=chunk).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i, t in enumerate(texts):
        assert got[i].decoded and own.decode(got[i].token_ids) == t
        if "▁" not in t:
            assert got[i].token_ids == sp.encode(t)
        assert got[i].n_tokens == len(got[i].token_ids)
        assert got[i].score == pytest.approx(sum(sp.get_score(x) for x in got[i].token_ids))
    assert pieces.encode_documents(odd).count() == len(ODD) and pieces.encode_documents(none).count() == 0
    assert {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(df)).collect()} == dict(enumerate(texts))


def test_pieces_equal_the_library_on_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = pieces.encode_documents(docs, giant=4000).collect()
    assert len(got) == len(text) and all(r.token_ids == sp.encode(text[r.doc_id]) for r in got)


def test_pieces_walks_join_only_where_alike():
    """In a text without spaces a chunk's matrix agrees with walks that go on alone from each state."""
    own = pieces.Encoder(pieces.Pieces.load())
    rng = np.random.default_rng(0)
    text = " " + "".join(rng.choice(list("abehilnorst"), 600))
    wide = own.pieces.longest
    chunk = pieces.Chunk(own, text[100 - wide : 400 + wide], wide, 300)
    alone = np.full(chunk.matrix().shape, -np.inf)
    for i, (_, end, token) in enumerate(chunk.entries):
        alone[i] = chunk._leave(pieces.Walk(own.pieces, chunk.text, end, token, chunk.hi))
    assert np.array_equal(alone, chunk.matrix()) and (alone > -np.inf).any() and len(chunk.entries) > 1


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.where("NOT decoded").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
