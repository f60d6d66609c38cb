"""SimHash near-dedup with pigeonring filtering.

Fingerprints. Every shingle of words is hashed by XXH64 (seed 42); a bit is 1 if it is
set in over half of the hashes. Wider fingerprints take further words derived from
each hash.

Links at up to ``radius`` of 64 bits, all of them. A fingerprint is a ring of 8
segments of 8 bits. If two fingerprints differ in at most 3 bits, the pigeonring
principle gives a segment from which the differences of every chain of l segments are
at most 3 l / 8: none in the first two, at most one in the first five, at most two in
the first seven. So the first two and some two of the next three are equal: these 32
bits, for each start and choice, are the index's keys (24 rows a fingerprint). What
meets under a key must pass the chains of its start before the full check.

Links of wide fingerprints, by similarity. No chain of a wide radius is selective
alone; chains of consecutive equal segments are taken as keys at many places (each
20 bits of 5 segments), and pairs that meet must pass the pigeonring of the sketch:
some start whose chains stay within their share of the radius. A pair at the least
similarity meets with probability over 0.99 (see README). Pairs
whose sketches are very close are links. The others are candidates: what they connect comes together
with its sets of shingles, a row a document, and the Jaccard similarity decides every pair
there that isn't connected by then.

Equal fingerprints are one node, so copies never meet as pairs. Rows come sorted by
key. Only a minimum spanning forest of a key's links is given out, which connects what the
links within any smaller radius connect, candidates as well.

Hot keys. A task holds at most ``most`` rows of a key; the rows of a fuller key are passed on. Of 64 bits, two
fingerprints within the radius that are equal in a key's 4 segments are equal in one of the other 4 as well (pigeonhole), so
these rows are keyed anew by the key and each of those. What is still too full, and wide fingerprints, are dealt into
blocks, and each two blocks meet in a group of their own: no pair is lost, and no task holds more than two blocks.

Defined results: null and empty texts have no shingles and fingerprint zero; a text of
fewer words than a shingle is one shingle; null ids never are a component's id unless
all its ids are null; repeated rows have one result each; an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, fresh, scratch
from factloom.llm.graph import components
from factloom.llm.lm_scoring import tokens

SHINGLE = 3
RADIUS = 3
#: Words of fingerprints that are counted at once, to stay in the cache.
LANES = 1 << 18
#: The two segments of the next three that are equal.
CHOICES = ((2, 3), (2, 4), (3, 4))

#: Rows of a key up to which all keys of one size are compared together.
FEW = 24
#: Rows of one key that a task compares; fuller keys are split.
MOST = 8192
#: The pipeline's: words a shingle, words of 64 bits, keys of so many bits, words of the sketch, bits in which it may
#: differ, bits up to which the texts needn't be compared, least similarity, rows of a key. Of 256 bits, 39 (deviation 6) differ at 0.8.
WIDE = {"shingle": 5, "words": 40, "key_bits": 20, "sketch": 4, "radius": 56, "sure": 20, "least": 0.8, "most": MOST}
#: Ids (of documents to compare) that may be broadcast; more are joined by merging.
BROADCAST_IDS = 500_000
#: Bytes of shingle sets that meet in one task.
HELD = 1 << 24


def shingle_hashes(words: list[bytes], k: int) -> list[int]:
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    runs = zip(*(words[i:] for i in range(k)), strict=False)
    return [xxhash.xxh64_intdigest(x, 42) for x in map(b" ".join, runs)]


def fold(hashes: np.ndarray, lengths: np.ndarray, words: int = 1) -> np.ndarray:
    """(documents, words) of uint64: bits set in over half of a document's hashes."""
    out = np.zeros((len(lengths), words), np.uint64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    lo = 0
    while lo < len(order):
        # As many documents of like length as stay in the cache, or one, then its words in parts.
        n = lengths[order[lo:]]
        hi = lo + max(1, int(np.searchsorted(n * np.arange(1, len(n) + 1) * words, LANES, "right")))
        own, most = order[lo:hi], int(lengths[order[hi - 1]])
        place = np.arange(most)[:, None]
        held = place < lengths[own]
        h = hashes[np.where(held, starts[own] + place, 0)]
        some = words if hi > lo + 1 else max(1, LANES // most)
        least = (lengths[own] // 2 + 1).astype(np.uint64)
        for w in range(0, words, some):
            x = _mixed(h, np.arange(w, min(w + some, words)))
            x[~held] = 0
            out[own, w : w + some] = _reach(_planes(x), least[:, None])
        lo = hi
    return out


def _planes(x: np.ndarray) -> list[np.ndarray]:
    """How often each bit is set along the first axis, in binary digits, lowest first (carry-save adders)."""
    planes = []
    while len(x):
        carries = []
        while len(x) > 1:
            k = len(x) // 3
            if not k:
                carries.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
                continue
            a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            x = np.concatenate([ab ^ c, x[3 * k :]])
        planes.append(x[0])
        x = np.concatenate(carries) if carries else x[:0]
    return planes


def _reach(planes: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """The bits whose count, in planes of binary digits, is at least ``least``."""
    out = np.full_like(planes[0], 0xFFFFFFFFFFFFFFFF)
    for digit, plane in enumerate(planes):
        wanted = np.where(least >> np.uint64(digit) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        out = (plane & ~wanted) | (~(plane ^ wanted) & out)
    return out


def _mixed(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The words of each hash, as a last axis: word 0 is the hash itself, others are derived from it (the finaliser of splitmix64)."""
    x = h[..., None] + words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    if words[0] == 0:
        x[..., 0] = h
    return x


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, words: int = 1, repeats: bool = True) -> DataFrame:
    """(doc_id, fp binary of 8 * words bytes, little-endian words), one row per row of docs; shingles count as often as they occur, or once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            hashes: list[int] = []
            lengths: list[int] = []
            start = 0

            def out(stop: int) -> pa.RecordBatch:
                fps = fold(np.array(hashes, np.uint64), np.array(lengths, np.int64), words)
                hashes.clear()
                lengths.clear()
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), len(fps), [None, pa.py_buffer(np.ascontiguousarray(fps).tobytes())])
                return pa.record_batch([ids.slice(start, stop - start), raw.cast(pa.binary())], ["doc_id", "fp"])

            for i, text in enumerate(texts):
                found = shingle_hashes(tokens(text.as_py() or b""), shingle)
                found = found if repeats else list(set(found))
                hashes += found
                lengths.append(len(found))
                if len(hashes) > 400_000 or len(lengths) >= 4000:
                    yield out(i + 1)
                    start = i + 1
            if start < len(texts):
                yield out(len(texts))

    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, fp binary")


def ring_ok(differ: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """differ: (pairs, segments of the ring) differing bits. Whether some start's chains all stay within radius * l / segments."""
    m = differ.shape[1]
    ring = np.concatenate([differ, differ[:, : m - 1]], axis=1)
    sums = np.concatenate([np.zeros((len(ring), 1), np.int64), np.cumsum(ring, axis=1)], axis=1)
    ok = np.zeros(len(differ), bool)
    for start in range(m):
        fits = np.ones(len(differ), bool)
        for length in range(1, m + 1):
            fits &= (sums[:, start + length] - sums[:, start]) * m <= radius * length
        ok |= fits
    return ok


def segments(x: np.ndarray) -> np.ndarray:
    """Differing bits by segment of the ring: 8 bits wide for one word, 16 for more."""
    wide = np.uint8 if x.shape[1] == 1 else np.uint16
    return np.bitwise_count(np.ascontiguousarray(x).view(wide).reshape(len(x), -1)).astype(np.int16)


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of fingerprints (rows of uint64 words) are within radius: all chains first, then all bits."""
    parts = segments(a ^ b)
    out = np.zeros(len(a), bool)
    left = np.flatnonzero(pair_ok(parts, radius))
    left = left[ring_ok(parts[left].astype(np.int64), a.shape[1] * 64, radius)]
    out[left] = parts[left].sum(axis=1) <= radius
    return out


def pair_ok(differ: np.ndarray, radius: int) -> np.ndarray:
    """The chains of one and of two segments only."""
    m = differ.shape[1]
    return ((differ * m <= radius) & ((differ + np.roll(differ, -1, axis=1)) * m <= 2 * radius)).any(axis=1)


def spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A minimum spanning forest of the links among fps (Prim), in memory that grows with their number only."""
    best = np.full(len(fps), radius + 1)
    by = np.zeros(len(fps), np.int64)
    left = np.arange(1, len(fps))
    at, found = 0, []
    while len(left):
        parts = segments(fps[left] ^ fps[at])
        hits = np.flatnonzero(pair_ok(parts, radius))
        bits = parts[hits].sum(axis=1)
        closer = bits < best[left[hits]]
        hits = left[hits[closer]]
        best[hits], by[hits] = bits[closer], at
        pick = int(np.argmin(best[left]))
        at = int(left[pick])
        if best[at] <= radius:
            found.append((int(by[at]), at))
        left = np.delete(left, pick)
    return found


def every_pair(fps: np.ndarray, radius: int, sure: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In blocks, the pairs of fps within radius, but of those that links within ``sure`` connect only a spanning forest of such links."""
    forest = np.array(spanning(fps, sure), np.int64).reshape(-1, 2)
    root = np.arange(len(fps))
    for a, b in forest:
        root[root == root[a]] = root[b]
    yield forest[:, 0], forest[:, 1]
    held: list[np.ndarray] = []
    size = 0
    for at in range(len(fps) - 1):
        other = at + 1 + np.flatnonzero(root[at + 1 :] != root[at])
        if not len(other):
            continue
        # Not near(): each pair is to be found that spanning() takes for a link.
        parts = segments(fps[other] ^ fps[at])
        hits = np.flatnonzero(pair_ok(parts, radius))
        hits = other[hits[parts[hits].sum(axis=1) <= radius]]
        held.append(np.stack([np.full(len(hits), at), hits]))
        size += len(hits)
        if size > 100_000:
            yield tuple(np.concatenate(held, axis=1))
            held.clear()
            size = 0
    if held:
        yield tuple(np.concatenate(held, axis=1))


def _meet(radius: int, sketch: int, sure: int | None = None, most: int | None = None):
    """Streams rows (key, node, fp) sorted by key; gives links (a, b, bits that differ) of nodes that meet under a key.

    A spanning forest of them, or with ``sure`` those of every_pair(). Rows of keys that have more than ``most`` are given
    back instead: a is the node, b null, key and fp their own.
    """
    names = ["a", "b", "bits", "key", "fp"]

    def back(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        n = len(keys)
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * sketch), n, [None, pa.py_buffer(np.ascontiguousarray(fps).tobytes())])
        return pa.record_batch([pa.array(nodes), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(keys), raw.cast(pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros(0, np.int64)
        nodes = np.zeros(0, np.int64)
        fps = np.zeros((0, sketch), np.uint64)
        hot = None  # the key whose rows are being passed on

        def links(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[first, len(keys)])
            if most is not None:
                full = (size > most) | (keys[first] == hot) if hot is not None else size > most
                for start, n in zip(first[full], size[full], strict=True):
                    yield back(keys[start : start + n], nodes[start : start + n], fps[start : start + n])
                first, size = first[~full], size[~full]
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            alone = size > 1  # groups to be gone through one by one
            for n in np.unique(size[size <= FEW]) if sure is None else (2,):
                same = np.flatnonzero(size == n)
                alone[same] = False
                i, j = np.triu_indices(n, 1)
                for lo in range(0, len(same) * (n > 1), max(1, 200_000 // max(1, len(i)))):
                    part = same[lo : lo + max(1, 200_000 // max(1, len(i)))]
                    left, right = (first[part][:, None] + x for x in (i, j))
                    ok = near(fps[left.ravel()], fps[right.ravel()], radius).reshape(left.shape)
                    many = ok.sum(axis=1) >= n  # more links than a forest has
                    alone[part[many]] = True
                    ok[many] = False
                    a.append(left[ok])
                    b.append(right[ok])

            def out() -> pa.RecordBatch:
                i, j = np.concatenate(a), np.concatenate(b)
                a.clear()
                b.clear()
                bits = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1).astype(np.int32)
                return pa.record_batch([pa.array(nodes[i]), pa.array(nodes[j]), pa.array(bits), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.binary())], names)

            for start, n in zip(first[alone], size[alone], strict=True):
                own = fps[start : start + n]
                if sure is None:
                    some = iter([np.array(spanning(own, radius), np.int64).reshape(-1, 2).T])
                else:
                    some = every_pair(own, radius, sure)
                for i, j in some:
                    a.append(i + start)
                    b.append(j + start)
                    if sum(map(len, a)) > 100_000:
                        yield out()
            if a:
                yield out()

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(2).cast(pa.binary(8 * sketch))
            own = np.frombuffer(raw.buffers()[1], np.uint64)[raw.offset * sketch : (raw.offset + len(raw)) * sketch].reshape(-1, sketch)
            keys, nodes, fps = np.r_[keys, batch.column(0).to_numpy()], np.r_[nodes, batch.column(1).to_numpy()], np.concatenate([fps, own])
            end = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if end:
                yield from links(keys[:end], nodes[:end], fps[:end])
                keys, nodes, fps = keys[end:], nodes[end:], fps[end:]
            if most is not None and (len(keys) > most or keys[0] == hot):
                hot = int(keys[0])
                yield back(keys, nodes, fps)
                keys, nodes, fps = keys[:0], nodes[:0], fps[:0]
        if len(keys):
            yield from links(keys, nodes, fps)

    return run


def ring_keys(fp) -> list:
    """The 24 keys of a 64-bit fingerprint (long column): table number and 32 bits."""
    segment = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for start in range(8):
        for c, (x, y) in enumerate(CHOICES):
            key = F.lit(start * 3 + c).cast("long")
            for at in (0, 1, x, y):
                key = F.shiftleft(key, 8).bitwiseOR(segment[(start + at) % 8])
            keys.append(key)
    return keys


def finer_keys(key, fp):
    """Of a key of ring_keys() and a fingerprint (long columns): the key with each of the 4 segments that it leaves out."""
    others = [[(start + at) % 8 for at in range(2, 8) if at not in choice] for start in range(8) for choice in CHOICES]
    left = F.element_at(F.array(*[F.array(*map(F.lit, own)) for own in others]), (F.shiftrightunsigned(key, 32) + 1).cast("int"))
    value = lambda i: F.call_function("shiftrightunsigned", fp, 8 * i).bitwiseAND(F.lit(255))
    return F.transform(left, lambda i: F.xxhash64(key, i, value(i)))


def links(nodes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """nodes: (fp long), distinct. Links (a, b) that connect all within radius (at most 3)."""
    if radius > 3:
        raise ValueError("the keys hold every link up to 3 bits")
    rows = nodes.select(F.explode(F.array(*ring_keys(F.col("fp")))).alias("key"), F.col("fp").alias("node"))
    return _linked(rows.withColumn("fp", _little(F.col("node"))), radius, 1, finer=finer_keys, most=most)


def _little(x):
    """The 8 bytes of a long, lowest first."""
    digits = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))


def _linked(rows: DataFrame, radius: int, sketch: int, sure: int | None = None, finer=None, most: int = MOST) -> DataFrame:
    """Links (a, b, bits) of rows (key, node, fp) that meet under a key; keys of more than ``most`` rows are split, by ``finer`` first."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def met(rows: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
        dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "node")
        both = cut(dealt.select("key", "node", "fp").mapInArrow(_meet(radius, sketch, sure, most), "a long, b long, bits int, key long, fp binary"))
        return both.where("b IS NOT NULL").select("a", "b", "bits"), both.where("b IS NULL").select("key", F.col("a").alias("node"), "fp")

    found, hot = met(rows, most)
    if finer is not None and not hot.isEmpty():
        more, hot = met(hot.select(F.explode(finer(F.col("key"), F.col("node"))).alias("key"), "node", "fp"), most)
        found = found.unionByName(more)
    if not hot.isEmpty():
        sizes = cut(hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, most // 2))).cast("int").alias("blocks")))
        few = sizes.count() <= BROADCAST_IDS
        dealt = hot.join(F.broadcast(sizes) if few else sizes.hint("merge"), "key")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        more, _ = met(dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "fp"), None)
        found = found.unionByName(more)
    return found


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    hashed = fingerprints(docs, id_col, text_col, shingle)
    big = F.concat(*[F.substring(F.hex("fp"), i, 2) for i in range(15, 0, -2)])
    rows = cut(hashed.select("doc_id", F.lower(big).alias("fingerprint")))
    # Two halves, as a signed long has no room for 64 unsigned bits.
    half = lambda at: F.conv(F.substring("fingerprint", at, 8), 16, 10).cast("long")
    rows = rows.withColumn("fp", F.shiftleft(half(1), 32).bitwiseOR(half(9)))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fp"), radius))
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(tops, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fingerprint", "component_id")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, top, root, n, hashes) of the documents in wanted (id, top, root): their distinct shingles' hashes, sorted, 8 bytes each."""
    few = wanted.count() <= BROADCAST_IDS
    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own = [np.unique(np.array(shingle_hashes(tokens(t.as_py()), shingle), np.uint64)) for t in part.column(3)]
                yield pa.record_batch([*part.columns[:3], pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "top", "root", "n", "hashes"])

    found = texts.join(F.broadcast(wanted) if few else wanted.hint("merge"), "id").select("id", "top", "root", "text")
    return cut(found.mapInArrow(run, "id long, top long, root long, n long, hashes binary"))


def connected(roots: np.ndarray, sides: np.ndarray | None, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect the roots whose sets have a Jaccard similarity of at least ``least``, a spanning forest; every pair is
    decided (with sides: of different sides) that isn't connected by then."""
    n = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(n) - n
    names, top = np.unique(roots, return_inverse=True)
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    out = []
    for i in range(len(n) - 1):
        ok = (top[i + 1 :] != top[i]) & (np.minimum(n[i + 1 :], n[i]) >= least * np.maximum(n[i + 1 :], n[i]))
        if sides is not None:
            ok &= sides[i + 1 :] != sides[i]
        others = i + 1 + np.flatnonzero(ok)
        if not len(others):
            continue
        mine = flat[starts[i] : starts[i] + n[i]]
        mark[mine] = 1
        if len(others) <= 16:
            common = np.array([mark[flat[starts[j] : starts[j] + n[j]]].sum() for j in others])
        else:
            lo = others[0]
            common = np.add.reduceat(mark[flat[starts[lo] :]], starts[lo:] - starts[lo])[others - lo]
        mark[mine] = 0
        for t in np.unique(top[others[common >= least * (n[i] + n[others] - common)]]):
            out.append((int(names[top[i]]), int(names[t])))
            top[top == t] = top[i]
    return out


def _connect(least: float, across: bool):
    """Streams rows (key, root, side, hashes) sorted by key; gives the links (a, b) of roots that connected() finds under a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        links: list[tuple[int, int]] = []

        def decide() -> None:
            roots, sides = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in (1, 2))
            sets = [np.frombuffer(h.as_py(), np.uint64) for x in held for h in x.column(3)]
            held.clear()
            if len(sets) > 1:
                links.extend(connected(roots, sides if across else None, sets, least))

        def out() -> pa.RecordBatch:
            done = pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
            links.clear()
            return done

        last = None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            for start, end in zip(first, np.r_[first[1:], len(keys)].astype(int), strict=True):
                if held and keys[start] != last:
                    decide()
                last = keys[start]
                held.append(batch.slice(start, end - start))
            if len(links) > 10_000:
                yield out()
        if held:
            decide()
        yield out()

    return run


def decided(sets: DataFrame, least: float, most: int) -> DataFrame:
    """sets: rows of shingle_sets(), top being a component of candidates and root one of sure links in it. Links (a, b) of
    roots, enough to connect all that hold a pair of similarity ``least`` within their component of candidates.

    A component is decided in one task, where its sets meet without being paired as rows. One of more than ``most`` rows, or
    HELD bytes, is dealt into blocks by chance, twice anew; if roots are left to connect, each two blocks meet as well.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(most)), F.ceil(F.sum("n") * 8 / F.lit(HELD))).cast("int")
    sizes = cut(sets.groupBy("top").agg(blocks.alias("blocks")))
    rows = sets.where("n > 0").join(_dealt(sizes), "top")

    def met(rows: DataFrame, key, side, across: bool) -> DataFrame:
        dealt = rows.select(key.alias("key"), "root", side.alias("side"), "hashes").repartition(parts, "key").sortWithinPartitions("key", "root")
        return dealt.mapInArrow(_connect(least, across), "a long, b long")

    held = None
    for salt in (7, 8, None):
        own = F.pmod(F.xxhash64(F.lit(salt or 9), "id"), F.col("blocks")).cast("int")
        if salt is None:
            meet = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
            found = met(meet, F.xxhash64("top", F.least("own", "other"), F.greatest("own", "other")), F.col("own") < F.col("other"), True)
            # And what shares a block of this dealing.
            found = found.unionByName(met(rows, F.xxhash64("top", own), F.lit(False), False))
        else:
            found = met(rows, F.xxhash64("top", own), F.lit(False), False)
        held = cut(found if held is None else held.unionByName(found))
        crowded = sizes.where("blocks > 1")
        if salt is None or crowded.isEmpty():
            break
        # Go on with the crowded components that have several roots left.
        now = cut(components(held))
        named = sets.select("top", "root").distinct().join(_dealt(crowded), "top").join(now.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left")
        named = cut(named.select("top", "root", "blocks", F.coalesce("least", "root").alias("least")))
        several = named.groupBy("top").agg(F.min("least").alias("x"), F.max("least").alias("y")).where("x <> y").select("top")
        left = cut(named.join(several, "top", "left_semi"))
        if left.isEmpty():
            break
        rows = sets.where("n > 0").join(_dealt(left), ["top", "root"]).drop("root").withColumnRenamed("least", "root")
    return held


def _dealt(small: DataFrame) -> DataFrame:
    """To be joined: broadcast if it has few rows."""
    return F.broadcast(small) if small.count() <= BROADCAST_IDS else small.hint("merge")


def _chain_keys(words: int, width: int, sketch: int):
    """Streams rows (fp, node); gives (key, node, sketch) for each of a fingerprint's chains of 4-bit segments, ``width`` bits long."""
    tables = words * 64 // width
    value = 2.0 ** np.arange(width - 1, -1, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n = part.num_rows
                raw = np.frombuffer(b"".join(x.as_py() for x in part.column(0)), np.uint8).reshape(n, 8 * words)
                bits = np.unpackbits(raw, axis=1)[:, : tables * width].reshape(n, tables, width)
                keys = (bits @ value).astype(np.int64) | np.arange(tables, dtype=np.int64) << width
                short = np.repeat(raw[:, : 8 * sketch], tables, axis=0)
                fps = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * sketch), n * tables, [None, pa.py_buffer(short)])
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(part.column(1).to_numpy(), tables)), fps.cast(pa.binary())], ["key", "node", "fp"])

    return run


def wide_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: dict | None = None) -> DataFrame:
    """One row per row of docs: node (the least id of its fingerprint), component_id; for similarities over a wide radius."""
    how = WIDE | (how or {})
    words, width, sketch = how["words"], how["key_bits"], how["sketch"]
    rows = cut(fingerprints(docs, id_col, text_col, how["shingle"], words, repeats=False))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"))
    dealt = nodes.select("fp", "node").mapInArrow(_chain_keys(words, width, sketch), "key long, node long, fp binary")
    # Of each key a minimum spanning forest: its links within any radius connect what all pairs within it connect.
    found = cut(_linked(dealt, how["radius"], sketch, most=how["most"]).where("a <> b").distinct())
    sure = cut(components(found.where(F.col("bits") <= how["sure"])))
    # What is left to decide: pairs between different components that candidates connect.
    ends = found.where(F.col("bits") > how["sure"])
    for end in ("a", "b"):
        ends = ends.join(sure.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    ends = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    loose = cut(components(ends.where("a <> b")))
    inside = nodes.select("node").join(sure, "node", "left").select(F.col("node").alias("id"), F.coalesce("root", "node").alias("root"))
    wanted = cut(inside.join(loose.select(F.col("node").alias("root"), F.col("root").alias("top")), "root").select("id", "top", "root"))
    sets = shingle_sets(docs, wanted, id_col, text_col, how["shingle"])
    tops = components(decided(sets, how["least"], max(1, how["most"] // 4)))
    tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = nodes.join(sure, "node", "left").withColumn("root", F.coalesce("root", "node")).join(tops, "root", "left")
    named = named.select("fp", "node", F.coalesce("top", "root").alias("component_id"))
    return rows.join(cut(named), "fp", "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: dict | None = None) -> DataFrame:
    """The rows of docs without those that have a near copy of a smaller id; all columns unchanged.

    Rows without words are never near copies of one another here; rows with a null id stay.
    """
    some = docs.where(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    found = wide_components(some, id_col, text_col, how)
    gone_id = fresh(docs, "near_copy")
    gone = cut(found.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias(gone_id)).distinct())
    return docs.join(_dealt(gone), F.col(f"`{id_col}`").cast("long") == gone[gone_id], "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
