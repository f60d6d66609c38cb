"""Language-model scoring by prediction by partial matching over bytes.

A document is its lower-cased words (A to Z only) joined by single spaces, and an end
symbol. Training counts every (ORDER + 1)-gram of bytes of the training documents;
shorter contexts' counts are sums of these, so the contexts form a trie by suffix. A
context predicts a symbol seen n times with weight n - 1/2; what it hasn't seen escapes
to the next shorter context with half the number of its symbols as weight and, there,
symbols that it has seen are excluded. After the empty context all 256 byte codes are alike.

Every gram of the training documents is a node. A symbol's probability depends on its
(ORDER + 1)-gram only, so each distinct gram of all documents is scored once. The trie
is dealt by the last SHARED bytes of the context: a part has all contexts of SHARED
bytes and more that end in these, and every part has the shorter ones, whose number the
alphabet bounds. Grams seen at least total / NODES times (NODES of them at most) are
broadcast with their scores, the others' scores are joined.

The base score needs every word's count, which has no bound. Words seen at least
total / HEAD times (HEAD of them at most) are broadcast, the others' counts are joined.

Defined results: a null or empty text is the end symbol alone; a null id counts as the
empty string for the split and is kept; repeated rows are scored alike; without training
documents N and V are 0 and the model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut, scratch

ORDER = 5
NODES = 1 << 24
#: Bytes of the context by which the trie is dealt, and distinct grams that a part has on average, at most.
SHARED = 3
PART = 1 << 19
HEAD = 1 << 19
#: No UTF-8 text has these bytes: the end symbol, and what stands before a text.
END, PAD = b"\xff", b"\xfe"
LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words or grams that a task gathers before it hands them on.
GATHER = 1 << 20
#: Rows that it hands on at once.
GIVEN = 1 << 16


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; bytes.split() divides at space and the controls 9 to 13."""
    return text.translate(LOWERED).split()


def grams(docs: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram of each symbol of each document as a number, and the first symbol of each document."""
    pad = PAD * order
    flat = np.frombuffer(b"".join([pad + d + END for d in docs]), np.uint8)
    lengths = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
    value = np.zeros(len(flat), np.uint64)
    for k in range(order + 1):
        value[k:] |= flat[: len(flat) - k].astype(np.uint64) << np.uint64(8 * k)
    keep = np.ones(len(flat), bool)
    starts = np.cumsum(lengths + order) - lengths - order
    for k in range(order):
        keep[starts + k] = False
    return value[keep], np.cumsum(lengths) - lengths


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for x in batch.column(column):
        yield x.as_py() or b""


COUNTED = "word binary, gram long, n long, times long"


def _merged(*held: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of several (distinct grams, and columns to sum), one; a column at a time, as all at once take much memory."""
    keys = np.concatenate([x[0] for x in held])
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], *(np.add.reduceat(np.concatenate(x)[by], first) for x in list(zip(*held, strict=True))[1:])


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        #: Distinct grams, how often they are learnt, how often they occur in all.
        held: list[tuple[np.ndarray, ...]] = []
        docs: dict[bool, list[bytes]] = {True: [], False: []}
        size = 0

        def out_words() -> Iterator[pa.RecordBatch]:
            found, n = list(words), list(words.values())
            words.clear()
            for lo in range(0, len(found), GIVEN):
                some, many = found[lo : lo + GIVEN], n[lo : lo + GIVEN]
                yield pa.record_batch([pa.array(some, pa.binary()), pa.nulls(len(some), pa.int64()), pa.array(many, pa.int64()), pa.nulls(len(some), pa.int64())], ["word", "gram", "n", "times"])

        def out_grams() -> Iterator[pa.RecordBatch]:
            columns = held.pop()
            for lo in range(0, len(columns[0]), GIVEN):
                keys, counts, times = (x[lo : lo + GIVEN] for x in columns)
                yield pa.record_batch([pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(counts), pa.array(times)], ["word", "gram", "n", "times"])

        def flush() -> Iterator[pa.RecordBatch]:
            """Takes the gathered texts in, and hands on what has become too much."""
            for learnt, some in docs.items():
                if some:
                    values = grams(some, order)[0]
                    some.clear()
                    values.sort()
                    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
                    times = np.diff(np.r_[first, len(values)])
                    held.append((values[first], times if learnt else np.zeros_like(times), times))
            # The small are merged first; into the large one when they are a quarter of it.
            while len(held) > 1 and 4 * len(held[-1][0]) >= len(held[-2][0]):
                held[-2:] = [_merged(*held[-2:])]
            if sum(len(x[0]) for x in held) > 2 * GATHER:
                held[:] = [_merged(*held)]
                if 2 * len(held[0][0]) > 3 * GATHER:
                    yield from out_grams()
            if len(words) > GATHER // 4:
                yield from out_words()

        for batch in batches:
            for learnt, text in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                found = tokens(text)
                if learnt:
                    words.update(found)
                docs[bool(learnt)].append(b" ".join(found))
                size += len(docs[bool(learnt)][-1])
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        yield from flush()
        yield from out_words()
        if held:
            held[:] = [_merged(*held)]
            yield from out_grams()

    return run


class Table:
    """Numbers to their places in an array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.at[slot[left]] < 0
            tries = left[free]
            _, first = np.unique(slot[tries], return_index=True)
            won = tries[first]
            self.keys[slot[won]], self.at[slot[won]] = keys[won], won
            left = left[self.at[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it has none."""
        slot = self._slot(keys)
        found = self.at[slot]
        left = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found[left] = self.at[slot[left]]
            left = left[(found[left] >= 0) & (self.keys[slot[left]] != keys[left])]
        return found


class Model:
    """The trie: for each order its contexts and its grams. counts[i]: (grams, n) of order i; totals[i]: (contexts, n)."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(counts) - 1
        self.contexts, self.grams, self.log_n = [], [], []
        self.den_first, self.esc_first, self.den, self.esc = [], [], [], []
        before = None
        with np.errstate(divide="ignore", invalid="ignore"):
            for i, ((keys, n), (all_contexts, whole)) in enumerate(zip(counts, totals, strict=True)):
                contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
                seen = np.bincount(of, n, len(contexts))
                # A symbol seen n times weighs n - 1/2; the halves are the escape's (method D).
                kinds = np.bincount(of, minlength=len(contexts)) / 2
                rest = whole[np.searchsorted(all_contexts, contexts)] - seen if len(contexts) else seen
                self.contexts.append(Table(contexts))
                self.grams.append(Table(keys))
                self.log_n.append(np.log10(n - 0.5))
                self.den_first.append(np.log10(seen + rest))
                self.esc_first.append(np.log10((kinds + rest) / (seen + rest)))
                den, esc = np.zeros(len(contexts)), np.zeros(len(contexts))
                if before is not None and len(contexts):
                    # The shorter context, without the symbols that this one has seen.
                    mask = np.uint64((1 << (8 * (i - 1))) - 1) if i > 1 else np.uint64(0)
                    up = before["contexts"].find(contexts & mask)
                    same = before["n"][before["grams"].find(keys & np.uint64((1 << (8 * i)) - 1))]
                    new = before["kinds"][up] - kinds + before["rest"][up]
                    left = before["seen"][up] - np.bincount(of, same, len(contexts)) - (before["kinds"][up] - kinds)
                    some = left + new > 0
                    den = np.where(some, np.log10(left + new), 0.0)
                    esc = np.where(some, np.log10(np.where(some, new, 1.0)) - den, 0.0)
                self.den.append(den)
                self.esc.append(esc)
                before = {"contexts": self.contexts[-1], "grams": self.grams[-1], "n": n.astype(np.float64), "seen": seen, "kinds": kinds, "rest": rest}
        self.kinds0 = int(len(counts[0][0]))
        place = self.contexts[-1].find(counts[-1][0] >> np.uint64(8))
        self.quick = self.log_n[-1] - self.den_first[-1][place] if len(place) else np.zeros(0)

    def scores(self, values: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability; values: its gram of order + 1 bytes."""
        at = self.grams[-1].find(values)
        out = self.quick[at] if len(self.quick) else np.zeros(len(values))
        miss = np.flatnonzero(at < 0)
        if not len(miss):
            return out
        v = values[miss]
        total, done = np.zeros(len(v)), np.zeros(len(v), bool)
        chain = np.zeros(len(v), bool)
        den, esc = np.zeros(len(v)), np.zeros(len(v))
        for i in range(self.order, -1, -1):
            gram = v & np.uint64((1 << (8 * (i + 1))) - 1)
            at, here = self.grams[i].find(gram), self.contexts[i].find(gram >> np.uint64(8))
            seen = (here >= 0) & ~done
            own_den = np.where(chain, den, self.den_first[i][here] if len(self.den_first[i]) else 0.0)
            own_esc = np.where(chain, esc, self.esc_first[i][here] if len(self.esc_first[i]) else 0.0)
            hit = seen & (at >= 0)
            total[hit] += self.log_n[i][at[hit]] - own_den[hit]
            done |= hit
            past = seen & ~hit
            total[past] += own_esc[past]
            den[past], esc[past] = self.den[i][here[past]], self.esc[i][here[past]]
            chain |= past
        total[~done] -= np.where(chain[~done], math.log10(256 - self.kinds0), math.log10(256))
        out[miss] = total
        return out

    def score(self, docs: list[bytes]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        values, starts = grams(docs, self.order)
        return np.add.reduceat(self.scores(values), starts)


def gather(docs: DataFrame, learnt: str, text: str, order: int = ORDER) -> DataFrame:
    """(word, n) of the learnt texts and (gram, n, times) of all, n in the learnt ones; text is UTF-8 in binary."""
    counted = docs.select(learnt, text).mapInArrow(_count(order), COUNTED)
    return cut(counted.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("times").alias("times")))


def _level(keys: np.ndarray, n: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of order i from those of a higher order."""
    found, of = np.unique(keys & np.uint64((1 << (8 * (i + 1))) - 1), return_inverse=True)
    return found, np.bincount(of, n, len(found))


def _whole(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
    return contexts, np.bincount(of, n, len(contexts))


def _short(every: DataFrame, below: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of the orders under ``below``; at most as many grams as the alphabet has runs of ``below`` bytes."""
    rows = every.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * below)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    keys, n = rows.column("key").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.float64)
    return [_level(keys, n, i) for i in range(below)]


def _part(shared, order: int, below: int):
    """The part's model, from its own grams and the shorter orders, and each of its grams' score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(k).to_numpy() for k in range(3)] for batch in batches if batch.num_rows]
        if not held:
            return
        keys, n, times = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        keys, learnt = keys.astype(np.uint64), np.flatnonzero(n > 0)
        counts = shared.value + [_level(keys[learnt], n[learnt].astype(np.float64), i) for i in range(below, order + 1)]
        model = Model(counts, [_whole(*c) for c in counts])
        for at in range(0, len(keys), GIVEN):
            some = slice(at, at + GIVEN)
            yield pa.record_batch([pa.array(keys[some].astype(np.int64)), pa.array(times[some]), pa.array(model.scores(keys[some]))], ["gram", "times", "score"])

    return run


def gram_scores(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, times, score) of every gram in gather()'s rows, by the trie of all that were learnt."""
    spark = counted.sparkSession
    every = counted.where("gram IS NOT NULL").select("gram", "n", "times")
    below = min(SHARED, order)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(every.count() / PART))
    shared = spark.sparkContext.broadcast(_short(every, below))
    ends = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << (8 * below)) - 1))
    return cut(every.repartition(parts, ends).mapInArrow(_part(shared, order, below), "gram long, times long, score double"))


class _Rest(dict):
    """Counts of the head; words that aren't in it are put aside and count 0 here."""

    def __missing__(self, word: bytes) -> float:
        self.aside.append(word)
        return 0.0


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, score double, rest array<struct<word:binary,n:int>>, grams array<struct<gram:long,n:int>>"


def _score(shared, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, scores, words, logs = shared.value
        common = Table(keys)
        head = _Rest(zip(words, logs, strict=True))
        row = TaskContext.get().partitionId() << 40
        rest_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

        def summed(docs: list[bytes]) -> tuple[np.ndarray, pa.ListArray]:
            """Each document's sum over common grams, and its other grams with how often it has them."""
            values, starts = grams(docs, order)
            at = common.find(values)
            known = np.append(scores, 0.0)[at]
            left = np.flatnonzero(at < 0)
            of = np.searchsorted(starts, left, side="right") - 1
            by = np.lexsort((values[left], of))
            of, rare = of[by], values[left][by]
            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (rare[1:] != rare[:-1])]) if len(rare) else np.zeros(0, np.int64)
            n = np.diff(np.r_[first, len(rare)]).astype(np.int32)
            offsets = np.searchsorted(of[first], np.arange(len(docs) + 1)).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(rare[first].astype(np.int64)), pa.array(n)], ["gram", "n"])
            return np.add.reduceat(known, starts), pa.ListArray.from_arrays(pa.array(offsets), flat)

        for batch in batches:
            rows: list[tuple] = []
            docs: list[bytes] = []
            kept = 0

            def out() -> pa.RecordBatch:
                ids, held, n, known, sums, offsets, w, c = zip(*rows, strict=True)
                flat = pa.StructArray.from_arrays([pa.array([x for y in w for x in y], pa.binary()), pa.array([x for y in c for x in y], pa.int32())], ["word", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(offsets)], pa.int32()), flat).cast(rest_type)
                numbers = pa.array(np.arange(row, row + len(rows)))
                total, rare = summed(docs)
                done = [numbers, pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(total), lists, rare]
                rows.clear()
                docs.clear()
                return pa.record_batch(done, ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", "score", "rest", "grams"])

            for i, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2), strict=True):
                found = tokens(text)
                head.aside = []
                total = float(np.fromiter(map(head.__getitem__, found), np.float64, len(found)).sum())
                rest = Counter(head.aside)
                rows.append((i, held, len(found) + 1, len(found) - len(head.aside), total, len(rest), list(rest), list(rest.values())))
                docs.append(b" ".join(found))
                kept += len(docs[-1])
                if kept > 1_000_000:
                    done = out()
                    row += done.num_rows
                    kept = 0
                    yield done
            if rows:
                done = out()
                row += done.num_rows
                yield done

    return run


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, nodes: int = NODES, head: int = HEAD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: boolean column; rows where it is false are learnt from. nodes, head: most grams and words that are broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out.alias("held_out"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("text"))
    counted = gather(rows.withColumn("learnt", F.coalesce(~F.col("held_out"), F.lit(False))), "learnt", "text", order)
    words = counted.where("word IS NOT NULL").select("word", "n")
    facts = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = rows.where(~F.col("held_out")).count()
    n, v = (facts["n"] or 0) + ends, facts["v"] + bool(ends)
    least = max(1, math.ceil(n / head))
    top = words.where(F.col("n") >= least).toArrow()
    logs = np.log10(top.column("n").to_numpy().astype(np.float64) + 1)
    scores = gram_scores(counted, order)
    often = max(1, math.ceil((scores.agg(F.sum("times")).first()[0] or 0) / nodes))
    common = scores.where(F.col("times") >= often).select("gram", "score").toArrow()
    keys = common.column("gram").to_numpy().astype(np.uint64)
    shared = spark.sparkContext.broadcast((keys, common.column("score").to_numpy(), top.column("word").to_pylist(), logs.tolist()))
    path = scratch(spark, "scored")
    rows.mapInArrow(_score(shared, order), SCORED).write.parquet(path)
    scored = spark.read.schema(SCORED).parquet(path)
    rare = scored.select("row", F.explode("grams").alias("g")).select("row", "g.gram", F.col("g.n").alias("many"))
    others = scores.where(F.col("times") < often).select("gram", F.col("score").alias("each"))
    rare = rare.join(others.hint("merge"), "gram").groupBy("row").agg(F.sum(F.col("many") * F.col("each")).alias("rare_sum"))
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    counts = words.where(F.col("n") < least)
    found = rest.join(counts.hint("merge"), "word").groupBy("row").agg(F.sum("times").alias("rest_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rest_sum"))
    joined = scored.drop("rest", "grams").join(found, "row", "left").join(rare, "row", "left")
    end_log = math.log10(ends + 1)
    base = F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    known = F.col("head_known") + F.coalesce("rest_known", F.lit(0)) + F.lit(int(ends > 0))
    return joined.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("rare_sum", F.lit(0.0))).alias("score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    split = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    return score_documents(docs, split == 2)
