"""SentencePiece encoding and decoding by a max-plus parallel scan; ids are those of the model.

The model is of the merge kind: of all neighbouring symbols whose union is a piece, the pair with the
best score (then the leftmost) is merged until none is left. Two facts make a scan of it. Any run of
neighbouring tokens in an encoding is the encoding of its own text, and a row of tokens is an encoding
if each two neighbours are (they "agree"). So an encoding is the one path through the lattice of
pieces whose neighbours agree; a path weighs the sum of its pieces' scores, all others minus infinity.

Spaces become the model's mark, one more stands in front of a text that isn't empty. A mark in a text
itself becomes byte pieces, as do characters without a piece, so decoding gives every text back exactly.
No piece has a mark after another character, so a unit (marks and what follows up to the next mark) is
encoded on its own: short ones many at once by merging, long ones by the lattice; frequent ones are kept.

Texts over GIANT characters are split into chunks. A state at a border is the piece that covers the
last character before it (one state where a unit ends). Each chunk gives a matrix of weights from
entry to exit state; matrices are combined associatively (max-plus products, by blocks, then over
blocks), states are read off backwards, and each chunk is backtraced on its own, given its two states.

Defined results: a null or empty text has no tokens; ids may be null or repeated; repeated texts of a
block are encoded once; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import cut
from factloom.llm.lm_scoring import Table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
GIANT = 65_536
CHUNK = 16_384
BLOCK = 64
#: Units kept by a worker; a unit of more characters goes through the lattice; characters of a block of texts.
KEPT, SHORT, TOGETHER = 300_000, 48, 1_000_000
#: Widths in which short units are merged together, shorter ones padded.
WIDTHS, PADDED = (6, 9, 12, 16, 24, SHORT), -(1 << 31)
#: A unit without its first space.
UNITS = re.compile(r" ( *[^ ]*)")
NEVER = np.iinfo(np.int32).max


class Pieces:
    """Vocabulary and merges; a space stands for the mark here. Small, and pickled to executors."""

    def __init__(self, names: list[str], scores: list[float], usable: list[bool], byte_ids: list[int]):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.scores = np.array(scores, np.float64)
        self.names = [name.replace(MARK, " ") for name in names]
        self.number = {name: i for i, (name, ok) in enumerate(zip(self.names, usable, strict=True)) if ok}
        if any(c not in self.number for name in self.number for c in name):
            raise ValueError("a piece has a character that is no piece")
        if any(" " in name.lstrip(" ") for name in self.number):
            raise ValueError("a piece has a mark after another character")
        self.prefixes = {name[:n] for name in self.number for n in range(1, len(name) + 1)}
        self.longest = max(map(len, self.number), default=1)
        self.bytes = [name.encode() for name in self.names]
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        # Merges: equal scores have one rank, the best has the least.
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in self.number.values()}, reverse=True))}
        self.rank = {name: order[scores[i]] for name, i in self.number.items()}
        pairs = {}
        for name, i in self.number.items():
            for n in range(1, len(name)):
                left, right = self.number.get(name[:n]), self.number.get(name[n:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pairs = Table(np.array(list(pairs), np.uint64))
        self.union = np.array([*pairs.values(), -1], np.int32)
        self.union_rank = np.array([*(self.rank[self.names[i]] for i in pairs.values()), NEVER], np.int32)
        chars = sorted((ord(name), i) for name, i in self.number.items() if len(name) == 1)
        self.chars, self.char_ids = (np.array(x) for x in zip(*chars, strict=True))
        self._agree: dict[tuple[int | None, int], bool] = {}

    @classmethod
    def load(cls, path: str = MODEL) -> "Pieces":
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        usable = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in every]
        return cls([sp.id_to_piece(i) for i in every], [sp.get_score(i) for i in every], usable, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def weight(self, token: int) -> float:
        """Score of a token; of one without a piece (-1 - code point) that of its bytes."""
        return float(self.scores[token]) if token >= 0 else float(self.scores[self.byte_ids[list(chr(-1 - token).encode())]].sum())

    def merge(self, text: str) -> list[int]:
        """Ids of a short text by merging, characters that are all pieces."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.number[p] for p in parts]

    def agree(self, a: int | None, b: int) -> bool:
        """Whether b may follow a (None: at a unit's start)."""
        if b < 0 or a is not None and a < 0:
            return True
        known = self._agree.get((a, b))
        if known is None:
            if len(self._agree) > 500_000:
                self._agree.clear()
            known = self.merge(("" if a is None else self.names[a]) + self.names[b]) == ([b] if a is None else [a, b])
            self._agree[a, b] = known
        return known

    def starting(self, text: str, s: int, stop: int) -> Iterator[tuple[int, int]]:
        """(end, token) of the pieces of text from s that end by stop."""
        if text[s] not in self.number:
            yield s + 1, -1 - ord(text[s])
            return
        for e in range(s + 1, min(s + self.longest, stop) + 1):
            part = text[s:e]
            if part not in self.prefixes:
                return
            token = self.number.get(part)
            if token is not None:
                yield e, token

    def merged(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges many texts at once; codes: (texts, characters), -1 after a text's end. (texts, their tokens and PADDED) by number of tokens."""
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        symbols = np.where(codes < 0, PADDED, np.where(self.chars[at] == codes, self.char_ids[at], -1 - codes))
        rows, out = np.arange(len(symbols)), []
        pair = self._pair(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1:
            ranks = self.union_rank[pair]
            best = ranks.argmin(axis=1)
            n = np.arange(len(best))
            go = ranks[n, best] < NEVER
            if not go.all():
                out.append((rows[~go], symbols[~go]))
                rows, symbols, pair, best = rows[go], symbols[go], pair[go], best[go]
                n = np.arange(len(best))
            if not len(rows):
                return out
            m = symbols.shape[1]
            symbols[n, best] = self.union[pair[n, best]]
            place = np.arange(m)[None, :]
            symbols = symbols[place != best[:, None] + 1].reshape(len(n), m - 1)
            pair = pair[place[:, : m - 1] != best[:, None]].reshape(len(n), m - 2)
            left = np.flatnonzero(best > 0)
            pair[left, best[left] - 1] = self._pair(symbols[left, best[left] - 1], symbols[left, best[left]])
            right = np.flatnonzero(best < m - 2)
            pair[right, best[right]] = self._pair(symbols[right, best[right]], symbols[right, best[right] + 1])
        return [*out, (rows, symbols)]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair's union, -1 if it is no piece."""
        whole = a.astype(np.uint32).astype(np.uint64) << np.uint64(32) | b.astype(np.uint32).astype(np.uint64)
        return self.pairs.find(whole.ravel()).reshape(whole.shape)

    def bytes_for(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens without a piece become byte pieces; owner: whose each token is."""
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, owner
        raw = [chr(-1 - c).encode() for c in ids[unknown].tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[unknown] = [len(r) for r in raw]
        out = np.repeat(ids, sizes)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.repeat(owner, sizes)

    def decode(self, ids) -> str:
        return self.decode_part(ids)[1:].decode()

    def decode_part(self, ids) -> bytes:
        """The text of neighbouring tokens, with the space in front."""
        return b"".join(map(self.bytes.__getitem__, ids))


class Walk:
    """The path of agreeing pieces from a place of a text on, after a token (None: a unit starts there).

    At each place: the token that ends there, where it starts, and the weight so far. Pieces start before ``stop``.
    With ``ref``, a walk that began earlier or elsewhere, it goes on as that one does where both have come to be alike.
    """

    def __init__(self, pieces: Pieces, text: str, at: int, after: int | None, stop: int, ref: "Walk | None" = None):
        self.pieces, self.at, self.after = pieces, at, after
        n, w = len(text), pieces.longest
        n = min(n, stop + w)
        self.token: list[int | None] = [None] * (n + 1)
        self.begin, self.total = [0] * (n + 1), [0.0] * (n + 1)
        alive = at
        for s in range(at, stop):
            before = after if s == at else self.token[s]
            if s > at and before is None:
                if s - alive >= w:
                    return
                continue
            alive = s
            for e, token in pieces.starting(text, s, n):
                if self.token[e] is None and pieces.agree(before, token):
                    self.token[e], self.begin[e], self.total[e] = token, s, self.total[s] + pieces.weight(token)
            if ref is not None and s - at >= 2 * w and s - ref.at >= 2 * w and self.token[s - w : s + 1] == ref.token[s - w : s + 1]:
                apart = {self.total[i] - ref.total[i] for i in range(s - w, s + 1) if self.token[i] is not None}
                if len(apart) == 1:
                    more = apart.pop()
                    self.token[s + 1 :], self.begin[s + 1 :] = ref.token[s + 1 :], ref.begin[s + 1 :]
                    self.total[s + 1 :] = [t + more for t in ref.total[s + 1 :]]
                    return

    def to(self, place: int) -> float:
        """Weight of the path that ends here."""
        return self.total[place] if place == self.at or self.token[place] is not None else -np.inf

    def into(self, start: int, token: int) -> float:
        """Weight of the path that ends with this token, started here."""
        if start < self.at or start > self.at and self.token[start] is None:
            return -np.inf
        ok = self.pieces.agree(self.after if start == self.at else self.token[start], token)
        return self.total[start] + self.pieces.weight(token) if ok else -np.inf

    def tokens(self, place: int) -> list[int]:
        found = []
        while place > self.at:
            found.append(self.token[place])
            place = self.begin[place]
        return found[::-1]


class Encoder:
    """Encodes units once and keeps them; ids of many texts come from one array."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.pool, self.start, self.size, self.total = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _new(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units (without their first space) one after another, and whose each is."""
        lengths = np.fromiter(map(len, units), np.int64, len(units)) + 1
        flat = np.frombuffer((" " + " ".join(units)).encode("utf-32-le"), np.uint32).astype(np.int64)
        offsets = np.cumsum(lengths) - lengths
        owner, ids = [], []
        for i in np.flatnonzero(lengths > SHORT).tolist():
            text = " " + units[i]
            found = Walk(self.pieces, text, 0, None, len(text)).tokens(len(text))
            owner.append(np.full(len(found), i))
            ids.append(np.array(found, np.int64))
        for below, m in zip((0, *WIDTHS), WIDTHS, strict=False):
            same = np.flatnonzero((lengths > below) & (lengths <= m))
            place = offsets[same][:, None] + np.arange(m)
            codes = np.where(np.arange(m) < lengths[same][:, None], flat[np.minimum(place, len(flat) - 1)], -1)
            for rows, tokens in self.pieces.merged(codes):
                owner.append(np.repeat(same[rows], tokens.shape[1]))
                ids.append(tokens.ravel())
        owner, ids = np.concatenate(owner), np.concatenate(ids)
        owner, ids = owner[ids != PADDED], ids[ids != PADDED]
        by = np.argsort(owner, kind="stable")
        return self.pieces.bytes_for(ids[by], owner[by])

    def units(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """parts: units without their first space. Ids one after another, the number and the weight of each unit."""
        if len(self.place) > KEPT:
            self._clear()
        new = list(set(parts).difference(self.place))
        if new:
            ids, owner = self._new(new)
            sizes = np.bincount(owner, minlength=len(new))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.start = np.r_[self.start, len(self.pool) + np.cumsum(sizes) - sizes]
            self.size, self.total = np.r_[self.size, sizes], np.r_[self.total, np.bincount(owner, self.pieces.scores[ids], len(new))]
            self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
        at = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        return _taken(self.pool, self.start[at], self.size[at]), self.size[at], self.total[at]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after another, the number and the weight of each text."""
        split = [_units(t) for t in texts]
        ids, sizes, totals = self.units([w for s in split for w in s])
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.bincount(owner, sizes, len(texts)).astype(np.int64), np.bincount(owner, totals, len(texts))


def _units(text: str) -> list[str]:
    """Units of a text, without their first space."""
    if not text:
        return []
    return UNITS.findall(" " + text) if text[0] == " " or "  " in text else text.split(" ")


def _taken(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of pool one after another."""
    return pool[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class Chunk:
    """A part of a giant text (with its space in front): n characters from ``left`` of text, which goes on by up to the longest piece on both sides."""

    def __init__(self, encoder: Encoder, text: str, left: int, n: int):
        self.encoder, self.pieces, self.text = encoder, encoder.pieces, text
        self.lo, self.hi = left, left + n
        starts = [p for p in (m.start() for m in re.finditer(" ", text)) if left <= p < left + n and self._unit(p)]
        self.first, self.last = (starts[0], starts[-1]) if starts else (None, None)
        self.entries, self.exits = self._states(self.lo), self._states(self.hi)
        #: Ids and weight of the whole units, set by of().
        self.middle, self.weight = np.zeros(0, np.int32), 0.0

    @classmethod
    def of(cls, encoder: Encoder, rows: Iterator[tuple[str, int, int]]) -> list["Chunk"]:
        """Chunks of (text, left, n), their whole units encoded together."""
        found = [cls(encoder, *row) for row in rows]
        units = [_units(c.text[c.first + 1 : c.last]) if c.first is not None and c.last > c.first else [] for c in found]
        ids, sizes, totals = encoder.units([u for x in units for u in x])
        ends = np.r_[0, np.cumsum([len(x) for x in units])]
        places = np.r_[0, np.cumsum(sizes)]
        for c, lo, hi in zip(found, ends[:-1], ends[1:], strict=True):
            c.middle, c.weight = ids[places[lo] : places[hi]], float(totals[lo:hi].sum())
        return found

    def _unit(self, p: int) -> bool:
        return p == 0 or p == len(self.text) or self.text[p] == " " and self.text[p - 1] != " "

    def _states(self, border: int) -> list[tuple[int, int, int] | None]:
        """(start, end, token) of the pieces over the last character before a border; None alone: a unit ends there."""
        if self._unit(border):
            return [None]
        return [(s, e, t) for s in range(max(0, border - self.pieces.longest), border) for e, t in self.pieces.starting(self.text, s, len(self.text)) if e >= border and self.pieces.agree(None, t)]

    def _walks(self) -> Iterator[tuple[int, Walk]]:
        """From each entry state on, in a chunk that no unit starts in."""
        ref = None
        for i, (_, end, token) in enumerate(self.entries):
            walk = Walk(self.pieces, self.text, end, token, self.hi, ref)
            ref = ref or walk
            yield i, walk

    def _tail(self) -> Walk:
        return Walk(self.pieces, self.text, self.last, None, self.hi)

    def _leave(self, walk: Walk) -> list[float]:
        return [walk.to(self.hi) if x is None else walk.into(x[0], x[2]) for x in self.exits]

    def matrix(self) -> np.ndarray:
        """Weight from each entry to each exit state."""
        if self.first is None:
            out = np.full((len(self.entries), len(self.exits)), -np.inf)
            for i, walk in self._walks():
                out[i] = self._leave(walk)
                if self.entries[i] in self.exits:  # one piece over the whole chunk
                    out[i, self.exits.index(self.entries[i])] = 0.0
            return out
        lead = np.array([0.0 if x is None else Walk(self.pieces, self.text[: self.first], x[1], x[2], self.first).to(self.first) for x in self.entries])
        return lead[:, None] + (np.array(self._leave(self._tail())) + self.weight)[None, :]

    def tokens(self, entry: int, leave: int) -> tuple[np.ndarray, str]:
        """Ids of the way from one state to the other, and the text they are of."""
        begin, out = self.entries[entry], self.exits[leave]
        start = self.lo if begin is None else begin[1]
        stop = self.hi if out is None else out[1]
        if begin is not None and begin == out:
            return np.zeros(0, np.int32), ""

        def ended(walk: Walk) -> list[int]:
            return walk.tokens(self.hi) if out is None else [*walk.tokens(out[0]), out[2]]

        if self.first is None:
            found = [ended(Walk(self.pieces, self.text, start, begin[2], self.hi))]
        else:
            lead = [] if begin is None else Walk(self.pieces, self.text[: self.first], start, begin[2], self.first).tokens(self.first)
            found = [lead, self.middle, ended(self._tail())]
        ids = np.concatenate([np.asarray(f, np.int64) for f in found])
        return self.pieces.bytes_for(ids, np.zeros(len(ids), np.int64))[0].astype(np.int32), self.text[start:stop]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """Entry and exit state of each matrix on the best way from entry to leave."""
    v = np.full(matrices[0].shape[0], -np.inf)
    v[entry] = 0
    before = []
    for m in matrices:
        before.append(v)
        v = (v[:, None] + m).max(axis=0)
    out = []
    for m, v in zip(reversed(matrices), reversed(before), strict=True):
        start = int(np.argmax(v + m[:, leave]))
        out.append((start, leave))
        leave = start
    return out[::-1]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder for this vocabulary, kept between tasks."""
    key = id(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


ENCODED = "doc_id long, n_tokens long, score double, decoded boolean, token_ids array<int>"
NAMES = ["doc_id", "n_tokens", "score", "decoded", "token_ids"]


def _encode_small(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lo, held = 0, 0
            place: dict[str, int] = {}
            part: list[int] = []

            def out(stop: int) -> pa.RecordBatch:
                known = list(place)
                tokens, sizes, totals = own.texts(known)
                ends = np.cumsum(sizes)
                same = np.zeros(len(known), bool)
                for i, (t, e, n) in enumerate(zip(known, ends.tolist(), sizes.tolist(), strict=True)):
                    same[i] = own.pieces.decode(tokens[e - n : e].tolist()) == t
                at = np.array(part)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes[at])], pa.int32()), pa.array(_taken(tokens, (ends - sizes)[at], sizes[at]), pa.int32()))
                return pa.record_batch([ids.slice(lo, stop - lo), pa.array(sizes[at]), pa.array(totals[at]), pa.array(same[at]), lists], NAMES)

            for i, text in enumerate(texts):
                text = text.as_py() or ""
                if text not in place:
                    place[text] = len(place)
                held += len(text)
                part.append(place[text])
                if held > TOGETHER:
                    yield out(i + 1)
                    place.clear()
                    part, held, lo = [], 0, i + 1
            if part:
                yield out(len(texts))

    return run


PART = "row long, doc_id long, k long, part string, start int, n int"


def _split(chunk: int, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = " " + text.as_py()
                starts = range(0, len(whole), chunk)
                for lo in range(0, len(starts), 256):
                    rows = [(row, i, lo + k, whole[max(0, at - wide) : at + chunk + wide], min(wide, at), min(chunk, len(whole) - at)) for k, at in enumerate(starts[lo : lo + 256])]
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["row", "doc_id", "k", "part", "start", "n"])
                row += 1

    return run


def _encode_giant(giant: DataFrame, shared, wide: int, chunk: int) -> DataFrame:
    parts = cut(giant.mapInArrow(_split(chunk, wide), PART))

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for batch in batches:
            found = [c.matrix() for c in Chunk.of(own, zip(*(batch.column(c).to_pylist() for c in ("part", "start", "n")), strict=True))]
            yield pa.record_batch([batch.column("row"), batch.column("k"), pa.array([len(m) for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], ["row", "k", "high", "m"])

    def read(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(m).reshape(high, -1) for m, high in zip(pdf["m"], pdf["high"], strict=True)]

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        out, *others = read(pdf.sort_values("k"))
        for m in others:
            out = product(out, m)
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "b": [pdf["b"].iloc[0]], "high": [len(out)], "m": [out.tobytes()]})

    def over_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        way = states(read(pdf), 0, 0)
        return pd.DataFrame({"row": pdf["row"], "b": pdf["b"], "b_in": [s for s, _ in way], "b_out": [s for _, s in way]})

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        way = states(read(pdf), int(pdf["b_in"].iloc[0]), int(pdf["b_out"].iloc[0]))
        return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "entry": [s for s, _ in way], "leave": [s for _, s in way]})

    matrices = cut(parts.select("row", "k", "part", "start", "n").mapInArrow(transfer, "row long, k long, high int, m binary").withColumn("b", F.floor(F.col("k") / BLOCK)))
    blocks = matrices.groupBy("row", "b").applyInPandas(combine, "row long, b long, high int, m binary")
    ends = blocks.groupBy("row").applyInPandas(over_blocks, "row long, b long, b_in int, b_out int")
    ways = matrices.join(ends, ["row", "b"]).groupBy("row", "b").applyInPandas(in_block, "row long, k long, entry int, leave int")

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for batch in batches:
            columns = batch.to_pydict()
            chunks = Chunk.of(own, zip(*(columns[c] for c in ("part", "start", "n")), strict=True))
            found = [c.tokens(e, x) for c, e, x in zip(chunks, columns["entry"], columns["leave"], strict=True)]
            same = [own.pieces.decode_part(ids.tolist()).decode(errors="replace") == text for ids, text in found]
            totals = [float(own.pieces.scores[ids].sum()) for ids, _ in found]
            yield pa.record_batch([*(batch.column(c) for c in ("row", "doc_id", "k")), pa.array(same, pa.bool_()), pa.array(totals, pa.float64()), pa.array([ids for ids, _ in found], pa.list_(pa.int32()))], ["row", "doc_id", "k", "decoded", "score", "ids"])

    done = parts.join(ways, ["row", "k"]).select("row", "doc_id", "k", "part", "start", "n", "entry", "leave")
    done = done.mapInArrow(backtrace, "row long, doc_id long, k long, decoded boolean, score double, ids array<int>")
    whole = done.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("c"), F.bool_and("decoded").alias("decoded"), F.sum("score").alias("score"))
    whole = whole.select("doc_id", F.flatten(F.transform("c", lambda c: c["ids"])).alias("token_ids"), "decoded", "score")
    return whole.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "score", "decoded", "token_ids")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, score (the pieces' sum), decoded (whether decoding gives the text back), token_ids."""
    pieces = Pieces.load(model)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    small = rows.where(F.length("text") <= giant).mapInArrow(_encode_small(shared), ENCODED)
    return small.unionByName(_encode_giant(rows.where(F.length("text") > giant), shared, pieces.longest, chunk))


def decode_documents(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) of token ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(x.values.to_pylist() if x.is_valid else []) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), ids_col).mapInArrow(run, "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
