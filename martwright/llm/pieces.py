"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type (BPE) vocabulary is applied as its library applies it: spaces become U+2581, one is put in front, and of all
neighbours whose concatenation is a piece the pair with the best score, leftmost among equals, is merged until none is
left; characters without a piece fall back to their bytes. Dropout skips candidate merges when they come up on the
agenda: a candidate (start, merged piece) of a unit is skipped if a hash keyed by seed, row, unit and candidate falls
under the dropout rate. Rate 0 gives the library's own segmentation, any other a varied one; all decode losslessly.

No piece has a space after another character, and none a line break, so texts fall into units that never merge with each
other: each run of spaces with the word after it; long ones are cut further where no piece has both neighbours.
A unit's key is a hash of the seed, the row's id (and its copy, where it has one) and the unit, so each document is cut in
its own way. What a key does to a unit is which of its candidates, the pieces among its substrings, it skips. A segmentation
follows from the unit and that set alone, so of units that come often a worker keeps segmentations by (unit, set) and finds
nearly all of them there. Those it lacks are made together, as arrays with one row a unit: all best candidates are merged at once, round by round.
Units with more characters or candidates than that is made for go through a heap, by their keys.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(r"\n| *[^ \n]+| +")
LONGEST = 32  # characters of a unit that is segmented as a row of an array
MOST_CANDIDATES = 62  # of a unit whose segmentations are kept: a set of them is a number of 64 bits
OFTEN = 3  # documents with a unit, before its segmentations are kept
KEPT_UNITS, KEPT_IDS = 200_000, 2_000_000  # that a worker holds before it begins anew
NONE = np.int32(2**31 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2, _ALL = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


@dataclass
class Vocabulary:
    """Symbols are piece ids, and above them the characters that have no piece of their own."""

    pieces: list[str]
    byte_id: np.ndarray  # (256,)
    symbol: dict[str, int]  # of single characters
    pair_key: np.ndarray  # sorted left << 32 | right
    pair_piece: np.ndarray
    rank: np.ndarray  # of a piece; the smaller, the sooner it is merged

    def __post_init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)
        for c, s in self.symbol.items():
            self.table[ord(c)] = s
        self.bits = int(np.ceil(np.log2(len(self.pair_key) * 4 + 4)))
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.zeros(len(self.slots), np.int32)
        for key, piece in zip(self.pair_key.tolist(), self.pair_piece.tolist(), strict=True):
            at = self._home(key)
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.values[at] = key, piece
        self.pairs = dict(zip(self.pair_key.tolist(), self.pair_piece.tolist(), strict=True))
        long = {p.replace(SPACE, " "): k for k, p in enumerate(self.pieces) if len(p) > 1 and self.rank[k] < NONE}
        self.neighbours = {p[k : k + 2] for p in long for k in range(len(p) - 1)}
        self.sizes = sorted({len(p) for p in long})
        self.powers = np.cumprod(np.full(max(self.sizes, default=1) + 1, _BASE), dtype=np.uint64)
        names = np.array([self._names(np.frombuffer(p.encode("utf-32-le"), np.uint32), len(p))[0] for p in long], np.uint64)
        order = np.argsort(names)
        self.names, self.named = names[order], np.array(list(long.values()), np.uint64)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(names >> np.uint64(44)).astype(np.int64)] = True

    def _names(self, code: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all runs of so many characters."""
        out = np.zeros(max(0, len(code) - size + 1), np.uint64)
        for k in range(size):
            out += code[k : k + len(out)].astype(np.uint64) * self.powers[k]
        return out * np.uint64(_MIX1)

    def substrings(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unit's number, start << 32 | piece) of the pieces of two characters or more among the units' substrings, by unit.

        They are told by hashes of 64 bits: one too many does no harm, as a candidate that never comes up changes nothing.
        """
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(u) for u in units], np.int64)
        unit = np.repeat(np.arange(len(units)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the unit's end
        start = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        rows, cands = [], []
        for n in self.sizes:
            names = self._names(code, n)
            at = np.flatnonzero(self.seen[(names >> np.uint64(44)).astype(np.int64)] & (left[: len(names)] >= n))
            where = np.minimum(np.searchsorted(self.names, names[at]), len(self.names) - 1)
            hit = self.names[where] == names[at]
            at, where = at[hit], where[hit]
            rows.append(unit[at])
            cands.append(start[at].astype(np.uint64) << np.uint64(32) | self.named[where])
        row, cand = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((rows, np.int64), (cands, np.uint64)))
        order = np.argsort(row, kind="stable")
        return row[order], cand[order]

    def _home(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = left.astype(np.int64) << 32 | right
        key[(left < 0) | (right < 0)] = -2
        at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(key.shape, -1, np.int32)
        left_over = np.arange(key.size)
        flat_key, flat_at, flat_out = key.ravel(), at.ravel(), out.ravel()
        while len(left_over):
            held = self.slots[flat_at[left_over]]
            hit = held == flat_key[left_over]
            flat_out[left_over[hit]] = self.values[flat_at[left_over[hit]]]
            left_over = left_over[~hit & (held >= 0)]
            flat_at[left_over] += 1
        return flat_out.reshape(key.shape)


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a merge-type SentencePiece model; read on the driver only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ids = {pieces[i]: i for i in plain}
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids):
        raise ValueError("pieces with inner spaces or line breaks: units would not be independent")
    symbol = {}
    for p in ids:
        for c in p:
            if c not in symbol:
                symbol[c] = ids.get(c, n + len(symbol))
    rank = np.full(n, NONE, np.int32)
    by_score = sorted(plain, key=lambda i: -sp.get_score(i))
    for k, i in enumerate(by_score):
        rank[i] = k if k == 0 or sp.get_score(i) != sp.get_score(by_score[k - 1]) else rank[by_score[k - 1]]
    known = symbol | ids
    pairs = {known[p[:k]] << 32 | known[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known}
    keys = np.array(sorted(pairs), np.int64)
    byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    if (byte_id == sp.unk_id()).any():
        raise ValueError("a vocabulary without byte pieces isn't lossless")
    symbol[" "] = symbol.pop(SPACE)  # U+2581 itself, in a text, falls back to its bytes
    return Vocabulary(pieces, byte_id, symbol, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), rank)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(_MIX1)
    x = (x ^ x >> np.uint64(27)) * np.uint64(_MIX2)
    return x ^ x >> np.uint64(31)


def drops(unit: np.ndarray, candidate: np.ndarray, rate: float) -> np.ndarray:
    """Whether each candidate (start << 32 | merged piece) of a unit, given by its keyed hash, is dropped."""
    h = _mix(unit + candidate * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


def skipped(unit: np.ndarray, start: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    return drops(unit, start.astype(np.uint64) << np.uint64(32) | piece.astype(np.uint64), rate)


def skips(unit: int, start: int, piece: int, rate: float) -> bool:
    """skipped() of one candidate."""
    x = unit + (start << 32 | piece) * 0x9E3779B97F4A7C15 & _ALL
    x = (x ^ x >> 30) * _MIX1 & _ALL
    x = (x ^ x >> 27) * _MIX2 & _ALL
    return (x ^ x >> 31) >> 11 < rate * 2.0**53


def by_heap(v: Vocabulary, symbols: list[int], unit: int, rate: float) -> list[int]:
    """One unit through an agenda of candidates, best first; what comes up stale or is skipped by its hash is let go."""
    pairs, n = v.pairs, len(symbols)
    own, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    agenda: list[tuple] = []

    def add(a: int) -> None:
        b = right[a]
        piece = pairs.get(own[a] << 32 | own[b]) if b >= 0 and own[a] >= 0 and own[b] >= 0 else None
        if piece is not None:
            heapq.heappush(agenda, (int(v.rank[piece]), a, b, own[a], own[b], piece))

    for a in range(n - 1):
        add(a)
    while agenda:
        _, a, b, x, y, piece = heapq.heappop(agenda)
        if own[a] != x or right[a] != b or own[b] != y:
            continue
        if rate and skips(unit, a, piece, rate):
            continue
        own[a], own[b] = piece, -2
        right[a] = right[b]
        if right[a] >= 0:
            left[right[a]] = a
        add(a)
        if left[a] >= 0:
            add(left[a])
    return [own[k] for k in _alive(right)]


def _alive(right: list[int]) -> Iterator[int]:
    k = 0
    while k >= 0:
        yield k
        k = right[k]


def by_rows(v: Vocabulary, ids: np.ndarray, unit: np.ndarray, rate: float) -> np.ndarray:
    """Units as rows of symbols, filled with -1: their segmentation, each piece where it begins, -1 elsewhere.

    Merges the best pair of all rows at once; what is left and right of each symbol is linked, so that nothing moves.
    """
    n, wide = ids.shape
    ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], axis=1)
    rank = np.full((n, wide), NONE, np.int32)
    right = np.tile(np.arange(1, wide + 2, dtype=np.int16), (n, 1))
    left = np.tile(np.arange(-1, wide, dtype=np.int16), (n, 1))

    def candidates(rows: np.ndarray, at: np.ndarray) -> None:
        found = v.merged(ids[rows, at], ids[rows, right[rows, at]])
        ranked = np.where(found >= 0, v.rank[np.maximum(found, 0)], NONE)
        if rate:
            ranked[(found >= 0) & skipped(unit[rows], at, np.maximum(found, 0), rate)] = NONE
        rank[rows, at] = ranked

    candidates(*np.nonzero(ids[:, 1:] >= 0))
    live = np.arange(n)
    while len(live):
        held = rank[live]
        at = held.argmin(axis=1)
        go = held[np.arange(len(live)), at] < NONE
        live, at = live[go], at[go]
        if not len(live):
            break
        gone = right[live, at]
        after = right[live, gone]
        ids[live, at] = v.merged(ids[live, at], ids[live, gone])
        ids[live, gone] = -1
        inside = gone < wide
        rank[live[inside], gone[inside]] = NONE
        right[live, at], left[live, after] = after, at
        candidates(live, at)
        inner = left[live, at] >= 0
        candidates(live[inner], left[live, at][inner])
    return ids[:, :wide]


def segment(v: Vocabulary, units: list[str], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, how many of each unit) of different units; keys: their keyed hashes."""
    code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    size = np.array([len(u) for u in units], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    known = v.table[code]
    unknown = known < 0
    symbols = np.where(unknown, np.int32(1 << 30) + code.astype(np.int32), known)  # never part of a pair
    parts: list = [None] * len(units)
    order = np.argsort(size, kind="stable")
    sorted_size = size[order]
    edges = np.searchsorted(sorted_size, [1, 3, 5, 7, 9, 12, 16, 24, LONGEST + 1])
    blocks, lengths = [], np.zeros(len(units), np.int64)
    for a, b in zip(edges, edges[1:], strict=False):
        for k in range(a, b, 1 << 15):
            rows = order[k : min(b, k + (1 << 15))]
            wide = int(size[rows[-1]])
            index = at[rows][:, None] + np.arange(wide)
            grid = np.where(np.arange(wide) < size[rows][:, None], symbols[np.minimum(index, len(symbols) - 1)], -1).astype(np.int32)
            ids = by_rows(v, grid, keys[rows], rate)
            lengths[rows] = (ids >= 0).sum(axis=1)
            blocks.append((rows, ids))
    for k in order[edges[-1] :]:
        parts[k] = by_heap(v, symbols[at[k] : at[k + 1]].tolist(), int(keys[k]), rate)
        lengths[k] = len(parts[k])
    first = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.zeros(first[-1], np.int32)
    for rows, ids in blocks:
        n = lengths[rows]
        flat[np.arange(n.sum()) + np.repeat(first[rows] - (np.cumsum(n) - n), n)] = ids[ids >= 0]
    for k in order[edges[-1] :]:
        flat[first[k] : first[k + 1]] = parts[k]
    return fall_back(v, flat, lengths)


def fall_back(v: Vocabulary, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece as the pieces of their bytes."""
    odd = flat >= len(v.pieces)
    if not odd.any():
        return flat, lengths
    names = {s: c for c, s in v.symbol.items() if s >= len(v.pieces)}
    kinds, inverse = np.unique(flat[odd], return_inverse=True)
    as_bytes = [(names[s] if s in names else chr(s - (1 << 30))).encode("utf-8", "surrogatepass") for s in kinds.tolist()]
    grid = np.zeros((len(kinds), 4), np.int32)
    for k, raw in enumerate(as_bytes):
        grid[k, : len(raw)] = v.byte_id[list(raw)]
    n = np.ones(len(flat), np.int64)
    n[odd] = np.array([len(b) for b in as_bytes])[inverse]
    out = np.repeat(flat, n)
    first = np.cumsum(n) - n
    where = np.repeat(np.flatnonzero(odd), n[odd])
    step = np.arange(len(where)) - np.repeat(np.cumsum(n[odd]) - n[odd], n[odd])
    out[first[where] + step] = grid[np.repeat(inverse, n[odd]), step]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.concatenate([[0], np.cumsum(lengths)])
    return out, ends[at[1:]] - ends[at[:-1]]


def units_of(v: Vocabulary, text: str | None) -> list[str]:
    found = UNIT.findall(" " + text) if text else []
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [part for u in found for part in (parted(v, u) if len(u) > LONGEST else (u,))]


def parted(v: Vocabulary, unit: str) -> list[str]:
    """A unit cut between neighbours that no piece has side by side: nothing merges over such a place."""
    ends = [k + 1 for k in range(len(unit) - 1) if unit[k : k + 2] not in v.neighbours]
    return [unit[a:b] for a, b in zip([0, *ends], [*ends, len(unit)], strict=True)]


class Segmenter:
    """Segmentations of units under keys; of units met OFTEN kept by unit and by the set of its candidates that the key skips."""

    def __init__(self, v: Vocabulary, rate: float, seed: int):
        self.v, self.rate, self.seed = v, rate, seed
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # of each unit
        self.units: list[str] = []
        self.hashes = np.zeros(0, np.uint64)
        self.met = np.zeros(0, np.int64)  # how often, batch by batch; -1: too long or too many candidates to keep
        self.n_cands, self.first_cand = np.zeros(0, np.int64), np.zeros(0, np.int64)  # n_cands: -1 where they haven't been listed
        self.cands = np.zeros(0, np.uint64)  # start << 32 | piece
        self.slot: dict[int, int] = {}  # by a hash of (unit, set), which slot_unit and slot_set confirm
        self.slot_unit, self.slot_set = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)  # the kept segmentations end to end, and where each begins

    def _learn(self, found: list[list[str]]) -> None:
        number = self.number
        new = list({u: None for own in found for u in own if u not in number})
        if new:
            number.update(zip(new, range(len(self.units), len(self.units) + len(new)), strict=True))
            self.units += new
            hashes = np.array([xxhash.xxh64_intdigest(u.encode("utf-8", "surrogatepass"), self.seed & _ALL) for u in new], np.uint64)
            self.hashes = np.concatenate([self.hashes, hashes])
            self.met = np.concatenate([self.met, np.where([len(u) > LONGEST for u in new], -1, 0)])
            self.n_cands, self.first_cand = (np.concatenate([x, np.full(len(new), -1, np.int64)]) for x in (self.n_cands, self.first_cand))

    def _list_candidates(self, unit: np.ndarray) -> None:
        """Lists the candidates of those of the units that were met often."""
        new = np.unique(unit[(self.met[unit] >= (OFTEN if self.rate else 0)) & (self.n_cands[unit] < 0)])
        if not len(new):
            return
        row, cand = self.v.substrings([self.units[k] for k in new.tolist()]) if self.rate else (new[:0], self.cands[:0])
        n = np.bincount(row, minlength=len(new))
        few = n <= MOST_CANDIDATES
        self.met[new[~few]] = -1
        cand, n, new = cand[few[row]], n[few], new[few]
        self.n_cands[new], self.first_cand[new] = n, len(self.cands) + np.cumsum(n) - n
        self.cands = np.concatenate([self.cands, cand])

    def _sets(self, unit: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which of each unit's candidates its key skips, as bits."""
        n = self.n_cands[unit]
        ends = np.cumsum(n)
        local = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        gone = np.flatnonzero(drops(np.repeat(key, n), self.cands[np.repeat(self.first_cand[unit], n) + local], self.rate))
        out = np.zeros(len(unit), np.uint64)
        np.bitwise_or.at(out, np.searchsorted(ends, gone, "right"), np.uint64(1) << local[gone].astype(np.uint64))
        return out

    def encode(self, texts: list[str | None], variants: list[int]) -> list[np.ndarray]:
        """Piece ids of each text."""
        if len(self.units) > KEPT_UNITS or len(self.ids) > KEPT_IDS:
            self.clear()
        found = [units_of(self.v, t) for t in texts]
        self._learn(found)
        sizes = np.array([len(f) for f in found], np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.int32) for _ in texts]
        number = self.number
        unit = np.array([number[u] for f in found for u in f], np.int64)
        text = np.repeat(np.arange(len(texts)) if self.rate else np.zeros(len(texts), np.int64), sizes)
        pair, which = np.unique(text << 32 | unit, return_inverse=True)
        unit = pair & 0xFFFFFFFF
        key = _mix(self.hashes[unit] ^ np.array(variants, np.uint64)[pair >> 32]) if self.rate else np.zeros(len(pair), np.uint64)
        np.add.at(self.met, unit, self.met[unit] >= 0)
        self._list_candidates(unit)
        place = np.full(len(pair), -1, np.int64)  # which segmentation: one that is kept, or after those one made now
        listed = np.flatnonzero(self.n_cands[unit] >= 0)
        own, chosen = unit[listed], self._sets(unit[listed], key[listed])
        name = _mix(chosen * np.uint64(0x9E3779B97F4A7C15) ^ own.astype(np.uint64))
        slot = np.array([self.slot.get(x, -1) for x in name.tolist()], np.int64)
        kept = np.flatnonzero(slot >= 0)
        kept = kept[(self.slot_unit[slot[kept]] == own[kept]) & (self.slot_set[slot[kept]] == chosen[kept])]
        place[listed[kept]] = slot[kept]
        _, first, same = np.unique(name, return_index=True, return_inverse=True)
        twin = first[same]  # the first pair with the same name: equal, unless the hash is no good here
        lacking = np.flatnonzero((slot < 0) & (twin == np.arange(len(listed))))
        held = len(self.at) - 1
        place[listed[lacking]] = held + np.arange(len(lacking))
        follow = np.flatnonzero((slot < 0) & (own == own[twin]) & (chosen == chosen[twin]))
        place[listed[follow]] = place[listed[twin[follow]]]
        alone = np.flatnonzero(place < 0)
        place[alone] = held + len(lacking) + np.arange(len(alone))
        rows = np.concatenate([listed[lacking], alone])
        flat, n = segment(self.v, [self.units[u] for u in unit[rows].tolist()], key[rows], self.rate)
        at, ids = np.concatenate([self.at, self.at[-1] + np.cumsum(n)]), np.concatenate([self.ids, flat])
        self.at = at[: held + len(lacking) + 1].copy()
        self.ids = ids[: self.at[-1]]
        self.slot.update(zip(name[lacking].tolist(), range(held, held + len(lacking)), strict=True))
        self.slot_unit, self.slot_set = np.concatenate([self.slot_unit, own[lacking]]), np.concatenate([self.slot_set, chosen[lacking]])
        place = place[which]
        count = at[place + 1] - at[place]
        ends = np.cumsum(count)
        out = ids[np.arange(ends[-1]) + np.repeat(at[place] - (ends - count), count)]
        return np.split(out, np.concatenate([[0], ends])[np.cumsum(sizes)][:-1])


_HELD: list = []


def segmenter(v: Vocabulary, rate: float, seed: int) -> Segmenter:
    """This worker's Segmenter, which goes on to its next task."""
    if not (_HELD and _HELD[0].v is v and (_HELD[0].rate, _HELD[0].seed) == (rate, seed)):
        _HELD[:] = [Segmenter(v, rate, seed)]
    return _HELD[0]


def variant_of(id_text: str, seed: int, copy: int = 0) -> int:
    return xxhash.xxh64_intdigest(f"{id_text}\0{copy}".encode() if copy else id_text.encode(), seed)


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, rate: float = 0.1, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None) -> DataFrame:
    """docs with ids array<int>: the pieces of each whole text.

    Equal (seed, id, copy, text) give equal ids; copy_col (integers, not null) numbers the rows of an id, 0 as if there were
    none. A null text has null ids, an empty text none; a null id draws the variant
    of the empty name. Repeated rows each keep their row. Lines of any length are read whole. An empty table gives an
    empty result. A column named ids is replaced.
    """
    wire = docs.sparkSession.sparkContext.broadcast(vocabulary or load())  # the vocabulary: a few MB, whatever the data
    others = without(docs.columns, "ids")
    i, t, c = others.index(id_col), others.index(text_col), others.index(copy_col) if copy_col else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = segmenter(wire.value, rate, seed)
        for batch in slices(batches, 256, t, 1 << 20):
            texts = batch.column(t).to_pylist()
            names = ["" if x is None else str(x) for x in batch.column(i).to_pylist()]
            copies = batch.column(c).to_pylist() if copy_col else [0] * len(names)
            ids = made.encode(texts, [variant_of(x, seed, k) if rate else 0 for x, k in zip(names, copies, strict=True)])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), pa.int32())
            nulls = pa.array([x is None for x in texts])
            column = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()), mask=nulls)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), column], [*others, "ids"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "ids array<int>"])
    return docs.select(*others).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """tokens with the text that ids_col stands for; null ids give null, no ids the empty text.

    Nulls among a row's ids stand for nothing; bytes that are no UTF-8 become U+FFFD. Repeated rows each keep their row. An
    empty table gives an empty result. A column named as out_col is replaced.
    """
    wire = tokens.sparkSession.sparkContext.broadcast(vocabulary or load())
    others = without(tokens.columns, out_col)
    t = others.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = wire.value
        raw = [p.replace(SPACE, " ").encode() for p in v.pieces] + [b""]
        for b, k in enumerate(v.byte_id.tolist()):
            raw[k] = bytes([b])
        for batch in slices(batches, 256):
            column = batch.column(t)
            at = column.offsets.to_pylist()
            flat = column.values.slice(at[0], at[-1] - at[0]).fill_null(len(v.pieces)).to_numpy(zero_copy_only=False).tolist()
            texts = [b"".join(map(raw.__getitem__, flat[a - at[0] : e - at[0]]))[1:].decode(errors="replace") for a, e in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))], [*others, out_col])

    schema = ", ".join([*(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in others), f"`{out_col}` string"])
    return tokens.select(*others).mapInArrow(run, schema)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless) of each row: its pieces, and whether they decode to its very text."""
    docs = docs.select("doc_id", "text")
    v = options.pop("vocabulary", None) or load()
    back = decode(encode(docs, v, **options), v)
    return back.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
