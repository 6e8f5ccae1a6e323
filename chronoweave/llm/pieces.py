"""SentencePiece encoding by sampled segmentations, and decoding.

The vocabulary of a SentencePiece model spans a lattice over the text.  A
segmentation's weight is the product of its pieces' weights, which follow
Zipf's law in the piece's rank, to the power `sharpness`.  Gumbel top-k draws k
different segmentations without replacement: the space of segmentations is a
tree of prefixes, every set of unseen continuations has the maximum of its
Gumbel-perturbed log probabilities as its key, and the set with the greatest
key is opened next (A*: the key is exact, so the first segmentation reached is
the best one left).  The key of the next set, which is not opened, gives each
sample's inclusion probability.

No piece goes on after a blank inside it, so the lattice falls into units
(blanks and the word after them) whose sums over segmentations are independent.
They are computed once per distinct unit of a slice of texts, for all units at
once.  Random numbers are hashes of the row key, the sample and the place, so
results do not depend on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.words import mix, power_table

SAMPLES = 2
SHARPNESS = 1.0
SLICE_CHARS = 1_500_000
SPELLED_IDS = 1 << 17  # turned into bytes at once
_MARK = 0x2581
_LITERAL = 0x110000  # stands for a U+2581 of the text itself, which is no blank
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STRIDE = np.uint64(0xD1342543DE82EF95)


_BMP = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))


def _code_values(codes: np.ndarray) -> np.ndarray:
    """A random 64-bit value per character code."""
    if len(codes) and int(codes.max()) >= 1 << 16:
        return mix(codes.astype(np.uint64) + np.uint64(1))
    return _BMP[codes]


def _hash_text(piece: str) -> int:
    h = 0
    for v in mix(np.array([ord(c) for c in piece], np.uint64) + np.uint64(1)).tolist():
        h = (h * int(_BASE) + v) & 0xFFFFFFFFFFFFFFFF
    return h


class Vocabulary:
    """Pieces of a model, their log weights and a lookup by hash."""

    def __init__(self, model_file: str, sharpness: float = SHARPNESS):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        if any("▁" in self.pieces[i].lstrip("▁") for i in plain):
            raise ValueError("the model has pieces with a blank inside")
        first = plain[0]
        self.log_weight = -sharpness * np.log(np.maximum(np.arange(size) - first, 0) + 2.0)
        self.byte_weight = -sharpness * float(np.log(size + 2.0))
        self.log_weight[list(self.byte_ids.values())] = self.byte_weight
        hashes = np.array([_hash_text(self.pieces[i]) for i in plain], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain)[order].astype(np.int32)
        self.longest = max(len(self.pieces[i]) for i in plain)
        starts = {self.pieces[i][:k] for i in plain for k in range(1, len(self.pieces[i]))}
        self.prefixes = np.zeros(1 << 22, bool)
        self.prefixes[(np.array([_hash_text(p) for p in starts], np.uint64) >> np.uint64(42)).astype(np.int64)] = True
        # first place to look by the upper bits; pieces that meet there are found by search
        self.place = np.full(1 << 20, -1, np.int32)
        self.place[(self.hashes >> np.uint64(44)).astype(np.int64)] = np.arange(len(self.hashes), dtype=np.int32)
        self.shared = np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 1
        self.single = np.array([len(p) == 1 for p in self.pieces])
        self.as_bytes = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else (b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace("▁", " ").encode())
            for i, p in enumerate(self.pieces)
        ]
        self.flat = np.frombuffer(b"".join(self.as_bytes), np.uint8)
        self.byte_size = np.array([len(b) for b in self.as_bytes])
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size

    def begins(self, hashes: np.ndarray) -> np.ndarray:
        """Whether a longer piece may begin with the hashed text."""
        return self.prefixes.take((hashes >> np.uint64(42)).astype(np.int64))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id per hash, -1 for none."""
        upper = (hashes >> np.uint64(44)).astype(np.int64)
        at = self.place.take(upper)
        known = np.maximum(at, 0)
        out = np.where((at >= 0) & (self.hashes.take(known) == hashes), self.ids.take(known), np.int32(-1))
        again = np.flatnonzero(self.shared.take(upper) & (out < 0))
        at = np.minimum(np.searchsorted(self.hashes, hashes[again]), len(self.hashes) - 1)
        out[again] = np.where(self.hashes[at] == hashes[again], self.ids[at], -1)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of a segmentation; the blank that encoding puts first is taken off."""
        whole = b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole

    def spelled(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(UTF-8 bytes of all pieces in a row, where each piece ends there)."""
        runs, ends = [], np.cumsum(self.byte_size[ids])
        for lo in range(0, len(ids), SPELLED_IDS):
            some = ids[lo : lo + SPELLED_IDS]
            size = self.byte_size[some]
            shift = self.byte_start[some] - (np.cumsum(size) - size)
            runs.append(self.flat[np.arange(int(size.sum())) + np.repeat(shift, size)].tobytes())
        return b"".join(runs), ends


def _decodes_to(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray, texts: list[str]) -> list[bool]:
    """Whether the ids from each offset to the next decode to the text; the blank put first is taken off."""
    whole, ends = vocab.spelled(ids)
    bounds = np.append(0, ends)[offsets].tolist()
    same = []
    for lo, hi, text in zip(bounds[:-1], bounds[1:], texts, strict=True):
        same.append(whole[lo + whole.startswith(b" ", lo, hi) : hi] == text.encode())
    return same


class Lattice:
    """Edges and sums of the distinct units of some texts.

    Node i is a character of a unit.  edge[i, l] is the edge of the piece of
    l + 1 characters from there, -1 for none; ids[e] its piece (-2: the bytes of
    one character) and log_share[e] its log probability among the node's edges.
    cum[i, l] are the running probabilities, to draw from; the last is beyond any draw.
    """

    def __init__(self, vocab: Vocabulary, codes: np.ndarray, ends: np.ndarray):
        n, longest = len(codes), vocab.longest
        self.codes, self.vocab = codes, vocab
        value = _code_values(codes)
        ends = ends.astype(np.int32)
        left = ends - np.arange(n, dtype=np.int32)
        rolled = value.copy()
        at = np.arange(n, dtype=np.int32)
        hits = []
        for length in range(1, longest + 1):
            if length > 1:
                fits = np.flatnonzero((left.take(at) >= length) & vocab.begins(rolled))
                at = at.take(fits)
                rolled = rolled.take(fits) * _BASE + value.take(at + (length - 1))
            found = vocab.lookup(rolled)
            if length == 1:
                found = np.where(found < 0, self._bytes_of(codes), found)
            hit = np.flatnonzero(found != -1)
            hits.append((at.take(hit), found.take(hit)))
        # edges by distance of their node from the unit's end, then node, then length
        degree = np.zeros(n, np.int32)
        for where, _ in hits:
            degree[where] = degree.take(where) + 1
        order = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        place = np.empty(n, np.int32)
        place[order] = np.cumsum(degree[order]) - degree[order]
        total = int(degree.sum())
        node, length, piece = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int32)
        for k, (where, found) in enumerate(hits, 1):
            to = place.take(where)
            node[to], length[to], piece[to] = where, k, found
            place[where] = to + 1
        del order, place, hits, rolled, at, value
        weight = vocab.log_weight.take(np.maximum(piece, 0))
        wide = np.flatnonzero(piece == -2)
        weight[wide] = vocab.byte_weight * _byte_count(codes[node[wide]])
        sums = np.zeros(n + 1)
        to = node + length
        to = np.where(to < ends.take(node), to, np.int32(n))
        level = np.concatenate(([0], np.cumsum(np.bincount(left[node])[1:]))) if n else np.zeros(1, np.int64)
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if n else np.zeros(0, np.int64)
        begin = np.searchsorted(first, level)
        terms = weight
        for r in range(1, len(level)):
            lo, hi = level[r - 1], level[r]
            if lo == hi:
                continue
            heads = first[begin[r - 1] : begin[r]] - lo
            t = weight[lo:hi] + sums.take(to[lo:hi])
            top = np.maximum.reduceat(t, heads)
            size = np.diff(np.append(heads, hi - lo))
            whole = top + np.log(np.add.reduceat(np.exp(t - np.repeat(top, size)), heads))
            sums[node[lo:hi][heads]] = whole
            terms[lo:hi] = t - np.repeat(whole, size)
        self.ids, self.log_share = piece.astype(np.int32), terms
        cell = node.astype(np.int64) * longest + (length - 1)
        self.edge = np.full((n, longest), -1, np.int32)
        self.edge.ravel()[cell] = np.arange(len(node), dtype=np.int32)
        self.cum = np.zeros((n, longest), np.float32)
        self.cum.ravel()[cell] = np.exp(terms)
        np.cumsum(self.cum, axis=1, out=self.cum)
        self.cum.ravel()[cell.take(np.append(first[1:], total) - 1)] = 2.0  # never passed by
        self.degree = degree

    def _bytes_of(self, codes: np.ndarray) -> np.ndarray:
        """Byte piece of each ASCII character, -2 for the others."""
        table = np.array([self.vocab.byte_ids[b] for b in range(128)], np.int32)
        return np.where(codes < 128, table[np.minimum(codes, 127)], -2).astype(np.int32)

    def shares(self, nodes: np.ndarray) -> np.ndarray:
        """Probability of every edge of the nodes, 0 where there is none."""
        edges = self.edge[nodes]
        return np.where(edges >= 0, np.exp(self.log_share[edges]), 0.0)


def _byte_count(codes: np.ndarray) -> np.ndarray:
    real = np.where(codes == _LITERAL, _MARK, codes)
    return 1 + (real >= 0x80).astype(np.int64) + (real >= 0x800) + (real >= 0x10000)


def _uniform(keys: np.ndarray, *places: np.ndarray | int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on the key and the place only."""
    x = keys
    for p in places:
        x = _placed(x, p)
    return _fraction(x)


def _placed(x: np.ndarray, p: np.ndarray | int) -> np.ndarray:
    """Random words further down: those of place p below x."""
    return mix(x * _STRIDE + (p.astype(np.uint64) if isinstance(p, np.ndarray) else np.uint64(p)) + np.uint64(1))


def _fraction(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class _Paths:
    """One segmentation per text, as steps in text order."""

    def __init__(self, lattice: Lattice, owner: np.ndarray, unit: np.ndarray, node: np.ndarray, length: np.ndarray, texts: int):
        self.owner, self.unit, self.node, self.length = owner, unit, node, length
        self.edge = lattice.edge.ravel().take(node.astype(np.int64) * lattice.edge.shape[1] + length)
        self.log = lattice.log_share.take(self.edge)
        self.count = np.bincount(owner, minlength=texts)
        self.start = np.cumsum(self.count) - self.count
        total = np.concatenate(([0.0], np.cumsum(self.log)))
        self.before = total[:-1] - np.repeat(total[self.start], self.count)
        self.total = total[self.start + self.count] - total[self.start]
        self.key = np.full(len(node), -np.inf)  # of the unseen continuations that leave at each step

    def open_sets(self, lattice: Lattice, steps: np.ndarray, bound: np.ndarray, keys: np.ndarray, sample: int) -> None:
        """Keys of the sets that leave at `steps`: Gumbel maxima below `bound` per text."""
        steps = steps[lattice.degree.take(self.node.take(steps)) > 1]
        owner = self.owner.take(steps)
        rest = -np.expm1(self.log.take(steps))
        place = self.before.take(steps) + np.log(np.maximum(rest, 1e-300))
        u = _fraction(_placed(_placed(keys, 2 * sample + 1).take(owner), steps - self.start.take(owner)))
        # the Gumbel maximum place - log(-log(u)), cut off at the bound
        key = place - np.log(np.exp(np.minimum(place - bound.take(owner), 700.0)) - np.log(u))
        self.key[steps] = np.where(rest <= 0, -np.inf, key)

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """(greatest key, its step) per text."""
        top = np.maximum.reduceat(self.key, self.start)
        hit = np.flatnonzero(self.key == np.repeat(top, self.count))
        _, first = np.unique(self.owner[hit], return_index=True)
        return top, hit[first]


def _walk(lattice: Lattice, owner: np.ndarray, unit: np.ndarray, node: np.ndarray, end: np.ndarray, keys: np.ndarray, sample: int):
    """Draws the pieces of every given unit from its node on: (owner, unit, node, length) in text order."""
    live = np.flatnonzero(node < end)
    here, stop = node[live], end[live]
    random = _placed(_placed(keys, 2 * sample).take(owner.take(live)), unit.take(live))
    rounds = []
    r = 0
    while len(live):
        u = _fraction(_placed(random, r))
        length = np.argmax(lattice.cum.take(here, axis=0) > u[:, None], axis=1)
        rounds.append((live, here, length))
        here = here + length + 1
        on = np.flatnonzero(here < stop)
        live, here, stop, random = live.take(on), here.take(on), stop.take(on), random.take(on)
        r += 1
    if not rounds:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    which = np.concatenate([x[0] for x in rounds])
    order = np.argsort(which, kind="stable")
    which = which[order]
    return owner[which], unit[which], np.concatenate([x[1] for x in rounds])[order], np.concatenate([x[2] for x in rounds])[order]


def sample_segmentations(vocab: Vocabulary, texts: list[str], keys: np.ndarray, samples: int) -> list[tuple[int, int, np.ndarray, float, float]]:
    """(text, rank from 1, ids, log probability, log inclusion) of up to `samples` segmentations of each text.

    `keys` seeds each text.  Fewer come out when a text has fewer segmentations.
    """
    spaced = "".join(" " + t for t in texts)
    codes = np.frombuffer(spaced.encode("utf-32-le"), np.int32)
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(lengths) - lengths
    blank = codes == 32
    codes = np.where(blank, _MARK, np.where(codes == _MARK, _LITERAL, codes))
    first = blank & np.concatenate(([True], ~blank[:-1]))
    first[starts] = True
    unit_at = np.flatnonzero(first)
    unit_end = np.append(unit_at[1:], len(codes))
    powers, inverse = power_table(len(codes) + 1)
    summed = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_code_values(codes) * powers[: len(codes)], out=summed[1:])
    hashes = mix((summed[unit_end] - summed[unit_at]) * inverse[unit_at] + (unit_end - unit_at).astype(np.uint64))
    _, sample_of, kind = np.unique(hashes, return_index=True, return_inverse=True)
    size = (unit_end - unit_at)[sample_of]
    kind_start = np.cumsum(size) - size
    picked = np.repeat(unit_at[sample_of] - kind_start, size) + np.arange(int(size.sum()))
    lattice = Lattice(vocab, codes[picked], np.repeat(kind_start + size, size))
    owner = np.searchsorted(starts, unit_at, "right") - 1
    number = np.arange(len(unit_at)) - np.searchsorted(owner, owner)
    unit_node, unit_stop = kind_start[kind], (kind_start + size)[kind]
    n = len(texts)
    first_unit = np.searchsorted(owner, np.arange(n))
    units = np.bincount(owner, minlength=n)

    paths = [_Paths(lattice, *_walk(lattice, owner, number, unit_node, unit_stop, keys, 0), n)]
    key = -np.log(-np.log(_uniform(keys, 0xFFFF)))
    paths[0].open_sets(lattice, np.arange(len(paths[0].node)), key, keys, 0)
    members: list[tuple[np.ndarray, _Paths]] = [(np.arange(n), paths[0])]
    drawn = [np.ones(n, bool)]
    opened: dict[tuple[int, int], list[int]] = {}
    for j in range(1, samples + 1):
        tops = [p.best() for p in paths]
        chosen = np.argmax(np.stack([t for t, _ in tops]), axis=0)
        key = np.stack([t for t, _ in tops])[chosen, np.arange(n)]
        if j == samples:
            break
        step = np.stack([s for _, s in tops])[chosen, np.arange(n)]
        go = np.flatnonzero(np.isfinite(key) & drawn[-1])
        # a text without a further segmentation keeps a copy of its first one that is never given out
        new = [np.zeros(0, np.int64)] * 4
        parts = []
        for c, p in enumerate(paths):
            d = go[chosen[go] == c]
            if not len(d):
                continue
            s = step[d]
            node = p.node[s]
            share = lattice.shares(node)
            share[np.arange(len(d)), p.length[s]] = 0
            for i, x in enumerate(s.tolist()):
                for gone in opened.get((c, x), ()):
                    share[i, gone] = 0
            mass = share.sum(axis=1)
            pick = (np.cumsum(share, axis=1) <= (_uniform(keys[d], 2 * j, 0xFFFFFFFF) * mass)[:, None]).sum(axis=1)
            pick = np.minimum(pick, share.shape[1] - 1 - np.argmax(share[:, ::-1] > 0, axis=1))
            share[np.arange(len(d)), pick] = 0
            left = share.sum(axis=1)
            place = p.before[s] + np.log(np.maximum(left, 1e-300))
            again = -np.logaddexp(-key[d], -(place - np.log(-np.log(_uniform(keys[d], 2 * j + 1, 0xFFFFFFFF)))))
            p.key[s] = np.where(left <= 0, -np.inf, again)
            for x, l in zip(s.tolist(), pick.tolist(), strict=True):
                opened.setdefault((c, x), []).append(l)
            keep = s - p.start[d]
            prefix = np.repeat(p.start[d] - (np.cumsum(keep) - keep), keep) + np.arange(int(keep.sum()))
            parts.append((p.owner[prefix], p.unit[prefix], p.node[prefix], p.length[prefix], np.full(len(prefix), -1)))
            parts.append((d, p.unit[s], node, pick, np.full(len(d), -1)))
            later = units[d] - p.unit[s]
            ids = np.repeat(first_unit[d] + p.unit[s] - (np.cumsum(later) - later), later) + np.arange(int(later.sum()))
            from_node = unit_node[ids].copy()
            heads = np.cumsum(later) - later
            from_node[heads] = node + pick + 1
            walked = _walk(lattice, owner[ids], number[ids], from_node, unit_stop[ids], keys, j)
            parts.append((*walked, np.zeros(len(walked[0]), np.int64)))
        idle = np.setdiff1d(np.arange(n), go)
        p0 = paths[0]
        copy = np.flatnonzero(np.isin(p0.owner, idle))
        parts.append((p0.owner[copy], p0.unit[copy], p0.node[copy], p0.length[copy], np.full(len(copy), -1)))
        who = np.concatenate([x[0] for x in parts])
        order = np.argsort(who, kind="stable")
        new = [np.concatenate([x[k] for x in parts])[order] for k in range(5)]
        fresh = _Paths(lattice, new[0], new[1], new[2], new[3], n)
        fresh.open_sets(lattice, np.flatnonzero(new[4] == 0), key, keys, j)
        paths.append(fresh)
        alive = np.zeros(n, bool)
        alive[go] = True
        drawn.append(alive)
        members.append((go, fresh))
    # inclusion: the chance that a perturbed log probability exceeds the first key left out
    out = []
    for rank, (who, p) in enumerate(members, 1):
        ids, bounds = _ids(lattice, p)
        above = np.exp(np.minimum(p.total - key, 50.0))
        inclusion = np.where(above < 1e-9, np.minimum(p.total - key, 0.0), np.log(np.maximum(-np.expm1(-above), 1e-300)))
        inclusion = np.where(np.isfinite(key), inclusion, 0.0)
        out += [(d, rank, ids[bounds[d] : bounds[d + 1]], float(p.total[d]), float(inclusion[d])) for d in who.tolist()]
    return sorted(out, key=lambda x: (x[0], x[1]))


def _ids(lattice: Lattice, p: _Paths) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all steps, where each text's begin)."""
    ids = lattice.ids[p.edge]
    wide = np.flatnonzero(ids == -2)
    code = lattice.codes[p.node[wide]]
    spelled = [chr(_MARK if c == _LITERAL else c).encode() for c in code.tolist()]
    count = np.ones(len(ids), np.int64)
    count[wide] = [len(b) for b in spelled]
    out = np.repeat(ids, count)
    at = np.cumsum(count) - count
    for i, b in zip(at[wide].tolist(), spelled, strict=True):
        out[i : i + len(b)] = [lattice.vocab.byte_ids[x] for x in b]
    ends = np.concatenate(([0], np.cumsum(count)))
    return out, ends[np.append(p.start, len(ids))]


_ENCODED = "sample int, ids array<int>, n_pieces long, log_prob double, log_inclusion double, round_trip boolean"


def row_keys(key: pa.Array, seed: int) -> np.ndarray:
    """One seed per row key; a null key has its own."""
    known = np.array(key.cast(pa.int64()).fill_null(0)).astype(np.int64).view(np.uint64)
    return mix(mix(known + np.array(key.is_null()).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) + np.uint64(seed))


def encode_documents(
    docs: DataFrame, model_file: str, samples: int = SAMPLES, sharpness: float = SHARPNESS, seed: int = 0,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """`key`, sample (from 1), ids, n_pieces, log_prob, log_inclusion, round_trip: up to `samples` rows per row of `docs`.

    The samples of a row are different segmentations of its whole text in the
    order they were drawn; a text with fewer segmentations gets them all.
    round_trip says that decoding gives the text back.  Null is encoded as the
    empty text, which is one blank.  Equal keys with equal texts get equal
    samples.  The key must be a whole number or null.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file, sharpness))
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            keys = row_keys(batch.column(0), seed)
            texts = batch.column(1).fill_null("").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE_CHARS):
                    size += len(texts[hi]) + 1
                    hi += 1
                found = sample_segmentations(v, texts[lo:hi], keys[lo:hi], samples)
                rows = pa.array([d + lo for d, *_ in found], pa.int64())
                ids = [x for _, _, x, _, _ in found]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                joined = np.concatenate(ids)
                same = _decodes_to(v, joined, offsets, [texts[lo + d] for d, *_ in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array([r for _, r, *_ in found], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined.astype(np.int32))),
                     pa.array([len(x) for x in ids], pa.int64()), pa.array([x[3] for x in found]), pa.array([x[4] for x in found]), pa.array(same)],
                    [key, "sample", "ids", "n_pieces", "log_prob", "log_inclusion", "round_trip"],
                )
                lo = hi

    return docs.select(F.col(key), F.col(text)).mapInArrow(encode, f"`{key}` {kind}, {_ENCODED}")


def decode_documents(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """`encoded` plus `text`: the ids decoded; null for null ids."""
    vocab = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else vocab.value.decode(x) for x in batch.column(ids).to_pylist()]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], [*kept, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "text"]
    return encoded.mapInArrow(decode, ", ".join([*fields, "text string"]))
