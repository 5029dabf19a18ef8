"""Sampled segmentations of a SentencePiece vocabulary: Gumbel top-k without replacement by perturbed A-star.

A text's lattice has a node between any two characters and an edge for every piece that fits (bytes for a
character that is no piece). A piece's weight falls with its rank in the vocabulary, -tau * log(rank + 2),
which stands in for the probabilities that a BPE model does not carry. No piece reaches over a word's end,
so the lattice is a chain of the lattices of words; a worker builds each word's once, many words at a time
in numpy: edges by looking up rolling hashes of all short spans, then total weights from the end backwards.

The best-first search keeps disjoint regions of segmentations, each with a Gumbel-perturbed bound that is the
perturbed weight of its best member. Taking the best region emits its best member and splits the rest at each
step: the same beginning, another edge there. Bounds of the parts are drawn below the parent's, so the k
emitted segmentations are distinct and a sample without replacement. The (k + 1)-th bound gives each one's
log probability of inclusion. All draws are functions of the row's key, the rank and the step.

Defined results: a null or empty text has the empty segmentation alone, with probability 1. A text with fewer
than k segmentations gives all of them. Rows of one id draw alike. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, Words, as_bytes, mix, release, slices

K, TAU = 2, 1.0
SPACE_MARK = "▁"
#: Edges that a worker keeps (20 bytes each); beyond, it starts anew.
MOST_EDGES, SLOTS = 10_000_000, 1 << 21
_R = U64(0x9E3779B97F4A7C15 | 1)


def uniform(key: np.ndarray, rank: int, step: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing but their arguments."""
    h = mix(key + step.astype(U64) * U64(0x9E3779B97F4A7C15) + U64((rank + 1) * 0xD1342543DE82EF95 % 2**64))
    return ((h >> U64(11)).astype(np.float64) + 0.5) / 2**53


class Lattices:
    """Words' lattices in flat arrays: nodes, and each node's edges with cumulative probabilities."""

    def __init__(self, model: str, tau: float = TAU):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.sp.vocab_size()
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        pieces = [self.sp.id_to_piece(i) for i in plain]
        if any(re.search(rf"[^{SPACE_MARK}\n][{SPACE_MARK}\n ]", p) for p in pieces):
            raise ValueError("a piece reaches over the end of a word")
        self.kind = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.longest = max(map(len, pieces))
        order = sorted(range(len(plain)), key=lambda j: -self.sp.get_score(plain[j]))
        rank = np.empty(len(plain), np.int64)
        rank[order] = np.arange(len(plain))
        #: Every beginning of a piece: a span that isn't one is not looked at longer. ``of``: the piece that it is, or -1.
        beginnings = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)})
        place = {p: i for i, p in enumerate(pieces)}
        self.hashes = mix(np.array([self._hash(p) for p in beginnings], U64))
        self.of = np.array([place.get(p, -1) for p in beginnings])
        self.ids, self.weights = np.array(plain), -tau * np.log(rank + 2.0)
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.slots = np.full(1 << 18, -1, np.int32)  # of beginnings, by the top bits of their hashes; a later one goes on to the next free slot
        for j, h in enumerate(self.hashes.tolist()):
            i = h >> 46
            while self.slots[i] >= 0:
                i = (i + 1) & (len(self.slots) - 1)
            self.slots[i] = j
        self.byte_ids = np.array(self.bytes, np.int32)
        self.byte_weight = -tau * np.log(len(plain) + 2.0)
        self._clear()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_R) + ord(c) + 1) % 2**64
        return h

    def _clear(self) -> None:
        self.keys, self.numbers = np.zeros(SLOTS, U64), np.zeros(SLOTS, np.int32)
        self.words = 0
        self.nodes = self.edges = 0
        self.first_node, self.first_edge = np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.int64)
        #: Of each edge: the probability of it and the node's edges before it, the log of its own and of the others' together, the node that it leads to, its piece.
        self.upto, self.logp, self.other = (np.zeros(MOST_EDGES, np.float32) for _ in range(3))  # untouched pages take no memory
        self.to, self.piece = (np.zeros(MOST_EDGES, np.int32) for _ in range(2))

    def _beginning(self, h: np.ndarray) -> np.ndarray:
        """The beginning of a piece of each hash, -1 for none."""
        slot = (h >> U64(46)).astype(np.int64)
        out, at = np.full(len(h), -1, np.int64), self.slots[slot]
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            own = self.slots[slot[open_]]
            hit = (own >= 0) & (self.hashes[own] == h[open_])
            out[open_[hit]] = own[hit]
            open_ = open_[(own >= 0) & ~hit]
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h & U64(SLOTS - 1)).astype(np.int64)
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(open_):
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.numbers[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
        return out

    def learn(self, h: np.ndarray, words: list[str]) -> None:
        """Lattices of words with distinct hashes."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        end_of = np.repeat(np.cumsum(size), size)
        begin = np.arange(len(chars))
        start, stop, found = [], [], []
        rolling = np.zeros(len(chars), U64)
        alive = begin
        for n in range(1, self.longest + 1):
            alive = alive[alive + n <= end_of[alive]]
            if not len(alive):
                break
            rolling[alive] = rolling[alive] * _R + chars[alive + n - 1].astype(U64) + U64(1)
            at = self._beginning(mix(rolling[alive]))
            alive, at = alive[at >= 0], self.of[at[at >= 0]]
            hit = at >= 0
            if n == 1:
                single = alive[hit]
            start.append(alive[hit])
            stop.append(alive[hit] + n)
            found.append(at[hit])
        bare = np.setdiff1d(begin, single)
        start, stop, found = (np.concatenate(x) for x in (start, stop, found))
        width = np.array([len(chr(c).encode("utf-8", "surrogatepass")) for c in chars[bare]], np.int64)
        # an edge's piece is an id, or minus the character and one for its bytes
        start, stop = np.r_[start, bare], np.r_[stop, bare + 1]
        piece, weight = np.r_[self.ids[found], -1 - chars[bare]], np.r_[self.weights[found], self.byte_weight * width]
        left = end_of[start] - start  # characters to the word's end
        beta = np.zeros(len(chars) + 1)
        through = np.zeros(len(start))
        order = np.argsort(left * (len(chars) + 1) + start)
        cuts = np.searchsorted(left[order], np.arange(1, int(size.max()) + 2))
        for i, j in zip(cuts[:-1], cuts[1:]):
            e = order[i:j]
            if len(e):
                v = weight[e] + np.where(stop[e] == end_of[start[e]], 0.0, beta[np.minimum(stop[e], len(chars))])
                through[e] = v
                head = np.flatnonzero(np.r_[True, start[e][1:] != start[e][:-1]])
                beta[start[e][head]] = np.logaddexp.reduceat(v, head)
        prob = np.exp(through - beta[start])
        by = np.argsort(start - 0.999 * prob)  # likely edges first, so that a walk looks at few
        start, stop, piece, prob, logp = start[by], stop[by], piece[by], prob[by], (through - beta[start])[by]
        counts = np.bincount(start, minlength=len(chars))
        run = np.cumsum(prob)
        upto = run - np.r_[0.0, run][np.r_[0, np.cumsum(counts)][:-1]][start]
        upto[np.cumsum(counts) - 1] = 2.0
        end = self.edges + len(prob)
        for name in ("upto", "logp", "other", "to", "piece"):
            self._room(name, end)
        own = slice(self.edges, end)
        self.upto[own], self.logp[own], self.piece[own] = upto, logp, piece
        with np.errstate(divide="ignore"):
            others = np.log(np.maximum(-np.expm1(logp), 0))
        self.other[own] = np.where(counts[start] == 1, -np.inf, others)
        self.to[own] = np.where(stop == end_of[start], -1, self.nodes + stop)
        self._room("first_edge", self.nodes + len(chars) + 1)
        self._room("first_node", self.words + len(words) + 1)
        self.first_edge[self.nodes + 1 : self.nodes + len(chars) + 1] = self.edges + np.cumsum(counts)
        self.first_node[self.words + 1 : self.words + len(words) + 1] = self.nodes + np.cumsum(size)
        self.edges, self.nodes = end, self.nodes + len(chars)
        number, todo = np.arange(self.words, self.words + len(words)), np.arange(len(words))
        slot = (h & U64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.numbers[slot[free]] = h[free], number[free]
            todo = todo[self.keys[slot[todo]] != h[todo]]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
        self.words += len(words)

    def _room(self, name: str, n: int) -> None:
        have = getattr(self, name)
        if n > len(have):
            grown = np.zeros(max(n, 2 * len(have)), have.dtype)
            grown[: len(have)] = have
            setattr(self, name, grown)

    def node_of(self, edge: int) -> int:
        return int(np.searchsorted(self.first_edge[: self.nodes + 1], edge, "right")) - 1

    def walk(self, node: np.ndarray, key: np.ndarray, rank: int, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled paths from many nodes to their words' ends: (walk, edge), in order of walks."""
        alive, place, who, edges = np.arange(len(node)), 0, [], []
        steps = np.zeros(len(node) + 1, np.int64)
        while len(alive):
            u = uniform(key[alive], rank, step[alive] + place)
            e = self.first_edge[node]
            on = np.flatnonzero(self.upto[e] < u)
            while len(on):
                e[on] += 1
                on = on[self.upto[e[on]] < u[on]]
            who.append(alive)
            edges.append(e)
            node = self.to[e].astype(np.int64)
            on = node >= 0
            steps[alive[~on] + 1] = place + 1
            alive, node, place = alive[on], node[on], place + 1
        first = np.cumsum(steps)
        out = np.empty(first[-1], np.int64)
        for i, (a, e) in enumerate(zip(who, edges)):
            out[first[a] + i] = e
        return np.repeat(np.arange(len(steps) - 1), steps[1:]), out

    def spell(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids; a character that is no piece gives the ids of its bytes."""
        p = self.piece[edges]
        bare = p < 0
        if not bare.any():
            return p
        if p[bare].min() >= -128:
            return np.where(bare, self.byte_ids[np.where(bare, -1 - p, 0)], p)
        return np.array([i for x in p.tolist() for i in ((x,) if x >= 0 else (self.bytes[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")))], np.int64)


class _Text:
    """The search over one text. Steps are those of paths; a word's number of its first step is a multiple of STEPS."""

    def __init__(self, lat: Lattices, key: np.uint64, nodes: np.ndarray, fresh: list[tuple[np.ndarray, np.ndarray]]):
        self.lat, self.key, self.nodes, self.fresh = lat, key, nodes, fresh
        self.bounds: list[np.ndarray] = []
        self.paths: list[tuple] = []
        self.drawn = 0

    def _below(self, mass: np.ndarray, top: float) -> np.ndarray:
        """Gumbel numbers of these log masses, given that none is above ``top``."""
        u = uniform(np.full(len(mass), self.key), 1 << 20, np.arange(self.drawn, self.drawn + len(mass)))
        self.drawn += len(mass)
        return mass - np.log(np.exp(mass - top) - np.log(u))

    def _add(self, word: np.ndarray, edge: np.ndarray, first: int, banned: list[int], top: float) -> None:
        """Regions that share the path's steps before i, from ``first`` on, and take another edge at i."""
        lat = self.lat
        logp = lat.logp[edge].astype(np.float64)
        mass = np.cumsum(logp)
        total = float(mass[-1])
        mass = mass[first:] - logp[first:] + lat.other[edge[first:]]
        if banned:
            node = lat.node_of(int(edge[first]))
            gone = {*banned, int(edge[first])}
            rest = [e for e in range(lat.first_edge[node], lat.first_edge[node + 1]) if e not in gone]
            left = float(np.exp(lat.logp[rest].astype(np.float64)).sum())
            mass[0] = mass[0] - lat.other[edge[first]] + np.log(left) if left > 0 else -np.inf
        self.bounds.append(self._below(mass, top))
        self.paths.append((word, edge, first, banned, total))

    def run(self, k: int) -> list[tuple[np.ndarray, float, float, float]]:
        """(edges, log probability, perturbed score, bound of the best region left) of the best k."""
        word, edge = self.fresh[0]
        top = float(self._below(np.zeros(1), np.inf)[0])
        out = [(edge, float(self.lat.logp[edge].sum(dtype=np.float64)), top)]
        self._add(word, edge, 0, [], top)
        while len(out) < k:
            best = max(range(len(self.bounds)), key=lambda r: self.bounds[r].max(initial=-np.inf))
            if not len(self.bounds[best]) or not np.isfinite(self.bounds[best].max()):
                break
            i = int(np.argmax(self.bounds[best]))
            top = float(self.bounds[best][i])
            word, edge, first, banned, _ = self.paths[best]
            self.bounds[best][i] = -np.inf
            at = first + i
            without = [*(banned if i == 0 else []), int(edge[at])]
            new_word, new_edge = self._other(word, edge, at, without, len(out))
            out.append((new_edge, float(self.lat.logp[new_edge].sum(dtype=np.float64)), top))
            self._add(new_word, new_edge, at, without, top)
        rest = max((b.max(initial=-np.inf) for b in self.bounds), default=-np.inf)
        return [(*x, rest) for x in out]

    def _other(self, word: np.ndarray, edge: np.ndarray, at: int, without: list[int], rank: int) -> tuple[np.ndarray, np.ndarray]:
        """A sample of the region: the steps before ``at``, another edge there, then on freely."""
        lat, w = self.lat, int(word[at])
        node = lat.node_of(int(edge[at]))
        choice = np.array([e for e in range(lat.first_edge[node], lat.first_edge[node + 1]) if e not in without])
        p = np.cumsum(np.exp(lat.logp[choice].astype(np.float64)))
        u = float(uniform(np.array([self.key]), rank + (1 << 16), np.array([at]))[0])
        e = int(choice[min(int(np.searchsorted(p, u * p[-1])), len(choice) - 1)])
        tail = np.zeros(0, np.int64)
        if lat.to[e] >= 0:
            tail = lat.walk(np.array([lat.to[e]]), np.array([self.key]), rank + (1 << 17), np.array([at]))[1]
        later_word, later_edge = self.fresh[rank]
        later = later_word > w
        return np.r_[word[:at], np.full(1 + len(tail), w), later_word[later]], np.r_[edge[:at], e, tail, later_edge[later]]


STEPS = 1 << 20
#: Pieces may end in other white space than these.
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True


def sample(lat: Lattices, ids: np.ndarray, texts: list[bytes | None], k: int) -> Iterator[tuple[int, list]]:
    """(row, segmentations) for rows of a slice; ids seed the draws."""
    w = Words(texts, space=_BREAK)
    doc = np.repeat(np.arange(len(texts)), w.n)
    # a unit is a word with the white space before it; white space at a text's end is a unit of its own
    start, end = np.r_[0, w.end[:-1]] if len(w.end) else w.end, w.end
    opens = np.zeros(len(end), bool)
    opens[w.first[:-1][w.n > 0]] = True
    start = np.where(opens, w.begin[:-1][doc], start)
    reach = w.begin[1:] - 1
    done = np.where(w.n > 0, w.end[np.maximum(w.first[1:] - 1, 0)] if len(w.end) else 0, w.begin[:-1])
    tails = np.flatnonzero(done < reach)
    start, end, doc, opens = np.r_[start, done[tails]], np.r_[end, reach[tails]], np.r_[doc, tails], np.r_[opens, w.n[tails] == 0]
    by = np.argsort(doc, kind="stable")
    start, end, doc, opens = start[by], end[by], doc[by], opens[by]
    h = mix(w.spans(start, end) + opens.astype(U64)) | U64(1)
    number = lat.find(h)
    new = np.flatnonzero(number < 0)
    if len(new):
        if lat.edges > 0.95 * MOST_EDGES or lat.words + len(new) > SLOTS // 2:
            lat._clear()
            new = np.arange(len(h))
        keys, at = np.unique(h[new], return_index=True)
        first = new[at]
        raw, spans = w.buf.tobytes(), zip(opens[first].tolist(), start[first].tolist(), end[first].tolist())
        lat.learn(keys, [(SPACE_MARK if o else "") + raw[i:j].decode().replace(" ", SPACE_MARK) for o, i, j in spans])
        number = lat.find(h)
    nodes = lat.first_node[number]
    keys = mix(ids.astype(np.int64).view(U64) + U64(0x5851F42D4C957F2D))
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    fresh = []
    for rank in range(k):
        who, edge = lat.walk(nodes, keys[doc], rank, (np.arange(len(doc)) - cuts[doc]) * STEPS)
        fresh.append((who, edge, np.searchsorted(who, cuts)))
    for d in range(len(texts)):
        if cuts[d] == cuts[d + 1]:
            yield d, [(np.zeros(0, np.int64), 0.0, 0.0, -np.inf)]
            continue
        own = [(who[c[d] : c[d + 1]], edge[c[d] : c[d + 1]]) for who, edge, c in fresh]
        yield d, _Text(lat, keys[d], nodes[cuts[d] : cuts[d + 1]], own).run(k)


_lattices: dict[tuple, Lattices] = {}


def sample_segmentations(docs: DataFrame, model: str, k: int = K, tau: float = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, rank, ids, log_prob, score, log_inclusion) for the k segmentations of each row; ids are little-endian, two or four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model, tau) not in _lattices:
            _lattices[model, tau] = Lattices(model, tau)
        lat = _lattices[model, tau]
        for b in batches:
            texts, given = as_bytes(b.column(1)), b.column(0).to_pylist()
            for part in slices([len(t or b"") for t in texts]):
                seeds, rows = np.array([i or 0 for i in given[part]], np.int64), []
                for d, found in sample(lat, seeds, texts[part], k):
                    for rank, (edges, logp, score, rest) in enumerate(found):
                        gap = logp - rest  # the log of 1 - exp(-exp(gap)) is gap itself where that is small
                        inside = 0.0 if not np.isfinite(rest) else gap if gap < -30 else float(np.log(-np.expm1(-np.exp(min(gap, 3.0)))))
                        rows.append((given[part.start + d], rank, lat.spell(edges).astype(lat.kind).tobytes(), logp, score, inside))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64()))], [id_col, "rank", "ids", "log_prob", "score", "log_inclusion"])
        release()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"`{id_col}` long, rank int, ids binary, log_prob double, score double, log_inclusion double")


def decode(segmentations: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``segmentations`` with ``text``: pieces put together again, the first space taken away."""
    columns = segmentations.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattices.setdefault((model, TAU), Lattices(model)) if (model, TAU) not in _lattices else _lattices[model, TAU]
        sp = lat.sp
        raw = [bytes([lat.bytes.index(i)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(sp.vocab_size())]
        for b in batches:
            out = []
            for x in b.column(columns.index(ids_col)).to_pylist():
                text = b"".join(raw[i] for i in np.frombuffer(x or b"", lat.kind).tolist())
                out.append(text[1:].decode() if text[:1] == b" " else text.decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*columns, "text"])

    return segmentations.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in segmentations.dtypes) + ", text string")
