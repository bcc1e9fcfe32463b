"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model is compiled into three machines: a normaliser, which is sequential (one path for
each text), a lexicon that maps marked text to pieces, with an arc to the bytes of each
character that no piece has, and an acceptor of piece sequences. Texts are composed with
them lazily and the path of least weight in the tropical semiring (weights add along a
path, the smaller path wins) is the encoding.

For a unigram model a piece weighs minus its log probability and every sequence is
accepted. For a byte-pair model weights cannot add up to the order of merges; there the
acceptor has a state for each piece and an arc of weight 0 from a to b when the merges of
the joined text of both give back exactly a, b. The arcs missing weigh infinity. A sequence
of pieces is what the merges give if and only if each neighbouring pair is: a merge across
a border would also happen in the pair, and one within a piece happens the same in both. So
exactly one path has a finite weight, and it is the model's own encoding.

The machines are arrays, compiled on the driver and broadcast. The texts of a batch are cut
where no piece can span, and the lattices of their distinct parts are composed and swept
together, position by position. Memory follows the batch, nothing is kept between batches
but a table of fixed size with acceptor arcs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import lean, rest, small_batches, tokenizer_dir

MARK = "▁"
# Fixed values of the model format: kinds of piece and of model, and the penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Bits of a piece or character in a key; characters of a lattice; parts that are swept together have at most LONG characters.
SHIFT, LATTICE, LONG = 21, 1 << 17, 48
BATCH = 4 << 20
U = np.uint64


class CharMap:
    """The normaliser as a sequential transducer: a double-array trie of byte strings with the offset of each replacement."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest entry that starts at ``at``."""
        found, node, unit = None, 0, self.units[0]
        node ^= self._jump(unit)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & ((1 << 31) | 0xFF) != raw[i]:
                break
            node ^= self._jump(unit)
            if (unit >> 8) & 1:
                start = self.units[node] & ((1 << 31) - 1)
                found = self.texts[start : self.texts.index(b"\0", start)], i + 1 - at
        return found

    def apply(self, text: str) -> str:
        if not self.units:
            return text
        raw, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(raw):
            hit = self.longest(raw, at)
            if hit:
                out.append(hit[0])
                at += hit[1]
            else:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                out.append(raw[at : at + n])
                at += n
        return b"".join(out).decode("utf-8", "replace")


class Table:
    """Values of integer keys, looked up for whole arrays: open addressing, at most a quarter full; -1 for other keys."""

    def __init__(self, found: dict[int, int]) -> None:
        bits = max(4, (4 * len(found)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.array(list(found), np.int64), np.array(list(found.values()), np.int32)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Tokenizer:
    """A compiled model."""

    def __init__(self, blob: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is neither unigram (1) nor byte-pair (2)")
        norm = proto.normalizer_spec
        self.prefix, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.charmap, self.denorm = CharMap(norm.precompiled_charsmap), CharMap(proto.denormalizer_spec.precompiled_charsmap)
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        pieces, kinds, scores = [p.piece for p in proto.pieces], [p.type for p in proto.pieces], [p.score for p in proto.pieces]
        if any(k in (USER, UNUSED) for k in kinds):
            raise ValueError("models with user-defined or unused pieces are not supported: their pieces bypass the weights")
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.byte_ids = np.full(256, -1, np.int32)
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.fallback = bool(proto.trainer_spec.byte_fallback and self.byte_ids.min() >= 0)
        surface = {CONTROL: b"", UNKNOWN: proto.trainer_spec.unk_surface.encode()}
        self.surface = pa.array([bytes([int(p[3:5], 16)]) if k == BYTE else surface.get(k, p.replace(MARK, " ").encode()) for p, k in zip(pieces, kinds, strict=True)], pa.binary())
        self.vocabulary = len(pieces)
        lexicon = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        # no piece spans a border in front of a mark, or a line break or tab that no piece has: such parts are encoded alone
        self.apart = self.escape and not any(MARK in p.lstrip(MARK) for p in lexicon)
        self.lone = np.zeros(256, bool)
        for c in "\n\r\t":
            self.lone[ord(c)] = not any(c in p for p in lexicon)
        self._compile(lexicon, np.array(scores, float))
        self.known, self.allowed = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, bool)

    # ---- the machines

    def _compile(self, lexicon: dict[str, int], scores: np.ndarray) -> None:
        """The lexicon as a trie, the weights of its arcs, and the acceptor."""
        # characters that pieces have but that are no piece are states after the vocabulary
        ids = lexicon | {c: self.vocabulary + i for i, c in enumerate(sorted({c for p in lexicon for c in p} - set(lexicon)))}
        self.cost = np.zeros(len(ids) + self.vocabulary + 1)
        self.cost[: len(scores)] = -scores
        normal = scores[list(lexicon.values())]
        self.unknown_cost = UNKNOWN_PENALTY - float(normal.min(initial=0.0))
        usable = dict(lexicon)
        if self.kind == BPE:
            usable = self._derivations(ids, lexicon, scores)
        nodes: dict[str, int] = {"": 0}
        arcs: dict[int, int] = {}
        for p in usable:
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    arcs[nodes[p[: n - 1]] << SHIFT | ord(p[n - 1])] = nodes[p[:n]]
        self.next = Table(arcs)
        self.piece = np.full(len(nodes), -1, np.int32)
        for p, i in usable.items():
            self.piece[nodes[p]] = i
        self.alone = Table({ord(c): i for c, i in ids.items() if len(c) == 1 and c not in usable})

    def _merge(self, parts: list[str], lexicon: dict[str, int], scores: np.ndarray) -> tuple[list[str], tuple[str, str] | None]:
        """What joining neighbours gives, best score first and leftmost at equal scores, and the last two joined."""
        parts, last = list(parts), None
        while True:
            best = None
            for i in range(len(parts) - 1):
                at = lexicon.get(parts[i] + parts[i + 1])
                if at is not None and (best is None or scores[at] > best[0]):
                    best = scores[at], i
            if best is None:
                return parts, last
            i = best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _derivations(self, ids: dict[str, int], lexicon: dict[str, int], scores: np.ndarray) -> dict[str, int]:
        """The two parts that each piece is merged from, the order of merges, and which parts merge to what; returns the pieces that merges can give."""
        score = scores.tolist()
        usable: dict[str, int] = {}
        size = self.vocabulary + len(ids)
        self.left, self.right, self.order = (np.full(size, -1, np.int64) for _ in range(3))
        rank = {s: r for r, s in enumerate(sorted({score[i] for i in lexicon.values()}, reverse=True))}
        for p, i in lexicon.items():
            parts, last = self._merge(list(p), lexicon, score)
            if len(parts) > 1:
                continue
            usable[p] = i
            if last:
                self.left[i], self.right[i], self.order[i] = ids[last[0]], ids[last[1]], rank[score[i]]
        joins = {}
        for p, i in lexicon.items():
            for n in range(1, len(p)):
                a, b = p[:n], p[n:]
                if (a in usable or a in ids and len(a) == 1) and (b in usable or b in ids and len(b) == 1):
                    joins[ids[a] << SHIFT | ids[b]] = i
        self.joins = Table(joins)
        self.join_order = np.full(self.vocabulary, -1, np.int64)
        for i in lexicon.values():
            self.join_order[i] = rank[score[i]]
        # merges happen in the order of scores if every part has a better score than the piece; pairs with other pieces are merged one by one
        self.loose = np.zeros(size, bool)
        for p in sorted(usable, key=len):
            i = usable[p]
            if self.left[i] >= 0:
                both = [self.left[i], self.right[i]]
                self.loose[i] = self.loose[both].any() or self.order[both].max() >= self.order[i]
        if self.loose.any():
            self.texts, self.lexicon, self.scores = {i: p for p, i in ids.items()}, lexicon, score
        return usable

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the acceptor has an arc from each piece a to the piece b; a or b is -1 for characters that no piece has.

        Undoes the merges inside a and b, the last first: the arc is missing if at some time
        the parts at the border could have merged before the next merge inside. At equal
        scores the merge further to the left is first.
        """
        out = np.ones(len(a), bool)
        if self.kind != BPE:
            return out
        at = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[at].astype(np.int64) << SHIFT | b[at]
        place = ((key.view(U) * U(0x9E3779B97F4A7C15)) >> U(46)).astype(np.int64)
        hit = self.known[place] == key
        out[at[hit]] = self.allowed[place[hit]]
        at, key, place = at[~hit], key[~hit], place[~hit]
        if len(at):
            new, back = np.unique(key, return_inverse=True)
            good = self._arcs_of(new >> SHIFT, new & ((1 << SHIFT) - 1))[back]
            out[at] = good
            self.known[place] = -1
            self.known[place], self.allowed[place] = key, good
            clash = self.known[place] != key  # another key took the place, with its own answer
            self.known[place[clash]] = -1
        return out

    def _arcs_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        loose = self.loose[x] | self.loose[y]
        for i in np.flatnonzero(loose):
            a, b = self.texts[int(x[i])], self.texts[int(y[i])]
            out[i] = self._merge(list(a + b), self.lexicon, self.scores)[0] == [a, b]
        at = np.flatnonzero(~loose)
        x, y, limit = x[at], y[at], np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            joined = self.joins.of(x << SHIFT | y)
            cross = (joined >= 0) & (self.join_order[joined] < limit)
            out[at[cross]] = False
            ox, oy = self.order[x], self.order[y]
            go = ~cross & ((ox >= 0) | (oy >= 0))
            at, x, y, ox, oy = at[go], x[go], y[go], ox[go], oy[go]
            first = ox > oy
            limit = np.where(first, ox, oy + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    # ---- composition and the shortest path

    def _lattice(self, chars: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All arcs (from, to, state) over the characters of parts that end at ``stop``; characters that are no piece have one to their bytes."""
        at = np.arange(len(chars))
        now, node = at, np.zeros(len(chars), np.int32)
        found = []
        while len(at):
            node = self.next.of(node.astype(np.int64) << SHIFT | chars[now])
            piece = np.where(node >= 0, self.piece[node], -1)
            if not found:
                bare = np.flatnonzero(piece < 0)
                found.append((bare, bare + 1, self.alone.of(chars[bare])))
            hit = piece >= 0
            found.append((at[hit], now[hit] + 1, piece[hit]))
            go = (node >= 0) & (now + 1 < stop[at])
            at, now, node = at[go], now[go] + 1, node[go]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _costs(self, state: np.ndarray) -> np.ndarray:
        if self.kind == BPE:
            return np.zeros(len(state))
        return np.where((state >= 0) & (state < self.vocabulary), self.cost[state], self.unknown_cost)

    def _sweep(self, chars: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last state of the least path to each position behind a character, and where that arc starts.

        ``first`` and ``stop`` are the bounds of each character's part. Arcs only lead forward,
        so the sweep settles the positions in the order of their distance from the start of
        their part, of all parts at once; two arcs to one position never meet in a step.
        """
        source, target, state = self._lattice(chars, stop)
        cost = self._costs(state)
        weight, last, back = np.full(len(chars) + 1, np.inf), np.full(len(chars) + 1, -1, np.int32), np.zeros(len(chars) + 1, np.int64)
        step = source - first[source]
        short = stop[source] - first[source] <= LONG
        order = np.flatnonzero(short)[np.argsort(step[short].astype(np.uint8), kind="stable")]
        cuts = np.searchsorted(step[order], np.arange(LONG + 1))
        for t in range(LONG):
            e = order[cuts[t] : cuts[t + 1]]
            if not len(e):
                break
            s = source[e]
            if t:
                e = e[weight[s] < np.inf]
                s = source[e]
                e = e[self.follows(last[s], state[e])]
                s = source[e]
            w = (weight[s] if t else 0.0) + cost[e]
            better = w < weight[target[e]]
            e, w = e[better], w[better]
            weight[target[e]], last[target[e]], back[target[e]] = w, state[e], source[e]
        if not short.all():
            self._sweep_long(np.flatnonzero(~short), source, target, state, cost, first, weight, last, back)
        return last, back

    def _sweep_long(self, which: np.ndarray, source, target, state, cost, first, weight, last, back) -> None:
        """The same for long parts, arc by arc in the order of their start; the acceptor's arcs are looked up for all neighbours at once."""
        which = which[np.argsort(source[which], kind="stable")]
        s, e, p = source[which], target[which], state[which]
        low, high = np.searchsorted(s, e), np.searchsorted(s, e, side="right")
        n = np.where(s[np.minimum(low, len(s) - 1)] == e, high - low, 0)
        left = np.repeat(np.arange(len(s)), n)
        right = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = p[left], p[right]
        missing = ~self.follows(a, b)
        barred = set((a[missing].astype(np.int64) << SHIFT | b[missing]).tolist())
        ws: dict[int, tuple[float, int, int]] = {}
        for i, j, q, c, start in zip(s.tolist(), e.tolist(), p.tolist(), cost[which].tolist(), (first[s] == s).tolist(), strict=True):
            w, before = (0.0, -1) if start else ws.get(i, (np.inf, -1, 0))[:2]
            if w + c < ws.get(j, (np.inf,))[0] and (start or before < 0 or q < 0 or before << SHIFT | q not in barred):
                ws[j] = w + c, q, i
        at = np.array(list(ws), np.int64)
        if len(at):
            got = list(zip(*ws.values(), strict=True))
            weight[at], last[at], back[at] = got

    def shortest_paths(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids on the least paths of parts that end at ``ends``, and the number of each part's ids."""
        size = np.diff(np.concatenate(([0], ends)))
        first, stop = np.repeat(ends - size, size), np.repeat(ends, size)
        last, back = self._sweep(chars, first, stop)
        on, at = np.zeros(len(chars) + 1, bool), ends
        floor = ends - size
        while len(at):
            on[at] = True
            at = back[at]
            go = at > floor
            at, floor = at[go], floor[go]
        on = np.flatnonzero(on)
        state = last[on]
        bare = np.flatnonzero((state < 0) | (state >= self.vocabulary))
        n = np.ones(len(on), np.int64)
        if self.fallback and len(bare):
            c = chars[on[bare] - 1]
            n[bare] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        ids = np.repeat(state, n)
        if len(bare):
            at = np.repeat(np.isin(np.arange(len(on)), bare), n)
            raw = chars[on[bare] - 1].astype("<u4").tobytes().decode("utf-32-le").encode() if self.fallback else b""
            ids[at] = self.byte_ids[np.frombuffer(raw, np.uint8)] if self.fallback else self.unknown
        counts = np.add.reduceat(n, np.searchsorted(on, ends - size, side="right")) if len(on) else np.zeros(0, np.int64)
        return ids.astype(np.int32), counts

    # ---- texts

    def normalize(self, text: str) -> str:
        """The normaliser's output; marks are spaces still where the model escapes them."""
        text = self.charmap.apply(text)
        if self.escape and MARK in text:
            text = text.replace(MARK, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text or not self.prefix:
            return text
        return text + " " if self.suffix else " " + text

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where those of each text end; none for null and empty ones."""
        raws = [self.normalize(t).encode("utf-8", "replace") if t else b"" for t in texts]
        ends = np.cumsum([len(r) for r in raws], dtype=np.int64) if raws else np.zeros(0, np.int64)
        raw = np.frombuffer(b"".join(raws), np.uint8)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        new = np.zeros(len(raw) + 1, bool)
        if self.apart:
            space, lone = raw == 32, self.lone[raw]
            new[:-1] = space | lone
            new[1:-1] &= ~space[:-1] | lone[1:]
            new[1:] |= lone
        new[0] = new[-1] = True
        new[ends] = True
        cuts = np.flatnonzero(new)
        parts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        ids, counts = self._distinct(parts.dictionary)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32())).take(parts.indices)
        at = lists.offsets.to_numpy()
        flat, ends = lists.flatten().to_numpy(), at[np.searchsorted(cuts, ends)].astype(np.int64)
        if not self.fallback and len(flat) > 1:  # a run of unknown characters is one unknown piece
            again = np.concatenate(([False], (flat[1:] == self.unknown) & (flat[:-1] == self.unknown)))
            again[ends[ends < len(flat)]] = False
            ends = ends - np.concatenate(([0], np.cumsum(again)))[ends]
            flat = flat[~again]
        return flat, ends

    def _distinct(self, parts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, in lattices of a bounded number of characters (one part may be longer)."""
        at = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, parts.offset * 4)
        raw = parts.buffers()[2].to_pybytes()[: at[-1]]
        begins = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))[at]
        text = raw.decode("utf-8", "replace")
        chars = np.frombuffer((text.replace(" ", MARK) if self.escape else text).encode("utf-32-le"), "<u4").astype(np.int64)
        out, low = [(np.zeros(0, np.int32), np.zeros(0, np.int64))], 0
        while low < len(parts):
            high = max(low + 1, int(np.searchsorted(begins, begins[low] + LATTICE, side="right")) - 1)
            out.append(self.shortest_paths(chars[begins[low] : begins[high]], begins[low + 1 : high + 1] - begins[low]))
            low = high
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the ids in a row, those of each text up to its end."""
        got = self.surface.take(pa.array(ids, pa.int32()))
        at = np.frombuffer(got.buffers()[1], np.int32, len(got) + 1, got.offset * 4)[np.concatenate(([0], ends)).astype(np.int64)].tolist()
        raw, out = memoryview(got.buffers()[2] or b""), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            part = bytes(raw[a:b])
            if self.prefix and not self.suffix and part[:1] == b" ":
                part = part[1:]
            elif self.prefix and self.suffix and part[-1:] == b" ":
                part = part[:-1]
            out.append(self.denorm.apply(part.decode("utf-8", "replace")))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_batch(np.asarray(ids, np.int32), np.array([len(ids)]))[0]


@lru_cache(maxsize=2)
def compiled(blob: bytes) -> Tokenizer:
    """The machines of a model, compiled once per driver; executors get them as arrays."""
    made = Tokenizer(blob)
    rest()
    return made


def _encode(batches: Iterable[pa.RecordBatch], t: Tokenizer) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, BATCH):
        texts = batch.column("text").to_pylist()
        ids, ends = t.encode_batch(texts)
        back = pa.array([None if x is None else b == x.replace(MARK, " ") for x, b in zip(texts, t.decode_batch(ids, ends), strict=True)], pa.bool_())
        ends = np.concatenate(([0], ends)).astype(np.int32)
        missing = np.array([x is None for x in texts], bool)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=pa.array(missing))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(ends).astype(np.int64), mask=missing), back], names=["doc_id", "ids", "n_tokens", "round_trip"])
    rest()


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver; it has the size of its vocabulary, whatever the input."""
    with open(path or f"{tokenizer_dir()}/piece_bpe_32k.model", "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding the ids gives the text back, for every row.

    A null text has null ids, count and check, an empty one no ids. The mark character in a
    text decodes to a space, as the model cannot tell them apart. Repeated rows and null ids
    are kept, other columns are not carried, an empty table gives an empty table.
    """
    lean(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(compiled(model or model_bytes()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _encode(it, sent.value), f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, model: bytes | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids give a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(compiled(model or model_bytes()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, BATCH):
            lists = batch.column("ids").to_pylist()
            ids = np.concatenate([np.zeros(0, np.int32), *(np.array(x or [], np.int32) for x in lists)])
            texts = sent.value.decode_batch(ids, np.cumsum([len(x or []) for x in lists], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())], names=["doc_id", "text"])
        rest()

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
