"""Merge-type subword encoding with seeded merge dropout, and lossless decoding.

An existing vocabulary's merge ranks drive the agenda: of all adjacent pairs that form a piece, the
best-ranked (leftmost on ties) is merged first. Whether a candidate merge is skipped is decided once by
a hash of the seed, the document, its copy, the unit's place in the text, the candidate's span and its
piece, so a row encodes the same on every machine, every occurrence of a word is cut on its own, and
another seed, document or copy gives other cuts. Characters outside the vocabulary, and the vocabulary's own blank mark, become byte pieces.

A unit is a run of blanks with the run of non-blank characters after it; no piece spans two units, nor
a line feed or a tab, so units' agendas are run once per worker and set of skipped merges, and remembered.
Units of more than HEAP characters run theirs on a heap, in time linear-log in their length.

Defined results: a null text encodes to null ids (and decodes to null), an empty one to no ids; rows
of one doc_id, copy and text get equal ids (null doc_ids count as one); surrogates survive as bytes; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_chunks, mix64, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20_24
#: Nodes a worker remembers; beyond it the memory starts anew (a speed bound, not a result bound).
UNIT_MEMORY = 400_000
#: Skipped merges up to which a unit's agendas are remembered, and the longest such unit (speed only).
DEPTH, LONG = 3, 24
#: Depths that stand for units met once (run when met again), and for long ones (never remembered).
ONCE, ALWAYS = 100, 101
#: Characters beyond which a unit's agenda is a heap instead of a row among others (speed only).
HEAP = 512
_LOW, _ALL = (1 << 20) - 1, (1 << 64) - 1
NO_MERGE = np.uint64(0xFFFFFFFFFFFFFFFF)
MARK = "▁"


def _mixed(x: int) -> int:
    """mix64 of one number."""
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _ALL
    return x ^ x >> 31


_UNITS = re.compile(r" *[^ \n\t]+| +|[\n\t]")


@dataclass
class MergeVocabulary:
    """Piece text, merge rank (lower merges first) and kind of every id."""

    pieces: list[str]
    ranks: np.ndarray
    byte_ids: np.ndarray

    @staticmethod
    def read(path: str) -> MergeVocabulary:
        """From a vocabulary file with byte pieces."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)]
        pieces = [sp.id_to_piece(i) if plain[i] else "" for i in range(n)]
        ranks = np.array([-sp.get_score(i) if plain[i] else np.inf for i in range(n)], np.float32)
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        return MergeVocabulary(pieces, ranks, byte_ids)


class Encoder:
    """Encodes units under one vocabulary, seed and dropout; one per worker."""

    def __init__(self, vocab: MergeVocabulary, seed: int, dropout: float):
        self.vocab, self.seed, self.limit = vocab, seed, np.uint64(min(dropout, 1 - 1e-12) * 2.0**64)
        self.single = {p: i for i, p in enumerate(vocab.pieces) if len(p) == 1}
        self.single[" "] = self.single.pop(MARK)  # a blank takes the mark's place; the mark itself is spelt in bytes
        self.code = np.full(0x110000, -1, np.int32)
        self.code[[ord(c) for c in self.single]] = list(self.single.values())
        self.numbers = ids = {p: i for i, p in enumerate(vocab.pieces) if p}
        left, right, out = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(i)
        key = np.array(left, np.uint64) << np.uint64(16) | np.array(right, np.uint64)
        # an open table of pairs: two slots a pair may be in, then a sorted rest
        self.bits = 21
        self.slot_key, self.slot_out = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(1 << self.bits, -1, np.int32)
        rest = []
        for k, o in zip(key, out, strict=True):
            at = self._slot(k)
            if self.slot_out[at] < 0:
                self.slot_key[at], self.slot_out[at] = k, o
            else:
                rest.append((int(k), o))
        rest.sort()
        self.rest_key = np.array([k for k, _ in rest] or [0], np.uint64)
        self.rest_out = np.array([o for _, o in rest] or [-1], np.int32)
        self.new: list[str] = []
        self._forget()

    def _forget(self) -> None:
        """Drop all nodes. A node is a unit with a set of skipped merges: its ids, and the merges that its agenda makes."""
        self.known, self.child, self.texts, self.size = _Numbers(self), {}, [], 0
        self.root, self.parent, self.skip, self.depth = np.zeros(1024, np.int32), np.full(1024, -1, np.int32), np.zeros(1024, np.uint64), np.zeros(1024, np.int8)
        self.met = np.zeros(1024, np.int64)
        self.spans, self.flat, self.used = np.zeros((1024, 2), np.int64), np.zeros(8192, np.int32), 0
        self.steps, self.made, self.used_steps = np.zeros((1024, 2), np.int64), np.zeros(8192, np.uint64), 0

    def _grow(self, size: int) -> np.ndarray:
        """Numbers of so many new nodes."""
        new = np.arange(self.size, self.size + size)
        self.size += size
        if (more := self.size - len(self.root)) > 0:
            more += len(self.root)
            self.root, self.parent, self.skip, self.depth, self.met = (np.concatenate((x, np.zeros(more, x.dtype))) for x in (self.root, self.parent, self.skip, self.depth, self.met))
            self.spans, self.steps = (np.concatenate((x, np.zeros((more, 2), np.int64))) for x in (self.spans, self.steps))
        return new

    def _slot(self, key):
        return (mix64(key) >> np.uint64(64 - self.bits)).astype(np.int64) if isinstance(key, np.ndarray) else int(mix64(np.array([key]))[0] >> np.uint64(64 - self.bits))

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair forms, or -1."""
        key = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)
        at = self._slot(key)
        out = np.where(self.slot_key[at] == key, self.slot_out[at], -1)
        r = np.minimum(np.searchsorted(self.rest_key, key), len(self.rest_key) - 1)
        return np.where(self.rest_key[r] == key, self.rest_out[r], out)

    def _symbols(self, unit: str) -> list[int]:
        out = list(map(self.single.get, unit))
        if None in out:
            out = [j for i, c in zip(out, unit, strict=True) for j in ([i] if i is not None else self.vocab.byte_ids[list(c.encode("utf-8", "surrogatepass"))].tolist())]
        return out

    def _all_symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all units in a row, and how many each has."""
        text = "".join(units)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, size = self.code[code], np.fromiter(map(len, units), np.int64, len(units))
        if (bad := np.flatnonzero(sym < 0)).size:
            c = code[bad]
            times = np.ones(len(sym), np.int64)
            times[bad] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            size = np.add.reduceat(times, np.cumsum(size) - size)
            sym = np.repeat(sym, times)
            spelt = "".join([text[i] for i in bad.tolist()]).encode("utf-8", "surrogatepass")
            sym[sym < 0] = self.vocab.byte_ids[np.frombuffer(spelt, np.uint8)]
        return sym, size

    def units(self, stream: int, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has; equal units of a stream are cut alike."""
        seed = self.seed * 0x10001 + stream & 0xFFFFFFFFFFFFFFFF
        return self.occurrences(units, np.fromiter((xxhash.xxh3_64_intdigest(u.encode("utf-8", "surrogatepass"), seed) for u in units), np.uint64, len(units)))

    def occurrences(self, units: list[str], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has; merges are skipped by each occurrence's salt.

        A merge that is skipped matters only where the agenda would make it. So an occurrence whose salt
        spares all merges of the unit's undropped agenda has its ids; else the first one skipped leads to
        the unit's agenda without that merge, and so on. Nodes are run and remembered from the second
        need on; before, past DEPTH skipped merges, and for long units, the occurrence's own agenda runs.
        """
        if max(self.size, len(self.child)) > UNIT_MEMORY:
            self._forget()
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        if self.new:
            numbers = self._grow(len(self.new))
            self.root[numbers], self.parent[numbers] = np.arange(len(self.texts) - len(self.new), len(self.texts)), -1
            self.depth[numbers] = np.fromiter((ONCE if len(u) <= LONG else ALWAYS for u in self.new), np.int8, len(self.new))
            self.new = []
            seen = np.bincount(at, minlength=self.size)[: self.size]
            again = (self.depth[: self.size] == ONCE) & ((seen > 1) | (seen > 0) & (np.arange(self.size) < numbers[0]))
        else:
            again = np.zeros(self.size, bool)
            again[at] = self.depth[at] == ONCE
        again = np.flatnonzero(again)
        self.depth[again] = 0
        self._run(again)
        todo, alone, origin = np.arange(len(units)), [], at.copy()
        while len(todo):
            node = at[todo]
            own = self.depth[node] > DEPTH
            alone.append(todo[own])
            todo, node = todo[~own], node[~own]
            begin, n = self.steps[node].T
            ends = np.cumsum(n)
            flat = np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
            hit = np.flatnonzero(mix64(np.repeat(salt[todo], n) ^ self.made[flat]) < self.limit)
            who, first = np.unique(np.searchsorted(ends, hit, "right"), return_index=True)
            step = flat[hit[first]]  # a place in ``made`` names its node and merge
            todo, node = todo[who], node[who]
            step, lead, back, times = np.unique(step, return_index=True, return_inverse=True, return_counts=True)
            numbers = np.fromiter(map(self.child.get, step.tolist(), repeat(-1)), np.int64, len(step))
            single = (numbers == -1) & (times == 1)
            self.child.update(zip(step[single].tolist(), repeat(-2)))
            alone.append(todo[single[back]])
            if (lack := np.flatnonzero((numbers < 0) & ~single)).size:
                numbers[lack] = self._grow(len(lack))
                up = node[lead[lack]]
                new = numbers[lack]
                self.root[new], self.parent[new], self.skip[new], self.depth[new] = self.root[up], up, self.made[step[lack]], self.depth[up] + 1
                self._run(new[self.depth[new] <= DEPTH])
                self.child.update(zip(step[lack].tolist(), new.tolist(), strict=True))
            at[todo] = numbers[back]
            todo = todo[~single[back]]
        mine = np.concatenate(alone) if alone else todo
        roots, used = self.root[origin[mine]], self.used
        numbers = self._grow(len(mine))
        self.root[numbers] = roots
        self._run(numbers, salt[mine])
        at[mine] = numbers
        begin, n = self.spans[at].T
        ends = np.cumsum(n)
        out = self.flat[np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        self.size, self.used = self.size - len(mine), used  # these are not remembered
        return out, n

    def _run(self, numbers: np.ndarray, salt: np.ndarray | None = None) -> None:
        """Run the agenda of nodes, each with its skipped merges, or under its salt."""
        units = [self.texts[k] for k in self.root[numbers].tolist()]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        if salt is not None and len(units):
            for k in np.flatnonzero(sizes > HEAP).tolist():
                self._store(numbers[k : k + 1], self._on_heap(units[k], int(salt[k]))[None, :])
            order = order[sizes[order] <= HEAP]
        start = 0
        while start < len(order):  # like lengths together, so padding is small
            stop = min(len(order), start + 8192)
            while stop - start > 1 and (stop - start) * len(units[order[stop - 1]]) > 1 << 18:
                stop = start + (stop - start) // 2
            part = order[start:stop]
            self._encode([units[k] for k in part], numbers[part], None if salt is None else salt[part])
            start = stop

    def _on_heap(self, unit: str, salt: int) -> np.ndarray:
        """The ids of one long unit under its salt: the same agenda, best rank first and leftmost on ties."""
        sym = np.array(self._symbols(unit), np.int64)
        n, limit, pieces = len(sym), int(self.limit), self.vocab.pieces
        ranks, number = self.vocab.ranks, self.numbers
        made = self._merge(sym[:-1], sym[1:])
        at = np.flatnonzero(made >= 0)
        b, u = at.astype(np.uint64), np.uint64
        high = mix64((b >> u(20)) << u(32) | (b + u(2)) >> u(20))
        key = ((b & u(_LOW)) << u(40)) ^ (((b + u(2)) & u(_LOW)) << u(20)) ^ made[at].astype(np.uint64) ^ high
        at = at[mix64(u(salt) ^ mix64(key)) >= self.limit]
        # (rank, begin, middle, end, piece) of every candidate; one whose parts are gone is passed over
        heap = list(zip(ranks[made[at]].tolist(), at.tolist(), (at + 1).tolist(), (at + 2).tolist(), made[at].tolist(), strict=True))
        heapq.heapify(heap)
        sym, ends, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n))
        while heap:
            _, begin, middle, end, piece = heapq.heappop(heap)
            if sym[begin] < 0 or ends[begin] != middle or sym[middle] < 0 or ends[middle] != end:
                continue
            sym[begin], sym[middle], ends[begin], before[end] = piece, -1, end, begin
            for x, y in ((before[begin], begin), (begin, end)):
                if x < 0 or y >= n:
                    continue
                p, q = pieces[sym[x]], pieces[sym[y]]
                new = number.get(p + q, -1) if p and q else -1
                if new < 0:
                    continue
                z = ends[y]
                key = (x & _LOW) << 40 ^ (z & _LOW) << 20 ^ new ^ _mixed((x >> 20) << 32 | z >> 20)
                if _mixed(salt ^ _mixed(key)) >= limit:
                    heapq.heappush(heap, (float(ranks[new]), x, y, z, new))
        return np.array([s for s in sym if s >= 0], np.int32)

    def _skipped(self, numbers: np.ndarray) -> np.ndarray:
        """The merges that each node skips, a row per node."""
        out = []
        while (self.depth[numbers] > 0).any():
            inner = self.depth[numbers] > 0
            out.append(np.where(inner, self.skip[numbers], NO_MERGE))
            numbers = np.where(inner, self.parent[numbers], numbers)
        return np.array(out, np.uint64).reshape(len(out), len(numbers)).T

    def _store(self, numbers: np.ndarray, symbols: np.ndarray) -> None:
        """Keep finished rows (padded with -1)."""
        filled = symbols >= 0
        n, ids = filled.sum(axis=1), symbols[filled]
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(ids) + len(self.flat), np.int32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.spans[numbers, 0] = self.used + np.cumsum(n) - n
        self.spans[numbers, 1] = n
        self.used += len(ids)

    def _store_steps(self, numbers: np.ndarray, row: np.ndarray, made: np.ndarray) -> None:
        """Keep the merges made (in the order made, by row) that the node's parents have not met."""
        order = np.argsort(row, kind="stable")
        row, made = row[order], made[order]
        n = np.bincount(row, minlength=len(numbers))
        before = np.zeros(len(numbers), np.int64)
        inner = np.flatnonzero(self.depth[numbers] > 0)
        if len(inner):  # the agenda is its parent's up to the merge it skips
            up = self.parent[numbers[inner]]
            begin, m = self.steps[up].T
            ends = np.cumsum(m)
            place = np.arange(ends[-1]) - np.repeat(ends - m, m)
            same = self.made[np.repeat(begin, m) + place] == np.repeat(self.skip[numbers[inner]], m)
            before[inner] = place[same] + self.met[up]
        keep = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) >= np.repeat(before, n)
        made, n = made[keep], n - before
        if self.used_steps + len(made) > len(self.made):
            self.made = np.concatenate((self.made, np.zeros(len(made) + len(self.made), np.uint64)))
        self.made[self.used_steps : self.used_steps + len(made)] = made
        self.steps[numbers, 0] = self.used_steps + np.cumsum(n) - n
        self.steps[numbers, 1], self.met[numbers] = n, before
        self.used_steps += len(made)

    def _encode(self, units: list[str], numbers: np.ndarray, salt: np.ndarray | None) -> None:
        """Run the agenda of all these units in lockstep: each round, every unit makes its best merge."""
        flat, n = self._all_symbols(units)
        skipped = self._skipped(numbers) if salt is None else None
        steps = []
        width = int(n.max())
        sym = np.full((len(n), width + 1), -1, np.int32)
        sym[np.arange(width + 1)[None, :] < n[:, None]] = flat
        start = np.tile(np.arange(width + 1, dtype=np.int32), (len(n), 1))

        def span(row, at, s, piece):
            """The merge of these places as one hashed value."""
            end = np.where(at + 2 < s.shape[1], begin[row, np.minimum(at + 2, s.shape[1] - 1)], width)
            return mix64((begin[row, at].astype(np.uint64) << np.uint64(40)) ^ (end.astype(np.uint64) << np.uint64(20)) ^ piece.astype(np.uint64))

        def rate(live, s, at):
            """(rank, piece) of the pairs at these places of live rows; skipped candidates rank last."""
            row = np.arange(len(live))[:, None] if at.ndim == 2 else np.arange(len(live))
            a, b = s[row, at], s[row, at + 1]
            piece = np.where((a >= 0) & (b >= 0), self._merge(np.maximum(a, 0), np.maximum(b, 0)), -1)
            if salt is not None:
                drop = mix64((salt[live][:, None] if at.ndim == 2 else salt[live]) ^ span(row, at, s, piece)) < self.limit
            else:
                drop = np.zeros(piece.shape, bool)
                key = span(row, at, s, piece) if skipped.shape[1] else None
                for k in range(skipped.shape[1]):
                    drop |= key == (skipped[live, k][:, None] if at.ndim == 2 else skipped[live, k])
            return np.where((piece < 0) | drop, np.inf, self.vocab.ranks[piece]), piece

        live, begin = np.arange(len(n)), start
        s = sym
        # symbols past a unit's end begin at its length, so spans end there
        begin = np.minimum(begin, n[:, None].astype(np.int32))
        rank, piece = rate(live, s, np.tile(np.arange(width), (len(n), 1)))
        while len(live):
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            done = ~np.isfinite(rank[row, best])
            if done.any():
                self._store(numbers[live[done]], s[done])
                go = ~done
                live, s, begin, rank, piece, best = live[go], s[go], begin[go], rank[go], piece[go], best[go]
                row = np.arange(len(live))
                if not len(live):
                    break
                if (keep := int((s >= 0).sum(axis=1).max())) + 1 < s.shape[1]:
                    s, begin, rank, piece = s[:, : keep + 1], begin[:, : keep + 1], rank[:, :keep], piece[:, :keep]
            if salt is None:
                steps.append((live, span(row, best, s, piece[row, best])))
            s[row, best] = piece[row, best]
            move = np.arange(s.shape[1] - 1)[None, :] > best[:, None]
            for x, fill in ((s, -1), (begin, None)):
                x[:, :-1] = np.where(move, x[:, 1:], x[:, :-1])
                x[:, -1] = -1 if fill is not None else n[live]
            move = np.arange(rank.shape[1] - 1)[None, :] > best[:, None]
            for x, fill in ((rank, np.inf), (piece, -1)):
                x[:, :-1] = np.where(move, x[:, 1:], x[:, :-1])
                x[:, -1] = fill
            for at in (best, best - 1):
                ok = (at >= 0) & (at < rank.shape[1])
                safe = np.clip(at, 0, rank.shape[1] - 1)
                new_rank, new_piece = rate(live, s, safe)
                rank[row[ok], at[ok]] = new_rank[ok]
                piece[row[ok], at[ok]] = new_piece[ok]
        if salt is None:
            self._store_steps(numbers, *(np.concatenate([x[k] for x in steps] or [np.zeros(0, t)]) for k, t in ((0, np.int64), (1, np.uint64))))

    def text(self, text: str, stream: int = 0) -> np.ndarray:
        """Ids of a whole text (after the vocabulary's leading blank)."""
        if not text:
            return np.zeros(0, np.int32)
        return self.units(stream, _UNITS.findall(" " + text))[0]


class _Numbers(dict):
    """Unit -> node without skipped merges; unseen units are queued with their encoder."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, unit: str) -> int:
        e = self.encoder
        n = self[unit] = e.size + len(e.new)
        e.new.append(unit)
        e.texts.append(unit)
        return n


class Decoder:
    """Turns ids back into the text they came from."""

    def __init__(self, vocab: MergeVocabulary):
        self.table = [p.replace(MARK, " ").encode() for p in vocab.pieces]
        for b, i in enumerate(vocab.byte_ids):
            self.table[i] = bytes([b])

    def text(self, ids) -> str:
        """The text of these ids."""
        return b"".join(map(self.table.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED, dropout: float = DROPOUT, check: bool = False, copy: str | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, ids; with ``check`` also whether decoding gives the text back.

    Merges are skipped by document, place in the text and, where ``copy`` names a column, its value, so
    repeated copies of a document are cut differently. The vocabulary is read on the driver and sent to
    the workers (32,000 pieces).
    """
    sent = docs.sparkSession.sparkContext.broadcast(MergeVocabulary.read(vocabulary))

    def make():
        encoder, decoder = Encoder(sent.value, seed, dropout), Decoder(sent.value)

        def run(chunk):
            out = {"doc_id": chunk["doc_id"], "n_chars": [], "ids": [], "lossless": []}
            units = [_UNITS.findall(" " + x) if x else [] for x in chunk["text"]]
            count = np.fromiter(map(len, units), np.int64, len(units))
            stop = np.cumsum(count)
            named = zip(chunk["doc_id"], chunk[copy] if copy else repeat(0), strict=False)
            salt = np.fromiter((xxhash.xxh3_64_intdigest(f"{d} {c}".encode(), seed) for d, c in named), np.uint64, len(units))
            place = (np.arange(1, count.sum() + 1) - np.repeat(stop - count, count)).astype(np.uint64)
            flat, n = encoder.occurrences([u for x in units for u in x], mix64(np.repeat(salt, count) + place * np.uint64(0x9E3779B97F4A7C15)))
            ends = np.concatenate(([0], np.cumsum(n)))
            ids = [None if x is None else flat[ends[b - c] : ends[b]] for x, b, c in zip(chunk["text"], stop, count, strict=True)]
            for x, i in zip(chunk["text"], ids, strict=True):
                out["n_chars"].append(None if x is None else len(x))
                out["ids"].append(i)
                out["lossless"].append(None if x is None or not check else decoder.text(i.tolist()) == x)
            return out

        return run

    return map_chunks(docs, ["doc_id", "text", *([copy] if copy else [])], "doc_id long, n_chars long, ids array<int>, lossless boolean", make)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id and the text of ``ids``; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(MergeVocabulary.read(vocabulary))

    def make():
        decoder = Decoder(sent.value)
        return lambda chunk: {"doc_id": chunk["doc_id"], "text": [None if i is None else decoder.text(i) for i in chunk["ids"]]}

    return map_chunks(encoded, ["doc_id", "ids"], "doc_id long, text string", make, text=None)


def digest(encoded: DataFrame) -> DataFrame:
    """Lengths and a 64-bit digest of the ids of each row."""
    return encoded.select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_digest"), "lossless")


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's encoding, as digest, with its round trip."""
    return digest(encode(table(spark, sf_dir, "documents"), check=True))


QUERIES = {"op8_sentencepiece": judge}
