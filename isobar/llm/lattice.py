"""Lattice likelihood of words under a unigram vocabulary: every segmentation counts.

The pieces and their scores come from an existing vocabulary file whose scores are negative merge
ranks; read as a rank-frequency law they are the starting log probabilities. Forward recursions run in
log space over many words at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix64

#: The vocabulary's mark at the start of a word, and the longest piece that is looked up.
MARK, LONGEST = "▁", 16
_BASE = np.uint64(0x100000001B3)
_SLOTS, _MORE = 20, 16


def read_vocabulary(path: str) -> list[str]:
    """Pieces of a vocabulary file in score order; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and sp.get_score(i) > -1e6]
    return [sp.id_to_piece(i) for i in sorted(ids, key=lambda i: (-sp.get_score(i), i))]


def _hash(code: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.zeros(len(code), np.uint64)
    for i in range(code.shape[1]):
        h = h * _BASE + code[:, i]
    return h


@dataclass
class UnigramScores:
    """Natural log probabilities of pieces and of the byte class (shared evenly by 256 bytes)."""

    pieces: np.ndarray
    byte: float


def initial_scores(n: int) -> UnigramScores:
    """Rank-frequency law over the vocabulary's own order."""
    p = 1.0 / (np.arange(n) + 3.0)
    byte = 1e-5
    return UnigramScores(np.log(p / p.sum() * (1 - byte)), float(np.log(byte)))


class Lattice:
    """Looks up pieces of words and runs the recursions; one per worker."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        hashes = np.zeros(self.n, np.uint64)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) <= LONGEST:
                by_length.setdefault(len(p), []).append(i)
        for length, ids in by_length.items():
            code = np.frombuffer("".join(pieces[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)
            hashes[ids] = mix64(_hash(code) + np.uint64(length))
        self.hashes = np.append(hashes, np.uint64(0))
        self.first, self.second = np.full(1 << _SLOTS, self.n, np.int32), np.full(1 << _MORE, self.n, np.int32)
        for i in range(self.n):
            if not hashes[i]:
                continue
            a = int(hashes[i] >> np.uint64(64 - _SLOTS))
            if self.first[a] == self.n:
                self.first[a] = i
                continue
            b = int(hashes[i] & np.uint64((1 << _MORE) - 1))
            if self.second[b] != self.n:
                raise ValueError("two pieces share both slots; widen the tables")
            self.second[b] = i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashed strings; n where there is none."""
        a = self.first[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        hit = self.hashes[a] == h
        b = self.second[(h & np.uint64((1 << _MORE) - 1)).astype(np.int64)]
        return np.where(hit, a, np.where(self.hashes[b] == h, b, self.n))

    def _arcs(self, words: list[str], scores: UnigramScores):
        """For words of about one length: (lengths, ids[i][L], scores[i][L], bytes per character)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        width = int(lengths.max())
        code = np.zeros((len(words), width), np.uint64)
        flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        code[np.arange(width)[None, :] < lengths[:, None]] = flat
        prefix = np.zeros((width + 1, len(words)), np.uint64)
        for i in range(width):
            prefix[i + 1] = prefix[i] * _BASE + code[:, i]
        power = np.cumprod(np.append(np.uint64(1), np.full(LONGEST, _BASE)), dtype=np.uint64)
        size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        table = np.append(scores.pieces, -np.inf)
        ids, values = [], []
        for i in range(1, width + 1):
            k = min(i, LONGEST)
            found = np.empty((k, len(words)), np.int32)
            for length in range(1, k + 1):
                found[length - 1] = self.find(mix64(prefix[i] - prefix[i - length] * power[length] + np.uint64(length)))
            value = table[found]
            missing = found[0] == self.n
            if missing.any():
                value[0, missing] = (size[missing, i - 1]) * (scores.byte - np.log(256.0))
            ids.append(found)
            values.append(value)
        return lengths, ids, values, size

    def _forward(self, lengths, values):
        alpha = [np.zeros(len(lengths))]
        for i, value in enumerate(values, 1):
            k = len(value)
            x = value + np.stack([alpha[i - length] for length in range(1, k + 1)])
            top = x.max(axis=0)
            alpha.append(top + np.log(np.exp(x - top).sum(axis=0)))
        return alpha

    def log_probability(self, words: list[str], scores: UnigramScores, block: int = 4096) -> np.ndarray:
        """Natural log of each word's marginal probability over all segmentations."""
        out = np.zeros(len(words))
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for at in self._blocks(words, order, block):
            lengths, _, values, _ = self._arcs([words[i] for i in at], scores)
            alpha = np.stack(self._forward(lengths, values))
            out[at] = alpha[lengths, np.arange(len(at))]
        return out

    def expected(self, words: list[str], weights: np.ndarray, scores: UnigramScores, block: int = 4096) -> tuple[np.ndarray, float]:
        """Expected number of times each piece, and any byte, is used in the words with these weights."""
        total, in_bytes = np.zeros(self.n + 1), 0.0
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for at in self._blocks(words, order, block):
            lengths, ids, values, size = self._arcs([words[i] for i in at], scores)
            alpha = self._forward(lengths, values)
            whole = np.stack(alpha)[lengths, np.arange(len(at))]
            width = len(values)
            beta = [np.full(len(at), -np.inf) for _ in range(width + 1)]
            for i in range(width, 0, -1):  # arcs that end at i
                beta[i] = np.where(lengths == i, 0.0, beta[i])
                k = len(values[i - 1])
                for length in range(1, k + 1):
                    onward = values[i - 1][length - 1] + beta[i]
                    beta[i - length] = np.logaddexp(beta[i - length], onward)
                    used = np.exp(alpha[i - length] + onward - whole) * weights[at]
                    if length == 1:
                        missing = ids[i - 1][0] == self.n
                        in_bytes += float((used * size[:, i - 1])[missing].sum())
                    total += np.bincount(ids[i - 1][length - 1], used, self.n + 1)
        return total[:-1], in_bytes

    @staticmethod
    def _blocks(words, order, block):
        """Blocks of words of like length, smaller for long words so that memory stays level."""
        start = 0
        while start < len(order):
            stop = min(len(order), start + block)
            while stop - start > 1 and (stop - start) * (len(words[order[stop - 1]]) + 1) > block * 64:
                stop = start + (stop - start) // 2
            yield order[start:stop]
            start = stop


def adapted(own: UnigramScores, counts: np.ndarray, in_bytes: float, share: float) -> UnigramScores:
    """The vocabulary's own probabilities, ``share`` of which go to the shares of expected uses."""
    total = counts.sum() + in_bytes
    if not total:
        return own
    mix = lambda p, n: np.log((1 - share) * np.exp(p) + share * n / total)
    return UnigramScores(mix(own.pieces, counts), float(mix(own.byte, in_bytes)))
