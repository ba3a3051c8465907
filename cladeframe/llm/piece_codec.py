"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that a worker has not met yet are concatenated and indexed by a suffix array.
Every vocabulary piece is binary-searched in it, which gives its occurrence ranges; the occurrences
are edges (start, length, piece), sorted by position. Words are then relaxed along these edges.
The file at hand is a BPE model, for which the relaxation is by merge priority: of all edges that
join two neighbouring symbols of a word, the one of the best score is taken first, leftmost on ties.
A word without a path gets the byte pieces of the characters left over.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts

BLANK = "▁"
#: Longest word for which merges run as arrays over all words at once; longer ones use a heap.
LONG = 200
#: Code points indexed at once.
BLOCK = 600_000


@dataclass
class Pieces:
    """What the codec needs of a model: normal pieces, their scores, and the byte pieces."""

    ids: np.ndarray
    texts: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    surface: list[bytes]

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = np.full(256, sp.unk_id(), np.int32)
        surface = [b"" if sp.is_control(i) else sp.id_to_piece(i).encode() for i in range(size)]
        for i in range(size):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                byte_ids[b], surface[i] = i, bytes([b])
        surface[sp.unk_id()] = " ⁇ ".encode()
        return cls(np.array(normal, np.int32), [sp.id_to_piece(i) for i in normal], np.array([sp.get_score(i) for i in normal], np.float32), byte_ids, surface)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.int32)


def suffix_order(points: np.ndarray, depth: int) -> np.ndarray:
    """Start positions, sorted by the first ``depth`` code points, by prefix doubling."""
    rank = np.unique(points, return_inverse=True)[1].astype(np.int64) + 1
    reach, order = 1, np.argsort(rank, kind="stable")
    while reach < depth:
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:]
        key = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1]))) + 1
        reach *= 2
    return order


class Matcher:
    """Finds all pieces in a text and relaxes words along them."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.lengths = pieces, np.array([len(t) for t in pieces.texts])
        self.depth = int(self.lengths.max())
        self.low = np.full((len(pieces.texts), self.depth), -2, np.int32)
        for row, text in zip(self.low, pieces.texts):
            row[: len(text)] = _points(text)
        self.high = np.where(self.low == -2, np.iinfo(np.int32).max, self.low)
        #: 0 for the best score; pieces of equal score share a priority.
        self.priority = np.unique(-pieces.scores, return_inverse=True)[1].astype(np.int64)

    def _search(self, padded: np.ndarray, order: np.ndarray, wanted: np.ndarray, past: bool) -> np.ndarray:
        """For each row the number of suffixes that sort before it, with those that equal it if ``past``."""
        lo, hi, cols, rows = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order)), np.arange(self.depth), np.arange(len(wanted))
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            there = padded[order[np.minimum(mid, len(order) - 1)][:, None] + cols]
            differ = there != wanted
            first = differ.argmax(1)
            less = np.where(differ[rows, first], there[rows, first] < wanted[rows, first], past)
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo

    def edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of all pieces, sorted by position and length: their keys and their piece rows."""
        order = suffix_order(points, self.depth)
        padded = np.concatenate((points, np.full(self.depth, -1, np.int32)))
        start, stop = self._search(padded, order, self.low, False), self._search(padded, order, self.high, True)
        count = stop - start
        rows = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        keys = order[start[rows] + within] * (self.depth + 1) + self.lengths[rows]
        by = np.argsort(keys)
        return keys[by], rows[by]

    def encode(self, words: list[str]) -> Iterator[bytes]:
        """For each word its ids as int32 bytes. Words are non-empty."""
        block: list[str] = []
        size = 0
        for w in words:
            block.append(w)
            size += len(w) + 1
            if size >= BLOCK:
                yield from self._encode_block(block)
                block, size = [], 0
        if block:
            yield from self._encode_block(block)

    def _encode_block(self, words: list[str]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        points = _points("\0".join(words) + "\0").copy()
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        points[ends] = -1
        keys, rows = self.edges(points)
        wide = self.depth + 1

        def row(start: np.ndarray, length: np.ndarray) -> np.ndarray:
            """Rows of the pieces that span these ranges, -1 where there is none."""
            if not len(keys):
                return np.full(len(start), -1)
            key = start * wide + length
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where((length < wide) & (keys[at] == key), rows[at], -1)

        none = np.iinfo(np.int64).max

        def rank(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            r = row(start, stop - start)
            return np.where(r >= 0, self.priority[r], none)

        short = np.flatnonzero(sizes <= LONG)
        n = sizes[short]
        unit = np.repeat(short, n)
        left = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[short], n)
        done_left, done_right = [], []
        right = left + 1
        joins = np.full(len(left), none)
        if len(left) > 1:
            same = np.flatnonzero(unit[1:] == unit[:-1])
            joins[same] = rank(left[same], right[same + 1])
        while len(left):
            first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            best = np.minimum.reduceat(joins, first)
            lengths = np.diff(np.concatenate((first, [len(unit)])))
            live = best < none
            if not live.all():
                over = np.repeat(~live, lengths)
                done_left.append(left[over])
                done_right.append(right[over])
                left, right, unit, joins = left[~over], right[~over], unit[~over], joins[~over]
                best, lengths = best[live], lengths[live]
                if not len(left):
                    break
            hits = np.flatnonzero(joins == np.repeat(best, lengths))
            _, leftmost = np.unique(unit[hits], return_index=True)
            at = hits[leftmost]
            right[at] = right[at + 1]
            keep = np.ones(len(left), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            left, right, unit, joins = left[keep], right[keep], unit[keep], joins[keep]
            joins[moved] = none
            ahead = moved[moved + 1 < len(left)]
            ahead = ahead[unit[ahead] == unit[ahead + 1]]
            joins[ahead] = rank(left[ahead], right[ahead + 1])
            back = moved[moved > 0] - 1
            back = back[unit[back] == unit[back + 1]]
            joins[back] = rank(left[back], right[back + 1])
        for u in np.flatnonzero(sizes > LONG):
            a, b = self._merge_long(int(starts[u]), int(ends[u]), rank)
            done_left.append(a)
            done_right.append(b)
        left, right = np.concatenate(done_left), np.concatenate(done_right)
        by = np.argsort(left)
        left, right = left[by], right[by]
        found = row(left, right - left)
        ids = np.where(found >= 0, self.pieces.ids[found], -1).astype(np.int32)
        word_of = np.searchsorted(ends, left)
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            out, extra = [], {int(i): self.pieces.byte_ids[np.frombuffer(chr(points[left[i]]).encode("utf-8", "surrogatepass"), np.uint8)] for i in lost}
            counts = np.ones(len(ids), np.int64)
            counts[lost] = [len(extra[int(i)]) for i in lost]
            ids, word_of = np.repeat(ids, counts), np.repeat(word_of, counts)
            ids[ids < 0] = np.concatenate(list(extra.values()))
        cuts = np.searchsorted(word_of, np.arange(len(words) + 1)) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _merge_long(self, start: int, stop: int, rank) -> tuple[np.ndarray, np.ndarray]:
        """Merges in one long word, by a heap: n log n."""
        end = list(range(start + 1, stop + 1))
        n = stop - start
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        none = np.iinfo(np.int64).max
        lefts = np.arange(start, stop - 1)
        first = rank(lefts, lefts + 2) if n > 1 else np.array([], np.int64)
        heap = [(int(r), i, i + 2 + start) for i, r in enumerate(first) if r < none]
        heapq.heapify(heap)
        while heap:
            _, i, reach = heapq.heappop(heap)
            if not alive[i] or (j := nxt[i]) >= n or end[j] != reach or end[i] >= reach:
                continue
            end[i], alive[j], nxt[i] = reach, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            pairs = [(p, i) for p in [prev[i]] if p >= 0] + [(i, q) for q in [nxt[i]] if q < n]
            for a, b in pairs:
                if end[b] - (start + a) <= self.depth:
                    r = int(rank(np.array([start + a]), np.array([end[b]]))[0])
                    if r < none:
                        heapq.heappush(heap, (r, a, end[b]))
        at = [i for i in range(n) if alive[i]]
        return np.array(at) + start, np.array([end[i] for i in at])


class Codec:
    """Encodes and decodes whole texts, keeping the ids of words it has met."""

    def __init__(self, pieces: Pieces, cache_entries: int = 500_000):
        self.pieces, self.matcher, self.cache_entries = pieces, Matcher(pieces), cache_entries
        self.cache: dict[str, bytes] = {}
        # No piece has a blank after another character, nor a control character beside any: words end there.
        joined = set("".join(t for t in pieces.texts if len(t) > 1))
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        if any(BLANK in t.lstrip(BLANK) for t in pieces.texts):
            raise ValueError("a piece has a blank inside; words cannot be encoded apart")
        self.words = re.compile(f"[{alone}]|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        parts = [self.words(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.cache) > self.cache_entries:
            self.cache.clear()
        new = list({w for p in parts for w in p if w not in self.cache})
        self.cache.update(zip(new, self.matcher.encode(new)))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.pieces.surface.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def encode_pieces(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, their number, and whether decoding gives the text back.

    A null or empty text has no ids and is given back. A text that holds the blank mark U+2581
    itself comes back with spaces there, so ``round_trip`` is false for it, as in the format.
    Repeated rows give repeated results; an empty table gives none; other columns are not carried.
    No row is shuffled: memory is bound by the bytes of a slice of a batch, or of one longer text, and the cache of words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.load(model_file))

    def make():
        codec = Codec(shared.value)

        def encode(texts: list) -> dict:
            texts = [t or "" for t in texts]
            ids = codec.encode(texts)
            back = [codec.decode(i.tolist()) == t for i, t in zip(ids, texts)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            return {"n_tokens": [len(i) for i in ids], "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.array([], np.int32), pa.int32())), "round_trip": back}

        return encode

    return map_texts(docs, id_col, text_col, make, {"n_tokens": "long", "ids": "array<int>", "round_trip": "boolean"})


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """Texts of rows (doc_id, ids); a null list gives an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
