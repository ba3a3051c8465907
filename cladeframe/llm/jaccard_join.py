"""Exact Jaccard join of n-gram sets in metric space.

Jaccard distance is a metric, and so is the size of the symmetric difference, which stays the same
if all sets are replaced by their differences from one pivot.

1. Pivots. Nearly all texts are at distance 1 of each other, where no triangle inequality can prune.
   So pivots are found by agreement: a document's shingles are dealt by hash into more parts than a
   linked pair can differ in, hence linked documents agree on a part whole. Below a similarity of 0.9 parts are small and
   often empty; there linked documents agree on one of the least elements of their sets, so many as a
   pair can differ in and one more, and each set has a bit for each of some buckets of hashes, whether the number
   of its elements there is odd. As two sets differ in one element at least for each bit that differs, most
   documents that agree on an element, but are linked with none that agrees on it, are sorted out before any
   set is moved. Of the documents that agree on a part the one with the most such agreements is a pivot, and all are measured against it. A pivot's region is
   the documents that were; each linked pair has a region in common. From here on a document
   is its difference from the pivot.
2. Regions of up to SMALL documents, of different components, are compared in full.
3. A larger region gets pivots of its own, so far apart that no document is near two of them, and is cut
   into their Voronoi cells. A document is at home in the cell of its nearest pivot, if that is within
   the cells' radius, else in the rest. By the triangle inequality a document that is linked with one at
   home is no farther from that pivot than the radius and the threshold: documents in this window are
   guests of the cell. So no document is in more than one cell, and besides in the rest.
4. A cell that is still large is centred on its median, the set of the elements that most of its documents
   have. Documents whose distances from it add up to the threshold are linked; all such links run over
   the document nearest to it. Any other two that are linked differ from the median in a common
   element, and agree on one of the rarest elements of their differences. So the cell is divided by
   these, as many as linked documents can differ in, and one more. The parts are the regions of the
   next round. No element sets more than half of a cell apart from its median, so a part has at most half of
   the documents, and the number of rounds is bounded by the logarithm of the largest region.

Nothing is capped; the result is exact up to 64-bit hashes. Only links that join components are looked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .graph import Labels
from .scratch import Scratch
from .shingles import Hasher, mix, set_hash

#: Size classes for parts grow by this factor.
CLASS_RATIO = 1.5
#: Sets of more parts are not dealt again for empty ones: at worst no part with elements agrees with a probability of 1e-24.
MANY_PARTS = 128
#: Groups of up to so many sets are compared by parities, so many pairs at once; numbers of parities of a set.
LIKELY, PAIRS, PARITIES = 1024, 20_000, (64, 1 << 15)
#: Regions of up to so many documents, with differences of up to so many elements, are compared in full by one task.
SMALL, SMALL_ELEMENTS = 512, 1 << 22
#: Cells of the matrices of a comparison.
MATRIX = 1 << 22
#: The radius of Voronoi cells, in multiples of the threshold's distance.
RADIUS = 2
#: A table of up to so many rows of two numbers is broadcast (some 50 MB).
BROADCAST_ROWS = 1_000_000
#: Bits of the table that holds which sets are wanted back; its size is fixed, hits beyond it are joined away.
WANTED_BITS = 24


class Classes:
    """Size classes and their numbers of parts. Sets of sizes a and b with a Jaccard similarity of at
    least num/den differ in at most (a + b) (den - num) / (den + num) elements."""

    def __init__(self, num: int, den: int):
        self.num, self.den, lows = num, den, [1]
        while lows[-1] < 1 << 31:
            lows.append(max(lows[-1] + 1, int(lows[-1] * CLASS_RATIO)))
        self.low = np.array(lows, np.int64)
        most = self.low[1:] - 1
        self.dealt = num * 10 >= den * 9
        # A pair belongs to the class of its larger set.
        self.parts = 2 * most * (den - num) // (den + num) + 1

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def above(self, n: np.ndarray) -> np.ndarray:
        """Class of the largest set that one of size n can be linked with."""
        return self.of(n * self.den // self.num)


def signatures(n: np.ndarray, values: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, given by sizes and concatenated elements in order: (row of the set, signature). They are parts,
    or the least elements."""
    rows, sigs = [], []
    own, top = classes.of(n), classes.above(n)
    starts = np.cumsum(n) - n
    if not classes.dealt:
        for step in (0, 1):
            chosen = np.flatnonzero((n > 0) & (own + step <= top))
            size, level = n[chosen], (own + step)[chosen]
            # A linked pair has that share of its larger set in common at least, and all but so many of either's elements.
            keep = size + 1 + -classes.num * np.maximum(size, classes.low[level]) // classes.den
            which = np.repeat(np.arange(len(chosen)), keep)
            at = np.repeat(starts[chosen] - (np.cumsum(keep) - keep), keep) + np.arange(keep.sum())
            rows.append(chosen[which])
            sigs.append(mix(values[at] ^ mix(level[which].astype(np.uint64), 3), 4))
        return np.concatenate(rows), np.concatenate(sigs)
    # A set that has a link partner in a higher class takes part there too; classes overlap by one at most.
    for step in (0, 1):
        chosen = np.flatnonzero((n > 0) & (own + step <= top))
        if not len(chosen):
            continue
        size, level = n[chosen], (own + step)[chosen]
        parts = classes.parts[level]
        at = np.repeat(starts[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        x = mix(values[at], 1)
        first = np.cumsum(parts) - parts
        part = (mix(x, 2) % np.repeat(parts, size).astype(np.uint64)).astype(np.int64)
        cell, cells = np.repeat(first, size) + part, int(parts.sum())
        which = np.repeat(np.arange(len(chosen)), parts)
        index = np.arange(cells) - first[which]
        code, count = _fold(x, cell, cells)
        tag = mix(level[which].astype(np.uint64) * np.uint64(1 << 32) + index.astype(np.uint64), 3)
        full = count > 0
        rows.append(chosen[which[full]])
        sigs.append(mix(code[full] ^ tag[full], 4))
        # Agreement on an empty part says nothing: there the set is dealt again, by another hash. Of many parts a linked
        # pair agrees on a third or more, and that all these are empty is less likely than that hashes agree by chance.
        for e in np.flatnonzero(~full & (parts[which] <= MANY_PARTS)):
            k = which[e]
            own_x = values[starts[chosen[k]] : starts[chosen[k]] + size[k]]
            y = mix(own_x, 5)
            m = int(parts[k])
            again, _ = _fold(y, (mix(y, 6) % np.uint64(m)).astype(np.int64), m)
            rows.append(np.full(m, chosen[k]))
            sigs.append(mix(again ^ mix(np.arange(m, dtype=np.uint64), 7) ^ tag[e], 8))
    if not rows:
        return np.array([], np.int64), np.array([], np.uint64)
    return np.concatenate(rows), np.concatenate(sigs)


def _fold(x: np.ndarray, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-free hash and number of the elements of each cell; halves are summed exactly as doubles."""
    low = np.bincount(cell, (x & np.uint64(0xFFFFFFFF)).astype(float), cells).astype(np.uint64)
    high = np.bincount(cell, (x >> np.uint64(32)).astype(float), cells).astype(np.uint64)
    return low + (high << np.uint64(32)), np.bincount(cell, minlength=cells)


def parities(s: np.ndarray) -> np.ndarray:
    """Bits, some for each element, whether the number of elements that end in the bit's number is odd."""
    width = min(max(PARITIES[0], 1 << (len(s) - 1).bit_length() if len(s) else 1), PARITIES[1])
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def least_apart(held: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many elements pairs of sets differ at least, by their parities. Of different numbers of them the
    longer are folded."""
    width = np.array([len(x) for x in held], np.int64)
    least, out = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)
    for w in np.unique(least).tolist():
        folded, used = np.zeros((len(held), w), np.uint64), np.flatnonzero(least == w)
        for k in np.unique(np.concatenate((i[used], j[used]))).tolist():
            folded[k] = np.bitwise_xor.reduce(held[k].reshape(-1, w), axis=0)
        for first in range(0, len(used), PAIRS):
            u = used[first : first + PAIRS]
            out[u] = np.bitwise_count(folded[i[u]] ^ folded[j[u]]).sum(1)
    return out


def _described(docs: DataFrame, k: int, lower: bool, classes: Classes) -> DataFrame:
    """(doc_id, text) to (doc_id, node, n_shingles, sigs, odd): the hash of the set, its size, signatures and parities,
    without these if its signatures are parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(alnum=False, lower=lower)
        for batch in (b for whole in batches for b in pieces(whole, 1)):
            sets = [np.unique(g) for g in hasher.grams(batch.column(1), k)]
            n = np.array([len(s) for s in sets], np.int64)
            rows, sigs = signatures(n, np.concatenate(sets) if sets else np.array([], np.uint64), classes)
            by = np.argsort(rows, kind="stable")
            offsets = np.searchsorted(rows[by], np.arange(len(n) + 1)).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sigs[by].view(np.int64)))
            node = np.array([set_hash(s, 51) for s in sets], np.uint64).view(np.int64)
            odd = pa.array([None if classes.dealt else parities(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(n), values, odd], ["doc_id", "node", "n_shingles", "sigs", "odd"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, n_shingles long, sigs array<bigint>, odd binary")


def bit_table(numbers: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits bits with those of the numbers (64-bit hashes) set; at most 2**(bits - 5) rows reach the driver."""
    bit = F.pmod(F.col(numbers.columns[0]), F.lit(1 << bits))
    words = numbers.select(bit.alias("b")).groupBy(F.shiftright("b", 5).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 AS INT)))").alias("m")).toPandas()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    return table


def in_table(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the bits of the numbers are set."""
    b = numbers & np.uint64(len(table) * 32 - 1)
    return ((table[(b >> np.uint64(5)).astype(np.int64)] >> (b & np.uint64(31)).astype(np.uint32)) & 1).astype(bool)


def wanted(nodes: DataFrame, docs: DataFrame, k: int, seed: int, hasher: dict, described: Callable[[np.ndarray], np.ndarray] = np.unique, bits: int = WANTED_BITS) -> DataFrame:
    """One row (node, s) for each of ``nodes``, from the texts (doc_id, text). ``described`` makes s of a text's
    k-gram hashes, and the node is its hash. A table of bits of fixed size sorts out most of the other texts before any
    shuffle; a join takes the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(nodes.select("node"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hasher(**hasher)
        for batch in (b for whole in batches for b in pieces(whole, 1)):
            found = [(set_hash(s, seed), s) for s in map(described, words.grams(batch.column(1), k)) if len(s)]
            node = np.array([x[0] for x in found], np.uint64)
            keep = np.flatnonzero(in_table(shared.value, node))
            values = [found[i][1] for i in keep]
            offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
            data = np.concatenate(values) if values else np.array([], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(data.view(np.int64)))], ["node", "s"])

    found = docs.select("doc_id", "text").mapInArrow(run, "node long, s array<bigint>")
    return found.groupBy("node").agg(F.first("s").alias("s")).join(nodes.select("node"), "node", "left_semi")


class Threshold:
    """Similarity num/den as bounds on sizes and symmetric differences."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, n: int, m: int, apart: int) -> bool:
        """Whether sets of sizes n and m that differ in ``apart`` elements are similar enough."""
        return (n + m - apart) * self.den >= (n + m + apart) * self.num

    def distance(self, n: int, m: int, apart: int) -> float:
        return 2 * apart / max(1, n + m + apart)

    def score(self, n: Column, from_centre: Column) -> Column:
        """Two sets whose scores add up to at most 0 are linked: their distances from the centre suffice."""
        return from_centre * (self.den + self.num) - n * (self.den - self.num)

    def most_apart(self, n: Column) -> Column:
        """In how many elements a set of size n and one that it is linked with can differ at most."""
        largest = F.floor(n * self.den / self.num)
        return F.floor((n + largest) * (self.den - self.num) / (self.den + self.num))


def _likely(agree: DataFrame, known: DataFrame, limit: Threshold, scratch: Scratch) -> DataFrame:
    """Of groups (sig, node) the members that may be linked with another by their parities; of groups with the same
    members one. Groups of more than LIKELY are left whole: they are measured against one pivot each."""
    c = F.col
    same = agree.groupBy("sig").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("m")).groupBy("size", "m").agg(F.min("sig").alias("sig"))
    once = scratch.write(agree.join(same.select("sig", "size"), "sig"), "once")
    small = c("size") <= LIKELY
    odd = once.where(small).select("node").distinct().join(known.select("node", "n_shingles", "odd"), "node").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("odd").alias("odd"))

    def compare(sig: np.ndarray, node: np.ndarray, n: np.ndarray, odd: list[bytes]) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        sizes = np.diff(np.append(starts, len(sig)))
        held, likely = [np.frombuffer(x, np.uint64) for x in odd], np.zeros(len(sig), bool)
        for m in np.unique(sizes[sizes > 1]).tolist():
            i, j = np.triu_indices(m, 1)
            first = starts[sizes == m]
            step = max(1, PAIRS // len(i))
            for k in range(0, len(first), step):
                a, b = ((first[k : k + step, None] + x).ravel() for x in (i, j))
                near = limit.linked(n[a], n[b], np.maximum(least_apart(held, a, b), np.abs(n[a] - n[b])))
                likely[a[near]] = likely[b[near]] = True
        return pa.RecordBatch.from_arrays([pa.array(node[likely]), pa.array(sig[likely])], ["node", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in batches:
            if not len(batch):
                continue
            now = [*(batch.column(k).to_numpy() for k in range(3)), batch.column(3).to_pylist()]
            held = now if held is None else [*(np.concatenate((x, y)) for x, y in zip(held[:3], now)), held[3] + now[3]]
            # The last group may go on in the next batch.
            last = int(np.flatnonzero(held[0] == held[0][-1])[0])
            if last:
                yield compare(*[x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None:
            yield compare(*held)

    rows = once.where(small).join(odd, "node").select("sig", "node", "n", "odd").repartition("sig").sortWithinPartitions("sig")
    found = scratch.write(rows.mapInArrow(run, "node long, sig long").unionByName(once.where(~small).select("node", "sig")), "likely")
    scratch.drop(once)
    return found


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.array([], np.int64), pa.int64()))


def _rows(column: pa.Array) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _measured(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs (node, pivot) to members of the pivots' regions: (region, node, n, delta, home, linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = _rows(batch.column(2)), _rows(batch.column(3))
            # Sets are kept in the order of unsigned numbers; differences are sorted as signed ones.
            delta = [np.setxor1d(a, b, assume_unique=True) for a, b in zip(own, other)]
            linked = [limit.linked(len(a), len(b), len(d)) for a, b, d in zip(own, other, delta)]
            n = pa.array([len(a) for a in own], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), n, _lists(delta), pa.array([True] * len(own)), pa.array(linked, pa.bool_())], ["region", "node", "n", "delta", "home", "linked"])

    c = F.col
    rows = pairs.join(sets.select("node", c("s").alias("su")), "node").join(sets.select(c("node").alias("pivot"), c("s").alias("sv")), "pivot")
    return rows.select("node", "pivot", "su", "sv").mapInArrow(run, "region long, node long, n int, delta array<bigint>, home boolean, linked boolean")


def similar_pairs(n: np.ndarray, deltas: list[np.ndarray], limit: Threshold) -> np.ndarray:
    """Which pairs of sets are linked, as a matrix, from their sizes and their differences from one centre. Common
    elements are counted by products of 0/1 matrices of a bounded number of columns."""
    size = np.array([len(d) for d in deltas], np.int64)
    row = np.repeat(np.arange(len(n)), size)
    _, element, often = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
    row, element = row[often[element] > 1], element[often[element] > 1]
    _, element = np.unique(element, return_inverse=True)
    by = np.argsort(element, kind="stable")
    row, element = row[by], element[by]
    both, width = np.zeros((len(n), len(n)), np.float32), max(1, MATRIX // len(n))
    for first in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        a, b = np.searchsorted(element, [first, first + width])
        x = np.zeros((len(n), min(width, int(element[-1]) + 1 - first)), np.float32)
        x[row[a:b], element[a:b] - first] = 1
        both += x @ x.T
    apart = size[:, None] + size - 2 * both.astype(np.int64)
    total = n[:, None] + n
    return (total - apart) * limit.den >= (total + apart) * limit.num


def _compared(members: DataFrame, limit: Threshold) -> DataFrame:
    """Links (u, v) between components within small regions; of those that close a circle none."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node, home, component = (group[x].to_numpy() for x in ("node", "home", "component"))
        linked = similar_pairs(group["n"].to_numpy(np.int64), group["delta"].tolist(), limit)
        linked &= (home[:, None] | home) & (component[:, None] != component)
        root = {x: x for x in component.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        out = []
        for i, j in np.argwhere(np.tril(linked)).tolist():
            a, b = top(int(component[i])), top(int(component[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return members.select("region", "node", "n", "home", "component", "delta").groupBy("region").applyInPandas(run, "u long, v long")


def _cells(members: DataFrame, limit: Threshold) -> DataFrame:
    """Voronoi cells of large regions: rows (region, node, n, delta, home, link). A row with a link is one that was
    found with a pivot, and no member; the others are members of a cell, or of what lies beyond all cells."""
    c = F.col
    # The nearest to the old centre, the farthest from it, and one by hash.
    near = F.struct(F.size("delta"), "node")
    pivots = members.groupBy("region").agg(F.array_distinct(F.array(F.min_by("node", near), F.max_by("node", near), F.min_by("node", F.xxhash64("node")))).alias("p"))
    chosen = pivots.select("region", F.explode("p").alias("node")).join(members.select("region", "node", "n", "delta"), ["region", "node"])
    pivots = chosen.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("node", "n", "delta"))).alias("pivots"))
    edge = (limit.den - limit.num) / limit.den

    def apart(a: tuple, b: tuple) -> tuple[np.ndarray, float]:
        d = np.setxor1d(a[2], b[2], assume_unique=True)
        return d, limit.distance(a[1], b[1], len(d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple]] = {}
        for batch in batches:
            out: list[tuple] = []
            for region, node, n, delta, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _rows(batch.column(3)), batch.column(4)):
                if region not in known:
                    known.clear()
                    # Pivot, and whether it has a cell: it has none if it is too near to one before it.
                    known[region] = []
                    for p in found.as_py():
                        p = (p["node"], p["n"], np.array(p["delta"], np.int64))
                        known[region].append((p, all(apart(p, q)[1] > 2 * (RADIUS + 1) * edge + 1e-6 for q, cell in known[region] if cell)))
                me, own = (node, n, delta), known[region]
                far = {p[0]: apart(me, p) for p, _ in own}
                out += [(region, node, n, delta[:0], False, p[0]) for p, _ in own if p[0] != node and limit.linked(n, p[1], len(far[p[0]][0]))]
                if node in far:
                    continue
                best = min((p[0] for p, cell in own if cell), key=lambda x: far[x][1])
                at_home = far[best][1] <= RADIUS * edge
                if not at_home:
                    out.append((region, node, n, delta, True, None))
                if far[best][1] <= (RADIUS + 1) * edge + 1e-6:
                    name = mix(np.array([region ^ best], np.int64).view(np.uint64), 71).view(np.int64)[0]
                    out.append((int(name), node, n, far[best][0], at_home, None))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), _lists(list(columns[3])), pa.array(columns[4], pa.bool_()), pa.array(columns[5], pa.int64())], ["region", "node", "n", "delta", "home", "link"])

    rows = members.select("region", "node", "n", "delta").join(pivots, "region").select("region", "node", "n", "delta", "pivots")
    return rows.mapInArrow(run, "region long, node long, n int, delta array<bigint>, home boolean, link long")


def _centred(members: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Large cells centred on their medians (region, node, n, delta, home), and how many of a cell differ from the
    median in an element, if more than one (region, e, often)."""
    c = F.col
    often = members.select("region", "size", F.explode("delta").alias("e")).groupBy("region", "size", "e").agg(F.count("*").alias("often"))
    often = scratch.write(often.where("often > 1"), "often")
    most = often.where(c("often") * 2 > c("size")).groupBy("region").agg(F.collect_list("e").alias("median"))
    out = members.join(most, "region", "left").withColumn("median", F.coalesce("median", F.array().cast("array<bigint>")))
    delta = F.array_sort(F.concat(F.array_except("delta", "median"), F.array_except("median", "delta")))
    out = scratch.write(out.select("region", "node", "n", delta.alias("delta"), "home"), "centred")
    return out, often.select("region", "e", F.least("often", c("size") - c("often")).alias("often")).where("often > 1")


def _keyed(members: DataFrame, often: DataFrame, limit: Threshold) -> DataFrame:
    """Cells divided by the rarest elements of the differences: (part, region, node, home, d). Elements that no
    other member has are the rarest of all and make no part."""
    c = F.col
    el = members.select("region", "node", F.explode("delta").alias("e"))
    shared = el.join(often, ["region", "e"]).groupBy("region", "node").agg(F.sort_array(F.collect_list(F.struct("often", "e"))).alias("s"))
    rows = members.select("region", "node", "home", F.size("delta").alias("d"), limit.most_apart(c("n")).cast("int").alias("most")).join(shared, ["region", "node"])
    rows = rows.select("region", "node", "home", "d", F.explode_outer(F.slice("s", 1, F.greatest(F.lit(0), c("most") + 1 - (c("d") - F.size("s"))))).alias("s")).where(c("s").isNotNull())
    return rows.select(F.xxhash64("region", "s.e").alias("part"), "region", "node", "home", "d")


def _open(members: DataFrame, key: str) -> DataFrame:
    """Of members with components the regions (key, size, elements) that have several components and someone at home; of
    regions with the same members one."""
    c = F.col
    found = members.groupBy(key).agg(F.count("*").alias("size"), F.sum("d").alias("elements"), F.min("component").alias("a"), F.max("component").alias("b"), F.max("home").alias("home"), F.bit_xor(F.xxhash64("node", "home")).alias("m"))
    return found.where((c("a") < c("b")) & c("home")).groupBy("size", "m").agg(F.min_by("elements", key).alias("elements"), F.min(key).alias(key)).select(key, "size", "elements")


def link_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 9, den: int = 10, lower: bool = True) -> DataFrame:
    """Documents linked where the Jaccard similarity of their k-shingle sets is at least num/den.

    One row for each row of ``docs``: doc_id, n_shingles, component_id, the least doc_id that can be
    reached by links. A document without words has an empty set and no links, so its component is its
    own id. Rows of equal sets are one node, whatever their ids; a null id does not count for the
    least, unless all ids of a component are null. Other columns are not carried.
    """
    spark, c = docs.sparkSession, F.col
    if num * CLASS_RATIO < den:
        raise ValueError("the threshold is too low for the size classes")
    scratch, classes, limit = Scratch(spark, "jaccard"), Classes(num, den), Threshold(num, den)
    d = docs.select(c(id_col).alias("doc_id"), c(text_col).cast("string").alias("text"))
    known = scratch.write(_described(d, k, lower, classes), "sets")
    slim = known.select("doc_id", "node", "n_shingles")
    occ = known.select("node", F.explode("sigs").alias("sig"))
    groups = scratch.write(occ.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("sig"), "groups")
    few = groups.count() <= BROADCAST_ROWS
    agree = scratch.write(occ.join(F.broadcast(groups) if few else groups, "sig").distinct(), "agree")
    if not classes.dealt:
        whole, agree = agree, _likely(agree, known, limit, scratch)
        scratch.drop(whole)
    # The pivot is the one of most agreements, so that groups of one family have one pivot.
    most = agree.join(agree.groupBy("node").agg(F.count("*").alias("most")), "node")
    pivots = most.groupBy("sig").agg(F.max(F.struct("most", "node")).alias("m")).select("sig", c("m.node").alias("pivot"))
    pairs = scratch.write(agree.join(pivots, "sig").where("node <> pivot").select("node", "pivot").distinct(), "pairs")
    scratch.drop(groups, agree)
    nodes = pairs.select("node").union(pairs.select("pivot")).distinct()
    sets = scratch.write(wanted(nodes, d, k, 51, {"alnum": False, "lower": lower}), "wanted")
    region = scratch.write(_measured(pairs, sets, limit), "measured")
    scratch.drop(pairs, sets)
    labels = Labels(scratch)
    labels.add(region.where("linked").select(c("node").alias("u"), c("region").alias("v")))
    region = region.drop("linked")
    while True:
        sized = labels.of(region.withColumn("d", F.size("delta")))
        open_ = scratch.write(_open(sized, "region"), "open")
        if not open_.limit(1).count():
            break
        small = (c("size") <= SMALL) & ((c("elements") <= SMALL_ELEMENTS) | (c("size") <= 2))
        members = sized.join(open_, "region")
        links = _compared(members.where(small), limit)
        large = scratch.write(members.where(~small).select("region", "node", "n", "delta"), "large")
        if not large.limit(1).count():
            labels.add(links)
            break
        cells = scratch.write(_cells(large, limit), "cells")
        labels.add(links.unionByName(cells.where("link IS NOT NULL").select(c("node").alias("u"), c("link").alias("v"))))
        cells = cells.where("link IS NULL").drop("link")
        open_ = scratch.write(_open(labels.of(cells.withColumn("d", F.size("delta"))), "region"), "open")
        cells = cells.join(open_, "region")
        centred, often = _centred(cells.where(~small), scratch)
        scored = centred.select("region", "node", limit.score(c("n"), F.size("delta")).alias("score"))
        middle = scored.groupBy("region").agg(F.min(F.struct("score", "node")).alias("m"))
        star = scored.join(middle, "region").where((c("score") + c("m.score") <= 0) & (c("node") != c("m.node")))
        labels.add(star.select(c("node").alias("u"), c("m.node").alias("v")))
        parts = scratch.write(_keyed(centred, often, limit), "parts")
        kept = parts.join(_open(labels.of(parts), "part").select("part"), "part").drop("home").join(centred, ["region", "node"])
        kept = kept.select(c("part").alias("region"), "node", "n", "delta", "home")
        region = scratch.write(kept.unionByName(cells.where(small).select("region", "node", "n", "delta", "home")), "region")
    least = labels.of(slim).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    rooted = labels.of(slim.select("node").distinct()).join(least, "component").select("node", "component_id")
    out = slim.join(rooted, "node", "left")
    out = scratch.write(out.select("doc_id", "n_shingles", F.when(c("n_shingles") == 0, c("doc_id")).otherwise(c("component_id")).alias("component_id")), "result")
    scratch.keep(out)
    return out
