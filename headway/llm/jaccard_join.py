"""N-gram Jaccard join by signature trees.

1. A document becomes the set of its distinct word shingles (64-bit codes).  Equal sets are one class from
   here on, so copies are never compared.
2. Codes have a common order: rare ones first, so that passages which many documents share come last, then long
   words first.  How often a code occurs is counted over all documents in ``2 ** ORDER_BITS`` counters, a
   bound that doesn't grow; codes of one counter count as one, which only concerns the order.  Two sets that reach
   the threshold must share one of their first n - ceil(t * n) + 1 codes.  These meet in one exchange, as packed arrays
   by parts of the code space, which drops codes that only one class has there; a code that a batch has often is
   known to be shared, and its rows don't go to its part.  The others are split by size: as linked sets differ in size by the threshold at most, each two neighbouring steps of a
   scale of sizes are a cell of the join.  Of cells with the same classes one stays.
3. In a cell a signature tree is built over the classes in the order of size and bitmap: its nodes hold the OR
   and the AND of their members' bitmaps and their range of sizes.  A dual traversal descends from the
   pair (root, root) and prunes a node pair if its maximum possible overlap (sizes, less bits that one
   side surely has and the other surely lacks) can't reach the threshold.  A pair of classes belongs to the cell of
   the first code that both share and of the smaller size step, so no other cell looks at it.
4. The traversal names the classes that have a possible partner in the cell, never the pairs.  It runs twice:
   with bitmaps of a quarter of the code space, which refute unrelated sets at a few bytes each, and, for what
   they leave, with bitmaps of whole sets.  Only the exact
   sets of what is left then are dealt to the cell again, where links are settled class by class: one expansion counts the codes
   that a class shares with all others, a class inside a component that is known is not expanded against
   it, and links that join nothing new are left out.  A cell of k classes gives k - 1 links at most, and no
   link between different components is lost.
5. A cell of over ``BLOCK`` classes (or ``BLOCK_CODES`` codes) is cut into blocks at random, ``MIXES`` times over,
   so that a large group of near copies becomes one component whatever block its members are in.  A second round
   takes all pairs of blocks of the cells that still have several components; inside a component it compares
   nothing.

Edge cases: a text of fewer words than a shingle has the whole word sequence as its one shingle; null texts
and texts without words have an empty set and link with nothing; repeated rows are one class; rows with
null id take part, the smallest non-null id names the component; an empty table gives an empty result; texts of
any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.components import components
from headway.llm.shared import among, drop_stored, shuffle_width, stored, text_rows
from headway.llm.textvec import NONSPACE, Words, chunks, member, mix64

BITS = 128
BITS_PER_CODE = 4
SLICE = 2  # bits: the first bitmaps hold one code of 2 ** SLICE
NODE_BYTES = 1024  # of a tree's bitmaps, at most
LEAF = 16
HELD = 8_000_000  # bytes of bitmaps compared at once
FANOUT = 4
BLOCK = 2000
BLOCK_CODES = 4_000_000
MIXES = 2
BROADCAST_IDS = 1_000_000  # rows of 24 bytes
ORDER_BITS = 20  # counters of the common order
SLICE_BITS = 12  # counters that travel as one row
PART_CODES = 2_000_000  # first codes in a part of the exchange
OFTEN = 8  # rows of a code in a batch that go to its part


def _sets(part: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted codes of each row's set: 4 bits for the length of the words, long first, then 56 bits of hash."""
    w = Words(part.column("text"), NONSPACE)
    at, h = w.windows(n)
    counts, out = w.counts(), []
    size = (w.end - w.start).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(size)))
    code = (h >> np.uint64(8)) | _long_first(total[at + n] - total[at])
    bounds = np.searchsorted(at, w.first)
    for r, c in enumerate(counts):
        if c >= n:
            out.append(np.unique(code[bounds[r] : bounds[r + 1]]))
        elif c:
            whole = np.uint64(c)
            for x in w.hash[w.first[r] : w.first[r + 1]]:
                whole = mix64(np.array([whole]) * np.uint64(31) + x)[0]
            out.append((whole >> np.uint64(8)) | _long_first(total[w.first[r + 1] : w.first[r + 1] + 1] - total[w.first[r]]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _long_first(length: np.ndarray) -> np.ndarray:
    return (15 - np.minimum(length >> 2, 15)).astype(np.uint64) << np.uint64(56)


def _counter(codes: np.ndarray) -> np.ndarray:
    return (mix64(codes) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _often(n: int):
    """A task's counters of codes, by slices of those that are not all zero."""

    def run(batches):
        seen, width = np.zeros(1 << ORDER_BITS, dtype=np.int64), 1 << SLICE_BITS
        for batch in batches:
            for part in chunks(batch):
                at, c = np.unique(_counter(np.concatenate(_sets(part, n))), return_counts=True)
                seen[at] += c
        for k in range(0, len(seen), width):
            own = seen[k : k + width]
            if own.any():
                own = own.astype(np.min_scalar_type(own.max()))  # 1, 2, 4 or 8 bytes a counter
                yield pa.RecordBatch.from_arrays([pa.array([k // width], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["slice", "counts"])

    return run


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[k] = np.frombuffer(counts, dtype=f"u{len(counts) >> SLICE_BITS}").astype(np.int64) + total.get(k, 0)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])


def frequency_levels(rows: DataFrame, n: int) -> np.ndarray:
    """0 to 7 for each counter: 0 up to four times the mean of all counters, each further level four times as much."""
    counts, width = np.zeros(1 << ORDER_BITS, dtype=np.int64), 1 << SLICE_BITS
    kinds = "slice int, counts binary"
    # 2 ** ORDER_BITS numbers
    for r in rows.mapInArrow(_often(n), kinds).repartition("slice").mapInArrow(_summed, kinds).collect():
        counts[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.counts, dtype=np.int64)
    return np.clip(np.floor(np.log2(np.maximum(counts / max(1.0, counts.mean()), 1)) / 2), 0, 7).astype(np.uint8)


def _bitmap(codes: np.ndarray, n: int) -> bytes:
    """Bits of some codes: at least ``BITS``, and at least n, a power of two."""
    bits = np.zeros(max(BITS, 1 << int(n - 1).bit_length()), dtype=bool)
    bits[(mix64(codes) % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _bitmaps(codes: np.ndarray) -> tuple[bytes, bytes]:
    """The bitmap of a slice of the code space, the same for all sets, and that of all codes: a bit that another
    set's bitmap lacks is a code that it lacks."""
    some = codes[mix64(codes + np.uint64(1)) >> np.uint64(64 - SLICE) == 0]
    return _bitmap(some, BITS_PER_CODE * len(codes) >> SLICE), _bitmap(codes, BITS_PER_CODE * len(codes))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _fingerprint(codes: np.ndarray) -> int:
    """An order-free 64-bit name of a set; 0 for the empty one."""
    if not len(codes):
        return 0
    mixed = mix64(codes)
    both = np.array([np.bitwise_xor.reduce(mixed), mixed.sum(dtype=np.uint64)], dtype=np.uint64)
    return int(mix64(both[:1] * np.uint64(3) + mix64(both[1:])).view(np.int64)[0])


def _digest(n: int, num: int, den: int, levels):
    """levels: broadcast of ``frequency_levels``."""

    def first(s: np.ndarray) -> np.ndarray:
        ranked = s | (levels.value[_counter(s)].astype(np.uint64) << np.uint64(60))
        size = len(s) - -(-len(s) * num // den) + 1
        return _signed(np.sort(np.partition(ranked, size - 1)[:size]))

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                sets = _sets(part, n)
                size = [len(s) for s in sets]
                fp = [_fingerprint(s) for s in sets]
                prefix = [first(s) if len(s) else np.zeros(0, np.int64) for s in sets]
                both = [_bitmaps(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), *(pa.array([x[k] for x in both], pa.binary()) for k in (0, 1))], ["doc_id", "n", "fp", "prefix", "part_bm", "bm"])

    return run


def _codes(n: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                sets = _sets(part, n)
                yield pa.RecordBatch.from_arrays([part.column("fp"), pa.array([_signed(s) for s in sets], pa.list_(pa.int64()))], ["fp", "codes"])

    return run


def _packed(parts: int, scale: float):
    """First codes of classes, packed by part of the code space; ``sure``: codes that are shared, in any part."""

    def run(batches):
        for batch in batches:
            prefix, fp = batch.column("prefix"), batch.column("fp").to_numpy()
            offsets = prefix.offsets.to_numpy()
            code = prefix.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            row = np.repeat(np.arange(len(fp)), np.diff(offsets))
            step = np.floor(np.log(batch.column("n").to_numpy()) / scale).astype(np.int32)
            part = (mix64(code.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((code, part))
            code, row, part = code[order], row[order], part[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))[: len(code)]
            sure = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code)))) >= OFTEN
            part[sure] = (mix64(fp[row[sure]].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((row, sure, part))
            code, row, part, sure = code[order], row[order], part[order], sure[order]
            begin = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (sure[1:] != sure[:-1]))))[: len(code)]
            end = np.append(begin[1:], len(code))
            packed = [[x[s:e].tobytes() for s, e in zip(begin, end, strict=True)] for x in (code, fp[row], step[row])]
            yield pa.RecordBatch.from_arrays([pa.array(part[begin], pa.int32()), pa.array(sure[begin]), *(pa.array(x, pa.binary()) for x in packed)], ["part", "sure", "code", "fp", "step"])

    return run


def _shared(batches):
    """(fp, step, code) of the codes that several classes have, from packed rows in the order of their parts.

    A part's codes are held once each, however often they occur.
    """
    held: list = []

    def rows(code, fp, step):
        for go in range(0, len(code), 100_000):
            at = slice(go, go + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(step[at]), pa.array(code[at])], ["fp", "step", "code"])

    def fold():
        code, fp, step, known = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((~known, code))  # what is known comes first
        code, fp, step, known = code[order], fp[order], step[order], known[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        size = np.diff(np.append(first, len(code)))
        new = np.repeat(size > 1, size) & ~known
        held[:] = [(code[first], fp[first], step[first], known[first] | (size > 1))]
        yield from rows(code[new], fp[new], step[new])

    now, waiting = None, 0
    for batch in batches:
        for part, sure, code, fp, step in zip(*(batch.column(c).to_pylist() for c in ("part", "sure", "code", "fp", "step")), strict=True):
            code, fp, step = np.frombuffer(code, np.int64), np.frombuffer(fp, np.int64), np.frombuffer(step, np.int32)
            if sure:
                yield from rows(code, fp, step)
                continue
            if held and (part != now or waiting > PART_CODES):
                yield from fold()
                held, waiting = [] if part != now else held, 0
            now, waiting = part, waiting + len(code)
            held.append((code, fp, step, np.zeros(len(code), dtype=bool)))
    if held:
        yield from fold()


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class Bitmaps:
    """Bitmaps of different widths; wider ones are folded to the other's width by OR."""

    def __init__(self, raw: list[bytes]) -> None:
        self.raw = raw
        self.width = np.fromiter(map(len, raw), np.int64, len(raw))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of each in the table, table of 64-bit words) of all that are as wide or wider."""
        if width not in self.known:
            place, parts, done = np.full(len(self.raw), -1), [], 0
            for w in np.unique(self.width[self.width >= width]):
                rows = np.flatnonzero(self.width == w)
                m = np.frombuffer(b"".join([self.raw[i] for i in rows]), dtype=np.uint64).reshape(len(rows), -1, width // 8)
                parts.append(np.bitwise_or.reduce(m, axis=1))
                place[rows] = done + np.arange(len(rows))
                done += len(rows)
            self.known[width] = place, np.concatenate(parts)
        return self.known[width]

    def misses(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pair by pair: bits of x that y lacks, and bits of y that x lacks."""
        out, width = np.zeros((2, len(x)), dtype=np.int64), np.minimum(self.width[x], self.width[y])
        for w in np.unique(width):
            place, m = self.folded(int(w))
            rows = np.flatnonzero(width == w)
            for at in np.array_split(rows, -(-len(rows) * int(w) // HELD)):
                p, q = m[place[x[at]]], m[place[y[at]]]
                out[0, at], out[1, at] = _bits(p & ~q), _bits(q & ~p)
        return out[0], out[1]


def _near(n: np.ndarray, maps: Bitmaps, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs that can reach the threshold by their sizes and bitmaps: a bit that the other lacks is a code that it lacks."""
    fits = np.minimum(n[a], n[b]) * den >= num * np.maximum(n[a], n[b])
    at = np.flatnonzero(fits)
    a, b = a[at], b[at]
    one, other = maps.misses(a, b)
    fits[at] = np.minimum(n[a] - one, n[b] - other) * (num + den) >= num * (n[a] + n[b])
    return fits


class SignatureTree:
    """Levels from leaves to root; ``lo``, ``hi``: sizes; ``any``, ``all``: OR and AND of bitmaps; ``comp``: a mark if mixed."""

    def __init__(self, n: np.ndarray, raw: list[bytes], comp: np.ndarray, blk: np.ndarray) -> None:
        place, m = Bitmaps(raw).folded(min(NODE_BYTES, min(map(len, raw))))
        bm = m[place]
        self.order = np.lexsort((*bm.T[:2], n))
        self.n, self.maps, self.comp, self.blk = n[self.order], Bitmaps([raw[i] for i in self.order]), comp[self.order], blk[self.order]
        self.two = self.blk.min() != self.blk.max()
        bm = bm[self.order]
        self.levels = []
        lo, hi, some, every, uniform = self.n, self.n, bm, bm, self.comp
        step = LEAF
        while not self.levels or len(lo) > 1:
            at = np.arange(0, len(lo), step)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            some, every = np.bitwise_or.reduceat(some, at), np.bitwise_and.reduceat(every, at)
            first = uniform[at]
            same = np.minimum.reduceat(uniform, at) == np.maximum.reduceat(uniform, at)
            uniform = np.where(same, first, np.iinfo(np.int64).min)
            self.levels.append((lo, hi, some, every, uniform))
            step = FANOUT

    def _open(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Node pairs that may hold a link between components."""
        lo, hi, some, every, uniform = self.levels[level]
        most = np.minimum(hi[i] - _bits(every[i] & ~some[j]), hi[j] - _bits(every[j] & ~some[i]))
        inside = (uniform[i] == uniform[j]) & (uniform[i] != np.iinfo(np.int64).min)
        return ~inside & (most * (num + den) >= num * (lo[i] + lo[j]))

    def leaf_pairs(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (a leaf and itself too) that survive the dual traversal, in a fixed order."""
        i = j = np.zeros(1, dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ok = self._open(level, i, j, num, den)
            i, j = i[ok], j[ok]
            if level:
                size = len(self.levels[level - 1][0])
                child = np.arange(FANOUT)
                a = (i[:, None, None] * FANOUT + child[None, :, None] + 0 * child[None, None, :]).ravel()
                b = (j[:, None, None] * FANOUT + child[None, None, :] + 0 * child[None, :, None]).ravel()
                ok = (a < size) & (b < size) & (a <= b)
                i, j = a[ok], b[ok]
        order = np.lexsort((j, i, i != j))  # a leaf with itself first: like sets are neighbours
        return i[order], j[order]

    def partners(self, num: int, den: int, own) -> np.ndarray:
        """Marks the classes with a possible partner; ``own`` tells which pairs (a, b) the cell has to look at."""
        marked = np.zeros(len(self.n), dtype=bool)
        i, j = self.leaf_pairs(num, den)
        width, at = -(-len(self.n) // LEAF), np.arange(LEAF)
        for go in range(0, len(i), 256):
            full = np.logical_and.reduceat(marked, np.arange(0, len(marked), LEAF))[:width]
            p, q = i[go : go + 256], j[go : go + 256]
            todo = ~(full[p] & full[q])
            p, q = p[todo], q[todo]
            a = (p[:, None, None] * LEAF + at[None, :, None] + 0 * at[None, None, :]).ravel()
            b = (q[:, None, None] * LEAF + at[None, None, :] + 0 * at[None, :, None]).ravel()
            ok = (a < b) & (b < len(self.n))
            a, b = a[ok], b[ok]
            ok = (self.comp[a] != self.comp[b]) & ~(marked[a] & marked[b])
            if self.two:
                ok &= self.blk[a] != self.blk[b]
            a, b = a[ok], b[ok]
            ok = _near(self.n, self.maps, a, b, num, den)
            a, b = a[ok], b[ok]
            ok = own(self.order[a], self.order[b])
            marked[a[ok]] = marked[b[ok]] = True
        out = np.zeros(len(self.n), dtype=bool)
        out[self.order] = marked
        return out


def _whole_cells(batches):
    """Tables of whole cells, from batches in the order of ``cell``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        change = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        if held and len(cells) and held[-1].column("cell")[-1].as_py() != cells[0]:
            change = np.concatenate(([0], change))
        if not len(change):  # the last cell goes on
            held.append(batch)
            continue
        cut = int(change[-1])
        yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: What a class's row in a cell holds; ``home``: the cell's size step is its own.
_ROW = {"cell": "long", "code": "long", "fp": "long", "comp": "long", "blk": "int", "home": "boolean"}


def _one(column) -> pa.Array:
    """A column as one array."""
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


class _Lower:
    """Shared first codes of each row that come before its cell's code."""

    def __init__(self, codes: pa.Array, code: np.ndarray) -> None:
        offsets, flat = codes.offsets.to_numpy(), codes.values.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(code)), np.diff(offsets))
        flat = flat[offsets[0] : offsets[-1]]
        before = flat < code[row]
        self.flat, row = flat[before].view(np.uint64), row[before]
        self.first = np.searchsorted(row, np.arange(len(code) + 1))
        self.keys = np.sort(mix64(self.flat ^ mix64(row.astype(np.uint64))))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of rows without a common code before the cell's."""
        size = self.first[a + 1] - self.first[a]
        owner = np.repeat(np.arange(len(a)), size)
        at = np.arange(len(owner)) + np.repeat(self.first[a] - np.cumsum(size) + size, size)
        common = member(mix64(self.flat[at] ^ mix64(b[owner].astype(np.uint64))), self.keys) >= 0
        return np.bincount(owner[common], minlength=len(a)) == 0


def _candidates(num: int, den: int, first: bool):
    """The rows of the classes that may have a partner in the cell; not ``first``: pairs that share an earlier code don't count."""

    def run(batches):
        for table in _whole_cells(batches):
            if not table.num_rows:
                continue
            cells, code, fp, n, comp, blk = (table.column(c).to_numpy() for c in ("cell", "code", "fp", "n", "comp", "blk"))
            home = table.column("home").to_numpy(zero_copy_only=False)
            raw = table.column("bm").to_pylist()
            lower = None if first else _Lower(_one(table.column("codes")), code)
            begin = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            size = np.diff(np.append(begin, len(cells)))
            number = np.repeat(np.arange(len(begin)), size)

            def own(a, b, home=home, lower=lower):
                ok = home[a] | home[b]
                if lower is not None:
                    at = np.flatnonzero(ok)
                    ok[at] = lower.apart(a[at], b[at])
                return ok

            marked, two = np.zeros(len(cells), dtype=bool), two_blocks(blk, begin, size, number)
            few = np.flatnonzero((size <= LEAF)[number])  # cells of a leaf's size have no tree
            maps = Bitmaps([raw[i] for i in few])
            for d in range(1, int(size[size <= LEAF].max(initial=0))):
                a = np.flatnonzero(number[few[:-d]] == number[few[d:]]) if len(few) > d else np.zeros(0, np.int64)
                p, q = few[a], few[a + d]
                ok = (comp[p] != comp[q]) & ((blk[p] != blk[q]) | ~two[p])
                a, p, q = a[ok], p[ok], q[ok]
                ok = _near(n[few], maps, a, a + d, num, den)
                p, q = p[ok], q[ok]
                ok = own(p, q)
                marked[p[ok]] = marked[q[ok]] = True
            for k in np.flatnonzero(size > LEAF):
                at = slice(begin[k], begin[k] + size[k])
                tree = SignatureTree(n[at], raw[at], comp[at], blk[at])
                marked[at] = tree.partners(num, den, lambda a, b, base=begin[k], own=own: own(a + base, b + base))
            at = pa.array(np.flatnonzero(marked))
            yield pa.RecordBatch.from_arrays([_one(table.column(c)).take(at) for c in _ROW], list(_ROW))

    return run


def two_blocks(blk: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Rows of cells that hold two blocks."""
    return (np.minimum.reduceat(blk, begin) != np.maximum.reduceat(blk, begin))[number]


def cell_links(sets: list[np.ndarray], comp: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between different components that join all members which can be joined; at most members - 1.

    A member is expanded by counting its codes' places in all others; what is in the component that is left at
    last needs no expansion.
    """
    k = len(sets)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    _, label = np.unique(comp, return_inverse=True)
    if k == 2:
        same = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if label[0] != label[1] and same * (num + den) >= num * n.sum() else []
    owner = np.repeat(np.arange(k), n)
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = (count > 1)[ids]
    owner, ids = owner[often], ids[often]
    first = np.searchsorted(owner, np.arange(k + 1))
    order = np.argsort(ids, kind="stable")
    holder, start = owner[order], np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(count)))))
    open_, out = np.ones(k, dtype=bool), []
    while True:
        left = np.bincount(label[open_], minlength=k)
        some = left[label]
        v = int(np.argmin(np.where(open_, some, k + 1)))
        if not open_[v] or some[v] == open_.sum():  # what is left is one component
            return out
        open_[v] = False
        mine = ids[first[v] : first[v + 1]]
        span = start[mine + 1] - start[mine]
        at = np.arange(int(span.sum())) + np.repeat(start[mine] - np.cumsum(span) + span, span)
        same = np.bincount(holder[at], minlength=k)
        linked = np.flatnonzero((same * (num + den) >= num * (n + n[v])) & (label != label[v]))
        for u in linked:
            if label[u] != label[v]:
                out.append((v, int(u)))
                label[label == label[u]] = label[v]


def _links(num: int, den: int):
    def run(batches):
        for table in _whole_cells(batches):
            if not table.num_rows:
                continue
            cells, fp, comp = (table.column(c).to_numpy() for c in ("cell", "fp", "comp"))
            codes = _one(table.column("codes"))
            offsets, flat = codes.offsets.to_numpy(), codes.values.to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            a, b = [], []
            for s, e in zip(begin, np.append(begin[1:], len(cells)), strict=True):
                for x, y in cell_links([flat[offsets[i] : offsets[i + 1]] for i in range(s, e)], comp[s:e], num, den) if e - s > 1 else ():
                    a.append(fp[s + x])
                    b.append(fp[s + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b) if a else [], pa.int64()), pa.array(np.maximum(a, b) if a else [], pa.int64())], ["a", "b"])

    return run


def shared_codes(spark: SparkSession, classes: DataFrame, scale: float) -> DataFrame:
    """(fp, step, code), stored, of the first codes that several of the classes (fp, n, prefix) have; ``step``: the class's step on the scale of sizes."""
    first_codes = classes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0)).alias("n")).first().n
    width = shuffle_width(spark)
    packed = classes.select("fp", "n", "prefix").mapInArrow(_packed(max(width, math.ceil(first_codes / PART_CODES)), scale), "part int, sure boolean, code binary, fp binary, step binary")
    return stored(spark, packed.repartition(width, "part").sortWithinPartitions("part").mapInArrow(_shared, "fp long, step int, code long"))


def groups(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, row_key (hash of the text), n_shingles, component_id, group_key of every document, at a similarity of num / den or more.

    ``group_key`` is one value for each component, also where ids are null or repeat; null without words.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("row_key", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    width = shuffle_width(spark)
    levels = spark.sparkContext.broadcast(frequency_levels(rows, n))
    digests = stored(spark, rows.mapInArrow(_with_key(_digest(n, num, den, levels)), f"doc_id {kind}, row_key long, n long, fp long, prefix array<long>, part_bm binary, bm binary"))
    place = F.struct("row_key", F.xxhash64("doc_id").alias("id_hash"), "prefix", "part_bm", "bm")
    classes = digests.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min(place).alias("own"))
    classes = stored(spark, classes.select("fp", "rep", "n", "own.*"))
    ids = stored(spark, digests.select("doc_id", "row_key", "n", "fp"))
    drop_stored(spark, digests)
    scale = 1.001 * max(0.01, math.log(den / num))  # sets whose sizes allow a link are at most one step apart
    cells = shared_codes(spark, classes, scale)
    sized = cells.select("fp", "code", F.explode(F.array(F.struct("step", F.lit(True).alias("home")), F.struct((F.col("step") - 1).alias("step"), F.lit(False).alias("home")))).alias("s")).select("fp", "code", "s.*")
    # of cells with the same classes, by count and two hashes of them, the first stays
    stamps = sized.groupBy("code", "step").agg(F.count("*").alias("size"), F.max("home").alias("home"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum(F.xxhash64("fp", F.lit(1)).bitwiseAND((1 << 32) - 1)).alias("y")).where("size > 1 and home")
    held = F.col("size") * F.exp((F.col("step") + 2) * scale)  # codes, at most
    parts = F.greatest(F.ceil(F.col("size") / block), F.ceil(held / BLOCK_CODES)).cast("int")
    kept = stored(spark, stamps.groupBy("size", "x", "y", "step").agg(F.min("code").alias("code")).select("code", "step", parts.alias("m")))
    members = stored(spark, sized.join(kept, ["code", "step"]).select("fp", "code", "step", "home", "m"))
    drop_stored(spark, kept)
    some, whole = classes.select("fp", "n", F.col("part_bm").alias("bm")), classes.select("fp", "n", "bm")
    row = ", ".join(f"{c} {t}" for c, t in _ROW.items())

    def block_of(seed) -> F.Column:
        return F.pmod(F.xxhash64("fp", "code", seed), F.col("m")).cast("int")

    def found(part: DataFrame) -> DataFrame:
        """Links of the cells in ``part`` (cell, fp, code, home, blk, comp)."""
        in_cells = lambda df: df.repartition(width, "cell").sortWithinPartitions("cell", "fp")
        maybe = stored(spark, in_cells(part.join(some, "fp")).mapInArrow(_candidates(num, den, True), row))
        own = cells.join(maybe.select("fp").distinct(), "fp").groupBy("fp").agg(F.array_sort(F.collect_list("code")).alias("codes"))  # a class's first codes
        before = F.filter("codes", lambda c: c < F.col("code")).alias("codes")  # all that tells whether a pair belongs to an earlier cell
        likely = in_cells(maybe.join(whole.join(own, "fp"), "fp").select(*_ROW, "n", "bm", before)).mapInArrow(_candidates(num, den, False), row)
        likely = stored(spark, likely.select("cell", "fp", "comp"))
        asked = stored(spark, classes.join(likely.select("fp").distinct(), "fp").select("fp", F.col("row_key").alias("own_key"), F.col("id_hash")))
        known = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
        texts = rows.where("text is not null").join(known, F.col("row_key") == F.col("own_key")).where(F.xxhash64("doc_id") == F.col("id_hash")).select("fp", "text")
        sets = stored(spark, texts.mapInArrow(_codes(n), "fp long, codes array<long>").dropDuplicates(["fp"]))
        links = stored(spark, in_cells(likely.join(sets.hint("merge"), "fp")).mapInArrow(_links(num, den), "a long, b long").distinct())
        drop_stored(spark, maybe, likely, asked, sets)
        return links

    multi = F.col("m") > 1
    mixes = members.withColumn("seed", F.explode(F.when(multi, F.array(*[F.lit(i) for i in range(MIXES)])).otherwise(F.array(F.lit(0)))))
    start = mixes.select("fp", F.col("fp").alias("comp"), F.xxhash64("code", "step", "seed", block_of("seed")).alias("cell"), "code", "home", F.lit(0).alias("blk"))
    links = found(start)
    comps = components(spark, links)
    drop_stored(spark, links)
    large = members.where(multi).join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("component", "fp")).drop("component")
    large = stored(spark, large.withColumn("blk", block_of(F.lit(0))))
    mixed = large.groupBy("code", "step").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("code", "step")
    pairs = large.join(mixed, ["code", "step"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).where("other <> blk")
    todo = stored(spark, pairs.select("fp", "comp", F.xxhash64("code", "step", F.least("blk", "other"), F.greatest("blk", "other"), F.lit("two")).alias("cell"), "code", "home", "blk"))
    if not todo.isEmpty():
        more = found(todo)
        known = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))  # stands for all links before
        comps = components(spark, known.unionByName(more))
        drop_stored(spark, more)
    named = classes.select("fp", "rep").join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = stored(spark, named.groupBy("component").agg(F.min("rep").alias("component_id")))
    of_class = stored(spark, named.join(smallest, "component").select("fp", "component_id", F.col("component").alias("group_key")))
    drop_stored(spark, classes, cells, members, large, todo, smallest)
    out = ids.withColumn("fp", F.when(F.col("n") > 0, F.col("fp"))).join(of_class, "fp", "left")
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "group_key")


def _with_key(digest):
    def run(batches):
        def keys():
            for batch in batches:
                for part in chunks(batch):
                    held.append(part.column("row_key"))
                    yield part

        held: list = []
        for out in digest(keys()):
            yield pa.RecordBatch.from_arrays([out.column(0), held.pop(0), *[out.column(k) for k in range(1, out.num_columns)]], ["doc_id", "row_key", *out.schema.names[1:]])

    return run


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id (null last), then text hash.

    Rows of equal id and text count once.  Rows without words are in no component; they all stay.
    """
    found = stored(spark, groups(spark, docs, n, num, den, id_col=id_col, text_col=text_col))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    linked = found.where("n_shingles > 0")
    best = linked.groupBy("group_key").agg(F.min(order).alias("best"))
    gone = linked.join(best, "group_key").where(order != F.col("best")).select("doc_id", "row_key").distinct()
    again = linked.groupBy("doc_id", "row_key").count().where("count > 1").select("doc_id", "row_key")
    gone, again = stored(spark, gone.withColumnsRenamed({"doc_id": "_gone_id", "row_key": "_gone_key"})), stored(spark, again)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("row_key"))
    some, none = among(spark, packed, F.struct("doc_id", "row_key"), gone, F.struct("_gone_id", "_gone_key"))
    kept = none.unionByName(some.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("row_key") == F.col("_gone_key")), "left_anti"))
    if not again.isEmpty():
        twice = again.withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "row_key"]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
