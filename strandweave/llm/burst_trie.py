"""A burst trie over sorted Arrow columns.

Inner nodes branch on one byte after their prefix, leaves are containers of terms with two counters.  A
container that outgrows its capacity bursts: it becomes an inner node whose children hold the slices of
the sorted terms.  Terms are inserted, and tries merged, in whole sorted columns, never one by one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCHEMA = pa.schema([("term", pa.large_binary()), ("occurrences", pa.int64()), ("records", pa.int64())])


def combine(t: pa.Table) -> pa.Table:
    """Counters of equal terms added, terms sorted."""
    t = t.combine_chunks().group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
    t = pa.table([t["term"], t["occurrences_sum"], t["records_sum"]], schema=SCHEMA)
    return t.take(pc.sort_indices(t["term"])).combine_chunks()


def flat(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], col.type)
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


class _Leaf:
    def __init__(self, prefix: bytes):
        self.prefix, self.parts, self.pending = prefix, [], 0


class _Node:
    def __init__(self, prefix: bytes):
        self.prefix, self.children = prefix, {}


class BurstTrie:
    def __init__(self, capacity: int = 1 << 15):
        self.capacity = capacity
        self.root: _Leaf | _Node = _Leaf(b"")

    def insert(self, t: pa.Table) -> None:
        """Adds sorted, distinct terms with their counters."""
        if t.num_rows:
            self.root = self._put(self.root, t)

    def merge(self, other: BurstTrie) -> None:
        """Adds the leaves of another trie; each lands below the node with the same prefix."""
        for _, t in other.leaves():
            self.insert(t)

    def leaves(self) -> Iterator[tuple[bytes, pa.Table]]:
        """Leaves in the order of their terms, each with its prefix."""
        stack = [self.root]
        while stack:
            n = stack.pop()
            if isinstance(n, _Node):
                stack.extend(n.children[b] for b in sorted(n.children, reverse=True))
            elif n.parts:
                self._compact(n)
                yield n.prefix, n.parts[0]

    def _compact(self, leaf: _Leaf) -> None:
        if len(leaf.parts) > 1:
            leaf.parts = [combine(pa.concat_tables(leaf.parts))]
        leaf.pending = leaf.parts[0].num_rows

    def _put(self, n: _Leaf | _Node, t: pa.Table) -> _Leaf | _Node:
        if isinstance(n, _Leaf):
            n.parts.append(t)
            n.pending += t.num_rows
            if n.pending <= self.capacity:
                return n
            self._compact(n)
            if n.pending <= self.capacity // 2:
                return n
            t, n = n.parts[0], _Node(n.prefix)
        for byte, part in self._branches(t, len(n.prefix)):
            child = n.children.get(byte) or _Leaf(n.prefix + (bytes([byte]) if byte >= 0 else b""))
            if byte < 0:  # the term that ends here; it can't burst any further
                child.parts.append(part)
                self._compact(child)
                n.children[byte] = child
            else:
                n.children[byte] = self._put(child, part)
        return n

    @staticmethod
    def _branches(t: pa.Table, depth: int) -> Iterator[tuple[int, pa.Table]]:
        """Slices of sorted terms by the byte at ``depth``; -1 for a term that has none."""
        off, data = flat(t["term"])
        at = off[:-1] + depth
        ends = at >= off[1:]
        byte = np.where(ends, -1, data[np.minimum(at, len(data) - 1)].astype(np.int16) if len(data) else -1)
        cut = np.flatnonzero(np.diff(byte)) + 1
        for a, b in zip([0, *cut], [*cut, len(byte)], strict=True):
            yield int(byte[a]), t.slice(a, b - a)


def pack(t: pa.Table) -> dict[str, bytes]:
    """A sorted leaf front-coded: shared prefix length and the rest of each term, and the counters."""
    off, data = flat(t["term"])
    n, lens = t.num_rows, np.diff(off)
    common = np.zeros(n, np.int64)
    if n > 1:
        alive = np.arange(1, n)
        depth = 0
        while len(alive):  # a step a byte, over all pairs of neighbours that agree so far
            ok = (lens[alive] > depth) & (lens[alive - 1] > depth)
            alive = alive[ok]
            alive = alive[data[off[alive] + depth] == data[off[alive - 1] + depth]]
            common[alive] += 1
            depth += 1
    rest = lens - common
    where = np.repeat(off[:-1] + common - np.cumsum(rest) + rest, rest) + np.arange(rest.sum())
    return {
        "shared": common.astype(np.uint32).tobytes(), "rest": rest.astype(np.uint32).tobytes(), "bytes": data[where].tobytes(),
        "occurrences": t["occurrences"].to_numpy().astype(np.int64).tobytes(), "records": t["records"].to_numpy().astype(np.int64).tobytes(),
    }


def unpack(shared: bytes, rest: bytes, data: bytes, occurrences: bytes, records: bytes) -> pa.Table:
    """The leaf that :func:`pack` coded."""
    common, rest = np.frombuffer(shared, np.uint32).astype(np.int64), np.frombuffer(rest, np.uint32).astype(np.int64)
    n, lens = len(common), common + rest
    off = np.concatenate([[0], np.cumsum(lens)])
    src = np.frombuffer(data, np.uint8)
    out = np.zeros(off[-1], np.uint8)
    where = np.repeat(off[:-1] + common - np.cumsum(rest) + rest, rest) + np.arange(rest.sum())
    out[where] = src
    # byte d of term i comes from the last term at or before i whose own part covers d
    for d in range(int(common.max(initial=0))):
        own = np.where((common <= d) & (lens > d), np.arange(n), 0)
        need = np.flatnonzero(common > d)
        out[off[need] + d] = out[off[np.maximum.accumulate(own)[need]] + d]
    term = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out)])
    return pa.table([term, pa.array(np.frombuffer(occurrences, np.int64)), pa.array(np.frombuffer(records, np.int64))], schema=SCHEMA)


def cut(t: pa.Table, bounds: list[bytes]) -> Iterator[tuple[int, pa.Table]]:
    """Slices of sorted terms by leaf number: leaf i holds the terms from bounds[i] on, up to bounds[i + 1].

    Only the bounds between the first and the last term are looked at, however many there are.
    """
    if not t.num_rows:
        return
    off, data = flat(t["term"])
    term = lambda i: data[off[i] : off[i + 1]].tobytes()
    first, last = (bisect_right(bounds, term(i)) - 1 for i in (0, t.num_rows - 1))
    at = 0
    for leaf in range(first, last + 1):
        end = bisect_left(range(t.num_rows), bounds[leaf + 1], lo=at, key=term) if leaf < last else t.num_rows
        if end > at:
            yield leaf, t.slice(at, end - at)
        at = end
