"""Long exact spans shared between records, by recompression.

Rounds of recompression parse all sequences: a round names adjacent pairs (a, b) with a from one half of the
symbols and b from the other, or runs of one symbol.  A name is a 64-bit mix of what it stands for, so every
task gives equal content the same name and the rounds need no exchange.  Each decision depends only on
neighbours and no symbol outgrows the cap of its round, so equal spans hold the same symbols but for a
margin of known width at either end.

1. Of the symbols between the margins of a span, the one with the least name stands for it; equal spans
   choose the same one, and most symbols are chosen by no span.  A chosen symbol is sent with its name, carried
   outwards over the margins that each of its spans holds, and with the stretch that its spans cover.
2. Spark brings equal names together.  A name of two records is revealed, and its spans are verified by
   extending both ways from the symbol, base by base, against all stretches of that name.
3. Verified spans of a record that overlap or touch are merged.

What is sent is one row a chosen symbol and stretch, combined over the records of a task before.  Stretches that
two records of a task have in common are known to be shared at once and wait for no other task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.scratch import Scratch

#: Odd multipliers of the mixing function.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Kinds of rounds and the longest symbol that each may make; as many are run as the wanted length allows.
ROUNDS = (("pair", 2), ("run", 4), ("pair", 8), ("run", 8), ("pair", 16), ("run", 32), ("pair", 64), ("run", 64))
#: Bases that one 64-bit word holds.
WORD = 32
#: Bases that a task parses at a time.
CHUNK = 1 << 21
#: Stretches that a task verifies at a time, about.
CELL = 1 << 16


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * MIX[0] & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def schedule(min_len: int) -> tuple[list[tuple[str, int]], int, int]:
    """The rounds for spans of ``min_len``, the margin at either end, and the longest symbol they make.

    A round moves the margin in which two equal spans may be parsed differently inwards by one symbol (pairs)
    or one run.  Rounds are added while a whole symbol surely lies between the margins.
    """
    done, margin, longest = [], 0, 1
    for kind, cap in ROUNDS:
        wider = margin + (longest if kind == "pair" else cap)
        if min_len < 2 * wider + 2 * cap - 1:
            break
        done.append((kind, cap))
        margin, longest = wider, cap
    return done, margin, longest


def parse(code: np.ndarray, rounds: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and name of the symbols; codes over 3 end a sequence and are no symbols."""
    begin = np.flatnonzero(code < 4)
    name = mix(code[begin].astype(np.uint64), 1)
    size = np.ones(len(begin), np.int64)
    for salt, (kind, cap) in enumerate(rounds, 2):
        if len(begin) < 2:
            break
        joint = begin[:-1] + size[:-1] == begin[1:]
        if kind == "pair":
            half = (mix(name, salt) >> np.uint64(63)).astype(bool)
            i = np.flatnonzero(half[:-1] & ~half[1:] & joint & (size[:-1] + size[1:] <= cap))
            name[i] = mix(name[i] * np.uint64(MIX[1]) + (name[i + 1] >> np.uint64(1)), salt)
            size[i] += size[i + 1]
            keep = np.ones(len(name), bool)
            keep[i + 1] = False
        else:
            new = np.append(True, (name[1:] != name[:-1]) | ~joint)
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(name)))
            joined = (times > 1) & (times * size[at] <= cap)
            i = at[joined]
            name[i] = mix(name[i] + times[joined].astype(np.uint64), salt)
            size[i] *= times[joined]
            keep = new | np.repeat(~joined, times)
        begin, name, size = begin[keep], name[keep], size[keep]
    return begin, begin + size, name


def ahead(x: np.ndarray, d: int) -> np.ndarray:
    """``x`` moved ``d`` places to the front, zeros after it."""
    return np.append(x[d:], np.zeros(min(d, len(x)), x.dtype)) if d else x


def packed(code: np.ndarray, length: int) -> np.ndarray:
    """Of every flat position the ``length`` (at most WORD) bases from there on as one number, two bits each."""
    power, size, out, done = code.astype(np.uint64) & np.uint64(3), 1, None, 0
    while length:
        if length & 1:
            part = ahead(power, done)
            out = part if out is None else (out << np.uint64(2 * size)) | part
            done += size
        length >>= 1
        if length:
            power = (power << np.uint64(2 * size)) | ahead(power, size)
            size *= 2
    return out if out is not None else np.zeros(len(code), np.uint64)


class Text:
    """Sequences of a batch as one array of codes, each followed by a separator."""

    def __init__(self, seqs: list[str]):
        table = np.full(256, 4, np.uint8)
        table[list(b"ACGTacgt")] = [0, 1, 2, 3, 0, 1, 2, 3]
        self.code = table[np.frombuffer("".join(s + " " for s in seqs).encode("latin-1", "replace"), np.uint8)]
        lens = np.fromiter(map(len, seqs), np.int64, len(seqs)) + 1
        self.row = np.repeat(np.arange(len(seqs)), lens)
        self.start = np.cumsum(lens) - lens
        # bases from each position up to the next separator or other letter
        stop = np.where(self.code > 3, np.arange(len(self.code)), len(self.code))
        self.run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(self.code))


def chosen(text: Text, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(begin, first, count, name)`` of the chosen symbols: where a symbol begins, the first of the spans that
    choose it, their number (they begin one after the other), and the name carried over the margins."""
    rounds, margin, _ = schedule(min_len)
    begin, end, name = parse(text.code, rounds)
    span = np.flatnonzero(text.run >= min_len)
    if not len(span):
        return span, span, span, np.zeros(0, np.uint64)
    n = len(text.code) + 1
    lo = np.cumsum(np.bincount(begin + 1, minlength=n))[span + margin]
    hi = np.cumsum(np.bincount(end, minlength=n))[span + min_len - margin] - 1
    level = np.floor(np.log2(hi - lo + 1)).astype(np.int8)
    least, pick = np.arange(len(name)), np.zeros(len(span), np.int64)
    for k in range(int(level.max()) + 1):  # least: of 2^k symbols from each on, the first with the least name
        at = np.flatnonzero(level == k)
        a, b = least[lo[at]], least[hi[at] - (1 << k) + 1]
        pick[at] = np.where(name[b] < name[a], b, a)
        other = np.minimum(np.append(least[1 << k :], np.full(min(1 << k, len(least)), len(name) - 1)), len(name) - 1)
        least = np.where(name[other] < name[least], other, least)
    cut = np.flatnonzero(np.append(True, (np.diff(pick) != 0) | (np.diff(span) != 1)))
    j = pick[cut]
    flank = min(margin, WORD)
    side = packed(text.code, flank)
    wide = mix(mix(name[j] ^ side[begin[j] - flank], 97) ^ side[np.minimum(end[j], len(side) - 1)], 98) if flank else name[j]
    return begin[j], span[cut], np.diff(np.append(cut, len(span))), wide


def words(text: Text, first: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """The stretches of ``length`` bases from ``first`` on, a row each: WORD bases a number, zeros after the end."""
    full = packed(text.code, WORD)
    out = np.zeros((len(first), -(-most // WORD)), np.uint64)
    for w in range(out.shape[1]):
        inside = np.clip(length - w * WORD, 0, WORD).astype(np.uint64)
        some = inside > 0
        mask = ~np.uint64(0) << (np.uint64(64) - np.uint64(2) * inside[some])
        out[some, w] = full[first[some] + w * WORD] & mask
    return out


def fingerprint(at: np.ndarray, count: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """64 bits of a stretch; with the 64 of its name they tell stretches apart."""
    out = mix(at.astype(np.uint64) << np.uint64(32) | count.astype(np.uint64), 99)
    for w in range(stretch.shape[1]):
        out = mix(out ^ stretch[:, w], 100 + w)
    return out


def chunks(batches: Iterator[pa.RecordBatch], seq: int) -> Iterator[pa.Table]:
    """Tables of about CHUNK bases."""
    held, n = [], 0
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(seq)), 0).to_numpy(zero_copy_only=False)
        piece = (n + np.cumsum(size)) // CHUNK
        for cut in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(piece)) + 1):
            if len(cut):
                held.append(b.slice(cut[0], len(cut)))
                n += int(size[cut].sum())
                if n >= CHUNK:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def several(groups: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """True where the rows that agree in all of ``groups`` have two members between them."""
    out = np.zeros(len(lo), bool)
    if len(out):
        order = np.lexsort(groups)
        new = np.append(True, np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0))
        i = np.flatnonzero(new)
        out[order] = np.repeat(np.minimum.reduceat(lo[order], i) < np.maximum.reduceat(hi[order], i), np.diff(np.append(i, len(order))))
    return out


def ranks(*members: pa.ChunkedArray) -> list[np.ndarray]:
    """Members of any type as whole numbers in one order."""
    whole = pa.chunked_array([c for m in members for c in m.chunks], members[0].type).combine_chunks()
    return np.split(pc.rank(whole, tiebreaker="dense").to_numpy().astype(np.int64), len(members))


class Symbols:
    """The chosen symbols of rows (rid, member, seq), and the stretches that their spans cover."""

    def __init__(self, t: pa.Table, min_len: int):
        text = Text(t["seq"].to_pylist())
        begin, first, count, self.name = chosen(text, min_len)
        self.row, self.count, self.at = text.row[first], count, begin - first
        self.first = first - text.start[self.row]
        self.stretch = words(text, first, count - 1 + min_len, 2 * (min_len - schedule(min_len)[1]))
        self.key = fingerprint(self.at, count, self.stretch)


def _send(min_len: int):
    """Each stretch of a chunk once, with the least and greatest member that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, 2):
            s = Symbols(t, min_len)
            if len(s.row):
                body = pa.Array.from_buffers(pa.binary(s.stretch.shape[1] * 8), len(s.row), [None, pa.py_buffer(np.ascontiguousarray(s.stretch).tobytes())])
                cols = {"name": pa.array(s.name.view(np.int64)), "at": pa.array(s.at.astype(np.int32)), "n": pa.array(s.count.astype(np.int32)), "body": body}
                every = pa.table({**cols, "member": t["member"].combine_chunks().take(pa.array(s.row))})
                one = every.group_by(list(cols)).aggregate([("member", "min"), ("member", "max")])
                yield from one.set_column(3, "body", one["body"].cast(pa.binary())).rename_columns([*cols, "lo", "hi"]).to_batches()

    return run


def _own(min_len: int):
    """Spans that two records of a chunk share, merged, with a null name; and the symbols that wait for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, 2):
            s = Symbols(t, min_len)
            if not len(s.row):
                continue
            rid, (member,) = t["rid"].to_numpy(), ranks(t["member"])
            shared = several([s.key, s.name], member[s.row], member[s.row])
            last = s.first + s.count - 1 + min_len
            row, a, b = s.row[shared], s.first[shared], last[shared]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (a[1:] > b[:-1]))) if len(row) else row
            end = np.append(new[1:], len(row))[: len(new)] - 1
            none = pa.nulls(len(new), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rid[row[new]]), pa.array(a[new]), pa.array(b[end]), none, none], names=["rid", "first", "end", "name", "key"])
            cols = [pa.array(rid[s.row[~shared]]), pa.array(s.first[~shared]), pa.nulls(int((~shared).sum()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s.name[~shared].view(np.int64)), pa.array(s.key[~shared].view(np.int64))], names=["rid", "first", "end", "name", "key"])

    return run


def _verify(min_len: int):
    def bases(stretch: np.ndarray, row: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """The ``length`` (at most WORD) bases at a place of a stretch."""
        w, shift = at // WORD, (2 * (at % WORD)).astype(np.uint64)
        here = stretch[row, w] << shift
        after = stretch[row, np.minimum(w + 1, stretch.shape[1] - 1)]
        both = np.where(shift > 0, here | (after >> (np.uint64(64) - np.maximum(shift, np.uint64(1)))), here)
        return both >> np.uint64(64 - 2 * length)

    def run(t: pa.Table) -> pa.Table:
        name, at, n = t["name"].to_numpy(), t["at"].to_numpy(), t["n"].to_numpy()
        stretch = np.frombuffer(b"".join(t["body"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
        lo, hi = ranks(t["lo"], t["hi"])
        some = np.flatnonzero(several([name], lo, hi))
        # every span of the revealed symbols, from its place in the stretch
        row = np.repeat(some, n[some])
        place = np.arange(len(row)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        steps = [(d, WORD) for d in range(0, min_len - WORD + 1, WORD)]
        if min_len % WORD:
            steps.append((max(0, min_len - WORD), min(min_len, WORD)))
        g = np.flatnonzero(several([bases(stretch, row, place + d, length) for d, length in steps], lo[row], hi[row]))
        begins = np.flatnonzero(np.append(True, (np.diff(g) != 1) | (row[g[1:]] != row[g[:-1]]))) if len(g) else g
        last = np.append(begins[1:], len(g))[: len(begins)] - 1
        r = row[g[begins]]
        cols = {"name": name[r], "key": fingerprint(at[r], n[r], stretch[r]).view(np.int64), "first": place[g[begins]], "last": place[g[last]]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in cols.items()})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        spans = b.column(1)
        row = np.repeat(np.arange(b.num_rows), spans.value_lengths().to_numpy())
        s, e = (spans.flatten().field(c).to_numpy() for c in ("first", "end"))
        order = np.lexsort((s, row))
        row, s, e = row[order], s[order], e[order]
        # the greatest end so far within a row
        reach = np.maximum.accumulate(e + row * (e.max() + 1)) - row * (e.max() + 1)
        new = np.append(True, (row[1:] != row[:-1]) | (s[1:] > reach[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[first])), pa.array(s[first]), pa.array(reach[last] - s[first])], names=["rid", "span_start", "span_len"])


def shared_spans(df: DataFrame, group: str, member: str, seq: str, min_len: int = 48) -> DataFrame:
    """``(grp, member, span_start, span_len)``: merged spans of each distinct row that also
    occur in a row of another member, at any place and under any group.

    A span is ``min_len`` or more consecutive A, C, G, T, in either case.  Rows with a null member or
    sequence are left out, repeated rows count once, equal rows of one member don't share with each other,
    rows shorter than ``min_len`` or without a shared span give nothing; sequences of any length are parsed
    whole; an empty table gives no rows; only the three named columns are read.
    """
    scratch = Scratch(df.sparkSession, "spans")
    rows = df.select(F.col(group).alias("grp"), F.col(member).alias("member"), F.upper(seq).alias("seq")).where("member is not null and seq is not null")
    # records of a group lie together, which lets a task combine what they share
    rows = rows.repartitionByRange("grp", "member", F.xxhash64("seq")).sortWithinPartitions("grp", "member").withColumn("rid", F.monotonically_increasing_id())
    rows = scratch.keep(rows)
    kind = rows.schema["member"].dataType.simpleString()
    here = rows.select("rid", "member", "seq")
    own = scratch.keep(here.mapInArrow(_own(min_len), "rid long, first long, end long, name long, key long"))
    sent = here.mapInArrow(_send(min_len), f"name long, at int, n int, body binary, lo {kind}, hi {kind}")
    cells = max(1, rows.agg(F.sum(F.length("seq"))).first()[0] or 0) // (CELL * 16) + 1
    sent = sent.withColumn("cell", F.pmod("name", F.lit(cells)))
    verified = sent.groupBy("cell").applyInArrow(_verify(min_len), "name long, key long, first long, last long")
    # of a stretch that many records have, one side has a row a run of spans: adaptive execution splits the other
    others = own.where("name is not null").alias("o").join(verified.alias("v"), ["name", "key"]).select("rid", (F.col("o.first") + F.col("v.first")).alias("first"), (F.col("o.first") + F.col("v.last") + min_len).alias("end"))
    every = own.where("name is null").select("rid", "first", "end").unionByName(others)
    merged = every.groupBy("rid").agg(F.collect_list(F.struct("first", "end")).alias("spans")).mapInArrow(_merge, "rid long, span_start long, span_len long")  # a row's spans are at most its length
    found = rows.select("rid", "grp", "member", F.xxhash64("seq").alias("content")).join(merged, "rid")
    return found.select("grp", "member", "content", "span_start", "span_len").distinct().drop("content")


def coverage(df: DataFrame, group: str, member: str, seq: str, min_len: int = 48) -> DataFrame:
    """``(grp, member, bases, shared)``: of every distinct row its bases and how many lie in shared spans."""
    one = shared_spans(df, group, member, seq, min_len).groupBy("grp", "member").agg(F.sum("span_len").alias("shared"))
    rows = df.select(F.col(group).alias("grp"), F.col(member).alias("member"), F.upper(seq).alias("seq")).where("member is not null and seq is not null").distinct()
    total = rows.groupBy("grp", "member").agg(F.sum(F.length(F.regexp_replace("seq", "[^ACGT]", ""))).alias("bases"))
    return total.join(one, total["member"].eqNullSafe(one["member"]) & total["grp"].eqNullSafe(one["grp"]), "left").select(total["grp"], total["member"], "bases", F.coalesce("shared", F.lit(0)).alias("shared"))
