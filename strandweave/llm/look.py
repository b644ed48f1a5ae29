"""One form for texts that look the same, on numpy arrays of code points.

A whole Arrow column is copied to one array of code points.  A table lookup gives each code point its
replacement (nothing, one or several code points), expansion offsets place them, marks are put in canonical
order and then composed with their bases over the whole array at once.  No step looks at single rows.

What is folded: the width of letters, kinds of space, joined letter forms, marks written apart, letters of
another script with the same shape, and characters without any look.  Case, digits, accents, superscripts,
punctuation, the number of spaces and line breaks stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.scratch import Scratch

SIZE = 0x110000
#: Letters of Cyrillic, Greek, Armenian, Cherokee, Lisu and Coptic drawn like a Latin one, and that one.
ALIKE = {
    "а": "a", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "с": "c", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "С": "C", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "µ": "μ",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Օ": "O", "Ս": "U", "Տ": "S", "ⅼ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ɡ": "g", "ɑ": "a",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮍ": "Y", "Ꮓ": "Z",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
}
#: Format characters that are seen, and characters of other categories that are not.
SEEN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Kinds of compatibility mapping that keep the look: width, space and joined forms.
FOLDED = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Blocks whose <compat> mappings are joined letters: digraphs, Armenian ligatures, presentation forms.
JOINED = (range(0x132, 0x134), range(0x149, 0x14A), range(0x1C4, 0x1CD), range(0x1F1, 0x1F4), range(0x587, 0x588), range(0xFB00, 0xFB50))


def _shown(c: int) -> str:
    """What a code point is replaced by, fully decomposed."""
    ch = chr(c)
    cat = unicodedata.category(ch)
    if cat == "Cc":
        return ch if ch in "\t\n\r" else ""
    if cat == "Cf" and c not in SEEN or c in UNSEEN:
        return ""
    if cat == "Zs":
        return " "
    if cat in ("Zl", "Zp"):
        return "\n"
    kind = unicodedata.decomposition(ch).split(" ")
    if kind[0] in FOLDED or kind[0] == "<compat>" and any(c in r for r in JOINED):
        return "".join(_shown(int(x, 16)) for x in kind[1:])
    return "".join(ALIKE.get(x, x) for x in unicodedata.normalize("NFD", ch))


class Tables:
    """Lookup tables built from the Unicode data by rule; their size doesn't depend on the texts."""

    def __init__(self):
        start, size, pool, ccc = np.zeros(SIZE, np.int32), np.ones(SIZE, np.int8), [], np.zeros(SIZE, np.uint8)
        one = np.arange(SIZE, dtype=np.int32)  # the replacement where it is a single code point
        pairs: dict[tuple[int, int], int] = {}
        for c in range(SIZE):
            if 0xD800 <= c < 0xE000 or 0xE000 <= c < 0xF900 or 0xAC00 <= c < 0xD7A4 or 0x4E00 <= c < 0x9FFF or c >= 0xF0000:
                if not 0xAC00 <= c < 0xD7A4:
                    continue
            ch = chr(c)
            if unicodedata.category(ch) == "Cn" and c not in UNSEEN:
                continue
            ccc[c] = unicodedata.combining(ch)
            s = _shown(c)
            if s != ch:
                size[c], start[c] = len(s), len(pool)
                pool.extend(map(ord, s))
                if len(s) == 1:
                    one[c] = ord(s)
            nfd = unicodedata.normalize("NFD", ch)
            if nfd != ch and len(nfd) > 1 and unicodedata.normalize("NFC", ch) == ch:
                d = unicodedata.decomposition(ch).split(" ")
                if 0xAC00 <= c < 0xD7A4:
                    t = (c - 0xAC00) % 28
                    a, b = (c - t, 0x11A7 + t) if t else (ord(nfd[0]), ord(nfd[1]))
                else:
                    a, b = int(d[0], 16), int(d[1], 16)
                a = ord(ALIKE.get(chr(a), chr(a))) if ord(nfd[0]) == a else a
                pairs.setdefault((a, b), c)
        # a base that was folded to Latin composes to the Latin letter where there is one
        for (a, b), c in list(pairs.items()):
            s = unicodedata.normalize("NFC", chr(a) + chr(b))
            if len(s) == 1:
                pairs[(a, b)] = ord(s)
        keys = np.array([(a << 21) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.start, self.size, self.one, self.ccc = start, size, one, ccc
        self.pool = np.array(pool, np.int32)
        self.keys, self.made = keys[order], np.array(list(pairs.values()), np.int32)[order]
        #: The second members of pairs; only they can be composed with what stands before them.
        self.tail = np.zeros(SIZE, bool)
        self.tail[self.keys & 0x1FFFFF] = True


@cache
def tables() -> Tables:
    """The tables of this process, built once."""
    return Tables()


def fold(cp: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The one form of code points ``cp`` that belong to the rows ``row`` (ascending)."""
    cr = cp == 13
    if cr.any():  # a carriage return is part of the line break after it, or else a line break itself
        nxt = np.append((cp[1:] == 10) & (row[1:] == row[:-1]), False)
        cp = np.where(cr & ~nxt, 10, cp)
        cp, row = cp[~(cr & nxt)], row[~(cr & nxt)]
    n = t.size[cp]
    if (n == 1).all():
        cp = t.one[cp]
    else:
        out = np.repeat(np.arange(len(cp)), n)
        first = np.cumsum(n) - n
        src = cp[out]
        many = n[out] > 1
        new = t.one[src]
        new[many] = t.pool[t.start[src[many]] + np.flatnonzero(many) - first[out[many]]]
        cp, row = new, row[out]
    if not len(cp):
        return cp, row
    ccc = t.ccc[cp]
    marks = ccc > 0
    wrong = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1])) + 1
    if len(wrong):  # marks of one base in canonical order: a stable sort within runs of marks
        run = np.cumsum(~marks | np.append(True, row[1:] != row[:-1]))
        sel = np.flatnonzero(marks & np.isin(run, run[wrong]))
        order = np.lexsort((np.arange(len(sel)), ccc[sel], run[sel]))
        cp[sel] = cp[sel][order]
        ccc = t.ccc[cp]
    while t.tail[cp].any():  # a second pass where a composed character takes one more (Hangul: the final)
        n = len(cp)
        cp, row = _compose(cp, row, t)
        if len(cp) == n:
            break
    return cp, row


def _compose(cp: np.ndarray, row: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Every round composes the first open mark of each base with it; marks that can't be stay and close."""
    n = len(cp)
    ccc = t.ccc[cp].astype(np.int16)
    starter = (ccc == 0) | np.append(True, row[1:] != row[:-1])
    alive = np.ones(n, bool)
    open_ = np.flatnonzero(t.tail[cp])
    base = np.maximum.accumulate(np.where(starter, np.arange(n), 0))
    # a trailing part that is itself a starter (Hangul, some Indic vowels) composes with the starter before
    prev = np.maximum.accumulate(np.where(starter, np.arange(n), -1))
    before = np.append(-1, prev[:-1])
    target = np.where(starter[open_], before[open_], base[open_])
    keep = (target >= 0) & (row[np.maximum(target, 0)] == row[open_]) & (target != open_)
    open_, target = open_[keep], target[keep]
    # a mark is blocked by an uncomposed one of the same class, or a starter, between it and its base
    group = np.cumsum(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, int)
    rank = np.arange(len(target)) - np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(len(target)), 0)) if len(target) else group
    busy = np.zeros(n, bool)
    for r in range(int(rank.max(initial=-1)) + 1):
        sel = rank == r
        i, b = open_[sel], target[sel]
        gap = i - b - 1
        between = np.zeros(len(i), bool)
        for d in range(1, int(gap.max(initial=0)) + 1):  # uncomposed marks between block those not above their class
            j = i - d
            inside = (d <= gap) & alive[j]
            between |= inside & ((ccc[j] >= ccc[i]) | (ccc[i] == 0))
        key = (cp[b].astype(np.int64) << 21) | cp[i]
        at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        ok = (t.keys[at] == key) & ~between & alive[b] & ~busy[i]
        cp[b[ok]] = t.made[at[ok]]
        alive[i[ok]] = False
        busy[b[ok]] = True  # a character made in this pass is not moved into the one before it
    return cp[alive], row[alive]


def fold_column(col: pa.Array, t: Tables) -> pa.Array:
    """:func:`fold` over an Arrow string column; nulls stay null."""
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return col
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    off = off - off[0]
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    # characters before each row's end: bytes that don't continue a character
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    row = np.repeat(np.arange(n), np.diff(chars))
    cp, row = fold(cp, row, t)
    raw = cp.astype(np.int32).tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.cumsum(np.bincount(row, width, n)).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_string(), n, [col.is_valid().buffers()[1] if col.null_count else None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(raw)]
    ).cast(pa.string())


def one_form(df: DataFrame, text: str, out: str = "shown") -> DataFrame:
    """``df`` with ``out``, the one form of ``text``; a column of that name is replaced.

    A null text stays null, an empty one empty, one of characters without any look becomes empty; texts of
    any length are folded whole.  The tables are broadcast: their size is that of Unicode.
    """
    sent = df.sparkSession.sparkContext.broadcast(tables())
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = fold_column(b.column(b.schema.get_field_index(text)), sent.value)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), folded], names=[*rest, out])

    return df.mapInArrow(run, schema)


def _classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(k, form, stored, links, n)``: rows that show something with fingerprints (128 bits) of their form and stored
    text, the number of rows that look the same but differ, and of those with the same text."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    shown = one_form(rows, "t", "s").where(F.length(F.regexp_replace("s", r"\s", "")) > 0)
    marks = Scratch(df.sparkSession, "look").keep(shown.select("k", F.md5("s").alias("form"), F.md5("t").alias("stored")))
    texts = marks.groupBy("form", "stored").agg(F.count("*").alias("n"), F.min("k").alias("same"))
    forms = texts.groupBy("form").agg(F.sum("n").alias("of_form"), F.min("same").alias("look"))
    # a text or form of very many rows is one row of ``texts`` and ``forms``: adaptive execution splits the other side
    each = texts.join(forms, "form").select("form", "stored", "n", "same", "look", (F.col("of_form") - F.col("n")).alias("links"))
    return marks.join(each, ["form", "stored"])


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, look, same, links)``: of every row its class of texts that look the same, named by the least key in it,
    the least key with the very same text, and the number of rows that look the same though their text differs.

    Null texts and those that show nothing (empty or only spaces and line breaks in their one form) have no row; repeated rows
    are rows of their own; only the two named columns are read; an empty table gives no rows.
    """
    return _classes(df, key, text).select(F.col("k").alias(key), "look", "same", "links")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_a, doc_b)``, doc_a < doc_b: rows whose texts differ but have one form.

    The classes of :func:`look_alike_classes` spelled out: different texts of one form are paired once, whatever
    their number of copies, and each pair is then expanded by the copies of its two texts.
    """
    some = Scratch(df.sparkSession, "alike").keep(_classes(df, key, text).where("links > 0").select("k", "form", "stored"))
    texts = some.select("form", "stored").distinct()
    pairs = texts.join(texts.withColumnRenamed("stored", "other"), "form").where("stored < other")
    a, b = some.select("form", "stored", F.col("k").alias("ka")), some.select("form", F.col("stored").alias("other"), F.col("k").alias("kb"))
    return pairs.join(a, ["form", "stored"]).join(b, ["form", "other"]).select(F.least("ka", "kb").alias("doc_a"), F.greatest("ka", "kb").alias("doc_b")).where("doc_a < doc_b")
