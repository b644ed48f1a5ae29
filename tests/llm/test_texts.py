import random
import unicodedata

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandweave.llm.bpe import Encoder, Merges, default_path, token_ids, token_sizes
from strandweave.llm import queries
from strandweave.llm.look import fold_column, look_alike_classes, look_alike_pairs, one_form, tables
from strandweave.llm.packing import pack, windows

TEXTS = ["", None, " ", "Hello world's  end", "<|endoftext|> x", "aaaaaaaaaaaaaaaaaa" * 300, "日本語 テキスト 한국어 😀👩‍👩‍👧", "\u0000\x1f\r\n\t\n\n  x", "a" * 20_000 + " b" * 5000, "ﬁ é é", "퟿\U0010ffff"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids if s else []


def test_ids_equal_the_library(spark, reference):
    rows = [(i, t, "x", [1]) for i, t in enumerate(TEXTS * 2)] + [(0, "again", "x", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_ string, ids array<int>")
    got = [(r.doc_id, list(r.ids)) for r in token_ids(df, "doc_id", "text").collect()]
    assert sorted(got) == sorted((i, reference(t)) for i, t, *_ in rows)
    assert {(r.doc_id, r.tokens) for r in token_sizes(df, "doc_id", "text").collect()} == {(i, len(reference(t))) for i, t, *_ in rows}
    assert token_ids(spark.createDataFrame([], df.schema), "doc_id", "text").count() == 0


def test_documents_equal_the_library(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: reference(r.text) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: list(r.ids) for r in token_ids(docs, "doc_id", "text").collect()} == want


def test_words_are_forgotten(monkeypatch, reference):
    from strandweave.llm import bpe

    monkeypatch.setattr(bpe, "WORDS", 3)
    enc = Encoder(Merges(default_path()))
    for t in ["one two three four", "five six", "one seven"]:
        assert enc.encode([t]).to_pylist() == [reference(t)]


def test_long_words_equal_the_library(reference):
    rng = random.Random(8)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ACGT", "aab", "日本語文字列"]
    words = ["".join(rng.choice(k) for _ in range(n)) for k in kinds for n in (1023, 1025, 4000, 30_000)]
    texts = [f"so {w} it is" for w in words] + [" ".join(words[:8])]
    assert Encoder(Merges(default_path())).encode(texts).to_pylist() == [reference(t) for t in texts]


def packed_ok(rows, sizes, capacity):
    by, fill = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        if r.window is not None:
            fill.setdefault(r.window, []).append((r.start, r.start + r.tokens))
    for spans in fill.values():  # no overlap, no gap, no overflow
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for doc, size in sizes.items():
        pieces = sorted((r.piece, r.first, r.tokens) for r in by[doc])
        assert sum(p[2] for p in pieces) == (size or 0) and pieces[0][:2] == (0, 0)
        assert len(pieces) == max(1, -(-(size or 0) // capacity))
    return fill


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_places_every_token_once(spark, parts):
    import random

    rng = random.Random(parts)
    sizes = {i: rng.choice([0, None, 1, 5, 100, 99, rng.randrange(1, 400), 100, 250]) for i in range(900)}
    df = spark.createDataFrame([(i, n, 1, 2) for i, n in sizes.items()], "doc_id long, n long, window long, start long").repartition(parts)
    p = pack(df, "doc_id", "n", 100)
    fill = packed_ok(p.collect(), sizes, 100)
    total = sum(n or 0 for n in sizes.values())
    assert len(fill) <= 1.02 * total / 100 + 3
    assert {(r.window, r.tokens) for r in windows(p).collect()} == {(w, s[-1][1]) for w, s in fill.items()}


def test_packing_edges(spark):
    assert pack(spark.createDataFrame([], "doc_id string, n int"), "doc_id", "n", 10).collect() == []
    rows = pack(spark.createDataFrame([("a", 10), ("a", 10), ("b", 11), ("c", -5), (None, 3)], "doc_id string, n int"), "doc_id", "n", 10).collect()
    assert sorted((str(r.doc_id), r.piece, r.tokens, r.window is None) for r in rows) == [("None", 0, 3, False), ("a", 0, 10, False), ("a", 0, 10, False), ("b", 0, 10, False), ("b", 1, 1, False), ("c", 0, 0, True)]


SAME = [
    ("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"), ("näive café", "näive café"), ("zero​wid­th﻿", "zerowidth"), ("no break thin", "no break thin"),
    ("pаypаl Ѕсоре", "paypal Scope"), ("oﬃce ﬂow", "office flow"), ("ﾊﾞﾅﾅ", "バナナ"), ("각", "각"), ("a\r\nb", "a\nb"), ("Å", "Å"), ("ạ̇", "ạ̇"),
]
SAME += [("ᎪᏴᏟ", "ABC"), ("ꓐꓳ", "BO"), ("ⲞⲢ", "OP")]
OTHER = [("Case", "case"), ("1", "l"), ("0", "O"), ("é", "e"), ("a  b", "a b"), ("a\nb", "a b"), ("x²", "x2"), ("a\n\nb", "a\nb"), ("バ", "ハ")]


def test_forms():
    t = tables()
    assert t is tables()
    fold = lambda s: fold_column(pa.array([s]), t)[0].as_py()
    for a, b in SAME:
        assert fold(a) == fold(b) and fold(fold(a)) == fold(a), (a, b)
    for a, b in OTHER:
        assert fold(a) != fold(b), (a, b)
    plain = ["Grüße, мир; 日本語 한국어 العربية हिन्दी Tiếng Việt", "x̣́̕", "", "\U0001f600 ok"]
    for s in plain:
        assert fold(s) == unicodedata.normalize("NFC", fold(s))
    assert fold_column(pa.array([], pa.string()), t).to_pylist() == []
    assert fold_column(pa.array(["a", None, "", "Ｂ"]).slice(1), t).to_pylist() == [None, "", "B"]


def test_pairs(spark):
    texts = ["Full text", "Ｆull text", "Full text", "full text", None, "", "​", " ", "　", "Fu​ll text", "y" * 30_000, "у" + "y" * 29_999]
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, s string, form string")
    got = {tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()}
    assert got == {(0, 1), (1, 2), (0, 9), (1, 9), (2, 9), (10, 11)}
    assert look_alike_pairs(spark.createDataFrame([], df.schema), "doc_id", "text").count() == 0
    classes = {r.doc_id: (r.look, r.same, r.links) for r in look_alike_classes(df, "doc_id", "text").collect()}
    assert classes == {0: (0, 0, 2), 1: (0, 1, 3), 2: (0, 0, 2), 3: (3, 3, 0), 9: (0, 9, 3), 10: (10, 10, 1), 11: (10, 11, 1)}
    assert look_alike_classes(spark.createDataFrame([], df.schema), "doc_id", "text").count() == 0
    shown = {r.doc_id: r.s for r in one_form(df, "text", "s").collect()}
    assert shown[1] == "Full text" and shown[4] is None and shown[6] == ""


def test_packing_of_the_documents(spark, sf, reference):
    """Every token of every document in one window, and hardly more windows than the tokens need."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sizes = {r.doc_id: len(reference(r.text)) for r in docs}
    fill = packed_ok(queries.p8_pieces(spark, sf).collect(), sizes, queries.WINDOW)
    assert len(fill) <= 1.02 * sum(sizes.values()) / queries.WINDOW + 2
    assert {r.doc_id for r in queries.p8_found(spark, sf).collect()} == {d for d, n in sizes.items() if n > queries.WINDOW}
    assert {(r.window, r.pieces, r.tokens) for r in queries.p8_windows(spark, sf).collect()} == {(w, len(v), v[-1][1]) for w, v in fill.items()}


def test_look_alikes_of_the_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    t = tables()
    shown = {d: fold_column(pa.array([x], pa.string()), t)[0].as_py() for d, x in docs.items()}
    assert {r.doc_id: r.shown for r in queries.p9_text(spark, sf).collect()} == shown
    forms = {}
    for d, x in shown.items():
        if x and x.strip():
            forms.setdefault(x, []).append(d)
    pairs = {(min(a, b), max(a, b)) for ids in forms.values() for a in ids for b in ids if docs[a] != docs[b]}
    got = [tuple(r) for r in queries.p9_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    want = {d: (min(ids), min(x for x in ids if docs[x] == docs[d]), sum(docs[x] != docs[d] for x in ids)) for ids in forms.values() for d in ids}
    assert {r.doc_id: (r.look, r.same, r.links) for r in queries.p9_classes(spark, sf).collect()} == want
