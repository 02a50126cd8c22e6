import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from streamloom.llm import packing, piece_codec, quality_classifier, token_counts  # noqa: E402
from streamloom.llm._bpe import keyed_skip  # noqa: E402

from .conftest import text  # noqa: E402

TEXTS = ["", "Hello  wörld\n a\tb é ", "日本語 text 𝄞", "   lead", "▁literal", "x" * 300, "<s> <0x0A> </s>", "a b  c   d\r\n", "\x00 z\x1c\xa0y", "don't we'll 're o'clock ''s \"'sand\" 'S", "a1b22c³ ½ ÀÉÎŸ ſ ŉ İ Σίσυφος ΑΣ", "<|endoftext|> a", "the cat's naïve café"]
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


# --- quality ---


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = quality_classifier.fit(docs, labels, ~held)
    rows = quality_classifier.score(docs, model).join(labels, "doc_id").where(held).collect()
    right = [(r.score >= 0.7) == (r.quality == 1) for r in rows]
    assert all(0 <= r.score <= 1 for r in rows) and np.mean(right) >= 0.9


def test_quality_odd_inputs(spark, frame):
    docs = frame([(1, None), (2, ""), (3, "a"), (4, "good " * 50_000), (5, "bad!! " * 20), (6, "good text"), (7, "bad!! bad!!")])
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (6, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert len(got) == 7 and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] and got[4] > got[5]
    for few, share in ((labels.where("quality = 1"), 1.0), (labels.limit(0), 0.5)):
        got = quality_classifier.score(docs, quality_classifier.fit(docs, few, F.lit(True))).collect()
        assert all(abs(r.score - share) < 1e-9 for r in got)


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    r = np.random.default_rng(2)
    rows = [r.choice(40, 8, replace=False) for _ in range(60)]
    y = np.where(np.array([f.mean() for f in rows]) > 20, 1, -1)
    values = [np.ones(8) / np.sqrt(8) for _ in rows]

    def primal(w):
        return 0.5 * (w @ w) + sum(max(0, 1 - t * (w[f] @ v)) for f, v, t in zip(rows, values, y))

    w = quality_classifier.dual_coordinate_descent(rows, values, y, epochs=500)
    best = primal(w)
    for _ in range(200):
        assert primal(w + r.standard_normal(len(w)) * (np.arange(len(w)) < 40) * 0.05) >= best - 1e-2


# --- token counts ---


@pytest.fixture
def rollup(spark, tmp_path):
    return token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")


def totals(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def counted(df, sign=1):
    return token_counts.signed_counts(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "v1", sign)


def test_token_rollup(spark, rollup):
    rows = [("a", "en", text(1, 50)), ("a", "en", "x"), ("a", None, None), (None, "de", ""), ("b", "de", "zwei Wörter"), ("b", "de", "zwei Wörter")]
    df = spark.createDataFrame(rows, "source string, lang string, text string")
    enc = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {}
    for s, l, t in rows:
        n, k = want.get((s, l), (0, 0))
        want[s, l] = (n + 1, k + len(enc.encode_ordinary(t or "")))
    assert totals(rollup) == {}
    assert rollup.commit("b1", counted(df)) and not rollup.commit("b1", counted(df))
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want and not rollup.commit("b1", counted(df)) and rollup._names("deltas") == []
    new = spark.createDataFrame([("b", "fr", "trois mots ici")], "source string, lang string, text string")
    change = token_counts.revision(df.where("source = 'b'").limit(1), new)
    assert rollup.commit("b2", counted(change, F.col("sign")))
    assert totals(rollup)["b", "de"] == (1, len(enc.encode_ordinary("zwei Wörter"))) and totals(rollup)["b", "fr"] == (1, len(enc.encode_ordinary("trois mots ici")))
    assert rollup.commit("b3", counted(df.where("source = 'a'"), -1)) and ("a", "en") not in totals(rollup)
    before = totals(rollup)
    rollup.compact()
    assert totals(rollup) == before and rollup.commit("b4", counted(df.limit(0)))


def test_half_written_batch_is_not_read(spark, rollup):
    counted(spark.createDataFrame([("a", "en", "x")], "source string, lang string, text string")).write.parquet(f"{rollup.root}/staging/half")
    assert totals(rollup) == {}


# --- sentence pieces ---


@pytest.fixture(scope="module")
def model():
    return piece_codec.model(PIECE)


def test_without_dropout_the_library_agrees(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [t for t in TEXTS if "▁" not in t] + [text(i, 80) for i in range(20)]
    ids, cut = model.encode(texts, np.arange(len(texts)))
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == sp.encode(texts)


def test_dropout_is_lossless_seeded_and_varied(model, monkeypatch):
    texts = TEXTS + [text(i, 80) for i in range(20)]
    at = np.arange(len(texts))
    ids, cut = model.encode(texts, at, 1, 0.2)
    assert [t.decode() for t in model.decode(ids, cut)] == texts
    again, cut2 = model.encode(texts[5:], at[5:], 1, 0.2)
    assert (again == ids[cut[5] :]).all()
    other, _ = model.encode(texts, at, 2, 0.2)
    assert len(other) != len(ids) or (other != ids).any()
    assert len(ids) > len(model.encode(texts, at)[0])
    monkeypatch.setattr(piece_codec, "LONGEST", 0)  # the heap, one segment at a time
    slow, _ = model.encode(texts, at, 1, 0.2)
    assert (slow == ids).all()
    every, cut = model.encode(texts, at, 1, 1.0)
    assert [t.decode() for t in model.decode(every, cut)] == texts


def test_codec_frames(spark, frame):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, text(1, 5000))]
    coded = piece_codec.encode(frame(rows), PIECE, 3, 0.1)
    assert {r.doc_id: r.text for r in piece_codec.decode(coded, PIECE).collect()} == dict(rows)
    lists = {r.doc_id: r.ids for r in coded.collect()}
    for r in piece_codec.digests(frame(rows), PIECE, 3, 0.1).collect():
        ids = lists[r.doc_id] or []
        assert r.lossless and r.n_ids == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert piece_codec.encode(frame([]), PIECE).count() == 0


def test_keyed_skip_rate():
    skip = keyed_skip(1, 0.25)
    n = 20_000
    got = skip(np.arange(n, dtype=np.uint64), np.zeros(n, int), np.ones(n, int), np.full(n, 2))
    assert abs(got.mean() - 0.25) < 0.02


# --- packing ---


def test_tokenizer_twin():
    import pyarrow as pa

    from streamloom.llm._columnar import text_slices

    t = packing.tokenizer(WORD)
    r = random.Random(3)
    mixed = ["".join(r.choice("aZé'st12 .,!-_²\n") for _ in range(60)) for _ in range(200)]
    texts = TEXTS + mixed
    for a, b, data, offsets in text_slices(pa.array(texts), 500):
        ids, cut = t.encode(data, offsets)
        for i, x in enumerate(texts[a:b]):
            assert ids[cut[i] : cut[i + 1]].tolist() == t.library.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("length", [2048, 64])
def test_packing_places_every_token_once(frame, space, length):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, text(1, 3000)), (52, text(2, 10)), (53, text(2, 10))]
    got = packing.pack(frame(rows), WORD, space, length, with_ids=True).collect()
    library = packing.tokenizer(WORD).library
    for i, t in rows:
        want, at = library.encode(t or "", add_special_tokens=False).ids + [1], 0
        for p in sorted((p for p in got if p.doc_id == i), key=lambda p: p.start):
            assert (p.start, p.ids, p.doc_tokens, p.ids_crc32) == (at, want[at : at + p.length], len(want), zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes()))
            at += p.length
        assert at == len(want)
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length and at & (at - 1) == 0


def test_packing_nothing(frame, space):
    assert packing.pack(frame([]), WORD, space).count() == 0


def test_hilbert_curve_visits_neighbours():
    import itertools

    for axes, bits in ((2, 3), (3, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        order = packing.hilbert_index(points, bits)
        assert sorted(order.tolist()) == list(range(len(points)))
        walk = points[np.argsort(order)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_model_file_is_of_the_kind_the_twin_knows():
    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    assert [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]


def test_packing_keeps_rows_without_an_id_and_repeated_rows(frame, space):
    rows = [(None, text(1, 300)), (None, None), (5, text(2, 40)), (5, text(2, 40)), (None, text(1, 300))]
    got = packing.pack(frame(rows), WORD, space, 64).collect()
    library = packing.tokenizer(WORD).library
    want = sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows), key=str)
    assert sorted(((p.doc_id, p.doc_tokens) for p in got if p.start == 0), key=str) == want
    assert sum(p.length for p in got) == sum(n for _, n in want)


def test_added_tokens_are_those_of_a_fresh_tokenizer(frame, space):
    library = tokenizers.Tokenizer.from_file(WORD)
    assert library.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [3306, 49407, 1002]
    rows = list(enumerate(["hello <|endoftext|> world", "", "a<|startoftext|>b", "<|endoftext|", "|> <|ENDOFTEXT|>", "plain", "<|endoftext|><|endoftext|>"]))
    whole = {}
    for p in packing.pack(frame(rows), WORD, space, with_ids=True).orderBy("doc_id", "start").collect():
        whole.setdefault(p.doc_id, []).extend(p.ids)
    assert whole == {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in rows}
