"""Token counts, SentencePiece and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidmill.llm import packing, spm_codec, token_count
from evidmill.llm.bpe import encoding, packed
from evidmill.llm.common import tokenizer_path

PATH, MODEL = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n\n", "a", "<|endoftext|>x <|endoftext|>", "it's  'tis\t x", "é中▁ \x0b\x1c !😀", "▁▁a▁", "a <s> </s> <unk> b", "x" * 5000, "wörd " * 3000, "中" * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def fuzz(n=600):
    rng, letters = random.Random(5), " \n\t'sabAB1,.é中▁\xa0 \x0b\x1c!😀-"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_bpe_ids_are_the_librarys(library):
    for t in ODD + fuzz():
        assert np.frombuffer(packed(encoding(PATH), t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 4), (64, 16), (1000, 8)])
def test_spliced_counts_are_whole_counts(library, chunk, overlap):
    for t in ODD + fuzz(300):
        assert token_count.count_long(encoding(PATH), t, chunk, overlap) == len(library.encode(t, add_special_tokens=False).ids)


def test_overlap_widens_where_nothing_aligns(library):
    text, log = "a" * 300 + " b c " + "z" * 500 + " d", []
    assert token_count.count_long(encoding(PATH), text, 64, 4, log) == len(library.encode(text, add_special_tokens=False).ids)
    assert max(log) > 4


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=120))
def test_any_text(text):
    from tokenizers import Tokenizer

    lib = test_any_text.__dict__.setdefault("lib", Tokenizer.from_file(PATH))
    text = text.encode("utf-8", "ignore").decode()
    ids = lib.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed(encoding(PATH), text), "<u4").tolist() == ids
    assert token_count.count_long(encoding(PATH), text, 24, 4) == len(ids)


def test_chunk_table_equals_sentencepiece(pieces):
    texts = ODD + fuzz()
    codec = spm_codec.ChunkCodec(MODEL, limit=50)
    for t, (n, ids, back) in zip(texts, codec.texts(texts)):
        want = pieces.encode(t)
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert back == pieces.decode(want + [2])


ROWS = [(1, "Some words here."), (2, None), (3, ""), (None, "no key"), (1, "Some words here."), (4, "long wörd " * 2000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(a, b, 7, "x", "y") for a, b in rows], "doc_id long, text string, n_tokens int, ids string, sequence_id string")


def test_counts_and_ids_frames(spark, library, pieces):
    got = token_count.token_counts(frame(spark)).collect()
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((len((t or "").encode()), k := len(library.encode(t or "", add_special_tokens=False).ids), k > 512) for _, t in ROWS)
    got = spm_codec.spm_encode(frame(spark)).collect()
    assert sorted(map(str, (r["ids"] for r in got))) == sorted(str([*pieces.encode(t or ""), 2]) for _, t in ROWS)
    got = spm_codec.spm_encode(frame(spark), as_digests=True).collect()
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256(pieces.decode(pieces.encode(t or "")).encode()).hexdigest() for _, t in ROWS)
    empty = frame(spark, [])
    assert token_count.token_counts(empty).count() == spm_codec.spm_encode(empty).count() == packing.pack(empty).count() == 0


def test_packing_is_a_gapless_partition(spark, library):
    rows = ROWS + [(k, "tok " * (k * 37 % 900)) for k in range(10, 90)]
    out = packing.pack(frame(spark, rows), size=256, group_sequences=64).collect()
    want = {}
    for key, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        raw = np.array(ids, "<u4").tobytes()
        for k, (s, n) in enumerate(packing.cut(len(ids), 256)):
            want.setdefault((key, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])), []).append(1)
    got, sequences = {}, {}
    for r in out:
        got.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(1)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 256
    lower = -(-sum(r["length"] for r in out) // 256)
    assert len(sequences) <= 1.05 * lower + 1


def test_only_the_first_piece_is_short():
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(1, 2048) == [(0, 1)]


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 60, 80)
    where, offset = packing.sum_of_squares(lengths, 64)
    gaps: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable"):
        n, fits = int(lengths[i]), [b for b, g in gaps.items() if g >= lengths[i]]
        if not fits:
            assert where[i] not in gaps
            gaps[int(where[i])] = 64 - n
            continue

        def total(b, n=n):
            left = [g - n if x == b else g for x, g in gaps.items()]
            return sum(left.count(g) ** 2 for g in set(left) if g)

        assert total(int(where[i])) == min(map(total, fits))
        assert offset[i] == 64 - gaps[int(where[i])]
        gaps[int(where[i])] -= n


LONG = [" " * 2_000_000, "\n" * 1_000_000 + "a b", "\xa0" * 1_200_000, "a" * 1_000_000, "word " * 200_000 + " \n" * 500_000 + "end"]


def test_very_long_texts(spark, library):
    """Runs of one character, through the default chunks of counting and through packing."""
    df = frame(spark, list(enumerate(LONG))).repartition(len(LONG))
    want = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(LONG)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(df).collect()} == want
    pieces = packing.pack(df).groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"]: r["sum(length)"] for r in pieces} == {k: n + 1 for k, n in want.items()}


def test_many_empty_texts_are_dealt_by_rows(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "cast(null as string) as text")
    out = packing.pack(rows, group_sequences=16)
    assert out.count() == 20_000 and out.select((out.sequence_id / (1 << 32)).cast("long")).distinct().count() > 10
