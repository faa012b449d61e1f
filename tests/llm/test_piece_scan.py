import zlib
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from mergestone.llm import piece_scan as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
P = S.Pieces(PATH)
TEXTS = [
    "Hello  wörld\n\tx 你  ", "", " ", "\n", "a", "  a   b    c     d", "▁a ▁", "aaaaaaaaaaaaaaaaaaa", "ththth the theththere there's", "☃☃ \U0001f600 é", "x\r\ny z", "1234567 89,10.11",
    "Oned anti the inwh, erthe; thon-ou (edble) ciónmente ñaque ßöä", "\n\n\n  \n a", "=" * 50, "----____----", "the▁▁▁end", "  " * 40,
]


def chunked(text, size):
    whole = S.normal(text)
    n = -(-len(whole) // size)
    matrices, parts = [], []
    for k in range(n):
        at = max(0, k * size - 64)
        part = whole[at : at + size + 128]
        lo, hi, final = k * size - at, (len(whole) if k == n - 1 else (k + 1) * size) - at, k == n - 1
        parts.append((part, at, lo, hi, final))
        matrices.append([tuple(v + at for v in e) for e in P.matrix(part, lo, hi, k == 0, final)])
    ids = []
    m = [set(x) for x in matrices]
    left, right = reduce(S.product, m), reduce(lambda a, b: S.product(b, a), m[::-1])
    assert left == right and len(left) == 1  # products may be taken in any order
    for (part, at, lo, hi, final), e in zip(parts, S.handed_down(m, next(iter(left)))):
        a, b = e[:2], e[2:]
        ids += P.traced(part, lo, hi, (a[0] - at, a[1] - at), (b[0] - at, b[1] - at), final).tolist()
    return ids


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(text):
    want = LIB.encode(text)
    assert P.words(S.normal(text)).tolist() == want
    raw, start = S.normal_bytes(pa.array([None, text, "", text, "x"]))
    ids, end = P.encoded(raw, start)
    assert [x.tolist() for x in np.split(ids, end[:-1])] == [[], want, [], want, LIB.encode("x")]
    assert P.decode(np.array(want, int)) == LIB.decode(want)
    for size in (1, 7, 20, 400):
        if text:
            assert chunked(text, size) == want, size


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ththe aeéinorsd\n  ,.xZ1你▁"), max_size=120), st.sampled_from([3, 16, 33, 150]))
def test_any_text(text, size):
    want = LIB.encode(text)
    assert P.words(S.normal(text)).tolist() == want
    if text:
        assert chunked(text, size) == want
    assert P.decode(np.array(want, int)) == text.replace(S.SPACE, " ")


def test_long_texts_in_chunks():
    rng = np.random.default_rng(0)
    syllables = ["th", "er", "on", "ing", "é", "ción", " ", " ", "\n", ", ", "0", "ß"]
    for text in ["".join(rng.choice(syllables, 9000)), "".join(rng.choice(syllables[:4], 6000)), "a" * 5000, "ab" * 3000 + " " * 3000]:
        assert chunked(text, 2048) == LIB.encode(text)


def test_encode(spark):
    rng = np.random.default_rng(1)
    long = ["".join(rng.choice(["the ", "on", "ing ", "ü", "\n"], 4000)), "x" * 3000, "w " * 2500]
    rows = [(i % 7 or None, t, [1], 2) for i, t in enumerate([*TEXTS, None, *long, *long])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n int").repartition(3)
    got = S.encode_texts(df, PATH, chunk=1000)
    want = sorted((str(d), LIB.encode(t or "")) for d, t, _, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got.collect()) == want
    back = sorted((str(r.doc_id), r.text) for r in S.decode_ids(got, PATH).collect())
    assert back == sorted((str(d), (t or "").replace(S.SPACE, " ")) for d, t, _, _ in rows)
    digests = S.encode_texts(df, PATH, digest=True, chunk=1000).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in digests) == sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    assert all(r.same for r in digests) and max(r.n_chunks for r in digests) > 5


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_products_in_a_tree(spark, fan):
    text = S.normal("ththe on aeé " * 700 + "x" * 900 + "\n ing")
    n, size = -(-len(text) // 50), 50
    rows = [(r, k, [v for e in P.matrix(text, k * size, min(len(text), (k + 1) * size), k == 0, k == n - 1) for v in e]) for r in (1, 2) for k in range(n)]
    got = {(r.row, r.k): list(r.path) for r in S.boundaries(spark.createDataFrame(rows, "row long, k int, m array<long>").repartition(5), fan).collect()}
    want = S.handed_down([S.entries(m) for r, _, m in rows if r == 1], (0, 0, len(text), len(text)))
    assert got == {(r, k): list(e) for r in (1, 2) for k, e in enumerate(want)}


@given(st.lists(st.binary(max_size=40), max_size=6))
def test_checksums_of_joined_parts(parts):
    assert S.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_empty_table(spark):
    assert S.encode_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
