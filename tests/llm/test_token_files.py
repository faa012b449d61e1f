import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mergestone.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, ENCODER = Tokenizer.from_file(PATH), T.WordEncoder(PATH)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype(np.uint32)
    data = T.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (T.unpack(data, 1001, bits) == ids).all()


@pytest.mark.parametrize("bits", [13, 16, 17])
def test_random_access(bits):
    rng = np.random.default_rng(0)
    docs = [(i if i else None, rng.integers(0, 2**bits, n).astype(np.uint32)) for i, n in enumerate([1, 0, 40000, 7, 8192, 1, 131072, 3])]
    sink = io.BytesIO()
    w = T.ShardWriter(sink, bits)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    f = pa.BufferReader(sink.getvalue())
    for lo, hi in [(0, 8), (2, 3), (3, 6), (7, 99), (1, 2)]:
        ids, starts, got = T.read_range(f, lo, hi)
        assert ids == [d for d, _ in docs[lo:hi]] and all((a == b[1]).all() and len(a) == len(b[1]) for a, b in zip(got, docs[lo:hi]))
        assert starts[0] == sum(len(x) for _, x in docs[:lo])


TEXTS = ["Hello World! it's 42 ok...", "", None, "naïve CAFÉ ÉTÉ,,, ß\x1cx\x85y z", "a<|endoftext|>b <|ENDOFTEXT|>", "İstanbul K é.", "the " * 70000, "don't. can't!?", "1a2b $$$ x*** ﬁ", "你好 мир ☃."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbBLHelo wWÉéßſK.,'*<|>endoftxsr\n\t\x1c\u0301 12你ﬁİ") | st.characters(codec="utf8"), max_size=60), min_size=1, max_size=4))
def test_any_texts(texts):
    texts = [*texts, texts[0] + "<|endoftext|>" + texts[-1], "Hello World <|x", "HELLO <| there", "Hello <|endoftext|>WORLD Foo"]
    for t, ids in zip(texts, ENCODER.encode(texts)):
        assert ids.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_forgotten_words_are_learnt_again(monkeypatch):
    encoder = T.WordEncoder(PATH)
    monkeypatch.setattr(T.WordEncoder, "KEEP", 3)
    for t in ("some more words, than. it keeps", "it keeps some", "$" * 300 + " a" + "!" * 300):
        assert encoder.encode([t])[0].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_words_encode_as_the_whole_text():
    lib = Tokenizer.from_file(PATH)
    got = T.WordEncoder(PATH).encode(TEXTS)
    for t, ids in zip(TEXTS, got):
        assert ids.tolist() == lib.encode(t or "", add_special_tokens=False).ids, t[:40]


@pytest.mark.parametrize("shard_ids", [T.SHARD, 10])
def test_write_and_read(spark, shard_ids):
    rows = [(i * 7 % 31, t, "x", 5) for i, t in enumerate(TEXTS * 3)] + [(None, "no id", None, None), (3, "again", "x", 1), (3, "again", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)
    shards = T.write_token_files(df, PATH, shard_ids=shard_ids).persist()
    assert shards.count() > (4 if shard_ids < 1000 else 0)
    got = T.read_token_files(shards, digest=True, run_of=4).collect()
    ids = {(r.doc_id, r.start): r.ids for r in T.read_token_files(shards, run_of=7).collect()}
    assert all(zlib.crc32(np.array(ids[r.doc_id, r.start], "<u4").tobytes()) == r.ids_crc32 for r in got)
    lib, at, want = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_token_files(T.write_token_files(df, PATH)).count() == 0
