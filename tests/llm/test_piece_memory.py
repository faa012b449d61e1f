import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece

from mergestone.llm import piece_scan as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_what_a_worker_remembers_stays_small():
    """Over many batches of words that were never seen, with the library's ids all along."""
    pieces, library = P.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(5)
    for k in range(12):
        texts = [" ".join(map(str, rng.integers(0, 10**9, 500))) for _ in range(100)]
        ids, end = pieces.encoded(*P.normal_bytes(pa.array(texts)))
        assert ids[: end[0]].tolist() == library.encode(texts[0])
        assert ids[end[-2] : end[-1]].tolist() == library.encode(texts[-1])
        assert len(pieces.segments) <= 460_000
