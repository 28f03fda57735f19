"""The text view of the quality classifier: what a task holds at once, and that words are counted whole."""

import tracemalloc

import numpy as np
import pyarrow as pa

from marketlens.llm import quality

ROWS = 4096


class _Rows:
    """Stands for the DataFrame: gives back the function that runs over the batches."""

    columns, dtypes = ["doc_id", "text", "words"], [("doc_id", "bigint"), ("text", "array<int>"), ("words", "binary")]

    def mapInArrow(self, run, schema):
        return run


def _batch(bits: np.ndarray) -> pa.RecordBatch:
    shapes = np.tile(np.arange(len(quality.TEXT_FEATURES)) * quality.BINS, (len(bits), 1)).astype(np.int32)
    lists = pa.array(shapes.tolist(), pa.list_(pa.int32()))
    words = [row.tobytes() for row in np.packbits(bits, axis=1)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(bits))), lists, pa.array(words, pa.binary()), pa.array(np.arange(len(bits), dtype=np.int32) % 2)], names=["doc_id", "text", "words", "y"])


def test_scores_and_counts_hold_some_rows_at_once():
    rng = np.random.default_rng(7)
    bits = rng.random((ROWS, quality.WORD_SLOTS)) < 0.05
    batch, weights = _batch(bits), rng.normal(size=quality.WIDTH["text"] + 1)
    run = quality.with_text_odds(_Rows(), weights.tolist())
    tracemalloc.start()
    odds = next(run(iter([batch.select(["doc_id", "text", "words"])]))).column("text_odds").to_numpy()
    counts = next(quality._text_counts(iter([batch.select(["text", "words", "y"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all bits of the batch are 16 MB, as doubles 128 MB
    shapes = np.arange(len(quality.TEXT_FEATURES)) * quality.BINS
    content = weights[quality.SHAPES : -1]
    wanted = weights[-1] + weights[shapes].sum() + bits.astype(float) @ content / np.sqrt(1 + bits.sum(axis=1))
    assert np.allclose(odds, wanted)
    found = {(f, y): n for f, y, n in zip(*(c.to_pylist() for c in counts.columns), strict=True)}
    assert [found[quality.SHAPES + s, 1] for s in range(0, quality.WORD_SLOTS, 500)] == bits[1::2, ::500].sum(axis=0).tolist()
    assert found[quality.WIDTH["text"], 0] == ROWS // 2


def test_more_words_than_a_byte_counts():
    bits = np.zeros((2, quality.WORD_SLOTS), bool)
    bits[0, :256], bits[1, :300] = True, True
    weights = np.full(quality.WIDTH["text"] + 1, 0.5)
    run = quality.with_text_odds(_Rows(), weights.tolist())
    odds = next(run(iter([_batch(bits).select(["doc_id", "text", "words"])]))).column("text_odds").to_numpy()
    plain = 0.5 * (1 + len(quality.TEXT_FEATURES))
    assert np.allclose(odds, [plain + 128 / np.sqrt(257), plain + 150 / np.sqrt(301)])
