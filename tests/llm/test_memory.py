import re
from pathlib import Path

import pytest

from axonwave.llm import common, op02_piece_encoding, op10_line_dedup

STATUS = Path("/proc/self/smaps_rollup")


def held() -> int:
    """Anonymous MB of this process."""
    return int(re.search(r"Anonymous:\s+(\d+)", STATUS.read_text())[1]) // 1024


def test_codec_forgets_words_and_pairs():
    codec = op02_piece_encoding.PieceCodec(op02_piece_encoding.PieceModel.load(op02_piece_encoding.model_path()))
    text = "Whole sentences of several words, forgotten afterwards."
    before = codec.encode(text)
    assert codec.words and codec.pairs
    codec.forget()
    assert not codec.words and not codec.older and not codec.pairs
    assert codec.encode(text) == before and codec.decode(before) == text


def test_encoding_leaves_nothing_in_its_workers(spark):
    docs = spark.createDataFrame([(i, f"text number {i} with words of its own") for i in range(40)], "doc_id long, text string")
    model = op02_piece_encoding.PieceModel.load(op02_piece_encoding.model_path())
    assert op02_piece_encoding.encoded(docs, model).count() == 40

    def left(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(c.words) + len(c.older) + len(c.pairs) for c in op02_piece_encoding._codecs.values())])], ["n"])

    assert {r.n for r in docs.select("doc_id").mapInArrow(left, "n long").collect()} == {0}


@pytest.mark.skipif(not STATUS.exists(), reason="memory can't be read here")
def test_what_a_task_freed_goes_back():
    last = []

    def rows(batches):
        for _ in batches:
            blocks = [b"%d" % k * 20_000 for k in range(2_000)]  # each of less than what malloc maps by itself
            last.append(b"top" * 20_000)  # above the blocks, so that they are no end of the heap that free() returns
            yield len(blocks)

    before = held()
    assert list(common.tidy(rows)([None])) == [2_000]
    assert held() - before < 40


def test_tidy_passes_on_what_fails():
    def rows(batches):
        yield 1
        raise ValueError("row")

    with pytest.raises(ValueError, match="row"):
        list(common.tidy(rows)([]))


def test_batches_of_texts_are_small(spark):
    docs = spark.range(0, 3_000, 1, 1).selectExpr("id", "repeat('some text ', 400) AS text")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    seen = [r.n for r in common.written(docs.mapInArrow(sizes, "n long"), "sizes", op10_line_dedup.HELD).collect()]
    assert sum(seen) > 12_000_000 and max(seen) < 5 << 20
