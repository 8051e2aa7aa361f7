import pyarrow as pa
import pytest

from filterlab.llm import spm
from filterlab.llm.common import mapped


def test_token_caches_end_with_their_task():
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=path)
    texts = ["Several words of a text", None, "other words\nand lines  apart"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": texts})
    (out,) = spm.coded(iter([batch]), path)
    assert out.column("ids").to_pylist() == [sp.encode(t or "") for t in texts]
    m = spm.model(path)
    assert not (m.words or m.words.bare or m.memo)
    assert m.encode(texts[0]).tolist() == sp.encode(texts[0])


def test_kept_text_goes_to_python_once(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")

    def sizes(keep):
        return mapped(docs, "text", lambda: lambda texts: [pa.array([len(t or "") for t in texts], pa.int64())], "n long", keep)

    assert sorted(map(tuple, sizes(None).collect())) == [(1, "ab", 2), (2, None, 0)]
    assert sorted(map(tuple, sizes(["doc_id"]).collect())) == [(1, 2), (2, 0)]
    assert "__mapped" not in sizes(None)._jdf.queryExecution().analyzed().toString()
