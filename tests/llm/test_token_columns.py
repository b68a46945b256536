"""Columns looked up in Arrow and the coder in the JVM, held against the library and codec.py."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tessera.llm import codec, compiled, token_output, tokens
from tessera.llm.tokens import Encoder

vocab = pytest.importorskip("public_tokenizers")
BYTES = vocab.path("byte_bpe_50k.json")
ENCODER = Encoder(BYTES, False)


def column(e, texts, kind=None):
    ids, counts = e.column(pa.array(texts, kind or pa.string()))
    return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]


pieces = st.sampled_from(["a", "bé", "Word", "can't", "x1", "漢", "é́", ".", ",,", "!", " ", "\n", "  ", "\t", " ", "\0", "\x01", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "<|"])


@given(st.lists(st.none() | st.lists(pieces, max_size=14).map("".join), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_columns_give_the_librarys_ids(texts):
    assert column(ENCODER, texts) == ENCODER.whole([t or "" for t in texts])


def test_columns_of_slices_and_of_no_rows():
    texts = [prose(k, 40) for k in range(9)] + [None, ""]
    e = Encoder(BYTES, False)
    ids, counts = e.column(pa.array(texts, pa.string()).slice(3, 7))
    assert ids.astype("<u4").tobytes() == b"".join(e.whole([t or "" for t in texts[3:10]])) and len(counts) == 7
    assert [len(x) for x in e.column(pa.array([], pa.string()))] == [0, 0]


def test_table_keeps_a_half_and_the_ids(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE", 60)
    e = Encoder(BYTES, False)
    for k in list(range(30)) * 2:
        texts = [prose(k, 60), "two  spaces", prose(k + 1, 3)]
        assert column(e, texts) == e.whole(texts) and len(e.table.chunks) <= 60


def test_only_new_chunks_meet_the_library(monkeypatch):
    e, seen = Encoder(BYTES, False), []
    monkeypatch.setattr(Encoder, "chunk_ids", lambda self, chunks, f=Encoder.chunk_ids: seen.append(len(chunks)) or f(self, chunks))
    texts = [prose(1, 4000)] * 3
    column(e, texts)
    column(e, [*texts, "anothernewword"])
    assert len(seen) == 2 and seen[0] < 1000 and seen[1] == 1


def documents():
    r = np.random.default_rng(5)
    ids = [np.tile(r.integers(0, 50_000, 300), 30), r.integers(0, 65_536, 5000), r.zipf(1.3, 9000) % 50_000, r.integers(0, 3, 2048)]
    return [[], [[]], [[0]], [x.tolist() for x in ids], [[], *[x[:100].tolist() for x in ids], []]]


def test_the_jvm_gives_the_bytes_of_the_codec(spark):
    lists = [[np.array(d, "<u4").tobytes() for d in some] for some in documents()]
    rows = []
    for k, some in enumerate(lists):
        counts = np.array([len(d) // 4 for d in some], "<u4").tobytes()
        rows.append((k, bytearray(counts), bytearray(np.frombuffer(b"".join(some), "<u4").astype("<u2").tobytes())))
    blobs = spark.createDataFrame(rows, "k int, counts binary, ids binary").select("k", compiled.call(spark, "tessera_encode_ids", "counts", "ids").alias("data"))
    for x in blobs.select("k", "data", compiled.call(spark, "tessera_decode_ids", "data").alias("back")).collect():
        assert bytes(x.data) == codec.encode(lists[x.k]) and [bytes(y.ids) for y in x.back] == lists[x.k] == codec.decode(bytes(x.data))
        assert [y.within for y in x.back] == [sum(map(len, lists[x.k][:i])) // 4 for i in range(len(x.back))]


def test_the_jvm_refuses_broken_blobs(spark):
    blob = codec.encode([np.arange(6000, dtype="<u4").tobytes()])
    broken = bytearray(blob)
    broken[-40] ^= 255
    for bad in (broken, bytearray(blob[:-3]), bytearray(b"x" * 40), bytearray()):
        with pytest.raises(Exception, match="IllegalArgumentException"):
            spark.createDataFrame([(bad,)], "data binary").select(compiled.call(spark, "tessera_decode_ids", "data")).collect()


def test_files_of_several_segments_are_written_and_read_in_the_jvm(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT_IDS", 500)
    monkeypatch.setattr(token_output, "PART", 2000)
    texts = [(k, prose(k, 50 + k)) for k in range(40)]
    token_output.write_tokens(spark.createDataFrame(texts, "doc_id long, text string").repartition(1), BYTES, f"{tmp_path}/a")
    found = token_output.read_tokens(spark, f"{tmp_path}/a")
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    at = 0
    for x, (k, text) in zip(found.orderBy("start").collect(), texts, strict=True):
        ids = ENCODER.whole([text])[0] + b"\0\0\0\0"
        assert (x.doc_id, x.start, x.n_tokens, bytes(x.ids)) == (k, at, len(ids) // 4, ids)
        at += x.n_tokens
    assert spark.read.parquet(f"{tmp_path}/a").count() > 4
