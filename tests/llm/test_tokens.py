"""Encodings, shards and packing against the tokenizers library and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import packing, sstable
from sparkloom.llm.common import scratch_path
from sparkloom.llm.tokens import Encoder

from .conftest import odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_library(library):
    r = random.Random(1)
    signs = [*"abcXYZ éÉñß'.,!?*$%&#-_ \t\n\x1c\x85İıΣς12३¼中文é́—…🙂KÅ", "<|endoftext|>", "'s", "'re", "n't", "<|", "|>", "<|ENDOFTEXT|>"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["", None]
    own = Encoder(PATH)
    for _ in range(2):  # the second time all words are known
        got = [f[a:b].tolist() for _, f, cuts in own.encode(pa.array(texts), 2) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def expected(library, end):
    return [(r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, end], "<u4")) for r in odd_rows()]


def test_shards_round_trip(spark, odd, empty, library):
    shards = sstable.write_shards(odd, scratch_path(spark, "sst"), shards=3)
    want = sorted(expected(library, 1), key=lambda x: (x[0] is None, x[0] or 0))
    found = []
    for row in sorted(shards.collect(), key=lambda r: r.shard):
        reader = sstable.open_shard(row.path)
        own = list(reader)
        assert (len(own), sum(len(x) for _, x in own)) == (row.rows, row.n_tokens) and reader.rows == row.rows
        for i, ids in own:
            assert any(np.array_equal(ids, x) for x in reader.get(i))
        assert reader.get(5_000_000) == [] and reader.get(-3) == []
        found += own
    assert [i for i, _ in found] == [i for i, _ in want]
    key = lambda rows: sorted((str(i), x.tobytes()) for i, x in rows)
    assert key(found) == key(want)
    assert sstable.write_shards(empty, scratch_path(spark, "none")).count() == 0


def test_blocks_index_and_filter():
    import io

    sink = io.BytesIO()
    writer = sstable.Writer(sink, 2)
    for i in range(0, 4000, 2):
        writer.add(sstable.key_of(i - 500), np.full(i % 97, i % 60000, "<u2").tobytes())
    writer.close()
    reader = sstable.Reader(pa.BufferReader(sink.getvalue()))
    assert len(reader.index) > 3
    for i in (0, 2, 1998, 3998):
        assert reader.get(i - 500)[0].tolist() == [i % 60000] * (i % 97)
    absent = [i for i in range(1, 4000, 2) if reader.may_hold(sstable.key_of(i - 500))]
    assert len(absent) < 100 and all(reader.get(i - 500) == [] for i in absent)


def test_packing(spark, odd, empty, library):
    got = packing.pack(odd, length=64).orderBy("sequence_id", "offset").collect()
    at = {}
    for r in got:
        assert r.offset == at.get(r.sequence_id, 0) and r.length > 0
        at[r.sequence_id] = r.offset + r.length
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert all(n == 64 for n in list(at.values())[:-1]) and sorted(at) == list(range(len(at)))
    # a document's pieces follow each other in the one row of ids, so whole documents come out again
    docs, open_ = [], []
    for r in got:
        assert r.start == sum(len(x) // 4 for x in open_)
        open_.append(r.ids)
        if r.start + r.length == r.doc_tokens:
            docs.append((str(r.id), b"".join(open_)))
            open_ = []
    assert not open_
    assert sorted(docs) == sorted((str(i), x.tobytes()) for i, x in expected(library, 2))
    assert packing.pack(empty).count() == 0


def test_query(spark, sf, library):
    got = {r.doc_id: r for r in sstable.op6_sstable(spark, sf).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.col("doc_id")).select("doc_id", "text").collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        own = got.pop(r.doc_id)
        assert (own.start, own.n_tokens, own.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got
