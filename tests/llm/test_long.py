"""Texts larger than a slice (512 KB; 2 MB for tokens) in the operators whose other tests have short ones."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import exact_dedup, licenses, mixing, packing, sharding, sstable, toxicity
from sparkloom.llm.common import scratch_path
from sparkloom.llm.shingles import text_slices

N = 330_000


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    words = [f"word{i}" for i in range(300)] + ["good", "fine,", "Zeit.", "l'été"]
    long = " ".join(r.choice(words) for _ in range(N))
    assert len(long) > 1 << 21
    other = long.replace(" ", "  ", 5000) + "\n"
    return [(4, long), (2, other), (7, long + " Released under the MIT License. " + long[:600_000]), (9, "short text"), (11, long[: 1 << 20] + " vile vile")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")


def test_exact(docs, rows):
    got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.dedup_groups(docs).collect()}
    assert got == {4: (4, 1), 2: (2, 1), 7: (7, 1), 9: (9, 1), 11: (11, 1)}
    twice = docs.unionByName(docs.filter("doc_id = 4").selectExpr("5 as doc_id", "concat(replace(text, ' ', '\t'), '') as text", "lang", "source"))
    assert {r.id: r.keep_id for r in exact_dedup.dedup_groups(twice).collect()}[5] == 4


def test_licences(docs):
    got = {r.doc_id: r.licenses for r in licenses.scan(docs, windows=True).collect()}
    assert got == {4: "", 2: "", 7: "MIT", 9: "", 11: ""}


def test_mix_and_shards(docs, rows):
    got = {r.id: r.tokens for r in mixing.mix(docs, share=1.0, epochs=1).collect()}
    assert got == {i: len(t.split()) for i, t in rows}
    assert {r.id: r.size for r in sharding.shards(docs, 2).collect()} == {i: len(t.encode()) + 1 for i, t in rows}


def test_tokens(spark, docs, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for i, t in rows}
    shards = sstable.write_shards(docs, scratch_path(spark, "sst"), shards=2)
    for row in shards.collect():
        for i, own in sstable.open_shard(row.path):
            assert own.tolist() == [*ids[i].tolist(), sstable.END_ID]
    pieces: dict = {}
    for r in packing.pack(docs).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.id, []).append((r.start, r.ids))
    assert {i: b"".join(x for _, x in sorted(own)) for i, own in pieces.items()} == {i: x.tobytes() + np.array([packing.END_ID], "<u4").tobytes() for i, x in ids.items()}


def test_toxicity(rows):
    """A long text's score is the largest of its windows', each scored as a text of its own."""
    m = toxicity.Trainer(4).m
    scale = np.random.default_rng(3)
    m = m | {"H": scale.standard_normal(m["H"].shape).astype(np.float32), "vocabulary": np.zeros(0, np.uint64), "classes": np.zeros(0, np.int64)}
    words = rows[0][1].replace("'", " ").split()[:150_000]
    score = lambda texts: np.concatenate([toxicity.scores(toxicity.Texts(d, o), m, toxicity.Spelling(m)) for _, _, d, o in text_slices(pa.array(texts))])
    whole = score([" ".join(words)])
    parts = score([" ".join(words[i : i + toxicity.WINDOW]) for i in range(0, len(words) - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE)])
    assert len(whole) == 1 and whole[0] == pytest.approx(parts.max(), abs=1e-4) and parts.std() > 0.01
