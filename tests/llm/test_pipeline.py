"""The pipeline against its stages said in plain Python, and the registered queries on the smallest tables."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import pytest

from sparkloom.llm import mixing, queries, toxicity
from sparkloom.llm.common import documents, id_text

from .test_dedup import brute_groups, norm


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    docs = documents(spark, sf)
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.id for r in toxicity.score(id_text(docs), model).collect() if r.score >= toxicity.REJECT}
    stage = [f for _, f in corpus_pipeline.STAGES]
    out = stage[0](spark, docs, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(rows) - bad
    left = {i: t for i, t in rows.items() if i not in bad}
    out = stage[1](spark, out, sf)
    first: dict = {}
    for i in sorted(left):
        first.setdefault(norm(left[i]), i)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(first.values())
    left = {i: left[i] for i in first.values()}
    out = stage[2](spark, out, sf)
    keep = {d for d, _, c in brute_groups(sorted(left.items()), 5, 4, 5) if d == c}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == keep
    again = stage[3](spark, out, sf)
    taken = Counter(r.id for r in mixing.mix(out).collect())
    assert again.columns == docs.columns and Counter(r.doc_id for r in again.collect()) == taken
    pieces = stage[4](spark, again, sf).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p.sequence_id] += p.length
    assert all(n == 4096 for s, n in tokens.items() if s != max(tokens))
    assert Counter(p.doc_id for p in pieces if p.start == 0) == taken


def rows_of(df):
    return Counter(tuple(r) for r in df.drop("ids").collect())


def test_run_equals_stages(spark, sf):
    """Row by row, and what the stages have written on the way is deleted but for the last one's input and ids."""
    from sparkloom.llm.common import written

    before = len(written())
    got = rows_of(corpus_pipeline.run(spark, sf))
    assert len(written()) - before == 2
    docs = documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).toArrow()) if stage is not corpus_pipeline.packed else stage(spark, docs, sf)
    pieces = rows_of(docs)
    # packing takes documents as they come, so places depend on the partitions; documents, tokens and sequences don't
    tokens = lambda rows: sorted({(r[0], r[4]) for r in rows}, key=str)  # noqa: E731  doc_id, doc_tokens
    assert got and tokens(got) == tokens(pieces) and sum(r[2] for r in got) == sum(r[2] for r in pieces)
    assert {r[5] for r in got} == {r[5] for r in pieces}
    assert corpus_pipeline.ORACLE_SQL is None


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_of_odd_rows(spark, tmp_path):
    """The chain over nulls, empty and repeated rows, and over nothing: each stage's rows from those of the one before."""
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    base = text(100)
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base + " x", "de", None, None), (None, base + " y", None, None, None), (3, "", "en", "a", 0), (4, None, None, "b", None), (None, None, None, None, None)]
    rows += [(10 + i, text(60) + (" vile" if i % 4 == 0 else ""), "en", "a", 1) for i in range(60)]
    marks = spark.createDataFrame([(10 + i, int(i % 4 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    for own in (rows, []):
        docs = spark.createDataFrame(own, SCHEMA)
        out = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = Counter(tuple(x) for x in out.collect())
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns, name
            found = Counter(tuple(x) for x in out.collect())
            assert set(found) <= set(left) and (name == "mixing" or found <= left), name
            if name == "exact_dedup" and own:
                assert found[(1, base, "en", "a", 1)] == 1 and sum(not (x[1] or "") for x in found) == 1
            if name == "ngram_jaccard" and own:
                assert found[(1, base, "en", "a", 1)] == 1 and not any(x[1] and x[1] != base and x[1].startswith(base) for x in found)
            out = spark.createDataFrame(list(found.elements()), SCHEMA)
        assert (corpus_pipeline.packed(spark, out, str(tmp_path)).count() > 0) == bool(own)


def test_queries_keep_their_contracts(spark, sf):
    """Columns, types and rows of the queries that have no SQL, on the smallest tables."""
    docs = {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}
    named = queries.queries()
    op7 = named["op7_toxicity"](spark, sf)
    assert dict(op7.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = op7.collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    rows = named["op8_order_minhash"](spark, sf).collect()
    assert {r.doc_id: r.n_chars for r in rows} == {i: len(t) for i, t in docs.items()} and len(rows) == len(docs)
    by_text: dict = {}
    assert all(by_text.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint for r in rows)
    rows = named["op9_hilbert_shards"](spark, sf).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()} and len(rows) == len(docs)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1 and {r.law for r in rows} == {"rows"}
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())
    rows = sorted(named["op10_packing"](spark, sf).collect(), key=lambda r: (r.sequence_id, r.offset))
    place, length = Counter(), Counter()
    for r in rows:
        assert r.offset == place[r.sequence_id] and r.length > 0
        place[r.sequence_id] += r.length
        length[r.doc_id] += r.length
    assert {r.doc_id: r.doc_tokens for r in rows} == dict(length) and set(length) == set(docs)
    assert all(n == 4096 for s, n in place.items() if s != max(place)) and sorted(place) == list(range(len(place)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, sf, name):
    df = queries.queries()[name](spark, sf)
    other = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in other.description]
    plain = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    rows = lambda cols, data: sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in data)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, other.fetchall())


def test_each_operator_has_a_query():
    names = queries.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
