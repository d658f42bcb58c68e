"""Minimum bin slack, collocations and bounded clustering against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import inf, nan

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import best_fit, clustering, collocations

from .conftest import odd_rows

# best-fit packing


def check_pieces(got, rows, length, end_id=1):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end_id]
        for p, a in enumerate(range(0, len(ids), length)):
            own = np.array(ids[a : a + length], "<u4").tobytes()
            want[(i, p, a, len(own) // 4, zlib.crc32(own), own)] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= length
    return [sorted((n for _, n in own), reverse=True) for own in bins.values()]


def slack_by_loop(sizes, length):
    """One bin at a time: the longest piece left and the fullest sum of others, by a table of sums."""
    left, bins = Counter(sizes), 0
    while left:
        longest = max(left)
        left[longest] -= 1
        best = {0: ()}
        for x in sorted(left.elements(), reverse=True):
            for s, own in list(best.items()):
                if s + x <= length - longest and s + x not in best:
                    best[s + x] = (*own, x)
        for x in best[max(best)]:
            left[x] -= 1
        left, bins = +left, bins + 1
    return bins


@pytest.mark.parametrize("length", [16, 50, 4096])
def test_slack_of_odd_rows(odd, length):
    rows = [(r[0], r[1]) for r in odd_rows()]
    bins = check_pieces(best_fit.pack(odd, length=length).collect(), rows, length)
    sizes = [n for own in bins for n in own]
    assert -(-sum(sizes) // length) <= len(bins) <= slack_by_loop(sizes, length) + 1


def test_slack_of_an_empty_table(empty):
    assert best_fit.pack(empty).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_kinds_of_bins(seed):
    r = random.Random(seed)
    length = r.choice([10, 37, 64])
    counts = {x: r.choice([0, 1, 2, 5, 60]) for x in range(1, length + 1) if r.random() < 0.7}
    kinds = best_fit.kinds_of_bins(counts, length)
    used = Counter()
    for times, taken in kinds:
        assert sum(x * n for x, n in taken.items()) <= length
        for x, n in taken.items():
            used[x] += n * times
    assert used == +Counter(counts)
    sizes = list(Counter(counts).elements())
    assert sum(t for t, _ in kinds) >= -(-sum(sizes) // length)
    # equal to one bin at a time, up to the choice between equal sums
    if len(sizes) < 400:
        assert abs(sum(t for t, _ in kinds) - slack_by_loop(sizes, length)) <= 1


def test_each_bin_is_the_fullest():
    r = random.Random(4)
    for _ in range(50):
        counts = {x: r.randint(0, 3) for x in r.sample(range(1, 60), 9)}
        room = r.randint(1, 90)
        taken = best_fit.fullest(counts, sorted(counts, reverse=True), room)
        sums = {0}
        for x in Counter(counts).elements():
            sums |= {s + x for s in sums if s + x <= room}
        assert sum(x * n for x, n in taken.items()) == max(sums)
        assert all(n <= counts[x] for x, n in taken.items())


def test_slack_is_one_table_for_any_number_of_pieces():
    """Kinds of bins grow with the lengths, not with the pieces."""
    r = random.Random(5)
    counts = {x: r.randint(1, 9) for x in range(1, 513)}
    few, many = (best_fit.kinds_of_bins({x: n * f for x, n in counts.items()}, 512) for f in (1, 10**9))
    assert len(many) < 3 * 512 and len(few) < 3 * 512
    assert sum(t for t, _ in many) <= 1.01 * sum(x * n * 10**9 for x, n in counts.items()) / 512


def test_slack_fills(spark, sf):
    got = best_fit.op11_bin_slack(spark, sf).collect()
    bins = len({r.sequence_id for r in got})
    assert bins <= -(-sum(r.length for r in got) // 4096) + 1


# collocations


def phrases_by_loop(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    f = {k: a for k, a in f.items() if a >= least}
    out = defaultdict(list)
    for (lang, *p), a in f.items():
        if len(p) < 2:
            continue
        inside = any(len(q) > len(p) and x == lang and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, *q), b in f.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), a, f[(lang, *p[:k])], f[(lang, *p[k:])], n[lang], score))
    return {(lang, i + 1, x[2].decode(), *x[3:]) for lang, own in out.items() for i, x in enumerate(sorted(own)[:top])}


def result(df):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize(("least", "top", "how"), [(2, 2000, {}), (3, 7, {"ranges": 40}), (2, 2000, {"ranges": 60, "splits": 3}), (2, 50, {"local": 10, "tokens": 20, "ranges": 9})])
def test_collocations_of_odd_rows(odd, least, top, how):
    want = phrases_by_loop([(r[2], r[1]) for r in odd_rows()], least, top)
    assert want and result(collocations.collocations(odd, least, top, **how)) == want


def test_collocations_of_an_empty_table(empty, spark):
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", ""), ("en", " .\n")], "lang string, text string"), 1).collect() == []


def test_collocations_of_long_texts(spark):
    """A hot phrase and texts over many slices and chunks; pieces go on over their borders."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["Of", "the", "\t", "a."]
    long = " ".join("of the same kind" if r.random() < 0.3 else r.choice(words) for _ in range(60_000))
    rows = [("en", long), ("de", long[:200_000].replace(".", "")), (None, "x" * 300_000 + " y z" * 150), ("en", "    " * 50_000 + "of the" + "\n" * 9)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = phrases_by_loop(rows, 100, 2000)
    assert result(collocations.collocations(docs)) == want
    assert result(collocations.collocations(docs, tokens=5000, local=60)) == want


def test_a_row_of_a_chunk_holds_one_word_at_most(spark):
    """Spark reads 4096 rows at once: with a chunk's dictionary in one row, these were all words of a partition's chunks."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(30)}" for _ in range(40)) for _ in range(50)]
    rows = collocations.encoded(spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1), tokens=100, local=20)
    assert all(f.dataType.typeName() not in ("array", "map", "struct") for f in rows.schema)
    found, n = defaultdict(list), Counter()
    for x in rows.collect():
        assert (x["ids"] is None) == (x["word"] is not None) == (x["at"] >= 0)
        found[x["chunk"]].append(x["at"])
        n[x["word"]] += x["n"] or 0
    assert len(found) > 10 and all(sorted(own) == list(range(-1, len(own) - 1)) and len(own) <= 21 for own in found.values())
    assert +n == Counter(w for t in texts for w in t.split())


def test_chunks_over_many_batches(spark, odd):
    """A chunk's words go on in the next batch."""
    want = phrases_by_loop([(r[2], r[1]) for r in odd_rows()], 2, 50)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        assert result(collocations.collocations(odd, 2, 50, local=30, ranges=5)) == want
    finally:
        spark.conf.set(name, before)


def test_radix_order():
    r = np.random.default_rng(1)
    for width in (1, 2, 5, 15, 20):
        keys = r.integers(0, 3, (500, width)).astype(np.uint8)
        assert [k.tobytes() for k in keys[collocations.radix_order(keys)]] == sorted(k.tobytes() for k in keys)


def test_products_past_64_bits(spark):
    """1000 * a * n and l * r in decimals."""
    from pyspark.sql import functions as F

    f, n, left = 10**13, 15 * 10**12, 14 * 10**12
    own = spark.createDataFrame([(f, n, left, left)], "f bigint, n bigint, l bigint, r bigint")
    score = own.select(F.expr(collocations.SCORE).alias("score")).first()["score"]
    assert score == 1000 * f * n // (left * left) and score < 2**63


# clustering


def clusters_by_loop(rows, k, rounds):
    own = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centres = [v for _, v in sorted(own, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        at = [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in own]
        if turn < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, c) in zip(own, at, strict=True) if c == j]
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else centres[j]
    inertia = Counter()
    for d, j in at:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(own, at, strict=True))


def vectors(seed, n, spread=1.0):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(5, 64)) / 8
    return [(i, (middle[i % 5] + spread * r.normal(size=64) / 8).tolist()) for i in range(n)]


ODD_VECTORS = [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (1004, [None] + [0.5] * 63), (1005, [nan] * 64), (1006, [inf] + [0.0] * 63), (None, [0.25] * 64), (None, [-0.01] * 64), (7, [0.25] * 64), (7, [0.25] * 64)]


@pytest.mark.parametrize(("rows", "k", "rounds"), [(vectors(1, 300) + ODD_VECTORS, 16, 3), (vectors(2, 200, 0.1), 16, 6), (vectors(3, 9), 16, 3), ([(i, [0.125 * (i % 2)] * 64) for i in range(60)], 16, 3), (vectors(4, 150), 1, 2), (vectors(5, 400, 0.4), 7, 8)])
def test_clusters(spark, rows, k, rounds):
    own = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, id int, cluster string").repartition(3)
    got = clustering.cluster(own, k=k, rounds=rounds).collect()
    assert Counter((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == clusters_by_loop(rows, k, rounds)


def test_clusters_of_an_empty_table(spark):
    for rows in ([], ODD_VECTORS[:7]):
        got = clustering.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
        assert got.collect() == [] and "centroid_sha256" in got.columns


def test_bounds_spare_scans(spark):
    """Of vectors in well-parted groups, few are compared with all centroids in the last assignment."""
    own = spark.createDataFrame(vectors(6, 400, 0.1), "vec_id bigint, embedding array<double>")
    got = clustering.cluster(own, k=5, rounds=6).collect()
    assert sum(r.scanned for r in got) < 40


def test_vectors_beyond_64_bits_stop(spark):
    own = spark.createDataFrame([(1, [1e30] * 64), (2, [0.0] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(own).collect()
