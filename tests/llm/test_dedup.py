"""Exact dedup, n-gram join and substring removal against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import anchors, exact_dedup, ngram_join, suffix_dedup
from sparkloom.llm.common import written
from sparkloom.llm.components import components

from .conftest import odd_rows


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize(("ranges", "splits"), [(1, 9), (3, 9), (40, 99), (40, 5)])
def test_exact(odd, ranges, splits):
    got = exact_dedup.dedup_groups(odd, ranges=ranges, splits=splits).collect()
    rows = [(r[0], norm(r[1])) for r in odd_rows()]
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = Counter()
    for i, t in rows:
        ids = [x for x in groups[t] if x is not None]
        want[(i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.id == r.keep_id for r in kept)


LAST = 2**63 - 1


@pytest.mark.parametrize("ranges", [1, 12])
def test_exact_of_the_largest_ids(spark, ranges):
    rows = [(LAST, "a"), (None, "a"), (LAST, "b"), (None, "c"), (None, "c"), (-(2**63), "d"), (LAST - 1, "d")]
    got = exact_dedup.dedup_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), ranges=ranges).collect()
    want = [(LAST, LAST, 2, True), (None, LAST, 2, False), (LAST, LAST, 1, True), (-(2**63), -(2**63), 2, True), (LAST - 1, -(2**63), 2, False), (None, None, 2, True), (None, None, 2, False)]
    assert Counter((r.id, r.keep_id, r.group_size, r.kept) for r in got) == Counter(want)


def test_exact_of_a_hot_text(spark):
    """One text in most rows: its ranges are cut by id, and their runs joined."""
    rows = [(i, "hot text") for i in range(500)] + [(1000 + i, f"t {i % 7}") for i in range(40)]
    got = exact_dedup.dedup_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), ranges=64, splits=8).collect()
    assert Counter((r.keep_id, r.group_size) for r in got) == Counter([(0, 500)] * 500 + [(1000 + i % 7, 6 if i % 7 < 5 else 5) for i in range(40)])
    assert sum(r.kept for r in got) == 8 and all(r.kept == (r.id == r.keep_id) for r in got)


@pytest.mark.parametrize("key", ["cast(null as bigint)", "cast(7 as bigint)"])
def test_exact_copies_of_one_id_are_many_tasks(spark, key):
    """100,000 copies without id, or with one id, are cut into ranges like others."""
    rows = spark.range(100_000).selectExpr(f"{key} as doc_id", "'a hot text' as text")
    for ranges, splits in ((16, 1024), (16, 4)):
        got = exact_dedup.dedup_groups(rows, ranges=ranges, splits=splits)
        runs = spark.read.parquet(next(p for p in reversed(written()) if p.endswith("dedup-runs")))
        sizes = [r["count"] for r in runs.groupBy("range").count().collect()]
        assert sum(sizes) == 100_000 and max(sizes) < 25_000
        whole = got.agg({"group_size": "min", "id": "count"}).first()
        assert whole[0] == 100_000 and got.filter("kept").count() == 1


def test_suffixes_of_copies_without_id_are_many_tasks(spark):
    """Rows that agree in all columns lie in several parts; without id none repeats another."""
    text = "a passage of more than fifty bytes that all of the rows have in common"
    rows = spark.range(400).selectExpr("cast(null as bigint) as doc_id", f"'{text}' as text").union(spark.createDataFrame([(3, text)], "doc_id bigint, text string"))
    got = suffix_dedup.deduplicated(rows)
    assert Counter((r.id, r.n_removed) for r in got.collect()) == Counter({(None, len(text)): 400, (3, 0): 1})
    assert got.groupBy(F.spark_partition_id()).count().count() > 1


def test_exact_apply_to_repeated_ids(spark):
    rows = [(1, "a b"), (1, "a  b"), (2, "a\tb"), (None, "c d"), (None, "c\nd"), (1, "e")]
    out = exact_dedup.apply(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, norm(r.text)) for r in out) == Counter([(1, "a b"), (None, "c d"), (1, "e")])


def test_exact_apply(odd, empty):
    out = exact_dedup.apply(odd)
    assert out.columns == odd.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(r[1]) for r in odd_rows()})
    assert exact_dedup.apply(empty).count() == 0 and exact_dedup.dedup_groups(empty).count() == 0


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, num, den):
    """Lists of the rows of each component."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = both and den * both >= num * (len(sets[i]) + len(sets[j]) - both)
            if linked or rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                root[top(i)] = top(j)
    out: dict = {}
    for i in range(len(rows)):
        out.setdefault(top(i), []).append(i)
    return list(out.values())


def brute_groups(rows, k, num, den):
    out = Counter()
    for own in brute_components(rows, k, num, den):
        least = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        out.update((rows[i][0], len(shingles(rows[i][1], k)), least) for i in own)
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_groups(odd, k, num, den):
    got = Counter(tuple(r) for r in ngram_join.groups(odd, k, (num, den)).collect())
    assert got == brute_groups([r[:2] for r in odd_rows()], k, num, den)


def test_groups_of_near_copies(spark, monkeypatch):
    """Chains and a large cluster, with blocks so small that every way of comparing is taken."""
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = list(r.choice(vocabulary, 120))
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(int(r.integers(0, 4))):
            own[int(r.integers(0, 120))] = "n" + str(r.integers(0, 9))
        rows.append((i * 3, " ".join(own)))
    chain = list(r.choice(vocabulary, 100))
    for i in range(12):
        chain[i * 8] = f"c{i}"
        rows.append((1000 - i, " ".join(chain)))
    monkeypatch.setattr(ngram_join, "LIST", 16)
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    monkeypatch.setattr(ngram_join, "STARS", 1)
    tried = []
    verified = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a: (tried.extend(frozenset(r) for r in pairs.collect()), verified(pairs, *a))[1])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(x) for x in ngram_join.groups(df, 4, (85, 100), frequent=20).collect())
    assert got == brute_groups(rows, 4, 85, 100)
    # once per pair, and not all pairs of the group
    assert 0 < len(tried) == len(set(tried)) < 90 * 89 / 4


def test_sizes_of_a_frequent_list(spark):
    """A list with many salts gets its whole size, and no task of the join holds all of its rows."""
    hot = [(7, salt, 1000 * salt + i) for salt in range(1, 21) for i in range(500)]
    short = [(h, 0, 50_000 + 2 * h + i) for h in range(100, 200) for i in range(2)]
    same = [(8, 0, 60_000), (8, 0, 60_000)]
    rows = [(h, salt, node, 10, 0, True) for h, salt, node in hot + short + same]
    lists = spark.createDataFrame(rows, "h bigint, salt int, node bigint, n bigint, pos int, indexed boolean")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ngram_join.mixed(lists, None)
        assert sorted((r.h, r.node, r["size"]) for r in got.collect()) == sorted((h, node, 10_000 if h == 7 else 2) for h, _, node in hot + short)
        most = max(r["count"] for r in got.filter("h = 7").groupBy(F.input_file_name()).count().collect())
        assert most < 10_000 * 0.6
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_links(spark, odd):
    """Verified links are links of the brute force, and connect what it connects."""
    rows = [r[:2] for r in odd_rows()]
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t, 4))
    found = [tuple(r) for r in ngram_join.links(odd, 4, (85, 100)).collect()]
    like = lambda a, b: bool(a & b) and 100 * len(a & b) >= 85 * len(a | b)
    assert found and all(any(like(a, b) for a in sets[i] for b in sets[j]) for i, j in found)


def test_pieces_of_lists():
    """Candidate pairs of lists of all shapes against a loop over all pairs."""
    r = np.random.default_rng(3)
    num, den = 4, 5
    c = {k: [] for k in ("h", "piece", "side", "node", "label", "n", "pos", "indexed")}
    for h, (size, across) in enumerate([(1, 0), (2, 0), (7, 0), (64, 0), (65, 0), (200, 0), (3, 1), (90, 1)]):
        n = r.integers(5, 30, size)
        values = {"h": np.full(size, h), "piece": np.zeros(size), "side": np.arange(size) % 2 + 1 if across else np.zeros(size), "node": np.arange(size), "label": r.integers(0, 4, size), "n": n, "pos": r.integers(0, 5, size), "indexed": r.random(size) < 0.6}
        for k in c:
            c[k].append(values[k])
    c = {k: np.concatenate(v).astype(bool if k == "indexed" else np.int64) for k, v in c.items()}
    c["brief"] = np.uint64(1) << r.integers(0, 4, (len(c["h"]), 3)).astype(np.uint64)
    got = Counter(frozenset((int(i), int(j))) for x, y in ngram_join.pairs_of_lists(c, num, den) for i, j in zip(x, y, strict=True))
    want = set()
    for i in range(len(c["h"])):
        for j in range(i):
            n, m, p, q = (int(c[k][x]) for k in ("n", "pos") for x in (i, j))
            differ = int(np.bitwise_count(c["brief"][i] ^ c["brief"][j]).sum())
            same = c["h"][i] == c["h"][j] and c["label"][i] != c["label"][j] and (not c["side"][i] or c["side"][i] != c["side"][j])
            short = c["indexed"][i] and n <= m or c["indexed"][j] and m <= n
            if same and short and n * den >= m * num and m * den >= n * num and min(p, q) + 1 + min(n - 1 - p, m - 1 - q) >= ngram_join.needed(n, m, num, den) and (n + m - differ) * (num + den) >= 2 * num * (n + m):
                want.add(frozenset((i, j)))
    assert want and got == Counter(want)


@pytest.mark.parametrize("size", [3, 400, 200_000])
def test_suffix_filter_keeps_links(size):
    """Pairs at the threshold pass, also of sets so large that sizes of parts would not fit 16 bits, and of unlike sizes."""
    own = np.random.default_rng(1).permutation(np.arange(2 * size, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    bits = lambda x: pa.array([ngram_join.part_bits(x)], pa.binary())
    for a, b in ((own[:size], own[:size]), (own[:size], own[: -(-size * 4 // 5)]), (own[:size], own[size // 10 : size])):
        both = len(np.intersect1d(a, b))
        passed = ngram_join.may_reach(np.array([len(a)]), np.array([len(b)]), bits(a), bits(b), 4, 5)
        assert passed.all() or 5 * both < 4 * (len(a) + len(b) - both)
    assert size < 100 or not ngram_join.may_reach(np.array([size]), np.array([size]), bits(own[:size]), bits(own[size:]), 4, 5).any()


def test_lone_postings_go_when_counters_are_full(spark):
    """Rarity is told by what a counter has beyond the mean, so a corpus that fills the table keeps no lone postings."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(20)] + [(100 + i, "a b c d e f g h") for i in range(2)]
    df = ngram_join.id_text(spark.createDataFrame(rows, "doc_id bigint, text string"))
    full = spark.sparkContext.broadcast(np.full(ngram_join.COUNTERS, 1 << 20, np.int32))
    found = ngram_join.postings(df, 4, 4, 5, full)
    assert found.filter("salt > 0").count() == 0 and found.count() > 100
    assert ngram_join.shared(found, 4, 5).count() == 0


def test_groups_of_the_largest_ids_and_none(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(LAST, text), (LAST - 1, text + " x"), (None, text + " y"), (None, "no one else has this text at all"), (-(2**63), "a b c d e f")]
    got = Counter(tuple(r) for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, (85, 100)).collect())
    assert got == brute_groups(rows, 4, 85, 100) and (LAST, 57, LAST - 1) in got


def test_groups_of_long_texts(spark):
    """Texts of more than a slice each."""
    r = np.random.default_rng(4)
    own = [f"v{i}" for i in r.integers(0, 10**6, 100_000)]
    rows = [(5, " ".join(own)), (3, " ".join(own[:95_000])), (9, " ".join(own[:80_000])), (7, " ".join(own[40_000:]))]
    assert all(len(t) > 1 << 18 for _, t in rows) and len(rows[0][1]) > 1 << 19
    got = Counter(tuple(x) for x in ngram_join.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, (85, 100)).collect())
    assert got == brute_groups(rows, 4, 85, 100) and len({c for _, _, c in got}) == 3


def test_groups_apply(odd, empty):
    """One row of each component stays, also of rows without ids and of rows that repeat an id."""
    out = ngram_join.apply(odd)
    assert out.columns == odd.columns
    rows = [r[:2] for r in odd_rows()]
    groups = brute_components(rows, 5, 4, 5)
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert sum(kept.values()) == len(groups)
    for own in groups:
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        found = {rows[i] for i in own if kept[rows[i]]}
        assert len(found) == 1 and next(iter(found))[0] == min(ids, default=None)
    assert ngram_join.apply(empty).count() == 0 and ngram_join.groups(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, i) for i in range(51, 80)] + [(100, 99), (99, 98), (3, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = {i: 0 for i in range(21)} | {i: 50 for i in range(50, 80)} | {i: 98 for i in range(98, 101)}
    assert got == want


def brute_cut(rows, n=50):
    where: dict = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            d_key = float("inf") if d is None else d
            where[s] = min(where.get(s, float("inf")), d_key)
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if where[b[i : i + n]] < (float("inf") if d is None else d):
                gone[i : i + n] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[(d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_suffixes(odd, empty):
    got = Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(odd).collect())
    want = brute_cut([r[:2] for r in odd_rows()])
    assert got == want
    # ranges cut again by a hash
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(odd, splits=1).collect()) == want
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_anchors_depend_on_windows_alone():
    """Equal windows pick the same anchor wherever they stand and whatever is around, also among equal grams."""
    r = np.random.default_rng(0)
    for body in ("".join(r.choice(list("ab"), 400)), "abcd" * 100, "x" * 300):
        places = []
        for before in ("", "q" * 17, "z" * 70_000):
            data = np.frombuffer((before + body + before).encode(), np.uint8)
            a = anchors.Anchors(data, np.array([0, len(data)]))
            inside = [(int(p) - len(before), int(p) - len(before) - o) for p, low, high in zip(a.place, a.low, a.high, strict=True) for o in range(low, high + 1)]
            places.append({s: p for p, s in inside if 0 <= s <= len(body) - anchors.SPAN})
        assert places[0] == places[1] == places[2] and len(places[0]) == len(body) - anchors.SPAN + 1


def test_suffixes_of_long_texts(spark):
    """Texts of several slices each, with passages in common."""
    r = np.random.default_rng(9)
    text = lambda n: "".join(r.choice(list("abcdefgh é"), n))
    shared = text(3000)
    rows = [(i, text(300_000 + 1000 * i) + shared + text(200_000)) for i in range(3)] + [(9, shared[:70])]
    got = Counter((x.id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == brute_cut(rows)


@pytest.mark.parametrize(("dense", "splits"), [(0, 1024), (1, 1024), (256, 1024), (0, 1), (1, 3)])
def test_suffixes_of_shared_passages(spark, dense, splits):
    r = np.random.default_rng(2)
    text = lambda n: "".join(r.choice(list("ab c"), n))
    shared = [text(n) for n in (49, 50, 51, 80, 300)]
    rows = [(int(i), text(int(r.integers(0, 200))) + shared[i % 5] + text(int(r.integers(0, 99))) + shared[(i * 7) % 5] * (i % 3)) for i in r.permutation(60)]
    got = Counter((x.id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), dense=dense, splits=splits).collect())
    assert got == brute_cut(rows)


def test_multikey_order():
    r = np.random.default_rng(1)
    rows = r.integers(0, 2, (500, 20)).astype(np.uint8)
    order = anchors.multikey_order(anchors.as_words(rows))
    as_bytes = [rows[i].tobytes() for i in order]
    assert as_bytes == sorted(as_bytes)
    same = anchors.common_prefix(rows, order)
    for a, b, n in zip(as_bytes, as_bytes[1:], same[1:], strict=False):
        assert a[:n] == b[:n] and (n == 20 or a[n] != b[n])
