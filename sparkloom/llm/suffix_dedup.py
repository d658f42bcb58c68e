"""Removal of repeated substrings by a distributed, sparse suffix array.

A byte goes if it lies in a string of SPAN bytes that also starts in a document
with a smaller id.  Equal strings of SPAN bytes have equal anchors (see
``anchors``), so only the suffixes at anchors are sorted:

1. Parts of the documents list the hashes of their anchors' K leading bytes.
   These meet in buckets of the hash range, which answer with one bit for each
   hash: whether more than one document has it.  All other anchors are done with.
2. Suffixes at the anchors left, with up to SPAN bytes and the bytes before them,
   are range-partitioned by sampled splitters of K leading bytes.  Of those that
   agree in all bytes, a part sends only the one of its smallest id, so a passage
   in any number of documents is one row for each part.  A bucket sorts its
   suffixes by multikey sorting, finds common prefixes of neighbours, and answers
   with one bit for each window.  Splitters are cut to K bytes, so suffixes that
   could share a window never lie on both sides of a boundary.
   At the edges of a passage in very many documents, suffixes agree in their first
   K bytes but not in all, and no splitter of K bytes parts them.  Where more than
   ``dense`` parts have an anchor's hash, the suffixes at all window starts are sent
   instead of the one at the anchor, and range-partitioned by splitters of SPAN
   bytes: each stands for one window, so equal ones are neighbours in one bucket,
   and a bucket has one row of them for each part at most.
3. Parts mark the windows' bytes and cut them out.

The three steps read the same shuffled documents; texts move once.

Defined cases: null text is empty; a null id counts as larger than any other;
rows that repeat an id don't repeat each other (no id is smaller); texts below
SPAN bytes stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.anchors import LEFT, SPAN, Anchors, K, as_words, common_prefix, least_ids, multikey_order
from sparkloom.llm.common import LAST, documents, id_text, partitions, tidy
from sparkloom.llm.shingles import mix, text_slices

SAMPLE, DENSE, SPLITTERS = 64, 256, 1024
_U = np.uint64
_LOW40 = _U((1 << 40) - 1)
_HASHES = "bucket int, part int, n int, hashes binary, several binary"
_ANSWERS = "part int, kind int, bucket int, answer binary"
_SUFFIXES = "bucket int, part int, kind int, n int, rows binary"
RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


class Part:
    """The anchors of a part's texts and the order of their distinct hashes."""

    def __init__(self, docs: pa.Table):
        self.ids = docs.column("id").combine_chunks().fill_null(LAST).to_numpy()
        self.slices = []
        for i, j, data, offsets in text_slices(docs.column("text").combine_chunks(), 1 << 18):
            self.slices.append((i, j, Anchors(data, offsets)))
        tidy()
        join = lambda name, kind: np.concatenate([getattr(a, name) for _, _, a in self.slices] or [np.zeros(0, kind)])
        self.key = join("key", _U)
        self.doc = np.concatenate([i + a.text for i, _, a in self.slices] or [np.zeros(0, np.int64)])
        self.keys = np.unique(self.key)

    def several(self) -> np.ndarray:
        """Of each distinct hash, whether two of the part's documents have it."""
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], self.doc[order]
        two = (key[1:] == key[:-1]) & (doc[1:] != doc[:-1])
        out = np.zeros(len(self.keys), bool)
        out[np.searchsorted(self.keys, key[1:][two])] = True
        return out

    def share(self, answers: list[tuple[int, bytes]], buckets: int) -> None:
        """Keeps the anchors of hashes that more documents have, and groups those that agree in all bytes."""
        at = np.searchsorted(bucket_of(self.keys, buckets), np.arange(buckets + 1))
        common, hot = np.zeros((2, len(self.keys)), bool)
        for bucket, answer in answers:
            n = at[bucket + 1] - at[bucket]
            common[at[bucket] : at[bucket + 1]], hot[at[bucket] : at[bucket + 1]] = np.unpackbits(np.frombuffer(answer, np.uint8), count=2 * n).astype(bool).reshape(2, n)
        self.spread(hot)
        common &= ~hot
        right, left, low, high, ids, of = [], [], [], [], [], []
        for s, (i, _, a) in enumerate(self.slices):
            some = np.flatnonzero(common[np.searchsorted(self.keys, a.key)]) if len(a.key) else np.zeros(0, np.int64)
            r, p = a.contexts(some)
            right.append(r)
            left.append(p)
            low.append(a.low[some])
            high.append(a.high[some])
            ids.append(self.ids[i + a.text[some]])
            of.append(np.stack([np.full(len(some), s), a.place[some]], 1))
        empty = lambda width: [np.zeros((0, width), np.uint8)]
        self.right, self.left = np.concatenate(right or empty(SPAN)), np.concatenate(left or empty(LEFT))
        none = [np.zeros(0, np.int64)]
        self.low, self.high, ids = np.concatenate(low or none), np.concatenate(high or none), np.concatenate(ids or none)
        self.of = np.concatenate(of or [np.zeros((0, 2), np.int64)])
        words = [*as_words(self.right), *as_words(self.left), self.low.astype(_U), self.high.astype(_U)]
        own = np.zeros(len(ids), _U)
        for w in words:
            own = mix(own * _U(0xD1342543DE82EF95) + w + _U(1))
        order = np.lexsort((ids, own))
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([w[order[1:]] != w[order[:-1]] for w in words], axis=0) if len(order) > 1 else True
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        self.first = order[fresh]
        self.first_id = ids[self.first]
        self.group, self.own_id = group, ids

    def spread(self, hot: np.ndarray) -> None:
        """The suffixes at the window starts of anchors of hot hashes: slice, start and id, the group of equal ones, and each group's bytes and smallest id."""
        at, ids, rows = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, SPAN), np.uint8)]
        for s, (i, _, a) in enumerate(self.slices):
            some = np.flatnonzero(hot[np.searchsorted(self.keys, a.key)]) if len(a.key) else np.zeros(0, np.int64)
            if not len(some):
                continue
            n = a.high[some] - a.low[some] + 1
            start = np.repeat(a.place[some] - a.high[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at.append(np.stack([np.full(len(start), s), start], 1))
            ids.append(np.repeat(self.ids[i + a.text[some]], n))
            rows.append(a.data[start[:, None] + np.arange(SPAN)])
        self.w_at, self.w_id, rows = np.concatenate(at), np.concatenate(ids), np.concatenate(rows)
        words = as_words(rows)
        order = multikey_order([*words, self.w_id.view(_U) ^ _U(1 << 63)])
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([w[order[1:]] != w[order[:-1]] for w in words], axis=0) if len(order) > 1 else True
        self.w_group = np.empty(len(order), np.int64)
        self.w_group[order] = np.cumsum(fresh) - 1
        lead = order[fresh]
        # groups are in the order of their bytes, and so of their buckets
        self.w_row, self.w_first_id = rows[lead], self.w_id[lead]

    def dense_dealt(self, splitters: np.ndarray, finer: int) -> tuple[np.ndarray, np.ndarray]:
        """The groups of suffixes at window starts in the order in which they are sent, and their buckets."""
        return in_buckets(self.w_row, splitters, finer)

    def dealt(self, splitters: np.ndarray, finer: int) -> tuple[np.ndarray, np.ndarray]:
        """The groups in the order in which they are sent, and their buckets."""
        return in_buckets(np.ascontiguousarray(self.right[self.first][:, :K]), splitters, finer)


def in_buckets(rows: np.ndarray, splitters: np.ndarray, finer: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by bucket, and their buckets in that order; the range between two splitters is ``finer`` buckets, by a hash of the row."""
    bucket = np.searchsorted(splitters, np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), "right")
    if finer > 1:
        own = np.zeros(len(rows), _U)
        for w in as_words(rows):
            own = mix(own * _U(0xD1342543DE82EF95) + w + _U(1))
        bucket = bucket * finer + (own % _U(finer)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def sampled_splitters(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """K leading bytes that cut suffixes at anchors into even ranges, and SPAN bytes that cut those at window starts, from about SAMPLE * buckets of each."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                a = Anchors(data, offsets)
                # of each text one anchor and one of its windows, whose numbers come from the first one's hash
                text, first, count = np.unique(a.text, return_index=True, return_counts=True)
                chosen = first + (mix(a.key[first] + _U(1)) % count.astype(_U)).astype(np.int64) if len(first) else first
                place = a.place[chosen]
                start = place - a.low[chosen] - (a.key[chosen] % (a.high[chosen] - a.low[chosen] + 1).astype(_U)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([data[p : p + n].tobytes() for p in x.tolist()], pa.binary()) for x, n in ((place, K), (start, SPAN))], ["lead", "window"])

    n = rows.count()
    share = min(1.0, SAMPLE * buckets / n) if n else 1.0
    found = rows.sample(share, 5).mapInArrow(lead, "lead binary, window binary").toArrow()

    def cut(column: str, size: int) -> np.ndarray:
        own = sorted(found.column(column).to_pylist())
        return np.unique(np.array([own[len(own) * j // buckets] for j in range(1, buckets)] if own else [], f"S{size}"))

    return cut("lead", K), cut("window", SPAN)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """All bytes of a binary column one after another, without a copy if it is one chunk."""
    parts = []
    for c in column.chunks:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        parts.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[at[0] : at[-1]])
    return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint8)])


def _tidied(f):
    """f, after which the worker gives back what it doesn't use."""

    def g(*tables: pa.Table) -> pa.Table:
        out = f(*tables)
        tidy()
        return out

    return (lambda table: g(table)) if f.__code__.co_argcount == 1 else (lambda table, answers: g(table, answers))


def _several_documents(table: pa.Table, hot: int) -> pa.Table:
    """Step 1's bucket: one bit for each hash of each part."""
    counts = table.column("n").to_pylist()
    own = np.zeros((sum(counts), 8), np.uint8)
    own[:, :5] = _bytes(table.column("hashes")).reshape(-1, 5)
    key = own.view("<u8").ravel()
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(table.column("several").to_pylist(), counts, strict=True)]).astype(bool)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    run = np.cumsum(fresh) - 1
    size = np.bincount(run)
    common = (size > 1) | (np.bincount(run, several[order]) > 0)
    out = np.empty((2, len(key)), bool)
    out[:, order] = common[run], (size > hot)[run]
    parts = np.split(out, np.cumsum(counts)[:-1], axis=1)
    return _answered(table, 0, [np.packbits(p).tobytes() for p in parts])


_ROW = SPAN + LEFT + 2 + 8


def _answered(table: pa.Table, kind: int, parts: list[bytes]) -> pa.Table:
    return pa.table({"part": table.column("part"), "kind": pa.array([kind] * len(parts), pa.int32()), "bucket": table.column("bucket"), "answer": pa.array(parts, pa.binary())})


def _sorted_windows(table: pa.Table) -> pa.Table:
    """Step 2's bucket of suffixes at window starts: sorts them; a bit for each, whether a neighbour with all bytes equal has a smaller id."""
    counts = table.column("n").to_pylist()
    rows = _bytes(table.column("rows")).reshape(-1, SPAN + 8)
    own = np.ascontiguousarray(rows[:, :SPAN])
    ids = np.ascontiguousarray(rows[:, SPAN:]).view("<i8").ravel()
    order = multikey_order([*as_words(own), ids.view(_U) ^ _U(1 << 63)])
    fresh = common_prefix(own, order) < SPAN
    fresh[:1] = True
    least = ids[order[fresh]]
    out = np.empty(len(order), bool)
    out[order] = ids[order] > least[np.cumsum(fresh) - 1]
    return _answered(table, 2, [np.packbits(p).tobytes() for p in np.split(out, np.cumsum(counts)[:-1])])


def _sorted_suffixes(table: pa.Table) -> pa.Table:
    """Step 2's bucket: sorts its suffixes; 32 bits for each row of each part, one for each window."""
    if table.column("kind")[0].as_py() == 2:
        return _sorted_windows(table)
    counts = table.column("n").to_pylist()
    rows = _bytes(table.column("rows")).reshape(-1, _ROW)
    right, left = np.ascontiguousarray(rows[:, :SPAN]), np.ascontiguousarray(rows[:, SPAN : SPAN + LEFT])
    low, high = rows[:, SPAN + LEFT].astype(np.int64), rows[:, SPAN + LEFT + 1].astype(np.int64)
    ids = np.ascontiguousarray(rows[:, SPAN + LEFT + 2 :]).view("<i8").ravel()
    masks = least_ids(right, left, low, high, ids)
    parts = np.split(masks, np.cumsum(counts)[:-1])
    return _answered(table, 1, [p.astype("<u4").tobytes() for p in parts])


def _by_kind(answers: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    found = zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True)
    return sorted((b, a) for k, b, a in found if k == kind)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True, dense: int = DENSE, splits: int = SPLITTERS) -> DataFrame:
    """One row per document (RESULT); kept is what is left of its bytes, null unless with_kept.

    There are at most ``splits`` splitters, however many buckets; what lies between two
    of them is cut again by a hash of the leading bytes.
    """
    rows = id_text(docs, id_col, text_col)
    buckets = partitions(docs.sparkSession)
    ranges = min(buckets, splits)
    finer = -(-buckets // ranges)
    splitters, dense_splitters = sampled_splitters(rows, ranges)
    # rows without id are told apart by their place
    lot = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    place = F.pmod(F.xxhash64("id", F.octet_length("text"), lot), F.lit(2 * buckets)).cast("int")
    moved = rows.select(place.alias("part"), "id", F.coalesce("text", F.lit("")).alias("text")).repartition(buckets, "part")

    def hashes(table: pa.Table) -> pa.Table:
        part = Part(table)
        several = part.several()
        at = np.searchsorted(bucket_of(part.keys, buckets), np.arange(buckets + 1))
        found = np.flatnonzero(np.diff(at))
        low = np.ascontiguousarray(part.keys & _LOW40).view(np.uint8).reshape(-1, 8)[:, :5]
        spans = [(at[b], at[b + 1]) for b in found]
        number = table.column("part")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(found, pa.int32()),
                "part": pa.array([number] * len(found), pa.int32()),
                "n": pa.array([b - a for a, b in spans], pa.int32()),
                "hashes": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
                "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary()),
            }
        )

    common = moved.groupBy("part").applyInArrow(_tidied(hashes), _HASHES).groupBy("bucket").applyInArrow(_tidied(lambda table: _several_documents(table, dense)), _ANSWERS)

    def suffixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({n: pa.array([], t) for n, t in (("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()))})
        part = Part(table)
        part.share(_by_kind(answers, 0), buckets)
        order, bucket = part.dealt(splitters, finer)
        chosen = part.first[order]
        out = np.concatenate([part.right[chosen], part.left[chosen], part.low[chosen, None].astype(np.uint8), part.high[chosen, None].astype(np.uint8), np.ascontiguousarray(part.first_id[order]).view(np.uint8).reshape(-1, 8)], axis=1)
        w_order, w_bucket = part.dense_dealt(dense_splitters, finer)
        windows = np.concatenate([part.w_row[w_order], np.ascontiguousarray(part.w_first_id[w_order]).view(np.uint8).reshape(-1, 8)], axis=1)
        number, sent = table.column("part")[0].as_py(), {n: [] for n in ("bucket", "part", "kind", "n", "rows")}
        # buckets of suffixes at window starts come after those of suffixes at anchors
        for kind, rows, of in ((1, out, bucket), (2, windows, (len(splitters) + 1) * finer + w_bucket)):
            found, start = np.unique(of, return_index=True)
            for x, a, b in zip(found.tolist(), start, np.append(start[1:], len(of))[: len(start)], strict=True):
                for name, value in zip(sent, (x, number, kind, b - a, rows[a:b].tobytes()), strict=True):
                    sent[name].append(value)
        return pa.table({n: pa.array(v, pa.binary() if n == "rows" else pa.int32()) for n, v in sent.items()})

    sent = moved.groupBy("part").cogroup(common.groupBy("part")).applyInArrow(_tidied(suffixes), _SUFFIXES)
    marked = sent.groupBy("bucket").applyInArrow(_tidied(_sorted_suffixes), _ANSWERS)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [(x.split()[0], x.split()[1]) for x in RESULT.split(", ")]
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        if not len(table):
            return pa.table({n: pa.array([], kinds[k]) for n, k in names})
        part = Part(table)
        part.share(_by_kind(answers, 0), buckets)
        order, _ = part.dealt(splitters, finer)
        masks = np.zeros(len(part.first), np.uint32)
        given = b"".join(a for _, a in _by_kind(answers, 1))
        masks[order] = np.frombuffer(given, "<u4")
        # what agrees in all bytes with a smaller id of the same part goes whole
        whole = ((np.uint64(1) << (part.high + 1).astype(_U)) - (np.uint64(1) << part.low.astype(_U))).astype(np.uint32)
        own = np.where(part.own_id > part.first_id[part.group], whole, masks[part.group])
        bits = [np.unpackbits(np.frombuffer(a, np.uint8)) for _, a in _by_kind(answers, 2)]
        w_order, w_bucket = part.dense_dealt(dense_splitters, finer)
        sizes = np.unique(w_bucket, return_counts=True)[1]
        smaller = np.zeros(len(w_order), bool)
        smaller[w_order] = np.concatenate([b[:n] for b, n in zip(bits, sizes, strict=True)] or [np.zeros(0, np.uint8)]).astype(bool)
        w_gone = (part.w_id > part.w_first_id[part.w_group]) | smaller[part.w_group]
        w_slices = np.searchsorted(part.w_at[:, 0], np.arange(len(part.slices) + 1))
        out = {n: [] for n, _ in names}
        # bounds of the slices' anchors in part.of
        at = np.searchsorted(part.of[:, 0], np.arange(len(part.slices) + 1))
        ids = table.column("id").combine_chunks()
        for s, (i, j, a) in enumerate(part.slices):
            n = len(a.data)
            begins = np.zeros(n + 1, np.int64)
            places, bits = part.of[at[s] : at[s + 1], 1], own[at[s] : at[s + 1]]
            for o in range(LEFT + 1):
                begins[places[(bits >> np.uint32(o) & np.uint32(1)).astype(bool)] - o] = 1
            mine = slice(w_slices[s], w_slices[s + 1])
            begins[part.w_at[mine, 1][w_gone[mine]]] = 1
            upto = np.concatenate([[0], np.cumsum(begins[:n])])
            gone = upto[1:] > upto[np.maximum(np.arange(n) - SPAN + 1, 0)]
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            edge[a.offsets[:-1][a.offsets[:-1] < n]] |= gone[a.offsets[:-1][a.offsets[:-1] < n]]
            left = a.data[~gone]
            removed = np.concatenate([[0], np.cumsum(gone)])[a.offsets]
            spans = np.concatenate([[0], np.cumsum(edge)])[a.offsets]
            cuts = a.offsets - removed
            blob = left.tobytes()
            for d in range(j - i):
                own_bytes = blob[cuts[d] : cuts[d + 1]]
                out["kept_sha256"].append(hashlib.sha256(own_bytes).hexdigest())
                out["kept"].append(own_bytes if with_kept else None)
            out["n_bytes"] += np.diff(a.offsets).tolist()
            out["n_removed"] += np.diff(removed).tolist()
            out["n_spans"] += np.diff(spans).tolist()
        out["id"] = ids
        return pa.table({n: out[n] if n == "id" else pa.array(out[n], kinds[k]) for n, k in names})

    both = common.union(marked)
    return moved.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(_tidied(cut), RESULT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir), with_kept=False).drop("kept").withColumnRenamed("id", "doc_id")


#: All strings of SPAN bytes, those that start in a document of a smaller id, and the runs that they cover.
ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, s, h[s + 1 : s + 50] AS bytes FROM (SELECT doc_id, h, unnest(range(0, octet_length(h) - 49)) AS s FROM d)),
low AS (SELECT bytes, min(doc_id) AS least FROM w GROUP BY bytes HAVING count(*) > 1),
g AS (SELECT w.doc_id, s FROM w JOIN low USING (bytes) WHERE least < w.doc_id),
f AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50, true) AS fresh FROM g),
n AS (SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM f),
r AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM n GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM r),
c AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, hex(any_value(h)[1 : min(a)]) || string_agg(hex(h[b + 1 : coalesce(next, octet_length(h))]), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(kept), h)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES = {"op4_suffix_dedup": ORACLE}
