"""Jaccard join on word n-grams: groups of documents linked by the share of shingles they have in common.

1. One pass over the texts gives each document's number of distinct shingles
   and a 128-bit signature of the set; documents with equal sets form a class,
   and from here on a class counts once.  The same pass counts shingles in a
   table of fixed size (COUNTERS), which is the order of rarity; it is a function
   of the shingle, so every document orders its shingles alike.
2. A second pass emits each class's prefix: its n - ceil(t n) + 1 rarest
   shingles.  Two sets with Jaccard >= t share one that is, in the smaller set,
   among the first n - ceil(2t/(1+t) n) + 1.  Postings are shuffled by shingle
   and sorted by length; those without a neighbour of fitting length go.
   Shingles far more frequent than the mean of the table are dealt out over
   several partitions.
3. Candidate pairs pass the length, index-prefix, positional and suffix filters of
   the list they come from, are made distinct, and are verified once.  The suffix
   filter: both sets are cut at fixed pivots of the hash range into parts, and at
   least as many shingles differ as parts whose sizes differ in parity.  Lists
   carry the parity of BRIEF parts, and pairs of the last step get four to eight
   parts for each shingle before they are merged.
4. Only reachability is asked for, so pairs that links have joined already aren't
   candidates.  In each of STARS rounds every document tries the centre that most
   of its lists propose, the first of a list's CENTRES that passes the filters.
   After that each list gives all of its pairs of unlike labels; of the pairs
   between two labels one is verified first, the others if it fails.  A list of
   more than LIST documents is compared in blocks, and blocks of one label aren't
   compared with each other, so a group of near copies gives no square of rows
   and no link is lost.

Defined cases: null text is empty; empty sets have no links, each its own
component; a document's id may be null (it can link others, and its component
is null if no member has an id); rows that repeat an id are one document and so
linked; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, durable, id_text, partitions, sized, tidy
from sparkloom.llm.components import components
from sparkloom.llm.shingles import mix, shingle_sets, signature

COUNTERS = 1 << 20
SLICES = 64
FREQUENT = 20_000
#: Rounds of stars, and one in how many lists (by hash) takes part in them, besides those of a set's first shingles.
STARS, SAMPLED, FIRST, CENTRES = 1, 4, 4, 8
#: Parts whose parity goes with each posting of a list that has unlike labels.
BRIEF = 1024
#: Documents of a list that are compared in one piece, and lists short enough to be compared many at a time.
LIST, SHORT = 2048, 64
#: Signatures that a task remembers, so that it emits the postings of equal sets once.
SEEN = 1 << 18
_SHIFT = np.uint64(64 - (COUNTERS.bit_length() - 1))
_U = np.uint64


def prefix_lengths(n: int, num: int, den: int) -> tuple[int, int]:
    """(probing, indexing) prefix length of a set of n for the threshold num / den."""
    return n + 1 + (-num * n // den), n + 1 + (-2 * num * n // (num + den))


def needed(n: int, m: int, num: int, den: int) -> int:
    """The overlap from which sets of n and m reach the threshold."""
    return -(-num * (n + m) // (num + den))


def measured(rows: DataFrame, k: int) -> DataFrame:
    """(id, t, u, n, c, d, slice, counts) of rows (id, text, t, u): c and d are the set's signature; rows with a slice hold counts of shingles instead."""

    names = ["id", "t", "u", "n", "c", "d", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for i, sets in shingle_sets(batch.column(1), k):
                n = np.array([len(s) for s in sets], np.int32)
                pairs = np.frombuffer(b"".join(signature(s) for s in sets), np.int64).reshape(-1, 2)
                if n.sum():
                    np.add.at(counts, (np.concatenate(sets) >> _SHIFT).astype(np.int64), np.uint32(1))
                m = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(i, m) for x in (0, 2, 3)), pa.array(n), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    names,
                )
        none = pa.nulls(SLICES, pa.int64())
        # the narrowest integers that hold a slice's counts
        blobs = [x.astype(np.min_scalar_type(x.max())).tobytes() for x in np.split(counts, SLICES)]
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(SLICES, pa.int32()), none, none, pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names)
        tidy()

    return durable(rows.mapInArrow(run, "id bigint, t bigint, u bigint, n int, c bigint, d bigint, slice int, counts binary"), "measured")


def rarity(seen: DataFrame) -> np.ndarray:
    """The COUNTERS sums over all partitions; they are of a fixed size, so the driver can hold and send them."""
    own = COUNTERS // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(counts, f"u{len(counts) // own}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    parts = seen.filter("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect()
    out = np.zeros(COUNTERS, np.int32)
    for s, counts in parts:
        out[s * own : (s + 1) * own] = np.frombuffer(counts, np.int32)
    return out


def postings(rows: DataFrame, k: int, num: int, den: int, sent, frequent: int = FREQUENT) -> DataFrame:
    """(h, salt, c, n, pos) for each prefix shingle of each class, at least once; sent is the broadcast table of rarity.

    A counter holds many shingles, so it is what it has beyond the table's mean
    that tells of a frequent one, at any size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sent.value, set()
        usual = int(counts.mean())
        for batch in batches:
            for _, sets in shingle_sets(batch.column(1), k):
                hs, fs, cs, ns, ps = [], [], [], [], []
                for own in sets:
                    n = len(own)
                    if not n or (sig := signature(own)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sig)
                    often = counts[(own >> _SHIFT).astype(np.int64)]
                    p = prefix_lengths(n, num, den)[0]
                    first = np.lexsort((own, often))[:p]
                    hs.append(own[first])
                    fs.append(often[first])
                    cs.append(np.full(p, np.frombuffer(sig, np.int64)[0]))
                    ns.append(np.full(p, n, np.int32))
                    ps.append(np.arange(p, dtype=np.int32))
                if hs:
                    h, f, c = np.concatenate(hs).view(np.int64), np.concatenate(fs).astype(np.int64) - usual, np.concatenate(cs)
                    salt = np.where(f > frequent, 1 + (c.view(_U) % np.maximum(1, f // frequent).astype(_U)).astype(np.int32), 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt), pa.array(c), pa.array(np.concatenate(ns)), pa.array(np.concatenate(ps))], ["h", "salt", "c", "n", "pos"])
        seen.clear()
        tidy()

    return rows.mapInArrow(run, "h bigint, salt int, c bigint, n int, pos int")


def shared(posted: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct postings that have another of fitting length in their list; all of frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "salt", "c", "n", "pos"]
        held = None  # the last posting and whether the one before it fits
        held_fits = False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(x).to_numpy() for x in names]
            fits = np.zeros(len(cols[0]) + (held is not None), bool)
            if held is not None:
                cols = [np.concatenate([a[None], b]) for a, b in zip(held, cols, strict=True)]
                fits[0] = held_fits
            h, salt, c, n, _ = cols
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
            cols, fits = [x[fresh] for x in cols], fits[fresh]
            h, salt, c, n, _ = cols
            near = (h[1:] == h[:-1]) & (n[:-1].astype(np.int64) * den >= n[1:].astype(np.int64) * num)
            fits[1:] |= near
            fits[:-1] |= near
            fits |= salt > 0
            held, held_fits = [x[-1] for x in cols], bool(fits[-1])
            keep = fits.copy()
            keep[-1] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], names)
        if held is not None and held_fits:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x])) for x in held], names)

    ordered = posted.repartition(partitions(posted.sparkSession), "h", "salt").sortWithinPartitions("h", "n", "c")
    return ordered.mapInArrow(run, "h bigint, salt int, c bigint, n int, pos int")


def part_bits(own: np.ndarray) -> bytes:
    """The suffix filter's summary of a set: for each part of the hash range whether its size is odd; four to eight parts for each shingle."""
    parts = max(64, 1 << (4 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & _U(parts - 1)).astype(np.int64), minlength=parts).astype(np.uint8) & 1, bitorder="little").tobytes()


def brief(own: np.ndarray) -> bytes:
    """The same for BRIEF parts, whatever the size."""
    return np.packbits(np.bincount((own & _U(BRIEF - 1)).astype(np.int64), minlength=BRIEF).astype(np.uint8) & 1, bitorder="little").tobytes()


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a binary column without nulls."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), at


def may_reach(n: np.ndarray, m: np.ndarray, a: pa.Array, b: pa.Array, num: int, den: int) -> np.ndarray:
    """The suffix filter for pairs of sets of n and m shingles: the parts that differ bound the overlap from above."""
    (a, at), (b, bt) = _bytes_of(a), _bytes_of(b)
    wide, narrow = np.diff(at), np.diff(bt)
    differ = np.zeros(len(n), np.int64)
    kinds = wide * (1 << 32) + narrow
    for kind in np.unique(kinds).tolist():
        rows, (x, y) = np.flatnonzero(kinds == kind), divmod(kind, 1 << 32)
        step = max(1, (1 << 23) // max(x, y))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            p, q = a[at[some][:, None] + np.arange(x)], b[bt[some][:, None] + np.arange(y)]
            # the finer parts of the larger set are put together: parity adds up
            while p.shape[1] > q.shape[1]:
                p = p[:, : p.shape[1] // 2] ^ p[:, p.shape[1] // 2 :]
            while q.shape[1] > p.shape[1]:
                q = q[:, : q.shape[1] // 2] ^ q[:, q.shape[1] // 2 :]
            differ[some] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
    return (n + m - differ) * (num + den) >= 2 * num * (n + m)


def overlap_reaches(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether sorted sets share at least ``least`` values."""
    if least > min(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= least


def likely(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y, ...) that pass the suffix filter."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_x", "n_y"))
                yield batch.select(names).filter(pa.array(may_reach(n, m, batch.column("bits_x"), batch.column("bits_y"), num, den)))

    own = sets.select("node", "n", "bits")
    full = pairs.join(own.toDF("x", "n_x", "bits_x"), "x").join(own.toDF("y", "n_y", "bits_y"), "y")
    return full.select(*names, "n_x", "n_y", "bits_x", "bits_y").mapInArrow(run, pairs.schema)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones (u, v) of distinct pairs (x, y), which durable() has written: the sets are compared in full.

    The set of x moves once for each pair, that of y once at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
                out.append(overlap_reaches(a, b, needed(len(a), len(b), num, den)))
            yield batch.select([0, 1]).filter(pa.array(out, pa.bool_())).rename_columns(["u", "v"])
        tidy()

    own = sets.select("node", "grams")
    some = sized(pairs)
    x = own.toDF("x", "of_x").join(some, "x")
    y = own.toDF("y", "of_y").join(some.select("y").distinct() if some is pairs else F.broadcast(pairs.select("y").distinct()), "y", "left_semi")
    return x.join(y, "y").select("x", "y", "of_x", "of_y").mapInArrow(run, "u bigint, v bigint")


def _unlike(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of rows i, j of one list have unlike labels and pass the length, index-prefix, positional and suffix filters."""
    n, m, p, q = c["n"][i], c["n"][j], c["pos"][i], c["pos"][j]
    ok = (c["label"][i] != c["label"][j]) & (n * den >= m * num) & (m * den >= n * num)
    ok &= np.where(n <= m, c["indexed"][i], False) | np.where(m <= n, c["indexed"][j], False)
    ok &= (np.minimum(p, q) + 1 + np.minimum(n - 1 - p, m - 1 - q)) * (num + den) >= num * (n + m)
    left = np.flatnonzero(ok)
    for k in range(0, len(left), 1 << 16):
        some = left[k : k + (1 << 16)]
        differ = np.bitwise_count(c["brief"][i[some]] ^ c["brief"][j[some]]).sum(1, dtype=np.int64)
        both = n[some] + m[some]
        ok[some] = (both - differ) * (num + den) >= 2 * num * both
    return ok


def centres_of_lists(c: dict[str, np.ndarray], num: int, den: int, star: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of documents and of the first of their list's CENTRES that they could link with.

    Centres of the first round are the documents with the fewest rarer shingles
    than the list's, which are the likest to all others; then any.
    """
    by = c["pos"] / c["n"] if star == 0 else mix(c["node"].view(_U) + _U(star))
    fresh = np.ones(len(c["h"]), bool)
    fresh[1:] = (c["h"][1:] != c["h"][:-1]) | (c["piece"][1:] != c["piece"][:-1])
    run = np.cumsum(fresh) - 1
    order = np.lexsort((c["node"], by, run))
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(run)))
    left, x, y = np.arange(len(run)), [], []
    for turn in range(CENTRES):
        left = left[size[run[left]] > turn]
        j = order[first[run[left]] + turn]
        ok = _unlike(c, left, j, num, den)
        x.append(left[ok])
        y.append(j[ok])
        left = left[~ok]
    return np.concatenate(x), np.concatenate(y)


def pairs_of_lists(c: dict[str, np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the candidate pairs of whole pieces of lists, which are runs of equal h and piece.

    Rows of side 0 are compared with each other, those of sides 1 and 2 across.
    """
    fresh = np.ones(len(c["h"]), bool)
    fresh[1:] = (c["h"][1:] != c["h"][:-1]) | (c["piece"][1:] != c["piece"][:-1])
    run, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(run)))
    short = np.flatnonzero((size[run] <= SHORT) & (c["side"] == 0))
    for d in range(1, min(SHORT, int(size.max(initial=0)))):
        i, j = short[:-d], short[d:]
        same = run[i] == run[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        ok = _unlike(c, i, j, num, den)
        yield i[ok], j[ok]
    for r in np.flatnonzero((size > SHORT) | (c["side"][first] > 0)).tolist():
        rows = np.arange(first[r], first[r] + size[r])
        side, label = c["side"][rows], c["label"][rows]
        if side[0]:
            left, right, after = rows[side == 1], rows[side == 2], False
        else:
            # no pair lies among the rows of the most frequent label, so these come last and only on the right
            names, number = np.unique(label, return_inverse=True)
            most = np.bincount(number).argmax() if len(names) else 0
            rows = np.concatenate([rows[number != most], rows[number == most]])
            left, right, after = rows[: int((number != most).sum())], rows, True
        step = max(1, (1 << 20) // max(1, len(right)))
        for k in range(0, len(left), step):
            i, j = np.meshgrid(np.arange(k, min(k + step, len(left))), np.arange(len(right)), indexing="ij")
            i, j = i.ravel(), j.ravel()
            if after:
                i, j = i[j > i], j[j > i]
            i, j = left[i], right[j]
            ok = _unlike(c, i, j, num, den)
            yield i[ok], j[ok]


_ROWS = ["h", "node", "label", "n", "pos", "indexed"]


def mixed(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of the lists that have unlike labels: with their document's label, and the list's size.

    A list's size comes from one row for each of its salts and goes back to the
    rows by list and salt, so a frequent shingle's list never meets in one task.
    """
    if labels is None:
        marked = lists.withColumn("label", F.col("node"))
    else:
        marked = lists.join(sized(labels).toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = marked.groupBy("h", "salt").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("h")
    sizes = own.select("h", "salt", F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high"), F.sum("size").over(whole).alias("size"))
    return durable(marked.join(sizes.filter("low < high").select("h", "salt", "size"), ["h", "salt"]).select(*_ROWS, "size"), "mixed-lists")


def _in_lists(pieces: DataFrame, sets: DataFrame, find, schema: str) -> DataFrame:
    """What find gives for runs of whole pieces (h, piece) of lists, whose rows get the brief of their set."""
    names = [*_ROWS, "piece", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            c |= {k: c[k].astype(np.int64) for k in ("n", "pos")}
            data, at = _bytes_of(batch.column("brief"))
            c["brief"] = data[at[0] : at[-1]].view(_U).reshape(len(batch), -1)
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in c}
            # the last piece may go on in the next batch
            last = int(np.flatnonzero((c["h"] != c["h"][-1]) | (c["piece"] != c["piece"][-1])).max(initial=-1)) + 1
            yield from find({k: v[:last] for k, v in c.items()})
            held = {k: v[last:] for k, v in c.items()}
        if held is not None:
            yield from find(held)
        held = c = None
        tidy()

    wide = pieces.join(sets.select("node", "brief"), "node").select(*names, "brief")
    return wide.repartition(partitions(pieces.sparkSession), "h", "piece").sortWithinPartitions("h", "piece").mapInArrow(run, schema)


def proposed(rows: DataFrame, sets: DataFrame, star: int, num: int, den: int) -> DataFrame:
    """(x, y): each document of mixed() rows with the centre that most of its lists propose."""

    def find(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(c["h"]):
            i, j = centres_of_lists(c, num, den, star)
            yield pa.RecordBatch.from_arrays([pa.array(c["node"][i]), pa.array(c["node"][j])], ["x", "y"])

    some = rows.filter(f"pos < {FIRST} or pmod(h, {SAMPLED}) = 0")
    pieces = some.select(*_ROWS, F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / LIST)).alias("piece"), F.lit(0).alias("side"))
    votes = _in_lists(pieces, sets, find, "x bigint, y bigint").groupBy("x", "y").agg(F.count(F.lit(1)).alias("lists"))
    return votes.groupBy("x").agg(F.max(F.struct("lists", "y")).getField("y").alias("y"))


def contenders(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, of_x, of_y), x < y: the distinct candidate pairs of mixed() rows, of unlike labels of_x and of_y."""
    pieces = rows.filter(f"size <= {LIST}").select(*_ROWS, F.lit(0).cast("bigint").alias("piece"), F.lit(0).alias("side"))
    long = rows.filter(f"size > {LIST}")
    if long.limit(1).count():
        parts = long.groupBy("h", "label").agg(F.count(F.lit(1)).alias("own"))
        # a label with many documents has blocks of its own, the others share blocks
        parts = parts.withColumn("kind", F.when(F.col("own") >= LIST // 2, F.col("label")).otherwise(F.lit(-1)))
        blocks = durable(parts.groupBy("h", "kind").agg(F.ceil(F.sum("own") * 2 / LIST).alias("blocks")), "blocks")
        kinds = parts.filter("kind >= 0").select("h", "label", "kind")
        placed = long.join(kinds, ["h", "label"], "left").withColumn("kind", F.coalesce("kind", F.lit(-1))).join(blocks, ["h", "kind"])
        placed = durable(placed.select(*_ROWS, "kind", F.pmod(F.xxhash64("node"), "blocks").alias("block")), "long-lists")
        each = blocks.select("h", "kind", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
        a, b = each.toDF("h", "kind", "block"), each.toDF("h", "other", "other_block")
        units = a.join(b, "h").filter("(kind, block) <= (other, other_block) and (kind <> other or kind < 0)")
        units = durable(units.withColumn("piece", F.xxhash64("kind", "block", "other", "other_block")), "pieces")
        alone = F.expr("kind = other and block = other_block")
        first = placed.join(units.withColumn("side", F.when(alone, 0).otherwise(1)).drop("other", "other_block"), ["h", "kind", "block"])
        second = placed.join(units.filter(~alone).select("h", F.col("other").alias("kind"), F.col("other_block").alias("block"), "piece", F.lit(2).alias("side")), ["h", "kind", "block"])
        pieces = pieces.union(first.select(*_ROWS, "piece", "side")).union(second.select(*_ROWS, "piece", "side"))

    def find(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, j in pairs_of_lists(c, num, den):
            if len(i):
                swap = c["node"][i] > c["node"][j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                found = np.unique(np.stack([c["node"][i], c["node"][j], c["label"][i], c["label"][j]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k].copy()) for k in range(4)], ["x", "y", "of_x", "of_y"])

    return _in_lists(pieces, sets, find, "x bigint, y bigint, of_x bigint, of_y bigint").distinct()


def _sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, bits, brief, grams) of the wanted classes (id, c, d, node)."""

    def found(named: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, sets in shingle_sets(batch.column("text"), k):
                    out = []
                    for j, own in enumerate(sets):
                        c, d = np.frombuffer(signature(own), np.int64).tolist()
                        # an id can stand for several texts
                        if len(own) and (not named or (c, d) == (batch.column("c")[i + j].as_py(), batch.column("d")[i + j].as_py())):
                            out.append((batch.column("node")[i + j].as_py() if named else c, d, len(own), part_bits(own), brief(own), own.tobytes()))
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], ["node", "d", "n", "bits", "brief", "grams"])
            tidy()

        return run

    schema = "node bigint, d bigint, n int, bits binary, brief binary, grams binary"
    some = rows.join(sized(durable(wanted.filter("id is not null"), "wanted")), "id").select("text", "c", "d", "node")
    out = some.mapInArrow(found(True), schema).drop("d")
    nameless = wanted.filter("id is null").select("c", "d", "node")
    if nameless.limit(1).count():
        own = rows.filter("id is null").mapInArrow(found(False), schema).withColumnRenamed("node", "c")
        own = own.groupBy("c", "d").agg(*(F.first(x).alias(x) for x in ("n", "bits", "brief", "grams")))
        out = out.union(own.join(nameless, ["c", "d"]).select("node", "n", "bits", "brief", "grams"))
    return durable(out, "sets")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _links(lists: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): linked pairs, enough to connect whatever is connected by links."""
    labels, tried, links = None, None, None
    for star in range(STARS):
        pairs = proposed(mixed(lists, labels), sets, star, num, den)
        if tried is not None:
            pairs = pairs.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(tried.toDF("a", "b"), ["a", "b"], "left_anti").select("x", "y")
        # two documents can propose each other
        pairs = durable(pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min(F.struct("x", "y")).alias("p")).select("p.x", "p.y"), "pairs")
        tried = _both_ways(pairs) if tried is None else tried.union(_both_ways(pairs))
        found = durable(verified(pairs, sets, num, den), "links")
        links = found if links is None else links.union(found)
        labels = components(links)
    pairs = contenders(mixed(lists, labels), sets, num, den).join(tried, ["x", "y"], "left_anti")
    left = durable(likely(pairs, sets, num, den), "contenders")
    # one of each two labels' pairs first: if it is linked, the others tell nothing new
    ends = [F.least("of_x", "of_y"), F.greatest("of_x", "of_y")]
    one = durable(left.groupBy(*ends).agg(F.min(F.struct("x", "y")).alias("p")).select("p.x", "p.y"), "one-each")
    found = durable(verified(one, sets, num, den), "links")
    links = links.union(found)
    labels = sized(components(links))
    rest = left.join(one, ["x", "y"], "left_anti").select("x", "y")
    for c in ("x", "y"):
        rest = rest.join(labels.toDF(c, f"of_{c}"), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    rest = durable(rest.filter("of_x <> of_y").select("x", "y"), "rest")
    return links.union(durable(verified(rest, sets, num, den), "links"))


def joined(docs: DataFrame, k: int, threshold: tuple[int, int], id_col: str, text_col: str, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row (id, t, u, n, c, d; t and u are hashes of the text), the classes of equal sets (c, d, id, n, node), and verified links (u, v) between their nodes."""
    num, den = threshold
    rows = id_text(docs, id_col, text_col)
    seen = measured(rows.withColumns({"t": F.xxhash64("text"), "u": F.xxhash64("text", F.lit(1))}), k)
    sent = docs.sparkSession.sparkContext.broadcast(rarity(seen))
    placed = seen.filter("slice is null").select("id", "t", "u", "n", "c", "d")
    classes = placed.filter("n > 0").groupBy("c", "d").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    # numbered in the order of ids, so a component's smallest node has its smallest id
    by_id = F.asc_nulls_last("id")
    classes = classes.repartitionByRange(partitions(docs.sparkSession), by_id).sortWithinPartitions(by_id)
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    indexing = f"n + 1 - cast(ceil({2 * num} * cast(n as bigint) / {num + den}) as int)"
    lists = shared(postings(rows, k, num, den, sent, frequent), num, den).join(sized(classes.select("c", "n", "node")), ["c", "n"])
    lists = durable(lists.select("h", "salt", "node", F.col("n").cast("bigint").alias("n"), "pos", F.expr(f"pos < {indexing}").alias("indexed")), "lists")
    sent.destroy()
    sets = _sets(rows, classes.join(lists.select("node").distinct(), "node", "left_semi").select("id", "c", "d", "node"), k)
    links = _links(lists, sets, num, den)
    # ids that stand for several sets tie them together
    named = placed.filter("id is not null and n > 0").join(sized(classes.select("c", "d", "node")), ["c", "d"]).select("id", "node")
    ties = named.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u < v").select("id", "u")
    return placed, classes, links.union(named.join(ties, "id").filter("node <> u").select("u", F.col("node").alias("v")))


def _components(docs: DataFrame, k: int, threshold: tuple[int, int], id_col: str, text_col: str, frequent: int = FREQUENT) -> DataFrame:
    """(id, t, u, n, group, component) of every row: the number of its component and the smallest id in it; no group without shingles."""
    placed, classes, found = joined(docs, k, threshold, id_col, text_col, frequent)
    labels = components(found)
    tops = sized(durable(labels.join(classes.select(F.col("node").alias("label"), F.col("id").alias("least")), "label"), "least-ids"))
    own = classes.select("c", "d", F.col("id").alias("own"), "node").join(tops, "node", "left")
    own = own.select("c", "d", F.coalesce("label", "node").alias("group"), F.when(F.col("label").isNull(), F.col("own")).otherwise(F.col("least")).alias("component"))
    out = placed.join(sized(durable(own, "components-of-classes")), ["c", "d"], "left")
    return out.select("id", "t", "u", "n", "group", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component"))


def groups(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs; linked when Jaccard >= threshold (a fraction)."""
    out = _components(docs, k, threshold, id_col, text_col, frequent)
    return out.select("id", F.col("n").cast("bigint").alias("n_shingles"), F.col("component").alias("component_id"))


def links(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, linked_id): verified links between the smallest ids of classes of equal sets, enough to connect every component; not all there are."""
    _, classes, found = joined(docs, k, threshold, id_col, text_col)
    ids = sized(classes.select("node", "id"))
    found = found.join(ids.toDF("u", "id"), "u").join(ids.toDF("v", "linked_id"), "v").filter("id <> linked_id")
    return found.select(F.least("id", "linked_id").alias("id"), F.greatest("id", "linked_id").alias("linked_id")).distinct()


def apply(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id (of several, or without ids, that of the smallest hash of its text); rows without shingles stay."""
    found = durable(_components(docs, k, threshold, id_col, text_col).filter("n > 0"), "rows-of-groups")
    row = [F.col("id").isNull().alias("none"), "id", "t", "u"]
    best = found.groupBy("group").agg(F.min(F.struct(*row)).alias("best"))
    several = found.groupBy("group").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("group")
    some = found.join(sized(durable(several, "several")), "group", "left_semi").join(best, "group")
    some = durable(some.select(*(F.col(c).alias(f"__{c}") for c in ("id", "t", "u")), (F.struct(*row) == F.col("best")).alias("__best")), "near-copies")
    text = F.col(text_col).cast("string")
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__t")) & (F.xxhash64(text, F.lit(1)) == F.col("__u"))
    out = docs.join(sized(durable(some.filter("not __best").drop("__best").distinct(), "gone")), same, "left_anti")
    # rows that repeat the one that stays
    again = some.filter("__best").groupBy("__id", "__t", "__u").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    again = durable(again, "repeated")
    if again.count():
        once = out.join(sized(again), same, "left_semi").withColumn("__text", text).dropDuplicates([id_col, "__text"]).drop("__text")
        out = out.join(sized(again), same, "left_anti").union(once)
    return out


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir), 4, (85, 100)).withColumnRenamed("id", "doc_id")


#: All pairs that share a shingle, and what can be reached over those that link.
ORACLE = r"""
WITH RECURSIVE
t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS grams FROM t WHERE len(w) > 0),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(len(s.grams), 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN s USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
ORACLES = {"op1_ngram_jaccard": ORACLE}
