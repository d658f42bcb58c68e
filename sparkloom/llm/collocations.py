"""Phrase collocations by sorted n-grams of dictionary numbers.

1. Texts are lower-cased (A-Z) and cut into pieces and words.  A task writes them in
   chunks of 16-bit numbers of the chunk's own dictionary, 0 where a piece ends; a
   chunk holds at most LOCAL words and about TOKENS numbers.  A text that is longer
   goes on in the next chunk, which begins with the last words of the one before.
   A chunk is a row with its numbers and a row for each of its words, as Spark reads
   4096 rows at once, which must not hold as many dictionaries.
2. The dictionaries' counts are summed by (lang, word).  Words that occur ``least``
   times get numbers 1, 2, ...; all others break pieces, as a phrase cannot be more
   frequent than its words.  Chunks get the numbers of their own words by a join, so
   no task needs the whole dictionary, and go through tasks chunk by chunk.
3. From each frequent word on, up to five numbers are packed into one key of fixed
   width, big-endian and filled up with zeros, so the phrases that begin there are
   prefixes of one key.  A task sorts its keys by radix, counts equal ones and deals
   them to ranges by sampled splitters.  A range sorts what it gets by radix and takes
   the run lengths of all prefixes.  Only a range's first and last runs can go on in
   another range; these are sent whatever their length, and summed.
4. Cuts, scores and containment are joins over the frequent phrases.  A phrase that a
   longer one with its frequency contains is also contained in one that is longer by
   one word and has that frequency, so only those are looked at.

Defined cases: null text is empty; null lang is ``und``; null ids and repeated rows
count like others; a lang without candidates gives no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, durable, partitions, running_offsets, ship, sized, tidy

LEAST, LONGEST, TOP = 100, 5, 2000
LOCAL, TOKENS, SLICE = 65_535, 1 << 20, 1 << 19
#: Keys that a task sorts at once, and sampled keys for each range; ids for which there is a range at least.
KEYS, SAMPLE, SPLITTERS, RANGE = 1 << 20, 64, 1024, 1 << 21
_ID_BITS = 40
#: Rows that a task returns at once.
ROWS = 1 << 14
#: Of f occurrences of a phrase among n words, whose parts occur l and r times; decimals hold products past 64 bits.
SCORE = "(1000 * cast(f as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
#: A chunk's row has its ids and ``at`` -1; the others its words, by their numbers from 0.
CHUNKS = "chunk bigint, at int, tail int, size int, ids binary, lang string, word string, n bigint"
_FROM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\r" + b"\t"
_TO = b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" "
_CLEAN = bytes.maketrans(_FROM, _TO)


class _Local(dict):
    """Numbers from 1 on for words, in the order in which they come."""

    next = 1

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.next
        self.next += 1
        return number


def _slices(text: bytes, size: int) -> Iterator[bytes]:
    """text cut at spaces and ends of pieces into runs of about size bytes."""
    at, n = 0, len(text)
    while at < n:
        to = at + size
        if to < n:
            ends = [e for e in (text.find(b" ", to), text.find(b"\n", to)) if e >= 0]
            to = min(ends) + 1 if ends else n
        yield text[at:to]
        at = to


def squeezed(rows: np.ndarray) -> bytes:
    """Rows of numbers, compressed byte by byte of all rows: leading bytes hardly change, and the others are unlike each other."""
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T.tobytes()
    return pa.compress(data, codec="zstd", asbytes=True)


def opened(data: pa.Scalar, n: int, width: int) -> np.ndarray:
    """n rows of width bytes."""
    return np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n).T if n else np.zeros((0, width), np.uint8)


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values, without an object for each."""
    n, width = rows.shape
    ends = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


class Chunk:
    """A run of texts as numbers of its own dictionary."""

    def __init__(self):
        self.langs: dict[str, _Local] = {}
        self.names: list[tuple[str, bytes]] = []
        self.parts: list[np.ndarray] = []
        # ids in all, carried over from the chunk before, and of the text that is being added
        self.size, self.carried, self.of_text = 0, 0, 0

    def add(self, lang: str, words: list[bytes]) -> None:
        own = self.langs.get(lang)
        if own is None:
            own = self.langs[lang] = _Local()
            own.update({b"": -1, b"\n": 0})
        own.next, before = len(self.names) + 1, len(own)
        ids = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
        # new words are the last ones of the dictionary
        fresh = list(islice(reversed(own), len(own) - before))
        self.names += zip(repeat(lang), reversed(fresh))
        ids = ids[ids >= 0]
        self.parts.append(ids.astype(np.uint16))
        self.size += len(ids)
        self.of_text += len(ids)

    def ends(self, n: int) -> list[bytes]:
        """The last n words and ends of pieces."""
        if not n:
            return []
        ids = np.concatenate(self.parts)[-n:]
        return [self.names[i - 1][1] if i else b"\n" for i in ids.tolist()]

    def rows(self, number: int, tail: int) -> pa.RecordBatch:
        """The chunk (CHUNKS); words are counted where they aren't carried over."""
        ids, k = np.concatenate(self.parts), len(self.names)
        counts = np.bincount(ids[self.carried :], minlength=k + 1)[1:]
        own = [pa.array([tail], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([squeezed(ids.astype("<u2")[:, None])], pa.binary())]
        words = [pa.array([x for x, _ in self.names], pa.string()), pa.array([w for _, w in self.names], pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
        columns = [pa.array(np.full(k + 1, number)), pa.array(np.arange(-1, k, dtype=np.int32))]
        columns += [pa.concat_arrays([x, pa.nulls(k, x.type)]) for x in own] + [pa.concat_arrays([pa.nulls(1, x.type), x]) for x in words]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "at", "tail", "size", "ids", "lang", "word", "n"])


def encoded(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", local: int = LOCAL, tokens: int = TOKENS) -> DataFrame:
    """The texts in chunks (CHUNKS); ids are squeezed 16-bit numbers, of which k + 1 is the word at k."""
    if not 2 * LONGEST <= local <= LOCAL:
        raise ValueError(f"local lies between {2 * LONGEST} and {LOCAL}")
    ship(docs.sparkSession)
    # a slice of so many bytes holds fewer words
    size = min(SLICE, local)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                chunk.of_text = 0
                for part in _slices(text.as_buffer().to_pybytes().translate(_CLEAN), size):
                    words = part.replace(b"\n", b" \n ").split(b" ")
                    if chunk.size and (len(chunk.names) + min(len(words), size) > local or chunk.size > tokens):
                        tail = min(LONGEST - 1, chunk.of_text)
                        ends = chunk.ends(tail)
                        yield chunk.rows(number, tail)
                        number, chunk = number + 1, Chunk()
                        if tail:
                            chunk.add(lang, ends)
                            chunk.carried = tail
                    chunk.add(lang, words)
                chunk.add(lang, [b"\n"])
        if chunk.size:
            yield chunk.rows(number, 0)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, CHUNKS)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of bytes, by 16 bits at a time from the last; numpy sorts such digits by radix."""
    n, width = keys.shape
    order = None
    for end in range(width, 0, -2):
        digit = keys[:, end - 1].astype(np.uint16)
        if end > 1:
            digit |= keys[:, end - 2].astype(np.uint16) << np.uint16(8)
        if order is None:
            order = np.argsort(digit, kind="stable")
        else:
            order = order[np.argsort(digit[order], kind="stable")]
    return np.arange(n) if order is None else order


def packed(numbers: list[np.ndarray], width: int) -> np.ndarray:
    """Big-endian keys of ``width`` bytes for each number."""
    out = np.empty((len(numbers[0]), len(numbers) * width), np.uint8)
    for j, x in enumerate(numbers):
        out[:, j * width : (j + 1) * width] = x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return out


def windows(ids: np.ndarray, tail: int, width: int) -> np.ndarray:
    """Keys of the frequent words from which a phrase of two or more begins; ids are 0 where a piece is broken."""
    n = len(ids)
    some = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
    start = np.flatnonzero((some[: n - tail] > 0) & (some[1 : n - tail + 1] > 0)) if n > tail else np.zeros(0, np.int64)
    numbers = [some[start], some[start + 1]]
    for j in range(2, LONGEST):
        numbers.append(np.where(numbers[-1] > 0, some[start + j], 0))
    return packed(numbers, width)


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of n for each."""
    if not len(keys):
        return keys, n
    order = radix_order(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[first], np.add.reduceat(n, first)


def runs(keys: np.ndarray, n: np.ndarray, width: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, prefixes, counts) of sorted keys: runs of ``least`` at least, and the first and last ones."""
    differs = (keys[1:].reshape(-1, LONGEST, width) != keys[:-1].reshape(-1, LONGEST, width)).any(2)
    new = differs[:, 0]
    for m in range(2, LONGEST + 1):
        new = new | differs[:, m - 1]
        first = np.flatnonzero(np.concatenate([[True], new]))
        f = np.add.reduceat(n, first)
        keep = f >= least
        keep[[0, -1]] = True
        keep &= keys[first, (m - 1) * width : m * width].any(1)
        yield m, keys[first[keep], : m * width], f[keep]


def bucket_of(keys: np.ndarray, splitters: np.ndarray, finer: int) -> np.ndarray:
    """The range of each key, ascending with it.  With ``finer`` above 1, what lies between two splitters is cut evenly by its leading bytes."""
    size = keys.shape[1]
    coarse = np.searchsorted(splitters, np.ascontiguousarray(keys).view(f"S{size}").ravel(), "right")
    if finer == 1:
        return coarse

    def lead(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 8), np.uint8)
        out[:, : min(8, size)] = rows[:, :8]
        return out.view(">u8").ravel().astype(np.float64)

    ends = lead(np.frombuffer(splitters.tobytes(), np.uint8).reshape(-1, size)) if len(splitters) else np.zeros(0)
    low, high = np.concatenate([[0.0], ends])[coarse], np.concatenate([ends, [2.0**64]])[coarse]
    share = (lead(keys) - low) / np.maximum(high - low, 1.0)
    return coarse * finer + np.clip((share * finer).astype(np.int64), 0, finer - 1)


def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text", ranges: int | None = None, splits: int = SPLITTERS, local: int = LOCAL, tokens: int = TOKENS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(words: key, lang, word, f), (phrases: key, m, f), (langs: lang, n), and the bytes of a word in a key.

    words has the words and phrases the phrases of 2 to LONGEST words that occur ``least`` times or more.
    """
    spark = docs.sparkSession
    both = durable(encoded(docs, lang_col, text_col, local, tokens), "chunks", "zstd")
    chunks, listed = both.filter("at < 0").select("chunk", "tail", "size", "ids"), both.filter("at >= 0").select("chunk", "at", "lang", "word", "n")
    langs = durable(listed.groupBy("lang").agg(F.sum("n").alias("n")), "langs")
    frequent = listed.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    # frequent words get small numbers, which take less room when compressed
    frequent = durable(frequent.orderBy(F.desc("f")).select("lang", "word", "f", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "words")
    before = running_offsets(frequent.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "part", "rows").select("part", "before")
    # one row for each partition that wrote words
    words = frequent.join(F.broadcast(before), "part").select("lang", "word", "f", (F.col("before") + F.col("place") + 1).alias("id"))
    width = max(1, (frequent.count().bit_length() + 7) // 8)
    words = durable(words.withColumn("key", F.unhex(F.lpad(F.hex("id"), 2 * width, "0"))), "numbers")

    own_words = sized(words.select("lang", "word", "id"))

    def bound(part: Column) -> DataFrame:
        """Each chunk's row (number -1), and after it the numbers of its own words with their places."""
        none = {"tail": F.lit(None).cast("int"), "size": F.lit(None).cast("int"), "ids": F.lit(None).cast("binary")}
        numbers = listed.filter(part).join(own_words, ["lang", "word"]).select("chunk", (F.shiftleft(F.col("at").cast("bigint"), _ID_BITS) + F.col("id")).alias("number"), *(x.alias(c) for c, x in none.items()))
        own = chunks.filter(part).select("chunk", F.lit(-1).cast("bigint").alias("number"), *none)
        return own.unionByName(numbers).repartition("chunk").sortWithinPartitions("chunk", "number").drop("chunk")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        ids = None
        for batch in batches:
            number, tails, sizes, texts = batch.columns
            number = number.to_numpy()
            starts = np.flatnonzero(number < 0).tolist()
            for a, b in zip([0, *starts], [*starts, len(number)], strict=True):
                if a == b:
                    continue
                if number[a] < 0:
                    if ids is not None:
                        yield table[ids], tail
                    ids, tail = np.ascontiguousarray(opened(texts[a], sizes[a].as_py(), 2)).view("<u2").ravel(), tails[a].as_py()
                    table = np.zeros(LOCAL + 1, np.int64)
                    a += 1
                table[(number[a:b] >> _ID_BITS) + 1] = number[a:b] & ((1 << _ID_BITS) - 1)
        if ids is not None:
            yield table[ids], tail

    n_chunks, n_ids = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = ranges or max(2 * partitions(spark), n_ids // RANGE)
    coarse = min(wanted, splits)
    finer = -(-wanted // coarse)
    # SAMPLE keys for each range, from at least 32 chunks
    chosen = min(1.0, max(32, coarse // 4) / max(1, n_chunks))
    each_chunk = max(1, -(-SAMPLE * coarse // max(1, min(n_chunks, max(32, coarse // 4)))))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(5)
        for ids, tail in each(batches):
            keys = windows(ids, tail, width)
            some = keys[np.sort(rng.choice(len(keys), each_chunk, replace=False))] if len(keys) > each_chunk else keys
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in some], pa.binary())], ["key"])

    some = F.pmod(F.xxhash64("chunk", F.lit(3)), F.lit(1_000_000)) < int(chosen * 1_000_000)
    found = sorted(bound(some).mapInArrow(sampled, "key binary").toArrow().column("key").to_pylist())
    splitters = np.unique(np.array([found[len(found) * j // coarse] for j in range(1, coarse)] if found else [], f"S{LONGEST * width}"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(parts: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.concatenate(parts)
            keys, n = counted(keys, np.ones(len(keys), np.int64))
            bucket = bucket_of(keys, splitters, finer)
            found, start = np.unique(bucket, return_index=True)
            cuts = list(zip(start.tolist(), [*start[1:].tolist(), len(keys)], strict=True))
            rows = [squeezed(keys[a:b]) for a, b in cuts], [squeezed(n[a:b].astype("<u4")[:, None]) for a, b in cuts]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([b - a for a, b in cuts], pa.int32()), *(pa.array(x, pa.binary()) for x in rows)], ["bucket", "size", "keys", "n"])

        parts, held = [], 0
        for ids, tail in each(batches):
            keys = windows(ids, tail, width)
            if len(keys):
                parts.append(keys)
                held += len(keys)
            if held >= KEYS:
                yield sent(parts)
                parts, held = [], 0
                tidy()
        if held:
            yield sent(parts)
        tidy()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts = [], []
        for batch in batches:
            size = batch.column("size").to_pylist()
            parts += [opened(x, k, LONGEST * width) for x, k in zip(batch.column("keys"), size, strict=True)]
            counts += [np.ascontiguousarray(opened(x, k, 4)).view("<u4").ravel() for x, k in zip(batch.column("n"), size, strict=True)]
        keys, n = np.concatenate(parts), np.concatenate(counts).astype(np.int64)
        del parts, counts
        keys, n = counted(keys, n)
        for m, prefix, f in runs(keys, n, width, least):
            for at in range(0, len(f), ROWS):
                some = f[at : at + ROWS]
                key = binaries(prefix[at : at + ROWS])
                yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(some), m, np.int32)), pa.array(some)], ["key", "m", "f"])
        tidy()

    found = bound(F.lit(True)).mapInArrow(dealt, "bucket int, size int, keys binary, n binary").groupBy("bucket").applyInArrow(summed, "key binary, m int, f bigint")
    phrases = durable(found.groupBy("key", "m").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases")
    return words.select("key", "lang", "word", "f"), phrases, langs, width


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", **how: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, words, cut): the ``top`` phrases of each language; ``cut`` words form the first part."""
    words, phrases, langs, width = phrase_counts(docs, least, lang_col, text_col, **how)
    part = lambda first, n: F.substring("key", first * width + 1, n * width)

    def part_at(first: Column, n: Column) -> Column:
        return F.col("key").substr(first * width + 1, n * width)

    longer = phrases.filter("m > 2").select(F.explode(F.array(part_at(F.lit(0), F.col("m") - 1), part_at(F.lit(1), F.col("m") - 1))).alias("key"), "f")
    kept = phrases.join(longer, ["key", "f"], "left_anti")
    known = words.select("key", "f").union(phrases.select("key", "f"))
    known = durable(known, "known")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumns({"left": part_at(F.lit(0), F.col("cut")), "right": part_at(F.col("cut"), F.col("m") - F.col("cut"))})
    cuts = cuts.join(sized(known.select(F.col("key").alias("left"), F.col("f").alias("l"))), "left").join(sized(known.select(F.col("key").alias("right"), F.col("f").alias("r"))), "right")
    first = words.select(F.col("key").alias("first"), "lang").join(sized(langs), "lang")
    cuts = cuts.withColumn("first", part(0, 1)).join(sized(durable(first, "first")), "first")
    best = cuts.groupBy("lang", "key", "m", F.col("f").alias("a"), "n").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "cut", "l", "r")).alias("best"))
    best = best.select("lang", "key", "m", "a", "n", "best.*")
    order = [F.desc("score"), F.desc("a")]
    # rank keeps ties, which are told apart by their words
    best = durable(best.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).drop("rank"), "best")
    spelled = best.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: part_at(i, F.lit(1)))).alias("at", "one"))
    spelled = spelled.join(sized(words.select(F.col("key").alias("one"), "word")), "one").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    out = best.join(spelled, "key").withColumn("phrase", F.array_join(F.col("spelled.word"), " "))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("spelled.word").alias("words"), F.col("cut").cast("bigint").alias("cut"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: All phrases of frequent words by their places; a word that isn't frequent can't be in one.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, d, unnest(pieces) AS piece, unnest(range(len(pieces))) AS p FROM (SELECT lang, d, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS pieces FROM d)),
w AS (SELECT lang, d, p, unnest(words) AS word, unnest(range(len(words))) AS i FROM (SELECT lang, d, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
ones AS (SELECT lang, word, count(*) AS f FROM w GROUP BY lang, word HAVING count(*) >= {LEAST}),
x AS MATERIALIZED (SELECT w.* FROM w JOIN ones USING (lang, word)),
r AS (SELECT lang, word, {", ".join(f"lead(word, {k}) OVER o AS w{k}, lead(i, {k}) OVER o - i AS g{k}" for k in range(1, LONGEST))}
      FROM x WINDOW o AS (PARTITION BY lang, d, p ORDER BY i)),
s AS ({" UNION ALL ".join(f"SELECT lang, [word, {', '.join(f'w{k}' for k in range(1, m))}] AS ws FROM r WHERE g{m - 1} = {m - 1}" for m in range(2, LONGEST + 1))}),
f AS MATERIALIZED (SELECT lang, ws, count(*) AS f FROM s GROUP BY lang, ws HAVING count(*) >= {LEAST}),
k AS (SELECT lang, [word] AS ws, f FROM ones UNION ALL SELECT lang, ws, f FROM f),
longer AS (SELECT lang, ws[:-2] AS ws, f FROM f UNION SELECT lang, ws[2:], f FROM f),
kept AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = f.lang AND longer.ws = f.ws AND longer.f = f.f)),
c AS (SELECT lang, ws, f, unnest(range(1, len(ws))) AS cut FROM kept),
v AS (SELECT c.lang, c.ws, c.f AS a, c.cut, kl.f AS l, kr.f AS r, n.n, (1000::HUGEINT * c.f * n.n) // (kl.f::HUGEINT * kr.f) AS score
      FROM c JOIN k kl ON kl.lang = c.lang AND kl.ws = c.ws[:c.cut] JOIN k kr ON kr.lang = c.lang AND kr.ws = c.ws[c.cut + 1:] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM b QUALIFY rank <= {TOP}
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": ORACLE}
