"""Licences, mixing, fingerprints, sharding and toxicity against brute force."""

import random
import re
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import licenses, mixing, order_minhash, sharding, toxicity

from .conftest import odd_rows


def norms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.sub(r"[^a-z0-9\n]+", " ", low)


def clean(x):
    return re.sub(r"[ \n]+", " ", x).strip(" ")


def brute_units(text, templates):
    """(dice, name) of the units that match."""
    norm = norms(text)
    units = {clean(norm), *(clean(p) for p in re.split(r"\n *(?:\n *)+", norm)), *(x.strip(" ") for x in norm.split("\n"))}
    grams = [(n, licenses.bigrams_of(x)) for n, x in templates]
    found = {}
    for u in units:
        own = licenses.bigrams_of(u)
        best = max(((2 * len(own & g) / (len(own) + len(g)), n) for n, g in grams), key=lambda s: (s[0], [-ord(c) for c in s[1]]))
        if own and best[0] >= licenses.THRESHOLD:
            found[u] = best
    return found


def summary(found):
    if not found:
        return None, 0.0, "", 0
    top = max(s for s, *_ in found)
    return min(n for s, n, *_ in found if s == top), top, ",".join(sorted({n for _, n, *_ in found})), len(found)


def brute_scan(text):
    return summary(list(brute_units(text, licenses.TEMPLATES).values()))


def brute_query(text, templates=licenses.TEMPLATES + licenses.TEXTS):
    """Units and windows of a whole document by loops."""
    found = brute_units(text, templates)
    norm = norms(text)
    out = {(d, n, u) for u, (d, n) in found.items()}
    if not any(g in f" {clean(norm)} " for n, t in templates for g in (f" {x} " for x in licenses.telling_bigrams(licenses.bigrams_of(t), licenses.THRESHOLD))):
        return summary(sorted(out))
    name = lambda u: found[u][1] if u in found else None
    segments: list = []
    for p in re.split(r"\n *(?:\n *)+", norm):
        for line in p.split("\n"):
            line = line.strip(" ")
            if line:
                mine, around = name(line), name(clean(p))
                key = line if mine else clean(p) if around else ""
                if segments and segments[-1][1] == key:
                    segments[-1][0] += " " + line
                else:
                    segments.append([line, key, {mine, around, name(clean(norm))} - {None}])
    for text, _, names in segments:
        words, some = text.split(), []
        own = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        for n, t in templates:
            grams = licenses.bigrams_of(t)
            hits = [g in grams for g in own]
            for i in range(len(own)):
                if not hits[i]:
                    continue
                seen, both = set(), 0
                for k in range(min(len(own) - i, licenses.size_bounds(len(grams), licenses.THRESHOLD)[1])):
                    if own[i + k] not in seen:
                        seen.add(own[i + k])
                        both += hits[i + k]
                    dice = 2 * both / (len(seen) + len(grams))
                    if hits[i + k] and dice >= licenses.THRESHOLD:
                        some.append((-dice, -1 - k, n not in names, n, i))
        chosen = []
        for x in sorted(some):
            if all(x[4] - x[1] < y[4] or y[4] - y[1] < x[4] for y in chosen):
                chosen.append(x)
        out |= {(-x[0], x[3], " ".join(words[x[4] : x[4] - x[1] + 1])) for x in chosen if x[2]}
    return summary(sorted(out))


def test_licences(spark, odd, empty):
    notices = [t for _, t in licenses.TEMPLATES]
    texts = [r[1] for r in odd_rows()] + notices + [t.upper() for t in notices] + [f"some words\n{t}\nmore\n\n{t} and" for t in notices] + [t.replace("License", "Permit") for t in notices]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.license, r.dice, r.licenses, r.n_units) for r in licenses.scan(df).collect()}
    assert got == {i: brute_scan(t) for i, t in enumerate(texts)}
    assert licenses.scan(odd).count() == len(odd_rows()) and licenses.scan(empty).count() == 0


def brute_windows(text):
    """Names and scores of the best windows of a text without matching lines, all windows of admissible sizes scored."""
    words, found = licenses.words_of(text), []
    for name, template in licenses.TEMPLATES:
        grams = licenses.bigrams_of(template)
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + 1 + licenses.size_bounds(len(grams), licenses.THRESHOLD)[1]) + 1):
                own = {f"{a} {b}" for a, b in zip(words[i:j], words[i + 1 : j], strict=False)}
                dice = 2 * len(own & grams) / (len(own) + len(grams))
                if dice >= licenses.THRESHOLD:
                    found.append((-dice, i - j, name, i, j))
    chosen = []
    for x in sorted(found):
        if all(x[4] <= y[3] or y[4] <= x[3] for y in chosen):
            chosen.append(x)
    best = min(((d, n) for d, _, n, _, _ in chosen), default=(0, None))
    return best[1], -best[0], ",".join(sorted({x[2] for x in chosen})), len({(x[2], " ".join(words[x[3] : x[4]])) for x in chosen})


def test_notices_inside_lines(spark):
    inside = "several words that stand before it in one long line of the file, {} And here are some that follow it, so that the line holds much more than that."
    texts = ["Copyright (c) 2020 Jane Doe. Licensed under the MIT License.", "Released under the MIT License. See LICENSE for details.", "All code here is licensed under the Apache License, Version 2.0."]
    texts += [inside.format(t) for _, t in licenses.TEMPLATES]
    texts += ["one line\nmore of it " + t.replace(" ", "\n", 2) + " and so on\nlast of all the lines of this paragraph" for _, t in licenses.TEMPLATES if t.count(" ") > 2]
    texts += [inside.format("it is released under the MIT License. Licensed under CC BY 4.0. Licensed under the Apache License, Version 2.0.")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.license, r.dice, r.licenses, r.n_units) for r in licenses.scan(df, windows=True).collect()}
    # lines that match by themselves are for the other tests
    inner = [i for i, t in enumerate(texts) if brute_scan(t)[0] is None]
    assert len(inner) > len(texts) / 2 and inner[:3] == [0, 1, 2] and all(got[i][0] for i in got)
    assert {i: got[i] for i in inner} == {i: brute_windows(texts[i]) for i in inner}
    assert got[len(texts) - 1][2] == "Apache-2.0,CC-BY-4.0,MIT"


def test_windows_of_matching_lines(spark):
    both = licenses.TEMPLATES[1][1] + " Released under the MIT License."
    df = spark.createDataFrame([(0, both), (1, "MIT it is:\n" + both + "\nend"), (2, "Released under the MIT License.\nand")], "doc_id bigint, text string")
    got = {r.doc_id: (r.license, r.licenses, r.n_units) for r in licenses.scan(df, windows=True).collect()}
    assert {i: x[1] for i, x in got.items()} == {0: "Apache-2.0,MIT", 1: "Apache-2.0,MIT", 2: "MIT"}
    assert got[0][2] == 2 and got[2][2] == brute_scan("Released under the MIT License.\nand")[3]


def test_windows_of_whole_documents(spark, sf):
    """The query's own scan over documents into which notices and licence texts are put: in lines, wrapped, one after another, among repeated ones."""
    r = random.Random(12)
    docs = [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    known = licenses.TEMPLATES + licenses.TEXTS
    texts = []
    for d in docs:
        words = d[:3000].split(" ")
        for _ in range(r.randint(0, 4)):
            t = r.choice(known)[1]
            if r.random() < 0.5:
                own = t.split(" ")
                for _ in range(len(own) // 12):
                    own[r.randrange(len(own))] = r.choice(["\n", "other", "the", "\n\n"])
                t = " ".join(own)
            words.insert(r.randint(0, len(words)), r.choice(["\n", "", "\n\n"]) + t + r.choice(["\n", "", "\n\n"]))
        texts.append(" ".join(words))
    texts += [" and ".join(r.choice(licenses.TEMPLATES)[1] for _ in range(30)), "\n".join(f"{r.choice(licenses.TEMPLATES)[1]} no {i}" for i in range(40)), "\n".join([licenses.TEXTS[3][1]] * 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.license, r.dice, r.licenses, r.n_units) for r in licenses.scan(df, known, windows=True).collect()}
    want = {i: brute_query(t) for i, t in enumerate(texts)}
    assert got == want
    assert sum(x[3] > 0 for x in want.values()) > 25 and max(x[3] for x in want.values()) > 17


def test_scan_is_linear_in_lines(spark):
    """One paragraph of ten times as many lines, with notices in some of them, takes about ten times as long."""
    import time

    r = random.Random(2)

    def seconds(n):
        lines = [" ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(6)) for _ in range(n)]
        for i in range(0, n, n // 40):
            lines[i] += " released under the MIT License. and so on"
        lines[n // 2] = "Released under the MIT License."
        df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string")
        began = time.perf_counter()
        got = licenses.scan(df, licenses.TEMPLATES + licenses.TEXTS, windows=True).collect()
        assert got[0].licenses == "MIT"
        return time.perf_counter() - began

    seconds(400)
    few, many = seconds(4000), seconds(40_000)
    assert many < 25 * few + 5


def test_query_scans_windows(spark, tmp_path):
    spark.createDataFrame([(1, "Copyright (c) 2020 Jane Doe. Licensed under the MIT License.")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.license, r.dice) for r in licenses.op3_license_scan(spark, str(tmp_path)).collect()] == [("MIT", 1.0)]


def test_whole_licence_texts(spark, tmp_path):
    wrapped = lambda t: "\n".join(t[i : i + 70] for i in range(0, len(t), 70))
    texts = [t for _, t in licenses.TEXTS] + ["Copyright 2020 Jane Doe\n\n" + t.replace(". ", ".\n\n", 2) + "\n\nand then other things\nthat are no licence" for _, t in licenses.TEXTS]
    texts += ["some words in front of it " + t + " and others behind it, " * 40 for _, t in licenses.TEXTS] + [wrapped(t) for _, t in licenses.TEXTS]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.licenses.split(",") for r in licenses.op3_license_scan(spark, str(tmp_path)).collect()}
    assert all(licenses.TEXTS[i % len(licenses.TEXTS)][0] in got[i] for i in got)


def test_telling_bigrams_are_needed():
    for _, t in licenses.TEMPLATES + licenses.TEXTS:
        grams = licenses.bigrams_of(t)
        telling = licenses.telling_bigrams(grams, 0.8)
        rest = len(grams - telling)
        assert telling <= grams and 2 * rest / (rest + len(grams)) < 0.8
        assert all(any(p in b for p in licenses.parts_of(telling)) for b in telling)


def test_telling_words_are_needed():
    for _, t in licenses.TEMPLATES:
        grams = licenses.bigrams_of(t)
        words = licenses.telling_words(grams, 0.8)
        rest = {g for g in grams if not words & set(g.split())}
        assert 2 * len(rest) / (2 * len(rest) + len(grams) - len(rest)) < 0.8 if rest else True


def fill(budget, children):
    """Water filling by bisection; children: (capacity, weight)."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for c, w in children) < budget else (low, mid)
    return [min(c, w * high) for c, w in children]


def test_budgets(spark):
    r = np.random.default_rng(4)
    leaves = [(d, la, s, int(r.integers(0, 1000))) for d in ("web", "reference") for la in ("en", "de", "fr") for s in ("a", "b", "c")]
    weights = {("web",): 3, ("web", "en"): 4, ("reference", "de"): 2}
    got = {tuple(x[:3]): x.budget for x in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), 0.7, 1, weights).collect()}
    given = {(): 0.7 * sum(x[3] for x in leaves)}
    for level in range(3):
        after = {}
        for path, b in given.items():
            own = sorted({x[: level + 1] for x in leaves if x[:level] == path})
            caps = [sum(x[3] for x in leaves if x[: level + 1] == o) for o in own]
            after |= dict(zip(own, fill(b, [(c, weights.get(o, 1)) for c, o in zip(caps, own, strict=True)]), strict=True))
        given = after
    assert set(got) == set(given)
    assert all(abs(got[k] - given[k]) <= 1 for k in got)


def test_mix(spark, odd, empty):
    got = mixing.mix(odd, share=0.6, with_key=True).collect()
    assert len({(r.key, r.epoch) for r in got}) == len(got)
    for leaf in {(r.domain, r.lang, r.source) for r in got}:
        own = [r for r in got if (r.domain, r.lang, r.source) == leaf]
        assert sum(r.tokens for r in own) <= own[0].budget
    out = mixing.apply(odd)
    assert out.columns == odd.columns and out.count() > 0
    assert mixing.apply(empty).count() == 0


def brute_mix(rows, share, epochs, seed=mixing.SEED):
    """Leaves' budgets by bisection, then each leaf's longest prefix of its documents in every epoch's order, in plain loops."""
    import re

    units: dict = {}
    for key, domain, lang, source, text in rows:
        leaf, n = (domain, lang or "", source or ""), len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])
        old = units.get(key, (leaf, 0))
        units[key] = (min(leaf, old[0]), old[1] + n)
    tokens: Counter = Counter()
    for leaf, n in units.values():
        tokens[leaf] += n
    given = {(): share * sum(tokens.values())}
    for level in range(3):
        after = {}
        for path, b in given.items():
            own = sorted({x[: level + 1] for x in tokens if x[:level] == path})
            caps = [epochs * sum(n for x, n in tokens.items() if x[: level + 1] == o) for o in own]
            after |= dict(zip(own, fill(b, [(c, mixing.WEIGHTS.get(o, 1)) for c, o in zip(caps, own, strict=True)]), strict=True))
        given = after
    out = Counter()
    for leaf in tokens:
        used, budget = 0, int(given[leaf] + 1e-6)
        for epoch in range(epochs):
            for key in sorted((k for k, (x, _) in units.items() if x == leaf), key=lambda k: hashlib.md5(f"{seed}:{epoch}:{k}".encode()).hexdigest()):
                used += units[key][1]
                if used <= budget:
                    out[(key, epoch, *leaf, units[key][1])] += 1
    return out


@pytest.mark.parametrize(("share", "epochs"), [(0.37, 1), (0.8, 2), (1.3, 2), (1.0, 1)])
def test_mix_equals_loops(spark, share, epochs):
    r = np.random.default_rng(12)
    rows = []
    for i in range(150):
        lang, source = [("en", "s1"), ("en", "s2"), ("de", "s3"), ("fr", "s4"), (None, None)][int(r.choice(5, p=[0.5, 0.2, 0.15, 0.1, 0.05]))]
        rows.append((i if i % 10 else None, " ".join(["w"] * int(r.integers(0, 30))) + f" t{i}", lang, source))
    rows += [rows[10]] * 2 + [(1, "again with the same id", "en", "s1"), (None, None, "en", "s1"), (None, "twice", None, "s2"), (None, "twice", None, "s2"), (None, "twice", "s2", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    keys = [(x.key, x.domain, x.lang, x.source, x.text) for x in df.select(mixing.unit_key("doc_id", "text").alias("key"), mixing.F.expr(mixing.DOMAIN).alias("domain"), "lang", "source", "text").collect()]
    got = Counter((x.key, x.epoch, x.domain, x.lang, x.source, x.tokens) for x in mixing.mix(df, share=share, epochs=epochs, with_key=True).collect())
    want = brute_mix(keys, share, epochs)
    assert got == want
    # the rows themselves come out as often as their unit is taken, in their own language and source
    taken = Counter()
    for key, *_ in want.elements():
        taken[key] += 1
    out = Counter((x.doc_id, x.text, x.lang, x.source) for x in mixing.apply(df, share=share, epochs=epochs).collect())
    expected = Counter()
    for (key, *_), row in zip(keys, rows, strict=True):
        expected[row] += taken[key]
    assert out == +expected


def brute_sketch(text):
    """Plain loops over all k-mers and orders."""
    n = len(text)
    if not n:
        return []
    points = np.array([ord(c) for c in text], np.uint32)
    own = order_minhash.kmers(points)
    seen: Counter = Counter()
    base = []
    for x in own.tolist():
        base.append((x + seen[x] * 0xC2B2AE3D27D4EB4F) % 2**64)
        seen[x] += 1
    base = [x >> 32 for x in order_minhash.mix(np.array(base, np.uint64)).tolist()]
    orders = (order_minhash.stream(order_minhash.SKETCHES, 8) | np.uint64(1)).tolist()
    size = min(order_minhash.TUPLE, len(base))
    steps = (order_minhash.stream(size, 9) | np.uint64(1)).tolist()
    out = []
    for a in orders:
        first = sorted(sorted(range(len(base)), key=lambda i: (base[i] * a % 2**32, i))[:size])
        total = sum(int(own[i]) * s for i, s in zip(first, steps, strict=True)) % 2**64
        out.append(int(order_minhash.mix(np.array([(total + a) % 2**64], np.uint64))[0] >> np.uint64(32)))
    return out


def test_sketch():
    r = np.random.default_rng(6)
    for n in (0, 1, 5, 10, 11, 12, 40, 300, 2000):
        text = "".join(r.choice(list("abcé 日"), n))
        assert order_minhash.sketch(text).tolist() == brute_sketch(text)
    a = "".join(r.choice(list("abcdefgh "), 900))
    moved, changed = a[450:] + a[:450], a[:440] + "xyz" + a[443:]
    like = lambda x: order_minhash.likeness(order_minhash.sketch(a), order_minhash.sketch(x))
    assert like(a) == 1 and like(changed) > like(moved)


def test_fingerprints(odd, empty):
    got = order_minhash.with_next(odd).collect()
    rows = odd_rows()
    assert Counter((r.id, r.n_chars, r.fingerprint) for r in got) == Counter((r[0], len(r[1] or ""), order_minhash.as_text(order_minhash.sketch(r[1] or ""))) for r in rows)
    single = {r[0]: r[1] or "" for r in rows if r[0] is not None and r[0] < 100}
    ids = sorted(single, reverse=True)
    own = {r.id: r for r in got}
    for i, j in zip(ids[:-1], ids[1:], strict=True):
        e = order_minhash.edited(single[i], single[j])
        assert own[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert own[i].edited_fingerprint == order_minhash.as_text(order_minhash.sketch(e))
    assert order_minhash.with_next(empty).count() == 0


def test_every_next_document(spark):
    """All columns in descending order of id, over the ends of partitions and from the last document to the first."""
    r = np.random.default_rng(11)
    base = "".join(r.choice(list("abcdefgh é"), 700))
    texts = [base, base[:400] + "".join(r.choice(list("xyz "), 300)), "", "abc", base[200:] + base[:200], base, "short one", "".join(r.choice(list("日本語 "), 90))] * 3 + ["q" * 600_000 + base]
    rows = [(int(i) * 3 - 20, t) for i, t in zip(r.permutation(len(texts)), texts, strict=True)]
    got = {x.id: x for x in order_minhash.with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    share = lambda a, b: float(len(a) == len(b)) if len(a) != len(b) or not len(a) else sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    some = 0
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 3
        e = t[: len(t) - n] + after[:n]
        a, b, c = (order_minhash.sketch(x).tolist() for x in (t, e, after))
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == "".join(f"{x:08x}" for x in a) and got[i].edited_fingerprint == "".join(f"{x:08x}" for x in b)
        assert got[i].near_edited == pytest.approx(share(a, b)) and got[i].near_next == pytest.approx(share(a, c))
        some += 0 < got[i].near_edited < 1
    assert some > 5


def test_hilbert_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    at = sharding.hilbert(cells, 3)
    assert sorted(at.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [1, 4, 16])
def test_shards(odd, empty, n):
    got = sharding.shards(odd, n).collect()
    rows = odd_rows()
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(min(n, len(rows)))) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    if n == 4:
        assert all(len({r.shard for r in got if r.text_crc32 == c}) == 1 for c in {r.text_crc32 for r in got})
    assert sharding.shards(empty, n).count() == 0


def brute_shards(rows, n):
    """Shards and slots in plain loops: the whole order, groups at home while they fit, all others in what is left."""
    cells = []
    for j in (2, 3):
        counts = Counter(x[j] or "" for x in rows)
        first, before = {}, 0
        for v, m in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            first[v] = before * 32 // len(rows)
            before += m
        cells.append([first[x[j] or ""] for x in rows])
    sizes = [len((x[1] or "").encode()) + 1 for x in rows]
    curve = sharding.hilbert(np.array([*cells, [min(31, s.bit_length()) for s in sizes]]).T, sharding.BITS).tolist()
    hashes = [hashlib.md5((x[1] or "").encode()).hexdigest() for x in rows]
    groups: dict = {}
    for k, h in enumerate(hashes):
        groups.setdefault(h, []).append(k)
    last = lambda i: 2**63 - 1 if i is None else i
    lead = {h: min(own, key=lambda k: (rows[k][0] is None, last(rows[k][0]), curve[k])) for h, own in groups.items()}
    order = sorted(range(len(rows)), key=lambda k: (curve[lead[hashes[k]]], hashes[k], last(rows[k][0])))
    place = {k: p for p, k in enumerate(order)}
    q, r = divmod(len(rows), n)
    room = [q + (s < r) for s in range(n)]
    ends = np.cumsum(room).tolist()
    home, by_class = {}, {}
    for h, own in groups.items():
        if len(own) > 1:
            home[h] = sum(e <= min(place[k] for k in own) + len(own) // 2 for e in ends)
            by_class.setdefault((home[h], len(own).bit_length()), []).append(h)
    kept: set = set()
    left = list(room)
    for s in range(n):
        upto = 0
        for c in sorted(c for t, c in by_class if t == s):
            upto += sum(len(groups[h]) for h in by_class[s, c])
            if upto <= room[s]:
                kept |= set(by_class[s, c])
                left[s] -= sum(len(groups[h]) for h in by_class[s, c])
    free, turn, out, slots = np.cumsum(left).tolist(), 0, Counter(), Counter()
    for k in order:
        if hashes[k] in kept:
            shard = home[hashes[k]]
        else:
            shard, turn = sum(e <= turn for e in free), turn + 1
        out[(rows[k][0], sizes[k], shard, slots[shard])] += 1
        slots[shard] += 1
    return out


@pytest.mark.parametrize("few", [0, 10**6])
def test_shards_equal_loops(spark, monkeypatch, few):
    """With groups that are broadcast, and with groups that are shuffled but for the heaviest."""
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", few)
    monkeypatch.setattr(sharding, "HEAVY", 20)
    r = np.random.default_rng(7)
    texts = [f"text {i} " + "y" * int(r.integers(0, 400)) for i in range(150)]
    rows = [(i, texts[int(r.integers(0, 150)) if i % 3 else int(r.integers(0, 3))], str(r.choice(["en", "de", "fr"])), f"s{r.integers(0, 9)}") for i in range(400)]
    rows += [(1000 + i, "hot", "en", "s1") for i in range(90)]
    got = Counter((x.id, x.size, x.shard, x.slot) for x in sharding.shards(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 8).collect())
    assert got == brute_shards(rows, 8)


def test_windows_hold_every_short_span():
    """Words up to half a window and more apart are seen together wherever they stand."""
    text = b" ".join(b"w%d" % i for i in range(101))
    _, start, length = toxicity.Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)])).windows()
    held = lambda i, j: ((start <= i) & (j < start + length)).any()
    assert all(held(i, i + 16) for i in range(101 - 16))


def test_gradients():
    """Backpropagation against finite differences."""
    r = np.random.default_rng(0)
    t = toxicity.Trainer(3)
    t.m = {k: x.astype(np.float64) for k, x in t.m.items()}
    t.m["H"] += r.standard_normal(t.m["H"].shape) / 4
    shape = (toxicity.WINDOW, 3)
    number, bucket, shown, word = r.integers(0, len(toxicity.CLASSES) + 1, shape), r.integers(0, 9, shape), r.integers(0, 2, shape).astype(float), r.integers(0, 7, shape)
    size = np.array([1, 2, 3, 5, 8, 15, 16])
    chars = np.where(np.arange(toxicity.CHARS) < size[:, None], r.integers(97, 103, (7, toxicity.CHARS)), 0).astype(np.uint8)
    length, y = np.array([toxicity.WINDOW, 5, 1]), np.array([1.0, 0.0, 1.0])

    def loss(m):
        x = np.concatenate([m["E"][number], m["H"][bucket] * shown[:, :, None], toxicity._spelled(chars, size, m)[0][word]], axis=2)
        mask, chain = toxicity._masks(length)
        states, _ = toxicity._steps(toxicity._aligned(x @ m["W"] + m["b"], toxicity._FORWARD), chain, m["U"], False)
        p = toxicity._sigmoid(toxicity._pooled(states, mask, m)[0])
        return float(-np.log(np.where(y > 0, p, 1 - p)).mean()) + toxicity.DECAY / 2 * float((m["H"] ** 2).sum())

    before = {k: x.copy() for k, x in t.m.items()}
    t.moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in t.m.items()}
    t.step(number, bucket, shown, word, chars, size, length, y)
    for k, (a, _) in t.moments.items():
        g = a / 0.1
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        step = np.zeros_like(before[k])
        step[i] = 2e-2
        numeric = (loss(before | {k: before[k] + step}) - loss(before | {k: before[k] - step})) / 4e-2
        assert abs(numeric - g[i]) < 0.03 * max(abs(numeric), 1e-3) + 2e-4, k


def brute_score(text, m):
    """The largest window logit, word by word, character by character and gate by gate."""
    sig = lambda x: 1 / (1 + np.exp(-x))

    def chain(inputs, u, hidden, forward):
        """inputs are the gates' sums of both chains; the last state and all states of one of them."""
        columns = np.flatnonzero(np.tile(np.repeat([forward, not forward], hidden), 3))
        own, h, states = u[np.ix_(columns[:hidden], columns)], np.zeros(hidden), []
        for g in inputs if forward else inputs[::-1]:
            g, hu = g[columns], h @ own
            z, r = sig(g[:hidden] + hu[:hidden]), sig(g[hidden : 2 * hidden] + hu[hidden : 2 * hidden])
            c = np.tanh(g[2 * hidden :] + r * hu[2 * hidden :])
            h = (1 - z) * c + z * h
            states.append(h)
        return h, states if forward else states[::-1]

    import re

    own = toxicity.Texts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    words = [w[i : i + toxicity.CHARS] for w in re.findall(rb"[a-z0-9\x80-\xff]+", own.data.tobytes()) for i in range(0, len(w), toxicity.CHARS)]
    steps = []
    assert len(words) == len(own.hashes)
    for w, h in zip(words, own.hashes, strict=True):
        known = dict(zip(m["vocabulary"].tolist(), m["classes"].tolist(), strict=True))
        gates = [m["C"][c] @ m["Wc"] + m["bc"] for c in w]
        spelled = np.concatenate([chain(gates, m["Uc"], toxicity.CHAR_HIDDEN, f)[0] for f in (True, False)])
        steps.append(np.concatenate([m["E"][known.get(int(h), toxicity.NEUTRAL)], m["H"][int(h) % toxicity.BUCKETS], spelled]) @ m["W"] + m["b"])
    best = []
    for a in range(0, max(1, len(steps) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        window = steps[a : a + toxicity.WINDOW]
        states = np.concatenate([chain(window, m["U"], toxicity.HIDDEN, f)[1] for f in (True, False)], axis=1)
        weight = np.exp(np.tanh(states @ m["A"] + m["c"]) @ m["v"])
        best.append((weight / weight.sum()) @ states @ m["o"] + m["p"][0])
    return max(best)


def test_scores():
    """Scores of whole texts against loops over windows, words and characters."""
    r = np.random.default_rng(2)
    m = {k: x.astype(np.float64) for k, x in toxicity.Trainer(5).m.items()}
    m["H"] = r.standard_normal(m["H"].shape)
    texts = [" ".join("".join(r.choice(list("abcXé1"), int(r.integers(1, 9)))) for _ in range(n)) for n in (1, 5, 24, 25, 32, 33, 70)] + ["x" * 70 + " y", "!one.Two"]
    whole = toxicity.Texts(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    m["vocabulary"] = np.unique(whole.hashes)[::3]
    m["classes"] = r.integers(0, len(toxicity.CLASSES) + 1, len(m["vocabulary"]))
    assert np.allclose(toxicity.scores(whole, m, toxicity.Spelling(m)), [brute_score(t, m) for t in texts], atol=1e-4)


def test_training_with_repeated_ids(spark):
    """Of rows that repeat an id one text is learned from, whatever their order, so the model is the same."""
    rows = [(i, f"{'vile' if i % 4 == 0 else 'fine'} w{i % 7} x{j}") for i in range(60) for j in range(2)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    models = [toxicity.train(spark.createDataFrame(own, "doc_id bigint, text string").repartition(n), marks) for own, n in ((rows, 1), (rows[::-1], 3))]
    assert all(np.array_equal(models[0][k], models[1][k]) for k in models[0])


def test_training_leaves_out_only_what_does_not_fit(spark):
    """One labelled text above the bound, first in the order of hashes, doesn't empty the training set."""
    rows = [(i, f"{'vile' if i % 4 == 0 else 'fine'} w{i % 7} x{i % 9}") for i in range(90)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(90)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    first = marks.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("long "), 5000)).otherwise(F.col("text")))
    model, without = toxicity.train(long, marks, max_bytes=20_000), toxicity.train(docs.filter(F.col("doc_id") != first), marks, max_bytes=20_000)
    assert model is not None and all(np.array_equal(model[k], without[k]) for k in model if k != "scale")
    got = {x.id: x.score for x in toxicity.score(toxicity.id_text(docs), model).collect()}
    assert np.mean([got[i] for i in range(0, 90, 4)]) > np.mean([got[i] for i in range(1, 90, 4)]) + 0.3


def test_held_out_accuracy(spark):
    r = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(400)])
    rows, labels = [], []
    for i in range(900):
        own = list(r.choice(words, int(r.integers(3, 120))))
        bad = i % 6 == 0
        if bad:
            own[int(r.integers(0, len(own)))] = ["Nasty,", "awful!", "vile"][int(r.integers(0, 3))]
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks)
    got = {x.id: x.score for x in toxicity.score(toxicity.id_text(docs), model).collect()}
    held = [i for i, _ in rows if toxicity.held_out(i)]
    assert len(held) > 250
    assert np.mean([(got[i] >= 0.7) == dict(labels)[i] for i in held]) > 0.97
    assert toxicity.train(docs, marks.filter("toxic = 0")) is None


def test_toxicity_of_odd_rows(spark, odd, empty, sf):
    marks = spark.createDataFrame([(r[0], int(k % 2)) for k, r in enumerate(odd_rows()) if r[0] is not None] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    out = toxicity.kept(odd, marks)
    assert out.columns == odd.columns
    model = toxicity.train(odd, marks)
    got = toxicity.score(toxicity.id_text(odd), model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.kept(empty, marks).count() == 0


def test_windows_overlap_and_cover():
    text = " ".join(f"w{i}" for i in range(100)).encode()
    t = toxicity.Texts(np.frombuffer(text + b"one", np.uint8), np.array([0, len(text), len(text) + 3]))
    which, start, length = t.windows()
    seen = Counter(w for s, n in zip(start, length, strict=True) for w in range(s, s + n))
    assert set(seen) == set(range(101)) and sum(v > 1 for v in seen.values()) >= 40
    assert which.tolist() == sorted(which.tolist())
