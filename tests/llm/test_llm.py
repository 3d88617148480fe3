"""Each operator against a plain version on small rows with nulls, blanks, ties, copies, long texts and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvanite.llm import ann, decontam, jaccard, licenses, line_dedup, lm_score, packing, repeats, token_counts, toxicity

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, __key string, __drop int, h int, n int"


def _texts():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 9)))
    line = lambda k: " ".join(word() for _ in range(k))
    shared = [line(12) for _ in range(4)]
    out = [(1, None), (2, ""), (3, "   \n\t"), (4, "One"), (5, "one"), (5, "one"), (None, "no id here at all, " + shared[0])]
    base = line(120)
    for i in range(8):  # near copies of a text
        w = base.split()
        w[r.randrange(120)] = word()
        out.append((20 + i, " ".join(w)))
    out += [(30, base), (31, base), (32, base + "\n" + base)]
    for i in range(10):
        out.append((40 + i, "\n".join([line(5), r.choice(shared), line(9), "  " + shared[1].upper() + " ", shared[2]])))
    out.append((60, line(6000)))
    out.append((61, "De " * 900))
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return line_dedup.LOWEST if i is None else i


def rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_line_dedup(docs, empty):
    found = collections.defaultdict(set)
    norm = lambda x: x.strip(" \t\n\v\f\r").translate(AZ)
    for i, t in TEXTS:
        for x in (t or "").split("\n"):
            if len(norm(x)) >= 20:
                found[norm(x)].add(key(i))
    gone = {x: max(i) for x, i in found.items() if len(i) >= 3}
    want = sorted((str(i), str("\n".join(x for x in (t or "").split("\n") if norm(x) not in gone or key(i) == gone[norm(x)]))) for i, t in TEXTS if t is not None)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns and rows(got.where("text is not null"), "doc_id", "text") == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = [(1, TEXTS[-2][1][:200]), (2, "One"), (2, None), (3, ""), (4, None), (10, TEXTS[8][1]), (11, TEXTS[8][1]), (None, "de")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(AZ))
        if i is not None and w:
            k = min(10, len(w))
            for a in range(len(w) - k + 1):
                windows[tuple(w[a : a + k])].add(i)
    want = []
    for i, t in TEXTS:
        w, hit, own = ALNUM.findall((t or "").translate(AZ)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if x := windows.get(tuple(w[a : a + k])):
                    own |= x
                    hit |= set(range(a, a + k))
        longest = []
        for item in sorted(own):
            best = (0, 0)
            for own_id, x in items:
                v = ALNUM.findall((x or "").translate(AZ)) if own_id == item else []
                for a, c in itertools.product(range(len(w)), range(len(v))):
                    if w[a] == v[c] and (a == 0 or c == 0 or w[a - 1] != v[c - 1]):
                        k = next((k for k in range(min(len(w) - a, len(v) - c)) if w[a + k] != v[c + k]), min(len(w) - a, len(v) - c))
                        best = max(best, (k, -a))
            longest.append(best)
        want.append((str(i), str(len(w)), str(len(hit)), str(sorted(own)), str([x[0] for x in longest]), str([-x[1] for x in longest])))
    for block, most in ((1 << 20, 8), (100, 8), (100, 2)):
        assert rows(decontam.search(docs, bench, block=block, most=most), "doc_id", "n_words", "n_hit", "items", "longest", "longest_at") == sorted(want)
    assert sorted(r.doc_id or 0 for r in decontam.decontaminate(docs, bench, block=100, most=2).collect()) == sorted(int(x[0]) if x[0] != "None" else 0 for x in want if x[2] == "0")
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(x[2] == "0" for x in want)
    assert decontam.search(empty, bench).count() == 0 and decontam.search(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_of_one_word_over_and_over(spark):
    bench = spark.createDataFrame([(1, "la " * 3000), (2, "la " * 20 + "di da")], "item_id long, text string")
    got = decontam.search(spark.createDataFrame([(1, "la " * 9000 + "di")], "doc_id long, text string"), bench).first()
    assert (got.n_words, got.n_hit, got["items"], got.longest, got.longest_at) == (9001, 9001, [1, 2], [3000, 21], [0, 8980])
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = r.integers(-1, 3, 30), r.integers(0, 3, 12)
        runs = [(k, -p) for p in range(30) for o in range(12) for k in range(1, 13) if p + k <= 30 and o + k <= 12 and (a[p : p + k] == b[o : o + k]).all()]
        n, p = max(runs, default=(0, 0))
        assert decontam.common_run(a, b) == (n, -p if n else 0)


def test_jaccard(docs, empty):
    sets = []
    for i, t in TEXTS:
        w = BLANK.findall((t or "").translate(AZ))
        sets.append((key(i), frozenset(tuple(w[a : a + 4]) for a in range(max(1, len(w) - 3))) if w else frozenset()))
    root = list(range(len(sets)))
    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            p, q = root[a], root[b]
            root = [min(p, q) if z in (p, q) else z for z in root]
    least = collections.defaultdict(list)
    for a, z in enumerate(root):
        least[z].append(sets[a][0])
    want = sorted((str(sets[a][0]), str(len(sets[a][1])), str(min(least[z]))) for a, z in enumerate(root))
    assert rows(jaccard.join(docs, k=4, num=85, den=100), "doc", "n", "component") == want
    kept = jaccard.keep_one(docs, k=4, num=85, den=100)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert jaccard.join(empty).count() == 0


def test_signature_tree_loses_no_pair():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 2**63, 40).astype(np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[:36], r.integers(0, 2**63, 4).astype(np.uint64)])) for s in sets]
    bits = np.stack([jaccard.bitmap(s) for s in sets]).view(np.uint64)
    n = np.array([len(s) for s in sets])
    x, y = jaccard.tree_pairs(n, n, bits, bits, 4, 5)
    got = {(min(p), max(p)) for p in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert want <= got and len(got) < 200


def test_repeats(docs, empty):
    seen = collections.Counter(b[k : k + 400] for _, t in TEXTS for b in [(t or "").encode()] for k in range(len(b) - 399))
    want = []
    for i, t in TEXTS:
        b = (t or "").encode()
        out = set()
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                out |= set(range(k, k + 400))
        left = bytes(x for k, x in enumerate(b) if k not in out)
        spans = sum(k - 1 not in out for k in out)
        want.append((str(i), str(len(b)), str(len(out)), str(spans), hashlib.sha256(left).hexdigest()))
    one = repeats.removed(docs)
    assert rows(one, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)
    assert repeats.with_spans(empty).count() == 0


def test_lm_score(docs, empty):
    w = [(i, [*BLANK.findall((t or "").translate(AZ)), "\0end"]) for i, t in TEXTS]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = collections.Counter(x for i, t in w if not fold(i) for x in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), str(fold(i)), len(t), sum(c[x] > 0 for x in t), n, sum(np.log10((c[x] + 1) / (n + v + 1)) for x in t)) for i, t in w)
    got = sorted((str(r[0]), str(r[1]), *r[2:]) for r in lm_score.score(docs, shard_rows=7).collect())
    for g, e in zip(got, want, strict=True):
        assert g[:5] == e[:5] and abs(g[5] - e[5]) < 1e-6 * max(1, abs(e[5])) and g[6] <= 0
    assert lm_score.score(empty).count() == 0


def test_lm_bigrams_of_rare_words(spark, tmp_path):
    r = random.Random(3)
    line = lambda: " ".join(f"w{r.randrange(400)}" for _ in range(60))
    texts = [(i, f"rare{i % 40}x then{i % 40}x " + line()) for i in range(2000)]
    got = lm_score.score(spark.createDataFrame(texts, "doc_id long, text string"), shard_rows=300).collect()
    train = [t.split() + ["\0end"] for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(x for t in train for x in t)
    pairs = collections.Counter(p for t in train for p in zip(["\0end", *t], t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in texts:
        w = t.split() + ["\0end"]
        q = lambda x: 0 if not x else np.ceil(1.5 ** np.floor(np.log(x) / np.log(1.5) + 1e-9) - 1e-6)
        want[i] = sum(np.log10((q(pairs[a, b]) + lm_score.MU * (c[b] + 1) / (n + v + 1)) / (c[a] + lm_score.MU)) for a, b in zip(["\0end", *w], w))
    off = [abs(x.score - want[x.doc_id]) / abs(want[x.doc_id]) for x in got]
    assert np.median(off) < 1e-3 and max(off) < 0.02  # the filter has some false positives
    path = str(tmp_path / "docs")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(path)
    again = {x.doc_id: x.score for x in lm_score.score(spark.read.parquet(path), shard_rows=100).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-9 for x in got)  # scores do not depend on the shards


def test_packing(docs, empty):
    enc = packing.encoder()
    ids = collections.defaultdict(list)
    for i, t in TEXTS:
        ids[i].append(np.append(np.array(enc.slow().encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4"))
    got = packing.pack(docs).toPandas()
    total = sum(len(x) for y in ids.values() for x in y)
    assert got.length.sum() == total
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 1024
    for r in got.itertuples():
        own = ids[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in own)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("most", [packing.MOST, 12])
def test_packer_keeps_most_tokens_in_place(most):
    r = np.random.default_rng(4)
    packer, sizes = packing.Packer(64, 0, most), r.integers(1, 200, 3000).tolist() + [40] * 500
    for doc, n in enumerate(sizes):
        packer.add(doc, np.arange(n, dtype=np.uint32))
        assert packer.live <= most
    packer.close()
    got, covered = collections.defaultdict(int), collections.defaultdict(list)
    for doc, start, length, crc, total, seq, at in packer.out:
        assert at == got[seq] and total == sizes[doc] and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
        got[seq] += length
        covered[doc] += range(start, start + length)
    assert all(sorted(covered[doc]) == list(range(n)) for doc, n in enumerate(sizes))
    odd = [x for x in got.values() if x != 64]
    assert sorted(got) == list(range(len(got))) and len(odd) == len(set(odd)) and all(x & (x - 1) == 0 for x in odd)
    assert packer.placed == sum(n % 64 for n in sizes) and (most < 20 or packer.moved < 0.2 * packer.placed)


def test_special_tokens_are_encoded_alike():
    enc = packing.encoder()
    for t in ("a<|endoftext|>b", "plain", "", "ñ  \n\n x"):
        assert enc.ids(t).tolist() == enc.slow().encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["start", "largest"])
def test_token_counts(docs, empty, rule):
    got = token_counts.section_tokens(docs, rule=rule).collect()
    assert len(got) == len(TEXTS) and all(sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections for r in got)
    assert token_counts.attribute(np.array([3, 4]), np.array([0, 4]), "largest")[0].tolist() == [1, 1]
    assert token_counts.attribute(np.array([3, 2]), np.array([0, 4]), "start")[0].tolist() == [2, 0]
    assert token_counts.section_tokens(empty).count() == 0


def plain_licenses(text, templates, t=0.8):
    """All windows of all sizes, by sets."""
    words = ALNUM.findall((text or "").translate(AZ))
    lines = [k for k, x in enumerate((text or "").split("\n")) for _ in ALNUM.findall(x.translate(AZ))]
    grams, out = list(zip(words, words[1:])), []
    for name, template in templates.items():
        w = ALNUM.findall(template.translate(AZ))
        own = set(zip(w, w[1:]))
        found = []
        for s in range(len(grams)):
            best = None
            for e in range(s + 1, min(len(grams), s + int(len(own) * (2 - t) / t + 1e-9)) + 1):
                unit = set(grams[s:e])
                d = 2 * len(unit & own) / (len(unit) + len(own))
                if d >= t and grams[s] in own and grams[e - 1] in own and (best is None or d > best[0]):
                    best = (d, s, e)
            if best:
                found.append(best)
        taken = []
        for d, s, e in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(e <= a or z <= s for _, a, z in taken):
                taken.append((d, s, e))
        out += [(-d, name, lines[s]) for d, s, _ in taken]
    top = min(out, default=(-0.0, None))
    return len(words), len(out), sorted({x[1] for x in out}), top[1], -top[0], sorted({x[2] for x in out})


def test_licenses(spark, docs, empty):
    r = random.Random(8)
    mit, bsd = licenses.TEXTS["MIT"], licenses.TEXTS["BSD-3-Clause"]
    own = {"a": "All rights reserved.", "b": "b c d e f g h i j", "c": "x y x y x y z", "mit": " ".join(mit.split()[:30]), "a2": "ALL rights, reserved"}
    texts = [(1, None), (2, ""), (3, "x\nAll rights\nreserved. y"), (None, "word"), (3, "all rights reserved all rights reserved")]
    for i in range(150):
        w = [r.choice("a b c d e f g h i j x y z All rights reserved".split()) for _ in range(r.randrange(30))]
        at = r.randrange(len(w) + 1)
        piece = r.choice(list(own.values())).split()
        if r.random() < 0.5:
            piece.pop(r.randrange(len(piece)))
        texts.append((10 + i, "".join(x + r.choice([" ", "\n", "  "]) for x in w[:at] + piece + w[at:])))
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_words int").repartition(3)
    got = sorted(map(str, map(tuple, licenses.scan(df, templates=own).collect())))
    assert got == sorted(str((i, *plain_licenses(t, own))) for i, t in texts)
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs).count() == len(TEXTS)
    # full texts, with a name, other line ends, and inside a long paragraph
    filler = " ".join(f"word{k}" for k in range(300))
    full = {1: ("Copyright (c) 2024 Jane Doe\n\n" + mit, "MIT"), 2: (filler + " " + " ".join(mit.split()) + " " + filler, "MIT"), 3: (bsd.replace("copyright holder", "Example Corp"), "BSD-3-Clause"), 4: (licenses.TEXTS["Apache-2.0"] + filler, "Apache-2.0"), 5: (filler + " Released under the MIT License. " + filler, "MIT-notice"), 6: (filler + mit[:300], None)}
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in full.items()], "doc_id long, text string")).collect()
    assert {x.doc_id: x.best_license for x in got} == {i: name for i, (_, name) in full.items()}
    with pytest.raises(ValueError):
        licenses.Scanner({"x": "one"}, 0.8)


def test_license_templates_from_files(spark, tmp_path):
    (tmp_path / "mine.txt").write_text("some words\nof mine")
    assert licenses.read_templates(spark, str(tmp_path)) == {"mine": "some words\nof mine"}


def test_nearest_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 8)).astype(np.float32)
    x[100:180] = x[0]  # copies
    data = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(600, None), (700, [0.0] * 8), (800, [float("nan")] * 8), (900, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(data + data[:50], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for q in ann.search(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(600), d)).tolist() if i != q][:10]
        assert len(got[q]) == 10 and all(abs(s - d[i]) < 1e-9 for i, s in got[q])
        hits += len(set(want) & {i for i, _ in got[q]})
    assert hits >= 54 and [i for i, _ in got[0]] == list(range(100, 110)) and set(got) == set(range(0, 600, 100))
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_toxicity_of_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in toxicity.op9_toxicity(spark, base).where("held_out").collect() if r.doc_id in labels]
    assert len(held) > 500 and np.mean([p == y for p, y in held]) > 0.95
    assert np.mean([p for p, y in held if y]) > 0.75


def test_toxicity_is_trained_on_whole_texts(spark):
    r = random.Random(5)
    plain = lambda k: " ".join(r.choice(["sun", "tree", "river", "stone", "cloud", "bird", "road", "house"]) for _ in range(k))
    texts = [(i, plain(3000) + (" vile scum filth" * 12 if i % 2 else "") + " " + plain(40)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert np.mean([x.predicted == x.doc_id % 2 for x in got]) > 0.95


def test_toxicity_reads_long_words_to_their_end():
    import pyarrow as pa

    r = random.Random(6)
    plain = lambda k: "".join(r.choice("天地山水風雲花鳥日月") for _ in range(k))
    texts = [plain(100) + ("毒罵恨" * 25 if i % 2 else plain(75)) + plain(30) for i in range(80)]
    net = toxicity.train(texts[:40], [i % 2 for i in range(40)])
    got = toxicity.score_texts(net, *toxicity.buffer(pa.array(texts[40:])))
    assert np.mean([(x >= 0.5) == i % 2 for i, x in enumerate(got)]) > 0.9
    words, _, begin, inverse, first = toxicity.distinct_words(*toxicity.buffer(pa.array(["ab " + "x" * 130, "", "y" * 64])))
    assert first.tolist() == [0, 4, 4, 5] and sorted(np.diff(begin)[inverse].tolist()) == [3, 3, 65, 65, 65]


def test_toxicity_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 50)] + [(5000, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(TEXTS) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.score(empty, None).count() == 0
    kept = toxicity.reject_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_toxicity_words_of_chunks_are_those_of_all_texts():
    import pyarrow as pa

    texts = [t or "" for _, t in TEXTS]
    whole = toxicity.distinct_words(*toxicity.buffer(pa.array(texts)))
    parts = toxicity.joined_words([toxicity._distinct(*toxicity.buffer(pa.array(texts[k : k + 5]))) for k in range(0, len(texts), 5)])
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(whole, parts))


def test_gradients():
    texts = ["ab cd ef", "gh ab", "xx"]
    import pyarrow as pa

    words, grams, begin, inverse, first = toxicity.distinct_words(*toxicity.buffer(pa.array(texts)))
    owner, start, size = toxicity.windows(first)
    ids, live = toxicity.grid(start, size, inverse)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    target, weight = np.array([1.0, 0, 1]), np.ones(3)
    loss = lambda: float(np.mean(np.logaddexp(0, o := net.forward(net.projected(net.inputs(words, grams, begin).astype(float)), ids, live)) - target * o))
    g, _, _, _ = net.gradients(words, grams, begin, ids, live, target, weight)
    for name in ("uf", "wb", "a", "v", "o"):
        at = (0,) * net.p[name].ndim
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        down = loss()
        net.p[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3


def plain_lines(rows):
    """Line dedup of (doc_id, text) rows."""
    norm = lambda x: x.strip(" \t\n\v\f\r").translate(AZ)
    found = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(norm(x)) >= 20:
                found[norm(x)].add(i)
    gone = {x: max(i) for x, i in found.items() if len(i) >= 3}
    return [(i, "\n".join(x for x in (t or "").split("\n") if norm(x) not in gone or i == gone[norm(x)])) for i, t in rows]


def plain_near_copies(rows):
    """The least doc_id of each group linked by 5-word shingles, from a Jaccard similarity of 0.8 on."""
    w = [BLANK.findall((t or "").translate(AZ)) for _, t in rows]
    sets = [{tuple(x[a : a + 5]) for a in range(max(1, len(x) - 4))} if x else set() for x in w]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small and 5 * small >= 4 * large and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            p, q = root[a], root[b]
            root = [min(p, q) if z in (p, q) else z for z in root]
    least = {}
    for k, z in enumerate(root):
        least[z] = min(least.get(z, rows[k][0]), rows[k][0])
    return [x for x in rows if x[0] in set(least.values())]


def plain_clean(rows, items):
    words = lambda t: ALNUM.findall((t or "").translate(AZ))
    windows = {tuple(w[a : a + min(10, len(w))]) for w in map(words, items) for a in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in windows}
    return [(i, t) for i, t in rows if not any(tuple(w[a : a + k]) in windows for w in [words(t)] for k in sizes for a in range(len(w) - k + 1))]


def pieces_of(packed):
    out = collections.defaultdict(dict)
    for r in packed.collect():
        out[r.doc_id][r.start] = (r.length, r.ids_crc32, r.doc_tokens)
    return out


def check_packed(packed, rows):
    enc = packing.encoder().slow()
    got = pieces_of(packed)
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.append(np.array(enc.encode(t or "", add_special_tokens=False).ids, "<u4"), 0).astype("<u4")
        at = 0
        for start, (length, crc, total) in sorted(got[i].items()):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline as c

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{base}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    import pyarrow as pa

    rows = [x for x in rows if toxicity.score_texts(net, *toxicity.buffer(pa.array([x[1] or ""])))[0] < 0.5]
    rows = plain_near_copies(plain_lines(rows))
    rows = plain_clean(rows, [r.text for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()])
    kept = docs
    for _, stage in c.STAGES[1:-1]:
        kept = stage(spark, kept, base)
        assert kept.columns == docs.columns
    packed = c.run(spark, base)
    assert len({x[0] for x in rows}) == len(rows) > 50
    check_packed(packed, rows)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as c

    texts = [(i, t) for i, t in TEXTS if i not in (5, None)] + [(70, TEXTS[-2][1]), (71, TEXTS[-2][1])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("full", texts), ("none", [])):
        base = tmp_path / name
        spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], schema).write.parquet(str(base / "documents.parquet"))
        spark.createDataFrame([(i, 1, None) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
        spark.createDataFrame([(1, TEXTS[8][1]), (2, None), (None, "de")] if rows else [], "item_id long, text string").write.parquet(str(base / "benchmark.parquet"))
        want = plain_clean(plain_near_copies(plain_lines(rows)), [TEXTS[8][1]] if rows else [])
        check_packed(c.run(spark, str(base)), want)
        assert bool(want) == bool(rows)


def test_token_counts_against_offsets(spark):
    r = random.Random(9)
    texts = [(i, "".join(r.choice(["word", " ", "\n", "\n\n", "é", "naïve ", "x1", "  ", "\t", "Zürich\n", "天地"]) for _ in range(r.randrange(60)))) for i in range(120)] + [(200, None), (201, "")]
    enc = packing.encoder().slow()
    for rule in ("start", "largest"):
        want = {}
        for i, t in texts:
            raw = (t or "").encode()
            bounds = [0, *(k + 1 for k, x in enumerate(raw) if x == 10), len(raw)]
            count, at = [0] * (len(bounds) - 1), 0
            for x in enc.encode(t or "", add_special_tokens=False).ids:
                end = at + packing.encoder().sizes[x]
                own = [max(0, min(z, end) - max(a, at)) for a, z in zip(bounds, bounds[1:])]
                hit = [k for k, y in enumerate(own) if y]
                count[hit[0] if rule == "start" else max(hit, key=lambda k: (own[k], -k))] += 1
                at = end
            assert at == len(raw)
            want[i] = count
        df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, id int, n_tokens int")
        assert {x.doc_id: x.section_tokens for x in token_counts.section_tokens(df, rule=rule).collect()} == want


def test_nearest_neighbours_beside_other_columns(spark):
    data = [(i, [float(i % 7), 1.0], i, "x", -i) for i in range(60)]
    plain = spark.createDataFrame([x[:2] for x in data], "vec_id long, embedding array<float>")
    wide = spark.createDataFrame(data, "vec_id long, embedding array<float>, id int, v string, cell int")
    got = [sorted(map(tuple, ann.search(x, F.col("id") % 10 == 0).collect())) for x in (plain, wide)]
    assert got[0] == got[1] and len(got[0]) == 60


def test_repeats_in_very_long_texts(spark):
    r = np.random.default_rng(5)
    long = "".join(map(chr, r.integers(97, 123, repeats.SEGMENT + 300_000).tolist()))
    at = repeats.SEGMENT - 500  # a passage over the border of two segments
    docs = spark.createDataFrame([(1, long), (2, "x" * 50 + long[at : at + 1000] + "y" * 50), (3, long[:399])], "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.removed(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (len(long), 1000, 1, sha(long[:at] + long[at + 1000 :])), 2: (1100, 1000, 1, sha("x" * 50 + "y" * 50)), 3: (399, 0, 0, sha(long[:399]))}


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_line_dedup", "op3_ngram_jaccard", "op10_repeats"])
def test_query_against_sql(spark, name):
    import duckdb

    from sylvanite import llm

    con, base = duckdb.connect(), "/root/testdata/sf0.001"
    for x in ("documents", "benchmark"):
        con.execute(f"create view {x} as select * from '{base}/{x}.parquet'")
    a, b = llm.queries()[name](spark, base).toPandas(), con.execute(llm.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and sorted(map(str, a[columns].values.tolist())) == sorted(map(str, b[columns].values.tolist()))


def test_components_of_few_links_are_not_dealt_out(spark):
    from sylvanite.llm._run import cut
    from sylvanite.llm.components import components

    r = random.Random(3)
    order = r.sample(range(-500, 500), 1000)
    pairs = [*zip(order[:600], order[1:600]), *zip(order[600:], order[601:]), *((order[0], r.choice(order[:600])) for _ in range(200)), (7000, 7000)]
    least = {x: min(part) for part in (order[:600], order[600:]) for x in part}
    links = cut(spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in pairs], "a long, b long").repartition(8))
    sc = spark.sparkContext
    for group, few in (("dealt", 0), ("few", None)):
        sc.setJobGroup(group, group)
        rows = components(links, **({} if few is None else {"few": few})).collect()
        assert dict(map(tuple, rows)) == least and len(rows) == len(least)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert not components(links.limit(0)).count()
    # a count and the result itself; rounds over the shuffled links took over ten jobs
    assert len(sc.statusTracker().getJobIdsForGroup("few")) <= 4 < 10 < len(sc.statusTracker().getJobIdsForGroup("dealt"))
