"""The n-gram join, decontamination and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from trailmark.llm import components as C
from trailmark.llm import decontaminate as D
from trailmark.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def mutated(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def corpus(seed, groups=12, copies=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([9, 14, 40, 150, 400]))]
        for _ in range(copies):
            w = mutated(rng, base, rng.randrange(0, max(2, len(base) // 30)))
            if rng.random() < 0.3:
                w = w + passage
            rows.append((rng.randrange(10**6) * 1000 + n, " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("seed", [0, 1])
def test_join_equals_brute_force(docs_of, k, num, seed):
    rows = corpus(seed)
    got = J.ngram_join(docs_of(rows), k=k, num=num, den=100).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, k, num, 100)


def test_join_with_common_grams(docs_of, monkeypatch):
    """Most n-grams count as common, so most sets are cut twice."""
    monkeypatch.setattr(J, "COMMON", 4)
    rows = corpus(7, groups=8, copies=9)
    got = J.ngram_join(docs_of(rows), k=3, num=90, den=100).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 3, 90, 100)


def test_common_grams_are_counted_on_all_documents(spark, monkeypatch):
    """No sample decides which n-grams are common: a map made from all texts has the same bits."""
    monkeypatch.setattr(J, "COMMON", 3)
    monkeypatch.setattr(J, "MARK_SAMPLE", 50, raising=False)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", "aa"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    grams, first = J.sets(*J.X.utf8(J.pa.array(texts, J.pa.string())), 5)
    names, times = np.unique(grams, return_counts=True)
    assert (times >= 3).any() and (times < 3).any()
    bitmap = J.common_grams(docs, spark.createDataFrame([(len(grams),)], "n_shingles long"), 5)
    assert (J._marked(names, bitmap) == (times >= 3)).all()


def test_join_with_small_blocks(docs_of, monkeypatch):
    """Clusters of many blocks: every pair of blocks is looked at."""
    monkeypatch.setattr(J, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = [(i, " ".join(mutated(rng, base, rng.randrange(0, 9)))) for i in range(60)]
    got = J.ngram_join(docs_of(rows), k=3, num=90, den=100).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 3, 90, 100)


@pytest.mark.parametrize("block", [4, 16])
def test_join_of_large_clusters(docs_of, spark, monkeypatch, block):
    """A hot cluster of many blocks with a chain through it, sets that are apart from it, and several partitions."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "FEW", 1 if block == 4 else 2)
    rng = random.Random(block)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    rows = [(i, " ".join(mutated(rng, base, rng.randrange(0, 6)))) for i in range(50)]
    far = list(base)
    for i in range(30):  # a chain that leads away, each text linked with its neighbours
        far = mutated(rng, far, 5)
        rows.append((100 + i, " ".join(far)))
    rows += [(200 + i, " ".join(mutated(rng, base, 60))) for i in range(20)]  # share segments, but are linked with nothing
    rows += [(300 + i, rows[i][1]) for i in range(0, 50, 7)]
    rng.shuffle(rows)
    got = J.ngram_join(docs_of(rows).repartition(5), k=3, num=90, den=100).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 3, 90, 100)


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    """A first hash of two values only: all sets share it, and the second one tells them apart."""
    import pyarrow as pa

    true = J._identity
    monkeypatch.setattr(J, "_identity", lambda g, f, salt: true(g, f, salt) & 1 if salt == 0x5851F42D4C957F2D else true(g, f, salt))
    texts = [t for _, t in corpus(3, groups=6, copies=4)] + ["a b c"] * 2
    grams, first = J.sets(*J.X.utf8(pa.array(texts)), 3)
    rows = [(i, 1, int(a), int(b), b"") for i, (a, b) in enumerate(zip(J.nodes(grams, first), J.checks(grams, first), strict=True))] + [(99, 0, None, None, b"")]
    light, twins = J._told_apart(spark.createDataFrame(rows, "doc_id long, n_shingles long, node long, check long, sketch binary"))
    assert twins.tolist() == [0, 1]
    got = {r.doc_id: r.node for r in light.collect()}
    assert got[99] is None and [got[i] for i in range(len(texts))] == J.nodes(grams, first, twins).tolist()
    assert len({got[i] for i in range(len(texts))}) == len(set(texts))


def test_keep_one_with_clashing_names(docs_of):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")]
    for names in (("_gone", "_node", "_id"), ("_GONE", "_Node", "root"), ("node", "least", "cluster")):
        for ids in (rows, [*rows, (3, "m n o p q r")]):
            docs = docs_of(ids)
            for n in names:
                docs = docs.withColumn(n, docs.doc_id * 2)
            kept = J.keep_one(docs)
            assert kept.columns == docs.columns
            assert sorted((r.doc_id, r[names[0]]) for r in kept.collect()) == sorted((i, 2 * i) for i, _ in ids if i != 2)


def test_join_of_odd_rows(docs_of, odd_rows):
    got = sorted(map(tuple, J.ngram_join(docs_of(odd_rows), k=3, num=90, den=100).collect()))
    assert got == brute_components(odd_rows, 3, 90, 100)
    assert J.ngram_join(docs_of([]), k=3).collect() == []


def test_every_linked_pair_shares_a_segment():
    rng = np.random.default_rng(3)
    for num in (80, 90):
        for n in (10, 12, 25, 60, 300, 3000):
            for _ in range(30):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                gone = rng.integers(0, max(1, int(n * (100 - num) / 100)) + 1)
                b = np.unique(np.concatenate([a[gone // 2 :], rng.integers(0, 2**64, gone - gone // 2, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if both == len(a) == len(b) or 100 * both < num * (len(a) + len(b) - both):
                    continue
                grams, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                for share in (None, 0, 1, 4, 7):  # whatever n-grams count as common
                    common = None if share is None else np.full(1 << J.MARK_BITS >> 3, (1 << share) - 1, np.uint8)
                    s, who = J.segments(grams, first, num, 100, common)
                    assert set(s[who == 0].tolist()) & set(s[who == 1].tolist())


def test_strangers_seldom_meet():
    """Unlike sets that share single n-grams by chance are not tied together, or a table's clusters would grow with its square."""
    rng = np.random.default_rng(5)
    arrays = [np.unique(J.X.mix(rng.integers(0, 40_000, 300).astype(np.uint64))) for _ in range(400)]
    grams, first = np.concatenate(arrays), np.cumsum([0, *map(len, arrays)])
    for num in (80, 90):
        s, who = J.segments(grams, first, num, 100)
        _, key, times = np.unique(s, return_inverse=True, return_counts=True)
        assert np.isin(np.arange(400), who).all()
        assert len(np.unique(who[times[key] > 1])) < 80


def test_screen_keeps_every_linked_pair():
    rng = np.random.default_rng(8)
    for num in (80, 90):
        for n in (1, 12, 90, 130, 700, 9000):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            for part in (0, 0.03, 0.1, 0.15, 0.5):
                gone = int(n * part)
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, int(gone * rng.random()), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                rows = J.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                found = J.screen([1, 2], [(len(a), rows[0]), (len(b), rows[1])], num, 100)
                if 100 * both >= num * (len(a) + len(b) - both):
                    assert found == [(1, 2)]
                elif part == 0.5 and n > 50:
                    assert not found
    assert J.screen([1, 2], [(900, b""), (900, b"x" * 256)], 80, 100) == [(1, 2)]


def test_keep_one(docs_of):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, ""), (4, "p q r s t u v"), (5, None), (1, "k l m n o p")]
    kept = sorted((r.doc_id, r.text) for r in J.keep_one(docs_of(rows)).collect() if r.text)
    assert kept == [(1, "a b c d e f g h"), (1, "k l m n o p"), (4, "p q r s t u v")]
    assert J.keep_one(docs_of(rows)).columns == docs_of(rows).columns
    assert J.keep_one(docs_of(rows)).count() == 5


def chain(tag):
    """Three texts of which the first and the last are linked only through the second."""
    words = [f"{tag}{i}" for i in range(100)]
    return [" ".join(words[i : i + 84]) for i in (0, 8, 16)]


@pytest.mark.parametrize(
    ("some", "none"),
    [
        ([(2, chain("a")[0]), (1, chain("a")[2]), (9, "p q r s t u v")], [chain("a")[1]]),  # a single null id, no repeats
        ([(2, chain("a")[0]), (1, chain("a")[2]), (9, "p q r s t u v"), (7, chain("d")[1])], [chain("a")[1], chain("d")[0], *chain("b"), "k l m n o p", "k l m n o p", "p q r s t u v", "", None]),
        ([(3, "a b c d e f"), (4, "g h i j k l"), (4, "m n o p q r")], [chain("c")[0], chain("c")[1]]),  # with repeated ids
        ([], [*chain("e"), "x y z", "", None]),  # nothing but null ids
        ([(3, "a b c d e f"), (5, "a b c d e f"), (5, ""), (6, None)], []),  # an id of a row that goes, and of one without words
    ],
)
def test_null_ids_are_linked_and_lose_nothing(docs_of, some, none):
    far = 10**9  # brute force sees null ids as the greatest
    rows = some + [(far + i, t) for i, t in enumerate(none)]
    null = lambda i: None if i >= far else i
    key = lambda r: [(x is None, x or 0) for x in r]
    brute = brute_components(rows, 5, 80, 100)
    docs = docs_of([(null(i), t) for i, t in rows])
    got = sorted(map(tuple, J.ngram_join(docs, k=5, num=80, den=100).collect()), key=key)
    want = sorted(((null(i), n, null(c) if n else null(i)) for i, n, c in brute), key=key)
    assert got == want
    kept = [(r.doc_id, r.text) for r in J.keep_one(docs).collect()]
    assert sum(not t for _, t in kept) == sum(n == 0 for _, n, _ in brute)
    # of each component one row, with the least id
    least = [c for _, n, c in brute if n]
    assert sorted((i for i, t in kept if t and i is not None)) == sorted(i for i in (some_least(rows, least)) if i < far)
    assert sum(bool(t) and i is None for i, t in kept) == len({c for c in least if c >= far})
    whole = {t for _, t in kept if t}
    assert len(whole) == sum(bool(t) for _, t in kept)


def some_least(rows, least):
    """The least ids, once for each component: rows of one id with unlike texts are components of their own."""
    texts = {}
    for i, t in rows:
        if t:
            texts.setdefault(i, set()).add(t)
    return [i for i in sorted(set(least)) for _ in range(len(texts[i]))]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 440)]
    root = list(range(500))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges for i in e if find(i) != i}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_hits(text, items, window):
    words = ITEM.findall(lower(text))
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = ITEM.findall(lower(t))
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            for q in range(len(words) - n + 1):
                if words[q : q + n] == w[p : p + n]:
                    hit[q : q + n] = [True] * n
                    found.add(str(item))
    return len(words), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, docs_of, odd_rows, block):
    rng = random.Random(block)
    word = lambda: rng.choice(["The", "of", "ÉTÉ", "a1", "b", "c", "d"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(12)] + [(50, ""), (51, None), (52, "one")]
    rows = [(100 + i, ", ".join(word() for _ in range(rng.choice([2, 9, 40])))) for i in range(25)]
    rows += [(200 + i, "x y " + (items[i][1] or "").upper() + " z") for i in range(12)]
    rows += [r for r in odd_rows if len(r[1] or "") < 1000]
    got = D.decontaminate(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).drop("items")
    want = sorted((i, *brute_hits(t, items, 10)) for i, t in rows)
    assert sorted(map(tuple, got.collect())) == want
    kept = D.keep_uncontaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[-1])


def test_many_blocks_of_items(spark, docs_of, monkeypatch):
    """More tables than are held at a time: what is found so far is written on the way."""
    monkeypatch.setattr(D, "TABLES", 2)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(9)]
    rows = [(i, f"x {items[i % 9][1]} y " + (items[0][1] if i % 2 else "")) for i in range(20)] + [(99, "clean")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(docs_of(rows), table, block_bytes=60).drop("items")
    assert sorted(map(tuple, got.collect())) == sorted((i, *brute_hits(t, items, 10)) for i, t in rows)
    assert [r.doc_id for r in D.keep_uncontaminated(docs_of(rows), table, block_bytes=60).collect()] == [99]


def test_decontamination_of_nothing(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in D.decontaminate(docs_of(odd_rows), none).collect())
    assert D.decontaminate(docs_of([]), none).collect() == []


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = rng.integers(0, 50, 10).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 50, rng.integers(0, 9)).astype(np.uint64), shared, rng.integers(0, 50, 5).astype(np.uint64)])
        b = np.concatenate([rng.integers(50, 99, rng.integers(0, 9)).astype(np.uint64), shared, rng.integers(50, 99, 5).astype(np.uint64)])
        prints = [set(D.winnow(x, np.array([0, len(x)]), 5, 6)[1].tolist()) for x in (a, b)]
        assert prints[0] & prints[1]
