"""Per-text operators: extraction, toxicity, quality, token counts, ids, packing, media."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from trailmark.llm import _text as X
from trailmark.llm import html_extract as H
from trailmark.llm import media as O
from trailmark.llm import packing as K
from trailmark.llm import quality as Q
from trailmark.llm import token_counts as T
from trailmark.llm import token_ids as I
from trailmark.llm import toxicity as FM
from trailmark.llm._encode import Encoder
from trailmark.llm.queries import vocabulary_file

TEXTS = [
    "", "  a", "a  b \n c\t", "İΣ ΑΣ naïve\x1f x", "don't we're 's 12345 x² ½", "a nb  sp", "á é ́x", "日本 語 テスト", "<|endoftext|> x", "\x00 \x01 a\x01", "ﬁ Ǆ ǆ",
    "tail ", "\n", "a\r\nb", "x y　z", "'S 'LL it'S", "Ⅷ ª º", "x, y. (z) a.b.c it's O'Neil", "ÀÉ ÉA, éa.", "one two one two", "\U0001f600 ok", None,
]


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(name, byte_level, monkeypatch):
    rng = random.Random(1)
    pieces = [t or "" for t in TEXTS] + ["the", "Word,", "x.y", "été", "Über", "42", "--", "a\nb"]
    texts = TEXTS + ["".join(rng.choice(pieces) + rng.choice([" ", " ", "", "  "]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += ["a<|endoftext|>b c", "<|startoftext|> x <|ENDOFTEXT|>", "y" * 50 + "<|endoftext|>"]
    e = Encoder(vocabulary_file(name), byte_level)
    assert e.known
    want = [x.ids for x in Tokenizer.from_file(vocabulary_file(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    some, edge = e._whole([t or "" for t in texts])
    assert [some[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == want
    from trailmark.llm import _encode

    for most in (10**6, 5):  # with a table that starts anew each time, too
        monkeypatch.setattr(_encode, "MOST_KEYS", most)
        for step in (len(texts), 7):
            for i in range(0, len(texts), step):
                ids, edge = e.encode(texts[i : i + step])
                assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == want[i : i + step]


def test_long_words_hash_the_same(monkeypatch):
    import pyarrow as pa

    whole = X.scan(*X.utf8(pa.array(["ab " + "q" * 5000 + " cd", "cd"])), X.NONSPACE).hash
    monkeypatch.setattr(X, "PIECE", 64)
    assert X.scan(*X.utf8(pa.array(["ab " + "q" * 5000 + " cd", "cd"])), X.NONSPACE).hash.tolist() == whole.tolist()
    assert whole[2] == whole[3]


def test_extraction_of_marked_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
      <header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- note --><div class="ad-box"><div>Buy</div>now</div>
      <article><h1>Head &amp; tail</h1><p>One <b>bold</b>&nbsp;word<br>here<p>Two<span class="advert">x</span></p><aside>side</aside><form>f</form>
      <div id="comments"><div>c1</div></div></article><p>after</p><footer>&copy; foot</footer></body>"""
    pages = spark.createDataFrame([(1, "http://a.b/c", page), (2, None, None), (3, "u", ""), (4, "u", "plain text &lt;b&gt; &am"), (4, "u", "plain text &lt;b&gt; &am")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in H.extract(pages).collect())
    want = "Head & tail\nOne bold word here\nTwo"
    assert got == [(1, want, len(want)), (2, "", 0), (3, "", 0), (4, "plain text <b> &am", 18), (4, "plain text <b> &am", 18)]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p class="ad">x<p>real text<p>more</article>', ["real text", "more"]),
        ('<article>a<div class="ad">x<p>y</article><article>second</article>', ["a", "second"]),
        ('<article>a<form>x<p>y</article><main>second<p>third</main>', ["a", "second", "third"]),
        ('<article><ul><li class="share">x<li>real item</ul><p>para</article>', ["real item", "para"]),
        ('<article><dl><dt>t<dd class="ad">x<dt>u<dd>v</dl></article>', ["t", "u", "v"]),
        ('<article><p>a <a class="advert">b <a>c</a></a> d <b class="sponsor">e</b></p><i id="ads">f</article><article>g', ["a d", "g"]),
        ('<article><section class="related-work">kept</section><div class="related-posts">x</div><h2 class="search-engines">s</h2><div class="search-box">x</div><p id="form-of-words">w</article>', ["kept", "s", "w"]),
        ('<main><table><tr><td>a<td class="ad">b<tr><td>c</div></table>d</main>', ["a", "c", "d"]),
        ('<article><div hidden>x</div><div role="search">x</div><p style="display: none">x</p><header>head</header></article><header>x</header>', ["head"]),
        ('<article><p>a &lt;b&gt; &#x41;&nbsp;\n c</p><script>var a="</p>";</script><br/>d<br>e</article>', ["a <b> A c", "d e"]),
        ("<article>one</article><p>two</p><article>three", ["one", "three"]),
        ("</div></article>open <p>text", ["open", "text"]),
        ("<div><nav>x</div>kept", ["kept"]),
    ],
)
def test_blocks_end_as_in_browsers(page, want):
    assert [t for role, t in H.blocks(page) if role != H.BOILERPLATE] == want


def test_the_array_decides_where_markup_does_not(spark):
    """Pages of two layouts without an article on three hosts, against a plain count of the blocks that pages share."""
    rng = random.Random(9)
    body = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, shown = [], {}
    for host in ("a", "b", "c"):
        menu, foot, often = body(9), body(12), body(10)
        for i in range(12):
            parts = [menu, body(30), often if i % 2 else body(10), body(15), foot]
            if host == "c":
                parts = [p for p in parts if p not in (menu, foot)]
            shown[len(rows)] = (host, parts)
            rows.append((len(rows), f"https://{host}.org/{i}", "".join(f"<div>{p}</div>" if i % 3 else f"<p>{p}" for p in parts)))
    count = {}
    for host, parts in shown.values():
        for p in set(parts):
            count[host, p] = count.get((host, p), 0) + 1
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == {i: "\n".join(p for p in parts if count[host, p] < 3) for i, (host, parts) in shown.items()}


def test_repeated_runs_are_cut_from_open_pages(spark):
    rng = random.Random(0)
    menu = "home about contact imprint help jobs press legal terms"
    body = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))
    texts = [body() for _ in range(8)]
    rows = [(i, f"http://{'a' if i < 6 else 'b'}.x/{i}", f"<div>{menu}</div><div>{t}</div>") for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == texts[i] for i in range(6))
    assert all(got[i] == f"{menu}\n{texts[i]}" for i in (6, 7))  # two pages of a host are not enough


def test_copies_and_quotations_stay(spark):
    rng = random.Random(1)
    menu = "home about contact imprint help jobs press legal terms"
    quoted = "to be or not to be that is the question whether"
    body = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))
    copy, line = body(), "this text is given away under the licence of the house"
    pages, want = [], []

    def add(host, shown, text):
        pages.append((len(pages), f"http://{host}/{len(pages)}", "".join(f"<div>{b}</div>" for b in shown)))
        want.append("\n".join(text))

    for _ in range(3):
        add("copies", [menu, copy], [menu, copy])  # copies are one page
    for i in range(60):  # a host of 60 pages that differ and 4 copies of one more
        text = body() + (f" {quoted} " if i % 2 else " ") + body()
        rare = [line] if i < 4 else []  # on more than PAGES pages, but on few of the host's
        add("hot", [menu, text, *rare], [text, *rare])
    for _ in range(4):
        add("hot", [menu, copy], [copy])
    add("hot", [menu], [menu])  # nothing else is on it
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract(table).collect()}
    assert [got[i] for i in range(len(pages))] == want


def test_one_repeated_run_covers_a_block(spark):
    """Pieces that different pages repeat do not make a block boilerplate; one run that the same pages have does."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    one, two, long_, menu = words(9), words(8), words(30), words(12)
    head, tail = " ".join(long_.split()[:20]), " ".join(long_.split()[10:])
    ends = [one] * 3 + [two] * 3 + [head] * 3 + [tail] * 3 + [f"{one} {two}", long_]
    bodies = [words(30) for _ in ends]
    rows = [(i, "http://h.org/x", f"<body><div>{menu}</div><p>{body}</p><div>{end}</div></body>") for i, (body, end) in enumerate(zip(bodies, ends, strict=True))]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: body if i < 12 else f"{body}\n{end}" for i, (body, end) in enumerate(zip(bodies, ends, strict=True))}


def test_suffix_runs_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        streams = [rng.integers(0, 3, rng.integers(0, 12)).astype(np.uint64) for _ in range(rng.integers(1, 5))]
        length = int(rng.integers(1, 6))
        order, new = H.suffix_runs(streams, length)
        flat = np.concatenate(streams)
        groups = {}
        for at, g in zip(order.tolist(), np.cumsum(new).tolist(), strict=True):
            groups.setdefault(g, []).append(at)
        want, base = {}, 0
        for s in streams:
            for i in range(len(s) - length + 1):
                want.setdefault(tuple(s[i : i + length].tolist()), []).append(base + i)
            base += len(s)
        assert sorted(map(sorted, groups.values())) == sorted(want.values())
        assert all(len({tuple(flat[i : i + length].tolist()) for i in g}) == 1 for g in groups.values())


def labelled(seed, n=700):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vile", "scum", "rotten"])
        poor = rng.random() < 0.3
        if poor:
            w = [x for x in w[:9] for _ in range(12)]
            toxic = False
        rows.append((i, " ".join(w)))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_classifiers_learn_and_keep_the_held_out_apart(spark, docs_of, odd_rows):
    rows, labels = labelled(3)
    table = spark.createDataFrame([*labels, (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows + [(i + 10_000, t) for i, t in odd_rows])
    for run, column in ((FM.toxicity, 2), (Q.quality, 1)):
        got = {r.doc_id: r for r in run(docs, table).collect()}
        held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
        assert all(got[x[0]].held_out for x in held) and not got[1 if zlib.crc32(b"1") % 5 else 2].held_out
        assert np.mean([got[x[0]].predicted == x[column] for x in held]) > 0.95
        assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows) + len({i for i, _ in odd_rows})
        flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
        again = {r.doc_id: r.score for r in run(docs, flipped).collect()}
        assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)
    model = FM.train(docs, table)
    kept = {r.doc_id for r in FM.keep_clean(docs, model).collect()}
    assert kept == {r.doc_id for r in FM.classify(docs, model).collect() if not r.predicted}


def test_dictionaries_take_all_short_texts(spark, docs_of, monkeypatch):
    """Only bytes bound the sample, not rows: here all texts fit."""
    seen = []
    monkeypatch.setattr(Q, "_dictionary", lambda texts: seen.append(texts) or b"".join(texts))
    monkeypatch.setattr(Q, "DICTIONARY_SAMPLE", 30_000)
    rows = [(i, f"short text number {i}") for i in range(400)]
    Q.train(docs_of(rows), spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int"))
    fitted = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(seen) == 2 and all(0.35 < 2 * len(texts) / len(fitted) < 0.65 for texts in seen)
    assert all(len(set(texts)) == len(texts) for texts in seen)


def test_classifiers_without_labels(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (FM.toxicity, Q.quality):
        assert run(docs_of(odd_rows), none).count() == len(odd_rows)
        assert run(docs_of([]), none).collect() == []


def test_machine_weighs_pairs():
    """Neither word says it alone; both together do."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([x for x, here in ((11, a), (22, b)) if here] + [int(v) for v in rng.integers(100, 105, 2)], "<u4"))
        y.append(int(a and b))
    model = FM.fit([np.unique(r) for r in rows], np.array(y))
    f = model["keep"][[11, 22]]
    assert (f >= 0).all() and float(model["v"][f[0]] @ model["v"][f[1]]) > 0


def test_machine_finds_terms_that_tell_in_pairs_only():
    """The label is whether just one of two words is there: neither word has any weight alone, and its linear part knows nothing."""
    rng = np.random.default_rng(4)
    rows, y = [], []
    for _ in range(5000):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique([x for x, here in ((11, a), (22, b)) if here] + [int(v) for v in rng.integers(100, 400, 6)]).astype("<u4"))
        y.append(int(a != b))
    y = np.array(y)
    model = FM.fit(rows[:4000], y[:4000])
    f = model["keep"][[11, 22]]
    assert (f >= 0).all() and float(model["v"][f[0]] @ model["v"][f[1]]) < -1
    linear = model | {"v": np.zeros_like(model["v"])}
    wide = lambda m: np.array([machine_score(m, r) >= 0.5 for r in rows[4000:]])
    assert (wide(model) == y[4000:]).mean() > 0.9 and (wide(linear) == y[4000:]).mean() < 0.8


def machine_score(model, buckets):
    """The machine's formula, pair by pair."""
    f = [int(model["keep"][b]) for b in sorted(set(map(int, buckets))) if model["keep"][b] >= 0]
    z = float(model["b"]) + sum(float(model["w"][i]) for i in f)
    z += sum(float(model["v"][i] @ model["v"][j]) for n, i in enumerate(f) for j in f[:n])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores_equal_their_formulas(spark, docs_of, odd_rows):
    """Scores of whole texts, recomputed word by word and by plain compression, for odd texts too."""
    import pyarrow as pa
    import zstandard

    rows, labels = labelled(8, 400)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = rows + [(i + 10_000, t) for i, t in odd_rows if i != 5] + [(20_000, " ".join(t for _, t in rows[:200]))]
    docs = docs_of(rows)
    model = FM.train(docs, table)
    got = {r.doc_id: r.score for r in FM.classify(docs, model).collect()}
    for i, t in rows:
        words = X.scan(*X.utf8(pa.array([t or ""])), X.ALNUM).hash
        assert abs(got[i] - machine_score(model, words >> np.uint64(64 - FM.BUCKET_BITS))) < 1e-9
    model = Q.train(docs, table)
    got = {r.doc_id: r.score for r in Q.classify(docs, model).collect()}
    cal = model["calibration"]
    for i, t in rows:
        raw = (t or "").encode()
        size = [len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(d)).compress(raw)) if d else len(zstandard.ZstdCompressor(level=Q.LEVEL).compress(raw)) for d in (model["good"], model["bad"], b"")]
        g, b, c, n = *size, len(raw) + 1
        x = np.array([(b - g) / c, (b - g) / n, (b - g) / (b + g), c / n, g / n, np.log(n)])
        z = cal["w"][0] + ((x - cal["mean"]) / cal["scale"]) @ cal["w"][1:]
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_keeping_stages_on_odd_tables(spark, docs_of):
    """Nulls in any column, empty texts, repeated rows, names that operators use, and empty tables."""
    rows = [(None, None), (None, "a b"), (1, ""), (1, ""), (2, "word " * 20_000), (3, "x")]
    docs = docs_of(rows)
    for name in ("y", "hit", "items", "value", "part"):
        docs = docs.withColumn(name, docs.doc_id)
    labels = spark.createDataFrame([(2, 1, 0), (3, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, "x"), (7, None), (8, "")], "item_id long, text string")
    from trailmark.llm import decontaminate as D

    for run in (lambda d: FM.keep_clean(d, FM.train(d, labels)), lambda d: Q.keep_good(d, Q.train(d, labels)), lambda d: D.keep_uncontaminated(d, items)):
        kept = run(docs)
        assert kept.columns == docs.columns
        assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
        assert run(docs.limit(0)).collect() == []


def brute_tokens(word, table, longest, low):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        options = [(best[e - 1][0] + low, best[e - 1][1] + 1)]
        options += [(best[e - n][0] + table[word[e - n : e]], best[e - n][1] + 1) for n in range(1, min(longest, e) + 1) if word[e - n : e] in table]
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][1]


def test_token_counts_equal_brute_force(docs_of, odd_rows):
    model = vocabulary_file("piece_bpe_32k.model")
    names, scores = T.vocabulary(model)
    table, longest, low = dict(zip(names, scores.tolist(), strict=True)), max(map(len, names)), float(scores.min()) - T.BYTE_COST
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, (_, t) in enumerate(odd_rows)]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in T.token_counts(docs_of(rows), model).collect()}
    for i, t in rows:
        words = T.pretokens(t or "")
        if sum(map(len, words)) < 5000:
            assert got[i] == (len(words), sum(brute_tokens(w, table, longest, low) for w in words))
        assert b"".join(words).replace(T.MARK, b"") == b"".join((t or "").encode().split()).replace(T.MARK, b"")
    assert T.token_counts(docs_of([]), model).collect() == []


def test_long_words_are_scored_whole(docs_of, odd_rows):
    """Words are split here, not by pretokens()."""
    model = vocabulary_file("piece_bpe_32k.model")
    names, scores = T.vocabulary(model)
    table, longest, low = dict(zip(names, scores.tolist(), strict=True)), max(map(len, names)), float(scores.min()) - T.BYTE_COST
    rng = random.Random(6)
    common = [n.decode() for n in names[:3000] if len(n) > 3 and T.MARK not in n]
    glued = ["".join(rng.choice(common) for _ in range(rng.randrange(60, 900))) for _ in range(8)]
    rows = list(enumerate([*glued, "a " + "日本語テスト" * 300 + " b", "é" * 257 + " " + "é" * 1000, "QUJD" * 700, " ".join(glued[:3] * 2)])) + [(100, odd_rows[6][1])]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in T.token_counts(docs_of(rows), model).collect()}
    for i, t in rows:
        words = [("▁" + w).encode() for w in t.split(" ")]
        assert got[i] == (len(words), sum(brute_tokens(w, table, longest, low) for w in words))
    pieces = T.Pieces(names, scores)
    short = [("▁" + w).encode() for w in [*common[:200], "naïve", "\U0001f600x", "zqxj"]]
    assert [T.long_count(w, pieces) for w in short] == T.trie_counts(short, pieces).tolist()


def test_unknown_tokenizers_go_through_the_library(tmp_path):
    t = Tokenizer.from_file(vocabulary_file("word_bpe_49k.json"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "other.json"))
    e = Encoder(str(tmp_path / "other.json"), False)
    assert not e.known
    ids, edge = e.encode(["it's x12.", None, "a  b"])
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [x.ids for x in t.encode_batch(["it's x12.", "", "a  b"], add_special_tokens=False)]


def ids_of(texts, name, end):
    t = Tokenizer.from_file(vocabulary_file(name))
    return [np.array([*x.ids, end], "<u4") for x in t.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark, docs_of, odd_rows, tmp_path):
    rows = sorted([(i * 7 - 20, t) for i, t in enumerate(TEXTS)] + [r for r in odd_rows if r[0] != 5] + [(500, "a"), (500, "b c")], key=lambda r: r[0])
    got = I.token_ids(docs_of(rows), str(tmp_path / "ids"), vocabulary_file("byte_bpe_50k.json"), shards=3).collect()
    ids = ids_of([t for _, t in rows], "byte_bpe_50k.json", 2)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    spans = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert [s for s, _, _ in spans] == np.cumsum([0] + [n for _, n, _ in spans])[:-1].tolist()
    assert [d for _, _, d in spans] == sorted(d for _, _, d in spans)
    shard = I.Shard((tmp_path / "ids" / "shard-00001.ids").read_bytes(), (tmp_path / "ids" / "shard-00001.mph").read_bytes())
    known = shard.doc_ids[:3]
    assert (shard.find(known, I._nth(known))[0] >= 0).all()
    assert (shard.find(np.arange(10**9, 10**9 + 1000), np.zeros(1000, np.int64))[0] == -1).all()
    hot = docs_of([(9, f"t{i}") for i in range(400)] + [(None, "n")] * 300)  # an id that most rows share goes on over shards
    again = I.token_ids(hot, str(tmp_path / "hot"), vocabulary_file("byte_bpe_50k.json"), shards=4).collect()
    spans = sorted((r.start, r.n_tokens) for r in again)
    assert len(again) == 700 and [a for a, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist()
    assert I.token_ids(docs_of([]), str(tmp_path / "none"), vocabulary_file("byte_bpe_50k.json"), shards=2).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 100, 20_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        slots = I.PerfectHash.build(keys).slots(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError, match="distinct"):
        I.PerfectHash.build(np.array([5, 5], np.uint64))


def test_ogg_round_trip_and_damage(docs_of, odd_rows):
    for n in (0, 1, 192, 193, 1536, 3072, 40_000, 300_000):
        payload = O.padded(bytes(i % 251 for i in range(n)))
        media = O.encode(payload)
        assert len(payload) % 192 == 0 and payload and O.decode(media)[0] == payload
        for at in (30, len(media) // 2, len(media) - 1):
            with pytest.raises(ValueError):
                O.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
        with pytest.raises(ValueError):
            O.decode(media[:-5])
    # the checksum of a page of zeros with the header "OggS", worked out bit by bit
    crc = 0
    for byte in b"OggS" + bytes(40):
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert O.ogg_crc(b"OggS" + bytes(40)) == crc
    got = O.read_ogg(O.to_ogg(docs_of(odd_rows))).collect()
    assert sorted((r.doc_id, r.payload_sha256) for r in got) == sorted((i, hashlib.sha256(O.padded((t or "").encode())).hexdigest()) for i, t in odd_rows)
    assert O.read_ogg(O.to_ogg(docs_of([]))).collect() == []


def plain_ogg(media):
    """Another reader of the container: pages by their magic, a bit-by-bit checksum, packets by lacing, streams by serial number."""
    def crc_of(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        return crc

    at, pages, streams = 0, 0, {}
    while at < len(media):
        assert media[at : at + 4] == b"OggS"
        n = media[at + 26]
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        assert crc_of(media[at : at + 22] + bytes(4) + media[at + 26 : end]) == int.from_bytes(media[at + 22 : at + 26], "little")
        packets = streams.setdefault(int.from_bytes(media[at + 14 : at + 18], "little"), [b""])
        place = at + 27 + n
        for v in lacing:
            packets[-1] += media[place : place + v]
            place += v
            if v < 255:
                packets.append(b"")
        at, pages = end, pages + 1
    whole = {s: p[:-1] for s, p in streams.items()}
    turns = max(len(p) for p in whole.values()) - 1
    sound = b"".join(whole[s][i + 1] for i in range(turns) for s in sorted(whole) if i + 1 < len(whole[s]))
    return sound, pages, sum(len(p) - 1 for p in whole.values())


def test_media_features_by_another_reader(docs_of, odd_rows):
    docs = docs_of([r for r in odd_rows if len(r[1] or "") < 100_000 and r[0] != 5])
    stored = O.to_ogg(docs)
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in O.read_ogg(stored).collect():
        sound, pages, packets = plain_ogg(files[r.doc_id])
        cross = sum((a < 128) != (b < 128) for a, b in zip(sound, sound[1:]))
        want = f"streams=2;pages={pages};packets={packets};seconds={len(sound) / 8000:.3f};mean={sum(sound) / len(sound):.4f};peak={max(sound)};crossings={cross}"
        assert r.feature == want and r.payload_sha256 == hashlib.sha256(sound).hexdigest() and r.tail_crc32 == zlib.crc32(sound[-16:])


def test_packing(docs_of, odd_rows):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x1", "été"]) for _ in range(int(rng.expovariate(1 / 400))))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(2000 + i, t) for i, t in odd_rows if i != 5] + [(3000, "same")] * 40
    got = K.pack(docs_of(rows), vocabulary_file("word_bpe_49k.json")).toPandas()
    ids = dict(zip([i for i, _ in rows], ids_of([t for _, t in rows], "word_bpe_49k.json", 1), strict=True))
    for i, part in got[got.doc_id != 3000].groupby("doc_id"):
        part = part.sort_values("start")
        assert part.start.tolist() == (part.length.cumsum() - part.length).tolist() and part.length.sum() == len(ids[i]) == part.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[i][a : a + n].tobytes()) == c for a, n, c in zip(part.start, part.length, part.ids_crc32, strict=True))
    assert (got.doc_id == 3000).sum() == 40 and set(got.doc_id) == set(ids)
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert by.length.sum().max() <= 2048 and sorted(by.groups) == list(range(len(by)))
    assert all(p.offset.tolist() == (p.length.cumsum() - p.length).tolist() for _, p in by)
    assert 1 - got.length.sum() / (2048 * len(by)) < 0.03
    assert K.pack(docs_of([]), vocabulary_file("word_bpe_49k.json")).collect() == []


def test_plans_cover_the_demand():
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 5000):
        demand = {}
        for s in np.minimum(rng.integers(1, 65, n), 64).tolist():
            demand[s] = demand.get(s, 0) + 1
        patterns = K.plan(demand, 64)
        held = {}
        for pattern, times in patterns:
            assert sum(s * c for s, c in pattern.items()) <= 64
            for s, c in pattern.items():
                held[s] = held.get(s, 0) + c * times
        assert held == demand
        used, least = sum(t for _, t in patterns), -(-sum(s * c for s, c in demand.items()) // 64)
        assert used <= least * 1.05 + 8
    assert K.plan({}, 64) == []


def test_price_is_the_best_knapsack():
    values, best = np.array([0.2, 0.5, 0.9]), 0
    sizes = np.array([3, 5, 8])
    for a in range(8):
        for b in range(5):
            for c in range(4):
                if 3 * a + 5 * b + 8 * c <= 23:
                    best = max(best, 0.2 * a + 0.5 * b + 0.9 * c)
    value, pattern = K.price(values, sizes, 23)
    assert abs(value - best) < 1e-9 and abs(pattern @ values - best) < 1e-9 and pattern @ sizes <= 23
