"""Classifiers by held-out accuracy, fingerprints and neighbours against plain versions, the pipeline stage by stage."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from matrixlake.llm import imatch, language, neighbours, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def label_map(spark, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_on_held_out_documents(spark):
    rows, labels = queries.op1_quality(spark, SF).collect(), label_map(spark, "quality")
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_toxicity_on_held_out_documents(spark):
    rows, labels = queries.op10_toxicity(spark, SF).collect(), label_map(spark, "toxic")
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_on_held_out_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in queries.op6_language(spark, SF).collect() if r.held_out]
    assert all(crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.97 * len(held)


ODD = [(1, None), (2, ""), (3, "123 ... !"), (4, "some words " * 30_000), (5, "some"), (5, "some"), (None, "no id here")]


def odd(spark):
    return spark.createDataFrame([(d, t, "en", "x") for d, t in ODD], "doc_id bigint, text string, lang string, score string")


@pytest.mark.parametrize("labels", [[], [(4, 1, 0)], [(4, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (2, None, None), (3, 7, 7)]])
def test_classifiers_take_odd_rows(spark, labels):
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for scores in (quality.scores, toxicity.scores):
        rows = scores(odd(spark), table).collect()
        assert len(rows) == len(ODD)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
        assert scores(odd(spark).limit(0), table).collect() == []
    assert toxicity.without_toxic(odd(spark), table).columns == odd(spark).columns


def test_language_of_odd_rows(spark):
    rows = language.predictions(odd(spark)).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in rows if r.doc_id in (1, 2, 3)) == [(1, "und"), (2, "und"), (3, "und")]
    assert all(r.lang_pred == "en" for r in rows if r.doc_id in (4, 5))
    assert language.predictions(odd(spark).limit(0)).collect() == []
    whole, cut = "aé Bc d" * 5, language.SLICE
    language.SLICE = 4
    try:
        pieces = language.grams(whole)
    finally:
        language.SLICE = cut
    assert all((a == b).all() for a, b in zip(pieces, language.grams(whole), strict=True))


def plain_match(word, terms):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    edits = [e for t, stem, most in terms for e in [min(distance(word[:n], t) for n in range(len(word) + 1)) if stem else distance(word, t)] if e <= most]
    return min(edits, default=None)


def test_automaton_against_edit_distance():
    rng = random.Random(5)
    terms = [("idiot", False, 1), ("clown", False, 1), ("abc", False, 0), ("réeux", True, 0), ("achlichkeit", True, 1), ("abcabc", False, 2)]
    a = toxicity.Automaton(terms)
    words = ["idiot", "idiots", "idot", "iidiot", "idxot", "clwon", "abc", "abcd", "réeuxpa", "reeuxpa", "achlichkeiten", "achlchkeiten", "abab", "x"]
    for _ in range(500):
        w = list(rng.choice(terms)[0] + rng.choice(["", "", "en"]))
        for _ in range(rng.choice([0, 1, 2, 3])):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.choice([0, 1])] = rng.choice(["", "z", "a", "é"])
        words.append("".join(w))
    words = [w for w in words if w]
    letters = np.array([ord(c) for c in " ".join(words)], np.uint32)
    letters[letters == 32] = 0
    got = a.read(letters, *toxicity.spans(letters))
    assert [None if g < 0 else int(g) % 4 for g in got] == [plain_match(w, terms) for w in words]


def test_misspelled_words_under_a_stem_are_found():
    counts = [("idiot", False, 20), ("idiots", False, 20), ("idiotic", False, 20), ("idiot", True, 40), ("idio", True, 60), ("scum", False, 20)]
    terms = toxicity.choose([Row(term=t, stem=s, toxic=n, clean=0) for t, s, n in counts], 100, 1000)
    assert any(stem for _, stem, _ in terms)
    words = ["idiot", "idiots", "idiotically", "idoiot", "ixiots", "idxotic", "scum", "scam"]
    letters = np.array([ord(c) for c in " ".join(words)], np.uint32)
    letters[letters == 32] = 0
    got = toxicity.Automaton(terms).read(letters, *toxicity.spans(letters))
    assert [None if g < 0 else int(g) % 4 for g in got] == [0, 0, 0, 1, 1, 1, 0, None]


def test_quotation_is_told_from_abuse():
    text = 'you idiot. ... ' + "bla " * 30 + '"idiot" ' + "bla " * 30 + "he said idiot"
    _, _, _, quoted, reported = toxicity.slice_hits(toxicity.Automaton([("idiot", False, 1)]), [text])
    assert quoted.tolist() == [False, True, False]
    assert reported.tolist() == [False, False, True]


def test_fingerprints(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgé") for _ in range(5)) for _ in range(60)]
    texts = {3 * i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for i in range(60)}
    texts |= {500: None, 501: "", 502: texts[3], 503: "One"}
    df = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id bigint, text string, marks string").repartition(7)
    got = {r.doc_id: r for r in imatch.fingerprints(df).collect()}
    ids = sorted(texts)
    for i, d in enumerate(ids):
        own, following = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        k = len(own) // 4
        assert got[d].n_chars == len(own)
        assert got[d].edited_sha256 == hashlib.sha256((own[: len(own) - k] + following[:k]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[502].fingerprint == got[3].fingerprint
    assert got[500].fingerprint == got[501].fingerprint and got[500].near_next == 1
    one = imatch.fingerprints(df.filter("doc_id = 3")).collect()[0]
    assert one.near_next == 1
    assert imatch.fingerprints(df.limit(0)).collect() == []
    twice = imatch.fingerprints(spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (None, "c", "x")], "doc_id bigint, text string, marks string")).collect()
    assert len(twice) == 3


def slot(word):
    return xxhash.xxh64_intdigest(word.encode(), seed=42)


def chained(words, last=()):
    h = 42
    for w in [*words, *last]:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return f"{h:016X}"[:8]


def plain_imatch(texts):
    """Fingerprints of texts and edited texts with the lexicon of the texts: one list a text."""
    words_of = lambda t: sorted({w for w in re.split(r"[^\w]+|_", t.lower()) if w}, key=str.encode)
    count = Counter(s for t in texts for s in {slot(w) % (1 << 20) for w in words_of(t)})
    low, high = max(2, 0.0002 * len(texts)), max(0.05 * len(texts), 2)

    def marks(text):
        words = words_of(text)
        terms = [w for w in words if low <= count[slot(w) % (1 << 20)] <= high]
        bare = "-" if not text else "~" + chained(words, ["" if words else text])
        out, at = [chained(terms) if terms else bare], 20
        for bits in (3, 5, 7, 9):
            for j in range(8):
                part = [w for w in terms if (slot(w) >> at) & ((1 << bits) - 1) == j]
                out.append(chained(part) if part else "-")
            at += bits
        return out

    return marks


def plain_likeness(a, b):
    levels = [0.0]
    for k in range(4):
        pairs = [(x, y) for x, y in zip(a[1 + 8 * k : 9 + 8 * k], b[1 + 8 * k : 9 + 8 * k], strict=True) if (x, y) != ("-", "-")]
        levels.append(sum(x == y for x, y in pairs) / max(len(pairs), 4))
    return 1.0 if a == b else max(levels)


def test_fingerprints_against_plain_imatch(spark):
    """Ids that are null, repeated and clustered; texts without terms in the band or without words."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    ids = [None] * 90 + [7] * 60 + list(range(10**12, 10**12 + 100)) + [-5, 3]
    rows = [(d, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 150])))) for d in ids]
    rows += [(20, "!!!"), (21, "???"), (22, ""), (23, None), (24, "zz"), (25, "yy"), (26, "zz"), (27, "word " * 40_000)]
    rows[100] = rows[101]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, marks string, range int").repartition(5)
    order = sorted([(d is not None, d or 0, (t or "")) for d, t in rows], key=lambda r: (r[0], r[1], r[2].encode()))
    texts = [t for _, _, t in order]
    marks, want = plain_imatch(texts), []
    for i, (known, d, t) in enumerate(order):
        after, k = texts[(i + 1) % len(texts)], len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        a, b = marks(t), marks(edited)
        want.append((str(d if known else None), len(t), hashlib.sha256(edited.encode()).hexdigest(), ":".join(a), ":".join(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, marks(after)), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in imatch.fingerprints(df).collect()]
    assert sorted(got) == sorted(want)


def test_trees_and_statistics_against_plain_versions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(np.float64)
    model = quality.train(x, y, trees=12)
    for row, got in zip(x[:200], model.score(x[:200]), strict=True):
        total = model.base
        for feature, cut, value in zip(model.feature, model.cut, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += value[node - len(feature)]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-12
    # the first split of a tree is the best of all cuts at the quantiles
    p, best = y.mean(), (-1.0, None)
    g, h = p - y, np.full(len(y), p * (1 - p))
    for f in range(5):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1], method="lower")):
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) >= quality.LEAF_ROWS:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE) for m in (low, ~low)) - g.sum() ** 2 / (h.sum() + quality.RIDGE)
                best = max(best, (round(float(gain), 9), (f, float(cut))))
    assert best[1] == (model.feature[0, 0], model.cut[0, 0])
    texts = ["Some words, some more words! THE END.\n", "", "a a a a", "é|#1 2"]
    raw = [t.encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for row, text in zip(got, texts, strict=True):
        value, words = dict(zip(quality.NAMES, row.tolist(), strict=True)), text.split()
        assert np.isclose(value["chars"], np.log1p(len(text))) and np.isclose(value["words"], np.log1p(len(words)))
        count = Counter(w.lower() for w in words)
        assert np.isclose(value["distinct"], len(count) / max(len(words), 1)) and np.isclose(value["top_word"], max(count.values(), default=0) / max(len(words), 1))
        assert np.isclose(value["same_as_last"], sum(a.lower() == b.lower() for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1))
        assert np.isclose(value["upper_words"], sum("A" <= w[0] <= "Z" for w in words) / max(len(words), 1))


def test_language_against_plain_rank_order():
    texts = {"en": "the quick brown fox jumps over the lazy dog and the cat", "de": "der schnelle braune Fuchs springt über den faulen Hund und die Katze"}

    def profile(text, size):
        count = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"\1{w}\1"
            for n in (1, 2, 3):
                count.update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != "\1")
        for a in ("\1",):
            count.pop(a, None)
        number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return [number(g) for g in sorted(count, key=lambda g: (-count[g], number(g)))[:size]]

    size = 60
    ranks = {k: profile(t, size) for k, t in texts.items()}
    assert {k: language.ranked(*language.grams(t), size).tolist() for k, t in texts.items()} == ranks
    known = language.Profiles(ranks, size)
    for text in ["the dog over the fox", "die Katze springt", "zzz 12 qq", "x", "!"]:
        mine, far = profile(text, size), {}
        for lang, ranked in ranks.items():
            far[lang] = sum(abs(ranked.index(g) - i) if g in ranked else size for i, g in enumerate(mine)) / (size * max(len(mine), 1))
        got = known.judge(text)
        if not mine:
            assert got == ("und", 0.0)
            continue
        best, other = sorted(far, key=lambda k: (far[k], k))
        assert got[0] == best and np.isclose(got[1], (far[other] - far[best]) / far[other])


def test_toxic_scores_against_plain_version():
    terms = [("idiot", False, 1), ("scum", False, 0), ("moro", True, 0)]
    weight = np.array([[3.0, 1.5, 0, 0], [2.0, 0, 0, 0], [1.0, 0, 0, 0]])
    model = toxicity.Model(terms, weight, np.array([0.5, 0.4, 0.3, -0.2, -0.1, 0.2, 0.1, -0.3, -1.0]), 0.5)
    texts = ["you idiot, you scum and moron", 'he is no "idiot" at all', "she said idot yesterday", "", "clean words only", "idiot " * 9, "“scum” and scum"]
    got = model.score(texts)
    for text, score in zip(texts, got, strict=True):
        hits = []
        for m in re.finditer(r"[^\W\d_]+", text):
            word, best = m[0].lower(), None
            for k, (term, stem, most) in enumerate(terms):
                e = plain_match(word, [(term, stem, most)])
                if e is not None and (best is None or e < best[1]):
                    best = (k, e)
            if best:
                a, b = max(0, m.start() - toxicity.WINDOW), min(len(text), m.end() + toxicity.WINDOW)
                marks = [i for i, c in enumerate(text) if c in "\"«»“”„‟‹›" and a <= i < b]
                left, right = [i for i in marks if i < m.start()], [i for i in marks if i >= m.start()]
                quoted = bool(right) and (len(left) % 2 == 1 or bool(left) and right[0] - left[-1] <= toxicity.WINDOW)
                hits.append((best[0], weight[best], quoted, bool(toxicity.REPORTS.search(text[a : m.start()]))))
        number = len(re.findall(r"[^\W\d_]+", text))
        calm = [w for _, w, q, r in hits if not q and not r]
        x = [max([w for _, w, _, _ in hits], default=0), max(calm, default=0), np.log1p(sum(calm)), np.log1p(sum(w for _, w, q, _ in hits if q)), np.log1p(sum(w for _, w, q, r in hits if r and not q)), np.log1p(sum(calm) / max(number, 1) * 100), np.log1p(sum(weight[k, 0] for k in {k for k, _, _, _ in hits})), np.log1p(number) / 10, 1]
        assert np.isclose(score, 1 / (1 + np.exp(-np.dot(x, model.beta)))), text


def test_the_graph_finds_the_lists_of_many_vectors():
    """200,000 vectors in 1,562 lists, by the walk, the ratio and the replicas; recall against all cosines."""
    x = np.random.default_rng(1).normal(size=(200_000, 64)).astype(np.float32)
    u = neighbours.unit(x.astype(np.float64))
    c = neighbours.centroids(u[:20_000], len(u) // neighbours.LIST_ROWS)
    row, to = [], []
    for i in range(0, len(u), 2048):
        r, t, _ = neighbours.members(u[i : i + 2048], c)
        row.append(r + i)
        to.append(t)
    row, to = np.concatenate(row), np.concatenate(to)
    by = np.argsort(to, kind="stable")
    row, cuts = row[by], np.searchsorted(to[by], np.arange(len(c) + 1))
    graph, own, hits = neighbours.Graph(c), np.diff(cuts), 0
    for q in range(0, 200_000, 8_000):
        read = np.concatenate([row[cuts[j] : cuts[j + 1]] for j in neighbours.chosen(graph, u[q], own)])
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argpartition(-s, 5)[:5].tolist()) & set(read.tolist()))
    assert hits >= 0.9 * 5 * 25


def exact(rows, every, k):
    valid = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    out = {}
    for i, v in valid:
        if i % every == 0:
            found = {(j, float(neighbours.cosine(np.array([v], np.float32), np.array([w], np.float32))[0])) for j, w in valid if j != i}
            out[i] = sorted(found, key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(2000, None), (2050, [0.0] * 8), (2100, [1.0, None] + [0.0] * 6), (2150, [float("nan")] * 8), (2200, [1.0] * 3), (rows[0][0], rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int").repartition(4)
    want, got = exact(rows, 50, 5), {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    assert [x[0] for x in want[1000]] == [got[1000][n][0] for n in range(1, 6)] == [5, 1001, 1002, 1003, 1004]
    hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q].values()}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    few = {r.vec_id for r in neighbours.nearest(df.filter("vec_id in (0, 3, 7)")).collect()}
    assert few == {3, 7}
    assert neighbours.nearest(df.limit(0)).collect() == []


def test_recall_on_the_given_vectors(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    u = neighbours.unit(np.stack(d.embedding.values).astype(np.float64))
    got = {}
    for r in queries.op7_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert hits >= 0.9 * 5 * len(got)


def test_queries_as_far_from_all_lists_read_all_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 16)  # 750 lists, all within the ratio of these queries
    x = np.random.default_rng(9).normal(size=(12_000, 64))
    x[:, 52:] = 0
    x[::1000] *= 0.3
    x[np.arange(12) * 1000, 52 + np.arange(12)] = 7  # each in a direction of its own
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>").repartition(8)
    u, got = neighbours.unit(x.astype(np.float64)), {}
    for r in neighbours.nearest(df, every=1000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = u[::1000] @ u.T
    s[np.arange(12), np.arange(12) * 1000] = -2
    hits = sum(len(set(np.argsort(-s[n])[:5].tolist()) & got[1000 * n]) for n in range(12))
    assert hits == 5 * 12, f"HITS {hits} of 60"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "repeats", "mixing", "packing"]
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out.cache()
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    total = corpus_pipeline.STAGES[-1][1](spark, docs, SF).agg(F.sum("length")).first()[0]
    whole = corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0]
    assert total == whole


ODD_DOCUMENTS = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (5, "another text of the same id"), (None, "no id at all here"), (None, None), (6, "a long text of words " * 20_000), (7, "a long text of words " * 20_000), (8, "ab" * 40_000)]
CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, turn int, _id string, _tag string, size int, copies int, taken int, start int, offset int, bucket int, kind int, block int, rest string, tag int"


def test_pipeline_takes_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, stage by stage."""
    spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rest = CLASHING.count(",") - 4
    rows = [(d, t, None, None if d == 2 else "s", None, *["7" if c.split()[1] == "string" else 7 for c in CLASHING.split(", ")[5:]]) for d, t in ODD_DOCUMENTS]
    assert len(rows[0]) == rest + 5
    for some in (rows, []):
        docs = spark.createDataFrame(some, CLASHING)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), CLASHING)
        kept = docs.collect()
        assert all(r.row == "7" and r["_id"] == "7" and r.turn == 7 for r in kept)
        if some:
            assert {r.text for r in kept if r.doc_id in (4, 5)} >= {"one"}
            assert len([r for r in kept if r.text and len(r.text) > 10_000]) <= 2
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert (len(pieces) > 0) == bool(some)


def test_neighbours_with_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0], i, i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, v int, list int, ids int")
    assert len(neighbours.nearest(df, every=10).collect()) == 10
