"""The n-gram join and the removal of repeats against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from matrixlake.llm import graphs, ngram_join, repeats

SCHEMA = "doc_id bigint, text string, n bigint, tag string, d1 string, root string"  # some names that the operators use themselves


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 30, 90, 200]))]
        rows.append((i, " ".join(words)))
    for i in range(160, 300):  # near copies, with more and fewer changes
        words = rows[rng.randrange(160)][1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(300, 380):  # a large group of near copies
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, "\n".join(words)))
    for i in range(380, 420):  # a passage that many share
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(40)) + " " + passage + " " + rng.choice(vocabulary)))
    rows += [(420, None), (421, ""), (422, " \t\n"), (423, "ONE Two"), (424, "one two"), (425, "word " * 5000), (426, "word " * 4000), (427, "a" * 3000), (428, "ab" * 1500), (429, "é" * 400)]
    rows += [(423, "ONE Two"), (423, "a different text with the same id as another one here"), (None, rows[3][1]), (None, "only here"), (500, rows[100][1])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "t", "x", None) for d, t in rows], SCHEMA).repartition(5)


def shingle_sets(rows, n):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    return out


def grouped(sets, num):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * 100 >= num * max(len(a), len(b)):
            both = len(a & b)
            if 100 * both >= num * (len(a) + len(b) - both):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_components_against_brute_force(spark):
    rows = corpus()
    sets = shingle_sets(rows, 4)
    top = grouped(sets, 85)
    low = lambda d: -1 if d is None else d
    least = {}
    for (d, _), t in zip(rows, top, strict=True):
        least[t] = min(least.get(t, 1 << 60), low(d))
    want = sorted((low(d), len(s), least[t]) for (d, _), s, t in zip(rows, sets, top, strict=True))
    got = sorted((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in ngram_join.classes(frame(spark, rows)).collect())
    assert got == want


def test_small_tiles_lose_nothing(spark, monkeypatch):
    rows = corpus(8)
    whole = sorted(map(str, ngram_join.classes(frame(spark, rows)).collect()))
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    assert sorted(map(str, ngram_join.classes(frame(spark, rows)).collect())) == whole


def test_blocks_of_a_chain_meet_without_its_pivots(spark, monkeypatch):
    """Texts of which each is near the next only: pivots reach few of them, so blocks must meet."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(75)] + [(900, " ".join(words[:100]))]
    got = {r.doc_id: r.component_id for r in ngram_join.classes(frame(spark, rows)).collect()}
    assert set(got.values()) == {0}


def test_files_follow_the_rows_and_not_the_partitions(spark, monkeypatch):
    """Tables of numbers are written in few files under many shuffle partitions, and nothing is lost by it."""
    rows, files, write = corpus(8), {}, ngram_join.staged
    whole = sorted(map(str, ngram_join.classes(frame(spark, rows)).collect()))

    def staged(df, tag):
        out = write(df, tag)
        files.setdefault(tag, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "staged", staged)
    monkeypatch.setattr(graphs, "staged", staged)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert sorted(map(str, ngram_join.classes(frame(spark, rows)).collect())) == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"classes", "signature-groups", "links", "close-tiles", "connected", "components", "ngram-join"} <= set(files)
    most = {tag: max(n) for tag, n in files.items() if tag not in ("shingle-sets", "candidate-sets", "large-components")}
    assert max(most.values()) <= 12, most


def test_forests_keep_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(4)).collect()}
    up = {x: x for x in range(400)}
    for _ in range(400):
        for a, b in links[:-1]:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: up[x] for ab in links[:-1] if ab[0] != ab[1] for x in ab}


def test_one_of_each_group_stays(spark):
    rows = corpus()
    sets = shingle_sets(rows, 5)
    top = grouped(sets, 80)
    kept = ngram_join.one_of_each(frame(spark, rows)).collect()
    assert kept[0].__fields__ == [c.split()[0] for c in SCHEMA.split(", ")]
    place = {}
    for k, (d, t) in enumerate(rows):
        place.setdefault((d, t), k)
    groups = [top[place[r.doc_id, r.text]] for r in kept if sets[place[r.doc_id, r.text]]]
    assert len(groups) == len(set(groups)) == len({t for t, s in zip(top, sets, strict=True) if s})
    assert sum(1 for r in kept if not sets[place[r.doc_id, r.text]]) == sum(1 for s in sets if not s)


def test_signatures_meet_within_the_threshold():
    rng, signer = np.random.default_rng(2), ngram_join.Signer(85, 100)
    for n in [1, 2, 5, 6, 7, 9, 13, 20, 33, 50, 80, 120, 300, 1000]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            cut = rng.integers(0, n * 15 // 185 + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - cut]], rng.integers(0, 1 << 63, rng.integers(0, cut + 1 + n // 12)).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if 100 * same >= 85 * (len(a) + len(b) - same):
                assert len(np.intersect1d(signer.sign(a), signer.sign(b)))


def test_empty_tables(spark):
    assert ngram_join.classes(frame(spark, [(1, "x")]).limit(0)).collect() == []
    assert ngram_join.one_of_each(frame(spark, [(1, "x")]).limit(0)).collect() == []
    assert repeats.deduplicated(frame(spark, [(1, "x")]).limit(0)).collect() == []


def brute_repeats(rows, length):
    """Rows of one id are texts of their own: a window is a repeat if it starts at a smaller (doc_id, start)."""
    low = lambda d: -1 if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, (1 << 60, 0)), (low(d), s))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (low(d), s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((low(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(spark):
    rows = corpus()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.deduplicated(frame(spark, rows)).collect())
    assert got == brute_repeats(rows, 100)


def test_low_entropy_and_flushes(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(50, 400))) + "ab" * rng.randint(0, 200)) for i in range(80)]
    monkeypatch.setattr(repeats, "FLUSH", 50)
    monkeypatch.setattr(repeats, "TEXT_BYTES", 500)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.deduplicated(frame(spark, rows)).collect())
    assert got == brute_repeats(rows, 100)


def test_texts_without_repeats_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 120, "fr", 120), (2, "é" * 120 + "x", "fr", 121), (3, None, None, None), (4, "é" * 120, "de", 120)], "doc_id bigint, text string, lang string, n_chars bigint")
    got = {r.doc_id: tuple(r) for r in repeats.without_repeats(docs).collect()}
    assert set(got) == {1, 2, 3}  # nothing is left of 4
    assert got[2][1:] == ("x", "fr", 1)
    assert got[1][0] == 1 and got[1][2] == "fr" and got[1][3] == len(got[1][1])
    assert docs.columns == repeats.without_repeats(docs).columns


def test_phrases_are_told_apart_by_bytes(spark, monkeypatch):
    """Fingerprints that agree for nearly all phrases only cost time."""
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage, longer = some(99), some(180)
    rows = [(i, some(80) + (longer if i % 5 == 0 else passage) + some(80)) for i in range(120)]
    whole = repeats.Spans.hash

    def weak(self, start, length):
        h = whole(self, start, length)
        return np.where(np.asarray(length) >= 100, h & np.uint64(1), h)

    monkeypatch.setattr(repeats.Spans, "hash", weak)
    text = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array([0] * 120, pa.int64()), pa.array([t for _, t in rows])], names=["doc", "tag", "text"])
    docs = pa.RecordBatch.from_arrays([*text.columns[:2], text["text"].cast(pa.binary()), pa.array([{"none": 0}] * 120)], names=["doc", "tag", "text", "rest"])
    schema = pa.schema([("doc", pa.int64()), ("rest", docs["rest"].type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
    told = list(repeats._choose(1)(repeats._parse(100, 1)([text])))
    half = list(repeats._apply(100, False, 1, schema)([*told, *repeats._sort_texts(1)([docs])]))
    moved = [b.select(["bucket", "kind", "block"]).filter(pa.array([k == kind for k in b["kind"].to_pylist()])) for kind in (0, 1, 2) for b in half]
    again = list(repeats._compare(100, 1)([b for b in moved if b.num_rows and b["kind"][0].as_py() < 2]))
    last = list(repeats._finish(100, False, pa.schema(list(schema)[:7]))([*again, *[b for b in moved if b.num_rows and b["kind"][0].as_py() == 2]]))
    got = [(r["doc"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for b in [*half, *last] for r in b.to_pylist() if r["doc"] is not None]
    assert sorted(got) == brute_repeats(rows, 100)


def test_suffix_order():
    rng = np.random.default_rng(1)
    size = [140, 100, 230, 12, 101]
    data, ends = rng.integers(97, 99, sum(size)).astype(np.uint8), np.cumsum(size)
    data[140:240] = data[20:120]
    got = repeats.ranks(data, np.repeat(ends, size), 100)
    strings = {p: data[p : p + 100].tobytes() for e, n in zip(ends.tolist(), size, strict=True) for p in range(e - n, e - 99)}
    place = {x: i for i, x in enumerate(sorted(set(strings.values())))}
    assert got.tolist() == [place[strings[p]] if p in strings else -1 for p in range(len(data))]
