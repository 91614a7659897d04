import hashlib
import re

import pytest

from matrixlake.llm import mixing

ROWS = [(i, "w " * (i * 7 % 23 + 1), f"s{i % 5}") for i in range(300)] + [(900 + i, "big words here now " * 20, "s0") for i in range(200)] + [(300, None, "s1"), (301, "", None), (302, "x y z", None), (303, None, "only"), (5, "w w", "s0"), (5, "w w", "s0"), (None, "q", "s2"), (None, "q q", "s2")]


def brute(rows):
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, _) in enumerate(rows)}
    total = {}
    for i, (_, _, s) in enumerate(rows):
        total[s] = total.get(s, 0) + n[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
        free -= over
    return n, total, target


def test_mixing_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").withColumn("size", mixing.F.lit("clash"))
    out = mixing.mixed(df.repartition(5)).collect()
    again = mixing.mixed(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    n, total, target = brute(ROWS)
    assert sorted(r.size for r in out) == sorted(n.values())
    h = lambda d: int(hashlib.md5(b"" if d is None else str(d).encode()).hexdigest()[:15], 16)
    for s in total:
        mine = [r for r in sorted(out, key=key) if r.source == s]
        assert all(r.source_size == total[s] and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size for r in mine)
        whole = min(3, int(target[s] // total[s])) if total[s] else 0
        budget, steps = target[s] - whole * total[s], {}
        for r in mine:
            steps[h(r.doc_id)] = steps.get(h(r.doc_id), 0) + r.size
        best, run = (abs(budget), 0), 0
        for k in sorted(steps):
            run += steps[k]
            best = min(best, (abs(budget - run), run))
        assert sum(r.taken for r in mine) == whole * total[s] + (best[1] if total[s] and budget > 0 else 0)


def test_empty_tables(spark):
    schema = "doc_id bigint, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []
    rows = mixing.mixed(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
