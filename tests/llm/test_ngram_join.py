import random

import numpy as np
import pytest

from quadrille.llm import graph, ngram_join

from . import cases


def brute(rows):
    """(class, copy, copies, links) of each id by comparing all pairs."""
    texts = {}
    for i, t, *_ in rows:
        if t is not None:
            texts.setdefault(t, []).append(i)
    rep = {t: min(ids) for t, ids in texts.items()}
    sets = {}
    for t in texts:
        w = ngram_join._WORD.findall(t)
        sets[t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    linked = {t: [u for u in texts if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u]) - 1e-9] for t in texts}
    low = dict(rep)
    for _ in texts:
        low = {t: min([low[t], *(low[u] for u in linked[t])]) for t in texts}
    return {(i, low[t], rep[t], len(texts[t]), len(linked[t])) if t is not None else (i, i, i, 1, 0) for i, t, *_ in rows}


def found(df, **kw):
    return {(r["doc_id"], r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in ngram_join.join(df, **kw).collect()}


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    rows, i = [], 0
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 6, 9))):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "a", 1))
        i += 1
    rows += [(1000 + k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(50)), "en", "a", 1) for k in range(30)]
    return rows


def test_against_sql(spark):
    cases.against(ngram_join.query(spark, cases.SF), ngram_join.ORACLE_SQL)


def test_awkward_rows(spark):
    rows = [r for r in cases.ROWS if r[0] is not None]
    df = cases.clashing(cases.docs(spark, rows), "class_id", "rep", "comp")
    assert found(df) == brute(rows)
    assert ngram_join.join(df).count() == len(rows)
    nameless = [r for r in ngram_join.join(cases.docs(spark)).collect() if r["doc_id"] is None]
    assert [tuple(r) for r in nameless] == [(None, None, None, 1, 0)]
    assert ngram_join.join(cases.empty(spark)).count() == 0


def test_shared_and_missing_ids(spark):
    other = "quite another text that nothing else in this table is like at all"
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(7, words, "en", "a", 1), (7, other, "en", "a", 1), (None, words + " end", "en", "a", 1), (9, other, "en", "a", 1)]
    got = [tuple(r) for r in ngram_join.join(cases.docs(spark, rows)).collect()]
    assert {(r[0], r[1]) for r in got} == {(7, 7), (None, 7), (9, 7)} and len(got) == 4
    assert [r[2:] for r in got if r[0] is None] == [(None, 1, 1)]


def test_large_groups_in_blocks(spark, monkeypatch):
    rows = near_copies(120, 4)
    want = brute(rows)
    assert max(x[4] for x in want) > 20
    assert found(cases.docs(spark, rows)) == want
    monkeypatch.setattr(ngram_join, "AT_ONCE", 7)
    assert found(cases.docs(spark, rows)) == want
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 25)
    assert found(cases.docs(spark, rows)) == want


@pytest.mark.parametrize("most", [0, 5])
def test_without_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_ROWS", most)
    rows = near_copies(40, 6)
    rows += [(500 + i, rows[3][1], "en", "a", 1) for i in range(25)]
    assert found(cases.docs(spark, rows).repartition(5)) == brute(rows)
    assert {r["doc_id"] for r in ngram_join.keep_one(cases.docs(spark, rows)).collect()} == {x[1] for x in brute(rows)}


@pytest.mark.parametrize("share", [1 / 1000, 0.2])
def test_hubs(spark, monkeypatch, share):
    monkeypatch.setattr(graph, "HOT_SHARE", share)
    edges = [(0, i) for i in range(1, 400)] + [(999, i) for i in range(300, 340)] + [(2000, 2001), (2001, 2002)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(400), 0), 999: 0, 2000: 2000, 2001: 2000, 2002: 2000}


def test_exact_links():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(70)]
    want = np.array([[len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert (ngram_join.exact_links(sets[:30], sets[30:], 0.5) == want[:30, 30:]).all()
    links, label = ngram_join.count_links(sets, np.zeros(70, int), False, 0.5)
    assert (links == want.sum(1) - 1).all()
    reach = np.linalg.matrix_power(want.astype(float), 64) > 0
    assert label.tolist() == [int(np.flatnonzero(r)[0]) for r in reach]


def test_keep_one(spark):
    rows = near_copies(40, 1) + [(5, "dup text here", "en", "a", 1)] * 0
    df = cases.docs(spark, rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {x[1] for x in brute(rows)}
    twice = cases.docs(spark, [(5, "the same words again and again", "en", "a", 1)] * 2)
    assert ngram_join.keep_one(twice).count() == 1


def test_keep_one_by_rows_not_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [
        (7, a), (7, b), (9, b),  # an id with two texts, one of them copied
        (5, c), (5, c), (None, c), (None, c + " end"),  # a repeated row, with an exact and a near copy without id
        (None, d), (None, d), (None, d + " end"), (None, e), (None, f),  # ids are all null
        (8, None), (8, None), (None, None),
        (3, f"{text()} {a}"),
    ]
    df = cases.docs(spark, [(i, t, "en", "a", 1) for i, t in rows]).repartition(3)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    of_d = {(None, d), (None, d + " end")} & set(got)
    assert len(of_d) == 1
    assert got == sorted([(7, a), (7, b), (5, c), *of_d, (None, e), (None, f), (8, None), (8, None), (None, None), rows[-1]], key=str)


def test_keep_one_with_ids_in_any_order(spark):
    rows = near_copies(60, 2)
    rows = [(10**9 - i if i % 3 else -i, *r) for i, *r in rows] + [(-5000, *rows[0][1:])]
    df = cases.docs(spark, rows).repartition(7)
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(df).collect()) == sorted({x[1] for x in brute(rows)})


def test_pruning_keeps_true_pairs():
    rng = np.random.default_rng(0)
    least = [ngram_join.least_matches(n, 0.8, 1e-5) for n in range(32, 161, 32)]
    assert least == sorted(least) and least[-1] < 0.8 * 160
    lost = 0
    for _ in range(2000):
        same = rng.random(160) < 0.82
        a = rng.integers(0, 256, 160, dtype=np.uint8)
        b = np.where(same, a, rng.integers(0, 256, 160)).astype(np.uint8)
        lost += not len(ngram_join._survivors(b[None], a, least))
    assert lost <= 2


def test_minhash_estimates():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = ngram_join.signature(items[:800]), ngram_join.signature(items[200:])
    assert abs((a == b).mean() - 0.6) < 0.12


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert sorted((r["node"], r["comp"]) for r in got) == sorted((x, label[x]) for x in linked)
