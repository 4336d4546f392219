import hashlib

import numpy as np
import pytest

from quadrille.llm import fingerprints as fp

from . import cases


def jaccard(a, b):
    a, b = set(fp.digests(a)), set(fp.digests(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, docs):
    """docs: (id, text) in their order."""
    order = sorted(docs, key=lambda d: hashlib.md5((d[1] or "").encode()).hexdigest())
    order.sort(key=lambda d: -(d[0] if d[0] is not None else -(1 << 63)))
    texts = [t or "" for _, t in order]
    want = []
    for (i, _), t, n in zip(order, texts, texts[1:] + texts[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        want.append((i is None, i or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(t, e), 9), round(jaccard(t, n), 9)))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows]
    assert sorted(got) == sorted(want)


def test_against_brute_force(spark):
    df = spark.read.parquet(f"{cases.SF}/documents.parquet")
    rows = fp.query(spark, cases.SF).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.95 * len(rows)


def test_awkward_rows(spark):
    df = cases.clashing(cases.docs(spark), "fingerprint", "id", "range")
    check(fp.fingerprint(df).collect(), [(r[0], r[1]) for r in cases.ROWS])
    assert fp.fingerprint(cases.empty(spark)).count() == 0
    one = fp.fingerprint(cases.docs(spark, [(1, "only one here.", "en", "a", 1)])).first()
    assert one["near_next"] == 1.0


def test_equal_texts_have_equal_fingerprints(spark):
    rows = fp.fingerprint(cases.docs(spark)).collect()
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}) == 1


@pytest.mark.parametrize("n", [0, 1, 5, 30, 400])
def test_peeling_recovers_all(n):
    rng = np.random.default_rng(n)
    shared = rng.integers(1, 2**63, 50).tolist()
    left, right = rng.integers(1, 2**63, n).tolist(), rng.integers(1, 2**63, n // 2).tolist()
    assert fp.differences([shared + left], [shared + right]).tolist() == [n + n // 2]
    s = fp.Sketches([2048]).add(*fp._flat([shared + left])).minus(fp.Sketches([1024]).add(*fp._flat([shared + right])))
    _, keys, signs, whole = s.peel()
    assert whole.all() and {int(k) for k in keys[signs > 0]} == set(left) and {int(k) for k in keys[signs < 0]} == set(right)


def test_repeated_paragraphs():
    assert len(fp.digests("a\na\na")) == 3 and len(set(fp.digests("a\na\na"))) == 3
    assert fp.digests("") == [] and fp.likeness([[]], [[]]).tolist() == [1.0]


def test_published_prints_decide(spark):
    rows = fp.query(spark, cases.SF).collect()
    got = fp.compare_prints([r["fingerprint"] for r in rows], [r["edited_fingerprint"] for r in rows])
    known = [(g, r["near_edited"]) for g, r in zip(got, rows, strict=True) if g is not None]
    assert len(known) > 0.75 * len(rows) and all(abs(g - w) < 1e-9 for g, w in known)
    assert fp.compare_prints([rows[0]["fingerprint"]], [rows[0]["fingerprint"]]) == [1.0] and fp.compare_prints([], []) == []


def test_folding_is_sketching_at_the_smaller_size():
    rng = np.random.default_rng(3)
    sets = [rng.integers(1, 2**63, n).tolist() for n in (0, 3, 90, 700)]
    big, small = np.array([64, 8, 512, 256]), np.array([4, 8, 32, 128])
    a, b = fp.Sketches(big).add(*fp._flat(sets)).fold(small), fp.Sketches(small).add(*fp._flat(sets))
    assert (a.count == b.count).all() and (a.keys == b.keys).all() and ((a.check - b.check) & fp._LOW == 0).all()
    back = fp.Sketches.of_texts(b.texts())
    assert (back.keys == b.keys).all() and back.rows.tolist() == small.tolist() and back.sizes().tolist() == [0, 3, 90, 700]


@pytest.mark.parametrize("dealt", [5, 1000])
def test_hot_keys(spark, monkeypatch, dealt):
    """Null ids, one id with many texts, and many rows that are alike."""
    monkeypatch.setattr(fp, "DEALT_ROWS", dealt)
    monkeypatch.setattr(fp, "MIN_RANGES", 12)
    rows = [(None, f"text {i}. and more", "en", "a", 1) for i in range(300)] + [(7, f"other {i}.", "en", "a", 1) for i in range(300)]
    rows += [(3, "all alike. all of it", "en", "a", 1)] * 900 + [(None, "alike too", "en", "a", 1)] * 700 + [(i, f"{i}", "en", "a", 1) for i in range(100)]
    check(fp.fingerprint(cases.docs(spark, rows).repartition(5)).collect(), [(r[0], r[1]) for r in rows])
