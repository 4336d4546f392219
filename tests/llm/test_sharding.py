import hashlib
import random
import zlib

import pytest

from quadrille.llm import sharding

from . import cases


def check(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    assert set(by) <= set(range(n))
    return by


def test_against_sql(spark):
    cases.against(sharding.query(spark, cases.SF), sharding.ORACLE_SQL)


def test_awkward_rows(spark):
    df = cases.clashing(cases.docs(spark), "size", "slot", "law")
    rows = sharding.shard(df, 3, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(cases.ROWS)
    check(rows, 3)
    for r in rows:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)


def test_hot_text_is_subdivided(spark, monkeypatch):
    rows = [(i, "the same text" if i % 3 else f"text {i}", "en", "a", 1) for i in range(3000)]
    monkeypatch.setattr(sharding, "SAMPLES", 2)
    by = check(sharding.shard(cases.docs(spark, rows), 8).collect(), 8)
    sizes = [sum(r["size"] for r in part) for part in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) <= 2 * max(r["size"] for part in by.values() for r in part)


def exact(rows, n):
    """The shard of each (id, text) by running bytes."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    order = sorted(rows, key=lambda r: (md5(r[1] or ""), md5("" if r[0] is None else str(r[0]))))
    sizes = [len((t or "").encode()) + 8 for _, t in order]
    total, before, out = sum(sizes), 0, []
    for (i, t), k in zip(order, sizes, strict=True):
        out.append((i, t, min(n - 1, (2 * before + k) * n // (2 * total))))
        before += k
    return out


@pytest.mark.parametrize("few, most, n", [(4, 10**6, 5), (512, 50, 24), (1, 40, 7)])
def test_ranges_decide_as_running_bytes_do(spark, monkeypatch, few, most, n):
    rng = random.Random(few)
    rows = [(rng.choice((i, None, 7)), rng.choice(("same", None, "x" * rng.randrange(4000), "y" * 9))) for i in range(1500)]
    monkeypatch.setattr(sharding, "FEW", few)
    monkeypatch.setattr(sharding, "RANGE_ROWS", most)
    monkeypatch.setattr(sharding, "SAMPLES", 4)
    df = cases.docs(spark, [(i, t, "en", "a", 1) for i, t in rows])
    got = sharding.shard(df, n, keep=["doc_id", "text"]).collect()
    check(got, n)
    assert sorted(((r["doc_id"], r["text"], r["shard"]) for r in got), key=str) == sorted(exact(rows, n), key=str)


def test_ranges_hold_few_rows_and_rounds_may_end(spark, monkeypatch):
    rows = [(i, None, "en", "a", 1) for i in range(2000)]
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    seen = []
    real = sharding.dealt
    monkeypatch.setattr(sharding, "dealt", lambda sizes, *a: (seen.append(int(sizes["rows"].max())), real(sizes, *a))[1])
    check(sharding.shard(cases.docs(spark, rows), 3).collect(), 3)
    monkeypatch.setattr(sharding, "ROUNDS", 1)  # the ranges of the first sample stay as they are
    by = check(sharding.shard(cases.docs(spark, rows), 3).collect(), 3)
    assert seen[0] <= 100 and sum(map(len, by.values())) == 2000


def test_identical_rows_and_empty(spark):
    rows = [(1, "same", "en", "a", 1)] * 50
    check(sharding.shard(cases.docs(spark, rows), 4).collect(), 4)
    assert sharding.shard(cases.empty(spark)).count() == 0


def test_write(spark, tmp_path):
    sharding.write_shards(cases.docs(spark), str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(cases.ROWS)
