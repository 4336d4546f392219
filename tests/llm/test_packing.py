import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from quadrille.llm import encoders, packing  # noqa: E402

from . import cases  # noqa: E402

PATH = P.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    fill, out = [], []
    for n in lengths:
        rooms = [(capacity - f, i) for i, f in enumerate(fill) if capacity - f >= n]
        least = min((r for r, _ in rooms), default=None)
        if least is None:
            fill.append(0)
            i = len(fill) - 1
        else:
            i = [i for r, i in rooms if r == least][-1]
        out.append(fill[i])
        fill[i] += n
    return sorted(fill)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, 65, 300).tolist(), reverse=True)
    placed = packing.best_fit(lengths, 64)
    fill = {}
    for n, (b, off) in zip(lengths, placed, strict=True):
        assert off == fill.get(b, 0)
        fill[b] = off + n
    assert max(fill.values()) <= 64
    assert len(fill) == len(plain_best_fit(lengths, 64))


def test_tree():
    t = packing.RoomTree(2048)
    assert t.tightest(1) == -1
    for room in (5, 700, 2047):
        t.add(room, 1)
    assert [t.tightest(n) for n in (1, 5, 6, 700, 701, 2047, 2048)] == [5, 5, 700, 700, 2047, 2047, -1]


def check(rows, texts, window):
    """rows: pieces with ids; texts: by id, all different ids."""
    coder = encoders.load(PATH)
    want = {i: coder.library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) <= window
    for i, ids in want.items():
        got = sorted(by_doc.pop(i), key=lambda r: r["start"])
        assert [x for r in got for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in got)
        assert [r["start"] for r in got] == list(range(0, len(ids), window))
    assert not by_doc
    for places in by_seq.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= window
    return len(by_seq)


def test_documents(spark):
    rows = {r[0]: r for r in cases.ROWS if r[0]}
    df = cases.clashing(cases.docs(spark, list(rows.values())), "ids", "offset", "length")
    got = packing.pack_documents(df, PATH, window=256).collect()
    check(got, {i: r[1] for i, r in rows.items()}, 256)


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    df = spark.read.parquet(f"{cases.SF}/documents.parquet")
    got = packing.pack_documents(df, PATH).collect()
    n = check(got, {r["doc_id"]: r["text"] for r in df.collect()}, 2048)
    assert n * 2048 < 1.25 * sum(r["length"] for r in got)


def test_repeats_and_empty(spark):
    df = cases.docs(spark, [(1, "one two", "en", "a", 1)] * 3)
    got = packing.pack_documents(df, PATH).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3
    assert packing.pack_documents(cases.empty(spark), PATH).count() == 0


def test_null_ids_and_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 300)
    rows = [(None, "the same words " * 20, "en", "a", 1)] * 3000 + [(i, f"{i} " * 700, "en", "a", 1) for i in range(20)]
    out = packing.pack_documents(cases.docs(spark, rows), PATH, window=512, with_ids=False)
    got = out.collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert (r["length"] == 512) == (r["sequence_id"] % 2 == 1)
    assert sum(r["doc_id"] is None for r in got) == 3000
    for places in by_seq.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 512
    sizes = [r["count"] for r in out.where("sequence_id % 2 = 0").groupBy((out["sequence_id"] / 2 % 11).cast("int")).count().collect()]
    assert len(sizes) == 11 and max(sizes) < 450  # 3020 rests in 11 groups


def test_query_against_the_library(spark):
    lib = encoders.load(PATH).library
    rows = packing.query(spark, cases.SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect()}
    want = set()
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids + [1]
        want |= {(i, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 2048)}
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_seq.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
