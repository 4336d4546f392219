import re
from collections import Counter

import pytest

from quadrille.llm import quality

from . import cases


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_against_sql(spark):
    cases.against(quality.query(spark, cases.SF), quality.ORACLE_SQL)


def test_stats_of_awkward_rows(spark):
    df = cases.clashing(cases.docs(spark), "n_words", "kept", "base_failed", "n_lines")
    rows = quality.judge(df).collect()
    assert len(rows) == len(cases.ROWS)
    want = Counter((r[0], *brute(r[1])) for r in cases.ROWS)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a a a", "x y z q x y z q x y z", "a b c d", "p q r " * 50])
def test_repeats(spark, text):
    got = quality.with_stats(cases.docs(spark, [(1, text, "en", "a", 1)])).first()
    assert got["n_repeat_words"] == brute(text)[4]


def test_repeats_without_hashes(spark, monkeypatch):
    monkeypatch.setattr(quality, "_INDEX_BITS", 3)  # all longer texts compare their windows as texts
    got = quality.with_stats(cases.docs(spark)).collect()
    assert {(r["doc_id"], r["n_repeat_words"]) for r in got} == {(r[0], brute(r[1])[4]) for r in cases.ROWS}


def test_sketches_merge(spark):
    scored = spark.range(2000).selectExpr("'en' AS __q_lang", "CAST(id % 2 AS STRING) AS __q_source", "false AS base_failed", *[f"id AS __q_m_{m}" for m in quality.METRICS])
    t = {r["t_source"]: r for r in quality.thresholds(quality.sketches(scored), spread=0).collect()}
    high = t["0"]["high_symbols"] - quality.METRICS["symbols"][0]
    assert 1500 * 63 / 64 <= high <= 1500


def test_empty_and_keep(spark):
    assert quality.judge(cases.empty(spark)).count() == 0
    df = cases.clashing(cases.docs(spark), "kept")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() <= df.count()


def test_many_groups_are_joined_alike(spark, monkeypatch):
    want = sorted(map(tuple, quality.query(spark, cases.SF).collect()))
    monkeypatch.setattr(quality, "MAX_BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quality.query(spark, cases.SF).collect())) == want
