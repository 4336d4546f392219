import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import pandas as pd
from pyspark.sql import functions as F

from quadrille.llm import langid

from . import cases


def test_accuracy(spark):
    got = langid.query(spark, "/root/testdata/sf0.01").toPandas()
    truth = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]].merge(got, on="doc_id")
    assert (truth["held_out"] == truth["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = truth[truth["held_out"]]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_backoff_by_hand():
    m = langid.Model([("de", "schön", 5), ("de", "haus", 5), ("en", "house", 5), ("en", "nice", 5)])
    assert m.predict("Haus!")[0] == "de" and m.predict("nice house")[0] == "en"
    assert m.predict("schönheit")[0] == "de" and m.predict("houses")[0] == "en"  # unseen: by n-grams
    assert m.predict("") == m.predict("123 ½ $$") == ("und", 0.0, 0.0)
    assert m.predict("日本")[0] in ("de", "en")  # nothing known: a tie


def test_awkward_rows(spark):
    df = cases.clashing(cases.docs(spark), "score", "lang_pred")
    rows = langid.predict(df, langid.fit(df)).collect()
    assert len(rows) == len(cases.ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 7))
    assert by[4]["lang_pred"] in {"en", "fr", "de"}
    out = langid.keep_identified(df)
    assert out.columns == df.columns


def test_nothing_to_learn(spark):
    assert langid.predict(cases.empty(spark), langid.fit(cases.empty(spark))).count() == 0
    rows = langid.predict(cases.docs(spark), langid.fit(cases.empty(spark))).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
    assert langid.keep_identified(cases.docs(spark, [(1, "Words that nobody has labelled.", None, "a", 1)])).count() == 1


def test_gibberish_is_not_kept(spark):
    rng = random.Random(2)
    df = spark.read.parquet(f"{cases.SF}/documents.parquet")
    noise = [(10**6 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(80)), None, "x", 1) for i in range(20)]
    both = df.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(cases.docs(spark, noise))
    kept = {r["doc_id"] for r in langid.keep_identified(both).collect()}
    clean = {r["doc_id"] for r in df.collect() if len((r["text"] or "").split()) >= 50}
    assert not kept & {n[0] for n in noise} and len(kept & clean) >= 0.99 * len(clean)


def plain(rows):
    """(language, score, known share) of each text by the method, word by word. rows: (doc_id, text, lang)."""
    word = re.compile(r"[^\W\d_]+")
    counts = {}
    for i, t, lang in rows:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            for w in word.findall((t or "").lower()):
                counts.setdefault(lang, Counter())[w] += 1
    langs = sorted(counts)
    total = sum(counts.values(), Counter())
    vocabulary = {w for w, n in total.items() if n >= 2}

    def parts(w, k):
        w = f"^{w}$" if k > 1 else w
        return [w[i : i + k] for i in range(len(w) - k + 1)]

    grams = {k: {lang: Counter() for lang in langs} for k in range(1, 6)}
    for lang in langs:
        for w, n in counts[lang].items():
            for k in grams:
                for g in parts(w, k):
                    grams[k][lang][g] += n
    known = {k: set().union(*(grams[k][lang] for lang in langs)) for k in grams}
    log = lambda n, all_, size: math.log((n + 0.5) / (all_ + 0.5 * (size + 1)))
    in_words = {lang: sum(n for w, n in counts[lang].items() if w in vocabulary) for lang in langs}
    in_grams = {k: {lang: sum(grams[k][lang].values()) for lang in langs} for k in grams}

    @cache
    def score(w, lang):
        if w in vocabulary:
            return log(counts[lang][w], in_words[lang], len(vocabulary))
        for k in (5, 4, 3, 2, 1):
            if found := [g for g in parts(w, k) if g in known[k]]:
                return sum(log(grams[k][lang][g], in_grams[k][lang], len(known[k])) for g in found) / len(found)
        return 0.0

    for i, t, _ in rows:
        ws = word.findall((t or "").lower())
        if not any(c.isalpha() for w in ws for c in w):
            yield i, "und", 0.0, 0.0
            continue
        sums = {lang: sum(score(w, lang) for w in ws) for lang in langs}
        best = max(langs, key=lambda lang: sums[lang])
        seen = sum(w in vocabulary and counts[best][w] > 0 for w in ws) / len(ws)
        yield i, best, 1 / sum(math.exp(min(s - sums[best], 0)) for s in sums.values()), seen


def test_against_a_plain_version(spark):
    df = spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in df.collect()]
    want = {i: x for i, *x in plain(rows)}
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["known"]) for r in langid.predict(df, langid.fit(df, train_docs=10**6, train_chars=10**9), keep=["doc_id"]).collect()}
    assert got.keys() == want.keys()
    for i, (lang, score, known) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-3 and abs(got[i][2] - known) < 1e-6
    queried = {r["doc_id"]: r for r in langid.query(spark, cases.SF).collect()}
    assert sum(queried[i]["lang_pred"] == want[i][0] for i in want) >= len(want) - 1


def test_sample_is_bounded(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('word', id) AS text", "'en' AS lang")
    assert len(langid.fit(df, train_docs=100).grams[1]) > 0
