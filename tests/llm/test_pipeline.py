"""The pipeline against plain Python versions of its stages."""

import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from quadrille.llm import langid, quality  # noqa: E402
from quadrille.llm.common import materialize  # noqa: E402

from . import cases  # noqa: E402
from .test_ngram_join import brute as classes  # noqa: E402
from .test_quality import brute as stats  # noqa: E402


def kept_by_rules(df: pd.DataFrame) -> set:
    """The quality stage by hand: metrics, bucketed quartiles, fences."""
    rows = []
    for r in df.itertuples():
        n, chars, sym, dup, rep = stats(r.text)
        lines = sum(any(c not in " \t\n\x0b\x0c\r" for c in x) for x in (r.text or "").split("\n"))
        m = {"symbols": sym * 10_000 // max(n, 1), "dup_lines": dup * 10_000 // max(lines, 1), "repeats": rep * 10_000 // max(n, 1), "word_len": chars * 1_000 // max(n, 1)}
        if n >= 50 and 100 * rep <= 50 * n:
            rows.append((r.doc_id, r.lang, r.source, m))
    cut = lambda v: v >> max(0, v.bit_length() - 7) << max(0, v.bit_length() - 7)
    quart = lambda vs, k: sorted(vs)[-(-len(vs) * k // 4) - 1]
    out = set()
    for i, lang, source, m in rows:
        for group in ([x for x in rows if x[1:3] == (lang, source)], [x for x in rows if x[1] == lang], rows):
            if len(group) >= quality.MIN_ROWS:
                break
        ok = True
        for k, (slack, both) in quality.METRICS.items():
            vs = [cut(x[3][k]) for x in group]
            a, b = quart(vs, 1), quart(vs, 3)
            reach = max(slack, quality.SPREAD * (b - a))
            ok &= (a - reach if both else 0) <= m[k] <= b + reach
        if ok:
            out.add(i)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    cols = docs.columns
    first = materialize(pipeline.quality_rules(spark, docs, cases.SF), "t1")
    assert first.columns == cols and {r["doc_id"] for r in first.select("doc_id").collect()} == kept_by_rules(docs.toPandas())
    second = materialize(pipeline.language_id(spark, first, cases.SF), "t2")
    model = langid.fit(first)
    want = {r["doc_id"] for r in first.collect() if (p := model.predict(r["text"]))[0] != "und" and p[1] >= 0.5 and p[2] >= 0.15}
    assert second.columns == cols and {r["doc_id"] for r in second.collect()} == want
    third = materialize(pipeline.ngram_jaccard_join(spark, second, cases.SF), "t3")
    keep = {x[1] for x in classes([(r["doc_id"], r["text"]) for r in second.collect()])}
    assert third.columns == cols and {r["doc_id"] for r in third.collect()} == keep
    last = pipeline.pack(spark, third, cases.SF).collect()
    assert {r["doc_id"] for r in last} == keep
    whole = pipeline.run(spark, cases.SF).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in last)
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "language_id", "ngram_jaccard_join", "packing"]


def test_empty_tables(spark):
    docs = cases.empty(spark)
    for _, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, cases.SF), "t")
        assert docs.count() == 0
