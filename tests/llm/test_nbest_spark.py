import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from quadrille.llm import nbest  # noqa: E402

from . import cases  # noqa: E402

PATH = P.path("piece_bpe_32k.model")


def test_documents(spark):
    df = cases.clashing(cases.docs(spark), "score", "nbest")
    rows = nbest.segment(df, PATH, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(cases.ROWS)
    coder = nbest.load(PATH)
    for r in rows:
        assert r["round_trip"] and list(r["nbest_scores"]) == sorted(r["nbest_scores"], reverse=True)
        assert r["score"] == r["nbest_scores"][0] and r["n_pieces"] == len(r["nbest"][0])
        assert all(coder.decode(ids) == (r["text"] or "") for ids in r["nbest"])
        assert len({tuple(x) for x in r["nbest"]}) == len(r["nbest"])
    back = nbest.decode(nbest.segment(df, PATH, keep=["doc_id"]).selectExpr("doc_id", "nbest[0] AS ids"), PATH, "ids").collect()
    assert sorted((r["text"] for r in back)) == sorted((r[1] or "") for r in cases.ROWS)
    assert nbest.segment(cases.empty(spark), PATH).count() == 0


def test_query_gives_every_segmentation(spark):
    got = {r["doc_id"]: r for r in nbest.query(spark, cases.SF).collect()}
    coder = nbest.load(PATH)
    for doc_id, text in spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text").collect()[:40]:
        want, r = coder.encode(text or "", 4), got[doc_id]
        assert len(want) == len(r["nbest_pieces"]) == 4 and len({tuple(x) for _, x in want}) == 4
        assert r["nbest_pieces"] == [len(x) for _, x in want] and all(r["nbest_round_trip"])
        assert r["nbest_crc32"] == [zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want]
        assert all(coder.decode(x) == text for _, x in want)
