import pytest

P = pytest.importorskip("public_tokenizers")
from quadrille.llm import encoders, token_counts  # noqa: E402

from . import cases  # noqa: E402


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_and_cache(spark, tmp_path, name):
    path, cache = P.path(name), str(tmp_path / "cache")
    lib = encoders.load(path).library
    n = lambda t: len(lib.encode(t)) if name.endswith("model") else len(lib.encode(t, add_special_tokens=False).ids)
    df = cases.clashing(cases.docs(spark), "n_tokens", "digest")
    got = token_counts.count_tokens(df, cache, path, keep=["doc_id", "text"]).collect()
    assert len(got) == len(cases.ROWS)
    for r in got:
        t = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n(t), n(t) > 4096)
    distinct = len({r[1] or "" for r in cases.ROWS})
    stored = spark.read.parquet(cache)
    assert stored.count() == distinct
    more = cases.docs(spark, [(1, "something new", "en", "a", 1), *cases.ROWS])
    assert token_counts.count_tokens(more, cache, path).count() == len(cases.ROWS) + 1
    assert spark.read.parquet(cache).count() == distinct + 1  # only the miss was encoded


def test_versions_are_apart(spark, tmp_path):
    cache = str(tmp_path / "cache")
    a, b = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
    assert encoders.version(a) != encoders.version(b)
    one = cases.docs(spark, [(1, "Some prose to count, in two ways.", "en", "a", 1)])
    counts = [token_counts.count_tokens(one, cache, p).first()["n_tokens"] for p in (a, b, a)]
    assert counts[0] == counts[2] and spark.read.parquet(cache).count() == 2


@pytest.mark.parametrize("name, library", [("piece_bpe_32k.model", "sentencepiece"), ("byte_bpe_50k.json", "tokenizers")])
def test_another_library_version_is_apart(monkeypatch, name, library):
    now = encoders.version(P.path(name))
    monkeypatch.setattr(f"{library}.__version__", "0.0.0")
    assert encoders.version(P.path(name)) != now


def test_empty(spark, tmp_path):
    assert token_counts.count_tokens(cases.empty(spark), str(tmp_path / "c"), P.path("piece_bpe_32k.model")).count() == 0


def test_a_second_run_encodes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "shared_dir", lambda spark: f"file://{tmp_path}")
    first = token_counts.query(spark, cases.SF).collect()
    stored = sorted(spark.read.parquet(f"{tmp_path}/quadrille-token-counts").inputFiles())
    seen = []
    real = token_counts.encode_missing
    monkeypatch.setattr(token_counts, "encode_missing", lambda texts, missing, *a: (seen.append(missing.count()), real(texts, missing, *a)))
    second = token_counts.query(spark, cases.SF).collect()
    assert seen == [0] and sorted(spark.read.parquet(f"{tmp_path}/quadrille-token-counts").inputFiles()) == stored
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))
    lib = encoders.load(P.path("piece_bpe_32k.model")).library
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in first} == {i: len(lib.encode(t)) for i, t in texts.items()}


@pytest.mark.parametrize("most", [0, 100_000])
def test_many_and_few_missing(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(token_counts, "MAX_BROADCAST_ROWS", most)
    cache, path = str(tmp_path / "c"), P.path("piece_bpe_32k.model")
    rows = [(i, f"text number {i % 40}", "en", "a", 1) for i in range(90)]
    for some in (rows[:30], rows):
        got = token_counts.count_tokens(cases.docs(spark, some), cache, path).collect()
        assert len(got) == len(some)
    assert spark.read.parquet(cache).count() == 40


def test_a_digest_stored_twice_counts_once(spark, tmp_path):
    cache, path = str(tmp_path / "c"), P.path("piece_bpe_32k.model")
    df = cases.docs(spark)
    want = sorted(map(tuple, token_counts.count_tokens(df, cache, path, keep=["text"]).collect()), key=str)
    again = spark.createDataFrame(spark.read.parquet(cache).toPandas()[["digest", "n_tokens", "version"]], token_counts.SCHEMA)
    again.write.mode("append").partitionBy("version").parquet(cache)
    assert sorted(map(tuple, token_counts.count_tokens(df, cache, path, keep=["text"]).collect()), key=str) == want
