"""Token counts through a digest cache.

A cache is a Parquet table (version, digest, n_tokens), partitioned by version. Texts and the tokenizer (library and
vocabulary file) are known by their digests. The distinct digests of a corpus are joined to the stored counts; one text
of each digest that is missing is encoded, and its count appended; then every row takes its count from the cache. A
corpus whose texts are all stored is never encoded, and its texts aren't shuffled.

Copies meet in the partial aggregation before the shuffle, so a text that a third of all rows share arrives as one row
a task. The join back is between digests, without texts, and Spark splits its large partitions. The texts themselves are
what is digested, as the vocabularies' normalisers aren't part of the libraries' interfaces: texts that only normalise
alike are counted apart.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows keep a row each; an empty table gives an
empty result and leaves the cache as it is; columns in keep that clash with result columns are dropped. Appends by two
jobs at once may store a digest twice, with one count; readers take one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encoders
from .common import MAX_BROADCAST_ROWS, materialize, scratch, shared_dir, text_or_empty

SCHEMA = "digest binary, n_tokens long, version string"
MADE = ["n_bytes", "n_tokens", "over_limit"]


def read_cache(spark, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one version, where a digest may come twice; without rows where there is no cache."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("version") == version).select("digest", "n_tokens")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def encode_missing(texts: DataFrame, missing: DataFrame, cache: str, tokenizer: str) -> None:
    """Append to the cache the counts of the missing digests. texts: (digest, text) of all rows."""
    few = missing.count()
    if not few:
        return
    if few <= MAX_BROADCAST_ROWS:  # nothing else needs to be shuffled
        texts = texts.join(F.broadcast(missing), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.any_value("text").alias("text"))
    if few > MAX_BROADCAST_ROWS:
        texts = texts.join(missing.hint("shuffle_merge"), "digest", "left_semi")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoders.load(tokenizer)
        for b in batches:
            n = coder.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    counted = texts.mapInArrow(count, "digest binary, n_tokens long")
    counted.withColumn("version", F.lit(encoders.version(tokenizer))).write.mode("append").partitionBy("version").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, text_col: str = "text", keep: list[str] | None = None, limit: int = 4096) -> DataFrame:
    """A row for each of docs: the columns in keep, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in MADE]
    spark, version = docs.sparkSession, encoders.version(tokenizer)
    texts = docs.select(text_or_empty(text_col).alias("text")).select(digest(F.col("text")).alias("digest"), "text")
    with scratch() as put:
        wanted = put(texts.select("digest").distinct(), "digests")
        missing = put(wanted.join(read_cache(spark, cache, version), "digest", "left_anti"), "missing")
        encode_missing(texts, missing, cache, tokenizer)
        # As a table of its own, so that both sides of the join come straight from their shuffles and a hot digest is split.
        stored = read_cache(spark, cache, version).join(wanted, "digest", "left_semi")
        stored = materialize(stored.groupBy(F.col("digest").alias("__q_stored")).agg(F.max("n_tokens").alias("n_tokens")), "counts")
    keyed = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text_col).alias("__q_text"))
    keyed = keyed.select(*[F.col(f"`{c}`") for c in keep], F.octet_length("__q_text").cast("long").alias("n_bytes"), digest(F.col("__q_text")).alias("__q_digest"))
    out = keyed.join(stored, F.col("__q_digest") == F.col("__q_stored"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    """The cache lies in the shared folder and stays there, so that later runs encode only texts that are new."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, f"{shared_dir(spark)}/quadrille-token-counts", public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
