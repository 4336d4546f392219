"""Sharding by sampled splitters into shards of near equal bytes.

Records are ordered by the digest of their text, then by that of their id, then by a number of their own, so copies lie
together and no two keys are equal. Splitters come from a sample that is drawn by size: a record's chance grows with its
bytes, so quantiles of the sample are quantiles of the corpus's bytes. The ranges between them are measured. An overfull
range, of too many bytes or rows, is subdivided by a finer sample of its own; so is one in which a shard ends, down to
single records. Ranges are then dealt in order: each goes whole to the shard in which the middle of its bytes lies, so
the splitters decide every record's shard, and shards differ by a record at most. Slots are ranks within ranges.

Only keys and sizes are shuffled, by range. Splitters are found by binary search in a sorted array. The sample has about
``SAMPLES`` records for each range, and ranges hold ``RANGE_BYTES`` or ``RANGE_ROWS`` at most: at 100 TB the driver holds
25,000 ranges. A range that is still overfull after ``ROUNDS`` subdivisions is ranked in one task, as it is.

Defined cases: a null text has no bytes (size 8, crc 0); null ids come first among equal texts; repeated rows take
slots each, in any order; an empty table gives an empty result. Columns in keep that clash with result columns are
dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, materialize

SHARDS, OVERHEAD = 24, 8
RANGE_BYTES, RANGE_ROWS = 4 << 30, 4_000_000
SAMPLES = 16
ROUNDS = 8
#: A range in which a shard ends is cut to records when it has no more than these.
FEW = 512
MADE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    text = F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    crc = F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long")
    number = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    key = F.concat(F.md5(F.coalesce(text, F.lit(""))), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), number)
    return docs.select(*[F.col(f"`{c}`") for c in keep], size.alias("size"), crc.alias("text_crc32"), key.alias("__q_key"))


def _ranged(keyed: DataFrame, splitters: list[str]) -> DataFrame:
    """keyed and the number of the range that holds each key."""
    cuts = np.array(sorted(splitters), "S")

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, keys.to_numpy().astype("S"), "right") if len(cuts) else np.zeros(len(keys))
        return pd.Series(at.astype(np.int32))

    return keyed.withColumn("__q_range", find("__q_key"))


def _quantiles(keys: list[str], parts: int) -> list[str]:
    keys = sorted(keys)
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if len(keys) >= parts else keys


def _drawn(rows: DataFrame, rate: Column, seed: int) -> DataFrame:
    """The rows drawn with a chance of size * rate."""
    return rows.where(F.pmod(F.xxhash64("__q_key", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) < F.col("size") * rate)


def _measure(keyed: DataFrame, cuts: list[str]) -> tuple[DataFrame, pd.DataFrame]:
    ranged = _ranged(keyed, cuts)
    sizes = ranged.groupBy("__q_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("__q_range", ignore_index=True)
    sizes["before"] = sizes["bytes"].cumsum() - sizes["bytes"]
    sizes["first"] = sizes["rows"].cumsum() - sizes["rows"]
    return ranged, sizes


def dealt(sizes: pd.DataFrame, shards: int, total: int) -> np.ndarray:
    """The shard in which each range's middle byte lies."""
    middle = [2 * b + n for b, n in zip(sizes["before"].tolist(), sizes["bytes"].tolist(), strict=True)]
    return np.array([min(shards - 1, m * shards // (2 * max(total, 1))) for m in middle], np.int64)


def _ends(sizes: pd.DataFrame, shards: int, total: int) -> np.ndarray:
    """Which ranges a shard ends in."""
    cuts = lambda x: np.array([v * shards // total for v in x.tolist()])
    return cuts(sizes["before"]) != cuts(sizes["before"] + sizes["bytes"] - 1)


def splitters(keyed: DataFrame, shards: int, ranges: int, total: int) -> tuple[DataFrame, pd.DataFrame]:
    """keyed with its ranges, and each range's bytes and rows, and those before it."""
    share = total / ranges
    drawn = _drawn(keyed, F.lit(SAMPLES / share), 0).select("__q_key").collect()
    cuts = set(_quantiles([r[0] for r in drawn], ranges))
    for step in range(1, ROUNDS + 1):
        ranged, sizes = _measure(keyed, sorted(cuts))
        over = (sizes["bytes"] > 2 * share) | (sizes["rows"] > RANGE_ROWS) | _ends(sizes, shards, total)
        over = sizes[over & (sizes["rows"] > 1)]
        if over.empty or step == ROUNDS:
            return ranged, sizes
        # Few rows are all drawn; of others so many that a range's parts have a 64th of it, or a share.
        parts = {int(r): max(64, int(-(-b // share)), int(-(-n // RANGE_ROWS))) for r, b, n in zip(over["__q_range"], over["bytes"], over["rows"], strict=True)}
        rates = {int(r): 2.0 if n <= FEW else SAMPLES * parts[int(r)] / b for r, b, n in zip(over["__q_range"], over["bytes"], over["rows"], strict=True)}
        few = {int(r) for r, n in zip(over["__q_range"], over["rows"], strict=True) if n <= FEW}
        listed = F.broadcast(keyed.sparkSession.createDataFrame(list(rates.items()), "__q_r int, __q_rate double"))
        drawn = _drawn(ranged.join(listed, F.col("__q_range") == F.col("__q_r")), F.col("__q_rate"), step)
        finer: dict[int, list[str]] = {}
        for r, k in drawn.select("__q_range", "__q_key").collect():
            finer.setdefault(r, []).append(k)
        cuts = cuts.union(*[keys if r in few else _quantiles(keys, parts[r]) for r, keys in finer.items()])
    raise AssertionError


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each of docs: the columns in keep, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and
    ``grown_shard`` (null: boundaries move when shards are added)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in MADE]
    keyed = materialize(_keyed(docs, id_col, text_col, keep), "shard-keys")
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    made = "size", "text_crc32", F.lit("bytes").alias("law")
    if not rows:
        return keyed.select(*[F.col(f"`{c}`") for c in keep], *made, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranged, sizes = splitters(keyed, shards, max(32 * shards, -(-total // RANGE_BYTES), -(-2 * rows // RANGE_ROWS)), total)
    home = dealt(sizes, shards, total)
    start = pd.Series(sizes["first"]).groupby(home).transform("min")
    at = list(zip(sizes["__q_range"].astype(int).tolist(), home.tolist(), (sizes["first"] - start).tolist(), strict=True))
    offsets = docs.sparkSession.createDataFrame(at, "__q_r int, shard int, __q_first long")
    ranged = ranged.join(F.broadcast(offsets) if len(at) <= MAX_BROADCAST_ROWS else offsets, F.col("__q_range") == F.col("__q_r"))
    slot = F.expr("__q_first + count(*) OVER (PARTITION BY __q_range ORDER BY __q_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1")
    return ranged.select(*[F.col(f"`{c}`") for c in keep], *made, "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs with shard and slot, a folder for each shard, in files of bounded size."""
    out = shard(docs, shards, id_col, text_col)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, keep=["doc_id"])


# The checksum byte by byte: eight shifts by the reflected polynomial for each.
_SHIFT = "xor(c >> 1, 3988292384 * (c & 1))"
ORACLE_SQL = f"""
WITH RECURSIVE tab(i, c, k) AS (SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL SELECT i, {_SHIFT}, k + 1 FROM tab WHERE k < 8),
tabs AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0) + {OVERHEAD} AS size, md5(coalesce(text, '')) || md5(coalesce(doc_id::VARCHAR, '')) AS key, coalesce(text, '') AS text FROM documents),
crc AS (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(text) + 1), lambda p: ('0x' || substr(h, 2 * p - 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS crc
    FROM (SELECT DISTINCT text, hex(encode(text)) AS h FROM d), tabs),
r AS (SELECT *, sum(size) OVER (ORDER BY key, rid) AS upto, row_number() OVER (ORDER BY key, rid) AS rank, sum(size) OVER () AS total FROM d),
s AS (SELECT *, least({SHARDS - 1}, floor((2 * upto - size) * {SHARDS} / (2 * total)))::INT AS shard FROM r)
SELECT doc_id, size::BIGINT AS size, crc.crc::BIGINT AS text_crc32, 'bytes' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM s JOIN crc ON s.text = crc.text
"""
