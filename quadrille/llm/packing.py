"""Packing by best-fit decreasing.

Documents become token ids, each with an end id. An overlong document is cut into full windows first; each is a
sequence of its own, and its place is known at once. What is left of every document, less than a window, is packed:
pieces in falling length, each into the open window with the least room that holds it, which a segment tree indexed by
remaining capacity finds.

Pieces get numbers and are written once to the shared folder. The rest is dealt by a hash of the number to groups of
about ``GROUP_ROWS``, so equal documents part; each group is packed by one task and wastes less than half of one window
beyond what the lengths force. A group holds less than ``GROUP_ROWS`` windows, with ids too, whatever the corpus holds.
Sequences of packed pieces have even numbers, full windows odd ones.

Defined cases: a null text counts as empty and gives the end id alone; repeated rows are packed each on their own, and so
are rows with a null id; an empty table gives no pieces. The result's columns are fixed, so that others of the input
cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoders
from .common import lean, materialize, text_or_empty

WINDOW, END_ID, GROUP_ROWS = 2048, 1, 4096


class RoomTree:
    """How many open windows have each remaining capacity; finds the least capacity that holds a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i, count = room + self.leaves, self.count
        while i:
            count[i] += n
            i >>= 1

    def tightest(self, length: int) -> int:
        """The least room of at least length that an open window has, or -1."""
        i, count = length + self.leaves, self.count
        while not count[i]:
            while i & 1:  # a right child: nothing to the right under this parent
                i >>= 1
            if i <= 1:
                return -1
            i += 1
        while i < self.leaves:
            i *= 2
            if not count[i]:
                i += 1
        return i - self.leaves


def best_fit(lengths: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each length, which come in falling order and are from 1 to capacity."""
    tree, open_with, fill, out = RoomTree(capacity), {}, [], []
    for n in lengths:
        room = tree.tightest(n)
        if room < 0:
            room, bin_ = capacity, len(fill)
            fill.append(0)
        else:
            bin_ = open_with[room].pop()
            tree.add(room, -1)
        out.append((bin_, fill[bin_]))
        fill[bin_] += n
        if room > n:
            open_with.setdefault(room - n, []).append(bin_)
            tree.add(room - n, 1)
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The documents' pieces: (id, start, length, ids_crc32, doc_tokens[, ids]); full windows, then the rest."""
    id_type = docs.schema[id_col].dataType
    schema = "start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoders.load(tokenizer)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in encoders.slices(texts):
                flat, sizes = coder.encode(texts[lo:hi])
                ends = np.cumsum(sizes)
                flat = np.insert(flat, ends, end_id).astype("<u4", copy=False)
                sizes = sizes + 1
                begins = np.cumsum(sizes) - sizes
                n = -(-sizes // window)
                doc = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(sizes[doc] - start, window)
                at = begins[doc] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                cols = [b.column("id").slice(lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc])]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)).astype(np.int32)), pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(lean(cut), f"id {id_type.simpleString()}, {schema}")


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """cut and for each piece ``sequence_id`` and ``offset``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    # A table, so that a number once given stays, whatever is computed anew.
    cut = materialize(cut.withColumn("__q_row", F.monotonically_increasing_id()), "pieces")
    rest = cut.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // GROUP_ROWS))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "__q_row"], ascending=[False, True, True], kind="stable")
        where = best_fit(pdf["length"].tolist(), window)
        pdf["sequence_id"] = [2 * (w * groups + key[0]) for w, _ in where]
        pdf["offset"] = [o for _, o in where]
        return pdf.drop(columns=["__q_group", "__q_row"])

    packed = rest.withColumn("__q_group", F.pmod(F.xxhash64("__q_row"), F.lit(groups))).groupBy("__q_group").applyInPandas(place, f"{fields}, sequence_id long, offset long")
    full = cut.where(F.col("length") == window).withColumns({"sequence_id": 2 * F.col("__q_row") + 1, "offset": F.lit(0).cast("long")}).drop("__q_row")
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most window ids."""
    return pack(pieces(docs, tokenizer, id_col, text_col, window, end_id, with_ids), window).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
