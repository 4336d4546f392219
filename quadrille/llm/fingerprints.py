"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is a set of paragraph digests: its lines, cut after sentence ends and after ``BLOCK`` code points; the k-th copy
of a paragraph counts as another. A sketch is three rows of cells; every digest adds itself, a check and a count to one
cell of each. A row has a power of two of cells, the fewest with which all three have ``ROOM`` for each digest, so that
what differs between versions of a text can be recovered from their fingerprints alone. A sketch folds to half its size
by adding the halves of its rows, so sketches of all sizes subtract, which cancels what two texts share; peeling the
cells that hold a single digest recovers the rest. Where peeling fails, the texts differ in more than either sketch was
made for, and both are sketched again at four times the size. A fingerprint is the text of a sketch; ``compare_prints``
takes two; it is about three quarters as long as its text. The likeness of two texts is the number of digests that both have over those that either has, from their
counts and the number recovered; of two empty texts it is 1.

To set a document beside the next one in falling id order, rows are dealt to ranges, a partition for each range, and
streamed in order, so no task holds more than a stretch of its range. Rows are ordered by id (falling, null last) and the
digest of the text. Splitters are keys that exist, drawn by size; the row with a splitter's key also ends the range
before it, which closes the gap between ranges. Rows that share both id and text are interchangeable, so those of a key
over a range's size are dealt over several ranges; all their neighbors have the same text.

Defined cases: a null text counts as empty; ids are whole numbers; the last row is followed by the first; a single row is
followed by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Cells for each digest, and the fewest cells of a row.
ROOM, LEAST, GROWTH = 1.6, 4, 4
BLOCK = 96
RANGE_BYTES, MIN_RANGES, OVERSAMPLE = 1 << 30, 64, 8
#: Rows of one key for each range that it is dealt over, at least.
DEALT_ROWS = 1000
STRETCH_CHARS = 1_000_000
_CUT = re.compile(r"\n+|(?<=[.!?]) +")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)
_CHECK = np.uint64(0xA0761D6478BD642F)
_CELL = np.dtype([("count", "<i2"), ("keys", "<u8"), ("check", "<u2")])
#: The bits of a check that a fingerprint keeps.
_LOW = np.uint64(0xFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def digests(text: str) -> list[int]:
    """The digests of the text's paragraphs, no two of them equal."""
    found = []
    for p in _CUT.split(text):
        if len(p) <= BLOCK:
            if p:
                found.append(p)
        else:
            found += [p[i : i + BLOCK] for i in range(0, len(p), BLOCK)]
    if len(set(found)) < len(found):
        seen: dict[str, int] = {}
        out = []
        for p in found:
            seen[p] = k = seen.get(p, -1) + 1
            out.append(xxhash.xxh64_intdigest(p, k))
        return list(dict.fromkeys(out))
    return list(map(xxhash.xxh64_intdigest, found))


def row_size(digests: np.ndarray | int) -> np.ndarray:
    """Cells in a row of a sketch of so many digests: a power of two."""
    need = np.maximum(LEAST, np.ceil(np.asarray(digests) * ROOM / 3))
    return (1 << np.ceil(np.log2(need)).astype(np.int64)).astype(np.int64)


class Sketches:
    """Sketches side by side. rows: the cells in a row of each."""

    def __init__(self, rows: np.ndarray, bits: np.uint64 = np.uint64((1 << 64) - 1)):
        self.rows, self.bits = np.asarray(rows, np.int64), bits
        self.end = np.cumsum(3 * self.rows)
        self.base = self.end - 3 * self.rows
        cells = int(self.end[-1]) if len(self.rows) else 0
        self.count, self.keys, self.check = np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: int | np.ndarray = 1) -> Sketches:
        """Add (sign 1) or remove (sign -1) digests of the sketches numbered by owner."""
        sign = np.ascontiguousarray(np.broadcast_to(np.asarray(sign, np.int64), keys.shape))
        wide, check = keys * sign.view(np.uint64), _mix(keys ^ _CHECK) * sign.view(np.uint64)
        row, base = self.rows[owner], self.base[owner]
        for j in range(3):
            at = base + j * row + (_mix(keys + _SEEDS[j]).astype(np.int64) & (row - 1))
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, wide)
            np.add.at(self.check, at, check)
        return self

    def fold(self, rows: np.ndarray) -> Sketches:
        """The sketches at other sizes, none larger than its own."""
        if (rows == self.rows).all():
            return self
        out = Sketches(rows, self.bits)
        owner = np.repeat(np.arange(len(rows)), 3 * self.rows)
        j, cell = np.divmod(np.arange(len(owner)) - self.base[owner], self.rows[owner])
        at = out.base[owner] + j * out.rows[owner] + (cell & (out.rows[owner] - 1))
        for mine, other in ((out.count, self.count), (out.keys, self.keys), (out.check, self.check)):
            np.add.at(mine, at, other)
        return out

    def minus(self, other: Sketches) -> Sketches:
        """Differences, at the smaller size of each pair."""
        out = Sketches(np.minimum(self.rows, other.rows), self.bits & other.bits)
        a, b = self.fold(out.rows), other.fold(out.rows)
        out.count, out.keys, out.check = a.count - b.count, a.keys - b.keys, a.check - b.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, sign) of what is recovered, and for each sketch whether that is all. Empties the cells."""
        owners, keys, signs = [], [], []
        whose = np.repeat(np.arange(len(self.rows)), 3 * self.rows)
        todo = np.flatnonzero(np.abs(self.count) == 1)
        while len(todo):
            sign = self.count[todo]
            key = self.keys[todo] * sign.view(np.uint64)
            ok = (np.abs(sign) == 1) & ((_mix(key ^ _CHECK) * sign.view(np.uint64) - self.check[todo]) & self.bits == 0)
            owner, key, sign = whose[todo[ok]], key[ok], sign[ok]
            if not len(key):
                break
            order = np.lexsort((key, owner))
            owner, key, sign = owner[order], key[order], sign[order]
            first = np.ones(len(key), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
            owner, key, sign = owner[first], key[first], sign[first]
            self.add(key, owner, -sign)
            owners.append(owner)
            keys.append(key)
            signs.append(sign)
            row = self.rows[owner]
            near = np.unique(np.concatenate([self.base[owner] + j * row + (_mix(key + _SEEDS[j]).astype(np.int64) & (row - 1)) for j in range(3)]))
            todo = near[np.abs(self.count[near]) == 1]
        left = (self.count != 0) | (self.keys != 0)
        whole = np.bincount(whose[left], minlength=len(self.rows)) == 0
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return join(owners, np.int64), join(keys, np.uint64), join(signs, np.int64), whole

    def texts(self) -> list[str]:
        rows = np.empty(len(self.count), _CELL)
        rows["count"], rows["keys"], rows["check"] = self.count, self.keys, self.check & _LOW
        raw, size = rows.tobytes(), _CELL.itemsize
        return [base64.b64encode(raw[a * size : b * size]).decode() for a, b in zip(self.base.tolist(), self.end.tolist(), strict=True)]

    @classmethod
    def of_texts(cls, texts: list[str]) -> Sketches:
        raw = [np.frombuffer(base64.b64decode(t), _CELL) for t in texts]
        out = cls(np.array([len(r) // 3 for r in raw], np.int64), _LOW)
        cells = np.concatenate(raw) if raw else np.empty(0, _CELL)
        out.count, out.keys, out.check = cells["count"].astype(np.int64), cells["keys"].astype(np.uint64), cells["check"].astype(np.uint64)
        return out

    def sizes(self) -> np.ndarray:
        """How many digests each sketch holds."""
        first = np.repeat(np.arange(len(self.rows)), 3 * self.rows)
        inside = np.arange(len(first)) - self.base[first] < self.rows[first]
        return np.bincount(first[inside], self.count[inside], len(self.rows)).astype(np.int64)


def _flat(sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in sets], np.int64)
    return np.fromiter((x for s in sets for x in s), np.uint64, int(n.sum())), np.repeat(np.arange(len(sets)), n)


def sketch(sets: list[list[int]]) -> Sketches:
    return Sketches(row_size([len(s) for s in sets])).add(*_flat(sets))


def _likeness(total: np.ndarray, apart: np.ndarray) -> np.ndarray:
    return np.where(total > 0, (total - apart) / np.maximum(total + apart, 1), 1.0)


def compare_prints(left: list[str], right: list[str]) -> list[float | None]:
    """The likeness of each pair of fingerprints, or None where they differ in more than these can tell."""
    a, b = Sketches.of_texts(left), Sketches.of_texts(right)
    owner, _, _, whole = a.minus(b).peel()
    near = _likeness(a.sizes() + b.sizes(), np.bincount(owner, minlength=len(left)))
    return [float(x) if ok else None for x, ok in zip(near, whole, strict=True)]


def differences(left: list[list[int]], right: list[list[int]], first: Sketches | None = None) -> np.ndarray:
    """How many digests only one side of each pair has, by subtraction and peeling, at growing sizes. first: the
    difference of the pairs' sketches."""
    out = np.zeros(len(left), np.int64)
    todo = np.arange(len(left))
    first = first or sketch(left).minus(sketch(right))
    while len(todo):
        rows = first.rows
        owner, _, _, whole = first.peel()
        n = np.bincount(owner, minlength=len(todo))
        out[todo[whole]] = n[whole]
        todo, rows = todo[~whole], GROWTH * rows[~whole]
        if len(todo):
            first = Sketches(rows).add(*_flat([left[i] for i in todo]), 1).add(*_flat([right[i] for i in todo]), -1)
    return out


def likeness(left: list[list[int]], right: list[list[int]], first: Sketches | None = None) -> np.ndarray:
    return _likeness(np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.float64), differences(left, right, first))


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points of the following one's start, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(texts: list[str], following: list[str]) -> dict[str, list]:
    """Fingerprints of texts, of their edits by the following texts, and the likeness to either."""
    edited = [edit(a, b) for a, b in zip(texts, following, strict=True)]
    own, new, after = ([digests(t) for t in some] for some in (texts, edited, following))
    print_, print_new, print_after = sketch(own), sketch(new), sketch(after)
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": print_.texts(),
        "edited_fingerprint": print_new.texts(),
        "near_edited": likeness(own, new, print_.minus(print_new)),
        "near_next": likeness(own, after, print_.minus(print_after)),
    }


def _splitters(docs: DataFrame) -> list[str]:
    """Keys that start ranges, in order, the first key first; one comes as often as its rows take ranges."""
    size = F.octet_length("text") + 64
    stats = docs.agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("first")).first()
    if not stats["rows"]:
        return []
    ranges = max(MIN_RANGES, -(-stats["bytes"] // RANGE_BYTES))
    drawn = docs.where(F.rand(7) < size * (OVERSAMPLE * ranges / stats["bytes"])).select("key")
    keys = np.sort(drawn.toArrow().column("key").to_numpy(zero_copy_only=False).astype("S"))
    found = Counter(keys[np.arange(1, ranges) * len(keys) // ranges].tolist() if len(keys) >= ranges else np.unique(keys).tolist())
    hot = [(k.decode(), n) for k, n in found.items() if n > 1]
    found = dict.fromkeys((k.decode() for k in found), 1) | {stats["first"]: 1}
    if hot:  # at most one for two ranges
        listed = F.broadcast(docs.sparkSession.createDataFrame(hot, "key string, times int"))
        for r in docs.join(listed, "key").groupBy("key", "times").agg(F.count("*").alias("n")).collect():
            found[r["key"]] = max(1, min(r["times"], r["n"] // DEALT_ROWS))
    return [k for k in sorted(found) for _ in range(found[k])]


def in_order(docs: DataFrame) -> tuple[DataFrame, set[int]]:
    """docs (id, text) as (range, last, id, text), where the row with last 1 opens the following range; and the ranges
    whose rows all have the text that follows."""
    null = F.col("id").isNull()
    falling = F.lpad(F.hex(F.bitwise_not(F.coalesce("id", F.lit(0)).bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
    docs = docs.withColumn("key", F.concat(F.when(null, "1").otherwise("0"), falling, F.md5("text")))
    cuts = np.array(_splitters(docs), "S")
    n = len(cuts)
    low, high = (np.searchsorted(cuts, cuts, side) for side in ("left", "right"))
    pure = {int(i) + 1 for i in np.flatnonzero(np.arange(n) < high - 1)}

    @F.pandas_udf("range int, opens int")
    def place(keys: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        k = keys.to_numpy().astype("S")
        a, b = np.searchsorted(cuts, k, "left"), np.searchsorted(cuts, k, "right")
        own = np.where(b > a, a + 1 + numbers.to_numpy() % np.maximum(b - a, 1), b)
        # Of a key's rows those in its last range open the range before its first.
        return pd.DataFrame({"range": own, "opens": np.where((b > a) & (own == b), np.where(a > 0, a, n), -1)}, dtype="int32")

    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40))
    placed = docs.withColumn("at", place("key", number))
    own, before = F.struct(F.col("at.range").alias("range"), F.lit(0).alias("last")), F.struct(F.col("at.opens").alias("range"), F.lit(1).alias("last"))
    placed = placed.withColumn("at", F.explode(F.when(F.col("at.opens") >= 0, F.array(own, before)).otherwise(F.array(own))))
    placed = placed.select("at.range", "at.last", "id", "text", "key")
    return placed.repartitionById(max(n, 1), F.col("range") - 1).sortWithinPartitions("range", "last", "key").drop("key"), pure


def _pairs(batches: Iterable[pa.RecordBatch], pure: set[int]) -> Iterator[tuple[int, str, str]]:
    """(id, text, the next row's text) of a sorted stream of ranges."""
    held = None
    for b in batches:
        for where, last, id_, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if held and held[0] == where:
                yield held[1], held[2], text
            elif held and held[0] in pure:
                yield held[1], held[2], held[2]
            held = None if last else (where, id_, text)
    if held and held[0] in pure:
        yield held[1], held[2], held[2]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    source, pure = in_order(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            ids, texts, following = zip(*held, strict=True)
            cols = compare(list(texts), list(following))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())] + [pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)], ["id", *cols])

        for row in _pairs(batches, pure):
            held.append(row)
            size += len(row[1])
            if size > STRETCH_CHARS:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
