"""Family dimension tables. They are small and of fixed size, and may be broadcast. Families are given by name or, with codes
that no name gives, as Family objects."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..families import CANDIDATES, SPECS, STEP, Complexity, Family, Layout, accept, as_family, first_candidate, hamming, rotate90
from ..schemas import FAMILY


def _all(names: list[str | Family] | None, max_candidates: int | None = CANDIDATES) -> list[Family]:
    return [as_family(n, max_candidates) for n in (names or list(SPECS))]


def _kind(f: Family) -> str:
    return SPECS[f.name][0] if f.name in SPECS else "custom"


def families(spark: SparkSession, names: list[str | Family] | None = None) -> DataFrame:
    rows = [(f.name, f.min_hamming, f.min_complexity, _kind(f), f.layout.size, f.layout.nbits, f.layout.border_start, f.layout.border_width, f.layout.reversed_border) for f in _all(names)]
    return spark.createDataFrame(rows, FAMILY)


def codes(spark: SparkSession, names: list[str | Family] | None = None, max_candidates: int | None = CANDIDATES) -> DataFrame:
    rows = [(f.name, i, int(c)) for f in _all(names, max_candidates) for i, c in enumerate(f.codes)]
    return spark.createDataFrame(rows, "family string, id int, code long")


def bits(spark: SparkSession, names: list[str | Family] | None = None) -> DataFrame:
    rows = [(f.name, i, x, y) for f in _all(names) for i, (x, y) in enumerate(f.layout.bits())]
    return spark.createDataFrame(rows, "family string, bit int, x int, y int")


def cells(spark: SparkSession, names: list[str | Family] | None = None) -> DataFrame:
    rows = [(f.name, i % f.layout.size, i // f.layout.size, c) for f in _all(names) for i, c in enumerate(f.layout.cells)]
    return spark.createDataFrame(rows, "family string, x int, y int, cell string")


def verify(spark: SparkSession, names: list[str | Family] | None = None) -> DataFrame:
    """A row for each family: its codes, how many come twice, the least distance of two codes in any turn and of a code
    to its own turns, the codes without enough edges, and whether all is as the family asks."""
    rows = []
    for f in _all(names):
        turns = [f.codes]
        for _ in range(3):
            turns.append(rotate90(turns[-1], f.layout.nbits))
        own = min((int(hamming(turns[0], t).min()) for t in turns[1:]), default=64) if len(f.codes) else 64
        apart = min((int(hamming(t[i + 1 :], c).min()) for t in turns for i, c in enumerate(f.codes[:-1])), default=64)
        flat = int((~Complexity(f.layout).enough(f.codes)).sum())
        twice = len(f.codes) - len(np.unique(f.codes))
        rows.append((f.name, len(f.codes), twice, apart, own, flat, not twice and min(apart, own) >= f.min_hamming))
    return spark.createDataFrame(rows, "family string, codes int, repeated int, least_distance int, least_own_distance int, low_complexity int, ok boolean")


def candidates(spark: SparkSession, layout: Layout, min_hamming: int, min_complexity: int, first: int, last: int) -> DataFrame:
    """(k, code) of the search's candidates from first to last that have enough edges and are far from their own turns,
    found by all tasks at once."""
    start, mask, nbits = first_candidate(layout, min_hamming, min_complexity), (1 << layout.nbits) - 1, layout.nbits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Complexity(layout)
        for b in batches:
            k = b.column(0).to_numpy()
            codes = (np.uint64(start) + k.astype(np.uint64) * np.uint64(STEP)) & np.uint64(mask)
            ok = rule.enough(codes)
            turned = rotate90(codes, nbits)
            ok &= (hamming(codes, turned) >= min_hamming) & (hamming(codes, rotate90(turned, nbits)) >= min_hamming)
            yield pa.RecordBatch.from_arrays([pa.array(k[ok]), pa.array(codes[ok].astype(np.int64))], ["k", "code"])

    return spark.range(first, last + 1).mapInArrow(run, "k long, code long")


def search(spark: SparkSession, layout: Layout, min_hamming: int, min_complexity: int, max_candidates: int | None = None, chunk: int = 1 << 22) -> np.ndarray:
    """The codes of families.generate(): candidates are filtered by all tasks, a chunk at a time, and accepted in their
    order on the driver, which holds a chunk's and the accepted ones."""
    total = min(1 << layout.nbits, max_candidates or 1 << layout.nbits)
    taken, out = np.empty(0, np.uint64), []
    for lo in range(1, total + 1, chunk):
        found = candidates(spark, layout, min_hamming, min_complexity, lo, min(lo + chunk - 1, total)).toArrow().sort_by("k")
        codes = found.column("code").to_numpy().astype(np.uint64)
        for part in np.array_split(codes, max(1, len(codes) // 4096)):
            new, taken = accept(part, taken, layout.nbits, min_hamming)
            out += new
    return np.array(out, np.uint64)
