"""SentencePiece encoding and decoding: the N best segmentations of a text.

A text's pieces form a lattice. Forward Viterbi gives the best score from the start to every position; it is the exact
heuristic of an A-star search that grows hypotheses backward from the end, so complete ones leave the queue in the order
of their scores. No piece crosses the start of a word or a line end, so the lattice of a text is a chain of those of its
units. Every unit's two best are searched once and remembered; the same search then runs backward over the chain. The N
best deviate from the best only in the N - 1 units whose deviation comes first in the result's order, so the search
steps over the other units. Sums are exact, as scores are whole millionths. All N segmentations are composed and digested.

A unigram vocabulary's scores are its pieces' log frequencies. A BPE vocabulary holds ranks instead; its pieces get the
log of 1 / (rank + 1), as Zipf's law has it. A character that no piece holds becomes its UTF-8 bytes' pieces, or the
unknown piece where there are none, at 10 below the least score each.

Every remembered segmentation of a unit is decoded once; a text's decodes to the text when all of its units' do.

Defined cases: a null text counts as empty and has one segmentation, without pieces and with score 0; a text with fewer
than N segmentations gives them all; ties come in the order of their ids, read from the end. A mark U+2581 in a text
counts as a space and decodes to one. Columns in keep that clash with result columns are dropped.
"""

from __future__ import annotations

import contextlib
import gc
import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .encoders import slices

N_BEST = 4
#: Units that a worker remembers, at about 250 bytes each.
MAX_UNITS = 800_000
MADE = ["n_pieces", "score", "ids_crc32", "nbest_scores", "round_trip", "nbest_pieces", "nbest_crc32", "nbest_round_trip", "nbest"]
SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
SCALE = 1_000_000
#: The loss of a unit with one segmentation.
NEVER = 1 << 62


class Lattice:
    """Pieces with whole scores; finds the best segmentations of a string."""

    def __init__(self, pieces: dict[str, tuple[int, int]], fallback: dict[int, int], fallback_score: int, unknown: int = 0):
        self.pieces, self.fallback, self.fallback_score, self.unknown = pieces, fallback, fallback_score, unknown
        self.found = ahocorasick.Automaton()
        for piece, (i, score) in pieces.items():
            self.found.add_word(piece, (len(piece), (i,), score))
        self.found.make_automaton()

    def edges(self, text: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """For each end position the (start, ids, score) of the pieces that end there."""
        out: list[list[tuple[int, tuple[int, ...], int]]] = [[] for _ in range(len(text) + 1)]
        lone = [True] * (len(text) + 1)
        for at, (size, ids, score) in self.found.iter(text):
            out[at + 1].append((at + 1 - size, ids, score))
            if size == 1:
                lone[at + 1] = False
        for end in range(1, len(text) + 1):
            if lone[end]:
                out[end] += self.spelled(text, end)
        return out

    def spelled(self, text: str, end: int) -> list[tuple[int, tuple[int, ...], int]]:
        """The edge over a character that is no piece."""
        raw = text[end - 1].encode("utf-8", "replace")
        ids = tuple(self.fallback.get(b, self.unknown) for b in raw) if self.fallback else (self.unknown,)
        return [(end - 1, ids, self.fallback_score * len(ids))]

    def search(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, ids), best first."""
        size = len(text)
        edges: list[list[tuple[int, tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
        ahead = [0] + [-(1 << 62)] * size
        at_end, lone = 1, True
        for at, (length, ids, score) in self.found.iter(text):
            end = at + 1
            while at_end < end:
                if lone:
                    self._spell(text, at_end, edges, ahead)
                at_end, lone = at_end + 1, True
            if length == 1:
                lone = False
            start = end - length
            edges[end].append((start, ids, score))
            if ahead[start] + score > ahead[end]:
                ahead[end] = ahead[start] + score
        while at_end <= size:
            if lone:
                self._spell(text, at_end, edges, ahead)
            at_end, lone = at_end + 1, True
        # Hypotheses in the queue have no completion in common and each one has its score, so n are enough.
        queue = [(-ahead[size], (), size, 0)]
        out = []
        while queue:
            _, back, at, behind = queue.pop(0)
            if not at:
                out.append((behind, back[::-1]))
                continue
            for start, ids, score in edges[at]:
                total = behind + score
                queue.append((-total - ahead[start], back + (ids if len(ids) == 1 else ids[::-1]), start, total))
            if len(queue) > 1:
                queue.sort()
                del queue[n - len(out) :]
        return out

    def _spell(self, text: str, end: int, edges: list, ahead: list[int]) -> None:
        """The edge over the character that ends here and is no piece."""
        ((start, ids, score),) = self.spelled(text, end)
        edges[end].append((start, ids, score))
        ahead[end] = max(ahead[end], ahead[start] + score)


def packed(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def shown(spelled: bytes) -> str:
    return spelled.decode("utf-8", "replace").removeprefix(" ")


@contextlib.contextmanager
def no_collection() -> Iterator[None]:
    """Searches make many tuples and no cycles: looking for these would take a quarter of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


#: Loss, place, ids, whether they decode to the unit.
_Choice = tuple[int, int, tuple[int, ...], bool]


class Segmentation(NamedTuple):
    score: int
    n_pieces: int
    crc32: int
    round_trip: bool
    ids: np.ndarray | None


class _Slots(dict):
    def __missing__(self, unit: str) -> int:
        self[unit] = k = len(self)
        self.new.append(unit)
        return k


class Segmenter:
    """N-best encoding and decoding with a lattice none of whose pieces crosses the start of a word or a line end.
    surface: the bytes of every id."""

    def __init__(self, lattice: Lattice, surface: list[bytes]):
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in lattice.pieces):
            raise ValueError("the vocabulary has pieces that cross the start of a word or a line end")
        self.lattice, self.surface = lattice, surface
        self._clear()

    @classmethod
    def of_model(cls, path: str) -> Segmenter:
        """With the vocabulary of a sentencepiece model file."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = {i: sp.get_score(i) for i in plain}
        if all(float(s).is_integer() for s in scores.values()):
            scores = {i: -math.log1p(max(0.0, -s)) for i, s in scores.items()}
        whole = {i: round(s * SCALE) for i, s in scores.items()}
        bytes_ = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        surface = [b""] * size
        for i in plain:
            surface[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in bytes_.items():
            surface[i] = bytes([b])
        surface[sp.unk_id()] = surface[sp.unk_id()] or " ⁇ ".encode()
        return cls(Lattice({sp.id_to_piece(i): (i, s) for i, s in whole.items()}, bytes_, min(whole.values()) - 10 * SCALE, sp.unk_id()), surface)

    def _clear(self) -> None:
        self.slot = _Slots()
        self.slot.new = []
        self.units: list[str] = []
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.at = {k: np.zeros(1024, v) for k, v in (("start", np.int64), ("count", np.int64), ("best", np.int64), ("loss", np.int64), ("down", bool), ("faithful", bool))}
        self.deep: dict[int, list[_Choice]] = {}

    def _spells(self, unit: str, ids: tuple[int, ...]) -> bool:
        return b"".join([self.surface[i] for i in ids]) == unit.replace(SPACE, " ").encode("utf-8", "replace")

    def _learn(self) -> None:
        new, self.slot.new = self.slot.new, []
        while len(self.slot) > len(self.at["start"]):
            self.at = {k: np.concatenate([x, np.zeros_like(x)]) for k, x in self.at.items()}
        start, count, best, loss, down, faithful = self.at.values()
        found: list[int] = []
        base, search = self.used, self.lattice.search
        for k, u in enumerate(new, len(self.units)):
            (best[k], ids), *other = search(u, 2)
            loss[k] = best[k] - other[0][0] if other else NEVER
            down[k] = bool(other) and other[0][1][::-1] < ids[::-1]
            start[k], count[k] = base + len(found), len(ids)
            faithful[k] = self._spells(u, ids)
            found += ids
        self.units += new
        while self.used + len(found) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(found)] = found
        self.used += len(found)

    def _deep(self, k: int, n: int) -> list[_Choice]:
        """The n best of a unit as (loss, place in the order of ids from the end, ids, decodes to the unit)."""
        if len(self.deep.get(k, ())) < n:
            found = self.lattice.search(self.units[k], n)
            place = {ids: i for i, ids in enumerate(sorted((ids for _, ids in found), key=lambda x: x[::-1]))}
            self.deep[k] = [(found[0][0] - s, place[ids], ids, self._spells(self.units[k], ids)) for s, ids in found]
        return self.deep[k]

    def deviations(self, at: np.ndarray, n: int) -> list[tuple[int, list[tuple[int, _Choice]]]]:
        """Of a chain of units the n best: the loss, and the units (by place in the chain) that don't have their best.

        Backward A-star over the chain; what the units before a hypothesis lose at least, 0, is its exact heuristic.
        Of one loss, deviations to ids that come earlier are better the later they are, others the earlier."""
        loss = self.at["loss"][at]
        if n == 1 or not len(at):
            return [(0, [])]
        brink = np.partition(loss, n - 2)[n - 2] if len(loss) >= n else NEVER - 1
        few = np.flatnonzero(loss <= min(brink, NEVER - 1))
        if len(few) >= n:
            down = self.at["down"][at[few]]
            few = few[np.lexsort((np.where(down, -few, few), ~down, loss[few]))[: n - 1]]
        few = np.sort(few)[::-1].tolist()
        choices = [self._deep(int(at[i]), n) for i in few]
        queue: list[tuple[int, tuple[int, ...], tuple[int, ...]]] = [(0, (), ())]
        out = []
        while queue and len(out) < n:
            cost, places, picks = heapq.heappop(queue)
            step = len(picks)
            if step == len(few):
                out.append((cost, [(i, c[j]) for i, c, j in zip(few, choices, picks, strict=True) if j]))
                continue
            for j, (more, place, _, _) in enumerate(choices[step]):
                heapq.heappush(queue, (cost + more, (*places, place), (*picks, j)))
        return out

    def segmentations(self, texts: list[str], n: int = N_BEST, with_ids: bool = True) -> Iterator[list[Segmentation]]:
        """For each text its n best segmentations."""
        if len(self.slot) > MAX_UNITS:
            self._clear()
        units: list[str] = []
        sizes = []
        for t in texts:
            sizes.append(-len(units))
            if t:
                units += _UNIT.findall(SPACE + t.replace(" ", SPACE))
            sizes[-1] += len(units)
        at = np.fromiter(map(self.slot.__getitem__, units), np.int64, len(units))
        if self.slot.new:
            self._learn()
        count = self.at["count"][at]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.at["start"][at] - ends + count, count) + np.arange(total)].astype("<u4", copy=False)
        raw = memoryview(flat).cast("B") if total else memoryview(b"")
        best, wrong = self.at["best"][at], ~self.at["faithful"][at]
        upto = np.concatenate([[0], ends])
        first = 0
        for size in sizes:
            last = first + size
            lo, hi = int(upto[first]), int(upto[last])
            bad = int(wrong[first:last].sum())
            score = int(best[first:last].sum())
            out = []
            for cost, others in self.deviations(at[first:last], n):
                crc, pos, length, parts, off = 0, lo, hi - lo, [], bad
                for i, (_, _, ids, spells) in reversed(others):
                    a, b = int(upto[first + i]), int(upto[first + i + 1])
                    own = packed(ids)
                    crc = zlib.crc32(own, zlib.crc32(raw[4 * pos : 4 * a], crc))
                    length += len(ids) - (b - a)
                    off += (not spells) - int(wrong[first + i])
                    if with_ids:
                        parts += [flat[pos:a], np.array(ids, "<u4")]
                    pos = b
                crc = zlib.crc32(raw[4 * pos : 4 * hi], crc)
                whole = np.concatenate([*parts, flat[pos:hi]]).view("<i4") if with_ids else None
                out.append(Segmentation(score - cost, length, crc, not off, whole))
            yield out
            first = last

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[int, list[int]]]:
        """The n best (score in millionths, ids) of a text."""
        return [(s.score, s.ids.tolist()) for s in next(self.segmentations([text], n))]

    def decode(self, ids: Iterable[int]) -> str:
        return shown(b"".join(map(self.surface.__getitem__, ids)))


_loaded: dict[str, Segmenter] = {}


def load(path: str) -> Segmenter:
    if path not in _loaded:
        _loaded[path] = Segmenter.of_model(path)
    return _loaded[path]


def segment(docs: DataFrame, model: str, n: int = N_BEST, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """A row for each of docs: the columns in keep, the best segmentation's ``n_pieces``, ``score`` and ``ids_crc32``
    (of its ids as little-endian 32-bit numbers) and ``round_trip`` (it decodes to the text); of each segmentation the
    ``nbest_scores``, ``nbest_pieces``, ``nbest_crc32``, ``nbest_round_trip`` and, if asked for, ``nbest``: its ids."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in MADE]
    made = MADE if with_ids else MADE[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(model)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for lo, hi in slices(texts):
                cols: list[list] = [[] for _ in made]
                with no_collection():
                    for found in coder.segmentations(texts[lo:hi], n, with_ids):
                        scores, pieces, crcs, trips, ids = zip(*found, strict=True)
                        for c, v in zip(cols, (pieces[0], scores[0] / SCALE, crcs[0], [s / SCALE for s in scores], trips[0], pieces, crcs, trips, ids), strict=False):
                            c.append(v)
                kinds = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in b.columns[:-1]] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], [*b.schema.names[:-1], *made])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text_col).alias("__q_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    types = ["n_pieces long", "score double", "ids_crc32 long", "nbest_scores array<double>", "round_trip boolean", "nbest_pieces array<long>", "nbest_crc32 array<long>", "nbest_round_trip array<boolean>", "nbest array<array<int>>"][: len(made)]
    return source.mapInArrow(run, ", ".join([*fields, *types]))


def decode(rows: DataFrame, model: str, ids_col: str, out_col: str = "text") -> DataFrame:
    """rows and the text of each row's ids (null: null)."""

    @F.pandas_udf("string")
    def run(col):
        coder = load(model)
        return col.map(lambda ids: None if ids is None else coder.decode(ids))

    return rows.withColumn(out_col, run(F.col(ids_col)))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return segment(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], with_ids=False)
