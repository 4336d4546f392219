"""Language identification by word-first backoff.

A word that the training texts hold is scored by its log frequency in each language. An unseen word falls back to its
character n-grams, from the longest length down: the first length of which the model knows one decides, by the mean of
the known n-grams' log frequencies. A text's language is that of the largest sum.

The model is fitted on a bounded sample: of every language at most about ``train_docs`` documents, drawn by a hash of
their ids, and of a document at most its first ``train_chars`` code points. That bounds the model's words and n-grams
too, and so what reaches the driver and is broadcast. Prediction is a map over whole texts: nothing is shuffled.

``score`` is the chance of the language among those learned, which nears 1 as texts grow, whatever they hold. So
``known`` is given as well: the share of a text's words that the model has seen in the language it finds. Gibberish and
languages that weren't learned have few.

Defined cases: null texts and texts without a letter are ``und`` with scores 0, and so is every text where there is
nothing to learn from. Ties go to the first language in alphabetical order. Repeated rows are each predicted alike.
Columns in keep that clash with result columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_or_empty
from .encoders import chunks

TRAIN_DOCS, TRAIN_CHARS = 600, 50_000
NGRAMS = (5, 4, 3, 2, 1)
MIN_COUNT = 2
#: Words whose scores a worker remembers.
MAX_WORDS = 150_000
UND = "und"
MADE = ["lang_pred", "score", "known"]
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


class _Rows(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Model:
    """Log frequencies of words and of character n-grams by language."""

    def __init__(self, counts: Iterable[tuple[str, str, int]], langs: Iterable[str] | None = None):
        counts = list(counts)
        self.langs = sorted({lang for lang, _, _ in counts} if langs is None else langs)
        at = {x: i for i, x in enumerate(self.langs)}
        words: dict[str, int] = {}
        for _, w, _ in counts:
            words.setdefault(w, len(words))
        table = np.zeros((len(words), len(at)), np.float64)
        grams: dict[int, dict[str, int]] = {k: {} for k in NGRAMS}
        cells: dict[int, Counter] = {k: Counter() for k in NGRAMS}
        for lang, w, n in counts:
            table[words[w], at[lang]] += n
            for k in NGRAMS:
                known = grams[k]
                for g in self.parts(w, k):
                    cells[k][known.setdefault(g, len(known)), at[lang]] += n
        often = table.sum(1) >= MIN_COUNT
        self.words = dict(zip((w for w, ok in zip(words, often, strict=True) if ok), range(int(often.sum())), strict=True))
        self.table = self._logs(table[often])
        self.seen = (table[often] > 0).astype(np.float32)
        self.grams = grams
        self.gram_tables = {}
        for k in NGRAMS:
            t = np.zeros((len(grams[k]), len(at)))
            for (i, j), n in cells[k].items():
                t[i, j] = n
            self.gram_tables[k] = self._logs(t)
        self._start()

    @staticmethod
    def parts(word: str, k: int) -> list[str]:
        word = f"^{word}$" if k > 1 else word
        return [word[i : i + k] for i in range(len(word) - k + 1)]

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        total = counts.sum(0, keepdims=True)
        return np.log((counts + 0.5) / (total + 0.5 * (len(counts) + 1))).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        self._rows = _Rows(self.words)
        self._rows.new = []
        # The scores of each word, and whether the languages have it.
        self._scores = np.concatenate([self.table, self.seen], 1)

    def _backoff(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        left = range(len(words))
        for k in NGRAMS:
            known, rest, owners, at = self.grams[k], [], [], []
            for i in left:
                found = [g for g in map(known.get, self.parts(words[i], k)) if g is not None]
                if found:
                    owners.append((i, len(found)))
                    at += found
                else:
                    rest.append(i)
            if owners:
                who, n = map(np.array, zip(*owners, strict=True))
                out[who] = np.add.reduceat(self.gram_tables[k][at], np.cumsum(n) - n, axis=0) / n[:, None]
            left = rest
        return out

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score, and the share of the words that are known in it."""
        k, total, n, letters = len(self.langs), np.zeros(2 * len(self.langs)), 0, False
        for part in chunks(text.lower()):
            words = _WORD.findall(part)
            if not words:
                continue
            letters = letters or any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)
            if len(self._rows) > MAX_WORDS + len(self.words):
                self._start()
            at = list(map(self._rows.__getitem__, words))
            if self._rows.new:
                new, self._rows.new = self._rows.new, []
                self._extra(new)
            total += self._scores[at].sum(0, dtype=np.float64)
            n += len(words)
        if not letters or not k:
            return UND, 0.0, 0.0
        best = int(np.argmax(total[:k]))
        return self.langs[best], float(1 / np.exp(np.minimum(total[:k] - total[best], 0)).sum()), float(total[k + best] / n)

    def _extra(self, new: list[str]) -> None:
        used = len(self._rows) - len(new)
        while len(self._rows) > len(self._scores):
            more = np.zeros((max(1024, len(self._scores)), 2 * len(self.langs)), np.float32)
            self._scores = np.concatenate([self._scores, more])
        self._scores[used : used + len(new), : len(self.langs)] = self._backoff(new)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """A model of the documents that are not held out and have a language."""
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_docs / n))])[F.col(lang_col)]
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30) < share
    sample = labelled.where(drawn).select(F.col(lang_col).alias("lang"), F.substring(text_or_empty(text_col), 1, train_chars).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for part in chunks(text.lower()):
                    seen.setdefault(lang, Counter()).update(_WORD.findall(part))
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    counts = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counts.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    return Model(zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True), sizes)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep, ``lang_pred``, ``score`` and ``known`` of every row."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in MADE]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # A text that is kept goes to Python once.
    carried = text_col if text_col in keep and dict(docs.dtypes)[text_col] == "string" else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(carried or "__q_text")
            found = [m.predict(t or "") for lo in range(0, b.num_rows, 512) for t in texts.slice(lo, 512).to_pylist()]
            cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + cols, [*keep, *MADE])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if carried else [text_or_empty(text_col).alias("__q_text")]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]]
    return source.mapInArrow(lean(run), ", ".join([*fields, "lang_pred string", "score double", "known double"]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, min_known: float = 0.15) -> DataFrame:
    """The rows of docs whose language is found with a score of at least min_score, and min_known of whose words are
    known in it, with docs' own columns. Where no language can be learned, all rows stay."""
    names = {c: f"__c_{i}" if c.lower() in MADE else c for i, c in enumerate(docs.columns)}
    df = docs.withColumnsRenamed({a: b for a, b in names.items() if a != b})
    model = fit(df)
    if not model.langs:
        return docs
    out = predict(df, model).where((F.col("lang_pred") != UND) & (F.col("score") >= min_score) & (F.col("known") >= min_known))
    return out.select(*[F.col(f"`{b}`").alias(a) for a, b in names.items()])
