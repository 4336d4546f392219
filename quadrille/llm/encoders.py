"""Encoders over the public vocabularies, exact to their libraries.

The tokenizers library spends most of its time outside of the merges. Where a vocabulary splits texts into words first,
the ids of a text are those of its words, one after the other: words are looked up in a bounded table, and the library
encodes only those that are missing. Texts for which that split isn't proven go to the library whole.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Units that a worker remembers; the table starts anew when it is full.
MAX_UNITS = 600_000
#: Characters that are split into units at once, so that memory doesn't grow with the text.
CHUNK_CHARS = 1_000_000

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_loaded: dict[str, object] = {}


def version(path: str) -> str:
    """Digest of the library, its version and the vocabulary file: others never share stored counts."""
    library = importlib.import_module("tokenizers" if path.endswith(".json") else "sentencepiece")
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}:".encode() + f.read()).hexdigest()


def load(path: str):
    if path not in _loaded:
        _loaded[path] = WordEncoder(path) if path.endswith(".json") else PieceEncoder(path)
    return _loaded[path]


def chunks(text: str) -> Iterator[str]:
    """Parts of about CHUNK_CHARS that start with a space, but for the first."""
    at = 0
    while len(text) - at > CHUNK_CHARS:
        end = text.find(" ", at + CHUNK_CHARS)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def slices(texts: list[str], most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many texts, with about CHUNK_CHARS together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS or i + 1 - start >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class _Slots(dict):
    """Gives each new key the next number and notes it in new."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class WordEncoder:
    """A vocabulary for the tokenizers library; encode() gives the ids without added special tokens."""

    # Letters, digits and spaces of U+0000 to U+017F after lower-casing; U+0130 grows when lower-cased and is left out.
    _LETTERS, _DIGITS, _SPACES = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼-¾", "\t\n\x0b\x0c\r \x85\xa0"
    #: Parts the texts that are split together; it lies outside of the characters above.
    _MARK = "\ue000"
    _UNIT = re.compile(f"{_MARK}|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}{_MARK}]+")
    _OUTSIDE = re.compile("[^\x00-\u012f\u0131-\u017f]")
    _KNOWN_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]  # noqa: RUF012
    _KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = (spec.get("normalizer") or {}).get("normalizers")
        first = steps[0]
        self.by_word = (
            normal == self._KNOWN_NORMAL and len(steps) == 2 and first.get("pattern") == {"Regex": self._KNOWN_SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
        )
        if self.by_word:
            spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
            #: For words that are normalised and split already.
            self.words = Tokenizer.from_str(json.dumps(spec))
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(self.library.get_vocab_size())])
        self._clear()

    def _clear(self) -> None:
        self.slot, self.known = _Slots({self._MARK: 0}), 1
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _add(self, units: list[str]) -> None:
        """Encode units together, a space between; the ids that end a word part them again."""
        ids = np.array(self.words.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(units) or ends[-1] != len(ids):
            each = [e.ids for e in self.library.encode_batch(units, add_special_tokens=False)]
            ids, ends = np.array([x for e in each for x in e], np.uint32), np.cumsum([len(e) for e in each])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        n = self.known
        while n + len(units) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count))
        begins = np.concatenate([[0], ends[:-1]])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(units)] = begins + self.used
        self.count[n : n + len(units)] = ends - begins
        self.used += len(ids)
        self.known += len(units)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for a, b in slices(texts):
            for i, part, counts in self._some(texts, a, b):
                parts.append(part)
                sizes[i : i + len(counts)] += counts
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), sizes

    def _some(self, texts: list[str], a: int, b: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, ids of each text) for runs of texts[a:b]."""
        run = a
        for i in range(a, b):
            t = texts[i]
            odd = not self.by_word or self._OUTSIDE.search(t) or any(x in t for x in self.added)
            if not odd and len(t) <= CHUNK_CHARS:
                continue
            if run < i:
                yield run, *self._units(texts[run:i])
            run = i + 1
            if odd:
                ids = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
                yield i, ids, np.array([len(ids)])
            else:
                for part in chunks(t):
                    yield i, *self._units([part])
        if run < b:
            yield run, *self._units(texts[run:b])

    def _units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slot) > MAX_UNITS:
            self._clear()
        units = self._UNIT.findall((self._MARK.join(texts) + self._MARK).lower())
        at = np.fromiter(map(self.slot.__getitem__, units), np.int64, len(units))
        new, self.slot.new = self.slot.new, []
        for i in range(0, len(new), 1000):
            self._add(new[i : i + 1000])
        n = self.count[at]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.start[at] - ends + n, n) + np.arange(ends[-1])]
        return ids, np.diff(ends[at == 0], prepend=0)

    def counts(self, texts: list[str]) -> list[int]:
        return [int(n) for a, b in slices(texts) for n in self.encode(texts[a:b])[1]]


class PieceEncoder:
    """A vocabulary for the sentencepiece library; counts() gives the number of pieces of whole texts."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for a, b in slices(texts) for x in self.library.encode(texts[a:b], num_threads=1)]
