"""N-best segmentation against all segmentations of short texts, and decoding against the library."""

import random
import zlib

import pytest

P = pytest.importorskip("public_tokenizers")
from quadrille.llm import nbest  # noqa: E402


def every(lattice, text):
    """All segmentations of a string with their scores."""
    if not text:
        return [(0, ())]
    edges = lattice.edges(text)
    out = []

    def grow(at, ids, score):
        if not at:
            out.append((score, ids))
        for start, own, s in edges[at] if at else ():
            grow(start, own + ids, score + s)

    grow(len(text), (), 0)
    return out


@pytest.fixture(scope="module")
def coder():
    return nbest.load(P.path("piece_bpe_32k.model"))


def test_lattice_against_all():
    rng = random.Random(3)
    for _ in range(60):
        vocab = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(8)}
        lattice = nbest.Lattice({p: (i + 10, -rng.randrange(1, 9)) for i, p in enumerate(sorted(vocab))}, {97: 1, 98: 2}, -30)
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        want = sorted(every(lattice, text), key=lambda x: (-x[0], x[1][::-1]))
        assert lattice.search(text, 5) == want[:5]
        assert lattice.search(text, 10**6) == want


def test_texts_against_all(coder):
    for text in ["a b", "the cat", "\nx", "a\n\nb", "é ç", " the", "on  of", "日 a"]:
        want = sorted(every(coder.lattice, "▁" + text.replace(" ", "▁")), key=lambda x: (-x[0], x[1][::-1]))
        got = coder.encode(text, 6)
        assert [(s, tuple(ids)) for s, ids in got] == want[:6]
        assert all(coder.decode(ids) == text for _, ids in got)


@pytest.mark.parametrize("seed", range(8))
def test_ties_across_units_against_all(seed):
    """Few scores, so that most segmentations tie; ids in no order."""
    rng = random.Random(seed)
    for _ in range(40):
        vocab = {"▁", "a", "b"} | {"▁" * rng.randrange(2) + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 3))) for _ in range(7)}
        ids = rng.sample(range(3, 60), len(vocab))
        lattice = nbest.Lattice({p: (i, -10 * rng.randrange(1, 4)) for p, i in zip(sorted(vocab), ids, strict=True)}, {}, -90)
        surface = [b""] * 60
        for p, (i, _) in lattice.pieces.items():
            surface[i] = p.replace("▁", " ").encode()
        coder = nbest.Segmenter(lattice, surface)
        text = " ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4)))
        want = sorted(every(lattice, "▁" + text.replace(" ", "▁")), key=lambda x: (-x[0], x[1][::-1]))
        for n in (1, 2, 4, 7):
            assert [(s, tuple(x)) for s, x in coder.encode(text, n)] == want[:n]
            bare = next(coder.segmentations([text], n, with_ids=False))
            assert [(s.score, s.n_pieces, s.crc32, s.round_trip) for s in bare] == [(s, len(x), zlib.crc32(nbest.packed(x)), True) for s, x in want[:n]]


def test_a_surface_that_differs_is_no_round_trip():
    coder = nbest.Segmenter(nbest.Lattice({"▁a": (1, -1), "▁": (2, -5), "a": (3, -5)}, {}, -90), [b"?", b" A", b" ", b"a"])
    assert [(s.ids.tolist(), s.round_trip) for s in next(coder.segmentations(["a"], 3))] == [([1], False), ([2, 3], True)]


def test_cases(coder):
    assert coder.encode("") == [(0, [])]
    assert coder.decode([]) == ""
    lib = __import__("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for text in ["x" * 5000, "😀" * 50, "a ▁ b", "\x00 \t\r\n", "of the " * 300]:
        (_, ids), *_ = coder.encode(text, 1)
        assert coder.decode(ids) == text.replace("▁", " ") == lib.decode(ids)
