"""Layouts, bit orders, code words and the search, against pinned values."""

import numpy as np
import pytest

from quadrille import families as fm
from quadrille.sources import files

# Nbits, border start, border width, reversed border, code 0, and the number of codes where it is whole.
PINNED = {
    "tag16h5": (16, 1, 6, False, 0x27C8, 30),
    "tag25h9": (25, 1, 7, False, 0x156F1F4, 35),
    "tag36h11": (36, 1, 8, False, 0xD7E00984B, None),
    "tagCircle21h7": (21, 2, 5, True, 0x157863, 38),
    "tagCircle49h12": (49, 3, 5, True, 0xC6C921D8614A, None),
    "tagCustom48h12": (48, 2, 6, True, 0xD6C8AE76DFF0, None),
    "tagStandard41h12": (41, 2, 5, True, 0x1BD8A64AD10, None),
    "tagStandard52h13": (52, 2, 6, True, 0x4064A19651FF1, None),
}


@pytest.mark.parametrize("name", PINNED)
def test_pinned(name):
    f = fm.family(name)
    lay = f.layout
    nbits, start, width, reverse, code, n = PINNED[name]
    assert (lay.nbits, lay.border_start, lay.border_width, lay.reversed_border, int(f.codes[0])) == (nbits, start, width, reverse, code)
    assert n is None or len(f.codes) == n
    assert len(lay.bits()) == len(set(lay.bits())) == nbits


def test_last_codes():
    assert int(fm.family("tag16h5").codes[-1]) == 0xB57A
    assert int(fm.family("tagCircle21h7").codes[-1]) == 0x1EC1E3


@pytest.mark.parametrize("name", PINNED)
def test_codes_are_apart(name):
    f = fm.family(name)
    codes = f.codes[:150]
    turns = [codes]
    for _ in range(3):
        turns.append(fm.rotate90(turns[-1], f.layout.nbits))
    assert (fm.rotate90(turns[-1], f.layout.nbits) == codes).all()
    far = np.stack([fm.hamming(codes[:, None], t[None, :]) for t in turns])
    far[0][np.diag_indices(len(codes))] = 99
    assert far.min() >= f.min_hamming


def test_prefix_of_search():
    lay = fm.Layout.standard(9)
    short, longer = fm.generate(lay, 12, 10, 500), fm.generate(lay, 12, 10, 3000, chunk=700)
    assert longer[: len(short)].tolist() == short.tolist()
    assert len(fm.generate(lay, 12, 10, max_codes=5)) == 5


@pytest.mark.parametrize("cells", ["ddd", "wwwwqwwww", "wbwwwwwww", "ddddddddd" * 9])
def test_bad_layouts(cells):
    with pytest.raises(fm.LayoutError):
        fm.Layout.parse(cells)


def test_render_turns_with_code():
    f = fm.family("tag36h11")
    cells = f.render(3)
    turned = fm.Family("t", f.layout, 11, 10, fm.rotate90(f.codes, 36))
    assert (np.rot90(cells, -1) == turned.render(3)).all() or (np.rot90(cells) == turned.render(3)).all()
    assert len(f.rgba(0)) == 400


def test_toml_and_codes():
    f = fm.family("tag16h5")
    text = 'name = "tag16h5"\nmin_hamming = 5\nmin_complexity = 5\n[layout]\ntype = "classic"\ngrid_size = 8\n'
    again = fm.from_toml(text, files.code_file(f))
    assert again.layout == f.layout and (again.codes == f.codes).all()
    with pytest.raises(fm.FamilyError):
        fm.parse_codes(b"123")
    with pytest.raises(fm.FamilyError):
        fm.from_toml("name = 1", b"")
    with pytest.raises(fm.FamilyError):
        fm.family("none")


def test_ids():
    assert files.parse_ids("0-4,7, 10-12") == [0, 1, 2, 3, 4, 7, 10, 11, 12]
    with pytest.raises(ValueError):
        files.parse_ids("4-1")


def test_all_codes_of_the_default_family():
    codes = fm.family("tag36h11").codes
    assert len(codes) == len(set(codes.tolist())) == 587
    turns = [codes]
    for _ in range(3):
        turns.append(fm.rotate90(turns[-1], 36))
    far = np.stack([fm.hamming(codes[:, None], t[None, :]) for t in turns])
    far[0][np.diag_indices(587)] = 99
    assert far.min() >= 11
