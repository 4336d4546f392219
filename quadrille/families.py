"""Marker families: layouts, bit order, code words, and the search that generates them.

A layout is a square grid of cells: data (d), black (b), white (w) and ignored (x). Everything here is a handful of
cells and, at most, some thousand codes, so it is computed on the driver and becomes small dimension tables.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from functools import cache

import numpy as np

STEP = 982_451_653  # fixed value: the distance between candidates of the search


class LayoutError(ValueError):
    """A layout string that is no layout."""


class FamilyError(ValueError):
    """A family description or code file that can't be read."""


@dataclass(frozen=True)
class Layout:
    size: int
    cells: str
    border_start: int
    reversed_border: bool

    @property
    def nbits(self) -> int:
        return self.cells.count("d")

    @property
    def border_width(self) -> int:
        return self.size - 2 * self.border_start

    def cell(self, x: int, y: int) -> str:
        return self.cells[y * self.size + x]

    def grid(self) -> np.ndarray:
        return np.array(list(self.cells)).reshape(self.size, self.size)

    @staticmethod
    def parse(cells: str) -> Layout:
        """A layout from its cells in reading order. It must be square, the same in all four rotations, and have a
        ring of one color around a ring of the other."""
        size = int(len(cells) ** 0.5)
        if size * size != len(cells):
            raise LayoutError(f"{len(cells)} cells are no square")
        odd = [c for c in cells if c not in "dbwx"]
        if odd:
            raise LayoutError(f"{odd[0]!r} is no cell")
        grid = np.array(list(cells)).reshape(size, size)
        if not (grid == np.rot90(grid)).all():
            raise LayoutError("the layout changes when it is rotated")
        diagonal = "".join(grid[i, i] for i in range((size + 1) // 2))
        steps = [(i, diagonal[i : i + 2]) for i in range((size - 1) // 2) if diagonal[i : i + 2] in ("wb", "bw")]
        if not steps:
            raise LayoutError("the layout has no border")
        at, pair = steps[0]
        for ring, color in ((at, pair[0]), (at + 1, pair[1])):
            if set(grid[ring, ring : size - ring]) != {color}:
                raise LayoutError(f"ring {ring} isn't all {color}")
        return Layout(size, cells, at + 1, pair == "bw")

    @staticmethod
    def _rings(size: int, of_ring) -> Layout:
        i = np.minimum(np.arange(size), size - 1 - np.arange(size))
        ring = np.minimum(i[:, None], i[None, :])
        return Layout.parse("".join(of_ring(int(k), x, y) for y, row in enumerate(ring) for x, k in enumerate(row)))

    @staticmethod
    def classic(size: int) -> Layout:
        return Layout._rings(size, lambda k, x, y: {0: "w", 1: "b"}.get(k, "d"))

    @staticmethod
    def standard(size: int) -> Layout:
        return Layout._rings(size, lambda k, x, y: {1: "b", 2: "w"}.get(k, "d"))

    @staticmethod
    def circle(size: int) -> Layout:
        half = size / 2
        radius = half - 0.25
        border = int(np.ceil(half - radius * 0.5**0.5 - 0.5))
        far = lambda x, y: np.hypot(x + 0.5 - half, y + 0.5 - half) > radius
        return Layout._rings(size, lambda k, x, y: {border: "b", border + 1: "w"}.get(k, "x" if far(x, y) else "d"))

    def bits(self) -> list[tuple[int, int]]:
        """Where each bit lies, counted from the border's inner corner, most significant first: the data cells of the
        top quadrant in reading order, then their rotations, then the center."""
        n = self.size
        quarter = [(x, y) for y in range(n // 2) for x in range(y, n - 1 - y) if self.cell(x, y) == "d"]
        out = list(quarter)
        for _ in range(3):
            quarter = [(n - 1 - y, x) for x, y in quarter]
            out += quarter
        if n % 2 and self.cell(n // 2, n // 2) == "d":
            out.append((n // 2, n // 2))
        return [(x - self.border_start, y - self.border_start) for x, y in out]


def rotate90(code, nbits: int):
    """A code, or an array of codes, seen after a quarter turn. Where nbits is 4k + 1, the lowest bit is the center."""
    low = nbits % 4 == 1
    quarter = nbits // 4
    code = np.asarray(code, np.uint64)
    ring = code >> np.uint64(low)
    width = np.uint64(4 * quarter)
    ring = ((ring << np.uint64(quarter)) | (ring >> np.uint64(3 * quarter))) & ((np.uint64(1) << width) - np.uint64(1))
    return (ring << np.uint64(1)) | (code & np.uint64(1)) if low else ring


def hamming(a, b):
    return np.bitwise_count(np.asarray(a, np.uint64) ^ np.asarray(b, np.uint64))


class Complexity:
    """Which codes have enough edges between neighboring cells: a third of twice the counted cells or more."""

    def __init__(self, layout: Layout, bits: list[tuple[int, int]] | None = None):
        n, start = layout.size, layout.border_start
        where = {(x + start, y + start): layout.nbits - 1 - i for i, (x, y) in enumerate(bits or layout.bits())}
        kind = lambda x, y: where.get((x, y), layout.cell(x, y))
        self.need = 2 * sum(c != "x" for c in layout.cells)
        self.fixed, self.pairs, self.weights = 0, [], {}
        for y in range(n):
            for x in range(n):
                for a, b in ((kind(x, y), kind(*q)) for q in ((x + 1, y), (x, y + 1)) if max(q) < n):
                    if isinstance(a, str) and isinstance(b, str):
                        self.fixed += {a, b} == {"b", "w"}
                    elif isinstance(a, int) and isinstance(b, int):
                        self.pairs.append((a, b))
                    else:
                        bit, color = (a, b) if isinstance(a, int) else (b, a)
                        if color == "w":  # an edge unless the bit is set
                            self.fixed += 1
                            self.weights[bit] = self.weights.get(bit, 0) - 1
                        elif color == "b":
                            self.weights[bit] = self.weights.get(bit, 0) + 1

    def energy(self, codes: np.ndarray) -> np.ndarray:
        total = np.full(codes.shape, self.fixed, np.int32)
        for weight in set(self.weights.values()):
            mask = np.uint64(sum(1 << b for b, w in self.weights.items() if w == weight))
            total += weight * np.bitwise_count(codes & mask).astype(np.int32)
        for a, b in self.pairs:
            total += (((codes >> np.uint64(a)) ^ (codes >> np.uint64(b))) & np.uint64(1)).astype(np.int32)
        return total

    def enough(self, codes: np.ndarray) -> np.ndarray:
        return 3 * self.energy(codes) >= self.need


def first_candidate(layout: Layout, min_hamming: int, min_complexity: int) -> int:
    """The first draw of 64 bits from a 48-bit linear congruential generator seeded by the family's numbers."""
    state = (layout.nbits * 10_000 + min_hamming * 100 + min_complexity) ^ 0x5DEECE66D
    draws = []
    for _ in range(2):
        state = (state * 0x5DEECE66D + 0xB) % (1 << 48)
        draws.append(state >> 16)
    high, low = draws
    return ((high << 32) + (low - (1 << 32) if low >> 31 else low)) % (1 << layout.nbits)


def generate(layout: Layout, min_hamming: int, min_complexity: int, max_candidates: int | None = None, max_codes: int | None = None, chunk: int = 1 << 16, progress=None) -> np.ndarray:
    """Codes in the order of the search. It only ever appends, so fewer candidates give the same first codes."""
    nbits = layout.nbits
    return search(Complexity(layout), nbits, first_candidate(layout, min_hamming, min_complexity), min_hamming, max_candidates, max_codes, chunk, progress)


def search(rule: Complexity, nbits: int, start: int, min_hamming: int, max_candidates: int | None = None, max_codes: int | None = None, chunk: int = 1 << 16, progress=None) -> np.ndarray:
    total = min(1 << nbits, max_candidates or 1 << nbits)
    mask = np.uint64((1 << nbits) - 1)
    taken = np.empty(0, np.uint64)
    out: list[int] = []
    for lo in range(0, total, chunk):
        if progress:
            progress(lo, total, len(out))
        k = np.arange(lo + 1, min(lo + chunk, total) + 1, dtype=np.uint64)
        codes = (np.uint64(start) + k * np.uint64(STEP)) & mask
        new, taken = accept(codes[rule.enough(codes)], taken, nbits, min_hamming, max_codes and max_codes - len(out))
        out += new
        if max_codes and len(out) >= max_codes:
            break
    return np.array(out, np.uint64)


def accept(codes: np.ndarray, taken: np.ndarray, nbits: int, min_hamming: int, most: int | None = None) -> tuple[list[int], np.ndarray]:
    """The codes, in their order, that are far enough from their own turns, from taken and from those accepted before;
    and taken with every turn of these."""
    turns = [codes]
    for _ in range(3):
        turns.append(rotate90(turns[-1], nbits))
    # Rotations by 1 and 3 are equally far; so a quarter and a half turn tell all.
    ok = (hamming(turns[0], turns[1]) >= min_hamming) & (hamming(turns[0], turns[2]) >= min_hamming)
    turns = np.stack(turns)[:, ok]
    if len(taken):
        far = np.ones(turns.shape[1], bool)
        for part in np.array_split(taken, max(1, len(taken) // 64)):
            at = np.flatnonzero(far)
            far[at] = (hamming(turns[0, at][:, None], part[None, :]) >= min_hamming).all(1)
        turns = turns[:, far]
    out: list[int] = []
    while turns.shape[1] and (most is None or len(out) < most):
        out.append(int(turns[0, 0]))
        new = turns[:, 0]
        taken = np.concatenate([taken, new])
        turns = turns[:, 1:]
        turns = turns[:, (hamming(turns[0][:, None], new[None, :]) >= min_hamming).all(1)]
    return out, taken


def upgrade(code: int, layout: Layout) -> int:
    """A code whose bits are in reading order, in the order of bits()."""
    side = round(layout.nbits**0.5)
    out = 0
    for x, y in layout.bits():
        out = out << 1 | code >> ((side - x) + (side - y) * side) & 1
    return out


@dataclass(frozen=True, eq=False)
class Family:
    """A layout and its codes; the number of a code in the array is the marker's id."""

    name: str
    layout: Layout
    min_hamming: int
    min_complexity: int | None
    codes: np.ndarray = field(repr=False)

    def render(self, id_: int) -> np.ndarray:
        """The marker's cells: 0 black, 255 white, -1 transparent."""
        lay, code = self.layout, int(self.codes[id_])
        out = np.select([lay.grid() == "b", lay.grid() == "w"], [0, 255], -1)
        for i, (x, y) in enumerate(lay.bits()):
            out[y + lay.border_start, x + lay.border_start] = 255 * (code >> (lay.nbits - 1 - i) & 1)
        return out

    def rgba(self, id_: int) -> bytes:
        cells = self.render(id_)
        gray = np.where(cells < 0, 0, cells).astype(np.uint8)
        return np.stack([gray, gray, gray, np.where(cells < 0, 0, 255).astype(np.uint8)], -1).tobytes()


def make_layout(kind: str, size: int, data: str | None = None) -> Layout:
    if kind == "custom":
        return Layout.parse(data or "")
    try:
        return {"classic": Layout.classic, "standard": Layout.standard, "circle": Layout.circle}[kind](size)
    except KeyError:
        raise FamilyError(f"{kind!r} is no layout") from None


def parse_codes(raw: bytes) -> np.ndarray:
    if len(raw) % 8:
        raise FamilyError(f"{len(raw)} bytes are no 64-bit codes")
    return np.frombuffer(raw, "<u8").astype(np.uint64)


def from_toml(text: str, codes: bytes) -> Family:
    """A family from its description and its codes as little-endian 64-bit numbers."""
    try:
        d = tomllib.loads(text)
        layout = d["layout"]
        made = make_layout(layout["type"].lower(), layout.get("grid_size", 0), layout.get("data"))
        return Family(d["name"], made, d["min_hamming"], d.get("min_complexity"), parse_codes(codes))
    except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError) as e:
        raise FamilyError(f"no family: {e!r}") from e


# The families' numbers, and a custom layout.
SPECS = {
    "tag16h5": ("classic", 8, None, 5, 5),
    "tag25h9": ("classic", 9, None, 9, 8),
    "tag36h11": ("classic", 10, None, 11, 10),
    "tagCircle21h7": ("circle", 9, None, 7, 10),
    "tagCircle49h12": ("circle", 11, None, 12, 15),
    "tagCustom48h12": ("custom", 10, "dddddddddddbbbbbbbbddbwwwwwwbddbwddddwbddbwdxxdwbddbwdxxdwbddbwddddwbddbwwwwwwbddbbbbbbbbddddddddddd", 12, 12),
    "tagStandard41h12": ("standard", 9, None, 12, 10),
    "tagStandard52h13": ("standard", 10, None, 13, 12),
}
#: Candidates that a built-in family's search goes through by default; the codes found are the family's first ones.
CANDIDATES = 1 << 13

# All codes of the classic families with their bits in reading order, by id.
CLASSIC = {
    "tag16h5": """
        0x231b 0x2ea5 0x346a 0x45b9 0x79a6 0x7f6b 0xb358 0xe745 0xfe59 0x156d
        0x380b 0xf0ab 0x0d84 0x4736 0x8c72 0xaf10 0x093c 0x93b4 0xa503 0x468f
        0xe137 0x5795 0xdf42 0x1c1d 0xe9dc 0x73ad 0xad5f 0xd530 0x07ca 0xaf2e
    """,
    "tag25h9": """
        0x155cbf1 0x1e4d1b6 0x17b0b68 0x1eac9cd 0x12e14ce 0x3548bb 0x7757e6 0x1065dab 0x1baa2e7 0xdea688
        0x81d927 0x51b241 0xdbc8ae 0x1e50e19 0x15819d2 0x16d8282 0x163e035 0x9d9b81 0x173eec4 0xae3a09
        0x5f7c51 0x1a137fc 0xdc9562 0x1802e45 0x1c3542c 0x870fa4 0x914709 0x16684f0 0xc8f2a5 0x833ebb
        0x59717f 0x13cd050 0xfa0ad1 0x1b763b0 0xb991ce
    """,
    "tag36h11": """
        0xd5d628584 0xd97f18b49 0xdd280910e 0xe479e9c98 0xebcbca822 0xf31dab3ac 0x056a5d085 0x10652e1d4 0x22b1dfead 0x265ad0472
        0x34fe91b86 0x3ff962cd5 0x43a25329a 0x474b4385f 0x4e9d243e9 0x5246149ae 0x5997f5538 0x683bb6c4c 0x6be4a7211 0x7e3158eea
        0x81da494af 0x858339a74 0x8cd51a5fe 0x9f21cc2d7 0xa2cabc89c 0xadc58d9eb 0xb16e7dfb0 0xb8c05eb3a 0xd25ef139d 0xd607e1962
        0xe4aba3076 0x2dde6a3da 0x43d40c678 0x5620be351 0x64c47fa65 0x686d7002a 0x6c16605ef 0x6fbf50bb4 0x8d06d39dc 0x9f53856b5
        0xadf746dc9 0xbc9b084dd 0xd290aa77b 0xd9e28b305 0xe4dd5c454 0xfad2fe6f2 0x181a8151a 0x26be42c2e 0x2e10237b8 0x405cd5491
        0x7742eab1c 0x85e6ac230 0x8d388cdba 0x9f853ea93 0xc41ea2445 0xcf1973594 0x14a34a333 0x31eacd15b 0x6c79d2dab 0x73cbb3935
        0x89c155bd3 0x8d6a46198 0x91133675d 0xa708d89fb 0xae5ab9585 0xb9558a6d4 0xb98743ab2 0xd6cec68da 0x1506bcaef 0x4becd217a
        0x4f95c273f 0x658b649dd 0xa76c4b1b7 0xecf621f56 0x1c8a56a57 0x3628e92ba 0x53706c0e2 0x5e6b3d231 0x7809cfa94 0xe97eead6f
        0x5af40604a 0x7492988ad 0xed5994712 0x5eceaf9ed 0x7c1632815 0xc1a0095b4 0xe9e25d52b 0x3a6705419 0xa8333012f 0x4ce5704d0
        0x508e60a95 0x877476120 0xa864e950d 0xea45cfce7 0x19da047e8 0x24d4d5937 0x6e079cc9b 0x99f2e11d7 0x33aa50429 0x499ff26c7
        0x50f1d3251 0x66e7754ef 0x96ad633ce 0x9a5653993 0xaca30566c 0xc298a790a 0x8be44b65d 0xdc68f354b 0x16f7f919b 0x4dde0e826
        0xd548cbd9f 0xe0439ceee 0xfd8b1fd16 0x76521bb7b 0xd92375742 0xcab16d40c 0x730c9dd72 0xad9ba39c2 0xb14493f87 0x52b15651f
        0x185409cad 0x77ae2c68d 0x94f5af4b5 0x0a13bad55 0x61ea437cd 0xa022399e2 0x203b163d1 0x7bba8f40e 0x95bc9442d 0x41c0b5358
        0x8e9c6cc81 0x0eb549670 0x9da3a0b51 0xd832a67a1 0xdcd4350bc 0x4aa05fdd2 0x60c7bb44e 0x4b358b96c 0x067299b45 0xb9c89b5fa
        0x6975acaea 0x62b8f7afa 0x33567c3d7 0xbac139950 0xa5927c62a 0x5c916e6a4 0x260ecb7d5 0x29b7bbd9a 0x903205f26 0xae72270a4
        0x3d2ec51a7 0x82ea55324 0x11a6f3427 0x1ca1c4576 0xa40c81aef 0xbddccd730 0x0e617561e 0x969317b0f 0x67f781364 0x610912f96
        0xb2549fdfc 0x06e5aaa6b 0xb6c475339 0xc56836a4d 0x844e351eb 0x4647f83b4 0x0908a04f5 0x7f51034c9 0xaee537fca 0x5e92494ba
        0xd445808f4 0x28d68b563 0x04d25374b 0x2bc065f65 0x96dc3ea0c 0x4b2ade817 0x07c3fd502 0xe768b5caf 0x17605cf6c 0x182741ee4
        0x62846097c 0x72b5ebf80 0x263da6e13 0xfa841bcb5 0x7e45e8c69 0x653c81fa0 0x7443b5e70 0x0a5234afd 0x74756f24e 0x157ebf02a
        0x82ef46939 0x80d420264 0x2aeed3e98 0xb0a1dd4f8 0xb5436be13 0x7b7b4b13b 0x1ce80d6d3 0x16c08427d 0xee54462dd 0x1f7644cce
        0x9c7b5cc92 0xe369138f8 0x5d5a66e91 0x485d62f49 0xe6e819e94 0xb1f340eb5 0x09d198ce2 0xd60717437 0x0196b856c 0xf0a6173a5
        0x12c0e1ec6 0x62b82d5cf 0xad154c067 0xce3778832 0x6b0a7b864 0x4c7686694 0x5058ff3ec 0xd5e21ea23 0x9ff4a76ee 0x9dd981019
        0x1bad4d30a 0xc601896d1 0x973439b48 0x1ce7431a8 0x57a8021d6 0xf9dba96e6 0x83a2e4e7c 0x8ea585380 0xaf6c0e744 0x875b73bab
        0xda34ca901 0x2ab9727ef 0xd39f21b9a 0x8a10b742f 0x5f8952dba 0xf8da71ab0 0xc25f9df96 0x06f8a5d94 0xe42e63e1a 0xb78409d1b
        0x792229add 0x5acf8c455 0x2fc29a9b0 0xea486237b 0xb0c9685a0 0x1ad748a47 0x03b4712d5 0xf29216d30 0x8dad65e49 0x0a2cf09dd
        0x0b5f174c6 0xe54f57743 0xb9cf54d78 0x4a312a88a 0x27babc962 0xb86897111 0xf2ff6c116 0x82274bd8a 0x97023505e 0x52d46edd1
        0x585c1f538 0xbddd00e43 0x5590b74df 0x729404a1f 0x65320855e 0xd3d4b6956 0x7ae374f14 0x2d7a60e06 0x315cd9b5e 0xfd36b4eac
        0xf1df7642b 0x55db27726 0x8f15ebc19 0x992f8c531 0x62dea2a40 0x928275cab 0x69c263cb9 0xa774cca9e 0x266b2110e 0x1b14acbb8
        0x624b8a71b 0x1c539406b 0x3086d529b 0x0111dd66e 0x98cd630bf 0x8b9d1ffdc 0x72b2f61e7 0x9ed9d672b 0x96cdd15f3 0x6366c2504
        0x6ca9df73a 0xa066d60f0 0xe7a4b8add 0x8264647ef 0xaa195bf81 0x9a3db8244 0x014d2df6a 0x0b63265b7 0x2f010de73 0x97e774986
        0x248affc29 0xfb57dcd11 0x0b1a7e4d9 0x4bfa2d07d 0x54e5cdf96 0x4c15c1c86 0xcd9c61166 0x499380b2a 0x540308d09 0x8b63fe66f
        0xc81aeb35e 0x86fe0bd5c 0xce2480c2a 0x1ab29ee60 0x8048daa15 0xdbfeb2d39 0x567c9858c 0x2b6edc5bc 0x2078fca82 0xadacc22aa
        0xb92486f49 0x51fac5964 0x691ee6420 0xf63b3e129 0x39be7e572 0xda2ce6c74 0x20cf17a5c 0xee55f9b6e 0xfb8572726 0xb2c2de548
        0xcaa9bce92 0xae9182db3 0x74b6e5bd1 0x137b252af 0x51f686881 0xd672f6c02 0x654146ce4 0xf944bc825 0xe8327f809 0x76a73fd59
        0xf79da4cb4 0x956f8099b 0x7b5f2655c 0xd06b114a6 0xd0697ca50 0x27c390797 0xbc61ed9b2 0xcc12dd19b 0xeb7818d2c 0x092fcecda
        0x89ded4ea1 0x256a0ba34 0xb6948e627 0x1ef6b1054 0x8639294a2 0xeda3780a4 0x39ee2af1d 0xcd257edc5 0x2d9d6bc22 0x121d3b47d
        0x37e23f8ad 0x119f31cf6 0x2c97f4f09 0xd502abfe0 0x10bc3ca77 0x53d7190ef 0x90c3e62a6 0x7e9ebf675 0x979ce23d1 0x27f0c98e9
        0xeafb4ae59 0x7ca7fe2bd 0x1490ca8f6 0x9123387ba 0xb3bc73888 0x3ea87e325 0x4888964aa 0xa0188a6b9 0xcd383c666 0x40029a3fd
        0xe1c00ac5c 0x39e6f2b6e 0xde664f622 0xe979a75e8 0x7c6b4c86c 0xfd492e071 0x8fbb35118 0x40b4a09b7 0xaf80bd6da 0x70e0b2521
        0x2f5c54d93 0x3f4a118d5 0x09c1897b9 0x079776eac 0x084b00b17 0x3a95ad90e 0x28c544095 0x39d457c05 0x7a3791a78 0xbb770e22e
        0x9a822bd6c 0x68a4b1fed 0xa5fd27b3b 0x0c3995b79 0xd1519dff1 0x8e7eee359 0xcd3ca50b1 0xb73b8b793 0x57aca1c43 0xec2655277
        0x785a2c1b3 0x75a07985a 0xa4b01eb69 0xa18a11347 0xdb1f28ca3 0x877ec3e25 0x31f6341b8 0x1363a3a4c 0x075d8b9ba 0x7ae0792a9
        0xa83a21651 0x7f08f9fb5 0x0d0cf73a9 0xb04dcc98e 0xf65c7b0f8 0x65ddaf69a 0x2cf9b86b3 0x14cb51e25 0xf48027b5b 0x0ec26ea8b
        0x44bafd45c 0xb12c7c0c4 0x959fd9d82 0xc77c9725a 0x48a22d462 0x8398e8072 0xec89b05ce 0xbb682d4c9 0xe5a86d2ff 0x358f01134
        0x8556ddcf6 0x67584b6e2 0x11609439f 0x08488816e 0xaaf1a2c46 0xf879898cf 0x8bbe5e2f7 0x101eee363 0x690f69377 0xf5bd93cd9
        0xcea4c2bf6 0x9550be706 0x2c5b38a60 0xe72033547 0x4458b0629 0xee8d9ed41 0xd2f918d72 0x78dc39fd3 0x8212636f6 0x7450a72a7
        0xc4f0cf4c6 0x367bcddcd 0xc1caf8cc6 0xa7f5b853d 0x9d536818b 0x535e021b0 0xa7eb8729e 0x422a67b49 0x929e928a6 0x48e8aefcc
        0xa9897393c 0x5eb81d37e 0x1e80287b7 0x34770d903 0x2eef86728 0x59266ccb6 0x0110bba61 0x1dfd284ef 0x447439d1b 0xfece0e599
        0x9309f3703 0x80764d1dd 0x353f1e6a0 0x2c1c12dcc 0xc1d21b9d7 0x457ee453e 0xd66faf540 0x44831e652 0xcfd49a848 0x9312d4133
        0x3f097d3ee 0x8c9ebef7a 0xa99e29e88 0x0e9fab22c 0x4e748f4fb 0xecdee4288 0xabce5f1d0 0xc42f6876c 0x7ed402ea0 0xe5c4242c3
        0xd5b2c31ae 0x286863be6 0x160444d94 0x5f0f5808e 0xae3d44b2a 0x9f5c5d109 0x8ad9316d7 0x3422ba064 0x2fed11d56 0xbea6e3e04
        0x04b029eec 0x6deed7435 0x3718ce17c 0x55857f5e2 0x2edac7b62 0x085d6c512 0xd6ca88e0f 0x2b7e1fc69 0xa699d5c1b 0xf05ad74de
        0x4cf5fb56d 0x5725e07e1 0x72f18a2de 0x1cec52609 0x48534243c 0x2523a4d69 0x35c1b80d1 0xa4d7338a7 0x0db1af012 0xe61a9475d
        0x05df03f91 0x97ae260bb 0x32d627fef 0xb640f73c2 0x45a1ac9c6 0x6a2202de1 0x57d3e25f2 0x5aa9f986e 0x0cc859d8a 0xe3ec6cca8
        0x54e95e1ae 0x446887b06 0x7516732be 0x3817ac8f5 0x3e26d938c 0xaa81bc235 0xdf387ca1b 0x0f3a3b3f2 0xb4bf69677 0xae21868ed
        0x81e1d2d9d 0xa0a9ea14c 0x8eee297a9 0x4740c0559 0xe8b141837 0xac69e0a3d 0x9ed83a1e1 0x5edb55ecb 0x07340fe81 0x50dfbc6bf
        0x4f583508a 0xcb1fb78bc 0x4025ced2f 0x39791ebec 0x53ee388f1 0x7d6c0bd23 0x93a995fbe 0x8a41728de 0x2fe70e053 0xab3db443a
        0x1364edb05 0x47b6eeed6 0x12e71af01 0x52ff83587 0x3a1575dd8 0x3feaa3564 0xeacf78ba7 0x0872b94f8 0xda8ddf9a2 0x9aa920d2b
        0x1f350ed36 0x18a5e861f 0x2c35b89c3 0x3347ac48a 0x7f23e022e 0x2459068fb 0xe83be4b73
    """,
}


@cache
def family(name: str, max_candidates: int | None = CANDIDATES) -> Family:
    """A built-in family by name. The search of the largest ones takes too long to end; what it finds in its first
    max_candidates candidates are the family's first ids (tagCircle21h7 is small and always whole)."""
    if name not in SPECS:
        raise FamilyError(f"{name!r} is no built-in family")
    kind, size, data, min_hamming, complexity = SPECS[name]
    layout = make_layout(kind, size, data)
    if name in CLASSIC:
        codes = np.array([upgrade(int(c, 16), layout) for c in CLASSIC[name].split()], np.uint64)
    else:
        codes = generate(layout, min_hamming, complexity, None if layout.nbits <= 21 else max_candidates)
    return Family(name, layout, min_hamming, complexity, codes)


def as_family(which: str | Family, max_candidates: int | None = CANDIDATES) -> Family:
    """A family by name, or which itself where it is one."""
    return which if isinstance(which, Family) else family(which, max_candidates)


def with_codes(name: str, raw: bytes) -> Family:
    """A built-in family with all its codes from a code file."""
    f = family(name)
    return Family(name, f.layout, f.min_hamming, f.min_complexity, parse_codes(raw))
