"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word windows (five words; a text with fewer words is one window). Equal texts form a class and
are compared once. Every class gets MinHash values; classes that share all values of a band meet. There, pairs compare
their values a stretch at a time: with m of n values equal, and no prior knowledge, the similarity's posterior is
Beta(1 + m, 1 + n - m), and a pair goes when its chance to reach the threshold falls below ``tolerance``. Of each value
one byte is compared; bytes of unequal values agree by chance once in 256, which keeps a pair rather than drops it. Pairs
that remain join classes to candidate groups, and within each group all pairs are verified exactly on their window sets.

No pair becomes a row: a bucket yields edges to one of its members, a group yields a count of links for each member. A
text is read, and a class's window set shuffled, once; only in groups whose sets are over ``BLOCK_BYTES`` does a set go
to as many tasks as the group has blocks of that size, and buckets are dealt likewise by ``BUCKET_ROWS``. So a task never
holds more than two blocks. Keys with many rows (buckets, hubs) are joined as ``graph.with_value`` says.

A pair at the threshold shares no band with a chance of (1 - t^ROWS)^BANDS, 3e-6 at 0.8, and is pruned wrongly with
about ``tolerance`` at each stretch. Windows are compared by 64-bit hashes.

Defined cases: a null text is a class of its own, with no links. Equal texts without a word are copies but have no
links. Repeated rows are copies like any others. Rows that share an id but not the text are one document: what is
linked to either is in its class. Null ids take part, but a class or copy whose ids are all null has a null number;
ids are whole numbers under 2^62. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, WORD_PATTERN, lean, materialize, scratch
from .graph import components, with_value

WIDTH, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
BANDS, ROWS = 32, 5
STRETCH = 32
#: Bytes of window sets in a block of a group, members in a block of a bucket, and sets that are compared at once.
BLOCK_BYTES, BUCKET_ROWS, AT_ONCE = 16 << 20, 16_384, 1024
#: Words whose hashes a task remembers.
MAX_WORDS = 200_000
#: Classes whose ids are all null get numbers from here on.
NAMELESS = 1 << 62
_WORD = re.compile(WORD_PATTERN)
_MASK = (1 << 64) - 1


def _odd(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), seed) | 1 for i in range(n)], np.uint64)


_STEP = _odd(64, 1)
_SCALE, _SHIFT = _odd(BANDS * ROWS, 2)[:, None], _odd(BANDS * ROWS, 3)[:, None]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def windows(text: str, width: int = WIDTH) -> np.ndarray:
    """The text's set of word windows as sorted 64-bit hashes."""
    words = _WORD.findall(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    total = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        total += h[i : i + n] * _STEP[i]
        total ^= total >> np.uint64(29)
    total *= _STEP[width]
    total ^= total >> np.uint64(32)
    return np.unique(total)


def signature(items: np.ndarray) -> np.ndarray:
    out = np.full(len(_SCALE), _MASK, np.uint64)
    for i in range(0, len(items), 4096):
        np.minimum(out, (items[None, i : i + 4096] * _SCALE + _SHIFT).min(1), out=out)
    return out


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of n equal values with which a pair stays: P(S >= t | m of n) is the chance of at most m successes
    in n + 1 trials of chance t."""
    upto = 0.0
    for m in range(n + 1):
        upto += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if upto >= tolerance:
            return m
    return n


def _survivors(sigs: np.ndarray, one: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of sigs stay against one, comparing a stretch at a time."""
    at, matches = np.arange(len(sigs)), np.zeros(len(sigs), np.int32)
    for i, need in enumerate(least):
        part = slice(i * STRETCH, (i + 1) * STRETCH)
        matches = matches + (sigs[at, part] == one[part]).sum(1, dtype=np.int32)
        keep = matches >= need
        at, matches = at[keep], matches[keep]
        if not len(at):
            break
    return at


def candidate_edges(reps: np.ndarray, sigs: np.ndarray, least: list[int]) -> tuple[list[int], list[int]]:
    """Edges that join the members of a bucket as their surviving pairs do: each to the least of its group."""
    left, u, v = np.arange(len(reps)), [], []
    while len(left) > 1:
        group, todo, left = [left[0]], [left[0]], left[1:]
        while todo and len(left):
            hit = _survivors(sigs[left], sigs[todo.pop()], least)
            new = left[hit].tolist()
            group += new
            todo += new
            left = np.delete(left, hit)
        if len(group) > 1:
            ids = reps[group]
            low = int(ids.min())
            u += [int(x) for x in ids if x != low]
            v += [low] * (len(u) - len(v))
    return u, v


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the consecutive rows with equal keys."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])
        if held and any(held[-1].column(k)[0] != t.column(k)[0] for k in keys):
            yield pa.concat_tables(held)
            held = []
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = t.slice(a, e - a)
            if held and a:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _blocks(df: DataFrame, blocks: Column, member: str) -> DataFrame:
    """df with block numbers b1 <= b2 and a row's own: rows of a key with several blocks go to every pair with theirs."""
    df = df.withColumn("__q_n", F.greatest(blocks, F.lit(1)).cast("int"))
    df = df.withColumn("own", F.pmod(F.xxhash64(member), F.col("__q_n")).cast("int"))
    df = df.withColumn("__q_o", F.explode(F.sequence(F.lit(0), F.col("__q_n") - 1)))
    return df.withColumns({"b1": F.least("own", "__q_o"), "b2": F.greatest("own", "__q_o")}).drop("__q_n", "__q_o")


def classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(key, rep, size, sig): per distinct text its digest, its least id, its rows, and its MinHash values."""
    source = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    source = source.select("id", F.unhex(F.md5(F.col("text"))).alias("key"), "text")

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = []
            for t in b.column("text").to_pylist():
                w = windows(t, width)
                sigs.append(signature(w).tobytes() if len(w) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(sigs, pa.binary())], ["id", "key", "sig"])

    signed = source.mapInArrow(lean(sign, _hashes.clear), "id long, key binary, sig binary")
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("key"), F.lit(NAMELESS >> 1))
    return signed.groupBy("key").agg(F.coalesce(F.min("id"), nameless).alias("rep"), F.count("*").alias("size"), F.any_value("sig").alias("sig"))


def _memberships(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class in the bucket of each of its bands."""
    for b in batches:
        sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(-1, BANDS, ROWS)
        h = np.tile(_odd(BANDS, 4), (len(sigs), 1))
        for i in range(ROWS):
            h = (h ^ sigs[:, :, i]) * _STEP[i]
            h ^= h >> np.uint64(31)
        reps = np.repeat(b.column("rep").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).ravel()), pa.array(reps)], ["bucket", "rep"])


def candidates(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (u, v) between classes that keep a chance to reach the threshold, as few as join the same groups."""
    least = [least_matches(n, threshold, tolerance) for n in range(STRETCH, BANDS * ROWS + 1, STRETCH)]
    low = "low binary"

    def narrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(-1, BANDS * ROWS)
            lows = (sigs >> np.uint64(17)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([x.tobytes() for x in lows], pa.binary())], ["rep", "low"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for t in _runs(batches, ["bucket", "b1", "b2"]):
            if t.num_rows > 1:
                sigs = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
                u, v = candidate_edges(t.column("rep").to_numpy(), sigs, least)
                us, vs = us + u, vs + v
                if len(us) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                    us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    signed = reps.where("sig IS NOT NULL").select("rep", "sig")
    with scratch() as put:
        member = put(signed.mapInArrow(_memberships, "bucket long, rep long"), "buckets")
        shared = put(member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        lows = signed.mapInArrow(narrow, f"rep long, {low}")
        dealt = with_value(member, shared, "bucket", "n", total).join(lows, "rep")
        dealt = _blocks(dealt, F.ceil(F.col("n") / BUCKET_ROWS), "rep").select("bucket", "b1", "b2", "rep", "low")
        dealt = dealt.repartition("bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2")
        return materialize(dealt.mapInArrow(lean(join), "u long, v long"), "candidates")


def exact_links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of a left and a right set reach the threshold."""
    n = [np.array([len(s) for s in sets], np.int64) for sets in (left, right)]
    col = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1]
    cols = np.split(col, [int(n[0].sum())])
    # Only windows of both sides count.
    width = int(col.max()) + 1 if len(col) else 0
    both_sides = np.bincount(cols[0], minlength=width).astype(bool) & np.bincount(cols[1], minlength=width).astype(bool)
    place = np.cumsum(both_sides) - 1
    sides = []
    for sizes, c in zip(n, cols, strict=True):
        keep = both_sides[c]
        who, at = np.repeat(np.arange(len(sizes)), sizes)[keep], place[c[keep]]
        order = np.argsort(at, kind="stable")
        sides.append((who[order], at[order]))
    both = np.zeros((len(left), len(right)), np.float32)
    step = max(1, 4_000_000 // max(len(left), len(right)))
    for a in range(0, int(both_sides.sum()), step):
        m = []
        for (who, at), sizes in zip(sides, n, strict=True):
            lo, hi = np.searchsorted(at, [a, a + step])
            one = np.zeros((len(sizes), step), np.float32)
            one[who[lo:hi], at[lo:hi] - a] = 1
            m.append(one)
        both += m[0] @ m[1].T
    both = both.astype(np.int64)
    return both >= threshold * (n[0][:, None] + n[1][None, :] - both) - 1e-9


def least_linked(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least place that links (u, v) join to each place, from the labels so far."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label = label[label]
    return label


def count_links(sets: list[np.ndarray], own: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set how many others reach the threshold, and the least place that links join to it; across: only pairs
    of different own count."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    parts = [order[i : i + AT_ONCE] for i in range(0, len(order), AT_ONCE)]
    links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for i, a in enumerate(parts):
        for b in parts[i:]:
            if sizes[a[-1]] < threshold * sizes[b[0]] - 1e-9:
                break  # sets of such sizes can't reach it
            ok = exact_links([sets[k] for k in a], [sets[k] for k in b], threshold)
            if across:
                ok &= own[a][:, None] != own[b][None, :]
            if a is b:
                np.fill_diagonal(ok, False)
            links[a] += ok.sum(1)
            if a is not b:
                links[b] += ok.sum(0)
            x, y = np.nonzero(ok)
            label = least_linked(label, a[x], b[y])
    return links, label


def verify(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """members: (comp, rep, items), a table. Gives (rep, links) with the exact links in each task, and the edges (u, v)
    that join what the links do, one for each class at most in a task."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["comp", "b1", "b2"]):
            t = t.sort_by("rep")
            reps = t.column("rep").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
            links, low = count_links(sets, t.column("own").to_numpy(), t.column("b1")[0] != t.column("b2")[0], threshold)
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(links), pa.array(reps[low])], ["rep", "links", "low"])

    with scratch() as put:
        sizes = put(members.groupBy("comp").agg(F.sum(F.octet_length("items") + 64).alias("bytes"), F.count("*").alias("n")), "sizes")
        blocks = with_value(members, sizes, "comp", "n", members.count())
        dealt = _blocks(blocks, F.ceil(F.col("bytes") / BLOCK_BYTES), "rep").select("comp", "b1", "b2", "own", "rep", "items")
        dealt = dealt.repartition("comp", "b1", "b2").sortWithinPartitions("comp", "b1", "b2")
        found = materialize(dealt.mapInArrow(lean(check), "rep long, links long, low long"), "links")
    return found.groupBy("rep").agg(F.sum("links").alias("links")), found.where("low <> rep").select(F.col("rep").alias("u"), F.col("low").alias("v"))


def sets_of(docs: DataFrame, members: DataFrame, text_col: str, width: int) -> DataFrame:
    """members (key, rep, comp), a table, as (comp, rep, items), with the window set of each one's text."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.unhex(F.md5(F.col(text_col).cast("string"))).alias("key"), F.col(text_col).cast("string").alias("text"))
    if members.count() <= MAX_BROADCAST_ROWS:  # other texts stay where they are
        texts = texts.join(F.broadcast(members.select("key")), "key", "left_semi")
    # Copies collapse in their tasks before the shuffle, so a hot text comes as a row of each task.
    texts = texts.groupBy("key").agg(F.any_value("text").alias("text")).join(members, "key")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [windows(t, width).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("comp"), b.column("rep"), pa.array(items, pa.binary())], ["comp", "rep", "items"])

    return texts.select("comp", "rep", "text").mapInArrow(lean(cut, _hashes.clear), "comp long, rep long, items binary")


def of_texts(docs: DataFrame, reps: DataFrame, text_col: str, width: int, threshold: float, tolerance: float) -> DataFrame:
    """reps: what classes() gives, as a table. A row for each of docs' texts: its digest ``r_key`` and, in the numbers of
    ``rep``, ``copy_id`` and ``class_id``; ``n_copies`` and ``n_links``."""
    with scratch() as put:
        groups = components(candidates(reps, threshold, tolerance))
        members = put(reps.select("key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep"), "members")
        links, edges = verify(put(sets_of(docs, members, text_col, width), "sets"), threshold)
        linked = components(edges)
        of_rep = reps.select("key", "rep", "size").join(linked.select(F.col("node").alias("rep"), F.col("comp")), "rep", "left").join(links, "rep", "left")
        of_rep = of_rep.select(F.col("key").alias("r_key"), F.col("rep").alias("copy_id"), F.col("size").alias("n_copies"), F.coalesce("comp", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
        # A table of its own, so that both sides of the join come straight from their shuffles and a hot text is split.
        return materialize(of_rep, "of-texts")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each of docs: its id, ``class_id`` (the least id of the documents that chains of links join to it),
    ``copy_id`` (the least id with an equal text), ``n_copies`` (rows with an equal text) and ``n_links`` (distinct
    other texts with a similarity of at least threshold)."""
    with scratch() as put:
        of_rep = of_texts(docs, put(classes(docs, id_col, text_col, width), "classes"), text_col, width, threshold, tolerance)
    own = docs.select(F.col(id_col), F.unhex(F.md5(F.col(text_col).cast("string"))).alias("__q_key"))
    out = own.join(of_rep, F.col("__q_key") == F.col("r_key"), "left")
    mine = F.col(id_col).cast("long")
    named = lambda c: F.when(F.coalesce(F.col(c), mine) < NAMELESS, F.coalesce(F.col(c), mine)).alias(c)
    return out.select(F.col(id_col), named("class_id"), named("copy_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def ranked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, least, most, rank): per distinct text its digest, its least id, the rows of its most repeated id, and its
    place in the order of least ids (null: last) and digests, with gaps."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.col(text_col).cast("string"))).alias("key"))
    texts = own.groupBy("key", "id").agg(F.count("*").alias("n")).groupBy("key").agg(F.min("id").alias("least"), F.max("n").alias("most"))
    return texts.orderBy(F.col("least").asc_nulls_last(), "key").select("*", F.monotonically_increasing_id().alias("rank"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of docs for each class of texts that chains of links join: a row with the least id (null: last; then the
    least digest). Unlike in join(), texts that share an id are apart unless they are linked. Rows without a text stay."""
    with scratch() as put:
        ranks = put(ranked(docs, id_col, text_col), "ranks")
        reps = classes(docs, id_col, text_col, width).drop("rep").join(ranks.select("key", F.col("rank").alias("rep")), "key")
        found = of_texts(docs, put(reps, "classes"), text_col, width, threshold, tolerance)
        wins = (F.col("class_id") == F.col("copy_id")).alias("__q_wins")
        found = found.where("class_id <> copy_id OR n_copies > 1").join(ranks.select("key", "least", "most"), F.col("r_key") == F.col("key"))
        found = materialize(found.select(F.col("key").alias("__q_key"), F.col("least").alias("__q_least"), F.col("most").alias("__q_most"), wins), "fates")
    few = lambda df: F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df
    key = F.unhex(F.md5(docs[text_col].cast("string")))
    stays = F.col("__q_wins") & docs[id_col].cast("long").eqNullSafe(F.col("__q_least"))
    out = docs.join(few(found), (key == F.col("__q_key")) & ~stays, "left_anti")
    repeated = found.where("__q_wins AND __q_most > 1").select("__q_key")
    if not repeated.limit(1).count():
        return out
    repeated, key = few(repeated), F.unhex(F.md5(out[text_col].cast("string")))
    first = out.join(repeated, key == F.col("__q_key"), "left_semi").withColumn("__q_key", key).dropDuplicates(["__q_key"]).drop("__q_key")
    return out.join(repeated, key == F.col("__q_key"), "left_anti").union(first)


ORACLE_SQL = rf"""
WITH RECURSIVE t AS (SELECT min(doc_id) AS rep, text, count(*) AS size FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT rep, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
s AS (SELECT DISTINCT rep, array_to_string(ws[i:i + {WIDTH - 1}], ' ') AS g FROM (SELECT rep, ws, unnest(range(1, greatest(len(ws) - {WIDTH - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
b AS (SELECT x.rep AS u, y.rep AS v, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rep <> y.rep GROUP BY ALL),
l AS (SELECT u, v FROM b JOIN n p ON p.rep = u JOIN n q ON q.rep = v WHERE c >= {THRESHOLD} * (p.n + q.n - c) - 1e-9),
r AS (SELECT rep, rep AS low FROM t UNION SELECT r.rep, l.v FROM r JOIN l ON r.low = l.u),
c AS (SELECT rep, min(low) AS class_id FROM r GROUP BY rep),
k AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(t.rep, d.doc_id) AS copy_id, coalesce(t.size, 1)::BIGINT AS n_copies, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN c ON c.rep = t.rep LEFT JOIN k ON k.u = t.rep
"""
