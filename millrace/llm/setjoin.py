"""Exact set-similarity join by set-relation skipping.

A set of size s is cut into M segments (fixed parts of the token universe, parts balanced by token frequency). Sets with
Jaccard similarity >= t differ in at most H = floor((|x|+|y|)(1-t)/(1+t)) tokens, so at most H segments differ: each set
becomes a set of M segment elements and the pair shares M-H of them. On these the prefix principle holds: ordered by
rarity, the first H+1 elements of both share one. Only those are indexed.

Index-level skipping: an index list holds, for one element, the sets having it, kept in blocks by position (rank of the
element in the set) and size. A pair that meets at positions i and j can share at most M-max(i,j) elements, so blocks
with max(i,j) > H, or with sizes out of proportion, are skipped whole; what is left is thinned by 64 parity bits a set
(sketches that differ in more than H bits exclude the pair). Nothing that qualifies is lost: all tests are bounds.

Answer-level skipping: candidate pairs are gathered by leader, the smallest set that is similar to the left one. The
leader's overlaps are computed once; those of a set highly similar to it follow from the few tokens in which the two
differ. Every reported pair is checked exactly.

Scale: index lists travel as packed column blocks, one shuffle of about 20 * 29 bytes a set. Cells have a fixed size, so
their number follows the number of sets, and each cell is one partition. Elements that very many sets have are told
beforehand and salted: their entries go to partitions by set instead of by element, are cut into chunks as they stream
by, and chunks meet pair by pair all over the cluster; so do lists that turn out to be long. Which elements are salted is
estimated from one set in SAMPLE and decides where entries meet, never whether. Collected are a table of 65,536
token-bucket counts and the salted elements, at most 24 * HOT_SHARE or one in some 40,000 sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokensets import mix, parity_sketch, rows_of, trigram_sets
from millrace.session import cut, shuffle_width

BUCKETS = 1 << 16
#: Entries of a sub-block; longer lists are worked off by sub-blocks, shorter ones entry by entry.
TILE = 512
SLACK = 2
#: A list longer than this is split over tasks, in chunks of CHUNK.
HOT_LIST, CHUNK = 24_576, 4_096
#: Elements of one set in HOT_SHARE, or of MOST sets, are salted; told from one set in SAMPLE.
HOT_SHARE, MOST, SAMPLE = 200, 1 << 20, 16
#: Bytes of the chunks that a task holds open.
OPEN_BYTES = 48 << 20
CELL_BYTES = 4 << 20
_COLUMNS = (("sig", "<u8"), ("uid", "<i8"), ("par", "<u8"), ("size", "<u4"), ("pos", "u1"))
_ROW_BYTES = 29
MET = "a long, b long, sig long, small int, large int, early int, blob binary"
_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sig", pa.int64()), ("small", pa.int32()), ("large", pa.int32()), ("early", pa.int32()), ("blob", pa.binary())])


def max_difference(total: np.ndarray | int, t: Fraction):
    """Most tokens in which two sets of this total size may differ at similarity t."""
    c = (1 - t) / (1 + t)
    return total * c.numerator // c.denominator


def band_of(size: np.ndarray) -> np.ndarray:
    """Bands [3*2^k, 6*2^k); sizes under 6 are band 0."""
    return np.maximum(0, np.floor(np.log2(np.maximum(size, 1) / 3.0) + 1e-12)).astype(np.int64)


def _band_end(band: np.ndarray | int):
    return 6 * 2**band


def _segments_in(band: int, t: Fraction) -> int:
    return int(max_difference(2 * (_band_end(band) - 1), t)) + 1 + SLACK


def bucket_counts(norms: DataFrame, text: str = "norm") -> np.ndarray:
    """How many sets have a token of each of the 65,536 token buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            tokens, _ = trigram_sets(b.column(0).to_pylist())
            total += np.bincount((mix(tokens) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = norms.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in found.collect():  # at most 65,536 rows
        out[bucket] = n
    return out


def _elements(texts: list[str], uids: np.ndarray, weight: np.ndarray, rank: np.ndarray, t: Fraction) -> dict[str, np.ndarray]:
    """The indexed segment elements of each text: sig, uid, par, size, pos."""
    tokens, offsets = trigram_sets(texts)
    sizes, row, hashes = np.diff(offsets), rows_of(offsets), mix(tokens)
    par = parity_sketch(hashes, row, len(texts))
    bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    content, w, r = mix(hashes ^ np.uint64(0x5BD1E995)), weight[bucket], rank[bucket]
    largest = sizes * t.denominator // t.numerator
    own = band_of(sizes)
    out: list[dict[str, np.ndarray]] = []
    for band in np.unique(np.r_[own, own + 1]):
        last, m = int(_band_end(band)) - 1, _segments_in(int(band), t)
        take = (sizes > 0) & ((own == band) | ((own + 1 == band) & (largest > int(_band_end(max(int(band) - 1, 0))) - 1)))
        if not take.any():
            continue
        differ = max_difference(sizes + np.minimum(largest, last), t)
        new = np.cumsum(take) - 1
        keep = take[row]
        # parts balanced by frequency: buckets of neighbouring rank go to different parts
        block, place = r[keep] // m, r[keep] % m
        part = (place + (block * 7919 + block // 3)) % m
        key = new[row[keep]] * m + part
        n = int(take.sum())
        seg = np.zeros(n * m, np.uint64)
        np.add.at(seg, key, content[keep])
        score = np.bincount(key, weights=w[keep], minlength=n * m).reshape(n, m)
        where = np.tile(np.arange(m, dtype=np.uint64), n) + np.uint64(1000 * (int(band) + 1))
        seg = mix(seg + mix(where)).reshape(n, m)
        order = np.argsort(-score, axis=1, kind="stable")
        length = np.minimum(m, differ[take] + 1)
        inside = np.arange(m)[None, :] < length[:, None]
        who = np.repeat(np.flatnonzero(take), length)
        pos = np.broadcast_to(np.arange(m), (n, m))[inside]
        out.append({"sig": np.take_along_axis(seg, order, 1)[inside], "uid": uids[who], "par": par[who], "size": sizes[who], "pos": np.minimum(pos, 255)})
    if not out:
        return {k: np.zeros(0, d) for k, d in _COLUMNS}
    return {k: np.concatenate([o[k] for o in out]).astype(d) for k, d in _COLUMNS}


def pack(cols: dict[str, np.ndarray], take: np.ndarray | slice = slice(None)) -> bytes:
    return b"".join(np.ascontiguousarray(cols[k][take], d).tobytes() for k, d in _COLUMNS)


def unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    got: dict[str, list[np.ndarray]] = {k: [] for k, _ in _COLUMNS}
    for blob in blobs:
        n, at = len(blob) // _ROW_BYTES, 0
        for k, d in _COLUMNS:
            width = np.dtype(d).itemsize * n
            got[k].append(np.frombuffer(blob, d, n, at))
            at += width
    return {k: np.concatenate(v) for k, v in got.items()}


def near(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, t: Fraction) -> np.ndarray:
    """Which of the index pairs (i, j) pass the bounds."""
    h = max_difference(c["size"][i].astype(np.int64) + c["size"][j], t)
    return (
        (np.bitwise_count(c["par"][i] ^ c["par"][j]) <= h)
        & (np.maximum(c["pos"][i], c["pos"][j]) <= h)
        & (np.abs(c["size"][i].astype(np.int64) - c["size"][j]) <= h)
        & (c["uid"][i] != c["uid"][j])
    )


def _tiles(a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: bool, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of two blocks that are sorted by size then position, skipping sub-blocks that can't qualify."""
    step = TILE
    for x in range(0, len(a["uid"]), step):
        for y in range(x if same else 0, len(b["uid"]), step):
            xs, ys = slice(x, x + step), slice(y, y + step)
            big, small = (int(a["size"][xs].max()), int(b["size"][ys].min())), (int(a["size"][xs].min()), int(b["size"][ys].max()))
            h = int(max_difference(int(a["size"][xs].max()) + int(b["size"][ys].max()), t))
            if big[1] - big[0] > h or small[0] - small[1] > h or max(int(a["pos"][xs].min()), int(b["pos"][ys].min())) > h:
                continue
            both = {k: np.concatenate([a[k][xs], b[k][ys]]) for k, _ in _COLUMNS}
            n, m = len(a["uid"][xs]), len(b["uid"][ys])
            i, j = np.repeat(np.arange(n), m), np.tile(np.arange(m), n) + n
            if same and x == y:
                upper = j - n > i
                i, j = i[upper], j[upper]
            ok = near(both, i, j, t)
            yield both["uid"][i[ok]], both["uid"][j[ok]]


def ordered_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    first = np.ones(len(lo), bool)
    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return lo[first], hi[first]


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[pa.nulls(len(a), f.type) for f in list(_MET)[2:]]], schema=_MET)


def chunk_batch(blocks: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    """Chunks of long lists, with the bounds by which pairs of chunks are skipped whole."""
    k = len(blocks)
    sig = np.array([c["sig"][0] for c in blocks], np.uint64).view(np.int64)
    bounds = [[int(f(c[name])) for c in blocks] for name, f in (("size", np.min), ("size", np.max), ("pos", np.min))]
    return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(sig), *[pa.array(x, pa.int32()) for x in bounds], pa.array([pack(c) for c in blocks], pa.binary())], schema=_MET)


def list_pairs(c: dict[str, np.ndarray], t: Fraction, hot: int = HOT_LIST) -> Iterator[pa.RecordBatch]:
    """Pairs that pass the bounds, from all index lists of one cell; chunks instead for lists longer than *hot*."""
    order = np.lexsort((c["pos"], c["size"], c["sig"]))
    c = {k: v[order] for k, v in c.items()}
    sig = c["sig"]
    if not len(sig):
        return
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    length = np.diff(np.r_[start, len(sig)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s, n in zip(start[length > TILE], length[length > TILE]):
        if n <= hot:
            block = {k: v[s : s + n] for k, v in c.items()}
            found += _tiles(block, block, True, t)
        else:
            yield chunk_batch([{k: v[x : min(x + CHUNK, s + n)] for k, v in c.items()} for x in range(s, s + n, CHUNK)])
    short = np.repeat(length <= TILE, length)
    left = np.repeat(start + length, length) - 1 - np.arange(len(sig))  # members of the list after this one
    alive = np.flatnonzero(short & (left > 0))
    d = 1
    while len(alive):
        going = []
        for at in range(0, len(alive), 1 << 20):
            i = alive[at : at + (1 << 20)]
            # the list is sorted by size and position: once the sizes exclude a pair, they exclude all after it
            size, other = c["size"][i].astype(np.int64), c["size"][i + d].astype(np.int64)
            inside = other - size <= max_difference(size + other, t)
            i = i[inside]
            ok = near(c, i, i + d, t)
            found.append((c["uid"][i[ok]], c["uid"][i[ok] + d]))
            going.append(i)
        d += 1
        alive = np.concatenate(going)
        alive = alive[left[alive] >= d]
    if found:
        yield pair_batch(*ordered_pairs(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])))


def salted_chunks(blobs: Iterator[bytes], most: int = OPEN_BYTES) -> Iterator[pa.RecordBatch]:
    """Chunks of the lists of salted elements, as their entries stream by."""
    held: dict[int, list[dict[str, np.ndarray]]] = {}
    count: dict[int, int] = {}

    def close(sig: int) -> dict[str, np.ndarray]:
        parts = held.pop(sig)
        count.pop(sig)
        whole = {k: np.concatenate([p[k] for p in parts]) for k, _ in _COLUMNS}
        order = np.lexsort((whole["pos"], whole["size"]))
        return {k: v[order] for k, v in whole.items()}

    for blob in blobs:
        c = unpack([blob])
        for sig in np.unique(c["sig"]):
            mine = c["sig"] == sig
            held.setdefault(int(sig), []).append({k: v[mine] for k, v in c.items()})
            count[int(sig)] = count.get(int(sig), 0) + int(mine.sum())
            if count[int(sig)] >= CHUNK:
                yield chunk_batch([close(int(sig))])
        if sum(count.values()) * _ROW_BYTES > most:
            yield chunk_batch([close(s) for s in list(held)])
    if held:
        yield chunk_batch([close(s) for s in list(held)])


def spread(met: DataFrame, t: Fraction) -> DataFrame:
    """(a, b), each once, from a table of pairs and chunks; pairs of chunks are worked off all over the cluster."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1)):
                x, y = x.as_py(), y.as_py()
                got = list(_tiles(unpack([x]), unpack([y]), x == y, t))
                a = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
                o = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
                lo, hi = ordered_pairs(a, o)
                yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["a", "b"])

    met = cut(met, "lists")
    pairs, chunks = met.where("blob is null").select("a", "b"), met.where("blob is not null").withColumn("id", F.xxhash64("sig", "blob"))
    if not chunks.isEmpty():
        meta = chunks.select("sig", "id", "small", "large", "early")
        x, y = meta.alias("x"), meta.alias("y")
        c = (1 - t) / (1 + t)
        h = F.floor((F.col("x.large") + F.col("y.large")) * c.numerator / c.denominator + 1e-9)
        apart = (F.col("x.small") - F.col("y.large") > h) | (F.col("y.small") - F.col("x.large") > h) | (F.greatest("x.early", "y.early") > h)
        both = x.join(y, F.col("x.sig") == F.col("y.sig")).where((F.col("x.id") <= F.col("y.id")) & ~apart).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"))
        left = both.join(chunks.select(F.col("id").alias("i"), F.col("blob").alias("left")), "i")
        tile = left.join(chunks.select(F.col("id").alias("j"), F.col("blob").alias("right")), "j").select("left", "right")
        pairs = pairs.union(tile.repartition(shuffle_width(met.sparkSession) * 4).mapInArrow(tiles, "a long, b long"))
    found = pairs.distinct()
    found._millrace_from = [met]
    return found


def salted_elements(norms: DataFrame, elements: Callable[[pa.RecordBatch], dict[str, np.ndarray]], n: int) -> np.ndarray:
    """Elements whose lists are longer than HOT_LIST and than n / HOT_SHARE or MOST, ascending, by estimate."""
    least = max(HOT_LIST, min(n // HOT_SHARE, MOST))
    if n < least:
        return np.zeros(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sigs, counts = 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for b in batches:
            sig, k = np.unique(elements(b)["sig"], return_counts=True)
            rows += len(b)
            sigs.append(sig[k > 1])
            counts.append(k[k > 1])
        sig, back = np.unique(np.concatenate(sigs), return_inverse=True)
        k = np.bincount(back, weights=np.concatenate(counts), minlength=len(sig)).astype(np.int64)
        keep = k * 4 * n >= rows * least  # what is frequent in all has its share in most tasks
        yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(k[keep])], names=["sig", "n"])

    few = norms.where(F.pmod("uid", F.lit(SAMPLE)) == 0).select("uid", "norm")
    found = few.mapInArrow(count, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") * SAMPLE >= least)
    return np.sort(np.array([r.sig for r in found.select("sig").collect()], np.int64).view(np.uint64))


def candidates(norms: DataFrame, t: Fraction, n: int) -> DataFrame:
    """(a, b) with a < b: pairs of sets that pass all bounds; every pair of similarity >= t is among them.

    norms: (uid LONG, norm STRING), one row a set, none empty.
    """
    counts = bucket_counts(norms)
    weight = np.round(-np.log((counts + 1) / (counts.sum() / 64 + 2)) * 256)
    weight -= weight.min() - 1
    rank = np.empty(BUCKETS, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(BUCKETS)
    width = shuffle_width(norms.sparkSession)
    cells = max(width, ceil(n * 24 * _ROW_BYTES / CELL_BYTES))

    def elements(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        return _elements(b.column(1).to_pylist(), b.column(0).to_numpy(), weight, rank, t)

    salted = salted_elements(norms, elements, n)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = elements(b)
            cell = ((cols["sig"] >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)
            if len(salted):
                cell = np.where(np.isin(cols["sig"], salted), cells + (mix(cols["uid"].view(np.uint64)) % np.uint64(width)).astype(np.int64), cell)
            order = np.argsort(cell, kind="stable")
            ends = np.searchsorted(cell[order], np.arange(cells + width + 1))
            used = np.flatnonzero(np.diff(ends))
            blobs = [pack(cols, order[ends[k] : ends[k + 1]]) for k in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["cell", "blob"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[bytes] = []

        def stream() -> Iterator[bytes]:
            for b in batches:
                for cell, blob in zip(b.column(0).to_pylist(), b.column(1)):
                    if cell >= cells:
                        yield blob.as_py()
                    else:
                        mine.append(blob.as_py())

        yield from salted_chunks(stream())
        if mine:
            yield from list_pairs(unpack(mine), t)

    indexed = norms.select("uid", "norm").mapInArrow(index, "cell int, blob binary")
    return spread(indexed.repartitionById(cells + (width if len(salted) else 0), "cell").mapInArrow(lists, MET), t)


def _overlaps(keys: np.ndarray, bits: int, codes: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """|x ∩ y| of row pairs, by looking each token of x up in y."""
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 50_000):
        xs, ys = x[at : at + 50_000], y[at : at + 50_000]
        n = offsets[xs + 1] - offsets[xs]
        pair = np.repeat(np.arange(len(xs)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[xs], n)
        out[at : at + len(xs)] = np.bincount(pair, weights=_has(keys, bits, ys[pair], codes[place]), minlength=len(xs))
    return out


def _has(keys: np.ndarray, bits: int, row: np.ndarray, code: np.ndarray) -> np.ndarray:
    want = row.astype(np.int64) << bits | code
    at = np.searchsorted(keys, want)
    at[at == len(keys)] = 0
    return keys[at] == want


def _differences(keys, bits, codes, offsets, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of x \\ y for row pairs."""
    n = offsets[x + 1] - offsets[x]
    pair = np.repeat(np.arange(len(x)), n)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[x], n)
    only = ~_has(keys, bits, y[pair], codes[place])
    return codes[place[only]], np.r_[0, np.cumsum(np.bincount(pair[only], minlength=len(x)))]


def answers(uids: np.ndarray, texts: list[str], leader: np.ndarray, a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Which pairs (a, b) have similarity >= t, deriving a's overlaps from those of its leader."""
    order = np.argsort(uids, kind="stable")
    uids, texts = uids[order], [texts[i] for i in order]
    tokens, offsets = trigram_sets(texts)
    universe, codes = np.unique(tokens, return_inverse=True)
    codes, bits = codes.astype(np.int64), max(1, len(universe).bit_length())  # row and code share 63 bits
    keys = rows_of(offsets) << bits | codes
    sizes = np.diff(offsets)
    la, lb, ll = (np.searchsorted(uids, v) for v in (a, b, leader))

    def once(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, back = np.unique(x.astype(np.int64) << 32 | y, return_inverse=True)
        return both >> 32, both & 0xFFFFFFFF, back

    px, py, back = once(ll, lb)  # the leader's own answers, each once
    overlap = _overlaps(keys, bits, codes, offsets, px, py)[back]
    dx, dy, which = once(ll, la)
    for x, y, sign in ((dx, dy, -1), (dy, dx, 1)):  # leader \ a is taken off, a \ leader is added
        diff, off = _differences(keys, bits, codes, offsets, x, y)
        n = off[which + 1] - off[which]
        pair = np.repeat(np.arange(len(a)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[which], n)
        overlap = overlap + sign * np.bincount(pair, weights=_has(keys, bits, lb[pair], diff[place]), minlength=len(a)).astype(np.int64)
    union = sizes[la] + sizes[lb] - overlap
    return overlap * t.denominator >= union * t.numerator


def verified(pairs: DataFrame, norms: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose texts have similarity >= t, exactly."""
    pairs = cut(pairs, "pairs", drop=getattr(pairs, "_millrace_from", ()))
    n = pairs.count()
    cells = max(1, min(shuffle_width(pairs.sparkSession) if n > 5_000 else 1, ceil(n / 5_000)), ceil(n / 100_000))
    lead = pairs.groupBy(F.col("b").alias("uid")).agg(F.min("a").alias("l"))
    routed = pairs.join(lead, pairs["a"] == lead["uid"], "left").select(F.coalesce("l", "a").alias("l"), "a", "b")
    # a range split keeps a leader's pairs together, yet divides a leader with very many
    routed = cut(routed.repartitionByRange(cells, "l", "a", "b").withColumn("cell", F.spark_partition_id()), "routed", drop=[pairs])
    asked = routed.select("cell", F.explode(F.array("l", "a", "b")).alias("uid")).distinct()
    members = asked.join(norms, "uid").select("cell", F.col("uid").alias("l"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "norm")
    rows = members.unionByName(routed.select("cell", "l", "a", "b", F.lit(None).cast("string").alias("norm")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        text = table.column("norm")
        sets, links = table.filter(text.is_valid()), table.filter(text.is_null())
        a, b, leader = (links.column(k).to_numpy() for k in ("a", "b", "l"))
        ok = answers(sets.column("l").to_numpy(), sets.column("norm").to_pylist(), leader, a, b, t) if len(a) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok], pa.int64()), pa.array(b[ok], pa.int64())], names=["a", "b"])

    return rows.repartitionById(cells, "cell").mapInArrow(check, "a long, b long")


def similar_sets(norms: DataFrame, t: Fraction) -> DataFrame:
    """(a, b), a < b: uids of all pairs of texts with trigram similarity >= t.

    norms: (uid LONG, norm STRING), one row a distinct text; null and empty texts take no part. An empty table gives
    an empty result.
    """
    norms = norms.where("norm is not null and norm <> ''").select("uid", "norm")
    n = norms.count()
    return verified(candidates(norms, t, n), norms, t)
