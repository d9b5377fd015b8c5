"""Deduplicating new batches against all history (problem 4).

A prefix-tree hash forest: every text has TREES signatures of LEVELS eight-bit min-hash values, one for each tree. The
signatures of a run of texts are kept as sorted blocks under one folder a cell, the cell being a hash of the tree and of
the prefix, so that whatever a lookup may find lies in its own cell. A batch is signed, persisted as a further run and
looked up: only the folders of its own cells are read, blocks whose ranges don't overlap are passed over, and within a block
a prefix is a range that binary search finds. The prefix is widened level by level until texts of the threshold similarity
meet with at least the target probability in some tree; what lies in the range is thinned by exact bounds (size and 64
parity bits) and verified exactly. Every MERGE_EVERY runs the new ones are merged into one. History is neither signed nor
sorted again.

With 16 trees and a target of 0.9999 the prefix is widened to 6 levels: a pair at the threshold itself is missed with
probability 5e-5, a closer one far less. Equal headlines and equal pages are found by equality, in tables that are kept
in shards by hash beside the forest.

The query takes batches in their order and puts neighbouring small ones together to rounds of ROUND_ROWS rows, MOST_ROUNDS
at most. Each round becomes a run; the young runs are looked up together before they are merged, so that the older runs are
read once for MERGE_EVERY rounds. What the rounds meet is verified, and joined with the records, once for all of them.

Scale: a signature takes about 30 bytes on disk once. A lookup joins the batch's blocks with those of its cells. The batch,
by its size on disk, is sent to the index in slices of whole cells, so that the runs aren't shuffled, however large they and
the batch are; only a cell in which the batch alone exceeds a slice is shuffled. A unit of work is a pair of blocks of at most
BLOCK signatures, so a cell that very many texts share is many small units, which AQE splits; no task holds a cell. There are
as many cells and shards as the size asks for, and the folders of a lookup are listed once.

Defined results: a null title has an empty headline, which is similar to none; a null link falls back to the canonical
URL, a record without both has no page; rows without batch are left out; a record is no pair with itself; repeated rows
count once; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import normalized_headline
from millrace.functions.url import canonical_url
from millrace.llm.formatting_duplicates import page
from millrace.llm.setjoin import near, ordered_pairs, verified
from millrace.llm.tokensets import mix, parity_sketch, rows_of, trigram_sets
from millrace.operators.ranges import running_total
from millrace.session import cut, path_bytes, remove, scratch_path, shuffle_width

THRESHOLD = Fraction(88, 100)
TREES, LEVELS, RECALL = 16, 8, 0.9999
#: Signatures in a block, and those that are sorted together when runs are merged.
BLOCK, SORTED = 1 << 14, 1 << 19
CELL_BYTES = 4 << 20
#: Records in a shard, as long as there are fewer shards than the shuffle is wide.
SHARD_ROWS = 20_000
ROUND_ROWS, MOST_ROUNDS, MERGE_EVERY = 20_000, 16, 4
#: Most bytes of a batch's blocks that are sent to all executors at once; measured before each lookup.
SENT_BYTES = 32 << 20
#: Texts whose signatures a task holds before it hands them on.
HELD = 1 << 15
_COLUMNS = (("tree", "u1"), ("sig", "<u8"), ("uid", "<i8"), ("par", "<u8"), ("size", "<u4"))
_ROW_BYTES = 29
_BLOCKS = "cell int, lo long, hi long, blob binary"


def widened_depth(t: float, recall: float = RECALL, trees: int = TREES, levels: int = LEVELS) -> int:
    """Levels of the prefix, widened from the whole signature until the recall at similarity t is reached."""
    depth = levels
    while depth > 1 and 1 - (1 - t**depth) ** trees < recall:
        depth -= 1
    return depth


def signatures(texts: list[str], trees: int = TREES, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature of each text and tree, parity sketches, sizes); texts must not be empty."""
    tokens, offsets = trigram_sets(texts)
    hashes, sizes = mix(tokens), np.diff(offsets)
    out = np.zeros((len(texts), trees), np.uint64)
    for i in range(trees * levels):
        salt = mix(np.array([i + 1], np.uint64))[0]
        low = np.minimum.reduceat((hashes ^ salt) * (salt | np.uint64(1)), offsets[:-1])
        out[:, i // levels] = out[:, i // levels] << np.uint64(8) | (mix(low) & np.uint64(255))
    return out, parity_sketch(hashes, rows_of(offsets), len(texts)), sizes


def _pack(c: dict[str, np.ndarray], take) -> bytes:
    return b"".join(np.ascontiguousarray(c[k][take], d).tobytes() for k, d in _COLUMNS)


def _unpack(blobs: list[bytes | pa.Buffer]) -> dict[str, np.ndarray]:
    got: dict[str, list[np.ndarray]] = {k: [np.zeros(0, d)] for k, d in _COLUMNS}
    for blob in blobs:
        n, at = memoryview(blob).nbytes // _ROW_BYTES, 0
        for k, d in _COLUMNS:
            got[k].append(np.frombuffer(blob, d, n, at))
            at += np.dtype(d).itemsize * n
    return {k: np.concatenate(v) for k, v in got.items()}


def _place(tree: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Tree and six levels of a signature in one ascending number."""
    return (tree.astype(np.int64) << 48) | (sig >> np.uint64(16)).astype(np.int64)


def _blocks(cell: int, c: dict[str, np.ndarray], most: int) -> list[tuple[int, int, int, bytes]]:
    """(cell, lo, hi, blob): the entries sorted, each once, in blocks of *most*."""
    order = np.lexsort((c["uid"], c["sig"], c["tree"]))
    c = {k: v[order] for k, v in c.items()}
    first = np.ones(len(order), bool)
    first[1:] = (c["uid"][1:] != c["uid"][:-1]) | (c["sig"][1:] != c["sig"][:-1]) | (c["tree"][1:] != c["tree"][:-1])
    c = {k: v[first] for k, v in c.items()}
    at = _place(c["tree"], c["sig"])
    cuts = [slice(x, min(x + most, len(at))) for x in range(0, len(at), most)]
    return [(cell, int(at[s][0]), int(at[s][-1]), _pack(c, s)) for s in cuts]


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cell", "lo", "hi", "blob"])


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of blocks that stream by in the order of their cells; at most SORTED entries are held."""
    now, held, size = None, [], 0
    for b in batches:
        for cell, blob in zip(b.column(0).to_pylist(), b.column(3)):
            if held and (cell != now or size >= SORTED):
                yield _rows(_blocks(now, _unpack(held), BLOCK))
                held, size = [], 0
            now = cell
            held.append(blob.as_py())
            size += len(held[-1]) // _ROW_BYTES
    if held:
        yield _rows(_blocks(now, _unpack(held), BLOCK))


def found_in_blocks(q: dict[str, np.ndarray], e: dict[str, np.ndarray], depth: int, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a signature of one sorted block and one of another that share a prefix and pass the bounds."""
    shift = np.uint64(8 * (LEVELS - depth))
    # tree and prefix in one ascending number (a prefix of all levels has no room for the tree)
    if depth < LEVELS:
        key = lambda c: c["tree"].astype(np.uint64) << np.uint64(8 * depth) | c["sig"] >> shift
        spans = [(slice(None), slice(None), key(q), key(e))]
    else:
        cuts = lambda c, tree: slice(*np.searchsorted(c["tree"], (tree, tree + 1)))
        spans = [(qs := cuts(q, tree), es := cuts(e, tree), q["sig"][qs], e["sig"][es]) for tree in np.intersect1d(q["tree"], e["tree"])]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for qs, es, asked, there in spans:
        mine, other = ({k: c[k][at] for k in ("uid", "par", "size")} for c, at in ((q, qs), (e, es)))
        # the range of a prefix among the sorted signatures
        low, high = np.searchsorted(there, asked, "left"), np.searchsorted(there, asked, "right")
        ends = np.cumsum(high - low)
        total = int(ends[-1]) if len(ends) else 0
        for at in range(0, total, 1 << 22):
            flat = np.arange(at, min(at + (1 << 22), total))
            i = np.searchsorted(ends, flat, "right")
            j = low[i] + flat - (ends[i] - (high - low)[i])
            both = {k: np.concatenate([mine[k][i], other[k][j]]) for k in mine} | {"pos": np.zeros(2 * len(i), np.uint8)}
            ok = near(both, np.arange(len(i)), np.arange(len(i)) + len(i), t)
            a.append(mine["uid"][i[ok]])
            b.append(other["uid"][j[ok]])
    return ordered_pairs(np.concatenate(a), np.concatenate(b))


def _stored(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The table in the folders under *path*. They are listed in a few tasks; by default each folder is a task of its own."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key)
    spark.conf.set(key, str(shuffle_width(spark)))
    try:
        return spark.read.schema(schema).parquet(path)
    finally:
        spark.conf.set(key, old)


def slices(sizes: dict[int, int], most: int) -> tuple[list[list[int]], list[int]]:
    """(cells that are sent together, each time *most* bytes at most; cells that are too large to be sent)."""
    out: list[list[int]] = []
    room = 0
    for cell, size in sorted(sizes.items()):
        if size > most:
            continue
        if size > room:
            out.append([])
            room = most
        out[-1].append(cell)
        room -= size
    return out, sorted(c for c, size in sizes.items() if size > most)


class HashForest:
    """Runs of sorted blocks under *path*, for lookups at similarity *t* or more; its cells are fixed when it is begun."""

    def __init__(self, spark: SparkSession, path: str, cells: int, t: Fraction = THRESHOLD, recall: float = RECALL):
        self.spark, self.path, self.cells, self.t, self.recall = spark, path, cells, t, recall
        self.depth = widened_depth(float(t), recall)

    def _signed(self, norms: DataFrame) -> DataFrame:
        cells, cut_off = self.cells, np.uint64(8 * (LEVELS - self.depth))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uids: list[np.ndarray] = []
            texts: list[str] = []

            def out() -> pa.RecordBatch:
                own, at = np.unique(np.concatenate(uids), return_index=True)
                sigs, par, sizes = signatures([texts[i] for i in at])
                cols = {"tree": np.tile(np.arange(TREES, dtype=np.uint8), len(own)), "sig": sigs.ravel()}
                cols |= {k: np.repeat(v, TREES) for k, v in {"uid": own, "par": par, "size": sizes}.items()}
                cell = (mix((cols["sig"] >> cut_off) ^ mix(cols["tree"].astype(np.uint64) + np.uint64(1))) % np.uint64(cells)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                ends = np.searchsorted(cell[order], np.arange(cells + 1))
                parts = ((int(k), {n: v[order[ends[k] : ends[k + 1]]] for n, v in cols.items()}) for k in np.flatnonzero(np.diff(ends)))
                return _rows([row for k, c in parts for row in _blocks(k, c, BLOCK)])

            for b in batches:
                uids.append(b.column(0).to_numpy())
                texts += b.column(1).to_pylist()
                if len(texts) >= HELD:
                    yield out()
                    uids, texts = [], []
            if texts:
                yield out()

        return norms.select("uid", "norm").mapInArrow(sign, _BLOCKS)

    def _write(self, blocks: DataFrame, run: str) -> None:
        # a rebalance, not a repartition: AQE splits a cell that very many texts share
        rows = blocks.hint("rebalance", "cell").sortWithinPartitions("cell", "lo").mapInArrow(_compact, _BLOCKS)
        rows.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/run={run}")

    def append(self, norms: DataFrame, run: str) -> None:
        """Persist a run: the signatures of (uid, norm), none empty; repeated rows count once."""
        self._write(self._signed(norms), run)

    def blocks(self) -> DataFrame:
        """(lo, hi, blob, run, cell) of all runs; run and cell are folders."""
        return _stored(self.spark, "lo long, hi long, blob binary, run string, cell int", self.path)

    def merge(self, runs: list[str], into: str) -> None:
        """One run in place of several."""
        self._write(self.blocks().where(F.col("run").isin(runs)).select("cell", "lo", "hi", "blob"), into)
        for run in runs:
            remove(self.spark, f"{self.path}/run={run}")

    def touched(self, *runs: str, blocks: DataFrame | None = None) -> DataFrame:
        """The blocks that a lookup of *runs* reads: those in their own cells."""
        blocks = self.blocks() if blocks is None else blocks
        names = "|".join(map(re.escape, runs))
        cells = {int(c) for f in blocks.inputFiles() for c in re.findall(rf"/run=(?:{names})/cell=(\d+)/", f)}
        return blocks.where(F.col("cell").isin(sorted(cells)))

    def lookups(self, *runs: str, within: bool = True) -> list[DataFrame]:
        """(a, b), a < b, maybe repeated: pairs of a text of *runs* and one of any run (if *within*, of *runs* too), in parts
        that are to be carried out one after the other."""
        blocks = self.blocks()
        if sum(path_bytes(self.spark, f"{self.path}/run={run}") for run in runs) <= SENT_BYTES:
            return [self._met(runs, within, self.touched(*runs, blocks=blocks), True)]
        own = blocks.where(F.col("run").isin(*runs)).groupBy("cell").agg(F.sum(F.length("blob")).alias("n"))
        sent, shuffled = slices({r.cell: r.n for r in own.collect()}, SENT_BYTES)
        parts = [(cells, True) for cells in sent] + ([(shuffled, False)] if shuffled else [])
        return [self._met(runs, within, blocks.where(F.col("cell").isin(cells)), small) for cells, small in parts]

    def candidates(self, run: str, within: bool = True) -> DataFrame:
        """(a, b), a < b: pairs of a text of *run* and one of any run (if *within*, of the run itself too)."""
        return reduce(DataFrame.union, self.lookups(run, within=within)).distinct()

    def _met(self, runs: tuple[str, ...], within: bool, blocks: DataFrame, sent: bool) -> DataFrame:
        t, depth = self.t, self.depth
        coarse = 8 * max(0, 6 - depth)
        from_, to = (lambda c: F.shiftleft(F.shiftright(c, coarse), coarse)), (lambda c: F.shiftleft(F.shiftright(c, coarse) + 1, coarse) - 1)
        own = F.col("run").isin(*runs)
        q = blocks.where(own).select("cell", F.col("run").alias("q_run"), from_("lo").alias("q_lo"), to("hi").alias("q_hi"), F.col("lo").alias("q_at"), F.col("blob").alias("q"))
        e = blocks.where(F.lit(within) | ~own).withColumnRenamed("blob", "e")
        once = ~own | (F.struct("q_run", "q_at") <= F.struct("run", "lo"))  # two blocks of the runs meet once
        # the batch goes to where the index lies
        met = (F.broadcast(q) if sent else q).join(e, "cell").where((F.col("q_lo") <= F.col("hi")) & (F.col("lo") <= F.col("q_hi")) & once)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                last, mine = None, {}
                for x, y in zip(b.column(0), b.column(1)):
                    x = x.as_buffer()
                    mine = mine if last is not None and x.equals(last) else _unpack([x])
                    last = x
                    lo, hi = found_in_blocks(mine, _unpack([y.as_buffer()]), depth, t)
                    if len(lo):
                        yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["a", "b"])

        return met.select("q", "e").mapInArrow(search, "a long, b long")


class History:
    """Everything accepted so far: the forest, and the records in shards by headline and by page. It lasts under *path*, so
    later batches may be added by another session."""

    def __init__(self, spark: SparkSession, path: str, cells: int, t: Fraction = THRESHOLD, shards: int | None = None):
        self.spark, self.path, self.t = spark, path, t
        self.shards = shards or shuffle_width(spark)
        self.forest = HashForest(spark, f"{path}/forest", cells, t)
        self.young: list[str] = []

    def add(self, records: DataFrame, run: str) -> None:
        """Persist a run of records (id, seq, page, norm, uid)."""
        self.keep(records, run)
        self.forest.append(self.headlines().where(F.col("run") == run).select(F.col("key").alias("uid"), "norm"), run)

    def keep(self, records: DataFrame, run: str) -> None:
        """Persist the records of a run beside the forest."""
        for name, key, columns in (("headlines", F.col("uid"), ["norm", "uid"]), ("pages", F.xxhash64("page"), ["page"])):
            rows = records.withColumn("key", F.when(F.col(columns[0]) != "", key) if name == "headlines" else F.when(F.col("page").isNotNull(), key))
            rows = rows.where("key is not null").select("key", *columns[:1], "id", "seq", F.pmod("key", F.lit(self.shards)).cast("int").alias("shard"))
            rows.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/{name}/run={run}")

    def headlines(self) -> DataFrame:
        return _stored(self.spark, "key long, norm string, id long, seq long, run string, shard int", f"{self.path}/headlines")

    def pages(self) -> DataFrame:
        return _stored(self.spark, "key long, page string, id long, seq long, run string, shard int", f"{self.path}/pages")

    def matches(self, run: str) -> DataFrame:
        """(id_a, id_b), id_a < id_b: a record of *run* and one before it with the same page or a similar headline."""
        met = scratch_path(self.spark, "met")
        self.look_up([run], met)
        self.young.append(run)
        self.merge_young()
        return self.settled(met, run)

    def look_up(self, runs: list[str], met: str) -> None:
        """Add to the table at *met* what *runs* meet in the forest."""
        for part in self.forest.lookups(*runs):
            part.write.mode("append").parquet(met)

    def merge_young(self) -> None:
        """Merge the forest's young runs once there are enough of them."""
        if len(self.young) >= MERGE_EVERY:
            self.forest.merge(self.young, f"{self.young[-1]}-merged")
            self.young = []

    def settled(self, met: str, run: str) -> DataFrame:
        """(id_a, id_b), id_a < id_b: a record kept under *run* and one before it with the same page, or headlines that are
        equal, or that are similar and among the pairs at *met*."""
        pairs = cut(self.spark.read.schema("a long, b long").parquet(met).distinct(), "met")
        remove(self.spark, met)
        kept = self.headlines()
        asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        shard = F.pmod("key", F.lit(self.shards)).cast("int")
        texts = kept.join(asked.withColumn("shard", shard), ["shard", "key"], "left_semi").groupBy(F.col("key").alias("uid")).agg(F.min("norm").alias("norm"))
        links = cut(verified(pairs, texts, self.t), "links", drop=[pairs])
        new = kept.where(F.col("run") == run)
        equal = new.select(F.col("key").alias("a"), F.col("key").alias("b")).distinct()
        ways = links.union(links.select("b", "a")).union(equal)
        before = F.col("y.seq").isNull() | (F.col("y.seq") < F.col("x.seq"))
        mine = ways.join(new.select(F.col("key").alias("a"), "id", "seq"), "a").withColumn("shard", F.pmod("b", F.lit(self.shards)).cast("int"))
        alike = mine.alias("x").join(kept.alias("y"), (F.col("x.shard") == F.col("y.shard")) & (F.col("b") == F.col("y.key"))).where(before)
        pages = self.pages()
        page_of = pages.where(F.col("run") == run).alias("x")
        same = page_of.join(pages.alias("y"), (F.col("x.shard") == F.col("y.shard")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.page") == F.col("y.page"))).where(before)
        ids = [F.col("x.id").alias("x"), F.col("y.id").alias("y")]
        found = alike.select(*ids).union(same.select(*ids)).where("x <> y")
        return cut(found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct(), "matches", drop=[links])


def cells_for(n: int) -> int:
    return max(1, ceil(n * TREES * _ROW_BYTES / CELL_BYTES))


def posted_records(posted: DataFrame) -> DataFrame:
    """(id, seq, page, norm) of posted entries, which come before every batch."""
    return posted.select(F.col("entry_id").alias("id"), F.lit(None).cast("long").alias("seq"), canonical_url(F.col("url")).alias("page"), normalized_headline(F.col("title")).alias("norm"))


def batch_records(incoming: DataFrame) -> DataFrame:
    """(id, seq, page, norm) of delivered rows; seq is the batch."""
    rows = incoming.where("batch_id is not null")
    return rows.select(F.col("article_id").alias("id"), F.col("batch_id").alias("seq"), page(F.col("link"), F.col("canonical_url")).alias("page"), normalized_headline(F.col("title")).alias("norm"))


def in_rounds(records: DataFrame, rows: int = ROUND_ROWS, most: int = MOST_ROUNDS) -> DataFrame:
    """*records* with ``round``: -1 of what has no seq, else a number that rises with seq; no seq is divided."""
    sizes = records.where("seq is not null").groupBy("seq").agg(F.count("*").alias("n"))
    total = records.where("seq is not null").count()
    placed = running_total(sizes, [F.col("seq")], "n", "before").select("seq", F.floor(F.col("before") / max(rows, ceil(total / most), 1)).cast("int").alias("round"))
    return records.join(placed, "seq", "left").withColumn("round", F.coalesce("round", F.lit(-1)))


def earlier_matches(posted: DataFrame, incoming: DataFrame, t: Fraction = THRESHOLD, path: str | None = None, round_rows: int = ROUND_ROWS, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: an incoming row and a record before it (posted, or of an earlier batch) that have the
    same page, or headlines of similarity >= t."""
    spark = incoming.sparkSession
    keyed = posted_records(posted).unionByName(batch_records(incoming))
    records = cut(keyed.withColumn("uid", F.when(F.col("norm") != "", F.xxhash64("norm"))), "records")
    where = scratch_path(spark, "rounds")
    in_rounds(records, round_rows, most_rounds).write.partitionBy("round").parquet(where)
    stored = _stored(spark, "seq long, id long, page string, norm string, uid long, round int", where)
    numbers = sorted({int(k) for f in stored.inputFiles() for k in re.findall(r"/round=(\d+)/", f)})  # MOST_ROUNDS and one at most
    n = records.where("uid is not null").count()
    history = History(spark, path or scratch_path(spark, "history"), cells_for(n), t, min(shuffle_width(spark), max(1, ceil(n / SHARD_ROWS))))
    remove(spark, records._millrace_path)
    history.keep(stored.where("round = -1"), "posted")
    history.keep(stored.where("round >= 0"), "batches")
    texts = lambda k: stored.where((F.col("round") == k) & F.col("uid").isNotNull()).select("uid", "norm")
    history.forest.append(texts(-1), "posted")
    met = scratch_path(spark, "met")
    for k in numbers:
        history.forest.append(texts(k), f"round-{k:05}")
        history.young.append(f"round-{k:05}")
        if len(history.young) >= MERGE_EVERY or k == numbers[-1]:
            history.look_up(history.young, met)
            history.merge_young()
    return history.settled(met, "batches") if numbers else spark.createDataFrame([], "id_a long, id_b long")
