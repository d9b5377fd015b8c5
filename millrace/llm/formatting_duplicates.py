"""Duplicates hidden by formatting differences (problem 2).

A record's canonical key is its page (canonical URL) and headline hash in hexadecimal digits only, as a 128-bit
fingerprint. A Bloom filter of BITS_PER_KEY bits a key, so one that grows with the input, is cut by key range into
segments of SEGMENT bits. Every input partition builds its part of the filter, bits of keys seen once and of keys seen
again, as sorted bit positions; a segment's task merges the partitions' bits, moving those they share from "once" to
"again", and answers each partition with those of its own bits that are "again". Keys then meet the answer where they
are stored: the key table is bucketed by partition, so it isn't shuffled. Only possible repeats are shuffled and grouped
exactly; all other records are singletons and are emitted where they are.

Scale: no filter is whole anywhere, neither on the driver nor broadcast. What is shuffled for it is some 3 bytes a key
and HASHES bits of answer a repeated key. At every size the fill is HASHES / BITS_PER_KEY at most, so some 1.4 % of the
unique keys pass for possible repeats and cost shuffle, never a wrong result. A key with much of the input is one
position a partition; its members are pre-aggregated, and the join back to them is split by AQE.

Defined results: a null link falls back to the canonical URL; without both, or without hash and headline, a record has no
copies; a null hash is the SHA-1 of the normalised headline, which may be that of an empty one; repeated rows with one id
count as copies but are not listed as copies of themselves; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import headline_hash, normalized_headline
from millrace.functions.url import canonical_url
from millrace.llm.tokensets import seeded
from millrace.session import bucketed, cut, shuffle_width

SEGMENT, BITS_PER_KEY, HASHES = 1 << 22, 16, 2
#: Keys a build task holds before it hands its bits on; more of a partition go out in several parts.
HELD = 1 << 22


def page(link: Column, canonical: Column) -> Column:
    return canonical_url(F.coalesce(link, canonical))


def stored_or_computed_hash(title_hash: Column, title: Column) -> Column:
    stored = F.regexp_replace(F.lower(title_hash), "[^0-9a-f]", "")
    computed = headline_hash(normalized_headline(F.when(title_hash.isNull(), title)))
    return F.when(title_hash.isNotNull(), stored).when(title.isNotNull(), computed)


def canonical_keys(articles: DataFrame) -> DataFrame:
    """(id, k1, k2): the fingerprint of each record that can have copies; k1 and k2 are null for the others."""
    keyed = articles.select(
        F.col("article_id").alias("id"),
        page(F.col("link"), F.col("canonical_url")).alias("page"),
        stored_or_computed_hash(F.col("title_hash"), F.col("title")).alias("hash"),
    )
    whole = F.col("page").isNotNull() & F.col("hash").isNotNull()
    return keyed.select("id", F.when(whole, F.xxhash64("page", "hash")).alias("k1"), F.when(whole, F.xxhash64(F.lit("second"), "hash", "page")).alias("k2"))


def segments_for(n: int, width: int) -> int:
    return max(width, ceil(n * BITS_PER_KEY / SEGMENT))


def places(keys: np.ndarray, segments: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment of each key, its bits there: HASHES columns)."""
    u = keys.view(np.uint64)
    segment = ((u >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    return segment, np.stack([(seeded(u, i + 1) % np.uint64(bits)).astype(np.uint32) for i in range(HASHES)], 1)


def _packed(positions: np.ndarray) -> bytes:
    """Ascending positions as gaps in four byte planes; those of the high bytes are nearly empty and shrink in the shuffle."""
    gaps = np.diff(positions.astype(np.int64), prepend=0).astype("<u4")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _positions(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def bits_of_segment(n: int, segments: int) -> int:
    return max(64, ceil(n * BITS_PER_KEY / segments))


def _built(keys: np.ndarray, segments: int, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(segment, bits of keys seen, bits of keys seen again) of some keys of one partition."""
    values, counts = np.unique(keys, return_counts=True)
    segment, at = places(values, segments, bits)
    order = np.argsort(segment, kind="stable")
    ends = np.searchsorted(segment[order], np.arange(segments + 1))
    for s in np.flatnonzero(np.diff(ends)):
        rows = order[ends[s] : ends[s + 1]]
        once, n = np.unique(at[rows], return_counts=True)
        # a bit that two keys share, or one key has twice, is seen again only if a key was
        again = np.unique(at[rows[counts[rows] > 1]])
        clash = once[n > 1]
        yield int(s), _packed(once), _packed(np.union1d(again, clash))


def repeat_bits(keys: DataFrame, n: int) -> DataFrame:
    """(part, segment, bits): of each partition's bits those that are seen again, in it or elsewhere. keys: (k1, part)."""
    segments = segments_for(n, shuffle_width(keys.sparkSession))
    bits = bits_of_segment(n, segments)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for part, got in held.items():
                rows = list(_built(np.concatenate(got), segments, bits))
                cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["segment", "part", "once", "again"])
            held.clear()

        for b in batches:
            k, p = b.column(0).to_numpy(), b.column(1).to_numpy()
            for part in np.unique(p):
                held.setdefault(int(part), []).append(k[p == part])
            size += len(k)
            if size >= HELD:
                yield from out()
                size = 0
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for b in batches:
            for s, part, once, again in zip(*(c.to_pylist() for c in b.columns)):
                mine.setdefault(s, []).append((part, once, again))
        for s, rows in mine.items():
            seen, repeated = np.zeros(bits, bool), np.zeros(bits, bool)
            for _, once, again in rows:
                at = _positions(once)
                repeated[at[seen[at]]] = True
                seen[at] = True
                repeated[_positions(again)] = True
            answers = [(part, at[repeated[at]]) for part, once, _ in rows for at in (_positions(once),)]
            found = [(part, at) for part, at in answers if len(at)]
            cols = [pa.array([p for p, _ in found], pa.int32()), pa.array([s] * len(found), pa.int32()), pa.array([_packed(at) for _, at in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "segment", "bits"])

    parts = keys.where("k1 is not null").select("k1", "part").mapInArrow(build, "segment int, part int, once binary, again binary")
    return parts.repartitionById(segments, "segment").mapInArrow(merge, "part int, segment int, bits binary")


def flagged(keys: DataFrame, n: int) -> DataFrame:
    """(id, k1, k2, maybe): whether the key may occur more than once; false only where it occurs once.

    keys: (id, k1, k2, part), bucketed by part, so that only the answers move."""
    segments = segments_for(n, shuffle_width(keys.sparkSession))
    bits = bits_of_segment(n, segments)

    def probe(rows: pa.Table, answers: pa.Table) -> pa.Table:
        maybe = np.zeros(len(rows), bool)
        known = rows.column("k1").is_valid().to_numpy()
        values = rows.column("k1").combine_chunks().fill_null(0).to_numpy()
        segment, at = places(values, segments, bits)
        owner = rows.column("part").to_numpy()
        for part in np.unique(owner):
            parts = answers.filter(pa.compute.equal(answers.column("part"), int(part)))
            flat = [_positions(b) + s * bits for b, s in zip(parts.column("bits").to_pylist(), parts.column("segment").to_pylist())]
            again = np.unique(np.concatenate(flat)) if flat else np.zeros(0, np.int64)
            here = owner == part
            maybe[here] = np.isin(segment[here, None] * bits + at[here], again).all(1)
        columns = [rows.column(k) for k in ("id", "k1", "k2")]
        return pa.Table.from_arrays([*columns, pa.array(maybe & known)], names=["id", "k1", "k2", "maybe"])

    answers = repeat_bits(keys, n)
    return keys.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(probe, "id long, k1 long, k2 long, maybe boolean")


def _split(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all keys with the flag ``maybe``, groups with keep_id and copies of the keys that do repeat)."""
    keys = bucketed(canonical_keys(articles).withColumn("part", F.spark_partition_id()), "part", "keys")
    rows = cut(flagged(keys, keys.count()), "flagged", drop=[keys])
    groups = rows.where("maybe").groupBy("k1", "k2").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))
    return rows, groups


def copies(articles: DataFrame) -> DataFrame:
    """(keep_id, copy_id): for each set of copies, its smallest id beside each other member."""
    rows, groups = _split(articles)
    members = rows.where("maybe").select("id", "k1", "k2")
    return members.join(groups.where("copies > 1"), ["k1", "k2"]).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def collapsed(articles: DataFrame) -> DataFrame:
    """(article_id, copies): one row for each page and headline: the smallest id and how many records carry it."""
    rows, groups = _split(articles)
    alone = rows.where("not maybe").select(F.col("id").alias("article_id"), F.lit(1).cast("long").alias("copies"))
    return alone.unionByName(groups.select(F.col("keep_id").alias("article_id"), "copies"))
