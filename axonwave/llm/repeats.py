"""Which 64-bit hashes occur more than once in a large collection, as a bitmap of fixed size.

A bit stands for a slice of the hash range. Tasks send their hashes, without anything else, to
the owner of the slice (packed, 8 bytes a hash); the owner sorts them and sets the bits of those
that occur again. The bitmap has 2**bits bits whatever the input, so it may be broadcast. It has no
false negatives: a hash that occurs twice has its bit set. False positives are for the exact
step that follows, and cost time only; when a collection grows, bits should grow with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame


def packed_by_owner(hashes: Iterator[np.ndarray], owners: int, most: int = 1 << 20):
    """Record batches (owner, hashes) of at most about `most` hashes each, from arrays of hashes."""
    import pyarrow as pa

    def flush(held):
        h = np.sort(np.concatenate(held))
        # a hash that this task has twice needs to be sent twice at most
        keep = np.ones(len(h), bool)
        keep[2:] = h[2:] != h[:-2]
        h = h[keep]
        owner = owner_of(h, owners)
        cut = np.searchsorted(owner, np.arange(owners + 1))
        ids = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in ids], pa.binary())], ["owner", "hashes"])

    held, n = [], 0
    for h in hashes:
        held.append(h)
        n += len(h)
        if n >= most:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def owner_of(h: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal contiguous ranges of hashes; owners is a power of two."""
    return (h >> np.uint64(64 - (owners.bit_length() - 1))).astype(np.int64) if owners > 1 else np.zeros(len(h), np.int64)


def owners_for(df: DataFrame) -> int:
    """A power of two at least as large as the number of shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(0, n - 1).bit_length()


def repeated_bitmap(blobs: DataFrame, owners: int, bits: int) -> np.ndarray:
    """blobs(owner, hashes) -> the bitmap, as bytes of 8 bits in np.packbits order; 2**bits bits in all."""
    return bitmap_of(blobs, owners, bits)


def bitmap_of(blobs: DataFrame, owners: int, bits: int, least: int = 2) -> np.ndarray:
    """The same for hashes that occur least (1 or 2) times or more."""
    span = bits - (owners.bit_length() - 1)

    def slices(key, group):
        import pyarrow as pa

        from axonwave.llm.common import given_back

        held = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("hashes")]
        h = np.sort(np.concatenate(held))
        again = h[1:][h[1:] == h[:-1]] if least > 1 else h
        own = np.zeros(1 << span, bool)
        own[(again >> np.uint64(64 - bits)).astype(np.int64) & ((1 << span) - 1)] = True
        part = zlib.compress(np.packbits(own), 1)
        del held, h, again, own
        given_back()
        return pa.table({"owner": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([part], pa.binary())})

    out = np.zeros((owners, (1 << span) // 8), np.uint8)
    # one job: a local iterator runs one for each partition, and the driver remembers them all; the parts together have 2**bits bits at most
    found = blobs.groupBy("owner").applyInArrow(slices, "owner int, part binary").toArrow()
    for owner, part in zip(found.column("owner").to_pylist(), found.column("part"), strict=True):
        out[owner] = np.frombuffer(zlib.decompress(part.as_buffer()), np.uint8)
    return out.reshape(-1)


def tested(bitmap: np.ndarray, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    def test(h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - bits)).astype(np.int64)
        return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    return test
