"""Near-duplicate texts with small edits: an exact similarity join by prefix filtering.

Records are sets of distinct runs of three tokens.  Two sets are joined when
their Jaccard similarity reaches the threshold (0.7 here: TESTDATA fixes it).

1. *Frequencies.*  Every partition counts its shingles in a table of hashed
   counters; the tables are added up block by block and kept as one byte per
   counter, exact up to 64 and in steps of an eighth of a doubling above, so
   frequent shingles are told from rare ones whatever the corpus holds.  The
   table has about two counters per shingle of the corpus, at most 2**MAX_BITS
   (128 MB), so it may be broadcast; a fuller table costs time, never a pair.
2. *Prefixes.*  A set of n shingles, ordered rarest first, needs only its first
   n - ceil(t n) + 1 shingles to meet every partner.  Shingles whose counter is
   1 occur in no other record and are left out.
3. *Classes.*  Records with the same token sequence are one class.
4. *Candidates.*  Classes meet on prefix shingles; a meeting must pass the
   length and the positional filter.  The postings of a shingle that far more
   records hold than its counter's share are dealt into blocks, and pairs of
   blocks meet in tasks of their own.  Each pair goes on once.
5. *Suffix filter.*  Both sets are parted at PIVOTS fixed pivots of the hash
   order; between two pivots they share no more than the smaller part holds,
   which bounds the overlap from above.  Sizes of parts travel as half bytes;
   parts of 15 and more on both sides bound nothing, and the pair goes on.
6. *Verification.*  Sets that pass are intersected once per pair on 32 bits of
   the hashes.  Two sets lose at most as many common hashes by that as the one
   that loses fewer has hashes that coincide on 32 bits, so no pair below the
   overlap needed less that number can be one; pairs from there to a margin
   above, and all pairs of large sets, are intersected on 64.

Defined results: null, empty and short texts (under 40 tokens) have no
partners; equal token sequences are similar; repeated rows (same id) count
once; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import by_bytes, materialized, release, spread, text_batches

THRESHOLD = 0.7
SHINGLE = 3
MIN_TOKENS = 40
#: Bounds of the frequency table (powers of two), and the size of one block of it.
MIN_BITS, MAX_BITS, BLOCK_BITS = 20, 27, 17
#: Characters of text for each shingle, to size the table by.
CHARACTERS = 7
#: Partial tables added up by one task.
MERGE = 2_000
#: Places at which sets are parted by the suffix filter (a power of two).
PIVOTS = 256
#: Bytes of text whose tokens are found at a time (some 60 bytes of work space each).
WORK_BYTES = 1 << 20
#: Records beyond the usual ones that a block of a frequent shingle's postings holds, about.
BLOCK_POSTINGS = 4_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: What a byte is to the tokens: nothing, an upper case letter, a lower case letter, a digit; and the byte in lower case.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS[0][:n], _POWERS[1][:n]


def without_breadcrumb(text: str, parent: str | None) -> str:
    """A chunk's text without the line that names its parent."""
    if parent is not None and text.startswith("# in "):
        cut = text.find("\n")
        return text[cut + 1 :] if cut >= 0 else ""
    return text


def token_hashes(texts: list[str]) -> list[np.ndarray]:
    """For each text one 64-bit hash per token, in order: all texts in one pass over their bytes.

    A token begins at a digit behind none, at a lower case letter behind no
    letter, at an upper case letter behind none or before a lower case one.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = _KIND[buf]
    before, after = np.append(np.uint8(0), kind[:-1]), np.append(kind[1:], np.uint8(0))
    first = ((kind == 3) & (before != 3)) | ((kind == 2) & (before != 2) & (before != 1)) | ((kind == 1) & ((before != 1) | (after == 2)))
    last = (kind > 0) & ((after == 0) | np.append(first[1:], True))
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER[buf] + np.uint64(1)) * power, out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.split(h, np.searchsorted(start, ends[:-1]))


def shingles(h: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of SHINGLE tokens."""
    if len(h) < SHINGLE:
        return np.empty(0, np.uint64)
    x = (h[:-2] * _M1) ^ ((h[1:-1] * _M2) + (h[2:] >> np.uint64(7))) + h[2:] * _M3
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return np.unique(x)


def table_bits(n_chars: int) -> int:
    want = max(1, 2 * n_chars // CHARACTERS)
    return min(MAX_BITS, max(MIN_BITS, (want - 1).bit_length()))


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _sets(batch):
    """(position in the batch, token hashes, shingles) of each record that is long enough."""
    rows = [(k, without_breadcrumb(t, p)) for k, (t, p) in enumerate(zip(batch.column("text").to_pylist(), batch.column("parent").to_pylist())) if t]
    if rows:
        for (k, _), h in zip(rows, token_hashes([t for _, t in rows])):
            if len(h) >= MIN_TOKENS:
                yield k, h, shingles(h)


#: Counters up to EXACT are kept as they are, larger ones by their logarithm.
EXACT, OCTAVE = 64, 8


def coded(counts: np.ndarray) -> np.ndarray:
    """One byte per counter, in the order of the counters."""
    big = EXACT + OCTAVE * np.log2(np.maximum(counts, EXACT) / EXACT)
    return np.minimum(np.where(counts <= EXACT, counts, big), 255).astype(np.uint8)


def decoded(codes: np.ndarray) -> np.ndarray:
    """About the counters that were coded."""
    c = codes.astype(np.float64)
    return np.where(c <= EXACT, c, EXACT * 2 ** ((c - EXACT) / OCTAVE))


def _count_batches(batches, bits, salts):
    table = np.zeros(1 << bits, np.uint8)
    some = False
    for b in by_bytes(batches, WORK_BYTES):
        parts = [s for _, _, s in _sets(b)]
        if parts:
            some = True
            u, c = np.unique(_bucket(np.concatenate(parts), bits), return_counts=True)
            table[u] = np.minimum(table[u] + c, 255).astype(np.uint8)
    if some:
        salt = TaskContext.get().partitionId() % salts
        blocks = table.reshape(-1, 1 << BLOCK_BITS)
        for n, row in enumerate(blocks):
            if row.any():
                yield pa.RecordBatch.from_pydict({"block": [n], "salt": [salt], "counts": [_packed(row)]}, _BLOCK)


def _packed(row: np.ndarray) -> bytes:
    """Counters of a block that are not zero: gaps as two planes of bytes, then the counts, compressed."""
    at = np.flatnonzero(row)
    gaps = np.diff(at, prepend=0).astype(np.uint32)
    planes = [(gaps >> s & 255).astype(np.uint8).tobytes() for s in (0, 8, 16)]
    return zlib.compress(b"".join([*planes, row[at].astype(np.uint8).tobytes()]), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts)"""
    a = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    g = a[0].astype(np.int64) | a[1].astype(np.int64) << 8 | a[2].astype(np.int64) << 16
    return np.cumsum(g), a[3].astype(np.int64)


_BLOCK = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])


def _packed_sums(total: np.ndarray) -> bytes:
    return zlib.compress(total.astype("<i8").tobytes(), 1)


def _sums(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<i8")


def _add_blocks(pdf):
    """Counters of a block over some partitions."""
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for raw in pdf["counts"]:
        at, n = _unpacked(raw)
        total[at] += n
    return pdf.head(1).assign(counts=[_packed_sums(total)])


def _code_blocks(pdf):
    """The sums of a block, coded."""
    return pdf.head(1).assign(counts=[_packed(coded(np.sum([_sums(raw) for raw in pdf["counts"]], axis=0)))])


def frequency_table(records: DataFrame) -> np.ndarray:
    """Coded counts of hashed shingles over all records."""
    bits = table_bits(records.select(F.sum(F.length("text")).cast("bigint")).first()[0] or 0)
    schema = "block int, salt int, counts binary"
    salts = -(-records.rdd.getNumPartitions() // MERGE)
    counted = records.mapInArrow(partial(_count_batches, bits=bits, salts=salts), schema)
    if salts > 1:
        merged = counted.groupBy("block", "salt").applyInPandas(_add_blocks, schema).groupBy("block").applyInPandas(_code_blocks, schema)
    else:
        merged = counted.groupBy("block").applyInPandas(lambda pdf: _code_blocks(_add_blocks(pdf)), schema)
    table = np.zeros(1 << bits, np.uint8)
    for r in merged.select("block", "counts").toLocalIterator():  # at most 2**(MAX_BITS - BLOCK_BITS) rows of a fixed size
        at, n = _unpacked(bytes(r.counts))
        table[(r.block << BLOCK_BITS) + at] = n
    return table


_SIGNED = np.int64
_RECORD = pa.schema(
    [("id", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("n", pa.int32()), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
     ("blocks", pa.list_(pa.int32())), ("parts", pa.binary())]
)
RECORD_SCHEMA = "id bigint, sig_a bigint, sig_b bigint, n int, grams array<bigint>, places array<int>, blocks array<int>, parts binary"


def prefix_of(s: np.ndarray, table: np.ndarray, threshold: float, usual: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix shingles that may occur elsewhere, their places in the rarest-first order, into how many blocks their postings are dealt.

    ``usual``: what a counter holds on average.
    """
    n = len(s)
    keep = n - math.ceil(threshold * n - 1e-9) + 1
    seen = table[_bucket(s, len(table).bit_length() - 1)]
    order = np.lexsort((s, seen))[:keep]
    places = np.flatnonzero(seen[order] > 1)
    chosen = order[places]
    blocks = 1 + np.maximum(0, decoded(seen[chosen]) - 4 * usual) // BLOCK_POSTINGS
    return s[chosen], places.astype(np.int32), blocks.astype(np.int32)


def _table_of(raw: bytes) -> tuple[np.ndarray, float]:
    """The unpacked frequency table and what a counter holds on average.

    Unpacked by every task and let go at its end: idle Python workers would
    keep theirs beside those of others.
    """
    table = np.frombuffer(zlib.decompress(raw), np.uint8)
    step = 1 << BLOCK_BITS  # counted piece by piece: numpy widens what it counts
    many = sum(np.bincount(table[k : k + step], minlength=256) for k in range(0, len(table), step))
    return table, float(many @ decoded(np.arange(256)) / len(table))


def _record_batches(batches, table, threshold):
    counts, usual = _table_of(table.value)
    for b in by_bytes(batches, WORK_BYTES):
        ids = b.column("id").to_pylist()
        out = {k: [] for k in _RECORD.names}
        for k, h, s in _sets(b):
            raw = h.tobytes()
            grams, places, blocks = prefix_of(s, counts, threshold, usual)
            out["id"].append(ids[k])
            out["sig_a"].append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
            out["sig_b"].append(xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
            out["n"].append(len(s))
            out["grams"].append(grams.view(_SIGNED))
            out["places"].append(places)
            out["blocks"].append(blocks)
            out["parts"].append(parts_of(s))
        yield pa.RecordBatch.from_pydict(out, _RECORD)


_SET = pa.schema([("id", pa.int64()), ("grams", pa.list_(pa.int64())), ("low", pa.list_(pa.int32()))])
SET_SCHEMA = "id bigint, grams array<bigint>, low array<int>"
#: Ids that may be sent to every task.
BROADCAST_IDS = 8_000_000


def low_bits(s: np.ndarray) -> np.ndarray:
    """The distinct values of 32 bits of a set's hashes."""
    return np.unique((s & np.uint64(0xFFFFFFFF)).astype(np.uint32))


def _set_batches(batches):
    for b in by_bytes(batches, WORK_BYTES):
        ids = b.column("id").to_pylist()
        rows = [(ids[k], s) for k, _, s in _sets(b)]
        yield pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "grams": [r[1].view(_SIGNED) for r in rows], "low": [low_bits(r[1]).view(np.int32) for r in rows]}, _SET)


_FULL = 15


def parts_of(s: np.ndarray) -> bytes:
    """How many hashes of a set lie between each two pivots, up to _FULL, as half bytes."""
    n = np.minimum(np.bincount((s >> np.uint64(65 - PIVOTS.bit_length())).astype(np.int64), minlength=PIVOTS), _FULL).astype(np.uint8)
    return (n[0::2] | n[1::2] << 4).tobytes()


def most_shared(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Per pair of sets, how many hashes they may share at most by their parts; very many where that can't be told."""
    x, y = (np.frombuffer(b"".join(p), np.uint8).reshape(len(p), -1) for p in (a, b))
    total = np.zeros(len(a), np.int64)
    for u, v in ((x & 15, y & 15), (x >> 4, y >> 4)):
        least = np.minimum(u, v).astype(np.int64)
        total += np.where(least == _FULL, 1 << 40, least).sum(axis=1)
    return total


def needed(n_a, n_b, threshold: float):
    """The overlap two sets must have."""
    return np.ceil(threshold / (1 + threshold) * (n_a + n_b) - 1e-9).astype(np.int64)


def margin(n_a: int, n_b: int) -> float:
    """Hashes of two sets that coincide on 32 bits by chance stay below this; for sets so large that one may be expected every few hundred pairs, 64 bits decide."""
    return 8 if n_a * n_b < 1 << 24 else math.inf


def _suffix_filter(batches, threshold):
    for b in batches:
        if b.num_rows:
            n_a, n_b = (b.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            keep = most_shared(*(b.column(c).to_pylist() for c in ("parts_a", "parts_b"))) >= needed(n_a, n_b, threshold)
            yield b.filter(pa.array(keep)).select(["rep_a", "rep_b", "n_a", "n_b"])


_CHECKED = pa.schema([("rep_a", pa.int64()), ("rep_b", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("similarity", pa.float64())])
_CHECKED_SCHEMA = "rep_a bigint, rep_b bigint, n_a int, n_b int, similarity double"


def _verify(batches, threshold, exact):
    """Pairs that reach the threshold with their similarity; on 32 bits null where only 64 can tell."""
    for b in by_bytes(batches, 16 << 20):
        rows = []
        for k, (i, j, n_a, n_b) in enumerate(zip(*(b.column(c).to_pylist() for c in ("rep_a", "rep_b", "n_a", "n_b")))):
            x, y = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("set_a", "set_b"))
            need, both = int(needed(n_a, n_b, threshold)), len(np.intersect1d(x, y, assume_unique=True))
            if exact:
                sure = both >= need
            else:
                sure = both >= need + margin(n_a, n_b)
                if not sure and both >= need - min(n_a - len(x), n_b - len(y)):
                    rows.append((i, j, n_a, n_b, None))
            if sure:
                rows.append((i, j, n_a, n_b, round(both / (n_a + n_b - both), 6)))
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _CHECKED.types[n]) for n in range(5)], schema=_CHECKED)


def classes(records: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: id, rep), (classes: rep, n, grams, places, blocks, parts); the table behind; ``records`` has id, text, parent."""
    spark = records.sparkSession
    text_batches(spark)
    records = spread(records.select("id", "text", "parent").where("id is not null and text is not null"))
    table = spark.sparkContext.broadcast(zlib.compress(frequency_table(records).tobytes(), 1))  # sparse, so it packs well
    made = materialized(records.mapInArrow(partial(_record_batches, table=table, threshold=threshold), RECORD_SCHEMA), "prefixes")
    slim = made.select("id", "sig_a", "sig_b").distinct()
    members = materialized(slim.join(slim.groupBy("sig_a", "sig_b").agg(F.min("id").alias("rep")), ["sig_a", "sig_b"]).select("id", "rep"), "members")
    # copies are few as a rule, so that leaving them out needs no shuffle of the prefixes; repeated rows are met by distinct below
    reps = made.join(members.where("id <> rep").select("id"), "id", "left_anti").withColumnRenamed("id", "rep")
    return members, reps, made


def met_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """(rep_a < rep_b) of classes that meet on a prefix shingle and pass the length and positional filters, each pair once.

    A posting lies in block x of its shingle's blocks; it is the left side of
    the block pairs (x, y >= x) and the right side of (y <= x, x).
    """
    g = F.col("g")
    post = reps.select("rep", "n", F.explode(F.arrays_zip("grams", "places", "blocks")).alias("g")).select(
        "rep", "n", g.grams.alias("gram"), g.places.alias("place"), g.blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), g.blocks).cast("int").alias("x")
    )
    a = post.select("*", F.explode(F.sequence("x", F.col("blocks") - 1)).alias("y")).alias("a")
    b = post.select("rep", "n", "gram", "place", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), "x")).alias("x")).alias("b")
    t = F.lit(threshold / (1 + threshold))
    need = F.ceil(t * (F.col("a.n") + F.col("b.n")) - F.lit(1e-9))
    rest = F.lit(1) + F.least(F.col("a.n") - F.col("a.place") - 1, F.col("b.n") - F.col("b.place") - 1)
    other = F.when(F.col("a.x") == F.col("a.y"), F.col("a.rep") < F.col("b.rep")).otherwise(F.col("a.rep") != F.col("b.rep"))
    met = a.join(
        b,
        (F.col("a.gram") == F.col("b.gram")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & other
        & (F.col("a.n") >= F.lit(threshold) * F.col("b.n") - F.lit(1e-9)) & (F.col("b.n") >= F.lit(threshold) * F.col("a.n") - F.lit(1e-9))
        # earlier places may already have met, so only what follows both places and the shorter lead bound the overlap
        & (rest + F.least(F.col("a.place"), F.col("b.place")) >= need),
    )
    return met.select(F.least("a.rep", "b.rep").alias("rep_a"), F.greatest("a.rep", "b.rep").alias("rep_b")).distinct()


def similar_classes(records: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): pairs (rep_a < rep_b, similarity) of classes that reach the threshold, each verified once."""
    members, reps, made = classes(records, threshold)
    size = lambda x: reps.select(F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("parts").alias(f"parts_{x}"))
    met = met_pairs(reps, threshold).join(size("a"), "rep_a").join(size("b"), "rep_b")
    near = met.mapInArrow(partial(_suffix_filter, threshold=threshold), "rep_a bigint, rep_b bigint, n_a int, n_b int").distinct()  # repeated rows give sizes twice
    near = materialized(near, "candidates")
    release(made)
    sets = materialized(_sets_of(records, near), "sets")
    side = lambda c, x: sets.select(F.col("id").alias(f"rep_{x}"), F.col(c).alias(f"set_{x}"))
    check = lambda pairs, c, exact: pairs.join(side(c, "a"), "rep_a").join(side(c, "b"), "rep_b").mapInArrow(partial(_verify, threshold=threshold, exact=exact), _CHECKED_SCHEMA).distinct()
    rough = materialized(check(near, "low", False), "rough")
    exact = check(rough.where("similarity is null").drop("similarity"), "grams", True)
    pairs = materialized(rough.where("similarity is not null").unionByName(exact).select("rep_a", "rep_b", "similarity"), "pairs")
    release(near, sets, rough)
    return members, pairs


def _keep_batches(batches, ids):
    wanted = ids.value
    for b in batches:
        keep = np.isin(b.column("id").to_numpy(zero_copy_only=False), wanted)
        if keep.any():
            yield from _set_batches([b.filter(pa.array(keep))])


def _sets_of(records: DataFrame, near: DataFrame) -> DataFrame:
    """(id, grams, low): the shingle sets of all classes in candidate pairs, from their texts.

    Up to BROADCAST_IDS ids (64 MB) are sent to the tasks, which then read the
    texts in place; beyond it the texts are shuffled to the ids.
    """
    wanted = near.select(F.col("rep_a").alias("id")).union(near.select(F.col("rep_b").alias("id"))).distinct()
    records = records.select("id", "text", "parent")
    if wanted.count() <= BROADCAST_IDS:
        ids = np.sort(wanted.toArrow().column("id").to_numpy())  # packed, 8 bytes each
        return records.where("text is not null").mapInArrow(partial(_keep_batches, ids=records.sparkSession.sparkContext.broadcast(ids)), SET_SCHEMA)
    return records.join(wanted, "id", "left_semi").mapInArrow(_set_batches, SET_SCHEMA)


def _records(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("id"), "text", "parent")


def near_pairs(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(chunk_id_a < chunk_id_b): all pairs of similar chunks, copies included."""
    members, pairs = similar_classes(_records(chunks), threshold)
    a, b = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    apart = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("x", "y")
    same = a.join(b, F.col("rep_a") == F.col("rep_b")).where("x < y").select("x", "y")
    return apart.union(same).select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).where("chunk_id_a < chunk_id_b").distinct()


def class_pairs(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(class_a < class_b, similarity): links between classes, by their representatives; with ``class_members`` all pairs without expanding copies."""
    return similar_classes(_records(chunks), threshold)[1].select(F.col("rep_a").alias("class_a"), F.col("rep_b").alias("class_b"), "similarity")


def class_members(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(chunk_id, class_id) of every chunk that is long enough: a class is represented by its smallest id."""
    return classes(_records(chunks), threshold)[0].select(F.col("id").alias("chunk_id"), F.col("rep").alias("class_id"))


def near_links(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per chunk that has a partner: its class and the numbers of copies and of similar other classes."""
    members, pairs = similar_classes(_records(chunks), threshold)
    ends = pairs.select(F.col("rep_a").alias("rep")).union(pairs.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    return (
        members.join(sizes, "rep").join(ends, "rep", "left").where("n_copies > 1 or n_links is not null")
        .select(F.col("id").alias("chunk_id"), F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


_TOKENS_SQL = r"""
WITH one AS (SELECT DISTINCT chunk_id, CASE WHEN parent IS NOT NULL AND starts_with(text, '# in ') THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END AS text FROM chunks),
w AS (SELECT chunk_id, list_transform(regexp_extract_all(regexp_replace(text, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda z: lower(z)) AS k FROM one),
t AS (SELECT * FROM w WHERE len(k) >= 40)"""
_RUNS_SQL = "list_distinct(list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]))"
#: All pairs through all shared shingles: for small tables.
FOUND_SQL = _TOKENS_SQL + f""",
s AS (SELECT chunk_id, {_RUNS_SQL} AS g FROM t),
e AS (SELECT chunk_id, len(g) AS n, unnest(g) AS x FROM s)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM e a JOIN e b ON a.x = b.x AND a.chunk_id < b.chunk_id
GROUP BY a.chunk_id, b.chunk_id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9
"""
_CLASSES_SQL = _TOKENS_SQL + f""",
cls AS (SELECT k, min(chunk_id) AS class_id, count(*) AS n_copies FROM t GROUP BY k),
m AS (SELECT t.chunk_id, c.class_id, c.n_copies FROM t JOIN cls c ON t.k = c.k),
s AS (SELECT class_id, {_RUNS_SQL} AS g FROM cls),
e AS (SELECT class_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.class_id AS class_a, b.class_id AS class_b, round(count(*) / (a.n + b.n - count(*)), 6) AS similarity FROM e a JOIN e b ON a.x = b.x AND a.class_id < b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9)"""
PAIRS_SQL = _CLASSES_SQL + " SELECT class_a, class_b, similarity FROM p"
MEMBERS_SQL = _CLASSES_SQL + " SELECT chunk_id, class_id FROM m"
LINKS_SQL = _CLASSES_SQL + """,
l AS (SELECT class_id, count(*) AS n_links FROM (SELECT class_a AS class_id FROM p UNION ALL SELECT class_b FROM p) GROUP BY class_id)
SELECT m.chunk_id, m.class_id, m.n_copies, coalesce(l.n_links, 0) AS n_links FROM m LEFT JOIN l USING (class_id) WHERE m.n_copies > 1 OR l.n_links IS NOT NULL"""
