"""Problem 7: the same or nearly the same records in training and evaluation periods.

Fingerprint. A text is its multiset of words; each (word, occurrence) is a 64-bit
token. The fingerprint has segments of 64 bits, and each token flips the bits of its
hash in the one segment that its hash selects. Texts that share at least the share
``s`` of the words of the longer differ in at most ``r = 2 floor((1 - s) n)`` tokens
for n words, which is the Hamming radius in segments. Six segments make a group, and
there is one group more than r holds fives: so in one group at most four segments
differ, and two agree. The number of segments grows with the length of texts, about
a quarter of their words; lengths are put in bands so that both texts are cut into
the same segments, and the evaluation side is cut for each band that its partners
may have.

Code blocks. A segment is a block of its own if its words are rare enough: the
corpus frequencies of its tokens tell how many texts would share it by chance.
Segments that hold only common words, or nothing, are blocks in pairs of a group.
Two texts within the radius agree in two segments of a group, so in a rare one or in
a pair of common ones: nothing is lost, and no block is one that most texts share. A
second filter needs no join: one more word of 64 bits flips one bit per token, and
codes farther apart than the radius leave. Whatever remains is checked on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.formatting import _encode
from deskloom.llm.lookalike import bare_sql, form_sql, run_sql
from deskloom.runtime import cut, small

#: Entries of the word-frequency sketch; its size doesn't depend on the data.
SKETCH_BITS = 18
SHARE = 0.9
#: Segments of a group, and texts that may share a block of one segment by chance.
GROUP, CHANCE = 6, 16.0


def band_edges(share: float, longest: int) -> np.ndarray:
    """Least lengths of the bands: texts within ``share`` of each other are in the same or in neighbouring bands."""
    edges = [1]
    while edges[-1] <= longest:
        edges.append(max(edges[-1] + 1, -int(-edges[-1] / share // 1)))
    return np.array([*edges, max(edges[-1] + 1, -int(-edges[-1] / share // 1)), 1 << 62])


def segments_of(band: np.ndarray, edges: np.ndarray, share: float) -> np.ndarray:
    """Segments of a band, none where texts within ``share`` can't differ."""
    longest = edges[np.minimum(band + 2, len(edges) - 2)] - 1
    radius = 2 * np.floor((1 - share) * longest + 1e-9).astype(np.int64)
    return np.where(radius > 0, GROUP * (radius // (GROUP - 1) + 1), 0)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, sorted within each text, and the offsets of texts. Repeats of a word get different tokens."""
    words = pa.compute.split_pattern(pa.compute.fill_null(texts, ""), " ")
    offsets = words.offsets.to_numpy()
    flat = words.values.dictionary_encode()
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()] or [0], np.uint64)
    h = hashed[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(fresh)
    nth = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    h = h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # wraps
    order = np.lexsort((h, row))
    return h[order], offsets


def _fingerprints(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    odd = np.bincount(row * 64 + (tokens & np.uint64(63)).astype(np.int64), minlength=rows * 64) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, 64), axis=1, bitorder="little").view("<u8").ravel()


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        same = next(_encode(iter([batch.select(["k", "text"])]))).column("entries").to_pylist()
        record = pa.array([None if e is None else xxhash.xxh3_128_digest(b"".join(sorted(e))) for e in same], pa.binary())
        bare = run_sql(batch.select(["text"]), f"SELECT {bare_sql(form_sql('text'))} AS v FROM batch").column("v").combine_chunks()
        if isinstance(bare, pa.ChunkedArray):
            bare = bare.combine_chunks()
        tokens, offsets = tokens_of(bare)
        prints = _fingerprints(tokens, offsets)
        data = tokens.view(np.int64)
        digests = [xxhash.xxh3_128_digest(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        wording, code = pa.array(digests, pa.binary()), pa.array(np.frombuffer(b"".join(d[:8] for d in digests), np.int64))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(data))
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("side"), record, wording, code, pa.array(np.diff(offsets), pa.int32()), pa.array(prints.view(np.int64)), lists], ["k", "side", "record", "wording", "code", "n", "print", "tokens"])


def _sketch(tokens: DataFrame) -> np.ndarray:
    """How often each of 2^SKETCH_BITS classes of tokens occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            flat = pa.compute.list_flatten(batch.column("tokens")).to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "times"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    counts = tokens.select("tokens").mapInArrow(count, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    out[counts.column("slot").to_numpy()] = counts.column("times").to_numpy()
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Tokens with all bits mixed, so that segment and bits don't depend on each other."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def block_codes(flat: np.ndarray, n: np.ndarray, band: np.ndarray, rarity: np.ndarray, edges: np.ndarray, share: float, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """``(code, text)`` of all blocks of texts with ``n`` tokens each in ``flat``, cut as texts of ``band``.

    ``rarity`` is minus the binary logarithm of each token's share of texts, in whole
    1/1024: a sum that doesn't depend on the order of tokens.
    """
    segments = segments_of(band, edges, share)
    start = np.concatenate([[0], np.cumsum(segments)])
    row = np.repeat(np.arange(len(n)), n)
    some = segments[row] > 0
    flat, rarity, row = flat[some], rarity[some], row[some]
    mixed = _mixed(flat)
    at = start[row] + ((mixed >> np.uint64(40)) % segments[row].astype(np.uint64)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, mixed, rare = at[order], mixed[order], rarity[order]
    bits, weight = np.zeros(start[-1], np.uint64), np.zeros(start[-1], np.int64)
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        bits[at[first]] = np.bitwise_xor.reduceat(mixed * np.uint64(0xC2B2AE3D27D4EB4F), first)
        weight[at[first]] = np.add.reduceat(rare, first)
    owner = np.repeat(np.arange(len(n)), segments)
    place = np.arange(start[-1]) - start[owner]
    code = _mixed(bits ^ _mixed((band[owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1)))
    alone = weight >= 1024 * np.log2(max(texts / CHANCE, 1.0))
    common = np.flatnonzero(~alone)
    # pairs of common segments of one group; every text has whole groups
    of = common // GROUP
    many = np.bincount(of, minlength=start[-1] // GROUP)
    left = np.repeat(np.arange(len(common)), (np.cumsum(many)[of] - 1 - np.arange(len(common))))
    run = np.arange(len(left)) - np.repeat(np.searchsorted(left, np.arange(len(common))), np.bincount(left, minlength=len(common)))
    right = left + 1 + run
    pairs = _mixed(code[common[left]]) ^ code[common[right]]
    return np.concatenate([code[alone], pairs]).view(np.int64), np.concatenate([owner[alone], owner[common[left]]])


def _blocks(rows: DataFrame, often: np.ndarray, share: float, texts: int, *, wide: bool) -> DataFrame:
    """``block, code, n, print`` of every wording, once for each batch; ``wide`` cuts it for all bands of its partners."""
    rarity = (1024 * np.log2(max(texts, 1) / np.clip(often, 1, max(texts, 1)))).astype(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                _, keep = np.unique(batch.column("code").to_numpy(), return_index=True)
                batch = batch.take(pa.array(keep))
                n = np.asarray(batch.column("n")).astype(np.int64)
                flat = pa.compute.list_flatten(batch.column("tokens")).to_numpy(zero_copy_only=False).view(np.uint64)
                rare = rarity[(flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                edges = band_edges(share, int(n.max()) * 2)
                least = np.ceil(share * n - 1e-9).astype(np.int64) if wide else n
                most = np.floor(n / share + 1e-9).astype(np.int64) if wide else n
                low, high = (np.searchsorted(edges, x, side="right") - 1 for x in (least, most))
                for step in range(int((high - low).max()) + 1):
                    some = np.flatnonzero(low + step <= high)
                    mask = np.zeros(len(n), bool)
                    mask[some] = True
                    mine = np.repeat(mask, n)
                    block, of = block_codes(flat[mine], n[some], low[some] + step, rare[mine], edges, share, texts)
                    at = pa.array(some[of])
                    yield pa.RecordBatch.from_arrays([pa.array(block), *(batch.column(c).take(at) for c in ("code", "n", "print"))], ["block", "code", "n", "print"])

    return rows.select("code", "n", "print", "tokens").mapInArrow(each, "block long, code long, n int, print long")


def _near(share: float) -> Column:
    most = F.greatest("a.n", "b.n")
    return (F.least("a.n", "b.n") >= share * most - 1e-9) & (F.bit_count(F.col("a.print").bitwiseXOR(F.col("b.print"))) <= F.floor(2 * (most - F.ceil(share * most - 1e-9))))


def cross_split_pairs(df: DataFrame, *, key: str, text: str, side: str, share: float = SHARE) -> DataFrame:
    """``a_id, b_id, same``: rows of side ``a`` and ``b`` that are the same or share ``share`` of the longer's words.

    ``side`` holds "a" or "b"; other rows, null keys, null and blank texts make
    no pair, and a key is never paired with itself. ``same`` is true for records
    that differ at most in formatting. Candidates are found between distinct
    wordings, so copies meet only in the result; blocks carry 64-bit codes of
    wordings, and whatever shares a code is checked. Side ``b`` has up to three
    times the blocks of ``a`` and should be the smaller one.
    """
    picked = df.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(side).alias("side")).where("k IS NOT NULL AND text IS NOT NULL AND side IN ('a', 'b')")
    rows = cut(picked.mapInArrow(_tokenise, "k string, side string, record binary, wording binary, code long, n int, print long, tokens array<long>").where("record IS NOT NULL"))
    often, texts = _sketch(rows), rows.count()
    a, b = (_blocks(rows.where(f"side = '{x}'"), often, share, texts, wide=x == "b").alias(x) for x in "ab")
    near = a.join(b, (F.col("a.block") == F.col("b.block")) & _near(share)).select(F.col("a.code").alias("ca"), F.col("b.code").alias("cb")).where("ca <> cb").distinct()
    near = cut(near)
    some = near.select(F.col("ca").alias("code")).union(near.select("cb")).distinct()
    full = rows.join(some, "code", "left_semi").groupBy("code", "wording").agg(F.first("tokens").alias("tokens"))
    ta, tb = (full.select(F.col("code").alias(f"c{x}"), F.col("wording").alias(f"w{x}"), F.col("tokens").alias(f"t{x}")) for x in "ab")
    common = F.size(F.array_intersect("ta", "tb"))
    alike = near.join(ta, "ca").join(tb, "cb").where(common >= share * F.greatest(F.size("ta"), F.size("tb")) - 1e-9).select("wa", "wb")
    ids = rows.select("k", "side", "record", "wording").distinct()
    left = ids.where("side = 'a'").select(F.col("k").alias("a_id"), F.col("record").alias("ra"), F.col("wording").alias("wa"))
    right = ids.where("side = 'b'").select(F.col("k").alias("b_id"), F.col("record").alias("rb"), F.col("wording").alias("wb"))
    worded = left.join(right, F.col("wa") == F.col("wb"))
    formed = left.join(right, F.col("ra") == F.col("rb"))
    nearly = left.join(alike, "wa").join(right, "wb")
    out = worded.select("a_id", "b_id", (F.col("ra") == F.col("rb")).alias("same"))
    out = out.union(formed.select("a_id", "b_id", F.lit(True))).union(nearly.select("a_id", "b_id", (F.col("ra") == F.col("rb"))))
    return out.where("a_id <> b_id").groupBy("a_id", "b_id").agg(F.max("same").alias("same"))


def with_split(episodes: DataFrame, splits: DataFrame) -> DataFrame:
    """Add ``split_name`` and ``side`` ("a" training, "b" evaluation) by ``created_at``; undated rows and rows outside every period leave.

    ``splits`` is a table of fixed size, broadcast if it is small. Columns of those
    two names in ``episodes`` are replaced.
    """
    side = F.when(F.col("purpose") == "training", "a").otherwise("b")
    periods = small(splits.select(F.struct(F.col("split_name").alias("name"), side.alias("side"), F.col("starts_at").alias("lo"), F.col("ends_at").alias("hi")).alias("_period")))
    own = [c for c in episodes.columns if c not in ("split_name", "side")]
    x = episodes.select(*own).join(periods, (F.col("created_at") >= F.col("_period.lo")) & (F.col("created_at") < F.col("_period.hi")))
    return x.select(*own, F.col("_period.name").alias("split_name"), F.col("_period.side").alias("side"))
