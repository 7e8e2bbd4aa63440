"""SimHash near-duplicates: fingerprints, candidate blocks, bit-sliced comparison, components.

near_duplicates() links fingerprints of 64 bits within a few bits; their pieces make the blocks, so no pair is missed.
Texts that share 0.8 of their shingles differ in about ten of 64 bits, too many for such pieces: near_copies() takes
256 bits and a radius that hardly any such pair exceeds, in blocks of texts that share a band of least shingle hashes.
What that comparison links are candidates: of each group of them, the shingle sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from photonflow.llm.common import byte_rows, cut, discard, only, space_words
from photonflow.llm.components import connected_components

SHINGLE = 5
RADIUS = 4
#: Fingerprints compared in one tile of a block; larger blocks are dealt out as pairs of tiles.
TILE = 2048
#: Different fingerprints of an average block at most.
BLOCK = 64
#: Words of a wide fingerprint.
WIDE = 4
#: Differing bits of wide fingerprints within which pairs are candidates: texts that share 0.8 of their shingles differ in
#: 39 of 256 on average, and in more than 63 in one of ten thousand cases (one of 150 for texts of five shingles).
WIDE_RADIUS = 63
#: The least share of common shingles (of two texts' distinct ones) of a near copy.
ALIKE = 0.8
#: Bytes of shingle hashes that are verified together; larger groups are dealt out as pairs of tiles.
TILE_BYTES = 32 << 20
#: Bands and least hashes of a band: texts that share 0.8 of their shingles share none in one of 38,000 cases.
BANDS, BAND_ROWS = 20, 4
_ODD = np.random.default_rng(42).integers(0, 1 << 63, WIDE + BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of all word shingles, A-Z lowered, repeats included; of the whole sequence where words are fewer."""
    words = space_words(text.lower() if text else text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def _majority(parts: Iterator[np.ndarray], words: int) -> np.ndarray:
    """The bits that over half of the rows (uint64 words each) have set, as uint64 words."""
    ones, n = np.zeros(64 * words, np.int64), 0
    for part in parts:
        ones += np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of all word shingles, repeats included; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    return int(_majority((hashes[i : i + 4096] for i in range(0, len(hashes), 4096)), 1).view(np.int64)[0])


def wide_fingerprint(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """SimHash of 256 bits over distinct shingles, and the keys of the bands of their least hashes (none without words)."""
    if not len(hashes):
        return bytes(8 * WIDE), np.zeros(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, _ONES)
    parts = []
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 2048):
            part = hashes[i : i + 2048]
            least = np.minimum(least, (part[None, :] * _ODD[WIDE:, None]).min(axis=1))
            mixed = (part[:, None] ^ (part[:, None] >> np.uint64(31))) * _ODD[None, :WIDE]
            parts.append((mixed ^ (mixed >> np.uint64(29))) * _ODD[None, :WIDE])
            parts[-1] ^= parts[-1] >> np.uint64(32)
    bands = [xxhash.xxh3_64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return _majority(iter(parts), WIDE).tobytes(), np.array(bands, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (long). A null text has no words, hence fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, fingerprint(t, shingle)) for k, t in byte_rows(batch, "id", "text")]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["id", "fp"])

    docs = docs.select(F.col(f"`{id_col}`").try_cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs.mapInArrow(run, "id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """fps: a row of uint64 words for each fingerprint. Bit j of planes[b, k] is bit b of fingerprint 64k + j."""
    blocks, words = max(1, -(-len(fps) // 64)), fps.shape[1]
    lanes = np.zeros((blocks * 64, words), np.uint64)
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T).reshape(64 * words, blocks, 64), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(64 * words, blocks)


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter (lowest bit first) exceeds the radius."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], _ONES)
    for k, c in reversed(list(enumerate(counters))):
        if radius >> k & 1:
            same = same & c
        else:
            more |= same & c
            same = same & ~c
    return more


def close_lanes(planes: np.ndarray, query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes of each (query, block) lie within the radius: indices of the items that have any, and their lane masks.

    Two planes at a time go through a carry-save adder into vertical counter bits and a sticky overflow. Every eight
    planes, items all of whose lanes exceed the radius are abandoned.
    """
    left = np.arange(len(query))
    zero, one = np.uint64(0), np.uint64(1)
    counters = [np.zeros(len(query), np.uint64) for _ in range(max(1, radius.bit_length()))]
    lost = np.zeros(len(query), np.uint64)
    for b in range(0, len(planes), 2):
        word = query[:, b >> 6]
        x = planes[b][block] ^ (zero - ((word >> np.uint64(b & 63)) & one))
        y = planes[b + 1][block] ^ (zero - ((word >> np.uint64((b & 63) + 1)) & one))
        half = counters[0] ^ x
        carry = (counters[0] & x) | (y & half)
        counters[0] = half ^ y
        for k in range(1, len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        lost |= carry
        if b % 8 == 6:
            alive = lanes & ~(lost | _over(counters, radius))
            keep = alive != 0
            if b == len(planes) - 2:
                return left[keep], alive[keep]
            lanes = alive
            if keep.sum() * 4 < 3 * len(keep):
                left, query, block, lost, lanes = (v[keep] for v in (left, query, block, lost, lanes))
                counters = [c[keep] for c in counters]
            if not len(left):
                break
    return left, lanes


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of every a, b; parents point to the smallest lane at the end."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def close_pairs(fps: np.ndarray, ends: np.ndarray, radius: int, items_at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of lanes within the radius, some at a time, by their first lane. Fingerprints are laid out block by block
    (ends: where each lane's block ends); lanes of different blocks are no pair."""
    fps = fps.reshape(len(fps), -1)
    planes = bit_planes(fps)
    lane = np.arange(len(fps))
    first, last = (lane + 1) // 64, (ends - 1) // 64
    count = np.where(lane + 1 < ends, last - first + 1, 0)
    totals = np.cumsum(count)
    done = 0
    while done < len(fps):
        base = totals[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(totals, base + items_at_once, "right")))
        who = np.repeat(lane[done:stop], count[done:stop])
        if len(who):
            offset = np.arange(len(who)) - np.repeat(totals[done:stop] - count[done:stop] - base, count[done:stop])
            block = first[who] + offset
            low = np.maximum(who + 1, block * 64) - block * 64
            high = np.minimum(ends[who], block * 64 + 64) - block * 64
            lanes = (_ONES >> (64 - high).astype(np.uint64)) & (_ONES << low.astype(np.uint64))
            found, mask = close_lanes(planes, fps[who], block, lanes, radius)
            for i in range(0, len(found), 1 << 14):
                bits = np.unpackbits(mask[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                item, bit = np.nonzero(bits)
                at = found[i : i + (1 << 14)][item]
                yield who[at], block[at] * 64 + bit
        done = stop


def link_blocks(fps: np.ndarray, ends: np.ndarray, radius: int = RADIUS, items_at_once: int = 1 << 16) -> np.ndarray:
    """The root lane of each lane's tree of links; the layout is close_pairs()'."""
    parent = np.arange(len(fps))
    for a, b in close_pairs(fps, ends, radius, items_at_once):
        _unite(parent, a, b)
    return parent


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets of hashes share at least so much of all they have. Two empty sets do."""
    small, large = sorted((len(a), len(b)))
    if small < least * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both) - 1e-9


def verified(fps: np.ndarray, sets: list[np.ndarray], ends: np.ndarray, radius: int, least: float) -> tuple[list[int], list[int]]:
    """Pairs of lanes whose sets are alike, enough for their components. Pairs beyond the radius are not looked at, nor are
    those that other links have joined already."""
    parent = np.arange(len(fps))
    left: list[int] = []
    right: list[int] = []
    for a, b in close_pairs(fps, ends, radius):
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
        if not len(a):
            continue
        order = np.argsort(a, kind="stable")
        for lane, others in zip(np.unique(a).tolist(), np.split(b[order], np.flatnonzero(np.diff(a[order])) + 1), strict=True):
            others = others[parent[others] != parent[lane]]
            while len(others):
                other = int(others[0])
                if alike(sets[lane], sets[other], least):
                    left.append(lane)
                    right.append(other)
                    low, high = sorted((parent[lane], parent[other]))
                    parent[parent == high] = low
                    others = others[parent[others] != parent[lane]]
                else:
                    others = others[1:]
    return left, right


def _masks(parts: int, equal: int) -> list[int]:
    """Bit masks of every choice of `equal` of `parts` near-equal pieces of 64 bits, as signed longs."""
    at = [round(64 * i / parts) for i in range(parts + 1)]
    piece = [((1 << (at[i + 1] - at[i])) - 1) << at[i] for i in range(parts)]
    masks = [sum(piece[i] for i in pick) for pick in combinations(range(parts), equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE, equal: int | None = None) -> DataFrame:
    """classes: fp, rep, one row per fingerprint. Returns a, b: enough links for the components at this radius, all exact.

    64 bits are cut into radius + `equal` pieces; two fingerprints within the radius agree on `equal` of them at least, so every
    pair meets in the block of some choice of so many pieces. The more fingerprints there are, the more pieces a block takes, so that
    blocks of different fingerprints stay small: an average one has BLOCK of them at most (or 5 pieces, of 9 or more). A block of more than
    `tile` is dealt out as pairs of tiles, which keeps each task's work bounded and loses no pair.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius must be 0 to 6")
    if equal is None:
        n = classes.count()
        equal = next((k for k in range(2, 5) if n >> (64 * k // (radius + k)) <= BLOCK), 5)
    masks = F.array(*(F.struct(F.lit(i).alias("pick"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(_masks(radius + equal, equal))))
    return block_links(classes.select("fp", "rep", F.explode(masks).alias("key")).select("fp", "rep", "key.*"), radius, tile)


def band_links(classes: DataFrame, radius: int = WIDE_RADIUS, tile: int = TILE) -> DataFrame:
    """classes: fp (binary), rep, bands. Returns a, b: enough links for the components of those that share a band, all exact."""
    return block_links(classes.select("fp", "rep", F.posexplode("bands").alias("pick", "bits")), radius, tile)


def _dealt(rows: DataFrame, key: list[str], tiles: DataFrame) -> DataFrame:
    """rows of the keys in `tiles` with t1, t2: one pair a row, or where `tiles` is given, all pairs of tiles that have the row's
    own (by a hash of fp). Rows meet by key and tiles."""
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: t != own),
        lambda t: F.struct(F.least(t, own).alias("t1"), F.greatest(t, own).alias("t2")),
    )
    single = F.array(F.struct(F.lit(0).alias("t1"), F.lit(0).alias("t2")))
    dealt = rows.join(tiles, key).withColumn("t", F.explode(F.when(F.col("tiles").isNull(), single).otherwise(pairs)))
    # by the tiles too: the join's own partitioning would keep all tiles of a key in one task
    return dealt.select(*rows.columns, "t.*").repartition(*key, "t1", "t2")


def block_links(keys: DataFrame, radius: int, tile: int) -> DataFrame:
    """keys: fp, rep, and the block's pick and bits. Each block is compared whole, a large one as pairs of tiles."""
    tiles = F.when(F.col("count") > tile, F.ceil(F.col("count") / (tile / 2)).cast("int")).alias("tiles")
    shared = keys.groupBy("pick", "bits").count().where("count > 1").select("pick", "bits", tiles)
    blocks = _dealt(keys, ["pick", "bits"], shared).groupBy("pick", "bits", "t1", "t2").agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps")).where(F.size("fps") > 1).select("fps", "reps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                sizes = part.column("fps").value_lengths().to_numpy(zero_copy_only=False)
                fps = part.column("fps").flatten()
                if pa.types.is_int64(fps.type):
                    fps = fps.to_numpy(zero_copy_only=False).view(np.uint64)
                else:
                    fps = np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(len(fps), -1)
                reps = part.column("reps").flatten().to_numpy(zero_copy_only=False)
                root = link_blocks(fps, np.repeat(np.cumsum(sizes), sizes), radius)
                linked = root != np.arange(len(root))
                yield pa.record_batch([pa.array(reps[linked]), pa.array(reps[root[linked]])], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, fingerprint, component_id.

    Equal fingerprints form one class, represented by its smallest id; only classes are compared. Documents without
    words (null, empty or blank text) have fingerprint zero and link like any other. A row with a null id keeps its
    fingerprint and gets the component of its class, or null where the class has no id; it never represents others.
    Ids must be whole numbers; a string that is none counts as null. Repeated rows are returned as often as they came. An empty
    table gives no rows. Columns other than the two are not read. A very long text is hashed in one task, a shingle at a time.
    """
    marks = cut(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = marks.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    found = _members(marks, classes, connected_components(links(classes, radius)))
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(marks: DataFrame, classes: DataFrame, tied: DataFrame, key: str = "fp") -> DataFrame:
    """marks with the component_id of their class."""
    found = tied.withColumnRenamed("node", "rep")
    return marks.join(classes.join(found, "rep", "left").select(key, F.coalesce("component", "rep").alias("component_id")), key, "left")


def verified_links(members: DataFrame, radius: int = WIDE_RADIUS, least: float = ALIKE, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """members: grp, rep, fp, hashes (a sorted set's bytes). Returns a, b: pairs of one group whose sets are alike, enough
    for their components. A group of more than `tile` members or `tile_bytes` is dealt out as pairs of tiles."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.octet_length("hashes")).alias("bytes"))
    many = F.greatest(F.ceil(F.col("n") / (tile / 2)), F.ceil(F.col("bytes") / (tile_bytes / 2))).cast("int")
    tiles = sizes.select("grp", F.when((F.col("n") > tile) | (F.col("bytes") > tile_bytes), many).alias("tiles"))
    columns = ("fp", "rep", "hashes")
    groups = _dealt(members, ["grp"], tiles).groupBy("grp", "t1", "t2").agg(*(F.collect_list(c).alias(c) for c in columns)).where(F.size("fp") > 1).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, totals = 0, np.cumsum(batch.column("fp").value_lengths().to_numpy(zero_copy_only=False))
            while done < len(batch):
                stop = max(done + 1, int(np.searchsorted(totals, (totals[done - 1] if done else 0) + 4096, "right")))
                part = batch.slice(done, stop - done)
                counts = part.column("fp").value_lengths().to_numpy(zero_copy_only=False)
                fps = np.frombuffer(b"".join(part.column("fp").flatten().to_pylist()), np.uint64).reshape(counts.sum(), -1)
                sets = [np.frombuffer(x, np.uint64) for x in part.column("hashes").flatten().to_pylist()]
                reps = part.column("rep").flatten().to_numpy(zero_copy_only=False)
                a, b = verified(fps, sets, np.repeat(np.cumsum(counts), counts), radius, least)
                yield pa.record_batch([pa.array(reps[a], pa.int64()), pa.array(reps[b], pa.int64())], names=["a", "b"])
                done = stop

    return groups.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = WIDE_RADIUS, least: float = ALIKE) -> DataFrame:
    """One row per row of docs: id, fingerprint (64 hex digits), component_id: the smallest id reachable by links.

    Two texts link if they share `least` of their distinct shingles (A-Z lowered). Texts of equal sets form one class,
    that of texts without words among them; classes that share a band of least shingle hashes and whose fingerprints lie
    within the radius are candidates, and of each group of candidates all pairs within the radius are decided by their sets,
    but for those that other links have joined. Ids must be whole numbers (a string that is none counts as null). A row with a
    null id gets its class's component, or null where the class has no id; different texts of one id may share its links. Repeated rows are returned
    as often as they came; an empty table gives no rows. A very long text costs eight bytes a shingle.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in byte_rows(batch, "id", "text"):
                hashes = np.unique(shingle_hashes(text, shingle))
                rows.append((key, xxhash.xxh3_128_digest(hashes.tobytes()), *wide_fingerprint(hashes)))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["id", "same", "fp", "bands"])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows = [np.unique(shingle_hashes(text, shingle)) for _, text in byte_rows(part, "id", "text")]
                yield pa.record_batch([part.column("grp"), part.column("id"), pa.array([wide_fingerprint(h)[0] for h in rows], pa.binary()), pa.array([h.tobytes() for h in rows], pa.binary())], names=["grp", "rep", "fp", "hashes"])

    docs = docs.select(F.col(f"`{id_col}`").try_cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marks = cut(docs.mapInArrow(marked, "id long, same binary, fp binary, bands array<long>"), "simhash")
    classes = marks.where("id is not null").groupBy("same").agg(F.min("id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    groups = cut(connected_components(band_links(classes, radius)).select(F.col("node").alias("id"), F.col("component").alias("grp")), "groups")
    members = docs.join(groups, "id").mapInArrow(with_sets, "grp long, rep long, fp binary, hashes binary").dropDuplicates(["grp", "rep", "fp"])
    members = cut(members, "members")
    tied = connected_components(verified_links(members, radius, least))
    discard(members, groups)
    found = _members(marks.drop("bands"), classes, tied, "same")
    return found.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = WIDE_RADIUS, least: float = ALIKE) -> DataFrame:
    """docs without the documents whose component of near_copies() has a smaller id; rows with a null id stay, repeated rows of
    an id that stays too. An empty table stays empty; all columns are kept."""
    found = near_copies(only(docs, id_col, text_col), id_col, text_col, shingle, radius, least)
    # written, so that Spark knows the size of what is mostly a small table
    extra = cut(found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("id")).distinct(), "copies")
    return docs.join(extra, F.col(f"`{id_col}`").try_cast("long") == extra["id"], "left_anti")
