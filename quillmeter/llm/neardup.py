"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import WordHashes, connected_components, cut, gram_hashes, mixed, prepare

#: Documents, and shingles of all of them, that one verification task holds at most of one side.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8; A-Z lower-cased on wish."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a shorter sequence is one shingle, no word none."""
    if len(hashes) == 0:
        return hashes
    grams = gram_hashes(hashes, k) if len(hashes) >= k else gram_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(grams)


def _scatter(x: np.ndarray, first: int = 0x7FEB352D, second: int = 0x846CA68B) -> np.ndarray:
    """A permutation of the 32-bit integers; each pair of odd constants is one."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(first)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(second)
    return x ^ (x >> np.uint32(16))


def _place(x: np.ndarray) -> np.ndarray:
    """The initial permutation, another than that of the shifts."""
    return _scatter(x, 0x21F0AAAD, 0xD35A2D97)


def circulant_signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """`size` MinHash values from two permutations of a 32-bit universe.

    The first scatters the shingles once. The second is shifted circularly by one place for each
    further value: value k is the least image of (place + k) modulo the universe.
    """
    places = _place((shingles >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 1024):
        np.minimum(least, _scatter(places[None, at : at + 1024] + shifts).min(1), out=least)
    return least


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band of `rows` values, different bands never alike by intent."""
    bands = signature.reshape(-1, rows).astype(np.uint64)
    keys = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for column in bands.T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set_key, bands) of whole texts; set_key is a 128-bit digest of the set, null for an empty one."""
    prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, keys, found = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(hashes.of(words_of(text)), k)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                found.append(band_keys(circulant_signature(s, bands * rows), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_key", "bands"])

    return docs.select(id_col, text_col).mapInArrow(run, "id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def linked_in_group(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(id, smallest id of its part) for documents joined by pairs with 100 * intersection >= percent * union.

    Each document meets, through the lists of the shingles it has, all others of the group; pairs
    that are joined already are known. Counts are exact, over full sets.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    posting = owner[order]
    begin = np.concatenate([[0], np.cumsum(df)[:-1]])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    part = np.arange(n)
    for x in range(n):
        mine = column[starts[x] : starts[x + 1]]
        mine = mine[df[mine] > 1]
        if not len(mine):
            continue
        lengths = df[mine]
        at = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[at], minlength=n)
        near = 100 * both >= percent * (sizes[x] + sizes - both)
        near[x] = True
        parts = np.unique(part[near])
        if len(parts) > 1:
            part[np.isin(part, parts)] = parts[0]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, part, ids)
    return [(int(i), int(least[p])) for i, p in zip(ids, part, strict=True) if i != least[p]]


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, bands: int = 24, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): classes of documents joined by near-equal shingle sets.

    Sets come from whole texts. Documents with the same set are one class from the start, so copies
    are never compared. Of distinct sets, those that share a band of their circulant signature (24
    bands of 4 values: a pair of similarity 0.8 is missed with probability 3e-6) are candidates;
    a star a bucket joins them to families, whose documents travel once each. Families of bounded
    size are verified whole in one task; of a larger one, each bucket is, in pairs of blocks with
    a bounded number of documents and shingles. Verified links come back as stars too, and
    components are found by contraction. No pair of a group is a row anywhere.

    Empty sets link with nothing. Rows without an id keep their class's component_id (null if no
    member has an id) and are kept only if it is null; they join nothing themselves, so documents
    that only such a row lies between stay apart. Rows that repeat an id share its fate. An
    empty table gives no rows; other columns are not read.
    """
    spark = prepare(docs)
    sk = cut(sketches(docs, k, bands, rows, id_col, text_col))
    full = sk.where("n_shingles > 0 and id is not null")
    reps = cut(full.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    keyed = reps.select(F.explode("bands").alias("key"), "rep", "n")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).where("size > 1")
    shared = cut(keyed.join(shared, "key").select("key", "rep", "n", "hub"))
    family = connected_components(shared.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    member = cut(family.join(shared.select(F.col("rep").alias("id"), "n").distinct(), "id").select(F.col("id").alias("rep"), F.col("component").alias("family"), "n"))
    size = member.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    member = member.join(size.where("docs > 1"), "family")
    small = (F.col("docs") <= 2 * BLOCK_DOCS) & (F.col("shingles") <= 2 * BLOCK_SHINGLES)
    whole = member.where(small).select(F.col("family").alias("gid"), F.lit(0).alias("kind"), "rep", "n")
    large = member.where(~small).select("rep", "n")
    split = shared.select("key", "rep").join(large, "rep").select(F.col("key").alias("gid"), F.lit(1).alias("kind"), "rep", "n")
    groups = cut(whole.unionByName(split))
    sums = groups.groupBy("gid", "kind").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    sums = sums.select("gid", "kind", F.when(F.col("kind") == 0, F.lit(1)).otherwise(F.when(F.col("docs") <= 2 * BLOCK_DOCS, F.ceil(F.col("shingles") / (2 * BLOCK_SHINGLES))).otherwise(blocks)).cast("int").alias("blocks"))
    # only groups of several blocks are looked up; they are few, as each fills its blocks
    placed = groups.join(sums.where("blocks > 1"), ["gid", "kind"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.select("gid", "kind", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("gid", "kind", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    loaded = placed.join(texts, "rep").select("gid", "kind", "i", "j", "rep", "text")

    def verify(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        seen: dict[tuple[int, bytes], np.ndarray] = {}
        for batch in table.to_batches():
            for rep, text in zip(batch.column("rep").to_pylist(), batch.column("text").to_pylist(), strict=True):
                one = shingle_set(hashes.of(words_of(text)), k)
                if len(one):
                    seen[rep, xxhash.xxh3_128_digest(one.tobytes())] = one
        ids = np.array([i for i, _ in seen], np.int64)
        links = linked_in_group(ids, list(seen.values()), percent) if len(ids) > 1 else []
        a, b = zip(*links, strict=True) if links else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = loaded.groupBy("gid", "kind", "i", "j").applyInArrow(verify, "a bigint, b bigint")
    parts = connected_components(links)
    classes = reps.join(parts, reps.rep == parts.id, "left").select(F.col("set_key").alias("class_key"), F.coalesce("component", "rep").alias("component_id"))
    out = sk.join(classes, sk.set_key == classes.class_key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
