"""Near-duplicate groups by SimHash, with candidate keys from the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import map_arrow, partitions, read, stored
from corpuslens.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Shingle hashes whose bits are counted at a time, so that a very long text needs bounded memory.
BLOCK = 1 << 14

#: Generator polynomial of the perfect binary Golay code of length 23 (fixed value).
GENERATOR = 0b110001110101
#: The fingerprint's segments as (shift, bits); each is padded with zeros to 23 bits.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Values whose keys are made at a time; each has about 119.
KEYED = 1024
#: Values of a key up to which all its pairs are looked at.
FEW = 8
#: Values of a key that a task holds at most (8 bytes each).
MOST_HELD = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash; 0 without words, the hash of all words where there are fewer than a shingle has."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: 1 - SHINGLE_WORDS].tolist()
    ends = ends[SHINGLE_WORDS - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest, seed = xxhash.xxh64_digest, SEED
    for at in range(0, len(starts), BLOCK):
        block = b"".join([digest(joined[i:j], seed) for i, j in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)])
        counts += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])


def _fingerprints_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
        row = batch.column(2)
        yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), *(row.field(n) for n in range(3))], names=["fp", "unnamed", "id", "hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is the SimHash as a signed long."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _fingerprints, "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ GENERATOR << (bit - 11), words)
    return words


def coset_table(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of at most radius bits: (starts, patterns), patterns in the order of syndromes."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(23), n)], np.int64)
    syndromes = _syndromes(patterns)
    order = np.argsort(syndromes, kind="stable")
    return np.searchsorted(syndromes[order], np.arange(2049)), patterns[order]


def codeword_indices(words: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, indices): for each word the 12-bit indices of the codewords that differ from it by a pattern of table."""
    starts, patterns = table
    syndromes = _syndromes(words)
    many = starts[syndromes + 1] - starts[syndromes]
    rows = np.repeat(np.arange(len(words)), many)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[syndromes], many)
    return rows, (words[rows] ^ patterns[place]) >> 11


def golay_keys(fps: np.ndarray, nearest, near) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): the keys of each value; values that differ in at most MAX_BITS bits share one.

    At most four bits differ over three segments. If one segment is equal, another differs by two bits at most: the key is
    the equal segment with every codeword within 4 bits of the other, as words 2 bits apart have a word between them
    whose nearest codeword (within 3) lies within 4 of both. Else two segments differ by one bit each and the third by one or two: the key is the
    nearest codeword of the one with all within 4 bits of the other, or the reverse (the nearest codeword of either word lies
    within 4 bits of both), and one of three pieces of the third segment, of which at least one is equal. Keys have 31 to 34 bits
    besides their family, so that values that are no copies rarely share one.
    """
    parts = [(fps >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1) for shift, bits in SEGMENTS]
    one = [codeword_indices(p, nearest)[1] for p in parts]
    all_near = [codeword_indices(p, near) for p in parts]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for family, (i, j) in enumerate(permutations(range(3), 2)):
        rows, index = all_near[j]
        out.append((rows, family << 40 | parts[i][rows] << 12 | index))
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        rows, index = all_near[j]
        other, reverse = all_near[i]
        new = reverse != one[i][other]  # the nearest codewords of both are among the first already
        other, reverse = other[new], reverse[new]
        rows, keys = np.concatenate([rows, other]), np.concatenate([one[i][rows] << 12 | index, reverse << 12 | one[j][other]])
        third = parts[3 - i - j][rows]
        for piece in range(3):
            out.append((rows, (6 + 3 * pair + piece) << 40 | keys << 8 | (third >> 7 * piece & (0xFF if piece == 2 else 0x7F))))
    return np.concatenate([r for r, _ in out]), np.concatenate([k for _, k in out])


def exact_keys(fps: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of another kind, one array for each choice of 12 of the 16 half bytes: values that differ in at most four bits agree in such a choice.

    Only 16 bits are free among the values of a key, so it has at most 65,536 of them, however many rows there are.
    """
    halves = [fps >> np.uint64(4 * n) & np.uint64(15) for n in range(16)]
    for choice, left in enumerate(combinations(range(16), MAX_BITS)):
        key = np.full(len(fps), choice, np.uint64)
        for n in range(16):
            if n not in left:
                key = key << np.uint64(4) | halves[n]
        yield key.view(np.int64)


def _golay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nearest, near = coset_table(3), coset_table(4)
    for batch in batches:
        every = batch.column(0).to_numpy()
        for at in range(0, len(every), KEYED):
            fps = every[at : at + KEYED]
            rows, keys = golay_keys(fps.view(np.uint64), nearest, near)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for keys in exact_keys(fps.view(np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], names=["key", "fp"])


def spanning(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of distinct values that link within MAX_BITS bits: fewer edges than values.

    Each reached value is compared with those not reached yet, so a dense group costs little more than its size.
    """
    rest, a, b = values, [], []
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = np.bitwise_count(rest ^ x) <= MAX_BITS
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                reached.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


def _edges(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among the values of each key; rows are sorted by key and whole keys."""
    borders = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = np.concatenate([[0], borders])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    a, b = [], []
    of_row = np.repeat(sizes, sizes)
    few = (of_row > 1) & (of_row <= FEW)
    k, v = keys[few], values[few]
    for step in range(1, min(FEW, len(k))):  # all pairs of the small keys, at most FEW - 1 rows a value
        near = np.flatnonzero((k[step:] == k[:-step]) & (np.bitwise_count(v[step:] ^ v[:-step]) <= MAX_BITS))
        a.append(v[near])
        b.append(v[near + step])
    for at in np.flatnonzero(sizes > FEW):
        x, y = spanning(values[starts[at] : starts[at] + sizes[at]])
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


def _forest(most: int):
    """Sorted rows (key, fp) to edges (a, b). A key with more than most values is not held: its values come out as (fp, fp), to be linked by exact_keys()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        dense: int | None = None

        def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if dense is not None:
                same = int(np.searchsorted(k, dense, "right"))
                yield told(v[:same], v[:same])
                k, v = k[same:], v[same:]
            if not len(k):
                continue
            dense = None
            k, v = np.concatenate([held_k, k]), np.concatenate([held_v, v])
            last = int(np.searchsorted(k, k[-1]))
            if last:
                yield told(*_edges(k[:last], v[:last]))
            held_k, held_v = k[last:], v[last:]
            if len(held_v) > most:
                dense = int(held_k[-1])
                yield told(held_v, held_v)
                held_k, held_v = held_k[:0], held_v[:0]
        if len(held_k):
            yield told(*_edges(held_k, held_v))

    return run


def _linked(values: DataFrame, keys, most: int) -> DataFrame:
    keyed = map_arrow(values, keys, "key long, fp long")
    return map_arrow(keyed.repartition("key").sortWithinPartitions("key", "fp"), _forest(most), "a long, b long")


def links(fps: DataFrame, most: int = MOST_HELD) -> DataFrame:
    """(a, b), a < b: pairs of different values of fp within MAX_BITS bits whose components are those of all such pairs.

    Rows are sorted by key and each key's values joined by a spanning forest: no pairs are made, and a key gives fewer
    edges than it has values. A task holds one key's values at a time, at most `most`; those of a key with more (a very large group of near
    copies) get exact_keys() instead, none of which can hold more than 65,536.
    """
    values = fps.select("fp").distinct()
    # Dealt out evenly: each value makes 119 rows, so that few bytes are much work.
    found = stored(_linked(values.repartition(partitions(fps.sparkSession)), _golay, most).distinct(), "simhash-found")
    edges, dense = found.where("a < b"), found.where("a = b").select(F.col("a").alias("fp"))
    if not dense.limit(1).count():
        return edges
    return edges.unionByName(_linked(dense.repartition(partitions(fps.sparkSession)), _exact, 1 << 16)).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs, which needs doc_id and text; other columns are ignored.

    Null and empty texts and texts of white space have fingerprint 0 and link like any other. Equal texts have equal
    fingerprints. Repeated rows stay. A null doc_id never names a component; if it stands alone, component_id is null.
    An empty table gives an empty result. Copies are joined by fingerprint, so a group of copies makes no pairs.
    """
    fps = stored(fingerprints(docs), "simhash")
    named = _rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), fps)
    least_of_root = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_fp = stored(named.join(least_of_root, "root").select("fp", "component_id"), "simhash-components")
    return fps.join(of_fp, "fp")


def _rooted(by_fp: DataFrame, fps: DataFrame) -> DataFrame:
    """by_fp, which has a row per fp, with root: the least fp of the component."""
    roots = components(links(fps), "simhash-links")
    return stored(by_fp.join(roots, by_fp.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node"), "simhash-roots")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component one row stays, with all its columns.

    That is the row of the least doc_id; of rows that share it the one of least fingerprint, then of least text hash. Rows without doc_id come after
    all others: such a row stays only if no row of its component has a doc_id, and then it is the one of least fingerprint and hash. Of repeated
    rows one stays. Two rows of one doc_id stay both if their components differ and both are led by it. Null and empty
    texts are copies of each other. Extra columns may have any name that doesn't start with '_simhash'. An empty table gives no rows.
    Which rows stay is settled on ids and hashes alone, so texts are shuffled once.
    """
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    prints = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row.alias("row")), _fingerprints_of_rows, "fp long, unnamed boolean, id long, hash long")
    fps = stored(prints, "simhash")
    first = F.min(F.struct("unnamed", "id", "fp", "hash"))
    named = _rooted(fps.groupBy("fp").agg(first.alias("first")), fps)
    heads = stored(named.groupBy("root").agg(F.min("first").alias("head")).select("head.*"), "simhash-heads")
    heads = heads.select(F.col("unnamed").alias("_simhash_unnamed"), F.col("id").alias("_simhash_id"), F.col("hash").alias("_simhash_hash"))
    keys = heads.columns
    told = docs.select("*", *[row[c].alias(k) for c, k in zip(("unnamed", "id", "hash"), keys, strict=True)])
    # The heads grow with the corpus: they are shuffled at every size, not broadcast while they happen to be few.
    kept = told.join(heads.hint("merge"), keys, "left_semi")
    order = Window.partitionBy(*keys).orderBy("_simhash_hash")
    return kept.withColumn("_simhash_row", F.row_number().over(order)).where("_simhash_row = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE: dict[str, str] = {}
