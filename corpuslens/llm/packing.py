"""Cost-balanced packing of documents into token sequences."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.common import map_arrow, read

SEQUENCE_TOKENS = 2048
END_ID = 1
#: Tokens that a task packs at a time (a longer document makes a longer block).
BLOCK_TOKENS = 4_000_000
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention within the piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Bytes of chunks and their ids that a worker remembers at a time, and of a chunk that is worth it.
REMEMBERED, WORTH = 32 << 20, 256
_ODD_SPACE = re.compile(r"\s ")


class Encoder:
    """Ids of a byte-level BPE vocabulary for whole texts; special tokens in a text are ordinary text.

    A token never spans the border before a space that follows a character other than white space, so texts
    are cut there and equal chunks are encoded once. Texts with white space before a space are encoded whole.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from public_tokenizers import PATTERN

        if vocabulary.endswith(".tiktoken"):
            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        else:
            ranks = _ranks(json.load(open(vocabulary, encoding="utf-8")))
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _chunk(self, chunk: str) -> bytes:
        ids = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= WORTH:
            if self.held >= REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[chunk] = ids
            self.held += 250 + 4 * len(chunk) + len(ids)  # with what Python adds to a string, bytes and a dictionary's entry
        return ids

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if _ODD_SPACE.search(text) or text[0] == " ":
            return np.array(self.encode(text), "<u4").tobytes()
        first, *chunks = text.split(" ")
        if chunks and not chunks[-1]:  # a space at the end stands alone
            return np.array(self.encode(text), "<u4").tobytes()
        get, make = self.known.get, self._chunk
        return np.array(self.encode(first), "<u4").tobytes() + b"".join([get(c) or make(c) for c in chunks])


def _ranks(spec: dict) -> dict[bytes, int]:
    """Byte strings by rank from a vocabulary file that writes each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}


def capacities(tokens: int, most: int = SEQUENCE_TOKENS) -> list[int]:
    """Sequence lengths that hold all tokens exactly: full ones, then the rest as powers of two, which need no padding."""
    full, rest = divmod(tokens, most)
    return [most] * full + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], most: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; every sequence is full.

    Whole sequences are cut off long documents first. The rest, longest first, goes to the sequence of lowest
    cost with room for it; where none has room it fills the roomiest one and goes on with what is left.
    """
    pieces, sequence = [], 0
    rests = []
    for d, n in enumerate(lengths):
        full = n // most
        for k in range(full):
            pieces.append((d, k * most, most, sequence, 0))
            sequence += 1
        if n % most:
            rests.append((n % most, d, full * most))
    size = np.array(capacities(sum(n for n, _, _ in rests), most), np.int64)
    room = size.copy()
    cost = np.zeros(len(size))
    for n, d, start in sorted(rests, key=lambda x: (-x[0], x[1])):
        while n:
            fits = room >= n
            at = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            put = int(min(n, room[at]))
            pieces.append((d, start, put, sequence + at, int(size[at] - room[at])))
            room[at] -= put
            cost[at] += LINEAR * put + QUADRATIC * put * put
            n, start = n - put, start + put
    return pieces


def _packed(vocabulary: str, end_id: int, most: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        base, block, held, sequences = TaskContext.get().partitionId() << 40, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, held, sequences
            # Sorted here, so that the order in which rows arrive within a block doesn't matter.
            block.sort(key=lambda x: (-len(x[1]), x[0] is not None, x[0] or 0, x[1]))
            pieces = assign([len(ids) // 4 for _, ids in block], most)
            for at in range(0, len(pieces), 50_000):
                part = pieces[at : at + 50_000]
                cut = [block[d][1][4 * s : 4 * (s + n)] for d, s, n, _, _ in part]
                cols = {
                    "doc_id": pa.array([block[p[0]][0] for p in part], pa.int64()),
                    "start": pa.array([p[1] for p in part], pa.int64()),
                    "length": pa.array([p[2] for p in part], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                    "doc_tokens": pa.array([len(block[p[0]][1]) // 4 for p in part], pa.int64()),
                    "sequence_id": pa.array([base + sequences + p[3] for p in part], pa.int64()),
                    "offset": pa.array([p[4] for p in part], pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)
            sequences += max((p[3] + 1 for p in pieces), default=0)
            block, held = [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                block.append((doc_id, ids))
                held += len(ids) // 4
                if held >= BLOCK_TOKENS:
                    yield from flush()
        if block:
            yield from flush()

    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, most: int = SEQUENCE_TOKENS, with_ids: bool = True) -> DataFrame:
    """A row per piece of docs (doc_id, text): PIECE, and the piece's ids if with_ids.

    Documents are packed where they are read, block by block, without a shuffle; a sequence's id holds its input
    partition, so sequences follow how the input is dealt out. Null and empty texts give the end id alone, repeated rows are packed each, ties go by
    doc_id, an empty table gives no rows, other columns are ignored. Every sequence is full, so no padding is left.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, _packed(vocabulary, end_id, most, with_ids), PIECE + ", ids array<int>" * with_ids)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


QUERIES = {"op3_packing": op3_packing}
ORACLE: dict[str, str] = {}
