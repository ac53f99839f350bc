"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, ship, single_threaded, slices, stage

CAPACITY = 2048
END_ID = 0
#: Pieces that one packer places; many more add little to how full its sequences are.
PIECES_PER_PACKER = 20_000
MARK = "<|endoftext|>"
OTHER = re.compile("[^\t\n\r\x20-\x7E¡-ſ]")


class Encoder:
    """Ids of the byte-level tokenizer in ``path`` (a tokenizers file).

    Where the folder has the same vocabulary as ranks (``.tiktoken``), texts are encoded by that, about four times
    as fast and with the same ids; texts with the special token's string, with characters on whose class the two
    libraries' Unicode tables might differ, or with very long words go to tokenizers.
    """

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            # Fixed value: the tokenizer's pattern of words.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or MARK in text or OTHER.search(text) or _long_run(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _long_run(text: str, size: int = 1000) -> bool:
    """Whether a stretch of ``size`` characters, from a multiple of it, isn't broken by white space inside."""
    return any(len(text[p : p + size].split(None, 1)) < 2 for p in range(0, len(text) - size + 1, size))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones from the end, so that only the first may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece.

    Pieces are placed by falling length (ties: as they come). A piece goes where the sum over gaps of the squared
    number of open sequences with that gap becomes smallest: into a sequence of some gap, or a new one; on
    ties into the tightest. Full sequences are closed and don't count.
    """
    lengths = np.asarray(lengths, np.int64)
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    order = np.argsort(-lengths, kind="stable")
    whole = int(np.count_nonzero(lengths >= capacity))
    where[order[:whole]], offset[order[:whole]] = np.arange(whole), 0
    used = whole
    for i in order[whole:].tolist():
        size = int(lengths[i])
        before = counts[size:capacity]
        rise = 2 * counts[: capacity - size] + 1
        rise[0] = 0
        rise = rise - 2 * before + 1
        rise[before == 0] = np.iinfo(np.int64).max
        best = int(rise.argmin()) if len(rise) else 0
        if len(rise) and before[best] and rise[best] <= 2 * counts[capacity - size] + 1:
            gap = size + best
            k = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, k = capacity, used
            used += 1
        where[i], offset[i] = k, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            open_at[gap - size].append(k)
    return where, offset


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", 2 * SLICE_BYTES):
                out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for key, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(body or ""), END_ID], "<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        for name, value in zip(out, (key, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32"))], list(out))

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Pack all rows into sequences of at most ``capacity`` tokens: a row per piece with sequence_id and offset.

    A text's ids are followed by id 0; null and empty texts are that id alone. Only texts longer than a sequence are
    cut. Pieces are dealt to packers of about ``per_packer`` by a hash of their row number, so neither a long text nor
    repeated or null ids gather in one task, and every packer sees the corpus's mix of lengths. Other
    columns are dropped; an empty table gives an empty result.
    """
    made = stage(pieces(docs, tokenizer, doc_id, text, capacity))
    packers = made.count() // per_packer + 1
    dealt = made.withColumn("packer", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(packers)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = pack(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=where + (group["packer"].to_numpy() << 32), offset=offset).drop(columns="packer")

    return dealt.groupBy("packer").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
