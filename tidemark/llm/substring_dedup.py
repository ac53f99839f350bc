"""Exact substring deduplication by a sparse suffix array over content-defined suffixes.

Which suffixes are sorted. A string of LENGTH bytes has LENGTH - GRAM + 1 grams, and the one with the smallest hash
(leftmost on ties) is its anchor. The anchor depends on the string alone, so equal strings have it at the same
place, and it suffices to sort suffixes at anchors: about 1 of 30. The starts with the same anchor are a run, a
"cell"; the cell's bytes are all that its strings hold. A suffix's leading tokens are the hash of its gram, then the hash
of its cell with the anchor's place in it, then the document and place.

How they are sorted. Splitters, sampled in proportion to the data over all these tokens, deal the suffixes into buckets of
a bounded size, whatever one gram's or one cell's share is; each bucket is sorted by multikey quicksort. What a bucket
can't know of its first and last gram is settled by comparing the buckets that have the same gram.

What follows. All suffixes of a cell but the first are repeats with all their strings. Cells alone under their gram are
unique. What remains are first cells that share a gram with another cell, mostly at the ends of a repeat: for these the
strings are compared one by one, first inside a bucket of documents, then one for each bucket and string.

Hashes are taken over words of eight bytes: each word is mixed by a bijection, and the words' sum under a random odd
multiplier each is mixed again. Cells are equal if gram and cell agree in 128 bits, strings if both their hashes do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, ship, slices, spread, stage, utf8
from .shingles import _runs_of as _runs
from .shingles import mix

LENGTH, GRAM = 100, 40
#: Suffixes of a bucket by plan, keys per bucket that the splitters are chosen from and at least, and bytes of a bucket of documents.
BUCKET_SUFFIXES, SAMPLE_KEYS, LEAST_KEYS, DOC_BUCKET_BYTES = 500_000, 16, 4000, 8 << 20
#: Bytes of a longer text that are looked at together.
SEGMENT = SLICE_BYTES
#: Suffixes, or bytes, that a task gathers before it sends them to their buckets.
FLUSH_SUFFIXES, FLUSH_BYTES = 1_000_000, 16 << 20
#: Hashes that are worked on together while they are in a core's cache.
CACHED = 1 << 15
REPEATED, MIXED = 1, 2
#: Stands for a null id.
NO_ID = (1 << 63) - 1
_FACTORS = np.random.default_rng(20240311).integers(0, 1 << 63, (3, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def packed(**arrays: np.ndarray) -> bytes:
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode()
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays.values()), 3)


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    body, out = zstandard.decompress(blob), {}
    at = 4 + int.from_bytes(body[:4], "little")
    for k, kind, n in (x.split(",") for x in body[4:at].decode().split(";")):
        out[k] = np.frombuffer(body, kind, int(n), at)
        at += out[k].nbytes
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` in place."""
    part = x >> np.uint64(30)
    for shift, factor in ((27, 0xBF58476D1CE4E5B9), (31, 0x94D049BB133111EB)):
        x ^= part
        x *= np.uint64(factor)
        np.right_shift(x, np.uint64(shift), out=part)
    x ^= part
    return x


class Slice:
    """Texts laid end to end, with the hash of any gram or string at hand."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        # The eight bytes from every place, by a view with a step of one byte.
        words = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,)).astype(np.uint64)
        words *= np.uint64(0x9FB21C651E98DF25)
        words ^= words >> np.uint64(32)
        words *= np.uint64(0xD6E8FEB86659FD93)
        self.words = words

    def grams(self, size: int = GRAM) -> np.ndarray:
        """The hash of every ``size`` bytes, for any multiple of eight."""
        n = max(0, len(self.data) - size + 1)
        out, part = np.zeros(n, np.uint64), np.empty(min(n, CACHED), np.uint64)
        for i in range(0, n, CACHED):
            own = out[i : i + CACHED]
            for k, factor in zip(range(0, size, 8), _FACTORS[0], strict=False):
                own += np.multiply(self.words[i + k : i + k + len(own)], factor, out=part[: len(own)])
            _mixed(own)
        return out

    def strings(self, start: np.ndarray, family: int, size: int = LENGTH) -> np.ndarray:
        """The hash of the ``size`` bytes from each start, under one of two families of multipliers."""
        out = np.zeros(len(start), np.uint64)
        for k, factor in zip([*range(0, size - 7, 8), *([size - 8] if size % 8 else [])], _FACTORS[family], strict=False):
            out += self.words[start + k] * factor
        return _mixed(out)

    def cells(self, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
        """For every cell: text, first and last start, anchor, and the hash of the gram there; places in the slice."""
        n, wide = len(self.data), length - gram + 1
        long = np.diff(self.at) >= length
        first, stop = self.at[:-1][long], self.at[1:][long] - length + 1
        if not len(first):
            return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64)
        grams = self.grams(gram)
        starts = n - length + 1
        rows = np.concatenate([grams, np.full(-len(grams) % wide, ~np.uint64(0))]).reshape(-1, wide)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts])
        inside = np.zeros(starts + 1, np.int64)
        np.add.at(inside, first, 1)
        np.add.at(inside, stop, -1)
        own = grams[:starts] == least
        ends = own.copy()
        ends[:-1] |= least[1:] < least[:-1]
        ends[stop - 1] = True
        last = (ends & (np.cumsum(inside[:starts]) > 0)).nonzero()[0]
        anchor = last.copy()
        elsewhere = (~own[last]).nonzero()[0]
        for part in np.array_split(elsewhere, len(elsewhere) // 20_000 + 1):
            anchor[part] = last[part] + np.argmin(grams[last[part][:, None] + np.arange(wide)], axis=1)
        text = np.searchsorted(self.at, last, "right") - 1
        begin = np.empty_like(last)
        begin[0], begin[1:] = 0, last[:-1] + 1
        fresh = np.concatenate(([True], text[1:] != text[:-1]))
        begin[fresh] = self.at[text[fresh]]
        return text, begin, last, anchor, grams[anchor]


def text_hash(text: np.ndarray) -> int:
    """Tells texts under one id apart."""
    return int.from_bytes(hashlib.blake2b(text.tobytes(), digest_size=8).digest(), "little", signed=True)


def pieces_of(data: np.ndarray, at: np.ndarray, segment: int) -> Iterator[tuple[np.ndarray, int, Slice]]:
    """Slices with their texts' places in the list and where in these they begin.

    A text of more than ``segment`` starts of strings is cut into pieces of so many, which overlap by a string but one byte,
    so that every string begins in one piece. The cells at a cut are other than elsewhere; their strings are compared
    one by one, as they share their gram with the whole cells.
    """
    n = np.diff(at)
    long = n > segment + LENGTH - 1
    (rows,) = (~long).nonzero()
    if not long.any():
        yield rows, 0, Slice(data, at)
        return
    if len(rows):
        yield rows, 0, Slice(data[np.repeat(~long, n)], np.concatenate(([0], np.cumsum(n[rows]))))
    for i in long.nonzero()[0].tolist():
        for base in range(0, int(n[i]) - LENGTH + 1, segment):
            part = data[at[i] + base : min(at[i + 1], at[i] + base + segment + LENGTH - 1)]
            yield np.array([i]), base, Slice(part, np.array([0, len(part)]))


def _suffixes(batches: Iterator[pa.RecordBatch], segment: int = SEGMENT) -> Iterator[dict[str, np.ndarray]]:
    """Tokens of the suffixes of a slice of texts; a cell's place is that of its first start."""
    for whole in batches:
        for batch in slices(whole, "text"):
            data, at = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            hashed: dict[int, int] = {}
            for rows, base, s in pieces_of(data, at, segment):
                text, begin, last, anchor, gram = s.cells()
                if not len(text):
                    continue
                used, index = np.unique(rows[text], return_inverse=True)
                for i in used.tolist():
                    if i not in hashed:
                        hashed[i] = text_hash(data[at[i] : at[i + 1]])
                own = np.array([hashed[i] for i in used.tolist()], np.int64)
                shape = mix(((anchor - begin) * 1024 + (last - begin)).astype(np.uint64))
                cell = mix(s.strings(begin, 1) + mix(s.strings(last, 1) + shape))
                yield {"h": gram, "c": cell, "d": ids[used][index], "t": own[index], "a": begin - s.at[text] + base}


def multikey_order(columns: list[np.ndarray], small: int = 1 << 14) -> np.ndarray:
    """The order of rows by the columns in turn: three-way quicksort on a token; equal rows go on to the next one."""
    out, todo = [], [(np.arange(len(columns[0])), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth == len(columns) or len(rows) < 2:
            out.append(rows)
        elif len(rows) <= small:
            out.append(rows[np.lexsort([c[rows] for c in columns[depth:][::-1]])])
        else:
            token = columns[depth][rows]
            pivot = np.sort(token[:: max(1, len(token) // 501)])[min(250, len(token) // 2)]
            todo += [(rows[token > pivot], depth), (rows[token == pivot], depth + 1), (rows[token < pivot], depth)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


TOKENS = ("h", "c", "d", "t", "a")


def bucket_of(splitters: dict[str, np.ndarray], s: dict[str, np.ndarray]) -> np.ndarray:
    """How many splitters are at or before each suffix; splitters are sorted by all tokens."""
    low, high = np.searchsorted(splitters["h"], s["h"], "left"), np.searchsorted(splitters["h"], s["h"], "right")
    (open_,) = (low != high).nonzero()  # the gram of a splitter: the further tokens decide
    while len(open_):
        mid = (low[open_] + high[open_]) // 2
        before, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k in TOKENS[1:]:
            x, y = splitters[k][mid], s[k][open_]
            before |= equal & (x < y)
            equal &= x == y
        before |= equal
        low[open_[before]], high[open_[~before]] = mid[before] + 1, mid[~before]
        open_ = open_[low[open_] != high[open_]]
    return low


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32 if a.max(initial=0) >> 16 else np.uint16)


def _pairs(d: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
    """Documents, each once, and their places."""
    listed, index = np.unique(np.stack([d, t], axis=1), axis=0, return_inverse=True)
    return {"i": index.ravel().astype(np.uint32), "d": listed[:, 0].copy(), "t": listed[:, 1].copy()}


def doc_bucket(d: np.ndarray, t: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(d.astype(np.int64).view(np.uint64) ^ mix(t.astype(np.int64).view(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def _by_place(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every place and the rows that have it."""
    if not len(place):
        return
    order = np.argsort(place, kind="stable")
    for i, j in pairwise([*_runs(place[order]).nonzero()[0].tolist(), len(order)]):
        yield int(place[order[i]]), order[i:j]


def _verdict_blobs(d: np.ndarray, t: np.ndarray, a: np.ndarray, f: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    return [(0, p, packed(d=d[m], t=t[m], a=a[m], f=f[m])) for p, m in _by_place(doc_bucket(d, t, buckets))]


def _sorted_bucket(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Verdicts of a bucket of suffixes, by bucket of documents (kind 0), and by gram what its first and last one leave open (kind 1)."""
    parts = [unpacked(b) for b in group["blob"]]
    s = {}
    for k in TOKENS:
        s[k] = np.concatenate([p[k][p["i"]] if k in "dt" else p[k] for p in parts]).astype(np.uint64 if k in "hc" else np.int64)
    order = multikey_order([s[k] for k in TOKENS])
    s = {k: v[order] for k, v in s.items()}
    new_gram, new_cell = _runs(s["h"]), _runs(s["h"], s["c"])
    start = np.maximum.accumulate(np.where(new_cell, np.arange(len(new_cell)), 0))
    same = (s["d"] == s["d"][start]) & (s["t"] == s["t"][start]) & (s["a"] == s["a"][start])  # a row listed again
    gram = np.cumsum(new_gram) - 1
    several = np.bincount(gram, weights=new_cell)[gram] > 1
    flag = np.where(~same, REPEATED, np.where(several, MIXED, 0)).astype(np.int8)
    (leads,) = new_gram.nonzero()
    ends = np.append(leads[1:], len(gram)) - 1
    out = []
    for i in {0, len(leads) - 1}:
        lead, end = leads[i], ends[i]
        flag[(start == lead) & same] = 0  # settled across the bounds, if the gram goes on there or not
        edge = packed(b=np.array([group["bucket"].iloc[0], several[lead]], np.int64), c=s["c"][[lead, end]], p=np.array([s[k][lead] for k in "dta"], np.int64))
        out.append((1, int(s["h"][[lead]].view(np.int64)[0]), edge))
    sure = flag > 0
    return pd.DataFrame(_verdict_blobs(s["d"][sure], s["t"][sure], s["a"][sure], flag[sure], buckets) + out, columns=["kind", "place", "blob"])


def _settled(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Verdicts on the first suffix that each bucket has of one gram: a repeat if its cell goes on from the bucket before,
    mixed if the gram has another cell in any bucket."""
    edges = sorted((unpacked(b) for b in group["blob"]), key=lambda e: int(e["b"][0]))
    several = any(e["b"][1] for e in edges) or len({int(c) for e in edges for c in e["c"]}) > 1
    flags = [REPEATED if k and edges[k - 1]["c"][1] == e["c"][0] else MIXED if several else 0 for k, e in enumerate(edges)]
    d, t, a = np.stack([e["p"] for e in edges], axis=1)
    f = np.array(flags, np.int8)
    return pd.DataFrame(_verdict_blobs(d[f > 0], t[f > 0], a[f > 0], f[f > 0], buckets), columns=["kind", "place", "blob"])


class Piece(NamedTuple):
    """Texts of a bucket of documents, or a part of a long one: ids, text hashes, where the part begins, and the whole long text."""

    ids: np.ndarray
    own: np.ndarray
    base: int
    slice: Slice
    whole: np.ndarray | None


def _texts_of(blobs, asked, segment: int) -> Iterator[Piece]:
    """A bucket's documents in ``asked`` (pairs of id and hash), some texts at a time."""
    for blob in blobs:
        p = unpacked(blob)
        at = np.cumsum(p["n"]) - p["n"]
        own = np.array([k for k, key in enumerate(zip(p["d"].tolist(), p["t"].tolist(), strict=True)) if key in asked], int)
        ends = np.concatenate(([0], np.cumsum(p["n"][own])))
        begin = 0
        while begin < len(own):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE_BYTES, "right")) - 1)
            part = own[begin:end]
            data = np.concatenate([p["x"][at[k] : at[k] + p["n"][k]] for k in part]) if len(part) > 1 else p["x"][at[part[0]] : at[part[0]] + p["n"][part[0]]]
            bounds = ends[begin : end + 1] - ends[begin]
            for rows, base, s in pieces_of(data, bounds, segment):
                long = p["n"][part[rows[0]]] > len(s.data) if len(rows) == 1 else False
                yield Piece(p["d"][part[rows]], p["t"][part[rows]], base, s, data[bounds[rows[0]] : bounds[rows[0] + 1]] if long else None)
            begin = end


def _other_texts(blobs, asked) -> Iterator[tuple[int, np.ndarray]]:
    """Ids and texts of a bucket's documents that are not in ``asked``."""
    for blob in blobs:
        p = unpacked(blob)
        at = np.cumsum(p["n"]) - p["n"]
        for k, key in enumerate(zip(p["d"].tolist(), p["t"].tolist(), strict=True)):
            if key not in asked:
                yield key[0], p["x"][at[k] : at[k] + p["n"][k]]


def _verdicts(blobs) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Per document its judged anchors, in order, and their flags."""
    parts = [unpacked(b) for b in blobs]
    if not parts:
        return {}
    d, t, a, f = (np.concatenate([p[k] for p in parts]) for k in "dtaf")
    order = np.lexsort((f, a, t, d))
    d, t, a, f = d[order], t[order], a[order], f[order]
    bounds = [*_runs(d, t).nonzero()[0].tolist(), len(d)]
    return {(int(d[i]), int(t[i])): (a[i:j], f[i:j]) for i, j in pairwise(bounds)}


def _judged(piece: Piece, verdicts: dict) -> tuple[np.ndarray, ...]:
    """Cells of a piece with a verdict: text, first and last start, flag."""
    s = piece.slice
    text, begin, last, _, _ = s.cells()
    flag = np.zeros(len(text), np.int8)
    bounds = np.searchsorted(text, np.arange(len(piece.ids) + 1))
    for i, (d, t) in enumerate(zip(piece.ids.tolist(), piece.own.tolist(), strict=True)):
        found = verdicts.get((d, t))
        if found is not None and bounds[i] < bounds[i + 1]:
            part = slice(bounds[i], bounds[i + 1])
            place = begin[part] - s.at[i] + piece.base
            low, high = np.searchsorted(found[0], [place[0], place[-1] + 1])
            flag[part][np.searchsorted(place, found[0][low:high])] = found[1][low:high]
    return text, begin, last, flag


def _strings(s: Slice, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All starts of some cells."""
    return spread(begin, last - begin + 1)


def _first_strings(texts, verdicts: dict, segment: int) -> dict[str, np.ndarray]:
    """The first place of each string of the mixed cells in a bucket of documents: hashes w and x, document d and t, place a."""
    found = [tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64))]
    for piece in _texts_of(texts, {k for k, (_, flag) in verdicts.items() if (flag == MIXED).any()}, segment):
        text, begin, last, flag = _judged(piece, verdicts)
        m, s = flag == MIXED, piece.slice
        at = _strings(s, begin[m], last[m])
        doc = np.repeat(text[m], (last - begin + 1)[m])
        found.append((s.strings(at, 1), s.strings(at, 2), piece.ids[doc], piece.own[doc], at - s.at[doc] + piece.base))
    w, x, d, t, a = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((a, t, d, x, w))
    order = order[_runs(w[order], x[order])]
    return {"w": w[order], "x": x[order], "d": d[order], "t": t[order], "a": a[order]}


def _in(w: np.ndarray, x: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which pairs of hashes are among the listed pairs."""
    order = np.lexsort(listed[::-1])
    lw, lx = listed[0][order], listed[1][order]
    low, high = np.searchsorted(lw, w, "left"), np.searchsorted(lw, w, "right")
    found = np.zeros(len(w), bool)
    for k in range(int((high - low).max(initial=0))):
        (there,) = (low + k < high).nonzero()
        found[there] |= lx[low[there] + k] == x[there]
    return found


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_suffixes: int = BUCKET_SUFFIXES, doc_bucket_bytes: int = DOC_BUCKET_BYTES, segment: int = SEGMENT) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, binary).

    Every byte that a LENGTH-byte string covers which also starts earlier (smaller doc_id, or earlier in the same
    document) is removed; strings are judged on the input and don't cross documents. Null and empty texts are
    empty. Null ids come after all others. Rows with the same id but different texts are ordered by a hash of
    the text; rows with the same id and text are the same document listed again, not a copy, and each gets the
    same result. Strings are compared by 128 bits of hashes. A long text is looked at in pieces of ``segment`` bytes, so
    that a task holds some bytes per byte of it, not some words. Other columns are dropped.

    What is dealt out are compressed blocks: suffix tokens by sampled splitters, texts and verdicts by bucket of documents.
    The driver holds SAMPLE_KEYS sampled keys of 40 bytes for a bucket of ``bucket_suffixes`` suffixes, which is to grow with
    the executors' memory (a bucket takes some 100 bytes a suffix).
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    suffixes = size // 25 + 1
    buckets, doc_buckets = suffixes // bucket_suffixes + 1, size // doc_bucket_bytes + 1

    # Some documents' suffixes are looked at, forty times as many as are kept, and of these a share drawn by hash.
    keys = max(LEAST_KEYS, SAMPLE_KEYS * buckets)
    looked = min(1.0, 40 * keys / suffixes)
    kept = min(1.0, keys / suffixes / looked)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _suffixes(batches, segment):
            pick = mix(s["c"] ^ mix(s["d"].view(np.uint64) ^ mix(s["a"].view(np.uint64)))) < np.uint64(kept * (2**64 - 2**12))
            yield pa.RecordBatch.from_arrays([pa.array(s[k][pick].view(np.int64)) for k in TOKENS], list(TOKENS))

    def chosen() -> dict[str, np.ndarray]:
        if buckets > 1:
            found = (rows if looked == 1 else rows.sample(looked, 11)).mapInArrow(sample, ", ".join(f"{k} long" for k in TOKENS)).toArrow()
        if buckets == 1 or not found.num_rows:
            return {k: np.zeros(0, np.uint64 if k in "hc" else np.int64) for k in TOKENS}
        s = {k: found.column(k).to_numpy().view(np.uint64 if k in "hc" else np.int64) for k in TOKENS}
        order = np.lexsort([s[k] for k in TOKENS[::-1]])[np.unique(found.num_rows * np.arange(1, buckets) // buckets)]
        order = order[_runs(*(s[k][order] for k in TOKENS))]
        return {k: v[order] for k, v in s.items()}

    splitters = spark.sparkContext.broadcast(chosen())

    def deal_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for s in _suffixes(batches, segment):
            held.append(s)
            n += len(s["h"])
            if n >= FLUSH_SUFFIXES:
                yield from send(held)
                held, n = [], 0
        if held:
            yield from send(held)

    def send(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        s = {k: np.concatenate([x[k] for x in held]) for k in TOKENS}
        for b, m in _by_place(bucket_of(splitters.value, s)):
            m = m[np.argsort(s["h"][m], kind="stable")]
            blob = packed(h=s["h"][m], c=s["c"][m], a=_narrow(s["a"][m]), **_pairs(s["d"][m], s["t"][m]))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int64()), "blob": pa.array([blob], pa.binary())})

    def deal_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at = utf8(batch.column("text"))
                own = np.array([text_hash(data[i:j]) for i, j in pairwise(at.tolist())], np.int64)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                for i, b in enumerate(doc_bucket(ids, own, doc_buckets).tolist()):
                    held.setdefault(b, []).append((ids[i], own[i], data[at[i] : at[i + 1]]))
                n += len(data)
                if n >= FLUSH_BYTES:
                    yield from texts_out(held)
                    held, n = {}, 0
        yield from texts_out(held)

    def texts_out(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for b, found in held.items():
            blob = packed(d=np.array([x[0] for x in found], np.int64), t=np.array([x[1] for x in found], np.int64), n=np.array([len(x[2]) for x in found], np.int64), x=np.concatenate([x[2] for x in found]))
            yield pa.RecordBatch.from_pydict({"place": pa.array([b], pa.int64()), "blob": pa.array([blob], pa.binary())})

    block = "kind int, place long, blob binary"
    judged = stage(rows.mapInArrow(deal_suffixes, "bucket long, blob binary").groupBy("bucket").applyInPandas(lambda g: _sorted_bucket(g, doc_buckets), block))
    settled = judged.where("kind = 1").groupBy("place").applyInPandas(lambda g: _settled(g, doc_buckets), block)
    verdicts = judged.where("kind = 0").unionByName(settled)
    texts = rows.mapInArrow(deal_texts, "place long, blob binary")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f = _first_strings(left["blob"], _verdicts(right["blob"]) if len(left) else {}, segment)
        part = ((f["w"] >> np.uint64(32)) * np.uint64(doc_buckets) >> np.uint64(32)).astype(np.int64)
        own = np.array([left["place"].iloc[0] if len(left) else 0], np.int64)
        out = [(b, packed(w=f["w"][m], x=f["x"][m], a=_narrow(f["a"][m]), p=own, **_pairs(f["d"][m], f["t"][m]))) for b, m in _by_place(part)]
        return pd.DataFrame(out, columns=["part", "blob"])

    def not_first(group: pd.DataFrame) -> pd.DataFrame:
        found = [unpacked(b) for b in group["blob"]]
        w, x, a = (np.concatenate([p[k] for p in found]) for k in "wxa")
        d, t = (np.concatenate([p[k][p["i"]] for p in found]) for k in "dt")
        place = np.concatenate([np.full(len(p["w"]), p["p"][0]) for p in found])
        order = np.lexsort((a, t, d, x, w))
        late = order[~_runs(w[order], x[order])]
        return pd.DataFrame([(2, p, packed(w=w[late][m], x=x[late][m])) for p, m in _by_place(place[late])], columns=["kind", "place", "blob"])

    late = texts.groupBy("place").cogroup(verdicts.groupBy("place")).applyInPandas(compare, "part long, blob binary").groupBy("part").applyInPandas(not_first, block)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []

        def judged_text(d: int, text: np.ndarray, gone: np.ndarray) -> None:
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
            out.append((d, len(text), int(gone.sum()), spans, text[~gone].tobytes()))

        if len(left):
            known = _verdicts(right["blob"][right["kind"] == 0])
            f = _first_strings(left["blob"], known, segment)
            late = [unpacked(b) for b in right["blob"][right["kind"] == 2]]
            stays = ~_in(f["w"], f["x"], tuple(np.concatenate([p[k] for p in late]) for k in "wx")) if late else np.ones(len(f["w"]), bool)
            order = np.lexsort((f["a"], f["t"], f["d"]))
            d, t, a = (f[k][order[stays[order]]] for k in "dta")
            firsts = {(int(d[i]), int(t[i])): a[i:j] for i, j in pairwise([*_runs(d, t).nonzero()[0].tolist(), len(d)])} if len(d) else {}
            out += [(d, len(x), 0, 0, x.tobytes()) for d, x in _other_texts(left["blob"], known)]
            gone = None
            for piece in _texts_of(left["blob"], known, segment):
                s = piece.slice
                text, begin, last, flag = _judged(piece, known)
                covered = np.zeros(len(s.data) + 1, np.int64)
                starts = _strings(s, begin[flag > 0], last[flag > 0])
                np.add.at(covered, starts, 1)
                np.add.at(covered, starts + LENGTH, -1)
                for i, key in enumerate(zip(piece.ids.tolist(), piece.own.tolist(), strict=True)):
                    if key in firsts:
                        at = firsts[key] - piece.base
                        at = at[(at >= 0) & (at <= s.at[i + 1] - s.at[i] - LENGTH)] + s.at[i]
                        np.add.at(covered, at, -1)
                        np.add.at(covered, at + LENGTH, 1)
                removed = np.cumsum(covered[:-1]) > 0
                if piece.whole is None:
                    for i, (x, y) in enumerate(pairwise(s.at.tolist())):
                        judged_text(int(piece.ids[i]), s.data[x:y], removed[x:y])
                    continue
                if not piece.base:
                    gone = np.zeros(len(piece.whole), bool)
                gone[piece.base : piece.base + len(s.data)] |= removed
                if piece.base + len(s.data) == len(piece.whole):
                    judged_text(int(piece.ids[0]), piece.whole, gone)
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = texts.groupBy("place").cogroup(verdicts.unionByName(late).groupBy("place")).applyInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    done = remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), q AS (SELECT doc_id, n, o, substr(x, 2 * o + 1, 1222) AS y FROM (SELECT *, unnest(range(0, n - 99, 512)) AS o FROM d WHERE n >= 100)
), p AS (SELECT doc_id, o + i AS s, md5_number(substr(y, 2 * i - 1, 200)) AS h FROM (SELECT *, unnest(range(1, least(512, n - 99 - o) + 1)) AS i FROM q)
), g AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM p) WHERE k > 1
), r AS (SELECT *, sum(CASE WHEN s <= e + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT *, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) AS e FROM g)
), c AS (SELECT doc_id, min(s) AS a, max(s) + 99 AS b FROM r GROUP BY doc_id, run
), k AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS cut, count(*) AS spans FROM c GROUP BY doc_id
), gaps AS (
  SELECT doc_id, lag(b, 1, 0) OVER w + 1 AS a, a - 1 AS b FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0) + 1, any_value(n) FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id
), t AS (SELECT gaps.doc_id, string_agg(substr(x, 2 * a - 1, 2 * (b - a + 1)), '' ORDER BY a) AS y FROM gaps JOIN d USING (doc_id) WHERE b >= a GROUP BY gaps.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(cut, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(y, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
