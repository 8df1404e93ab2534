"""Finding repeated windows of a sequence by anchors: the part that suffix-array and suffix-tree dedup share.

Every window of `window` symbols holds an anchor, the `gram`-symbol run with the least hash in it, and equal
windows hold it at the same place. So only anchors (about one in 35 bytes, or in 9 words) are shuffled, by hash;
an anchor that occurs once ends there. Each occurrence carries a hash of its context, all that windows with this
anchor can cover; occurrences with equal contexts are settled by that alone (128 bits of hash in all), and one of
each different context of an anchor is fetched and compared symbol by symbol by the operator.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import BASES, anchors, arrow_map, batch, grams, mix64, slices, utf8, written

#: A fixed table of random odd symbols for bytes.
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What to keep of 8 bytes of which the first n are a word's.
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 64
#: Bits of a text's crc32 that tell rows of one doc_id apart.
TAG = 0x7FFFF
LEAST = -(1 << 63)


def word_edges(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    step = np.diff(np.concatenate([[True], _SPACE[a], [True]]).astype(np.int8))
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def byte_symbols(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


def word_symbols(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word: 8 bytes after 8 bytes with mixing between; of words over LONG bytes BLAKE2."""
    a = np.frombuffer(text, np.uint8)
    start, end = word_edges(a)
    length = end - start
    padded = np.zeros(len(a) + 8, np.uint8)
    padded[: len(a)] = a
    low = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(start), np.uint64)
    short = np.flatnonzero(length <= LONG)
    for k in range(0, LONG, 8):
        short = short[length[short] > k]
        if not len(short):
            break
        n = np.minimum(length[short] - k, 8)
        block = np.ascontiguousarray(low[start[short] + k]).view("<u8").ravel() & _TAIL[n]
        out[short] = mix64((out[short] ^ block) * np.uint64(BASES[0]) + n.astype(np.uint64))
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(text[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def byte_slice(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    return [text[a:b] for a, b in spans]


def word_slice(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in spans]


def pack_at(tag: int, pos: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Tag of the text (19 bits), position (28), symbols of context before and from it (8 each), in one long that sorts by them."""
    return (tag << 44) | (pos << 16) | (back << 8) | ahead


def open_at(at: int) -> tuple[int, int, int]:
    """Position, start and end of the context."""
    pos = at >> 16 & 0xFFFFFFF
    return pos, pos - (at >> 8 & 255), pos + (at & 255)


_ANCHOR = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("more", pa.binary())])


def _collapsed(h: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """A row for each (h, c): its least (doc, at), and the others in order, as pairs of 64-bit integers side by side."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    often = np.zeros(len(h), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    once, some = np.flatnonzero(~often), np.flatnonzero(often)
    some = some[np.lexsort((at[some], doc[some], c[some], h[some]))]
    first = np.ones(len(some), bool)
    first[1:] = (h[some][1:] != h[some][:-1]) | (c[some][1:] != c[some][:-1])
    heads, rest = np.flatnonzero(first), some[~first]
    rows = np.concatenate([once, some[heads]])
    sizes = np.concatenate([np.zeros(len(once), np.int64), np.diff(np.append(heads, len(some))) - 1])
    offsets = np.concatenate([[0], np.cumsum(16 * sizes)]).astype(np.int32)
    places = np.stack([doc[rest], at[rest]], axis=1).astype("<i8").tobytes()
    more = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(places)])
    return batch(_ANCHOR, [h[rows].view(np.int64), c[rows].view(np.int64), doc[rows], at[rows], more])


def _anchored(symbols: Callable, window: int, gram: int):
    width = window - gram + 1

    def run(batches):
        for rb in batches:
            hs, cs, ds, ats = [], [], [], []
            for doc, text in zip(rb.column("doc").to_pylist(), utf8(rb.column("text"))):
                if len(text) < window:
                    continue
                s = symbols(text)
                n = len(s)
                if n < window:
                    continue
                h = grams(s, gram, BASES[0])
                p = anchors(h, width)
                low, high = np.maximum(p - (width - 1), 0), np.minimum(p + window, n)
                hs.append(h[p])
                cs.append(slices(s, low, high, BASES[1]) + (p - low).astype(np.uint64))
                ds.append(np.full(len(p), doc))
                ats.append(pack_at(zlib.crc32(text) & TAG, p, p - low, high - p))
            if hs:
                yield _collapsed(*map(np.concatenate, (hs, cs, ds, ats)))

    return run


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (null doc_id: the least long), tag and text. Rows that agree in both keys count as one document."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), (F.crc32(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(TAG))).alias("tag"), F.col(text).alias("text"))


def shared_anchors(rows: DataFrame, symbols: Callable, window: int, gram: int, name: str) -> DataFrame:
    """h, c, doc, at, more, n_same (occurrences of this context), nth (1 where doc and at are the first of them), n_ctx (different contexts of h), alone (one occurs once).

    Only anchors that occur twice or more. One shuffle, by h, of the anchors alone. An Arrow batch has one row for each
    anchor and context, so a passage that a third of all documents share comes as one row a batch, with its other places in `more`.
    """
    found = arrow_map(rows.select("doc", "text"), _anchored(symbols, window, gram), "h long, c long, doc long, at long, more binary")
    of_c, of_h = W.partitionBy("h", "c"), W.partitionBy("h")
    # By h first: that exchange serves the windows by (h, c) too.
    sized = found.withColumn("size", F.expr("1 + octet_length(more) div 16")).withColumn("n", F.sum("size").over(of_h)).where("n > 1")
    ranked = sized.withColumn("nth", F.rank().over(of_c.orderBy("doc", "at"))).withColumn("n_same", F.sum("size").over(of_c))
    ranked = ranked.withColumn("n_ctx", F.sum((F.col("nth") == 1).cast("int")).over(of_h)).withColumn("alone", F.max(F.col("n_same") == 1).over(of_h))
    return written(ranked.drop("n", "size"), name)


_CONTEXT = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n_same", pa.int64()), ("context", pa.binary())])


def contexts(rows: DataFrame, wanted: DataFrame, cut: Callable) -> DataFrame:
    """The symbols around the wanted anchors (h, doc, at, n_same), read from the texts."""
    places = wanted.groupBy("doc", F.shiftright("at", 44).alias("tag")).agg(F.collect_list(F.struct("h", "at", "n_same")).alias("places"))
    joined = rows.join(places, ["doc", "tag"]).select("doc", "text", "places")

    def run(batches):
        for rb in batches:
            h, d, a, s, out = [], [], [], [], []
            for doc, text, places_ in zip(rb.column("doc").to_pylist(), utf8(rb.column("text")), rb.column("places").to_pylist()):
                out += cut(text, [open_at(x["at"])[1:] for x in places_])
                for x in places_:
                    h.append(x["h"])
                    d.append(doc)
                    a.append(x["at"])
                    s.append(x["n_same"])
            yield batch(_CONTEXT, [h, d, a, s, out])

    return arrow_map(joined, run, "h long, doc long, at long, n_same long, context binary")


_MARK = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def solved(found: DataFrame, solve: Callable) -> DataFrame:
    """Runs solve(list of (doc, at, n_same, context), sorted by doc and at) on each anchor's contexts; it yields (index, start, end), relative to the context."""
    ordered = found.repartition("h").sortWithinPartitions("h", "doc", "at")

    def run(batches):
        def close(group):
            d, t, a, b = [], [], [], []
            for i, start, end in solve(group):
                doc, at = group[i][:2]
                low = open_at(at)[1]
                d.append(doc)
                t.append(at >> 44)
                a.append(low + start)
                b.append(low + end)
            return d, t, a, b

        held, group, out = None, [], ([], [], [], [])
        for rb in batches:
            for h, *x in zip(*[rb.column(i).to_pylist() for i in range(5)]):
                if h != held:
                    for to, more in zip(out, close(group) if len(group) > 1 else ()):
                        to += more
                    held, group = h, []
                    if len(out[0]) > 50_000:
                        yield batch(_MARK, list(out))
                        out = ([], [], [], [])
                if not group or group[-1][:2] != tuple(x[:2]):
                    group.append(tuple(x))
        for to, more in zip(out, close(group) if len(group) > 1 else ()):
            to += more
        yield batch(_MARK, list(out))

    return arrow_map(ordered, run, "doc long, tag long, start long, end long")


def whole_contexts(found: DataFrame, own) -> DataFrame:
    """Marks over the whole context of each row's own place, where `own` holds, and of each place in `more`."""
    pos = F.shiftright("at", 16).bitwiseAND(F.lit(0xFFFFFFF))
    mine = found.where(own).select("doc", F.shiftright("at", 44).alias("tag"), (pos - F.shiftright("at", 8).bitwiseAND(F.lit(255))).alias("start"), (pos + F.col("at").bitwiseAND(F.lit(255))).alias("end"))

    def run(batches):
        for rb in batches:
            doc, at = np.frombuffer(b"".join(rb.column("more").to_pylist()), "<i8").reshape(-1, 2).T
            place, low, high = open_at(at)
            yield batch(_MARK, [doc, at >> 44, low, high])

    return mine.unionAll(arrow_map(found.where(F.octet_length("more") > 0).select("more"), run, "doc long, tag long, start long, end long"))


def runs(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of intervals as maximal runs; touching ones are one run."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(rows: DataFrame, docs_columns: list[str], marks: DataFrame, digest: Callable, schema: str) -> DataFrame:
    """Joins each text with its marks and applies digest(doc, text, runs) -> row."""
    spans = marks.groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = rows.join(spans, ["doc", "tag"], "left").select(*docs_columns, "text", "starts", "ends")
    return arrow_map(joined, digest, schema)
