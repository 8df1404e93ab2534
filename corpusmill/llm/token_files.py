"""Token-ID files: Elias-Fano encoded document boundaries over a concatenated id array.

A file holds the ids of consecutive documents (ascending doc_id) as little-endian 16- or 32-bit integers behind
a header and two Elias-Fano codes: of the n + 1 boundaries, and of the doc ids less the first of them. A code is each
value's low bits packed side by side, the high bits in unary, and a sample of the unary code's ones every SAMPLE of
them, as 32-bit positions, for select. Readers take offsets by select, so no table of them is stored or built.
Layout, little-endian: magic 8s, width u32, low_bits of boundaries u32, of doc ids u32, 0 u32, n_docs u64, n_ids u64,
n_null u64 (documents without an id, which come first), first doc id i64, then for each code low words, high words,
samples (a u64 count and u32 each), then the ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import arrow_map, batch, filesystem, new_path, utf8, written

MAGIC, HEAD, SAMPLE = b"CMTOKEF2", struct.Struct("<8sIIIIQQQq"), 256
END_ID = 1
#: Ids in a file, at least, unless the partition ends.
FILE_IDS = 8 << 20
#: Documents that a reader selects at a time.
READ_DOCS = 4096
#: Entries of each half of a worker's cache of words, and of that of pieces.
CACHE_WORDS = 400_000


class EliasFano:
    """A non-decreasing sequence of n unsigned integers in about n * (2 + log2(u / n)) bits, with select."""

    def __init__(self, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, n: int):
        self.low_bits, self.low, self.high, self.samples, self.n = low_bits, low, high, samples, n

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        block, raw = 1 << 16, []  # a block's bits are whole bytes
        for i in range(0, n, block):
            raw.append(np.packbits(((values[i : i + block, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(low_bits, cls._words(np.concatenate([np.zeros(0, np.uint8), *raw])), cls._words(np.packbits(unary, bitorder="little")), ones[::SAMPLE].astype("<u4"), n)

    @staticmethod
    def _words(raw: np.ndarray) -> np.ndarray:
        return np.concatenate([raw, np.zeros(-len(raw) % 4, np.uint8)]).view("<u4")

    def _low(self, i: int) -> int:
        out = 0
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= (int(self.low[at >> 5]) >> (at & 31) & 1) << b
        return out

    def _place(self, i: int) -> int:
        """Where the i-th one of the unary code is: from the sampled one before it, count ones word by word."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word, w = at >> 5, int(self.high[at >> 5]) >> (at & 31) << (at & 31)
        while (ones := w.bit_count()) <= left:
            left -= ones
            word += 1
            w = int(self.high[word])
        for _ in range(left):
            w &= w - 1
        return (word << 5) + ((w & -w).bit_length() - 1)

    def select(self, i: int) -> int:
        """The i-th value."""
        return (self._place(i) - i) << self.low_bits | self._low(i)

    def selects(self, first: int, end: int) -> np.ndarray:
        """The values first to end - 1 (uint64): select for the first and the last, and the code between them alone."""
        if end <= first:
            return np.zeros(0, np.uint64)
        a, b = self._place(first) >> 5, (self._place(end - 1) >> 5) + 1
        bits = np.flatnonzero(np.unpackbits(self.high[a:b].view(np.uint8), bitorder="little")) + (a << 5)
        bits = bits[np.searchsorted(bits, self._place(first)) :][: end - first]
        out = (bits - np.arange(first, end)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at, to = first * self.low_bits, end * self.low_bits
            raw = np.unpackbits(self.low[at >> 5 : (to + 31) >> 5].view(np.uint8), bitorder="little")[at & 31 :][: to - at].reshape(-1, self.low_bits)
            for k in range(self.low_bits):
                out |= raw[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def all(self) -> np.ndarray:
        """Every value, as select gives them."""
        return self.selects(0, self.n).astype(np.int64)


def pack(doc_ids: list, lengths: list[int], ids: bytes, width: int) -> bytes:
    """A file's bytes. doc_ids ascend, nulls first; ids are all documents' ids at `width` bytes each."""
    n_null = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[n_null:], np.int64)
    first = int(known[0]) if len(known) else 0
    edges = EliasFano.of(np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]))
    names = EliasFano.of(known.view(np.uint64) - np.uint64(first & 0xFFFFFFFFFFFFFFFF))
    head = HEAD.pack(MAGIC, width, edges.low_bits, names.low_bits, 0, len(doc_ids), len(ids) // width, n_null, first)
    return b"".join([head, *(struct.pack("<Q", len(x)) + x.astype("<u4").tobytes() for c in (edges, names) for x in (c.low, c.high, c.samples)), ids])


class TokenFile:
    """A file's bytes, opened: doc ids and boundaries by select, ids."""

    def __init__(self, raw: bytes):
        magic, width, edge_bits, name_bits, _, self.n_docs, n_ids, self.n_null, self.first = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at, parts = HEAD.size, []
        for _ in range(6):
            (n,) = struct.unpack_from("<Q", raw, at)
            parts.append(np.frombuffer(raw, "<u4", n, at + 8))
            at += 8 + 4 * n
        self.edges = EliasFano(edge_bits, *parts[:3], self.n_docs + 1)
        self.names = EliasFano(name_bits, *parts[3:], self.n_docs - self.n_null)
        self.ids = np.frombuffer(raw, f"<u{width}", n_ids, at)

    def doc_ids(self, a: int, b: int) -> list:
        """The doc ids of documents a to b - 1."""
        null = max(0, min(b, self.n_null) - a)
        known = self.names.selects(max(a, self.n_null) - self.n_null, b - self.n_null) if b > self.n_null else np.zeros(0, np.uint64)
        return [None] * null + (known + np.uint64(self.first & 0xFFFFFFFFFFFFFFFF)).view(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        """The ids of document i."""
        return self.ids[self.edges.select(i) : self.edges.select(i + 1)]


def unpack(raw: bytes) -> tuple[list, EliasFano, np.ndarray]:
    """doc ids, boundaries, ids."""
    f = TokenFile(raw)
    return f.doc_ids(0, f.n_docs), f.edges, f.ids


def save(uri: str, raw: bytes) -> None:
    """Write a file under a name of its own; only tasks that end well report their names, so no reader meets a part of one."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(raw)


def load(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_stream(path) as f:
        return f.read()


#: How the tokenizer that WordEncoder has a short path for normalizes and parts texts.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same pattern for lower-case ASCII, and for words of letters and ASCII signs but for apostrophes.
_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
_LETTERS = re.compile(r"[^\W\d_]+|[!-&(-/:-@\[-`{-~]+").findall

_tokenizers: dict[str, object] = {}


class _Letters(dict):
    """Code points of letters to what normalizer and pre-tokenizer make of them; to ODD if that is not one piece."""

    ODD = "\ud800"

    def __init__(self, t):
        self.t = t

    def __missing__(self, point: int) -> str:
        made = self.t.pre_tokenizer.pre_tokenize_str(self.t.normalizer.normalize_str(chr(point)))
        out = self[point] = made[0][0] if len(made) == 1 else self.ODD
        return out


class _Cache(dict):
    """Values of `make` by key, with an older half: what is in use is taken over from it, the rest goes with it."""

    def __init__(self, make, older=None):
        self.make, self.older = make, older if older is not None else {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def aged(self) -> "_Cache":
        """This cache, or a new one with this as its older half, if it is full."""
        if len(self) <= CACHE_WORDS:
            return self
        self.older = {}
        return _Cache(self.make, self)


class WordEncoder:
    """Ids of texts through bounded caches of words and of pieces of words.

    The short path is for a tokenizer that lower-cases and whose pieces are runs of letters, single digits and runs of
    signs (checked when it is opened; any other encodes whole texts). A word of printable ASCII is parted here, by the
    tokenizer's own pattern. A word of letters below U+1100, where no letter joins with the next, and of ASCII signs is
    normalized letter by letter. Each piece goes to the library's model once. All other words, and those with signs of
    a special token, go to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[path] = Tokenizer.from_file(path)
        self.t = _tokenizers[path]
        self.width = 2 if self.t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.letters, self.tokenize = _Letters(self.t), self.t.model.tokenize
        self.words, self.pieces = _Cache(self._word), _Cache(self._piece)
        spec = json.loads(self.t.to_str())
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        special = all("<|" in x["content"] for x in spec["added_tokens"])
        self.short = (spec["normalizer"] or {}).get("normalizers") == _NORMALIZER and parts[0].get("pattern") == {"Regex": _PATTERN} and len(parts) == 2 and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and spec["truncation"] is None and special

    def _raw(self, ids: list[int]) -> bytes:
        out = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._raw([t.id for t in self.tokenize(piece)])

    def _word(self, word: bytes) -> bytes:
        s = word.decode()
        if "<|" in s:
            return self._whole(s)
        if s.isascii():
            if not s.isprintable():
                return self._whole(s)
            s = s.lower()
            return self.pieces[s] if s.isalpha() else b"".join(map(self.pieces.__getitem__, _ASCII(s)))
        if max(s) >= "\u1100":
            return self._whole(s)
        if s.isalpha():
            s = s.translate(self.letters)
            return self._whole(word.decode()) if _Letters.ODD in s else self.pieces[s]
        parts = _LETTERS(s)
        if "".join(parts) != s:
            return self._whole(s)
        made = [p.translate(self.letters) if p.isalpha() else p if p.isascii() else _Letters.ODD for p in parts]
        return self._whole(s) if any(_Letters.ODD in p for p in made) else b"".join(map(self.pieces.__getitem__, made))

    def _whole(self, text: str) -> bytes:
        return self._raw(self.t.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[bytes], end: int = END_ID) -> list[bytes]:
        """Each text's ids with the end id, as little-endian integers of `width` bytes."""
        tail = end.to_bytes(self.width, "little")
        if not self.short:
            return [self._whole(t.decode()) + tail for t in texts]
        self.words, self.pieces = self.words.aged(), self.pieces.aged()
        get = self.words.__getitem__
        return [b"".join(map(get, t.split())) + tail for t in texts]


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("path", pa.string())])


def _writer(folder: str, tokenizer: str, file_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc = WordEncoder(tokenizer)
        ids, lengths, docs, n = [], [], [], 0

        def flush():
            nonlocal ids, lengths, docs, n, seq
            path = f"{folder}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
            save(path, pack(docs, lengths, b"".join(ids), enc.width))
            row = [part], [seq], [len(docs)], [n], [path]
            ids, lengths, docs, n, seq = [], [], [], 0, seq + 1
            return batch(_MANIFEST, list(row))

        for rb in batches:
            for doc, raw in zip(rb.column("doc_id").to_pylist(), enc.encode(utf8(rb.column("text")))):
                docs.append(doc)
                ids.append(raw)
                lengths.append(len(raw) // enc.width)
                n += lengths[-1]
                if n >= file_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _reader(batches):
    for rb in batches:
        for path, base in zip(rb.column("path").to_pylist(), rb.column("base").to_pylist()):
            f = TokenFile(load(path))
            for a in range(0, f.n_docs, READ_DOCS):
                b = min(f.n_docs, a + READ_DOCS)
                edges = f.edges.selects(a, b + 1).astype(np.int64)
                wide = memoryview(f.ids[edges[0] : edges[-1]].astype("<u4").tobytes())
                cut = ((edges - edges[0]) * 4).tolist()
                crc = [zlib.crc32(wide[x:y]) for x, y in zip(cut, cut[1:])]
                yield batch(_READ, [f.doc_ids(a, b), edges[:-1] + base, np.diff(edges), crc])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all texts' ids below folder, in ascending doc_id order (null first, ties by text), and return the manifest.

    A row a file: part, seq, n_docs, n_ids, path, and base, the ids before it in the whole corpus. The manifest is a table;
    the driver sees one sum for each range of doc_ids. Null text: empty, so only the end id. An empty table: no files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    files = written(arrow_map(ordered, _writer(folder, tokenizer, file_ids), "part int, seq int, n_docs long, n_ids long, path string"), "manifest")
    before, starts = 0, []
    for part, size in files.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect():
        starts.append((part, before))
        before += size
    of = spark.createDataFrame(starts, "part int, part_base long")
    within = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return files.join(of, "part").withColumn("base", F.col("part_base") + within).drop("part_base")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(files.select("path", "base").repartition(n, "path"), _reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the token files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32 of each row.

    Null text: only the end id. Null doc_ids come first, as null; rows of one doc_id are documents of their own, by text. Very
    long texts: a file is as large as its last document makes it. Empty table: no rows. Other columns are not kept.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_tokens(write_tokens(docs, folder or new_path(docs.sparkSession, "tokens"), tokenizer))


def op7_elias_fano(spark, sf_dir: str) -> DataFrame:
    return tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
