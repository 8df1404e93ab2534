"""Cross-tokenizer alignment: the token groups and token pairs of two tokenizers over the same bytes.

The tokens of B, whose byte ranges tile the text, are a static interval index: two sorted arrays. Each token of A stabs it by
bisection and gets the list of B tokens that it overlaps. A gap between two B tokens that no A token spans is a group
boundary. Tokens of a group whose ranges end together are linked. Links are counted over the corpus for each pair of ids. The number of such pairs
has a bound that the vocabularies set (one token's bytes end with the other's), so the counts go to the tasks as one small table.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, batch, ship, utf8, written

SPACE = "\u2581"
#: Fixed value: how byte-level tokenizers part texts. No part has white space behind anything else.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in each half of a worker's cache, unless a single text has more, and characters of texts whose words are looked up together.
CACHE_CHUNKS, TOGETHER = 100_000, 1 << 18
#: Link keys that a task holds before it merges them into its counts.
PENDING = 1 << 21
#: White space and a word; other white space and the model's sign for a space, with which texts are not parted into words.
_CHUNK = re.compile(r"[ \n\t]+[^ \n\t]*").findall
_ODD_SPACE = re.compile(r"[\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u2581\u3000\ufeff]").search


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first and last B token that it overlaps. Ends ascend strictly, and both tile the same bytes."""
    starts_a = np.concatenate([[0], ends_a[:-1]])
    starts_b = np.concatenate([[0], ends_b[:-1]])
    return np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left") - 1


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of each A and of each B token."""
    first, last = overlaps(ends_a, ends_b)
    spanned = np.zeros(len(ends_b) + 1, np.int64)  # how many A tokens span the gap before each B token
    np.add.at(spanned, first + 1, 1)
    np.add.at(spanned, last + 1, -1)
    cut = np.cumsum(spanned)[:-1] == 0
    cut[0] = False
    of_b = np.cumsum(cut)
    return of_b[first], of_b


def rendered(ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> list[str]:
    """The pieces of `a1,a2|b1;a3|b2,b3;`: each token with what follows it, in order."""
    numbers = np.arange(int(of_b[-1]) + 1)
    out = np.empty(len(ids_a) + len(ids_b), object)
    for ids, of, between, behind, before in ((ids_a, of_a, ",", "|", np.searchsorted(of_b, numbers)[of_a]), (ids_b, of_b, ",", ";", np.searchsorted(of_a, numbers, "right")[of_b])):
        more = np.append(of[:-1] == of[1:], False)
        out[np.arange(len(ids)) + before] = [f"{i}{between if m else behind}" for i, m in zip(ids.tolist(), more.tolist())]
    return out.tolist()


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of A and B tokens whose ranges end together."""
    at = np.searchsorted(ends_a, ends_b)
    b = np.flatnonzero(ends_a[np.minimum(at, len(ends_a) - 1)] == ends_b)
    return at[b], b


def _byte_level() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as: those of three printable ranges as themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A tokenizer file of byte-level BPE: ids of space and text, special tokens' strings as plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        byte = _byte_level()
        vocab = self.t.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.fast = self._ranked(json.loads(self.t.to_str()), byte)

    @staticmethod
    def _ranked(spec: dict, byte: dict[str, int]):
        """The same tokenizer by ranks, some times faster, where ids follow the order of the merges and nothing else is done to texts."""
        pre, model, first = spec["pre_tokenizer"] or {}, spec["model"], len(byte)
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and spec["truncation"] is None
        plain = plain and model["type"] == "BPE" and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"] or model.get("ignore_merges"))
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
        if not plain or any(model["vocab"].get(m) != first + i for i, m in enumerate(merges)) or {model["vocab"].get(c) for c in byte} != set(range(first)):
            return None
        import tiktoken

        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i < first + len(merges)}
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> list[int]:
        return self.t.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class Pieces:
    """A SentencePiece model that adds a space: ids of text."""

    def __init__(self, path: str):
        import sentencepiece

        self.t = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.t.get_piece_size()
        pieces = [self.t.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.t.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.t.piece_to_id(SPACE)
        #: Words can be encoded by themselves: no merge crosses from a word to white space, nor touches a line end or tab, and texts are not normalized.
        plain = [p for i, p in enumerate(pieces) if not (self.t.is_byte(i) or self.t.is_control(i) or self.t.is_unknown(i))]
        self.by_words = self._plain_model(path) and not any(re.search(f"[^{SPACE}]{SPACE}|[\n\t ]", p) for p in plain)

    @staticmethod
    def _plain_model(path: str) -> bool:
        try:
            from sentencepiece import sentencepiece_model_pb2 as pb
        except ImportError:
            return False
        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        s, kind = m.normalizer_spec, pb.ModelProto.SentencePiece
        known = {kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE}
        return not s.precompiled_charsmap and s.add_dummy_prefix and not s.remove_extra_whitespaces and s.escape_whitespaces and m.trainer_spec.model_type == pb.TrainerSpec.BPE and not m.trainer_spec.treat_whitespace_as_suffix and {p.type for p in m.pieces} <= known

    def whole(self, text: str) -> list[int]:
        return self.t.encode(text, num_threads=1)

    def chunks(self, chunks: list[str]) -> list[list[int]]:
        """A word's first space is the one that the model adds; before a line end or tab that space stands alone and goes."""
        found = self.t.encode([c.removeprefix(" ") for c in chunks], num_threads=1)
        return [ids if c[0] == " " else ids[1:] if ids[0] == self.space else [] for c, ids in zip(chunks, found)]


class Aligner:
    """Alignments of texts, word by word through a bounded cache where both tokenizers allow it: both then part texts before white
    space, so groups and links stay within a word with its white space. What the cache lacks is encoded and aligned together, as one string."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        if not all(self.a.bytes) or not all(self.b.bytes):
            raise ValueError("a token without bytes has no place in an alignment")
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.width = 4 if len(self.size_a) * len(self.size_b) <= 1 << 32 else 8
        self.by_words = self.a.fast is not None and self.b.by_words
        self.new, self.old = {}, {}

    def aligned(self, words: list[str], ids_a: np.ndarray, ids_b: list[list[int]]) -> list[tuple | None]:
        """(rendered groups, packed link keys, n_a, n_b) of each string: ids_a of all of them, ids_b of each. None where their bytes are not the string."""
        raw = [w.encode() for w in words]
        n_b = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[b])
        to_a, to_b = np.searchsorted(ends_a, ends, "right"), np.cumsum(n_b)
        whole = b"".join(raw)
        good = len(ids_a) and n_b.all() and np.array_equal(ends_a[to_a - 1], ends) and np.array_equal(ends_b[to_b - 1], ends)
        good = good and b"".join(map(self.a.bytes.__getitem__, ids_a.tolist())) == whole and b"".join(map(self.b.bytes.__getitem__, b.tolist())) == whole
        if not good:
            return [None] * len(words)
        of_a, of_b = groups(ends_a, ends_b)
        at_a, at_b = links(ends_a, ends_b)
        keys = (ids_a[at_a] * len(self.size_b) + b[at_b]).astype(f"<u{self.width}").tobytes()
        shown = rendered(ids_a, b, of_a, of_b)
        cut = [0, *(to_a + to_b).tolist()]
        key_cut = [0, *(np.searchsorted(at_b, to_b) * self.width).tolist()]
        shown = ["".join(shown[i:j])[:-1] for i, j in zip(cut, cut[1:])]
        return list(zip(shown, [keys[i:j] for i, j in zip(key_cut, key_cut[1:])], np.diff(to_a, prepend=0).tolist(), n_b.tolist()))

    def whole(self, text: str) -> tuple | None:
        return self.aligned([" " + text], np.array(self.a.whole(text), np.int64), [self.b.whole(text)])[0]

    def _fill(self, chunks: set[str]) -> None:
        """Put all of these words into the cache, from its older half or made anew."""
        if len(self.new) >= CACHE_CHUNKS:
            self.new, self.old = {}, self.new
        lacking = chunks.difference(self.new)
        held = lacking.intersection(self.old)
        self.new |= {c: self.old[c] for c in held}
        lacking = list(lacking - held)
        if lacking:
            self.new |= zip(lacking, self.aligned(lacking, np.array(self.a.fast("".join(lacking)), np.int64), self.b.chunks(lacking)))

    def texts(self, texts: list[str]) -> list[tuple | None]:
        """aligned() of space and text for each text; None for no tokens."""
        out: list[tuple | None] = [None] * len(texts)
        parted, size = [], 0

        def flush():
            nonlocal parted, size
            self._fill(set().union(*(c for _, c in parted)))
            get = self.new.__getitem__
            for i, chunks in parted:
                found = list(map(get, chunks))
                if None in found:
                    out[i] = self.whole(texts[i])
                else:
                    shown, keys, n_a, n_b = zip(*found)
                    out[i] = ";".join(shown), b"".join(keys), sum(n_a), sum(n_b)
            parted, size = [], 0

        for i, text in enumerate(texts):
            if text and self.by_words and not _ODD_SPACE(text):
                parted.append((i, _CHUNK(" " + text)))
                size += len(text)
                if size >= TOGETHER:
                    flush()
            elif text:
                out[i] = self.whole(text)
        if parted:
            flush()
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners.clear()
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def pair_bound(bytes_a: list[bytes], bytes_b: list[bytes]) -> int:
    """At most so many pairs of ids can be linked: the bytes of one end with those of the other."""
    in_a, in_b = Counter(bytes_a), Counter(bytes_b)
    shorter_b = sum(in_b[x[i:]] for x in bytes_a for i in range(len(x)))
    shorter_a = sum(in_a[x[i:]] for x in bytes_b for i in range(1, len(x)))
    return shorter_b + shorter_a


_TEXTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("links", pa.binary())])


def _align(path_a: str, path_b: str, digest: bool):
    def run(batches):
        al = aligner(path_a, path_b)
        for rb in batches:
            rows = []
            for got in al.texts([raw.decode() for raw in utf8(rb.column("text"))]):
                if got is None:
                    rows.append((0, 0, 0, 0, "", b""))
                else:
                    shown, keys, n_a, n_b = got
                    rows.append((n_a, n_b, shown.count(";") + 1, len(keys) // al.width, sha256(shown.encode()).hexdigest() if digest else shown, keys))
            yield batch(_FOUND, [rb.column("doc_id"), *map(list, zip(*rows))] if rows else [[]] * 7)

    return run


def _counter(width: int):
    def run(batches):
        keys, counts, pending, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged():
            more, n = np.unique(np.concatenate(pending), return_counts=True)
            both = np.concatenate([keys, more.astype(np.uint64)])
            k, at = np.unique(both, return_inverse=True)
            return k, np.bincount(at, np.concatenate([counts, n])).astype(np.int64)

        for rb in batches:
            for raw in rb.column("links").to_pylist():
                pending.append(np.frombuffer(raw, f"<u{width}"))
                held += len(pending[-1])
            if held >= PENDING:
                keys, counts = merged()
                pending, held = [], 0
        if held:
            keys, counts = merged()
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].astype(np.int64)), pa.array(counts[i : i + (1 << 16)])], names=["key", "n"])

    return run


_SCORED = pa.schema([*list(_FOUND)[:5], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])


def _scorer(width: int, table):
    def run(batches):
        keys, counts, best = (np.frombuffer(x, t) for x, t in zip(table.value, ("<i8", "<i8", "?")))
        for rb in batches:
            n_best, total = [], []
            for raw in rb.column("links").to_pylist():
                at = np.searchsorted(keys, np.frombuffer(raw, f"<u{width}").astype(np.int64))
                n_best.append(int(best[at].sum()))
                total.append(int(counts[at].sum()))
            yield batch(_SCORED, [*(rb.column(c) for c in _FOUND.names[:5]), n_best, total, rb.column("groups")])

    return run


def texts(docs: DataFrame, path_a: str, path_b: str, *, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (their text, or its SHA-256), links (packed keys A id * size of B + B id): a row a row.

    A text that is null or empty, or that either tokenizer does not give back byte by byte, has no tokens: zeros and empty.
    A very long text takes memory in proportion. Repeated rows and null doc_ids are rows like any other. Other columns are not kept.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _align(path_a, path_b, digest), _TEXTS)


def pair_counts(found: DataFrame, width: int, size_b: int) -> DataFrame:
    """key, n, best: how many links hold each pair of ids, and whether that is the most for its B id. Counted in each task first."""
    n = arrow_map(found.select("links"), _counter(width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    n = written(n, "pairs")
    most = n.groupBy((F.col("key") % size_b).alias("b")).agg(F.max("n").alias("most"))
    return n.withColumn("b", F.col("key") % size_b).join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, *, digest: bool = False) -> DataFrame:
    """texts() without links, and n_best and count_sum over each row's links; the links lie in the shared folder between the two passes.

    The pair table goes to the tasks whole. It has at most pair_bound() rows, some 10 MB for these vocabularies whatever the corpus, which is checked.
    """
    import public_tokenizers

    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    ship(spark)
    al = aligner(path_a, path_b)
    found = written(texts(docs, path_a, path_b, digest=digest), "aligned")
    bound = pair_bound(al.a.bytes, al.b.bytes)
    table = pair_counts(found, al.width, len(al.b.bytes)).limit(bound + 1).toArrow().sort_by("key")
    if table.num_rows > bound:
        raise ValueError("more linked pairs than the vocabularies allow")
    columns = [table.column(c).to_numpy() for c in ("key", "n", "best")]
    sent = spark.sparkContext.broadcast([c.astype(t).tobytes() for c, t in zip(columns, ("<i8", "<i8", "?"))])
    return arrow_map(found, _scorer(al.width, sent), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def op12_interval_index(spark, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).withColumnRenamed("groups", "groups_sha256")
