"""Benchmark decontamination with suffix arrays of the training text.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. Each task cuts its documents into shards of about
SHARD_WORDS words (whole documents) and builds the suffix array of each, whatever the benchmark holds. Every suffix of
every benchmark item is then searched in it by bisection, which gives its longest verbatim match in the shard.
Where that has `window` words or more (or is all of a shorter item), the places that share the suffix's first `window`
words are the window's occurrences; documents with such a place are affected. Windows are taken item by item, so the
union of their occurrences is that of all matches of `window` words or more.

The benchmark lies in the shared folder and is read by the tasks in blocks of a bounded size, all blocks for each
shard; a benchmark of one block is kept by the worker. The documents are read once.

Null or empty texts have no words: such documents are clean and such items are never found. Items of one id are one item
(a null id is the empty string). Repeated documents are separate rows. An empty benchmark leaves every document clean.
A very long document is a shard of its own. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, arrow_map, batch, filesystem, new_path, utf8

#: Lower-cases A-Z and blanks what no word contains.
_CLEAN = bytes(32 if (c := LOWER[b]) <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for b in range(256))
SHARD_WORDS = 1 << 20
WINDOW = 10
BLOCK_BYTES = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


class Benchmark:
    """A block of items: their words as numbers of the block's vocabulary, one after another, and its suffixes that start a window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        vocab: dict[bytes, int] = defaultdict(count().__next__)
        self.names, seqs = [], []
        for item, text in items:
            seq = list(map(vocab.__getitem__, words_of(text)))
            if seq:
                self.names.append(item)
                seqs.append(seq)
        self.vocab = list(vocab)
        lengths = np.array([len(x) for x in seqs], np.int64)
        self.longest = int(lengths.max(initial=0))
        self.words = np.array([w for x in seqs for w in x], np.int64)
        ends = np.cumsum(lengths)
        starts = np.maximum(lengths - window + 1, 1)  # of each item: suffixes that start a window
        self.item = np.repeat(np.arange(len(seqs)), starts)
        self.pos = np.arange(len(self.item)) - np.repeat(np.cumsum(starts) - starts, starts)
        self.start = (ends - lengths)[self.item] + self.pos
        self.end = ends[self.item]
        self.need = np.minimum(window, lengths)[self.item]


class Shard:
    """The suffix array of whole documents, by words: word numbers in order of appearance, 0 at the end of each document.

    Suffixes are ordered by their first `depth` words or more: those that agree so far are sorted by the order of what
    follows, 1, 2, 4 and so on words on, until all differ or depth is reached.
    """

    def __init__(self, docs: list[list[bytes]], depth: int):
        self.vocab: dict[bytes, int] = defaultdict(count(1).__next__)
        number = self.vocab.__getitem__
        lengths = np.array([len(d) + 1 for d in docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.ids = np.zeros(self.starts[-1] + 1, np.int64)
        for at, d in zip(self.starts, docs):
            self.ids[at : at + len(d)] = np.fromiter(map(number, d), np.int64, len(d))
        self._sort(depth)

    def _sort(self, depth: int) -> None:
        ids, last = self.ids, len(self.ids) - 1
        order = np.flatnonzero(ids)
        order = order[np.argsort(ids[order], kind="stable")]
        n = len(order)
        rank = np.zeros(len(ids), np.int64)  # 1 and the place of the group's first suffix; 0 at the ends of documents
        at, here, new = np.arange(n), order, ids[order]
        k = 1
        while len(at):
            first = np.concatenate([[True], new[1:] != new[:-1]])
            group = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            rank[here] = at[group] + 1
            alone = first & np.concatenate([first[1:], [True]])
            at, here = at[~alone], here[~alone]
            if k >= depth or not len(at):
                break
            new = rank[here] * (n + 2) + rank[np.minimum(here + k, last)]
            by = np.argsort(new, kind="stable")
            here, new = here[by], new[by]
            order[at] = here
            k *= 2
        self.order = order

    def bisect(self, words: np.ndarray, start: np.ndarray, end: np.ndarray, after: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each words[start:end]: its place in the order, before (after: behind) all suffixes that begin with it, and the words it shares with the suffixes before and behind that place."""
        n = len(self.order)
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), n, np.int64)
        left, right = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            p, s, e = self.order[mid], start[todo], end[todo]
            shared = np.minimum(left[todo], right[todo])  # all suffixes between share that much
            go = np.arange(len(todo))
            while len(go):
                more = s[go] + shared[go] < e[go]
                go = go[more]
                go = go[self.ids[p[go] + shared[go]] == words[s[go] + shared[go]]]
                shared[go] += 1
            whole = s + shared == e
            less = np.full(len(todo), after)
            part = np.flatnonzero(~whole)
            less[part] = self.ids[p[part] + shared[part]] < words[s[part] + shared[part]]
            up, down = todo[less], todo[~less]
            lo[up], left[up] = mid[less] + 1, shared[less]
            hi[down], right[down] = mid[~less], shared[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo, left, right

    def matches(self, b: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of the block with a match that counts: their numbers, the length of the longest match, where the window's occurrences are in the order (from, to), and the block's words by this shard's numbers."""
        known = self.vocab.get
        words = np.array([known(w, -1) for w in b.vocab], np.int64)[b.words] if len(b.words) else b.words
        unknown = np.concatenate([[0], np.cumsum(words < 0)])
        which = np.flatnonzero(unknown[b.start + b.need] == unknown[b.start])  # a suffix with a word that the shard lacks ends there
        place, left, right = self.bisect(words, b.start[which], b.end[which])
        longest = np.maximum(left, right)
        found = longest >= b.need[which]
        which, longest = which[found], longest[found]
        stop = b.start[which] + b.need[which]
        low = self.bisect(words, b.start[which], stop)[0]
        high = self.bisect(words, b.start[which], stop, after=True)[0]
        return which, longest, low, high, words


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers in [low, high) of each pair, one after another."""
    size = high - low
    return np.repeat(low, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _stored(benchmark: DataFrame) -> tuple[str, int]:
    """Write the benchmark's ids and texts to the shared folder: where, and a bound on an item's words."""
    spark = benchmark.sparkSession
    path = new_path(spark, "benchmark")
    benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).write.parquet(path)
    most = spark.read.schema("item string, text string").parquet(path).agg(F.max(F.octet_length("text"))).first()[0]
    return path, (most or 0) // 2 + 1


_one_block: dict[tuple, Benchmark] = {}


def blocks(path: str, window: int, block_bytes: int):
    """The stored benchmark in blocks of at most that many bytes of text (a longer item is a block)."""
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    key = path, window, block_bytes
    if key in _one_block:
        yield _one_block[key]
        return
    store, folder = filesystem(path)
    held, size, n = [], 0, 0
    for name in sorted(ds.dataset(folder, filesystem=store, format="parquet").files):
        with store.open_input_file(name) as f:
            for rb in pq.ParquetFile(f).iter_batches(batch_size=256):
                for item, raw in zip(rb.column("item").to_pylist(), utf8(rb.column("text"))):
                    if held and size + len(raw) > block_bytes:
                        yield Benchmark(held, window)
                        held, size, n = [], 0, n + 1
                    held.append((item, raw))
                    size += len(raw)
    if held:
        last = Benchmark(held, window)
        if not n:
            _one_block.clear()
            _one_block[key] = last
        yield last


class _Shards:
    """Collects whole documents, about SHARD_WORDS words at a time."""

    def __init__(self, depth: int):
        self.depth, self.docs, self.n = depth, [], 0

    def add(self, texts: list[bytes]) -> bool:
        """Whether the shard is full."""
        for t in texts:
            self.docs.append(words_of(t))
            self.n += len(self.docs[-1])
        return self.n >= SHARD_WORDS

    def take(self) -> Shard:
        out = Shard(self.docs, self.depth)
        self.docs, self.n = [], 0
        return out


_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])


def _hits(shard: Shard, path: str, window: int, block_bytes: int) -> tuple[list[int], list[set]]:
    """Of each document of a shard: words hit, and ids of the items with windows in it."""
    n_docs = len(shard.starts) - 1
    marks, items = np.zeros(len(shard.ids) + 1, np.int64), [set() for _ in range(n_docs)]
    for b in blocks(path, window, block_bytes):
        which, _, low, high, _ = shard.matches(b)
        # Equal windows have equal ranges: their places are looked at once, and their items together.
        kinds, of = np.unique(np.stack([low, high, b.need[which]]), axis=1, return_inverse=True)
        names: list[set] = [set() for _ in range(kinds.shape[1])]
        for k, j in zip(of.ravel().tolist(), b.item[which].tolist()):
            names[k].add(b.names[j])
        for k, (lo, hi, need) in enumerate(kinds.T.tolist()):
            at = shard.order[lo:hi]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + need, -1)
            for d in np.unique(np.searchsorted(shard.starts, at, "right") - 1).tolist():
                items[d] |= names[k]
    hit = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
    return (hit[shard.starts[1:]] - hit[shard.starts[:-1]]).tolist(), items


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item, or all of a shorter one.
    """
    path, depth = _stored(benchmark)

    def run(batches):
        shards, rows = _Shards(depth), []

        def close():
            shard = shards.take()
            hits, items = _hits(shard, path, window, block_bytes)
            return batch(_HITS, [rows, np.diff(shard.starts) - 1, hits, [sorted(x) for x in items]])

        for rb in batches:
            rows += rb.column("doc_id").to_pylist()
            if shards.add(utf8(rb.column("text"))):
                yield close()
                rows = []
        if rows:
            yield close()

    found = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_hit long, items array<string>")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_MATCH = pa.schema([("item_id", pa.string()), ("item_pos", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("doc_pos", pa.int64())])


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each suffix of each item that is found with `window` words or more (or the whole of a shorter item): the
    longest verbatim match in the corpus and its place (least doc_id, null before all, then least position). Distances are in words."""
    path, depth = _stored(benchmark)

    def run(batches):
        shards, rows = _Shards(depth), []

        def close():
            shard, out = shards.take(), []
            for b in blocks(path, window, block_bytes):
                which, longest, _, _, words = shard.matches(b)
                stop = b.start[which] + longest
                low, high = (shard.bisect(words, b.start[which], stop, after)[0] for after in (False, True))
                for j, n, lo, hi in zip(which.tolist(), longest.tolist(), low.tolist(), high.tolist()):
                    at = shard.order[lo:hi]
                    of = np.searchsorted(shard.starts, at, "right") - 1
                    doc, pos = min(((rows[d] is not None, rows[d] or 0), p) for d, p in zip(of.tolist(), (at - shard.starts[of]).tolist()))
                    out.append((b.names[b.item[j]], int(b.pos[j]), n, doc[1] if doc[0] else None, pos))
            return batch(_MATCH, [list(c) for c in zip(*out)] if out else [[]] * 5)

        for rb in batches:
            rows += rb.column("doc_id").to_pylist()
            if shards.add(utf8(rb.column("text"))):
                yield close()
                rows = []
        if rows:
            yield close()

    every = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "item_id string, item_pos long, length long, doc_id long, doc_pos long")
    best = F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "doc_pos")).alias("b")
    return every.groupBy("item_id", "item_pos").agg(best).select("item_id", "item_pos", (-F.col("b.less")).alias("length"), "b.doc_id", "b.doc_pos")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no benchmark window, without a shuffle; all columns stay, whatever their names."""
    path, depth = _stored(benchmark)

    def run(batches):
        shards, held = _Shards(depth), []

        def close():
            hits, _ = _hits(shards.take(), path, window, block_bytes)
            at = 0
            for rb in held:
                yield rb.filter(pa.array([h == 0 for h in hits[at : at + rb.num_rows]], pa.bool_()))
                at += rb.num_rows

        for rb in batches:
            held.append(rb)
            if shards.add(utf8(rb.column("text"))):
                yield from close()
                held = []
        if held:
            yield from close()

    return arrow_map(docs, run, docs.schema)


def op9_suffix_arrays(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB: windows of 10 words (all of a shorter item) joined by their words.
SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as key from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
ks as (select distinct k from iw),
dw as (select r, i, k, array_to_string(w[i : i + k - 1], ' ') as key from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
m as (select r, i, k, item from dw join iw using (k, key)),
h as (select r, count(distinct p)::bigint as n_hit from (select r, unnest(range(i, i + k)) as p from m) group by 1),
t as (select r, count(*)::bigint as n_items, sha256(string_agg(item, ',' order by item)) as sha from (select distinct r, item from m) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join h using (r) left join t using (r)
"""


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """For tests: doc_id -> (n_words, n_hit, item ids), by plain comparison."""
    out = {}
    for doc_id, text in docs:
        w = words_of((text or "").encode())
        hit, names = set(), []
        for item, t in items:
            x = words_of((t or "").encode())
            n = min(window, len(x))
            places = [i for at in range(len(x) - n + 1) for i in range(len(w) - n + 1) if n and w[i : i + n] == x[at : at + n]]
            if places:
                names.append(str(item))
                hit.update(i + j for i in places for j in range(n))
        out[doc_id] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    return out
