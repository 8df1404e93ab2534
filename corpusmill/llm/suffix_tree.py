"""Substring dedup with prefix-partitioned suffix trees: words in long repeats go, in every place.

Suffixes are parted by a prefix: the words of an anchor (see repeats), then, in groups that are too large for a
task, longer ones. Each group's suffixes form one subtree, built from their order and common prefixes. An internal
node of depth d says that d words repeat; with the words that two of its leaves share before the prefix, the node
is a maximal repeat, and where that is WINDOW words or more, the words it covers are removed at those leaves.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats
from .common import batch, utf8
from .suffix_array import shared_length

WINDOW = 35
GRAM = 18
#: Suffixes in a subtree that is built in one piece; larger groups are split by longer prefixes.
GROUP = 2000


def subtree(suffixes: list) -> list[tuple[int, int, int]]:
    """Internal nodes of the tree of sorted suffixes: (depth, first leaf, end leaf), by depth from the leaves up; the root is one."""
    nodes, open_ = [], [(0, 0)]
    for k in range(1, len(suffixes) + 1):
        depth = shared_length(suffixes[k - 1], suffixes[k]) if k < len(suffixes) else 0
        first = k - 1
        while open_ and open_[-1][0] > depth:
            d, first = open_.pop()
            nodes.append((d, first, k))
        if not open_ or open_[-1][0] < depth:
            open_.append((depth, first))
    nodes.append((0, 0, len(suffixes)))
    return nodes


def repeats_in(group: list[tuple], window: int = WINDOW, gram: int = GRAM):
    """group: (doc, at, n_same, context). Yields (index, start, end) in words for the leaves of deep nodes."""
    words = [ctx.split(b" ") for _, _, _, ctx in group]
    backs = [at >> 8 & 255 for _, at, _, _ in group]
    left = [w[:k][::-1] for w, k in zip(words, backs)]
    right = [w[k + gram :] for w, k in zip(words, backs)]
    order = sorted(range(len(group)), key=right.__getitem__)
    for depth, first, end in subtree([right[i] for i in order]):
        need = window - gram - depth
        leaves = sorted((i for i in order[first:end] if len(left[i]) >= need), key=left.__getitem__)
        if len(leaves) < 2:
            continue
        gaps = [0, *(shared_length(left[x], left[y]) for x, y in zip(leaves, leaves[1:])), 0]
        for k, i in enumerate(leaves):
            n = max(gaps[k], gaps[k + 1])
            if n >= need and group[i][2] == 1:
                yield i, backs[i] - n, backs[i] + gram + depth


def _longer_prefixes(found: DataFrame, window: int, gram: int) -> DataFrame:
    """Groups of more than GROUP suffixes are parted by prefixes that are longer by some words.

    Two places that share a window share L words before the anchor and R after its gram, L + R >= window - gram.
    For each step t, those with R of step * t or more and L of what is then still needed at least share a longer
    prefix (counted from L words before the anchor), so each such pair meets in one of the steps' groups.
    """
    rest = window - gram
    step = -(-rest // 4)
    size = F.count(F.lit(1)).over(repeats.W.partitionBy("h"))
    sized = found.withColumn("big", size > GROUP)
    small = sized.where(~F.col("big")).drop("big")
    big = sized.where("big").drop("big")
    back = F.shiftright("at", 8).bitwiseAND(F.lit(255)).cast("int")
    words = F.split(F.col("context").cast("string"), " ")
    keys = []
    for t in range(4):
        r = step * t
        l = max(0, rest - step * (t + 1) + 1)
        enough = (back >= l) & (F.size(words) >= back + gram + r)
        keys.append(F.when(enough, F.xxhash64("h", F.lit(t), F.array_join(F.slice(words, F.greatest(back - l + 1, F.lit(1)), gram + l + r), " "))))
    big = big.withColumn("h", F.explode(F.array(*keys))).where("h is not null")
    return small.unionAll(big.select(*small.columns))


def removed_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The keyed rows, and marks (doc, tag, start, end) over all words in windows that occur more than once."""
    rows = repeats.keyed(docs)
    found = repeats.shared_anchors(rows, repeats.word_symbols, window, gram, "word-anchors")
    again = repeats.whole_contexts(found, F.col("n_same") > 1)
    several = found.where("nth = 1 and n_ctx > 1 and alone").select("h", "doc", "at", "n_same")
    parts = _longer_prefixes(repeats.contexts(rows, several, repeats.word_slice), window, gram)
    partly = repeats.solved(parts, lambda group: repeats_in(group, window, gram))
    return rows, again.unionAll(partly)


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    for rb in batches:
        cols = [[], [], []]
        for text, starts, ends in zip(utf8(rb.column("text")), rb.column("starts").to_pylist(), rb.column("ends").to_pylist()):
            words, kept, at = text.split(), [], 0
            for a, b in repeats.runs(starts or [], ends or []):
                kept += words[at:a]
                at = b
            kept += words[at:]
            for to, x in zip(cols, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                to.append(x)
        yield batch(schema, [rb.column("doc_id"), *cols])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of documents.

    Null or empty text, or one of fewer than `window` words: nothing removed. Repeated rows repeat each other, so
    both lose their words. Empty table: no rows. Other columns are not kept.
    """
    rows, marks = removed_words(docs, window, gram)
    rows = rows.withColumn("doc_id", F.when(F.col("doc") != repeats.LEAST, F.col("doc")))
    return repeats.removed(rows, ["doc_id"], marks, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_prefix_trees(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB: windows of 35 words counted by their words.
SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, i, array_to_string(w[i : i + 34], ' ') as key from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
g as (select r, i from s where key in (select key from s group by key having count(*) > 1)),
hit as (select distinct r, unnest(range(i, i + 35)) as p from g),
p as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
k as (select r, count(*)::bigint as n, string_agg(word, ' ' order by p) as kept from p anti join hit using (r, p) group by 1)
select doc_id, len(w)::bigint as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (r)
"""


def brute_force(docs: list[tuple], window: int = WINDOW) -> dict:
    """For tests: doc_id -> (n_words, n_removed, kept_sha256)."""
    from collections import Counter

    lists = {d: (t or "").encode().split() for d, t in docs}
    seen = Counter(tuple(w[i : i + window]) for w in lists.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in lists.items():
        hit = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                hit[i : i + window] = b"\1" * window
        out[d] = (len(w), sum(hit), hashlib.sha256(b" ".join(x for x, h in zip(w, hit) if not h)).hexdigest())
    return out
