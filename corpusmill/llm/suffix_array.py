"""Suffix-array dedup: linear grouping construction, and removal of bytes that repeat earlier ones.

`sort_suffixes` sorts the suffixes of a sequence by grouping: suffixes are put in groups by their longest Lyndon
prefix, group by group in descending order, with each suffix's pointer to the last earlier suffix of a lower
group; then one sweep emits the order of each group along the pointers. Nothing is renamed and no recursion runs.

The corpus is cut into texts for it by anchors (see repeats): for each anchor that several places share, the
different contexts. There, contexts are written in symbols that are the edges of the tries of what stands before
and after the anchor, so that shared stretches start and end at symbols and the sequence stays short.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats
from .common import batch, utf8

LENGTH = 100
GRAM = 32


def sort_suffixes(text: list[int]) -> list[int]:
    """The suffix array of text, whose last symbol must be its least and occur once."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, last = [0] * n, [0] * n, [0] * n  # last[g]: where the group that starts at g ends
    g = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            last[g] = k
            g = k
        place[i], group[i] = k, g
    if n:
        last[g] = n
    before = [-2] * n  # the last earlier suffix of a lower group, once known
    stop = n
    while stop > 0:
        g = group[order[stop - 1]]
        pointed: dict[int, int] = {}
        for i in order[g:stop]:
            if before[i] == -2:
                chain = [i]  # members of this group that point to one place
                while True:
                    j = chain[-1] - 1
                    while j >= 0 and group[j] > g:
                        j = before[j]
                    if j < 0 or group[j] < g:
                        break
                    if before[j] != -2:
                        j = before[j]
                        break
                    chain.append(j)
                for k in chain:
                    before[k] = j
            j = before[i]
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        parts: dict[int, dict[int, list[int]]] = {}
        for j, times in pointed.items():
            parts.setdefault(times, {}).setdefault(group[j], []).append(j)
        keys = [(t, low) for t in range(max(parts), 0, -1) for low in parts.get(t, ())] if parts else []
        for t, low in keys:
            members = parts[t][low]
            high = last[low]
            new = high - len(members)
            if new == low:
                continue
            to = high
            inside = {place[j] for j in members if place[j] >= new}
            moving = [j for j in members if place[j] < new]
            for j in moving:  # swap with one that stays
                to -= 1
                while to in inside:
                    to -= 1
                other, at = order[to], place[j]
                order[to], order[at] = j, other
                place[j], place[other] = to, at
            last[low], last[new] = new, high
            for j in members:
                group[j] = new
        stop = g
    out, free, done = [0] * n, list(range(n)), [False] * n
    if n:
        out[0], done[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Symbols that each suffix of the order shares with the one before it."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def shared_length(a, b) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def branches(strings: list) -> list[list[int]]:
    """For each string, the depths on its path in the strings' trie where another string leaves it, ascending."""
    by = sorted(range(len(strings)), key=strings.__getitem__)
    near = [shared_length(strings[x], strings[y]) for x, y in zip(by, by[1:])]
    out: list[set[int]] = [set() for _ in strings]
    for seq, gaps in ((by, near), (by[::-1], near[::-1])):
        path: list[int] = []
        for x, gap in zip(seq[1:], gaps):
            while path and path[-1] > gap:
                path.pop()
            if not path or path[-1] < gap:
                path.append(gap)
            out[x].update(path)
    return [sorted(x - {0}) for x in out]


def earlier_matches(group: list[tuple], length: int = LENGTH, gram: int = GRAM):
    """group: (doc, at, n_same, context) in order of place. Yields (index, start, end) of what also starts in an earlier one, for matches of `length` or more."""
    backs = [at >> 8 & 255 for _, at, _, _ in group]
    left = [ctx[:k][::-1] for k, (_, _, _, ctx) in zip(backs, group)]
    right = [ctx[k + gram :] for k, (_, _, _, ctx) in zip(backs, group)]
    lefts, rights = branches(left), branches(right)
    text: list[int] = []
    sizes: list[int] = []
    owner: list[int] = []
    starts: list[int] = []
    used = [i for i in range(len(group)) if (lefts[i][-1] if lefts[i] else 0) + gram + (rights[i][-1] if rights[i] else 0) >= length]
    if len(used) < 2:
        return
    base = len(used)
    names: dict = {None: base}
    name, more, size, at_, own = names.setdefault, text.append, sizes.append, starts.append, owner.append
    for rank, i in enumerate(used):
        at, string, b = backs[i], left[i], 0
        cuts = lefts[i]
        for k in range(len(cuts) - 1, -1, -1):
            b = cuts[k]
            more(name((0, string[:b]), base + len(names)))
            size(b - (cuts[k - 1] if k else 0))
            at_(at - b)
            own(rank)
        more(base)
        size(gram)
        at_(at)
        own(rank)
        at, string, a = at + gram, right[i], 0
        for b in rights[i]:
            more(name((1, string[:b]), base + len(names)))
            size(b - a)
            at_(at + a)
            own(rank)
            a = b
        more(base - 1 - rank)
        size(0)
        at_(0)
        own(rank)
    order = sort_suffixes(text)
    shared = common_prefixes(text, order)
    upto = [0, *accumulate(sizes)]
    best: dict[int, int] = {}
    for sequence, gaps in ((order, shared), (order[::-1], [0, *shared[:0:-1]])):
        # owners ascend on the stack, each with the symbols it shares with the one below; the nearest earlier owner is on top
        owners: list[int] = []
        below: list[int] = []
        for i, gap in zip(sequence, gaps):
            mine = owner[i]
            while owners and owners[-1] >= mine:
                owners.pop()
                least = below.pop()
                if least < gap:
                    gap = least
            if owners and gap:
                n = upto[i + gap] - upto[i]
                if n >= length and n > best.get(i, 0):
                    best[i] = n
            owners.append(mine)
            below.append(gap)
    # What overlaps within one context is one mark; places ascend with i.
    last, low, high = -1, 0, 0
    for i in sorted(best):
        a = starts[i]
        if owner[i] == last and a <= high:
            high = max(high, a + best[i])
        else:
            if last >= 0:
                yield used[last], low, high
            last, low, high = owner[i], a, a + best[i]
    if last >= 0:
        yield used[last], low, high


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for rb in batches:
        cols = [[], [], [], []]
        for text, starts, ends in zip(utf8(rb.column("text")), rb.column("starts").to_pylist(), rb.column("ends").to_pylist()):
            spans = repeats.runs(starts or [], ends or [])
            kept = kept_text(text, spans)
            for to, x in zip(cols, (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())):
                to.append(x)
        yield batch(schema, [rb.column("doc_id"), *cols])


def kept_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The keyed rows, and marks (doc, tag, start, end) over all bytes that a string of `length` bytes covers that also starts earlier."""
    rows = repeats.keyed(docs)
    found = repeats.shared_anchors(rows, repeats.byte_symbols, length, gram, "anchors")
    again = repeats.whole_contexts(found, F.col("nth") > 1)
    several = found.where("nth = 1 and n_ctx > 1").select("h", "doc", "at", "n_same")
    partly = repeats.solved(repeats.contexts(rows, several, repeats.byte_slice), lambda group: earlier_matches(group, length, gram))
    return rows, again.unionAll(partly)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of documents.

    Null text: empty. Texts shorter than `length`: nothing removed. Null doc_id comes before all others. Rows with
    equal doc_id and text count as one document and get the same result; rows with equal doc_id and other text are
    documents in the order of a hash of the text. Empty table: no rows. Other columns are not kept.
    """
    rows, marks = repeated_spans(docs, length, gram)
    rows = rows.withColumn("doc_id", F.when(F.col("doc") != repeats.LEAST, F.col("doc")))
    return repeats.removed(rows, ["doc_id"], marks, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_linear_grouping(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB: 100-byte strings, numbered by place among equal ones (by a 64-bit hash).
SQL = r"""
with d as (select row_number() over (order by doc_id nulls first, text) as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select r, i, hash(substr(h, 2 * i + 1, 200)) as key from (select r, h, unnest(range(0, length(h) // 2 - 99)) as i from d where length(h) >= 200)),
e as (select r, i from (select r, i, row_number() over (partition by key order by r, i) as n from s) where n > 1),
m as (select r, i, max(i) over (partition by r order by i rows between unbounded preceding and 1 preceding) as prev from e),
g as (select r, i, sum(case when prev is null or i > prev + 100 then 1 else 0 end) over (partition by r order by i) as run from m),
z as (select r, run, min(i) as a, max(i) + 100 as b from g group by 1, 2),
y as (select r, count(*)::bigint as n_spans, sum(b - a)::bigint as n_removed, list(a order by a) as starts, list(b order by a) as ends from z group by 1),
k as (select d.r, array_to_string(list_transform(generate_series(1, len(starts) + 1), lambda j: substr(h, 2 * (case when j = 1 then 0 else ends[j - 1] end) + 1, 2 * ((case when j > len(starts) then length(h) // 2 else starts[j] end) - (case when j = 1 then 0 else ends[j - 1] end)))), '') as kept from d join y using (r))
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join y using (r) left join k using (r)
"""


def brute_force(docs: list[tuple], length: int = LENGTH) -> dict:
    """For tests: doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        hit = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                hit[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        out[doc_id] = (len(raw), sum(hit), sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1])), hashlib.sha256(kept).hexdigest())
    return out
