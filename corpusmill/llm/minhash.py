"""MinHash near-dedup with circulant permutations and exact verification.

Two permutations of a universe of 2^20 places make a whole signature: the first scatters a document's shingles,
the second is shifted circularly by one place for each coordinate, so the K values of a shingle are one slice of K
neighbours in the second permutation, and a signature is the minimum of such slices. Bands of ROWS coordinates
propose pairs; a byte of each coordinate estimates their similarity; pairs that could reach the threshold are
confirmed on full shingle sets, by hashes first and then word by word; confirmed links are joined to components.

Rows with equal sets (128 bits of hash over the set, and its size) are one class before any pair is made, and one row
of a class, its head, stands for it. In a band's bucket every head is compared with the bucket's most central one; after
the components of those links are known, only heads of one bucket that are still in different components are
compared with each other, large buckets in parts. So a group of copies costs as many pairs as it has documents, and
no pair that a bucket proposes and that could join two components is left out.

Minima of a key are aggregated before they are shuffled, written, and joined back: a join of plain exchanges, which AQE
splits where a key is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import DoubleType

from .common import BASES, LOWER, arrow_map, batch, grams, mix64, slices, utf8, written
from .components import components
from .repeats import LEAST, word_symbols

BANDS, ROWS = 36, 5
K = BANDS * ROWS
UNIVERSE = 1 << 20
#: Share of equal bytes in two signatures below which a pair is not verified: six standard errors below 0.8.
ESTIMATE = 0.62
#: Rows of a bucket that one task compares with each other; parts of larger buckets meet in tasks of their own.
CELL = 2000
#: Coordinates of a finer estimate, for documents that a bucket holds in different components, and its bound: five standard errors below 0.8.
FINE, FINE_ESTIMATE = 1280, 0.74

_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def permutations(k: int = K, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all slices of k neighbours of the circular one."""
    if (k, seed) not in _tables:
        rng = np.random.default_rng(seed)
        scatter, circle = rng.permutation(UNIVERSE), rng.permutation(UNIVERSE).astype(np.uint32)
        _tables[k, seed] = scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([circle, circle[: k - 1]]), k)
    return _tables[k, seed]


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the distinct runs of `words` words of the lower-cased text (of all its words, if fewer), ascending."""
    s = word_symbols(text.translate(LOWER))
    if not len(s):
        return np.zeros(0, np.uint64)
    return np.unique(grams(s, words, BASES[1]) if len(s) >= words else slices(s, np.array([0]), np.array([len(s)]), BASES[1]))


def signature(shingle_hashes: np.ndarray, k: int = K) -> np.ndarray:
    scatter, rows = permutations(k)
    at = scatter[(shingle_hashes >> np.uint64(44)).astype(np.int64)]
    out = rows[at[:1024]].min(axis=0)
    for i in range(1024, len(at), 1024):
        np.minimum(out, rows[at[i : i + 1024]].min(axis=0), out=out)
    return out


_SETS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sets(words: int):
    def run(batches):
        lanes = np.arange(K, dtype=np.uint64).reshape(BANDS, ROWS)
        for rb in batches:
            out = [[], [], [], [], []]
            for text in utf8(rb.column("text")):
                s = shingles(text, words)
                if len(s):
                    sig = signature(s)
                    bands = mix64(mix64(sig.astype(np.uint64).reshape(BANDS, ROWS) + (lanes << np.uint64(32))).sum(1, dtype=np.uint64)).view(np.int64)
                    row = len(s), int(mix64(s).sum(dtype=np.uint64).view(np.int64)), int(mix64(s ^ np.uint64(BASES[0])).sum(dtype=np.uint64).view(np.int64)), bands, sig.astype(np.uint8).tobytes()
                else:
                    row = 0, None, None, None, None
                for to, x in zip(out, row):
                    to.append(x)
            yield batch(_SETS, [rb.column("doc"), rb.column("tag"), *out])

    return run


def shingle_set(text: bytes, words: int) -> set[tuple]:
    """The shingles themselves."""
    w = text.translate(LOWER).split()
    return set(zip(*(w[i:] for i in range(words)))) if len(w) >= words else {tuple(w)} if w else set()


def _verify(words: int, percent: int):
    """Rows with two texts (y, text_y, x, text_x), y in runs -> the pairs that are links."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def enough(a: int, b: int, both: int) -> bool:
        return 100 * both >= percent * (a + b - both)

    def run(batches):
        held, mine, whole = None, None, None
        for rb in batches:
            u, v = [], []
            ys, xs = rb.column("y").to_pylist(), rb.column("x").to_pylist()
            for y, x, ty, tx in zip(ys, xs, utf8(rb.column("text_y")), utf8(rb.column("text_x"))):
                if y != held:
                    held, mine, whole = y, shingles(ty, words), None
                other = shingles(tx, words)
                if enough(len(mine), len(other), len(mine) + len(other) - len(np.union1d(mine, other))):
                    whole = whole or shingle_set(ty, words)
                    exact = shingle_set(tx, words)
                    if enough(len(whole), len(exact), len(whole & exact)):
                        u.append(x)
                        v.append(y)
            yield batch(schema, [u, v])

    return run


def _fine(words: int):
    """Rows (doc, text) -> doc and the bytes of its finer signature."""
    schema = pa.schema([("doc", pa.int64()), ("fine", pa.binary())])

    def run(batches):
        for rb in batches:
            yield batch(schema, [rb.column("doc"), [signature(shingles(t, words), FINE).astype(np.uint8).tobytes() for t in utf8(rb.column("text"))]])

    return run


def _cross(batches):
    """Rows (cell, bucket, own, doc, root, bands, fine) in runs of one cell -> pairs of documents of different roots that may be links. A pair comes from the first band alone that both share.

    A cell is a bucket, or two parts of a large one (own: the row's part; null in a cell of one part, where all rows meet).
    """
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def close(bucket, parts, docs, roots, bands, fine):
        if len(set(roots)) < 2:
            return [], []
        d, r, lanes, s = np.array(docs), np.array(roots), np.array(bands), np.frombuffer(b"".join(fine), np.uint8).reshape(len(docs), FINE)
        part = None if parts[0] is None else np.array(parts)
        kinds, of, sizes = np.unique(r, return_inverse=True, return_counts=True)
        coarse, xs, ys = np.ascontiguousarray(s[:, :K]), [], []
        most = int(sizes.argmax())
        for i in np.flatnonzero(of != most):  # the largest component's members meet all others from their side
            meets = (of != of[i]) & ((of == most) | (np.arange(len(d)) < i))
            at = np.flatnonzero(meets if part is None else meets & (part != part[i]))
            for k in range(0, len(at), 8192):
                some = at[k : k + 8192]
                some = some[(coarse[some] == coarse[i]).sum(1) >= ESTIMATE * K]
                some = some[(s[some] == s[i]).sum(1) >= FINE_ESTIMATE * FINE]
                same = lanes[some] == lanes[i]
                hit = some[lanes[i][same.argmax(1)] == bucket]
                xs += [int(d[i])] * len(hit)
                ys += d[hit].tolist()
        return xs, ys

    held, rows, out = None, ([], [], [], [], []), ([], [])
    for rb in batches:
        for cell, bucket, *x in zip(*[rb.column(i).to_pylist() for i in range(7)]):
            if (cell, bucket) != held:
                for to, more in zip(out, close(held[1], *rows) if held else ()):
                    to += more
                held, rows = (cell, bucket), ([], [], [], [], [])
                if len(out[0]) > 50_000:
                    yield batch(schema, list(out))
                    out = ([], [])
            for to, y in zip(rows, x):
                to.append(y)
    for to, more in zip(out, close(held[1], *rows) if held else ()):
        to += more
    yield batch(schema, list(out))


@arrow_udf(DoubleType())
def _agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal bytes of two signatures."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, K) for c in (a, b))
    return pa.array((x == y).mean(axis=1))


def _cells(apart: DataFrame) -> DataFrame:
    """Adds cell and own. Buckets of more than CELL rows come in parts: a row is in a cell for its part with each part."""
    parts = F.ceil(F.col("n") / CELL).cast("int")
    sized = apart.join(written(apart.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "sizes"), "bucket")
    sized = sized.withColumn("part", F.pmod(F.xxhash64("doc"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cell = (F.least("part", "other") * parts + F.greatest("part", "other")).cast("long")
    return sized.select("bucket", "doc", "root", cell.alias("cell"), F.when(F.col("part") != F.col("other"), F.col("part")).alias("own"))


def links(heads: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """u, v: confirmed links that join all documents which confirmed pairs of a bucket join.

    heads: doc (a unique key), id, tag, bands, sketch, one row for each different set. rows: id, tag, text, where id and tag name a text.
    """
    exploded = heads.select("doc", F.explode("bands").alias("bucket"))
    sizes = written(exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    in_buckets = written(exploded.join(sizes, "bucket"), "buckets")
    central = written(in_buckets.groupBy("doc").agg(F.sum("size").alias("central")), "central")
    weighed = in_buckets.select("doc", "bucket").join(central, "doc")
    leaders = written(weighed.groupBy("bucket").agg(F.max(F.struct("central", (-F.col("doc")).alias("least"))).alias("top")).select("bucket", (-F.col("top.least")).alias("y")), "leaders")
    stars = in_buckets.select("bucket", F.col("doc").alias("x")).join(leaders, "bucket").where("x <> y").select("x", "y").distinct()
    sketch = lambda doc, name: heads.select(F.col("doc").alias(doc), F.col("sketch").alias(name))
    stars = stars.join(sketch("x", "sx"), "x").join(sketch("y", "sy"), "y")
    stars = written(stars.where(_agreement("sx", "sy") >= ESTIMATE).select("x", "y"), "stars")
    wanted = heads.select("doc", "id", "tag").join(central.select("doc"), "doc")
    texts = written(rows.join(wanted, ["id", "tag"]).groupBy("doc").agg(F.first("text").alias("text")), "candidates")

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_x = pairs.join(texts.select(F.col("doc").alias("x"), F.col("text").alias("text_x")), "x")
        both = with_x.join(texts.select(F.col("doc").alias("y"), F.col("text").alias("text_y")), "y")
        return arrow_map(both.select("y", "text_y", "x", "text_x"), _verify(words, percent), "u long, v long")

    first = written(confirmed(stars), "links")
    roots = components(first)
    rooted = in_buckets.select("bucket", "doc").join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("root", "doc").alias("root"))
    rooted = written(rooted, "rooted")
    mixed = written(rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket"), "mixed")
    apart = written(rooted.join(mixed, "bucket"), "apart")
    fine = arrow_map(texts.join(apart.select("doc").distinct(), "doc", "left_semi").select("doc", "text"), _fine(words), "doc long, fine binary")
    marked = heads.select("doc", "bands").join(fine, "doc")
    cells = _cells(apart).join(marked, "doc").select("cell", "bucket", "own", "doc", "root", "bands", "fine").repartition("cell", "bucket").sortWithinPartitions("bucket", "cell", "doc")
    more = arrow_map(cells, _cross, "x long, y long").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    known = stars.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    second = confirmed(written(more.join(known, ["x", "y"], "left_anti"), "pairs"))
    return first.unionAll(second)


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of documents.

    A document's set: distinct shingles of `words` words, the whole sequence where there are fewer. Links: 100 times the
    common shingles are `percent` times all of the two sets or more. Null or empty text: no set, linked with nothing.
    Rows of one doc_id are one document here: each text of it is searched for links, and they share a component. A null
    doc_id is such an id, returned as null and the least of all. Very long texts are read whole. Empty table: no rows. Other columns are not kept.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    made = arrow_map(rows, _sets(words), "doc long, tag long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary")
    sets = written(made.withColumn("row", F.monotonically_increasing_id()), "sets")
    full = sets.where("n_shingles > 0")
    classes = written(full.groupBy("s1", "s2", "n_shingles").agg(F.min("row").alias("head")), "classes")
    first = F.col("row") == F.col("head")
    member = full.join(classes, ["s1", "s2", "n_shingles"]).select("row", "head", "doc", "tag", "n_shingles", F.when(first, F.col("bands")).alias("bands"), F.when(first, F.col("sketch")).alias("sketch"))
    member = written(member, "members")
    heads = member.where("row = head").select(F.col("row").alias("doc"), F.col("doc").alias("id"), "tag", "bands", "sketch")
    linked = links(heads, rows.withColumnRenamed("doc", "id"), words, percent)
    every = member.select("row", "head", "doc", "n_shingles").unionAll(sets.where("n_shingles = 0").select("row", F.col("row").alias("head"), "doc", "n_shingles"))
    several = written(every.groupBy("doc").agg(F.min("head").alias("v"), F.max("head").alias("last")).where("v <> last").select("doc", "v"), "several")
    same_id = every.join(several, "doc").where("head <> v").select(F.col("head").alias("u"), "v").distinct()
    roots = written(components(linked.unionAll(same_id)), "roots")
    rooted = every.join(roots.withColumnRenamed("node", "head"), "head", "left").select("doc", "n_shingles", F.coalesce("root", "head").alias("root"))
    least = written(rooted.groupBy("root").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    out = rooted.join(least, "root", "left").select("doc", "n_shingles", F.coalesce("least", "doc").alias("least"))
    back = lambda c: F.when(c != LEAST, c)
    return out.select(back(F.col("doc")).alias("doc_id"), "n_shingles", back(F.col("least")).alias("component_id"), (F.col("least") == F.col("doc")).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay when each group of near duplicates keeps its least doc_id; all columns stay."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def op8_circulant(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)


#: DuckDB: all pairs with a common shingle, and what each document reaches over links.
SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) >= 4 then array_to_string(w[i : i + 3], ' ') else array_to_string(w, ' ') end as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*)::bigint as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
l as (select a, b from e union all select b, a from e),
reach as (select doc_id as root, doc_id as node from n union select root, l.b from reach join l on l.a = reach.node and l.b > reach.root),
f as (select node, min(root) as root from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(f.root, d.doc_id) as component_id, coalesce(f.root, d.doc_id) = d.doc_id as kept from d left join n using (doc_id) left join f on f.node = d.doc_id
"""


def brute_force(docs: list[tuple], words: int = 4, percent: int = 80) -> dict:
    """For tests: doc_id -> (n_shingles, component_id, kept)."""
    sets = {}
    for d, t in docs:
        w = (t or "").encode().translate(LOWER).split()
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}
