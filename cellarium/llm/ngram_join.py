"""Similarity join of documents on the Jaccard likeness of their word n-grams.

Documents with the same set of n-grams form a class; classes are joined by MinHash
banding and every candidate pair is verified on the full sets. Texts travel only for
classes that have a candidate. Pairs are compared inside tasks, in blocks of bounded
size, and leave them as counts and as a few edges that keep the classes connected, so
that a group of thousands of near copies never becomes millions of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, cut_lineage, may_be_among, sliced, tidy

U64 = np.uint64


def choose_bands(threshold: float, recall: float = 0.9999, most_hashes: int = 128) -> tuple[int, int]:
    """Bands and rows a band: the most rows (fewest false candidates) for which a pair
    at ``threshold`` becomes a candidate with probability ``recall`` at least, within
    ``most_hashes`` hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the white-space separated words, in order; null gives none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ngram_sets(words: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each list of word hashes, one after the other,
    and where each begins (and the last ends). Fewer than n words are one n-gram."""
    ends = words.offsets.to_numpy()
    flat = words.values.to_numpy(zero_copy_only=False).view(U64)[ends[0] : ends[-1]]
    ends = (ends - ends[0]).astype(np.int64)
    counts = np.diff(ends)
    grams = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(grams)])
    row = np.repeat(np.arange(len(counts)), grams)
    at = ends[:-1][row] + np.arange(starts[-1]) - starts[:-1][row]
    inside = np.minimum(counts[row], n)
    value = np.zeros(len(at), U64)
    for k in range(n):
        more = inside > k
        place = np.minimum(at + k, max(len(flat) - 1, 0))
        step = _mix(flat[place] + U64(k + 1)) if len(flat) else value
        value = np.where(more, _mix(value * U64(0x9E3779B97F4A7C15) + step), value)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


def band_hashes(sets: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash for each set and band; sets must not be empty."""
    random = np.random.default_rng(seed)
    factors = random.integers(0, 1 << 63, bands * rows, dtype=U64) * U64(2) + U64(1)
    shifts = random.integers(0, 1 << 63, bands * rows, dtype=U64)
    out = np.zeros((len(starts) - 1, bands), U64)
    for k in range(bands * rows):
        least = np.minimum.reduceat(_fast(sets, factors[k], shifts[k]), starts[:-1])
        band = k // rows
        out[:, band] = _mix(out[:, band] * U64(0x9E3779B97F4A7C15) + least + U64(band + 1))
    return out


def _fast(x: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
    x = (x ^ shift) * factor
    return x ^ (x >> U64(32))


def _grouped(batches: Batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group ends, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(reduce(np.logical_or, [c[1:] != c[:-1] for c in columns]))
        same = held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
        if not len(change):
            if held and not same:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        cut = int(change[-1]) + 1
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


GROUP = ["band", "bucket", "left", "right"]


def _owned(bands: np.ndarray, band: int, side: np.ndarray, left: int, right: int) -> np.ndarray:
    """Pairs (i, j) of a block that agree in ``band`` and in no earlier one, so that each
    pair belongs to one bucket; of two blocks only pairs across count."""
    n = len(bands)
    i, j = np.triu_indices(n, 1)
    if left != right:
        across = side[i] != side[j]
        i, j = i[across], j[across]
    mine = bands[i, band] == bands[j, band]
    i, j = i[mine], j[mine]
    for b in range(band):
        fresh = bands[i, b] != bands[j, b]
        i, j = i[fresh], j[fresh]
    return np.stack([i, j], axis=1)


def _links(sets: list[np.ndarray], pairs: np.ndarray, over: int, under: int) -> np.ndarray:
    """Of ``pairs`` those whose Jaccard likeness is at least over / under, exactly."""
    sizes = np.array([len(s) for s in sets])
    i, j = pairs[:, 0], pairs[:, 1]
    low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    pairs = pairs[low * under >= high * over]  # else even containment is not enough
    if len(pairs) > 4 * len(sets):
        both = _common(sets)[pairs[:, 0], pairs[:, 1]]
    else:
        both = np.array([_intersection(sets[a], sets[b]) for a, b in pairs], np.int64)
    union = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - both
    return pairs[both * under >= union * over] if len(pairs) else pairs


def _intersection(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _common(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, from products of blocks of the incidence matrix."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, len(shared), width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for edges (``a``, ``b``).

    Rounds of large-star and small-star steps: each ties a node's neighbours to the
    least of them. Nothing but counts reaches the driver; lineage is cut each round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == seen:
            break
        seen = state
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's place in the order of documents: by id, nulls last, then by hash of the text.
    Rows that repeat both have one key."""
    return F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash")
    )


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row a document: all links of word ``n``-gram likeness ``over`` / ``under`` or more.

    Words are what white space separates, as written. Returns

    * id;
    * ``set_id``: least id of the documents with the same set of n-grams;
    * ``n_copies``: how many documents have that set, this one included;
    * ``n_links``: how many other sets are linked to this one (each a different text);
    * ``class_id``: least id of all documents that chains of links reach.

    A link at the threshold is found with probability ``recall`` at least, likelier
    ones more surely; what is found is exact. Texts of 1 to n - 1 words have one
    n-gram, all their words. Texts without words (null, empty, blank) all have the
    empty set and form one class without links. Rows with the same id are documents
    of their own; null ids count as greater than all. Other columns are not read,
    whatever their names; an empty table gives no rows. Long texts count whole.
    ``settings`` are those of ``ngram_classes``.
    """
    found = ngram_classes(docs, id_col, text_col, **settings)
    return found.select(
        F.col("row.id").alias(id_col),
        F.col("class_row.id").alias("class_id"),
        F.col("set_row.id").alias("set_id"),
        "n_copies",
        "n_links",
    )


def ngram_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    over: int = 4,
    under: int = 5,
    recall: float = 0.9999,
    block_docs: int = 384,
    block_grams: int = 1_000_000,
) -> DataFrame:
    """``row``, ``set_row`` and ``class_row`` (by ``row_key``: the row's, the first of its set,
    the first of its class), ``n_copies`` and ``n_links`` of each row; see ``ngram_jaccard_join``.

    Buckets are compared in blocks of about ``block_docs`` documents (dealt by hash) and
    ``block_grams`` n-grams: large ones become many blocks, none is cut short.
    """
    bands, rows = choose_bands(over / under, recall)

    @tidy
    def sketch(batches: Batches) -> Batches:
        for batch in sliced(batches, 400_000):
            ids, words = batch.columns
            sets, starts = ngram_sets(words, n)
            sizes = np.diff(starts)
            full = np.flatnonzero(sizes)
            hashes = np.zeros((len(sizes), bands), U64)
            if len(full):
                hashes[full] = band_hashes(sets, np.append(starts[full], len(sets)), bands, rows)
            key = [hashlib.md5(sets[a:b].tobytes()).digest() for a, b in zip(starts, starts[1:], strict=False)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(hashes.ravel().view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(key, pa.binary()), pa.array(sizes.astype(np.int64)), lists], ["row", "key", "size", "bands"]
            )

    plain = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    kind = plain.schema["row"].dataType.simpleString()
    sketches = plain.select("row", word_hashes(F.col("text")).alias("words")).mapInArrow(
        sketch, f"row {kind}, key binary, size long, bands array<long>"
    )
    sketches = cut_lineage(sketches)

    classes = sketches.groupBy("key").agg(
        F.min("row").alias("set_row"),
        F.count("*").alias("n_copies"),
        F.first("size").alias("size"),
        F.first("bands").alias("bands"),
    )
    classes = cut_lineage(classes)
    rows_of = classes.where("size > 0").select("key", "size", F.posexplode("bands").alias("band", "hash"))
    rows_of = rows_of.withColumn("bucket", F.xxhash64("band", "hash"))
    filled = rows_of.groupBy("band", "bucket").agg(F.count("*").alias("members"), F.sum("size").alias("grams"))
    filled = filled.where("members > 1").withColumn(
        "blocks",
        F.greatest(F.ceil(F.col("members") / block_docs), F.ceil(F.col("grams") / block_grams), F.lit(1)).cast("int"),
    )
    # Each member meets all blocks of its bucket, its own as (b, b).
    placed = rows_of.select("key", "band", "bucket").join(filled, ["band", "bucket"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int"))
    placed = placed.select(
        "key", "band", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "key", "band", "bucket", "own", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right")
    )
    together = placed.join(classes.select("key", "bands"), "key")

    @tidy
    def involved(batches: Batches) -> Batches:
        for table in _grouped(batches, GROUP):
            table = table.combine_chunks()
            matrix = table["bands"].combine_chunks()
            matrix = matrix.flatten().to_numpy().reshape(len(table), bands)
            keep = np.zeros(len(table), bool)
            for a, b, band, left, right, side in _groups(table):
                if b - a == 2 and left == right:  # the usual case, without a matrix
                    agree = matrix[a] == matrix[a + 1]
                    keep[a:b] = agree[band] and not agree[:band].any()
                    continue
                pairs = _owned(matrix[a:b], band, side, left, right)
                keep[a + np.unique(pairs)] = True
            yield from table.filter(pa.array(keep)).drop_columns(["bands"]).to_batches()

    where = "band int, bucket long, left int, right int, own int, key binary"
    chosen = _by_group(together.select("band", "bucket", "left", "right", "own", "key", "bands")).mapInArrow(
        involved, where
    )
    chosen = cut_lineage(chosen)

    # The sets of the classes with candidates, made again from one of their texts.
    wanted = cut_lineage(chosen.select("key").distinct().join(classes.select("key", F.col("set_row").alias("row")), "key"))
    sieved = plain.where(may_be_among(plain["row"], wanted, "row")).dropDuplicates(["row"])
    texts = sieved.join(wanted, "row").select("key", "text")

    @tidy
    def remake(batches: Batches) -> Batches:
        for batch in sliced(batches, 400_000):
            key, words = batch.columns
            sets, starts = ngram_sets(words, n)
            own = [hashlib.md5(sets[a:b].tobytes()).digest() for a, b in zip(starts, starts[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sets.view(np.int64)))
            made = pa.RecordBatch.from_arrays([key, lists], ["key", "grams"])
            yield made.filter(pa.array([a == b for a, b in zip(own, key.to_pylist(), strict=True)]))

    made = texts.select("key", word_hashes(F.col("text")).alias("words")).mapInArrow(remake, "key binary, grams array<long>")
    ready = chosen.join(made, "key").join(classes.select("key", "bands"), "key")

    @tidy
    def verify(batches: Batches) -> Batches:
        for table in _grouped(batches, GROUP):
            table = table.combine_chunks()
            matrix = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(table), bands)
            grams = table["grams"].combine_chunks()
            ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(U64)
            keys = table["key"].to_pylist()
            nodes, roots, counts = [], [], []
            for a, b, band, left, right, side in _groups(table):
                sets = [flat[ends[k] : ends[k + 1]] for k in range(a, b)]
                pairs = _links(sets, _owned(matrix[a:b], band, side, left, right), over, under)
                if not len(pairs):
                    continue
                degree = np.bincount(pairs.ravel(), minlength=b - a)
                root = _roots(b - a, pairs)
                for k in np.flatnonzero(degree):
                    nodes.append(keys[a + k])
                    roots.append(keys[a + root[k]])
                    counts.append(int(degree[k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(roots, pa.binary()), pa.array(counts, pa.int64())],
                ["key", "root", "links"],
            )

    linked = _by_group(ready.select("band", "bucket", "left", "right", "own", "key", "bands", "grams")).mapInArrow(
        verify, "key binary, root binary, links long"
    )
    linked = cut_lineage(linked)
    degrees = linked.groupBy("key").agg(F.sum("links").alias("n_links"))
    reached = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("key", "set_row", "n_copies")
        .join(degrees, "key", "left")
        .join(reached.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    least = named.groupBy("root").agg(F.min("set_row").alias("class_row"))
    named = named.join(least, "root").select(
        "key", "class_row", "set_row", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return sketches.select("row", "key").join(named, "key").drop("key")


def _by_group(df: DataFrame) -> DataFrame:
    """Rows of a block in one task, one after the other."""
    return df.repartition(*GROUP).sortWithinPartitions(*GROUP, "key")


def _groups(table: pa.Table) -> Iterator[tuple]:
    """Start, end, band, blocks and sides of each block of rows of ``table``."""
    columns = [table[k].to_numpy() for k in GROUP]
    own = table["own"].to_numpy()
    change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
    for a, b in zip([0, *change.tolist()], [*change.tolist(), len(table)], strict=True):
        band, _, left, right = (int(c[a]) for c in columns)
        yield a, b, band, left, right, own[a:b] == left


#: The exact join by brute force on distinct n-grams; for small tables.
NGRAM_JOIN_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
    list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s
  FROM worded
), classes AS (
  SELECT s, min(doc_id) AS set_id, count(*) AS n_copies, len(s) AS size FROM sets GROUP BY s
), grams AS (
  SELECT set_id, unnest(s) AS g FROM classes
), shared AS (
  SELECT x.set_id AS a, y.set_id AS b, count(*) AS n_both
  FROM grams x JOIN grams y ON x.g = y.g AND x.set_id <> y.set_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN classes p ON p.set_id = a JOIN classes q ON q.set_id = b
  WHERE n_both * 5 >= (p.size + q.size - n_both) * 4
), reach AS (
  SELECT set_id AS a, set_id AS b FROM classes
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, (SELECT min(b) FROM reach r WHERE r.a = c.set_id) AS class_id, c.set_id, c.n_copies,
       (SELECT count(*) FROM links l WHERE l.a = c.set_id) AS n_links
FROM sets d JOIN classes c ON d.s = c.s
"""
