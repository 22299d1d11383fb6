"""N-gram Jaccard self-join with prefix filters under several token orders.

A document is the set of its distinct word shingles. Two sets with Jaccard
similarity of at least t share a shingle among the first n - ceil(t n) + 1 of
each set, under any order of all shingles. So candidates must share such a
prefix shingle under every one of several orders; only pairs that pass all of
them are compared.

All orders put rare shingles first (by the number of documents that have
them), and break ties by different hashes. Passages that many documents share
therefore lie behind what sets a document apart, and are hardly ever in a
prefix. The document counts cover the whole corpus (chunks.totals).

Equal sets form a class and only its smallest row goes on. The result needs
components, not all links, so a bucket of rows that share a prefix shingle is
not expanded into pairs. Its rows are compared with one of them, twice: first
each row with the one that it shares most buckets with, then in each bucket
that is not one component yet. What is linked becomes one component. Then only pairs between different
components are left, of which one lies outside the bucket's main component;
all of these that pass the size and position filters, and whose bitmaps leave
room for the overlap that is needed, are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm import chunks as C
from fleetcast.llm.common import bounded_batches, materialize, mix, table
from fleetcast.llm.components import components

WIDTH, PERCENT = 3, 90
ORDERS = 3
AT_ONCE = 1 << 18         # shingles of a chunk whose prefixes are found together
ROUNDS = 2                # comparisons with one row of each bucket, before the rest

WORDS = 16                # of 64 bits, in the bitmap of a set

ROW = ("row long, key {key}, n_shingles long, digest string, prefix array<struct<token:long,place:int>>, bits array<long>, "
       "others array<binary>, shingles binary")


def distinct(chunk: C.Chunk, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, documents with each, and for all distinct pairs of document and
    key: the document, and the place of its key), pairs ordered by key."""
    doc, key = C.grams(chunk, width)
    order = np.argsort(key, kind="stable")            # documents ascend within a key
    doc, key = doc[order], key[order]
    del order
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    doc, key = doc[new], key[new]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at], np.diff(np.append(at, len(key))).astype(np.uint32), doc, np.cumsum(new, dtype=np.int32) - np.int32(1)


def by_document(chunk: C.Chunk, width: int, answer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(borders of the documents, their distinct keys, ascending, and the
    documents that have each). ``answer()`` gives the latter for each key."""
    keys, _, doc, place = distinct(chunk, width)
    order = np.argsort(doc, kind="stable")            # keys ascend within a document
    ends = np.searchsorted(doc[order], np.arange(len(chunk.ends)))
    place = place[order]
    del order, doc
    return ends, keys[place], answer()[place]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(t n) + 1, in integers."""
    return n - (percent * n + 99) // 100 + 1


def row_numbers(chunk: C.Chunk) -> range:
    """A number for each document of a chunk: partition (23 bits), chunk in
    the partition (16 bits), document in the chunk (24 bits)."""
    partition, at, n = chunk.number >> 32, chunk.number & 0xFFFFFFFF, len(chunk.ends) - 1
    if partition >= 1 << 23 or at >= 1 << 16 or n > 1 << 24:
        raise ValueError(f"no row numbers for partition {partition}, chunk {at}, {n} documents; read the table in other partitions")
    first = (partition << 40) + (at << 24)
    return range(first, first + n)


def prefixes(chunk: C.Chunk, ends: np.ndarray, key: np.ndarray, count: np.ndarray, percent: int, kind: pa.DataType) -> pa.Table:
    """The rows of a chunk's documents (ROW), some documents at a time.
    Prefixes leave out shingles of a single document, which nobody can share,
    but keep places in the whole set."""
    tables, a = [], 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + AT_ONCE, side="right")) - 1)
        part = slice(ends[a], ends[b])
        tables.append(_prefixes(chunk, range(a, b), ends[a:b + 1] - ends[a], key[part], count[part], percent, kind))
        a = b
    return pa.concat_tables(tables)


def _prefixes(chunk: C.Chunk, documents: range, ends, key, count, percent: int, kind: pa.DataType) -> pa.Table:
    rows, numbers, n = len(documents), row_numbers(chunk), np.diff(ends)
    doc = np.repeat(np.arange(rows), n)
    take = prefix_length(n, percent)
    alive = np.bincount(doc[count == 1], minlength=rows) < take        # else the prefix is all singles
    some = alive[doc]
    d, k, c = doc[some], key[some], count[some]
    first = np.searchsorted(d, np.arange(rows))

    def prefix(o: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(border of each document, keys, places) of the prefixes under order o."""
        order = np.lexsort((k if o == 0 else mix(k ^ np.uint64(o)), c, d))
        at = np.arange(len(d)) - first[d]              # documents stay where they are
        use = (at < take[d]) & (c[order] > 1)
        return np.searchsorted(d[use], np.arange(rows + 1)), k[order[use]], at[use]

    borders, tokens, places = prefix(0)
    entries = pa.StructArray.from_arrays([pa.array(tokens.view(np.int64)), pa.array(places, pa.int32())], names=["token", "place"])
    wanted = np.diff(borders) > 0
    bits = np.zeros((rows, WORDS), np.uint64)
    np.bitwise_or.at(bits, (doc, (key >> np.uint64(6)).astype(np.int64) % WORDS), np.uint64(1) << (key & np.uint64(63)))
    others = [[] for _ in documents]
    for o in range(1, ORDERS):
        at, tokens, _ = prefix(o)
        for i in np.flatnonzero(wanted):
            others[i].append(np.sort(tokens[at[i]:at[i + 1]]).tobytes())
    digests = [hashlib.blake2b(key[ends[i]:ends[i + 1]], digest_size=16).hexdigest() if n[i] else f"empty {chunk.number} {x}" for i, x in enumerate(documents)]
    shingles = [C.squeeze_sorted(key[ends[i]:ends[i + 1]]) if wanted[i] else None for i in range(rows)]
    return pa.table({
        "row": pa.array(numbers[documents.start:documents.stop], pa.int64()), "key": pa.array(chunk.keys[documents.start:documents.stop], kind),
        "n_shingles": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.string()),
        "prefix": pa.ListArray.from_arrays(pa.array(borders, pa.int32()), entries),
        "bits": pa.array([b if w else None for b, w in zip(bits.view(np.int64), wanted)], pa.list_(pa.int64())),
        "others": pa.array(others, pa.list_(pa.binary())), "shingles": pa.array(shingles, pa.binary())})


def document_rows(docs: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """One row (ROW) for each document, written."""
    parts = C.encode(docs, "shingle-chunks", text, key)
    n = C.slots(parts)

    def asked(chunk: C.Chunk):
        keys, count, _, _ = distinct(chunk, width)
        return [(keys, [count])]

    def count(slot, keys, sums, first):
        return [np.minimum(sums[0], 2**32 - 1).astype(np.uint32)], []

    def select(chunk: C.Chunk, found: pa.Table) -> pa.Table:
        borders, shingles, df = by_document(chunk, width, lambda: C.read_answer(found, 0, n, [np.uint32])[0])
        return prefixes(chunk, borders, shingles, df, percent, arrow)

    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType
    arrow = C.arrow_type(kind)
    answers = C.totals(C.requests(parts, n, asked), [np.uint32], count)
    # a chunk without any word asks nothing, and still gets its rows
    silent = parts.select(F.lit(-1).cast("long").alias("slot"), "chunk", F.array().cast("array<binary>").alias("values"))
    rows = C.with_answers(parts, answers.unionByName(silent), select, ROW.format(key=kind.simpleString()))
    return materialize(rows, "shingle-rows")


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def enough_left(n_a: Column, at_a: Column, n_b: Column, at_b: Column, percent: int) -> Column:
    """The overlap that the threshold needs, (t / (1 + t)) (|a| + |b|), is
    still possible if this is the first shingle that both prefixes share."""
    return (F.lit(1) + F.least(n_a - at_a - 1, n_b - at_b - 1)) * (100 + percent) >= (n_a + n_b) * percent


def enough_shared(n_a: Column, bits_a: Column, n_b: Column, bits_b: Column, percent: int) -> Column:
    """The overlap that the threshold needs is still possible: two sets share
    at most as many shingles as their bitmaps share bits, and the shingles of
    one set that had no bit of their own."""
    count = lambda bits: F.aggregate(bits, F.lit(0), lambda n, x: n + F.bit_count(x))
    both = F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
    return (both + F.least(n_a - count(bits_a), n_b - count(bits_b))) * (100 + percent) >= (n_a + n_b) * percent


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: they share a prefix shingle under each
    of the other orders, and their whole sets are similar enough."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y, p, q in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                ok = all(len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True))
                         for s, t in zip(p, q))
                if ok:
                    x, y = C.stretch_sorted(x), C.stretch_sorted(y)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok = 100 * both >= percent * (len(x) + len(y) - both)
                linked.append(ok)
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("x"), F.col("others").alias("p"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("y"), F.col("others").alias("q"))
    return (pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y", "p", "q")
            .mapInArrow(check, "a long, b long"))


def _labelled(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """``rows`` with the component that links give them so far."""
    if links is None:
        return rows.withColumn("part", F.col("row"))
    labels = components(links).select(F.col("node").alias("row"), "label")
    return rows.join(labels, "row", "left").withColumn("part", F.coalesce("label", "row")).drop("label")


def find_links(rows: DataFrame, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b) between different sets that connect what all links
    connect. ``rows``: one document of each class (ROW)."""
    index = (rows.select("row", F.col("n_shingles").alias("n"), F.explode("prefix").alias("p"))
             .select("row", "n", F.col("p.token").alias("token"), F.col("p.place").alias("place")))
    shared = index.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    index = materialize(index.join(shared, "token"), "prefix-index")
    sets = rows.select("row", "bits", "others", "shingles").join(index.select("row").distinct(), "row", "left_semi")
    sets = materialize(sets, "prefix-sets")
    a, b = F.least("row", "row_"), F.greatest("row", "row_")
    sizes = similar_sizes(F.col("n"), F.col("n_"), percent)
    passes = (sizes
              & enough_left(F.col("n"), F.col("place"), F.col("n_"), F.col("place_"), percent)
              & enough_shared(F.col("n"), F.col("bits"), F.col("n_"), F.col("bits_"), percent))
    links, taken = None, ("row", "n", "place", "part")

    def add(pairs: DataFrame) -> DataFrame:
        new = materialize(verify(pairs.select(a.alias("a"), b.alias("b")).distinct(), sets, percent), "verified")
        return new if links is None else links.unionByName(new)

    for k in range(rounds):
        now = _labelled(index, links)
        by = F.col("row") if k == 0 else F.xxhash64("row", F.lit(k))
        one = (now.groupBy("token").agg(F.min(F.struct(by.alias("by"), *taken)).alias("one"),
                                        F.min("part").alias("least"), F.max("part").alias("most")).filter("least <> most")
               .select("token", *[F.col(f"one.{c}").alias(f"{c}_") for c in taken]))
        # the position filter holds for the first shared shingle only; a row may share a later one with this row
        pairs = now.join(one, "token").filter("part <> part_").filter(sizes)
        if k == 0:
            pairs = (pairs.groupBy("row", "row_").agg(F.count("*").alias("shared"))
                     .groupBy("row").agg(F.max(F.struct("shared", (-F.col("row_")).alias("other"))).alias("best"))
                     .select("row", (-F.col("best.other")).alias("row_")))
        links = add(pairs)

    now = materialize(_labelled(index, links), "prefix-parts")
    main = (now.groupBy("token", "part").agg(F.count("*").alias("size"))
            .groupBy("token").agg(F.max(F.struct("size", "part")).alias("main"), F.count("*").alias("parts"))
            .filter("parts > 1").select("token", F.col("main.part").alias("main")))
    mixed = now.join(main, "token").join(sets.select("row", "bits"), "row")
    outside = mixed.filter("part <> main").select("token", *[F.col(c).alias(f"{c}_") for c in (*taken, "bits")])
    return add(mixed.join(outside, "token").filter("part <> part_").filter(passes))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``row`` (a number of the document), ``key``, ``n_shingles``,
    ``class_row`` (the row that stands for its set) and ``component_id`` (the
    smallest key that links reach).

    Null and empty texts have no shingles and are linked with nothing; a text
    of fewer words than ``width`` has its whole sequence as one shingle.
    Repeated rows have equal sets and so are linked. A null key is larger than
    all others: a component of null keys only has a null id. Extra columns
    are ignored; an empty table gives an empty result. ``key`` may be a struct.
    """
    bounded_batches(docs.sparkSession)
    rows = document_rows(docs, text, key, width, percent)
    classes = rows.groupBy("digest").agg(F.min("row").alias("class_row"))
    all_ = materialize(rows.select("row", "key", "n_shingles", "digest").join(classes, "digest").drop("digest"), "shingle-classes")
    own = all_.filter("row = class_row").select("row")
    links = find_links(rows.filter(F.size("prefix") > 0).join(own, "row", "left_semi"), percent)
    labels = components(links).select(F.col("node").alias("class_row"), "label")
    parts = all_.join(labels, "class_row", "left").withColumn("part", F.coalesce("label", "class_row"))
    least = parts.groupBy("part").agg(F.min("key").alias("component_id"))
    return parts.join(least, "part").select("row", F.col("key").alias(key), "n_shingles", "class_row", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row
    with the smallest key (then the smallest text digest) stays, with all its
    columns. Rows that agree in key and text are copies and one of them stays,
    also where the text is empty."""
    # all columns travel in one struct, so that none can clash with a name used here
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    mine = mine.select("doc", F.struct(F.col(f"doc.`{key}`").alias("id"), F.md5(F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))).alias("md5")).alias("name"))
    found = materialize(join(mine.select("name", F.col(f"doc.`{text}`").alias("text")), "text", "name", width, percent), "near-copies")
    chosen = (found.groupBy("component_id").agg(F.count(F.when(F.col("name") == F.col("component_id"), 1)).alias("n"))
              .select(F.col("component_id").alias("chosen"), "n"))
    kept = mine.join(chosen, (F.col("name.md5") == F.col("chosen.md5")) & F.col("name.id").eqNullSafe(F.col("chosen.id")))
    once, often = kept.filter("n = 1"), kept.filter("n > 1").dropDuplicates(["name"])
    return once.unionByName(often).select("doc.*")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
