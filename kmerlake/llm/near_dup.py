"""Near-duplicate classes by order MinHash over five-word shingles.

Words are runs of digits, letters lower-cased in A-Z, and bytes from 0x80. A shingle is
five consecutive words (all words of a shorter text), labelled with how often it occurred
before in the text. For each of several hash functions the few labelled shingles
of smallest hash are taken and put back into text order; the hash of that sequence is a
band. Texts with a band in common are candidates. A candidate pair is a link if the
banded alignment of their labelled shingles matches M of n and m with
M / (n + m - M) >= similarity, which is an order-keeping Jaccard similarity.

Texts of equal words are one node. Work on the nodes of a band's bucket is in two steps:

1. Each bucket elects a leader, the node that shares most buckets with others, and only
   pairs with a leader are aligned. Their links join most copies into classes.
2. In a bucket that still holds several classes, the pairs of different classes are held
   against a bound on what they can share, inside a task, in tiles of TILE nodes at most.
   Only pairs that pass become rows and are aligned.

The bound: a node has a bit table, in which a shingle flips one bit. Shingles of both texts
cancel, so two tables never differ in more bits than the texts differ in shingles, and a
link may differ in (n + m) * (1 - similarity) / (1 + similarity) shingles at most. A pair
beyond that is surely no link; so no pair of a bucket that is a link is lost. What can be
lost is a pair without a bucket in common: 2 of 10,000 pairs of similarity 0.8.
Classes are the connected components of the links.

Defined results: a null text, and a text without words unless its bytes equal another's,
is alone in its class. class_id is the smallest doc_id of the class (null only if all are).
Repeated ids are separate rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import shared, spans

SHINGLE = 5
SIMILARITY = 0.8
#: (fewest shingles, most shingles, sketches, least) of a family of sketches. Texts of lengths that
#: similar texts can have share a family. Of 10,000 pairs of similarity 0.8 the long one misses 2.
FAMILIES = ((1, 60, 16, 3), (48, None, 48, 8))
#: Nodes on a side of a tile. Larger buckets are dealt into several tiles.
TILE = 1024
#: Bits of a node's table: the power of two that twice its shingles need, within these.
LEAST_BITS, MOST_BITS = 512, 8192


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes in which the second, third .. occurrence of a value differ from the first."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
    if not len(same):
        return hashes
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[same] = False
    at = np.arange(len(hashes))
    number = at - np.maximum.accumulate(np.where(fresh, at, 0))
    out = hashes.copy()
    out[order] = spans.mix(ordered + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.where(np.isin(np.arange(len(hashes)), order[fresh]), hashes, out)


def flipped_bits(marked: np.ndarray) -> bytes:
    """A bit table in which each labelled shingle flips one bit."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(marked) - 1).bit_length()))
    flips = np.bincount((marked & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def folded(table: np.ndarray, size: int) -> np.ndarray:
    """A bit table as one of fewer bits would be; both sizes are powers of two."""
    while len(table) > size:
        table = table[: len(table) // 2] ^ table[len(table) // 2 :]
    return table


def surely_apart(tables: np.ndarray, sizes: np.ndarray, table: np.ndarray, size: int, similarity: float) -> np.ndarray:
    """Which of the nodes (tables and numbers of shingles) cannot be links of a node."""
    total = sizes + size
    differ = np.bitwise_count(tables ^ table).sum(axis=1)
    lengths = np.minimum(sizes, size) < similarity * np.maximum(sizes, size) - 1e-9
    return lengths | (differ > total * (1 - similarity) / (1 + similarity) + 1e-6)


def order_sketch(marked: np.ndarray, seeds: np.ndarray, least: int) -> np.ndarray:
    """For each seed a hash of the `least` smallest labelled shingles in text order."""
    take = min(least, len(marked))
    step = max(1, (1 << 20) // len(marked))
    out = np.empty(len(seeds), dtype=np.uint64)
    for i in range(0, len(seeds), step):
        part = seeds[i : i + step, None]
        drawn = (marked[None, :] ^ part) * np.uint64(0x9FB21C651E98DF25)
        drawn ^= drawn >> np.uint64(29)
        drawn *= np.uint64(0xD6E8FEB86659FD93)
        at = np.sort(np.argpartition(drawn, take - 1, axis=1)[:, :take], axis=1)
        chosen = marked[at]
        total = np.zeros(len(part), dtype=np.uint64)
        for k in range(take):
            total = total * np.uint64(0x9FB21C651E98DF25) + chosen[:, k]
        out[i : i + step] = spans.mix(total ^ part[:, 0])
    return out


NEW = "__uid long, __key binary, __n int, __sketch array<bigint>, __bits binary"
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Candidates' texts are found through so many bits before they are joined.
FILTER_BITS = 1 << 26


def sketched(docs: DataFrame, text: str, families: tuple) -> DataFrame:
    """docs with each row's own number, key of its words, number of shingles, bands and bit table."""
    seeds = [spans.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)) for i, (_, _, count, _) in enumerate(families)]
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(NEW)])
    names, where = schema.names, docs.columns.index(text)

    def scan(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(where)
            data, offsets = spans.byte_column(texts)
            missing = texts.is_null().to_pylist()
            for i, j in spans.runs(offsets):
                base = offsets[i]
                low = spans.LOWER[data[base : offsets[j]]]
                starts, ends, first = spans.words(low, offsets[i : j + 1] - base, spans.ALNUM)
                hashes = spans.span_hashes(low, starts, ends)
                raw, source = low.tobytes(), data[base : offsets[j]].tobytes()
                grams = spans.window_hashes(hashes, SHINGLE)
                keys, counts, bands, tables = [], [], [], []
                for row in range(j - i):
                    a, b = int(first[row]), int(first[row + 1])
                    if a == b:
                        own = None if missing[i + row] else b"\x00" + source[offsets[i + row] - base : offsets[i + row + 1] - base]
                        sketch = table = None
                    else:
                        own = b" ".join([raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())])
                        mine = grams[a : b - SHINGLE + 1] if b - a >= SHINGLE else spans.window_hashes(hashes[a:b], b - a)
                        mine = labelled(mine)
                        n, table = len(mine), flipped_bits(mine)
                        sketch = np.concatenate([order_sketch(mine, own_seeds, least) for own_seeds, (low_n, high_n, _, least) in zip(seeds, families) if low_n <= n and (high_n is None or n <= high_n)]).view(np.int64)
                    keys.append(None if own is None else hashlib.blake2b(own, digest_size=16).digest())
                    counts.append(max(min(b - a, 1), b - a - SHINGLE + 1))
                    bands.append(sketch)
                    tables.append(table)
                new = [pa.array(np.arange(uid, uid + j - i)), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(tables, pa.binary())]
                yield pa.RecordBatch.from_arrays([*[x.slice(i, j - i) for x in batch.columns], *new], names=names)
                uid += j - i

    return docs.mapInArrow(scan, schema)


def maybe(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows with __maybe: false only where the key is surely not wanted, by a bit table of fixed size."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("__found"))
    # FILTER_BITS / 64 rows at most, whatever is wanted
    near = rows.withColumn("__p", place).withColumn("__w", F.floor(F.col("__p") / 64)).join(F.broadcast(bits), "__w", "left")
    hit = F.coalesce(F.expr("(__found & shiftleft(1L, int(__p % 64))) <> 0"), F.lit(False))
    return near.select(*rows.columns, hit.alias("__maybe"))


def only(rows: DataFrame, wanted: DataFrame, key: str = "__uid") -> DataFrame:
    """Rows joined with those of the same key that are wanted; most others are dropped before anything is moved."""
    return maybe(rows, wanted, key).filter("__maybe").drop("__maybe").join(wanted, key)


def without(rows: DataFrame, unwanted: DataFrame, key: str = "__uid") -> DataFrame:
    """Rows whose key is not unwanted; most of them are not moved."""
    marked = maybe(rows, unwanted, key)
    rest = marked.filter("__maybe").join(unwanted, key, "left_anti")
    return marked.filter("not __maybe").unionByName(rest).drop("__maybe")


def shingle_list(text: str) -> list:
    words = WORDS.findall(text.encode().lower())
    if len(words) < SHINGLE:
        return [tuple(words)] if words else []
    grams = list(zip(*[words[k:] for k in range(SHINGLE)]))
    seen: dict = {}
    if len(set(grams)) < len(grams):
        for i, gram in enumerate(grams):
            seen[gram] = number = seen.get(gram, -1) + 1
            if number:
                grams[i] = (*gram, number)
    return grams


def aligned(a: list, b: list, bar: float) -> float:
    """Order-keeping Jaccard similarity of two labelled shingle lists, 0 if it is surely below bar.

    Labelled shingles are unique in a text, so the longest common subsequence is the
    longest increasing run of places. At least bar / (1 + bar) of all shingles must
    match, which bounds how far apart two matching places can be: the band.
    """
    n, m = len(a), len(b)
    need = bar / (1 + bar) * (n + m)
    band = n + m - 2 * need
    if not n or not m or min(n, m) < need - 1e-9:
        return 0.0
    at = dict(zip(a, range(n)))
    places = [i for j, x in enumerate(b) if (i := at.get(x)) is not None and abs(i - j) <= band + 1e-9]
    if len(places) < need - 1e-9:
        return 0.0
    tails: list[int] = []
    for i in places:
        if not tails or i > tails[-1]:
            tails.append(i)
        else:
            tails[bisect_left(tails, i)] = i
    found = len(tails) / (n + m - len(tails))
    return found if found >= bar - 1e-12 else 0.0


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, with their similarity."""

    def scan(batches):
        last: tuple = (None, None)
        for batch in batches:
            a, b, left, right = (batch.column(k) for k in range(4))
            out = []
            for x, y in zip(left, right):
                x = x.as_py()
                if last[0] != x:
                    last = (x, shingle_list(x))
                out.append(aligned(last[1], shingle_list(y.as_py()), similarity))
            found = np.array(out, dtype=np.float64)
            keep = pa.array(found > 0)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(found[found > 0])], names=["a", "b", "sim"])

    left = texts.select(F.col("__uid").alias("a"), F.col("__text").alias("left"))
    right = texts.select(F.col("__uid").alias("b"), F.col("__text").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(scan, "a long, b long, sim double")


def promising(pairs: DataFrame, tables: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are not surely apart; tables has node, n and bits."""

    def scan(batches):
        for batch in batches:
            a, b, n, m, left, right = batch.columns
            n, m = n.to_numpy(), m.to_numpy()
            keep = np.zeros(len(n), dtype=bool)
            for i, (x, y) in enumerate(zip(left.to_pylist(), right.to_pylist())):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                size = min(len(x), len(y))
                keep[i] = not surely_apart(folded(x, size)[None], n[i : i + 1], folded(y, size), m[i], similarity)[0]
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    left = tables.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("bits").alias("left"))
    right = tables.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "an", "bn", "left", "right").mapInArrow(scan, "a long, b long")


def tile_pairs(nodes: list, comps: list, sizes: list, tables: list, sides: list, similarity: float) -> tuple[list, list]:
    """Pairs of a tile in different classes that are not surely apart. sides: 0 and 1, met with each other, or 2, met with all."""
    size = min(map(len, tables)) // 8
    tables = np.stack([folded(np.frombuffer(x, dtype=np.uint64), size) for x in tables])
    nodes, comps, sizes, sides = np.array(nodes), np.array(comps), np.array(sizes), np.array(sides)
    a, b = [], []
    for i in range(len(nodes) - 1):
        rest = np.flatnonzero((comps[i + 1 :] != comps[i]) & ((sides[i + 1 :] != sides[i]) | (sides[i] == 2))) + i + 1
        if len(rest):
            rest = rest[~surely_apart(tables[rest], sizes[rest], tables[i], sizes[i], similarity)]
            a += np.minimum(nodes[rest], nodes[i]).tolist()
            b += np.maximum(nodes[rest], nodes[i]).tolist()
    return a, b


def pairs_apart(members: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Distinct pairs (a, b) of nodes in one bucket, in different classes, that are not surely apart.

    members: h, size (of the bucket), node, n, comp, bits. A bucket of more than `tile`
    nodes is dealt into blocks, and each pair of blocks is a tile.
    """
    blocks = F.ceil(F.col("size") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp", "n", "bits", side.alias("side"))
    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(spread, "h", "i", "j").sortWithinPartitions("h", "i", "j")

    def scan(batches):
        last, held = None, [[], [], [], [], []]

        def found():
            a, b = tile_pairs(*held, similarity) if len(held[0]) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for h, i, j, *row in zip(*[x.to_pylist() for x in batch.columns]):
                if (h, i, j) != last:
                    if len(held[0]) > 1:
                        yield found()
                    last, held = (h, i, j), [[], [], [], [], []]
                for into, x in zip(held, row):
                    into.append(x)
        yield found()

    return dealt.mapInArrow(scan, "a long, b long").distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, comp) for every node of links (a, b); comp is the component's smallest node.

    Labels spread along links and jump to their label's label each round, so the number
    of rounds grows with the logarithm of a component's width. Tables of the rounds go to
    the folder.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    both = shared.written(both, f"{folder}/both")
    labels = both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("comp"))
    labels = shared.written(labels, f"{folder}/0")
    turn = 0
    while True:
        turn += 1
        seen = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        moved = labels.join(seen, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        up = moved.select(F.col("node").alias("low"), F.col("low").alias("top"))
        moved = moved.join(up, "low", "left").select("node", F.col("comp").alias("was"), F.least("low", F.coalesce("top", "low")).alias("comp"))
        moved = shared.written(moved, f"{folder}/{turn}")
        labels = moved.select("node", "comp")
        if moved.filter("was <> comp").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, families: tuple = FAMILIES, folder: str | None = None, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, table, links).

    classes: __uid, __id, class_id, n_class, keeper (true for one row of each class).
    table: what `sketched` returns, docs' columns being c0, c1 ..; links: pairs of __uid
    with their similarity. All three read tables in `folder`.
    """
    spark = docs.sparkSession
    folder = folder or shared.new_folder(spark, "near-dup")
    own = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    table = shared.written(sketched(docs.toDF(*own.values()), own[text], families), f"{folder}/table")
    nodes = table.filter("__key is not null").groupBy("__key").agg(F.min("__uid").alias("node"))
    nodes = shared.written(nodes, f"{folder}/nodes")
    copies = table.filter("__key is not null").select("__uid", "__key").join(nodes, "__key").filter("__uid <> node").select("__uid")
    copies = shared.written(copies, f"{folder}/copies")
    whole = table.filter("__sketch is not null").select("__uid", "__n", "__sketch")
    bands = without(whole, copies).select(F.col("__uid").alias("node"), F.col("__n").alias("n"), F.explode("__sketch").alias("h"))
    full = shared.written(bands.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"), f"{folder}/full")
    members = shared.written(only(bands, full, "h").select("h", "node", "n", "size"), f"{folder}/members")

    rank = members.groupBy("node").agg(F.sum("size").alias("rank"))
    lead = members.join(rank, "node").groupBy("h").agg(F.max(F.struct("rank", F.negative("node").alias("minus"), "n")).alias("m")).select("h", F.negative("m.minus").alias("a"), F.col("m.n").alias("an"))
    near = (F.col("a") != F.col("node")) & (F.least("an", "n") >= similarity * F.greatest("an", "n") - 1e-9)
    led = members.join(lead, "h").filter(near).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    led = shared.written(led, f"{folder}/led")
    candidates = rank.select(F.col("node").alias("__uid"))
    texts = only(table.select("__uid", "__n", "__bits", F.col(own[text]).alias("__text")), candidates)
    texts = shared.written(texts, f"{folder}/texts")
    tables = texts.select(F.col("__uid").alias("node"), F.col("__n").alias("n"), F.col("__bits").alias("bits"))
    first = shared.written(verified(promising(led, tables, similarity), texts, similarity), f"{folder}/links1")
    labels = components(first, f"{folder}/labels1")

    known = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = shared.written(known, f"{folder}/known")
    apart = known.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h")
    rest = known.join(apart, "h", "left_semi").drop("n").join(tables, "node")
    more = pairs_apart(rest, similarity, tile).join(led, ["a", "b"], "left_anti")
    more = shared.written(more, f"{folder}/more")
    second = shared.written(verified(more, texts, similarity), f"{folder}/links2")
    links = first.union(second)
    labels = components(links, f"{folder}/labels2") if not second.isEmpty() else labels

    named = nodes.join(labels, "node", "left").select("__key", F.coalesce("comp", "node").alias("comp"))
    rows = table.select("__uid", F.col(own[doc_id]).alias("__id"), "__key").join(named, "__key", "left").select("__uid", "__id", F.coalesce("comp", "__uid").alias("comp"))
    rows = shared.written(rows, f"{folder}/rows")
    shared.remove(spark, *[f"{folder}/{x}" for x in ("copies", "full", "members", "led", "texts", "known", "more", "labels1", "labels2")])
    least_id = rows.groupBy("comp").agg(F.min("__id").alias("class_id"), F.count("*").alias("n_class"), F.min(F.struct(F.col("__id").isNull().alias("z"), "__id", "__uid")).alias("first"))
    classes = rows.join(least_id, "comp").select("__uid", "__id", "class_id", "n_class", (F.col("__uid") == F.col("first.__uid")).alias("keeper"))
    return classes, table, links


def kept_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of docs for each class, that of the smallest id, with docs' own columns."""
    folder = shared.new_folder(docs.sparkSession, "near-dup")
    classes, table, _ = near_duplicates(docs, doc_id, text, folder=folder, **options)
    rows = without(table, classes.filter("not keeper").select("__uid"))
    return shared.settled(rows.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)]), folder)


def with_links(classes: DataFrame, table: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, class_id, n_class, n_aligned of every document.

    n_aligned counts the aligned pairs that join the document's text to other texts; copies
    of a text share it. It is no number of near texts: pairs that a class joined before were
    not aligned, and which pairs were depends on how the rows were partitioned. Classes do not.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_aligned"))
    nodes = table.filter("__key is not null").groupBy("__key").agg(F.min("__uid").alias("node")).join(ends, "node").select("__key", "n_aligned")
    mine = table.select("__uid", "__key").join(nodes, "__key").select("__uid", "n_aligned")
    rows = classes.join(mine, "__uid", "left")
    return rows.select(F.col("__id").alias("doc_id"), "class_id", "n_class", F.coalesce("n_aligned", F.lit(0)).cast("long").alias("n_aligned"))
