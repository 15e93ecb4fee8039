"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of digits, A-Z lower-cased to a-z, and bytes from 0x80. A pattern is
every window of 10 consecutive words of a benchmark item; an item of fewer words, but
not none, is one pattern. A shift table over blocks of two words tells how far a
search may jump; where it says 0, the suffix block's bucket and then a hash of the
whole window select patterns, and the words themselves are compared. Many documents
are searched side by side: each lane of the search is a stretch of one document.

Null texts have no words. Null item texts and items without words give no pattern.
Items with a null id are left out of `contamination`, as in its SQL; `clean` searches
for their text as well, since a passage is no less a passage without a name.
Rows are independent: repeated documents and repeated ids each give their own row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, spans

WINDOW = 10
LANE = 256
TABLE_BITS = 16
#: Patterns searched for at once stem from at most so many bytes of benchmark text; more are searched block by block.
PATTERN_BYTES = 8 << 20


def item_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    low = spans.LOWER[data]
    starts, ends, _ = spans.words(low, np.array([0, len(low)], dtype=np.int64), spans.ALNUM)
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends)]


class Searcher:
    """Wu-Manber tables for the patterns of one length."""

    def __init__(self, length: int, patterns: dict[bytes, set], block: int = 2):
        self.length, self.block = length, min(block, length)
        self.patterns = patterns
        keys = list(patterns)
        ends = np.cumsum([len(k) + 1 for k in keys])
        data = np.frombuffer(b" ".join(keys), dtype=np.uint8)
        offsets = np.array([0, *ends[:-1], len(data)], dtype=np.int64)
        starts, stops, _ = spans.words(data, offsets, spans.ALNUM)
        by_word = spans.span_hashes(data, starts, stops).reshape(len(keys), length)
        self.default = length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, self.default, dtype=np.int64)
        for j in range(self.block - 1, length):
            blocks = self.blocks(by_word[:, j - self.block + 1 : j + 1])
            np.minimum.at(self.shift, blocks, length - 1 - j)
        self.windows = np.sort(np.array([spans.window_hashes(row, length)[0] for row in by_word]))

    def blocks(self, parts: np.ndarray) -> np.ndarray:
        total = parts[:, 0]
        for k in range(1, parts.shape[1]):
            total = total * np.uint64(0x9FB21C651E98DF25) + parts[:, k]
        return (spans.mix(total) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def positions(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """First words of the windows that have a pattern's suffix block and hash, ascending."""
        low, high = first[:-1] + self.length - 1, first[1:]
        count = np.maximum(0, -(-(high - low) // LANE))
        total = int(count.sum())
        if not total:
            return np.zeros(0, dtype=np.int64)
        row = np.repeat(np.arange(len(count)), count)
        within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        at = low[row] + within * LANE
        stop = np.minimum(at + LANE, high[row])
        found = []
        back = np.arange(self.block - 1, -1, -1)
        while len(at):
            jump = self.shift[self.blocks(hashes[at[:, None] - back])]
            hit = jump == 0
            if hit.any():
                found.append(at[hit])
                jump = np.where(hit, 1, jump)
            at = at + jump
            keep = at < stop
            at, stop = at[keep], stop[keep]
        if not found:
            return np.zeros(0, dtype=np.int64)
        begin = np.sort(np.concatenate(found)) - self.length + 1
        total = np.zeros(len(begin), dtype=np.uint64)
        for k in range(self.length):
            total = total * np.uint64(0x9FB21C651E98DF25) + hashes[begin + k]
        total = spans.mix(total)
        at = np.minimum(np.searchsorted(self.windows, total), len(self.windows) - 1)
        return begin[self.windows[at] == total]


def searchers(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[Searcher]:
    by_length: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        found = item_words(text)
        size = min(window, len(found))
        for i in range(len(found) - size + 1 if size else 0):
            by_length[size][b" ".join(found[i : i + size])].add(item)
    return [Searcher(size, patterns) for size, patterns in sorted(by_length.items())]


def search_batch(data: np.ndarray, offsets: np.ndarray, tools: list[Searcher]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
    """For each row: number of words, merged word ranges that are hit, items found."""
    for i, j in spans.runs(offsets):
        base = offsets[i]
        low = spans.LOWER[data[base : offsets[j]]]
        starts, ends, first = spans.words(low, offsets[i : j + 1] - base, spans.ALNUM)
        hashes = spans.span_hashes(low, starts, ends)
        hits: dict[int, list] = defaultdict(list)
        raw = low.tobytes()
        for tool in tools:
            begin = tool.positions(hashes, first)
            rows = np.searchsorted(first, begin, side="right") - 1
            for at, row in zip(begin.tolist(), rows.tolist()):
                text = b" ".join([raw[a:b] for a, b in zip(starts[at : at + tool.length].tolist(), ends[at : at + tool.length].tolist())])
                if items := tool.patterns.get(text):
                    hits[row].append((at - int(first[row]), tool.length, items))
        counts = np.diff(first).tolist()
        for row in range(j - i):
            merged: list[tuple[int, int]] = []
            items: set = set()
            for at, size, names in sorted(hits.get(row, ()), key=lambda x: x[:2]):
                items |= names
                if merged and at <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], at + size))
                else:
                    merged.append((at, at + size))
            yield counts[row], merged, items


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES, unnamed: bool = False) -> DataFrame:
    """docs with `__n_words` long, `__spans` array of word ranges [lo, hi) and `__items` array of item ids as strings.

    The benchmark is measured first. Up to pattern_bytes of it is sent to the tasks at
    once; a larger one is searched for in blocks of that size, one pass over docs each,
    with a checkpoint between passes. With unnamed, items with a null id give spans, too,
    but no id.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull() & (F.lit(unnamed) | F.col("i").isNotNull())).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // pattern_bytes))
    kept = [x for x in docs.columns if x not in ("__n_words", "__spans", "__items")]
    out = docs.select(*[F.col(f"`{x}`") for x in kept], F.lit(0).cast("long").alias("__n_words"), F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)").alias("__spans"), F.expr("cast(array() as array<string>)").alias("__items"))
    schema = out.schema
    arrow = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("i", F.when(F.col("i").isNull(), F.col("t"))), F.lit(blocks)) == block) if blocks > 1 else items
        sent = spark.sparkContext.broadcast([tuple(x) for x in mine.collect()])

        def scan(batches, sent=sent):
            tools = searchers(sent.value, window)
            for batch in batches:
                table = pa.Table.from_batches([batch])
                data, offsets = spans.byte_column(batch.column(table.schema.get_field_index(text)))
                n, ranges, names = [], [], []
                had = zip(table["__spans"].to_pylist(), table["__items"].to_pylist())
                for (count, merged, found), (old_spans, old_items) in zip(search_batch(data, offsets, tools), had):
                    n.append(count)
                    ranges.append([*(old_spans or ()), *({"lo": a, "hi": b} for a, b in merged)])
                    names.append(sorted({*(old_items or ()), *found} - {None}))
                new = {"__n_words": pa.array(n, pa.int64()), "__spans": pa.array(ranges, pa.list_(arrow)), "__items": pa.array(names, pa.list_(pa.string()))}
                for name, column in new.items():
                    table = table.set_column(table.schema.get_field_index(name), name, column)
                yield from table.to_batches()

        out = out.mapInArrow(scan, schema)
        if block + 1 < blocks:
            shared.shared_root(spark)
            out = out.checkpoint()
    return out


def hit_words() -> F.Column:
    """Number of words in the union of `__spans`."""
    start = F.expr("named_struct('n', 0L, 'hi', 0L)")

    def add(acc, s):
        low = F.greatest(acc["hi"], s["lo"])
        return F.struct((acc["n"] + F.greatest(s["hi"] - low, F.lit(0).cast("long"))).alias("n"), F.greatest(acc["hi"], s["hi"]).alias("hi"))

    return F.aggregate(F.array_sort("__spans"), start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_passages(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("__items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark passage occurs, with their own columns, whatever those are called."""
    own = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    found = find_passages(docs.toDF(*own.values()), benchmark, text=own[text], unnamed=True, **options)
    return found.filter(F.size("__spans") == 0).select(*[F.col(name).alias(x) for x, name in own.items()])
