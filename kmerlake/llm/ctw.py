"""Language-model scoring by context-tree weighting, beside an add-0.1 word model.

Texts are read as tokens: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, then one end.
The byte stream of a text is its words joined by one space and closed by a line feed,
so a stream stands for exactly one token sequence.

Contexts. A byte is coded as eight binary decisions, high bit first. Their contexts are
the 0 to DEPTH bytes before it, as they are: no byte is merged with another. Before a
text's first byte stand line feeds.

Weights. Each decision has a context tree of its own. A node that saw a zeros and b
ones gives the Krichevsky-Trofimov estimate of that sequence; the weighted probability
of an inner node is half its own estimate plus half the product of its children's, that
of a leaf is its estimate. A decision's probability mixes (b + 1/2) / (a + b + 1) along
the path with the posterior weights that follow; a path ends at the deepest context in
which that decision was seen in training. All counts are over all training texts.

Where it is. The tree grows with the corpus and is never in one place: a part has the
subtrees of the contexts whose last TOP bytes hash to it. Parts count the grams of all
chunks, work out their subtrees' weights, and send each chunk ln probabilities (float32)
of its own grams. Only nodes above TOP bytes, 256 ** 2 * 255 at most for a TOP of 3, are
joined on the driver. Words are counted and looked up in the same way.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, spans

DEPTH = 5
TOP = 3
CHUNK_BYTES = 4 << 20
#: Streams are made from about so many bytes of text at once.
RUN_BYTES = 512 << 10
#: Grams of so many bytes are sorted at once; a place or a count among them has 16 bits, beside a gram's 48.
PIECE = (1 << 16) - 1
LOW = np.uint64(16)
SPACE, END = 0x20, 0x0A


def streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte streams of rows (lower-cased words, spaces, line feeds) and their offsets."""
    low = spans.LOWER[data]
    starts, ends, first = spans.words(low, offsets, spans.NONSPACE)
    inside = spans.NONSPACE[low]
    counts = np.diff(first)
    # every word is followed by one byte: a space, or the text's line feed; a text without words is a line feed
    lengths = ends - starts + 1
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=at[1:])
    empty = counts == 0
    before = np.concatenate([[0], np.cumsum(empty)])
    out_offsets = at[first] + before
    shift = np.repeat(before[:-1], counts)
    out = np.full(int(at[-1] + before[-1]), END, dtype=np.uint8)
    places = np.flatnonzero(inside)
    target = places - np.repeat(starts, ends - starts) + np.repeat(at[:-1] + shift, ends - starts)
    out[target] = low[places]
    closing = at[1:] - 1 + shift
    out[closing] = SPACE
    out[out_offsets[1:] - 1] = END
    return out, out_offsets


def long_streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`streams` of one row at least, run by run, so that little is held at once beside the result."""
    found, at = [], np.zeros(len(offsets), dtype=np.int64)
    for i, j in spans.runs(offsets, RUN_BYTES):
        stream, own = streams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        found.append(stream)
        at[i + 1 : j + 1] = at[i] + own[1:]
    return np.concatenate(found), at


def word_numbers(stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of a stream's words, and each row's first word."""
    starts, ends, first = spans.words(stream, at, spans.NONSPACE)
    return spans.span_hashes(stream, starts, ends) >> np.uint64(1), first


def sorted_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often (or with which total weight) each occurs."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    if weights is None:
        keys = np.sort(keys)
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[cut], np.diff(np.append(cut, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[cut], np.add.reduceat(weights[order], cut)


def context_keys(stream: np.ndarray, offsets: np.ndarray, begin: int = 0, end: int | None = None) -> np.ndarray:
    """For each byte, of those from begin to end, the DEPTH bytes before it, newest highest, and then the byte itself."""
    end = len(stream) if end is None else end
    key = stream[begin:end].astype(np.uint64)
    starts = offsets[np.searchsorted(offsets, begin - DEPTH) : np.searchsorted(offsets, end)]
    for back in range(1, DEPTH + 1):
        prior = np.full(end - begin, END, dtype=np.uint8)
        known = max(begin - back, 0)
        if end - back > known:
            prior[known + back - begin :] = stream[known : end - back]
        for ahead in range(back):
            place = starts + (ahead - begin)
            prior[place[(place >= 0) & (place < len(prior))]] = END
        wide = prior.astype(np.uint64)
        wide <<= np.uint64(8 * (DEPTH + 1 - back))
        key |= wide
    return key


def pieces(n: int) -> list[tuple[int, int]]:
    return [(a, min(a + PIECE, n)) for a in range(0, n, PIECE)]


def first_of_each(keys: np.ndarray) -> np.ndarray:
    """Where each different one of ascending keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def joined(found: list[np.ndarray]) -> np.ndarray:
    """All keys of some lists, ascending; the lists are given up, and no second copy is held while these are sorted."""
    every = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    found.clear()
    every.sort()
    return every


def gram_counts(stream: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`in_training` of a stream's grams, train being a flag of each byte; piece by piece, so that little is held at once."""
    found = []
    for a, b in pieces(len(stream)):
        keys, counts = in_training(context_keys(stream, offsets, a, b), train[a:b])
        found.append(keys << LOW | counts.astype(np.uint64))
    every = joined(found)
    keys = every >> LOW
    cut = first_of_each(keys)
    keys = keys[cut]
    every &= np.uint64(PIECE)
    return keys, np.add.reduceat(every.view(np.int64), cut) if len(cut) else np.zeros(0, dtype=np.int64)


def placed_grams(stream: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stream's distinct grams, ascending, and each piece's grams in order, with the place in the piece below each."""
    every, found = np.empty(len(stream), dtype=np.uint64), []
    for a, b in pieces(len(stream)):
        every[a:b] = np.sort(context_keys(stream, offsets, a, b) << LOW | np.arange(b - a, dtype=np.uint64))
        keys = every[a:b] >> LOW
        found.append(keys[first_of_each(keys)])
    keys = joined(found)
    return keys[first_of_each(keys)], every


def summed_along(keys: np.ndarray, values: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Running sums, from 0, of the values of a stream's grams; keys and every are those of `placed_grams`."""
    along = np.zeros(len(every) + 1)
    for a, b in pieces(len(every)):
        own = every[a:b] >> LOW
        cut = first_of_each(own)
        place = (every[a:b] & np.uint64(PIECE)).astype(np.int64)
        along[a + 1 + place] = np.repeat(values[np.searchsorted(keys, own[cut])], np.diff(np.append(cut, len(own))))
    return np.cumsum(along, out=along)


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that has each gram: all grams with the same last TOP bytes of context share one."""
    return (spans.mix(keys >> np.uint64(8 * (DEPTH + 1 - TOP))) % np.uint64(parts)).astype(np.int64)


def squeezed(values: np.ndarray, ascending: bool = True) -> bytes:
    """Unsigned 64-bit numbers as zipped byte planes, of the steps between them if they ascend."""
    values = values.astype(np.uint64)
    steps = np.diff(values, prepend=np.uint64(0)) if ascending else values
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def loosened(packed: bytes, ascending: bool = True) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def zipped(values: np.ndarray) -> bytes:
    """An array's bytes, compressed, behind their number: what goes through the JVM in large rows."""
    raw = pa.py_buffer(np.ascontiguousarray(values))
    return raw.size.to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unzipped(packed: bytes, kind) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(memoryview(packed)[8:], size, codec="zstd"), dtype=kind)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the KT probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        shift[small] -= np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series + shift


def weighted_tables(keys: np.ndarray, counts: np.ndarray, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A whole tree over small alphabets in one table, the plain form of what parts do.

    Returns ln-probability rows of all seen contexts, and the row to use for each context of full depth.

    keys: context classes (5 bits each, depth of them, oldest first) and then the symbol
    of `bits` bits; ascending and distinct. The rows have 2 ** bits columns.
    """
    width = 1 << bits
    symbol, context = (keys & (width - 1)).astype(np.int64), (keys >> bits).astype(np.int64)
    tables = []
    for d in range(depth + 1):
        own = context & ((1 << (5 * d)) - 1)
        seen = np.flatnonzero(np.bincount(own, minlength=1 << (5 * d)))
        row = np.searchsorted(seen, own)
        tables.append((seen, np.bincount(row * width + symbol, weights=counts, minlength=len(seen) * width).reshape(len(seen), width)))
    ones, zeros, kt = [], [], []
    for _, table in tables:
        a, b = np.zeros((len(table), width)), np.zeros((len(table), width))  # decision i's node is column i, as in a heap
        for level in range(bits):
            halves = table.reshape(len(table), 1 << (level + 1), -1).sum(axis=2)
            part = slice(1 << level, 2 << level)
            a[:, part], b[:, part] = halves[:, 0::2], halves[:, 1::2]
        zeros.append(a), ones.append(b), kt.append(log_kt(a, b))
    weighted = [None] * (depth + 1)
    weighted[depth] = kt[depth]
    parents = []
    for d in range(depth - 1, -1, -1):
        seen = tables[d][0]
        up = np.searchsorted(seen, tables[d + 1][0] & ((1 << (5 * d)) - 1))
        children = np.zeros_like(kt[d])
        np.add.at(children, up, weighted[d + 1])
        weighted[d] = np.logaddexp(kt[d], children) - math.log(2)
        parents.append(up)
    parents.reverse()
    # down the paths: the mixture so far and the weight that is left for deeper contexts
    rows, starts = [], [0]
    mixed = left = None
    for d in range(depth + 1):
        a, b = zeros[d], ones[d]
        estimate = (b + 0.5) / (a + b + 1)
        stop = np.exp(np.minimum(0, kt[d] - weighted[d] - (math.log(2) if d < depth else 0)))
        if d == 0:
            so_far, weight = np.zeros_like(a), np.ones_like(a)
        else:
            so_far, weight = mixed[parents[d - 1]], left[parents[d - 1]]
        seen_here = (a + b) > 0
        # the probability if the path ended here: all the weight that is left goes to this node
        ended = so_far + weight * estimate
        final = ended if d == 0 else np.where(seen_here, ended, rows[-1][1][parents[d - 1]])
        mixed = np.where(seen_here, so_far + weight * stop * estimate, so_far)
        left = np.where(seen_here, weight * (1 - stop), weight)
        rows.append((tables[d][0], final))
        starts.append(starts[-1] + len(a))
    out = np.zeros((starts[-1], width))
    use = np.zeros(1 << (5 * depth), dtype=np.int32)
    whole = np.arange(1 << (5 * depth))
    for d, (seen, p) in enumerate(rows):
        for level in range(bits):
            node = (1 << level) + (np.arange(width) >> (bits - level))
            bit = (np.arange(width) >> (bits - 1 - level)) & 1
            chosen = p[:, node]
            out[starts[d] : starts[d + 1]] += np.log(np.where(bit, chosen, 1 - chosen))
        if len(seen):
            at = np.minimum(np.searchsorted(seen, whole & ((1 << (5 * d)) - 1)), len(seen) - 1)
            found = seen[at] == (whole & ((1 << (5 * d)) - 1))
            use[found] = starts[d] + at[found]
    return out, use


def decisions(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(8, n) nodes of grams at a depth, the context's bytes and then a place in a heap of 256, and the bits decided there."""
    symbol = keys & np.uint64(255)
    context = keys >> np.uint64(8 * (DEPTH + 1 - depth)) << np.uint64(8)
    level = np.arange(8, dtype=np.uint64)[:, None]
    heap = np.uint64(1) << level | symbol >> (np.uint64(8) - level)
    return context | heap, (symbol >> (np.uint64(7) - level) & np.uint64(1)).astype(bool)


def seen_nodes(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a depth, ascending, with the zeros and ones they saw."""
    node, bit = decisions(keys, depth)
    return added(node.ravel(), np.where(bit, 0, counts).ravel(), np.where(bit, counts, 0).ravel())


def added(nodes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct nodes, ascending, and sums of each list of values."""
    seen, place = np.unique(nodes, return_inverse=True)
    return seen, *(np.bincount(place, weights=x, minlength=len(seen)).astype(np.float64) for x in values)


def parents_of(nodes: np.ndarray) -> np.ndarray:
    return nodes >> np.uint64(16) << np.uint64(8) | nodes & np.uint64(255)


def climbed(nodes: tuple, below: tuple | None) -> tuple[np.ndarray, ...]:
    """Nodes with their estimate, the weight of stopping there, and the ln weighted probability.

    below: the inner nodes that have children, ascending, and their children's summed ln
    weighted probabilities; None for leaves.
    """
    seen, a, b = nodes
    kt = log_kt(a, b)
    estimate = (b + 0.5) / (a + b + 1)
    if below is None:
        return seen, estimate, np.ones_like(kt), kt
    weighted = np.logaddexp(kt, below[1]) - math.log(2)
    return seen, estimate, np.exp(np.minimum(0, kt - weighted - math.log(2))), weighted


def subtrees(keys: np.ndarray, counts: np.ndarray) -> tuple[list[tuple], tuple]:
    """A part's nodes from depth TOP to DEPTH, and what it adds to nodes of depth TOP - 1."""
    keys, counts = keys[counts > 0], counts[counts > 0].astype(np.float64)
    below, out = None, []
    for depth in range(DEPTH, TOP - 1, -1):
        here = climbed(seen_nodes(keys, counts, depth), below)
        below = added(parents_of(here[0]), here[3])
        out.append(here[:3])
    out.reverse()
    return out, (*seen_nodes(keys, counts, TOP - 1), below[1])


#: About so many of a part's grams are worked on at once.
SLICE = 1 << 17


def slices(keys: np.ndarray) -> list[slice]:
    """Ascending grams in runs that share no context of TOP bytes, so that their subtrees are apart."""
    top = keys >> np.uint64(8 * (DEPTH + 1 - TOP))
    cuts = np.append(np.flatnonzero(top[1:] != top[:-1]) + 1, len(keys)) if len(keys) else []
    out, begin = [], 0
    while begin < len(keys):
        end = int(cuts[min(np.searchsorted(cuts, begin + SLICE), len(cuts) - 1)])
        out.append(slice(begin, end))
        begin = end
    return out


def added_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a part adds to nodes of depth TOP - 1."""
    adds = [subtrees(keys[x], counts[x])[1] for x in slices(keys)] or [subtrees(keys, counts)[1]]
    return adds[0] if len(adds) == 1 else added(*(np.concatenate(x) for x in zip(*adds)))


def grown(keys: np.ndarray, counts: np.ndarray, above: list[tuple]) -> np.ndarray:
    """ln probabilities (float32) of a part's grams, above being the nodes of depths 0 to TOP - 1."""
    out = np.zeros(len(keys), dtype=np.float32)
    for x in slices(keys):
        out[x] = log_probabilities(keys[x], [*above, *subtrees(keys[x], counts[x])[0]])
    return out


def crown(adds: list[tuple]) -> list[tuple]:
    """The nodes of depths 0 to TOP - 1 from what all parts add to the last of these."""
    seen, a, b, children = added(*(np.concatenate(x) for x in zip(*adds)))
    out = []
    for _ in range(TOP):
        here = climbed((seen, a, b), (seen, children))
        out.append(here[:3])
        seen, a, b, children = added(parents_of(seen), a, b, here[3])
    out.reverse()
    return out


def log_probabilities(keys: np.ndarray, levels: list[tuple]) -> np.ndarray:
    """ln probability of each gram's byte after its context, by nodes of depths 0 to DEPTH."""
    final = np.full((8, len(keys)), 0.5)
    mixed, left = np.zeros_like(final), np.ones_like(final)
    for depth, (seen, estimate, stop) in enumerate(levels):
        if not len(seen):
            break
        node, bit = decisions(keys, depth)
        at = np.minimum(np.searchsorted(seen, node), len(seen) - 1)
        found = seen[at] == node
        # the probability if the path ended here: all the weight that is left goes to this node
        final = np.where(found, mixed + left * estimate[at], final)
        mixed = np.where(found, mixed + left * stop[at] * estimate[at], mixed)
        left = np.where(found, left * (1 - stop[at]), left)
    return np.log(np.where(bit, final, 1 - final)).sum(axis=0) if len(levels[0][0]) else np.full(len(keys), 8 * math.log(0.5))


#: A part has the grams and words of about so many bytes of text.
PART_BYTES = 32 << 20
PACKED = "chunk long, bytes long, ids binary, missing binary, train binary, stream binary, at binary"


def packed(rows: DataFrame) -> DataFrame:
    """(__row long, __train boolean, __text) in chunks of a few MB, as streams, bytes long and zipped."""

    def scan(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = spans.byte_column(batch.column(2))
            for i, j in spans.runs(offsets, CHUNK_BYTES):
                stream, at = long_streams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts = [ids[i:j].astype(np.int64), missing[i:j], train[i:j], stream, at]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(stream)]), *[pa.array([zipped(x)], pa.binary()) for x in parts]], names=["chunk", "bytes", "ids", "missing", "train", "stream", "at"])
                number += 1

    return rows.mapInArrow(scan, PACKED)


def in_training(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of up to 63 bits, ascending, and how often each occurs in training texts (0 if only in others)."""
    keys, counts = sorted_counts(keys << np.uint64(1) | train.astype(np.uint64))
    key = keys >> np.uint64(1)
    trained = np.where(keys & np.uint64(1), counts, 0)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[cut], np.add.reduceat(trained, cut) if len(cut) else trained


def counted(chunks: DataFrame, buckets: int) -> DataFrame:
    """(kind, part, chunk, keys, counts): a chunk's distinct words (kind 0) and grams (kind 1) by part.

    Counts are occurrences in training texts of the chunk, 0 if only others hold the key.
    """

    def scan(batches):
        for batch in batches:
            for chunk, train, stream, at in zip(*[batch.column(k) for k in range(4)]):
                chunk, train, stream, at = chunk.as_py(), unzipped(train.as_py(), bool), unzipped(stream.as_py(), np.uint8), unzipped(at.as_py(), np.int64)
                words, first = word_numbers(stream, at)
                out = []
                for kind, (keys, counts) in enumerate((in_training(words, np.repeat(train, np.diff(first))), gram_counts(stream, at, np.repeat(train, np.diff(at))))):
                    part = parts_of(keys, buckets) if kind else (keys % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    ends = np.searchsorted(part[order], np.arange(buckets + 1))
                    for b in range(buckets):
                        pick = order[ends[b] : ends[b + 1]]
                        if len(pick):
                            out.append((kind, b, chunk, squeezed(keys[pick]), squeezed(counts[pick], False)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["kind", "part", "chunk", "keys", "counts"])

    return chunks.select("chunk", "train", "stream", "at").mapInArrow(scan, "kind int, part int, chunk long, keys binary, counts binary")


def summed(counts: DataFrame) -> DataFrame:
    """By kind and part: words' totals sent back to each chunk (kind 0, with the part's N and V as chunk -1).

    Kind 1 has grams and totals once, as chunk -1, with the chunks that hold some, the
    places of each chunk's grams among the part's, and what the part adds to the crown.
    """
    names = ["kind", "part", "chunk", "counts", "keys", "chunks", "places", "adds", "total", "distinct"]
    schema = "kind int, part int, chunk long, counts binary, keys binary, chunks array<long>, places array<binary>, adds array<binary>, total long, distinct long"

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        kind, part = key
        every = [loosened(x) for x in frame["keys"]]
        keys, _ = sorted_counts(np.concatenate(every))
        totals = np.zeros(len(keys), dtype=np.int64)
        places = []
        for own, n in zip(every, frame["counts"]):
            places.append(np.searchsorted(keys, own))
            totals[places[-1]] += loosened(n, False).astype(np.int64)
        if kind:
            adds = added_by(keys, totals)
            row = (1, part, -1, squeezed(totals, False), squeezed(keys), frame["chunk"].tolist(), [squeezed(x) for x in places], [x.tobytes() for x in adds], 0, 0)
            return pd.DataFrame([row], columns=names)
        n, v = int(totals.sum()), int((totals > 0).sum())
        out = [(0, part, chunk, zipped(totals[at]), None, None, None, None, 0, 0) for chunk, at in zip(frame["chunk"].tolist(), places)]
        return pd.DataFrame([*out, (0, part, -1, None, None, None, None, None, n, v)], columns=names)

    return counts.groupBy("kind", "part").applyInPandas(add, schema)


def scored(rows: DataFrame, buckets: int | None = None, folder: str | None = None) -> DataFrame:
    """Scores (__row long, __train boolean, __text string): every row, learning from those with __train.

    Returns __row, n_tokens, n_known, train_tokens, base_score, score, n_bytes, by tables
    in `folder`. A null __row stays null, a null __train counts as false, a null text as
    empty. An empty table gives no rows.
    """
    spark = rows.sparkSession
    folder = folder or shared.new_folder(spark, "ctw")
    rows = rows.select("__row", F.coalesce("__train", F.lit(False)).alias("__train"), "__text")
    chunks = shared.written(packed(rows), f"{folder}/chunks", bulky=True)

    def training(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(unzipped(x, bool).sum()) for x in batch.column(0).to_pylist())])], names=["n"])

    ends = int(chunks.select("train").mapInArrow(training, "n long").agg(F.sum("n")).first()[0] or 0)
    size = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    totals = shared.written(summed(counted(chunks, buckets)), f"{folder}/totals", bulky=True)

    n, v = totals.filter("kind = 0 and chunk = -1").agg(F.sum("total"), F.sum("distinct")).first()
    n, v = int(n or 0) + ends, int(v or 0) + (ends > 0)
    adds = [[np.frombuffer(x, dtype=kind) for x, kind in zip(r["adds"], (np.uint64, float, float, float))] for r in totals.filter("kind = 1").select("part", "adds").orderBy("part").collect()]
    sent = spark.sparkContext.broadcast(crown(adds) if adds else [])

    def looked_up(batches):
        for batch in batches:
            for part, keys, counts, holders, places in zip(*batch.columns):
                part, keys = part.as_py(), loosened(keys.as_py())
                values = grown(keys, loosened(counts.as_py(), False).astype(np.int64), sent.value)
                for chunk, own in zip(holders.as_py(), places.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([part], pa.int32()), pa.array([chunk]), pa.array([values[loosened(own).astype(np.int64)].tobytes()], pa.binary())], names=["kind", "part", "chunk", "counts"])

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["__row", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
        if left.empty:
            return pd.DataFrame({x: [] for x in names})
        x = left.iloc[0]
        ids = pd.array(unzipped(x["ids"], np.int64).copy(), dtype="Int64")
        ids[unzipped(x["missing"], bool)] = pd.NA
        at, stream = unzipped(x["at"], np.int64), unzipped(x["stream"], np.uint8)
        words, first = word_numbers(stream, at)
        word, place = np.unique(words, return_inverse=True) if len(words) else (words, np.zeros(0, dtype=np.int64))
        own = np.zeros(len(word))
        bucket = (word % np.uint64(buckets)).astype(np.int64)
        for kind, part, counts in zip(right["kind"].tolist(), right["part"].tolist(), right["counts"]):
            if kind == 0:
                own[bucket == part] = unzipped(counts, np.int64)
        floor = n + 0.1 * (v + 1)
        logs = np.append(0.0, np.cumsum(np.log10((own + 0.1) / floor)[place]))
        known = np.append(0, np.cumsum((own > 0)[place]))
        keys, every = placed_grams(stream, at)
        part = parts_of(keys, buckets)
        values = np.zeros(len(keys))
        for kind, p, own_values in zip(right["kind"].tolist(), right["part"].tolist(), right["counts"]):
            if kind == 1:
                values[part == p] = np.frombuffer(own_values, dtype=np.float32)
        along = summed_along(keys, values, every)
        return pd.DataFrame(
            dict(
                zip(
                    names,
                    (
                        ids,
                        np.diff(first) + 1,
                        known[first[1:]] - known[first[:-1]] + (ends > 0),
                        n,
                        logs[first[1:]] - logs[first[:-1]] + math.log10((ends + 0.1) / floor),
                        (along[at[1:]] - along[at[:-1]]) / math.log(10),
                        np.diff(at),
                    ),
                )
            )
        )

    names = "kind int, part int, chunk long, counts binary"
    back = totals.filter("kind = 0 and chunk >= 0").select("kind", "part", "chunk", "counts")
    back = back.union(totals.filter("kind = 1").select("part", "keys", "counts", "chunks", "places").mapInArrow(looked_up, names))
    have = chunks.select("chunk", "ids", "missing", "stream", "at")
    schema = "__row long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return have.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(score, schema)


def score_documents(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every document."""
    rows = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    coded = rows.select(F.col("doc_id").cast("long").alias("__row"), (~F.col("held_out")).alias("__train"), F.col("text").alias("__text"))
    folder = shared.new_folder(docs.sparkSession, "ctw")
    out = scored(coded, folder=folder)
    flags = held_out_of(F.col("__row"))
    out = out.select(F.col("__row").alias("doc_id"), flags.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") / F.lit(-math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
    return shared.settled(out, folder)


def held_out_of(doc_id: F.Column) -> F.Column:
    """Documents whose crc32 of the id as text leaves 0 when divided by 10; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))
