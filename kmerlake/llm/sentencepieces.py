"""SentencePiece encoding and decoding by a shared-prefix forward pass over marked words.

The distinct marked words of a run of texts (leading spaces and what follows up to the
next space) are sorted, which is a depth-first walk of their trie, and the forward state
of every character of a common prefix is computed once and kept for the next word.

For a unigram model the state is Viterbi's: the best score of a segmentation of the
prefix and its last piece. A BPE model's ids are not those of a best score, so there the
same pass keeps the last piece of the prefix's only BPE segmentation: the piece that ends
here, starts where a shorter prefix ends, and is not merged otherwise next to that
prefix's last piece. Both are exact. What no piece covers falls back to bytes.

A model file is read here, so encoding needs no tokenizer library. Models must keep
texts as they are (identity normalisation, spaces kept and escaped, a dummy prefix);
others are refused. Null and empty texts have no ids and decode to an empty text.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import public_path, text_runs

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words kept by a Python worker; beyond that it starts anew.
CACHE = 1_000_000


def fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces with scores and kinds; texts to ids and back."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE):
        self.kind = kind
        self.ids: dict[str, int] = {}
        self.scores = [score for _, score, _ in pieces]
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        for i, (piece, _, of) in enumerate(pieces):
            text = piece.replace(MARK, " ")
            if of == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            else:
                if of in (NORMAL, USER):
                    self.ids[text] = i
                self.bytes_of.append(text.encode() if of in (NORMAL, USER) else b" \xe2\x81\x87 " if of == UNKNOWN else b"")
        if any(" " in x.lstrip(" ") for x in self.ids):
            raise ValueError("pieces that go on after a space are not supported")
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.scores, default=0.0) - 10
        self.alone: dict[int, bool] = {}
        self.beside: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        cut = "".join(x for x in "\n\t" if not any(x in p for p in self.ids))
        inside = re.escape(cut)
        self.find = re.compile(f"[{inside}]| *[^ {inside}]+| +" if cut else " *[^ ]+| +").findall

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as file:
            data = file.read()
        pieces, kind, dummy, squeeze, escape, chart = [], UNIGRAM, True, True, True, b""
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(fields(value))
                chart, dummy, squeeze, escape = own.get(2, b""), own.get(3, 1), own.get(4, 1), own.get(5, 1)
        if chart or squeeze or not dummy or not escape or kind not in (UNIGRAM, BPE):
            raise ValueError("only models that keep texts as they are, with a dummy prefix, are supported")
        return cls(pieces, kind)

    # BPE: is a piece, or a pair of pieces, what merging makes of its text?

    def merged(self, text: str) -> list[str]:
        """Symbols after merging, best score first, leftmost of equals."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                found = ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, where = scores[found], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def stands(self, piece: int, text: str) -> bool:
        found = self.alone.get(piece)
        if found is None:
            found = self.alone[piece] = len(self.merged(text)) == 1
        return found

    def joins(self, left: int, a: str, right: int, b: str) -> bool:
        key = left << 32 | right
        found = self.beside.get(key)
        if found is None:
            found = self.beside[key] = self.merged(a + b) == [a, b]
        return found

    def walk(self, words: list[str]):
        """Ids of each of the sorted words, as little-endian unsigned 32-bit bytes."""
        ids, scores, unigram = self.ids, self.scores, self.kind == UNIGRAM
        # by prefix length: the last piece's id (-1: a character without a piece) and length, the best score
        last, size, best = [0], [0], [0.0]
        before = ""
        for word in words:
            common = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], size[common + 1 :], best[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                chosen, length, top = -1, 1, None
                for n in range(min(self.longest, end), 0, -1):
                    start = end - n
                    text = word[start:end]
                    piece = ids.get(text)
                    if piece is None:
                        continue
                    if unigram:
                        score = best[start] + scores[piece]
                        if top is None or score > top:
                            chosen, length, top = piece, n, score
                    elif self.stands(piece, text):
                        left = last[start]
                        if not start or left < 0 or self.joins(left, word[start - size[start] : start], piece, text):
                            chosen, length = piece, n
                            break
                if unigram and ids.get(word[end - 1]) is None:
                    score = best[end - 1] + self.floor
                    if top is None or score > top:
                        chosen, length, top = -1, 1, score
                last.append(chosen)
                size.append(length)
                best.append(top if top is not None else 0.0)
            out, end = [], len(word)
            while end:
                if last[end] >= 0:
                    out.append(last[end])
                else:
                    own = word[end - 1].replace(" ", MARK).encode()
                    out += [self.byte_ids.get(x, self.unknown) for x in reversed(own)] if self.byte_ids else [self.unknown]
                end -= size[end]
            out.reverse()
            before = word
            yield struct.pack(f"<{len(out)}I", *out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes."""
        if len(self.known) > CACHE:
            self.known.clear()
        cut = [self.find(" " + x.replace(MARK, " ")) if x else [] for x in texts]
        new = sorted(set(chain.from_iterable(cut)).difference(self.known))
        self.known.update(zip(new, self.walk(new)))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """This process's model of a file."""
    if path not in _models:
        _models[path] = Model.load(path)
    return _models[path]


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids array<int>, n_tokens, decoded (the text made from the ids).

    Columns of these names in docs are replaced. Decoded texts are made from the ids
    alone; they differ from the text only where it holds the mark character itself.
    """
    kept = [x for x in docs.columns if x not in ("ids", "n_tokens", "decoded")]
    rows = docs.select(*[F.col(f"`{x}`") for x in kept])
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("ids array<int>, n_tokens long, decoded string")])
    where = kept.index(text)

    def scan(batches):
        tool = model(path)
        for batch in batches:
            for start, part in text_runs(batch.column(where).to_pylist()):
                found = tool.encode(part)
                values = np.frombuffer(b"".join(found), dtype="<u4").astype(np.int32)
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])])
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
                texts = [tool.decode(values[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([*[x.slice(start, len(part)) for x in batch.columns], ids, pa.array(np.diff(at)), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(scan, schema)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit), text_crc32 and decoded_crc32 (UTF-8), same."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_tokens long, ids_crc32 long, text_crc32 long, decoded_crc32 long, same boolean")])

    def scan(batches):
        tool = model(path)
        for batch in batches:
            rows = []
            for _, part in text_runs(batch.column(1).to_pylist()):
                for text, ids in zip(part, tool.encode(part)):
                    back = tool.decode(np.frombuffer(ids, dtype="<u4"))
                    rows.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(text.encode()), zlib.crc32(back.encode()), back == text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)]], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def public_model() -> str:
    return public_path("piece_bpe_32k.model")
