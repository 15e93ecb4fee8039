"""Byte-level BPE ids of whole texts, each distinct piece encoded once.

The pre-tokenisation of byte-level tokenizers that split by their usual pattern ends a
token before a single space that a non-space follows, and on both sides of a single line
feed between non-spaces, and also between a letter or digit and an ASCII mark after it. Lines
of plain words are therefore cut at single spaces and before the marks at a word's end, and a
distinct piece that is not known yet goes through the tokenizers library once, words of letters
alone, which that pattern does not cut, straight through its model, many at a time. Lines of
anything else go through the library whole, with the line feeds around them, so the ids are always
those of the whole text. So does all of a text that holds an added token's own text, such as
<|endoftext|>, which is one id, and every text for a tokenizer that is not known to be of that kind.

Lines and pieces of a run of texts are cut, compared and numbered as Arrow arrays; Python
sees a run's distinct pieces only.
"""

from __future__ import annotations

import itertools
import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of printable ASCII and Latin letters, single spaces between them.
_PLAIN = "^[!-~À-ÖØ-öø-ɏ]+(?: [!-~À-ÖØ-öø-ɏ]+)*$"
#: Marks, which may follow a piece's letters and digits.
_MARKS = "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum())
#: Bytes that byte-level vocabularies show as they are; the others are shown as the characters from 256 on.
SHOWN = (range(33, 127), range(161, 173), range(174, 256))
_LATER = [b for b in range(256) if not any(b in r for r in SHOWN)]
_CHARACTERS = np.arange(256, dtype="<u4")
_CHARACTERS[_LATER] = np.arange(256, 256 + len(_LATER))
#: Stands between what the model is to take as words of their own; as a character it is in no vocabulary of that kind.
_CUT = "\t"
_CHARACTERS[ord(_CUT)] = ord(_CUT)
#: Pieces kept by a Python worker, of LONGEST characters at most; beyond that it starts anew with those just asked for.
CACHE = 600_000
LONGEST = 48
#: So many pieces go through the model in one call.
AT_ONCE = 50
_encoders: dict[str, Encoder] = {}


class Pieces:
    """Ids of pieces that follow `before`, a space or nothing."""

    def __init__(self, encoder: Encoder, before: str, every: list[Pieces]):
        self.encoder, self.before, self.every = encoder, before, every
        self.known: dict[str, bytes] = {}
        every.append(self)

    def ids(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces of printable ASCII and Latin letters."""
        bodies = pc.utf8_rtrim(pieces, characters=_MARKS)
        bodies = pc.if_else(pc.equal(pc.binary_length(bodies), 0), pieces, bodies)
        each = bodies.dictionary_encode()
        found = list(map(self.of(_strings(each.dictionary)).__getitem__, each.indices.to_numpy().tolist()))
        sizes = pc.subtract(pc.binary_length(pieces), pc.binary_length(bodies)).to_numpy()
        marked = np.flatnonzero(sizes)
        marks = [x[-n:] for x, n in zip(_strings(pieces.take(pa.array(marked))), sizes[marked].tolist())]
        distinct = list(dict.fromkeys(marks))
        ids = dict(zip(distinct, self.encoder.first.of(distinct)))
        for i, x in zip(marked.tolist(), marks):
            found[i] += ids[x]
        return found

    def of(self, bodies: list[str]) -> list[bytes]:
        """Ids of distinct pieces without the marks after them, or of marks alone; what is not known is encoded."""
        found = list(map(self.known.get, bodies))
        new = [i for i, x in enumerate(found) if x is None]
        words = [i for i in new if bodies[i].isalpha()]
        for low in range(0, len(words), AT_ONCE):
            part = words[low : low + AT_ONCE]
            for i, x in zip(part, self.encoder.of_words([bodies[i] for i in part], self.before), strict=True):
                found[i] = x
        others = [i for i in new if found[i] is None]
        for i, x in zip(others, self.encoder.whole([self.before + bodies[i] for i in others]), strict=True):
            found[i] = x
        fresh = {bodies[i]: found[i] for i in new if len(bodies[i]) <= LONGEST}
        if sum(len(x.known) for x in self.every) + len(fresh) > CACHE:
            for x in self.every:
                x.known = {}
            fresh = dict(itertools.islice(((x, y) for x, y in zip(bodies, found) if len(x) <= LONGEST), CACHE))
        self.known.update(fresh)
        return found


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer file is byte-level BPE with the usual splitting pattern and nothing that changes texts."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    before, model = whole.get("pre_tokenizer") or {}, whole.get("model") or {}
    own = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return bool(own and plain and model.get("type") == "BPE" and not any(whole.get(x) for x in ("normalizer", "post_processor", "truncation", "padding")))


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_file(path)
        #: the largest id that may occur
        self.largest = max([*self.tool.get_vocab().values(), 0])
        #: texts that the library takes for one token wherever they stand
        self.added = [x.content for x in self.tool.get_added_tokens_decoder().values()]
        every: list[Pieces] = []
        self.first = Pieces(self, "", every)  # pieces at a line's start
        self.later = Pieces(self, " ", every)  # pieces that a space precedes
        self.feed = self.whole(["\n"])[0]
        self.cuts = cuts_at_spaces(path) and array("I").itemsize == 4 and len(self.feed) == 4
        #: the same model, for words in the vocabulary's characters
        self.words = Tokenizer(self.tool.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_CUT)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, by the library alone."""
        found = self.tool.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def of_words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of letters, of which `before` precedes each; a line feed's id parts them."""
        text = before + f"{_CUT}\n{_CUT}{before}".join(words)
        shown = _CHARACTERS[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
        raw = array("I", self.words.encode_batch_fast([shown], add_special_tokens=False)[0].ids).tobytes()
        feeds = 4 * np.flatnonzero(np.frombuffer(raw, dtype="<u4") == np.frombuffer(self.feed, dtype="<u4"))
        return [raw[i:j] for i, j in zip([0, *(feeds + 4).tolist()], [*feeds.tolist(), len(raw)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts or not texts:
            return self.whole(texts)
        every = pa.array(texts, pa.large_string())
        cut = pc.split_pattern(every, "\n")
        lines, lines_at = cut.values, cut.offsets.to_numpy()
        plain = _flags(pc.match_substring_regex(lines, _PLAIN))
        for added in self.added:
            plain &= ~np.repeat(_flags(pc.match_substring(every, added)), np.diff(lines_at))

        # a stretch is a plain line between plain lines, or an odd line with the lines around it
        begins = plain.copy()
        begins[1:] &= plain[:-1]
        begins[lines_at[:-1]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(lines))
        own = plain[starts] & (ends - starts == 1)
        stretches = lines.take(pa.array(starts))
        odd = np.flatnonzero(~own)
        if len(odd):
            whole = self.whole(["\n".join(lines[i:j].to_pylist()) for i, j in zip(starts[odd].tolist(), ends[odd].tolist())])
            stretches = pc.if_else(pa.array(own), stretches, pa.scalar("", pa.large_string()))

        # pieces by number: after a space; k more at a text's start; 2 k more after a line feed; odd stretches are the last
        cut = pc.split_pattern(stretches, " ")
        pieces_at, pieces = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        k, codes = len(pieces.dictionary), pieces.indices.to_numpy().astype(np.int64)
        opens = np.zeros(len(lines), dtype=bool)
        opens[lines_at[:-1]] = True
        opens = opens[starts]
        codes[pieces_at[:-1]] += np.where(opens, k, 2 * k)
        codes[pieces_at[odd]] = 3 * k + np.arange(len(odd))
        used = np.flatnonzero(np.bincount(codes, minlength=3 * k + len(odd)))
        after, at_start, after_feed, _ = np.split(used, np.searchsorted(used, [k, 2 * k, 3 * k]))
        ids = self.later.ids(pieces.dictionary.take(pa.array(after)))
        ids += self.first.ids(pieces.dictionary.take(pa.array(at_start - k)))
        ids += [self.feed + x for x in self.first.ids(pieces.dictionary.take(pa.array(after_feed - 2 * k)))]
        if len(odd):
            ids += [x if o else self.feed + x for x, o in zip(whole, opens[odd].tolist())]

        # each piece's ids in the texts' order
        raw = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes, froms = np.zeros((2, 3 * k + len(odd)), dtype=np.int64)
        sizes[used] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        froms[used] = np.cumsum(sizes[used]) - sizes[used]
        size = sizes[codes]
        until = np.concatenate([[0], np.cumsum(size)])
        out = raw[np.arange(until[-1]) + np.repeat(froms[codes] - until[:-1], size)].tobytes()
        bounds = (4 * until[pieces_at[np.searchsorted(starts, lines_at)]]).tolist()
        return [out[i:j] for i, j in itertools.pairwise(bounds)]


def _flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def _strings(found: pa.Array) -> list[str]:
    return found.to_numpy(zero_copy_only=False).tolist()


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_runs(texts: list[str | None], limit: int = 4 << 20):
    """(start, texts) of about limit characters each; nulls are empty."""
    start, part, size = 0, [], 0
    for i, text in enumerate(texts):
        part.append(text or "")
        size += len(text or "")
        if size >= limit:
            yield start, part
            start, part, size = i + 1, [], 0
    if part:
        yield start, part
