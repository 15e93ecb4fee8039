"""Operators over documents, against plain Python versions."""

import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kmerlake.llm import bpe, ctw, decontaminate, langid, near_dup, sentencepieces, sharding, spans, token_counts, token_files
from kmerlake.llm import shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts_of(rng: random.Random, n: int) -> list:
    words = ["the", "Of", "and", "naïve", "tion", "x1", "é", "a", "bb", "ccc", "日本", "end.", "don't"]
    out = [None, "", " ", "\n\n", "!!!", "a", "the the the the the the"]
    while len(out) < n:
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", ", "]) for _ in range(rng.randint(1, 60))))
    return out


def documents(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return texts_of(random.Random(5), 60)


def lower(text):
    return (text or "").encode().lower()


def test_words_and_hashes():
    texts = [b"ab cd ab", b"", b"ab", b" x\n"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    starts, ends, first = spans.words(data, offsets, spans.NONSPACE)
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(starts, ends)] == [b"ab", b"cd", b"ab", b"ab", b"x"]
    assert first.tolist() == [0, 3, 3, 4, 5]
    h = spans.span_hashes(data, starts, ends)
    assert h[0] == h[2] == h[3] and len(set(h.tolist())) == 3
    assert (h == spans.span_hashes(data, starts, ends, block=1)).all()


# 9


def brute_contamination(text, items):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", lower(text))
    hit, found = set(), set()
    for name, item in items:
        v = re.findall(rb"[0-9a-z\x80-\xff]+", lower(item))
        m = min(10, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("pattern_bytes", [8 << 20, 40])
def test_contamination(spark, texts, pattern_bytes):
    rng = random.Random(3)
    items = [(1, "THE end"), (2, None), (3, ""), (4, "zzz"), (10, " ".join(rng.choice("abcdefg") for _ in range(25))), (10, "ccc"), (None, "bb")]
    more = [*texts, "q " + items[4][1][4:40] + " r", items[4][1] + " " + items[4][1], items[4][1].upper()]
    docs = documents(spark, more)
    out = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), pattern_bytes=pattern_bytes).collect()
    assert len(out) == len(more)
    for r in out:
        assert tuple(r)[1:] == brute_contamination(more[r.doc_id], [x for x in items if x[0] is not None and x[1]]), more[r.doc_id]
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(more)


@pytest.mark.parametrize("pattern_bytes", [8 << 20, 4])
def test_clean_searches_for_items_without_an_id(spark, pattern_bytes):
    items = spark.createDataFrame([(None, "leaked words"), (None, "other"), (1, "named"), (None, None)], "item_id long, text string")
    docs = documents(spark, ["has Leaked words in it", "fine", "named here", "an other", "leaked"])
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items, pattern_bytes=pattern_bytes).collect()) == [1, 4]
    assert [(r.doc_id, r.n_hit) for r in decontaminate.contamination(docs, items, pattern_bytes=pattern_bytes).filter("n_hit > 0").collect()] == [(2, 1)]


# 1


def test_sentencepieces_equal_the_library(spark, texts):
    import sentencepiece

    path = sentencepieces.public_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    own = sentencepieces.Model.load(path)
    odd = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "日", "\t", "🙂", "ing", "x", "1"]) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["a" * 3000, " " * 50]
    for text in [*odd, *[t for t in texts if t]]:
        ids = np.frombuffer(own.encode([text])[0], dtype="<u4")
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == text
    out = {r.doc_id: r for r in sentencepieces.round_trips(documents(spark, texts), path).collect()}
    for i, text in enumerate(texts):
        ids = np.array(library.encode(text or ""), dtype="<u4").tobytes()
        assert (out[i].n_tokens, out[i].ids_crc32, out[i].same) == (len(ids) // 4, zlib.crc32(ids), True)
    more = sentencepieces.encoded(documents(spark, texts), path).collect()
    assert all(r.decoded == (r.text or "") for r in more)


def test_unigram_pass_is_viterbi():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -2.1, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -2.7, 1), ("ba", -4.9, 1), ("aba", -5.2, 1)]
    model = sentencepieces.Model(pieces, sentencepieces.UNIGRAM)
    score = {p.replace("▁", " "): s for p, s, _ in pieces[1:]}

    def best(text):
        table = [0.0]
        for end in range(1, len(text) + 1):
            table.append(max(table[end - n] + score[text[end - n : end]] for n in range(1, end + 1) if text[end - n : end] in score))
        return table[-1]

    for n in range(1, 7):
        for text in map("".join, itertools.product("ab", repeat=n)):
            ids = np.frombuffer(model.encode([text])[0], dtype="<u4")
            assert model.decode(ids) == text
            assert math.isclose(sum(pieces[i][1] for i in ids), best(" " + text))


# 5, 7


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    path = bpe.public_path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    many = texts * 4
    out = sorted(token_files.token_files(documents(spark, many), path).collect())
    start = 0
    for i, r in enumerate(out):
        ids = np.array(tool.encode(many[i] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(documents(spark, []), path).count() == 0
    frames = [b"".join(np.array(x, dtype="<u2").tobytes() for x in ([1, 2, 3],))]
    import zstandard

    file = token_files.pack_shard([zstandard.compress(x) for x in frames], [3], 2, b"")
    assert token_files.ShardReader(io.BytesIO(file)).document(0).tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        token_files.ShardReader(io.BytesIO(b"x" * 64))


def test_added_tokens_are_encoded_as_by_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.public_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "one two<|endoftext|>three four\nfive", "plain\na <|endoftext|>\n\nb", "no <|endoftex|> token here", "a <|endoftext|> b"]
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert [50256 in x for x in want] == [True, True, True, False, True]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.Encoder(path).encode(texts)] == want
    assert [r.new_tokens for r in token_counts.with_bpe_counts(documents(spark, texts), path).orderBy("doc_id").collect()] == [len(x) for x in want]


def test_marks_and_odd_lines_cost_no_more_words(monkeypatch):
    from tokenizers import Tokenizer

    path = bpe.public_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = lambda texts: [np.array(library.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    tool = bpe.Encoder(path)
    marked = "first " + " ".join(f"Stra\u00dfe{a}{b}" for a in ".,;:!?" for b in ("", ")", "'", '"'))
    # a word is known once, whatever marks follow it; lines after an odd one are cut again
    texts = [marked, "an odd\t line\n" + "\n".join(["one of", "two, of", "one of"] * 3)]
    assert tool.encode(texts) == ids(texts)
    assert [x for x in (getattr(tool.later, "known", tool.later)) if x.startswith("Stra")] == ["Stra\u00dfe"]
    assert {"one", "two"} <= set(getattr(tool.first, "known", tool.first))
    # pieces are kept up to a limit, and ids stay those of the library
    monkeypatch.setattr(bpe, "CACHE", 40)
    rng = random.Random(7)
    bits = ["\n", "\n\n", " ", "  ", "\t", "\r\n", "the", "don't", "it's", "na\u00efve,", "x1", "3.14,", "--", "!", "<|endoftext|>", "\u65e5", "\u0120\u010a", "\u00a0", "\u01c3", "a" * 60, "\x00", "'s", "\u00d7"]
    for _ in range(200):
        texts = ["".join(rng.choice(bits if rng.random() < 0.5 else ["the ", "of\n", "a, ", f"w{rng.randrange(50)}. ", "W\u00f6rter "]) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(9))]
        assert tool.encode(texts) == ids(texts)
        assert len(tool.later.known) + len(tool.first.known) <= 40


def test_rollups(spark, texts):
    from tokenizers import Tokenizer

    path = bpe.public_path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    docs = documents(spark, texts).select("text", "source", "lang").withColumn("old_tokens", token_counts.counted_words(__import__("pyspark").sql.functions.col("text")))
    store = token_counts.Rollups(spark, shared.new_folder(spark, "t"))
    assert store.totals().count() == 0
    first = token_counts.signed(docs, None, docs.old_tokens, new_version="w")
    assert store.commit("a", first) and not store.commit("a", first)
    words = Counter()
    for i, t in enumerate(texts):
        words["s" if i % 3 else None] += len(lower(t).split())
    assert {r.source: r.n_tokens for r in store.totals().collect()} == {k: v for k, v in words.items()}
    counted = token_counts.with_bpe_counts(docs, path)
    second = token_counts.signed(counted, counted.old_tokens, counted.new_tokens, "w", "b")
    assert store.commit("b", second) and not store.commit("b", second)
    ids = Counter()
    for i, t in enumerate(texts):
        ids["s" if i % 3 else None] += len(tool.encode(t or "", add_special_tokens=False).ids)
    assert {(r.source, r.tokenizer): r.n_tokens for r in store.totals().collect()} == {(k, "b"): v for k, v in ids.items()}
    with pytest.raises(ValueError):
        store.commit("../x", first)


def test_upserts(spark):
    ledger = spark.createDataFrame([(1, "s", "en", "w", 5), (2, "s", "en", "w", 7)], "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    batch = spark.createDataFrame([(1, "s", "de", "w", 6, False), (2, "s", "en", "w", 0, True), (3, "r", None, "w", 1, False), (9, "r", "en", "w", 1, True)], "doc_id long, source string, lang string, tokenizer string, n_tokens long, gone boolean")
    got = {tuple(r) for r in token_counts.upserts(ledger, batch).collect()}
    assert got == {("s", "en", "w", -1, -5), ("s", "de", "w", 1, 6), ("s", "en", "w", -1, -7), ("r", None, "w", 1, 1)}


# 6


def spark_hash(parts):
    """Spark's xxhash64 of strings and ints, chained from seed 42."""
    import xxhash

    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else int(p).to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def test_hash_tree(spark, texts):
    docs = documents(spark, texts * 5)
    out = sharding.sharded(docs, 12, 13).collect()
    assert len(out) == len(texts) * 5

    def draw(i, s):
        return -math.log(((spark_hash([str(i), s]) >> 11) + 0.5) / 2**53)

    slots = defaultdict(list)
    for r in out:
        text = (texts * 5)[r.doc_id]
        assert r.shard == min(range(12), key=lambda s: draw(r.doc_id, s))
        assert r.grown_shard == min(range(13), key=lambda s: draw(r.doc_id, s)) and r.grown_shard in (r.shard, 12)
        assert r["size"] == len((text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text or "").encode())
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    heavy = {r.doc_id: r.shard for r in sharding.sharded(docs, 12, weights={3: 4.0, 5: 0.0}).collect()}
    for r in out:
        assert heavy[r.doc_id] in ((r.shard, 3) if r.shard != 5 else range(12)) and heavy[r.doc_id] != 5
    assert sharding.sharded(documents(spark, []), 3).count() == 0
    assert sharding.sharded(spark.createDataFrame([(None, "a"), (None, "a"), (4, None)], "doc_id long, text string"), 3).count() == 3


# 8


def test_base_scores_and_model(spark, texts):
    from pyspark.sql import functions as F

    docs = documents(spark, texts)
    out = {r.doc_id: r for r in ctw.score_documents(docs, ctw.held_out_of(F.col("doc_id"))).collect()}
    tokens = {i: [*(w for w in re.findall(rb"[^\x20\x09-\x0D]+", lower(t))), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(x for i, v in tokens.items() if not held[i] for x in v)
    n, v = sum(c.values()), len(c)
    for i, own in tokens.items():
        r = out[i]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(c[x] > 0 for x in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and -1e9 < r.score < 0
    assert ctw.score_documents(documents(spark, []), ctw.held_out_of(F.col("doc_id"))).count() == 0
    assert ctw.score_documents(documents(spark, [None, ""]), F.lit(True)).count() == 2


def test_chunks_are_zipped(spark):
    """Chunks hold their rows' whole streams, and are much smaller than these in the JVM."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["The", "mat", "naïve", "日本", "\t"]) for _ in range(n)) for n in (*[3000] * 60, 0, 1, 200_000)]
    rows = [(i if i else None, i % 3 > 0, t) for i, t in enumerate([*texts, None])]
    chunks = ctw.packed(spark.createDataFrame(rows, "__row long, __train boolean, __text string").coalesce(1)).collect()
    assert sum(len(c["stream"]) for c in chunks) < sum(len(t.encode()) for t in texts) / 2
    got = []
    for c in chunks:
        ids, missing, train = (ctw.unzipped(c[k], kind) for k, kind in (("ids", np.int64), ("missing", bool), ("train", bool)))
        stream, at = ctw.unzipped(c["stream"], np.uint8), ctw.unzipped(c["at"], np.int64)
        assert c["bytes"] == len(stream) == at[-1]
        got += [(None if m else i, t, stream[a:b].tobytes()) for i, m, t, a, b in zip(ids.tolist(), missing, train, at, at[1:])]
    assert sorted(got, key=str) == sorted(((i, t, b" ".join(lower(x or "").split()) + b"\n") for i, t, x in rows), key=str)


def test_streams_need_little_beside_themselves():
    import tracemalloc

    data = np.frombuffer(b"some Words and spaces " * 100_000, dtype=np.uint8)
    offsets = np.arange(0, len(data) + 1, 2200)
    want = ctw.streams(data, offsets)
    tracemalloc.start()
    got = ctw.long_streams(data, offsets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and most < 12 * len(data)


def test_grams_are_sorted_in_place():
    import tracemalloc

    rng = np.random.default_rng(6)
    stream = rng.integers(97, 105, 2 << 20).astype(np.uint8)
    at = np.arange(0, len(stream) + 1, 1 << 12)
    stream[at[1:] - 1] = ctw.END
    peaks = []
    for f in (lambda: ctw.gram_counts(stream, at, np.ones(len(stream), dtype=bool)), lambda: ctw.placed_grams(stream, at)):
        tracemalloc.start()
        f()
        peaks.append(tracemalloc.get_traced_memory()[1] / len(stream))
        tracemalloc.stop()
    assert peaks[0] < 20 and peaks[1] < 24, peaks


def test_context_tree_probabilities():
    """The mixture equals the ratio of weighted probabilities of sequences, for every context and symbol."""
    rng = random.Random(2)
    depth, bits = 2, 2
    seen = Counter()
    for _ in range(400):
        seen[rng.choice([0, 1, 5]), rng.choice([0, 3]), min(3, int(rng.expovariate(1.2)))] += 1
    keys = np.array([(a << 5 | b) << bits | s for (a, b, s) in seen])
    counts = np.array(list(seen.values()), dtype=float)
    order = np.argsort(keys)
    table, use = ctw.weighted_tables(keys[order], counts[order], bits, depth)
    assert np.allclose(np.exp(table).sum(axis=1), 1)

    def weighted(node, context, extra=None):
        """ln of the weighted probability at a context (newest first) for the decision at node."""
        a = b = 0
        level = node.bit_length() - 1
        for (o, n, s), c in seen.items():
            full = (n, o)
            if full[: len(context)] == context and (1 << level | s >> (bits - level)) == node:
                bit = s >> (bits - 1 - level) & 1
                a, b = a + c * (1 - bit), b + c * bit
        if extra is not None and extra[0][: len(context)] == context:
            a, b = a + (extra[1] == 0), b + (extra[1] == 1)
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == depth:
            return own
        below = {(n, o)[: len(context) + 1] for (o, n, s) in seen if (n, o)[: len(context)] == context}
        return np.logaddexp(own, sum(weighted(node, c, extra) for c in below)) - math.log(2)

    for o, n in {(o, n) for o, n, _ in seen}:
        for s in range(4):
            want, complete = 0.0, True
            for level in range(bits):
                node, bit = 1 << level | s >> (bits - level), s >> (bits - 1 - level) & 1
                # where the decision was never met in the full context the path ends earlier, by definition
                complete &= any((1 << level | t >> (bits - level)) == node and (p, q) == (o, n) for p, q, t in seen)
                want += weighted(node, (), ((n, o), bit)) - weighted(node, ())
            if complete:
                assert math.isclose(table[use[o << 5 | n], s], want, abs_tol=1e-6)


def test_scores_mix_all_byte_contexts(spark):
    """Scores are the products of a plain byte-wise mixture, for rare bytes and other scripts, too."""
    rng = random.Random(4)
    words = ["the", "quick", "x1", "q9", "naïve", "日本語", "привет", "мир", "zj~"]
    rows = [(i, i % 4 > 0, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    got = {r["__row"]: r["score"] for r in ctw.scored(spark.createDataFrame(rows, "__row long, __train boolean, __text string"), 5).collect()}
    depth = 5
    streams = {i: t.encode() + b"\n" for i, _, t in rows}

    def steps(stream):
        for at in range(len(stream)):
            before = (b"\n" * depth + stream)[at : at + depth]
            for level in range(8):
                yield before, stream[at] >> (8 - level) | 1 << level, stream[at] >> (7 - level) & 1

    seen, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for i, train, _ in rows:
        for before, node, bit in steps(streams[i]) if train else ():
            for d in range(depth + 1):
                seen[before[depth - d :], node][bit] += 1
                if d < depth:
                    children[before[depth - d :], node].add(before[depth - d - 1 :])
    kt = {x: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for x, (a, b) in seen.items()}
    weighted = {}
    for x in sorted(seen, key=lambda x: -len(x[0])):
        weighted[x] = kt[x] if len(x[0]) == depth else np.logaddexp(kt[x], sum(weighted[c, x[1]] for c in children[x])) - math.log(2)

    def mixture(before, node, d=0):
        """The probability of a one from depth d down."""
        x = before[depth - d :], node
        a, b = seen[x]
        own = (b + 0.5) / (a + b + 1)
        deeper = before[depth - d - 1 :], node
        if d == depth or deeper not in kt:
            return own
        stop = math.exp(kt[x] - weighted[x] - math.log(2))
        return stop * own + (1 - stop) * mixture(before, node, d + 1)

    for i, stream in streams.items():
        want = 0.0
        for before, node, bit in steps(stream):
            p = mixture(before, node) if (b"", node) in kt else 0.5
            want += math.log10(p if bit else 1 - p)
        assert math.isclose(got[i], want, rel_tol=1e-5)


# 3


def test_language_id(spark):
    rng = random.Random(1)
    parts = {"en": "the of and ing tion that with", "de": "der die und ung schaft nicht ein", "fr": "le de et eau tion que une", "es": "el la y ción que una los"}
    texts, langs = [], []
    for i in range(400):
        lang = rng.choice(list(parts))
        texts.append(" ".join(rng.choice(parts[lang].split()) + rng.choice(["", rng.choice(parts[lang].split())]) for _ in range(30)))
        langs.append(lang)
    texts += [None, "", "123 !!", "日本"]
    langs += [None, "en", "en", None]
    out = {r.doc_id: r for r in langid.identified(documents(spark, texts, langs)).collect()}
    right = [out[i].lang_pred == langs[i] for i in range(400) if out[i].held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (400, 401, 402))
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.values())
    assert langid.identified(documents(spark, [])).count() == 0
    unlabelled = langid.identified(documents(spark, ["the"], [None])).first()
    assert unlabelled.lang_pred == "und"
    kept = langid.accepted(documents(spark, texts, langs).withColumnRenamed("n_chars", "score"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"] and kept.count() >= 398


# 10


def brute_classes(texts):
    grams = [near_dup.shingle_list(t or "") for t in texts]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = grams[i], grams[j]
        if a == b and (a or (texts[i] is not None and texts[i] == texts[j])):
            same = True
        else:
            m = lcs(a, b) if a and b else 0
            same = bool(m) and m / (len(a) + len(b) - m) >= 0.8
        if same:
            x, y = sorted((find(i), find(j)))
            top[y] = x
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [None, None, "", "", "!!", "one", "one", "One!", "one two three"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own).title())
    star = [rng.choice(words) for _ in range(100)]
    for i in range(30):  # each is near the middle one, few are near each other
        own = list(star)
        own[(i * 3) % 100] = f"x{i}"
        own[(i * 3 + 50) % 100] = f"y{i}"
        texts.append(" ".join(own))
    texts.append(" ".join(star))
    want = brute_classes(texts)
    classes, table, links = near_dup.near_duplicates(documents(spark, texts))
    out = near_dup.with_links(classes, table, links).collect()
    assert {r.doc_id: r.class_id for r in out} == dict(enumerate(want))
    assert {r.doc_id: r.n_class for r in out} == {i: want.count(c) for i, c in enumerate(want)}
    kept = near_dup.kept_one(documents(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))
    assert near_dup.kept_one(documents(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "__uid long, text string")
    assert near_dup.kept_one(twice, "__uid").count() == 2


def test_aligned_pairs_are_named_as_such(spark):
    text = " ".join(f"w{i}" for i in range(60))
    found = near_dup.near_duplicates(documents(spark, [text, text + " more", "else"]))
    out = near_dup.with_links(*found)
    assert out.columns == ["doc_id", "class_id", "n_class", "n_aligned"]
    assert sorted(map(tuple, out.collect())) == [(0, 0, 2, 1), (1, 0, 2, 1), (2, 2, 1, 0)]


def test_alignment_matches_plain_lcs():
    rng = random.Random(8)
    for _ in range(60):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(5, 40))]
        b = [x if rng.random() > 0.03 else "z" for x in a]
        x, y = near_dup.shingle_list(" ".join(a)), near_dup.shingle_list(" ".join(b))
        row = [0] * (len(y) + 1)
        for p in x:
            before = 0
            for j, q in enumerate(y):
                before, row[j + 1] = row[j + 1], before + 1 if p == q else max(row[j + 1], row[j])
        want = row[-1] / (len(x) + len(y) - row[-1])
        got = near_dup.aligned(x, y, 0.8)
        assert math.isclose(got, want) if want >= 0.8 else got == 0


def test_bit_tables_never_reject_a_link():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 900)
        a = np.array([rng.getrandbits(63) for _ in range(n)], dtype=np.uint64)
        changed = rng.randint(0, max(1, n // 8))
        b = np.concatenate([a[changed:], np.array([rng.getrandbits(63) for _ in range(rng.randint(0, changed))], dtype=np.uint64)])
        common = n - changed
        x, y = (np.frombuffer(near_dup.flipped_bits(v), dtype=np.uint64) for v in (a, b))
        size = min(len(x), len(y))
        x, y = near_dup.folded(x, size), near_dup.folded(y, size)
        apart = near_dup.surely_apart(x[None], np.array([len(a)]), y, len(b), 0.8)[0]
        if common / (len(a) + len(b) - common) >= 0.8:
            assert not apart
    far = [near_dup.flipped_bits(np.array([rng.getrandbits(63) for _ in range(150)], dtype=np.uint64)) for _ in range(2)]
    assert near_dup.surely_apart(np.frombuffer(far[0], dtype=np.uint64)[None], np.array([150]), np.frombuffer(far[1], dtype=np.uint64), 150, 0.8)[0]


def test_large_buckets_are_dealt_into_tiles(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for _ in range(40):  # copies with some words of their own: some are links of one another, some are not
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    want = brute_classes(texts)
    assert len(set(want)) > 1
    for tile in (3, 1024):
        classes, _, _ = near_dup.near_duplicates(documents(spark, texts), tile=tile)
        assert {r["__id"]: r.class_id for r in classes.collect()} == dict(enumerate(want))


def test_recall_at_the_bar(spark):
    """Of pairs just over the bar, both families of sketches find 0.9 at least."""
    rng = random.Random(11)
    for length, edits in ((50, 1), (195, 4)):
        texts = []
        while len(texts) < 300:
            own = [f"w{rng.getrandbits(30)}" for _ in range(length)]
            near = list(own)
            for place in rng.sample(range(5, length - 5), edits):
                near[place] = f"w{rng.getrandbits(30)}"
            pair = [" ".join(own), " ".join(near)]
            if 0.8 <= near_dup.aligned(*map(near_dup.shingle_list, pair), 0.8) < 0.83:
                texts += pair
        classes, _, _ = near_dup.near_duplicates(documents(spark, texts))
        found = {r["__id"]: r.class_id for r in classes.collect()}
        assert sum(found[i] == found[i + 1] for i in range(0, 300, 2)) >= 0.9 * 150


def test_grams_of_a_chunk_are_counted_and_summed_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    stream = rng.choice(np.frombuffer(b"abcde ", dtype=np.uint8), 1 << 21)
    at = np.unique(np.append(rng.integers(1, len(stream), 500), [0, 1, 2, 3, len(stream)]))
    stream[at[1:] - 1] = ctw.END
    train = np.repeat(rng.random(len(at) - 1) < 0.9, np.diff(at))
    plain = np.array([sum(int(([ctw.END] * 5 + list(stream[s:e]))[i + 5 - back]) << 8 * (5 - back if back else 0) + (8 if back else 0) for back in range(6)) for s, e in zip(at[:9], at[1:10]) for i in range(min(e - s, 40))], dtype=np.uint64)
    begin = np.concatenate([np.arange(s, min(e, s + 40)) for s, e in zip(at[:9], at[1:10])])
    assert (ctw.context_keys(stream, at)[begin] == plain).all()
    every = ctw.context_keys(stream, at)
    want_keys, want = ctw.in_training(every, train)
    values = rng.random(len(want_keys))
    want_along = np.append(0.0, np.cumsum(values[np.searchsorted(want_keys, every)]))
    del every
    tracemalloc.start()
    keys, counts = ctw.gram_counts(stream, at, train)
    own, order = ctw.placed_grams(stream, at)
    along = ctw.summed_along(own, values, order)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (keys == want_keys).all() and (counts == want).all() and (own == keys).all() and (along == want_along).all()
    assert peak < 30 * len(stream)


def test_slices_of_a_part_grow_the_same_tree(monkeypatch):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 12, 5000, dtype=np.uint64) * np.uint64(0x1000101) % np.uint64(1 << 48))
    counts = rng.integers(0, 4, len(keys))
    whole = ctw.subtrees(keys, counts)
    want = ctw.log_probabilities(keys, [*ctw.crown([whole[1]]), *whole[0]])
    monkeypatch.setattr(ctw, "SLICE", 100)
    assert len(ctw.slices(keys)) > 5
    adds = ctw.added_by(keys, counts)
    assert (adds[0] == whole[1][0]).all() and np.allclose(adds[3], whole[1][3], rtol=1e-12)
    assert np.allclose(ctw.grown(keys, counts, ctw.crown([adds])), want, rtol=1e-6)


def test_bulky_rows_get_small_row_groups(spark):
    import os

    import pyarrow.parquet as pq

    folder = shared.new_folder(spark, "bulky")
    rows = spark.range(40, numPartitions=1).selectExpr("id", "encode(array_join(transform(sequence(1, 60000), x -> md5(cast(x * 41 + id as string))), ''), 'utf-8') as b")
    shared.written(rows, folder, bulky=True)
    file = next(x for x in os.scandir(folder.removeprefix("file:").replace("//", "/")) if x.name.endswith(".parquet"))
    groups = pq.ParquetFile(file.path).metadata
    assert groups.num_row_groups > 2 and max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 32 << 20
