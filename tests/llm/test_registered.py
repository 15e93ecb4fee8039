"""The registered queries, run as the driver runs them, over small tables with every odd case, against plain versions.

The documents hold null, empty and very long texts, ties, repeated rows, null and repeated
ids, and columns that are called like those that operators add.
"""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from kmerlake.llm import bpe, sentencepieces, sharding

from .test_text_operators import brute_classes, brute_contamination, lower, spark_hash, texts_of

CLASHES = "ids int, n_tokens string, decoded int, score string, lang_pred int, __spans string, __items string, __uid string, __text int, shard string, slot string, start string, size string, part string, c0 string, n string, class_id string, held_out string, draw string, old_tokens string, new_tokens int"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
TABLES = {"documents": DOCUMENTS, "benchmark": "item_id long, text string, ids int, __spans string", "embeddings": "vec_id long, embedding array<float>, score int, row string, n string", "conversations": "conv_id long, turn long, role string, text string, place string, part int, n_turns string"}
ITEM = " ".join(f"q{i}" for i in range(15))


def rows_of():
    rng = random.Random(21)
    texts = texts_of(rng, 40)
    base = [f"w{rng.randint(0, 300)}" for _ in range(90)]
    texts += [" ".join(base), " ".join(base[:-1]), " ".join(base).upper(), "one " + ITEM + " two", " ".join(rng.choice(["the", "of", "naïve", "x9", "日本"]) for _ in range(30_000)), "<|endoftext|> a", None, "日本語 привет"]
    rows = [(i, t, ["en", "fr", None][i % 3], "s" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (5, "another text of id 5", "fr", "t"), (None, "no id here", "en", "s"), (None, None, None, None), (2**60 + 1, "a large id", "en", "s")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    extra = [None] * len(CLASHES.split(","))
    spark.createDataFrame([(*r, *extra) for r in rows], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM, 0, "x"), (2, None, 0, ""), (None, "the the the", None, None)], TABLES["benchmark"]).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: [r.asDict() for r in entry.queries()[next(q for q in entry.queries() if q.startswith(name))](spark, folder).collect()]


def ids_of(rows):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))
    return [tool.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows]


def test_op1(run, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.public_model())
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(library.encode(t or ""), dtype="<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes()), True] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["same"]) for r in run("op1_")) == want


def test_op3(run, rows):
    out = run("op3_")
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    letters = {(i, t is not None and any(map(str.isalpha, t))) for i, t, *_ in rows}
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] in ("en", "fr") and 0 <= r["score"] <= 1) if (r["doc_id"], False) not in letters else r["lang_pred"] in ("en", "fr", "und")


def test_op5(run, rows):
    out = sorted(run("op5_"), key=lambda r: r["start"])
    assert [r["doc_id"] is not None and r["doc_id"] for r in out] == sorted((r[0] is not None and r[0] for r in rows), key=lambda x: -1 if x is False else x)
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    want = Counter()
    for (i, *_), ids in zip(rows, ids_of(rows)):
        raw = np.array([*ids, 0], dtype="<u4").tobytes()
        want[i, len(raw) // 4, zlib.crc32(raw)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want


def test_op6(run, rows):
    def draw(i, s):
        return -math.log(((spark_hash([str(i) if i is not None else "\x00null", s]) >> 11) + 0.5) / 2**53)

    slots, got = defaultdict(list), Counter()
    for r in run("op6_"):
        i = r["doc_id"]
        assert (r["law"], r["shard"], r["grown_shard"]) == ("key", *(min(range(n), key=lambda s: draw(i, s)) for n in (40, 41)))
        slots[r["shard"]].append(r["slot"])
        got[i, r["size"], r["text_crc32"]] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert got == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sharding.tree_of(40) == sharding.tree_of(41)[:4]


def test_op7(run, rows):
    want, docs = Counter(), Counter()
    for (_, _, lang, source, *_), ids in zip(rows, ids_of(rows)):
        want[source, lang] += len(ids)
        docs[source, lang] += 1
    got = {(r["source"], r["lang"]): (r["tokenizer"], r["n_docs"], r["n_tokens"]) for r in run("op7_")}
    assert got == {x: ("byte_bpe_50k", docs[x], want[x]) for x in docs}


def test_op8(run, rows):
    import re

    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", lower(t)), None] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    c = Counter(x for own, h in zip(tokens, held) if not h for x in own)
    n, v = sum(c.values()), len(c)
    shown = lambda i, h, size, known, base: (i, h, size, known, n, round(base, 6))
    want = Counter(shown(i, h, len(own), sum(c[x] > 0 for x in own), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)) for (i, *_), h, own in zip(rows, held, tokens))
    out = run("op8_")
    assert Counter(shown(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in out) == want and {r["train_tokens"] for r in out} == {n}
    # the model's own probabilities are held against a plain mixture in test_scores_mix_all_byte_contexts
    by_size = {}
    for r in out:
        assert r["score"] < 0 and by_size.setdefault((r["doc_id"], r["n_tokens"], round(r["base_score"], 6)), r["score"]) == r["score"]


def test_op9(run, rows):
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in run("op9_"))
    # the long text has no passage; its words are counted without the slow search
    want = Counter((i, *(brute_contamination(t, [(1, ITEM)]) if len(t or "") < 9999 else (*brute_contamination(t, [])[:1], *brute_contamination("", [])[1:]))) for i, t, *_ in rows)
    assert got == want and sum(n for x, n in got.items() if x[-1]) == 1


def test_op10(run, rows):
    texts = [t if t is None or len(t) < 9999 else f"long {zlib.crc32(t.encode())}" for _, t, *_ in rows]
    classes = defaultdict(list)
    for row, c in zip(rows, brute_classes(texts)):
        classes[c].append(row[0])
    want = Counter()
    for own in classes.values():
        known = [x for x in own if x is not None]
        for x in own:
            want[x, min(known) if known else None, len(own)] += 1
    assert Counter((r["doc_id"], r["class_id"], r["n_class"]) for r in run("op10_")) == want


def test_pipeline_keeps_columns_and_takes_odd_rows(spark, folder, rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns and [t for _, t in kept.dtypes] == [t for _, t in docs.dtypes] and kept.count() <= before
    out = {r["doc_id"]: r["decoded"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == {r["doc_id"] for r in kept.collect()} and 43 not in out and 40 in out and not {41, 42} & set(out)
    assert out[40] == rows[40][1]


def test_empty_tables(spark, tmp_path):
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in entry.queries().items():
        if name.startswith("op") or name == "pipeline":
            assert query(spark, str(tmp_path)).count() == 0, name
