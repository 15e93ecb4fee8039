"""Chat formatting, nearest neighbours, the pipeline and the entry's guard."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np

from kmerlake.llm import ann, chat


def test_chat_keeps_maximal_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye <|im_end|>"),
        (3, 5, "user", "hi"), (3, 9, "assistant", "hello"), (3, 700, "user", "bye <|im_end|>"),
        (4, 0, None, None), (5, 0, "user", "ho"), (5, 0, "user", "ho"), (6, 0, "user", "ho"),
        (None, 0, "user", "lost"), (None, None, "system", "first"),
    ]
    out = {r.conv_id: r for r in chat.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {2, 4, 5, None}
    assert out[2].n_copies == 2 and out[2].n_turns == 3
    assert out[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye <\\|im_end|><|im_end|>\n"
    assert out[4].text == "<|im_start|>unknown\n<|im_end|>\n" and out[5].n_turns == 2
    assert out[None].text.startswith("<|im_start|>system\nfirst")
    assert chat.rendered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 24))
    vectors[7] = vectors[50]
    vectors[8] = 2 * vectors[50]
    rows = [(i, [float(x) for x in np.float32(v)], i % 3) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1050, [0.0] * 24, 0), (1100, [float("nan")] * 24, 0), (1150, [None] + [1.0] * 23, 0), (1200, [1.0, 2.0], 0), (1201, [], 0)]
    rows += [rows[3], (None, [1.0] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.search(df.filter("vec_id % 50 = 0"), df, query_block=3, candidate_block=20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    v = np.float32(vectors).astype(np.float64)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert set(got) == {0, 50, 100, 150, 200, 250}
    for q, near in got.items():
        cos = unit @ unit[q]
        want = sorted((-round(cos[i], 12), i) for i in range(300) if i != q)[:5]
        assert [near[k][0] for k in range(1, 6)] == [i for _, i in want]
        assert np.allclose([near[k][1] for k in range(1, 6)], [-s for s, _ in want])
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df.limit(2), df.limit(0)).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_classes, brute_contamination

    rng = random.Random(6)
    item = " ".join(f"q{i}" for i in range(15))
    texts = []
    for lang, parts in (("en", "the of and ing"), ("fr", "le de et eau")):
        for _ in range(40):
            texts.append((lang, " ".join(rng.choice(parts.split()) + str(rng.randint(0, 40)) for _ in range(40))))
    texts += [("en", "the of " + item + " and"), ("en", None), ("en", "12 3"), texts[0], texts[50]]
    rows = [(i, t, lang, "s", len(t or "")) for i, (lang, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    stay = [i for i, (_, t) in enumerate(texts) if t and any(map(str.isalpha, t))]
    classes = brute_classes([texts[i][1] for i in stay])
    first = [stay[c] for c in sorted(set(classes))]
    want = {i for i in first if not brute_contamination(texts[i][1], [(1, item)])[-1]}
    assert set(out) == want and all(out[i].decoded == texts[i][1] for i in want)


def test_rest_works_without_this_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "kmerlake", tmp_path / "kmerlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin"})
