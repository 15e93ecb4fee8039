"""Operators over tables, sources, sinks and commands."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kmerlake import schemas
from kmerlake.functions import kmers as K
from kmerlake.functions import sequence as S
from kmerlake.operators import detect, filters, kmer_tables, local, merge, metrics, variants, walk
from kmerlake.plans import charts, commands, dot, reports, settings, simulate
from kmerlake.sources import readers, writers


def call(**own):
    base = dict.fromkeys(schemas.CALL_COLUMNS) | dict(sample="s1", target="T", type="Substitution", variant_name="3:A/T:3", rVAF=0.1, expression=10.0, min_coverage=20, start_kmer_count=5, ref_sequence="ACGTACGT", alt_sequence="ACGTTCGT", info="vs_ref")
    return tuple((base | own)[c] for c in schemas.CALL_COLUMNS)


SINK_ROWS = [
    call(target="TP53", rVAF=0.15, chrom="chr17", pos=7577120, ref_allele="C", alt_allele="T", pvalue=1.2345e-4, qual=39.1, ci_lower=0.1, ci_upper=0.2),
    call(target="NPM1", type="Insertion", rVAF=0.25, chrom="chr5", pos=170837543, ref_allele="T", alt_allele="TCTG"),
    call(target="FLT3", type="ITD", rVAF=0.08, chrom="chr13", pos=28608250, ref_allele="GATA", alt_allele="G"),
    call(target="KRAS", type="Reference", variant_name="", rVAF=1.0, chrom="chr12", pos=25398284, ref_allele="G", alt_allele="G", info='a,"b"'),
]


@pytest.fixture(scope="module")
def sink_calls(spark):
    return spark.createDataFrame(SINK_ROWS, schemas.CALLS).coalesce(1)


def test_kmer_functions(spark):
    row = spark.sql("select 'ACGTN' n, 'GATTACA' s, '' e").select(
        K.encode("s").alias("packed"), K.decode(K.encode("s"), 7).alias("back"), K.encode("n").alias("bad"), K.encode("e").alias("none"),
        K.reverse_complement("s").alias("rc"), K.canonical("s").alias("can"), K.extend_right("s", F.lit("G")).alias("right"), K.extend_left("s", F.lit("G")).alias("left"),
        K.decompose("s", 5).alias("k5"), K.decompose("s", 8).alias("k8"), K.path_sequence(K.decompose("s", 3)).alias("path"), K.encode_base(F.lit("t")).alias("b"), K.encode_base(F.lit("N")).alias("nb"), K.decode_base(F.lit(2)).alias("g"),
        S.max_homopolymer(F.lit("AATTTTC")).alias("run"), S.gc_content(F.lit("GGCA")).alias("gc"), S.low_complexity(F.lit("AAAAAAAAAA")).alias("low"), S.shared_prefix(F.lit("ACG"), F.lit("ACT")).alias("pre"), S.shared_suffix(F.lit("AC"), F.lit("GAC")).alias("suf"), S.scientific(F.lit(1.2345e-4)).alias("e1"), S.scientific(F.lit(1.0)).alias("e2"), S.safe_file_name(F.lit("a b/c-1")).alias("safe"),
    ).first()
    assert row.packed == int("2033010", 4) and row.back == "GATTACA" and row.bad is None and row.none is None
    assert (row.rc, row.can, row.right, row.left) == ("TGTAATC", "GATTACA", "ATTACAG", "GGATTAC")
    assert row.k5 == ["GATTA", "ATTAC", "TTACA"] and row.k8 == [] and row.path == "GATTACA" and (row.b, row.nb, row.g) == (3, None, "G")
    assert (row.run, row.gc, row.low, row.pre, row.suf, row.e1, row.e2, row.safe) == (4, 0.75, True, 2, 2, "1.234500e-4", "1.000000e0", "a_b_c-1")


def test_walks_in_tasks_equal_walks_by_joins(spark, monkeypatch):
    rng = random.Random(11)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets = spark.createDataFrame([(f"t{i}", dna(9), "") for i in range(5)] + [("short", "AC", ""), ("odd", "ACNéGT", "")], "target string, sequence string, path string")
    rows = {(s, dna(4)): rng.randint(1, 30) for s in ("a", "b", "c") for _ in range(130)} | {("one", "AAAA"): 1, ("odd", "ACNGT"): 9, ("odd", "CGTA"): 7}
    kmers = spark.createDataFrame([(*x, n) for x, n in rows.items()], "sample string, kmer string, count long")
    whole = walk.reach_by_joins
    for direction in ("forward", "backward"):
        want = sorted(map(tuple, whole(targets, kmers, 4, direction).collect()))
        by_joins = []
        monkeypatch.setattr(walk, "reach_by_joins", lambda t, k, *a, **b: by_joins.extend(r[0] for r in k.select("sample").distinct().collect()) or whole(t, k, *a, **b))
        got = walk.reach(targets, kmers, 4, direction)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 500 and by_joins == ["odd"]
    monkeypatch.setattr(walk, "HELD", 70)
    assert sorted(map(tuple, walk.reach(targets, kmers, 4, "backward").collect())) == want and {"a", "b", "c"} & set(by_joins)


def test_walk_equals_a_depth_first_walk(spark):
    rng = random.Random(7)
    k, rows, targets, want = 4, [], [], {}
    for t in range(6):
        sequence = "".join(rng.choice("ACGT") for _ in range(12))
        targets.append((f"t{t}", sequence, ""))
    for sample in ("a", "b"):
        table = {}
        for _ in range(150):
            table["".join(rng.choice("ACGT") for _ in range(k))] = rng.randint(1, 30)
        for _, s, _ in targets:
            for i in range(len(s) - k + 1):
                table.setdefault(s[i : i + k], rng.randint(5, 50))
        rows += [(sample, k, x, n) for x, n in table.items()]
        options = local.WalkOptions(max_stack=10**6, max_break=10**6, max_node=10**6)
        for name, s, _ in targets:
            reference = [s[i : i + k] for i in range(len(s) - k + 1)]
            want[sample, name] = local.walk_both(reference, lambda x: table.get(x, 0), options)
    kmers, frame = spark.createDataFrame(rows, schemas.KMERS), spark.createDataFrame(targets, schemas.TARGETS)
    got = {}
    for r in walk.reach_both(frame, kmers, k).collect():
        got.setdefault((r["sample"], r["target"]), {})[r["kmer"]] = r["count"]
    assert got == want
    options = detect.DetectOptions(walk=local.WalkOptions(max_node=60, bidirectional=True))
    shown = ["sample", "target", "alt_sequence", "type", "rVAF", "min_coverage", "pvalue"]
    near = lambda df: sorted((tuple(r) for r in df.select(*shown).collect()), key=str)
    whole, parts = detect.detect(frame, kmers, k, options), detect.detect(frame, kmers, k, options, part_rows=10)
    assert near(whole) == near(parts)


def test_simulated_panel_is_detected(spark, tmp_path):
    panel = simulate.simulate(spark, "large_indels", seed=3)
    found = detect.detect(panel.targets, panel.kmers, panel.k, detect.DetectOptions(prune=local.PruneOptions(bubble_ratio=0.0), walk=local.WalkOptions(ratio=0.001)))
    seen = {r["target"] for r in found.filter("type <> 'Reference' and min_coverage > 0").select("target").distinct().collect()}
    real = [r["target"] for r in panel.targets.select("target").collect() if not r["target"].endswith("absent")]
    assert len(seen & set(real)) / len(real) > 0.55
    three = detect.detect_multi_k(panel.targets.limit(2), panel.kmers, [21])
    assert {"k_values", "tier", "consensus_rvaf"} <= set(three.columns) and three.count() >= 2
    with pytest.raises(ValueError):
        detect.detect_multi_k(panel.targets, panel.kmers, [20])


def test_sinks_read_back(spark, sink_calls, tmp_path):
    path = f"{tmp_path}/c.tsv"
    writers.write_calls(sink_calls, "tsv", path)
    text = open(path).read().splitlines()
    assert text[0] == "\t".join(schemas.CALL_COLUMNS) and "1.234500e-4\t39.10\t0.100000\t0.200000" in text[1]
    back = readers.calls(spark, path)
    assert [tuple(r[c] for c in schemas.CALL_COLUMNS) for r in back.collect()] == SINK_ROWS
    writers.write_calls(sink_calls, "csv", f"{tmp_path}/c.csv", header=False)
    assert '"a,""b"""' in open(f"{tmp_path}/c.csv").read().splitlines()[3]
    writers.write_calls(sink_calls, "vcf", f"{tmp_path}/c.vcf")
    vcf = open(f"{tmp_path}/c.vcf").read().splitlines()
    assert vcf[0] == "##fileformat=VCFv4.3" and vcf[10] == "chr17\t7577120\t.\tC\tT\t39.1\tPASS\tKVAF=0.150000;KCOV=20;KEXP=10.00;KTYPE=Substitution;KPV=1.234500e-4;KCI_LO=0.100000;KCI_HI=0.200000"
    for form, many in (("json", True), ("jsonl", False)):
        writers.write_calls(sink_calls, form, f"{tmp_path}/c.{form}")
        again = readers.json_calls(spark, f"{tmp_path}/c.{form}", many).select(*schemas.CALL_COLUMNS)
        assert sorted(map(tuple, again.collect()), key=str) == sorted(SINK_ROWS, key=str)
    assert json.load(open(f"{tmp_path}/c.json"))[2]["variant_type"] == "Itd"
    writers.write_calls(sink_calls, "xlsx", f"{tmp_path}/c.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/c.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 5 and "<v>0.15</v>" in sheet
    with pytest.raises(ValueError):
        writers.write_calls(sink_calls, "xlsx")
    bad = f"{tmp_path}/bad.tsv"
    open(bad, "w").write("\t".join(schemas.CALL_COLUMNS) + "\nS\tT\tWrong\n")
    with pytest.raises(Exception, match="unknown variant type"):
        readers.calls(spark, bad).collect()


def test_fasta_and_kmers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.fa").write_text(">one x\nacgt\nAC\n>two\nGG\n")
    (tmp_path / "sub" / "b.fasta").write_text(">three\nTTTT")
    (tmp_path / "c.txt").write_text(">no\nA")
    rows = {r["target"]: r["sequence"] for r in readers.fasta(spark, str(tmp_path)).collect()}
    assert rows == {"one x": "ACGTAC", "two": "GG", "three": "TTTT"}
    (tmp_path / "s1.tsv").write_text("kmer\tcount\nACG\t5\nCGT 7\nxx\n")
    table = readers.kmer_table(spark, f"{tmp_path}/s1.tsv")
    assert sorted(map(tuple, table.collect())) == [("s1", 3, "ACG", 5), ("s1", 3, "CGT", 7)]
    cover = kmer_tables.coverage_stats(readers.fasta(spark, str(tmp_path)), table, 3).filter("target = 'one x'").first()
    assert (cover.num_kmers, cover.mean_coverage, cover.median_coverage, cover.min_coverage, cover.max_coverage) == (4, 3.0, 2.5, 0, 7)
    commands.coverage(spark, f"{tmp_path}/s1.tsv", [str(tmp_path)], output=f"{tmp_path}/cov.tsv")
    assert open(f"{tmp_path}/cov.tsv").read().splitlines()[1].startswith("one x\t4\t3.00\t2.5\t0\t7\t")
    assert {r["kmer"] for r in kmer_tables.strand_specific(table.filter("kmer = 'ACG'")).collect()} == {"ACG", "CGT"}
    with pytest.raises(ValueError):
        readers.fasta(spark)


def test_filter_against_expected(spark):
    calls = spark.createDataFrame([call(chrom="chr1", pos=100, ref_allele="A", alt_allele="T"), call(type="Deletion", chrom="chr2", pos=9, ref_allele="AGT", alt_allele="AT", min_coverage=1, rVAF=0.001)], schemas.CALLS)
    expected = spark.createDataFrame([("1", 100, "A", "T", "substitution"), ("chr2", 9, "AG", "A", "deletion"), ("3", 1, "A", "T", "substitution")], schemas.EXPECTED)
    rows = {r["chrom"]: r for r in filters.filtered(expected, calls, filters.FilterOptions(min_vaf=0.01)).collect()}
    assert rows["1"]["found"] == "Found" and rows["1"]["filter_notes"] == "PASS"
    assert rows["chr2"]["filter_notes"] == "coverage 1 < 3; VAF 0.001000 < 0.01" and rows["3"]["filter_notes"] == filters.NO_MATCH and rows["3"]["sample"] == ""
    alt = filters.filtered(expected, calls, filters.FilterOptions(use_alt=True)).collect()
    assert len(alt) == 3 and all(r["found"] == "Found" or r["kmer_min_coverage"] == 1 for r in alt)
    more = filters.filtered(expected.limit(1), calls.withColumn("qual", F.lit(5.0)), filters.FilterOptions(min_qual=10.0, context=True)).first()
    assert more["found"] == "Not Found" and more["filter_notes"] == "QUAL 5.0 < 10.0"
    report = reports.filter_report(filters.filtered(expected, calls, filters.FilterOptions(min_vaf=0.01)), filters.FilterOptions(min_vaf=0.01))
    assert report["summary"]["found"] == 1 and {r["criterion"]: r["rejected_any"] for r in report["criteria"]} == {"coverage": 1, "VAF": 1, "expression": 0, "type": 0}
    assert "1 of 3 expected" in reports.filter_text(report)


def test_filter_joins_one_call_for_each_key(spark, monkeypatch):
    rows = [call(sample=f"s{i:04d}", chrom="chr1", pos=5, ref_allele="A", alt_allele="T", min_coverage=i + 10) for i in range(300)]
    rows += [call(sample=f"s{i:04d}", type="Insertion", chrom="chr1", pos=9, ref_allele="CA", alt_allele="CAG", qual=float(q)) for i in range(300) for q in (70, 60)]
    expected = [("1", 5, "A", "T", "Substitution")] * 200 + [("chr1", 9, "CA", "CAG", "insertion"), ("1", 10, "A", "AG", "Insertion"), ("1", 10, "A", "AG", "Deletion"), (None, 10, "A", "AG", "Insertion")]
    out = filters.filtered(spark.createDataFrame(expected, schemas.EXPECTED), spark.createDataFrame(rows[::-1], schemas.CALLS), filters.FilterOptions(min_qual=65.0))
    got = [(r["pos"], r["variant_type"], r["chrom"], r["sample"], r["kmer_min_coverage"], r["filter_notes"]) for r in out.collect()]
    assert got.count((5, "Substitution", "1", "s0000", 10, "PASS")) == 200 and len(got) == 204
    # among equals the other columns decide, so the lower quality comes first
    assert {x for x in got if x[0] > 5} == {(9, "insertion", "chr1", "s0000", 20, "QUAL 60.0 < 65.0"), (10, "Insertion", "1", "s0000", 20, "QUAL 60.0 < 65.0"), (10, "Deletion", "1", "", None, filters.NO_MATCH), (10, "Insertion", None, "", None, filters.NO_MATCH)}
    # no join carries a row for each pair of an expected variant and a call
    joined = []
    whole = type(out).join
    monkeypatch.setattr(type(out), "join", lambda self, *a, **b: joined.append(whole(self, *a, **b)) or joined[-1])
    filters.filtered(spark.createDataFrame(expected, schemas.EXPECTED), spark.createDataFrame(rows, schemas.CALLS)).count()
    assert joined and max(x.count() for x in joined) <= len(expected)


def test_panel_of_normals(spark, tmp_path):
    rows = [call(sample=f"n{i}", chrom="chr1", pos=100, ref_allele="A", alt_allele="T", rVAF=0.1 * (i + 1)) for i in range(2)] + [call(sample="n3", type="Deletion", pos=4, ref_allele="AGT", alt_allele="AT", ref_sequence="AAAAGTTTT")]
    normals = spark.createDataFrame(rows, schemas.CALLS)
    panel = filters.pon_build(normals, files=4)
    found = {r["alt_allele"]: r for r in panel.collect()}
    assert found["T"]["sample_count"] == 2 and found["T"]["frequency"] == 0.5 and found["T"]["mean_vaf"] == pytest.approx(0.15)
    assert any(r["ref_allele"] == "AG" for r in panel.collect())
    writers.write_pon(panel, f"{tmp_path}/pon.json")
    again = readers.pon(spark, f"{tmp_path}/pon.json")
    assert sorted(map(str, again.select(*panel.columns).collect())) == sorted(map(str, panel.collect()))
    passed, dropped = filters.pon_split(normals, again, 0.3)
    assert dropped.count() == 2 and passed.count() == 1


def test_benchmark(spark, tmp_path):
    truth = [("1", 1, "A", "T", "Substitution", 0.05, None), ("1", 2, "A", "T", "Substitution", 0.05, None), ("1", 3, "A", "T", "Insertion", 0.5, None), ("1", 4, "A", "T", "Substitution", 0.0, None)]
    own = [call(chrom="chr1", pos=p, ref_allele="A", alt_allele="T", rVAF=v) for p, v in ((1, 0.03), (1, 0.07), (2, 0.05), (9, 0.1))]
    t, c = spark.createDataFrame(truth, schemas.TRUTH), spark.createDataFrame(own, schemas.CALLS)
    r = metrics.confusion(t, c).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 2, 1, 1) and r.sensitivity == pytest.approx(2 / 3)
    report = reports.benchmark_report(t, c, [0, 0.1, 1.0], [0.0, 0.06, 0.9])
    assert [x["sensitivity"] for x in report["sweep"]] == pytest.approx([2 / 3, 1 / 3, 0.0]) and report["by_vaf"][1]["total"] == 1
    assert "sensitivity" in reports.benchmark_text(report)
    empty = metrics.confusion(t.limit(0), c.limit(0)).first()
    assert empty.tp == 0 and empty.sensitivity is None
    with pytest.raises(ValueError):
        metrics.by_vaf_bin(t, c, [0.1])


def test_merge_cluster_and_dedup(spark):
    calls = spark.createDataFrame([call(variant_name=f"{a}:A/T:{b}") for a, b in ((10, 15), (12, 25), (24, 36), (50, 51))], schemas.CALLS)
    assert {(r.start, r.end, r.n) for r in variants.clusters(calls).collect()} == {(10, 36, 3), (50, 51, 1)}
    info = sorted(r.info for r in variants.with_clusters(calls).collect())
    assert info == ["vs_ref"] + ["vs_ref;cluster=1"] * 3
    twice = [call(type="Insertion", variant_name=f"{p}:T/TT:{p}", ref_allele="T", alt_allele="TT", ref_sequence="AAATTTTCCC", expression=e) for p, e in ((6, 1.0), (4, 9.0))]
    kept = variants.deduplicated(spark.createDataFrame(twice + [call()], schemas.CALLS), ["variant_name"]).collect()
    assert len(kept) == 2 and {r.expression for r in kept} == {9.0, 10.0}
    assert merge.merged([calls, calls], True).count() == 4
    with pytest.raises(ValueError):
        merge.merged([calls, calls.drop("info")])


def test_stats_charts_and_reports(spark, sink_calls, tmp_path):
    r = metrics.summary(sink_calls).first()
    assert (r.total_targets, r.detected, r.detection_rate) == (4, 3, 0.75) and r.vaf_min == 0.08
    assert metrics.summary(sink_calls.limit(0)).first().vaf_mean == 0
    for kind in charts.CHARTS:
        assert commands.plot(sink_calls, kind, f"{tmp_path}/x.svg") and open(f"{tmp_path}/x.svg").read().startswith("<svg")
    with pytest.raises(ValueError):
        charts.chart(sink_calls.limit(0), "summary-pie")
    commands.stats(sink_calls, output=f"{tmp_path}/s.tsv")
    assert open(f"{tmp_path}/s.tsv").read().splitlines()[1] == "total_targets\t4"
    assert commands.stats(sink_calls, "type").count() == 4
    reports.write_run_report(sink_calls, f"{tmp_path}/r", ["variant_name"], "standard")
    assert (tmp_path / "r" / "targets" / "TP53" / "decision.txt").exists()


def test_graph_texts():
    count = lambda x: {"ACG": 500, "CGT": 500, "GTA": 500, "TAG": 500, "GTT": 100, "TTA": 100}.get(x, 0)
    reference = ["ACG", "CGT", "GTA", "TAG"]
    graph = local.build_graph(local.walk(reference, count, local.WalkOptions()), reference)
    text = dot.graph_dot(graph, 'a"b', [p for p, _ in local.paths(graph, count)], legend=True)
    assert text.startswith('digraph "a\\"b"') and '"CGT" -> "GTT"' in text and "Legend" in text
    assert '"GTT" [label="GTT .. TTA (2 k-mers, 100-100)"' in dot.simplified_dot(graph, "t")
    assert "rejected: 2" in dot.filter_flow_dot({"total": 5, "coverage": 2, "found": 3})
    found = reports.trace_target("s", "t", "ACGTAG", 3, count, detect.DetectOptions(prune=None))
    assert found["outcome"] == "variant_detected" and found["walking"]["variant_nodes"] == 2


def test_settings():
    s = settings.settled({"detect": {"count": 7}}, {"ratio": 0.5}, "strict")
    assert (s["count"], s["ratio"], s["min_qual"]) == (7, 0.5, 20.0)
    o = settings.detect_options(s | {"prune": False, "bootstrap": True, "bootstrap_replicates": 10})
    assert o.prune is None and o.bootstrap.replicates == 10 and o.walk.count == 7
    assert settings.filter_options({"filter": {"min_coverage": 9, "types": ["ITD"]}}, min_vaf=0.5) == filters.FilterOptions(min_coverage=9, types=("ITD",), min_vaf=0.5)
    assert readers.config("[detect]\ncount = 3\n") == {"detect": {"count": 3}}
    with pytest.raises(ValueError):
        settings.preset("none")


def test_commands_end_to_end(spark, tmp_path):
    sequence = "ACGTTGCAAGGCTATTCCGA"
    other = sequence[:10] + "T" + sequence[11:]
    k, table = 7, {}
    for s, n in ((sequence, 100), (other, 30)):
        for i in range(len(s) - k + 1):
            table[s[i : i + k]] = table.get(s[i : i + k], 0) + n
    (tmp_path / "p1.tsv").write_text("kmer\tcount\n" + "".join(f"{x}\t{n}\n" for x, n in table.items()))
    (tmp_path / "t.fa").write_text(f">T1\n{sequence}\n")
    calls = commands.detect(spark, f"{tmp_path}/p1.tsv", [f"{tmp_path}/t.fa"], output=f"{tmp_path}/o.tsv", bidirectional=True, bootstrap=True, bootstrap_replicates=20, debug_graph=f"{tmp_path}/g", trace=f"{tmp_path}/tr", report_dir=f"{tmp_path}/rep")
    rows = {r["type"]: r for r in calls.collect()}
    assert rows["Substitution"]["variant_name"] == "10:G/T:10" and rows["Substitution"]["rVAF"] == pytest.approx(30 / 130, abs=0.02)
    assert rows["Substitution"]["ci_lower"] <= rows["Substitution"]["rVAF"] <= rows["Substitution"]["ci_upper"]
    assert (tmp_path / "g" / "T1.dot").exists() and (tmp_path / "tr" / "summary.json").exists() and (tmp_path / "rep" / "run_summary.json").exists()
    (tmp_path / "e.tsv").write_text("CHROM\tPOS\tREF\tALT\tTYPE\nchr1\t1\tG\tT\tSubstitution\n")
    assert commands.run(spark, f"{tmp_path}/p1.tsv", [f"{tmp_path}/t.fa"], f"{tmp_path}/e.tsv", use_alt=True).first()["found"] == "Found"
    assert commands.merge(spark, [f"{tmp_path}/o.tsv"] * 2, deduplicate=True).count() == 2
    commands.pon_build(spark, [f"{tmp_path}/o.tsv"], f"{tmp_path}/pon.json")
    assert commands.pon_filter(spark, f"{tmp_path}/o.tsv", f"{tmp_path}/pon.json").count() == 1
    (tmp_path / "truth.tsv").write_text("chrom\tpos\tref\talt\ttype\ttrue_vaf\nchr1\t1\tG\tT\tSubstitution\t0.2\n")
    assert commands.benchmark(spark, f"{tmp_path}/o.tsv", f"{tmp_path}/truth.tsv", sweep_vaf="0,0.5", output=f"{tmp_path}/b.txt")["overall"]["fn"] == 1


def test_foreign_table(spark):
    names = "Database Query Type Variant_name rVAF Expression Min_coverage Start_offset Sequence Reference_expression Reference_sequence Info".split()
    raw = spark.createDataFrame([("d", "q", "Insertion", "5:insAC:6|x", "NaN", "2.5", "7", "0", "S", "1", "R", ""), ("d", "q", "", "5:A/T:5", "0.5", "x", "1", "0", "S", "1", "R", "")], ", ".join(f"{n} string" for n in names))
    a, b = readers.foreign_calls(raw).collect()
    assert (a.type, a.variant_name, a.rVAF, a.ref_allele, a.alt_allele, a.min_coverage) == ("Insertion", "5:insAC:6", 0.0, "", "AC", 7)
    assert (b.ref_allele, b.alt_allele, b.expression) == ("A", "T", 0.0)
