"""Forms of output, line order, panels, reports and k-mer parts."""

import json

import pytest

from kmerlake import schemas, storage
from kmerlake.operators import consensus, detect, kmer_index, local, walk
from kmerlake.plans import commands, simulate
from kmerlake.sources import readers, writers

from .test_tables import SINK_ROWS, call


def table_of(*sequences):
    k, table = 7, {}
    for s, n in sequences:
        for i in range(len(s) - k + 1):
            table[s[i : i + k]] = table.get(s[i : i + k], 0) + n
    return k, table


def test_merge_keeps_the_first_line(spark, tmp_path):
    head = "\t".join(schemas.CALL_COLUMNS)
    line = lambda name, rvaf: "\t".join(["s", "T", "Substitution", name, str(rvaf), "1", "1", "1", "A", "C", "x", *[""] * (len(schemas.CALL_COLUMNS) - 11)])
    (tmp_path / "a.tsv").write_text("\n".join([head, line("n1", 0.9), line("n1", 0.1), line('"n2', 0.5), line("n3", 0.4)]) + "\n")
    (tmp_path / "b.tsv").write_text("\n".join([head, line("n3", 0.01), line("n4", 0.7), line("n4", 0.2)]) + "\n")
    out = commands.merge(spark, [f"{tmp_path}/a.tsv", f"{tmp_path}/b.tsv"], deduplicate=True)
    assert "_line" not in out.columns
    # the larger shares come first in the files, so an order by value would choose others; a quote is a plain letter
    assert {r["variant_name"]: r["rVAF"] for r in out.collect()} == {"n1": 0.9, '"n2': 0.5, "n3": 0.4, "n4": 0.7}


def test_stats_forms(spark, tmp_path):
    calls = spark.createDataFrame(SINK_ROWS, schemas.CALLS)
    for form in writers.STATS_FORMS:
        commands.stats(calls, output=f"{tmp_path}/s.{form}", form=form)
    rows = dict(x.split("\t") for x in (tmp_path / "s.tsv").read_text().splitlines())
    assert rows["total_targets"] == "4" and rows["detected_variants"] == "3" and rows["detection_rate"] == "0.7500" and rows["type_itd"] == "1" and rows["vaf_mean"] == "0.160000" and rows["expression_mean"] == "10.00"
    text = (tmp_path / "s.text").read_text()
    assert "Detection rate:     75.0%" in text and "  Mean:    0.1600" in text and "Variant Types:" in text
    whole = json.loads((tmp_path / "s.json").read_text())
    assert whole["variant_types"] == {"ITD": 1, "Insertion": 1, "Substitution": 1} and whole["detected_variants"] == 3
    with pytest.raises(ValueError):
        commands.stats(calls, form="xml")


def test_panel_entries_hold_the_number_of_samples(spark, tmp_path):
    panel = spark.createDataFrame([("chr1", 5, "A", "T", "t", 2, 0.5, 0.2, 0.1, 4)], "chrom string, pos long, ref_allele string, alt_allele string, target string, sample_count long, frequency double, max_vaf double, mean_vaf double, total_samples long")
    writers.write_pon(panel, f"{tmp_path}/p.json")
    whole = json.loads((tmp_path / "p.json").read_text())
    assert whole["entries"][0]["entry"] == {"sample_count": 2, "total_samples": 4, "frequency": 0.5, "max_vaf": 0.2, "mean_vaf": 0.1} and whole["total_samples"] == 4
    assert readers.pon(spark, f"{tmp_path}/p.json").count() == 1


def test_report_levels(spark, tmp_path):
    sequence = "ACGTTGCAAGGCTATTCCGA"
    _, table = table_of((sequence, 100), (sequence[:10] + "T" + sequence[11:], 30))
    (tmp_path / "p1.tsv").write_text("kmer\tcount\n" + "".join(f"{x}\t{n}\n" for x, n in table.items()))
    (tmp_path / "t.fa").write_text(f">T1\n{sequence}\n")
    for level in ("standard", "full"):
        commands.detect(spark, f"{tmp_path}/p1.tsv", [f"{tmp_path}/t.fa"], report_dir=f"{tmp_path}/{level}", report_level=level)
        own = tmp_path / level / "targets" / "T1"
        found = json.loads((own / "result.json").read_text())
        assert found["n_ref_kmers"] == 14 and found["n_walked_kmers"] == 21 and found["n_graph_nodes"] == 21 and found["variants"][0]["variant_name"] == "10:G/T:10"
        assert (own / "decision.txt").read_text().startswith("Detected Substitution 10:G/T:10, rVAF=0.2")
        assert (own / "walking").exists() == (level == "full")
    assert json.loads((own / "graph" / "graph_stats.json").read_text())["n_alt_nodes"] == 7
    assert len((own / "kmers" / "ref_kmers.tsv").read_text().splitlines()) == 15 and len((own / "quantification" / "nnls_matrix.tsv").read_text().splitlines()) == 22
    log = (own / "walking" / "walk_log.tsv").read_text().splitlines()
    assert log[0] == "kmer\tdirection\tcount\tthreshold\taccepted" and any(x.endswith("true") for x in log)


def test_consensus_is_ordered_for_output(spark):
    calls = spark.createDataFrame([call(sample=s, target=t) for s, t in (("b", "x"), ("a", "y"), ("b", "a"), ("a", "x"))], schemas.CALLS).withColumn("k", __import__("pyspark").sql.functions.lit(21))
    out = consensus.as_calls(consensus.ordered(consensus.merged(calls, [21]))).collect()
    assert [(r["sample"], r["target"]) for r in out] == [("a", "x"), ("a", "y"), ("b", "a"), ("b", "x")]


def test_limits_of_a_walk():
    """Each limit binds: nodes, breaks on the way, and the stack."""
    k, table = table_of(("ACGTTGCAAGGCTATTCCGA", 50), ("ACGTTGCAAGTCTATTCCGA", 40), ("ACGTTGCAAGTCAATTCCGA", 30))
    count = lambda x: table.get(x, 0)
    reference = ["ACGTTGC"]
    whole = local.walk(reference, count, local.WalkOptions())
    assert len(local.walk(reference, count, local.WalkOptions(max_node=5))) == 5
    assert len(local.walk(reference, count, local.WalkOptions(max_break=0))) < len(whole)
    assert len(local.walk(reference, count, local.WalkOptions(max_stack=0))) < len(whole)


def test_parts_find_every_count(spark):
    k, table = table_of(("ACGTTGCAAGGCTATTCCGATTGACCAGTTAC", 5), ("TTTTTTTTTTTT", 2))
    rows = [("s1", k, x, n) for x, n in table.items()] + [("s2", k, "AAAAAAA", 9)]
    kmers = spark.createDataFrame(rows, schemas.KMERS)
    for size in (4, 1000):
        found = {r["sample"]: r for r in kmer_index.built(kmers.select("sample", "kmer", "count"), k, size).collect()}
        assert (found["s1"]["n_parts"] > 1) == (size == 4)
        parts = kmer_index.Parts(k, found["s1"]["n_parts"], {p["part"]: p["file"] for p in found["s1"]["parts"]}, cached=2)
        look = parts.lookup()
        assert all(look(x) == n for x, n in table.items()) and look("GGGGGGG") == 0 and len(parts.held) <= 2


def test_detection_takes_an_empty_table(spark):
    targets = spark.createDataFrame([("t", "ACGTACGTAC", "")], schemas.TARGETS)
    kmers = spark.createDataFrame([], schemas.KMERS)
    assert detect.detect(targets, kmers, 7).count() == 0 and walk.reach(targets, kmers, 7).count() == 0


def test_mean_count():
    assert local.mean_count(["a", "b"], {"a": 3, "b": 4}.get) == 3.5 and local.mean_count([], {}.get) == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host", "x"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        storage.new_folder(Session(), "x")


def test_reads_are_counted(spark):
    sequence = "ACGTTGCAAGGCTATTCCGATTGACCAGTTAC" * 4 + "GGATCCTTAGCAA"
    haplotypes = spark.createDataFrame([("t", sequence, 0.9), ("t", sequence[:70] + "T" + sequence[71:], 0.1), ("u", "ACGTACGTA", 1.0)], "target string, sequence string, share double")
    table = simulate.read_counts(haplotypes, 9, 400, read_length=60, min_count=1)
    found = {r["kmer"]: r["count"] for r in table.collect()}
    flip = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    known = {min(x, flip(x)) for s in (sequence, sequence[:70] + "T" + sequence[71:], "ACGTACGTA") for x in (s[i : i + 9] for i in range(len(s) - 8))}
    assert set(found) <= known and sum(found.values()) == (-(-400 * 0.9 * 141 // 60) + -(-400 * 0.1 * 141 // 60)) * 52 + 1
    assert found == {r["kmer"]: r["count"] for r in simulate.read_counts(haplotypes.repartition(3), 9, 400, read_length=60, min_count=1).collect()}
    assert simulate.read_counts(haplotypes, 9, 400, read_length=60, min_count=10**6).count() == 0
