"""Upstream tables, pileups, modules, readers over several splits, exports."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lociform.operators import clustering, expression, inputs, modules, pileup, plotdata, stats
from lociform.sources import readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_cigars(spark):
    rows = [("m", "c", 10, "3M", "ACG", "III"), ("clip", "c", 10, "2H2S2M1S", "TTACT", "IIIII"), ("ins", "c", 10, "1M2I1M", "ATTC", "IIII"), ("del", "c", 10, "1M2D1=3N1X", "ACG", "IAI"), ("none", "c", 10, "*", "A", "I"), ("null", "c", 10, None, "A", "I")]
    df = spark.createDataFrame(rows, "qname string, chr string, pos bigint, cigar string, seq string, qual string")
    got = sorted((r.qname, r.position, r.base, r.quality) for r in pileup.aligned_bases(df).collect())
    assert got == sorted([("m", 11, "A", 40), ("m", 12, "C", 40), ("m", 13, "G", 40), ("clip", 11, "A", 40), ("clip", 12, "C", 40), ("ins", 11, "A", 40), ("ins", 12, "C", 40), ("del", 11, "A", 40), ("del", 14, "C", 32), ("del", 18, "G", 40)])


def test_targeted_pileup_keeps_uncovered_sites(spark):
    al = [("a", 99, "c", 10, 60, "4M", "ACGT", "IIII", False), ("low base", 99, "c", 10, 60, "4M", "CCCC", "I!!!", False), ("low read", 99, "c", 10, 5, "4M", "GGGG", "IIII", False), ("dup", 1123, "c", 10, 60, "4M", "GGGG", "IIII", False), ("sa", 99, "c", 10, 60, "4M", "GGGG", "IIII", True), ("n", 147, "c", 12, 60, "2M", "NA", "II", False)]
    df = spark.createDataFrame(al, "qname string, flag int, chr string, pos bigint, mapq int, cigar string, seq string, qual string, has_sa boolean")
    sites = spark.createDataFrame([("c", 11, "A"), ("c", 13, "G"), ("c", 14, "T"), ("c", 99, "N"), ("d", 11, "A")], "chr string, position bigint, reference string")
    got = {(r.chr, r.position): (r.coverage, r.count_A, r.count_C, r.count_G, r.count_T) for r in pileup.targeted_pileup(df, sites, 30, 20, 2).collect()}
    assert got == {("c", 11): (2, 1, 1, 0, 0), ("c", 13): (1, 0, 0, 1, 0), ("c", 14): (2, 1, 0, 0, 1), ("c", 99): (0, 0, 0, 0, 0), ("d", 11): (0, 0, 0, 0, 0)}


def test_merges_refuse_what_does_not_fit(spark):
    v = "feature_id string, sample_id string, value bigint"
    g, t = spark.createDataFrame([("g", "s1", 1), ("g", "s2", 2)], v), spark.createDataFrame([("t", "s2", 5), ("t", "s3", 6)], v)
    assert sorted(map(tuple, inputs.merge_counts(g, t).collect())) == [("g", "s2", 2), ("t", "s2", 5)]
    with pytest.raises(ValueError, match="both sides"):
        inputs.merge_counts(g, g)
    with pytest.raises(ValueError, match="no sample"):
        inputs.merge_counts(g, t.where("sample_id = 's3'"))
    reads = spark.createDataFrame([("c1",), ("spikein_c1",)], "chr string")
    assert [x.count() for x in inputs.split_spike_in(reads)] == [1, 1]
    with pytest.raises(ValueError, match="spike-in"):
        inputs.split_spike_in(reads.where("chr = 'c1'"))
    a = spark.createDataFrame([("x", 1), ("y", 2)], "gene string, cell bigint")
    with pytest.raises(ValueError, match="other genes"):
        inputs.merge_cells({"a": a, "b": a.where("gene = 'x'")})
    assert inputs.validate_frames({"a": a, "b": a.where("false")}, {"a": ["gene", "umap"], "b": [], "c": ["x"]}) == ["a lacks umap", "b is empty", "no table c"]


def test_matrix_folder(spark, tmp_path):
    put(tmp_path / "genes.tsv", "g1\tn\ng2\tn\ng3\tn\n")
    put(tmp_path / "barcodes.tsv", "".join(f"b{k}\n" for k in range(1, 4)))
    put(tmp_path / "matrix.mtx", "%%MatrixMarket\n3 3 3\n1 1 7\n2 3 1\n3 3 3\n")
    assert sorted(map(tuple, readers.triplets(spark, str(tmp_path)).collect())) == [("g1", "b1", 7), ("g2", "b3", 1), ("g3", "b3", 3)]


def test_fasta_and_line_numbers_over_splits(spark, tmp_path):
    rng = random.Random(3)
    lines, want, numbers = [], [], []
    for c in range(6):
        lines.append(f">chr{c} some text")
        at = 0
        for _ in range(rng.choice([0, 1, 40])):
            seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30)))
            lines.append(seq)
            want.append((f"chr{c}", at, seq))
            at += len(seq)
    put(tmp_path / "a" / "x.fa", "\n".join(lines) + "\n")
    put(tmp_path / "a" / "y.fa", ">other\nAC\nGT\n")
    want += [("other", 0, "AC"), ("other", 2, "GT")]
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("100", "1m"):
            spark.conf.set(key, size)
            got = [(r.chr, r.start, r.seq) for r in readers.fasta(spark, str(tmp_path / "a")).collect()]
            assert sorted(got) == sorted(want)
            n = {r.line: r.value for r in readers.numbered_lines(spark, str(tmp_path / "a" / "x.fa")).collect()}
            assert [n[k + 1] for k in range(len(n))] == lines
    finally:
        spark.conf.set(key, before)


def test_sheet_driven_loads(spark, tmp_path):
    a = put(tmp_path / "a.txt", "gene\tn\ng1\t3\ng2\t4\n")
    b = put(tmp_path / "b.txt", "g1\t5\ng3\t6\n")
    p = put(tmp_path / "p.bed", "c1\t5\t9\tn\t1\t+\n")
    sheet = spark.createDataFrame([("s1", "RNAseq", "counts", a), ("s2", "RNAseq", "counts", b), ("s3", "RNAseq", "counts", "NA"), ("s4", "ATACseq", "bed", p), ("s5", "ATACseq", "bed", None)], "sample_id string, omics string, format string, file_loc string")
    assert sorted(map(tuple, readers.from_sheet(sheet, "RNAseq").select("feature_id", "sample_id", "value").collect())) == [("g1", "s1", 3.0), ("g1", "s2", 5.0)]
    assert [(r.chr, r.sample_id) for r in readers.from_sheet(sheet, "ATACseq").collect()] == [("c1", "s4")]
    with pytest.raises(ValueError, match="no file"):
        readers.from_sheet(sheet, "Olink")


def test_exports_come_back(spark, tmp_path):
    de = spark.createDataFrame([("a", "x", 2.0, 0.01), ("b", "x", -2.0, 0.01), ("c", "x", 3.0, 0.05), ("d", "x", 0.5, 0.0), (" ", "x", 4.0, 0.0), ("e", "y", None, None)], "feature_id string, comparison string, log2FoldChange double, padj double")
    folder = str(tmp_path / "de")
    writers.result_set(de, folder, ["comparison"])
    back = {n: {r.feature_id for r in readers.result_set(spark, folder, n).collect()} for n in ("all", "significant", "up", "down")}
    assert len(back["all"]) == 6 and {"a", "b"} <= back["significant"] and "c" not in back["significant"] and "a" in back["up"] and back["down"] == {"b"}
    for what in ("significant", "all"):
        assert {(r.experiment, r.gene) for r in readers.gene_lists(spark, {"one": folder}, what).collect()} == {("one", "a"), ("one", "b")}
    assert {r.comparison: int(r.n_significant) for r in readers.result_set(spark, folder, "summary").collect()} == {"x": 3, "y": 0}
    writers.tables({"de": de, "n": de.groupBy("comparison").count()}, str(tmp_path / "all"), {"de": ["comparison"]})
    t = readers.tables(spark, str(tmp_path / "all"), ["de", "n"])
    assert t["de"].count() == 6 and t["n"].count() == 2
    with pytest.raises(FileNotFoundError, match="missing"):
        readers.tables(spark, str(tmp_path / "all"), ["missing"])


def test_modules(spark):
    m = spark.createDataFrame([("m1", "g1.1"), ("m1", "g1.2"), ("grey", "g2"), ("m2", "g3")], "module string, gene string")
    assert {r.module: (r.genes, r.n) for r in modules.cluster_genes(m, strip=True).collect()} == {"m1": (["g1"], 1), "m2": (["g3"], 1)}
    assert modules.ranges_around([0.5, 0.0, 2.0], 0.2) == [(0.4, 0.6), (0.0, 0.1), (0.0, 1.0)]
    assert modules.fine_grid([(0.0, 1.0)], 3) == [(0.0,), (0.5,), (1.0,)]
    with pytest.raises(ValueError):
        modules.fine_grid([(1.0, 1.0)], 3)
    s = modules.simulate_views(spark, 40, (30,), 10, (5,))
    a, b = (s.where(F.col("signal") == x).agg(F.avg("value"), F.stddev_samp("value")).first() for x in (True, False))
    assert abs(a[0] - 2) < 0.6 and abs(b[0]) < 0.15 and abs(b[1] - 1) < 0.15
    assert s.repartition(7).agg(F.sum("value")).first()[0] == pytest.approx(s.agg(F.sum("value")).first()[0])


def test_outlying_sample(spark):
    rng = random.Random(4)
    rows = [(f"f{i}", f"s{j:02d}", rng.gauss(0, 1) + (6 if j == 3 else 0)) for i in range(60) for j in range(20)] + [("flat", f"s{j:02d}", 1.0) for j in range(20)]
    df = spark.createDataFrame(rows, "feature_id string, sample_id string, value double")
    for how, t in (("sd", 3.0), ("mad", 6.0)):
        assert {r.sample_id for r in modules.sample_outliers(df, 5, t, how).where("outlier").collect()} == {"s03"}


def test_ranked_lists(spark):
    rng = random.Random(5)
    rows = [(f"k{i % 3}", f"g{i}", float(rng.choice([-2, 0, 1, 1, 3]) + (rng.random() if i % 2 else 0))) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, gene string, stat double")
    for by in (["k"], []):
        got = {(r.k, r.gene): (r["rank"], r.n) for r in stats.ordered_rank(df, by, "stat", "gene").collect()}
        for k in {r[0] for r in rows} if by else {None}:
            own = sorted((r for r in rows if k in (None, r[0])), key=lambda r: (-r[2], r[1]))
            assert [got[r[0], r[1]] for r in own] == [(i + 1, len(own)) for i in range(len(own))]


def test_lists_too_short_for_enrichment(spark):
    ranked = spark.createDataFrame([("a", f"g{k}", float(k)) for k in range(12)] + [("b", "g1", 1.0), ("c", "g1", None)], "cluster string, gene string, stat double")
    sets = spark.createDataFrame([("s", "g11"), ("s", "g10")], "set_id string, gene string")
    got = {r.cluster: (r.set_id, r.n_ranked) for r in expression.gsea_by(ranked, sets, "cluster").collect()}
    assert got == {"a": ("s", 12), "b": (None, 1), "c": (None, 0)}


def test_curves(spark):
    v = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 1.0), ("a", None)], "k string, v double")
    assert {r.x: round(r.share, 3) for r in plotdata.ecdf(v, "v", ["k"], 2).collect()} == {0.0: 0.333, 0.5: 0.667, 1.0: 1.0}


def best_modularity(n, weight):
    """The largest modularity of all partitions of a few nodes."""
    m = 2 * sum(weight.values())
    k = [sum(w for e, w in weight.items() if i in e) for i in range(n)]
    best = -1.0

    def go(i, labels, used):
        nonlocal best
        if i == n:
            q = sum(2 * w for (a, b), w in weight.items() if labels[a] == labels[b]) / m
            q -= sum((sum(k[j] for j in range(n) if labels[j] == c) / m) ** 2 for c in range(used))
            best = max(best, q)
            return
        for c in range(used + 1):
            go(i + 1, [*labels, c], max(used, c + 1))

    go(0, [], 0)
    return best


def test_louvain(spark, tmp_path):
    rng = random.Random(6)
    weight = {(a, b): rng.choice([1.0, 2.0]) if a // 3 == b // 3 else 0.3 for a in range(8) for b in range(a + 1, 8) if a // 3 == b // 3 or rng.random() < 0.4}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "a bigint, b bigint, weight double")
    got = clustering.louvain(df, str(tmp_path / "few"))
    both = df.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").alias("w"))
    both = both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    q = clustering.modularity(both, got.select(F.col("id").alias("node"), F.col("cluster").alias("c")))
    assert q == pytest.approx(best_modularity(8, weight))
    groups = [(a, b, 1.0) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.6 if a % 4 == b % 4 else 0.03)]
    many = {r.id: r.cluster for r in clustering.louvain(spark.createDataFrame(groups, "a bigint, b bigint, weight double"), str(tmp_path / "many")).collect()}
    assert many == {k: k % 4 for k in range(60)}
    assert clustering.louvain(df.where("false"), str(tmp_path / "none")).count() == 0


def test_result_set_without_hits(spark, tmp_path):
    de = spark.createDataFrame([("a", "01", 0.1, 0.9), ("b", "01", -0.2, 0.8)], "feature_id string, comparison string, log2FoldChange double, padj double")
    writers.result_set(de, str(tmp_path / "r"), ["comparison"])
    assert {(r.feature_id, r.comparison, r.log2FoldChange) for r in readers.result_set(spark, str(tmp_path / "r")).collect()} == {("a", "01", "0.1"), ("b", "01", "-0.2")}
    for what in ("significant", "up", "down"):
        x = readers.result_set(spark, str(tmp_path / "r"), what)
        assert x.columns == ["feature_id", "log2FoldChange", "padj", "comparison"] and x.count() == 0
    assert readers.gene_lists(spark, {"one": str(tmp_path / "r")}).collect() == []


def test_result_set_is_computed_once_and_keeps_texts(spark, tmp_path):
    names = ["two\nlines", "two\r\nlines", "a\rb", "end\n", "\nstart", "  spaces ", 'q"u,o\\', '"', "plain"]
    rows = [(name, "x", 2.0 if k % 2 else -2.0, 0.01) for k, name in enumerate(names)] + [("n", "x", float("nan"), 0.01), ("n", "y", float("nan"), 0.01), ("none", "y", None, None)]
    run = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()
    de = spark.createDataFrame(rows, "feature_id string, comparison string, log2FoldChange double, padj double").repartition(4).withColumn("run", run())
    writers.result_set(de, str(tmp_path / "r"), ["comparison"])
    back = {n: {(r.feature_id, r.comparison, r.log2FoldChange, r.run) for r in readers.result_set(spark, str(tmp_path / "r"), n).collect()} for n in ("all", "significant", "up", "down")}
    text = lambda v: None if v is None else "NaN" if v != v else str(v)
    assert sorted(map(str, (x[:3] for x in back["all"]))) == sorted(str((f, c, text(v))) for f, c, v, _ in rows)
    assert back["significant"] == {x for x in back["all"] if x[2] is not None}
    assert back["up"] == {x for x in back["all"] if x[2] in ("2.0", "NaN")} and back["down"] == {x for x in back["all"] if x[2] == "-2.0"}
    assert {(r.comparison, r.n_tested, r.n_significant, r.n_up, r.n_down) for r in readers.result_set(spark, str(tmp_path / "r"), "summary").collect()} == {("x", "10", "10", "5", "5"), ("y", "2", "1", "1", "0")}
