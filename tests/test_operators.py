import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.functions import scalar as S
from lociform.operators import cells, clustering, editing, expression, graph, models, multivariate, plotdata, quality, sequences, stats, values

V = "feature_id string, sample_id string, value double"


def test_tails():
    assert S.normal_tail(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert S.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert S.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert S.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert S.f_tail(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    exact = sum(math.comb(5, k) * math.comb(15, 6 - k) for k in (3, 4, 5)) / math.comb(20, 6)
    assert S.hypergeom_tail(3, 20, 5, 6) == pytest.approx(exact)
    assert S.hypergeom_tail(0, 20, 5, 6) == pytest.approx(1.0)


def test_scalars(spark):
    df = spark.createDataFrame([(1234.5, "ENSG1.12", "AACAAAAT", "3/40"), (-0.00012349, "x.y", "", "bad"), (0.0, "a", "N", "1/0")], "x double, id string, s string, r string")
    got = df.select(S.signif(df.x), S.strip_version(df.id), S.longest_run(df.s, "A"), S.ratio_text(df.r), S.complement(df.s)).collect()
    assert [r[0] for r in got] == pytest.approx([1230.0, -0.000123, 0.0])
    assert [r[1] for r in got] == ["ENSG1", "x.y", "a"] and [r[2] for r in got] == [4, 0, 0]
    assert [r[3] for r in got] == [0.075, None, None] and got[0][4] == "TTGTTTTA"


def test_bh_with_ties_and_nulls(spark):
    p = [0.01, 0.04, 0.04, 0.03, None, 0.9, 0.02]
    got = {r.k: r.padj for r in stats.bh(spark.createDataFrame(list(enumerate(p)), "k int, pvalue double")).collect()}
    known = sorted((x, k) for k, x in enumerate(p) if x is not None)
    run, want = 1.0, {4: None}
    for i in range(len(known) - 1, -1, -1):
        run = min(run, known[i][0] * len(known) / (i + 1))
        want[known[i][1]] = run
    assert {k: None if v is None else round(v, 12) for k, v in got.items()} == {k: None if v is None else round(v, 12) for k, v in want.items()}


def test_values(spark):
    rng = random.Random(1)
    rows = [(f"g{i}", f"s{j}", float(rng.randrange(0, 50))) for i in range(12) for j in range(6) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, V)
    full = values.combine(df, "outer")
    assert full.count() == 12 * 6 and values.combine(df, "inner").groupBy("feature_id").count().where("count <> 6").count() == 0
    z = values.scale(full).groupBy("feature_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.d - 1) < 1e-9 for r in z)
    flat = spark.createDataFrame([("a", "s1", 2.0), ("a", "s2", 2.0)], V)
    assert {r.value for r in values.scale(flat).collect()} == {None}
    f = {r.sample_id: r.size_factor for r in values.size_factors(full).collect()}
    m = {(a, b): v for a, b, v in rows}
    genes = [g for g in {r[0] for r in rows} if all(m.get((g, f"s{j}"), 0) > 0 for j in range(6))]
    for s, got in f.items():
        want = np.median([m[g, s] / np.exp(np.mean([np.log(m[g, f"s{j}"]) for j in range(6)])) for g in genes])
        assert got == pytest.approx(want, rel=0.2) if len(genes) % 2 == 0 else got == pytest.approx(want)
    holes = spark.createDataFrame([("a", "s1", None), ("a", "s2", 4.0), ("a", "s3", 8.0)], V)
    assert values.impute(holes).where("sample_id = 's1'").first().value == 6.0
    assert values.impute(holes, "half_min").where("sample_id = 's1'").first().value == 2.0
    one = [r.value for r in values.impute(holes, "shifted").orderBy("sample_id").collect()]
    assert one == [r.value for r in values.impute(holes.repartition(3), "shifted").orderBy("sample_id").collect()]
    with pytest.raises(ValueError):
        values.filter_samples(df, df, nothing=[1])


def test_results_bounds(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 0.05), ("b", "x", 1.1, 0.04), ("c", "x", -2.0, None), ("b", "y", 1.5, 0.01)], "feature_id string, comparison string, log2FoldChange double, padj double")
    sel = lambda **k: {r.feature_id for r in expression.select(df, **k).collect()}
    assert sel() == {"a", "b"} and sel(p_closed=False, lfc_closed=False) == {"b"} and sel(how="intersect") == {"b"}
    v = {r.feature_id: r["class"] for r in plotdata.volcano(df.where("comparison = 'x'")).collect()}
    assert v == {"a": "up", "b": "up", "c": "none"}


def test_gsea_by_brute_force(spark):
    rng = random.Random(3)
    ranked = [(f"g{k}", rng.gauss(0, 1)) for k in range(60)]
    sets = {f"s{i}": {f"g{k}" for k in rng.sample(range(60), 3 + 2 * i)} for i in range(6)}
    got = {r.set_id: r.es for r in expression.gsea(spark.createDataFrame([*ranked, ("none", None)], "gene string, stat double"), spark.createDataFrame([(s, g) for s, gs in sets.items() for g in gs], "set_id string, gene string")).collect()}
    order = sorted(ranked, key=lambda r: (-r[1], r[0]))
    for s, gs in sets.items():
        total, run, best = sum(abs(x) for g, x in order if g in gs), 0.0, [0.0]
        for g, x in order:
            run += abs(x) / total if g in gs else -1 / (60 - len(gs))
            best.append(run)
        want = max(best) if max(best) >= -min(best) else min(best)
        assert got[s] == pytest.approx(want)


def test_cells(spark):
    e = spark.createDataFrame([("MT-A", "c1", 5), ("B", "c1", 5), ("B", "c2", 1)], "gene string, cell string, counts bigint")
    got = {r.cell: (r["sum"], r.detected, r.pct_mito, r.log10_genes_per_umi) for r in cells.cell_metrics(e).collect()}
    assert got["c1"] == (10, 2, 50.0, pytest.approx(math.log10(2))) and got["c2"] == (1, 1, 0.0, None)


def test_knn_many_ties(spark):
    x = np.random.default_rng(0).integers(0, 3, (500, 2)).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, vec array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {(i, k + 1, j) for i in range(500) for k, j in enumerate(sorted((j for j in range(500) if j != i), key=lambda j: (d[i, j], j))[:4])}
    assert {(r.id, r["rank"], r.other) for r in graph.knn(df, 4).collect()} == want


def test_knn_blocks(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(60, 4)), np.zeros((3, 4))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, vec array<double>")
    want = set()
    for i in range(len(x)):
        d = sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 9), j) for j in range(len(x)) if j != i)[:4]
        want |= {(i, k + 1, j) for k, (_, j) in enumerate(d)}
    for block in (10, 2048):
        assert {(r.id, r["rank"], r.other) for r in graph.knn(df, 4, block).collect()} == want
    assert all(r.weight <= 1 for r in graph.snn(graph.knn(df, 4)).collect())


def test_editing(spark):
    reads = spark.createDataFrame([("r", 1, "C", b) for b in "CCCTTA"] + [("r", 2, "A", "A"), ("r", 2, "A", "N")], "region string, position bigint, reference string, base string")
    s = {r.position: r for r in editing.base_counts(reads).collect()}
    assert (s[1].all_subs, s[1].coverage, s[1].frequency) == ("CA CT", 6, 0.5) and (s[2].all_subs, s[2].frequency) == ("-", 0.0)
    a = editing.primary_alt(editing.base_counts(reads)).where("position = 1").first()
    assert (a.alt, a.alt_count) == ("T", 2)
    dna = spark.createDataFrame([("r", 1, 30, 0, 27, 0, 3)], "region string, position bigint, coverage bigint, count_A bigint, count_C bigint, count_G bigint, count_T bigint")
    g = {r.position: r.germline_status for r in editing.germline(editing.primary_alt(editing.base_counts(reads)), dna).collect()}
    assert g == {1: "germline", 2: None}
    al = spark.createDataFrame([("ok", 99, 60, "ACGT", False), ("unmapped", 103, 60, "ACGT", False), ("dup", 99 + 1024, 60, "ACGT", False), ("low", 99, 3, "ACGT", False), ("sa", 99, 60, "ACGT", True), ("improper", 97, 60, "ACGT", False)], "qname string, flag int, mapq int, seq string, has_sa boolean")
    assert [r.qname for r in editing.read_filter(al).collect()] == ["ok"]


def test_sequences(spark):
    df = spark.createDataFrame([(1, "ACACACGGGGn"), (2, "")], "id bigint, seq string")
    r = {x.id: x for x in sequences.composition(df).collect()}
    assert (r[1].longest_homopolymer, r[1].longest_dinucleotide, r[1].gc, r[1].n_N) == (4, 6, 0.7, 1) and r[2].gc is None
    assert sorted(x.position for x in sequences.motif_positions(df, "ACA").collect()) == [0, 2]


def test_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=40)
    y = 2 + 3 * x + rng.normal(size=40) * 0.1
    df = spark.createDataFrame([("f", float(a), float(b)) for a, b in zip(x, y, strict=True)], "feature_id string, x double, value double")
    fit = {r.term: r for r in models.ols_per_feature(df, ["x"]).collect()}
    b = np.polyfit(x, y, 1)
    assert fit["x"].estimate == pytest.approx(b[0]) and fit["intercept"].estimate == pytest.approx(b[1]) and fit["x"].pvalue < 1e-20
    c = [("up", float(v), 1.0, g) for g, m in (("a", 20), ("b", 80)) for v in rng.poisson(m, 8)] + [("same", float(v), 1.0, g) for g in "ab" for v in rng.poisson(30, 8)]
    nb = {r.feature_id: r for r in models.negative_binomial(spark.createDataFrame(c, "feature_id string, value double, size_factor double, grp string")).collect()}
    assert nb["up"].estimate == pytest.approx(2, abs=0.4) and nb["up"].pvalue < 1e-6 and nb["same"].pvalue > 0.01
    p = rng.normal(size=(50, 3)) * [5, 1, 0.1]
    pc = models.pca(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(p)], "id bigint, vec array<double>"), 2).where("component = 1").orderBy("id").collect()
    assert abs(np.corrcoef([r.score for r in pc], p[:, 0])[0, 1]) > 0.999
    u, v, r = models.sparse_cca(np.c_[x, rng.normal(size=(40, 3))], np.c_[rng.normal(size=(40, 2)), x + 0.01 * rng.normal(size=40)], 0.3, 0.3)
    assert abs(r) > 0.95 and np.argmax(np.abs(u)) == 0 and np.argmax(np.abs(v)) == 2


def test_quality(spark):
    df = spark.createDataFrame([(1, " NA ", 1.0), (2, "x", None), (3, "x", 1.0)], "id int, a string, b double")
    p = {r.column: r for r in quality.profile_columns(quality.normalise_missing(df), "id").collect()}
    assert (p["a"].missing, p["a"].n_distinct, p["a"].constant) == (pytest.approx(1 / 3), 1, True) and p["b"].top_share == 1.0
    sheet = spark.createDataFrame([("f", "g", "atac", "bed", 1, 1, 1), ("", "g", "atac", "zip", 1, 1, 1)], "file_name string, `group` string, omics string, format string, bio_rep int, tech_rep int, batch int")
    got = sorted((r.rule, r.detail) for r in quality.validate_sheet(sheet, ["file_name", "format"]).collect())
    assert got == sorted([("duplicate_id", "atac_g_11_b1")] * 2 + [("empty", "file_name"), ("format", "zip")])
    with pytest.raises(ValueError):
        quality.validate_sheet(sheet, ["absent"])


def test_clustering(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 0.1, (20, 3)), rng.normal(3, 0.1, (20, 3))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, vec array<double>")
    lab = {r.id: r.cluster for r in clustering.kmeans(df, 2).collect()}
    assert len({lab[k] for k in range(20)}) == len({lab[k] for k in range(20, 40)}) == 1 and lab[0] != lab[39]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert clustering.average_linkage(d, 2).tolist() == [0] * 20 + [1] * 20
    g = {r.id: r.cluster for r in clustering.label_propagation(graph.snn(graph.knn(df, 5)).select("a", "b", "weight")).collect()}
    assert not {g[k] for k in range(20)} & {g[k] for k in range(20, 40)}
    shifted = spark.createDataFrame([(k, (v + (0.4 if k % 2 else 0)).tolist()) for k, v in enumerate(x)], "id bigint, vec array<double>")
    out = np.array([r.vec for r in clustering.integrate_batches(shifted, spark.createDataFrame([(k, k % 2) for k in range(40)], "id bigint, batch int"), 2).orderBy("id").collect()])
    assert np.abs(out[:20:2].mean(0) - out[1:20:2].mean(0)).max() < 1e-9


def test_deconvolution_and_permutation(spark):
    sig = spark.createDataFrame([(t, f"g{k}", float(w)) for t, ws in {"A": (9, 1, 1, 5), "B": (1, 9, 1, 5), "C": (1, 1, 9, 5)}.items() for k, w in enumerate(ws)], "cell_type string, feature_id string, weight double")
    mix = [0.2 * a + 0.5 * b + 0.3 * c for a, b, c in zip((9, 1, 1, 5), (1, 9, 1, 5), (1, 1, 9, 5), strict=True)]
    v = spark.createDataFrame([(f"g{k}", "s", float(x)) for k, x in enumerate(mix)], V)
    got = {r.cell_type: r.share for r in clustering.deconvolve(v, sig).collect()}
    assert got == {"A": pytest.approx(0.2, abs=1e-3), "B": pytest.approx(0.5, abs=1e-3), "C": pytest.approx(0.3, abs=1e-3)}
    ranked = spark.createDataFrame([(f"g{k}", 5.0 - k * 0.1) for k in range(100)], "gene string, stat double")
    sets = spark.createDataFrame([("top", f"g{k}") for k in range(8)] + [("spread", f"g{k}") for k in range(3, 100, 12)], "set_id string, gene string")
    p = {r.set_id: r for r in clustering.gsea_permutation(ranked, sets).collect()}
    assert p["top"].es > 0.9 and p["top"].pvalue < 0.05 < p["spread"].pvalue


def test_sites_without_alternative(spark):
    cols = "region string, position bigint, reference string, coverage bigint, count_A bigint, count_C bigint, count_G bigint, count_T bigint, all_subs string"
    rows = [("c", 1, "A", 9, 9, 0, 0, 0, "-"), ("c", 2, "A", 9, 1, 4, 4, 0, "AG AC"), ("c", 3, "A", 9, 1, 8, 0, 0, "GC"), ("c", 4, "C", 30, 0, 20, 0, 10, "CT"), ("c", 5, "C", 30, 0, 20, 0, 10, "CT"), ("c", 6, "C", 30, 0, 20, 0, 10, "CT")]
    x = editing.primary_alt(spark.createDataFrame(rows, cols))
    assert {r.position: (r.alt, r.alt_count) for r in x.collect()} == {1: (None, None), 2: ("G", 4), 3: (None, None), 4: ("T", 10), 5: ("T", 10), 6: ("T", 10)}
    dna = spark.createDataFrame([("c", 1, "A", 50, 50, 0, 0, 0, "-"), ("c", 4, "C", 30, 0, 27, 0, 3, "CT"), ("c", 5, "C", 31, 0, 28, 0, 3, "CT"), ("c", 6, "C", 9, 0, 0, 0, 9, "CT")], cols)
    got = {r.position: (r.dna_coverage, r.dna_alt_reads, r.germline_status) for r in editing.germline(x, dna).collect()}
    assert got == {1: (None, None, None), 2: (None, None, "undetermined"), 3: (None, None, None), 4: (30, 3, "germline"), 5: (31, 3, "confirmed_somatic"), 6: (9, 9, "undetermined")}


def test_robust_scale_without_spread(spark):
    rows = [("flat", f"s{k}", 3.0) for k in range(5)] + [("one", "s0", 9.0)]
    rows += [("iqr0", f"s{k}", v) for k, v in enumerate([1.0] * 8 + [5.0, -3.0])] + [("wide", f"s{k}", float(k)) for k in range(5)]
    got = {}
    for r in values.scale(spark.createDataFrame(rows, "feature_id string, sample_id string, value double"), "robust").collect():
        got.setdefault(r.feature_id, []).append(r.value)
    assert set(got["flat"]) == {0.0} and got["one"] == [0.0]
    assert sorted(got["iqr0"]) == [-4.0] + [0.0] * 8 + [4.0]  # neither IQR nor MAD: a scale of 1
    assert sorted(got["wide"]) == [-1.0, -0.5, 0.0, 0.5, 1.0]


def test_no_significant_feature_is_an_error(spark):
    de = spark.createDataFrame([("g", "x", 2.0, 0.05), ("h", "x", 0.9, 0.01), ("g", "y", 3.0, None)], "feature_id string, comparison string, log2FoldChange double, padj double")
    with pytest.raises(ValueError, match="no feature"):
        expression.comparison_table(de, ["x", "y"], p_cut=0.05, lfc_cut=1.0).collect()
    got = expression.comparison_table(de, ["x", "y"], p_cut=0.051, lfc_cut=1.0).collect()
    assert [tuple(r) for r in got] == [("g", 2.0, 0.05, 3.0, None)]


def test_duplicates_by_both_mates(spark):
    rows = [("a", 99, "c", 10, "II", 60), ("a", 147, "c", 90, "II", 60), ("b", 99, "c", 10, "AA", 60), ("b", 147, "c", 90, "AA", 60), ("c", 99, "c", 10, "##", 60), ("c", 147, "c", 95, "##", 60)]
    df = spark.createDataFrame(rows, "qname string, flag int, chr string, pos bigint, qual string, mapq int")
    assert {(r.qname, r.duplicate) for r in editing.mark_duplicates(df).collect()} == {("a", False), ("b", True), ("c", False)}


def test_long_sequences_in_chunks(spark, monkeypatch):
    import random

    rng = random.Random(2)
    seqs = ["", "N", "A", "ACACACA", "AAAA", "ACGT" * 20 + "N" * 9 + "TGTGTGTGTG", "G" * 40 + "CT" * 15] + ["".join(rng.choice("ACGTN") for _ in range(200)) for _ in range(30)]
    whole = [sequences._describe(s.encode()) for s in seqs]
    monkeypatch.setattr(sequences, "CHUNK", 7)
    assert [sequences._describe(s.encode()) for s in seqs] == whole


def test_consensus_matrix_makes_pairs_where_they_are_returned(spark):
    """Odd inputs as by a join on runs (more than 64 runs, repeated and unknown labels, NULL keys), and no exchange of pairs."""

    def joined(rows):
        out = {}
        for i, r, c in rows:
            for k, s, e in rows:
                if None not in (i, k, r) and r == s and i < k:
                    x = out.setdefault((i, k), [0, 0, 0])
                    x[0], x[1], x[2] = x[0] + 1, x[1] + (None not in (c, e)), x[2] + (c is not None and c == e)
        return {k: (n, same / known if known else None) for k, (n, known, same) in out.items()}

    rng = random.Random(3)
    many = [(f"i{i}", f"r{r}", f"c{rng.randrange(5)}") for i in range(14) for r in range(70) if rng.random() < 0.1]
    odd = [(f"i{rng.randrange(12)}", f"r{rng.randrange(3)}", rng.choice(["a", "b", None])) for _ in range(60)] + [(None, "r1", "a"), ("i1", None, "a")]
    for rows in ([], [("i1", "r1", None), ("i2", "r1", None), ("i3", "r2", "a")], many, odd):
        df = spark.createDataFrame(rows, "item string, run string, cluster string")
        for block in (3, 4096):
            got = clustering.consensus_matrix(df, block)
            assert {(r.x, r.y): (r.runs, r.consensus) for r in got.collect()} == joined(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not any(w in plan[: plan.index("Join")] for w in ("Exchange", "Aggregate"))


def test_reference_labels_of_constant_profiles(spark):
    """A constant cell or reference profile has no correlation; it is no error and no best label."""
    e = spark.createDataFrame([(c, g, float(v)) for c, vs in (("rises", (1, 2, 5)), ("flat", (2, 2, 2)), ("falls", (9, 3, 1))) for g, v in zip("abc", vs)], "cell string, gene string, value double")
    ref = spark.createDataFrame([(n, g, float(v)) for n, vs in (("even", (4, 4, 4)), ("up", (1, 3, 8)), ("down", (8, 3, 1))) for g, v in zip("abc", vs)], "label string, gene string, value double")
    assert {r.cell: (r.label, r.r) for r in multivariate.reference_labels(e, ref).collect()} == {"rises": ("up", 1.0), "falls": ("down", 1.0)}
