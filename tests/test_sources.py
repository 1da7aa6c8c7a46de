import pytest

from lociform.sources import readers, writers
from lociform.streaming import islands


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_bed_and_peaks(spark, tmp_path):
    b = put(tmp_path / "a.bed", "# note\nc1\t5\t9\tn\t1.5\t+\nchr\tstart\tend\tname\tscore\tstrand\nc2\t0\t1\tm\t2\t-\n")
    assert [tuple(r) for r in readers.bed(spark, b, 3).collect()] == [("c1", 5, 9), ("c2", 0, 1)]
    p = put(tmp_path / "a.narrowPeak", "c1\t10\t20\tp\t5\t.\t1\t2\t3\t4\nc1\t30\t40\tq\t0\t.\t1\t2\t0.5\t-1\n")
    assert [(r.start, r.summit_pos) for r in readers.narrow_peaks(spark, p).collect()] == [(10, 14), (30, None)]
    assert readers.narrow_peaks(spark, p, min_qvalue=1).count() == 1


def test_counts_directory(spark, tmp_path):
    put(tmp_path / "d" / "s1.counts.txt", "gene\tcount\ng1\t3\ng2\t0\n")
    put(tmp_path / "d" / "s2.counts.txt", "g1\t7\n")
    v = readers.counts_files(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, v.collect())) == [("g1", "s1", 3.0), ("g1", "s2", 7.0), ("g2", "s1", 0.0)]
    assert {r.value for r in readers.require_integral(v).collect()} == {0, 3, 7}
    with pytest.raises(Exception, match="not an integer count"):
        readers.require_integral(v.withColumn("value", v.value + 0.5)).collect()


def test_gtf_sizes_and_fasta(spark, tmp_path):
    g = put(tmp_path / "a.gtf", '##sequence-region c1 1 500\nc1\tx\tgene\t11\t20\t.\t+\t.\tgene_id "G1.2"; gene_name "N";\nc2\tx\texon\t1\t90\t.\t-\t.\tgene_id "G2";\n')
    r = readers.gtf(spark, g, "gene").first()
    assert (r.start, r.stop, r.gene_id, r.gene_name, r.transcript_id) == (10, 20, "G1.2", "N", None)
    assert {tuple(x) for x in readers.chromosome_sizes(spark, g).collect()} == {("c1", 500), ("c2", 90)}
    f = put(tmp_path / "a.fa", ">c1 note\nACGT\nAC\n>c2\nGG\n")
    assert sorted(tuple(x)[:3] for x in readers.fasta(spark, f).collect()) == [("c1", 0, "ACGT"), ("c1", 4, "AC"), ("c2", 0, "GG")]


def test_matrix_folder_and_editing(spark, tmp_path):
    put(tmp_path / "m" / "matrix.mtx", "%%MatrixMarket\n3 2 3\n1 1 4\n3 2 1\n2 1 9\n")
    put(tmp_path / "m" / "genes.tsv", "g1\tA\ng2\tB\ng3\tC\n")
    put(tmp_path / "m" / "barcodes.tsv", "c1\nc2\n")
    assert sorted(map(tuple, readers.triplets(spark, str(tmp_path / "m")).collect())) == [("g1", "c1", 4), ("g2", "c1", 9), ("g3", "c2", 1)]
    e = put(tmp_path / "e.txt", "Region\tPosition\tReference\tStrand\tCoverage-q30\tMeanQ\tBaseCount[A,C,G,T]\tAllSubs\tFrequency\nc1\t7\tC\t1\t8\t30.5\t[0, 5, 0, 3]\tCT\t0.38\nc1\t8\tA\t1\t8\t30.5\t[8, 0, 0, 0]\t-\t0\n")
    r = readers.editing(spark, e).collect()
    assert len(r) == 1 and (r[0].count_C, r[0].count_T, r[0].all_subs) == (5, 3, "CT")
    w = put(tmp_path / "w.tsv", "id\tnote\tS1_Plate 1\tS2_Plate 1\na\tx\t4\tbad\n")
    assert sorted(map(tuple, readers.wide_matrix(spark, w, "_Plate").collect())) == [("a", "S1_Plate 1", 4.0), ("a", "S2_Plate 1", None)]


def test_alignments_and_writers(spark, tmp_path):
    s = put(tmp_path / "a.sam", "@HD\tx\nq\t99\tc1\t11\t60\t4M\t=\t20\t9\tACGT\tIIII\tSA:Z:x\n")
    r = readers.alignments(spark, s).first()
    assert (r.pos, r.flag, r.has_sa) == (10, 99, True)
    df = spark.createDataFrame([("c1", 5, 9, 1.0), ("c1", 1, 2, 0.0)], "chr string, start bigint, stop bigint, score double")
    for f, name in ((writers.csv, "c"), (writers.bed, "b"), (writers.bed_graph, "g"), (writers.json_rows, "j"), (writers.intervals, "i")):
        f(df, str(tmp_path / name))
        f(df.limit(0), str(tmp_path / name))  # an existing result stays
    assert spark.read.csv(str(tmp_path / "b"), sep="\t").count() == 2 and readers.coverage(spark, str(tmp_path / "g")).count() == 1
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2
    with pytest.raises(ValueError):
        readers.require_columns(df, ["nothing"])


def test_sessions(spark, tmp_path):
    df = spark.createDataFrame([("a", k) for k in (0, 5, 9, 40, 100000)] + [("b", 3)], "k string, s long").selectExpr("k", "timestamp_seconds(s) AS at")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = islands.sessions(stream, "k", "at", "10 seconds", "1 second").writeStream.format("memory").queryName("s").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.k, r.n) for r in spark.table("s").collect()) == [("a", 1), ("a", 3), ("b", 1)]
