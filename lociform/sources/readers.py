"""Readers of text formats, each with an explicit schema; nothing is inferred and every scan is splittable (written results by files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    if absent := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks columns: {', '.join(absent)}")
    return df


def _tsv(spark: SparkSession, path, schema: str, header: bool = False, comment: str | None = "#") -> DataFrame:
    r = spark.read.schema(schema).option("sep", "\t").option("header", header).option("mode", "PERMISSIVE")
    return (r.option("comment", comment) if comment else r).csv(path)


def bed(spark: SparkSession, path, columns: int = 6) -> DataFrame:
    """First `columns` (3 to 6) columns of BED files; rows whose coordinates are no integers drop."""
    fields = schemas.INTERVALS.split(", ")[:columns]
    return _tsv(spark, path, ", ".join(fields)).where("start IS NOT NULL AND stop IS NOT NULL")


def narrow_peaks(spark: SparkSession, path, min_score: float = 0, min_qvalue: float = 0) -> DataFrame:
    """narrowPeak files with summit_pos; a bound of 0 does not filter."""
    x = _tsv(spark, path, schemas.NARROW_PEAKS)
    if min_score > 0:
        x = x.where(F.col("score") >= min_score)
    if min_qvalue > 0:
        x = x.where(F.col("qvalue") >= min_qvalue)
    return x.withColumn("summit_pos", F.when(F.col("peak_summit") >= 0, F.col("start") + F.col("peak_summit")))


def blocks(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.BLOCKS)


def read_pairs(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.READ_PAIRS)


def coverage(spark: SparkSession, path) -> DataFrame:
    """bedGraph files."""
    return _tsv(spark, path, schemas.COVERAGE)


def counts_files(spark: SparkSession, path) -> DataFrame:
    """Directory of two-column count files to long values; the sample is the file's name up to its first dot, and a
    header is whatever has no number in its second column."""
    x = _tsv(spark, path, "feature_id string, text string")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^/]*)?$", 1)
    x = x.select("feature_id", name.alias("sample_id"), F.col("text").try_cast("double").alias("value"))
    return x.where("value IS NOT NULL")


def require_integral(values: DataFrame) -> DataFrame:
    """Values as integers; a fraction is an error when the row is read."""
    bad = F.raise_error(F.concat(F.lit("not an integer count: "), F.col("value").cast("string")))
    return values.withColumn("value", F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint")).otherwise(bad.cast("bigint")))


def wide_matrix(spark: SparkSession, path, sample_pattern: str, sep: str = "\t") -> DataFrame:
    """Delimited matrix with a header to long values; columns that match the pattern are samples, the first column is the key."""
    import re

    x = spark.read.option("sep", sep).option("header", True).csv(path)
    samples = [c for c in x.columns if re.search(sample_pattern, c)]
    if not samples:
        raise ValueError(f"no column matches {sample_pattern}")
    key = x.columns[0]
    num = x.select(F.col(f"`{key}`").alias("feature_id"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in samples])
    return num.unpivot("feature_id", samples, "sample_id", "value")


def gtf(spark: SparkSession, path, feature: str | None = None) -> DataFrame:
    """GTF rows as 0-based half-open intervals with gene_id, gene_name and transcript_id."""
    x = _tsv(spark, path, "chr string, source string, feature string, start bigint, stop bigint, score string, strand string, frame string, attributes string")
    if feature:
        x = x.where(F.col("feature") == feature)
    attr = lambda k: F.nullif(F.regexp_extract("attributes", f'{k} "([^"]+)"', 1), F.lit(""))
    return x.select("chr", (F.col("start") - 1).alias("start"), "stop", "strand", "feature", attr("gene_id").alias("gene_id"), attr("gene_name").alias("gene_name"), attr("transcript_id").alias("transcript_id"))


def chromosome_sizes(spark: SparkSession, path) -> DataFrame:
    """Sizes from ##sequence-region lines, else the furthest end of any feature."""
    t = spark.read.text(path)
    told = t.where(F.startswith("value", F.lit("##sequence-region"))).select(F.split("value", r"\s+")[1].alias("chr"), F.split("value", r"\s+")[3].cast("bigint").alias("told"))
    seen = gtf(spark, path).groupBy("chr").agg(F.max("stop").alias("seen"))
    return seen.join(told, "chr", "full").select("chr", F.coalesce("told", "seen").alias("size"))


def _lines(spark: SparkSession, path) -> DataFrame:
    """(value, file, split, n) of text files: a split by its place in the file, n the order of lines inside a split."""
    return spark.read.text(path).select("value", F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("split"), F.monotonically_increasing_id().alias("n"))


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(value, line): lines of one text file with their 1-based numbers. A line is numbered inside its split, and the counts of the
    splits before it, one small row each, are carried in."""
    x = _lines(spark, path)
    w = Window.orderBy("split")  # as many rows as splits
    c = x.groupBy("split").agg(F.count(F.lit(1)).alias("k")).select("split", (F.sum("k").over(w) - F.col("k")).alias("before"))
    line = F.col("before") + F.row_number().over(Window.partitionBy("split").orderBy("n"))
    return x.join(F.broadcast(c), "split").select("value", line.alias("line"))


def triplets(spark: SparkSession, folder: str) -> DataFrame:
    """10x-style matrix folder (matrix.mtx, genes.tsv or features.tsv, barcodes.tsv) to (gene, cell, counts)."""
    m = spark.read.text(f"{folder}/matrix.mtx").where(~F.startswith("value", F.lit("%")))
    p = F.split(F.trim("value"), r"\s+")
    m = m.select(p[0].cast("bigint").alias("g"), p[1].cast("bigint").alias("c"), p[2].cast("bigint").alias("counts"))

    def numbered(name: str, column: str, out: str) -> DataFrame:
        return numbered_lines(spark, f"{folder}/{name}").select(F.col("line").alias(column), F.split("value", "\t")[0].alias(out))

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/features.tsv")
    names = "features.tsv" if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else "genes.tsv"
    # the first line tells the sizes; a value in the last place that equals it comes a second time and stays
    first = m.first()
    if first is None:
        raise ValueError(f"{folder}/matrix.mtx has no size line")
    is_first = (F.col("g") == first.g) & (F.col("c") == first.c) & (F.col("counts") == first.counts)
    same = m.where(is_first).count() - 1
    body = m.where(~is_first)
    if same:
        body = body.unionAll(spark.createDataFrame([tuple(first)] * same, m.schema))
    return body.join(numbered(names, "g", "gene"), "g").join(numbered("barcodes.tsv", "c", "cell"), "c").select("gene", "cell", "counts")


def transcript_quant(spark: SparkSession, path) -> DataFrame:
    """quant.sf files of several samples (sample: the folder's name)."""
    x = _tsv(spark, path, schemas.QUANT, header=True, comment=None)
    return x.select(F.col("Name").alias("feature_id"), F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("sample_id"), F.col("NumReads").alias("value"), F.col("TPM").alias("tpm"), F.col("EffectiveLength").alias("length"))


def editing(spark: SparkSession, path) -> DataFrame:
    """Editing tables, their coverage column named after the quality bound 30 or 20; rows without a substitution drop at the scan."""
    x = _tsv(spark, path, schemas.EDITING, header=True, comment=None).where("AllSubs <> '-'")
    from ..operators.editing import parse_counts

    x = parse_counts(x)
    return x.select(F.col("Region").alias("region"), F.col("Position").alias("position"), F.col("Reference").alias("reference"), F.col("Strand").alias("strand"), F.col("Coverage-q30").alias("coverage"), F.col("MeanQ").alias("mean_quality"), "count_A", "count_C", "count_G", "count_T", F.col("AllSubs").alias("all_subs"), F.col("Frequency").alias("frequency"))


def known_motifs(spark: SparkSession, path) -> DataFrame:
    """Motif result tables: percent texts become numbers, p and q as given."""
    x = spark.read.option("sep", "\t").option("header", True).csv(path)
    pct = [c for c in x.columns if c.startswith("%")]
    for c in pct:
        x = x.withColumn(c, F.regexp_replace(F.col(f"`{c}`"), "%", "").try_cast("double"))
    return x


def fasta(spark: SparkSession, path, chunk: int = 1 << 20) -> DataFrame:
    """FASTA to (chr, start, seq, chunk) rows, one for each sequence line with its offset in the record; `chunk` groups lines for range
    fetches. Offsets are summed inside splits of the files; the record that a split begins in, and how much of it lies in the
    splits before, come from one small row per split."""
    x = _lines(spark, path)
    head = F.startswith("value", F.lit(">"))
    x = x.withColumns({"header": F.when(head, F.split(F.substring("value", 2, 1 << 20), r"\s")[0]), "size": F.when(head, 0).otherwise(F.length("value"))})
    run = Window.partitionBy("file", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({"record": F.count("header").over(run), "own": F.last("header", True).over(run)})
    inside = Window.partitionBy("file", "split", "record").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ends = x.groupBy("file", "split", "record").agg(F.sum("size").alias("size"), F.max("own").alias("own"))
    tail = ends.groupBy("file", "split").agg(F.max_by("size", "record").alias("tail"), F.max_by("own", "record").alias("last"))
    order = Window.partitionBy("file").orderBy("split")
    tail = tail.withColumn("group", F.count("last").over(order))
    tail = tail.withColumn("sum", F.sum("tail").over(Window.partitionBy("file", "group").orderBy("split")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tail = tail.select("file", "split", F.last("last", True).over(before).alias("carried"), F.coalesce(F.lag("sum").over(order), F.lit(0)).alias("length"))
    y = x.where(F.col("header").isNull()).join(tail, ["file", "split"])
    start = F.col("at") + F.when(F.col("record") == 0, F.col("length")).otherwise(0)
    return y.select(F.coalesce("own", "carried").alias("chr"), start.cast("bigint").alias("start"), F.col("value").alias("seq")).withColumn("chunk", F.floor(F.col("start") / chunk))


def alignments(spark: SparkSession, path) -> DataFrame:
    """SAM text: header lines drop; has_sa tells of a supplementary alignment."""
    t = spark.read.text(path).where(~F.startswith("value", F.lit("@")))
    p = F.split("value", "\t")
    return t.select(p[0].alias("qname"), p[1].cast("int").alias("flag"), p[2].alias("chr"), (p[3].cast("bigint") - 1).alias("pos"), p[4].cast("int").alias("mapq"), p[5].alias("cigar"), p[9].alias("seq"), p[10].alias("qual"), F.contains("value", F.lit("\tSA:Z:")).alias("has_sa"))


def result_set(spark: SparkSession, folder: str, what: str = "all") -> DataFrame:
    """One table of a written differential result: all, significant, up, down or summary. A line break within quotes belongs to its
    text, so a file is one task's; the writer bounds the files. Empty texts come back as null."""
    r = spark.read.options(header=True, inferSchema=False, multiLine=True, lineSep="\n")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/columns")
    if what != "summary" and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        r = r.schema(r.csv(f"{folder}/columns").schema)  # texts all; a table may have no rows
    return r.csv(f"{folder}/{what}")


def gene_lists(spark: SparkSession, folders: dict[str, str], what: str = "significant", column: str = "feature_id", p: str = "padj", p_cut: float = 0.05, lfc_cut: float = 1.0) -> DataFrame:
    """(experiment, gene): distinct ids, blanks left out, of one table of each experiment's written result; `all` takes the bounds."""
    out = None
    for name, folder in folders.items():
        x = result_set(spark, folder, what)
        if what == "all":
            x = x.where((F.col(p).cast("double") < p_cut) & (F.abs(F.col("log2FoldChange").cast("double")) >= lfc_cut))
        x = x.select(F.lit(name).alias("experiment"), F.col(column).alias("gene")).where(F.trim("gene") != "").distinct()
        out = x if out is None else out.unionByName(x)
    return out


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a written bundle; an absent one is an error that names it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for n in names:
        path = hadoop(f"{folder}/{n}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(f"{folder} has no table {n}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


#: Formats of a sample sheet and their readers.
SHEET_READERS = {"peaks": narrow_peaks, "seacr": blocks, "bed": bed, "counts": counts_files}


def from_sheet(sheet: DataFrame, omics: str, path: str = "file_loc", formats: list[str] | None = None) -> DataFrame:
    """Files that a sample sheet (sample_id, omics, format, <path>) lists for one kind of data, under each other with their sample.

    Rows without a path (empty, or the text NA) are left out. Sheets are small; one scan is planned for each file.
    Counts keep the features that all samples have.
    """
    spark = sheet.sparkSession
    rows = sheet.where(F.col("omics") == omics).select("sample_id", "format", path).collect()
    out, kinds = None, set()
    for r in rows:
        where = r[path]
        if where is None or where.strip() in ("", "NA") or (formats is not None and r.format not in formats):
            continue
        if r.format not in SHEET_READERS:
            raise ValueError(f"{r.sample_id}: no reader for format {r.format}")
        kinds.add(r.format)
        x = SHEET_READERS[r.format](spark, where).drop("sample_id").withColumn("sample_id", F.lit(r.sample_id))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"the sheet lists no file of {omics}")
    if kinds == {"counts"}:
        n = out.agg(F.countDistinct("sample_id").alias("__n"))
        ok = out.groupBy("feature_id").agg(F.countDistinct("sample_id").alias("__k")).crossJoin(F.broadcast(n)).where("__k = __n").select("feature_id")
        return out.join(ok, "feature_id", "left_semi")
    return out


def motif_sets(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Known-motif results of several sets under each other with the set's name."""
    out = None
    for name, path in folders.items():
        x = known_motifs(spark, path).drop("set_id").withColumn("set_id", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out
