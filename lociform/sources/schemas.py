"""Schemas of the tables that readers give and operators take."""

INTERVALS = "chr string, start bigint, stop bigint, name string, score double, strand string"
NARROW_PEAKS = INTERVALS + ", signal_value double, pvalue double, qvalue double, peak_summit bigint"
BLOCKS = "peak_id string, chr string, start bigint, stop bigint, total_signal double, max_signal double"
READ_PAIRS = "chr1 string, start1 bigint, stop1 bigint, chr2 string, start2 bigint, stop2 bigint, name string, score double, strand1 string, strand2 string"
COVERAGE = "chr string, start bigint, stop bigint, score double"
VALUES = "feature_id string, sample_id string, value double"
QUANT = "Name string, Length double, EffectiveLength double, TPM double, NumReads double"
EDITING = "Region string, Position bigint, Reference string, Strand int, `Coverage-q30` bigint, MeanQ double, `BaseCount[A,C,G,T]` string, AllSubs string, Frequency double"
ALIGNMENTS = "qname string, flag int, chr string, pos bigint, mapq int, cigar string, seq string, qual string"
