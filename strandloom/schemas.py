"""Canonical schemas. Sentinels (-1, '*') stay as the formats have them."""

#: Where a line stands: sorts by file, then block, then row.
LINE_NO = "struct<file:string,block:bigint,row:bigint>"
SIGNALS = "read_id string, signal array<float>, cal_offset double, cal_scale double"
CIGAR = "array<struct<op:int,len:int>>"
READS = (
    "query_name string, parent_id string, flag int, reference_name string, reference_start bigint, mapping_quality int, "
    f"cigar {CIGAR}, next_reference_name string, next_reference_start bigint, template_length int, seq string, qual string, "
    "is_reverse boolean, ts int, sp int, mv array<int>, sm double, sd double, mm string, ml array<int>, "
    "ns array<int>, nl array<int>, tags_extra map<string,string>"
)
CALLS = (
    "chrom string, ref_pos bigint, strand string, label int, read_id string, read_pos int, methy_type string, "
    "prob_unmethylated double, prob_methylated double, prediction double, kmer string, line_no " + LINE_NO
)
CONTIGS = "contig string, seq string"
BED = (
    "chrom string, start bigint, end bigint, name string, score string, strand string, thick_start bigint, "
    "thick_end bigint, rgb string, coverage int, percentage double, line_no " + LINE_NO
)
