"""Columns of the tab-separated call rows and of finished records."""

from __future__ import annotations

from pyspark.sql import types as T

#: The input's fields by position, with their kinds. The last three may be missing.
FIELDS = [
    ("sample", "text"), ("interval_name", "text"), ("contig", "text"), ("start", "unsigned"), ("end", "unsigned"),
    ("ref_allele", "text"), ("alt_allele", "text"), ("depth", "int"), ("alt_depth", "int"), ("ref_forward", "int"),
    ("ref_reverse", "int"), ("alt_forward", "int"), ("alt_reverse", "int"), ("gt", "text"), ("af", "float"),
    ("strand_bias", "pair"), ("mean_position_in_read", "float"), ("stdev_position_in_read", "float"), ("base_quality_mean", "float"),
    ("stdev_base_stdev", "float"), ("strand_bias_p_value", "float"), ("strand_bias_odds_ratio", "odds"), ("mean_mapping_quality", "float"),
    ("signal_to_noise", "float"), ("af_high_quality_bases", "float"), ("af_adjusted", "float"), ("num_bases_3_prime_shift_for_deletions", "int"),
    ("microsatellite", "float"), ("microsatellite_length", "int"), ("mean_mismatches_in_reads", "float"), ("high_quality_variant_reads", "int"),
    ("high_quality_total_reads", "int"), ("flank_seq_5_prime", "text"), ("flank_seq_3_prime", "text"), ("segment", "text"),
    ("variant_type", "text"), ("duplication_rate", "rate"), ("sv_info", "sv"), ("distance_to_crispr_site", "optional"),
]
REF_FIELD = 5
REQUIRED = 36

SV_INFO = "struct<supporting_split_reads:int,supporting_pairs:int,supporting_clusters:int>"
PAIR_BIAS = "struct<reference:string,alternate:string>"

FAI = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("length", "offset", "linebases", "linewidth")]])
