"""Modules that have queries."""

MODULES = ("op01_sstable", "op02_langid", "op03_jaccard", "op04_ann", "op05_decontaminate", "op06_warc", "op07_substrings", "op08_toxicity", "op09_packing", "op10_lines")
