"""Readers and writers: VCF text, BCF, the Parquet store, group files."""
