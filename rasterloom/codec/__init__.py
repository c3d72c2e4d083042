"""Byte kernels: entropy coders and whole-image codecs that run inside Arrow batches."""
