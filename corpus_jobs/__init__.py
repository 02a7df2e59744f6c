"""Batch and streaming jobs for document question answering, as DataFrame operations."""
