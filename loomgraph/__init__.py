"""Temporal, multimodal graph analytics expressed as Spark DataFrame plans."""
