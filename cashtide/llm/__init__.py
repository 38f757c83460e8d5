"""Operators of a training-data pipeline: token counts, deduplication, decontamination,
piece segmentation, quality rules, web archives, token files and personal data.

Nothing outside this subpackage imports it.
"""
