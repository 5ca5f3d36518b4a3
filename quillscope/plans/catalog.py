"""Importing this module registers every query (Spark builder + oracle SQL)."""

from quillscope.plans import q_learn, q_prep, q_stats, q_stream, q_text  # noqa: F401
