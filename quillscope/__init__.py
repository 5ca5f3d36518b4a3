"""quillscope: Spark-native text-forensics analytics.

Stylometric features as native DataFrame columns, class-separation statistics,
multi-task training tables, distributed scoring/evaluation and streaming verdicts.
"""

__all__ = ["session"]
