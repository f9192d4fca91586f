"""Video question-answering evaluation as Spark DataFrame jobs."""

from clipquest.config import EvalConfig

__all__ = ["EvalConfig"]
