"""Helpers the corpus tests import by name."""

from __future__ import annotations

import importlib.util
from pathlib import Path

_SPEC = importlib.util.spec_from_file_location("corpus_fixtures", Path(__file__).with_name("conftest.py"))
_FIXTURES = importlib.util.module_from_spec(_SPEC)
_SPEC.loader.exec_module(_FIXTURES)
edge_rows, lines, words, SHARED = (getattr(_FIXTURES, n) for n in ("edge_rows", "lines", "words", "SHARED"))


def sorted_rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)
