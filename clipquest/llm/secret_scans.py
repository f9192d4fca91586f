"""Secrets in texts: fixed patterns, and character Markov models of random strings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquest.llm.rows import documents
from clipquest.session import materialize

# The patterns of the base kinds, in the order of the contract, and the
# group whose length counts with its least number of characters. Letters of the first
# are of either case, in ASCII.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
_ASSIGN_LEAST = 6
# A maximal run of letters is what the open pattern matches, so its length may be asked for at once.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")


@dataclass(frozen=True)
class MarkovScan:
    """How the strings beside the patterns are judged.

    Candidates are maximal stretches of letters, digits and ``+/_-`` (and ``=`` at
    their end) of ``shortest`` characters or more. One is added as a secret if, by Bayes'
    rule from the two models and the shares of the two kinds among distinct strings,
    it is random with a probability of ``sure``. ``pull`` is the weight, in
    characters, with which a context falls back on the next shorter one.
    """

    shortest: int = 16
    sure: float = 0.99
    pull: float = 8.0


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."
# 0 stands before a string's first characters.
_SYMBOLS = len(_ALPHABET) + 1
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(1, _SYMBOLS)
_FOLDS = 2


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Start, number of the kind, end, and where the secret itself begins; sorted."""
    found = []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if len(m.group(2)) >= _ASSIGN_LEAST:
                found.append((m.start(), 0, m.end(), m.start(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def _candidates(shortest: int) -> re.Pattern:
    return re.compile(r"[A-Za-z0-9+/_-]{%d,}=*" % shortest)


def scanned(docs: DataFrame, scan: MarkovScan) -> DataFrame:
    """``doc_id, text_hash, spans, strings`` of each row, from one reading of its text.

    ``spans`` are the base kinds' (``start, kind, end``). ``strings`` are all candidates:
    ``start, text``, ``labelled`` (it is a base span's secret) and ``free`` (no
    base span overlaps it).
    """
    pattern = _candidates(scan.shortest)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, strings = [], []
            for value in batch.column(2):
                text = value.as_py()
                base = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in base])
                own = []
                for _, _, end, inner in base:
                    if end - inner >= scan.shortest:
                        own.append({"start": inner, "text": text[inner:end], "labelled": True, "free": False})
                for m in pattern.finditer(text):
                    if not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                        own.append({"start": m.start(), "text": m.group(), "labelled": False, "free": True})
                strings.append(own)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN)),
                                   pa.array(strings, pa.list_(_STRING))],
                                  ["doc_id", "text_hash", "spans", "strings"])

    rows = documents(docs).select("doc_id", "text_hash", "text")
    return rows.mapInArrow(read, "doc_id bigint, text_hash bigint, spans array<struct<start: bigint, "
                                 "kind: int, end: bigint>>, strings array<struct<start: bigint, "
                                 "text: string, labelled: boolean, free: boolean>>")


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_STRING = pa.struct([("start", pa.int64()), ("text", pa.string()), ("labelled", pa.bool_()),
                     ("free", pa.bool_())])


def codes(text: str) -> np.ndarray:
    """Numbers of the characters of a candidate."""
    return _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]


def cells(text: str) -> np.ndarray:
    """One number for each character together with the two before it."""
    own = np.concatenate([[0, 0], codes(text)])
    return (own[:-2] * _SYMBOLS + own[1:-1]) * _SYMBOLS + own[2:]


def fold_of(text: str) -> int:
    """Which half of the strings a string belongs to; it is judged by the other half's models."""
    return int(cells(text).sum() // 7) % _FOLDS


def sample_counts(strings: DataFrame) -> DataFrame:
    """``fold, labelled, cell, n``: how often distinct strings hold each three characters.

    A cell of -1 counts the strings. ``strings`` are the column of :func:`scanned`, one a row.
    """
    distinct = strings.groupBy("text").agg(F.max("labelled").alias("labelled"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _SYMBOLS ** 3 + 1
        totals = np.zeros((_FOLDS * 2, size), np.int64)
        for batch in batches:
            for text, labelled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = totals[fold_of(text) * 2 + labelled]
                np.add.at(row, cells(text) + 1, 1)
                row[0] += 1
        which, cell = np.nonzero(totals)
        yield pa.record_batch([pa.array(which // 2, pa.int32()), pa.array(which % 2 == 1, pa.bool_()),
                               pa.array(cell - 1, pa.int32()), pa.array(totals[which, cell], pa.int64())],
                              ["fold", "labelled", "cell", "n"])

    counted = distinct.mapInArrow(count, "fold int, labelled boolean, cell int, n bigint")
    return counted.groupBy("fold", "labelled", "cell").agg(F.sum("n").alias("n"))


def _log_chances(counts: np.ndarray, pull: float) -> np.ndarray:
    """Log probabilities of a character after two others; shorter contexts fill in what is rare."""
    chances = np.full(_SYMBOLS, 1.0 / (_SYMBOLS - 1))
    for axes in ((0, 1), (0,), ()):
        seen = counts.sum(axis=axes) if axes else counts
        chances = (seen + pull * chances) / (seen.sum(axis=-1, keepdims=True) + pull)
    return np.log(chances)


def log_ratios(counts: DataFrame, scan: MarkovScan) -> tuple[np.ndarray, np.ndarray] | None:
    """Per fold: log ratios of a character being drawn at random or by an ordinary string, and the
    logarithm of the odds of random strings. The table that reaches the driver has a
    fixed number of cells. None where a kind of string has no sample.
    """
    table = np.zeros((_FOLDS, 2, _SYMBOLS ** 3))
    strings = np.zeros((_FOLDS, 2))
    found = counts.toArrow()
    fold, kind, cell, n = (found.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(4))
    kind, whole = kind.astype(np.int64), cell < 0
    np.add.at(strings, (fold[whole], kind[whole]), n[whole])
    np.add.at(table, (fold[~whole], kind[~whole], cell[~whole]), n[~whole])
    if not strings.sum(axis=0).all():
        return None
    table = table.reshape(_FOLDS, 2, _SYMBOLS, _SYMBOLS, _SYMBOLS)
    # A fold is judged by all other folds.
    others = table.sum(axis=0) - table
    rest = strings.sum(axis=0) - strings + 1
    ratios = [_log_chances(o[1], scan.pull) - _log_chances(o[0], scan.pull) for o in others]
    return np.array(ratios).reshape(_FOLDS, -1), np.log(rest[:, 1] / rest[:, 0])


def log_odds(text: str, ratios: np.ndarray, prior: np.ndarray) -> float:
    """Logarithm of the odds that a candidate is a random string."""
    fold = fold_of(text)
    return float(ratios[fold][cells(text)].sum() + prior[fold])


def find_secrets(docs: DataFrame, scan: MarkovScan = MarkovScan()) -> DataFrame:
    """``doc_id, text_hash, spans`` of every row: ``kind, start, end, log_odds`` by start and kind.

    ``kind`` is ``assign``, ``access`` or ``hex`` for the fixed patterns, which
    always count, and ``random`` for further strings that no such span overlaps and that the
    models take for random. Positions are code points of the whole text, ends exclusive.

    Two models of each character after the two before it are counted over all
    distinct strings of the corpus: over the secrets that the patterns find, and over all other
    candidates. Distinct, so that copies of a document weigh no more than one. The
    strings are dealt into two halves by their characters, and each is judged by the
    models of the other half, which have never seen it: an unlabelled secret can't vouch for itself.

    Texts are read once; only candidates are written and shuffled. The models
    have a fixed size whatever the corpus, and are broadcast. Where the corpus has no labelled
    or no other string there are no models and only the patterns count. A null or
    empty text has no spans, and a text of any length is scanned whole. A null ``doc_id`` keeps
    its row, repeated rows each get a row, further columns are left out, and an
    empty table gives none.
    """
    rows = materialize(scanned(docs, scan), "strings")
    strings = rows.select(F.explode("strings").alias("s")).select("s.text", "s.labelled")
    learnt = log_ratios(sample_counts(strings), scan)
    shared = docs.sparkSession.sparkContext.broadcast(learnt)
    least = float(np.log(scan.sure / (1 - scan.sure)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            out = []
            for base, strings in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                spans = [(s["start"], s["kind"], s["end"], None) for s in base]
                for s in strings if models else ():
                    if s["free"] and (odds := log_odds(s["text"], *models)) >= least:
                        spans.append((s["start"], KINDS.index("random"), s["start"] + len(s["text"]), odds))
                out.append([{"kind": KINDS[k], "start": a, "end": b, "log_odds": odds}
                            for a, k, b, odds in sorted(spans, key=lambda s: s[:3])])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(_FOUND))],
                                  ["doc_id", "text_hash", "spans"])

    return rows.mapInArrow(judge, "doc_id bigint, text_hash bigint, spans array<struct<kind: string, "
                                  "start: bigint, end: bigint, log_odds: double>>")


_FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                    ("log_odds", pa.float64())])
