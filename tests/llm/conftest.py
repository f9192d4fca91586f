from __future__ import annotations

import random

import pytest

from clipquest.session import ship_package

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # Names that the operators use themselves.
          "text_hash string, word string, n string, node string, copies string, label string, x string")


def words(seed: int, count: int, kinds: int = 400) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice("abcdefghij") for _ in range(2 + pick.randrange(6))) + f"{pick.randrange(kinds)}"
            for _ in range(count)]


def lines(seed: int, count: int) -> str:
    return "\n".join(" ".join(words(seed * 1000 + i, 12)) for i in range(count))


SHARED = "This LINE is shared by very many documents, and it is long enough"


def edge_rows() -> list[tuple]:
    """Plain documents, near and exact copies, and every odd case the docstrings name."""
    base = words(1, 120)
    near = list(base)
    near[60] = "changed"
    far = list(base)
    far[5::10] = ["other"] * len(far[5::10])
    rows = [(i, lines(i, 4) + f"\n \t{SHARED if i % 2 else SHARED.upper()} \r\nend {i}") for i in range(1, 9)]
    rows += [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base)), (13, " ".join(far)),
             (14, " ".join(base).upper()), (None, " ".join(near)), (None, None), (None, ""), (15, None),
             (16, ""), (16, ""), (17, " \n\t "), (18, "one"), (19, "one  two"), (20, "One two"),
             (None, "alone here now yes"), (21, "a b c"), (21, "a b c"), (21, "a b c d"),
             (22, " ".join(words(9, 30_000, 50_000))), (23, "x" * 50_000),
             (24, "Ä É ß 日本語 　 \x85 \xa0 \x1c ▁ ▁▁ tail  "), (25, "  lead\n\n\nends \n"),
             (26, "it's we'll 12345 !!?? 'S ½٣"), (9_000_000_000, SHARED.lower()),
             (-5, f"{SHARED}\n{SHARED}\nkept")]
    return rows


@pytest.fixture(scope="session")
def make(spark):
    ship_package(spark)

    def build(rows):
        full = [(i, t, f"l{(i or 0) % 2}", None if i == 3 else "s", len(t or ""), "c", "c", "c", "c", "c", "c",
                 "c") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def edges(make):
    return make(edge_rows()).persist()


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 1 - i % 2) for i in range(1, 30)] + [(None, 1, 1), (5, None, None), (6, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
