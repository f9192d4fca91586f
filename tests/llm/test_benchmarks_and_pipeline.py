"""Decontamination and the whole pipeline against brute force."""

import hashlib
import random
import struct
from dataclasses import replace
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import SHARED, edge_rows, lines, words
from test_lines_and_copies import brute_components, brute_lines

import corpus_pipeline
from clipquest.llm import bpe, decontamination, quality_classifier
from clipquest.llm.queries import BYTE_RANKS, public_file


def item(seed, size):
    return words(10_000 + seed, size, 10**6)


ITEMS = [(i, " ".join(item(i, 15 + 9 * i))) for i in range(6)] + [
    (10, " ".join(item(10, 9))), (11, " ".join(item(11, 5))), (12, ""), (13, None), (14, "x y z " * 20),
    (None, " ".join(item(15, 30))), (16, " ".join(item(3, 42)))]


@pytest.fixture(scope="module")
def benchmark_table(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in ITEMS],
                                 "item_id long, text string, tokens string, doc_id string").drop("doc_id")


def with_passage(seed, passage):
    text = words(seed, 70)
    return " ".join([*text[:30], *passage, *text[30:]])


def substituted(passage, every):
    return [w if i % every else "other" for i, w in enumerate(passage, 1)]


FOUND = [
    (100, with_passage(1, item(0, 15)), {0: (30, 15, 15)}),
    (101, with_passage(2, [w.upper() for w in item(2, 33)]), {2: (30, 33, 33)}),
    (102, with_passage(3, substituted(item(4, 51), 9)), {4: (30, 51, 46)}),
    (103, with_passage(4, item(1, 24)[4:20]), {1: (30, 16, 16)}),
    (104, with_passage(5, item(10, 9)), {10: (30, 9, 9)}),
    (105, with_passage(6, item(0, 15) + ["gap"] * 200 + item(5, 60)), {0: (30, 15, 15), 5: (245, 60, 60)}),
    (106, " ".join(item(5, 60)), {5: (0, 60, 60)}),
    (107, with_passage(7, item(3, 42)), {3: (30, 42, 42), 16: (30, 42, 42)}),
    (108, with_passage(8, ["x", "y", "z"] * 20), {14: (30, 60, 60)}),
    (109, with_passage(9, item(2, 33)[:12]), {}),       # too short a piece
    (110, with_passage(10, substituted(item(5, 60), 3)), {}),  # too many differ
    (111, with_passage(11, item(11, 5)), {}),           # an item without seeds
    (112, with_passage(12, words(77, 60)), {}),
    (113, with_passage(13, substituted(item(5, 60), 5)), {5: (30, 59, 48)}),
    (114, with_passage(14, substituted(item(4, 51), 6)), {4: (30, 51, 43)}),
]


def test_passages(make, benchmark_table):
    docs = make([*[(i, t) for i, t, _ in FOUND], (None, FOUND[0][1]), (100, FOUND[0][1]), *edge_rows()])
    for bits in (1 << 24, 1 << 15):
        config = decontamination.SpacedSeeds(filter_bits=bits)
        rows = decontamination.find_passages(docs, benchmark_table, config).collect()
        got = {}
        for r in rows:
            got.setdefault(r.doc_id, {})[r.item_id] = (r.start, r.overlap, r.equal)
        assert got.pop(None) == {0: (30, 15, 15)}
        assert got == {i: f for i, _, f in FOUND if f}
        assert len(rows) == sum(len(f) for _, _, f in FOUND) + 1
    kept = decontamination.drop_contaminated(docs, benchmark_table)
    assert kept.columns == docs.columns
    renamed = docs.withColumnsRenamed({"word": "_doc", "n": "_text"})
    assert decontamination.drop_contaminated(renamed, benchmark_table).columns == renamed.columns
    left = [r.doc_id for r in kept.collect()]
    assert {i for i in left if i and 100 <= i < 115} == {109, 110, 111, 112}
    assert len(left) == docs.count() - sum(bool(f) for _, _, f in FOUND) - 2


def test_nothing_to_find(make, benchmark_table):
    docs = make(edge_rows())
    assert decontamination.find_passages(docs, benchmark_table.filter("false")).count() == 0
    assert decontamination.find_passages(make([]), benchmark_table).count() == 0
    assert decontamination.drop_contaminated(docs, benchmark_table.filter("false")).count() == len(edge_rows())


def test_long_passages_with_repeats(make, spark):
    long = item(50, 900)
    table = spark.createDataFrame([(1, " ".join(long + long[:100]))], "item_id long, text string")
    rows = decontamination.find_passages(make([(1, with_passage(1, long))]), table).collect()
    assert [(r.start, r.overlap) for r in rows] == [(30, 900)]


def unseeded(masks, size, replaced):
    """Placements of replaced tokens where no mask fits."""
    left = []
    for gone in replaced:
        kept = "".join("0" if i in gone else "1" for i in range(size))
        if not any(all(k == "1" for k, m in zip(kept[at:], mask) if m == "1")
                   for mask in masks for at in range(size - len(mask) + 1)):
            left.append(gone)
    return left


def test_masks_hit_every_placement():
    config = decontamination.SpacedSeeds()
    # A longer passage can be cut into these lengths; one of them has enough equal tokens.
    for size in range(13, 25):
        assert not unseeded(config.masks, size, combinations(range(size), size // 5))
    assert not unseeded(config.masks, 25, combinations(range(25), 5))
    # Of a whole item the first and the last token are equal.
    for size in range(5, 13):
        masks = [config.every[n] for n in replace(config, shortest=1).numbers(size)]
        assert not unseeded(masks, size, combinations(range(1, size - 1), size // 5))


def test_every_placement_is_found(make, spark):
    rows, expected = [], set()
    for number, size in enumerate((13, 15, 10, 6)):
        for gone in combinations(range(1, size - 1), size // 5):
            doc = len(rows)
            passage = ["other" if i in gone else w for i, w in enumerate(item(70 + number, size))]
            rows.append((doc, with_passage(doc, passage)))
            expected.add((doc, number, 30, size, size - len(gone)))
    table = spark.createDataFrame([(n, " ".join(item(70 + n, size))) for n, size in enumerate((13, 15, 10, 6))]
                                  + [(9, "very short one")], "item_id long, text string")
    docs = make([*rows, (9000, "some Very short ONE here")])
    found = decontamination.find_passages(docs, table).drop("text_hash").collect()
    assert {tuple(r) for r in found} == expected
    config = decontamination.SpacedSeeds(shortest=1)
    found = decontamination.find_passages(docs, table, config).drop("text_hash").collect()
    assert {tuple(r) for r in found} == expected | {(9000, 9, 1, 3, 3)}


def test_repeats_in_items_hide_no_passage(make, spark):
    """Items A B A C; documents hold A C with two tokens replaced, in every placement."""
    a, b, c = item(200, 9), item(201, 20), item(202, 4)
    table = spark.createDataFrame([(1, " ".join(a + b + a + c))], "item_id long, text string")
    rows = []
    for gone in combinations(range(1, 12), 2):
        passage = ["other" if i in gone else w for i, w in enumerate(a + c)]
        rows.append((len(rows), with_passage(len(rows), passage)))
    found = decontamination.find_passages(make(rows), table).collect()
    assert {(r.doc_id, r.start, r.overlap, r.equal) for r in found} == {(i, 30, 13, 11) for i, _ in rows}


def brute_passages(docs, items, shortest=6):
    """The longest overlap of each document and item over all alignments."""
    out = set()
    for number, text in docs:
        tokens = text.lower().split()
        for name, passage in items:
            wanted, best = passage.lower().split(), None
            if len(wanted) < shortest:
                continue
            for shift in range(1 - len(wanted), len(tokens)):
                low, high = max(0, shift), min(len(tokens), shift + len(wanted))
                equal = np.array([tokens[i] == wanted[i - shift] for i in range(low, high)], bool)
                begin, size, same = decontamination.best_overlap(equal, 80)
                if size >= min(13, len(wanted)):
                    best = max(best or (0,), (size, same, -(low + begin)))
            if best:
                out.add((number, name, -best[2], *best[:2]))
    return out


def test_against_all_alignments(make, spark):
    """Random items with many repeats, short ones too, and documents made of their pieces."""
    pick = random.Random(31)
    items = []
    for i in range(30):
        kinds = words(400 + i, pick.choice([2, 4, 9, 30]), 10**6)
        items.append((i, " ".join(pick.choice(kinds) for _ in range(pick.choice([6, 7, 9, 12, 13, 14, 20, 35])))))
    docs = []
    for i in range(350):
        name, passage = pick.choice(items)
        piece = passage.split()[pick.randrange(4):] * pick.choice([1, 1, 2])
        piece = [w if pick.random() > pick.choice([0, 0.1, 0.25]) else "other" for w in piece][:50]
        docs.append((i, " ".join(words(i, 5) + piece + words(i + 500, 3))))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_passages(make(docs), table).drop("text_hash").collect()
    expected = brute_passages(docs, items)
    assert {tuple(r) for r in found} == expected and len(expected) > 100


def test_longest_overlap():
    late = [i not in (4, 8) for i in range(13)]
    assert decontamination.best_overlap(np.array([True] * 12 + [False] * 30 + late), 80) == (42, 13, 11)
    random_ = np.random.default_rng(3)
    for _ in range(300):
        equal = random_.random(random_.integers(0, 40)) < random_.random()
        lengths = [b - a for a, b in combinations(range(len(equal) + 1), 2)
                   if equal[a] and equal[b - 1] and 100 * equal[a:b].sum() >= 80 * (b - a)]
        start, size, same = decontamination.best_overlap(equal, 80)
        assert size == max(lengths, default=0)
        assert same == equal[start:start + size].sum() and 100 * same >= 80 * size


@pytest.fixture(scope="module")
def folder(spark, make, benchmark_table, tmp_path_factory):
    """A small set of tables with something for every stage."""
    where = str(tmp_path_factory.mktemp("tables"))
    pick = random.Random(8)
    rows = [(i, lines(500 + i, 5) + f"\n{SHARED}") for i in range(60)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in words(i, 60))) for i in range(60)]
    for i in range(10):
        text = words(900 + i, 150)
        copy = list(text)
        copy[pick.randrange(150)] = "edit"
        rows += [(300 + i, " ".join(text)), (400 + i, " ".join(copy)), (400 + i, " ".join(copy))]
    rows += [(1000 + i, t) for i, t, _ in FOUND]
    make([*rows, (None, None), (None, "some words without an id"), (700, "")]).write.parquet(
        f"{where}/documents.parquet")
    benchmark_table.write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 260), 0) for i, _ in rows if i % 4],
                          "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "good_texts", "own_lines", "one_of_each", "without_benchmarks", "token_ids"]
    scores = quality_classifier.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rejected = {(r.doc_id, r.text_hash) for r in scores.filter("predicted = 0").collect()}
    assert len(rejected) >= 55
    hashed = docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as h").collect()
    rows = [(r.doc_id, r.text) for r in hashed if (r.doc_id, r.h) not in rejected]
    assert {i for i, _ in rows if i is not None and i < 60} == set(range(60))  # clean ones stay
    rows = [(i, t) for i, t, _, _ in brute_lines(rows, 40, 5)]
    assert sum(SHARED in t for _, t in rows) == 1

    kept, seen = [], set()
    component = {}
    for (i, t), (_, _, c) in zip(sorted(rows, key=lambda r: (str(r[0]), r[1])), brute_in_order(rows)):
        component[(i, t)] = c
    for i, t in rows:
        if not t.split() or (component[(i, t)] == i and (i, t) not in seen):
            seen.add((i, t))
            kept.append((i, t))
    assert not [i for i, _ in kept if i is not None and 400 <= i < 410]
    leaks = {1000 + i for i, _, f in FOUND if f}
    kept = [(i, t) for i, t in kept if i not in leaks]

    library = bpe._encoding(public_file(BYTE_RANKS), public_tokenizers.PATTERN)
    expected = []
    for i, t in kept:
        ids = library.encode_ordinary(t)
        expected.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                         hashlib.sha256(t.encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def brute_in_order(rows):
    """Components of rows in the order of their id and text."""
    out = []
    ordered = sorted(rows, key=lambda r: (str(r[0]), r[1]))
    by_row = {}
    for n, row in enumerate(ordered):
        by_row.setdefault(n, row)
    numbered = [(n, t) for n, (_, t) in by_row.items()]
    lowest = {n: c for n, _, c in brute_components(numbered, 80, 5)}
    groups = {}
    for n, c in lowest.items():
        if ordered[n][0] is not None:
            groups[c] = min(groups.get(c, ordered[n][0]), ordered[n][0])
    for n, (i, _) in by_row.items():
        out.append((i, None, groups.get(lowest[n], i)))
    return out


def brute_representatives(rows, n, percent):
    """Lowest ids of the components of rows whose n-word shingles link."""
    sets = [set(zip(*(t.lower().split()[i:] for i in range(n)))) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    return {min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group}


def test_near_copies_of_the_pipeline(spark, make):
    rows = []
    for i in range(12):
        text = words(3000 + i, 200)
        copy = list(text)
        for place in range(20, 200, 200 // (1 + i))[:1 + i]:
            copy[place] = "edit"
        rows += [(10 * i, " ".join(text)), (10 * i + 1, " ".join(copy))]
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, make(rows), "").collect()}
    assert kept == brute_representatives(rows, 5, 80)
    assert len(kept) < len(brute_representatives(rows, 3, 90))


def test_empty_tables(spark, folder, make, tmp_path):
    where = str(tmp_path)
    make([]).write.parquet(f"{where}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{where}/{name}.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0


def test_token_ids_have_one_python_step_a_task(spark, make):
    """Two steps in one task are two workers, and executors keep the memory of both when they are idle."""
    plan = corpus_pipeline.token_ids(spark, make([(1, "one two"), (2, None)]), "")._jdf.queryExecution(
        ).executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
