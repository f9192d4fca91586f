"""Line deduplication and the Jaccard join against brute force."""

import random
from collections import defaultdict

import numpy as np
from conftest_llm import edge_rows, sorted_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from clipquest.llm import jaccard_join, line_dedup

SPACES = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows, min_chars, min_docs):
    low = -(1 << 63)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(SPACES))
            if len(key) >= min_chars:
                holders[key].add(low if i is None else i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = []
        for line in all_lines:
            docs = holders.get(lowered(line.strip(SPACES)), ())
            if len(docs) < min_docs or max(docs) == (low if i is None else i):
                kept.append(line)
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def test_shared_lines(edges, make):
    for least in (5, 2):
        found = line_dedup.drop_shared_lines(edges, min_docs=least)
        expected = brute_lines(edge_rows(), 40, least)
        assert sorted_rows(found) == expected
        assert any(r[3] for r in expected)
    short = line_dedup.drop_shared_lines(edges, min_chars=1, min_docs=2)
    assert sorted_rows(short) == brute_lines(edge_rows(), 1, 2)
    assert line_dedup.drop_shared_lines(make([])).count() == 0


def test_bitmaps_are_runs_of_kept_and_dropped(spark, make):
    long = "a long line that many hold, of more than forty characters"
    rows = [(i, f"x\n{long}\n{long}\ny\n{long}\nz") for i in range(6)]
    bits = line_dedup.keep_bitmaps(make(rows)).orderBy("doc").collect()
    assert [r.doc for r in bits] == [0, 1, 2, 3, 4]
    assert all(r.runs == [1, 2, 1, 1] for r in bits)


def test_many_lines(make):
    """Work grows with the lines: the square of these would take hours."""
    rows = [(d, "\n".join(f"this line number {i} is held by every document of these" if i % 2 else f"own {d} {i}"
                          for i in range(60_000))) for d in range(6)]
    found = {r.doc_id: r for r in line_dedup.drop_shared_lines(make(rows)).collect()}
    assert all((found[d].n_lines, found[d].n_dropped) == (60_000, 30_000) for d in range(5))
    assert found[4].text == "\n".join(f"own 4 {i}" for i in range(0, 60_000, 2))
    assert found[5].text == rows[5][1]


def test_named_columns_are_kept(edges):
    found = line_dedup.drop_shared_lines(edges, "lang", "n")
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped", "lang", "n"]
    assert found.filter("n = 'c'").count() == len(edge_rows())
    more = edges.withColumnsRenamed({"word": "doc", "n": "runs", "node": "_lines", "label": "ends", "x": "lines"})
    found = line_dedup.drop_shared_lines(more, "doc", "runs", "_lines", "ends", "lines")
    assert found.columns[4:] == ["doc", "runs", "_lines", "ends", "lines"]
    assert found.filter("runs = 'c' and ends = 'c' and lines = 'c'").count() == len(edge_rows())


def shingle_set(text, n=3):
    w = [x for x in "".join(" " if c in SPACES else c for c in lowered(text or "")).split(" ") if x]
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=90, n=3):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[find(i)] = min(lowest.get(find(i), doc), doc)
    return sorted([(doc, len(s), lowest.get(find(i)) if s else doc) for i, ((doc, _), s)
                   in enumerate(zip(rows, sets))], key=str)


def components_of(docs, **settings_):
    return sorted_rows(jaccard_join.similar_documents(
        docs, jaccard_join.Similarity(**settings_)).select("doc_id", "n_shingles", "component_id"))


def test_edges(edges, make):
    expected = brute_components(edge_rows())
    assert components_of(edges) == expected
    assert sum(1 for d, _, c in expected if d is not None and c != d) >= 3
    assert components_of(make([])) == []


def family(seed, members, size, edits):
    """Texts that differ from one text in a few words each."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(10**6)}" for _ in range(size)]
    out = []
    for m in range(members):
        text = list(base)
        for _ in range(pick.randrange(edits + 1)):
            text[pick.randrange(size)] = f"e{m}x{pick.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def test_families_across_blocks_and_chains(make):
    texts = [*family(1, 60, 150, 5), *family(2, 30, 40, 1), *family(3, 12, 400, 14), *family(4, 10, 12, 1)]
    rows = list(enumerate(texts))
    expected = brute_components(rows)
    docs = make(rows)
    for settings_ in ({}, {"block": 900}, {"members": 4}, {"block": 2000, "members": 2}):
        assert components_of(docs, **settings_) == expected
    assert len({c for _, _, c in expected}) < len(rows)
    # Other shapes of PartEnum find the same.
    assert components_of(docs, parts=1, apart=0) == components_of(docs, parts=4, apart=2) == expected
    assert components_of(docs, words=5, percent=80) == brute_components(rows, 80, 5)


def test_a_passage_that_many_documents_share(make):
    passage = " ".join(f"p{i}" for i in range(60))
    pick = random.Random(5)
    rows = [(i, " ".join(f"w{pick.randrange(10**6)}" for _ in range(20 + i % 7)) + " " + passage) for i in range(150)]
    rows += [(1000 + i, rows[i][1].replace("p30 ", f"x{i} ")) for i in range(0, 150, 5)]
    docs = make(rows)
    for settings_ in ({}, {"members": 16, "block": 3000}):
        assert components_of(docs, percent=80, **settings_) == brute_components(rows, 80)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.integers(0, 300), st.integers(0, 300), st.integers(0, 10**6))
def test_sketches_never_differ_in_more_than_the_sets(common, left, right, seed):
    values = np.random.default_rng(seed).integers(0, 1 << 62, common + left + right).astype(np.uint64)
    a, b = np.unique(values[:common + left]), np.unique(np.concatenate([values[:common], values[common + left:]]))
    if not len(a) or not len(b):
        return
    rows = [(i, len(x), jaccard_join.sketch(x)) for i, x in enumerate((a, b))]
    same = len(np.intersect1d(a, b))
    for copies in (1, 10):  # few sets are compared one by one, many at once
        several = rows + [(2 + i, len(b), rows[1][2]) for i in range(copies)]
        found = jaccard_join._close(several, 80, jaccard_join._Forest())
        if 100 * same >= 80 * (len(a) + len(b) - same):
            assert any(0 in pair for pair in found)


def test_keep_one_each(edges, make):
    kept = jaccard_join.keep_one_each(edges)
    assert kept.columns == edges.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    texts = [t for _, _, t in ids]
    assert (False, 10, " ".join(edge_rows()[8][1].split())) in ids
    assert not {11, 12, 14} & {i for none, i, _ in ids if not none}
    assert texts.count("a b c") == 1 and texts.count("") == 5  # wordless rows all stay
    assert "alone here now yes" in texts


def test_clashing_names_stay(edges):
    more = edges.withColumnsRenamed({"word": "_doc", "n": "_TEXT", "node": "__doc", "label": "group"})
    for kept in (jaccard_join.keep_one_each(more), jaccard_join.keep_one_each(edges)):
        assert kept.filter("doc_id = 10").count() == 1
    assert jaccard_join.keep_one_each(more).columns == more.columns


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6),
       st.sampled_from([(1, 0), (2, 1), (3, 1), (4, 2)]))
def test_linked_sets_share_a_signature(common, left, right, seed, shape):
    similarity = jaccard_join.Similarity(parts=shape[0], apart=shape[1])
    random_ = np.random.default_rng(seed)
    values = np.unique(random_.integers(0, 1 << 63, common + left + right).astype(np.uint64) * np.uint64(2))
    random_.shuffle(values)
    a = np.sort(np.concatenate([values[:common], values[common:common + left]]))
    b = np.sort(np.concatenate([values[:common], values[common + left:]]))
    signatures = jaccard_join.Signatures(similarity)
    if 100 * common >= 90 * len(values):
        assert len(np.intersect1d(signatures.of(a), signatures.of(b)))
