"""Learned operators: exact parts against brute force, learned parts on held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import edge_rows, sorted_rows, words
from pyspark.sql import functions as F

from clipquest.llm import features, lm_scoring, quality_classifier, quality_rules, toxicity


def held_out(i, folds):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0


def test_base_scores_and_counts(edges):
    for frequent in (100_000, 5):
        found = lm_scoring.score_documents(edges, lm_scoring.LogBilinear(frequent=frequent))
        counts = Counter()
        for i, text in edge_rows():
            if not held_out(i, 10):
                counts.update((text or "").encode().lower().split() + [b" end"])
        n, v = sum(counts.values()), len(counts)
        expected = []
        for i, text in edge_rows():
            tokens = (text or "").encode().lower().split() + [b" end"]
            base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
            expected.append((i, held_out(i, 10), len(tokens), sum(counts[t] > 0 for t in tokens), n, base))
        rows = sorted([tuple(r)[:6] for r in found.collect()], key=str)
        for got, want in zip(rows, sorted(expected, key=str), strict=True):
            assert got[:5] == want[:5] and got[5] == pytest.approx(want[5], abs=1e-6)
        assert all(r.score < 0 and math.isfinite(r.score) for r in found.collect())


def test_class_probabilities_add_up_to_one():
    config = lm_scoring.LogBilinear(own=5, endings=4, width=6)
    share = np.full(config.classes, 1 / config.classes)
    model = lm_scoring.initial(config, share)
    before = [3, 7, 0, 9, 2, 2]
    total = sum(10 ** lm_scoring.class_scores(model, np.array([*before, c]), np.array([0]))[-1]
                for c in range(config.classes))
    assert total == pytest.approx(1, abs=1e-5)


def test_the_model_learns_what_follows(make):
    pick = random.Random(3)
    pairs = {"a": "b", "b": "c", "c": "d", "d": "a"}

    def text():
        word, out = pick.choice("abcd"), []
        for _ in range(200):
            out.append(word)
            word = pairs[word] if pick.random() < 0.95 else pick.choice("abcd")
        return " ".join(out)

    docs = make([(i, text()) for i in range(300)])
    rows = lm_scoring.score_documents(docs, lm_scoring.LogBilinear(batch=256)).filter("held_out").collect()
    assert rows and sum(r.score for r in rows) > 0.7 * sum(r.base_score for r in rows)


def test_scoring_nothing(make, labels):
    assert lm_scoring.score_documents(make([])).count() == 0
    assert quality_classifier.quality_scores(make([]), labels).count() == 0
    assert toxicity.severity(make([]), labels).count() == 0
    assert quality_rules.judge_documents(make([])).count() == 0


def brute_statistics(text):
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    windows = list(zip(w, w[1:], w[2:]))
    often = {x for x, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, x in enumerate(windows) if x in often for k in range(3)}
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            doubled += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), doubled, len(inside),
            len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_statistics_and_base_rule(edges, make):
    found = quality_rules.judge_documents(edges)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted_rows(found.select(columns)) == sorted(
        [(i, *brute_statistics(t)) for i, t in edge_rows()], key=str)
    repeats = [(1, "a b c d a b c " * 9), (2, "# *<>\n# *<>\n\n \n x"), (3, "a b a b a b"), (4, "a\tb\x0bc")]
    assert sorted_rows(quality_rules.judge_documents(make(repeats)).select(columns)) == sorted(
        [(i, *brute_statistics(t)) for i, t in repeats], key=str)


def test_outliers_of_their_group(make):
    good = [(i, " ".join(words(i, 80 + i % 60))) for i in range(400)]
    odd = [(1000 + i, " ".join(f"{w}%%%" for w in words(i, 90))) for i in range(60)]
    odd += [(2000 + i, " ".join(words(i, 90)).upper().replace(" ", "!! ")) for i in range(60)]
    rows = {r.doc_id: r.kept for r in quality_rules.judge_documents(make(good + odd)).collect()}
    assert all(rows[i] for i, _ in good)
    assert not any(rows[i] for i, _ in odd)


def concentrated(x, prior, rules):
    """Centre and covariance of the lowest determinant, by whole sorts in numpy."""
    d, floor = x.shape[1], np.diag(np.square(rules.floors))
    rank = lambda v, q: np.sort(v, axis=0)[max(0, int(np.ceil(q * len(v))) - 1)]
    center = rank(x, 0.5)
    spread = np.maximum((rank(x, 0.75) - rank(x, 0.25)) / 1.349, rules.floors)
    z, best = (x - center) / spread, None
    length = np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)
    for shape in (np.zeros_like(z), np.tanh(z), z / length):
        second = shape.T @ shape
        scale = np.sqrt(np.maximum(np.diag(second), 1e-12))
        cover = second / np.outer(scale, scale)
        np.fill_diagonal(cover, 1)
        cover, mean, last = cover * np.outer(spread, spread) + floor * 1e-3, center, np.inf
        for _ in range(rules.steps):
            off = x - mean
            distance = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cover), off)
            near = x[distance <= rank(distance, rules.keep)]
            n, sums, second = len(near), near.sum(0), near.T @ near
            if prior:
                n, sums = n + rules.prior, sums + rules.prior * prior[0]
                second = second + rules.prior * (prior[1] + np.outer(prior[0], prior[0]))
            mean = sums / n
            raw = second / n - np.outer(mean, mean)
            cover = raw + floor
            now = np.linalg.slogdet(cover)[1]
            assert now <= last + 1e-9
            if last - now < 1e-12:
                break
            last = now
        if best is None or now < best[0] - 1e-9:
            best = now, mean, raw
    return best[1:]


def test_robust_distances_match_numpy(spark):
    random_ = np.random.default_rng(2)
    sizes = {("a", "one"): 1, ("a", "s"): 199, ("a", "t"): 200, ("a", "u"): 201, ("b", "s"): 40, ("b", "v"): 250}
    x = {g: random_.normal(0, 1, (n, quality_rules.STATISTICS)) * (1 + i) + i
         for i, (g, n) in enumerate(sizes.items())}
    x["b", "v"][:50] += 40
    rows = spark.createDataFrame([(*g, v.tolist()) for g in x for v in x[g]],
                                 "lang string, source string, x array<double>")
    # Quantiles of this accuracy are exact here, as numpy's are.
    rules = quality_rules.OutlierRules(settled=1e-9, ranks=100_000)
    got = quality_rules.robust_outliers(rows.repartition(3), rules).collect()
    whole = concentrated(np.concatenate(list(x.values())), None, rules)
    by_lang = {l: concentrated(np.concatenate([v for g, v in x.items() if g[0] == l]), whole, rules) for l in "ab"}
    for g in x:
        center, cover = concentrated(x[g], by_lang[g[0]], rules)
        inverse = np.linalg.inv(rules.consistency * cover + np.diag(np.square(rules.floors)))
        found = np.array([(*r.x, r.distance) for r in got if (r.lang, r.source) == g])
        off = found[:, :-1] - center
        assert len(found) == sizes[g]
        assert np.allclose(found[:, -1], np.einsum("ij,jk,ik->i", off, inverse, off), rtol=1e-9)
    shifted = [r.distance for r in got if r.source == "v" and r.x[0] > 25]
    assert len(shifted) == 50 and min(shifted) > rules.cut


def test_cut_and_consistency():
    rules = quality_rules.OutlierRules(beyond=0.001)
    assert abs(rules.cut - 26.1245) < 1e-3
    draws = np.random.default_rng(1).normal(0, 1, (200_000, quality_rules.STATISTICS))
    lengths = (draws ** 2).sum(1)
    near = draws[lengths <= np.quantile(lengths, rules.keep)]
    assert abs(near.var() * rules.consistency - 1) < 0.01


def test_verdicts_do_not_jump_with_a_groups_size(spark):
    random_ = np.random.default_rng(4)
    base = random_.normal(0, 1, (600, quality_rules.STATISTICS))
    small, probe = random_.normal(0.5, 1, (201, quality_rules.STATISTICS)), [3.0] * quality_rules.STATISTICS
    found = {}
    for n in (1, 2, 199, 200, 201):
        rows = [("l", "large", v.tolist()) for v in base] + [("l", "small", v.tolist()) for v in small[:n - 1]]
        table = spark.createDataFrame([*rows, ("l", "small", probe)], "lang string, source string, x array<double>")
        judged = quality_rules.robust_outliers(table, quality_rules.OutlierRules())
        found[n] = judged.filter(judged.x[0] == 3.0).first().distance
    assert abs(found[200] / found[199] - 1) < 0.05 and abs(found[201] / found[200] - 1) < 0.05
    assert abs(found[2] / found[1] - 1) < 0.05


@pytest.fixture(scope="module")
def marked(spark, make):
    """Good texts and three kinds of bad ones, half of them toxic, with labels for all but a few."""
    pick, rows, labels_ = random.Random(5), [], []
    for i in range(600):
        text, bad, toxic = words(i, 60), i % 5 == 0, i % 3 == 0
        if bad:
            text = [[w.upper() + "!!" for w in text], [w + "%%%" for w in text], [text[0]] * 60][i // 5 % 3]
        if toxic:
            for _ in range(1 + i % 4):
                text[pick.randrange(60)] = pick.choice(["scum", "idiot.", "Loser", "vermin,"])
        rows.append((i, " ".join(text)))
        labels_.append((i, int(not bad), int(toxic)))
    table = spark.createDataFrame(labels_, "doc_id long, quality int, toxic int")
    return make(rows), table, {i: (q, t) for i, q, t in labels_}


def test_quality_of_held_out_texts(marked):
    docs, labels_, truth = marked
    config = quality_classifier.QualityModel(sample=400)
    rows = quality_classifier.quality_scores(docs, labels_, config).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held_out(r.doc_id, 5) and r.predicted == int(r.score >= 0.3) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id][0] for r in tested) >= 0.97 * len(tested)
    again = quality_classifier.quality_scores(docs.repartition(7), labels_, config).collect()
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)


def test_quality_learns_from_as_many_rows_as_toxicity():
    assert quality_classifier.QualityModel().sample == 20_000


def test_dual_coordinate_descent_reaches_the_optimum():
    random_ = np.random.default_rng(0)
    rows = [np.flatnonzero(random_.random(30) < 0.3) for _ in range(80)]
    signs = np.where(random_.random(80) < 0.5, 1.0, -1.0)
    ratio, config = random_.normal(0, 1, 30), quality_classifier.QualityModel(rounds=400)
    weights, bias = quality_classifier.dual_coordinate_descent(rows, signs, ratio, config)
    cost = config.cost * 0.5 / np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / max(np.linalg.norm(ratio[r]), 1e-12)
    x[:, 30] = 1

    def objective(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - signs * (x @ w))).sum()

    best = np.append(weights, bias)
    for _ in range(200):
        assert objective(best) <= objective(best + random_.normal(0, 0.02, 31)) + 1e-4


def test_severity_of_held_out_texts(marked):
    docs, labels_, truth = marked
    rows = toxicity.severity(docs, labels_).collect()
    tested = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id][1] for r in tested) >= 0.95 * len(tested)
    mean = {t: np.mean([r.expected_severity for r in tested if truth[r.doc_id][1] == t]) for t in (0, 1)}
    assert mean[1] > mean[0] + 0.7
    assert all(0 <= r.expected_severity <= 2 and 0 <= r.score <= 1 and r.grade in (0, 1, 2) for r in rows)


def test_given_grades_and_ordered_thresholds(spark, make):
    rows, grades = [], []
    for i in range(500):
        text, grade = words(i, 40), i % 3
        text[:2 * grade] = ["scum", "vermin", "idiot", "loser"][:2 * grade]
        rows.append((i, " ".join(text)))
        grades.append((i, grade))
    labels_ = spark.createDataFrame(grades, "doc_id long, grade int")
    found = toxicity.severity(make(rows), labels_, label="grade").filter("held_out").collect()
    assert sum(r.grade == r.doc_id % 3 for r in found) >= 0.9 * len(found)
    chances = toxicity.grade_chances(np.array([-1.0, 0.0, 3.0]), np.array([0.5, 2.0]))
    assert np.allclose(chances.sum(1), 1) and (chances > 0).all()


def test_odd_rows_and_labels(edges, labels, spark):
    for operator in (quality_classifier.quality_scores, toxicity.severity):
        ids = sorted(str(r.doc_id) for r in operator(edges, labels).collect())
        assert ids == sorted(str(i) for i, _ in edge_rows())
    one_class = spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    nothing = labels.filter("false")
    for table, score in ((one_class, None), (nothing, 0.5)):
        scores = {r.score for r in quality_classifier.quality_scores(edges, table).collect()}
        assert len(scores) == 1 and (score is None or scores == {score})
        assert toxicity.severity(edges, table).count() == len(edge_rows())


def test_class_scores_hold_one_block_at_a_time():
    import tracemalloc

    config, random = lm_scoring.LogBilinear(), np.random.default_rng(3)
    share = random.dirichlet(np.ones(config.classes))
    p = lm_scoring.initial(config, share)
    codes, starts = random.integers(0, config.classes, 20_000), np.arange(0, 20_000, 70)
    tracemalloc.start()
    lm_scoring.class_scores(p, codes, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    before = lm_scoring.contexts(codes, starts, config.context)
    for scale in (1, 200):  # with 200, some rows lie far below their block's highest score
        p["next"] = p["next"] * scale
        exact = {k: v.astype("f8") for k, v in p.items()}
        scores = sum(exact["seen"][b] * w for b, w in zip(before, exact["weigh"])) @ exact["next"].T + exact["bias"]
        top = scores.max(1, keepdims=True)
        expected = (scores - top - np.log(np.exp(scores - top).sum(1, keepdims=True))) / np.log(10)
        found = lm_scoring.class_scores(p, codes, starts)
        assert np.allclose(found, expected[np.arange(len(codes)), codes], rtol=1e-3, atol=1e-3)


def test_fits_read_features_from_arrow_memory(make, labels):
    """Copies of each row's features left the worker of a fit with some 100 MB that it could not give back."""
    sample = features.labelled_sample(make([(i, f"text {i}") for i in range(1, 30)] + [(30, "")]), labels,
                                      F.col("quality"), F.lit(True), 100)

    def own(data, offsets):
        return [np.arange(b - a) for a, b in zip(offsets[:-1], offsets[1:])]

    def fit(rows, known):
        bases = {type(r.base).__name__ for r in rows}
        return repr((sorted(bases), len(rows), sum(len(r) for r in rows))).encode()

    size = sum(len(f"text {i}") for i in range(1, 30))
    assert features.fitted(sample, own, fit, b"") == repr((["Buffer"], 29, size)).encode()


def test_sums_by_index_are_those_of_one_row_after_the_other():
    random = np.random.default_rng(4)
    index, values = random.integers(0, 7, 500), random.normal(0, 1, (500, 3)).astype("f4")
    expected = np.zeros((9, 3))
    for i, row in zip(index, values):
        expected[i] += row
    assert (lm_scoring._added(index, values.T.astype("f8"), 9) == expected).all()


def test_a_batch_of_texts_becomes_rows_of_sums_and_of_other_words():
    config = lm_scoring.LogBilinear(own=1, endings=1)
    words = lm_scoring.Vocabulary(config, {b"a": 0, b"b": 1}, np.array([1, 2, 0]), np.array([-1.0, -2.0]),
                                  np.zeros(2), {b"xy": 2}, np.full(4, 0.25))
    texts = pa.array(["A b xy Zz xy", "", "b"])
    codes, starts, numbers, others = words.read(texts)
    assert codes.tolist() == [1, 2, 2, 3, 2, 0, 0, 2, 0] and starts.tolist() == [0, 6, 7]
    assert [n.tolist() for n in numbers] == [[0, 1], [], [1]] and others == [{b"xy": 2, b"zz": 1}, {}, {}]
    plain = words.read(texts, counted=False)
    assert plain[0].tolist() == codes.tolist() and plain[2:] == ([], [])
    part = pa.record_batch([pa.array([5, None, -3]), pa.array([1, -2, 3]), texts], ["doc_id", "text_hash", "text"])
    rows = words.rows(part, others, [3, 1, 2], [-1.5, -2.5, -3.5], [-4.0, -5.0, -6.0], np.array([6, 1, 2]))
    mark = [b"\xff" + i.to_bytes(8, "little", signed=True) for i in (1, -2, 3)]
    assert [tuple(r.values()) for r in rows.to_pylist()] == [
        (5, 1, mark[0], 3, None, -1.5, -4.0, 6), (5, 1, b"xy", 2, 2, None, None, None),
        (5, 1, b"zz", 1, 3, None, None, None), (None, -2, mark[1], 1, None, -2.5, -5.0, 1),
        (-3, 3, mark[2], 2, None, -3.5, -6.0, 2)]
