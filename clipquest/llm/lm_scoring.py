"""A log-bilinear language model: noise-contrastive training, normalised scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquest.llm.rows import (
    NO_WORD, ascii_words, documents, fold, most_frequent, per_copy, word_counts)
from clipquest.session import materialize


@dataclass(frozen=True)
class LogBilinear:
    """Fixed sizes of the model; none grows with the corpus.

    Words fall into classes: the end of a text, the ``own`` most frequent words,
    the ``endings`` most frequent last two bytes of the others, and a rest. The
    network predicts classes, and counts over all training words split a class
    into its words.
    """

    own: int = 127
    endings: int = 127
    width: int = 16
    context: int = 4
    noise: int = 32
    batch: int = 2048
    rate: float = 0.1
    frequent: int = 131_072
    folds: int = 10
    warm_up: int = 8

    @property
    def classes(self) -> int:
        return self.own + self.endings + 2


Parameters = dict[str, np.ndarray]


def initial(config: LogBilinear, share: np.ndarray) -> Parameters:
    """Small random vectors; biases at the logarithm of each class's share of the tokens."""
    random = np.random.default_rng(7)
    shape = (config.classes, config.width)
    return {"seen": random.normal(0, 0.3, shape).astype("f4"),
            "next": random.normal(0, 0.3, shape).astype("f4"),
            "weigh": np.full((config.context, config.width), 1 / config.context, "f4"),
            "bias": np.log(share).astype("f4")}


def contexts(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` classes before each token; 0, the end of a text, before its start."""
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    out = np.zeros((width, len(codes)), np.int64)
    for i in range(1, width + 1):
        out[i - 1, i:] = np.where(place[i:] >= i, codes[:-i], 0) if i < len(codes) else 0
    return out


def _added(index: np.ndarray, columns: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``columns``, a row for each of the result's, by ``index``; added up in its order."""
    return np.stack([np.bincount(index, column, rows) for column in columns], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive estimation by AdaGrad; a batch shares its noise classes."""

    def __init__(self, config: LogBilinear, share: np.ndarray, start: Parameters):
        self.config, self.p = config, {k: v.astype("f4") for k, v in start.items()}
        self.sums = {k: np.full(v.shape, 1e-6) for k, v in start.items()}
        self.log_noise = np.log(config.noise * share).astype("f4")
        self.share, self.random, self.tokens = share, np.random.default_rng(11), 0

    def learn(self, codes: np.ndarray, starts: np.ndarray) -> None:
        before = contexts(codes, starts, self.config.context)
        for low in range(0, len(codes), self.config.batch):
            part = slice(low, low + self.config.batch)
            self._step(codes[part], before[:, part])
        self.tokens += len(codes)

    def _step(self, target: np.ndarray, before: np.ndarray) -> None:
        p, classes = self.p, self.config.classes
        noise = self.random.choice(classes, self.config.noise, p=self.share)
        # Rows are taken once a step; ``take`` copies them several times as fast as an index does.
        seen, nexts = [p["seen"].take(b, 0) for b in before], p["next"].take(target, 0)
        guess = sum(s * w for s, w in zip(seen, p["weigh"]))
        true = (guess * nexts).sum(1) + p["bias"][target] - self.log_noise[target]
        false = guess @ p["next"][noise].T + p["bias"][noise] - self.log_noise[noise]
        off_true, off_false = _sigmoid(true) - 1, _sigmoid(false)
        back = off_true[:, None] * nexts + off_false @ p["next"][noise]
        nexts = _added(target, (off_true[:, None] * guess).T.astype("f8"), classes)
        np.add.at(nexts, noise, off_false.T @ guess)
        bias = np.bincount(target, off_true, classes)
        np.add.at(bias, noise, off_false.sum(0))
        columns, across = np.ascontiguousarray(back.T), np.empty((back.shape[1], *before.shape))
        for i, w in enumerate(p["weigh"]):
            np.multiply(columns, w[:, None], out=across[:, i])
        gradients = {
            "next": nexts, "bias": bias,
            "weigh": np.stack([np.einsum("ij,ij->j", back, s) for s in seen]),
            "seen": _added(before.ravel(), across.reshape(len(across), -1), classes)}
        for name, gradient in gradients.items():
            self.sums[name] += gradient ** 2
            p[name] -= (self.config.rate * gradient / np.sqrt(self.sums[name])).astype("f4")


def class_scores(p: Parameters, codes: np.ndarray, starts: np.ndarray, block: int = 8192,
                 step: int = 512) -> np.ndarray:
    """log10 of each token's class probability, normalised over all classes.

    Blocks share their memory, and of a block ``step`` tokens at a time are
    scored and then raised to powers, so that those stay in a core's cache.
    """
    before = contexts(codes, starts, len(p["weigh"]))
    weighed, nexts = [p["seen"] * w for w in p["weigh"]], p["next"].T
    out, rows = np.empty(len(codes)), np.arange(block)
    room = np.empty((min(block, len(codes)), len(p["bias"])), "f4")
    powers, sums = np.empty((step, len(p["bias"])), "f4"), np.empty(block, "f4")
    for low in range(0, len(codes), block):
        part = slice(low, low + block)
        guess = sum(w.take(b, 0) for w, b in zip(weighed, before[:, part]))
        scores, total = room[:len(guess)], sums[:len(guess)]
        top = np.float32(-np.inf)
        for at in range(0, len(scores), step):
            some = np.matmul(guess[at:at + step], nexts, out=scores[at:at + step])
            some += p["bias"]
            top = max(top, some.max())
        target = scores[rows[:len(scores)], codes[part]]
        for at in range(0, len(scores), step):
            some = scores[at:at + step]
            few = np.subtract(some, top, out=powers[:len(some)])
            np.exp(few, out=few).sum(1, out=total[at:at + step])
        far = total < 1e-30
        logs = np.log(np.where(far, 1, total)) + top
        if far.any():
            peak = scores[far].max(1)
            logs[far] = np.log(np.exp(scores[far] - peak[:, None]).sum(1)) + peak
        out[part] = (target - logs) / math.log(10)
    return out


@dataclass
class Vocabulary:
    """What tasks need to know of the counts; all of bounded size."""

    config: LogBilinear
    numbers: dict[bytes, int]
    classes: np.ndarray
    base: np.ndarray
    inside: np.ndarray
    by_ending: dict[bytes, int]
    share: np.ndarray

    def read(self, texts: pa.Array, counted: bool = True
             ) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[dict]]:
        """Classes of all tokens, each text's start and, if ``counted``, known numbers and other words of each."""
        get, ending, rest, none = self.numbers.get, self.by_ending.get, self.config.classes - 1, repeat(-1)
        codes, starts, numbers, others, at = [], [], [], [], 0
        for text in texts:
            words = ascii_words(text.as_py())
            found = np.fromiter(map(get, words, none), np.int64, len(words))
            kinds = self.classes[found]
            missing = np.flatnonzero(found < 0)
            other = [words[i] for i in missing.tolist()]
            if other:
                kinds[missing] = [ending(w[-2:], rest) for w in other]
            codes += [kinds, _END]
            starts.append(at)
            if counted:
                numbers.append(found[found >= 0])
                others.append(Counter(other))
            at += len(words) + 1
        return np.concatenate(codes), np.array(starts), numbers, others


    def rows(self, part: pa.RecordBatch, others: list[dict], known: list[int], base: list[float],
             model: list[float], lengths: np.ndarray) -> pa.RecordBatch:
        """A row of each text's sums, followed by one for each of its other words."""
        sizes = np.array([len(other) + 1 for other in others])
        heads = np.cumsum(sizes) - sizes
        text = pa.array(np.repeat(np.arange(len(others)), sizes))
        names, counts = [], []
        for digest, n, other in zip(part.column(1).to_pylist(), known, others):
            names.append(NO_WORD + digest.to_bytes(8, "little", signed=True))
            names += other
            counts.append(n)
            counts += other.values()
        head = np.zeros(len(names), bool)
        head[heads] = True
        ending, rest = self.by_ending.get, self.config.classes - 1

        def at_heads(values: list[float] | np.ndarray, kind: pa.DataType) -> pa.Array:
            spread = np.zeros(len(names), kind.to_pandas_dtype())
            spread[heads] = values
            return pa.array(spread, kind, mask=~head)

        kinds = np.array([ending(name[-2:], rest) for name in names], np.int32)
        return pa.record_batch(
            [part.column(0).take(text), part.column(1).take(text), pa.array(names, pa.binary()),
             pa.array(counts, pa.int64()), pa.array(kinds, mask=head), at_heads(base, pa.float64()),
             at_heads(model, pa.float64()), at_heads(lengths, pa.int64())],
            ["doc_id", "text_hash", "word", "n", "kind", "base", "model", "n_tokens"])


_END = np.zeros(1, np.int64)


def _parts(batch: pa.RecordBatch, column: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Some MB of texts at a time."""
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def train(rows: DataFrame, shared, start: Parameters) -> Parameters:
    """One pass: each task learns from its texts, then the tasks' results are averaged by tokens."""
    names = list(start)
    shapes = [start[n].shape for n in names]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        trainer = Trainer(words.config, words.share, start)
        for batch in batches:
            for part in _parts(batch, 0):
                codes, starts, _, _ = words.read(part.column(0), counted=False)
                trainer.learn(codes, starts)
        if trainer.tokens:
            flat = np.concatenate([trainer.p[n].ravel() for n in names]).astype("f8") * trainer.tokens
            yield pa.record_batch([pa.array([trainer.tokens], pa.int64()),
                                   pa.array([flat.tobytes()], pa.binary())], ["tokens", "flat"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, flat = 0, 0.0
        for batch in batches:
            for n, data in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, flat = tokens + n, flat + np.frombuffer(data)
        if tokens:
            yield pa.record_batch([pa.array([tokens], pa.int64()),
                                   pa.array([flat.tobytes()], pa.binary())], ["tokens", "flat"])

    kind = "tokens bigint, flat binary"
    parts = rows.select("text").mapInArrow(learn, kind)
    found = parts.repartition(16).mapInArrow(add_up, kind).collect()
    if not found:
        return start
    mean = sum(np.frombuffer(r.flat) for r in found) / sum(r.tokens for r in found)
    cuts = np.split(mean, np.cumsum([math.prod(s) for s in shapes])[:-1])
    return {n: c.reshape(s).astype("f4") for n, c, s in zip(names, cuts, shapes)}


def score_documents(docs: DataFrame, config: LogBilinear = LogBilinear()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text.

    Learns from all rows whose CRC-32 of the id is not 0 modulo ``folds``: word
    counts over all their words, then the network over all their tokens, first
    one part in ``warm_up`` of the rows from one start, then the others from the
    averaged result. Every task visits its own rows in its own order, so a task
    that runs again gives the same. A class is predicted from the classes of the
    last ``context`` words; unseen words take a share of their class as one word
    would with no count.

    Words beyond the ``frequent`` most frequent ones (a fixed number, broadcast)
    get their counts by a join on the word; hot words never reach it.

    A null text is empty and has its end only. A null ``doc_id`` counts as an
    empty text's CRC-32, 0, hence as held out. Repeated rows each get a row;
    further columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = documents(docs).withColumn("held_out", fold("doc_id", config.folds) == 0)
    learned = rows.filter(~F.col("held_out"))
    words = materialize(word_counts(learned, ascii_words), "words")
    n_docs = learned.count()

    head = most_frequent(words, config.frequent).toArrow().sort_by(
        [("n", "descending"), ("word", "ascending")])
    names, numbers = head.column(0).to_pylist(), np.array(head.column(1).to_pylist(), np.float64)
    own = names[:config.own]
    ending = F.substring("word", -2, 2)
    few = spark.createDataFrame([(w, i + 1) for i, w in enumerate(own)], "word binary, own int")
    rest = words.join(F.broadcast(few), "word", "left").filter("own is null").withColumn("ending", ending)
    ends = rest.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).orderBy(
        F.desc("n"), "ending")
    top = ends.limit(config.endings).collect()
    by_ending = {bytes(r.ending): config.own + 1 + i for i, r in enumerate(top)}
    all_words = ends.agg(F.sum("n"), F.sum("words")).first()

    totals, kinds = np.zeros(config.classes), np.zeros(config.classes)
    totals[0] = n_docs
    totals[1:len(own) + 1] = numbers[:len(own)]
    for i, r in enumerate(top):
        totals[config.own + 1 + i], kinds[config.own + 1 + i] = r.n, r.words
    totals[-1] = (all_words[0] or 0) - sum(r.n for r in top)
    kinds[-1] = (all_words[1] or 0) - sum(r.words for r in top)
    n_tokens = int(totals.sum())
    n_kinds = int(kinds.sum()) + len(own) + (n_docs > 0)
    log_base = math.log10(n_tokens + 0.1 * (n_kinds + 1))
    log_class = np.log10(totals + 0.1 * (kinds + 1))

    class_of = np.array([i + 1 if i < config.own else by_ending.get(w[-2:], config.classes - 1)
                         for i, w in enumerate(names)] + [0], np.int64)
    log_n = np.log10(numbers + 0.1)
    inside = np.where(np.arange(len(names)) < config.own, 0.0, log_n - log_class[class_of[:-1]])
    share = (totals + 1) / (totals + 1).sum()
    end_base = (math.log10(n_docs + 0.1) if n_docs else -1.0) - log_base
    shared = spark.sparkContext.broadcast(Vocabulary(
        config, {w: i for i, w in enumerate(names)}, class_of, log_n - log_base, inside,
        by_ending, share))

    first = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(config.warm_up)) == 0
    model = train(learned.filter(first), shared, initial(config, share))
    model = train(learned.filter(~first), shared, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for part in _parts(batch, 2):
                codes, starts, known, others = words.read(part.column(2))
                sums = np.add.reduceat(class_scores(model, codes, starts), starts)
                lengths = np.diff(np.append(starts, len(codes)))
                yield words.rows(
                    part, others, [len(k) + (n_docs > 0) for k in known],
                    [end_base + words.base[k].sum() for k in known],
                    [s + words.inside[k].sum() for s, k in zip(sums, known)], lengths)

    scored = rows.select("doc_id", "text_hash", "text").mapInArrow(
        score, "doc_id bigint, text_hash bigint, word binary, n bigint, kind int, base double, "
               "model double, n_tokens bigint")
    joined = scored.join(words.select("word", F.col("n").alias("count")), "word", "left")
    log_count = F.log10(F.coalesce("count", F.lit(0)) + 0.1)
    of_class = F.element_at(F.array(*(F.lit(float(x)) for x in log_class)), F.col("kind") + 1)
    found = joined.groupBy("doc_id", "text_hash").agg(
        F.count("n_tokens").alias("copies"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(F.col("n_tokens").isNotNull() | F.col("count").isNotNull(), F.col("n"))
              ).alias("known"),
        F.sum(F.coalesce("base", F.col("n") * (log_count - log_base))).alias("base"),
        F.sum(F.coalesce("model", F.col("n") * (log_count - of_class))).alias("model"))
    return per_copy(found.select(
        "doc_id", (fold("doc_id", config.folds) == 0).alias("held_out"), "n_tokens",
        F.expr("known div copies").alias("n_known"), F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("model") / F.col("copies")).alias("score"), "copies"), "copies")
