"""Similar documents: an exact Jaccard join on word shingles by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipquest.llm.components import components
from clipquest.llm.decontamination import filter_places, seed_filter
from clipquest.llm.rows import documents, free_names, mix, text_slices, word_hashes
from clipquest.session import materialize


@dataclass(frozen=True)
class Similarity:
    """Sets of ``words``-word shingles link at a Jaccard similarity of ``percent`` % or more.

    ``parts`` second-level parts of which ``apart`` may differ make PartEnum's
    subsets. ``block`` bounds how many shingles one side of a comparison holds, and
    ``members`` how many sets of one signature meet at a time.
    """

    words: int = 3
    percent: int = 90
    parts: int = 2
    apart: int = 1
    block: int = 250_000
    members: int = 4096

    def bands(self, largest: int) -> list[tuple[int, int]]:
        """Size bands: each reaches to the largest size that its smallest can link with."""
        out, low = [], 1
        while low <= largest:
            high = low * 100 // self.percent
            out.append((low, high))
            low = high + 1
        return out

    def differ(self, high: int) -> int:
        """How many elements two linked sets of at most ``high`` elements differ by, at most."""
        return int(Fraction(100 - self.percent, 100 + self.percent) * 2 * high)


_NO_ID = -(1 << 63)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def shingles(hashes: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a shorter row is one shingle, an empty none."""
    mixed = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        mixed += hashes[i:i + len(mixed)] * np.uint64(_MULTIPLIERS[i])
    mixed = mix(mixed)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(mixed[a:b - words + 1]))
        elif b > a:
            short = sum(int(h) * m for h, m in zip(hashes[a:b], _MULTIPLIERS)) + (b - a)
            out.append(mix(np.array([short & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(batches: Iterator[pa.RecordBatch], words: int
          ) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part, data, offsets in text_slices(batch):
            yield part, shingles(*word_hashes(data, offsets), words)


def node_of(elements: np.ndarray) -> bytes:
    """Sixteen bytes that stand for a set."""
    sums = [mix(elements).sum(dtype=np.uint64),
            mix(elements ^ np.uint64(_MULTIPLIERS[5])).sum(dtype=np.uint64) + np.uint64(len(elements))]
    return np.array(sums, ">u8").tobytes()


class Signatures:
    """PartEnum for sets of about equal size.

    A set belongs to its size band and is compared within it and with the band
    below. Of sets with at most ``high`` elements, linked ones differ in at most
    k. The hash range is cut into n1 parts of ``parts`` parts each, with
    n1 * (apart + 1) > k, so in one of the n1 at most ``apart`` of its parts
    differ, and some subset of the others is equal. Where a chosen subset is empty
    it says nothing; a set with more empty ones than there must be equal ones
    gives signatures for those too, so no link is lost.
    """

    def __init__(self, similarity: Similarity):
        self.s, self.tables = similarity, {}
        self.bands: list[tuple[int, int]] = []

    def band(self, size: int) -> int:
        if len(self.bands) < 2 or self.bands[-2][1] < size:
            self.bands = self.s.bands(4 * size)
        return int(np.searchsorted([h for _, h in self.bands], size))

    def of(self, elements: np.ndarray) -> np.ndarray:
        own = self.band(len(elements))
        # Pairs of bands (own - 1, own) and (own, own + 1); a link spans no more.
        return np.unique(np.concatenate(
            [self._of_pair(elements, low, self.bands[low + 1][1]) for low in (own - 1, own)
             if low >= 0] or [np.zeros(0, np.uint64)])) if len(elements) else np.zeros(0, np.uint64)

    def _of_pair(self, elements: np.ndarray, pair: int, high: int) -> np.ndarray:
        k, s = self.s.differ(high), self.s
        spare = max(1, k // 8) if k else 0
        n1 = k // (s.apart + 1) + 1 + spare
        cells = n1 * s.parts
        # Sorted hashes: a cell is a run of them.
        cell = np.minimum((elements.astype(np.float64) * (cells / 2.0 ** 64)).astype(np.int64), cells - 1)
        values = mix(elements ^ np.uint64(_MULTIPLIERS[4]))
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        sums = np.zeros(cells, np.uint64)
        sums[cell[begins]] = np.add.reduceat(values, begins)
        sums = sums.reshape(n1, s.parts)
        out, empty, seeds = [], [], np.arange(n1, dtype=np.uint64)
        for number, chosen in enumerate(combinations(range(s.parts), s.parts - s.apart)):
            total = np.zeros(n1, np.uint64)
            for place, c in enumerate(chosen):
                total += mix(sums[:, c] + np.uint64(place + 1))
            bare = (sums[:, list(chosen)] == 0).all(axis=1)
            key = (seeds * np.uint64(64) + np.uint64(number)) * np.uint64(_MULTIPLIERS[1])
            signed = mix(total ^ mix(key + np.uint64(pair * 0x1F123BB5)))
            out.append(signed[~bare])
            empty.append((signed[bare], seeds[bare]))
        bare_parts = np.unique(np.concatenate([parts for _, parts in empty]))
        # At least spare + 1 of the n1 parts agree; that many must not all be empty.
        if len(bare_parts) > spare:
            out += [signed for signed, _ in empty]
        return np.concatenate(out)


def sketch(elements: np.ndarray) -> bytes:
    """A bit per place: whether an odd number of elements fall there; about as many places as elements.

    Sketches of two sets differ in at most as many bits as the sets in elements. A
    sketch folds to half its size by an exclusive or of its halves.
    """
    size = max(64, 1 << (len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def short_id(node: bytes) -> int:
    """The first eight bytes of a node; sets that share them only become candidates together."""
    return int.from_bytes(node[:8], "big", signed=True)


def document_sets(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, short, bits`` of every row.

    Equal sets have equal nodes; ``short`` is a node's short id and ``bits`` its sketch. Texts without
    words have none of the three.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, similarity.words):
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield pa.record_batch(
                [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(nodes, pa.binary()),
                 pa.array([n and short_id(n) for n in nodes], pa.int64()),
                 pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "node", "short", "bits"])

    return documents(docs).mapInArrow(read, "doc_id bigint, text_hash bigint, n_shingles bigint, "
                                            "node binary, short bigint, bits binary")


def shared_signatures(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """``group, member``: short ids of sets that share a signature, each set of members once.

    Rows (signature, short id) are dealt by signature and sorted. Signatures that a
    single set has, nine in ten, go no further, and neither do equal lists of
    members, as near copies share very many signatures. Lists of over ``members`` are cut
    into pieces of that size, of which every two make a group, so a signature that
    very many sets share is streamed and its pairs of sets meet in groups of bounded size.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, seen = Signatures(similarity), set()
        for part, sets in _sets(batches, similarity.words):
            found, owners = [], []
            for elements in sets:
                node = node_of(elements)
                if not len(elements) or node in seen:  # copies in a task sign once
                    continue
                if len(seen) < 100_000:
                    seen.add(node)
                own = signatures.of(elements)
                found.append(own)
                owners.append(np.full(len(own), short_id(node)))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)),
                                       pa.array(np.concatenate(owners))], ["signature", "member"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        signature, member, pieces = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(more[0]):
                continue
            signature, member = np.concatenate([signature, more[0]]), np.concatenate([member, more[1]])
            fresh = (np.diff(signature, prepend=~signature[0]) != 0) | (np.diff(member, prepend=~member[0]) != 0)
            signature, member = signature[fresh], member[fresh]
            # The last signature may go on in the next batch.
            last = int(np.searchsorted(signature, signature[-1], "left"))
            if pieces and last:
                first = int(np.searchsorted(signature, signature[0], "right"))
                yield _piece(signature[0], pieces, member[:first])
                signature, member, last, pieces = signature[first:], member[first:], last - first, 0
            yield closed(signature[:last], member[:last], seen)
            signature, member = signature[last:], member[last:]
            while len(member) > similarity.members:
                yield _piece(signature[0], pieces, member[:similarity.members])
                signature, member = signature[similarity.members:], member[similarity.members:]
                pieces += 1
        if pieces:
            yield _piece(signature[0], pieces, member)
        elif len(signature):
            yield closed(signature, member, seen)

    def closed(signature: np.ndarray, member: np.ndarray, seen: set[int]) -> pa.RecordBatch:
        begins = np.flatnonzero(np.diff(signature, prepend=~signature[:1]) != 0)
        sizes = np.diff(np.append(begins, len(signature)))
        keys = np.zeros(0, np.int64)
        if len(begins):
            keys = mix(np.add.reduceat(mix(member.view(np.uint64)), begins) + sizes.astype(np.uint64)).view(np.int64)
        several = np.flatnonzero(sizes > 1)
        several = several[np.unique(keys[several], return_index=True)[1]]
        several = several[np.fromiter((k not in seen for k in keys[several].tolist()), bool, len(several))]
        if len(seen) < 500_000:
            seen.update(keys[several].tolist())
        taken = np.zeros(len(begins), bool)
        taken[several] = True
        rows = np.repeat(taken, sizes)
        return _members(np.repeat(keys, sizes)[rows], None, member[rows])

    def _piece(signature: int, number: int, member: np.ndarray) -> pa.RecordBatch:
        return _members(np.full(len(member), signature), number, member)

    def _members(key: np.ndarray, piece: int | None, member: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(key, pa.int64()), pa.array([piece] * len(member), pa.int32()),
                                pa.array(member, pa.int64())], ["group", "piece", "member"])

    signed = documents(docs).mapInArrow(sign, "signature bigint, member bigint")
    found = signed.repartition("signature").sortWithinPartitions("signature", "member").mapInArrow(
        group, "group bigint, piece int, member bigint")
    found = materialize(found, "signature-groups")
    pieces = found.filter("piece is not null").distinct()
    numbers = pieces.groupBy("group").agg(F.max("piece").alias("top"))
    spread = pieces.join(numbers, "group").withColumn("other", F.explode(F.sequence(F.lit(0), "top"))).filter(
        "top = 0 or other != piece")
    pairs = spread.select(F.xxhash64("group", F.least("piece", "other"), F.greatest("piece", "other")).alias(
        "group"), "member")
    return found.filter("piece is null").select("group", "member").union(pairs).distinct()


def _close(rows: list[tuple[int, int, bytes]], percent: int, joined: _Forest) -> list[tuple[int, int]]:
    """Links of sets (short id, size, sketch) that may be similar, as many as join them.

    Sets that ``joined`` holds together already are not compared.
    """
    size = min(len(r[2]) for r in rows)
    out = []
    if len(rows) <= 12:
        folded = []
        for _, _, bits in rows:
            value, width = int.from_bytes(bits, "little"), 8 * len(bits)
            while width > 8 * size:
                width //= 2
                value = (value >> width) ^ (value & ((1 << width) - 1))
            folded.append(value)
        for j, (b, n, _) in enumerate(rows):
            for i, (a, m, _) in enumerate(rows[:j]):
                apart = (folded[i] ^ folded[j]).bit_count()
                if (apart * (100 + percent) <= (100 - percent) * (n + m)
                        and 100 * min(n, m) >= percent * max(n, m) and joined.join(a, b)):
                    out.append((a, b))
        return out
    words = np.empty((len(rows), size // 8), np.uint64)
    for i, (_, _, bits) in enumerate(rows):
        words[i] = np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)
    sizes = np.array([r[1] for r in rows])
    ends: dict[int, int] = {}
    own = np.array([ends.setdefault(joined.end(r[0]), len(ends)) for r in rows])
    for i in range(len(rows) - 1):
        others = np.flatnonzero(own[i + 1:] != own[i]) + i + 1
        n, m = sizes[i], sizes[others]
        others = others[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
        if not len(others):
            continue
        apart = np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64)
        others = others[apart * (100 + percent) <= (100 - percent) * (n + sizes[others])]
        labels, first = np.unique(own[others], return_index=True)
        for j in others[first].tolist():
            joined.join(rows[i][0], rows[j][0])
            out.append((rows[i][0], rows[j][0]))
        own[np.isin(own, labels)] = own[i]
    return out


def candidate_links(docs: DataFrame, nodes: DataFrame, similarity: Similarity) -> DataFrame:
    """``a, b``: links between short ids that join all sets that may be similar.

    That are sets that share a signature, of sizes and sketches that similar sets can
    have. All pairs of a group are tried, on sketches of some bits per element, in one task, as a
    group is bounded; only links that join what was apart are rows.
    """
    groups = shared_signatures(docs, similarity).join(
        nodes.select(F.col("short").alias("member"), "n_shingles", "bits"), "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Forest()
        key, rows = None, []
        for batch in batches:
            out = []
            for group, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if group != key:
                    out += _close(rows, similarity.percent, joined) if len(rows) > 1 else []
                    key, rows = group, []
                rows.append(tuple(row))
            yield links(out)
        yield links(_close(rows, similarity.percent, joined) if len(rows) > 1 else [])

    def links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([a for a, _ in rows], pa.int64()),
                                pa.array([b for _, b in rows], pa.int64())], ["a", "b"])

    sorted_rows = groups.select("group", "member", "n_shingles", "bits").repartition(
        "group").sortWithinPartitions("group", "member")
    return sorted_rows.mapInArrow(compare, "a bigint, b bigint").distinct()


class _Forest:
    """Which sets links have joined so far; forgets when it has grown large."""

    def __init__(self, most: int = 200_000):
        self.up: dict[int, int] = {}
        self.most = most

    def end(self, node: int) -> int:
        up = self.up
        while (above := up.get(node, node)) != node:
            up[node] = up.get(above, above)
            node = above
        return node

    def join(self, a: int, b: int) -> bool:
        """Whether the link joins what was apart."""
        if len(self.up) > self.most:
            self.up.clear()
        a, b = self.end(a), self.end(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _linked(sets: list[np.ndarray], split: int, percent: int) -> list[tuple[int, int]]:
    """Links that join all linked sets of a group; across ``split``, if it isn't 0.

    A set is compared with all those at once that it isn't joined with yet. The
    first set of either side is compared with both sides, so near copies of one
    text are joined in one step or two.
    """
    sizes = np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(values), np.int32)
    own = np.arange(len(sets))
    out = []

    def compare(i: int, low: int) -> None:
        others = np.flatnonzero(own[low:] != own[i]) + low
        if not len(others):
            return
        mark[inverse[starts[i]:starts[i + 1]]] = 1
        first, last = int(others[0]), int(others[-1])
        hits = mark[inverse[starts[first]:starts[last + 1]]]
        both = np.add.reduceat(hits, starts[first:last + 1] - starts[first])[others - first]
        mark[inverse[starts[i]:starts[i + 1]]] = 0
        linked = others[100 * both >= percent * (sizes[i] + sizes[others] - both)]
        labels, at = np.unique(own[linked], return_index=True)
        out.extend((i, int(j)) for j in linked[at])
        own[np.isin(own, labels)] = own[i]

    for i in (0, split) if split else ():
        compare(i, 0)
    for i in range(split or len(sets) - 1):
        compare(i, max(i + 1, split))
    return out


def candidate_texts(docs: DataFrame, placed: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Documents whose text hash may be one of ``placed``: all of those, and few others.

    A broadcast bit filter of fixed size keeps other texts out of the shuffle. A larger corpus fills it up and
    lets more through, up to all texts once.
    """
    filtered = seed_filter(placed.select(F.array("text_hash").alias("seeds")), bits)
    shared = docs.sparkSession.sparkContext.broadcast(filtered)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            one, two = filter_places(batch.column(2).to_numpy().view(np.uint64), bits)
            yield batch.filter(pa.array(table[one] & table[two]))

    return documents(docs).mapInArrow(keep, "doc_id bigint, text string, text_hash bigint")


def verified_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame,
                   similarity: Similarity) -> DataFrame:
    """``a, b``: true links that join the same sets as all true links do.

    Sets of a candidate family (a component of the candidate links) are laid out
    in blocks by size, of some ``block`` shingles. Every two blocks whose sizes can
    link meet in one task as texts, so a family of any size is compared whole and
    no task holds more than two blocks. Most families are one block.
    """
    families = components(candidates).withColumnRenamed("node", "short")
    sizes = families.join(nodes.drop("bits"), "short")
    by_size = sizes.groupBy("root", "n_shingles").agg(F.sum("n_shingles").alias("total"))
    order = Window.partitionBy("root").orderBy("n_shingles")
    below = by_size.withColumn("below", F.sum("total").over(order) - F.col("total"))
    spot = F.col("below") + F.pmod(F.xxhash64("node"), F.col("total"))
    placed = materialize(sizes.join(below, ["root", "n_shingles"]).select(
        "root", "node", "key", "text_hash", "n_shingles",
        F.floor(spot / similarity.block).cast("int").alias("block")), "blocks")
    reach = placed.groupBy("root", "block").agg(
        F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    left, right = reach.alias("l"), reach.alias("r")
    pairs = left.join(right, (F.col("l.root") == F.col("r.root"))
                      & (F.col("l.block") <= F.col("r.block"))
                      & (F.col("l.high") * 100 >= F.col("r.low") * similarity.percent)).select(
        F.col("l.root").alias("root"), F.col("l.block").alias("one"), F.col("r.block").alias("two"))
    sides = pairs.select("root", "one", "two", F.explode(
        F.array_distinct(F.array("one", "two"))).alias("block"))
    texts = candidate_texts(docs, placed).withColumn("key", F.coalesce("doc_id", F.lit(_NO_ID))).join(
        placed.select("key", "text_hash", "root", "block", "node").hint("shuffle_hash"),
        ["key", "text_hash"])
    routed = texts.join(sides, ["root", "block"]).select(
        "text", "root", "one", "two", "block", "node")
    groups = routed.repartition("root", "one", "two").sortWithinPartitions(
        "root", "one", "two", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, seen, split = None, [], [], 0

        def links() -> Iterator[pa.RecordBatch]:
            found = _linked(sets, split, similarity.percent) if len(sets) > 1 else []
            if found:
                yield pa.record_batch([pa.array([seen[i] for i, _ in found], pa.binary()),
                                       pa.array([seen[j] for _, j in found], pa.binary())], ["a", "b"])

        for batch in batches:
            for part, found in _sets([batch], similarity.words):
                roots, ones, twos, blocks, names = (part.column(i).to_pylist() for i in range(1, 6))
                for *at, block, name, elements in zip(roots, ones, twos, blocks, names, found):
                    if at != key:
                        yield from links()
                        key, sets, seen, split = at, [], [], 0
                    if at[1] != at[2] and block == at[2] and not split:
                        split = len(sets)
                    sets.append(elements)
                    seen.append(name)
        yield from links()

    return groups.mapInArrow(compare, "a binary, b binary")


def similar_documents(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, group`` of every row.

    ``component_id`` is the smallest id of a document that links lead to, itself
    included; ``group`` tells components apart, also those without an id, and is
    null for texts without words. Texts are cut at white space and A-Z lower-cased; a text of fewer
    words than a shingle is one shingle; a null or empty text links with nothing.
    A null id takes the smallest id of its component, if any. Repeated rows each
    get a row; further columns are ignored; an empty table gives none.

    Equal sets are one node, so copies are never compared. Each node has one
    representative row; signatures and sketches give candidate families, and only families'
    texts are compared. A text of any length is one set, whole; its signatures and its sketch
    grow with it.
    """
    sets = materialize(document_sets(docs, similarity), "sets")
    filled = sets.filter("node is not null")
    nodes = filled.groupBy("node").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), "text_hash",
                       "n_shingles", "short", "bits")).alias("row"), F.min("doc_id").alias("lowest")).select(
        "node", "row.key", "row.text_hash", "row.n_shingles", "row.short", "row.bits", "lowest")
    nodes = materialize(nodes, "nodes")
    links = materialize(verified_links(docs, nodes, candidate_links(docs, nodes, similarity), similarity),
                        "similar")
    roots = components(links)
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = joined.groupBy("root").agg(F.min("lowest").alias("component_id"))
    of_node = joined.select("node", "root").join(lowest, "root").select(
        "node", "component_id", F.col("root").alias("group"))
    return sets.select("doc_id", "text_hash", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def keep_one_each(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """The rows of ``docs``, with their columns, that stand for their component.

    That is the row of the smallest id, and of the smallest text hash under it;
    of repeated rows one. A null id comes last. Null and empty texts and those without words all
    stay. Columns of any name stay as they are, and an empty table gives no row.
    """
    key, text = F.coalesce("doc_id", F.lit(_NO_ID)), F.coalesce("text", F.lit(""))
    wordless = ~text.rlike(r"[^\x20\x09-\x0D]")
    # An id is better than none, then the smaller one.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), key.alias("_doc"),
                           F.col("text_hash").alias("_text"))).alias("first")
    chosen = similar_documents(docs, similarity).filter(F.col("group").isNotNull()).groupBy("group").agg(
        first).select("first._doc", "first._text")
    own = free_names(docs, "doc", "text")
    marked = docs.filter(~wordless).withColumns(dict(zip(own, (key, F.xxhash64(text)))))
    chosen = chosen.toDF(*own).hint("shuffle_hash")
    kept = marked.join(chosen, own, "left_semi").dropDuplicates(own).drop(*own)
    return kept.unionByName(docs.filter(wordless))
