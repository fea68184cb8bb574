"""N-gram Jaccard join with PartEnum signatures.

Sets of word shingles whose Jaccard resemblance reaches a threshold differ in few elements:
sizes ``a`` and ``b`` allow a symmetric difference of ``(1 - t) / (1 + t) * (a + b)``. Sizes are
divided into bands at least as wide as linked sets can be apart, and each band has its largest
difference ``k``; a set also takes part in the next band if a set of that band can be near enough.
Within a band the domain of shingles is partitioned into ``floor(k / 2) + 1 + x`` parts, so that at
least ``1 + x`` parts hold at most one differing element each, and each part again into ``ways``
smaller ones. A signature is the content of all smaller parts of a part but one. Of two linked
sets at least one signature is equal in each of these ``1 + x`` parts, whatever their elements.

Signatures of little content, empty ones above all, are shared by a fixed share of a band. A set
that has such heavy signatures in at most ``x`` parts does without them: in some other part it has
a signature in common with each of its partners, and that one is not heavy. Heavy signatures are
left to the sets that have more, so no link is lost.

From equal signatures to components:

1. Rows with the same set are one class, so copies never meet each other.
2. Classes under one signature are compared with the smallest of them (a star, not all pairs):
   first each class with the one it shares most signatures with, then the pairs of stars that
   are still in different components.
3. Where several components are left under a signature, those outside its largest component are
   compared with all others of other components: first by a sketch of part checksums, which
   never counts more differences than there are, then by the sets. Of the pairs of a crowded
   signature that sketches cannot rule out, first come the nearest that join the same components,
   fewer than there are members; then those that are still between components.

All pairs that might link two components have been compared with the sets when this ends, so no
link is lost; no limit is set on the members of a signature or a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrail.llm.components import components
from geotrail.llm.tables import bucket_flag, giving_back, saved, whole
from geotrail.llm.words import blocks, mixed, shingle_hashes, word_hashes

LEAST_PARTS = 64
#: Classes from which on a signature is heavy. A plan, never a result, depends on it.
HEAVY = 32
#: Bits of a signature that say which part of a band it is of, and that bands take turns by.
PART_BITS = 15
STRAY_BLOCK = 2048
MEMBER_BLOCK = 2048


@dataclass(frozen=True)
class Scheme:
    """Smaller parts of a part, how many times as far as linked sets can be apart a band reaches,
    and the parts in excess of those needed, as a share of these. Wider bands allow more
    differences, narrower ones have more sets that take part in two of them."""

    ways: int = 2
    reach: int = 3
    excess: float = 0.0

    def needed(self, allowed: np.ndarray) -> np.ndarray:
        return allowed // 2 + 1

    def spare(self, allowed: np.ndarray) -> np.ndarray:
        return np.ceil(self.needed(allowed) * self.excess).astype(np.int64)


def _scaled(elements: np.ndarray, seed: int, parts: np.ndarray) -> np.ndarray:
    """A part number below ``parts`` for each element, by a hash."""
    high = mixed(elements, seed) >> np.uint64(32)
    return ((high * parts.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def bands(largest: int, percent: int, reach: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the bands up to one beyond ``largest``, and the differences they allow."""
    first, widest = [1], []
    while True:
        last = first[-1] * 100**reach // percent**reach
        widest.append((100 - percent) * 2 * last // (100 + percent))
        first.append(last + 1)
        if first[-2] > largest:
            return np.array(first[:-1]), np.array(widest)


def spare_parts(sizes: np.ndarray, percent: int, scheme: Scheme) -> np.ndarray:
    """In how many parts a set may do without its signatures, in either of its bands; -1 for sets
    with more parts than a signature can tell apart."""
    first, allowed = bands(int(sizes.max(initial=1)), percent, scheme.reach)
    own = np.searchsorted(first, np.maximum(sizes, 1), side="right") - 1
    upper = allowed[np.minimum(own + 1, len(allowed) - 1)]
    parts = scheme.needed(upper) + scheme.spare(upper)
    # A later band never has less to spare.
    return np.where(parts < 1 << PART_BITS, scheme.spare(allowed[own]), -1)


def element_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and set sizes."""
    words, counts, _ = word_hashes(texts)
    hashes, runs = shingle_hashes(words, counts, shingle)
    stops = np.cumsum(runs)
    sets = [np.unique(hashes[b - n : b]) for b, n in zip(stops.tolist(), runs.tolist())]
    return np.concatenate(sets) if sets else hashes, np.array([len(s) for s in sets], np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each set, modulo 2**64."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


def class_hash(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mixed(_sums(mixed(elements, 11), sizes)).view(np.int64)


def _sketches(elements: np.ndarray, sizes: np.ndarray, percent: int) -> list[bytes]:
    """Checksums of the parts of each set: parts that differ have a difference. There are twice
    as many parts as differences are allowed to a set of the size, so sets that have nothing in
    common differ in more; powers of two, so that the parts of one are those of another united."""
    allowed = (100 - percent) * 2 * sizes // (100 + percent)
    parts = np.exp2(np.ceil(np.log2(np.maximum(LEAST_PARTS, 2 * allowed + 2)))).astype(np.int64)
    ends = np.cumsum(parts)
    out = np.zeros(int(parts.sum()), dtype=np.uint8)
    place = np.repeat(ends - parts, sizes) + _scaled(elements, 12, np.repeat(parts, sizes))
    np.add.at(out, place, (mixed(elements, 13) >> np.uint64(56)).astype(np.uint8))
    return [out[e - n : e].tobytes() for e, n in zip(ends.tolist(), parts.tolist())]


def _folded(sketch: bytes, parts: int) -> np.ndarray:
    """A sketch of fewer parts: checksums of united parts add up."""
    full = np.frombuffer(sketch, np.uint8)
    return full if len(full) == parts else full.reshape(parts, -1).sum(axis=1, dtype=np.uint8)


def _low_bits(sketch: bytes) -> bytes:
    """The two low bits of each checksum, four of them to a byte: a quarter of what travels."""
    four = (np.frombuffer(sketch, np.uint8) & 3).reshape(-1, 4)
    return np.bitwise_or.reduce(four << np.array([0, 2, 4, 6], np.uint8), axis=1).tobytes()


def _folded_low(low: bytes, parts: int) -> np.ndarray:
    """Low bits of a sketch of fewer parts. They differ in no more parts than whole checksums."""
    each = np.frombuffer(low, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)
    return (each & 3).reshape(parts, -1).sum(axis=1, dtype=np.uint8) & 3


def _with_low_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = [_low_bits(sketch) for sketch in batch.column(2).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(low, pa.binary())],
            names=["class", "n", "sketch"],
        )


def signatures(
    elements: np.ndarray, sizes: np.ndarray, percent: int, scheme: Scheme = Scheme()
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set and the number of the set they belong to. The low bits of a
    signature are those of its band and part."""
    first, allowed = bands(int(sizes.max(initial=1)), percent, scheme.reach)
    own = np.searchsorted(first, sizes, side="right") - 1
    # A set also takes part in the next band if a set of that band can be near enough.
    upper = own + 1
    up = (sizes > 0) & (sizes * 100 >= percent * first[np.minimum(upper, len(first) - 1)])
    chosen = np.concatenate([np.flatnonzero(sizes > 0), np.flatnonzero(up)])
    band = np.concatenate([own[sizes > 0], upper[up]])
    # Without any difference allowed, only equal sets are linked, and these are one class.
    chosen, band = chosen[allowed[band] > 0], band[allowed[band] > 0]
    ways = scheme.ways
    slots = (scheme.needed(allowed[band]) + scheme.spare(allowed[band])) * ways
    start = np.cumsum(slots) - slots
    n = sizes[chosen]
    begin = (np.cumsum(sizes) - sizes)[chosen]
    job = np.repeat(np.arange(len(chosen)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begin[job]
    held = elements[at]
    content = np.zeros(int(slots.sum()), dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(content, start[job] + _scaled(held, 14, slots[job]), mixed(held, 15))
        parts = content.reshape(-1, ways)
        rest = (parts.sum(axis=1, dtype=np.uint64)[:, None] - parts).reshape(-1)
        owner = np.repeat(np.arange(len(chosen)), slots)
        place = np.arange(len(rest)) - start[owner]
        tag = (band[owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)
        content_hash = mixed(mixed(tag, 16) + rest, 17) >> np.uint64(PART_BITS + 1)
    turn, part = band[owner] & 1, (place // ways) & ((1 << PART_BITS) - 1)
    low = ((turn << PART_BITS) + part).astype(np.uint64)
    signature = (content_hash << np.uint64(PART_BITS + 1)) + low
    return signature.view(np.int64), chosen[owner]


def _describe(shingle: int, percent: int, scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, marks = (batch.column(i) for i in range(3))
            for a, b in blocks(texts):
                elements, sizes = element_sets(texts.slice(a, b - a), shingle)
                sketch = _sketches(elements, sizes, percent)
                second = mixed(_sums(mixed(elements, 18), sizes)).view(np.int64)
                yield pa.record_batch(
                    [
                        ids.slice(a, b - a),
                        marks.slice(a, b - a),
                        pa.array(sizes),
                        pa.array(class_hash(elements, sizes)),
                        pa.array(second),
                        pa.array(sketch, pa.binary()),
                        pa.array(spare_parts(sizes, percent, scheme)),
                    ],
                    names=["doc_id", "mark", "n_shingles", "class", "check", "sketch", "spare"],
                )

    return run


def _sign(shingle: int, percent: int, scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seen = batch.column(0), np.zeros(0, np.int64)
            for a, b in blocks(texts):
                elements, sizes = element_sets(texts.slice(a, b - a), shingle)
                label = class_hash(elements, sizes)
                # A class that this batch has shown before has nothing to add.
                fresh = np.zeros(len(label), bool)
                fresh[np.unique(label, return_index=True)[1]] = True
                fresh &= ~np.isin(label, seen)
                seen = np.union1d(seen, label)
                kept = np.repeat(fresh, sizes)
                signature, owner = signatures(elements[kept], sizes[fresh], percent, scheme)
                yield pa.record_batch(
                    [pa.array(signature), pa.array(label[fresh][owner])],
                    names=["signature", "class"],
                )

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and class: the first class of a signature with each other
    one. A signature may reach over any number of batches."""
    last_signature = last_class = pivot = None
    for batch in batches:
        signature, label = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(signature):
            continue
        opens = np.concatenate([[True], signature[1:] != signature[:-1]])
        repeated = np.concatenate([[False], (label[1:] == label[:-1]) & ~opens[1:]])
        group = np.cumsum(opens) - 1
        pivots = label[opens].copy()
        if last_signature is not None and signature[0] == last_signature:
            opens[0] = False
            pivots[0] = pivot
            repeated[0] = label[0] == last_class
        out = ~opens & ~repeated
        last_signature, last_class, pivot = signature[-1], label[-1], pivots[group[-1]]
        yield pa.record_batch(
            [pa.array(signature[out]), pa.array(pivots[group[out]]), pa.array(label[out])],
            names=["signature", "pivot", "class"],
        )


def _plausible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for size, left, right in zip(
                *(batch.column(c).to_pylist() for c in ("sizes", "left", "right"))
            ):
                parts = min(len(left), len(right))
                far = int((_folded(left, parts) != _folded(right, parts)).sum())
                near.append(far * (100 + percent) <= (100 - percent) * size)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _forest(left: np.ndarray, right: np.ndarray, groups: int) -> np.ndarray:
    """Numbers of the pairs of groups, nearest first, that hold together what all of them do:
    fewer than there are groups."""
    root, taken = np.arange(groups), []
    while True:
        a, b = root[left], root[right]
        across = np.flatnonzero(a != b)
        if not len(across):
            return np.sort(np.concatenate(taken)) if taken else across
        # The first pair of each group: the pairs are in one order, so these close no circle.
        first = np.full(groups, len(left))
        np.minimum.at(first, a[across], across)
        np.minimum.at(first, b[across], across)
        chosen = np.unique(first[first < len(left)])
        taken.append(chosen)
        for pair in chosen.tolist():
            u, v = root[left[pair]], root[right[pair]]
            while root[u] != u:
                u = root[u]
            while root[v] != v:
                v = root[v]
            root[max(u, v)] = min(u, v)
        while not np.array_equal(root, root[root]):
            root = root[root]


def _cross(percent: int, every: bool):
    """Pairs between the strays and the members of a block that may be linked and belong to
    different components: all, or the nearest ones that join the same components."""

    def run(table: pa.Table) -> pa.Table:
        stray = table.filter(table.column("stray"))
        member = table.filter(pa.compute.invert(table.column("stray")))
        held = member.column("sketch").to_pylist()
        lengths = np.array([len(x) for x in held], np.int64)
        # Each pair is held against each other in as many parts as the shorter sketch has.
        exact = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths).tolist()}
        strays = {len(x) for x in stray.column("sketch").to_pylist()}
        longer = {n: np.flatnonzero(lengths > n) for n in strays}
        same = {n: np.stack([_folded(held[r], n) for r in rows]) for n, rows in exact.items()}
        cut = {
            n: np.array([_folded(held[r], n) for r in rows], np.uint8).reshape(-1, n)
            for n, rows in longer.items()
        }
        size, label, part = (member.column(c).to_numpy() for c in ("n", "class", "component"))
        left, right, homes, others, distance = [], [], [], [], []
        for row, own, cls, home in zip(
            *(stray.column(c).to_pylist() for c in ("sketch", "n", "class", "component"))
        ):
            far = np.empty(len(size), np.int64)
            for n, rows in exact.items():
                if n <= len(row):
                    far[rows] = (same[n] != _folded(row, n)).sum(axis=1)
            above = longer[len(row)]
            far[above] = (cut[len(row)] != np.frombuffer(row, np.uint8)).sum(axis=1)
            fit = np.minimum(size, own) * 100 >= np.maximum(size, own) * percent
            near = fit & (part != home) & (far * (100 + percent) <= (100 - percent) * (size + own))
            at = np.flatnonzero(near)
            left.append(np.minimum(label[at], cls))
            right.append(np.maximum(label[at], cls))
            homes.append(np.full(len(at), home))
            others.append(part[at])
            distance.append(far[at])
        if not left:
            left = right = homes = others = distance = [np.zeros(0, np.int64)]
        a, b, home, other, far = (
            np.concatenate(x) for x in (left, right, homes, others, distance)
        )
        if not every:
            order = np.lexsort((b, a, far))
            a, b, home, other = a[order], b[order], home[order], other[order]
            known, group = np.unique(np.concatenate([home, other]), return_inverse=True)
            at = _forest(group[: len(home)], group[len(home) :], len(known))
            a, b = a[at], b[at]
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _near_within(percent: int, signature, label, size, part, sketches):
    """Pairs of rows of one signature and different components that may be linked; rows are
    sorted by signature, and no signature has more than ``HEAVY``."""
    rows = np.arange(len(signature))
    ends = np.append(np.flatnonzero(signature[1:] != signature[:-1]) + 1, len(signature))
    later = np.repeat(ends, np.diff(ends, prepend=0)) - 1 - rows
    i = np.repeat(rows, later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    apart = (part[i] != part[j]) & (label[i] != label[j]) & (low * 100 >= high * percent)
    i, j = i[apart], j[apart]
    lengths = np.array([len(sketch) for sketch in sketches], np.int64)
    parts_of, near = 4 * np.minimum(lengths[i], lengths[j]), np.zeros(len(i), bool)
    for parts in np.unique(parts_of).tolist():
        pairs = np.flatnonzero(parts_of == parts)
        held = np.unique(np.concatenate([i[pairs], j[pairs]]))
        folded = np.stack([_folded_low(sketches[row], parts) for row in held.tolist()])
        step = max(1, (1 << 22) // parts)
        for a in range(0, len(pairs), step):
            at = pairs[a : a + step]
            left, right = (folded[np.searchsorted(held, side[at])] for side in (i, j))
            far = (left != right).sum(axis=1)
            near[at] = far * (100 + percent) <= (100 - percent) * (size[i[at]] + size[j[at]])
    a, b = label[i[near]], label[j[near]]
    return np.minimum(a, b), np.maximum(a, b)


def _cross_light(percent: int):
    """``_near_within`` for rows sorted by signature, any number of signatures at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> pa.RecordBatch:
            numbers = (table.column(c).to_numpy() for c in range(4))
            found = _near_within(percent, *numbers, table.column(4).to_pylist())
            return pa.record_batch([pa.array(side) for side in found], names=["a", "b"])

        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if left is not None:
                table = pa.concat_tables([left, table])
            # The last signature may go on in the next batch.
            signature = table.column(0).to_numpy()
            whole_rows = int(np.argmax(signature == signature[-1]))
            left = table.slice(whole_rows)
            if whole_rows:
                yield pairs(table.slice(0, whole_rows))
        if left is not None:
            yield pairs(left)

    return run


def _whole_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in blocks(texts):
                elements, sizes = element_sets(texts.slice(a, b - a), shingle)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.record_batch(
                    [
                        ids.slice(a, b - a),
                        pa.array(class_hash(elements, sizes)),
                        pa.ListArray.from_arrays(pa.array(offsets), elements.view(np.int64)),
                    ],
                    names=["doc_id", "class", "elements"],
                )

    return run


class JaccardJoin:
    """One join over a table of documents."""

    def __init__(
        self,
        docs: DataFrame,
        doc_id: str,
        text: str,
        shingle: int,
        percent: int,
        scheme: Scheme,
    ):
        self.texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        self.shingle, self.percent, self.scheme = shingle, percent, scheme
        self.id_type = self.texts.schema["doc_id"].dataType.simpleString()
        self.rows = saved(
            self.texts.withColumn("mark", F.xxhash64("text")).mapInArrow(
                giving_back(_describe(shingle, percent, scheme)),
                f"doc_id {self.id_type}, mark long, n_shingles long, class long, check long,"
                " sketch binary, spare long",
            )
        )
        self.classes = saved(
            self.rows.where("n_shingles > 0")
            .groupBy("n_shingles", "class", "check")
            .agg(
                F.min("doc_id").alias("first"),
                F.first("sketch").alias("sketch"),
                F.first("spare").alias("spare"),
            )
        )

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` of classes whose sets are near enough."""
        pairs = saved(self._plausible_pairs(pairs))
        needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        known = self.classes.select("class", F.col("first").alias("doc_id"))
        needed = saved(known.join(needed, "class", "left_semi"))
        flagged = bucket_flag(self.texts, needed, ["doc_id"], "_needed")
        sets = (
            flagged.where("_needed")
            .select("doc_id", "text")
            .mapInArrow(
                giving_back(_whole_sets(self.shingle)),
                f"doc_id {self.id_type}, class long, elements array<long>",
            )
            # A class may have a null id for its first.
            .join(
                needed.select(F.col("doc_id").alias("_id"), F.col("class").alias("_class")),
                F.expr("doc_id <=> _id and class = _class"),
                "left_semi",
            )
            .groupBy("class")
            .agg(F.first("elements").alias("elements"))
        )
        sets = saved(sets)
        shared = F.size(F.array_intersect("left", "right"))
        union = F.size("left") + F.size("right") - shared
        compared = pairs.join(
            sets.select(F.col("class").alias("b"), F.col("elements").alias("right")), "b"
        ).join(sets.select(F.col("class").alias("a"), F.col("elements").alias("left")), "a")
        return compared.where(shared * 100 >= union * self.percent).select("a", "b")

    def _plausible_pairs(self, pairs: DataFrame) -> DataFrame:
        def side(name: str, size: str, sketch: str) -> DataFrame:
            return self.classes.select(
                F.col("class").alias(name),
                F.col("n_shingles").alias(size),
                F.col("sketch").alias(sketch),
            )

        described = pairs.join(side("b", "nb", "right"), "b").join(side("a", "na", "left"), "a")
        near = described.where(
            f"least(na, nb) * 100 >= greatest(na, nb) * {self.percent}"
        ).select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), "left", "right")
        return near.mapInArrow(giving_back(_plausible(self.percent)), "a long, b long")

    def stars(self) -> DataFrame:
        """``signature, pivot, class``: classes that share a signature with a smaller one."""
        return self._starred(
            self.texts.select("text").mapInArrow(
                giving_back(_sign(self.shingle, self.percent, self.scheme)),
                "signature long, class long",
            )
        )

    def told_apart(self, stars: DataFrame) -> DataFrame:
        """``stars`` in which heavy signatures have the classes alone that cannot do without."""
        heavy = saved(
            stars.groupBy("signature")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= HEAVY)
            .select("signature")
        )
        if heavy.isEmpty():
            return stars
        crowded = stars.join(heavy, "signature", "left_semi")
        members = saved(
            crowded.select("signature", "class").union(
                crowded.select("signature", "pivot").distinct()
            )
        )
        low = F.col("signature").bitwiseAND(F.lit((1 << PART_BITS + 1) - 1))
        parts = (
            members.select("class", low.alias("part"))
            .distinct()
            .groupBy("class", F.shiftright("part", PART_BITS).alias("turn"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        bound = (
            parts.join(self.classes.select("class", "spare"), "class")
            .where("n > spare")
            .select("class")
            .distinct()
        )
        kept = saved(self._starred(members.join(bound, "class", "left_semi")))
        return stars.join(heavy, "signature", "left_anti").unionByName(kept)

    @staticmethod
    def _starred(members: DataFrame) -> DataFrame:
        return (
            members.select("signature", "class")
            .repartition("signature")
            .sortWithinPartitions("signature", "class")
            .mapInArrow(giving_back(_stars), "signature long, pivot long, class long")
        )

    def _labelled(self, links: DataFrame) -> DataFrame:
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        return components(edges).withColumnRenamed("node", "class")

    @staticmethod
    def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of classes in different components."""

        def side(name: str) -> DataFrame:
            return labels.select(F.col("class").alias(name), F.col("component").alias(f"of_{name}"))

        return (
            pairs.join(side("a"), "a", "left")
            .join(side("b"), "b", "left")
            .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
            .drop("of_a", "of_b")
        )

    def open_members(self, stars: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of the signatures that still hold several components, and whether these are
        crowded. Of signatures with the very same members, as near copies have by the hundred, one
        stands for all."""
        members = stars.select("signature", "class").union(
            stars.select("signature", "pivot").distinct()
        )
        members = members.join(labels, "class", "left").withColumn(
            "component", F.coalesce("component", "class")
        )
        mixed_up = (
            members.groupBy("signature")
            .agg(
                F.min("component").alias("low"),
                F.max("component").alias("high"),
                F.count(F.lit(1)).alias("n"),
                F.bit_xor(F.xxhash64("class")).alias("one"),
                F.bit_xor(F.xxhash64("class", F.lit(1))).alias("two"),
            )
            .where("low <> high")
            .groupBy("n", "one", "two")
            .agg(F.min("signature").alias("signature"))
            .select("signature", (F.col("n") > HEAVY).alias("crowded"))
        )
        return members.join(mixed_up, "signature")

    def _described(self) -> DataFrame:
        """Classes with the low bits of their sketches, for signatures of few members: pairs are
        held against the whole sketches, and then the sets, later."""
        described = self.classes.select("class", F.col("n_shingles").alias("n"), "sketch")
        return described.mapInArrow(
            giving_back(_with_low_bits), "class long, n long, sketch binary"
        )

    def light_pairs(self, members: DataFrame) -> DataFrame:
        """Pairs across components under one signature of few members that the sketches cannot
        rule out."""
        return (
            members.join(self._described(), "class")
            .select("signature", "class", "n", "component", "sketch")
            .repartition("signature")
            .sortWithinPartitions("signature")
            .mapInArrow(giving_back(_cross_light(self.percent)), "a long, b long")
            .distinct()
        )

    def cross_pairs(self, members: DataFrame, every: bool) -> DataFrame:
        """Pairs across components under one crowded signature that the whole sketches cannot
        rule out: all, or the nearest ones of each block that join the same components."""
        sizes = members.groupBy("signature", "component").count()
        largest = sizes.groupBy("signature").agg(
            F.max(F.struct("count", "component")).getField("component").alias("main")
        )
        number = Window.partitionBy("signature").orderBy("class")
        rows = (
            members.join(largest, "signature")
            .withColumn("_strays", F.col("component") != F.col("main"))
            .withColumn("_place", F.row_number().over(number) - 1)
            .withColumn(
                "_turn", F.sum(F.col("_strays").cast("int")).over(number) - F.col("_strays").cast("int")
            )
        )
        totals = rows.groupBy("signature").agg(
            F.floor(F.max("_place") / MEMBER_BLOCK).alias("_last_member"),
            F.floor((F.sum(F.col("_strays").cast("int")) - 1) / STRAY_BLOCK).alias("_last_stray"),
        )
        described = self.classes.select("class", F.col("n_shingles").alias("n"), "sketch")
        rows = rows.join(totals, "signature").join(described, "class")
        common = ["signature", "class", "component", "n", "sketch"]
        as_member = rows.select(
            *common,
            F.lit(False).alias("stray"),
            F.floor(F.col("_place") / MEMBER_BLOCK).alias("mb"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last_stray"))).alias("sb"),
        )
        as_stray = rows.where("_strays").select(
            *common,
            F.lit(True).alias("stray"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last_member"))).alias("mb"),
            F.floor(F.col("_turn") / STRAY_BLOCK).alias("sb"),
        )
        return (
            as_member.unionByName(as_stray)
            .groupBy("signature", "mb", "sb")
            .applyInArrow(_cross(self.percent, every), "a long, b long")
            .distinct()
        )

    def labels(self) -> DataFrame:
        """``class, component`` of all classes that are linked with another one."""
        stars = self.told_apart(saved(self.stars()))
        pairs = saved(
            stars.groupBy(F.col("pivot").alias("a"), F.col("class").alias("b")).agg(
                F.count(F.lit(1)).alias("shared")
            )
        )
        nearest = saved(
            pairs.groupBy("b")
            .agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
            .select("a", "b")
        )
        links = saved(self.links(nearest))
        labels = self._labelled(links)
        pairs = pairs.drop("shared")
        others = saved(
            self._apart(pairs, labels).join(nearest, ["a", "b"], "left_anti").select("a", "b")
        )
        if not others.isEmpty():
            links = links.union(saved(self.links(others)))
            labels = self._labelled(links)
        # Crowded signatures first by the nearest pairs, which leaves fewer apart.
        for every in (False, True):
            members = saved(self.open_members(stars, labels))
            crowded = members.where("crowded").drop("crowded")
            found = self.cross_pairs(crowded, every)
            if every:
                light = members.where("not crowded").drop("crowded")
                found = found.union(self.light_pairs(light)).distinct()
            elif crowded.isEmpty():
                continue
            fresh = saved(found.join(pairs, ["a", "b"], "left_anti"))
            if fresh.isEmpty():
                continue
            pairs = pairs.union(fresh)
            links = links.union(saved(self.links(fresh)))
            labels = self._labelled(links)
        return labels

    def result(self) -> DataFrame:
        """``doc_id, mark, n_shingles, component_id`` for each row; the mark is of its text."""
        linked = self.classes.join(self.labels(), "class", "left").withColumn(
            "component", F.coalesce("component", "class")
        )
        least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
        found = linked.join(least, "component").select(
            "n_shingles", "class", "check", "component_id"
        )
        empty = self.rows.where("n_shingles = 0").select(
            "doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id")
        )
        return (
            self.rows.where("n_shingles > 0")
            .drop("sketch", "spare")
            .join(found, ["n_shingles", "class", "check"])
            .select("doc_id", "mark", "n_shingles", "component_id")
            .unionByName(empty)
        )


def jaccard_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    percent: int = 90,
    scheme: Scheme = Scheme(),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    The set of a text is its distinct runs of ``shingle`` words, A-Z lower-cased; fewer words
    are one run. Two rows are linked when ``100 * intersection >= percent * union``, and
    ``component_id`` is the smallest id that can be reached by links. Texts that are null, empty
    or blank have no shingles and are linked with nothing. Rows that repeat a text or an id are
    rows like others; a null id is never the smallest. Extra columns are left out.
    """
    return JaccardJoin(docs, doc_id, text, shingle, percent, scheme).result().drop("mark")


#: At a lower threshold a smaller part holds fewer shingles: more ways and narrower bands keep
#: signatures telling, and parts in excess spare most sets those that are not.
LOOSE = Scheme(ways=3, reach=1, excess=0.15)


def one_of_each(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    scheme: Scheme = LOOSE,
) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the one with
    the smallest id. Rows without shingles all stay, and so do repeated rows of an id and text
    that stays."""
    found = JaccardJoin(docs, doc_id, text, shingle, percent, scheme).result()
    gone = saved(
        found.where("n_shingles > 0 and not doc_id <=> component_id")
        .select("doc_id", "mark")
        .distinct()
    )
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), whole(docs)
    )
    flagged = bucket_flag(rows, gone, ["doc_id", "mark"], "_gone")
    known = gone.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    doubtful = flagged.where("_gone").join(
        known, F.expr("doc_id <=> _id and mark = _mark"), "left_anti"
    )
    return flagged.where("not _gone").select("_row.*").union(doubtful.select("_row.*"))
