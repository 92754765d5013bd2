"""Near-duplicate join on word n-gram sets: PartEnum signatures, exact verification, components.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their sets of five-word shingles.

Signatures. Set sizes fall into bands [L, L'), L' = 4L // 3 + 1, so linked sets lie in one band or in
neighbouring ones. In the instance of band i (smaller set in i, larger one in i or i + 1) linked sets
differ in at most k = (L' - 1) // 3 shingles. The shingle domain is cut by hash range into n1 partitions,
more than k / 2, so in some of them linked sets differ in one shingle at most. Each partition is cut into
n2 = 3 parts, and its subsets of n2 - 1 parts are enumerated: a signature is a hash of what a set has in
such a subset. One difference leaves one subset of its partition alone, no difference leaves all three;
so linked sets have one signature in common at least, and with the partitions beyond k / 2 that there
are, as many as `promised` says. That number is a lossless filter. Subsets where a set has nothing give no
signature; a (small) set with so many of them that its promise falls to nothing also gives the hashes of
its least shingles (as many as a linked set cannot all miss).

Meeting. Documents with equal sets are one class before anything is compared. A class keeps the
signatures it shares with others; if these are fewer than its promise it cannot have a partner. Of the
rest, rarest first, it keeps so many that no partner can miss them all (x - promise + 1 of x), which
leaves out signatures made of very common passages. The least signature that two linked classes share
is kept by both.

Links. A shared signature ties its classes to the least of them, so no pairs within a group are made. Each
class is compared with the class that most of its signatures are tied to; that gives components. After
that a signature is open if classes of several components keep it. Only classes that keep an open
signature are compared further: those that open signatures connect, block by block, all against those
outside their largest component, as products of 0/1 matrices, so pairs are counted but never written.
No signature, partner or candidate is dropped.

Nulls: a null text is empty: size 0, linked with nothing, its own component. A row with a null doc_id
gets its size and a null component. Rows that repeat a doc_id are one vertex. Ids are whole numbers.
Very long texts are taken whole. Ties do not arise. Empty tables give no rows. Only doc_id and text are
read; clashing further columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import CHUNK_BYTES, MOST_BROADCAST, column_bytes, lean, mix, partitions, pieces, release, shingle_sets, sized, store

SET = ("n", "k1", "k2")
_P1, _P2, _P3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def bands(most: int) -> np.ndarray:
    """Lower ends of the size bands, up to beyond `most`."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 4 // 3 + 1)
    out.append(out[-1] * 4 // 3 + 1)
    return np.array(out, dtype=np.int64)


#: Parts of a partition; signatures take all of them but one.
N2 = 3


def instance(low: np.ndarray, band: int) -> tuple[int, int]:
    """(k, n1) of a band's instance: the most shingles linked sets differ in, and the partitions."""
    k = int(low[band + 1] - 1) // 3
    return k, k // 2 + 1 + k // 8


def promised(k: int, n1: int) -> int:
    """Of n1 * N2 subsets, those that k differences surely leave alone: the first one in a partition spoils two, the second the third."""
    return N2 * n1 - (2 * min(k, n1) + max(0, k - n1))


def prefix_length(n: int) -> int:
    """Two linked sets share one of their so many least shingles."""
    return n - (3 * n + 3) // 4 + 1


def signatures(s: np.ndarray, low: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
    """(band, signatures, promise) of a sorted set for each instance it takes part in.

    promise: signatures that any partner surely has in common with this set (at most 0: no promise).
    """
    n, out = len(s), []
    own = int(np.searchsorted(low, n, side="right")) - 1
    for band in ([own - 1, own] if own and 3 * n <= 4 * int(low[own] - 1) else [own]):
        k, n1 = instance(low, band)
        if k == 0:
            continue
        part = (((s >> np.uint64(32)) * np.uint64(n1 * N2)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        held = np.zeros(n1 * N2, np.uint64)
        held[part[first]] = np.add.reduceat(mix(s ^ _P1), first)
        some = np.zeros(n1 * N2, np.int64)
        some[part[first]] = 1
        held, some = held.reshape(n1, N2), some.reshape(n1, N2)
        # The subset that leaves out part j of partition q: the partition's sum without that part's.
        subset = held.sum(axis=1, dtype=np.uint64)[:, None] - held
        live = (some.sum(axis=1)[:, None] - some > 0).ravel()
        tag = np.uint64(band * int(_P3) % 2**64)
        sig = mix(subset.ravel() + np.arange(n1 * N2, dtype=np.uint64) * _P2 + tag)[live]
        promise = promised(k, n1) - (n1 * N2 - len(sig))
        if promise <= 0:
            sig = np.concatenate((sig, mix((s[: prefix_length(n)] ^ _P2) + tag)))
        out.append((band, sig, promise))
    return out


def _sets(batches: Iterator) -> Iterator[tuple[object, np.ndarray]]:
    """(Arrow batch row id, set) for each row; texts in pieces of bounded size."""
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        data, offsets = column_bytes(b.column("text"))
        for i, j in pieces(offsets, CHUNK_BYTES):
            found = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield from zip(ids[i:j], found, strict=True)


def _keyed(*names: str):
    """The named columns, with size and two hashes of the set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for _, s in _sets([b]):
                a = int(np.add.reduce(mix(s ^ _P2))) if len(s) else 0
                c = int(np.bitwise_xor.reduce(mix(s + _P3))) if len(s) else 0
                rows.append((len(s), a - 2**63, c - 2**63))
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *cols], [*names, *SET])

    return run


#: So many signatures are packed at a time; bounds a task's memory, not its results.
PACK = 400_000
PACKED = ("bucket", "low", "high", "id", "kind", "count")


def planes(x: np.ndarray) -> bytes:
    """The bytes of all numbers by place, lowest first: the upper ones are mostly alike and vanish in the shuffle's compression."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def from_planes(raw, kind: type) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(parts.T).view(kind).ravel()


def _emit(buckets: int):
    """Signatures, packed into one row a bucket for every `PACK` signatures of a task."""

    def packed(entries: list):
        import pyarrow as pa

        # In order of the ids, so that a bucket's ids are written as small differences.
        entries.sort(key=lambda e: e[0])
        ids, kinds = np.array([e[0] for e in entries], np.int64), np.array([e[1] for e in entries], np.int32)
        sig, row = np.concatenate([e[2] for e in entries]), np.repeat(np.arange(len(entries), dtype=np.int32), [len(e[2]) for e in entries])
        bucket = ((sig >> np.uint64(40)).astype(np.int32)) % buckets
        order = np.argsort(bucket, kind="stable")
        sig, row, bucket = sig[order], row[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        out: dict[str, list] = {k: [] for k in PACKED}
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            x, r = sig[cuts[k] : cuts[k + 1]], row[cuts[k] : cuts[k + 1]]
            who, per = np.unique(r, return_counts=True)
            # The bucket stands for the upper bits of its signatures; the lower 40 go along.
            lower = (x.astype(np.uint32).tobytes(), (x >> np.uint64(32)).astype(np.uint8).tobytes())
            owner = (planes(np.diff(ids[who], prepend=np.int64(0))), planes(kinds[who]), planes(per.astype(np.int32)))
            for name, v in zip(PACKED, (k, *lower, *owner), strict=True):
                out[name].append(v)
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(out[k], pa.binary()) for k in PACKED[1:]]], list(PACKED))

    def run(batches: Iterator) -> Iterator:
        held: list[tuple] = []
        n, low = 0, bands(1 << 10)
        for doc, s in _sets(batches):
            if len(s) >= low[-2]:
                low = bands(len(s))
            if len(s) < 3:
                continue
            for band, sig, promise in signatures(s, low):
                held.append((doc, band << 24 | min(max(promise, 1), (1 << 24) - 1), sig))
                n += len(sig)
            if n >= PACK:
                yield packed(held)
                n, held = 0, []
        if n:
            yield packed(held)

    return run


_MET = "a long, rank long, center long, kind int"


def _meet(batches: Iterator) -> Iterator:
    """Signatures of a task's buckets that several classes share: one row for each of these classes.

    rank orders signatures by the number of their classes; center is the least of them; kind holds
    the band and what the class is promised (1 at least).
    """
    import pyarrow as pa

    rows = [r for b in batches for r in zip(*[b.column(c) for c in PACKED[1:]], strict=True)]
    if not rows:
        return
    get = lambda k, t: np.concatenate([np.frombuffer(r[k].as_buffer(), t) for r in rows])
    sig = get(0, np.uint32) | (get(1, np.uint8).astype(np.uint64) << np.uint64(32))
    ids = np.concatenate([np.cumsum(from_planes(r[2].as_buffer(), np.int64)) for r in rows])
    kind, count = (np.concatenate([from_planes(r[k].as_buffer(), np.int32) for r in rows]) for k in (3, 4))
    del rows
    at = np.repeat(np.arange(len(count), dtype=np.int32), count)
    order = np.argsort(sig, kind="stable")
    sig, at = sig[order], at[order]
    same = sig[1:] == sig[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    sig, at = sig[shared], at[shared]
    order = np.lexsort((ids[at], sig))
    sig, at = sig[order], at[order]
    # A class may repeat a signature (repeated rows): once is enough.
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (ids[at[1:]] != ids[at[:-1]])
    sig, at = sig[new], at[new]
    start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))[: len(sig)]
    length = np.diff(np.append(start, len(sig)))
    many = np.repeat(length > 1, length)
    center = np.repeat(ids[at[start]] if len(start) else ids[:0], length)[many]
    size = np.repeat(length, length)[many]
    sig, at = sig[many], at[many]
    rank = (np.minimum(size, 32767).astype(np.int64) << 48) | sig.astype(np.int64)
    for i in range(0, len(sig), 100_000):
        cut = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[cut]]), pa.array(rank[cut]), pa.array(center[cut]), pa.array(kind[at[cut]])], ["a", "rank", "center", "kind"])


def kept_signatures(docs: DataFrame) -> DataFrame:
    """(a, kept): the signatures (rank, center) that a class keeps, by instance; a list is bounded by the class's own text."""
    buckets = partitions(docs.sparkSession)
    packed = docs.mapInArrow(lean(_emit(buckets)), "bucket int, " + ", ".join(f"{c} binary" for c in PACKED[1:]))
    met = packed.repartitionById(buckets, "bucket").mapInArrow(lean(_meet), _MET)
    each = met.groupBy("a", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", "center"))).alias("all"))
    need = F.col("kind").bitwiseAND(F.lit((1 << 24) - 1))
    each = each.where(F.size("all") >= need).select("a", F.slice("all", F.lit(1), F.size("all") - need + 1).alias("kept"))
    return store(each, "jaccard-kept")


def ties(kept: DataFrame) -> DataFrame:
    """(a, centers, best): the classes that a class is tied to, and the one it is tied to most often."""
    centers = F.filter(F.transform("kept", lambda x: x["center"]), lambda c: c != F.col("a"))
    each = kept.select("a", centers.alias("c")).where(F.size("c") > 0)
    votes = F.transform(F.array_distinct("c"), lambda d: F.struct(F.size(F.filter("c", lambda e: e == d)).alias("n"), (-d).alias("minus")))
    return store(each.select("a", F.array_distinct("c").alias("centers"), (-F.array_max(votes)["minus"]).alias("best")), "jaccard-ties")


def _pack(batches: Iterator) -> Iterator:
    """Sets as sorted hashes cut to 32 bits."""
    import pyarrow as pa

    for b in batches:
        found = [np.sort((s >> np.uint64(32)).astype(np.uint32)).tobytes() for _, s in _sets([b])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("best"), pa.array(found, pa.binary())], ["node", "best", "words"])


def _pack_whole(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.tobytes() for _, s in _sets([b])], pa.binary())], ["doc_id", "words"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays (with repeats: of the multisets, at most)."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _verify_whole(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        verdict = []
        for x, y in zip(b.column("words_a"), b.column("words_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            verdict.append(int(175 * _common(x, y) >= 75 * (len(x) + len(y))))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(verdict, pa.int32())], ["a", "b", "verdict"])


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a stored list of ids, whose size decides how."""
    return docs.join(sized(ids), "doc_id", how)


def sets_of(docs: DataFrame, ids: DataFrame, pack) -> DataFrame:
    sets = by_ids(docs, store(ids.distinct(), "jaccard-ids"), "left_semi").mapInArrow(lean(pack), "doc_id long, words binary")
    return store(sets.dropDuplicates(["doc_id"]), "jaccard-sets")


def _judged(pairs: DataFrame, sets: DataFrame, judge) -> DataFrame:
    left = sets.select(F.col("doc_id").alias("a"), F.col("words").alias("words_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("words").alias("words_b"))
    return store(pairs.join(right, "b").join(left, "a").mapInArrow(lean(judge), "a long, b long, verdict int"), "jaccard-judged")


def whole_links(docs: DataFrame, close: DataFrame) -> DataFrame:
    """Of pairs too close for 32 bits, those that link by 64-bit hashes."""
    close = store(close.distinct(), "jaccard-close")
    if close.isEmpty():
        return close
    sets = sets_of(docs, close.select(F.explode(F.array("a", "b")).alias("doc_id")), _pack_whole)
    return _judged(close, sets, _verify_whole).where("verdict = 1").select("a", "b")


BLOCK = 1024
_COLUMNS = 1 << 12


def _chance(n: np.ndarray) -> np.ndarray:
    """Common hashes of 32 bits that agree by chance: far more than can be expected of n hashes in all."""
    return 3 + n * n // 2**28


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    words = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, at, times = np.unique(words, return_inverse=True, return_counts=True)
    keep = times[at] > 1  # a word of one set only is common to none
    place = np.cumsum(times > 1) - 1
    row, at = row[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, _COLUMNS):
        i, j = np.searchsorted(at, [lo, lo + _COLUMNS])
        m = np.zeros((len(left) + len(right), min(_COLUMNS, int(at[-1]) + 1 - lo)), np.float32)
        m[row[i:j], at[i:j] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _compare_blocks(pdf):
    """Links between a block of members outside the largest component and a block of all members."""
    import pandas as pd

    l, r = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    out: list[tuple] = []
    if len(l) and len(r):
        lw, rw = ([np.frombuffer(x, np.uint32) for x in p["words"]] for p in (l, r))
        common = common_counts(lw, rw)
        n = np.array([len(x) for x in lw])[:, None] + np.array([len(x) for x in rw])[None, :]
        # Words that agree by chance within a set count once in the product; that much may be missing.
        twice = [np.array([np.count_nonzero(x[1:] == x[:-1]) for x in w]) for w in (lw, rw)]
        missing = twice[0][:, None] + twice[1][None, :]
        other = l["label"].to_numpy()[:, None] != r["label"].to_numpy()[None, :]
        may = other & (175 * (common + missing) >= 75 * n)
        sure = may & (175 * (common - _chance(n)) >= 75 * n)
        li, ri, rl = l["node"].to_numpy(), r["node"].to_numpy(), r["label"].to_numpy()
        # One link between two components is enough; close pairs are only asked about where there is none.
        for i, links in ((i, np.flatnonzero(may[i])) for i in range(len(l))):
            if not len(links):
                continue
            firm = links[sure[i, links]]
            joined = set()
            for j in firm:
                if rl[j] not in joined:
                    joined.add(rl[j])
                    out.append((li[i], ri[j], 1))
            out += [(li[i], ri[j], 2) for j in links[~sure[i, links]] if rl[j] not in joined]
    return pd.DataFrame(out, columns=["a", "b", "verdict"])


_BLOCK_ROW = ("family", "node", "label", "words", "side", "i", "j")


def _own(n) -> F.Column:
    """Block of a node among n."""
    return F.pmod(F.xxhash64("node"), n).cast("int")


def _span(n) -> F.Column:
    """All blocks of n."""
    return F.explode(F.sequence(F.lit(0), n - 1))


def _blocks(n) -> F.Column:
    return F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")


def _compare(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.select(*_BLOCK_ROW).unionByName(right.select(*_BLOCK_ROW))
    return store(both.groupBy("family", "i", "j").applyInPandas(_compare_blocks, "a long, b long, verdict int"), "jaccard-blocks")


def compare_stars(sets: DataFrame) -> DataFrame:
    """Verdicts of each class and the one it is tied to most often (sets: node, best, words)."""
    tied = sets.where("best is not null").withColumn("family", F.col("best"))
    n = store(tied.groupBy("family").agg(F.count("*").alias("n")), "jaccard-stars")
    right = tied.join(n, "family").withColumn("label", F.col("node")).withColumn("side", F.lit(1)).withColumn("i", F.lit(0)).withColumn("j", _own(_blocks(F.col("n"))))
    left = sets.join(n, sets["node"] == n["family"]).withColumn("label", F.col("node")).withColumn("side", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", _span(_blocks(F.col("n"))))
    return _compare(left, right)


def compare_families(sets: DataFrame, members: DataFrame, every: bool) -> DataFrame:
    """Verdicts between components of one family: all members against those outside the largest component.

    members: node, family, label. Unless `every`, the members of the largest component are stood for
    by about one block of them; that joins most of the rest, and leaves little for the whole comparison.
    """
    size = members.groupBy("family", "label").agg(F.count("*").alias("n"))
    largest = size.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")).where("most < n")
    m = members.join(sized(store(largest, "jaccard-families")), "family").join(sets.select("node", "words"), "node")
    nl, nr = _blocks(F.col("n") - F.col("most")), _blocks(F.col("n")) if every else F.lit(1)
    left = m.where("label != largest").withColumn("side", F.lit(0)).withColumn("i", _own(nl)).withColumn("j", _span(nr))
    right = m if every else m.where((F.col("label") == F.col("largest")) & (_own(_blocks(F.col("most"))) == 0))
    right = right.withColumn("side", F.lit(1)).withColumn("j", _own(nr)).withColumn("i", _span(nl))
    return _compare(left, right)


def components(links: DataFrame) -> DataFrame:
    """(node, label) with the least node reachable, for all nodes of the links.

    Each round every node goes to the least of itself and its neighbours, and on along two such steps; then the links are
    contracted: they join what their ends went to, once each, and those inside one label are gone. So a round
    reads only what is not joined yet, and at the end the steps are followed from the nodes.
    """
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    edges = store(links.where("a != b").select(*pair("a", "b")).distinct(), "jaccard-edges")
    steps: list[DataFrame] = []
    while not steps or not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        hook = store(ends.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "jaccard-hooks")
        step = hook
        for _ in range(2):
            far = hook.select(F.col("node").alias("label"), F.col("label").alias("far"))
            step = step.join(far, "label").select("node", F.col("far").alias("label"))
        step = store(step, "jaccard-steps")
        steps.append(step)
        to = lambda end: step.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        left = store(edges.join(to("a"), "a").join(to("b"), "b").where("label_a != label_b").select(*pair("label_a", "label_b")).distinct(), "jaccard-edges")
        release(edges, hook)
        edges = left
    labels = steps[0]
    for step in steps[1:]:
        labels = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    labels = store(labels, "jaccard-labels")
    release(edges, *steps)
    return labels


def open_members(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, family) of the classes that keep a signature which other components keep too.

    groups: node, rank. A family is what open signatures connect: classes that link, but are not in one component
    yet, keep one signature in common, so they are in one family.
    """
    g = groups.join(labels, "node", "left").select("node", "rank", F.coalesce("label", "node").alias("label"))
    open_ = g.groupBy("rank").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("rank", "least")
    live = store(g.join(sized(store(open_, "jaccard-open")), "rank").select("node", "label", "least").distinct(), "jaccard-live")
    # Components are connected, not classes: one row for each component and least neighbour.
    family = components(live.where("label != least").select(F.col("label").alias("a"), F.col("least").alias("b")).distinct())
    out = live.select("node", "label").distinct().join(family.select(F.col("node").alias("label"), F.col("label").alias("family")), "label")
    return store(out, "jaccard-members")


def link_components(docs: DataFrame) -> DataFrame:
    """(node, label) for the classes of `docs` (one row a doc_id) that link with others."""
    kept = kept_signatures(docs)
    tied = ties(kept)
    nodes = tied.select(F.col("a").alias("doc_id"), "best").unionByName(tied.select(F.explode("centers").alias("doc_id"), F.lit(None).cast("long").alias("best")))
    nodes = store(nodes.groupBy("doc_id").agg(F.max("best").alias("best")), "jaccard-nodes")
    sets = docs.join(sized(nodes), "doc_id").select("doc_id", "text", "best").mapInArrow(lean(_pack), "node long, best long, words binary")
    sets = store(sets, "jaccard-sets")

    def linked(verdicts: DataFrame) -> DataFrame:
        return verdicts.where("verdict = 1").select("a", "b").unionByName(whole_links(docs, verdicts.where("verdict = 2").select("a", "b")))

    links = store(linked(compare_stars(sets)), "jaccard-links")
    groups = kept.select(F.col("a").alias("node"), F.explode("kept.rank").alias("rank"))
    labels = components(links)
    for every in (False, True):
        members = open_members(groups, labels)
        more = store(linked(compare_families(sets, members, every)), "jaccard-more")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
        release(members)
    release(kept, tied, nodes, sets)
    return labels


def _set_keys(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, n, k1, k2) of every row, and whether some id is repeated with different sets."""
    keys = store(docs.mapInArrow(lean(_keyed("doc_id")), "doc_id long, n long, k1 long, k2 long"), "jaccard-keys")
    form = F.struct(*SET)
    return keys, not keys.where("doc_id is not null").groupBy("doc_id").agg((F.min(form) != F.max(form)).alias("mixed")).where("mixed").isEmpty()


def _with_texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(lean(_keyed("doc_id", "text")), "doc_id long, text string, n long, k1 long, k2 long")


def _class_labels(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `keys` with the label of their class's component (null for empty sets), where an id may stand for several classes."""
    classes = keys.where("doc_id is not null and n > 0").groupBy(*SET).agg(F.min("doc_id").alias("doc_id"))
    classes = store(store(classes, "jaccard-classes").withColumn("node", F.monotonically_increasing_id()), "jaccard-numbered")
    texts = store(_with_texts(docs).join(classes, ["doc_id", *SET]).select(F.col("node").alias("doc_id"), "text"), "jaccard-texts")
    rows = keys.join(classes.drop("doc_id"), [*SET], "left").join(link_components(texts), "node", "left")
    return store(rows.select("doc_id", *SET, F.coalesce("label", "node").alias("label")), "jaccard-rows")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    keys, mixed = _set_keys(docs)
    if mixed:
        # Rows that repeat an id with several texts tie their classes together.
        rows = _class_labels(docs, keys)
        known = rows.where("doc_id is not null and label is not null")
        least = known.groupBy("label").agg(F.min("doc_id").alias("a"))
        labels = components(store(known.join(least, "label").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct(), "jaccard-ids"))
        out = rows.drop("label").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))
    return _components_by_id(docs, keys)


def _components_by_id(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """jaccard_components where no id is repeated with different sets."""
    classes = keys.where("doc_id is not null").groupBy(*SET).agg(F.min("doc_id").alias("rep"))
    rep = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("rep"))
    keys = store(keys.join(classes, [*SET], "left").select("doc_id", F.col("n").alias("n_shingles"), rep.alias("rep")), "jaccard-classes")
    copies = store(keys.where("doc_id != rep or n_shingles = 0").select("doc_id").distinct(), "jaccard-copies")
    labels = link_components(by_ids(docs.where("doc_id is not null"), copies, "left_anti"))
    out = keys.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep")).alias("component_id"))


def near_duplicates_removed(docs: DataFrame) -> DataFrame:
    """The documents without all but the first of each group; columns as they came.

    Rows that repeat an id with different texts are judged each by its own text.
    """
    slim = docs.select("doc_id", "text")
    keys, mixed = _set_keys(slim)
    if not mixed:
        found = _components_by_id(slim, keys).where("doc_id != component_id").select("doc_id").distinct()
        return by_ids(docs, store(found, "jaccard-dropped"), "left_anti").select(*docs.columns)
    rows = _class_labels(slim, keys).where("doc_id is not null and label is not null")
    row = F.struct("doc_id", *SET)
    lost = rows.join(rows.groupBy("label").agg(F.min(row).alias("first")), "label").where(row != F.col("first")).select("doc_id", *SET).distinct()
    sha = lambda text: F.sha2(F.coalesce(text, F.lit("")), 256)
    lost = _with_texts(slim).join(store(lost, "jaccard-lost"), ["doc_id", *SET]).select("doc_id", sha(F.col("text")).alias("sha")).distinct()
    lost = store(lost, "jaccard-dropped")
    return docs.join(lost, (docs["doc_id"] == lost["doc_id"]) & (sha(docs["text"]) == lost["sha"]), "left_anti").select(*docs.columns)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b WHERE 100 * c.n >= 75 * (len(x.s) + len(y.s) - c.n)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (WITH RECURSIVE r(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.root AS component_id FROM s JOIN r ON r.node = s.doc_id
"""
