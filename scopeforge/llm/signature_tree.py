"""Shingle Jaccard join by signature trees (operator 8).

1. ``document_sets``: size, 64-bit signature and token bitmap of each document's set of
   shingles; equal sets are one node from here on, so groups of copies never meet again.
2. ``candidate_lists``: two sets with Jaccard >= t differ in fewer than m elements, with m
   from their size class; of m parts of the hash space they hold at least one alike.  Part
   keys are shuffled in packed form by key range; the nodes that share a key are a list.
   Every link lies inside a list.
3. ``survivors``: sets of a list are leaves of a signature tree, whose nodes hold the OR of
   the token bitmaps and the size range of what is below.  A dual traversal drops node pairs
   whose largest possible overlap is too small.  Only bitmaps are shuffled for it, a few bits
   an element; what survives joins nodes to groups.
4. ``links``: the sets of a group meet in one task as packed hashes (large groups as pairs of
   blocks), are traversed again, and pairs that are not connected yet are verified on the
   sets themselves.  A task returns a spanning forest, not all pairs.
5. components over the forests.

Null, empty and wordless texts: size 0, linked with nothing.  Repeated rows and ids: the
rows are kept; an id's component is the smallest id of its row's set.  Null ids never
name a component.  Only the named columns are read.  Empty table: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeforge.operators.skew import broadcast_if_small
from scopeforge.session import materialize

from .common import gram_hashes, inside, lower_ascii, mix, sized, span_hashes, table, text_buffer, text_slices, words_of
from .components import connected, forest

SHINGLE, SIMILARITY = 3, 0.9
#: Keys of a range that one task sorts, and the least number of ranges.
RANGE_KEYS, LEAST_RANGES = 1_000_000, 16
#: Keys that a map task holds before it hands them on.
HELD_KEYS = 300_000
#: Ways to deal a set's elements to parts.
WAYS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
#: Nodes, bytes of bitmaps and shingles of a block, and about those that small lists or groups bring together.
BLOCK_NODES, BLOCK_BYTES, BLOCK_SHINGLES = 2048, 4 << 20, 400_000
#: Bits of a bitmap are at least twice the elements, up to this power of two.
MOST_BITS = 16
#: Bytes of group members that are broadcast to find their texts.
MEMBER_BYTES = 32 << 20
FANOUT = 8


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the size of each set.

    A text of fewer than ``k`` words has one shingle, its word sequence."""
    starts, ends, n_words = words_of(buf, off)
    words = span_hashes(buf, starts, ends)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    at = np.flatnonzero(inside(n_words, k))
    grams, owners = [gram_hashes(words, k)[at]], [owner[at]]
    first = np.cumsum(n_words) - n_words
    for size in range(1, k):
        short = np.flatnonzero(n_words == size)
        if len(short):
            grams.append(gram_hashes(words, size)[first[short]])
            owners.append(short)
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(gram)
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]  # at most 65,536 texts
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[new], np.bincount(owner[new], minlength=len(n_words))


def _signatures(gram: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(gram), dtype=np.uint64)])
    ends = np.cumsum(size)
    return mix(total[ends] - total[ends - size] + size.astype(np.uint64)).view(np.int64)


def bit_powers(size: np.ndarray) -> np.ndarray:
    """The power of two of each bitmap's bits."""
    return np.clip(np.ceil(np.log2(np.maximum(2 * size, 1))), 6, MOST_BITS).astype(np.int64)


def bitmaps(gram: np.ndarray, size: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of the bitmaps of all sets, and how many each has; the low bits of a
    hash are its place, so that a larger bitmap folds to a smaller one."""
    words = np.where(size > 0, 1 << np.maximum(power - 6, 0), 0)
    owner = np.repeat(np.arange(len(size)), size)
    bit = gram & ((np.uint64(1) << power.astype(np.uint64)) - np.uint64(1))[owner]
    flags = np.zeros(int(words.sum()), np.uint64)
    first = np.cumsum(words) - words
    np.bitwise_or.at(flags, first[owner] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return flags, words


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of 64-bit values as binary."""
    offsets = np.concatenate([[0], np.cumsum(counts) * 8])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [
        None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def document_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, th, n_shingles, sig, bits); ``th`` tells the texts of a repeated id apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                buf, off = text_buffer(part.column("text"))
                gram, size = shingle_sets(lower_ascii(buf), off, k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(size.astype(np.int64)),
                     pa.array(_signatures(gram, size)), binary_rows(*bitmaps(gram, size, bit_powers(size)))],
                    names=["doc_id", "th", "n_shingles", "sig", "bits"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        run, f"doc_id {kind}, th long, n_shingles long, sig long, bits binary")


def part_keys(gram: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set, and how many each set has.

    Sizes fall into classes as wide as the similarity allows two linked sets to differ, so
    linked sets are of one class or of neighbours.  A set takes part in the scheme of its
    class as an upper and in the next as a lower member.  In scheme s with largest size U
    linked sets (not both upper) differ in at most d = (1 - t) U elements, which touch at
    most d parts.  A set with elements in more than d parts therefore shares one of them
    with every linked set.  The few sets with fewer are dealt to parts again in another way,
    among themselves; what is left after the last way meets by elements: of two linked sets,
    one of the first d + 1 elements of each, in one order of all, is the same."""
    width = math.log(1 / similarity) * 1.0001
    owner = np.repeat(np.arange(len(size)), size)
    base = np.zeros(len(size), np.int64)
    some = size > 0
    base[some] = np.floor(np.log(size[some]) / width).astype(np.int64)
    keys, owners = [], []
    for scheme in (base, base + 1):
        differ = np.floor((1 - similarity) * np.exp((scheme + 1) * width) + 1e-6).astype(np.int64)
        own, who, active = gram, owner, some
        for way in WAYS:
            spread = mix(own + np.uint64(way))
            parts = np.where(active, differ + 1 + -(-differ // 10), 0)
            ends = np.cumsum(parts)
            cell = (ends - parts)[who] + (spread % parts[who].astype(np.uint64)).astype(np.int64)
            sums = np.zeros(int(parts.sum()), np.uint64)
            np.add.at(sums, cell, own)
            holder = np.repeat(np.arange(len(size)), parts)
            part = np.arange(len(sums)) - np.repeat(ends - parts, parts)
            label = (scheme[holder] * 1_000_003 + part).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(way)
            full = sums != 0
            keys.append(mix(mix(sums[full]) + label[full]))
            owners.append(holder[full])
            active = active & (np.bincount(holder[full], minlength=len(size)) <= differ)
            left = active[who]
            own, who = own[left], who[left]
            if not len(own):
                break
        else:
            order = np.lexsort((mix(own), who))
            own, who = own[order], who[order]
            n = np.bincount(who, minlength=len(size))
            rank = np.arange(len(own)) - (np.cumsum(n) - n)[who]
            early = rank <= differ[who]
            keys.append(mix(own[early] + mix(scheme[who[early]].astype(np.uint64) + np.uint64(0x6A09E667F3BCC909))))
            owners.append(who[early])
    key, who = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return key[order], np.bincount(who, minlength=len(size))


def candidate_lists(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(list, sig): the signatures of sets that share a part key.  Keys with the same sets make one list."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word of about six bytes is a shingle; a set has about 2.5 (1 - t) keys per shingle
    ranges = sized(int(total / 6 * 2.5 * (1 - similarity)), RANGE_KEYS, LEAST_RANGES)
    shift = np.uint64(32)

    def keys(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size_held = 0

        def hand_on():
            key = np.concatenate([h[0] for h in held])
            sig = np.concatenate([h[2] for h in held])
            at = np.cumsum([len(h[2]) for h in held]) - [len(h[2]) for h in held]
            who = np.concatenate([h[1] + a for h, a in zip(held, at)]).astype(np.uint32)
            lane = ((key >> shift) * np.uint64(ranges) >> shift).astype(np.int64)
            order = np.argsort(lane, kind="stable")
            cuts = np.searchsorted(lane[order], np.arange(ranges + 1))
            for r in range(ranges):
                own = order[cuts[r]:cuts[r + 1]]
                if len(own):
                    used, index = np.unique(who[own], return_inverse=True)
                    index = index.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                    yield pa.record_batch({"lane": pa.array([r], pa.int32()), "keys": pa.array([key[own].tobytes()]),
                                           "who": pa.array([index.tobytes()]), "sigs": pa.array([sig[used].tobytes()])})

        for batch in batches:
            for part in text_slices(batch, "text"):
                buf, off = text_buffer(part.column("text"))
                gram, size = shingle_sets(lower_ascii(buf), off, k)
                sig = _signatures(gram, size)
                one = np.zeros(len(size), bool)
                one[np.unique(sig, return_index=True)[1]] = True
                gram, size, sig = gram[np.repeat(one, size)], size[one], sig[one]
                key, n = part_keys(gram, size, similarity)
                held.append((key, np.repeat(np.arange(len(n)), n), sig))
                size_held += len(key)
                if size_held >= HELD_KEYS:
                    yield from hand_on()
                    held, size_held = [], 0
        if size_held:
            yield from hand_on()

    def shared(group: pa.Table) -> pa.Table:
        key, sig = [], []
        for keys_, who, sigs in zip(*(group[c] for c in ("keys", "who", "sigs"))):
            own = np.frombuffer(keys_.as_buffer(), np.uint64)
            index = np.frombuffer(who.as_buffer(), np.uint16 if len(who.as_buffer()) == 2 * len(own) else np.uint32)
            key.append(own)
            sig.append(np.frombuffer(sigs.as_buffer(), np.int64)[index])
        key, sig = np.concatenate(key), np.concatenate(sig)
        order = np.argsort(key)
        key, sig = key[order], sig[order]
        same = key[1:] == key[:-1]
        both = np.zeros(len(key), bool)
        both[1:] = same
        both[:-1] |= same
        key, sig = key[both], sig[both]
        order = np.lexsort((sig, key))
        key, sig = key[order], sig[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        key, sig = key[new], sig[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(key)))
        name = np.add.reduceat(mix(sig.view(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
        name = mix(name + n.astype(np.uint64))
        once = np.zeros(len(first), bool)
        once[np.unique(name, return_index=True)[1]] = True
        once &= n > 1
        kept = np.repeat(once, n)
        return pa.table({"list": np.repeat(name.view(np.int64)[once], n[once]), "sig": sig[kept]})

    packed = docs.select("text").mapInArrow(keys, "lane int, keys binary, who binary, sigs binary")
    return packed.groupBy("lane").applyInArrow(shared, "list long, sig long").distinct()


class SignatureTree:
    """Leaves in order of size; each node above holds the OR of the bitmaps and the size
    range of ``FANOUT`` nodes below, and the most elements that bitmaps of its leaves lose
    to equal bits."""

    def __init__(self, flags: np.ndarray, size: np.ndarray):
        self.size = size
        lost = size - np.bitwise_count(flags).sum(1, dtype=np.int64)
        self.levels = [(flags, size, size, lost)]
        while len(self.levels[-1][0]) > FANOUT:
            flags, low, high, lost = self.levels[-1]
            at = np.arange(0, len(flags), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(flags, at, axis=0), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))


def traverse(a: SignatureTree, b: SignatureTree | None, similarity: float):
    """Leaf pairs (i of ``a``, j of ``b`` or of ``a`` itself with i < j) that may be similar enough."""
    own = b is None
    other = a if own else b
    # both trees are walked from their own roots; the lower one waits at its root
    da, db = len(a.levels) - 1, len(other.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[da][0])), np.arange(len(other.levels[db][0])),
                                           indexing="ij"))
    if own:
        i, j = i[i <= j], j[i <= j]
    share = similarity / (1 + similarity)
    width = min(a.levels[0][0].shape[1], other.levels[0][0].shape[1])

    chunk = max(64, (1 << 20) // width)

    def fold(flags: np.ndarray) -> np.ndarray:
        """Bitmaps of ``width`` words: the low bits of a hash place it in either size."""
        return flags if flags.shape[1] == width else np.bitwise_or.reduce(
            flags.reshape(len(flags), -1, width), axis=1)

    def losses(level: int, tree: SignatureTree) -> np.ndarray:
        flags, _, high, lost = tree.levels[level]
        return lost if flags.shape[1] == width else high  # a folded bitmap bounds nothing by itself

    while True:
        fa, la, ha, _ = a.levels[da]
        fb, lb, hb, _ = other.levels[db]
        xa, xb, sa, sb = fold(fa), fold(fb), losses(da, a), losses(db, other)
        keep = []
        for at in range(0, len(i), chunk):
            p, q = i[at:at + chunk], j[at:at + chunk]
            common = np.bitwise_count(xa[p] & xb[q]).sum(1, dtype=np.int64)
            most = np.minimum(np.minimum(common + np.minimum(sa[p], sb[q]), ha[p]), hb[q])
            near = np.minimum(ha[p], hb[q]) >= similarity * np.maximum(la[p], lb[q]) - 1e-9
            keep.append(near & (most >= share * (la[p] + lb[q]) - 1e-9))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        if da == 0 and db == 0:
            return (i[i < j], j[i < j]) if own else (i, j)
        step = np.arange(FANOUT)
        if da >= db:
            i = (i[:, None] * FANOUT + step).ravel()
            j = np.repeat(j, FANOUT)
            ok = i < len(a.levels[da - 1][0])
            i, j, da, was = i[ok], j[ok], da - 1, da
        else:
            was = -1
        if db and (db == was or was == -1):
            i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + step).ravel()
            ok = j < len(other.levels[db - 1][0])
            i, j, db = i[ok], j[ok], db - 1
        if own:
            i, j = i[i <= j], j[i <= j]


def join_group(gram: np.ndarray, size: np.ndarray, block: np.ndarray | None, similarity: float) -> np.ndarray:
    """Component label (smallest place) of each set.  With ``block`` (of two blocks) only
    pairs across the blocks are compared."""
    n = len(size)
    order = np.argsort(size, kind="stable")
    start = np.cumsum(size) - size
    token = np.unique(gram, return_inverse=True)[1]
    parent = np.arange(n)

    def places(sets: np.ndarray) -> np.ndarray:
        """Places in ``gram`` of the elements of several sets."""
        ends = np.cumsum(size[sets])
        return np.repeat(start[sets] - (ends - size[sets]), size[sets]) + np.arange(int(ends[-1]))

    def tree(sets: np.ndarray) -> SignatureTree:
        power = np.full(len(sets), min(MOST_BITS, int(4 * size[sets].max()).bit_length()))
        power = np.maximum(power, 6)
        return SignatureTree(bitmaps(gram[places(sets)], size[sets], power)[0].reshape(len(sets), -1), size[sets])

    def roots(sets: np.ndarray) -> np.ndarray:
        at = parent[sets]
        while (parent[at] != at).any():
            at = parent[at]
        return at

    if block is None:
        left = right = order
        i, j = traverse(tree(order), None, similarity)
    else:
        left, right = order[block[order] == 0], order[block[order] == 1]
        if not len(left) or not len(right):
            return parent
        i, j = traverse(tree(left), tree(right), similarity)
    by = np.argsort(i, kind="stable")
    i, j = left[i[by]], right[j[by]]
    percent = round(similarity * 100)
    flag = np.zeros(int(token.max()) + 1, bool)
    for own in np.split(j, np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
        x, i = i[0], i[len(own):]
        own = own[roots(own) != roots(np.array([x]))]
        if not len(own):
            continue
        mine = token[start[x]:start[x] + size[x]]
        flag[mine] = True
        at = np.cumsum(size[own]) - size[own]
        both = np.add.reduceat(flag[token[places(own)]], at, dtype=np.int64)
        flag[mine] = False
        linked = own[100 * both >= percent * (size[x] + size[own] - both)]
        if len(linked):
            joined = roots(np.append(linked, x))
            parent[joined] = joined.min()
    return roots(np.arange(n))


def _sharded(members: DataFrame, group: str, weight: int, amounts: list[tuple]) -> DataFrame:
    """``members`` (``group``, node, ...) with the ``shard`` where they meet and their ``side``: small
    groups together (side -1), large ones as pairs of blocks.  ``amounts``: (column, most of a
    block); the first one's sum also packs the small groups."""
    sums = [F.sum(c).alias(f"_{i}") for i, (c, _) in enumerate(amounts)]
    blocks = F.greatest(*[F.ceil(F.col(f"_{i}") / most) for i, (_, most) in enumerate(amounts)], F.lit(1)).cast("int")
    sizes = materialize(members.groupBy(group).agg(*sums).withColumn("blocks", blocks), "group-sizes")
    packs = sized(int(sizes.filter("blocks = 1").agg(F.sum("_0")).first()[0] or 0), weight)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.join(sizes.select(group, "blocks"), group).withColumn("own", own).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "with"), F.greatest("own", "with")
    small = F.pmod(F.xxhash64(group), F.lit(packs)).cast("string")
    side = F.when(lo == hi, F.lit(-1)).otherwise(F.when(F.col("own") == hi, 1).otherwise(0)).cast("int")
    shard = F.when(F.col("blocks") == 1, small).otherwise(F.concat_ws(":", group, lo, hi))
    return members.withColumn("side", side).withColumn("shard", shard).drop("own", "with", "blocks")


def _ordered(group: pa.Table, name: str):
    """(sorted table, rows of each ``name``)."""
    group = group.sort_by([(name, "ascending"), ("node", "ascending")])
    label, node = group[name].to_numpy(), group["node"].to_numpy()
    each = np.split(np.arange(len(label)), np.flatnonzero(np.diff(label)) + 1)
    return group, node, [own[np.concatenate([[True], node[own][1:] != node[own][:-1]])] for own in each]


def _words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit values of a binary column, and how many each row has."""
    buffers = [v.as_buffer() for v in column]
    counts = np.array([b.size // 8 for b in buffers], np.int64)
    return np.concatenate([np.frombuffer(b, np.uint64) for b in buffers]) if buffers else np.zeros(0, np.uint64), counts


def survivors(lists: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): spanning forests of the pairs that the signature trees of the lists leave.

    ``sets``: (sig, n_shingles, bits) of each set."""
    members = lists.withColumnRenamed("sig", "node").join(
        sets.select(F.col("sig").alias("node"), "n_shingles", "bits"), "node").withColumn("weight", F.octet_length("bits"))
    members = _sharded(materialize(members, "list-members"), "list", BLOCK_BYTES,
                       [("weight", BLOCK_BYTES), (F.lit(1), BLOCK_NODES)]).drop("weight")

    def run(group: pa.Table) -> pa.Table:
        group, node, each = _ordered(group, "list")
        size, side = group["n_shingles"].to_numpy(), group["side"].to_numpy()
        flags, words = _words(group["bits"])
        first = np.cumsum(words) - words
        a, b = [], []
        for own in each:
            own = own[np.argsort(size[own], kind="stable")]
            width = int(words[own].min())
            folded = np.stack([np.bitwise_or.reduce(flags[first[i]:first[i] + words[i]].reshape(-1, width), axis=0) for i in own])
            if side[own[0]] < 0:
                left = right = own
                i, j = traverse(SignatureTree(folded, size[own]), None, similarity)
            else:
                here = side[own] == 0
                left, right = own[here], own[~here]
                if not len(left) or not len(right):
                    continue
                i, j = traverse(SignatureTree(folded[here], size[left]), SignatureTree(folded[~here], size[right]), similarity)
            if len(i):
                at, label = forest(left[i], right[j])
                other = at != label
                a.append(node[label[other]])
                b.append(node[at[other]])
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a + none), "b": np.concatenate(b + none)})

    return members.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def packed_sets(docs: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(node, grams): the shingle hashes of the ``wanted`` (doc_id, th, node) documents."""
    few, _ = broadcast_if_small(wanted, max_bytes=MEMBER_BYTES)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(few, ["doc_id", "th"]).select("node", "text")

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                buf, off = text_buffer(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("node"), binary_rows(*shingle_sets(lower_ascii(buf), off, k))],
                                                 names=["node", "grams"])

    return texts.mapInArrow(run, "node long, grams binary").dropDuplicates(["node"])


def links(docs: DataFrame, sets: DataFrame, groups: DataFrame, k: int = SHINGLE,
          similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): spanning forests of the links inside the groups.

    ``sets``: (doc_id, th, sig, n_shingles) with one document of each signature; ``groups``: (node, label)."""
    members = materialize(groups.join(sets.select(F.col("sig").alias("node"), "n_shingles", "doc_id", "th"), "node"), "group-members")
    grams = materialize(packed_sets(docs, members.select("doc_id", "th", "node"), k), "packed-sets")
    dealt = _sharded(members.drop("doc_id", "th"), "label", BLOCK_SHINGLES, [("n_shingles", BLOCK_SHINGLES), (F.lit(1), BLOCK_NODES)])
    dealt = dealt.drop("n_shingles").join(grams, "node")

    def run(group: pa.Table) -> pa.Table:
        group, node, each = _ordered(group, "label")
        side = group["side"].to_numpy()
        gram, size = _words(group["grams"])
        first = np.cumsum(size) - size
        a, b = [], []
        for own in each:
            some = np.concatenate([gram[first[i]:first[i] + size[i]] for i in own])
            found = join_group(some, size[own], side[own] if side[own[0]] >= 0 else None, similarity)
            linked = found != np.arange(len(own))
            a.append(node[own][found[linked]])
            b.append(node[own][linked])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.groupBy("shard").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, n_shingles, component, component_id) of every row of ``docs`` (doc_id, text).

    ``component`` tells components apart that repeated ids would give one name; null without words or id."""
    sets = materialize(document_sets(docs, k), "shingle-sets")
    lists = materialize(candidate_lists(docs, k, similarity), "shingle-lists")
    first = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(
        F.min(F.struct("doc_id", "th", "n_shingles")).alias("d"), F.first("bits").alias("bits"))
    first = materialize(first.select("sig", "d.doc_id", "d.th", "d.n_shingles", "bits"), "first-of-sets")
    groups = connected(materialize(survivors(lists, first, similarity), "shingle-survivors"))
    edges = materialize(links(docs, first.drop("bits"), groups, k, similarity), "shingle-links")
    labels = connected(edges)
    named = materialize(first.select("sig", "doc_id").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "label", F.coalesce("label", "sig")), "shingle-labels")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = materialize(named.join(smallest, "label").select("sig", F.col("label").alias("component"), "component_id"), "shingle-components")
    return sets.drop("bits").join(of_set, "sig", "left").select(
        "doc_id", "th", "n_shingles", "component",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))


def op8_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
