"""SimHash near-dedup with pigeonring filtering.

``near_groups`` links by one 64-bit fingerprint of 4-word shingles. ``similar_groups`` links by the
similarity of 5-word shingle sets: near fingerprints propose first, then shared rare shingles propose all
pairs that are left, and an exact check decides.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestary.llm.common import unfolded, whole, worker_state
from attestary.llm.components import components
from attestary.session import stage, unstage

BITS = 64
CHUNK = 1 << 16  # shingle hashes counted at once
SEGMENT_SHIFT = 58  # a bucket's number: the chain's first segment above its key bits
NOBODY = 2 ** 63 - 1  # a null id stands behind all others
WORDS = 100_000  # words whose hashes a worker process remembers
APART = [1, 2, 16, 256]  # places of two sets in their bucket from which a round of proposals begins
EPS = 1e-9
COUNTERS, COUNTER_CHUNK = 1 << 20, 1 << 15  # hashed counters of shingles, whatever the corpus; sent in chunks


def simhash(text: str | None, shingle: int, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number: a bit is set where over half of the shingle hashes set it.

    A-Z in lower case; words are runs other than the six ASCII blanks; with fewer words than a
    shingle has, the whole sequence is the one shingle; without words the fingerprint is 0.
    """
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks divide
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, CHUNK):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], seed)
                  for a, b in zip(starts[i:min(n, i + CHUNK)].tolist(), last[i:i + CHUNK].tolist())]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")
    return run(text)


def _segments(max_bits: int) -> tuple[list[int], list[int]]:
    """Start and width of the ``max_bits + 1`` segments on the ring of 64 bits."""
    if not 2 <= max_bits < 32:
        raise ValueError("max_bits must be in 2..31")
    edges = [round(i * BITS / (max_bits + 1)) for i in range(max_bits + 2)]
    return edges[:-1], [b - a for a, b in zip(edges, edges[1:])]


def _keys(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and fingerprint rows: what a chain that begins at each segment can hold.

    With one segment more than differences allowed, the budget of a chain of n segments is n - 1
    differences. So a chain's first segment is equal and its second differs in one bit at most:
    both are the bucket, and a fingerprint also enters the buckets in which one 0 of its second
    segment is 1, to meet those that differ there.
    """
    starts, widths = _segments(max_bits)
    one, buckets, values = np.uint64(1), [], []
    for i, (start, width) in enumerate(zip(starts, widths)):
        j = (i + 1) % len(starts)
        first = (prints >> np.uint64(start)) & np.uint64((1 << width) - 1)
        second = (prints >> np.uint64(starts[j])) & np.uint64((1 << widths[j]) - 1)
        base = (np.uint64(i) << np.uint64(SEGMENT_SHIFT)) | (first << np.uint64(widths[j]))
        buckets.append(base | second)
        values.append(prints)
        for b in range(widths[j]):
            zero = (second >> np.uint64(b)) & one == 0
            buckets.append((base | second | (one << np.uint64(b)))[zero])
            values.append(prints[zero])
    return np.concatenate(buckets), np.concatenate(values)


def _chain_masks(max_bits: int) -> list[list[int]]:
    """For each first segment: the bits of its chains of 3, 4, ... segments."""
    starts, widths = _segments(max_bits)
    m = len(starts)
    out = []
    for i in range(m):
        mask, masks = 0, []
        for n in range(m):
            k = (i + n) % m
            mask |= ((1 << widths[k]) - 1) << starts[k]
            masks.append(mask)
        out.append(masks[2:])
    return out


def _span(run: np.ndarray, masks: list[int]) -> tuple[list[int], list[int]]:
    """Links that join whatever in one bucket is linked, at most one fewer than it has members.

    Each member met is compared with those not yet linked to anything met: a chain that exceeds its
    budget ends the comparison, what passes them all is within the full Hamming budget.
    """
    rest, left, right = np.unique(run), [], []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.arange(len(rest))
            for n, mask in enumerate(masks):
                near = near[np.bitwise_count((rest[near] ^ x) & np.uint64(mask)) <= n + 2]
                if not len(near):
                    break
            if len(near):
                hits = rest[near]
                left += [int(x)] * len(hits)
                right += hits.tolist()
                front += list(hits)
                rest = np.delete(rest, near)
    return left, right


def _bucket_rows(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(prints), CHUNK):
                buckets, values = _keys(prints[i:i + CHUNK], max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets.view(np.int64)), pa.array(values.view(np.int64))], ["bucket", "print"])
    return run


def _bucket_links(max_bits: int):
    chains = _chain_masks(max_bits)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_b, kept_p = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(b: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            left, right = [], []
            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
            for s, e in zip(edge[:-1][np.diff(edge) > 1].tolist(), edge[1:][np.diff(edge) > 1].tolist()):
                u, v = _span(p[s:e].view(np.uint64), chains[int(b[s]) >> SEGMENT_SHIFT])
                left += u
                right += v
            ends = [np.array(x, dtype=np.uint64).view(np.int64) for x in (left, right)]
            return pa.RecordBatch.from_arrays([*map(pa.array, ends)], ["u", "v"])

        for batch in batches:
            b = np.concatenate([kept_b, batch.column(0).to_numpy()])
            p = np.concatenate([kept_p, batch.column(1).to_numpy()])
            if not len(b):
                continue
            cut = int(np.searchsorted(b, b[-1]))  # the last bucket may go on
            yield links(b[:cut], p[:cut])
            kept_b, kept_p = b[cut:], np.unique(p[cut:])
            kept_b = kept_b[:len(kept_p)]
        yield links(kept_b, kept_p)
    return run


def near_links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links ``u, v`` that connect the same fingerprints as all pairs at ``max_bits`` or fewer would.

    ``prints``: distinct ``print``. Not every pair is given: a bucket gives a spanning forest of its
    links, so a large group of near copies costs no quadratic output.
    """
    rows = prints.select("print").mapInArrow(_bucket_rows(max_bits), "bucket long, print long")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_bucket_links(max_bits), "u long, v long").distinct()


def near_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, row, print, component_id`` of every document: ``component_id`` is the smallest id
    reachable over links between fingerprints, the document's own included.

    Fingerprints are made distinct before they are linked, so exact copies cost one row. ``row`` is
    the hash of the text. Nulls: a null text has no words (fingerprint 0, linked like any other); a
    null id is never a component's smallest unless it has no other. Very long texts are hashed in
    chunks; repeated rows are in one component; other columns are ignored.
    """
    rows = stage(docs.select("doc_id", F.xxhash64("text").alias("row"),
                             fingerprint(F.col("text"), shingle).alias("print")), "prints")
    least = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    least = stage(least, "distinct-prints")
    roots = components(near_links(least.select("print"), max_bits))
    rooted = (least.join(roots.withColumnRenamed("node", "print"), "print", "left")
              .withColumn("root", F.coalesce("root", "print")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("print", "root", "component_id")
    return rows.join(named, "print").select("doc_id", "row", "print", "root", "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One document of each component stays, with all its columns: that of the smallest id.

    Where rows share that id, the one with the smallest text hash stays. A component of null ids
    only keeps one of them.
    """
    groups = near_groups(docs, shingle, max_bits)
    nobody = F.lit(2 ** 63 - 1)
    first = groups.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", nobody).alias("_id"), "row")).alias("m"))
    keep = first.select("root", F.col("m._id").alias("id"), F.col("m.row").alias("row"))
    rows = docs.select(whole(docs), F.coalesce("doc_id", nobody).alias("id"), F.xxhash64("text").alias("row"))
    kept = rows.join(keep, ["id", "row"]).dropDuplicates(["id", "row", "root"])
    return unfolded(kept, docs)


# --- similarity of shingle sets ---------------------------------------------------------------

class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 42)
        if len(self) < WORDS:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """A hash of every run of ``shingle`` words, or of the whole sequence if it is shorter."""
    known = worker_state("simhash-words", _WordHashes)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(shingle, len(h))
    total = np.zeros(max(0, len(h) - k + 1) if k else 0, dtype=np.uint64)
    for i in range(k):
        total = _mixed(total + h[i:i + len(total)])
    return total


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order; none for a text without words."""
    return np.unique(shingle_hashes((text or "").encode().lower().split(), shingle))


def prefix_length(size: int | np.ndarray, similarity: float) -> int | np.ndarray:
    """How many of a set's elements, the first in any order common to all sets, hold one of every set as similar."""
    return np.where(size, size - np.ceil(similarity * size - EPS) + 1, 0).astype(np.int64)


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes as a signed 64-bit number."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        octets = hashes[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def shingle_ranks(docs: DataFrame, shingle: int) -> np.ndarray:
    """How often a shingle stands in the sets of all documents, as one of ``COUNTERS`` small ranks.

    A shingle's counter is its hash modulo their number, and a rank is the counter's logarithm, so the
    table has the same size for any corpus. Only the order of a set's shingles depends on it, and any
    order common to all sets is as good for results; this one sets frequent shingles last.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype="<u4")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, (shingle_set(text, shingle) % np.uint64(COUNTERS)).astype(np.int64), np.uint32(1))
        for i in range(0, COUNTERS, COUNTER_CHUNK):
            part = counts[i:i + COUNTER_CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([zlib.compress(part.tobytes(), 1)])], ["start", "counts"])

    def total(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTER_CHUNK, dtype=np.int64)
        for batch in parts:
            for part in batch.column("counts").to_pylist():
                counts += np.frombuffer(zlib.decompress(part), "<u4")
        ranks = np.minimum(255, 6 * np.log2(counts + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([ranks.tobytes()])], ["start", "ranks"])

    sums = docs.select("text").mapInArrow(count, "start long, counts binary").groupBy("start").applyInArrow(
        total, "start long, ranks binary")
    ranks = np.zeros(COUNTERS, dtype=np.uint8)
    for r in sums.collect():  # COUNTERS bytes
        ranks[r.start:r.start + COUNTER_CHUNK] = np.frombuffer(r.ranks, np.uint8)
    return ranks


def _similar_sketch(shingle: int, similarity: float, ranks: np.ndarray):
    @F.pandas_udf("key string, size int, print long, prefix array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            members = shingle_set(t, shingle)
            rare = np.argsort(ranks[(members % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")
            prefix = members[rare[:int(prefix_length(len(members), similarity))]]
            out.append((hashlib.blake2b(members.tobytes(), digest_size=16).hexdigest(), len(members), print_of(members), prefix.view(np.int64)))
        return pd.DataFrame(out, columns=["key", "size", "print", "prefix"])
    return run


def _sets(shingle: int):
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts], dtype=object)
    return run


def _bucket_pairs(low: int, high: int | None, similarity: float):
    """Pairs ``u, v`` of different roots in one bucket whose places, by size, are ``low`` to ``high`` - 1 apart."""
    def pairs(node: np.ndarray, size: np.ndarray, at: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        def may(i, j) -> np.ndarray:
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            # no more is shared than stands from here on, if this shingle is the first that is shared
            most = np.minimum(size[i] - at[i], size[j] - at[j])
            return ((root[i] != root[j]) & (small >= similarity * large - EPS)
                    & (most * (1 + similarity) >= similarity * (small + large) - EPS))

        m = len(node)
        if high is not None:
            for d in range(low, min(high, m)):
                i = np.arange(m - d)
                i = i[may(i, i + d)]
                yield node[i], node[i + d]
            return
        names, which, n = np.unique(root, return_inverse=True, return_counts=True)
        rest = which != np.argmax(n)  # one of each pair stands outside the largest group
        for i in np.flatnonzero(rest).tolist():
            j = np.flatnonzero(~rest | (np.arange(m) > i))
            j = j[np.abs(j - i) >= low]
            j = j[may(np.full(len(j), i), j)]
            yield np.full(len(j), node[i]), node[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 5

        def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, held, n = columns[0], [], 0
            edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            for s, e in zip(edge[:-1][np.diff(edge) > 1].tolist(), edge[1:][np.diff(edge) > 1].tolist()):
                for u, v in pairs(*[c[s:e] for c in columns[1:]]):
                    held.append((np.minimum(u, v), np.maximum(u, v)))
                    n += len(u)
                    if n >= CHUNK:
                        yield batch_of(held)
                        held, n = [], 0
            if n:
                yield batch_of(held)

        def batch_of(held: list) -> pa.RecordBatch:
            both = np.unique(np.stack([np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held])]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])

        for batch in batches:
            columns = [np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept)]
            if not len(columns[0]):
                continue
            cut = int(np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))[-1])  # the last bucket may go on
            yield from found([c[:cut] for c in columns])
            kept = [c[cut:] for c in columns]
        yield from found(kept)
    return run


def shared_prefixes(nodes: DataFrame, similarity: float) -> DataFrame:
    """``token, node, size, at`` of the prefixes of ``nodes(node, size, prefix)``: a set's rarest shingles, as many as
    hold one of every set as similar; ``at`` is the shingle's place in the set, rarest first. Rows without a
    neighbour of fitting size under the same token are left out."""
    rows = nodes.select("node", F.col("size").cast("long").alias("size"), F.posexplode("prefix").alias("at", "token"))
    by_size = Window.partitionBy("token").orderBy("size", "node")
    fits = ((F.lag("size").over(by_size) >= F.col("size") * similarity - EPS)
            | (F.col("size") >= F.lead("size").over(by_size) * similarity - EPS))
    return rows.withColumn("fits", fits).where("fits").select("token", "node", "size", F.col("at").cast("long").alias("at"))


def print_pairs(nodes: DataFrame) -> DataFrame:
    """``u, v`` to check first: nodes of equal fingerprints with the smallest of these, and the smallest of fingerprints
    that pigeonring chains link."""
    rows = nodes.where("size > 0").select("node", "print")
    hubs = stage(rows.groupBy("print").agg(F.min("node").alias("hub")), "hubs")
    equal = rows.join(hubs, "print").where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    links = near_links(hubs.select("print"))
    for end in ("u", "v"):
        links = links.join(hubs.select(F.col("print").alias(end), F.col("hub").alias(f"_{end}")), end).drop(end)
    return equal.union(links.select(F.least("_u", "_v"), F.greatest("_u", "_v")))


def similar_pairs(proposed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ``proposed(u, v)`` whose sets are similar. Only the sets of proposed nodes are moved: each once to
    its partner, and once to where those meet."""
    held = sets.join(proposed.select(F.col("v").alias("node")).distinct(), "node", "left_semi")
    pairs = (sets.select(F.col("node").alias("u"), F.col("members").alias("_a")).join(proposed, "u")
             .join(held.select(F.col("node").alias("v"), F.col("members").alias("_b")), "v"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.where(both >= F.lit(similarity) * (F.size("_a") + F.size("_b") - both) - EPS).select("u", "v")


def similar_roots(rows: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``key, root`` of the keys of ``rows(id, row, key, size, print, prefix)`` that have a similar one.

    Pairs of near fingerprints are checked first: they join most copies. Then every pair that similar
    shares one of the first shingles of both, in an order common to all sets: these are the buckets. Each
    round proposes pairs of one bucket that confirmed links do not join yet, neighbours by size first,
    all that are left last, and the sets decide.
    """
    keys = rows.groupBy("key").agg(F.min(F.struct("id", "row")).alias("at"), *[F.first(c).alias(c) for c in ("size", "print", "prefix")])
    nodes = stage(keys.select("key", "at.id", "at.row", "size", "print", "prefix", F.monotonically_increasing_id().alias("node")), "shingle-sets")
    prefixes = stage(shared_prefixes(nodes, similarity), "prefixes")
    by_print = stage(print_pairs(nodes).distinct(), "proposed")
    asked = prefixes.select("node").union(by_print.select("u")).union(by_print.select("v")).distinct()
    places = stage(nodes.join(asked, "node", "left_semi").select("node", "key", "id", "row"), "asked")
    texts = docs.select(F.coalesce("doc_id", F.lit(NOBODY)).alias("id"), F.xxhash64("text").alias("row"), "text")
    sets = texts.join(places, ["id", "row"]).dropDuplicates(["node"]).select("node", _sets(shingle)("text").alias("members"))
    sets = stage(sets, "members")
    links = stage(similar_pairs(by_print, sets, similarity), "similar")
    roots = stage(components(links), "roots")
    for low, high in zip(APART, [*APART[1:], None]):
        held = (prefixes.join(roots.withColumnRenamed("root", "_root"), "node", "left")
                .select("token", "node", "size", "at", F.coalesce("_root", "node").alias("root")))
        several = held.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
        held = held.join(several, "token", "left_semi")
        held = held.repartition("token").sortWithinPartitions("token", "size", "node")
        proposed = stage(held.mapInArrow(_bucket_pairs(low, high, similarity), "u long, v long").distinct(), "proposed")
        if proposed.isEmpty() and high is None:
            break
        similar = stage(similar_pairs(proposed, sets, similarity), "similar")
        if not similar.isEmpty():
            before = roots  # it joins what all earlier links join, so fewer rounds of stars are left
            roots = stage(components(before.toDF("u", "v").union(similar)), "roots")
            unstage(before)
        unstage(proposed)
    unstage(sets, prefixes, by_print)
    top = places.select(F.col("node").alias("root"), F.col("key").alias("top"))
    return places.select("key", "node").join(roots, "node").join(top, "root").select("key", F.col("top").alias("root"))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id, row, root`` of every document: those of one ``root`` reach each other over similar texts.

    Texts are similar if the Jaccard similarity of their sets of ``shingle``-word shingles is
    ``similarity`` or more. Every such pair is compared on the whole sets unless confirmed links join
    it already, so the groups are those of all pairs.

    Equal sets are one node, so copies cost one row. Nulls: a null text has no words; texts without
    words are alike and like no other. ``id`` is ``doc_id`` (null ids behind all others), ``row`` the hash
    of the text. Repeated rows share a root; other columns are ignored; an empty table gives no rows.
    """
    ranks = shingle_ranks(docs, shingle)
    rows = docs.select(F.coalesce("doc_id", F.lit(NOBODY)).alias("id"), F.xxhash64("text").alias("row"),
                       _similar_sketch(shingle, similarity, ranks)("text").alias("s"))
    rows = stage(rows.select("id", "row", "s.*"), "sketches")
    roots = stage(similar_roots(rows, docs, shingle, similarity), "similar-roots")
    return (rows.select("id", "row", "key").join(roots, "key", "left")
            .select("id", "row", F.coalesce("root", "key").alias("root")))


def keep_one_of_similar(docs: DataFrame, **settings) -> DataFrame:
    """One document of each group of similar texts stays, with all its columns: that of the smallest id;
    where rows share that id, the one with the smallest text hash. ``settings`` go to ``similar_groups``."""
    groups = similar_groups(docs, **settings)
    first = groups.groupBy("root").agg(F.min(F.struct("id", "row")).alias("m"))
    keep = first.select(F.col("m.id").alias("id"), F.col("m.row").alias("row"))
    rows = docs.select(whole(docs), F.coalesce("doc_id", F.lit(NOBODY)).alias("id"), F.xxhash64("text").alias("row"))
    return unfolded(rows.join(keep, ["id", "row"]).dropDuplicates(["id", "row"]), docs)
