"""Cross-tokenizer alignment: fragments of a text as an associative monoid.

Two tokenizers cut the same bytes. Where tokens of both end, a group closes; tokens whose bytes overlap
are linked. A byte range of a text is a fragment: an open prefix up to its first sure cut, closed groups,
and an open suffix after its last one, or open as a whole. Fragments compose: the suffix of one and the
prefix of the next are encoded together and close.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestary.llm.common import worker_state
from attestary.llm.encoding import BYTE_CHARS
from attestary.session import stage

CHUNK = 1 << 16  # bytes of a fragment; longer texts are dealt over tasks
BLOCK = 1 << 21  # links of documents whose pairs are counted together before they are shuffled
BLOCK_DOCS = 1 << 16
SLICE = 1 << 20  # characters of texts whose new units are encoded together
FAN_IN = 16  # neighbouring fragments one step of the reduction composes
REMEMBERED = 300_000  # units a worker process remembers before it starts anew
SPACE = "\u2581"  # the piece model's blank
SEPARATORS = r"\x1c-\x1f"  # white space to Python, not to the tokenizers
BLANK, INK = rf"[^\S{SEPARATORS}]", rf"[\S{SEPARATORS}]"
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIGNS = ".,;:!?"
CARRIER = " a"  # stands before a sign that is encoded apart from its word


class Part(NamedTuple):
    """Closed groups in a row: their text, token numbers, and the id pair of every link (A id << 32 | B id)."""
    groups: str
    n_a: int
    n_b: int
    n_groups: int
    pairs: np.ndarray
    whole: bool  # both tokenizers give the bytes back


def aligned_tokens(a: np.ndarray, a_bytes: np.ndarray, b: np.ndarray, b_bytes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where groups end in bytes and in tokens of either side, and where links end with the pair of each.

    The bytes between two neighbouring ends of any token belong to one token of each side, and two tokens
    that overlap share the bytes of exactly one such stretch: so stretches are links.
    """
    a_ends, b_ends = np.cumsum(a_bytes), np.cumsum(b_bytes)
    both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    last = np.append(both[1:] != both[:-1], True)
    link_ends, group_ends = both[last], both[~last]
    pairs = (a[np.searchsorted(a_ends, link_ends)] << 32) | b[np.searchsorted(b_ends, link_ends)]
    return group_ends, np.searchsorted(a_ends, group_ends) + 1, np.searchsorted(b_ends, group_ends) + 1, link_ends, pairs


class Units(dict):
    """Parts of units of text, made when first asked for. A unit begins where both tokenizers are sure to cut:
    before white space that follows something else, and before a sign that follows a letter, if no piece
    joins the two. No merge of either crosses such a place."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        super().__init__()
        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True  # their strings are plain text
        byte_of = {chr(BYTE_CHARS.get(b, b)): b for b in range(256)}
        known = {i: bytes(map(byte_of.get, t)) for t, i in self.a.get_vocab(False).items() if set(t) <= byte_of.keys()}
        self.a_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.b_space = self.b.piece_to_id(SPACE)
        # white space that some piece has behind another character is no sure place to cut
        joined = {c for p in names for c in p[1:].replace(SPACE, "") if c.isspace()}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names):
            joined.add(" ")
        self.joined = re.compile(f"[{re.escape(''.join(sorted(joined)))}]" if joined else r"(?!)")
        sure = rf"(?![{re.escape(''.join(sorted(joined)))}]){BLANK}" if joined else BLANK
        signs = "".join(c for c in SIGNS if not any(re.search(f"[{LETTER}]{re.escape(c)}", p) for p in names)) or "(?!)"
        self.signs, sign, run = set(signs), f"[{re.escape(signs)}]" if signs != "(?!)" else signs, f"[{LETTER}]++"
        self.edge = re.compile(rf"(?<={INK})(?={sure})")  # white space alone: where fragments are cut
        self.cut = re.compile(rf"{self.edge.pattern}|(?<=[{LETTER}])(?={sign})")
        other = rf"(?:(?![{LETTER}]){INK})++"
        self.plain = re.compile(rf"{BLANK}*(?:(?:{run}(?!{sign})|{other})+(?:{run}(?={sign}))?|{run}(?={sign}))|{BLANK}+")
        self.chains = re.compile(rf"{sure}[\s\S]*{INK}\Z")  # units that may stand in any order without joining
        self.carried = [len(ids) for ids in self.tokens(CARRIER)]

    def split(self, text: str) -> list[str]:
        """The units of a text that begins at a cut."""
        if not self.joined.search(text):
            return self.plain.findall(text)
        return [u for u in self.cut.split(text) if u]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both for a text that begins at a cut. The piece model sets a blank before whatever it encodes."""
        if text[0] in self.signs:
            a, b = self.tokens(CARRIER + text)
            return a[self.carried[0]:], b[self.carried[1]:]
        a = self.a.encode(text, add_special_tokens=False).ids
        if text == " ":
            return a, [self.b_space]
        return a, self.b.encode(text[1:], num_threads=1) if text[0] == " " else self.b.encode(text, num_threads=1)[1:]

    def learn(self, units: list[str]) -> None:
        """Encode all units as one text, so that both tokenizers and the alignment take them in one step; those that could
        join, and those of a text that does not come back as it was, one by one."""
        chained, rest = [], []
        ink = re.compile(rf"[\s\S]*{INK}\Z")
        for u in units:
            if u[0] in self.signs and ink.match(u):
                chained += [CARRIER, u]
            else:
                (chained if self.chains.match(u) else rest).append(u)
        if chained and not self._learnt(chained):
            rest += chained
        for u in rest:
            if not self._learnt([u]):
                self[u] = ("", 0, 0, 0, b"", False)

    def _learnt(self, units: list[str]) -> bool:
        text = "".join(units)
        raw, (a, b) = text.encode(), self.tokens(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return False
        a_names, b_names = list(map(str, a)), list(map(str, b))
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        group_ends, a_at, b_at, link_ends, pairs = aligned_tokens(a, self.a_sizes[a], b, self.b_sizes[b])
        a_to, b_to = a_at.tolist(), b_at.tolist()
        groups = [f"{','.join(a_names[i:j])}|{','.join(b_names[k:m])}"
                  for i, j, k, m in zip([0, *a_to], a_to, [0, *b_to], b_to)]
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, units)), dtype=np.int64, count=len(units)))
        last = np.searchsorted(group_ends, ends)
        g, n_a, n_b = [0, *(last + 1).tolist()], np.diff(a_at[last], prepend=0).tolist(), np.diff(b_at[last], prepend=0).tolist()
        links, packed = [0, *((np.searchsorted(link_ends, ends) + 1) * 8).tolist()], pairs.astype("<i8").tobytes()
        for i, u in enumerate(units):
            self[u] = (";".join(groups[g[i]:g[i + 1]]), n_a[i], n_b[i], g[i + 1] - g[i], packed[links[i]:links[i + 1]], True)
        return True

    def parts(self, texts: list[str]) -> Iterator[Part]:
        """The closed groups of texts that begin and end at a cut."""
        split = [self.split(t) for t in texts]
        units = set().union(*split)
        new = units.difference(self)
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = units
        if new:
            self.learn(list(new))
        for mine in split:
            if not mine:
                yield Part("", 0, 0, 0, np.empty(0, np.int64), True)
                continue
            groups, n_a, n_b, n_groups, pairs, whole = zip(*map(self.__getitem__, mine))
            yield Part(";".join(groups), sum(n_a), sum(n_b), sum(n_groups), np.frombuffer(b"".join(pairs), "<i8"), all(whole))


class TokenizerPair(NamedTuple):
    """Files of a byte-level tokenizer (A) and of a piece model that sets a blank before the text (B)."""
    byte_level: str
    pieces: str

    def units(self) -> Units:
        return worker_state(f"units:{self.byte_level}:{self.pieces}", lambda: Units(*self))


class Fragment(NamedTuple):
    """What composes: the open ends of a byte range. ``first``: number of the range that holds the first cut;
    without any cut (``open``) all of the text is ``prefix``."""
    open: bool
    prefix: str
    suffix: str
    first: int


def fragment(text: str, number: int, begins: bool, ends: bool, units: Units) -> tuple[Fragment, str]:
    """A byte range as a fragment, and the text between its first and last cut. The ends of a document are cuts."""
    found = [m.start() for m in units.edge.finditer(text)]
    cuts = [0] * begins + found + [len(text)] * ends
    if not cuts:
        return Fragment(True, text, "", number), ""
    return Fragment(False, text[:cuts[0]], text[cuts[-1]:], number), text[cuts[0]:cuts[-1]]


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, tuple[int, str] | None]:
    """Both in a row, and what closes between them: (the range it closes in, text). Associative."""
    if x.open:
        return Fragment(y.open, x.prefix + y.prefix, y.suffix, y.first), None
    if y.open:
        return Fragment(False, x.prefix, x.suffix + y.prefix, x.first), None
    return Fragment(False, x.prefix, y.suffix, x.first), (y.first, x.suffix + y.prefix)


PARTS = ("uid long, at long, open boolean, prefix string, suffix string, groups string, n_a long, n_b long, n_groups long, "
         "whole boolean, pairs array<long>, times array<long>")
PART_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
              pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
PART_NAMES = [c.split()[0] for c in PARTS.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PART_TYPES)], PART_NAMES)


def _closed(uid: int, at: int, text: str, units: Units) -> list[tuple]:
    if not text:
        return []
    part, = units.parts([text])
    pairs, times = np.unique(part.pairs, return_counts=True)
    return [(uid, at, None, None, None, part.groups, part.n_a, part.n_b, part.n_groups, part.whole, pairs, times)]


def _open(uid: int, number: int, f: Fragment) -> tuple:
    return (uid, number, f.open, f.prefix, f.suffix, None, f.first, None, None, None, None, None)


def byte_ranges(long_docs: DataFrame) -> DataFrame:
    """``uid, number, last, range`` of the blank and text of each row, cut every ``CHUNK`` bytes at the character before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = f" {text.as_py()}".encode()
                edges = list(range(0, len(raw), CHUNK)) + [len(raw)]
                for i in range(1, len(edges) - 1):
                    while raw[edges[i]] & 0xC0 == 0x80:
                        edges[i] -= 1
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid]), pa.array([i]), pa.array([len(edges) - 2]), pa.array([raw[a:b].decode()])],
                        ["uid", "number", "last", "range"])
    return long_docs.select("uid", "text").mapInArrow(run, "uid long, number long, last long, range string")


def closed_parts(ranges: DataFrame, pair: TokenizerPair) -> DataFrame:
    """The closed parts of every document of ``byte_ranges``: ``at`` orders them within a ``uid``.

    Ranges are dealt over the tasks; then ``FAN_IN`` neighbours at a time compose until one fragment is
    left of each document. Open ends alone take part in that; what closes is handed on at once, so no
    task holds a document.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, number, last, text in zip(*(c.to_pylist() for c in batch.columns)):
                units = pair.units()  # a task without rows loads no tokenizers
                ends, inner = fragment(text, number, number == 0, number == last, units)
                yield _rows([_open(uid, number, ends), *_closed(uid, 2 * number + 1, inner, units)])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # uid, number of the step, fragment so far
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key, mine = (r["uid"], r["at"] // FAN_IN), Fragment(r["open"], r["prefix"], r["suffix"], r["n_a"])
                if held and held[0] == key:
                    both, seam = compose(held[1], mine)
                    held = (key, both)
                    if seam:
                        out += _closed(key[0], 2 * seam[0], seam[1], pair.units())
                else:
                    if held:
                        out.append(_open(*held[0], held[1]))
                    held = (key, mine)
            if out:
                yield _rows(out)
        if held:
            yield _rows([_open(*held[0], held[1])])

    level = stage(ranges.repartition("uid", "number").mapInArrow(cut, PARTS), "fragments")
    parts = level.where("open is null")
    most = ranges.agg(F.max("last")).first()[0] or 0
    while most > 0:
        level = level.where("open is not null").withColumn("_step", F.floor(F.col("at") / FAN_IN))
        level = level.repartition("uid", "_step").sortWithinPartitions("uid", "at").drop("_step")
        level = stage(level.mapInArrow(reduce, PARTS), "fragments")
        parts = parts.unionByName(level.where("open is null"))
        most //= FAN_IN
    return parts


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the parts of each document, which come in order."""
    uid, state = None, None
    for batch in batches:
        for mine, groups in zip(batch.column(0).to_pylist(), batch.column(1)):
            if state is not None and mine == uid:
                state.update(b";")
            else:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([state.hexdigest()])], ["uid", "groups_sha256"])
                uid, state = mine, hashlib.sha256()
            state.update(groups.as_py().encode())
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([state.hexdigest()])], ["uid", "groups_sha256"])


BLOCKS = ("block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "digests array<string>, kinds array<long>, places binary, times binary, pairs array<long>, held array<long>")
BLOCK_TYPES = [pa.int64()] + [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(),
                                                          pa.list_(pa.int64()), pa.list_(pa.int64())]
BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _block(number: int, docs: list[tuple]) -> pa.RecordBatch:
    """A block's distinct pairs with the number of its documents that hold each, and each document's pairs as places among them."""
    ids, n_a, n_b, n_groups, n_links, digests, keys, times = zip(*docs)
    pairs, places, held = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    row = [number, ids, n_a, n_b, n_groups, n_links, digests, list(map(len, keys)), places.astype("<u4").tobytes(),
           np.concatenate(times).astype("<u4").tobytes(), pairs, held]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK_TYPES)], BLOCK_NAMES)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        names, texts, size = [], [], 0
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            names.append(name)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= SLICE:
                yield names, texts
                names, texts, size = [], [], 0
        yield names, texts


def _blocks(pair: TokenizerPair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, links = [], 0
        number = TaskContext.get().partitionId() << 32
        for names, texts in _slices(batches):
            found = pair.units().parts([" " + t for t in texts if t])
            for name, text in zip(names, texts):
                part = next(found) if text else None
                if part and part.whole:
                    keys, times = np.unique(part.pairs, return_counts=True)
                    docs.append((name, part.n_a, part.n_b, part.n_groups, len(part.pairs),
                                 hashlib.sha256(part.groups.encode()).hexdigest(), keys, times))
                    links += len(part.pairs)
                else:
                    docs.append((name, 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)))
                if links >= BLOCK or len(docs) >= BLOCK_DOCS:
                    yield _block(number, docs)
                    number, docs, links = number + 1, [], 0
        if docs:
            yield _block(number, docs)
    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i] for c in batch.schema.names}
            places, times = (np.frombuffer(r[c].as_py(), "<u4").astype(np.int64) for c in ("places", "times"))
            known = r["known"].values
            counts, best = np.zeros(0 if known is None else len(known), np.int64), None
            best = counts.copy()
            if known is not None:
                at = known.field("place").to_numpy()
                counts[at] = known.field("n").to_numpy()
                best[at] = known.field("best").to_numpy(zero_copy_only=False)
            ends = np.cumsum(r["kinds"].values.to_numpy())
            starts = np.concatenate([[0], ends[:-1]])

            def per_doc(of_pair: np.ndarray) -> pa.Array:
                sums = np.concatenate([[0], np.cumsum(times * of_pair[places])])
                return pa.array(sums[ends] - sums[starts])
            yield pa.RecordBatch.from_arrays(
                [*(r[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")), per_doc(best), per_doc(counts),
                 r["digests"].values], RESULT_NAMES)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def align(docs: DataFrame, pair: TokenizerPair) -> tuple[DataFrame, DataFrame]:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and per linked pair
    ``a_id, b_id, n, best``: in how many documents it is linked, and whether no pair of ``a_id`` is in more.

    ``n_best``: links whose pair is best; ``count_sum``: ``n`` summed over links; ``groups_sha256``: of the groups
    as ``a1,a2|b1;a3|b2``. Special tokens' strings are plain text. Pairs are counted in blocks of
    documents before they are shuffled, and the counts come back block by block, so a pair that all
    documents hold is one row per block.

    Nulls: a null id is handed on; texts that are null or empty, or whose bytes either tokenizer does not
    give back (as with U+2581 in the text), have no tokens: zeros and the empty string. Texts beyond
    ``CHUNK`` bytes are fragments dealt over tasks; a unit without white space is encoded in one piece.
    Repeated rows are documents of their own; other columns are ignored; an empty table gives no rows.
    """
    is_long = F.octet_length("text") >= CHUNK
    rows = docs.select("doc_id", "text")
    blocks = stage(rows.where(F.coalesce(~is_long, F.lit(True))).mapInArrow(_blocks(pair), BLOCKS), "alignment-blocks")
    # numbered once and written with its ranges, so that number and text belong together whatever is run again
    numbered = rows.where(is_long).withColumn("uid", F.monotonically_increasing_id())
    long_docs = stage(numbered, "long-documents")
    ranges = stage(byte_ranges(long_docs), "byte-ranges")
    parts = closed_parts(ranges, pair)
    facts = parts.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")], F.min("whole").alias("whole"))
    facts = stage(facts, "alignment-facts")
    digests = parts.select("uid", "groups", "at").repartition("uid").sortWithinPartitions("uid", "at")
    digests = digests.select("uid", "groups").mapInArrow(_digests, "uid long, groups_sha256 string")
    links = (parts.join(facts.where("whole").select("uid"), "uid").select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
             .groupBy("uid", F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("times")))
    links = stage(links, "long-links")

    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "h"))
    held = held.select("block", "place", F.col("h.pairs").alias("pair"), F.col("h.held").alias("n"))
    counts = (held.select("pair", "n").union(links.select("pair", F.lit(1).cast("long")))
              .groupBy("pair").agg(F.sum("n").alias("n")))
    counts = stage(counts.withColumn("a_id", F.shiftright("pair", 32)), "pair-counts")
    known = counts.join(counts.groupBy("a_id").agg(F.max("n").alias("top")), "a_id")
    known = stage(known.select("pair", "a_id", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
    told = (held.select("block", "place", "pair").join(known.select("pair", "n", "best"), "pair")
            .groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("known")))  # at most BLOCK links and one document
    short = blocks.drop("pairs", "held").join(told, "block", "left").mapInArrow(_finish, RESULT)

    scores = links.join(known, "pair").groupBy("uid").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    whole = F.coalesce("whole", F.lit(False))
    long = (long_docs.select("doc_id", "uid").join(facts, "uid", "left").join(digests, "uid", "left").join(scores, "uid", "left")
            .select("doc_id", *[F.when(whole, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in RESULT_NAMES[1:7]],
                    F.when(whole, F.col("groups_sha256")).otherwise("").alias("groups_sha256")))
    pairs = known.select(F.col("a_id").cast("int").alias("a_id"), F.col("pair").bitwiseAND(2 ** 32 - 1).cast("int").alias("b_id"), "n", "best")
    return short.union(long), pairs


def aligned(docs: DataFrame, pair: TokenizerPair) -> DataFrame:
    """The documents of :func:`align`."""
    return align(docs, pair)[0]
