"""Every operator against a brute-force version, on the small tables and on rows with awkward cases."""

import hashlib
import html as entities
import os
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestary.llm import (components, fingerprints, html, linededup, mixing, packing, quality, queries, shards, simhash,
                           tokenfile, topk)
from attestary.llm.encoding import Encoder

FOLDER = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, _id long, row string, size long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
AWKWARD = [
    (1, "The quick brown fox jumps\nover the lazy dog every day\nand again", "en", "b", 1),
    (2, "The quick brown fox jumps\nover the lazy dog every day\nand again", "en", "a", 1),
    (2, "The quick brown fox jumps\nover the lazy dog every day\nand again", "en", "a", 1),
    (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n\x0b ", "de", None, 5), (6, LONG, "en", "z", 9),
    (7, LONG + " end", "en", "z", 9), (None, "no id but some words here to see", "en", "a", 3),
    (None, None, None, "a", 3), (8, "é à ü 日本 <|endoftext|> x", "fr", "é", 4), (9, "one two", "en", "𝒳", 2),
    (10, "OVER THE LAZY DOG EVERY DAY\r\nshort\nshort\n  over the lazy dog every day  ", "en", "b", 2),
    (-5, "over the lazy dog every day\x1c", "en", "b", 2), (11, "tie", "en", "b", 1), (12, "tie", "en", "b", 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(*r, "clash", -1, "clash", 77) for r in AWKWARD], DOCS)
    return {"plain": docs, "odd": odd, "none": odd.where("false")}


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


KINDS = ["plain", "odd", "none"]


@pytest.mark.parametrize("kind", KINDS)
def test_simhash_groups(tables, kind):
    rows = rows_of(tables[kind])

    def brute(text):
        words = [w.encode() for w in WORDS.findall(lower(text or ""))]
        grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {t: brute(t) for _, t, _ in rows}
    parent = {p: p for p in prints.values()}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p
    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, t, _ in rows:
        least[root(prints[t])].append(i)
    ids = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    want = Counter((i, f"{prints[t]:016x}", ids[root(prints[t])]) for i, t, _ in rows)
    assert Counter(tuple(r) for r in queries.op1(tables[kind]).collect()) == want
    kept = simhash.keep_one_of_each(tables[kind])
    assert kept.columns == tables[kind].columns
    assert len(kept.collect()) == len(least)


@pytest.mark.parametrize("kind", KINDS)
def test_similar_groups(tables, kind):
    """No group reaches beyond true links of 5-word shingle sets, and all true links are found."""
    docs = tables[kind]
    rows = [(2 ** 63 - 1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()]
    sets = {}
    for _, text in rows:
        words = WORDS.findall(lower(text or ""))
        k = min(5, len(words))
        sets[text] = frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()
    distinct = list(set(sets.values()))
    parent = {s: s for s in distinct}

    def top(s):
        while parent[s] is not s:
            s = parent[s]
        return s
    holders = defaultdict(list)
    for s in distinct:
        for x in s:
            holders[x].append(s)
    links = set()
    for s in distinct:
        shared = Counter(map(id, (o for x in s for o in holders[x])))
        links |= {(s, o) for o in {id(o): o for x in s for o in holders[x]}.values()
                  if o is not s and shared[id(o)] >= 0.8 * (len(s) + len(o) - shared[id(o)])}
    for a, b in links:
        parent[top(a)] = top(b)
    got = simhash.similar_groups(docs).collect()
    assert len(got) == len(rows)
    hashes = dict(docs.select("text", F.xxhash64("text")).distinct().collect())
    root = {(r.id, r.row): r.root for r in got}
    of_set, reach = {}, defaultdict(set)
    for name, text in rows:
        r = root[name, hashes[text]]
        assert of_set.setdefault(sets[text], r) == r
        reach[r].add(top(sets[text]))
    assert all(len(tops) == 1 for tops in reach.values())
    assert all(of_set[a] == of_set[b] for a, b in links)
    kept = simhash.keep_one_of_similar(docs)
    assert kept.columns == docs.columns
    first = {}
    for name, text in rows:
        key = root[name, hashes[text]]
        first[key] = min(first.get(key, (name, hashes[text])), (name, hashes[text]))
    assert sorted(first.values()) == sorted(
        (2 ** 63 - 1 if r.doc_id is None else r.doc_id, hashes[r.text]) for r in kept.collect())


def similar_by_brute_force(texts):
    """The smallest index each text reaches over pairs at 0.8 or more of their 5-word shingle sets."""
    sets = []
    for text in texts:
        words = text.split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    top = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if top[i] != top[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((top[i], top[j]))
                top = [low if x == high else x for x in top]
    return top


def similar_by_groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    roots = {r.id: r.root for r in simhash.similar_groups(docs).collect()}
    least = {}
    for i in sorted(roots):
        least.setdefault(roots[i], i)
    return [least[roots[i]] for i in range(len(texts))]


def drawn_words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_similar_texts_that_differ_by_a_block(spark):
    rng, texts = np.random.default_rng(5), []
    for n, more in ((100, 20), (300, 70), (24, 4), (12, 1)):
        for _ in range(40):
            words, block = drawn_words(rng, n), drawn_words(rng, more)
            texts += [" ".join(words), " ".join(words + block)]
    got = similar_by_groups(spark, texts)
    assert got == similar_by_brute_force(texts)
    assert len(set(got)) == len(texts) / 2


def test_variants_are_grouped_as_by_all_pairs(spark):
    """Large groups of variants of one text: a pair that is not similar hides no other pair."""
    rng, texts = np.random.default_rng(7), []
    for _ in range(2):
        base = drawn_words(rng, 300)
        for _ in range(150):
            words = list(base)
            for at in rng.choice(300, rng.integers(1, 11), replace=False):
                words[at] = f"x{rng.integers(0, 10 ** 9)}"
            texts.append(" ".join(words))
    got = similar_by_groups(spark, texts)
    want = similar_by_brute_force(texts)
    assert 2 < len(set(want)) < 200
    assert got == want


def test_repeated_passages_do_not_hide_similar_texts(spark):
    rng, texts = np.random.default_rng(9), []
    for _ in range(40):
        words = drawn_words(rng, 120)
        texts += [" ".join(words), " ".join(words[:80] + words[40:80] * 3 + words[80:])]
    got = similar_by_groups(spark, texts)
    assert got == similar_by_brute_force(texts)
    assert len(set(got)) == 40


def test_native_hash_is_the_same(tables):
    got = tables["plain"].select("text", F.xxhash64("text").alias("h")).collect()
    assert all(r.h & (2 ** 64 - 1) == xxhash.xxh64_intdigest(r.text.encode(), 42) for r in got)


def test_dense_groups_are_linked_without_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2 ** 63, 12, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(150):
            p = int(c)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "print long").repartition(5))
    assert links.count() < 20 * len(prints)
    got = {r.node: r.root for r in components.components(links).collect()}
    todo, group = set(prints), {}
    while todo:
        front = [todo.pop()]
        members = set(front)
        while front:
            x = front.pop()
            near = {y for y in todo if (x ^ y).bit_count() <= 4}
            todo -= near
            members |= near
            front += near
        for m in members:
            group[m] = min(np.uint64(v).view(np.int64) for v in members)
    for p in prints:
        s = int(np.uint64(p).view(np.int64))
        assert got.get(s, s) == group[p]


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1000 + i] == 1000 for i in range(1, 200))


@pytest.mark.parametrize("kind", KINDS)
def test_token_tables(tables, kind):
    rows = sorted(rows_of(tables[kind]), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    tokenizer, start, want = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json")), 0, []
    for i, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op2(tables[kind]).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("top", [1, 2, 9, 300, 70_000, 2 ** 40, 2 ** 60, 2 ** 64 - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 59, 60, 61, 5000):
        ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        ids[::7] %= 3
        assert (tokenfile.unpack(tokenfile.pack(ids)) == ids).all()
        if top < 2 ** 32:
            assert (tokenfile.unpack(tokenfile.pack(ids.astype(np.uint32))) == ids).all()


@pytest.mark.parametrize("name, drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_remembered_ids_are_the_tokenizers(name, drops):
    path = queries.tokenizer_file(name)
    tokenizer, encoder = Tokenizer.from_file(path), Encoder(path, drops)
    parts = ["İ,", "a\x1cb", "x  y\n\n\nz \t q", "don't I'll 's", "<|endoftext|> a<|startoftext|>b", "ὈΔΥΣΣΕΎΣ. ΣΑΣ", "é́.",
             "ß. ª º µ² ½", " a b​c", "日本語 text。", "'s.'t", "A!! B?! c'", "", " ", "\n", "É.", "ÀB", "x" * 300, "1,000.5"]
    rng = np.random.default_rng(1)
    texts = parts + [rng.choice([" ", "", "\n", "  "]).join(rng.choice(parts, 6)) for _ in range(400)]
    for text in texts:
        assert list(np.frombuffer(encoder.ids(text), dtype="<u4")) == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", KINDS)
def test_shards(spark, tables, kind, tmp_path):
    rows, got = rows_of(tables[kind]), queries.op3(tables[kind]).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    again = queries.op3(tables[kind].repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    if kind == "plain":
        source = {i: s for i, _, s in rows}
        mixture = Counter((source[r.doc_id], r.shard) for r in got)
        total = Counter(source.values())
        assert all(abs(mixture[s, n] - total[s] / 16) <= 2 for s in total for n in range(16))
        shards.write_shards(tables[kind], str(tmp_path / "out"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_quality_finds_the_labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries.op4(docs).collect()
    assert len(got) == 1000
    right = [r.keep == bool(labels[r.doc_id]) for r in got if r.doc_id in labels]
    assert sum(right) / len(right) > 0.98
    again = {(r.doc_id, r.keep, round(r.score, 6)) for r in queries.op4(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.keep, round(r.score, 6)) for r in got}


CLEAN = ["Мы долго шли вдоль берега реки и говорили о прошедшем лете. Никто не помнил, когда началась эта дорога, но все знали её конец. ",
         "Περπατήσαμε πολλή ώρα δίπλα στο ποτάμι και μιλούσαμε για το καλοκαίρι. Κανείς δεν θυμόταν πότε άρχισε αυτός ο δρόμος. ",
         "हम नदी के किनारे बहुत देर तक चलते रहे और बीती गर्मी की बातें करते रहे। किसी को याद नहीं था कि यह रास्ता कब शुरू हुआ। "]


def test_quality_accuses_no_script():
    for text in CLEAN:
        stats, _, n = quality.statistics((text * 2).encode())
        assert "-" not in quality.votes_of(stats, n)
    blankless = "我们沿着河边走了很久谈论着过去的夏天没有人记得这条路是什么时候开始的"
    stats, _, n = quality.statistics(" ".join(blankless[i:] + blankless for i in range(25)).encode())
    assert quality.votes_of(stats, n)[6] == quality.votes_of(stats, n)[8] == "."


def test_quality_finds_an_unreliable_labeller():
    """A labeller that accuses three documents in ten, alone, is not believed; rare faults still are."""
    clean = "+" * 9
    counts = {clean: 6000, clean[:8] + "-": 3000}
    for i in range(8):
        counts[clean[:i] + "-" + clean[i + 1:]] = 60
        counts[clean[:i] + "-" + clean[i + 1:8] + "-"] = 30
    posterior = quality.LabelModel(counts).posterior
    assert posterior[clean] > 0.5 and posterior[clean[:8] + "-"] > 0.5
    assert all(posterior[clean[:i] + "-" + clean[i + 1:]] < 0.5 for i in range(8))


def test_quality_sample_is_packed_in_the_driver(spark):
    """The sample comes as packed buckets and weights, not as Python numbers, and the scorer is that of the sample in order of its numbers."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(32, 127, 3000))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tracemalloc.start()
    try:
        model = quality.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    rows = []
    for t in texts:
        stats, octets, n = quality.statistics(t.encode())
        at, value = quality.hashed_features(stats, octets)
        rows.append((quality.votes_of(stats, n), at.tolist(), value.astype(np.float32).tolist()))
    rows.sort()
    posterior = np.array([model.labels.posterior[v] for v, _, _ in rows])
    weights, bias = quality.fit_scorer([(np.array(at), np.array(value)) for _, at, value in rows], posterior)
    assert np.array_equal(model.weights, weights) and model.bias == bias
    assert peak < 100e6, peak


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_quality_of_awkward_rows(tables, kind):
    got = queries.op4(tables[kind]).collect()
    assert len(got) == tables[kind].count()
    assert all(r.keep for r in got if r.doc_id in (3, 4, 5))
    assert quality.keep_good(tables[kind]).columns == tables[kind].columns


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("blocks", [1, 7])
def test_fingerprints_with_the_next(tables, kind, blocks):
    rows = sorted(rows_of(tables[kind]), key=lambda r: (-(r[0] if r[0] is not None else -2 ** 63), r[1] or ""))
    want = []
    for n, (i, text, _) in enumerate(rows):
        text, follower = text or "", rows[(n + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edit = text[:len(text) - cut] + follower[:cut]
        a, b, c = (fingerprints.fingerprint(t) for t in (text, edit, follower))
        want.append((i, len(text), hashlib.sha256(edit.encode()).hexdigest(), fingerprints.as_hex(a), fingerprints.as_hex(b),
                     round(fingerprints.likeness(a, b), 9), round(fingerprints.likeness(a, c), 9)))
    got = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9))
           for r in fingerprints.compare_with_next(tables[kind], blocks).collect()]
    assert Counter(got) == Counter(want)


def test_fingerprints_are_homomorphic():
    a, b = ["first paragraph", "second one", "third"], ["fourth", "second one"]
    whole = fingerprints.fingerprint("\n".join(a + b))
    assert fingerprints.as_hex(fingerprints.fingerprint("\n".join(b + a[::-1]))) == fingerprints.as_hex(whole)
    some = fingerprints.fingerprint("\n".join(a))
    assert fingerprints.as_hex(fingerprints.combine(some, fingerprints.fingerprint("\n".join(b)))) == fingerprints.as_hex(whole)
    assert fingerprints.as_hex(fingerprints.combine(whole, fingerprints.fingerprint("\n".join(b)), -1)) == fingerprints.as_hex(some)
    back = fingerprints.from_hex(fingerprints.as_hex(whole))
    assert back[:2] == whole[:2] and (back[2] == whole[2]).all() and (back[3] == whole[3]).all()
    assert fingerprints.as_hex(some) != fingerprints.as_hex(whole)


def test_fingerprints_are_equal_for_equal_paragraphs_alone(tables):
    """Texts that differ only in line ends, blanks or repeats: equal prints where the multisets of lines are, and nowhere else."""
    rng, texts = np.random.default_rng(4), []
    for _, t, _ in rows_of(tables["plain"])[:120]:
        words = (t or "").split(" ")
        at = int(rng.integers(0, max(1, len(words) - 1)))
        lines = (t or "").split("\n")
        cut = "\n".join(" \n".join(p.decode() for p in fingerprints.pieces(line.encode())) for line in lines)
        texts += [t or "", cut, cut.replace(" \n", "\n"), " ".join(words[:at]) + "\n" + " ".join(words[at:]), "\n".join(lines[::-1]),
                  "\n".join(lines + lines[:1]), (t or "") + " ", (t or "") + "\n"]
    prints = {}
    for t in texts:
        prints.setdefault(fingerprints.as_hex(fingerprints.fingerprint(t)), set()).add(tuple(sorted(t.split("\n"))))
    assert all(len(v) == 1 for v in prints.values())
    assert len(prints) == len({tuple(sorted(t.split("\n"))) for t in texts})
    a, b = (fingerprints.fingerprint(t) for t in ("one two three\nfour", "one two\nthree four"))
    assert fingerprints.likeness(a, b) < 1 and not fingerprints.same(a, b)


def test_fingerprint_likeness_follows_the_share(tables):
    texts = [t for _, t, _ in rows_of(tables["plain"]) if len(t) > 1500]
    off = []
    for t, u in zip(texts, texts[1:]):
        edit = t[:len(t) - len(t) // 3] + u[:len(t) // 3]
        a, b = (Counter(p for line in fingerprints.paragraphs(x) for p in fingerprints.pieces(line)) for x in (t, edit))
        true = sum((a & b).values()) / sum((a | b).values())
        off.append(fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(edit)) - true)
    assert np.abs(off).mean() < 0.06 and np.abs(off).max() < 0.25


@pytest.mark.parametrize("kind", KINDS)
def test_line_dedup(tables, kind):
    rows = rows_of(tables[kind])
    key = lambda line: lower(line.strip(BLANK))
    rank = lambda i: 2 ** 63 - 1 if i is None else i
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(rank(i))
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or rank(i) == min(holders[key(x)])]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert Counter(map(tuple, queries.op6(tables[kind]).collect())) == Counter(want)
    out = linededup.drop_repeated_lines(tables[kind])
    assert out.columns == tables[kind].columns and out.count() == len(rows)


def test_line_dedup_over_many_partitions(spark):
    """A line in every document fills many partitions; its holder is in the first of them."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("a line that all of them share\nown line number "), (F.col("id") % 1000).cast("string")).alias("text"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.n_dropped for r in queries.op6(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(n == (0 if i == 0 else 1 if i < 1000 else 2) for i, n in got.items())


@pytest.mark.parametrize("kind", KINDS)
def test_mixing(tables, kind):
    rows, got = rows_of(tables[kind]), queries.op7(tables[kind]).collect()
    sizes = [(i, len(WORDS.findall(t or ""))) for i, t, _ in rows]
    assert Counter((r.doc_id, r.size) for r in got) == Counter(sizes)
    by = Counter()
    for (_, n), (_, _, s) in zip(sizes, rows):
        by[s] += n
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in by else [])
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    target, free, left = {}, set(by), sum(by.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * by[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * by[s] for s in full}
        left -= sum(3 * by[s] for s in full)
        free -= full
    found = {}
    for r in got:
        found.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
        assert 0 <= r.taken <= 3 * r.size
    assert {(by[s], round(target[s], 6)) for s in by} == set(found)
    if len({(by[s], round(target[s], 6)) for s in by}) == len(by):
        assert all(abs(sum(v) - k[1]) <= 1 for k, v in found.items())
    assert Counter(map(tuple, queries.op7(tables[kind].repartition(3)).collect())) == Counter(map(tuple, got))


@pytest.mark.parametrize("kind", KINDS)
def test_mixed_copies_hold_what_was_taken(tables, kind):
    want = Counter()
    for r in queries.op7(tables[kind]).collect():
        want[r.doc_id] += r.taken
    got = Counter()
    out = mixing.mix(tables[kind])
    assert out.columns == tables[kind].columns
    for r in out.collect():
        got[r.doc_id] += len(WORDS.findall(r.text))
    assert +got == +want


def test_mixed_repeats_keep_their_rows(spark):
    """Rows of one id and text that differ elsewhere: every rerun gives each row the same copies."""
    rows = [(1, "one two three four five six", s, n) for s in ("a", "b", None) for n in range(4)] + [(2, "x y", "a", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note int")
    runs = [Counter(tuple(r) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("kind", ["plain", "odd"])
def test_mix_is_the_global_order_cut_at_the_budget(tables, kind):
    """All copies of all sources in one order of virtual finish time, cut where the running sum of words reaches the
    budget, are what each source's cut at its own target takes."""
    lots = mixing.allotments(tables[kind]).collect()
    budget = sum(r["size"] for r in lots)
    copies = []  # finish time, words before it in its source, row, words
    for n, r in enumerate(lots):
        if r.target > 0 and r["size"]:
            copies += [((r._before + r["size"] + k * r.source_size) / r.target, r._before + k * r.source_size, n, r["size"]) for k in range(3)]
    taken, total = Counter(), 0
    for finish, start, n, size in sorted(copies):
        words = size if finish <= 1 else max(0, min(size, int(np.floor(lots[n].target)) - start))  # being served at time 1
        taken[n] += words
        total += words
        assert total <= budget
    assert budget - total < len({r.stratum for r in lots}) + 1
    assert all(taken[n] == r.taken for n, r in enumerate(lots))


def brute_top(vectors, k=5):
    good = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(float(x) * 256)) for x in v]))
    want = []
    for q, a in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return Counter(want)


def test_top_k(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_top([(r.vec_id, r.embedding) for r in vectors.collect()])
    assert Counter(tuple(r)[:4] for r in queries.op8(vectors).collect()) == want


def test_top_k_of_awkward_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, [1.0, None]), (2, None), (3, [nan, 1.0]), (4, [float("inf"), 0.0]), (5, [1.0, 2.0]),
            (6, [1.0, 2.0]), (7, [-3.0, 0.5]), (8, [1.0, 2.0, 3.0]), (100, [1.0, 1.0, 1.0]), (5, [4.0, 4.0]), (None, [1.0, 1.0]),
            (9, []), (150, []), (10, [1e12, -1e12]), (200, [1e9, 1e9])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r)[:4] for r in queries.op8(table).collect()) == brute_top(rows)
    assert queries.op8(table.where("false")).collect() == []


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).round(1).tolist()) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r)[:4] for r in queries.op8(table).collect()) == brute_top(rows)


@pytest.mark.parametrize("kind", KINDS)
def test_packing(tables, kind):
    rows, got = rows_of(tables[kind]), queries.op9(tables[kind]).collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows]
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    cuts = defaultdict(set)
    for r in got:
        cuts[r.doc_id, r.doc_tokens].add((r.start, r.length, r.ids_crc32))
    for i, x in ids:  # each document is covered by pieces that hold its ids
        at = 0
        while at < len(x):
            at = next(s + n for s, n, c in cuts[i, len(x)] if s == at and crc(x[s:s + n]) == c)
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    fills = []
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        fills.append(at)
    assert all(f <= 2048 for f in fills)
    if kind == "plain":
        assert sum(2048 - f for f in fills) < 0.02 * sum(fills)


def test_packing_merges_the_leftovers_of_partitions(tables):
    got = packing.pack_documents(tables["plain"].repartition(40), Encoder(queries.tokenizer_file("byte_bpe_50k.json"), False)).collect()
    fill = Counter()
    for r in got:
        assert len(r.ids) == 4 * r.length
        fill[r.sequence_id] += r.length
    assert sum(2048 - f for f in fill.values()) < 0.02 * sum(fill.values())


def test_page_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in queries.op10(pages).collect():
        body = re.search("<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        plain = re.sub("</?b>", "", re.sub("<(?:/?(?:p|h1)|br)>", " ", body))
        assert r.text == " ".join(entities.unescape(plain).split())
        assert r.n_chars == len(r.text)


PAGES = [
    ('<body><div id="menu"><a href=x>Home</a> <a>About</a></div><div class="content"><h2>Title here</h2><p>This is a long text about '
     'things, with &eacute; and more.</p><div class="ad">Buy now cheap</div><p>Short.</p><p>Another one &amp more.</p></div>'
     '<div class="sidebar">Other stuff here</div><div id="comments"><p>great post</p></div><footer>copyright me</footer></body>',
     "Title here This is a long text about things, with é and more. Short. Another one & more."),
    ("<header><h1>Site</h1></header><main><article><h1>Head</h1><p>Alpha <i>be</i>ta.<aside>side note</aside><p>x<form>Sign up"
     "<input name=q></form><p>Last one.<script>if (a<b) '</p>'</script><section class='comments'><p>hi there</section></article></main>",
     "Head Alpha beta. x Last one."),
    ("", ""), (None, ""), ("<nav>only a menu</nav>", ""), ("just words", "just words"),
    ('<div class="cookie-notice">We use cookies ok</div><article class="post"><h1>T</h1><p title="open>Body\n\t words</p></article>', None),
    ("<article>" + "<p>word word</p>" * 20_000 + "</article>", "word word " * 19_999 + "word word"),
]


def test_page_text_of_awkward_pages(spark):
    table = spark.createDataFrame([(i, None if i == 2 else f"u{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(None, "u", "same", "y")],
                                  "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in queries.op10(table).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert want is None or got[i] == want
    assert got[None] == "same"
    assert queries.op10(table.where("false")).collect() == []


@pytest.mark.parametrize("page", [
    "<body><div class='layout has-sidebar'>{}<div class=sidebar>other things</div></div></body>",
    "<body><div class='no-sidebar'><main>{}</main></div></body>", "<body><div class='page with-banner'>{}</div></body>",
    "<body><div class='comments'><article>{}</article></div></body>", "<body><form action=x>{}<input></form></body>",
    "<body><div class='post comment-enabled'>{}</div></body>", "<body><div class='share-price'>{}</div></body>",
    "<body><div class=sidebar>{}</div></body>",
    "<body><select><option>one{}</body>", "<body><svg><path>{}</body>", "<body><noscript>{}</body>", "<body><iframe src=x>{}</body>"])
def test_page_text_below_wrappers(page):
    text = "The whole text of the page stands here, in more than ten words."
    assert html.extract(page.replace("{}", f"<p>{text}</p>"), {}) == text


@pytest.mark.parametrize("n", [1, 4, 40])
@pytest.mark.parametrize("page", ["<body><article><h1>Title</h1><p>{}</p><section class='comments'>{c}</section></article></body>",
                                  "<body><div><h1>Title</h1><p>{}</p><div id=replies>{c}</div></div></body>",
                                  "<body><main><h1>Title</h1><p>{}</p><div class='related posts'><ul>{c}</ul></div></main></body>"])
def test_comments_go_whatever_their_share(page, n):
    text = "The whole text of the page stands here, in more than ten words."
    said = "".join(f"<div class=entry><p>Reader {i} says that this was a long and good text to read.</p></div>" for i in range(n))
    assert html.extract(page.replace("{}", text).replace("{c}", said), {}) == "Title " + text


MALFORMED = ["<div>*</x>*", "<a x=\"*", "<a x='*>", "<a \"x>\" *", "<b>*<p></p>*", "<svg><p>*", "<p><div><b>*<p></p>*", "<*", "<!*", "<a *", "</p>*<p>*",
             "<select>*<option>*", "<p>a<b>*</i>*", "<a b='\"'*>", "<iframe *", "&amp*", "<div class='comment*"]


@pytest.mark.parametrize("shape", MALFORMED)
def test_malformed_pages_take_time_in_proportion(shape):
    """40 000 tags of any broken kind are read in seconds: twice the page takes about twice the time."""
    import time
    units, page = shape.split("*"), ""
    for u in units[:-1]:
        page += u * 40_000
    began = time.perf_counter()
    html.extract(page + units[-1] + "<p>text</p>", {})
    assert time.perf_counter() - began < 20  # a scan per tag takes minutes


def test_page_text_without_parts_beside():
    page = ("<body><article><p>One two three four five six.</p><div class=ad>Buy this now</div><p>Seven eight.</p></article>"
            "<div class=comments><article>A comment of some words</article></div></body>")
    assert html.extract(page, {}) == "One two three four five six. Seven eight."


def test_unmarked_pages_are_scored_by_learned_weights(spark):
    """A menu in an unnamed list goes; the bounded sample holds marked pages only."""
    menu = "<ul>" + "".join(f"<li><a href=x>Menu entry number {i}</a></li>" for i in range(6)) + "</ul>"
    text = "".join(f"<p>Sentence {i} of the main text has some words more.</p>" for i in range(4))
    marked = f"<body><div>{menu}</div><article>{text}</article></body>"
    bare = f"<body><div>{menu}</div><div>{text}</div></body>"
    pages = spark.createDataFrame([(i, "u", marked if i < 5 else bare) for i in range(200)], "page_id long, url string, html string")
    weights = html.learn_weights(pages, 5)
    assert "Menu" in html.extract(bare, {})
    assert html.extract(bare, weights) == " ".join(f"Sentence {i} of the main text has some words more." for i in range(4))


def test_page_weights_have_their_signs():
    counts = Counter()
    for page, _ in PAGES:
        counts.update(html.labelled_counts(page or ""))
    weights = html.weights_of(counts)
    assert all(w >= 0 if " words" in f else w < 0 for f, w in weights.items())


def test_pipeline_stages(spark, tables):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near dedup", "mixing", "packing"]
    for kind in ("odd", "none"):
        docs = tables[kind]
        for _, apply in corpus_pipeline.STAGES[:-1]:
            docs = apply(spark, docs, "")
            assert docs.columns == tables[kind].columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_stages_and_alignment_bound_their_batches(spark, tables):
    import corpus_pipeline
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for apply in [corpus_pipeline.STAGES[0][1], lambda s, docs, at: queries.op13(docs)]:
            spark.conf.set(key, "10000")
            apply(spark, tables["none"], "")
            assert spark.conf.get(key) == "2000"
    finally:
        spark.conf.set(key, was)


def test_entry_works_without_the_folder(tmp_path):
    """The rest imports when this folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/attestary", tmp_path / "attestary", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"],
                          cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.stdout.endswith("False\n"), said.stderr
