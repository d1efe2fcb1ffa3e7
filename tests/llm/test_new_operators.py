"""Alignment, clustering and URL filters against brute force and SQL, on the small tables and on awkward rows."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestary.llm import alignment, centroids, queries, urlfilters

FOLDER = "/root/testdata/sf0.001"
PAIR = alignment.TokenizerPair(queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, uid long, block string, pair long"
LONG = "\n\n".join(" ".join(f"Wort{i % 977}x{i} läuft, it's 42!" for i in range(k, k + 60)) for k in range(0, 6000, 60))
TEXTS = ["The quick brown fox", "The quick brown fox", None, "", " ", "   \n\t x  y ", "a\r\nb\r\n  c\rd", "é à ü 日本語のテキスト 한국어 <|endoftext|> <s> x",
         "with \u2581 inside", "\x1c odd \x1d\x1fblanks\x85 and\u2002more\u3000here\xa0 now", "don't we'll 'tis", "x" * 3000, "\u0000nul \u0007 bell",
         "Ünïcödé " * 40, LONG, LONG, LONG + " \r\n  end  ", "\u65e5" * 30_000, ("z" * 70_000) + " tail", LONG + "\u2581", "e\u0301 ﬁ ①", "\n", "tab\tand  two"]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(None if i == 3 else i, t, "x", -1, "clash", 7) for i, t in enumerate(TEXTS)]
    odd = spark.createDataFrame(rows, DOCS).repartition(3)
    return {"plain": spark.read.parquet(f"{FOLDER}/documents.parquet"), "odd": odd, "none": odd.where("false")}


def brute_tokens(text, a, b, a_bytes, b_bytes):
    """Token ids and byte ends of both tokenizers over whole texts, None where the bytes differ."""
    if not text:
        return None
    raw = (" " + text).encode()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [a_bytes[i] for i in ids[0]], [b_bytes[i] for i in ids[1]]
    if any(b"".join(p) != raw for p in parts):
        return None
    return [(i, np.cumsum([len(x) for x in p]).tolist()) for i, p in zip(ids, parts)]


def brute_alignment(rows):
    units = alignment.Units(*PAIR)
    docs = []
    for name, text in rows:
        both = brute_tokens(text, units.a, units.b, units.a_bytes, units.b_bytes)
        if both is None:
            docs.append((name, None, None, None, None, []))
            continue
        (a, a_ends), (b, b_ends) = both
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            x, y = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
            for p in range(i, x):
                for q in range(j, y):
                    if max(a_ends[p - 1] if p else 0, b_ends[q - 1] if q else 0) < min(a_ends[p], b_ends[q]):
                        links.append((a[p], b[q]))
            i, j = x, y
        docs.append((name, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    held = Counter(p for d in docs for p in set(d[5]))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for name, n_a, n_b, n_groups, digest, links in docs:
        out.append((name, n_a or 0, n_b or 0, n_groups or 0, len(links), sum(held[p] == top[p[0]] for p in links),
                    sum(held[p] for p in links), digest or ""))
    return Counter(out), {(a, b, n, n == top[a]) for (a, b), n in held.items()}


@pytest.mark.parametrize("kind", ["plain", "odd", "none"])
def test_alignment(tables, kind):
    docs = tables[kind]
    want, want_pairs = brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    got, pairs = alignment.align(docs, PAIR)
    assert got.columns == alignment.RESULT_NAMES
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {tuple(r) for r in pairs.collect()} == want_pairs
    assert Counter(tuple(r) for r in queries.op13(docs).collect()) == want


def test_alignment_in_small_ranges(tables, monkeypatch):
    """Ranges of a few bytes: most texts are many fragments, reduced in several steps."""
    docs = tables["odd"].where(F.coalesce(F.length("text"), F.lit(0)) < 5000)
    want, _ = brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    monkeypatch.setattr(alignment, "CHUNK", 7)
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    monkeypatch.setattr(alignment, "BLOCK", 20)
    assert Counter(tuple(r) for r in alignment.aligned(docs, PAIR).collect()) == want


def test_alignment_without_rows_loads_no_tokenizers(tables):
    """Most of many shuffle partitions hold no fragment: their workers stay small."""
    nowhere = alignment.TokenizerPair("/nowhere/a.json", "/nowhere/b.model")
    assert alignment.aligned(tables["odd"].where("doc_id < -1"), nowhere).collect() == []
    assert alignment.closed_parts(alignment.byte_ranges(tables["odd"].limit(0).withColumn("uid", F.lit(1).cast("long"))), nowhere).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\r\té日", max_size=40), st.lists(st.integers(0, 40), max_size=6), st.randoms())
def test_fragments_compose_associatively(text, edges, rng):
    """Any order of composing neighbours closes the same texts at the same places."""
    units = _UNITS[0] if _UNITS else _UNITS.append(alignment.Units(*PAIR)) or _UNITS[0]
    text = " " + text
    edges = [0, *sorted(min(e, len(text)) for e in edges), len(text)]
    pieces = [text[a:b] for a, b in zip(edges, edges[1:])]
    row = []
    for n, p in enumerate(pieces):
        f, inner = alignment.fragment(p, n, n == 0, n == len(pieces) - 1, units)
        row.append((f, {2 * n + 1: inner}))
    while len(row) > 1:
        i = rng.randrange(len(row) - 1)
        (x, x_closed), (y, y_closed) = row[i], row[i + 1]
        both, seam = alignment.compose(x, y)
        row[i:i + 2] = [(both, {**x_closed, **y_closed, **({2 * seam[0]: seam[1]} if seam else {})})]
    (f, closed), = row
    assert (f.open, f.prefix, f.suffix) == (False, "", "")
    assert "".join(closed[k] for k in sorted(closed)) == text
    assert [u for k in sorted(closed) for u in units.split(closed[k])] == units.split(text)


_UNITS = []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet=" \n\r\t\xa0\u3000\x1cab1'.é", max_size=40) | st.text(alphabet="abs tT'.,;:!?-²1é×", max_size=40))
def test_units_are_encoded_as_in_the_whole_text(text):
    units = _UNITS[0] if _UNITS else _UNITS.append(alignment.Units(*PAIR)) or _UNITS[0]
    if not text:
        return
    parts = units.split(" " + text)
    assert "".join(parts) == " " + text
    found = [units.tokens(p) for p in parts]
    assert [i for a, _ in found for i in a] == units.a.encode(" " + text, add_special_tokens=False).ids
    assert [i for _, b in found for i in b] == units.b.encode(text)
    units.clear()
    part, = units.parts([" " + text])
    whole = brute_tokens(text, units.a, units.b, units.a_bytes, units.b_bytes)
    assert part.whole == (whole is not None)
    assert not whole or (part.n_a, part.n_b) == (len(whole[0][0]), len(whole[1][0]))


# --- clustering -----------------------------------------------------------------------------------

def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, tuple(int(np.floor(float(x) * 256)) for x in v)) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in start]
    if not centres:
        return Counter()

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centres = [tuple(sum(col) // len(members[n]) for col in zip(*members[n])) if n in members else c for n, c in enumerate(centres)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
                   for i, c, d in out)


def test_clusters_of_awkward_vectors(spark):
    rng = random.Random(3)
    base = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + rng.uniform(-.1, .1) for x in base[i % 12]]) for i in range(120)]
    rows += [(500, base[0]), (500, base[0]), (500, base[1]), (None, base[2]), (None, None), (7, None), (8, []), (9, base[0][:63]),
             (10, base[0] + [1.0]), (11, [None] + base[0][1:]), (12, [float("nan")] + base[0][1:]), (13, [float("inf")] + base[0][1:]),
             (14, [3000.0] * 64), (15, [-3000.5] * 64)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, id long").repartition(3)
    for k in (40, 3):
        got = centroids.clusters(table, k=k)
        assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows, k)
    few = [r for r in rows if r[0] in (500, 14)]
    assert Counter(tuple(r) for r in centroids.clusters(table.where("vec_id in (500, 14)")).collect()) == brute_clusters(few)
    assert centroids.clusters(table.where("false")).collect() == []
    assert centroids.clusters(table.where("vec_id is null")).collect() == []


def test_pivots_spare_exact_distances_and_lose_none():
    """Of well-parted groups most centroids are bounded away; the nearest is that of all distances."""
    rng = np.random.default_rng(5)
    pivots = rng.integers(-256, 256, (20, 64))
    rows = np.repeat(pivots, 50, axis=0) + rng.integers(-9, 9, (1000, 64))
    centres = pivots + rng.integers(-5, 5, (20, 64))
    far = np.sqrt(centroids._squares(rows, pivots)).astype(np.float32)
    cluster, distance, computed = centroids.nearest(rows, far, centres, np.sqrt(centroids._squares(centres, pivots)).astype(np.float32))
    every = centroids._squares(rows, centres)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed < 0.2 * every.size


def test_huge_components_are_an_error(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        centroids.clusters(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


# --- URL filters ----------------------------------------------------------------------------------

URLS = ["http://example.org/es/1", "http://EXAMPLE.org/es", "https://a.b.example.org/en/12?x=/es/", "https://example.org/en/2#f", "http://notexample.org/es/1",
        "http://x.com/fr/", "http://x.com/FR/1", "http://x.com/de/1", "http://com/de/", "http://x.com", "http://x.org", "http://x.org/", "ftp://x.net/a",
        None, "", "no scheme", "://", ":///de/", "http://x.com:80/de/1", "http://u@x.com/de/1", "http://casino-win.example.net/en/1",
        "http://www.casino-x.org/a", "http://mycasino-x.net/a", "http://x.net/cgi-bin/a/b.exe", "http://x.net/cgi-bin/a/b.exes", "http://x.net/wp-login.php",
        "http://x.net/" + "a/" * 20_000 + "wp-login.php", "http://x.com/de/1", "http://é.com/de/", "http://x.net/a*b|c", "a://b://c.org/d", "http://x.com\n/de/1",
        "http://xn.net/\\Q.\\E/1", "http://K.org/"]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in queries.SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end]


def test_url_verdicts(spark):
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], "x", "y")],
                                  "page_id long, url string, rule string, place string")
    got = {r.page_id: r for r in queries.op12(table).collect()}
    assert len(got) == len(URLS) + 1
    blocked = {20, 23, 25, 26}
    for i, url in enumerate(URLS):
        host, path = split_url(url)
        rule, verdict = brute_rule(host, path)
        want = (i, host, path, rule, verdict or ("block" if i in blocked else "allow"))
        assert tuple(got[i]) == want, url
    assert got[None].verdict == "block"
    rules = urlfilters.rule_table(spark, queries.SITES, urlfilters.UNWANTED)
    kept = urlfilters.keep_allowed(table, rules)
    assert kept.columns == table.columns
    assert Counter(r.page_id for r in kept.collect()) == Counter(r.page_id for r in got.values() if r.verdict == "allow")
    assert queries.op12(table.where("false")).collect() == []
    assert {r.verdict for r in urlfilters.judge(table, rules.where("false")).collect()} == {"allow"}


PATTERNS = ["||x.com^", "|x.com/a|", "/ad/*.gif|", "a*b", "*", "track", "^q^", ".net/", "||b.net/p", "||x", "c|d"]


def test_patterns_are_found_by_their_tokens(spark):
    """Every pattern on every URL: fetching by the rarest token loses no match."""
    import re

    def fits(pattern, place):
        body = re.sub(r"^\|{1,2}|\|$", "", pattern)
        inner = "".join(".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|\Z)" if c == "^" else re.escape(c) for c in body)
        start = r"^(?:[^/]*\.)?" if pattern.startswith("||") else "^" if pattern.startswith("|") else ""
        return re.search("(?s)" + start + inner + (r"\Z" if len(pattern) > 1 and pattern.endswith("|") and pattern[-2] != "|" else ""), place)
    hosts, paths = ["x.com", "y.x.com", "ax.com", "b.net", "q", ""], ["", "/", "/a", "/ad/1.gif", "/ad/1.gifs", "/p/q/r", "/atrackb", "/c|d"]
    urls = [f"http://{h}{p}" for h, p in itertools.product(hosts, paths)]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = urlfilters.rule_table(spark, [], PATTERNS)
    for pattern in PATTERNS:
        got = {r.doc.url for r in urlfilters.judge(table, rules.where(F.col("pattern") == pattern)).collect() if r.verdict == "block"}
        assert got == {u for u in urls if u != "http://" and fits(pattern, u[7:])}, pattern
    both = {r.doc.url: r.pattern for r in urlfilters.judge(table, rules).collect()}
    for u in urls:
        want = [p for p in PATTERNS if u != "http://" and fits(p, u[7:])]
        assert both[u] == (max(want, key=lambda p: (len(p), p)) if want else None)


def test_rules_are_listed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"a{i % 3}.common.org/en/{i}",) for i in range(30)] + [("rare.common.org/en/1",)], "place string")
    rules = urlfilters.rule_table(spark, [("rare.common.org", "/en/", "block"), ("common.org", "/1", "allow")], ["zzz", "||absent.org/"])
    token = {r.rule: r.token for r in urlfilters.rule_index(rules, urls).collect()}
    assert token == {"rare.common.org/en/": "rare", "common.org/1": "common", "zzz": "", "||absent.org/": "absent"}


@pytest.mark.parametrize("name", ["op11_laesa_clusters", "op12_url_filters"])
def test_new_queries_against_sql(spark, name):
    got = compare.actual(queries.QUERIES[name](spark, FOLDER))
    assert compare.difference(got, compare.expected(compare.connect(FOLDER), queries.ORACLES[name])) is None


def test_new_queries_plan_native_filters(spark):
    plan = queries.QUERIES["op12_url_filters"](spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "InPandas", "InArrow", "Cartesian", "NestedLoop"))
