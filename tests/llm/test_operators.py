"""The other operators on small tables: brute force, edge rows, clashing columns."""

import random
import time
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphweave.llm import chat, decontam, html, linededup, mixing, mtree, quality, simhash

SCHEMA = "doc_id long, text string, source string, size string, t int, s_size int, bucket int"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, s, "x", 1, 2, 3) for k, t, s in rows], SCHEMA).repartition(3)


EDGES = [(None, "a b c d e", "s"), (901, None, None), (902, "", "s"), (903, " \n\t", None), (904, LONG, "big"), (905, "same", "s"), (905, "same", "s"), (906, "ünï Çé", "S")]


# SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return sorted(((k, fp[i], least[find(i)]) for i, (k, _) in enumerate(rows)), key=repr)


def test_simhash_equals_brute_force(spark):
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(300)}" for _ in range(n)]
    rows = []
    for i in range(60):
        w = words(r.choice((3, 40, 300)))
        rows.append((len(rows), " ".join(w)))
        for _ in range(r.randrange(4)):
            v = list(w)
            v[r.randrange(len(v))] = "edited"
            rows.append((len(rows), " ".join(v)))
    rows += [(k, t) for k, t, _ in EDGES]
    got = simhash.near_duplicates(frame(spark, [(k, t, "s") for k, t in rows])).select("doc_id", "fp", "component_id").collect()
    assert sorted(((g[0], g[1] % 2**64, g[2]) for g in got), key=repr) == brute_components(rows)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_masks_cover_the_radius():
    masks = simhash.masks()
    r = random.Random(1)
    for _ in range(20_000):
        diff = sum(1 << i for i in r.sample(range(64), 4))
        assert any(diff & m == 0 for m in masks)
    assert all(24 <= m.bit_count() <= 40 for m in masks)


def test_split_buckets_lose_no_link(spark):
    """Few far centres with many variants each: with a bound of 8 nearly all buckets are split by second masks."""
    r = random.Random(5)
    fps = {r.getrandbits(40) for _ in range(30)}
    for f in list(fps):
        fps |= {f ^ sum(1 << i for i in r.sample(range(64), r.randrange(1, 6))) for _ in range(20)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    root = {simhash.signed(f): simhash.signed(f) for f in fps}

    def find(root, i):
        while root[i] != i:
            i = root[i]
        return i

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= 4:
                root[find(root, simhash.signed(f))] = find(root, simhash.signed(g))
    for bucket in (8, simhash.BUCKET):
        got = {k: k for k in root}
        for u, v in simhash.links(df, bucket=bucket).collect():
            got[find(got, u)] = find(got, v)
        groups = lambda x: sorted(sorted(k for k in x if find(x, k) == c) for c in {find(x, k) for k in x})
        assert groups(got) == groups(root)


def test_second_masks_cover_too():
    family = simhash.masks(stride=37)
    r = random.Random(2)
    diffs = [sum(1 << i for i in r.sample(range(64), 4)) for _ in range(5_000)]
    assert all(any(d & m == 0 for m in family) for d in diffs) and family != simhash.masks()


def test_bucket_links_reach_all():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 5)
    fps = np.unique(np.array([int(b) ^ (1 << int(i)) for b in base for i in r.integers(0, 60, 200)], np.int64))
    edges = simhash.bucket_links(fps, 4)
    assert len(edges) == len(fps) - 5


# line dedup


def brute_lines(rows):
    uniq = sorted({(k, t) for k, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, gone = set(), {}
    for k, t in uniq:
        lines = t.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone.setdefault((k, t), set()).update((i, i + 1, i + 2))
            seen.add(w)
    out = []
    for k, t in rows:
        lines = t.split("\n") if t is not None else []
        g = gone.get((k, t), set())
        out.append((k, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in g), len(lines), len(g)))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(6)
    rows = [(i, "\n".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 12)))) for i in range(120)] + [(k, t) for k, t, _ in EDGES]
    rows += [(1000, "\n".join(f"l{i % 3000}" for i in range(9000)))]
    out = linededup.dedup_lines(frame(spark, [(k, t, "s") for k, t in rows]))
    assert set(SCHEMA.split(", ")) <= {f"{n} {d}" for n, d in out.dtypes} | {f"{n} {'long' if d == 'bigint' else d}" for n, d in out.dtypes}
    assert sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr) == brute_lines(rows)
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


# decontamination


def brute_hits(docs, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    windows = [(i, tuple(w[p : p + 10])) for i, t in items for w in [words(t)] if w for p in range(max(1, len(w) - 9))]
    out = []
    for k, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, g in windows:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    ids.add(str(i))
        out.append((k, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [0, 3, 20_000])
def test_decontamination_equals_brute_force(spark, block):
    r = random.Random(8)
    word = lambda: r.choice("abcdefghijk") + r.choice("xyz")
    items = [(i, " ".join(word() for _ in range(r.choice((3, 10, 25))))) for i in range(12)] + [(50, None), (51, " .. "), (52, "Same"), (53, "same"), (54, "ünï")]
    docs = []
    for i in range(50):
        w = [word() for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = (r.choice(items)[1] or "").upper().replace(" ", "-").split()
        docs.append((i, ", ".join(w)))
    docs += [(k, t) for k, t, _ in EDGES]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n int")
    out = decontam.contamination(frame(spark, [(k, t, "s") for k, t in docs]), bench, block=block)
    got = out.select("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute_hits(docs, items)
    none = decontam.contamination(frame(spark, EDGES), bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(EDGES)
    assert decontam.contamination(frame(spark, []), bench).count() == 0


def shuffled(spark):
    """Bytes that this session has written to shuffles so far."""
    time.sleep(0.5)  # the status store follows the tasks
    return sum(x.totalShuffleWrite() for x in iter_java(spark._jsparkSession.sparkContext().statusStore().executorList(False)))


def iter_java(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_decontamination_without_broadcasts_is_linear(spark, monkeypatch):
    """Prefix words that are too many to broadcast, on long texts: what is shuffled follows the text's length, and hits are the same."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(words, k=40))) for i in range(150)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    moved, took = [], []
    for n in (2_000, 8_000, 32_000):
        docs = [(i, " ".join([*r.choices(words, k=n), *items[i][1].split()[5:30], *r.choices(words, k=n // 2)]), "s") for i in range(4)]
        df = frame(spark, docs)
        want = sorted(map(tuple, decontam.contamination(df, bench).drop("t").collect()))
        before, began = shuffled(spark), time.time()
        got = sorted(map(tuple, decontam.contamination(df, bench, block=0).drop("t").collect()))
        moved.append(shuffled(spark) - before)
        took.append(time.time() - began)
        assert got == want and all(x[2] >= 25 for x in got)
    assert moved[2] < 4.5 * moved[1] < 4.5 * 4.5 * moved[0] and took[2] < 60


# mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return t | {s: 3.0 * sizes[s] for s in capped}
        capped.update(over)


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randrange(0, 80), r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(400)] + EDGES
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for g in got:
        sizes[g.source] = sizes.get(g.source, 0) + g["size"]
        taken[g.source] = taken.get(g.source, 0) + g.taken
        target[g.source] = g.target
        assert 0 <= g.taken <= 3 * g["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, "", "a"), (2, None, None)])).agg({"taken": "sum"}).first()[0] == 0


# exact search


@pytest.mark.parametrize("clustered", [True, False])
def test_top_k_equals_brute_force(spark, clustered):
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 16)) * (0.05 if clustered else 1) + (r.normal(size=(9, 16)).repeat(100, axis=0) if clustered else 0)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist(), 1) for i in range(150)] + [(0, x[5].tolist(), 1)]
    rows += [(2000, None, 1), (2001, [float("nan")] * 16, 1), (2002, [None] * 16, 1), (None, x[0].tolist(), 1), (2050, [0.5] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, uid int").repartition(4)
    got = mtree.top_k(df, df["vec_id"] % 50 == 0, tree_rows=200, query_rows=7).collect()
    ok = [(k, np.floor(np.array(v) * 256)) for k, v, _ in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for i, (q, v) in enumerate(ok):
        if q % 50 == 0:
            s = sorted((-int(v @ u), k) for j, (k, u) in enumerate(ok) if j != i and len(u) == len(v))[:5]
            want += [(q, n + 1, k, -a) for n, (a, k) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert mtree.top_k(df.limit(0), df["vec_id"] % 50 == 0).count() == 0
    # Groves of several trees, looked into in rounds that start from the scores known.
    again = mtree.top_k(df, df["vec_id"] % 50 == 0, tree_rows=20, query_rows=7, first_groves=1).collect()
    assert sorted(map(tuple, again)) == sorted(want)


def test_top_k_of_large_components(spark):
    """Beyond what doubles hold exactly the tree still finds the integer best; what might not fit 64 bits is an error."""
    r = np.random.default_rng(8)
    x = np.floor(r.normal(size=(300, 4)) * 2**21)
    x[7], x[8] = x[50] * 64 + 1, x[50] * 64
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = mtree.top_k(df, df["vec_id"] % 50 == 0, tree_rows=100, query_rows=3).collect()
    ints = [[int(a) for a in v] for v in x]
    want = []
    for i in range(0, 300, 50):
        s = sorted((-sum(a * b for a, b in zip(ints[i], v)), j) for j, v in enumerate(ints) if j != i)[:5]
        want += [(i, n + 1, j, -a) for n, (a, j) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(Exception, match="64 bits"):
        mtree.top_k(spark.createDataFrame([(0, [1e12] * 4), (50, [1e12] * 4)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()


def test_top_k_of_products_beyond_64_bits(spark):
    """Products that do not fit 64 bits are added up exactly; only a score among the best must fit."""
    big = [(0, [2.0**50, 2.0**50, 1.0, 0.0])] + [(i, [2.0**50, -(2.0**50), float(i), 7.0]) for i in range(1, 40)] + [(40, [-(2.0**60), -(2.0**60), 0.0, 0.0])]
    df = spark.createDataFrame([(i, [a / 256 for a in v]) for i, v in big], "vec_id long, embedding array<double>").repartition(3)
    got = mtree.top_k(df, df["vec_id"] % 50 == 0, tree_rows=10, first_groves=1).collect()
    assert sorted(map(tuple, got)) == [(0, n + 1, 39 - n, 39 - n) for n in range(5)]


def test_tree_goes_on_from_what_is_known():
    r = np.random.default_rng(9)
    x = np.floor(r.normal(size=(1200, 6)) * 64)
    ids, norms = np.arange(1200), (x**2).sum(axis=1)
    tree = lambda part: mtree.Page(x, part, norms, 32)
    for q in range(0, 40, 5):
        want = sorted((-int(x[j] @ x[q]), j) for j in range(1200) if j != q)[:5]
        first = mtree.search(tree(ids[:500]), x, ids, ids, norms, x[q], q, 5, [0])
        cold, warm, floored = [0], [0], [0]
        mtree.search(tree(ids[500:]), x, ids, ids, norms, x[q], q, 5, cold)
        best = mtree.search(tree(ids[500:]), x, ids, ids, norms, x[q], q, 5, warm, known=first)
        assert [(-a, i) for a, i, _ in best] == want and warm[0] <= cold[0]
        rest = mtree.search(tree(ids[500:]), x, ids, ids, norms, x[q], q, 5, floored, floor=first[-1][0])
        assert sorted((-a, i) for a, i, _ in first + rest)[:5] == want and floored[0] <= cold[0]


def test_tree_skips_work():
    r = np.random.default_rng(7)
    x = np.floor((r.normal(size=(2000, 8)) * 0.02 + r.normal(size=(20, 8)).repeat(100, axis=0)) * 256)
    norms, work = (x**2).sum(axis=1), [0]
    root = mtree.Page(x, np.arange(2000), norms, mtree.PAGE)
    best = mtree.search(root, x, np.arange(2000), np.arange(2000), norms, x[3], 3, 5, work)
    s = x @ x[3]
    want = sorted((-int(v), i) for i, v in enumerate(s) if i != 3)[:5]
    assert [(-a, i) for a, i, _ in best] == want and work[0] < 2000


# quality


def test_quality_learns_and_holds_out(spark):
    r = random.Random(3)
    good = lambda: " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 9))) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(("###", "BUY!!", "$$$", "x|x")) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "s") for i in range(600)] + EDGES
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "de") for i in range(600)] + [(None, 1, "x"), (5, None, "x"), (7, 9, "x"), (9, 0, "x")], "doc_id long, quality int, lang string")
    out = quality.classify(frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in out)
    held = [g for g in out if g.held_out and g.doc_id is not None and g.doc_id < 600]
    assert held and all((g.score >= 0.5) == (g.doc_id % 3 > 0) for g in held)
    assert {g.score for g in quality.classify(frame(spark, EDGES), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(frame(spark, []), labels).count() == 0
    kept = quality.keep_good(frame(spark, rows), labels)
    assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")] and kept.filter("doc_id < 600 and doc_id % 3 > 0").count() == 400


def brute_tree(x, y, trees, depth):
    """Boosting by looking at every feature, every bound between bins and every row of a node, one after another."""
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, quality.TRAIN_BINS + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    raw, out = [start] * len(y), []
    for _ in range(trees):
        p = [1 / (1 + np.exp(-r)) for r in raw]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]

        def node(rows, level):
            if level == depth:
                return {"value": -quality.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + quality.LAMBDA)}
            worth = lambda rs: sum(g[i] for i in rs) ** 2 / (sum(h[i] for i in rs) + quality.LAMBDA)
            best = (1e-6, None, np.inf)
            for j, bounds in enumerate(edges):
                for b in bounds:
                    left, right = [i for i in rows if x[i, j] <= b], [i for i in rows if x[i, j] > b]
                    if min(len(left), len(right)) >= quality.LEAST and worth(left) + worth(right) - worth(rows) > best[0] + 1e-12:
                        best = (worth(left) + worth(right) - worth(rows), j, b)
            _, j, b = best
            left = [i for i in rows if j is None or x[i, j] <= b]
            right = [i for i in rows if j is not None and x[i, j] > b]
            return {"feature": j, "bound": b, "left": node(left, level + 1), "right": node(right, level + 1)}

        tree = node(list(range(len(y))), 0)
        out.append(tree)
        raw = [r + walk(tree, row) for r, row in zip(raw, x)]
    return start, out


def walk(tree, row):
    while "value" not in tree:
        tree = tree["left"] if tree["feature"] is None or row[tree["feature"]] <= tree["bound"] else tree["right"]
    return tree["value"]


def test_trees_equal_brute_force():
    r = np.random.default_rng(11)
    x = r.normal(size=(400, 4))  # large nodes: no two splits are equally good
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=400) * 0.3) > 0).astype(float)
    grown = quality.grow(x, y, trees=3, depth=2)
    start, trees = brute_tree(x, y, 3, 2)
    new = r.normal(size=(200, 4))
    for rows in (x, new):
        want = [1 / (1 + np.exp(-(start + sum(walk(t, row) for t in trees)))) for row in rows]
        assert grown.score(rows) == pytest.approx(want, abs=1e-9)


# html

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header>Site name</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies, really, many of them.</p></div>
<div id=content><div class=ad>Buy, buy, buy</div><article><header><h1>A &amp; B</h1><p>By someone</p></header><p>First,&nbsp;one
  two<br>three<p>Second <b>bold<p>Third</b> with <a href=y>a link</a>, and more, and more.<form><input><p>Search</form><ul><li>item one<li>item two</ul>
<!-- <p>hidden</p> --><div style="display: none">hidden</div><aside>Side</aside><section class="comments"><p>Nice, very nice, comment.</p></section></article></div>
<footer><p>&copy; 2024, all rights reserved, by us</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE).split("\n\n") == ["A & B", "First, one two three", "Second bold", "Third with a link, and more, and more.", "item one", "item two"]
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> </p>") == html.main_text("<nav>only, a, menu</nav>") == ""
    assert html.main_text("just text, no tags") == "just text, no tags"
    assert html.main_text("<article><p>cut &amp off, he") == "cut & off, he"
    long = "<article>" + "".join(f"<p>Paragraph {i}, of many.</p>" for i in range(20_000)) + "</article>"
    assert html.main_text(long).count("\n\n") == 19_999
    assert html.main_text("<div>" * 30_000 + "deep, deep text" + "</div>" * 30_000) == "deep, deep text"
    assert html.main_text("<p>a &lt;b&gt; c</p><script>x<") == "a <b> c"


@pytest.mark.parametrize(("name", "kept"), [
    ("main-content", True), ("has-sidebar", True), ("article-body", True), ("post", True), ("sidebar-left-layout", True), ("page-text", True), ("header-image-caption", True), ("story", True), ("adventure", True), ("shadow", True), ("gradient", True), ("navy-blue", True),
    ("ad", False), ("ad-slot", False), ("main-nav", False), ("page-header", False), ("siteFooter", False), ("comment-list", False), ("post-comments", False), ("sidebar-content", False), ("cookie-box", False), ("top-banner", False), ("notice", False), ("newsletter_form", False),
])
def test_html_names(name, kept):
    page = f"<article><p>Some text, with words.</p><div class='{name}'><p>The part, in question.</p></div></article>"
    assert ("question" in html.main_text(page)) == kept


def test_html_extract(spark):
    df = spark.createDataFrame([(1, PAGE, "old"), (2, None, "x"), (1, PAGE, "old")], "page_id long, html string, text string")
    out = html.extract(df)
    assert out.columns == ["page_id", "html", "text"] and [r.text == "" for r in out.orderBy("page_id").collect()] == [False, False, True]
    assert html.extract(df.limit(0)).count() == 0


# chat


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, None, None, "?"), (2, 0, "system", "alone"), (None, 1, "x", "é")]
    rows += [(3, i, "ab"[i % 2], f"m{i}") for i in range(200)] + [(4, 7, "p", f"t{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, m int")
    out = chat.rotate(df).collect()
    one = {r.perspective: r for r in out if r.conv_id == 1 and r.part == 0}
    assert set(one) == {"ann", "bob", "unknown"}
    assert one["ann"].text == "<|im_start|>user name=unknown\n?<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    for r in out:
        said = [r.text[s.start : s.end] for s in r.loss_spans]
        # What is said again at the head of a later part carries no loss.
        again = r.text.count("<|im_start|>") - r.n_turns
        assert said and all(x.endswith("<|im_end|>") for x in said) and 0 <= again <= (5 if r.part else 0)
        assert len(said) == sum(x.startswith("assistant\n") for x in r.text.split("<|im_start|>")[1 + again :])
    assert not [r for r in out if r.conv_id == 2]
    long = chat.rotate(spark.createDataFrame([(9, 0, "system", "be kind")] + [(9, i, "ab"[i % 2], f"m{i}") for i in range(1, 200)], "conv_id long, turn long, role string, text string")).filter("perspective = 'a'").collect()
    assert all(r.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n") and r.text.count("system\n") == 1 for r in long) and sum(r.n_turns for r in long) == 200
    assert sorted(r.part for r in out if r.conv_id == 3 and r.perspective == "a") == [0, 1, 2, 3]
    crowd = sorted((r for r in out if r.conv_id == 4), key=lambda r: r.part)
    assert sum(r.n_turns for r in crowd) == 300 and len(crowd) == 5
    said = [line for r in crowd for line in r.text.split("\n")[:-1] if line.startswith("t")]
    every = [f"{t}<|im_end|>" for t in sorted(f"t{i}" for i in range(300))]  # in order across the parts, each after the last four of the one before
    assert said == [x for p in range(5) for x in every[max(0, 64 * p - 4) : 64 * p + 64]]
    assert chat.rotate(df.limit(0)).count() == 0


def test_parts_follow_places_and_not_turn_numbers(spark):
    """Times, gaps and message ids as turns give the parts that dense turns give; each turn is learnt once for its speaker."""
    n = 150
    dense = [(1, i, "ab"[i % 2] if i % 50 else f"guest{i}", f"m{i}") for i in range(n)]
    times = [(1, 1_700_000_000 + 977 * i * i, r, t) for _, i, r, t in dense]
    schema = "conv_id long, turn long, role string, text string"
    a, b = (sorted(map(tuple, chat.rotate(spark.createDataFrame(x, schema)).collect())) for x in (dense, times))
    assert a == b and max(r[2] for r in a) == 2
    learnt = [r[4][s.start : s.end] for r in a for s in r[5]]
    assert sorted(learnt) == sorted(f"m{i}<|im_end|>" for i in range(n))
    assert {(r[1], r[2]) for r in a if r[1].startswith("guest")} == {("guest0", 0), ("guest50", 0), ("guest100", 1)}
    assert next(r for r in a if r[2] == 1)[4].split("\n")[1] == "m60<|im_end|>"
