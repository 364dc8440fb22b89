"""Operators 2, 5 and 10, and the pipeline."""

import html
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import bpe, decontaminate, pages, pii, pseudo_likelihood as L
from recollect.llm import quality as Q
from recollect.llm import queries
from tests.llm.test_simhash import near_groups


# --- 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("just &lt;text&gt; 3 < 4", "just <text> 3 < 4"),
        ("<p>one<p>two &amp three &copy; &#233;<br>x", "one two & three © é x"),
        ("<nav>menu</nav><article><h1>T</h1><p>a <b>b</b>c</p></article><footer>f</footer>", "T a bc"),
        ("<article>keep<div class='comments'>no</div><aside>no</aside><form>no</form> too</article>", "keep too"),
        ("<div class=ad>no</div><div id='cookieNotice'>no</div><div class='header'>no</div><p>yes", "yes"),
        ("<script>var t='</p>';x<y</script><style>p{}</style><p>ok</p><!-- no --> <noscript>no</noscript>", "ok"),
        ("<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table>", "a b x y z"),
        ("<article>cut &amp; short<p>here</p><p unfinished", "cut & short here"),
        ("<main>outer<article>inner</article></main>", "inner"),
        ("<article hidden>no</article><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("<p>a &nbsp; b\n\tc</p>", "a b c"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<div class='with-sidebar'><p>text</p></div><div class='side-bar'>no</div><section id=comments><p>no</p></section>", "text"),
        ("<script>never closed <p>x", ""),
    ],
)
def test_main_text(page, want):
    assert pages.main_text(page, {}) == want


def test_articles_of_the_table(spark, small):
    rows = queries.op2_pages(spark, small).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        article = re.search("<article>(.*)</article>", source[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())
        assert r.text == want and r.n_chars == len(want)


def plain_tree(rows):
    """Importance of each (host, path), by counting pages of each content and presentation in loops."""
    shows, texts, kinds = {}, {}, {}
    for url, page in rows:
        root, host = pages.parse(page or ""), pages.host_of(url)
        found = [(n.path, t) for n, t in pages.blocks(root) if not n.declared]
        identity = tuple(sorted({t for _, t in found}, key=lambda t: (-len(t), t))[: pages.TELLING])
        own = {}
        for n in pages.nodes(root):
            if not n.declared:
                styles = [c.style for c in n.parts if not isinstance(c, str)]
                own.setdefault(n.path, set()).add(tuple(x for x, y in zip(styles, [None, *styles], strict=False) if x != y))
        for path, s in own.items():
            shows.setdefault((host, path), {}).setdefault(frozenset(s), set()).add(identity)
            kinds[host, path] = max(kinds.get((host, path), 0), len({x for one in s for x in one}))
        for path, t in found:
            texts.setdefault((host, path), {}).setdefault(t, set()).add(identity)
    out = {}
    for (host, path), each in shows.items():
        m, below = sum(map(len, each.values())), []
        for (h, q), contents in texts.items():
            if h == host and (q == path or q.startswith(path + "/")):
                pages_there = sum(map(len, shows[h, q].values()))
                logs = sum(math.log(len(ids)) for ids in contents.values())
                below.append((min(logs / math.log(pages_there), len(contents)) if pages_there > 1 else 0.0, len(contents)))
        if not below:
            continue
        p = [len(ids) / m for ids in each.values()]
        presentation = -sum(x * math.log(x) for x in p) / math.log(m) if m > 1 else 1.0
        content = 1 - sum(x for x, _ in below) / sum(n for _, n in below)
        weight = pages.DAMPING ** kinds[host, path]
        out[host, path] = 1 - (1 - ((1 - weight) * presentation + weight * content)) * m / (m + 1)
    return out


def test_tree_against_loops(spark, small):
    rng = random.Random(6)
    odd_pages = []
    for k in range(80):
        extra = rng.choice(["<div class=note>on every page</div>", "<div class=note>now and then</div><p>x", "", "<section><p>deep<div><p>er</div></section>"])
        odd_pages.append((f"http://h{k % 3}.example/", f"<body>{extra}<article><p>story {k // 2}</p><p>by the same author</p></article><div>call us</div>"))
    for rows in ([(r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()], [*odd_pages, (None, None), ("http://[", "x")]):
        df = spark.createDataFrame(rows, "url string, html string").repartition(3)
        want = plain_tree(rows)
        got = {(r.host, r.path): r.importance for r in pages.style_tree(df).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
        by_host = {}
        for (host, path), x in want.items():
            by_host.setdefault(host, {})[path] = x
        texts = sorted(r.text for r in pages.extract(df).collect())
        assert texts == sorted(pages.main_text(page or "", by_host.get(pages.host_of(url), {})) for url, page in rows)


def test_importance_decides_within_articles(spark, small):
    for r in spark.read.parquet(f"{small}/pages.parquet").limit(20).collect():
        every = {n.path: 0.0 for n in pages.nodes(pages.parse(r.html))}
        assert "<article>" in r.html and pages.main_text(r.html, {}) and not pages.main_text(r.html, every)
    page = lambda k: f"<article><h1>Title {k}</h1><p>story {k}</p><div class=note><p>all rights are with the paper</p></div></article><div>beside {k}</div>"
    # copies of one article with an address of their own are one page of the tree: nothing of them is taken for what repeats
    copy = lambda k: f"<p>{k}</p><article><h1>Same</h1><p>a long and often copied story</p><p>with two paragraphs</p></article>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(12)] + [(20 + k, "http://b.example/", copy(k)) for k in range(12)]
    out = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Title 3 story 3" and out[23] == "Same a long and often copied story with two paragraphs"


def test_style_tree_removes_what_repeats(spark):
    page = lambda k: f"<body><div class='x1'>same promise on each page</div><div class='story'><p>story {k} alone</p></div><div class='x2'><p>call us</p></div></body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(8)] + [(9, "http://b.example/", page(9)), (10, None, None), (11, "http://[", ""), (12, "http://a.example/0", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    tree = {r.path: r.importance for r in pages.style_tree(df).filter("host = 'a.example'").collect()}
    assert tree["html/body/div.x"] < pages.LOW < tree["html/body/div.story"]
    out = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert out[3] == "story 3 alone" and out[9].startswith("same promise") and out[10] == "" and out[12] == "story 0 alone"
    assert pages.extract(df.limit(0)).count() == 0
    assert pages.extract(df.withColumn("text", F.lit("own"))).columns == ["page_id", "url", "html", "text"]


def test_end_tags_without_a_start_take_linear_time():
    began = time.perf_counter()
    pages.parse("<div>" * 100_000 + "</p>" * 100_000)
    assert time.perf_counter() - began < 20
    assert pages.main_text("<div>a</p>b</div></section>c<ul><li>d</div>e</ul>f", {}) == "ab c de f"


# --- 5


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(0)
    m = Q.Machine(0.3, rng.normal(size=Q.SIZE).astype(np.float32), rng.normal(size=(Q.SIZE, Q.FACTORS)).astype(np.float32))
    rows = [(rng.choice(Q.SIZE, n, replace=False), rng.normal(size=n).astype(np.float32)) for n in (3, 7, 1)]
    for (p, x), got in zip(rows, m.margins(rows)[0], strict=True):
        want = m.bias + m.w[p] @ x + sum(m.v[p[i]] @ m.v[p[j]] * x[i] * x[j] for i in range(len(p)) for j in range(i))
        assert got == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op5_quality(spark, folder).toPandas()
    both = rows.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert rows.score.between(0, 1).all() and len(held) > 50
    assert (held.predicted == held.quality).mean() > 0.95
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_odd_labels(spark, odd, nothing):
    labels = spark.createDataFrame([(6, 1), (9, 0), (100, 1), (101, None), (102, 0), (102, 1), (None, 1), (10, 0)], "doc_id long, quality int")
    scored = Q.with_score(odd, Q.fit(odd, labels)).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    by_text = {}
    for r in scored:
        by_text.setdefault(r.text or "", set()).add(round(r.score, 6))
    assert all(len(v) == 1 for v in by_text.values())
    assert {r.score for r in Q.with_score(odd, Q.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in Q.with_score(odd, Q.fit(odd, labels.filter("quality = 1 AND doc_id IN (6, 100)"))).collect()} == {0.95}
    assert Q.with_score(nothing, Q.fit(nothing, labels)).count() == 0


# --- 10


def small_network(seed=0):
    rng = np.random.default_rng(seed)
    words = L.Words([f"w{k}" for k in range(12)], [50 - k for k in range(12)], 30, rng.integers(0, 9, (L.END + 1, L.END + 1)).astype(float))
    net = L.Network(words, rng.normal(0, 0.7, (2 * (12 + L.PLACES + 1) + 1) * L.UNITS), rng.random((13, L.UNITS)) * 40)
    return words, net


def one_by_one(words, net, text):
    """The pseudo-likelihood of a text, token by token and unit by unit."""
    known, w, out = L.Tokens(words), text.split(), []
    ids = [known[x] for x in w]
    for i, own in enumerate(ids):
        z = net.bias[0].astype(float).copy()
        for j in range(max(0, i - L.WINDOW), i):
            z += net.left[ids[j]]
        for j in range(i + 1, min(len(ids), i + L.WINDOW + 1)):
            z += net.right[ids[j]]
        h = np.exp(z - z.max())
        h /= h.sum()
        p = sum(h[k] * net.q[min(own, net.rare), k] for k in range(L.UNITS))
        spelled = 0.0
        if own >= net.rare:
            chain = [L.END, *w[i].encode(), L.END]
            spelled = sum(float(words.spelling[a, b]) for a, b in zip(chain, chain[1:], strict=False))
        out.append(np.log(p) + spelled)
    return out


def test_scores_are_the_pseudo_likelihood(spark):
    words, net = small_network()
    rng = random.Random(2)
    texts = [" ".join(rng.choice([f"w{rng.randrange(12)}", f"rare{rng.randrange(99)}", "é日"]) for _ in range(n)) for n in (0, 1, 2, 5, 9, 40)]
    df = spark.createDataFrame([*enumerate(texts), (6, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in L.scored(df, words, net).collect()}
    for k, t in enumerate(texts):
        want = one_by_one(words, net, t)
        assert out[k].n_tokens == len(want) and out[k].log_likelihood == pytest.approx(sum(want), abs=2e-3)
    assert (out[6].n_tokens, out[6].log_likelihood, out[6]["mean"]) == (0, 0, 0)


def test_probabilities_sum_to_one():
    words, net = small_network(1)
    x = np.array([3, 250, 7, 1, 0, 9, net.none, 4, 11], np.int32)
    p = 0.0
    for k in range(net.rare + 1):  # the last is the class of all rare words
        x[L.WINDOW] = k
        p += float(np.exp(net.log_probabilities(x)[0]))
    assert p == pytest.approx(1, abs=1e-5)
    assert np.exp(words.spelling.astype(float)).sum(1) == pytest.approx(np.ones(L.END + 1), abs=1e-4)


def test_slopes_are_the_numeric_gradient():
    _, net = small_network(2)
    rng = np.random.default_rng(3)
    x = np.concatenate([[net.none] * L.WINDOW, rng.integers(0, 15, 20), [net.none] * L.WINDOW]).astype(np.int32)
    _, g = net.slopes(x)
    n, total = len(x) - 2 * L.WINDOW, lambda: float(net.log_probabilities(x).astype(np.float64).sum())
    for table, offsets in ((net.left, range(-L.WINDOW, 0)), (net.right, range(1, L.WINDOW + 1))):
        for token, unit in ((3, 0), (7, 5), (11, 31), (14, 2)):
            want = sum(g[i, unit] for i in range(n) for k in offsets if x[L.WINDOW + i + k] == token)
            old = table[token, unit]
            table[token, unit] = old + 0.01
            up = total()
            table[token, unit] = old - 0.01
            assert (up - total()) / 0.02 == pytest.approx(want, abs=5e-3)
            table[token, unit] = old


def test_neighbours_stay_in_their_text():
    words = L.Words(["a", "b"], [5, 4])
    strings, x, begins = L.stream(["a b", "", "b"], L.Tokens(words), 99)
    e = [99] * L.WINDOW
    assert strings == ["a", "b", "b"] and x.tolist() == [*e, 0, 1, *e, *e, 1, *e] and begins.tolist() == [4, 10, 14]


def test_better_than_frequencies_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(L, "PART", 40_000)  # several parts in a round
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kept, apart = docs.filter("doc_id % 10 <> 3"), docs.filter("doc_id % 10 = 3")
    out, nets = [], []
    for n in (2, 8):
        words = L.vocabulary(kept.repartition(n))
        nets.append(L.trained(kept.repartition(n), words))
        out.append({r.doc_id: r["mean"] for r in L.scored(apart, words, nets[-1]).collect()})
    assert out[0].keys() == out[1].keys() and max(abs(out[0][k] - out[1][k]) for k in out[0]) < 1e-3
    gain, tokens, known, log = 0.0, 0, L.Tokens(words), np.log(words.frequencies())
    for r in apart.collect():
        _, x, _ = L.stream([r.text], known, nets[0].none)
        real = x[L.WINDOW : -L.WINDOW] != nets[0].none
        own = np.minimum(x[L.WINDOW : -L.WINDOW][real], nets[0].rare)
        gain, tokens = gain + float((nets[0].log_probabilities(x)[real] - log[own]).sum()), tokens + len(own)
    assert tokens > 20_000 and gain / tokens > 0.4  # nats a token


def test_learning_and_scoring(spark, odd, nothing):
    rng = random.Random(0)
    chain = "red blue green black white grey pink brown".split()
    text = lambda: " ".join(chain[(rng.randrange(8) + k) % 8] if k % 50 == 0 else chain[k % 8] for k in range(80))
    df = spark.createDataFrame([(k, text()) for k in range(900)], "doc_id long, text string").repartition(3)
    words = L.vocabulary(df)
    net = L.trained(df, words)
    mixed = lambda t: " ".join(rng.sample(t.split(), len(t.split())))
    sample = [text() for _ in range(30)]
    pair = spark.createDataFrame([(k, t) for k, t in enumerate(sample + [mixed(t) for t in sample])], "doc_id long, text string")
    out = {r.doc_id: r["mean"] for r in L.scored(pair, words, net).collect()}
    assert np.mean([out[k] > out[k + 30] for k in range(30)]) == 1
    rows = L.score(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.n_tokens == len((r.text or "").split()) and (r.log_likelihood == 0) == (r.n_tokens == 0)
    assert L.score(nothing).count() == 0


def test_vocabulary_grows_with_the_corpus(spark):
    rng = random.Random(1)
    often, junk = [f"often{k}" for k in range(300)], [f"junk{k}" for k in range(3000)]
    texts = [" ".join(rng.sample(often, 100) + [junk.pop()]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    words = L.vocabulary(df)
    assert set(words) == set(often) and words.total == 6060 and words.seen[-1] == 60
    net = L.Network(words)
    a, b = net.spelled(["junk77", "zzqqzz"])
    assert a > b  # rare words are spelled alike


# --- the pipeline


def test_pipeline_equals_its_parts(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, small)
    rows = {r.doc_id: r for r in out.collect()}
    base = spark.read.parquet(f"{small}/documents.parquet")
    machine = Q.fit(base, spark.read.parquet(f"{small}/labels.parquet").filter(~Q.held_out()))
    good = sorted(r.doc_id for r in Q.with_score(base, machine).collect() if r.score >= Q.GOOD)
    single = set(near_groups([(d, docs[d].text) for d in good]))
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.contained(base, items).collect()}
    assert set(rows) == single - leaks
    coder = bpe.tokenizer_of(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    for d, r in rows.items():
        assert r.ids == coder.encode(r.text) and r.decoded == r.text and r.n_chars == len(r.text)
        assert r.lang == docs[d].lang and r.source == docs[d].source
    assert pii.find(out.select("doc_id", "text")).filter(F.exists("findings", lambda f: f["kind"] < pii.TERM)).count() == 0


def test_stages_on_odd_rows(spark, odd, clashing, nothing, tmp_path):
    folder = str(tmp_path)
    odd.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{folder}/labels.parquet")
    odd.select(F.col("doc_id").alias("item_id"), F.lit("an item that no text has in it at all").alias("text")).write.parquet(f"{folder}/benchmark.parquet")
    for df in (odd, clashing, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, folder)
            assert k == 4 or out.columns == df.columns
            assert out.count() <= df.count()


@pytest.mark.parametrize("most", [1, 3, 40])
def test_sums_of_runs(most):
    rng = np.random.default_rng(most)
    sizes = rng.integers(1, most + 1, 50)
    rows = rng.normal(size=(sizes.sum(), 6)).astype(np.float32)
    begins = np.cumsum(sizes) - sizes
    assert np.allclose(L.sums_of_runs(rows, begins), np.add.reduceat(rows, begins, axis=0), atol=1e-5)
