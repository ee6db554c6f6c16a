"""Language, extraction, toxicity, quality and divergence on small fixtures, against plain versions or held-out accuracy."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from pocketlake.llm import divergence, html_extract, langid, quality_bayes, textstats, toxicity
from pocketlake.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
ODD = [(None, None), (1, ""), (2, " \n\n"), (3, "12 345 !?"), (4, "Ab"), (4, "Ab"), (5, "ñ " * 20_000), (6, "\x00\x7f%$#")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, None, None, "x", 1.0) for k, t in ODD], "doc_id long, text string, lang string, source string, score string, margin double")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 0


# language


@needs_data
def test_language_held_out(tables):
    docs, _ = tables
    rows = langid.predict(docs, langid.learn(docs)).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == out(r.doc_id) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.accepted for r in rows) >= 0.97 * len(rows)


@needs_data
def test_language_ignores_other_columns(spark, tables, odd):
    docs, _ = tables
    model = langid.learn(docs)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = dict(ODD)[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in model.languages
    assert langid.predict(odd.limit(0), model).count() == 0
    assert langid.accepted_rows(odd, model).columns == odd.columns
    accepted = {r.doc_id for r in rows if r.accepted}
    assert {r.doc_id for r in langid.accepted_rows(odd, model).collect()} == accepted


def test_language_without_labels(odd):
    model = langid.learn(odd)
    assert model.languages == ()
    assert {r.lang_pred for r in langid.predict(odd, model).collect()} == {"und"}


def test_language_learns_from_training_rows_only(spark):
    rows = [(i, "aaa bbb ccc " * 5, "held" if out(i) else "own") for i in range(50)]
    assert langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ("own",)


# extraction

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<!-- <p>note</p> --><header><a href=/>Home</a> Site</header><div class="cookie-notice">We use cookies, sorry.</div>
<div id=page><div class="main-menu"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>
{open}<h1>A &lt;title&gt; &amp; more</h1><p>First paragraph,   with some
text; it is long enough, surely.<p>Second <b>bold and <i>both</b> words,<br>a line&nbsp;more &copy; &#x41;.<ul><li>item one</li><li>item two.</ul>
<div class="ad">Buy, now!</div><script>if (a < b) document.write("<p>no</p>")</script><p>Oh.</p>
<table><tr><td>cell<td>other</table><form>Name <input name=x> <button>Go</button></form>{close}
<div class="sidebar"><p>Related, things.</p></div><section id="comments"><p>First! I think, that this is nice, really.</p></section></div>
<footer>&copy; us</footer>"""
TEXT = [
    "A <title> & more", "First paragraph, with some text; it is long enough, surely.", "Second bold and both words, a line more © A.",
    "item one", "item two.", "Oh.", "cell", "other",
]


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ('<div class="content-wrap">', "</div>"), ("<main>", "")])
def test_page_parts(wrap):
    assert html_extract.main_text(PAGE.replace("{open}", wrap[0]).replace("{close}", wrap[1])).split("\n") == TEXT


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "just text"), (4, "u", "<p>a<p>b<di"), (5, "u", "<nav>x</nav>"), (5, "u", "<nav>x</nav>"), (None, "u", "<p>" + "word, " * 50_000), (7, "u", "<a href='x>y</a><p>q")]
    frame = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, n_chars long")
    rows = html_extract.extract(frame).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    by = {r.page_id: r.text for r in rows}
    assert (by[1], by[2], by[3], by[4], by[5]) == ("", "", "just text", "a\nb", "")
    assert by[None] == ("word, " * 50_000).strip()
    assert html_extract.extract(frame.limit(0)).count() == 0


@needs_data
def test_given_pages(spark):
    import html

    rows = QUERIES["op4_html"](spark, str(DATA)).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b)))).strip() for b in re.split("</?(?:h1|p)>", body))
        assert r.text == "\n".join(b for b in blocks if b)


# toxicity


def toxic_rows(n, bad=("vile", "foul", "nasty")):
    random = np.random.default_rng(3)
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in random.zipf(1.3, 60) % 5000]
        words = [w.replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace("7", "h").replace("8", "i").replace("9", "j") for w in words]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words[int(random.integers(60))] = bad[int(random.integers(len(bad)))]
        rows.append((i, " ".join(words), "en", toxic))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(900)
    docs = spark.createDataFrame([(k, t, lang, 1, "s") for k, t, lang, _ in rows], "doc_id long, text string, lang string, toxic int, score string")
    labels = spark.createDataFrame([(k, y, 0.5) for k, _, _, y in rows] + [(None, 1, 0.1), (3, None, 0.1)], "doc_id long, toxic int, score double")
    network = toxicity.learn(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, network).collect()}
    held = [(found[k], y) for k, _, _, y in rows if out(k)]
    assert all(r.held_out for r, _ in held)
    assert np.mean([r.predicted == y for r, y in held]) >= 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())


def test_toxicity_labels_of_held_out_rows_play_no_part(spark):
    rows = toxic_rows(200)
    docs = spark.createDataFrame([(k, t, lang) for k, t, lang, _ in rows], "doc_id long, text string, lang string")
    one = [(k, y) for k, _, _, y in rows]
    other = [(k, 1 - y if out(k) else y) for k, y in one]
    scores = [
        sorted((r.doc_id, r.score) for r in toxicity.score(docs, toxicity.learn(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).collect())
        for x in (one, other)
    ]
    assert scores[0] == scores[1]


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    network = toxicity.learn(odd, labels)
    rows = toxicity.score(odd, network).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    empty = toxicity.learn(odd.limit(0), labels.limit(0))
    assert {r.predicted for r in toxicity.score(odd, empty).collect()} == {0}
    assert toxicity.score(odd.limit(0), network).count() == 0


def test_long_text_in_blocks(monkeypatch):
    random = np.random.default_rng(1)
    codes = [random.integers(0, 1 << 32, n, dtype=np.uint32) for n in (0, 1, 2, 3, 50, 400)] * 3
    network = toxicity.train(codes, np.arange(18) % 2.0, ["a", "b"] * 9)
    whole = [toxicity.Scorer(network).raw(c) for c in codes]
    monkeypatch.setattr(toxicity.Scorer, "BLOCK", 7)
    for (a, lang), (b, same) in zip(whole, [toxicity.Scorer(network).raw(c) for c in codes], strict=True):
        assert a == pytest.approx(b) and lang == same


def test_gradient():
    """The filters' gradient against differences."""
    random = np.random.default_rng(5)
    network = toxicity.train([random.integers(0, 1 << 32, 9, dtype=np.uint32) for _ in range(6)], np.array([1.0, 0, 1, 0, 1, 0]), [None] * 6)
    rows = toxicity.buckets(random.integers(0, 1 << 32, 12, dtype=np.uint32))
    lean = np.stack([random.normal(size=toxicity.BUCKETS + 1) for _ in range(2)])
    network.bias[:] = 0.3

    def loss():
        p = 1 / (1 + np.exp(-network.logit(toxicity._forward(network, rows, lean)[1])))
        return -np.log(p)

    gradients = [np.zeros_like(network.filters), np.zeros_like(network.bias), np.zeros_like(network.output), np.zeros(1)]
    tables = [t.copy() for t in network.tables]
    toxicity._backward(network, rows, lean, 1.0, 1.0, gradients)
    network.tables = tables
    for at in [(0, 0, 0), (1, 2, 3), (2, 1, 7), (5, 7, 4)]:
        network.filters[at] += 1e-5
        up = loss()
        network.filters[at] -= 2e-5
        down = loss()
        network.filters[at] += 1e-5
        assert gradients[0][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


# quality


@needs_data
def test_quality_keeps_clean(tables):
    docs, labels = tables
    rows = {r.doc_id: r for r in quality_bayes.judge(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    assert len(rows) == docs.count()
    assert np.mean([rows[k].kept for k, y in truth.items() if y == 1]) >= 0.99
    assert np.mean([not rows[k].kept for k, y in truth.items() if y == 0]) >= 0.9
    kept = {r.doc_id for r in quality_bayes.kept_rows(docs, labels).collect()}
    assert kept == {k for k, r in rows.items() if r.kept}


def plain_strength(groups, mean_of):
    n = np.array([g[1] for g in groups], float)
    m = np.array([g[0] / g[1] for g in groups])
    mu = np.array([mean_of(i) for i in range(len(groups))])
    noise = mu * (1 - mu)
    room = n.sum() - (n * n).sum() / n.sum()
    between = ((n * (m - mu) ** 2).sum() - (noise.sum() - (n * noise).sum() / n.sum())) / room if room > 0 else 0
    fitted = (n * noise).sum() / n.sum() / between - 1 if between > 0 else quality_bayes.STRONGEST
    return min(max(fitted, quality_bayes.WEAKEST), quality_bayes.STRONGEST)


def test_site_posteriors(spark):
    random = np.random.default_rng(9)
    rows = []
    for host in ["a", "b", "c", "d", None]:
        for path in ["x", "y", None]:
            level = random.uniform(0.2, 0.9)
            rows += [(host, path, float(np.clip(random.normal(level, 0.1), 0, 1))) for _ in range(int(random.integers(1, 60)))]
    sites, prior = quality_bayes.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double").repartition(4))
    mean = np.mean([p for _, _, p in rows])
    hosts = {h: [sum(p for x, _, p in rows if x == h), sum(x == h for x, _, _ in rows)] for h in {r[0] for r in rows}}
    names = list(hosts)
    strong = plain_strength([hosts[h] for h in names], lambda i: mean)
    host_post = {h: (s + strong * mean) / (n + strong) for h, (s, n) in hosts.items()}
    paths = {(h, q): [sum(p for a, b, p in rows if (a, b) == (h, q)), sum((a, b) == (h, q) for a, b, _ in rows)] for h, q in {r[:2] for r in rows}}
    keys = list(paths)
    weak = plain_strength([paths[k] for k in keys], lambda i: host_post[keys[i][0]])
    assert (prior.mean, prior.host_strength, prior.path_strength) == pytest.approx((mean, strong, weak))
    for r in sites.collect():
        s, n = paths[(r.host, r.path)]
        assert r.host_posterior == pytest.approx(host_post[r.host])
        assert r.path_posterior == pytest.approx((s + weak * host_post[r.host]) / (n + weak))


def test_quality_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_bayes.judge(odd, none).collect()
    assert len(rows) == len(ODD) and all(r.p_document == 0.5 and r.kept for r in rows)
    extra = odd.withColumnsRenamed({"score": "_p", "margin": "_host"})
    assert quality_bayes.kept_rows(extra, none).columns == extra.columns
    assert quality_bayes.kept_rows(extra, none).count() == len(ODD)
    labels = spark.createDataFrame([(4, 1, "a"), (4, 1, "b"), (3, 0, "a"), (None, 1, "a"), (5, None, "a")], "doc_id long, quality int, text string")
    assert quality_bayes.judge(odd, labels).count() == len(ODD)
    assert quality_bayes.judge(odd.limit(0), labels).count() == 0


# divergence


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered), failed


@needs_data
def test_rules_against_plain_counts(spark, tables):
    docs, labels = tables
    rows = {r.doc_id: r for r in QUERIES["op10_divergence"](spark, str(DATA)).collect()}
    for d in docs.collect():
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(d.text)
        assert not (r.base_failed and r.kept)
    good = [r.doc_id for r in labels.collect() if r.quality == 1]
    judged = [rows[k] for k in good if not rows[k].base_failed]
    assert np.mean([r.kept for r in judged]) >= 0.99


def test_rules_on_odd_rows(odd):
    references = divergence.learn_references(odd)
    assert references == []
    rows = divergence.judge(odd, references).collect()
    by = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=str)
    assert by == sorted([(k, *plain_counts(t)) for k, t in ODD], key=str)
    assert divergence.judge(odd.limit(0), references).count() == 0


@needs_data
def test_references_against_plain_counts(tables, monkeypatch):
    """Common words come through the summaries whole, also when the summaries are cut often."""
    monkeypatch.setattr(divergence, "SUMMARY", 4000)
    docs, _ = tables
    found = {r.lang: r for r in divergence.learn_references(docs.repartition(7))}
    words: dict = {}
    classes: dict = {}
    for d in docs.collect():
        body = d.text.encode()
        words.setdefault(d.lang, Counter()).update(textstats.bare_words(body))
        classes[d.lang] = classes.get(d.lang, 0) + textstats.class_counts(textstats.byte_counts(body))
    assert set(found) == set(words)
    for lang, counts in words.items():
        total = sum(counts.values())
        common = sorted(w for w, n in counts.items() if n >= divergence.COMMON * total)
        assert list(found[lang].words) == common
        assert found[lang].word_counts.tolist() == [*(counts[w] for w in common), total - sum(counts[w] for w in common)]
        assert found[lang].classes.tolist() == classes[lang].tolist()


def test_summary_never_loses_a_heavy_word():
    random = np.random.default_rng(0)
    stream = [f"w{i}" for i in random.zipf(1.5, 20_000) % 3000]
    summary, error = Counter(), 0
    for at in range(0, len(stream), 500):
        summary.update(stream[at : at + 500])
        summary, cut = divergence.shrink(summary, 50)
        error += cut
    assert error <= len(stream) / 51
    for word, n in Counter(stream).items():
        assert summary[word] <= n <= summary[word] + error


def test_js_distance():
    assert divergence.js_distance(np.array([1, 1]), np.array([2, 2])) == 0
    assert divergence.js_distance(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1)
    assert divergence.js_distance(np.array([0, 0]), np.array([0, 1])) == 1


# registry


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not there")
def test_search_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    expected = sorted(base.sql(ORACLES["op6_vafile"]).fetchall())
    assert sorted(map(tuple, QUERIES["op6_vafile"](spark, SMALL).collect())) == expected
