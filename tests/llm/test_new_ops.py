"""Web page text, conversation trie and spelling variants against plain-Python versions."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from kinetra.llm import conversation_trie, html_blocks, html_extract, queries, sql, variants


def plain(df, *cols):
    return sorted(tuple("" if v is None else str(v) for v in (r[c] for c in cols)) for r in df.collect())


# --- op13


def brute_words(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), str(n), str(len(near[w])), str(words[form[w]]) if form[w] else "") for w, n in words.items())


VARIANT_COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_on_edges(spark):
    texts = [None, "", "12 345 --", "hello hello hello hello helo hallo hallo", "HELLO Hello hellos hellos hellos helloss helloss helloss", "aaaaa " * 5 + "aaaaaa " * 3 + "aaaaaaa " * 12, "Étéété étéété " * 3 + "Ābcdefgh " * 3 + "x×yzw " * 3 + "xyyzw " * 4]
    texts += ["vocab vocal vocat voca vocab vocabs " * 3, "abcd* abcde abcdf bbcde abcdeg " * 7, ("long" * 3000 + " ") * 3 + ("long" * 2999 + "lung ") * 6 + ("long" * 2999 + "lon ") * 3, "x" * 100_000]
    rows = [(i if i else None, t, "w", 3) for i, t in enumerate(texts)] + [(3, texts[3], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    want = brute_variants(brute_words([(r[0], r[1]) for r in rows]))
    assert len(want) > 12
    assert plain(variants.spelling_variants(variants.count_words(df)), *VARIANT_COLUMNS) == want
    empty = variants.spelling_variants(variants.count_words(df.limit(0)))
    assert empty.collect() == [] and empty.columns == list(VARIANT_COLUMNS)


def test_variants_of_whole_tables(spark, sf_dir):
    got = queries.op13_wildcard_variants(spark, sf_dir)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duckdb.sql(sql.OP13_SQL).fetchall()
    assert plain(got, *VARIANT_COLUMNS) == sorted(tuple("" if v is None else str(v) for v in r) for r in want)


def test_chains_of_forms_and_crowded_groups(spark):
    """A chain of twelve forms, and a wildcard group as large as an alphabet."""
    chain = [("a" * 5 + "b" * k, 3 * 2**k) for k in range(12)]
    crowd = [(f"word{chr(c)}s", 3 if c != 200 else 7) for c in [*range(97, 123), *range(192, 256)]]
    rows = chain + crowd
    got = plain(variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")), *VARIANT_COLUMNS)
    assert got == brute_variants(dict(rows))
    assert {g[2] for g in got if g[0].startswith("aaaaab")} == {"a" * 5 + "b" * 11}


def test_keys_spell_what_they_stand_for():
    words = ["abcde", "abcdx", "abcd", "abde", "aabb", "abb", "aab", "é", ""]
    owner, kind, k1, k2 = variants._keys_of([w for w in words if w])
    seen = defaultdict(set)
    for o, k, *key in zip(owner, kind, k1, k2, strict=True):
        seen[tuple(key)].add((int(o), int(k)))
    spelt = defaultdict(set)
    for o, w in enumerate(w for w in words if w):
        spelt[w].add((o, 0))
        for i in range(len(w)):
            spelt[w[:i] + "*" + w[i + 1 :]].add((o, 2))
            spelt[w[:i] + w[i + 1 :]].add((o, 1))
    assert sorted(map(sorted, seen.values())) == sorted(map(sorted, spelt.values()))


# --- op12


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    out = []
    for node, cs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        leaf = lambda x: not any(y[:-1] == x for y in members if y)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else "", len(cs), sum(1 for x in members if x and x[:-1] == node), sum(leaf(x) for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(tuple(map(str, r)) for r in out)


TRIE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, node string, c long")
    return plain(conversation_trie.prefix_trie(df), *TRIE_COLUMNS)


def test_trie_on_edges(spark):
    same = [(c, t, "user", f"turn {t} of all") for c in (100, 101, 102, 107, 119) for t in range(9)]
    odd = [(120, None, None, None), (120, 0, "user", ""), (121, 3, "a", "x y\x0bz"), (121, 3, "a", "x y\x0bz"), (121, None, "b", None), (141, 0, "user", "alone"), (None, 0, "user", "no conversation"), (7, 0, "user", "no base"), (13, 0, "user", "no base")]
    clash = [(200, 0, "us", "er:x"), (220, 0, "user", ":x"), (240, 0, "", "user:x")]
    long = [(300, t, "user", f"w{t % 2}") for t in range(70)] + [(301, t, "user", f"w{t % 2}") for t in range(67)]
    rows = same + odd + clash + long
    assert trie(spark, rows) == brute_trie(rows)
    assert trie(spark, []) == []


def test_trie_of_whole_tables(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    got = plain(queries.op12_prefix_trie(spark, sf_dir), *TRIE_COLUMNS)
    assert got == brute_trie(rows)
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(TRIE_COLUMNS)} FROM ({sql.OP12_SQL})").fetchall()
    assert got == sorted(tuple("" if v is None else str(v) for v in r) for r in want)


def test_many_ends_of_one_node(spark):
    """More members that end at a node than a piece holds, negative ids among them."""
    rows = [(c * 20, 0, "user", "the same") for c in range(-3000, 3000)]
    got = trie(spark, rows)
    ids = ",".join(str(c * 20) for c in range(-3000, 3000))
    assert [g for g in got if g[1] == "1"] == [("-60000", "1", "-60000", "6000", "0", "1", str(5999 * 2), hashlib.sha256(ids.encode()).hexdigest())]


# --- op11


def test_blocks():
    blocks = lambda page: [(b.text, b.path.split("!")[1]) for b in html_blocks.blocks_of(page)]
    assert blocks(None) == blocks("") == blocks("<p> \n</p>") == []
    assert blocks("<p>a<b>c</b> d<br>e<ul><li>x<li>y &amp z</ul>t &lt;q&gt; &eacute;&#233; <a href='>'>l</a>") == [("ac d e", "p"), ("x", "li"), ("y & z", "li"), ("t <q> éé l", "")]
    assert blocks("a < b <i>c") == [("a < b c", "")]
    assert blocks("<script>var x='<p>no</p>'</script><table><td>x<td>y<tr><td>z") == [("x", "td"), ("y", "td"), ("z", "td")]
    assert blocks("<div><p>x</i></section><!-- <p>no</p> -->y<!-- open <p>no") == [("xy", "p")]
    assert blocks("<p>one<div>two</div>three<p>four<style>p{}") == [("one", "p"), ("two", "div"), ("three", ""), ("four", "p")]
    assert [b.linked for b in html_blocks.blocks_of("<p><a>link</a> text</p><p>no</p>")] == [4, 0]
    assert len(html_blocks.blocks_of("<div>" * 3000 + "x" + "<p>y" * 20_000)) == 20_001


@pytest.fixture(scope="module")
def labeller(spark, sf_dir):
    return html_extract.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def articles(page):
    """The text of the given pages' articles: their one template marks it."""
    found = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1|b><br|br)>", found[1]) if found else []
    return " ".join(" ".join(x for p in parts for x in html.unescape(re.sub(r"</?b>", "", p)).split()).split())


def test_text_of_whole_tables(spark, sf_dir, labeller):
    """Pages that were not among those trained on, too: training takes 400 of them at most."""
    pages = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/pages.parquet")
    want = {r.page_id: articles(r.html) for r in pages.collect()}
    got = html_extract.extract_text(pages, labeller).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in queries.op11_block_lstm(spark, sf_dir).collect()} == {r.page_id: articles(r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}


def test_layouts_that_were_not_trained_on(labeller):
    layouts = html_extract._Layouts(["some words of a text to make pages of, as they come"], ["other", "words"], seed=123)
    made = [p for p in (layouts.page() for _ in range(300))]
    found = html_extract.label_blocks(labeller, html_blocks.Features(), [[b for b, _ in page] for page in made])
    right = [(p > 0.5) == y for page, chances in zip(made, found, strict=True) for (_, y), p in zip(page, chances, strict=True)]
    assert np.mean(right) > 0.97
    page = "<body><div id=header><p>Site</p></div><div class=menu><a href=/>Home</a></div><div class=post><h2>Title</h2><p>The text of it, in a few words.</p><p>And more of the text.</p></div><div class=comments><div class=comment><p>A reader's view, which is long enough to be a text.</p></div></div><div id=footer>Imprint</div></body>"
    blocks = html_blocks.blocks_of(page)
    [chances] = html_extract.label_blocks(labeller, html_blocks.Features(), [blocks])
    assert [b.text for b, p in zip(blocks, chances, strict=True) if p > 0.5] == ["Title", "The text of it, in a few words.", "And more of the text."]


def test_text_on_edges(spark, labeller):
    long = "<body><article>" + "<p>word &amp; word</p>" * 30_000 + "</article></body>"
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<article><p>x"), (None, "u", "<article><p>x"), (4, "u", long), (5, "u", "<nav><a>menu</a></nav>")]
    df = spark.createDataFrame([(*r, "t", 1.5) for r in rows], "page_id long, url string, html string, text string, n_chars double")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extract_text(df, labeller).collect()}
    assert got[(1, None)] == got[(1, "u")] == got[(5, "u")] == ("", 0)
    assert got[(4, "u")][0] == " ".join(["word & word"] * 30_000)
    assert html_extract.extract_text(df, labeller).count() == 6
    none = df.limit(0)
    assert html_extract.train(none) is None and html_extract.extract_text(none, None).collect() == []


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    model = html_extract.BlockLabeller(hidden=3)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    x, y, mask = rng.normal(size=(4, 2, html_extract.INPUT)), rng.integers(0, 2, (4, 2)).astype(float), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], dtype=float)

    def loss():
        sizes = mask.sum(axis=0).astype(int)
        dims = html_blocks.PATH_DIMS
        flat = x.reshape(-1, html_extract.INPUT)
        chances = model.probabilities(lambda a, b: (np.arange(8).reshape(4, 2)[a:b], x[a:b, :, dims:]), flat[:, :dims], sizes)
        return -sum(np.log(p if t else 1 - p) for k in range(2) for p, t in zip(chances[k], y[: sizes[k], k], strict=True)) / mask.sum()

    grads = model._gradients(x, y, mask)
    for name, at in (("out", (2, 0)), ("bias", (0,)), ("xf", (5, 4)), ("xb", (600, 7)), ("hf", (1, 8)), ("hb", (2, 2)), ("bf", (9,)), ("bb", (0,))):
        model.p[name][at] += 1e-3
        high = loss()
        model.p[name][at] -= 2e-3
        low = loss()
        model.p[name][at] += 1e-3
        assert abs((high - low) / 2e-3 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at])), name
