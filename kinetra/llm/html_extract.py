"""Main text of web pages by a recurrent block labeller: a numpy bidirectional LSTM over the leaf blocks of a page.

Each block is a vector of its hashed tag path, its hashed words and its shape (`html_blocks`); one LSTM reads the blocks from
the first to the last, another from the last to the first, and a logistic unit over both states says whether the block belongs
to the article. So a verdict rests on all blocks of the page. Blocks with a probability over one half are joined.

Training uses two sources, both bounded. (1) Up to `max_train_pages` pages of the table, of at most `max_train_chars` characters, that
mark their article by themselves (`article`, `main`, role or itemprop); the marked blocks, less those in parts named as
boilerplate, are the positive ones. (2) `made_pages` layouts made by a rule from the blocks of those pages (or invented words): articles,
menus, side columns, notices, adverts, forms and reader comments under many element and class names, so that the model
does not hang on one template. The fit is one small job on the driver; its parameters (about 0.5 MB whatever the input) are broadcast.
Every page is read whole, in batches of similar length with bounded memory; states are kept for each block, some 200 bytes.

Defined results: null or empty html gives an empty text, as does a page without an article; rows that repeat are pages of their own; a null
id or url is passed on; an empty table trains nothing; other columns are not read. Ties (a probability of exactly one half) are left out.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.html_blocks import PATH_DIMS, SHAPE_DIMS, WORD_DIMS, Block, Features, blocks_of

INPUT = PATH_DIMS + WORD_DIMS + SHAPE_DIMS
#: Dense rows that are built at once.
SLICE = 8192

# Words of element, class, id and role names that page authors give to parts of a page.
ARTICLE_NAMES = ["article", "post", "entry", "story", "content", "body", "main", "text", "articleBody", "post-content", "entry-content", "article-body", "story-text", "page-content", "blog-post", "single"]
PART_NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "topnav", "main-menu", "breadcrumb", "breadcrumbs", "tabs", "links", "toc", "pagination", "skip"],
    "header": ["header", "masthead", "site-header", "top", "topbar", "banner", "brand", "logo", "tagline", "page-header"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "credits", "colophon", "foot"],
    "side": ["sidebar", "aside", "widget", "related", "recent-posts", "side", "rail", "secondary", "popular", "recommended", "tag-cloud", "archive", "more-stories", "see-also"],
    "notice": ["cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "privacy-banner", "message", "warning", "disclaimer", "announcement"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-slot", "adsbox", "banner-ad", "outbrain", "affiliate"],
    "form": ["form", "search", "newsletter", "subscribe", "signup", "login", "contact-form", "feedback", "poll", "survey"],
    "comment": ["comment", "comments", "comment-list", "discussion", "replies", "reply", "responses", "disqus", "comment-body", "respond", "user-comment", "reviews", "thread"],
    "share": ["share", "social", "share-buttons", "follow", "meta", "byline", "tags", "toolbar", "actions", "author-box"],
}
TAGS = {"menu": ["nav", "ul", "div", "ol"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section", "td"], "notice": ["div", "aside", "section", "dialog", "p"], "advert": ["div", "aside", "ins", "section"], "form": ["form", "div", "fieldset"], "comment": ["section", "div", "ol", "article", "ul"], "share": ["div", "ul", "p"]}


def marked(block: Block) -> bool:
    """The label of a block of a page that marks its article: inside the mark, and in no part that is named as something else."""
    names = block.path.lower().split(" ")
    other = {"nav", "header", "footer", "aside", "form", "dialog"} | {f"{key}.{n}" for key in "ci" for n in ("comment", "comments", "ad", "ads", "advert", "sidebar", "nav", "menu", "footer", "cookie", "share", "related", "newsletter")}
    starts = [k for k, n in enumerate(names) if n in ("article", "main", "r.main")]
    inside = bool(starts) or ("i.article" in names and "i.body" in names)
    after = names[starts[0] + 1 :] if starts else names
    return inside and not other & set(after)


class _Layouts:
    """Pages made by a rule from a pool of article texts and a pool of other texts."""

    def __init__(self, texts: list[str], others: list[str], seed: int = 7):
        self.rng = random.Random(seed)
        invented = ["".join(self.rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "ste", "tion", "ver", "un"]) for _ in range(self.rng.randint(1, 4))) for _ in range(400)]
        self.words = [w for t in texts for w in t.split()][:200_000] or invented
        self.others = [t for t in others if t] or [" ".join(self.rng.choices(invented, k=3)) for _ in range(200)]

    def sentence(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join(r.choices(self.words, k=r.randint(low, high))).capitalize() + r.choice([".", ".", ".", "!", "?", "", ","])

    def prose(self) -> str:
        return " ".join(self.sentence(3, 18) for _ in range(self.rng.choice([1, 1, 2, 3, 5, 8])))

    def named(self, tag: str, names: list[str], chance: float = 1.0) -> str:
        """A path step: the element and, mostly, its class, id or role."""
        if self.rng.random() > chance:
            return tag
        key = self.rng.choice(["c", "c", "c", "i"])
        picked = self.rng.sample(names, k=min(len(names), self.rng.choice([1, 1, 2])))
        return " ".join([tag, *(f"{key}.{p}" for name in picked for p in name.lower().split("-"))])

    def part(self, kind: str, outer: list[str]) -> list[tuple[Block, bool]]:
        r = self.rng
        tag = r.choice(TAGS[kind])
        telling = tag in ("nav", "header", "footer", "aside", "form", "dialog")
        steps = [*outer, self.named(tag, PART_NAMES[kind], 0.6 if telling else 1.0)]
        if r.random() < 0.3:
            steps.append(r.choice(["div", "div c.inner", "div c.container", "section", "div c.wrap"]))
        out = []
        for _ in range(r.randint(1, {"menu": 9, "comment": 8, "side": 7, "footer": 4, "share": 4}.get(kind, 3))):
            long = {"comment": 0.9, "notice": 0.6, "advert": 0.6, "footer": 0.4, "side": 0.4, "header": 0.2}.get(kind, 0.1)
            text = self.prose() if r.random() < long else r.choice(self.others) if r.random() < 0.5 else self.sentence(1, 5)
            inner, linked = [], 0
            if kind in ("menu", "side", "share") and r.random() < 0.7 or r.random() < 0.15:
                inner, linked = (["li", "a"] if r.random() < 0.7 else ["a"]), len(text)
                leaf = "li" if "li" in inner else tag
            else:
                leaf = r.choice(["p", "p", "li", "div", "span", tag, "h3", *{"form": ["label"], "comment": ["blockquote"], "header": ["h1", "h1", "h2", "h1"], "side": ["h2"]}.get(kind, [])])
                inner = [] if leaf == tag else [leaf]
                leaf = tag if leaf == "span" else leaf
                if kind == "comment" and r.random() < 0.5:
                    inner = [self.named(r.choice(["li", "div", "article"]), PART_NAMES[kind]), *inner]
            out.append((Block(text, " ".join([*steps, *inner, "!" + leaf]), linked), False))
        return out

    def page(self) -> list[tuple[Block, bool]]:
        r = self.rng
        outer = ["html", "body", *r.choice([[], [], ["div"], ["div c.container"], ["div i.page", "div c.row"], ["div i.wrapper"], ["table", "tr"]])]
        tag = r.choice(["article", "main", "article", "div", "div", "section", "td" if "tr" in outer else "div"])
        steps = [*outer, *([] if r.random() < 0.7 else [r.choice(["main", "div c.content", "div i.main", "section"])]), self.named(tag, ARTICLE_NAMES, 0.5 if tag in ("article", "main") else 0.85)]
        if r.random() < 0.3:
            steps.append(self.named(r.choice(["div", "section"]), ARTICLE_NAMES, 0.7))
        body = []
        for k in range(r.choice([1, 2, 4, 8, 12, 20])):
            kind = r.random()
            leaf = "h1" if k == 0 and r.random() < 0.8 else "p" if kind < 0.75 else r.choice(["li", "blockquote", "h2", "h3", "pre", "td", "figcaption", "div", "dd"])
            inner = {"li": ["ul", "li"], "td": ["table", "tr", "td"], "figcaption": ["figure", "figcaption"], "dd": ["dl", "dd"]}.get(leaf, [leaf])
            if r.random() < 0.15:
                inner = [*inner, r.choice(["b", "strong", "em", "a", "i"])]
            text = self.prose() if leaf in ("p", "blockquote", "pre", "div", "dd") else self.sentence(1, 14)
            body.append((Block(text, " ".join([*steps, *inner, "!" + leaf]), len(text) if inner[-1] == "a" else 0), True))
        for kind in ("advert", "share", "side", "form", "notice"):
            if r.random() < 0.2:  # parts inside the article's element
                at = r.randint(0, len(body))
                body[at:at] = self.part(kind, steps)
        if r.random() < 0.2:
            body += self.part("comment", steps)
        before = [b for kind in r.sample(["menu", "header", "notice", "advert", "side", "form"], k=r.randint(0, 4)) for b in self.part(kind, outer)]
        after = [b for kind in r.sample(["footer", "side", "comment", "advert", "share", "form", "menu", "notice"], k=r.randint(0, 5)) for b in self.part(kind, outer)]
        return before + body + after


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BlockLabeller:
    """A bidirectional LSTM with `hidden` cells each way and a logistic unit, trained by Adam on whole pages."""

    def __init__(self, hidden: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, 0.08, (INPUT, 4 * hidden)).astype(np.float32)
            self.p[f"h{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32) * 0.5
            self.p[f"b{way}"] = np.repeat(np.array([0, 1, 0, 0], dtype=np.float32), hidden)  # input, forget, output gates, candidate
        self.p["out"] = rng.normal(0, 0.2, (2 * hidden, 1)).astype(np.float32)
        self.p["bias"] = np.zeros(1, dtype=np.float32)

    def _steps(self, z: np.ndarray, way: str, h: np.ndarray, c: np.ndarray, mask: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States (T, B, hidden) for inputs z (T, B, 4 hidden), which are in reading order, and the last state. Where mask is 0 a state stays as it was."""
        n, weights = self.hidden, self.p[f"h{way}"]
        out = np.empty((*z.shape[:2], n), dtype=np.float32)
        for t in range(len(z)):
            a = z[t] + h @ weights
            gates, new = _sigmoid(a[:, : 3 * n]), np.tanh(a[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            m = mask[t][:, None]
            c2 = f * c + i * new
            th = np.tanh(c2)
            if keep is not None:
                keep.append((h, c, i, f, o, new, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
        return out, h, c

    def probabilities(self, dense, paths: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The probability of each block of each page. dense(t0, t1) gives of those places the path numbers (t1 - t0, B), rows of paths, and the other inputs (t1 - t0, B, INPUT - PATH_DIMS); sizes are the pages' numbers of blocks."""
        pages, longest = len(sizes), int(sizes.max())
        mask = (np.arange(longest)[:, None] < sizes).astype(np.float32)
        step = max(1, SLICE // pages)
        logits = np.full((longest, pages), self.p["bias"][0], dtype=np.float32)
        for k, way in enumerate("fb"):
            h = c = np.zeros((pages, self.hidden), dtype=np.float32)
            unit = self.p["out"][k * self.hidden : (k + 1) * self.hidden, 0]
            of_path, rest = paths @ self.p[f"x{way}"][:PATH_DIMS] + self.p[f"b{way}"], self.p[f"x{way}"][PATH_DIMS:]
            cuts = range(0, longest, step)
            for t0 in cuts if way == "f" else reversed(cuts):
                t1 = min(longest, t0 + step)
                numbers, others = dense(t0, t1)
                z = of_path[numbers] + (others.reshape(-1, others.shape[2]) @ rest).reshape(t1 - t0, pages, -1)
                if way == "f":
                    states, h, c = self._steps(z, way, h, c, mask[t0:t1])
                else:
                    states, h, c = self._steps(z[::-1], way, h, c, mask[t0:t1][::-1])
                    states = states[::-1]
                logits[t0:t1] += states @ unit
        chances = _sigmoid(logits)
        return [chances[: sizes[k], k] for k in range(pages)]

    def _gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        steps, pages, _ = x.shape
        n, grads, kept, states = self.hidden, {}, {}, {}
        zero = np.zeros((pages, n), dtype=np.float32)
        for way in "fb":
            z = (x.reshape(-1, INPUT) @ self.p[f"x{way}"] + self.p[f"b{way}"]).reshape(steps, pages, -1)
            kept[way] = []
            turned = (z, mask) if way == "f" else (z[::-1], mask[::-1])
            out, _, _ = self._steps(turned[0], way, zero, zero, turned[1], kept[way])
            states[way] = out if way == "f" else out[::-1]
        both = np.concatenate([states["f"], states["b"]], axis=2)
        chance = _sigmoid(both @ self.p["out"][:, 0] + self.p["bias"][0])
        d = (chance - y) * mask / mask.sum()
        grads["out"] = np.einsum("tbh,tb->h", both, d)[:, None]
        grads["bias"] = np.array([d.sum()], dtype=np.float32)
        for k, way in enumerate("fb"):
            unit = self.p["out"][k * n : (k + 1) * n, 0]
            down = d[:, :, None] * unit
            down = down if way == "f" else down[::-1]
            dh, dc = zero, zero
            da = np.empty((steps, pages, 4 * n), dtype=np.float32)
            hs = np.empty((steps, pages, n), dtype=np.float32)
            for t in range(steps - 1, -1, -1):
                h0, c0, i, f, o, new, th, m = kept[way][t]
                total = dh + down[t]
                inner = m * total
                dc2 = m * dc + inner * o * (1 - th * th)
                da[t] = np.concatenate([dc2 * new * i * (1 - i), dc2 * c0 * f * (1 - f), inner * th * o * (1 - o), dc2 * i * (1 - new * new)], axis=1)
                hs[t] = h0
                dh = da[t] @ self.p[f"h{way}"].T + (1 - m) * total
                dc = dc2 * f + (1 - m) * dc
            grads[f"h{way}"] = np.einsum("tbh,tbg->hg", hs, da)
            grads[f"b{way}"] = da.sum(axis=(0, 1))
            turned = da if way == "f" else da[::-1]
            grads[f"x{way}"] = x.reshape(-1, INPUT).T @ turned.reshape(-1, 4 * n)
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int = 32, rate: float = 0.01, drop: float = 0.1, seed: int = 5) -> None:
        """pages: (inputs, labels) of each. Inputs are dropped at random, so that no single name decides."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        count = 0
        for epoch in range(epochs):
            order = sorted(range(len(pages)), key=lambda k: (len(pages[k][1]) // 8, rng.random()))
            batches = [order[k : k + batch] for k in range(0, len(order), batch)]
            rng.shuffle(batches)
            for chosen in batches:
                steps = max(len(pages[k][1]) for k in chosen)
                x = np.zeros((steps, len(chosen), INPUT), dtype=np.float32)
                y, mask = np.zeros(x.shape[:2], dtype=np.float32), np.zeros(x.shape[:2], dtype=np.float32)
                for j, k in enumerate(chosen):
                    m = len(pages[k][1])
                    x[:m, j], y[:m, j], mask[:m, j] = pages[k][0], pages[k][1], 1
                x *= rng.random(x.shape, dtype=np.float32) >= drop
                count += 1
                now = rate * (0.3 if epoch >= epochs * 2 // 3 else 1)
                for name, g in self._gradients(x, y, mask).items():
                    g = np.clip(g, -1, 1)
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    self.p[name] -= (now * (first[name] / (1 - 0.9**count)) / (np.sqrt(second[name] / (1 - 0.99**count)) + 1e-7)).astype(np.float32)


def _word_rows(ids: list[list[int]]) -> np.ndarray:
    """Hashed words of each block as rows of length one."""
    sizes = np.array([len(w) for w in ids], dtype=np.int64)
    flat = np.array(list(chain.from_iterable(ids)), dtype=np.int64)
    rows = np.bincount(np.repeat(np.arange(len(ids)) * WORD_DIMS, sizes) + flat, minlength=len(ids) * WORD_DIMS).reshape(len(ids), WORD_DIMS).astype(np.float32)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1)


def label_blocks(model: BlockLabeller, features: Features, pages: list[list[Block]]) -> list[np.ndarray]:
    """The probability of each block of each page; pages of similar length share a batch."""
    found: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and stop - start < 256 and len(pages[order[stop]]) * (stop + 1 - start) <= 4 * SLICE:
            stop += 1
        chosen = order[start:stop]
        made = [features.page(pages[k]) for k in chosen]
        sizes = np.array([len(pages[k]) for k in chosen])
        paths = np.stack(features.rows)

        def dense(t0: int, t1: int, made=made) -> tuple[np.ndarray, np.ndarray]:
            counts = [max(0, min(t1, len(path)) - t0) for path, _, _ in made]
            rows = np.concatenate([_word_rows([w for _, words, _ in made for w in words[t0:t1]]), np.concatenate([shape[t0:t1] for _, _, shape in made])], axis=1)
            page, place = np.repeat(np.arange(len(made)), counts), np.concatenate([np.arange(c) for c in counts])
            numbers, others = np.zeros((t1 - t0, len(made)), dtype=np.int64), np.zeros((t1 - t0, len(made), rows.shape[1]), dtype=np.float32)
            numbers[place, page], others[place, page] = np.concatenate([path[t0:t1] for path, _, _ in made]), rows
            return numbers, others

        for k, chances in zip(chosen, model.probabilities(dense, paths, sizes), strict=True):
            found[k] = chances
        features.forget()
        start = stop
    return found


def train(pages: DataFrame, html_col: str = "html", max_train_pages: int = 400, max_train_chars: int = 100_000, made_pages: int = 900, epochs: int = 9) -> BlockLabeller | None:
    """A labeller from pages that mark their article and from made layouts; None if the table has no row to judge."""
    if not pages.limit(1).count():
        return None
    usable = pages.select(F.col(html_col).cast("string").alias("t")).where((F.length("t") <= max_train_chars) & F.col("t").rlike(r"(?i)<(article|main)\b|role=.?main|articlebody")).withColumn("h", F.xxhash64("t"))
    chosen = [r.h for r in usable.select("h").distinct().orderBy("h").limit(max_train_pages).collect()]  # hashes only: no task sends pages that are not used
    sample = usable.where(F.col("h") <= max(chosen, default=0)).groupBy("h").agg(F.min("t").alias("t")).orderBy("h")
    labelled = [[(b, marked(b)) for b in blocks_of(r.t)] for r in sample.collect()]  # at most max_train_pages * max_train_chars characters
    layouts = _Layouts([b.text for blocks in labelled for b, y in blocks if y], [b.text for blocks in labelled for b, y in blocks if not y])
    features, ready = Features(), []
    for blocks in [*labelled, *(layouts.page() for _ in range(made_pages))]:
        for k in range(0, len(blocks), 200):  # long pages train in stretches
            part = blocks[k : k + 200]
            path, words, shape = features.page([b for b, _ in part])
            x = np.concatenate([np.stack([features.rows[n] for n in path]), _word_rows(words), shape], axis=1)
            ready.append((x, np.array([y for _, y in part], dtype=np.float32)))
    model = BlockLabeller()
    model.fit(ready, epochs)
    return model


def extract_text(pages: DataFrame, model: BlockLabeller | None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep with text, the article's blocks in page order joined by one space, and n_chars, its code points."""
    src = pages.select(*keep, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    kinds = ", ".join(f"`{n}` {src.schema[n].dataType.simpleString()}" for n in keep)
    sent = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, features = sent.value, Features()
        for batch in batches:
            start, held, size = 0, [], 0
            for k in range(batch.num_rows):
                raw = batch.column(len(keep))[k].as_py()
                held.append(blocks_of(raw))
                size += len(raw)
                if size > 4_000_000 or k == batch.num_rows - 1:
                    texts = [" ".join(b.text for b, p in zip(blocks, chances, strict=True) if p > 0.5) for blocks, chances in zip(held, label_blocks(labeller, features, held), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(start, k + 1 - start) for j in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])
                    start, held, size = k + 1, [], 0

    return src.mapInArrow(run, f"{kinds}, text string, n_chars long")
