"""Main text of web pages by a recurrent block labeller.

A page is parsed into leaf blocks (text between block-level tags) with their tag paths. Each block becomes a vector:
hashed element names, classes and ids of its path, hashed words, and a few measures (length, share of link text,
punctuation, place in the page). A bidirectional LSTM in numpy reads the sequence of all blocks and labels each one as
main text or not, so a label can depend on the whole page. It is trained here on generated pages of many layouts,
whose labels are known (`generate`): articles in several containers, among menus, headers, footers, sidebars, notices,
adverts, forms and reader comments.

Scripts, styles, comments, images, the head and what is typed or chosen in forms are dropped by the parser; an element of
these kinds without an end is like any other tag (but script and style, which hide the rest as in a browser).
Character references are decoded, white space inside a block becomes one space, blocks are joined by a line break in page
order. Whole pages are read, whatever their length, and all their words; pages are independent rows, so ties, repeated
rows and empty tables need nothing. Null html is empty. Other columns are ignored.

Training takes some seconds, so its result is kept beside this file (WEIGHTS), named by the recipe that gives it; a test
trains again and compares. Without the file, or after a change of the recipe, the network is trained where it is needed.
"""

from __future__ import annotations

import hashlib
import html as entities
import inspect
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.lean import arrow

PATH_DIM, WORD_DIM, PLAIN = 64, 24, 8
DIM = PATH_DIM + WORD_DIM + PLAIN
HIDDEN = 24
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "page_labeller.npz")

# HTML element kinds.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html label legend li main nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What stands in these is no text of the page; a form's free text and its choices are among them.
RAW = frozenset("script style noscript template iframe object textarea select datalist".split())
#: These hide the rest of the page where they are not closed; the others are then like any tag.
ENDLESS = frozenset(("script", "style"))
CLOSES_P = BLOCK - {"button", "label", "option", "select", "textarea"}

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)")
REST = re.compile(r"(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>")
# An image's markup ends with its end tag, or where a tag of the page begins.
SVG_END = re.compile(r"</svg\s*>|(?=<(?:b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|h[1-6]|hr|i|img|li|menu|ol|p|pre|s|section|article|main|small|span|strong|sub|sup|table|u|ul)[\s/>])", re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


END = {name: re.compile(f"</{name}\\s*>", re.I) for name in (*RAW, "head")}


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of link text) of each leaf block, in page order."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = total = links = 0

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((tuple(s for _, s in stack), text, linked / max(total, 1)))
            parts.clear()
            linked = total = 0

    def say(piece: str) -> None:
        nonlocal linked, total
        if piece:
            parts.append(piece)
            total += len(piece)
            linked += len(piece) if links else 0

    def leave(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        tag = TAG.match(page, lt)
        if not tag:
            if page[lt + 1 : lt + 2] in ("!", "?"):
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                say("<")
                at = lt + 1
            continue
        rest = REST.match(page, tag.end())
        close = rest.end() if rest else page.find(">", tag.end()) + 1 or end
        name, at = tag[2].lower(), close
        if tag[1]:
            if name in BLOCK:
                flush()
                leave(name)
            elif name == "a":
                links = max(links - 1, 0)
            continue
        if name == "svg":
            if not page.endswith("/>", lt, close):
                ends = SVG_END.search(page, close)
                at = ends.end() if ends else close
            continue
        if name in RAW or name == "head":
            ends = END[name].search(page, close)
            if ends or name in ENDLESS:
                at = ends.end() if ends else end
            continue
        if name in ("br", "wbr", "img"):
            say(" " if name == "br" else "")
            continue
        if name == "a":
            links += 1
        if name not in BLOCK:
            continue
        flush()
        links = 0
        if name == "hr":
            continue
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            stack.pop()
        attrs = page[tag.end() : close]
        named = " ".join(a or b or c for a, b, c in NAMES.findall(attrs)) if "=" in attrs else ""
        stack.append((name, f"{name} {named.lower()}".strip()))
    flush()
    return out


@cache
def _slot(token: str, size: int) -> tuple[int, int]:
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return h % size, 1 if h & 0x10000 else -1


class _WordCodes(dict):
    """A word's place and sign in one number; words of usual length are remembered."""

    def __missing__(self, word: str) -> int:
        at, sign = _slot.__wrapped__(word, WORD_DIM)
        code = 2 * at + (sign > 0)
        if len(word) <= 40:
            if len(self) >= 300_000:
                self.clear()
            self[word] = code
        return code


_word_codes = _WordCodes()


def word_vector(words: list[str]) -> np.ndarray:
    """Sum of the signed places of all words, scaled so that long blocks weigh no more than blocks of 24 words."""
    codes = np.bincount(np.fromiter(map(_word_codes.__getitem__, words), "i8", len(words)), minlength=2 * WORD_DIM).reshape(-1, 2)
    return (codes[:, 1] - codes[:, 0]) / (5 * max(1.0, len(words) / 24) ** 0.5)


@cache
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, "f4")
    for depth, step in enumerate(reversed(path)):
        for k, token in enumerate(re.split(r"[\s_-]+", step)):
            at, sign = _slot(("" if k == 0 else ".") + token, PATH_DIM)
            v[at] += sign * (1.0 if depth < 2 else 0.7)
    return v


def features(seq: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    if _path_vector.cache_info().currsize > 20_000:
        _path_vector.cache_clear()
    if _slot.cache_info().currsize > 200_000:
        _slot.cache_clear()
    x = np.zeros((len(seq), DIM), "f4")
    for i, (path, text, link) in enumerate(seq):
        x[i, :PATH_DIM] = _path_vector(path)
        words = text.lower().split()
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = word_vector(words)
        n = len(text)
        x[i, -PLAIN:] = (np.log1p(n) / 6, link, len(words) / 50 if len(words) < 100 else 2, sum(text.count(ch) for ch in ".,;") / (n + 10) * 10,
                         i / len(seq), (len(seq) - i) / len(seq), len(path) / 8, text[-1] in ".!?")
    return x


class BiLSTM:
    """One LSTM in each direction and a logistic unit for each block; padded batches, Adam."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.12, (DIM + HIDDEN, 4 * HIDDEN)).astype("f4")
            self.p["b" + d] = np.repeat(np.array([0, 1, 0, 0], "f4"), HIDDEN)
        self.p["o"], self.p["c"] = rng.normal(0, 0.2, 2 * HIDDEN).astype("f4"), np.zeros(1, "f4")

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: time, batch, DIM. Padding carries the state on, so reading backwards may begin with it."""
        w, b = self.p["w" + d], self.p["b" + d]
        xw = x.reshape(-1, DIM) @ w[:DIM] + b
        xw = xw.reshape(*x.shape[:2], -1)
        h = c = np.zeros((x.shape[1], HIDDEN), "f4")
        out, tape = np.zeros((*x.shape[:2], HIDDEN), "f4"), {}
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = xw[t] + h @ w[DIM:]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                tape[t] = (h, c, i, f, o, g, tc, m)
            h, c = np.where(m, o * tc, h), np.where(m, new, c)
            out[t] = h
        return out, tape

    def logits(self, x, mask):
        f, b = (self.run(x, mask, d, False)[0] for d in "fb")
        return f @ self.p["o"][:HIDDEN] + b @ self.p["o"][HIDDEN:] + self.p["c"]

    def gradients(self, x, mask, y) -> dict[str, np.ndarray]:
        (f, tf), (b, tb) = (self.run(x, mask, d, True) for d in "fb")
        z = f @ self.p["o"][:HIDDEN] + b @ self.p["o"][HIDDEN:] + self.p["c"]
        dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        g = {"o": np.concatenate(((f * dz[..., None]).sum((0, 1)), (b * dz[..., None]).sum((0, 1)))), "c": np.array([dz.sum()])}
        for d, tape, o in (("f", tf, self.p["o"][:HIDDEN]), ("b", tb, self.p["o"][HIDDEN:])):
            w = self.p["w" + d]
            gw, gb = np.zeros_like(w), np.zeros(4 * HIDDEN, "f4")
            dh = dc = np.zeros((x.shape[1], HIDDEN), "f4")
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                h, c, i, fg, og, gg, tc, m = tape[t]
                dh = dh + dz[t][:, None] * o
                own, dcn = dh * m, dc * m + dh * m * og * (1 - tc**2)
                a = np.concatenate((dcn * gg * i * (1 - i), dcn * c * fg * (1 - fg), own * tc * og * (1 - og), dcn * i * (1 - gg**2)), 1)
                gw[:DIM] += x[t].T @ a
                gw[DIM:] += h.T @ a
                gb += a.sum(0)
                dh, dc = np.where(m, a @ w[DIM:].T, dh), np.where(m, dcn * fg, dc)
            g["w" + d], g["b" + d] = gw, gb
        return g

    def fit(self, seqs, labels, epochs: int = 6, rate: float = 0.006, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        m, v, t = {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0
        for _ in range(epochs):
            # batches of like length, in random order
            order = rng.permutation(len(seqs))
            order = [i for at in range(0, len(order), 320) for i in sorted(order[at : at + 320], key=lambda i: len(seqs[i]))]
            parts = [order[at : at + 32] for at in range(0, len(order), 32)]
            for part in (parts[i] for i in rng.permutation(len(parts))):
                x, mask = pad([seqs[i] for i in part])
                y = np.zeros(mask.shape, "f4")
                for j, i in enumerate(part):
                    y[: len(labels[i]), j] = labels[i]
                t += 1
                for k, g in self.gradients(x, mask, y).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype("f4")

    def label(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text. Sequences of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(seqs)
        order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: len(seqs[i]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and n < 64 and len(seqs[order[at + n]]) * (n + 1) <= 8192:
                n += 1
            part = order[at : at + n]
            z = self.logits(*pad([seqs[i] for i in part]))
            for j, i in enumerate(part):
                out[i] = z[: len(seqs[i]), j] > 0
            at += n
        return out


def pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, seqs)), len(seqs), DIM), "f4")
    mask = np.zeros(x.shape[:2], bool)
    for j, s in enumerate(seqs):
        x[: len(s), j], mask[: len(s), j] = s, True
    return x, mask


MARK = "\ue000"


def generate(count: int, seed: int) -> list[str]:
    """Pages whose main-text blocks begin with MARK."""
    rng = np.random.default_rng(seed)
    some = lambda a, b: int(rng.integers(a, b))
    pick = lambda seq: seq[some(0, len(seq))]
    chance = lambda p: rng.random() < p
    syllables = "an er in th re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma ç é ñ ü ß 中 文 да не".split()
    word = lambda: "".join(pick(syllables) for _ in range(some(1, 5)))
    words = lambda a, b: " ".join(word() for _ in range(some(a, b)))
    def prose() -> str:
        text = " ".join(words(3, 14).capitalize() + pick([".", ".", ",", "", "!", "?"]) for _ in range(some(1, 9)))
        odd = rng.random()
        if odd < 0.12:  # junk, capitals, tables in text, and the same over and over
            mark = pick(["!!", "###", "$$$", "%%%", "***", " |"])
            text = " ".join(w + mark for w in text.split())
        if odd < 0.04:
            text = text.upper()
        if 0.02 < odd < 0.06 or odd > 0.98:
            text = " ".join([text] * some(3, 80))
        return text

    links = lambda a, b: [f'<a href="/{word()}">{words(1, 4)}</a>' for _ in range(some(a, b))]

    def paragraph() -> str:
        text = prose() if chance(0.8) else words(1, 4) + pick([".", ""])
        if chance(0.2):
            text += f' <a href="/{word()}">{words(1, 3)}</a> ' + words(2, 9)
        if chance(0.15):
            text = f"<b>{text}</b>" if chance(0.5) else f"<b>{text}"
        return MARK + text + pick(["", "", "<br>"])

    def article_part() -> str:
        return pick([lambda: f"<p>{paragraph()}</p>"] * 9 + [
            lambda: f"<p>{paragraph()}", lambda: f"<h2>{MARK}{words(1, 7)}</h2>", lambda: f"<h3>{MARK}{words(1, 7)}</h3>", lambda: f"<blockquote>{paragraph()}</blockquote>",
            lambda: "<ul>" + "".join(f"<li>{MARK}{words(2, 12)}</li>" for _ in range(some(2, 6))) + "</ul>", lambda: "<ol>" + "".join(f"<li>{MARK}{words(2, 12)}</li>" for _ in range(some(2, 6))) + "</ol>",
            lambda: "<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(some(1, 4))) + "</table>",
            lambda: f"<figure><img src=x><figcaption>{MARK}{words(3, 9)}</figcaption></figure>", lambda: f"<pre>{MARK}{words(3, 20)}</pre>", lambda: f"<div>{paragraph()}</div>"])()

    inline_junk = [
        lambda: f'<div class="{pick(["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo"])}">{prose()}</div>', lambda: f'<aside class="{word()}">{prose()}</aside>',
        lambda: f'<div class="{pick(["share", "social", "related", "newsletter", "tags"])}">{" ".join(links(2, 6))}</div>', lambda: f"<form><label>{words(1, 4)}</label><input><button>{words(1, 3)}</button></form>",
        lambda: f'<div class="{pick(["notice", "cookie", "consent", "alert", "popup", "cookie-banner"])}">{prose()}</div>', lambda: f"<script>var t='<p>{words(1, 4)}</p>';</script>",
    ]

    def menu() -> str:
        items = links(3, 10)
        body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if chance(0.7) else " ".join(items)
        return pick([f"<nav>{body}</nav>", f'<div class="{pick(["menu", "nav", "navbar", "breadcrumb", "navigation"])}">{body}</div>', f'<ul class="menu">{body}</ul>'])

    def header() -> str:
        return pick([f"<header>{words(1, 6)}{menu() if chance(0.4) else ''}</header>", f'<div class="{pick(["header", "top", "masthead", "site-header"])}">{words(1, 8)}</div>', f"<header><h1>{words(1, 4)}</h1><p>{words(2, 9)}</p></header>"])

    def side() -> str:
        body = f"<h3>{words(1, 4)}</h3>" + pick(["<ul>" + "".join(f"<li>{x}</li>" for x in links(2, 8)) + "</ul>", f"<p>{prose()}</p>"])
        return pick([f"<aside>{body}</aside>", f'<div class="{pick(["sidebar", "related", "widget", "side", "recommended"])}">{body}</div>', f'<section class="related">{body}</section>'])

    def comments() -> str:
        one = lambda: pick([f"<p>{prose()}</p>", f'<div class="comment"><b>{words(1, 3)}</b><p>{prose()}</p></div>', f"<li>{prose()}</li>"])
        body = (f"<h3>{words(1, 3)}</h3>" if chance(0.5) else "") + "".join(one() for _ in range(some(1, 6)))
        return pick([f'<section class="comments">{body}</section>', f'<div id="comments">{body}</div>', f'<ol class="comment-list">{body}</ol>', f'<div class="{pick(["comments", "replies", "responses", "discussion"])}">{body}</div>'])

    def footer() -> str:
        return pick([f"<footer>&copy; {words(1, 3)} &middot; {prose()}</footer>", f'<div class="footer">{prose()}</div>', f"<footer><p>{prose()}</p>{' '.join(links(1, 5))}</footer>", f'<div id="footer">&copy; {words(1, 9)}</div>'])

    def notice() -> str:
        return f'<div class="{pick(["cookie", "notice", "consent", "alert", "cookie-notice", "banner", "subscribe", "overlay"])}"><p>{prose()}</p>{"<button>" + words(1, 3) + "</button>" if chance(0.5) else ""}</div>'

    def form() -> str:
        return f"<form action=/s><label>{words(1, 4)}</label><input name=q><select><option>{words(1, 2)}<option>{words(1, 2)}</select><textarea>{words(1, 9)}</textarea><button>{words(1, 2)}</button><p>{words(1, 9)}</p></form>"

    def article() -> str:
        parts = [article_part() for _ in range(some(1, 14) if chance(0.9) else some(14, 60))]
        for _ in range(some(0, 3)):
            parts.insert(some(0, len(parts) + 1), pick(inline_junk)())
        if chance(0.8):
            parts.insert(0, f"<h1>{MARK}{words(1, 12)}</h1>")
        if chance(0.1):
            parts.append(comments())
        body = "".join(parts)
        return pick([f"<article>{body}</article>"] * 5 + [f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<div class="{pick(["content", "post", "entry-content", "article-body", "post-body", "story", "main"])}">{body}</div>', f'<div id="{pick(["content", "main", "article"])}">{body}</div>', f'<article class="post"><div class="body">{body}</div></article>'])

    pages = []
    for _ in range(count):
        before = [f() for f in (notice, header, menu, menu, side, form) if chance(0.4)] + [pick(inline_junk)() for _ in range(some(0, 2))]
        after = [f() for f in (side, comments, form, notice, menu, menu) if chance(0.3)] + [footer() for _ in range(1) if chance(0.85)]
        wrap = pick(["{}", "{}", '<div class="page">{}</div>', '<div id="wrap"><div class="inner">{}</div></div>'])
        pages.append("<html><head><title>t</title></head><body>" + wrap.replace("{}", "".join(before) + article() + "".join(after)) + "</body></html>")
    return pages


def labelled(count: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    seqs, labels = [], []
    for page in generate(count, seed):
        seq = blocks(page)
        labels.append(np.array([t.startswith(MARK) for _, t, _ in seq], "f4"))
        seqs.append(features([(p, t.replace(MARK, "").strip() or "-", k) for p, t, k in seq]))
    return seqs, labels


def recipe() -> str:
    """A name for what training depends on: the code that makes pages, features and weights."""
    code = "".join(inspect.getsource(f) for f in (blocks, _slot, _path_vector, word_vector, features, BiLSTM, pad, generate, labelled, train))
    return hashlib.sha256(code.encode()).hexdigest()


def train() -> BiLSTM:
    net = BiLSTM()
    net.fit(*labelled(2600, 21))
    return net


@cache
def trained() -> BiLSTM:
    """The network: its kept weights if they are of this recipe, else trained now."""
    if os.path.exists(WEIGHTS):
        with np.load(WEIGHTS) as kept:
            if str(kept["recipe"]) == recipe():
                net = BiLSTM()
                net.p = {k: kept[k] for k in net.p}
                return net
    return train()


def keep_weights() -> None:
    """Train and write WEIGHTS; to be called after a change of the recipe."""
    np.savez_compressed(WEIGHTS, recipe=recipe(), **train().p)


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    net = trained()
    key = df.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                seqs = [blocks(h) if h else [] for h in part.column("html").to_pylist()]
                labels = net.label([features(s) for s in seqs])
                texts = ["\n".join(t for (_, t, _), keep in zip(s, k) if keep) for s, k in zip(seqs, labels)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), "i8")], ["page_id", "url", "text", "n_chars"]
                )

    return df.select("page_id", "url", "html").transform(arrow, run, f"page_id {key}, url string, text string, n_chars bigint")
