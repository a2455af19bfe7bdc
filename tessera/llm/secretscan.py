"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Base findings are pattern matches. Candidates of the network are all runs of key characters outside them, 16 or more with
a letter: a run that a base finding touches is cut around it, and where a longer run of letters and digits holds a hex or
access match, that run is a candidate as a whole. The network reads each candidate with its context in windows that
overlap at the end, so every character of a candidate is in the middle of one. It is trained here, in numpy, on labelled
findings that `labelled` generates: keys of many shapes in settings that assign or carry them, against addresses, hosts,
paths, versions, numbers, identifiers of programs, rules and long words in prose. Scores are calibrated (Platt) on a
held-out third, and the threshold is the highest that keeps `RECALL` of its secrets, and a margin of two standard errors.

Texts are scanned whole, as UTF-8 bytes; offsets are then turned into code points. Defined cases: null text is empty
and has no findings; rows are independent, so ties, repeated rows and empty tables need nothing; other columns are
ignored (by `scan`) or kept (by `redact`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lean import arrow

ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "cnn")
#: Each pattern of ASSIGN holds one of these in lower case.
MARKS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

LEFT, MIDDLE, RIGHT = 20, 32, 8
WIDTH = LEFT + MIDDLE + RIGHT
EMBED, FILTERS, KERNEL = 10, 32, 5
RECALL = 0.98
LEAST = 16
#: Windows that are scored at once.
VIEWS = 16_384
#: Words that names in programs are made of.
PARTS = (
    "get set user account by from data base name file path list map key value index count size type id parse read write open close load save find create delete update "
    "insert select order item node tree hash code string number array buffer stream client server request response session config option default error message event handler "
    "manager service factory builder helper view model controller page image font color width height left right top bottom start end next last first max min http url json xml "
    "sha rsa utf base with to is has on test main core util common internal module package version abstract single proxy bean thread lock queue task event loop state sync async "
    "date time zone format print log debug trace check valid parse token type class object method field value enum static final public private shared local remote cache memory disk"
).split()

_key = np.zeros(256, bool)
_key[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.~-")] = True
_digit, _letter = np.zeros(256, bool), np.zeros(256, bool)
_digit[list(b"0123456789")] = True
_letter[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


def runs(raw: bytes) -> list[tuple[int, int]]:
    """Maximal runs of at least LEAST key characters."""
    mask = np.zeros(len(raw) + 2, "i1")
    mask[1:-1] = _key[np.frombuffer(raw, "u1")]
    edges = np.flatnonzero(np.diff(mask))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= LEAST
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def base_spans(raw: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns, in bytes. `found` are the runs; access and hex matches lie inside one."""
    out = []
    low = raw.lower()
    if any(m in low for m in MARKS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if len(m[2]) >= 6]
    for a, b in found:
        out += [(a + m.start(), a + m.end(), 1) for m in ACCESS.finditer(raw[a:b]) if m.end() - m.start() >= 20]
        out += [(a + m.start(), a + m.end(), 2) for m in HEX.finditer(raw[a:b]) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(raw: bytes, found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the network reads: runs cut around base findings, and runs of letters and digits that hold one and more."""
    out, chars = [], np.frombuffer(raw, "u1")
    for a, b in found:
        at, own = a, [s for s in base if s[0] < b and a < s[1]]
        for s, e, kind in own:
            if s - at >= LEAST:
                out.append((at, s))
            at = max(at, e)
            if kind and _letter[chars[s:e]].any():
                left, right = s, e
                while left > a and (_letter | _digit)[chars[left - 1]]:
                    left -= 1
                while right < b and (_letter | _digit)[chars[right]]:
                    right += 1
                if right - left > e - s:
                    out.append((left, right))
        if b - at >= LEAST:
            out.append((at, b))
    return sorted({(a, b) for a, b in out if _letter[chars[a:b]].any()})


def windows(raw: bytes, a: int, b: int) -> Iterator[tuple[np.ndarray, int]]:
    """Fixed-width views of a candidate with its context: character codes, and how many are candidate characters."""
    for at in [*range(a, b - MIDDLE, MIDDLE), max(a, b - MIDDLE)]:
        end = min(at + MIDDLE, b)
        left = raw[max(0, at - LEFT) : at].rjust(LEFT, b"\0")
        view = left + raw[at:end] + raw[end : end + RIGHT + MIDDLE - (end - at)]
        yield np.frombuffer(view.ljust(WIDTH, b"\0")[:WIDTH], "u1"), end - at


class CharCNN:
    """Embedding (with an inside-candidate flag), one convolution, max pooling, one logistic unit; Adam in numpy."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (256, EMBED)), "conv": rng.normal(0, 0.15, (KERNEL * (EMBED + 1), FILTERS)), "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.2, FILTERS), "off": np.zeros(1),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray, n: np.ndarray):
        inside = (np.arange(WIDTH) >= LEFT) & (np.arange(WIDTH) < LEFT + n[:, None])
        e = np.concatenate((self.p["embed"][x], inside[..., None]), 2)
        cols = np.lib.stride_tricks.sliding_window_view(e, KERNEL, 1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - KERNEL + 1, -1)
        h = cols @ self.p["conv"] + self.p["bias"]
        best = h.argmax(1)
        top = np.maximum(np.take_along_axis(h, best[:, None], 1)[:, 0], 0)
        return top @ self.p["out"] + self.p["off"][0], (cols, best, top)

    def logits(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512], n[i : i + 512])[0] for i in range(0, len(x), 512)] or [np.zeros(0)])

    def fit(self, x, n, y, epochs: int = 12, rate: float = 0.012, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        m, v, t = {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                i = order[at : at + 128]
                z, (cols, best, top) = self.forward(x[i], n[i])
                d = (1 / (1 + np.exp(-z)) - y[i]) / len(i)
                g = {"out": top.T @ d, "off": np.array([d.sum()])}
                dh = d[:, None] * self.p["out"] * (top > 0)
                picked = np.take_along_axis(cols, best[:, :, None], 1)
                g["conv"], g["bias"] = np.einsum("bfk,bf->kf", picked, dh), dh.sum(0)
                back = (dh[:, :, None] * self.p["conv"].T).reshape(len(i), FILTERS, KERNEL, EMBED + 1)[..., :EMBED]
                g["embed"] = np.zeros_like(self.p["embed"])
                at_chars = np.take_along_axis(x[i][:, None, :], best[:, :, None] + np.arange(KERNEL), 2)
                np.add.at(g["embed"], at_chars.ravel(), back.reshape(-1, EMBED))
                t += 1
                for k in self.p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x, n, y) -> None:
        """Platt scaling, then the highest threshold that keeps RECALL of the secrets and two standard errors more."""
        z = self.logits(x, n)
        a, b = 1.0, 0.0
        for _ in range(500):
            d = 1 / (1 + np.exp(-(a * z + b))) - y
            a, b = a - 0.02 * (d * z).mean(), b - 0.02 * d.mean()
        self.slope, self.shift = a, b
        secret = np.sort(self.probability(x, n)[y == 1])
        lose = 1 - RECALL - 2 * np.sqrt(RECALL * (1 - RECALL) / len(secret))
        self.threshold = float(secret[int(max(lose, 0) * len(secret))])

    def probability(self, x, n) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(x, n) + self.shift)))


def labelled(count: int = 24_000, seed: int = 11) -> list[tuple[bytes, int, int, int]]:
    """Generated findings: (text, start, end, label)."""
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, n: "".join(chars[j] for j in rng.integers(0, len(chars), n))
    some = lambda a, b: int(rng.integers(a, b))
    syllables = "sch cht tz pf keit heit schaft ung lich rst zu mpf ght str tion ness ment kh vsk szcz rz ij oe aa kk ckl an er in th re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ión ç é ñ ü".split()
    word = lambda: "".join(pick(syllables) for _ in range(some(1, 5)))
    prose = lambda: " ".join(word() for _ in range(some(3, 9)))
    ascii_word = lambda: word().encode("ascii", "ignore").decode() or "an"
    parts = lambda a, b: [pick(PARTS) if rng.random() < 0.7 else ascii_word() for _ in range(some(a, b))]

    def identifier() -> str:
        """A name in a program, digits in any of its places or none."""
        own = [p + (str(some(1, 300)) if rng.random() < 0.2 else "") for p in parts(3, 8)]
        return pick(
            [
                lambda: own[0] + "".join(p.capitalize() for p in own[1:]), lambda: "".join(p.capitalize() for p in own), lambda: "_".join(own), lambda: "-".join(own), lambda: ".".join(own),
                lambda: "_".join(own).upper(), lambda: "/".join(own), lambda: "".join(own), lambda: "".join(p.upper() if len(p) < 5 else p.capitalize() for p in own),
            ]
        )()

    def secret() -> str:
        body = lower + upper + digits
        return pick(
            [
                lambda: "ghp_" + draw(body, 36), lambda: "sk-" + draw(body, some(32, 49)), lambda: "xoxb-" + draw(digits, 12) + "-" + draw(body, 24),
                lambda: "eyJ" + draw(body, some(20, 40)) + "." + draw(body + "_-", some(30, 60)) + "." + draw(body + "_-", 43), lambda: draw(body + "+/", 40),
                lambda: draw(body + "+/", some(24, 64)) + "==", lambda: draw(body, some(20, 48)), lambda: draw("0123456789ABCDEF", pick([32, 40, 64])),
                lambda: "AIza" + draw(body + "_-", 35), lambda: "pk_live_" + draw(body, 24), lambda: "glpat-" + draw(body + "_-", 20), lambda: "SG." + draw(body, 22) + "." + draw(body, 43),
                lambda: draw(upper + digits, some(24, 40)), lambda: draw(lower + digits, some(20, 40)), lambda: draw(lower + upper, some(24, 48)),
                lambda: draw(body, some(3, 12)) + draw("0123456789abcdef", some(24, 41)) + draw(body, some(2, 9)), lambda: "npm_" + draw(body, 36), lambda: draw(body + "-_", 43),
            ]
        )()

    def harmless() -> str:
        return pick(
            [
                lambda: f"{ascii_word()}.{ascii_word()}{some(1, 99)}.example.{pick(['com', 'org', 'net'])}", lambda: f"mail{some(1, 999)}.{ascii_word()}.example.com",
                lambda: f"{ascii_word()}/{ascii_word()}/{ascii_word()}-{some(1, 9999)}.html", lambda: f"www.{ascii_word()}{ascii_word()}.com/{ascii_word()}/{some(1, 999)}",
                lambda: "_".join(ascii_word() for _ in range(4)) + f"_{some(1, 99)}", lambda: f"{some(1990, 2030)}-{some(1, 13):02}-{some(1, 29):02}T{some(0, 24):02}-00-00Z",
                lambda: "-".join(ascii_word() for _ in range(4)) + f"-v{some(1, 20)}.{some(0, 20)}.{some(0, 99)}", lambda: "".join(ascii_word() for _ in range(6)) + str(some(1, 999)),
                lambda: "".join(ascii_word().capitalize() for _ in range(5)) + str(some(1, 30)), lambda: "lib" + ascii_word() + ascii_word() + f".so.{some(1, 9)}.{some(0, 99)}.{some(0, 99)}",
                lambda: "x86_64-" + ascii_word() + "-" + ascii_word() + "-gnu", lambda: "1." + ascii_word() + ascii_word() + ascii_word() + "...." + ascii_word() + "2",
                lambda: "." * some(5, 20) + str(some(1, 99)) + ascii_word() + "." * 9, lambda: str(some(1, 9)) + "a" + "-" * some(14, 30), lambda: ascii_word() * some(4, 9) + str(some(1, 9)),
                lambda: str(some(10**9, 10**10)) + "/" + str(some(10**6, 10**7)) + "-" + ascii_word(), *[identifier] * 8, lambda: "".join(ascii_word() for _ in range(some(4, 9))),
                lambda: pick("=-_.~") * some(12, 60) + ascii_word() + pick(["", pick("=-_.~") * some(1, 40)]), lambda: ("".join(ascii_word() for _ in range(4))).capitalize() + pick(["", ".", "..."]),
                lambda: pick(["application", "text", "image"]) + "/" + "-".join(parts(2, 5)) + "+" + pick(["xml", "json"]), lambda: "".join(p.upper() for p in parts(4, 9)), lambda: pick(lower) * some(16, 60), lambda: "-".join(draw("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
                lambda: f"{some(1, 10**6)}/{some(1, 10**6)}/" + ".".join(parts(2, 4)) + f"/{some(1, 99)}", lambda: "-".join([f"{some(0, 100):02}"] * 2 + [ascii_word()] + parts(2, 4)), lambda: (ascii_word()[:2] or "ab") * some(8, 30),
            ]
        )()

    carry = ["Authorization: Bearer ", "key=", "AWS_SECRET_ACCESS_KEY = ", "private_key: ", "credential ", "auth ", "client_id: ", "session=", "export KEY='", "access key ", "Bearer ", "--key "]
    plain = ["see ", "at ", "@", "file ", "http://", "version ", "from ", "in ", "path: ", "/", "name = ", "(", '"', "host: ", "id ", "build "]
    rows = []
    for i in range(count):
        y = i % 2
        body = secret() if y else harmless()
        if len(body) < LEAST or not any(ch.isalpha() for ch in body):
            continue
        carried = rng.random() < (0.6 if y else 0.15)
        head = prose() + " " + (pick(carry) if carried else pick(plain) if rng.random() < 0.6 else "")
        tail = pick(["", " ", "'", '"', ", ", "\n", "### ", "!! "]) + prose()
        raw, at = (head + body + tail).encode(), len(head.encode())
        rows.append((raw, at, at + len(body), y))
    return rows


@cache
def trained() -> tuple[CharCNN, dict[str, float]]:
    """The network, and its recall and precision on held-out findings at the calibrated threshold."""
    rows = labelled()
    # a long one counts by its worst window if harmless, and by its first if secret
    rows = [(raw, a, b, y, v) for raw, a, b, y in rows for v in ([next(windows(raw, a, b))] if y else windows(raw, a, b))]
    views = [r[4] for r in rows]
    x, n, y = np.stack([v for v, _ in views]), np.array([k for _, k in views]), np.array([r[3] for r in rows], "f8")
    part = np.arange(len(x)) % 3
    net = CharCNN()
    net.fit(x[part == 0], n[part == 0], y[part == 0])
    net.calibrate(x[part == 1], n[part == 1], y[part == 1])
    hit = net.probability(x[part == 2], n[part == 2]) >= net.threshold
    truth = y[part == 2] == 1
    return net, {"recall": float(hit[truth].mean()), "precision": float(truth[hit].mean()), "threshold": net.threshold}


def find(raws: list[bytes], net: CharCNN) -> list[list[tuple[int, int, int]]]:
    """All spans (start, end, kind) of each text, in bytes, by start, then kind."""
    out, views, owner, secret = [], [], [], set()

    def score() -> None:
        if views:
            p = net.probability(np.stack([v for v, _ in views]), np.array([k for _, k in views]))
            secret.update(owner[k] for k in np.flatnonzero(p >= net.threshold))
            views.clear()
            owner.clear()

    for i, raw in enumerate(raws):
        found = runs(raw)
        out.append(base_spans(raw, found))
        for a, b in candidates(raw, found, out[-1]):
            for view in windows(raw, a, b):
                views.append(view)
                owner.append((i, a, b))
                if len(views) == VIEWS:
                    score()
    score()
    for i, a, b in sorted(secret):
        # a part of a longer secret is not named again
        if not any((i, s, e) in secret and s <= a and b <= e and e - s > b - a for s, e in {(s, e) for j, s, e in secret if j == i}):
            out[i].append((a, b, 3))
            out[i].sort(key=lambda s: (s[0], s[2]))
    return out


def to_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or raw.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, "u1") & 0xC0) != 0x80)))
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn for every row."""
    net, _ = trained()
    key = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                raws = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                spans = [to_points(raw, s) for raw, s in zip(raws, find(raws, net))]
                count = lambda k: pa.array([sum(x[2] == k for x in s) for s in spans], "i8")  # noqa: E731, B023
                base = [hashlib.sha256(show([x for x in s if x[2] < 3]).encode()).hexdigest() for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), count(0), count(1), count(2), pa.array(base), pa.array([show(s) for s in spans]), count(3)],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"],
                )

    schema = f"doc_id {key}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_cnn bigint"
    return df.select("doc_id", F.col("text").cast("string").alias("text")).transform(arrow, run, schema)


def masked(raw: bytes, spans: list[tuple[int, int, int]], mark: bytes = b"[SECRET]") -> bytes:
    """The text with every span, or group of overlapping spans, replaced."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [raw[at:a], mark]
        at = max(at, b)
    return b"".join([*out, raw[at:]])


def redact(df: DataFrame) -> DataFrame:
    """The same rows and columns; secrets in `text` are replaced (text without one is unchanged, null stays null)."""
    net, _ = trained()
    at_text = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                raws = part.column(at_text).cast(pa.binary()).to_pylist()
                spans = find([r or b"" for r in raws], net)
                if any(spans):
                    new = [masked(r, s).decode() if s else r and r.decode() if r is not None else None for r, s in zip(raws, spans)]
                    new = ["" if r == b"" else x for r, x in zip(raws, new)]
                    part = part.set_column(at_text, "text", pa.array(new, part.schema.field(at_text).type))
                yield part

    return df.transform(arrow, run, df.schema)
