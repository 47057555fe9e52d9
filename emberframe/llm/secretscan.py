"""Secret scans: patterns, and a character convolutional network over every candidate in its context.

Candidates are runs of token characters (CHARS) with a letter: all of LONG or more, shorter ones of SHORT or more that also
hold a digit, and whatever stands where a key word announces a value. Runs longer than SPLIT are also taken apart at
separators, so that a credential at the end of a path is judged by itself.

The network reads the characters from BEFORE in front of a window's start to AFTER behind it, with a channel that marks the
candidate itself: embedding, one convolution, maxima over the candidate and means over the window, a small dense
layer. Candidates longer than a window are read in overlapping windows over their whole length, and the best one counts. It is trained
in numpy, on the driver, on labelled findings that ``labelled_findings`` writes from a seed. Platt scaling on held-out findings
calibrates it, and the threshold is the largest, up to even odds, at which their recall is still ``recall``.

Pattern findings stay whatever the network says; the network adds those that no pattern covers.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.workspace import doc_rows, map_rows, ship

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
CHARS = r"A-Za-z0-9+/_.=!@#$%^&*~?:\-"
LONG, SHORT, SPLIT = 16, 8, 40
_RUN = re.compile(rf"(?<![{CHARS}])(?=[A-Za-z]*+[^A-Za-z\s]|[{CHARS}]{{{LONG}}})[{CHARS}]{{{SHORT},}}")
_PARTS = re.compile(r"[^./:=_?&-]+")
_KEYED = re.compile(r"""(?:passw(?:or)?d|passphrase|passcode|pwd|pass|secret|token|key|auth[a-z]{0,12}|bearer|credentials?|private)["']?[ \t]{0,2}(?:[:=]|\bis\b|[ \t])[ \t]{0,2}["']?([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)
_EDGE = ".,:;!?*#$%&=-_~^@/+"
BEFORE, AFTER, SYMBOLS = 32, 64, 130
SCHEMA = "doc_id long, findings array<struct<kind:string,start:long,end:long,score:double>>"


def pattern_findings(text: str) -> list[tuple[str, int, int]]:
    """Base findings of every kind, leftmost and non-overlapping within a kind; a match that fails its length is dropped."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs and announced values by start; marks at the edges are not part, but for a value's last ``=`` and marks inside quotes."""
    out = set()
    for m in _RUN.finditer(text):
        run = m[0]
        a = m.start() + len(run) - len(run.lstrip(_EDGE))
        b = m.start() + len(run.rstrip(_EDGE.replace("=", "")))
        if any(map(str.isalpha, run)) and (b - a >= LONG or (b - a >= SHORT and any(map(str.isdigit, run)))):
            out.add((a, b))
    for m in _KEYED.finditer(text):
        run = m[1].rstrip(".,:;?)]}")
        if len(run) >= 6:
            out.add((m.start(1), m.start(1) + len(run)))
    kept: list[tuple[int, int]] = []
    for a, b in sorted(out, key=lambda s: (s[0], -s[1])):  # the longer of two that overlap
        if kept and a < kept[-1][1]:
            if b - a > kept[-1][1] - kept[-1][0]:
                kept[-1] = (a, b)
            continue
        kept.append((a, b))
    return kept


def parts(text: str, span: tuple[int, int]) -> list[tuple[int, int]]:
    """A long candidate's pieces between separators, those of LONG or more."""
    a, b = span
    if b - a <= SPLIT:
        return []
    return [(a + m.start(), a + m.end()) for m in _PARTS.finditer(text[a:b]) if m.end() - m.start() >= LONG]


def places(span: tuple[int, int]) -> list[int]:
    """Where windows begin that read a whole candidate, the last one with what is behind it."""
    a, b = span
    return [a] if b - a <= AFTER - 16 else [*range(a, b - AFTER + 16, AFTER // 2), b - AFTER + 16]


def windows(text: str, spans: list[tuple[int, int]], starts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (0: outside the text) and candidate marks of one window for each span, from ``starts`` (the span's own)."""
    sym = np.zeros((len(spans), BEFORE + AFTER), np.int64)
    mark = np.zeros(sym.shape, np.float32)
    for i, (a, b) in enumerate(spans):
        w = starts[i] if starts else a
        low = max(0, w - BEFORE)
        part = np.frombuffer(text[low : w + AFTER].encode("utf-32-le", "surrogatepass"), np.uint32)
        at = BEFORE - (w - low)
        sym[i, at : at + len(part)] = np.minimum(part, SYMBOLS - 2) + 1
        mark[i, BEFORE + max(a - w, -BEFORE) : BEFORE + min(b - w, AFTER)] = 1
    return sym, mark


def labelled_findings(n: int, seed: int = 11) -> list[tuple[str, tuple[int, int], int]]:
    """n findings (text, span, 1 for a secret): credentials of many forms, and tokens that only look like them."""
    r = random.Random(seed)
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alnum, hexd = low + up + dig, "0123456789abcdef"
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "ti", "es", "or", "st", "en", "at", "is", "ou", "ea", "ng", "al", "it", "que", "des", "sch", "ung", "ci", "as", "ment", "ver", "pro", "com")) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    number = lambda a, b: str(r.randint(a, b))
    onsets, vowels, codas = "b br ch d f g gr h k kl l m n p pf qu r s sch schl st str t th tr tz v w z".split(), "a e i o u ei ie au eu ou io".split(), ["", "", "", *"n r s t l ng ch cht lt nd rt st tz ss pf".split()]
    long_word = lambda a, b: "".join(r.choice(onsets) + r.choice(vowels) + r.choice(codas) for _ in range(r.randint(a, b)))
    cased = lambda w: r.choice((w, w, w.capitalize(), w.upper()))
    uuid = lambda: "-".join(some(hexd, k, k) for k in (8, 4, 4, 4, 12))
    name = lambda: "_".join(word() for _ in range(r.randint(2, 4)))
    says = lambda: r.choice(("password: ", "password=", "pwd = ", "passwd: '", "pass: ", "passphrase is ", "secret=", "token = \"", "key: ", "api key ", "auth=", "credential ", "private_key = ", "Authorization: ", "Bearer ", "the password is ", "client_secret: "))
    secrets = [
        lambda: ("", some(hexd, 32, 64)), lambda: ("", some(hexd.upper(), 32, 48)), lambda: ("", some(alnum, 20, 48)), lambda: ("", some(alnum + "+/", 40, 60) + "=" * r.randint(0, 2)),
        lambda: ("Bearer ", some(alnum + "-_", 24, 60)), lambda: (says(), some(alnum, 16, 44)), lambda: (says(), some(alnum, 16, 24)), lambda: (says(), some(low + up, 16, 44)),
        lambda: ("", some(low + up, 28, 48)), lambda: ("", some(alnum, 16, 20)), lambda: (says(), some(alnum + "!@#$%^&*!@#$%^&*", 8, 18)), lambda: (says(), some(alnum + "!@#$", 9, 14)),
        lambda: (says(), uuid()), lambda: (says(), some(hexd, 16, 31)), lambda: (says(), some(up + dig, 16, 32)), lambda: (says(), some(low + dig, 10, 20)),
        lambda: ("", r.choice(("ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "pk_", "ya29.", "SG.")) + some(alnum, 20, 40)),
        lambda: ("", "eyJ" + some(alnum, 16, 30) + "." + some(alnum, 20, 40) + "." + some(alnum + "-_", 20, 43)), lambda: ("", some(alnum + "+/", 80, 300)),
        lambda: (f"https://{word()}.com/{word()}/", some(alnum, 20, 40)), lambda: (f"{name()}=", some(alnum, 20, 40)),
    ]
    others = [
        lambda: ("", f"{word()}{number(0, 99)}.{word()}.example.{r.choice(('com', 'org', 'net'))}"), lambda: ("", f"{long_word(1, 3)}.{number(0, 99)}@mail{number(0, 9)}.{r.choice((word() + word(), 'example'))}.{r.choice(('com', 'org', 'de'))}"), lambda: ("", f"{word()}{r.choice(('.', '_', ''))}{number(0, 99)}@{word()}.{r.choice(('com', 'net', 'fr'))}"),
        lambda: ("", f"https://www.{word()}.com/{word()}/{number(1, 9999)}/{word()}-{word()}"), lambda: ("", f"{word()}-{word()}-{word()}-{number(1, 2030)}-{word()}"),
        lambda: ("", f"{name()}_{number(1, 99)}_{word()}.{r.choice(('txt', 'html', 'tar.gz', 'py'))}"), lambda: ("", f"20{number(10, 29)}-0{number(1, 9)}-{number(10, 28)}T{number(10, 23)}:{number(10, 59)}:{number(10, 59)}.{number(100, 999)}Z"),
        lambda: ("", word() + word() + word() + number(1, 99) + word() + word()), lambda: ("", r.choice("-=_.*#") * r.randint(16, 90)), lambda: ("", (word() + number(0, 9)) * r.randint(3, 9)),
        lambda: ("", f"v{number(1, 9)}.{number(0, 99)}.{number(0, 99)}-{word()}.{word()}+{word()}"), lambda: ("", ".".join(word() + word() for _ in range(4)) + number(0, 9)),
        lambda: ("", f"/{word()}/{word()}/{word()}/{word()}{number(1, 500)}/{word()}/{word()}"), lambda: ("", f"{number(1, 255)}.{number(1, 255)}.{number(1, 255)}.{number(1, 255)}"),
        lambda: ("", uuid()), lambda: ("id ", uuid()), lambda: ("", some(dig, 16, 16)), lambda: ("", some(dig, 16, 16)), lambda: ("", "-".join(some(dig, 4, 4) for _ in range(4))), lambda: ("", f"+{number(1, 99)}-{number(100, 999)}-{number(1000, 9999999)}"),
        lambda: ("", "".join(word().capitalize() for _ in range(r.randint(3, 5)))), lambda: ("", word() + "".join(word().capitalize() for _ in range(r.randint(2, 4)))),
        lambda: ("", cased(long_word(4, 9))), lambda: ("", cased(long_word(4, 7))), lambda: ("", cased("".join(r.choice((word, lambda: long_word(1, 1)))() for _ in range(r.randint(4, 8))))), lambda: (says(), long_word(2, 5)), lambda: ("", cased(long_word(2, 4)) + number(1, 99)),
        lambda: ("", "".join(word() for _ in range(r.randint(4, 7)))), lambda: ("", "".join(word() for _ in range(r.randint(3, 5))).upper()), lambda: ("", name() + "_" + name()), lambda: ("", name().upper() + "_" + word().upper()),
        lambda: (says(), word() + word()), lambda: (says(), r.choice(("required", "changed", "incorrect", "not-set", "none.", "optional", "forgotten", "protected", "economy", name(), "${" + name() + "}", "os.environ", "********"))),
        lambda: ("", word() + number(1, 2030)), lambda: ("", f"{word()}{number(1, 99)}{word()}"), lambda: ("", f"978-{number(0, 9)}-{number(10, 99)}-{number(100000, 999999)}-{number(0, 9)}"),
        lambda: ("", "/".join(word() for _ in range(r.randint(8, 30)))), lambda: ("", "".join(word() for _ in range(r.randint(20, 60)))), lambda: ("", f"{word()}={word()}&{word()}={number(1, 99)}&{word()}={word()}"), lambda: ("", "ab" * r.randint(8, 60)),
    ]
    out = []
    while len(out) < n:
        y = r.random() < 0.5
        lead, tok = r.choice(secrets if y else others)()
        if len(tok) < 6:
            continue
        head = prose(r.randint(0, 6)) + r.choice((" ", "\n", " | ", "### ", " ", " (", ' "')) + lead
        out.append((head + tok + r.choice((" ", ".\n", '"', ",", "", ")", "&&& ", "!! ")) + prose(r.randint(0, 5)), (len(head), len(head) + len(tok)), int(y)))
    return out


_SHAPES = (("emb", (SYMBOLS, 8)), ("conv", (5 * 9, 24)), ("cb", (24,)), ("d1", (48, 16)), ("b1", (16,)), ("d2", (16,)), ("b2", ()))


@dataclass
class Network:
    """Weights, calibration and threshold."""

    w: dict
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, sym: np.ndarray, mark: np.ndarray) -> tuple:
        w = self.w
        x = np.concatenate([w["emb"][sym], mark[..., None]], axis=2)
        cols = np.concatenate([x[:, i : x.shape[1] - 4 + i] for i in range(5)], axis=2)
        a = cols @ w["conv"] + w["cb"]
        h = np.maximum(a, 0)
        inside = mark[:, 2:-2, None]
        top = (h * inside).argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h * inside, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        z = pooled @ w["d1"] + w["b1"]
        g = np.maximum(z, 0)
        return cols, a, h, inside, top, pooled, z, g, g @ w["d2"] + w["b2"]

    def scores(self, sym: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-(self.slope * self.forward(sym, mark)[-1] + self.shift)))

    def gradients(self, sym: np.ndarray, mark: np.ndarray, y: np.ndarray) -> dict:
        w = self.w
        cols, a, h, inside, top, pooled, z, g, out = self.forward(sym, mark)
        d = (1 / (1 + np.exp(-out)) - y) / len(y)
        grad = {"d2": g.T @ d, "b2": d.sum()}
        dz = np.outer(d, w["d2"]) * (z > 0)
        grad |= {"d1": pooled.T @ dz, "b1": dz.sum(0)}
        dp = dz @ w["d1"].T
        dh = np.repeat(dp[:, None, 24:] / h.shape[1], h.shape[1], axis=1)
        at = np.zeros_like(h)
        np.put_along_axis(at, top[:, None], dp[:, None, :24], 1)
        da = (dh + at * inside) * (a > 0)
        grad |= {"conv": np.einsum("nlc,nlf->cf", cols, da, optimize=True), "cb": da.sum((0, 1))}
        dx = da @ w["conv"].T
        de = np.zeros((*sym.shape, 8))
        for i in range(5):
            de[:, i : sym.shape[1] - 4 + i] += dx[..., i * 9 : i * 9 + 8]
        emb = np.zeros_like(w["emb"])
        np.add.at(emb, sym.ravel(), de.reshape(-1, 8))
        return grad | {"emb": emb}


def train(findings: list[tuple[str, tuple[int, int], int]], recall: float = 0.98, epochs: int = 5, seed: int = 3) -> Network:
    """Fits on four fifths of the findings by Adam; calibrates and sets the threshold on the rest. Of a long finding one window is read."""
    rng = np.random.default_rng(seed)
    parts = [windows(t, [s], [int(rng.choice(places(s)))]) for t, s, _ in findings]
    sym, mark = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    y = np.array([f[2] for f in findings], np.float64)
    fold = np.arange(len(y)) % 5 == 0
    net = Network({k: rng.normal(0, 0.5 if k == "emb" else 1 / np.sqrt(max(1, s[0] if s else 1)), s) * (k not in ("cb", "b1", "b2")) for k, s in _SHAPES})
    m, v, step = {k: 0.0 for k in net.w}, {k: 0.0 for k in net.w}, 0
    rows = np.flatnonzero(~fold)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
            step += 1
            for k, g in net.gradients(sym[part], mark[part], y[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.w[k] = net.w[k] - 0.006 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    out, t = net.forward(sym[fold], mark[fold])[-1], y[fold]
    for _ in range(300):  # Platt scaling
        p = 1 / (1 + np.exp(-(net.slope * out + net.shift)))
        net.slope -= 0.05 * float(np.mean((p - t) * out))
        net.shift -= 0.05 * float(np.mean(p - t))
    found = np.sort(net.scores(sym[fold], mark[fold])[t == 1])
    net.threshold = min(0.5, float(found[int((1 - recall) * len(found))]))
    return net


@lru_cache
def default_network(findings: int = 10000, recall: float = 0.98) -> Network:
    """The network of ``labelled_findings``, trained once in a process."""
    return train(labelled_findings(findings), recall)


def judged(text: str, spans: list[tuple[int, int]], net: Network) -> np.ndarray:
    """Score of each span: the best of its windows."""
    at = [(i, w) for i, s in enumerate(spans) for w in places(s)]
    best = np.zeros(len(spans))
    for k in range(0, len(at), 512):
        some = at[k : k + 512]
        np.maximum.at(best, [i for i, _ in some], net.scores(*windows(text, [spans[i] for i, _ in some], [w for _, w in some])))
    return best


def findings(text: str | None, net: Network) -> list[tuple[str, int, int, float]]:
    """All findings of a text by start and kind: (kind, start, end, calibrated score); offsets in code points.

    Of a long candidate the pieces that are secrets are found; all of it, if all its pieces are or it has none.
    """
    if not text:
        return []
    base = pattern_findings(text)
    starts, ends = [], []  # what patterns cover, joined
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(span: tuple[int, int]) -> bool:
        k = bisect_right(starts, span[0])
        return not (k and ends[k - 1] > span[0]) and not (k < len(starts) and starts[k] < span[1])

    whole = candidates(text)
    pieces = [[p for p in parts(text, c) if free(p)] for c in whole]
    spans = [(a, b) for _, a, b in base] + [p for ps in pieces for p in ps] + [c for c in whole if free(c)]
    if not spans:
        return []
    score = dict(zip(spans, judged(text, spans, net).tolist(), strict=True))
    out = [(k, a, b, score[a, b]) for k, a, b in base]
    for c, ps in zip(whole, pieces, strict=True):
        good = [p for p in ps if score[p] >= net.threshold]
        if c in score and (len(good) == len(ps) if ps else score[c] >= net.threshold) and free(c):
            good = [c]
        out += [("model", *p, max([score[p]] + [score[q] for q in ps if p == c])) for p in good]
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def find_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id and findings (array of kind, start, end, score) of every row.

    Null and empty texts have none. Rows that repeat an id keep a row each, null ids stay null,
    extra columns are ignored, an empty table gives no rows.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net or default_network())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "score"), f, strict=True)) for f in findings(t.as_py(), sent.value)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "findings"])

    return doc_rows(docs).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, net: Network | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every finding in ``text`` replaced by the mask (n_chars follows, if there); rows and columns stay."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net or default_network())
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        out, end = [], 0
        for _, a, b, _ in findings(text, sent.value):
            if a >= end:
                out += [text[end:a], mask]
            end = max(end, b)
        return "".join(out) + text[end:] if end else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type))

    out = map_rows(docs, run)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
