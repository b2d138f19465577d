"""Noise in text from scanned pages: running headers, page numbers, words broken over lines, misread characters.

The lines of a document form a sequence. A linear conditional model (a first-order chain with weights for layout features and
for transitions) labels each line as header, page number, body, or body that ends a
paragraph. Words are then repaired within the body alone, and paragraphs are put together from it.

The model is fitted on all documents, whose lines are labelled by evidence that single lines lack: lines that
recur on other pages at the same edge, and numbers that run along with the pages. Each of them is shown twice, once without the features that hold this
evidence, so that the labels can't simply be read off. What fitting needs of the documents is how often each look of a line, with its label and its neighbours' labels,
occurs: that is counted over the whole table, and the weights maximise the pseudo-likelihood of these counts.
"""

from __future__ import annotations

import difflib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain as joined

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import table

LABELS = ("header", "number", "body", "break")
HEADER, NUMBER, BODY, BREAK = range(4)
PRIOR = 1e-3  # weight of the squared weights for each line that was counted: tables of any size are fitted alike
HYPHENS = "-‐‑¬­="
#: What characters are commonly misread as, right form and read form.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("i", "l"), ("l", "i"), ("i", "1"), ("l", "1"), ("s", "5"), ("o", "0"), ("a", "o"),
    ("o", "a"), ("n", "ri"), ("u", "ii"), ("h", "b"), ("b", "h"), ("d", "cl"), ("cl", "d"), ("g", "q"), ("q", "g"), ("b", "6"), ("g", "9"), ("b", "8"),
    ("m", "rn"), ("rn", "m"), ("w", "vv"), ("y", "v"), ("li", "h"), ("in", "m"), ("nn", "rm"), ("t", "i"), ("z", "2"), ("n", "u"), ("u", "n"),
)
_NUMBER = re.compile(r"^\W*(?:(?:p|pp|page|seite|s|pg|blatt)\b\W*)?(\d{1,4}|(?=\D{0,3}\d)[\dOolIS]{1,4}|[ivxlc]{1,7})\W*(?:(?:/|of|von|de)\W*\d{1,4}\W*)?$", re.I)
_AS_DIGITS = str.maketrans("OolIS", "00115")
_TOKEN = re.compile(r"\S+")
_AT_END = re.compile(r"^(?:\W*(\d{1,4})(?=\W*\s)(?![.,]\d))?(?:.*\s\W*(\d{1,4})\W*$)?")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def roman(s: str) -> int | None:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    n = [value.get(c, 0) for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0], strict=True)) if n and all(n) else None


def page_number(line: str) -> int | None:
    """The number that a line consists of, as digits or Roman, possibly with `page`, dashes or a total; None for any other line."""
    m = _NUMBER.match(line.strip())
    if not m:
        return None
    digits = m[1].translate(_AS_DIGITS) if any(c.isdigit() for c in m[1]) else m[1]
    return int(digits) if digits.isdigit() else roman(m[1])


def number_shape(line: str) -> str:
    """How a page number is written: with a total, with a word, Roman, in dashes or brackets, or bare."""
    t = line.strip()
    m = _NUMBER.match(t)
    if not m:
        return ""
    after = t[m.end(1) :]
    if any(c.isdigit() for c in after):
        return "total"
    if any(c.isalpha() for c in t[: m.start(1)]):
        return "word"
    return "bare" if any(c.isdigit() for c in m[1]) and t == m[1] else "Roman" if m[1].isalpha() else "dashed"


def skeleton(line: str) -> str:
    """A line without digits, case and punctuation: the part of a running header that stays."""
    return " ".join(re.findall(r"[^\W\d_]+", line.lower()))


class Line:
    __slots__ = ("block", "no", "text", "page", "kind", "first", "last", "top", "bottom", "title", "_number", "_bare", "alone", "section", "heads", "_ends_with")

    def __init__(self, block: int, no: int, text: str, page: int | None, kind: str, title: str):
        self.block, self.no, self.text, self.page, self.kind, self.title = block, no, text, page, kind, title
        self.first = self.last = self.top = self.bottom = self.alone = self.heads = False
        self.section = ""
        self._number = self._ends_with = self._bare = None  # made when asked for

    @property
    def number(self) -> int | None:
        if self._number is None:
            n = page_number(self.text)
            self._number = -1 if n is None else n
        return None if self._number < 0 else self._number

    @property
    def ends_with(self) -> list[int]:
        """Numbers of their own at the line's ends."""
        if self._ends_with is None:
            m = _AT_END.match(self.text)
            self._ends_with = [int(n) for n in m.groups() if n] if m else []
        return self._ends_with

    @property
    def bare(self) -> str:
        if self._bare is None:
            self._bare = skeleton(self.text)
        return self._bare


def lines_of(blocks: Iterable[dict] | None) -> list[Line]:
    """All lines of a document's blocks in order; a null block or text has none. A block without page takes that of the block before."""
    out: list[Line] = []
    page = None
    for b, block in enumerate(blocks if blocks is not None else ()):
        if block is None or block.get("text") is None:
            continue
        page = page if block.get("page") is None or block["page"] != block["page"] else int(block["page"])
        path = block.get("section_path")
        title = skeleton(path[0] or "") if path is not None and len(path) else ""
        section = skeleton(path[-1] or "") if path is not None and len(path) > 1 else ""
        texts = block["text"].split("\n")
        of_block = []
        for n, t in enumerate(texts):
            line = Line(b, n, t, page, block.get("kind") or "", title)
            line.first, line.last, line.alone, line.section = n == 0, n == len(texts) - 1, len(texts) == 1, section
            of_block.append(line)
        if block.get("kind") == "heading":  # its last line that is no page number is the heading itself
            for line in reversed(of_block):
                if line.number is None and line.bare:
                    line.heads = True
                    break
        out += of_block
    for i, line in enumerate(out):
        line.top = i == 0 or out[i - 1].page != line.page
        line.bottom = i == len(out) - 1 or out[i + 1].page != line.page
    for i in range(1, len(out)):  # a number above or below a header is at the edge, too
        if out[i - 1].top and (out[i - 1].number is not None or len(out[i - 1].bare) < 40) and out[i].first:
            out[i].top = True
    for i in range(len(out) - 2, -1, -1):
        if out[i + 1].bottom and out[i + 1].number is not None:
            out[i].bottom = out[i].bottom or out[i].last
    return out


@lru_cache(1 << 16)
def _pairs(s: str) -> frozenset[str]:
    return frozenset(map(str.__add__, s, s[1:]))


@lru_cache(1 << 16)
def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def _alike(a: str, b: str) -> bool:
    """Equal but for some misread characters. Strings of a ratio of 0.8 share over half of their pairs of characters, which is quick to see."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 4 or len(a) <= 5:
        return False
    p, q = _pairs(a), _pairs(b)
    return len(p & q) >= 0.4 * min(len(p), len(q)) and _ratio(a, b) >= 0.8


def looks(lines: list[Line]) -> list[str]:
    """How each line looks, from which its features are made; what looks at other pages compares with every line at an edge of the document's pages."""
    edges = [x for x in lines if (x.top or x.bottom or x.first) and x.bare and len(x.text) <= 60]
    groups: list[tuple[str, set]] = []
    of: dict[str, int] = {}
    for x in edges:
        if x.bare not in of:
            k = next((i for i, (s, _) in enumerate(groups) if _alike(s, x.bare)), len(groups))
            if k == len(groups):
                groups.append((x.bare, set()))
            of[x.bare] = k
        groups[of[x.bare]][1].add(x.page if x.page is not None else ("block", x.block))
    offsets = Counter(x.number - x.page for x in lines if x.number is not None and x.page is not None and (x.top or x.bottom or x.alone))
    lead = Counter()
    for x in edges:
        for n in x.ends_with:
            if x.page is not None:
                lead[n - x.page] += 1
    out = []
    for i, x in enumerate(lines):
        t = x.text.strip()
        edge = x.top or x.bottom
        pages = len(groups[of[x.bare]][1]) if (edge or x.first) and x.bare in of else 0
        short = len(t) <= 60
        runs = shape = form = None
        if x.number is not None:
            runs, shape, form = x.page is not None and offsets[x.number - x.page] >= 2, number_shape(t), str((t[:1].isdigit(), t[-1:].isdigit()))
        elif x.ends_with:
            runs = short and (x.first or x.last) and x.page is not None and any(lead[n - x.page] >= 2 for n in x.ends_with)
            form = str((t[:1].isdigit(), t[-1:].isdigit()))
        after = lines[i + 1].text.lstrip()[:1] if i + 1 < len(lines) else ""
        out.append(_look(
            x.kind, pages if pages < 3 else 3, "top" if x.top else "bottom" if x.bottom else "in", x.first, x.last, x.alone, x.heads, min(len(t) // 15, 4), t[-1:] if t[-1:] in _ENDS else "letter" if t[-1:].isalpha() else "digit" if t[-1:].isdigit() else "other",
            x.number is not None, runs, shape, form, _alike(x.title, x.bare) if x.title and short and x.bare else None, _alike(x.section, x.bare) if x.section and x.bare else None,
            _capitals(t) if x.first or x.last else None, "lower" if after.islower() else "upper" if after.isupper() else "other",
        ))
    return out


_ENDS = frozenset(".!?:;," + HYPHENS)


def _capitals(t: str) -> str | None:
    if not any(map(str.isalpha, t)):
        return None
    words = t.split()
    return "all" if t.upper() == t else "most" if sum(c[:1].isupper() for c in words) * 2 > len(words) else "few"


@lru_cache(1 << 16)
def _look(*x: object) -> str:
    return json.dumps(x)


@lru_cache(1 << 16)
def described(look: str) -> tuple[str, ...]:
    return _described(*json.loads(look))


def features(lines: list[Line]) -> list[tuple[str, ...]]:
    """Layout features of each line."""
    return [described(x) for x in looks(lines)]


def _described(kind, pages, edge, first, last, alone, heads, size, end, number, runs, shape, form, title, section, capitals, after) -> tuple[str, ...]:  # noqa: ANN001
    """The names of a line's features; lines that look the same share them."""
    at = edge != "in"
    f = [f"kind={kind}", f"repeat={pages}", f"edge={edge}", f"repeat+edge={min(pages, 2)},{at}", f"place={first:d}{last:d}{alone:d}", f"size={size}", f"end={end}", f"heads={heads}", f"next={after}", f"last+end={last},{end in '.!?'}"]
    if number:
        f += ["number", f"number+kind={kind}", f"number+edge={at}", f"number+runs={runs}", f"number+runs+edge={runs},{at}", f"number+shape={shape},{at}", f"number+shape+kind={shape},{kind}", f"number+form={form},{at}"]
    elif form is not None:
        f += [f"numbered={form},{kind}", *(["runs along"] if runs else [])]
    if title is not None:
        f += ["title", f"title+kind={kind},{first}"] if title else ["not title"]
    if section is not None:
        f.append(f"section={section},{kind}")
    if capitals is not None:
        f.append(f"capitals={capitals}")
    return tuple(f)


#: What features that look at other pages begin with.
EVIDENCE = ("repeat=", "repeat+edge", "number+runs", "runs along")


def without_evidence(feats: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The features of single lines alone. Each document is fitted on with and without the others, so that the model also tells lines of documents that
    show no recurrence by their layout."""
    return [tuple(x for x in f if not x.startswith(EVIDENCE)) for f in feats]


def evident_labels(lines: list[Line], feats: list[list[str]]) -> list[int]:
    """Labels by what the whole document shows (features that EVIDENCE names) and by unmistakable forms; only for fitting."""
    out = []
    for x, f in zip(lines, feats, strict=True):
        s = set(f)
        if x.number is not None and ("number+runs=True" in s and (x.top or x.bottom) or x.kind != "list" and x.alone and (x.top or x.bottom) or (x.top or x.bottom) and number_shape(x.text) in ("total", "word", "Roman")):
            out.append(NUMBER)
        elif x.kind != "list" and not x.heads and len(x.text) <= 60 and x.first and x.bare and ({"repeat=2", "repeat=3"} & s or "runs along" in s and (x.top or x.bottom)) and not x.text.rstrip().endswith((".", ",")):
            out.append(HEADER)
        else:
            out.append(BREAK if x.last and x.text.rstrip()[-1:] in ".!?:" else BODY)
    return out


class Chain:
    """Weights of the linear conditional model."""

    def __init__(self, w: dict[str, np.ndarray] | None = None, t: np.ndarray | None = None):
        self.w = w or {}
        self.t = t if t is not None else np.zeros((4, 4))

    def scores(self, f: tuple[str, ...]) -> list[float]:
        zero = (0.0,) * 4
        return [sum(x) for x in zip(*(self.w.get(y, zero) for y in f), strict=True)] if f else [0.0] * 4

    def label(self, feats: list[tuple[str, ...]], known: dict | None = None) -> list[int]:
        """The best labels; known keeps scores of lines that look the same, for a model that doesn't change."""
        if not feats:
            return []
        known = {} if known is None else known
        t = self.t.tolist()
        best, back = None, []
        for f in feats:
            e = known.get(f)
            if e is None:
                e = known[f] = self.scores(f)
            if best is None:
                best = e
                continue
            now, came = [], []
            for j in range(4):
                v = [best[i] + t[i][j] for i in range(4)]
                m = max(v)
                came.append(v.index(m))
                now.append(m + e[j])
            back.append(came)
            best = now
        y = [best.index(max(best))]
        for came in reversed(back):
            y.append(came[y[-1]])
        return y[::-1]

    @staticmethod
    def fit(docs: list[tuple[list[tuple[str, ...]], list[int]]]) -> Chain:
        """The chain of documents at hand: features and labels of each."""
        return Chain.of_counts(Counter(w for feats, gold in docs for w in windows(feats, gold)))

    @staticmethod
    def of_counts(counts: dict[tuple[int, tuple[str, ...], int, int], int]) -> Chain:
        """The chain of the highest pseudo-likelihood; counts: of (label before, features, label, label after), as windows() has them."""
        items = sorted(counts.items())
        if not items:
            return Chain()
        kinds = {f: n for n, f in enumerate(sorted({f for (_, f, _, _), _ in items}))}
        names = {x: n for n, x in enumerate(sorted({x for f in kinds for x in f}))}
        flat, of = np.array([names[x] for f in kinds for x in f], dtype=np.int64), np.repeat(np.arange(len(kinds)), [len(f) for f in kinds])
        before, look, gold, after = (np.array(x) for x in zip(*((a, kinds[f], y, b) for (a, f, y, b), _ in items), strict=True))
        n, at, k = np.array([c for _, c in items], dtype=float), np.arange(len(items)), len(names)
        prior = PRIOR * n.sum()

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            w, t = x[: 4 * k].reshape(k, 4), np.zeros((5, 5))  # the last row and column: no neighbour
            t[:4, :4] = x[4 * k :].reshape(4, 4)
            s = np.stack([np.bincount(of, w[flat, j], len(kinds)) for j in range(4)], 1)[look] + t[before, :4] + t[:4, after].T
            s -= s.max(1, keepdims=True)
            p = np.exp(s)
            z = p.sum(1)
            d = p / z[:, None]
            d[at, gold] -= 1
            d *= n[:, None]
            of_look = np.stack([np.bincount(look, d[:, j], len(kinds)) for j in range(4)], 1)
            dw = np.stack([np.bincount(flat, of_look[of, j], k) for j in range(4)], 1)
            dt = np.stack([np.bincount(before % 5, d[:, j], 5)[:4] for j in range(4)], 1) + np.stack([np.bincount(after % 5, d[:, j], 5)[:4] for j in range(4)])
            return float(n @ (np.log(z) - s[at, gold]) + prior / 2 * (x @ x)), np.concatenate([dw.ravel(), dt.ravel()]) + prior * x

        x = lowest(loss, np.zeros(4 * k + 16))
        return Chain(dict(zip(names, x[: 4 * k].reshape(k, 4), strict=True)), x[4 * k :].reshape(4, 4))


def windows(kinds: list, labels: list[int]) -> Iterator[tuple]:
    """(label before, look, label, label after) of each line; -1 where there is no neighbour."""
    return zip([-1, *labels[:-1]], kinds, labels, [*labels[1:], -1], strict=True) if labels else iter(())


def lowest(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 300, keep: int = 10) -> np.ndarray:
    """Where the convex loss, given with its gradient, is least (L-BFGS)."""
    v, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, used = g.copy(), []
        for s, y in reversed(past):
            used.append(s @ d / (s @ y))
            d -= used[-1] * y
        d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(past, reversed(used), strict=True):
            d += s * (a - y @ d / (s @ y))
        step = 1.0
        while (new := loss(x - step * d))[0] > v - 1e-4 * step * (g @ d) and step > 1e-10:
            step /= 2
        if new[0] >= v:
            break
        s, y = -step * d, new[1] - g
        done, x, v, g = v - new[0] < 1e-9 * v, x + s, *new
        if done:
            break
        if s @ y > 1e-12:
            past = [*past, (s, y)][-keep:]
    return x


class Lexicon:
    """The house vocabulary, and every form that one or two common misreadings make of its words: made at once for up to `most` words, else found by undoing
    the misreadings of each token that is no word, with the same result."""

    def __init__(self, words: Iterable[str], capital: frozenset[str] = frozenset(), most: int = 20_000):
        self.words = frozenset(w.lower() for w in words if w)
        self.capital = capital
        self.read: dict[str, tuple[int, str]] = {}
        self._near: dict[str, str | None] = {}
        self.made = len(self.words) <= most
        if self.made:
            self._make()

    def _make(self) -> None:
        forms = [(w, w, 0) for w in sorted(self.words)]
        for depth in (1, 2):
            made = []
            for form, word, at in forms:
                for right, read in CONFUSIONS:
                    i = form.find(right, at)
                    while i >= 0:
                        new = form[:i] + read + form[i + len(right) :]
                        made.append((new, word, i + len(read)))
                        if new not in self.words and self.read.get(new, (9, ""))[0] > depth:
                            self.read[new] = (depth, word)
                        elif self.read.get(new, (0, word)) == (depth, "") or self.read.get(new, (0, word))[0] == depth and self.read[new][1] != word:
                            self.read[new] = (depth, min(word, self.read[new][1] or word))
                        i = form.find(right, i + 1)
            forms = made

    def misread(self, u: str) -> str | None:
        """The word of which u is a misread form: of the fewest misreadings, then the first by letters."""
        if self.made or u in self.read:
            return self.read.get(u, (0, None))[1]
        if len(self.read) > 200_000:
            self.read.clear()
        now, word = [(u, 0)], None
        for _ in (1, 2):
            nxt = []
            for form, at in now:
                for right, read in CONFUSIONS:
                    i = form.find(read, at)
                    while i >= 0:
                        nxt.append((form[:i] + right + form[i + len(read) :], i + len(right)))
                        i = form.find(read, i + 1)
            word = min((f for f, _ in nxt if f in self.words), default=None)
            if word is not None:
                break
            now = nxt
        self.read[u] = (0, word)
        return word

    def right(self, token: str, loose: bool = False) -> str | None:
        """The word (lower case) that was read as token, or None. loose: also the only word one letter away."""
        u = token.lower()
        if u in self.words:
            return u
        word = self.misread(u)
        if word is not None:
            return word
        if not loose or len(u) < 6:
            return None
        if u not in self._near:
            if len(self._near) > 100_000:
                self._near.clear()
            letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñóíúá"
            hit = {u[:i] + u[i + 1 :] for i in range(len(u))} | {u[:i] + c + u[i + k :] for i in range(len(u) + 1) for c in letters for k in (0, 1)}
            hit &= self.words
            self._near[u] = hit.pop() if len(hit) == 1 else None
        return self._near[u]

    def cased(self, word: str, token: str, begins: bool) -> str:
        """word in the capitals of token, whose first character may have been read as a digit."""
        letters = [c for c in token if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            return word.upper()
        first = token[0]
        capital = first.isupper() if first.isalpha() else begins or word in self.capital
        return word[:1].upper() + word[1:] if capital else word


def repair(lines: list[Line], labels: list[int], lex: Lexicon) -> tuple[list[tuple[int, int, str, str]], list[str]]:
    """(block, line, kind, fixed) of furniture, broken and misread words, and the document's paragraphs."""
    found: list[tuple[int, int, str, str]] = []
    body = [x for x, y in zip(lines, labels, strict=True) if y in (BODY, BREAK)]
    ends = {id(x): y == BREAK for x, y in zip(lines, labels, strict=True)}
    for x, y in zip(lines, labels, strict=True):
        if y in (HEADER, NUMBER) and x.text.strip():
            found.append((x.block, x.no, "furniture", ""))
    paragraphs: list[str] = []
    now: list[str] = []
    begun = ""  # the first part of a word broken over the line end before, with its hyphen if that is the word's own
    begins = True
    for i, x in enumerate(body):
        tokens = _TOKEN.findall(x.text)
        for k, raw in enumerate(tokens):
            if k == 0 and begun:
                a, raw_b = begun, raw
                begun = ""
                tail = raw_b[len(raw_b.rstrip(".,;:!?)\"'»”")) :]
                b = raw_b[: len(raw_b) - len(tail)]
                head = _EDGE.match(a)[0] if _EDGE.match(a) and not a[0].isalnum() else ""
                core = a[len(head) :] + b
                word = lex.right(core) or (lex.right(core, loose=True) if a[-1] != "-" else None)
                fixed = core if word is None or word == core.lower() else lex.cased(word, core, begins)
                y = body[i - 1]
                found.append((y.block, y.no, "broken_word", fixed))
                now.append(head + fixed + tail)
                begins = tail[:1] in (".", "!", "?") if tail else False
                continue
            if raw.lower() in lex.words:
                now.append(raw)
                begins = False
                continue
            if k == len(tokens) - 1 and len(raw) > 1 and raw[-1] in HYPHENS and raw[-2].isalpha() and i + 1 < len(body):
                after = _TOKEN.findall(body[i + 1].text)
                a, b = raw[:-1], _EDGE.sub("", after[0]) if after else ""
                whole = f"{a}-{b}".lower()
                if b and b[0].isalpha() and (b[0].islower() or a.isupper()):
                    begun = f"{a}-" if lex.right(_EDGE.sub("", whole)) is not None else a
                    break
            core = _EDGE.sub("", raw)
            fixed = raw
            if core and not core.isdigit() and core.lower() not in lex.words:
                loose = core.isalpha() and core.islower()
                word = lex.right(core, loose) if any(c.isalpha() for c in core) and len(core) > 1 else None
                if word is not None and len(word) > 1:
                    right = lex.cased(word, core, begins)
                    if right != core:
                        found.append((x.block, x.no, "misread_word", right))
                        fixed = raw.replace(core, right, 1)
            now.append(fixed)
            begins = raw[-1] in ".!?"
        if ends[id(x)] and not begun or x.kind == "heading" and x.last or i + 1 == len(body) or body[i + 1].kind in ("heading", "list") and body[i + 1].first:
            if now:
                paragraphs.append(" ".join(now))
            now, begins = [], True
    return found, paragraphs


def _scanned(irs: DataFrame) -> DataFrame:
    """Documents that went through text recognition: they name an engine (even an empty one) or a confidence."""
    return irs.where("provenance.ocr_engine IS NOT NULL OR provenance.ocr_confidence IS NOT NULL").select("ir_id", "text_blocks")


def _spread(docs: DataFrame) -> DataFrame:
    """Documents are independent: they are only spread where a few files would leave cores idle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(2 * cores)


def _looked(irs: DataFrame) -> DataFrame:
    """Every scanned document with the looks of its lines and their evident labels, kept for fitting and for labelling."""
    docs = _scanned(irs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, labels = [], []
            for blocks in b.column(1).to_pylist():
                lines = lines_of(blocks)
                kinds.append(looks(lines))
                labels.append(evident_labels(lines, [described(x) for x in kinds[-1]]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int32()))], names=["ir_id", "text_blocks", "looks", "labels"])

    schema = T.StructType([*docs.schema.fields, T.StructField("looks", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.IntegerType()))])
    return table(_spread(docs).mapInArrow(run, schema), "looks")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for counts in _counted((w for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in windows(x, y)) for b in batches):
        before, look, label, after = zip(*counts, strict=True)
        yield pa.RecordBatch.from_pydict({"before": pa.array(before, pa.int32()), "look": look, "label": pa.array(label, pa.int32()), "after": pa.array(after, pa.int32()), "n": pa.array(counts.values(), pa.int64())})


def _capitals_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for counts in _counted(joined.from_iterable(_INSIDE.findall(t) for t in b.column(0).to_pylist() if t) for b in batches):
        yield pa.RecordBatch.from_pydict({"word": [w.lower() for w in counts], "n": pa.array([n if w[0].isupper() and not w.isupper() else -n for w, n in counts.items()], pa.int64())})


_INSIDE = re.compile(r"(?<=[\w,] )[^\W\d_]+")


def _counted(parts: Iterable[Iterable], most: int = 200_000) -> Iterator[Counter]:
    """How often each thing occurs, given out whenever over `most` have gathered, and at the end; to be summed up."""
    counts: Counter = Counter()
    for x in parts:
        counts.update(x)
        if len(counts) > most:
            yield counts
            counts = Counter()
    if counts:
        yield counts


def _fit(looked: DataFrame, lexicon: DataFrame) -> tuple[Chain, frozenset[str]]:
    counts = looked.select("looks", "labels").mapInArrow(_windows, "before int, look string, label int, after int, n bigint").groupBy("before", "look", "label", "after").agg(F.sum("n"))
    both: Counter = Counter()
    for before, look, label, after, n in counts.collect():
        f = described(look)
        both[before, f, label, after] += n
        both[before, without_evidence([f])[0], label, after] += n
    inside = looked.select(F.explode("text_blocks.text")).mapInArrow(_capitals_of, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    capital = inside.join(lexicon.select(F.lower("word").alias("word")), "word", "left_semi")  # of other words none is asked for
    return Chain.of_counts(both), frozenset(r[0] for r in capital.collect())


def fit(irs: DataFrame, lexicon: DataFrame) -> tuple[Chain, frozenset[str]]:
    """The model, and words of the lexicon that usually have a capital inside sentences, from all scanned documents."""
    return _fit(_looked(irs), lexicon)


def _run(irs: DataFrame, lexicon: DataFrame, model: tuple[Chain, frozenset[str]] | None, schema: str, rows_of) -> DataFrame:
    if model is None:
        docs = _looked(irs)
        model = _fit(docs, lexicon)
        docs = docs.drop("labels")
    else:
        docs = _scanned(irs)
    chain, capital = model
    words = [r[0] for r in lexicon.select("word").where("word IS NOT NULL").distinct().limit(5_000_001).collect()]
    if len(words) > 5_000_000:
        raise ValueError("every worker holds the lexicon: at most 5,000,000 words")
    shared = irs.sparkSession.sparkContext.broadcast((chain.w, chain.t, words, capital))
    kept: dict = {}

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "lex" not in kept:
            w, t, vocabulary, capitals = shared.value
            kept["chain"], kept["lex"] = Chain(w, t), Lexicon(vocabulary, capitals)
        known: dict = {}
        for b in batches:
            out: list[tuple] = []
            for ir, blocks, *seen in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = lines_of(blocks)
                known = known if len(known) < 100_000 else {}
                feats = [described(x) for x in seen[0]] if seen else features(lines)
                out += [(ir, *x) for x in rows_of(*repair(lines, kept["chain"].label(feats, known), kept["lex"]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[] for _ in names], kinds.types, strict=True)], schema=kinds)

    return _spread(docs.where("ir_id IS NOT NULL")).mapInArrow(run, schema)


def found_noise(irs: DataFrame, lexicon: DataFrame, model: tuple[Chain, frozenset[str]] | None = None) -> DataFrame:
    """Distinct (ir_id, block_no, line_no, kind, fixed): furniture lines, words broken over a line end, misread words with their right form.

    Only documents that went through text recognition count. Without a model (of fit()) one is fitted on the documents themselves. Blocks that are null or have a null text keep their number and give nothing.
    """
    return _run(irs, lexicon, model, "ir_id bigint, block_no int, line_no int, kind string, fixed string", lambda found, _: found).distinct()


def paragraphs(irs: DataFrame, lexicon: DataFrame, model: tuple[Chain, frozenset[str]] | None = None) -> DataFrame:
    """(ir_id, paragraph_no, text): the readable text of each scanned document, from 0 on."""
    return _run(irs, lexicon, model, "ir_id bigint, paragraph_no int, text string", lambda _, text: enumerate(text))
