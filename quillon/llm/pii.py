"""Personal information in free text: a semi-Markov conditional model over whole spans.

A text is cut into segments: either one of the candidate spans (an entity of one of five types, bounded in length) or text
between them. A candidate is scored as a whole, by features of the full span (form, shape, capitals, titles, the words around it) and
of the entity before it; an exact dynamic program then chooses boundaries and types of all segments together.

Candidates are proposed generously: every way to end an address, every sub-sequence of up to NAME_PARTS capitalised words outside the vocabulary that could be a name, every
group of digits. The weights are those of averaged perceptrons, each fitted on a share of about SHARD_DOCS documents, and their mean over all shares, so that every document is fitted on.
Evidence tells what a span is that the model doesn't see:
of a name the list of persons and the affixes of its names, which no feature knows, so that names of any language are found by their form and surroundings; of a number the nearest
cue word and what the collection's cues say of numbers of its shape; for half of the training spans the words around are hidden, too.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import table

KINDS = ("email", "phone", "id_number", "address", "name")
SHARD_DOCS = 3_000  # documents with candidates that one perceptron is fitted on
NAME_PARTS = 6  # words of the longest name, as entities are bounded
CLOSE = 30  # characters between entities that are near each other

_U, _L = "A-ZÀ-ÖØ-Þ", "a-zà-öø-ÿß"
_CAP = rf"[{_U}][{_U}{_L}'’]+"
_SEP = r"(?:,\s+|\s+)"
_LOCAL, _AT, _DOT = r"[A-Za-z0-9_%+][\w.%+-]*", r"(?:@|\s?[\[({<]\s?at\s?[\])}>]\s?)", r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
EMAIL = re.compile(rf"{_LOCAL}(?:{_AT}(?:[A-Za-z0-9-]+{_DOT})+|\s+at\s+(?:[A-Za-z0-9-]+\s+dot\s+)+)[A-Za-z]{{2,}}(?![\w@])", re.I)
_AT_SIGN = re.compile(r"@|[\[({<] ?at ?[\])}>]|\sat\s+[\w-]+\s+dot\s", re.I)
_AT_PARTS = ("@", "dot", *(f"{x}{y}at" for x in "[({<" for y in ("", " ")))  # one of them stands, in lower case, wherever _AT_SIGN matches
_BEFORE_AT = re.compile(r"[\w.%+-]{1,64}\s?$")
_NUMBERED = re.compile(rf"\d[A-Za-z]? [{_U}]")
#: What a street's name ends in or begins with, so that most texts need not be searched for addresses.
_STREETS = ("", ("straße", "strasse", "str.", "gasse", "allee", "weg ", "platz", "damm", "ring "), ("rue ", "avenue", "chemin", "quai", "place ", "boulevard", "impasse", "allée", "cours "), ("calle", "c/", "avenida", "avda", "plaza", "paseo", "camino", "ronda"))
NUMBER = re.compile(
    r"(?=[\d(+A-Z](?:[^\d\n]{0,3}\d){5})(?<![\w@#:.,/+-])(?:(?:\+|\(\+?|00)?\d(?:[\d]|[ ().\-/]{1,2}(?=[\d(]))*\)?(?:[ \-./]{1,2}\d[\d \-/.]*\d)?|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]-?\d{7,8}(?:-?[A-Z])?)(?:(?<=\d{8})-?[A-Z])?(?![\w@]|[.,:/]\d|-\w)"
)
_TOWN = rf"{_CAP}(?:[- ]{_CAP})?"
_CODE = r"(?:\s+[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2}\b|,?\s+[A-Z]{2}\s\d{5}(?:-\d{4})?\b)"
_FLAT = r"(?:Flat|Apt|Unit|FLAT|APT|UNIT)\.?\s\d+[A-Za-z]?"
_PARTICLE = r"(?:(?:de\s(?:la|las|los)|del|des|du|de)\s|de\sl['’]|l['’]|d['’])?"
ADDRESSES = tuple(
    re.compile(p)
    for p in (
        rf"(?P<street>\b\d{{1,4}}[A-Za-z]?\s(?:{_CAP}\s){{1,3}}(?i:Street|St|Road|Rd|Lane|Ln|Close|Cl|Avenue|Ave|Drive|Square|Court)\b\.?(?:,\s+{_FLAT})?)(?P<town>{_SEP}{_CAP})?(?P<code>{_CODE})?",
        rf"(?P<street>\b[{_U}][{_U}{_L}]*(?:(?i:straße|strasse|str\.|gasse|allee|weg|platz|damm|ring))\s\d{{1,4}}(?: ?[a-zA-Z])?\b)(?:{_SEP}(?P<code>\d{{5}})\s(?P<town>{_TOWN}))?",
        rf"(?P<street>\b\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?i:rue|avenue|chemin|quai|place|boulevard|impasse|allée|cours)\s(?i:{_PARTICLE}){_CAP}(?:[- ]{_CAP})?)(?:{_SEP}(?P<code>\d{{5}})\s(?P<town>{_TOWN}))?",
        rf"(?P<street>\b(?i:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda)\s?(?i:{_PARTICLE}){_CAP}(?:[- ]{_CAP})?,?\s\d{{1,4}}(?:,\s\d{{1,2}}º\s?[{_U}])?)(?:{_SEP}(?P<code>\d{{5}})\s(?P<town>{_TOWN}))?",
    )
)
NAMES = re.compile(rf"(?<![\w@.+])(?:[{_U}]\.|{_CAP}(?:-{_CAP})*)(?:(?:,?\s)(?:[{_U}]\.(?!\w)|{_CAP}(?:-{_CAP})*))+(?![\w@])")
_PART = re.compile(rf"[{_U}]\.|{_CAP}(?:-{_CAP})*")
_WORD = re.compile(r"[^\W\d_]+")
#: Words before a number that tell what it is, in English, German, French and Spanish.
PHONE_CUES = ("tel", "tél", "téléphone", "teléfono", "phone", "call", "ring", "mobile", "telefon", "left", "rufnummer", "fax")
ID_CUES = ("ssn", "insurance", "social", "sociale", "steuernummer", "ausweis", "identidad", "dni", "tax", "passport", "identité", "nino", "nif")
TITLES = frozenset(("mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "herr", "frau", "hr", "fr", "monsieur", "madame", "mme", "mlle", "maître", "señor", "señora", "sr", "sra", "don", "doña", "ing", "dipl"))
OTHER_CUES = ("invoice", "ticket", "change", "build", "node", "window", "ratio", "port", "checksum", "dimensions", "version", "offset", "shelf")

_SENTENCE_END = re.compile(r"[.!?]\s")
_CUES = frozenset(PHONE_CUES + ID_CUES + OTHER_CUES)


class Span:
    __slots__ = ("start", "end", "kind", "form", "parts", "town", "code")

    def __init__(self, start: int, end: int, kind: str, form: str, parts: tuple = (), town: bool = False, code: bool = False):
        self.start, self.end, self.kind, self.form, self.parts, self.town, self.code = start, end, kind, form, parts, town, code


class Vocabulary:
    """A set of words; beyond `most` as sorted hashes of 64 bits, eight bytes a word."""

    def __init__(self, words: Iterable[str], most: int = 200_000):
        self.words: frozenset[str] = frozenset(w for w in words if w)
        self.hashes = None
        if len(self.words) > most:
            self.hashes = np.sort(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), dtype=np.uint64, count=len(self.words)))
            self.words = frozenset()

    def __contains__(self, word: str) -> bool:
        if self.hashes is None:
            return word in self.words
        h = np.uint64(xxhash.xxh3_64_intdigest(word))
        i = int(np.searchsorted(self.hashes, h))
        return i < len(self.hashes) and self.hashes[i] == h


class Known:
    """The vocabulary, in which proper names don't occur; and, only for fitting, names from the list of persons with the affixes they are made of."""

    def __init__(self, given: Iterable[str], family: Iterable[str], vocabulary: Iterable[str]):
        self.given, self.family = frozenset(x.lower() for x in given if x), frozenset(y for x in family if x for y in x.lower().split("-"))
        self.lexicon, self.vocabulary = frozenset(vocabulary), Vocabulary(())
        self.learn(())
        self.given_ends, self.given_begins = frozenset(x[-3:] for x in self.given), frozenset(x[:3] for x in self.given)
        self.family_ends, self.family_begins = frozenset(x[-3:] for x in self.family), frozenset(x[:3] for x in self.family)

    def learn(self, words: Iterable[str]) -> None:
        """Adds words to the vocabulary; names of the list of persons are never in it."""
        self.vocabulary = Vocabulary(w for w in self.lexicon.union(words) if w not in self.given and w not in self.family)

    def is_given(self, x: str) -> bool:
        return x in self.given or x[:3] in self.given_begins and x[-3:] in self.given_ends

    def is_family(self, x: str) -> bool:
        return all(y in self.family or y[:3] in self.family_begins and y[-3:] in self.family_ends for y in x.split("-"))

    def without_persons(self) -> Known:
        """What is needed to search texts."""
        out = Known((), (), ())
        out.vocabulary = self.vocabulary
        return out


def shape(text: str) -> str:
    """Lengths of the groups of digits, with what stands between them; letters as A."""
    return re.sub(r"\d+", lambda m: str(len(m[0])), re.sub(r"[^\W\d_]+", "A", text))


_FLAT_BEFORE = re.compile(rf"\b{_FLAT},\s+$")


def _numbered(text: str) -> Iterator[re.Match]:
    """Streets that follow their number."""
    for m in _NUMBERED.finditer(text):
        begin = m.start()
        while begin and text[begin - 1].isdigit():
            begin -= 1
        if found := ADDRESSES[0].match(text, begin):
            yield found


def candidates(text: str, known: Known) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    last = 0
    for sign in _AT_SIGN.finditer(text) if any(x in low for x in _AT_PARTS) else ():
        local = _BEFORE_AT.search(text, max(last, sign.start() - 65), sign.start())
        m = local and EMAIL.match(text, local.start()) or (local and EMAIL.search(text, local.start(), min(len(text), sign.end() + 256)))
        if m and m.start() <= sign.start() < m.end():
            s, last = m[0], m.end()
            out.append(Span(m.start(), m.end(), "email", "plain" if "@" in s and " " not in s else "bracket" if re.search(r"[\[({]", s) else "words"))
    for m in NUMBER.finditer(text):
        s = m[0]
        digits = sum(c.isdigit() for c in s)
        if not 6 <= digits <= 18 or "\n" in s:
            continue
        begin, end = m.span()
        while text[begin:end].count(")") > text[begin:end].count("(") and text[end - 1] == ")":
            end -= 1
        inner = text[begin + 1 : end - 1]
        if text[begin] == "(" and text[end - 1] == ")" and inner.count("(") == inner.count(")") and inner.find("(") <= inner.find(")"):
            begin, end = begin + 1, end - 1
        alternatives = [(begin, end)]
        if s[0] in "123456789" and (g := re.match(r"\d{1,3} (?=[+(0-9])", s)):
            alternatives.append((begin + g.end(), end))  # a number of its own before it
        for a, b in alternatives:
            if sum(c.isdigit() for c in text[a:b]) >= 6:
                f = shape(text[a:b])
                out += [Span(a, b, "phone", f), Span(a, b, "id_number", f)]
    for n, rx in enumerate(ADDRESSES):
        if n == 0:
            found = _numbered(text)
        else:
            found = rx.finditer(text) if any(x in low for x in _STREETS[n]) else ()
        for m in found:
            g = m.groupdict()
            begins = [m.start()]
            if n == 0 and (flat := _FLAT_BEFORE.search(text, max(0, m.start() - 14), m.start())):
                begins.insert(0, flat.start())
            for k, begin in enumerate(begins):
                form = f"{n}{' flat' if k < len(begins) - 1 else ''}"
                if g["town"]:
                    if n == 0:
                        out.append(Span(begin, m.end("town"), "address", f"{form} town", (g["town"].strip(" ,\n"),), True))
                    if n or g["code"]:
                        out.append(Span(begin, m.end(), "address", f"{form} code", (g["town"].strip(" ,\n"),), True, True))
                else:
                    out.append(Span(begin, m.end("street"), "address", f"{form} street"))
    for m in NAMES.finditer(text):
        parts = [p for p in _PART.finditer(text, m.start(), m.end())]
        ok = [len(p[0]) == 2 and p[0][1] == "." or not any(x in known.vocabulary for x in p[0].lower().split("-")) for p in parts]
        for i in range(len(parts)):
            if not ok[i]:
                continue
            for j in range(i + 1, min(i + NAME_PARTS, len(parts))):
                if not ok[j]:
                    break
                span = parts[i : j + 1]
                between = [text[a.end() : b.start()] for a, b in zip(span, span[1:], strict=False)]
                form = "".join(("I" if p[0][1] == "." else "W") + ("," if "," in s else "/" if "\n" in s else " ") for p, s in zip(span, [*between, ""], strict=True)).strip()
                if "W" in form and form.count(",") <= 1 and form.count("/") <= 1:
                    out.append(Span(span[0].start(), span[-1].end(), "name", form, tuple(p[0].lower() for p in span)))
    return out


def _context(text: str, s: Span) -> tuple[list[str], str]:
    before = _WORD.findall(text[max(0, s.start - 48) : s.start].lower())[-4:]
    after = _WORD.findall(text[s.end : s.end + 24].lower())[:1]
    return before, after[0] if after else ""


def described(text: str, s: Span, known: Known) -> tuple[list[str], list[str]]:
    """Features of the whole span, and those of the words around it."""
    before, after = _context(text, s)
    k = s.kind
    left, right = text[s.start - 1 : s.start], text[s.end : s.end + 1]
    f = [f"{k} form={s.form}", k]
    around = [f"{k} before={x}" for x in before[-1:]] + [f"{k} after={after}"]
    around += [f"{k} cue={c}" for c, cues in (("phone", PHONE_CUES), ("id", ID_CUES), ("other", OTHER_CUES)) if any(x in cues for x in before)]
    if k in ("phone", "id_number"):
        t = text[s.start : s.end]
        f += [f"{k} digits={sum(c.isdigit() for c in t)}", f"{k} begins={t[:2] if t[0] in '+(0' else 'A' if t[0].isalpha() else '9'}", f"{k} spaced={' ' in t}{'-' in t}{'.' in t}{'/' in t}"]
        cue = next(("phone" if x in PHONE_CUES else "id" if x in ID_CUES else "other" for x in reversed(before) if x in _CUES), "none")
        around += [f"{k} nearest cue={cue}", f"{k} nearest cue={cue} form={s.form}"]
        f.append(f"{k} inside={left.isalnum() or left in '-/.' and left != ''},{right in '-/' and right != ''}")
    elif k == "address":
        f += [f"address town={s.town} code={s.code}", f"address capital={'upper' if text[s.start:s.end].isupper() else 'title'}"]
        if s.town and s.parts:
            around.append(f"address town known={s.parts[0].lower() in known.vocabulary}")
    elif k == "name":
        t = text[s.start : s.end]
        w = [p for p in s.parts if not p.endswith(".")]
        f += [f"name words={len(w)}", f"name title={any(p.rstrip('.') in TITLES for p in s.parts)}", f"name short={min(map(len, w)) < 4}", f"name apostrophe={any(c in t for c in chr(39) + '’')}"]
        capitals = [x for x in _WORD.findall(t) if len(x) > 1 and x.isupper()]
        f.append(f"name capitals={'all' if len(capitals) == len(w) else 'last' if capitals and t.rstrip().endswith(capitals[-1]) else 'first' if capitals else 'none'}")
        if before[-1:] and before[-1] in TITLES:
            around.append("name after title")
    return f, around


def features(text: str, s: Span, known: Known, hide: bool = False) -> list[str]:
    """Features of the whole span. hide: without the words around it."""
    own, around = described(text, s, known)
    return own if hide else own + around


def between(text: str, a: Span | None, b: Span) -> list[str]:
    if a is None:
        return []
    gap = b.start - a.end
    return [pair(a.kind, b.kind, "near" if gap <= 3 else "close" if gap <= CLOSE else "far")]


def pair(a: str, b: str, gap: str) -> str:
    return f"{a}>{b} {gap}"


class Weights(dict):
    def score(self, feats: list[str]) -> float:
        get = self.get
        return sum([get(x, 0.0) for x in feats])


def best_segmentation(text: str, spans: list[Span], feats: list[list[str]], w: Weights) -> list[int]:
    """Positions of the spans that form the highest-scoring segmentation; text outside of entities scores 0.

    Exact: of the entities that end more than CLOSE characters before a span only the kind matters, so the best of each kind is enough; nearer ones are all tried.
    """
    order = sorted(range(len(spans)), key=lambda i: (spans[i].end, spans[i].start))
    ends = [spans[i].end for i in order]
    own, prev = [0.0] * len(order), [-1] * len(order)
    best_of: dict[str, list[int]] = {k: [] for k in KINDS}  # by kind: the best candidate among the first n, or -1
    far_of: dict[str, list[tuple[str, float]]] = {}
    for n, i in enumerate(order):
        s = spans[i]
        far, m = bisect_right(ends, s.start - CLOSE - 1, 0, n), bisect_right(ends, s.start, 0, n)
        top, at = 0.0, -1
        if far:
            if s.kind not in far_of:
                far_of[s.kind] = [(j, w.get(pair(j, s.kind, "far"), 0.0)) for j in KINDS]
            for k, weight in far_of[s.kind]:
                p = best_of[k][far - 1]
                if p >= 0 and own[p] + weight > top:
                    top, at = own[p] + weight, p
        for p in range(far, m):
            v = own[p] + w.score(between(text, spans[order[p]], s))
            if v > top:
                top, at = v, p
        own[n], prev[n] = w.score(feats[i]) + top, at
        for k, best in best_of.items():
            last = best[-1] if best else -1
            best.append(n if k == s.kind and (last < 0 or own[n] > own[last]) else last)
    n = max(range(len(order)), key=own.__getitem__, default=-1)
    n = n if n >= 0 and own[n] > 0 else -1
    out = []
    while n >= 0:
        out.append(order[n])
        n = prev[n]
    return out[::-1]


def evidence(text: str, s: Span, known: Known) -> str:
    """Whether the list of persons with the affixes of its names, or its form, gives a span away ("yes"); of a number, what the nearest cue word says. Only for fitting."""
    if s.kind in ("phone", "id_number"):
        before, _ = _context(text, s)
        cue = next((x for x in reversed(before) if x in _CUES), "")
        if cue and cue not in PHONE_CUES and cue not in ID_CUES:  # it speaks of the numbers of its own sentence alone
            left = text[max(0, s.start - 48) : s.start].lower()
            return "" if _SENTENCE_END.search(left, left.rfind(cue)) else "other"
        return "phone" if cue in PHONE_CUES else "id_number" if cue in ID_CUES else ""
    ok = s.kind == "email" or s.kind == "address" and s.town
    if s.kind == "name":
        w = [p for p in s.parts if not p.endswith(".")]
        g, fam = ((w[-1], w[0]) if "," in s.form else (w[0], w[-1])) if len(w) > 1 else (None, w[0])
        fam_ok = known.is_family(fam) and "/" not in s.form
        ok = fam_ok and (known.is_given(g) if g is not None else s.form in ("I W", "W, I", "I I W")) and len(w) <= 2
    return "yes" if ok else ""


def evident(spans: list[Span], told: list[str], shapes: dict[str, str]) -> list[int]:
    """Positions of the spans that their evidence and, of numbers, what most numbers of the shape are, give away; only for fitting."""
    said = []
    for i, (s, e) in enumerate(zip(spans, told, strict=True)):
        if s.kind in ("phone", "id_number"):
            shape = shapes.get(s.form)
            ok = ("" if e == "other" else e or shape) == s.kind and shape in ("phone", "id_number")
        else:
            ok = e == "yes"
        if ok:
            said.append(i)
    said.sort(key=lambda i: (spans[i].start - spans[i].end, i))  # the longest first
    out: list[int] = []
    for i in said:
        if all(spans[i].end <= spans[j].start or spans[j].end <= spans[i].start for j in out):
            out.append(i)
    return sorted(out, key=lambda i: spans[i].start)


def word_counts(texts: Iterable[str]) -> Counter:
    """How often each word stands, email addresses aside."""
    tokens: Counter = Counter()
    for t in texts:
        low = t.lower()
        tokens.update((EMAIL.sub(" ", t) if any(x in low for x in _AT_PARTS) and _AT_SIGN.search(t) else t).split())
    out: Counter = Counter()
    for t, n in tokens.items():
        for w in _WORD.findall(t):
            out[w] += n
    return out


def common_words(texts: list[str]) -> set[str]:
    """Words that the texts have more often in lower case than with a capital, email addresses aside: no names, whatever the vocabulary lacks."""
    more: Counter = Counter()
    for w, n in word_counts(texts).items():
        more[w.lower()] += n if w.islower() else -n
    return {w for w, n in more.items() if n > 0}


def number_shapes(votes: dict[tuple[str, str], int]) -> dict[str, str]:
    """What a number of each shape is, by what the nearest cue words before numbers of that shape say, and how often."""
    best: dict[str, tuple[int, str]] = {}
    for (form, kind), n in sorted(votes.items()):
        if kind and n > best.get(form, (0, ""))[0]:
            best[form] = n, kind
    return {form: kind for form, (_, kind) in best.items()}


class Example(NamedTuple):
    """A text's candidates as fitting and searching need them. around: features of the words around; hidden: whether fitting does without those."""

    spans: list[Span]
    own: list[list[str]]
    around: list[list[str]]
    told: list[str]
    hidden: list[bool]


def example(text: str, known: Known) -> Example:
    spans = candidates(text, known)
    parts = [described(text, s, known) for s in spans]
    hidden = [xxhash.xxh32_intdigest(f"{s.start}{s.end}{text[s.start:s.end]}") % 2 == 0 for s in spans]
    return Example(spans, [x for x, _ in parts], [y for _, y in parts], [evidence(text, s, known) for s in spans], hidden)


def fit(texts: list[str], known: Known, rounds: int = 10) -> Weights:
    """The weights of texts at hand; the texts' common words are added to known's vocabulary."""
    known.learn(common_words([x for x in texts if x]))
    docs = [e for t in texts if t and (e := example(t, known)).spans]
    return perceptron(docs, number_shapes(Counter((s.form, t) for e in docs for s, t in zip(e.spans, e.told, strict=True) if s.kind == "phone")), rounds)


def perceptron(docs: Iterable[Example], shapes: dict[str, str], rounds: int = 10) -> Weights:
    data = [(e.spans, [x if h else x + y for x, y, h in zip(e.own, e.around, e.hidden, strict=True)], evident(e.spans, e.told, shapes)) for e in docs]
    w, total, step = Weights(), Counter(), 1
    for n in range(rounds):
        wrong = False
        for spans, feats, gold in data:
            said = best_segmentation("", spans, feats, w)
            if said != gold:
                wrong = True
                for path, d in ((gold, 1.0), (said, -1.0)):
                    before = None
                    for i in path:
                        for x in (*feats[i], *between("", before, spans[i])):
                            w[x] = w.get(x, 0.0) + d
                            total[x] += step * d
                        before = spans[i]
            step += 1
        if not wrong:  # nor will it change in the rounds that are left
            step += len(data) * (rounds - 1 - n)
            break
    return Weights({k: v - total[k] / step for k, v in w.items() if v or total[k]})


def entities(text: str | None, known: Known, w: Weights) -> list[Span]:
    if not text:
        return []
    spans = candidates(text, known)
    return [spans[i] for i in best_segmentation(text, spans, [features(text, s, known) for s in spans], w)] if spans else []


def redacted(text: str, found: list[Span]) -> str:
    """text with each entity replaced by its type in brackets, all else as it was."""
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


class Model(NamedTuple):
    """What a search needs: the vocabulary and the weights. To be fitted once and passed to many calls."""

    known: Known
    weights: Weights


_UNIT = "\x1f"  # stands in no feature
_SPANNED = "starts array<int>, ends array<int>, kinds array<int>, own array<string>, around array<string>, told array<string>, hidden array<boolean>"
_PART_OF_ONE = 1 << 24  # weights are summed as whole numbers of this part, in any order the same


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = word_counts(b.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.lower() for w in counts], pa.string()), "n": pa.array([n if w.islower() else -n for w, n in counts.items()], pa.int64())})


def _spanned(docs: DataFrame, known: Known) -> DataFrame:
    """Every document with its candidates, kept for fitting and for searching."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for t in b.column(1).to_pylist():
                e = example(t, known) if t else Example([], [], [], [], [])
                for c, x in zip(cols, ([s.start for s in e.spans], [s.end for s in e.spans], [KINDS.index(s.kind) for s in e.spans], [_UNIT.join(x) for x in e.own], [_UNIT.join(x) for x in e.around], e.told, e.hidden), strict=True):
                    c.append(x)
            kinds = [pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "text", *(c.split()[0] for c in _SPANNED.split(", "))])

    return table(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, text string, {_SPANNED}"), "spans")


def _example(starts: list, ends: list, kinds: list, own: list, around: list, told: list, hidden: list) -> Example:
    spans = [Span(a, b, KINDS[k], x.split(_UNIT, 1)[0].partition(" form=")[2]) for a, b, k, x in zip(starts, ends, kinds, own, strict=True)]
    return Example(spans, [x.split(_UNIT) for x in own], [x.split(_UNIT) for x in around], told, hidden)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark, phone = "phone form=", KINDS.index("phone")
    for b in batches:
        kinds, own, told = (b.column(i).flatten().to_pylist() for i in range(3))
        votes = Counter((x.split(_UNIT, 1)[0][len(mark) :], e) for k, x, e in zip(kinds, own, told, strict=True) if k == phone and e)
        yield pa.RecordBatch.from_pydict({"form": pa.array([f for f, _ in votes], pa.string()), "kind": pa.array([k for _, k in votes], pa.string()), "n": pa.array(votes.values(), pa.int64())})


def _weights(spanned: DataFrame) -> Weights:
    votes = spanned.select("kinds", "own", "told").mapInArrow(_votes, "form string, kind string, n bigint").groupBy("form", "kind").agg(F.sum("n")).collect()
    shapes = number_shapes({(form, kind): n for form, kind, n in votes})
    some = spanned.where("size(starts) > 0")
    shards = max(1, -(-some.count() // SHARD_DOCS))
    shared = spanned.sparkSession.sparkContext.broadcast(shapes)

    def run(share: pa.Table) -> pa.Table:
        rows = sorted(zip(*(share.column(c).to_pylist() for c in share.column_names[1:]), strict=True), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1:6]))
        w = perceptron([_example(*r[1:]) for r in rows], shared.value)
        return pa.table({"feature": pa.array(list(w), pa.string()), "w": pa.array([round(v * _PART_OF_ONE) for v in w.values()], pa.int64())})

    shard = F.pmod(F.xxhash64("doc_id", "starts", "own"), F.lit(shards)).alias("shard")
    parts = some.select(shard, "doc_id", *(c.split()[0] for c in _SPANNED.split(", "))).repartition(2 * shards, "shard").groupBy("shard").applyInArrow(run, "feature string, w bigint")
    return Weights({x: n / shards / _PART_OF_ONE for x, n in parts.groupBy("feature").agg(F.sum("w")).orderBy("feature").collect()})


def _fitted(docs: DataFrame, directory: DataFrame, lexicon: DataFrame, most_words: int = 5_000_000) -> tuple[Model, DataFrame]:
    """The model of all documents and the whole list of persons, and the documents with their candidates."""
    given, family = ([r[0] for r in directory.select(c).where(f"{c} IS NOT NULL").distinct().collect()] for c in ("given_name", "family_name"))
    words = [r[0] for r in lexicon.select(F.lower("word")).where("word IS NOT NULL").distinct().limit(most_words + 1).collect()]
    if len(words) > most_words:
        raise ValueError(f"every worker holds the lexicon: at most {most_words} words")
    known = Known(given, family, words)
    common = docs.select("text").where("text IS NOT NULL").mapInArrow(_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    known.learn(r[0] for r in common.select("word").toLocalIterator())
    known.lexicon = frozenset()  # the vocabulary has it now; workers need it once
    spanned = _spanned(docs, known)
    return Model(known.without_persons(), _weights(spanned)), spanned


def fit_model(docs: DataFrame, directory: DataFrame, lexicon: DataFrame, most_words: int = 5_000_000) -> Model:
    """A model from all documents and persons; the lexicon, with the documents' common words, goes to every worker: of the lexicon at most most_words words."""
    return _fitted(docs, directory, lexicon, most_words)[0]


def _run(docs: DataFrame, directory: DataFrame, lexicon: DataFrame, model: Model | None, schema: str, rows_of) -> DataFrame:
    spanned = None
    if model is None:
        model, spanned = _fitted(docs, directory, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        for b in batches:
            out = []
            for i, t, *kept in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(i, *x) for x in rows_of(t, chosen(*kept, w) if kept else entities(t, known, w))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), pa.schema([(n, pa.int64() if n == "doc_id" else pa.int32() if n in ("start", "end") else pa.string()) for n in names]), preserve_index=False)

    columns = ["doc_id", "text", *(["starts", "ends", "kinds", "own", "around"] if spanned is not None else [])]
    return (docs if spanned is None else spanned).select(*columns).where("doc_id IS NOT NULL").mapInArrow(run, schema)


def chosen(starts: list, ends: list, kinds: list, own: list, around: list, w: Weights) -> list[Span]:
    """entities() of candidates that were kept."""
    if not starts:
        return []
    spans = [Span(a, b, KINDS[k], "") for a, b, k in zip(starts, ends, kinds, strict=True)]
    return [spans[i] for i in best_segmentation("", spans, [x.split(_UNIT) + y.split(_UNIT) for x, y in zip(own, around, strict=True)], w)]


def found_pii(docs: DataFrame, directory: DataFrame, lexicon: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, kind, found, start, end): every piece of personal information as it stands in the text, with its place in code points.

    Null and empty texts give nothing; a row of documents that is repeated gives its pieces again. Without a model one is fitted on the documents themselves.
    """
    return _run(docs, directory, lexicon, model, "doc_id bigint, kind string, found string, start int, end int", lambda t, e: [(s.kind, t[s.start : s.end], s.start, s.end) for s in e])


def redact(docs: DataFrame, directory: DataFrame, lexicon: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, text) with typed placeholders in place of personal information; a null text stays null."""
    return _run(docs, directory, lexicon, model, "doc_id bigint, text string", lambda t, e: [(None if t is None else redacted(t, e),)])
