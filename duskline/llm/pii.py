"""Personal data by fixed patterns and a semi-Markov conditional random field over whole spans."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textkit import map_texts

KINDS = ("email", "ip", "card", "phone")
# fixed patterns of the base, as they were asked for
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts at the first of its digits and takes all of a run; said so, the search is linear in runs of digits
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Longest span in tokens, passes and step of training.
MOST_TOKENS, PASSES, STEP = 6, 25, 0.5
#: Labels of segments: outside of all spans, then the kinds.
LABELS = ("out", *KINDS)
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
CUE = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]|\b(?:AT|DOT)\b")
HEAD, TAIL = re.compile(r"[A-Za-z0-9+(\[]"), re.compile(r"[A-Za-z0-9](?=[^A-Za-z0-9]*$)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, in linear time: from each @ back to the last match."""
    out, last = [], 0
    ok = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    for m in DOMAIN.finditer(text):
        i = m.start()
        while i > last and text[i - 1] in ok:
            i -= 1
        if i < m.start():
            out.append((i, m.end()))
            last = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base: (kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# ---- the random field -------------------------------------------------------------------------------


def _features(span: str, n_tokens: int, before: str) -> list[str]:
    """Features of a whole candidate span; all are properties of the span, none of single tokens."""
    digits = re.sub("[^0-9]", "", span)
    groups = tuple(map(len, re.findall("[0-9]+", span)))
    n, letters = len(digits), sum(c.isalpha() for c in span)
    parts = span.split(".")
    low = span.lower()
    out = ["bias", f"tokens={n_tokens}", f"letters={min(letters, 3)}"]
    out.append("digits=" + ("0" if not n else "1-6" if n < 7 else "7-9" if n < 10 else "10-11" if n < 12 else "12-15" if n < 16 else "16-19" if n < 20 else "20+"))
    if n and not letters:
        out.append("groups=" + ("-".join(map(str, groups)) if len(groups) <= 5 and max(groups) <= 6 else "other"))
        out.append("luhn" if 16 <= n <= 19 and luhn(digits) else "no-luhn")
        out.append("plus" if span[0] == "+" else "paren" if "(" in span else "plain")
    if len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts):
        out.append("quad" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "bad-quad")
    if re.fullmatch(r"[a-z0-9._%+-]+ ?[\[(]at[\])] ?[a-z0-9-]+(?: ?(?:[\[(]dot[\])]|\.) ?[a-z0-9-]+)+", low) or re.fullmatch(r"[A-Za-z0-9._%+-]+ AT [A-Za-z0-9-]+(?: DOT [A-Za-z0-9-]+)+", span):
        out.append("spelled-mail")
    if re.fullmatch(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", low):
        out.append("mail")
    if before in ("tel", "phone", "call", "mobile", "fax", "card", "visa", "mail", "ip", "host"):
        out.append(f"cue={before}")
    return out


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the punctuation around it."""
    head = HEAD.search(text, start, end)
    tail = TAIL.search(text[start:end])
    return (head.start(), start + tail.end()) if head and tail and start + tail.end() > head.start() else (start, end)


def _add(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    """Logarithm of a sum of exponentials."""
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Field:
    """Segments of one token outside entities, or of 1 to MOST_TOKENS tokens of one kind; a weight for each
    (kind, feature) of a span and each ("pair", labels) of neighbouring segments, the start counting as outside."""

    def __init__(self, weights: dict[tuple, float]):
        self.weights = weights

    def candidates(self, text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
        out = {}
        for i in range(len(tokens)):
            before = re.sub(r"[^a-z]", "", text[slice(*tokens[i - 1])].lower()) if i else ""
            for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
                if "\n" in text[tokens[i][0] : tokens[j - 1][1]]:
                    break
                s, e = _core(text, tokens[i][0], tokens[j - 1][1])
                if e - s > 80:
                    break
                span = text[s:e]
                if CUE.search(span):
                    out[i, j] = _features(span, j - i, before)
        return out

    def score(self, kind: str, features: list[str]) -> float:
        return sum(self.weights.get((kind, f), 0.0) for f in features)

    def pairs(self) -> np.ndarray:
        """Weights of label pairs, the former label by row."""
        return np.array([[self.weights.get(("pair", (a, b)), 0.0) for b in LABELS] for a in LABELS])

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The best segmentation by score and label pairs: entity lengths are bounded, so the program is linear in tokens."""
        ends: dict[int, list] = {}
        for (i, j), f in self.candidates(text, tokens).items():
            ends.setdefault(j, []).extend((i, k, self.score(kind, f)) for k, kind in enumerate(KINDS, 1))
        if not ends:
            return []
        pair = self.pairs().tolist()
        none, every = float("-inf"), range(len(LABELS))
        best, back = [[0.0, *[none] * len(KINDS)]], [None]
        # step[i][l]: the best way to i on which a segment of label l follows, and its last label
        step = []
        for j in range(1, len(tokens) + 1):
            last = best[j - 1]
            step.append([max((last[a] + pair[a][b], a) for a in every) for b in every])
            now, way = [none] * len(LABELS), [None] * len(LABELS)
            now[0], way[0] = step[j - 1][0][0], (j - 1, step[j - 1][0][1])
            for i, k, s in ends.get(j, ()):
                if step[i][k][0] + s > now[k]:
                    now[k], way[k] = step[i][k][0] + s, (i, step[i][k][1])
            best.append(now)
            back.append(way)
        out, j = [], len(tokens)
        label = max(every, key=lambda a: best[j][a])
        while j:
            i, former = back[j][label]
            if label:
                out.append((LABELS[label], *_core(text, tokens[i][0], tokens[j - 1][1])))
            j, label = i, former
        return out[::-1]

    def gradient(self, text: str, tokens: list[tuple[int, int]], gold: dict[tuple[int, int], str]) -> tuple[float, dict]:
        """Log-likelihood of the gold segmentation and its gradient, by forward and backward sums over segments."""
        n, pair = len(tokens), self.pairs()
        arcs = [(i, j, k, f, self.score(KINDS[k - 1], f)) for (i, j), f in self.candidates(text, tokens).items() for k in range(1, len(LABELS))]
        into: dict[int, list] = {}
        out_of: dict[int, list] = {}
        for a in arcs:
            into.setdefault(a[1], []).append(a)
            out_of.setdefault(a[0], []).append(a)
        fwd, step = np.full((n + 1, len(LABELS)), -np.inf), np.zeros((n, len(LABELS)))
        bwd, start = np.zeros((n + 1, len(LABELS))), np.full((n, len(LABELS)), -np.inf)
        fwd[0, 0] = 0
        for j in range(1, n + 1):
            step[j - 1] = _add(fwd[j - 1][:, None] + pair, 0)
            fwd[j, 0] = step[j - 1, 0]
            for i, _, k, _, s in into.get(j, ()):
                fwd[j, k] = np.logaddexp(fwd[j, k], step[i, k] + s)
        for i in range(n - 1, -1, -1):
            start[i, 0] = bwd[i + 1, 0]
            for _, j, k, _, s in out_of.get(i, ()):
                start[i, k] = np.logaddexp(start[i, k], s + bwd[j, k])
            bwd[i] = _add(pair + start[i], 1)
        total = float(_add(fwd[n]))
        grad: dict[tuple, float] = {}
        like = -total
        for i, j, k, f, s in arcs:
            hit = gold.get((i, j)) == LABELS[k]
            like += s * hit
            g = hit - float(np.exp(step[i, k] + s + bwd[j, k] - total))
            for x in f:
                grad[LABELS[k], x] = grad.get((LABELS[k], x), 0.0) + g
        met, at, former = np.zeros_like(pair), 0, 0
        begins = {i: (j, LABELS.index(k)) for (i, j), k in gold.items()}
        while at < n:
            at, label = begins.get(at, (at + 1, 0))
            met[former, label] += 1
            former = label
        like += float((met * pair).sum())
        for i in range(n):
            met -= np.exp(fwd[i][:, None] + pair + start[i] - total)
        for a, la in enumerate(LABELS):
            for b, lb in enumerate(LABELS):
                grad["pair", (la, lb)] = float(met[a, b])
        return like, grad


def _examples(n: int, seed: int) -> list[tuple[str, list[tuple[str, str]]]]:
    """Invented sentences with the spans they hold: none is taken from the corpus."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))

    def card(sep: str, good: bool = True) -> str:
        d = "4" + num(15)
        while luhn(d) != good:
            d = "4" + num(15)
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    words = ["la", "of", "the", "und", "que", "note", "order", "page", "in", "version", "item", "from"]
    made = {
        "phone": [lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+{num(2)} {num(3)} {num(4)} {num(4)}"],
        "card": [lambda: card(""), lambda: card(" "), lambda: card("-"), lambda: card(".")],
        "ip": [lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))],
        "email": [lambda: f"{pick(words)}{num(2)}@{pick(words)}.com", lambda: f"{pick(words)}.{pick(words)} [at] {pick(words)} [dot] org", lambda: f"{pick(words)}{num(1)} (at) {pick(words)} (dot) com", lambda: f"{pick(words)} AT {pick(words)} DOT net"],
    }
    other = [lambda: num(int(rng.integers(1, 7))), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(1)}.{num(1)}", lambda: num(8), lambda: card("", False), lambda: f"{num(4)}.{num(3)}.{num(2)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: num(24), lambda: f"{num(3)},{num(3)}", lambda: f"a{num(3)}b{num(4)}", lambda: f"{num(5)} {num(5)} {num(6)}"]
    out = []
    for _ in range(n):
        parts, gold = [], []
        for _ in range(rng.integers(1, 4)):
            parts += [pick(words) for _ in range(rng.integers(1, 4))]
            if rng.random() < 0.6:
                kind = pick(KINDS)
                parts.append(span := pick(made[kind])())
                gold.append((kind, span))
            else:
                parts.append(pick(other)())
        out.append((" ".join([*parts, pick(words)]) + pick(["", ".", ","]), gold))
    return out


@lru_cache(maxsize=1)
def trained(n: int = 240, seed: int = 3) -> Field:
    """Fits the field by stochastic gradient ascent with a small pull to zero; the same on every call."""
    field, data = Field({}), []
    for text, spans in _examples(n, seed):
        tokens, gold, at = [m.span() for m in TOKEN.finditer(text)], {}, 0
        for kind, span in spans:
            s = text.index(span, at)
            at = s + len(span)
            inside = [i for i, (a, b) in enumerate(tokens) if a < at and b > s]
            gold[inside[0], inside[-1] + 1] = kind
        data.append((text, tokens, gold))
    for p in range(PASSES):
        for text, tokens, gold in data:
            _, grad = field.gradient(text, tokens, gold)
            for k, g in grad.items():
                field.weights[k] = field.weights.get(k, 0.0) * (1 - 1e-4) + STEP / (1 + 0.2 * p) * g
    return field


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens around cues, as many on either side as a span with the cue may have; all others are outside in every
    segmentation."""
    hits = sorted({m.start() for m in CUE.finditer(text)})
    if not hits:
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    starts = np.array([t[0] for t in tokens])
    near = np.unique(np.searchsorted(starts, np.array(hits), side="right") - 1)
    out: list[list[int]] = []
    for i in near.tolist():
        lo, hi = max(0, i - MOST_TOKENS + 1), min(len(tokens), i + MOST_TOKENS)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [tokens[a:b] for a, b in out]


def all_spans(text: str, field: Field, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and the field's that touch none of them, by kind as listed, then start."""
    taken = sorted((s, e) for _, s, e in base)
    added, i = [], 0
    for region in regions(text):
        for k, s, e in field.decode(text, region):
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            if not any(a < e and s < b for a, b in taken[max(0, i - 3) : i + 6]):
                added.append((k, s, e))
    return sorted([*base, *added], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first one names the whole."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with n_email, n_ip, n_card, n_phone, base_sha256, spans, masked_text for each row of docs (doc_id, text).

    Counts and digest are of the base patterns; spans has theirs and the field's. masked_text is the text
    with every span replaced by its kind, null for a null text, which else counts as empty. Texts of any length are searched whole, in
    time that grows with them; runs of digits of any length too. Of spans that start together the longest is masked. Repeated rows
    give repeated rows; an empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = [*[f.name for f in fields], "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked_text"]
    empty = hashlib.sha256(b"").hexdigest()

    def work(t: pa.Table) -> pa.Table:
        text = t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string())
        may = pc.match_substring_regex(text, r"[0-9@]|[\[(](at|dot)[\])]|\bAT\b").fill_null(False).to_numpy(zero_copy_only=False)
        n = len(text)
        counts, digest, shown = np.zeros((4, n), np.int64), [empty] * n, [""] * n
        at = np.flatnonzero(may)
        changed = {}
        for i in at.tolist():
            s = text[i].as_py()
            base = base_spans(s)
            for k, _, _ in base:
                counts[KINDS.index(k), i] += 1
            digest[i] = hashlib.sha256(_listed(base).encode()).hexdigest()
            spans = all_spans(s, shared.value, base)
            shown[i] = _listed(spans)
            if spans:
                changed[i] = masked(s, spans)
        mask = np.zeros(n, bool)
        mask[list(changed)] = True
        out = pc.replace_with_mask(text, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], text.type)) if changed else text
        return pa.table([*[t.column(f.name) for f in fields], *[pa.array(c) for c in counts], pa.array(digest, pa.string()), pa.array(shown, pa.string()), out], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_texts(docs.select(*[f.name for f in fields if f.name != "text"], "text"), work, f"{schema}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked_text string")
