"""Personal data by a semi-Markov conditional random field on top of fixed base patterns.

Base spans (email, ip, card, phone) come from the four patterns below and always stay. Looser patterns propose further
candidate segments, each in several boundary variants; the model scores every (segment, type) arc on features of the
whole span and dynamic programming picks the best non-overlapping set, boundaries and types together. Segments are
bounded by ``MAX_SPAN`` code points. Text without a candidate is one run of "outside" with score 0, so decoding the
neighbourhood of candidates is decoding the whole text.

The weights are fitted by maximum likelihood (forward-backward over the segment lattice) on sentences generated from
rules, so nothing of the corpus is needed and every run has the same model.

Defined cases: a null or empty text has no spans; rows with a null id are kept; repeated rows are treated alike; the
text is used whole however long; extra columns pass through :func:`redact` untouched.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .storage import folded, small_batches, unfolded
from .text import strings

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "secret")
ORDER = {k: i for i, k in enumerate(LABELS)}
MAX_SPAN = 200

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails at its first digit fails at every later one too, so starts inside a run are skipped
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: all starts of one run of local characters lead to the same ``@``, so each ``@`` is tried once
    with the longest run before it that no earlier match holds."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in code points, by start and then kind."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]], s[1]))


# Looser proposals; each is linear in the text.
_SECRET = re.compile(r"(?i:password|passwd|secret|token|api[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9+/_=-]{8,200})[\"']?")
_KEYLIKE = re.compile(r"\b(?:AKIA[0-9A-Z]{12,20}|gh[pousr]_[A-Za-z0-9]{20,60}|sk-[A-Za-z0-9]{16,60})\b")
_LOCALPHONE = re.compile(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_KEYWORDS = ("passw", "secret", "token", "api")
_PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
_MASKEDMAIL = re.compile(r"[A-Za-z0-9._-]{1,40} ?[\[(]? ?(?:at|AT) ?[\])]? ?[A-Za-z0-9-]{1,40}(?: ?[\[(]? ?(?:dot|DOT) ?[\])]? ?[A-Za-z]{2,12}){1,3}")
_CONTEXT_PHONE = re.compile(r"(?i:phone|call|tel|mobile|fon|fax)[^\n]{0,12}$")
_CONTEXT_MAIL = re.compile(r"(?i:mail|contact|write|reach)[^\n]{0,16}$")
_CONTEXT_KEY = re.compile(r"(?i:password|passwd|secret|token|key)[\"']?\s{0,2}[=:]?\s{0,2}[\"']?$")


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Segments in every boundary variant that touch no base span."""
    found: set[tuple[int, int]] = set()
    low = text.lower()
    if len(low) != len(text) or any(k in low for k in _KEYWORDS):
        for m in _SECRET.finditer(text):
            found |= {m.span(), m.span(1)}
    if any(k in text for k in _PREFIXES):
        found |= {m.span() for m in _KEYLIKE.finditer(text)}
    for m in _LOCALPHONE.finditer(text):
        a, b = m.span()
        if a and text[a - 1] == "(":
            found |= {(a - 1, b), (a, b)}
        elif not a or not (text[a - 1].isalnum() or text[a - 1] == "+"):
            found.add((a, b))
    if "dot" in text or "DOT" in text:
        found |= {m.span() for m in _MASKEDMAIL.finditer(text)}
    if not found:
        return []
    starts = sorted(a for a, _, _ in taken)
    reach = list(accumulate((b for _, b, _ in sorted(taken)), max))  # the furthest end of the spans up to each
    free = lambda a, b: (k := bisect_left(starts, b)) == 0 or reach[k - 1] <= a
    return sorted((a, b) for a, b in found if b - a <= MAX_SPAN and free(a, b))


def span_features(text: str, a: int, b: int) -> list[str]:
    """Of the whole segment and of what stands around it."""
    s, left = text[a:b], text[max(0, a - 24) : a]
    n, digits = b - a, sum("0" <= c <= "9" for c in text[a:b])
    out = ["bias", f"len{min(n // 6, 8)}", f"digits{min(digits, 12)}", f"share{int(4 * digits / n)}", f"dots{min(s.count('.'), 4)}"]
    out.append("spaced" if " " in s else "solid")
    if re.fullmatch(r"[0-9a-fA-F]+", s) and 0 < digits < n:
        out.append("hex")
    if re.search(r"[\[( ](?:at|AT)[\]) ]", s) and re.search(r"[\[( ](?:dot|DOT)[\]) ]", s):
        out.append("masked")
        if "[" in s or "(" in s:
            out.append("bracketed")
    if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s):
        out.append("ten")
    if re.match(r"AKIA|gh[pousr]_|sk-", s):
        out.append("prefix")
    counts = [s.count(c) / n for c in set(s)]
    out.append(f"entropy{int(-sum(p * math.log2(p) for p in counts))}")
    if _CONTEXT_PHONE.search(left):
        out.append("after-phone")
    if _CONTEXT_MAIL.search(left):
        out.append("after-mail")
    if _CONTEXT_KEY.search(left):
        out.append("after-key")
    if s[:1].isalnum() and s[-1:].isalnum():
        out.append("tidy")
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        out.append("cut")
    return out


Arc = tuple[int, int, int, list[str]]  # from node, to node, label, features


def lattice(text: str, spans: list[tuple[int, int]]) -> tuple[list[int], list[Arc]]:
    """Nodes are the boundaries of candidates; between neighbouring nodes an outside arc is always open."""
    nodes = sorted({x for s in spans for x in s})
    at = {x: i for i, x in enumerate(nodes)}
    arcs = []
    for a, b in spans:
        f = span_features(text, a, b)
        arcs += [(at[a], at[b], y, f) for y in range(len(LABELS))]
    return nodes, arcs


def arc_scores(arcs: list[Arc], weights: dict[tuple[int, str], float]) -> list[float]:
    return [sum(weights.get((y, f), 0.0) for f in feats) for _, _, y, feats in arcs]


def decode(n_nodes: int, arcs: list[Arc], scores: list[float]) -> list[int]:
    """Indices of the best non-overlapping arcs (an arc must score above the outside, 0)."""
    best, back = [0.0] * n_nodes, [-1] * n_nodes
    ending: dict[int, list[int]] = {}
    for k, (_, j, _, _) in enumerate(arcs):
        ending.setdefault(j, []).append(k)
    for j in range(1, n_nodes):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            value = best[arcs[k][0]] + scores[k]
            if value > best[j] + 1e-12:
                best[j], back[j] = value, k
    out, j = [], n_nodes - 1
    while j > 0:
        if back[j] >= 0:
            out.append(back[j])
            j = arcs[back[j]][0]
        else:
            j -= 1
    return out[::-1]


def log_marginals(n_nodes: int, arcs: list[Arc], scores: list[float]) -> tuple[float, list[float]]:
    """log Z and the probability of each arc, by forward and backward sums."""
    add = np.logaddexp
    f, b = np.full(n_nodes, -np.inf), np.full(n_nodes, -np.inf)
    f[0] = b[-1] = 0.0
    order = sorted(range(len(arcs)), key=lambda k: arcs[k][1])
    k = 0
    for j in range(1, n_nodes):
        f[j] = f[j - 1]
        while k < len(order) and arcs[order[k]][1] == j:
            f[j] = add(f[j], f[arcs[order[k]][0]] + scores[order[k]])
            k += 1
    order = sorted(range(len(arcs)), key=lambda k: -arcs[k][0])
    k = 0
    for i in range(n_nodes - 2, -1, -1):
        b[i] = b[i + 1]
        while k < len(order) and arcs[order[k]][0] == i:
            b[i] = add(b[i], b[arcs[order[k]][1]] + scores[order[k]])
            k += 1
    z = f[-1]
    return z, [math.exp(f[i] + s + b[j] - z) for (i, j, _, _), s in zip(arcs, scores)]


def training_sentences(n: int, seed: int) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Rule-made sentences with their true spans; negatives look like dates, orders, versions and plain prose."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    token = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    out = []
    for i in range(n):
        parts, spans, at = [], set(), 0

        def put(s, label=None):
            nonlocal at
            if label:
                spans.add((at, at + len(s), label))
            parts.append(s)
            at += len(s)

        for _ in range(r.randint(1, 3)):
            put(" ".join(word() for _ in range(r.randint(2, 6))) + " ")
            kind = (i + r.randint(0, 7)) % 8
            if kind == 0:
                key, quote = r.choice(["password=", "token = ", "secret: ", "api_key="]), r.choice(["", '"'])
                put(key + quote)
                put(token(r.randint(12, 40)), "secret")
                put(quote)
            elif kind == 1:
                put(r.choice(["AKIA" + digits(16), "ghp_" + token(36), "sk-" + token(32)]), "secret")
            elif kind == 2:
                put(r.choice(["phone ", "call ", "tel: ", ""]))
                put(r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]), "phone")
            elif kind == 3:
                put(r.choice(["mail ", "contact ", ""]))
                put(f"{word()} {r.choice(['[at]', '(at)'])} {word()} {r.choice(['[dot]', '(dot)'])} {r.choice(['com', 'org', 'net'])}", "email")
            elif kind == 4:
                put(f"{word()} at {word()} dot {word()}")  # prose
            elif kind == 5:
                put(f"token: {''.join(word() for _ in range(4))}"[:30])  # a word, not a key
            elif kind == 6:
                put(f"{digits(4)}-{digits(2)}-{digits(2)}")
            else:
                put(f"v{digits(1)}.{digits(2)} no. {digits(7)}")
            put(r.choice([" ", ". ", ", "]))
        out.append(("".join(parts), spans))
    return out


@lru_cache(maxsize=1)
def model(sentences: int = 400, rounds: int = 30, rate: float = 0.5, decay: float = 0.002) -> dict[tuple[int, str], float]:
    """Weights by gradient ascent on the conditional likelihood; a second or two, alike on every machine."""
    made = []
    for text, spans in training_sentences(sentences, 7):
        cand = candidates(text, [])
        if cand:
            nodes, arcs = lattice(text, cand)
            made.append((len(nodes), arcs, [1.0 if (nodes[i], nodes[j], LABELS[y]) in spans else 0.0 for i, j, y, _ in arcs]))
    w: dict[tuple[int, str], float] = {}
    for _ in range(rounds):
        grad: dict[tuple[int, str], float] = {}
        for n, arcs, gold in made:
            _, p = log_marginals(n, arcs, arc_scores(arcs, w))
            for (_, _, y, feats), g, q in zip(arcs, gold, p):
                if abs(g - q) > 1e-4:
                    for f in feats:
                        grad[y, f] = grad.get((y, f), 0.0) + g - q
        for k, g in grad.items():
            w[k] = w.get(k, 0.0) * (1 - decay) + rate * g / math.sqrt(len(made))
    return w


def spans_of(text: str, weights: dict[tuple[int, str], float] | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans)."""
    base = base_spans(text)
    cand = candidates(text, base)
    if not cand:
        return base, base
    nodes, arcs = lattice(text, cand)
    arcs_scores = arc_scores(arcs, weights if weights is not None else model())
    added = [(nodes[arcs[k][0]], nodes[arcs[k][1]], LABELS[arcs[k][2]]) for k in decode(len(nodes), arcs, arcs_scores)]
    return base, sorted(base + added, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_DIGIT_OR_AT = np.zeros(256, bool)
_DIGIT_OR_AT[[*range(0x30, 0x3A), 0x40]] = True


def worth_reading(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which texts can hold a span at all: every pattern wants a digit, an ``@``, a "dot", a key word or
    a key's prefix."""
    hits = [np.flatnonzero(_DIGIT_OR_AT[data])]
    raw = data.tobytes()
    low = raw.lower()
    for literal in (b"dot", *(k.lower().encode() for k in (*_KEYWORDS, *_PREFIXES))):
        at = low.find(literal)
        while at >= 0:
            hits.append(np.array([at]))
            at = low.find(literal, at + len(literal))
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.concatenate(hits), side="right") - 1] = True
    return out


_NONE = hashlib.sha256(b"").hexdigest()


def _digest(weights):
    def run(batches):
        for batch in batches:
            offsets, data = strings(batch.column("text"))
            rows = [(0, 0, 0, 0, _NONE, "", 0)] * batch.num_rows
            for i in np.flatnonzero(worth_reading(offsets, data)).tolist():
                base, every = spans_of(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"), weights)
                if every:
                    counts = [sum(s[2] == k for s in base) for k in KINDS]
                    rows[i] = (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return run


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, and all spans."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digest(model()), schema)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, or group of overlapping spans, gives way to the name of its first kind in brackets."""
    out, at, end = [], 0, 0
    for a, b, kind in spans:
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def _redact(weights):
    def run(batches):
        for batch in batches:
            offsets, data = strings(batch.column("text"))
            texts = batch.column("text").to_pylist()
            for i in np.flatnonzero(worth_reading(offsets, data)).tolist():
                if texts[i] is not None:
                    _, every = spans_of(texts[i], weights)
                    texts[i] = masked(texts[i], every) if every else texts[i]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "text"])

    return run


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span masked; ``n_chars``, where it is there, is counted again."""
    from pyspark.sql import functions as F

    small_batches(docs.sparkSession)
    rows = folded(docs, "text")
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("text").isNull(), F.col("_row.n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return rows.mapInArrow(_redact(model()), rows.schema).select(*unfolded(docs.columns, **own))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
