"""Personal data: exact patterns, and a character-level bidirectional LSTM with a CRF that adds spans.

Base spans (email, ip, card, phone) come from patterns with checks.  A tagger
learns from labelled spans: windows of sampled texts with their base spans, and
copies of them in which a span is written in ways the patterns don't know
(``name at host dot org``, dotted card numbers, ``00`` for ``+``).  Embedding,
both LSTM directions, the emission layer and the CRF's transitions are trained
in NumPy by Adam on the negative log likelihood.

Every text is searched as a whole.  Windows of WINDOW code points, HOP apart,
are laid wherever the text has a digit, an ``@`` or an ``at`` between what can
be a name and a host.  A span that is added passes its kind's checks
(``plausible``), and none passes without one of these, so a text without them
has nothing to find; windows reach MARGIN cells beyond a written-out sign.  The
emissions of overlapping windows are averaged (centres weigh most) and one
Viterbi pass over each stretch of windows that touch reconciles them, so no
window border cuts a span.  A decoded span is added if the model's confidence in
it, from the posteriors of the AROUND code points at either side, is
MIN_CONFIDENCE, it passes the checks, and no base span overlaps it; base spans
always stay.

Defined results: null is the empty text, without spans; positions are code
points, ends exclusive; repeated rows get equal answers; without training texts
only base spans are found; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm import kernels
from helixlake.llm.common import prepare, text_of

KINDS = ("email", "ip", "card", "phone")
#: Texts with a trigger that the tagger is trained on at most, chosen by hash, and windows of them.
SAMPLE_ROWS, SAMPLE_WINDOWS = 1_500, 3_000
#: Code points, from 1,000 before the first digit or @ on, that a training text is cut to, and its windows at most.
SAMPLE_CHARS, SAMPLE_TEXT_WINDOWS = 3_000, 12
WINDOW, HOP, MARGIN, AROUND = 64, 32, 2, 48
#: Code points by tags that are decoded at a time.
CELLS = 400_000
EMBED, HIDDEN, EPOCHS, BATCH, RATE = 12, 20, 5, 48, 0.01
MIN_CONFIDENCE = 0.9
TAGS = 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits can't match where the run's own start fails.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOT = r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
_ADDRESS = re.compile(rf"[\w.%+-]+(?:\s*@\s*|\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+)[\w-]+(?:{_DOT}[\w-]+)+", re.I)
#: What follows the name in an address without @, in lower case; it begins with letters, which are found fast.
_SPELLED = re.compile(rf"at(?:\s*[\])]\s*|\s+)[\w-]+{_DOT}[\w-]")
#: The same over UTF-8, where bytes of other characters may be anything: finds the texts to look at.
_MAYBE = re.compile(rb"at(?:[\s\x80-\xff]*[\])][\s\x80-\xff]*|[\s\x80-\xff]+)[\w\x80-\xff-]+"
                    rb"(?:\.|[\s\x80-\xff]*[\[(][\s\x80-\xff]*dot[\s\x80-\xff]*[\])][\s\x80-\xff]*|[\s\x80-\xff]+dot[\s\x80-\xff]+)[\w\x80-\xff-]")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern matches that pass their checks, by start and kind."""
    out, since = [], 0
    at = text.find("@")
    while at >= 0:  # the leftmost match of an address begins as far left of its sign as allowed
        a = at
        while a > since and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end(), 0))
            since = m.end()
        at = text.find("@", max(at + 1, since))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def plausible(text: str, kind: int) -> bool:
    """The checks of a kind for a span in another spelling."""
    d = _digits(text)
    if kind == 0:
        return _ADDRESS.fullmatch(text) is not None
    if kind == 1:
        parts = re.split(r"\s*\.\s*", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return re.fullmatch(r"[0-9](?:[\x20._/-]{0,2}[0-9])+", text) is not None and 14 <= len(d) <= 19 and luhn(d)
    return re.fullmatch(r"(?:\+|00)[0-9][\x20()./0-9-]+[0-9]", text) is not None and 10 <= len(d) - 2 * text.startswith("00") <= 15


def symbols(text: str) -> np.ndarray:
    """Character classes: printable ASCII as itself, white space, other letters, anything else."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((cp >= 32) & (cp < 127), cp - 29, 2)
    out[(cp >= 9) & (cp <= 13)] = 1
    out[cp >= 0xC0] = 0
    return out.astype(np.int64)


SYMBOLS = 98


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 5):
        r = np.random.RandomState(seed)
        scale = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": r.normal(0, 0.3, (SYMBOLS, EMBED)), "out": scale(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS),
                  "T": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"x{d}": scale(EMBED, 4 * HIDDEN), f"h{d}": scale(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def _lstm(self, x: np.ndarray, d: str, cache: list | None = None) -> np.ndarray:
        b, n, _ = x.shape
        H = HIDDEN
        gates = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((b, H)), np.zeros((b, H))
        out = np.empty((b, n, H))
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = gates[:, t] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * H], -30, 30)))
            g = np.tanh(z[:, 3 * H :])
            i, f, o = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :]
            old, before = c, h
            c = f * old + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if cache is not None:
                cache.append((t, i, f, o, g, old, tc, before))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["E"][ids]
        h = np.concatenate([self._lstm(x, "f"), self._lstm(x, "b")], 2)
        return h @ self.p["out"] + self.p["bias"]

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a batch of windows and its gradient."""
        b, n = ids.shape
        x = self.p["E"][ids]
        caches: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._lstm(x, d, caches[d]) for d in "fb"], 2)
        e = h @ self.p["out"] + self.p["bias"]
        node, edge, log_z = marginals(e, self.p["T"], self.p["first"])
        rows, at = np.arange(b)[:, None], np.arange(n)[None]
        gold = e[rows, at, tags].sum() + self.p["T"][tags[:, :-1], tags[:, 1:]].sum() + self.p["first"][tags[:, 0]].sum()
        de = node.copy()
        de[rows, at, tags] -= 1
        dT = edge
        np.add.at(dT, (tags[:, :-1], tags[:, 1:]), -1)
        grad = {"T": dT, "first": de[:, 0].sum(0), "out": np.einsum("bnh,bnt->ht", h, de), "bias": de.sum((0, 1))}
        dh = de @ self.p["out"].T
        dx = np.zeros_like(x)
        H = HIDDEN
        for k, d in enumerate("fb"):
            own = dh[:, :, k * H : (k + 1) * H]
            w = self.p[f"h{d}"]
            gw, dz_all = np.zeros_like(w), np.zeros((b, n, 4 * H))
            back_h, back_c = np.zeros((b, H)), np.zeros((b, H))
            for t, i, f, o, g, old, tc, before in reversed(caches[d]):
                ht = own[:, t] + back_h
                ct = back_c + ht * o * (1 - tc * tc)
                dz = np.concatenate([ct * g * i * (1 - i), ct * old * f * (1 - f), ht * tc * o * (1 - o), ct * i * (1 - g * g)], 1)
                dz_all[:, t] = dz
                gw += before.T @ dz
                back_h, back_c = dz @ w.T, ct * f
            grad |= {f"h{d}": gw, f"b{d}": dz_all.sum((0, 1)), f"x{d}": np.einsum("bne,bnz->ez", x, dz_all)}
            dx += dz_all @ self.p[f"x{d}"].T
        grad["E"] = np.zeros_like(self.p["E"])
        np.add.at(grad["E"], ids, dx)
        return float(log_z.sum() - gold) / b, {k: v / b for k, v in grad.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, seed: int = 9) -> None:
        r = np.random.RandomState(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, steps = 0, EPOCHS * -(-len(ids) // BATCH)
        for _ in range(EPOCHS):
            order = r.permutation(len(ids))
            for a in range(0, len(ids), BATCH):
                own = order[a : a + BATCH]
                _, grad = self.loss(ids[own], tags[own])
                step += 1
                norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5 / max(norm, 1e-9))
                    u, v = m[k]
                    u += 0.1 * (g - u)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= RATE * (1.05 - step / steps) * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(e: np.ndarray, T: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each tag at each place, summed posterior of transitions, and log Z, of (batch, n, tags)."""
    b, n, k = e.shape
    fw, bw = np.empty_like(e), np.zeros_like(e)
    fw[:, 0] = first + e[:, 0]
    for t in range(1, n):
        fw[:, t] = _lse(fw[:, t - 1, :, None] + T[None], 1) + e[:, t]
    for t in range(n - 2, -1, -1):
        bw[:, t] = _lse(T[None] + (e[:, t + 1] + bw[:, t + 1])[:, None], 2)
    z = _lse(fw[:, -1], 1)
    edge = np.zeros((k, k))
    for t in range(1, n):
        edge += np.exp(fw[:, t - 1, :, None] + T[None] + (e[:, t] + bw[:, t])[:, None] - z[:, None, None]).sum(0)
    return np.exp(fw + bw - z[:, None, None]), edge, z


def viterbi(e: np.ndarray, T: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best tags of each row of (batch, n, tags), of which the first size places count."""
    b, n, k = e.shape
    score, back = first + e[:, 0], np.empty((b, n, k), np.int8)
    for t in range(1, n):
        total = score[:, :, None] + T
        back[:, t] = total.argmax(1)
        score = np.where((t < size)[:, None], total.max(1) + e[:, t], score)
    out, rows = np.zeros((b, n), np.int64), np.arange(b)
    now = score.argmax(1)
    for t in range(n - 1, -1, -1):
        out[:, t] = np.where(t < size, now, 0)
        if t:
            now = np.where(t < size, back[rows, t, now], now)
    return out


def starts(text: str) -> list[int]:
    """Starts of the windows: all HOP apart that contain a trigger, and more around an @ or a written-out sign."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    digits = np.unique(np.flatnonzero((cp >= 48) & (cp < 58)) // HOP)
    signs = np.flatnonzero(cp == 64)
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: places stay
    signs = np.concatenate([signs, [m.start() for m in _SPELLED.finditer(lower)]]).astype(np.int64)
    signs = np.unique(signs // HOP)
    cells = np.concatenate([digits - 1, digits, *[signs + d for d in range(-MARGIN, MARGIN)]])
    return (np.unique(cells[(cells >= 0) & (cells * HOP < len(cp))]) * HOP).tolist()


def _padded(ids: np.ndarray, a: int) -> np.ndarray:
    out = np.full(WINDOW, 1, np.int64)
    own = ids[a : a + WINDOW]
    out[: len(own)] = own
    return out


def _labels(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for a, b, kind in spans:
        if not out[a:b].any():
            out[a:b] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
    return out


def _respelled(text: str, spans: list[tuple[int, int, int]], random: np.random.RandomState) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans in spellings that the patterns miss."""
    out, found, since = "", [], 0
    for a, b, kind in spans:
        if a < since:
            continue
        own = text[a:b]
        if kind == 0:
            at = (" at ", " [at] ", " (at) ", "[at]", "(at)")[random.randint(5)]
            dot = (" dot ", " [dot] ", " (dot) ", ".", "[dot]")[random.randint(5)]
            own = own.replace("@", at).replace(".", dot)
        elif kind == 2:
            d = _digits(own)
            own = "._/"[random.randint(3)].join(d[i : i + 4] for i in range(0, len(d), 4))
        elif kind == 3:
            own = own.replace("+", "00", 1)
        out += text[since:a]
        found.append((len(out), len(out) + len(own), kind))
        out += own
        since = b
    return out + text[since:], found


def train(texts: list[str], seed: int = 3) -> Tagger | None:
    """A tagger for the labelled spans of texts; None if there is nothing to learn from."""
    random = np.random.RandomState(seed)
    ids, tags = [], []
    for text in texts:
        spans = base_spans(text)
        versions = [(text, spans)] + ([_respelled(text, spans, random)] if spans else [])
        for body, labelled in versions:
            symbol, tag = symbols(body), _labels(len(body), labelled)
            near = starts(body) + [max(0, a - random.randint(HOP)) for a, _, _ in labelled]
            for a in near if len(near) <= SAMPLE_TEXT_WINDOWS else [near[i] for i in random.choice(len(near), SAMPLE_TEXT_WINDOWS, replace=False)]:
                ids.append(_padded(symbol, a))
                own = np.zeros(WINDOW, np.int64)
                part = tag[a : a + WINDOW]
                own[: len(part)] = part
                tags.append(own)
    if not ids:
        return None
    pick = random.permutation(len(ids))[:SAMPLE_WINDOWS]
    tagger = Tagger()
    tagger.fit(np.stack(ids)[pick], np.stack(tags)[pick])
    return tagger


def _together(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in rows, (batch, n, tags) and sizes: rows of about one length as one array, about CELLS at a time."""
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    while order:
        n, many = len(rows[order[-1]]), 1
        while many < len(order) and (many + 1) * n * TAGS <= CELLS and 2 * len(rows[order[-many - 1]]) >= n:
            many += 1
        own, order = order[-many:], order[:-many]
        out = np.zeros((many, n, TAGS))
        for i, k in enumerate(own):
            out[i, : len(rows[k])] = rows[k]
        yield np.array(own), out, np.array([len(rows[k]) for k in own])


def stretches(tagger: Tagger, texts: list[str]) -> list[tuple[int, int, np.ndarray]]:
    """(text, start, emissions) of each stretch of windows that touch, emissions averaged where windows overlap."""
    ids = [symbols(t) for t in texts]
    flat = [(k, a) for k, t in enumerate(texts) for a in starts(t)]
    weight = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(float)
    out: list[list] = []  # text, start, summed emissions, weights
    owner = []
    for i, (k, a) in enumerate(flat):
        if not i or flat[i - 1][0] != k or a > flat[i - 1][1] + WINDOW:
            out.append([k, a, a])
        out[-1][2] = min(a + WINDOW, len(texts[k]))
        owner.append(len(out) - 1)
    out = [[k, a, np.zeros((b - a, TAGS)), np.zeros(b - a)] for k, a, b in out]
    for at in range(0, len(flat), 1024):
        batch = flat[at : at + 1024]
        e = tagger.emissions(np.stack([_padded(ids[k], a) for k, a in batch])) * weight[:, None]
        for (_, a), own, mine in zip(batch, e, owner[at : at + 1024]):
            _, start, total, w = out[mine]
            part = slice(a - start, a - start + WINDOW)
            n = len(w[part])
            total[part] += own[:n]
            w[part] += weight[:n]
    return [(k, a, total / w[:, None]) for k, a, total, w in out]


def added_spans(tagger: Tagger, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the tagger adds to the base spans of each text."""
    T, first = tagger.p["T"], tagger.p["first"]
    found: list[tuple[int, int, int, int, np.ndarray]] = []  # text, start, end, kind, emissions around
    lead: list[tuple[int, int, int]] = []  # its place there, its first tag
    parts = stretches(tagger, texts)
    for own, e, size in _together([x[2] for x in parts]):
        for i, tags in zip(own.tolist(), viterbi(e, T, first, size)):
            k, a, emitted = parts[i]
            for s in np.flatnonzero(tags % 2 == 1).tolist():
                t = s + 1
                while t < len(tags) and tags[t] == tags[s] + 1:
                    t += 1
                # What a check or a base span rules out needs no posterior.
                kind, body = int(tags[s] - 1) // 2, texts[k][a + s : a + t]
                x = a + s + len(body) - len(body.lstrip())
                body = body.strip()
                if plausible(body, kind) and not any(x < q and p < x + len(body) for p, q, _ in bases[k]):
                    low = max(0, s - AROUND)
                    found.append((k, x, x + len(body), kind, emitted[low : t + AROUND].copy()))
                    lead.append((s - low, t - low, int(tags[s])))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for own, e, size in _together([x[4] for x in found]):
        for i, row, n in zip(own.tolist(), e, size.tolist()):
            s, t, tag = lead[i]
            sure = marginals(row[None, :n], T, first)[0][0]
            if np.concatenate([sure[s : s + 1, tag], sure[s + 1 : t, tag + 1]]).mean() >= MIN_CONFIDENCE:
                out[found[i][0]].append(found[i][1:4])
    return out


def _spelled(part: kernels.Texts) -> set[int]:
    """The texts that may have an address without @."""
    low, ends = kernels.LOWER[part.data].tobytes(), part.offsets.tolist()
    whole = b"\0".join(low[a:b] for a, b in zip(ends, ends[1:]))
    at = np.array([m.start() for m in _MAYBE.finditer(whole)], np.int64)
    return set((np.searchsorted(part.offsets + np.arange(part.n + 1), at, "right") - 1).tolist())


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def find(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all), n_added and n_spans (all)."""
    spark = docs.sparkSession
    prepare(spark)
    h = F.xxhash64("doc_id", "text")
    marked = docs.where(F.regexp_like("text", F.lit("[0-9@]")))
    share = min(1.0, 1.2 * sample_rows / max(1, marked.count()))
    # Passages around a trigger, so that a few very long texts can't fill the driver.
    first = F.regexp_instr("text", F.lit("[0-9@]"))
    begin = F.greatest(first - 1000, F.lit(1))
    sample = (marked.where(F.pmod(h, F.lit(1 << 31)) < max(1, int(share * (1 << 31))))
              .select(h.alias("h"), F.substr("text", begin, F.lit(SAMPLE_CHARS)).alias("text")).orderBy("h", "text").limit(sample_rows).collect())
    shipped = spark.sparkContext.broadcast(train([r["text"] for r in sample]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch.column(1)):
                marks = np.diff(np.concatenate([[0], np.cumsum(_TRIGGER[part.data], dtype=np.int64)])[part.offsets])
                texts = {k: part.data[part.offsets[k] : part.offsets[k + 1]].tobytes().decode("utf-8") for k in sorted({*np.flatnonzero(marks).tolist(), *_spelled(part)})}
                base = {k: base_spans(t) if marks[k] else [] for k, t in texts.items()}
                more = dict(zip(texts, added_spans(shipped.value, list(texts.values()), list(base.values())))) if shipped.value else {}
                rows = []
                for k in range(part.n):
                    own, extra = base.get(k, []), more.get(k, [])
                    rows.append((*[sum(s[2] == kind for s in own) for kind in range(len(KINDS))],
                                 hashlib.sha256(joined(own).encode()).hexdigest(), joined(own + extra), len(extra), len(own) + len(extra)))
                cols = list(zip(*rows))
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                                 ["doc_id", *[f"n_{x}" for x in KINDS], "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
