"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The patterns' spans always stay. The network is trained in numpy from labelled spans, at every call that is not
given a model. It reads every whole text in overlapping windows, which are decoded one by one; where they overlap, a
span counts from the window that holds it furthest from its edges, and what remains is reconciled over the whole text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import bounded_batches, only, share, text_bytes

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Bytes of text that are searched at a time.
STEP_BYTES = 1 << 20
_AT, _DOT = re.compile(r"@|\bat\b", re.I), re.compile(r"\.|\bdot\b", re.I)
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind, then start, in time linear in the text."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((1, start, end))
            start = end + 1
    for m in _CARD.finditer(text):
        if 16 <= len(digits := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# ---- labelled spans -------------------------------------------------------------------------------------------


def labelled_lines(n: int, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """n made-up lines with their spans: the four kinds as the patterns know them and as people write them otherwise
    (spaced, spelled out, in brackets, local numbers, letters beyond ASCII, mistyped cards), among words and other numbers."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    plain = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    letters = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéñüèó"), k))
    pick = lambda *xs: xs[int(rng.integers(0, len(xs)))]

    small = "the of and to in that for at on is was or as a be are der die das und in von zu mit ist ein de la le les et en des que du un pour el los y por con se una do dot da".split()

    def word() -> str:
        w = str(rng.choice(small)) if rng.random() < 0.4 else letters(rng.integers(1, 10))
        return w.upper() if rng.random() < 0.1 else w.capitalize() if rng.random() < 0.15 else w

    def card() -> tuple[str, str]:
        d = str(rng.integers(3, 6)) + digits(14)
        own = next(str(c) for c in range(10) if luhn(d + str(c)))
        name = pick("card ", "visa ", "card no. ", "tarjeta ", "karte ", "carte ", "credit card: ")
        if rng.random() < 0.35:
            return name, pick(" ", "-", ".", "  ", "_").join((d + digits(1))[i : i + 4] for i in range(0, 16, 4))
        sep = pick("", " ", "-", ".", "  ", "/")
        return pick("", "", name), sep.join((d + own)[i : i + 4] for i in range(0, 16, 4))

    def phone() -> tuple[str, str]:
        a, b, c, e = digits(3), digits(3), digits(4), digits(2)
        name = pick("tel ", "tel. ", "phone ", "call ", "fax: ", "mobile ", "ring ")
        if rng.random() < 0.4:
            return pick("", "", name), pick(f"+1 ({a}) {b}-{c}", f"+{e} {a} {b} {c}", f"+{digits(11)}", f"+{e}-{a}-{b}{c}")
        return pick("", name), pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{e} / {b}{c}", f"0{a} {b} {c}", f"00{e} {a} {b} {c}", f"+{e}.{a}.{b}.{c}", f"{e} {e} {digits(2)} {digits(2)} {digits(2)}")

    def email() -> tuple[str, str]:
        who = plain(rng.integers(2, 8)) + pick("", ".", "_") + pick("", plain(3), digits(2))
        host, end = plain(rng.integers(3, 8)) + pick("", "", digits(1)), pick("com", "org", "net", "de", "fr")
        at, dot = pick(("@", "."), ("@", "."), (" @ ", " . "), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" AT ", " DOT "), ("[at]", "."))
        if rng.random() < 0.2:
            who, host = letters(rng.integers(3, 8)) + "é", letters(rng.integers(3, 8)) + "ü"
        return pick("", "", "mail ", "write to "), who + at + host + pick("", dot + "example") + dot + end

    def ip() -> tuple[str, str]:
        if rng.random() < 0.25:
            return pick("", "ip "), ":".join("".join(rng.choice(list("0123456789abcdef"), rng.integers(1, 5))) for _ in range(8))
        return pick("", "", "host ", "ip "), pick(".", ".", " . ", "[.]", "(.)").join(str(x) for x in rng.integers(0, 256, 4))

    made = (email, ip, card, phone)
    others = (
        lambda: digits(rng.integers(1, 8)),
        lambda: digits(2) + pick("/", ".", "-") + digits(2) + pick("/", ".", "-") + digits(4),
        lambda: pick("token", "key", "id", plain(5)) + pick("=", " = ") + pick("", '"') + "".join(rng.choice(list("0123456789abcdef"), rng.integers(12, 41))) + pick("", '"'),
        lambda: digits(rng.integers(1, 3)) + "." + digits(rng.integers(1, 4)),
        lambda: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18)),
        lambda: pick("License, Version ", "version ", "CC ", "v") + digits(1) + "." + digits(1),
        lambda: digits(16),
        lambda: digits(16) + pick("$$$", "###", "&&&"),
        lambda: "@" + plain(5),
        lambda: "v" + digits(1) + "." + digits(1) + "." + digits(2),
        lambda: digits(4) + "-" + digits(2) + "-" + digits(2) + " " + digits(2) + ":" + digits(2),
        lambda: digits(rng.integers(9, 30)),
        lambda: "at " + word() + " dot " + word(),
        lambda: word() + " at " + word() + ". " + word(),
        lambda: "(" + digits(rng.integers(1, 3)) + ") " + word(),
        lambda: ".".join(digits(rng.integers(1, 3)) for _ in range(3)) + " " + word(),
        lambda: pick("$", "€") + digits(rng.integers(1, 4)) + "," + digits(3) + "." + digits(2),
        lambda: digits(2) + ":" + digits(2) + ":" + digits(2),
        lambda: pick("a|b | ", " | ", "## ", "%% ") + digits(2) + " | " + digits(3) + " | " + digits(1),
        lambda: " ".join(digits(rng.integers(1, 4)) for _ in range(int(rng.integers(2, 7)))),
        lambda: pick("!!", "%%%", "###", "***", "&&&", "|", "<b>", "...").join(word() for _ in range(4)),
        lambda: " ".join(word() for _ in range(8)),
        lambda: ". ".join(word() + " " + word() for _ in range(4)),
        lambda: " ".join([word()] * int(rng.integers(3, 9))),
        lambda: word() + " at " + word() + " " + word() + " dot",
        lambda: " ".join(word().upper() + "," for _ in range(4)),
    )
    out = []
    for _ in range(n):
        line, spans = "", []
        for _ in range(rng.integers(2, 5)):
            line += " ".join(word() for _ in range(rng.integers(1, 6))) + pick(" ", " ", " ", ", ", ": ", "\n", ". ")
            if rng.random() < 0.5:
                k = int(rng.integers(0, len(KINDS)))
                name, own = made[k]()
                line += name
                spans.append((k, len(line), len(line) + len(own)))
            else:
                own = others[rng.integers(0, len(others))]()
            line += own + pick(" ", ". ", ", ", ".\n", "!! ", "### ")
        out.append((line, spans))
    return out


# ---- network --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PiiSettings:
    """window, margin: of decoding, each window begins that much before the last one's end, twice; train_window: of training."""

    window: int = 384
    margin: int = 24
    train_window: int = 80
    embed: int = 12
    hidden: int = 16
    lines: int = 2400
    epochs: int = 8
    batch: int = 64
    rate: float = 0.02
    least: float = 0.9
    seed: int = 3


def _classes() -> np.ndarray:
    """The class of each code point below 2 ** 16."""
    out = np.ones(1 << 16, np.uint8)
    out[:127] = np.arange(127)
    for p in range(127, 1 << 16):
        c = chr(p)
        out[p] = 2 if c.isalpha() else 32 if c.isspace() else 1
    return out


_CLASSES = _classes()


def characters(text: str) -> np.ndarray:
    """A class for each code point: ASCII as it is, other letters, white space, the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 1 << 16, _CLASSES[np.minimum(points, (1 << 16) - 1)], 1).astype(np.uint8)


class PiiModel:
    """Embedding, forward and backward LSTM, linear emissions, and CRF transitions.

    Arrays are time x features x batch. A direction's weights W act on (state, embedding, 1) and give the input, forget
    and output gates and the fresh cell, in this order.
    """

    def __init__(self, settings: PiiSettings) -> None:
        self.settings, rng = settings, np.random.default_rng(settings.seed)
        e, h = settings.embed, settings.hidden
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
        self.p = {"E": (draw(128, e) * np.sqrt(e)).astype(np.float32) / 4, "O": draw(TAGS, 2 * h), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            bias = np.repeat(np.array([0, 1, 0, 0], np.float32), h)[:, None]
            self.p[f"W{d}"] = np.concatenate([draw(4 * h, h), draw(4 * h, e), bias], axis=1)
        self.allowed = np.ones((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            self.allowed[:, 2 + 2 * k] = False
            self.allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True

    def _potentials(self) -> np.ndarray:
        return np.where(self.allowed, self.p["T"], -1e4)

    def _letters(self) -> np.ndarray:
        """What a character adds to the network's input: its embedding and the constant one, by column."""
        return np.ascontiguousarray(np.column_stack([self.p["E"], np.ones(len(self.p["E"]), np.float32)]).T)

    # -- training

    def _lstm(self, ids: np.ndarray, d: str, order) -> tuple[np.ndarray, ...]:
        """States of every time in this order, and what the gradient needs: inputs, gates, cells."""
        h, (t, n) = self.settings.hidden, ids.shape
        letters, own = self._letters(), self.p[f"W{d}"]
        z, gates = np.zeros((t, h + len(letters), n), np.float32), np.empty((t, 4 * h, n), np.float32)
        states, cells, cell, state = np.empty((t, h, n), np.float32), np.empty((t, h, n), np.float32), np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
        for j in order:
            z[j, :h] = state
            z[j, h:] = letters[:, ids[j]]
            a = np.matmul(own, z[j], out=gates[j])
            a[: 3 * h] *= 0.5
            np.tanh(a, out=a)
            a[: 3 * h] += 1
            a[: 3 * h] *= 0.5
            cell = a[h : 2 * h] * cell + a[:h] * a[3 * h :]
            cells[j] = cell
            state = np.multiply(a[2 * h : 3 * h], np.tanh(cell), out=states[j])
        return states, z, gates, cells

    def _lstm_gradient(self, ids: np.ndarray, d: str, order: list[int], d_states: np.ndarray, z: np.ndarray, gates: np.ndarray, cells: np.ndarray, grad: dict) -> None:
        h, own = self.settings.hidden, self.p[f"W{d}"]
        back = np.empty_like(gates)
        dh, dc = np.zeros_like(cells[0]), np.zeros_like(cells[0])
        for at in range(len(order) - 1, -1, -1):
            j = order[at]
            i, f, o, u = (gates[j, k * h : (k + 1) * h] for k in range(4))
            tc = np.tanh(cells[j])
            dh += d_states[j]
            dc += dh * o * (1 - tc * tc)
            da = back[j]
            da[:h] = dc * u * i * (1 - i)
            da[h : 2 * h] = dc * cells[order[at - 1]] * f * (1 - f) if at else 0
            da[2 * h : 3 * h] = dh * tc * o * (1 - o)
            da[3 * h :] = dc * i * (1 - u * u)
            dh = own[:, :h].T @ da
            dc *= f
        grad[f"W{d}"] = np.matmul(back, z.transpose(0, 2, 1)).sum(axis=0)
        dx = np.matmul(np.ascontiguousarray(own[:, h:-1].T), back)
        for k in range(dx.shape[1]):
            grad["E"][:, k] += np.bincount(ids.ravel(), dx[:, k].ravel(), len(grad["E"]))

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, list]:
        """time x tags x batch, and what the gradient needs; ids: time x batch."""
        t = len(ids)
        runs = [(d, order, self._lstm(ids, d, order)) for d, order in (("f", list(range(t))), ("b", list(range(t - 1, -1, -1))))]
        both = np.concatenate([kept[0] for _, _, kept in runs], axis=1)
        return np.matmul(self.p["O"], both) + self.p["o"][:, None], [both, runs]

    def forward_backward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log partition of each sequence, marginals, expected transitions of all); the first tag may not be an inside."""
        t, k, n = e.shape
        trans = np.exp(self._potentials()).astype(np.float64)
        top = e.max(axis=1, keepdims=True)
        own = np.exp((e - top).astype(np.float64))
        alpha, scale = np.empty((t, k, n)), np.empty((t, n))
        a = own[0] * self.allowed[0][:, None]
        for j in range(t):
            if j:
                a = (trans.T @ a) * own[j]
            scale[j] = a.sum(axis=0)
            a = np.divide(a, scale[j], out=alpha[j])
        beta, p, pairs = np.ones((k, n)), np.empty((t, k, n)), np.zeros((k, k))
        for j in range(t - 1, -1, -1):
            np.multiply(alpha[j], beta, out=p[j])
            if j:
                right = own[j] * beta / scale[j]
                pairs += (alpha[j - 1] @ right.T) * trans
                beta = trans @ right
        return np.log(scale).sum(axis=0) + top.sum(axis=(0, 1)), p, pairs

    def step(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood a character, and its gradient; ids and gold: time x batch."""
        e, (both, runs) = self.emissions(ids)
        t, k, n = e.shape
        log_z, p, pairs = self.forward_backward(e)
        hot = (gold[:, None] == np.arange(k)[:, None]).astype(np.float32)
        gold_score = (e * hot).sum() + self._potentials()[gold[:-1], gold[1:]].sum()
        size = t * n
        seen = np.bincount((gold[:-1] * k + gold[1:]).ravel(), minlength=k * k).reshape(k, k)
        de = ((p - hot) / size).astype(np.float32)
        grad = {"T": (pairs - seen) / size * self.allowed, "o": de.sum(axis=(0, 2)), "O": np.matmul(de, both.transpose(0, 2, 1)).sum(axis=0), "E": np.zeros_like(self.p["E"])}
        d_both = np.matmul(np.ascontiguousarray(self.p["O"].T), de)
        h = self.settings.hidden
        for at, (d, order, kept) in enumerate(runs):
            self._lstm_gradient(ids, d, order, d_both[:, at * h : (at + 1) * h], *kept[1:], grad)
        return float((log_z.sum() - gold_score) / size), grad

    # -- decoding

    def prepare(self) -> dict[str, tuple[np.ndarray, ...]]:
        """For fast(): weights by which one hyperbolic tangent serves all gates.

        A logistic of x is (1 + tanh(x / 2)) / 2; states are kept doubled, so that neither the sum nor the half is spelled out.
        """
        h = self.settings.hidden
        half = np.concatenate([np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)])[:, None]
        of = lambda d: np.concatenate([self.p[f"W{d}"][:, :h] / 2, self.p[f"W{d}"][:, h:]], axis=1) * half
        return {d: (self._letters(), np.ascontiguousarray(of(d)), np.ascontiguousarray(self.p["O"][:, i * h : (i + 1) * h] / 2)) for i, d in enumerate("fb")}

    def fast(self, ids: np.ndarray, ready: dict) -> np.ndarray:
        """emissions() without what training needs, as time x tags x batch; ids: time x batch."""
        h, (t, n) = self.settings.hidden, ids.shape
        out = np.empty((t, TAGS, n), np.float32)
        for d, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            letters, own, part = ready[d]
            z, a, cell = np.zeros((h + len(letters), n), np.float32), np.empty((4 * h, n), np.float32), np.zeros((h, n), np.float32)
            state, got, fresh, gates = z[:h], z[h:], a[:h], a[: 3 * h]
            for j in order:
                np.take(letters, ids[j], axis=1, out=got, mode="clip")
                np.matmul(own, z, out=a)
                np.tanh(a, out=a)
                gates += 1
                cell *= a[h : 2 * h]
                fresh *= a[3 * h :]
                cell += fresh
                cell *= 0.5
                np.tanh(cell, out=state)
                state *= a[2 * h : 3 * h]
                if d == "f":
                    np.matmul(part, state, out=out[j])
                else:
                    out[j] += part @ state
        out += self.p["o"][:, None]
        return out

    def may_hold(self, e: np.ndarray) -> np.ndarray:
        """Sequences that may have neighbouring spans that gain over "outside": a span begins by the best transition from any
        tag of the best score so far, or from outside, and ends by its own; of each tagging that gains, one such run does."""
        t = self._potentials() - self.p["T"][0, 0]
        begins, inners = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        fresh, beside, begin, inner, out_begin, out_inner = (x.astype(np.float32)[:, None] for x in (t[0, begins], t[1:, begins].max(axis=0), t[begins, inners], t[inners, inners], t[begins, 0], t[inners, 0]))
        first = e[0, 1::2] - e[0, 0]
        held, best = np.full_like(first, -1e4), first + out_begin
        for j in range(1, len(e)):
            top = np.maximum(first, held).max(axis=0)
            first += begin
            held += inner
            np.maximum(held, first, out=held)
            held += e[j, 2::2]
            held -= e[j, 0]
            first = np.maximum(fresh, top + beside)
            first += e[j, 1::2]
            first -= e[j, 0]
            np.maximum(best, first + out_begin, out=best)
            np.maximum(best, held + out_inner, out=best)
        return np.flatnonzero(np.maximum(best, np.maximum(first, held)).max(axis=0) > -1e-2)

    def decode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which sequences have a best tagging with spans, and these tags: a bound by single spans leaves few to search."""
        rows = self.may_hold(e)
        tags = self.viterbi(e[:, :, rows])
        spans = tags.any(axis=0)
        return rows[spans], tags[:, spans]

    def above_none(self, e: np.ndarray) -> np.ndarray:
        """Which sequences have a tagging with spans that beats "outside" throughout."""
        return self.decode(e)[0]

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags, time x batch."""
        t, k, n = e.shape
        trans = self._potentials()[:, :, None]
        score, back = np.where(self.allowed[0][:, None], e[0], -1e4), np.empty((t, k, n), np.int8)
        for j in range(1, t):
            both = score[:, None] + trans
            back[j] = both.argmax(axis=0)
            score = both.max(axis=0) + e[j]
        tags = np.empty((t, n), np.int64)
        tags[-1] = score.argmax(axis=0)
        for j in range(t - 1, 0, -1):
            tags[j - 1] = back[j, tags[j], np.arange(n)]
        return tags


def train_pii(lines: list[tuple[str, list[Span]]] | None = None, settings: PiiSettings = PiiSettings()) -> PiiModel:
    """Adam on windows of the labelled lines."""
    model, size = PiiModel(settings), settings.train_window
    ids, gold = [], []
    for text, spans in labelled_lines(settings.lines) if lines is None else lines:
        tags = np.zeros(len(text), np.int64)
        for k, a, b in spans:
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
        own = characters(text)
        for lo in range(0, max(1, len(own)), size // 2):
            part, mark = own[lo : lo + size].astype(np.int64), tags[lo : lo + size].copy()
            if len(part) < size // 2 and lo:
                break
            inside = (mark > 0) & (mark % 2 == 0)
            cut = int(np.argmin(np.append(inside, False)))  # a span that began before the window
            mark[:cut] = np.where(np.arange(cut) == 0, mark[:cut] - 1, mark[:cut])
            ids.append(np.pad(part, (0, size - len(part)), constant_values=10))
            gold.append(np.pad(mark, (0, size - len(mark))))
    if not ids:
        return model
    x, y = np.array(ids).T.copy(), np.array(gold).T.copy()
    rng = np.random.default_rng(settings.seed)
    m1, m2, n = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    total = settings.epochs * -(-x.shape[1] // settings.batch)
    for _ in range(settings.epochs):
        order = rng.permutation(x.shape[1])
        for lo in range(0, len(order), settings.batch):
            own = order[lo : lo + settings.batch]
            _, grad = model.step(x[:, own], y[:, own])
            n += 1
            rate = settings.rate * min(1.0, 1.2 - n / total)
            for k, g in grad.items():
                g = np.clip(g, -0.1, 0.1)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                model.p[k] = (model.p[k] - rate * (m1[k] / (1 - 0.9**n)) / (np.sqrt(m2[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    return model


# ---- decoding -------------------------------------------------------------------------------------------------


def windows(lengths: np.ndarray, settings: PiiSettings) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of windows that cover each text whole and overlap by two margins."""
    step = settings.window - 2 * settings.margin
    each = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - settings.window) // step)), 0)
    text = np.repeat(np.arange(len(lengths)), each)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * step


def plausible(kind: int, own: str) -> bool:
    """What a kind has at least: signs or their names, or a number of digits. Whether it is one is for the network to say."""
    digits = len(_DIGIT.findall(own))
    if kind == 0:
        return bool(_AT.search(own) and _DOT.search(own))
    if kind == 1:
        return digits >= 4 if re.search(r"\.", own) else own.count(":") >= 2
    return 13 <= digits <= 19 if kind == 2 else 8 <= digits <= 15


def method_spans(points: np.ndarray, offsets: np.ndarray, model: PiiModel, ready: dict, at_a_time: int = 1024) -> list[tuple[int, float, int, Span]]:
    """(text, probability, distance to the window's nearer edge, span) of all windows of the texts, one after another in points.

    points: the classes of the texts' characters; offsets: the n + 1 ends of the texts. A window whose best tagging is
    "outside" throughout has no span, and is not decoded further.
    """
    settings, lengths = model.settings, np.diff(offsets)
    text, start = windows(lengths, settings)
    size = np.minimum(settings.window, lengths[text] - start)
    order = np.argsort(-size, kind="stable")
    out: list[tuple[int, float, int, Span]] = []
    for lo in range(0, len(order), at_a_time):
        part = order[lo : lo + at_a_time]
        wide = int(size[part[0]])
        column = np.arange(wide)
        inside = column < size[part][:, None]
        first = (offsets[text[part]] + start[part])[:, None]
        ids = np.where(inside, points[np.minimum(first + column, len(points) - 1)], 10)
        e = model.fast(np.ascontiguousarray(ids.T, np.int64), ready)
        rows, tags = model.decode(e)
        if not len(rows):
            continue
        e = np.ascontiguousarray(e[:, :, rows])
        _, p, _ = model.forward_backward(e)
        sure = np.take_along_axis(p, tags[:, None], axis=1)[:, 0].T
        tags = tags.T
        for r, row in enumerate(part[rows].tolist()):
            i, a, end_of = int(text[row]), int(start[row]), int(lengths[text[row]])
            own, last = tags[r], int(size[row])
            begins = np.flatnonzero(own[:last] % 2 == 1)
            for j in begins.tolist():
                end = j + 1
                while end < last and own[end] == own[j] + 1:
                    end += 1
                left = j if a else settings.window
                right = last - end if a + last < end_of else settings.window
                out.append((i, float(sure[r, j:end].min()), min(left, right), (int(own[j]) // 2, a + j, a + end)))
    return out


def reconcile(text: str, base: list[Span], found: list[tuple[float, int, Span]], least: float) -> list[Span]:
    """The base spans, and of the network's those that are sure, plausible, and clear of all spans taken before them.

    White space and closing marks at a span's ends are cut off. Spans further from their window's edges go first.
    """
    taken, out = sorted((a, b) for _, a, b in base), list(base)
    for p, edge, (k, a, b) in sorted(set(found), key=lambda x: (-min(x[1], 8), -x[0], x[2])):
        own = text[a:b]
        a += len(own) - len(own.lstrip(" \t\n\r.,;:!?"))
        b -= len(own) - len(own.rstrip(" \t\n\r.,;:!?#$&%*"))
        if p >= least and edge > 0 and a < b and plausible(k, text[a:b]):
            at = bisect.bisect_left(taken, (a, b))
            if (at == len(taken) or taken[at][0] >= b) and (at == 0 or taken[at - 1][1] <= a):
                out.append((k, a, b))
                taken.insert(at, (a, b))
    return sorted(out)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: PiiModel | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the patterns' spans), spans (all), for each row.

    Offsets count code points, ends are exclusive. Null text counts as empty, which has no spans. Null doc_ids and
    repeated rows stay as they are; an empty table gives an empty table.
    """
    search = searcher(docs, model)

    def rows(batches):
        for batch in batches:
            base, spans = search(batch.column(1))
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            digest = [hashlib.sha256(spell(b).encode()).hexdigest() for b in base]
            arrays = [batch.column(0).cast(pa.int64()), *counts, pa.array(digest, pa.string()), pa.array([spell(s) for s in spans], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return only(docs, doc_id, text).mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span], form: str) -> str:
    """The text with each span, or run of overlapping spans, as form with the kind's name."""
    pieces, last = [], 0
    for k, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= last:
            pieces += [text[last:a], form.format(KINDS[k].upper())]
        last = max(last, b)
    return "".join([*pieces, text[last:]])


def mask_pii(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", model: PiiModel | None = None, form: str = "<{}>") -> DataFrame:
    """docs, with all their rows and columns, and each text's spans masked; n_chars, if given, follows. Null text stays null."""
    bounded_batches(docs.sparkSession)
    search, at, schema = searcher(docs, model), docs.columns.index(text), docs.schema

    def rows(batches):
        for batch in batches:
            column = batch.column(at)
            _, spans = search(column)
            if any(spans):
                changed = [masked(column[i].as_py(), s, form) if s else None for i, s in enumerate(spans)]
                column = pc.coalesce(pa.array(changed, column.type), column)
                batch = batch.set_column(at, batch.schema.field(at), column)
            yield batch

    out = docs.mapInArrow(rows, schema)
    return out.withColumn(n_chars, F.length(text).cast(schema[n_chars].dataType)) if n_chars and n_chars in docs.columns else out


def searcher(docs: DataFrame, model: PiiModel | None = None):
    """A function for the executors: (base spans, all spans) of each row of a text column. Without a model, one is trained now."""
    shared = share(docs.sparkSession, model or train_pii())
    trigger = np.zeros(256, bool)
    trigger[[*range(48, 58), 64]] = True

    def search(column: pa.Array) -> tuple[list[list[Span]], list[list[Span]]]:
        own, n = shared(), len(column)
        ready = own.prepare()
        data, offsets = text_bytes(column)
        base: list[list[Span]] = [[] for _ in range(n)]
        spans: list[list[Span]] = [[] for _ in range(n)]
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, "right")) - 1)
            part = data[offsets[lo] : offsets[hi]]
            before = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # code points before each byte
            content = part.tobytes().decode("utf-8", "replace")
            if len(content) != before[-1]:
                raise ValueError("text is not UTF-8")
            ends = before[offsets[lo : hi + 1] - offsets[lo]]
            found: dict[int, list] = {}
            for i, *rest in method_spans(characters(content), ends, own, ready):
                found.setdefault(i, []).append(tuple(rest))
            rows = set((np.searchsorted(offsets, offsets[lo] + np.flatnonzero(trigger[part]), "right") - 1 - lo).tolist())
            for i in sorted(rows | found.keys()):
                text = content[ends[i] : ends[i + 1]]
                base[lo + i] = base_spans(text) if i in rows else []
                spans[lo + i] = reconcile(text, base[lo + i], found.get(i, []), own.settings.least)
            lo = hi
        return base, spans

    return search
