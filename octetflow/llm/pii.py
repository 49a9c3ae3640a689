"""Personal data by a semi-Markov conditional random field over candidate segments, besides exact base patterns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import cache
from ipaddress import ip_address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.llm.common import table

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
#: Tokens of a segment, at most (bounded entities; a token has any length), and training sentences; the model is the same for every input.
TOKENS, SENTENCES, SEED = 8, 1500, 11
#: Code points before a candidate that its features can see: 24 to the end of a cue, and the longest cue.
CONTEXT = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# After a digit no match can start that the digit's own start did not offer, so the look-behind changes no match; it keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base patterns, leftmost and non-overlapping in each kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # as the pattern would match, but looking from each @ back to the start of its local part
        lo = at
        while lo > done and text[lo - 1] in _LOCAL_SET:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at)):
            out.append((lo, 0, m.end()))
            done = m.end()
        else:
            done = at + 1  # a local part holds no @
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _only_digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_only_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_RUN = re.compile(r"(?<![0-9A-Za-z])[0-9]++(?:[().\x20/-]{1,3}+[0-9]++)*+")
_GROUP = re.compile(r"[0-9]++")
_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}|(?<=\s)at(?=\s)", re.I)
_AT_WORD = re.compile(r"[(\[{\s][Aa][Tt][)\]}\s]")
_DOT = r"(?:\(dot\)|\[dot\]|\{dot\}|(?<=\s)dot(?=\s)|\.)"
_LABEL = re.compile(r"\s?([A-Za-z0-9-]++)")
_DOTS = re.compile(r"\s?" + _DOT, re.I)
_DOT_BEFORE = re.compile(r"(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s)\Z", re.I)
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]*+(?::[0-9A-Fa-f]*+){2,}+(?![0-9A-Za-z])")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}+")
_KEYED = re.compile(r"(?:passw(?:or[dt]|d)?|pwd|secret|token|key)[\"']?\s*+[=:]\s*+[\"']?([^\s\"']{6,}+)", re.I)
_CUES = [re.compile(p, re.I) for p in (
    r"mail|contact|write|kontakt|correo|courriel|schreib|escrib|@", r"\bip|host|server|serveur|servidor|addr|from|ping", r"card|visa|credit|karte|tarjeta|carte|pay|amex",
    r"tel|phone|call|fax|mobil|anruf|llam|t[ée]l|reach|ring", r"token|key|secret|passw|pwd|\bapi|auth|bearer|contrase|mot de passe|kennwort|schl[üu]ssel",
)]
_SEPARATORS = [ord(c) for c in " -./()"]
_GLUE = frozenset(" \t\n\r,;\"'")


def _is_ip(s: str) -> bool:
    try:
        return ip_address(s).version == 6
    except ValueError:
        return False


def _mail_candidates(text: str) -> list[tuple[int, int]]:
    """Around each mark that can stand for @: local parts from one token to the bound before it, domains from two labels to the bound behind it."""
    out, done = [], 0
    for m in _AT.finditer(text) if "@" in text or _AT_WORD.search(text) else ():
        lo = m.start() - (text[m.start() - 1 : m.start()].isspace())
        starts = []
        while len(starts) < TOKENS:
            end = lo
            while lo > done and text[lo - 1] in _LOCAL_SET:
                lo -= 1
            if lo == end:
                break
            starts.append(lo)
            before = _DOT_BEFORE.search(text, max(done, lo - 8), lo)
            if not before:
                break
            lo = before.start()
        done = m.end()
        at, ends = m.end(), []
        while starts and len(ends) < TOKENS and (label := _LABEL.match(text, at)):
            if at > m.end():
                ends.append(label.end())
            dot = _DOTS.match(text, label.end())
            if not dot:
                break
            at = dot.end()
        out += [(x, y) for x in starts for y in ends]
    return out


def candidates(text: str, taken: list[tuple[int, int]]) -> np.ndarray:
    """Segments (start, end, kind) that no base span touches, by end, start, kind: every run of up to ``TOKENS`` whole tokens that can be
    of the kind at all (by digits, marks of an address, colons, or a stretch of key characters). A token is never cut, however long it is."""
    parts: list[tuple[np.ndarray, np.ndarray, int]] = []
    add = lambda spans, kind: parts.append((*np.array(spans, np.int64).reshape(-1, 2).T, kind))
    add(_mail_candidates(text), 0)
    signs = ":" in text or "=" in text
    colons = [] if not signs else [(m.start(), m.end() - (m.group()[-1] == ":" and m.group()[-2] != ":")) for m in _COLONS.finditer(text)]
    add([(lo, hi) for lo, hi in colons if hi - lo < 40 and _is_ip(text[lo:hi])], 1)
    add([m.span() for m in _LONG.finditer(text)], 4)
    add([(m.start(1), m.start(1) + max(1, len(m[1].rstrip(",.;:)]")))) for m in _KEYED.finditer(text)] if signs else [], 4)
    groups, runs = [], []
    for k, m in enumerate(_RUN.finditer(text)):
        if m.end() - m.start() > 6:
            found = [g.span() for g in _GROUP.finditer(text, *m.span())]
            if text[m.end() : m.end() + 1].isalnum():  # the last one is part of a longer token
                found.pop()
            groups += found
            runs += [k] * len(found)
    if groups:
        g, run = np.array(groups, np.int64), np.array(runs)
        before = np.r_[0, np.cumsum(g[:, 1] - g[:, 0])]
        lead = np.array([text[x - 1 : x] in ("(", "+") for x in g[:, 0].tolist()])
        for w in range(1, min(TOKENS, len(g)) + 1):
            n = before[w:] - before[:-w]
            ok = (n >= 7) & (n <= 19) & (run[w - 1 :] == run[: len(run) - w + 1])
            lo, hi, n = (g[: len(ok), 0] - lead[: len(ok)])[ok], g[w - 1 :, 1][ok], n[ok]
            for kind, least, most in ((3, 7, 15), (2, 12, 19)):
                parts.append((lo[(n >= least) & (n <= most)], hi[(n >= least) & (n <= most)], kind))
    if not any(len(lo) for lo, _, _ in parts):
        return np.zeros((0, 3), np.int64)
    out = np.concatenate([np.column_stack([lo, hi, np.full(len(lo), kind)]) for lo, hi, kind in parts]).astype(np.int64)
    if len(taken) and len(out):
        starts, ends = np.array(taken).T
        k = np.searchsorted(starts, out[:, 1])
        out = out[~((k > 0) & (ends[np.maximum(k - 1, 0)] > out[:, 0]))]
    return np.unique(out[:, [1, 0, 2]], axis=0)[:, [1, 0, 2]]


FEATURES = ["bias", "cue", "other_cue", "digits", "letters", "upper", "lower", "changes", "luhn", "keyed", "quoted", "plus", "glued", "hex", "at", "bare_at", "spaced_dot", "literal_dot", "even", "beside", "short_tail", "lone_letters",
            *(f"sep{chr(c)}" for c in _SEPARATORS), *(f"n{k}" for k in range(7, 20)), *(f"groups{k}" for k in range(1, 9)), *(f"long{k}" for k in range(2, 9))]


class Features:
    """Whole-span features of candidates of one text, from running sums over its code points: shapes, checks, lengths, and what stands before."""

    def __init__(self, text: str):
        self.text = text
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        digit, upper, lower = (c >= 48) & (c <= 57), (c >= 65) & (c <= 90), (c >= 97) & (c <= 122)
        letter = upper | lower | (c >= 192)
        kind = digit * 1 + upper * 2 + lower * 3 + (c >= 192) * 3
        run = lambda x: np.r_[0, np.cumsum(x)]
        self.c, self.sums = c, {"digits": run(digit), "letters": run(letter), "upper": run(upper), "lower": run(lower), "hex": run(digit | (c >= 65) & (c <= 70) | (c >= 97) & (c <= 102)), "changes": run(np.r_[0, kind[1:] != kind[:-1]] if len(c) else kind)}
        self.separators = [run(c == x) for x in _SEPARATORS]
        self.group = run(np.r_[digit[:1], digit[1:] & ~digit[:-1]])
        edges = np.flatnonzero(np.diff(np.r_[False, digit, False].astype(np.int8)))
        self.sizes = edges[1::2] - edges[::2]
        self.uneven = np.r_[0, np.cumsum(self.sizes[1:] != self.sizes[:-1])]
        d = c[digit].astype(np.int64) - 48
        twice = np.where(d > 4, 2 * d - 9, 2 * d)
        even = np.arange(len(d)) % 2 == 0
        self.luhn = [run(np.where(even, d, twice)), run(np.where(even, twice, d))]  # by the parity of the last digit's place
        self.cues = [np.array([m.end() for m in cue.finditer(text)], np.int64) for cue in _CUES]

    def _digit_near(self, at: np.ndarray, step: int) -> np.ndarray:
        """Whether a digit is at ``at`` or up to two separators further on: the number is part of a longer row of numbers."""
        open_, found = np.ones(len(at), bool), np.zeros(len(at), bool)
        for k in range(3):
            x = at + k * step
            c = np.where((x >= 0) & (x < len(self.c)), self.c[np.clip(x, 0, len(self.c) - 1)], 0)
            found |= open_ & (c >= 48) & (c <= 57)
            open_ &= np.isin(c, (*_SEPARATORS, 43))
        return found

    def __call__(self, cands: np.ndarray) -> np.ndarray:
        lo, hi, kind = cands.T
        out = {name: np.zeros(len(cands)) for name in FEATURES}
        size, text, c = hi - lo, self.text, self.c
        span = {k: (s[hi] - s[lo]) for k, s in self.sums.items()}
        n = span["digits"]
        for k in ("digits", "letters", "upper", "lower"):
            out[k] = span[k] / size
        out["changes"] = np.minimum(1.0, span["changes"] / size)
        out["bias"][:], out["hex"] = 1.0, (span["hex"] == size) * 1.0
        out["lone_letters"] = (span["letters"] == size) * 1.0
        near = np.array([(np.searchsorted(q, lo, "right") > np.searchsorted(q, lo - 24, "left")) for q in self.cues])
        out["cue"] = near[kind, np.arange(len(kind))] * 1.0
        out["other_cue"] = (near.sum(0) - out["cue"] > 0) * 1.0
        first, last = self.sums["digits"][lo], self.sums["digits"][hi]
        checks = np.where((last - 1) % 2 == 0, self.luhn[0][last] - self.luhn[0][first], self.luhn[1][last] - self.luhn[1][first])
        out["luhn"] = ((n >= 12) & (n <= 19) & (checks % 10 == 0)) * 1.0
        before = np.where(lo > 0, c[np.maximum(lo - 1, 0)], 32)
        quote = (before == 34) | (before == 39)
        out["quoted"] = quote * 1.0
        key = np.where(lo > 1, c[np.maximum(lo - 2, 0)], 32)
        key3 = np.where(lo > 2, c[np.maximum(lo - 3, 0)], 32)
        out["keyed"] = (np.isin(before, (58, 61)) | np.isin(key, (58, 61)) & ((before == 32) | quote) | np.isin(key3, (58, 61)) & (key == 32) & quote) * 1.0
        out["plus"] = (c[lo] == 43) * 1.0
        after = np.where(hi < len(c), c[np.minimum(hi, len(c) - 1)], 32)
        word = lambda x: (x >= 48) & (x <= 57) | (x >= 65) & (x <= 90) | (x >= 97) & (x <= 122) | (x >= 192) | (x == 45) | (x == 47) | (x == 95)
        out["glued"] = (word(before) | word(after)) * 1.0
        for x, s in zip(_SEPARATORS, self.separators, strict=True):
            out[f"sep{chr(x)}"] = (s[hi] > s[lo]) * 1.0
        groups = self.group[hi] - self.group[lo]
        for k in range(7, 20):
            out[f"n{k}"] = ((n == k) & (kind > 1) & (kind < 4)) * 1.0
        for k in range(1, 9):
            out[f"groups{k}"] = (groups == k) * 1.0
        log = np.minimum(8, np.log2(np.maximum(4, size)).astype(np.int64))
        for k in range(2, 9):
            out[f"long{k}"] = (log == k) * 1.0
        for i in np.flatnonzero(kind == 0).tolist():
            s = text[lo[i] : hi[i]]
            out["at"][i], out["bare_at"][i] = "@" in s, bool(re.search(r"\sat\s", s, re.I))
            out["spaced_dot"][i], out["literal_dot"][i] = bool(re.search(r"\.\s", s)), "." in s
            out["short_tail"][i] = 2 <= len(re.split(r"[^A-Za-z0-9]", s)[-1]) <= 3
        numbers = (kind == 2) | (kind == 3)
        out["beside"] = (numbers & (self._digit_near(lo - 1, -1) | self._digit_near(hi, 1))) * 1.0
        several = numbers & (groups > 1)
        one, end = self.group[lo[several]], self.group[hi[several]] - 1  # the first and the last group
        out["even"][several] = (self.uneven[np.maximum(end - 1, one)] == self.uneven[one]) & (self.sizes[end] <= self.sizes[one])
        return np.column_stack([out[k] for k in FEATURES])


def _next_token(text: str, at: int) -> int:
    while at < len(text) and text[at] in _GLUE:
        at += 1
    return at


class Lattice:
    """Labellings of a text: candidates as segments, and between them stretches without a label. Places are token starts; a segment that ends where the next
    token is the start of another one is adjacent to it. The score of a labelling is the sum of its segments' scores and of a weight for each change from one label
    to the next; labels are the kinds and, last, none."""

    def __init__(self, text: str, cands: np.ndarray):
        self.kind = cands[:, 2].tolist()
        ends = {hi: _next_token(text, hi) for hi in set(cands[:, 1].tolist())}
        lo, hi = cands[:, 0].tolist(), [ends[x] for x in cands[:, 1].tolist()]
        places = sorted({*lo, *hi})
        at = {p: k for k, p in enumerate(places)}
        self.lo, self.hi, self.n = [at[p] for p in lo], [at[p] for p in hi], len(places)
        self.order = sorted(range(len(lo)), key=lambda i: (self.hi[i], lo[i], self.kind[i]))

    def best(self, scores: list[float], moves: list[list[float]]) -> list[int]:
        """The labelling of the highest score; of equal ones that with fewer segments. Exact, by dynamic programming over places."""
        none, low = len(KINDS), -math.inf
        value = [[low] * (none + 1) for _ in range(self.n)]
        back: list[list] = [[None] * (none + 1) for _ in range(self.n)]
        value[0][none], k = 0.0, 0
        for place in range(self.n):
            if place:
                s = max(range(none, -1, -1), key=lambda s: value[place - 1][s] + moves[s][none])
                value[place][none], back[place][none] = value[place - 1][s] + moves[s][none], (place - 1, s, None)
            while k < len(self.order) and self.hi[self.order[k]] == place:
                i = self.order[k]
                k += 1
                here, into = value[self.lo[i]], self.kind[i]
                s = max(range(none, -1, -1), key=lambda s: here[s] + moves[s][into])
                if here[s] + moves[s][into] + scores[i] > value[place][into]:
                    value[place][into], back[place][into] = here[s] + moves[s][into] + scores[i], (self.lo[i], s, i)
        place, out = self.n - 1, []
        s = max(range(none, -1, -1), key=lambda s: value[place][s] + moves[s][none])
        while place or s != none:
            place, s, i = back[place][s]
            if i is not None:
                out.append(i)
        return out[::-1]

    def expected(self, scores: list[float], moves: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each segment and expected number of each change of labels, by forward and backward sums."""
        none, low = len(KINDS), -math.inf
        m = np.array(moves)
        fwd = np.full((self.n, none + 1), low)
        fwd[0, none] = 0.0
        by_hi: list[list[int]] = [[] for _ in range(self.n)]
        for i in self.order:
            by_hi[self.hi[i]].append(i)
        for place in range(self.n):
            if place:
                fwd[place, none] = np.logaddexp.reduce(fwd[place - 1] + m[:, none])
            for i in by_hi[place]:
                fwd[place, self.kind[i]] = np.logaddexp(fwd[place, self.kind[i]], np.logaddexp.reduce(fwd[self.lo[i]] + m[:, self.kind[i]]) + scores[i])
        back = np.full((self.n, none + 1), low)
        back[-1] = m[:, none]
        total = np.logaddexp.reduce(fwd[-1] + back[-1])
        p, changes = np.zeros(len(scores)), np.zeros((none + 1, none + 1))
        changes[:, none] += np.exp(fwd[-1] + back[-1] - total)
        for place in range(self.n - 1, -1, -1):
            if place:
                step = fwd[place - 1] + m[:, none] + back[place, none]
                changes[:, none] += np.exp(step - total)
                back[place - 1] = np.logaddexp(back[place - 1], m[:, none] + back[place, none])
            for i in by_hi[place]:
                step = m[:, self.kind[i]] + scores[i] + back[place, self.kind[i]]
                each = np.exp(fwd[self.lo[i]] + step - total)
                p[i] = each.sum()
                changes[:, self.kind[i]] += each
                back[self.lo[i]] = np.logaddexp(back[self.lo[i]], step)
        return p, changes

    def changes(self, chosen: list[int]) -> np.ndarray:
        none, out, place, s = len(KINDS), np.zeros((len(KINDS) + 1,) * 2), 0, len(KINDS)
        for i in [*chosen, None]:
            to = self.n - 1 if i is None else self.lo[i]
            if to > place:
                out[s, none] += 1
                out[none, none] += to - place - 1
                s = none
            place, s, before = (self.hi[i], self.kind[i], s) if i is not None else (to, none, s)
            out[before, s] += 1
        return out


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A made-up sentence with its true segments, among decoys that look alike."""
    word = lambda: "".join(r.choice(["an", "er", "ti", "on", "the", "in", "lo", "sch", "ó", "que"]) for _ in range(r.randint(1, 3)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    plain = lambda: word().replace("ó", "o")
    hexes, key = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def card():
        body = r.choice("3456") + num(r.choice([14, 14, 14, 13, 11]))
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = r.choice([".", "-", " ", "", "/"])
        return sep.join(body[k : k + 4] for k in range(0, len(body), 4))

    phones = [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"0{num(3)} {num(7)}", lambda: f"0{num(2)}/{num(8)}",
              lambda: " ".join(["0" + num(1), *(num(2) for _ in range(4))]), lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"0{num(3)}-{num(6)}"]
    secrets = [lambda: pick(hexes, r.choice([32, 40, 64])), lambda: pick(key, r.choice([20, 24, 40, 300])), lambda: r.choice(["sk_live_", "pk-", "ghp_"]) + pick(key, 24), lambda: pick(key + "+/", 42) + "==", lambda: pick(key + "!#$%_", r.randint(8, 14))]
    made = {
        "email": lambda: plain() + r.choice(["", "." + plain(), num(2)]) + r.choice([" (at) ", "[at]", "(at)", " at ", " [at] ", " @ "]) + plain() + r.choice([" dot ", " (dot) ", "[dot]", "."]) + r.choice(["com", "org", "net", "de", "co.uk"]),
        "phone": lambda: r.choice(phones)(),
        "card": card,
        "ip": lambda: r.choice([lambda: ":".join(pick(hexes, r.randint(1, 4)) for _ in range(8)), lambda: f"fe80::{pick(hexes, 4)}:{pick(hexes, 3)}", lambda: f"2001:db8::{pick(hexes, 2)}"])(),
        "secret": lambda: r.choice(['"', "'", ""]) + r.choice(secrets)(),
    }
    cue = {"email": ["mail:", "contact", "write to", "Kontakt"], "phone": ["tel.", "call", "phone:", "fax", "Mobil"], "card": ["card", "visa", "credit card:", "Karte"], "ip": ["host", "ip", "server", "from"],
           "secret": ["token =", "api_key:", "secret =", "password =", "key=", "passwd:"]}
    decoy = [lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: num(12), lambda: num(16), lambda: f"{word()} at {word()}. {word()}", lambda: f"{num(1)}.{num(2)} {num(3)}", lambda: "x = " + word() * 7, lambda: " ".join(num(2) for _ in range(6)),
             lambda: f"{num(4)} - {num(4)}", lambda: "n: " + "_".join(word() for _ in range(5)), lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: " ".join(num(1) for _ in range(r.randint(8, 20))),
             lambda: "/".join(word() for _ in range(8)), lambda: "-".join(word() for _ in range(6)), lambda: word() * 6, lambda: f"{num(3)} {num(3)} {num(3)} {num(3)} {num(3)}", lambda: f"key: {word()} {word()}", lambda: "commit " + pick(hexes, 40),
             lambda: r.choice([" ", "  ", " / ", "-"]).join(num(r.choice([k, k, k + 1])) for k in [r.randint(1, 4)] for _ in range(r.randint(6, 24))),
             lambda: f"{num(2)}/{num(2)}/{num(4)} {num(2)}.{num(2)}", lambda: f"{word()} at {num(2)}. {word()}", lambda: f"{num(8)}.{num(4)}", lambda: f"{word()}::{word()}::{word()}"]
    text, gold = "", []
    for _ in range(r.randint(2, 6)):
        text += " ".join(word() for _ in range(r.randint(1, 6))) + " "
        kind = r.choice([*KINDS, None, None, None])
        if kind is None:
            text += r.choice(decoy)() + " "
            continue
        text += r.choice(cue[kind]) + " " if kind == "secret" or r.random() < 0.7 else ""
        s = made[kind]()
        lo = len(text) + (s[0] in "\"'")
        text += s
        gold.append((lo, len(text), kind))
        text += (s[0] if s[0] in "\"'" else "") + r.choice([" ", ". ", ", "])
    return text, gold


class Field:
    """Weights of the features of each kind and of the changes of labels."""

    def __init__(self):
        self.weights, self.moves = np.zeros((len(KINDS), len(FEATURES))), np.zeros((len(KINDS) + 1,) * 2)

    def scores(self, text: str, cands: np.ndarray) -> np.ndarray:
        """Stretches of the text around candidates are looked at one by one; features reach no further than ``CONTEXT`` to the left and a few signs to the right."""
        order, out = np.argsort(cands[:, 0], kind="stable"), np.zeros(len(cands))
        lo, reach = cands[order, 0], np.maximum.accumulate(cands[order, 1])
        cuts = np.r_[0, np.flatnonzero(lo[1:] - CONTEXT > reach[:-1] + 8) + 1, len(order)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            start = max(0, int(lo[a]) - CONTEXT)
            features = Features(text[start : int(reach[b - 1]) + 8])
            for k in range(a, b, 16384):
                part = cands[order[k : min(b, k + 16384)]]
                out[order[k : min(b, k + 16384)]] = (features(part - [start, start, 0]) * self.weights[part[:, 2]]).sum(1)
        return out

    def find(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        cands = candidates(text, taken)
        if not len(cands):
            return []
        scores, m = self.scores(text, cands), self.moves
        gain = np.array([(m[:, [k]] + m[[k], :] - m[:, [-1]] - m[[-1], :]).max() for k in range(len(KINDS))])
        worth = scores + gain[cands[:, 2]] > 0  # without the others no labelling is worse, whatever stands beside them
        cands, scores = cands[worth], scores[worth].tolist()
        if not len(cands):
            return []
        return [tuple(cands[i].tolist()) for i in Lattice(text, cands).best(scores, m.tolist())]


def train(sentences: int = SENTENCES, seed: int = SEED, epochs: int = 4) -> Field:
    """Stochastic gradient on the conditional log-likelihood of whole labellings of made-up sentences."""
    r, field, data = random.Random(seed), Field(), []
    for _ in range(sentences):
        text, gold = _sentence(r)
        cands = candidates(text, [])
        if len(cands):
            at = {tuple(c): i for i, c in enumerate(cands.tolist())}
            true = [at[lo, hi, KINDS.index(k)] for lo, hi, k in gold if (lo, hi, KINDS.index(k)) in at]
            data.append((cands, Features(text)(cands), Lattice(text, cands), true))
    for epoch in range(epochs):
        rate = 0.2 / (1 + epoch)
        for cands, x, lattice, true in data:
            p, changes = lattice.expected((x * field.weights[cands[:, 2]]).sum(1).tolist(), field.moves.tolist())
            p = -p
            p[true] += 1
            field.weights *= 1 - 1e-5
            np.add.at(field.weights, cands[:, 2], rate * p[:, None] * x)
            field.moves += rate * (lattice.changes(true) - changes)
            field.moves[-1, -1] = 0.0  # what the others are measured against
    return field


def find_spans(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """(base spans, all spans by start, then kind as listed). Base spans stay; the field adds segments beside them."""
    if not text:
        return [], []
    base = base_spans(text)
    taken, reach = [], -1
    for lo, _, hi in base:  # merged, so that bisection by start suffices
        if lo < reach:
            taken[-1] = (taken[-1][0], reach := max(reach, hi))
        else:
            taken.append((lo, reach := hi))
    more = [(lo, kind, hi) for lo, hi, kind in field.find(text, taken)]
    return base, [(lo, hi, KINDS[k]) for lo, k, hi in sorted(base + more)]


def _finder(field: Field):
    def run(batches):
        for batch in batches:
            counts, digests, lists = [[] for _ in BASE], [], []
            for t in batch.column(1):
                base, spans = find_spans(t.as_py(), field)
                for k, c in enumerate(counts):
                    c.append(sum(b[1] == k for b in base))
                digests.append(hashlib.sha256(",".join(f"{BASE[k]}:{lo}:{hi}" for lo, k, hi in base).encode()).hexdigest())
                lists.append([{"kind": k, "start": lo, "end": hi} for lo, hi, k in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, kind)], ["id", *(f"n_{k}" for k in BASE), "base_sha256", "found"])

    return run


@cache
def field_of(sentences: int = SENTENCES, seed: int = SEED) -> Field:
    return train(sentences, seed)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row a row of ``docs``: id_col, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and ``found``, an array of (kind, start, end) of all spans.

    Offsets are code points of the whole text, ends exclusive. The field is trained on made-up sentences at the driver, the same for every
    input. Null and empty texts have no spans; null and repeated ids keep their rows; other columns are ignored. No shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"n_{k} long" for k in BASE)
    out = rows.mapInArrow(_finder(field or field_of()), f"id long, {kinds}, base_sha256 string, found array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def mask_pii(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets."""
    use = field or field_of()

    def masked(series):
        out = []
        for t in series.to_pylist():
            parts, at = [], 0
            for lo, hi, kind in find_spans(t, use)[1]:
                if lo >= at:
                    parts += [t[at:lo], f"<{kind}>"]
                at = max(at, hi)
            out.append(t and "".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, F.arrow_udf(masked, "string")(F.col(text_col).cast("string")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", spans.alias("spans"))
