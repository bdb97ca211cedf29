"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns are exact. The field adds spans that they miss, such as numbers without a plus,
numbers with dots or brackets, addresses with spelled-out signs, long internet addresses and
secrets (keys, tokens, passwords): it scores whole candidate segments by features of the span, of
what stands around it and of the segment before, and dynamic programming over the last segment's
kind chooses boundaries and kinds together. Weights are fitted by likelihood, with forward and
backward sums over all segmentations, on labelled sentences made by sentences(). Base spans always
stay; an added span never overlaps one.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, texts, tuned

#: The base kinds, in order, and the one that only the field knows.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
#: Labels of the field: the kinds, and last what is none.
OUTSIDE = len(KINDS)

# The patterns of the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Numbers joined by dots; four at a time are what the contract's ip pattern matches, [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+).
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")

#: Tokens in a segment at most; a secret may have any number.
MAX_TOKENS = 48
#: Tokens of a spelled-out address before its sign at most.
NAME_TOKENS = 9
#: How much better than plain text a segment must be to be added.
MARGIN = 0.5
_SAID = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|key|bearer|auth\w*|credentials?)"
_TRIGGER = re.compile(r"[0-9]+|@|at(?=[ )\]}])|AT(?=[ )\]}])|[:=]")
_SAID_BEFORE = re.compile(rf"{_SAID}[\"']?\s*\Z", re.I)
_TOKENS = 48
#: Tokens of a spelled-out address before its sign at most.
NAME_TOKENS = 9
#: How much better than plain text a segment must be to be added.
MARGIN = 0.5
_SAID = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|key|bearer|auth\w*|credentials?)"
_TRIGGER = re.compile(rf"[0-9]+|@|[(\[{{] ?(?:at|AT) ?[)\]}}]| (?:at|AT) |(?i:{_SAID}[\"']?\s*[:=])")
_TOKENS = re.compile(r"[^\W\d_]+|[0-9]+|[^\S\n]+|\n|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    """The leftmost non-overlapping matches, found from each @: the local part is the run before it, no further left than the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _ips(text: str):
    """Each run of numbers is read once: matches are four numbers at a time from its start."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for n in range(0, len(parts) - 3, 4):
            four = parts[n : n + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if "." in text:
        out += [(s, 1, e) for s, e in _ips(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- candidate segments and their features

_AT = r"(?:\s*@\s*|\s*[(\[{]\s*(?:at|AT)\s*[)\]}]\s*|\s+(?:at|AT)\s+)"
_DOT = r"(?:\.|\s*[(\[{]\s*(?:dot|DOT|\.)\s*[)\]}]\s*|\s+(?:dot|DOT)\s+)"
_SHAPES = {
    0: re.compile(rf"[\w%+-]+(?:{_DOT}[\w%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}"),
    1: re.compile(r"[0-9]{1,3}(?:\s?(?:\.|[(\[]\.[)\]]|[(\[]dot[)\]])\s?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"),
    2: re.compile(r"[0-9]{4}([ .\-/])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([ .\-/])[0-9]{6}\2[0-9]{4,5}|[0-9]{13,19}"),
    3: re.compile(r"(?:\(?00\)?|\+)?[ .]?[0-9]{0,3}[ .\-/]?(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .\-/]?[0-9]{2,4}[ .\-/][0-9]{2,5}(?:[ .\-/][0-9]{2,4})*"),
    4: re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=.-]{16,}"),
}
_CUES = {
    0: re.compile(r"(?:e-?mail|mail|contact|write|reach)\W*(?:\w+\W+)?\Z", re.I),
    1: re.compile(r"(?:\bip|host|server|address|addr|ping)\W*(?:\w+\W+)?\Z", re.I),
    2: re.compile(r"(?:card|visa|mastercard|credit|debit|payment)\W*(?:\w+\W+)?\Z", re.I),
    3: re.compile(r"(?:phone|tel|telephone|call|mobile|cell|fax|dial|whatsapp|ring)\W*(?:\w+\W+)?\Z", re.I),
    4: re.compile(rf"{_SAID}[\"']?(?:\s*[:=]\s*|\s+)[\"'\u201c]?\Z", re.I),
}
#: What shows that a number, or an address, goes on to the left or to the right of a segment.
_ON = ((re.compile(r"[0-9][ .\-/(\[]*\Z"), re.compile(r"[ .\-/)\]]*[0-9]")), (re.compile(rf"[A-Za-z0-9]{_DOT}\Z"), re.compile(rf"{_DOT}[A-Za-z0-9]")))
#: What may be a secret: a long run of letters and digits, or what a word like password is set to.
_GROUPS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_RUNS = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_SET = re.compile(rf"{_SAID}[\"']?\s*[:=]\s*[\"']?([^\s\"',;<>()]{{6,}})", re.I)


def span_features(text: str, start: int, end: int, kind: int) -> list[str]:
    span, k = text[start:end], KINDS[kind]
    digits = sum(map(str.isdigit, span))
    out = [f"{k}", f"{k}:shape={_SHAPES[kind].fullmatch(span) is not None}", f"{k}:digits={min(digits, 20) // 2}"]
    cue = _CUES[kind].search(text[max(0, start - 24) : start]) is not None
    out.append(f"{k}:cue={cue}")
    before, after = text[start - 1 : start], text[end : end + 1]
    out.append(f"{k}:joined={before in ('.', '-', '+', '_', '/') and before != '' or (after in ('-', '_', '@', '/') and after != '')}")
    left, right = _ON[kind == 0]
    out.append(f"{k}:more={left.search(text[max(0, start - 12) : start]) is not None}{right.match(text[end : end + 12]) is not None}")
    if kind == 0:
        out.append(f"email:plain={'@' in span}")
    if kind == 1 and ":" not in span:
        out.append(f"ip:parts={all(int(p) <= 255 for p in re.findall('[0-9]{1,9}', span)[:8])}")
    if kind == 2:
        out.append(f"card:luhn={luhn(''.join(filter(str.isdigit, span)))}")
    if kind == 3:
        out += [f"phone:bracket={'(' in span and ')' in span}", f"phone:plus={span[0] in '+0'}", f"phone:seps={min(4, len(re.findall('[ ./-]', span)))}"]
    if kind == 4:
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
        out += [f"secret:hex={re.fullmatch('[0-9a-f]+|[0-9A-F]+', span) is not None}", f"secret:long={min(len(span), 48) // 8}", f"secret:mixed={min(4, changes // 2)}"]
        out += [f"secret:cases={span != span.lower() and span != span.upper()}", f"secret:slashes={min(2, span.count('/'))}", f"secret:cue+digits={cue and digits > 0}"]
    return out


def _addresses(text: str, tokens: list[tuple[int, int]]):
    """Mail addresses around each at sign, plain or spelled out: up to NAME_TOKENS before it, and a dot after it."""
    last = -1
    for at, (s, e) in enumerate(tokens):
        if text[s:e] not in ("@", "at", "AT"):
            continue
        begins = []
        for i in range(at - 1, max(last, at - NAME_TOKENS - 1), -1):
            a = tokens[i][0]
            if text[a] == "\n":
                break
            if (text[a].isalnum() or text[a] in "_%+-") and not (a and text[a - 1].isalnum()):
                begins.append(i)
        dot = False
        for j in range(at + 1, min(at + MAX_TOKENS, len(tokens))):
            piece = text[tokens[j][0] : tokens[j][1]]
            if piece in ("\n", "@"):
                break
            dot |= piece in (".", "dot", "DOT")
            if dot and piece.isalpha() and not text[tokens[j][1] : tokens[j][1] + 1].isalnum():
                yield from ((i, j + 1, 0) for i in begins if j + 1 - i <= MAX_TOKENS)
        last = at


def _numbers(text: str, tokens: list[tuple[int, int]]):
    """Addresses of hosts, cards and phones: digits with signs, blanks and brackets between, no words but dot."""
    for i, (s, _) in enumerate(tokens):
        first = text[s]
        if not (first.isdigit() or first in "+(") or (s and text[s - 1].isalnum()):
            continue
        digits = dots = 0
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            a, e = tokens[j]
            piece = text[a:e]
            if piece == "." or (piece == "dot" and text[a - 1] in "[("):
                dots += 1
            elif piece[0].isdigit():
                digits += e - a
                if digits > 19:
                    break
                if text[e : e + 1].isalnum():
                    continue
                if first.isdigit() and 4 <= digits <= 12 and dots == 3:
                    yield i, j + 1, 1
                if first.isdigit() and digits >= 13:
                    yield i, j + 1, 2
                if 7 <= digits <= 15:
                    yield i, j + 1, 3
            elif piece[0] == "\n" or piece[0].isalpha():
                break


def _runs(text: str, tokens: list[tuple[int, int]]):
    """Secrets, and addresses of eight groups, that begin and end with tokens."""
    starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
    spans = {(*m.span(), 4) for m in _RUNS.finditer(text, starts[0], ends[-1]) if any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0]))}
    spans |= {(*m.span(1), 4) for m in _SET.finditer(text, starts[0], ends[-1])}
    spans |= {(*m.span(), 1) for m in _GROUPS.finditer(text, starts[0], ends[-1])}
    for s, e, k in sorted(spans):
        i, j = bisect_left(starts, s), bisect_left(ends, e)
        if i < len(starts) and starts[i] == s and j < len(ends) and ends[j] == e:
            yield i, j + 1, k


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first token, past the last, kind) of whole-word segments that could be of a kind; their shape bounds their number."""
    return [*_addresses(text, tokens), *_numbers(text, tokens), *_runs(text, tokens)] if tokens else []


def _lattice(text: str, tokens: list[tuple[int, int]]):
    """(first token, past the last, kind, features) of all candidates among tokens."""
    return [(i, j, k, span_features(text, tokens[i][0], tokens[j - 1][1], k)) for i, j, k in candidates(text, tokens)]


def _triggers(text: str, begin: int, end: int):
    """(start, end) of what every candidate holds: digits, an at sign in any form, or what says that a secret follows."""
    for m in _TRIGGER.finditer(text, begin, end):
        s, c = m.start(), m[0][0]
        if c in "aA" and text[s - 1 : s] not in (" ", "(", "[", "{"):
            continue
        if c in ":=" and not _SAID_BEFORE.search(text[max(0, s - 16) : s]):
            continue
        yield s, m.end()


def _windows(text: str):
    """Lists of tokens that can be part of a candidate: within MAX_TOKENS of a trigger, in its line."""
    done = 0
    for s, _ in _triggers(text, 0, len(text)):
        if s < done:
            continue
        begin, end = text.rfind("\n", 0, s) + 1, text.find("\n", s)
        end = done = len(text) if end < 0 else end + 1
        tokens = [t.span() for t in _TOKENS.finditer(text, begin, end)]
        starts = [s for s, _ in tokens]
        spans: list[list[int]] = []
        for s, e in _triggers(text, begin, end):
            i, j = bisect_right(starts, s) - 1, bisect_left(starts, e)
            if spans and i - MAX_TOKENS <= spans[-1][1]:
                spans[-1][1] = j + MAX_TOKENS
            else:
                spans.append([max(0, i - MAX_TOKENS), j + MAX_TOKENS])
        yield from (tokens[i:j] for i, j in spans)


# ---------------------------------------------------------------- the field

def sentences(count: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled sentences: (text, spans as (start, kind, end)); two in five numbers or names in them are no personal data."""
    r = random.Random(seed)
    plain = "we saw the report of this year and then it was said that more of them came to the house near a river".split()
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    chars = lambda n, of: "".join(r.choice(of) for _ in range(n))
    small, every = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card() -> str:
        body = r.choice("3456") + d(14)
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = r.choice(["", " ", "-", ".", "/"])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        name = r.choice(["jo.smith", "ana", "k_lee", "info42", "john", "mary", "j.doe", "sales-team"])
        hosts = r.choice([["mail"], ["example"], ["corp-net"], ["mail", "example"], ["uni", "cs"]]) + r.choice([["com"], ["org"], ["net"], ["co", "uk"], ["de"]])
        at, dot = r.choice([("@", "."), (" at ", " dot "), (" (at) ", "."), ("[at]", "[dot]"), (" @ ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" AT ", " DOT ")])
        return f"{name if r.random() < 0.8 else name.replace('.', dot)}{at}{dot.join(hosts)}"

    def phone() -> str:
        return r.choice(["({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "+1 ({a}) {b}-{c}", "00{x} {a} {b} {c}", "{a} {b} {c}", "+{x} {a} {b}{c}", "0{a}/{b}{c}", "1-{a}-{b}-{c}"]).format(a=d(3), b=d(3), c=d(4), x=d(2))

    def ip() -> str:
        if r.random() < 0.3:
            return ":".join(chars(r.choice([1, 3, 4, 4, 4]), "0123456789abcdef") for _ in range(8))
        return r.choice([".", " . ", "[.]", "[dot]"]).join(str(r.randrange(256)) for _ in range(4))

    def secret() -> str:
        return r.choice([chars(40, "0123456789abcdef"), chars(32, "0123456789abcdef"), chars(64, "0123456789abcdef"), "sk-" + chars(32, every), "ghp_" + chars(36, every), "AKIA" + chars(16, small.upper()), chars(24, every) + "==", chars(8, small) + d(2), chars(40, every)])

    def other() -> str:
        return r.choice([
            f"{d(4)}-{d(2)}-{d(2)}", d(2) + "/" + d(2) + "/" + d(4), d(5), f"{d(2)}:{d(2)}:{d(2)}", f"{d(3)},{d(3)},{d(3)}", f"v{d(1)}.{d(2)}.{d(1)}.{d(3)}", f"{d(8)}", f"{d(16)}", f"No. {d(6)}-{d(4)}", f"{d(1)}.{d(4)} {d(1)}.{d(4)} {d(1)}.{d(4)}",
            f"{d(4)} {d(4)}", "1 2 3 4 5 6 7 8", "see you at the dot on the map", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}{d(2)}", f"{d(4)}\u2013{d(4)}", f"id{d(9)}", f"order {d(4)}-{d(2)}-{d(2)} {d(7)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            f"https://example.org/{chars(6, small)}/{d(4)}/{d(2)}/page", f"see section{d(2)} at page {d(3)} dot", f"isn't-a-key-{chars(4, 'abc')}-word", f"antidisestablishmentarianism{d(1)}", "look at this. Then go", f"the key: {r.choice(plain)} things", f"file_name_version_{d(2)}.txt", f"{d(2)} of {d(3)} in {d(4)}", f"rev {chars(7, '0123456789abcdef')}",
        ])

    make = (email, ip, card, phone, secret)
    cues = (("mail", "contact"), ("ip", "server"), ("card", "visa"), ("phone", "call", "tel:"), ("token =", "api_key:", "secret =", "password:", "key ="))
    out = []
    for n in range(count):
        text, spans = "", []
        for _ in range(1 + n % 2):
            text += " ".join(r.choice(plain) for _ in range(r.randrange(2, 6))) + " "
            if r.random() < 0.4:
                text += other() + " "
            else:
                k = r.randrange(len(make))
                said = r.random() < 0.5 or k == 4
                text += r.choice(cues[k]) + " " if said else ""
                s = make[k]()
                quote = r.choice(['"', "'", ""]) if k == 4 else ""
                text += quote
                spans.append((len(text), k, len(text) + len(s)))
                text += s + quote + r.choice([" ", ". ", ", "])
        out.append((text + r.choice(plain), spans))
    return out


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def _after(last: int, label: int) -> str:
    """The feature of a segment that follows another one; a place outside is a segment of one token."""
    return f"{last}>{label}"


LABELS = range(OUTSIDE + 1)


def marginals(n: int, segments, score: list[float], w: dict[str, float]):
    """(log of the sum over all segmentations of n tokens, each segment's probability, the expected number of each pair of labels)."""
    step = [[w.get(_after(a, b), 0.0) for b in LABELS] for a in LABELS]
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for at, (i, j, *_) in enumerate(segments):
        ends.setdefault(j, []).append(at)
        starts.setdefault(i, []).append(at)
    none = -math.inf
    forward = [[none] * (OUTSIDE + 1) for _ in range(n + 1)]  # by the last segment's label
    forward[0][OUTSIDE] = 0.0
    into = {}  # the sum before a segment, of all labels before it
    for j in range(1, n + 1):
        forward[j][OUTSIDE] = _logsum([forward[j - 1][a] + step[a][OUTSIDE] for a in LABELS])
        by: dict[int, list[float]] = {}
        for at in ends.get(j, ()):
            i, k = segments[at][0], segments[at][2]
            into[at] = _logsum([forward[i][a] + step[a][k] for a in LABELS])
            by.setdefault(k, []).append(into[at] + score[at])
        for k, values in by.items():
            forward[j][k] = _logsum(values)
    backward = [[none] * (OUTSIDE + 1) for _ in range(n + 1)]  # of what follows a segment of that label
    backward[n] = [0.0] * (OUTSIDE + 1)
    for i in range(n - 1, -1, -1):
        outs = [(OUTSIDE, backward[i + 1][OUTSIDE]), *((segments[a][2], score[a] + backward[segments[a][1]][segments[a][2]]) for a in starts.get(i, ()))]
        backward[i] = [_logsum([step[a][k] + v for k, v in outs]) for a in LABELS]
    total = _logsum(forward[n])
    pairs: dict[tuple[int, int], float] = {}
    chance = []
    for at, (i, j, k, *_) in enumerate(segments):
        rest = score[at] + backward[j][k] - total
        chance.append(math.exp(min(0.0, into[at] + rest)))
        for a in LABELS:
            if forward[i][a] > none:
                pairs[a, k] = pairs.get((a, k), 0.0) + math.exp(min(0.0, forward[i][a] + step[a][k] + rest))
    for i in range(n):
        for a in LABELS:
            if forward[i][a] > none:
                pairs[a, OUTSIDE] = pairs.get((a, OUTSIDE), 0.0) + math.exp(min(0.0, forward[i][a] + step[a][OUTSIDE] + backward[i + 1][OUTSIDE] - total))
    return total, chance, pairs


def best(n: int, segments, score: list[float], w: dict[str, float]) -> list[int]:
    """The segments of the best segmentation; of equal ones the one with fewer segments from the right."""
    step = [[w.get(_after(a, b), 0.0) for b in LABELS] for a in LABELS]
    ends: dict[int, list[int]] = {}
    for at, (_, j, *_) in enumerate(segments):
        ends.setdefault(j, []).append(at)
    none = -math.inf
    value = [[none] * (OUTSIDE + 1) for _ in range(n + 1)]
    back: list[list] = [[None] * (OUTSIDE + 1) for _ in range(n + 1)]
    value[0][OUTSIDE] = 0.0
    for j in range(1, n + 1):
        last = max(LABELS, key=lambda a: (value[j - 1][a] + step[a][OUTSIDE], a))
        value[j][OUTSIDE], back[j][OUTSIDE] = value[j - 1][last] + step[last][OUTSIDE], (j - 1, last, None)
        for at in ends.get(j, ()):
            i, k = segments[at][0], segments[at][2]
            last = max(LABELS, key=lambda a: (value[i][a] + step[a][k], a))
            if (v := value[i][last] + step[last][k] + score[at]) > value[j][k]:
                value[j][k], back[j][k] = v, (i, last, at)
    out, j = [], n
    label = max(LABELS, key=lambda a: (value[n][a], a))
    while j > 0:
        j, label, at = back[j][label]
        if at is not None:
            out.append(at)
    return out[::-1]


def fit(rows, epochs: int = 8, rate: float = 0.3, penalty: float = 1e-3) -> dict[str, float]:
    """Weights of greatest likelihood, by adaptive gradient steps."""
    w: dict[str, float] = {}
    square: dict[str, float] = {}
    data = []
    for text, spans in rows:
        tokens = [m.span() for m in _TOKENS.finditer(text)]
        segments, gold = _lattice(text, tokens), set(spans)
        right = {n for n, (i, j, k, _) in enumerate(segments) if (tokens[i][0], k, tokens[j - 1][1]) in gold}
        truth: dict[tuple[int, int], int] = {}
        at, last, begin = 0, OUTSIDE, {segments[n][0]: segments[n] for n in right}
        while at < len(tokens):
            end, label = (begin[at][1], begin[at][2]) if at in begin else (at + 1, OUTSIDE)
            truth[last, label] = truth.get((last, label), 0) + 1
            at, last = end, label
        data.append((len(tokens), segments, right, truth))
    for _ in range(epochs):
        for n, segments, right, truth in data:
            score = [sum(w.get(f, 0.0) for f in fs) for *_, fs in segments]
            _, chance, pairs = marginals(n, segments, score, w)
            gradient: dict[str, float] = {}
            for a, (*_, fs) in enumerate(segments):
                g = (a in right) - chance[a]
                if abs(g) > 1e-6:
                    for f in fs:
                        gradient[f] = gradient.get(f, 0.0) + g
            for pair in {*truth, *pairs}:
                if pair != (OUTSIDE, OUTSIDE):  # what all others are measured by
                    gradient[_after(*pair)] = truth.get(pair, 0) - pairs.get(pair, 0.0)
            for f, g in gradient.items():
                g -= penalty * w.get(f, 0.0)
                square[f] = square.get(f, 0.0) + g * g
                w[f] = w.get(f, 0.0) + rate * g / math.sqrt(square[f] + 1e-8)
    return w


@functools.cache
def weights() -> dict[str, float]:
    return fit(sentences(700))


def added_spans(text: str, w: dict[str, float], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best segmentation that overlap no span in taken. Reads the lines that hold a digit, a sign or a word that a secret follows; nothing else can be a candidate."""
    out = []
    for tokens in _windows(text):
        segments = _lattice(text, tokens)
        if segments:
            score = [sum(w.get(f, 0.0) for f in fs) - MARGIN for *_, fs in segments]
            out += [(tokens[i][0], k, tokens[j - 1][1]) for i, j, k, _ in (segments[a] for a in best(len(tokens), segments, score, w))]
    starts = sorted(taken)
    reach = np.maximum.accumulate([e for _, _, e in starts]) if starts else []
    free = []
    for s, k, e in set(out):
        n = bisect_left(starts, (e,))
        if n == 0 or reach[n - 1] <= s:
            free.append((s, k, e))
    return sorted(free)


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:BASE]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("n_added", pa.int64()), ("n_spans", pa.int64())])


def _find(batches, w):
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
            base = base_spans(text)
            added = added_spans(text, w, base)
            counts = [sum(k == n for _, k, _ in base) for n in range(BASE)]
            secrets = sum(k == BASE for _, k, _ in added)
            rows.append((doc, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), secrets, len(added), len(base) + len(added)))
        if rows:
            yield batch(_OUT, *zip(*rows))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans (all, in order of start), n_secret, n_added, n_spans for every row of docs (doc_id, text).

    Null text counts as empty and has no spans. Repeated rows each give a row, equal texts equal
    values. Long texts are read whole, in time that grows with their length. An empty table gives an
    empty result. Other columns are ignored.
    """
    tuned(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    kinds = {pa.int64(): "long", pa.string(): "string"}
    return rows.mapInArrow(functools.partial(_find, w=weights()), ", ".join(f"{f.name} {kinds[f.type]}" for f in _OUT))
