"""Personal data: fixed base patterns, and candidates that boosted trees judge.

There are no labels for personal data, so the trees learn from candidates made by rule: formats of each
kind in telling and in misleading contexts, from a fixed seed. A part that the trees haven't seen calibrates
their margins and sets each kind's threshold.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import itertools
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import bounded_batches, owns_memory
from .labelled import Logistic

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_words", "ipv6", "national_id", "iban", "phone_local", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: A kind's threshold is the least score from which this share of its calibration candidates is right.
PRECISION = 0.98
#: Candidates of one text that are judged at a time.
CHUNK = 4_096

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: Digits joined by single dots, whole runs: an address is four numbers of one, and runs are scanned once.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(numbers: list[int]) -> bool:
    total = sum(numbers[-1::-2])
    for d in numbers[-2::-2]:
        total += 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _octet(number: str) -> bool:
    kept = number.lstrip("0")
    return len(kept) <= 3 and int(kept or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The base kinds' spans, each kind leftmost and non-overlapping, failing matches dropped."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for run in _DOTTED.finditer(text) if "." in text else ():
            parts = [m.span() for m in _NUMBER.finditer(text, *run.span())]
            for four in zip(parts[::4], parts[1::4], parts[2::4], parts[3::4]):  # what is left over is no address
                if all(_octet(text[a:b]) for a, b in four):
                    out.append((four[0][0], four[3][1], "ip"))
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=_by_place)


def _by_place(s: Span):
    return s[0], _ORDER[s[2]], s[1]


#: Generators of the added kinds; what they propose may overlap and is often wrong.
_AT_WORD = re.compile(r"[(\[{<][Aa][Tt][)\]}>]|\s[Aa][Tt]\s")
_DOMAIN_WORDS = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s?[(\[{<]dot[)\]}>]\s?|\sdot\s)[A-Za-z0-9-]++)++", re.I)
_NUMERIC = {
    "ipv6": re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){3,}+(?![0-9A-Za-z:])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "phone_local": re.compile(r"(?<![0-9A-Za-z+.(-])\(?0?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])"),
}
#: Numbers with an area code that begins by zero, in one or more groups of any even look.
_PHONE_ZERO = re.compile(r"(?<![0-9A-Za-z+.(/-])\(?0[0-9]{1,4}\)?(?:[ ./-][0-9]{2,8}){1,5}+(?![0-9A-Za-z-])")
#: Addresses with '::' for zeros, also at either end.
_IPV6_SHORT = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z]|:[0-9A-Fa-f:])")
#: Of any length, with digits or without; and tokens of three and more parts joined by dots.
_SECRET = re.compile(r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{20,}+")
_SECRET_PARTS = re.compile(r"(?<![0-9A-Za-z_.-])[0-9A-Za-z_-]{8,}+(?:\.[0-9A-Za-z_-]{8,}+){2,}+")
#: Values of any look that a name gives away, from SAID characters on.
SAID = 6
_SECRET_SAID = re.compile(r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential)s?[\"']?(?:\s?(?:[:=]|=>|:=)\s?|\sis\s)[\"'`]?([^\s\"'`<>,;()\[\]{}]{%d,}+)" % SAID, re.I)
#: What one of them has in it. Fixed values.
_SAID_BY = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential")


def _addresses(text: str) -> list[Span]:
    """Mail addresses with 'at' and 'dot' in words, leftmost and non-overlapping."""
    out, done = [], 0
    for at in _AT_WORD.finditer(text):
        end, after = at.span()
        if not text[end].isspace():  # brackets may stand apart
            end -= text[end - 1 : end].isspace()
            after += text[after : after + 1].isspace()
        start = end
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < end and (m := _DOMAIN_WORDS.match(text, after)):
            out.append((start, m.end(), "email_words"))
            done = m.end()
    return out


def candidates(text: str) -> list[Span]:
    out = _addresses(text)
    if _DIGIT.search(text):
        for kind, pattern in _NUMERIC.items():
            if kind == "ipv6" and ":" not in text:
                continue
            out += [(*m.span(), kind) for m in pattern.finditer(text)]
        known = set(out)
        out += [s for m in _PHONE_ZERO.finditer(text) if 7 <= len(digits(m.group())) <= 13 and (s := (*m.span(), "phone_local")) not in known]
    if "::" in text:
        known = set(out)
        out += [s for m in _IPV6_SHORT.finditer(text) if m.end() - m.start() > 2 and (s := (*m.span(), "ipv6")) not in known]
    out += [(*m.span(), "secret") for m in _SECRET.finditer(text)]
    if "." in text:
        out += [(*m.span(), "secret") for m in _SECRET_PARTS.finditer(text)]
    known, low = set(out), text.lower()
    for m in _SECRET_SAID.finditer(text) if any(w in low for w in _SAID_BY) else ():
        end = m.end(1) - (text[m.end(1) - 1] in ".:?")  # what ends a sentence is no part
        if (s := (m.start(1), end, "secret")) not in known:
            out.append(s)
    return out


#: Words before a candidate that speak for or against it. Fixed values.
_FOR = ("mail", "contact", "phone", "tel", "call", "fax", "mobile", "token", "key", "secret", "passw", "auth", "ssn", "password", "pwd", "aws", "credential", "social", "iban", "account", "host", "addr", "reach", "bearer", "login")
_AGAINST = ("version", "isbn", "order", "invoice", "commit", "sha", "date", "page", "price", "chapter", "build", "checksum", "ref", "serial", "time", "lot", "md5", "row", "figure", "score")
CONTEXT = 32
#: Runs that words and names written as one have otherwise than random letters.
_LOWER, _CONSONANTS = re.compile(r"[a-z]+"), re.compile(r"[b-df-hj-np-tv-xz]+", re.I)


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    start, end, kind = span
    s, before, after = text[start:end], text[max(0, start - CONTEXT) : start].lower(), text[end : end + 2]
    d = digits(s)
    letters = sum(c.isalpha() for c in s)
    counts = Counter(s)
    entropy = -sum(n / len(s) * np.log2(n / len(s)) for n in counts.values())
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", s) if g] or [0]
    last = before.rstrip(" \t\"'([=:")
    return [
        *(kind == k for k in ADDED_KINDS), len(s), len(d), letters, len(s) - len(d) - letters, len(d) / len(s), entropy, len(counts) / len(s),
        len(groups), max(groups), min(groups), groups[0], groups[-1], "(" in s, s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count("_"),
        all(c in "0123456789abcdefABCDEF" for c in s), any(c.isupper() for c in s), any(c.islower() for c in s), _checks(kind, s),
        sum(w in before for w in _FOR), sum(w in before for w in _AGAINST), last.endswith(_FOR), last.endswith(_AGAINST),
        sum(a.islower() != b.islower() for a, b in zip(s, s[1:])) / len(s), sum(counts[c] for c in "aeiouAEIOU") / len(s),
        sum(a.isupper() and b.isupper() for a, b in zip(s, s[1:])) / len(s), max(map(len, _LOWER.findall(s)), default=0), max(map(len, _CONSONANTS.findall(s)), default=0),
        "=" in before[-4:], ":" in before[-4:], bool(before) and before[-1] in "\"'", bool(after) and after[0] in "\"'", before[-1:] in ("", "\n"),
    ]


def _checks(kind: str, s: str) -> bool:
    if kind == "iban":
        code = "".join(s.split())
        return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    if kind == "national_id":
        return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[-4:] != "0000"
    if kind == "ipv6":
        try:
            return bool(ipaddress.IPv6Address(s))
        except ValueError:
            return False
    return False


def _made(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, truth and kind of n made candidates, half of them right."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "on", "th", "es", "lo", "mi", "ra", "tu", "be")) for _ in range(r.randint(1, 4)))
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"

    def iban(valid: bool) -> str:
        country, body = pick("DEFRESITNL", 2), pick("0123456789", r.choice((12, 14, 16, 18)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        code = f"{country}{check if valid else (check + r.randint(1, 90)) % 97:02d}{body}"
        return code if r.random() < 0.5 else " ".join(code[i : i + 4] for i in range(0, len(code), 4))

    def short() -> str:
        """An address with '::' in place of its zeros."""
        groups = lambda k: ":".join(pick(hexes, r.randint(1, 4)) for _ in range(k))
        head = r.choice(("fe80", "2001:db8", f"2001:{groups(1)}", f"fd{pick(hexes, 2)}:{groups(2)}", "", groups(r.randint(1, 4))))
        return f"{head}::{r.choice(('', *'123456789')) if head and r.random() < 0.4 else groups(r.randint(1, 3))}"

    letters = mixed[:52]
    onsets, codas = (*"bcdfghjklmnprstvwyz", "pr", "st", "tr", "ch", "sh", "br", "pl", "cr", "str", "th", ""), ("", "", "", *"nrstlm", "ct", "cts", "nd", "st", "ck", "ng", "rd", "ld", "ss")
    said = lambda: "".join(r.choice(onsets) + r.choice(("a", "e", "i", "o", "u", "ea", "ou")) + r.choice(codas) for _ in range(r.randint(1, 3)))
    words = lambda join, low, high: r.choice(("", "", join)) + join.join(said() for _ in range(r.randint(low, high)))
    camel = lambda: "".join(said().capitalize() for _ in range(r.randint(6, 12)))

    def secret() -> str:
        kind = r.random()
        if kind < 0.15:  # parts of a signed token, the first often the code of a brace and a quote
            return ".".join((r.choice(("eyJ", "")) + pick(mixed, r.randint(12, 60)), r.choice(("eyJ", "")) + pick(mixed, r.randint(20, 400)), pick(mixed, r.randint(20, 90))))
        if kind < 0.45:
            return pick(hexes, r.choice((32, 40, 64, 128, 256)))
        if kind < 0.7:
            return pick(mixed, r.randint(20, 48))
        return pick(mixed, r.randint(100, 900)) if kind < 0.85 else pick(r.choice((letters, letters[:26], letters[26:])), r.randint(20, 64))

    def marked() -> str:
        """Tokens whose first letters name who gave them."""
        mark, chars, size = r.choice((("AKIA", mixed[:26] + "234567", 16), ("ASIA", mixed[:26] + "234567", 16), ("ghp_", mixed[:62], 36), ("sk_live_", mixed[:62], 24), ("xoxb-", "0123456789-", 24), ("AIza", mixed, 35), ("glpat-", mixed, 20)))
        return mark + pick(chars, size)

    def password() -> str:
        """Short ones as people choose them: words with digits, signs or capitals in them, or a few random characters."""
        if r.random() < 0.4:
            return pick(mixed[:62] + "!#$%&*+?@^", r.randint(7, 16))
        base = "".join(said() for _ in range(r.randint(2, 3)))
        if r.random() < 0.5:
            base = "".join({"o": "0", "e": "3", "a": "4", "i": "1", "s": "5"}.get(c, c) if r.random() < 0.7 else c for c in base) + num(1)
        else:
            base = base.capitalize() + num(r.randint(1, 4))
        return (base + r.choice(("", "!", "#", "$", "!x", "_", "*"))).ljust(SAID, "7")

    unset = lambda: r.choice((said() * 2 + said(), "required", "optional", "unsetting", "forever", "expired", "missing", "invalid", "disabled", f"os.environ.{said()}{said()}", f"config.{said()}.{said()}", "********", "xxxxxxxx", f"{said()}{said()}_{said()}", f"$ENV_{said().upper()}", "/" + "/".join(said() for _ in range(r.randint(2, 5)))))
    dialled = lambda: r.choice((f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(2)} {num(7)}", f"0{num(3)}/{num(6)}", f"0{num(3)} {num(6)}", f"(0{num(2)}) {num(7)}", f"0{num(1)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}", f"0{num(4)} {num(6)}", f"0{num(2)}-{num(4)} {num(4)}"))

    plain = (
        lambda: words("-", 5, 9), lambda: words("/", 5, 12), lambda: words("/", 5, 9), lambda: words("_", 5, 12), lambda: words("", 6, 10), camel, lambda: words("_", 5, 12).upper(),
        lambda: ".".join("".join(said() for _ in range(r.randint(4, 6))) for _ in range(r.randint(3, 6))), lambda: ".".join(camel() for _ in range(3)), lambda: words("/", 40, 90), lambda: words("", 50, 90), lambda: r.choice("-_/+ax") * r.randint(20, 300), lambda: num(r.randint(100, 400)), lambda: r.choice(("ha", "la", "ab-", "+-", "no")) * r.randint(10, 90),
    )

    right = {
        "email_words": (lambda: f"{r.choice((f'{word()}.{word()}', f'{word()}{num(2)}', word(), pick(hexes[10:], 1)))}{r.choice((' at ', ' [at] ', '(at)', ' (at) '))}{r.choice((word(), word(), f'{word()}-{word()}', pick(hexes[10:], 1)))}{r.choice((' dot ', ' [dot] ', '(dot)', '.'))}{r.choice(('com', 'org', 'net', 'de', 'fr'))}", ("mail", "contact", "write to", "reach me:", "e-mail:", "")),
        "ipv6": (lambda: ":".join(pick(hexes, r.randint(1, 4)) for _ in range(8)) if r.random() < 0.5 else short(), ("host", "addr", "from", "server", "")),
        "national_id": (lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", ("ssn", "ssn:", "social security", "social security number", "")),
        "iban": (lambda: iban(True), ("iban", "account", "iban:", "pay to", "")),
        "phone_local": (lambda: r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(3)} {num(4)}", dialled(), dialled())), ("phone", "tel", "tel:", "call", "call me at", "mobile", "fax:")),
        "secret": (secret, ('token = "', 'api_key = "', "secret: ", 'password="', "auth: ", "bearer ", 'key="')),
    }
    wrong = {
        "email_words": (lambda: f"{word()} at {word()}{r.choice((' dot ', '.'))}{word()}", ("look", "the", "stood", "a", "was")),
        "ipv6": (lambda: ":".join(f"{r.randint(0, 59):02d}" for _ in range(r.choice((4, 5)))) if r.random() < 0.5 else r.choice((lambda: f"{pick('abcdefABCDEF', r.randint(1, 4))}::{pick('abcdefABCDEF', r.randint(1, 4))}", lambda: f"{pick('abcdef', r.randint(1, 4))}::", lambda: f"::{pick('abcdefABCDEF', r.randint(1, 4))}", lambda: f"{num(r.randint(1, 2))}::{num(r.randint(1, 2))}"))(), ("time", "at", "date", "row", "see", "type", "using", "class", "")),
        "national_id": (lambda: r.choice((f"{r.choice(('000', '666', '9' + num(2)))}-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}")), ("order", "ref", "lot", "serial", "invoice")),
        "iban": (lambda: iban(False) if r.random() < 0.7 else f"{pick('ABCDEFG', 2)}{num(2)} {pick('ABCDEFGHIJ0123', 4)} {pick('ABCDEFG012', 4)}", ("serial", "ref", "build", "order", "lot", "")),
        "phone_local": (lambda: r.choice((f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(4)} {num(4)} {num(4)}", dialled(), f"0{num(1)} {num(2)} {num(2)} {num(2)}", f"0{num(1)}.{num(2)}.{num(4)}", f"0{num(1)}/{num(2)}/{num(4)}")), ("version", "price", "order", "isbn", "score", "row", "ref", "the", "page")),
        "secret": (lambda: r.choice((lambda: pick(hexes, r.choice((32, 40, 64, 128))), r.choice(plain), r.choice(plain), lambda: f"{word()}-{word()}-{word()}-{word()}-{word()}-{word()}-{r.randint(1, 99)}", lambda: f"{word()}/{word()}/{word()}_{word()}/{word()}{num(2)}", lambda: num(r.randint(20, 40)), lambda: word() * 3 + word() * 2 + "abcdefghij" + num(1)))(), ("commit ", "sha ", "checksum: ", "md5 ", "build ", "see ", "the ", "page ", "")),
    }
    said_by = ('password = "', "password: ", "pwd=", "passwd: ", "secret: ", 'secret = "', "token=", 'token: "', "api_key = ", "passphrase: ", "the password is ", "Password: ")
    x, y, kinds = [], [], []
    for i in range(n):
        kind, truth = ADDED_KINDS[i % len(ADDED_KINDS)], (i // len(ADDED_KINDS)) % 2 == 0
        make, cues = (right if truth else wrong)[kind]
        if kind == "secret" and not truth and r.random() < 0.3:  # words, paths and rules aren't secrets anywhere
            make, cues = r.choice(plain), right[kind][1]
        cue = r.choice(cues)
        if kind == "secret" and r.random() < 0.3:  # short ones are proposed only where a name gives them away
            make, cue = (marked if r.random() < 0.3 else password) if truth else unset, r.choice(said_by)
            cue = r.choice((cue, "aws ", "key ", "")) if make is marked else cue
        if kind == "email_words" and truth and r.random() < 0.2:
            make = lambda f=make: f().upper()
        lead = " ".join(word() for _ in range(r.randint(0, 6)))
        head = f"{lead} {cue}".strip()
        head += "" if not head or head[-1] in ' "' else " "
        if truth and cue == "" and kind == "phone_local":
            continue
        body = make()
        text = head + body + ('"' if head.endswith('"') else "") + r.choice((" ", ". ", ", ", "\n", "")) + word()
        x.append(features(text, (len(head), len(head) + len(body), kind)))
        y.append(truth)
        kinds.append(ADDED_KINDS.index(kind))
    return np.array(x, float), np.array(y, float), np.array(kinds)


class Model:
    def __init__(self):
        x, y, _ = _made(1, 12_000)
        self.trees = BoostedTrees(x, y, trees=80)
        x, y, kinds = _made(2, 6_000)
        margins = self.trees.margins(x)[:, None]
        self.curve = Logistic(margins, y, np.ones(len(y)), ridge=1e-2)
        score = self.curve(margins)
        self.thresholds = {k: _threshold(score[kinds == i], y[kinds == i]) for i, k in enumerate(ADDED_KINDS)}

    def judged(self, text: str) -> list[tuple[float, Span]]:
        """Candidates that reach their kind's threshold, with their scores, but those inside another such of their kind."""
        out, proposed = [], candidates(text)
        for k in range(0, len(proposed), CHUNK):  # bounds the features of a very long text
            part = proposed[k : k + CHUNK]
            scores = self.curve(self.trees.margins(np.array([features(text, s) for s in part], float))[:, None])
            out += [(score, s) for score, s in zip(scores.tolist(), part, strict=True) if score >= self.thresholds[s[2]]]
        out.sort(key=lambda p: (p[1][0], -p[1][1]))
        reach: dict[str, int] = {}
        whole = []
        for score, (start, end, kind) in out:
            if end > reach.get(kind, -1):
                whole.append((score, (start, end, kind)))
                reach[kind] = end
        return whole

    def __call__(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans): base ones stay, judged candidates join where nothing overlaps them, those with a right check number first, then the best."""
        base = base_spans(text)
        good = self.judged(text)
        if not good:
            return base, base
        chosen = list(base)
        taken = [*itertools.chain.from_iterable(_united(base))]  # starts and ends in turn, all apart
        for _, (start, end, kind) in sorted(good, key=lambda p: (p[1][2] != "iban" or not _checks("iban", text[p[1][0] : p[1][1]]), -p[0], p[1])):
            at = bisect.bisect_right(taken, start)
            if at % 2 == 0 and (at == len(taken) or end <= taken[at]):
                taken[at:at] = [start, end]
                chosen.append((start, end, kind))
        return base, sorted(chosen, key=_by_place)


def _united(spans: list[Span]) -> list[tuple[int, int]]:
    """The stretches that spans, sorted by start, cover; those that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _threshold(score: np.ndarray, truth: np.ndarray) -> float:
    order = np.argsort(-score)
    right = truth[order].cumsum() / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    return float(max(0.5, score[order[good[-1]]])) if len(good) else 1.1


@cache
def model() -> Model:
    """Trained once, in the driver, and broadcast (some 100 KB), so that all executors judge alike."""
    return Model()


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the name of its first kind."""
    out, done, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join(out) + text[done:] if out else text


def _find(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("pii", None)
        judge = held.value
        for batch in batches:
            counts, base_out, out = [[] for _ in BASE_KINDS], [], []
            for text in batch.column(1):
                base, spans = judge(text.as_py() or "")
                n = Counter(k for _, _, k in base)
                for column, kind in zip(counts, BASE_KINDS, strict=True):
                    column.append(n[kind])
                base_out.append(hashlib.sha256(written(base).encode()).hexdigest())
                out.append(written(spans))
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(base_out, pa.string()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans ("kind:start:end,...").

    Whole texts; offsets are code points, ends are exclusive; spans sort by start, then by the order of KINDS.
    Null and empty texts have no spans. One row for each row of docs; only the named columns are read.
    """
    bounded_batches(docs.sparkSession)
    columns = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(model())), f"doc_id {docs.schema[id_col].dataType.simpleString()}, {columns}, base_sha256 string, spans string")


def redact_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, whole, with all spans of text_col replaced by [KIND]; a null text stays null."""
    bounded_batches(docs.sparkSession)
    at, held = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns_memory("pii", None)
        judge = held.value
        for batch in batches:
            texts = [t if t is None else redact(t, judge(t)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
