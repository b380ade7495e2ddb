"""Operator 2: personal data by base patterns and a semi-Markov conditional random field.

Base spans are exact matches of four patterns (email, ip, card, phone) with their checks.  The random field
adds spans that the patterns miss: obfuscated or ill-formed addresses and numbers, and secrets.  Around
each trigger (a digit, ``@``, or the words "at"/"dot", in brackets or between words of a host) a window of tokens is cut.  Every
run of up to ``MAX_TOKENS`` tokens (``WORD_TOKENS`` where words are among them) that holds a trigger, and every spelt address however long, is a candidate segment of each kind, scored by
features of the whole span (shape, digits, groups, separators, octets, Luhn, neighbours), and
a dynamic programme over segment ends chooses boundaries and kinds of the window together, with tokens outside
segments free.  Base spans are barriers: they always stay, and segments lie between them.  Windows of a long run of triggers
overlap, and a segment belongs to the window that holds it whole.

The field is trained by gradient ascent on the conditional log likelihood (segment-level forward and backward
sums) over at most ``TRAIN_WINDOWS`` windows of a hash sample of about ``TRAIN_ROWS`` documents (documented bounds): of each
document, wherever in its text they stand, one span of each kind and ``TRIGGERS_A_TEXT`` other triggers, chosen by hash; of all
those at most ``KIND_SNIPPETS`` for each kind come first, so that rare kinds are learnt too, and the other triggers fill up.  One task trains.
Of a snippet at most four spans and one secret are shown, and windows of more than 80 tokens are not (bounds too).
There are no labels, so base spans and strong secrets (long hexadecimal runs, keys with an issuer's prefix; some are made up) serve as the truth; every
base span is also shown once in a damaged spelling that keeps its label, which teaches what the patterns
cannot match; an address is shown in nine, with fewer and more parts and without digits.  A word, "at" and a host
name count as an address ("look at example.com" too).  The sample decides weights only; every whole text is searched.

Defined results: null and blank texts have no spans; offsets are code points, ends exclusive; repeated rows
are searched one by one; null ids are carried; an empty table gives an empty result; without any
trigger in the sample no weights exist and only base spans are found.  All patterns are searched in
time linear in the text, long runs of digits or letters included.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from framesift.llm.arrow import map_rows
from framesift.llm.words import hash_share

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["secret"]
LABELS = [*KINDS, *ADDED]
#: The longest candidates: of numbers and marks, and of those with words that are no whole address.
MAX_TOKENS, WORD_TOKENS = 24, 9
MARGIN = 3
TRAIN_ROWS = 4000
TRAIN_WINDOWS = 1000
KIND_SNIPPETS = 40
TRIGGERS_A_TEXT = 4
EPOCHS = 14
BITS = 14

SPANS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()),
    T.StructField("base", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("added", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each ``@`` outward."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four patterns, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(DIGIT.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\w")
AT_MARK = r"(?:\s*+[\[({<]\s?at\s?[\])}>]\s*+|\s++at\s++|\s?@\s?)"
DOT_MARK = r"(?:\.|\s++\.\s++|\s*+[\[({<]\s?dot\s?[\])}>]\s*+|\s++dot\s++)"
#: A bare "at" counts where a host follows, that is a word, a dot in any spelling and another word.
TRIGGER = re.compile(rf"[0-9@]|[\[({{<]\s?(?:at|dot)\s?[\])}}>]|(?<=\s)at(?=\s++[\w-]++{DOT_MARK}\w)|(?<=\s)dot(?=\s++\w)", re.I)
#: An address whose marks are signs, words or words in brackets; its last part has letters only.
ADDRESS = re.compile(rf"[\w%+-]++(?:{DOT_MARK}[\w%+-]++)*{AT_MARK}[\w-]++(?:{DOT_MARK}[\w-]++)*{DOT_MARK}[^\W\d_]{{2,}}(?![\w-])", re.I)
#: A word, a bare "at" and a host with a plain dot ("look at example.com"): a place rather than an address, unless the local part has more than letters.
LOOK_AT = re.compile(r"[^\W\d_]+\s+at\s+[\w-]+(?:\.[\w-]+)+", re.I)
#: Last parts of hosts; those of countries have two letters.
SUFFIXES = frozenset("com org net edu gov mil int info biz name pro".split())
#: What stands before a span that begins within an address.
WITHIN = re.compile(rf"[\w%+-](?:{DOT_MARK})?\Z", re.I)
#: Strong secrets: long hexadecimal runs, and keys whose issuers give them a prefix.
SECRET = re.compile(r"[0-9A-Fa-f]{24,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:[sprk]k|whsec)_(?:(?:live|test)_)?[0-9A-Za-z]{16,}|gh[a-z]_[0-9A-Za-z]{30,}|glpat-[0-9A-Za-z]{20,}|xox[a-z]-[0-9A-Za-z]{10,}(?:-[0-9A-Za-z]{10,})*")
#: What makes a number a part of a longer one.
CUT_BEFORE, CUT_AFTER = re.compile(r"[0-9][-./,:]?\Z"), re.compile(r"[-./,:]?[0-9]")
#: Digits in groups with a phone number's marks between them.
GROUPED = re.compile(r"\(?[0-9]++\)?(?:(?:\s?[-./]\s?|\s)?\(?[0-9]++\)?)*+")


class Window:
    """Tokens (start, end) around triggers, free of base spans; ``hot``: which tokens hold a trigger; segments that begin
    from ``low`` on and before ``high`` are this window's."""

    __slots__ = ("ends", "high", "hot", "low", "starts", "text")

    def __init__(self, text: str, starts: list[int], ends: list[int], hot: list[bool], low: int = 0, high: int = 1 << 62) -> None:
        self.text, self.starts, self.ends, self.hot, self.low, self.high = text, starts, ends, hot, low, high


#: Code points on either side of a trigger within which its window's tokens are cut, and the longest window of many triggers.
REACH, LONGEST = 48, 768
#: How far back a window's first word is followed to be whole: local parts have 64 characters at most.
LONG_NAME = 80
#: How far a window reads beyond the place from which on segments belong to the next one, and back from where its own begin.
BEYOND, BACK = 192, 32


def windows(text: str, barriers: list[tuple[int, int]]) -> Iterator[Window]:
    """Windows of the text's triggers that no barrier covers; nearby triggers share one."""
    spots: list[list[int]] = []  # begin, end, and where the segments that are its own begin and end
    barriers = sorted(barriers)
    b = 0
    for m in TRIGGER.finditer(text):
        while b < len(barriers) and barriers[b][1] <= m.start():
            b += 1
        if b < len(barriers) and barriers[b][0] < m.end():
            continue
        floor = barriers[b - 1][1] if b else 0
        ceiling = barriers[b][0] if b < len(barriers) else len(text)
        low, high = max(floor, m.start() - REACH), min(ceiling, m.end() + REACH)
        while low > floor and m.start() - low < LONG_NAME and text[low - 1] in LOCAL and text[low] in LOCAL:
            low -= 1
        if not spots or low > spots[-1][1] or floor >= spots[-1][1]:
            spots.append([low, high, low, len(text)])
        elif high - spots[-1][2] <= LONGEST:
            spots[-1][1] = max(high, spots[-1][1])
        else:  # a long run of triggers: windows overlap
            low = max(low, spots[-1][2] + 1)
            spots[-1][1], spots[-1][3] = max(spots[-1][1], min(ceiling, low + BEYOND)), low
            spots.append([max(floor, low - BACK), high, low, len(text)])
    for low, high, own, after in spots:
        # a long run without breaks is whole in one token where it fits, cut at the window's edge where not
        tokens = [m.span() for m in TOKEN.finditer(text, low, high)]
        merged: list[tuple[int, int]] = []
        for s, e in tokens:  # hexadecimal runs mix letters and digits: one token
            if merged and merged[-1][1] == s and text[s - 1].isalnum() and text[s].isalnum():
                merged[-1] = (merged[-1][0], e)
            else:
                merged.append((s, e))
        if merged:
            yield Window(text, [s for s, _ in merged], [e for _, e in merged], [bool(TRIGGER.search(text[s:e])) or text[s:e].lower() in ("at", "dot") for s, e in merged], own, after)


@lru_cache(1 << 16)
def shape(text: str) -> str:
    out = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: "d" if len(m[0]) > 4 else "d" * len(m[0]), text))
    return re.sub(r"\s+", "_", out)[:40]


def features(text: str, start: int, end: int, before: str, after: str) -> list[str]:
    """Names of the features of a whole candidate span."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    groups = re.findall(r"[0-9]+", span)
    marks = "".join(sorted(set(re.sub(r"[\w\s]", "", span))))
    low = span.lower()
    out = ["bias", f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 6)}", f"shape={shape(span)}", f"marks={marks[:8]}", f"first={shape(span[:1])}", f"last={shape(span[-1:])}",
           f"before={before}", f"after={after}", f"length={min((end - start) // 4, 12)}", f"at={'@' in span}", f"spelt={' at ' in low or '(at)' in low or '[at]' in low}"]
    if 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if len(groups) == 4:
        out.append(f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if SECRET.fullmatch(text, start, end):
        out.append("key")
    if digits:
        out.append(f"cut={bool(CUT_BEFORE.search(text[max(0, start - 2) : start]) or CUT_AFTER.match(text, end))}")
    if len(digits) > 6 and GROUPED.fullmatch(span):
        sizes = [min(len(g), 5) for g in groups]
        between = "".join(sorted(set(re.findall(r"[-./\s]", span))))
        lead = "00" if digits.startswith("00") else digits[0] if digits[0] in "01" else "x"
        out += [f"phone={9 <= len(digits) <= 15}:{lead}", f"sizes={min(sizes)}-{max(sizes)}", f"between={between}:{len(groups) > 1}", f"grouped={len(digits)}:{between}", f"brackets={'(' in span}:{lead}"]
    found = ADDRESS.match(text, start, end + REACH) if "@" in span or "at" in low else None
    if found:
        tail, marked = re.split(r"\W+", found[0])[-1].lower(), "@" in span or "(" in span or "[" in span
        out.append(f"tail={min(len(tail), 5)}:{marked}")
        whole = found.end() == end and not WITHIN.search(text[max(0, start - 12) : start])
        out.append("beyond address" if found.end() < end else f"address={whole}")
        if whole:
            out.append(f"host={'known' if tail in SUFFIXES else min(len(tail), 3)}:{marked}")
    elif "@" in span or "at" in low:
        out.append("no address")
    out.append(f"words={min(len(span.split()), 9)}")
    if re.search(r"[.](?:com|org|net|[a-z]{2})$", low):
        out.append("domain")
    return out


def hashed(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(n.encode("utf-8", "replace"), 2) & ((1 << BITS) - 1) for n in names], np.int64)


class Lattice:
    """Candidate segments of one window, in the order of their ends."""

    def __init__(self, w: Window) -> None:
        self.n = len(w.starts)
        self.spans: list[tuple[int, int]] = []
        self.features: list[np.ndarray] = []
        self.by_end: list[list[int]] = [[] for _ in range(self.n + 1)]
        words = [w.text[s:e] for s, e in zip(w.starts, w.ends, strict=True)]
        first, last = {s: i for i, s in enumerate(w.starts)}, {e: j for j, e in enumerate(w.ends)}
        found = [m.span() for m in ADDRESS.finditer(w.text, w.starts[0], w.ends[-1])] if self.n else []
        whole = {first[s]: last[e] for s, e in found if s in first and e in last}
        for i in range(self.n):
            if words[i] in ",.;:!?)]":
                continue
            warm = False
            stop = min(self.n, i + MAX_TOKENS)
            stop = min(stop, max(i + WORD_TOKENS, next((k for k in range(i, stop) if words[k].isalpha()), stop)))
            ends = [*range(i, stop)]
            if whole.get(i, 0) >= stop:
                ends.append(whole[i])
                warm = True
            for j in ends:
                warm = warm or w.hot[j]
                if not warm or words[j] in ",.;:!?([+=":
                    continue
                before = words[i - 1].lower()[:10] if i else "^"
                after = "$" if j + 1 == self.n else words[j + 1].lower() if words[j + 1].lower() in ("at", "dot") else shape(words[j + 1])[:4]
                self.by_end[j + 1].append(len(self.spans))
                self.spans.append((i, j + 1))
                self.features.append(hashed(features(w.text, w.starts[i], w.ends[j], before, after)))

        self.first, self.end = (np.array([x[k] for x in self.spans], np.int64) for k in (0, 1))
        self.at = np.cumsum([0, *map(len, self.features)])
        self.flat = np.concatenate(self.features) if self.features else np.zeros(0, np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """One score for each candidate and label."""
        return np.add.reduceat(weights[:, self.flat], self.at[:-1], axis=1).T if self.spans else np.zeros((0, len(LABELS)))


def best_segments(lattice: Lattice, scores: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, end token, label) of the best segmentation: bounded-length Viterbi."""
    best = np.zeros(lattice.n + 1)
    back: list[tuple[int, int] | None] = [None] * (lattice.n + 1)
    for end in range(1, lattice.n + 1):
        best[end] = best[end - 1]
        for c in lattice.by_end[end]:
            label = int(scores[c].argmax())
            value = best[lattice.spans[c][0]] + scores[c, label]
            if value > best[end]:
                best[end], back[end] = value, (c, label)
    out, end = [], lattice.n
    while end > 0:
        if back[end] is None:
            end -= 1
        else:
            c, label = back[end]
            out.append((*lattice.spans[c], label))
            end = lattice.spans[c][0]
    return out[::-1]


def _log_sum(one: float, others: np.ndarray) -> float:
    if not len(others):
        return one
    top = max(one, float(others.max()))
    return top + math.log(math.exp(one - top) + float(np.exp(others - top).sum()))


def expected(lattice: Lattice, scores: np.ndarray) -> np.ndarray:
    """Probability of each candidate and label under the field: forward and backward over segments."""
    n = lattice.n
    if not lattice.spans:
        return scores
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    mass = np.logaddexp.reduce(scores, axis=1)
    starting: list[list[int]] = [[] for _ in range(n)]
    for c, (i, _) in enumerate(lattice.spans):
        starting[i].append(c)
    for end in range(1, n + 1):
        own = lattice.by_end[end]
        forward[end] = _log_sum(forward[end - 1], forward[lattice.first[own]] + mass[own] if own else mass[:0])
    for at in range(n - 1, -1, -1):
        own = starting[at]
        backward[at] = _log_sum(backward[at + 1], backward[lattice.end[own]] + mass[own] if own else mass[:0])
    return np.exp(forward[lattice.first][:, None] + scores + backward[lattice.end][:, None] - forward[n])


LETTERS = str.maketrans("0123456789", "aeiourstln")


def drawn(choices: list, number: int, what: str):
    """One of the choices by a hash, so that every choice comes together with every other one."""
    return choices[xxhash.xxh64_intdigest(f"{what}:{number}", 5) % len(choices)]


def varied(address: str, number: int) -> str:
    """The address, or one without digits, with fewer or more parts."""
    local, _, host = drawn([address, address.translate(LETTERS)], number, "digits").rpartition("@")
    parts = host.split(".")
    local = drawn([local, re.split(r"[._%+-]", local)[0] or local, f"{local}.{parts[0]}"], number, "local")
    return local + "@" + ".".join(drawn([parts, parts[-2:], [*parts, parts[-1][:2]], ["mail", *parts, parts[-1][:2]]], number, "host"))


def damaged(kind: str, span: str, number: int) -> str:
    """A spelling of a base span that its pattern no longer matches."""
    if kind == "email":
        span = varied(span, number)
        return span.replace("@", drawn([" at ", " at ", " (at) ", " [at] ", "[at]", " {at} "], number, "at")).replace(".", drawn([".", " dot ", " dot ", " [dot] ", " (dot) "], number, "dot"))
    if kind == "phone":
        own = re.sub(r"^\+[0-9]{1,3}[ -]?", "", span)
        groups = re.findall("[0-9]+", own)
        digits = "".join(groups)
        if number % 2:  # the same number in other groups
            groups = [g for g in re.findall(GROUPINGS[number // 2 % len(GROUPINGS)], digits)[0] if g]
        mark = "- ./"[number // 10 % 4]
        return [span.lstrip("+"), "00" + span.lstrip("+"), own, mark.join(groups), " ".join(["0" + groups[0], *groups[1:]]), f"({groups[0]}) " + mark.join(groups[1:] or groups), ".".join(groups),
                " ".join(["00" + str(30 + number % 60), *groups]), mark.join(["0" + groups[0], *groups[1:]]), f"(0{groups[0]}) " + " ".join(groups[1:] or groups)][number % 10]
    if kind == "card":
        digits = re.sub("[^0-9]", "", span)
        return [".", "/", "_", " . ", " / "][number % 5].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return span.replace(".", [" . ", ",", " dot "][number % 3])


#: How many damaged spellings of a base span are shown.
SPELLINGS = {"email": 9, "phone": 10, "card": 5, "ip": 3}
#: Groups in which a phone's digits are shown too.
GROUPINGS = [r"(.{1,3})(.{0,3})(.*)", r"(.{1,3})(.*)", r"(.{1,2})(.{0,2})(.{0,2})(.{0,2})(.*)", r"(.{1,4})(.*)", r"(.{1,3})(.{0,4})(.*)"]
#: Keys with their issuers' prefixes and the number of letters and digits after them.
PREFIXES = {"AKIA": 16, "ASIA": 16, "sk_live_": 24, "pk_test_": 24, "sk_": 32, "ghp_": 36, "gho_": 36, "glpat-": 20, "xoxb-": 24}
#: Ordinary numbers, and "at" and "dot" as ordinary words: nothing personal.
PLAIN = [
    "{a}.{b}.{c}", "v{a}.{b}", "{a}/{b}/{y}", "{y}-0{c}-1{c}", "{a}:3{c}", "{a}:1{c}:4{b}", "${a},{y}.{a}", "{a}.{y} %", "{y} to {y}", "{y}/{c}", "{a} - {b} = {c}", "{a} x {b}", "no. {y}{a}", "{a} {y}",
    "{a}{b} of {y}", "(see {c}.{a})", "[{a}]", "{a}st and {b}nd", "{y}s", "#{a}{y}", "at {a} or {b}", "at noon. They", "a dot in the", "{y}{y}{y}{y}", "{y} {y} {y} {y}", "{y}{a}-{y}-{y}-{y}", "a dot or two dots", "stay at sea. Then",
    "978-{c}-16-{a}8410-{c}", "ISBN {c}-{y}-{y}-{c}", "{y}-0{c}-1{c} 1{c}:{y}", "{c}.{y}{y}{y}", "{y}{a}-{y}{b}", "{c} {c}00 000 000", "{c},{c}00,000,000", "{a}.{y}, -{b}.{y}", "({y}) {y}-{y}", "{y}/{y}/{y}", "{y}.0{c}.1{c}", "{y}-{y}, {y}-{y}",
    "v{a}.{b}.{c}.{y}", "order {y}{y}{y}", "id_{y}_{a}", "{a} {b} {c} {a} {b} {c}", "{y}0{c}1{c}{y}", "model_{y}_{a}b{c}", "section {a}.{b}.{c}.{a}.{b}", "look at the dot there", "wait at one dot or more", "point at this dot again", "stop at every dot. Then", "met at number {a} dot five", "meet at one dot and go", "aim at any dot with care", "stay at this dot for now", "{c}.{y}{y}", "{b}.{y}{y}", "{c}0{c} {c}00 {c}0{c}",
]


def plain_examples(texts: list[str]) -> Iterator[tuple[str, list]]:
    """``PLAIN`` with numbers, between words of the snippets."""
    words = [w for text in texts for w in re.findall(r"[^\W\d_]+[.,]?", text)] or ["a"]
    for i in range(2 * len(PLAIN)):
        number = {"a": 1 + i % 12, "b": 2 + i * 7 % 30, "c": 1 + i * 5 % 9, "y": 1900 + i * 37 % 130}
        at = i * 13 % len(words)
        plain = PLAIN[i % len(PLAIN)].format(**number)
        if luhn(re.sub("[^0-9]", "", plain)):  # a long number that is no card
            plain = plain[:-1] + "5731940628"[ord(plain[-1]) % 10]
        yield " ".join([*words[at : at + 4], plain, *words[at + 4 : at + 8]]), []


def key_examples(texts: list[str]) -> Iterator[tuple[str, list]]:
    """Keys of ``PREFIXES`` between words of the snippets."""
    words = [w for text in texts for w in re.findall(r"[^\W\d_]+[.,]?", text)] or ["a"]
    for i in range(4 * len(PREFIXES)):
        prefix, size = [*PREFIXES.items()][i % len(PREFIXES)]
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + ("" if prefix.isupper() else "abcdefghijklmnopqrstuvwxyz")
        body = "".join(letters[xxhash.xxh64_intdigest(f"{i}:{k}", 4) % len(letters)] for k in range(size - 1)) + str(i % 10)
        if i % 3 == 0:  # few digits
            body = body[: size // 2].translate(LETTERS) + str(i % 10) + body[size // 2 : -1].translate(LETTERS)
            body = body.upper() if prefix.isupper() else body
        head = " ".join(words[i * 11 % len(words) :][:4]) + " "
        yield head + prefix + body + " " + " ".join(words[i * 17 % len(words) :][:4]), [("secret", len(head), len(head) + len(prefix) + size)]


def _example(text: str, truth: list[tuple[str, int, int]]) -> tuple[Lattice, dict[int, int]] | None:
    """The lattice of the text's first window with the truth's candidates; None where a true span has no candidate."""
    for w in windows(text, []):
        lattice = Lattice(w)
        places = {(w.starts[i], w.ends[j - 1]): c for c, (i, j) in enumerate(lattice.spans)}
        if any((s, e) not in places for _, s, e in truth):
            return None
        return lattice, {places[s, e]: LABELS.index(kind) for kind, s, e in truth}
    return None


def training_examples(texts: Iterable[str]) -> list[tuple[Lattice, dict[int, int]]]:
    """At most ``TRAIN_WINDOWS`` windows of the texts with their true segments, and those of ordinary numbers and keys."""
    texts = list(texts)
    made = [_example(*x) for x in [*plain_examples(texts), *key_examples(texts)]]
    return [x for x in [*_text_examples(texts), *made] if x and x[0].n <= 80]


def _text_examples(texts: Iterable[str]) -> list[tuple[Lattice, dict[int, int]] | None]:
    out: list = []
    for text in texts:
        spans = base_spans(text)
        covered = [(s, e) for _, s, e in spans]
        for number, (kind, s, e) in enumerate(spans[:4]):
            head, tail = text[max(0, s - REACH // 2) : s], text[e : e + REACH // 2]
            if any(c in "0123456789@" for c in head + tail):
                continue
            spans_of = [text[s:e], *(damaged(kind, text[s:e], n) for n in range(number + len(out), number + len(out) + SPELLINGS[kind]))]
            for span in spans_of:
                out.append(_example(head + span + tail, [(kind, len(head), len(head) + len(span))]))
        for m in [*SECRET.finditer(text)][:1]:
            head, tail = text[max(0, m.start() - REACH // 2) : m.start()], text[m.end() : m.end() + REACH // 2]
            if not any(c in "0123456789@" for c in head + tail):
                for size in (24, 32, 36):
                    out.append(_example(head + m[0][:size] + tail, [("secret", len(head), len(head) + min(size, len(m[0])))]))
        for w in windows(text, covered):
            lattice = Lattice(w)
            gold = {c: LABELS.index("secret") for c, (i, j) in enumerate(lattice.spans) if j == i + 1 and SECRET.fullmatch(text[w.starts[i] : w.ends[i]])}
            out.append((lattice, gold))
        if len(out) >= TRAIN_WINDOWS:
            break
    return out[:TRAIN_WINDOWS]


def train(texts: Iterable[str], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (label, feature) by gradient ascent with a rate for each coordinate (AdaGrad)."""
    weights = np.zeros((len(LABELS), 1 << BITS))
    weights[:, hashed(["bias"])] = -2.0
    square = np.full_like(weights, 1e-3)
    examples = training_examples(texts)
    for _ in range(epochs):
        for lattice, gold in examples:
            if not lattice.spans:
                continue
            gradient = -expected(lattice, lattice.scores(weights))
            for c, label in gold.items():
                gradient[c, label] += 1
            sizes = np.diff(lattice.at)
            at, place = np.unique(lattice.flat, return_inverse=True)
            g = np.stack([np.bincount(place, np.repeat(x, sizes), len(at)) for x in gradient.T]) - decay * weights[:, at]
            square[:, at] += g * g
            weights[:, at] += rate * g / np.sqrt(square[:, at])
    return weights


def find_spans(text: str, weights: np.ndarray | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and the spans that the field adds between them."""
    base = base_spans(text)
    if weights is None:
        return base, []
    added, last = [], 0
    for w in windows(text, [(s, e) for _, s, e in base]):
        lattice = Lattice(w)
        for i, j, label in best_segments(lattice, lattice.scores(weights)):
            if max(w.low, last) <= w.starts[i] < w.high:
                added.append((LABELS[label], w.starts[i], w.ends[j - 1]))
                last = w.ends[j - 1]
    return base, sorted((x for x in added if not (x[0] == "email" and LOOK_AT.fullmatch(text, x[1], x[2]))), key=lambda x: (LABELS.index(x[0]), x[1]))


def snippets(text: str) -> Iterator[tuple[str, str]]:
    """(kind, surroundings) of one span of each kind and of some other triggers (kind ""), chosen by hash over the whole text."""

    def order(place: int) -> int:
        return xxhash.xxh64_intdigest(f"{place}:{len(text)}".encode(), 3)

    chosen: dict[str, tuple[int, int]] = {}
    for kind, s, e in [*base_spans(text), *(("secret", *m.span()) for m in SECRET.finditer(text))]:
        if kind not in chosen or order(s) < order(chosen[kind][0]):
            chosen[kind] = (s, e)
    triggers = heapq.nsmallest(TRIGGERS_A_TEXT, (m.span() for m in TRIGGER.finditer(text)), key=lambda x: order(x[0]))
    for kind, (s, e) in [*chosen.items(), *(("", x) for x in triggers)]:
        yield kind, text[max(0, s - REACH) : min(e, s + 4 * REACH) + REACH]


def balanced(found: Iterable[tuple[str, str]]) -> list[str]:
    """Snippets in the order of their hashes: of each kind ``KIND_SNIPPETS`` at most first, then those of other triggers."""
    order = sorted({(kind, text) for kind, text in found}, key=lambda x: (xxhash.xxh64_intdigest(x[1].encode("utf-8", "replace")), x))
    first = [[x for k, x in order if k == kind][:KIND_SNIPPETS] for kind in LABELS]
    return [*(x for group in zip_longest(*first) for x in group if x is not None), *(x for k, x in order if not k)]


def fit(docs: DataFrame, bound: int = TRAIN_ROWS) -> np.ndarray | None:
    """Weights from a hash sample of about ``bound`` documents; None without any trigger in it."""
    text = F.col("text").cast("string")
    sample = docs.where(hash_share(2, bound, docs.count(), "doc_id", text)).select(text.alias("text"))

    def cut(rows: Iterator[tuple]) -> Iterable[tuple]:
        """Only the surroundings of spans and triggers, each bounded in number and size, go to the one task that trains."""
        for (value,) in rows:
            yield from snippets(value or "")

    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
    def learn(rows: Iterator[tuple]) -> Iterable[tuple]:
        texts = balanced(rows)
        if texts:
            yield (train(texts).tobytes(),)

    weights = map_rows(map_rows(sample, cut, schema).repartition(1), learn, T.StructType([T.StructField("weights", T.BinaryType())])).collect()
    return np.frombuffer(weights[0]["weights"]).reshape(len(LABELS), -1) if weights else None


def personal_spans(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """(doc_id, row, base, added) of every row; ``row`` is a hash of id and text."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        model = held.value
        for doc_id, row, text in rows:
            base, added = find_spans(text or "", model)
            name = ("kind", "start", "end")
            yield doc_id, row, [dict(zip(name, x, strict=True)) for x in base], [dict(zip(name, x, strict=True)) for x in added]

    text = F.col("text").cast("string")
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text), text.alias("text")), run, SPANS)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, the wider first where they overlap, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start < at:
            if end > at:
                at = end
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars`` renewed; other columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        model = held.value
        for row in rows:
            text = row[at]
            if text:
                base, added = find_spans(text, model)
                if base or added:
                    row = list(row)
                    row[at] = redacted(text, [*base, *added])
                    if size is not None:
                        row[size] = len(row[at])
            yield tuple(row)

    return map_rows(docs, run, docs.schema, weight=lambda r: len(r[at] or ""))
