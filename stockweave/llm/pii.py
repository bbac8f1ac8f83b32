r"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field for what they miss.

Base spans, by kind, leftmost and non-overlapping; failing matches are dropped without another try:
email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`; ip `[0-9]+(\.[0-9]+){3}`, parts at most 255; card
`[0-9]([\x20-]?[0-9])+`, 16 to 19 digits that pass Luhn; phone `\+[0-9][\x20().0-9-]+[0-9]`, 8 to 15 digits. They are
found in one pass from their anchors (an @, a dotted run of digits, a plus), so long runs take linear time.

The random field works on regions that could hold more: runs of digit groups (a single group of NUMBER_DIGITS too), words
around "at" and "dot" in place of @ and a point, and long runs of letters and digits, which may be secrets. Candidate
segments of a region are its sub-spans of up to MAX_GROUPS groups; whole-span features (grouping of the digits, separators,
checksum, kind of characters, cue words before it, what touches it) score each with each type. The dynamic programme over
the region's groups picks the segments and types together that score best, with MAX_GROUPS as the longest entity; a group
in no segment scores 0. Segments that overlap base spans are no candidates. The weights are trained here, by the
conditional likelihood of sentences that a seeded generator makes.

Nulls and empty texts: no spans. Repeated rows and ties give equal results. Very long texts, also runs of a million
digits, take linear time: no pattern starts again inside a run that it has left. An empty table gives an empty one.
redact_documents replaces only text (and n_chars) and keeps every other column; find_personal_data ignores them.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.common import returning_memory, slices

#: The kinds of base spans, and those of all spans.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAX_GROUPS = 6
#: Digits of a candidate that is a single group; least and most characters of a secret.
NUMBER_DIGITS, SECRET_CHARS = (9, 15), (16, 256)
EPOCHS, SENTENCES, SEED = 10, 900, 7

_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_digits = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_region = re.compile(r"(?<![0-9])[+(]{0,2}+[0-9]++(?:[ ().\-]{1,3}+[0-9]++)*+")
_group = re.compile(r"[0-9]+")
_veiled = re.compile(r"(?:\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|\s(?:at|AT)\s)([A-Za-z0-9-]+(?:(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s|\.)[A-Za-z0-9-]+)+)")
_cue = re.compile(r"(?i)(tel|phone|call|fax|mobile|cell|whatsapp|sms)|(card|visa|amex|mastercard|credit)|(ip|host|server|address)|(mail|contact|write)")
_run = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9]|[+/_.\-](?=[A-Za-z0-9])){15,}+")
_parts = re.compile(r"[A-Za-z0-9]+")
_credential = re.compile(r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)|(commit|sha|hash|digest|md5|checksum|uuid|id|ref|part|model|version|order)")
_prefix = re.compile(r"(?:sk|pk|rk)_(?:live|test)_|gh[pousr]_|AKIA|xox[abp]-|eyJ|AIza")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and _local.match(text[start - 1]):
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[Span]:
    """In the order of BASE, then of starts."""
    out: list[Span] = [("email", *s) for s in _emails(text)] if "@" in text else []
    for m in _dotted.finditer(text):
        parts = [(p.start(), p.end(), p.group()) for p in _group.finditer(text, m.start(), m.end())]
        for k in range(0, len(parts) - 3, 4):
            if all(len(p[2]) < 4 and int(p[2]) <= 255 or int(p[2].lstrip("0")[:4] or 0) <= 255 and len(p[2].lstrip("0")) <= 3 for p in parts[k : k + 4]):
                out.append(("ip", parts[k][0], parts[k + 3][1]))
    for m in _digits.finditer(text):
        if m.end() - m.start() >= 16:
            found = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(found) <= 19 and luhn(found):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Segment:
    """A candidate: groups first to last of its region, characters start to end, and its features without a type."""

    __slots__ = ("first", "last", "start", "end", "features")

    def __init__(self, first: int, last: int, start: int, end: int, features: tuple[str, ...]):
        self.first, self.last, self.start, self.end, self.features = first, last, start, end, features


def _number_features(text: str, start: int, end: int, groups: list[str], left: str, right: str) -> tuple[str, ...]:
    """left, right: what stands between the segment and the next digit group of its region, or nothing."""
    digits, span = "".join(groups), text[start:end]
    shape = "-".join(str(len(g)) for g in groups)
    seps = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
    before, after = text[max(0, start - 24) : start], text[end : end + 1]
    out = [f"shape={shape}", f"seps={seps}", f"shape&seps={shape}|{seps}", f"n={min(len(digits), 20)}", "bias"]
    out.append(f"luhn={luhn(digits)}&long={len(digits) >= 13}")
    out.append(f"octets={len(groups) == 4 and all(int(g) <= 255 for g in groups)}&{seps}")
    if span.startswith(("+", "(")):
        out.append(f"opens={span[0]}")
    glued_left, glued_right = before[-1:], after
    out.append(f"left={'alnum' if glued_left.isalnum() else glued_left if glued_left in '+-./:=#$' and glued_left else 'free'}")
    out.append(f"right={'alnum' if glued_right.isalnum() else glued_right if glued_right in '-/:=%' and glued_right else 'free'}")
    if left:
        out.append(f"cut-left={left.strip() or 'space'}")
    if right:
        out.append(f"cut-right={right.strip() or 'space'}")
    for m in _cue.finditer(before):
        out.append(f"cue={m.lastindex}")
    return tuple(out)


def _secret_features(text: str, start: int, end: int, groups: int, inside: tuple[bool, bool]) -> tuple[str, ...]:
    """inside: whether the run goes on before and after the segment."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 1]
    digits = sum(c.isdigit() for c in span)
    kind = "hex" if not set(span.lower()) - set("0123456789abcdef") else "lower" if span.lower() == span else "upper" if span.upper() == span else "mixed"
    out = ["bias", "secret", f"run={kind}", f"run={kind}&{min(len(span) // 8, 8)}", f"groups={groups}", f"digits={min(4, 5 * digits // len(span))}"]
    sign = before.rstrip(" \"'`")[-1:]
    assigned = sign if sign in "=:" and sign else "none"
    out += [f"assigned={assigned}", f"quoted={before[-1:] in tuple('`\"') + (chr(39),)}", f"after={'end' if not after else 'alnum' if after.isalnum() else after if after in '/@=%' else 'free'}"]
    if _prefix.match(span):
        out.append("prefix")
    cues = {m.lastindex for m in _credential.finditer(before)}
    out += [f"credential={c}" for c in sorted(cues)]
    if assigned != "none":
        out.append(f"assigned&credential={1 in cues}")
    out += [f"inside={k}" for k, x in zip(("before", "after"), inside, strict=True) if x]
    return tuple(out)


def _secret_regions(text: str) -> Iterator[list[Segment]]:
    """Runs of letters and digits, with single signs between them; segments need both and SECRET_CHARS."""
    for m in _run.finditer(text):
        run = m.group()
        if run.isalpha() or run.isdigit():
            continue
        groups = [(g.start(), g.end()) for g in _parts.finditer(text, m.start(), m.end())]
        found = []
        for i in range(len(groups)):
            for j in range(i, min(len(groups), i + MAX_GROUPS)):
                start, end = groups[i][0], groups[j][1]
                if end - start > SECRET_CHARS[1]:
                    break
                span = text[start:end]
                if end - start < SECRET_CHARS[0] or not any(c.isdigit() for c in span) or not any(c.isalpha() for c in span):
                    continue
                found.append(Segment(i, j, start, end, _secret_features(text, start, end, j - i + 1, (i > 0, j + 1 < len(groups)))))
        if found:
            yield found


def _regions(text: str) -> Iterator[list[Segment]]:
    """Candidate segments of each region."""
    for m in _region.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start(), g.end(), g.group()) for g in _group.finditer(text, m.start(), m.end())]
        found = []
        for i in range(len(groups)):
            total = 0
            for j in range(i, min(len(groups), i + MAX_GROUPS)):
                total += len(groups[j][2])
                if total > 19:
                    break
                if i == j and not NUMBER_DIGITS[0] <= total <= NUMBER_DIGITS[1] or total < 7 and j - i != 3:
                    continue
                start = groups[i][0]
                while start > m.start() and text[start - 1] in "+(" and (i == 0 or start - 1 >= groups[i - 1][1]):
                    start -= 1
                left = text[groups[i - 1][1] : start] if i else ""
                right = text[groups[j][1] : groups[j + 1][0]] if j + 1 < len(groups) else ""
                found.append(Segment(i, j, start, groups[j][1], _number_features(text, start, groups[j][1], [g[2] for g in groups[i : j + 1]], left, right)))
        if found:
            yield found
    yield from _secret_regions(text)
    if "at" in text or "AT" in text or "@" in text:
        for m in _veiled.finditer(text):
            start = m.start()
            while start > 0 and _local.match(text[start - 1]):
                start -= 1
            if start == m.start():
                continue
            joint = text[m.start() : m.start(1)]
            dots = re.findall(r"\s?[\[({]?\s?(?:dot|DOT|\.)\s?[\])}]?\s?", m.group(1))
            out = ["bias", f"veil={'bracket' if any(c in joint for c in '[({') else 'word'}", f"dots={'word' if any('dot' in d.lower() for d in dots) else 'point'}"]
            out.append("&".join(out[1:]))
            tail = re.split(r"[^A-Za-z0-9]+", m.group(1))[-1].lower()
            out.append(f"tail={tail if tail in ('com', 'org', 'net', 'edu', 'io', 'de', 'fr', 'es') else 'other'}")
            out += [f"cue={c.lastindex}" for c in _cue.finditer(text[max(0, start - 24) : start])]
            yield [Segment(0, 0, start, m.end(), tuple(out))]


class SemiCrf:
    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = weights or {}

    def scores(self, s: Segment) -> list[float]:
        w = self.weights
        return [sum(w.get((k, f), 0.0) for f in s.features) for k in KINDS]

    def best(self, region: list[Segment]) -> list[tuple[Segment, str]]:
        """Segments and types of the best path through the groups of a region."""
        n = max(s.last for s in region) + 1
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        ending: dict[int, list[Segment]] = {}
        for s in region:
            ending.setdefault(s.last + 1, []).append(s)
        for e in range(1, n + 1):
            value[e] = value[e - 1]
            for s in ending.get(e, ()):
                for kind, score in zip(KINDS, self.scores(s), strict=True):
                    if value[s.first] + score > value[e]:
                        value[e], back[e] = value[s.first] + score, (s, kind)
        out, e = [], n
        while e:
            if back[e]:
                out.append(back[e])
                e = back[e][0].first
            else:
                e -= 1
        return out[::-1]

    @staticmethod
    def sums(region: list[Segment], scored: list[list[float]]) -> tuple[list[float], list[float]]:
        """Logarithms of the sums over all segmentations of the groups before, and from, each place."""
        n = max(s.last for s in region) + 1
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for e in range(1, n + 1):
            ahead[e] = ahead[e - 1]
            for s, sc in zip(region, scored, strict=True):
                if s.last + 1 == e:
                    for x in sc:
                        ahead[e] = add(ahead[e], ahead[s.first] + x)
        for b in range(n - 1, -1, -1):
            behind[b] = behind[b + 1]
            for s, sc in zip(region, scored, strict=True):
                if s.first == b:
                    for x in sc:
                        behind[b] = add(behind[b], behind[s.last + 1] + x)
        return ahead, behind

    def train(self, examples: list[tuple[list[Segment], list[tuple[int, int, str]]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Stochastic gradient of the conditional log likelihood: gold features less the expected ones."""
        w = self.weights
        for epoch in range(epochs):
            step = rate / (1 + epoch / 2)
            for region, gold in examples:
                n = max(s.last for s in region) + 1
                scored = [self.scores(s) for s in region]
                ahead, behind = self.sums(region, scored)
                for s, sc in zip(region, scored, strict=True):
                    for kind, x in zip(KINDS, sc, strict=True):
                        slope = float((s.start, s.end, kind) in gold) - math.exp(min(0.0, ahead[s.first] + x + behind[s.last + 1] - ahead[n]))
                        if abs(slope) > 1e-4:
                            for f in s.features:
                                w[kind, f] = w.get((kind, f), 0.0) * (1 - step * decay) + step * slope


def _examples(rnd: random.Random) -> Iterator[tuple[str, list[Span]]]:
    """Sentences with the spans in them that the base patterns don't give, and sentences without any."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    area = lambda: rnd.choice("23456789") + d(2)
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 8)))

    def card(n: int) -> str:
        body = rnd.choice("3456") + d(n - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def phone() -> str:
        a, b, c = area(), area(), d(4)
        return rnd.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{d(2)} {d(4)} {d(4)}", f"00{d(2)} {a} {d(4)} {d(3)}"])

    def amex() -> str:
        x = card(15)
        return rnd.choice([f"{x[:4]} {x[4:10]} {x[10:]}", f"{x[:4]}-{x[4:10]}-{x[10:]}"])

    def mail() -> str:
        at, dot = rnd.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" AT ", " DOT "), ("[at]", "[dot]"), ("{at}", ".")])
        return word() + rnd.choice([".", "_", ""]) + word() + at + word() + dot + rnd.choice(["com", "org", "net", "de"])

    def spaced_ip() -> str:
        return rnd.choice([" . ", ". "]).join(str(rnd.randint(0, 255)) for _ in range(4))

    def unbroken() -> str:
        return rnd.choice([f"{area()}{area()}{d(4)}", f"0{d(9)}", f"0{d(10)}", f"00{d(11)}"])

    def unbroken_amex() -> str:
        body = rnd.choice(["34", "37"]) + d(12)
        return next(body + c for c in "0123456789" if luhn(body + c))

    text_of = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    hexes, small, wide = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key() -> str:
        return "a1" + rnd.choice([lambda: text_of(hexes, rnd.choice([30, 38, 46, 62])), lambda: text_of(small, rnd.randint(18, 40)), lambda: text_of(wide, rnd.randint(18, 60)), lambda: text_of(hexes.upper(), 38)])()

    def named_key() -> str:
        name = rnd.choice(["token", "TOKEN", "secret", "api_key", "apikey", "API-KEY", "password", "auth_token", "access key", "client_secret", "bearer"])
        return rnd.choice([f'{name} = "', f"{name}=", f"{name}: ", f'"{name}": "', f"{name} '", f"{name} = "])

    def known_key() -> str:
        return rnd.choice(["sk_live_", "ghp_", "AKIA", "AIza", "xoxb-"]) + "7Q" + text_of(wide, rnd.randint(16, 36))

    junk = [
        lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", lambda: f"{d(2)}.{d(2)}.{rnd.randint(1990, 2030)}",
        lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(1)}.{d(2)}.{d(4)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(5)}-{d(4)}",
        lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(2)} {d(3)} {d(2)} {d(1)} {d(4)}", lambda: f"{d(3)}.{d(6)}", lambda: f"{d(16)} {d(2)}",
        lambda: f"{d(8)}-{d(4)}-{d(4)}-{d(4)}-{d(12)}", lambda: f"{d(1)}-{d(3)} {d(4)}-{d(4)}", lambda: f"{rnd.randint(1990, 2030)} {d(4)} {d(2)}",
        lambda: f"{d(6)}-{d(7)}", lambda: f"{d(2)}:{d(2)}:{d(2)}.{d(6)} {d(4)}", lambda: f"{word()} at {word()}.{word()}", lambda: f"{word()} at {word()} dot {word()}ing",
        lambda: d(16), lambda: d(16), lambda: d(13), lambda: f"order {d(10)}", lambda: f"no. {d(rnd.randint(9, 15))}", lambda: f"1{d(9)}", lambda: d(rnd.randint(9, 15)),
        lambda: rnd.choice(["commit ", "sha1 ", "md5: ", "", "hash="]) + "b2" + text_of(hexes, rnd.choice([30, 38, 62])), lambda: f"{word()}{d(2)}-{word()}-{word()}-{word()}{d(1)}",
        lambda: "-".join(text_of(hexes, n) for n in (8, 4, 4, 4, 12)), lambda: f"{word()}/{word()}{d(3)}/{word()}_{word()}.{word()}", lambda: f"{word()}{word()}{word()}{word()}{d(2)}",
        lambda: f"www.{word()}{d(2)}{word()}.com/{word()}", lambda: f"{rnd.choice('ABC')}{d(4)}-{d(4)}-{text_of(wide.upper(), 8)}",
    ]
    makers = [("phone", phone), ("phone", phone), ("card", amex), ("email", mail), ("ip", spaced_ip), ("phone", unbroken), ("card", unbroken_amex), ("secret", key), ("secret", key), ("secret", known_key)]
    cues = {"phone": ["call", "tel", "phone:", "fax"], "card": ["card", "amex"], "email": ["mail", "contact"], "ip": ["ip", "server"]}
    for _ in range(SENTENCES):
        parts, spans, size = [], [], 0
        for _ in range(rnd.randint(1, 3)):
            lead = " ".join(word() for _ in range(rnd.randint(1, 4))) + " "
            if rnd.random() < 0.5:
                kind, make = rnd.choice(makers)
                if make is key:  # without its name no run of characters is a secret
                    lead += named_key()
                elif make is unbroken or kind in cues and rnd.random() < 0.4:  # nor is a bare number a phone
                    lead += rnd.choice(cues[kind]) + " "
                body = make()
                spans.append((kind, size + len(lead), size + len(lead) + len(body)))
            else:
                body = rnd.choice(junk)()
            parts.append(lead + body + rnd.choice([" ", ". ", ", ", "\n"]))
            size += len(parts[-1])
        yield "".join(parts), spans


@lru_cache(maxsize=1)
def trained() -> SemiCrf:
    """The model; the same wherever it is trained."""
    model, examples = SemiCrf(), []
    for text, spans in _examples(random.Random(SEED)):
        gold = [(a, b, k) for k, a, b in spans]
        examples += [(region, gold) for region in _regions(text)]
    model.train(examples)
    return model


def find_spans(text: str, model: SemiCrf) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each in the order of KINDS, then of starts."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added: list[Span] = []
    for region in _regions(text):
        if taken:
            region = [s for s in region if not any(a < s.end and s.start < b for a, b in _near(taken, s))]
        if region:
            added += [(kind, s.start, s.end) for s, kind in model.best(region)]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (order[s[0]], s[1]))


def _near(taken: list[tuple[int, int]], s: Segment) -> list[tuple[int, int]]:
    """Base spans that may touch a segment; of each kind they don't overlap, so few start shortly before it."""
    from bisect import bisect_left

    hi = bisect_left(taken, (s.end, -1))
    lo = hi
    while lo > 0 and hi - lo < 2 * len(KINDS) + MAX_GROUPS:
        lo -= 1
    return taken[lo:hi]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """text with each span (of overlapping ones the first, and their union) replaced by its kind in brackets."""
    out, end = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{k.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _finder(weights: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCrf(weights)
        for b in slices(batches):
            if b.num_rows:
                rows = []
                for t in b.column(1).to_pylist():
                    base, every = find_spans(t or "", model)
                    n = [sum(s[0] == k for s in base) for k in BASE]
                    rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base), len(every)))
                cols = list(zip(*rows, strict=True))
                kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64())
                names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "n_spans"]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return returning_memory(run)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all), n_added (those that the random field added), n_spans."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _finder(trained().weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    )


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind; a null text stays null, n_chars follows the text."""
    weights = trained().weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiCrf(weights)
        for part in slices(batches):
            at = part.schema.get_field_index("text")
            done = [None if t is None else redact(t, find_spans(t, model)[1]) for t in part.column(at).to_pylist()]
            cols = [*part.columns]
            cols[at] = pa.array(done, part.schema.types[at])
            yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    out = docs.mapInArrow(returning_memory(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op2_pii_semi_markov(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
