"""High-recall generators of spans that may be personal data, and the features that judge them.

Generators go by form only; word lists never end a candidate, they are features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np

from rillmark.llm.pii_examples import PUBLIC_FAMILY, PUBLIC_GIVEN, PUBLIC_HINDI

TYPES = ("email", "phone", "id_number", "address", "name")

# Words that stand before personal data, and before what looks like it.
BEFORE = {
    "email": ("mail", "e-mail", "email", "write to", "reply", "mail id", "contact", "tel", "|", "cc", "statements", "served at", "ईमेल"),
    "phone": ("tel", "mobile", "phone", "ph:", "call", "ring", "rung", "dial", "whatsapp", "reached", "contact", " or ", "number is", "cell", "fax", "helpdesk", "दूरभाष", "संपर्क", "फोन", "मोबाइल", "faithfully", "sincerely", "at ", "on "),
    "id_number": ("aadhaar", "aadhar", "uid", "pan", "epic", "voter", "passport", "licence", "license", "dl no", "card", "holds", "identity", "id no", "id card", "proof", "आधार", "पैन", "पासपोर्ट", "मतदाता"),
    "address": ("lives at", "resident of", "r/o", "order to", "come to", "address", "copy to", "residing", "send", "deliver", "return", "residence", "pickup", "near", "at ", "from ", "to ", "for ", "पता", "पत्र"),
    "name": ("name", "nominee", "applicant", "father", "mother", "guardian", "officer", "person", "claimant", "minutes by", "copy to", "i,", "faithfully", "sincerely", "signed", "present", "patient", "complainant", "witness", "passenger", "tenant", "owner", "referee", "deliver to", "son of", "daughter of", "s/o", "d/o", "w/o", "dear", "advocate", "said", "by", "नाम", "आवेदक", "पिता", "माता"),
}
AGAINST = ("toll", "1800", "application", "ref", "transaction", "tender", "budget", "head", "file", "order", "letter", "complaint", "slip", "rs.", "account", "follow", "invoice", "receipt", "survey", "of ", "tracking", "customer", "employee", "ticket", "pnr", "policy", "claim", "cheque", "meter", "utr", "sample", "bill", "parcel", "certificate", "engine", "code", "deposit", "आवेदन", "रसीद", "फाइल")
WORDS = {
    "scheme": "yojana scheme mission fund memorial abhiyan programme initiative trust foundation award plan policy act rule code",
    "organisation": "department ministry panel board desk bank school hospital college corporation company society limited logistics traders press mills mill airlines university institute office court station railway insurance union club committee council association agency services industries government authority police hotel",
    "place": "gali marg street road cross lane towers nagar sector ward district village tehsil near pin post avenue colony park garden apartments residency enclave layout bazar market bridge hall square river lake hill valley north south east west central city town state zone block phase platform",
    "title": "mr mrs ms smt shri sri dr prof kumari kum late miss sir justice advocate minister judge inspector officer patient passenger tenant witness surveyor dear complainant receiver plaintiff accused borrower guarantor clerk श्री श्रीमती कुमारी डॉ सुश्री",
    "common": "may got adds only names register listed charge counted opened the of and by in at for to from under each who those where on no since after before if all i a an old new copy name mobile nominee claimant call verified applicants families her his my son yours please send reply mail contact person loans tender budget application meanwhile further interest penalty stocks is are was were not this that with as or we you they it its order letter complaint bills plot house flat door account card number date general public social science history day year night express human resources chief prime secretary manager head senior junior first second world national international case diary traffic branch offer vehicle follow subjects और का की के में ने को से पर है हैं था थे यह वह नाम पता माता पिता गाँव रहते रखी दी गई हुई जाँच",
    "theme": "jal awas kisan urja setu mahila van poshan yuva matsya gram rozgar shiksha swasthya bunkar sadak beti bal nari shram krishi gramin swachh arogya vidya kaushal",
    "month": "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday",
}
CLASSES = {w: k for k, ws in WORDS.items() for w in ws.split()}
#: Endings of English words that names seldom have.
ENGLISH = frozenset("ing ion ent ers ies ess hip ure ity ous ive ble ary ory ics nce ard est ful ght ted ded sed nal ial age ate ect ort ule ths ons".split())

_AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\s+dot\s+)"
_EMAILS = (
    re.compile(rf"(?<![\w+%-])(?=([\w+%-]+(?:{_DOT}[\w+%-]+)*{_AT}[\w-]+(?:{_DOT}[a-z][\w-]*)+))", re.I),
    re.compile(r"(?<![\w+%-])(?=([\w.+%-]*[\w+%-]\s?(?:@|[\[(]\s?at\s?[\])])\s?[\w-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[a-z][\w-]*)+))", re.I),
    re.compile(r"(?<![\w+%-])(?=([\w+%-]+(?:\s+dot\s+[\w+%-]+)*\s+at\s+[\w-]+(?:\s+dot\s+[a-z][\w-]*)+))", re.I),
    re.compile(r"(?<![\w.+%-])(?=([\w.+%-]*[\w+%-]@[\w-]+(?:\.[a-z][\w-]*)+))", re.I),
)
#: Cheap signs of a candidate; the patterns run only around them.
_EMAIL_SIGN = re.compile(r"@|[\[(]\s?[aA][tT]\s?[\])]|\s[dD][oO][tT]\s")
_NUMBER_SIGN = re.compile(r"\d[\d\s./()+-]{5,}\d")
_PAN_SIGN = re.compile(r"\d{4}(?<=[A-Za-z]\d{4})[A-Za-z](?!\w)")
_S = r"[\s.-]?"
_PHONES = (
    re.compile(rf"(?<![\w/])\+\d{{1,3}}{_S}\d{{5}}{_S}\d{{5}}(?!\d)"),
    re.compile(rf"(?<![\w/])00\d{{2,3}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{4}}(?!\d)"),
    re.compile(r"(?<![\w/])\(\d{2,5}\)\s?\d{3,4}[\s-]?\d{3,4}(?!\d)"),
    re.compile(r"(?<![\w/.-])0\d{2,4}[\s-]\d{6,8}(?!\d)"),
    re.compile(rf"(?<![\w/.+-])\d{{5}}{_S}\d{{5}}(?!\d)"),
    re.compile(r"(?<![\w/.-])\d{10}(?!\d)"),
    re.compile(r"(?<![\w/.+-])\d{3}[\s.-]\d{3}[\s.-]\d{4}(?!\d)"),
    re.compile(r"(?<![\w/])[+(]?\d[\d()-]*(?:[\s.][\d()-]+){0,4}\d(?!\d)"),
)
_IDS = (
    re.compile(rf"(?<![\w/+])\d{{4}}{_S}\d{{4}}{_S}\d{{4}}(?!\d)"),
    re.compile(r"(?<!\w)[A-Z]{5}\d{4}[A-Z](?!\w)", re.I),
    re.compile(r"(?<!\w)[A-Z]{3}[/\s-]?\d{7}(?!\w)", re.I),
    re.compile(r"(?<!\w)[A-Z][\s-]?\d{7}(?!\w)", re.I),
    re.compile(rf"(?<!\w)[A-Z]{{2}}{_S}\d{{2}}{_S}\d{{4}}{_S}\d{{7}}(?!\w)", re.I),
)
# A house number with what follows it, and the designation that may stand before it.
_HOUSE = re.compile(r"\d(?<![\w/.,]\d)(?<!\w-\d)\d{0,4}(?:[/-]?\w{1,4}){0,3}(?=,?\s+[^\W\d_a-z]|,[A-Z]|,\s+\d[\w/-]*[\s,]+[A-Z])")
_DESIGNATION = re.compile(
    r"(?:\b(?:H\.?\s?No\.?|House(?:\s+No\.?)?|Flat(?:\s+No\.?)?|Plot(?:\s+No\.?)?|Door(?:\s+No\.?)?|Street(?:\s+No\.?)?|Apartment|Apt\.?|Shop(?:\s+No\.?)?|Room|Unit|Block|Building|Villa|Quarter|No\.)|#|मकान(?:\s+नं\.?|\s+संख्या)?|घर|फ्लैट|प्लॉट)\s?(?:[A-Z]-)?$"
)
_PART = r"(?:[A-Z#][\w.'/-]*|\d[\w/-]*|[^\W\d_a-zA-Z]\S*)"
_REST = re.compile(rf"(?:,?\s+(?:[A-Z][\w.'-]*\s+){{0,4}}[A-Z][\w.'-]*)?(?:,(?:\s+|(?=[A-Z])){_PART}(?:\s+{_PART}){{0,5}}){{1,9}}(?:\s?[-–]?\s?\d{{3}}\s?\d{{3}})?")
_POSTAL = re.compile(r"\d{3}\s?\d{3}(?!\d)")
# Names: runs of capitalised words and initials; the sub-runs of these shapes are candidates.
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĒĘĚĞĪİŁŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽΑ-ΩА-Я"
_WORD = rf"[{_UPPER}][^\W\d_]+(?:['’-][^\W\d_]+)*"
_PIECE = rf"(?:{_WORD}|[{_UPPER}]\.|[{_UPPER}](?!\w))"
_RUN = re.compile(rf"[{_UPPER}](?<![\w@.-][{_UPPER}])(?:[^\W\d_]+(?:['’-][^\W\d_]+)*|\.|(?!\w))(?:(?:,?\s{{1,3}}|(?<=\.)){_PIECE})+(?![\w@])")
_PIECES = re.compile(_PIECE)
_SHAPES = {s: i for i, s in enumerate(("WW", "WIW", "IW", "IIW", "WWW", "WI", "WII", "WIIW", "IWW", "W,W", "W,WI", "W,WII", "W,IW"))}
# Words of scripts without capitals: pairs of which one is a known name or follows a title or a cue.
_FOREIGN = re.compile(r"[^\W\d_a-zA-ZÀ-ž][^\s\x00-\x7f।॥‐-‧　-〿]*")
_TOKEN = re.compile(r"[^\W\d_]+")


def _last(words: tuple[str, ...]) -> re.Pattern:
    """Matches up to the end of the last of the words."""
    return re.compile(r"(?s).*(?<![a-z])(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")")


_CUES = {k: _last(v) for k, v in BEFORE.items()}
_AGAINST = _last(AGAINST)
_SCHEME = re.compile("|".join(WORDS["scheme"].split()))
_STREET = re.compile(r"\b(?:" + "|".join(WORDS["place"].split()) + r")\b")

_CLASS_NAMES = tuple(WORDS)
#: Facts of a token: given, family, like a given or family name, like English, length, and its class of words.
FACTS = 6 + len(_CLASS_NAMES)
_TITLE, _COMMON, _SCHEME_AT, _ORGANISATION = (6 + _CLASS_NAMES.index(c) for c in ("title", "common", "scheme", "organisation"))


class Lexicon:
    """Known given and family names (anything with ``in``), and the endings that a sample of them shares."""

    def __init__(self, names: list[tuple[str, str]], given=None, family=None) -> None:
        sample = {"given": {t.lower() for t, k in names if k == "given"}, "family": {t.lower() for t, k in names if k == "family"}}
        self.given = sample["given"] if given is None else given
        self.family = sample["family"] if family is None else family
        self.public = {**dict.fromkeys(map(str.lower, PUBLIC_GIVEN), 1), **dict.fromkeys(map(str.lower, PUBLIC_FAMILY), 2), **dict.fromkeys(PUBLIC_HINDI, 3)}
        self.endings = {}
        for kind, tokens in sample.items():
            for size in (3, 4, 0):
                c = Counter(t[-size:] if size else t[:3] for t in tokens)
                self.endings[kind, size] = {e: n / max(len(tokens), 1) for e, n in c.items()}
        self.ids: dict[str, int] = {"": 0}
        self.table = np.zeros((1024, FACTS), dtype=np.float32)

    def like(self, token: str, kind: str) -> float:
        """How usual the token's ending and beginning are for names of the kind, without looking it up whole."""
        e = self.endings
        return e[kind, 3].get(token[-3:], 0.0) + e[kind, 4].get(token[-4:], 0.0) + 3 * e[kind, 0].get(token[:3], 0.0)

    def of(self, token: str) -> int:
        """The row of the token's facts in ``table``; rows are kept for its next time."""
        i = self.ids.get(token)
        if i is None:
            t = token.strip(".,'").lower()
            parts = t.split("-")
            public = max(self.public.get(p, 0) for p in parts)
            word = CLASSES.get(t)
            i = self.ids[token] = len(self.ids)
            if i >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[i] = (
                any(p in self.given for p in parts) or public in (1, 3), any(p in self.family for p in parts) or public in (2, 3),
                0 if word else max(self.like(p, "given") for p in parts), 0 if word else max(self.like(p, "family") for p in parts),
                t[-3:] in ENGLISH, len(t), *[word == c for c in _CLASS_NAMES],
            )
        return i

    def trim(self, most: int = 500_000) -> None:
        """Forget the facts of all tokens once there are too many."""
        if len(self.ids) > most:
            self.ids, self.table = {"": 0}, np.zeros((1024, FACTS), dtype=np.float32)


def lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


Candidate = tuple[int, int, int, int, tuple | None]


def candidates(text: str, lexicon: Lexicon) -> list[Candidate]:
    """Spans ``(start, end, type, generator, pieces)``; they overlap freely."""
    found: dict[tuple[int, int, int], tuple] = {}
    low = lower(text)
    if "@" in text or "dot" in low or "at]" in low or "at)" in low or "at ]" in low or "at )" in low:
        for a, b in _around(text, _EMAIL_SIGN, 70, 90):
            for g, p in enumerate(_EMAILS):
                for m in p.finditer(text, a, b):
                    found.setdefault((*m.span(1), 0), (g, None))
    for a, b in _around(text, _NUMBER_SIGN, 8, 4, 7):
        for k, patterns in ((1, _PHONES), (2, _IDS)):
            for g, p in enumerate(patterns):
                for m in p.finditer(text, a, b):
                    if k == 2 or sum(map(str.isdigit, m.group())) >= 8:
                        found.setdefault((*m.span(), k), (g, None))
    for m in _PAN_SIGN.finditer(text):
        for n in _IDS[1].finditer(text, max(0, m.start() - 5), m.end() + 3):
            found.setdefault((*n.span(), 2), (1, None))
    until = 0
    for m in _HOUSE.finditer(text):
        named = _DESIGNATION.search(text[max(0, m.start() - 14) : m.start()])
        if not named and m.start() < until:
            continue  # a number inside an address
        rest = _REST.match(text, m.end())
        if rest:
            until = max(until, rest.end())
            start = m.start() - (len(named.group()) if named else 0)
            for e in _address_ends(text, start, rest.end()):
                found.setdefault((start, e, 3), (int(named is not None), None))
    for run in _RUN.finditer(text):
        for s, e, shape, pieces in _sub_runs(text, run):
            found.setdefault((s, e, 4), (shape, pieces))
    if not text.isascii():
        words = list(_FOREIGN.finditer(text))
        for i in range(len(words) - 1):
            a, b = words[i], words[i + 1]
            if text[a.end() : b.start()].strip(" ") or b.start() - a.end() > 2:
                continue
            fa, fb, t = lexicon.of(a.group()), lexicon.of(b.group()), lexicon.table
            known = t[fa, 0] or t[fa, 1] or t[fb, 0] or t[fb, 1]
            if known or (i and lexicon.table[lexicon.of(words[i - 1].group()), _TITLE]) or _CUES["name"].match(low[max(0, a.start() - 20) : a.start()]):
                found.setdefault((a.start(), b.end(), 4), (len(_SHAPES), ((a, b), (), ())))
    return [(s, e, k, g, pieces) for (s, e, k), (g, pieces) in found.items()]


def _sub_runs(text: str, run: re.Match) -> Iterator[tuple[int, int, int, tuple]]:
    """Sub-runs of a run of capitalised words that have the shape of a name."""
    pieces = list(_PIECES.finditer(text, run.start(), run.end()))
    kinds = ["I" if m.end() - m.start() <= 2 and (m.end() - m.start() == 1 or text[m.end() - 1] == ".") else "W" for m in pieces]
    comma = [text[m.end() : m.end() + 1] == "," for m in pieces]
    last = len(pieces)
    for i in range(last):
        shape = kinds[i] + ("," if comma[i] else "")
        for j in range(i + 1, min(i + 4, last)):
            if comma[j - 1] and j - 1 > i:
                break
            shape += kinds[j]
            g = _SHAPES.get(shape)
            if g is not None:
                yield pieces[i].start(), pieces[j].end(), g, (pieces[i : j + 1], pieces[max(0, i - 2) : i], pieces[j + 1 : j + 4])


def _around(text: str, sign: re.Pattern, before: int, after: int, digits: int = 0) -> list[list[int]]:
    """Joined stretches of the text around every sign; with ``digits`` of every one that has so many and is no date."""
    out: list[list[int]] = []
    for m in sign.finditer(text):
        if digits and (sum(map(str.isdigit, m.group())) < digits or _DATE.match(m.group())):
            continue
        a, b = max(0, m.start() - before), min(len(text), m.end() + after)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    for stretch in out:  # a stretch begins and ends between words
        while stretch[0] > 0 and not text[stretch[0] - 1].isspace():
            stretch[0] -= 1
        while stretch[1] < len(text) and not text[stretch[1]].isspace():
            stretch[1] += 1
    return out


def _address_ends(text: str, s: int, e: int) -> list[int]:
    """Where an address that begins at ``s`` may end: after each part, after each word of a part, after a postal code."""
    ends = {e}
    commas = [i for i in range(s, e) if text[i] == ","]
    for a in commas:  # inside a part, after each word
        stop = next((c for c in commas if c > a), e)
        ends.update(a + w.end() for w in re.finditer(r"\S+", text[a:stop]) if w.start() > 0 and a + w.end() <= stop)
    for p in _POSTAL.finditer(text, s, min(len(text), e + 12)):
        ends.add(p.end())
    out = {s + len(text[s:end].rstrip(" ,.")) for end in ends}
    return sorted(end for end in out if commas and end > commas[0] + 1)


def _near(cue: re.Pattern, before: str) -> int:
    """Nearness of the last cue in the text before; 0 if there is none."""
    m = cue.match(before)
    return 49 - (len(before) - m.end()) if m else 0


def _checksum(digits: str) -> bool:
    """Does the last digit agree with the dihedral check sum of a personal number?"""
    c = 0
    for i, ch in enumerate(reversed(digits)):
        c = _dihedral(c, _permuted(int(ch), i % 8))
    return c == 0


def _dihedral(a: int, b: int) -> int:
    """Product in the dihedral group of ten elements."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _permuted(x: int, times: int) -> int:
    for _ in range(times):
        x = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[x]  # fixed permutation of the check sum
    return x


def _context(text: str, low: str, s: int, kind: int) -> tuple:
    """What stands before a span; spans of one start share it."""
    before = low[max(0, s - 48) : s]
    shared = (_near(_CUES[TYPES[kind]], before), _near(_AGAINST, before), before[-1:].isalnum() or before[-1:] in "@/.+-", text[s - 1 : s] == "(", before[-2:-1] == ":")
    if kind == 0:
        return *shared, bool(re.search(r"(?:dot|\.|\]|\))\s*$", before))
    if kind < 3:
        return *shared, _near(_CUES["phone"], before), _near(_CUES["id_number"], before)
    return shared


def _general(text: str, low: str, s: int, e: int, kind: int, g: int, lexicon: Lexicon) -> tuple:
    span, after = text[s:e], text[e : e + 14]
    rest = after.lstrip(" ")
    digits = [c for c in span if c.isdigit()]
    shared = (
        g, e - s, len(digits), span.count(","), span.count("\n"), len(re.findall(r"[ \-./()]", span)),
        after[:1] == "/", after[:1].isalnum(), rest[:1].isupper(), rest[:1].isdigit(), after[:1] in "-@_",
    )
    if kind == 0:
        return *shared, "@" in span, "at" in low[s:e], "dot" in low[s:e], bool(re.match(r"\s*(?:dot|\[|\(|\.[a-z])", low[e : e + 14])), span.isupper(), span.count(" ")
    if kind < 3:
        parts = re.split(r"\D+", span.strip("()+"))
        return (
            *shared, span[:1] in "+(", span[:1] == "0", span[:4] == "1800", "-" in span, "." in span, len(parts[0]), len(parts[-1]), len(parts), digits[:1] > ["5"],
            len(digits) == 12 and _checksum("".join(str(int(c)) for c in digits)), bool(_DATE.match(span)),
        )
    words, tail = _TOKEN.findall(span), span.rsplit(",", 1)[-1]
    first = lexicon.of(words[0] if words else "")
    last = lexicon.of(words[-1] if words else "")
    return (
        *shared, len(words), sum(w[0].isupper() for w in words), bool(_STREET.search(low, s, e)), bool(_POSTAL.search(span)), bool(_POSTAL.search(span, max(0, len(span) - 7))), bool(_PIN_AFTER.match(after)),
        bool(_PART_AFTER.match(after)), *lexicon.table[first, 4:], bool(_STREET.search(tail.lower())), len(tail.split()), rest[:1].isupper() and after[:1].isspace(), lexicon.table[last, _COMMON],
    )


_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d$")
_PIN_AFTER = re.compile(r"[\s,-]*(?:PIN\s*)?\d{3}\s?\d{3}(?!\d)")
_PART_AFTER = re.compile(r"\s*,\s*[A-Z\d]")


def _name_left(text: str, low: str, s: int, left: tuple, lexicon: Lexicon) -> tuple[tuple, tuple]:
    stretch = text[max(0, s - 32) : s]
    words = list(_TOKEN.finditer(stretch))[-2:]
    gap = stretch[words[-1].end() :] if words else stretch[-1:]
    ids = [0, 0, *[lexicon.of(w.group()) for w in words]][-2:]
    between = text[left[-1].end() : s] if left else "x"
    flags = (not between.strip(". ") and "\n" not in between, "\n" in gap, ":" in gap, "." in gap, "," in gap, "(" in gap, gap == "", _near(_CUES["name"], low[max(0, s - 48) : s]))
    return flags, (*ids, *[lexicon.of(x.group()) for x in left[-2:]], *[0] * (2 - len(left)))


def _name_right(text: str, e: int, right: tuple, lexicon: Lexicon) -> tuple[tuple, tuple]:
    after = text[e : e + 2]
    follows = bool(right) and not text[e : right[0].start()].strip()
    flags = (follows, after[:1] == ",", after[:1] == ".", "(" in after, after[:1] == "\n", bool(right) and not follows)
    return flags, tuple(lexicon.of(r.group()) for r in right) + (0,) * (3 - len(right)) if follows else (0, 0, 0)


class Rows:
    """Features of the candidates of many texts, a table for each type in the order of ``add``."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.rows: list[list[tuple]] = [[] for _ in TYPES]
        self.tokens: list[tuple] = []

    def add(self, text: str, found: list[Candidate]) -> None:
        low, lexicon, seen = lower(text), self.lexicon, {}
        for s, e, k, g, pieces in found:
            if k < 4:
                before = seen.get((s, k))
                if before is None:
                    before = seen[s, k] = _context(text, low, s, k)
                self.rows[k].append(_general(text, low, s, e, k, g, lexicon) + before)
                continue
            own, left, right = pieces
            before, after = seen.get((s, 4)), seen.get((e, 5))
            if before is None:
                before = seen[s, 4] = _name_left(text, low, s, left, lexicon)
            if after is None:
                after = seen[e, 5] = _name_right(text, e, right, lexicon)
            head, tail = own[0].group(), own[-1].group()
            self.rows[4].append((g, len(own), e - s, "\n" in text[s:e], text[s:e].isupper(), f" {head.lower()}" in text, f" {tail.lower()}" in text, *before[0], *after[0]))
            self.tokens.append((lexicon.of(head), lexicon.of(tail), lexicon.of(own[1].group()) if len(own) > 2 else 0, *before[1], *after[1]))

    def tables(self) -> list[np.ndarray]:
        out = [np.array(r, dtype=np.float32) for r in self.rows]
        if self.tokens:
            ids, t = np.array(self.tokens), self.lexicon.table
            first, last, middle, earlier, previous, left1, left2, next1, next2, next3 = ids.T
            any_own = np.maximum(np.maximum(t[first], t[last]), t[middle])[:, 6:]
            behind, ahead = np.maximum(t[left1], t[left2]), np.maximum(np.maximum(t[next1], t[next2]), t[next3])
            out[4] = np.concatenate([out[4], t[first], t[last], t[middle], t[previous], t[next1], t[earlier, 6:], any_own, behind[:, 6:], ahead[:, 6:]], axis=1)
        return out
