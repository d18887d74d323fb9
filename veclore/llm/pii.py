"""Personal information in free text by a semi-Markov conditional random field (problem 8).

Grammars propose candidate segments: every reading of a stretch of text as an e-mail address, phone number, identity
number, postal address or name, with all its possible ends. A segment is scored as a whole (its shape, its parts' place
in the name lists, the words before and after it), neighbouring segments also by their kinds, and a dynamic program over
the segments picks the best set that does not overlap: boundaries and kinds are chosen together. Entities are bounded by
their grammar, so the program is linear in the text.

The weights are fitted by maximum likelihood (forward-backward over the same segments) on a sample of at most
``TRAIN_ROWS`` documents, those with the smallest hashed ids, leaving out runs of more than ``ISLAND`` segments. Their labels are silver: a segment with an unmistakable
label in front of it, or a name of which both parts are listed, is one; a segment behind a label of something else
(invoice, order, version ...) is none; everything in between is left out of the likelihood. The name lists are hidden
from half of the names while fitting, so that unlisted names are learned from form and context. Whether a word mostly
stands beside a listed name part is counted over all documents.

Defined cases: NULL and empty texts have nothing; a text is read whole however long it is; repeated entities of a page
are one row; without labelled segments the weights are the prior ones, so that only unmistakable segments are found.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclore.runtime import written

TRAIN_ROWS = 3000
#: Words of the corpus that are sent to every task; of more, each page is given its own.
MAX_WORDS = 200_000
#: Share of a word's places beside a listed name part from which on it counts as part of names.
MOSTLY = 0.25
#: Segments of a run that is fitted on: the sums over its sets grow with their square. Longer runs are decoded like all others.
ISLAND = 60
#: Listed name parts at most: the lists go to every task.
MAX_PARTS = 1_000_000
KINDS = ("email", "phone", "id_number", "address", "name")
NEAR = 3

_W = r"[^\W\d_]"
# a two-byte letter that was decoded with the wrong charset
_BAD = r"[ÂÃÄÅ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]"
_UP = r"[A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻŠŽČÉА-ЯЁ]"
_LETTER = rf"(?:{_BAD}|{_W})"
_CAP = rf"(?:{_BAD}|{_UP}){_LETTER}*(?:['’]{_UP}{_LETTER}+)?"
_PARTICLE = r"(?:van der|van den|van|von der|von|de la|de|del|der|di|da|la|le|ten|ter|af|av|VAN DER|VAN|VON|DE LA|DE|DEL|DER|DI|DA) "
_GIVEN = rf"{_CAP}(?:-{_CAP})*"
_INITIAL = rf"{_UP}\."
_END = r"(?![\w\u0080-\u009f¡-©¬-¶¸-º¼-¿])"
_FAMILY = rf"(?:{_PARTICLE})?{_CAP}(?:-{_CAP})*"
NAME = re.compile(rf"(?<![\w'’@.+-])(?=(?P<a>(?:{_INITIAL}|{_GIVEN})(?:\s{_INITIAL})?\s{_FAMILY}){_END}|(?P<b>{_FAMILY},\s{_GIVEN}(?:\s{_INITIAL})?){_END})(?=[A-ZÀ-ÞĄĆĘŁŃÓŚŹŻŠŽА-ЯЁa-z])")
_DOT = r"(?:\.|\s?\[\.\]\s?|\s?\(\.\)\s?|\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)"
EMAIL = re.compile(
    rf"(?i)(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*(?:(?:\s?@\s?|\s?\[@\]\s?|\s?\(@\)\s?|\s?\(at\)\s?|\s?\[at\]\s?)(?:[a-z0-9-]+{_DOT})+[a-z]{{2,}}|\sat\s(?:[a-z0-9-]+(?:\sdot\s|\s?\[dot\]\s?|\s?\(dot\)\s?))+[a-z]{{2,}})(?![\w@])"
)
_MAIL = re.compile(r"(?i)@|[\[(]at[\])]|\bdot\b")  # every address has one of these
DIGITS = re.compile(r"(?<![\w.,/+-])(?:\+\s?|\()?\d(?:[ .\-/()  ]{0,2}\d)+(?:-[A-Z])?(?![\w])")
LETTERED = re.compile(r"(?<![\w-])[A-Z]{1,3}(?:[ -]?\d{2,}){1,5}(?:[ -][A-Z])?(?![\w-])")
_TOWN = rf"(?:(?:Sankt|Saint|San|Bad|St\.?) )?{_CAP}(?:-{_CAP})*"
_SEP = r"(?:,\s|\n)"
_NO = r"\d+ ?(?:[a-zA-Z](?!\w)|bis|ter)?"
_STREETWORD = rf"{_LETTER}+(?:['’]{_LETTER}+)?\.?"
ADDRESS = [
    # number first: 12 Mill Road, Town 1234 / 12 bis rue des Ormes, 12345 Town
    ("number_first", rf"(?:(?:Flat|Apt\.?|Unit) \d+[a-z]?,\s)?{_NO},? (?:{_STREETWORD}[ -]){{0,4}}{_LETTER}+(?:['’]{_LETTER}+)?"),
    ("box", r"(?:P\. ?O\. ?Box|PO Box|Postfach|Apartado|BP|skr\. poczt\.|а/я) \d+"),
    # street first: Am Hafen 12a, D-12345 Town / Calle del Olmo, 4, 2.º B, 12345 Town / ul. Lipowa 3/4, 12-345 Town
    ("street_first", rf"(?:{_CAP}\.?|ul\.|C/|пл\.|ул\.|al\.|os\.|pl\.)(?:[ -]{_STREETWORD}){{0,4}},? \d+ ?(?:[a-z](?!\w))?(?:/\d+)?(?:, \d+\.?[ºª°o]? ?[A-Z]?(?!\w))?"),
]
_PLACE_CODE_FIRST = rf"(?:[A-Z]{{1,2}}-)?\d{{2}}-?\d{{3}}\s{_TOWN}"
_PLACE_CODE_LAST = rf"{_TOWN}(?: \d{{4,5}}(?!\d))?"
ADDRESSES = [(kind, re.compile(rf"(?<![\w/-])(?P<street>{street})(?P<sep>{_SEP})(?P<place>{_PLACE_CODE_FIRST}|{_PLACE_CODE_LAST})(?![\w-])")) for kind, street in ADDRESS]
#: Words that make a stretch a street; with a code in front of the town none is needed.
_STREET = re.compile(
    r"(?i)\b(?:road|lane|row|close|terrace|avenue|street|way|drive|place|square|court|hill|rise|mews|crescent|gardens|grove|walk|yard|avenida|calle|plaza|paseo|camino|rue|bd|boulevard|chemin|impasse|quai|cours|all[ée]e|all\w*|ul|ulica|aleja)\b|(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm|ring)\b|C/"
)

#: Words that make a pair of capitalised words a place or a thing; fixed words.
_PLACE_FIRST = re.compile(r"(?i)(?:the|lake|mount|fort|port|cape|river|saint|san|santa|new|old|upper|lower|north|south|east|west|lac|mont|place|rue|lago|monte|calle|plaza|avenida|der|die|das|le|la|el|los|las|les|jezioro|ulica|озеро|гора|улица|площадь)[\s,]")
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "frau", "herr", "fräulein", "mme", "mlle", "monsieur", "madame", "señor", "señora", "don", "doña", "sr", "sra", "pan", "pani", "г-н", "г-жа", "господин", "госпожа"}
_THING_LAST = re.compile(r"\s(?:&|and Sons|Prize|Award|Square|Street|Road|Lane|Row|Close|Terrace|Avenue|Park|Bridge|Institute|Library|Hospital|Museum|GmbH|Ltd|Inc|SA|AG)\b|\s?&")

#: What a label in front of a segment says about it, in the languages of the pages; fixed words.
LABELS = [
    ("phone", re.compile(r"(?i)(?:\btel|phone|\bcall|mobile|\bring|telefon\w*|t[ée]l|тел|звоните|erreicht|appeler|llam[ae]\w*|zadzwo\w*|dzwoni\w*|fax|handy|m[óo]vil|кому)\b[^\n\d+(]{0,24}$")),
    ("id_number", re.compile(r"(?i)(?:passport|passeport|pasaporte|paszport\w*|паспорт\w*|\bID|identi\w+|ausweis\w*|tax number|steuernummer|steuer-?id|social insurance|sozialversicherung\w*|insurance|s[ée]curit[ée] sociale|seguridad social|pesel|\bnip|dowod\w*|dowód|снилс|инн|\bDNI|\bNIF|\bNIE)\b[^\n\d]{0,16}$")),
    ("address", re.compile(r"(?i)(?:address|anschrift|adresse|adres|адрес|direcci[óo]n|domicilio|parcels? (?:go|goes) to|collected at|paket ging an|colis (?:part|va) (?:au|à)|caja va a|paczka\w* \w+ (?:do|na)|посылка \w+ (?:на|в|по)|lived at|habite|wohnt|mieszka|vive en)\b[^\n\d]{0,12}$")),
    ("none", re.compile(r"(?i)(?:invoice|order no|order|tracking|version|isbn|article code|article|sample|price|score was|coordinates|room|parcel|rechnung\w*|commande|facture|pedido|factura|zam[óo]wieni\w*|faktur\w*|заказ\w*|счёт|release|build|№|art\.|on)\b[^\n\d]{0,10}$")),
]


def _word_before(text: str, at: int) -> list[str]:
    return re.findall(r"\w+", text[max(0, at - 24) : at].lower())[-2:]


def _shape(s: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))[:24]


def _edge(text: str, at: int, step: int) -> str:
    """The sign next to a segment, blanks skipped: line ends and text ends are signs too."""
    i = at - 1 if step < 0 else at
    while 0 <= i < len(text) and text[i] in "  \t":
        i += step
    if not 0 <= i < len(text) or text[i] == "\n":
        return "line"
    return "word" if text[i].isalnum() else text[i]


class Lists(NamedTuple):
    """Listed name parts in lower case, and what the corpus says about the other words: do they stand beside a listed part?"""

    given: set[str]
    family: set[str]
    near: dict[str, bool]


class Segment:
    __slots__ = ("start", "end", "kind", "features", "silver", "score")

    def __init__(self, start: int, end: int, kind: str, features: list[str], silver: bool | None):
        self.start, self.end, self.kind, self.features, self.silver, self.score = start, end, kind, features, silver, 0.0


def _context(text: str, start: int, end: int, kind: str) -> list[str]:
    before, after = _word_before(text, start), re.match(r"[\s,]*(\w*)", text[end : end + 24])[1].lower()
    last = before[-1] if before else ""
    return [
        kind, f"{kind}<{last}", f"{kind}<<{' '.join(before)}", f"{kind}>{after if not after.isdigit() else '9'}", f"{kind}({_edge(text, start, -1)}", f"{kind}){_edge(text, end, 1)}",
    ]


def _label(text: str, start: int) -> str | None:
    left = text[max(0, start - 48) : start]
    for kind, pattern in LABELS:
        if pattern.search(left):
            return kind
    return None


def _number_segments(text: str) -> Iterator[Segment]:
    for m in DIGITS.finditer(text):
        s, start = m[0], m.start()
        if s[0] == "(" and ")" not in s:
            s, start = s[1:], start + 1
        n = sum(c.isdigit() for c in s)
        if n < 7 or "  " in s:
            continue
        label = _label(text, start)
        for kind in ("phone", "id_number"):
            silver = (label == kind) if label in ("phone", "id_number", "none") else None
            lead = "+" if s[0] == "+" else "(" if s[0] == "(" else "00" if s.startswith("00") else "0" if s[0] == "0" else "n"
            f = _context(text, start, start + len(s), kind) + [f"{kind}~{_shape(s)}", f"{kind}#{n}", f"{kind}^{lead}{n}", f"{kind}^{lead}", f"{kind}:{label}"]
            yield Segment(start, start + len(s), kind, f, silver)
    for m in LETTERED.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 6:
            label = _label(text, m.start())
            f = _context(text, m.start(), m.end(), "id_number") + [f"id_number~{_shape(m[0])}", f"id_number!{re.match('[A-Z]+', m[0])[0]}", f"id_number:{label}"]
            yield Segment(m.start(), m.end(), "id_number", f, (label == "id_number") if label in ("id_number", "none") else None)


def _address_segments(text: str) -> Iterator[Segment]:
    for grammar, pattern in ADDRESSES:
        at = 0
        while m := pattern.search(text, at):
            at = m.start() + 1
            street, place = m["street"], m["place"]
            coded = bool(re.search(r"\d{4}", place.replace("-", "")))
            streety = bool(_STREET.search(street)) or grammar == "box"
            if not (coded or streety):
                continue
            f = _context(text, m.start(), m.end(), "address") + [
                f"address@{grammar}", f"address.code{coded}", f"address.street{streety}", f"address.{coded}{streety}{grammar}", f"address.lines{min(2, street.count(chr(10)))}", f"address.words{len(street.split())}", f"address:{_label(text, m.start())}"
            ]
            low = re.sub(r"(?<!\w)(?:de|del|des|du|la|le|les|el|los|las|al|an|am|der|den|dem|im|zum|zur|bis|ter|rue|bd|chemin|place|avenue|quai|ul)(?!\w)", "", street)
            plain = sum(w[0].islower() for w in low.split())
            f.append(f"address.low{plain}")
            f.append(f"address.first{re.match(r'[^ ]*', street)[0].lower() if not street[0].isdigit() else '9'}")
            f.append(f"address.low{min(plain, 3)}{coded}")
            led = _label(text, m.start()) == "address" or _edge(text, m.start(), -1) in ("line", "|", "-")
            yield Segment(m.start(), m.end(), "address", f, True if led and coded and streety and not plain and chr(10) not in street else False if plain >= 2 and not coded else None)


def _status(token: str, listed: set[str], near: dict[str, bool]) -> str:
    """``k``: listed; ``h``, ``l``: in the corpus it mostly stands, or mostly doesn't stand, beside a listed part; ``u``: unseen there."""
    bare = re.sub(f"(?i)^{_PARTICLE}", "", token.lower())
    pieces = bare.split("-")
    if token.lower() in listed or bare in listed or all(p in listed for p in pieces):
        return "k"
    if any(p in listed for p in pieces) or any(near.get(p) for p in (bare, *pieces)):
        return "h"
    return "l" if any(near.get(p) is False for p in (bare, *pieces)) else "u"


def _name_parts(s: str, turned: bool) -> tuple[str, str]:
    """Given name or initial, and family name, of a candidate."""
    if turned:
        last, first = s.split(",", 1)
        return first.split()[0], last
    first = s.split()[0]
    return first, re.sub(rf"^{_INITIAL}\s", "", s[len(first) :].strip()).strip()


def _name_segments(text: str, lists: Lists, hide: random.Random | None) -> Iterator[Segment]:
    for m in NAME.finditer(text):
        for turned, s in ((False, m["a"]), (True, m["b"])):
            if not s:
                continue
            first, last = _name_parts(s, turned)
            initial = bool(re.fullmatch(_INITIAL, first))
            g = "i" if initial else _status(first, lists.given, lists.near)
            k = _status(last, lists.family, lists.near)
            silver = True if g in "ik" and k == "k" else False if "l" in g + k and "k" not in g + k else None
            title = first.rstrip(".").lower() in _TITLES and len(first) > 2
            led = re.search(rf"({_UP}{_LETTER}+) $", text[max(0, m.start() - 24) : m.start()]) if initial else None
            inner = bool(led) and led[1].lower() not in _TITLES
            thing = bool(_THING_LAST.match(text[m.start() + len(s) : m.start() + len(s) + 14]) or _THING_LAST.search(s))
            if inner or title or thing or _PLACE_FIRST.match(s):
                silver = False
            if hide is not None and hide.random() < 0.5:  # as if a part, or both, were not listed
                g = "h" if g == "k" and hide.random() < 0.6 else g
                k = "h" if k == "k" and hide.random() < 0.6 else k
            start, end = m.start(), m.start() + len(s)
            f = _context(text, start, end, "name") + [
                f"name={g}{k}", f"name.turned{turned}", f"name.upper{last.isupper()}{first.isupper()}", f"name.mid{bool(re.search(_UP + '[.] ', s[3:]))}", f"name.particle{bool(re.match(_PARTICLE, last))}", f"name.line{chr(10) in s}",
                f"name.familyfirst{first.lower() in lists.family}", f"name.givenlast{last.lower() in lists.given}", f"name.thing{thing}", f"name.place{bool(_PLACE_FIRST.match(s))}", f"name.title{title}", f"name.inner{inner}",
            ]
            yield Segment(start, end, "name", f, silver)


def segments(text: str, lists: Lists, hide: random.Random | None = None) -> list[Segment]:
    """All candidate segments, by start."""
    out = []
    for m in EMAIL.finditer(text) if _MAIL.search(text) else ():
        out.append(Segment(m.start(), m.end(), "email", _context(text, m.start(), m.end(), "email") + [f"email~{'@' in m[0]}", f"email.{m[0].count('.') > 0}"], True))
    out += _number_segments(text)
    out += _address_segments(text)
    out += _name_segments(text, lists, hide)
    out.sort(key=lambda s: (s.start, s.end))
    return out


def _step(weights: dict[str, float], a: Segment, b: Segment) -> float:
    return weights.get(f"{a.kind}|{b.kind}", 0.0) if b.start - a.end <= NEAR else 0.0


def best(candidates: list[Segment], weights: dict[str, float]) -> list[Segment]:
    """The set of segments without overlaps that has the highest score. Ends are kept in a heap: a segment looks back only
    at those that end within ``NEAR`` signs before it, and at the best of all that end earlier."""
    far, far_of, heap, done = 0.0, None, [], []
    for i, s in enumerate(candidates):
        s.score = sum(weights.get(f, 0.0) for f in s.features)
        while heap and heap[0][0] < s.start - NEAR:
            _, j = heapq.heappop(heap)
            if done[j][0] > far:
                far, far_of = done[j][0], j
        value, back = far, far_of
        for end, j in heap:
            if end <= s.start and done[j][0] + _step(weights, candidates[j], s) > value:
                value, back = done[j][0] + _step(weights, candidates[j], s), j
        done.append((value + s.score, back))
        heapq.heappush(heap, (s.end, i))
    at, top = None, 0.0
    for i, (value, _) in enumerate(done):
        if value > top:
            at, top = i, value
    out = []
    while at is not None:
        out.append(candidates[at])
        at = done[at][1]
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _expected(island: list[Segment], weights: dict[str, float]) -> tuple[list[float], dict[str, float]]:
    """Marginal probability of each segment, and expected count of each step, over all sets without overlaps."""
    n = len(island)
    score = [sum(weights.get(f, 0.0) for f in s.features) for s in island]
    forward, backward = [0.0] * n, [0.0] * n
    before = [[j for j in range(i) if island[j].end <= s.start] for i, s in enumerate(island)]
    for i, s in enumerate(island):
        forward[i] = score[i] + _log_sum([0.0, *(forward[j] + _step(weights, island[j], s) for j in before[i])])
    after: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        for j in before[i]:
            after[j].append(i)
    for j in range(n - 1, -1, -1):
        backward[j] = _log_sum([0.0, *(score[i] + _step(weights, island[j], island[i]) + backward[i] for i in after[j])])
    z = _log_sum([0.0, *forward])
    steps: dict[str, float] = {}
    for i in range(n):
        for j in before[i]:
            if island[i].start - island[j].end <= NEAR:
                p = math.exp(forward[j] + _step(weights, island[j], island[i]) + score[i] + backward[i] - z)
                key = f"{island[j].kind}|{island[i].kind}"
                steps[key] = steps.get(key, 0.0) + p
    return [math.exp(f + b - z) for f, b in zip(forward, backward)], steps


def islands(candidates: list[Segment]) -> Iterator[list[Segment]]:
    """Runs of segments that overlap or lie within ``NEAR`` of each other."""
    run, end = [], -1
    for s in candidates:
        if run and s.start > end + NEAR:
            yield run
            run = []
        run.append(s)
        end = max(end, s.end) if len(run) > 1 else s.end
    if run:
        yield run


def _gold(island: list[Segment]) -> list[Segment]:
    """The true segments of an island: the longest first, without overlaps."""
    out: list[Segment] = []
    for s in sorted((s for s in island if s.silver), key=lambda s: (s.start - s.end, s.start)):
        if all(s.end <= o.start or o.end <= s.start for o in out):
            out.append(s)
    return sorted(out, key=lambda s: s.start)


#: Before any page is seen: the bias of each kind, and what the name lists mean.
PRIOR = {"email": 2.0, "phone": -1.0, "id_number": -1.0, "address": 0.5, "name": -3.0, "name=kk": 4.0, "name=ik": 3.0, "name=hk": 2.5, "name=kh": 2.5, "name=ih": 2.0, "name=hh": 1.5, "name.titleTrue": -4.0, "name.innerTrue": -3.0, "name.thingTrue": -4.0, "name.placeTrue": -4.0, "address.low1": -1.0, "address.low2": -2.0, "address.low3": -3.0, "address.low4": -3.0, "address.low2False": -2.0, "address.low3False": -3.0, "name.lineTrue": -0.5}


_WORD = re.compile(rf"{_CAP}(?:-{_CAP})*")


#: How far a word looks for its neighbours.
_BESIDE = 32
_BEFORE = re.compile(rf"(\S+),?\s(?:{_INITIAL}\s)?(?:{_PARTICLE})?$")
_AFTER = re.compile(rf",?\s(?:{_INITIAL}\s)?(?:{_PARTICLE})?(\S+)")
_TOKEN = re.compile(r"\S+")


def _is_listed(token: str, listed: set[str]) -> bool:
    token = token.strip(".,;:!?").lower()
    return token in listed or token.split("-")[0] in listed


def beside_counts(texts: Iterable[str], listed: set[str]) -> dict[str, list[int]]:
    """For each capitalised word that is not listed: in how many places it stands, and in how many beside a listed name part.
    Only words near a listed part are looked at closely."""
    counts: dict[str, list[int]] = {}
    for t in texts:
        marks = bytearray(len(t) + 1)  # where a listed part is near
        for m in _TOKEN.finditer(t):
            if _is_listed(m[0], listed):
                low, high = max(0, m.start() - _BESIDE - 1), min(len(t), m.end() + _BESIDE + 1)
                marks[low:high] = b"\1" * (high - low)
        for m in _WORD.finditer(t):
            start, end = m.span()
            if _THING_LAST.match(t[end : end + 14]):
                continue
            near = False
            if marks[start] or marks[end]:
                before, after = _BEFORE.search(t[max(0, start - _BESIDE) : start]), _AFTER.match(t[end : end + _BESIDE])
                near = any(_is_listed(x[1], listed) for x in (before, after) if x)
            word = m[0].lower()
            for w in {word, *word.split("-")} if "-" in word else (word,):
                if w not in listed:
                    count = counts.setdefault(w, [0, 0])
                    count[0] += 1
                    count[1] += near
    return counts


def neighbours(texts: list[str], given: set[str], family: set[str]) -> dict[str, bool]:
    """For each capitalised word of the texts: whether it mostly stands beside a listed name part."""
    return {w: beside >= MOSTLY * n for w, (n, beside) in beside_counts(texts, given | family).items()}


def corpus_words(pages: DataFrame, listed: set[str]) -> DataFrame:
    """(word, near) as ``neighbours``, counted over all pages; a task combines its counts before the shuffle."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        for b in batches:
            for w, (n, beside) in beside_counts(b.text, listed).items():
                count = held.setdefault(w, [0, 0])
                count[0] += n
                count[1] += beside
            if len(held) > 200_000:
                yield _counts(held)
                held = {}
        if held:
            yield _counts(held)

    sums = pages.select("text").mapInPandas(counted, "word string, n bigint, beside bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("beside").alias("beside"))
    return written(sums.select("word", (F.col("beside") >= F.lit(MOSTLY) * F.col("n")).alias("near")), "words")


def _counts(held: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(w, *c) for w, c in held.items()], columns=["word", "n", "beside"])


class _Asked(dict):
    """Holds nothing and keeps what it is asked for."""

    def get(self, key, default=None):
        self[key] = None
        return default


def asked_words(text: str, given: set[str], family: set[str]) -> list[str]:
    """The words whose ``near`` the name segments of a text depend on."""
    asked = _Asked()
    for _ in _name_segments(text, Lists(given, family, asked), None):
        pass
    return list(asked)


def fit(texts: list[str], given: set[str], family: set[str], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 1, near: dict[str, bool] | None = None) -> tuple[dict[str, float], Lists]:
    """Weights by stochastic gradient ascent on the log-likelihood of the silver labels, with steps scaled per feature.
    Without ``near`` the words are counted on ``texts``."""
    weights, squares = dict(PRIOR), {}
    lists = Lists(given, family, neighbours(texts, given, family) if near is None else near)
    hide, data = random.Random(seed), []
    for t in texts:
        for island in islands(segments(t, lists, hide)):
            gold = _gold(island)
            kept = [s for s in island if s.silver is not None or any(s.start < o.end and o.start < s.end for o in gold)]
            if kept and len(kept) <= ISLAND:
                data.append((kept, gold))
    for _ in range(rounds):
        hide.shuffle(data)
        for island, gold in data:
            marginal, steps = _expected(island, weights)
            gradient: dict[str, float] = {k: -v for k, v in steps.items()}
            for s, p in zip(island, marginal):
                for f in s.features:
                    gradient[f] = gradient.get(f, 0.0) - p
            for s in gold:
                for f in s.features:
                    gradient[f] = gradient.get(f, 0.0) + 1.0
            for a, b in zip(gold, gold[1:]):
                if b.start - a.end <= NEAR:
                    gradient[f"{a.kind}|{b.kind}"] = gradient.get(f"{a.kind}|{b.kind}", 0.0) + 1.0
            for f, g in gradient.items():
                if abs(g) > 1e-4:
                    g -= decay * (weights.get(f, 0.0) - PRIOR.get(f, 0.0))
                    squares[f] = squares.get(f, 0.1) + g * g
                    weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
    return {f: round(w, 4) for f, w in weights.items() if abs(w) > 0.02}, lists


class Model(NamedTuple):
    """``words``: (word, near) of the corpus where they are too many for ``lists`` to hold them all."""

    weights: dict[str, float]
    lists: Lists
    words: DataFrame | None


def train(documents: DataFrame, name_parts: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """At most ``rows`` documents, those with the smallest hashed id, come to the driver; words are counted over all. More than
    ``MAX_PARTS`` name parts are an error."""
    listed = name_parts.where("name_part is not null").select(F.lower("name_part").alias("part"), "part_kind").distinct().limit(MAX_PARTS + 1).collect()
    if len(listed) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} name parts")
    parts = [(r["part"], r["part_kind"]) for r in listed]
    given, family = {p for p, k in parts if k == "given"}, {p for p, k in parts if k == "family"}
    pages = documents.where("text is not null and text != ''").select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h"))
    # a threshold on the hash first, so that not every task sends ``rows`` texts
    share = min(1.0, 1.3 * rows / max(1, pages.count()))
    sample = pages.where(F.col("h") <= min(int(share * 2**63), 2**63 - 1)).orderBy("h", "doc_id").select("text").limit(rows).collect()
    texts = [r["text"] for r in sample]
    words = corpus_words(pages, given | family)
    many = words.limit(MAX_WORDS + 1).count() > MAX_WORDS
    known = words
    if many:
        asked = sorted({w for t in texts for w in asked_words(t, given, family)})
        known = words.join(documents.sparkSession.createDataFrame([(w,) for w in asked], "word string"), "word", "left_semi")
    near = {r["word"]: r["near"] for r in known.collect()}
    weights, lists = fit(texts, given, family, near=near)
    return Model(weights, lists._replace(near={}) if many else lists, words if many else None)


def entities(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, found: array of (kind, start, end)) of every document with text, positions in code points. Each page
    is given the words it asks for by a join where the model doesn't hold them all."""
    weights, lists, words = model
    pages = documents.where("text is not null and text != ''").select("doc_id", "text")

    def read(text: str, lists: Lists) -> list[dict]:
        return [{"kind": s.kind, "start": s.start, "end": s.end} for s in best(segments(text, lists), weights)]

    if words is None:

        @F.pandas_udf("array<struct<kind string, start int, end int>>")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([read(t, lists) for t in texts], dtype=object)

        return pages.select("doc_id", "text", find("text").alias("found"))

    @F.pandas_udf("array<string>")
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([asked_words(t, lists.given, lists.family) for t in texts], dtype=object)

    @F.pandas_udf("array<struct<kind string, start int, end int>>")
    def find_with(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, near, far in batches:
            own = [dict.fromkeys([] if n is None else n, True) | dict.fromkeys([] if f is None else f, False) for n, f in zip(near, far)]
            yield pd.Series([read(t, lists._replace(near=o)) for t, o in zip(texts, own)], dtype=object)

    known = pages.select("doc_id", F.explode(asked("text")).alias("word")).distinct().join(words, "word")
    known = known.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.when(F.col("near"), F.col("word"))).alias("yes"), F.collect_list(F.when(~F.col("near"), F.col("word"))).alias("no"))
    return pages.join(known, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", find_with("text", "yes", "no").alias("found"))


def found_texts(documents: DataFrame, model) -> DataFrame:
    """(doc_id, kind, pii_text), distinct."""
    each = entities(documents, model).select("doc_id", "text", F.explode("found").alias("e"))
    return each.select("doc_id", "e.kind", F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("pii_text")).distinct()


def redacted(documents: DataFrame, model) -> DataFrame:
    """(doc_id, text, entities): the text with ``[EMAIL]``, ``[PHONE]`` ... in place of each entity, all else as it was."""
    whole = entities(documents, model)
    piece = F.aggregate(
        "found",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, e: F.struct(F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, e["start"] - acc["at"]), F.lit("["), F.upper(e["kind"]), F.lit("]")).alias("done"), e["end"].alias("at")),
    )
    return whole.withColumn("p", piece).select("doc_id", F.concat("p.done", F.expr("substring(text, p.at + 1)")).alias("text"), F.size("found").alias("entities"))
