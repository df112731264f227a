"""Personal data by a semi-Markov conditional random field.

A text is a sequence of tokens (runs of letters and digits, single other marks, single blanks). A segmentation cuts it in
entities of at most `LONGEST` tokens and in single tokens outside; its score is the sum of its segments', and an
entity's score is linear in features of the whole span (how its characters make up an address, a number, a key; whether
checksums hold; what stands at either side). Dynamic programming over end positions and bounded lengths finds the best
segmentation, boundaries and types together.

The weights are trained here, by gradient ascent on the conditional log likelihood (forward-backward over segments) of sentences
made from templates with a fixed seed.

The lattice holds the spans that a type can have at all: those with a digit or an at sign; what a credential's name is assigned to,
letters alone too; capitalised words after a title, a field or a form of address; a street with its number. Whole texts are searched
for these signs, and the text falls in independent stretches around them; a span that no stretch holds isn't in the lattice
of the whole text either. Spans no type can have (white space inside an e-mail address) are left out in training and inference alike.
Names and streets without any such sign (`Ada Lovelace wrote`) aren't found: nothing in a span tells them from other capitalised words.

Defined results: null and empty texts have no entities; rows without doc_id keep a null doc_id; repeated rows
repeat; equally good segmentations: fewer entity tokens. Texts and runs of any length are read whole; checksums are only taken of
spans as long as their type can be. Offsets count characters from 0. Other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm._text import slices
from codequarry.session import ship

TYPES = ("email", "phone", "ip", "card", "ssn", "iban", "secret", "name", "address")
LONGEST = 24
_TOKEN = re.compile(r"[^\W_]+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]")
_SPACED = re.compile(r"[0-9+(). \-]+")
_EMAIL = re.compile(r"[\w.+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]?\d{3,4}")
_CARD = re.compile(r"\d{4}([ \-]?)\d{4}\1\d{4}\1\d{1,7}|\d{13,19}")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
_SECRET = re.compile(r"(?:[A-Za-z]{2,6}[_\-])*[A-Za-z0-9+/=_\-]{20,}")
_CUE = re.compile(r"(?i)(?:token|secret|password|passwd|api.?key|key|bearer|pwd)\W{0,4}$")
_CREDENTIAL = r"(?i:api[ _-]?key|access[ _-]?key|bearer|client[ _-]?secret|passphrase|passwd|passwort|password|pwd|secret|token)"
_TO = r"[\"']?\s{0,2}(?:=>|:=|[:=]|\bis\b)\s{0,2}"
_GIVEN_TO = re.compile(rf"{_CREDENTIAL}{_TO}[\"']?$")
_GIVEN = re.compile(r"[A-Za-z0-9+/=_.!#$%^&*~\-]{6,}")
_TITLES = r"\b(?:Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sra|Sr|Se\u00f1ora|Se\u00f1or|Monsieur|Madame)\.?"
_FIELDS = r"(?:\b(?i:full name|first name|last name|surname|name|patient|employee|contact person|contact|signed):|\b(?i:my name is|dear|regards,|sincerely,))"
_NAME_CUE = re.compile(rf"(?:{_TITLES}|{_FIELDS})\s{{1,2}}(?:{_TITLES} )?$")
_CAPITAL = r"(?!(?:Sir|Madam|All|Team|Customer|Colleague|Reader|Friend)s?\b)[A-Z\u00c0-\u00de][\w'\u2019-]*\.?"
_NAME = re.compile(rf"{_CAPITAL}(?: (?:(?:van|von|der|de|la|del|di|bin) )*{_CAPITAL}){{0,3}}")
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Ct|Square|Terrace|Highway|Hwy|Parkway|Way"
_ADDRESS = re.compile(
    rf"\d{{1,5}}[A-Za-z]?,? (?:[A-Z0-9][\w'.-]* ){{1,4}}(?:{_STREETS})\b\.?(?:,? (?:Apt|Suite|Unit|No)\.? ?#?\w{{1,5}})?|[A-Z\u00c4\u00d6\u00dc][\w-]*(?:stra\u00dfe|strasse|str\.|weg|platz|allee|gasse) \d{{1,4}}[a-z]?"
    r"|(?i:rue|avenue|boulevard|calle|avenida|paseo) (?:(?:de|du|des|la|las|los|del|di) )*[A-Z\u00c0-\u00de][\w'-]*(?: [A-Z\u00c0-\u00de][\w'-]*){0,3},? \d{1,4}|\d{1,4},? (?:rue|avenue|boulevard) (?:(?:de|du|des|la) )*[A-Z\u00c0-\u00de][\w'-]*(?: [A-Z\u00c0-\u00de][\w'-]*){0,3}"
)
#: Where spans of the lattice can be: runs with digits or at signs (and groups of an account number behind), assignments, names behind a cue,
#: streets; each with words one of which a text must hold, so that most texts are only searched for these.
_RUN = re.compile(r"[0-9@]\S*(?: [A-Z0-9]{1,4}(?![^\s.,;:!?\"')]))*")
_SIGNS = (
    (tuple("key bearer secret pass pwd token".split()), re.compile(rf"{_CREDENTIAL}{_TO}\S+")),
    (tuple("name: patient: employee: person: contact: signed: regards, sincerely, dear".split()) + ("name is", "mr", "ms", "dr", "prof", "herr", "frau", "mme", "mlle", "sr", "se\u00f1or", "monsieur", "madame"), re.compile(rf"(?:{_TITLES}|{_FIELDS})\s{{1,2}}(?:{_TITLES} )?{_CAPITAL}(?: (?:(?:van|von|der|de|la|del|di|bin) )*{_CAPITAL}){{0,3}}")),
    (tuple(f" {x.lower()}" for x in _STREETS.split("|")) + tuple("stra\u00dfe strasse str. weg platz allee gasse rue avenue boulevard calle avenida paseo".split()), _ADDRESS),
)
FEATURES = ("span", "shape", "prefix_of_longer", "suffix_of_longer", "plus", "parenthesis", "checksum", "issuer", "grouped", "cue", "hex", "mixed", "separators", "quoted", "assigned", "letters_only", "titled", "words", "cut")
_LEAST = {"secret": 16, "iban": 15}
_MOST_CHECKED = 64


def luhn(digits: str) -> bool:
    return not sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(digits))) % 10


def mod97(span: str) -> bool:
    """The checksum of an account number; false for what is longer than any."""
    if len(span) > _MOST_CHECKED:
        return False
    marks = re.sub(r"[^0-9A-Za-z]", "", span[4:] + span[:4])
    rest = 0
    for c in marks:
        n = int(c, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


_SHAPES = {"email": _EMAIL, "phone": _PHONE, "ip": _IP, "card": _CARD, "ssn": _SSN, "iban": _IBAN, "secret": _SECRET, "name": _NAME, "address": _ADDRESS}


def features(text: str, start: int, end: int, kind: str) -> list[int]:
    """The places in FEATURES that hold for the span as an entity of this type."""
    span = text[start:end]
    out = [0]
    if _SHAPES[kind].fullmatch(span):
        out.append(1)
    after, before = text[end : end + 2], text[max(0, start - 2) : start]
    if after[:1].isalnum() or after[:1] in "@+-_" and after[1:].isalnum() or after[:1] == "." and after[1:].isalnum() and after[1:2] > " ":
        out.append(2)
    if before[-1:].isalnum() or before[-1:] in "@.+-_" and before[:1].isalnum() or before[-1:] == "+" or before[-1:] == "(" and kind == "phone":
        out.append(3)
    if span[0] == "+":
        out.append(4)
    if "(" in span:
        out.append(5)
    digits = re.sub(r"\D", "", span) if len(span) <= _MOST_CHECKED else ""
    if kind == "card" and digits and luhn(digits) or kind == "iban" and mod97(span):
        out.append(6)
    if kind == "card" and digits[:1] in ("2", "3", "4", "5", "6") and len(digits) in (14, 15, 16, 19):
        out.append(7)
    if kind in ("card", "phone", "ssn") and re.search(r"\d[ .\-]\d", span):
        out.append(8)
    if kind == "secret" and _CUE.search(text[max(0, start - 20) : start]):
        out.append(9)
    if kind == "secret" and len(span) >= 32 and re.fullmatch(r"[0-9a-fA-F]+", span):
        out.append(10)
    if kind == "secret" and re.search(r"\d", span) and re.search(r"[A-Za-z]", span):
        out.append(11)
    if not span[0].isalnum() and span[0] not in "+(" or not span[-1].isalnum():
        out.append(12)
    if before[-1:] in ("\"", "'"):
        out.append(13)
    if kind == "secret" and _GIVEN_TO.search(text[max(0, start - 40) : start]):
        out.append(14)
        if span.isalpha():
            out.append(15)
    if kind == "name":
        if re.search(rf"{_TITLES} $", text[max(0, start - 12) : start]):
            out.append(16)
        if " " in span:
            out.append(17)
    if kind in ("name", "address") and re.match(r" [A-Z\u00c0-\u00de]\w", text[end : end + 3]) or kind == "secret" and text[end : end + 1] in tuple("!#$%^&*~/=") and text[end + 1 : end + 2].strip():
        out.append(18)
    return out


def lattice(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, list[int]]]:
    """Spans (first token, token after the last, type, features) that an entity may take."""
    out = []
    n = len(tokens)
    space = [text[a].isspace() for a, _ in tokens]
    for i in range(n):
        a = tokens[i][0]
        if space[i] or not (text[a].isalnum() or text[a] in "+("):
            continue
        given = _GIVEN_TO.search(text[max(0, a - 40) : a]) is not None
        called = text[a].isupper() and _NAME_CUE.search(text[max(0, a - 40) : a]) is not None
        placed = text[a].isdigit() or text[a].isalpha()
        blank = trigger = at = False
        for j in range(i, min(n, i + LONGEST)):
            b, e = tokens[j]
            if space[j]:
                blank = True
                if text[b] != " " or not (called or placed or _SPACED.fullmatch(text, a, e) or text[a : a + 2].isalpha() and text[a : a + 2].isupper()):
                    break
                continue
            at = at or text[b] == "@"
            trigger = trigger or _TRIGGER.search(text, b, e) is not None
            if not text[b].isalnum() and text[b] != ".":
                continue
            if called and e - a <= 80 and _NAME.fullmatch(text, a, e):
                out.append((i, j + 1, TYPES.index("name"), features(text, a, e, "name")))
            if placed and blank and trigger and e - a <= 120 and _ADDRESS.fullmatch(text, a, e):
                out.append((i, j + 1, TYPES.index("address"), features(text, a, e, "address")))
            if not text[b].isalnum():
                continue
            if given and not blank and (e - a < 16 or not trigger) and _GIVEN.fullmatch(text, a, e):
                out.append((i, j + 1, TYPES.index("secret"), features(text, a, e, "secret")))
            if not trigger or blank and not (_SPACED.fullmatch(text, a, e) or text[a : a + 2].isalpha() and text[a : a + 2].isupper()):
                continue
            for t, kind in enumerate(TYPES[:7]):
                if kind == "email" and (blank or not at) or at and kind != "email" or blank and kind in ("ip", "ssn", "secret"):
                    continue
                if kind in ("phone", "card", "ip", "ssn") and not _SPACED.fullmatch(text, a, e) or e - a < _LEAST.get(kind, 0):
                    continue
                out.append((i, j + 1, t, features(text, a, e, kind)))
    return out


def tokenize(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def viterbi(n: int, spans: list[tuple[int, int, int, list[int]]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities; of equally good ones, that with fewer tokens in entities. A token outside scores 0."""
    best, inside, back = [0.0] * (n + 1), [0] * (n + 1), [None] * (n + 1)
    by_end: dict[int, list] = {}
    for i, j, t, f in spans:
        score = sum(weights[t, x] for x in f)
        if score > 0:
            by_end.setdefault(j, []).append((i, t, score))
    for j in range(1, n + 1):
        best[j], inside[j] = best[j - 1], inside[j - 1]
        for i, t, score in by_end.get(j, ()):
            if (best[i] + score, -inside[i] - j + i) > (best[j], -inside[j]):
                best[j], inside[j], back[j] = best[i] + score, inside[i] + j - i, (i, t)
    out, j = [], n
    while j:
        if back[j]:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text that hold all spans of its lattice: around signs, joined where they are near."""
    found, low = [], text.lower()
    for m in _RUN.finditer(text):
        a, b = m.span()
        while a and not text[a - 1].isspace() and (not found or a > found[-1][1]):
            a -= 1
        found.append((a, b))
    for words, sign in _SIGNS:
        if any(w in low for w in words) and (sign is not _ADDRESS or found):
            found += [m.span() for m in sign.finditer(text)]
    found.sort()
    start = end = -1
    for a, b in found:
        if start < 0 or a - end > 32:
            if start >= 0:
                yield start, end
            start, end = a, b
        end = max(end, b)
    if start >= 0:
        yield start, end


def find(text: str, weights: np.ndarray) -> list[tuple[str, int, int]]:
    out = []
    for a, b in stretches(text):
        tokens = tokenize(text, a, b)
        out += [(TYPES[t], tokens[i][0], tokens[j - 1][1]) for i, j, t in viterbi(len(tokens), lattice(text, tokens), weights)]
    return out


def _made(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence with its entities."""
    word = lambda: "".join(rng.choice("aeinorstlmudk") for _ in range(rng.randint(2, 9)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    cap = lambda: word().capitalize() + "a"

    def card() -> str:
        head = rng.choice("23456") + num(14)
        digits = next(head + c for c in "0123456789" if luhn(head + c)) if rng.random() < 0.6 else head + num(1)
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        body, country = num(18), rng.choice(["DE", "FR", "ES", "GB"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    make = {
        "email": lambda: f"{word()}{rng.choice(['.', '_', '', '-'])}{rng.choice([word(), num(2)])}@{word()}{rng.choice(['', num(1)])}{rng.choice(['', '.' + word()])}.{rng.choice(['com', 'org', 'de', 'co'])}",
        "phone": lambda: rng.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{rng.randint(30, 49)} {num(3)} {num(4)} {num(3)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "ssn": lambda: f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "iban": iban,
        "secret": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))) if rng.random() < 0.6 else f"{rng.choice(['sk', 'ghp', 'key'])}_" + "".join(rng.choice("abcdefXYZ0123456789") for _ in range(28)),
        "name": lambda: rng.choice([f"{cap()} {cap()}", f"{cap()} {cap()}", cap(), f"{cap()} {rng.choice('ABCDE')}. {cap()}"]),
        "address": lambda: rng.choice([f"{rng.randint(1, 9999)} {cap()} {rng.choice(['Street', 'Avenue', 'Road', 'Lane', 'St', 'Blvd'])}", f"{cap()}{rng.choice(['stra\u00dfe', 'weg', 'platz'])} {rng.randint(1, 200)}", f"{rng.randint(1, 99)} rue de {cap()}", f"calle {cap()} {rng.randint(1, 99)}"]),
    }
    given = lambda: rng.choice([lambda: "".join(word() for _ in range(3)), lambda: word() + rng.choice("!#$%&") + num(3), lambda: cap() + num(4) + rng.choice("!#$&*") + word()])()
    noise = [word, word, word, lambda: str(rng.randint(0, 99999)), lambda: f"{rng.randint(1, 99)}.{rng.randint(0, 99)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{word()}{rng.randint(1, 99)}", lambda: f"@{word()}", lambda: f"{rng.randint(1, 12)}:{num(2)}", lambda: f"{rng.randint(1, 999)},{num(3)}", lambda: num(9), lambda: f"({num(4)})", lambda: "".join(word() for _ in range(4)), lambda: f"{cap()} {cap()}", cap, lambda: f"the {rng.choice(['token', 'password', 'secret'])} {word()}", lambda: f"{rng.randint(2, 90)} {word()}", lambda: f"password is {rng.choice(['not', 'the', 'set', 'long'])}", lambda: f"{rng.randint(1, 99)} {cap()} {word()}"]
    text, gold = "", []
    for _ in range(rng.randint(3, 7)):
        if rng.random() < 0.45:
            kind = rng.choice(TYPES)
            lead = rng.choice(["", "(", "\""]) if kind not in ("phone", "name") else ""
            entity = make[kind]()
            if kind == "secret" and rng.random() < 0.7:
                lead = rng.choice(["token = \"", "api_key: ", "password=", "secret is "])
                entity = given() if rng.random() < 0.5 else entity
            if kind == "name":
                lead = rng.choice(["Mr. ", "Dr ", "Mrs ", "Name: ", "Dear ", "my name is ", "Contact: "])
            text += lead
            gold.append((len(text), len(text) + len(entity), kind))
            text += entity + (rng.choice(["", ",", ";", "\""]) if kind in ("secret", "name", "address") else rng.choice(["", "", ".", ",", "###", "!", "$$$", "\"", ";"]))
        else:
            text += rng.choice(noise)() + rng.choice(["", "", ".", ",", "%%%"])
        text += rng.choice([" ", " ", " ", "\n"])
    return text, gold


def likelihood(w: np.ndarray, n: int, spans: list[tuple[int, int]], x: np.ndarray, gold: list[int]) -> tuple[float, np.ndarray]:
    """Conditional log likelihood of the segmentation `gold` (places in `spans`) of n tokens, and its gradient, by sums over all segmentations."""
    if not spans:
        return 0.0, np.zeros(len(w))
    score = x @ w
    begin = [[] for _ in range(n + 1)]
    finish = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(spans):
        finish[j].append(k)
        begin[i].append(k)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[spans[k][0]] + score[k] for k in finish[j])]) if finish[j] else alpha[j - 1]
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[spans[k][1]] + score[k] for k in begin[i])]) if begin[i] else beta[i + 1]
    p = np.exp([alpha[i] + score[k] + beta[j] - alpha[n] for k, (i, j) in enumerate(spans)])
    p[gold] -= 1
    return float(score[gold].sum() - alpha[n]), -(p @ x)


@lru_cache(maxsize=2)
def train(sentences: int = 240, rounds: int = 60, seed: int = 7) -> np.ndarray:
    """Weights (type, feature) by gradient ascent on the penalised conditional log likelihood."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, gold = _made(rng)
        tokens = tokenize(text, 0, len(text))
        spans = lattice(text, tokens)
        where = {(tokens[i][0], tokens[j - 1][1], TYPES[t]): k for k, (i, j, t, _) in enumerate(spans)}
        x = np.zeros((len(spans), len(TYPES), len(FEATURES)), np.float32)
        for k, (_, _, t, f) in enumerate(spans):
            x[k, t, f] = 1
        data.append((len(tokens), [(i, j) for i, j, _, _ in spans], x.reshape(len(spans), len(TYPES) * len(FEATURES)), [where[g] for g in gold if g in where]))
    size = len(TYPES) * len(FEATURES)
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        grad = -0.02 * w
        for one in data:
            grad = grad + likelihood(w, *one)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + 0.4 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w.reshape(len(TYPES), len(FEATURES))


def _search(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("entities", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.filter(pc.fill_null(pc.greater(pc.binary_length(part.column("text")), 0), False))
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if found := find(text, weights):
                        rows.append({"doc_id": doc, "entities": [dict(zip(("type", "start", "end"), e, strict=True)) for e in found]})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return search


def personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, entities: array of (type, start, end)) of the documents that have any."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train())
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_search(shared), "doc_id long, entities array<struct<type: string, start: int, end: int>>")


def _mask(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                at = part.schema.get_field_index("text")
                hit = pc.fill_null(pc.greater(pc.binary_length(part.column(at)), 0), False)
                texts = part.column(at).filter(hit).to_pylist()
                if not texts:
                    yield part
                    continue
                for i, text in enumerate(texts):
                    for kind, a, b in reversed(find(text, weights)):
                        text = f"{text[:a]}<{kind}>{text[b:]}"
                    texts[i] = text
                yield part.set_column(at, part.schema.field(at), pc.replace_with_mask(part.column(at), hit, pa.array(texts, part.schema.field(at).type)))

    return mask


def redact(documents: DataFrame) -> DataFrame:
    """The documents with each entity replaced by its type, as <type>; all columns stay."""
    spark = documents.sparkSession
    ship(spark)
    return documents.mapInArrow(_mask(spark.sparkContext.broadcast(train())), documents.schema)
