"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests finds to be random ones.

A candidate is a long run of key characters. Its encoding is inferred from its alphabet, and the battery asks whether it
is uniform random in that alphabet: chi-squared over character classes, over frequent and rare letters and over equal parts
of the alphabet; runs of classes, of vowels and consonants and of the alphabet's two halves; the number of vowels; and the
serial correlation of neighbours. Each test gives a p-value.

What a p-value is worth depends on the length: short strings pass most tests by chance. So every length band, apart for
strings with digits and without, has reference distributions of each test's p-values among random strings and among decoys
(identifiers, slugs and paths). The log of their ratio, summed over the battery, ranks a candidate. A band accepts from the
highest bound on that keeps nearly all random strings, but never from one at which, with random strings as rare as PRIOR
says, more than the wanted share of what it accepts would be decoys. Bounds rise with the length of a band. Nothing of the
rule depends on the table, so a string has the same answer in every table.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.buffers import pieces

# The base patterns and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARACTERS = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_CHARACTERS = 20
HEX = r"[0-9a-f]+"
HEX_CHARACTERS = 24
KINDS = ("assign", "access", "hex", "random")
# Alphabets in their usual order, narrowest first.
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "upper hex": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "url base64": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
#: Least length of each band; a candidate is compared with decoys of its band.
BANDS = (16, 24, 32, 48, 96)
#: Strings that the plain tests reject at this p-value are not random, whatever else they look like.
LEVEL = 0.0001
#: Strings of each kind in a reference distribution, and as many again for the bounds.
REFERENCE = 1000
#: The share of random strings that a bound keeps, and how many random strings there are for each decoy.
KEPT = 0.99
PRIOR = 0.05
#: Borders between the bins of p-values.
BINS = (1e-8, 1e-6, 1e-5, 1e-4, 1e-3, 3e-3, 0.01, 0.03, 0.1, 0.3, 0.6)
# Letters by how often European languages use them, the rest being rare; and the vowels.
FREQUENT = "etaoinsr"
MIDDLE = "lhdcumfpg"
VOWELS = "aeiou"
# Words of names, slugs and paths, of which decoys are made: every second one for the reference, the others for tests.
WORDS = """
    account action active address admin album amount answer archive array article asset author average backup balance
    banner batch benutzer bericht binary block board body book branch bridge browser buffer build button cache calendar
    campaign cancel capture card catalog category center chain change channel chapter charge check child city class clean
    client cliente close cloud cluster code collection color column comment common company compare complete config connect
    contact container content context control copy core correct count country course cover create credit current customer
    daily dashboard data datei daten debug default delete delivery deploy design detail device dialog digest direct display
    document domain donnees download draft drive edit email employee empty enable engine english entry error event example
    expert export express factory failure false feature field figure file filter final finance fixed flag folder font
    footer forecast form format forum frame friday function future gallery game general german global graph green group
    guide handler hash header health height hello help history home host house icon image import income index info initial
    inner input insert install invoice issue item january java journal july key kunde label language large last layer
    layout leader learn left legal length level library license light limit line link list live load local location lock
    login loop machine mail main manager manual map march market master match media member memory menu message method
    metric migration minute mobile mode model module monday month move music name native network news next node note number
    object offer office online open option order output owner package page panel parent partner password path pattern
    payment people permission person phone photo pipeline place plan player plugin point policy pool post prefix press
    preview price primary print private process product profile program progress project proxy public purchase quality
    quantity query queue quick quote radio random range rate reader record refresh region release remote remove render
    report request reset resource response result retail return review right role room root route rule runner sales sample
    scale schedule schema school score screen script search season section select sensor sequence server service session
    setting shape share shipping shop signal simple single site size slide small social sort source space special speed
    stack stage standard start state static status step stock storage store stream street string structure student style
    subject submit summary supplier support survey switch symbol system table target task team template terminal test text
    theme thread ticket time title token tool topic total track trade training transfer travel tree trigger type unique
    unit update upload user utility valid value vector vendor version video view visit volume warning water weather web
    website week weight widget window winter word worker write year zahlung zone
""".split()

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII).finditer
# A run that is long enough holds no shorter one that is found first, so the least length may stand in the pattern.
_access = re.compile(ACCESS[:-1] + f"{{{ACCESS_CHARACTERS - 4},}}").finditer
_hex = re.compile(HEX[:-1] + f"{{{HEX_CHARACTERS},}}").finditer
_candidate = re.compile(rf"[A-Za-z0-9+/_-]{{{BANDS[0]},}}").finditer
_digit = re.compile("[0-9]").search
_letter = re.compile("[A-Za-z]").search
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
#: Strings without digits are letters alone, or with the signs of paths.
LETTERS = {"lower": LOWER, "upper": UPPER, "letters": UPPER + LOWER}
_sets = {name: (frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in {**LETTERS, **ENCODINGS}.items()}


def infer_encoding(s: str) -> str:
    """The narrowest encoding whose alphabet holds every character; one of letters only if there is no digit."""
    used = set(s)
    plain = () if _digit(s) else LETTERS
    return next(name for name in (*plain, *ENCODINGS) if used <= _sets[name][0])


def _normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    v = 2 / (9 * df)
    return _normal_tail(((x / df) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def uniformity_p(values: list[int], size: int) -> float:
    """Chi-squared over equal parts of the alphabet, five expected characters to a part."""
    n, parts = len(values), min(size, max(2, len(values) // 5))
    seen = [0] * parts
    for v in values:
        seen[v * parts // size] += 1
    share = [0] * parts
    for v in range(size):
        share[v * parts // size] += 1
    return _chi2_tail(sum((o - n * w / size) ** 2 / (n * w / size) for o, w in zip(seen, share)), parts - 1)


def runs_p(values: list[int], size: int) -> float:
    """Runs below and above the middle of the alphabet."""
    high = [2 * v >= size for v in values]
    a, n = sum(high), len(high)
    b = n - a
    if not a or not b or n < 3:
        return 2.0 ** (1 - n)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return min(1.0, 2 * _normal_tail(abs(runs - mean) / math.sqrt(var))) if var > 0 else 1.0


def serial_p(values: list[int]) -> float:
    """Correlation of each character with the next."""
    n = len(values) - 1
    if n < 3:
        return 1.0
    x, y = values[:-1], values[1:]
    mx, my = sum(x) / n, sum(y) / n
    sx, sy = sum((v - mx) ** 2 for v in x), sum((v - my) ** 2 for v in y)
    if not sx or not sy:
        return 2.0 ** -n
    r = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sx * sy)
    return min(1.0, 2 * _normal_tail(abs(r) * math.sqrt(n)))


def randomness_p(s: str) -> float:
    """p-value of "uniform random in its inferred encoding": the three tests joined by Fisher's rule."""
    alphabet, index = _sets[infer_encoding(s)]
    values = [index[c] for c in s]
    half = -sum(math.log(max(p, 1e-300)) for p in (uniformity_p(values, len(alphabet)), runs_p(values, len(alphabet)), serial_p(values)))
    return math.exp(-half) * (1 + half + half * half / 2)


def _kind(c: str) -> str:
    return "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else "s"


def decoy(rng: random.Random, words: list[str], length: int, with_digits: bool = True) -> str:
    """An identifier, slug or path of that many characters at least, that mixes digits and letters, or is of letters."""
    joint = rng.choice(["_", "-", "/", "", "", "_-", "/_", "/-"])
    case = rng.choice([str.lower, str.lower, str.upper, str.title, str.title])
    out, n, digits = "", 0, not with_digits
    while len(out) < length or not digits:
        last = rng.choice(joint) if joint else ""
        digits = digits or len(out) >= length
        if with_digits and out and (digits and not any(c in DIGITS for c in out) or rng.random() < 0.2):
            kind, digits = rng.randrange(4), True
            part = (str(rng.randrange(1, 100)), str(rng.randrange(1950, 2050)), "v" + str(rng.randrange(1, 20)),
                    f"{rng.randrange(1990, 2040)}{rng.randrange(1, 13):02}{rng.randrange(1, 32):02}")[kind]
        else:
            part = case(rng.choice(words)) if n or case is not str.title or rng.random() < 0.5 else rng.choice(words)
        out += (last if out and rng.random() < 0.9 else "") + part
        n += 1
    return out


def _share(alphabet: str, of) -> dict:
    return {k: n / len(alphabet) for k, n in Counter(map(of, alphabet)).items()}


def _rarity(c: str) -> int:
    c = c.lower()
    return 0 if c in FREQUENT else 1 if c in MIDDLE else 2


def _is_vowel(c: str) -> bool:
    return c.lower() in VOWELS


_letters_of = {name: "".join(c for c in alphabet if c.isalpha()) for name, (alphabet, _) in _sets.items()}
_classes = {name: _share("".join(sorted(alphabet)), _kind) for name, (alphabet, _) in _sets.items()}
_rarities = {name: _share(letters, _rarity) for name, letters in _letters_of.items()}
_vowels = {name: _share(letters, _is_vowel).get(True, 0.0) for name, letters in _letters_of.items()}


def groups_p(seen: Counter, share: dict) -> float:
    """Chi-squared over groups of the alphabet."""
    n = sum(seen.values())
    if n < 4 or len(share) < 2:
        return 1.0
    x = sum((seen.get(k, 0) - n * p) ** 2 / (n * p) for k, p in share.items())
    return _chi2_tail(x, len(share) - 1) if x > 0 else 1.0


def few_p(k: int, n: int, p: float) -> float:
    """How likely k or fewer of n are, each with chance p, by the normal approximation."""
    return _normal_tail((n * p - k) / math.sqrt(n * p * (1 - p))) if n and 0 < p < 1 else 0.5


def battery(s: str) -> list[float]:
    """The p-values of all tests. Small ones tell against randomness; runs of classes tell by being few, vowels and their
    changes by being many, digits after digits likewise."""
    name = infer_encoding(s)
    index, classes, vowel = _sets[name][1], _classes[name], _vowels[name]
    n, kinds, values = len(s), [_kind(c) for c in s], [index[c] for c in s]
    letters = [c for c in s if c.isalpha()]
    change = 1 - sum(p * p for p in classes.values())
    neighbours = [(_is_vowel(a), _is_vowel(b)) for a, b in zip(s, s[1:]) if a.isalpha() and b.isalpha()]
    after_digit = [b == "d" for a, b in zip(kinds, kinds[1:]) if a == "d"]
    m, vowels = len(neighbours), sum(map(_is_vowel, letters))
    return [
        groups_p(Counter(kinds), classes), groups_p(Counter(map(_rarity, letters)), _rarities[name]),
        uniformity_p(values, len(index)), runs_p(values, len(index)), serial_p(values),
        few_p(sum(a != b for a, b in zip(kinds, kinds[1:])), n - 1, change),
        few_p(m - sum(a != b for a, b in neighbours), m, 1 - 2 * vowel * (1 - vowel)),
        few_p(len(letters) - vowels, len(letters), 1 - vowel),
        few_p(len(after_digit) - sum(after_digit), len(after_digit), 1 - classes.get("d", 0.0))]


def _bin(p: float) -> int:
    return bisect_left(BINS, p)


def band_of(s: str) -> int:
    return sum(len(s) >= b for b in BANDS) - 1


def _weigh(weights: list[list[float]], s: str) -> float:
    return sum(w[_bin(p)] for w, p in zip(weights, battery(s)))


@dataclass(frozen=True)
class Rule:
    """For strings with digits and without, and each band: the weight of each test's bins, and the bound of their sum."""

    weights: dict[tuple[bool, int], list[list[float]]]
    bounds: dict[tuple[bool, int], float]

    def score(self, s: str) -> float:
        """The log of how much likelier the battery's p-values are for a random string than for a decoy."""
        return _weigh(self.weights[_digit(s) is not None, band_of(s)], s)


def random_string(rng: random.Random, alphabet: str, length: int, digits: bool) -> str:
    """Uniform random, and drawn again until it can be a candidate."""
    while True:
        s = "".join(rng.choices(alphabet, k=length))
        if s == s.strip("-_/") and (_digit(s) is not None) == digits and _letter(s):
            return s


def _examples(rng: random.Random, digits: bool, band: int) -> tuple[list[str], list[str]]:
    """Random strings and decoys of a band's lengths."""
    alphabets = ENCODINGS if digits else LETTERS
    lengths = range(BANDS[band], BANDS[band + 1] if band + 1 < len(BANDS) else 2 * BANDS[band])
    some = lambda: lengths[int(len(lengths) * rng.random() ** 2)]  # noqa: E731  # shorter ones are more frequent and harder
    drawn = [random_string(rng, a, some(), digits) for a in alphabets.values() for _ in range(REFERENCE // len(alphabets))]
    return drawn, [decoy(rng, WORDS[::2], some(), digits) for _ in range(REFERENCE)]


@lru_cache(16)
def least_bits(rate: float) -> Rule:
    """The rule at which at most `rate` of the accepted strings are decoys, in every band."""
    weights, bounds = {}, {}
    for key in [(digits, band) for digits in (True, False) for band in range(len(BANDS))]:
        rng = random.Random(100 + 10 * key[1] + key[0])
        logs = []
        for group in _examples(rng, *key):
            seen = [Counter(map(_bin, ps)) for ps in zip(*map(battery, group))]
            logs.append([[math.log((c[i] + 0.5) / (len(group) + 0.5 * (len(BINS) + 1))) for i in range(len(BINS) + 1)] for c in seen])
        weights[key] = [[a - b for a, b in zip(*test)] for test in zip(*logs)]
        true, false = (sorted((_weigh(weights[key], s) for s in group), reverse=True) for group in _examples(rng, *key))
        keeps = true[min(int(KEPT * len(true)), len(true) - 1)]
        # Decoys among the accepted ones: their share is `rate` if so many of the decoys pass.
        allowed = int(rate / (1 - rate) * PRIOR * KEPT * len(false))
        bounds[key] = max(keeps, false[allowed], 0.0)
    return Rule(weights, bounds)


def is_random(s: str, rule: Rule) -> bool:
    return randomness_p(s) >= LEVEL and rule.score(s) > rule.bounds[_digit(s) is not None, band_of(s)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _assign(text) if m.end(2) - m.start(2) >= ASSIGN_CHARACTERS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access(text)]
    out += [(m.start(), 2, m.end()) for m in _hex(text)]
    return sorted(out)


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of strings that hold letters and touch no known span."""
    out = []
    for m in _candidate(text):
        s = m.group().strip("-_/")
        if len(s) < BANDS[0] or not _letter(s):
            continue
        start = m.start() + m.group().index(s)
        end = start + len(s)
        if any(a < end and start < b for a, _, b in known):
            continue
        out.append((start, end))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, text: str = "text", rate: float = 0.01) -> DataFrame:
    """Replace the text column by `base_spans` and `spans`: arrays of (start, kind number, end), in order of start and
    kind (numbers of KINDS), in code points, `spans` with the added random strings. `rate` is the share of decoys among
    the added strings that the rule allows for.

    Null and empty texts have no spans, repeated rows stay, an empty table stays empty; the names of the new columns
    must be free. Rows do not depend on each other."""
    new = {"base_spans", "spans"}
    if new & set(docs.columns):
        raise ValueError(f"columns exist: {sorted(new & set(docs.columns))}")
    others = [f for f in docs.schema if f.name != text]
    schema = T.StructType([*others, T.StructField("base_spans", _SPANS), T.StructField("spans", _SPANS)])
    least = least_bits(rate)

    def rows(spans: list[tuple[int, int, int]]) -> list[dict[str, int]]:
        return [{"start": a, "kind": k, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            base, every = [], []
            for s in texts.to_pylist():
                known = base_spans(s)
                base.append(rows(known))
                every.append(rows(sorted(known + [(a, 3, b) for a, b in candidates(s, known) if is_random(s[a:b], least)])))
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(base, _ARROW_SPANS), pa.array(every, _ARROW_SPANS)], schema.names)

    return docs.mapInArrow(run, schema)


def spans_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")
