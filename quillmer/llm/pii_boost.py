"""Personal data: base patterns, and candidate spans that boosted trees select. DataFrame functions only.

The base patterns (email, ip, card, phone) give the spans that always stand. High-recall generators propose further spans,
which may overlap: obscured mail addresses ("contact"), digit groups and account numbers ("number"), keys, tokens and
passwords ("secret"), streets with a house number ("address") and titled or labelled names ("person"). No generator has a
length cap other than that of the format it names. Gradient-boosted trees score each candidate by format and context
features; per kind, the threshold is the lowest score that keeps the precision on calibration texts, which are made from
other templates than the training texts, and candidates above it that don't overlap a base span are added. The trees are
fitted on generated texts by the driver and become SQL expressions; scoring stays in the JVM.

Positions are code points, end exclusive; they come from prefix sums over the pieces between matches, and overlaps from one
ordered scan, so the work is linear in the spans of a text but for sorting. The context of a candidate reaches back over the
piece and the match of its generator before it, and as far ahead.

Defined results: a null text is empty and has no spans; equal spans count once, added spans of one kind may overlap each
other; repeated rows each get their row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from random import Random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, let, running

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("contact", "number", "secret", "address", "person")
KINDS = (*BASE_KINDS, *ADDED_KINDS)

# The base patterns in possessive form. A local part, digit run or card run can only match from its first character or from
# the end of the match before (\G), so a failing run is tried once and long runs stay linear.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Lengths of international account numbers by country.
ACCOUNTS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_AT, _DOT = r"(?:\x20?(?:\[at\]|\(at\)|\{at\})\x20?|\x20at\x20)", r"(?:\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\x20dot\x20|\.)"
_LABEL = r"(?:password|passwort|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|bearer)"
_DIGITS, _LONG = r"[0-9][0-9\x20().-]{4,}[0-9]", "(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20}"
_KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "sk_", "pk_", "xox", "AIza", "glpat-")
#: kind, pattern and guard (a pattern, or literals of which a text must hold one to be searched) of each generator; a start is never tried within a run that failed
GENERATORS = (
    ("contact", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*+{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++", r"(?i)[(\[{]at[)\]}]|\x20at\x20[a-z0-9-]+(?:\.[a-z0-9]|\x20dot\x20|\x20?[(\[{]dot)"),
    ("number", r"(?<![0-9A-Za-z+])(?<![0-9)][\x20.-])\(?[0-9]++\)?(?:[\x20.-]\(?[0-9]++\)?)++", _DIGITS),
    ("number", r"(?<![0-9A-Za-z+])(?<![0-9][.-])[0-9]++(?:[.-][0-9]++)++", _DIGITS),
    ("number", r"(?<![0-9A-Za-z+.-])(?:\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\([0-9]{2,5}\)\x20?[0-9]++(?:[\x20.-][0-9]++)*+)(?![0-9A-Za-z])", _DIGITS),
    ("number", r"(?<![0-9A-Za-z+.-])(?:\(?0[0-9]{1,4}\)?[\x20/-][0-9]{5,8}|0[0-9]{2,4}\x20[0-9]{3,4}\x20[0-9]{3,4})(?![0-9A-Za-z])", "0[0-9]{1,4}\\)?[\\x20/-][0-9]"),
    ("number", r"(?<![0-9A-Za-z+])[0-9]{7,}+(?![0-9A-Za-z])", "[0-9]{7}"),
    ("number", r"(?<![0-9A-Za-z])(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + rf"\x20?[A-Z0-9]{{{n % 4}}}" * (n % 4 > 0) for c, n in ACCOUNTS.items()) + ")(?![0-9A-Za-z])", "[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}"),
    ("number", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", "[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}"),
    ("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}(?![A-Za-z0-9_/+=-])", _LONG),
    ("secret", r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+){2,}+", r"\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8}"),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk[-_]|pk_|xox[abprs]-|AIza|glpat-)[A-Za-z0-9_-]{10,}+", _KEY_PREFIXES),
    ("secret", rf"(?i)(?<=[:=]\x20{{0,2}}[\"']?)(?<={_LABEL}[\"']?\x20{{0,2}}[:=]\x20{{0,2}}[\"']?)[^\s\"',;:=<>][^\s\"',;<>]{{2,}}[^\s\"',;<>.)]", rf"(?i)[:=](?<={_LABEL}[\"']?\x20{{0,2}}[:=])"),
    ("address", r"(?<![\p{L}0-9])[0-9]{1,5}[a-z]?\x20(?:\p{Lu}\p{L}++\x20){1,3}?(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square|Way)(?!\p{L})", r"[0-9][a-z]?\x20\p{Lu}"),
    ("address", r"(?<!\p{L})\p{Lu}\p{L}*(?:straße|strasse|str\.|weg|platz|gasse|allee)\x20[0-9]{1,4}(?![0-9])", ("straße ", "strasse ", "str. ", "weg ", "platz ", "gasse ", "allee ")),
    ("address", r"(?<![\p{L}0-9])[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place|chemin)\x20(?:(?:de|du|des|la|le)\x20)*+\p{Lu}\p{L}++|(?<!\p{L})(?:Calle|Avenida|Plaza)\x20(?:(?:de|del|la|los)\x20)*+\p{Lu}\p{L}++,?\x20[0-9]{1,4}(?![0-9])", (" rue ", " avenue ", " boulevard ", " place ", " chemin ", "Calle ", "Avenida ", "Plaza ")),
    ("person", r"(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.?\x20\p{Lu}\p{L}++(?:[\x20-]\p{Lu}\p{L}++)*+", ("Mr", "Ms", "Miss ", "Dr", "Prof", "Herr ", "Frau ", "Mme", "Mlle", "Sr")),
    ("person", r"(?<=(?:[Nn]ame|[Pp]atient|[Ee]mployee|[Nn]om|[Nn]ombre)\x20?[:=]\x20)\p{Lu}\p{L}++(?:[\x20-]\p{Lu}\p{L}++)++", r"[:=]\x20\p{Lu}\p{L}+[\x20-]\p{Lu}"),
)
CONTEXT, AHEAD = 24, 8
PERSONAL_WORDS = r"(?i)(?:tel|phone|fon|call|fax|mobile?|handy|cell|whatsapp|ring|dial|ssn|social|security|tax|iban|konto|account|acct|bank|passport|licen[cs]e no|card|mail|contact|reach|write to|patient|born|name|lives? at|address|home|customer)\W{0,4}(?:(?:me|us|is|at|on|no|number)\W{1,3}){0,2}$"
SECRET_WORDS = r"(?i)(?:token|secret|key|passw(?:or)?[dt]|passwd|pwd|bearer|auth\w*|credential\w*|api|login)\W{0,5}(?:is\W{1,2})?$"
NEUTRAL_WORDS = r"(?i)(?:version|isbn|issn|date|commit|sha\d*|md5|checksum|digest|page|figure|fig|no|nr|order|invoice|item|part|build|since|until|in|year|total|pop|ratio|score|seed|revision|uuid|[$€£#/])\W{0,4}$"
DATE = r"^(?:\d{4}[-. ]\d{1,2}[-. ]\d{1,2}|\d{1,2}[-. ]\d{1,2}[-. ]\d{4}|\d{4} ?- ?\d{4})$"
#: shapes of mobile or land-line, social security and key formats
_SHAPES = (r"^\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}$", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", r"^\(?0[0-9]{1,4}[\x20)/-]", r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk[-_]|pk_|xox[abprs]-|AIza|glpat-)", r"^eyJ", r"^[0-9a-f]+$", r"^[A-Z]{2}[0-9]{2}", r"^97[89]", r"[\[({]", r"\x20(?:at|dot)\x20", r"[A-Z].*[a-z].*[0-9]|[a-z].*[A-Z].*[0-9]|[0-9].*[a-z].*[A-Z]")

TREES, DEPTH, RATE, SEED, TRAINING_TEXTS = 30, 3, 0.3, 7, 4000
#: precision that a kind's threshold keeps on the calibration texts
PRECISION = 0.98


# --- spans ------------------------------------------------------------------------------------------------------------

def _holds(text: Column, guard: str | tuple[str, ...]) -> Column:
    return text.rlike(guard) if isinstance(guard, str) else reduce(or_, [text.contains(x) for x in guard])


def spans(text: Column, searches: list[tuple[str, str, str | tuple[str, ...]]]) -> Column:
    """Leftmost, non-overlapping matches of each of ``searches`` (kind, pattern, guard), as structs of kind, g (number of the
    search), s, e, m (match), b and a (context before and after). Only texts with ``guard`` are searched.

    The pieces between matches and the matches themselves alternate, so the running sum of their lengths gives the positions.
    """

    def searched(g: int, kind: str, pattern: str, guard: str | tuple[str, ...]) -> Column:
        hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        return F.when(_holds(text, guard), F.struct(F.lit(kind).alias("kind"), F.lit(g).alias("g"), gaps.alias("gaps"), hits.alias("hits")))

    def placed(p: Column) -> Column:
        lengths = F.zip_with(p["gaps"], p["hits"], lambda x, m: F.length(x) + F.coalesce(F.length(m), F.lit(0)))

        def span(m: Column, i: Column, at: Column) -> Column:
            before = F.right(F.concat(F.when(i > 0, F.right(F.get(p["hits"], i - 1), F.lit(CONTEXT))).otherwise(""), F.get(p["gaps"], i)), F.lit(CONTEXT))
            after = F.left(F.concat(F.get(p["gaps"], i + 1), F.coalesce(F.get(p["hits"], i + 1), F.lit(""))), F.lit(AHEAD))
            start = F.get(at, i) + F.length(F.get(p["gaps"], i))
            return let(start, lambda s: F.struct(p["kind"].alias("kind"), p["g"].alias("g"), s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), before.alias("b"), after.alias("a")))

        return let(running(lengths, F.lit(0), lambda x, y: x + y), lambda at: F.transform(p["hits"], lambda m, i: span(m, i, at)))

    found = F.filter(F.array(*[searched(g, *x) for g, x in enumerate(searches)]), lambda p: F.size(p["hits"]) > 0)
    return F.flatten(F.transform(found, placed))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    digit = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, F.get(doubled, digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def iban(m: Column) -> Column:
    """The check digits of an account number: letters as 10 to 35, country and check digits last, 1 modulo 97."""
    turned = lambda x: F.split(F.concat(F.substring(x, 5, 64), F.substring(x, 1, 4)), "")
    digit = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda a, c: let(digit(c), lambda d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)
    plain = F.regexp_replace(m, r"\x20", "")
    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.aggregate(F.array_remove(turned(plain), ""), F.lit(0), step) == 1).otherwise(False)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(16, 19), luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}
_GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]"}


def base_spans(text: Column) -> Column:
    found = spans(text, [(k, BASE_PATTERNS[k], _GUARD[k]) for k in BASE_KINDS])
    return F.filter(found, lambda x: F.coalesce(*[F.when(x["kind"] == k, _VALID[k](x["m"])) for k in BASE_KINDS]))


def candidates(text: Column) -> Column:
    return spans(text, list(GENERATORS))


def free_of(found: Column, base: Column) -> Column:
    """The structs of ``found`` that overlap none of ``base``, by one scan: base spans in the order of their starts and others
    in that of their ends; one of these overlaps if some base span before it ends after its start."""
    event = lambda at, own, x: F.struct(at.alias("at"), F.lit(own).alias("own"), x.alias("x"))
    # at one position a base span starts after a span ends there, so own = 0 (the candidate) sorts first
    events = F.sort_array(F.concat(F.transform(base, lambda b: event(b["s"], 1, b)), F.transform(found, lambda c: event(c["e"], 0, c))))
    ends = lambda ev: running(F.transform(ev, lambda v: F.when(v["own"] == 1, v["x"]["e"]).otherwise(-1)), F.lit(-1), lambda a, b: F.greatest(a, b))
    kept = let(events, lambda ev: let(ends(ev), lambda top: F.transform(F.filter(ev, lambda v, i: (v["own"] == 0) & (F.get(top, i) <= v["x"]["s"])), lambda v: v["x"])))
    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(kept)


# --- features ---------------------------------------------------------------------------------------------------------


def features(c: Column) -> list[Column]:
    """Format and context features of a candidate, as doubles."""
    m, before, after = c["m"], c["b"], c["a"]
    digits, n = _digits(m), F.length(m)
    number = lambda p: n - F.length(F.regexp_replace(m, p, ""))
    found = [
        c["g"], n, F.length(digits), F.length(digits) / n, number("[^0-9A-Za-z]"), number("[.]"), number("-"), number(" "), number("[A-Z]"), number("[a-z]"), number("[aeiouAEIOU]") / n,
        F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False), F.when(n.between(15, 42), iban(m)).otherwise(False), m.rlike(DATE), *[m.rlike(p) for p in _SHAPES],
        before.rlike(PERSONAL_WORDS), before.rlike(SECRET_WORDS), before.rlike(NEUTRAL_WORDS), before.rlike(r"[$€£#/]\s?$"), before.rlike(r"[0-9][\x20.-]$"), after.rlike(r"^\s?(?:%|€|\$|km|kg|MB|GB|USD|EUR)"), after.rlike("^[/0-9A-Za-z]"),
    ]
    return [x.cast("double") for x in found]


# --- boosted trees ----------------------------------------------------------------------------------------------------


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass
class Boosted:
    bias: float
    trees: list[Node]
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(_apply(t, x) for t in self.trees)

    def sql(self, x: str) -> str:
        """The margin as a SQL expression over the array of features ``x``; far smaller to build than one of columns."""
        return " + ".join([f"{self.bias!r}D", *(_expression(t, x) for t in self.trees)])


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _apply(node.low, x), _apply(node.high, x))


def _expression(node: Node, x: str) -> str:
    if node.feature < 0:
        return f"({node.value!r}D)"
    return f"IF({x}[{node.feature}] <= {node.cut!r}D, {_expression(node.low, x)}, {_expression(node.high, x)})"


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Node:
    leaf = Node(value=float(RATE * g.sum() / (h.sum() + 1.0)))
    if depth == 0 or len(x) < 10:
        return leaf
    best, whole = (1e-3, -1, 0.0), g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        gain = np.where(v[:-1] < v[1:], cg**2 / (ch + 1.0) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1.0) - whole, 0)
        if len(gain) and gain.max() > best[0]:
            k = int(gain.argmax())
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    _, f, cut = best
    if f < 0:
        return leaf
    low = x[:, f] <= cut
    return Node(feature=f, cut=cut, low=_grow(x[low], g[low], h[low], depth - 1), high=_grow(x[~low], g[~low], h[~low], depth - 1))


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(share / (1 - share))), [])
    margin = np.full(len(y), model.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), DEPTH)
        margin = margin + _apply(tree, x)
        model.trees.append(tree)
    return model


def calibrate(margin: np.ndarray, y: np.ndarray) -> float:
    """The lowest margin from which on the share of positives is at least ``PRECISION``, midway to the next one below; even
    odds at most if all of them may stay."""
    margin = np.round(margin, 6)  # sums in another order differ in the last digits
    order = np.argsort(-margin, kind="stable")
    precision = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(margin[order][1:] < margin[order][:-1], True)
    ok = np.flatnonzero((precision >= PRECISION) & last)
    if not len(ok):
        return float("inf")
    k = ok[-1]
    return min(0.0, float(margin[order][k]) - 1e-3) if k + 1 == len(y) else float(margin[order][k] + margin[order][k + 1]) / 2


# --- generated texts --------------------------------------------------------------------------------------------------

#: syllables of words, names and labels of the texts that trees learn from, that calibrate, and that measure recall
_SYLLABLES = (["an", "er", "st", "on", "the", "le", "ou", "in", "de", "ra"], ["ma", "ti", "or", "es", "un", "ve", "al", "ch", "no", "di"], ["so", "li", "en", "ar", "tu", "re", "mi", "ost", "ba", "ge"])
_LABELS = {
    "phone": (["tel ", "phone: ", "call "], ["Fax ", "mobile: ", "ring me on "], ["Tel.: ", "Phone no. ", "cell "]), "ssn": (["ssn ", "SSN: ", "tax id "], ["social security ", "tax no. "], ["Social: ", "SSN "]),
    "bank": (["IBAN ", "account: "], ["Konto ", "bank account "], ["iban: ", "acct "]), "card": (["card "], ["Card: "], ["card no. "]), "mail": (["", "mail: ", "contact "], ["", "reach "], ["", "write to "]),
    "secret": (["token = \"", "secret: ", "api_key=", "bearer "], ["password = \"", "access_key: ", "auth token "], ["api-key: ", "passwd=", "token: "]), "name": (["patient: ", "Name: "], ["Employee: ", "name = "], ["Nom: ", "Patient: "]),
    "hash": (["commit ", "sha1 ", "md5: "], ["revision ", "checksum "], ["digest ", "build "]), "order": (["order ", "No. ", "item "], ["invoice ", "part "], ["item no. ", "order: "]),
}


def generated_texts(part: int, n: int = TRAINING_TEXTS, seed: int = SEED) -> list[tuple[str, int, str, int, int]]:
    """Texts with one item each: text, whether the item is personal, its kind, start and end. ``part`` 0 is to learn from, 1 to
    calibrate, 2 to measure recall; they share formats, not syllables or labels. Of the items without a label some that look
    alike count as personal and some don't, as in real texts."""
    r = Random(seed * 10 + part)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(_SYLLABLES[part]) for _ in range(r.randint(1, 4)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    letters = lambda k, more="": "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more) for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
    label = lambda k: r.choice(_LABELS[k][part])
    name = lambda: word().capitalize()
    date = lambda: r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}"])

    def card() -> str:
        s = "4" + d(14)
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(s)))
        s += str(-total % 10)
        return r.choice([".", ". "]).join(s[i : i + 4] for i in range(0, 16, 4)).replace(". ", ".")

    def other_card() -> str:  # check digit wrong
        s = card().replace(".", "")
        return s[:-1] + str((int(s[-1]) + r.randint(1, 9)) % 10)

    def contact() -> str:
        at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" {at} ", " {dot} ")])
        return f"{word()}.{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"

    def account() -> str:
        country, body = r.choice([("DE", d(18)), ("GB", upper(4).translate(str.maketrans("234567", "ABCDEF")) + d(14)), ("FR", d(23)), ("ES", d(20))])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02}{body}"
        return r.choice([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])

    def phone() -> str:
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(7)}", f"0{d(3)} {d(3)} {d(4)}", f"(0{d(2)}) {d(6)}", f"0{d(4)}-{d(6)}"])

    def key() -> str:
        return r.choice([hexa(r.choice([32, 40, 64, 128, 320])), letters(r.choice([24, 32, 40, 300])), letters(38, "/+") + r.choice(["", "=", "=="])])

    def vendor() -> str:
        return r.choice(["AKIA" + upper(16), "sk-" + letters(r.choice([32, 48])), "ghp_" + letters(36), "eyJ" + letters(20) + ".eyJ" + letters(40) + "." + letters(43, "-_"), "xoxb-" + d(11) + "-" + letters(24), "AIza" + letters(35, "-_")])

    def street() -> str:
        return r.choice([f"{r.randint(1, 9999)} {name()} {r.choice(['Street', 'Road', 'Avenue', 'Lane', 'Drive'])}", f"{name()}{r.choice(['straße', 'weg', 'platz'])} {r.randint(1, 200)}", f"{r.randint(1, 200)} rue de {name()}", f"Calle {name()} {r.randint(1, 200)}"])

    personal = [  # kind, label, item
        ("contact", lambda: label("mail"), contact), ("number", lambda: label("phone"), phone), ("number", lambda: label("ssn"), lambda: f"{d(3)}-{d(2)}-{d(4)}"), ("number", lambda: r.choice(["", label("bank")]), account),
        ("number", lambda: label("card"), card), ("number", lambda: "", lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])), ("secret", lambda: label("secret"), key), ("secret", lambda: r.choice(["", label("secret")]), vendor),
        ("secret", lambda: r.choice(["password: ", "pwd=", "Passwort: "]), lambda: word() + r.choice(["!", "#", "$", "_"]) + d(3) + letters(r.randint(0, 8))), ("address", lambda: r.choice(["", "lives at ", "address: "]), street),
        ("person", lambda: "", lambda: r.choice(["Mr ", "Mrs. ", "Dr. ", "Herr ", "Frau ", "Mme "]) + name() + " " + name()), ("person", lambda: label("name"), lambda: name() + " " + name()), ("number", lambda: label("phone") + r.choice(["", d(4) + " or "]), phone),
    ]
    other = [
        lambda: date(), lambda: f"in {r.randint(1900, 2000)}-{r.randint(2000, 2030)}", lambda: "ISBN 978-" + d(1) + "-" + d(2) + "-" + d(6) + "-" + d(1), lambda: "version " + ".".join(d(r.randint(1, 3)) for _ in range(5)),
        lambda: r.choice(["$", "€", "total "]) + r.choice(" .").join([d(r.randint(1, 3)), d(3), d(3)]), lambda: label("order") + r.choice([d(r.randint(7, 12)), f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)}-{d(4)}"]), lambda: d(r.randint(7, 10)),
        lambda: label("hash") + hexa(r.choice([32, 40, 64])), lambda: hexa(r.choice([32, 40])), lambda: "/".join(word() for _ in range(8)), lambda: "-".join(word() for _ in range(8)), lambda: "".join(word() for _ in range(9)), lambda: "".join(word().capitalize() for _ in range(8)),
        lambda: f"{word()} at {word()}. {word()}", lambda: f"{word()} at {word()}.", lambda: f"{word()} at {word()} dot. {word()}", lambda: f"{d(7)} km", lambda: " ".join(d(r.randint(1, 2)) for _ in range(r.randint(5, 30))), lambda: d(3) + " " + d(3) + " " + d(3),
        lambda: f"the token: {word()} and", lambda: d(r.randint(13, 15)), lambda: other_card(), lambda: other_card() + " " + d(16), lambda: "www." + word() + "ation." + word() + "ement.com/" + word(), lambda: f"key = {word()}", lambda: "ACGT" * r.randint(5, 12), lambda: "-" * r.randint(20, 60), lambda: "_".join(word() for _ in range(7)),
        lambda: ".".join(word() + "ation" for _ in range(4)), lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{r.randint(1, 30)}-{r.randint(1, 30)}-{r.randint(1, 30)}", lambda: "=" * 30, lambda: f"fig {d(2)}.{d(2)}.{d(2)}", lambda: "sk-" + "-".join(word() for _ in range(5)), lambda: upper(2) + d(2) + " " + upper(4) + " " + upper(4) + " " + d(4),
    ]
    out = []
    for i in range(n):
        lead = " ".join(word() for _ in range(r.randint(0, 5))) + " "
        if i % 2 == 0:
            kind, tag, make = personal[i // 2 % len(personal)]
            lead += tag()
            item, y = make(), 1
        else:
            kind, item, y = "", other[i // 2 % len(other)](), 0
        tail = r.choice(["", ".", ",", "\""]) + " " + r.choice([date(), d(4), word(), word(), word()]) + " " + " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((lead + item + tail, y, kind, len(lead), len(lead) + len(item)))
    return out


_fitted: list[Boosted] = []


def fit(spark: SparkSession) -> Boosted:
    """Trees and thresholds; the features of the generated texts are computed by the expressions that score documents. A
    candidate is personal if it covers the item but for at most two characters and has no more than the item; what covers
    less of it is left out."""
    if _fitted:
        return _fitted[0]
    made = [(part, *row) for part in (0, 1) for row in generated_texts(part)]
    texts = spark.createDataFrame(made, "part int, text string, y int, kind string, s int, e int").withColumn("c", F.explode(candidates(F.col("text"))))
    within = (F.col("y") == 1) & (F.col("c.s") >= F.col("s")) & (F.col("c.e") <= F.col("e"))
    own = within & (F.col("c.kind") == F.col("kind")) & (F.col("c.e") - F.col("c.s") >= F.col("e") - F.col("s") - 2)
    rows = texts.where(own | ~within).select("part", own.cast("int").alias("y"), F.col("c.kind").alias("kind"), F.array(*features(F.col("c"))).alias("x")).orderBy("part", "text", "kind", "c.g", "c.s").collect()
    x, y, kind, learn = np.array([r.x for r in rows]), np.array([r.y for r in rows], float), np.array([r.kind for r in rows]), np.array([r.part == 0 for r in rows])
    model = boost(x[learn], y[learn])
    margin = model.margin(x)
    for k in ADDED_KINDS:
        at = ~learn & (kind == k)
        model.thresholds[k] = calibrate(margin[at], y[at])
    _fitted.append(model)
    return model


# --- operator ---------------------------------------------------------------------------------------------------------


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, base and added (arrays of kind, s, e, m; by kind, then start)."""
    model = model or fit(docs.sparkSession)
    t = F.col("text")
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    based = rows.withColumn("base", base_spans(t)).withColumn("proposed", candidates(t))
    scored = based.withColumn("scored", F.transform(free_of(F.col("proposed"), F.col("base")), lambda c: F.struct(c.alias("c"), F.array(*features(c)).alias("x"))))
    threshold = "CASE v.c.kind " + " ".join(f"WHEN '{k}' THEN {min(v, 1e9)!r}D" for k, v in model.thresholds.items()) + " END"
    chosen = scored.withColumn("chosen", F.expr(f"transform(filter(scored, v -> {model.sql('v.x')} >= {threshold}), v -> v.c)"))

    rank = lambda c: F.coalesce(*[F.when(c["kind"] == k, F.lit(i)) for i, k in enumerate(ADDED_KINDS)])
    plain = lambda c: F.struct(c["kind"], c["s"], c["e"], c["m"])
    ordered = lambda cs: F.sort_array(F.transform(cs, lambda c: F.struct(rank(c).alias("k"), c["s"].alias("s"), c["e"].alias("e"), plain(c).alias("c"))))
    once = lambda cs: F.transform(F.filter(cs, lambda c, i: (i == 0) | (F.get(cs, i - 1)["c"] != c["c"])), lambda c: c["c"])
    added = let(ordered(F.col("chosen")), once)
    return chosen.select("doc_id", "text", F.transform("base", plain).alias("base"), added.alias("added"))


def report(docs: DataFrame, **columns) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = F.col("base")
    number = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias("n_" + k)
    return find(docs, **columns).select("doc_id", *[number(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))


#: code points of the blocks that a text is cut from, so that a piece costs a block and itself, not its position
_CUT = 2048


def redact(docs: DataFrame, *, mask: Callable[[Column], Column] = lambda kind: F.concat(F.lit("<"), kind, F.lit(">")), **columns) -> DataFrame:
    """doc_id and redacted: the text with every span, overlapping ones once, replaced by the mask of its kind (of the one that
    starts first, then the shorter)."""
    found = find(docs, **columns)
    ordered = F.sort_array(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _CUT).cast("int")
        whole = lambda k: F.array_join(F.slice(blocks, k + 1, F.floor((end - 1) / _CUT).cast("int") - k + 1), "")
        return F.when(end <= start, "").otherwise(let(first, lambda k: F.substring(whole(k), start - k * _CUT + 1, end - start)))

    def pieces(spans_: Column) -> Column:
        def masked(blocks: Column, top: Column) -> Column:
            parts = F.transform(spans_, lambda x, i: F.when(x["s"] >= F.get(top, i), F.concat(cut(blocks, F.get(top, i), x["s"]), mask(x["kind"]))).otherwise(""))
            end = F.greatest(F.element_at(top, -1), F.element_at(spans_, -1)["e"])
            return F.concat(F.array_join(parts, ""), cut(blocks, end, F.length("text")))

        tops = running(F.transform(spans_, lambda x: x["e"]), F.lit(0), lambda a, b: F.greatest(a, b))
        return let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0)), lambda blocks: let(tops, lambda top: masked(blocks, top)))

    return found.select("doc_id", let(ordered, lambda s: F.when(F.size(s) == 0, F.col("text")).otherwise(pieces(s))).alias("redacted"))
