"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers and dates that look personal are validated (check digits, octets, calendar), and
valid ones are permuted within their format: a card number becomes another valid card
number with the same separators, a date another date. The permutation depends on the key
and the kind alone, so equal values get equal pseudonyms in every document, however they are
spelled, and different values stay different; with the key it can be undone, but where an IBAN or a
card in unusual groups and a neighbour beside a blank happen to validate together afterwards.
What does not validate is left as it is.

| kind | checked | permuted |
| --- | --- | --- |
| secret | 12 or more hexadecimal digits after a name such as password or token | the digits |
| email | shape | letters and digits of the local part |
| iban | length, remainder 97 | digits behind the check digits, which are set anew |
| date | calendar, years 1900 to 2099; month first where the second number is over 12 | day, so that days over 12 stay so |
| ip | octets | the 32-bit address |
| phone | `+`, 8 to 15 digits | digits behind the country code |
| ssn | number ranges | all digits |
| card | 13 to 19 digits, Luhn; usual groups (4-4-4-4, 4-6-5, 4-6-4, 4-4-4-4-3, all in one) before others | digits before the check digit, which is set anew |

Defined results: a NULL text stays NULL and an empty one empty, both without findings;
texts are searched whole, whatever their length; repeated rows give repeated results; an
empty table gives an empty result; other columns are kept, whatever their names: if one is
called like the findings (in any case), these take underscores behind their name.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickersift.llm.sharding import unused

ROUNDS = 10
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
HEX = DIGITS + "abcdef"
HEX_MIXED = HEX + "ABCDEF"

# Country calling codes of one and of two digits; all others have three.
CODES_1 = ["1", "7"]
CODES_2 = [
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66",
    "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
]

# Groups of digits in which cards are printed, those first that are tried first.
CARD_GROUPS = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)]

FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))


class Feistel:
    """Permutations of the numbers below ``radix ** length``, one for each kind of value."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()

    def _round(self, kind: str, n: int, length: int, value: int) -> int:
        size = (value.bit_length() + 7) // 8 or 1
        message = b"%s|%d|%d|" % (kind.encode(), n, length) + value.to_bytes(size, "big")
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=32).digest(), "big")

    def permute(self, kind: str, value: int, radix: int, length: int, undo: bool = False) -> int:
        if length < 2:  # one digit has no halves
            shift = self._round(kind, 0, length, 0) % radix
            return (value + (-shift if undo else shift)) % radix if length else value
        left_size, right_size = radix ** (length // 2), radix ** (length - length // 2)
        left, right = divmod(value, right_size)
        for n in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            # Halves of different sizes take turns instead of swapping places.
            if n % 2:
                f = self._round(kind, n, length, left)
                right = (right + (-f if undo else f)) % right_size
            else:
                f = self._round(kind, n, length, right)
                left = (left + (-f if undo else f)) % left_size
        return left * right_size + right

    def walk(self, kind: str, value: int, radix: int, length: int, valid: Callable[[int], bool], undo: bool = False) -> int:
        """The permutation of the valid numbers: go on until a valid one comes up."""
        value = self.permute(kind, value, radix, length, undo)
        while not valid(value):
            value = self.permute(kind, value, radix, length, undo)
        return value

    def string(self, kind: str, text: str, alphabet: str, undo: bool = False, valid: Callable[[str], bool] = lambda _: True) -> str:
        """The permutation of the valid strings over the alphabet."""

        def spelled(value: int) -> str:
            out = []
            for _ in text:
                value, digit = divmod(value, len(alphabet))
                out.append(alphabet[digit])
            return "".join(reversed(out))

        value = 0
        for c in text:
            value = value * len(alphabet) + alphabet.index(c)
        return spelled(self.walk(kind, value, len(alphabet), len(text), lambda v: valid(spelled(v)), undo))


def luhn_digit(payload: str) -> int:
    total = 0
    for place, c in enumerate(reversed(payload)):
        d = int(c) * (1 if place % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in (rest + country + "00").lower())
    return f"{98 - int(number) % 97:02d}"


def refill(template: str, characters: str, replaced: str) -> str:
    """``template`` with its characters out of ``characters`` replaced in turn; case follows the template."""
    new = iter(replaced)
    return "".join((c.upper() if t.isupper() else c) if (t.lower() in characters and (c := next(new, ""))) else t for t in template)


def only(text: str, characters: str) -> str:
    return "".join(c for c in text.lower() if c in characters)


def valid_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == int(digits[-1]) and bool(digits.strip("0"))


def calling_code(digits: str) -> str:
    return digits[:1] if digits[:1] in CODES_1 else digits[: 2 if digits[:2] in CODES_2 else 3]


def valid_ssn(value: int) -> bool:
    area, group, serial = value // 10**6, value // 10**4 % 100, value % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


class Pseudonyms:
    """``of`` gives the pseudonym of a found string, or None if it does not validate; with ``undo`` the original."""

    def __init__(self, key: bytes, undo: bool = False):
        self.feistel, self.undo = Feistel(key), undo

    def of(self, kind: str, text: str) -> str | None:
        return getattr(self, kind)(text)

    def _part(self, kind: str, text: str, alphabet: str, valid: Callable[[str], bool] = lambda _: True) -> str:
        return self.feistel.string(kind, text, alphabet, self.undo, valid)

    def secret(self, text: str) -> str:
        """Digits only, letters of one case and letters of both are permuted among themselves, so the pseudonym shows which it was."""
        if text.isdigit():
            return self._part("secret digits", text, DIGITS)
        if text.isupper() or text.islower():
            new = self._part("secret", text.lower(), HEX, lambda s: not s.isdigit())
            return new.upper() if text.isupper() else new
        return self._part("secret mixed", text, HEX_MIXED, lambda s: s != s.lower() and s != s.upper())

    def email(self, text: str) -> str:
        local, at, domain = text.rpartition("@")
        for alphabet in (LOWER, DIGITS):
            local = refill(local, alphabet, self._part(f"email {len(alphabet)}", only(local, alphabet), alphabet))
        return local + at + domain

    def iban(self, text: str) -> str | None:
        compact = text.replace(" ", "").upper()
        country, check, rest = compact[:2], compact[2:4], compact[4:]
        if not 15 <= len(compact) <= 34 or iban_check(country, rest) != check:
            return None
        rest = refill(rest, DIGITS, self._part(f"iban {country}", only(rest, DIGITS), DIGITS))
        new = iter(country + iban_check(country, rest) + rest)
        return "".join(c if c == " " else next(new) for c in text)

    def date(self, text: str) -> str | None:
        parts = re.split(r"[-/.]", text)
        year_first = len(parts[0]) == 4
        y, m, d = (parts if year_first else parts[::-1])
        month_first = not year_first and int(m) > 12
        if month_first:
            m, d = d, m
        try:
            day = datetime.date(int(y), int(m), int(d))
        except ValueError:
            return None
        number = day.toordinal() - FIRST_DAY
        if not 0 <= number < DAYS:
            return None
        # Days over 12 among themselves, so that one written behind its month is read so again.
        same = lambda v: v < DAYS and (datetime.date.fromordinal(FIRST_DAY + v).day > 12) == (day.day > 12)
        new = datetime.date.fromordinal(FIRST_DAY + self.feistel.walk("date", number, 2, 17, same, self.undo))
        digits = f"{new:%Y%m%d}" if year_first else f"{new:%m%d%Y}" if month_first else f"{new:%d%m%Y}"
        return refill(text, DIGITS, digits)

    def ip(self, text: str) -> str | None:
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        value = self.feistel.permute("ip", int.from_bytes(bytes(octets), "big"), 256, 4, self.undo)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def phone(self, text: str) -> str | None:
        digits = only(text, DIGITS)
        if not 8 <= len(digits) <= 15:
            return None
        code = calling_code(digits)
        return refill(text, DIGITS, code + self._part(f"phone {code}", digits[len(code) :], DIGITS))

    def ssn(self, text: str) -> str | None:
        value = int(only(text, DIGITS))
        if not valid_ssn(value):
            return None
        return refill(text, DIGITS, f"{self.feistel.walk('ssn', value, 10, 9, valid_ssn, self.undo):09d}")

    def card(self, text: str) -> str | None:
        digits = only(text, DIGITS)
        if not valid_card(digits):
            return None
        # The first 16 of 19 digits are tried before them; so they validate in the pseudonym only if they did before.
        same = lambda s: len(s) < 18 or valid_card(s[:16]) == valid_card(digits[:16])
        payload = self._part("card", digits[:-1], DIGITS, same)
        return refill(text, DIGITS, payload + str(luhn_digit(payload)))


# In the order in which they are tried at a place. No pattern can backtrack over more than a few characters a place.
PATTERNS = {
    "secret": r"(?i:(?<=password)|(?<=passwd)|(?<=token)|(?<=secret)|(?<=api_key)|(?<=apikey))(?P<lead>\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[0-9A-Fa-f]{12,})(?![0-9A-Za-z])",
    "email": r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9.,/-])(?P<date>(?:19|20)[0-9]{2}(?P<s>[-/.])[0-9]{2}(?P=s)[0-9]{2}|[0-9]{2}(?P<z>[-/.])[0-9]{2}(?P=z)(?:19|20)[0-9]{2})(?![0-9]|[.,/-][0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?P<phone>\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){1,6})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z.,-])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![0-9A-Za-z])",
}


def ends(kind: str, text: str, begin: int, end: int) -> list[int]:
    """Ends of the candidates of a match, in the order in which they are tried.

    Blanks may join a card or an IBAN to a neighbour, so they may end behind any group: IBANs
    the longest first, cards in usual groups first. A card in usual groups that begins further
    on in the match goes before one in unusual groups that begins here.
    """
    if kind not in ("card", "iban"):
        return [end]
    groups = [m.span() for m in re.compile("[^ -]+").finditer(text, begin, end)]
    found = [e for _, e in groups][::-1]
    if kind == "iban":
        return found
    usual = usual_cards(groups)
    beyond = [m.span() for m in re.compile("[0-9]+").finditer(text, begin, re.compile("(?:[ -]?[0-9])*").match(text, end, end + 24).end())]
    for at in range(1, len(groups)):
        for later in usual_cards(beyond[at:]):
            if valid_card(only(text[beyond[at][0] : later], DIGITS)):
                return [*usual, groups[0][1]]
    return usual + [e for e in found if e not in usual]


def usual_cards(groups: list[tuple[int, int]]) -> list[int]:
    """Ends of the cards in usual groups that begin with the first group."""
    lengths = tuple(e - b for b, e in groups)
    if lengths[0] >= 13:
        return [groups[0][1]]
    return [groups[len(g) - 1][1] for g in CARD_GROUPS if lengths[: len(g)] == g]


def replaced(text: str, finder: re.Pattern, numbers: re.Pattern, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in the original text."""
    out, findings, at, pos = [], [], 0, 0
    pattern = finder if "@" in text or _LEADS.search(text) else numbers
    while match := pattern.search(text, pos):
        kind = next(k for k in PATTERNS if k in match.re.groupindex and match[k] is not None)
        begin, pos = match.span(kind)
        for end in ends(kind, text, begin, pos):
            pos = end  # without a valid candidate, the search goes on behind the first group
            if (new := names.of(kind, text[begin:end])) is not None:
                out += [text[at:begin], new]
                findings.append((kind, begin, end - begin))
                at = end
                break
    return "".join([*out, text[at:]]) if findings else text, findings


_LEADS = re.compile(r"(?i)passw|token|secret|api_?key")
_DIGIT = re.compile("[0-9]")


def pseudonymised(docs: DataFrame, key: bytes, text_column: str = "text", findings_column: str = "pii", undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in the text, and a last column with what was found and where it was."""
    at, names = docs.columns.index(text_column), docs.columns
    findings_column = unused(findings_column, names)
    schema = T.StructType([*docs.schema.fields, T.StructField(findings_column, FINDINGS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = re.compile("|".join(PATTERNS.values()))
        numbers = re.compile("|".join(p for k, p in PATTERNS.items() if k not in ("secret", "email")))
        pseudonyms = Pseudonyms(key, undo)
        for batch in batches:
            texts, found = [], []
            for value in batch.column(at):
                text, findings = value.as_py(), []
                if text and ("@" in text or _DIGIT.search(text)):
                    text, findings = replaced(text, finder, numbers, pseudonyms)
                texts.append(text)
                found.append([{"kind": k, "start": s, "length": n} for k, s, n in findings])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [*names, findings_column])

    return docs.mapInArrow(work, schema)
