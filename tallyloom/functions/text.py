"""Text functions as columns: normal forms, hashes, masks of personal data."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = "0123456789abcdef"


def normal_form(text: Column) -> Column:
    """White space as single spaces, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def text_hash(text: Column) -> Column:
    return F.sha2(normal_form(text), 256)


def hex_remainder(digest: Column, modulus: int) -> Column:
    """A hexadecimal number of any length modulo modulus."""
    places = F.transform(F.filter(F.split(digest, ""), lambda c: c != ""), lambda c: F.instr(F.lit(DIGITS), c) - 1)
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % modulus)


def unit_interval(text: Column, steps: int = 1_000_000) -> Column:
    """A number in [0, 1) that depends on the text alone."""
    return hex_remainder(F.sha2(text, 256), steps) / float(steps)


def assign_split(row_id: Column, seed: int = 0, train: float = 0.7, val: float = 0.15) -> Column:
    u = unit_interval(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def fold_share(row_id: Column, share: float) -> Column:
    """Whether the first 13 hexadecimal digits of the hash, as a fraction, are below share."""
    return F.conv(F.substring(F.sha2(row_id.cast("string"), 256), 1, 13), 16, 10).cast("double") / float(16**13) < share


#: Placeholders, and the patterns of scrub() in their order: fixed values.
PLACEHOLDERS = {"email": "[EMAIL]", "iban": "[IBAN]", "card": "[CARD]", "iin": "[IIN]", "phone": "[PHONE]", "number": "[NUMBER]", "name": "[NAME]"}
SCRUB = (
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "email"),
    (r"(?<![A-Za-z0-9_])[Kk][Zz][0-9]{2}(?: ?[A-Za-z0-9]){16}(?![A-Za-z0-9_])", "iban"),
    (r"(?U)(?<![A-Za-z_\d])(?:\d{16}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?![A-Za-z_\d])", "card"),
    (r"(?U)(?<![A-Za-z_\d])\d{12}(?![A-Za-z_\d])", "iin"),
    (r"(?U)(?<!\d)(?:\+7|8|7)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)", "phone"),
    (r"(?U)(?<![\w+])\+\d(?:[  ().\-]{0,2}\d){7,14}(?!\d)", "phone"),
    (r"(?U)(?<!\d)(?:\(7\d{2}\)[  .\-]?\d{3}[  .\-]?\d{2}[  .\-]?\d{2}|7\d{2}\.\d{3}\.\d{2}\.\d{2})(?!\d)", "phone"),
)


#: What a text must have for a pattern of a kind to be looked for; the rest need a digit.
NEEDS = {"email": "@", "iban": "[Kk][Zz][0-9]{2}"}


def _masked(text: Column, pattern: str, kind: str) -> Column:
    """The text, which is computed once, without what the pattern finds; few texts have what it needs."""
    one = F.transform(F.array(text), lambda t: F.when(t.rlike(NEEDS.get(kind, r"\p{Nd}")), F.regexp_replace(t, pattern, PLACEHOLDERS[kind])).otherwise(t))
    return F.element_at(one, 1)


def scrub(text: Column) -> Column:
    """Addresses, account, card, identity and phone numbers as placeholders; blank texts as they are. Applying it again changes nothing."""
    for pattern, kind in SCRUB:
        text = _masked(text, pattern, kind)
    return text


def residual(text: Column) -> Column:
    """Whether scrubbing would change the text."""
    return scrub(text) != text


def phone_digits(number: Column) -> Column:
    """Digits only; null under seven; ten digits get a 7 before them, and of eleven a leading 8 becomes 7."""
    d = F.regexp_replace(number, r"(?U)\D", "")
    return F.when(F.length(d) < 7, None).when(F.length(d) == 10, F.concat(F.lit("7"), d)).when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)


def phone_prefix(number: Column) -> Column:
    d = phone_digits(number)
    return F.when(d.isNotNull(), F.concat(F.lit("+"), F.substring(d, 1, 1), F.lit(" "), F.substring(d, 2, 3), F.lit(" ***")))


def keyed_hash(number: Column, key: bytes) -> Column:
    """The first 24 hexadecimal digits of HMAC-SHA256, from Spark's own SHA-256 by the definition of HMAC."""
    if not key:
        raise ValueError("a key is needed")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    d = phone_digits(number)
    first = F.unhex(F.sha2(F.concat(inner, d.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, 24)


def reference_keyed_hash(digits: str, key: bytes) -> str:
    return hmac.new(key, digits.encode(), hashlib.sha256).hexdigest()[:24]


def fingerprint(members: Column) -> Column:
    """Sixteen letters g to v that depend on the set of members alone."""
    return F.translate(F.substring(F.sha2(F.array_join(F.array_sort(members), "\n"), 256), 1, 16), DIGITS, "ghijklmnopqrstuv")


def letter_share(text: Column, letters: str) -> Column:
    """The part of a text's letters that are among letters; 0 without letters."""
    every = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.when(every > 0, F.length(F.regexp_replace(text, f"[^{letters}]", "")) / every).otherwise(0.0)


def clean(text: Column) -> Column:
    """Line ends as \\n, backspaces dropped, wrapping straight quotes and blanks stripped, blanks within lines squeezed."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\b", ""))
    count = F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))
    both = t.startswith('"') & t.endswith('"') & (F.length(t) >= 2)
    t = F.when(both, F.substring(t, F.lit(2), F.length(t) - 2)).when(t.startswith('"') & (count == 1), F.substring(t, F.lit(2), F.length(t))).when(t.endswith('"') & (count == 1), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)[^\S\n]+", " ")))
    return F.trim(F.array_join(lines, "\n"))


def corrupted(text: Column) -> Column:
    """Control characters, or a line end within a word."""
    return text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") | text.rlike(r"(?U)\w\n\w")


def char_grams(text: Column, n: int = 5) -> Column:
    """The different runs of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(1.0)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most > 0, 1 - F.levenshtein(a, b) / most).otherwise(1.0)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one big integer as the row of the table."""
    where: dict[str, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    row = 0
    for y in b:
        m = where.get(y, 0) | row
        row = m & ~(m - ((row << 1) | 1))
    return row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """The harmonic mean of precision and recall of the longest common subsequence of words; 0 if either has none."""

    def one(x: str | None, y: str | None) -> float:
        p, q = (x or "").split(), (y or "").split()
        n = lcs_length(p, q) if p and q else 0
        return 2 * n / (len(p) + len(q)) if n else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def _kept(text: str) -> tuple[str, list[int]]:
    """Letters and digits of a text in a plain form, and where each stood."""
    out, at = [], []
    for k, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).lower().replace("ё", "е"):
            if re.match(r"[0-9a-zа-яәғқңөұүһі]", x):
                out.append(x)
                at.append(k)
    return "".join(out), at


def edits_allowed(length: int) -> int:
    """0 under 12 characters, 1 under 21, 2 under 31, then 3."""
    return sum(length >= x for x in (12, 21, 31))


#: What isn't kept of a text in lower case, and ё as е.
PLAIN = "[^0-9a-zа-яәғқңөұүһі]"


def phrase_parts(phrase: str) -> list[str]:
    """Parts of a phrase of which a text must hold one, if it holds the phrase with as many edits as are allowed; none if no edits are."""
    want, _ = _kept(phrase)
    most = edits_allowed(len(want))
    cut = [len(want) * i // (most + 1) for i in range(most + 2)]
    return [want[a:b] for a, b in zip(cut, cut[1:], strict=False)] if most else []


def find_phrase(text: str, phrase: str) -> tuple[int, int] | None:
    """Where a phrase stands in a text: literally but for case, or else, line by line, with few edits and regardless of blanks and marks."""
    if not text or not phrase:
        return None
    if (k := text.lower().find(phrase.lower())) >= 0:
        return k, k + len(phrase)
    want, _ = _kept(phrase)
    most = edits_allowed(len(want))
    if not most:
        return None
    begin = 0
    for line in text.split("\n"):
        have, at = _kept(line)
        if have and any(part in have for part in phrase_parts(phrase)):  # a part without an edit must be there
            row = [(0, j) for j in range(len(have) + 1)]  # cost and start of the best match that ends here
            for i, x in enumerate(want, 1):
                new = [(i, 0)]
                for j, y in enumerate(have, 1):
                    ways = ((row[j - 1][0] + (x != y), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1]))
                    new.append(min(ways, key=lambda w: w[0]))
                row = new
            end = min(range(1, len(row)), key=lambda j: (row[j][0], j))
            cost, start = row[end]
            if cost <= most and end > start:
                return begin + at[start], begin + at[end - 1] + 1
        begin += len(line) + 1
    return None
