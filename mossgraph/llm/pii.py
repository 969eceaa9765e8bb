"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and words that announce an
identifier.  At each anchor a deterministic local parser expands to the boundaries of an e-mail address, an IP address, a
card number, a telephone number, a web address that carries a user name, or an account identifier, and validates it
(octets, Luhn, digit counts, IBAN remainder, lengths).

Kinds, in this order: email, ip, card, phone (leftmost non-overlapping matches of fixed expressions per kind), then iban,
ssn, account, secret, url_login, which the method adds.  Spans count code points, end exclusive.  Null and empty texts have
no spans; very long texts are read whole, in one pass, and digit runs of any length are compared as text.  Where two kinds
begin at one place (a tie) both spans stay, in the order of the kinds.  Rows are independent: repeated rows, null ids and any
other columns, whatever their names, are of no consequence.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "secret", "url_login")
ORDER = {kind: k for k, kind in enumerate(KINDS)}

# The expressions of the base kinds, and the cues.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|id|#))?[\x20:=#]{1,3}([A-Za-z0-9][A-Za-z0-9-]{3,33})(?![A-Za-z0-9])", re.I)
SECRET = re.compile(r"[\"']?[\x20]?[:=][\x20]?[\"']?([A-Za-z0-9_+/.=-]{16,})")
LOGIN = re.compile(r"[^\s/@:\"'<>]+(?::[^\s/@\"'<>]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?")
CUES = {
    "account": ("account", "acct", "customer", "passport", "licence", "license", "member", "patient", "policy"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key"),
    "url_login": ("http://", "https://", "ftp://", "ssh://", "sftp://"),
}
DIGITS = frozenset("0123456789")


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0") or "0"
    return len(digits) <= 3 and int(digits) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class Finder:
    """All spans of a text."""

    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for mark in "@+0123456789":
            self.anchors.add_word(mark, ("digit" if mark in DIGITS else mark, 1))
        for kind, words in CUES.items():
            for word in words:
                for form in {word, word.upper(), word.capitalize()}:
                    self.anchors.add_word(form, (kind, len(form)))
        self.anchors.make_automaton()

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        found: list[tuple[str, int, int]] = []
        ended = dict.fromkeys(KINDS, 0)

        def take(kind: str, start: int, end: int) -> None:
            ended[kind] = end
            found.append((kind, start, end))

        for last, (anchor, length) in self.anchors.iter(text):
            at = last - length + 1
            if anchor == "@":
                start = at
                while start > ended["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := EMAIL.match(text, start)):
                    take("email", start, m.end())
            elif anchor == "+":
                if at >= ended["phone"] and (m := PHONE.match(text, at)):
                    ended["phone"] = m.end()
                    if 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                        take("phone", at, m.end())
            elif anchor == "digit":
                first = at == 0 or text[at - 1] not in DIGITS
                if at >= ended["ip"] and (first or at == ended["ip"]) and (m := IP.match(text, at)):
                    ended["ip"] = m.end()
                    if all(_octet(p) for p in m.group().split(".")):
                        take("ip", at, m.end())
                if at >= ended["card"] and (first or at == ended["card"]) and (m := CARD.match(text, at)):
                    ended["card"] = m.end()
                    digits = "".join(c for c in m.group() if c in DIGITS)
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        take("card", at, m.end())
                if first and at >= ended["ssn"] and (m := SSN.match(text, at)) and text[at - 1 : at] not in ("-", ".") and text[at : at + 3] not in ("000", "666") and text[at] != "9":
                    take("ssn", at, m.end())
                if first and at >= 2 and at - 2 >= ended["iban"]:
                    self._iban_at(text, at - 2, take)
            elif anchor == "account":
                if self._word_start(text, at) and last + 1 >= ended["account"] and (m := ACCOUNT.match(text, last + 1)) and sum(c in DIGITS for c in m[1]) >= 4:
                    take("account", *m.span(1))
            elif anchor == "secret":
                if self._word_start(text, at) and last + 1 >= ended["secret"] and (m := SECRET.match(text, last + 1)):
                    ended["secret"] = m.end()  # whatever begins within has no digits either
                    if any(c in DIGITS for c in m[1]):
                        take("secret", *m.span(1))
            elif anchor == "url_login" and (m := LOGIN.match(text, last + 1)):
                take("url_login", at, m.end())
        return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))

    @staticmethod
    def _word_start(text: str, at: int) -> bool:
        return at == 0 or not text[at - 1].isalnum()

    @staticmethod
    def _iban_at(text: str, at: int, take) -> None:
        if at and text[at - 1].isalnum() or not (m := IBAN.match(text, at)):
            return
        end = m.end()
        while end - at >= 15:
            if (end == len(text) or not text[end].isalnum()) and _iban(text[at:end]):
                take("iban", at, end)
                return
            end -= 1


def _spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans, n_email, n_ip, n_card, n_phone, n_other, base_sha256, masked_text)`` for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                spans = finder(text) if text else []
                base = [s for s in spans if ORDER[s[0]] < 4]
                counts = [sum(s[0] == kind for s in base) for kind in KINDS[:4]]
                row = [_spelled(spans), *counts, len(spans) - len(base), hashlib.sha256(_spelled(base).encode()).hexdigest(), masked(text, spans) if spans else text]
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id_col, "spans", "n_email", "n_ip", "n_card", "n_phone", "n_other", "base_sha256", "masked_text"])

    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, f"`{id_col}` long, spans string, n_email long, n_ip long, n_card long, n_phone long, n_other long, base_sha256 string, masked_text string")


def mask_personal_data(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by bracketed kinds, and ``length_col`` where a text
    changed; all other columns and all rows stay."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            arrays = dict(zip(names, batch.columns, strict=True))
            before = arrays[text_col].to_pylist()
            texts = [masked(t, finder(t)) if t else t for t in before]
            arrays[text_col] = pa.array(texts, pa.string())
            if length_col in arrays:
                sizes = zip(before, texts, arrays[length_col].to_pylist(), strict=True)
                arrays[length_col] = pa.array([n if t == b else len(t) for b, t, n in sizes], arrays[length_col].type)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names)

    return docs.mapInArrow(run, schema)
