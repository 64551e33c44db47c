"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, schemes and identifier cues. From
each anchor a deterministic local parser expands to the boundaries of an e-mail address, a number, a URL or an account,
and validates it. The base kinds give the matches of their patterns, leftmost and without overlap, in linear time.

The method adds to them: `url` (a scheme and what follows, where it carries a user or an e-mail address), `iban` (a
country code and digits that pass mod 97, after its cue), `account` (the number after words such as "account"), and
`secret` (the value after "password=", "token =" and the like, and AKIA keys).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "secret")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"://[^\x00-\x20\"'<>`{|}\x7f]++")
IBAN = re.compile(r"[\x20:#.]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?|num\.?))?[\x20:#=.]{1,4}([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])")
SECRET = re.compile(r"[\x20]?[=:][\x20]?[\"']?([A-Za-z0-9+/_.-]{8,})")
AKIA = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")

CUES = {w: "iban" for w in ("IBAN", "iban", "Iban")}
CUES |= {v: "account" for w in ("account", "acct", "passport", "ssn", "konto", "compte", "cuenta") for v in (w, w.upper(), w.capitalize())}
CUES |= {v: "secret" for w in ("password", "passwd", "token", "api_key", "secret") for v in (w, w.upper(), w.capitalize())}
CUES |= {"AKIA": "akia", "://": "url", "@": "email", "+": "phone"} | {d: "digit" for d in "0123456789"}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in CUES.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, in order; a text without any gives an empty dict."""
    found: dict[str, list[tuple[int, int]]] = {}
    until = dict.fromkeys(BASE + ADDED, 0)

    def take(kind: str, start: int, end: int, good: bool) -> None:
        until[kind] = end
        if good:
            found.setdefault(kind, []).append((start, end))

    for last, (kind, length) in automaton().iter(text):
        at = last + 1 - length
        if kind == "digit":
            if at >= until["ip"] and (at == until["ip"] or text[at - 1] not in DIGITS) and (m := IP.match(text, at)):
                take("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")))
            if at >= until["card"] and (m := CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                take("card", at, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
        elif kind == "email":
            start = at
            while start > until["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                take("email", start, m.end(), True)
        elif kind == "phone":
            if at >= until["phone"] and (m := PHONE.match(text, at)):
                take("phone", at, m.end(), 9 <= sum(c in DIGITS for c in m[0]) <= 15)
        elif kind == "url":
            start = at
            while start > until["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at and (m := URL.match(text, at)):
                take("url", start, m.end(), "@" in m[0])
        elif kind == "akia":
            if at >= until["secret"] and (at == 0 or not text[at - 1].isalnum()) and (m := AKIA.match(text, at)):
                take("secret", at, m.end(), True)
        elif at == 0 or not text[at - 1].isalnum():
            m = {"iban": IBAN, "account": ACCOUNT, "secret": SECRET}[kind].match(text, last + 1)
            if m and m.start(1) >= until[kind]:
                take(kind, m.start(1), m.end(1), kind != "iban" or mod97(m[1].replace(" ", "")))
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found.get(k, ()))


def redact(text: str, mark: str = "[{kind}]") -> str:
    """The text with every span replaced; where spans overlap, the one that begins first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, s in find(text).items() for a, b in s):
        if start >= at:
            out += [text[at:start], mark.format(kind=kind)]
            at = end
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """A row for each row of docs; a null text counts as an empty one, a text without spans has empty `spans`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = find(text or "")
                base = joined(found, BASE)
                rows.append([*(len(found.get(k, ())) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), joined(found, BASE + ADDED)])
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
