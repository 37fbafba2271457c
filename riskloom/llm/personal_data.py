"""Personal data by anchor expansion.

Aho-Corasick finds anchors in one pass: at-signs, digits, a plus before a digit, address schemes and
identifier cues. Local parsers expand each anchor to the boundaries of a value and
validate it. The parsers of the four base kinds give what leftmost matching of their patterns
over the whole text gives: per kind they go from left to right, and a match takes its characters
whether or not it is valid.

Added kinds: ``account`` (a value of six or more letters, digits and ``_ . + / = -`` after an identifier
cue, with four digits, or with one after a secret's cue and a colon or equals sign; or an account number in
groups of four whose check digits hold) and ``url_user`` (a name or password inside an address with a scheme).
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, map_batches

KINDS = ("email", "ip", "card", "phone", "account", "url_user")
BASE = KINDS[:4]

# Cues before an identifier, and schemes of addresses.
CUES = (
    "account number", "account no", "account", "acct", "iban", "passport", "ssn", "social security",
    "tax id", "customer id", "user id", "license no", "token", "api key", "apikey", "secret", "password",
)
# Of these, those whose value is a secret: after a colon or equals sign one digit is enough.
SECRETS = frozenset(("token", "api key", "apikey", "secret", "password"))
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = "0123456789"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What may stand between a cue and its value, then the value.
_LEAD = re.compile(r"[\x20\t]*+(?:(?:is|number|no\.?|#)(?![A-Za-z0-9])[\x20\t]*+)?([:=]?)[\x20\t]*+[\"']?")
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.+/=-]{5,}+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_USER = re.compile(r"[^\s/@?#\"'<>]++(?=@)")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for d in _DIGITS:
        a.add_word(d, ("digit", 1))
        a.add_word(f"+{d}", ("phone", 2))
    for s in SCHEMES:
        a.add_word(s, ("url_user", len(s)))
    for c in CUES:
        a.add_word(c, ("account", len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban(value: str) -> bool:
    """Whether the check digits of an account number hold (modulo 97)."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _account(text: str, at: int, cue: str, dead: list[int]) -> tuple[int, int] | None:
    """The value after a cue that ends before ``at``. ``dead`` is the last run without enough digits: what
    starts inside it is not read again, so a run is read a bounded number of times."""
    lead = _LEAD.match(text, at)
    start = lead.end()
    # Grouped in fours, shortened by groups until the check digits hold.
    if m := _IBAN.match(text, start):
        end = m.end()
        while end - start >= 14:
            if iban(text[start:end].replace(" ", "")):
                return start, end
            end = text.rfind(" ", start, end)
    need = 1 if cue in SECRETS and lead[1] else 4
    if dead[0] <= start < dead[1] and dead[2] < need:
        return None
    if not (m := _VALUE.match(text, start)):
        return None
    value = m[0].rstrip("._+/=-") if m[0][-1] in "._+/-" else m[0]
    digits = sum(map(value.count, _DIGITS))
    if digits >= need and len(value) >= 6:
        return start, start + len(value)
    dead[:] = [start, m.end(), digits]
    return None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, end exclusive, by start, then as in ``KINDS``."""
    text = text or ""
    out: list[tuple[str, int, int]] = []
    dead = [0, 0, 0]
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    size = len(text)
    # Only ASCII letters are lowered, so positions stay.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for last, (kind, length) in _anchors().iter(lowered):
        at = last - length + 1
        if kind == "digit":
            if at >= free["card"] and (m := _CARD.match(text, at)):
                free["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, m.end()))
            # A match starts where a run of digits does, or where the last match ended.
            if at >= free["ip"] and (at == free["ip"] or text[at - 1] not in _DIGITS):
                if m := _IP.match(text, at):
                    free["ip"] = m.end()
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                        out.append(("ip", at, m.end()))
        elif kind == "phone":
            if at >= free["phone"] and (m := _PHONE.match(text, at)):
                free["phone"] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append(("phone", at, m.end()))
        elif kind == "email":
            start = at
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                free["email"] = m.end()
                out.append(("email", start, m.end()))
        elif kind == "account":
            # A cue is a word of its own, followed by a value.
            ends = last + 1 < size and not text[last + 1].isalnum()
            if ends and at >= free["account"] and (not at or not text[at - 1].isalnum()):
                if found := _account(text, last + 1, lowered[at : last + 1], dead):
                    free["account"] = found[1]
                    out.append(("account", *found))
        elif m := _USER.match(text, last + 1):
            out.append(("url_user", m.start(), m.end()))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, with ``spans``: an array of ``(kind, start, end)``. Null and empty
    texts have none; repeated rows are searched each, no rows give none. Texts are taken whole, one at a
    time; nothing is shuffled. ``keep`` must not hold ``spans``."""
    whole = fresh(df, "__text")
    source = df.select(*keep, F.col(text).alias(whole))

    def rows(batch):
        spans = [
            [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in batch[whole]
        ]
        return {"spans": spans}

    return map_batches(source, "spans array<struct<kind:string,start:long,end:long>>", rows, keep)


def digest(spans: Column) -> dict[str, Column]:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return {f"n_{k}": count(k) for k in BASE} | {
        "base_sha256": F.sha2(F.array_join(F.transform(base, one), ","), 256),
        "spans": F.array_join(F.transform(spans, one), ","),
    } | {f"n_{k}": count(k) for k in KINDS if k not in BASE}


def redact_text(text: str | None) -> str | None:
    """``text`` with each stretch of overlapping spans replaced by its first kind in brackets."""
    if not text:
        return text
    out, done = [], 0
    for kind, start, end in find_spans(text):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the spans of ``text`` replaced; other columns and all rows stay as they are."""

    def rows(batch):
        return {text: [redact_text(t) for t in batch[whole]]}

    whole = fresh(df, "__text")
    others = [c for c in df.columns if c != text]
    found = map_batches(df.select(*others, F.col(text).alias(whole)), f"`{text}` string", rows, others)
    return found.select(*df.columns)


__all__ = ["BASE", "KINDS", "digest", "find_personal_data", "find_spans", "redact"]
