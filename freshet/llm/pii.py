"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, scheme marks and cue
words. Local parsers expand each anchor to the left and to the right, decide the borders and validate what they hold.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``; a base parser finds the leftmost, longest, non-overlapping
matches of its form and drops those that fail the check, without a second try. The method adds

* ``email``: addresses written with a fullwidth at-sign or with "(at)"/"[at]" and "(dot)"/"[dot]";
* ``url``: the authority of a scheme mark that holds a user name or password, or an IPv6 address in brackets;
* ``account``: bank account numbers (IBAN, with its check digits) and numbers of 6 to 18 digits behind a cue word
  such as "account no".

Added spans that overlap a base span are dropped, unless a ``url`` span holds all of it. Positions count code points, end exclusive.

Defined cases: null text is empty; repeated rows are searched each; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.bytescan import in_small_batches

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "n_added long"
)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGIT = frozenset("0123456789")
_PHONE = frozenset(" ().-0123456789")
#: fixed values: words that announce an account number, and lengths of IBANs by country
CUES = ("account no", "account number", "acct no", "acct #", "account #", "kontonummer", "konto-nr", "iban", "ssn")
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27,
    "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}
_DOTTED = re.compile(r"(?:\(at\)|\[at\])", re.IGNORECASE)


@cache
def anchors():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for sign in ("@", "＠", "+", "://", "(at)", "[at]", "(AT)", "[AT]", *_DIGIT):
        auto.add_word(sign, (sign.lower(), len(sign)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            auto.add_word(form, ("cue", len(form)))
    auto.make_automaton()
    return auto


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of ``allowed`` characters from ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _run_back(text: str, at: int, allowed: frozenset, floor: int) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def _domain_end(text: str, at: int) -> int:
    """End of a dotted host name from ``at``, or -1: two labels at least."""
    end = _run(text, at, _HOST)
    if end == at:
        return -1
    labels = 1
    while end < len(text) and text[end] == ".":
        after = _run(text, end + 1, _HOST)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    return end if labels > 1 else -1


def _four_numbers(text: str, start: int) -> tuple[int, bool]:
    """(end, valid) of four dotted digit runs from ``start``; end is -1 where the form is not met."""
    at, valid = start, True
    for i in range(4):
        if i:
            if at >= len(text) or text[at] != ".":
                return -1, False
            at += 1
        end = _run(text, at, _DIGIT)
        if end == at:
            return -1, False
        valid = valid and (end - at <= 3 or not text[at:end - 3].strip("0")) and int(text[max(at, end - 3):end]) <= 255
        at = end
    return at, valid


def _digit_groups(text: str, start: int) -> tuple[int, int]:
    """(end, digits) of digits with single spaces or hyphens between them."""
    at, digits = start, 0
    while True:
        end = _run(text, at, _DIGIT)
        digits += end - at
        if end + 1 < len(text) and text[end] in " -" and text[end + 1] in _DIGIT:
            at = end + 1
        else:
            return end, digits


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def iban(text: str, start: int) -> int:
    """End of a valid IBAN from ``start``, or -1; single spaces may stand between its characters."""
    n = IBAN_LENGTH.get(text[start:start + 2])
    if not n:
        return -1
    at, own = start, ""
    while len(own) < n and at < len(text):
        c = text[at]
        if c.isascii() and c.isalnum():
            own += c
        elif c != " " or text[at - 1] == " ":
            return -1
        at += 1
    if len(own) < n or (at < len(text) and text[at].isascii() and text[at].isalnum()) or not own[2:4].isdigit():
        return -1
    return at if int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1 else -1


def _spoken_email(text: str, start: int, end: int) -> tuple[int, int] | None:
    """Borders of "name (at) host (dot) tld" around the mark at ``start`` to ``end``."""
    name_end = start - (start > 0 and text[start - 1] == " ")
    name = _run_back(text, name_end, _LOCAL, 0)
    at = end + (text[end:end + 1] == " ")
    host_end = _run(text, at, _HOST)
    if name == name_end or host_end == at:
        return None
    dots = 0
    while True:
        m = re.compile(r" ?(?:\(dot\)|\[dot\]) ?|\.", re.IGNORECASE).match(text, host_end)
        after = _run(text, m.end(), _HOST) if m else -1
        if not m or after == m.end():
            break
        host_end, dots = after, dots + 1
    return (name, host_end) if dots else None


def find_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) of ``text`` as (start, kind, end), sorted."""
    base, extra = [], []
    done = dict.fromkeys(BASE, 0)
    for last, (sign, size) in anchors().iter(text):
        start = last + 1 - size
        if sign == "@":
            left = _run_back(text, start, _LOCAL, done["email"])
            end = _domain_end(text, start + 1) if left < start else -1
            if end >= 0:
                base.append((left, 0, end))
                done["email"] = end
        elif sign in _DIGIT:
            if start >= done["ip"] and (start == done["ip"] or text[start - 1] not in _DIGIT):
                end, valid = _four_numbers(text, start)
                if end >= 0:
                    done["ip"] = end
                    if valid:
                        base.append((start, 1, end))
            if start >= done["card"]:
                end, digits = _digit_groups(text, start)
                if digits > 1:
                    done["card"] = end
                    if 14 <= digits <= 19 and luhn(re.sub("[^0-9]", "", text[start:end])):
                        base.append((start, 2, end))
        elif sign == "+":
            if start >= done["phone"] and text[start + 1:start + 2] in _DIGIT and start + 1 < len(text):
                end = _run(text, start + 2, _PHONE)
                while end > start + 2 and text[end - 1] not in _DIGIT:
                    end -= 1
                if end >= start + 4:
                    done["phone"] = end
                    if 10 <= sum(c in _DIGIT for c in text[start:end]) <= 15:
                        base.append((start, 3, end))
        elif sign == "＠":
            left = _run_back(text, start, _LOCAL, 0)
            end = _domain_end(text, start + 1) if left < start else -1
            if end >= 0:
                extra.append((left, 0, end))
        elif sign in ("(at)", "[at]"):
            if found := _spoken_email(text, start, last + 1):
                extra.append((found[0], 0, found[1]))
        elif sign == "://":
            end = start + 3
            while end < len(text) and text[end] not in "/?# \t\r\n\"'<>":
                end += 1
            authority = text[start + 3:end]
            if "@" in authority[1:] or re.fullmatch(r"\[[0-9A-Fa-f:.]{3,}\](:[0-9]+)?", authority):
                extra.append((start + 3, 4, end))
        else:
            at = last + 1
            while at < len(text) and text[at] in " .:#=" and at < last + 6:
                at += 1
            end = iban(text, at)
            if end < 0 and text[at:at + 1] in _DIGIT and at < len(text):
                end, digits = _digit_groups(text, at)
                end = end if 6 <= digits <= 18 else -1
            if end >= 0:
                extra.append((at, 5, end))
    base.sort()
    added, floor = [], 0
    taken = [(s, e) for s, _, e in base]
    for s, k, e in sorted(set(extra)):
        inner = k == KINDS.index("url")  # the name and host of an authority may look like an address
        if s >= floor and not any(s < b and a < e and not (inner and s <= a and b <= e) for a, b in taken):
            added.append((s, k, e))
            floor = e
    return base, added


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans, a digest of them and all spans, for every document of ``docs`` (doc_id, text)."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                out = [[] for _ in names]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    base, added = find_spans(text.as_py() or "")
                    counts = [sum(k == i for _, k, _ in base) for i in range(4)]
                    digest = hashlib.sha256(spelled(base).encode()).hexdigest()
                    row = (doc, *counts, digest, spelled(sorted(base + added)), len(added))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def masked_text(text: str) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    base, added = find_spans(text)
    out, at = [], 0
    for s, k, e in sorted(base + added):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def masked_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with personal data in ``text`` masked and ``n_chars`` counted anew; other columns unchanged."""
    columns = docs.columns
    at, schema = columns.index("text"), docs.schema

    def run(batches):
        for batch in batches:
            texts = [t if t is None else masked_text(t) for t in batch.column(at).to_pylist()]
            arrays = [pa.array(texts, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.record_batch(arrays, schema=batch.schema)

    out = in_small_batches(docs).mapInArrow(run, schema)
    if "n_chars" in columns:
        kind = schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out
