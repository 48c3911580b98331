"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, address schemes, digits, plus
signs and identifier cues.  Around each anchor a local parser expands to the left and right, decides the
exact boundaries and validates the find.  Base kinds follow fixed grammars, leftmost and non-overlapping
within a kind; a find that fails its check is dropped and not retried:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), every part at most 255
    card   [0-9]([\\x20-]?[0-9])+, 13 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits

Two more kinds are added beside them: ``url`` (scheme up to white space, quotes or angle brackets, less
closing punctuation, with a host) and ``account`` (an identifier cue as a word of its own, up to 24 characters of
separators and filler words such as ``number`` or ``is``, then a run of at least six letters, digits, blanks or
hyphens that begins and ends with one of the first two, has a digit in each blank-separated group and four in all).
What begins like an IBAN is taken as far as its checksum (ISO 13616, mod 97) holds; without one it is no account
after the cue ``iban``, and a run like others after other cues.

Defined cases.  Null is empty; an empty text has no spans.  Offsets are code points, end exclusive.  Texts of any
length are read whole.  Of cues at one place the longest counts.  Rows are independent, so repeated rows, null ids and
further columns don't matter.  An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import as_text, batches, sha256_hex, two

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: Address schemes and identifier cues, lower case.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "mailto:", "tel:")
CUES = ("account", "acct", "iban", "bic", "swift", "routing", "passport", "ssn", "social security", "tax id", "vat", "license", "licence", "member id", "customer id", "user id", "patient id", "konto", "compte", "cuenta")
FILLERS = ("number", "num", "no", "nr", "nummer", "numéro", "número", "is", "ist", "est", "es", "code", "id")
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
PHONE = frozenset(" ().0123456789-")
URL_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")

Span = tuple[str, int, int]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in [("@", "at"), *((d, "digit") for d in "0123456789"), ("+", "plus"), *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES)]:
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def emails(text: str, ats: list[int]) -> Iterator[Span]:
    free = 0  # no match may begin before this
    for at in ats:
        if at < free:
            continue
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        end, parts, n = at + 1, 0, len(text)
        while True:
            to = end
            while to < n and text[to] in HOST:
                to += 1
            if to == end:
                end -= 1  # the dot, or the at-sign, has nothing after it
                break
            end, parts = to, parts + 1
            if end >= n or text[end] != ".":
                break
            end += 1
        if start < at and parts >= 2:
            yield "email", start, end
            free = end


def digit_runs(ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of consecutive positions as (start, end)."""
    runs: list[tuple[int, int]] = []
    for p in ends:
        if runs and runs[-1][1] == p:
            runs[-1] = (runs[-1][0], p + 1)
        else:
            runs.append((p, p + 1))
    return runs


def ips(text: str, runs: list[tuple[int, int]]) -> Iterator[Span]:
    k = 0
    while k + 3 < len(runs):
        four = runs[k : k + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            if all(len(part := text[a:b].lstrip("0")) <= 3 and int(part or "0") <= 255 for a, b in four):
                yield "ip", four[0][0], four[3][1]
            k += 4
        else:
            k += 1


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def cards(text: str, runs: list[tuple[int, int]]) -> Iterator[Span]:
    k = 0
    while k < len(runs):
        start, end = runs[k]
        count = end - start
        k += 1
        while k < len(runs) and runs[k][0] == end + 1 and text[end] in " -":
            count += runs[k][1] - runs[k][0]
            end = runs[k][1]
            k += 1
        if 13 <= count <= 19 and luhn("".join(c for c in text[start:end] if c in DIGITS)):
            yield "card", start, end


def phones(text: str, pluses: list[int]) -> Iterator[Span]:
    free, n = 0, len(text)
    for plus in pluses:
        if plus < free or plus + 1 >= n or text[plus + 1] not in DIGITS:
            continue
        end = plus + 2
        while end < n and text[end] in PHONE:
            end += 1
        while end > plus and text[end - 1] not in DIGITS:
            end -= 1
        if end - plus < 4:
            continue
        free = end
        if 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15:
            yield "phone", plus, end


def urls(text: str, schemes: list[tuple[int, int]]) -> Iterator[Span]:
    free, n = 0, len(text)
    for start, after in schemes:
        if start < free or start and text[start - 1].isalnum():
            continue
        end = after
        while end < n and text[end] not in URL_STOP:
            end += 1
        while end > after and text[end - 1] in ".,;:!?)]'":
            end -= 1
        if end > after and text[after].isalnum():
            yield "url", start, end
            free = end


def _after_fillers(text: str, at: int, most: int = 24) -> int:
    """The place behind separators and filler words."""
    n, first = len(text), at
    while at < n and at - first < most:
        if text[at] in " \t:#=.-":
            at += 1
            continue
        end = at
        while end < n and text[end].isalpha() and end - at < 8:
            end += 1
        if text[at:end].lower() not in FILLERS or end < n and text[end].isdigit():
            break
        at = end
    return at


def _iban(text: str, at: int) -> int:
    """Where the longest IBAN that begins here ends, or ``at``."""
    n, end, best, clean = len(text), at, at, ""
    while end < n and len(clean) < 34:
        c = text[end]
        if c in " -" and clean and end + 1 < n and text[end + 1] in HOST and text[end - 1] not in " -":
            end += 1
            continue
        if not (c.isascii() and c.isalnum()):
            break
        clean += c.upper()
        end += 1
        whole = end == n or not text[end].isalnum()
        if whole and len(clean) >= 15 and int("".join(str(int(d, 36)) for d in clean[4:] + clean[:4])) % 97 == 1:
            best = end
    return best


def accounts(text: str, cues: list[tuple[int, int]]) -> Iterator[Span]:
    free, n = 0, len(text)
    for start, after in cues:
        if start < free or start and text[start - 1].isalnum() or after < n and text[after].isalpha():
            continue
        at = _after_fillers(text, after)
        head = text[at : at + 4]
        if len(head) == 4 and head[:2].isascii() and head[:2].isalpha() and head[2] in DIGITS and head[3] in DIGITS:
            end = _iban(text, at)
            if end > at:
                yield "account", at, end
                free = end
                continue
            if text[start:after].lower() == "iban":
                continue
        end = at
        while end < n and (text[end] in HOST or text[end] == " " and end + 1 < n and text[end + 1] in DIGITS):
            end += 1
        while end > at and text[end - 1] in " -":
            end -= 1
        found = text[at:end]
        if end - at >= 6 and sum(c in DIGITS for c in found) >= 4 and all(any(c in DIGITS for c in g) for g in found.split(" ")):
            yield "account", at, end
            free = end


def find_spans(text: str, anchors) -> list[Span]:
    """Every span, by kind as listed in KINDS, then start."""
    at: dict[str, list] = {"at": [], "digit": [], "plus": [], "scheme": [], "cue": []}
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lower-cased; only ASCII matters to the anchors
        low = "".join(c.lower() if c.isascii() else c for c in text)
    for end, (kind, size) in anchors.iter(low):
        at[kind].append(end if size == 1 else (end + 1 - size, end + 1))
    runs = digit_runs(at["digit"])
    schemes, cues = sorted(at["scheme"], key=lambda x: (x[0], -x[1])), sorted(at["cue"], key=lambda x: (x[0], -x[1]))
    return [*emails(text, at["at"]), *ips(text, runs), *cards(text, runs), *phones(text, at["plus"]), *urls(text, schemes), *accounts(text, cues)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


SCHEMA = pa.schema([("_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("masked", pa.string())])


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones together, replaced by the kind of the earliest."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _scan(with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()

        def one(i, text: str) -> tuple:
            spans = find_spans(text, anchors)
            order = [KINDS.index(s[0]) for s in spans]
            base = spans[: bisect_left(order, len(BASE))]
            return i, *(sum(s[0] == k for s in base) for k in BASE), sha256_hex(joined(base).encode()), joined(spans), mask(text, spans) if with_text else None

        for batch in it:
            yield from batches((one(*row) for row in zip(batch.column(0).to_pylist(), as_text(batch.column(1)), strict=True)), SCHEMA, 2048)

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, masked: bool = True) -> DataFrame:
    """Per row: id, counts of base kinds, base_sha256, all spans and, if asked for, the masked text."""
    src = two(docs, id_col, text_col)
    ddl = "_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string"
    return src.select(src["_id"].cast("long").alias("_id"), "_text").mapInArrow(_scan(masked), ddl).withColumnRenamed("_id", id_col)
