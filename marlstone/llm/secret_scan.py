"""Secret scans: three base patterns, and sliding-window Shannon entropy by character class with an allow-list.

Candidates are runs of at least WINDOW token characters.  In each run the entropy of every window of WINDOW
characters is followed by counts that change by two characters a step.  The class of a run (digits, hexadecimal, letters
of one case, letters of both cases, letters and digits) has a limit of its own; a run with a window that reaches it is a
span as a whole.  Runs that the allow-list matches (words and numbers joined by marks, names of capitalised words,
UUIDs) are dropped, and so are spans inside a base span; base spans always stay.  Letters of one case count as words by
their shape alone: enough vowels, no long rows of consonants, few rare letters.

Defined cases: null and empty texts have no spans; very long texts and runs are scanned whole; positions count code points;
repeated rows are each scanned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from marlstone.llm.common import map_batches, str_texts

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
WINDOW = 24
_DIGITS, _UPPER, _LOWER = set("0123456789"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("abcdefghijklmnopqrstuvwxyz")
_HEX_DIGITS = _DIGITS | set("abcdefABCDEF")
#: Bits a character that a window of a class must reach; 24 random characters of a class mostly do.
LIMITS = {"digits": 2.9, "hex": 3.0, "one case": 3.6, "letters": 4.1, "mixed": 3.9}
_PART = "(?:[A-Z]?[a-z]+[0-9]{0,3}|[A-Z]+[0-9]{0,3}|[0-9]{1,17}|v[0-9.]+)"
_ALLOWED = (
    re.compile(rf"[-_/+]*(?:{_PART}(?:[-_/+]+{_PART})*)?[-_/+]*=*\Z"),  # words and numbers joined by marks, rules
    re.compile(r"(?i:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})\Z"),  # UUIDs
)
_VOWELS, _RARE = frozenset("aeiouyAEIOUY"), frozenset("jkqwxzJKQWXZ")
_CONSONANTS = re.compile(r"[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+")
#: Shape of words: least share of vowels, most consonants in a row, greatest share of rare letters, and letters of a part between marks.
LEAST_VOWELS, MOST_CONSONANTS, MOST_RARE, MOST_PART = 0.26, 7, 0.13, 14
_CAPITALISED = re.compile(r"[a-z]*(?:[A-Z][a-z]+|[A-Z]+(?=[A-Z][a-z]|[0-9]|\Z))+[0-9]{0,3}\Z")
_GAIN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then by the order of KINDS."""
    spans: list[tuple[int, int, str]] = []
    if _ASSIGN_HINT.search(text):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def window_entropies(run: str, width: int = WINDOW) -> Iterator[float]:
    """Shannon entropy of each window, by counts that are updated for the character that leaves and the one that comes."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of n log2 n
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += _GAIN[n + 1] - _GAIN[n]
        counts[c] = n + 1
        if i >= width:
            old = run[i - width]
            n = counts[old]
            total += _GAIN[n - 1] - _GAIN[n]
            counts[old] = n - 1
        if i >= width - 1:
            yield math.log2(width) - total / width


def _class(run: str) -> str | None:
    """The class of a run; None for marks alone."""
    held = set(run)
    digits, upper, lower = (not held.isdisjoint(x) for x in (_DIGITS, _UPPER, _LOWER))
    if digits and not (upper or lower):
        return "digits"
    if digits and not (held & _UPPER and held & _LOWER) and held <= _HEX_DIGITS:
        return "hex"
    if digits:
        return "mixed"
    if upper and lower:
        return "letters"
    return "one case" if upper or lower else None


def _wordlike(run: str) -> bool:
    """Whether the letters of a run of one case look like words; short parts between marks need vowels alone."""
    parts = re.findall("[A-Za-z]+", run)
    letters = "".join(parts)
    vowels = sum(c in _VOWELS for c in letters) / len(letters)
    if len(parts) > 2 and max(map(len, parts)) <= MOST_PART:
        return vowels >= LEAST_VOWELS
    rows = max((len(m) for m in _CONSONANTS.findall(run)), default=0)
    return vowels >= LEAST_VOWELS and rows <= MOST_CONSONANTS and sum(c in _RARE for c in letters) <= MOST_RARE * len(letters)


def _allowed(run: str, kind: str) -> bool:
    """Names of capitalised words have few capitals."""
    if kind == "one case":
        return _wordlike(run)
    if any(p.match(run) for p in _ALLOWED):
        return True
    return 4 * sum(c in _UPPER for c in run) <= len(run) and _CAPITALISED.match(run) is not None


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Runs with a window at their class's limit, allow-listed ones left out."""
    spans = []
    for m in _RUN.finditer(text):
        run, at = m[0], m.start()
        kind = _class(run)
        if kind is None or _allowed(run, kind):
            continue
        limit = LIMITS[kind] - 1e-9
        if any(bits >= limit for bits in window_entropies(run)):
            spans.append((at, m.end(), "entropy"))
    return spans


def find_secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans); an entropy span inside a base span adds nothing and is dropped."""
    base = base_spans(text)
    extra = entropy_spans(text)
    if not extra:
        return base, base
    kept, at, furthest = [], 0, 0
    for s in extra:  # both lists go by start: one sweep with the furthest end of the base spans that begin no later
        while at < len(base) and base[at][0] <= s[0]:
            furthest = max(furthest, base[at][1])
            at += 1
        if s[1] > furthest:
            kept.append(s)
    return base, sorted(base + kept, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, merged where they overlap, replaced by mark."""
    out, at = [], 0
    for start, end, _ in find_secrets(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for each row."""

    def start():
        def each(batch):
            found = [find_secrets(t) for t in str_texts(batch.column("text"))]
            count = lambda kind: [sum(s[2] == kind for s in b) for b, _ in found]
            yield {
                "doc_id": batch.column("doc_id"),
                "n_assign": count("assign"),
                "n_access": count("access"),
                "n_hex": count("hex"),
                "base_sha256": [hashlib.sha256(join_spans(b).encode()).hexdigest() for b, _ in found],
                "spans": [join_spans(a) for _, a in found],
            }

        return each

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", start)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text masked and n_chars set to the new length; null texts stay null, with a null n_chars.

    Empty texts stay empty; repeated rows are each masked; an empty table stays empty; columns of any name are kept as they are."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    names = docs.columns

    def start():
        def each(batch):
            texts = [t if t is None else redact(t) for t in batch.column("text").to_pylist()]
            new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
            yield {n: new.get(n, batch.column(n)) for n in names}

        return each

    fields = [StructField(f.name, {"text": StringType(), "n_chars": LongType()}.get(f.name, f.dataType)) for f in docs.schema]
    ddl = StructType(fields).toDDL()
    return map_batches(docs, ddl, start)
