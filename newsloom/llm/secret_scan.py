"""Secrets in texts: fixed patterns, and literals assigned to sensitive names.

Lines that look like source or configuration are lexed into names, literals and
operators; assignments give name-literal pairs, names stand for the literals last
assigned to them, joined literals for their concatenation. A literal is scored by
the most sensitive name it reaches and by its own form.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import mapped, slices

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of names, and how sensitive a literal of that name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "api_key": 1.0, "accesskey": 1.0, "access_key": 1.0, "privatekey": 1.0, "private_key": 1.0, "credential": 0.9,
    "auth": 0.6, "bearer": 0.8, "signingkey": 0.9, "signing_key": 0.9, "encryption_key": 0.9, "connectionstring": 0.7,
    "connection_string": 0.7, "client_key": 0.8,
}
#: Parts of names that say the literal is not the secret itself.
HARMLESS = ("_path", "_file", "_url", "_uri", "_name", "_type", "_length", "_field", "_header", "_count", "_id")
#: Literals that stand for a value to be filled in.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "xxxxxx", "your"}
MIN_LITERAL, MIN_SCORE = 6, 0.75
#: A name whose weight is below MIN_SCORE is reached by literals of this form score.
MIN_FORM = 0.9
MASK = "[SECRET]"

_CLUE = re.compile(r"pass(?:word|wd|phrase)|pwd|secret|token|key|credential|auth|bearer|connection_?string", re.IGNORECASE)
_LEX = re.compile(
    r"""(?P<long>\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})"""
    r"""|(?P<block>(?<=:\x20)[|>][+\-\d]{0,2}[ \t]*\n(?P<pad>[ \t]+)\S[^\n]*(?:\n(?P=pad)[^\n]*)*)"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<name>[^\W\d][\w.\-]*(?:\[["']?\w+["']?\])?)"""
    r"""|(?P<bare>\d[\w+/\-.]*)"""
    r"""|(?P<assign>:=|=>|=(?!=)|:(?!:))"""
    r"""|(?P<plus>\+)|(?P<end>[\n;,{}()])|(?P<other>\S)"""
)

#: "auth" where it isn't part of author, authority or authentic; names whose values hold blanks.
_AUTH = re.compile(r"auth(?!or(?!i[sz])|entic(?!ation))")
_WORDY = re.compile(r"pass_?phrase|connection_?string")
#: The rest of a bare value: signs other than operators and separators, and what follows them.
_MORE = re.compile(r"(?:[!#$@%^*~?][\w!#$@%^*~?/.\-]*)?")

_NAME = re.compile(r"[\w.\-]+")
_LINE = re.compile(r"[^\s](?:[^\n]*[^\s])?")
_ASSIGNED = re.compile(r"\s*(?:=(?!=)|:)")
#: Fields that name a setting, and fields that hold its value.
_NAME_FIELDS, _VALUE_FIELDS = {"key", "name"}, {"value", "val"}
#: Calls that read or ask for a secret are given its name, not the secret.
_ASKS = re.compile(r"(?:.*\.)?(?:get|fetch|load|read|find|lookup|is|has|check|env|test|print|log)", re.IGNORECASE)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three fixed patterns, sorted by start, then kind."""
    found = []
    low = text.lower()
    if any(key in low for key in _KEYS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _lowered(name: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower().replace("-", "_").replace(".", "_")


def _weight(low: str) -> float:
    tight = low.replace("_", "")
    return max(
        [
            v for k, v in SENSITIVE.items()
            if (k in low or k.replace("_", "") in tight) and (k != "auth" or _AUTH.search(low))
        ],
        default=0.0,
    )


def sensitivity(name: str) -> float:
    """0 to 1: how much a name says that its value is secret."""
    low = _lowered(name)
    return _weight(low) * (0.3 if low.endswith(HARMLESS) else 1.0)


def least_score(name: str) -> float:
    """What a literal of that name must score; literals of every listed name can."""
    return min(MIN_SCORE, MIN_FORM * _weight(_lowered(name)) or MIN_SCORE)


def literal_score(value: str, name: str) -> float:
    """Sensitivity of the target name, lowered for values that look like words or blanks."""
    core = value.strip()
    if len(core) < MIN_LITERAL or core.lower() in PLACEHOLDERS or len(set(core)) < 4:
        return 0.0
    blanks = core.count(" ")
    if core.startswith(("${", "{{", "<", "%(", "$(")) or blanks > 1 and not _WORDY.search(_lowered(name)):
        return 0.0
    counts = Counter(core)
    n = sum(counts.values())
    spread = -sum(c / n * math.log2(c / n) for c in counts.values())
    mixed = any(c.isdigit() for c in core) + any(c.isupper() for c in core) + any(not c.isalnum() for c in core)
    return sensitivity(name) * min(1.0, 0.55 + 0.1 * mixed + 0.08 * spread) * max(0.92, 1 - 0.02 * max(0, blanks - 1))


def pairs(text: str) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(name, value, spans of the literals it is made of) of every assignment.

    A value is one literal, a name assigned before, or a sum of these. A bare
    value (``name=abc123``) counts when it holds a digit, a quoted one always. A
    literal may have three quotes or be an indented block after ``name: |`` or
    ``name: >``. Where one field names a setting and the next gives its value
    (``key="password" value="..."``), the value belongs to that name; literals and
    names passed to ``name(...)``, unless it reads or asks, belong to the called name.
    """
    known: dict[str, tuple[str, list[tuple[int, int]]]] = {}
    out = []
    target, parts, wants, before = None, [], False, None
    setting, called = None, None

    def close():
        nonlocal target, parts, setting
        if target is not None and parts:
            value = "".join(v for v, _ in parts)
            spans = [s for _, own in parts for s in own]
            known[target] = (value, spans)
            out.append((target, value, spans))
            field = target.lower()
            if field in _VALUE_FIELDS and setting is not None:
                out.append((setting, value, spans))
            setting = value if field in _NAME_FIELDS and _NAME.fullmatch(value) else None
        target, parts = None, []

    for m in _LEX.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind == "assign":
            if before is not None:
                if target is not None and parts:
                    # chained: a = b = "literal"; or the next "name:" on one line
                    parts = [] if token != ":" and parts[-1][0] == known.get(before, (None,))[0] else parts
                    close()
                target, parts, wants = before, [], True
            before = None
            continue
        if kind == "block":
            if wants:
                start = m.start("pad")
                lines = [(start + a.start(), start + a.end()) for a in _LINE.finditer(text[start : m.end()])]
                parts.append(("".join(text[a:b] for a, b in lines), lines))
            close()
            wants, before, called = False, None, None
            continue
        if kind in ("string", "long"):
            quotes = 3 if kind == "long" else 1
            value, span = token[quotes:-quotes], (m.start() + quotes, m.end() - quotes)
            if wants:
                parts.append((value, [span]))
                wants = False
            elif target is not None:
                close()
            elif called is not None:
                out.append((called, value, [span]))
            before = value if _NAME.fullmatch(value) else None
            continue
        if kind in ("name", "bare"):
            if wants:
                whole = token + _MORE.match(text, m.end()).group()
                if kind == "name" and token in known:
                    parts.append(known[token])
                    wants = False
                elif any(c.isdigit() for c in whole) and len(whole) >= MIN_LITERAL:
                    parts.append((whole, [(m.start(), m.start() + len(whole))]))
                    wants = False
                else:
                    if kind == "name" and target.lower() in _NAME_FIELDS:
                        setting, target = token, None
                    wants = False
            elif target is not None:
                close()
            elif called is not None and token in known and not _ASSIGNED.match(text, m.end()):
                out.append((called, *known[token]))
            before = token if kind == "name" else None
            continue
        if kind == "plus" and target is not None and parts:
            wants = True
            continue
        close()
        # an argument list begins right behind a name and ends with its bracket or statement
        if token == "(":
            called = before if text[m.start() - 1 : m.start()].isalnum() and before and not _ASKS.match(before) else None
        elif token in ");{}":
            called = None
        if token in "}>":
            setting = None
        wants, before = False, None
    close()
    return out


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, through constants and sums."""
    best: dict[tuple[int, int], float] = {}
    if not _CLUE.search(text) or not any(sign in text for sign in "=:("):
        return []
    for name, value, spans in pairs(text):
        score = literal_score(value, name)
        for span in spans if score >= least_score(name) else []:
            best[span] = max(score, best.get(span, 0))
    return [(a, b, "literal") for (a, b) in sorted(best) if b > a]


def _covered(start: int, end: int, base: list[tuple[int, int, str]]) -> bool:
    """Whether the spans of ``base``, sorted by start, together hold all of [start, end)."""
    for a, b, _ in base:
        if a <= start < b:
            start = b
    return start >= end


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans: the fixed patterns, and the literals that reach beyond them."""
    base = base_spans(text)
    more = [s for s in literal_spans(text) if not _covered(s[0], s[1], base)]
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scanned(batches):
    for part in slices(batches):
        rows = [[] for _ in range(5)]
        for text in part.column(1).to_pylist():
            spans = scan(text or "")
            base = [s for s in spans if s[2] != "literal"]
            counts = Counter(kind for _, _, kind in base)
            digest = hashlib.sha256(_listed(base).encode()).hexdigest()
            for out, value in zip(rows, (counts["assign"], counts["access"], counts["hex"], digest, _listed(spans))):
                out.append(value)
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *[pa.array(v, t) for v, t in zip(rows, types)]],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end in code points, end exclusive, by start, then
    kind; base_sha256 is the digest of that list without the lexed literals. A
    null text counts as empty; rows with null or repeated ids are scanned like any
    other; other columns are not read.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return mapped(
        source, _scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def masked(text: str) -> str:
    """``text`` with every span, overlapping ones merged, replaced by a mask."""
    out, at = [], 0
    for start, end, _ in scan(text):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def _masked(text_at: int, chars_at: int | None):
    def run(batches):
        for part in slices(batches):
            texts = [None if t is None else masked(t) for t in part.column(text_at).to_pylist()]
            arrays = list(part.columns)
            if chars_at is not None:
                counts = [
                    old if new == was or new is None else len(new)
                    for old, was, new in zip(part.column(chars_at).to_pylist(), part.column(text_at).to_pylist(), texts)
                ]
                arrays[chars_at] = pa.array(counts, part.schema.field(chars_at).type)
            arrays[text_at] = pa.array(texts, part.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names)
    return run


def mask_secrets(docs: DataFrame, text_column: str = "text", chars_column: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; every row and column stays, and
    n_chars, where there is one, follows a changed text. Null texts stay null."""
    chars = docs.columns.index(chars_column) if chars_column in docs.columns else None
    return mapped(docs, _masked(docs.columns.index(text_column), chars), docs.schema)
