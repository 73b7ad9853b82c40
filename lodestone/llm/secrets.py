"""Secret scans: an assignment-aware lexer beside three plain patterns.

The plain patterns find values behind a few fixed names, access key ids and long
hexadecimal runs.  The lexer reads source and configuration syntax as pairs of a
name and a literal or another name (``name = "literal"``, ``name: literal``,
``name => 'literal'``, ``"name": "literal"``, ``name: Type = b"literal"``), propagates constants (a literal
bound to a harmless name counts when that name is later assigned to a sensitive
one, through any number of names), and scores each literal by the name it
reaches and by its own shape.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds of span in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "lexed")
#: Literals of a score of at least this are reported.
THRESHOLD = 1.0
#: What replaces a secret.
MASK = "[SECRET]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

_HINTS = ("passw", "secret", "token", "api")
#: Words of a name that make its value sensitive, with their weights.
_NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.8, "pass": 0.6, "secret": 1.0, "token": 0.8,
    "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "auth": 0.5, "bearer": 0.7, "key": 0.3, "private": 0.4,
    "access": 0.3, "api": 0.4, "signing": 0.4, "encryption": 0.4, "salt": 0.5, "session": 0.3, "client": 0.2,
}
_HARMLESS = {"id", "name", "url", "uri", "path", "file", "length", "len", "size", "count", "type", "field", "label", "hint", "policy", "expiry", "ttl"}
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%|changeme|change_me|example|placeholder|your[_-].*|none|null|true|false|todo|redacted)$", re.IGNORECASE)
_OPERATOR = re.compile(r"=>|:=|[:=]")
#: What may stand before the quote of a literal: a string prefix, two of three quotes.
_PREFIX = re.compile(r"""(?:[bBrRuUfFlLnN]{1,3}8?|[@$]{1,2}|b?r\#{1,8})?(?:""(?=")|''(?='))?(?=["'`])""")
_QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`((?:[^`\\\n]|\\.)*)`')
#: A type annotation without what stands in its brackets.
_TYPE = re.compile(r"[ \t]*(?:[&*?]|'\w+[ \t]+|(?:mut|dyn|const|readonly)[ \t]+)*[A-Za-z_][\w.:]*[?!*]?(?:[ \t]*[|&][ \t]*[A-Za-z_][\w.:]*[?!*]?)*[ \t]*")
_BEFORE_TYPE = re.compile(r"\b(?:var|const)[ \t]+([A-Za-z_]\w*)[ \t]+[*\[\]\w.]+[ \t]*\Z")
_BARE = re.compile(r"[^\s,;()\[\]{}\"'<>&|#`]+")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, in code points, by start."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _name_before(text: str, at: int, floor: int) -> str:
    """The name that ends before an operator at ``at``, not reaching below ``floor``."""
    end = at
    while end > floor and text[end - 1] in " \t":
        end -= 1
    if end > floor and text[end - 1] in "\"'`":
        end -= 1
    elif end > floor and text[end - 1] == "?" and text[at] == ":":  # an optional member
        end -= 1
    start = end
    while start > floor and text[start - 1] in _NAME_CHARS:
        start -= 1
    return text[start:end].strip(".-")


def _is_type(text: str) -> bool:
    """Whether all of a text is a type annotation, with any types in brackets."""
    depth, outer = 0, []
    for c in text:
        if c in "\n;":
            return False
        if c in "<[(":
            depth += 1
        elif c in ">])":
            depth -= 1
            if depth < 0:
                return False
        elif not depth:
            outer.append(c)
    return not depth and _TYPE.fullmatch("".join(outer)) is not None


def pairs(text: str) -> list[tuple[str, int, int, bool]]:
    """(name, start, end, quoted) of each assignment; spans are the literal's own.

    ``==``, ``!=``, ``<=``, ``>=``, ``::`` and ``://`` assign nothing.  A literal
    behind a type annotation (``name: Type = literal``, ``var name type = literal``)
    is given for the name too, and spans leave out string prefixes.  A bare value may hold further assignments (``a=b=c``); values are given by their
    places only, so that a long chain of them takes no more than its length.
    """
    out, floor, run, end = [], 0, 0, 0  # run, end: where the bare run that was read last ends, and the value in it
    typed = ("", 0)  # the last name before a colon, and where its type may begin
    for op in _OPERATOR.finditer(text):
        a, b = op.span()
        if a < floor:
            continue
        after, before = text[b : b + 1], text[a - 1 : a]
        if after in ("=", ":") or op.group() == ":" and text.startswith("//", b) or before in ("=", "!", "<", ">", ":") and before:
            continue
        names = [_name_before(text, a, floor)]
        if op.group() == ":":
            typed = (names[0], b)
        elif op.group() != "=>":
            if typed[0] and _is_type(text[typed[1] : a]):
                names.append(typed[0])
            elif names[0] and (m := _BEFORE_TYPE.search(text, max(floor, a - 128), a)):
                names.append(m.group(1))
            typed = ("", 0)
        names = [n for n in names if n and (n[0].isalpha() or n[0] == "_")]
        if not names:
            continue
        at = b
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        if m := _QUOTED.match(text, p.end() if (p := _PREFIX.match(text, at)) else at):
            k = m.lastindex
            out += [(n, m.start(k), m.end(k), True) for n in names]
            floor = m.end()
            typed = ("", 0)
            continue
        if at >= run and (m := _BARE.match(text, at)):
            run, end = m.end(), at + len(m.group().rstrip(".!?:"))
        if end > at:
            out += [(n, at, end, False) for n in names]
            floor = b
    return out


def name_score(name: str) -> float:
    """How sensitive a name's words make its value."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[-1] in _HARMLESS:
        return 0.0
    return min(1.5, sum(_NAME_WEIGHTS.get(p, 0.0) for p in parts))


def literal_score(value: str) -> float:
    """0 to 1 for a literal's own shape; negative for what cannot be a secret."""
    if len(value) < 8 or _PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return -2.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^A-Za-z0-9]", value))))
    return min(1.0, entropy / 8 + 0.15 * (classes - 1))


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """(start, end, "lexed") of literals that reach a sensitive name."""
    found = pairs(text) if "=" in text or ":" in text else []
    if not any(name_score(p[0]) > 0 for p in found):
        return []
    # Constants: the last literal bound to a name before it is read, as in straight-line code.
    bound: dict[str, tuple[int, int]] = {}
    scores: dict[tuple[int, int], float] = {}
    out, floor = set(), 0
    for name, start, end, quoted in found:
        if start < floor:
            continue
        literal = (start, end)
        is_name = not quoted and _IDENTIFIER.match(text, start, end)
        if is_name:
            literal = bound.get(text[start:end], literal)
        bound[name] = literal
        weight = name_score(name)
        if weight > 0 and not (is_name and literal == (start, end) and not any(c.isdigit() for c in text[start:end])):
            if literal not in scores:
                scores[literal] = literal_score(text[literal[0] : literal[1]])
            if weight + scores[literal] >= threshold:
                out.add((*literal, "lexed"))
                # what a reported literal holds is reported with it
                floor = max(floor, end if literal == (start, end) else 0)
    return sorted(out)


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of one text, by start and then by kind."""
    text = text or ""
    found = base_spans(text) + lexed_spans(text)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(found: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def redact(text: str | None, mask: str = MASK) -> str | None:
    """The text with each maximal run of overlapping spans replaced by ``mask``."""
    found = sorted((a, b) for a, b, _ in spans(text))
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        a, b = found[i]
        while i + 1 < len(found) and found[i + 1][0] < b:
            i += 1
            b = max(b, found[i][1])
        out += [text[at:a], mask]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


_SCAN = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex", "n_lexed")]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def _scan_batches(batches):
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["text"], strict=True):
            found = spans(text)
            count = Counter(kind for _, _, kind in found)
            base = listed(s for s in found if s[2] != "lexed")
            rows.append((doc_id, *(count[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), listed(found)))
        frame = pd.DataFrame(rows, columns=_SCAN.names)
        yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of the secrets of every row.

    Null texts count as empty; rows are read on their own, so repeated rows and
    null ids give their own rows, and an empty table gives an empty result.
    Other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_scan_batches, _SCAN)


def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; null texts stay null.

    ``n_chars``, if there is such a column, becomes the new text's length.
    """

    def masked(text: pd.Series) -> pd.Series:
        return text.map(lambda t: redact(t, mask), na_action="ignore")

    out = docs.withColumn("text", F.pandas_udf(masked, T.StringType())(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
