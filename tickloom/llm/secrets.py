"""Operator 8: secret scans with a guess-cost estimate for values in credential contexts.

Base spans come from three fixed patterns. The method adds values that stand in a credential context (a key word and a sign of
assignment, a bearer header, the password of a URL) and that are hard to guess: the cost of a value is the cheapest way to
put it together from words, dates, repeats, keyboard walks and brute-force spans, found by dynamic programming over its
positions. A value counts as a secret from 10**10 guesses on, if at least 10**5 of them are not for words: a value of words alone
(unfortunately, authentication-scheme, four words run together) may be long, but in running text it is language. A URL is
no secret, but the password in it may be one. Words are a short list of common parts of passwords, then the word pieces of a
tokenizer's vocabulary in its order, which follows their frequency.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tickloom.llm.common import parts, slices

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CONTEXT = re.compile(
    r"""(?:\b|_)(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?|client[_-]?secret)["']?\]?[ \t]*(?:=>|:=|[:=])[ \t]*["']?([^\s"'<>,;]{6,})"""
    r"""|\b(?i:authorization:[ \t]*bearer|authorization:[ \t]*basic|bearer)[ \t]+([A-Za-z0-9+/_.=~-]{12,})"""
    r"""|://[^\s/:@"']+:([^\s/@"']{6,})@""", re.A)
#: any text with a span has a match of this
_ANY = r"""(?i)(pass|pwd|secret|token|key|credential)[a-z]*["']?\]?[ \t]*(=>|:=|[:=])|AKIA|[0-9a-f]{32}|bearer[ \t]|authorization:[ \t]*basic[ \t]|://[^\s/:@"']+:[^\s/@"']+@"""

KINDS = ("assign", "access", "hex", "guess")

# Common parts of passwords, most common first.
_WORDS = (
    "password pass admin root user test guest login welcome letmein qwerty dragon monkey master shadow sunshine princess football baseball iloveyou trustno "
    "hello freedom whatever secret token key example changeme change default sample dummy placeholder null none true false your my the and for value string "
    "here insert replace local host server data base database dev prod demo temp public private summer winter spring autumn monday friday love money angel super star"
).split()
VOCABULARY = "byte_bpe_50k.json"
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in _ROWS for a, b in zip(row, row[1:])}
_DIGITS = frozenset("0123456789")
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_BRUTE = 1.0  # powers of ten for each character
_JOIN = 0.3  # for the order of parts, and for one sign between words
_SIGNS = frozenset("-_./:+ ")
SECRET = 10.0
UNKNOWN = 5.0
_EDGE = 16  # a part of a long run begins and ends this near to the run's ends
_PATH = re.compile(r"(?:~|\.{1,2}|[A-Za-z]:)?(?:[/\\][A-Za-z0-9_.-]+){2,}[/\\]?")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^\s/:@\"']*:([^\s/@\"']{6,})@)?")


@lru_cache(4)
def word_ranks(path: str) -> dict[str, int]:
    """Rank of each known word: common parts of passwords, then the vocabulary's pieces of three ASCII letters or more in their order."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks: dict[str, int] = {}
    for word in (*_WORDS, *(p.lstrip("\u0120").lower() for p in sorted(vocabulary, key=vocabulary.get))):
        if len(word) >= 3 and word.isascii() and word.isalpha():
            ranks.setdefault(word, len(ranks) + 1)
    return ranks


def _runs(value: str, same) -> Iterator[tuple[int, int]]:
    """(begin, end) of the longest runs in which ``same`` holds for each position with the one before."""
    begin = 0
    for j in range(1, len(value) + 1):
        if j == len(value) or not same(j):
            yield begin, j
            begin = j


def _cuts(begin: int, end: int, least: int) -> Iterator[tuple[int, int]]:
    """Parts of a run with ``least`` characters or more: all of them, but in a long run only those that begin and end near its ends."""
    short = end - begin <= 2 * _EDGE
    for i in range(begin, end - least + 1 if short else begin + _EDGE):
        for j in range(i + least if short else end - _EDGE, end + 1):
            yield i, j


def _parts(value: str, ranks: dict[str, int]) -> list[list[tuple[int, float, float]]]:
    """By end: (begin, cost, cost not for words) of the known parts of ``value``."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose small form is longer
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    plain = low.translate(_PLAIN)
    longest = max(map(len, ranks), default=0)
    out: list[list[tuple[int, float, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            if not plain[j - 1].isalpha():
                break
            word = plain[i:j]
            rank = min(ranks.get(word, math.inf), 2 * ranks.get(word[::-1], math.inf))
            if rank < math.inf:
                cost = math.log10(rank + 1) + 0.3 * (value[i:j] != low[i:j]) + 0.6 * (low[i:j] != word)
                out[j].append((i, cost, 0.0))
        if value[i] in _SIGNS:
            out[i + 1].append((i, _JOIN, 0.0))
        if (m := _DATE.match(value, i)):
            cost = 2.1 if m.end() - i == 4 else 4.6
            out[m.end()].append((i, cost, cost))
    steps = (
        (1.0, lambda j: low[j] == low[j - 1]),
        (1.3, lambda j: (low[j - 1], low[j]) in _NEXT or (low[j] in _DIGITS and low[j - 1] in _DIGITS and abs(ord(low[j - 1]) - ord(low[j])) == 1)),
    )
    for base, same in steps:
        for begin, end in _runs(low, same):
            for i, j in _cuts(begin, end, 3):
                cost = base + math.log10(j - i)
                out[j].append((i, cost, cost))
    for unit in (2, 3, 4):  # a unit repeated, such as abcabc
        for begin, end in _runs(low, lambda j: j < unit or low[j] == low[j - unit]):
            for i, j in _cuts(begin and begin - unit + 1, end, 2 * unit):
                cost = unit * _BRUTE + math.log10((j - i) / unit)
                out[j].append((i, cost, cost))
    return out


def guess_parts(value: str, ranks: dict[str, int] | None = None) -> tuple[float, float]:
    """(guesses for ``value``, the share of them not for words) as powers of ten: the least over all ways to split it into known parts
    and brute-force spans. Each part after the first costs a third of a power more, for the order of parts. Linear in the length.
    """
    known = _parts(value, word_ranks(public_tokenizers.path(VOCABULARY)) if ranks is None else ranks)
    best = [(0.0, 0.0)]
    for j in range(1, len(value) + 1):
        cost, other = best[j - 1]
        least = (cost + _BRUTE, other + _BRUTE)
        for i, c, o in known[j]:
            least = min(least, (best[i][0] + c + (_JOIN if i else 0.0), best[i][1] + o))
        best.append(least)
    return best[-1]


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """Guesses for ``value`` as a power of ten, see ``guess_parts``."""
    return guess_parts(value, ranks)[0]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind; positions are code points, the end is exclusive."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def guess_spans(text: str, base: list[tuple[int, int, int]], least: float = SECRET, ranks: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """Values in credential contexts that take ``least`` powers of ten of guesses or more and lie in no base span."""
    out = []
    for m in _CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        if m.lastindex == 1 and (url := _URL.match(text, a, b)):
            if not url[1]:
                continue
            a, b = url.span(1)
        while b > a and text[b - 1] in ".,)]}":
            b -= 1
        if any(s <= a and b <= e for s, e, _ in base):
            continue
        value = text[a:b]
        for part in re.split(r"[/\\]", value) if _PATH.fullmatch(value) else [value]:  # a path is a secret if a name in it is
            cost, other = guess_parts(part, ranks)
            if cost >= least and other >= UNKNOWN:
                out.append((a, b, 3))
                break
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _scan(column: pa.Array, ranks: dict[str, int] | None = None) -> Iterator[tuple[str | None, list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(text, base spans, all spans) of each row; the text is given only where there are spans."""
    for a, b in slices(column, 1 << 22):
        part = column.slice(a, b - a)
        hit = pc.fill_null(pc.match_substring_regex(part, _ANY), False).to_numpy(zero_copy_only=False)
        for i in range(len(part)):
            if not hit[i]:
                yield None, [], []
                continue
            text = part[i].as_py()
            base = base_spans(text)
            both = sorted(base + guess_spans(text, base, ranks=ranks), key=lambda x: (x[0], x[2]))
            yield (text if both else None), base, both


def scan_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, base_spans) for every row of ``docs`` (doc_id, text).

    spans is an array of (kind, start, end) by start, then kind. A null or empty text has none, and its digest is that of the empty
    string. Very long texts and values are read whole, in linear time. Null ids and repeated rows give rows of their own; other columns
    are left out; an empty table gives no rows. ``vocabulary`` is the tokenizer file whose pieces are the known words.
    """
    ranks = word_ranks(vocabulary or public_tokenizers.path(VOCABULARY))  # at most as many as the file has pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digest, spans = [], [], []
            for _, base, both in _scan(batch.column(1), ranks):
                counts.append([sum(k == i for _, _, k in both) for i in range(4)])
                digest.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in both])
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[:, i]) for i in range(4)), pa.array(digest, pa.string()), pa.array(spans, schema)], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans array<struct<kind: string, start: long, `end`: long>>")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with every span of its column text replaced by ``mark`` (overlapping spans by one mark); other columns stay as they are.

    Null and empty texts and repeated rows stay; very long texts are read whole; an empty table gives no rows.
    """
    ranks = word_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole, at)):
            column = batch.column(at)
            out = None
            for i, (text, _, both) in enumerate(_scan(column, ranks)):
                if not both:
                    continue
                if out is None:
                    out = column.to_pylist()
                left, end = [], 0
                for s, e, _ in both:
                    if s >= end:
                        left += [text[end:s], mark]
                    end = max(end, e)
                out[i] = "".join(left) + text[end:]
            yield batch if out is None else batch.set_column(at, batch.schema.field(at), pa.array(out, column.type))

    return docs.mapInArrow(run, docs.schema)
