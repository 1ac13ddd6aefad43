"""Secret scans: credential parts, and the links between complementary parts of one scope."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import fresh

#: Characters between the ends of two parts that may belong together.
REACH = 200
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
#: Kinds whose finding stands alone; the others are weak and need a complement.
STRONG = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Weak parts: an account identifier, a token of mixed kinds, an endpoint (schemes of 32 characters at most, so that each
#: place of a text is tried in bounded time).
_ID = re.compile(r"""\b(?:client_?id|access_?key_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{4,})""", re.A | re.I)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""\b(?:[a-z][a-z0-9+.-]{0,31}://[^\s"'<>]+|(?:host|endpoint|server|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{3,})""", re.A | re.I)
_SCOPE_END = re.compile(r"\n[\x20\t]*\n")
_TO_HEX = bytes.maketrans(bytes(range(256)), bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256)))

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each strong kind, those too short dropped."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    if b"h" * 24 in text.encode("latin-1", "replace").translate(_TO_HEX):
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def _weak_spans(text: str, low: str) -> list[Span]:
    found: list[Span] = []
    if any(w in low for w in ("id", "key", "account", "user", "login")) and ("=" in text or ":" in text):
        found += [(m.start(), m.end(), "id") for m in _ID.finditer(text)]
    if "://" in text or any(w in low for w in ("host", "endpoint", "server", "region")):
        found += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    if any(c.isdigit() for c in text):
        found += [(m.start(), m.end(), "secret") for m in _TOKEN.finditer(text) if _mixed(m[0])]
    return found


def _apart(weak: list[Span], strong: list[Span]) -> list[Span]:
    """Weak spans that no strong span of the same role overlaps, by one sorted pass over each."""
    kept = []
    for role in ("id", "secret", "endpoint"):
        held = sorted(s for s in strong if ROLE[s[2]] == role)
        starts, furthest = [s[0] for s in held], list(accumulate((s[1] for s in held), max))
        for s in (w for w in weak if ROLE[w[2]] == role):
            k = bisect_left(starts, s[1])  # strong ones that begin before its end
            if not k or furthest[k - 1] <= s[0]:
                kept.append(s)
    return kept


#: What each kind of part is: an identifier, a secret or an endpoint.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}


def scan(text: str | None, reach: int = REACH) -> tuple[list[Span], list[tuple[Span, Span]]]:
    """Reported spans, by start then kind, and the links (identifier or endpoint, secret) found.

    A scope is a run of lines without a blank line between. The interval join links a secret to every identifier and
    endpoint of its scope that ends or starts within `reach` characters of it; parts that overlap are one text, so no
    link. Spans of a kind do not overlap: those in reach are two runs of their order. A strong part is always
    reported; a weak one only if a link holds it.
    """
    if not text:
        return [], []
    strong = base_spans(text)
    low = text.lower()
    weak = _apart(_weak_spans(text, low), strong)
    if not weak and len(strong) < 2:
        return sorted(strong, key=_order), []
    ends = [m.start() for m in _SCOPE_END.finditer(text)]
    spans = sorted(strong + weak, key=_order)
    links: list[tuple[Span, Span]] = []
    for kind in ("access", "id", "endpoint"):
        others = [s for s in spans if s[2] == kind]
        if not others:
            continue
        starts, stops = [o[0] for o in others], [o[1] for o in others]
        for secret in (s for s in spans if ROLE[s[2]] == "secret"):
            a, b, _ = secret
            near = others[bisect_left(stops, a - reach) : bisect_right(stops, a)] + others[bisect_left(starts, b) : bisect_right(starts, b + reach)]
            links += [(o, secret) for o in near if bisect_left(ends, o[0]) == bisect_left(ends, a)]
    held = {s for pair in links for s in pair}
    return sorted(strong + [s for s in weak if s in held], key=_order), links


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs with `secrets`: array of (kind, start, end, text), code points, end exclusive; and `links`.

    A null or empty text has none. Whole texts of any length; every row stays, repeated rows too; other columns are kept,
    but for those two names. An empty table gives an empty result.
    """

    @F.pandas_udf("secrets array<struct<kind string, start int, stop int, value string>>, links array<struct<part int, secret int>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        spans, pairs = [], []
        for text in texts:
            s, p = scan(text, reach)
            spans.append([{"kind": k, "start": a, "stop": b, "value": text[a:b]} for a, b, k in s])
            pairs.append([{"part": a[0], "secret": b[0]} for a, b in p])
        return pd.DataFrame({"secrets": spans, "links": pairs})

    (held,) = fresh(docs, "found")
    return docs.withColumn(held, found(docs["text"])).withColumns({"secrets": F.col(f"{held}.secrets"), "links": F.col(f"{held}.links")}).drop(held)


def redact(docs: DataFrame, reach: int = REACH, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every reported span of text replaced by the mask (overlaps merged); n_chars follows where there is one.

    A null text stays null, an empty one empty. Every row stays, repeated rows alike, and so do all other columns,
    whatever their names; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            spans, _ = scan(text, reach)
            if spans:
                parts, at = [], 0
                for start, stop, _kind in spans:
                    if start >= at:
                        parts += [text[at:start], mask]
                    at = max(at, stop)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    done = docs.withColumn("text", cleaned(docs["text"]))
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
