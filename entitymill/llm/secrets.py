"""Secret scans: keyword automaton first, anchored patterns near hits, then checksums.

An Aho-Corasick automaton over the lower-cased text finds every place where a
keyword stands; only there a pattern anchored at the hit runs. Tokens that carry
a checksum (fixed formats below) count only if it is right. Long hexadecimal runs
have no keyword; their own run pattern finds them.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.llm.common import free_name, map_texts

# Keywords, patterns and least lengths of the base kinds.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")

# Tokens whose last six characters are the CRC-32 of the ones between
# prefix and checksum, in base 62, padded with zeros.
CHECKED_PREFIXES = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
CHECKED_BODY = re.compile(r"[0-9A-Za-z]{36}(?![0-9A-Za-z])")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Order of kinds in results where two spans start at the same place.
KINDS = ["assign", "access", "hex", "checked"]

_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def base62_crc32(body: str) -> str:
    """Six base-62 digits of the CRC-32 of ``body``."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        a.add_word(word, ("assign", len(word)))
    a.add_word("akia", ("access", 4))
    for prefix in CHECKED_PREFIXES:
        a.add_word(prefix, ("checked", len(prefix)))
    a.make_automaton()
    return a


def find_spans(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then kind; end exclusive, in code points."""
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    free = {"assign": 0, "access": 0, "checked": 0}
    # Lower-casing only A-Z keeps every position. Keywords of one kind end in the
    # order in which they start, as none of them lies inside another.
    for last, (kind, size) in words.iter(text.translate(_LOWER)):
        start = last - size + 1
        if start < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                free[kind] = m.end()
                if m.end(1) - m.start(1) >= ASSIGN_LEAST:
                    found.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                free[kind] = m.end()
                if m.end() - start >= ACCESS_LEAST:
                    found.append((start, m.end(), kind))
        elif text[start : last + 1] in CHECKED_PREFIXES and (m := CHECKED_BODY.match(text, last + 1)):
            if base62_crc32(m[0][:30]) == m[0][30:]:
                free[kind] = m.end()
                found.append((start, m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans, mask: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones together, replaced by ``mask``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, counts by kind, spans and their digest.

    Null and empty texts have no spans (digest of the empty string); a null id is
    kept; repeated rows give repeated results; whole texts are scanned whatever
    their length; an empty table gives no rows. Further columns play no part.
    """

    def work():
        words = automaton()

        def scan(texts: list) -> dict:
            columns = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans")}
            for raw in texts:
                spans = find_spans((raw or b"").decode("utf-8", "replace"), words)
                kinds = [s[2] for s in spans]
                for k in KINDS:
                    columns[f"n_{k}"].append(kinds.count(k))
                base = joined(s for s in spans if s[2] != "checked")
                columns["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                columns["spans"].append(joined(spans))
            return columns

        return scan

    schema = "n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"
    return map_texts(docs, text_col, [id_col], schema, work)


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret in the text masked, and ``length_col``, if there is one,
    counted anew where the text changed. All rows and columns stay; null texts stay null."""
    clean = free_name(docs, "clean_text")

    def work():
        words = automaton()

        def mask(texts: list) -> dict:
            out = []
            for raw in texts:
                text = None if raw is None else raw.decode("utf-8", "replace")
                spans = find_spans(text, words) if text else []
                out.append(redacted(text, spans) if spans else text)
            return {clean: pa.array(out, pa.string())}

        return mask

    masked = map_texts(docs, text_col, docs.columns, f"{clean} string", work)
    changed = ~F.col(clean).eqNullSafe(F.col(f"`{text_col}`"))
    columns = []
    for f in docs.schema:
        column = F.col(f"`{f.name}`")
        if f.name == text_col:
            column = F.col(clean)
        elif f.name == length_col:
            column = F.when(changed, F.length(clean).cast(f.dataType)).otherwise(column)
        columns.append(column.alias(f.name))
    return masked.select(*columns)
