"""Operator 3, secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, checksum validation.

One automaton pass finds every keyword of every kind in the lower-cased text. A kind's expression is only tried at its
keyword's hits, anchored there, from left to right and never inside its own previous match, which gives exactly the
leftmost non-overlapping matches of a full scan. Kinds whose tokens embed a checksum are kept only if it holds. Runs of
hexadecimal digits have no keyword; they are the one kind that is scanned for directly.

Null text counts as empty; a text without a secret gives zero counts, empty ``spans`` and the digest of no bytes.
Repeated rows and ids give one row each. All positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .arrow import fresh, prepare, table

#: The base kinds, in the order in which spans of one start are listed.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
GITHUB = re.compile(r"gh[opsur]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: Up to the END line of the same label, header lines included, and never across another BEGIN line.
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY( BLOCK)?-----(?:(?!-----BEGIN ).){16,}?-----END \1PRIVATE KEY(?(2) BLOCK)-----", re.S)
#: Keys of file encryption (bech32) and extended private keys of wallets (base 58 with a digest).
AGE = re.compile(r"AGE-SECRET-KEY-1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![A-Z0-9])")
WALLET = re.compile(r"([xyzt]prv[1-9A-HJ-NP-Za-km-z]{107})(?![A-Za-z0-9])")
#: Digits of base 62 as these tokens use them, of base 58 and of bech32, and bech32's generator.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("gho_", "ghp_", "ghs_", "ghu_", "ghr_"),
    "npm": ("npm_",),
    "pem": ("-----begin ",),
    "age": ("age-secret-key-1",),
    "wallet": ("xprv", "yprv", "zprv", "tprv"),
}
KINDS = (*BASE, "github", "npm", "pem", "age", "wallet")


def base62_crc32(body: str) -> str:
    """The six base-62 digits of a token body's CRC-32, as the token ends with."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def _checksum(m: re.Match) -> bool:
    return base62_crc32(m[1]) == m[2]


def bech32_holds(prefix: str, data: str) -> bool:
    """Whether the last six digits are the checksum of those before and of the prefix, all in lower case."""
    check = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(BECH32.index, data)]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATOR):
            check ^= g if top >> i & 1 else 0
    return check == 1


def base58_holds(text: str, size: int) -> bool:
    """Whether the text is of ``size`` bytes whose last four begin the double SHA-256 of the others."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    if n >> 8 * size:
        return False
    raw = n.to_bytes(size, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


ANCHORED = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= MIN_ASSIGN),
    "access": (ACCESS, lambda m: len(m[0]) >= MIN_ACCESS),
    "github": (GITHUB, _checksum),
    "npm": (NPM, _checksum),
    "pem": (PEM, lambda m: True),
    "age": (AGE, lambda m: bech32_holds("age-secret-key-", m[1].lower())),
    "wallet": (WALLET, lambda m: base58_holds(m[1], 82)),
}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z alone, so that code point positions stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every secret, by start and then in the order of ``KINDS``."""
    if not text:
        return []
    found, over = [], dict.fromkeys(KEYWORDS, 0)
    for last, (kind, n) in automaton().iter(ascii_lower(text)):
        at = last + 1 - n
        if at < over[kind]:
            continue
        expression, valid = ANCHORED[kind]
        if m := expression.match(text, at):
            over[kind] = m.end()
            if valid(m):
                found.append((at, m.end(), kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping secrets replaced by ``mark``; null stays null."""
    if not text or not (found := find_secrets(text)):
        return text
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(redact, na_action="ignore")


def redacted(text: Column) -> Column:
    return _redact(text)


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])


@F.pandas_udf(T.ArrayType(_SPAN))
def _scan(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b, "kind": k} for a, b, k in find_secrets(t)])


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``docs`` with an array of ``(start, end, kind)`` more, under a name like ``out_col`` that is free; every column and row stays."""
    prepare(docs.sparkSession)
    return docs.withColumn(fresh(docs, out_col), _scan(F.col(text_col)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "secrets")
    kind = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(kind, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


QUERIES = {"op3_secret_scans": op3_secret_scans}
ORACLE: dict[str, str] = {}
