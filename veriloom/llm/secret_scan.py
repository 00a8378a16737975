"""Secret scans with structural confirmation.

Assignments, access ids and long hex runs are base spans. Beyond these, long base64 and hex runs and dotted tokens are
candidates only: a candidate is reported when its decoded bytes prove to be what they look like. DER key encodings
must nest exactly, each length ending where its parent says, and hold the fields of a private key; the binary key
container must have all its length-prefixed fields; a signed token needs a JSON header that names an algorithm, a
JSON body and a signature of the algorithm's size; a decoded text must itself hold a base secret.

The floor of a candidate is the least that can be confirmed: ten bytes of an encrypted key, SHORTEST characters of
base64. Within a run, tokens are tried at every start of a JSON object, decoding at every part between dots and equals
signs, and there from every slash to the next one and to the part's end. A part is decoded once for each of the four
ways in which its characters can fall into groups, and what starts at a slash is looked at there: of a key only the
lengths that it states, of text the longest end that is text. So the work grows with the run, not with its square.
Encodings within encodings are followed as deep as they go: each is a quarter shorter than the one around it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import small_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "signed_token", "der_key", "key_container", "encoded_secret", "encrypted_key")

_NAMES = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Candidates; the look-behinds keep one long run from being tried at each of its places.
SHORTEST = 14
RUN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
#: White space and slashes of a wrapped key may be escaped, as in JSON strings.
WRAPPED = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:[A-Za-z0-9+/=\s]|\\+[nrt/])+)-----END \1-----")
#: A key that is encrypted as a whole states how in header lines; its bytes fill whole blocks of the vector's size.
SEALED = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s+Proc-Type:\s*4,\s*ENCRYPTED\s+DEK-Info:\s*[A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s+([A-Za-z0-9+/=\s]+)-----END \1-----")
HEX_RUN = re.compile(r"(?:[0-9a-f]{2}){10,}\Z|(?:[0-9A-F]{2}){10,}\Z")
#: Base64 of an opening brace and a quote or white space.
HEAD = re.compile(r"e(?:y[A-DI-L]|w[k-r0-3])")
PART = re.compile(r"[^.]+")
PIECE = re.compile(r"[^.=]+={0,2}")
URL_SAFE = re.compile(r"[A-Za-z0-9_-]+={0,2}")
_SPACE = re.compile(r"\s+|\\+[nrt]|\\+(?=/)")
#: Fixed sizes of the signatures of signed tokens, by algorithm name.
SIGNATURES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114), "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024), "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024)}
#: The first field of the binary private key container.
CONTAINER = b"openssh-key-v1\x00"
ASCII = bytes(range(128))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of base secrets, leftmost and without overlap within a kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def decode64(run: str) -> bytes | None:
    """Bytes of a base64 run, of either alphabet, padded or not."""
    body = run.rstrip("=")
    if "=" in body or "." in body or len(body) % 4 == 1 or len(run) - len(body) > 2:
        return None
    if ("+" in body or "/" in body) and ("-" in body or "_" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, lo: int, hi: int) -> list[tuple[int, int, int]] | None:
    """tag, start and end of the values that fill data from lo to hi exactly; None if they don't."""
    items = []
    while lo < hi:
        if lo + 2 > hi:
            return None
        tag, n, at = data[lo], data[lo + 1], lo + 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > hi or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None
        if at + n > hi:
            return None
        items.append((tag, at, at + n))
        lo = at + n
    return items


def der_key(data: bytes) -> bool:
    """Whether data is a DER private key: PKCS#1, SEC1, PKCS#8 or encrypted PKCS#8, with all lengths nested."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_items(data, *top[0][1:])
    if not inner or any(tag == 0x30 and der_items(data, lo, hi) is None for tag, lo, hi in inner):
        return False
    tags = [t for t, _, _ in inner]
    if tags[0] == 0x02:
        version = int.from_bytes(data[inner[0][1] : inner[0][2]], "big")
        if version <= 1 and len(tags) >= 9 and all(t == 0x02 for t in tags[:9]):  # RSA
            return inner[1][2] - inner[1][1] >= 32
        if version == 0 and tags == [0x02] * 6:  # DSA
            return True
        if version == 1 and tags[1] == 0x04 and all(t in (0xA0, 0xA1) for t in tags[2:]):  # elliptic curve
            return inner[1][2] - inner[1][1] in (20, 24, 28, 32, 48, 66)
        if version <= 1 and tags[1:3] == [0x30, 0x04]:  # PKCS#8
            kind = der_items(data, *inner[1][1:])
            return bool(kind) and kind[0][0] == 0x06
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        kind = der_items(data, *inner[0][1:])
        return bool(kind) and [t for t, _, _ in kind] == [0x06, 0x30]
    return False


def key_container(data: bytes) -> bool:
    """Whether data is the binary private key container, with each length-prefixed field in place."""
    if not data.startswith(CONTAINER):
        return False
    at = len(CONTAINER)

    def field() -> int | None:
        """The size of the next field."""
        nonlocal at
        if at + 4 > len(data) or at + 4 + (n := int.from_bytes(data[at : at + 4], "big")) > len(data):
            return None
        at += 4 + n
        return n

    head = [field() for _ in range(3)]
    if None in head or at + 4 > len(data) or not head[0]:
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= (len(data) - at) // 4 and all(field() is not None for _ in range(keys)) and field() is not None and at == len(data)


def _object(part: str, at: int = 0) -> dict | None:
    """The JSON object that a base64 part encodes from a character on."""
    left = len(part) - at
    for size in (256, 4096, left):  # most of what only looks like one fails within its first characters
        data = decode64(part[at : at + size])
        try:
            made = json.loads(data) if data else None
        except json.JSONDecodeError as e:
            if size < left and (e.msg.startswith("Unterminated") or e.pos >= len(data) - 16):
                continue
            return None
        except UnicodeDecodeError as e:
            if size < left and e.start >= len(data) - 4:  # cut within a character
                continue
            return None
        except (ValueError, RecursionError):
            return None
        if size >= left:
            return made if isinstance(made, dict) else None
    return None


def _signed(head: dict | None, signature: str) -> bool:
    """Whether a header names an algorithm whose signatures have the size of this one."""
    if head is None or not isinstance(head.get("alg"), str) or not (data := decode64(signature) if signature else None):
        return False
    low, high = SIGNATURES.get(head["alg"], (1, 0))
    return low <= len(data) <= high


def confirm(data: bytes | None) -> str | None:
    """The kind of secret that decoded bytes prove to be; text may itself hold encoded runs, and these may again."""
    if not data:
        return None
    if data[0] == 0x30 and der_key(data):
        return "der_key"
    if key_container(data):
        return "key_container"
    if data.isascii():
        inner = data.decode()
        if base_spans(inner) or any(decoded_kind(m[0].rstrip(".")) for m in RUN.finditer(inner)):
            return "encoded_secret"
    return None


def token_spans(run: str) -> list[tuple[int, int]]:
    """Start and end of the signed tokens within a run, whatever stands before and behind them."""
    parts, found, at = [(m.start(), m[0]) for m in PART.finditer(run)], [], 0
    for (a, x), (b, y), (c, z) in zip(parts, parts[1:], parts[2:]):
        if a < at or b != a + len(x) + 1 or c != b + len(y) + 1 or _object(y) is None:
            continue
        short = m[0] if (m := URL_SAFE.match(z)) else z
        for k in dict.fromkeys((0, *(m.start() for m in HEAD.finditer(x)))):
            head = _object(x, k)
            if (end := next((e for e in dict.fromkeys((z, short)) if _signed(head, e)), None)) is not None:
                at = c + len(end)
                found.append((a + k, at))
                break
    return found


def decoded_kind(run: str) -> str | None:
    """The kind of secret that a whole run encodes."""
    if len(run) < SHORTEST:
        return None
    return (HEX_RUN.match(run) and confirm(bytes.fromhex(run))) or confirm(decode64(run))


class _Ends:
    """Decodings of what is left of a base64 part from any of its characters on."""

    def __init__(self, part: str):
        self.part, self.made = part, {}
        self.plain, self.url = (max(part.rfind(c) for c in cs) for cs in ("+/", "-_"))

    def kind(self, at: int) -> str | None:
        """The kind of secret that the part's end from a character on encodes. A text is searched once for each grouping,
        from the first place asked for on."""
        if len(self.part) - at < SHORTEST or (self.plain >= at and self.url >= at):
            return None
        way = at % 4
        if way not in self.made:
            data = decode64(self.part[way:].replace("-", "+").replace("_", "/"))
            high = len(data.rstrip(ASCII)) - 1 if data else -1
            self.made[way] = [data, high, False]
        data, high, searched = self.made[way]
        lo = (at - way) // 4 * 3
        if not data or lo >= len(data):
            return None
        if data[lo] == 0x30 and _whole(data, lo) or data.startswith(CONTAINER, lo):
            return confirm(data[lo:])
        if high < lo and not searched:
            self.made[way][2] = True
            return confirm(data[lo:])
        return None


def _whole(data: bytes, lo: int) -> bool:
    """Whether the value that starts at lo states just the length that is left."""
    head = data[lo : lo + 6]
    if len(head) < 2:
        return False
    n, k = head[1], 0
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or len(head) < 2 + k:
            return False
        n = int.from_bytes(head[2 : 2 + k], "big")
    return lo + 2 + k + n == len(data)


def encoded_spans(run: str) -> list[tuple[str, int, int]]:
    """kind, start and end of what is encoded in a run or in its parts."""
    found = []
    for m in PIECE.finditer(run):
        at, piece = m.start(), m[0]
        end = at + len(piece)
        bare = at + len(piece.rstrip("="))
        ends = _Ends(run[at:bare])
        while bare - at >= SHORTEST:
            to = end if end == len(run) or (end - at) % 4 == 0 else bare  # else a name and its equals sign
            slash = run.find("/", at, end)
            kind = decoded_kind(run[at:bare]) if at == m.start() or slash < 0 else ends.kind(at - m.start())
            if kind:
                found.append((kind, at, to))
                break
            if slash < 0:
                break
            if at < slash and (kind := decoded_kind(run[at:slash])):
                found.append((kind, at, slash))
            at = slash + 1
    return found


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by kind; code points, end exclusive."""
    found = base_spans(text)
    for m in RUN.finditer(text):
        run, at = m[0].rstrip("."), m.start()
        tokens = token_spans(run) if run.count(".") >= 2 else []
        found += [("signed_token", at + a, at + b) for a, b in tokens]
        found += [(k, at + a, at + b) for k, a, b in encoded_spans(run) if not any(a < hi and lo < b for lo, hi in tokens)]
    if "-----BEGIN " in text:
        for m in WRAPPED.finditer(text):
            if (kind := confirm(decode64(_SPACE.sub("", m[2])))) and "PUBLIC" not in m[1]:
                found = [x for x in found if x[0] in BASE or not m.start() <= x[1] < m.end()]
                found.append((kind, *m.span()))
        for m in SEALED.finditer(text):
            data = decode64(_SPACE.sub("", m[3]))
            if data and len(data) >= 16 and len(data) % (len(m[2]) // 2) == 0:
                found = [x for x in found if x[0] in BASE or not m.start() <= x[1] < m.end()]
                found.append(("encrypted_key", *m.span()))
    place = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda x: (x[1], place[x[0]], x[2]))


def scan_secrets(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and spans, an array of kind, start and end, for the whole text of each row; null is empty.

    Rows are independent, so that repeated rows give repeated results. Spans come by start; of several kinds that start
    at one place, the first in the order of KINDS stands first.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind string, start bigint, end bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(t or "")] for t in batch], dtype=object)

    return docs.select(*keep, run(F.col("text")).alias("spans"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Query: counts and digest of base spans and all spans of every document."""
    from veriloom.llm.common import table

    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x.kind.isin(*BASE))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
