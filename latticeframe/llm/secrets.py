"""Secret scan with structural confirmation.

Patterns find the base spans (assigned credentials, access key ids, hex runs). Beyond them, base64 and hex candidates
are decoded and reported only where their structure parses: DER key encodings whose nested lengths add up, OpenSSH
key blobs with length-prefixed fields, PEM blocks around either (with real or escaped line ends, or with the headers of
an encrypted body), and signed tokens whose header is JSON that names an algorithm; a token is tried at every dotted
part. A key is looked for at every place of a run at which one can begin, and over lines of one width; base64 of a PEM
block is scanned once more. Positions are code points, ends exclusive.

Null and empty texts have no spans. Rows are independent: repeated rows repeat their result, and rows without an id are
scanned like others. Texts are scanned whole, in time that goes with their length. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import Sink, rows_of

# The base patterns, their least lengths, and the kinds in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
SSH_KINDS = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")

HINTS = ("password", "passwd", "secret", "token", "api")
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/]++={0,2})+")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/]+={0,2}")
#: Where a key can begin in base64 (a DER sequence, an SSH blob, the magic of an OpenSSH key, a PEM block) and in hex.
BASE64_START = re.compile(r"M[A-I]|AAAA[AB]|b3BlbnNzaC1rZXk|LS0tLS1CRUdJTi")
HEX_START = re.compile(r"30(?:[0-7][0-9A-Fa-f]|8[12])|000000(?:07|0[bB]|13)7373682[dD]|000000136563|6[fF]70656[eE]7373682[dD]")
LEAST_BASE64, LEAST_HEX = 40, 64
#: First bytes of a DER key: a sequence that begins with the number 0 or 1, or with a sequence that names an algorithm.
KEY_HEAD = re.compile(rb"(\x30(?:([\x00-\x7f])|\x81([\x80-\xff])|\x82([\x01-\xff][\x00-\xff])))(?:\x02\x01[\x00\x01]|\x30(?:[\x00-\x7f]|\x81.|\x82..)\x06)", re.DOTALL)
#: How a JSON header begins in base64: `{"`, `{` and a line end, a blank, a tab or a carriage return.
TOKEN_HINTS = ("eyJ", "ewo", "eyA", "ewk", "ew0")
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----")
PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: ")


def decode_base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(raw: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) items that fill the bytes exactly; constructed ones must parse too."""
    items, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(raw):
                return None
            size, at = int.from_bytes(raw[at : at + width], "big"), at + width
            if size < 0x80 or size >> (8 * (width - 1)) == 0:
                return None  # not the shortest form
        if at + size > len(raw):
            return None
        content, at = raw[at : at + size], at + size
        if tag & 0x20 and (depth > 12 or der_items(content, depth + 1) is None):
            return None
        items.append((tag, content))
    return items


def is_der_key(raw: bytes) -> bool:
    """PKCS#1, DSA and SEC1 private keys, PKCS#8, encrypted PKCS#8, and SubjectPublicKeyInfo."""
    top = der_items(raw) if raw[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    parts = der_items(top[0][1]) or []
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02] and len(parts) >= 9 and set(tags[:9]) == {0x02}:
        return True
    if tags == [0x02] * 6 and parts[0][1] == b"\x00":
        return True
    if tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01":
        return True
    if tags[:3] == [0x02, 0x30, 0x04] and parts[0][1] in (b"\x00", b"\x01"):
        return (der_items(parts[1][1]) or [(0, b"")])[0][0] == 0x06
    if tags in ([0x30, 0x03], [0x30, 0x04]):
        return (der_items(parts[0][1]) or [(0, b"")])[0][0] == 0x06
    return False


def is_ssh_key(raw: bytes) -> bool:
    if raw.startswith(b"openssh-key-v1\0"):
        raw, least = raw[15:], 3
    elif any(raw[4 : 4 + len(k)] == k and int.from_bytes(raw[:4], "big") == len(k) for k in SSH_KINDS):
        least = 2
    else:
        return False
    at, fields = 0, 0
    while at + 4 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            break
        at, fields = at + 4 + size, fields + 1
        if least == 3 and fields == 3:
            return True  # cipher, derivation and its options; the number of keys follows
    return least == 2 and fields >= 2 and at == len(raw)


def is_signed_token(header: str, payload: str) -> bool:
    raw = decode_base64(header)
    try:
        head = json.loads(raw) if raw and raw[:1] == b"{" else None
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and decode_base64(payload) is not None


def signed_tokens(text: str) -> list[tuple[int, int, int]]:
    """Three dotted parts of which the first is a header; after one that is none the next part is tried."""
    found = []
    for m in DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            # `{` is an `e` in base64
            if len(parts[i]) >= 8 and parts[i][0] == "e" and is_signed_token(parts[i], parts[i + 1]):
                end = at + sum(map(len, parts[i : i + 3])) + 2
                found.append((at, 6, end))
                at, i = end + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1
    return found


def is_pem_key(body: str) -> bool:
    """A key between BEGIN and END: its base64 after any headers. An encrypted body has no structure of its own; its
    headers and a length of whole cipher blocks stand for it."""
    lines = [x.strip() for x in body.replace("\\r", "\n").replace("\\n", "\n").split("\n")]
    headers = [x for x in lines if PEM_HEADER.match(x)]
    raw = decode_base64("".join("".join(x.split()) for x in lines if not PEM_HEADER.match(x)))
    if raw is None:
        return False
    if any(h.startswith("DEK-Info: ") for h in headers):
        return len(raw) >= 16 and len(raw) % 8 == 0
    return is_der_key(raw) or is_ssh_key(raw)


def pem_blocks(text: str) -> list[tuple[int, int, int]]:
    found = []
    for m in PEM.finditer(text):
        at, mark = text.find("-----", m.end()), f"-----END {m[1]}-----"
        if at >= 0 and text.startswith(mark, at) and is_pem_key(text[m.end() : at]):
            found.append((m.start(), 3, at + len(mark)))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end)."""
    found = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def key_size(head: bytes) -> int:
    """Bytes of the key that the first bytes of a DER encoding announce; 0 where they are not those of a key."""
    m = KEY_HEAD.match(head)
    return m.end(1) + int.from_bytes(m[2] or m[3] or m[4], "big") if m else 0


def kind_of(raw: bytes) -> int | None:
    return 4 if is_der_key(raw) else 5 if is_ssh_key(raw) else None


def in_decoded(raw: bytes) -> list[int]:
    """Kinds of what a decoded text holds when it is scanned once more."""
    text = raw.decode("latin-1")
    found = [3] if "-----BEGIN " in text and pem_blocks(text) else []
    return found + ([6] if any(h in text for h in TOKEN_HINTS) and signed_tokens(text) else [])


def base64_keys(run: str) -> list[tuple[int, int, int]]:
    """Keys in a run of base64, wherever in it they begin: a DER encoding ends where its length says, others with the run."""
    body, found, at = run.rstrip("="), [], 0
    while m := BASE64_START.search(body, at):
        at = m.start()
        size = key_size(decode_base64(body[at : at + 20]) or b"") if m[0][0] == "M" else 0
        end = at + -(-8 * size // 6) if size else len(body)
        piece = body[at:end] if end <= len(body) and (size or m[0][0] != "M") else ""
        raw = decode_base64(piece) if len(piece) >= LEAST_BASE64 else None
        kinds = [] if not raw else in_decoded(raw) if m[0][0] == "L" else [k for k in [kind_of(raw)] if k]
        end = len(run) if end == len(body) else end
        found += [(at, kind, end) for kind in kinds]
        at = end if kinds else at + 1
    return found


def hex_keys(run: str) -> list[tuple[int, int, int]]:
    """Keys in a run of hex digits, at any digit."""
    found, at = [], 0
    while m := HEX_START.search(run, at):
        at = m.start()
        head = bytes.fromhex(run[at : at + 30])[:15] if at + 30 <= len(run) else b""
        size = key_size(head)
        end = at + 2 * size if size else at + (len(run) - at) // 2 * 2
        kind = kind_of(bytes.fromhex(run[at:end])) if end <= len(run) and end - at >= LEAST_HEX and (size or m[0][0] != "3") else None
        if kind:
            found.append((at, kind, end))
        at = end if kind else at + 1
    return found


def line_blocks(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Base64 over several lines of one width, the last one shorter or not: joined, with (place in the text, place in the
    joined run) of each line."""
    for m in BASE64_LINES.finditer(text):
        lines = [(m.start() + x.start(), x[0]) for x in BASE64_LINE.finditer(m[0])]
        first = 0
        for i in range(1, len(lines) + 1):
            width = len(lines[first][1])
            if i < len(lines) and len(lines[i][1]) <= width and len(lines[i - 1][1]) == width:
                continue
            if i - first > 1:
                places = [(start, k * width) for k, (start, _) in enumerate(lines[first:i])]
                yield "".join(x for _, x in lines[first:i]), places
            first = i


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    if "-----BEGIN " in text:
        found += pem_blocks(text)
    for m in BASE64_RUN.finditer(text):
        raw = decode_base64(m[0])
        kind = kind_of(raw) if raw else None
        keys = [(0, kind, len(m[0]))] if kind else base64_keys(m[0])
        found += [(m.start() + a, kind, m.start() + b) for a, kind, b in keys]
    for run, places in line_blocks(text):
        back = lambda at: next(start + at - own for start, own in reversed(places) if own <= at)  # noqa: B023,E731
        found += [(back(a), kind, back(b - 1) + 1) for a, kind, b in base64_keys(run)]
    for m in HEX_RUN.finditer(text):
        found += [(m.start() + a, kind, m.start() + b) for a, kind, b in hex_keys(m[0])]
    if any(h in text for h in TOKEN_HINTS):
        found += signed_tokens(text)
    return found


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(set(spans)))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_confirmed, base_spans, spans): span strings kind:start:end joined by commas, by start, then kind."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_assign", "n_access", "n_hex", "n_confirmed")), ("base_spans", pa.string()), ("spans", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(schema)
        for doc, text in rows_of(batches, "doc_id", "text"):
            base, more = base_spans(text), confirmed_spans(text)
            counts = [sum(kind == k for _, k, _ in base) for kind in range(3)]
            out.add((doc, *counts, len(set(more)), spans_text(base), spans_text(base + more)))
            if out.full():
                yield out.take()
        yield from out.rest()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_spans string, spans string")


def masked(text: str) -> str:
    """The text with every span, overlapping ones together, overwritten by the kinds it holds: `<assign>`, `<hex,der>`."""
    parts, at, i = [], 0, 0
    spans = sorted(set(base_spans(text) + confirmed_spans(text)))
    while i < len(spans):
        start, kind, end = spans[i]
        kinds, i = [kind], i + 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            kinds.append(spans[i][1])
            i += 1
        parts += [text[at:start], "<" + ",".join(KINDS[k] for k in dict.fromkeys(kinds)) + ">"]
        at = end
    return "".join([*parts, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns as they are, but for secrets in the text; a null text stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                i = part.schema.get_field_index(text_col)
                new = pa.array([None if t is None else masked(t) for t in part.column(i).to_pylist()], part.schema.field(i).type)
                yield part.set_column(i, part.schema.field(i), new)

    return docs.mapInArrow(work, docs.schema)
