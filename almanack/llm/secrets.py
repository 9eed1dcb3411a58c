"""Secret scans with structural confirmation.

Plain patterns find assignments, access keys and hex strings. Beyond them, base64 and hex candidates are decoded and
reported only if what they hold has the structure of a key or a signed token: DER key encodings whose nested lengths add
up, OpenSSH private keys with their length-prefixed fields, and three-part tokens whose header and payload are JSON and
whose header names an algorithm. A key's lines may be joined by real or escaped line breaks, indentation or literals' quotes.
Texts are scanned whole, partition by partition; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frees, pieces, small_batches, table

KINDS = ("assign", "access", "hex", "der", "openssh", "token", "pem")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: Where an encoded candidate starts: not within a run of its characters, unless after a PEM label's dashes, an escaped line break or 0x.
#: A token's header starts as {" or { and white space do in base64; a PEM file in base64 as its dashes do. Neither starts within a run of its
#: characters, so that no run is read from more than one place.
_START = re.compile(
    r"[eMb36L](?:(?<![A-Za-z0-9+/_-].)|(?<=-----.)|(?<=\\[nrt].)|(?<=0[xX].))"
    r"(?:(?P<token>(?<=e)(?:(?<![A-Za-z0-9_-]e)|(?<=\\[nrt]e))(?:y[JA]|w[o0k])[A-Za-z0-9_-]++={0,2}\.[A-Za-z0-9_-]++={0,2}\.[A-Za-z0-9_-]*+)"
    r"|(?P<b64>(?<=M)[A-P][A-Za-z0-9+/_-]{10}|(?<=b)3BlbnNzaC1rZXktdjE|(?<=L)S0tLS1CRUdJTi)"
    r"|(?P<hex>(?<=3)0[0-9A-Fa-f]{12}|(?<=6)(?i:f70656e7373682d6b65792d763100)))"
)
_PEM = "LS0tLS1CRUdJTi"
_RUN = {"b64": re.compile(r"[A-Za-z0-9+/_-]++"), "hex": re.compile(r"[0-9A-Fa-f]++")}
#: What may stand between the lines of one key: blanks and line breaks, real or escaped, quotes of adjoining literals; JSON's \/ too.
_JOIN = re.compile(r"""(?:[\x20\t\r\n]|\\+[nrt]|\\+(?=[/\r\n])|["'][\x20\t\r\n]*+\+[\x20\t\r\n]*+["']|["'])++""")
_PAD = re.compile("={0,2}")
#: Object identifiers that start a password-based encryption: PKCS#5's and PKCS#12's.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_MAGIC = b"openssh-key-v1\0"


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(tag, start, end) of the DER value at `at`; ValueError if it doesn't fit before end."""
    if at + 2 > end:
        raise ValueError
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            raise ValueError
        n, at = int.from_bytes(data[at : at + k]), at + k
        if n < 0x80:
            raise ValueError
    if at + n > end:
        raise ValueError
    return tag, at, at + n


def _parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while at < end:
        out.append(_tlv(data, at, end))
        at = out[-1][2]
    return out


def is_der_key(data: bytes) -> bool:
    """A private key (RSA, DSA, EC, wrapped or encrypted) whose nested lengths fill the data exactly."""
    try:
        tag, a, b = _tlv(data, 0, len(data))
        if tag != 0x30 or b != len(data):
            return False
        parts = _parts(data, a, b)
        tags, sizes = [t for t, _, _ in parts], [y - x for _, x, y in parts]
        if tags == [0x30, 0x04]:  # encrypted: algorithm with its parameters, octets
            own = _parts(data, parts[0][1], parts[0][2])
            return [t for t, _, _ in own] == [0x06, 0x30] and data[own[0][1] : own[0][2]].startswith(_PBE) and sizes[1] >= 8
        if tags[:1] != [0x02]:
            return False
        if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # RSA: version and eight integers
            return True
        if tags == [0x02] * 6:  # DSA: version, p, q, g, y, x
            return data[parts[0][1] : parts[0][2]] == b"\0" and sizes[1] >= sizes[2] >= 16 and sizes[5] <= sizes[2] + 1
        if tags[:2] == [0x02, 0x04] and parts[1][2] - parts[1][1] >= 16:  # EC: version, octets
            return data[parts[0][1] : parts[0][2]] == b"\x01"
        if tags[:3] == [0x02, 0x30, 0x04]:  # wrapped: version, algorithm, key
            own = _parts(data, parts[1][1], parts[1][2])
            return bool(own) and own[0][0] == 0x06 and bool(_parts(data, parts[2][1], parts[2][2]))
    except ValueError:
        pass
    return False


def is_openssh_key(data: bytes) -> bool:
    """Magic, then cipher, derivation, its options, a count of keys and as many public keys, then the private part."""
    if not data.startswith(_MAGIC):
        return False
    at = len(_MAGIC)

    def field() -> bytes:
        nonlocal at
        n = int.from_bytes(data[at : at + 4])
        if at + 4 + n > len(data):
            raise ValueError
        at += 4 + n
        return data[at - n : at]

    try:
        if not field().isascii() or not field().isascii():
            return False
        field()
        count, at = int.from_bytes(data[at : at + 4]), at + 4
        if not 1 <= count <= 16:
            return False
        return all(field() for _ in range(count)) and len(field()) > 0
    except ValueError:
        return False


def _b64(text: str) -> bytes:
    text = re.sub(r"[\r\n=]", "", text).replace("-", "+").replace("_", "/")
    return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)


def is_token(text: str) -> bool:
    """Three parts; header and payload are JSON objects, the header names its algorithm."""
    try:
        header, payload = (json.loads(_b64(x)) for x in text.split(".")[:2])
        return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)
    except (ValueError, binascii.Error, RecursionError):
        return False


def _first(text: str, at: int, n: int, kind: str) -> tuple[bytes, int]:
    """The n bytes encoded from `at` on, over joins of lines, and their end; ValueError if there are fewer."""
    need = 2 * n if kind == "hex" else -(-4 * n // 3)
    if need > len(text) - at:
        raise ValueError
    out = []
    while True:
        m = _RUN[kind].match(text, at)
        if not m:
            raise ValueError
        at = min(m.end(), at + need)
        out.append(text[m.start() : at])
        need -= len(out[-1])
        if not need:
            break
        m = _JOIN.match(text, at)
        if not m:
            raise ValueError
        at = m.end()
    data = "".join(out)
    return (bytes.fromhex(data) if kind == "hex" else _b64(data))[:n], at


def _der_size(head: bytes) -> int:
    """Size by the first 7 bytes, a SEQUENCE's head and its first part's tag."""
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if head[0] != 0x30 or k > 4 or head[1] == 0x80 or k and not head[2] or head[2 + k] not in (0x02, 0x30):
        raise ValueError
    return 2 + k + (int.from_bytes(head[2 : 2 + k]) if k else head[1])


def _openssh_sizes(first) -> list[int]:
    """Sizes that an OpenSSH key may have by its fields: ciphers with authentication append a tag to the private part."""
    number = lambda at: int.from_bytes(first(at + 4)[at:])
    at = len(_MAGIC)
    cipher = first(at + 4 + number(at))[at + 4 :]
    for _ in range(3):
        at += 4 + number(at)
    count, at = number(at), at + 4
    if not 1 <= count <= 16:
        raise ValueError
    for _ in range(count + 1):
        at += 4 + number(at)
    return [at + 16, at] if cipher.endswith((b"gcm@openssh.com", b"poly1305@openssh.com")) else [at]


def _pem(text: str, start: int) -> tuple[str, int, int] | None:
    """A PEM file in base64: its lines, up to the next one's start, are decoded, and a key must be confirmed within."""
    out, at, end = [], start, start
    while m := _RUN["b64"].match(text, at):
        nxt = text.find(_PEM, max(at, start + 1), m.end())
        end = m.end() if nxt < 0 else nxt
        out.append(text[at:end])
        join = _JOIN.match(text, end)
        if nxt >= 0 or not join:
            break
        at = join.end()
    data = "".join(out)
    try:
        inner = _b64(data[: len(data) - len(data) % 4] if len(data) % 4 == 1 else data).decode("latin-1")
    except (ValueError, binascii.Error):
        return None
    return ("pem", start, _PAD.match(text, end).end()) if any(k in ("der", "openssh") for k, _, _ in _structures(inner, False)) else None


def confirmed(text: str, m: re.Match, nested: bool = True) -> tuple[str, int, int] | None:
    """(kind, start, end) of a key or token that starts at m, a match of _START; how far a key goes is told by its own lengths."""
    kind, start = m.lastgroup, m.start()
    if kind == "token":
        return ("token", *m.span()) if is_token(m.group()) else None
    if m.group()[0] == "L":
        return _pem(text, start) if nested else None
    try:
        if m.group()[0] in "M3":
            data, end = _first(text, start, _der_size(_first(text, start, 7, kind)[0]), kind)
            whole = not _RUN[kind].match(text, end) or text.startswith("-----", end)
            return ("der", start, _PAD.match(text, end).end()) if whole and is_der_key(data) else None
        for n in _openssh_sizes(lambda n: _first(text, start, n, kind)[0]):
            try:
                data, end = _first(text, start, n, kind)
            except ValueError:
                continue
            if is_openssh_key(data):
                run = _RUN[kind].match(text, end)
                end = run.end() if run and not text.startswith("-----", end) else end
                return "openssh", start, _PAD.match(text, end).end()
    except ValueError:
        pass
    return None


def _structures(text: str, nested: bool = True) -> list[tuple[str, int, int]]:
    out, at = [], 0
    while m := _START.search(text, at):
        if s := confirmed(text, m, nested):
            out.append(s)
        at = s[2] if s else m.end() if m.lastgroup == "token" else m.start() + 1
    return out


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans of the structural method), each (kind, start, end) in code points."""
    base = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        base += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return base, _structures(text)


def _line(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _scan(batches):
    for batch in batches:
        out = [[], [], [], [], [], []]
        for text in batch.column(1).to_pylist():
            base, more = find(text or "")
            kinds = [k for k, _, _ in base]
            for to, x in zip(out, (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_line(base).encode()).hexdigest(), _line(base + more), len(more)), strict=True):
                to.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.string()) for x in out[3:5]), pa.array(out[5], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) and n_confirmed.

    A null text counts as empty and has no spans; ids are carried only, so null and repeated ids are fine; other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redacted(text: str, mark: str = "<secret>") -> str:
    """text with each run of overlapping spans replaced by mark."""
    base, more = find(text)
    out, at = [], 0
    for _, a, b in sorted(base + more, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "<secret>") -> DataFrame:
    """docs with secrets replaced in its texts, and lengths to match; all columns and rows stay, null texts too."""

    def run(batches):
        for batch in pieces(batches):
            names = batch.schema.names
            old = batch.column(names.index(text_col)).to_pylist()
            new = [x if x is None else redacted(x, mark) for x in old]
            batch = batch.set_column(names.index(text_col), batch.schema.field(text_col), pa.array(new, batch.schema.field(text_col).type))
            if length_col in names:
                sizes = batch.column(names.index(length_col)).to_pylist()
                sizes = [n if x is y or x == y else len(y) for n, x, y in zip(sizes, old, new, strict=True)]
                batch = batch.set_column(names.index(length_col), batch.schema.field(length_col), pa.array(sizes, batch.schema.field(length_col).type))
            yield batch

    small_batches(docs.sparkSession)
    return docs.mapInArrow(frees(run), docs.schema)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document scanned for secrets."""
    return scan(table(spark, sf_dir, "documents"))
