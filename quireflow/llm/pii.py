"""Personal data: patterns propose spans, validators confirm them, nearby words move the score.

Each kind has a pattern, a score for a match that its validator lets through, and context words. Card numbers must
pass the Luhn check, IBANs the mod-97 check and their country's length, IPv4 addresses and US social security numbers
the rules on their parts, and telephone numbers the number of their digits. A context word among the ``WINDOW``
characters on either side adds 0.2, one that speaks against the kind takes 0.3 away. Spans with at least ``LEAST``
stay; where two overlap, the one with the higher score stays, then the longer, then the earlier. A text is read whole.

Null and empty texts have no spans. Repeated rows give their spans again. Null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quireflow.llm import shared
from quireflow.llm import words as W

WINDOW, LEAST, FOR, AGAINST = 60, 0.5, 0.2, -0.3
#: Lengths of IBANs by country, from the public IBAN registry.
IBAN_LENGTH = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28,
    IE=22, IL=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24, SM=27, TN=24, TR=26, UA=29, VG=24, XK=20,
)


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    doubled = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and (doubled + sum(digits[-1::-2])) % 10 == 0


def mod97(text: str) -> bool:
    code = re.sub(r"[ -]", "", text).upper()
    return IBAN_LENGTH.get(code[:2]) == len(code) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ipv4(text: str) -> bool:
    parts = text.split(".")
    return all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts) and parts[0] != "0"


def social(text: str) -> bool:
    area, group, serial = re.split("[- ]", text)
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def telephone(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return 7 <= len(digits) <= 15 and len(set(digits)) > 2


class Kind(NamedTuple):
    name: str
    pattern: re.Pattern
    score: float
    valid: Callable[[str], bool]
    context: re.Pattern
    against: re.Pattern


def _words(*words: str) -> re.Pattern:
    return re.compile(r"\b(?:%s)\b" % "|".join(words), re.I) if words else re.compile(r"(?!)")


KINDS = [
    Kind("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@])", re.A), 0.8, lambda t: ".." not in t, _words("e-?mail", "contact", "mail", "write"), _words()),
    Kind("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])", re.A), 0.7, luhn, _words("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "carte", "karte", "tarjeta"), _words("isbn", "sku", "order", "tracking", "serial")),
    Kind("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}(?!\w)", re.A), 0.8, mod97, _words("iban", "account", "bank", "konto", "compte", "cuenta", "bic", "swift"), _words()),
    Kind("ssn", re.compile(r"(?<![\w.-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])", re.A), 0.5, social, _words("ssn", "social", "security", "taxpayer"), _words("isbn", "sku", "order", "part", "serial")),
    Kind("phone", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,8}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])", re.A), 0.6, telephone, _words("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp"), _words("isbn", "sku", "order", "version", "serial")),
    Kind("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)", re.A), 0.6, ipv4, _words("ip", "host", "server", "address", "client"), _words("version", "release", "section", "v")),
    Kind("secret", re.compile(r"(?<!\w)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{12,}={0,2}[\"']?", re.A | re.I), 0.7, lambda t: bool(re.search(r"\d", re.split("[=:]", t, maxsplit=1)[1])), _words("login", "credentials", "auth"), _words("example", "placeholder")),
]
#: Every match of a kind has a match of this in it, so texts without one are passed over.
ANY = r"@[A-Za-z0-9]|[A-Z]{2}[0-9]{2}|[0-9][ .()-]{0,3}[0-9][ .()-]{0,3}[0-9]|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t\n\v\f\r]*[=:]"


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in the order of the text, places counted in characters."""
    found = []
    for kind in KINDS:
        for m in kind.pattern.finditer(text):
            if not kind.valid(m[0]):
                continue
            near = text[max(0, m.start() - WINDOW) : m.start()] + "\n" + text[m.end() : m.end() + WINDOW]
            score = kind.score + FOR * bool(kind.context.search(near)) + AGAINST * bool(kind.against.search(near))
            if round(score, 6) >= LEAST:
                found.append((kind.name, m.start(), m.end(), round(min(1.0, score), 6)))
    found.sort(key=lambda s: (-s[3], s[1] - s[2], s[1], s[0]))
    kept: list[tuple[str, int, int, float]] = []
    if len(found) < 2:
        return found
    taken = np.zeros(len(text), bool)
    for s in found:
        if not taken[s[1] : s[2]].any():
            taken[s[1] : s[2]] = True
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def redact(text: str) -> str:
    """The text with a placeholder for each span."""
    out, at = [], 0
    for kind, a, b, _ in spans(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _suspects(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring_regex(texts, ANY).to_numpy(zero_copy_only=False))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, kind, span_start, span_end and score, a row for each span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = W.flat(part.column("text"))
                rows = [(int(i), *s) for i in _suspects(texts) for s in spans(texts[int(i)].as_py())]
                if rows:
                    at, kind, a, b, score = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), pa.array(kind), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(score)], names=["doc_id", "kind", "span_start", "span_end", "score"])

    shared.small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, kind string, span_start int, span_end int, score double")


def redacted(docs: DataFrame, length: str | None = "n_chars") -> DataFrame:
    """The rows and columns of docs with a placeholder for each span in text; the column ``length``, where there is one, has the new length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text")
            texts = W.flat(raw)
            changed = {int(i): redact(texts[int(i)].as_py()) for i in _suspects(texts)}
            changed = {i: t for i, t in changed.items() if t != texts[i].as_py()}
            if changed:
                new = raw.to_pylist()
                for i, t in changed.items():
                    new[i] = t
                batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))
                if length in batch.schema.names:
                    k = batch.schema.get_field_index(length)
                    sizes = batch.column(k).to_pylist()
                    for i, t in changed.items():
                        sizes[i] = len(t)
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(sizes, batch.schema.field(k).type))
            yield batch

    shared.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
