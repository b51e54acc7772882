"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move the score.

Base spans (email, ip, card, phone) follow fixed rules and are always kept. Further spans are proposed more widely: cards within
longer runs of digits, phone numbers without a country code, emails with a spelled-out at, and bank accounts. Such a
proposal needs its checksum where its kind has one, must not touch a base span, and must reach KEEP with the help of the words around it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of results; the first four have base spans.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = 4
#: Characters before and after a span in which words count, and the score that an added span must reach.
BEFORE, AFTER, KEEP = 40, 20, 0.6
#: A kind's score before words are looked at, for base spans and for added ones.
START = {"email": (0.9, 0.6), "ip": (0.6, 0.0), "card": (0.7, 0.4), "phone": (0.6, 0.3), "iban": (0.0, 0.8)}
#: What a word of the kind adds, and what one takes away that speaks of other numbers.
FOR, AGAINST = 0.3, 0.3

# Words that stand near personal data of a kind, and words that stand near other numbers.
NEAR = {
    "email": ("mail", "email", "contact", "write", "correo", "contacto", "courriel", "contacter", "schreiben", "kontakt"),
    "ip": ("ip", "address", "host", "server", "client", "login", "dirección", "adresse"),
    "card": ("card", "credit", "debit", "visa", "mastercard", "amex", "payment", "tarjeta", "carte", "karte", "kreditkarte", "bancaire"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "sms", "teléfono", "móvil", "llamar", "téléphone", "portable", "appeler", "telefon", "handy", "anrufen"),
    "iban": ("iban", "account", "bank", "transfer", "cuenta", "banco", "compte", "banque", "konto", "überweisung"),
}
OTHER = ("version", "isbn", "issn", "order", "invoice", "serial", "sku", "part", "build", "hash", "checksum", "pedido", "factura", "commande", "facture", "bestellung", "rechnung")

# Length of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

# All run in time that grows with the text alone: runs are taken as a whole, without a second try inside them.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
_IP = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
_NATIONAL = re.compile(r"(?<![\w.+/-])(?:\([0-9]{2,5}\)[\x20-]?|[0-9]{2,5}[\x20/.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}(?![\w/-])(?!\.[0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[\x20]?[A-Z0-9])")
_WORD = re.compile(r"[^\W\d_]+")
_GROUP = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of base spans: leftmost matches of each kind that pass its check."""
    end = 0
    for m in _DOMAIN.finditer(text):
        # the local part reaches back to the last character that cannot stand in one, or to the match before
        start = m.start()
        while start > end:
            part = text[max(end, start - 64) : start]
            start -= (own := len(_LOCAL.search(part)[0]))
            if own < len(part):
                break
        if start < m.start():
            end = m.end()
            yield 0, start, end
    for m in _IP.finditer(text):
        if m[1] and all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield 1, *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 13 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            yield 2, *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield 3, *m.span()


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of further spans, confirmed by their checksums; of one kind they do not overlap."""
    end = 0
    for m in _SPELLED.finditer(text):
        start = m.start()
        while start > end and start > m.start() - 64 and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < m.start():
            end = m.end()
            yield 0, start, end
    for m in _CARD.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start(), g[0]) for g in _GROUP.finditer(m[0])]
        i = 0
        while i < len(groups):
            digits, j = groups[i][2], i
            while len(digits) < 13 and j + 1 < len(groups):
                j += 1
                digits += groups[j][2]
            if (i > 0 or j + 1 < len(groups)) and 13 <= len(digits) <= 19 and digits[0] in "3456" and luhn(digits):
                yield 2, groups[i][0], groups[j][1]
                i = j
            i += 1
    for m in _NATIONAL.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 12:
            yield 3, *m.span()
    end = 0
    for m in _IBAN.finditer(text):
        need, at, out = IBAN_LENGTH.get(m[0][:2], 0), m.start(), ""
        if not need or at < end:
            continue
        while len(out) < need and at < len(text) and (text[at].isascii() and (text[at].isdigit() or text[at].isupper()) or text[at] == " " and out and text[at - 1] != " "):
            out += text[at].strip()
            at += 1
        if len(out) == need and not text[at : at + 1].isalnum() and mod97(out):
            end = at
            yield 4, m.start(), at


def score(text: str, kind: int, start: int, end: int, base: bool) -> float:
    """Start of the kind, and what the words around the span add and take away, between 0 and 1."""
    around = {w.lower() for w in _WORD.findall(text, max(0, start - BEFORE), start)} | {w.lower() for w in _WORD.findall(text, end, end + AFTER)}
    name = KINDS[kind]
    return round(min(1.0, max(0.0, START[name][not base] + FOR * (not around.isdisjoint(NEAR[name])) - AGAINST * (not around.isdisjoint(OTHER)))), 2)


def spans(text: str) -> list[tuple[int, int, int, float, bool]]:
    """(kind, start, end, score, base) of one text, by kind and start. Added spans touch no base span and no better one."""
    out = [(k, a, b, score(text, k, a, b, True), True) for k, a, b in base_spans(text)]
    more = [(k, a, b, score(text, k, a, b, False), False) for k, a, b in proposals(text)]
    taken: list[tuple[int, int]] = []  # apart from each other; base spans of different kinds may overlap
    for a, b in sorted((a, b) for _, a, b, _, _ in out):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for x in sorted((x for x in more if x[3] >= KEEP), key=lambda x: (-x[3], x[0], x[1])):
        if _free(taken, x[1], x[2]):
            out.append(x)
    return sorted(out)


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether the span overlaps none of the sorted ones; if so it joins them."""
    i = bisect_left(taken, (start, start))
    if (i and taken[i - 1][1] > start) or (i < len(taken) and taken[i][0] < end):
        return False
    taken.insert(i, (start, end))
    return True


_SPAN = "struct<kind:string,start:int,end:int,value:string,score:double,base:boolean>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` for each row of ``docs`` (doc_id, text): an array of kind, start, end, value, score and base.

    Places are code points of the whole text, the end exclusive. Spans come by kind, as in KINDS, and start. Base spans are all there
    whatever their score; of one kind they do not overlap, but a card and an ip may. Added ones have a score of KEEP or more.

    Null and empty texts have no spans. Null and repeated ids: each row is answered on its own. An empty table stays empty. Other
    columns are not read. Time grows with the length of a text alone, also for one run of digits or letters.
    """

    def run(batches):
        for batch in batches:
            found = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                found.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b], "score": s, "base": base} for k, a, b, s, base in spans(text)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans array<{_SPAN}>")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; the first of overlapping ones counts. Null stays null."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("text"):
                text, at, parts = x.as_py(), 0, []
                for a, b, k in sorted((a, b, k) for k, a, b, _, _ in spans(text or "")):
                    if a >= at:
                        parts += [text[at:a], f"[{KINDS[k]}]"]
                    at = max(at, b)
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *(number(k) for k in KINDS[:BASE]), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
