"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, plus signs, digits, schemes and identifier cues. From
each anchor a small deterministic parser grows the span to both sides and validates it. Spans of one kind
never overlap; spans of different kinds may.

Defined results: a null or empty text has no spans; a repeated row is scanned like any other; positions are
code points, ends exclusive.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyrolith.llm.common import slices

#: Kinds in the order in which spans with one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "login", "secret", "account")
BASE = KINDS[:4]

# Identifier cues and the kind that each announces.
CUES = {
    "api_key": "secret", "apikey": "secret", "password": "secret", "passwd": "secret", "secret": "secret", "token": "secret",
    "account": "account", "iban": "account", "passport": "account", "ssn": "account",
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[A-Za-z0-9._%+~-]+:[^\s/@:]+(?=@)")
VALUE = re.compile(r"""["']?[ \t]*[=:][ \t]*["']?([A-Za-z0-9_+/.-]{8,})""")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+0123456789":
        found.add_word(sign, (sign if sign in "@+" else "digit", 1))
    found.add_word("://", ("login", 3))
    for cue, kind in CUES.items():
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    found: list[tuple[int, int, int]] = []
    done = dict.fromkeys(("email", "ip", "card", "phone", "login", "secret", "account"), 0)
    for last, (anchor, width) in anchors.iter(text):
        at = last + 1 - width
        if anchor == "digit":
            if at >= done["ip"]:
                chain = DOTTED.match(text, at)
                done["ip"] = chain.end()
                parts = chain[0].split(".")
                start = at
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        found.append((start, 1, end))
                    start = end + 1
            if at >= done["card"]:
                chain = CARD.match(text, at)
                done["card"] = chain.end() if chain else last + 1
                if chain:
                    digits = chain[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((at, 2, chain.end()))
        elif anchor == "@":
            start, floor = at, done["email"]
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            domain = DOMAIN.match(text, last + 1) if start < at else None
            if domain:
                found.append((start, 0, domain.end()))
                done["email"] = domain.end()
        elif anchor == "+":
            number = PHONE.match(text, at) if at >= done["phone"] else None
            if number:
                done["phone"] = number.end()
                if 10 <= sum(c.isdigit() for c in number[0]) <= 15:
                    found.append((at, 3, number.end()))
        elif anchor == "login":
            if (login := LOGIN.match(text, last + 1)) and last + 1 >= done["login"]:
                found.append((login.start(), 4, login.end()))
                done["login"] = login.end()
        else:
            value = VALUE.match(text, last + 1)
            if value and value.start(1) >= done[anchor] and any(c.isdigit() for c in value[1]):
                found.append((value.start(1), KINDS.index(anchor), value.end(1)))
                done[anchor] = value.end(1)
    found.sort()
    return found


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every run of overlapping spans replaced by the name of its first kind."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text: str = "text", spans: str = "pii_spans", redact: str | None = None) -> DataFrame:
    """The rows with their spans in a new column (and the redacted text, if a column is named for it).

    Columns of the same names are replaced. The scan is a map over partitions: no shuffle, and a lost task is
    simply run again. A null text stays null when redacted.
    """
    added = [spans] + ([redact] if redact else [])
    lower = {c.lower() for c in added}
    keep = [c for c in docs.columns if c.lower() not in lower or c == text]
    rest = [c for c in keep if c.lower() not in lower]
    types = {spans: SPANS} | ({redact: T.StringType()} if redact else {})
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(c, types[c]) for c in added])

    def scan(batches):
        anchors = automaton()
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [spans_of(t, anchors) if t else [] for t in texts]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            columns.append(pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found], kind_type))
            if redact:
                columns.append(pa.array([redacted(t, x) if x else t for t, x in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *added])

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(scan, schema)


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))


def sql() -> str:
    """The same rows in DuckDB: each kind's pattern over the whole text; a match starts after the pieces and matches before it."""
    cues = {kind: "|".join(form for cue, k in CUES.items() if k == kind for form in (cue, cue.upper(), cue.capitalize())) for kind in ("secret", "account")}
    value = """["\\']?[ \\t]*[=:][ \\t]*["\\']?""".replace("\\'", "''")
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "login": r"://[A-Za-z0-9._%+~-]+:[^\s/@:]+@", "secret": f"(?:{cues['secret']}){value}[A-Za-z0-9_+/.-]{{8,}}", "account": f"(?:{cues['account']}){value}[A-Za-z0-9_+/.-]{{8,}}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({digits}), i, 1) AS INT) ELSE (2 * CAST(substr(reverse({digits}), i, 1) AS INT)) // 10 + (2 * CAST(substr(reverse({digits}), i, 1) AS INT)) % 10 END)) % 10 = 0"
    tail = r"regexp_extract(m, '[A-Za-z0-9_+/.-]*$')"
    checks = {
        "email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0", "card": f"len({digits}) BETWEEN 14 AND 19 AND {luhn}", "phone": f"len({digits}) BETWEEN 10 AND 15",
        "login": "true", "secret": f"regexp_matches({tail}, '[0-9]')", "account": f"regexp_matches({tail}, '[0-9]')",
    }
    first = {"login": "a + 3", "secret": f"e - len({tail})", "account": f"e - len({tail})"}
    last = {"login": "e - 1"}
    parts = []
    for k, (kind, p) in enumerate(patterns.items()):
        parts.append(f"""SELECT rid, {k} AS k, '{kind}' AS kind, {first.get(kind, 'a')} AS s, {last.get(kind, 'e')} AS e FROM (
  SELECT rid, m, list_sum(list_transform(pieces[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: len(x))), 0) AS a, a + len(m) AS e
  FROM (SELECT rid, pieces, found, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS i FROM (SELECT rid, regexp_split_to_array(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS found FROM d))) WHERE {checks[kind]}""")
    name = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(parts)})
SELECT any_value(doc_id) AS doc_id, {', '.join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)},
  sha256(coalesce({name} FILTER (WHERE k < {len(BASE)}), '')) AS base_sha256, coalesce({name}, '') AS spans
FROM d LEFT JOIN f ON f.rid = d.rid GROUP BY d.rid"""
