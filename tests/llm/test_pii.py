import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from gyrolith.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = [int(x) for x in d][::-1]
    return (sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            checks = {"email": lambda m, d: True, "ip": lambda m, d: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 10 <= len(d) <= 15}
            if checks[kind](m, digits):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def base(text):
    return [x for x in pii.spans_of(text, pii.automaton()) if x[1] < 4]


CASES = [
    "", "a@b", "a@b.c", "x a.b+c@d-e.fr.com@z.org", "@@a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.4", "1.2.3", "..1.2.3.4.",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "+1 (017) 555-7713", "+1", "+1 ", "+12345678901 ) ", "é€+1(555)555-5555 a@é.b",
    "token = \"0b96a8c8d79c4a50\"", "http://joe:pw1@host/x", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2",
]


def test_cases_match_the_patterns():
    for text in CASES:
        assert base(text) == plain(text), text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab0159.@+-() %é", max_size=60))
def test_any_text_matches_the_patterns(text):
    assert base(text) == plain(text)


def test_added_kinds_and_redaction():
    spans = pii.spans_of('x token = "0b96a8c8d79c4a50" http://joe:pw1@host/', pii.automaton())
    assert [pii.KINDS[k] for _, k, _ in spans] == ["secret", "login"]
    assert pii.redacted("mail a@b.de now", [(5, 0, 11)]) == "mail [EMAIL] now"


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op10_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id] or "")
        name = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(name.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]


def test_nulls_empty_table_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a@b.cd", "y"), (None, "a@b.cd", "y")], "doc_id long, text string, pii_spans string")
    got = pii.find_pii(docs, redact="text").collect()
    assert [len(r.pii_spans) for r in got] == [0, 1, 1] and [r.text for r in got] == [None, "[EMAIL]", "[EMAIL]"]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_query_against_sql(spark):
    compare(pii.op10_pii(spark, "/root/testdata/sf0.01"), pii.sql(), "/root/testdata/sf0.01")
