import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                s = sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d[::-1]))
                if not 16 <= len(d) <= 19 or s % 10:
                    continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


pieces = st.sampled_from(["a", "@", ".", "-", "+", "1", "25", "4111111111111111", "4111 1111 1111 1111", " ", "  ", "\n", "é", "(", ")", "%", "1.2.3.4", "300", "a.b@c.de", "+1 (234) 555-6789", "٣", "00000000000000000", "_"])


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_numbers_of_any_length():
    for t in ("x 1.2.3." + "0" * 5000 + "1 y", "1.2.3." + "9" * 5000, "0" * 5000 + "1.2.3.4", "1.2.3.²", "1.2.3.٣", "+" + "1" * 5000, "4 " * 5000):
        assert pii.base_spans(t) == brute_octets(t) and pii.find(t, pii.train()) is not None


def brute_octets(text):
    import sys

    old = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        return brute(text)
    finally:
        sys.set_int_max_str_digits(old)


def test_a_zone_of_any_length_is_read_in_pieces():
    w = pii.train()
    text = " ".join(f"anna{i % 90 + 10} (at) mail (dot) com wrote" for i in range(400))
    got = [(k, a, b) for k, a, b, base in pii.find(text, w) if not base]
    zone = pii.zones(text, [])[0]
    assert len(zone) > 2000 and got == pii.decode(pii.Lattice(text, zone), w, 0.9) and len(got) == 400


#: Written by hand: what the patterns miss in forms and sentences that the generator of examples does not make, and what is none.
FORMS = {
    "Please reach Anna at anna.k (at) mail (dot) com before noon": "anna.k (at) mail (dot) com",
    "mail joe[at]host.org, or come by": "joe[at]host.org",
    "Kontakt: m.weber[at]firma[dot]de (Buero)": "m.weber[at]firma[dot]de",
    "Anrufen: 212-555-1000, danke": "212-555-1000",
    "tel (212) 555-1000 or write": "(212) 555-1000",
    "The hotline is 1-800-555-0199 and free": "1-800-555-0199",
    "fax no. 415.555.2671 (office hours)": "415.555.2671",
    "charged to 4111/1111/1111/1111 in May": "4111/1111/1111/1111",
    "4111.1111.1111.1111 is the number on it": "4111.1111.1111.1111",
    "amex 3782 822463 10005 expired": "3782 822463 10005",
    "id 0049 30 1234567 home": "0049 30 1234567",
    "joe AT host DOT org is how to spell it": "joe AT host DOT org",
}
PLAIN_TEXT = ["room 12 (at) 14:30", "version 10.2.33 of 2021-03-04", "pages 212-555 and 1000", "sold 1,234,567 in 2019-2020", "call me at 5", "look [at] line 44", "ISBN 978-3-16-148410-0", "4111/1111/1111/1112 is wrong", "a 1:0 win, 3.5 %, 20 x 30"]


def test_hand_written_forms():
    w = pii.train()
    right = sum(any(t[a:b] == want for _, a, b, base in pii.find(t, w) if not base) for t, want in FORMS.items())
    wrong = sum(len(pii.find(t, w)) for t in PLAIN_TEXT)
    assert right >= 9 and wrong <= 1, (right, wrong)


def test_base_spans_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "1 " * 150_000, "+1 " * 100_000, "@" * 200_000, "a@" * 100_000):
        pii.base_spans(t)


def test_model_on_made_up_text():
    w = pii.train()
    assert pii.train() == w
    found = right = all_ = 0
    for text, gold in pii.examples(1234, 400):
        got = {x[:3] for x in pii.find(text, w) if not x[3]}
        base = {x for x in pii.base_spans(text)}
        want = {g for g in gold if not any(g[1] < b and a < g[2] for _, a, b in base)}
        found, right, all_ = found + len(got), right + len(got & want), all_ + len(want)
    assert right / found > 0.93 and right / all_ > 0.9


def test_clean_text_has_no_spans():
    w, r = pii.train(), random.Random(5)
    for _ in range(300):
        t = " ".join("".join(r.choices("abcdefghilmnorstuéß.", k=r.randrange(1, 9))) for _ in range(60)) + r.choice(["", " 843 items.", " CC BY-NC 4.0.", " in 2024-01-05", ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', " at 12:30, for $3,200.50"])
        assert pii.find(t, w) == []


def test_zones_end_and_entities_are_bounded():
    w = pii.train()
    t = "1 2 3 " * 3000 + "(376) 555-9077 " + "x" * 5000 + "@" + "y" * 5000
    for k, a, b, base in pii.find(t, w):
        assert base or len(pii.tokenize(t, a, b)) <= pii.LONGEST


def test_spans_and_redaction(spark):
    w = pii.train()
    rows = [(1, "écrire à a.b@c.de, (376) 555-9077.", 0), (2, None, 0), (3, "", 0), (4, "no data", 0), (5, "+1 234 555 6789 1.2.3.4 ", 0), (5, "+1 234 555 6789 1.2.3.4 ", 0), (None, "x" * 100_000 + " a@b.co", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").select("*", pii.pii_spans(F.col("text"), w).alias("found"))
    got = df.select("doc_id", "found", pii.redact(F.col("text"), w).alias("red")).collect()
    assert [(s.kind, s.start, s.end, s.base) for s in got[0].found] == [("email", 9, 17, True), ("phone", 19, 33, False)]
    assert got[0].red == "écrire à <email>, <phone>." and got[1].red is None and got[2].red == "" and got[3].red == "no data"
    assert got[4] == got[5] and got[6].red.endswith("x <email>")
    assert df.limit(0).count() == 0


def test_query(spark, sf_dir):
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op5_pii(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for x in got:
        base = [f"{k}:{a}:{b}" for k, a, b in brute(docs[x.doc_id])]
        assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(x.spans.split(",") if x.spans else [])
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in pii.KINDS]
