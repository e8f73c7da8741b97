"""Personal data: base spans against plain regular expressions; what the trees add on a corpus where labels can be learned."""

import hashlib
import random
import re
from collections import Counter

from lexquarry.llm import op05_pii as op

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = [
    "mail a.b+c@x-y.example.org, d@e.fg_h@i.jk @no.pe a@b a@b. a@b..c x@y.z", "..a.@b.c é@ü.de ü.b@c.d-e.f", "a@b.cd@e.fg",
    "10.0.0.1 256.1.1.1 1.2.3.4.5 0001.02.255.255 1.2.3 999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111",
    "5500005555555559 12345678901234567890 4111111111111111", "- 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 -1", "+1 (988) 555-2485 +12 +123456789012345678 +4 ..9",
    "漢😀 +49 30 1234567 😀 b@c.de", "1 " * 3000, "a." * 3000 + "@" + "b." * 3000 + "c", "x" * 50000, "1" * 20000, "a@b.c " * 900, "", None,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    text, out = text or "", []
    out += [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def digest(spans):
    return ",".join(f"{op.BASE[k]}:{s}:{e}" for k, s, e in spans)


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in op.scan(docs, ["doc_id"]).collect():
        assert [(s.place, s.start, s.end) for s in r.base] == base(TEXTS[r.doc_id]), r.doc_id


def test_query(spark, folder, documents):
    rows = op.op5_pii(spark, folder).collect()
    want = Counter()
    for doc, text in documents:
        spans = base(text)
        n = Counter(k for k, _, _ in spans)
        want[doc, n[0], n[1], n[2], n[3], hashlib.sha256(digest(spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    assert sum(r.n_email for r in rows) and sum(r.n_phone for r in rows)


def test_trees_add_near_misses_and_leave_the_rest(spark):
    draw = random.Random(8)
    docs = []
    for i in range(400):
        digits = "".join(draw.choice("0123456789") for _ in range(15))
        card = next(digits + c for c in "0123456789" if luhn(digits + c))
        docs.append((i, draw.choice([f"pay with {card} now", f"call me at +1 (555) {draw.randint(100, 999)}-{draw.randint(1000, 9999)} today",
                                     f"version {draw.randint(10, 99)}.{draw.randint(10, 99)} of {draw.randint(1990, 2020)}-10-1{i % 9} it"])))
    wrong = next(d for d in ("4111111111111112",) if not luhn(d))
    docs += [(1000, f"pay with {wrong} now"), (1001, "version 12.34 of 2001-10-12 it")]
    rows = {r.doc_id: r for r in op.scan(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"]).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[1000].spans] == [("loose_number", 9, 25)] and not rows[1000].base
    assert not rows[1001].spans


def test_odd_rows(odd, none):
    from conftest import ODD

    rows = op.scan(odd, ["doc_id"]).collect()
    assert Counter((r.doc_id, digest([(s.place, s.start, s.end) for s in r.base])) for r in rows) == Counter((d, digest(base(t))) for d, t in ODD)
    assert op.scan(none, ["doc_id"]).count() == 0
