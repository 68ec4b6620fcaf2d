"""Personal data: base spans against the plain patterns, contexts on planted texts."""

import hashlib
import random
import re

from rewardframe.llm import private_data as pd_

SCHEMA = "doc_id long, text string, row int, kind string, base int, found int"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(6)
    pieces = ["a@b.c", "@", ".", "x", "+", "1", "12", "255", "256", "0007.", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", " ", "-", "--", "(", ")", "+1 (017) 555-7713", "é", "\n", "a.b%", "@x.y@z.w"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert pd_.base_spans(text) == plain(text), text
    assert pd_.base_spans("") == []


def test_time_is_linear():
    import time

    for unit in ["a", "1", "1 ", "+1 ", "a.", "1.", "1.2.3.", "@", "@a.", "1-", "(at) ", "a at ", "x" * 70 + "1"]:
        text = unit * (400_000 // len(unit))
        start = time.process_time()
        pd_.candidates(text, pd_.base_spans(text))
        assert time.process_time() - start < 6, unit


def planted():
    rng = random.Random(1)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]

    def filler(n):
        return " ".join(rng.choices(words, k=n))

    def number():
        return f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"

    rows, hidden = [], {}
    for i in range(30):
        rows.append((i, f"{filler(9)} please call me on +1 {number()} after six {filler(9)}"))
        rows.append((100 + i, f"{filler(5)} write to me at anna.{i}@mail.example.com please {filler(5)}"))
    for i in range(4):
        number_ = number()
        rows.append((200 + i, f"{filler(9)} please call me on {number_} after six {filler(9)}"))
        hidden[200 + i] = ("phone", number_)
        spelled = f"otto{i} (at) example (dot) org"
        rows.append((300 + i, f"{filler(4)} write to me at {spelled} please {filler(4)}"))
        hidden[300 + i] = ("email", spelled)
    # a found number elsewhere, in other words
    rows.append((400, f"{filler(3)} {hidden[200][1]} {filler(3)}"))
    hidden[400] = hidden[200]
    # clean texts: numbers in the slots of common words, contexts of another kind of number
    rows += [(500 + i, f"{filler(30)} chapter {i} of {rng.randint(1000, 9999)} {filler(30)} room {rng.randint(10**6, 10**7)}") for i in range(40)]
    rows += [(700 + i, f"{filler(20)} 192.168.{i}.7 {filler(20)}") for i in range(20)]
    return rows, hidden


def test_contexts_find_what_the_forms_miss(spark):
    rows, hidden = planted()
    df = spark.createDataFrame([(i, t, 1, "a", 2, 3) for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in pd_.op13_personal_data(df).collect()}
    text = dict(rows)
    for i, r in got.items():
        base = ",".join(f"{pd_.KINDS[k]}:{s}:{e}" for s, k, e in plain(text[i]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        extra = [(k, text[i][int(s) : int(e)]) for k, s, e in spans if f"{k}:{s}:{e}" not in base.split(",")]
        assert set(base.split(",")) - {""} <= {":".join(x) for x in spans}
        assert extra == ([hidden[i]] if i in hidden else []), (i, extra)
        assert r.n_found == len(extra)
        assert [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)
    assert len(got) == len(rows)


def test_patterns_and_rounds(spark):
    """A pattern seen with found instances only is learned in the next round."""
    rows, _ = planted()
    rng = random.Random(2)
    rows += [(900 + i, f"please call me on +1 (333) 555-{2000 + i} after six") for i in range(60)]
    for i in range(4):
        n = f"(777) 555-{1000 + i}"
        rows.append((800 + i, f"please call me on {n} after six"))
        rows.append((820 + i, f"our fax line {n} night and day"))
    hidden = f"(778) 555-{rng.randint(1000, 9999)}"
    rows.append((850, f"our fax line {hidden} night and day"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    full, patterns = pd_.extract(docs)
    names = {r.pattern for r in patterns.collect()}
    assert {"L2 me on", "LR on after", "L2 fax line"} <= names
    found = {r.doc_id: r.found for r in full.filter("size(found) > 0").collect()}
    assert 850 in found and {820, 821, 822, 823} <= set(found)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "mail a@b.cd"), (1, None), (1, ""), (1, "a@b.cd"), (1, "a@b.cd"), (2, "x" * 300_000 + " 1.2.3.4")]
    df = spark.createDataFrame([(i, t, 1, "a", 2, 3) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.spans) for r in pd_.op13_personal_data(df).collect()), key=repr)
    assert got == sorted([(None, 1, 0, "email:5:11"), (1, 0, 0, ""), (1, 0, 0, ""), (1, 1, 0, "email:0:6"), (1, 1, 0, "email:0:6"), (2, 0, 1, "ip:300001:300008")], key=repr)
    assert pd_.op13_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
