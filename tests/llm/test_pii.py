import hashlib
import random
import re

from casewatch.llm import pii
from casewatch.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in PATTERNS.items()}


def test_fixed_patterns_are_plain_searches():
    r = random.Random(1)
    parts = ["a", "Zé", "@", ".", "-", " ", "+", "1", "25", "255", "300", "(", ")", "4111111111111111", "4111 1111-1111 1111", "+1 (375) 555-4393", "x@y.co", "%", "中", "٣", "0" * 30, "1.2.3.4"]
    for _ in range(6_000):
        text = "".join(r.choices(parts, k=r.randint(0, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_no_long_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " (" * 100_000, "1." * 100_000, "a@" + "b-" * 100_000):
        pii.base_spans(text)
    assert pii.base_spans("9" * 5_000 + ".1.1.1")["ip"] == []


def test_supervised_spans(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 9)))
    secret = lambda n: "".join(r.choices("0123456789abcdef", k=n)) + "1a"
    texts, planted = [], []
    for i in range(60):
        body = " ".join(word() for _ in range(20))
        key = "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOP234567", k=16)) if i % 3 == 0 else secret(38)
        line = {0: f" {key} ", 1: f' token = "{key}" ', 2: f" password={key} "}[i % 3]
        texts.append(body + line + "version 3. in 2024-2025, page-1234567 " + body)
        planted.append(key)
    texts += [None, "", "nothing here", "mail a@b.co now", "covid19vaccines 12345678"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id int, text string, n_chars long, pii_spans string")
    rows = pii.find_personal_data(docs).sort("doc_id").collect()
    for row, key in zip(rows, planted):
        found = [row["text"][s["start"] : s["end"]] for s in row["pii_spans"] if s["kind"] == pii.SECRET]
        assert found == [key]
    assert [[s["kind"] for s in row["pii_spans"]] for row in rows[60:]] == [[], [], [], ["email"], []]
    clean = pii.redact_personal_data(docs).sort("doc_id").collect()
    assert clean[0].asDict().keys() == set(docs.columns)
    assert all(k not in c["text"] for k, c in zip(planted, clean)) and clean[63]["text"] == "mail <EMAIL> now"
    assert clean[63]["n_chars"] == len(clean[63]["text"]) and clean[60]["text"] is None and clean[62]["text"] == texts[62]
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_announced_tokens_reach_the_labelers():
    texts = {
        "my PIN: 4821, ok": ["4821"],
        "password: hunter2": ["hunter2"],
        'Password = "correcthorsebattery"': ["correcthorsebattery"],
        "the key : 1234567890abc and 2024-2025": ["1234567890abc", "2024-2025"],
        "secret:": [],
        "note: nothing, mail: a@b.co, token=": [],
        "user:a@b.co": [],
        "pin:1.2.3.4": [],
        "apikey='x' pass:y/z": ["x", "y/z"],
    }
    for text, want in texts.items():
        taken = [s for spans in pii.base_spans(text).values() for s in spans]
        assert [text[a:b] for a, b in pii.candidates(text, taken)] == want, text
    text = "password: hunter2"
    assert pii.votes(text, (10, 17))[1:3] == (1, 1)


def test_short_secrets_are_found(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 9)))
    texts = []
    for i in range(300):
        body = " ".join(word() for _ in range(30))
        key = [f"PIN: {r.randrange(1000, 9999)}", f"password={word()}{r.randrange(100)}", f"token: {r.randrange(10**11)}abc"][i % 3]
        texts.append(f"{body} {key if i % 5 == 0 else ''} in 2024-2025 page-1234567 {body}")
    docs = spark.createDataFrame(list(enumerate([*texts, "PIN: 4821", "password: hunter2"])), "doc_id int, text string")
    rows = pii.find_personal_data(docs).sort("doc_id").collect()
    assert [[s["kind"] for s in r["pii_spans"]] for r in rows[-2:]] == [[pii.SECRET]] * 2
    assert all(not r["pii_spans"] for i, r in enumerate(rows[:-2]) if i % 5)


def test_em_trusts_the_better_labeler():
    patterns = {(1, 1, -1, 1): 50, (0, -1, 0, 0): 400, (1, -1, -1, -1): 20, (0, 1, -1, -1): 3}
    share, told = pii.reliabilities(patterns)
    assert 0 < share < 1 and told[0][1][1] > 0.9 and told[0][0][0] > 0.9


def test_registered_query(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for row in QUERIES["op9_pii"](spark, data).collect():
        want = plain(texts[row["doc_id"]])
        assert [row[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert row["spans"].startswith(joined)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
