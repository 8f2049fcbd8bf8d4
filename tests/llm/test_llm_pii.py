import hashlib
import random
import re

from ledgerlens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((kind, m.start(), m.end()))
    return spans


def texts():
    draw = random.Random(5)
    signs = "ab1.1@%+-_ 234().5 +0\n😀é@.x-=\"4"
    made = ["".join(draw.choice(signs) for _ in range(draw.randrange(120))) for _ in range(300)]
    made += ["".join(draw.choice("0123456789 -+().") for _ in range(60)) for _ in range(300)]
    made += ["card 4111 1111 1111 1111, a@b.c@d.e a@b.c_d@e.f", "", None, "plain", "7" * 5000, "1-" * 20000,
             "a" * 50000 + "@b.c", "call +1 (415) 555-1234 now", "joe (at) example (dot) com"] * 2
    return made


def test_base_spans_equal_brute_force(spark):
    rows = [(i % 550, t, "x") for i, t in enumerate(texts())] + [(None, "a@b.c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.personal_data(df, {"doc_id": "doc_id"}).collect()
    want = []
    for i, text, _ in rows:
        base = brute(text)
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want.append((i, *[sum(s[0] == k for s in base) for k in PATTERNS], sha))
    assert sorted([tuple(r)[:6] for r in found], key=repr) == sorted(want, key=repr)
    listed = {s for r in found for s in r["spans"].split(",") if s}
    assert {f"{k}:{a}:{b}" for _, t, _ in rows for k, a, b in brute(t)} <= listed


def test_redaction_removes_every_base_span_and_nothing_else(spark):
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts()[-40:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    made = {r["doc_id"]: r for r in pii.redact(df, pii.Model(-1.0, {}, {}), "text", "n_chars").collect()}
    for i, text, _ in rows:
        out, at = "", 0
        spans = sorted(brute(text), key=lambda s: (s[1], s[2], list(PATTERNS).index(s[0])))
        merged = []
        for kind, a, b in spans:
            if merged and a < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], b)
            else:
                merged.append([kind, a, b])
        for kind, a, b in merged:
            out, at = out + text[at:a] + f"<{kind.upper()}>", b
        want = None if text is None else out + text[at:]
        assert made[i]["text"] == want and made[i]["n_chars"] == len(want or "")


def test_labelers_tell_kinds_of_candidates_apart(spark):
    strict = [f"write to user{i}@mail.example.com or call +1 (415) 555-{1000 + i}" for i in range(60)]
    loose = [f"phone (415) 555-{2000 + i} here" for i in range(20)]
    other = [f"version 1.2.3.{300 + i} hash {'9' * 12}{i:04d}x" for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(strict + loose + other)], "doc_id long, text string")
    model = pii.fit(df)
    good, bad = model.reliability["strict"][1]
    assert good > bad
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(df, {"doc_id": "doc_id"}).collect()}
    assert all(spans[i] == "phone:6:20" for i in range(60, 80))
    for i, text in enumerate(strict + loose + other):
        if not 60 <= i < 80:  # nothing beyond the base spans
            assert spans[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(df, {"doc_id": "doc_id"}).count() == 0
    assert pii.redact(df, pii.fit(df)).columns == ["doc_id", "text"]
