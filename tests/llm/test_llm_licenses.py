import numpy as np

from ledgerlens.llm import licenses

NOTICE = licenses.NOTICES[1][1]
TEMPLATES = [(k, name, text) for k, (name, text) in enumerate(licenses.NOTICES)]


def whole_alignment(template, words):
    """Best local score over the whole table, by the definition."""
    table = np.zeros((len(template) + 1, len(words) + 1), int)
    for i in range(1, len(template) + 1):
        for j in range(1, len(words) + 1):
            same = 2 if template[i - 1] == words[j - 1] else -1
            table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max()


def scan(spark, rows, templates=TEMPLATES, threshold=0.8):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    known = spark.createDataFrame(templates, "template_id int, license string, text string")
    return licenses.license_matches(docs, known, {"doc_id": "doc_id"}, threshold=threshold).collect()


def test_notices_are_found_with_their_spans(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    edited = NOTICE.replace("obtain", "get").replace("in compliance", "in full compliance")
    rows = [(1, filler + NOTICE + " " + filler), (2, filler + edited), (3, filler), (4, None), (5, ""),
            (6, "ALL RIGHTS RESERVED."), (6, "ALL RIGHTS RESERVED."), (7, "İ " + "All rights reserved"),
            (None, "Released under the MIT License.\n" * 3), (8, filler * 100 + "Licensed under CC BY-NC 4.0")]
    found = scan(spark, rows)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert {k: [m["license"] for m in v] for k, v in by_doc.items()} == {
        1: ["Apache-2.0"], 2: ["Apache-2.0"], 6: ["proprietary"] * 2, 7: ["proprietary"],
        None: ["MIT"] * 3, 8: ["CC-BY-NC-4.0"]}
    text = dict(rows[:2])
    assert text[1][by_doc[1][0]["start"] : by_doc[1][0]["end"]] == NOTICE
    assert by_doc[1][0]["coverage"] == 1.0 and 0.8 <= by_doc[2][0]["coverage"] < 1.0
    assert rows[7][1][by_doc[7][0]["start"] : by_doc[7][0]["end"]] == "All rights reserved"


def test_band_alignment_equals_the_whole_table():
    random = np.random.default_rng(0)
    for _ in range(60):
        template = random.integers(0, 6, random.integers(4, 14))
        words = np.concatenate([random.integers(0, 6, random.integers(0, 8)), template, random.integers(0, 6, 4)])
        for _ in range(random.integers(0, 3)):
            words = np.delete(words, random.integers(0, len(words)))
        matched, first, last = licenses.align(template, words, -len(template), len(words))
        part = words[first : last + 1]
        assert whole_alignment(template, part) == whole_alignment(template, words)
        assert matched <= min(len(template), len(part))


def test_every_shared_stretch_holds_a_fingerprint():
    random = np.random.default_rng(1)
    hashes = random.integers(0, 2**60, 200).astype(np.uint64)
    prints = set(licenses.winnow(hashes, licenses.WINDOW).tolist())
    assert all(prints & set(range(i, i + licenses.WINDOW)) for i in range(200 - licenses.WINDOW + 1))


def test_templates_in_several_passes_and_odd_ones(spark, monkeypatch):
    rows = [(1, "All rights reserved. Released under the MIT License")]
    odd = TEMPLATES + [(90, None, "a b c d"), (91, "none", None), (92, "none", "!!!"), (93, "none", "two words")]
    whole = scan(spark, rows, odd)
    monkeypatch.setattr(licenses, "PASS_WORDS", 60)
    assert sorted(map(tuple, scan(spark, rows, odd))) == sorted(map(tuple, whole)) and len(whole) == 2
    assert scan(spark, rows, odd[-4:]) == []


def test_every_near_copy_of_a_short_notice_is_found(spark):
    """Each notice with one word left out, changed or put in, against alignment with every template."""
    short = [t for t in TEMPLATES if len(licenses.WORD.findall(t[2])) <= 14]
    texts = [(0, "Licensed under Apache License, Version 2.0"), (1, "Released under the MIT Licence"),
             (2, "Released under an MIT License"), (3, "Released under MIT License")]
    for _, _, notice in short:
        words = notice.split()
        for i in range(len(words)):
            for new in ([], ["other"], [words[i], "other"]):
                texts.append((len(texts), "x " + " ".join(words[:i] + new + words[i + 1 :]) + " y"))
    want = set()
    for k, text in texts:
        words = licenses.WORD.findall(text.lower())
        for _, _, notice in TEMPLATES:
            known = licenses.WORD.findall(notice.lower())
            number = {w: n for n, w in enumerate({*words, *known})}
            both = (np.array([number[w] for w in ws]) for ws in (known, words))
            matched, _, _ = licenses.align(*both, -len(known), len(words))
            if matched >= 0.8 * len(known):
                want.add(k)
    assert {r["doc_id"] for r in scan(spark, texts)} == want and {0, 1, 2, 3} <= want


def test_repeated_lines_and_short_templates_have_a_row_each(spark):
    rows = [(1, "All rights reserved.\n" * 50), (2, "Released under MIT License\n" * 7), (3, "Copyright X. Copyright Y")]
    found = [r["doc_id"] for r in scan(spark, rows, TEMPLATES + [(50, "none", "copyright")])]
    assert [found.count(k) for k in (1, 2, 3)] == [50, 7, 2]


def test_more_licenses_have_their_own_row():
    templates = licenses.Templates(TEMPLATES, 0.8)
    for _, license_, text in TEMPLATES[14:]:
        (found,) = templates.scan("Copyright X. " + text + " End of the file.")
        assert found[1] == license_ and found[6] == 1.0
    assert len(TEMPLATES) >= 20
