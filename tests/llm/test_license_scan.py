import random

from newsloom.llm import license_scan as L

from small import documents

INDEX = L.Index(L.TEMPLATES)


def slow_score(template, words):
    """Best local alignment score over all cells, no band."""
    best, above = 0, [0] * (len(words) + 1)
    for t in template:
        row = [0] * (len(words) + 1)
        for k, w in enumerate(words, 1):
            row[k] = max(0, above[k - 1] + (L.MATCH if t == w else L.MISS), above[k] + L.GAP, row[k - 1] + L.GAP)
        best, above = max(best, *row), row
    return best


def test_windows_hold_every_long_run():
    for ids in INDEX.words:
        places = L.winnowed(INDEX.grams(ids))
        assert all(any(a <= p < a + L.WINDOW for p in places) for a in range(max(1, len(ids) - L.GRAM - L.WINDOW + 2)))


def test_whole_templates_are_covered():
    for name, template in L.TEMPLATES.items():
        text = "É some words before.\n" + template + "\nThe words after that."
        hit = [m for m in L.matches(text, INDEX) if m[0] == name]
        assert len(hit) == 1 and hit[0][1] == 1.0
        assert text[hit[0][3]:hit[0][4]] == template.strip("./") or text[hit[0][3]:hit[0][4]] in template


def test_edited_templates_against_the_whole_table():
    r = random.Random(3)
    for name, template in L.TEMPLATES.items():
        words = template.split()
        if len(words) < 20:
            continue
        for _ in range(3):
            changed = [w for w in words if r.random() > 0.08]
            for _ in range(len(words) // 15):
                changed.insert(r.randrange(len(changed)), "other")
            text = "noise here " * 20 + " ".join(changed) + " more noise" * 20
            own = [m for m in L.matches(text, INDEX) if m[0] == name]
            number = INDEX.names.index(name)
            ids = [INDEX.vocabulary[w] for w in L._WORD.findall(text.lower())]
            template_ids = INDEX.words[number].tolist()
            assert len(own) == 1 and own[0][1] > 0.7
            whole = slow_score(template_ids, ids)
            matched, a, b, c, d = L.align(template_ids, ids, 40, len(template_ids) // 8)
            assert matched == own[0][2] and 2 * matched - (b - a - matched) - (d - c - matched) <= whole <= 2 * matched


def test_repeated_lines_and_clean_texts(spark):
    line = L.TEMPLATES["mit-line"]
    rows = documents() + [(50, f"{line}\n{line} {line}", None), (51, "The license of the work is not here, under the tree.", None), (52, line.upper(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS start", "2 AS license")
    got = [(r.doc_id, r.license, r.start, r.end, r.coverage) for r in L.licenses(docs).collect()]
    n = len(line)
    assert sorted(got) == [(50, "mit-line", k * (n + 1), k * (n + 1) + n - 1, 1.0) for k in range(3)] + [(52, "mit-line", 0, n - 1, 1.0)]
    assert L.licenses(docs.limit(0)).collect() == []


def test_letters_whose_lower_case_is_longer():
    line = L.TEMPLATES["mit-line"]
    for before in ("İstanbul İzmir. ", "İİ İ " * 30):
        text = before + line
        assert [(m[0], text[m[3]:m[4]]) for m in L.matches(text, INDEX)] == [("mit-line", line.strip("."))]


def test_template_table(spark):
    own = "You may read this text aloud on any day but Monday, to whoever listens."
    told = spark.createDataFrame([("own-1", own), ("none", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "İ " + own.upper()), (2, L.TEMPLATES["mit"])], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.start, r.coverage) for r in L.licenses(docs, told).collect()] == [(1, "own-1", 2, 1.0)]


def test_kinds_of_notices_are_told_apart():
    for name in ("lgpl-2.1-header", "agpl-3.0-header", "gpl-3.0-header", "epl-2.0-header", "unlicense", "cc-by-4.0-line", "bsd-3-clause"):
        found = L.matches("Before it. " + L.TEMPLATES[name], INDEX)
        assert max(found, key=lambda m: (m[1], m[2]))[0] == name
