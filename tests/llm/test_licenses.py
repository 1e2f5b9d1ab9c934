import random
import re
import time
from collections import Counter

import pytest
from voxloom.llm.licenses import TEMPLATES, Scanner, scan

SCHEMA = "doc_id long, text string, license string"


def test_matches(spark):
    lines = [TEMPLATES["mit-notice"], TEMPLATES["mit"]]
    noisy = TEMPLATES["mit"].replace("free of charge", "free of any charge").replace("obtaining", "receiving")
    texts = [None, "", "nothing here", f"é start {lines[0]} end", f"x {noisy} y", f"{lines[0]}\nmore words\n{lines[0]}", "released under the", "w " * 20000 + lines[1].upper()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = sorted(map(tuple, scan(df).collect()))
    assert [(r[0], r[1]) for r in got] == [(3, "mit-notice"), (4, "mit"), (5, "mit-notice"), (5, "mit-notice"), (7, "mit")]
    one = got[0]
    assert texts[3].encode()[one[5] : one[6]].decode() == "Released under the MIT License" and one[4] == 1.0
    assert got[1][2] == got[1][3] - 1 and texts[4][got[1][5] : got[1][6]] == noisy.rstrip(".")
    assert scan(df.limit(0)).count() == 0 and scan(df, {}).count() == 0


LINES = {
    r"Licensed under CC BY-NC \d\.\d\.": "cc-by-nc-notice", r"All rights reserved\.": "reserved", r"Released under the MIT License\.": "mit-notice",
    r"Licensed under the Apache License, Version 2\.0\.": "apache-notice",
    r"This work is licensed under the GNU General Public License, version \d\.": "gpl-notice",
}


def test_all_license_lines_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text RLIKE 'icense|rights reserved'")
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        for pattern, name in LINES.items():
            want[r.doc_id, name] += len(re.findall(pattern, r.text))
    got = Counter((r.id, r.license) for r in scan(docs).collect())
    assert +want == got and sum(want.values()) == 328


def test_every_template_is_told_apart_from_the_others():
    scanner = Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        found = list(scanner.scan([f"some words {text} and others".encode()]))
        assert [(f[1], f[4]) for f in found] == [(name, 1.0)]


@pytest.mark.parametrize("name", ["mit-notice", "cc-by-nc-notice"])
def test_one_replaced_word_of_a_short_notice(name):
    words = TEMPLATES[name].split()
    for i in range(len(words) - ("CC" in words)):
        text = " ".join(["before", "it", *words[:i], "replaced", *words[i + 1 :], "after", "it"])
        assert name in [f[1] for f in Scanner({name: TEMPLATES[name]}).scan([text.encode()])]


def test_many_notices_in_one_text():
    """The work follows the text, however many notices follow each other."""
    took = {}
    for n in (1000, 8000):
        begun = time.process_time()
        found = list(Scanner(TEMPLATES).scan([b"All rights reserved. " * n]))
        took[n] = time.process_time() - begun
        assert len(found) == n and {(f[1], f[4]) for f in found} == {("reserved", 1.0)}
        assert [f[5] for f in found] == list(range(0, 21 * n, 21))
    assert took[8000] < 24 * max(took[1000], 0.2)


def best_alignment(words, template, low, high):
    """The highest score of a local alignment on the diagonals low..high, by the whole matrix."""
    score, best = {}, 0
    for j, want in enumerate(template):
        for i, word in enumerate(words):
            if low <= i - j <= high:
                step = score.get((i - 1, j - 1), 0) + (2 if word == want else -1)
                score[i, j] = max(0, step, score.get((i - 1, j), 0) - 1, score.get((i, j - 1), 0) - 1)
                best = max(best, score[i, j])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_alignment_against_the_whole_matrix(seed):
    rng = random.Random(seed)
    scanner = Scanner({"x": "one two three"})
    for _ in range(40):
        template = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        words = [rng.randrange(6) for _ in range(rng.randint(1, 25))]
        low = rng.randint(-6, 10)
        high = low + rng.randint(0, 9)
        matched, first, last = scanner._align(words, template, low, high)
        want = best_alignment(words, template, low, high)
        if want == 0:
            assert matched == 0
            continue
        # The words it names hold an alignment of the best score with that many matches.
        part = best_alignment([w if first <= i <= last else None for i, w in enumerate(words)], template, low, high)
        assert part == want and matched <= min(len(template), last - first + 1) and 2 * matched >= want
