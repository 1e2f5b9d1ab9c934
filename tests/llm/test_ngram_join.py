import random
import re

import pytest
from voxloom.llm.ngram_join import components, deduplicate, floor_, prefix_length

SCHEMA = "doc_id long, text string, sig string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, part=85):
    sets = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for i, (doc, *_) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((doc, len(sets[i]), least[root(i)]) for i, (doc, *_) in enumerate(rows)), key=repr)


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def table(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(pool) for _ in range(12))
    rows = [(1000, None, "a", 1), (1001, "", "b", 2), (1002, " \n", "c", 3), (1003, "One two", "d", 4), (1004, "one  TWO", "e", 5), (1005, "two one", "f", 6)]
    doc = 0
    for _ in range(12):
        base = [rng.choice(pool) for _ in range(rng.choice([5, 8, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 4])):
            rows.append((doc, near(rng, base, rng.randrange(4)), "s", 0))
            doc += 1
    center = [rng.choice(pool) for _ in range(130)]
    for _ in range(60):  # a group that is linked through its centre
        rows.append((doc, near(rng, center, rng.choice([0, 1, 2, 3, 5])), "s", 0))
        doc += 1
    rows += [(doc + i, line + " " + " ".join(rng.choice(pool) for _ in range(10)), "s", 0) for i in range(20)]
    rows += [(2000 + i, rows[20][1], "s", 0) for i in range(5)] + rows[8:10] + [(None, rows[30][1], "s", 0)]
    return rows


@pytest.mark.parametrize("seed,hot,rows", [(1, 1 << 17, 512), (2, 5, 7), (3, 0, 3)])
def test_against_brute_force(spark, seed, hot, rows):
    data = table(seed)
    got = components(spark.createDataFrame(data, SCHEMA), hot=hot, rows=rows).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data)


def test_deduplicate_and_empty(spark):
    data = table(4)
    df = spark.createDataFrame(data, SCHEMA)
    kept = deduplicate(df)
    assert kept.columns == df.columns
    want = {d for d, _, c in brute(data) if d == c}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want - {None} and kept.count() == len(want)
    assert components(df.limit(0)).count() == 0


def test_rows_without_an_id_or_with_the_same_id_are_told_apart(spark):
    rng = random.Random(9)
    prose = [[f"v{rng.randrange(10**6)}" for _ in range(60)] for _ in range(5)]
    text = [" ".join(p) for p in prose]
    rows = [
        (1, text[0]), (None, near(rng, prose[0], 1)), (None, text[1]), (None, near(rng, prose[1], 1)), (None, text[2]), (None, text[2]),
        (7, text[3]), (7, text[4]), (7, near(rng, prose[0], 1)), (8, near(rng, prose[3], 1)), (9, text[4]), (9, near(rng, prose[4], 1)),
        (None, ""), (None, " "), (7, None),
    ]
    kept = deduplicate(spark.createDataFrame([(i, t, "s", 0) for i, t in rows], SCHEMA)).collect()
    own = lambda t: [k for k, p in enumerate(text) if t and len(set(t.split()) & set(p.split())) > 50]
    got = sorted(((r.doc_id, own(r.text)) for r in kept), key=repr)
    assert got == sorted([(1, [0]), (None, [1]), (None, [2]), (7, [3]), (7, [4]), (None, []), (None, []), (7, [])], key=repr)


def test_prefix_bound():
    for n in range(1, 300):
        assert 1 <= prefix_length(n, 85) <= n
        for m in range(n, int(n / 0.85) + 1):
            least = -(-85 * (n + m) // 185)
            for x in (n, m):  # what is left after the prefix cannot hold more than least - floor_
                assert least - (x - prefix_length(x, 85)) >= min(floor_(x), x - 0) or prefix_length(x, 85) == x
