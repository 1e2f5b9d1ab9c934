import itertools
import random
import re

from voxloom.llm.quotations import conversations

SCHEMA = "conv_id long, turn long, role string, text string, position int"


def test_threads(spark):
    rows = [
        (1, 0, "a", "Hello there\nHow are you?", 0), (1, 1, "b", "Another topic", 0),
        (1, 2, "c", "> hello   THERE\n> how are you?\nFine", 0), (1, 3, "d", "> another topic\nYes", 0),
        (1, 4, "e", ">> Hello there\n>> how are you?\n> Fine\nGood", 0), (1, 5, "f", "> Not said by anyone\nOk", 0),
        (2, 0, "a", "> hello there\n> how are you?", 0), (2, 1, "b", None, 0), (None, None, "x", "", 0), (2, 1, "b", None, 0),
    ]
    for block in (65536, 2):
        got = conversations(spark.createDataFrame(rows, SCHEMA), block_rows=block).collect()
        assert len(got) == len(rows)
        of = {(r.conv_id, r.turn): r for r in got}
        assert [of[1, t].reply_to for t in range(6)] == [None, None, 0, 1, 2, None]
        assert [of[1, t].thread for t in range(6)] == [0, 1, 0, 1, 0, 5]
        assert [of[1, t].depth for t in range(6)] == [0, 0, 1, 1, 2, 0]
        assert [of[1, t].position for t in range(6)] == [0, 3, 1, 4, 2, 5]
        assert of[1, 4].text == "Good" and (of[1, 4].n_quotes, of[1, 4].n_linked) == (2, 2)
        assert of[2, 0].reply_to is None and of[2, 0].text == "" and of[2, 1].text is None
        assert sorted(r.position for r in got if r.conv_id == 2) == [0, 1, 2]
    assert conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_latest_earlier_turn_and_long_chains(spark):
    rows = [(7, 0, "a", "line 0", 0)] + [(7, t, "a", f"> line {t - 1}\nline {t}", 0) for t in range(1, 40)]
    rows += [(7, 40, "a", "line 3", 0), (7, 41, "b", "> Line 3", 0)]
    got = {r.turn: r for r in conversations(spark.createDataFrame(rows, SCHEMA), block_rows=8).collect()}
    assert got[41].reply_to == 40 and got[39].depth == 39 and got[39].thread == 0
    assert [got[t].position for t in range(42)] == list(range(42))


def normal(text):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", text.lower()))


def in_order(lines, said):
    rest = iter(said)
    return all(line in rest for line in lines)


def brute(rows):
    """(turn, reply_to, thread, depth, n_quotes, n_linked, text) of the messages of one conversation, in order of turns."""
    offers, out, by_turn = [], [], {}
    for turn, text in sorted(rows):
        lines = []
        for line in text.split("\n"):
            marks = re.match(r"[ \t]*>[> \t]*", line)
            lines.append((marks[0].count(">") if marks else 0, line[len(marks[0]) if marks else 0 :]))
        runs = [(k, [normal(x) for _, x in g]) for k, g in itertools.groupby(lines, key=lambda x: x[0]) if k]
        passages = [(level, [x for x in run if x]) for level, run in runs if any(run)]
        own = "\n".join(x for level, x in lines if not level)
        linked = []
        for level, quoted in passages:
            passage = " ".join(quoted)
            at = [t for t, parts, _ in offers if passage in parts]
            if not at and len(quoted) > 1:
                at = [t for t, _, said in offers if in_order(quoted, said)]
            if at:
                linked.append((level, len(passage), max(at)))
        up = max(((n, t) for level, n, t in linked if level == 1), default=(0, None))[1]
        thread, depth = (by_turn[up][0], by_turn[up][1] + 1) if up is not None else (turn, 0)
        by_turn[turn] = (thread, depth)
        parts = {normal(x) for x in [own, *re.split(r"\n\s*\n", own), *own.split("\n")]} - {""}
        offers.append((turn, parts, [x for x in map(normal, own.split("\n")) if x]))
        out.append((turn, up, thread, depth, len(passages), len(linked), own))
    return out


def test_against_brute_force(spark):
    rng, rows = random.Random(3), []
    pool = ["Yes", "no, I think", "the Third line", "a b", "more of it"]
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 9)):
            text = []
            for _ in range(rng.randint(0, 4)):
                kind = rng.random()
                if kind < 0.5 and said:
                    old = rng.choice(said).split("\n")
                    part = [rng.choice(old)] if rng.random() < 0.4 else [x for x in old if rng.random() < 0.7]
                    text += [rng.choice(["> ", ">", " >  "]) + (x.upper() if rng.random() < 0.5 else x) for x in part]
                elif kind < 0.6:
                    text += ["> never said", ""]
                else:
                    text += [rng.choice(pool) for _ in range(rng.randint(1, 3))] + [""] * rng.randint(0, 1)
            said.append("\n".join(text))
            rows.append((conv, turn, "r", said[-1], 0))
    got = conversations(spark.createDataFrame(rows, SCHEMA), block_rows=4).collect()
    for conv in range(12):
        own = sorted((r.turn, r.reply_to, r.thread, r.depth, r.n_quotes, r.n_linked, r.text) for r in got if r.conv_id == conv)
        assert own == brute([(t, x) for c, t, _, x, _ in rows if c == conv])
        order = [(r.thread, r.turn) for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)]
        assert order == sorted(order)
    assert any(r.n_linked for r in got) and any(r.depth > 1 for r in got)


def test_trimmed_quotes(spark):
    rows = [
        (1, 0, "a", "one\ntwo\nthree\nfour", 0), (1, 1, "b", "two", 0), (1, 2, "c", "three\nmore\ntwo", 0),
        (1, 3, "d", "> two\n> three\nok", 0), (1, 4, "e", "> one\n>\n> four\nok", 0), (1, 5, "f", "> three\n> two", 0), (1, 6, "g", "> four\n> one", 0),
    ]
    got = {r.turn: r.reply_to for r in conversations(spark.createDataFrame(rows, SCHEMA), block_rows=2).collect()}
    assert [got[t] for t in range(7)] == [None, None, None, 0, 0, 2, None]
