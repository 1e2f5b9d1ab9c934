import itertools
import re

import duckdb
from tests.compare import difference
from voxloom.llm.catalog import SQL
from voxloom.llm.quality import LineLimits, clean, judge

SCHEMA = "doc_id long, text string, source string, host string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def prose(seed, n=60):
    return " ".join(f"w{(seed * 7919 + i * i) % 10007}" for i in range(n))


def test_base_measures(spark):
    texts = [None, "", " \n\t", "one", "a b c a b c", "a a a a a a", "x y\nx y\n\n x y", "é # $ | é", prose(3, 400) + " " + prose(3, 90)]
    texts.append("w " * 20000)
    rows = [(i, t, "s", "h") for i, t in enumerate(texts)]
    for r in judge(spark.createDataFrame(rows, SCHEMA)).collect():
        if r.id < len(texts) - 1:
            assert {k: r[k] for k in base("")} == base(texts[r.id])
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        if r.id == len(texts) - 1:
            assert r.n_words == r.n_repeat_words == 20000


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    headers = [" ".join(f"head{k}x{j}" for j in range(15)) for k in range(4)]
    top = [headers[i % 4].upper() if i % 3 else headers[i % 4] for i in range(30)]
    rows = [(i, f"{top[i]}\n{prose(i)}", "s", "h") for i in range(30)]
    rows += [(100 + i, "\n".join(headers) + f"\n{prose(50 + i, 50)}", None if i else "s", "h") for i in range(2)]
    rows += [(200 + i, prose(1000), "s", "h") for i in range(40)]  # copies are no frequent line
    rows += [rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = LineLimits(least=5)
    got = {r.id: r for r in judge(df, limits=limits).collect()}
    assert got[0].lines_removed == 1 and got[0].words_removed == 15 and got[0].kept
    assert got[100].lines_removed == 4 and not got[100].kept and not got[100].base_failed
    assert got[101].lines_removed == 0 and got[101].kept  # another host
    assert all(got[200 + i].kept for i in range(40))
    kept = clean(df, limits=limits)
    assert kept.columns == df.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert 100 not in texts and texts[1] == prose(1) and texts[200] == prose(1000) and kept.count() == len(rows) - 1


def test_pages_mixed_from_a_few_shared_lines_count_each(spark):
    pool = [" ".join(f"pool{k}x{j}" for j in range(12)) for k in range(8)]
    rows = [(i, "\n".join(pool[(i + j * (1 + i % 3)) % 8] for j in range(5)) + f"\nown{i} " + prose(i, 5), "s", "h") for i in range(60)]
    rows += [(100 + i, "\n".join([prose(2000), prose(2001)]).replace(" ", " " * (1 + i % 2)), "s", "h") for i in range(40)]  # true copies
    rows += [(200 + i, prose(3000 + i), "s", "h") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r for r in judge(df).collect()}
    assert all(got[i].lines_removed == 5 and not got[i].kept for i in range(60))
    assert all(got[i].lines_removed == 0 and got[i].kept for i in got if i >= 100)
    assert sorted(r.doc_id for r in clean(df).collect()) == sorted(i for i in got if i >= 100)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert judge(df).count() == 0 and clean(df).count() == 0


def test_sql_counts_distinct_documents(spark):
    """Pages made of a few shared lines in different orders, copies, and hosts with and without a name."""
    shared = [" ".join(f"line{k}x{j}" for j in range(12)) for k in range(6)]
    pages = list(itertools.permutations(shared))[:400]
    rows = [(i, "\n".join(p), "a") for i, p in enumerate(pages)]
    rows += [(1000 + i, "\n".join(pages[0]), None) for i in range(30)] + [(2000 + i, prose(i), ["", None, "a"][i % 3]) for i in range(30)]
    rows += [(3000, None, "a"), (3001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = judge(docs).withColumnRenamed("id", "doc_id").drop("text_key", "host")
    assert difference(got, con, SQL["op7_quality_rules"]) is None
    assert got.where("doc_id < 400 AND kept").count() == 0
