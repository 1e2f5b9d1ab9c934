"""The operators that return rows keep columns of any name, those that they use inside among them."""

import os
import re

import pytest
import voxloom.llm
from voxloom.llm import exact_dedup, ngram_join, quality, suffix_dedup

PROSE = " ".join(f"w{i * i % 1009}" for i in range(70))
CALLS = {"exact_dedup": exact_dedup.deduplicate, "ngram_join": ngram_join.deduplicate, "quality": quality.clean, "suffix_dedup": suffix_dedup.deduplicate}


def inner_names(module):
    """Every short text of a module that could be the name of a column."""
    path = os.path.join(os.path.dirname(voxloom.llm.__file__), f"{module}.py")
    with open(path) as file:
        found = set(re.findall(r"[\"'](\w{1,20})[\"']", file.read())) - {"doc_id", "text", "source"}
    return sorted({n.lower(): n for n in found}.values())


@pytest.mark.parametrize("module", sorted(CALLS))
def test_clashing_names(spark, module):
    names = inner_names(module)
    rows = [(i, [PROSE, PROSE + " end", "other words " + PROSE[::-1], None][i % 4], "s", *[f"{n}-{i}" for n in names]) for i in range(6)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    got = CALLS[module](docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert kept and all(r[n] == f"{n}-{r.doc_id}" for r in kept for n in names)
    plain = CALLS[module](docs.select("doc_id", "text", "source")).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted((r.doc_id, r.text or "") for r in plain)
