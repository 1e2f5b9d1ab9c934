from voxloom.operators.model import map_batches


def scaled(factor):
    return lambda: lambda rows: [(x * factor,) for (x,) in rows]


def test_factories_of_one_outer_function_are_told_apart(spark):
    df = spark.range(4).coalesce(1)
    for factor in (1, 2, 5, 1):
        got = map_batches(df, scaled(factor), ["id"], "y long", ["id"]).collect()
        assert [(r.id, r.y) for r in got] == [(i, i * factor) for i in range(4)]


def scorer():
    def call(rows):
        if any(run == "bad" and x == 2 for run, x in rows):
            raise ValueError("two")
        return [(float(len(run) * x),) for run, x in rows]

    return call


def test_runs_are_looped_over_in_the_worker(spark, monkeypatch):
    from voxloom.plans import report

    samples = spark.range(5, numPartitions=2).withColumnRenamed("id", "sample_index")
    runs = spark.createDataFrame([("bad", 2), ("a", 3), ("longer", 1)], "run string, place int")
    found = []
    for block in (1024, 2):
        monkeypatch.setattr(report, "RUNS", block)
        scored = report.evaluate_runs(samples, runs, scorer, ["sample_index"], ["y"], order="place", batch=3)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") == -(-3 // block) and "Join" not in plan
        found.append(sorted(map(tuple, scored.select("checkpoint", "ckpt_ord", "sample_index", "value", "error").collect()), key=repr))
    assert found[0] == found[1]
    want = [(r, o, i, None if r == "bad" and i == 2 else float(len(r) * i), "ValueError: two" if r == "bad" and i == 2 else None)
            for o, r in enumerate(["longer", "bad", "a"]) for i in range(5)]
    assert found[0] == sorted(want, key=repr)
