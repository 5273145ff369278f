"""Merged history of an owner is made in batches, not from a whole group in memory."""


from siteloom.operators import reports


def plain(listed, came, most):
    for site, entry in came:
        at = next((k for k, (s, _) in enumerate(listed) if s == site), None)
        if at is None:
            listed = [(site, entry), *listed][:most]
        else:
            listed[at] = (site, entry)
    return listed


def test_batches_of_ten_rows_and_earlier_lists(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = [(o, (k * 7919) % 1000, f"s{(k * k) % 29}", f"e{k}") for o in (1, 2, None) for k in range(150)] + [(1, 3000, None, "x")]
        before = [(1, 1, "s4", "old"), (1, 0, "gone", "old"), (5, 0, "kept", "old")]
        arrivals = spark.createDataFrame(rows, "owner long, ord int, site string, entry string").repartition(7)
        merged = reports.merged_history(spark.createDataFrame(before, "owner long, place int, site string, entry string"), arrivals, 6)
        assert "MapInArrow" in merged._jdf.queryExecution().toString() and "CoGroup" not in merged._jdf.queryExecution().toString()
        got = {}
        for r in merged.orderBy("owner", "place").collect():
            got.setdefault(r.owner, []).append((r.site, r.entry))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {5: [("kept", "old")]}
    for o in (1, 2, None):
        came = [(s, e) for w, _, s, e in sorted((r for r in rows if r[0] == o), key=lambda r: r[1]) if s]
        expected[o] = plain([("gone", "old"), ("s4", "old")] if o == 1 else [], came, 6)
    assert got == expected
