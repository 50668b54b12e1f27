from lumenshelf.operators.snapshots import TTL_MS, ReviewSnapshots


def key(k):
    return "near:" + f"{k:064x}"


def outcomes(frame):
    return {r["review_id"]: (r["outcome"], sorted(r["removed"])) for r in frame.collect()}


def test_decisions_are_checked_against_what_was_shown(spark, tmp_path):
    shots = ReviewSnapshots(spark, str(tmp_path))
    members = spark.createDataFrame([(key(1), "s", 1), (key(1), "s", 2), (key(1), "s", 3), (key(2), "t", 4), (key(2), "t", 5), (key(3), "s", 6), (key(3), "s", 7)], "review_id string, space_id string, id long")
    shots.take(members, {"s": 1, "t": 1}, 1_000_000)
    assets = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6)], "id long")  # 7 has gone
    asked = spark.createDataFrame([(key(1), 1, [2, 3]), (key(2), 9, []), (key(3), 6, None), (key(4), None, [1]), ("exact:x", None, [1]), (None, None, [1])], "review_id string, keep long, removals array<long>")
    want = {key(1): ("accepted", [2, 3]), key(2): ("foreign", []), key(3): ("gone", []), key(4): ("stale", []), "exact:x": ("invalid", []), None: ("invalid", [])}
    assert outcomes(shots.decided(asked, assets, {"s": 1, "t": 1}, 1_000_000 + TTL_MS)) == want
    # Too late, or the vectors of the space have moved on.
    assert outcomes(shots.decided(asked, assets, {"s": 1, "t": 1}, 1_000_001 + TTL_MS))[key(1)] == ("stale", [])
    assert outcomes(shots.decided(asked, assets, {"s": 2, "t": 1}, 1_000_000))[key(1)] == ("stale", [])
    # Shown again: decided on again, and what is too old is removed from the folder.
    shots.take(members.where("space_id = 's'"), {"s": 2}, 2_000_000 + TTL_MS)
    assert outcomes(shots.decided(asked, assets, {"s": 2, "t": 1}, 2_000_000 + TTL_MS)) == want | {key(2): ("stale", [])}
    assert sum(p.name.startswith("members-") for p in tmp_path.iterdir()) == 1


def test_nothing_shown(spark, tmp_path):
    asked = spark.createDataFrame([(key(1), None, [1])], "review_id string, keep long, removals array<long>")
    assert outcomes(ReviewSnapshots(spark, str(tmp_path)).decided(asked, spark.range(3), {}, 5)) == {key(1): ("stale", [])}
