"""Missing references pass through the dictionary and the bitmaps like all others."""

from datetime import datetime

from siltstone.operators import references

REFS = "k string, row int, at timestamp_ntz"
ITEMS = "k string, born timestamp_ntz, died timestamp_ntz"


def test_missing_come_out_of_the_and_not(spark, monkeypatch):
    t = datetime(2024, 3, 5)
    r = spark.createDataFrame([("a", 0, t), ("x", 1, t), ("y", 2, t), ("y", 3, None), ("a", 4, None), (None, 5, t)], REFS)
    p = spark.createDataFrame([("a", datetime(2024, 1, 1), None), ("z", t, None)], ITEMS)
    sizes, opened = [], []
    encode, and_not = references.encode_keys, references.and_not
    monkeypatch.setattr(references, "encode_keys", lambda *a: (d := encode(*a), sizes.append(d.count()))[0])
    monkeypatch.setattr(references, "and_not", lambda *a: (d := and_not(*a), opened.append(d.count()))[0])
    out = references.orphan_references(r, p, ["k"], "at", "born", "died")
    assert sorted((x.k, x.row, x.reason) for x in out.collect()) == [("x", 1, "missing"), ("y", 2, "missing"), ("y", 3, "missing")]
    # a, x, y and z are coded; x, y and the two without time stay open, a in March is covered.
    assert sizes == [4] and opened == [4]
