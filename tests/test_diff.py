from datetime import datetime

from pyspark.sql import functions as F

from siltstone.functions.words import squeezed, word32
from siltstone.operators.diff import diff_copies

T = [datetime(2024, 1, d) for d in range(1, 9)]
SCHEMA = "k string, v string, w string, at timestamp, _key int, _side string"


def run(spark, a, b):
    mk = lambda rows: spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    v, w = F.col("v"), F.col("w")
    df = diff_copies(mk(a), mk(b), F.coalesce("k", F.lit("")), "at", {"v": (v, v), "w": (w, w)})
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_missing_changed_and_latest(spark):
    a = [("a", "1", "x", T[0]), ("a", "2", "x", T[1]), ("b", "1", None, T[0]), ("c", "1", "y", T[0])]
    b = [("a", "1", "x", T[0]), ("a", "3", "x", T[1]), ("b", "1", " ", T[5]), ("d", "1", "y", T[0])]
    assert run(spark, a, b) == {("a", "v", "changed"), ("c", "*", "only_first"), ("d", "*", "only_second")}


def test_nulls_repeats_and_ties(spark):
    a = [(None, None, None, None)] * 3 + [("a", "1", "x", None), ("a", "2", "x", T[0])]
    b = [(None, None, "", None), ("a", "2", "x", None)]
    assert run(spark, a, b) == set()
    assert run(spark, [("a", "1", None, T[0]), ("a", "9", None, T[0])], [("a", "9", None, T[3])]) == set()


def test_empty(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("a", "1", "x", T[0])], []) == {("a", "*", "only_first")}


def test_long_values_and_many_rows(spark):
    long = "z" * 1_000_000
    a = [("a", long, "x", T[0])] + [(f"k{i:05d}", "1", "x", T[0]) for i in range(3000)] + [("hot", str(i), "x", T[0]) for i in range(3000)]
    b = [("a", long + "!", "x", T[0])] + [(f"k{i:05d}", "2" if i % 100 == 0 else "1", "x", T[0]) for i in range(3000)] + [("hot", "2999", "x", T[0])]
    got = run(spark, a, b)
    assert got == {("a", "v", "changed")} | {(f"k{i:05d}", "v", "changed") for i in range(0, 3000, 100)} | ({("hot", "v", "changed")} if max(map(str, range(3000))) != "2999" else set())


def test_children(spark):
    schema = "k string, at timestamp, items array<struct<id:string, e:string, extra:int>>"
    a = [("r", T[0], [("1", "a b", 1), ("1", "a b", 2), None, ("2", "x", 1), (None, "n", 1)]), ("s", T[0], None), ("t", T[0], [("9", "x", 0)])]
    b = [("r", T[0], [("2", "x", 3), ("1", "a  b", 1), ("3", "x", 1), ("4", "x", 1), (None, "n", 0)]), ("s", T[0], []), ("u", T[0], [("1", "", 0)])]
    df = diff_copies(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), F.col("k"), "at", children="items", child_key="id", child_fields={"e": lambda c: squeezed(c["e"])})
    assert sorted(tuple(r) for r in df.collect()) == [("r", "3", "only_second"), ("r", "4", "only_second"), ("t", "*", "only_first"), ("u", "*", "only_second")]
    b[0] = ("r", T[0], [("1", "ac", 1), ("2", None, 1)])
    df = diff_copies(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), F.col("k"), "at", children="items", child_key="id", child_fields={"e": lambda c: squeezed(c["e"])})
    assert {tuple(r) for r in df.collect() if r[0] == "r"} == {("r", "1.e", "changed"), ("r", "2.e", "changed"), ("r", "", "only_first")}


def test_word32(spark):
    cases = [("0x10", 16), (" 0X1F\t", 31), ("-1", 2**32 - 1), ("123", 123), ("1Fh", 31), ("0b101", 5), ("zz", None), ("", None), (None, None), ("0x", None), ("12.0", 12), ("0800_0000h", 2**27), ("-0x1", 2**32 - 1)]
    long = [7 * 10**24 + 123456789, 10**18 - 1, 10**18, 3**200]
    cases += [(str(n), n % 2**32) for n in long] + [(f"-{n}", -n % 2**32) for n in long] + [(hex(n), n % 2**32) for n in long] + [(bin(n), n % 2**32) for n in long] + [(oct(n), n % 2**32) for n in long]
    df = spark.createDataFrame(cases, "t string, want bigint").select("t", "want", word32(F.col("t")).alias("got"))
    assert [r for r in df.collect() if r.got != r.want] == []
