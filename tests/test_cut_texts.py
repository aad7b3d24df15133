"""Texts cut off behind an assignment in a loop, through the operators that read loops."""

import pytest

from siltstone.operators import code, roots
from siltstone.plans import mining

KEYS = ["binary_id", "function_name"]


@pytest.fixture
def cut(spark):
    text = "u = *(uint *)0x40011000; while (*(uint *)0x40011000 & 1) { u = 1; } for (i = 0; i < n; i++) { a[i] ="
    return spark.createDataFrame([("b", "f", 1, text)], "binary_id string, function_name string, function_address int, code string")


def test_finds(cut):  # F4
    assert {(r.find, r.expr) for r in roots.finds(cut, KEYS).collect()} == {("loop_bound", "n")}


def test_loop_sinks(cut):  # F5
    assert [r.bound for r in mining.loop_sinks(cut).collect()] == ["n"]


def test_loops(cut):  # F9
    assert [(r.loop_kind, r.bound) for r in code.loops(cut, KEYS, "code").collect()] == [("while", None), ("for", "n")]


def test_register_reads(cut):  # F10
    accesses = mining.access_index(cut)
    assert [r.target_addr for r in mining.polled(accesses, cut).collect()] == [0x40011000]
    assert [r.address for r in mining.register_reads(accesses, polls=mining.polled(accesses, cut)).collect()] == [0x40011000]
