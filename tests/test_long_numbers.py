"""Numbers in program text that no 64-bit column holds."""

from siltstone.operators import code
from siltstone.plans import mining


def test_register_reads_beside_long_numbers(spark):  # F10
    text = "u = *(uint *)0x40011000; v = *(uint *)0x400110004001100040; w = *(uint *)(p + 0xffffffffffffffff); x = *(uint *)DAT_40011000400110004; y = *(uint *)0x7fffffffffffffff;"
    long = spark.createDataFrame([("b", "f", 1, text)], "binary_id string, function_name string, function_address int, code string")
    found = code.memory_accesses(long, ["function_name"], "code").orderBy("seq").collect()
    assert [(r.shape, r.number) for r in found] == [("constant", 0x40011000), ("constant", None), ("constant_offset", None), ("constant", None), ("constant", 0x7FFFFFFFFFFFFFFF)]
    assert 0x40011000 in [r.address for r in mining.register_reads(mining.access_index(long)).collect()]
