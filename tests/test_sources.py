import json
import struct

from pyspark.sql import functions as F

from siltstone.session import clear_scratch, materialize
from siltstone.sources import files, firmware
from siltstone.streaming import incremental


def raw_image():
    w = [0x20002000, 0x08000101, 0x08000111, 0, 0, 0x08000121, 0, 0, 0, 0, 0, 0x08000111, 0, 0, 0, 0x2, 0x08000131, 0x40011000, 0xE000E100]
    return struct.pack(f"<{len(w)}I", *w) + bytes(512)


def elf_image():
    body = struct.pack("<3I", 0x20001000, 0x08000041, 0x08000051) + bytes(116)
    head = b"\x7fELF\x01\x01\x01" + bytes(9) + struct.pack("<HHIIIIIHHHHHH", 2, 40, 1, 0x08000041, 52, 0, 0, 52, 32, 2, 0, 0, 0)
    seg = struct.pack("<8I", 1, 116, 0x08000000, 0, len(body), len(body), 5, 4) + struct.pack("<8I", 1, 0, 0x20000000, 0, 0, 0x800, 6, 4)
    return head + seg + body


def test_images(spark, tmp_path):
    for name, data in (("a.bin", raw_image()), ("b.elf", elf_image()), ("c.bin", b"junk"), ("d.bin", b""), ("e.elf", b"\x7fELF" + bytes(10))):
        (tmp_path / name).write_bytes(data)
    images = firmware.read_images(spark, f"file://{tmp_path}")
    got = {}
    for r in firmware.memory_regions(images).collect():
        got.setdefault(r.binary_id, []).append((r.format, r.name, r.base, r.size, r.permissions, r.isr_handlers, r.stack_pointer))
    assert {k: v[0][0] for k, v in got.items()} == {"a.bin": "raw", "b.elf": "elf", "c.bin": "unknown", "e.elf": "unknown"}
    assert [r[1] for r in got["a.bin"]] == ["FLASH_ALIAS", "FLASH", "SRAM", "PERIPHERAL", "SYSTEM"]
    assert got["a.bin"][0][5] == [0x08000110, 0x08000120] and got["a.bin"][2][3] == 0x2000
    assert [r[1:5] for r in got["b.elf"]][:2] == [("FLASH", 0x08000000, 128, "r-x"), ("SRAM", 0x20000000, 0x800, "rw-")] and got["b.elf"][0][5] == [0x08000050]
    ptr = firmware.words(images.filter("binary_id = 'a.bin'"), 0x08000000, 0x40000000, 0x5FFFFFFF).collect()
    assert [(r.address, r.value) for r in ptr] == [(0x08000000 + 17 * 4, 0x40011000)]


def test_facts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p1", "COPY_SINK", 16, "f", "VERIFIED", 0.5, {"a": "1"}), ("p2", "MMIO_READ", 32, "f", "PARTIAL", 0.7, None), ("p3", "MMIO_READ", 48, "g", "VERIFIED", None, {})], files.FACTS)
    files.write_facts(df, f"{tmp_path}/x")
    back = files.read_facts(spark, f"{tmp_path}/x")
    assert sorted(r.pack_id for r in back.collect()) == ["p1", "p2", "p3"]
    assert [r.pack_id for r in files.select_facts(back, labels=["MMIO_READ"], function="g", verdict="VERIFIED").collect()] == ["p3"]
    assert files.select_facts(back, address=16).count() == 1
    with open(f"{tmp_path}/x/facts/extra.json", "w") as f:
        f.write('{"pack_id": "p4", "later": {"a": 1}}\nnot json\n')
    odd = files.read_facts(spark, f"{tmp_path}/x")
    assert [(r._extra, r._refused) for r in odd.filter("pack_id = 'p4'").collect()] == [({"later": '{"a":1}'}, False)]
    assert [r._line for r in odd.filter("_refused").collect()] == ["not json"]
    hints = files.with_source_hints(back.filter("label = 'COPY_SINK'"), back.filter("label = 'MMIO_READ'"))
    assert hints.first().source_hints == ["MMIO_READ"]
    assert {(r.label, r.verdict, r.n) for r in spark.read.json(f"{tmp_path}/x/index").collect()} == {("COPY_SINK", "VERIFIED", 1), ("MMIO_READ", "PARTIAL", 1), ("MMIO_READ", "VERIFIED", 1)}


def test_manifests_and_csv(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"binary_path": "d/x.elf", "dataset": "m"}, {"dataset": "none"}]))
    (tmp_path / "map.json").write_text(json.dumps({"samples": [{"binary_path": "d/y.bin", "gt_stem": "g", "sample_id": "s"}]}))
    one = files.read_manifest(spark, f"{tmp_path}/list.json").collect()
    assert [(r.sample_id, r.gt_stem, r.output_stem, r.eval_scope) for r in one] == [("x", "x", "x", "auto")]
    two = files.read_manifest(spark, f"{tmp_path}/map.json").collect()
    assert [(r.sample_id, r.gt_stem, r.output_stem) for r in two] == [("s", "g", "y")]
    (tmp_path / "r.csv").write_text("\ufeffBase address,Reg address,Reg name,Reg cat,Model Cat,Read,Write,Correct cat,Comments GT\n0x40000000,0x40000004,CR,CR,CR,1,0,,\"a, b\"\nzz,1,bad,CR,CR,1,1,,\n")
    got = sorted(files.read_registers(spark, f"{tmp_path}/r.csv").collect(), key=lambda r: r._refused)
    assert [tuple(r)[:7] for r in got[:1]] == [(0x40000000, 0x40000004, "CR", "CR", True, False, "")] and [(r._refused, r._line[:3]) for r in got[1:]] == [(True, "zz,")]
    (tmp_path / "g.csv").write_text("adress,name,category,Comments,peripheral\n40011004,DR,DR,,USART1\n")
    assert [tuple(r)[:7] for r in files.read_registers(spark, f"{tmp_path}/g.csv").collect()] == [(0x40011004, 0x40011004, "DR", "DR", True, True, "USART1")]
    files.write_csv(spark.createDataFrame([(1, "a")], "n int, s string"), f"{tmp_path}/out", ["s", "n"])
    assert spark.read.option("header", "true").csv(f"{tmp_path}/out").columns == ["s", "n"]


def test_headers(spark):
    text = "#define A_BASE (0x40000000UL)\n#define B (A_BASE + 0x400UL)\ntypedef struct\n{\n  __IO uint32_t CR;\n  __IO uint16_t SR;\n  uint8_t PAD[2];\n  __IO uint32_t DR; /* Address offset: 0x10 */\n  __IO uint32_t X;\n} USART_TypeDef;\n"
    h = spark.createDataFrame([("h", text)], "f string, t string")
    got = {r.field: r.offset for r in files.struct_offsets(h, "f", "t").collect()}
    assert got == {"CR": 0, "SR": 4, "PAD": 6, "DR": 16, "X": 12}
    assert {(r.name, r.address) for r in files.base_addresses(h, "f", "t").collect()} == {("A_BASE", 0x40000000), ("B", 0x40000400)}
    more = "#define P_BASE 0x40000000U /* bus */\n#define T2 ((TIM_TypeDef *)0x40000400UL)\n#define U1_BASE (P_BASE + 0x1000U)\n#define U1 ((USART_TypeDef *) U1_BASE)\n#define U2 ((USART_TypeDef *)(P_BASE + 0x2000))\n#define N 5\n#define LOOP LOOP\n"
    got = {(r.name, r.address, r.type) for r in files.base_addresses(spark.createDataFrame([("h", more), ("n", None)], "f string, t string"), "f", "t").collect()}
    assert got == {("P_BASE", 0x40000000, None), ("T2", 0x40000400, "TIM_TypeDef"), ("U1_BASE", 0x40001000, None), ("U1", 0x40001000, "USART_TypeDef"), ("U2", 0x40002000, "USART_TypeDef")}


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    df = spark.sql("SELECT id % 3 AS k, timestamp'2024-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS at FROM range(12)")
    df.repartition(3).write.parquet(src)
    stream = incremental.landed(spark, f"file://{src}", df.schema)
    q = incremental.each_batch(stream, lambda b: b.groupBy("k").agg(F.count("*").alias("n")), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sum(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == 12
    seen = incremental.first_seen(stream, ["k"], "at", "1 hour").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    seen.awaitTermination(120)
    assert spark.table("seen").count() == 3
    win = incremental.counts_per_window(stream, ["k"], "at", "5 minutes", "1 minute").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    win.awaitTermination(120)
    assert spark.table("win").groupBy().sum("n").first()[0] == 12


def test_scratch(spark):
    df = materialize(spark.range(5), "t")
    assert df.count() == 5
    clear_scratch()
