import struct

from pyspark.sql import functions as F

from pulsegrain.functions import layouts, payload


def test_numbers(spark):
    rows = [(bytearray(struct.pack("<iIhHqBd", -5, 2**32 - 1, -2, 65535, -(2**62), 200, v)), v) for v in (0.0, 1.5, -2.25e-300, 5e-324, 1.7e308, -0.1)]
    df = spark.createDataFrame(rows, "p binary, v double")
    p = F.col("p")
    got = df.select(payload.signed(p, 0, 4), payload.unsigned(p, 4, 4), payload.signed(p, 8, 2), payload.unsigned(p, 10, 2), payload.signed(p, 12, 8), payload.unsigned(p, 20, 1), payload.float64(p, 21), "v", payload.signed(p, 26, 4)).collect()
    for r in got:
        assert tuple(r)[:6] == (-5, 2**32 - 1, -2, 65535, -(2**62), 200) and r[6] == r.v and r[8] is None


def test_collections_and_exceptions(spark):
    text = lambda s: s.encode("utf-16-le") + b"\0\0"
    thrown = text("System.Exception") + text("né 😀") + struct.pack("<QiH", 7, -2146233088, 16)
    df = spark.createDataFrame([(bytearray(struct.pack("<iiiih", 3, 2, 1, 0, 9)), bytearray(struct.pack("<ih", 3, 1)), bytearray(thrown), 0)], "s binary, e binary, x binary, v int")
    r = df.select(payload.gc_start(F.col("s")).alias("s"), payload.gc_end(F.col("e"), F.col("v")).alias("e"), payload.exception(F.col("x")).alias("x")).first()
    assert tuple(r.s) == (3, 2, 1, 0) and tuple(r.e) == (3, 1) and tuple(r.x) == ("System.Exception", "né 😀", -2146233088, 16)
    short = spark.createDataFrame([(bytearray(struct.pack("<i", 4)),)], "s binary").select(payload.gc_start(F.col("s")).alias("s")).first()
    assert tuple(short.s) == (4, None, None, None)


def test_texts_in_turn_are_read_in_one_pass(spark):
    """Eight texts and the number behind them; offsets built on offsets would have named the payload some hundred times."""
    texts = ["", "Ā", "né 😀", "x" * 300, "", "䈀", "b", "z"]
    body = b"".join(t.encode("utf-16-le") + b"\0\0" for t in texts) + struct.pack("<i", -7)
    fields = (*[layouts.Field(f"t{k}", "text") for k in range(8)], layouts.Field("n", "i4"))
    df = spark.createDataFrame([(bytearray(body),), (bytearray(b"a\0b"),)], "p binary").select(layouts.decode(F.col("p"), fields).alias("r"))
    assert df._jdf.queryExecution().analyzed().toString().count("hex(substring(") < 20
    got = [tuple(r.r) for r in df.collect()]
    assert got == [(*texts, -7), ("a", *[""] * 7, None)]
