"""Integers of any length and mergeable profiles."""
import random

from pyspark.sql import functions as F

from docatlas.operators import calls as K


def test_integers_keep_all_digits(spark):
    rng = random.Random(4)
    values = [0, 1, 2 ** 31 - 1, 2 ** 31, 2 ** 63, 2 ** 64, 10 ** 38, 10 ** 38 - 1, 16 ** 200 - 1, 8 ** 300 + 5, int("7" * 1000)] + [rng.getrandbits(rng.randint(1, 900)) for _ in range(150)]
    tokens = []
    for v in values:
        text = rng.choice([str, hex, oct, bin])(v)
        if rng.random() < 0.3 and len(text) > 4:
            text = text[:-1] + "_" + text[-1]
        tokens.append(rng.choice(["", "-", "+"]) + rng.choice([text, text.upper().replace("0X", "0x").replace("0O", "0o").replace("0B", "0b")]) + rng.choice(["", " "]))
    tokens += ["0x" + "0" * 50 + "f", "-0", "000", "0_0", "010", "0x", "1__2", "_1", "1_", "abc", "", "0xg", "0b2", "+-1", "0b" + "0" * 90]
    d = spark.createDataFrame([(t,) for t in tokens], "token string")
    for r in K.typed(d, "token").collect():
        try:
            want = int(r.token, 0) if r.token.strip() else None
        except ValueError:
            want = None
        assert r.digits == (None if want is None else str(want)), r.token
        assert r.kind == ("wstr" if want is None else "int")
        if want is not None:
            small = -2 ** 31 <= want < 2 ** 31
            assert r.width == (("i32" if want < 0 else "u32") if small else ("i64" if want < 0 else "u64"))
            assert r.number is None if abs(want) >= 10 ** 38 else int(r.number) == want
    buffers = spark.createDataFrame([("$b:" + "9" * 60,), ("$b:-5",), ("$b:0",), ("$b:0x4000000",), ("$b:0x4000001",), ("$b:x",)], "token string")
    assert [r.error for r in K.typed(buffers, "token").collect()] == ["buffer size too large", "buffer size not positive", "buffer size not positive", None, "buffer size too large", "invalid buffer size"]


def test_profiles_merge_in_any_order(spark):
    d = spark.range(40_000).select(F.lit("m").alias("module"), (F.col("id") % 3).cast("string").alias("function"), (F.col("id") % 9001).alias("l_orderkey"),
                                   (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("elapsed"), (F.col("id") % 7).alias("day"))
    by_day = K.profile_sketches(d, "day")
    halves = [K.merged_profiles(by_day.where(c)) for c in ("day < 3", "day >= 3")]
    for merged in (K.merged_profiles(by_day), K.merged_profiles(halves[0].unionByName(halves[1])), K.profile_sketches(d)):
        for r in K.read_profiles(merged, (0.1, 0.5, 0.99)).collect():
            own = d.where(F.col("function") == r.function)
            assert r.calls == own.count() and abs(r.sources / own.select("l_orderkey").distinct().count() - 1) < 0.03
            for q, x in zip((0.1, 0.5, 0.99), r.quantiles):
                assert abs(own.where(F.col("elapsed") <= x).count() / r.calls - q) < 0.02
