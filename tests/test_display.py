"""Sizes as people read them."""

from pyspark.sql import functions as F

from quillspark.functions.display import size_text


def test_sizes_halfway_between_two_digits_go_to_the_even_one(spark):
    sizes = [0, 1023, 1024, 347_392, 349_440, 349_952, 1_048_575, 1_048_576 + 262_144, 1_048_576 + 786_432, 5 * 1024**3 // 4, 3 * 1024**4 + 123, None]
    got = [r["s"] for r in spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long").select("i", size_text(F.col("n")).alias("s")).orderBy("i").collect()]
    units = ((1024**3, "GB"), (1024**2, "MB"), (1024, "KB"))

    def plain(n):  # Python rounds like C
        return None if n is None else f"{n} B" if n < 1024 else next(f"{n / u:.1f} {name}" for u, name in units if n >= u)

    assert got == [plain(n) for n in sizes] and got[3] == "339.2 KB" and got[9] == "1.2 GB"
