"""Bloom filters of bounded size, built on the executors and tested within generated code.

Spark's own filter and membership test are used. They are not in the public Python interface: they are reached through the
JVM of a classic session (tried with Spark 4.1.2), not through Spark Connect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

#: A filter never has more bits (32 MB), so it may be sent to every executor. Up to 25 million keys have ten bits each; of
#: more keys it lets more through that it does not hold. Whoever uses it verifies what it lets through, so results never change.
MAX_BITS = 1 << 28


def bloom_filter(keys: DataFrame, key: str, n: int, bits_per_key: int = 10, max_bits: int = MAX_BITS) -> DataFrame:
    """Bloom filter of the non-null ``keys`` (``n`` of them), as one row ``bits`` (binary). Built from one filter per partition."""
    spark = keys.sparkSession
    hashed = keys.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    if n:
        made = hashed._jdf.stat().bloomFilter("h", n, max(64, min(max_bits, n * bits_per_key)))
    else:  # Spark builds none of nothing
        made = spark._jvm.org.apache.spark.util.sketch.BloomFilter.create(1, 64)
    out = spark._jvm.java.io.ByteArrayOutputStream()
    made.writeTo(out)
    return spark.createDataFrame([(bytearray(out.toByteArray()),)], "bits binary")


def might_contain(bits: DataFrame, key: Column) -> Column:
    """False only if ``key`` is certainly not in the filter. The filter is a scalar subquery, sent once to each executor."""
    jvm = bits.sparkSession._jvm
    e = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain
    return ClassicColumn(e.column(test(e.expression(bits.scalar()._jc), e.expression(F.xxhash64(key)._jc))))
