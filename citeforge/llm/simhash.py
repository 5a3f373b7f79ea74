"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.llm.columns import arrow_rows, id_and_text
from citeforge.llm.graph import connected_components
from citeforge.llm.scratch import apart, written

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
#: Buckets above this size are probed fingerprint by fingerprint instead of being compared.
BUCKET = 64


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text; 0 without words."""
    words = raw.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(text, seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        spans = zip((end - size)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[s:e], seed) for s, e in spans]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of which, for any ``radius`` bit positions, one leaves out them all.

    Bit i gets the (radius + 1)-bit vector a(i), the nonzero ones in turn; mask v, for each
    nonzero v, has the bits with odd <a(i), v>. Any ``radius`` vectors span at most ``radius``
    dimensions, so some v is orthogonal to them all: its mask has none of those bits.
    """
    k = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % k + 1) & v).bit_count() % 2) for v in range(1, k + 1)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_tag): a map without shuffle. Null and empty texts have fingerprint 0;
    the tag is Spark's 64-bit hash of the text."""
    return arrow_rows(
        id_and_text(docs, id_col, text_col),
        "doc_id long, fp long, text_tag long",
        lambda ids, texts: {"doc_id": ids, "fp": [signed(fingerprint(t)) for t in texts], "text_tag": [signed(xxhash.xxh64_intdigest(t, SEED)) for t in texts]},
    )


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints at ``radius`` or fewer differing bits.

    Rows: column fp, without repeats. Each fingerprint enters one bucket per mask. Buckets of
    2 to ``bucket`` are compared within; in a larger one each fingerprint looks up, by equality,
    the few hundred values it could have as neighbours there, so that work stays linear in the
    bucket's size. Either way every pair within the radius is found.
    """
    spark = fps.sparkSession
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)))
    keyed = fps.select("fp", F.inline(tables))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    full = written(keyed.join(apart(sizes), ["t", "key"]), "simhash_buckets")

    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    few = full.filter(F.col("n") <= bucket)
    a, b = few.select("t", "key", F.col("fp").alias("u")), few.select("t", "key", F.col("fp").alias("v"))
    compared = a.join(b, ["t", "key"]).filter((F.col("u") < F.col("v")) & near(F.col("u"), F.col("v"))).select("u", "v")

    flips = [
        (t, signed(sum(1 << i for i in which)))
        for t, m in enumerate(masks)
        for n in range(1, radius + 1)
        for which in combinations([i for i in range(BITS) if not m >> i & 1], n)
    ]
    flip = F.broadcast(spark.createDataFrame(flips, "t int, flip long"))  # a fixed table: radius alone sets its size
    asked = full.filter(F.col("n") > bucket).join(flip, "t").select(F.col("fp").alias("u"), F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    probed = asked.filter("u < v").join(fps.select(F.col("fp").alias("v")), "v", "left_semi").select("u", "v")
    return compared.unionByName(probed).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id,
    text_tag, component (the least fingerprint that links reach, which names components without ids too).

    Documents are first reduced to distinct fingerprints, so copies never meet as pairs.
    ``component_id`` is the least doc_id that links reach, the row's own included; null ids are
    passed over, and a component of only null ids has a null one. Null and empty texts share
    fingerprint 0. Repeated rows share their fingerprint; an empty table gives an empty result.
    """
    own = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = connected_components(links(fps.select("fp"), radius))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(apart(ids), "root").select("fp", "component_id", F.col("root").alias("component"))
    return own.join(apart(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_tag", "component")
