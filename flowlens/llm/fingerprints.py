"""Document fingerprints: 128-bit SimHash by signed bit votes, and permuted block tables over them. SQL functions only.

The terms of a text are its pairs of neighbouring lower-case words (the word itself if there is only one), weighted by
how often they occur. Each occurrence votes on every bit of the fingerprint, for it if the bit is set in the term's
hash and against it otherwise. The votes are counted in lanes: ``(hash >>> j) & 0x0101..01`` holds the bits j, j + 8, ...
in the eight bytes of a long, so eight sums count 64 bits for up to 127 terms, and wider lanes add up those sums.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import WORD
from flowlens.session import written

#: Terms whose votes fit the signed bytes of a long.
LANE_TERMS = 120
#: Rows of one run of neighbouring documents, about, and the runs that quantiles divide a larger one into at a time.
RUN_ROWS, KNOTS = 400, 32
#: Fingerprints of a block of those that meet in one front of a table.
BLOCK = 512
#: Keys that the rows of one fingerprint are dealt over.
SALTS = 16
BITS = 128

_BYTES = 0x0101010101010101
_WIDE = 0x000000FF000000FF


def terms(text: Column) -> Column:
    """Hashes of the terms of a text, repeats included."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                       lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """For each of the distinct ``keys`` of ``texts``: n_terms, hi and lo (the fingerprint's longs).

    A text without words has no votes: its bits are 0. No exchange is needed where the rows lie by some of the keys.
    """
    one = texts.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("nth", "h"))
    one = one.withColumn("part", F.floor(F.coalesce(F.col("nth"), F.lit(0)) / F.lit(LANE_TERMS)).cast("int"))
    one = one.withColumn("g", F.xxhash64("h")).withColumn("some", F.col("h").isNotNull())

    def lane(name: str, j: int) -> Column:
        bits = F.shiftrightunsigned(F.col(name), j).bitwiseAND(F.lit(_BYTES))
        return F.sum(F.when(F.col("some"), bits).otherwise(F.lit(0).cast("long"))).alias(f"{name}{j}")

    narrow = one.groupBy(*keys, "part").agg(
        F.sum(F.col("some").cast("long")).alias("n"), *[lane(name, j) for name in "hg" for j in range(8)])
    wide = [F.sum(F.shiftrightunsigned(F.col(f"{name}{j}"), 8 * i).bitwiseAND(F.lit(_WIDE))).alias(f"{name}{j}_{i}")
            for name in "hg" for j in range(8) for i in range(4)]
    counted = narrow.groupBy(*keys).agg(F.sum("n").alias("n_terms"), *wide)

    def packed(name: str) -> Column:
        out = F.lit(0).cast("long")
        for bit in range(64):
            byte, j = divmod(bit, 8)
            lanes = F.col(f"{name}{j}_{byte % 4}")
            votes = F.shiftrightunsigned(lanes, 32) if byte >= 4 else lanes.bitwiseAND(F.lit(0xFFFFFFFF))
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(votes * 2 > F.col("n_terms"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
        return out

    return counted.select(*keys, "n_terms", packed("h").alias("hi"), packed("g").alias("lo"))


def hex_text(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(bits: Column) -> Column:
    """The cosine of the angle that so many differing bits stand for, at least 0; 1 for none."""
    return F.greatest(F.lit(0.0), F.round(F.cos(bits * F.lit(3.141592653589793 / BITS)), 6))


def _runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``run``: larger ids have larger runs, of about RUN_ROWS rows however the ids lie.

    All ids are divided at their quantiles, then the ids of each part at theirs, until the parts are small. Null ids have
    runs below 0, divided by the md5 of their text, which is their order.
    """
    rows, without = docs.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    placed, size = docs.withColumn("run", F.lit(0).cast("long")), RUN_ROWS
    while size < rows:
        size *= KNOTS
        marks = placed.filter("doc_id IS NOT NULL").groupBy(F.col("run").alias("of")).agg(
            F.percentile_approx("doc_id", [k / KNOTS for k in range(1, KNOTS)], 10_000).alias("marks"))
        place = F.coalesce(F.size(F.filter("marks", lambda m: m <= F.col("doc_id"))), F.lit(0))
        placed = placed.join(written(marks, "marks"), F.col("run") == F.col("of"), "left").withColumn(
            "run", F.col("run") * KNOTS + place).drop("of", "marks")
    share = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    own = -1 - F.floor(share * F.lit(max(1, -(-without // RUN_ROWS)))).cast("long")
    return placed.withColumn("run", F.when(F.col("doc_id").isNull(), own).otherwise(F.col("run")))


def _next_heads(placed: DataFrame) -> DataFrame:
    """For each run as ``before``, the run after it (the last has the first) and its greatest id: run, first_id.

    Runs are put in order inside groups of neighbouring ones, and the groups among themselves.
    """
    heads = placed.groupBy("run").agg(F.max("doc_id").alias("first_id")).withColumn("group", F.floor(F.col("run") / 1024))
    head = F.struct("run", "first_id")
    groups = heads.groupBy("group").agg(F.max(head).alias("top"))
    every = Window.partitionBy()
    groups = groups.select("group", F.coalesce(F.lead("top").over(Window.orderBy(F.desc("group"))),
                                               F.max("top").over(every)).alias("beyond"))
    inside = F.lead(head).over(Window.partitionBy("group").orderBy(F.desc("run")))
    heads = heads.withColumn("inside", inside).join(groups, "group").select(
        F.col("run").alias("before"), F.coalesce("inside", "beyond").alias("next"))
    return heads.select("before", "next.run", "next.first_id")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document, by descending ``id_col`` (a number).

    Edited: the last ``floor(n_chars / 2)`` code points are replaced by the first as many (or all) of the next
    document; after the last comes the first. Returns ``id_col``, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (:func:`likeness` of the fingerprints), and the bits hi and lo.

    A null text is empty. Null ids come last; rows of one id follow each other by the md5 of their text, and equal rows
    in any order. A single document is its own next. Other columns play no part; an empty table gives an empty result.

    Rows travel once, to runs of neighbouring ids, where everything else happens: each run also gets the first row of
    the run after it, so that its last row has a next one.
    """
    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    placed = _runs(chosen)
    heads = written(_next_heads(placed), "heads").withColumnRenamed("run", "r")
    tails = placed.join(heads, (F.col("run") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy(
        "before").agg(F.min_by("text", F.md5("text")).alias("text"))
    tails = tails.select(F.lit(None).cast(chosen.schema["doc_id"].dataType).alias("doc_id"), "text",
                         F.col("before").alias("run"), F.lit(1).alias("extra"))
    rows = placed.withColumn("extra", F.lit(0)).unionByName(tails)
    order = Window.partitionBy("run").orderBy("extra", F.desc_nulls_last("doc_id"), F.md5("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select("doc_id", "run", "place", "extra", "text", n.cast("long").alias("n_chars"),
                       F.when(F.col("extra") == 0, edited).alias("edited"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
                    F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    both = rows.withColumn("sha", F.sha2("edited", 256)).withColumn("one", F.explode(kinds)).filter(
        "one.kind = 0 OR extra = 0").select("doc_id", "run", "place", "extra", "n_chars", "sha", "one.kind", "one.t")
    keys = ["run", "place", "kind", "doc_id", "extra", "n_chars", "sha"]
    found = fingerprints(both, keys, "t")
    later = Window.partitionBy("run").orderBy("place", "kind")
    bits = F.struct("hi", "lo")
    found = found.withColumn("edit", F.lead(bits).over(later)).withColumn("after", F.lead(bits, 2).over(later))
    found = found.filter("kind = 0 AND extra = 0")
    own, edit, after = (F.col("hi"), F.col("lo")), (F.col("edit.hi"), F.col("edit.lo")), (F.col("after.hi"), F.col("after.lo"))
    return found.select(
        F.col("doc_id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"),
        hex_text(*own).alias("fingerprint"), hex_text(*edit).alias("edited_fingerprint"),
        likeness(distance(own, edit)).alias("near_edited"), likeness(distance(own, after)).alias("near_next"), "hi", "lo")


def _met(prints: DataFrame, radius: int) -> DataFrame:
    """For distinct fingerprints hi, lo: ``others``, some of those that differ in 1 to ``radius`` bits, each in one row only.

    With the 128 bits in radius + 2 blocks, such a pair agrees in two whole blocks at least. Each pair of blocks is a
    permuted table with those blocks in front; fingerprints meet where the front of a table is equal, and a pair counts
    only in the first table in which it meets. Equal fingerprints are one entry, so copies never meet each other.

    Fingerprints alone with a front go first. The others of a front are dealt in blocks, and each meets every block as one
    array: a front of m fingerprints makes m * m / BLOCK rows in as many groups, never a row for each pair.
    """
    edges = [BITS * k // (radius + 2) for k in range(radius + 3)]

    def block(hi: Column, lo: Column, k: int) -> tuple[Column, Column]:
        mask = ((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1)
        signed = [m - (1 << 64) if m >> 63 else m for m in (mask >> 64, mask & ((1 << 64) - 1))]
        return hi.bitwiseAND(F.lit(signed[0]).cast("long")), lo.bitwiseAND(F.lit(signed[1]).cast("long"))

    mine = (F.col("hi"), F.col("lo"))
    pairs = list(combinations(range(radius + 2), 2))
    fronts = F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*block(*mine, a), *block(*mine, b)).alias("front"))
                       for t, (a, b) in enumerate(pairs)])
    prints = prints.select("hi", "lo").distinct()
    tables = prints.select("hi", "lo", F.explode(fronts).alias("f")).select("hi", "lo", "f.table", "f.front")
    shared = tables.groupBy("table", "front").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    shared = written(tables.join(shared.select("table", "front", blocks.alias("blocks")), ["table", "front"]), "fronts")
    key = ["table", "front", "block"]
    entries = shared.withColumn("block", F.pmod(F.xxhash64(*mine), F.col("blocks")).cast("int")).groupBy(*key).agg(
        F.collect_list(F.struct("hi", "lo")).alias("entries"))
    asks = shared.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def near(other: Column) -> Column:
        theirs = (other["hi"], other["lo"])
        bits = distance(mine, theirs)
        same = []
        for k in range(radius + 2):
            x, y = block(*mine, k), block(*theirs, k)
            same.append((x[0] == y[0]) & (x[1] == y[1]))
        first = F.lit(-1)
        for t, (a, b) in reversed(list(enumerate(pairs))):
            first = F.when(same[a] & same[b], F.lit(t)).otherwise(first)
        return (bits > 0) & (bits <= radius) & (first == F.col("table"))

    return asks.join(entries, key).select("hi", "lo", F.filter("entries", near).alias("others"))


def within_radius(prints: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs of distinct fingerprints (hi, lo) that differ in 1 to ``radius`` bits: hi, lo, other_hi, other_lo, bits."""
    found = _met(prints, radius).select("hi", "lo", F.explode("others").alias("o")).select(
        "hi", "lo", F.col("o.hi").alias("other_hi"), F.col("o.lo").alias("other_lo"))
    ahead = (F.col("hi") < F.col("other_hi")) | ((F.col("hi") == F.col("other_hi")) & (F.col("lo") < F.col("other_lo")))
    bits = distance((F.col("hi"), F.col("lo")), (F.col("other_hi"), F.col("other_lo")))
    return found.filter(ahead).withColumn("bits", bits)


def with_neighbours(found: DataFrame, radius: int = 3) -> DataFrame:
    """``found`` with n_near: how many other fingerprints lie within ``radius`` bits."""
    counts = _met(found, radius).groupBy("hi", "lo").agg(F.sum(F.size("others")).cast("long").alias("n_near"))
    # Copies share a fingerprint: they are dealt over several keys, and the few fingerprints with neighbours go to all.
    counts = counts.filter("n_near > 0").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(*found.columns), F.lit(SALTS)).cast("int"))
    return salted.join(counts, ["hi", "lo", "_salt"], "left").drop("_salt").withColumn(
        "n_near", F.coalesce("n_near", F.lit(0).cast("long")))
